"""Registered queries over the given tables."""

import importlib
import pkgutil

from cutover.plans import registry


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")


def all_queries():
    _load()
    return dict(registry.QUERIES)


def all_oracles():
    _load()
    return dict(registry.ORACLES)
