"""Registered queries: a callable on the given tables and the SQL that must agree with it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutover.plans import standin

TYPES = {"i": ("bigint", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN"), "D": ("date", "DATE")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given parquet tables and the application tables read through them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in standin.TABLES:
            return standin.TABLES[name][0](self)
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in spec.split()]


def with_standins(sql: str) -> str:
    """Prefix the definitions of the application tables the text names."""
    used: dict[str, str] = {}

    def visit(text: str) -> None:
        for name, (_, body) in standin.TABLES.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(body)
                used[name] = body

    visit(sql)
    if not used:
        return sql
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in used.items())
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{sql[head.end():]}"
    return f"WITH {ctes}\n{sql}"


def query(name: str, columns: str, sql: str | None = None):
    """Register a query; ``columns`` lists ``name:type`` for both engines."""
    cols = _columns(columns)

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Tables(spark, folder))
            return df.select(*(F.col(c).cast(TYPES[t][0]).alias(c) for c, t in cols))

        QUERIES[name] = run
        if sql is not None:
            picked = ", ".join(f"CAST({c} AS {TYPES[t][1]}) AS {c}" for c, t in cols)
            ORACLES[name] = f"SELECT {picked} FROM (\n{with_standins(sql)}\n) AS q"
        return fn

    return register
