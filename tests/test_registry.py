"""Every registered query beside its check SQL, and the driver's entry points."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

from cutover.plans import all_oracles, all_queries  # noqa: E402

SMALL = Path("/root/testdata/sf0.001")
WITHOUT_SQL: set[str] = set()

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.connect(str(SMALL))


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_agrees_with_sql(spark, con, name):
    verdict, rows, _ = check.compare(spark, con, str(SMALL), name)
    assert verdict.startswith("ok") or (name in WITHOUT_SQL and rows > 0), verdict


def test_entry_points(spark):
    assert set(all_oracles()) == set(all_queries()) - WITHOUT_SQL
    assert set(entry.queries()) >= set(all_queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
