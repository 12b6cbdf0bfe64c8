"""Rows at wanted places against a full sort, with ties, nulls, text and few values."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from cutover.operators import compare as R
from cutover.operators import ordered, selection

c = F.col


def brute(rows, key, falling=False, ties=lambda r: ()):
    """The rows in the library's order: nulls last when rising, first when falling."""
    nan = lambda v: isinstance(v, float) and math.isnan(v)
    place = lambda v: (v is None, 0 if v is None else math.inf if nan(v) else v, nan(v))
    return sorted(sorted(rows, key=ties), key=lambda r: place(r[key]), reverse=falling)


DAY = datetime.datetime(2024, 2, 28, 23, 59, 0)
LEADS = {
    "long": ("long", lambda g: g.choice([None, g.randint(-5, 5), g.randint(-(2**62), 2**62)])),
    "few": ("int", lambda g: g.choice([None, 1, 2])),
    "double": ("double", lambda g: g.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, g.random()])),
    "text": ("string", lambda g: g.choice([None, "", "a", "prefix" + str(g.randint(0, 99)), "é", "\U0001f600x"])),
    "time": ("timestamp_ntz", lambda g: g.choice([None, DAY + datetime.timedelta(milliseconds=g.randint(-10**6, 10**6))])),
    "day": ("date", lambda g: g.choice([None, DAY.date() + datetime.timedelta(days=g.randint(-400, 400))])),
    "flag": ("boolean", lambda g: g.choice([None, True, False])),
    "list": ("array<int>", lambda g: [g.randint(0, 3)]),
    "nothing": ("int", lambda g: None),
}


@pytest.mark.parametrize("falling", [False, True])
@pytest.mark.parametrize("kind", LEADS)
def test_against_a_full_sort(spark, kind, falling):
    ddl, draw = LEADS[kind]
    rng = random.Random(f"{kind}{falling}")
    rows = [(draw(rng), k, f"w{k}") for k in range(400)]
    df = spark.createDataFrame(rows, f"v {ddl}, k int, w string").repartition(5)
    order = [("v", "desc") if falling else "v", "k"]
    whole = {r.k: r.i for r in ordered.global_index(df, order, "i").collect()}
    wanted = [(0, 4), (50, 50), (51, 51), (200, 203), (399, 399)]
    got, n = selection.numbered_rows(df, order, lambda n: wanted, lambda n: lambda i: (i < 5) | i.isin(50, 51, 399) | i.between(200, 203))
    assert n == 400 and got.columns == ["v", "k", "w", "_i"]
    places = {i for a, b in wanted for i in range(a, b + 1)}
    assert sorted((r.k, r["_i"], r.w) for r in got.collect()) == sorted((k, i, f"w{k}") for k, i in whole.items() if i in places)
    if kind not in ("list", "text"):
        want = brute(rows, 0, falling, lambda r: r[1])
        assert {r.k: r["_i"] for r in got.collect()} == {want[i][1]: i for i in places}


def test_copies_of_a_row_keep_their_number(spark):
    rows = [(k // 40, "same") for k in range(400)]
    got, _ = selection.numbered_rows(spark.createDataFrame(rows, "k int, w string"), ["k"], lambda n: [(0, 9), (100, 130)], lambda n: lambda i: (i < 10) | i.between(100, 130))
    assert sorted((r["_i"], r.k) for r in got.collect()) == [(i, i // 40) for i in [*range(10), *range(100, 131)]]


def test_what_is_moved_does_not_depend_on_the_width(spark, monkeypatch):
    written = []
    for module in (selection, ordered):
        monkeypatch.setattr(module, "stage", lambda df, label, whole=module.stage: written.append((label, sorted(df.columns))) or whole(df, label))
    df = spark.range(20_000).select(c("id").alias("k"), *(F.concat(F.lit(f"text{i}"), c("id")).alias(f"t{i}") for i in range(20)))
    got = R.head_middle_tail(df, ["k"], 5, 10, 5)
    assert got.count() == 20 and {len(columns) for _, columns in written} <= {2, 4} and not any(x.startswith("t") for _, columns in written for x in columns)
    # only rows around the wanted places are ordered
    seen = []
    monkeypatch.setattr(selection, "global_index", lambda df, *a: seen.append(df.count()) or ordered.global_index(df, *a))
    assert R.head_middle_tail(df, ["k"], 5, 10, 5).count() == 20 and seen[0] < 400
    assert R.bounded(df, ["k"], 50).count() == 50 and seen[1] < 100


def test_a_poor_sketch_does_not_matter(spark, monkeypatch):
    df = spark.range(5000).select((c("id") * 7 % 5000).alias("k"))
    monkeypatch.setattr(selection, "_windows", lambda *a: [(1000.0, 1010.0), (3000.0, 3000.0)])
    got, _ = selection.numbered_rows(df, ["k"], lambda n: [(10, 12), (3000, 3000), (4999, 4999)], lambda n: lambda i: i.between(10, 12) | i.isin(3000, 4999))
    assert sorted((r.k, r["_i"]) for r in got.collect()) == [(i, i) for i in (10, 11, 12, 3000, 4999)]


def test_nothing_and_little(spark):
    empty = spark.createDataFrame([], "k int, w string")
    assert R.bounded(empty, ["k"]).count() == 0 and R.head_middle_tail(empty, ["k"]).count() == 0
    assert R.bounded(empty, ["k"]).columns == ["k", "w", "total_rows", "sampled"]
    one = spark.createDataFrame([(None, "x")], "k int, w string")
    assert [tuple(r) for r in R.bounded(one, ["k"]).collect()] == [(None, "x", 1, False)]
    with pytest.raises(ValueError):
        R.bounded(one, [])
