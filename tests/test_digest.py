"""Digests: what they tell apart, what they move, and the way down from buckets to cells."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.functions.equality import canonical, cells_equal
from cutover.operators import compare as R
from cutover.operators import digest

c = F.col


def tree(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hash_and_move_digests_only(spark):
    s = spark.range(1000).select(c("id").alias("k"), *(F.concat(F.lit(f"v{i}"), c("id")).alias(f"text{i}") for i in range(20)))
    for plan in (tree(digest.key_digests(s, s, ["k"])), tree(digest.bucket_digests(s, s, ["k"]))):
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
        moved = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(moved) == 1 and "text" not in moved[0]


def test_equal_tables_are_not_read_again(spark, monkeypatch):
    asked = []
    whole = digest.key_digests
    monkeypatch.setattr(digest, "key_digests", lambda s, t, keys, *buckets: asked.append(len(buckets)) or whole(s, t, keys, *buckets))
    s = spark.range(5000).select(c("id").alias("k"), (c("id") * 3).alias("v"))
    found, rows = digest.changed_keys(s, s.toDF("K", "V"), ["k"], unique=True)
    assert found.count() == 0 and rows == {"source_rows": 5000, "target_rows": 5000} and asked == [0]
    t = s.withColumn("v", F.when(c("k") == 77, 0).otherwise(c("v")))
    found, _ = digest.changed_keys(s, t, ["k"], unique=True)
    assert [(r.k, r.change) for r in found.collect()] == [(77, "changed")] and asked == [0, 1]


@pytest.mark.parametrize("unique", [False, True])
def test_against_plain_comparison(spark, unique):
    rng = random.Random(7)
    draw = lambda: (rng.choice([None, "a", "b", ""]), rng.choice([None, "a", "b", ""]), rng.choice([None, 0, 1, -1]), rng.choice([None, 0.0, -0.0, float("nan"), 1.5]))
    source = {k: draw() for k in range(300)}
    target = {k: (draw() if rng.random() < 0.3 else v) for k, v in source.items() if rng.random() > 0.1} | {k: draw() for k in range(1000, 1010)}
    ddl = "k long, a string, b string, n int, x double"
    frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows.items()], ddl).repartition(5)
    got = {(r.k, r.change, r.column) for r in R.keyed_diff(frame(source), frame(target), ["k"], unique).collect()}
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and a != a and b != b)
    want = {(k, "missing_in_target", None) for k in source.keys() - target.keys()} | {(k, "extra_in_target", None) for k in target.keys() - source.keys()}
    want |= {(k, "changed", n) for k in source.keys() & target.keys() for n, a, b in zip("abnx", source[k], target[k]) if not same(a, b)}
    assert got == want
    report = R.reconcile("t", frame(source), frame(target), ["k"], unique).first()
    assert (report.source_rows, report.target_rows) == (len(source), len(target))
    assert (report.missing_rows, report.extra_rows, report.changed_cells) == tuple(sum(w[1] == x for w in want) for x in ("missing_in_target", "extra_in_target", "changed"))


def test_moved_nulls_and_nested_cells_differ(spark):
    ddl = "k long, a string, b string, l array<string>, s struct<t:timestamp_ntz,u:string>, m map<string,int>"
    at = datetime.datetime(2020, 1, 1, 0, 0, 0, 1)
    base = (1, None, "x", [None, "a, b"], (at, None), {"a": 1})
    others = [(1, "x", None, *base[3:]), (*base[:3], ["a, b", None], *base[4:]), (*base[:3], [None, "a", "b"], *base[4:]), (*base[:3], [None, "a, b", None], *base[4:]),
              (*base[:4], (at.replace(microsecond=2), None), base[5]), (*base[:4], (None, None), base[5]), (*base[:5], {"a": 2}), (*base[:5], None)]
    s = spark.createDataFrame([base], ddl)
    for other in others:
        assert R.keyed_diff(s, spark.createDataFrame([other], ddl), ["k"]).count() > 0, other
    assert R.keyed_diff(s, s, ["k"]).count() == 0


NUMBERS = [None, 0, 1, -1, 7, 2**53 + 1, 10**18]
KINDS = [T.IntegerType(), T.LongType(), T.DecimalType(38, 0), T.DecimalType(38, 10), T.DecimalType(20, 2), T.DoubleType(), T.FloatType(), T.StringType()]


@pytest.mark.parametrize("left", KINDS, ids=str)
@pytest.mark.parametrize("right", KINDS, ids=str)
def test_canonical_cells_are_equal_where_cells_are(spark, left, right):
    texts = ["0", "1", "-1", "0.5", "0.1", "7.10", "9007199254740993", "1000000000000000000", "1000000000000000000000000000000", "-0.0", None]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    to = lambda x, kind: c(x) if isinstance(kind, T.StringType) else c(x).try_cast("decimal(38,10)").try_cast(kind) if isinstance(kind, T.IntegralType) else c(x).try_cast(kind)
    df = df.select(to("a", left).alias("l"), to("b", right).alias("r"))
    df = df.select("l", "r", cells_equal(c("l"), left, c("r"), right).alias("equal"), canonical(c("l"), left, right).eqNullSafe(canonical(c("r"), right, left)).alias("grouped"))
    assert [tuple(r) for r in df.collect() if r.equal != r.grouped] == []


def test_values_that_do_not_fit_are_no_nulls(spark):
    source = spark.createDataFrame([(1, Decimal(10) ** 30), (1, Decimal(5))], "k long, v decimal(38,0)")
    target = spark.createDataFrame([(1, None), (1, Decimal("5.0000000000"))], "k long, v decimal(38,10)")
    got = {(r.v, r.change, r.copies) for r in R.repeated_key_diff(source, target, ["k"]).collect()}
    assert got == {("1" + "0" * 30, "missing_in_target", 1), (None, "extra_in_target", 1)}
    zero = spark.createDataFrame([(1, -0.0), (1, 0.0)], "k long, v double")
    assert R.repeated_key_diff(zero, zero.withColumn("v", c("v").cast("float")), ["k"]).count() == 0


def test_one_failing_pair_does_not_fail_the_report(spark):
    good = spark.range(3).withColumnRenamed("id", "k")
    torn = good.withColumn("k", F.when(c("k") == 2, F.raise_error(F.lit("torn")).cast("long")).otherwise(c("k")))

    def absent():
        return spark.read.parquet("/no/such/table")

    rows = R.reconcile_many({"good": (good, good, ["k"]), "torn": (good, torn, ["k"]), "absent": (absent, good, ["k"]), "wrong": (good, good, ["nokey"]), "last": (good, good, ["k"], True)}).collect()
    assert [(r.tc_id, r.status, r.failure_type) for r in rows] == [
        ("good", "passed", None), ("torn", "failed", "execution_error"), ("absent", "failed", "execution_error"), ("wrong", "failed", "execution_error"), ("last", "passed", None)]
    assert "torn" in rows[1].note and "/no/such/table" in rows[2].note and "nokey" in rows[3].note


def test_hot_and_null_keys(spark):
    hot = spark.range(3000).select(F.when(c("id") % 3 == 0, F.lit(None)).otherwise(c("id")).alias("k"), c("id").alias("v"))
    changed = hot.withColumn("v", F.when(c("v") == 9, -9).otherwise(c("v")))
    for unique in (False, True):
        got = R.keyed_diff(hot, changed, ["k"], unique).collect()
        assert [(r.k, r.change, r.source_value, r.target_value) for r in got] == [(None, "duplicate_key", "1000 copies", "1000 copies")]
    assert {(r.k, r.v, r.change) for r in R.repeated_key_diff(hot, changed, ["k"]).collect()} == {(None, 9, "missing_in_target"), (None, -9, "extra_in_target")}
    one = spark.createDataFrame([(None, "a"), (1, "b")], "k long, v string")
    two = spark.createDataFrame([(None, "z"), (1, "b")], "k long, v string")
    assert [(r.k, r.change, r.source_value, r.target_value) for r in R.keyed_diff(one, two, ["k"]).collect()] == [(None, "changed", "a", "z")]
