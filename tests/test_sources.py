"""Footers instead of rows, and conditions that split a read."""

import datetime
import decimal
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cutover.operators import dictionary, load
from cutover.sources import io
from cutover.sources.footers import footer_table

c = F.col


@pytest.fixture
def numbers(spark, tmp_path):
    path = str(tmp_path / "numbers")
    spark.range(0, 10_000, 1, 4).select((c("id") - 5000).alias("a"), (c("id") % 7).cast("int").alias("b"), F.lit(None).cast("int").alias("n"), F.concat(F.lit("t"), c("id")).alias("t")).write.parquet(path)
    return path


def pushed(df):
    return [x.split("PushedAggregation: ")[1].split("]")[0] for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "PushedAggregation: [" in x]


def test_counts_and_extremes_come_from_footers(spark, numbers):
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    df = footer_table(spark, numbers)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    check = load.overflow_check({"numbers": df}, 10)
    assert pushed(load.unpivot_aggregates(df, "t", ["a", "b"], {"least": F.min, "greatest": F.max})) == ["[MIN(a), MAX(a), MIN(b), MAX(b)"]
    plain = load.overflow_check({"numbers": spark.read.parquet(numbers)}, 10)
    assert sorted(map(tuple, check.collect())) == sorted(map(tuple, plain.collect())) and {r.column_name: (int(r.max_abs), r.overflows) for r in check.collect()} == {"a": (5000, True), "b": (6, False)}
    counts = dictionary.table_row_counts({"numbers": df})
    assert pushed(counts) == ["[COUNT(*)"] and counts.first().rows == 10_000
    assert pushed(df.agg(F.min("a"))) == ["[MIN(a)"]
    sample = dictionary.sample_row("numbers", df)
    assert {r.column_name: r.sample_value for r in sample.collect()} == {"a": "-5000", "b": "0", "n": None, "t": "t0"}
    # reading columns is as ever
    assert df.filter("b = 3").count() == spark.read.parquet(numbers).filter("b = 3").count()


def test_a_table_without_sample_is_named(spark, caplog):
    torn = spark.range(3).select(F.raise_error(F.lit("torn")).cast("long").alias("k"))
    assert dictionary.sample_row("lost", torn) is None and "lost" in caplog.text and "torn" in caplog.text


def parts_of(values, predicates):
    """How many rows meet each condition, and that each row meets exactly one."""
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, k BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    sizes = [con.execute(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in predicates]
    assert sum(sizes) == len(values) == con.execute("SELECT count(*) FROM t WHERE " + " OR ".join(f"({p})" for p in predicates)).fetchall()[0][0]
    return sizes


def test_split_of_a_skewed_key():
    rng = random.Random(3)
    values = [rng.randint(0, 999) for _ in range(2000)] + [500] * 1000 + [7] * 400 + [None] * 20
    histogram = sorted({v: values.count(v) for v in values if v is not None}.items())
    sizes = parts_of(values, io.split_predicates(histogram, "k", 10))
    assert max(sizes) == values.count(500) and sorted(sizes)[-3] <= 342 and len(sizes) <= 22
    cut = parts_of(values, io.split_predicates(histogram, "k", 10, within="id"))
    assert max(cut) <= 430 and len(cut) > len(sizes)
    assert parts_of(values, io.split_predicates(histogram, "k", 1)) == [len(values)]
    assert parts_of([4] * 30, io.split_predicates([(4, 30)], "k", 3, within="id")) == [10, 10, 10]
    assert parts_of([-5, None, 99, 2], io.split_predicates([(1, 1), (2, 1), (3, 1)], "k", 3)) == [2, 1, 1]
    for wrong in (([], 3), ([(1, 1)], 0), ([(2, 1), (1, 1)], 2)):
        with pytest.raises(ValueError):
            io.split_predicates(wrong[0], "k", wrong[1])


def test_histogram_of_a_table(spark):
    df = spark.range(9000).select(F.when(c("id") % 3 == 0, 17).when(c("id") % 100 == 1, None).otherwise(c("id")).alias("k"))
    values = [r.k for r in df.collect()]
    histogram = io.key_histogram(df, "k", 50)
    assert sum(n for _, n in histogram) == len([v for v in values if v is not None]) and dict(histogram)[17] == values.count(17)
    sizes = parts_of(values, io.split_predicates(histogram, "k", 12, within="id"))
    assert max(sizes) <= 2.2 * len(values) / 12
    days = spark.range(100).select(F.date_add(F.lit("2024-01-01").cast("date"), c("id").cast("int")).alias("d"))
    assert io.split_predicates(io.key_histogram(days, "d", 10), "d", 2)[0].startswith("d < DATE '2024-0")
    assert io.key_histogram(df.limit(0), "k") == []
    with pytest.raises(ValueError):
        io.key_histogram(df.withColumn("k", c("k").cast("string")), "k")


def test_literals():
    assert [io.sql_literal(v) for v in (5, -2.5, "it's", datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3, 4, 5), decimal.Decimal("1E+3"))] == [
        "5", "-2.5", "'it''s'", "DATE '2024-01-02'", "TIMESTAMP '2024-01-02 03:04:05'", "1000"]
    for wrong in (None, True):
        with pytest.raises(ValueError):
            io.sql_literal(wrong)
