"""Replacement of tables: whole, by partition, after failures and after a lost driver."""

from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cutover.operators import load
from cutover.sources import replace

c = F.col


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "tables" / "my table")


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).collect())


def alone(path):
    """The table has no leftovers beside it."""
    return [p.name for p in Path(path).parent.iterdir()] == [Path(path).name]


def failing(df, column, at):
    return df.withColumn(column, F.when(c(column) == at, F.raise_error(F.lit("on purpose")).cast("long")).otherwise(c(column)))


def test_replaces_and_keeps_the_schema(spark, path):
    replace.replace_table(spark.range(5).select(c("id").alias("Key"), F.lit("a").alias("v")), path)
    replace.replace_table(spark.range(3).select(F.lit("b").alias("V"), c("id").cast("int").alias("KEY"), F.lit(1).alias("more")), path)
    assert rows(spark, path) == [(0, "b"), (1, "b"), (2, "b")] and alone(path)
    assert spark.read.parquet(path).dtypes == [("Key", "bigint"), ("v", "string")]
    with pytest.raises(ValueError, match="v"):
        replace.replace_table(spark.range(3).withColumnRenamed("id", "key"), path)
    assert len(rows(spark, path)) == 3
    replace.replace_table(spark.read.parquet(path).limit(0), path)
    assert rows(spark, path) == []
    replace.replace_table(spark.range(2).select(c("id").alias("key"), F.lit("c").alias("v")), path)
    assert rows(spark, path) == [(0, "c"), (1, "c")]


def test_a_failing_write_leaves_the_old_rows(spark, path):
    replace.replace_table(spark.range(5), path)
    for parts in (1, 4):
        with pytest.raises(PySparkException):
            replace.replace_table(failing(spark.range(0, 100, 1, parts), "id", 77), path)
        assert rows(spark, path) == [(k,) for k in range(5)] and alone(path)
    # the same statement run again, without the fault
    replace.replace_table(spark.range(100), path)
    assert len(rows(spark, path)) == 100


def test_a_write_may_read_its_own_table(spark, path):
    replace.replace_table(spark.range(10), path)
    mine = spark.read.parquet(path)
    assert mine.count() == 10
    replace.replace_table(mine.filter("id >= 4"), path)
    assert rows(spark, path) == [(k,) for k in range(4, 10)]
    with pytest.raises(PySparkException):
        replace.replace_table(failing(spark.read.parquet(path), "id", 9), path)
    assert len(rows(spark, path)) == 6


def test_a_lost_driver(spark, path, monkeypatch):
    replace.replace_table(spark.range(5), path)

    class Lost(BaseException):
        pass

    # lost between the two renames: the table is out of place
    whole = replace.Folder.rename
    moves = []

    def once(self, to):
        moves.append(to.path)
        if len(moves) > 1:
            raise Lost
        whole(self, to)

    monkeypatch.setattr(replace.Folder, "rename", once)
    monkeypatch.setattr(replace.Folder, "delete", lambda self: None)
    with pytest.raises(Lost):
        replace.replace_table(spark.range(9), path)
    monkeypatch.undo()
    assert not Path(path).exists()
    assert replace.recover_table(spark, path) and rows(spark, path) == [(k,) for k in range(5)] and alone(path)
    assert not replace.recover_table(spark, path) and len(rows(spark, path)) == 5
    replace.replace_table(spark.range(9), path)
    assert len(rows(spark, path)) == 9 and alone(path)


def test_a_failing_swap_puts_the_table_back(spark, path, monkeypatch):
    replace.replace_table(spark.range(5), path)
    whole = replace.Folder.rename
    monkeypatch.setattr(replace.Folder, "rename", lambda self, to: (_ for _ in ()).throw(OSError("no")) if replace.NEXT in self.path else whole(self, to))
    with pytest.raises(OSError):
        replace.replace_table(spark.range(9), path)
    assert rows(spark, path) == [(k,) for k in range(5)] and alone(path)


def test_partitions(spark, path):
    df = spark.range(12).select("id", (c("id") % 3).cast("int").alias("p q"), F.when(c("id") < 6, "a/b").otherwise("z").alias("r"))
    with pytest.raises(ValueError):
        replace.replace_partitions(df, path)
    replace.replace_partitions(df, path, ["p q", "r"])
    assert replace.Folder(spark, path).partition_columns() == ["p q", "r"]
    mine = spark.read.parquet(path)
    replace.replace_partitions(mine.filter("`p q` = 1 AND r = 'z' AND id > 8"), path)
    want = sorted((k, k % 3, "a/b" if k < 6 else "z") for k in range(12) if not (k % 3 == 1 and 6 <= k <= 8))
    assert rows(spark, path) == want
    with pytest.raises(PySparkException):
        replace.replace_partitions(failing(spark.read.parquet(path).filter("r = 'z'"), "id", 11), path)
    assert rows(spark, path) == want
    # a whole replacement keeps the partitions
    replace.replace_table(spark.read.parquet(path).filter("id < 5"), path)
    assert replace.Folder(spark, path).partition_columns() == ["p q", "r"] and rows(spark, path) == [r for r in want if r[0] < 5]
    with pytest.raises(ValueError):
        replace.replace_partitions(df, path, ["r"])


def test_unpartitioned_tables_have_no_partitions_to_replace(spark, path):
    replace.replace_table(spark.range(3), path)
    with pytest.raises(ValueError):
        replace.replace_partitions(spark.range(1), path)
    assert len(rows(spark, path)) == 3


def test_load_log_names_the_failing_task(spark, tmp_path):
    good, root = spark.range(4), str(tmp_path / "load")
    assert all(r.task_ok for r in load.full_load({"A": good, "B": good}, root).collect())
    log = {r.table_name: r for r in load.full_load({"A": spark.range(6), "B": failing(spark.range(6), "id", 5)}, root).collect()}
    assert (log["A"].state, log["A"].task_ok, log["A"].rows) == ("loaded", True, 6)
    assert (log["B"].state, log["B"].task_ok, log["B"].rows) == ("errored", False, None) and "on purpose" in log["B"].error
    # what was there before is still there
    assert len(rows(spark, f"{root}/b")) == 4 and len(rows(spark, f"{root}/a")) == 6
