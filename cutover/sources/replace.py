"""Replacement of tables that lie in folders: all of a table, or the partitions at hand.

New rows are written beside the table and take its place when all of them are
there.  Until then the table is as it was, so a write may fail, be run again,
or read the very table it replaces.  What the swap sets aside is found and put
back by the next replacement, or by ``recover_table``, should the driver be
lost between its two renames.

One writer at a time may replace a table.  Folders must be in a file system
whose rename moves a folder as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the names of folders beside a table go on with: rows being written, and the rows being replaced.
NEXT, OLD = ".next-", ".old-"

c = F.col


class Folder:
    """A folder of whatever file system its path names, and its siblings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        at = path_of(path.rstrip("/"))
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.at = self.fs.makeQualified(at)

    def beside(self, mark: str) -> Folder:
        return Folder(self.spark, f"{self.at.toString()}{mark}{uuid.uuid4().hex}")

    def siblings(self, mark: str) -> list[Folder]:
        """Folders beside this one whose names go on with ``mark``."""
        parent = self.at.getParent()
        if not self.fs.exists(parent):
            return []
        name = f"{self.at.getName()}{mark}"
        found = [s.getPath() for s in self.fs.listStatus(parent) if s.isDirectory() and s.getPath().getName().startswith(name)]
        return [Folder(self.spark, p.toString()) for p in found]

    @property
    def path(self) -> str:
        return self.at.toString()

    def exists(self) -> bool:
        return self.fs.exists(self.at)

    def rename(self, to: Folder) -> None:
        if not self.fs.rename(self.at, to.at):
            raise OSError(f"{self.path} could not be renamed to {to.path}")

    def delete(self) -> None:
        self.fs.delete(self.at, True)

    def partition_columns(self) -> list[str]:
        """Names of the partition columns, outermost first; one listing per level."""
        out, at = [], self.at
        while True:
            names = (s.getPath() for s in self.fs.listStatus(at) if s.isDirectory())
            inner = next((p for p in names if "=" in p.getName() and not p.getName().startswith((".", "_"))), None)
            if inner is None:
                return out
            out.append(unquote(inner.getName().split("=", 1)[0]))
            at = inner

    def has_rows_files(self) -> bool:
        """Whether there is anything but marks and hidden files."""
        return any(not s.getPath().getName().startswith((".", "_")) for s in self.fs.listStatus(self.at))


def recover_table(spark: SparkSession, path: str) -> bool:
    """Put back a table whose replacement was cut off between its two renames, and delete leftovers of others.

    True if there was a table to put back.  A table that is in place stays as it is.
    """
    table = Folder(spark, path)
    back = False
    for old in table.siblings(OLD):
        if not table.exists():
            old.rename(table)
            back = True
        else:
            old.delete()
    for unfinished in table.siblings(NEXT):
        unfinished.delete()
    if back:
        spark.catalog.refreshByPath(table.path)
    return back


def table_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The columns of a table, or None where there is none yet."""
    table = Folder(spark, path)
    if not table.exists() or not table.has_rows_files():
        return None
    schema = spark.read.parquet(table.path).schema
    return schema if schema.fields else None


def fitted(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    """``df`` with the names, order and types of a table's columns; columns the table lacks are left out.

    A column that is missing fails here, before anything is written.
    """
    if schema is None:
        return df
    own = {x.lower(): x for x in df.columns}
    missing = [f.name for f in schema.fields if f.name.lower() not in own]
    if missing:
        raise ValueError(f"columns of the table are missing: {', '.join(missing)}")
    return df.select(*(c(own[f.name.lower()]).cast(f.dataType).alias(f.name) for f in schema.fields))


def swap_in(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``df`` beside the table and put it in the table's place, whatever schema that has."""
    spark = df.sparkSession
    recover_table(spark, path)
    table = Folder(spark, path)
    new, old = table.beside(NEXT), table.beside(OLD)
    try:
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(new.path)
    except BaseException:
        new.delete()
        raise
    there = table.exists()
    if there:
        table.rename(old)
    try:
        new.rename(table)
    except BaseException:
        if there and not table.exists():
            old.rename(table)
        new.delete()
        raise
    # what is cached of the table is read anew; other frames must be made again, as after any overwrite
    spark.catalog.refreshByPath(table.path)
    if there:
        old.delete()


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Replace a table's rows and keep its schema; running it again gives the same table.

    Columns are cast to the types that are there.  ``df`` may read the table
    itself; if the write fails, all old rows are still there.  A partitioned
    table stays partitioned as it is, unless ``partition_by`` says otherwise.
    """
    spark = df.sparkSession
    recover_table(spark, path)
    schema = table_schema(spark, path)
    if partition_by is None:
        partition_by = Folder(spark, path).partition_columns() if schema is not None else []
    swap_in(fitted(df, schema), path, partition_by)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Replace the partitions that ``df`` has rows of; the others stay, and so does the schema.

    The rows of a partition change places when all of the write is done, so a
    failing write changes nothing.  Without a table yet, ``partition_by`` names
    the columns of a new one.
    """
    spark = df.sparkSession
    recover_table(spark, path)
    schema = table_schema(spark, path)
    if schema is None:
        if not partition_by:
            raise ValueError("a new table needs the names of its partition columns")
        swap_in(df, path, partition_by)
        return
    columns = Folder(spark, path).partition_columns()
    if not columns:
        raise ValueError("the table has no partitions to replace; replace all of it")
    if partition_by and [x.lower() for x in partition_by] != [x.lower() for x in columns]:
        raise ValueError(f"the table is partitioned by {', '.join(columns)}")
    fitted(df, schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
    spark.catalog.refreshByPath(path)
