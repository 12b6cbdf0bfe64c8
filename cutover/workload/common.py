"""Helpers shared by the application's statements."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutover.operators.ordered import Order, global_index


def only(df: DataFrame, key: str, ids: Sequence[int] | None) -> DataFrame:
    """The rows a bound key list names; every row when no list is bound."""
    return df if ids is None else df.filter(F.col(key).isin(list(ids)))


def stamp(as_of: datetime) -> Column:
    """A time without zone; going through text keeps the session's zone out of it."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def flagged(df: DataFrame, keys: DataFrame | None, key: str, flag: str = "_hit") -> DataFrame:
    """Mark the rows whose key is in ``keys``; all rows when ``keys`` is None."""
    if keys is None:
        return df.withColumn(flag, F.lit(True))
    marked = keys.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(marked, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def replace_columns(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """The table's next snapshot: named columns replaced where ``when`` holds."""
    when = F.coalesce(when, F.lit(False))
    # the new values are all computed from the old row
    return df.withColumns({
        c: F.when(when, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()
    })


def latest_per_key(binds: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Reduce a log of bound updates to the last one per key, as running them in order would.

    Several last updates, with equal ``seq``, have no order: they fail the
    statement unless they are equal in all columns.
    """
    rest = [c for c in binds.columns if c not in keys]
    newest = F.rank().over(W.partitionBy(*keys).orderBy(F.col(seq).desc_nulls_last()))
    last = binds.withColumn("_rank", newest).filter("_rank = 1").select(*keys, F.struct(*rest).alias("_row"))
    met = last.groupBy(*keys).agg(F.min("_row").alias("_one"), F.max("_row").alias("_other"))
    key = F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    sure = F.when(F.col("_one").eqNullSafe(F.col("_other")), F.col("_one")).otherwise(F.raise_error(F.concat(F.lit("several last changes of "), key)))
    return met.withColumn("_row", sure).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def one_per_key(changes: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """At most one change per key, so that a join with them can't multiply rows of the table.

    With ``seq``, the last change of a key wins, as running them in order
    would.  Without it a key that repeats has no defined result and fails the
    statement, unless its rows are equal in all columns.
    """
    if seq is not None:
        return latest_per_key(changes, [key], seq)
    rest = [x for x in changes.columns if x != key]
    met = changes.groupBy(key).agg(F.min(F.struct(*rest)).alias("_one"), F.max(F.struct(*rest)).alias("_other"))
    sure = F.when(F.col("_one") == F.col("_other"), F.col("_one")).otherwise(
        F.raise_error(F.concat(F.lit(f"{key} has several changes: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return met.select(key, sure.alias("_one")).select(key, "_one.*")


def assign_keys(new_rows: DataFrame, order: Order, key: str, table: DataFrame) -> DataFrame:
    """Give new rows keys that follow the table's highest one, without a one-task window."""
    highest = table.agg(F.max(key)).first()[0] or 0
    return global_index(new_rows, order, "_i").withColumn(key, F.col("_i") + F.lit(highest + 1)).drop("_i")


def append_aligned(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows, casting to the table's types; columns the rows lack become null."""
    aligned = rows.select(*(
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in table.schema.fields
    ))
    return table.unionByName(aligned)
