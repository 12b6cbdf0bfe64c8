"""Key, reference, value and sequence checks of loaded tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.operators.load import union_all

c = F.col


def orphans(child: DataFrame, parent: DataFrame, child_cols: Sequence[str], parent_cols: Sequence[str]) -> DataFrame:
    """Foreign key values without a parent, with the number of child rows; a null part makes a key exempt.

    The child is reduced to its distinct keys before the join, so a key that
    holds a third of the rows costs one row.
    """
    names = [f"k{i}" for i in range(len(child_cols))]
    keys = child.select(*(c(x).alias(n) for x, n in zip(child_cols, names))).dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("child_rows"))
    known = parent.select(*(c(x).alias(n) for x, n in zip(parent_cols, names)))
    return keys.join(known, names, "left_anti")


def _in_order(columns: Sequence[str]) -> Column:
    """Key parts in a form that sorts alike whatever their types: numbers by size, all else by text."""
    return F.array(*(F.struct(c(x).cast("string").try_cast("double").alias("n"), F.length(c(x).cast("string")).alias("l"), c(x).cast("string").alias("t")) for x in columns))


def foreign_key_check(constraints: Mapping[str, tuple], sample: int = 5) -> DataFrame:
    """One row per constraint: orphan keys, orphan rows and the first few orphan keys.

    The orphans of all constraints are one frame, which is counted and sampled
    at once: nothing is written, and nothing reaches the driver before the
    report does.  A sample keeps the first keys of every task before they meet.
    """
    if not constraints:
        raise ValueError("no constraints given")
    found = []
    for name, (child, parent, child_cols, parent_cols) in constraints.items():
        keys = [f"k{i}" for i in range(len(child_cols))]
        numbers = all(isinstance(child.schema[x].dataType, T.NumericType) for x in child_cols)
        place = _in_order(keys) if numbers else F.transform(F.array(*(c(k).cast("string") for k in keys)), lambda t: F.struct(
            F.lit(None).cast("double").alias("n"), F.lit(0).alias("l"), t.alias("t")))
        found.append(orphans(child, parent, child_cols, parent_cols).select(
            F.lit(name).alias("constraint_name"), place.alias("_place"), F.concat_ws("/", *(c(k).cast("string") for k in keys)).alias("_text"), "child_rows"))
    all_ = union_all(found)
    counts = all_.groupBy("constraint_name").agg(F.count(F.lit(1)).alias("orphan_keys"), F.sum("child_rows").alias("orphans"))
    # a constant would be no group to prune by, if there is just one constraint
    all_ = all_.withColumn("constraint_name", F.concat("constraint_name", F.left("_text", F.lit(0))))
    first = all_.withColumn("_rn", F.row_number().over(W.partitionBy("constraint_name").orderBy("_place"))).filter(c("_rn") <= sample)
    listed = first.groupBy("constraint_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_text"))), lambda x: x["_text"]), ";").alias("sample"))
    names = all_.sparkSession.createDataFrame([(i, n) for i, n in enumerate(constraints)], "_i int, constraint_name string")
    report = names.join(counts, "constraint_name", "left").join(listed, "constraint_name", "left").orderBy("_i")
    return report.select(
        F.coalesce("orphan_keys", F.lit(0)).alias("orphan_keys"), F.coalesce("orphans", F.lit(0)).alias("orphans"), "constraint_name",
        F.coalesce("sample", F.lit("")).alias("sample"), c("orphans").isNull().alias("holds"))


def key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated keys, the rows they hold, and rows with a null key part."""
    null = c(keys[0]).isNull()
    for k in keys[1:]:
        null = null | c(k).isNull()
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    more = (c("n") > 1) & ~null
    found = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(more).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(more, c("n"))), F.lit(0)).alias("rows_in_repeated_keys"), F.coalesce(F.sum(F.when(null, c("n"))), F.lit(0)).alias("null_keys"))
    return found.withColumn("holds", (c("repeated_keys") == 0) & (c("null_keys") == 0))


def value_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows that break each check; a check that evaluates to null passes."""
    one = df.agg(*(F.count_if(~F.coalesce(cond, F.lit(True))).alias(name) for name, cond in checks.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("check_name"), c(n).alias("violations")) for n in checks))
    return one.select(F.inline(rows)).withColumn("holds", c("violations") == 0)


def sequence_sync(source: DataFrame, target: DataFrame) -> DataFrame:
    """Value each target sequence must be set to; a value outside the target's bounds goes to its minimum."""
    bounds = target.select(F.lower("sequence_name").alias("_n"), "min_value", "max_value", F.lit(True).alias("_there"))
    s = source.withColumn("_n", F.lower("sequence_name")).join(bounds, "_n", "left")
    last = c("last_number")
    # a bound that is null bounds nothing
    out_of_bounds = F.coalesce(last > c("max_value"), F.lit(False)) | F.coalesce(last < c("min_value"), F.lit(False))
    missing = c("_there").isNull()
    return s.select(
        "sequence_name", F.when(~missing & out_of_bounds, c("min_value")).otherwise(last).alias("last_number"),
        F.when(missing, "MISSING_IN_TARGET").when(out_of_bounds, "SYNCED_CLAMPED").otherwise("SYNCED").alias("status"))


def sequence_totals(synced: DataFrame) -> DataFrame:
    return synced.agg(
        F.count(F.lit(1)).alias("source_count"), F.count_if(c("status").startswith("SYNCED")).alias("synced"),
        F.count_if(c("status") == "SYNCED_CLAMPED").alias("clamped"), F.count_if(c("status") == "MISSING_IN_TARGET").alias("missing_in_target"))
