"""Summaries of comparison outcomes, conversions and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOW_MS = 1000
# Severities, worst first.
SEVERITY_ORDER = ["critical", "high", "medium", "low"]

c = F.col


def status_summary(outcomes: DataFrame) -> DataFrame:
    """Counts by status; the success rate leaves skipped cases out and is 0 when nothing ran."""
    n = outcomes.agg(
        F.count(F.lit(1)).alias("total_test_cases"), F.count_if(c("status") == "passed").alias("passed"),
        F.count_if(c("status") == "failed").alias("failed"), F.count_if(c("status") == "skipped").alias("skipped"))
    ran = c("total_test_cases") - c("skipped")
    return n.withColumn("success_rate", F.when(ran > 0, F.round(c("passed").cast("decimal(20,0)") * 100 / ran, 1)).otherwise(F.lit(0)))


def failure_breakdown(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter((c("status") == "failed") & c("failure_type").isNotNull()).groupBy("failure_type").agg(
        F.count(F.lit(1)).alias("failures"))


def failure_extract(outcomes: DataFrame) -> DataFrame:
    """One line per failed case, fit for CSV: no nulls, no line breaks in the note."""
    blank = lambda x: F.coalesce(c(x), F.lit(""))
    return outcomes.filter(c("status") == "failed").select(
        "tc_id", blank("failure_type").alias("failure_type"), blank("severity").alias("severity"), "source_rows", "target_rows",
        (c("target_rows") - c("source_rows")).alias("row_diff"), F.replace(blank("note"), F.lit("\n"), F.lit(" ")).alias("note"))


def timing_rows(outcomes: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases timed on both sides with their metadata, slowest target first."""
    timed = outcomes.filter(c("source_time_ms").isNotNull() & c("target_time_ms").isNotNull())
    meta = cases.select("tc_id", "sql_id", "namespace", "mapper")
    s, t = c("source_time_ms"), c("target_time_ms")
    return timed.join(meta, "tc_id", "left").select(
        F.coalesce("sql_id", "tc_id").alias("sql_id"), "tc_id", F.coalesce("namespace", F.lit("")).alias("namespace"),
        F.coalesce("mapper", F.lit("")).alias("mapper"), "status", s.alias("source_ms"), t.alias("target_ms"), (t - s).alias("gap_ms"),
        F.when(s > 0, F.round(t.cast("decimal(18,0)") / s.cast("decimal(18,0)"), 2)).alias("ratio"),
    ).orderBy(c("gap_ms").desc(), "tc_id")


def timing_rollup(outcomes: DataFrame, slow_ms: int = SLOW_MS) -> DataFrame:
    timed = outcomes.filter(c("source_time_ms").isNotNull() & c("target_time_ms").isNotNull())
    sums = timed.agg(
        F.count(F.lit(1)).alias("total_queries"), F.sum("source_time_ms").alias("source_total_ms"), F.sum("target_time_ms").alias("target_total_ms"),
        F.count_if(F.greatest("source_time_ms", "target_time_ms") > slow_ms).alias("slow_queries"))
    s, t, n = (c(x).cast("decimal(20,0)") for x in ("source_total_ms", "target_total_ms", "total_queries"))
    return sums.select(
        "*", F.when(n > 0, F.round(s / n, 1)).alias("source_avg_ms"), F.when(n > 0, F.round(t / n, 1)).alias("target_avg_ms"),
        F.when(s > 0, F.round((s - t) * 100 / s, 1)).alias("improvement_pct"))


def top_failures(outcomes: DataFrame, k: int = 10) -> DataFrame:
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SEVERITY_ORDER)), c("severity")), F.lit(0))
    return outcomes.filter(c("status") == "failed").withColumn(
        "severity_rank", F.when(rank > 0, rank).otherwise(len(SEVERITY_ORDER) + 1)).orderBy("severity_rank", "tc_id").limit(k).select(
        "tc_id", "failure_type", "severity", "severity_rank")


def conversion_summary(progress: DataFrame) -> DataFrame:
    return progress.groupBy("status").agg(F.count(F.lit(1)).alias("fragments"))


def load_outcome(load_log: DataFrame, fk_failures: int | DataFrame = 0) -> DataFrame:
    """Tables by load state; the load failed if a table errored, the task did, or a foreign key did."""
    state = lambda s: F.count_if(c("state") == s)
    n = load_log.agg(
        state("loaded").alias("loaded"), state("loading").alias("loading"), state("queued").alias("queued"), state("errored").alias("errored"),
        F.coalesce(F.bool_and("task_ok"), F.lit(True)).alias("task_ok"))
    if isinstance(fk_failures, DataFrame):
        fk_failures = fk_failures.filter(c("orphans") > 0).count()
    return n.withColumn("fk_failures", F.lit(fk_failures).cast("bigint")).withColumn(
        "failed", ~c("task_ok") | (c("errored") > 0) | (c("fk_failures") > 0))


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Count per group and its share of the whole in percent; the window runs over the groups, not the rows."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(W.partitionBy())
    return n.withColumn("share_pct", F.when(whole > 0, F.round(c("n").cast("decimal(20,0)") * 100 / whole, 1)).otherwise(F.lit(0)))
