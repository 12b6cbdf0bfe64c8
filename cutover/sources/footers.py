"""Parquet tables whose counts, minima and maxima are read from file footers."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_V1 = "spark.sql.sources.useV1SourceList"
_PUSHDOWN = "spark.sql.parquet.aggregatePushdown"


def footer_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table that answers ungrouped count, min and max of plain columns without reading them.

    Numbers, dates and booleans have such statistics; for text and times, and
    behind a filter, the columns are read as ever.  The setting it needs has no
    effect on other tables and stays on.
    """
    spark.conf.set(_PUSHDOWN, "true")
    before = spark.conf.get(_V1)
    spark.conf.set(_V1, ",".join(x for x in before.split(",") if x.strip().lower() != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(_V1, before)


def small_result(df: DataFrame, aggregate: Callable[[DataFrame], DataFrame]) -> list[Row]:
    """The few rows of an aggregate of ``df``, from footers where those can tell.

    A row group that holds nothing but nulls has no extremes in its footer,
    which Spark takes for an error; the rows are read then.
    """
    try:
        return aggregate(df).collect()
    except (Py4JJavaError, PySparkException):
        # footers don't answer behind a filter, if only one that all rows pass; an error of another kind comes again
        some = F.col(f"`{df.columns[0]}`")
        return aggregate(df.filter(some.isNull() | some.isNotNull())).collect()
