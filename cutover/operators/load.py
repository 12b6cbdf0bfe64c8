"""Bulk load: table selection, renaming, value rules, writing, and surrogate keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.sources.footers import small_result
from cutover.sources.replace import swap_in

PARALLEL_TABLES = 8
COMMIT_ROWS = 10_000
LOB_KB = 1024
BIGINT_MAX = 9223372036854775807
WIDE = "decimal(38,0)"

c = F.col


def select_tables(spark: SparkSession, names: Sequence[str], include: str = "%", exclude: Sequence[str] = ()) -> list[str]:
    """Table names that match a LIKE pattern, whatever their case; names only, never rows."""
    df = spark.createDataFrame([(n,) for n in names], "name string").filter(F.lower("name").like(include.lower()))
    for pattern in exclude:
        df = df.filter(~F.lower("name").like(pattern.lower()))
    return [r.name for r in df.orderBy("name").collect()]


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(x.lower() for x in df.columns))


def _within(column: str, limit: int) -> Column:
    """The longest run of whole characters from the start that takes at most ``limit`` bytes.

    The byte cut may fall into a character; the up to three bytes of such a part go too.
    """
    octets = c(column).cast("binary")
    head = F.substring(octets, 1, limit)
    whole = F.coalesce(*(F.when(F.is_valid_utf8(F.substring(octets, 1, limit - k).cast("string")), F.substring(octets, 1, limit - k).cast("string")) for k in range(4)))
    return F.when(F.octet_length(column) <= limit, c(column)).otherwise(F.coalesce(whole, head.cast("string")))


def cut_long_text(df: DataFrame, column: str, max_kb: int = LOB_KB) -> DataFrame:
    """Cut text that takes more bytes than the limit, between characters, and flag the rows it was cut in."""
    limit = max_kb * 1024
    return df.withColumn(f"{column}_cut", F.coalesce(F.octet_length(column) > limit, F.lit(False))).withColumn(column, _within(column, limit))


def cut_report(df: DataFrame, column: str, max_kb: int = LOB_KB) -> DataFrame:
    limit = max_kb * 1024
    return df.agg(
        F.count(column).alias("values"), F.count_if(F.octet_length(column) > limit).alias("cut"),
        F.coalesce(F.sum(F.length(column) - F.length(_within(column, limit))), F.lit(0)).alias("chars_lost"),
        F.coalesce(F.max(F.octet_length(column)), F.lit(0)).alias("longest_octets"))


def unpivot_aggregates(df: DataFrame, table: str, columns: Sequence[str], measures: Mapping[str, callable], kind: str | None = None) -> DataFrame:
    """Aggregate many columns in one pass and turn the one result row into a row per column; ``kind`` is the measures' common type."""
    one = df.agg(*(measure(x).alias(f"{m}__{i}") for i, x in enumerate(columns) for m, measure in measures.items()))
    rows = F.array(*(
        F.struct(F.lit(table).alias("table_name"), F.lit(x).alias("column_name"), *((c(f"{m}__{i}").cast(kind) if kind else c(f"{m}__{i}")).alias(m) for m in measures))
        for i, x in enumerate(columns)))
    return one.select(F.inline(rows))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def scale_zero_check(table: str, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Whether each number column can be unloaded without decimals: counts the values that would lose some."""
    names = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType))]
    report = unpivot_aggregates(df, table, names, {
        "rows": lambda x: F.count(x), "fractional": lambda x: F.count_if(c(x) != F.floor(x))})
    return report.withColumn("safe", c("fractional") == 0)


def to_whole_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({x: c(x).cast(WIDE) for x in columns})


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType))]


def overflow_check(tables: Mapping[str, DataFrame], bound: int = BIGINT_MAX, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Largest absolute value of every integer column against a bound; empty columns are left out.

    Only the least and the greatest value of a column are asked for, which
    tables of ``footer_table`` answer without reading rows; tables are asked
    side by side.  Those two are widened first: the absolute value of the
    smallest long has no long.
    """
    asked = []
    for name, df in tables.items():
        wanted = (columns or {}).get(name) or integer_columns(df)
        present = {x.lower(): x for x in df.columns}
        wanted = [present[x.lower()] for x in wanted if x.lower() in present]
        if wanted:
            asked.append((name, df, wanted))
    if not asked:
        raise ValueError("no integer columns to check")
    spark = asked[0][1].sparkSession

    def extremes(item):
        name, df, wanted = item
        return small_result(df, lambda d: unpivot_aggregates(d, name, wanted, {"least": F.min, "greatest": F.max}, WIDE))

    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        rows = [r for found in pool.map(extremes, asked) for r in found if r.least is not None]
    found = spark.createDataFrame(rows, f"table_name string, column_name string, least {WIDE}, greatest {WIDE}")
    return found.select("table_name", "column_name", F.greatest(F.abs("least"), F.abs("greatest")).alias("max_abs")).withColumn("overflows", c("max_abs") > F.lit(bound).cast(WIDE))


def widen_overflowing(df: DataFrame, check: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """The table with its overflowing columns widened, and the report row.

    The check holds one row per column, so reading it on the driver is bounded by the schema.
    """
    rows = check.filter(c("table_name") == table).collect()
    wide = [r.column_name for r in rows if r.overflows]
    report = df.sparkSession.createDataFrame(
        [(table, len(rows), len(wide), 0, ",".join(sorted(wide)))], "table_name string, checked long, widened long, failed long, columns string")
    return df.withColumns({x: c(x).cast(WIDE) for x in wide}), report


def full_load(tables: Mapping[str, DataFrame], root: str, parallel: int = PARALLEL_TABLES, transform=lower_names) -> DataFrame:
    """Load tables side by side, replacing what is there; one log row per table.

    Rows are counted while they are written, beside the table that is there; a
    failing table keeps its old rows, is logged with ``task_ok`` false, and does
    not stop the others.
    """
    if not tables:
        raise ValueError("no tables to load")
    spark = next(iter(tables.values())).sparkSession

    def load(item):
        name, df = item
        seen = Observation(f"load {name}")
        try:
            out = transform(df).observe(seen, F.count(F.lit(1)).alias("rows"))
            swap_in(out, f"{root}/{name.lower()}")
            return name, "loaded", seen.get["rows"], None, True
        except Exception as e:  # noqa: BLE001 - every failure becomes a log row
            return name, "errored", None, str(e), False

    with ThreadPoolExecutor(parallel) as pool:
        log = list(pool.map(load, tables.items()))
    return spark.createDataFrame(log, "table_name string, state string, rows long, error string, task_ok boolean")


def with_defaults(df: DataFrame, defaults: Mapping[str, Column], computed: Mapping[str, Column] | None = None) -> DataFrame:
    """Fill missing values with column defaults, then add computed columns."""
    filled = df.withColumns({x: F.coalesce(c(x), d.cast(df.schema[x].dataType)) for x, d in defaults.items()})
    return filled.withColumns(dict(computed or {}))
