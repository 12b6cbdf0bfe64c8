"""Column dictionary: metadata, samples, cast hints, lookups and coverage."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.functions.equality import cell_text
from cutover.operators.load import PARALLEL_TABLES, union_all
from cutover.operators.names import mentions
from cutover.operators.ordered import ranked
from cutover.session import stage
from cutover.sources.footers import small_result

c = F.col

# Cast syntax by data type.
NUMERIC_CASTS = {
    "smallint": "::SMALLINT", "integer": "::INTEGER", "bigint": "::BIGINT", "numeric": "::NUMERIC", "decimal": "::NUMERIC",
    "real": "::REAL", "double precision": "::DOUBLE PRECISION",
}
DATETIME_CASTS = {
    "date": "::DATE", "timestamp without time zone": "::TIMESTAMP", "timestamp with time zone": "::TIMESTAMPTZ",
    "time without time zone": "::TIME", "time with time zone": "::TIMETZ",
}
FIXED_CHAR_TYPES = ["character", "char", "bpchar"]
NO_CAST_TYPES = ["character varying", "varchar", "text", "json", "jsonb", "uuid"]
# Notes and reasons of the reports.
NUMERIC_NOTE = "리터럴은 숫자로, 바인드 변수는 명시적 캐스팅 권장"
DATETIME_NOTE = "날짜/시간 리터럴에 명시적 캐스팅 권장"
CHAR_NOTE = "CHAR 고정 길이: PostgreSQL은 패딩 비교가 엄격 (자바에서 패딩 전달 또는 TRIM 고려)"
REASON_UNKNOWN = "딕셔너리에 없는 컬럼 (캐스팅 생략, 수동 검토 권장)"
REASON_CHAR = "CHAR 고정 길이: 캐스팅 불필요"
REASON_TEXT = "문자열 타입, 캐스팅 불필요"
# Severity of each reason a reference could not be resolved.
REASON_SEVERITY = {
    "column_not_in_dictionary": "high", "table_inference_failed": "critical", "column_inference_failed": "critical",
    "ambiguous_mapping": "medium", "view_column": "medium", "dynamic_table": "critical", "subquery_result": "low", "computed_column": "low",
}
#: A statement whose table is put in at run time.
DYNAMIC_TABLE = r"(?i)\b(from|join|into|update|table)\s+\$\{"


def target_type(t: T.DataType) -> str:
    """The target database's name of a Spark type."""
    names = {
        T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint", T.DecimalType: "numeric",
        T.FloatType: "real", T.DoubleType: "double precision", T.DateType: "date", T.TimestampNTZType: "timestamp without time zone",
        T.TimestampType: "timestamp with time zone", T.StringType: "text", T.VarcharType: "character varying", T.CharType: "character",
        T.BinaryType: "bytea", T.BooleanType: "boolean",
    }
    return names.get(type(t), t.simpleString())


METADATA = ("table_name string, column_name string, position long, data_type string, is_nullable boolean, "
            "char_max_length long, numeric_precision long, numeric_scale long")


def column_metadata(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column, by table and position; reads schemas only."""
    rows = []
    for table in sorted(tables):
        for i, f in enumerate(tables[table].schema.fields, 1):
            t = f.dataType
            rows.append((table, f.name, i, target_type(t), f.nullable, t.length if isinstance(t, (T.CharType, T.VarcharType)) else None,
                         t.precision if isinstance(t, T.DecimalType) else None, t.scale if isinstance(t, T.DecimalType) else None))
    return spark.createDataFrame(rows, METADATA)


def table_list(metadata: DataFrame) -> DataFrame:
    """Distinct tables in order of their first column."""
    return metadata.groupBy("table_name").agg(F.count(F.lit(1)).alias("columns")).orderBy("table_name")


def sample_row(table: str, df: DataFrame, key: str | None = None) -> DataFrame | None:
    """The lowest row by key, then by all columns, as (table, column, value); None when the table cannot be read.

    The lowest key is found from the key column alone, or from file footers if
    ``df`` is a ``footer_table`` and the key a number or date; the filter on it
    then lets the scan skip everything but the row groups that may hold the
    row.  Without a named key it is the first column that can be ordered.
    """
    try:
        key = key or next((f.name for f in df.schema.fields if _orderable(f.dataType)), None)
        one = df if key is None else df.filter(c(key) == F.lit(small_result(df, lambda d: d.agg(F.min(key)))[0][0]))
    except Exception as e:  # noqa: BLE001 - a table that can't be read has no sample, and the other tables go on
        logging.getLogger(__name__).warning("no sample of %s: %s", table, str(e).splitlines()[0] if str(e) else type(e).__name__)
        return None
    ordered = F.struct(*((c(f.name) if _orderable(f.dataType) else cell_text(c(f.name), f.dataType)).alias(f"_{i}") for i, f in enumerate(df.schema.fields)))
    lowest = one.agg(F.min(ordered).alias("_row")).filter("_row IS NOT NULL")
    cell = lambda i, f: c(f"_row._{i}") if not _orderable(f.dataType) else cell_text(c(f"_row._{i}"), f.dataType)
    rows = F.array(*(
        F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"), cell(i, f).alias("sample_value"))
        for i, f in enumerate(df.schema.fields)))
    return lowest.select(F.inline(rows))


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _orderable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def cast_hints(spark: SparkSession) -> DataFrame:
    """The dimension of cast hints, one row per data type."""
    rows = [(t, True, s, False, NUMERIC_NOTE) for t, s in NUMERIC_CASTS.items()]
    rows += [(t, True, s, False, DATETIME_NOTE) for t, s in DATETIME_CASTS.items()]
    rows += [(t, False, None, True, CHAR_NOTE) for t in FIXED_CHAR_TYPES]
    return spark.createDataFrame(rows, "data_type string, needs_cast boolean, cast_syntax string, needs_trim boolean, hint_note string")


def with_hints(df: DataFrame) -> DataFrame:
    """Join hints on data_type; types without one need neither cast nor trim."""
    hints = F.broadcast(cast_hints(df.sparkSession))  # fifteen rows
    return df.join(hints, "data_type", "left").withColumns({
        "needs_cast": F.coalesce("needs_cast", F.lit(False)), "needs_trim": F.coalesce("needs_trim", F.lit(False))})


def build_dictionary(spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, str] | None = None) -> DataFrame:
    """Metadata with sample and hint, keyed by lower-case ``table.column``; tables are sampled side by side.

    ``sample_found`` is false for the columns of tables that are empty or can't be read.
    """
    meta = column_metadata(spark, tables)
    with ThreadPoolExecutor(PARALLEL_TABLES) as pool:
        found = list(pool.map(lambda item: sample_row(*item, (keys or {}).get(item[0])), tables.items()))
    samples = [s.withColumn("sample_found", F.lit(True)) for s in found if s is not None]
    nothing = meta.withColumns({"sample_value": F.lit(None).cast("string"), "sample_found": F.lit(None).cast("boolean")})
    joined = meta.join(union_all(samples), ["table_name", "column_name"], "left") if samples else nothing
    return with_hints(joined).withColumn("sample_found", F.coalesce("sample_found", F.lit(False))).withColumn("key", F.lower(F.concat_ws(".", "table_name", "column_name")))


def lookup(refs: DataFrame, dictionary: DataFrame, column: str = "ref") -> DataFrame:
    """Dictionary entry of each reference, whatever its case, with a found flag."""
    entries = dictionary.select(
        "key", "data_type", "needs_cast", "cast_syntax", "needs_trim", "sample_value", "char_max_length", F.lit(True).alias("_found"))
    return refs.withColumn("key", F.lower(column)).join(entries, "key", "left").withColumn(
        "found", F.coalesce("_found", F.lit(False))).drop("_found", "key")


def cast_decisions(refs: DataFrame, dictionary: DataFrame, column: str = "ref") -> DataFrame:
    """What to cast each referenced column to, why, and what to warn of."""
    df = lookup(refs, dictionary, column)
    t = F.lower("data_type")
    fixed = t.isin(FIXED_CHAR_TYPES) | c("needs_trim")
    text = t.isin(NO_CAST_TYPES)
    cast = c("needs_cast") & c("cast_syntax").isNotNull()
    return df.withColumns({
        "cast_applied": F.when(c("found") & ~fixed & ~text & cast, c("cast_syntax")),
        "reason": F.when(~c("found"), REASON_UNKNOWN).when(fixed, REASON_CHAR).when(text, REASON_TEXT)
        .when(cast, F.concat(t, F.lit(" 타입, 명시적 캐스팅 필요"))).otherwise(F.concat(t, F.lit(": 캐스팅 규칙 없음 (생략)"))),
        "warning": F.when(~c("found"), F.concat(F.lit("컬럼을 딕셔너리에서 찾을 수 없음: "), c(column)))
        .when(fixed, F.concat(F.lit("CHAR 타입("), c(column), F.lit("): PostgreSQL은 패딩 비교가 엄격 (자바에서 패딩 전달 또는 TRIM 고려)"))),
    })


def cast_plan(binds: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Decisions for every bind of a fragment: fragment_id, variable, ref -> cast, reason, warning."""
    return cast_decisions(binds, dictionary).select("fragment_id", "variable", "ref", "data_type", "cast_applied", "reason", "warning")


def plan_warnings(plan: DataFrame) -> DataFrame:
    """Casts and warnings per fragment, counted; each distinct warning stays a row of its own."""
    return plan.filter(c("warning").isNotNull()).groupBy("fragment_id", "warning").agg(F.count(F.lit(1)).alias("binds"))


def dictionary_subset(fragments: DataFrame, dictionary: DataFrame, id_column: str, text_column: str, cap: int | None = None) -> DataFrame:
    """Dictionary entries a fragment's text may refer to.

    Entries whose table and column are both named in the text; when no table
    is, entries whose column is.  All of them, unless ``cap`` asks for so many
    at most, in dictionary order, with a flag where entries were left out.
    Fragments with equal ids count as one.
    """
    entries = dictionary.filter(F.coalesce("column_name", F.lit("")) != "").select(
        "position", F.coalesce("table_name", F.lit("")).alias("table_name"), F.upper("table_name").alias("_table"), F.upper("column_name").alias("name"),
        F.lower(F.concat_ws(".", "table_name", "column_name")).alias("key"))
    # one index for both: a table and a column may have the same name
    names = entries.select(c("_table").alias("n")).unionAll(entries.select("name"))
    hits = stage(mentions(fragments, names, [id_column], text_column, "n"), "named")
    tables = hits.join(entries.select("_table").distinct(), hits["name"] == c("_table"), "left_semi").withColumnRenamed("name", "_table")
    columns = hits.join(entries, "name").select(id_column, "table_name", "position", "_table", "key")
    rows = columns.join(tables, [id_column, "_table"], "left_semi").unionByName(columns.join(tables.select(id_column).distinct(), id_column, "left_anti"))
    if cap is None:
        return rows.select(id_column, "key", F.lit(False).alias("truncated"))
    # a text has at most the dictionary's entries
    numbered = ranked(rows, [id_column], ["table_name", "position"], ["key"], {"_i": ("row_number",), "_n": ("count",)}, split=False)
    return numbered.filter(c("_i") <= cap).select(id_column, "key", (c("_n") > cap).alias("truncated"))


def _severity(reason: Column) -> Column:
    severity = F
    for name, level in REASON_SEVERITY.items():
        severity = severity.when(reason == name, level)
    return severity


def coverage(refs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each reference with found flag, reason and severity; ``hint`` names a reason known beforehand."""
    df = lookup(refs, dictionary)
    reason = F.when(~c("found"), F.coalesce("hint", F.lit("column_not_in_dictionary")))
    return df.withColumn("failure_reason", reason).withColumn("severity", _severity(c("failure_reason")))


def resolved(binds: DataFrame, fragments: DataFrame, dictionary: DataFrame, views: DataFrame | None = None,
             id_column: str = "fragment_id", text_column: str = "text", ref_column: str = "ref") -> DataFrame:
    """What each reference of a fragment means, or why that cannot be told.

    A reference ``table.column`` is looked up.  A bare column belongs to the
    table that the fragment names and that has it; if the fragment names no
    table of the dictionary, to the only table that has it.  Adds ``key`` (what
    it was resolved to), ``found``, ``failure_reason`` and ``severity``.  Reasons:

    * no column in the reference: ``column_inference_failed``
    * a table that is put in at run time, in the reference or, where no other
      table has the column, in the fragment: ``dynamic_table``
    * several tables have the column: ``ambiguous_mapping``
    * no table named, and none has the column: ``table_inference_failed``
    * a column of one of ``views`` (a frame with ``view_name``): ``view_column``
    * all else: ``column_not_in_dictionary``
    """
    entries = dictionary.select(F.lower("table_name").alias("_table"), F.lower("column_name").alias("_column")).filter("_table <> '' AND _column <> ''").distinct()
    key = F.concat_ws(".", "_table", "_column")
    ref = F.lower(F.btrim(F.coalesce(c(ref_column), F.lit(""))))
    parts = F.split(ref, r"\.")
    marked = binds.withColumns({
        "_column": F.element_at(parts, -1), "_table": F.when(F.size(parts) > 1, F.element_at(parts, -2)), "_dynamic": F.instr(ref, "${") > 0})

    # the tables each fragment names, and those of them that have each column it refers to
    named = mentions(fragments, entries.select(c("_table").alias("n")), [id_column], text_column, "n").select(id_column, F.lower("name").alias("_table"))
    named = stage(named.join(entries.select("_table").distinct(), "_table", "left_semi"), "named-tables")
    bare = marked.filter(c("_table").isNull()).select(id_column, "_column").distinct()
    here = bare.join(named, id_column).join(entries, ["_table", "_column"]).groupBy(id_column, "_column").agg(
        F.count(F.lit(1)).alias("_n_here"), F.min(key).alias("_key_here"))
    anywhere = entries.groupBy("_column").agg(F.count(F.lit(1)).alias("_n_any"), F.min(key).alias("_key_any"))
    at_run_time = fragments.groupBy(id_column).agg(F.coalesce(F.bool_or(F.rlike(text_column, F.lit(DYNAMIC_TABLE))), F.lit(False)).alias("_fragment_dynamic"))
    many = named.groupBy(id_column).agg(F.count(F.lit(1)).alias("_n_named"))
    known_views = (views.select(F.lower("view_name").alias("_table")).distinct() if views is not None else entries.select("_table").limit(0)).withColumn("_view", F.lit(True))
    df = (marked.join(entries.withColumn("_key_full", key), ["_table", "_column"], "left").join(here, [id_column, "_column"], "left")
          .join(anywhere, "_column", "left").join(at_run_time, id_column, "left").join(many, id_column, "left").join(known_views, "_table", "left"))
    full, unnamed = c("_table").isNotNull(), F.coalesce("_n_named", F.lit(0)) == 0
    meant = F.when(full, c("_key_full")).when(c("_n_here") == 1, c("_key_here")).when(unnamed & (c("_n_any") == 1), c("_key_any"))
    reason = (
        F.when((c("_column") == "") | (c("_dynamic") & ~full), "column_inference_failed")
        .when(c("_dynamic"), "dynamic_table")
        .when(meant.isNotNull(), None)
        .when(full, F.when(c("_view"), "view_column").otherwise("column_not_in_dictionary"))
        .when(c("_n_here") > 1, "ambiguous_mapping")
        .when(c("_fragment_dynamic"), "dynamic_table")
        .when(unnamed & (c("_n_any") > 1), "ambiguous_mapping")
        .when(unnamed, "table_inference_failed")
        .otherwise("column_not_in_dictionary"))
    done = df.withColumn("failure_reason", reason).withColumns({"found": c("failure_reason").isNull(), "key": F.when(c("failure_reason").isNull(), meant)})
    return done.select(*binds.columns, "key", "found", "failure_reason", _severity(c("failure_reason")).alias("severity"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    n = covered.agg(F.count(F.lit(1)).alias("total"), F.count_if("found").alias("successful"), F.count_if(~c("found")).alias("failed"))
    return n.withColumn("success_rate", F.when(c("total") > 0, F.round(c("successful").cast("decimal(20,0)") * 100 / c("total"), 1)).otherwise(F.lit(0)))


def coverage_by(covered: DataFrame, by: str) -> DataFrame:
    return covered.filter(~c("found")).groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()])


def object_counts(objects: DataFrame, types: list[str]) -> DataFrame:
    """Objects per type, for the listed types; a type without objects counts 0."""
    listed = objects.sparkSession.createDataFrame([(t,) for t in types], "object_type string")
    counts = objects.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, "object_type", "left").select("object_type", F.coalesce("n", F.lit(0)).alias("n"))
