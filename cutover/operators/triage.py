"""Classification of failure text and the repair worklist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutover.functions.once import once
from cutover.operators.ordered import ranked, top_per_group
from cutover.session import stage

# Failure groups in the order that numbers them, with nature and action.
GROUPS = [
    ("A_미변환_Oracle함수", "변환결함", "repair"),
    ("B_변환결함_의심", "변환결함 의심", "repair"),
    ("C_테스트데이터_OGNL파라미터", "테스트데이터", "tc_fix"),
    ("D_테스트데이터_값범위", "테스트데이터", "tc_fix"),
    ("E_비실행조각_TC오생성", "TC생성 이슈", "tc_filter"),
    ("F_오탐_원본도동일실패", "오탐", "none"),
]
UNCONVERTED, SUSPECT, PARAMETER, RANGE, MISGENERATED, FALSE_ALARM = (g for g, _, _ in GROUPS)
EXECUTABLE_TYPES = ["select", "insert", "update", "delete"]
SIGNATURE_CHARS, ERROR_CHARS, SHOWN_ERROR_CHARS = 120, 300, 200
TOP_MAPPERS = 8
MAX_RETRIES = 3
BLANKS = " \t\n\r\f\x0b"

c = F.col


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def source_side(note: Column) -> Column:
    tail = F.split(F.split(note, "source:", 2)[1], "target:", 2)[0]
    return F.when(note.contains("source:"), F.rtrim(F.rtrim(strip(tail), F.lit("|")), F.lit(BLANKS))).otherwise(F.lit(""))


def target_side(note: Column) -> Column:
    return F.when(note.contains("target:"), strip(F.split(note, "target:", 2)[1])).otherwise(F.lit(""))


def error_signature(error: Column) -> Column:
    """The gist of an error: hint, position and quoted values removed."""
    s = F.split(error, "Hint:", 2)[0]
    for pattern, kept in ((r"Position: \d+", ""), (r"=\([^)]*\)", ""), (r'"[^"]*"', '""')):
        s = F.regexp_replace(s, pattern, kept)
    return F.substring(strip(s), 1, SIGNATURE_CHARS)


def _verdict(group: str, category: str | Column) -> Column:
    return F.struct(F.lit(group).alias("group"), (F.lit(category) if isinstance(category, str) else category).alias("category"))


def _target_verdict(text: Column) -> Column:
    missing = text.contains("does not exist")
    name = F.regexp_extract(text, r"function (\w+)\(", 1)
    return (
        F.when(missing & text.contains("function"), _verdict(UNCONVERTED, F.concat(
            F.lit("target_fn_missing:"), F.when(name == "", "unknown").otherwise(name))))
        .when(missing & text.contains("column"), _verdict(SUSPECT, "target_column_missing"))
        .when(text.contains("operator does not exist"), _verdict(SUSPECT, "target_operator_type"))
        .when(text.contains("invalid reference to FROM"), _verdict(SUSPECT, "target_from_alias"))
        .when(text.contains("out of range"), _verdict(RANGE, "target_data_out_of_range"))
        .when(text.contains("too long"), _verdict(RANGE, "target_value_too_long"))
        .otherwise(_verdict(SUSPECT, "target_other"))
    )


def classified(failures: DataFrame) -> DataFrame:
    """Add group and category; expects note and failure_type.  The first rule that fits wins.

    Each step is unpacked from a one-element array, so its expressions run once
    per row: a later filter on the result cannot be pushed down as a copy of them.
    """
    note, s, t = c("_note"), c("_src"), c("_tgt")
    other = c("failure_type").isNotNull() & (c("failure_type") != "") & (c("failure_type") != "execution_error")
    noted = once(failures, {"_note": F.coalesce("note", F.lit(""))})
    sided = once(noted, {"_src": source_side(note), "_tgt": target_side(note)})
    prepared = once(sided, {"_same": F.when((s != "") & (t != ""), error_signature(s) == error_signature(t))})
    verdict = (
        F.when(other, _verdict(SUSPECT, c("failure_type")))
        .when(note.contains("Mapped Statements collection does not contain"), _verdict(MISGENERATED, "mybatis_stmt_not_found"))
        .when(note.contains("evaluated to a null value") | note.contains("is null for method"), _verdict(PARAMETER, "ognl_null_param"))
        .when(note.contains("no getter for property"), _verdict(PARAMETER, "ognl_getter_missing"))
        .when(c("_same"), _verdict(FALSE_ALARM, "both_error_identical"))
        .when(~c("_same"), _verdict(SUSPECT, "both_error_differ"))
        .when(s != "", _verdict(FALSE_ALARM, "source_only_error"))
        .when(t != "", _target_verdict(t))
        .otherwise(_verdict(SUSPECT, "unknown"))
    )
    return prepared.select(*failures.columns, F.inline(F.array(verdict)))


def group_number(group: Column) -> Column:
    """1..6 whatever the counts; 7 for a group not known here."""
    at = F.array_position(F.array(*(F.lit(g) for g, _, _ in GROUPS)), group)
    return F.when(at > 0, at).otherwise(len(GROUPS) + 1).cast("bigint")


def _label(group: Column, index: int) -> Column:
    out = F
    for row in GROUPS:
        out = out.when(group == row[0], row[index])
    return out


def plan_summary(outcomes: DataFrame) -> DataFrame:
    n = outcomes.agg(F.count(F.lit(1)).alias("total"), F.count_if(c("status") == "failed").alias("failed"))
    return n.select("total", (c("total") - c("failed")).alias("passed"), "failed")


def category_histogram(members: DataFrame) -> DataFrame:
    """Counts per group and category, ranked within the group; the category seen first wins a tie.

    ``members`` carries group, category, error and ``seq``, the order of arrival.
    """
    counts = members.groupBy("group", "category").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"),
        F.min_by("error", F.when(F.coalesce(c("error"), F.lit("")) != "", c("seq"))).alias("first_error"))
    # written out, so that the failures are classified once; a group has at most the categories of the rules
    return ranked(stage(counts, "histogram"), ["group"], [("n", "desc")], ["first_seq"], {"rank": ("row_number",)}, split=False)


def plan_types(members: DataFrame) -> DataFrame:
    """One row per failure group: size, categories, the modal category and its first error text."""
    hist = category_histogram(members)
    groups = hist.groupBy("group").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("categories"),
        F.min_by("category", "rank").alias("representative_category"), F.min_by("first_error", "rank").alias("_error"))
    return groups.select(
        group_number(c("group")).alias("no"), "group", _label(c("group"), 1).alias("nature"), _label(c("group"), 2).alias("action"),
        "count", "categories", "representative_category",
        F.substring(F.coalesce("_error", F.lit("")), 1, SHOWN_ERROR_CHARS).alias("representative_error")).orderBy("no")


def with_case_fields(details: DataFrame, cases: DataFrame) -> DataFrame:
    """mapper and sql_id from the row if it has both, else from the case table, never from the id's text."""
    meta = cases.select("tc_id", c("mapper").alias("_m"), c("sql_id").alias("_q"), F.lit(True).alias("_case"))
    have = F.coalesce((c("mapper") != "") & (c("sql_id") != ""), F.lit(False))
    use = ~have & c("_case").isNotNull()
    return details.join(meta, "tc_id", "left").withColumns({
        "mapper": F.when(use, c("_m")).otherwise(c("mapper")), "sql_id": F.when(use, c("_q")).otherwise(c("sql_id"))}).drop("_m", "_q", "_case")


def statement_types(catalogue: DataFrame) -> DataFrame:
    """One statement type per (mapper, sql_id): the first executable one, else the first; ``seq`` orders them."""
    return catalogue.groupBy("mapper", "sql_id").agg(
        F.min_by("statement_type", F.struct(~c("statement_type").isin(EXECUTABLE_TYPES), "seq")).alias("statement_type"))


def with_fragment(cases: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Add statement_type and frag_id, which is null when a part is missing."""
    joined = cases.join(statement_types(catalogue), ["mapper", "sql_id"], "left")
    parts = [c(x) for x in ("mapper", "statement_type", "sql_id")]
    complete = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return joined.withColumn("frag_id", F.when(complete, F.concat_ws("__", *parts)))


def members_of(failures: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Failure rows with group, category, fragment and error text."""
    return with_fragment(classified(failures), catalogue).withColumn("error", F.coalesce("note", F.lit("")))


def top_mappers(members: DataFrame, k: int = TOP_MAPPERS) -> DataFrame:
    counts = members.groupBy("group", F.coalesce("mapper", F.lit("?")).alias("mapper")).agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return top_per_group(counts, ["group"], [("n", "desc"), "first_seq"], k).drop("first_seq")


def worklist(members: DataFrame, limit: int | None = None, group: str | None = None) -> DataFrame:
    """One row per fragment to repair: its first failure that has an error text.

    ``group`` asks for one failure type, which must be one that is repaired;
    ``limit`` then takes the first so many of it, in the order they were seen.
    """
    repairable = [g for g, _, action in GROUPS if action == "repair"]
    if group is not None:
        if group not in repairable:
            raise ValueError(f"failures of type {group} aren't repaired")
        repairable = [group]
    usable = members.filter(c("group").isin(repairable) & c("frag_id").isNotNull() & (strip(c("error")) != ""))
    fields = ["seq", "tc_id", "mapper", "sql_id", "statement_type", "category", "error"]
    one = usable.groupBy("group", "frag_id").agg(F.min_by(F.struct(*fields), "seq").alias("r")).select("group", "frag_id", "r.*")
    one = one.withColumn("error", F.substring("error", 1, ERROR_CHARS))
    return one if limit is None else one.orderBy("seq").limit(limit)


def without_error(members: DataFrame) -> DataFrame:
    """Fragments of repairable groups left out of the worklist because no failure names an error."""
    repairable = [g for g, _, action in GROUPS if action == "repair"]
    known = members.filter(c("group").isin(repairable) & c("frag_id").isNotNull())
    return known.groupBy("group", "frag_id").agg(F.count_if(strip(c("error")) != "").alias("with_error")).filter(
        c("with_error") == 0).drop("with_error")


def pending(fragments: DataFrame, completed: DataFrame, key: str = "fragment_id") -> DataFrame:
    return fragments.join(completed.select(key), key, "left_anti")


def retryable(progress: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    return progress.filter((c("status") == "failed") & (c("retry_count") < max_retries))


def reset_by_status(progress: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return progress.filter(c("status").isin(list(statuses)))


def reset_by_ids(completed: DataFrame, targets: DataFrame, key: str = "fragment_id") -> tuple[DataFrame, DataFrame]:
    """Completed work left after a reset, and how many targets were removed or not found."""
    wanted = targets.select(key).distinct()
    left = completed.join(wanted, key, "left_anti")
    done = completed.select(key, F.lit(True).alias("_done")).distinct()
    counts = wanted.join(done, key, "left").agg(
        F.count_if(c("_done").isNotNull()).alias("removed"), F.count_if(c("_done").isNull()).alias("not_found"))
    return left, counts


def reset_by_sql_id(progress: DataFrame, sql_ids: DataFrame, key: str = "fragment_id") -> DataFrame:
    """Progress rows whose fragment id ends in ``__`` and one of the given sql ids.

    Every ending that follows a double underscore is looked up by equality, so
    no row is compared with every id.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.length(key) - 2, F.lit(1)))
    endings = F.transform(starts, lambda i: F.when(F.substr(c(key), i, F.lit(2)) == "__", F.substr(c(key), i + 2)))
    hits = progress.select(key, F.explode(F.array_compact(endings)).alias("sql_id")).join(
        sql_ids.select("sql_id").distinct(), "sql_id", "left_semi").select(key).distinct()
    return progress.join(hits, key, "left_semi")
