"""Reconciliation of a source with a target: counts, columns, cells, rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.functions.equality import cell_text, cells_equal, grouped_cell
from cutover.operators.digest import changed_keys, rows_of_keys, shared_columns
from cutover.operators.ordered import Order, global_index
from cutover.operators.selection import numbered_rows

# Outcome names of the comparison report.
PASSED, FAILED, SKIPPED = "passed", "failed", "skipped"
EXECUTION_ERROR, ROW_COUNT, COLUMN, VALUE = "execution_error", "row_count_mismatch", "column_mismatch", "value_mismatch"
SEVERITY = {EXECUTION_ERROR: "high", ROW_COUNT: "high", COLUMN: "critical", VALUE: "medium"}
DEFAULT_ERROR = "extraction/execution error"
SAMPLED_NOTE = "대용량 결과 - 샘플 비교 (신뢰도 medium)"
SHOWN_CELLS = 20
KEPT_ROWS = 10_000
HEAD, MIDDLE, TAIL = 1000, 3000, 1000
MATCH_RATE = 0.95
PARALLEL_PAIRS = 8

c = F.col


def _severity(kind: Column) -> Column:
    out = F
    for name, level in SEVERITY.items():
        out = out.when(kind == name, level)
    return out


def error_note(source_ok: Column, source_error: Column, target_ok: Column, target_error: Column) -> Column:
    side = lambda ok, label, text: F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{label}: "), F.coalesce(text, F.lit("failed"))))
    return F.concat_ws(" | ", side(source_ok, "source", source_error), side(target_ok, "target", target_error))


def outcomes(runs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Judge one row per test case; ``carry`` names further columns to keep.

    Expects raw_status, error_message, source_/target_ skipped, skip_reason,
    success, error, rows, ms, sampled, and columns_differ, value_mismatches.
    For statements that change data, *_rows holds the affected rows, so that
    two such runs do not always look equal.
    """
    broken = c("raw_status") == "error"
    skipped = c("source_skipped") | c("target_skipped")
    ran = F.coalesce(c("source_success") & c("target_success"), F.lit(False))
    compared = ~broken & ~skipped & ran
    rows_ok = ~compared | (c("source_rows") == c("target_rows"))
    cols_ok = ~compared | ~c("columns_differ")
    cells_ok = ~compared | ~cols_ok | (c("value_mismatches") == 0)
    kind = (
        F.when(broken, EXECUTION_ERROR).when(skipped, None).when(~ran, EXECUTION_ERROR)
        .when(~rows_ok, ROW_COUNT).when(~cols_ok, COLUMN).when(~cells_ok, VALUE)
    )
    judged = runs.select(
        "*", broken.alias("_broken"), skipped.alias("_skipped"), compared.alias("_compared"),
        rows_ok.alias("row_count_matched"), cols_ok.alias("columns_matched"), cells_ok.alias("values_matched"), kind.alias("failure_type"))
    counted = ~c("_broken") & ~c("_skipped")
    return judged.select(
        "tc_id",
        F.when(~c("_broken") & c("_skipped"), SKIPPED).when(c("failure_type").isNull(), PASSED).otherwise(FAILED).alias("status"),
        (c("_compared") & c("failure_type").isNull()).alias("matched"),
        "failure_type", _severity(c("failure_type")).alias("severity"),
        "row_count_matched", "columns_matched", "values_matched",
        F.when(counted, c("source_rows")).otherwise(0).cast("bigint").alias("source_rows"),
        F.when(counted, c("target_rows")).otherwise(0).cast("bigint").alias("target_rows"),
        # a run that never reached the databases has no times
        F.when(~c("_broken"), c("source_ms")).alias("source_time_ms"),
        F.when(~c("_broken"), c("target_ms")).alias("target_time_ms"),
        F.when(c("_broken"), F.coalesce(c("error_message"), F.lit(DEFAULT_ERROR)))
        .when(c("_skipped"), c("skip_reason"))
        .when(~c("_compared"), error_note(c("source_success"), c("source_error"), c("target_success"), c("target_error")))
        .when(c("source_sampled") | c("target_sampled"), SAMPLED_NOTE).alias("note"),
        *carry,
    )


def row_count_check(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both counts and target minus source, from one pass over each side."""
    both = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionAll(target.select(F.lit(0).alias("s"), F.lit(1).alias("t")))
    counts = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("target_rows"))
    return counts.select("*", (c("target_rows") - c("source_rows")).alias("difference"), (c("source_rows") == c("target_rows")).alias("matched"))


def column_check(source: DataFrame, target: DataFrame) -> tuple[list[str], list[str]]:
    """Lower-case names missing in the target and extra in it, sorted; reads schemas only."""
    s, t = {x.lower() for x in source.columns}, {x.lower() for x in target.columns}
    return sorted(s - t), sorted(t - s)


def column_check_many(source_catalog: DataFrame, target_catalog: DataFrame) -> DataFrame:
    """The same check over catalogues with columns table_name and column_name; one row per differing column."""
    names = lambda df, flag: df.select(
        F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"), F.lit(True).alias(flag)).distinct()
    joined = names(source_catalog, "s").join(names(target_catalog, "t"), ["table_name", "column_name"], "full_outer")
    return joined.filter(c("s").isNull() | c("t").isNull()).select(
        "table_name", "column_name", F.when(c("t").isNull(), "missing_in_target").otherwise("extra_in_target").alias("finding"))


def _sided(df: DataFrame, side: str, names: Sequence[str], keys: Mapping[str, str]) -> DataFrame:
    """Keys under common names, the rest packed into one struct of that side."""
    cols = F.struct(*(c(n) for n in names)) if names else F.struct(F.lit(1).alias("_none"))
    return df.select(*(c(n).alias(k) for k, n in keys.items()), cols.alias(side))


def _pairs(source: DataFrame, target: DataFrame, shared: Sequence[tuple[str, str]]):
    """For each shared column: source cell, its type, target cell, its type."""
    st, tt = source.schema, target.schema
    return [(s, c("s")[s], st[s].dataType, c("t")[t], tt[t].dataType) for s, t in shared]


def _all_equal(pairs) -> Column:
    out = F.lit(True)
    for _, a, at, b, bt in pairs:
        out = out & cells_equal(a, at, b, bt)
    return out


def _cells(pairs) -> Column:
    """The differing cells of a joined row."""
    every = F.array(*(
        F.when(~cells_equal(a, at, b, bt), F.struct(
            F.lit(i).alias("ordinal"), F.lit(name).alias("column"),
            cell_text(a, at).alias("source_value"), cell_text(b, bt).alias("target_value")))
        for i, (name, a, at, b, bt) in enumerate(pairs)))
    return F.filter(every, lambda x: x.isNotNull())


def positional_cells(source: DataFrame, target: DataFrame, order: Order) -> DataFrame:
    """Differing cells of rows at the same place of both ordered results, up to the shorter one.

    ``order`` must be total: without one, "row i" means nothing.
    """
    shared = shared_columns(source, target)
    names = {n.lower(): n for n in target.columns}
    on_target = [(names[o.lower()]) if isinstance(o, str) else (names[o[0].lower()], o[1]) for o in order]
    s = _sided(global_index(source, order, "row_index"), "s", [x for x, _ in shared], {"row_index": "row_index"})
    t = _sided(global_index(target, on_target, "row_index"), "t", [y for _, y in shared], {"row_index": "row_index"})
    pairs = _pairs(source, target, shared)
    # rows that agree are dropped before any cell is unpivoted
    differing = s.join(t, "row_index").filter(~_all_equal(pairs))
    return differing.select("row_index", F.explode(_cells(pairs)).alias("cell")).select("row_index", "cell.*")


def shown(cells: DataFrame, limit: int = SHOWN_CELLS) -> DataFrame:
    """The first cells in (row, column) order, as many as a report shows."""
    return cells.orderBy("row_index", "ordinal").limit(limit).drop("ordinal")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(c("copies") > 1)


def _changed_rows(source: DataFrame, target: DataFrame, keys: Sequence[str], found: DataFrame):
    """Both rows of each changed key, and the pairs of their cells; only those rows are moved."""
    shared = shared_columns(source, target, keys)
    theirs = {x.lower(): x for x in target.columns}
    wanted = found.filter("change = 'changed'").select(*keys)
    t_keys = [theirs[k.lower()] for k in keys]
    s = _sided(rows_of_keys(source, keys, wanted, keys), "s", [x for x, _ in shared], {f"_k{i}": k for i, k in enumerate(keys)})
    t = _sided(rows_of_keys(target, t_keys, wanted, keys), "t", [y for _, y in shared], {f"_t{i}": k for i, k in enumerate(t_keys)})
    on = reduce(lambda a, b: a & b, (s[f"_k{i}"].eqNullSafe(t[f"_t{i}"]) for i in range(len(keys))))
    both = s.join(t, on).select(*(c(f"_k{i}").alias(k) for i, k in enumerate(keys)), "s", "t")
    return both, _pairs(source, target, shared)


def _findings(source: DataFrame, target: DataFrame, keys: Sequence[str], found: DataFrame) -> DataFrame:
    """Keyed findings as rows, from the keys whose digests differ."""
    nothing = F.lit(None).cast("string")
    copies = lambda n: F.when(c("change") == "duplicate_key", F.concat(c(n), F.lit(" copies")))
    whole = found.filter("change <> 'changed'").select(*keys, "change", nothing.alias("column"), copies("sn").alias("source_value"), copies("tn").alias("target_value"))
    both, pairs = _changed_rows(source, target, keys, found)
    if not pairs:
        return whole
    cells = both.select(*keys, F.lit("changed").alias("change"), F.explode(_cells(pairs)).alias("cell"))
    return whole.unionByName(cells.select(*keys, "change", "cell.column", "cell.source_value", "cell.target_value"))


def keyed_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], unique: bool = False) -> DataFrame:
    """Rows missing or extra in the target and changed cells of common rows.

    A key that repeats on either side cannot be paired row by row; it is
    reported once as ``duplicate_key`` with its counts, and what differs in
    its rows is found by ``repeated_key_diff``.  Where keys are known to be
    unique, ``unique`` lets equal parts of the tables go by unread (see
    ``changed_keys``).
    """
    found, _ = changed_keys(source, target, keys, unique)
    return _findings(source, target, keys, found)


def multiset_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows, with copies counted, that only one side has; for tables without a key.

    One partially aggregated shuffle of both sides; copies never meet in pairs.
    """
    names = [x for x, _ in shared_columns(source, target)]
    theirs = {x.lower(): x for x in target.columns}
    both = source.select(*names, F.lit(1).alias("_d")).unionAll(target.select(*(c(theirs[x.lower()]) for x in names), F.lit(-1).alias("_d")))
    return both.groupBy(*names).agg(F.sum("_d").alias("_d")).filter(c("_d") != 0).select(
        *names, F.when(c("_d") > 0, "missing_in_target").otherwise("extra_in_target").alias("change"), F.abs("_d").alias("copies"))


def _repeated_rows(source: DataFrame, target: DataFrame, keys: Sequence[str], found: DataFrame) -> DataFrame:
    """Rows, with copies counted, that only one side has, of the repeated keys whose digests differ."""
    shared = shared_columns(source, target, keys)
    theirs = {x.lower(): x for x in target.columns}
    st, tt = source.schema, target.schema
    wanted = found.filter("change = 'duplicate_key' AND NOT alike").select(*keys)
    one = F.lit(1).cast("bigint")
    t_keys = [theirs[k.lower()] for k in keys]
    s = rows_of_keys(source, keys, wanted, keys).select(*keys, *(grouped_cell(c(x), st[x].dataType, tt[y].dataType).alias(x) for x, y in shared), one.alias("_d"))
    t = rows_of_keys(target, t_keys, wanted, keys).select(
        *(c(n).alias(k) for k, n in zip(keys, t_keys)), *(grouped_cell(c(y), tt[y].dataType, st[x].dataType).alias(x) for x, y in shared), (-one).alias("_d"))
    names = [x for x, _ in shared]
    return s.unionAll(t).groupBy(*keys, *names).agg(F.sum("_d").alias("_d")).filter(c("_d") != 0).select(
        *keys, *(c(x)["v"].alias(x) for x in names), F.when(c("_d") > 0, "missing_in_target").otherwise("extra_in_target").alias("change"), F.abs("_d").alias("copies"))


def repeated_key_diff(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of repeated keys, with copies counted, that only one side has.

    Rows of a key that repeats on either side can't be paired one by one, so
    they are compared as multisets.  Cells are grouped in a form in which equal
    means what it means for single cells.  Only rows of keys whose digests
    differ are looked at.
    """
    found, _ = changed_keys(source, target, keys)
    return _repeated_rows(source, target, keys, found)


def bounded(df: DataFrame, order: Order, kept: int = KEPT_ROWS) -> DataFrame:
    """The first ``kept`` rows with the exact total and a flag telling whether rows were left out."""
    rows, total = numbered_rows(df, order, lambda n: [(0, kept - 1)], lambda n: lambda i: i < kept)
    return rows.drop("_i").withColumns({"total_rows": F.lit(total).cast("bigint"), "sampled": F.lit(total > kept)})


def head_middle_tail(df: DataFrame, order: Order, head: int = HEAD, middle: int = MIDDLE, tail: int = TAIL) -> DataFrame:
    """First, evenly spaced and last rows of an ordered result, numbered ``sample_index`` from 0.

    A result no longer than the sample is kept whole.
    """
    whole = lambda n: n <= head + middle + tail
    step = lambda n: max(1, (n - head - tail) // middle)

    def places(n: int) -> list[tuple[int, int]]:
        if whole(n):
            return [(0, n - 1)]
        spaced = ((head + k * step(n),) * 2 for k in range(middle) if head + k * step(n) < n - tail)
        return [(0, head - 1), *spaced, (n - tail, n - 1)]

    def keep(n: int):
        if whole(n):
            return lambda i: F.lit(True)
        spaced = lambda i: (i >= head) & (i < n - tail) & ((i - head) % step(n) == 0) & (F.floor((i - head) / step(n)) < middle)
        return lambda i: (i < head) | (i >= n - tail) | spaced(i)

    rows, n = numbered_rows(df, order, places, keep)
    i = c("_i")
    place = i if whole(n) else F.when(i < head, i).when(i >= n - tail, i - (n - tail) + head + middle).otherwise(head + F.floor((i - head) / step(n)))
    return rows.withColumn("sample_index", place.cast("bigint")).drop("_i").withColumn("total_rows", F.lit(n).cast("bigint"))


def _samples(source: DataFrame, target: DataFrame, order: Order, *sizes: int) -> list[DataFrame]:
    """The samples of both sides, taken side by side."""
    take = lambda x: x[0].run(head_middle_tail, x[1], order, *sizes)
    with ThreadPoolExecutor(2) as pool:
        return list(pool.map(take, [(copy_context(), source), (copy_context(), target)]))


def sampled_match(source: DataFrame, target: DataFrame, order: Order, head: int = HEAD, middle: int = MIDDLE, tail: int = TAIL) -> DataFrame:
    """Match rate of the two samples, place by place; two empty results match, without a rate."""
    shared = shared_columns(source, target)
    of_source, of_target = _samples(source, target, order, head, middle, tail)
    s = _sided(of_source, "s", [x for x, _ in shared], {"sample_index": "sample_index", "s_total": "total_rows"})
    t = _sided(of_target, "t", [y for _, y in shared], {"sample_index": "sample_index", "t_total": "total_rows"})
    both = c("s").isNotNull() & c("t").isNotNull()
    hit = both & _all_equal(_pairs(source, target, shared))
    totals = s.join(t, "sample_index", "full_outer").agg(
        F.coalesce(F.max("s_total"), F.lit(0)).alias("source_total_rows"), F.coalesce(F.max("t_total"), F.lit(0)).alias("target_total_rows"),
        F.count_if(both).alias("samples_compared"), F.count_if(hit).alias("samples_matched"))
    rate = F.try_divide("samples_matched", "samples_compared")
    same_count = c("source_total_rows") == c("target_total_rows")
    return totals.select(
        "*", rate.alias("sample_match_rate"), same_count.alias("row_count_matched"),
        (same_count & ((rate > MATCH_RATE) | (c("source_total_rows") == 0))).alias("matched"),
        F.when((rate > MATCH_RATE) | (same_count & (c("source_total_rows") == 0)), "medium").otherwise("low").alias("confidence"))


def sampled_mismatches(source: DataFrame, target: DataFrame, order: Order, head: int = HEAD, middle: int = MIDDLE, tail: int = TAIL) -> DataFrame:
    """Differing cells of the two samples with their ``sample_index``, where both have a row."""
    shared = shared_columns(source, target)
    of_source, of_target = _samples(source, target, order, head, middle, tail)
    s = _sided(of_source, "s", [x for x, _ in shared], {"sample_index": "sample_index"})
    t = _sided(of_target, "t", [y for _, y in shared], {"sample_index": "sample_index"})
    pairs = _pairs(source, target, shared)
    differing = s.join(t, "sample_index").filter(~_all_equal(pairs))
    return differing.select("sample_index", F.explode(_cells(pairs)).alias("cell")).select("sample_index", "cell.*").drop("ordinal")


def reconcile(name: str, source: DataFrame, target: DataFrame, keys: Sequence[str], unique: bool = False) -> DataFrame:
    """One row: counts, column sets, changed cells and rows, and the resulting outcome.

    One shuffle of digests finds the keys that differ; cells and copies are
    compared for those only, and not at all where there are none.
    """
    missing, extra = column_check(source, target)
    found, rows = changed_keys(source, target, keys, unique)
    tally = {kind: 0 for kind in ("missing_in_target", "extra_in_target", "duplicate_key", "changed")}
    apart = 0
    for r in found.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.count_if(~c("alike")).alias("apart")).collect():
        tally[r.change] = r.n
        apart = r.apart if r.change == "duplicate_key" else apart
    cells = 0
    if tally["changed"]:
        both, pairs = _changed_rows(source, target, keys, found)
        # counted without building the cells
        cells = both.agg(F.sum(sum((F.when(cells_equal(a, at, b, bt), 0).otherwise(1) for _, a, at, b, bt in pairs), F.lit(0)))).first()[0]
    repeated = _repeated_rows(source, target, keys, found).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] if apart else 0
    return _judged(source.sparkSession, [_run(
        name, **rows, columns_differ=bool(missing or extra),
        # rows without a partner differ too, even when the counts happen to agree
        value_mismatches=cells + tally["missing_in_target"] + tally["extra_in_target"] + repeated,
        missing_rows=tally["missing_in_target"], extra_rows=tally["extra_in_target"], duplicate_keys=tally["duplicate_key"], changed_cells=cells,
        missing_columns=",".join(missing), extra_columns=",".join(extra))])


_RUN_DDL = ("tc_id string, raw_status string, error_message string, skip_reason string, source_skipped boolean, target_skipped boolean, "
            "source_success boolean, target_success boolean, source_error string, target_error string, source_sampled boolean, target_sampled boolean, "
            "source_ms long, target_ms long, source_rows long, target_rows long, columns_differ boolean, value_mismatches long, "
            "missing_rows long, extra_rows long, duplicate_keys long, changed_cells long, missing_columns string, extra_columns string")


def _run(name: str, **known) -> dict:
    """A run that both sides made, with what is known of it."""
    return {"tc_id": name, "raw_status": "ok", "source_skipped": False, "target_skipped": False, "source_success": True, "target_success": True,
            "source_sampled": False, "target_sampled": False, "columns_differ": False, "value_mismatches": 0, "source_rows": 0, "target_rows": 0} | known


def _judged(spark, runs: Sequence[dict]) -> DataFrame:
    schema = T.StructType.fromDDL(_RUN_DDL)
    rows = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in runs], schema)
    return outcomes(rows, ["missing_rows", "extra_rows", "duplicate_keys", "changed_cells", "missing_columns", "extra_columns"])


def reconcile_many(pairs: Mapping[str, tuple], parallel: int = PARALLEL_PAIRS) -> DataFrame:
    """One report over many table pairs, a row for each, in the order given.

    A pair is (source, target, keys) or (source, target, keys, unique); either
    table may be a function that makes it.  Pairs run side by side.  One that
    fails is reported as an execution error with its message, and the others
    go on.
    """
    if not pairs:
        raise ValueError("no table pairs given")

    def one(item):
        name, (source, target, *rest) = item
        try:
            source, target = (x() if callable(x) else x for x in (source, target))
            return reconcile(name, source, target, *rest)
        except Exception as e:  # noqa: BLE001 - every failure becomes a row of the report
            return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"

    with ThreadPoolExecutor(parallel) as pool:
        # tables staged in a thread belong to the caller's block
        done = list(pool.map(lambda item: item[0].run(one, item[1]), [(copy_context(), i) for i in pairs.items()]))
    spark = SparkSession.active()
    reports = [r if isinstance(r, DataFrame) else _judged(spark, [_run(n, raw_status="error", error_message=r)]) for n, r in zip(pairs, done)]
    return reduce(DataFrame.unionByName, reports)
