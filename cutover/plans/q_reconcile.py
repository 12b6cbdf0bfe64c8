"""Registered queries: reconciliation, summaries and triage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutover.functions.equality import cells_equal
from cutover.operators import compare as R
from cutover.operators import summary as S
from cutover.operators import triage as X
from cutover.plans.registry import query
from cutover.plans.sqltext import half_up

c = F.col
BIG = "HUGEINT"

OUTCOMES_SQL = """SELECT tc_id, seq, mapper, sql_id,
  case when raw_status = 'error' then 'failed' when skipped then 'skipped' when kind is null then 'passed' else 'failed' end AS status,
  raw_status <> 'error' and not skipped and ran and kind is null AS matched, kind AS failure_type,
  case kind when 'execution_error' then 'high' when 'row_count_mismatch' then 'high' when 'column_mismatch' then 'critical' when 'value_mismatch' then 'medium' end AS severity,
  not compared or source_rows = target_rows AS row_count_matched, not compared or not columns_differ AS columns_matched,
  not compared or columns_differ or value_mismatches = 0 AS values_matched,
  case when raw_status = 'error' or skipped then 0 else source_rows end AS source_rows, case when raw_status = 'error' or skipped then 0 else target_rows end AS target_rows,
  case when raw_status <> 'error' then source_ms end AS source_time_ms, case when raw_status <> 'error' then target_ms end AS target_time_ms,
  case when raw_status = 'error' then coalesce(error_message, 'extraction/execution error') when skipped then skip_reason
    when not ran then concat_ws(' | ', case when not source_success then 'source: ' || coalesce(source_error, 'failed') end, case when not target_success then 'target: ' || coalesce(target_error, 'failed') end)
    when source_sampled or target_sampled then '대용량 결과 - 샘플 비교 (신뢰도 medium)' end AS note
FROM (SELECT *, raw_status <> 'error' and not skipped and ran AS compared,
  case when raw_status = 'error' then 'execution_error' when skipped then null when not ran then 'execution_error' when source_rows <> target_rows then 'row_count_mismatch'
    when columns_differ then 'column_mismatch' when value_mismatches > 0 then 'value_mismatch' end AS kind
  FROM (SELECT *, source_skipped or target_skipped AS skipped, source_success and target_success AS ran FROM runs))"""
_OUTCOME_COLS = "tc_id:s status:s matched:b failure_type:s severity:s row_count_matched:b columns_matched:b values_matched:b source_rows:i target_rows:i"

query("r01_outcomes", _OUTCOME_COLS, OUTCOMES_SQL)(lambda t: R.outcomes(t.runs))

query("r02_row_count", "source_rows:i target_rows:i difference:i matched:b", """
SELECT s AS source_rows, g AS target_rows, g - s AS difference, s = g AS matched FROM (SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM orders_target) AS g)
""")(lambda t: R.row_count_check(t.orders, t.orders_target))


def _catalogs(t):
    source = t.lineitem.select(F.concat(F.lit("T"), c("l_orderkey")).alias("table_name"), F.concat(F.lit("Col_"), c("l_linenumber")).alias("column_name"))
    target = t.lineitem.select(F.concat(F.lit("t"), c("l_orderkey")).alias("table_name"), F.concat(F.lit("COL_"), F.expr("case when l_partkey % 10 = 0 then 9 else l_linenumber end")).alias("column_name"))
    return source, target


query("r03_column_sets", "table_name:s column_name:s finding:s", """
SELECT 't' || coalesce(s.o, g.o) AS table_name, 'col_' || coalesce(s.n, g.n) AS column_name, case when g.o is null then 'missing_in_target' else 'extra_in_target' end AS finding
FROM (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem) s FULL JOIN
  (SELECT DISTINCT l_orderkey AS o, case when l_partkey % 10 = 0 then 9 else l_linenumber end AS n FROM lineitem) g ON s.o = g.o AND s.n = g.n WHERE s.o IS NULL OR g.o IS NULL
""")(lambda t: R.column_check_many(*_catalogs(t)))


def _money(df):
    """Amounts as exact decimals, so that their text is the same in every engine."""
    return df.withColumn("o_totalprice", c("o_totalprice").cast("decimal(14,2)")).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


_POS_SQL = """
SELECT row_index, ordinal, col AS column_name, source_value, target_value FROM (
  SELECT s.i AS row_index, unnest([0, 1, 2, 3, 4, 5]) AS ordinal, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS col,
    unnest(s.v) AS source_value, unnest(g.v) AS target_value
  FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, [o_orderkey::varchar, o_custkey::varchar, o_orderstatus, o_totalprice::decimal(14,2)::varchar, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority] AS v FROM orders) s
  JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, [o_orderkey::varchar, o_custkey::varchar, o_orderstatus, o_totalprice::decimal(14,2)::varchar, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority] AS v FROM orders_target) g ON s.i = g.i)
WHERE source_value IS DISTINCT FROM target_value"""
query("r04_positional_cells", "row_index:i ordinal:i column_name:s source_value:s target_value:s", _POS_SQL)(
    lambda t: R.positional_cells(_money(t.orders), _money(t.orders_target), ["o_orderkey"]).withColumnRenamed("column", "column_name"))
query("r04_positional_shown", "row_index:i column_name:s source_value:s target_value:s", _POS_SQL + " ORDER BY row_index, ordinal LIMIT 20")(
    lambda t: R.shown(R.positional_cells(_money(t.orders), _money(t.orders_target), ["o_orderkey"])).withColumnRenamed("column", "column_name"))


def _strict(t):
    df = t.part.withColumns({
        "size_d": c("p_size").cast("double"), "padded": F.concat("p_brand", F.lit(" ")), "size_s": c("p_size").cast("string"),
        "flag": c("p_size") > 25, "maybe": F.expr("case when p_size % 3 > 0 then p_size end"), "near": c("p_retailprice") + 0.001,
        "brand_or_padded": F.expr("case when p_size % 2 = 0 then p_brand else concat(p_brand, ' ') end")})
    ty = {f.name: f.dataType for f in df.schema.fields}
    eq = lambda a, b: cells_equal(c(a), ty[a], c(b), ty[b])
    return df.select("p_partkey", eq("p_size", "size_d").alias("int_double"), eq("p_brand", "padded").alias("padding"), eq("p_size", "size_s").alias("int_text"),
                     eq("size_d", "size_s").alias("double_text"), eq("flag", "p_size").alias("bool_int"), eq("p_size", "maybe").alias("with_null"),
                     eq("maybe", "maybe").alias("null_null"), eq("p_retailprice", "near").alias("tolerance"), eq("p_brand", "brand_or_padded").alias("some_padding"))


query("r05_strict_equality", "p_partkey:i int_double:b padding:b int_text:b double_text:b bool_int:b with_null:b null_null:b tolerance:b some_padding:b", """
SELECT p_partkey, true AS int_double, false AS padding, true AS int_text, false AS double_text, false AS bool_int, p_size % 3 > 0 AS with_null, true AS null_null, false AS tolerance, p_size % 2 = 0 AS some_padding FROM part
""")(_strict)

def _decimals():
    """Keys beyond 2^53 and amounts as decimals, beside the doubles nearest to them."""
    big, cents, fine = T.DecimalType(20, 0), T.DecimalType(12, 2), T.DecimalType(30, 19)
    key = c("o_orderkey").cast(big) * 2 + F.lit(9007199254740992).cast(big)
    amount = c("o_totalprice").cast(cents)
    eq = lambda a, at, b: cells_equal(a.cast(at), at, b, T.DoubleType())
    return [
        eq(key, big, key.cast("double")).alias("same"), eq(key + 1, big, (key + 1).cast("double")).alias("shifted"),
        eq(amount, cents, amount.cast("double")).alias("fraction"),
        eq(amount.cast(fine) + F.lit("0.0000000000000000001").cast(fine), fine, amount.cast("double")).alias("finer")]


query("r05_decimal_double", "o_orderkey:i same:b shifted:b fraction:b finer:b", """
SELECT o_orderkey, true AS same, false AS shifted, true AS fraction, false AS finer FROM orders
""")(lambda t: t.orders.select("o_orderkey", *_decimals()))

query("r06_failure_precedence", "failure_type:s severity:s n:i rows_ok:i columns_ok:i values_ok:i", f"""
SELECT failure_type, severity, count(*) AS n, count(*) FILTER (row_count_matched) AS rows_ok, count(*) FILTER (columns_matched) AS columns_ok, count(*) FILTER (values_matched) AS values_ok FROM ({OUTCOMES_SQL}) GROUP BY 1, 2
""")(lambda t: R.outcomes(t.runs).groupBy("failure_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if("row_count_matched").alias("rows_ok"),
     F.count_if("columns_matched").alias("columns_ok"), F.count_if("values_matched").alias("values_ok")))

query("r07_execution_notes", "tc_id:s note:s", f"SELECT tc_id, note FROM ({OUTCOMES_SQL}) WHERE note IS NOT NULL")(
    lambda t: R.outcomes(t.runs).filter(c("note").isNotNull()).select("tc_id", "note"))

_KEYED_SQL = """
SELECT o_orderkey, 'missing_in_target' AS change, null AS column_name, null AS source_value, null AS target_value FROM orders s WHERE NOT EXISTS (SELECT 1 FROM orders_target g WHERE g.o_orderkey = s.o_orderkey)
UNION ALL SELECT o_orderkey, 'extra_in_target', null, null, null FROM orders_target s WHERE NOT EXISTS (SELECT 1 FROM orders g WHERE g.o_orderkey = s.o_orderkey)
UNION ALL SELECT s.o_orderkey, 'changed', 'o_orderstatus', s.o_orderstatus, g.o_orderstatus FROM orders s JOIN orders_target g USING (o_orderkey) WHERE s.o_orderstatus IS DISTINCT FROM g.o_orderstatus
UNION ALL SELECT s.o_orderkey, 'changed', 'o_totalprice', s.o_totalprice::decimal(14,2)::varchar, g.o_totalprice::decimal(14,2)::varchar FROM orders s JOIN orders_target g USING (o_orderkey) WHERE s.o_totalprice::decimal(14,2) <> g.o_totalprice::decimal(14,2)"""
query("r08_keyed_diff", "o_orderkey:i change:s column_name:s source_value:s target_value:s", _KEYED_SQL)(
    lambda t: R.keyed_diff(_money(t.orders), _money(t.orders_target).toDF(*[x.upper() for x in t.orders.columns]), ["o_orderkey"]).withColumnRenamed("column", "column_name"))

query("r08_keyed_diff_by_bucket", "o_orderkey:i change:s column_name:s source_value:s target_value:s", _KEYED_SQL)(
    lambda t: R.keyed_diff(_money(t.orders), _money(t.orders_target), ["o_orderkey"], unique=True).withColumnRenamed("column", "column_name"))

query("r08_keyed_diff_repeated_keys", "l_orderkey:i l_linenumber:i change:s column_name:s source_value:s target_value:s", """
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, 'duplicate_key' AS change, null AS column_name, n || ' copies' AS source_value, n || ' copies' AS target_value FROM k WHERE n > 1
UNION ALL SELECT l.l_orderkey, l.l_linenumber, 'changed', 'l_extendedprice', l.l_extendedprice::decimal(14,2)::varchar, (l.l_extendedprice::decimal(14,2) + 1)::varchar
FROM lineitem l JOIN k ON k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber WHERE n = 1 AND l.l_orderkey % 89 = 0
""")(lambda t: R.keyed_diff(*(x.withColumn("l_extendedprice", c("l_extendedprice").cast("decimal(14,2)")) for x in (t.lineitem, t.lineitem_target)),
                            ["l_orderkey", "l_linenumber"]).withColumnRenamed("column", "column_name"))

_LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
query("r08_multiset_diff", "l_orderkey:i l_partkey:i l_linenumber:i l_extendedprice:d change:s copies:i", f"""
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, case when d > 0 then 'missing_in_target' else 'extra_in_target' end AS change, abs(d) AS copies FROM (
  SELECT {_LINE}, sum(d) AS d FROM (SELECT {_LINE}, 1 AS d FROM lineitem UNION ALL SELECT {_LINE}, -1 FROM lineitem_target) GROUP BY ALL) WHERE d <> 0
""")(lambda t: R.multiset_diff(t.lineitem, t.lineitem_target))

# prices last: a changed price then does not move a row
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice"]
_LINE_KEYS = ", ".join(LINE_ORDER)
query("r08_changes_in_repeated_keys", "l_orderkey:i l_linenumber:i l_partkey:i l_quantity:d change:s copies:i", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem), t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS l_quantity FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber FROM s GROUP BY ALL HAVING count(*) > 1),
d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, sum(d) AS d FROM (SELECT *, 1 AS d FROM s UNION ALL SELECT *, -1 FROM t) GROUP BY ALL HAVING sum(d) <> 0)
SELECT d.l_orderkey, d.l_linenumber, l_partkey, l_quantity, CASE WHEN d > 0 THEN 'missing_in_target' ELSE 'extra_in_target' END AS change, abs(d) AS copies FROM d JOIN r USING (l_orderkey, l_linenumber)
""")(lambda t: R.repeated_key_diff(
    t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"),
    t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (c("l_quantity") + F.when(c("l_partkey") % 7 == 0, 1).otherwise(0)).alias("l_quantity")),
    ["l_orderkey", "l_linenumber"]))



def _beyond_the_scale(t):
    """Amounts of 31 digits, which the target's decimals can't hold and so are null there."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", c("l_quantity").cast("int").cast("string").alias("q"), (c("l_partkey") % 7 == 0).alias("wide"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    source = lines.select(*keys, F.when(c("wide"), F.concat("q", F.repeat(F.lit("0"), F.lit(30)))).otherwise(c("q")).cast("decimal(38,0)").alias("amount"))
    target = lines.select(*keys, F.when(~c("wide"), c("q")).cast("decimal(38,10)").alias("amount"))
    return R.repeated_key_diff(source, target, keys[:2])


query("r08_amounts_beyond_the_scale", "l_orderkey:i l_linenumber:i l_partkey:i amount:s change:s copies:i", """
WITH r AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1),
w AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS int)::varchar || repeat('0', 30) AS amount FROM lineitem JOIN r USING (l_orderkey, l_linenumber) WHERE l_partkey % 7 = 0)
SELECT l_orderkey, l_linenumber, l_partkey, amount, 'missing_in_target' AS change, count(*) AS copies FROM w GROUP BY ALL
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, NULL, 'extra_in_target', count(*) FROM w GROUP BY ALL
""")(_beyond_the_scale)

query("r09_bounded_rows", "l_orderkey:i l_partkey:i l_linenumber:i total_rows:i sampled:b", f"""
SELECT l_orderkey, l_partkey, l_linenumber, n AS total_rows, n > 10000 AS sampled FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY {_LINE_KEYS}) AS rn FROM lineitem) WHERE rn <= 10000
""")(lambda t: R.bounded(t.lineitem, LINE_ORDER))


def sample_sql(table: str) -> str:
    """The head/middle/tail sample of a table in LINE_ORDER, by definition."""
    return f"""SELECT *, case when n <= 5000 then i when i < 1000 then i when i >= n - 1000 then i - (n - 1000) + 4000 else 1000 + (i - 1000) // step END AS sample_index
FROM (SELECT *, greatest(1, (n - 2000) // 3000) AS step FROM (SELECT *, row_number() OVER (ORDER BY {_LINE_KEYS}) - 1 AS i, count(*) OVER () AS n FROM {table}))
WHERE n <= 5000 OR i < 1000 OR i >= n - 1000 OR ((i - 1000) % step = 0 AND (i - 1000) // step < 3000)"""


query("r10_head_middle_tail", "l_orderkey:i l_partkey:i l_linenumber:i sample_index:i total_rows:i", f"SELECT l_orderkey, l_partkey, l_linenumber, sample_index, n AS total_rows FROM ({sample_sql('lineitem')})")(
    lambda t: R.head_middle_tail(t.lineitem, LINE_ORDER))

query("r11_sampled_match", "source_total_rows:i target_total_rows:i samples_compared:i samples_matched:i sample_match_rate:d row_count_matched:b matched:b confidence:s", f"""
SELECT s AS source_total_rows, g AS target_total_rows, k AS samples_compared, m AS samples_matched, m / k AS sample_match_rate, s = g AS row_count_matched, s = g AND m / k > 0.95 AS matched, case when m / k > 0.95 then 'medium' else 'low' end AS confidence
FROM (SELECT max(a.n) AS s, max(b.n) AS g, count(*) AS k, count(*) FILTER (a.l_extendedprice = b.l_extendedprice AND a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey) AS m
  FROM ({sample_sql('lineitem')}) a JOIN ({sample_sql('lineitem_target')}) b USING (sample_index))
""")(lambda t: R.sampled_match(t.lineitem, t.lineitem_target, LINE_ORDER))

query("r11_empty", "source_total_rows:i target_total_rows:i samples_compared:i sample_match_rate:d row_count_matched:b matched:b", """
SELECT count(*) AS source_total_rows, count(*) AS target_total_rows, count(*) AS samples_compared, NULL AS sample_match_rate, true AS row_count_matched, true AS matched FROM lineitem WHERE l_quantity < 0
""")(lambda t: R.sampled_match(t.lineitem.filter("l_quantity < 0"), t.lineitem_target.filter("l_quantity < 0"), LINE_ORDER))

query("r11_sampled_mismatches", "sample_index:i column_name:s source_value:s target_value:s", f"""
SELECT a.sample_index, 'l_extendedprice' AS column_name, round(a.l_extendedprice * 100)::bigint::varchar AS source_value, round(b.l_extendedprice * 100)::bigint::varchar AS target_value
FROM ({sample_sql('lineitem')}) a JOIN ({sample_sql('lineitem_target')}) b USING (sample_index) WHERE a.l_extendedprice <> b.l_extendedprice
""")(lambda t: R.sampled_mismatches(t.lineitem, t.lineitem_target, LINE_ORDER).filter("column = 'l_extendedprice'").withColumnRenamed("column", "column_name").withColumns({
    x: F.round(c(x).cast("double") * 100).cast("bigint").cast("string") for x in ("source_value", "target_value")}))

query("r12_timing_kept", "tc_id:s status:s source_time_ms:i target_time_ms:i", f"SELECT tc_id, status, source_time_ms, target_time_ms FROM ({OUTCOMES_SQL}) WHERE status <> 'passed'")(
    lambda t: R.outcomes(t.runs).filter(c("status") != "passed"))


def _pairs(t):
    wider = t.part.toDF(*[x.upper() for x in t.part.columns]).withColumn("LOADED_AT", F.lit("x"))
    return {
        "orders": (t.orders, t.orders_target, ["o_orderkey"]),
        "customer": (t.customer, t.customer.drop("c_mktsegment"), ["c_custkey"]),
        "part": (t.part, wider.drop("P_SIZE"), ["p_partkey"]),
        "supplier": (t.supplier, t.supplier.toDF(*[x.upper() for x in t.supplier.columns]), ["s_suppkey"]),
    }


_MANY_COLS = "tc_id:s status:s failure_type:s severity:s row_count_matched:b columns_matched:b values_matched:b source_rows:i target_rows:i missing_rows:i extra_rows:i changed_cells:i missing_columns:s extra_columns:s"
_MANY_SQL = f"""
SELECT 'orders' AS tc_id, 'failed' AS status, case when s <> g then 'row_count_mismatch' else 'value_mismatch' end AS failure_type, case when s <> g then 'high' else 'medium' end AS severity, s = g AS row_count_matched, true AS columns_matched, false AS values_matched, s AS source_rows, g AS target_rows,
  (SELECT count(*) FROM ({_KEYED_SQL}) WHERE change = 'missing_in_target') AS missing_rows, (SELECT count(*) FROM ({_KEYED_SQL}) WHERE change = 'extra_in_target') AS extra_rows, (SELECT count(*) FROM ({_KEYED_SQL}) WHERE change = 'changed') AS changed_cells, '' AS missing_columns, '' AS extra_columns
FROM (SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM orders_target) AS g)
UNION ALL SELECT 'customer', 'failed', 'column_mismatch', 'critical', true, false, true, count(*), count(*), 0, 0, 0, 'c_mktsegment', '' FROM customer
UNION ALL SELECT 'part', 'failed', 'column_mismatch', 'critical', true, false, true, count(*), count(*), 0, 0, 0, 'p_size', 'loaded_at' FROM part
UNION ALL SELECT 'supplier', 'passed', null, null, true, true, true, count(*), count(*), 0, 0, 0, '', '' FROM supplier"""
query("r13_reconcile_many", _MANY_COLS, _MANY_SQL)(lambda t: R.reconcile_many(_pairs(t)))
query("r13_one_pair_fails", _MANY_COLS, f"""{_MANY_SQL}
UNION ALL SELECT 'absent', 'failed', 'execution_error', 'high', true, true, true, 0, 0, NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT 'unreadable', 'failed', 'execution_error', 'high', true, true, true, 0, 0, NULL, NULL, NULL, NULL, NULL FROM nation WHERE n_nationkey = 24""")(
    lambda t: R.reconcile_many(_pairs(t) | {
        "absent": (lambda: t.no_such_table, t.nation, ["n_nationkey"]),
        "unreadable": (t.nation, t.nation.withColumn("n_name", F.when(c("n_nationkey") == 24, F.raise_error(F.lit("torn row"))).otherwise(c("n_name"))), ["n_nationkey"])}))

SUMMARY_SQL = "SELECT n AS total_test_cases, p AS passed, f AS failed, k AS skipped, coalesce({rate}, 0) AS success_rate FROM (SELECT count(*) AS n, count(*) FILTER (status = 'passed') AS p, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'skipped') AS k FROM ({src}))".format(
    rate=half_up("CAST(p AS HUGEINT) * 100", "nullif(CAST(n - k AS HUGEINT), 0)", 1), src="{src}")
_SUMMARY_COLS = "total_test_cases:i passed:i failed:i skipped:i success_rate:d"
query("s01_status_summary", _SUMMARY_COLS, SUMMARY_SQL.format(src=OUTCOMES_SQL))(lambda t: S.status_summary(R.outcomes(t.runs)))
query("flagship_reconcile_summary", _SUMMARY_COLS, SUMMARY_SQL.format(src=_MANY_SQL))(lambda t: S.status_summary(R.reconcile_many(_pairs(t))))

query("s02_failure_breakdown", "failure_type:s failures:i", f"SELECT failure_type, count(*) AS failures FROM ({OUTCOMES_SQL}) WHERE status = 'failed' GROUP BY 1")(
    lambda t: S.failure_breakdown(R.outcomes(t.runs)))
query("s03_failure_extract", "tc_id:s failure_type:s severity:s source_rows:i target_rows:i row_diff:i note:s", f"""
SELECT tc_id, coalesce(failure_type, '') AS failure_type, coalesce(severity, '') AS severity, source_rows, target_rows, target_rows - source_rows AS row_diff, replace(coalesce(note, ''), chr(10), ' ') AS note FROM ({OUTCOMES_SQL}) WHERE status = 'failed'
""")(lambda t: S.failure_extract(R.outcomes(t.runs)))
_TIMING = f"""SELECT coalesce(m.sql_id, o.tc_id) AS sql_id, o.tc_id, coalesce(namespace, '') AS namespace, coalesce(m.mapper, '') AS mapper, status, source_time_ms AS source_ms, target_time_ms AS target_ms, target_time_ms - source_time_ms AS gap_ms,
  case when source_time_ms > 0 then {half_up('CAST(target_time_ms AS HUGEINT)', 'CAST(source_time_ms AS HUGEINT)', 2)} end AS ratio
FROM ({OUTCOMES_SQL}) o LEFT JOIN cases m ON m.tc_id = o.tc_id WHERE source_time_ms IS NOT NULL AND target_time_ms IS NOT NULL"""
query("s04_timing_rows", "tc_id:s status:s source_ms:i target_ms:i gap_ms:i ratio:d", _TIMING)(lambda t: S.timing_rows(R.outcomes(t.runs), t.cases))
query("s05_timing_metadata", "tc_id:s sql_id:s namespace:s mapper:s", _TIMING)(lambda t: S.timing_rows(R.outcomes(t.runs), t.cases))
query("s06_timing_rollup", "total_queries:i source_total_ms:i target_total_ms:i slow_queries:i source_avg_ms:d target_avg_ms:d improvement_pct:d", f"""
SELECT n AS total_queries, s AS source_total_ms, g AS target_total_ms, slow AS slow_queries, {half_up('s', 'n', 1)} AS source_avg_ms, {half_up('g', 'n', 1)} AS target_avg_ms, {half_up('(s - g) * 100', 's', 1)} AS improvement_pct
FROM (SELECT CAST(count(*) AS HUGEINT) AS n, CAST(sum(source_time_ms) AS HUGEINT) AS s, CAST(sum(target_time_ms) AS HUGEINT) AS g, count(*) FILTER (greatest(source_time_ms, target_time_ms) > 150) AS slow
  FROM ({OUTCOMES_SQL}) WHERE source_time_ms IS NOT NULL AND target_time_ms IS NOT NULL)
""")(lambda t: S.timing_rollup(R.outcomes(t.runs), 150))
query("s07_top_failures", "tc_id:s failure_type:s severity:s severity_rank:i", f"""
SELECT tc_id, failure_type, severity, case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 when 'low' then 4 else 5 end AS severity_rank FROM ({OUTCOMES_SQL}) WHERE status = 'failed' ORDER BY 4, 1 LIMIT 25
""")(lambda t: S.top_failures(R.outcomes(t.runs), 25))
query("s08_conversion_summary", "status:s fragments:i", "SELECT status, count(*) AS fragments FROM progress GROUP BY 1")(lambda t: S.conversion_summary(t.progress))
query("s10_group_shares", "status:s failure_type:s n:i share_pct:d", f"""
SELECT status, failure_type, n, {half_up('CAST(n AS HUGEINT) * 100', 'CAST(sum(n) OVER () AS HUGEINT)', 1)} AS share_pct FROM (SELECT status, failure_type, count(*) AS n FROM ({OUTCOMES_SQL}) GROUP BY 1, 2)
""")(lambda t: S.shares(R.outcomes(t.runs), "status", "failure_type"))

# ---- triage -------------------------------------------------------------------
_WS = "' ' || chr(9) || chr(10) || chr(13)"
SIDES_SQL = f"""SELECT *, case when contains(n0, 'source:') then rtrim(rtrim(trim(split_part(n0[instr(n0, 'source:') + 7:], 'target:', 1), {_WS}), '|'), {_WS}) else '' end AS src,
  case when contains(n0, 'target:') then trim(n0[instr(n0, 'target:') + 7:], {_WS}) else '' end AS tgt FROM (SELECT *, coalesce(note, '') AS n0 FROM failures)"""


def signature_sql(x: str) -> str:
    """The error signature of a text, as one expression."""
    s = f"split_part({x}, 'Hint:', 1)"
    for p, r in ((r"Position: \d+", ""), (r"=\([^)]*\)", ""), ('"[^"]*"', '""')):
        s = f"regexp_replace({s}, '{p}', '{r}', 'g')"
    return f"left(trim({s}, {_WS}), 120)"


CATEGORY_SQL = f"""SELECT *, case category when 'mybatis_stmt_not_found' then 'E_비실행조각_TC오생성' when 'ognl_null_param' then 'C_테스트데이터_OGNL파라미터' when 'ognl_getter_missing' then 'C_테스트데이터_OGNL파라미터'
  when 'both_error_identical' then 'F_오탐_원본도동일실패' when 'source_only_error' then 'F_오탐_원본도동일실패' when 'target_data_out_of_range' then 'D_테스트데이터_값범위' when 'target_value_too_long' then 'D_테스트데이터_값범위'
  else case when starts_with(category, 'target_fn_missing') then 'A_미변환_Oracle함수' else 'B_변환결함_의심' end end AS grp, left(n0, 300) AS error
FROM (SELECT *, case when failure_type <> 'execution_error' then failure_type when contains(n0, 'Mapped Statements collection does not contain') then 'mybatis_stmt_not_found'
  when contains(n0, 'evaluated to a null value') or contains(n0, 'is null for method') then 'ognl_null_param' when contains(n0, 'no getter for property') then 'ognl_getter_missing'
  when src <> '' and tgt <> '' then case when {signature_sql('src')} = {signature_sql('tgt')} then 'both_error_identical' else 'both_error_differ' end
  when src <> '' then 'source_only_error' when tgt = '' then 'unknown'
  when contains(tgt, 'does not exist') and contains(tgt, 'function') then 'target_fn_missing:' || coalesce(nullif(regexp_extract(tgt, 'function (\\w+)\\(', 1), ''), 'unknown')
  when contains(tgt, 'does not exist') and contains(tgt, 'column') then 'target_column_missing' when contains(tgt, 'operator does not exist') then 'target_operator_type'
  when contains(tgt, 'invalid reference to FROM') then 'target_from_alias' when contains(tgt, 'out of range') then 'target_data_out_of_range' when contains(tgt, 'too long') then 'target_value_too_long' else 'target_other' end AS category FROM ({SIDES_SQL}))"""
NUMBER_SQL = "(ascii(left(grp, 1)) - 64)"

query("f01_note_sides", "tc_id:s source_side:s target_side:s", f"SELECT tc_id, src AS source_side, tgt AS target_side FROM ({SIDES_SQL})")(
    lambda t: t.failures.withColumn("n", F.coalesce("note", F.lit(""))).select("tc_id", X.source_side(c("n")).alias("source_side"), X.target_side(c("n")).alias("target_side")))
query("f02_error_signature", "tc_id:s signature:s", f"SELECT tc_id, {signature_sql('n0')} AS signature FROM ({SIDES_SQL})")(
    lambda t: t.failures.select("tc_id", X.error_signature(F.coalesce("note", F.lit(""))).alias("signature")))
query("f03_classify", "tc_id:s grp:s category:s", f"SELECT tc_id, grp, category FROM ({CATEGORY_SQL})")(
    lambda t: X.classified(t.failures).withColumnRenamed("group", "grp"))
query("f04_target_categories", "category:s n:i", f"SELECT category, count(*) AS n FROM ({CATEGORY_SQL}) WHERE starts_with(category, 'target_') GROUP BY 1")(
    lambda t: X.classified(t.failures).filter(c("category").startswith("target_")).groupBy("category").agg(F.count(F.lit(1)).alias("n")))
query("f05_group_numbers", "tc_id:s no:i", f"SELECT tc_id, {NUMBER_SQL} AS no FROM ({CATEGORY_SQL})")(
    lambda t: X.classified(t.failures).select("tc_id", X.group_number(c("group")).alias("no")))
query("f06_plan_summary", "total:i passed:i failed:i", f"SELECT count(*) AS total, count(*) FILTER (status <> 'failed') AS passed, count(*) FILTER (status = 'failed') AS failed FROM ({OUTCOMES_SQL})")(
    lambda t: X.plan_summary(R.outcomes(t.runs)))

_HIST_SQL = f"SELECT grp, category, count(*) AS n, min(seq) AS first_seq, arg_min(error, seq) FILTER (error <> '') AS first_error, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, min(seq)) AS rank FROM ({CATEGORY_SQL}) GROUP BY grp, category"
_members = lambda t: X.members_of(X.with_case_fields(t.failures, t.cases), t.fragment_catalogue)
query("f07_category_histogram", "grp:s category:s n:i rank:i", _HIST_SQL)(lambda t: X.category_histogram(_members(t)).withColumnRenamed("group", "grp"))
query("f07_plan_types", "no:i grp:s nature:s action:s n:i categories:i representative_category:s representative_error:s", f"""
SELECT {NUMBER_SQL} AS no, grp, ['변환결함', '변환결함 의심', '테스트데이터', '테스트데이터', 'TC생성 이슈', '오탐'][{NUMBER_SQL}] AS nature, ['repair', 'repair', 'tc_fix', 'tc_fix', 'tc_filter', 'none'][{NUMBER_SQL}] AS action,
  sum(n) AS n, count(*) AS categories, arg_min(category, rank) AS representative_category, left(coalesce(max(first_error) FILTER (rank = 1), ''), 200) AS representative_error FROM ({_HIST_SQL}) GROUP BY grp
""")(lambda t: X.plan_types(_members(t)).withColumnRenamed("group", "grp").withColumnRenamed("count", "n"))

_TYPES_SQL = "SELECT mapper, sql_id, coalesce(arg_min(statement_type, seq) FILTER (statement_type IN ('select', 'insert', 'update', 'delete')), arg_min(statement_type, seq)) AS statement_type FROM fragment_catalogue GROUP BY 1, 2"
query("f08_statement_types", "mapper:s sql_id:s statement_type:s", _TYPES_SQL)(lambda t: X.statement_types(t.fragment_catalogue))
_CASES_SQL = "SELECT f.tc_id, f.seq, case when f.mapper is null then m.mapper else f.mapper end AS mapper, case when f.mapper is null then m.sql_id else f.sql_id end AS sql_id, f.grp, f.category, f.error FROM ({src}) f LEFT JOIN cases m ON m.tc_id = f.tc_id".format(src=CATEGORY_SQL)
query("f09_case_fields", "tc_id:s mapper:s sql_id:s", _CASES_SQL)(lambda t: X.with_case_fields(t.failures, t.cases))
_FRAG_SQL = f"SELECT c.*, statement_type, c.mapper || '__' || statement_type || '__' || c.sql_id AS frag_id FROM ({_CASES_SQL}) c LEFT JOIN ({_TYPES_SQL}) y ON y.mapper = c.mapper AND y.sql_id = c.sql_id"
query("f10_fragment_ids", "tc_id:s statement_type:s frag_id:s", _FRAG_SQL)(lambda t: X.with_fragment(X.with_case_fields(t.failures, t.cases), t.fragment_catalogue))
query("f11_top_mappers", "grp:s mapper:s n:i", f"""
SELECT grp, mapper, n FROM (SELECT grp, coalesce(mapper, '?') AS mapper, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, min(seq)) AS rn FROM ({_FRAG_SQL}) GROUP BY 1, 2) WHERE rn <= 4
""")(lambda t: X.top_mappers(_members(t), 4).withColumnRenamed("group", "grp"))
_REPAIR = "grp IN ('A_미변환_Oracle함수', 'B_변환결함_의심') AND frag_id IS NOT NULL"
query("f12_worklist", "grp:s frag_id:s tc_id:s category:s error:s", f"""
SELECT grp, frag_id, tc_id, category, error FROM (SELECT *, row_number() OVER (PARTITION BY grp, frag_id ORDER BY seq) AS rn FROM ({_FRAG_SQL}) WHERE {_REPAIR} AND trim(error, {_WS}) <> '') WHERE rn = 1
""")(lambda t: X.worklist(_members(t)).withColumnRenamed("group", "grp"))
query("f12_worklist_of_type", "grp:s frag_id:s tc_id:s category:s error:s", f"""
SELECT grp, frag_id, tc_id, category, error FROM (SELECT *, row_number() OVER (PARTITION BY grp, frag_id ORDER BY seq) AS rn FROM ({_FRAG_SQL}) WHERE {_REPAIR} AND trim(error, {_WS}) <> '') WHERE rn = 1 AND grp = '{X.UNCONVERTED}' ORDER BY seq LIMIT 5
""")(lambda t: X.worklist(_members(t), 5, X.UNCONVERTED).withColumnRenamed("group", "grp"))
query("f12_without_error", "grp:s frag_id:s", f"SELECT grp, frag_id FROM ({_FRAG_SQL}) WHERE {_REPAIR} GROUP BY 1, 2 HAVING count(*) FILTER (trim(error, {_WS}) <> '') = 0")(
    lambda t: X.without_error(_members(t)).withColumnRenamed("group", "grp"))
query("f13_pending", "fragment_id:s status:s", "SELECT fragment_id, status FROM progress WHERE status <> 'success'")(
    lambda t: X.pending(t.progress, t.progress.filter(c("status") == "success")))
query("f14_retryable", "fragment_id:s retry_count:i", "SELECT fragment_id, retry_count FROM progress WHERE status = 'failed' AND retry_count < 3")(lambda t: X.retryable(t.progress))
query("f15_reset_by_status", "fragment_id:s status:s", "SELECT fragment_id, status FROM progress WHERE status IN ('failed', 'partial')")(
    lambda t: X.reset_by_status(t.progress, ["failed", "partial"]))
query("f15_reset_by_ids", "removed:i not_found:i kept:i", """
SELECT count(*) FILTER (retry_count = 1 AND status = 'success') AS removed, count(*) FILTER (retry_count = 1 AND status <> 'success') AS not_found, count(*) FILTER (retry_count <> 1 AND status = 'success') AS kept FROM progress
""")(lambda t: _reset_ids(t))
query("f15_reset_by_sql_id", "fragment_id:s", "SELECT fragment_id FROM progress WHERE sql_id IN (SELECT concat('q', l_orderkey) FROM lineitem WHERE l_returnflag = 'R')")(
    lambda t: X.reset_by_sql_id(t.progress, t.lineitem.filter(c("l_returnflag") == "R").select(F.concat(F.lit("q"), c("l_orderkey")).alias("sql_id"))))


def _reset_ids(t):
    done = t.progress.filter(c("status") == "success")
    left, counts = X.reset_by_ids(done, t.progress.filter(c("retry_count") == 1))
    return counts.withColumn("kept", F.lit(left.count()))
