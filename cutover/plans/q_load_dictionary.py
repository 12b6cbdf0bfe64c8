"""Registered queries: bulk load, integrity and dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutover.operators import dictionary as D
from cutover.operators import integrity as I
from cutover.operators import load as L
from cutover.operators import summary as S
from cutover.plans.registry import query
from cutover.plans.sqltext import half_up
from cutover.session import owned_folder
from cutover.sources.footers import footer_table
from cutover.workload.common import assign_keys
from cutover.workload.order import next_item_seq

c = F.col
NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark", "labels", "embeddings"]
INTEGERS = {
    "customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "part": ["p_partkey", "p_size"],
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "supplier": ["s_suppkey", "s_nationkey"], "events": ["event_id", "user_id"],
    "documents": ["doc_id", "n_chars"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "benchmark": ["item_id"], "labels": ["doc_id", "quality", "toxic"],
    "embeddings": ["vec_id", "label"],
}


def tables(t, names=NAMES):
    """The given tables; vectors as whole thousandths, which both engines print alike."""
    found = {n: getattr(t, n) for n in names}
    if "embeddings" in found:
        found["embeddings"] = found["embeddings"].withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * 1000)))
    return found


def footed(t, names=NAMES):
    """The given tables in a form whose counts, minima and maxima come from file footers; vectors as in ``tables``."""
    found = {n: footer_table(t.spark, f"{t.folder}/{n}.parquet") for n in names}
    if "embeddings" in found:
        found["embeddings"] = found["embeddings"].withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * 1000)))
    return found


def _union(parts):
    return "\nUNION ALL ".join(parts)


query("l01_selected_tables", "table_name:s rows:i", _union(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in ("orders", "region", "supplier", "customer", "benchmark")))(
    lambda t: D.table_row_counts(tables(t, L.select_tables(t.spark, NAMES, "%R%", exclude=["part", "conv%"]))))

query("l02_lower_names", "c_custkey:i c_name:s c_acctbal:d", "SELECT c_custkey, c_name, c_acctbal FROM customer")(
    lambda t: L.lower_names(t.customer.toDF(*[x.upper() for x in t.customer.columns])))


def _load(t):
    root = owned_folder(t.spark, "load")
    upper = {n.upper(): d.toDF(*[x.upper() for x in d.columns]) for n, d in tables(t, ["customer", "orders", "lineitem"]).items()}
    log = L.full_load(upper, root)
    kept = D.table_row_counts({n.lower(): t.spark.read.parquet(f"{root}/{n.lower()}") for n in upper})
    return log.withColumn("table_name", F.lower("table_name")).withColumnRenamed("rows", "rows_written").join(kept, "table_name"), root


query("l03_full_load", "table_name:s state:s rows_written:i rows:i", _union(
    f"SELECT '{n}' AS table_name, 'loaded' AS state, count(*) AS rows_written, count(*) AS rows FROM {n}" for n in ("customer", "orders", "lineitem")))(lambda t: _load(t)[0])

# characters that fit into 4,096 bytes: bytes that begin one, less the last if it goes on behind the limit
_FITTING = """SELECT doc_id, text, strlen(text) > 4096 AS cut, CASE WHEN strlen(text) <= 4096 THEN length(text) ELSE
  len(list_filter(range(0, 4096), lambda i: substr(h, 2 * i + 1, 1) NOT IN ('8', '9', 'A', 'B'))) - CASE WHEN substr(h, 8193, 1) IN ('8', '9', 'A', 'B') THEN 1 ELSE 0 END END AS chars
  FROM (SELECT *, hex(encode(text)) AS h FROM documents)"""
query("l04_long_text_cut", "doc_id:i chars:i cut:b", f"SELECT doc_id, chars, cut FROM ({_FITTING})")(
    lambda t: L.cut_long_text(t.documents, "text", 4).select("doc_id", F.length("text").alias("chars"), c("text_cut").alias("cut")))
query("l04_cut_report", "n:i cut:i chars_lost:i longest_octets:i", f"""
SELECT count(text) AS n, count(*) FILTER (cut) AS cut, sum(length(text) - chars) AS chars_lost, max(strlen(text)) AS longest_octets FROM ({_FITTING})
""")(lambda t: L.cut_report(t.documents, "text", 4).withColumnRenamed("values", "n"))

_SCALE = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "part": ["p_retailprice"], "customer": ["c_acctbal"], "events": ["value"]}
query("l05_scale_zero_check", "table_name:s column_name:s n:i fractional:i safe:b", _union(
    f"SELECT '{n}' AS table_name, '{x}' AS column_name, count({x}) AS n, count(*) FILTER ({x} <> floor({x})) AS fractional, count(*) FILTER ({x} <> floor({x})) = 0 AS safe FROM {n}"
    for n, xs in _SCALE.items() for x in xs))(lambda t: L.union_all([L.scale_zero_check(n, getattr(t, n)) for n in _SCALE]).withColumnRenamed("rows", "n"))
query("l05_whole_numbers", "l_orderkey:i l_quantity:i", "SELECT l_orderkey, cast(l_quantity as bigint) AS l_quantity FROM lineitem")(
    lambda t: L.to_whole_numbers(t.lineitem, ["l_quantity"]))

query("l06_integer_candidates", "table_name:s column_name:s filled:i", _union(
    f"SELECT '{n}' AS table_name, '{x}' AS column_name, count({x}) AS filled FROM {n}" for n, xs in INTEGERS.items() for x in xs))(
    lambda t: L.union_all([L.unpivot_aggregates(d, n, L.integer_columns(d), {"filled": lambda x: F.count(x)}) for n, d in tables(t, list(INTEGERS)).items()]))
query("l07_overflow_check", "table_name:s column_name:s max_abs:i overflows:b", _union(
    f"SELECT '{n}' AS table_name, '{x}' AS column_name, max(abs({x})) AS max_abs, max(abs({x})) > 1200 AS overflows FROM {n}" for n, xs in INTEGERS.items() for x in xs))(
    lambda t: L.overflow_check(footed(t, list(INTEGERS)), 1200))


def _widened(t):
    check = L.overflow_check({"orders": t.orders}, 1200)
    wide, report = L.widen_overflowing(t.orders, check, "orders")
    types = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in wide.schema.fields if f.name in ("o_orderkey", "o_custkey")))
    return report.withColumn("types", F.lit(types)).withColumn("key_sum", F.lit(wide.agg(F.sum("o_orderkey")).first()[0]).cast("bigint"))


query("l08_widen_overflowing", "table_name:s checked:i widened:i failed:i columns:s types:s key_sum:i", """
SELECT 'orders' AS table_name, 2 AS checked, (k > 1200)::int + (u > 1200)::int AS widened, 0 AS failed, concat_ws(',', case when u > 1200 then 'o_custkey' end, case when k > 1200 then 'o_orderkey' end) AS columns,
  'o_custkey:' || case when u > 1200 then 'decimal(38,0)' else 'bigint' end || ',o_orderkey:' || case when k > 1200 then 'decimal(38,0)' else 'bigint' end AS types, s AS key_sum
FROM (SELECT max(abs(o_orderkey)) AS k, max(abs(o_custkey)) AS u, sum(o_orderkey) AS s FROM orders)
""")(_widened)

_FK = {
    "fk_orders_customer": ("orders", "customer", "o_custkey", "c_custkey"), "fk_lineitem_orders": ("lineitem", "orders_target", "l_orderkey", "o_orderkey"),
    "fk_lineitem_part": ("lineitem", "part", "l_partkey", "p_partkey"), "fk_employee_manager": ("employees", "employees", "manager_id", "employee_id"),
}
_FK_SQL = _union(f"""SELECT '{n}' AS constraint_name, count(DISTINCT k) AS orphan_keys, count(*) AS orphans,
  (SELECT coalesce(string_agg(k::varchar, ';' ORDER BY k), '') FROM (SELECT DISTINCT {f} AS k FROM {ch} WHERE {f} NOT IN (SELECT {pk} FROM {pa}) ORDER BY 1 LIMIT 5)) AS sample, count(*) = 0 AS holds
FROM (SELECT {f} AS k FROM {ch} WHERE {f} IS NOT NULL AND {f} NOT IN (SELECT {pk} FROM {pa}))""" for n, (ch, pa, f, pk) in _FK.items())
query("l09_foreign_keys", "constraint_name:s orphan_keys:i orphans:i sample:s holds:b", _FK_SQL)(
    lambda t: I.foreign_key_check({n: (getattr(t, ch), getattr(t, pa), [f], [pk]) for n, (ch, pa, f, pk) in _FK.items()}))
query("l09_orphan_keys", "l_orderkey:i child_rows:i", "SELECT l_orderkey, count(*) AS child_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders_target) GROUP BY 1")(
    lambda t: I.orphans(t.lineitem, t.orders_target, ["l_orderkey"], ["o_orderkey"]).withColumnRenamed("k0", "l_orderkey"))
query("s09_load_outcome", "loaded:i loading:i queued:i errored:i task_ok:b fk_failures:i failed:b", f"""
SELECT count(*) FILTER (state = 'loaded') AS loaded, count(*) FILTER (state = 'loading') AS loading, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'errored') AS errored, bool_and(task_ok) AS task_ok,
  any_value(fk) AS fk_failures, count(*) FILTER (state = 'errored') > 0 OR any_value(fk) > 0 OR NOT bool_and(task_ok) AS failed
FROM load_log, (SELECT count(*) AS fk FROM ({_FK_SQL}) WHERE NOT holds)
""")(lambda t: S.load_outcome(t.load_log, I.foreign_key_check({n: (getattr(t, ch), getattr(t, pa), [f], [pk]) for n, (ch, pa, f, pk) in _FK.items()})))


def _key_sql(table, keys):
    null = " OR ".join(f"{k} IS NULL" for k in keys)
    ks = ", ".join(keys)
    return f"""SELECT '{table}' AS table_name, sum(n) AS n, count(*) FILTER (n > 1 AND NOT nul) AS repeated_keys, coalesce(sum(n) FILTER (n > 1 AND NOT nul), 0) AS rows_in_repeated_keys, coalesce(sum(n) FILTER (nul), 0) AS null_keys,
      count(*) FILTER (n > 1 OR nul) = 0 AS holds FROM (SELECT {ks}, count(*) AS n, bool_or({null}) AS nul FROM {table} GROUP BY {ks})"""


_KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "orders_target": ["o_orderstatus", "o_orderpriority"]}
query("l10_key_checks", "table_name:s n:i repeated_keys:i rows_in_repeated_keys:i null_keys:i holds:b", _union(_key_sql(n, k) for n, k in _KEYS.items()))(
    lambda t: L.union_all([I.key_check(getattr(t, n), k).withColumn("table_name", F.lit(n)).withColumnRenamed("rows", "n") for n, k in _KEYS.items()]))

query("l11_value_checks", "check_name:s violations:i holds:b", """
SELECT 'status' AS check_name, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS violations, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 AS holds FROM orders_target
UNION ALL SELECT 'price', count(*) FILTER (o_totalprice <= 1000), count(*) FILTER (o_totalprice <= 1000) = 0 FROM orders_target
UNION ALL SELECT 'priority', count(*) FILTER (o_orderpriority NOT LIKE '_-%'), count(*) FILTER (o_orderpriority NOT LIKE '_-%') = 0 FROM orders_target
""")(lambda t: I.value_checks(t.orders_target, {"status": c("o_orderstatus").isin("F", "O"), "price": c("o_totalprice") > 1000, "priority": c("o_orderpriority").like("_-%")}))

query("l12_defaults_and_computed", "order_id:i item_seq:i product_id:i discount_amt:d line_total:d", """
SELECT order_id, item_seq, product_id, coalesce(discount_amt, 0) AS discount_amt, quantity * unit_price - coalesce(discount_amt, 0) AS line_total FROM order_items
""")(lambda t: L.with_defaults(t.order_items, {"discount_amt": F.lit(0)}, {"line_total": c("quantity") * c("unit_price") - c("discount_amt")}))

_SEQ_SOURCE = "SELECT concat('SEQ_S', l_suppkey) AS sequence_name, max(l_orderkey) AS last_number FROM lineitem GROUP BY l_suppkey"


def _sequences(t):
    source = t.lineitem.groupBy(F.concat(F.lit("SEQ_S"), c("l_suppkey")).alias("sequence_name")).agg(F.max("l_orderkey").alias("last_number"))
    target = t.supplier.filter(c("s_nationkey") != 7).select(
        F.concat(F.lit("seq_s"), c("s_suppkey")).alias("sequence_name"), F.expr("case when s_nationkey = 3 then 1000000000 else 1 end").alias("min_value"),
        F.expr("case when s_nationkey > 12 then s_suppkey * 10 + 2 else 2000000000 end").alias("max_value"))
    return I.sequence_sync(source, target)


_SEQ_SQL = f"""SELECT sequence_name, case when s_suppkey is not null and clamp then mn else last_number end AS last_number, case when s_suppkey is null then 'MISSING_IN_TARGET' when clamp then 'SYNCED_CLAMPED' else 'SYNCED' end AS status
FROM (SELECT *, last_number > mx or last_number < mn AS clamp FROM ({_SEQ_SOURCE}) q LEFT JOIN
  (SELECT s_suppkey, case when s_nationkey = 3 then 1000000000 else 1 end AS mn, case when s_nationkey > 12 then s_suppkey * 10 + 2 else 2000000000 end AS mx FROM supplier WHERE s_nationkey <> 7) b ON sequence_name = concat('SEQ_S', s_suppkey))"""
query("l13_sequence_sync", "sequence_name:s last_number:i status:s", _SEQ_SQL)(_sequences)
query("l13_sequence_totals", "source_count:i synced:i clamped:i missing_in_target:i", f"""
SELECT count(*) AS source_count, count(*) FILTER (status <> 'MISSING_IN_TARGET') AS synced, count(*) FILTER (status = 'SYNCED_CLAMPED') AS clamped, count(*) FILTER (status = 'MISSING_IN_TARGET') AS missing_in_target FROM ({_SEQ_SQL})
""")(lambda t: I.sequence_totals(_sequences(t)))

query("l14_surrogate_keys", "new_key:i c_custkey:i c_acctbal:d", """
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS new_key, c_custkey, c_acctbal FROM customer
""")(lambda t: assign_keys(t.customer, [("c_acctbal", "desc"), "c_custkey"], "new_key", t.orders.select(c("o_orderkey").alias("new_key"))))

query("l15_next_sequence_per_parent", "order_id:i n:i item_seq:i", """
SELECT o_orderkey AS order_id, n, coalesce(top, 0) + n AS item_seq FROM (SELECT o_orderkey, unnest([1, 2, 3]) AS n FROM orders) LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")(lambda t: next_item_seq(t.order_items, t.orders.select(c("o_orderkey").alias("order_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n")), ["n"]))

# ---- dictionary ---------------------------------------------------------------
TYPE_SQL = "case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'integer' when 'DOUBLE' then 'double precision' when 'FLOAT[]' then 'array<bigint>' when 'VARCHAR' then 'text' else 'timestamp without time zone' end"
META_SQL = f"SELECT table_name, column_name, ordinal_position AS position, {TYPE_SQL} AS data_type FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in NAMES)})"
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars", "pages": "page_id url html", "conversations": "conv_id turn role text",
    "benchmark": "item_id text", "labels": "doc_id quality toxic", "embeddings": "vec_id embedding label",
}


def _metadata(t):
    filled = L.union_all([L.unpivot_aggregates(d, n, d.columns, {"filled": lambda x: F.count(x)}) for n, d in tables(t).items()])
    return D.column_metadata(t.spark, tables(t)).join(filled, ["table_name", "column_name"])


query("d01_column_metadata", "table_name:s column_name:s position:i data_type:s filled:i", f"""
SELECT m.*, filled FROM ({META_SQL}) m JOIN ({_union(f"SELECT '{n}' AS table_name, '{x}' AS column_name, count({x}) AS filled FROM {n}" for n, xs in COLUMNS.items() for x in xs.split())}) f
  ON m.table_name = f.table_name AND m.column_name = f.column_name
""")(_metadata)
query("d02_table_list", "table_name:s columns:i rows:i", _union(f"SELECT '{n}' AS table_name, {len(xs.split())} AS columns, count(*) AS rows FROM {n}" for n, xs in COLUMNS.items()))(
    lambda t: D.table_list(D.column_metadata(t.spark, tables(t))).join(D.table_row_counts(tables(t)), "table_name"))


def _source(n):
    return "(SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 1000::float) AS BIGINT)) AS embedding, label FROM embeddings)" if n == "embeddings" else n


def _text(row, x):
    return f"replace({row}.{x}::varchar, ' ', '')" if x == "embedding" else f"{row}.{x}::varchar"


_SAMPLES = _union(f"SELECT '{n}' AS table_name, '{x}' AS column_name, {_text('x', x)} AS sample_value FROM (SELECT min(t) AS x FROM {_source(n)} AS t)" for n in NAMES for x in COLUMNS[n].split())
query("d03_sample_rows", "table_name:s column_name:s sample_value:s", _SAMPLES)(lambda t: L.union_all([D.sample_row(n, d) for n, d in footed(t).items()]))

_HINT = """SELECT x.*, coalesce(s is not null, false) AS needs_cast, s AS cast_syntax, data_type in ('character', 'char', 'bpchar') AS needs_trim FROM (SELECT *, case data_type when 'smallint' then '::SMALLINT' when 'integer' then '::INTEGER' when 'bigint' then '::BIGINT'
  when 'numeric' then '::NUMERIC' when 'decimal' then '::NUMERIC' when 'real' then '::REAL' when 'double precision' then '::DOUBLE PRECISION' when 'date' then '::DATE' when 'timestamp without time zone' then '::TIMESTAMP' end AS s FROM ({src})) x"""
query("d04_cast_hints", "ref_id:i data_type:s needs_cast:b cast_syntax:s needs_trim:b", _HINT.format(src="SELECT * FROM typed_refs"))(lambda t: D.with_hints(t.typed_refs))
_DICT_SQL = _HINT.format(src=f"SELECT m.*, sample_value, lower(m.table_name || '.' || m.column_name) AS key FROM ({META_SQL}) m LEFT JOIN ({_SAMPLES}) f ON m.table_name = f.table_name AND m.column_name = f.column_name")
_dictionary = lambda t: D.build_dictionary(t.spark, footed(t))
query("d05_dictionary", "key:s table_name:s column_name:s position:i data_type:s sample_value:s sample_found:b needs_cast:b cast_syntax:s needs_trim:b", f"SELECT *, true AS sample_found FROM ({_DICT_SQL})")(_dictionary)
query("d06_sample_text", "event_id:i as_text:s", "SELECT event_id, concat_ws('|', event_id::varchar, strftime(ts, '%Y-%m-%d %H:%M:%S'), value::decimal(12,2)::varchar, (user_id > 70)::varchar) AS as_text FROM events")(
    lambda t: t.events.select("event_id", F.concat_ws("|", *(D.cell_text(x, y) for x, y in (
        (c("event_id"), t.events.schema["event_id"].dataType), (F.date_trunc("second", c("ts")).cast("timestamp_ntz"), t.events.schema["ts"].dataType),
        (c("value").cast("decimal(12,2)"), t.events.schema["value"].dataType), (c("user_id") > 70, t.events.schema["props"].dataType)))).alias("as_text")))

_FOUND = f"SELECT b.*, d.data_type, d.sample_value, d.cast_syntax, d.needs_trim, d.key IS NOT NULL AS found FROM binds b LEFT JOIN ({_DICT_SQL}) d ON d.key = lower(b.ref)"
query("d07_lookup", "ref_id:i ref:s found:b data_type:s sample_value:s", _FOUND)(lambda t: D.lookup(t.binds, _dictionary(t)))
_DECIDED = f"""SELECT *, case when found and data_type not in ('text') then cast_syntax end AS cast_applied,
  case when not found then '딕셔너리에 없는 컬럼 (캐스팅 생략, 수동 검토 권장)' when data_type = 'text' then '문자열 타입, 캐스팅 불필요' else data_type || ' 타입, 명시적 캐스팅 필요' end AS reason,
  case when not found then '컬럼을 딕셔너리에서 찾을 수 없음: ' || ref end AS warning FROM ({_FOUND})"""
query("d08_cast_decisions", "ref_id:i ref:s cast_applied:s reason:s warning:s", _DECIDED)(lambda t: D.cast_decisions(t.binds, _dictionary(t)))
query("d09_cast_plan", "fragment_id:s variable:s ref:s data_type:s cast_applied:s reason:s warning:s", _DECIDED)(lambda t: D.cast_plan(t.binds, _dictionary(t)))
query("d09_plan_warnings", "fragment_id:s warning:s binds:i", f"SELECT fragment_id, warning, count(*) AS binds FROM ({_DECIDED}) WHERE warning IS NOT NULL GROUP BY 1, 2")(
    lambda t: D.plan_warnings(D.cast_plan(t.binds, _dictionary(t))))

_WORDS = "SELECT table_name, column_name, lower(table_name || '.' || column_name) AS key FROM (VALUES " + ", ".join(
    f"('{n}', '{x}')" for n, xs in COLUMNS.items() for x in xs.split()) + ", ('on', 'in'), ('on', 'the'), ('was', 'hand'), ('la', 'tion')) AS v(table_name, column_name)"


def _word_dictionary(t):
    """The given tables' columns and a few short names that do occur in prose."""
    extra = t.spark.createDataFrame([("on", "in", 1), ("on", "the", 2), ("was", "hand", 1), ("la", "tion", 1)], "table_name string, column_name string, position long")
    return D.column_metadata(t.spark, tables(t)).select("table_name", "column_name", "position").unionByName(extra)


query("d10_dictionary_subset", "doc_id:i key:s truncated:b", f"""
WITH d AS ({_WORDS}), f AS (SELECT doc_id, u, len(list_filter((SELECT list(DISTINCT upper(table_name)) FROM d), lambda x: contains(u, x))) AS n FROM (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS u FROM documents))
SELECT doc_id, key, false AS truncated FROM f, d WHERE contains(u, upper(column_name)) AND (n = 0 OR contains(u, upper(table_name)))
""")(lambda t: D.dictionary_subset(t.documents, _word_dictionary(t), "doc_id", "text"))

_COVER = f"""SELECT *, case failure_reason when 'column_not_in_dictionary' then 'high' when 'table_inference_failed' then 'critical' when 'view_column' then 'medium' when 'dynamic_table' then 'critical' end AS severity
FROM (SELECT *, case when not found then coalesce(hint, 'column_not_in_dictionary') end AS failure_reason FROM ({_FOUND}))"""
_covered = lambda t: D.coverage(t.binds, _dictionary(t))
query("d11_coverage", "ref_id:i found:b failure_reason:s severity:s", _COVER)(_covered)
query("d11_coverage_summary", "total:i successful:i failed:i success_rate:d", f"""
SELECT t AS total, s AS successful, t - s AS failed, {half_up('s * 100', 't', 1)} AS success_rate FROM (SELECT CAST(count(*) AS HUGEINT) AS t, CAST(count(*) FILTER (found) AS HUGEINT) AS s FROM ({_COVER}))
""")(lambda t: D.coverage_summary(_covered(t)))
query("d11_coverage_by_reason", "failure_reason:s n:i", f"SELECT failure_reason, count(*) AS n FROM ({_COVER}) WHERE NOT found GROUP BY 1")(lambda t: D.coverage_by(_covered(t), "failure_reason"))
query("d11_coverage_by_severity", "severity:s n:i", f"SELECT severity, count(*) AS n FROM ({_COVER}) WHERE NOT found GROUP BY 1")(lambda t: D.coverage_by(_covered(t), "severity"))

# by definition: every statement against every table of the dictionary
_RESOLVED = f"""
WITH e AS (SELECT DISTINCT table_name AS t, column_name AS col FROM ({META_SQL})), s AS (SELECT *, lower(trim(ref)) AS r FROM bound_statements),
p AS (SELECT *, CASE WHEN contains(r, '.') THEN string_split(r, '.')[1] END AS t, CASE WHEN contains(r, '.') THEN string_split(r, '.')[2] ELSE r END AS col,
  contains(r, '$' || '{{') AS dyn, regexp_matches(text, '(?i)\\b(from|join|into|update|table)\\s+\\$\\{{') AS fdyn,
  (SELECT count(DISTINCT e.t) FROM e WHERE contains(upper(s.text), upper(e.t))) AS named FROM s),
q AS (SELECT *, (SELECT count(*) FROM e WHERE e.col = p.col AND contains(upper(p.text), upper(e.t))) AS n_here, (SELECT min(e.t || '.' || e.col) FROM e WHERE e.col = p.col AND contains(upper(p.text), upper(e.t))) AS key_here,
  (SELECT count(*) FROM e WHERE e.col = p.col) AS n_any, (SELECT min(e.t || '.' || e.col) FROM e WHERE e.col = p.col) AS key_any, (SELECT min(e.t || '.' || e.col) FROM e WHERE e.col = p.col AND e.t = p.t) AS key_full FROM p),
v AS (SELECT *, CASE WHEN col = '' OR (dyn AND t IS NULL) THEN 'column_inference_failed' WHEN dyn THEN 'dynamic_table'
  WHEN t IS NOT NULL THEN CASE WHEN key_full IS NOT NULL THEN NULL WHEN t = 'v_orders' THEN 'view_column' ELSE 'column_not_in_dictionary' END
  WHEN n_here = 1 OR (named = 0 AND n_any = 1) THEN NULL WHEN n_here > 1 THEN 'ambiguous_mapping' WHEN fdyn THEN 'dynamic_table' WHEN named = 0 AND n_any > 1 THEN 'ambiguous_mapping'
  WHEN named = 0 THEN 'table_inference_failed' ELSE 'column_not_in_dictionary' END AS failure_reason FROM q)
SELECT fragment_id, failure_reason IS NULL AS found, CASE WHEN failure_reason IS NULL THEN coalesce(key_full, CASE WHEN n_here = 1 THEN key_here ELSE key_any END) END AS key, failure_reason,
  CASE failure_reason WHEN 'column_not_in_dictionary' THEN 'high' WHEN 'ambiguous_mapping' THEN 'medium' WHEN 'view_column' THEN 'medium' ELSE CASE WHEN failure_reason IS NOT NULL THEN 'critical' END END AS severity FROM v"""
query("d11_resolved_references", "fragment_id:s found:b key:s failure_reason:s severity:s", _RESOLVED)(lambda t: D.resolved(
    t.bound_statements.select("fragment_id", "ref"), t.bound_statements.select("fragment_id", "text"), D.column_metadata(t.spark, tables(t)),
    t.spark.createDataFrame([("v_orders",)], "view_name string")))
query("d12_object_counts", "object_type:s n:i", """
SELECT o AS object_type, count(event_id) AS n FROM (SELECT unnest(['view', 'click', 'error', 'trigger']) AS o) LEFT JOIN events ON event_type = o GROUP BY 1
""")(lambda t: D.object_counts(t.events.select(c("event_type").alias("object_type")), ["view", "click", "error", "trigger"]))
query("d12_row_counts", "table_name:s rows:i", _union(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in NAMES))(lambda t: D.table_row_counts(footed(t)))
