"""The sample application's tables, read through the given star schema.

Each entry pairs a Spark projection with the same projection in SQL.  Columns
the star schema lacks are derived row by row from columns it has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

TABLES: dict[str, tuple] = {}


def _table(name: str, source: str, columns: dict[str, tuple[str, str | None]]):
    """Columns: name -> (Spark expression, SQL expression when it differs)."""

    def read(t):
        return getattr(t, source).select(*(F.expr(spark).alias(c) for c, (spark, _) in columns.items()))

    body = "SELECT " + ", ".join(f"{sql or spark} AS {c}" for c, (spark, sql) in columns.items()) + f" FROM {source}"
    TABLES[name] = (read, body)


_table("customers", "customer", {
    "customer_id": ("c_custkey", None),
    "customer_name": ("c_name", None),
    "email": ("case when c_custkey % 5 <> 0 then concat(lower(replace(c_name, '#', '.')), '@example.com') end", None),
    "phone": ("case when c_custkey % 7 <> 0 then concat('010-', lpad(cast(c_custkey % 10000 as string), 4, '0'), '-', lpad(cast(c_nationkey as string), 4, '0')) end",
              "case when c_custkey % 7 <> 0 then concat('010-', lpad(cast(c_custkey % 10000 as varchar), 4, '0'), '-', lpad(cast(c_nationkey as varchar), 4, '0')) end"),
    "address": ("case when c_custkey % 3 <> 0 then concat('Nation ', c_nationkey) end", None),
    "customer_type": ("case c_mktsegment when 'FURNITURE' then 'P' when 'HOUSEHOLD' then 'P' when 'BUILDING' then null else 'B' end", None),
    "credit_limit": ("case when c_custkey % 11 <> 0 then cast(c_acctbal as decimal(12,2)) end", None),
    "birth_date": ("case when c_custkey % 13 <> 0 then date_add(date'1950-01-01', cast(c_custkey * 37 % 18000 as int)) end",
                   "case when c_custkey % 13 <> 0 then date '1950-01-01' + cast(c_custkey * 37 % 18000 as integer) end"),
    "memo": ("case when c_custkey % 4 <> 0 then c_mktsegment end", None),
    "reg_date": ("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 2000 as int), 0, 0, c_custkey % 86400)",
                 "timestamp '1995-01-01 00:00:00' + to_days(cast(c_custkey % 2000 as integer)) + to_seconds(c_custkey % 86400)"),
    "status": ("case c_nationkey % 3 when 0 then 'ACTIVE' when 1 then 'INACTIVE' else 'SUSPENDED' end", None),
})

_STATUS = (
    "case when o_orderstatus = 'F' then 'DELIVERED' when o_orderstatus = 'P' then 'PENDING' "
    "when o_orderpriority = '1-URGENT' then 'SHIPPED' when o_orderpriority like '3%' then 'CANCELLED' else 'CONFIRMED' end"
)
_table("shop_orders", "orders", {
    "order_id": ("o_orderkey", None),
    "customer_id": ("o_custkey", None),
    "order_date": ("cast(o_orderdate as date)", None),
    "ship_date": (f"case when ({_STATUS}) = 'DELIVERED' then date_add(cast(o_orderdate as date), 3) end",
                  f"case when ({_STATUS}) = 'DELIVERED' then cast(o_orderdate as date) + 3 end"),
    "total_amount": ("cast(o_totalprice as decimal(14,2))", None),
    "tax_amount": ("case when o_orderkey % 10 <> 0 then cast(round(cast(o_totalprice as decimal(14,2)) * cast(0.1 as decimal(2,1)), 2) as decimal(12,2)) end", None),
    "discount_rate": ("cast(o_orderkey % 4 as decimal(5,2))", None),
    "order_status": (_STATUS, None),
    "payment_method": ("case o_orderkey % 4 when 0 then 'CARD' when 1 then 'BANK' when 2 then 'CASH' end", None),
    "remarks": ("case when o_orderkey % 6 <> 0 then o_orderpriority end", None),
    "created_at": ("cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, 0, o_orderkey % 86400)", "o_orderdate + to_seconds(o_orderkey % 86400)"),
})

_table("order_items", "lineitem", {
    "order_id": ("l_orderkey", None),
    "item_seq": ("l_linenumber", None),
    "product_id": ("l_partkey", None),
    "supplier_id": ("l_suppkey", None),
    "quantity": ("cast(l_quantity as bigint)", None),
    "unit_price": ("cast(l_extendedprice as decimal(10,2))", None),
    "discount_amt": ("case when l_discount > 0 then cast(round(cast(l_extendedprice as decimal(10,2)) * cast(l_discount as decimal(4,2)), 2) as decimal(10,2)) end", None),
})

_table("products", "part", {
    "product_id": ("p_partkey", None),
    "product_name": ("p_name", None),
    "category": ("case p_type when 'ECONOMY' then 'ELEC' when 'SMALL' then 'FOOD' when 'MEDIUM' then 'CLOTH' when 'PROMO' then 'BOOK' when 'STANDARD' then 'HOME' end", None),
    "unit_price": ("cast(p_retailprice as decimal(10,2))", None),
    "weight": ("cast(p_size as double)", None),
    "product_code": ("encode(p_brand, 'utf-8')", "encode(p_brand)"),
    "description": ("case when p_size % 5 <> 0 then concat(p_brand, '   ', p_name) end", None),
    "is_active": ("case when p_size % 10 = 0 then 0 else 1 end", None),
    "created_date": ("date_add(date'2000-01-01', p_size)", "date '2000-01-01' + p_size"),
})

_table("employees", "supplier", {
    "employee_id": ("s_suppkey", None),
    "employee_name": ("s_name", None),
    "department": ("case when s_nationkey <> 24 then concat('D', lpad(cast(s_nationkey as string), 2, '0')) end",
                   "case when s_nationkey <> 24 then concat('D', lpad(cast(s_nationkey as varchar), 2, '0')) end"),
    "position_title": ("case s_suppkey % 4 when 0 then 'Director' when 1 then 'Manager' when 2 then 'Senior' end", None),
    "hire_date": ("date_add(date'1990-01-01', cast(s_suppkey * 31 % 3000 as int))", "date '1990-01-01' + cast(s_suppkey * 31 % 3000 as integer)"),
    "salary": ("cast(s_acctbal as decimal(12,2))", None),
    "commission_pct": ("case when s_suppkey % 3 <> 0 then cast(cast(s_suppkey % 30 as decimal(4,2)) / 100 as decimal(4,2)) end",
                       "case when s_suppkey % 3 <> 0 then cast((s_suppkey % 30) / 100.0 as decimal(4,2)) end"),
    "manager_id": ("case when s_suppkey > 0 then (s_suppkey - 1) div 4 end", "case when s_suppkey > 0 then (s_suppkey - 1) // 4 end"),
    "email": ("concat(lower(replace(s_name, '#', '.')), '@example.com')", None),
    "phone_ext": ("lpad(cast(s_suppkey % 10000 as string), 4, '0')", "lpad(cast(s_suppkey % 10000 as varchar), 4, '0')"),
})

_table("audit_log", "events", {
    "log_id": ("event_id", None),
    "table_name": ("case event_type when 'signup' then 'CUSTOMERS' when 'purchase' then 'ORDERS' else upper(event_type) end", None),
    "operation": ("case event_type when 'signup' then 'INSERT' else 'UPDATE' end", None),
    "old_value": ("case when event_id % 3 <> 0 then props end", None),
    "new_value": ("props", None),
    "changed_by": ("case when user_id % 5 <> 0 then concat('U', user_id) end", None),
    "changed_at": ("cast(ts as timestamp_ntz)", "ts"),
})


def _code_master(t):
    regions = t.region.selectExpr(
        "'REGION' as code_group", "cast(r_regionkey as string) as code_value", "r_name as code_name",
        "r_regionkey as sort_order", "'Y' as use_yn", "cast(null as string) as description")
    nations = t.nation.selectExpr(
        "'NATION' as code_group", "cast(n_nationkey as string) as code_value", "n_name as code_name",
        "n_regionkey as sort_order", "case when n_regionkey = 4 then 'N' else 'Y' end as use_yn", "concat('region ', n_regionkey) as description")
    return regions.unionByName(nations)


TABLES["code_master"] = (_code_master, (
    "SELECT 'REGION' AS code_group, cast(r_regionkey as varchar) AS code_value, r_name AS code_name, r_regionkey AS sort_order, 'Y' AS use_yn, cast(null as varchar) AS description FROM region "
    "UNION ALL SELECT 'NATION', cast(n_nationkey as varchar), n_name, n_regionkey, case when n_regionkey = 4 then 'N' else 'Y' end, concat('region ', n_regionkey) FROM nation"
))


# Inputs of the comparison and triage operators, derived row by row from the given tables.

_table("orders_target", "orders_kept", {
    "o_orderkey": ("o_orderkey", None),
    "o_custkey": ("o_custkey", None),
    "o_orderstatus": ("case when o_orderkey % 101 = 0 then null else o_orderstatus end", None),
    "o_totalprice": ("case when o_orderkey % 89 = 0 then o_totalprice + 1 else o_totalprice end", None),
    "o_orderdate": ("o_orderdate", None),
    "o_orderpriority": ("o_orderpriority", None),
})
# The target copy lost some rows on the way and got one row too many per 500.
TABLES["orders_kept"] = (
    lambda t: t.orders.filter("o_orderkey % 97 <> 0").unionAll(t.orders.filter("o_orderkey % 499 = 3").withColumn("o_orderkey", -F.col("o_orderkey"))),
    "SELECT * FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT * REPLACE (-o_orderkey AS o_orderkey) FROM orders WHERE o_orderkey % 499 = 3",
)

_table("lineitem_target", "lineitem", {
    **{x: (x, None) for x in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")},
    "l_extendedprice": ("case when l_orderkey % 89 = 0 then l_extendedprice + 1 else l_extendedprice end", None),
    **{x: (x, None) for x in ("l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")},
})

_K = ("cast(get_json_object(props, '$.k') as bigint)", "cast(json_extract_string(props, '$.k') as bigint)")
_table("runs", "events", {
    "tc_id": ("concat('tc_', event_id)", None),
    "seq": ("event_id", None),
    "mapper": ("concat('M', user_id % 7)", None),
    "sql_id": ("concat('q', user_id % 23)", None),
    "raw_status": ("case when event_type = 'error' and event_id % 5 = 0 then 'error' else 'ok' end", None),
    "error_message": ("case when event_id % 2 = 0 then 'statement could not be read' end", None),
    "source_skipped": ("event_type = 'signup' and event_id % 3 = 0", None),
    "target_skipped": ("event_type = 'signup' and event_id % 6 = 0", None),
    "skip_reason": ("case when event_type = 'signup' and event_id % 3 = 0 then 'procedure' end", None),
    "source_success": ("not (event_type = 'error' and event_id % 5 in (1, 2))", None),
    "target_success": ("not (event_type = 'error' and event_id % 5 in (2, 3))", None),
    "source_error": ("case when event_type = 'error' then concat('ORA-', event_id % 900) end", None),
    "target_error": ("case when event_type = 'error' and event_id % 4 > 0 then concat('ERROR: ', user_id, chr(10), 'line 2') end", None),
    "source_rows": (_K[0], _K[1]),
    "target_rows": (f"{_K[0]} + case when event_id % 11 = 0 then 1 else 0 end", f"{_K[1]} + case when event_id % 11 = 0 then 1 else 0 end"),
    "columns_differ": ("event_id % 17 = 0", None),
    "value_mismatches": ("case when event_id % 19 = 0 then user_id % 5 else 0 end", None),
    "source_sampled": ("event_id % 23 = 0", None),
    "target_sampled": ("event_id % 29 = 0", None),
    "source_ms": ("case when event_id % 13 = 0 then null else cast(floor(value) as bigint) end", None),
    "target_ms": (f"{_K[0]} * 2", f"{_K[1]} * 2"),
})

_table("cases", "events", {
    "tc_id": ("concat('tc_', event_id)", None),
    "sql_id": ("case when event_id % 10 <> 3 then concat('q', user_id % 23) end", None),
    "namespace": ("case when event_id % 10 <> 3 then concat('app.M', user_id % 7) end", None),
    "mapper": ("case when event_id % 10 <> 3 then concat('M', user_id % 7) end", None),
})

# One failure text per rule, with values that vary from row to row.
_NOTES = [
    "concat('Mapped Statements collection does not contain value for app.q', user_id)",
    "concat('The expression ids', user_id, ' evaluated to a null value.')",
    "concat('There is no getter for property named p', user_id)",
    "concat('source: ERROR: relation \"a', user_id, '\" is gone Position: ', event_id, ' | target: ERROR: relation \"b\" is gone Position: 1 Hint: look')",
    "concat('source: ORA-00942: table ', user_id, ' is missing | target: ERROR: syntax error')",
    "concat('source: ORA-01722: invalid number ', event_id, ' | ')",
    "concat('target: ERROR: function nvl', user_id % 3, '(integer) does not exist Hint: none')",
    "concat('target: ERROR: column c', user_id, ' does not exist')",
    "'target: ERROR: operator does not exist: text = integer'",
    "'target: ERROR: invalid reference to FROM-clause entry'",
    "concat('target: ERROR: integer out of range ', event_id)",
    "'target: ERROR: value too long for type character varying(10)'",
    "'target: something else'",
    "null",
]
_NOTE = "case event_id % 14 " + " ".join(f"when {i} then {n}" for i, n in enumerate(_NOTES)) + " end"
_table("failures", "events", {
    "tc_id": ("concat('tc_', event_id)", None),
    "seq": ("event_id", None),
    "mapper": ("case when event_id % 4 <> 0 then concat('M', user_id % 7) end", None),
    "sql_id": ("concat('q', user_id % 23)", None),
    "failure_type": ("case event_type when 'view' then 'value_mismatch' when 'purchase' then 'row_count_mismatch' when 'click' then null else 'execution_error' end", None),
    "note": (f"case when user_id % 6 = 5 or (event_type = 'view' and event_id % 2 = 0) then null else {_NOTE} end", None),
})

# Several statement kinds may share one id; seq is the order in the file.
_table("fragment_catalogue", "events", {
    "mapper": ("concat('M', user_id % 7)", None),
    "sql_id": ("concat('q', user_id % 23)", None),
    "statement_type": ("case when user_id % 23 < 3 then 'resultMap' when event_id % 3 = 0 then 'resultMap' when event_id % 3 = 1 then 'sql' when user_id % 2 = 0 then 'select' else 'update' end", None),
    "seq": ("event_id", None),
})

_table("progress", "orders", {
    "fragment_id": ("concat('M', o_custkey % 7, '__select__q', o_orderkey)", None),
    "sql_id": ("concat('q', o_orderkey)", None),
    "status": ("case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else case when o_custkey % 2 = 0 then 'partial' else 'skipped' end end", None),
    "retry_count": ("o_custkey % 5", None),
})

_table("load_log", "supplier", {
    "table_name": ("s_name", None),
    "state": ("case s_nationkey % 8 when 0 then 'loading' when 1 then 'queued' when 2 then 'errored' else 'loaded' end", None),
    "task_ok": ("s_acctbal > -1e9", None),
})

_DATA_TYPES = ["bigint", "integer", "numeric", "date", "timestamp without time zone", "char", "bpchar", "text", "varchar", "uuid", "bytea", "boolean"]
_table("typed_refs", "events", {
    "ref_id": ("event_id", None),
    "data_type": ("case event_id % 12 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(_DATA_TYPES)) + " end", None),
})

_REFS = ["Customer.C_NAME", "orders.o_totalprice", "ORDERS.O_ORDERDATE", "part.p_size", "orders.o_missing", "nowhere.at_all", "lineitem.l_quantity", "documents.text", "Supplier.s_suppkey", "o_totalprice"]
_table("binds", "events", {
    "ref_id": ("event_id", None),
    "fragment_id": ("concat('F', user_id)", None),
    "variable": ("concat('v', event_id % 10)", None),
    "ref": ("case event_id % 10 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(_REFS)) + " end", None),
    "hint": ("case when event_id % 10 = 9 then 'table_inference_failed' when event_id % 30 = 5 then 'view_column' when event_id % 30 = 15 then 'dynamic_table' end", None),
})

# Statements with one bind each, and what the bind is compared with: one per customer.
_CASES = [
    ("'select o_orderdate from orders where o_totalprice > 1'", "'o_totalprice'"), ("'select * from documents join labels using (doc_id)'", "'Doc_Id'"),
    ("concat('select 1 from $', '{tab} where x')", "'amount'"), ("concat('select ', c_custkey, ' from nowhere')", "'no_such_column'"), ("'select * from nation'", "''"),
    ("'select * from NATION'", "concat('n_missing', c_custkey)"), ("concat('select ', c_custkey)", "'Customer.C_NAME'"), ("'select 1 from dual'", "'text'"), ("'select 1 from dual'", "'p_brand'"),
    ("'select * from v_orders'", "'v_orders.total'"), ("'select * from lineitem, orders'", "concat('$', '{t}.o_orderkey')"), ("'select 1'", "'nowhere.at_all'"),
]
_table("bound_statements", "customer", {
    "fragment_id": ("concat('F', c_custkey)", None),
    "text": ("case c_custkey % 12 " + " ".join(f"when {i} then {t}" for i, (t, _) in enumerate(_CASES)) + " end", None),
    "ref": ("case c_custkey % 12 " + " ".join(f"when {i} then {r}" for i, (_, r) in enumerate(_CASES)) + " end", None),
})

# SQL text in a session replaces dollar-brace names by settings, hence the split literals.
# Mapper files around the whole text of each document; every tenth lacks a closing tag.
_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_CONTENT = (
    "concat('<mapper namespace=\"app.', source, '\"><!-- head --><resultMap id=\"rm\" type=\"x\"/>', "
    "'<select id=\"q', doc_id, '\" resultType=\"', lang, 'Map\" parameterType=\"map\">select 1 from t join u where note = ''', " + _ESC + ", ''' and a = #{userId, jdbcType=INTEGER} ', "
    "case when doc_id % 2 = 0 then '<if test=\"a != null\"> and b = #{range.min} and c = #{ total }</if><if test=\"d\"> and d = #{d}</if>' else '' end, "
    "case when doc_id % 3 = 0 then '<choose><when test=\"t == 1\">x = #{c}</when><when test=\"t == 2\">x = 2</when><otherwise>y = #{userId}</otherwise></choose>' else '' end, "
    "case when doc_id % 5 = 0 then '<foreach collection=\"ids\" item=\"i\">#{i}</foreach>' else '' end, "
    "case when doc_id % 7 = 0 then ' @app.util.Check@isEmpty(x) ' else '' end, 'order by $', '{sort.col} $', '{ DIR } #{sysdate} $', '{a.b,c}</select>', "
    "case when doc_id % 4 = 0 then '<update parameterType=\"com.app.Order\" resultType=\"LONG\">{call fix(#{userId})}</update>' else '' end, "
    "case when doc_id % 10 = 3 then '' else '</mapper>' end)"
)
_table("corpus", "documents", {
    "doc_id": ("doc_id", None),
    "file": ("concat('d', doc_id % 3, '/M', doc_id, '.xml')", None),
    "content": (_CONTENT, None),
})

# Statements of each kind, behind comments and blanks.
_STATEMENTS = [
    "concat('/* m.', doc_id, ' */ select ', text)", "concat('-- note', chr(10), '  insert into t values (', text, ')')", "concat('/* a */ /* b ** c */', chr(10), 'update t set x = ', text)",
    "concat('{call p', doc_id, '}')", "concat('begin ', text, ' end;')", "concat('with a as (select 1) insert into t select ', text)", "concat('with a as (select 1) select ', text)",
    "concat('/* never closed ', text)", "concat('-- only a comment ', doc_id)", "concat('exec p ', text)", "concat('merge into t ', text)", "text",
]
_KINDS = ["query", "dml", "dml", "procedure", "procedure", "dml", None, "query", "query", "procedure", "dml", None]
_table("statements", "documents", {
    "doc_id": ("doc_id", None),
    "statement": ("case doc_id % 12 " + " ".join(f"when {i} then {s}" for i, s in enumerate(_STATEMENTS)) + " end", None),
})

# Assessment trees of three levels, one per event.
_SJSON = {"k": "cast(get_json_object(props, '$.k') as int)", "type": "case event_type when 'view' then 'PACKAGE' when 'click' then 'TABLE' when 'error' then 'TRIGGER' else 'VIEW' end"}
TABLES["trees"] = (
    lambda t: t.events.select("event_id", F.expr(f"""to_json(named_struct('name', 'APP', 'statistic', named_struct('objectType', cast(null as string), 'countErrorNodes', ''), 'children', array(
      named_struct('name', concat('APP.PKG', user_id), 'statistic', named_struct('objectType', {_SJSON['type']}, 'countErrorNodes', case when {_SJSON['k']} % 7 = 0 then '' else cast({_SJSON['k']} % 3 as string) end,
          'messageActions', array(named_struct('code', cast({_SJSON['k']} % 50 + 1 as string), 'nodeName', 'n'), named_struct('code', cast({_SJSON['k']} % 13 + 1 as string), 'nodeName', 'n'))),
        'children', array(named_struct('name', concat('APP.PKG', user_id, '.P', event_id), 'statistic', named_struct('objectType', 'FUNCTION', 'countErrorNodes', cast(event_id % 4 as string)))))),
      'x', 1))""").alias("tree")),
    "SELECT event_id, user_id, cast(json_extract_string(props, '$.k') as int) AS k, case event_type when 'view' then 'PACKAGE' when 'click' then 'TABLE' when 'error' then 'TRIGGER' else 'VIEW' end AS ty FROM events",
)
TABLES["action_items"] = (
    lambda t: t.part.select(F.expr("concat('{\"', p_size, '\": {\"severityType\": \"', case when p_size % 4 = 0 then 'CRITICAL' else 'WARNING' end, '\"}, \"z', p_partkey, '\": \"text\"}')").alias("doc")),
    "SELECT DISTINCT cast(p_size as varchar) AS code, case when p_size % 4 = 0 then 'CRITICAL' else 'WARNING' end AS severity FROM part",
)
