import random
import re

import pytest
from pyspark.sql import functions as F

from cutover.operators import dictionary as D
from cutover.operators import names as N

c = F.col


@pytest.fixture(scope="module")
def tables(spark):
    users = spark.createDataFrame([(2, "bob", None), (1, "amy", True)], "user_id long, name string, active boolean").withColumn("since", F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05")))
    orders = spark.createDataFrame([(7, 12.5)], "order_id int, amount double").withColumn("amount", c("amount").cast("decimal(10,2)"))
    return {"Users": users, "orders": orders}


def test_dictionary(spark, tables):
    got = {r.key: r for r in D.build_dictionary(spark, tables).collect()}
    assert set(got) == {"users.user_id", "users.name", "users.active", "users.since", "orders.order_id", "orders.amount"}
    assert got["users.name"].sample_value == "amy" and got["users.name"].needs_cast is False and got["users.name"].cast_syntax is None
    assert got["orders.amount"].cast_syntax == "::NUMERIC" and (got["orders.amount"].numeric_precision, got["orders.amount"].numeric_scale) == (10, 2)
    assert got["users.since"].cast_syntax == "::TIMESTAMP" and got["users.since"].sample_value == "2024-01-02 03:04:05"
    assert got["users.active"].data_type == "boolean" and got["users.active"].needs_cast is False


def test_unreadable_and_empty_tables_have_no_sample(spark, tables):
    assert D.sample_row("t", tables["Users"], key="no_such_column") is None
    empty = {**tables, "none": tables["orders"].limit(0)}
    got = {r.key: r.sample_value for r in D.build_dictionary(spark, empty, {"Users": "no_such_column"}).collect()}
    assert got["none.amount"] is None and got["users.name"] is None and got["orders.order_id"] == "7"


def test_hints_and_tables(spark, tables):
    df = spark.createDataFrame([("char",), ("date",), ("bigint",), ("uuid",), ("point",)], "data_type string")
    got = {r.data_type: (r.needs_cast, r.cast_syntax, r.needs_trim) for r in D.with_hints(df).collect()}
    assert got == {"char": (False, None, True), "date": (True, "::DATE", False), "bigint": (True, "::BIGINT", False), "uuid": (False, None, False), "point": (False, None, False)}
    assert [(r.table_name, r.columns) for r in D.table_list(D.column_metadata(spark, tables)).collect()] == [("Users", 4), ("orders", 2)]


def test_lookup_and_decisions(spark, tables):
    fixed = spark.createDataFrame([("t.flag", "char", False, None, True, None, 1)], "key string, data_type string, needs_cast boolean, cast_syntax string, needs_trim boolean, sample_value string, char_max_length long")
    d = D.build_dictionary(spark, tables).select(fixed.columns).unionByName(fixed)
    refs = spark.createDataFrame([("F1", "a", "USERS.User_Id"), ("F1", "b", "users.name"), ("F1", "c", "x.y"), ("F1", "d", "T.flag"), ("F2", "e", "users.active"), ("F2", "f", "x.y"), ("F2", "g", "x.y")],
                                 "fragment_id string, variable string, ref string")
    plan = D.cast_plan(refs, d)
    got = {r.variable: r for r in plan.collect()}
    assert {v: r.cast_applied for v, r in got.items()} == {"a": "::BIGINT", "b": None, "c": None, "d": None, "e": None, "f": None, "g": None}
    assert got["c"].warning.endswith("x.y") and got["d"].warning.startswith("CHAR") and got["a"].warning is None and got["b"].warning is None
    assert got["e"].reason.startswith("boolean")
    assert {(r.fragment_id, r.binds) for r in D.plan_warnings(plan).collect()} == {("F1", 1), ("F2", 2)}


def test_coverage(spark, tables):
    d = D.build_dictionary(spark, tables)
    refs = spark.createDataFrame([("users.name", None), ("x.y", None), ("z", "table_inference_failed"), ("v.c", "view_column")], "ref string, hint string")
    covered = D.coverage(refs, d)
    s = D.coverage_summary(covered).first()
    assert (s.total, s.successful, s.failed, float(s.success_rate)) == (4, 1, 3, 25.0)
    assert {r.severity: r.n for r in D.coverage_by(covered, "severity").collect()} == {"high": 1, "critical": 1, "medium": 1}
    assert float(D.coverage_summary(covered.limit(0)).first().success_rate) == 0


def subset_by_definition(entries, text, cap):
    up = text.upper()
    present = {t.upper() for t, _ in entries if t.upper() in up}
    hits = [f"{t}.{col}".lower() for t, col in entries if col.upper() in up and (not present or t.upper() in present)]
    return [(k, len(hits) > cap) for k in hits[:cap]]


@pytest.mark.parametrize("cap", [400, 2])
def test_dictionary_subset(spark, cap):
    entries = [("orders", "id"), ("orders", "name"), ("orders", "total"), ("users", "id"), ("users", "name"), ("zzz", "id")]
    d = spark.createDataFrame([(t, col, i) for i, (t, col) in enumerate(entries)], "table_name string, column_name string, position long")
    texts = ["select id, name, total from Orders", "select Name from users join orders", "only id here", "nothing", "orders but no columns"]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, body string")
    got = {}
    for r in D.dictionary_subset(df, d, "n", "body", cap).collect():
        got.setdefault(r.n, set()).add((r.key, r.truncated))
    assert got == {i: set(x) for i, t in enumerate(texts) if (x := subset_by_definition(entries, t, cap))}


def test_object_counts(spark):
    df = spark.createDataFrame([("VIEW",), ("VIEW",), ("INDEX",)], "object_type string")
    assert {r.object_type: r.n for r in D.object_counts(df, ["VIEW", "TABLE"]).collect()} == {"VIEW": 2, "TABLE": 0}


def test_mentions_against_containment(spark):
    rng = random.Random(11)
    letters = "ab_$ .1é"
    names = ["A", "b", "ab", "a.b", "a b", "ORDER_ID", "order_id2", "straße", "x" * 40, "no-such", "..", "", None, "é1"] + ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(60)]
    texts = [None, "", "a.b", "A B ab", "my_ORDER_ID2;", "STRASSE", "y" + "x" * 50, "no such", "no-such"] + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {(r.k, r.name) for r in N.mentions(df, spark.createDataFrame([(n,) for n in names], "n string"), ["k"], "t", "n").collect()}
    spoken = {n.upper() for n in names if n and re.search(r"[\w$#]", n)}
    assert got == {(k, n) for k, t in enumerate(texts) if t for n in spoken if n in t.upper()}


def test_a_large_dictionary(spark):
    d = spark.range(100_000).select(F.concat(F.lit("tab_"), (F.col("id") / 20).cast("int")).alias("table_name"), F.concat(F.lit("col_"), F.col("id")).alias("column_name"), F.col("id").alias("position"))
    texts = spark.createDataFrame([(k, f"select col_{k * 20}, col_{k * 20 + 1}x from tab_{k} where {'lorem ipsum ' * 50}") for k in range(0, 5000, 50)], "k long, t string")
    found = D.dictionary_subset(texts, d, "k", "t")
    got = {}
    for r in found.collect():
        got.setdefault(r.k, set()).add(r.key)
    # every prefix of a number names a table and a column as well, as containment says
    for k in (0, 50, 1250, 4950):
        tables = {f"tab_{str(k)[:i]}" for i in range(1, len(str(k)) + 1)}
        columns = {f"col_{str(n)[:i]}" for n in (k * 20, k * 20 + 1) for i in range(1, len(str(n)) + 1)}
        assert got[k] == {f"{t}.{x}" for t in tables for x in columns if int(x[4:]) // 20 == int(t[4:])}
    plan = found._jdf.queryExecution().toString()
    assert len(plan) < 200_000 and "CartesianProduct" not in plan and "NestedLoop" not in plan


REFERENCES = [
    ("select o_date from orders where amount > 1", "amount", "orders.amount", None), ("select 1 from ORDERS", " Orders.AMOUNT ", "orders.amount", None),
    ("select 1 from orders join users", "id", None, "ambiguous_mapping"), ("select 1 from dual", "id", None, "ambiguous_mapping"),
    ("select 1 from dual", "amount", "orders.amount", None), ("select 1 from dual", "nothing", None, "table_inference_failed"),
    ("select 1 from users", "amount", None, "column_not_in_dictionary"), ("select 1 from users", "users.nothing", None, "column_not_in_dictionary"),
    ("select 1 from users", None, None, "column_inference_failed"), ("select 1 from users", "users.", None, "column_inference_failed"), ("x", "  ", None, "column_inference_failed"),
    ("select 1 from ${tab}", "nothing", None, "dynamic_table"), ("select 1 from ${tab} join users", "amount", None, "dynamic_table"), ("select 1 from ${tab} join users", "name", "users.name", None),
    ("select 1", "${tab}.amount", None, "dynamic_table"), ("select 1", "${column}", None, "column_inference_failed"), ("select 1 from v_sums", "V_Sums.total", None, "view_column"),
    ("update ${t} set x = 1", "id", None, "dynamic_table"), (None, "amount", "orders.amount", None), ("select 1", "app.orders.amount", "orders.amount", None),
]


def test_reasons_are_worked_out(spark):
    d = spark.createDataFrame([("Orders", "ID"), ("orders", "amount"), ("users", "id"), ("users", "name")], "table_name string, column_name string")
    fragments = spark.createDataFrame([(f"F{k}", t) for k, (t, *_) in enumerate(REFERENCES)], "fragment_id string, text string")
    binds = spark.createDataFrame([(f"F{k}", f"v{k}", r) for k, (_, r, *_) in enumerate(REFERENCES)] + [("no fragment", "w", "amount")], "fragment_id string, variable string, ref string")
    views = spark.createDataFrame([("v_sums",)], "view_name string")
    out = D.resolved(binds, fragments, d, views)
    got = {r.variable: (r.key, r.failure_reason) for r in out.collect()}
    assert got == {f"v{k}": (key, reason) for k, (_, _, key, reason) in enumerate(REFERENCES)} | {"w": ("orders.amount", None)}
    assert {r.failure_reason: r.severity for r in out.collect()} == {None: None} | {r: D.REASON_SEVERITY[r] for *_, r in REFERENCES if r}
    s = D.coverage_summary(out).first()
    assert (s.total, s.successful) == (21, 7) and sum(r.n for r in D.coverage_by(out, "failure_reason").collect()) == 14
    assert D.resolved(binds.limit(0), fragments, d).count() == 0


def test_mentions_shuffles_findings_only(spark, monkeypatch, capsys):
    """Whatever the texts' words, they are read where they lie; names go to the tasks in blocks."""
    monkeypatch.setattr(N, "BLOCK_NAMES", 3)
    names = ["on", "station", "sta tion", "o.on", "a_b$c", "ΣΟΦ", "x" * 70, "??", "b-c", "straße"]
    texts = ["Stations on", "sta tion", "staxtion", "no o.ON", "A_B$C\u00a0b-c", "σοφ ??", "-" * 50 + "x" * 71, "", None, "STRASSE on", "n\no"]
    df = spark.createDataFrame([(i % 10, t) for i, t in enumerate(texts)], "k long, t string")
    found = N.mentions(df, spark.createDataFrame([(n,) for n in names], "n string"), ["k"], "t", "n")
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 3
    upper = {n.upper() for n in names if n != "??"}
    assert {tuple(r) for r in found.collect()} == {(i % 10, n) for i, t in enumerate(texts) for n in upper if n in (t or "").upper()}
