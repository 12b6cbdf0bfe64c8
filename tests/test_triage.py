import pytest
from pyspark.sql import functions as F

from cutover.operators import triage as X

c = F.col
A, B, C, D, E_, G = (g for g, _, _ in X.GROUPS)


@pytest.mark.parametrize("note,kind,group,category", [
    ("anything", "value_mismatch", B, "value_mismatch"),
    ("Mapped Statements collection does not contain value for x", "execution_error", E_, "mybatis_stmt_not_found"),
    ("expression evaluated to a null value", None, C, "ognl_null_param"),
    ("source is null for method foo", "execution_error", C, "ognl_null_param"),
    ("There is no getter for property named 'x'", "", C, "ognl_getter_missing"),
    ('source: ERR "a" Position: 3 | target: ERR "b" Position: 9 Hint: x', "execution_error", G, "both_error_identical"),
    ("source: ERR one | target: ERR two", "execution_error", B, "both_error_differ"),
    ("source: ERR one | ", "execution_error", G, "source_only_error"),
    ("target: function nvl(integer) does not exist", "execution_error", A, "target_fn_missing:nvl"),
    ("target: the function does not exist", "execution_error", A, "target_fn_missing:unknown"),
    ("target: column x does not exist", "execution_error", B, "target_column_missing"),
    ("target: operator does not exist: a = b", "execution_error", B, "target_operator_type"),
    ("target: invalid reference to FROM-clause", "execution_error", B, "target_from_alias"),
    ("target: integer out of range", "execution_error", D, "target_data_out_of_range"),
    ("target: value too long for type", "execution_error", D, "target_value_too_long"),
    ("target: what", "execution_error", B, "target_other"),
    (None, None, B, "unknown"), ("", "execution_error", B, "unknown"),
])
def test_rules(spark, note, kind, group, category):
    r = X.classified(spark.createDataFrame([(note, kind)], "note string, failure_type string")).first()
    assert (r.group, r.category) == (group, category)


def test_signature_and_numbers(spark):
    r = spark.createDataFrame([('bad "x" key=(5) Position: 12 now Hint: try',)], "e string").select(X.error_signature(c("e")).alias("s")).first()
    assert r.s == 'bad "" key  now'
    groups = spark.createDataFrame([(g,) for g, _, _ in X.GROUPS] + [("?",)], "g string")
    assert [r.n for r in groups.select(X.group_number(c("g")).alias("n")).collect()] == [1, 2, 3, 4, 5, 6, 7]


MEMBER = "seq long, group string, category string, error string, frag_id string, tc_id string, mapper string, sql_id string, statement_type string"


def member(seq, group, category, error, frag="M__select__q"):
    return (seq, group, category, error, frag, f"t{seq}", "M", "q", "select")


def test_plan_types_tie_goes_to_first_seen(spark):
    rows = [member(3, B, "y", "late"), member(1, B, "x", ""), member(2, B, "y", ""), member(4, B, "x", "first x"), member(5, G, "z", "e")]
    got = X.plan_types(spark.createDataFrame(rows, MEMBER)).collect()
    assert [(r.no, r["count"], r.categories, r.representative_category, r.representative_error) for r in got] == [(2, 4, 2, "x", "first x"), (6, 1, 1, "z", "e")]
    assert got[0].action == "repair" and got[1].action == "none"


def test_worklist_prefers_rows_with_error(spark):
    rows = [member(1, B, "x", "  "), member(2, B, "x", "boom"), member(3, B, "x", "later"), member(4, B, "x", "", "F2"), member(5, C, "x", "no repair", "F3"), member(6, A, "x", "no id", None)]
    df = spark.createDataFrame(rows, MEMBER)
    assert [(r.frag_id, r.seq, r.error) for r in X.worklist(df).collect()] == [("M__select__q", 2, "boom")]
    assert [r.frag_id for r in X.without_error(df).collect()] == ["F2"]
    assert X.worklist(df, limit=1).count() == 1


def test_statement_type_prefers_executable(spark):
    cat = spark.createDataFrame([("M", "q", "resultMap", 1), ("M", "q", "select", 2), ("M", "q", "insert", 3), ("M", "r", "sql", 5), ("M", "r", "resultMap", 4)],
                                "mapper string, sql_id string, statement_type string, seq long")
    assert {r.sql_id: r.statement_type for r in X.statement_types(cat).collect()} == {"q": "select", "r": "resultMap"}
    cases = spark.createDataFrame([("t1", "M", "q"), ("t2", "M", "nope"), ("t3", None, "q")], "tc_id string, mapper string, sql_id string")
    assert {r.tc_id: r.frag_id for r in X.with_fragment(cases, cat).collect()} == {"t1": "M__select__q", "t2": None, "t3": None}


def test_case_fields(spark):
    details = spark.createDataFrame([("t1", "M", "q"), ("t2", None, "q"), ("t3", None, "q")], "tc_id string, mapper string, sql_id string")
    cases = spark.createDataFrame([("t1", "X", "y"), ("t2", "X", "y")], "tc_id string, mapper string, sql_id string")
    assert {r.tc_id: (r.mapper, r.sql_id) for r in X.with_case_fields(details, cases).collect()} == {"t1": ("M", "q"), "t2": ("X", "y"), "t3": (None, "q")}


def test_progress_selection(spark):
    p = spark.createDataFrame([("M__select__q1", "success", 0), ("M__select__aq1", "success", 0), ("M__sql__x__q1", "failed", 2), ("M___q1", "failed", 3), ("M__select__q2", "partial", 0)],
                              "fragment_id string, status string, retry_count int")
    done = p.filter("status = 'success'")
    ids = lambda df: sorted(r.fragment_id for r in df.collect())
    assert ids(X.pending(p, done)) == ["M___q1", "M__select__q2", "M__sql__x__q1"]
    assert ids(X.retryable(p)) == ["M__sql__x__q1"]
    assert ids(X.reset_by_status(p, ["failed", "partial"])) == ["M___q1", "M__select__q2", "M__sql__x__q1"]
    # exactly the rows whose id ends in "__q1", three underscores included
    assert ids(X.reset_by_sql_id(p, spark.createDataFrame([("q1",)], "sql_id string"))) == ["M___q1", "M__select__q1", "M__sql__x__q1"]
    left, counts = X.reset_by_ids(done, spark.createDataFrame([("M__select__q1",), ("gone",), ("gone",)], "fragment_id string"))
    assert ids(left) == ["M__select__aq1"] and tuple(counts.first()) == (1, 1)


def test_top_mappers(spark):
    rows = [(i, B, f"M{i % 12}" if i % 12 else None) for i in range(100)]
    got = X.top_mappers(spark.createDataFrame(rows, "seq long, group string, mapper string")).collect()
    assert len(got) == 8 and any(r.mapper == "?" for r in got)
