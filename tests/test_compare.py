import pytest
from pyspark.sql import functions as F

from cutover.operators import compare as R
from cutover.operators import summary as S

c = F.col
RUN = dict(tc_id="t", raw_status="ok", error_message=None, source_skipped=False, target_skipped=False, skip_reason=None, source_success=True,
           target_success=True, source_error=None, target_error=None, source_rows=1, target_rows=1, columns_differ=False, value_mismatches=0,
           source_sampled=False, target_sampled=False, source_ms=5, target_ms=7)
SCHEMA = ("tc_id string, raw_status string, error_message string, source_skipped boolean, target_skipped boolean, skip_reason string, source_success boolean, "
          "target_success boolean, source_error string, target_error string, source_rows long, target_rows long, columns_differ boolean, value_mismatches long, "
          "source_sampled boolean, target_sampled boolean, source_ms long, target_ms long")


def judge(spark, *changes):
    rows = [tuple({**RUN, "tc_id": f"t{i}", **ch}.values()) for i, ch in enumerate(changes)]
    return R.outcomes(spark.createDataFrame(rows, SCHEMA)).orderBy("tc_id").collect()


def test_outcome_precedence(spark):
    got = judge(
        spark, {}, {"raw_status": "error"}, {"source_skipped": True, "source_success": False, "skip_reason": "procedure"},
        {"source_success": False, "source_error": "boom"}, {"source_success": False, "target_success": False, "target_error": "bad"},
        {"target_rows": 2, "columns_differ": True, "value_mismatches": 3}, {"columns_differ": True, "value_mismatches": 3}, {"value_mismatches": 3},
        {"source_sampled": True}, {"raw_status": "error", "error_message": "lost"})
    assert [r.status for r in got] == ["passed", "failed", "skipped", "failed", "failed", "failed", "failed", "failed", "passed", "failed"]
    assert [r.failure_type for r in got] == [None, "execution_error", None, "execution_error", "execution_error", "row_count_mismatch", "column_mismatch", "value_mismatch", None, "execution_error"]
    assert [r.severity for r in got] == [None, "high", None, "high", "high", "high", "critical", "medium", None, "high"]
    # the first finding names the type, later checks still set their flags; cells are not compared when columns differ
    assert (got[5].row_count_matched, got[5].columns_matched, got[5].values_matched) == (False, False, True)
    assert [got[i].note for i in (1, 2, 3, 4, 9)] == ["extraction/execution error", "procedure", "source: boom", "source: failed | target: bad", "lost"]
    assert "medium" in got[8].note
    # times stay for failed and skipped runs, not for runs that never started
    assert got[2].source_time_ms == 5 and got[3].target_time_ms == 7 and got[1].source_time_ms is None


def test_changed_rows_of_statements_count(spark):
    """Statements that change data compare by affected rows; a differing count is a finding."""
    assert judge(spark, {"source_rows": 3, "target_rows": 4})[0].failure_type == "row_count_mismatch"


def test_columns_and_counts(spark):
    a = spark.createDataFrame([(1, "x")], "ID long, Name string")
    b = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    assert R.column_check(a, b) == ([], [])
    assert R.column_check(a, b.withColumn("z", F.lit(1)).drop("name")) == (["name"], ["z"])
    assert tuple(R.row_count_check(a, b).first()) == (1, 2, 1, False)
    assert tuple(R.row_count_check(a.limit(0), b.limit(0)).first()) == (0, 0, 0, True)


def test_positional_cells(many_segments):
    s = many_segments.range(100).select(c("id").alias("k"), F.concat(F.lit("v"), c("id")).alias("V"))
    t = s.toDF("K", "v").withColumn("v", F.when(c("K") % 10 == 3, None).otherwise(c("v"))).limit(1000)
    cells = R.positional_cells(s, t, ["k"])
    got = R.shown(cells, 3).orderBy("row_index").collect()
    assert cells.count() == 10
    assert [(r.row_index, r.column, r.source_value, r.target_value) for r in got] == [(3, "V", "v3", None), (13, "V", "v13", None), (23, "V", "v23", None)]
    # a null source cell is seen as well
    assert R.positional_cells(t, s, ["K"]).count() == 10
    with pytest.raises(ValueError):
        R.positional_cells(s, t, [])


def test_keyed_diff_hot_repeated_key(spark):
    """A key holding a third of all rows is one finding, not a product of its copies."""
    hot = spark.range(3000).select(F.when(c("id") % 3 == 0, F.lit(-1)).otherwise(c("id")).alias("k"), c("id").alias("v"))
    got = R.keyed_diff(hot, hot, ["k"]).collect()
    assert [(r.k, r.change, r.source_value, r.target_value) for r in got] == [(-1, "duplicate_key", "1000 copies", "1000 copies")]


def test_keyed_diff_null_key_and_types(spark):
    s = spark.createDataFrame([(None, 1), (1, 5), (2, 6)], "k long, v int")
    t = spark.createDataFrame([(None, 1.0), (1, 5.5), (3, 1.0)], "K long, V double")
    got = {(r.k, r.change, r.column, r.source_value, r.target_value) for r in R.keyed_diff(s, t, ["k"]).collect()}
    assert got == {(1, "changed", "v", "5", "5.5"), (2, "missing_in_target", None, None, None), (3, "extra_in_target", None, None, None)}


def test_multiset_diff_counts_copies(spark):
    s = spark.createDataFrame([(1,), (1,), (1,), (2,)], "a long")
    t = spark.createDataFrame([(1,), (2,), (2,), (None,)], "a long")
    got = {(r.a, r.change, r.copies) for r in R.multiset_diff(s, t).collect()}
    assert got == {(1, "missing_in_target", 2), (2, "extra_in_target", 1), (None, "extra_in_target", 1)}


def test_samples(many_segments):
    df = many_segments.range(100).withColumnRenamed("id", "k")
    got = R.head_middle_tail(df, ["k"], head=5, middle=10, tail=5).orderBy("sample_index").collect()
    assert [r.k for r in got] == [*range(5), *range(5, 95, 9), *range(95, 100)]
    assert [r.sample_index for r in got] == list(range(20)) and got[0].total_rows == 100
    assert R.head_middle_tail(df, ["k"], 50, 10, 50).count() == 100
    kept = R.bounded(df, ["k"], 10)
    assert kept.count() == 10 and kept.first().sampled and kept.first().total_rows == 100
    low = R.sampled_match(df, df.select(F.when(c("k") % 9 == 5, -1).otherwise(c("k")).alias("k")), ["k"], 5, 10, 5).first()
    assert not low.matched and low.confidence == "low"
    same = R.sampled_match(df, df, ["k"], 5, 10, 5).first()
    assert same.matched and same.samples_compared == 20 and same.confidence == "medium"


def test_reconcile_many(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    t = spark.createDataFrame([(1, "a"), (3, "b")], "k long, v string")
    got = {r.tc_id: r for r in R.reconcile_many({"same": (s, s, ["k"]), "swapped": (s, t, ["k"]), "empty": (s.limit(0), s.limit(0), ["k"])}).collect()}
    assert got["same"].status == "passed" and got["empty"].status == "passed"
    assert got["swapped"].failure_type == "value_mismatch" and (got["swapped"].missing_rows, got["swapped"].extra_rows) == (1, 1)


def test_summary(spark):
    rows = [("a", "passed", None, None, 1, 1, None, 10, 5), ("b", "failed", "value_mismatch", "medium", 2, 2, "x\ny", 0, 5),
            ("c", "skipped", None, None, 0, 0, None, None, 5), ("d", "failed", "column_mismatch", "critical", 2, 5, None, 3, 2000)]
    out = spark.createDataFrame(rows, "tc_id string, status string, failure_type string, severity string, source_rows long, target_rows long, note string, source_time_ms long, target_time_ms long")
    s = S.status_summary(out).first()
    assert (s.total_test_cases, s.passed, s.failed, s.skipped, float(s.success_rate)) == (4, 1, 2, 1, 33.3)
    assert float(S.status_summary(out.filter("status = 'skipped'")).first().success_rate) == 0
    ex = {r.tc_id: r for r in S.failure_extract(out).collect()}
    assert ex["b"].note == "x y" and ex["d"].note == "" and ex["d"].row_diff == 3
    cases = spark.createDataFrame([("a", "q1", "ns", "M")], "tc_id string, sql_id string, namespace string, mapper string")
    t = S.timing_rows(out, cases).collect()
    assert [r.tc_id for r in t] == ["d", "b", "a"]
    assert t[1].ratio is None and float(t[2].ratio) == 0.5 and t[2].sql_id == "q1" and t[0].sql_id == "d" and t[0].mapper == ""
    assert S.timing_rollup(out).first().slow_queries == 1
    assert [r.tc_id for r in S.top_failures(out, 1).collect()] == ["d"]
    assert {r.status: float(r.share_pct) for r in S.shares(out, "status").collect()} == {"passed": 25.0, "failed": 50.0, "skipped": 25.0}
    log = spark.createDataFrame([("t", "loaded", True), ("u", "errored", True)], "table_name string, state string, task_ok boolean")
    assert S.load_outcome(log).first().failed and not S.load_outcome(log.limit(1)).first().failed and S.load_outcome(log.limit(1), 2).first().failed


def test_repeated_keys_as_multisets(spark):
    rows = [(1, "a", 1.5), (1, "a", 1.5), (1, "b", 2.0), (2, "c", None), (None, "d", 1.0), (None, "d", 1.0)]
    source = spark.createDataFrame(rows, "k long, v string, x double")
    same = source.selectExpr("k AS K", "v", "CAST(x AS DECIMAL(10, 2)) AS x")
    assert R.repeated_key_diff(source, same, ["k"]).count() == 0
    report = R.reconcile("t", source, same, ["k"]).first()
    assert (report.status, report.duplicate_keys) == ("passed", 2)
    other = spark.createDataFrame([(1, "a", 1.5), (1, "z", 2.0), (1, "b", 2.0), (2, "c", None), (None, "d", 1.0), (None, "d", 1.0)], "k long, v string, x double")
    assert {(r.k, r.v, r.change, r.copies) for r in R.repeated_key_diff(source, other, ["k"]).collect()} == {(1, "a", "missing_in_target", 1), (1, "z", "extra_in_target", 1)}
    assert R.reconcile("t", source, other, ["k"]).first().failure_type == "value_mismatch"


def test_empty_results_match(spark):
    none = spark.createDataFrame([], "k long, v string")
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    r = R.sampled_match(none, none, ["k"]).first()
    assert (r.matched, r.samples_compared, r.sample_match_rate) == (True, 0, None)
    r = R.sampled_match(none, one, ["k"]).first()
    assert (r.matched, r.row_count_matched, r.target_total_rows) == (False, False, 1)
