from decimal import Decimal

from pyspark.sql import functions as F

from cutover.operators import integrity as I
from cutover.operators import load as L

c = F.col


def test_selection_and_names(spark):
    assert L.select_tables(spark, ["ORDERS", "order_items", "users"], "order%") == ["ORDERS", "order_items"]
    assert L.select_tables(spark, ["ORDERS", "order_items"], exclude=["%items"]) == ["ORDERS"]
    assert L.lower_names(spark.createDataFrame([(1,)], "ABC int")).columns == ["abc"]


def test_long_text(spark):
    df = spark.createDataFrame([("a" * 1024,), ("é" * 1025,), (None,), ("a" + "é" * 600,)], "t string")
    got = L.cut_long_text(df, "t", 1).collect()
    assert [(r.t_cut, len(r.t) if r.t else None) for r in got] == [(False, 1024), (True, 512), (False, None), (True, 512)]
    assert got[3].t == "a" + "é" * 511
    assert tuple(L.cut_report(df, "t", 1).first()) == (3, 2, 513 + 89, 2050)


def test_scale_zero(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, None)], "a double, b double")
    assert {r.column_name: (r.fractional, r.safe) for r in L.scale_zero_check("t", df).collect()} == {"a": (0, True), "b": (1, False)}
    assert L.to_whole_numbers(df, ["a"]).first().a == Decimal(1)


def test_overflow_takes_the_smallest_long(spark):
    df = spark.createDataFrame([(-(2**63), 5, None), (1, 7, None)], "a long, b int, n long")
    check = L.overflow_check({"t": df})
    assert {r.column_name: (int(r.max_abs), r.overflows) for r in check.collect()} == {"a": (2**63, True), "b": (7, False)}
    wide, report = L.widen_overflowing(df, check, "t")
    assert wide.schema["a"].dataType.simpleString() == "decimal(38,0)" and wide.schema["b"].dataType.simpleString() == "int"
    assert tuple(report.first()) == ("t", 2, 1, 0, "a")
    # a column the source does not have is skipped
    assert L.overflow_check({"t": df}, columns={"t": ["B", "gone"]}).count() == 1


def test_full_load_logs_failures_and_can_run_again(spark, tmp_path):
    good = spark.createDataFrame([(1,), (2,)], "ID long")
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    for _ in range(2):
        log = {r.table_name: r for r in L.full_load({"GOOD": good, "BAD": bad}, str(tmp_path)).collect()}
    assert (log["GOOD"].state, log["GOOD"].rows) == ("loaded", 2) and log["BAD"].state == "errored" and "broken" in log["BAD"].error
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/good").collect()) == [1, 2]


def test_defaults(spark):
    df = spark.createDataFrame([(2, 3, None), (2, 3, 1)], "q int, p int, d int")
    got = L.with_defaults(df, {"d": F.lit(0)}, {"total": c("q") * c("p") - c("d")}).collect()
    assert [r.total for r in got] == [6, 5]


def test_foreign_keys_with_a_hot_orphan(spark):
    child = spark.range(3000).select(F.when(c("id") % 3 == 0, F.lit(99)).when(c("id") % 3 == 1, F.lit(None)).otherwise(F.lit(1)).cast("long").alias("fk"))
    parent = spark.createDataFrame([(1,), (2,)], "pk long")
    r = I.foreign_key_check({"x": (child, parent, ["fk"], ["pk"]), "y": (parent, parent, ["pk"], ["pk"])}).collect()
    got = {x.constraint_name: (x.orphan_keys, x.orphans, x.sample, x.holds) for x in r}
    assert got == {"x": (1, 1000, "99", False), "y": (0, 0, "", True)}
    two = spark.createDataFrame([(1, 2), (1, 3), (None, 9)], "a long, b long")
    assert I.foreign_key_check({"z": (two, two.filter("b = 2"), ["a", "b"], ["a", "b"])}).first().sample == "1/3"


def test_keys_and_values(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b")], "k long, v string")
    assert tuple(I.key_check(df, ["k"]).first()) == (4, 1, 2, 0, False)
    assert tuple(I.key_check(df, ["k", "v"]).first()) == (4, 1, 2, 1, False)
    assert I.key_check(df.limit(0), ["k"]).first().holds
    got = {r.check_name: (r.violations, r.holds) for r in I.value_checks(df, {"known": c("v").isin("a"), "low": c("k") < 5}).collect()}
    assert got == {"known": (1, False), "low": (0, True)}  # null passes


def test_sequences(spark):
    src = spark.createDataFrame([("SEQ_A", 50), ("SEQ_CYCLE", 1000), ("SEQ_LOW", 0), ("SEQ_GONE", 7)], "sequence_name string, last_number long")
    tgt = spark.createDataFrame([("seq_a", 1, 999), ("seq_cycle", 1, 999), ("seq_low", 5, 999)], "sequence_name string, min_value long, max_value long")
    got = {r.sequence_name: (r.last_number, r.status) for r in I.sequence_sync(src, tgt).collect()}
    assert got == {"SEQ_A": (50, "SYNCED"), "SEQ_CYCLE": (1, "SYNCED_CLAMPED"), "SEQ_LOW": (5, "SYNCED_CLAMPED"), "SEQ_GONE": (7, "MISSING_IN_TARGET")}
    assert tuple(I.sequence_totals(I.sequence_sync(src, tgt)).first()) == (4, 3, 2, 1)


def test_constraints_are_checked_in_one_plan(spark):
    numbers = spark.createDataFrame([(k, f"n{k}", k % 3) for k in (10, 9, 100, 2**53 + 1, 2**53, -5, 1)], "a long, b string, g int")
    none = spark.createDataFrame([], "p long, q string")
    some = spark.createDataFrame([(1, "n1"), (9, "n9"), (9, "n9")], "p long, q string")
    r = I.foreign_key_check({
        "num": (numbers, none, ["a"], ["p"]), "text": (numbers, none, ["b"], ["q"]), "two": (numbers.unionAll(numbers), some, ["a", "b"], ["p", "q"]),
        "fine": (some, some, ["p"], ["p"]), "small": (numbers, some, ["g"], ["p"])}, sample=3)
    got = {x.constraint_name: (x.orphan_keys, x.orphans, x.sample, x.holds) for x in r.collect()}
    assert got == {
        "num": (7, 7, "-5;1;9", False), "text": (7, 7, "n-5;n1;n10", False), "two": (5, 10, "-5/n-5;10/n10;100/n100", False), "fine": (0, 0, "", True),
        "small": (2, len([k for k in (10, 9, 100, 2**53 + 1, 2**53, -5, 1) if k % 3 != 1]), "0;2", False)}
    top = I.foreign_key_check({"num": (numbers.filter("a > 1000"), none, ["a"], ["p"])}).first()
    assert top.sample == f"{2**53};{2**53 + 1}"
    wide = spark.range(10_000)
    plan = I.foreign_key_check({"wide": (wide, wide.limit(0), ["id"], ["id"])})
    assert plan.first().orphan_keys == 10_000 and "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
