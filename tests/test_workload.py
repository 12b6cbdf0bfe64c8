import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cutover.workload import common, customer, employee, order

c = F.col
EMP = "employee_id long, employee_name string, department string, position_title string, manager_id long, salary decimal(12,2), commission_pct decimal(4,2)"


def test_tree_order_levels_and_leaves(spark):
    rows = [(1, "Root", "A", "x", None), (2, "Zed", "A", "x", 1), (3, "Amy", "B", "x", 1), (4, "Leaf", "A", "x", 2), (5, "Lost", "A", "x", 99)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], EMP)
    got = employee.org_chart(df).collect()
    # siblings by department then name; a row whose manager is unknown is not reachable
    assert [(r.employee_name, r.org_level, r.is_leaf) for r in got] == [("Root", 1, 0), ("Zed", 2, 0), ("Leaf", 3, 1), ("Amy", 2, 1)]
    assert got[2].full_path == " > Root > Zed > Leaf" and got[2].org_tree == " " * 8 + "Leaf"
    assert [(r.employee_name, r.depth, r.tree_view) for r in employee.subordinates(df, 2).collect()] == [("Zed", 0, "Zed"), ("Leaf", 1, "└─ Leaf")]


def test_cycle_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", "A", "x", 2, None, None), (2, "b", "A", "x", 1, None, None)], EMP)
    with pytest.raises(ValueError, match="cycle"):
        employee.subordinates(df, 1)


def test_salary_update(spark):
    rows = [(1, "a", "A", "x", None, Decimal("1000.00"), None), (2, "b", "A", "x", 1, Decimal("1499.00"), Decimal("0.29")), (3, "c", "A", "x", 1, None, None)]
    got = {r.employee_id: (r.salary, r.commission_pct) for r in employee.update_salary(spark.createDataFrame(rows, EMP), 10, "Y").collect()}
    # never a cut, capped commission, a null salary stays null
    assert got == {1: (Decimal("1000.00"), Decimal("0.02")), 2: (Decimal("2000.00"), Decimal("0.30")), 3: (None, Decimal("0.02"))}
    kept = employee.update_salary(spark.createDataFrame(rows, EMP), 10, "N").filter("employee_id = 2").first()
    assert kept.commission_pct == Decimal("0.29")


def test_rollup_tells_a_real_null_from_a_total(spark):
    df = spark.createDataFrame([("P", "ACTIVE", 1), ("X", "ACTIVE", 2), ("X", None, 4)], "customer_type string, status string, credit_limit int")
    got = {(r.type_is_total, r.status_is_total, r.customer_type, r.status): r.total_credit for r in customer.customer_stats(df).collect()}
    assert got[(1, 1, "합계", "소계")] == 7 and got[(0, 1, None, "소계")] == 6 and got[(0, 0, None, None)] == 4


def test_latest_bind_wins_and_keys_continue(spark):
    binds = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k long, seq long, v string")
    assert {r.k: r.v for r in common.latest_per_key(binds, ["k"], "seq").select("k", "v").collect()} == {1: "new", 2: "x"}
    table = spark.createDataFrame([(41,)], "id long")
    got = common.assign_keys(spark.createDataFrame([("b",), ("a",)], "n string"), ["n"], "id", table)
    assert {r.n: r.id for r in got.collect()} == {"a": 42, "b": 43}
    assert [r.id for r in common.assign_keys(spark.createDataFrame([("a",)], "n string"), ["n"], "id", table.limit(0)).collect()] == [1]


def test_next_item_seq_of_a_hot_order(many_segments):
    items = many_segments.createDataFrame([(1, 3)], "order_id long, item_seq int")
    new = many_segments.range(900).select(F.when(c("id") < 600, F.lit(1)).otherwise(c("id")).alias("order_id"), c("id").alias("line"))
    got = order.next_item_seq(items, new, ["line"])
    hot = sorted(r.item_seq for r in got.filter("order_id = 1").collect())
    assert hot == list(range(4, 604)) and got.filter("order_id > 1 and item_seq = 1").count() == 300


def test_status_update_guards(spark):
    o = spark.createDataFrame([(1, "PENDING", None), (2, "CANCELLED", None)], "order_id long, order_status string, ship_date date")
    ch = spark.createDataFrame([(1, "SHIPPED"), (2, "SHIPPED")], "order_id long, new_status string")
    got = {r.order_id: (r.order_status, str(r.ship_date)) for r in order.update_status(o, ch, datetime(2024, 5, 6, 7, 8)).collect()}
    assert got == {1: ("SHIPPED", "2024-05-06"), 2: ("CANCELLED", "None")}


def test_repeated_update_keys(spark):
    from cutover.workload.common import one_per_key

    log = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k long, v string, seq long")
    assert {(r.k, r.v) for r in one_per_key(log, "k", "seq").collect()} == {(1, "b"), (2, "c")}
    assert one_per_key(log.select("k", F.lit("x").alias("v")), "k").count() == 2
    with pytest.raises(Exception, match="several changes"):
        one_per_key(log.drop("seq"), "k").collect()


EMPLOYEE = "employee_id long, employee_name string, department string, manager_id long, position_title string"


def staff(spark, bosses):
    return spark.createDataFrame([(k, f"e{k}", "d", b, "t") for k, b in bosses.items()], EMPLOYEE)


def test_a_long_chain_takes_few_joins(spark, monkeypatch):
    written = []
    monkeypatch.setattr(employee, "stage", lambda df, label, whole=employee.stage: written.append(label) or whole(df, label))
    chain = spark.range(5000).select(c("id").alias("employee_id"), F.concat(F.lit("e"), c("id")).alias("employee_name"), F.lit("d").alias("department"),
                                     F.when(c("id") > 0, c("id") - 1).alias("manager_id"), F.lit("t").alias("position_title"))
    tree = employee.walk_tree(chain.repartition(4), chain.filter("manager_id is null"), ["employee_name"])
    r = tree.agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("deep"), F.count_if(c("level") == c("employee_id") + 1).alias("right")).first()
    assert (r.n, r.deep, r.right) == (5000, 5000, 5000) and len(written) <= 15
    assert tree.filter("employee_id = 3").first().full_path == " > e0 > e1 > e2 > e3"


def test_trees_against_a_walk(spark):
    rng = random.Random(12)
    for _ in range(3):
        bosses = {k: rng.choice([None, rng.randint(0, 59), 999]) if rng.random() < 0.2 else rng.randint(0, max(0, k - 1)) for k in range(60)}
        reach, todo = {}, [(k, (k,)) for k, b in bosses.items() if b is None]
        while todo:
            k, path = todo.pop()
            reach[k] = path
            todo += [(x, (*path, x)) for x, b in bosses.items() if b == k]
        df = staff(spark, bosses)
        got = {r.employee_id: (r.level, r.full_path) for r in employee.walk_tree(df, df.filter("manager_id is null"), ["employee_name"]).collect()}
        assert got == {k: (len(p), "".join(f" > e{x}" for x in p)) for k, p in reach.items()}


def test_cycles(spark):
    # 0 leads to 1 and 2; 3, 4 and 5 lead to one another, and 6 hangs below them; 7 is its own boss, 8 has an unknown one
    df = staff(spark, {0: None, 1: 0, 2: 1, 3: 4, 4: 5, 5: 3, 6: 5, 7: 7, 8: 99})
    assert sorted(r.employee_id for r in employee.walk_tree(df, df.filter("manager_id is null"), ["employee_name"]).collect()) == [0, 1, 2]
    assert sorted(r.employee_id for r in employee.walk_tree(df, df.filter("employee_id = 1"), ["employee_name"]).collect()) == [1, 2]
    for start in (3, 7):
        with pytest.raises(ValueError):
            employee.walk_tree(df, df.filter(c("employee_id") == start), ["employee_name"])
    assert employee.walk_tree(df, df.filter("employee_id = 12345"), ["employee_name"]).count() == 0


def test_last_changes_that_tie(spark):
    ddl = "k long, seq long, v string, w int"
    tied = spark.createDataFrame([(1, 5, "a", 1), (1, 5, "b", 1), (1, 4, "c", 1)], ddl)
    with pytest.raises(Exception, match="several last changes of 1"):
        common.latest_per_key(tied, ["k"], "seq").collect()
    alike = spark.createDataFrame([(1, 5, "a", None), (1, 5, "a", None), (1, 4, "c", 1), (None, None, "x", 2), (None, 1, "y", 3)], ddl)
    assert {(r.k, r.v, r.w) for r in common.latest_per_key(alike, ["k"], "seq").collect()} == {(1, "a", None), (None, "y", 3)}


def test_merge_meets_orders_once(spark):
    when = datetime(2024, 5, 6)
    orders = spark.createDataFrame([(k, 7, date(2024, 1, 1), Decimal("10.00"), Decimal("1.00"), "PENDING", "CARD", None, when) for k in (1, 2)],
                                   "order_id long, customer_id long, order_date date, total_amount decimal(14,2), tax_amount decimal(14,2), order_status string, payment_method string, remarks string, created_at timestamp_ntz")
    changes = spark.createDataFrame([(1, 7, Decimal("20.00"), None, "CASH", "r"), (None, 8, Decimal("30.00"), "PAID", "CASH", None), (99, 9, Decimal("40.00"), None, "CARD", None)],
                                    "order_id long, customer_id long, total_amount decimal(14,2), order_status string, payment_method string, remarks string")
    got = {r.order_id: (r.customer_id, str(r.total_amount), str(r.tax_amount), r.order_status, r.remarks) for r in order.merge_orders(orders, changes, ["customer_id"], when).collect()}
    assert got == {1: (7, "20.00", "2.00", "PENDING", "r"), 2: (7, "10.00", "1.00", "PENDING", None), 3: (8, "30.00", "3.00", "PAID", None), 4: (9, "40.00", "4.00", "PENDING", None)}
