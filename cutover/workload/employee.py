"""Statements on employees and the audit log."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutover.functions import oracle as O
from cutover.operators.ordered import listagg_parts, ranked
from cutover.session import stage
from cutover.workload import labels as L
from cutover.workload.common import append_aligned, assign_keys, flagged, only, replace_columns, stamp

c = F.col


def employee_by_id(employees: DataFrame, as_of: date, ids=None) -> DataFrame:
    managers = employees.select(c("employee_id").alias("manager_id"), c("employee_name").alias("_manager"))
    pct = O.nvl(c("commission_pct"), F.lit(0).cast("decimal(4,2)"))
    return only(employees, "employee_id", ids).join(managers, "manager_id", "left").select(
        "employee_id", "employee_name", "department", "position_title",
        O.to_char_date(c("hire_date")).alias("hire_date"),
        O.calc_age(c("hire_date"), F.lit(as_of)).alias("years_worked"),
        O.format_amount(c("salary")).alias("salary"),
        F.concat((pct * 100).cast("bigint").cast("string"), F.lit("%")).alias("commission"),
        O.format_amount(c("salary") * (F.lit(1).cast("decimal(3,2)") + pct)).alias("total_compensation"),
        O.nvl(c("_manager"), L.TOP_OF_TREE).alias("manager_name"),
        "email", "phone_ext",
    )


def walk_tree(employees: DataFrame, start: DataFrame, siblings: list[str]) -> DataFrame:
    """Rows reachable from ``start`` with level, name path and sort path.

    Every row carries the piece of its path that is known, and the row above
    that piece.  A round puts the piece of that row before its own, so pieces
    double: a tree of depth d takes about log2(d) joins.  A row that comes upon
    itself is in or below a cycle that no start leads to, and is left out; a
    start below itself is an error.
    """
    starts = start.select("employee_id").distinct()
    step = F.struct(c("employee_id").alias("id"), c("employee_name").alias("name"), F.struct(*siblings).alias("sort"))
    pieces = flagged(employees, starts, "employee_id", "_start").select(
        "employee_id", F.when(~c("_start"), c("manager_id")).alias("_up"), "_start", F.array(step).alias("_piece")).filter(c("_start") | c("_up").isNotNull())
    pieces = stage(pieces, "tree-pieces")
    whole, open_ = pieces.filter("_start"), pieces.filter("NOT _start")
    while not open_.isEmpty():
        above = whole.unionByName(open_).select(c("employee_id").alias("_id"), c("_up").alias("_next"), c("_start").alias("_whole"), c("_piece").alias("_above"))
        met = open_.join(above, c("_up") == c("_id")).select("employee_id", c("_next").alias("_up"), c("_whole").alias("_start"), F.concat("_above", "_piece").alias("_piece"))
        ids = F.transform("_piece", lambda x: x["id"])
        met = stage(met.filter(c("_start") | (F.size(F.array_distinct(ids)) == F.size(ids))), "tree-pieces")
        whole, open_ = whole.unionByName(met.filter("_start")), met.filter("NOT _start")
    again = employees.join(starts, "employee_id", "left_semi").select(c("manager_id").alias("employee_id"))
    if not whole.join(again, "employee_id", "left_semi").isEmpty():
        raise ValueError("the hierarchy has a cycle")
    names = F.transform("_piece", lambda x: x["name"])
    path = F.when(F.forall("_piece", lambda x: x["name"].isNotNull()), F.concat(F.lit(" > "), F.array_join(names, " > ")))
    paths = whole.select("employee_id", F.size("_piece").cast("bigint").alias("level"), path.alias("full_path"), F.transform("_piece", lambda x: x["sort"]).alias("sort_path"))
    return employees.join(paths, "employee_id")


def org_chart(employees: DataFrame, siblings=("department", "employee_name")) -> DataFrame:
    tree = walk_tree(employees, employees.filter(c("manager_id").isNull()), list(siblings))
    bosses = employees.filter(c("manager_id").isNotNull()).select(c("manager_id").alias("employee_id")).distinct()
    return flagged(tree, bosses, "employee_id", "_boss").orderBy("sort_path").select(
        "employee_id", "employee_name", "department", "position_title", "manager_id",
        c("level").alias("org_level"),
        # LPAD of one blank to length 0 is null, which concatenation ignores
        F.concat(F.repeat(F.lit(" "), ((c("level") - 1) * 4).cast("int")), c("employee_name")).alias("org_tree"),
        "full_path", F.when(c("_boss"), 0).otherwise(1).alias("is_leaf"),
    )


def subordinates(employees: DataFrame, manager_id: int) -> DataFrame:
    tree = walk_tree(employees, employees.filter(c("employee_id") == manager_id), ["employee_name"])
    pad = ((c("level") - 1) * 3).cast("int")
    return tree.orderBy("sort_path").select(
        "employee_id", "employee_name", "department", "position_title", (c("level") - 1).alias("depth"),
        F.concat(F.lpad(F.lit("└─ "), pad, " "), c("employee_name")).alias("tree_view"),
    )


def dept_salary_stats(employees: DataFrame) -> DataFrame:
    fine = employees.groupBy("department").agg(
        F.count(F.lit(1)).alias("n"), F.count("salary").alias("paid"), F.sum("salary").alias("total"),
        F.min("salary").alias("lo"), F.max("salary").alias("hi"),
        F.sum(c("salary") * O.nvl(c("commission_pct"), F.lit(0))).alias("commission"))
    return fine.rollup("department").agg(
        F.grouping("department").alias("is_total"), F.sum("n").alias("emp_count"), F.sum("paid").alias("paid"),
        F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("commission").alias("commission"),
    ).orderBy(c("is_total"), c("department").asc_nulls_last()).select(
        F.when(c("is_total") == 1, L.ALL_DEPARTMENTS).otherwise(c("department")).alias("department"), "is_total",
        "emp_count",
        O.format_amount(F.round(c("total") / c("paid"), 0)).alias("avg_salary"),
        O.format_amount(c("lo")).alias("min_salary"), O.format_amount(c("hi")).alias("max_salary"),
        O.format_amount(c("total")).alias("total_salary"),
        O.format_amount(F.round(c("commission"), 0)).alias("total_commission"),
    )


def dept_employee_list(employees: DataFrame, part_rows: int = 10_000) -> DataFrame:
    counts = employees.groupBy("department").agg(F.count(F.lit(1)).alias("emp_count"))
    items = employees.select("department", "employee_id", "salary",
                             O.concat_ignoring_null(c("employee_name"), "(", c("position_title"), ")").alias("member"))
    lists = listagg_parts(items, ["department"], {"member_list": "member"}, [("salary", "desc")], ["employee_id"], part_rows=part_rows)
    joined = lists.alias("l").join(counts.alias("n"), c("l.department").eqNullSafe(c("n.department")))
    return joined.select("l.department", "part_no", "emp_count", "member_list").orderBy(c("department").asc_nulls_last(), "part_no")


def salary_ranking(employees: DataFrame, department: str | None = None) -> DataFrame:
    df = employees if not department else employees.filter(c("department") == department)
    df = df.select("employee_id", "employee_name", "department", "position_title", "salary")
    down = ranked(df, [], [("salary", "desc")], ["employee_id"], {"salary_rank": ("dense_rank",), "salary_tier": ("ntile", 3)})
    up = ranked(down, [], ["salary"], ["employee_id"], {"_pr": ("percent_rank",), "_cd": ("cume_dist",)})
    dept = ranked(up, ["department"], [("salary", "desc")], ["employee_id"], {"dept_rank": ("dense_rank",)})
    return dept.select(
        "employee_id", "employee_name", "department", "position_title", "salary", "salary_rank", "dept_rank",
        F.round(c("_pr") * 100, 1).alias("percentile"), F.round(c("_cd") * 100, 1).alias("cumulative_pct"), "salary_tier",
    ).orderBy(c("salary").desc_nulls_first(), "employee_id")


def insert_employees(employees: DataFrame, new_rows: DataFrame, order, as_of: datetime) -> DataFrame:
    rows = assign_keys(new_rows, order, "employee_id", employees).withColumn(
        "hire_date", F.coalesce(O.to_date(c("hire_date")), F.lit(as_of.date())))
    return append_aligned(employees, rows)


def update_salary(employees: DataFrame, raise_rate: int, adjust_commission: str | None, ids: DataFrame | None = None) -> DataFrame:
    """Raise rounded to thousands but never a cut; the commission goes up by 0.02 to 0.30 at most."""
    raised = F.round(c("salary") * (F.lit(100 + raise_rate).cast("decimal(5,0)")) / 100, -3)
    lifted = O.least(O.nvl(c("commission_pct"), F.lit(0)) + F.lit(0.02).cast("decimal(3,2)"), F.lit(0.30).cast("decimal(3,2)"))
    done = replace_columns(flagged(employees, ids, "employee_id"), c("_hit"), {
        "salary": O.greatest(raised, c("salary")),
        "commission_pct": O.decode(F.lit(adjust_commission), "Y", lifted, c("commission_pct"))})
    return done.select(*employees.columns)


def audit_entries(audit_log: DataFrame, table_name: str | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    df = audit_log
    if table_name is not None:
        df = df.filter(c("table_name") == table_name)
    if start is not None:
        df = df.filter(c("changed_at") >= O.to_timestamp(F.lit(start.isoformat()), "YYYY-MM-DD"))
    if end is not None:
        df = df.filter(c("changed_at") <= O.to_timestamp(F.lit(f"{end.isoformat()} 23:59:59"), "YYYY-MM-DD HH24:MI:SS"))
    return df.orderBy(c("changed_at").desc_nulls_first(), c("log_id").desc()).select(
        "log_id", "table_name", "operation",
        F.substring("old_value", 1, 200).alias("old_value_short"), F.substring("new_value", 1, 200).alias("new_value_short"),
        O.nvl(c("changed_by"), "SYSTEM").alias("changed_by"),
        O.to_char_date(c("changed_at"), "YYYY-MM-DD HH24:MI:SS").alias("changed_at"),
    )
