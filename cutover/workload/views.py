"""Views, procedures in bulk form, audit rows and the check statements."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutover.functions import oracle as O
from cutover.operators.ordered import global_index, listagg_parts, ranked
from cutover.session import stage
from cutover.workload import labels as L
from cutover.workload.common import append_aligned, replace_columns, stamp
from cutover.workload.customer import _keyword_filter

c = F.col


def order_summary(orders: DataFrame, customers: DataFrame) -> DataFrame:
    tax = O.nvl(c("tax_amount"), F.lit(0))
    # the join keeps or drops whole customers, so ranks may come first
    by_amount = ranked(orders, ["customer_id"], [("total_amount", "desc")], ["order_id"], {"amount_rank": ("rank",)}, split=False)
    return by_amount.join(customers.select("customer_id", "customer_name", "customer_type"), "customer_id").select(
        "order_id", "customer_name", O.decode(c("customer_type"), *L.CUSTOMER_TYPE, L.OTHER).alias("cust_type"),
        O.to_char_date(c("order_date")).alias("order_date_str"), "total_amount", tax.alias("tax_amount"),
        (c("total_amount") - tax).alias("net_amount"), "order_status",
        O.decode(c("order_status"), *L.ORDER_STATUS).alias("status_kr"), "amount_rank")


def product_sales(products: DataFrame, items: DataFrame) -> DataFrame:
    per_order = items.groupBy("product_id", "order_id").agg(
        F.sum("quantity").alias("q"), F.sum(c("quantity") * c("unit_price")).alias("r"),
        F.sum("unit_price").alias("p"), F.count("unit_price").alias("n"))
    sums = per_order.groupBy("product_id").agg(
        F.sum("q").alias("q"), F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("orders"))
    columns = ["product_id", "product_name", "category", "unit_price"]
    # one row per product, written out so that the total does not read the lines again
    sold = stage(products.select(columns).join(sums, "product_id", "left").withColumn("revenue", O.nvl(c("r"), F.lit(0))), "product-sales")
    total = sold.agg(F.sum("revenue")).first()[0]
    share = F.round(c("revenue") * 100 / F.lit(total), 2) if total else F.lit(None)
    return sold.select(
        "product_id", "product_name", "category", c("unit_price").alias("list_price"),
        O.nvl(c("q"), 0).alias("total_qty_sold"), c("revenue").alias("total_revenue"), O.nvl(c("orders"), 0).alias("order_count"),
        F.round(O.nvl(c("p") / c("n"), F.lit(0)), 2).alias("avg_sell_price"), share.alias("revenue_pct"))


def update_grades(customers: DataFrame, orders: DataFrame, as_of: datetime) -> DataFrame:
    """Write each active customer's grade, from purchases of the last twelve months, into the memo."""
    since = O.add_months_at(F.lit(as_of), -12)
    bought = orders.filter((c("order_date") >= since) & (c("order_status") == "DELIVERED")).groupBy("customer_id").agg(
        F.sum("total_amount").alias("_bought"))
    df = customers.withColumn("upd_date", F.lit(None).cast("timestamp_ntz")).join(bought, "customer_id", "left")
    amount = O.nvl(c("_bought"), F.lit(0))
    grade = F
    for least, name in L.CUSTOMER_GRADES:
        grade = grade.when(amount >= least, name)
    memo = F.concat(grade.otherwise(L.LOWEST_GRADE), F.lit(f" ({L.GRADE_PURCHASES}"), O.format_amount(c("_bought")), F.lit(")"))
    done = replace_columns(df, c("status") == "ACTIVE", {"memo": memo, "upd_date": stamp(as_of)})
    return done.select(*customers.columns, "upd_date")


def customer_info(customers: DataFrame) -> DataFrame:
    kind = O.decode(c("customer_type"), *L.CUSTOMER_TYPE)
    return customers.select("customer_id", O.concat_ignoring_null(
        c("customer_name"), " (", kind, ") ", O.nvl(c("email"), "-"), " / ", O.nvl(c("phone"), "-"),
        " / " + L.CREDIT_LIMIT, O.format_amount(c("credit_limit"))).alias("info"))


def find_customers(customers: DataFrame, keyword: str) -> DataFrame:
    return customers.filter(_keyword_filter(keyword, None)).orderBy("customer_name", "customer_id").select(
        "customer_id", "customer_name", "email", "phone", "status")


def audit_rows(audit_log: DataFrame, old_orders: DataFrame, new_orders: DataFrame, old_customers: DataFrame,
               new_customers: DataFrame, user: str, as_of: datetime) -> DataFrame:
    """Audit rows two snapshots imply: one per changed order status, one per inserted customer."""
    text = lambda *p: O.concat_ignoring_null(*(F.lit(x) if isinstance(x, str) else x for x in p))
    moved = old_orders.select("order_id", c("order_status").alias("o")).join(
        new_orders.select("order_id", c("order_status").alias("n")), "order_id").filter(~c("o").eqNullSafe(c("n")))
    updates = moved.select(
        F.lit("ORDERS").alias("table_name"), F.lit("UPDATE").alias("operation"),
        text("ORDER_ID=", c("order_id"), ", STATUS=", c("o")).alias("old_value"),
        text("ORDER_ID=", c("order_id"), ", STATUS=", c("n")).alias("new_value"), c("order_id").alias("_key"))
    inserts = new_customers.join(old_customers.select("customer_id"), "customer_id", "left_anti").select(
        F.lit("CUSTOMERS").alias("table_name"), F.lit("INSERT").alias("operation"), F.lit(None).cast("string").alias("old_value"),
        text("CUSTOMER_ID=", c("customer_id"), ", NAME=", c("customer_name")).alias("new_value"), c("customer_id").alias("_key"))
    last = audit_log.agg(F.max("log_id")).first()[0] or 0
    numbered = global_index(updates.unionByName(inserts), ["table_name", "_key"], "_i")
    return numbered.select(
        (c("_i") + F.lit(last + 1)).alias("log_id"), "table_name", "operation", "old_value", "new_value",
        F.lit(user).alias("changed_by"), stamp(as_of).alias("changed_at"))


def check_strings_customer(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id", O.mask_string(c("customer_name")).alias("masked_name"), O.nvl(c("email"), "N/A").alias("email"),
        O.decode(c("customer_type"), "P", "Personal", "B", "Business", "Unknown").alias("type"),
        O.to_char_date(c("reg_date"), "YYYY-MM-DD HH24:MI:SS").alias("reg_date"))


def check_strings_product(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id", F.upper(F.substring("product_name", 1, 10)).alias("short_name"), F.lower("category").alias("category_lower"),
        F.replace("description", F.lit(" "), F.lit("_")).alias("desc_no_space"), F.trim("product_name").alias("trimmed_name"),
        O.instr(c("product_name"), " ").alias("first_space_pos"))


def check_numbers(orders: DataFrame) -> DataFrame:
    t = c("total_amount")
    return orders.select(
        "order_id", t, F.round(t / F.lit(1.1).cast("decimal(2,1)"), 2).alias("net_amount"), F.ceil(t / 10000).alias("ceil_10k"),
        F.floor(t / 10000).alias("floor_10k"), (c("order_id") % 3).alias("mod_3"), F.abs(t - 1000000).alias("diff_from_1m"))


def check_dates(orders: DataFrame, as_of: date) -> DataFrame:
    d = c("order_date")
    return orders.select(
        "order_id", d, O.add_months(d, 3).alias("plus_3m"),
        F.months_between(F.lit(as_of), d, False).alias("months_ago"), F.last_day(d).alias("month_end"),
        F.next_day(d, "MON").alias("next_mon"), F.year(d).alias("ord_year"), F.month(d).alias("ord_month"))


def check_windows(orders: DataFrame) -> DataFrame:
    df = orders.select("order_id", "customer_id", "order_date", "total_amount")
    by_amount = ranked(df, [], [("total_amount", "desc")], ["order_id"], {"rn": ("row_number",), "rnk": ("rank",), "drnk": ("dense_rank",)})
    return ranked(by_amount, [], ["order_date"], ["order_id"], {
        "prev_amount": ("lag", "total_amount"), "next_amount": ("lead", "total_amount"),
        "running_total": ("running_sum", "total_amount")}).drop("order_date")


def check_lists(orders: DataFrame, part_rows: int = 10_000) -> DataFrame:
    items = orders.select("customer_id", "order_id", "order_date", c("order_id").cast("string").alias("id_text"))
    return listagg_parts(items, ["customer_id"], {"order_list": "id_text"}, ["order_date"], ["order_id"], part_rows=part_rows, split=False).drop("items")
