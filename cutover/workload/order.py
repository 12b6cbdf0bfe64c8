"""Statements on orders and their lines."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutover.functions import oracle as O
from cutover.operators.ordered import page, ranked
from cutover.session import stage
from cutover.workload import labels as L
from cutover.workload.common import one_per_key, append_aligned, assign_keys, flagged, only, replace_columns, stamp

c = F.col


def line_amount() -> Column:
    return c("quantity") * c("unit_price") - O.nvl(c("discount_amt"), F.lit(0))


def order_totals(items: DataFrame) -> DataFrame:
    """Sum of the lines per order: the bulk form of the total-of-one-order function."""
    return items.groupBy("order_id").agg(F.sum(line_amount()).alias("calculated_total"))


def order_by_id(orders: DataFrame, customers: DataFrame, items: DataFrame, ids=None) -> DataFrame:
    return (
        only(orders, "order_id", ids)
        .join(customers.select("customer_id", "customer_name"), "customer_id")
        .join(order_totals(only(items, "order_id", ids)), "order_id", "left")
        .select(
            "order_id", "customer_id", "customer_name",
            O.to_char_date(c("order_date")).alias("order_date"),
            O.to_char_date(c("ship_date")).alias("ship_date"),
            O.format_amount(c("total_amount")).alias("total_amount"),
            O.format_amount(O.nvl(c("tax_amount"), F.lit(0))).alias("tax_amount"),
            O.format_amount(c("total_amount") - O.nvl(c("tax_amount"), F.lit(0))).alias("net_amount"),
            # a number turns into text without trailing zeros
            F.concat(F.regexp_replace(c("discount_rate").cast("string"), r"\.?0+$", ""), F.lit("%")).alias("discount_rate"),
            O.decode(c("order_status"), *L.ORDER_STATUS, L.UNKNOWN).alias("order_status"),
            O.nvl(c("payment_method"), L.NOT_DECIDED).alias("payment_method"),
            "remarks",
            O.nvl(c("calculated_total"), F.lit(0)).alias("calculated_total"),
            O.to_char_date(c("created_at"), "YYYY-MM-DD HH24:MI:SS").alias("created_at"),
        )
    )


def order_list(orders, customers, items, start_row: int, end_row: int, start_date: date | None = None,
               end_date: date | None = None, status: str | None = None, customer_id: int | None = None) -> DataFrame:
    """One page of orders; lines are counted for the orders of the page only."""
    df = orders
    if start_date is not None:
        df = df.filter(c("order_date") >= F.lit(start_date))
    if end_date is not None:
        df = df.filter(c("order_date") <= F.lit(end_date))
    if status:
        df = df.filter(c("order_status") == status)
    if customer_id is not None:
        df = df.filter(c("customer_id") == customer_id)
    named = df.join(customers.select("customer_id", "customer_name"), "customer_id")
    rows = page(named, [("order_date", "desc"), ("order_id", "desc")], start_row, end_row)
    # the page is found once; how it travels is decided by what was written
    rows = stage(rows, "page")
    counts = items.join(rows.select("order_id"), "order_id", "left_semi").groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))
    return rows.join(counts, "order_id", "left").select(
        "rnum", "order_id", "customer_name", O.to_char_date(c("order_date")).alias("order_date"),
        O.format_amount(c("total_amount")).alias("total_amount"), "order_status",
        O.nvl(c("payment_method"), "-").alias("payment_method"),
        O.nvl(c("item_count"), 0).alias("item_count"),
    )


def order_items(items: DataFrame, products: DataFrame, ids=None) -> DataFrame:
    gross = c("quantity") * c("unit_price")
    discount = O.nvl(c("discount_amt"), F.lit(0))
    return only(items, "order_id", ids).join(
        products.select("product_id", "product_name", "category"), "product_id").select(
        "order_id", "item_seq", "product_name", "category", "quantity",
        O.format_amount(c("unit_price")).alias("unit_price"),
        O.format_amount(discount).alias("discount_amt"),
        O.format_amount(line_amount()).alias("line_total"),
        F.round(discount * 100 / F.nullif(gross, F.lit(0)), 1).alias("discount_pct"),
    )


def insert_orders(orders: DataFrame, new_rows: DataFrame, order, as_of: datetime) -> DataFrame:
    rows = assign_keys(new_rows, order, "order_id", orders).select(
        "order_id", "customer_id", F.lit(as_of.date()).alias("order_date"), F.lit(0).alias("total_amount"),
        F.lit(0).alias("tax_amount"), O.nvl(c("discount_rate"), F.lit(0)).alias("discount_rate"),
        F.lit("PENDING").alias("order_status"), "payment_method", "remarks", stamp(as_of).alias("created_at"))
    return append_aligned(orders, rows)


def next_item_seq(items: DataFrame, new_lines: DataFrame, order) -> DataFrame:
    """Number new lines after the highest line of their order."""
    highest = items.join(new_lines.select("order_id").distinct(), "order_id", "left_semi").groupBy("order_id").agg(F.max("item_seq").alias("_top"))
    numbered = ranked(new_lines, ["order_id"], order, [], {"_n": ("row_number",)}, split=False)
    return numbered.join(highest, "order_id", "left").withColumn("item_seq", O.nvl(c("_top"), 0) + c("_n")).drop("_top", "_n")


def insert_order_items(items: DataFrame, products: DataFrame, new_lines: DataFrame, order) -> DataFrame:
    """Append lines: next number in the order, price looked up in the product table."""
    rows = next_item_seq(items, new_lines, order).join(products.select("product_id", "unit_price"), "product_id", "left").withColumn(
        "discount_amt", O.nvl(c("discount_amt"), F.lit(0)))
    return append_aligned(items, rows)


def recalculate_totals(orders: DataFrame, items: DataFrame, as_of: datetime, ids: DataFrame | None = None) -> DataFrame:
    """Total and tax from the lines; orders without lines become 0."""
    total = O.nvl(c("calculated_total"), F.lit(0))
    df = flagged(orders.withColumn("upd_date", F.lit(None).cast("timestamp_ntz")), ids, "order_id")
    df = df.join(order_totals(items), "order_id", "left")
    done = replace_columns(df, c("_hit"), {
        "total_amount": total,
        "tax_amount": F.round(total * F.lit(0.1).cast("decimal(2,1)"), 2),
        "upd_date": stamp(as_of)})
    return done.select(*orders.columns, "upd_date")


def update_status(orders: DataFrame, changes: DataFrame, as_of: datetime, seq: str | None = None) -> DataFrame:
    """Set the status of orders that are not cancelled; the first shipment stamps the ship date."""
    new = one_per_key(changes.select("order_id", "new_status", *([seq] if seq else [])), "order_id", seq).select("order_id", "new_status")
    df = orders.withColumn("upd_date", F.lit(None).cast("timestamp_ntz")).join(new, "order_id", "left")
    done = replace_columns(df, c("new_status").isNotNull() & (c("order_status") != "CANCELLED"), {
        "order_status": c("new_status"),
        "ship_date": F.when((c("new_status") == "SHIPPED") & c("ship_date").isNull(), F.lit(as_of.date())).otherwise(c("ship_date")),
        "upd_date": stamp(as_of)})
    return done.select(*orders.columns, "upd_date")


def monthly_sales(orders: DataFrame, year: int | None = None) -> DataFrame:
    df = orders.filter(c("order_status") != "CANCELLED")
    if year is not None:
        # a range, not a function of the column, so that the scan can skip files
        df = df.filter(c("order_date").between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31))))
    fine = df.groupBy(O.to_char_date(c("order_date"), "YYYY-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_amount").alias("total"), F.max("total_amount").alias("hi"), F.min("total_amount").alias("lo"))
    return fine.rollup("month").agg(
        F.grouping("month").alias("is_total"), F.sum("n").alias("order_count"), F.sum("total").alias("total_sales"),
        F.max("hi").alias("max_order"), F.min("lo").alias("min_order"),
    ).select(
        F.when(c("is_total") == 1, L.TOTAL).otherwise(c("month")).alias("sales_month"),
        O.nvl(c("order_count"), 0).alias("order_count"),
        "total_sales",
        O.format_amount(c("total_sales")).alias("total_sales_fmt"),
        O.format_amount(F.round(c("total_sales") / c("order_count"), 2)).alias("avg_order"),
        O.format_amount(c("max_order")).alias("max_order"),
        O.format_amount(c("min_order")).alias("min_order"),
    ).orderBy("sales_month")


def sales_ranking(orders: DataFrame, customers: DataFrame, year: int | None = None) -> DataFrame:
    """Delivered orders ranked by amount, with neighbours and running total by date."""
    df = orders.filter(c("order_status") == "DELIVERED")
    if year is not None:
        df = df.filter(c("order_date").between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31))))
    sales = df.select("order_id", "customer_id", "order_date", "total_amount").join(
        customers.select("customer_id", "customer_name"), "customer_id").drop("customer_id")
    by_amount = ranked(sales, [], [("total_amount", "desc")], ["order_id"], {
        "rn": ("row_number",), "sales_rank": ("rank",), "_all": ("total", "total_amount")})
    by_date = ranked(by_amount, [], ["order_date"], ["order_id"], {
        "prev_order_amt": ("lag", "total_amount"), "next_order_amt": ("lead", "total_amount"),
        "running_total": ("running_sum", "total_amount")})
    share = F.round(c("total_amount") * 100 / F.nullif(c("_all"), F.lit(0)), 2)
    return by_date.withColumn("sales_pct", share).withColumn("order_date", O.to_char_date(c("order_date"))).drop("_all")


def sales_by_category(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    lines = items.select("order_id", "product_id", (c("quantity") * c("unit_price")).alias("amount"))
    df = lines.join(products.select("product_id", "category"), "product_id").join(
        orders.filter(c("order_status") != "CANCELLED").select("order_id", "order_date"), "order_id")
    months = df.groupBy(O.to_char_date(c("order_date"), "YYYY-MM").alias("sales_month"))
    zero = F.lit(0).cast("decimal(10,2)")
    return months.agg(
        *(F.sum(F.when(c("category") == cat, c("amount")).otherwise(zero)).alias(f"{cat.lower()}_sales") for cat in L.CATEGORY[::2]),
        F.sum("amount").alias("total_sales"),
    ).orderBy("sales_month")


def merge_orders(orders: DataFrame, changes: DataFrame, order, as_of: datetime) -> DataFrame:
    """Upsert: known orders are updated, unknown ones inserted under new keys; two changes of a known order fail."""
    tax = lambda amount: F.round(amount * F.lit(0.1).cast("decimal(2,1)"), 2)
    new = [x for x in changes.columns if x != "order_id"]
    known = one_per_key(changes.filter(c("order_id").isNotNull()), "order_id").withColumn("_new", F.lit(True))
    # changes without a key meet no order, and are all inserted
    keyless = changes.filter(c("order_id").isNull()).withColumn("_new", F.lit(True))
    renamed = known.unionByName(keyless).select("order_id", "_new", *(c(x).alias(f"new_{x}") for x in new))
    met = orders.withColumn("_old", F.lit(True)).join(renamed, "order_id", "full_outer").withColumn("upd_date", F.lit(None).cast("timestamp_ntz"))
    # both sides of the join are needed, and it is run once
    met = stage(met, "merged")
    matched = replace_columns(met.filter("_old"), c("_new"), {
        "total_amount": c("new_total_amount"), "tax_amount": tax(c("new_total_amount")),
        "order_status": F.coalesce("new_order_status", "order_status"), "remarks": F.coalesce("new_remarks", "remarks"),
        "upd_date": stamp(as_of)}).select(*orders.columns, "upd_date")
    unknown = met.filter(c("_old").isNull()).select("order_id", *(c(f"new_{x}").alias(x) for x in new))
    inserted = assign_keys(unknown, order, "order_id", matched).select(
        "order_id", "customer_id", F.lit(as_of.date()).alias("order_date"), "total_amount", tax(c("total_amount")).alias("tax_amount"),
        O.nvl(c("order_status"), "PENDING").alias("order_status"), "payment_method", "remarks", stamp(as_of).alias("created_at"))
    return append_aligned(matched, inserted)


def daily_sales(orders: DataFrame, start: date, end: date) -> DataFrame:
    """Every day of the range, sold on or not."""
    spark = orders.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("sale_date"))
    sums = orders.filter((c("order_status") != "CANCELLED") & c("order_date").between(F.lit(start), F.lit(end))).groupBy(
        c("order_date").alias("sale_date")).agg(F.count(F.lit(1)).alias("order_cnt"), F.sum("total_amount").alias("total_amt"))
    return days.join(sums, "sale_date", "left").select(
        O.to_char_date(c("sale_date")).alias("sale_date"),
        O.korean_day(c("sale_date")).alias("day_name"),
        O.nvl(c("order_cnt"), 0).alias("order_count"),
        O.format_amount(c("total_amt")).alias("total_sales"),
    ).orderBy("sale_date")


def latest_order_by_customer(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """The newest order of each customer; the aggregate keeps one row per customer and task."""
    fields = ["order_id", "order_date", "total_amount", "tax_amount", "order_status"]
    newest = orders.filter(c("order_status") != "CANCELLED").groupBy("customer_id").agg(
        F.max_by(F.struct(*fields), F.struct("order_date", "order_id")).alias("o"))
    return newest.join(customers, "customer_id").select(
        "customer_id", "customer_name", c("o.order_id").alias("order_id"),
        O.to_char_date(c("o.order_date")).alias("order_date"),
        c("o.total_amount").alias("total_amount"), c("o.order_status").alias("order_status"),
        O.greatest(c("o.total_amount"), O.nvl(c("o.tax_amount"), F.lit(0))).alias("greater_amt"),
        O.least(c("o.total_amount"), O.nvl(c("credit_limit"), F.lit(0))).alias("lesser_amt"),
    ).orderBy("customer_name", "customer_id")


def cancel_orders(orders: DataFrame, as_of: datetime, reasons: DataFrame, seq: str | None = None) -> DataFrame:
    """Cancel pending or confirmed orders and append the reason to the remarks."""
    when = as_of.strftime("%Y-%m-%d %H:%M")
    reasons = one_per_key(reasons.select("order_id", "cancel_reason", *([seq] if seq else [])), "order_id", seq)
    new = reasons.select("order_id", F.lit(True).alias("_hit"), "cancel_reason")
    df = orders.withColumn("upd_date", F.lit(None).cast("timestamp_ntz")).join(new, "order_id", "left")
    note = O.concat_ignoring_null(c("remarks"), "\n" + L.CANCELLED_MARK + when + " ", O.nvl(c("cancel_reason"), L.NO_REASON))
    done = replace_columns(df, c("_hit") & c("order_status").isin(L.CANCELLABLE_STATUSES),
                           {"order_status": F.lit("CANCELLED"), "remarks": note, "upd_date": stamp(as_of)})
    return done.select(*orders.columns, "upd_date")
