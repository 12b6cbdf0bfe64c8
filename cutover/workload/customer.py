"""Statements on customers."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutover.functions import oracle as O
from cutover.operators.ordered import listagg_parts, page
from cutover.workload import labels as L
from cutover.workload.common import one_per_key, append_aligned, assign_keys, flagged, only, replace_columns, stamp


def customer_by_id(customers: DataFrame, ids=None) -> DataFrame:
    c = F.col
    return only(customers, "customer_id", ids).select(
        "customer_id",
        "customer_name",
        O.nvl(c("email"), L.UNREGISTERED).alias("email"),
        O.nvl(c("phone"), L.UNREGISTERED).alias("phone"),
        O.nvl(c("address"), L.UNREGISTERED).alias("address"),
        O.decode(c("customer_type"), *L.CUSTOMER_TYPE, L.OTHER).alias("customer_type"),
        O.format_amount(c("credit_limit")).alias("credit_limit"),
        O.to_char_date(c("birth_date")).alias("birth_date"),
        O.to_char_date(c("reg_date"), "YYYY-MM-DD HH24:MI:SS").alias("reg_date"),
        "status",
    )


def customer_list(customers: DataFrame, start_row: int, end_row: int, status=None, name=None, customer_type=None) -> DataFrame:
    c = F.col
    df = customers.filter(c("status").isNotNull() if status is None else c("status") == status)
    if name:
        df = df.filter(O.like_anywhere(F.upper("customer_name"), name.upper()))
    if customer_type is not None:
        df = df.filter(c("customer_type") == customer_type)
    rows = df.select(
        "customer_id",
        "customer_name",
        O.nvl2(c("email"), c("email"), c("phone")).alias("contact_info"),
        O.decode(c("customer_type"), *L.CUSTOMER_TYPE).alias("customer_type"),
        O.format_amount(c("credit_limit")).alias("credit_limit"),
        O.to_char_date(c("reg_date")).alias("reg_date"),
        "status",
    )
    return page(rows, [("customer_id", "desc")], start_row, end_row)


def _keyword_filter(keyword: str, by: str | None):
    upper = keyword.upper()
    in_name, in_email = O.like_anywhere(F.upper("customer_name"), upper), O.like_anywhere(F.upper("email"), upper)
    if by == "NAME":
        return in_name
    if by == "EMAIL":
        return in_email
    if by == "PHONE":
        return O.like_anywhere(F.replace("phone", F.lit("-"), F.lit("")), keyword.replace("-", ""))
    return in_name | in_email


def search_customers(customers: DataFrame, keyword: str, by: str | None = None) -> DataFrame:
    c = F.col
    at = F.instr(O.nvl(c("email"), "@"), "@")
    return customers.filter(_keyword_filter(keyword, by)).select(
        "customer_id",
        O.mask_string(c("customer_name")).alias("customer_name"),
        # an empty string is null in the source database
        F.nullif(F.substring(c("email"), F.lit(1), at - 1), F.lit("")).alias("email_id"),
        F.replace("phone", F.lit("-"), F.lit("")).alias("phone"),
        F.lpad(c("customer_id").cast("string"), 10, "0").alias("customer_no"),
        "status",
    ).orderBy("customer_name", "customer_id")


def customer_detail(customers: DataFrame, orders: DataFrame, as_of: date, ids=None) -> DataFrame:
    c = F.col
    sums = orders.filter(c("order_status") != "CANCELLED").groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_cnt"), F.sum("total_amount").alias("total_amt"))
    today = F.lit(as_of)
    return only(customers, "customer_id", ids).join(sums, "customer_id", "left").select(
        "customer_id", "customer_name", "email", "phone", "address",
        O.decode(c("customer_type"), *L.CUSTOMER_TYPE_LONG).alias("customer_type_nm"),
        O.format_amount(c("credit_limit")).alias("credit_limit_fmt"),
        O.to_char_date(c("birth_date")).alias("birth_date"),
        O.calc_age(c("birth_date"), today).alias("age"),
        O.trunc_number(F.months_between(today, c("reg_date"), False)).cast("bigint").alias("member_months"),
        O.to_char_date(c("reg_date"), "YYYY-MM-DD HH24:MI:SS").alias("reg_date"),
        O.nvl(c("memo"), L.NO_GRADE).alias("grade_info"),
        O.nvl(c("order_cnt"), 0).alias("order_count"),
        O.nvl(c("total_amt"), F.lit(0)).alias("total_purchase"),
        O.format_amount(c("total_amt")).alias("total_purchase_fmt"),
    )


def insert_customers(customers: DataFrame, new_rows: DataFrame, order, as_of: datetime) -> DataFrame:
    """Append customers: keys continue the sequence, missing type and limit take their defaults."""
    c = F.col
    rows = assign_keys(new_rows, order, "customer_id", customers).select(
        "customer_id", "customer_name", "email", "phone", "address",
        O.nvl(c("customer_type"), "P").alias("customer_type"),
        O.nvl(c("credit_limit"), F.lit(0)).alias("credit_limit"),
        O.to_date(c("birth_date")).alias("birth_date"),
        stamp(as_of).alias("reg_date"),
        F.lit("ACTIVE").alias("status"),
    )
    return append_aligned(customers, rows)


def update_customers(customers: DataFrame, updates: DataFrame, as_of: datetime, seq: str | None = None) -> DataFrame:
    """Keyed update of active customers; a null limit or birth date keeps the old one.  ``seq`` orders updates of one key."""
    fields = ["customer_name", "email", "phone", "address", "credit_limit", "birth_date"]
    updates = one_per_key(updates.select("customer_id", *fields, *([seq] if seq else [])), "customer_id", seq)
    new = updates.select("customer_id", F.lit(True).alias("_hit"), *(F.col(f).alias(f"new_{f}") for f in fields))
    df = customers.withColumn("upd_date", F.lit(None).cast("timestamp_ntz")).join(new, "customer_id", "left")
    done = replace_columns(df, F.col("_hit") & (F.col("status") == "ACTIVE"), {
        **{f: F.col(f"new_{f}") for f in fields[:4]},
        "credit_limit": F.coalesce("new_credit_limit", "credit_limit"),
        "birth_date": F.coalesce(O.to_date(F.col("new_birth_date")), F.col("birth_date")),
        "upd_date": stamp(as_of),
    })
    return done.select(*customers.columns, "upd_date")


def deactivate_customers(customers: DataFrame, orders: DataFrame, as_of: datetime, ids: DataFrame | None = None) -> DataFrame:
    """Deactivate active customers that have no open order."""
    busy = orders.filter(F.col("order_status").isin(L.OPEN_STATUSES))
    df = flagged(customers.withColumn("upd_date", F.lit(None).cast("timestamp_ntz")), busy, "customer_id", "_busy")
    df = flagged(df, ids, "customer_id")
    done = replace_columns(df, F.col("_hit") & ~F.col("_busy") & (F.col("status") == "ACTIVE"),
                           {"status": F.lit("INACTIVE"), "upd_date": stamp(as_of)})
    return done.select(*customers.columns, "upd_date")


def delete_customers(customers: DataFrame, as_of: datetime, ids: DataFrame | None = None) -> DataFrame:
    """Soft delete: suspend and append a note to the memo, whether or not there was one."""
    note = F.lit("\n" + L.DELETED_MARK + as_of.strftime("%Y-%m-%d %H:%M") + L.DELETED_NOTE)
    df = flagged(customers.withColumn("upd_date", F.lit(None).cast("timestamp_ntz")), ids, "customer_id")
    done = replace_columns(df, F.col("_hit"), {
        "status": F.lit("SUSPENDED"), "memo": O.concat_ignoring_null(F.col("memo"), note), "upd_date": stamp(as_of)})
    return done.select(*customers.columns, "upd_date")


def customer_stats(customers: DataFrame) -> DataFrame:
    """Rollup by type and status; labels only on real subtotal rows, told apart by the level columns."""
    fine = customers.withColumn("type_label", O.decode(F.col("customer_type"), *L.CUSTOMER_TYPE)).groupBy(
        "type_label", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(O.nvl(F.col("credit_limit"), F.lit(0))).alias("credit"))
    # the rollup expands one row per (type, status), not one per customer
    return fine.rollup("type_label", "status").agg(
        F.grouping("type_label").alias("type_is_total"), F.grouping("status").alias("status_is_total"),
        F.sum("n").alias("cnt"), F.sum("credit").alias("total_credit"),
    ).select(
        F.when(F.col("type_is_total") == 1, L.TOTAL).otherwise(F.col("type_label")).alias("customer_type"),
        F.when(F.col("status_is_total") == 1, L.SUBTOTAL).otherwise(F.col("status")).alias("status"),
        "type_is_total", "status_is_total", "cnt", "total_credit",
    )


def customer_order_summary(customers: DataFrame, orders: DataFrame, ids=None, part_rows: int = 10_000) -> DataFrame:
    """Order totals and ordered id/date lists per customer; a long list goes on in further parts."""
    c = F.col
    live = orders.filter(c("order_status") != "CANCELLED")
    live = only(live, "customer_id", ids)
    sums = live.groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"), F.sum("total_amount").alias("total"),
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"))
    items = live.select("customer_id", "order_id", "order_date", c("order_id").cast("string").alias("id_text"),
                        O.to_char_date(c("order_date"), "MM/DD").alias("date_text"))
    lists = listagg_parts(items, ["customer_id"], {"order_id_list": "id_text", "order_date_list": "date_text"},
                          ["order_date"], ["order_id"], part_rows=part_rows, split=False)
    return only(customers, "customer_id", ids).select("customer_id", "customer_name").join(sums, "customer_id", "left").join(
        lists, "customer_id", "left").select(
        "customer_id", "customer_name",
        O.nvl(c("part_no"), 1).alias("part_no"),
        O.nvl(c("order_count"), 0).alias("order_count"),
        O.format_amount(c("total")).alias("total_purchase"),
        "order_id_list", "order_date_list", "first_order", "last_order",
        F.round(c("total") / c("order_count"), 2).alias("avg_order_amt"),
    )
