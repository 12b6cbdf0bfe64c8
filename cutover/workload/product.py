"""Statements on products and the code table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutover.functions import oracle as O
from cutover.operators.ordered import ranked
from cutover.workload import labels as L
from cutover.workload.common import append_aligned, assign_keys, only, replace_columns
from cutover.workload.order import line_amount

c = F.col


def product_by_id(products: DataFrame, ids=None) -> DataFrame:
    return only(products, "product_id", ids).select(
        "product_id", "product_name", O.nvl(c("category"), L.UNCATEGORISED).alias("category"),
        O.format_amount(c("unit_price")).alias("unit_price"), "weight",
        O.raw_to_text(c("product_code")).alias("product_code_str"),
        O.nvl(c("description"), L.NO_DESCRIPTION).alias("description"),
        O.decode(c("is_active"), *L.PRODUCT_STATUS, L.UNKNOWN).alias("status"),
        O.to_char_date(c("created_date")).alias("created_date"),
    )


def search_products(products: DataFrame, keyword: str | None = None, category: str | None = None,
                    min_price=None, max_price=None, sort_by: str | None = None) -> DataFrame:
    df = products.filter(c("is_active") == 1)
    if keyword:
        pattern = F.lit(f"(?i){keyword}")
        df = df.filter(F.regexp_like("product_name", pattern) | F.regexp_like(O.nvl(c("description"), ""), pattern))
    if category:
        df = df.filter(c("category") == category)
    if min_price is not None:
        df = df.filter(c("unit_price") >= F.lit(min_price))
    if max_price is not None:
        df = df.filter(c("unit_price") <= F.lit(max_price))
    order = {
        "PRICE_ASC": [c("unit_price").asc_nulls_last()], "PRICE_DESC": [c("unit_price").desc_nulls_first()],
        "NAME": [c("product_name").asc_nulls_last()],
    }.get(sort_by, [])
    return df.orderBy(*order, c("product_id").desc()).select(
        "product_id", "product_name", "category", O.format_amount(c("unit_price")).alias("unit_price"),
        F.regexp_replace("description", r"\s+", " ").alias("description_clean"),
    )


def products_by_category(products: DataFrame) -> DataFrame:
    return products.filter(c("is_active") == 1).groupBy("category").agg(
        F.count(F.lit(1)).alias("product_count"), F.sum("unit_price").alias("_sum"),
        F.min("unit_price").alias("lo"), F.max("unit_price").alias("hi"),
        F.sqrt(O.variance(c("unit_price"))).alias("sd"),
    ).filter(c("product_count") >= 1).orderBy(c("product_count").desc(), "category").select(
        O.decode(c("category"), *L.CATEGORY, L.OTHER).alias("category_nm"), "category", "product_count",
        O.format_amount(F.round(c("_sum") / c("product_count"), 0)).alias("avg_price"),
        O.format_amount(c("lo")).alias("min_price"), O.format_amount(c("hi")).alias("max_price"),
        F.round("sd", 2).alias("price_stddev"),
    )


def insert_products(products: DataFrame, new_rows: DataFrame, order, as_of: datetime) -> DataFrame:
    rows = assign_keys(new_rows, order, "product_id", products).withColumns({
        "product_code": O.text_to_raw(c("product_code")), "is_active": O.nvl(c("is_active"), 1),
        "created_date": F.lit(as_of.date())})
    return append_aligned(products, rows)


def update_prices(products: DataFrame, category: str, change_rate: int) -> DataFrame:
    """Change the prices of a category's active products, rounded, 100 at least."""
    changed = F.round(c("unit_price") * F.lit(100 + change_rate).cast("decimal(5,0)") / 100, 0)
    return replace_columns(products, (c("category") == category) & (c("is_active") == 1),
                           {"unit_price": O.greatest(changed, F.lit(100))})


def sales_performance(products: DataFrame, items: DataFrame) -> DataFrame:
    # (product, order) first: the distinct count then needs no second copy of the lines
    per_order = items.groupBy("product_id", "order_id").agg(F.sum("quantity").alias("q"), F.sum(line_amount()).alias("r"))
    sums = per_order.groupBy("product_id").agg(F.sum("q").alias("q"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))
    sold = products.filter(c("is_active") == 1).join(sums, "product_id", "left").select(
        "product_id", "product_name", "category", O.nvl(c("q"), 0).alias("total_qty"),
        O.nvl(c("r"), F.lit(0)).alias("revenue"), O.nvl(c("n"), 0).alias("order_count"))
    tiled = ranked(sold, [], [("revenue", "desc")], ["product_id"], {"quartile": ("ntile", 4)})
    grade = F.element_at(F.array(*(F.lit(g) for g in L.SALES_GRADES)), c("quartile").cast("int"))
    return tiled.orderBy(c("revenue").desc(), "product_id").select(
        "product_id", "product_name", "category", "total_qty", O.format_amount(c("revenue")).alias("total_revenue"),
        "order_count", "quartile", grade.alias("grade"))


def code_list(codes: DataFrame, group: str) -> DataFrame:
    return codes.filter((c("code_group") == group) & (c("use_yn") == "Y")).orderBy("sort_order", "code_value").select(
        "code_value", "code_name", "description", "sort_order")
