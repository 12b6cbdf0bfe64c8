"""Registered queries: statements on customers and orders."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from cutover.functions import oracle as O
from cutover.plans.registry import query
from cutover.plans.sqltext import cents, half_up, krw, krw_half_up
from cutover.workload import customer, order
from cutover.workload.common import latest_per_key

c = F.col
AS_OF = datetime(2002, 1, 1, 9, 30)
TODAY = AS_OF.date()

TYPE_SQL = "case customer_type when 'P' then '개인' when 'B' then '기업' end"
STATUS_SQL = "case order_status when 'PENDING' then '대기' when 'CONFIRMED' then '확인' when 'SHIPPED' then '배송중' when 'DELIVERED' then '완료' when 'CANCELLED' then '취소' end"
LINE_SQL = "quantity * unit_price - coalesce(discount_amt, 0)"
DAY = "'%Y-%m-%d'"
SECOND = "'%Y-%m-%d %H:%M:%S'"


def full_months(d: str) -> str:
    """Whole months from ``d`` to the first of January 2002."""
    return f"((2002 * 12 + 1) - (year({d}) * 12 + month({d})) - case when day({d}) > 1 then 1 else 0 end)"


query("q01_customer_by_id", "customer_id:i customer_name:s email:s phone:s address:s customer_type:s credit_limit:s birth_date:s reg_date:s status:s", f"""
SELECT customer_id, customer_name, coalesce(email, '미등록') AS email, coalesce(phone, '미등록') AS phone,
  coalesce(address, '미등록') AS address, coalesce({TYPE_SQL}, '기타') AS customer_type, {krw('credit_limit')} AS credit_limit,
  strftime(birth_date, {DAY}) AS birth_date, strftime(reg_date, {SECOND}) AS reg_date, status
FROM customers""")(lambda t: customer.customer_by_id(t.customers))

query("q02_customer_list_page", "rnum:i customer_id:i customer_name:s contact_info:s customer_type:s credit_limit:s reg_date:s status:s", f"""
SELECT * FROM (SELECT row_number() OVER (ORDER BY customer_id DESC) AS rnum, customer_id, customer_name, coalesce(email, phone) AS contact_info,
  {TYPE_SQL} AS customer_type, {krw('credit_limit')} AS credit_limit, strftime(reg_date, {DAY}) AS reg_date, status
FROM customers WHERE status = 'ACTIVE' AND upper(customer_name) LIKE '%CUSTOMER%') WHERE rnum BETWEEN 11 AND 30
""")(lambda t: customer.customer_list(t.customers, 11, 30, status="ACTIVE", name="customer"))

_SEARCH = """SELECT customer_id, case when length(customer_name) <= 3 then customer_name else left(customer_name, 3) || repeat('*', length(customer_name) - 3) end AS customer_name,
  nullif(left(email, strpos(email, '@') - 1), '') AS email_id, replace(phone, '-', '') AS phone,
  lpad(cast(customer_id as varchar), 10, '0') AS customer_no, status FROM customers WHERE """
_SEARCH_COLS = "customer_id:i customer_name:s email_id:s phone:s customer_no:s status:s"
query("q03_search_customers_any", _SEARCH_COLS, _SEARCH + "upper(customer_name) LIKE '%7%' OR upper(email) LIKE '%7%'")(
    lambda t: customer.search_customers(t.customers, "7"))
query("q03_search_customers_by_phone", _SEARCH_COLS, _SEARCH + "replace(phone, '-', '') LIKE '%0100%'")(
    lambda t: customer.search_customers(t.customers, "010-0", "PHONE"))

query("q04_customer_detail", "customer_id:i customer_name:s email:s phone:s address:s customer_type_nm:s credit_limit_fmt:s birth_date:s age:i member_months:i reg_date:s grade_info:s order_count:i total_purchase:d total_purchase_fmt:s", f"""
SELECT c.customer_id, customer_name, email, phone, address,
  case customer_type when 'P' then '개인고객' when 'B' then '기업고객' end AS customer_type_nm, {krw('credit_limit')} AS credit_limit_fmt,
  strftime(birth_date, {DAY}) AS birth_date, floor({full_months('birth_date')} / 12) AS age, {full_months('reg_date')} AS member_months,
  strftime(reg_date, {SECOND}) AS reg_date, coalesce(memo, '등급 미산정') AS grade_info, coalesce(order_cnt, 0) AS order_count,
  coalesce(total_amt, 0) AS total_purchase, {krw('total_amt')} AS total_purchase_fmt
FROM customers c LEFT JOIN (SELECT customer_id, count(*) AS order_cnt, sum(total_amount) AS total_amt FROM shop_orders
  WHERE order_status <> 'CANCELLED' GROUP BY customer_id) o ON c.customer_id = o.customer_id
""")(lambda t: customer.customer_detail(t.customers, t.shop_orders, TODAY))


def new_customers(t):
    return t.supplier.select(
        c("s_suppkey").alias("n"), c("s_name").alias("customer_name"), F.lit(None).cast("string").alias("email"),
        F.lit("010-1").alias("phone"), F.lit(None).cast("string").alias("address"),
        F.expr("case when s_nationkey > 12 then 'B' end").alias("customer_type"),
        F.expr("case when s_acctbal > 0 then cast(s_acctbal as decimal(12,2)) end").alias("credit_limit"),
        F.expr("case when s_nationkey > 3 then '1980-02-29' end").alias("birth_date"))


query("q05_insert_customers", "customer_id:i customer_name:s phone:s customer_type:s credit_limit:d birth_date:s reg_date:s status:s", f"""
SELECT customer_id, customer_name, phone, customer_type, credit_limit, strftime(birth_date, {DAY}) AS birth_date, strftime(reg_date, {SECOND}) AS reg_date, status FROM customers
UNION ALL
SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name, '010-1', case when s_nationkey > 12 then 'B' else 'P' end,
  case when s_acctbal > 0 then cast(s_acctbal as decimal(12,2)) else 0 end, case when s_nationkey > 3 then '1980-02-29' end, '2002-01-01 09:30:00', 'ACTIVE' FROM supplier
""")(lambda t: customer.insert_customers(t.customers, new_customers(t), ["n"], AS_OF).withColumn(
    "birth_date", O.to_char_date(c("birth_date"))).withColumn("reg_date", O.to_char_date(c("reg_date"), "YYYY-MM-DD HH24:MI:SS")))

query("q05_insert_orders", "order_id:i customer_id:i order_date:s total_amount:d tax_amount:d discount_rate:d order_status:s payment_method:s created_at:s", f"""
SELECT order_id, customer_id, strftime(order_date, {DAY}) AS order_date, total_amount, tax_amount, discount_rate, order_status, payment_method, strftime(created_at, {SECOND}) AS created_at FROM shop_orders
UNION ALL
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey), c_custkey, '2002-01-01', 0, 0,
  case when c_nationkey > 9 then 2.5 else 0 end, 'PENDING', 'CARD', '2002-01-01 09:30:00' FROM customer
""")(lambda t: order.insert_orders(t.shop_orders, t.customer.select(
    c("c_custkey").alias("customer_id"), F.expr("case when c_nationkey > 9 then 2.5 end").alias("discount_rate"),
    F.lit("CARD").alias("payment_method"), F.lit(None).cast("string").alias("remarks")), ["customer_id"], AS_OF)
    .withColumn("order_date", O.to_char_date(c("order_date"))).withColumn("created_at", O.to_char_date(c("created_at"), "YYYY-MM-DD HH24:MI:SS")))


def limit_updates(t):
    """One bound update per customer with orders: the newest order's amount becomes the limit."""
    binds = t.orders.select(
        c("o_custkey").alias("customer_id"), c("o_orderkey").alias("seq"),
        F.concat(F.lit("Renamed "), c("o_custkey")).alias("customer_name"), F.lit(None).cast("string").alias("email"),
        F.lit("010-2").alias("phone"), c("o_orderpriority").alias("address"),
        F.expr("case when o_orderstatus <> 'F' then cast(o_totalprice as decimal(12,2)) end").alias("credit_limit"),
        F.expr("case when o_orderstatus = 'O' then '1970-12-31' end").alias("birth_date"))
    return latest_per_key(binds, ["customer_id"], "seq")


query("q06_update_customers", "customer_id:i customer_name:s email:s phone:s address:s credit_limit:d birth_date:s status:s upd_date:s", f"""
SELECT c.customer_id, case when hit then concat('Renamed ', c.customer_id) else customer_name end AS customer_name,
  case when hit then null else email end AS email, case when hit then '010-2' else phone end AS phone,
  case when hit then o_orderpriority else address end AS address,
  case when hit and o_orderstatus <> 'F' then cast(o_totalprice as decimal(12,2)) else credit_limit end AS credit_limit,
  case when hit and o_orderstatus = 'O' then '1970-12-31' else strftime(birth_date, {DAY}) end AS birth_date, status,
  case when hit then '2002-01-01 09:30:00' end AS upd_date
FROM (SELECT c.*, o.*, o.o_custkey IS NOT NULL AND status = 'ACTIVE' AS hit FROM customers c LEFT JOIN
  (SELECT * FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)) o ON o.o_custkey = c.customer_id) c
""")(lambda t: customer.update_customers(t.customers, limit_updates(t), AS_OF).withColumn(
    "birth_date", O.to_char_date(c("birth_date"))).withColumn("upd_date", O.to_char_date(c("upd_date"), "YYYY-MM-DD HH24:MI:SS")))

query("q07_deactivate_customers", "customer_id:i status:s changed:b", """
SELECT customer_id, case when done then 'INACTIVE' else status end AS status, done AS changed FROM (
  SELECT *, status = 'ACTIVE' AND NOT EXISTS (SELECT 1 FROM shop_orders o WHERE o.customer_id = c.customer_id AND order_status IN ('PENDING', 'CONFIRMED', 'SHIPPED')) AS done FROM customers c)
""")(lambda t: customer.deactivate_customers(t.customers, t.shop_orders, AS_OF).withColumn("changed", c("upd_date").isNotNull()))

query("q08_delete_customers", "customer_id:i status:s memo:s", r"""
SELECT customer_id, case when hit then 'SUSPENDED' else status end AS status,
  case when hit then coalesce(memo, '') || chr(10) || '[삭제] 2002-01-01 09:30 삭제 처리' else memo end AS memo
FROM (SELECT *, NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.customer_id AND o.o_orderstatus = 'P') AS hit FROM customers c)
""")(lambda t: customer.delete_customers(t.customers, AS_OF, t.customer.select(c("c_custkey").alias("customer_id")).join(
    t.orders.filter(c("o_orderstatus") == "P").select(c("o_custkey").alias("customer_id")), "customer_id", "left_anti")))

query("q08_cancel_orders", "order_id:i order_status:s remarks:s", r"""
SELECT order_id, case when hit then 'CANCELLED' else order_status end AS order_status,
  case when hit then coalesce(remarks, '') || chr(10) || '[취소] 2002-01-01 09:30 ' || case when total_amount > 200000 then 'price' else '사유 미입력' end else remarks end AS remarks
FROM (SELECT *, total_amount > 100000 AND order_status IN ('PENDING', 'CONFIRMED') AS hit FROM shop_orders)
""")(lambda t: order.cancel_orders(t.shop_orders, AS_OF, t.shop_orders.filter(c("total_amount") > 100000).select(
    "order_id", F.expr("case when total_amount > 200000 then 'price' end").alias("cancel_reason"))))

query("q09_customer_stats_rollup", "customer_type:s status:s type_is_total:i status_is_total:i cnt:i total_credit:d", f"""
SELECT case when grouping(type_label) = 1 then '합계' else type_label end AS customer_type, case when grouping(status) = 1 then '소계' else status end AS status,
  grouping(type_label) AS type_is_total, grouping(status) AS status_is_total, count(*) AS cnt, sum(coalesce(credit_limit, 0)) AS total_credit
FROM (SELECT {TYPE_SQL} AS type_label, status, credit_limit FROM customers) GROUP BY ROLLUP (type_label, status)
""")(lambda t: customer.customer_stats(t.customers))

query("q10_customer_order_summary", "customer_id:i customer_name:s part_no:i order_count:i total_purchase:s order_id_list:s order_date_list:s first_order:s last_order:s avg_order_amt:d", f"""
SELECT c.customer_id, customer_name, coalesce(part_no, 1) AS part_no, coalesce(order_count, 0) AS order_count, {krw('total')} AS total_purchase,
  order_id_list, order_date_list, strftime(first_order, {DAY}) AS first_order, strftime(last_order, {DAY}) AS last_order, {half_up(cents('total'), 'CAST(order_count AS HUGEINT) * 100', 2)} AS avg_order_amt
FROM customers c LEFT JOIN (SELECT customer_id, count(*) AS order_count, sum(total_amount) AS total, min(order_date) AS first_order, max(order_date) AS last_order
    FROM shop_orders WHERE order_status <> 'CANCELLED' GROUP BY customer_id) s ON s.customer_id = c.customer_id
  LEFT JOIN (SELECT customer_id, part_no, string_agg(cast(order_id as varchar), ', ' ORDER BY rn) AS order_id_list, string_agg(strftime(order_date, '%m/%d'), ', ' ORDER BY rn) AS order_date_list
    FROM (SELECT *, (rn - 1) // 10000 + 1 AS part_no FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS rn
      FROM shop_orders WHERE order_status <> 'CANCELLED')) GROUP BY customer_id, part_no) l ON l.customer_id = c.customer_id
""")(lambda t: customer.customer_order_summary(t.customers, t.shop_orders))

query("q11_order_by_id", "order_id:i customer_id:i customer_name:s order_date:s ship_date:s total_amount:s tax_amount:s net_amount:s discount_rate:s order_status:s payment_method:s remarks:s calculated_total:d created_at:s", f"""
SELECT o.order_id, o.customer_id, customer_name, strftime(order_date, {DAY}) AS order_date, strftime(ship_date, {DAY}) AS ship_date,
  {krw('total_amount')} AS total_amount, {krw('tax_amount')} AS tax_amount, {krw('total_amount - coalesce(tax_amount, 0)')} AS net_amount,
  concat(cast(discount_rate as integer), '%') AS discount_rate, coalesce({STATUS_SQL}, '알수없음') AS order_status, coalesce(payment_method, '미정') AS payment_method,
  remarks, coalesce(total, 0) AS calculated_total, strftime(created_at, {SECOND}) AS created_at
FROM shop_orders o JOIN customers c ON o.customer_id = c.customer_id
  LEFT JOIN (SELECT order_id, sum({LINE_SQL}) AS total FROM order_items GROUP BY order_id) i ON i.order_id = o.order_id
""")(lambda t: order.order_by_id(t.shop_orders, t.customers, t.order_items))

query("q12_order_list_page", "rnum:i order_id:i customer_name:s order_date:s total_amount:s order_status:s payment_method:s item_count:i", f"""
SELECT rnum, order_id, customer_name, strftime(order_date, {DAY}) AS order_date, {krw('total_amount')} AS total_amount, order_status, coalesce(payment_method, '-') AS payment_method,
  (SELECT count(*) FROM order_items i WHERE i.order_id = p.order_id) AS item_count
FROM (SELECT row_number() OVER (ORDER BY order_date DESC, order_id DESC) AS rnum, o.*, customer_name FROM shop_orders o JOIN customers c ON c.customer_id = o.customer_id
  WHERE order_date >= date '1996-01-01' AND order_date <= date '2000-12-31' AND order_status = 'DELIVERED') p WHERE rnum BETWEEN 21 AND 60
""")(lambda t: order.order_list(t.shop_orders, t.customers, t.order_items, 21, 60, date(1996, 1, 1), date(2000, 12, 31), "DELIVERED"))

query("q13_order_items", "order_id:i item_seq:i product_name:s category:s quantity:i unit_price:s discount_amt:s line_total:s discount_pct:d", f"""
SELECT order_id, item_seq, product_name, category, quantity, {krw('i.unit_price')} AS unit_price, {krw('discount_amt')} AS discount_amt,
  {krw('quantity * i.unit_price - coalesce(discount_amt, 0)')} AS line_total,
  {half_up(cents('coalesce(discount_amt, 0)') + ' * 100', 'nullif(quantity * ' + cents('i.unit_price') + ', 0)', 1)} AS discount_pct
FROM order_items i JOIN products p ON i.product_id = p.product_id
""")(lambda t: order.order_items(t.order_items, t.products))


def new_lines(t):
    """Two more lines for every order."""
    lines = t.orders.select(
        c("o_orderkey").alias("order_id"), F.expr("o_custkey % 200").alias("product_id"),
        F.explode(F.array(F.lit(3), F.lit(5)).cast("array<bigint>")).alias("quantity"))
    return lines.withColumn("discount_amt", F.expr("case when quantity = 5 then cast(1.5 as decimal(10,2)) end"))


query("q14_insert_order_items", "order_id:i item_seq:i product_id:i quantity:i unit_price:d discount_amt:d", """
SELECT order_id, item_seq, product_id, quantity, unit_price, discount_amt FROM order_items
UNION ALL
SELECT o_orderkey, coalesce(top, 0) + n, p_partkey, qty, p_retailprice, case when qty = 5 then 1.5 else 0 end
FROM (SELECT o_orderkey, o_custkey % 200 AS product_id, unnest([1, 2]) AS n, unnest([3, 5]) AS qty FROM orders) x
  LEFT JOIN part ON p_partkey = product_id LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS top FROM lineitem GROUP BY l_orderkey) i ON l_orderkey = o_orderkey
""")(lambda t: order.insert_order_items(t.order_items, t.products, new_lines(t), ["quantity"]))

query("q15_recalculate_totals", "order_id:i total_amount:d tax_amount:d order_status:s", f"""
SELECT o.order_id, coalesce(total, 0) AS total_amount, {half_up(cents('coalesce(total, 0)'), '1000', 2)} AS tax_amount, order_status
FROM shop_orders o LEFT JOIN (SELECT order_id, sum({LINE_SQL}) AS total FROM order_items GROUP BY order_id) i ON i.order_id = o.order_id
""")(lambda t: order.recalculate_totals(t.shop_orders, t.order_items, AS_OF))

query("q16_update_status", "order_id:i order_status:s ship_date:s", f"""
SELECT order_id, case when hit then new_status else order_status end AS order_status,
  strftime(case when hit and new_status = 'SHIPPED' and ship_date is null then date '2002-01-01' else ship_date end, {DAY}) AS ship_date
FROM (SELECT *, case when total_amount > 250000 then 'SHIPPED' else 'CONFIRMED' end AS new_status, total_amount > 50000 and order_status <> 'CANCELLED' AS hit FROM shop_orders)
""")(lambda t: order.update_status(t.shop_orders, t.shop_orders.filter(c("total_amount") > 50000).select(
    "order_id", F.when(c("total_amount") > 250000, "SHIPPED").otherwise("CONFIRMED").alias("new_status")), AS_OF)
    .withColumn("ship_date", O.to_char_date(c("ship_date"))))


def _monthly(where: str) -> str:
    return f"""
SELECT case when grouping(m) = 1 then '합계' else m end AS sales_month, count(*) AS order_count, sum(total_amount) AS total_sales, {krw('sum(total_amount)')} AS total_sales_fmt,
  {krw_half_up('((2 * ' + cents('sum(total_amount)') + ' + count(*)) // (2 * count(*)))', '100')} AS avg_order,
  {krw('max(total_amount)')} AS max_order, {krw('min(total_amount)')} AS min_order
FROM (SELECT strftime(order_date, '%Y-%m') AS m, total_amount FROM shop_orders WHERE order_status <> 'CANCELLED' {where}) GROUP BY ROLLUP (m)"""


_MONTHLY_COLS = "sales_month:s order_count:i total_sales:d total_sales_fmt:s avg_order:s max_order:s min_order:s"
query("q17_monthly_sales_rollup", _MONTHLY_COLS, _monthly(""))(lambda t: order.monthly_sales(t.shop_orders))
query("q17_monthly_sales_of_year", _MONTHLY_COLS, _monthly("AND year(order_date) = 1998"))(lambda t: order.monthly_sales(t.shop_orders, 1998))

query("q18_sales_ranking", "order_id:i customer_name:s order_date:s total_amount:d rn:i sales_rank:i prev_order_amt:d next_order_amt:d running_total:d sales_pct:d", f"""
SELECT order_id, customer_name, strftime(order_date, {DAY}) AS order_date, total_amount, row_number() OVER (ORDER BY total_amount DESC, order_id) AS rn,
  rank() OVER (ORDER BY total_amount DESC) AS sales_rank, lag(total_amount) OVER w AS prev_order_amt, lead(total_amount) OVER w AS next_order_amt,
  sum(total_amount) OVER (ORDER BY order_date, order_id ROWS UNBOUNDED PRECEDING) AS running_total,
  {half_up(cents('total_amount') + ' * 100', cents('sum(total_amount) OVER ()'), 2)} AS sales_pct
FROM shop_orders o JOIN customers c ON c.customer_id = o.customer_id WHERE order_status = 'DELIVERED' WINDOW w AS (ORDER BY order_date, order_id)
""")(lambda t: order.sales_ranking(t.shop_orders, t.customers))

query("q19_sales_by_category", "sales_month:s elec_sales:d food_sales:d cloth_sales:d book_sales:d total_sales:d", """
SELECT strftime(order_date, '%Y-%m') AS sales_month, """ + ", ".join(
    f"sum(case when category = '{x}' then quantity * i.unit_price else 0 end) AS {x.lower()}_sales" for x in ("ELEC", "FOOD", "CLOTH", "BOOK")) + """,
  sum(quantity * i.unit_price) AS total_sales FROM shop_orders o JOIN order_items i ON o.order_id = i.order_id JOIN products p ON p.product_id = i.product_id
WHERE order_status <> 'CANCELLED' GROUP BY 1
""")(lambda t: order.sales_by_category(t.shop_orders, t.order_items, t.products))


def order_changes(t):
    """Changes for the dearer half of the orders, and one order per customer that is not there yet."""
    known = t.shop_orders.filter(c("total_amount") > 250000).select(
        "order_id", "customer_id", (c("total_amount") + 10).alias("total_amount"),
        F.expr("case when total_amount > 400000 then 'SHIPPED' end").alias("order_status"),
        F.lit("BANK").alias("payment_method"), F.lit(None).cast("string").alias("remarks"))
    new = t.customer.select(
        (-c("c_custkey") - 1).alias("order_id"), c("c_custkey").alias("customer_id"),
        F.expr("cast(abs(c_acctbal) as decimal(14,2))").alias("total_amount"), F.lit(None).cast("string").alias("order_status"),
        F.lit("CARD").alias("payment_method"), F.lit("new").alias("remarks"))
    return known.unionByName(new)


query("q20_merge_orders", "order_id:i customer_id:i total_amount:d tax_amount:d order_status:s remarks:s payment_method:s", f"""
SELECT order_id, customer_id, case when total_amount > 250000 then total_amount + 10 else total_amount end AS total_amount,
  case when total_amount > 250000 then {half_up(cents('total_amount + 10'), '1000', 2)} else tax_amount end AS tax_amount,
  case when total_amount > 400000 then 'SHIPPED' else order_status end AS order_status, remarks, payment_method FROM shop_orders
UNION ALL
SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey DESC), c_custkey, abs(cast(c_acctbal as decimal(14,2))),
  {half_up(cents('abs(cast(c_acctbal as decimal(14,2)))'), '1000', 2)}, 'PENDING', 'new', 'CARD' FROM customer
""")(lambda t: order.merge_orders(t.shop_orders, order_changes(t), ["order_id"], AS_OF))

query("q21_daily_sales_calendar", "sale_date:s day_name:s order_count:i total_sales:s", f"""
SELECT strftime(d, {DAY}) AS sale_date, ['일','월','화','수','목','금','토'][dayofweek(d) + 1] AS day_name, coalesce(order_cnt, 0) AS order_count, {krw('total_amt')} AS total_sales
FROM (SELECT cast(unnest(generate_series(date '1994-12-25', date '2001-12-31', interval 1 day)) as date) AS d) LEFT JOIN
  (SELECT order_date, count(*) AS order_cnt, sum(total_amount) AS total_amt FROM shop_orders WHERE order_status <> 'CANCELLED' GROUP BY order_date) ON d = order_date
""")(lambda t: order.daily_sales(t.shop_orders, date(1994, 12, 25), date(2001, 12, 31)))

query("q22_latest_order_by_customer", "customer_id:i customer_name:s order_id:i order_date:s total_amount:d order_status:s greater_amt:d lesser_amt:d", f"""
SELECT customer_id, customer_name, order_id, strftime(order_date, {DAY}) AS order_date, total_amount, order_status,
  greatest(total_amount, coalesce(tax_amount, 0)) AS greater_amt, least(total_amount, coalesce(credit_limit, 0)) AS lesser_amt
FROM (SELECT o.*, customer_name, credit_limit, row_number() OVER (PARTITION BY o.customer_id ORDER BY order_date DESC, order_id DESC) AS rn
  FROM shop_orders o JOIN customers c ON c.customer_id = o.customer_id WHERE order_status <> 'CANCELLED') WHERE rn = 1
""")(lambda t: order.latest_order_by_customer(t.customers, t.shop_orders))
