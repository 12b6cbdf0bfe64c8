"""Registered queries: employees, products, views, procedures and check statements."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from cutover.functions import oracle as O
from cutover.operators.ordered import ranked
from cutover.plans.q_customer_order import AS_OF, DAY, LINE_SQL, SECOND, STATUS_SQL, TODAY, TYPE_SQL, full_months
from cutover.plans.registry import query
from cutover.plans.sqltext import cents, half_up, krw, krw_half_up
from cutover.workload import customer, employee, order, product, views

c = F.col

query("q23_employee_by_id", "employee_id:i employee_name:s department:s position_title:s hire_date:s years_worked:i salary:s commission:s total_compensation:s manager_name:s email:s phone_ext:s", f"""
SELECT e.employee_id, e.employee_name, e.department, e.position_title, strftime(e.hire_date, {DAY}) AS hire_date,
  floor({full_months('e.hire_date')} / 12) AS years_worked, {krw('e.salary')} AS salary,
  concat(cast(coalesce(e.commission_pct, 0) * 100 as integer), '%') AS commission, {krw('e.salary * (1 + coalesce(e.commission_pct, 0))')} AS total_compensation,
  coalesce(m.employee_name, '(최상위)') AS manager_name, e.email, e.phone_ext
FROM employees e LEFT JOIN employees m ON e.manager_id = m.employee_id
""")(lambda t: employee.employee_by_id(t.employees, TODAY))

query("q24_org_chart", "employee_id:i employee_name:s department:s position_title:s manager_id:i org_level:i org_tree:s full_path:s is_leaf:i", """
WITH RECURSIVE tree AS (
  SELECT employee_id, 1 AS lvl, ' > ' || employee_name AS path FROM employees WHERE manager_id IS NULL
  UNION ALL SELECT e.employee_id, lvl + 1, path || ' > ' || e.employee_name FROM employees e JOIN tree ON e.manager_id = tree.employee_id)
SELECT e.employee_id, employee_name, department, position_title, manager_id, lvl AS org_level, repeat(' ', (lvl - 1) * 4) || employee_name AS org_tree,
  path AS full_path, case when e.employee_id in (SELECT manager_id FROM employees WHERE manager_id IS NOT NULL) then 0 else 1 end AS is_leaf
FROM tree JOIN employees e ON e.employee_id = tree.employee_id
""")(lambda t: employee.org_chart(t.employees))

query("q25_subordinates", "employee_id:i employee_name:s department:s position_title:s depth:i tree_view:s", """
WITH RECURSIVE tree AS (
  SELECT employee_id, 1 AS lvl FROM employees WHERE employee_id = 0
  UNION ALL SELECT e.employee_id, lvl + 1 FROM employees e JOIN tree ON e.manager_id = tree.employee_id)
SELECT e.employee_id, employee_name, department, position_title, lvl - 1 AS depth,
  case when lvl = 1 then '' else lpad('└─ ', (lvl - 1) * 3, ' ') end || employee_name AS tree_view
FROM tree JOIN employees e ON e.employee_id = tree.employee_id
""")(lambda t: employee.subordinates(t.employees, 0))

query("q26_dept_salary_stats", "department:s is_total:i emp_count:i avg_salary:s min_salary:s max_salary:s total_salary:s total_commission:s", f"""
SELECT case when grouping(department) = 1 then '전체' else department end AS department, grouping(department) AS is_total, count(*) AS emp_count,
  {krw_half_up(cents('sum(salary)'), 'CAST(count(salary) AS HUGEINT) * 100')} AS avg_salary, {krw('min(salary)')} AS min_salary, {krw('max(salary)')} AS max_salary,
  {krw('sum(salary)')} AS total_salary, {krw('sum(salary * coalesce(commission_pct, 0))')} AS total_commission
FROM employees GROUP BY ROLLUP (department)
""")(lambda t: employee.dept_salary_stats(t.employees))

query("q27_dept_employee_list", "department:s part_no:i emp_count:i member_list:s", """
SELECT department, (rn - 1) // 10000 + 1 AS part_no, any_value(n) AS emp_count, string_agg(employee_name || '(' || coalesce(position_title, '') || ')', ', ' ORDER BY rn) AS member_list
FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY salary DESC NULLS FIRST, employee_id) AS rn, count(*) OVER (PARTITION BY department) AS n FROM employees)
GROUP BY 1, 2
""")(lambda t: employee.dept_employee_list(t.employees))

query("q28_salary_ranking", "employee_id:i employee_name:s department:s position_title:s salary:d salary_rank:i dept_rank:i percentile:d cumulative_pct:d salary_tier:i", """
SELECT employee_id, employee_name, department, position_title, salary, dense_rank() OVER (ORDER BY salary DESC) AS salary_rank,
  dense_rank() OVER (PARTITION BY department ORDER BY salary DESC) AS dept_rank, round(percent_rank() OVER (ORDER BY salary) * 100, 1) AS percentile,
  round(cume_dist() OVER (ORDER BY salary) * 100, 1) AS cumulative_pct, ntile(3) OVER (ORDER BY salary DESC, employee_id) AS salary_tier FROM employees
""")(lambda t: employee.salary_ranking(t.employees))

query("q05_insert_employees", "employee_id:i employee_name:s department:s hire_date:s salary:d manager_id:i", f"""
SELECT employee_id, employee_name, department, strftime(hire_date, {DAY}) AS hire_date, salary, manager_id FROM employees
UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey), c_name, 'NEW', case when c_nationkey > 10 then '2001-05-06' else '2002-01-01' end, cast(c_acctbal as decimal(12,2)), 0 FROM customer
""")(lambda t: employee.insert_employees(t.employees, t.customer.select(
    c("c_custkey").alias("n"), c("c_name").alias("employee_name"), F.lit("NEW").alias("department"), F.lit(None).cast("string").alias("position_title"),
    F.expr("case when c_nationkey > 10 then '2001-05-06' end").alias("hire_date"), F.expr("cast(c_acctbal as decimal(12,2))").alias("salary"),
    F.lit(None).cast("decimal(4,2)").alias("commission_pct"), F.lit(0).alias("manager_id")), ["n"], AS_OF)
    .withColumn("hire_date", O.to_char_date(c("hire_date"))))

query("q29_update_salary", "employee_id:i salary:d commission_pct:d", """
SELECT employee_id, greatest(sign(salary) * ((abs(cast(salary * 100 as hugeint)) * 107 + 5000000) // 10000000) * 1000, salary) AS salary,
  least(coalesce(commission_pct, 0) + 0.02, 0.30) AS commission_pct FROM employees
""")(lambda t: employee.update_salary(t.employees, 7, "Y"))

_AUDIT_COLS = "log_id:i table_name:s operation:s old_value_short:s new_value_short:s changed_by:s changed_at:s"
_AUDIT = f"""SELECT log_id, table_name, operation, left(old_value, 200) AS old_value_short, left(new_value, 200) AS new_value_short,
  coalesce(changed_by, 'SYSTEM') AS changed_by, strftime(changed_at, {SECOND}) AS changed_at FROM audit_log """
query("q30_audit_log_all", _AUDIT_COLS, _AUDIT)(lambda t: employee.audit_entries(t.audit_log))
query("q30_audit_log_range", _AUDIT_COLS, _AUDIT + "WHERE table_name = 'ORDERS' AND changed_at >= timestamp '2024-01-02' AND changed_at <= timestamp '2024-01-05 23:59:59'")(
    lambda t: employee.audit_entries(t.audit_log, "ORDERS", date(2024, 1, 2), date(2024, 1, 5)))

query("q31_product_by_id", "product_id:i product_name:s category:s unit_price:s weight:d product_code_str:s description:s status:s created_date:s", f"""
SELECT product_id, product_name, coalesce(category, '미분류') AS category, {krw('unit_price')} AS unit_price, weight, decode(product_code) AS product_code_str,
  coalesce(description, '설명 없음') AS description, case is_active when 1 then '판매중' when 0 then '판매중지' else '알수없음' end AS status, strftime(created_date, {DAY}) AS created_date
FROM products
""")(lambda t: product.product_by_id(t.products))

query("q32_search_products", "product_id:i product_name:s category:s unit_price:s description_clean:s", f"""
SELECT product_id, product_name, category, {krw('unit_price')} AS unit_price, regexp_replace(description, '\\s+', ' ', 'g') AS description_clean
FROM products WHERE is_active = 1 AND (regexp_matches(product_name, 'BLUE|ring$', 'i') OR regexp_matches(coalesce(description, ''), 'BLUE|ring$', 'i'))
  AND category = 'FOOD' AND unit_price >= 901 AND unit_price <= 1090
""")(lambda t: product.search_products(t.products, "BLUE|ring$", "FOOD", 901, 1090, "PRICE_DESC"))

query("q33_products_by_category", "category_nm:s category:s product_count:i avg_price:s min_price:s max_price:s price_stddev:d", f"""
SELECT case category when 'ELEC' then '전자제품' when 'FOOD' then '식품' when 'CLOTH' then '의류' when 'BOOK' then '도서' else '기타' end AS category_nm, category, count(*) AS product_count,
  {krw_half_up(cents('sum(unit_price)'), 'CAST(count(*) AS HUGEINT) * 100')} AS avg_price, {krw('min(unit_price)')} AS min_price, {krw('max(unit_price)')} AS max_price,
  round(sqrt(case when count(*) = 1 then 0 else var_samp(unit_price) end), 2) AS price_stddev
FROM products WHERE is_active = 1 GROUP BY category HAVING count(*) >= 1
""")(lambda t: product.products_by_category(t.products))

query("q05_insert_products", "product_id:i product_name:s unit_price:d product_code_str:s is_active:i created_date:s", f"""
SELECT product_id, product_name, unit_price, decode(product_code) AS product_code_str, is_active, strftime(created_date, {DAY}) AS created_date FROM products
UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY s_suppkey), s_name, abs(cast(s_acctbal as decimal(10,2))), concat('C', s_nationkey), case when s_nationkey > 20 then 0 else 1 end, '2002-01-01' FROM supplier
""")(lambda t: product.insert_products(t.products, t.supplier.select(
    c("s_suppkey").alias("n"), c("s_name").alias("product_name"), F.lit("ELEC").alias("category"), F.expr("abs(cast(s_acctbal as decimal(10,2)))").alias("unit_price"),
    F.lit(1.0).alias("weight"), F.expr("concat('C', s_nationkey)").alias("product_code"), F.lit(None).cast("string").alias("description"),
    F.expr("case when s_nationkey > 20 then 0 end").alias("is_active")), ["n"], AS_OF)
    .withColumn("product_code_str", O.raw_to_text(c("product_code"))).withColumn("created_date", O.to_char_date(c("created_date"))))

query("q34_update_prices", "product_id:i unit_price:d", """
SELECT product_id, case when category = 'FOOD' and is_active = 1 then greatest((cast(unit_price * 100 as hugeint) * 2 * 13 + 10000) // 20000, 100) else unit_price end AS unit_price FROM products
""")(lambda t: product.update_prices(t.products, "FOOD", -87))

query("q35_sales_performance", "product_id:i product_name:s category:s total_qty:i total_revenue:s order_count:i quartile:i grade:s", f"""
SELECT product_id, product_name, category, total_qty, {krw('revenue')} AS total_revenue, order_count, quartile, ['A등급', 'B등급', 'C등급', 'D등급'][quartile] AS grade FROM (
  SELECT p.product_id, product_name, category, coalesce(q, 0) AS total_qty, coalesce(r, 0) AS revenue, coalesce(n, 0) AS order_count, ntile(4) OVER (ORDER BY coalesce(r, 0) DESC, p.product_id) AS quartile
  FROM products p LEFT JOIN (SELECT product_id, sum(quantity) AS q, sum({LINE_SQL}) AS r, count(DISTINCT order_id) AS n FROM order_items GROUP BY product_id) s ON p.product_id = s.product_id WHERE is_active = 1)
""")(lambda t: product.sales_performance(t.products, t.order_items))

query("q36_code_list", "code_value:s code_name:s description:s sort_order:i", """
SELECT code_value, code_name, description, sort_order FROM code_master WHERE code_group = 'NATION' AND use_yn = 'Y'
""")(lambda t: product.code_list(t.code_master, "NATION"))

query("q37_order_summary_view", "order_id:i customer_name:s cust_type:s order_date_str:s total_amount:d tax_amount:d net_amount:d order_status:s status_kr:s amount_rank:i", f"""
SELECT order_id, customer_name, coalesce({TYPE_SQL}, '기타') AS cust_type, strftime(order_date, {DAY}) AS order_date_str, total_amount, coalesce(tax_amount, 0) AS tax_amount,
  total_amount - coalesce(tax_amount, 0) AS net_amount, order_status, {STATUS_SQL} AS status_kr, rank() OVER (PARTITION BY o.customer_id ORDER BY total_amount DESC) AS amount_rank
FROM shop_orders o JOIN customers c ON o.customer_id = c.customer_id
""")(lambda t: views.order_summary(t.shop_orders, t.customers))

query("q38_product_sales_view", "product_id:i product_name:s category:s list_price:d total_qty_sold:i total_revenue:d order_count:i avg_sell_price:d revenue_pct:d", f"""
SELECT p.product_id, product_name, category, p.unit_price AS list_price, coalesce(q, 0) AS total_qty_sold, coalesce(r, 0) AS total_revenue, coalesce(n, 0) AS order_count,
  coalesce({half_up(cents('ps'), 'cnt * 100', 2)}, 0) AS avg_sell_price, {half_up(cents('coalesce(r, 0)') + ' * 100', cents('sum(coalesce(r, 0)) OVER ()'), 2)} AS revenue_pct
FROM products p LEFT JOIN (SELECT product_id, sum(quantity) AS q, sum(quantity * unit_price) AS r, count(DISTINCT order_id) AS n, sum(unit_price) AS ps, CAST(count(*) AS HUGEINT) AS cnt FROM order_items GROUP BY product_id) s ON p.product_id = s.product_id
""")(lambda t: views.product_sales(t.products, t.order_items))

query("q39_update_grades", "customer_id:i memo:s status:s", f"""
SELECT c.customer_id, case when status = 'ACTIVE' then (case when coalesce(b, 0) >= 10000000 then 'VIP' when coalesce(b, 0) >= 5000000 then 'GOLD' when coalesce(b, 0) >= 1000000 then 'SILVER' else 'BRONZE' end)
  || ' (총 구매: ' || {krw('b')} || ')' else memo end AS memo, status
FROM customers c LEFT JOIN (SELECT customer_id, sum(total_amount) AS b FROM shop_orders WHERE order_date >= date '1999-06-30' AND order_status = 'DELIVERED' GROUP BY customer_id) o ON o.customer_id = c.customer_id
""")(lambda t: views.update_grades(t.customers, t.shop_orders, datetime(2000, 6, 30)))

query("q40_customer_info", "customer_id:i info:s", f"""
SELECT customer_id, customer_name || ' (' || coalesce({TYPE_SQL}, '') || ') ' || coalesce(email, '-') || ' / ' || coalesce(phone, '-') || ' / 신용한도: ' || {krw('credit_limit')} AS info FROM customers
""")(lambda t: views.customer_info(t.customers))

query("q40_find_customers", "customer_id:i customer_name:s email:s phone:s status:s", """
SELECT customer_id, customer_name, email, phone, status FROM customers WHERE upper(customer_name) LIKE '%99%' OR upper(email) LIKE '%99%'
""")(lambda t: views.find_customers(t.customers, "99"))


def _audited(t):
    moved = order.update_status(t.shop_orders, t.shop_orders.filter(c("total_amount") > 250000).select("order_id", F.lit("SHIPPED").alias("new_status")), AS_OF)
    grown = customer.insert_customers(t.customers, t.supplier.select(
        c("s_suppkey").alias("n"), c("s_name").alias("customer_name"), *(F.lit(None).cast("string").alias(x) for x in ("email", "phone", "address", "customer_type", "birth_date")),
        F.lit(None).cast("decimal(12,2)").alias("credit_limit")), ["n"], AS_OF)
    return views.audit_rows(t.audit_log, t.shop_orders, moved, t.customers, grown, "SYSTEM", AS_OF).withColumn(
        "changed_at", O.to_char_date(c("changed_at"), "YYYY-MM-DD HH24:MI:SS"))


query("q41_audit_rows", "log_id:i table_name:s operation:s old_value:s new_value:s changed_by:s changed_at:s", """
SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY table_name, k) AS log_id, table_name, operation, old_value, new_value, 'SYSTEM' AS changed_by, '2002-01-01 09:30:00' AS changed_at FROM (
  SELECT 'ORDERS' AS table_name, 'UPDATE' AS operation, concat('ORDER_ID=', order_id, ', STATUS=', order_status) AS old_value, concat('ORDER_ID=', order_id, ', STATUS=SHIPPED') AS new_value, order_id AS k
  FROM shop_orders WHERE total_amount > 250000 AND order_status NOT IN ('CANCELLED', 'SHIPPED')
  UNION ALL SELECT 'CUSTOMERS', 'INSERT', null, concat('CUSTOMER_ID=', id, ', NAME=', s_name), id
  FROM (SELECT s_name, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS id FROM supplier))
""")(_audited)

query("q42_check_strings_customer", "customer_id:i masked_name:s email:s type:s reg_date:s", f"""
SELECT customer_id, case when length(customer_name) <= 3 then customer_name else left(customer_name, 3) || repeat('*', length(customer_name) - 3) end AS masked_name, coalesce(email, 'N/A') AS email,
  case customer_type when 'P' then 'Personal' when 'B' then 'Business' else 'Unknown' end AS type, strftime(reg_date, {SECOND}) AS reg_date FROM customers
""")(lambda t: views.check_strings_customer(t.customers))

query("q42_check_strings_product", "product_id:i short_name:s category_lower:s desc_no_space:s trimmed_name:s first_space_pos:i", """
SELECT product_id, upper(left(product_name, 10)) AS short_name, lower(category) AS category_lower, replace(description, ' ', '_') AS desc_no_space, trim(product_name) AS trimmed_name, strpos(product_name, ' ') AS first_space_pos FROM products
""")(lambda t: views.check_strings_product(t.products))

query("q43_check_numbers", "order_id:i total_amount:d net_amount:d ceil_10k:i floor_10k:i mod_3:i diff_from_1m:d", f"""
SELECT order_id, total_amount, {half_up(cents('total_amount') + ' * 10', '1100', 2)} AS net_amount, ceil(total_amount / 10000) AS ceil_10k, floor(total_amount / 10000) AS floor_10k, order_id % 3 AS mod_3, abs(total_amount - 1000000) AS diff_from_1m FROM shop_orders
""")(lambda t: views.check_numbers(t.shop_orders))

query("q44_check_dates", "order_id:i order_date:s plus_3m:s months_ago:d month_end:s next_mon:s ord_year:i ord_month:i", f"""
SELECT order_id, strftime(order_date, {DAY}) AS order_date, strftime(case when order_date = last_day(order_date) then last_day(order_date + interval 3 month) else order_date + interval 3 month end, {DAY}) AS plus_3m,
  round((2002 * 12 + 1) - (year(order_date) * 12 + month(order_date)) + (1 - day(order_date)) / 31.0, 6) AS months_ago, strftime(last_day(order_date), {DAY}) AS month_end,
  strftime(order_date + cast(8 - isodow(order_date) as integer), {DAY}) AS next_mon, year(order_date) AS ord_year, month(order_date) AS ord_month FROM shop_orders
""")(lambda t: views.check_dates(t.shop_orders, TODAY).withColumns({
    **{x: O.to_char_date(c(x)) for x in ("order_date", "plus_3m", "month_end", "next_mon")}, "months_ago": F.round("months_ago", 6)}))

query("q45_check_windows", "order_id:i customer_id:i total_amount:d rn:i rnk:i drnk:i prev_amount:d next_amount:d running_total:d", """
SELECT order_id, customer_id, total_amount, row_number() OVER (ORDER BY total_amount DESC, order_id) AS rn, rank() OVER (ORDER BY total_amount DESC) AS rnk, dense_rank() OVER (ORDER BY total_amount DESC) AS drnk,
  lag(total_amount) OVER w AS prev_amount, lead(total_amount) OVER w AS next_amount, sum(total_amount) OVER (ORDER BY order_date, order_id ROWS UNBOUNDED PRECEDING) AS running_total
FROM shop_orders WINDOW w AS (ORDER BY order_date, order_id)
""")(lambda t: views.check_windows(t.shop_orders))

query("q46_check_lists", "customer_id:i part_no:i order_list:s", """
SELECT customer_id, (rn - 1) // 10000 + 1 AS part_no, string_agg(cast(order_id as varchar), ', ' ORDER BY rn) AS order_list
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS rn FROM shop_orders) GROUP BY 1, 2
""")(lambda t: views.check_lists(t.shop_orders))

# the path for large groups, and lists that go on in further parts
query("q46_check_lists_in_parts", "customer_id:i part_no:i order_list:s", """
SELECT customer_id, (rn - 1) // 4 + 1 AS part_no, string_agg(cast(order_id as varchar), ', ' ORDER BY rn) AS order_list
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date, order_id) AS rn FROM shop_orders) GROUP BY 1, 2
""")(lambda t: views.check_lists(t.shop_orders, part_rows=4))

query("q45_windows_by_segment", "order_id:i order_status:s rn:i rnk:i drnk:i pr:d cd:d tile:i n:i prev_amount:d next_amount:d running_total:d total:d", """
SELECT order_id, order_status, row_number() OVER w AS rn, rank() OVER v AS rnk, dense_rank() OVER v AS drnk, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd, ntile(7) OVER w AS tile,
  count(*) OVER (PARTITION BY order_status) AS n, lag(total_amount) OVER w AS prev_amount, lead(total_amount) OVER w AS next_amount,
  sum(total_amount) OVER (PARTITION BY order_status ORDER BY order_date DESC, order_id ROWS UNBOUNDED PRECEDING) AS running_total, sum(total_amount) OVER (PARTITION BY order_status) AS total
FROM shop_orders WINDOW v AS (PARTITION BY order_status ORDER BY order_date DESC), w AS (PARTITION BY order_status ORDER BY order_date DESC, order_id)
""")(lambda t: ranked(t.shop_orders.select("order_id", "order_status", "order_date", "total_amount"), ["order_status"], [("order_date", "desc")], ["order_id"], {
    "rn": ("row_number",), "rnk": ("rank",), "drnk": ("dense_rank",), "_pr": ("percent_rank",), "_cd": ("cume_dist",), "tile": ("ntile", 7), "n": ("count",),
    "prev_amount": ("lag", "total_amount"), "next_amount": ("lead", "total_amount"), "running_total": ("running_sum", "total_amount"),
    "total": ("total", "total_amount")}).withColumns({"pr": F.round("_pr", 9), "cd": F.round("_cd", 9)}))

query("u1_format_amount", "order_id:i krw:s usd:s jpy:s eur:s", f"""
SELECT order_id, {krw('x')} AS krw, '$' || f AS usd, {krw('x')} AS jpy, f || ' EUR' AS eur FROM (
  SELECT *, regexp_replace(case when x < 0 then '-' else '' end || format('{{:,}}', cast(abs(cast(x * 100 as bigint)) // 100 as bigint)) || '.' || lpad(cast(abs(cast(x * 100 as bigint)) % 100 as varchar), 2, '0'), '^(-?)0\\.', '\\1.') AS f
  FROM (SELECT order_id, coalesce(case when order_id % 2 = 0 then total_amount else cast(order_id % 100 as decimal(14,2)) / 100 end, 0)::decimal(14,2) AS x FROM shop_orders))
""")(lambda t: t.shop_orders.withColumn("x", F.expr("cast(case when order_id % 2 = 0 then total_amount else cast(order_id % 100 as decimal(14,2)) / 100 end as decimal(14,2))")).select(
    "order_id", *(O.format_amount(c("x"), k).alias(k.lower()) for k in ("KRW", "USD", "JPY", "EUR"))))

query("u2_mask_string", "product_id:i masked:s", """
SELECT product_id, case when length(product_name) <= 8 then product_name else left(product_name, 8) || repeat('*', length(product_name) - 8) end AS masked FROM products
""")(lambda t: t.products.select("product_id", O.mask_string(c("product_name"), 8).alias("masked")))

query("u3_calc_age", "customer_id:i age:i", f"""
SELECT customer_id, floor({full_months('birth_date')} / 12) AS age FROM customers
""")(lambda t: t.customers.select("customer_id", O.calc_age(c("birth_date"), F.lit(TODAY)).alias("age")))

query("u4_order_total", "order_id:i total:d", f"""
SELECT o.order_id, coalesce(sum({LINE_SQL}), 0) AS total FROM shop_orders o LEFT JOIN order_items i ON o.order_id = i.order_id GROUP BY 1
""")(lambda t: t.shop_orders.select("order_id").join(order.order_totals(t.order_items), "order_id", "left").select(
    "order_id", O.nvl(c("calculated_total"), F.lit(0)).alias("total")))

query("u5_business_days", "order_id:i days:i", """
SELECT order_id, case when a > b then 0 else (SELECT count(*) FROM (SELECT unnest(generate_series(a, b, interval 1 day)) AS d) WHERE isodow(d) < 6) end AS days
FROM (SELECT order_id, order_date AS a, order_date + cast(order_id % 40 - 5 as integer) AS b FROM shop_orders)
""")(lambda t: t.shop_orders.select("order_id", O.business_days(c("order_date"), F.expr("date_add(order_date, cast(order_id % 40 - 5 as int))")).alias("days")))
