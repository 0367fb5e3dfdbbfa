"""Queries of the week review, the budget and card bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import budget
from tallyforge.plans.catalog import query

_C = F.col
_WEEK = budget.Week("2001-06-25", "2001-06-28")
_E = """SELECT 'e:' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS month, CAST(CASE WHEN o_orderkey % 19 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2)) AS amount, 'c' || o_orderkey % 9 AS category_id,
  CASE WHEN o_orderkey % 23 = 0 THEN 'name:new' || o_orderkey WHEN o_custkey % 7 <> 0 THEN 'name:m' || o_custkey % 400 END AS merchant_key, o_orderpriority AS title, o_orderstatus = 'P' AS pending FROM {orders}"""
_CENTS = "floor(CAST({0} AS DOUBLE) * 100 + 0.5) / 100.0"
_WEEKS = f"""e AS ({_E}), f AS (SELECT min(day) AS first FROM e), w AS (SELECT k AS ago, DATE '2001-06-25' - CAST(7 * k AS INT) AS s FROM range(1, 9) AS t(k)), b AS (SELECT w.* FROM w JOIN f ON f.first <= w.s + 1),
  p AS (SELECT b.ago, coalesce(sum(amount), 0) AS total FROM b LEFT JOIN e ON e.day >= b.s AND e.day < b.s + 4 GROUP BY 1)"""


def _entries(t):
    return t.spark.sql(_E, orders=t["orders"])


@query("ag6_week_review", f"""WITH {_WEEKS}, o AS (SELECT {_CENTS.format("coalesce(sum(amount) FILTER (day < DATE '2001-06-29'), 0)")} AS total, {_CENTS.format("coalesce(sum(amount) FILTER (pending), 0)")} AS pending_amount FROM e WHERE day BETWEEN DATE '2001-06-25' AND DATE '2001-07-01'),
  m AS (SELECT count(*) AS baseline_weeks, CASE WHEN count(*) >= 2 THEN {_CENTS.format("median(CAST(total AS DOUBLE))")} END AS baseline_median FROM p)
  SELECT *, {_CENTS.format("(total - baseline_median)")} AS difference, 4 AS elapsed_days, FALSE AS complete, DATE '2001-06-26' AS unsure_from FROM o, m""")
def _(t):
    return budget.week_review(_entries(t), _WEEK)


@query("ag6_week_days", f"WITH e AS ({_E}) SELECT d AS day, {_CENTS.format('coalesce(sum(amount), 0)')} AS amount FROM (SELECT DATE '2001-06-25' + CAST(k AS INT) AS d FROM range(7) AS t(k)) LEFT JOIN e ON e.day = d GROUP BY 1")
def _(t):
    return budget.week_days(_entries(t), _WEEK)


@query("ag6_category_increases", f"""WITH {_WEEKS}, n AS (SELECT category_id, sum(amount) AS now FROM e WHERE day >= DATE '2001-06-25' AND day < DATE '2001-06-29' GROUP BY 1), q AS (SELECT category_id, sum(amount) AS past FROM e JOIN b ON e.day >= b.s AND e.day < b.s + 4 GROUP BY 1),
  r AS (SELECT category_id, now, CAST(coalesce(past, 0) AS DOUBLE) / (SELECT count(*) FROM b) AS base FROM n LEFT JOIN q USING (category_id))
  SELECT * FROM (SELECT category_id, {_CENTS.format("now")} AS amount, {_CENTS.format("base")} AS baseline, {_CENTS.format("(CAST(now AS DOUBLE) - base)")} AS delta FROM r) WHERE delta > 0 ORDER BY delta DESC, category_id LIMIT 3""")
def _(t):
    return budget.category_increases(_entries(t), _WEEK)


@query("ag6_largest_entries", f"WITH e AS ({_E}) SELECT id, day, title, CAST(amount AS DOUBLE) AS amount, category_id, pending FROM e WHERE amount > 0 AND day BETWEEN DATE '2001-06-25' AND DATE '2001-07-01' ORDER BY amount DESC, id LIMIT 5")
def _(t):
    return budget.largest_entries(_entries(t), _WEEK).withColumn("amount", _C("amount").cast("double"))


@query("ag6_new_merchants", f"WITH {_WEEKS} SELECT merchant_key, {_CENTS.format('sum(amount)')} AS amount, count(*) AS entries FROM e WHERE day BETWEEN DATE '2001-06-25' AND DATE '2001-07-01' AND merchant_key NOT IN (SELECT merchant_key FROM e WHERE day < DATE '2001-06-25' AND merchant_key IS NOT NULL) AND (SELECT count(*) FROM b) >= 2 GROUP BY 1 ORDER BY amount DESC, merchant_key LIMIT 5")
def _(t):
    return budget.new_merchants(_entries(t), _WEEK)


_DEC = "SELECT DISTINCT 'name:m' || o_custkey % 400 AS merchant_key, CASE (o_custkey % 400) % 5 WHEN 0 THEN 'annual' WHEN 1 THEN 'not_fixed' ELSE 'monthly' END AS kind, CASE WHEN (o_custkey % 400) % 3 = 0 THEN 500.25E0 END AS expected_amount FROM {orders} WHERE o_custkey % 400 < 40"
_HISTORY = ["2001-03", "2001-04", "2001-05"]
_H = ", ".join(f"'{m}'" for m in _HISTORY)
_FIXED = f"""e AS ({_E}), d AS ({_DEC}), mo AS (SELECT merchant_key, month, CAST(sum(amount) AS DOUBLE) AS a FROM e WHERE merchant_key IS NOT NULL AND month IN ('2001-06', {_H}) GROUP BY 1, 2),
  bm AS (SELECT merchant_key, median(CASE WHEN month <> '2001-06' THEN a END) AS usual, sum(CASE WHEN month = '2001-06' THEN a END) AS paid FROM mo GROUP BY 1),
  fx AS (SELECT d.merchant_key, kind, {_CENTS.format("coalesce(expected_amount, CASE WHEN kind = 'monthly' THEN coalesce(usual, 0.0) ELSE 0.0 END)")} AS expected, CASE WHEN expected_amount IS NOT NULL THEN 'user' ELSE 'history' END AS expected_source, {_CENTS.format("coalesce(paid, 0)")} AS paid
    FROM d LEFT JOIN bm USING (merchant_key) WHERE kind <> 'not_fixed')"""


@query("ag7_fixed_merchants", f"WITH {_FIXED} SELECT * FROM fx")
def _(t):
    return budget.fixed_merchants(_entries(t), t.spark.sql(_DEC, orders=t["orders"]), "2001-06", _HISTORY)


@query("ag7_budget", f"""WITH {_FIXED}, r AS (SELECT e.*, coalesce(kind, '') AS kind FROM e LEFT JOIN d USING (merchant_key)),
  s AS (SELECT {_CENTS.format("coalesce(sum(amount) FILTER (month = '2001-06' AND kind <> 'annual'), 0)")} AS spent, {_CENTS.format("coalesce(sum(amount) FILTER (month = '2001-06' AND kind = 'monthly'), 0)")} AS spent_fixed, {_CENTS.format("coalesce(sum(amount) FILTER (month = '2001-06' AND kind = 'annual'), 0)")} AS spent_from_reserve FROM r),
  u AS (SELECT {_CENTS.format("median(a)")} AS typical_spending FROM (SELECT {_CENTS.format("sum(amount)")} AS a FROM r WHERE month IN ({_H}) AND kind <> 'annual' GROUP BY month)),
  x AS (SELECT {_CENTS.format("coalesce(sum(greatest(expected - paid, 0.0)) FILTER (kind = 'monthly'), 0)")} AS fixed_remaining FROM fx),
  y AS (SELECT *, {_CENTS.format("(9e8 - spent - fixed_remaining)")} AS available FROM s, u, x)
  SELECT spent, spent_fixed, spent_from_reserve, fixed_remaining, typical_spending, 9e8 AS monthly_budget, 3 AS days_left, available, {_CENTS.format("(greatest(available, 0.0) / 3)")} AS daily_allowance, 1000.0 AS monthly_reserve, 52000.5 AS expected_income, 'history' AS income_source, {_CENTS.format("(52000.5 - 9e8 - 1000.0)")} AS expected_savings, FALSE AS annual_without_reserve FROM y""")
def _(t):
    return budget.budget(_entries(t), t.spark.sql(_DEC, orders=t["orders"]), {"monthly_budget": 9e8, "expected_income": None, "annual_reserve": 12000}, "2001-06", "2001-06-28", _HISTORY, 52000.5)


@query("ag7_large_merchants", f"WITH e AS ({_E}), d AS ({_DEC}) SELECT merchant_key, {_CENTS.format('sum(amount)')} AS amount, count(*) AS entries FROM e WHERE month = '2001-06' AND merchant_key IS NOT NULL AND merchant_key NOT IN (SELECT merchant_key FROM d) GROUP BY 1 HAVING {_CENTS.format('sum(amount)')} >= 1000 ORDER BY amount DESC, merchant_key LIMIT 8")
def _(t):
    return budget.large_merchants(_entries(t), t.spark.sql(_DEC, orders=t["orders"]), "2001-06")


_BILLS = "SELECT account_id || ':' || billing_period AS bill_id, account_id AS issuer, closing_date, CASE WHEN CAST(substr(billing_period, 6, 2) AS INT) % 5 <> 0 THEN statement_amount END AS statement_amount, CASE WHEN CAST(substr(billing_period, 6, 2) AS INT) % 3 = 0 THEN statement_amount / 2 END AS source_paid, CAST(substr(billing_period, 6, 2) AS INT) % 10 = 0 AS source_is_paid, CASE WHEN CAST(substr(billing_period, 6, 2) AS INT) % 2 = 0 THEN 100 END AS minimum FROM {bills}"
_PAID = "SELECT account_id AS issuer, CAST(posted_date AS DATE) AS day, CASE WHEN n % 2 = 0 THEN 'bank' ELSE 'card' END AS side, amount FROM {transactions} WHERE amount > 0 AND account_type = 'credit'"
_SHARED = f"b AS ({_BILLS}), p AS ({_PAID}), n AS (SELECT *, lead(closing_date) OVER (PARTITION BY issuer ORDER BY closing_date) AS following FROM b), l AS (SELECT n.bill_id, p.side, p.amount FROM n JOIN p ON p.issuer = n.issuer AND p.day > n.closing_date AND (n.following IS NULL OR p.day <= n.following))"


@query("jn27_statement_payments", f"WITH {_SHARED} SELECT bill_id, side, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM l GROUP BY 1, 2")
def _(t):
    found = budget.statement_payments(t.spark.sql(_BILLS, bills=t["bills"]), t.spark.sql(_PAID, transactions=t["transactions"]))
    return found.groupBy("bill_id", "side").agg(F.count(F.lit(1)).alias("n"), F.sum(_C("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@query("ag20_evaluated_bills", f"""WITH {_SHARED}, s AS (SELECT bill_id, sum(amount) FILTER (side = 'bank') AS bank, sum(amount) FILTER (side = 'card') AS card FROM l GROUP BY 1),
  q AS (SELECT b.*, {_CENTS.format("greatest(coalesce(CAST(source_paid AS DOUBLE), 0), coalesce(CAST(bank AS DOUBLE), 0), coalesce(CAST(card AS DOUBLE), 0))")} AS paid FROM b LEFT JOIN s USING (bill_id)),
  z AS (SELECT *, CASE WHEN statement_amount IS NULL THEN CASE WHEN source_is_paid THEN 'paid' ELSE 'unknown' END WHEN statement_amount <= 0 OR source_is_paid OR paid >= CAST(statement_amount AS DOUBLE) THEN 'paid' WHEN paid > 0 THEN 'partial' ELSE 'unpaid' END AS status FROM q)
  SELECT bill_id, paid, CASE status WHEN 'paid' THEN 0.0 WHEN 'partial' THEN {_CENTS.format("(CAST(statement_amount AS DOUBLE) - paid)")} WHEN 'unpaid' THEN CAST(statement_amount AS DOUBLE) END AS remaining, status, CASE WHEN minimum IS NOT NULL THEN status = 'paid' OR paid >= minimum END AS minimum_paid FROM z""")
def _(t):
    bills = t.spark.sql(_BILLS, bills=t["bills"])
    return budget.evaluated_bills(bills, budget.statement_payments(bills, t.spark.sql(_PAID, transactions=t["transactions"])))


