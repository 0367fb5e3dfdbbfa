"""Queries by operator id, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import cards, ingest, ledger, linkage, merchants, series
from tallyforge.plans import annotating, banking, cardbills, histories, lifecycles, linking, merging, normalising, settling, spending, statements, unified, waiting  # noqa: F401  (they register their queries)
from tallyforge.plans.annotating import assignment
from tallyforge.plans.catalog import QUERIES, SQL, query
from tallyforge.plans.derived import ACT as _ACT
from tallyforge.plans.derived import DAY as _DAY
from tallyforge.plans.derived import RULES, activity as _activity  # noqa: F401
from tallyforge.sources.durable import stored
from tallyforge.sources.tables import TODAY, Tables

_PLAIN = "twd IS NOT NULL AND role NOT IN ('excluded', 'advance', 'reimbursement')"


def _sum(test: str, value: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {test} THEN {value} END), 0) AS DOUBLE)"


@query("ag5_advances", f"""{_ACT} SELECT lower(advance_counterparty) AS counterparty, currency, CAST(sum(-amount) AS DOUBLE) AS balance, count(*) AS entries, max(day) AS last_day, arg_max(advance_counterparty, (day, id)) AS display_name
  FROM act WHERE role IN ('advance', 'reimbursement') AND advance_counterparty IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return ledger.advances(_activity(t))


@query("ag11_merchants", f"""{_ACT}, k AS (SELECT *, substr(regexp_replace(lower(counterparty), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+', '', 'g'), 1, 120) AS merchant_key FROM act),
  c AS (SELECT merchant_key, category_id, count(*) AS n, sum(CASE WHEN role = 'spending' THEN -twd END) AS s FROM k GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY merchant_key ORDER BY n DESC, category_id) AS r FROM c)
  SELECT merchant_key, CAST(sum(n) AS BIGINT) AS activity_count, CAST(coalesce(sum(s), 0) AS DOUBLE) AS spending, max(CASE WHEN r = 1 THEN category_id END) AS category_id FROM o GROUP BY 1""")
def _(t):
    return ledger.merchants(_activity(t))


@query("ag8_fixed_candidates", """WITH s AS (SELECT c.id AS merchant_key, substr(t.posted_date, 1, 7) AS month, -t.amount AS amount FROM {transactions} t JOIN {accounts} c ON c.id = t.account_id WHERE t.amount < 0),
  m AS (SELECT merchant_key, month, CAST(sum(amount) AS DOUBLE) AS a, count(*) AS n FROM s WHERE month IN ('1999-01', '1999-02') GROUP BY 1, 2)
  SELECT merchant_key, min(a) AS low, max(a) AS high, median(a) AS typical_amount FROM m GROUP BY 1 HAVING count(*) = 2 AND min(a) >= 100 AND max(n) <= 2 AND max(a) <= min(a) * 1.5 ORDER BY typical_amount DESC, merchant_key LIMIT 10""")
def _(t):
    rows = t["transactions"].filter("amount < 0").select(F.col("account_id").alias("merchant_key"), F.substring("posted_date", 1, 7).alias("month"), (-F.col("amount")).alias("amount"))
    return ledger.fixed_candidates(rows, ["1999-01", "1999-02"])


@query("ag6_week_summary", f"""{_ACT}, s AS (SELECT day, -twd AS amount, CAST(date_trunc('week', day) AS DATE) AS week FROM act WHERE role = 'spending' AND twd <> 0)
  SELECT week, CAST(sum(amount) AS DOUBLE) AS total, CAST(max(amount) AS DOUBLE) AS largest, count(*) AS entries FROM s
  WHERE day BETWEEN CAST(date_trunc('week', DATE '{TODAY}') AS DATE) - 56 AND DATE '{TODAY}' AND day - week <= DATE '{TODAY}' - CAST(date_trunc('week', DATE '{TODAY}') AS DATE) GROUP BY 1""")
def _(t):
    rows = _activity(t).filter("role = 'spending' and twd <> 0").select("day", (-F.col("twd")).alias("amount"))
    return ledger.week_summary(rows, TODAY)


@query("sc1_transactions_in_range", f"""SELECT id, account_id, {_DAY} AS day, CAST(amount AS DOUBLE) AS amount FROM {{transactions}}
  WHERE canonical_account_id IS NULL AND (status <> 'pending' OR matched_transaction_id IS NULL) AND {_DAY} >= DATE '1999-02-01' AND {_DAY} < DATE '1999-04-01'""")
def _(t):
    rows = ledger.in_range(ledger.with_day(ledger.visible(t["transactions"])), "day", "1999-02-01", "1999-04-01")
    return rows.select("id", "account_id", "day", F.col("amount").cast("double").alias("amount"))


@query("sc3_accounts_with_balance", """SELECT a.id, a.currency, CAST(s.balance AS DOUBLE) AS balance, s.as_of_day FROM {accounts} a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY as_of_day DESC, n DESC) AS r FROM {snapshots}) s ON s.account_id = a.id AND s.r = 1 WHERE a.canonical_account_id IS NULL AND NOT a.inactive""")
def _(t):
    last = ledger.latest_per(t["snapshots"], ["account_id"], F.desc("as_of_day"), F.desc("n"))
    rows = t["accounts"].filter("canonical_account_id is null and not inactive").join(last.withColumnRenamed("account_id", "a"), F.col("a") == t["accounts"]["id"], "left")
    return rows.select(t["accounts"]["id"], "currency", F.col("balance").cast("double").alias("balance"), "as_of_day")


@query("sc4_invoices_in_range", "SELECT id, day, CAST(amount AS DOUBLE) AS amount FROM {invoices} WHERE day >= DATE '1999-02-01' AND day < DATE '1999-03-01'")
def _(t):
    return ledger.in_range(t["invoices"], "day", "1999-02-01", "1999-03-01").select("id", "day", F.col("amount").cast("double").alias("amount"))


@query("sc5_invoice_items", "SELECT invoice_id, line_number, description, CAST(amount AS DOUBLE) AS amount FROM {invoice_items} WHERE invoice_id IN (SELECT id FROM {invoices} WHERE day = DATE '1999-02-03')")
def _(t):
    wanted = t["invoices"].filter("day = date '1999-02-03'").select(F.col("id").alias("invoice_id"))
    return t["invoice_items"].join(wanted, "invoice_id", "left_semi").select("invoice_id", "line_number", "description", F.col("amount").cast("double").alias("amount"))


@query("sc7_bills_in_range", "SELECT account_id, billing_period, currency, CAST(statement_amount AS DOUBLE) AS statement_amount FROM {bills} WHERE billing_period >= '1999-01' AND billing_period < '1999-04'")
def _(t):
    return t["bills"].filter("billing_period >= '1999-01' and billing_period < '1999-04'").select("account_id", "billing_period", "currency", F.col("statement_amount").cast("double").alias("statement_amount"))


# a quote an order, some of them no rates
_QUOTES = "SELECT CASE o_orderkey % 7 WHEN 0 THEN 'USD' WHEN 1 THEN 'JPY' WHEN 2 THEN 'EUR' WHEN 3 THEN 'CNY' WHEN 4 THEN 'KRW' WHEN 5 THEN 'GBP' ELSE 'THB' END AS currency, CASE WHEN o_orderkey % 5 = 0 THEN 0E0 WHEN o_orderkey % 11 = 0 THEN -1E0 WHEN o_orderkey % 13 <> 0 THEN 1E0 / (20E0 + o_orderkey % 17) END AS per_twd, CAST(o_orderdate AS DATE) AS day, o_orderkey AS n FROM {orders}"
_RATES = f"SELECT currency, 1E0 / arg_max(per_twd, (day, n)) AS rate_to_twd, max(day) AS updated_on FROM ({_QUOTES}) WHERE per_twd > 0 GROUP BY 1"


def _kept_rates(t):
    """The table of rates, overwritten with what the quotes say."""
    return stored(ledger.inverted_rates(t.spark.sql(_QUOTES, orders=t["orders"])), "rates")


@query("sc9_exchange_rates", f"SELECT currency, rate_to_twd, CASE currency WHEN 'USD' THEN 1 WHEN 'JPY' THEN 2 WHEN 'EUR' THEN 3 ELSE 4 END AS place FROM ({_RATES}) WHERE currency IN ('USD', 'JPY', 'EUR', 'CNY')")
def _(t):
    return ledger.listed_rates(_kept_rates(t)).select("currency", "rate_to_twd", "place")


@query("sc11_earliest_day", f"SELECT min({_DAY}) AS day FROM {{transactions}}")
def _(t):
    return ledger.with_day(t["transactions"]).agg(F.min("day").alias("day"))


@query("sc12_earliest_advance_day", f"SELECT min(day) AS day FROM (SELECT min({_DAY}) AS day FROM {{transactions}} WHERE advance_counterparty IS NOT NULL UNION ALL SELECT min(day) FROM {{invoices}} WHERE amount > 700000)")
def _(t):
    bank = ledger.with_day(t["transactions"].filter("advance_counterparty is not null")).select("day")
    return bank.unionByName(t["invoices"].filter("amount > 700000").select("day")).agg(F.min("day").alias("day"))


@query("sc14_inverted_rates", f"SELECT currency, rate_to_twd, updated_on FROM ({_RATES})")
def _(t):
    return _kept_rates(t)


@query("st4_transaction_page", """SELECT id, posted_date FROM {transactions} WHERE (posted_date, id) < ('1999-06-30', 'txn:5') ORDER BY posted_date DESC, id DESC LIMIT 50""")
def _(t):
    return ledger.page_after(t["transactions"].select("posted_date", "id"), ["posted_date", "id"], ("1999-06-30", "txn:5"), 50)


@query("st3_group_by_date", f"{_ACT} SELECT day, count(*) AS n, CAST(sum(twd) AS DOUBLE) AS total FROM act GROUP BY day")
def _(t):
    return _activity(t).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("twd").cast("double").alias("total"))


@query("fn_days", f"""SELECT id, {_DAY} AS transaction_day, CASE WHEN status = 'posted' THEN CAST(posted_date AS DATE) ELSE {_DAY} END AS billing_day, coalesce(posted_date, authorized_at, '') AS effective_date,
  CAST(date_trunc('month', CAST(posted_date AS DATE)) AS DATE) - INTERVAL 1 MONTH + INTERVAL (day(CAST(posted_date AS DATE)) - 1) DAY AS overflowed, CAST(CAST(posted_date AS DATE) - INTERVAL 1 MONTH AS DATE) AS clamped FROM {{transactions}}""".replace("CAST(date_trunc('month', CAST(posted_date AS DATE)) AS DATE) - INTERVAL 1 MONTH + INTERVAL (day(CAST(posted_date AS DATE)) - 1) DAY", "CAST(CAST(date_trunc('month', CAST(posted_date AS DATE)) AS DATE) - INTERVAL 1 MONTH AS DATE) + CAST(day(CAST(posted_date AS DATE)) - 1 AS INT)"))
def _(t):
    a, p = F.col("authorized_at"), F.col("posted_date")
    return t["transactions"].select("id", C.transaction_day(a, p).alias("transaction_day"), C.billing_day(F.col("status"), a, p).alias("billing_day"), C.effective_date(a, p).alias("effective_date"), C.subtract_months(p.cast("date"), 1).alias("overflowed"), C.month_before(p.cast("date")).alias("clamped"))


@query("pj14_amount_twd", f"{_ACT} SELECT id, CAST(twd AS DOUBLE) AS twd FROM act")
def _(t):
    return _activity(t).select("id", F.col("twd").cast("double").alias("twd"))


@query("pj17_masked_export", "SELECT id, regexp_replace('No.' || lpad(CAST(n AS STRING), 9, '7') || ' / ' || account_last4, '7*[0-9]*([0-9]{{4}}) /', '****\\1 /') AS memo FROM {transactions}")
def _(t):
    memo = F.concat(F.lit("No."), F.lpad(F.col("n").cast("string"), 9, "7"), F.lit(" / "), F.col("account_last4"))
    return t["transactions"].select("id", C.mask_long_digits(memo).alias("memo"))


@query("fl2_search_amount", "SELECT id, CAST(amount AS DOUBLE) AS amount FROM {transactions} WHERE abs(amount) BETWEEN 1000 AND 5000")
def _(t):
    return t["transactions"].filter(C.amount_condition(F.col("amount"), "1000-5000")).select("id", F.col("amount").cast("double").alias("amount"))


@query("fl4_search_text", "SELECT id FROM {transactions} WHERE contains(lower(concat_ws(' ', description, counterparty)), 'urgent supplier#000000003')")
def _(t):
    return t["transactions"].filter(F.lower(F.concat_ws(" ", "description", "counterparty")).contains("urgent supplier#000000003")).select("id")


@query("cl4_classification", f"{_ACT} SELECT id, category_id, rule_id FROM act")
def _(t):
    return _activity(t).select("id", "category_id", "rule_id")


@query("cl7_economic_role", f"{_ACT} SELECT id, role, review FROM act")
def _(t):
    return _activity(t).select("id", "role", "review")


@query("jn3_balance_as_of", f"SELECT account_id, CAST(arg_max(balance, (as_of_day, n)) AS DOUBLE) AS balance, max(as_of_day) AS as_of_day FROM {{snapshots}} WHERE as_of_day <= DATE '2000-01-15' GROUP BY 1")
def _(t):
    return series.balance_as_of(t["snapshots"], "2000-01-15").withColumn("balance", F.col("balance").cast("double"))


@query("jn4_first_real_snapshot", "SELECT account_id, CAST(balance AS DOUBLE) AS balance, as_of_day FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY as_of_day, n) AS r FROM {snapshots} WHERE NOT derived) WHERE r = 1")
def _(t):
    first = ledger.latest_per(t["snapshots"].filter("not derived"), ["account_id"], F.asc("as_of_day"), F.asc("n"))
    return first.select("account_id", F.col("balance").cast("double").alias("balance"), "as_of_day")


@query("jn5_latest_positions", "SELECT connector_id, asset_type, symbol, CAST(market_value AS DOUBLE) AS market_value FROM (SELECT *, max(as_of_date) OVER (PARTITION BY connector_id, asset_type) AS top FROM {positions}) WHERE as_of_date = top")
def _(t):
    top = t["positions"].groupBy("connector_id", "asset_type").agg(F.max("as_of_date").alias("as_of_date"))  # a few rows, so a join, not a window over all
    return t["positions"].join(top, ["connector_id", "asset_type", "as_of_date"]).select("connector_id", "asset_type", "symbol", F.col("market_value").cast("double").alias("market_value"))


@query("jn9_invoice_edges", """WITH e AS (SELECT i.id AS invoice_id, t.id AS transaction_id, abs(t.day - i.day) AS gap, t.amount = i.amount AS exact, i.seller = t.merchant AS same
  FROM {dense_invoices} i JOIN {dense_transactions} t ON t.day BETWEEN i.day - 3 AND i.day + 3 AND NOT t.inflow
    AND (t.amount = i.amount OR t.amount < i.amount AND t.amount >= i.amount * 0.8E0 AND i.amount - t.amount <= 500 AND i.seller = t.merchant))
  SELECT invoice_id, transaction_id, CAST(gap AS INT) AS gap, exact, CAST(CASE WHEN exact THEN 5 ELSE 3 END + CASE gap WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END + CASE WHEN same THEN 2 ELSE 0 END AS INT) AS score FROM e""")
def _(t):
    return linkage.edges_of_alike(t["dense_invoices"], t["dense_transactions"].filter("not inflow"))


_EDGES = """SELECT i.id AS invoice_id, t.id AS transaction_id, abs(t.day - i.day) AS gap, t.amount = i.amount AS exact, CASE WHEN t.amount = i.amount THEN 5 ELSE 3 END + CASE abs(t.day - i.day) WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END + CASE WHEN i.seller = t.merchant THEN 2 ELSE 0 END AS score
  FROM {dense_invoices} i JOIN {dense_transactions} t ON t.day BETWEEN i.day - 3 AND i.day + 3 AND NOT t.inflow
    AND (t.amount = i.amount OR t.amount < i.amount AND t.amount >= i.amount * 0.8E0 AND i.amount - t.amount <= 500 AND i.seller = t.merchant)"""


def _matched(t: Tables, small: int | None = None) -> DataFrame:
    return linkage.settled_alike(t["dense_invoices"], t["dense_transactions"].filter("not inflow"), small).filter("invoice_id is not null")


@query("jn12_invoice_matches", assignment(_EDGES, range(10, 4, -1)))
def _(t):
    return _matched(t)


@query("jn12_matches_by_rounds", assignment(_EDGES, range(10, 4, -1)))
def _(t):
    return _matched(t, small=0)


_SELLERS = "SELECT id, CASE id % 6 WHEN 0 THEN '全聯實業股份有限公司旅順分公司' WHEN 2 THEN 'Cloudflare Inc.' ELSE '老王牛肉麵' END AS seller, amount, day, CASE WHEN id % 10 = 6 THEN lpad(CAST(id % 7 AS STRING), 4, '0') END AS carrier FROM {dense_invoices}"
_BUYS = "SELECT id, CASE id % 3 WHEN 0 THEN '全支付﹘全聯' WHEN 1 THEN 'CLOUDFLAREA3906' ELSE '連支＊老王牛肉麵' END AS merchant, amount + CASE WHEN id % 4 = 1 THEN 15 ELSE 0 END AS amount, day, id % 2 = 1 AS credit, lpad(CAST(id % 7 AS STRING), 4, '0') AS account_last4, id % 9 <> 0 AS outflow FROM {dense_transactions}"
_LEVELS = "SELECT * FROM (VALUES ('全聯實業股份有限公司旅順分公司', '全支付﹘全聯', 1, FALSE), ('Cloudflare Inc.', 'CLOUDFLAREA3906', 2, TRUE), ('老王牛肉麵', '連支＊老王牛肉麵', 2, FALSE)) AS v(seller, merchant, points, brand)"


@query("jn10_similar_names", f"""WITH i AS ({_SELLERS}), t AS ({_BUYS}), v AS ({_LEVELS}), c AS (SELECT i.id AS invoice_id, t.id AS transaction_id, abs(t.day - i.day) AS gap, t.amount = i.amount AS exact, coalesce(points, 0) AS points, coalesce(brand, FALSE) AS brand, carrier IS NOT NULL AS carried, credit, outflow, t.amount AS paid, i.amount AS asked
  FROM i JOIN t ON abs(t.day - i.day) <= CASE WHEN carrier IS NULL THEN 3 ELSE 5 END AND (carrier IS NULL OR credit AND account_last4 = carrier) AND t.amount BETWEEN i.amount * 0.5E0 AND i.amount * 2 LEFT JOIN v ON v.seller = i.seller AND v.merchant = t.merchant)
  SELECT invoice_id, transaction_id, CAST(gap AS INT) AS gap, exact, CAST(CASE WHEN exact THEN 5 ELSE 3 END + CASE gap WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END + points + CASE WHEN carried THEN 3 ELSE 0 END AS INT) AS score FROM c
  WHERE (exact OR paid < asked AND paid >= asked * 0.8E0 AND asked - paid <= 500 AND (carried OR points = 2) OR credit AND brand AND abs(paid - asked) <= greatest(30, asked * 0.05E0)) AND (exact AND gap = 0 OR outflow)""")
def _(t):
    i, b = t.spark.sql(_SELLERS, dense_invoices=t["dense_invoices"]), t.spark.sql(_BUYS, dense_transactions=t["dense_transactions"])
    pairs = merchants.similar_pairs(i.select("seller", F.lit(None).cast("string").alias("ban")), b.select("merchant"))
    return linkage.edges_of_alike(i, b, names=linkage.name_points(pairs))


@query("jn16_repeat_groups", """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id AS id, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS sec FROM {events}),
  g AS (SELECT user_id, event_type, min(sec) AS at_sec FROM e GROUP BY 1, 2 UNION ALL SELECT user_id, event_type, (SELECT min(e.sec) FROM e WHERE e.user_id = g.user_id AND e.event_type = g.event_type AND e.sec > g.at_sec + 86400) FROM g WHERE at_sec IS NOT NULL)
  SELECT e.user_id, e.event_type, e.id, max(g.at_sec) AS anchor FROM e JOIN g ON g.user_id = e.user_id AND g.event_type = e.event_type AND g.at_sec <= e.sec GROUP BY 1, 2, 3""")
def _(t):
    rows = t["events"].select("user_id", "event_type", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return linkage.anchored_groups(rows, ["user_id", "event_type"])


@query("jn17_repeat_rounds")
def _(t):
    # invoices of one seller, amount and month are taken as issued again, one after another
    ranked = t["dense_invoices"].select(F.col("id").alias("invoice_id"), "seller", "amount", F.trunc("day", "month").alias("month"))
    w = Window.partitionBy("seller", "amount", "month").orderBy("invoice_id")
    repeats = ranked.select("invoice_id", F.min("invoice_id").over(Window.partitionBy("seller", "amount", "month")).alias("anchor"), F.row_number().over(w).alias("rank"))
    edges = linkage.candidate_edges(t["dense_invoices"], t["dense_transactions"].filter("not inflow"))
    return linkage.assign_repeats(edges, stored(repeats, "repeats"))


@query("jn28_authorisation_matches")
def _(t):
    rows = t["transactions"].select("id", F.col("id").alias("source_id"), F.col("account_id").alias("card"), F.substring("posted_date", 1, 7).alias("day"), "amount", "currency", "description", "n")
    return cards.authorisation_matches(rows.filter("n % 2 = 0"), rows.filter("n % 2 = 1"), {"USD": 31.5})


@query("nm13_assigned_payments")
def _(t):
    bills = t["bills"].select(F.concat_ws("|", "account_id", "billing_period").alias("bill_id"), F.col("account_id").alias("card"), "currency", "billing_period", F.date_add("closing_date", 20).alias("due_date"), "statement_amount", F.lit(0).cast("decimal(18,2)").alias("paid"))
    paid = t["transactions"].filter("account_type = 'credit' and amount > 0").select(F.col("id").alias("payment_id"), F.col("account_id").alias("card"), "currency", F.col("posted_date").cast("date").alias("day"), "amount")
    return cards.assigned_payments(bills, paid)


_LEGS = "SELECT id, account_id, day, 'TWD' AS currency, CAST(CASE WHEN inflow THEN amount ELSE -amount END AS BIGINT) AS amount FROM {dense_transactions}"


@query("jn20_transfer_pairs", f"""WITH l AS ({_LEGS}), g AS (SELECT day, currency, abs(amount) AS size, count(*) FILTER (amount > 0) AS p, count(*) FILTER (amount < 0) AS m FROM l GROUP BY 1, 2, 3)
  SELECT a.day, a.currency, a.id AS into_id, b.id AS out_id FROM g JOIN l a ON a.day = g.day AND a.amount = g.size JOIN l b ON b.day = g.day AND b.amount = -g.size WHERE g.p = 1 AND g.m = 1 AND a.account_id <> b.account_id""")
def _(t):
    rows = t["dense_transactions"].select("id", "account_id", "day", F.lit("TWD").alias("currency"), F.when(F.col("inflow"), F.col("amount")).otherwise(-F.col("amount")).alias("amount"))
    return linkage.transfer_pairs(rows)


_RANKED = "SELECT id, day, amount, inflow, row_number() OVER (PARTITION BY day, amount, inflow ORDER BY id) AS n FROM {dense_transactions}"


@query("jn22_offset_rank_pairs", f"WITH r AS ({_RANKED}) SELECT a.day, a.amount, CAST(a.n AS INT) AS n, a.id AS left_id, b.id AS right_id FROM r a JOIN r b ON a.day = b.day AND a.amount = b.amount AND a.n = b.n AND a.inflow AND NOT b.inflow")
def _(t):
    return linkage.rank_pairs(t["dense_transactions"], ["day", "amount"], "inflow", "id")


@query("jn30_unique_pairs", """WITH a AS (SELECT day, amount, merchant, count(*) AS n, min(id) AS left_id FROM {dense_transactions} WHERE inflow GROUP BY 1, 2, 3), b AS (SELECT day, amount, merchant, count(*) AS n, min(id) AS right_id FROM {dense_transactions} WHERE NOT inflow GROUP BY 1, 2, 3)
  SELECT day, amount, merchant, left_id, right_id FROM a JOIN b USING (day, amount, merchant) WHERE a.n = 1 AND b.n = 1""")
def _(t):
    rows = t["dense_transactions"]
    return linkage.unique_pairs(rows.filter("inflow"), rows.filter("not inflow"), ["day", "amount", "merchant"])


_CAND = "SELECT CASE WHEN n % 9 = 0 THEN n - 1 ELSE n END AS old_id, 1000000 + CASE WHEN n % 11 = 0 THEN n - 2 ELSE n END AS new_id FROM {transactions}"


@query("jn33_merge_candidates", f"WITH c AS (SELECT DISTINCT * FROM ({_CAND})) SELECT old_id, new_id FROM (SELECT *, count(*) OVER (PARTITION BY old_id) AS o, count(*) OVER (PARTITION BY new_id) AS k FROM c) WHERE o = 1 AND k = 1")
def _(t):
    return linkage.one_to_one(t.spark.sql(_CAND, transactions=t["transactions"]))


@query("jn39_lifecycle_dedupe", "SELECT k AS lifecycle, id FROM (SELECT n // 3 AS k, id, row_number() OVER (PARTITION BY n // 3 ORDER BY CASE status WHEN 'posted' THEN 0 ELSE 1 END, n) AS r FROM {transactions}) WHERE r = 1")
def _(t):
    rows = t["transactions"].select(F.expr("n div 3").alias("lifecycle"), "id", "n", (F.col("status") != "posted").alias("late"))
    return ledger.latest_per(rows, ["lifecycle"], F.asc("late"), F.asc("n")).select("lifecycle", "id")


@query("wn4_cash_fifo", """WITH w AS (SELECT id, strftime(day, '%Y-%m') AS month, day, amount FROM {withdrawals}), n AS (SELECT strftime(expense_date, '%Y-%m') AS month, CAST(sum(amount) * 2 AS DECIMAL(18,2)) AS need FROM {cash_expenses} GROUP BY 1),
  p AS (SELECT month, sum(amount) AS pool FROM w GROUP BY 1), o AS (SELECT strftime(CAST(n.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS month, greatest(0, need - coalesce(pool, 0)) AS over FROM n LEFT JOIN p USING (month)),
  a AS (SELECT w.*, coalesce(over, 0) AS over, least(amount, greatest(0, coalesce(need, 0) - coalesce(sum(amount) OVER (PARTITION BY w.month ORDER BY day, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS own FROM w LEFT JOIN n USING (month) LEFT JOIN o USING (month)),
  b AS (SELECT *, least(amount - own, greatest(0, over - coalesce(sum(amount - own) OVER (PARTITION BY month ORDER BY day DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS late FROM a)
  SELECT id, month, CAST(amount AS DOUBLE) AS amount, CAST(own + late AS DOUBLE) AS allocated, CAST(amount - own - late AS DOUBLE) AS remaining FROM b""")
def _(t):
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")
    needs = t["cash_expenses"].groupBy(month("expense_date")).agg((F.sum("amount") * 2).cast("decimal(18,2)").alias("need"))
    return series.allocate_cash(t["withdrawals"].select("id", month("day"), "day", "amount"), needs)


@query("wn5_backfill", """WITH d AS (SELECT account_id, CAST(posted_date AS DATE) AS day, sum(amount) AS net FROM {transactions} GROUP BY 1, 2), a AS (SELECT account_id, arg_max(balance, (as_of_day, n)) AS anchor, max(as_of_day) AS anchor_day FROM {snapshots} WHERE as_of_day <= DATE '2000-01-15' GROUP BY 1)
  SELECT account_id, day, CAST(anchor - coalesce(sum(net) OVER (PARTITION BY account_id ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS balance FROM d JOIN a USING (account_id) WHERE day <= anchor_day""")
def _(t):
    anchors = series.balance_as_of(t["snapshots"], "2000-01-15").select("account_id", F.col("balance").alias("anchor"), F.col("as_of_day").alias("anchor_day"))
    return series.backfill(t["transactions"].select("account_id", F.col("posted_date").cast("date").alias("day"), "amount"), anchors)


@query("wn10_statement_periods", "SELECT account_id, billing_period, closing_date, lag(closing_date) OVER (PARTITION BY account_id ORDER BY billing_period) AS previous_closing FROM {bills}")
def _(t):
    return series.statement_periods(t["bills"]).select("account_id", "billing_period", "closing_date", "previous_closing")


@query("ag16_net_worth_series", """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', as_of_day) AS DATE) AS month FROM {snapshots}),
  l AS (SELECT account_id, CAST(date_trunc('month', as_of_day) AS DATE) AS month, arg_max(balance, (as_of_day, n)) AS balance FROM {snapshots} GROUP BY 1, 2),
  c AS (SELECT account_id, month, balance, lead(month) OVER (PARTITION BY account_id ORDER BY month) AS until FROM l),
  r AS (SELECT a.id, CAST(CASE WHEN a.account_type = 'credit' THEN -1 ELSE 1 END * CASE WHEN a.currency = 'TWD' THEN 1.0 ELSE coalesce(x.rate_to_twd, 0.0) END AS DECIMAL(10,4)) AS rate FROM {accounts} a LEFT JOIN {rates} x ON x.currency = a.currency)
  SELECT m.month, CAST(sum(CAST(balance * rate AS DECIMAL(24,4))) AS DOUBLE) AS net_worth FROM m JOIN c ON c.month <= m.month AND (until IS NULL OR until > m.month) JOIN r ON r.id = c.account_id GROUP BY 1""")
def _(t):
    return series.net_worth_by_month(t["snapshots"], t["accounts"], t["rates"])


@query("ag13_dashboard", """SELECT (SELECT count(*) FROM {invoices}) AS invoices, (SELECT count(*) FROM {accounts}) AS accounts,
  (SELECT CAST(sum(balance) AS DOUBLE) FROM (SELECT arg_max(balance, (as_of_day, n)) AS balance FROM {snapshots} GROUP BY account_id)) AS balances""")
def _(t):
    last = t["snapshots"].groupBy("account_id").agg(F.max_by("balance", F.struct("as_of_day", "n")).alias("balance")).agg(F.sum("balance").cast("double").alias("balances"))
    one = lambda name: t[name].agg(F.count(F.lit(1)).alias(name))
    # three relations of one row each
    return one("invoices").join(one("accounts"), F.lit(True)).join(last, F.lit(True))


@query("ag20_bill_status", """WITH p AS (SELECT account_id, CAST(posted_date AS DATE) AS day, amount FROM {transactions} WHERE amount > 0 AND account_type = 'credit'),
  b AS (SELECT *, lead(closing_date) OVER (PARTITION BY account_id ORDER BY closing_date) AS next_closing FROM {bills}),
  s AS (SELECT b.account_id, b.billing_period, b.statement_amount, coalesce(sum(p.amount), 0) AS paid FROM b LEFT JOIN p ON p.account_id = b.account_id AND p.day > b.closing_date AND (b.next_closing IS NULL OR p.day <= b.next_closing) GROUP BY 1, 2, 3)
  SELECT account_id, billing_period, CAST(statement_amount AS DOUBLE) AS statement_amount, CAST(paid AS DOUBLE) AS paid, CAST(greatest(0, statement_amount - paid) AS DOUBLE) AS remaining, CASE WHEN paid >= statement_amount THEN 'paid' WHEN paid > 0 THEN 'partial' ELSE 'unpaid' END AS status FROM s""")
def _(t):
    payments = t["transactions"].filter("amount > 0 and account_type = 'credit'").select("account_id", F.col("posted_date").cast("date").alias("day"), "amount")
    return series.bill_status(t["bills"], payments)


@query("ag24_frequent_cash", "SELECT description, amount, category_id, count(*) AS n, max(expense_date) AS last_day FROM {cash_expenses} WHERE expense_date > DATE '2001-07-15' - 90 GROUP BY 1, 2, 3 ORDER BY n DESC, last_day DESC, description, amount LIMIT 8")
def _(t):
    rows = t["cash_expenses"].filter(F.col("expense_date") > F.date_sub(F.lit(TODAY).cast("date"), 90)).groupBy("description", "amount", "category_id").agg(F.count(F.lit(1)).alias("n"), F.max("expense_date").alias("last_day"))
    return rows.orderBy(F.desc("n"), F.desc("last_day"), "description", "amount").limit(8)


@query("ag30_category_shares", f"{_ACT}, c AS (SELECT category_id, sum(-twd) AS s FROM act WHERE role = 'spending' AND twd < 0 GROUP BY 1) SELECT category_id, CAST(s AS DOUBLE) AS spending, floor(CAST(s AS DOUBLE) / CAST(sum(s) OVER () AS DOUBLE) * 1000 + 0.5) / 10 AS percent FROM c")
def _(t):
    by = _activity(t).filter("role = 'spending' and twd < 0").groupBy("category_id").agg(F.sum(-F.col("twd")).alias("s"))
    share = F.col("s").cast("double") / F.sum("s").over(Window.partitionBy()).cast("double")  # over the few categories
    return by.select("category_id", F.col("s").cast("double").alias("spending"), (F.floor(share * 1000 + 0.5) / F.lit(10.0)).alias("percent"))


@query("se5_new_merchants", "SELECT DISTINCT account_id FROM {transactions} WHERE posted_date >= '2001-06' AND account_id NOT IN (SELECT account_id FROM {transactions} WHERE posted_date < '2001-06')")
def _(t):
    rows = t["transactions"].select("account_id", "posted_date")
    return rows.filter("posted_date >= '2001-06'").select("account_id").distinct().join(rows.filter("posted_date < '2001-06'").select("account_id"), "account_id", "left_anti")


_OLD = "SELECT id, status, amount, description, CASE WHEN n % 4 = 0 THEN 'peer' || n END AS transfer_peer_id, authorized_at FROM {transactions} WHERE n % 3 <> 1"
_NEW = "SELECT id, CASE WHEN n % 2 = 0 THEN 'posted' ELSE 'pending' END AS status, amount * 2 AS amount, lower(description) AS description, CASE WHEN n % 8 = 1 THEN 'new' || n END AS transfer_peer_id, posted_date AS authorized_at FROM {transactions} WHERE n % 3 <> 2"


@query("up_merge_transactions", f"""WITH o AS ({_OLD}), n AS ({_NEW}), j AS (SELECT o.id AS oid, n.id AS nid, o.status AS os, n.status AS ns, o.amount AS oa, n.amount AS na, o.description AS od, n.description AS nd, o.transfer_peer_id AS op, n.transfer_peer_id AS np, o.authorized_at AS ot, n.authorized_at AS nt,
  coalesce(o.status = 'posted' AND n.status = 'pending', FALSE) AS stale FROM o FULL JOIN n ON o.id = n.id)
  SELECT coalesce(oid, nid) AS id, CASE WHEN nid IS NULL OR stale THEN os ELSE ns END AS status, CAST(CASE WHEN nid IS NULL OR stale THEN oa ELSE na END AS DOUBLE) AS amount, CASE WHEN nid IS NULL OR stale THEN od ELSE nd END AS description, coalesce(np, op) AS transfer_peer_id,
  coalesce(CASE WHEN length(ot) > 10 AND coalesce(length(nt), 0) <= 10 THEN ot END, CASE WHEN stale THEN ot END, nt, ot) AS authorized_at FROM j""")
def _(t):
    own, n = t["transactions"], F.col("n")
    old = own.filter("n % 3 <> 1").select("id", "status", "amount", "description", F.when(n % 4 == 0, F.concat(F.lit("peer"), n)).alias("transfer_peer_id"), "authorized_at")
    new = own.filter("n % 3 <> 2").select("id", F.when(n % 2 == 0, "posted").otherwise("pending").alias("status"), (F.col("amount") * 2).alias("amount"), F.lower("description").alias("description"), F.when(n % 8 == 1, F.concat(F.lit("new"), n)).alias("transfer_peer_id"), F.col("posted_date").alias("authorized_at"))
    return ingest.merge_transactions(old, new).withColumn("amount", F.col("amount").cast("double"))


@query("ag28_new_records", "SELECT count(*) AS n FROM (SELECT 'txn:' || o_orderkey AS id FROM {orders} WHERE o_orderkey % 3 <> 2) WHERE id NOT IN (SELECT id FROM {transactions} WHERE n % 3 <> 1)")
def _(t):
    new = t["orders"].filter("o_orderkey % 3 <> 2").select(F.concat(F.lit("txn:"), "o_orderkey").alias("id"))
    return ingest.new_records(t["transactions"].filter("n % 3 <> 1"), new).agg(F.count(F.lit(1)).alias("n"))


@query("nm12_last_wins", "SELECT account_id, id FROM (SELECT account_id, id, row_number() OVER (PARTITION BY account_id ORDER BY n DESC) AS r FROM {transactions}) WHERE r = 1")
def _(t):
    return ingest.last_of_each(t["transactions"].select("account_id", "id", "n"), "account_id", "n").select("account_id", "id")


@query("nm5_parsed_numbers", "SELECT id, CAST(CASE WHEN amount < 0 THEN amount ELSE amount END AS DOUBLE) AS amount FROM {transactions}")
def _(t):
    text = F.when(F.col("amount") < 0, F.concat(F.lit("($"), F.format_number(-F.col("amount"), 2), F.lit(")"))).otherwise(F.format_number("amount", 2))
    return t["transactions"].select("id", C.parsed_number(text).cast("double").alias("amount"))


@query("nm1_parsed_dates", "SELECT id, CAST(posted_date AS DATE) AS day FROM {transactions}")
def _(t):
    day, k = F.col("posted_date").cast("date"), F.col("n") % 3
    roc = F.concat((F.year(day) - 1911).cast("string"), F.date_format(day, "/MM/dd"))
    return t["transactions"].select("id", C.parsed_date(F.when(k == 0, roc).when(k == 1, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "yyyy.M.d"))).alias("day"))


@query("nm9_occurrence_ids", "SELECT id, row_number() OVER (PARTITION BY account_id, description ORDER BY n) AS occurrence FROM {transactions}")
def _(t):
    w = Window.partitionBy("account_id", "description").orderBy("n")
    return t["transactions"].select("id", F.row_number().over(w).alias("occurrence"))


@query("ag9_usable_months", f"""{_ACT}, m AS (SELECT month, count(*) FILTER ({_PLAIN}) AS n, {_sum(_PLAIN + " AND role = 'income'", "twd")} AS income FROM act GROUP BY 1)
  SELECT count(*) AS usable_months, median(CASE WHEN income > 0 THEN income END) AS median_income FROM m WHERE n > 0 AND n * 2 >= (SELECT max(n) FROM m)""")
def _(t):
    return ledger.usable_months(ledger.month_summary(_activity(t)))


@query("ag12_merchant_history", f"""{_ACT}, c AS (SELECT counterparty, category_id, count(*) AS n FROM act WHERE rule_id IS NOT NULL GROUP BY 1, 2)
  SELECT counterparty, category_id FROM (SELECT *, row_number() OVER (PARTITION BY counterparty ORDER BY n DESC, category_id) AS r FROM c) WHERE r = 1""")
def _(t):
    return ledger.most_frequent(_activity(t).filter("rule_id is not null"), "counterparty", "category_id")


@query("ag31_month_trend", f"""{_ACT}, s AS (SELECT strftime(CAST(range AS DATE), '%Y-%m') AS month FROM range(DATE '2000-11-01', DATE '2001-11-01', INTERVAL 1 MONTH)), m AS (SELECT month, {_sum(_PLAIN + " AND role = 'spending'", "-twd")} AS spending FROM act GROUP BY 1)
  SELECT s.month, coalesce(spending, 0) AS spending, m.month IS NULL AS no_data FROM s LEFT JOIN m USING (month)""")
def _(t):
    months = t.spark.sql("SELECT date_format(d, 'yyyy-MM') AS month FROM (SELECT explode(sequence(DATE '2000-11-01', DATE '2001-10-01', INTERVAL 1 MONTH)) AS d)")
    got = ledger.month_summary(_activity(t).filter("month between '2000-11' and '2001-10'")).select("month", "spending")
    return months.join(got, "month", "left").select("month", F.coalesce("spending", F.lit(0.0)).alias("spending"), F.col("spending").isNull().alias("no_data"))


annotating.register()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
