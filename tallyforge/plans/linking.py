"""Queries of the linkage, bill and net-worth operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import ledger, linkage, series
from tallyforge.plans.catalog import query
from tallyforge.sources.tables import TODAY

_C = F.col


@query("jn14_late_invoices", """WITH l AS (SELECT DISTINCT merchant AS seller, account_id, merchant FROM {dense_transactions} WHERE id % 3 <> 1),
  p AS (SELECT i.id AS invoice_id, t.id AS transaction_id, CAST(i.day - t.day AS INT) AS late_by FROM {dense_invoices} i JOIN {dense_transactions} t ON t.day BETWEEN i.day - 7 AND i.day AND t.amount = i.amount AND NOT t.inflow JOIN l ON l.seller = i.seller AND l.account_id = t.account_id AND l.merchant = t.merchant)
  SELECT invoice_id, transaction_id, late_by FROM (SELECT *, count(*) OVER (PARTITION BY invoice_id) AS a, count(*) OVER (PARTITION BY transaction_id) AS b FROM p) WHERE a = 1 AND b = 1""")
def _(t):
    learned = t["dense_transactions"].filter("id % 3 <> 1").select(_C("merchant").alias("seller"), "account_id", "merchant")
    return linkage.late_invoices(t["dense_invoices"], t["dense_transactions"].filter("not inflow"), learned)


_PEERS = """SELECT o_orderkey AS id, o_orderkey % 3 AS account_id, CASE WHEN o_orderkey % 4 = 0 THEN 'time_deposit' WHEN o_orderkey % 5 = 0 THEN 'credit' ELSE 'checking' END AS account_type,
  CASE WHEN o_orderkey % 13 = 0 THEN 'pending' ELSE 'posted' END AS status, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * (o_orderkey % 40 - o_orderkey % 4) AS BIGINT) AS amount, 'TWD' AS currency, DATE '2001-01-01' AS day,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 28 = 2 THEN o_orderkey - 1 END AS transfer_peer_id FROM {orders}"""


@query("jn21_explicit_peers", f"""WITH r AS ({_PEERS}), k AS (SELECT transfer_peer_id FROM r WHERE transfer_peer_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
  SELECT c.id, p.id AS peer_id FROM r c JOIN k USING (transfer_peer_id) JOIN r p ON p.id = c.transfer_peer_id WHERE c.account_type = 'time_deposit' AND p.account_type = 'checking' AND c.status = 'posted' AND p.status = 'posted' AND c.amount <> 0 AND c.amount = -p.amount AND c.account_id <> p.account_id""")
def _(t):
    return linkage.explicit_peers(t.spark.sql(_PEERS, orders=t["orders"]))


_OWNED = "SELECT * FROM (VALUES ('a', '012', '1234', 'own_account', 0), ('b', '012', '11234', 'unsynced_card', 1), ('c', '013', '0042', 'own_account', 2), ('d', '013', '0042', 'unsynced_card', 3), ('e', '013', '042', 'own_account', 4)) AS t(id, bank_code, account_suffix, kind, position)"
_SEEN = "SELECT id, CASE WHEN n % 2 = 0 THEN '012' ELSE '013' END AS bank_code, CASE n % 5 WHEN 0 THEN '11234' WHEN 1 THEN '1234' WHEN 2 THEN '90042' WHEN 3 THEN '042' END AS account_suffix FROM {transactions}"


@query("jn24_own_accounts", f"""WITH o AS ({_OWNED}), s AS ({_SEEN}) SELECT id, own_id, kind FROM (SELECT s.id, o.id AS own_id, o.kind, row_number() OVER (PARTITION BY s.id ORDER BY length(o.account_suffix) DESC, position) AS r
  FROM s JOIN o ON s.bank_code = o.bank_code AND ends_with(s.account_suffix, o.account_suffix) AND length(o.account_suffix) BETWEEN 4 AND 5) WHERE r = 1""")
def _(t):
    return linkage.own_account_matches(t.spark.sql(_SEEN, transactions=t["transactions"]), t.spark.sql(_OWNED))


_FEES = "SELECT id, merchant AS account_id, day, floor(amount * 0.015E0 + 0.5E0) AS amount, CASE WHEN id % 14 = 0 THEN amount + 100 END AS base FROM {dense_transactions} WHERE id % 7 = 0"
_BOUGHT = "SELECT id, merchant AS account_id, day, amount, CASE WHEN id % 3 = 0 THEN '商店' ELSE 'shop' END AS text FROM {dense_transactions} WHERE id % 7 <> 0"


@query("jn25_foreign_fees", f"""WITH f AS ({_FEES}), p AS ({_BOUGHT}), c AS (SELECT f.id AS fee_id, p.id AS purchase_id, p.text = '商店' AS han, count(*) OVER (PARTITION BY f.id) AS n FROM f JOIN p ON p.account_id = f.account_id AND p.day BETWEEN f.day - 2 AND f.day + 2
    AND CASE WHEN base IS NOT NULL THEN p.amount = base ELSE abs(floor(p.amount * 0.015E0 + 0.5E0) - f.amount) <= 1 END)
  SELECT fee_id, min(purchase_id) AS purchase_id FROM c WHERE n = 1 OR NOT han GROUP BY 1 HAVING count(*) = 1""")
def _(t):
    return linkage.foreign_fees(t.spark.sql(_FEES, dense_transactions=t["dense_transactions"]), t.spark.sql(_BOUGHT, dense_transactions=t["dense_transactions"]))


@query("jn29_fifo_authorizations", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY merchant, day, amount, inflow ORDER BY id) AS n FROM {dense_transactions})
  SELECT a.merchant, a.day, a.amount, CAST(a.n AS INT) AS n, a.id AS left_id, b.id AS right_id FROM r a JOIN r b USING (merchant, day, amount, n) WHERE a.inflow AND NOT b.inflow""")
def _(t):
    return linkage.rank_pairs(t["dense_transactions"], ["merchant", "day", "amount"], "inflow", "id")


@query("jn31_near_unique_pairs", """WITH p AS (SELECT a.id AS left_id, b.id AS right_id FROM {dense_transactions} a JOIN {dense_transactions} b ON a.merchant = b.merchant AND a.amount = b.amount AND b.day BETWEEN a.day - 1 AND a.day + 1 WHERE a.inflow AND NOT b.inflow)
  SELECT left_id, right_id FROM (SELECT *, count(*) OVER (PARTITION BY left_id) AS m, count(*) OVER (PARTITION BY right_id) AS n FROM p) WHERE m = 1 AND n = 1""")
def _(t):
    rows = t["dense_transactions"]
    return linkage.near_unique_pairs(rows.filter("inflow"), rows.filter("not inflow"), ["merchant", "amount"])


_IN = "SELECT CASE WHEN n % 5 = 0 THEN 'new' || n ELSE id END AS id, account_id, description, n FROM {transactions} WHERE n % 3 <> 0"


@query("jn32_claimed_identities", f"""WITH e AS (SELECT id, account_id, description, n FROM {{transactions}} WHERE n % 2 = 0), i AS ({_IN}),
  a AS (SELECT *, row_number() OVER (PARTITION BY account_id, description ORDER BY n) AS k FROM i WHERE id NOT IN (SELECT id FROM e)), b AS (SELECT *, row_number() OVER (PARTITION BY account_id, description ORDER BY n) AS k FROM e WHERE id NOT IN (SELECT id FROM i))
  SELECT a.id AS incoming_id, b.id AS existing_id FROM a JOIN b USING (account_id, description, k)""")
def _(t):
    return linkage.claim_identities(t["transactions"].filter("n % 2 = 0").select("id", "account_id", "description", "n"), t.spark.sql(_IN, transactions=t["transactions"]), ["account_id", "description"], "n")


@query("jn35_single_card_folds", """WITH a AS (SELECT id, connector_id || '/' || institution_name || '/' || CAST(substr(id, 6) AS BIGINT) // 50 AS g, account_type = 'credit' AS s FROM {accounts})
  SELECT min(CASE WHEN s THEN id END) AS summary_id, min(CASE WHEN NOT s THEN id END) AS card_id FROM a GROUP BY g HAVING count(*) FILTER (s) = 1 AND count(*) FILTER (NOT s) = 1""")
def _(t):
    group = F.concat_ws("/", "connector_id", "institution_name", F.expr("cast(substr(id, 6) AS BIGINT) div 50"))
    return linkage.single_card_folds(t["accounts"].select("id", group.alias("group_id"), (_C("account_type") == "credit").alias("is_summary")))


_NUMBERED = "SELECT CASE WHEN n % 3 = 0 THEN 'v2:' ELSE 'v1:' END || n AS id, n // 4 AS number, n FROM {transactions}"


@query("jn36_invoice_survivors", f"WITH r AS ({_NUMBERED}) SELECT id AS old_id, new_id FROM (SELECT id, first_value(id) OVER (PARTITION BY number ORDER BY CASE WHEN id LIKE 'v2:%' THEN 0 ELSE 1 END, id) AS new_id FROM r) WHERE id <> new_id")
def _(t):
    rows = t.spark.sql(_NUMBERED.replace("n // 4", "n div 4"), transactions=t["transactions"])
    return linkage.survivors(rows, "number", _C("id").startswith("v2:"))


@query("jn37_carried_settings", f"""WITH r AS ({_NUMBERED}), m AS (SELECT id, number, first_value(id) OVER (PARTITION BY number ORDER BY CASE WHEN id LIKE 'v2:%' THEN 0 ELSE 1 END, id) AS new_id, n FROM r), s AS (SELECT new_id AS id, 'role' || n % 4 AS value, n % 7 AS updated_at FROM m WHERE n % 2 = 0)
  SELECT id, value, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, value DESC) AS k FROM s) WHERE k = 1""")
def _(t):
    rows = t.spark.sql(_NUMBERED.replace("n // 4", "n div 4"), transactions=t["transactions"])
    settings = rows.filter("n % 2 = 0").selectExpr("id", "'role' || n % 4 AS value", "n % 7 AS updated_at")
    return linkage.carried_settings(settings, linkage.survivors(rows, "number", _C("id").startswith("v2:")))


_MONTHLY = "SELECT account_id, CAST(date_trunc('month', as_of_day) AS DATE) AS month, {best}(balance, {order}) AS value FROM {{snapshots}} WHERE as_of_day <= DATE '" + TODAY + "' GROUP BY 1, 2"


@query("wn8_carried_values", f"""WITH m AS ({_MONTHLY.format(best="arg_max", order="(as_of_day, n)")}), k AS (SELECT *, coalesce(CAST(lead(month) OVER (PARTITION BY account_id ORDER BY month) - INTERVAL 1 MONTH AS DATE), DATE '2001-07-01') AS stop FROM m)
  SELECT account_id, CAST(month + to_months(CAST(g AS INT)) AS DATE) AS month, CAST(value AS DOUBLE) AS value FROM (SELECT *, unnest(range(0, datediff('month', month, stop) + 1)) AS g FROM k)""")
def _(t):
    points = t.spark.sql(_MONTHLY.format(best="max_by", order="struct(as_of_day, n)").replace("{{", "{").replace("}}", "}"), snapshots=t["snapshots"])
    return series.carry_forward(points, "account_id", "2001-07-01").withColumn("value", _C("value").cast("double"))


@query("wn9_comparisons", """WITH d AS (SELECT account_id, as_of_day AS day, arg_max(balance, n) AS value FROM {snapshots} GROUP BY 1, 2), l AS (SELECT account_id, max(day) AS last, arg_max(value, day) AS now FROM d GROUP BY 1),
  g AS (SELECT *, unnest(['day', 'week', 'month']) AS period FROM l), h AS (SELECT *, CASE period WHEN 'day' THEN last - 1 WHEN 'week' THEN last - 7 ELSE CAST(last - INTERVAL 1 MONTH AS DATE) END AS target FROM g)
  SELECT account_id, period, max(day) AS previous_day, CAST(arg_max(value, day) AS DOUBLE) AS previous_value, CAST(any_value(now) - arg_max(value, day) AS DOUBLE) AS change, CASE WHEN arg_max(value, day) <> 0 THEN CAST(any_value(now) - arg_max(value, day) AS DOUBLE) / CAST(abs(arg_max(value, day)) AS DOUBLE) * 100 END AS percent
  FROM h JOIN d USING (account_id) WHERE day <= target GROUP BY 1, 2""")
def _(t):
    points = t["snapshots"].groupBy("account_id", _C("as_of_day").alias("day")).agg(F.max_by("balance", "n").alias("value"))
    return series.comparisons(points, "account_id")


_BILLED = "SELECT connector_id AS issuer, billing_period, currency, CASE WHEN length(account_id) % 2 = 0 THEN statement_amount END AS statement_amount, CASE WHEN billing_period < '1998' THEN statement_amount END AS paid_amount, billing_period < '1999' AS is_paid, closing_date + 15 AS due_date, closing_date FROM {bills}"


@query("ag19_issuer_bills", f"""WITH b AS ({_BILLED}), c AS (SELECT issuer, billing_period, arg_min(currency, (CASE WHEN currency = 'TWD' THEN 0 ELSE 1 END, currency)) AS currency FROM b GROUP BY 1, 2)
  SELECT issuer, billing_period, currency, CAST(sum(abs(statement_amount)) AS DOUBLE) AS statement_amount, CAST(sum(abs(paid_amount)) AS DOUBLE) AS paid_amount, bool_and(is_paid) AS is_paid, min(due_date) AS due_date, max(closing_date) AS closing_date FROM b JOIN c USING (issuer, billing_period, currency) GROUP BY 1, 2, 3""")
def _(t):
    out = series.issuer_bills(t.spark.sql(_BILLED, bills=t["bills"]))
    return out.withColumns({c: _C(c).cast("double") for c in ("statement_amount", "paid_amount")})


_LINES = "SELECT account_id, CAST(posted_date AS DATE) AS day, CASE WHEN currency = 'KRW' THEN NULL WHEN n % 97 = 0 THEN NULL ELSE amount END AS twd FROM {transactions} WHERE account_type = 'credit'"


@query("ag22_estimated_statements", f"""WITH l AS ({_LINES}), b AS (SELECT *, lag(closing_date) OVER (PARTITION BY account_id ORDER BY closing_date) AS before FROM {{bills}})
  SELECT b.account_id, b.billing_period, CASE WHEN count(*) FILTER (l.day IS NOT NULL AND l.twd IS NULL) = 0 THEN CAST(greatest(0, coalesce(sum(-l.twd), 0)) AS DOUBLE) END AS estimate FROM b LEFT JOIN l ON l.account_id = b.account_id AND l.day > b.before AND l.day <= b.closing_date WHERE before IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return series.estimated_statements(t["bills"], t.spark.sql(_LINES, transactions=t["transactions"]))


@query("ag29_freshness", f"SELECT connector_id, max(posted_date) AS last_success, DATE '{TODAY}' - CAST(max(posted_date) AS DATE) > 2 AS stale FROM {{transactions}} WHERE status = 'posted' AND account_type <> 'savings' GROUP BY 1")
def _(t):
    last = t["transactions"].filter("status = 'posted' and account_type <> 'savings'").groupBy("connector_id").agg(F.max("posted_date").alias("last_success"))
    return last.withColumn("stale", F.datediff(F.lit(TODAY).cast("date"), _C("last_success").cast("date")) > 2)


@query("ag14_financial_snapshot", """WITH l AS (SELECT account_id, arg_max(balance, (as_of_day, n)) AS balance FROM {snapshots} GROUP BY 1), v AS (SELECT a.account_type, a.currency, balance, CAST(CASE WHEN a.currency = 'TWD' THEN 1 ELSE rate_to_twd END AS DECIMAL(10,4)) AS rate FROM l JOIN {accounts} a ON a.id = l.account_id LEFT JOIN {rates} r ON r.currency = a.currency)
  SELECT CAST(coalesce(sum(CASE WHEN account_type <> 'credit' THEN CAST(balance * rate AS DECIMAL(24,4)) END), 0) AS DOUBLE) AS assets, CAST(coalesce(sum(CASE WHEN account_type = 'credit' THEN CAST(balance * rate AS DECIMAL(24,4)) END), 0) AS DOUBLE) AS card_debt, coalesce(string_agg(DISTINCT CASE WHEN rate IS NULL THEN currency END, ','), '') AS missing_currencies FROM v""")
def _(t):
    last = t["snapshots"].groupBy("account_id").agg(F.max_by("balance", F.struct("as_of_day", "n")).alias("balance"))
    rate = F.when(_C("currency") == "TWD", F.lit(1.0)).otherwise(_C("rate_to_twd")).cast("decimal(10,4)")
    rows = last.join(t["accounts"].withColumnRenamed("id", "account_id"), "account_id").join(t["rates"], "currency", "left").withColumn("rate", rate)
    value = (_C("balance") * _C("rate")).cast("decimal(24,4)")
    total = lambda test: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("double")
    return rows.agg(total(_C("account_type") != "credit").alias("assets"), total(_C("account_type") == "credit").alias("card_debt"), F.array_join(F.array_sort(F.collect_set(F.when(_C("rate").isNull(), _C("currency")))), ",").alias("missing_currencies"))


_WORDED = "SELECT invoice_id, line_number, CASE WHEN line_number = 3 THEN NULL ELSE amount END AS amount, CASE WHEN length(description) % 4 = 0 THEN 'food' WHEN length(description) % 4 = 1 THEN 'fun' WHEN length(description) % 4 = 2 THEN 'home' END AS category_id FROM {invoice_items}"


@query("ag32_item_categories", f"""WITH r AS (SELECT *, CASE WHEN amount > 0 THEN amount ELSE 1 END AS w FROM ({_WORDED})), g AS (SELECT invoice_id, category_id, sum(w) AS w, min(line_number) AS f FROM r GROUP BY 1, 2), k AS (SELECT *, sum(w) OVER (PARTITION BY invoice_id) AS total FROM g),
  b AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY w DESC, f, category_id) AS k FROM k WHERE category_id IS NOT NULL) SELECT invoice_id, category_id FROM b WHERE k = 1 AND CAST(w AS DOUBLE) / CAST(total AS DOUBLE) >= 0.4E0""")
def _(t):
    return ledger.item_category(t.spark.sql(_WORDED, invoice_items=t["invoice_items"]))


_PLAN = "SELECT 'snap:' || n AS id, account_id, as_of_day, CAST(n % 1000 AS DECIMAL(18,2)) AS balance, TRUE AS derived FROM {snapshots} WHERE n % 8 = 0 OR n % 9 = 1"


@query("sk4_derived_snapshots", f"SELECT id, account_id, as_of_day, CAST(balance AS DOUBLE) AS balance, derived FROM (SELECT id, account_id, as_of_day, balance, derived FROM {{snapshots}} WHERE NOT derived UNION ALL SELECT * FROM ({_PLAN}) WHERE id NOT IN (SELECT id FROM {{snapshots}} WHERE NOT derived))")
def _(t):
    have = t["snapshots"].select("id", "account_id", "as_of_day", "balance", "derived")
    return series.replace_derived(have, t.spark.sql(_PLAN, snapshots=t["snapshots"])).withColumn("balance", _C("balance").cast("double"))


_ITEMS = "SELECT id, account_type, amount, currency, CASE WHEN n % 9 = 0 THEN 'food' WHEN n % 9 = 1 THEN 'misc' END AS category_id, n % 10 = 0 AS duplicate, CASE n % 5 WHEN 0 THEN 'ATM 提款' WHEN 1 THEN '提款卡' WHEN 2 THEN '跨行提款手續費' WHEN 3 THEN '跨行提款' ELSE description END AS text, n FROM {transactions}"


@query("fl8_withdrawals", "SELECT id FROM {transactions} WHERE account_type <> 'credit' AND amount < 0 AND currency = 'TWD' AND n % 9 <> 0 AND n % 10 <> 0 AND n % 5 IN (0, 3)")
def _(t):
    rows = t.spark.sql(_ITEMS, transactions=t["transactions"])
    item = {c: _C(c) for c in ("amount", "currency", "category_id", "duplicate", "text")}
    return rows.filter(ledger.is_withdrawal(item | {"source": F.when(_C("account_type") == "credit", "card").otherwise("bank"), "role": F.lit("spending")})).select("id")
