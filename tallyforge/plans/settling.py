"""Queries of invoice roles, fee categories, running balances and net-worth points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import invoices, linkage, series
from tallyforge.plans.catalog import query

_C = F.col
_FI = "SELECT id, seller, CAST(amount * 0.03E0 AS DOUBLE) AS amount, CASE WHEN id % 3 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CASE WHEN id % 3 = 0 THEN CAST(amount AS DOUBLE) END AS twd, day FROM {dense_invoices}"
_FP = "SELECT id, merchant, CAST(CASE WHEN id % 4 = 0 THEN amount * 0.03E0 ELSE amount END AS DOUBLE) AS amount, CASE WHEN id % 8 = 0 THEN 'USD' WHEN id % 4 = 0 THEN 'EUR' ELSE 'TWD' END AS currency, day FROM {dense_transactions}"


@query("jn11_foreign_edges", f"""WITH i AS ({_FI}), p AS ({_FP}), e AS (SELECT i.id AS invoice_id, p.id AS transaction_id, abs(p.day - i.day) AS gap FROM i JOIN p ON p.merchant = i.seller AND p.day BETWEEN i.day - 1 AND i.day + 5
  AND CASE WHEN p.currency = i.currency THEN abs(p.amount - i.amount) <= greatest(i.amount * 0.01E0, 0.01E0) WHEN p.currency = 'TWD' THEN coalesce(i.twd > 0 AND abs(p.amount - i.twd) <= greatest(i.twd * 0.05E0, {invoices.CONVERTED_LEAST}), FALSE) ELSE FALSE END)
  SELECT invoice_id, transaction_id, CAST(gap AS INT) AS gap, CAST(5 + CASE gap WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS INT) AS score FROM e""")
def _(t):
    return invoices.foreign_edges(t.spark.sql(_FI, dense_invoices=t["dense_invoices"]), t.spark.sql(_FP, dense_transactions=t["dense_transactions"]))


_LINKS = "SELECT seller, 'acct:' || id % 50 AS account_id, seller AS merchant, CASE WHEN id % 9 = 0 THEN 'USD' ELSE 'TWD' END AS currency, day AS invoice_day, day - CAST(id % 12 AS INT) AS day FROM {dense_invoices}"


@query("jn15_learned_merchants", f"SELECT DISTINCT seller, account_id, merchant FROM ({_LINKS}) WHERE currency = 'TWD' AND invoice_day - day > 3 AND invoice_day - day <= 7")
def _(t):
    return invoices.learned_merchants(t.spark.sql(_LINKS, dense_invoices=t["dense_invoices"]))


_ROLES = "SELECT id, 'spending' AS role, 'sign' AS reason, CASE WHEN id % 3 = 0 THEN 'confirmed' ELSE 'auto' END AS review, CASE id % 8 WHEN 0 THEN 'awaiting_card' WHEN 2 THEN 'ambiguous' WHEN 4 THEN 'unmatched' ELSE 'matched_card' END AS status, id % 5 = 0 AS overdue, id % 11 = 0 AS voided, id % 7 = 0 AS duplicate FROM {dense_invoices}"


@query("cl14_resolved_roles", f"""SELECT id, CASE WHEN voided THEN 'excluded' ELSE role END AS role, CASE WHEN voided THEN 'invoice_voided' WHEN duplicate THEN reason WHEN status = 'awaiting_card' THEN 'invoice_awaiting_card' WHEN status = 'ambiguous' AND review <> 'confirmed' THEN 'invoice_ambiguous' ELSE reason END AS reason,
  CASE WHEN voided THEN 'auto' WHEN duplicate OR review = 'confirmed' THEN review WHEN status = 'awaiting_card' AND overdue OR status = 'ambiguous' THEN 'needs_review' ELSE review END AS review FROM ({_ROLES})""")
def _(t):
    rows = t.spark.sql(_ROLES, dense_invoices=t["dense_invoices"])
    return rows.select("id", invoices.resolved_role({c: _C(c) for c in rows.columns}).alias("r")).select("id", "r.*")


_MARKED = "SELECT id, 'spending' AS role, CASE WHEN n % 5 = 0 THEN 'override' ELSE 'sign' END AS reason, advance_counterparty AS counterparty, n FROM {transactions}"
_ADV = "SELECT 'inv:' || n AS id, CASE WHEN n % 4 = 0 THEN 'spending' ELSE 'advance' END AS role, CASE WHEN n % 6 = 0 THEN 'sign' ELSE 'override' END AS reason, CASE WHEN n % 9 <> 0 THEN 'txn:' || (n - n % 2) END AS duplicate_of, CASE WHEN n % 10 <> 0 THEN 'Friend' || n % 7 END AS counterparty FROM {transactions}"


@query("cl15_carried_advances", f"""WITH m AS ({_MARKED}), a AS ({_ADV}), f AS (SELECT duplicate_of, id AS inv, counterparty, row_number() OVER (PARTITION BY duplicate_of ORDER BY id) AS r FROM a WHERE role = 'advance' AND reason = 'override' AND duplicate_of IS NOT NULL)
  SELECT m.id, CASE WHEN inv IS NOT NULL AND reason <> 'override' THEN 'advance' ELSE role END AS role, CASE WHEN inv IS NOT NULL AND reason <> 'override' THEN 'invoice_override' ELSE reason END AS reason, CASE WHEN inv IS NOT NULL AND reason <> 'override' THEN f.counterparty ELSE m.counterparty END AS counterparty FROM m LEFT JOIN f ON f.duplicate_of = m.id AND r = 1""")
def _(t):
    tx = t["transactions"]
    return invoices.carry_advances(t.spark.sql(_MARKED, transactions=tx), t.spark.sql(_ADV, transactions=tx))


_CAT = "SELECT id, CASE WHEN n % 4 = 0 THEN 'other' WHEN n % 4 = 1 THEN 'food' ELSE 'fun' END AS category_id, CASE WHEN n % 5 = 0 THEN 'user' WHEN n % 5 = 1 THEN 'merchant_rule' WHEN n % 5 = 2 THEN 'rule' END AS category_source FROM {transactions}"
_OF = "SELECT id AS fee_id, 'txn:' || (n + 1) AS purchase_id FROM {transactions} WHERE n % 3 = 0"


@query("cl25_fee_categories", f"""WITH c AS ({_CAT}), o AS ({_OF}), b AS (SELECT fee_id, category_id AS base FROM o JOIN c ON c.id = o.purchase_id WHERE category_id <> 'other')
  SELECT id, CASE WHEN base IS NOT NULL AND coalesce(category_source, '') NOT IN ('user', 'merchant_rule') THEN base ELSE category_id END AS category_id, CASE WHEN base IS NOT NULL AND coalesce(category_source, '') NOT IN ('user', 'merchant_rule') THEN 'rule' ELSE category_source END AS category_source FROM c LEFT JOIN b ON b.fee_id = c.id""")
def _(t):
    return invoices.fee_categories(t.spark.sql(_CAT, transactions=t["transactions"]), t.spark.sql(_OF, transactions=t["transactions"]))


@query("pj15_matched_amounts", "SELECT id, CASE WHEN t.currency = 'TWD' THEN CAST(amount AS DOUBLE) WHEN rate_to_twd > 0 THEN floor(CAST(amount AS DOUBLE) * rate_to_twd + 0.5) END AS amount, CASE WHEN t.currency <> 'TWD' THEN t.currency END AS currency, CASE WHEN t.currency <> 'TWD' THEN CAST(amount AS DOUBLE) END AS original FROM {transactions} t LEFT JOIN {rates} r ON r.currency = t.currency")
def _(t):
    rows = t["transactions"].join(t["rates"], "currency", "left")
    return rows.select("id", invoices.matched_amounts(_C("amount"), _C("currency"), _C("rate_to_twd")).alias("m")).select("id", "m.*")


_CASH = "SELECT id, n % 2 = 0 AS paid_in_cash, CASE WHEN n % 3 = 0 THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN n % 5 = 0 THEN 'advance' ELSE 'spending' END AS role, CASE WHEN n % 7 = 0 THEN TRUE END AS duplicate, currency, abs(amount) AS amount FROM {transactions}"


@query("fl9_cash_paid_invoices", "SELECT id FROM {transactions} WHERE n % 2 = 0 AND n % 3 <> 0 AND n % 5 <> 0 AND n % 7 <> 0 AND currency = 'TWD' AND amount <> 0")
def _(t):
    rows = t.spark.sql(_CASH, transactions=t["transactions"])
    return rows.filter(invoices.is_cash_paid({c: _C(c) for c in rows.columns})).select("id")


_RUN = """SELECT account_id, CAST(date_trunc('month', CAST(posted_date AS DATE)) AS DATE) AS day, n, amount,
  CAST(sum(amount) OVER (PARTITION BY account_id ORDER BY posted_date, n) + CASE WHEN n % 19 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS running FROM {transactions}"""
_ENDS = f"""r AS ({_RUN}), e AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM r o WHERE o.account_id = r.account_id AND o.day = r.day AND o.n <> r.n AND o.running - o.amount = r.running) AS is_end FROM r),
  d AS (SELECT account_id, day, CASE WHEN count(*) FILTER (is_end) = 1 THEN min(running) FILTER (is_end) ELSE arg_max(running, n) END AS balance, sum(amount) AS net FROM e GROUP BY 1, 2)"""


@query("wn7_day_end_balances", f"WITH {_ENDS} SELECT account_id, day, CAST(balance AS DOUBLE) AS balance FROM d")
def _(t):
    return series.day_end_balances(t.spark.sql(_RUN, transactions=t["transactions"])).select("account_id", "day", _C("balance").cast("double").alias("balance"))


@query("wn6_opening_balances", f"WITH {_ENDS} SELECT account_id, min(day) AS first_day, CAST(arg_min(balance - net, day) AS DOUBLE) AS opening FROM d GROUP BY 1")
def _(t):
    return series.opening_balances(series.day_end_balances(t.spark.sql(_RUN, transactions=t["transactions"]))).withColumn("opening", _C("opening").cast("double"))


_HIST = "SELECT id, as_of_day AS day, CASE WHEN n % 2 = 0 THEN 'manual' ELSE 'bank' END AS source, account_id AS asset_type, balance AS net_worth FROM {snapshots}"


@query("jn7_history_in_twd", f"""SELECT h.id, h.day, CASE WHEN source <> 'manual' OR a.currency = 'TWD' THEN CAST(net_worth AS DOUBLE) WHEN rate_to_twd IS NOT NULL THEN CAST(net_worth AS DOUBLE) * rate_to_twd ELSE 0.0E0 END AS value
  FROM ({_HIST}) h LEFT JOIN {{accounts}} a ON a.id = h.asset_type AND source = 'manual' LEFT JOIN {{rates}} r ON r.currency = a.currency""")
def _(t):
    return series.history_in_twd(t.spark.sql(_HIST, snapshots=t["snapshots"]), t["accounts"].select("id", "currency"), t["rates"])


_POINTS = "SELECT 'bank' AS source, account_id AS asset_type, as_of_day AS day, CAST(max(balance) AS DOUBLE) * {scale}.0E0 AS value FROM {{snapshots}} WHERE n % 3 <> {gone} GROUP BY 1, 2, 3"
_P1, _P2 = (_POINTS.format(scale=k, gone=k).replace("{{", "{").replace("}}", "}") for k in (1, 2))


@query("sk5_history_upsert", f"WITH o AS ({_P1}), n AS ({_P2}) SELECT source, asset_type, day, coalesce(n.value, o.value) AS value FROM o FULL JOIN n USING (source, asset_type, day)")
def _(t):
    return series.upsert_points(t.spark.sql(_P1, snapshots=t["snapshots"]), t.spark.sql(_P2, snapshots=t["snapshots"]))


_PREF = "SELECT id AS invoice_id, CASE WHEN id % 3 <> 0 THEN id // 8 END AS transaction_id, CASE WHEN id % 3 = 0 THEN 'separate' ELSE 'linked' END AS decision FROM {dense_invoices} WHERE id % 4 = 0"


@query("jn13_preferred_links", f"""WITH p AS ({_PREF}) SELECT min(invoice_id) AS invoice_id, transaction_id, 'linked' AS outcome FROM p WHERE decision = 'linked' GROUP BY transaction_id UNION ALL SELECT invoice_id, NULL, 'separate' FROM p WHERE decision = 'separate'""")
def _(t):
    return linkage.preferred_links(t.spark.sql(_PREF.replace("id // 8", "id div 8"), dense_invoices=t["dense_invoices"]))


@query("jn13_open_edges", f"""WITH p AS ({_PREF}), f AS (SELECT min(invoice_id) AS invoice_id, transaction_id FROM p WHERE decision = 'linked' GROUP BY transaction_id UNION ALL SELECT invoice_id, NULL FROM p WHERE decision = 'separate')
  SELECT i.id AS invoice_id, t.id AS transaction_id FROM {{dense_invoices}} i JOIN {{dense_transactions}} t ON t.day = i.day AND t.amount = i.amount AND NOT t.inflow WHERE i.id NOT IN (SELECT invoice_id FROM f) AND t.id NOT IN (SELECT transaction_id FROM f WHERE transaction_id IS NOT NULL)""")
def _(t):
    fixed = linkage.preferred_links(t.spark.sql(_PREF.replace("id // 8", "id div 8"), dense_invoices=t["dense_invoices"]))
    edges = linkage.candidate_edges(t["dense_invoices"], t["dense_transactions"].filter("not inflow"), 0).filter("exact")
    return linkage.open_edges(edges, fixed).select("invoice_id", "transaction_id")


_CARR = "SELECT id, CASE WHEN id % 3 = 0 THEN lpad(CAST(id % 10000 AS STRING), 4, '0') END AS carrier_suffix FROM {dense_invoices}"


@query("jn19_synced_carriers", f"SELECT id, CASE WHEN carrier_suffix IN (SELECT account_last4 FROM {{accounts}} WHERE account_type = 'credit') THEN carrier_suffix END AS carrier_suffix FROM ({_CARR})")
def _(t):
    return linkage.synced_carriers(t.spark.sql(_CARR, dense_invoices=t["dense_invoices"]), t["accounts"])


@query("cl20_shared_notes", "SELECT id, CASE WHEN n % 3 = 0 THEN 'note ' || n WHEN (n + 1) % 3 = 0 AND n + 1 IN (SELECT n FROM {transactions}) THEN 'note ' || (n + 1) END AS note FROM {transactions}")
def _(t):
    tx = t["transactions"]
    return linkage.shared_notes(tx.selectExpr("id", "'txn:' || (n + 1) AS peer_id"), tx.filter("n % 3 = 0").selectExpr("id", "'note ' || n AS note"))


_DUE = "SELECT connector_id AS issuer, account_id, currency, statement_amount, CAST(CASE WHEN billing_period < '2000' THEN 0 ELSE statement_amount END AS DECIMAL(18,2)) AS remaining, CASE WHEN billing_period < '2000' THEN 'paid' ELSE 'unpaid' END AS status, closing_date + 15 AS due_date FROM {bills}"


@query("ag23_issuer_totals", f"""SELECT issuer, CAST(coalesce(sum(statement_amount) FILTER (currency = 'TWD'), 0) AS DOUBLE) AS statement_amount, CAST(coalesce(sum(remaining) FILTER (currency = 'TWD'), 0) AS DOUBLE) AS remaining,
  min(due_date) FILTER (status <> 'paid') AS next_due, arg_min(account_id, (due_date, account_id)) FILTER (status <> 'paid') AS next_account FROM ({_DUE}) GROUP BY 1""")
def _(t):
    return series.issuer_totals(t.spark.sql(_DUE, bills=t["bills"]))


@query("ag18_latest_manual_values", "SELECT account_id AS asset_id, max(as_of_day) AS day, CAST(arg_max(balance, (as_of_day, id)) AS DOUBLE) AS value FROM {snapshots} WHERE NOT derived GROUP BY 1")
def _(t):
    rows = t["snapshots"].filter("not derived").select("id", F.col("account_id").alias("asset_id"), F.col("as_of_day").alias("day"), F.col("balance").cast("double").alias("value"))
    return series.latest_manual_values(rows)
