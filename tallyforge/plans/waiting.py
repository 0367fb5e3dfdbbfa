"""Queries of the inbox, views, reports and daily deposits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import inbox, items, linkage, series
from tallyforge.plans.catalog import query
from tallyforge.plans.unified import _ITEMS, _items
from tallyforge.sources.durable import fresh_path
from tallyforge.streaming import lifecycle
from tallyforge.streaming import waiting as stream

_C = F.col


def _sql(t, text, *tables):
    return t.spark.sql(text, **{k: t[k] for k in tables})


_JOBS = "SELECT * FROM (VALUES ('conn0', 'failed', DATE '2001-07-10', DATE '2001-07-01'), ('conn1', 'needs_user_action', DATE '2001-07-12', NULL), ('conn2', 'success', DATE '2001-07-14', DATE '2001-07-14'), ('conn3', 'success', DATE '2001-07-01', DATE '2001-07-01')) AS v(connector_id, status, last_run, last_success)"
_BILLS = "SELECT account_id AS issuer, billing_period, CASE WHEN CAST(substr(account_id, 6) AS INT) % 3 = 0 THEN 'paid' WHEN CAST(substr(account_id, 6) AS INT) % 3 = 1 THEN 'unpaid' ELSE 'partial' END AS status, closing_date + CAST(20 AS INT) AS due_date, closing_date, statement_amount AS remaining, currency FROM {bills} WHERE billing_period >= '2001-05'"


@query("cl26_inbox", f"""{_ITEMS}, b AS ({_BILLS}), x AS (SELECT * FROM items WHERE month IN ('2001-06', '2001-07') AND role <> 'excluded'), ia AS (SELECT id FROM ir WHERE reason = 'invoice_ambiguous'),
  u AS (SELECT count(*) AS n, max(day) AS last, floor(CAST(sum(abs(coalesce(twd, 0))) AS DOUBLE) * 100 + 0.5) / 100.0 AS s FROM x WHERE source IN ('bank', 'card') AND coalesce(category_id, 'other') = 'other' AND role = 'spending' AND duplicate_of IS NULL)
  SELECT CASE WHEN status = 'failed' THEN 'connector_error' ELSE 'connector_needs_user_action' END || ':' || connector_id AS id, CASE WHEN status = 'failed' THEN 'connector_error' ELSE 'connector_needs_user_action' END AS kind, CAST(last_run AS VARCHAR) AS created_at, NULL::DOUBLE AS amount, NULL AS currency, 'blocking' AS severity FROM ({_JOBS}) WHERE status <> 'success'
  UNION ALL SELECT 'import_stale:' || connector_id, 'import_stale', CAST(coalesce(last_success, DATE '2001-07-15') AS VARCHAR), NULL, NULL, 'blocking' FROM ({_JOBS}) WHERE connector_id IN ('conn1', 'conn2', 'conn3') AND (last_success IS NULL OR DATE '2001-07-15' - last_success > 7)
  UNION ALL SELECT 'card_due_unpaid:' || issuer || ':' || billing_period, 'card_due_unpaid', CAST(closing_date AS VARCHAR), CAST(remaining AS DOUBLE), currency, 'blocking' FROM b WHERE status <> 'paid' AND due_date - DATE '2001-07-15' BETWEEN -31 AND 7
  UNION ALL SELECT CASE WHEN id IN (SELECT id FROM ia) THEN 'duplicate_ambiguous' ELSE 'needs_review' END || ':' || source || ':' || id, CASE WHEN id IN (SELECT id FROM ia) THEN 'duplicate_ambiguous' ELSE 'needs_review' END, date, CAST(abs(coalesce(twd, amount)) AS DOUBLE), CASE WHEN twd IS NOT NULL THEN 'TWD' ELSE currency END, 'tidy' FROM x WHERE review = 'needs_review'
  UNION ALL SELECT 'uncategorized:' || n, 'uncategorized', CAST(last AS VARCHAR), s, 'TWD', 'tidy' FROM u WHERE n > 0""")
def _(t):
    return inbox.inbox(t.spark.sql(_JOBS), _sql(t, _BILLS, "bills"), _items(t), "2001-07-15", ["conn1", "conn2", "conn3"], ["2001-06", "2001-07"])


_CHANGES = "SELECT 'b' || n % 40 AS batch_id, CASE WHEN n % 3 = 0 THEN 'posted' ELSE 'added' END AS change, CASE WHEN n % 2 = 0 THEN id ELSE 'inv:' || (n + 1) END AS id FROM {transactions}"


@query("cl28_report_details", f"{_ITEMS}, c AS ({_CHANGES}) SELECT batch_id, CASE WHEN change = 'added' AND source = 'invoice' AND duplicate_of IS NOT NULL THEN 'invoice_linked' ELSE change END AS change, id, title, CAST(amount AS DOUBLE) AS amount FROM c JOIN items USING (id)")
def _(t):
    return inbox.report_details(_sql(t, _CHANGES, "transactions"), _items(t))


_AFTER = "SELECT 'b' || o_orderkey AS batch_id, CAST(o_totalprice AS DECIMAL(18,2)) AS assets, CAST(o_orderkey % 1000 AS DECIMAL(18,2)) AS debt FROM {orders}"


@query("sm8_batch_changes", f"WITH a AS ({_AFTER}) SELECT batch_id, CASE WHEN CAST(substr(batch_id, 2) AS INT) % 9 <> 0 THEN CAST(assets - 10 AS DOUBLE) END AS assets_change, CASE WHEN CAST(substr(batch_id, 2) AS INT) % 9 <> 0 THEN 5.0 END AS debt_change, CAST(substr(batch_id, 2) AS INT) % 9 = 0 AS baseline FROM a")
def _(t):
    after = _sql(t, _AFTER, "orders")
    before = after.filter("cast(substr(batch_id, 2) as int) % 9 <> 0").select("batch_id", F.lit(10).cast("decimal(18,2)").alias("assets"), (_C("debt") - 5).alias("debt"))
    return inbox.batch_snapshots(before, after)


@query("fl10_views", f"{_ITEMS} SELECT 'ledger' AS view, count(*) AS n FROM items WHERE duplicate_of IS NULL UNION ALL SELECT 'invoice', count(*) FROM items WHERE source = 'invoice' UNION ALL SELECT 'income', count(*) FROM items WHERE duplicate_of IS NULL AND role = 'income' UNION ALL SELECT 'review', count(*) FROM items WHERE duplicate_of IS NULL AND review = 'needs_review' UNION ALL SELECT 'slice', count(*) FROM items WHERE duplicate_of IS NULL AND category_id = 'food' AND role = 'spending' UNION ALL SELECT 'card', count(*) FROM items WHERE source = 'card' AND last4 = '0048' UNION ALL SELECT 'invoices kept', count(*) FROM items WHERE source = 'invoice' AND role = 'excluded'")
def _(t):
    rows = _items(t)
    made = {"ledger": items.viewed(rows), "invoice": items.viewed(rows, "invoice"), "income": items.viewed(rows, role="income"), "review": items.viewed(rows, review=True), "slice": items.viewed(rows, slice_=("food", "spending")), "card": items.viewed(rows, "card", card="0048"), "invoices kept": items.viewed(rows, "invoice", role="excluded")}
    out = None
    for name, df in made.items():
        one = df.agg(F.lit(name).alias("view"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("st6_search_page", f"{_ITEMS} SELECT id, day FROM items WHERE contains(lower(title), 'supplier#000000002') AND (day < DATE '2000-01-05' OR day = DATE '2000-01-05' AND id > 'inv:5') ORDER BY day DESC, id LIMIT 30")
def _(t):
    return items.search_page(_items(t), "Supplier#000000002", ("2000-01-05", "inv:5")).select("id", "day")


_CAR = "SELECT id, CASE WHEN n % 3 = 0 THEN 'EK0002' END AS carrier_type, CASE WHEN n % 6 = 0 THEN '1234' END AS carrier_suffix FROM {invoices}"


@query("pj18_source_records", f"{_ITEMS} SELECT items.id, carrier_type, carrier_suffix, coalesce(source = 'invoice' AND carrier_suffix IS NOT NULL AND duplicate_of IS NULL AND DATE '2001-07-15' - day > 10, FALSE) AS overdue FROM items LEFT JOIN ({_CAR}) c ON c.id = items.invoice_id WHERE source IN ('invoice', 'card')")
def _(t):
    return items.source_records(_items(t), _sql(t, _CAR, "invoices"), "2001-07-15").filter("source in ('invoice', 'card')").select("id", "carrier_type", "carrier_suffix", "overdue")


_LEGS = "SELECT id, account_id, day, 'TWD' AS currency, CAST(CASE WHEN inflow THEN amount ELSE -amount END AS BIGINT) AS amount FROM {dense_transactions}"


@query("jn23_transfer_counterparts", f"WITH l AS ({_LEGS}), p AS (SELECT * FROM l WHERE id % 50 = 1) SELECT id, account_id, day, currency, amount FROM l WHERE id % 50 <> 1 AND EXISTS (SELECT 1 FROM p WHERE p.day = l.day AND p.amount = -l.amount AND p.account_id <> l.account_id)")
def _(t):
    rows = _sql(t, _LEGS, "dense_transactions")
    return linkage.transfer_counterparts(rows.filter("id % 50 = 1"), rows).select("id", "account_id", "day", "currency", "amount")


@query("ag16_deposits_by_day", """WITH l AS (SELECT account_id, as_of_day AS day, arg_max(balance, n) AS balance FROM {snapshots} GROUP BY 1, 2), c AS (SELECT account_id, day, balance - coalesce(lag(balance) OVER (PARTITION BY account_id ORDER BY day), 0) AS change FROM l),
  r AS (SELECT a.id, CAST(CASE WHEN a.currency = 'TWD' THEN 1.0 ELSE coalesce(x.rate_to_twd, 0.0) END AS DECIMAL(10,4)) AS rate FROM {accounts} a LEFT JOIN {rates} x ON x.currency = a.currency WHERE account_type <> 'credit'), d AS (SELECT day, sum(CAST(change * rate AS DECIMAL(24,4))) AS change FROM c JOIN r ON r.id = c.account_id GROUP BY 1)
  SELECT day, CAST(sum(change) OVER (ORDER BY day) AS DOUBLE) AS total FROM d""")
def _(t):
    return series.deposits_by_day(t["snapshots"], t["accounts"], t["rates"])


_PAID = "SELECT 'payment' AS kind, id, account_id AS owner, currency, CAST(abs(amount) AS DECIMAL(18,2)) AS amount, CAST(posted_date AS DATE) AS day FROM {transactions} UNION ALL SELECT 'invoice', i.id, t.account_id, t.currency, i.amount, i.day FROM {invoices} i JOIN {transactions} t ON t.n = i.n"


@query("sm4_waiting_invoices", f"""WITH r AS ({_PAID}), u AS (SELECT max(day) - 15 AS until FROM r), c AS (SELECT i.id AS invoice_id, p.id AS transaction_id, p.day - i.day AS gap, i.day, row_number() OVER (PARTITION BY i.id ORDER BY abs(p.day - i.day), p.day, p.id) AS place
  FROM r i LEFT JOIN r p ON p.kind = 'payment' AND p.owner = i.owner AND p.currency = i.currency AND p.amount = i.amount AND p.day BETWEEN i.day - 7 AND i.day + 7 WHERE i.kind = 'invoice')
  SELECT invoice_id, transaction_id, CASE WHEN transaction_id IS NULL THEN 'overdue' ELSE 'matched' END AS outcome, CAST(gap AS INT) AS gap FROM c, u WHERE place = 1 AND CASE WHEN transaction_id IS NULL THEN c.day + 10 <= until ELSE c.day + 7 <= until END""")
def _(t):
    feed, out, check = (fresh_path(t.spark, x) for x in ("feed", "waits", "state"))
    rows = t.spark.sql(_PAID, transactions=t["transactions"], invoices=t["invoices"])
    rows.write.parquet(feed)
    stream.drained(stream.waits(t.spark.readStream.schema(rows.schema).parquet(feed)), out, check)
    return t.spark.read.schema(stream.OUT).parquet(out)


@query("sm4_waiting_in_batch", f"""WITH r AS ({_PAID}), c AS (SELECT i.id AS invoice_id, p.id AS transaction_id, p.day - i.day AS gap, i.day, row_number() OVER (PARTITION BY i.id ORDER BY abs(p.day - i.day), p.day, p.id) AS place
  FROM r i LEFT JOIN r p ON p.kind = 'payment' AND p.owner = i.owner AND p.currency = i.currency AND p.amount = i.amount AND p.day BETWEEN i.day - 7 AND i.day + 7 WHERE i.kind = 'invoice')
  SELECT invoice_id, transaction_id, CASE WHEN transaction_id IS NULL THEN 'overdue' ELSE 'matched' END AS outcome, CAST(gap AS INT) AS gap FROM c WHERE place = 1 AND CASE WHEN transaction_id IS NULL THEN day + 10 ELSE day + 7 END <= DATE '2000-06-30'""")
def _(t):
    return stream.waits_of_all(t.spark.sql(_PAID, transactions=t["transactions"], invoices=t["invoices"]), "2000-06-30")


_ARRIVES = "SELECT id, CASE WHEN n % 3 = 0 THEN 'posted' ELSE 'pending' END AS status, amount, description, CAST(NULL AS STRING) AS transfer_peer_id, authorized_at, n AS ordinal FROM {transactions}"


@query("sm2_lifecycle_ledger", "SELECT id, CASE WHEN n % 3 = 0 OR n % 4 = 0 THEN 'posted' ELSE 'pending' END AS status, CASE WHEN n % 4 = 0 THEN 'settled' ELSE description END AS description FROM {transactions}")
def _(t):
    folder = fresh_path(t.spark, "lifecycle")
    first = t.spark.sql(_ARRIVES, transactions=t["transactions"])
    lifecycle.promote(first, 0, folder)
    second = first.filter("ordinal % 4 = 0").withColumns({"status": F.lit("posted"), "description": F.lit("settled")})
    lifecycle.promote(second, 1, folder)
    return lifecycle.latest(t.spark, folder).select("id", "status", "description")


@query("sm2_lifecycle_changes", "SELECT id, 'posted' AS kind FROM {transactions} WHERE n % 4 = 0 AND n % 3 <> 0")
def _(t):
    folder = fresh_path(t.spark, "lifecycle")
    first = t.spark.sql(_ARRIVES, transactions=t["transactions"])
    lifecycle.promote(first, 0, folder)
    lifecycle.promote(first.filter("ordinal % 4 = 0").withColumn("status", F.lit("posted")), 1, folder)
    return t.spark.read.schema("id string, kind string").parquet(f"{folder}/changes/1")
