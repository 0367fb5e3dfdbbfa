"""Queries of bank texts, automatic classification, suggestions, transfers, upserts and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import banks as B
from tallyforge.functions import columns as C
from tallyforge.functions import normalise as N
from tallyforge.operators import ingest, ledger, linkage, merchants, series
from tallyforge.plans.catalog import query
from tallyforge.plans.derived import DAY

_C = F.col


def _sql(t, text, *tables):
    return t.spark.sql(text, **{k: t[k] for k in tables})


_LEGS = "SELECT id, account_id, day, 'TWD' AS currency, CAST(CASE WHEN inflow THEN amount ELSE -amount END AS BIGINT) AS amount FROM {dense_transactions}"


@query("jn20_transfer_matching", f"""WITH l AS ({_LEGS}), a AS (SELECT day, abs(amount) AS size, account_id, count(*) FILTER (amount > 0) AS p, count(*) FILTER (amount < 0) AS m FROM l GROUP BY 1, 2, 3),
  g AS (SELECT day, size, sum(p) AS p, sum(m) AS m, max(p + m) AS most FROM a GROUP BY 1, 2) SELECT day, size, CAST(least(p, m, p + m - most) AS BIGINT) AS pairs FROM g WHERE least(p, m, p + m - most) > 0""")
def _(t):
    found = linkage.transfer_matching(_sql(t, _LEGS, "dense_transactions"))
    return found.groupBy("day", "size").agg(F.count(F.lit(1)).alias("pairs"))


@query("jn18_all_candidates", f"""WITH p AS (SELECT id, amount, day, merchant AS name, id % 97 AS user_id FROM {{dense_transactions}} WHERE NOT inflow AND id % 3 <> 0) SELECT i.id AS invoice_id, p.id AS transaction_id,
  CAST(row_number() OVER (PARTITION BY i.id ORDER BY abs(i.amount - p.amount), abs(p.day - i.day), p.name, p.id) AS INT) AS place FROM {{dense_invoices}} i JOIN p ON p.user_id = i.id % 97 AND p.day BETWEEN i.day - 7 AND i.day + 7""")
def _(t):
    paid = t["dense_transactions"].filter("not inflow").select("id", (-_C("amount")).alias("amount"), "day", _C("merchant").alias("name"), (_C("id") % 97).alias("user_id"))
    taken = t["dense_transactions"].filter("id % 3 = 0").select(_C("id").alias("transaction_id"))
    return linkage.manual_candidates(t["dense_invoices"].withColumn("user_id", _C("id") % 97), paid, taken, owner=("user_id",))


@query("jn18_manual_candidates", """WITH p AS (SELECT id, amount, day, merchant AS name FROM {dense_transactions} WHERE NOT inflow AND id % 3 <> 0), c AS (SELECT i.id AS invoice_id, p.id AS transaction_id, row_number() OVER (PARTITION BY i.id ORDER BY abs(i.amount - p.amount), abs(p.day - i.day), p.name, p.id) AS place
  FROM {dense_invoices} i JOIN p ON p.day BETWEEN i.day - 7 AND i.day + 7) SELECT invoice_id, transaction_id, CAST(place AS INT) AS place FROM c WHERE place <= 3""")
def _(t):
    paid = t["dense_transactions"].filter("not inflow").select("id", (-_C("amount")).alias("amount"), "day", _C("merchant").alias("name"))
    taken = t["dense_transactions"].filter("id % 3 = 0").select(_C("id").alias("transaction_id"))
    return linkage.manual_candidates(t["dense_invoices"], paid, taken, most=3)


_CATS = "SELECT id, CASE n % 6 WHEN 0 THEN 'food' WHEN 1 THEN 'income.salary' WHEN 2 THEN 'user:1' WHEN 3 THEN 'other' WHEN 4 THEN '' END AS category_id FROM {transactions}"


@query("cl6_top_categories", f"SELECT id, CASE WHEN category_id IS NULL OR category_id IN ('', 'other') THEN 'other' WHEN category_id = 'food' THEN 'food' WHEN category_id LIKE 'income%' THEN 'income' ELSE 'misc' END AS top FROM ({_CATS})")
def _(t):
    return _sql(t, _CATS, "transactions").select("id", ledger.top_category(_C("category_id")).alias("top"))


_BANKED = "SELECT id, n, CASE n % 7 WHEN 0 THEN '轉帳 國泰世華銀行' WHEN 1 THEN '臺灣銀行 玉山' WHEN 2 THEN '遠東商銀ATM' WHEN 3 THEN '中國信託銀行 中信' WHEN 4 THEN description WHEN 5 THEN '中信卡' END AS text FROM {transactions}"


@query("cl9_bank_codes", "SELECT id, CASE n % 7 WHEN 0 THEN '013' WHEN 2 THEN '805' WHEN 3 THEN '822' WHEN 5 THEN '822' END AS bank_code FROM {transactions}")
def _(t):
    return merchants.bank_codes(_sql(t, _BANKED, "transactions"), "text").select("id", "bank_code")


_PAYS = "SELECT id, n, account_type = 'credit' AS credit, CASE n % 9 WHEN 0 THEN '信用卡自動扣繳' WHEN 1 THEN '中信 卡' WHEN 2 THEN '繳款入帳' WHEN 3 THEN 'CARD-PAYMENT 12' WHEN 4 THEN 'Payment received' WHEN 5 THEN '繳 卡 款' WHEN 6 THEN '信用卡消費' ELSE description END AS text FROM {transactions}"


@query("fl11_card_payments", "SELECT id, CASE n % 9 WHEN 0 THEN TRUE WHEN 1 THEN account_type <> 'credit' WHEN 2 THEN account_type = 'credit' WHEN 3 THEN TRUE WHEN 4 THEN account_type = 'credit' WHEN 5 THEN TRUE ELSE FALSE END AS card_payment FROM {transactions}")
def _(t):
    return _sql(t, _PAYS, "transactions").select("id", B.is_card_payment(_C("text"), _C("credit")).alias("card_payment"))


_AUTO = "SELECT id, n % 11 = 0 AS offset, n % 7 = 0 AS transfer, CASE n % 5 WHEN 0 THEN 'own_account' WHEN 1 THEN 'unsynced_card' END AS own_kind, 'food' AS category_id, CASE n % 3 WHEN 0 THEN 'user_rule' WHEN 1 THEN 'system_rule' END AS source, FALSE AS excluded, n FROM {transactions}"


@query("cl17_automatic_classification", """SELECT id, CASE WHEN n % 11 = 0 THEN 'misc' WHEN n % 7 = 0 OR n % 3 <> 0 AND n % 5 < 2 THEN 'other' ELSE 'food' END AS category_id,
  CASE WHEN n % 11 = 0 THEN 'auto_offset' WHEN n % 7 = 0 THEN 'auto_transfer' WHEN n % 3 <> 0 AND n % 5 = 1 THEN 'unsynced_card' WHEN n % 3 <> 0 AND n % 5 = 0 THEN 'own_account' WHEN n % 3 = 0 THEN 'user_rule' WHEN n % 3 = 1 THEN 'system_rule' END AS source,
  n % 11 = 0 OR n % 7 = 0 OR n % 3 <> 0 AND n % 5 = 0 AS excluded FROM {transactions}""")
def _(t):
    rows = _sql(t, _AUTO, "transactions")
    return rows.select("id", ledger.automatic_classification({c: _C(c) for c in rows.columns}).alias("r")).select("id", "r.*")


_WORDS = [("urgent", "shopping", "outflow"), ("high", "income.salary", "inflow"), ("low|urgent", "food", "outflow")]
_SUG = "SELECT id, n, CASE WHEN n % 5 = 0 THEN 'health' END AS history, description, CASE WHEN amount > 0 THEN 'inflow' ELSE 'outflow' END AS direction, CASE WHEN n % 3 = 0 THEN 'tech' END AS items, CASE WHEN n % 4 = 0 THEN 'income' WHEN n % 4 = 1 THEN 'food' END AS category_id, CASE WHEN n % 6 = 0 THEN 'override' WHEN n % 6 = 1 THEN 'auto_transfer' END AS source, CASE WHEN n % 13 = 0 THEN 'investment' END AS role, n % 17 = 0 AS duplicate FROM {transactions}"


@query("cl21_suggestions", f"""WITH k AS (SELECT *, CASE WHEN direction = 'outflow' AND regexp_matches(lower(description), 'urgent') THEN 'shopping' WHEN direction = 'inflow' AND regexp_matches(lower(description), 'high') THEN 'income.salary' WHEN direction = 'outflow' AND regexp_matches(lower(description), 'low') THEN 'food' END AS keyword FROM ({_SUG})),
  s AS (SELECT *, coalesce(history, CASE WHEN keyword <> 'shopping' THEN keyword END, CASE WHEN direction = 'outflow' THEN items END, keyword) AS suggested, CASE WHEN history IS NOT NULL THEN 'merchant_history' WHEN keyword <> 'shopping' THEN 'merchant_keywords' WHEN direction = 'outflow' AND items IS NOT NULL THEN 'item_keywords' WHEN keyword IS NOT NULL THEN 'merchant_keywords' END AS by FROM k)
  SELECT id, suggested, "by" AS suggestion_source, CASE WHEN NOT duplicate AND coalesce(role, 'spending') IN ('spending', 'income') AND coalesce(source, '') <> 'auto_transfer' AND suggested IS NOT NULL AND (coalesce(category_id, 'other') = 'other' OR coalesce(source, '') <> 'override' AND suggested = 'income.salary' AND category_id = 'income') THEN suggested ELSE category_id END AS applied FROM s""".replace(" AS by FROM k", ' AS "by" FROM k'))
def _(t):
    rows = _sql(t, _SUG, "transactions").withColumn("keyword", ledger.keyword_category(_C("description"), _WORDS, _C("direction")))
    rows = rows.withColumn("s", ledger.suggestion({c: _C(c) for c in rows.columns}, refined=["shopping"])).withColumns({"suggested": _C("s.category_id"), "suggestion_source": _C("s.source")})
    return rows.select("id", "suggested", "suggestion_source", ledger.applied_suggestion({c: _C(c) for c in rows.columns}).alias("applied"))


_PREF = "SELECT 'txn:' || o_orderkey AS transaction_id, o_orderkey % 2 = 0 AS excluded FROM {orders} WHERE o_orderkey % 3 = 0"


@query("sc1_with_preferences", f"""SELECT t.id, account_id, {DAY} AS day, CASE WHEN p.excluded THEN 'exclude' WHEN NOT p.excluded THEN 'include' END AS preference FROM {{transactions}} t LEFT JOIN ({_PREF}) p ON p.transaction_id = t.id
  WHERE canonical_account_id IS NULL AND (status <> 'pending' OR matched_transaction_id IS NULL) AND {DAY} IN (DATE '1999-02-01', DATE '1999-02-05')""")
def _(t):
    rows = ledger.with_preferences(ledger.with_day(ledger.visible(t["transactions"])), _sql(t, _PREF, "orders"))
    return rows.filter(_C("day").isin("1999-02-01", "1999-02-05")).select("id", "account_id", "day", "preference")


_OLD_I = "SELECT id, invoice_date, CASE WHEN n % 3 = 0 THEN '3J0002' END AS carrier_type, CASE WHEN n % 5 = 0 THEN '1234' END AS carrier_suffix, amount FROM {invoices} WHERE n % 3 <> 1"
_NEW_I = "SELECT id, CASE WHEN n % 24 = 12 THEN CAST(day AS STRING) WHEN n % 2 = 0 THEN CAST(CAST(CASE WHEN n % 12 = 0 THEN day + CAST(1 AS INT) ELSE day END AS DATE) AS STRING) END AS invoice_date, CASE WHEN n % 4 = 0 THEN 'BG0001' END AS carrier_type, CAST(NULL AS STRING) AS carrier_suffix, CAST(amount + 1 AS DECIMAL(18,2)) AS amount FROM {invoices} WHERE n % 3 <> 2"
_TAIPEI = "CASE WHEN {0} LIKE '%Z' THEN CAST(CAST(CAST(replace(replace({0}, 'T', ' '), 'Z', '') AS TIMESTAMP) + INTERVAL 8 HOUR AS DATE) AS VARCHAR) ELSE substr({0}, 1, 10) END"


@query("up_merge_invoices", f"""WITH o AS ({_OLD_I}), n AS ({_NEW_I}) SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.invoice_date IS NULL OR length(o.invoice_date) > 10 AND length(n.invoice_date) = 10 AND {_TAIPEI.format("o.invoice_date")} = n.invoice_date THEN o.invoice_date ELSE n.invoice_date END AS invoice_date,
  coalesce(n.carrier_type, o.carrier_type) AS carrier_type, coalesce(n.carrier_suffix, o.carrier_suffix) AS carrier_suffix, CAST(CASE WHEN n.id IS NULL THEN o.amount ELSE n.amount END AS DOUBLE) AS amount FROM o FULL JOIN n ON o.id = n.id""")
def _(t):
    return ingest.merge_invoices(_sql(t, _OLD_I, "invoices"), _sql(t, _NEW_I, "invoices")).withColumn("amount", _C("amount").cast("double"))


_B = "SELECT account_id || billing_period AS id, CAST(substr(billing_period, 6, 2) AS INT) AS m, statement_amount FROM {bills}"
_OLD_B = f"SELECT id, statement_amount, CASE WHEN m % 2 = 0 THEN 50 END AS paid_amount, CASE m % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_paid FROM ({_B}) WHERE m % 4 <> 1"
_NEW_B = f"SELECT id, CAST(statement_amount * 2 AS DECIMAL(18,2)) AS statement_amount, CASE WHEN m % 5 = 0 THEN 70 END AS paid_amount, CASE m % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_paid FROM ({_B}) WHERE m % 4 <> 2"


@query("up_merge_bills", f"""WITH o AS ({_OLD_B}), n AS ({_NEW_B}) SELECT coalesce(o.id, n.id) AS id, CAST(CASE WHEN n.id IS NULL THEN o.statement_amount ELSE n.statement_amount END AS DOUBLE) AS statement_amount, coalesce(n.paid_amount, o.paid_amount) AS paid_amount,
  CASE WHEN coalesce(o.is_paid, FALSE) OR coalesce(n.is_paid, FALSE) THEN TRUE ELSE coalesce(n.is_paid, o.is_paid) END AS is_paid FROM o FULL JOIN n ON o.id = n.id""")
def _(t):
    return ingest.merge_bills(_sql(t, _OLD_B, "bills"), _sql(t, _NEW_B, "bills")).withColumn("statement_amount", _C("statement_amount").cast("double"))


_STAGED = "SELECT id, n % 700 AS n, o AS ordinal, amount FROM (SELECT id, n, n AS o, CAST(amount AS DOUBLE) AS amount FROM {transactions})"


@query("sk1_staged", f"SELECT n AS record_key, id, amount FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY ordinal DESC) AS r FROM ({_STAGED})) WHERE r = 1")
def _(t):
    stage = ingest.staged(_sql(t, _STAGED, "transactions"), "run1", "bank_transaction", "n", "ordinal")
    return ingest.promoted(stage, "run1", "bank_transaction", "id string, n long, amount double").select(_C("n").alias("record_key"), "id", "amount")


_LAST = "SELECT account_id, arg_max(balance, (as_of_day, n)) AS balance FROM {snapshots} GROUP BY 1"
_RATE = "CASE WHEN a.currency = 'TWD' THEN 1.0 ELSE coalesce(x.rate_to_twd, 0.0) END"
_MANUAL = "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'TWD' END AS currency, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM {orders} WHERE o_orderstatus = 'P'"
_ASSETS = f"""z AS (SELECT CASE WHEN account_type = 'credit' THEN 'card' ELSE 'deposit' END AS kind, institution_name AS institution, currency, l.balance AS amount FROM {{accounts}} c LEFT JOIN ({_LAST}) l ON l.account_id = c.id
  UNION ALL SELECT 'investment', NULL, 'TWD', market_value FROM {{positions}} UNION ALL SELECT 'manual', NULL, currency, amount FROM ({_MANUAL})),
  a AS (SELECT a.*, rate_to_twd, CAST(CAST(coalesce(amount, 0) AS DOUBLE) * {_RATE} AS DECIMAL(24,6)) AS twd FROM z a LEFT JOIN {{rates}} x ON x.currency = a.currency)"""


def _assets(t):
    last = t["snapshots"].groupBy(_C("account_id").alias("id")).agg(F.max_by("balance", F.struct("as_of_day", "n")).alias("balance"))
    accounts = t["accounts"].join(last, "id", "left").select(_C("institution_name").alias("institution"), "account_type", "currency", "balance")
    return series.asset_rows(accounts, t["positions"].select(F.lit("TWD").alias("currency"), _C("market_value").alias("amount")), _sql(t, _MANUAL, "orders"), t["rates"])


@query("ag15_asset_summary", f"""WITH {_ASSETS} SELECT CAST(sum(twd) FILTER (kind = 'deposit') AS DOUBLE) AS bank_total, CAST(sum(twd) FILTER (kind = 'investment') AS DOUBLE) AS investment_total, CAST(sum(twd) FILTER (kind = 'manual') AS DOUBLE) AS manual_total, -CAST(sum(twd) FILTER (kind = 'card') AS DOUBLE) AS card_debt,
  CAST(sum(twd) FILTER (kind <> 'card') AS DOUBLE) AS gross_assets, CAST(sum(twd) AS DOUBLE) AS net_worth, string_agg(DISTINCT CASE WHEN currency <> 'TWD' AND rate_to_twd IS NULL AND coalesce(amount, 0) <> 0 THEN currency END, ',' ORDER BY CASE WHEN currency <> 'TWD' AND rate_to_twd IS NULL AND coalesce(amount, 0) <> 0 THEN currency END) AS missing_currencies FROM a""")
def _(t):
    return series.asset_summary(_assets(t))


@query("ag15_institutions", f"WITH {_ASSETS} SELECT institution, CAST(coalesce(sum(twd) FILTER (kind = 'deposit'), 0) AS DOUBLE) AS asset_total, -CAST(coalesce(sum(twd) FILTER (kind = 'card'), 0) AS DOUBLE) AS debt_total, coalesce(string_agg(DISTINCT CASE WHEN currency <> 'TWD' THEN currency END, ',' ORDER BY CASE WHEN currency <> 'TWD' THEN currency END), '') AS foreign_currencies, bool_or(kind = 'card' AND amount IS NULL) AS unknown_card FROM a WHERE institution IS NOT NULL GROUP BY 1")
def _(t):
    return series.institution_totals(_assets(t))


@query("ag15_currencies", f"WITH {_ASSETS} SELECT currency, CAST(sum(twd) AS DOUBLE) AS total FROM a WHERE kind <> 'card' AND (currency = 'TWD' OR rate_to_twd IS NOT NULL) GROUP BY 1 HAVING sum(twd) > 0")
def _(t):
    return series.currency_totals(_assets(t))


@query("se2_asset_rows", f"WITH {_ASSETS} SELECT kind, count(*) AS n, CAST(sum(twd) AS DOUBLE) AS twd FROM a GROUP BY 1")
def _(t):
    return _assets(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("twd").cast("double").alias("twd"))


@query("ag17_date_bounds", "SELECT min(as_of_day) AS first_day, max(as_of_day) AS last_day, min(as_of_day) FILTER (derived) AS first_derived_day, max(as_of_day) FILTER (derived) AS last_derived_day FROM {snapshots}")
def _(t):
    return series.date_bounds(t["snapshots"])


_MEMO = "SELECT id, n, CASE n % 5 WHEN 0 THEN '(012)00001' || lpad(CAST(n AS STRING), 8, '2') || '；' WHEN 1 THEN '（８２２） 1234-5678' WHEN 2 THEN '(012)00000000' WHEN 3 THEN '王小明' END AS memo, amount FROM {transactions}"


@query("fn_accounts", """SELECT id, CASE n % 5 WHEN 0 THEN '012' WHEN 1 THEN '822' END AS bank_code, CASE n % 5 WHEN 0 THEN right(lpad(CAST(n AS VARCHAR), 8, '2'), 5) WHEN 1 THEN '45678' END AS account_suffix, CASE n % 5 WHEN 0 THEN CASE WHEN amount < 0 THEN '→ ' ELSE '← ' END || '台北富邦 …' || right(lpad(CAST(n AS VARCHAR), 8, '2'), 5)
  WHEN 1 THEN CASE WHEN amount < 0 THEN '→ ' ELSE '← ' END || '中國信託 …45678' END AS label, CASE n % 5 WHEN 0 THEN '(012)…' || right(lpad(CAST(n AS VARCHAR), 8, '2'), 5) || '；' WHEN 1 THEN '（８２２） 1234-5678' WHEN 2 THEN '(012)…00000' WHEN 3 THEN '王小明' END AS masked FROM {transactions}""")
def _(t):
    rows = _sql(t, _MEMO, "transactions").withColumn("a", B.account_in_memo(_C("memo")))
    return rows.select("id", _C("a.bank_code").alias("bank_code"), _C("a.account_suffix").alias("account_suffix"), B.direction_label(_C("amount"), _C("a.bank_code"), _C("a.account_suffix")).alias("label"), B.mask_accounts(_C("memo")).alias("masked"))


# eight digits each: lpad cuts longer numbers off at the end
_IDS = "SELECT id, CASE n % 4 WHEN 0 THEN 'esun' WHEN 1 THEN 'obank' ELSE 'tdcc' END AS connector, CASE n % 4 WHEN 0 THEN 'bank:esun:00-' || lpad(CAST(n AS STRING), 8, '0') WHEN 1 THEN 'bank:obank:x:' || lpad(CAST(n AS STRING), 8, '0') WHEN 2 THEN 'settlement:700:99-' || lpad(CAST(n AS STRING), 8, '0') ELSE 'other:' || n END AS source_id, n FROM {transactions}"


@query("pj10_match_keys", "SELECT id, CASE n % 4 WHEN 0 THEN '808' WHEN 1 THEN '048' WHEN 2 THEN '700' END AS bank_code, CASE WHEN n % 4 <> 3 THEN right(lpad(CAST(n AS VARCHAR), 8, '0'), 4) END AS last4 FROM {transactions}")
def _(t):
    key = B.match_key(_C("connector"), _C("source_id"), {"esun": "808", "obank": "048"}, {"obank": 3})
    return _sql(t, _IDS, "transactions").select("id", key.alias("k")).select("id", "k.*")


@query("fn_counterparties", "SELECT id, CASE n % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'Ｂob' END AS shown, CASE n % 4 WHEN 0 THEN 'Ann Lee' WHEN 3 THEN 'Bob' END AS counterparty, sha256('A1|' || n) AS code_hash FROM {transactions}")
def _(t):
    raw = F.when(_C("n") % 4 == 0, " Ann　 Lee ").when(_C("n") % 4 == 1, F.repeat(F.lit("x"), F.lit(41))).when(_C("n") % 4 == 2, "  ").otherwise("Ｂob")
    rows = t["transactions"].select("id", "n", raw.alias("raw"))
    shown = F.when(_C("n") % 4 == 0, "Ann Lee").when(_C("n") % 4 == 3, "Ｂob")
    return rows.select("id", shown.alias("shown"), B.counterparty(_C("raw")).alias("counterparty"), N.source_hash(F.lit("A1"), _C("n").cast("string")).alias("code_hash"))


_TIMES = "SELECT id, n, CASE n % 5 WHEN 0 THEN '113/02/05 9:07' WHEN 1 THEN '2024-02-05T23:59:58Z' WHEN 2 THEN '20240205 25:10' WHEN 3 THEN '2024.2.5 12:30:01+09:00' ELSE '2024/02/05' END AS said FROM {transactions}"


@query("nm2_parsed_times", "SELECT id, CASE n % 5 WHEN 0 THEN '2024-02-05T09:07:00+08:00' WHEN 1 THEN '2024-02-05T23:59:58Z' WHEN 2 THEN '2024-02-05' WHEN 3 THEN '2024-02-05T12:30:01+09:00' ELSE '2024-02-05' END AS at FROM {transactions}")
def _(t):
    return _sql(t, _TIMES, "transactions").select("id", N.parsed_time(_C("said")).alias("at"))


@query("pj16_signed_amounts", "SELECT id, -abs(CAST(amount AS DOUBLE)) AS invoice, CAST(amount AS DOUBLE) AS bank, FALSE AS trade_counts FROM {transactions}")
def _(t):
    d = lambda s: C.signed_amount(F.lit(s), _C("amount")).cast("double").alias(s)
    return t["transactions"].select("id", d("invoice"), d("bank"), C.is_counted(F.lit("investment")).alias("trade_counts"))
