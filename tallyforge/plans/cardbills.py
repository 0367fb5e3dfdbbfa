"""Queries of cards, merges of duplicate rows, running balances, day search and merchant texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.functions.search import Search
from tallyforge.operators import cards, items, ledger, linkage, merchants, series
from tallyforge.plans.catalog import query
from tallyforge.plans.derived import DAY

_C = F.col


def _sql(t, text, *tables):
    return t.spark.sql(text, **{k: t[k] for k in tables})


_PAYS = "SELECT id, account_id, account_type, amount, CASE WHEN n % 3 <> 0 THEN 'card_payment' ELSE 'spending' END AS role, n % 17 = 0 AS duplicate, CASE n % 4 WHEN 0 THEN '013' WHEN 1 THEN '808' END AS bank_code FROM {transactions}"
_OWN = "SELECT connector_id AS issuer, id AS account_id FROM {accounts} WHERE account_type = 'credit'"
_CODES = "SELECT * FROM (VALUES ('conn0', '013'), ('conn1', '808'), ('conn2', NULL)) AS v(issuer, bank_code)"


@query("jn26_payment_sides", f"""WITH p AS (SELECT * FROM ({_PAYS}) WHERE role = 'card_payment' AND NOT duplicate), o AS ({_OWN}) SELECT p.id, o.issuer, 'card' AS side FROM p JOIN o USING (account_id) WHERE amount > 0
  UNION ALL SELECT p.id, c.issuer, 'bank' FROM p JOIN ({_CODES}) c ON c.bank_code = p.bank_code WHERE account_type <> 'credit' AND amount < 0 AND account_id NOT IN (SELECT account_id FROM o)""")
def _(t):
    return cards.payment_sides(_sql(t, _PAYS, "transactions"), _sql(t, _OWN, "accounts"), t.spark.sql(_CODES))


_LINES = f"SELECT account_id, CASE WHEN n % 5 = 0 THEN '0000' END AS last4, CASE WHEN status = 'posted' THEN CAST(posted_date AS DATE) ELSE {{day}} END AS day, status, amount, t.currency, rate_to_twd FROM {{transactions}} t LEFT JOIN {{rates}} r ON r.currency = t.currency WHERE account_type = 'credit'"
_VAL = "CAST(CASE WHEN currency = 'TWD' OR amount = 0 THEN -CAST(amount AS DOUBLE) WHEN rate_to_twd > 0 THEN -CAST(amount AS DOUBLE) * rate_to_twd END AS DECIMAL(24,6))"
_CENTS = "floor(CAST(coalesce(sum(v) FILTER ({0}), 0) AS DOUBLE) * 100 + 0.5) / 100.0"
_OPEN, _BILLED = "day >= DATE '2001-05-01'", "day BETWEEN DATE '2001-03-01' AND DATE '2001-04-30'"


@query("ag21_card_sums", f"""WITH l AS ({_LINES.replace("{day}", DAY)}), v AS (SELECT *, {_VAL} AS v, coalesce(last4, '') AS card FROM l),
  s AS (SELECT account_id, card AS last4, {_CENTS.format(_OPEN)} AS unbilled, {_CENTS.format(_OPEN + " AND status = 'pending'")} AS pending, count(v) FILTER ({_OPEN}) AS unbilled_count, {_CENTS.format(_BILLED)} AS statement_amount, count(v) FILTER ({_BILLED}) AS statement_count,
    coalesce(string_agg(DISTINCT CASE WHEN v IS NULL THEN currency END, ','), '') AS missing_currencies FROM v WHERE {_OPEN} OR {_BILLED} GROUP BY 1, 2),
  c AS (SELECT id AS account_id, '' AS last4 FROM {{accounts}} WHERE account_type = 'credit')
  SELECT account_id, last4, coalesce(unbilled, 0) AS unbilled, coalesce(pending, 0) AS pending, coalesce(unbilled_count, 0) AS unbilled_count, coalesce(statement_amount, 0) AS statement_amount, coalesce(statement_count, 0) AS statement_count, coalesce(missing_currencies, '') AS missing_currencies FROM c FULL JOIN s USING (account_id, last4)""")
def _(t):
    tx = t["transactions"].filter("account_type = 'credit'").join(t["rates"], "currency", "left")
    day = C.billing_day(_C("status"), _C("authorized_at"), _C("posted_date"))
    lines = tx.select("account_id", F.when(_C("n") % 5 == 0, "0000").alias("last4"), day.alias("day"), "status", "amount", "currency", "rate_to_twd")
    known = t["accounts"].filter("account_type = 'credit'").select(_C("id").alias("account_id"), F.lit(None).cast("string").alias("last4"))
    return cards.card_sums(lines, known, "2001-05-01", ("2001-03-01", "2001-04-30"))


_RAWS = """SELECT id, connector_id AS issuer, CASE WHEN CAST(substr(id, 6) AS INT) % 3 = 0 THEN account_last4 END AS account_last4, CASE CAST(substr(id, 6) AS INT) % 4 WHEN 0 THEN '{{"cards":[{{"last4":"' || account_last4 || '"}},{{"last4":"12"}}]}}' WHEN 1 THEN '{{"cardLast4s":["' || account_last4 || '","' || account_last4 || '"]}}' END AS raw_payload FROM {accounts}"""


@query("pj19_listed_cards", f"""WITH a AS ({_RAWS}), o AS (SELECT issuer, id AS account_id, account_last4 AS last4 FROM a WHERE account_last4 IS NOT NULL), m AS (SELECT issuer, substr(raw_payload, CASE WHEN raw_payload LIKE '%cards%' THEN 21 ELSE 17 END, 4) AS last4 FROM a WHERE raw_payload IS NOT NULL)
  SELECT 'own' AS kind, count(*) AS n FROM (SELECT DISTINCT account_id, last4 FROM o) UNION ALL SELECT 'listed', count(*) FROM (SELECT DISTINCT issuer, last4 FROM m WHERE (issuer, last4) NOT IN (SELECT (issuer, last4) FROM o))""")
def _(t):
    rows = _sql(t, _RAWS, "accounts")
    found = cards.listed_cards(rows).join(rows.select(_C("id").alias("account_id"), "account_last4"), "account_id")
    own = F.count_if(_C("last4") == _C("account_last4"))
    # both kinds have a row, with zero cards too
    return found.agg(own.alias("own"), (F.count(F.lit(1)) - own).alias("listed")).selectExpr("stack(2, 'own', own, 'listed', listed) AS (kind, n)")


_DEPS = "SELECT 'dep:' || o_orderkey AS deposit_id, CASE WHEN o_orderkey % 2 = 0 THEN 'opened' ELSE 'withdrawn' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'TWD' WHEN 1 THEN 'USD' ELSE 'JPY' END AS currency, CAST(100 * (o_orderkey % 900) AS DECIMAL(18,2)) AS balance, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS opened, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderdate AS DATE) END AS last_seen FROM {orders}"
_ACCS = "SELECT * FROM (VALUES ('s1', 'savings', 'TWD'), ('s2', 'savings', 'USD'), ('s3', 'savings', 'JPY'), ('s4', 'savings', 'JPY'), ('c1', 'checking', 'EUR')) AS v(id, account_type, currency)"
_TXS = "SELECT 't' || o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 's1' WHEN 1 THEN 's2' ELSE 's3' END AS account_id, CASE o_orderkey % 3 WHEN 0 THEN 'TWD' WHEN 1 THEN 'USD' ELSE 'JPY' END AS currency, CASE WHEN o_orderkey % 13 = 0 THEN 'pending' ELSE 'posted' END AS status, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * 100 * (o_orderkey % 900) AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INT) AS day FROM {orders}"


@query("jn38_deposit_events", f"""WITH d AS (SELECT *, CASE WHEN kind = 'opened' THEN -balance ELSE balance END AS amount FROM ({_DEPS}) WHERE balance > 0 AND currency IN ('TWD', 'USD')), t AS (SELECT * FROM ({_TXS}) WHERE status = 'posted' AND day <= DATE '2001-01-01'),
  f AS (SELECT d.deposit_id, kind, t.id AS transaction_id, day, d.amount FROM d JOIN t ON t.account_id = CASE d.currency WHEN 'TWD' THEN 's1' ELSE 's2' END AND t.amount = d.amount AND CASE WHEN kind = 'opened' THEN day = opened ELSE day > last_seen END)
  SELECT deposit_id, kind, transaction_id, day, CAST(-amount AS DOUBLE) AS amount FROM (SELECT *, count(*) OVER (PARTITION BY deposit_id) AS x, count(*) OVER (PARTITION BY transaction_id) AS y FROM f) WHERE x = 1 AND y = 1""")
def _(t):
    return cards.deposit_events(_sql(t, _DEPS, "orders"), t.spark.sql(_ACCS), _sql(t, _TXS, "orders"), "2001-01-01").withColumn("amount", _C("amount").cast("double"))


_CANDS = "SELECT n AS old_id, n + 1000000 + CASE WHEN n % 10 = 0 THEN 7 ELSE 0 END AS new_id FROM {transactions} UNION ALL SELECT n, n + 2000000 FROM {transactions} WHERE n % 11 = 0"
_SETS = "SELECT n AS id, 'role' AS kind, CASE WHEN n % 2 = 0 THEN 'x' END AS value FROM {transactions} WHERE n % 3 = 0 UNION ALL SELECT n + 1000000, 'role', 'x' FROM {transactions} WHERE n % 3 = 0 AND n % 4 <> 1 UNION ALL SELECT n, 'invoice', 'i' || n FROM {transactions} WHERE n % 7 = 0 UNION ALL SELECT n + 1000000, 'invoice', 'i' || n FROM {transactions} WHERE n % 21 = 0 UNION ALL SELECT n, 'note', 'old' || n FROM {transactions} WHERE n % 5 = 0 UNION ALL SELECT n + 1000000, 'note', CASE WHEN n % 2 = 0 THEN 'old' || n ELSE 'new' END FROM {transactions} WHERE n % 15 = 0"
_MAP = f"""c AS (SELECT DISTINCT old_id, new_id FROM ({_CANDS}) WHERE old_id <> new_id), p AS (SELECT old_id, new_id FROM (SELECT *, count(*) OVER (PARTITION BY old_id) AS o, count(*) OVER (PARTITION BY new_id) AS k FROM c) WHERE o = 1 AND k = 1), s AS ({_SETS}),
  m AS (SELECT * FROM p WHERE old_id NOT IN (SELECT p.old_id FROM p JOIN s a ON a.id = p.old_id JOIN s b ON b.id = p.new_id AND b.kind = a.kind WHERE a.kind = 'invoice' OR a.kind <> 'note' AND a.value IS DISTINCT FROM b.value))"""


@query("jn33_merge_mapping", f"WITH {_MAP} SELECT old_id, new_id FROM m")
def _(t):
    settings = _sql(t, _SETS, "transactions")
    return linkage.merge_mapping(_sql(t, _CANDS, "transactions"), settings.filter("kind <> 'note'"))


@query("jn33_moved_settings", f"""WITH {_MAP}, a AS (SELECT coalesce(new_id, id) AS id, kind, value, old_id IS NOT NULL AS moved FROM s LEFT JOIN m ON m.old_id = s.id), b AS (SELECT id, kind, min(value) FILTER (NOT moved) AS own, min(value) FILTER (moved) AS came FROM a GROUP BY 1, 2)
  SELECT id, kind, CASE WHEN kind = 'note' AND own <> came THEN own || chr(10) || came ELSE coalesce(own, came) END AS value FROM b""")
def _(t):
    settings = _sql(t, _SETS, "transactions")
    mapping = linkage.merge_mapping(_sql(t, _CANDS, "transactions"), settings.filter("kind <> 'note'"))
    return linkage.moved_settings(settings, mapping)


_ROWS = "SELECT n AS id, n - 1 AS peer_id FROM {transactions} UNION ALL SELECT n + 1000000, n + 1 FROM {transactions}"


@query("jn33_moved_rows", f"WITH {_MAP}, r AS ({_ROWS}) SELECT id, coalesce(m.new_id, peer_id) AS peer_id FROM r LEFT JOIN m ON m.old_id = r.peer_id WHERE id NOT IN (SELECT old_id FROM m)")
def _(t):
    mapping = linkage.merge_mapping(_sql(t, _CANDS, "transactions"), _sql(t, _SETS, "transactions").filter("kind <> 'note'"))
    return linkage.moved_rows(_sql(t, _ROWS, "transactions"), mapping, ["peer_id"])


_ENDS = "SELECT account_id, CAST(date_trunc('month', CAST(posted_date AS DATE)) AS DATE) AS day, CAST(sum(amount) AS DECIMAL(18,2)) AS net, CAST(sum(amount) * 2 AS DECIMAL(18,2)) AS balance FROM {transactions} WHERE posted_date >= '2001-01-01' GROUP BY 1, 2"


@query("wn6_filled_balances", f"""WITH d AS ({_ENDS}), f AS (SELECT account_id, min(day) AS first_day FROM d GROUP BY 1), s AS (SELECT account_id, CAST(range AS DATE) AS day FROM f, range(first_day - 1, DATE '2001-09-01', INTERVAL 1 DAY))
  SELECT s.account_id, s.day, CAST(coalesce(x.balance, o.opening) AS DOUBLE) AS balance FROM s ASOF LEFT JOIN d x ON x.account_id = s.account_id AND x.day <= s.day LEFT JOIN (SELECT account_id, arg_min(balance - net, day) AS opening FROM d GROUP BY 1) o ON o.account_id = s.account_id""")
def _(t):
    return series.filled_balances(_sql(t, _ENDS, "transactions"), "2001-08-31").withColumn("balance", _C("balance").cast("double"))


_NOTES = "SELECT 'invoice' AS kind, 'inv:' || o_orderkey AS id, 'see ' || o_orderstatus || lpad(CAST(o_orderkey % 97 AS STRING), 4, '0') AS note FROM {orders} WHERE o_orderkey % 100 = 2 UNION ALL SELECT 'bank_transaction', 'txn:' || o_orderkey, 'told P' || lpad(CAST(o_orderkey % 89 AS STRING), 4, '0') FROM {orders} WHERE o_orderkey % 50 = 7"
_LABELS = "SELECT DISTINCT o_orderpriority AS label FROM {orders}"


def _days_sql(text: str, amount: str = "TRUE", either: bool = False, needle: str = "", account: str = "", ban: str = "", bounds: str = "TRUE") -> str:
    both = lambda hit: f"(({hit}) OR ({amount}))" if either else f"(({hit}) AND ({amount}))"
    pin = lambda names: f"contains(lower(replace({names}, ' ', '')), '{needle}')" if needle else "FALSE"
    bank = f"contains(lower(coalesce(x.description, '') || ' ' || coalesce(x.counterparty, '') || ' ' || coalesce(a.institution_name, '') || ' ' || coalesce(a.id, '') || ' ' || coalesce(x.account_last4, '') || ' 銀行 信用卡'), '{text}') OR x.account_id = '{account}' OR EXISTS (SELECT 1 FROM c WHERE contains(lower(label), '{text}')) OR {pin("coalesce(x.description, '') || coalesce(x.counterparty, '')")} OR x.id IN (SELECT id FROM n WHERE kind = 'bank_transaction' AND contains(lower(note), '{text}'))"
    bill = f"contains(lower(coalesce(seller_name, '') || ' ' || coalesce(invoice_number, '') || ' 電子發票'), '{text}') OR seller_ban = '{ban}' OR {pin("coalesce(seller_name, '')")} OR id IN (SELECT invoice_id FROM {{invoice_items}} WHERE contains(lower(description), '{text}')) OR id IN (SELECT id FROM n WHERE kind = 'invoice' AND contains(lower(note), '{text}'))"
    trade = f"contains(lower(coalesce(name, '') || ' ' || coalesce(symbol, '') || ' ' || coalesce(transaction_name, '') || ' ' || coalesce(CAST(price AS VARCHAR), '') || ' 投資'), '{text}')"
    if not text:
        bank = bill = trade = "TRUE"
    return f"""WITH n AS ({_NOTES}), c AS ({_LABELS}), iv AS (SELECT *, lpad(CAST(n % 1000 AS STRING), 8, '0') AS seller_ban FROM {{invoices}}),
  f AS (SELECT {DAY} AS day FROM {{transactions}} x JOIN {{accounts}} a ON a.id = x.account_id WHERE x.canonical_account_id IS NULL AND (status <> 'pending' OR matched_transaction_id IS NULL) AND {both(bank)}
  UNION ALL SELECT day FROM iv WHERE {both(bill)} UNION ALL SELECT CAST(posted_date AS DATE) FROM {{trades}} WHERE {both(trade)}) SELECT DISTINCT day FROM f WHERE day IS NOT NULL AND {bounds} ORDER BY day DESC LIMIT 33"""


def _days(t, line: str, **more):
    banks = t["accounts"].select(_C("id").alias("account_id"), "institution_name", _C("id").alias("account_name"))
    trades = t["trades"].select("id", _C("posted_date").cast("date").alias("day"), "amount", "name", "symbol", "transaction_name", _C("price").cast("string").alias("transaction_code"))
    invoices = t["invoices"].withColumn("seller_ban", F.lpad((_C("n") % 1000).cast("string"), 8, "0"))
    return items.search_days(ledger.with_day(t["transactions"]).join(banks, "account_id"), invoices, t["invoice_items"], trades, _sql(t, _NOTES, "orders"), _sql(t, _LABELS, "orders"), Search.of(line), **more)


@query("fl5_search_days", _days_sql("0077", "abs(amount) = 77", True))
def _(t):
    return _days(t, "0077")


@query("fl5_search_words_and_amounts", _days_sql("supplier#000000003", "abs(amount) >= 1000 AND abs(amount) < 90000 AND abs(amount) <= 80000 AND abs(amount) >= 500", bounds="day >= DATE '1999-01-01' AND day <= DATE '2000-03-01' AND day < DATE '2000-02-01'"))
def _(t):
    return _days(t, "Supplier#000000003 >= 1,000 ＜90000 500~80000", since="1999-01-01", until="2000-03-01", before="2000-02-01")


@query("fl5_search_amount_only", _days_sql("", "abs(amount) > 150000 AND abs(amount) < 151000", bounds="day <= DATE '2001-01-01'"))
def _(t):
    return _days(t, ">NT$150000 < 151000", before="2001-01-01", inclusive=True)


@query("fl5_search_by_label", _days_sql("medium", bounds="day < DATE '1998-01-01'"))
def _(t):
    return _days(t, "MEDIUM", before="1998-01-01")


@query("fl5_search_by_alias", _days_sql("zzz", needle="r#000000007", account="acct:19", ban="00000042"))
def _(t):
    return _days(t, "zzz", needles=("r#000000007",), accounts=("acct:19",), bans=("00000042",))


_NAMES = """SELECT id, n, CASE n % 6 WHEN 0 THEN '已田商行股份有限公司承德路門市' WHEN 1 THEN '連支＊老王牛肉麵' WHEN 2 THEN 'UBER   *EATS help.uber.com' WHEN 3 THEN '信用卡消費' WHEN 4 THEN 'Cafe Nero Taipei' ELSE '全家便利商店 P000000001234' END AS counterparty,
  CASE WHEN n % 2 = 0 THEN '轉帳' ELSE '街口支付＊小吃店' END AS description FROM {transactions}"""


@query("fn_clean_names", "SELECT id, CASE n % 6 WHEN 0 THEN '已田商行' WHEN 1 THEN '老王牛肉麵' WHEN 2 THEN 'UBER *EATS' WHEN 3 THEN '信用卡消費' WHEN 4 THEN 'Cafe Nero' ELSE '全家便利商店' END AS clean_name, CASE WHEN n % 6 = 1 THEN 'line_pay' END AS payment_method, CASE n % 6 WHEN 0 THEN '已田商行' WHEN 1 THEN '老王牛肉麵' WHEN 2 THEN 'ubereats' WHEN 3 THEN '信用卡消費' WHEN 4 THEN 'cafenero' ELSE '全家便利商店' END AS name_key FROM {transactions}")
def _(t):
    return merchants.cleaned(_sql(t, _NAMES, "transactions"), "counterparty").select("id", "clean_name", "payment_method", "name_key")


@query("fn_bank_merchants", """SELECT id, CASE n % 6 WHEN 0 THEN 'name:已田商行' WHEN 1 THEN 'name:老王牛肉麵' WHEN 2 THEN 'name:ubereats' WHEN 3 THEN 'name:小吃店' WHEN 4 THEN 'name:cafenero' ELSE 'name:小吃店' END AS merchant_key,
  CASE n % 6 WHEN 1 THEN 'line_pay' WHEN 3 THEN 'jko_pay' WHEN 5 THEN 'jko_pay' END AS payment_method FROM {transactions}""")
def _(t):
    return merchants.bank_merchants(_sql(t, _NAMES, "transactions")).select("id", "merchant_key", "payment_method")


@query("fn_invoice_merchants", "SELECT id, CASE WHEN n % 3 = 0 THEN 'ban:12345678' WHEN n % 6 = 1 THEN 'name:老王牛肉麵' WHEN n % 6 = 2 THEN 'name:ubereats' WHEN n % 6 = 4 THEN 'name:cafenero' ELSE 'name:全家便利商店' END AS merchant_key FROM {transactions}")
def _(t):
    rows = _sql(t, _NAMES, "transactions").withColumn("ban", F.when(_C("n") % 3 == 0, " １２３４５６７８ ").otherwise("123"))
    return merchants.invoice_merchants(rows, "counterparty", "ban").select("id", "merchant_key")


_ITEMS = "SELECT invoice_id, line_number, CASE line_number % 4 WHEN 1 THEN '4710088412345 鮮奶茶(大) x2' WHEN 2 THEN '衛生紙 3 包' WHEN 3 THEN '折扣' ELSE '【促銷】衛生紙' END AS description, CASE WHEN line_number = 6 THEN -1 ELSE amount END AS amount FROM {invoice_items}"


@query("fn_item_previews", "WITH f AS (SELECT invoice_id, CASE WHEN line_number % 4 = 1 THEN '鮮奶茶(大)' ELSE '衛生紙' END AS name, min(line_number) AS line FROM {invoice_items} WHERE line_number % 4 <> 3 AND line_number <> 6 GROUP BY 1, 2) SELECT invoice_id, string_agg(name, ',' ORDER BY line) AS preview FROM f GROUP BY 1")
def _(t):
    return merchants.item_previews(_sql(t, _ITEMS, "invoice_items")).select("invoice_id", F.array_join("preview", ",").alias("preview"))
