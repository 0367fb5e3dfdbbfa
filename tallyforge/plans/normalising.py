"""Queries of the operators that normalise source fields before staging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import normalise as N
from tallyforge.operators import ingest
from tallyforge.plans.catalog import query
from tallyforge.sources.tables import TODAY

_C = F.col
_MONTH = "substr(posted_date, 6, 2)"


@query("nm3_statement_days", f"SELECT id, CAST((CAST(substr(posted_date, 1, 4) AS INT) - CASE WHEN {_MONTH} > '06' THEN 1 ELSE 0 END) || substr(posted_date, 5, 6) AS DATE) AS day FROM {{transactions}} WHERE {_MONTH} <> '02'")
def _(t):
    rows = t["transactions"].filter(f"{_MONTH} <> '02'").selectExpr("id", f"{_MONTH} || '/' || substr(posted_date, 9, 2) AS text", "CAST(substr(posted_date, 1, 4) AS INT) AS year")
    return rows.select("id", N.statement_day(_C("text"), _C("year"), F.lit(6)).alias("day"))


@query("nm4_billing_periods", "SELECT id, CASE WHEN n % 4 <> 3 AND posted_date >= '2000' THEN substr(posted_date, 1, 7) END AS period FROM {transactions}")
def _(t):
    year = "CAST(substr(posted_date, 1, 4) AS INT)"
    text = f"CASE n % 4 WHEN 0 THEN lpad(CAST({year} - 1911 AS STRING), 3, '0') || '/' || {_MONTH} WHEN 1 THEN substr(posted_date, 1, 4) || {_MONTH} WHEN 2 THEN substr(posted_date, 1, 7) ELSE posted_date END"
    return t["transactions"].selectExpr("id", f"{text} AS text").select("id", N.billing_period(_C("text")).alias("period"))


@query("nm6_currency_codes", "SELECT id, CASE n % 7 WHEN 0 THEN 'TWD' WHEN 1 THEN 'USD' WHEN 2 THEN 'JPY' WHEN 3 THEN 'EUR' WHEN 4 THEN 'TWD' WHEN 5 THEN NULL ELSE 'TWD' END AS currency FROM {transactions}")
def _(t):
    text = "CASE n % 7 WHEN 0 THEN 'NTD' WHEN 1 THEN ' 840' WHEN 2 THEN '392' WHEN 3 THEN 'eur ' WHEN 4 THEN '000' WHEN 5 THEN 'x1' END"
    return t["transactions"].selectExpr("id", f"{text} AS text").select("id", N.currency_code(_C("text")).alias("currency"))


@query("nm7_card_amounts", "SELECT id, CAST(CASE WHEN n % 7 = 0 OR amount < 0 THEN abs(amount) ELSE -abs(amount) END AS DOUBLE) AS amount FROM {transactions}")
def _(t):
    rows = t["transactions"].selectExpr("id", "amount", "CASE WHEN n % 14 = 0 THEN '刷卡退款' WHEN n % 7 = 0 THEN 'Refund' ELSE description END AS text")
    return rows.select("id", N.card_amount(_C("amount"), _C("text")).cast("double").alias("amount"))


_FEED = "SELECT *, row_number() OVER (PARTITION BY account_id, description ORDER BY n) AS occurrence FROM {{transactions}} WHERE {test}"


@query("nm10_feed_merge", f"""WITH a AS ({_FEED.format(test="n % 3 <> 0")}), b AS ({_FEED.format(test="n % 2 = 0")})
  SELECT coalesce(a.account_id, b.account_id) AS account_id, coalesce(a.description, b.description) AS description, CAST(coalesce(a.occurrence, b.occurrence) AS INT) AS occurrence, coalesce(a.id, b.id) AS id
  FROM a FULL JOIN b ON a.account_id = b.account_id AND a.description = b.description AND a.occurrence = b.occurrence""")
def _(t):
    rows = t["transactions"].select("account_id", "description", "n", "id")
    return ingest.merge_feeds([rows.filter("n % 3 <> 0"), rows.filter("n % 2 = 0")], ["account_id", "description"], "n").select("account_id", "description", "occurrence", "id")


_TRADES = "SELECT l_orderkey, l_linenumber, lpad(CAST(l_partkey % 300 AS STRING), 4, '0') AS symbol, CASE WHEN l_suppkey % 3 = 0 THEN '12' ELSE '01' END AS type_code, CAST(l_quantity AS DECIMAL(12,2)) AS quantity, CASE WHEN l_linenumber = 2 THEN CAST(1 AS DECIMAL(12,2)) ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS price FROM {lineitem}"


@query("nm14_trades", f"SELECT l_orderkey, l_linenumber, CASE WHEN symbol LIKE '00%' THEN 'etf' WHEN type_code = '12' THEN 'fund' ELSE 'stock' END AS asset_type, CASE WHEN price <> 1 THEN CAST(floor(quantity * price) AS BIGINT) END AS amount FROM ({_TRADES})")
def _(t):
    rows = t.spark.sql(_TRADES, lineitem=t["lineitem"])
    return rows.select("l_orderkey", "l_linenumber", N.trade_asset_type(_C("symbol"), _C("type_code")).alias("asset_type"), N.trade_amount(_C("quantity"), _C("price")).alias("amount"))


@query("nm15_holdings", """SELECT id, 'A' AS symbol, CAST(n % 50 * 2.5 AS DOUBLE) AS market_value FROM {transactions}
  UNION ALL SELECT id, 'B', CAST(n % 9 * 10.25 AS DOUBLE) FROM {transactions}""")
def _(t):
    payload = """'[{"symbol":"A","quantity":"' || n % 50 || '","price":"2.5"},{"symbol":"B","quantity":"' || n % 9 || '","price":"10.25"}]'"""
    rows = t["transactions"].selectExpr("id", f"{payload} AS payload")
    return ingest.holdings(rows, "id", "payload").select("id", "symbol", "market_value")


@query("nm16_trend_series", """WITH o AS (SELECT id, unnest([1, 2]) AS k, n FROM {transactions}), v AS (SELECT id, k - 1 AS position, n % 100 * k AS total, n % 10 * k AS fund FROM o)
  SELECT id, position, series, CAST(CASE series WHEN 'total' THEN total WHEN 'fund' THEN fund ELSE total - fund END AS DOUBLE) AS value FROM v, (VALUES ('total'), ('fund'), ('stock')) AS s(series)""")
def _(t):
    rows = t["transactions"].selectExpr("id", "array(n % 100, n % 100 * 2) AS total", "array(n % 10, n % 10 * 2) AS fund")
    return ingest.trend_series(rows, "id", "total", "fund")


@query("nm18_absent_accounts", f"SELECT id AS account_id, 0.0E0 AS balance, TRUE AS inactive, DATE '{TODAY}' AS as_of_day FROM {{accounts}} WHERE account_type = 'time_deposit' AND CAST(substr(id, 6) AS BIGINT) % 13 = 0")
def _(t):
    known = t["accounts"].filter("account_type = 'time_deposit'").select("id")
    return ingest.absent_accounts(known, t["accounts"].filter("cast(substr(id, 6) AS BIGINT) % 13 <> 0").select("id"), TODAY)


@query("nm19_carriers", "SELECT id, CASE n % 3 WHEN 0 THEN 'BG0001' END AS carrier_type, CASE WHEN n % 4 <> 1 THEN account_last4 END AS carrier_suffix FROM {transactions}")
def _(t):
    rows = t["transactions"].selectExpr("id", "CASE n % 3 WHEN 0 THEN ' bg0001 ' WHEN 1 THEN 'a carrier type too long to keep' ELSE '  ' END AS kind", "CASE n % 4 WHEN 0 THEN '12 3' || account_last4 WHEN 1 THEN ' ' WHEN 2 THEN account_last4 ELSE substr(account_last4, 1, 2) || ' ' || substr(account_last4, 3) END AS number")
    return rows.select("id", N.carrier_type(_C("kind")).alias("carrier_type"), N.carrier_suffix(_C("number")).alias("carrier_suffix"))


@query("nm20_first_text", "SELECT id, CASE WHEN n % 3 = 0 THEN description WHEN n % 3 = 1 THEN counterparty END AS value FROM {transactions}")
def _(t):
    rows = t["transactions"].selectExpr("id", "CASE WHEN n % 3 = 0 THEN ' ' || description ELSE '  ' END AS a", "CASE WHEN n % 3 = 1 THEN counterparty END AS b")
    return rows.select("id", N.first_text(_C("a"), _C("b"), F.lit("")).alias("value"))


@query("nm21_invoice_periods", f"""WITH p AS (SELECT DISTINCT year(day) AS y, (month(day) - 1) // 2 AS k FROM {{invoices}})
  SELECT CAST(y * 6 + k AS INT) AS period, y || '/' || lpad(CAST(k * 2 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(k * 2 + 2 AS STRING), 2, '0') AS label, make_date(y, k * 2 + 1, 1) AS first_day,
  least(last_day(make_date(y, k * 2 + 2, 1)), DATE '{TODAY}') AS last_day FROM p""")
def _(t):
    rows = t["invoices"].select(N.invoice_period_index(_C("day")).alias("period")).distinct().withColumn("p", N.invoice_period(_C("period"), F.lit(TODAY).cast("date")))
    return rows.select("period", "p.label", _C("p.start").alias("first_day"), _C("p.end").alias("last_day"))


@query("nm22_latest_statements", "SELECT account_id, currency, billing_period, CAST(statement_amount AS DOUBLE) AS statement_amount FROM (SELECT *, dense_rank() OVER (PARTITION BY currency ORDER BY billing_period DESC) AS r FROM {bills}) WHERE r <= 3")
def _(t):
    return ingest.latest_groups(t["bills"], ["currency"], "billing_period", 3).select("account_id", "currency", "billing_period", _C("statement_amount").cast("double").alias("statement_amount"))


@query("nm23_name_containment", "SELECT id, CASE n % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE ELSE FALSE END AS same FROM {transactions}")
def _(t):
    rows = t["transactions"].selectExpr("id", "counterparty", "CASE n % 4 WHEN 0 THEN upper(counterparty) || ' taipei branch' WHEN 1 THEN replace(counterparty, '#', ' - ') WHEN 2 THEN 'sup' ELSE '##' END AS other")
    return rows.select("id", N.names_contain(_C("counterparty"), _C("other")).alias("same"))


@query("pj8_card_last4", "SELECT id, CASE WHEN account_type = 'credit' AND CAST(substr(id, 6) AS BIGINT) % 3 <> 2 THEN account_last4 END AS card_last4 FROM {accounts}")
def _(t):
    payload = """CASE CAST(substr(id, 6) AS BIGINT) % 3 WHEN 0 THEN '{"cardLast4":"' || account_last4 || '","cardNo":"9999"}' WHEN 1 THEN '{"cardLast4":"x","cardNo":"4000-12 ' || account_last4 || '"}' ELSE 'not json' END"""
    return t["accounts"].selectExpr("id", "account_type", f"{payload} AS payload").select("id", N.card_last4(_C("account_type"), _C("payload")).alias("card_last4"))


@query("pj11_stable_ids", "SELECT id, connector_id || ':' || account_id || ':' || n AS stable_id FROM {transactions}")
def _(t):
    return t["transactions"].select("id", N.stable_id(_C("connector_id"), _C("account_id"), _C("n")).alias("stable_id"))


@query("cl10_investment_events", "SELECT id, CASE n % 5 WHEN 0 THEN 'dividend' WHEN 1 THEN 'sell' WHEN 2 THEN 'buy' WHEN 3 THEN 'dividend' END AS kind FROM {transactions}")
def _(t):
    text = "CASE n % 5 WHEN 0 THEN '現金股利 買進' WHEN 1 THEN 'SELL then buy' WHEN 2 THEN '定期定額' WHEN 3 THEN 'Dividend' ELSE description END"
    return t["transactions"].selectExpr("id", f"{text} AS text").select("id", N.investment_event(_C("text")).alias("kind"))


@query("cl13_match_statuses", f"""SELECT id, CASE id % 10 WHEN 2 THEN 'matched_card' WHEN 4 THEN 'matched_bank' WHEN 6 THEN 'ambiguous' WHEN 8 THEN 'awaiting_card' ELSE 'unmatched' END AS status, id % 10 = 8 AND DATE '{TODAY}' - day > 10 AS overdue FROM {{dense_invoices}}""")
def _(t):
    rows = t["dense_invoices"].selectExpr("id", "day", "CASE id % 10 WHEN 2 THEN 'matched' WHEN 4 THEN 'linked' WHEN 6 THEN CASE WHEN id % 20 = 6 THEN 'repeat' ELSE 'ambiguous' END ELSE 'unmatched' END AS outcome", "CASE WHEN id % 10 = 2 THEN 'credit' WHEN id % 10 = 4 THEN 'checking' END AS account_type", "CASE WHEN id % 10 = 8 THEN '1234' END AS carrier")
    return rows.select("id", N.match_status(_C("outcome"), _C("account_type"), _C("carrier"), _C("day"), F.lit(TODAY).cast("date")).alias("m")).select("id", "m.status", "m.overdue")


@query("cl19_merged_categories", """WITH r AS (SELECT id, CASE n % 5 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN -1 ELSE 0 END AS mine, CASE n % 3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 0 END AS theirs, n FROM {transactions})
  SELECT id, CASE WHEN n % 5 = 3 OR n % 11 = 0 THEN 'own' WHEN theirs > mine OR theirs = mine AND mine <> 6 THEN 'invoice' ELSE 'own' END AS category_id FROM r""")
def _(t):
    rows = t["transactions"].selectExpr("id", "CASE n % 5 WHEN 0 THEN 'override' WHEN 1 THEN 'user_rule' WHEN 2 THEN 'system_rule' WHEN 3 THEN 'own_account' END AS mine", "CASE n % 3 WHEN 0 THEN 'override' WHEN 1 THEN 'invoice' ELSE 'fallback' END AS theirs", "CASE WHEN n % 11 <> 0 THEN 'invoice' END AS category")
    return rows.select("id", N.merged_category(F.lit("own"), _C("mine"), _C("category"), _C("theirs")).alias("category_id"))
