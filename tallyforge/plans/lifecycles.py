"""Queries of pairing passes, lifecycle marks, repeated invoices, rules by keyword, trends, reports and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import keywords as K
from tallyforge.operators import inbox, invoices, ledger, linkage
from tallyforge.plans.catalog import query
from tallyforge.plans.derived import ACT, DAY, activity

_C = F.col


def _sql(t, text, *tables):
    return t.spark.sql(text, **{k: t[k] for k in tables})


_AUTHS = "SELECT id, CASE WHEN id % 3 <> 0 THEN 'h' || (id // 2) % 4000 END AS code, id % 5 <> 0 AS normal, 'c' || id % 13 AS card, day, 'TWD' AS currency, amount FROM {dense_transactions} WHERE "
_L, _R = _AUTHS.replace("//", "DIV") + "inflow", _AUTHS.replace("//", "DIV") + "NOT inflow"
_PAIRED = f"""l AS ({_AUTHS + "inflow"}), r AS ({_AUTHS + "NOT inflow"}), f AS MATERIALIZED (SELECT l.id AS left_id, r.id AS right_id, coalesce(l.code = r.code, FALSE) AND abs(l.day - r.day) <= 31 AS coded,
    NOT coalesce(l.code IS NOT NULL AND r.code IS NOT NULL AND l.normal AND r.normal, FALSE) AND NOT coalesce(l.code = r.code, FALSE) AND l.card = r.card AND abs(l.day - r.day) <= 3 AS carded FROM l JOIN r USING (currency, amount)),
  a AS MATERIALIZED (SELECT left_id, right_id FROM (SELECT *, count(*) OVER (PARTITION BY left_id) AS x, count(*) OVER (PARTITION BY right_id) AS y FROM f WHERE coded) WHERE x = 1 AND y = 1),
  b AS (SELECT * FROM f WHERE (coded OR carded) AND left_id NOT IN (SELECT left_id FROM a) AND right_id NOT IN (SELECT right_id FROM a))"""


@query("jn30_two_pass_pairs", f"WITH {_PAIRED} SELECT * FROM a UNION ALL SELECT left_id, right_id FROM (SELECT *, count(*) OVER (PARTITION BY left_id) AS x, count(*) OVER (PARTITION BY right_id) AS y FROM b) WHERE x = 1 AND y = 1")
def _(t):
    return linkage.two_pass_pairs(_sql(t, _L, "dense_transactions"), _sql(t, _R, "dense_transactions"))


_MARKED = "SELECT id, n, CASE WHEN n % 3 = 0 THEN 'esun' ELSE 'other' END AS connector_id, 'card' || n % 500 || CASE n % 4 WHEN 0 THEN ':已入帳:' WHEN 1 THEN ':未入帳:' ELSE ':' END || n % 7 AS source_id FROM {transactions}"


@query("jn39_lifecycle_marks", f"""WITH m AS ({_MARKED}), r AS (SELECT *, row_number() OVER (PARTITION BY regexp_replace(source_id, ':(已入帳|未入帳):', ':') ORDER BY CASE WHEN contains(source_id, '已') THEN 1 WHEN contains(source_id, '未') THEN 2 ELSE 0 END, n) AS k FROM m WHERE connector_id = 'esun')
  SELECT id FROM m WHERE connector_id <> 'esun' UNION ALL SELECT id FROM r WHERE k = 1""")
def _(t):
    return ledger.lifecycle_dedupe(_sql(t, _MARKED, "transactions"), "esun", r":(已入帳|未入帳):(?=\d+$)").select("id")


_AGAIN = "SELECT id, 'Seller ' || id % 3 AS seller_key, CASE WHEN id % 7 <> 0 THEN 'tea' END AS items_key, CASE WHEN id % 5 = 0 THEN 'TWD' ELSE 'USD' END AS currency, amount, CAST(day AS TIMESTAMP) + INTERVAL 1 HOUR * CAST(id % 20 AS INT) AS ts FROM {dense_invoices}"


@query("jn16_invoice_repeats", f"""WITH RECURSIVE i AS (SELECT id, currency, seller_key, items_key, CAST(floor(CAST(amount AS DOUBLE) * 100 + 0.5) AS BIGINT) AS cents, CAST(epoch(ts) AS BIGINT) AS sec FROM ({_AGAIN}) WHERE currency <> 'TWD' AND amount > 0 AND items_key IS NOT NULL),
  g AS (SELECT currency, seller_key, cents, min(sec) AS anchor FROM i GROUP BY 1, 2, 3 UNION ALL SELECT currency, seller_key, cents, (SELECT min(i.sec) FROM i WHERE i.currency = g.currency AND i.seller_key = g.seller_key AND i.cents = g.cents AND i.sec > g.anchor + 86400) FROM g WHERE anchor IS NOT NULL),
  m AS (SELECT i.id, i.sec, i.currency, i.seller_key, i.cents, max(g.anchor) AS anchor FROM i JOIN g ON g.currency = i.currency AND g.seller_key = i.seller_key AND g.cents = i.cents AND g.anchor <= i.sec GROUP BY ALL),
  r AS (SELECT id, row_number() OVER w AS rank, count(*) OVER (PARTITION BY currency, seller_key, cents, anchor) AS n, first(id) OVER w AS head FROM m WINDOW w AS (PARTITION BY currency, seller_key, cents, anchor ORDER BY sec, id))
  SELECT id AS invoice_id, head AS anchor, CAST(rank AS INT) AS rank FROM r WHERE n > 1""")
def _(t):
    return invoices.repeat_groups(_sql(t, _AGAIN, "dense_invoices"))


_SAID = "SELECT id, n, CASE n % 9 WHEN 0 THEN 'UBER EATS' WHEN 1 THEN 'Uber trip' WHEN 2 THEN '7-ELEVEN' WHEN 3 THEN '家扶基金會捐款' WHEN 4 THEN '薪資' WHEN 5 THEN '街口支付儲值' WHEN 6 THEN '證券交割' WHEN 7 THEN 'ATM跨行轉帳' ELSE 'nothing' END AS description, CAST(NULL AS STRING) AS counterparty, amount, CASE WHEN amount > 0 THEN 'inflow' ELSE 'outflow' END AS direction FROM {transactions}"


@query("cl5_system_rules", """SELECT id, CASE n % 9 WHEN 0 THEN 'system:shared:dining-keywords' WHEN 1 THEN 'system:shared:ride-keywords' WHEN 2 THEN 'system:shared:convenience-keywords' WHEN 4 THEN CASE WHEN amount > 0 THEN 'system:bank:salary-keywords' END WHEN 5 THEN 'system:bank:ewallet-topup' WHEN 6 THEN 'system:bank:investment-keywords' WHEN 7 THEN 'system:bank:transfer-keywords' END AS rule_id,
  CASE n % 9 WHEN 0 THEN 'food' WHEN 1 THEN 'transport' WHEN 2 THEN 'food' WHEN 4 THEN CASE WHEN amount > 0 THEN 'income.salary' ELSE 'other' END ELSE 'other' END AS category_id, CASE n % 9 WHEN 5 THEN 'own_transfer' WHEN 6 THEN 'investment' END AS rule_role FROM {transactions}""")
def _(t):
    return ledger.classify(_sql(t, _SAID, "transactions"), K.system_rules("bank_transaction")).select("id", "rule_id", "category_id", "rule_role")


@query("cl22_merchant_words", "SELECT id, CASE WHEN amount > 0 THEN CASE n % 9 WHEN 4 THEN 'income.salary' END ELSE CASE n % 9 WHEN 0 THEN 'food' WHEN 1 THEN 'transport' WHEN 2 THEN 'food' WHEN 3 THEN 'donation' END END AS category_id FROM {transactions}")
def _(t):
    return _sql(t, _SAID, "transactions").select("id", ledger.keyword_category(_C("description"), K.merchant_words(), _C("direction")).alias("category_id"))


_GOODS = "SELECT invoice_id, line_number, CASE line_number WHEN 1 THEN '鮮奶茶' WHEN 2 THEN '衛生紙' WHEN 3 THEN 'USB 充電線' WHEN 4 THEN '牛肉麵' WHEN 5 THEN '停車費' ELSE 'x' END AS name, amount FROM {invoice_items}"


@query("cl23_item_words", """WITH w AS (SELECT invoice_id, CASE line_number WHEN 1 THEN 'food' WHEN 2 THEN 'shopping' WHEN 3 THEN 'tech' WHEN 4 THEN 'food' WHEN 5 THEN 'transport' END AS category_id, line_number, amount FROM {invoice_items}),
  b AS (SELECT invoice_id, category_id, sum(amount) AS w, min(line_number) AS first FROM w GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY invoice_id) AS total, row_number() OVER (PARTITION BY invoice_id, category_id IS NULL ORDER BY w DESC, first) AS k FROM b)
  SELECT invoice_id, category_id FROM r WHERE category_id IS NOT NULL AND k = 1 AND CAST(w AS DOUBLE) / CAST(total AS DOUBLE) >= 0.4""")
def _(t):
    rows = _sql(t, _GOODS, "invoice_items")
    words = [(p, c, "outflow") for p, c in K.ITEM_WORDS]
    return ledger.item_category(rows.withColumn("category_id", ledger.keyword_category(_C("name"), words, F.lit("outflow"))))


_OVER = "SELECT CASE WHEN n % 2 = 0 THEN 'bank_transaction' ELSE 'invoice' END AS target_type, CASE WHEN n % 2 = 0 THEN id ELSE 'inv:' || (n - 1) END AS target_id, CASE n % 5 WHEN 0 THEN 'other' WHEN 1 THEN 'food' ELSE 'fun' END AS category_id FROM {transactions} WHERE n % 3 = 0"


@query("jn8_override_history", f"""WITH o AS (SELECT * FROM ({_OVER}) WHERE category_id <> 'other') SELECT target_type, target_id, category_id, description, counterparty, i.seller_name FROM o JOIN {{transactions}} t ON t.id = o.target_id LEFT JOIN {{invoice_links}} l ON l.transaction_id = t.id LEFT JOIN {{invoices}} i ON i.id = l.invoice_id WHERE target_type = 'bank_transaction'
  UNION ALL SELECT target_type, target_id, category_id, NULL, NULL, i.seller_name FROM o JOIN {{invoices}} i ON i.id = o.target_id WHERE target_type = 'invoice'""")
def _(t):
    return ledger.override_history(_sql(t, _OVER, "transactions"), t["transactions"], t["invoices"], t["invoice_links"])


@query("jn6_open_links", """SELECT l.invoice_id, CASE WHEN l.transaction_id IS NULL THEN 'separate' ELSE 'linked' END AS decision, i.seller_name, l.transaction_id, t.id IS NOT NULL AS visible FROM {invoice_links} l LEFT JOIN {invoices} i ON i.id = l.invoice_id
  LEFT JOIN (SELECT id FROM {transactions} WHERE canonical_account_id IS NULL AND (status <> 'pending' OR matched_transaction_id IS NULL)) t ON t.id = l.transaction_id""")
def _(t):
    decided = t["invoice_links"].select("invoice_id", "transaction_id", F.when(_C("transaction_id").isNull(), "separate").otherwise("linked").alias("decision"))
    return ledger.open_links(decided, t["invoices"], t["transactions"])


@query("sc12_earliest_advance", f"SELECT min(day) AS day FROM (SELECT {DAY} AS day FROM {{transactions}} WHERE advance_counterparty IS NOT NULL UNION ALL SELECT i.day FROM {{invoices}} i JOIN {{orders}} ON 'inv:' || o_orderkey = i.id WHERE o_orderkey % 86 = 0)")
def _(t):
    marked = t["orders"].filter("o_orderkey % 86 = 0").select(F.concat(F.lit("inv:"), "o_orderkey").alias("id"))
    days = ledger.with_day(t["transactions"].filter("advance_counterparty is not null")).select("day")
    return days.unionByName(t["invoices"].join(marked, "id", "left_semi").select("day")).agg(F.min("day").alias("day"))


@query("ag13_summary", """SELECT (SELECT count(*) FROM {invoices}) AS invoices, (SELECT CAST(sum(market_value) AS DOUBLE) FROM (SELECT *, max(as_of_date) OVER (PARTITION BY connector_id, asset_type) AS top FROM {positions}) WHERE as_of_date = top) AS positions,
  (SELECT count(*) FROM {accounts}) AS accounts, (SELECT CAST(sum(balance) AS DOUBLE) FROM (SELECT arg_max(balance, (as_of_day, n)) AS balance FROM {snapshots} GROUP BY account_id)) AS balances""")
def _(t):
    top = t["positions"].groupBy("connector_id", "asset_type").agg(F.max("as_of_date").alias("as_of_date"))
    held = t["positions"].join(top, ["connector_id", "asset_type", "as_of_date"]).agg(F.sum("market_value").cast("double").alias("positions"))
    last = t["snapshots"].groupBy("account_id").agg(F.max_by("balance", F.struct("as_of_day", "n")).alias("balance")).agg(F.sum("balance").cast("double").alias("balances"))
    one = lambda name: t[name].agg(F.count(F.lit(1)).alias(name))
    return one("invoices").join(held, F.lit(True)).join(one("accounts"), F.lit(True)).join(last, F.lit(True))  # one row each


_RESULTS = "SELECT 'b' || o_orderkey % 300 AS batch_id, 'conn' || o_orderkey % 7 AS connector_id, CASE o_orderkey % 37 WHEN 0 THEN 'failed' WHEN 1 THEN 'needs_user_action' WHEN 2 THEN 'partial' ELSE 'success' END AS status, o_orderkey % 4 AS new_records FROM {orders}"


@query("ag27_report_rollup", f"""WITH r AS ({_RESULTS}) SELECT batch_id, CASE max(CASE status WHEN 'failed' THEN 3 WHEN 'needs_user_action' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) WHEN 3 THEN 'failed' WHEN 2 THEN 'needs_user_action' WHEN 1 THEN 'partial' ELSE 'success' END AS status, count(*) AS connectors, count(*) FILTER (status = 'failed') AS failed, CAST(sum(new_records) AS BIGINT) AS new_records FROM r GROUP BY 1""")
def _(t):
    return ledger.report_rollup(_sql(t, _RESULTS, "orders"))


_AFTER = "SELECT batch_id, CAST(sum(new_records) * 100 AS DECIMAL(18,2)) AS assets, CAST(count(*) AS DECIMAL(18,2)) AS debt FROM r GROUP BY 1"


@query("ag27_rollup_with_change", f"""WITH r AS ({_RESULTS}), a AS ({_AFTER}), g AS (SELECT batch_id, max(CASE status WHEN 'failed' THEN 3 WHEN 'needs_user_action' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS worst, min(CASE status WHEN 'failed' THEN 3 WHEN 'needs_user_action' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END) AS best, count(*) AS connectors,
    count(*) FILTER (status = 'failed') AS failed, CAST(sum(new_records) AS BIGINT) AS new_records FROM r GROUP BY 1)
  SELECT g.batch_id, CASE worst WHEN 3 THEN 'failed' WHEN 2 THEN 'needs_user_action' WHEN 1 THEN 'partial' ELSE 'success' END AS status, connectors, failed, new_records, CASE WHEN best < 2 AND assets > 7000 THEN CAST(assets - 10 AS DOUBLE) END AS assets_change, CASE WHEN best < 2 AND assets > 7000 THEN CAST(debt - 3 AS DOUBLE) END AS debt_change, best < 2 AND assets <= 7000 AS baseline
  FROM g JOIN a ON a.batch_id = g.batch_id""")
def _(t):
    rows = _sql(t, _RESULTS, "orders")
    after = t.spark.sql(_AFTER.replace("FROM r", "FROM {r}"), r=rows)
    before = after.filter("assets > 7000").select("batch_id", F.lit(10).cast("decimal(18,2)").alias("assets"), F.lit(3).cast("decimal(18,2)").alias("debt"))
    return ledger.report_rollup(rows, inbox.batch_snapshots(before, after))


@query("ag31_trend_flags", f"""{ACT}, v AS (SELECT strftime(CAST(range AS DATE), '%Y-%m') AS month FROM range(DATE '1994-11-01', DATE '1995-07-01', INTERVAL 1 MONTH)),
  m AS (SELECT month, floor(CAST(coalesce(sum(CASE WHEN role = 'spending' AND twd IS NOT NULL THEN -twd END), 0) AS DOUBLE) * 100 + 0.5) / 100.0 AS spending, count(*) FILTER (twd IS NOT NULL AND role NOT IN ('excluded', 'advance', 'reimbursement')) AS n FROM act GROUP BY 1)
  SELECT v.month, coalesce(spending, 0) AS spending, coalesce(n, 0) = 0 AS no_data, v.month NOT BETWEEN '1994-12' AND '1995-04' AS outside FROM v LEFT JOIN m USING (month)""")
def _(t):
    # the first transactions are of January 1995
    return ledger.month_trend(ledger.month_summary(activity(t)), ["1994-11", "1994-12", *(f"1995-0{k}" for k in range(1, 7))], ("1994-12", "1995-04"))


for _name, _table, _keys, _after in (("invoices", "invoices", ("invoice_date", "id"), ("1999-06-30", "inv:5")), ("trades", "trades", ("posted_date", "id"), ("1998-06-30", "trade:5")), ("positions", "positions", ("as_of_date", "connector_id", "symbol"), None), ("bills", "bills", ("billing_period", "account_id"), ("1999-06", "acct:5"))):
    _w = f"WHERE ({', '.join(_keys)}) < ({', '.join(map(repr, _after))})" if _after else ""

    @query(f"st4_{_name}_page", f"SELECT {', '.join(_keys)} FROM {{{_table}}} {_w} ORDER BY {', '.join(f'{k} DESC' for k in _keys)} LIMIT 40")
    def _(t, table=_table, keys=_keys, after=_after):
        return ledger.page_after(t[table].select(*keys), list(keys), after, 40)


@query("cl7_all_signals", "SELECT id, CASE WHEN n % 11 = 0 THEN 'own_transfer' WHEN n % 7 = 0 THEN 'spending' WHEN n % 5 = 0 THEN 'own_transfer' WHEN n % 3 = 0 THEN 'card_payment' ELSE CASE WHEN amount > 0 AND account_type <> 'credit' THEN 'income' ELSE 'spending' END END AS role, CASE WHEN n % 11 = 0 THEN 'calculation_preference' WHEN n % 7 = 0 THEN 'unsynced_card' WHEN n % 5 = 0 THEN 'auto_transfer' WHEN n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 'card_payment' ELSE 'possible_unsynced_card' END ELSE 'sign' END AS source, CASE WHEN n % 11 = 0 THEN 'confirmed' WHEN n % 7 <> 0 AND n % 5 <> 0 AND n % 3 = 0 AND n % 2 <> 0 OR n % 7 <> 0 AND n % 5 <> 0 AND n % 3 <> 0 AND n % 13 = 0 THEN 'needs_review' ELSE 'auto' END AS review FROM {transactions}")
def _(t):
    n, none = _C("n"), F.lit(None).cast("string")
    signals = {
        "preference": F.when(n % 11 == 0, "exclude"), "own_account_kind": F.when(n % 7 == 0, "unsynced_card"), "merchant_role": none, "auto_transfer": n % 5 == 0, "card_payment": (n % 3 == 0) & (n % 11 != 0), "synced_card": n % 2 == 0,
        "top_up": F.lit(False), "rule_role": none, "income_category": F.lit(False), "excluded": F.lit(False), "amount": _C("amount"), "credit": _C("account_type") == "credit", "transfer_hint": n % 13 == 0,
    }
    return t["transactions"].select("id", ledger.economic_role(signals).alias("r")).select("id", "r.*")


@query("se4_missing_rows", "SELECT id FROM {accounts} WHERE id NOT IN (SELECT account_id FROM {snapshots} WHERE NOT derived AND as_of_day >= DATE '2001-01-01')")
def _(t):
    # accounts without a real balance in the last months
    recent = t["snapshots"].filter("not derived and as_of_day >= date '2001-01-01'")
    return t["accounts"].select("id").join(recent.select(_C("account_id").alias("id")), "id", "left_anti")


@query("ag11_open_activity", "SELECT count(*) AS n FROM {transactions} WHERE canonical_account_id IS NULL AND (status <> 'pending' OR matched_transaction_id IS NULL)")
def _(t):
    return activity(t).agg(F.count(F.lit(1)).alias("n"))


_BUYS = "SELECT id, 'name:m' || n % 300 AS merchant_key, 'M ' || n % 300 AS merchant_name, CASE n % 4 WHEN 0 THEN 'line_pay' WHEN 1 THEN 'jko_pay' END AS payment_method, 'c' || n % 5 AS category_id, CASE WHEN n % 3 = 0 THEN 'override' ELSE 'rule' END AS category_source, CASE WHEN n % 6 <> 0 THEN 'spending' ELSE 'income' END AS role, amount AS twd FROM {transactions}"
_ALIASES = "SELECT * FROM (VALUES ('name:m1', 'First', 'c9', 'own_transfer'), ('name:m2', NULL, NULL, 'spending'), ('name:gone', 'Gone', 'c1', NULL)) AS v(merchant_key, display_name, category_id, economic_role)"


@query("ag11_listed_merchants", f"""WITH b AS ({_BUYS}), c AS (SELECT merchant_key, category_id, count(*) AS n FROM b GROUP BY 1, 2), u AS (SELECT merchant_key, category_id FROM (SELECT *, row_number() OVER (PARTITION BY merchant_key ORDER BY n DESC, category_id) AS r FROM c) WHERE r = 1),
  s AS (SELECT merchant_key, min(merchant_name) AS name, count(*) AS n, CAST(coalesce(sum(CASE WHEN role = 'spending' THEN -twd END), 0) AS DOUBLE) AS spending, coalesce(string_agg(DISTINCT payment_method, ',' ORDER BY payment_method), '') AS methods FROM b GROUP BY 1)
  SELECT coalesce(s.merchant_key, a.merchant_key) AS merchant_key, coalesce(display_name, name) AS name, coalesce(n, 0) AS activity_count, coalesce(spending, 0) AS spending, coalesce(a.category_id, u.category_id) AS category_id, coalesce(methods, '') AS payment_methods FROM s LEFT JOIN u ON u.merchant_key = s.merchant_key FULL JOIN ({_ALIASES}) a ON a.merchant_key = s.merchant_key""")
def _(t):
    return ledger.listed_merchants(_sql(t, _BUYS, "transactions"), t.spark.sql(_ALIASES))


@query("cl4_with_aliases", f"""SELECT id, CASE WHEN a.category_id IS NOT NULL AND category_source <> 'override' THEN a.category_id ELSE b.category_id END AS category_id, CASE WHEN a.category_id IS NOT NULL AND category_source <> 'override' THEN 'merchant_rule' ELSE category_source END AS category_source, economic_role AS merchant_role FROM ({_BUYS}) b LEFT JOIN ({_ALIASES}) a ON a.merchant_key = b.merchant_key""")
def _(t):
    return ledger.with_aliases(_sql(t, _BUYS, "transactions"), t.spark.sql(_ALIASES)).select("id", "category_id", "category_source", "merchant_role")
