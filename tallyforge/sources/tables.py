"""Canonical ledger tables as SQL projections of the retail star schema.

Each text is valid in Spark SQL and in DuckDB: :class:`Tables` runs it over parquet, and :func:`with_tables` puts
the same text before an oracle query as common table expressions.  Nothing is read until a table is used,
and Catalyst prunes the columns a query does not need.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = frozenset("region nation customer supplier part orders lineitem events documents".split())
TODAY = "2001-07-15"

PROJECTIONS = {
    "accounts": """
SELECT 'acct:' || c_custkey AS id, 'conn' || (c_custkey % 5) AS connector_id, c_mktsegment AS institution_name,
  CASE c_custkey % 4 WHEN 0 THEN 'credit' WHEN 1 THEN 'checking' WHEN 2 THEN 'savings' ELSE 'time_deposit' END AS account_type,
  CASE WHEN c_nationkey % 5 = 0 THEN 'USD' WHEN c_nationkey % 7 = 0 THEN 'JPY' WHEN c_nationkey % 11 = 0 THEN 'KRW' ELSE 'TWD' END AS currency,
  lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS account_last4,
  CASE WHEN c_custkey % 97 = 5 THEN 'acct:' || (c_custkey - 1) END AS canonical_account_id, c_custkey % 89 = 7 AS inactive
FROM {customer}""",
    "transactions": """
SELECT 'txn:' || o_orderkey AS id, o_orderkey AS n, a.id AS account_id, a.connector_id, a.account_type, a.account_last4, a.currency, a.canonical_account_id,
  CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'posted' END AS status, CAST(CAST(o_orderdate AS DATE) AS STRING) AS posted_date,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T18:30:00Z' WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS authorized_at,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount,
  o_orderpriority AS description, s_name AS counterparty, CASE WHEN o_orderkey % 11 = 3 THEN 'txn:' || (o_orderkey + 1) END AS matched_transaction_id,
  CASE WHEN o_orderkey % 41 = 0 THEN 'excluded' WHEN o_orderkey % 43 = 0 THEN 'advance' WHEN o_orderkey % 47 = 0 THEN 'reimbursement' WHEN o_orderkey % 53 = 0 THEN 'investment' END AS role_override,
  CASE WHEN o_orderkey % 43 = 0 OR o_orderkey % 47 = 0 THEN 'Friend' || (o_orderkey % 6) END AS advance_counterparty
FROM {orders} JOIN {accounts} a ON a.id = 'acct:' || o_custkey JOIN {supplier} ON s_suppkey = o_orderkey % 10""",
    "invoices": """
SELECT 'inv:' || o_orderkey AS id, o_orderkey AS n, 'AB' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS invoice_number, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INT) AS day, s_name AS seller_name,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INT) AS STRING) || CASE o_orderkey % 12 WHEN 0 THEN 'T17:45:00Z' WHEN 4 THEN 'T09:05:00+08:00' WHEN 6 THEN ' 10:00' ELSE '' END AS invoice_date,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END AS DECIMAL(18,2)) AS amount, 'TWD' AS currency,
  CASE o_orderkey % 20 WHEN 2 THEN '作廢' WHEN 4 THEN '開立' WHEN 6 THEN '' WHEN 8 THEN '已撤銷' WHEN 10 THEN 'Issued' WHEN 12 THEN 'ＶＯＩＤ' WHEN 14 THEN ' 正常 ' WHEN 16 THEN 'valid' WHEN 18 THEN '已退回' END AS status,
  '{{' || CASE o_orderkey % 22 WHEN 2 THEN '"sellerID":" 12345678 ",' WHEN 4 THEN '"invoice":{{"sellerBan":"87654321","invStatus":"已確認"}},' WHEN 6 THEN '"invStatus":" ",' ELSE '' END
  || '"detail":{{"currency":"' || CASE WHEN o_orderkey % 14 = 0 THEN ' usd ' WHEN o_orderkey % 16 = 0 THEN 'bad!' ELSE 'twd' END || '","sellerBan":"' || lpad(CAST(o_orderkey % 100000 AS STRING), CASE WHEN o_orderkey % 18 = 0 THEN 5 ELSE 8 END, '1')
  || '","amount":"' || CAST(o_orderkey % 1000 AS STRING) || CASE WHEN o_orderkey % 28 = 0 THEN '.25' ELSE '' END || '"' || CASE WHEN o_orderkey % 26 = 0 THEN ',"invStatus":"開立"' ELSE '' END
  || ',"details":[{{"description":" Tea  Cup ","amount":"' || CAST(o_orderkey % 1000 AS STRING) || '.5"}},{{"description":"","amount":"n/a"}},{{"description":"Rice","amount":0}}]}}}}' AS raw_payload
FROM {orders} JOIN {supplier} ON s_suppkey = o_orderkey % 10 WHERE o_orderkey % 2 = 0""",
    "invoice_items": """
SELECT 'inv:' || l_orderkey AS invoice_id, l_linenumber AS line_number, p_name AS description, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "invoice_links": "SELECT 'inv:' || o_orderkey AS invoice_id, CASE WHEN o_orderkey % 40 <> 0 THEN 'txn:' || o_orderkey END AS transaction_id, o_orderkey % 24 = 0 AS by_hand FROM {orders} WHERE o_orderkey % 8 = 0",
    "trades": """
SELECT 'trade:' || l_orderkey || '-' || l_linenumber AS id, l_orderkey AS n, CASE WHEN l_linenumber <> 2 THEN 'Fund ' || l_partkey % 50 END AS name, 'F' || l_partkey % 50 AS symbol,
  CASE WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 5 THEN '0' || lpad(CAST(year(l_shipdate) - 1911 AS STRING), 3, '0') || substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 5) ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END AS trade_date,
  CAST(CAST(l_shipdate AS DATE) + CAST(2 AS INT) AS STRING) AS posted_date, CASE l_linenumber % 4 WHEN 0 THEN '買進' WHEN 1 THEN '現金股利' WHEN 2 THEN 'SELL' END AS transaction_name,
  CAST(CASE WHEN l_linenumber = 4 THEN 1 ELSE l_extendedprice / l_quantity END AS DOUBLE) AS price, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, 'TWD' AS currency
FROM {lineitem}""",
    "snapshots": """
SELECT 'snap:' || o_orderkey AS id, o_orderkey AS n, 'acct:' || o_custkey AS account_id, CAST(o_totalprice AS DECIMAL(18,2)) AS balance, CAST(o_orderdate AS DATE) AS as_of_day, o_orderkey % 4 = 0 AS derived
FROM {orders}""",
    "positions": """
SELECT 'conn' || (l_suppkey % 5) AS connector_id, CASE l_partkey % 3 WHEN 0 THEN 'stock' WHEN 1 THEN 'etf' ELSE 'fund' END AS asset_type, l_partkey AS symbol,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS as_of_date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS market_value
FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    "rates": "SELECT * FROM (VALUES ('USD', 31.5E0), ('JPY', 0.21E0), ('EUR', 34.2E0), ('CNY', 4.4E0)) AS t(currency, rate_to_twd)",
    "rules": """
SELECT * FROM (VALUES ('r1', 'salary', 'income', 'description', 'contains', 'urgent', 110, 'inflow'), ('r2', 'transfer', 'own_transfer', 'description', 'equals', '5-low', 90, 'any'),
  ('r3', 'food', 'spending', 'counterparty', 'regex', '#0+[1-3]$', 100, 'outflow'), ('r4', 'fun', 'spending', 'description', 'starts_with', '2-', 100, 'outflow'))
AS t(id, category_id, economic_role, field, operator, pattern, priority, direction)""",
    "dense_transactions": """
SELECT o_orderkey AS id, 'acct:' || o_custkey AS account_id, 'Supplier ' || (o_orderkey % 3) AS merchant, CAST(100 * (1 + o_orderkey % 40) AS BIGINT) AS amount,
  CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_orderkey % 28 AS INT) AS day, o_orderkey % 80 < 40 AS inflow FROM {orders}""",
    "dense_invoices": """
SELECT o_orderkey AS id, 'Supplier ' || (o_orderkey % 3) AS seller, CAST(100 * (1 + o_orderkey % 40) + CASE WHEN o_orderkey % 10 = 4 THEN 60 ELSE 0 END AS BIGINT) AS amount,
  CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_orderkey % 28 + o_orderkey % 5 AS INT) AS day FROM {orders} WHERE o_orderkey % 2 = 0""",
    "cash_expenses": """
SELECT 'cash:' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS expense_date, CAST(1 + floor(o_totalprice) AS BIGINT) AS amount, o_orderpriority AS description, 'food' AS category_id
FROM {orders}""",
    "withdrawals": """
SELECT id, n, CAST(posted_date AS DATE) AS day, CAST(-amount AS DECIMAL(18,2)) AS amount FROM {transactions} WHERE amount < 0 AND currency = 'TWD' AND account_type <> 'credit'""",
    "deposits": """
SELECT a.id, CASE CAST(substr(a.id, 6) AS INT) % 9 WHEN 0 THEN 'esun' WHEN 1 THEN 'cathaybk' WHEN 2 THEN 'ctbc' WHEN 3 THEN 'obank' WHEN 4 THEN 'other' ELSE 'firstbank' END AS connector_id, a.account_last4,
  CASE WHEN CAST(substr(a.id, 6) AS INT) % 13 = 1 THEN CAST('1998-09-15' AS DATE) END AS opened_date, s.anchor_balance, CASE WHEN CAST(substr(a.id, 6) AS INT) % 17 <> 2 THEN a.currency END AS anchor_currency,
  CAST(s.anchor_day AS STRING) || CASE CAST(substr(a.id, 6) AS INT) % 3 WHEN 0 THEN 'T18:30:00Z' WHEN 1 THEN 'T02:00:00Z' ELSE 'T20:00:00+08:00' END AS anchor_at
FROM {accounts} a LEFT JOIN (SELECT account_id, min(as_of_day) AS anchor_day, CAST(min(balance) AS DECIMAL(18,2)) AS anchor_balance FROM {snapshots} WHERE NOT derived AND as_of_day >= CAST('1999-06-01' AS DATE) GROUP BY account_id) s ON s.account_id = a.id""",
    "deposit_rows": """
SELECT t.id, t.account_id, t.n, t.posted_date, t.authorized_at, t.amount, CASE WHEN t.n % 211 = 0 THEN 'EUR' WHEN CAST(substr(t.account_id, 6) AS INT) % 17 <> 2 THEN t.currency ELSE 'TWD' END AS currency,
  CASE WHEN CAST(substr(t.account_id, 6) AS INT) % 4 = 1 AND t.n % 3 = 0 THEN '{{"note":"-","balance":"n/a"}}' WHEN t.n % 5 = 0 THEN '{{"defaultSeq":' || t.n || ',"balanceAfter":" ' || r.running || '"}}' ELSE '{{"balance":"' || r.running || '","acctBal":1,"sequenceNumber":"' || t.n || '"}}' END AS raw_payload
FROM {transactions} t JOIN (SELECT id, CAST(sum(amount) OVER (PARTITION BY account_id ORDER BY CAST(CASE WHEN length(authorized_at) > 10 THEN CAST(posted_date AS DATE) + CAST(1 AS INT) ELSE CAST(posted_date AS DATE) END AS DATE), CASE WHEN length(authorized_at) > 10 THEN 1 ELSE 0 END, n)
  + CASE WHEN n % 19 = 0 THEN 5 ELSE 0 END + CAST(substr(account_id, 6) AS INT) AS DECIMAL(18,2)) AS running FROM {transactions}) r ON r.id = t.id""",
    "bills": """
SELECT account_id, connector_id, substr(posted_date, 1, 7) AS billing_period, currency, CAST(sum(-amount) AS DECIMAL(18,2)) AS statement_amount, CAST(max(CAST(posted_date AS DATE)) AS DATE) AS closing_date
FROM {transactions} WHERE account_type = 'credit' AND amount < 0 GROUP BY 1, 2, 3, 4""",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", text)))


class Tables:
    """``tables["transactions"]`` and the like, over the parquet files of ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in RAW:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = PROJECTIONS[name]
                self._made[name] = self.spark.sql(text, **{k: self[k] for k in _names(text)})
        return self._made[name]


def with_tables(query: str) -> str:
    """``query`` with the tables it names in braces as common table expressions before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _names(text):
            if name not in RAW and name not in order:
                need(PROJECTIONS[name])
                order.append(name)

    need(query)
    plain = lambda text: re.sub(r"(?<!\{)\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")
    head = ", ".join(f"{name} AS ({plain(PROJECTIONS[name])})" for name in order)
    body = plain(query).strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
