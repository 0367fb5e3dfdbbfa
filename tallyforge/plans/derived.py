"""Transactions with category and role, as the queries derive them, and the same by hand for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyforge.operators import ledger
from tallyforge.sources.tables import Tables

RULES = [
    {"id": "r1", "category_id": "salary", "economic_role": "income", "field": "description", "operator": "contains", "pattern": "urgent", "priority": 110, "direction": "inflow", "updated_at": "2024-02-01"},
    {"id": "r10", "category_id": "bonus", "economic_role": "income", "field": "description", "operator": "contains", "pattern": "URGENT", "priority": 110, "direction": "inflow", "updated_at": "2024-02-01"},
    {"id": "r0", "category_id": "older", "economic_role": "income", "field": "description", "operator": "contains", "pattern": "urgent", "priority": 110, "direction": "inflow", "updated_at": "2024-01-01"},
    {"id": "r5", "category_id": "broken", "economic_role": "spending", "field": "description", "operator": "regex", "pattern": "(", "priority": 200, "direction": "any"},
    {"id": "r2", "category_id": "transfer", "economic_role": "own_transfer", "field": "description", "operator": "equals", "pattern": "5-low", "priority": 90, "direction": "any"},
    {"id": "r3", "category_id": "food", "economic_role": "spending", "field": "counterparty", "operator": "regex", "pattern": "#0+[1-3]$", "priority": 100, "direction": "outflow"},
    {"id": "r4", "category_id": "fun", "economic_role": "spending", "field": "description", "operator": "starts_with", "pattern": "2-", "priority": 100, "direction": "outflow"},
]


def activity(t: Tables) -> DataFrame:
    return ledger.activity(t["transactions"], t["rates"], RULES)


# The same derivation for the oracle, written out by hand.
DAY = "CASE WHEN length(authorized_at) > 10 THEN CAST(CAST(replace(replace(authorized_at, 'T', ' '), 'Z', '') AS TIMESTAMP) + INTERVAL 8 HOUR AS DATE) ELSE CAST(substr(coalesce(authorized_at, posted_date), 1, 10) AS DATE) END"
ACT = f"""
WITH ruled AS (
  SELECT *, {DAY} AS day,
    CASE WHEN lower(description) LIKE '%urgent%' AND amount > 0 THEN 'r1' WHEN regexp_matches(counterparty, '#0+[1-3]$') AND amount < 0 THEN 'r3'
      WHEN lower(description) LIKE '2-%' AND amount < 0 THEN 'r4' WHEN lower(description) = '5-low' THEN 'r2' END AS rule_id
  FROM {{transactions}} WHERE canonical_account_id IS NULL AND (status <> 'pending' OR matched_transaction_id IS NULL)),
act AS (
  SELECT ruled.*, strftime(day, '%Y-%m') AS month,
    CASE rule_id WHEN 'r1' THEN 'salary' WHEN 'r2' THEN 'transfer' WHEN 'r3' THEN 'food' WHEN 'r4' THEN 'fun' ELSE 'other' END AS category_id,
    coalesce(role_override, CASE rule_id WHEN 'r1' THEN 'income' WHEN 'r2' THEN 'own_transfer' WHEN 'r3' THEN 'spending' WHEN 'r4' THEN 'spending' END,
      CASE WHEN amount > 0 AND account_type <> 'credit' THEN 'income' ELSE 'spending' END) AS role,
    CASE WHEN role_override IS NOT NULL THEN 'confirmed' WHEN rule_id IS NULL AND lower(description) LIKE '%not specified%' THEN 'needs_review' ELSE 'auto' END AS review,
    CAST(floor((CASE WHEN ruled.currency = 'TWD' OR amount = 0 THEN CAST(amount AS DOUBLE) WHEN rate_to_twd > 0 THEN CAST(amount AS DOUBLE) * rate_to_twd END) * 100 + 0.5) / 100.0 AS DECIMAL(18,2)) AS twd
  FROM ruled LEFT JOIN {{rates}} r ON r.currency = ruled.currency)
"""
