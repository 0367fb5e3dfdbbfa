"""Queries of merge candidates: each generator's pairs that are one to one."""

from __future__ import annotations

from tallyforge.operators import candidates, linkage
from tallyforge.plans.catalog import query

# every transaction, and a second row of most of them under another id; days, texts and amounts collide for some
_TWICE = """
SELECT 'old:' || n AS id, 'old' AS version, account_id, connector_id, posted_date AS posted, CASE WHEN n % 4 = 0 THEN CAST(CAST(posted_date AS DATE) - CAST(1 AS INT) AS STRING) ELSE posted_date END AS authorized, CASE WHEN n % 6 = 0 THEN 5.0 ELSE CAST(amount AS DOUBLE) END AS amount, currency,
  CASE WHEN n % 7 <> 0 THEN description END AS description, CASE n % 5 WHEN 0 THEN 'S' || n // 10 ELSE 'S' || n END AS source_id, n % 3 AS occurrence, n AS created_at, n FROM {transactions}
UNION ALL SELECT 'new:' || n, 'new', account_id, connector_id, posted_date, posted_date, CASE WHEN n % 6 = 0 THEN 5.0 ELSE CAST(amount AS DOUBLE) END, currency, CASE WHEN n % 7 <> 0 THEN description END, 'S' || n, n % 3, n + 1, n FROM {transactions} WHERE n % 9 <> 0"""


def _rows(t):
    text = _TWICE.replace("n // 10", "n div 10")
    return t.spark.sql(text, transactions=t["transactions"])


def _one_to_one(pairs: str) -> str:
    return f"WITH r AS ({_TWICE}), o AS (SELECT * FROM r WHERE version = 'old'), w AS (SELECT * FROM r WHERE version = 'new'), c AS ({pairs}) SELECT old_id, new_id FROM (SELECT *, count(*) OVER (PARTITION BY old_id) AS x, count(*) OVER (PARTITION BY new_id) AS y FROM (SELECT DISTINCT old_id, new_id FROM c)) WHERE x = 1 AND y = 1"


def _sides(t):
    rows = _rows(t)
    return rows.filter("version = 'old'"), rows.filter("version = 'new'")


_SAME = "o.account_id = w.account_id AND o.amount = w.amount AND o.currency = w.currency"


@query("jn34_legacy_ids", _one_to_one(f"SELECT o.id AS old_id, w.id AS new_id FROM o JOIN w ON {_SAME} AND coalesce(o.description, '') = coalesce(w.description, '') AND (w.authorized = o.posted OR w.posted = o.posted)"))
def _(t):
    old, new = _sides(t)
    return linkage.one_to_one(candidates.legacy_ids(old, new, ["posted"], ["authorized", "posted"], ["account_id", "amount", "currency", "description"]))


@query("jn34_legacy_ids_any_day", _one_to_one(f"SELECT o.id AS old_id, w.id AS new_id FROM o JOIN w ON {_SAME} AND (w.authorized = o.posted OR w.posted = o.posted OR w.authorized = o.authorized OR w.posted = o.authorized)"))
def _(t):
    old, new = _sides(t)
    return linkage.one_to_one(candidates.legacy_ids(old, new, ["posted", "authorized"], ["authorized", "posted"], ["account_id", "amount", "currency"]))


@query("jn34_summary_shadows", _one_to_one("SELECT o.id AS old_id, w.id AS new_id FROM o JOIN {accounts} a ON a.id = o.account_id AND a.account_type = 'credit' JOIN w ON w.connector_id = o.connector_id AND w.source_id = o.source_id JOIN {accounts} b ON b.id = w.account_id AND b.account_type = 'credit'"))
def _(t):
    # the old rows' account is the summary, the new rows' the card
    rows = _rows(t).join(t["accounts"].filter("account_type = 'credit'").selectExpr("id as account_id"), "account_id", "left_semi").selectExpr("id", "connector_id", "concat(version, account_id) as account_id", "source_id")
    kinds = rows.selectExpr("account_id as id", "if(startswith(account_id, 'old'), 'summary', 'card') as kind").distinct()
    return linkage.one_to_one(candidates.summary_shadows(rows, kinds))


@query("jn34_oldest_shadows", _one_to_one(f"SELECT old_id, new_id FROM (SELECT o.id AS old_id, w.id AS new_id, row_number() OVER (PARTITION BY w.id ORDER BY o.created_at, o.id) AS k FROM o JOIN w ON {_SAME} AND o.posted = w.posted) WHERE k = 1"))
def _(t):
    return linkage.one_to_one(candidates.oldest_shadows(*_sides(t), ["account_id", "amount", "currency", "posted"]))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY account_id, amount, description, version ORDER BY occurrence, created_at, id) AS k FROM r WHERE description IS NOT NULL"


@query("jn34_stale_ranks", _one_to_one(f"SELECT o.id AS old_id, w.id AS new_id FROM ({_RANKED}) o JOIN ({_RANKED}) w ON o.account_id = w.account_id AND o.amount = w.amount AND o.description = w.description AND o.k = w.k AND o.version = 'old' AND w.version = 'new'"))
def _(t):
    rows = _rows(t).selectExpr("*", "version = 'new' as fresh")
    return linkage.one_to_one(candidates.stale_ranks(rows, ["account_id", "amount", "description"]))


_STARS = "CASE n % 4 WHEN 0 THEN substr(source_id, 1, 2) || repeat('*', length(source_id) - 2) WHEN 1 THEN substr(source_id, 1, length(source_id) - 1) || '*' WHEN 2 THEN '*' || substr(source_id, 2) ELSE source_id END"


@query("jn34_masked_ids", _one_to_one(f"SELECT o.id AS old_id, m.id AS new_id FROM o JOIN (SELECT *, {_STARS} AS shown FROM w) m ON m.account_id = o.account_id AND contains(m.shown, '*') AND length(m.shown) = length(o.source_id) AND regexp_full_match(o.source_id, replace(m.shown, '*', '.'))"))
def _(t):
    old, new = _sides(t)
    return linkage.one_to_one(candidates.masked_ids(old, new.drop("source_id").join(new.selectExpr("id", f"{_STARS} as source_id"), "id"), ["account_id"]))
