"""Queries of statements: directions from running balances and from flags."""

from __future__ import annotations

from tallyforge.operators import statements
from tallyforge.plans.catalog import query

# months of accounts, newest or oldest first, some with all times alike, some rows unread, some balances wrong
_LINES = """
SELECT account_id, month, CASE WHEN kind % 2 = 0 THEN -n ELSE n END AS place, CASE WHEN n % 23 <> 0 THEN CASE WHEN kind % 3 = 0 THEN month ELSE posted_date END END AS seen, CAST(abs(amount) AS DOUBLE) AS amount,
  CASE WHEN n % 19 <> 0 THEN CAST(running AS DOUBLE) + CASE WHEN n % 41 = 0 THEN 3 ELSE 0 END END AS balance, CASE WHEN n % 5 < 4 THEN (amount > 0) = (kind % 5 <> 1) END AS flag
FROM (SELECT account_id, substr(posted_date, 1, 4) AS month, CAST(substr(account_id, 6) AS INT) AS kind, n, posted_date, amount, CAST(sum(amount) OVER (PARTITION BY account_id, substr(posted_date, 1, 4) ORDER BY posted_date, n) AS DECIMAL(18,2)) AS running FROM {transactions})"""
_FOUND = f"""WITH l AS ({_LINES}), p AS (SELECT *, CASE WHEN seen IS NOT NULL AND lead(seen) OVER w IS NOT NULL THEN balance - lead(balance) OVER w END AS dn, CASE WHEN seen IS NOT NULL AND lag(seen) OVER w IS NOT NULL THEN balance - lag(balance) OVER w END AS d_o FROM l WINDOW w AS (PARTITION BY account_id, month ORDER BY place)),
  t AS (SELECT account_id, month, coalesce(bool_and(abs(abs(dn) - amount) <= 0.005), FALSE) AS n_all, coalesce(bool_and(abs(abs(d_o) - amount) <= 0.005), FALSE) AS o_all, arg_min(seen, place) FILTER (seen IS NOT NULL) AS a, arg_max(seen, place) FILTER (seen IS NOT NULL) AS b FROM p GROUP BY 1, 2),
  f AS (SELECT p.account_id, p.month, p.place, p.flag, CASE WHEN a > b OR coalesce(a = b, TRUE) AND n_all AND NOT o_all THEN CASE WHEN abs(abs(dn) - amount) <= 0.005 THEN CASE WHEN dn > 0 THEN 1 ELSE -1 END END
    WHEN a < b OR coalesce(a = b, TRUE) AND o_all AND NOT n_all THEN CASE WHEN abs(abs(d_o) - amount) <= 0.005 THEN CASE WHEN d_o > 0 THEN 1 ELSE -1 END END END AS direction FROM p JOIN t ON t.account_id = p.account_id AND t.month = p.month)"""


def _found(t):
    return statements.directions(t.spark.sql(_LINES, transactions=t["transactions"]).withColumnRenamed("seen", "at"), ["account_id", "month"])


@query("nm8_directions", f"{_FOUND} SELECT account_id, month, place, direction FROM f")
def _(t):
    return _found(t).select("account_id", "month", "place", "direction")


@query("nm8_learned_flags", f"""{_FOUND}, e AS (SELECT account_id, min(CASE WHEN flag THEN direction ELSE -direction END) AS low, max(CASE WHEN flag THEN direction ELSE -direction END) AS high FROM f WHERE flag IS NOT NULL AND direction IS NOT NULL GROUP BY 1)
  SELECT f.account_id, month, place, coalesce(direction, CASE WHEN low = high THEN CASE WHEN flag THEN low WHEN NOT flag THEN -low END END) AS direction FROM f LEFT JOIN e ON e.account_id = f.account_id""")
def _(t):
    return statements.with_flags(_found(t), ["account_id"]).select("account_id", "month", "place", "direction")
