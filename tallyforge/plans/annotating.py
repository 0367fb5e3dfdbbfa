"""Queries of activities with the library's own links: who pays which invoice, monthly totals over them, and annotated items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import annotation, merchants
from tallyforge.plans.catalog import query
from tallyforge.plans.derived import ACT, activity
from tallyforge.sources.durable import stored
from tallyforge.sources.tables import Tables

_C = F.col

def rounds(edges: str, scores: range) -> list[str]:
    """The rounds of the assignment in SQL, one block a score; ``d``: settled, with the same columns each round."""
    parts = [f"e AS MATERIALIZED ({edges})", f"d{scores[0] + 1} AS (SELECT invoice_id, transaction_id, 'none' AS outcome FROM e WHERE FALSE)"]
    for s in scores:
        done = f"d{s + 1}"
        parts += [
            f"t{s} AS MATERIALIZED (SELECT * FROM e WHERE score = {s} AND invoice_id NOT IN (SELECT invoice_id FROM {done}) AND transaction_id NOT IN (SELECT transaction_id FROM {done}))",
            f"a{s} AS MATERIALIZED (SELECT invoice_id, list_sort(list(transaction_id)) AS ts FROM t{s} GROUP BY 1), b{s} AS MATERIALIZED (SELECT transaction_id, list_sort(list(invoice_id)) AS is_ FROM t{s} GROUP BY 1)",
            f"g{s} AS MATERIALIZED (SELECT t{s}.*, ts, is_ FROM t{s} JOIN a{s} USING (invoice_id) JOIN b{s} USING (transaction_id))",
            f"u{s} AS MATERIALIZED (SELECT transaction_id, count(DISTINCT ts) = 1 AND bool_and(exact AND gap = 0) AS ok FROM g{s} GROUP BY 1)",
            f"w{s} AS MATERIALIZED (SELECT invoice_id, count(DISTINCT is_) = 1 AND bool_and(ok) AS ok FROM g{s} JOIN u{s} USING (transaction_id) GROUP BY 1)",
            f"o{s} AS MATERIALIZED (SELECT invoice_id, transaction_id, CASE WHEN len(ts) = 1 AND len(is_) = 1 THEN 'matched' WHEN NOT ok THEN 'blocked' WHEN list_position(is_, invoice_id) = list_position(ts, transaction_id) THEN 'matched' END AS outcome FROM g{s} JOIN w{s} USING (invoice_id))",
            f"d{s} AS MATERIALIZED (SELECT * FROM {done} UNION ALL SELECT * FROM o{s} WHERE outcome IS NOT NULL)",
        ]
    return parts


def assignment(edges: str, scores: range) -> str:
    return f"WITH {', '.join(rounds(edges, scores))} SELECT DISTINCT invoice_id, CASE WHEN outcome = 'matched' THEN transaction_id END AS transaction_id, CASE outcome WHEN 'blocked' THEN 'ambiguous' ELSE outcome END AS outcome FROM d{scores[-1]}"



VOID = "CASE WHEN status IS NULL OR trim(status) = '' THEN FALSE ELSE regexp_matches(lower(translate(status, 'ＶＯＩＤ', 'VOID')), '作廢|註銷|撤銷|退回|void|cancel') OR NOT regexp_matches(lower(status), '開立|確認|正常|issued|confirmed') END"
_CHOICES = "SELECT 'inv:' || o_orderkey AS invoice_id, CASE WHEN o_orderkey % 40 <> 0 THEN 'txn:' || o_orderkey END AS transaction_id, CASE WHEN o_orderkey % 40 = 0 THEN 'separate' ELSE 'linked' END AS decision FROM {orders} WHERE o_orderkey % 16 = 4 OR o_orderkey % 40 = 0"
_PAIRED = """SELECT i.id AS invoice_id, t.id AS transaction_id, abs(t.day - i.day) AS gap, t.amount = i.amount AS exact, CASE WHEN t.amount = i.amount THEN 5 ELSE 3 END + CASE abs(t.day - i.day) WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END + CASE WHEN i.seller = t.merchant THEN 2 ELSE 0 END AS score
  FROM ci i JOIN pt t ON t.day BETWEEN i.day - 3 AND i.day + 3 AND (t.amount = i.amount OR t.amount < i.amount AND t.amount >= i.amount * 0.8E0 AND i.amount - t.amount <= 500 AND i.seller = t.merchant)
  WHERE i.id NOT IN (SELECT invoice_id FROM fx UNION ALL SELECT invoice_id FROM sp) AND t.id NOT IN (SELECT transaction_id FROM fx)"""
#: ``lk``: invoice_id, transaction_id, by_hand, outcome of every link, from ``act``.
LINKS = f"""pf AS ({_CHOICES}), fx AS (SELECT min(invoice_id) AS invoice_id, transaction_id FROM pf WHERE decision = 'linked' AND transaction_id IN (SELECT id FROM act) GROUP BY transaction_id), sp AS (SELECT invoice_id FROM pf WHERE decision = 'separate'),
ci AS (SELECT id, day, amount, seller_name AS seller FROM {{invoices}} WHERE NOT ({VOID}) AND currency = 'TWD' AND amount > 0),
pt AS (SELECT id, account_id, counterparty AS merchant, CAST(-amount AS DECIMAL(18,2)) AS amount, day FROM act WHERE currency = 'TWD' AND amount < 0 AND role IN ('spending', 'advance')),
{", ".join(rounds(_PAIRED, range(10, 4, -1)))},
fd AS (SELECT DISTINCT invoice_id, CASE WHEN outcome = 'matched' THEN transaction_id END AS transaction_id, CASE outcome WHEN 'blocked' THEN 'ambiguous' ELSE outcome END AS outcome FROM d5),
lr AS (SELECT DISTINCT ci.seller, a.account_id, a.counterparty AS merchant FROM fx JOIN ci ON ci.id = fx.invoice_id JOIN act a ON a.id = fx.transaction_id WHERE ci.day - a.day BETWEEN 4 AND 7),
lt AS (SELECT i.id AS invoice_id, t.id AS transaction_id FROM ci i JOIN pt t ON t.amount = i.amount AND i.day - t.day BETWEEN 0 AND 7 JOIN lr ON lr.seller = i.seller AND lr.account_id = t.account_id AND lr.merchant = t.merchant
  WHERE i.id NOT IN (SELECT invoice_id FROM fx UNION ALL SELECT invoice_id FROM sp UNION ALL SELECT invoice_id FROM d5) AND t.id NOT IN (SELECT transaction_id FROM fx UNION ALL SELECT transaction_id FROM d5)),
lu AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY invoice_id) AS x, count(*) OVER (PARTITION BY transaction_id) AS y FROM lt) WHERE x = 1 AND y = 1),
lk AS (SELECT invoice_id, transaction_id, TRUE AS by_hand, 'linked' AS outcome FROM fx UNION ALL SELECT invoice_id, NULL, TRUE, 'separate' FROM sp UNION ALL SELECT invoice_id, transaction_id, FALSE, outcome FROM fd UNION ALL SELECT invoice_id, transaction_id, FALSE, 'late' FROM lu)"""


def links(t: Tables, acts: DataFrame) -> DataFrame:
    """invoice_id, transaction_id, by_hand, outcome: derived from the tables, stored once for all that needs it."""
    asked = t["invoices"].filter(~C.is_voided(_C("status")) & (_C("amount") > 0)).select("id", _C("seller_name").alias("seller"), "amount", "day", "currency")
    known = acts.select("id", "account_id", _C("counterparty").alias("merchant"), "day", "currency", (-_C("amount")).cast("decimal(18,2)").alias("amount"), "role")
    paid = known.filter("currency = 'TWD' and amount > 0 and role in ('spending', 'advance')")
    choices = t.spark.sql(_CHOICES, orders=t["orders"])
    return stored(annotation.linked(asked, paid, known, choices), "links")


def settled_links(found: DataFrame) -> DataFrame:
    """The links that decide about duplicates: all but ambiguous ones."""
    return found.filter("outcome <> 'ambiguous'")


@query("jn12_activity_links", f"{ACT}, {LINKS} SELECT invoice_id, transaction_id, by_hand, outcome FROM lk")
def _(t):
    return links(t, activity(t))


_GOODS = "SELECT invoice_id, line_number, CASE line_number % 4 WHEN 1 THEN '4710088412345 鮮奶茶(大) x2' WHEN 2 THEN '衛生紙 3 包' WHEN 3 THEN '折扣' ELSE '【促銷】衛生紙' END AS description, CASE WHEN line_number = 6 THEN -1 ELSE amount END AS amount FROM {invoice_items}"
_ALIASES = "SELECT 'name:' || s_name AS merchant_key, CASE WHEN s_suppkey % 3 <> 0 THEN 'Shop ' || s_suppkey END AS display_name, s_suppkey % 4 = 1 AS paid_in_cash FROM {supplier}"
_CLASSES = "SELECT id AS invoice_id, CASE n % 14 WHEN 0 THEN 'food' WHEN 2 THEN 'fun' WHEN 4 THEN 'other' WHEN 6 THEN 'home' WHEN 8 THEN 'books' END AS category_id, CASE n % 14 WHEN 0 THEN 'override' WHEN 2 THEN 'user_rule' WHEN 4 THEN 'fallback' WHEN 6 THEN 'system_rule' WHEN 8 THEN 'merchant_rule' END AS source, CASE WHEN n % 18 = 0 THEN 'investment' END AS merchant_role FROM {invoices} WHERE n % 14 <= 8"
_SOURCES = "SELECT id, CASE WHEN n % 31 = 0 THEN 'override' WHEN n % 29 = 0 THEN 'auto_transfer' WHEN n % 3 = 0 THEN 'user_rule' WHEN n % 7 = 0 THEN 'fallback' WHEN n % 4 = 0 THEN 'system_rule' END AS class_source FROM {transactions}"
_TOLD = "SELECT 'invoice' AS kind, 'inv:' || o_orderkey AS id, 'invoice note ' || o_orderkey AS note FROM {orders} WHERE o_orderkey % 6 = 4 UNION ALL SELECT 'bank_transaction', 'txn:' || o_orderkey, 'payment note ' || o_orderkey FROM {orders} WHERE o_orderkey % 5 = 2"


def annotated(t: Tables) -> DataFrame:
    from tallyforge.plans.unified import linked_items  # it needs this module's links

    sql = lambda text, *names: t.spark.sql(text, **{k: t[k] for k in names})
    rows = stored(linked_items(t).drop("rate_to_twd"), "items")
    key = lambda c: F.concat(F.lit("name:"), c)
    sellers = t["invoices"].select(_C("id").alias("invoice_id"), key(_C("seller_name")).alias("_seller"))
    own = t["transactions"].select("id", key(_C("counterparty")).alias("own_key"))
    keys = rows.select("id", "invoice_id", "source").join(sellers, "invoice_id", "left").join(own, "id", "left")
    keys = keys.select("id", F.coalesce("_seller", "own_key").alias("primary_key"), "own_key").distinct()  # ids of trades repeat
    return annotation.annotated(rows, keys, sql(_ALIASES, "supplier"), sql(_CLASSES, "invoices"), sql(_SOURCES, "transactions"), merchants.item_previews(sql(_GOODS, "invoice_items")), sql(_TOLD, "orders"))


def _annotated_sql() -> str:
    from tallyforge.plans.unified import LINKED

    better = "(coalesce(own_source, '') NOT IN ('auto_transfer') AND (r.rank > own_rank OR r.rank = own_rank AND coalesce(own_source, '') <> 'override'))"
    return f"""{LINKED},
al AS ({_ALIASES}), cs AS ({_CLASSES}), so AS ({_SOURCES}), nt AS ({_TOLD}), rk(source, rank) AS (VALUES ('override', 6), ('merchant_rule', 5), ('user_rule', 4), ('system_rule', 3), ('fallback', 0)),
gp AS (SELECT invoice_id, string_agg(name, ',' ORDER BY line) AS preview FROM (SELECT invoice_id, CASE WHEN line_number % 4 = 1 THEN '鮮奶茶(大)' ELSE '衛生紙' END AS name, min(line_number) AS line FROM {{invoice_items}} WHERE line_number % 4 <> 3 AND line_number <> 6 GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT i.*, coalesce('name:' || v.seller_name, 'name:' || tx.counterparty) AS primary_key, 'name:' || tx.counterparty AS own_key, coalesce(so.class_source, 'fallback') AS own_source, coalesce(o.rank, CASE WHEN so.class_source IS NULL THEN 0 ELSE -1 END) AS own_rank, tx.role_override, ir.reason AS invoice_reason
  FROM items i LEFT JOIN {{invoices}} v ON v.id = i.invoice_id LEFT JOIN {{transactions}} tx ON tx.id = i.id LEFT JOIN so ON so.id = i.id LEFT JOIN rk o ON o.source = so.class_source LEFT JOIN ir ON ir.id = i.id),
y AS (SELECT x.*, cs.category_id AS c, cs.source AS s, cs.merchant_role AS mr, p.display_name AS p_name, p.paid_in_cash AS p_cash, q.display_name AS q_name, gp.preview AS preview, n1.note AS n1, n2.note AS n2,
    CASE WHEN x.source IN ('bank', 'card', 'cash') THEN cs.category_id IS NOT NULL AND cs.category_id <> 'other' AND {better} ELSE FALSE END AS takes,
    mr IS NOT NULL AND role IS NOT NULL AND CASE x.source WHEN 'invoice' THEN invoice_reason IN ('invoice', 'invoice_ambiguous') AND duplicate_of IS NULL WHEN 'investment' THEN FALSE ELSE role_override IS NULL END AS new_role
  FROM x LEFT JOIN cs ON cs.invoice_id = x.invoice_id LEFT JOIN rk r ON r.source = cs.source LEFT JOIN al p ON p.merchant_key = x.primary_key LEFT JOIN al q ON q.merchant_key = x.own_key LEFT JOIN gp ON gp.invoice_id = x.invoice_id
  LEFT JOIN nt n1 ON n1.id = x.id AND n1.kind = CASE x.source WHEN 'invoice' THEN 'invoice' ELSE 'bank_transaction' END
  LEFT JOIN nt n2 ON n2.kind = CASE x.source WHEN 'invoice' THEN 'bank_transaction' ELSE 'invoice' END AND n2.id = CASE x.source WHEN 'invoice' THEN x.duplicate_of ELSE x.invoice_id END),
z AS (SELECT id, source, invoice_id, duplicate_of, CASE WHEN source <> 'investment' THEN coalesce(p_name, q_name) END AS display_name, CASE WHEN source <> 'investment' THEN coalesce(preview, '') ELSE '' END AS preview,
    CASE WHEN source <> 'investment' THEN coalesce(n1, n2) END AS note, CASE WHEN source = 'investment' THEN NULL WHEN n1 IS NOT NULL THEN id WHEN n2 IS NOT NULL THEN CASE source WHEN 'invoice' THEN duplicate_of ELSE invoice_id END END AS note_of, source = 'invoice' AND coalesce(p_cash, FALSE) AS paid_in_cash,
    CASE source WHEN 'investment' THEN NULL WHEN 'invoice' THEN coalesce(s, 'fallback') ELSE CASE WHEN takes THEN CASE s WHEN 'override' THEN 'invoice' ELSE s END ELSE own_source END END AS class_source,
    CASE source WHEN 'invoice' THEN coalesce(c, 'other') WHEN 'investment' THEN category_id ELSE CASE WHEN takes THEN c ELSE category_id END END AS category_id,
    CASE WHEN new_role THEN mr ELSE role END AS role, CASE WHEN new_role THEN 'confirmed' ELSE review END AS review FROM y)
SELECT z.id, z.source, z.display_name, z.preview, z.note, z.note_of, z.paid_in_cash, coalesce(f.class_source, z.class_source) AS class_source, CASE WHEN f.id IS NOT NULL THEN f.category_id ELSE z.category_id END AS category_id, z.role, z.review
FROM z LEFT JOIN z f ON z.source = 'invoice' AND f.id = z.duplicate_of AND f.source IN ('bank', 'card') AND f.invoice_id IS NOT NULL"""


def register() -> None:
    """The query over the unified table, once that is there."""

    @query("cl18_annotated_items", _annotated_sql())
    def _(t):
        return annotated(t).select("id", "source", "display_name", F.coalesce(F.array_join("preview", ","), F.lit("")).alias("preview"), "note", "note_of", "paid_in_cash", "class_source", "category_id", "role", "review")
