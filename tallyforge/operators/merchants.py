"""Merchants: cleaned names and keys, item previews, and similar pairs of sellers and payment texts.

Texts repeat, so each function cleans distinct texts once and joins the result back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import banks as B
from tallyforge.functions import text as T


def _each(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` maps a row's values to the tuple of ``schema`` after the input columns."""
    names = df.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*r, *function(*(None if x is None or x is pd.NA else x for x in r))) for r in part.astype(object).where(part.notna(), None).itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[*names, *(x.split()[0] for x in schema.split(", "))])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{own}, {schema}")


def _with_texts(rows: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """``rows`` with ``function`` of the distinct values of ``keys``."""
    found = _each(rows.select(*(F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys))).distinct(), function, schema)
    same = None
    for i, k in enumerate(keys):
        test = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        same = test if same is None else same & test
    return rows.join(found, same, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def cleaned(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``clean_name``, ``payment_method`` and ``name_key`` of a text column."""
    def one(x):
        name, method = T.clean_name(x)
        return name, method, T.name_key(name)

    return _with_texts(rows, [column], one, "clean_name string, payment_method string, name_key string")


def _named(raw: str | None) -> tuple[str, str, str | None] | None:
    name, method = T.clean_name(raw)
    key = T.name_key(name)
    return (f"name:{key}", name, method) if key else None


def _invoice_identity(seller: str | None, ban: str | None) -> tuple:
    number = T.unicodedata.normalize("NFKC", ban or "").strip()
    own = _named(seller)
    if T.re.fullmatch(r"\d{8}", number):
        return f"ban:{number}", own[1] if own else number, None
    return own or (None, None, None)


def _bank_identity(description: str | None, counterparty: str | None) -> tuple:
    texts = [t for t in ((T.unicodedata.normalize("NFKC", x).strip() if x else "") for x in (counterparty, description)) if t]
    texts = [t for t in texts if not T.is_generic(t)]
    wallets = [t for t in texts if T.wallet(t)[1]]
    return next((found for t in [*wallets[:1], *texts] if (found := _named(t))), (None, None, None))


_IDENTITY = "merchant_key string, merchant_name string, payment_method string"


def invoice_merchants(invoices: DataFrame, seller: str = "seller_name", ban: str = "seller_ban") -> DataFrame:
    """``invoices`` with merchant_key (tax number first), merchant_name and payment_method."""
    return _with_texts(invoices, [seller, ban], _invoice_identity, _IDENTITY)


def bank_merchants(transactions: DataFrame) -> DataFrame:
    """``transactions`` (description, counterparty) likewise: wallet texts first, then the counterparty, then the description; generic texts name none."""
    return _with_texts(transactions, ["description", "counterparty"], _bank_identity, _IDENTITY)


def bank_codes(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``bank_code``: the one bank that a text names."""
    return rows.withColumn("bank_code", B.code_in_text(T.nfkc(F.col(column))))


def item_names(items: DataFrame) -> DataFrame:
    """(invoice_id, line_number, name) of the goods among the lines: no discounts, no negative amounts, cleaned names."""
    rows = items.filter((F.col("amount").isNull() | (F.col("amount") > 0)) & ~F.coalesce(F.col("description").rlike(T.NOT_GOODS), F.lit(False)))
    return _with_texts(rows, ["description"], lambda x: (T.clean_item(x),), "name string").filter("name is not null").select("invoice_id", "line_number", "name")


def item_previews(items: DataFrame, most: int = 3) -> DataFrame:
    """(invoice_id, preview): the first ``most`` distinct item names of each invoice."""
    first = item_names(items).groupBy("invoice_id", "name").agg(F.min("line_number").alias("line"))
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line", "name"))), 1, most), lambda x: x["name"])
    return first.groupBy("invoice_id").agg(listed.alias("preview"))


def similar_pairs(sellers: DataFrame, texts: DataFrame) -> DataFrame:
    """(seller, ban, merchant, level, brand): distinct sellers (seller, ban) and payment texts (merchant) that are ``strong`` or ``partial``.

    Texts meet over keys that any similar pair shares, so no text is compared with all others; only those pairs are measured.
    """
    left = _each(sellers.select("seller", F.col("ban").cast("string").alias("ban")).distinct(), lambda s, b: (T.blocks(s, b),), "keys array<string>")
    right = _each(texts.select("merchant").filter("merchant is not null").distinct(), lambda m: (T.blocks(m, m),), "keys array<string>")
    pairs = left.withColumn("key", F.explode("keys")).join(right.withColumn("key", F.explode("keys")).select("merchant", "key"), "key").select("seller", "ban", "merchant").distinct()
    return _each(pairs, lambda s, b, m: (T.similarity(s, b, m), T.brand_match(s, m)), "level string, brand boolean").filter("level <> 'none'")
