"""Candidates for merging rows that a source has written twice under different ids.

Only pairs that are one to one are merged afterwards (:func:`tallyforge.operators.linkage.merge_mapping`).  So a key that many old and many new rows share need not
give all its pairs: each row is paired with the first and the last row of the other side, which is enough to tell that it has
several candidates, and a key with one row each side gives that pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK = "*"


def _witnesses(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(old_id, new_id): for rows of equal ``keys`` (none null), pairs of which those without a rival are the ones that all pairs would leave."""

    def met(rows: DataFrame, others: DataFrame, name: str, other: str) -> DataFrame:
        ends = others.dropna(subset=keys).groupBy(*keys).agg(F.array_distinct(F.array(F.min("id"), F.max("id"))).alias("ends"))
        return rows.join(ends, keys).select(F.col("id").alias(name), F.explode("ends").alias(other))

    return met(old, new, "old_id", "new_id").unionByName(met(new, old, "new_id", "old_id")).filter("old_id <> new_id").distinct()


def legacy_ids(old: DataFrame, new: DataFrame, old_days: list[str], new_days: list[str], same: list[str]) -> DataFrame:
    """Rows of an older kind of id and the newer rows that agree in the columns ``same`` and in any of ``old_days`` with any of ``new_days``."""
    days = lambda rows, names: rows.withColumn("_day", F.explode(F.array_distinct(F.array_compact(F.array(*names)))))
    filled = lambda rows: rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in same})
    return _witnesses(days(filled(old), old_days), days(filled(new), new_days), [*same, "_day"])


def summary_shadows(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows of a summary account and those of a card's own account with the same source id.

    rows: id, connector_id, account_id, source_id; accounts: id, kind (``summary`` or ``card``).
    """
    of = lambda kind: rows.join(accounts.filter(F.col("kind") == kind).select(F.col("id").alias("account_id")), "account_id", "left_semi")
    return _witnesses(of("summary"), of("card"), ["connector_id", "source_id"])


def oldest_shadows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Each new row with the oldest old one of its key: of several old rows one is merged a round.  old: id, created_at and ``keys``."""
    first = old.groupBy(*keys).agg(F.min(F.struct("created_at", "id")).alias("first"))
    return new.join(first, keys).select(F.col("first.id").alias("old_id"), F.col("id").alias("new_id"))


def stale_ranks(rows: DataFrame, identity: list[str]) -> DataFrame:
    """The nth stale with the nth fresh row of an identity, in the order of their occurrence.  rows: id, fresh (boolean), occurrence, created_at and ``identity``."""
    w = Window.partitionBy(*identity, "fresh").orderBy(F.col("occurrence").asc_nulls_first(), "created_at", "id")
    ranked = rows.dropna(subset=identity).withColumn("_rank", F.row_number().over(w))
    side = lambda fresh, name: ranked.filter(F.col("fresh") == fresh).select(*identity, "_rank", F.col("id").alias(name))
    return side(False, "old_id").join(side(True, "new_id"), [*identity, "_rank"]).select("old_id", "new_id")


def _masked(text: Column, signature: Column) -> Column:
    """``text`` with the signature's masked places masked."""
    return F.array_join(F.zip_with(F.split(text, ""), F.split(signature, ""), lambda c, s: F.when(s == MASK, MASK).otherwise(c)), "")


def masked_ids(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ids agree wherever the new one is not masked: ``AB12****7`` meets ``AB1234567``.  Both: id, source_id and ``keys``.

    An old id is masked in the few ways that new ids of its key and length are, and then meets them by equality.
    """
    signature = F.regexp_replace("source_id", r"[^*]", "-")
    asked = new.filter(F.col("source_id").contains(MASK)).withColumn("_ways", signature)
    ways = asked.select(*keys, "_ways", F.length("_ways").alias("_size")).distinct()
    plain = old.withColumn("_size", F.length("source_id")).join(ways, [*keys, "_size"])
    plain = plain.withColumn("_shown", _masked(F.col("source_id"), F.col("_ways"))).select("id", *keys, "_ways", "_shown")
    return _witnesses(plain, asked.withColumn("_shown", F.col("source_id")), [*keys, "_ways", "_shown"])
