"""Bounded training samples of labelled rows, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import fold, stored


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int, test: int, most_bytes: int) -> DataFrame:
    """(doc_id, text, label, fold) of at most ``rows`` labels, least hash of doc_id first, while the texts before have less than ``most_bytes``.

    Texts that take part do so whole, so the sample is bounded by ``most_bytes`` and one text.

    Rows whose crc32 fold is ``test`` never take part.  A label that is repeated or contradicts itself
    counts once, by its greatest value; of rows that share an id the one with the smallest text counts, so there are at
    most ``rows`` rows.  The id set is no longer than that, so it may be broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).withColumn("fold", fold("doc_id", modulus))
    known = known.filter(F.col("fold") != test).groupBy("doc_id", "fold").agg(F.max(label).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "fold", "label").agg(F.min("text").alias("text"))
    sample = stored(sample, "sample")
    # one task, a narrow row for each of the sample's texts
    earlier = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sample.select("doc_id", F.sum(F.octet_length("text").cast("long")).over(earlier).alias("before"))
    within = sizes.filter((F.col("before") < most_bytes) | F.col("before").isNull()).select("doc_id")
    return sample.join(F.broadcast(within), "doc_id", "left_semi")
