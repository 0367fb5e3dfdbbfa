"""Pending-to-posted lifecycle as a stream: each micro-batch is merged into a ledger table and leaves a change feed.

The ledger lies in ``BUCKETS`` buckets of ids.  A batch reads and writes the buckets that its rows fall in, under its own number, and a manifest that says
which number holds each bucket; all others stay as they are.  A batch that is replayed after a failure starts from the manifest
before it and writes the same again.  Bucket versions that neither the last manifest nor the one before it names are removed.
``latest`` reads the last version.  Event-time windows are an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.ingest import last_of_each, merge_transactions
from tallyforge.sources.durable import complete_numbers, remove

FIELDS = "id string, status string, amount decimal(18,2), description string, transfer_peer_id string, authorized_at string"
BUCKETS = 64


def _bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))


def _manifest(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, int]:
    """Bucket to version, as the last manifest (before a number) says; a row a bucket."""
    have = [k for k in complete_numbers(spark, f"{folder}/manifest") if before is None or k < before]
    return {r.bucket: r.version for r in spark.read.parquet(f"{folder}/manifest/{have[-1]}").collect()} if have else {}


def _read(spark: SparkSession, folder: str, manifest: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/ledger/{version}/bucket={bucket}" for bucket, version in sorted(manifest.items())]
    return spark.read.schema(FIELDS).parquet(*paths) if paths else spark.createDataFrame([], FIELDS)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger as the last batch left it."""
    return _read(spark, folder, _manifest(spark, folder))


def changes(old: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, kind): added, pending or posted."""
    was = old.select("id", F.col("status").alias("was"))
    rows = merged.join(was, "id", "left")
    kind = F.when(F.col("was").isNull() & (F.col("status") == "pending"), "pending").when(F.col("was").isNull(), "added").when((F.col("was") == "pending") & (F.col("status") == "posted"), "posted")
    return rows.select("id", kind.alias("kind")).filter("kind is not null")


def promote(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Merge one micro-batch (FIELDS and ordinal) into the ledger and write its changes."""
    spark = batch.sparkSession
    before = _manifest(spark, folder, batch_id)
    earlier = [k for k in complete_numbers(spark, f"{folder}/manifest") if k < batch_id]
    if len(earlier) > 1:
        # the last batch is committed, so what it replaced is read no more
        gone = _manifest(spark, folder, earlier[-1])
        for bucket, version in gone.items():
            if before.get(bucket) != version:
                remove(spark, f"{folder}/ledger/{version}/bucket={bucket}")
    staged = last_of_each(batch, "id", "ordinal").drop("ordinal")
    touched = [r.bucket for r in _bucket(staged.select("id")).select("bucket").distinct().collect()]  # BUCKETS rows at most
    old = _read(spark, folder, {b: v for b, v in before.items() if b in touched})
    _bucket(merge_transactions(old, staged)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/ledger/{batch_id}")
    after = before | {b: batch_id for b in touched}
    changes(old, _read(spark, folder, {b: batch_id for b in touched})).write.mode("overwrite").parquet(f"{folder}/changes/{batch_id}")
    spark.createDataFrame(sorted(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{batch_id}")


def run(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Drain ``stream`` (FIELDS and ordinal) into buckets under ``folder``/ledger and feeds under ``folder``/changes."""
    stream.writeStream.foreachBatch(lambda batch, batch_id: promote(batch, batch_id, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, lateness: str = "14 days", width: str = "1 day") -> DataFrame:
    """Extension: totals per tumbling window and type, with a watermark for late rows."""
    rows = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
