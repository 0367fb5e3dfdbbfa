"""The deposit history as a stored series, a partition a day: rebuilt as a whole or carried on day by day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import series

POINT = "connector_id string, value double, day date"


def points(snapshots: DataFrame, accounts: DataFrame, rates: DataFrame, since: str, until: str) -> DataFrame:
    """(connector_id, value, day): what a connector's accounts hold in TWD on each day from ``since`` to ``until``; a balance holds until the next one.

    snapshots: account_id, day, balance, one an account and day; accounts: id, connector_id, currency.  Of the balances before ``since`` only the last of
    each account is read on, so a point of one day costs one grouped pass however long the history is.
    """
    first, last = F.lit(since).cast("date"), F.lit(until).cast("date")
    known = snapshots.filter(F.col("day") <= last)
    before = known.filter(F.col("day") <= first).groupBy("account_id").agg(F.max_by("balance", "day").alias("balance")).withColumn("day", first)
    inside = known.filter(F.col("day") > first).select("account_id", "balance", "day")
    held = series.held_until(before.unionByName(inside), "account_id", until)
    of = accounts.select(F.col("id").alias("account_id"), "connector_id", "currency")
    twd = C.to_twd(F.col("balance"), F.col("currency"), F.col("rate_to_twd"))
    rows = held.join(of, "account_id").join(rates, "currency", "left").withColumn("twd", twd.cast("decimal(24,6)"))
    return rows.groupBy("connector_id", "day").agg(C.cents(F.sum("twd")).alias("value")).filter("value is not null").select("connector_id", "value", "day")


def write(found: DataFrame, path: str) -> None:
    """Replace the days that ``found`` has; other days keep their files."""
    found.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def last_day(spark: SparkSession, path: str) -> date | None:
    """The last day of a stored series, from its partitions."""
    return spark.read.schema(POINT).parquet(path).agg(F.max("day")).first()[0]


def carry_on(snapshots: DataFrame, accounts: DataFrame, rates: DataFrame, path: str, today: str) -> int:
    """Add the days after the series' last one up to ``today``; how many those are."""
    have = last_day(snapshots.sparkSession, path)
    if have is None or have >= date.fromisoformat(today):
        return 0
    since = have + timedelta(days=1)
    write(points(snapshots, accounts, rates, str(since), today), path)
    return (date.fromisoformat(today) - have).days
