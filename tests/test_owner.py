"""Cash allocated for several owners at once equals each owner's by itself."""

import random
from datetime import date

from pyspark.sql import functions as F

from tallyforge.operators import series


def test_cash_by_owner(spark):
    rng = random.Random(4)
    owner = lambda: rng.choice(["hot", "hot", "a", "b"])
    months = ["2024-01", "2024-02", "2024-03"]
    rows = [(owner(), f"w{k}", (m := rng.choice(months)), date(2024, int(m[-2:]), rng.randint(1, 28)), rng.randint(1, 50)) for k in range(80)]
    needs = [(o, m, rng.randint(0, 900)) for o in ("hot", "a", "b") for m in months if rng.random() < 0.8]
    money = F.col("amount").cast("decimal(18,2)").alias("amount")
    taken = spark.createDataFrame(rows, "owner string, id string, month string, day date, amount int").select("owner", "id", "month", "day", money)
    asked = spark.createDataFrame(needs, "owner string, month string, need int").withColumn("need", F.col("need").cast("decimal(18,2)"))
    whole = {tuple(r) for r in series.allocate_cash(taken, asked, ("owner",)).collect()}
    apart = {(o, *tuple(r)) for o in ("hot", "a", "b") for r in series.allocate_cash(taken.filter(F.col("owner") == o), asked.filter(F.col("owner") == o).drop("owner")).collect()}
    assert whole == apart and any(r[4] > 0 for r in whole) and any(r[5] > 0 for r in whole)
