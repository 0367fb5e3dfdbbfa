"""Statements that give amounts without a sign: directions from balances that stand beside each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 0.005


def directions(rows: DataFrame, statement: list[str]) -> DataFrame:
    """(statement, place, flag, direction): 1 into the account, -1 out of it, null where balances do not tell.

    rows: the columns ``statement``, place (the row's number in its source), at (time as text, null where the row could not be read), amount (without
    a sign), balance (after the row, or null), flag (boolean, of unknown meaning, or null).

    A row is told by its own and the balance before it, so one has to know whether the newest or the oldest comes first.  The first and the last
    time say so; if they are the same, both orders are tried and the one that explains every pair counts, if only one does.  Each row meets its
    neighbours in one window; what a whole statement says is one grouped row.
    """
    w = Window.partitionBy(*statement).orderBy("place")
    read = F.col("at").isNotNull() & F.col("balance").isNotNull()

    def pair(other) -> tuple[Column, Column]:
        """Whether the pair with a neighbour that is older explains the row, and which way; null if there is no pair."""
        delta = F.when(read & other("at").isNotNull(), F.col("balance") - other("balance"))
        fits = F.abs(F.abs(delta) - F.col("amount")) <= TOLERANCE
        return fits, F.when(fits, F.when(delta > 0, 1).otherwise(-1))

    newest, newest_way = pair(lambda c: F.lead(c).over(w))
    oldest, oldest_way = pair(lambda c: F.lag(c).over(w))
    told = rows.withColumns({"_n": newest, "_nw": newest_way, "_o": oldest, "_ow": oldest_way})
    known = F.when(F.col("at").isNotNull(), F.col("place"))
    whole = lambda c: F.coalesce(F.min(c), F.lit(False)).alias(f"{c}_all")
    of = told.groupBy(*statement).agg(whole("_n"), whole("_o"), F.min_by("at", known).alias("_first"), F.max_by("at", known).alias("_last"))
    tied = F.when(F.col("_n_all") & ~F.col("_o_all"), "newest").when(F.col("_o_all") & ~F.col("_n_all"), "oldest")
    order = F.when(F.col("_first") > F.col("_last"), "newest").when(F.col("_first") < F.col("_last"), "oldest").otherwise(tied)
    found = told.join(of.select(*statement, order.alias("_order")), statement, "left")
    return found.select(*statement, "place", "flag", F.when(F.col("_order") == "newest", F.col("_nw")).when(F.col("_order") == "oldest", F.col("_ow")).alias("direction"))


def with_flags(found: DataFrame, learner: list[str]) -> DataFrame:
    """``found`` with directions also where only the flag tells: what the flag means is learned for each ``learner`` from rows that have both, if they all agree."""
    into = F.when(F.col("flag"), F.col("direction")).otherwise(-F.col("direction"))
    evidence = found.filter("flag is not null and direction is not null").groupBy(*learner).agg(F.min(into).alias("_low"), F.max(into).alias("_high"))
    learned = evidence.filter("_low = _high").select(*learner, F.col("_low").alias("_means"))
    rows = found.join(learned, learner, "left")
    return rows.withColumn("direction", F.coalesce("direction", F.when(F.col("flag"), F.col("_means")).otherwise(F.when(~F.col("flag"), -F.col("_means"))))).drop("_means")
