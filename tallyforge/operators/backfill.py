"""Balances of deposit accounts before their first real snapshot, day by day, with a report for each account.

An account whose connector lists all its transactions is walked back from its anchor, its earliest real snapshot: the balance of a day is the
anchor less what came after.  Where every transaction tells the balance after it, those balances are chained forward as well; the
forward value counts on days on which both chains meet within ``TOLERANCE``, else the anchor wins.  An account whose
transactions may be incomplete holds its anchor's balance back to the same first day as all others.

Transactions become a row an account and day before anything is ordered, so a window over one account sees its days only, however
many transactions it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import series
from tallyforge.sources.durable import stored

# Connectors whose deposit transactions are complete, and one whose may not be; names of the balance in payloads.
TRUSTED = ("esun", "cathaybk", "obank", "kgibank", "skbank", "firstbank")
INCOMPLETE = ("ctbc",)
BALANCE_KEYS = ("balance", "balanceAfter", "balanceAmt", "Balance", "acctBal")
TOLERANCE = 1

_MONEY = "decimal(18,2)"


def _number(text: Column) -> Column:
    """A plain decimal number, thousands separators allowed."""
    text = F.trim(F.regexp_replace(text, ",", ""))
    return F.when(text.rlike(r"^-?[0-9]+([.][0-9]+)?$"), text).try_cast(_MONEY)


def running_balance(payload: Column) -> Column:
    """The first key of the payload that holds a number."""
    return F.coalesce(*(_number(F.get_json_object(payload, f"$.{k}")) for k in BALANCE_KEYS))


def _prepared(transactions: DataFrame) -> DataFrame:
    """(account_id, day, at, place, amount, currency, running); rows without a day are left out."""
    at = F.when(F.length("authorized_at") > 10, F.unix_micros(F.try_to_timestamp("authorized_at")))
    number = _number(F.coalesce(F.get_json_object("raw_payload", "$.sequenceNumber"), F.get_json_object("raw_payload", "$.defaultSeq")))
    rows = transactions.select(
        "account_id", C.transaction_day(F.col("authorized_at"), F.col("posted_date")).alias("day"), at.alias("at"), F.struct(at.alias("at"), number.alias("number"), F.col("id").alias("id")).alias("place"),
        F.col("amount").cast(_MONEY).alias("amount"), F.coalesce(F.nullif("currency", F.lit("")), F.lit("TWD")).alias("currency"), running_balance(F.col("raw_payload")).alias("running"),
    )
    return rows.filter("day is not null")


def _sorted_out(accounts: DataFrame) -> DataFrame:
    """Accounts with ``way`` (walk, carry or null), the reason why not, and the anchor's day and time."""
    anchored = F.col("anchor_at").isNotNull()
    trusted = F.col("connector_id").isin(*TRUSTED) & ~F.col("connector_id").isin(*INCOMPLETE)
    trusted = F.coalesce(trusted, F.lit(False))
    reason = F.when(anchored, None).when(trusted, "no_real_snapshot").when(F.col("connector_id").isin(*INCOMPLETE), "deposit_details_may_be_incomplete").otherwise("connector_without_deposit_details")
    at = F.try_to_timestamp("anchor_at")
    return accounts.select(
        "id", "connector_id", "account_last4", "opened_date", F.col("anchor_balance").cast(_MONEY).alias("anchor"), F.coalesce(F.nullif("anchor_currency", F.lit("")), F.lit("TWD")).alias("currency"),
        F.when(anchored, F.when(trusted, "walk").otherwise("carry")).alias("way"), reason.alias("reason"), F.unix_micros(at).alias("anchor_time"), C.transaction_day(F.col("anchor_at"), F.col("anchor_at")).alias("anchor_day"),
    )


def _daily(transactions: DataFrame, walked: DataFrame) -> DataFrame:
    """(account_id, day, net, balance at its end, mixed, told): what happened up to the anchor."""
    own = walked.select(F.col("id").alias("account_id"), F.col("currency").alias("own"), "anchor_day", "anchor_time")
    rows = _prepared(transactions).join(own, "account_id")
    # a transaction of the anchor's day that has no time counts as before it
    rows = rows.filter((F.col("day") < F.col("anchor_day")) | (F.col("day") == F.col("anchor_day")) & (F.col("at").isNull() | (F.col("at") <= F.col("anchor_time"))))
    rows = rows.select("account_id", "day", F.col("place").alias("n"), "amount", "running", (F.col("currency") != F.col("own")).alias("mixed"))
    return series.day_end_balances(rows, {"mixed": F.max("mixed"), "told": F.min(F.col("running").isNotNull())})


def plan(accounts: DataFrame, transactions: DataFrame, months: int) -> tuple[DataFrame, DataFrame]:
    """Balances (account_id, connector_id, day, balance, currency, method) and reports, a row an account.

    accounts: id, connector_id, account_last4, opened_date, anchor_balance, anchor_currency, anchor_at (ISO time; null without a real
    snapshot).  transactions: id, account_id, posted_date, authorized_at, amount, currency, raw_payload.  No day lies more than ``months``
    before the anchor, before the account was opened, or before the first day that any walked account has a transaction.
    """
    # both are needed more than once, and the transactions' texts only for them
    sorted_out = stored(_sorted_out(accounts), "accounts")
    daily = stored(_daily(transactions, sorted_out.filter("way = 'walk'")), "daily")
    of_account = daily.groupBy("account_id").agg(F.max("mixed").alias("mixed"), F.min("told").alias("told"), F.min("day").alias("first_day"))
    known = sorted_out.join(of_account.withColumnRenamed("account_id", "id"), "id", "left")
    walks = (F.col("way") == "walk") & ~F.coalesce("mixed", F.lit(False))
    # one row: the first day of all
    first = known.filter(walks).agg(F.min("first_day").alias("all_from"))
    known = known.crossJoin(F.broadcast(first))
    reason = F.coalesce("reason", F.when(~walks & (F.col("way") == "walk"), "mixed_currency"), F.when(F.col("all_from").isNull(), "no_transactions"))
    start = F.greatest("all_from", C.subtract_months(F.col("anchor_day"), months), "opened_date")
    known = known.withColumns({"reason": reason, "start": start, "stop": F.date_sub("anchor_day", 1)})
    open_ = known.filter("reason is null and start <= stop")
    asked = open_.select(F.col("id").alias("account_id"), "connector_id", "currency", "way", "anchor", "told", "start", "stop")
    # stretches of days alike: an account's days of transactions and, with no values, the one its range begins with, each up to the next of them; only
    # the balances asked for are a row a day, and these are never shuffled
    lined = daily.select("account_id", "day", "net", "balance").unionByName(asked.select("account_id", F.col("start").alias("day")), allowMissingColumns=True)
    # the beginning of a range comes before what happened on its day
    turn = Window.partitionBy("account_id").orderBy("day", F.col("net").asc_nulls_first())
    upto, throughout = (turn.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    opening = F.first(F.col("balance") - F.col("net"), True).over(throughout)
    net = lambda w: F.coalesce(F.sum("net").over(w), F.lit(0).cast(_MONEY))
    lined = lined.withColumns({"after": net(throughout) - net(upto), "forward": F.coalesce(F.last("balance", True).over(upto), opening), "next": F.lead("day").over(turn)})
    found = asked.join(lined, "account_id").withColumns({"from": F.greatest("day", "start"), "to": F.least(F.date_sub("next", 1), "stop")}).filter("from <= to")
    walk = F.col("way") == "walk"
    backward = F.col("anchor") - F.when(walk, F.col("after")).otherwise(F.lit(0).cast(_MONEY))
    forward = F.when(F.col("told") & walk, F.col("forward"))
    meets = F.abs(forward - backward) <= TOLERANCE
    method = F.when(F.col("way") == "carry", "carry_back").when(meets, "running_balance").otherwise("reverse_sum")
    found = found.select("account_id", "connector_id", "currency", "from", "to", method.alias("method"), F.floor(F.when(meets, forward).otherwise(backward).cast("double") + 0.5).alias("balance"), F.when(forward.isNotNull(), ~meets).alias("off"))
    balances = found.select("account_id", "connector_id", F.explode(F.sequence("from", "to")).alias("day"), "balance", "currency", "method")
    long = F.datediff("to", "from").cast("long") + 1
    total = lambda test, name: F.coalesce(F.sum(F.when(test, long)), F.lit(0).cast("long")).alias(name)
    count = lambda m: total(F.col("method") == m, m)
    sums = found.groupBy(F.col("account_id").alias("id")).agg(
        F.sum(long).alias("days"), count("running_balance"), count("reverse_sum"), count("carry_back"), total(F.col("off").isNotNull(), "compared_days"), total(F.col("off"), "mismatch_days"),
        F.min(F.when(F.col("off"), F.col("from"))).alias("first_mismatch"), F.max(F.when(F.col("off"), F.col("to"))).alias("last_mismatch"),
    )
    numbers = ("days", "running_balance", "reverse_sum", "carry_back", "compared_days", "mismatch_days")
    reports = known.join(sums, "id", "left").select(
        F.col("id").alias("account_id"), "connector_id", "account_last4", F.when(F.col("reason").isNull(), "backfilled").otherwise("skipped").alias("status"), "reason",
        F.when(F.col("days") > 0, F.col("start")).alias("from_day"), F.when(F.col("days") > 0, F.col("stop")).alias("to_day"), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), "first_mismatch", "last_mismatch",
    )
    return balances, reports
