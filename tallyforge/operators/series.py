"""Dated series: as-of balances, net worth, cash allocation, backfill.  Windows are partitioned by account, month or series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balance_as_of(snapshots: DataFrame, day: str) -> DataFrame:
    """The last snapshot of each account up to ``day``; a combined aggregate, not a range join."""
    rows = snapshots.filter(F.col("as_of_day") <= F.lit(day).cast("date"))
    return rows.groupBy("account_id").agg(F.max_by("balance", F.struct("as_of_day", "n")).alias("balance"), F.max("as_of_day").alias("as_of_day"))


def net_worth_by_month(snapshots: DataFrame, accounts: DataFrame, rates: DataFrame) -> DataFrame:
    """Sum over accounts of the last known balance at each month's end, in TWD (no rate counts as zero).

    Each snapshot is a change of its account's value from its month on, so months are sums of changes and
    no account is spread over the months in between.
    """
    last = snapshots.groupBy("account_id", F.trunc("as_of_day", "month").alias("month")).agg(F.max_by("balance", F.struct("as_of_day", "n")).alias("balance"))
    before = F.lag("balance").over(Window.partitionBy("account_id").orderBy("month"))
    change = last.withColumn("change", F.col("balance") - F.coalesce(before, F.lit(0)))
    rate = F.when(F.col("currency") == "TWD", 1.0).otherwise(F.coalesce("rate_to_twd", F.lit(0.0)))
    known = accounts.join(rates, "currency", "left").select(F.col("id").alias("account_id"), F.when(F.col("account_type") == "credit", -rate).otherwise(rate).cast("decimal(10,4)").alias("rate"))
    by_month = change.join(known, "account_id").groupBy("month").agg(F.sum((F.col("change") * F.col("rate")).cast("decimal(24,4)")).alias("change"))
    # one row a month: the running sum over all months is small
    total = F.sum("change").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return by_month.select("month", total.cast("double").alias("net_worth"))


def deposits_by_day(snapshots: DataFrame, accounts: DataFrame, rates: DataFrame) -> DataFrame:
    """(day, total): sum of the last known balances of deposits on each day with a snapshot, in TWD; changes are summed, as in :func:`net_worth_by_month`."""
    known = accounts.filter("account_type <> 'credit'").join(rates, "currency", "left").select(F.col("id").alias("account_id"), F.when(F.col("currency") == "TWD", 1.0).otherwise(F.coalesce("rate_to_twd", F.lit(0.0))).cast("decimal(10,4)").alias("rate"))
    last = snapshots.groupBy("account_id", F.col("as_of_day").alias("day")).agg(F.max_by("balance", "n").alias("balance"))
    before = F.lag("balance").over(Window.partitionBy("account_id").orderBy("day"))
    change = last.withColumn("change", F.col("balance") - F.coalesce(before, F.lit(0))).join(known, "account_id")
    by_day = change.groupBy("day").agg(F.sum((F.col("change") * F.col("rate")).cast("decimal(24,4)")).alias("change"))
    # one row a day: the running sum over all days is small
    return by_day.select("day", F.sum("change").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("double").alias("total"))


def allocate_cash(withdrawals: DataFrame, needs: DataFrame, owner: tuple[str, ...] = ()) -> DataFrame:
    """(owner, id, month, amount, allocated, remaining): a month's need takes its withdrawals first to last, the rest the previous month's last to first.

    withdrawals: owner's columns, id, month, day, amount; needs: owner's columns, month, need.
    """
    keys = [*owner, "month"]
    up = Window.partitionBy(*keys).orderBy("day", "id").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("day"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(18,2)")
    part = lambda amount, need, before: F.least(amount, F.greatest(zero, need - F.coalesce(before, zero)))
    pool = withdrawals.groupBy(*keys).agg(F.sum("amount").alias("pool"))
    over = needs.join(pool, keys, "left").withColumn("over", F.greatest(zero, F.col("need") - F.coalesce("pool", zero)))
    over = over.select(*owner, F.date_format(F.add_months(F.to_date(F.concat("month", F.lit("-01"))), -1), "yyyy-MM").alias("month"), "over").filter("over > 0")
    rows = withdrawals.join(needs, keys, "left").join(over, keys, "left")
    rows = rows.withColumn("own", part(F.col("amount"), F.coalesce("need", zero), F.sum("amount").over(up)))
    rows = rows.withColumn("left", F.col("amount") - F.col("own"))
    rows = rows.withColumn("late", part(F.col("left"), F.coalesce("over", zero), F.sum("left").over(down)))
    allocated = F.col("own") + F.col("late")
    return rows.select(*owner, "id", "month", F.col("amount").cast("double").alias("amount"), allocated.cast("double").alias("allocated"), (F.col("amount") - allocated).cast("double").alias("remaining"))


def backfill(transactions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Day-end balance before each account's anchor: the anchor less all that came after.  (account_id, day, balance)"""
    daily = transactions.groupBy("account_id", "day").agg(F.sum("amount").alias("net"))
    rows = daily.join(anchors, "account_id").filter(F.col("day") <= F.col("anchor_day"))
    after = F.sum("net").over(Window.partitionBy("account_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("account_id", "day", (F.col("anchor") - F.coalesce(after, F.lit(0))).cast("double").alias("balance"))


def statement_periods(bills: DataFrame) -> DataFrame:
    """Each bill with the closing date before it: its period is (previous_closing, closing_date]."""
    return bills.withColumn("previous_closing", F.lag("closing_date").over(Window.partitionBy("account_id").orderBy("billing_period")))


def bill_status(bills: DataFrame, payments: DataFrame) -> DataFrame:
    """Paid amount and status from the payments in (closing, next closing].

    Bills and payments of an account are laid in one order of days, so each payment takes the last closing before it.
    """
    lines = bills.select("account_id", F.col("closing_date").alias("day"), F.lit(1).alias("kind"), "billing_period", F.lit(None).cast("decimal(18,2)").alias("paid"))
    lines = lines.unionByName(payments.select("account_id", "day", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("billing_period"), F.col("amount").alias("paid")))
    w = Window.partitionBy("account_id").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    paid = lines.withColumn("billing_period", F.last("billing_period", True).over(w)).filter("kind = 0 and billing_period is not null").groupBy("account_id", "billing_period").agg(F.sum("paid").alias("paid"))
    out = bills.join(paid, ["account_id", "billing_period"], "left").withColumn("paid", F.coalesce("paid", F.lit(0)))
    status = F.when(F.col("paid") >= F.col("statement_amount"), "paid").when(F.col("paid") > 0, "partial").otherwise("unpaid")
    remaining = F.greatest(F.lit(0).cast("decimal(18,2)"), F.col("statement_amount") - F.col("paid"))
    return out.select("account_id", "billing_period", F.col("statement_amount").cast("double").alias("statement_amount"), F.col("paid").cast("double").alias("paid"), remaining.cast("double").alias("remaining"), status.alias("status"))


def carry_forward(points: DataFrame, key: str, until: str) -> DataFrame:
    """(key, month, value): each monthly value holds until the key's next one, the last until the month ``until``.

    points: key, month (a first day), value.  A point is exploded over its own months, so nothing is joined to a calendar.
    """
    following = F.lead("month").over(Window.partitionBy(key).orderBy("month"))
    stop = F.coalesce(F.add_months(following, -1), F.greatest(F.col("month"), F.lit(until).cast("date")))
    return points.withColumn("_stop", stop).select(key, F.explode(F.sequence("month", "_stop", F.expr("interval 1 month"))).alias("month"), "value")


def comparisons(points: DataFrame, key: str) -> DataFrame:
    """(key, period, previous_day, previous_value, change, percent) of a series' last point with the latest at or before a day, a week and a calendar month earlier.

    points: key, day, value, one row a day and key.  Percent is null from zero.
    """
    rows = points.withColumn("_last", F.max("day").over(Window.partitionBy(key)))
    targets = {"day": F.date_sub("_last", 1), "week": F.date_sub("_last", 7), "month": F.add_months("_last", -1)}
    found = rows.groupBy(key).agg(F.max_by("value", "day").alias("_now"), *(F.max(F.when(F.col("day") <= at, F.struct("day", "value"))).alias(p) for p, at in targets.items()))
    each = F.array(*(F.struct(F.lit(p).alias("period"), F.col(p).alias("before")) for p in targets))
    out = found.select(key, "_now", F.inline(each)).filter("before is not null")
    change = F.col("_now") - F.col("before.value")
    percent = F.when(F.col("before.value") != 0, change.cast("double") / F.abs(F.col("before.value")).cast("double") * 100)
    return out.select(key, "period", F.col("before.day").alias("previous_day"), F.col("before.value").cast("double").alias("previous_value"), change.cast("double").alias("change"), percent.alias("percent"))


def issuer_bills(bills: DataFrame) -> DataFrame:
    """One bill for each issuer and period: in TWD if any is, else in the smallest currency code; null-aware sums of sizes, earliest due, latest closing.

    bills: issuer, billing_period, currency, statement_amount, paid_amount, is_paid, due_date, closing_date.
    """
    size = lambda c: F.sum(F.abs(c)).alias(c)
    by = bills.groupBy("issuer", "billing_period", "currency").agg(size("statement_amount"), size("paid_amount"), F.min(F.coalesce("is_paid", F.lit(False))).alias("is_paid"), F.min("due_date").alias("due_date"), F.max("closing_date").alias("closing_date"))
    rest = [c for c in by.columns if c not in ("issuer", "billing_period")]
    best = F.min_by(F.struct(*rest), F.struct(F.col("currency") != "TWD", "currency")).alias("b")
    return by.groupBy("issuer", "billing_period").agg(best).select("issuer", "billing_period", "b.*")


def estimated_statements(bills: DataFrame, lines: DataFrame) -> DataFrame:
    """(account_id, billing_period, estimate): net charges in (previous closing, closing], at least zero; null if one of them has no rate.

    bills: account_id, billing_period, closing_date; lines: account_id, day, twd (null without a rate).  Both are
    laid in one order of days and a line takes the next closing, as in :func:`bill_status`.
    """
    w = Window.partitionBy("account_id").orderBy("closing_date")
    known = bills.select("account_id", "closing_date", "billing_period", F.lag("closing_date").over(w).isNotNull().alias("bounded"))
    marks = known.select("account_id", F.col("closing_date").alias("day"), F.lit(1).alias("kind"), F.when(F.col("bounded"), F.col("billing_period")).otherwise("").alias("billing_period"), F.lit(None).cast("decimal(18,2)").alias("twd"))
    rows = lines.select("account_id", "day", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("billing_period"), F.col("twd").cast("decimal(18,2)").alias("twd")).unionByName(marks)
    ahead = Window.partitionBy("account_id").orderBy("day", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    taken = rows.withColumn("billing_period", F.first("billing_period", True).over(ahead)).filter("kind = 0 and billing_period <> ''")
    sums = taken.groupBy("account_id", "billing_period").agg(F.sum(-F.col("twd")).alias("net"), F.bool_or(F.col("twd").isNull()).alias("unknown"))
    out = known.filter("bounded").join(sums, ["account_id", "billing_period"], "left")
    zero = F.lit(0).cast("decimal(18,2)")
    return out.select("account_id", "billing_period", F.when(~F.coalesce("unknown", F.lit(False)), F.greatest(zero, F.coalesce("net", zero))).cast("double").alias("estimate"))


def replace_derived(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """Snapshots after a rebuild: real ones stay as they are, derived ones are those planned.  Both: id, account_id, as_of_day, balance, derived."""
    real = existing.filter("not derived")
    return real.unionByName(planned.join(real.select("id"), "id", "left_anti").select(*real.columns))


def day_end_balances(rows: DataFrame, flags: dict[str, Column] | None = None) -> DataFrame:
    """(account_id, day, balance, net, flags): the running balance no other row of the day starts from, if one is; else the last row's.

    rows: account_id, day, n (order), amount, running (balance after the row); ``flags``: more aggregates of a day's rows.  Starts are counted by
    value, so rows of a day are not compared in pairs.  A row is shuffled once, and stands there for its start and its end.
    """
    value = lambda x, is_end: F.struct(x.cast("decimal(18,2)").alias("value"), F.lit(is_end).alias("is_end"))
    running = F.col("running")
    lined = rows.repartition("account_id", "day").withColumn("_at", F.explode(F.array(value(running, True), value(running - F.col("amount"), False)))).select("*", "_at.*").drop("_at")
    w = Window.partitionBy("account_id", "day", "value")
    marked = lined.withColumn("starts", F.count_if(~F.col("is_end") & F.col("value").isNotNull()).over(w)).filter("is_end")
    end = F.col("starts") - F.when(F.col("amount") == 0, 1).otherwise(0) <= 0
    out = marked.groupBy("account_id", "day").agg(F.count_if(end).alias("ends"), F.min(F.when(end, running)).alias("one"), F.max_by("running", "n").alias("last"), F.sum("amount").alias("net"), *(x.alias(c) for c, x in (flags or {}).items()))
    return out.select("account_id", "day", F.when(F.col("ends") == 1, F.col("one")).otherwise(F.col("last")).alias("balance"), "net", *(flags or {}))


def opening_balances(day_ends: DataFrame) -> DataFrame:
    """(account_id, first_day, opening): the balance before the first day, computed back from its end."""
    return day_ends.groupBy("account_id").agg(F.min("day").alias("first_day"), F.min_by(F.col("balance") - F.col("net"), "day").alias("opening"))


def filled_balances(day_ends: DataFrame, until: str) -> DataFrame:
    """(account_id, day, balance) of every day from the one before the first to ``until``: a day's end balance holds until the next one.

    Each day's end is exploded over the days it holds, so nothing is joined to a calendar; the first day back is the opening balance.
    """
    w = Window.partitionBy("account_id").orderBy("day")
    stop = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.greatest(F.col("day"), F.lit(until).cast("date")))
    held = day_ends.withColumn("_stop", stop).select("account_id", F.explode(F.sequence("day", "_stop")).alias("day"), "balance")
    first = opening_balances(day_ends).select("account_id", F.date_sub("first_day", 1).alias("day"), F.col("opening").alias("balance"))
    return held.unionByName(first)


def held_until(rows: DataFrame, key: str, until: str) -> DataFrame:
    """(key, day, balance) of every day from a key's first to ``until``: a balance holds until the next one.  Each is exploded over its own days."""
    following = F.lead("day").over(Window.partitionBy(key).orderBy("day"))
    stop = F.coalesce(F.date_sub(following, 1), F.greatest(F.col("day"), F.lit(until).cast("date")))
    return rows.withColumn("_stop", stop).select(key, F.explode(F.sequence("day", "_stop")).alias("day"), "balance")


def history_in_twd(history: DataFrame, assets: DataFrame, rates: DataFrame) -> DataFrame:
    """(id, day, value): manual values converted by their asset's currency, zero without a rate; other sources are in TWD.

    history: id, day, source, asset_type (the asset's id if manual), net_worth; assets: id, currency.
    """
    a = assets.select(F.col("id").alias("asset_type"), F.lit("manual").alias("source"), "currency")
    rows = history.join(a, ["asset_type", "source"], "left").join(rates, "currency", "left")
    value = F.col("net_worth").cast("double")
    return rows.select("id", "day", F.when((F.col("source") != "manual") | (F.col("currency") == "TWD"), value).when(F.col("rate_to_twd").isNotNull(), value * F.col("rate_to_twd")).otherwise(0.0).alias("value"))


def upsert_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """Points by (source, asset_type, day); the new value wins."""
    keys = ["source", "asset_type", "day"]
    both = old.join(new.withColumnRenamed("value", "_new"), keys, "full")
    return both.select(*keys, F.coalesce("_new", "value").alias("value"))


def issuer_totals(bills: DataFrame) -> DataFrame:
    """For each issuer the statement and remaining totals in TWD, and the unpaid bill due next.

    bills: issuer, account_id, currency, statement_amount, remaining, status, due_date.
    """
    twd = lambda c: F.coalesce(F.sum(F.when(F.col("currency") == "TWD", F.col(c))), F.lit(0)).cast("double").alias(c)
    next_due = F.min(F.when((F.col("status") != "paid") & F.col("due_date").isNotNull(), F.struct("due_date", "account_id"))).alias("n")
    return bills.groupBy("issuer").agg(twd("statement_amount"), twd("remaining"), next_due).select("issuer", "statement_amount", "remaining", F.col("n.due_date").alias("next_due"), F.col("n.account_id").alias("next_account"))


def latest_manual_values(history: DataFrame) -> DataFrame:
    """(asset_id, day, value): the latest value of each manual asset; of one day the greatest id.  history: id, asset_id, day, value."""
    return history.groupBy("asset_id").agg(F.max("day").alias("day"), F.max_by("value", F.struct("day", "id")).alias("value"))


def asset_rows(accounts: DataFrame, positions: DataFrame, manual: DataFrame, rates: DataFrame) -> DataFrame:
    """(kind, institution, currency, amount, twd): deposits, cards, investments and manual assets in one table; zero without a rate.

    accounts: institution, account_type, currency, balance; positions: currency, amount; manual: currency, amount.
    """
    deposit = F.when(F.col("account_type") == "credit", "card").otherwise("deposit")
    rows = accounts.select(deposit.alias("kind"), "institution", "currency", F.col("balance").alias("amount"))
    for kind, df in (("investment", positions), ("manual", manual)):
        rows = rows.unionByName(df.select(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("institution"), "currency", "amount"))
    rate = F.when(F.col("currency") == "TWD", 1.0).otherwise(F.coalesce("rate_to_twd", F.lit(0.0)))
    return rows.join(rates, "currency", "left").select("kind", "institution", "currency", "amount", "rate_to_twd", (F.coalesce("amount", F.lit(0)).cast("double") * rate).cast("decimal(24,6)").alias("twd"))


def asset_summary(rows: DataFrame) -> DataFrame:
    """One row: bank, investment and manual totals, card debt, gross assets, net worth, currencies without a rate."""
    total = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("twd"))), F.lit(0)).cast("double")
    lacks = (F.col("currency") != "TWD") & F.col("rate_to_twd").isNull() & (F.coalesce("amount", F.lit(0)) != 0)
    return rows.agg(
        total("deposit").alias("bank_total"), total("investment").alias("investment_total"), total("manual").alias("manual_total"), (-total("card")).alias("card_debt"), total("deposit", "investment", "manual").alias("gross_assets"),
        total("deposit", "investment", "manual", "card").alias("net_worth"), F.array_join(F.array_sort(F.collect_set(F.when(lacks, F.col("currency")))), ",").alias("missing_currencies"),
    )


def institution_totals(rows: DataFrame) -> DataFrame:
    """(institution, asset_total, debt_total, foreign_currencies, unknown_card) of each institution."""
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("twd"))), F.lit(0)).cast("double")
    foreign = F.array_join(F.array_sort(F.collect_set(F.when(F.col("currency") != "TWD", F.col("currency")))), ",")
    return rows.filter("institution is not null").groupBy("institution").agg(total("deposit").alias("asset_total"), (-total("card")).alias("debt_total"), foreign.alias("foreign_currencies"), F.bool_or((F.col("kind") == "card") & F.col("amount").isNull()).alias("unknown_card"))


def currency_totals(rows: DataFrame) -> DataFrame:
    """(currency, total) of assets in currencies with a rate, positive sums only."""
    known = rows.filter((F.col("kind") != "card") & ((F.col("currency") == "TWD") | F.col("rate_to_twd").isNotNull()))
    return known.groupBy("currency").agg(F.sum("twd").cast("double").alias("total")).filter("total > 0")


def date_bounds(snapshots: DataFrame) -> DataFrame:
    """First and last day of all snapshots, and of derived ones."""
    bounds = lambda test, name: [F.min(F.when(test, F.col("as_of_day"))).alias(f"first_{name}"), F.max(F.when(test, F.col("as_of_day"))).alias(f"last_{name}")]
    return snapshots.agg(*bounds(F.lit(True), "day"), *bounds(F.col("derived"), "derived_day"))
