"""Week review, monthly budget and bill evaluation over spending entries (:func:`tallyforge.operators.items.spending` with merchants)."""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as C

# Weeks to compare with and their least number, entries of each list, days that may lack data.
BASELINE_WEEKS, LEAST_WEEKS = 8, 2
INCREASES, LARGEST, NEW_MERCHANTS, LARGE_MERCHANTS = 3, 5, 5, 8
LARGE_LEAST, RECENT_DAYS = 1000, 3


def _sum(test: Column, value: Column | str = "amount") -> Column:
    return C.cents(F.coalesce(F.sum(F.when(test, F.col(value) if isinstance(value, str) else value)), F.lit(0)))


def _days(start: str, n: int) -> str:
    return str(datetime.date.fromisoformat(start) + datetime.timedelta(days=n))


class Week:
    """A week and the days of it that have passed; an open week is compared with the same weekdays only."""

    def __init__(self, start: str, today: str):
        self.start, self.today, self.end = start, today, _days(start, 6)
        self.complete = self.end < today
        passed = (datetime.date.fromisoformat(today) - datetime.date.fromisoformat(start)).days + 1
        self.elapsed = 7 if self.complete else max(1, passed)
        since = max(_days(today, 1 - RECENT_DAYS), start)
        self.unsure_from = since if _days(today, 1 - RECENT_DAYS) <= self.end else None


def _placed(entries: DataFrame, week: Week) -> DataFrame:
    """Entries with ``ago``, the weeks back from the week (0: itself), and whether they lie in the days to compare."""
    back = F.floor(F.datediff(F.lit(week.end).cast("date"), F.col("day")) / 7).cast("int")
    at = 6 - F.pmod(F.datediff(F.lit(week.end).cast("date"), F.col("day")), F.lit(7))
    return entries.withColumns({"ago": back, "same": at < week.elapsed})


def past_weeks(entries: DataFrame, week: Week) -> DataFrame:
    """(ago, total) of the weeks that count as baseline: those whose first or second day the data reaches back to; weeks without entries are 0."""
    first = entries.agg(F.min("day").alias("_first"))
    weeks = entries.sparkSession.range(1, BASELINE_WEEKS + 1).select(F.col("id").cast("int").alias("ago"))
    weeks = weeks.join(first, F.col("_first") <= F.date_add(F.date_sub(F.lit(week.start).cast("date"), F.col("ago") * 7), F.lit(1))).select("ago")  # one row beside eight
    sums = _placed(entries, week).filter(F.col("same") & F.col("ago").between(1, BASELINE_WEEKS)).groupBy("ago").agg(C.cents(F.sum("amount")).alias("total"))
    return weeks.join(sums, "ago", "left").select("ago", F.coalesce("total", F.lit(0.0)).alias("total"))


def week_review(entries: DataFrame, week: Week) -> DataFrame:
    """One row: total to the same weekday, pending amount, baseline weeks and median, difference, completeness.

    entries: id, day, amount (cents), category_id, merchant_key, title, pending.
    """
    own = entries.filter(F.col("day").between(F.lit(week.start).cast("date"), F.lit(week.end).cast("date")))
    same = F.col("day") < F.lit(_days(week.start, week.elapsed)).cast("date")
    found = own.agg(_sum(same).alias("total"), _sum(F.col("pending")).alias("pending_amount"))
    base = past_weeks(entries, week).agg(F.count(F.lit(1)).alias("baseline_weeks"), F.median("total").alias("_median"))
    median = F.when(F.col("baseline_weeks") >= LEAST_WEEKS, C.cents(F.col("_median")))
    out = found.join(base, F.lit(True)).select("total", "pending_amount", "baseline_weeks", median.alias("baseline_median"))  # one row each
    return out.withColumns({"difference": C.cents(F.col("total") - F.col("baseline_median")), "elapsed_days": F.lit(week.elapsed), "complete": F.lit(week.complete), "unsure_from": F.lit(week.unsure_from).cast("date")})


def week_days(entries: DataFrame, week: Week) -> DataFrame:
    """(day, amount) of the seven days, also those without entries."""
    days = entries.sparkSession.range(7).select(F.date_add(F.lit(week.start).cast("date"), F.col("id").cast("int")).alias("day"))
    return days.join(entries.groupBy("day").agg(C.cents(F.sum("amount")).alias("amount")), "day", "left").select("day", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def category_increases(entries: DataFrame, week: Week) -> DataFrame:
    """(category_id, amount, baseline, delta): the categories that grew most over their mean of the baseline weeks; none without a baseline."""
    weeks = past_weeks(entries, week).select(F.col("ago").alias("_ago"))
    rows = _placed(entries, week).filter("same").join(weeks, F.col("ago") == F.col("_ago"), "left").filter("ago = 0 or _ago is not null")
    by = rows.groupBy("category_id").agg(F.sum(F.when(F.col("ago") == 0, F.col("amount"))).alias("now"), F.coalesce(F.sum(F.when(F.col("ago") > 0, F.col("amount"))), F.lit(0)).alias("past")).filter("now is not null")
    by = by.join(weeks.agg(F.count(F.lit(1)).alias("_n")), F.lit(True)).filter(F.col("_n") >= LEAST_WEEKS)
    base = F.col("past") / F.col("_n")
    out = by.select("category_id", C.cents(F.col("now")).alias("amount"), C.cents(base).alias("baseline"), C.cents(F.col("now") - base).alias("delta")).filter("delta > 0")
    return out.orderBy(F.desc("delta"), "category_id").limit(INCREASES)


def largest_entries(entries: DataFrame, week: Week) -> DataFrame:
    own = entries.filter((F.col("amount") > 0) & F.col("day").between(F.lit(week.start).cast("date"), F.lit(week.end).cast("date")))
    return own.orderBy(F.desc("amount"), "id").limit(LARGEST).select("id", "day", "title", "amount", "category_id", "pending")


def new_merchants(entries: DataFrame, week: Week) -> DataFrame:
    """(merchant_key, amount, entries) of merchants first seen in the week, the greatest sums; none without a baseline."""
    named = entries.filter("merchant_key is not null")
    start = F.lit(week.start).cast("date")
    own = named.filter(F.col("day").between(start, F.lit(week.end).cast("date")))
    fresh = own.join(named.filter(F.col("day") < start).select("merchant_key").distinct(), "merchant_key", "left_anti")
    enough = past_weeks(entries, week).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= LEAST_WEEKS)
    sums = fresh.groupBy("merchant_key").agg(C.cents(F.sum("amount")).alias("amount"), F.count(F.lit(1)).alias("entries"))
    return sums.join(enough, F.lit(True)).drop("_n").orderBy(F.desc("amount"), "merchant_key").limit(NEW_MERCHANTS)


def fixed_merchants(entries: DataFrame, decisions: DataFrame, month: str, history: list[str]) -> DataFrame:
    """(merchant_key, kind, expected, expected_source, paid) of merchants judged monthly or annual.

    Expected is the user's amount, else for monthly ones the median of the history months with entries.  decisions: merchant_key,
    kind, expected_amount; entries: month, merchant_key, amount.
    """
    monthly = entries.filter(F.col("merchant_key").isNotNull() & F.col("month").isin([month, *history])).groupBy("merchant_key", "month").agg(F.sum("amount").alias("a"))
    by = monthly.groupBy("merchant_key").agg(F.median(F.when(F.col("month") != month, F.col("a"))).alias("_usual"), F.sum(F.when(F.col("month") == month, F.col("a"))).alias("_paid"))
    rows = decisions.filter("kind <> 'not_fixed'").join(by, "merchant_key", "left")
    usual = F.when(F.col("kind") == "monthly", F.coalesce("_usual", F.lit(0.0))).otherwise(0.0)
    return rows.select("merchant_key", "kind", C.cents(F.coalesce("expected_amount", usual)).alias("expected"), F.when(F.col("expected_amount").isNotNull(), "user").otherwise("history").alias("expected_source"), C.cents(F.coalesce("_paid", F.lit(0))).alias("paid"))


def budget(entries: DataFrame, decisions: DataFrame, settings: dict, month: str, today: str, history: list[str], historical_income: float | None) -> DataFrame:
    """One row: what is spent, still to be paid for fixed merchants, available and available a day, with reference values.

    settings: monthly_budget, expected_income (either may be None), annual_reserve.  Annual merchants are paid from the reserve, if
    there is one, and do not lower what is available.
    """
    reserve = settings["annual_reserve"]
    kinds = decisions.select("merchant_key", "kind")
    rows = entries.filter(F.col("month").isin([month, *history])).join(kinds, "merchant_key", "left")
    annual, monthly = F.coalesce(F.col("kind") == "annual", F.lit(False)), F.coalesce(F.col("kind") == "monthly", F.lit(False))
    aside = annual if reserve > 0 else F.lit(False)
    now = F.col("month") == month
    spent = rows.agg(_sum(now & ~aside).alias("spent"), _sum(now & monthly).alias("spent_fixed"), _sum(now & aside).alias("spent_from_reserve"))
    months = entries.sparkSession.createDataFrame([(m,) for m in history], "month string")
    usual = months.join(rows.filter(~now & ~annual).groupBy("month").agg(C.cents(F.sum("amount")).alias("a")), "month", "left").agg(C.cents(F.median(F.coalesce("a", F.lit(0.0)))).alias("typical_spending"))
    fixed = fixed_merchants(entries, decisions, month, history)
    due = fixed.agg(_sum(F.col("kind") == "monthly", F.greatest(F.col("expected") - F.col("paid"), F.lit(0.0))).alias("fixed_remaining"), F.coalesce(F.bool_or(F.col("kind") == "annual"), F.lit(False)).alias("_annual"))
    out = spent.join(usual, F.lit(True)).join(due, F.lit(True))  # one row each
    year, number = map(int, month.split("-"))
    left = calendar.monthrange(year, number)[1] - int(today[8:10]) + 1 if today.startswith(month) else 0
    known = historical_income if historical_income and historical_income > 0 else None
    income = settings["expected_income"] if settings["expected_income"] is not None else known
    limit = F.lit(settings["monthly_budget"]).cast("double")
    available = C.cents(limit - F.col("spent") - F.col("fixed_remaining"))
    return out.select(
        "spent", "spent_fixed", "spent_from_reserve", "fixed_remaining", "typical_spending", limit.alias("monthly_budget"), F.lit(left).alias("days_left"), available.alias("available"),
        (C.cents(F.greatest(available, F.lit(0.0)) / left) if left else F.lit(None).cast("double")).alias("daily_allowance"), C.cents(F.lit(reserve / 12)).alias("monthly_reserve"), C.cents(F.lit(income).cast("double")).alias("expected_income"),
        F.lit("settings" if settings["expected_income"] is not None else "history" if known else "none").alias("income_source"), C.cents(F.lit(income).cast("double") - limit - C.cents(F.lit(reserve / 12))).alias("expected_savings"),
        (F.col("_annual") & F.lit(reserve <= 0)).alias("annual_without_reserve"),
    )


def large_merchants(entries: DataFrame, known: DataFrame, month: str) -> DataFrame:
    """(merchant_key, amount, entries) of the month's merchants with large sums that are neither judged nor candidates.  known: merchant_key."""
    rows = entries.filter((F.col("month") == month) & F.col("merchant_key").isNotNull()).join(known.select("merchant_key").distinct(), "merchant_key", "left_anti")
    sums = rows.groupBy("merchant_key").agg(C.cents(F.sum("amount")).alias("amount"), F.count(F.lit(1)).alias("entries"))
    return sums.filter(F.col("amount") >= LARGE_LEAST).orderBy(F.desc("amount"), "merchant_key").limit(LARGE_MERCHANTS)


def evaluated_bills(bills: DataFrame, payments: DataFrame) -> DataFrame:
    """(bill_id, paid, remaining, status, minimum_paid): paid is the greatest of the source's word and the sums of the two sides.

    bills: bill_id, statement_amount, source_paid, source_is_paid, minimum; payments: bill_id, side (``bank``, ``card``), amount.
    Both sides show the same money, so they are never added up.
    """
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount")))
    sums = payments.groupBy("bill_id").agg(side("bank").alias("_bank"), side("card").alias("_card"))
    rows = bills.join(sums, "bill_id", "left")
    zero = F.lit(0.0)
    d = lambda c: F.coalesce(F.col(c).cast("double"), zero)
    rows = rows.withColumn("paid", C.cents(F.greatest(d("source_paid"), d("_bank"), d("_card"))))
    balance, said, paid = F.col("statement_amount").cast("double"), F.coalesce("source_is_paid", F.lit(False)), F.col("paid")
    status = F.when(balance.isNull(), F.when(said, "paid").otherwise("unknown")).when((balance <= 0) | said | (paid >= balance), "paid").when(paid > 0, "partial").otherwise("unpaid")
    rows = rows.withColumn("status", status)
    left = F.when(F.col("status") == "paid", zero).when(F.col("status") == "partial", C.cents(balance - paid)).when(F.col("status") == "unpaid", balance)
    enough = F.when(F.col("minimum").isNotNull(), (F.col("status") == "paid") | (paid >= F.col("minimum").cast("double")))
    return rows.select("bill_id", "paid", left.alias("remaining"), "status", enough.alias("minimum_paid"))


def statement_payments(bills: DataFrame, payments: DataFrame) -> DataFrame:
    """(bill_id, side, amount) of the payments in (closing, next closing] of their issuer; the last bill takes all after it.

    bills: bill_id, issuer, closing_date; payments: issuer, day, side, amount.  Bills and payments of an issuer are laid in one order of days.
    """
    none = F.lit(None)
    marks = bills.select("issuer", F.col("closing_date").alias("day"), F.lit(1).alias("kind"), "bill_id", none.cast("string").alias("side"), none.cast("double").alias("amount"))
    rows = payments.select("issuer", "day", F.lit(0).alias("kind"), none.cast("string").alias("bill_id"), "side", F.col("amount").cast("double").alias("amount")).unionByName(marks)
    w = Window.partitionBy("issuer").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("bill_id", F.last("bill_id", True).over(w)).filter("kind = 0 and bill_id is not null").select("bill_id", "side", "amount")
