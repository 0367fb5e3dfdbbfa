"""What waits for the user: connectors, cards due, activities to review, duplicates in doubt, open categories; and what a report shows of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import columns as C

# The kinds in their order, of which the first four block; days before and after a due date, and after which an import is stale.
KINDS = ("connector_needs_user_action", "connector_error", "card_due_unpaid", "import_stale", "needs_review", "duplicate_ambiguous", "uncategorized")
BLOCKING = 4
DUE_SOON, OVERDUE_MOST, IMPORT_STALE = 7, 31, 7


def _shaped(rows: DataFrame, key: Column, kind: Column | str, created: Column, amount: Column | None = None, currency: Column | None = None) -> DataFrame:
    name = F.lit(kind) if isinstance(kind, str) else kind
    value = amount.cast("double") if amount is not None else F.lit(None).cast("double")
    money = currency if currency is not None else F.lit(None).cast("string")
    return rows.select(F.concat_ws(":", name, key).alias("id"), name.alias("kind"), created.cast("string").alias("created_at"), value.alias("amount"), money.alias("currency"))


def inbox(jobs: DataFrame, bills: DataFrame, items: DataFrame, today: str, manual: list[str], months: list[str]) -> DataFrame:
    """(id, kind, severity, created_at, amount, currency) of all that waits, in no order; see :func:`order`.

    jobs: connector_id, status, last_run, last_success (days), one row a connector; bills: issuer, billing_period, status, due_date,
    closing_date, remaining, currency, the current one of each issuer; items: the unified table; ``manual``: connectors whose data is
    imported by hand.  Activities of ``months`` only; open categories are one entry.
    """
    day = F.lit(today).cast("date")
    failed = jobs.filter(F.col("status").isin("failed", "needs_user_action"))
    parts = [_shaped(failed, F.col("connector_id"), F.when(F.col("status") == "failed", KINDS[1]).otherwise(KINDS[0]), F.col("last_run"))]
    stale = jobs.filter(F.col("connector_id").isin(manual) & (F.col("last_success").isNull() | (F.datediff(day, "last_success") > IMPORT_STALE)))
    parts.append(_shaped(stale, F.col("connector_id"), "import_stale", F.coalesce("last_success", day)))
    left = F.datediff("due_date", day)
    due = bills.filter(F.col("status").isin("unpaid", "partial") & left.between(-OVERDUE_MOST, DUE_SOON))
    parts.append(_shaped(due, F.concat_ws(":", "issuer", "billing_period"), "card_due_unpaid", F.coalesce("closing_date", "due_date"), F.col("remaining"), F.col("currency")))
    own = items.filter(F.col("month").isin(months) & (F.coalesce("role", F.lit("")) != "excluded"))
    review = own.filter("review = 'needs_review'")
    kind = F.when(F.col("reason").isin("invoice_ambiguous", "invoice_repeat"), "duplicate_ambiguous").otherwise("needs_review")
    size, money = F.abs(F.coalesce("twd", "amount")), F.when(F.col("twd").isNotNull(), "TWD").otherwise(F.col("currency"))
    parts.append(_shaped(review, F.concat_ws(":", "source", "id"), kind, F.col("date"), size, money))
    loose = own.filter(F.col("source").isin("bank", "card") & (F.coalesce("category_id", F.lit("other")) == "other") & (F.col("role") == "spending") & F.col("duplicate_of").isNull())
    total = loose.agg(F.count(F.lit(1)).alias("n"), F.max("day").alias("last"), C.cents(F.sum(F.abs(F.coalesce("twd", F.lit(0))))).alias("sum")).filter("n > 0")
    parts.append(_shaped(total, F.col("n").cast("string"), "uncategorized", F.col("last"), F.col("sum"), F.lit("TWD")))
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    return rows.withColumn("severity", F.when(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) <= BLOCKING, "blocking").otherwise("tidy"))


def order() -> list[Column]:
    """Blocking ones first, then by kind, latest first, then by id."""
    return [F.col("severity"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.desc("created_at"), F.col("id")]


def batch_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(batch_id, assets_change, debt_change, baseline): what a batch changed; without a snapshot before, it is the baseline.  Both: batch_id, assets, debt."""
    b = before.select("batch_id", F.col("assets").alias("_a"), F.col("debt").alias("_d"))
    rows = after.join(b, "batch_id", "left")
    return rows.select("batch_id", C.cents(F.col("assets") - F.col("_a")).alias("assets_change"), C.cents(F.col("debt") - F.col("_d")).alias("debt_change"), F.col("_a").isNull().alias("baseline"))


def report_details(changes: DataFrame, items: DataFrame) -> DataFrame:
    """(batch_id, change, id, title, amount): each change of a batch (``added``, ``posted``) with its activity, and ``invoice_linked`` for added invoices that a transaction shows.

    changes: batch_id, change, id; items: the unified table.  Activities that are gone are left out.
    """
    rows = changes.join(items.select("id", "source", "title", "amount", "duplicate_of"), "id")
    linked = (F.col("change") == "added") & (F.col("source") == "invoice") & F.col("duplicate_of").isNotNull()
    return rows.select("batch_id", F.when(linked, "invoice_linked").otherwise(F.col("change")).alias("change"), "id", "title", F.col("amount").cast("double").alias("amount"))
