"""Invoices beside payments: foreign currencies, learning, final roles, and what a match changes on a payment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.functions.text import fold_width
from tallyforge.operators.linkage import APPROXIMATE, GAP_SCORE, anchored_groups, equal_names

# Days before and after, and the tolerances of foreign amounts.
DAYS_BEFORE, DAYS_AFTER = 1, 5
SAME_CURRENCY_RATIO, SAME_CURRENCY_LEAST = 0.01, 0.01
CONVERTED_RATIO, CONVERTED_LEAST = 0.05, 1


# Where an invoice's JSON has its seller's tax number and its status, first of all that are there.
BAN_PATHS = ("$.invoice.sellerID", "$.invoice.sellerBan", "$.sellerID", "$.sellerBan", "$.detail.sellerBan")
STATUS_PATHS = ("$.detail.invStatus", "$.invStatus", "$.invoice.invStatus")
LATE_LEAST = 100


def _number(text: Column) -> Column:
    """A number in plain digits, else null."""
    bare = F.trim(text)
    return F.when(bare.rlike("[0-9]") & ~bare.rlike("[^0-9.-]"), bare.try_cast("double"))


def invoice_fields(payload: Column) -> dict[str, Column]:
    """seller_ban, currency, original_amount, items_amount, item_texts (joined by U+001F) and status from an invoice's JSON; null where it is not valid."""
    get = lambda path: F.get_json_object(payload, path)
    ban, code = F.trim(F.coalesce(*map(get, BAN_PATHS))), F.upper(F.trim(get("$.detail.currency")))
    lines = F.from_json(get("$.detail.details"), "array<struct<description:string,amount:string>>")
    amounts = F.filter(F.transform(lines, lambda x: _number(x["amount"])), lambda x: x.isNotNull())
    texts = F.transform(F.filter(lines, lambda x: x["description"].isNotNull()), lambda x: F.trim(x["description"]))
    return {
        "seller_ban": F.when(ban.rlike("^[0-9]{8}$"), ban),
        "currency": F.when(code.rlike("^[A-Z]{3}$"), code).otherwise("TWD"),
        "original_amount": _number(get("$.detail.amount")),
        "items_amount": F.when(F.size(amounts) > 0, F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x)),
        "item_texts": F.when(F.size(texts) > 0, F.array_join(texts, "\x1f")),
        "status": F.nullif(F.trim(F.coalesce(*map(get, STATUS_PATHS))), F.lit("")),
    }


def repeat_groups(invoices: DataFrame, hours: int = 24) -> DataFrame:
    """(invoice_id, anchor, rank) of foreign invoices issued again: same seller, items, currency and cents within ``hours`` of the group's first; groups of two or more.

    invoices: id, seller_key (tax number, else name), items_key, currency, amount, ts.
    """
    keys = ["currency", "seller_key", "items_key", "cents"]
    rows = invoices.filter("currency <> 'TWD' and amount > 0 and seller_key is not null and items_key is not null and ts is not null").withColumn("cents", F.floor(F.col("amount").cast("double") * 100 + 0.5))
    marked = anchored_groups(rows.select(*keys, "id", "ts"), keys, hours).join(rows.select("id", F.unix_seconds("ts").alias("_at")), "id")
    w = Window.partitionBy(*keys, "anchor")
    ranked = marked.withColumns({"rank": F.row_number().over(w.orderBy("_at", "id")), "n": F.count(F.lit(1)).over(w), "first": F.first("id").over(w.orderBy("_at", "id"))})
    return ranked.filter("n > 1").select(F.col("id").alias("invoice_id"), F.col("first").alias("anchor"), "rank")


def items_key(texts: Column) -> Column:
    """Item texts told apart by words only: width, case and spaces do not matter, blank lines go."""
    each = F.transform(F.split(texts, "\x1f"), lambda x: F.trim(F.regexp_replace(F.lower(fold_width(x)), r"\s+", " ")))
    return F.nullif(F.array_join(F.filter(each, lambda x: x != ""), "\x1f"), F.lit(""))


def precise_amount(amount: Column, currency: Column, detail: Column, items: Column) -> Column:
    """The exact amount of a foreign invoice: the detail's if it has a fraction, the items' sum if that has one and the same whole part, else the detail's."""
    value, sums = amount.cast("double"), C.cents(items)
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    fine = sums.isNotNull() & (sums != whole(sums)) & (whole(sums) == whole(F.coalesce(detail, value)))
    foreign = F.when(detail.isNotNull() & (detail != whole(detail)), C.cents(detail)).when(fine, sums).otherwise(F.coalesce(C.cents(detail), value))
    return F.when(currency == "TWD", value).otherwise(foreign)


def invoice_roles(invoices: DataFrame, links: DataFrame, unmatched: DataFrame, window: int = 3, late: int = 7) -> DataFrame:
    """(id, role, reason, review, duplicate_of) of every invoice: void, linked, kept apart, ambiguous, or spending of its own.

    invoices: id, day, amount, currency, voided; links: invoice_id, transaction_id (null: kept apart by the user), by_hand;
    unmatched: amount (paid, positive), day of TWD spending without an invoice.  An unlinked TWD invoice is ambiguous if an equal payment lies
    ``window`` days around it or, from ``LATE_LEAST``, up to ``late`` days before it.  Its days are exploded, so the test is a
    semi join of (day, amount) pairs.
    """
    l = links.select(F.col("invoice_id").alias("id"), "transaction_id", "by_hand", F.lit(True).alias("_told"))
    rows = invoices.join(l, "id", "left")
    reach = F.when(F.col("amount") >= LATE_LEAST, max(late, window)).otherwise(window)
    near = rows.filter("_told is null and currency = 'TWD'").select("id", "amount", F.explode(F.sequence(F.date_sub("day", reach), F.date_add("day", F.lit(window)))).alias("day"))
    near = near.join(unmatched.select(F.col("amount").cast("decimal(18,2)").alias("amount"), "day").distinct(), ["amount", "day"], "left_semi").select("id").distinct().withColumn("_near", F.lit(True))
    rows = rows.join(near, "id", "left")
    linked, sure = F.col("transaction_id").isNotNull(), F.coalesce("by_hand", F.lit(False))
    out = lambda role, reason, review: F.struct(F.lit(role).alias("role"), F.lit(reason).alias("reason"), review.alias("review"))
    told = (
        F.when(F.col("voided"), out("excluded", "invoice_voided", F.lit("auto")))
        .when(linked, out("spending", "invoice_matched", F.when(sure, "confirmed").otherwise("auto")))
        .when(F.col("_told"), out("spending", "invoice", F.lit("confirmed")))
        .when(F.col("_near"), out("spending", "invoice_ambiguous", F.lit("needs_review")))
        .otherwise(out("spending", "invoice", F.lit("auto")))
    )
    return rows.select("id", told.alias("r"), F.when(~F.col("voided"), F.col("transaction_id")).alias("duplicate_of")).select("id", "r.*", "duplicate_of")


def foreign_edges(invoices: DataFrame, payments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(invoice_id, transaction_id, gap, score) of foreign invoices with card payments to the same merchant.

    invoices: id, seller, amount, currency, twd (null without a rate), day; payments: id, merchant, amount (paid,
    positive), currency, day, all of credit accounts; names: seller, merchant, points of names that are alike (equal ones if absent).  The join has day, merchant, currency and a bucket of
    the size in its key.  Invoices are in another currency than TWD and positive.
    """
    # sizes within the tolerances lie in the same or the next bucket: (x + 20) differs by less than a tenth of its logarithm
    bucket = lambda x: F.floor(F.log(x + 20.0) * 10).cast("int")
    asked, twd = F.col("amount").cast("double"), F.col("twd").cast("double")
    own = F.struct(F.col("currency").alias("paid_in"), asked.alias("size"), F.greatest(asked * SAME_CURRENCY_RATIO, F.lit(SAME_CURRENCY_LEAST)).alias("slack"))
    converted = F.struct(F.lit("TWD").alias("paid_in"), twd.alias("size"), F.greatest(twd * CONVERTED_RATIO, F.lit(float(CONVERTED_LEAST))).alias("slack"))
    known = (names if names is not None else equal_names(invoices)).select("seller", "merchant", "points")
    i = invoices.select(F.col("id").alias("invoice_id"), "seller", F.col("day").alias("invoice_day"), F.col("currency").alias("asked_in"), F.explode(F.array(own, converted)).alias("w")).join(known, "seller")
    i = i.select("invoice_id", "merchant", "points", "invoice_day", "w.*", (F.col("w.size") > 0).alias("sized"), F.explode(F.sequence(F.lit(-DAYS_BEFORE), F.lit(DAYS_AFTER))).alias("offset")).filter("sized")
    i = i.withColumn("day", F.date_add("invoice_day", F.col("offset"))).withColumn("bucket", F.explode(F.array(*(bucket(F.col("size")) + k for k in (-1, 0, 1)))))
    p = payments.select(F.col("id").alias("transaction_id"), "merchant", F.col("amount").cast("double").alias("paid"), F.col("currency").alias("paid_in"), "day").withColumn("bucket", bucket(F.col("paid")))
    found = i.join(p, ["day", "merchant", "paid_in", "bucket"])
    fits = F.abs(F.col("paid") - F.col("size")) <= F.col("slack")
    gap = F.abs("offset")
    score = F.lit(APPROXIMATE) + F.col("points") + F.element_at(F.array(*map(F.lit, GAP_SCORE)), gap + 1)
    return found.filter(fits).select("invoice_id", "transaction_id", gap.alias("gap"), score.alias("score"))


def learned_merchants(links: DataFrame, window: int = 3, late: int = 7) -> DataFrame:
    """Distinct (seller, account_id, merchant) of the links whose invoice came later than ``window`` and up to ``late`` days.

    links: seller, account_id, merchant, currency, invoice_day, day.
    """
    by = F.datediff("invoice_day", "day")
    return links.filter((F.col("currency") == "TWD") & (by > window) & (by <= late)).select("seller", "account_id", "merchant").dropna().distinct()


def resolved_role(s: dict[str, Column]) -> Column:
    """Struct (role, reason, review) once status is known: void, duplicate, waiting for a card, ambiguous, else as derived.

    ``s``: role, reason, review, status, overdue, voided, duplicate (boolean).
    """
    out = lambda role, reason, review: F.struct(role.alias("role"), reason.alias("reason"), review.alias("review"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    sure = s["review"] == "confirmed"
    waiting = F.when(sure, "confirmed").when(yes(s["overdue"]), "needs_review").otherwise("auto")
    return (
        F.when(yes(s["voided"]), out(F.lit("excluded"), F.lit("invoice_voided"), F.lit("auto")))
        .when(yes(s["duplicate"]), out(s["role"], s["reason"], s["review"]))
        .when(s["status"] == "awaiting_card", out(s["role"], F.lit("invoice_awaiting_card"), waiting))
        .when((s["status"] == "ambiguous") & ~yes(sure), out(s["role"], F.lit("invoice_ambiguous"), F.lit("needs_review")))
        .otherwise(out(s["role"], s["reason"], s["review"]))
    )


def carry_advances(transactions: DataFrame, invoices: DataFrame) -> DataFrame:
    """Transactions with the advance their duplicate invoice was marked as; the user's own mark stays, the first invoice wins.

    transactions: id, role, reason, counterparty; invoices: id, role, reason, duplicate_of, counterparty.
    """
    first = invoices.filter("role = 'advance' and reason = 'override' and duplicate_of is not null").groupBy(F.col("duplicate_of").alias("id")).agg(F.min(F.struct(F.col("id").alias("by"), F.col("counterparty").alias("with"))).alias("_a"))
    rows = transactions.join(first, "id", "left")
    takes = F.col("_a").isNotNull() & (F.coalesce("reason", F.lit("")) != "override")
    new = {"role": F.lit("advance"), "reason": F.lit("invoice_override"), "counterparty": F.col("_a.with")}
    return rows.select("id", *(F.when(takes, v).otherwise(F.col(k)).alias(k) for k, v in new.items()))


def fee_categories(items: DataFrame, fees: DataFrame) -> DataFrame:
    """Items whose fee rows have their purchase's category, unless that is open or the fee's own was set by hand or for its merchant.

    items: id, category_id, category_source; fees: fee_id, purchase_id.
    """
    of = fees.join(items.select(F.col("id").alias("purchase_id"), F.col("category_id").alias("_base")), "purchase_id").select(F.col("fee_id").alias("id"), "_base")
    rows = items.join(of, "id", "left")
    takes = F.col("_base").isNotNull() & (F.col("_base") != "other") & ~F.coalesce(F.col("category_source").isin("user", "merchant_rule"), F.lit(False))
    return rows.select("id", F.when(takes, F.col("_base")).otherwise(F.col("category_id")).alias("category_id"), F.when(takes, "rule").otherwise(F.col("category_source")).alias("category_source"))


def matched_amounts(amount: Column, currency: Column, rate: Column) -> Column:
    """Struct (amount, currency, original) shown on a payment: foreign ones converted to whole TWD (null without a rate) beside the original."""
    foreign = currency != "TWD"
    whole = F.floor(C.to_twd(amount, currency, rate) + 0.5).cast("double")
    return F.struct(F.when(foreign, whole).otherwise(amount.cast("double")).alias("amount"), F.when(foreign, currency).alias("currency"), F.when(foreign, amount.cast("double")).alias("original"))


def is_cash_paid(i: dict[str, Column]) -> Column:
    """An unmatched TWD invoice, counted as spending, of a merchant that is always paid in cash."""
    test = i["paid_in_cash"] & (i["status"] == "unmatched") & (i["role"] == "spending") & ~F.coalesce(i["duplicate"], F.lit(False)) & (i["currency"] == "TWD") & (i["amount"] > 0)
    return F.coalesce(test, F.lit(False))
