"""Scans, classification, roles and the monthly summary.

Dimensions (accounts, rules, rates, overrides) are joined without a forced hint: Spark broadcasts them while their
measured size is under its threshold, and shuffles beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import banks as B
from tallyforge.functions import columns as C


def visible(transactions: DataFrame) -> DataFrame:
    """Rows of accounts that are not merged away, without pending rows that have been matched."""
    return transactions.filter(F.col("canonical_account_id").isNull() & ((F.col("status") != "pending") | F.col("matched_transaction_id").isNull()))


def with_day(transactions: DataFrame) -> DataFrame:
    return transactions.withColumn("day", C.transaction_day(F.col("authorized_at"), F.col("posted_date")))


def in_range(rows: DataFrame, day: str, start: str, stop: str) -> DataFrame:
    """Half-open range of days."""
    return rows.filter((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) < F.lit(stop).cast("date")))


def latest_per(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, first in ``order``: a window whose rank filter Spark applies before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def page_after(rows: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """Keyset page, all keys descending; ``after`` is the last row of the page before."""
    if after:
        rows = rows.filter(F.struct(*keys) < F.struct(*(F.lit(x) for x in after)))
    return rows.orderBy(*(F.col(k).desc() for k in keys)).limit(limit)


def named_page(rows: DataFrame, name: str, key: str, after: tuple | None, limit: int) -> DataFrame:
    """Keyset page by a name in the order of the locale, then by ``key``; ``after``: name and key of the last row of the page before."""
    by = C.localized(F.col(name))
    if after:
        last = C.localized(F.lit(after[0]))
        rows = rows.filter((by > last) | (by == last) & (F.col(key) > F.lit(after[1])))
    return rows.orderBy(by, key).limit(limit)


def classify(rows: DataFrame, rules: list[dict], overrides: DataFrame | None = None) -> DataFrame:
    """category_id, rule_id and rule_role: the user's override, else the first rule by priority, then the latest change, then id.

    ``rules`` is user data of a few hundred rows; it becomes one ordered CASE, so rows are read once and nothing
    is joined pairwise.
    """
    first = F.lit(None).cast("struct<rule_id:string,category_id:string,role:string>")
    last_first = sorted(rules, key=lambda r: r["id"], reverse=True)
    for r in sorted(last_first, key=lambda r: (r["priority"], r.get("updated_at") or "")):
        text = F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("description", "counterparty", "source_id") if c in rows.columns)) if r["field"] == "any_text" else F.col(r["field"])
        hit = C.rule_matches(text, r["operator"], r["pattern"]) & C.direction_matches(F.col("amount"), r["direction"])
        value = F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["category_id"]).cast("string").alias("category_id"), F.lit(r["economic_role"]).cast("string").alias("role"))
        first = F.when(hit, value).otherwise(first)
    rows = rows.withColumn("_first", first)
    if overrides is not None:
        rows = rows.join(overrides.select(F.col("target_id").alias("id"), F.col("category_id").alias("_own")), "id", "left")
    else:
        rows = rows.withColumn("_own", F.lit(None).cast("string"))
    return rows.withColumns(
        {"category_id": F.coalesce("_own", "_first.category_id", F.lit("other")), "rule_id": F.col("_first.rule_id"), "rule_role": F.col("_first.role"), "category_source": F.when(F.col("_own").isNotNull(), "override").when(F.col("_first").isNotNull(), "rule").otherwise("fallback")}
    ).drop("_first", "_own")


def economic_role(s: dict[str, Column]) -> Column:
    """Struct (role, source, review) by the fixed order of tests.

    ``s``: preference, own_account_kind, merchant_role, auto_transfer, card_payment, synced_card, top_up,
    rule_role, income_category, excluded, amount, credit, transfer_hint.  Absent signals may be null literals.
    """
    signed = F.when(s["amount"] > 0, F.when(s["credit"], "spending").otherwise("income")).otherwise("spending")

    def role(name: Column | str, source: str, review: str = "auto") -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("role"), F.lit(source).alias("source"), F.lit(review).alias("review"))

    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(s["preference"] == "exclude", role(F.when(yes(s["card_payment"]), "card_payment").otherwise("own_transfer"), "calculation_preference", "confirmed"))
        .when((s["preference"] == "include") & (s["rule_role"] == "investment"), role("investment", "calculation_preference", "confirmed"))
        .when(s["preference"] == "include", role(signed, "calculation_preference", "confirmed"))
        .when(s["own_account_kind"] == "own_account", role("own_transfer", "own_account"))
        .when(s["own_account_kind"] == "unsynced_card", role("spending", "unsynced_card"))
        .when(s["merchant_role"].isNotNull(), role(s["merchant_role"], "merchant_rule", "confirmed"))
        .when(yes(s["auto_transfer"]), role("own_transfer", "auto_transfer"))
        .when(yes(s["card_payment"]) & yes(s["synced_card"]), role("card_payment", "card_payment"))
        .when(yes(s["card_payment"]), role("card_payment", "possible_unsynced_card", "needs_review"))
        .when(yes(s["top_up"]), role("own_transfer", "ewallet_topup"))
        .when(s["rule_role"] == "investment", role("investment", "category"))
        .when((s["rule_role"] == "income") | yes(s["income_category"]), role("income", "category"))
        .when(s["rule_role"] == "own_transfer", role("own_transfer", "rule"))
        .when(s["rule_role"] == "spending", role("spending", "rule"))
        .when(yes(s["excluded"]), role("own_transfer", "excluded"))
        .when(yes(s["transfer_hint"]), role(signed, "sign", "needs_review"))
        .otherwise(role(signed, "sign"))
    )


def with_preferences(transactions: DataFrame, preferences: DataFrame) -> DataFrame:
    """``transactions`` with the user's word on counting them, ``preference``: exclude, include or null.  preferences: transaction_id, excluded."""
    told = preferences.select(F.col("transaction_id").alias("id"), F.when(F.col("excluded"), "exclude").otherwise("include").alias("preference"))
    return transactions.join(told, "id", "left")


def automatic_classification(s: dict[str, Column]) -> Column:
    """Struct (category_id, source, excluded): fee offset, transfer pair, own account unless the user classified, else the rule's.

    ``s``: offset, transfer (boolean), own_kind, category_id, source, excluded.
    """
    out = lambda category, source, excluded: F.struct(category.alias("category_id"), source.alias("source"), excluded.alias("excluded"))
    users = F.coalesce(s["source"].isin("override", "merchant_rule", "user_rule"), F.lit(False))
    none = F.lit("other")
    return (
        F.when(s["offset"], out(F.lit("misc"), F.lit("auto_offset"), F.lit(True)))
        .when(s["transfer"], out(none, F.lit("auto_transfer"), F.lit(True)))
        .when(~users & (s["own_kind"] == "unsynced_card"), out(none, F.lit("unsynced_card"), F.lit(False)))
        .when(~users & s["own_kind"].isNotNull(), out(none, F.lit("own_account"), F.lit(True)))
        .otherwise(out(s["category_id"], s["source"], s["excluded"]))
    )


# The category tree (id, parent).
CATEGORIES = tuple((x, None) for x in "food transport housing shopping tech entertainment health donation misc income".split()) + tuple((f"income.{x}", "income") for x in ("salary", "investment", "other")) + (("other", None),)


def top_category(category: Column) -> Column:
    """The top category: ``other`` without one, ``misc`` for ids that the tree does not have."""
    known = F.create_map(*(F.lit(x) for name, parent in CATEGORIES for x in (name, parent or name)))
    return F.when(F.coalesce(category, F.lit("")) == "", "other").otherwise(F.coalesce(F.element_at(known, category), F.lit("misc")))


def keyword_category(text: Column, words: list[tuple[str, str, str]], direction: Column) -> Column:
    """The first keyword's category; ``words``: (pattern, category_id, ``inflow`` or ``outflow``) in their order, of the user or a shared table."""
    found, low = F.lit(None).cast("string"), F.lower(text)
    for pattern, category, way in reversed(words):
        found = F.when(low.rlike(pattern) & (direction == way), category).otherwise(found)
    return found


def suggestion(s: dict[str, Column], refined: list[str] | None = None) -> Column:
    """Struct (category_id, source): the merchant's history, its keyword, the items', in this order; keywords in ``refined`` give way to items.

    ``s``: history, keyword, items, direction.
    """
    out = lambda value, source: F.when(value.isNotNull(), F.struct(value.alias("category_id"), F.lit(source).alias("source")))
    sure = F.when(~F.coalesce(s["keyword"].isin(refined or [""]), F.lit(False)), s["keyword"])
    items = F.when(s["direction"] == "outflow", s["items"])
    return F.coalesce(out(s["history"], "merchant_history"), out(sure, "merchant_keywords"), out(items, "item_keywords"), out(s["keyword"], "merchant_keywords"))


def applied_suggestion(s: dict[str, Column]) -> Column:
    """The category after suggestions: only of counted spending and income that no transfer rule took, open or a top category that the suggestion lies under.

    ``s``: category_id, source, role, duplicate (boolean), suggested.
    """
    own, new = s["category_id"], s["suggested"]
    parents = F.create_map(*(F.lit(x) for name, parent in CATEGORIES if parent for x in (name, parent)))
    open_ = F.coalesce(own, F.lit("other")) == "other"
    closer = (F.coalesce(s["source"], F.lit("")) != "override") & (F.element_at(parents, new) == own)
    may = ~F.coalesce(s["duplicate"], F.lit(False)) & F.coalesce(s["role"], F.lit("spending")).isin("spending", "income") & ~F.coalesce(s["source"].isin("auto_transfer", "auto_offset", "own_account", "unsynced_card"), F.lit(False))
    return F.when(may & new.isNotNull() & (open_ | closer), new).otherwise(own)


def lifecycle_dedupe(rows: DataFrame, connector: str, marker: str) -> DataFrame:
    """``rows`` (id, connector_id, source_id, n) where of a connector's ids that differ in a lifecycle mark only one stays: without mark, else the later mark, then the first row.

    ``marker``: a pattern whose group 1 is the mark; posted marks start with ``已``.
    """
    mark = F.regexp_extract("source_id", marker, 1)
    rank = F.when(mark == "", 0).when(mark.startswith("已"), 1).otherwise(2)
    own = rows.filter(F.col("connector_id") == connector).withColumns({"_key": F.regexp_replace("source_id", marker, ":"), "_rank_of": rank})
    kept = latest_per(own, ["_key"], F.asc("_rank_of"), F.asc("n")).drop("_key", "_rank_of")
    return rows.filter(F.col("connector_id") != connector).unionByName(kept)


def override_history(overrides: DataFrame, transactions: DataFrame, invoices: DataFrame, links: DataFrame) -> DataFrame:
    """(target_type, target_id, category_id, description, counterparty, seller_name) of the user's categories, with the seller of a linked invoice.

    overrides: target_type, target_id, category_id; links: invoice_id, transaction_id of user links.  Open categories tell nothing.
    """
    told = overrides.filter("category_id <> 'other'")
    sellers = invoices.select(F.col("id").alias("invoice_id"), "seller_name")
    of = links.filter("transaction_id is not null").join(sellers, "invoice_id").select(F.col("transaction_id").alias("target_id"), "seller_name")
    bank = told.filter("target_type = 'bank_transaction'").join(transactions.select(F.col("id").alias("target_id"), "description", "counterparty"), "target_id").join(of, "target_id", "left")
    own = told.filter("target_type = 'invoice'").join(sellers.withColumnRenamed("invoice_id", "target_id"), "target_id")
    none = F.lit(None).cast("string")
    columns = ["target_type", "target_id", "category_id", "description", "counterparty", "seller_name"]
    return bank.select(*columns).unionByName(own.withColumns({"description": none, "counterparty": none}).select(*columns))


def open_links(preferences: DataFrame, invoices: DataFrame, transactions: DataFrame) -> DataFrame:
    """(invoice_id, decision, seller_name, transaction_id, visible): the user's decisions with their invoice and transaction, and whether that one still shows."""
    shown = visible(transactions).select(F.col("id").alias("_shown"))
    rows = preferences.join(invoices.select(F.col("id").alias("invoice_id"), "seller_name"), "invoice_id", "left").join(shown, F.col("transaction_id") == F.col("_shown"), "left")
    return rows.select("invoice_id", "decision", "seller_name", "transaction_id", F.col("_shown").isNotNull().alias("visible"))


def checked_months(since: str, until: str, most: int = 12) -> tuple[str, str]:
    """Half-open days of the months ``since`` to ``until`` (YYYY-MM, both in); raises if they are out of order or more than ``most``."""
    (a, b), (c, d) = (tuple(map(int, m.split("-"))) for m in (since, until))
    n = (c - a) * 12 + d - b + 1
    if not (1 <= b <= 12 and 1 <= d <= 12) or not 1 <= n <= most:
        raise ValueError(f"{since} to {until}: between 1 and {most} months in order")
    return f"{since}-01", f"{c + d // 12}-{d % 12 + 1:02}-01"


def month_trend(summary: DataFrame, months: list[str], loaded: tuple[str, str]) -> DataFrame:
    """(month, spending, no_data, outside): spending of each month; months outside those loaded are told apart from months without data."""
    spine = summary.sparkSession.createDataFrame([(m, not loaded[0] <= m <= loaded[1]) for m in months], "month string, outside boolean")
    rows = spine.join(summary.select("month", "spending", "activity_count"), "month", "left")
    return rows.select("month", F.coalesce("spending", F.lit(0.0)).alias("spending"), (F.coalesce("activity_count", F.lit(0)) == 0).alias("no_data"), "outside")


#: The currencies whose rates are listed, in this order.
LISTED_CURRENCIES = ("USD", "JPY", "EUR", "CNY")


def inverted_rates(quotes: DataFrame) -> DataFrame:
    """(currency, rate_to_twd, updated_on): the inverse of a currency's latest good quote.

    quotes: currency, per_twd (units a TWD), day, n (order within a day).  Zero, negative, missing and infinite quotes are no rates; a currency
    keeps its last good one.
    """
    good = quotes.filter((F.col("per_twd") > 0) & (F.col("per_twd") < float("inf")))
    last = good.groupBy("currency").agg(F.max_by(F.struct("per_twd", "day"), F.struct("day", "n")).alias("q"))
    return last.select("currency", (F.lit(1.0) / F.col("q.per_twd")).alias("rate_to_twd"), F.col("q.day").alias("updated_on"))


def listed_rates(rates: DataFrame) -> DataFrame:
    """Rates of the listed currencies in their order (``place``)."""
    place = F.array_position(F.array(*map(F.lit, LISTED_CURRENCIES)), F.col("currency")).cast("int")
    return rates.withColumn("place", place).filter("place > 0").orderBy("place")


def report_rollup(results: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(batch_id, status, connectors, failed, new_records): the worst status of a batch's connectors and the sum of their new records.

    results: batch_id, connector_id, status, new_records.  ``changes`` (:func:`tallyforge.operators.inbox.batch_snapshots`) adds what assets and debt
    became more by, which a batch without any success does not tell, and ``baseline``.
    """
    rank = F.when(F.col("status") == "failed", 3).when(F.col("status") == "needs_user_action", 2).when(F.col("status") == "partial", 1).otherwise(0)
    by = results.groupBy("batch_id").agg(F.max(rank).alias("_r"), F.min(rank).alias("_best"), F.count(F.lit(1)).alias("connectors"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("new_records"), F.lit(0)).alias("new_records"))
    status = F.element_at(F.array(*map(F.lit, ("success", "partial", "needs_user_action", "failed"))), F.col("_r") + 1)
    told = ["batch_id", status.alias("status"), "connectors", "failed", "new_records"]
    if changes is None:
        return by.select(*told)
    known = F.col("_best") < 2
    money = [F.when(known, F.col(c)).alias(c) for c in ("assets_change", "debt_change")]
    return by.join(changes, "batch_id", "left").select(*told, *money, F.coalesce(F.col("baseline") & known, F.lit(False)).alias("baseline"))


def activity(transactions: DataFrame, rates: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per visible transaction: day, month, role, review, category and amount in TWD (null without a rate)."""
    rows = classify(with_day(visible(transactions)), rules)
    none = F.lit(None).cast("string")
    signals = {
        "preference": none, "own_account_kind": none, "merchant_role": none, "auto_transfer": F.lit(False), "card_payment": B.is_card_payment(F.concat_ws(" ", "description", "counterparty"), F.col("account_type") == "credit"),
        "synced_card": F.lit(True), "top_up": F.lit(False), "rule_role": F.col("rule_role"), "income_category": F.lit(False), "excluded": F.lit(False),
        "amount": F.col("amount"), "credit": F.col("account_type") == "credit", "transfer_hint": F.lower("description").contains("unspecified") | F.lower("description").contains("not specified"),
    }
    rows = rows.withColumn("_role", economic_role(signals)).join(rates, "currency", "left")
    return rows.withColumns(
        {
            "role": F.coalesce("role_override", "_role.role"), "role_source": F.when(F.col("role_override").isNotNull(), "override").otherwise(F.col("_role.source")),
            "review": F.when(F.col("role_override").isNotNull(), "confirmed").otherwise(F.col("_role.review")), "month": F.date_format("day", "yyyy-MM"),
            "twd": C.cents(C.to_twd(F.col("amount"), F.col("currency"), F.col("rate_to_twd"))).cast("decimal(18,2)"),
        }
    ).drop("_role")


def month_summary(items: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Totals per month.  Tests in order: excluded, missing rate, advance, reimbursement, then the role.

    One grouped aggregate with partial sums before the only shuffle; ``months`` adds months without rows.
    """
    twd, role = F.col("twd"), F.col("role")
    plain = twd.isNotNull() & ~role.isin("excluded", "advance", "reimbursement")
    total = lambda test, value: F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("double")
    out = items.groupBy("month").agg(
        total(plain & (role == "income"), twd).alias("income"),
        total(plain & (role == "spending"), -twd).alias("spending"),
        total(plain & (role == "investment"), -twd).alias("investment"),
        total(plain & (role == "own_transfer") & (twd < 0), -twd).alias("own_transfer"),
        total(plain & (role == "card_payment") & (twd < 0), -twd).alias("card_payment"),
        F.count_if(plain & (F.col("review") == "needs_review")).alias("review_count"),
        total(plain & (F.col("review") == "needs_review"), F.abs(twd)).alias("review_amount"),
        F.count_if(role == "excluded").alias("excluded_count"),
        total(role == "excluded", F.abs(twd)).alias("excluded_amount"),
        F.count_if(twd.isNotNull() & (role == "advance")).alias("advance_count"),
        total(role == "advance", -twd).alias("advance_amount"),
        F.count_if(twd.isNotNull() & (role == "reimbursement")).alias("reimbursement_count"),
        total(role == "reimbursement", twd).alias("reimbursement_amount"),
        F.count_if(plain).alias("activity_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(twd.isNull() & (role != "excluded"), F.col("currency")))), ",").alias("missing_currencies"),
    )
    out = out.withColumn("saved", F.floor((F.col("income") - F.col("spending")) * 100 + 0.5) / 100)
    if months is not None:
        out = months.join(out, "month", "left").fillna(0).fillna("")
    return out


def spending_by_category(items: DataFrame) -> DataFrame:
    rows = items.filter((F.col("role") == "spending") & F.col("twd").isNotNull() & (F.col("twd") != 0))
    return rows.groupBy("month", "category_id").agg(F.sum(-F.col("twd")).cast("double").alias("spending"))


def advances(items: DataFrame) -> DataFrame:
    """Balance per counterparty (case folded) and currency, with the latest spelling."""
    rows = items.filter(F.col("role").isin("advance", "reimbursement") & F.col("advance_counterparty").isNotNull())
    return rows.groupBy(F.lower("advance_counterparty").alias("counterparty"), "currency").agg(
        F.sum(-F.col("amount")).cast("double").alias("balance"), F.count(F.lit(1)).alias("entries"), F.max("day").alias("last_day"), F.max_by("advance_counterparty", F.struct("day", "id")).alias("display_name")
    )


def merchants(items: DataFrame) -> DataFrame:
    """Count, spending and the most frequent category (then smallest id) per merchant key; two combined aggregates."""
    rows = items.withColumn("merchant_key", C.merchant_key(F.col("counterparty")))
    by_category = rows.groupBy("merchant_key", "category_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("role") == "spending", -F.col("twd"))).alias("s"))
    best = F.min_by("category_id", F.struct((-F.col("n")).alias("n"), "category_id"))
    return by_category.groupBy("merchant_key").agg(F.sum("n").alias("activity_count"), F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("spending"), best.alias("category_id"))


def fixed_candidates(spending: DataFrame, months: list[str], least: float = 100.0, per_month: int = 2, ratio: float = 1.5, top: int = 10) -> DataFrame:
    """Merchants with spending in every one of ``months``, alike in size: the ``top`` by median amount."""
    monthly = spending.filter(F.col("month").isin(months)).groupBy("merchant_key", "month").agg(F.sum("amount").cast("double").alias("amount"), F.count(F.lit(1)).alias("n"))
    out = monthly.groupBy("merchant_key").agg(F.count(F.lit(1)).alias("months"), F.min("amount").alias("low"), F.max("amount").alias("high"), F.max("n").alias("most"), F.median("amount").alias("typical_amount"))
    keep = (F.col("months") == len(months)) & (F.col("low") >= least) & (F.col("most") <= per_month) & (F.col("high") <= F.col("low") * ratio)
    return out.filter(keep).orderBy(F.desc("typical_amount"), "merchant_key").limit(top).select("merchant_key", "low", "high", "typical_amount")


def week_summary(spending: DataFrame, today: str) -> DataFrame:
    """Total of each of the last nine weeks up to today's weekday; ``spending``: day, amount."""
    this = C.week_start(F.lit(today).cast("date"))
    upto = F.datediff(F.lit(today).cast("date"), this)
    rows = spending.filter((F.col("day") >= F.date_sub(this, 56)) & (F.col("day") <= F.lit(today).cast("date")))
    rows = rows.withColumn("week", C.week_start(F.col("day"))).filter(F.datediff("day", "week") <= upto)
    return rows.groupBy("week").agg(F.sum("amount").cast("double").alias("total"), F.max("amount").cast("double").alias("largest"), F.count(F.lit(1)).alias("entries"))


def most_frequent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) with the value that is most frequent, then smallest."""
    n = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def usable_months(summary: DataFrame) -> DataFrame:
    """(usable_months, median_income): months with at least half of the fullest month's activity, and the median of their positive incomes."""
    most = F.max("activity_count").over(Window.partitionBy())  # one row a month
    rows = summary.withColumn("_most", most).filter((F.col("activity_count") > 0) & (F.col("activity_count") * 2 >= F.col("_most")))
    return rows.agg(F.count(F.lit(1)).alias("usable_months"), F.median(F.when(F.col("income") > 0, F.col("income"))).alias("median_income"))


def item_category(items: DataFrame, share: float = 0.4) -> DataFrame:
    """(invoice_id, category_id): the category with the greatest weight of lines if it has ``share`` of all; of equals the first seen,
    then the smallest id.

    items: invoice_id, line_number, amount, category_id (null if no word fits).  A line weighs its positive amount, else 1.
    """
    rows = items.withColumn("w", F.when(F.col("amount") > 0, F.col("amount")).otherwise(1).cast("decimal(20,2)"))
    by = rows.groupBy("invoice_id", "category_id").agg(F.sum("w").alias("w"), F.min("line_number").alias("first"))
    best = F.min(F.when(F.col("category_id").isNotNull(), F.struct((-F.col("w")).alias("less"), "first", "category_id"))).alias("best")
    out = by.groupBy("invoice_id").agg(best, F.sum("w").alias("total")).filter(-F.col("best.less").cast("double") / F.col("total").cast("double") >= share)
    return out.select("invoice_id", "best.category_id")


def listed_merchants(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(merchant_key, name, activity_count, spending, category_id, payment_methods) of every merchant with activity or an alias.

    items: merchant_key, merchant_name, payment_method, category_id, role, twd; aliases: merchant_key, display_name, category_id.  The alias names and
    classifies its merchant; else the most frequent category counts, then the smallest id.
    """
    rows = items.filter("merchant_key is not null")
    by = rows.groupBy("merchant_key", "category_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("role") == "spending", -F.col("twd"))).alias("s"), F.min("merchant_name").alias("name"), F.collect_set("payment_method").alias("methods"))
    usual = F.min_by("category_id", F.struct((-F.col("n")).alias("n"), "category_id"))
    seen = by.groupBy("merchant_key").agg(F.sum("n").alias("activity_count"), F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("spending"), usual.alias("_usual"), F.min("name").alias("_name"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))), ",").alias("payment_methods"))
    out = seen.join(aliases.select("merchant_key", "display_name", F.col("category_id").alias("_own")), "merchant_key", "full")
    return out.select(
        "merchant_key", F.coalesce("display_name", "_name").alias("name"), F.coalesce("activity_count", F.lit(0)).alias("activity_count"), F.coalesce("spending", F.lit(0.0)).alias("spending"), F.coalesce("_own", "_usual").alias("category_id"), F.coalesce("payment_methods", F.lit("")).alias("payment_methods")
    )


def with_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Classified ``rows`` (merchant_key, category_id, category_source) under the users' merchant rules: overrides stay, then the alias' category counts; its role stands in ``merchant_role``.

    aliases: merchant_key, category_id, economic_role; a few hundred rows of the user.
    """
    own = aliases.select(F.col("merchant_key").alias("_key"), F.col("category_id").alias("_category"), F.col("economic_role").alias("merchant_role"))
    out = rows.join(own, F.col("merchant_key") == F.col("_key"), "left")
    takes = F.col("_category").isNotNull() & (F.col("category_source") != "override")
    new = {"category_id": F.when(takes, F.col("_category")).otherwise(F.col("category_id")), "category_source": F.when(takes, "merchant_rule").otherwise(F.col("category_source"))}
    return out.withColumns(new).drop("_key", "_category")


def is_withdrawal(item: dict[str, Column]) -> Column:
    """A cash withdrawal whose use is unknown: a TWD outflow of a bank account, spending, uncategorised, no duplicate and no fee.

    ``item``: source, amount, currency, role, category_id, duplicate (boolean), text.
    """
    text = F.coalesce(item["text"], F.lit(""))
    words = text.rlike(f"(?iu){C.WITHDRAWAL}") & ~text.rlike(f"(?iu){C.FEE}")
    test = (item["source"] == "bank") & (item["currency"] == "TWD") & (item["amount"] < 0) & (item["role"] == "spending") & ~F.coalesce(item["duplicate"], F.lit(False))
    return F.coalesce(test & F.coalesce(item["category_id"], F.lit("other")).isin("misc", "other") & words, F.lit(False))
