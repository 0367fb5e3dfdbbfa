"""The unified activity table: bank and card transactions, invoices, trades and cash expenses in one schema, and what is summed over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.functions import normalise as N
from tallyforge.functions.search import Search
from tallyforge.operators.ledger import visible

# Titles and institutions of rows that have none of their own, reasons of incompleteness in their order.
BANK, CARD, INVOICE, INVESTMENT, TRADE, CASH = "銀行", "信用卡", "電子發票", "投資", "投資交易", "現金"
BANK_TITLE, CASH_TITLE = "銀行交易", "現金支出"
REASONS = ("missing_exchange_rates", "classification_unavailable", "role_overrides_unavailable", "own_accounts_unavailable")
SCHEMA = (
    "id string, source string, date string, has_time boolean, title string, subtitle string, institution_name string, amount decimal(18,2), currency string, category_id string, role string, reason string, "
    "review string, duplicate_kind string, duplicate_of string, event_kind string, counterparty string, status string, invoice_id string, remaining decimal(18,2), last4 string"
)
_COLUMNS = [x.split(" ", 1) for x in SCHEMA.split(", ")]


def _shaped(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """``made`` in the order and types of the schema; absent columns are null."""
    return rows.select(*(made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _COLUMNS))


def bank_items(transactions: DataFrame, matched: DataFrame) -> DataFrame:
    """Transactions with role (:func:`tallyforge.operators.ledger.activity`); a matched invoice lends its time and number.

    matched: transaction_id, invoice_id, invoice_date, invoice_number, seller_name; one a transaction.
    """
    m = matched.select(F.col("transaction_id").alias("id"), "invoice_id", F.col("invoice_date").alias("_when"), F.col("invoice_number").alias("_number"))
    rows = transactions.join(m, "id", "left")
    card = F.col("account_type") == "credit"
    timed = C.has_offset(F.col("_when"))
    return _shaped(
        rows,
        {
            "id": F.col("id"), "source": F.when(card, "card").otherwise("bank"), "date": F.coalesce(F.when(timed, F.col("_when")), F.col("authorized_at"), F.col("posted_date"), F.lit("")),
            "has_time": C.has_offset(F.col("authorized_at")) | timed, "title": F.coalesce("description", "counterparty", F.lit(BANK_TITLE)),
            "subtitle": F.concat_ws(" · ", F.when(card, CARD).otherwise(BANK), F.col("account_last4"), F.col("_number")), "institution_name": F.when(card, CARD).otherwise(BANK), "amount": F.col("amount"), "currency": F.col("currency"),
            "category_id": F.coalesce("category_id", F.lit("other")), "role": F.col("role"), "reason": F.col("role_source"), "review": F.col("review"), "counterparty": F.col("advance_counterparty"), "status": F.col("status"),
            "invoice_id": F.col("invoice_id"), "last4": F.col("account_last4"),
        },
    )


def invoice_items(invoices: DataFrame, roles: DataFrame, merged: bool = False) -> DataFrame:
    """Invoices with their roles (id, role, reason, review, duplicate_of); ``merged`` leaves out those that a transaction shows."""
    rows = invoices.join(roles, "id", "left")
    if merged:
        rows = rows.filter("duplicate_of is null")
    return _shaped(
        rows,
        {
            "id": F.col("id"), "source": F.lit("invoice"), "date": F.col("invoice_date"), "has_time": C.has_offset(F.col("invoice_date")), "title": F.coalesce("seller_name", F.lit(INVOICE)), "subtitle": F.coalesce("invoice_number", F.lit("")),
            "institution_name": F.lit(INVOICE), "amount": F.col("amount"), "currency": F.col("currency"), "role": F.col("role"), "reason": F.col("reason"), "review": F.col("review"),
            "duplicate_kind": F.when(F.col("duplicate_of").isNotNull(), "bank_transaction"), "duplicate_of": F.col("duplicate_of"), "status": F.lit("issued"), "invoice_id": F.col("id"),
        },
    )


def trade_items(trades: DataFrame) -> DataFrame:
    """Trades are listed as investments and never counted; a price of 1 is a placeholder, so the amount is unknown."""
    return _shaped(
        trades,
        {
            "id": F.col("id"), "source": F.lit("investment"), "date": F.coalesce(C.republican_date(F.coalesce("trade_date", "posted_date")), F.lit("")), "has_time": F.lit(False), "title": F.coalesce("name", "symbol", F.lit(TRADE)),
            "subtitle": F.coalesce("transaction_name", F.lit("")), "institution_name": F.lit(INVESTMENT), "amount": F.when(F.col("price") == 1, None).otherwise(F.col("amount")), "currency": F.col("currency"), "role": F.lit("investment"),
            "reason": F.lit("trade"), "review": F.lit("auto"), "event_kind": N.investment_event(F.col("transaction_name")), "status": F.lit("done"),
        },
    )


def cash_items(expenses: DataFrame) -> DataFrame:
    """Cash expenses are confirmed spending in TWD."""
    return _shaped(
        expenses,
        {
            "id": F.col("id"), "source": F.lit("cash"), "date": F.col("expense_date").cast("string"), "has_time": F.lit(False), "title": F.coalesce("description", F.lit(CASH_TITLE)), "subtitle": F.lit(CASH), "institution_name": F.lit(CASH),
            "amount": -F.col("amount"), "currency": F.lit("TWD"), "category_id": F.col("category_id"), "role": F.lit("spending"), "reason": F.lit("cash_expense"), "review": F.lit("confirmed"), "status": F.lit("posted"),
        },
    )


def unified(parts: list[DataFrame], rates: DataFrame) -> DataFrame:
    """The parts together with day, month, and what counts in TWD: ``counted`` (signed, six decimals, null without a rate) and ``twd`` (cents).

    A cash withdrawal counts with what its cash expenses leave (``remaining``).
    """
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.unionByName(other)
    rows = rows.join(rates, "currency", "left").withColumn("day", C.activity_day(F.col("date"), F.col("has_time")))
    signed = F.coalesce(-F.col("remaining"), C.signed_amount(F.col("source"), F.col("amount")))
    counted = C.to_twd(signed, F.col("currency"), F.col("rate_to_twd")).cast("decimal(24,6)")
    twd = C.cents(C.to_twd(F.col("amount"), F.col("currency"), F.col("rate_to_twd"))).cast("decimal(18,2)")
    return rows.withColumns({"month": F.date_format("day", "yyyy-MM"), "signed": signed, "counted": counted, "twd": twd}).drop("rate_to_twd")


def _role() -> Column:
    return F.coalesce("role", F.when(F.col("counted") > 0, "income").otherwise("spending"))


def month_summary(items: DataFrame, months: DataFrame | None = None, issues: tuple[str, ...] = ()) -> DataFrame:
    """Totals per month over the unified table; trades are not counted.

    Tests in order: excluded, missing rate, duplicate, advance, reimbursement, then the role.  One grouped aggregate with
    partial sums before the only shuffle.  ``months`` adds months without rows and drops all others.
    """
    amount, role, gone = F.col("counted"), _role(), F.col("role") == "excluded"
    out = F.coalesce(gone, F.lit(False))
    known = ~out & F.col("signed").isNotNull() & amount.isNotNull()
    own = known & F.col("duplicate_of").isNull()
    plain = own & ~role.isin("advance", "reimbursement")
    invoice = ~out & (F.col("source") == "invoice")
    total = lambda test, value: C.cents(F.coalesce(F.sum(F.when(test, value)), F.lit(0)))
    review = F.col("review") == "needs_review"
    missing = F.array_sort(F.collect_set(F.when(~out & F.col("signed").isNotNull() & amount.isNull() & F.col("duplicate_of").isNull(), F.col("currency"))))
    found = items.filter(C.is_counted(F.col("source"))).groupBy("month").agg(
        total(plain & (role == "income"), amount).alias("income"),
        total(plain & (role == "spending"), -amount).alias("spending"),
        total(plain & (role == "investment"), -amount).alias("investment"),
        total(plain & (role == "own_transfer") & (amount < 0), -amount).alias("own_transfer"),
        total(plain & (role == "card_payment") & (amount < 0), -amount).alias("card_payment"),
        C.cents(F.coalesce(F.sum(F.when(plain & (role == "income"), amount).when(plain & (role == "spending"), amount)), F.lit(0))).alias("saved"),
        F.count_if(plain & review).alias("review_count"), total(plain & review, F.abs(amount)).alias("review_amount"),
        total(known & F.col("duplicate_of").isNotNull(), F.abs(amount)).alias("duplicate_excluded"),
        F.count_if(out).alias("excluded_count"), total(out, F.abs(amount)).alias("excluded_amount"),
        F.count_if(own & (role == "advance")).alias("advance_count"), total(own & (role == "advance"), -amount).alias("advance_amount"),
        F.count_if(own & (role == "reimbursement")).alias("reimbursement_count"), total(own & (role == "reimbursement"), amount).alias("reimbursement_amount"),
        F.count_if(plain).alias("activity_count"),
        F.count_if(invoice & F.col("duplicate_of").isNotNull()).alias("invoices_matched"), F.count_if(invoice & F.col("duplicate_of").isNull() & review).alias("invoices_ambiguous"),
        F.count_if(invoice & F.col("duplicate_of").isNull() & ~F.coalesce(review, F.lit(False))).alias("invoices_unmatched"),
        F.array_join(missing, ",").alias("missing_currencies"),
    )
    if months is not None:
        found = months.join(found, "month", "left").fillna(0).fillna("")
    told = [F.when(F.col("missing_currencies") != "", REASONS[0]) if r == REASONS[0] else F.lit(r if r in issues else None) for r in REASONS]
    if REASONS[0] in issues:
        told[0] = F.lit(REASONS[0])
    reasons = F.array_join(F.array_compact(F.array(*told)), ",")
    return found.withColumns({"incomplete_reasons": reasons, "complete": reasons == ""})


def spending(items: DataFrame) -> DataFrame:
    """Rows that count as spending: id, source, day, month, amount (cents), category_id, title, pending."""
    counted = C.is_counted(F.col("source")) & (F.coalesce("role", F.lit("")) != "excluded") & F.col("duplicate_of").isNull() & F.col("counted").isNotNull() & (_role() == "spending")
    rows = items.filter(counted & ~(F.col("remaining").isNotNull() & (F.col("counted") == 0)))
    return rows.select("id", "source", "day", "month", C.cents(-F.col("counted")).alias("amount"), F.coalesce("category_id", F.lit("other")).alias("category_id"), "title", (F.coalesce("status", F.lit("")) == "pending").alias("pending"))


def spending_by_category(items: DataFrame, parents: DataFrame) -> DataFrame:
    """(month, level, category_id, spending): net spending by top category (``top``) and by the category itself (``own``).  parents: id, parent_id."""
    rows = items.filter(C.is_counted(F.col("source")) & F.col("duplicate_of").isNull() & (_role() == "spending") & (F.col("counted") != 0))
    rows = rows.withColumn("own", F.coalesce("category_id", F.lit("other")))
    rows = rows.join(parents.select(F.col("id").alias("own"), F.coalesce("parent_id", "id").alias("_top")), "own", "left").withColumn("top", top_category(F.col("own"), F.col("_top")))
    rows = rows.select("month", "counted", F.inline(F.array(*(F.struct(F.lit(k).alias("level"), F.col(k).alias("category_id")) for k in ("top", "own")))))
    return rows.groupBy("month", "level", "category_id").agg(C.cents(F.sum(-F.col("counted"))).alias("spending"))


def category_maps(items: DataFrame, level: str, parents: DataFrame) -> DataFrame:
    """(month, spending): a MAP of category to net spending a month, its keys in order.  Sums are grouped before entries meet, so a map has a row a category."""
    rows = spending_by_category(items, parents).filter(F.col("level") == level)
    return rows.groupBy("month").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category_id", "spending")))).alias("spending"))


def top_category(own: Column, known_top: Column) -> Column:
    """A known category's top one; unknown ids are ``misc``, none is ``other``."""
    return F.when(own.isNull(), "other").otherwise(F.coalesce(known_top, F.when(own == "other", "other"), F.lit("misc")))


def source_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("month", "source").agg(F.count(F.lit(1)).alias("n"))


def order(items: DataFrame) -> list[Column]:
    """Latest day first (none last), timed before untimed, latest time first, then source and id."""
    at = F.when(F.col("has_time") & C.has_offset(F.col("date")), F.unix_micros(F.try_to_timestamp("date")))
    return [F.desc_nulls_last("day"), at.desc_nulls_last(), F.col("source"), F.col("id")]


def sorted_by(items: DataFrame, mode: str = "date_desc") -> list[Column]:
    """The four sort modes; rows of unknown amount come last in both amount modes."""
    size = F.abs("counted")
    latest = order(items)
    return {
        "date_desc": latest,
        "date_asc": [F.asc_nulls_last("day"), *latest[1:]],
        "amount_desc": [size.desc_nulls_last(), *latest],
        "amount_asc": [size.asc_nulls_last(), *latest],
    }[mode]


def filtered(items: DataFrame, month: str | None = None, since: str | None = None, until: str | None = None, category: str | None = None, flow: str | None = None, source: str | None = None, search: str | None = None) -> DataFrame:
    """Rows of a month or of the days ``since`` to ``until``, of a category, flow (``income``, ``expense``) and source, that a search finds.

    The source ``invoice`` also keeps rows that carry an invoice.
    """
    tests = [F.col("month") == month if month else None, F.col("day") >= F.lit(since).cast("date") if since else None, F.col("day") <= F.lit(until).cast("date") if until else None]
    tests.append(F.coalesce("category_id", F.lit("other")) == category if category else None)
    tests.append({"income": F.col("signed") > 0, "expense": F.col("signed") < 0}[flow] if flow else None)
    tests.append((F.col("source") == source) | (F.col("invoice_id").isNotNull() if source == "invoice" else F.lit(False)) if source else None)
    if search:
        tests.append(C.search_condition(F.concat_ws(" ", "title", "subtitle", "institution_name"), F.col("amount"), search))
    for test in tests:
        if test is not None:
            items = items.filter(test)
    return items


def active_days(items: DataFrame) -> DataFrame:
    """Distinct days with any activity."""
    return items.select("day").filter("day is not null").distinct()


def uncategorised(items: DataFrame) -> DataFrame:
    """Transactions that can be given a category: spending or of no role, of no known use, no duplicates."""
    own = F.col("source").isin("bank", "card") & F.col("duplicate_of").isNull() & (F.coalesce("role", F.lit("spending")) == "spending")
    return items.filter(own & (F.coalesce("category_id", F.lit("other")) == "other"))


def search_days(
    transactions: DataFrame, invoices: DataFrame, lines: DataFrame, trades: DataFrame, notes: DataFrame, categories: DataFrame, search: Search, *, accounts: tuple[str, ...] = (), bans: tuple[str, ...] = (),
    needles: tuple[str, ...] = (), since: str | None = None, until: str | None = None, before: str | None = None, inclusive: bool = False, most: int = 33,
) -> DataFrame:
    """The latest ``most`` days with anything that a search finds: in visible transactions, invoices, their lines, trades, and notes on them.

    transactions: id, day, amount, description, counterparty, account_id, institution_name, account_name, account_last4 and what
    :func:`tallyforge.operators.ledger.visible` needs; invoices: id, day, amount, seller_name, seller_ban, invoice_number; lines: invoice_id,
    description; trades: id, day, amount, name, symbol, transaction_name, transaction_code; notes: kind (``bank_transaction``, ``invoice``), id,
    note; categories: label.  A category that the text names lets all transactions take part, since what is found is narrowed later by the day's
    whole rows.  ``accounts``: ids of accounts that the text names; ``bans`` and ``needles``: sellers and pieces of names that aliases stand for.
    Days lie from ``since`` to ``until`` and before ``before`` (on it too if ``inclusive``).  Lines and notes are semi joins, so nothing is multiplied.
    """
    text = search.text
    joined = lambda *c: F.lower(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in c)))
    named = lambda *c: F.lower(F.replace(F.concat(*(F.coalesce(x, F.lit("")) for x in c)), F.lit(" "), F.lit("")))
    needle = lambda *c: reduce(Column.__or__, (named(*c).contains(x) for x in needles), F.lit(False))
    noted = notes.filter(F.lower("note").contains(text)).select("kind", F.col("id").alias("_id")).distinct()
    lined = lines.filter(F.lower("description").contains(text)).select(F.col("invoice_id").alias("_line")).distinct()
    # one row: whether any category bears the text
    labelled = categories.agg(F.coalesce(F.max(F.lower("label").contains(text)), F.lit(False)).alias("_labelled"))
    on = lambda kind: noted.filter(F.col("kind") == kind).drop("kind")
    bank = visible(transactions).join(on("bank_transaction"), F.col("id") == F.col("_id"), "left").crossJoin(F.broadcast(labelled))
    hit = joined("description", "counterparty", "institution_name", "account_name", "account_last4", F.lit(f"{BANK} {CARD}")).contains(text)
    hit = hit | F.col("account_id").isin(*accounts) | F.col("_labelled") | needle("description", "counterparty") | F.col("_id").isNotNull()
    bank = bank.filter(search.fits(hit, F.col("amount"))).select("day")
    bills = invoices.join(on("invoice"), F.col("id") == F.col("_id"), "left").join(lined, F.col("id") == F.col("_line"), "left")
    hit = joined("seller_name", "invoice_number", F.lit(INVOICE)).contains(text) | F.coalesce(F.col("seller_ban").isin(*bans), F.lit(False)) | needle("seller_name") | F.col("_line").isNotNull() | F.col("_id").isNotNull()
    bills = bills.filter(search.fits(hit, F.col("amount"))).select("day")
    hit = joined("name", "symbol", "transaction_name", "transaction_code", F.lit(INVESTMENT)).contains(text)
    days = bank.unionByName(bills).unionByName(trades.filter(search.fits(hit, F.col("amount"))).select("day")).filter("day is not null")
    limits = [F.col("day") >= F.lit(since).cast("date") if since else None, F.col("day") <= F.lit(until).cast("date") if until else None]
    if before:
        limits.append(F.col("day") <= F.lit(before).cast("date") if inclusive else F.col("day") < F.lit(before).cast("date"))
    for limit in limits:
        if limit is not None:
            days = days.filter(limit)
    return days.distinct().orderBy(F.desc("day")).limit(most)


def _shown_role() -> Column:
    """The role, or what the sign says where there is none; nothing for zero and unknown amounts."""
    return F.coalesce("role", F.when(F.col("signed") > 0, "income").when(F.col("signed") < 0, "spending"))


def viewed(items: DataFrame, tab: str = "ledger", role: str | None = None, review: bool = False, card: str | None = None, slice_: tuple[str, str] | None = None) -> DataFrame:
    """The rows a view lists: the ledger without duplicates or one source as it is, a role, those to review, a card by its transactions' last digits, a slice (category, role) of the totals."""
    rows = items.filter("duplicate_of is null") if tab == "ledger" else items.filter(F.col("source") == tab)
    if role:
        rows = rows.filter(_shown_role() == role)
    if review:
        rows = rows.filter("review = 'needs_review'")
    if card:
        rows = rows.filter((F.col("source") == "card") & (F.col("last4") == card))
    if slice_:
        rows = rows.filter((F.coalesce("category_id", F.lit("other")) == slice_[0]) & (_shown_role() == slice_[1]) & F.col("duplicate_of").isNull())
    return rows


def search_page(items: DataFrame, text: str, after: tuple | None = None, most: int = 30) -> DataFrame:
    """The next ``most`` rows that a search finds, latest day first; ``after``: day and id of the last row seen."""
    found = filtered(items, search=text)
    if after:
        found = found.filter((F.col("day") < F.lit(after[0]).cast("date")) | (F.col("day") == F.lit(after[0]).cast("date")) & (F.col("id") > after[1]))
    return found.orderBy(F.desc_nulls_last("day"), "id").limit(most)


def source_records(items: DataFrame, invoices: DataFrame, today: str, wait: int = 10) -> DataFrame:
    """Activities with the carrier of their invoice, and ``overdue``: an invoice of a card's carrier that waits for its payment for more than ``wait`` days.

    invoices: id, carrier_type, carrier_suffix.
    """
    c = invoices.select(F.col("id").alias("invoice_id"), "carrier_type", "carrier_suffix")
    late = (F.col("source") == "invoice") & F.col("carrier_suffix").isNotNull() & F.col("duplicate_of").isNull() & (F.datediff(F.lit(today).cast("date"), "day") > wait)
    return items.join(c, "invoice_id", "left").withColumn("overdue", F.coalesce(late, F.lit(False)))
