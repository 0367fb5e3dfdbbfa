"""Cards: whose bill a payment pays, sums a card, authorisations with postings, and deposit events with their principal."""

from __future__ import annotations

import itertools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.functions.text import name_key

# Fee words, the least likeness of names, the weights of an exact amount, a name and a near amount, and of the same record.
FEE_WORDS, LEAST_LIKENESS = "手續費|服務費|FEE", 0.3
EXACT_WEIGHT, NAME_WEIGHT, NEAR_WEIGHT, SAME_WEIGHT = 2000.0, 1000.0, 100.0, 10000.0
WITHIN_LEAST, WITHIN_LIKENESS = 5, 0.95


def payment_sides(payments: DataFrame, accounts: DataFrame, banks: DataFrame) -> DataFrame:
    """(id, issuer, side): a card payment with the issuer whose bill it pays, seen on the card (money in) or at a bank (money out).

    payments: id, account_id, account_type, amount, role, duplicate (boolean), bank_code (of the counterparty, else named in the text);
    accounts: issuer, account_id of its cards; banks: issuer, bank_code.
    """
    rows = payments.filter((F.col("role") == "card_payment") & ~F.coalesce("duplicate", F.lit(False)))
    own = rows.join(accounts, "account_id")
    card = own.filter("amount > 0").select("id", "issuer", F.lit("card").alias("side"))
    rest = rows.join(accounts.select("account_id").distinct(), "account_id", "left_anti").filter("account_type <> 'credit' and amount < 0 and bank_code is not null")
    return card.unionByName(rest.join(banks.filter("bank_code is not null"), "bank_code").select("id", "issuer", F.lit("bank").alias("side")))


def card_sums(lines: DataFrame, cards: DataFrame, since: str, statement: tuple[str, str] | None) -> DataFrame:
    """(account_id, last4, unbilled, pending, unbilled_count, statement_amount, statement_count, missing_currencies) of each card, also those without lines.

    lines: account_id, last4 (null: the account's only card), day (of billing), status, amount, currency, rate_to_twd; cards: account_id,
    last4.  Amounts are net charges; lines in currencies without a rate are named, not counted.
    """
    value = C.to_twd(-F.col("amount"), F.col("currency"), F.col("rate_to_twd"))
    open_ = F.col("day") >= F.lit(since).cast("date")
    billed = F.col("day").between(*(F.lit(x).cast("date") for x in statement)) if statement else F.lit(False)
    exact = value.cast("decimal(24,6)")
    total = lambda test: C.cents(F.coalesce(F.sum(F.when(test, exact)), F.lit(0)))
    known = exact.isNotNull()
    sums = lines.filter(open_ | billed).groupBy("account_id", F.coalesce("last4", F.lit("")).alias("last4")).agg(
        total(open_).alias("unbilled"), total(open_ & (F.col("status") == "pending")).alias("pending"), F.count_if(open_ & known).alias("unbilled_count"), total(billed).alias("statement_amount"), F.count_if(billed & known).alias("statement_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(~known, F.col("currency")))), ",").alias("missing_currencies"),
    )
    all_cards = cards.select("account_id", F.coalesce("last4", F.lit("")).alias("last4")).distinct()
    out = all_cards.join(sums, ["account_id", "last4"], "full").fillna(0, ["unbilled", "pending", "unbilled_count", "statement_amount", "statement_count"]).fillna("", ["missing_currencies"])
    return out if statement else out.withColumn("statement_amount", F.lit(None).cast("double"))


def listed_cards(accounts: DataFrame) -> DataFrame:
    """(account_id, last4) of cards: the account's own digits, and those of its JSON's ``cards`` or ``cardLast4s`` that the issuer's accounts do not have.

    accounts: id, issuer, account_last4, raw_payload.
    """
    own = accounts.filter("account_last4 is not null").select("issuer", F.col("id").alias("account_id"), F.col("account_last4").alias("last4"))
    raw = F.col("raw_payload")
    one = F.from_json(F.get_json_object(raw, "$.cards"), "array<struct<last4:string>>")
    many = F.from_json(F.get_json_object(raw, "$.cardLast4s"), "array<string>")
    listed = F.concat(F.coalesce(F.transform(one, lambda x: x["last4"]), F.array().cast("array<string>")), F.coalesce(many, F.array().cast("array<string>")))
    more = accounts.select("issuer", F.col("id").alias("account_id"), F.explode(listed).alias("last4")).filter(F.col("last4").rlike("^[0-9]{4}$")).dropDuplicates(["issuer", "last4"])
    return own.unionByName(more.join(own.select("issuer", "last4").distinct(), ["issuer", "last4"], "left_anti").select("issuer", "account_id", "last4")).select("account_id", "last4").distinct()


#: What stands before a merchant's name in card texts: a channel up to a slash, or a mark.
_BEFORE_NAME = re.compile(r"^(?:[^/]+/)?(?:A\s*-\s*)?")


def _pairs_of(name: str) -> tuple[str, frozenset[str]]:
    """A card text's letters and digits in upper case, and the pairs of characters that follow each other."""
    x = name_key(_BEFORE_NAME.sub("", unicodedata.normalize("NFKC", name or "").upper()), None).upper()
    return x, frozenset(map("".join, itertools.pairwise(x)))


def likeness(left: str, right: str) -> float:
    """1 for equal names, 0.95 where one holds the other, else Dice's share of common character pairs."""
    (a, of_a), (b, of_b) = _pairs_of(left), _pairs_of(right)
    short, long = sorted((a, b), key=len)
    held = WITHIN_LIKENESS if len(short) >= WITHIN_LEAST and short in long else 0.0
    dice = 2 * len(of_a & of_b) / (len(of_a) + len(of_b)) if of_a and of_b else 0.0
    return 0.0 if not short else 1.0 if a == b else held or dice


def best_assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of greatest total weight among the positive ones: shortest augmenting paths on reduced costs."""
    n, m = weights.shape
    cost = np.concatenate([-weights, np.zeros((n, n))], axis=1)  # a row may stay alone
    rows, cols, owner = np.zeros(n), np.zeros(m + n), np.full(m + n, -1)
    for start in range(n):
        reach, back, closed = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        row, col, far = start, -1, 0.0
        while True:
            step = far + cost[row] - rows[row] - cols
            better = ~closed & (step < reach)
            reach[better], back[better] = step[better], col
            col = int(np.argmin(np.where(closed, np.inf, reach)))
            far, closed[col] = reach[col], True
            if owner[col] < 0:
                break
            row = owner[col]
        # potentials of what was visited move by what the path still lacks
        for c in np.flatnonzero(closed):
            cols[c] += reach[c] - far
            if owner[c] >= 0:
                rows[owner[c]] += far - reach[c]
        rows[start] += far
        while col >= 0:
            before = back[col]
            owner[col] = owner[before] if before >= 0 else start
            col = before
    return [(int(owner[c]), c) for c in range(m) if owner[c] >= 0 and weights[owner[c], c] > 0]


def authorisation_matches(authorisations: DataFrame, posted: DataFrame, rates: dict[str, float]) -> DataFrame:
    """(authorisation_id, posted_id): within a card and day the pairs of greatest total likeness.

    Both: id, source_id, card, day, amount, currency, description.  A card's purchases of a day are few, so a group is one task.
    Pairs need the same sign, no fee, and the same amount or like names.
    """
    names = ["id", "source_id", "card", "day", "amount", "currency", "description"]
    both = authorisations.select(*names).withColumn("side", F.lit(0)).unionByName(posted.select(*names).withColumn("side", F.lit(1)))
    kind = dict(both.dtypes)["id"]

    def weight(a, b) -> float:
        if not a.amount or not b.amount or (a.amount > 0) != (b.amount > 0) or re.search(FEE_WORDS, f"{a.description} {b.description}", re.I):
            return 0.0
        if a.source_id == b.source_id:
            return SAME_WEIGHT
        exact, name = a.currency == b.currency and a.amount == b.amount, likeness(a.description, b.description)
        if not exact and name < LEAST_LIKENESS:
            return 0.0
        x, y = (abs(r.amount) * (1.0 if r.currency == "TWD" else rates.get(r.currency, 0.0)) for r in (a, b))
        return EXACT_WEIGHT * exact + NAME_WEIGHT * name + (NEAR_WEIGHT * min(x, y) / max(x, y) if min(x, y) > 0 else 0.0)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        a = list(part[part.side == 0].sort_values("source_id").itertuples())
        b = list(part[part.side == 1].sort_values("id").itertuples())
        found = best_assignment(np.array([[weight(x, y) for y in b] for x in a])) if a and b else []
        return pd.DataFrame([(a[i].id, b[j].id) for i, j in found], columns=["authorisation_id", "posted_id"])

    # only cards and days with both sides go to Python
    sides = both.groupBy("card", "day").agg(F.count_distinct("side").alias("n")).filter("n = 2").select("card", "day")
    rows = both.join(sides, ["card", "day"]).withColumn("amount", F.col("amount").cast("double"))
    return rows.groupBy("card", "day").applyInPandas(run, f"authorisation_id {kind}, posted_id {kind}")


def deposit_events(deposits: DataFrame, accounts: DataFrame, transactions: DataFrame, today: str) -> DataFrame:
    """(deposit_id, kind, transaction_id, day, amount): deposits opened or withdrawn with their principal leg in the only savings account of the currency, unique both ways.

    deposits: deposit_id, kind, currency, balance, opened (the contract's day), last_seen (the last day a withdrawn one was there);
    accounts: id, account_type, currency; transactions: id, account_id, currency, status, amount, day.
    """
    only = accounts.filter("account_type = 'savings'").groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("account_id")).filter("n = 1").drop("n")
    opened = F.coalesce(F.col("kind") == "opened", F.lit(False))
    d = deposits.filter("balance > 0").join(only, "currency").withColumn("amount", F.when(opened, -F.col("balance")).otherwise(F.col("balance")))
    d = d.withColumn("at", F.when(opened, F.col("opened")).otherwise(F.col("last_seen"))).filter("at is not null")
    legs = transactions.filter((F.col("status") == "posted") & (F.col("day") <= F.lit(today).cast("date"))).select(F.col("id").alias("transaction_id"), "account_id", "currency", "amount", F.col("day").alias("at"))
    keys = ["account_id", "currency", "amount"]
    # how many fit each other is told by the day, so pairs are never made to be counted: a row a key, side and day
    numbers = lambda test, name, of: (F.count_if(test).alias(f"{name}_n"), F.min(F.when(test, F.col(of))).alias(f"{name}_id"))
    each = d.groupBy(*keys, "at").agg(*numbers(opened, "opened", "deposit_id"), *numbers(~opened, "withdrawn", "deposit_id"))
    daily = each.join(legs.groupBy(*keys, "at").agg(*numbers(F.lit(True), "legs", "transaction_id")), [*keys, "at"], "full").fillna(0, ["opened_n", "withdrawn_n", "legs_n"])
    rising, falling = (Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1) for x in (F.asc("at"), F.desc("at")))
    before = lambda w, c: (F.coalesce(F.sum(f"{c}_n").over(w), F.lit(0)).alias(f"{c}_more"), F.min(f"{c}_id").over(w).alias(f"{c}_far"))
    lined = daily.select("*", *before(rising, "withdrawn"), *before(falling, "legs"))
    # an opened deposit has the legs of its day, a withdrawn one those after it
    fit = lambda is_opened, name, one: lined.select(*keys, "at", F.lit(is_opened).alias("is_opened"), F.col(name).alias("n"), F.col(one).alias("transaction_id")).filter("n > 0")
    of_d = fit(True, "legs_n", "legs_id").unionByName(fit(False, "legs_more", "legs_far"))
    of_leg = lined.select(*keys, "at", (F.col("opened_n") + F.col("withdrawn_more")).alias("n"), F.coalesce(F.when(F.col("opened_n") > 0, F.col("opened_id")), F.col("withdrawn_far")).alias("deposit_id")).filter("n > 0")
    one = lambda rows, by, *kept: rows.groupBy(by).agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in kept)).filter("n = 1").drop("n")
    only_d = one(d.withColumn("is_opened", opened).join(of_d, [*keys, "at", "is_opened"]), "deposit_id", "transaction_id", "kind", "amount")
    only_leg = one(legs.join(of_leg, [*keys, "at"]), "transaction_id", "deposit_id", "at")
    return only_d.join(only_leg, ["deposit_id", "transaction_id"]).select("deposit_id", "kind", "transaction_id", F.col("at").alias("day"), (-F.col("amount")).alias("amount"))


def is_payment_credit(text: Column, amount: Column) -> Column:
    """Money in on a card that is a payment, not a refund."""
    return F.coalesce((amount > 0) & text.rlike("(?i)繳款|扣繳|自扣|還款|payment") & ~text.rlike("(?i)退款|退貨|退費|折讓|回饋|refund|cashback"), F.lit(False))


def assigned_payments(bills: DataFrame, payments: DataFrame) -> DataFrame:
    """(bill_id, payment_id, paid, is_paid): each payment takes one bill of its card and currency, first one whose period or due month is the payment's, else the newest; no bill twice.

    bills: bill_id, card, currency, billing_period, due_date, statement_amount, paid; payments: payment_id, card, currency, day,
    amount.  Payments are taken in the order of day and id.  A card's bills are few, so a card is one task.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    b = bills.select("card", "currency", F.lit(0).alias("kind"), F.col("bill_id").alias("id"), "billing_period", text("due_date"), F.col("statement_amount").cast("double").alias("statement"), F.col("paid").cast("double").alias("amount"))
    none = F.lit(None)
    p = payments.select("card", "currency", F.lit(1).alias("kind"), F.col("payment_id").alias("id"), F.col("day").cast("string").alias("billing_period"), none.cast("string").alias("due_date"), none.cast("double").alias("statement"), F.col("amount").cast("double").alias("amount"))
    kind = dict(b.dtypes)["id"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        open_ = list(part[part.kind == 0].sort_values("billing_period", ascending=False).itertuples())
        out = []
        for x in part[part.kind == 1].sort_values(["billing_period", "id"]).itertuples():
            month = x.billing_period[:7]
            found = next((k for k in open_ if k.billing_period == month or (k.due_date or "")[:7] == month), open_[0] if open_ else None)
            if found is None:
                break
            open_.remove(found)
            paid = (found.amount if found.amount == found.amount and found.amount is not None else 0.0) + x.amount
            known = found.statement is not None and found.statement == found.statement
            out.append((found.id, x.id, paid, bool(paid >= found.statement) if known else None))
        return pd.DataFrame(out, columns=["bill_id", "payment_id", "paid", "is_paid"])

    return b.unionByName(p).groupBy("card", "currency").applyInPandas(run, f"bill_id {kind}, payment_id {kind}, paid double, is_paid boolean")
