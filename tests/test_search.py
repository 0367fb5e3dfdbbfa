"""Search lines, views and the day search on a few rows."""

from datetime import date

import pytest

from tallyforge.functions.search import Search
from tallyforge.operators import items


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("", Search("")), ("  ＣＡＦＥ nero ", Search("cafe nero")), ("120", Search("120", (("=", 120.0),), True)), ("NT$1,200", Search("nt$1,200", (("=", 1200.0),), True)), ("> 1000", Search("", ((">", 1000.0),))),
        ("cafe >=100 <200", Search("cafe", ((">=", 100.0), ("<", 200.0)))), ("300-100", Search("", ((">=", 100.0), ("<=", 300.0)))), ("100~300 x", Search("x", ((">=", 100.0), ("<=", 300.0)))), ("120 tea", Search("120 tea")), ("=5", Search("", (("=", 5.0),))),
        ("a-b", Search("a-b")), ("0077-", Search("0077-")),
    ],
)
def test_search_lines(line, want):
    assert Search.of(line) == want


def _days(spark, line, **more):
    d = lambda k: date(2024, 1, k)
    transactions = [
        ("t1", d(1), 10.0, "Tea House", None, "a1", "Bank One", "Main", "1234", None, "posted", None), ("t2", d(2), -120.0, None, "T e a", "a2", None, None, None, None, "posted", None),
        ("t3", d(3), 10.0, "tea merged", None, "a3", None, None, None, "a1", "posted", None), ("t4", d(4), 10.0, "tea pending", None, "a1", None, None, None, None, "pending", "t9"), ("t5", d(5), None, "tea pending", None, "a1", None, None, None, None, "pending", None),
    ]
    transactions = spark.createDataFrame(transactions, "id string, day date, amount double, description string, counterparty string, account_id string, institution_name string, account_name string, account_last4 string, canonical_account_id string, status string, matched_transaction_id string")
    invoices = spark.createDataFrame([("i1", d(11), 120.0, "Tea 120", None, "AB1"), ("i2", d(12), 5.0, None, "87654321", None), ("i3", None, 5.0, "tea", None, None)], "id string, day date, amount double, seller_name string, seller_ban string, invoice_number string")
    lines = spark.createDataFrame([("i2", "green TEA"), ("i2", "tea"), ("i9", None)], "invoice_id string, description string")
    trades = spark.createDataFrame([("x", d(20), None, "Tea Fund", None, None, None)], "id string, day date, amount double, name string, symbol string, transaction_name string, transaction_code string")
    notes = spark.createDataFrame([("bank_transaction", "t2", "bought tea"), ("invoice", "t1", "nothing"), ("invoice", "i1", "for 99")], "kind string, id string, note string")
    categories = spark.createDataFrame([("Food",)], "label string")
    return [r.day.day for r in items.search_days(transactions, invoices, lines, trades, notes, categories, Search.of(line), **more).collect()]


def test_days_found(spark):
    assert _days(spark, "TEA") == [20, 12, 11, 5, 2, 1]
    assert _days(spark, "120") == [11, 2] and _days(spark, "tea >=100") == [11, 2] and _days(spark, "<=10") == [12, 1]
    assert _days(spark, "99") == [11] and _days(spark, "food") == [5, 2, 1] and _days(spark, "bank one") == [1] and _days(spark, "投資") == [20]
    assert _days(spark, "zzz", bans=("87654321",), needles=("tea",), accounts=("a1",)) == [12, 11, 5, 2, 1]
    assert _days(spark, "tea", before="2024-01-12") == [11, 5, 2, 1] and _days(spark, "tea", before="2024-01-12", inclusive=True, since="2024-01-05", until="2024-01-19") == [12, 11, 5] and _days(spark, "tea", most=2) == [20, 12]


def test_views(spark):
    rows = [
        ("b", "bank", None, "spending", None, "other", "1", -5.0, "auto"), ("c", "card", "4321", None, None, None, "12349999", -5.0, "auto"), ("d", "card", "9999", "spending", None, "other", "4321", -5.0, "needs_review"), ("i", "invoice", None, "spending", None, None, "4321", -1.0, "auto"),
        ("k", "card", None, "spending", "i", "other", "4321", -5.0, "auto"), ("m", "cash", None, "spending", None, "other", "", -5.0, "confirmed"), ("n", "bank", None, None, None, "other", "", 0.0, "auto"), ("o", "bank", None, "income", None, "other", "", 7.0, "auto"),
    ]
    table = spark.createDataFrame(rows, "id string, source string, last4 string, role string, duplicate_of string, category_id string, subtitle string, signed double, review string")
    ids = lambda df: "".join(sorted(r.id for r in df.collect()))
    assert ids(items.uncategorised(table)) == "bcdn"
    assert ids(items.viewed(table)) == "bcdimno" and ids(items.viewed(table, "card")) == "cdk"
    assert ids(items.viewed(table, "card", card="4321")) == "c" and ids(items.viewed(table, card="9999")) == "d"
    assert ids(items.viewed(table, role="spending")) == "bcdim" and ids(items.viewed(table, role="income")) == "o" and ids(items.viewed(table, review=True)) == "d"
    assert ids(items.viewed(table, slice_=("other", "spending"))) == "bcdim"
