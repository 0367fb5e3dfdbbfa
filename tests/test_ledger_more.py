"""Normalisation, linkage and balance operators: edge cases and brute force (their SQL is in test_ledger)."""

import datetime
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.functions import normalise as N
from tallyforge.operators import cards, ingest, invoices, ledger, linkage, series
from tallyforge.sources.export import export_items

DAY = datetime.date(2024, 1, 1)


def _values(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_normalised_fields(spark):
    text = lambda x: F.lit(x).cast("string")
    got = _values(
        spark,
        period=N.billing_period(text("113/2")), short=N.billing_period(text("13/2")), month=N.billing_period(text("113/13")), none=N.billing_period(text(None)),
        code=N.currency_code(text(None)), bad=N.currency_code(text("12")), event=N.investment_event(text("賣出 股利")), nothing=N.investment_event(text(None)),
        refund=N.card_amount(F.lit(5), text(None)), same=N.names_contain(text("AB-C D Cafe"), text("abcd")), brief=N.names_contain(text("abc"), text("abcd")), blank=N.names_contain(text(""), text("x")),
        placeholder=N.trade_amount(F.lit(93.0), F.lit(1.0)), traded=N.trade_amount(F.lit(3.0), F.lit(-2.5)), card=N.card_last4(text("checking"), text("{}")), day=N.statement_day(text("12/31"), F.lit(2024), F.lit(1)), leap=N.statement_day(text("02/29"), F.lit(2023), F.lit(3)),
        rank=N.source_rank(text(None)), unknown=N.source_rank(text("x")), first=N.first_text(text(" "), text(None), text("c")),
    )
    want = {"period": "2024-02", "short": None, "month": None, "none": None, "code": "TWD", "bad": None, "event": "dividend", "nothing": None, "refund": -5, "same": True, "brief": False, "blank": False}
    want |= {"placeholder": None, "traded": -7, "card": None, "day": datetime.date(2023, 12, 31), "leap": None, "rank": 0, "unknown": -1, "first": "c"}
    assert got == want


def test_feeds_of_repeated_rows_keep_the_greater_number(spark):
    feed = lambda *x: spark.createDataFrame([(k, i) for k, i in x], "k string, i long")
    out = ingest.merge_feeds([feed(("a", 1), ("a", 2)), feed(("a", 7), ("a", 8), ("a", 9), ("b", 7))], ["k"], "i")
    assert sorted((r.k, r.occurrence, r.feed, r.i) for r in out.collect()) == [("a", 1, 0, 1), ("a", 2, 0, 2), ("a", 3, 1, 9), ("b", 1, 1, 7)]


def test_unreadable_holdings_and_uneven_trends(spark):
    rows = spark.createDataFrame([(1, "no json"), (2, None), (3, '[{"symbol":"A","quantity":"x","price":"2"}]')], "id long, payload string")
    assert [(r.id, r.market_value) for r in ingest.holdings(rows, "id", "payload").collect()] == [(3, None)]
    uneven = spark.createDataFrame([(1, [5, 6], [1])], "id long, a array<long>, b array<long>")
    got = {(r.position, r.series): r.value for r in ingest.trend_series(uneven, "id", "a", "b").collect()}
    assert got == {(0, "total"): 5, (0, "fund"): 1, (0, "stock"): 4, (1, "total"): 6, (1, "fund"): None, (1, "stock"): None}


def test_day_ends_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [(a, DAY + datetime.timedelta(d), 100 * d + k, rnd.randint(-2, 2), rnd.randint(0, 4)) for a in "ab" for d in range(40) for k in range(rnd.randint(1, 5))]
    df = spark.createDataFrame(rows, "account_id string, day date, n long, amount long, running long")
    df = df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("amount", "running")})
    got = {(r.account_id, r.day): r.balance for r in series.day_end_balances(df).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted(r for r in rows if r[:2] == key)
        ends = [r for r in own if not any(o is not r and o[4] - o[3] == r[4] for o in own)]
        want[key] = (ends if len(ends) == 1 else own)[-1][4]
    assert got == want


def test_own_accounts_ties_and_short_suffixes(spark):
    owned = spark.createDataFrame([("x", "1", "2345", "own_account", 0), ("y", "1", "2345", "unsynced_card", 1), ("z", "1", "12345", "own_account", 2)], "id string, bank_code string, account_suffix string, kind string, position int")
    rows = spark.createDataFrame([("a", "1", "92345"), ("b", "1", "12345"), ("c", "2", "12345"), ("d", "1", "345"), ("e", None, None)], "id string, bank_code string, account_suffix string")
    assert {r.id: r.own_id for r in linkage.own_account_matches(rows, owned).collect()} == {"a": "x", "b": "z"}


def test_fees_prefer_latin_names_and_stay_open_when_in_doubt(spark):
    schema = "id string, account_id string, day date, amount double"
    fees = spark.createDataFrame([("f", "a", DAY, 15.0, None), ("g", "b", DAY, 15.0, None), ("h", "c", DAY, 1.0, 777.0)], schema + ", base double")
    bought = spark.createDataFrame([("p", "a", DAY, 1000.0, "商店"), ("q", "a", DAY, 1010.0, "shop"), ("r", "b", DAY, 1000.0, "x"), ("s", "b", DAY, 1000.0, "y"), ("t", "c", DAY, 777.2, None)], schema + ", text string")
    assert {r.fee_id: r.purchase_id for r in linkage.foreign_fees(fees, bought).collect()} == {"f": "q", "h": "t"}


def test_roles_and_empty_inputs(spark):
    none = F.lit(None)
    s = {"role": F.lit("spending"), "reason": F.lit("sign"), "review": none.cast("string"), "status": F.lit("ambiguous"), "overdue": none.cast("boolean"), "voided": none.cast("boolean"), "duplicate": none.cast("boolean")}
    assert tuple(spark.range(1).select(invoices.resolved_role(s).alias("r")).first().r) == ("spending", "invoice_ambiguous", "needs_review")
    empty = spark.createDataFrame([], "id string, seller string, merchant string, account_id string, amount long, day date")
    assert linkage.late_invoices(empty, empty, empty.select("seller", "account_id", "merchant")).count() == 0
    assert ledger.usable_months(spark.createDataFrame([], "month string, activity_count long, income double")).first().usable_months == 0
    items = spark.createDataFrame([("i", 1, None, None), ("j", 1, 0, "a"), ("j", 2, None, "b")], "invoice_id string, line_number int, amount int, category_id string")
    assert [tuple(r) for r in ledger.item_category(items).collect()] == [("j", "a")]


def test_carried_months_end_at_the_last_or_later(spark):
    first = lambda m: datetime.date(2024, m, 1)
    points = spark.createDataFrame([("a", first(1), 1), ("a", first(3), 2), ("b", first(6), 5)], "k string, month date, value long")
    got = sorted((r.k, r.month.month, r.value) for r in series.carry_forward(points, "k", "2024-04-01").collect())
    assert got == [("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("a", 4, 2), ("b", 6, 5)]


def test_export_masks_and_parts_by_month(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2024-01", "to 1234567890", None), ("2", "2024-02", "short 123", "x")], "id string, month string, description string, counterparty string")
    export_items(rows, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("month=2024-01/*.json") for x in p.read_text().splitlines()]
    assert lines == [{"id": "1", "description": "to ****7890"}]


def test_carriers_restrict_and_raise_edges(spark):
    edges = spark.createDataFrame([(1, 10, 0, True, 8), (1, 11, 0, True, 8), (2, 11, 1, True, 7), (1, 12, 0, True, 8)], "invoice_id long, transaction_id long, gap int, exact boolean, score int")
    carriers = spark.createDataFrame([(1, "0042"), (2, None)], "id long, carrier_suffix string")
    cards = spark.createDataFrame([(10, "credit", "0042"), (11, "credit", "0001"), (12, "checking", "0042")], "id long, account_type string, account_last4 string")
    got = sorted((r.invoice_id, r.transaction_id, r.score) for r in linkage.carrier_edges(edges, carriers, cards).collect())
    assert got == [(1, 10, 8 + linkage.CARRIER), (2, 11, 7)]


def test_linked_invoices_compete_for_a_transaction(spark):
    rows = spark.createDataFrame([(3, 9, "linked"), (2, 9, "linked"), (4, None, "separate"), (5, None, "linked")], "invoice_id long, transaction_id long, decision string")
    got = sorted((r.invoice_id, r.transaction_id, r.outcome) for r in linkage.preferred_links(rows).collect())
    assert got == [(2, 9, "linked"), (4, None, "separate")]


def test_deposit_events_are_counted_not_paired(spark):
    rng = random.Random(7)
    day = lambda k: DAY + datetime.timedelta(days=k)
    deposits, legs = [], []
    for k in range(400):
        opened = rng.random() < 0.5
        # of large amounts few, so that some are unique; a deposit may be opened and withdrawn, and a leg told twice
        deposits.append((f"d{k - (k % 9 == 8)}", rng.choice(["opened", None if k % 50 == 7 else "opened"]) if opened else "withdrawn", rng.choice(["TWD", "TWD", "JPY"]), rng.choice([0, 1, 2, rng.randrange(3, 150)]), day(rng.randrange(40)), None if k % 31 == 3 else day(rng.randrange(40))))
        legs.append((f"t{k - (k % 11 == 10)}", rng.choice(["s1", "s1", "s2"]), "TWD", rng.choice(["posted", "posted", "pending"]), rng.choice([-1, 1]) * rng.choice([1, 2, rng.randrange(3, 150)]), day(rng.randrange(45))))
    today = day(42)
    pairs = []
    for name, kind, currency, balance, opened, seen in deposits:
        for leg, account, _, status, amount, at in legs:
            wanted = -balance if kind == "opened" else balance
            if currency == "TWD" and balance > 0 and account == "s1" and status == "posted" and at <= today and amount == wanted and (at == opened if kind == "opened" else seen is not None and at > seen):
                pairs.append((name, kind, leg, at, -amount))
    ends = [Counter(p[0] for p in pairs), Counter(p[2] for p in pairs)]
    want = {p for p in pairs if ends[0][p[0]] == 1 and ends[1][p[2]] == 1}
    frames = (
        spark.createDataFrame(deposits, "deposit_id string, kind string, currency string, balance long, opened date, last_seen date"),
        spark.createDataFrame([("s1", "savings", "TWD"), ("s2", "savings", "JPY"), ("s3", "savings", "JPY")], "id string, account_type string, currency string"),
        spark.createDataFrame(legs, "id string, account_id string, currency string, status string, amount long, day date"),
    )
    found = cards.deposit_events(*frames, str(today))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 10 and {p[1] for p in want} >= {"opened", "withdrawn"}
    # no join says that one day lies after another
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and not any(" > " in x or " < " in x for x in joins)
