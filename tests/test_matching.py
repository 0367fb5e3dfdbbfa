"""Matching operators against brute force: transfers, assignments by weight, invoices issued again, merchant likeness."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tallyforge.functions import banks, text
from tallyforge.operators import cards, linkage, merchants


def augmented(legs):
    """Pairs found leg after leg by breadth-first augmenting paths over all outflows in the order of ids."""
    plus, minus = sorted(r for r in legs if r[4] > 0), sorted(r for r in legs if r[4] < 0)
    taken = {}
    for start in range(len(plus)):
        came, queue, end = {}, [start], None
        for leg in queue:
            for k, other in enumerate(minus):
                if k in came or other[1] == plus[leg][1]:
                    continue
                came[k] = leg
                if k not in taken:
                    end = k
                    break
                queue.append(taken[k])
            if end is not None:
                break
        while end is not None:
            leg = came[end]
            before = next((k for k, v in taken.items() if v == leg), None)
            taken[end] = leg
            end = before if leg != start else None
    return {(plus[v][0], minus[k][0]) for k, v in taken.items()}


def test_pairs_are_those_of_augmenting_paths():
    rnd = random.Random(11)
    for _ in range(600):
        n, accounts = rnd.randint(2, 24), rnd.randint(1, 5)
        legs = [(k, f"a{min(rnd.randrange(accounts), rnd.randrange(accounts))}", "d", "TWD", rnd.choice([10.0, -10.0])) for k in range(n)]
        got = linkage._pair_group(pd.DataFrame(legs, columns=["id", "account_id", "day", "currency", "amount"]))
        assert set(zip(got.into_id, got.out_id, strict=True)) == augmented(legs), legs


def test_pairs_of_a_great_group():
    n = 200_000
    legs = pd.DataFrame({"id": range(n), "account_id": ["hot" if k % 3 else f"a{k % 7}" for k in range(n)], "amount": [10.0 if k * 7 % 5 < 2 else -10.0 for k in range(n)]})
    got = linkage._pair_group(legs)
    account = dict(zip(legs.id, legs.account_id, strict=True))
    assert len(got) == min((legs.amount > 0).sum(), (legs.amount < 0).sum(), n - (legs.account_id == "hot").sum()) and all(account[a] != account[b] for a, b in zip(got.into_id, got.out_id, strict=True))


def test_transfers_are_as_many_as_possible(spark):
    rnd, rows = random.Random(3), []
    for g in range(80):
        for _ in range(rnd.randint(2, 9)):
            rows.append((len(rows), f"a{rnd.randint(0, rnd.choice([1, 2, 4]))}", f"d{g}", "TWD", rnd.choice([10.0, -10.0])))
    legs, groups = {r[0]: r for r in rows}, defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    want = {}
    for g, own in groups.items():
        plus = sum(r[4] > 0 for r in own)
        want[g] = min(plus, len(own) - plus, len(own) - max(Counter(r[1] for r in own).values()))
    got = linkage.transfer_matching(spark.createDataFrame(rows, "id long, account_id string, day string, currency string, amount double")).collect()
    assert Counter(r.day for r in got) == Counter({k: v for k, v in want.items() if v})
    assert len({r.into_id for r in got}) == len({r.out_id for r in got}) == len(got)
    assert all(legs[r.into_id][4] > 0 > legs[r.out_id][4] and legs[r.into_id][1] != legs[r.out_id][1] and legs[r.into_id][2] == legs[r.out_id][2] == r.day for r in got)


def test_best_assignment_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = map(int, rng.integers(1, 5, 2))
        w = rng.integers(0, 5, (n, m)) * rng.integers(0, 2, (n, m)) * 1.0
        pairs = cards.best_assignment(w)
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and all(w[i, j] > 0 for i, j in pairs)
        best = max(sum(w[i, j] for i, j in enumerate(p) if j < m) for p in itertools.permutations(range(n + m), n))
        assert sum(w[i, j] for i, j in pairs) == best


def test_authorisations_meet_their_postings(spark):
    schema = "id string, source_id string, card string, day string, amount double, currency string, description string"
    a = [("a1", "x1", "c", "d", -100.0, "TWD", "UBER EATS"), ("a2", "x2", "c", "d", -100.0, "TWD", "7-ELEVEN"), ("a3", "x3", "c", "d", -31.0, "TWD", "國外手續費"), ("a4", "x4", "c", "e", -10.0, "USD", "STEAM GAMES")]
    p = [("p1", "y1", "c", "d", -100.0, "TWD", "7-ELEVEN TAIPEI"), ("p2", "y2", "c", "d", -100.0, "TWD", "UBER* EATS"), ("p3", "y3", "c", "d", -31.0, "TWD", "手續費"), ("p4", "y4", "c", "e", -321.0, "TWD", "STEAMGAMES.COM"), ("p5", "y5", "c", "e", 10.0, "USD", "STEAM GAMES")]
    got = {(r.authorisation_id, r.posted_id) for r in cards.authorisation_matches(spark.createDataFrame(a, schema), spark.createDataFrame(p, schema), {"USD": 32.0}).collect()}
    assert got == {("a1", "p2"), ("a2", "p1"), ("a4", "p4")}


def test_repeated_invoices_take_turns(spark):
    edges = [(1, 100, 0, False, 8), (2, 100, 0, False, 8), (2, 101, 1, False, 7), (3, 100, 0, False, 8), (7, 200, 0, True, 10), (8, 300, 0, False, 5), (8, 301, 0, False, 5), (9, 301, 0, False, 5)]
    repeats = [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    frame = spark.createDataFrame(edges, "invoice_id long, transaction_id long, gap int, exact boolean, score int")
    got = {tuple(r) for r in linkage.assign_repeats(frame, spark.createDataFrame(repeats, "invoice_id long, anchor long, rank int")).collect()}
    # the second finds the next payment, the third none
    assert got == {(1, 100, "matched", None), (2, 101, "matched", None), (3, None, "repeat", 1), (7, 200, "matched", None), (8, None, "ambiguous", None), (9, None, "ambiguous", None)}


def test_names_are_compared_over_shared_keys_only(spark):
    sellers = ["全聯實業股份有限公司旅順分公司", "Cloudflare Inc.", "老王牛肉麵", "Valve Corp", "甲乙丙丁", "統一超商", None, "The Company"]
    texts = ["全支付﹘全聯", "CLOUDFLAREA3906", "連支＊老王牛肉麵", "STEAMGAMES.COM 425", "丙丁戊己庚", "84149961 統一", "", "the company"]
    s = spark.createDataFrame([(x, "84149961" if x == "統一超商" else None) for x in sellers], "seller string, ban string")
    m = spark.createDataFrame([(x,) for x in texts], "merchant string")
    got = {(r.seller, r.merchant): (r.level, r.brand) for r in merchants.similar_pairs(s, m).collect()}
    want = {(a, b): (level, text.brand_match(a, b)) for a in sellers for b in texts if (level := text.similarity(a, "84149961" if a == "統一超商" else None, b)) != "none"}
    assert got == want and got["Valve Corp", "STEAMGAMES.COM 425"] == ("strong", True) and got["甲乙丙丁", "丙丁戊己庚"][0] == "partial" and got["統一超商", "84149961 統一"][0] == "strong"
    assert text.common_run("甲乙丙丁戊", "丁乙丙戊") == 2

def test_bank_named_in_a_text(spark):
    from pyspark.sql import functions as F

    cases = {"國泰世華銀行轉帳": "013", "玉山 台新": None, "臺灣銀行": "004", "": None, None: None, "台新銀行 台新": "812", "中國信託商業銀行": "822", "遠東商銀ATM": "805", "no bank": None}
    rows = spark.createDataFrame([(k,) for k in cases], "memo string")
    assert {r.memo: r.bank_code for r in merchants.bank_codes(rows, "memo").collect()} == cases
    assert rows.select(banks.code_in_text(F.col("memo")).alias("x")).filter("x is not null").count() == 5


def test_rules_with_prefix_ids_bad_patterns_and_statuses(spark):
    from pyspark.sql import functions as F

    from tallyforge.functions import columns as C
    from tallyforge.operators import ledger

    rule = {"category_id": "c", "economic_role": "spending", "field": "description", "operator": "contains", "pattern": "x", "priority": 1, "direction": "any"}
    rows = spark.createDataFrame([("1", "x", 1.0)], "id string, description string, amount double")
    first = lambda rules: ledger.classify(rows, rules).first().rule_id
    assert first([rule | {"id": "r10"}, rule | {"id": "r1"}]) == "r1"
    assert first([rule | {"id": "a", "updated_at": "2024-01-01"}, rule | {"id": "b", "updated_at": "2024-01-02"}]) == "b"
    assert first([rule | {"id": "a", "operator": "regex", "pattern": "(", "priority": 9}, rule | {"id": "b"}]) == "b"
    told = {"已撤銷": True, "已退回": True, "valid": True, "Cancelled": True, "正常": False, "ISSUED": False, "Confirmed": False, None: False, " ": False, "ＶＯＩＤ": True, "開立": False}
    frame = spark.createDataFrame([(k,) for k in told], "status string")
    assert {r.status: r.v for r in frame.select("status", C.is_voided(F.col("status")).alias("v")).collect()} == told


def test_payments_take_bills_by_month_then_the_newest(spark):
    bills = [("b1", "c", "TWD", "2024-01", "2024-02-10", 100.0, None), ("b2", "c", "TWD", "2024-02", "2024-03-10", 50.0, 20.0), ("b3", "c", "TWD", "2024-03", None, None, None), ("b4", "d", "USD", "2024-01", None, 5.0, None)]
    paid = [("p1", "c", "TWD", "2024-03-05", 30.0), ("p2", "c", "TWD", "2024-02-01", 40.0), ("p3", "c", "TWD", "2024-09-01", 7.0), ("p4", "c", "TWD", "2024-09-02", 7.0), ("p5", "d", "TWD", "2024-01-01", 5.0)]
    b = spark.createDataFrame(bills, "bill_id string, card string, currency string, billing_period string, due_date string, statement_amount double, paid double")
    p = spark.createDataFrame(paid, "payment_id string, card string, currency string, day string, amount double")
    # newest first among equals: the payment of February takes February's bill, March's its own, the third what is left
    assert {tuple(r) for r in cards.assigned_payments(b, p).collect()} == {("b2", "p2", 60.0, True), ("b3", "p1", 30.0, None), ("b1", "p3", 7.0, False)}


def test_export_has_items_by_month_and_summaries(spark, tmp_path):
    from tallyforge.sources import export

    rows = spark.createDataFrame([("2024-01", "paid 1234567890123", 1.0), ("2024-02", "x", 2.0)], "month string, title string, amount double")
    export.export_items(rows, str(tmp_path / "out"), summaries=spark.createDataFrame([("2024-01", 1.0)], "month string, spending double"))
    got = {r.month: r.title for r in spark.read.json(str(tmp_path / "out/items")).collect()}
    assert got == {"2024-01": "paid ****0123", "2024-02": "x"} and spark.read.json(str(tmp_path / "out/summaries")).count() == 1


def test_month_ranges():
    from tallyforge.operators import ledger

    assert ledger.checked_months("2024-03", "2025-02") == ("2024-03-01", "2025-03-01") and ledger.checked_months("2024-12", "2024-12") == ("2024-12-01", "2025-01-01")
    for bad in (("2024-03", "2025-03"), ("2024-03", "2024-02"), ("2024-13", "2024-13")):
        with pytest.raises(ValueError):
            ledger.checked_months(*bad)


@pytest.mark.parametrize("seed", [3, 4])
def test_classes_of_alike_rows_settle_as_all_edges_do(spark, seed):
    rng = random.Random(seed)
    day = pd.Timestamp("2024-01-01").date()
    days = [day + pd.Timedelta(days=k) for k in (0, 0, 1, 4, 9, 10, 30, 31)]
    ids = rng.sample(range(1000), 260)
    invoices = [(ids[k], rng.choice("AB"), rng.choice([100, 110, 300]), rng.choice(days)) for k in range(120)]
    payments = [(ids[120 + k], rng.choice("ABC"), rng.choice([100, 100, 110, 300, 290]), rng.choice(days)) for k in range(140)]
    # one to one, on days of their own
    invoices += [(2000 + k, "A", 500 + k, day + pd.Timedelta(days=100)) for k in range(5)]
    payments += [(3000 + k, "A", 500 + k - 20 * (k % 2), day + pd.Timedelta(days=100 + k)) for k in range(5)]
    i = spark.createDataFrame(invoices, "id long, seller string, amount long, day date")
    p = spark.createDataFrame(payments, "id long, merchant string, amount long, day date")
    rows = lambda df: sorted(map(str, df.select("invoice_id", "transaction_id", "outcome").collect()))
    want = rows(linkage.settled(linkage.candidate_edges(i, p), small=10_000))
    assert rows(linkage.settled_alike(i, p, small=0)) == want
    assert rows(linkage.settled_alike(i, p)) == want
    assert all(any(outcome in x for x in want) for outcome in ("matched", "ambiguous", "blocked"))
    edges = lambda df: sorted(map(str, df.collect()))
    assert edges(linkage.edges_of_alike(i, p)) == edges(linkage.candidate_edges(i, p))
    carried, paid = i.selectExpr("*", "CASE WHEN id % 3 = 0 THEN '77' END AS carrier"), p.selectExpr("*", "id % 2 = 0 AS credit", "string(id % 2 + 76) AS account_last4", "id % 5 > 0 AS outflow")
    assert edges(linkage.edges_of_alike(carried, paid)) == edges(linkage.candidate_edges(carried, paid))


def test_alike_rows_make_no_edges(spark):
    """4,000 equal invoices and 5,000 equal payments would be 20 million edges."""
    i = spark.range(4000).selectExpr("id", "'A' AS seller", "100L AS amount", "DATE '2024-01-01' AS day")
    p = spark.range(5000).selectExpr("id", "'A' AS merchant", "100L AS amount", "DATE '2024-01-01' AS day")
    made, real = [], linkage.candidate_edges
    try:
        linkage.candidate_edges = lambda *a, **k: made.append(real(*a, **k)) or made[-1]
        got = {(r.invoice_id, r.transaction_id) for r in linkage.settled_alike(i, p).collect()}
    finally:
        linkage.candidate_edges = real
    assert got == {(k, k) for k in range(4000)} and [x.count() for x in made] == [1]


@pytest.mark.parametrize("owner", [(), ("user",)])
def test_all_candidates_are_ordered_where_they_are_joined(spark, monkeypatch, owner):
    monkeypatch.setattr(linkage, "CANDIDATES", 50)
    rng = random.Random(5)
    day = lambda: pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=rng.randrange(60))
    invoices = [(k, rng.choice([10, 20, 30]), rng.choice([None, *(day() for _ in range(9))]), rng.choice("ab")) for k in range(60)]
    payments = [(f"p{k}", rng.choice([-10, -25, 30]), day(), rng.choice([None, "x", "y"]), rng.choice("ab")) for k in range(80)]
    taken = {"p3", "p4"}
    want = set()
    for name, asked, at, user in invoices:
        near = [(abs(asked - abs(x)), abs((d - at).days), c or p, p) for p, x, d, c, u in payments if at and p not in taken and abs((d - at).days) <= 7 and (not owner or u == user)]
        want |= {(name, x[3], k + 1) for k, x in enumerate(sorted(near))}
    frames = (spark.createDataFrame(invoices, "id long, amount long, day date, user string"), spark.createDataFrame(payments, "id string, amount long, day date, name string, user string"), spark.createDataFrame([(x,) for x in taken], "transaction_id string"))
    found = linkage.manual_candidates(*frames, owner=owner)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 300
    # no shuffle by invoice: nothing is exchanged above the join
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above = plan[: plan.index("Join")]
    assert "Window" in above and "Exchange" not in above
