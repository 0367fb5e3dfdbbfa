"""Ledger operators: every SQL-checked query against DuckDB, and the rest against brute force or small cases."""

import datetime
import glob
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import columns as C
from tallyforge.operators import ingest, ledger, linkage, series
from tallyforge.plans import registry
from tallyforge.streaming import lifecycle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(_cell(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(map(_cell, r)) for r in want.fetchall())


def _brute(edges):
    """The assignment one score class after another, over labelled components."""
    pair, taken, blocked_i, blocked_t = {}, set(), set(), set()
    for score in sorted({e[4] for e in edges}, reverse=True):
        tier = [e for e in edges if e[4] == score and e[0] not in pair and e[1] not in taken and e[0] not in blocked_i and e[1] not in blocked_t]
        todo = set(range(len(tier)))
        while todo:
            part, front = set(), {todo.pop()}
            while front:
                part |= front
                i, t = {tier[k][0] for k in part}, {tier[k][1] for k in part}
                front = {k for k in todo if tier[k][0] in i or tier[k][1] in t}
                todo -= front
            own = [tier[k] for k in part]
            i, t = sorted({e[0] for e in own}), sorted({e[1] for e in own})
            if len(own) == 1 or len(own) == len(i) * len(t) and all(e[3] and e[2] == 0 for e in own):
                for a, b in zip(i, t):
                    pair[a] = b
                    taken.add(b)
            else:
                blocked_i |= set(i)
                blocked_t |= set(t)
    return {(a, b, "matched") for a, b in pair.items()} | {(a, None, "ambiguous") for a in blocked_i}


@pytest.mark.parametrize("small", [200_000, 0])
def test_assignment_equals_brute_force_in_any_order(spark, monkeypatch, small):
    monkeypatch.setattr(linkage, "SMALL", small)
    rnd = random.Random(5)
    edges = []
    for graph in range(60):
        n, m = rnd.randint(1, 4), rnd.randint(1, 4)
        for i, t in itertools.product(range(n), range(m)):
            if rnd.random() < 0.6:
                gap, exact = rnd.choice([(0, True), (0, True), (1, True), (0, False)])
                edges.append((graph * 10 + i, 1000 + graph * 10 + t, gap, exact, rnd.choice([8, 8, 10]) if exact else 8))
    schema = "invoice_id long, transaction_id long, gap int, exact boolean, score int"
    rnd.shuffle(edges)
    got = {tuple(r) for r in linkage.assign(spark.createDataFrame(edges, schema)).collect()}
    assert got == _brute(edges)
    assert any(x[2] == "ambiguous" for x in got) and len([x for x in got if x[1]]) == len({x[1] for x in got if x[1]})
    assert linkage.assign(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("most", [10_000, 3])
def test_anchored_groups_compare_with_the_first_row(spark, monkeypatch, most):
    monkeypatch.setattr(linkage, "FOLD_MOST", most)
    rnd = random.Random(3)
    rows = [(k % 5, k, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rnd.randint(0, 400))) for k in range(300)]
    got = {r.id: r.anchor for r in linkage.anchored_groups(spark.createDataFrame(rows, "key long, id long, ts timestamp"), ["key"]).collect()}
    want, last = {}, {}
    for key, i, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        at = int(ts.replace(tzinfo=datetime.timezone.utc).timestamp())
        if key not in last or at - last[key] > 86400:
            last[key] = at
        want[i] = last[key]
    assert got == want


@pytest.mark.parametrize(
    ("signals", "role", "source"),
    [
        ({}, "spending", "sign"),
        ({"amount": 5.0}, "income", "sign"),
        ({"amount": 5.0, "credit": True}, "spending", "sign"),
        ({"preference": "exclude", "card_payment": True}, "card_payment", "calculation_preference"),
        ({"preference": "include", "own_account_kind": "own_account"}, "spending", "calculation_preference"),
        ({"own_account_kind": "own_account", "merchant_role": "income"}, "own_transfer", "own_account"),
        ({"own_account_kind": "unsynced_card"}, "spending", "unsynced_card"),
        ({"merchant_role": "income", "auto_transfer": True}, "income", "merchant_rule"),
        ({"card_payment": True}, "card_payment", "possible_unsynced_card"),
        ({"card_payment": True, "synced_card": True}, "card_payment", "card_payment"),
        ({"top_up": True, "rule_role": "investment"}, "own_transfer", "ewallet_topup"),
        ({"rule_role": "investment", "income_category": True}, "investment", "category"),
        ({"rule_role": "spending", "excluded": True}, "spending", "rule"),
        ({"excluded": True}, "own_transfer", "excluded"),
    ],
)
def test_role_precedence(spark, signals, role, source):
    kinds = {"preference": "string", "own_account_kind": "string", "merchant_role": "string", "rule_role": "string", "amount": "double"}
    names = "preference own_account_kind merchant_role auto_transfer card_payment synced_card top_up rule_role income_category excluded amount credit transfer_hint".split()
    s = {k: F.lit(signals.get(k, -5.0 if k == "amount" else False if k == "credit" else None)).cast(kinds.get(k, "boolean")) for k in names}
    got = spark.range(1).select(ledger.economic_role(s).alias("r")).first().r
    assert (got.role, got.source) == (role, source)


def test_columns(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(C.cents(F.lit(-0.125))) == -0.12 and value(C.cents(F.lit(0.125))) == 0.13  # halves go up
    assert value(C.to_twd(F.lit(5.0), F.lit("KRW"), F.lit(None).cast("double"))) is None
    assert value(C.to_twd(F.lit(0.0), F.lit("KRW"), F.lit(None).cast("double"))) == 0
    assert str(value(C.subtract_months(F.lit("2023-03-31").cast("date"), 1))) == "2023-03-03"
    assert str(value(C.month_before(F.lit("2023-03-31").cast("date")))) == "2023-02-28"
    assert str(value(C.transaction_day(F.lit("2023-01-31T18:00:00Z"), F.lit("x")))) == "2023-02-01"
    assert value(C.transaction_day(F.lit(None).cast("string"), F.lit("bad"))) is None
    assert str(value(C.parsed_date(F.lit("112/02/28")))) == "2023-02-28" and value(C.parsed_date(F.lit("112/02/30"))) is None
    assert value(C.mask_long_digits(F.lit("a 12345678 b 1234567"))) == "a ****5678 b 1234567"
    assert float(value(C.parsed_number(F.lit("($1,234.50)")))) == -1234.5 and value(C.parsed_number(F.lit("x"))) is None


def test_cash_allocation_invariants(spark):
    rnd = random.Random(1)
    rows = [(str(k), f"2024-0{1 + k % 4}", datetime.date(2024, 1 + k % 4, 1 + rnd.randint(0, 27)), rnd.randint(1, 50)) for k in range(60)]
    needs = [(f"2024-0{m}", rnd.randint(0, 600)) for m in range(1, 6)]
    w = spark.createDataFrame(rows, "id string, month string, day date, amount long").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    n = spark.createDataFrame(needs, "month string, need long").withColumn("need", F.col("need").cast("decimal(18,2)"))
    got = {r.id: r for r in series.allocate_cash(w, n).collect()}
    pools = {m: sorted((r for r in rows if r[1] == m), key=lambda r: (r[2], r[0])) for m in {r[1] for r in rows}}
    used = dict.fromkeys((r[0] for r in rows), 0)

    def take(pool, need):
        for r in pool:
            x = min(r[3] - used[r[0]], need)
            used[r[0]] += x
            need -= x
        return need

    over = {m: take(pools.get(m, []), need) for m, need in needs}
    for m, need in over.items():
        take(reversed(pools.get(f"2024-0{int(m[-1]) - 1}", [])), need)
    assert {k: v.allocated for k, v in got.items()} == {k: float(v) for k, v in used.items()}


def test_merge_is_idempotent_and_posted_is_sticky(spark):
    rows = lambda *x: spark.createDataFrame([(*r, None) for r in x], "id string, status string, amount long, description string, authorized_at string, transfer_peer_id string")
    old = rows(("a", "posted", 1, "old", "2024-01-01T10:00:00Z"), ("b", "pending", 2, "old", None))
    new = rows(("a", "pending", 9, "new", "2024-01-01"), ("b", "posted", 3, "new", "2024-01-02"), ("c", "pending", 4, "new", None))
    once = ingest.merge_transactions(old, new)
    got = {r.id: (r.status, r.amount, r.description, r.authorized_at) for r in once.collect()}
    assert got == {"a": ("posted", 1, "old", "2024-01-01T10:00:00Z"), "b": ("posted", 3, "new", "2024-01-02"), "c": ("pending", 4, "new", None)}
    assert sorted(map(str, ingest.merge_transactions(once, new).collect())) == sorted(map(str, once.collect()))


def test_lifecycle_stream(spark, tmp_path):
    schema = lifecycle.FIELDS + ", ordinal long"
    feed, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame([(i, s, None, d, None, None, o) for i, s, d, o in rows], schema).coalesce(1).write.mode("append").parquet(feed)
        lifecycle.run(spark.readStream.schema(schema).parquet(feed), out, str(tmp_path / "check"))

    arrive(("a", "pending", "first", 1), ("a", "pending", "second", 2), ("b", "posted", "x", 3))
    arrive(("a", "posted", "third", 4), ("c", "pending", "y", 5))
    ledger_rows = {r.id: (r.status, r.description) for r in lifecycle.latest(spark, out).collect()}
    assert ledger_rows == {"a": ("posted", "third"), "b": ("posted", "x"), "c": ("pending", "y")}
    kinds = [{(r.id, r.kind) for r in spark.read.parquet(f"{out}/changes/{k}").collect()} for k in (0, 1)]
    assert kinds == [{("a", "pending"), ("b", "added")}, {("a", "posted"), ("c", "pending")}]


def test_empty_tables(spark):
    schema = "id string, account_id string, account_type string, currency string, canonical_account_id string, status string, posted_date string, authorized_at string, amount decimal(18,2), description string, counterparty string, matched_transaction_id string, role_override string, advance_counterparty string"
    items = ledger.activity(spark.createDataFrame([], schema), spark.createDataFrame([], "currency string, rate_to_twd double"), registry.RULES)
    assert ledger.month_summary(items).count() == 0
    months = spark.createDataFrame([("2024-01",)], "month string")
    row = ledger.month_summary(items, months).first()
    assert row.income == 0 and row.missing_currencies == ""
