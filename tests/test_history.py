"""Stored series, schedules, arrays at depth, merge candidates and assignment by owners against loops."""

import json
import os
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import normalise
from tallyforge.operators import candidates, history, linkage


def _sides(spark, seed=1):
    rng = random.Random(seed)
    rows = {(f"a{rng.randrange(6)}", date(2024, 1, 1) + timedelta(days=rng.randrange(60))): float(rng.randint(-50, 500)) for _ in range(80)}
    accounts = [(f"a{k}", f"c{k % 2}", ["TWD", "USD", "KRW"][k % 3]) for k in range(6)]
    frames = spark.createDataFrame([(a, d, b) for (a, d), b in rows.items()], "account_id string, day date, balance double"), spark.createDataFrame(accounts, "id string, connector_id string, currency string"), spark.createDataFrame([("USD", 30.0)], "currency string, rate_to_twd double")
    return rows, accounts, frames


def test_ten_daily_runs_equal_one_full_run(spark, tmp_path):
    rows, accounts, sides = _sides(spark)
    want = {}
    for day in (date(2024, 2, 1) + timedelta(days=k) for k in range(15)):
        for i, connector, currency in accounts:
            held = [(d, b) for (a, d), b in rows.items() if a == i and d <= day]
            rate = {"TWD": 1.0, "USD": 30.0}.get(currency)
            if held and (rate or max(held)[1] == 0):
                want[connector, day] = want.get((connector, day), 0.0) + max(held)[1] * (rate or 0)
    whole, daily = str(tmp_path / "whole"), str(tmp_path / "daily")
    history.write(history.points(*sides, "2024-02-01", "2024-02-15"), whole)
    history.write(history.points(*sides, "2024-02-01", "2024-02-05"), daily)
    read = lambda p: {(r.connector_id, r.day): r.value for r in spark.read.schema(history.POINT).parquet(p).collect()}
    files = lambda: {os.path.join(a, f) for a, _, fs in os.walk(daily) for f in fs if f.endswith(".parquet")}
    for k in range(6, 16):
        before = files()
        assert history.carry_on(*sides, daily, f"2024-02-{k:02}") == 1
        assert before < files() and all(f"day=2024-02-{k:02}" in f for f in files() - before)
    assert history.carry_on(*sides, daily, "2024-02-15") == 0
    assert read(daily) == read(whole) == pytest.approx(want)
    # one day again: only its files are new
    before = files()
    history.write(history.points(*sides, "2024-02-10", "2024-02-10"), daily)
    assert {f.split("day=")[1][:10] for f in before ^ files()} == {"2024-02-10"} and read(daily) == read(whole)


def test_next_runs_over_two_years(spark):
    taipei, start, cases = timezone(timedelta(hours=8)), datetime(2023, 1, 1, tzinfo=timezone.utc), []
    for k in range(0, 2 * 365 * 1440, 397):
        cases.append((start + timedelta(minutes=k), [30, 1440, 10080, 4320][k % 4], ["00:00", "07:59", "23:30", "24:00", "7:30", None][k % 6], [None, -1, 0, 3, 6, 9][k % 5]))

    def want(now, every, preferred, weekday):
        if every < 1440 or preferred not in ("00:00", "07:59", "23:30"):
            return now + timedelta(minutes=every)
        local = now.astimezone(taipei)
        at = local.replace(hour=int(preferred[:2]), minute=int(preferred[3:]), second=0, microsecond=0)
        day = min(6, max(0, 1 if weekday is None else weekday))
        while at <= local or every == 10080 and (at.weekday() + 1) % 7 != day:
            at += timedelta(days=1)
        return at

    frame = spark.createDataFrame([(int(a.timestamp()), b, c, d) for a, b, c, d in cases], "now long, every int, preferred string, weekday int")
    got = frame.select(F.unix_seconds(normalise.next_run(F.col("every"), F.col("preferred"), F.timestamp_seconds("now"), F.col("weekday"))).alias("at")).collect()
    assert [r.at for r in got] == [int(want(*c).timestamp()) for c in cases]


def test_first_arrays(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(7)
        if kind == 0:
            return rng.choice([[], [1], ["x", {"y": [2]}]])
        if kind < 4 and depth < 8:
            return {rng.choice(["b", "list", "z", "a", "data", "\u00e9"]): value(depth + 1) for _ in range(rng.randint(0, 3))}
        return rng.choice([None, 5, "[1]", "{}", "text", True, 1.5])

    def find(x, keys, depth=0):
        if depth > 5 or x is None:
            return []
        if isinstance(x, list):
            return x
        if not isinstance(x, dict):
            return []
        for k in keys:
            if isinstance(x.get(k), list):
                return x[k]
        return next((y for y in (find(v, keys, depth + 1) for v in x.values()) if y), [])

    texts = [json.dumps(value(0), ensure_ascii=False, separators=(",", ":")) for _ in range(400)] + ["", "{", "no", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.found for r in rows.select("k", normalise.first_array(F.col("text"), ["list", "data"]).alias("found")).collect()}
    for k, t in enumerate(texts):
        want = find(json.loads(t), ["list", "data"]) if t and t[0] in "[{tfn0123456789\"" and t != "no" and t != "{" else []
        assert (json.loads(got[k]) if got[k] else []) == want, t
    assert sum(x is not None for x in got.values()) > 40


def test_witnesses_leave_the_same_pairs(spark):
    rng = random.Random(5)
    rows = lambda name: [(f"{name}{k}", rng.randrange(25), rng.choice([1, 1, 2, None])) for k in range(40)]
    old, new = rows("o"), rows("n")
    frame = lambda r: spark.createDataFrame(r, "id string, a int, b int")
    pairs = {(o[0], n[0]) for o in old for n in new if o[1:] == n[1:] and None not in o}
    one = {(o, n) for o, n in pairs if sum(x[0] == o for x in pairs) == 1 == sum(x[1] == n for x in pairs)}
    got = linkage.one_to_one(candidates._witnesses(frame(old), frame(new), ["a", "b"]))
    assert one and {tuple(r) for r in got.collect()} == one
    # a key with 50,000 rows a side gives pairs in proportion
    many = spark.range(50_000).selectExpr("concat('o', id) as id", "1 as a", "1 as b")
    assert candidates._witnesses(many, many.withColumn("id", F.concat(F.lit("n"), "id")), ["a", "b"]).count() <= 200_000


def test_edges_stay_with_their_owner(spark):
    rng, day = random.Random(9), date(2024, 5, 1)
    owner = lambda: rng.choice(["hot", "hot", "a", "b"])
    invoices = [(k, owner(), "s", float(rng.randint(1, 5)), day + timedelta(days=rng.randrange(8))) for k in range(60)]
    payments = [(k, owner(), "s", float(rng.randint(1, 5)), day + timedelta(days=rng.randrange(8))) for k in range(60)]
    got = linkage.candidate_edges(spark.createDataFrame(invoices, "id int, owner string, seller string, amount double, day date"), spark.createDataFrame(payments, "id int, owner string, merchant string, amount double, day date"), owner=("owner",))
    want = {(i[0], p[0]) for i in invoices for p in payments if i[1] == p[1] and abs((i[4] - p[4]).days) <= 3 and (i[3] == p[3] or 0.8 * i[3] <= p[3] < i[3])}
    assert {(r.invoice_id, r.transaction_id) for r in got.collect()} == want


def test_pages_by_locale_equal_the_whole_sort(spark):
    from tallyforge.functions import columns
    from tallyforge.operators import ledger

    rng = random.Random(2)
    rows = spark.createDataFrame([(k, rng.choice(["李記", "王家", "全聯", "中信", "apple", "Apple", "zoo", "7-11", "一", "龍門"])) for k in range(90)], "id long, name string")
    whole = [(r.name, r.id) for r in rows.orderBy(columns.localized(F.col("name")), "id").collect()]
    assert [x for x in dict.fromkeys(n for n, _ in whole)][:3] == ["7-11", "一", "中信"]
    pages, last = [], None
    while True:
        page = [(r.name, r.id) for r in ledger.named_page(rows, "name", "id", last, 17).collect()]
        if not page:
            break
        pages, last = pages + page, page[-1]
    assert pages == whole
