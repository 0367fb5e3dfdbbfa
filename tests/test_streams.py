"""Streams: shuffled replays give the batch's result, a batch of the ledger writes only its buckets."""

import os
import random
from datetime import date, timedelta

import pytest

from tallyforge.streaming import lifecycle, waiting

ROW = "kind string, id string, owner string, currency string, amount long, day date"
FIRST = date(2024, 1, 1)


def _rows(rng, n=240, span=80):
    out = []
    for k in range(n):
        day = FIRST + timedelta(days=rng.randrange(span))
        out.append((rng.choice(["invoice", "payment"]), f"r{k:03}", rng.choice(["hot", "hot", "a", "b"]), "TWD", rng.choice([5, 6, 7]), day))
    return out


def plain(rows, until, before=7, after=7, overdue=10):
    """All keys at once, invoice after invoice."""
    out, free = set(), [r for r in rows if r[0] == "payment" and r[5] <= until]
    for _, name, owner, _, amount, day in sorted((r for r in rows if r[0] == "invoice"), key=lambda r: (r[5], r[1])):
        if day + timedelta(days=after) > until:
            continue
        near = [p for p in free if p[2] == owner and p[4] == amount and -before <= (p[5] - day).days <= after]
        if near:
            p = min(near, key=lambda p: (abs((p[5] - day).days), p[5], p[1]))
            free.remove(p)
            out.add((name, p[1], "matched", (p[5] - day).days))
        elif day + timedelta(days=overdue) <= until:
            out.add((name, None, "overdue", None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_replay_equals_the_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = _rows(rng)
    until = max(r[5] for r in rows) - timedelta(days=waiting.LATE + 1)
    want = plain(rows, until)
    assert {x[2] for x in want} == {"matched", "overdue"}
    assert {tuple(r) for r in waiting.waits_of_all(spark.createDataFrame(rows, ROW), str(until)).collect()} == want
    # no row comes more than 13 days behind the latest before it
    order = sorted(rows, key=lambda r: (r[5] + timedelta(days=rng.randrange(13)), rng.random()))
    feed, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(0, len(order), 60):
        spark.createDataFrame(order[k : k + 60], ROW).coalesce(1).write.mode("append").parquet(feed)
        # started anew each time: state and timers come back from the checkpoint
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(feed)
        waiting.drained(waiting.waits(stream), out, check)
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_state_is_dropped():
    out, invoices, payments = waiting.decided([[0, "i", False], [3, "j", False], [90, "k", False]], [[1, "p"], [2, "q"], [60, "r"]], 70, 7, 7, 10)
    assert out == [("i", "p", "matched", 1), ("j", "q", "matched", -1)] and invoices == [[90, "k", False]] and payments == [[60, "r"]]
    assert waiting.decided([[0, "i", False]], [], 8, 7, 7, 10) == ([], [[0, "i", True]], [])
    assert waiting.decided([[0, "i", True]], [], 10, 7, 7, 10) == ([("i", None, "overdue", None)], [], [])
    assert waiting.decided([[0, "i", False]], [[0, "p"]], None, 7, 7, 10) == ([], [[0, "i", False]], [[0, "p"]])


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    schema, folder = lifecycle.FIELDS + ", ordinal long", str(tmp_path / "ledger")
    batch = lambda ids, status, o: spark.createDataFrame([(i, status, None, f"{status}{o}", None, None, o) for i in ids], schema)
    ids = [f"t{k}" for k in range(400)]
    held = lambda: {os.path.join(a, f) for a, _, fs in os.walk(f"{folder}/ledger") for f in fs if f.endswith(".parquet")}
    lifecycle.promote(batch(ids, "pending", 1), 0, folder)
    first = held()
    assert len({os.path.dirname(f) for f in first}) == lifecycle.BUCKETS
    lifecycle.promote(batch(["t1", "t2"], "posted", 2), 1, folder)
    new = {os.path.dirname(f) for f in held() - first}
    assert 1 <= len(new) <= 2 and first <= held()
    # the same batch again, as after a failure
    lifecycle.promote(batch(["t1", "t2"], "posted", 2), 1, folder)
    state = {r.id: r.status for r in lifecycle.latest(spark, folder).collect()}
    assert len(state) == 400 and sorted(k for k, v in state.items() if v == "posted") == ["t1", "t2"]
    assert {(r.id, r.kind) for r in spark.read.parquet(f"{folder}/changes/1").collect()} == {("t1", "posted"), ("t2", "posted")}
    lifecycle.promote(batch(["t3", "new"], "posted", 3), 2, folder)
    # what the second batch replaced is gone, the rest stands
    assert not any(os.path.exists(f) for f in first if f.replace("/ledger/0/", "/ledger/1/").rsplit("/", 1)[0] in new)
    assert len(lifecycle.latest(spark, folder).collect()) == 401
    # a batch number may be missing
    lifecycle.promote(batch(["t4"], "posted", 9), 7, folder)
    assert {r.id for r in lifecycle.latest(spark, folder).filter("status = 'posted'").collect()} == {"t1", "t2", "t3", "t4", "new"}


def test_python_is_called_for_slots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(waiting, "SLOTS", 3)
    rows = [(kind, f"{kind[0]}{k}", f"o{k}", "TWD", k % 50, FIRST + timedelta(days=k % 60)) for k in range(300) for kind in ("invoice", "payment")]
    spark.createDataFrame(rows, ROW).write.parquet(str(tmp_path / "in"))
    waiting.drained(waiting.waits(spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain(rows, FIRST + timedelta(days=59 - waiting.LATE - 1)) and len(got) > 100
    state = spark.read.format("statestore").load(str(tmp_path / "check"))
    assert 0 < state.count() <= 3
