"""Directions of small statements against both orders tried by hand."""

import random

import pytest

from tallyforge.operators import statements

ROW = "statement long, place long, at string, amount double, balance double, flag boolean"


def derive(rows, newest):
    way, good, bad = {}, 0, 0
    for a, b in zip(rows, rows[1:]):
        new, old = (a, b) if newest else (b, a)
        if new[2] is None or old[2] is None or new[4] is None or old[4] is None:
            continue
        delta = new[4] - old[4]
        if abs(abs(delta) - new[3]) <= 0.005:
            good += 1
            way[new[1]] = 1 if delta > 0 else -1
        else:
            bad += 1
    return way, good > 0 and not bad


def plain(rows):
    read = [r for r in rows if r[2] is not None]
    newest, oldest = derive(rows, True), derive(rows, False)
    if read and read[0][2] != read[-1][2]:
        return (newest if read[0][2] > read[-1][2] else oldest)[0]
    return newest[0] if newest[1] and not oldest[1] else oldest[0] if oldest[1] and not newest[1] else {}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_directions_match_both_orders(spark, seed):
    rng, rows, want, signs = random.Random(seed), [], {}, {}
    for s in range(120):
        n, balance, own = rng.randint(1, 7), rng.randint(0, 50), []
        same, turned, means = rng.random() < 0.5, rng.random() < 0.5, s % 3
        for k in range(n):
            amount = rng.choice([-3, -2, -1, 0, 1, 2, 3])
            balance += amount
            told = float(balance + (rng.random() < 0.1))
            flag = None if rng.random() < 0.3 else (amount > 0) == (means != 1)
            own.append(("2024-01-01" if same else f"2024-01-{k + 1:02}", abs(float(amount)), told if rng.random() < 0.9 else None, flag))
        own = own[::-1] if turned else own
        own = [(s, k, None if rng.random() < 0.08 else at, a, b, f) for k, (at, a, b, f) in enumerate(own)]
        rows += own
        want |= {(s, k): v for k, v in plain(own).items()}
    for r in rows:
        signs.setdefault(r[0] % 3, set()).update({want[r[0], r[1]] * (1 if r[5] else -1)} if (r[0], r[1]) in want and r[5] is not None else ())
    rng.shuffle(rows)
    found = statements.directions(spark.createDataFrame(rows, ROW), ["statement"])
    got = {(r.statement, r.place): r.direction for r in found.collect()}
    assert got == {(r[0], r[1]): want.get((r[0], r[1])) for r in rows} and want
    more = {(r.statement, r.place): r.direction for r in statements.with_flags(found.withColumn("kind", found.statement % 3), ["kind"]).collect()}
    for r in rows:
        own, known = want.get((r[0], r[1])), signs[r[0] % 3]
        assert more[r[0], r[1]] == (own if own is not None or r[5] is None or len(known) != 1 else next(iter(known)) * (1 if r[5] else -1))
