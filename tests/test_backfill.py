"""The backfill planner against one account after another in plain Python."""

import json
import math
import random
from datetime import date, datetime, timedelta, timezone

import pytest

from tallyforge.operators import backfill

TAIPEI = timezone(timedelta(hours=8))
ACCOUNTS = "id string, connector_id string, account_last4 string, opened_date date, anchor_balance double, anchor_currency string, anchor_at string"
ROWS = "id string, account_id string, posted_date string, authorized_at string, amount double, currency string, raw_payload string"


def when(text):
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def day_of(row):
    at = row["authorized_at"]
    if at and len(at) > 10:
        return when(at).astimezone(TAIPEI).date()
    text = at or row["posted_date"]
    return date.fromisoformat(text[:10]) if text else None


def end_of(rows):
    ends = [r for r in rows if not any(o is not r and o["running"] - o["amount"] == r["running"] for o in rows)]
    return ends[0]["running"] if len(ends) == 1 else rows[-1]["running"]


def plain(accounts, transactions, months):
    reports, points, walks, carried = {}, {}, [], []
    for a in accounts:
        trusted = a["connector_id"] in backfill.TRUSTED
        if a["anchor_at"] is None:
            reports[a["id"]] = ("skipped", "no_real_snapshot" if trusted else "deposit_details_may_be_incomplete" if a["connector_id"] == "ctbc" else "connector_without_deposit_details")
            continue
        anchor, anchor_day = when(a["anchor_at"]), when(a["anchor_at"]).astimezone(TAIPEI).date()
        if not trusted:
            carried.append((a, anchor_day, []))
            continue
        rows = []
        for t in transactions:
            if t["account_id"] == a["id"] and (day := day_of(t)):
                at = when(t["authorized_at"]) if t["authorized_at"] and len(t["authorized_at"]) > 10 else None
                payload = json.loads(t["raw_payload"]) if t["raw_payload"] else {}
                if day < anchor_day or day == anchor_day and (at is None or at <= anchor):
                    rows.append({**t, "day": day, "running": payload.get("balance"), "key": (day, at is not None, at.timestamp() if at else 0, t["id"])})
        if any((r["currency"] or "TWD") != (a["anchor_currency"] or "TWD") for r in rows):
            reports[a["id"]] = ("skipped", "mixed_currency")
            continue
        walks.append((a, anchor_day, sorted(rows, key=lambda r: r["key"])))
    first = min((r["day"] for _, _, rows in walks for r in rows), default=None)
    for way, found in (("walk", walks), ("carry", carried)):
        for a, anchor_day, rows in found:
            if first is None:
                reports[a["id"]] = ("skipped", "no_transactions")
                continue
            month = anchor_day.year * 12 + anchor_day.month - 1 - months
            window = date(month // 12, month % 12 + 1, 1) + timedelta(days=anchor_day.day - 1)
            start = max(x for x in (first, window, a["opened_date"]) if x)
            days = [start + timedelta(days=k) for k in range((anchor_day - start).days)]
            told = bool(rows) and all(r["running"] is not None for r in rows)
            per_day = {d: [r for r in rows if r["day"] == d] for d in sorted({r["day"] for r in rows})}
            off = []
            for d in days:
                back = a["anchor_balance"] - sum(r["amount"] for r in rows if r["day"] > d)
                method, value = ("carry_back", a["anchor_balance"]) if way == "carry" else ("reverse_sum", back)
                if way == "walk" and told:
                    before = [x for x in per_day if x <= d]
                    opening = next(iter(per_day.values()))
                    forward = end_of(per_day[before[-1]]) if before else end_of(opening) - sum(r["amount"] for r in opening)
                    if abs(forward - back) > 1:
                        off.append(d)
                    else:
                        method, value = "running_balance", forward
                points[a["id"], d] = (method, math.floor(value + 0.5))
            reports[a["id"]] = ("backfilled", None, days[0] if days else None, days[-1] if days else None, len(days), len(days) if told and way == "walk" else 0, len(off), off[0] if off else None, off[-1] if off else None)
    return points, reports


@pytest.mark.parametrize(("seed", "kind"), [(1, "all"), (2, "all"), (3, "none"), (4, "carried")])
def test_plan_matches_plain_accounts(spark, seed, kind):
    rng = random.Random(seed)
    accounts, rows = [], []
    for k in range(24):
        connector = "ctbc" if kind == "carried" else rng.choice(["esun", "firstbank", "ctbc", "unknown", "obank", "kgibank", "esun"])
        day = date(2024, rng.randint(1, 3), rng.randint(1, 28))
        at = rng.choice([None, f"{day}T16:30:00Z", f"{day}T01:00:00+08:00", f"{day}T12:00:00.000Z"])
        accounts.append({"id": f"a{k}", "connector_id": connector, "account_last4": "1234", "opened_date": rng.choice([None, None, date(2024, 1, 10), date(2025, 1, 1)]), "anchor_balance": rng.randint(-500, 5000) / 2, "anchor_currency": rng.choice(["TWD", "TWD", None, "USD"]), "anchor_at": at})
        balance, mixed = rng.randint(0, 1000), k % 8 == 7
        for j in range(0 if kind == "none" else rng.randint(0, 12)):
            posted = date(2023, 11, 20) + timedelta(days=rng.randint(0, 140))
            amount = rng.choice([0, rng.randint(-200, 200), rng.randint(-200, 200) / 2])
            balance += amount
            told = None if k % 5 == 0 and j % 4 == 3 else json.dumps({"balance": balance})
            rows.append({"id": f"t{k:02}{j:02}", "account_id": f"a{k}", "posted_date": rng.choice([str(posted), str(posted), None]), "authorized_at": rng.choice([None, str(posted), f"{posted}T{rng.randint(0, 23):02}:15:00Z"]), "amount": float(amount), "currency": "EUR" if mixed and j == 0 else accounts[-1]["anchor_currency"] or rng.choice(["TWD", None]), "raw_payload": told})
    rows += [{"id": "x", "account_id": "nobody", "posted_date": "2001-01-01", "authorized_at": None, "amount": 1.0, "currency": "TWD", "raw_payload": None}]
    balances, reports = backfill.plan(spark.createDataFrame(accounts, ACCOUNTS), spark.createDataFrame(rows, ROWS), 2)
    points, told = plain(accounts, rows, 2)
    assert {(r.account_id, r.day): (r.method, r.balance) for r in balances.collect()} == points
    shown = {r.account_id: (r.status, r.reason) if r.status == "skipped" else (r.status, None, r.from_day, r.to_day, r.days, r.compared_days, r.mismatch_days, r.first_mismatch, r.last_mismatch) for r in reports.collect()}
    assert shown == told


def test_days_are_not_shuffled(spark):
    """A row a day is made last: nothing behind the explode of days is joined, ordered or counted."""
    accounts = [{"id": f"a{k}", "connector_id": "esun", "account_last4": "1234", "opened_date": None, "anchor_balance": 10.0, "anchor_currency": "TWD", "anchor_at": "2024-03-01T01:00:00+08:00"} for k in range(3)]
    rows = [{"id": "t1", "account_id": "a1", "posted_date": "2023-12-24", "authorized_at": None, "amount": 5.0, "currency": "TWD", "raw_payload": None}]
    balances, reports = backfill.plan(spark.createDataFrame(accounts, ACCOUNTS), spark.createDataFrame(rows, ROWS), 2)
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" in text(balances) and "sequence(" not in text(reports)
    above = text(balances)[: text(balances).index("sequence(")]
    assert not any(x in above for x in ("Join", "Window", "Aggregate"))
    assert balances.count() == 3 * 60 and {r.days for r in reports.collect()} == {60}
