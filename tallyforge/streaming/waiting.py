"""Invoices that wait for their payment, as a stream with event-time timers.

Rows of both kinds arrive in any order, up to the watermark's delay late.  An invoice is decided once the watermark has passed the last day a
payment of its own may have, so what has arrived by then, not the order of arrival, settles it: invoices of a key, first day
first, take the free payment that is nearest.  One without a payment is overdue when the watermark has passed ``overdue`` days.  A
payment is forgotten once no invoice can take it, an invoice once it is told, so a key's state spans ``before + after`` days and the watermark's delay.
Keys are nearly as many as rows, so the state is kept by slot, a fixed share of the keys, and Python is called for slots and not for keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Days that a payment may lie before and after its invoice, after which an invoice is overdue, and that rows may be late.
BEFORE, AFTER, OVERDUE, LATE = 7, 7, 10, 14
KEYS = ("owner", "currency", "amount")
#: Parts of the state that Python is called for.  Each is read and written as a whole.  A checkpoint holds for one number.
SLOTS = 4096
OUT = "invoice_id string, transaction_id string, outcome string, gap int"
_DAY_MS = 86_400_000


def decided(invoices: list, payments: list, until: int | None, before: int, after: int, overdue: int) -> tuple[list, list, list]:
    """(results, invoices left, payments left) of one key once all rows up to day ``until`` are there (None: nothing is certain).

    invoices: [day, id, decided]; payments: [day, id].  Days are numbers.
    """
    if until is None:
        return [], invoices, payments
    out, left = [], []
    free = sorted(map(tuple, payments))
    for day, name, told in sorted(map(tuple, invoices)):
        if not told and day + after <= until:
            near = min((p for p in free if day - before <= p[0] <= day + after), key=lambda p: (abs(p[0] - day), p), default=None)
            if near:
                free.remove(near)
                out.append((name, near[1], "matched", near[0] - day))
                continue
            told = True
        if told and day + overdue <= until:
            out.append((name, None, "overdue", None))
            continue
        left.append([day, name, told])
    # an invoice that may still take a payment was issued up to ``before`` days after it, and is decided ``after`` days later
    return out, left, [list(p) for p in free if p[0] + before + after > until]


def _settle(before: int, after: int, overdue: int):
    def settle(slot: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        for part in parts:
            for key, kind, name, day in zip(part.key, part.kind, part.id, part.day_number, strict=True):
                invoices, payments = kept.setdefault(key, ([], []))
                invoices.append([int(day), name, False]) if kind == "invoice" else payments.append([int(day), name])
        mark = state.getCurrentWatermarkMs()
        # the watermark's own day may still get rows
        until = mark // _DAY_MS - 1 if mark > 0 else None
        out, first = [], None
        for key in list(kept):
            told_now, invoices, payments = decided(*kept[key], until, before, after, overdue)
            out += told_now
            if not invoices and not payments:
                del kept[key]
                continue
            kept[key] = (invoices, payments)
            turn = min([day + (overdue if told else after) for day, _, told in invoices] + [day + before + after for day, _ in payments])
            first = turn if first is None else min(first, turn)
        if kept:
            state.update((json.dumps(kept),))
            # fires once the watermark has come to the day after
            state.setTimeoutTimestamp(max((first + 1) * _DAY_MS - 1, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["invoice_id", "transaction_id", "outcome", "gap"]).astype({"gap": "Int32"})

    return settle


def waits(rows: DataFrame, before: int = BEFORE, after: int = AFTER, overdue: int = OVERDUE, late: int = LATE) -> DataFrame:
    """(invoice_id, transaction_id, outcome, gap) of every invoice that has been decided.

    rows: a stream of ``kind`` (``invoice`` or ``payment``), id, owner, currency, amount, day; rows later than ``late`` days are dropped with the watermark.
    """
    at = rows.withColumn("at", F.timestamp_seconds(F.unix_date("day").cast("long") * 86400)).withWatermark("at", f"{late} days").withColumn("day_number", F.unix_date("day"))
    lined = at.withColumn("key", F.to_json(F.struct(*KEYS))).select(F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot"), "key", "kind", "id", "day_number", "at")
    keyed = lined.groupBy("slot")
    return keyed.applyInPandasWithState(_settle(before, after, overdue), OUT, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def waits_of_all(rows: DataFrame, until: str, before: int = BEFORE, after: int = AFTER, overdue: int = OVERDUE) -> DataFrame:
    """The same over a whole table, as if every row up to the day ``until`` had arrived and no other: sorted by key, one key after another."""
    last = F.unix_date(F.lit(until).cast("date"))
    lined = rows.select(F.struct(*KEYS).alias("key"), "kind", "id", F.unix_date("day").alias("day_number"), last.alias("last"))
    lined = lined.withColumn("key", F.to_json("key")).repartition("key").sortWithinPartitions("key")

    def settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, invoices, payments, end = None, [], [], 0
        for part in parts:
            out = []
            for name, kind, row, day, end in zip(part.key, part.kind, part.id, part.day_number, part["last"], strict=True):
                if name != key:
                    out += decided(invoices, payments, end, before, after, overdue)[0]
                    key, invoices, payments = name, [], []
                invoices.append([day, row, False]) if kind == "invoice" else payments.append([day, row])
            yield pd.DataFrame(out, columns=["invoice_id", "transaction_id", "outcome", "gap"]).astype({"gap": "Int32"})
        out = decided(invoices, payments, end, before, after, overdue)[0]
        yield pd.DataFrame(out, columns=["invoice_id", "transaction_id", "outcome", "gap"]).astype({"gap": "Int32"})

    return lined.mapInPandas(settle, OUT)


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run ``stream`` until its source has nothing left, the results to ``path``; started again it goes on where it stopped."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
