"""Conversation repair against all edits of short conversations and a plain Viterbi of whole strings."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallyforge.llm import conversations

RNG = random.Random(19)
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_edits(rows):
    """Least (cost, audit) and its text, from every edit of every row and up to two inserts at every place."""
    marks, best = faults(rows), None
    choices = []
    for (_, role, text), mark in zip(rows, marks, strict=True):
        stay = [] if mark in ("blank", "duplicate") else [("K", 0, role, text), ("R", 2, "user", text), ("R", 2, "assistant", text)]
        choices.append([("D", 3, None, None)] + [(e, c + (mark == "truncated"), r, t) for e, c, r, t in stay])
    gaps = [(), *itertools.product(("user", "assistant"), repeat=1), *itertools.product(("user", "assistant"), repeat=2)]
    for picks in itertools.product(*choices):
        base = sum(p[1] for p in picks)
        if best and base > best[0]:
            continue
        for inserts in itertools.product(gaps, repeat=len(picks) + 1):
            cost = base + 2 * sum(map(len, inserts))
            if best and cost > best[0]:
                continue
            turns, audit = [], ""
            for k in range(len(picks) + 1):
                turns += [(r, "") for r in inserts[k]]
                audit += "I" * len(inserts[k])
                if k < len(picks):
                    audit += picks[k][0]
                    turns += [picks[k][2:]] if picks[k][2] is not None else []
            if GRAMMAR.match("".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in turns))
    return best


def plain(rows):
    """The same by a Viterbi pass that carries whole strings, one edit at a time, inserts closed by repetition."""
    live = {0: (0, "", "")}

    def put(to, state, cost, audit, text):
        if state not in to or (cost, audit) < to[state][:2]:
            to[state] = (cost, audit, text)
            return True
        return False

    def join(state, text, turn):
        return turn if state == 0 else text + "\n" + turn

    def closed(at):
        at, again = dict(at), True
        while again:
            again = False
            for s, (c, a, t) in list(at.items()):
                n, role = (2, "user") if s != 2 else (3, "assistant")
                again |= put(at, n, c + 2, a + "I", join(s, t, role + ":"))
        return at

    for (_, role, text), mark in zip(rows, faults(rows), strict=True):
        # all (state, string) before the row, also those that an insert leads to at a higher cost
        to, extra = {}, mark == "truncated"
        for s0, (c0, a0, t0) in live.items():
            for s, (c, a, t) in closed({s0: (c0, a0, t0)}).items():
                put(to, s, c + 3, a + "D", t)
                if mark in ("blank", "duplicate"):
                    continue
                keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
                if keep is not None:
                    put(to, keep, c + extra, a + "K", join(s, t, f"{role}:{text}"))
                n, new = (2, "user") if s != 2 else (3, "assistant")
                put(to, n, c + 2 + extra, a + "R", join(s, t, f"{new}:{text}"))
        live = to
    return min((v for s, v in closed(live).items() if s in (0, 3)), key=lambda v: v[:2])


def run(rows):
    one = conversations.Repair()
    for (_, role, text), mark in zip(rows, faults(rows), strict=True):
        one.add(role, text, mark in ("blank", "duplicate"), mark == "truncated")
    return one.result()


def some_rows(n, roles=("user", "assistant", "system", "tool", "", "ua")):
    return [(i, RNG.choice(roles), RNG.choice([f"Text {i}.", f"text {i}", "", " \n", "same.", "Ü!"])) for i in range(n)]


def test_short_conversations_against_all_edits():
    for n in (0, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3):
        for _ in range(4 if n == 3 else 12):
            rows = some_rows(n, ("user", "assistant", "system", "tool"))
            cost, audit, text = all_edits(rows)
            assert run(rows) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def test_longer_conversations_against_plain_strings():
    for k in range(400):
        rows = some_rows(RNG.randint(1, 14), ("user", "assistant") if k % 2 else ("user", "assistant", "system", "tool", ""))
        cost, audit, text = plain(rows)
        assert run(rows) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def test_long_conversation_takes_little_time_and_memory():
    rows = [(i, RNG.choice(["user", "assistant"]), f"turn {i}.") for i in range(20_000)]
    assert len(run(rows)[1].replace("I", "")) == 20_000
    cost, audit, text = plain(rows[:3000])
    assert run(rows[:3000]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = ":".join(" " if x is None else str(x) for x in (conv, turn))
        harm = zlib.crc32(shown.encode()) % 20
        own = by[conv]
        if harm == 1:
            text = ""
        elif harm == 2:
            text = re.sub("[.!?]", "", text)
        elif harm == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, text = plain(own)
        out.append((conv, min(gaps, 2**63 - 1), *(marks.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_operator_matches_brute_force(spark, tmp_path):
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(RNG.randint(1, 9)):
            rows.append((conv, RNG.choice([turn, turn, turn + 1, None, turn * 3]), RNG.choice(["user", "assistant", "system", None, ""]), RNG.choice(["Yes.", None, "", "no", "Long " * 3000 + "end!", f"a {turn}?", "é. "])))
    rows += rows[:10] + [(7000, t, "user", "x") for t in range(400) if zlib.crc32(f"7000:{t}".encode()) % 20 == 0] + [(8000, 2**62, "user", "a."), (8000, -(2**62) - 5, "assistant", "b.")]
    rows += [(9000, i, "user" if i % 2 else "assistant", f"row {i % 900}.") for i in range(2000)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "v", "v", True) for r in rows], "conv_id long, turn long, role string, text string, fault string, hash string, gone boolean").repartition(4).write.parquet(path)
    got = sorted(map(str, map(tuple, conversations.op12(spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, brute(rows)))
    assert sum("7000," in x and "e3b0c442" in x for x in got) == 1


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_empty_and_null_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in conversations.op12(spark, str(tmp_path)).collect()]
    assert got == brute(rows)
