r"""Conversation structure repair: a forward Viterbi pass over four grammar states.

A repaired conversation's role initials are ``(s?(ua)+)?``.  States: nothing yet, after the system turn, after user, after assistant.  Edits:
keep (0), rerole to user or assistant (2), delete (3, required for blank and duplicate rows), insert an empty user or assistant turn
(2); a truncated row that stays adds 1.

1. Damage and faults are columns.  A row is a duplicate if a window over (conversation, role, text) does not see it first.
2. Rows go to tasks by conversation, sorted by turn, and stream through the pass: each layer closes with the inserts that can stand
   before the next row (two at most, as more come back to a state already reached) and keeps the least (cost, audit) a state.
   Two audits of one layer have as many row edits and end with one, so none is a prefix of another, and rank in the last layer plus the
   step's own letters order them; a step is kept as two bytes a state, and the text's digest goes forward with each state.  So a
   conversation takes 8 bytes a row in memory, whatever its texts, and is never gathered.  Its rows pass one task in order, as
   the digest of its whole repaired text demands.

Defined cases: null role and text, and null parts of the key that picks the damage, are one space; a null conversation is one of its own; null turns come first; rows of the
same turn go by role, then text; a turn is counted once however often it is repeated; role initials are first characters, an empty role has none; gaps beyond a long are the greatest long; a conversation that loses all
rows gives zeros; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = (START, ASSISTANT)

_AFTER_INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_INSERTED = {USER: b"user:", ASSISTANT: b"assistant:"}


def _inserts(state: int):
    """(state, inserted states) of no insert, then one, then two, without coming back to a state."""
    path, seen = [], {state}
    yield state, ()
    while (state := _AFTER_INSERT[state]) not in seen:
        seen.add(state)
        path.append(state)
        yield state, tuple(path)


def _row_edits(state: int, initial: str, must_go: bool, truncated: bool):
    """(letter, cost, new state, role of a rerole or None)."""
    yield "D", DELETE, state, None
    if must_go:
        return
    user_next = state != USER
    extra = TRUNCATED if truncated else 0
    goes = {"s": SYSTEM if state == START else None, "u": USER if user_next else None, "a": None if user_next else ASSISTANT}.get(initial)
    if goes is not None:
        yield "K", KEEP + extra, goes, None
    goes, role = (USER, "user") if user_next else (ASSISTANT, "assistant")
    yield "R", REROLE + extra, goes, role


def _steps(initial: str, must_go: bool, truncated: bool):
    """For each new state: (old state, cost, letters, inserted states, letter, role) of the best step from each old state."""
    best = {}
    for old in range(4):
        for mid, inserted in _inserts(old):
            for letter, cost, new, role in _row_edits(mid, initial, must_go, truncated):
                step = (cost + INSERT * len(inserted), "I" * len(inserted) + letter, inserted, letter, role)
                if (old, new) not in best or step[:2] < best[old, new][:2]:
                    best[old, new] = step
    return [[(old, *best[old, new]) for old in range(4) if (old, new) in best] for new in range(4)]


_STEPS = {(i, g, t): _steps(i, g, t) for i in "sua-" for g in (False, True) for t in (False, True)}
_LETTERS = [b"D", b"K", b"R", b"ID", b"IK", b"IR", b"IID", b"IIK", b"IIR"]
_CODE = {x.decode(): k for k, x in enumerate(_LETTERS)}


class Repair:
    """The pass over one conversation; rows come in order."""

    def __init__(self):
        self.live = {START: (0, 0, hashlib.sha256())}  # state: (cost, rank of the audit in this layer, digest of the repaired text)
        self.back = bytearray()  # for each row and state: old state, code of the step's letters

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
        found, body = {}, None
        for new, ways in enumerate(_STEPS[initial, must_go, truncated]):
            best = None
            for old, cost, letters, inserted, letter, rerole in ways:
                before = self.live.get(old)
                if before is not None:
                    key = (before[0] + cost, before[1], letters)
                    if best is None or key < best[0]:
                        best = (key, old, inserted, letter, rerole)
            if best is not None:
                found[new] = best
        places = {key: k for k, key in enumerate(sorted({x[0][1:] for x in found.values()}))}
        live, back = {}, bytearray(8)
        for new, (key, old, inserted, letter, rerole) in found.items():
            digest = self.live[old][2]
            if inserted or letter != "D":
                digest = digest.copy()
                first = old == START
                for state in inserted:
                    digest.update(_INSERTED[state] if first else b"\n" + _INSERTED[state])
                    first = False
                if letter != "D":
                    if body is None:
                        body = b":" + text.encode()
                    digest.update((b"" if first else b"\n") + (rerole or role).encode())
                    digest.update(body)
            live[new] = (key[0], places[key[1:]], digest)
            back[2 * new], back[2 * new + 1] = old, _CODE[key[2]]
        self.live = live
        self.back += back

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired text)."""
        best = None
        for old, (cost, rank, digest) in self.live.items():
            for state, inserted in _inserts(old):
                key = (cost + INSERT * len(inserted), rank, "I" * len(inserted))
                if state in ACCEPT and (best is None or key < best[0]):
                    best = (key, old, inserted, digest)
        (cost, _, letters), state, inserted, digest = best
        if inserted:
            digest = digest.copy()
            for k, made in enumerate(inserted):
                digest.update(_INSERTED[made] if state == START and not k else b"\n" + _INSERTED[made])
        pieces = [letters.encode()]
        for at in range(len(self.back) - 8, -1, -8):
            pieces.append(_LETTERS[self.back[at + 2 * state + 1]])
            state = self.back[at + 2 * state]
        return cost, b"".join(reversed(pieces)).decode(), digest.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.repair, self.last = conv_id, Repair(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, role, text, fault) -> None:
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.illegal += self.last is not None and self.last + role[:1] not in _LEGAL
        self.last = role[:1]
        self.repair.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, min(gaps, 2**63 - 1), self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.result())


def _stream(batches):
    """Rows (conv_id, turn, role, text, fault, gone, ...) in order of conversation and turn."""
    open_one, done = None, []
    for batch in batches:
        columns = [batch.column(k) for k in range(6)]
        for k in range(batch.num_rows):  # value by value: a batch may hold very long texts
            conv_id, gone = columns[0][k].as_py(), columns[5][k].as_py()
            if open_one is None or open_one.conv_id != conv_id:
                if open_one is not None:
                    done.append(open_one.row())
                open_one = _Conversation(conv_id)
            if not gone:
                open_one.add(*(c[k].as_py() for c in columns[1:5]))
        if done:
            yield _table(done)
            done = []
    if open_one is not None:
        yield _table([open_one.row()])


def _table(rows):
    types = [pa.int64()] * 7 + [pa.string()] * 2
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACE))


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with ``fault``: blank, duplicate, truncated or null.

    Partitioned by conversation once; the window and the pass use the same partitions.
    """
    trimmed = _trimmed(F.col("text"))
    rows = rows.repartition("conv_id").withColumn("hash", F.xxhash64("text"))
    same = Window.partitionBy("conv_id", "gone", "role", "hash", "text").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.withColumn("again", F.row_number().over(same) > 1)
    fault = F.when(trimmed == "", "blank").when(F.col("again"), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), "gone", "again")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage; a dropped row stays as ``gone`` so that its conversation is reported."""
    own = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    rows = conversations.select(*own, *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("harm", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("harm").isin(0, 1), "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def repaired(rows: DataFrame) -> DataFrame:
    """Report a conversation of ``rows`` (conv_id, turn, role, text, gone)."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "again")]
    return with_faults(rows).sortWithinPartitions(*order).mapInArrow(_stream, RESULT)


def op12(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v::UBIGINT, list_transform(range(8), lambda k: k::UBIGINT)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
harmed AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)),
         lambda c, b: xor(list_extract(t, (xor(c, b) & 255)::BIGINT + 1), c >> 8)), 4294967295::UBIGINT) % 20 AS harm FROM raw, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM harmed, range(2) copies(n) WHERE harm <> 0 AND (n = 0 OR harm = 3)),
told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn ASC NULLS FIRST) AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, role, text, again) AS k FROM told),
faulty AS (
  SELECT conv_id, turn, role, text, k, left(role, 1) AS initial,
         CASE WHEN shown = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM faulty),
counts AS (
  SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(k) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN pairs p ON c.conv_id IS NOT DISTINCT FROM p.conv_id GROUP BY c.conv_id),
inserts(old, mid, paid, letters, added) AS (VALUES
  (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')),
edits(mid, letter, price, state, wanted) AS (VALUES
  (0, 'D', 3, 0, NULL), (1, 'D', 3, 1, NULL), (2, 'D', 3, 2, NULL), (3, 'D', 3, 3, NULL),
  (0, 'K', 0, 1, 's'), (0, 'K', 0, 2, 'u'), (1, 'K', 0, 2, 'u'), (3, 'K', 0, 2, 'u'), (2, 'K', 0, 3, 'a'),
  (0, 'R', 2, 2, NULL), (1, 'R', 2, 2, NULL), (3, 'R', 2, 2, NULL), (2, 'R', 2, 3, NULL)),
paths AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS state, {'cost': 0, 'audit': '', 'made': ''} AS best FROM counts UNION ALL
  SELECT p.conv_id, p.k + 1, e.state, min({
         'cost': p.best.cost + i.paid + e.price + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 1 ELSE 0 END,
         'audit': p.best.audit || i.letters || e.letter,
         'made': p.best.made || i.added || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || CASE e.state WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text END})
  FROM paths p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.k = p.k + 1 JOIN inserts i ON i.old = p.state
  JOIN edits e ON e.mid = i.mid AND (e.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.wanted IS NULL OR e.wanted = f.initial)
  GROUP BY p.conv_id, p.k, e.state),
ends AS (
  SELECT c.conv_id, min({'cost': p.best.cost + i.paid, 'audit': p.best.audit || i.letters, 'made': p.best.made || i.added}) AS best
  FROM counts c JOIN paths p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.k JOIN inserts i ON i.old = p.state AND i.mid IN (0, 3) GROUP BY c.conv_id)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, e.best.cost::BIGINT AS cost, e.best.audit AS audit, sha256(substr(e.best.made, 2)) AS repaired_sha256
FROM counts c JOIN ends e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
