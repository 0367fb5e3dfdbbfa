"""SimHash near-duplicates by bit-sliced comparison.

1. Fingerprints: one pass over the texts (C-speed XXH64 a shingle, vectorised bit counts).
2. Distinct fingerprints with their smallest doc_id; exact copies collapse here, with map-side combine.
3. Candidates by nested pigeonhole: of three bands at least one is equal in any pair within two bits,
   and of three parts of the rest again at least one.  Nine keys of 35 or 36 bits a fingerprint.  A key
   with more than ``BUCKET`` fingerprints is split by a third level of three parts; distinct
   fingerprints that agree on 45 bits or more are at most 2**19, so every bucket is bounded.
4. Comparison in a bucket: bit planes stored vertically, 64 fingerprints a word; carry-save counters
   hold 64 distances at once, and a block is abandoned when all of its distances exceed the radius.
   A bucket returns a spanning forest of its links, not its pairs.
5. Connected components over the forests (:mod:`components`).

Defined cases: null and word-less texts have fingerprint zero and link like any other; repeated rows
stay, one output row each; a null doc_id is ignored as a component's smallest id unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ROW_ID, chunks, stored, with_row_id
from tallyforge.llm.components import components

WIDTH = 3
RADIUS = 2
SEED = 42
BUCKET = 512
SLICE = 1 << 16
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of one text's word shingles."""
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -WIDTH])).tolist()
    digest = xxhash.xxh64_intdigest
    found = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[WIDTH - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > len(found)].sum())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        out = np.zeros(len(texts), np.uint64)
        for a, b, data, offs in chunks(texts):
            raw = data.tobytes()
            at = offs.tolist()
            out[a:b] = [fingerprint(raw[at[i] : at[i + 1]]) for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(ROW_ID), batch.column("doc_id"), pa.array(out.view(np.int64))], [ROW_ID, "doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(row, doc_id, fp) of every row of ``documents``."""
    rows = with_row_id(documents).select(ROW_ID, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, f"{ROW_ID} long, doc_id long, fp long")


_BANDS = ((0, 22), (22, 21), (43, 21))


def _bits(x: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _split(width: int) -> list[tuple[int, int]]:
    cuts = [0, width // 3, 2 * width // 3, width]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _keys() -> Column:
    """Nine (band, part) keys with what is left of the fingerprint, for a third level."""
    out = []
    for b, (at, width) in enumerate(_BANDS):
        (p, pw), (q, qw) = [x for x in _BANDS if x != (at, width)]
        rest = _bits(F.col("fp"), p, pw).bitwiseOR(F.shiftleft(_bits(F.col("fp"), q, qw), pw))
        parts = _split(pw + qw)
        for s, (x, w) in enumerate(parts):
            (y, yw), (z, zw) = [t for t in parts if t != (x, w)]
            key = F.shiftleft(_bits(F.col("fp"), at, width), 15).bitwiseOR(_bits(rest, x, w))
            left = _bits(rest, y, yw).bitwiseOR(F.shiftleft(_bits(rest, z, zw), yw))
            tag = F.lit((3 * b + s) << 40).cast("long")
            out.append(F.struct(key.bitwiseOR(tag).alias("key"), left.alias("left")))
    return F.array(*out)


def _third() -> Column:
    return F.array(*(F.struct(F.lit(i).alias("third"), _bits(F.col("left"), at, w).alias("value")) for i, (at, w) in enumerate(_split(29))))


def _near(mine: np.ndarray, words_w: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (fingerprint, word w) hold a lane within ``radius``; a 64-bit lane mask each.

    planes[j, w]: bit j of the 64 fingerprints in word w.  Counters saturate at four, so radius <= 3.
    """
    live = np.arange(len(mine))
    ones, twos, over = (np.zeros(len(mine), np.uint64) for _ in range(3))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(64):
        # all ones where the fingerprint's bit is set
        x = planes[j, words_w] ^ (np.uint64(0) - ((mine >> np.uint64(j)) & np.uint64(1)))
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if j % 8 == 7:
            far = over | ((ones & twos) if radius == 2 else twos if radius == 1 else ones | twos if radius == 0 else np.uint64(0))
            keep = far != full
            if not keep.all():
                live, ones, twos, over = live[keep], ones[keep], twos[keep], over[keep]
                mine, words_w = mine[keep], words_w[keep]
            if not len(live):
                break
    far = over | ((ones & twos) if radius == 2 else twos if radius == 1 else ones | twos if radius == 0 else np.uint64(0))
    return live, ~far


def _root(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if np.array_equal(up, label):
            return label
        label = up


def linked(prints: np.ndarray, bounds: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links in each bucket ``prints[bounds[k]:bounds[k+1]]``."""
    sizes = np.diff(bounds)
    # a bucket of up to 64 shares a word with others; a larger one starts a word of its own
    slot = np.zeros(len(prints), np.int64)
    at = 0
    for k, n in enumerate(sizes.tolist()):
        room = 64 - at % 64
        if n > room:
            at += room % 64
        slot[bounds[k] : bounds[k + 1]] = np.arange(at, at + n)
        at += n
    n_words = -(-at // 64)
    lanes = np.zeros(n_words * 64, np.uint64)
    lanes[slot] = prints
    of = np.full(n_words * 64, -1, np.int64)
    of[slot] = np.arange(len(prints))
    bucket = np.full(n_words * 64, -1, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bucket[slot] = owner
    shifts = np.arange(64, dtype=np.uint64)
    planes = np.empty((64, n_words), np.uint64)
    for j in range(64):
        planes[j] = np.bitwise_or.reduce(((lanes >> np.uint64(j)) & np.uint64(1)).reshape(n_words, 64) << shifts, axis=1)
    first = slot[bounds[:-1]][owner] // 64
    last = slot[bounds[1:] - 1][owner] // 64
    label = np.arange(len(prints))
    spans = np.cumsum(last - first + 1)
    at = 0
    while at < len(prints):
        # about 32k pairs of a fingerprint and a word at once
        to = max(at + 1, int(np.searchsorted(spans, (spans[at - 1] if at else 0) + (1 << 15), "right")))
        reach = (last - first + 1)[at:to]
        i = np.repeat(np.arange(at, to), reach)
        w = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(first[at:to], reach)
        live, near = _near(prints[i], w, planes, radius)
        i, w = i[live], w[live]
        for q in range(0, len(i), 1 << 12):
            hit = np.unpackbits(near[q : q + (1 << 12)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            hit &= bucket.reshape(n_words, 64)[w[q : q + (1 << 12)]] == owner[i[q : q + (1 << 12)]][:, None]
            r, lane = np.nonzero(hit)
            a, b = i[q : q + (1 << 12)][r], of[w[q : q + (1 << 12)][r] * 64 + lane]
            while len(a):
                a, b = label[a], label[b]
                differ = a != b
                a, b = a[differ], b[differ]
                if not len(a):
                    break
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                label = _root(label)
        at = to
    child = np.flatnonzero(label != np.arange(len(prints)))
    return prints[child], prints[label[child]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        bounds = np.asarray(lists.offsets).astype(np.int64)
        prints = np.asarray(lists.values).astype(np.int64).view(np.uint64)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        at = 0
        while at < len(lists):
            # whole buckets, SLICE fingerprints at once
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
            a, b = linked(prints[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            at = to


def links(distinct: DataFrame) -> DataFrame:
    """Forests (a, b) of fingerprints within the radius, over the distinct ``fp`` of ``distinct``."""
    keyed = distinct.select("fp", F.explode(_keys()).alias("k")).select("fp", "k.key", "k.left")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = stored(keyed.join(shared, "key"), "buckets")
    small = rows.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    large = rows.filter(F.col("n") > BUCKET).select("key", "fp", F.explode(_third()).alias("t")).groupBy("key", "t").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return small.select("fps").union(large.select("fps")).mapInArrow(_links, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(row, doc_id, fp, root, component_id) of every row; component_id is the group's smallest doc_id."""
    prints = stored(fingerprints(documents), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")), "a", "b")
    group = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    group = stored(group, "groups")
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(group.join(least, "root").select("fp", "root", "component_id"), "fp")


def op9(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` without all but one row of each near-duplicate group: the smallest doc_id, then row."""
    best = near_duplicates(documents).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW_ID)).alias("best"))
    return with_row_id(documents).join(best.select(F.col(f"best.{ROW_ID}").alias(ROW_ID)), ROW_ID, "left_semi").drop(ROW_ID).select(documents.columns)
