"""Removal of repeated byte passages with suffix arrays.

A byte goes if a ``WIDTH``-byte string that covers it also starts anywhere else.

1. Every ``WIDTH``-byte window has one minimizer, the least-hashed ``GRAM``-byte string in it.  Runs of
   windows with the same minimizer form a segment (about 170 windows, 570 bytes).  Equal windows have equal
   minimizers, so only segments whose minimizer occurs twice or more can hold repeats: the rest, most of
   the corpus, is never sorted.
2. Equal segments collapse to one with a multiplicity (map-side combine), so a thousand copies cost one.
3. Distinct segments are dealt to shards of about ``SHARD_BYTES`` by minimizer.  A shard builds a suffix
   array by Larsson-Sadakane refinement, then common prefixes by Kasai's bound, both in numpy.  Runs of
   suffixes that share ``WIDTH`` bytes and stand for two or more places are repeats.
4. A minimizer with more than ``HOT`` distinct segments is split over several shards.  Those return the sorted keys of
   their runs as arrays, one for each of as many key ranges; merging finds keys of other shards by binary search.
5. The windows of a segment overlap, so its repeats cover one range.  It goes back to every place of the segment;
   ranges are merged per text, and cut.

Nothing is sampled or capped; the hash of a segment is used with its minimizer's, 128 bits together.
Defined cases: null and empty texts have no bytes; texts under ``WIDTH`` bytes lose nothing; repeated
rows are copies of each other; a passage that repeats within one text counts, overlaps included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ROW_ID, Rolling, chunks, stored, with_row_id

WIDTH = 400
GRAM = 64
SHARD_BYTES = 2 << 20
PIECE = 1 << 19
HOT = 2048

_SEGMENTS = f"{ROW_ID} long, off int, n int, gram long, body long"
_LOW = np.uint64(0xFFFFFFFF)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for each full window, by block prefixes and suffixes."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def segments_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window's offset in it, windows, minimizer hash, segment hash) of each segment."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < WIDTH:
        return empty
    rolling = Rolling(data)
    grams = rolling.every(GRAM)
    order = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(order, WIDTH - GRAM + 1) & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(at)]
    whole = np.arange(len(at)) + WIDTH <= offs[1:][text]
    start = np.flatnonzero(whole)
    if not len(start):
        return empty
    at = at[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(start)))
    a = start[first]
    body = rolling.span(a, a + count - 1 + WIDTH)
    return text[a], a - offs[:-1][text[a]], count, grams[at[first]].view(np.int64), body.view(np.int64)


def _pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`segments_of` in steps of ``PIECE`` windows, so that a long text takes no more memory than a short one.

    A step may part a segment in two; both keep its minimizer, so no equal windows are lost.
    """
    if len(data) <= PIECE + WIDTH:
        yield segments_of(data, offs)
        return
    for lo in range(0, len(data), PIECE):
        hi = min(len(data), lo + PIECE + WIDTH - 1)
        own = np.clip(offs, lo, hi) - lo
        text, off, n, gram, body = segments_of(data[lo:hi], own)
        yield text, off + own[text] + lo - offs[text], n, gram, body


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.asarray(batch.column(ROW_ID))
        found = ((a, b, part) for a, b, data, offs in chunks(batch.column("text"), PIECE) for part in _pieces(data, offs))
        for a, b, (text, off, n, gram, body) in found:
            yield pa.RecordBatch.from_arrays([pa.array(rows[a:b][text]), pa.array(off.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(gram), pa.array(body)], [ROW_ID, "off", "n", "gram", "body"])


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes at least, by Larsson-Sadakane refinement,
    and the 8-byte words at each place.  Only groups that still tie are sorted again."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(words)
    # the end of the data counts as zero bytes: no suffix of interest reaches it
    sorted_words = words[order]
    head = np.ones(n, bool)
    head[1:] = sorted_words[1:] != sorted_words[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    place = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    rank[order] = place[group]
    del sorted_words
    h = 8
    # a group's rank is its first place in the order, so refining one group leaves the others' ranks alone
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    while h < depth and len(tied):
        suffixes = order[tied]
        key = (rank[suffixes].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(suffixes + h, n)] + 1).astype(np.uint64)
        by = np.argsort(key)
        suffixes, key = suffixes[by], key[by]
        order[tied] = suffixes
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(fresh)
        rank[suffixes] = tied[first][np.cumsum(fresh) - 1]
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order, words


def shared_prefix(order: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix shares ``width`` bytes with the one before it in the order.

    Kasai's bound, vectorised over a block of places at a time: common prefixes are found in full for every 32nd place of the text; each
    other place begins from that value less its distance if its predecessor is the anchor's moved as far.  Elsewhere
    the bound is not safe, as suffixes that agree in all refined bytes stand in any order: these begin from zero.
    """
    n = len(order)
    prior = np.full(n, -1, np.int64)
    prior[order[1:]] = order[:-1]
    common = np.zeros(n, np.int64)

    def extend(i: np.ndarray, have: np.ndarray) -> None:
        j = prior[i]
        ok = (j >= 0) & (np.maximum(i, j) + width <= n)
        i, j, have = i[ok], j[ok], have[ok]
        while len(i):
            at = np.minimum(have, width - 8)
            same = words[i + at] == words[j + at]
            common[i[~same]] = have[~same]
            done = same & (at + 8 >= width)
            common[i[done]] = width
            go = same & ~done
            i, j, have = i[go], j[go], at[go] + 8

    stride, block = 32, 1 << 17
    for lo in range(0, n, block):
        places = np.arange(lo, min(n, lo + block))
        anchors = places[::stride]
        extend(anchors, np.zeros(len(anchors), np.int64))
        rest = places[places % stride > 0]
        step = rest % stride
        before = prior[rest - step]
        follows = (before >= 0) & (prior[rest] == before + step)
        extend(rest, np.where(follows, np.maximum(common[rest - step] - step, 0), 0))
    out = np.zeros(n, bool)
    out[1:] = common[order[1:]] >= width
    return out


def repeated_windows(bodies: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the joined segments.  For each window: segment, offset, run, places its run has."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    starts = np.cumsum(sizes) - sizes
    order, words = suffix_array(data, WIDTH)
    run = np.cumsum(~shared_prefix(order, words, WIDTH)) - 1
    segment = np.repeat(np.arange(len(bodies)), sizes)[order]
    offset = order - starts[segment]
    window = offset + WIDTH <= sizes[segment]
    segment, offset, run = segment[window], offset[window], run[window]
    total = np.bincount(run, weights=places[segment])
    return segment, offset, run, total[run].astype(np.int64)


_FOUND = "gram long, body long, a int, b int, slice int, closed array<long>, open array<long>, open_body array<long>, open_a array<int>"
_RANGES = "gram long, body long, a int, b int"


def _lists(flat: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat, kind))


def _slice_of(key: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Range of the unsigned 64-bit key among ``parts`` equal ones."""
    return (((key.view(np.uint64) >> np.uint64(32)) * parts.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def _shard(found: pa.Table) -> pa.Table:
    """What a shard knows: a row per segment with repeats (first and last window), and for split minimizers a row per slice of its keys.

    The windows of a segment start within ``WIDTH`` bytes of each other, so the bytes that its repeats cover are one range.
    A slice has the sorted keys of runs that repeat in the shard (``closed``) and those of runs with a single place (``open``).
    """
    bodies = [x or b"" for x in found.column("bytes").to_pylist()]
    gram, body, parts = (np.asarray(found.column(k)) for k in ("gram", "body", "parts"))
    segment, offset, run, total = repeated_windows(bodies, np.asarray(found.column("places")))
    low, high = np.full(len(bodies), WIDTH, np.int64), np.full(len(bodies), -1, np.int64)
    twice = total > 1
    np.minimum.at(low, segment[twice], offset[twice])
    np.maximum.at(high, segment[twice], offset[twice])
    own = np.flatnonzero(high >= 0)
    none = lambda n, kind: pa.nulls(n, kind)
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    tables = [[pa.array(gram[own]), pa.array(body[own]), pa.array(low[own].astype(np.int32)), pa.array(high[own].astype(np.int32)), none(len(own), pa.int32()), none(len(own), longs), none(len(own), longs), none(len(own), longs), none(len(own), ints)]]
    if (parts > 1).any():
        _, one = np.unique(run, return_index=True)
        one = one[parts[segment[one]] > 1]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        at = (np.cumsum(sizes) - sizes)[segment[one]] + offset[one]
        key = Rolling(data).span(at, at + WIDTH).view(np.int64)
        piece = _slice_of(key, parts[segment[one]])
        by = np.lexsort((key, piece, gram[segment[one]]))
        one, key, piece = one[by], key[by], piece[by]
        owner, alone = gram[segment[one]], total[one] == 1
        fresh = np.ones(len(one), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(fresh)
        edge = np.append(first, len(one))
        seen = np.concatenate(([0], np.cumsum(alone)))[edge]
        pick = np.flatnonzero(alone)
        n = len(first)
        tables.append(
            [pa.array(owner[first]), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.int32()), pa.array(piece[first].astype(np.int32)), _lists(key[~alone], edge - seen, pa.int64()), _lists(key[pick], seen, pa.int64()), _lists(body[segment[one[pick]]], seen, pa.int64()), _lists(offset[one[pick]].astype(np.int32), seen, pa.int32())]
        )
    names = ["gram", "body", "a", "b", "slice", "closed", "open", "open_body", "open_a"]
    return pa.concat_tables([pa.table(t, names) for t in tables])


def _merge(found: pa.Table) -> pa.Table:
    """Segments of a split minimizer with open windows whose key another shard also has, by binary search in one slice."""
    flat = lambda k: np.asarray(pa.chunked_array([x.flatten() for x in found.column(k).chunks], found.schema.field(k).type.value_type))
    key, body, a = flat("open"), flat("open_body"), flat("open_a")
    merged = np.sort(np.concatenate((key, flat("closed"))))
    # a shard has each key once
    hit = np.searchsorted(merged, key, "right") - np.searchsorted(merged, key, "left") > 1
    body, a = body[hit], a[hit]
    by = np.lexsort((a, body))
    body, a = body[by], a[by]
    fresh = np.ones(len(body), bool)
    fresh[1:] = body[1:] != body[:-1]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(body)) - 1 if len(body) else first
    gram = found.column("gram")[0].as_py()
    return pa.table([pa.array(np.full(len(first), gram, np.int64)), pa.array(body[first]), pa.array(a[first]), pa.array(a[last])], ["gram", "body", "a", "b"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted segments out of their texts."""
    for batch in batches:
        texts = batch.column("text")
        wanted = batch.column("wanted")
        bounds = np.asarray(wanted.offsets)
        fields = wanted.values
        off, n = np.asarray(fields.field("off")), np.asarray(fields.field("n"))
        rows: list[int] = []
        bodies: list[bytes] = []
        for a, b, data, offs in chunks(texts):
            raw = data.tobytes()
            for i in range(a, b):
                for k in range(bounds[i], bounds[i + 1]):
                    at = int(offs[i - a]) + int(off[k])
                    rows.append(k)
                    bodies.append(raw[at : at + int(n[k]) - 1 + WIDTH])
        take = fields.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([take.field("shard"), take.field("gram"), take.field("body"), take.field("places"), take.field("parts"), pa.array(bodies, pa.binary())], ["shard", "gram", "body", "places", "parts", "bytes"])


def repeats(documents: DataFrame) -> DataFrame:
    """(row, spans) of the rows with repeated passages: byte ranges start..end, not yet merged."""
    rows = with_row_id(documents).select(ROW_ID, F.col("text").cast("string").alias("text"))
    found = stored(rows.filter(F.octet_length("text") >= WIDTH).mapInArrow(_segments, _SEGMENTS), "segments")
    # stored, so that both sides of the join are exchanges and a frequent minimizer can be split
    twice = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("gram"), "twice")
    found = stored(found.join(twice, "gram", "left_semi"), "shared")
    kinds = found.groupBy("gram", "body").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct(ROW_ID, "off")).alias("at"), F.max("n").alias("n"))
    kinds = stored(kinds, "kinds")
    size = kinds.agg(F.sum(F.col("n") + WIDTH).alias("size")).first()["size"] or 0
    shards = max(1, -(-int(size) // SHARD_BYTES))
    # stored for the same reason; at most one row for HOT segments
    hot = stored(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > HOT).select("gram", F.ceil(F.col("kinds") / HOT).alias("split")), "hot")
    parts = F.coalesce("split", F.lit(1))
    dealt = kinds.join(hot, "gram", "left").select(
        F.col(f"at.{ROW_ID}").alias(ROW_ID),
        F.struct(F.pmod(F.xxhash64("gram", F.pmod(F.col("body"), parts)), F.lit(shards)).alias("shard"), "gram", "body", "places", parts.alias("parts"), F.col("at.off").alias("off"), "n").alias("one"),
    )
    wanted = dealt.groupBy(ROW_ID).agg(F.collect_list("one").alias("wanted"))
    bodies = rows.join(wanted.hint("shuffle_hash"), ROW_ID).select("text", "wanted").mapInArrow(_bodies, "shard long, gram long, body long, places long, parts long, bytes binary")
    out = stored(bodies.groupBy("shard").applyInArrow(_shard, _FOUND), "runs")
    # as many slices a split minimizer as it has parts, so a slice is about as long as a shard
    merged = out.filter("slice is not null").select("gram", "slice", "closed", "open", "open_body", "open_a").groupBy("gram", "slice").applyInArrow(_merge, _RANGES)
    ranges = out.filter("slice is null").select("gram", "body", "a", "b").union(merged).groupBy("gram", "body").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    spans = found.join(stored(ranges, "ranges"), ["gram", "body"]).select(ROW_ID, F.struct((F.col("off") + F.col("a")).alias("start"), (F.col("off") + F.col("b") + WIDTH).alias("end")).alias("span"))
    return spans.groupBy(ROW_ID).agg(F.collect_list("span").alias("spans"))


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(fresh)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        bounds = np.asarray(spans.offsets)
        flat = spans.flatten()
        shift = bounds[0]
        start, end = (np.asarray(flat.field(x)) if len(flat) else np.zeros(0, np.int32) for x in ("start", "end"))
        rows: list[tuple] = []
        for a, b, data, offs in chunks(batch.column("text")):
            raw = data.tobytes()
            for i in range(a, b):
                text = raw[offs[i - a] : offs[i - a + 1]]
                lo, hi = bounds[i] - shift, bounds[i + 1] - shift
                removed: list[tuple[int, int]] = []
                if hi > lo:
                    s, e = _union(start[lo:hi], end[lo:hi])
                    removed = list(zip(s.tolist(), e.tolist(), strict=True))
                at, kept = 0, hashlib.sha256()
                for s, e in removed:
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                rows.append((len(text), sum(e - s for s, e in removed), len(removed), kept.hexdigest(), removed))
        n_bytes, n_removed, n_spans, digest, removed = zip(*rows, strict=True) if rows else ((),) * 5
        pairs = pa.array([[{"start": s, "end": e} for s, e in x] for x in removed], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pairs],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges, one row per document."""
    rows = with_row_id(documents).select(ROW_ID, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.join(repeats(documents).hint("shuffle_hash"), ROW_ID, "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.select("doc_id", "text", F.coalesce("spans", none).alias("spans")).mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    )


def op7(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeated"))
