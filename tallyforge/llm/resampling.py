r"""Target-distribution importance resampling over hashed word n-grams, long texts in overlapping chunks.

1. Texts of more than ``CHUNK`` bytes are cut at word boundaries into chunk rows and dealt to all tasks.  A chunk owns the words
   that begin in it and carries the next ``GRAM - 1`` words, so every n-gram begins in exactly one chunk and is whole there.
   Shorter texts are one chunk and stay where they were read; long ones are cut once and stored.
2. Features are all runs of 1 to ``GRAM`` words; a feature's bucket is its CRC-32 modulo ``BUCKETS``.  A word's CRC is computed once and
   CRCs of runs are put together from those of their words, in numpy.  Each task adds up its bucket counts before the shuffle.
3. Gains of buckets come from the counts of corpus and target: ``BUCKETS`` numbers, whatever the input.
4. A second pass sums gains and features a chunk; chunks are summed by document.
5. Score: weight plus Gumbel noise from the hash of doc_id, so the highest scores are a draw without replacement.  Ranks come from one
   total order dealt into ranges, the place in the range and a prefix sum over ranges; no key is kept together.

Defined cases: null and word-less texts have no features, weight 0 and are never drawn; equal scores go to the smaller doc_id, null ids last,
then by the row's place in the table; repeated rows are documents of their own (they share the noise); a null id is hashed as
the empty text; without target texts every bucket's gain is still defined; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import ROW_ID, byte_class, chunks, per_text, segment_sum, stored, token_bounds, with_row_id

GRAM = 3
BUCKETS = 10_000
CHUNK = 256 << 10
LEAST_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42

_SEPARATOR = ~byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Longer words get their CRC one by one.
_SHORT = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()
_BLANK = np.uint32(zlib.crc32(b" "))


def _look_up(tables: np.ndarray, which, crc: np.ndarray) -> np.ndarray:
    """Linear map ``which`` of ``tables``, given for the four bytes of its argument."""
    out = tables[which, 0, crc & 255] ^ tables[which, 1, (crc >> 8) & 255]
    return out ^ tables[which, 2, (crc >> 16) & 255] ^ tables[which, 3, crc >> 24]


def _shift_tables(levels: int = 6) -> list[np.ndarray]:
    """What ``d * 64**level`` zero bytes make of a CRC, for d of 0 to 63."""
    same = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = []
    for level in range(levels):
        tables = np.empty((64, 4, 256), np.uint32)
        tables[0] = same
        for d in range(1, 64):
            last = tables[d - 1]
            tables[d] = _TABLE[last & 255] ^ (last >> 8) if not level else _look_up(unit, 0, last)
        unit = _look_up(tables, 1, tables[63])[None]  # 64 times this level's step
        out.append(tables)
    return out


_SHIFTS = _shift_tables()


def _followed(crc: np.ndarray, then: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC of two strings one after the other, from their CRCs and the second one's size."""
    out, level = _look_up(_SHIFTS[0], size & 63, crc), 1
    size = size >> 6
    while size.any():
        more = np.flatnonzero(size)
        out[more] = _look_up(_SHIFTS[level], size[more] & 63, out[more])
        size, level = size >> 6, level + 1
    return out ^ then


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    size = end - start
    out = np.empty(len(start), np.uint32)
    for i in np.flatnonzero(size > _SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    short = np.flatnonzero(size <= _SHORT)
    short = short[np.argsort(-size[short], kind="stable")]
    at, left = start[short], np.bincount(size[short], minlength=_SHORT + 1)
    left = np.cumsum(left[::-1])[::-1]  # words of at least this size
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    for j in range(_SHORT):
        k = left[j + 1]
        if not k:
            break
        crc[:k] = _TABLE[(crc[:k] ^ data[at[:k] + j]) & 255] ^ (crc[:k] >> 8)
    out[short] = ~crc
    return out


def features(data: np.ndarray, offs: np.ndarray, owned: np.ndarray):
    """Buckets of all runs that begin in the owned bytes of each chunk: [(bucket, chunk of each)] by run length, and words owned a chunk."""
    data = _LOWER[data]
    start, end = token_bounds(data, offs, _SEPARATOR)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(per_text(start, offs)))
    own = start < offs[text] + owned[text]
    word, size = word_crcs(data, start, end), end - start
    runs, crc = [], word
    for n in range(1, GRAM + 1):
        if n > 1:
            if len(crc) < 2:
                break
            blank = _followed(crc[:-1], _BLANK, np.ones(len(crc) - 1, np.int64))
            crc = _followed(blank, word[n - 1 :], size[n - 1 :])
        whole = own[: len(crc)] & (text[: len(crc)] == text[n - 1 :])
        runs.append((crc[whole] % BUCKETS, text[: len(crc)][whole]))
    return runs, np.bincount(text[own], minlength=len(offs) - 1)


def _next_start(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where a word begins, or the end."""
    step = 4096
    while at < len(data):
        inside = ~_SEPARATOR[data[max(at - 1, 0) : at + step]]
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1 if at else np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
        if len(begins):
            return max(at - 1, 0) + int(begins[0])
        at, step = at + step, step * 2
    return len(data)


def _word_end(data: np.ndarray, at: int) -> int:
    """The end of the word that begins at ``at``."""
    step = 4096
    while at < len(data):
        gaps = np.flatnonzero(_SEPARATOR[data[at : at + step]])
        if len(gaps):
            return at + int(gaps[0])
        at, step = at + step, step * 2
    return len(data)


def cut(data: np.ndarray, limit: int):
    """(start, end of the owned bytes, end) of each chunk of one text."""
    start = 0
    while start < len(data):
        stop = end = _next_start(data, start + limit)
        for _ in range(GRAM - 1):
            end = _word_end(data, _next_start(data, end)) if end < len(data) else end
        yield start, stop, end
        start = stop


def _cut_texts(limit: int):
    def each(batches):
        for batch in batches:
            for row, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py().encode()
                for start, stop, end in cut(np.frombuffer(raw, np.uint8), limit):
                    piece = pa.array([raw[start:end].decode()], pa.string())
                    yield pa.record_batch([pa.array([row], pa.int64()), pa.array([own], pa.int64()), piece, pa.array([stop - start], pa.int64())], names=[ROW_ID, "own_id", "text", "owned"])

    return each


def chunked(texts: DataFrame, id_column: str) -> DataFrame:
    """(row, own_id, text, owned) of every chunk of ``texts``, a table read from files; ``owned`` is a number of bytes."""
    rows = with_row_id(texts).select(ROW_ID, F.col(id_column).cast("long").alias("own_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    short = rows.filter(size <= CHUNK).withColumn("owned", size)
    long = rows.filter(size > CHUNK).mapInArrow(_cut_texts(CHUNK), short.schema)
    return short.unionByName(stored(long.repartition(ROW_ID, "owned", F.xxhash64("text")), "chunks"))


def _features_of(batch):
    """Chunks of a batch a few megabytes at a time: first and last row, runs and word counts."""
    owned = batch.column(batch.schema.get_field_index("owned")).to_numpy()
    for a, b, data, offs in chunks(batch.column(batch.schema.get_field_index("text"))):
        yield a, b, *features(data, offs, owned[a:b])


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, runs, _ in _features_of(batch):
            for bucket, _ in runs:
                total += np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(total)
    yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["bucket", "n"])


def bucket_counts(parts: DataFrame) -> DataFrame:
    """(bucket, n) of all features of the chunks."""
    return parts.select("text", "owned").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket, from (bucket, n) of corpus and target."""
    both = corpus.withColumn("t", F.lit(0).cast("long")).withColumnRenamed("n", "s").unionByName(target.withColumn("s", F.lit(0).cast("long")).withColumnRenamed("n", "t"))
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # BUCKETS rows at most
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    all_s, all_t = s.sum() + BUCKETS, t.sum() + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def _weigh(gain: np.ndarray):
    def each(batches):
        for batch in batches:
            n_features, weight, n_words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b, runs, words in _features_of(batch):
                n_words[a:b] = words
                for bucket, text in runs:
                    bounds = np.searchsorted(text, np.arange(b - a + 1))
                    n_features[a:b] += np.diff(bounds)
                    weight[a:b] += segment_sum(gain[bucket], bounds)
            yield pa.record_batch([batch.column(0), batch.column(1), *map(pa.array, (n_words, n_features, weight))], names=[ROW_ID, "own_id", "n_words", "n_features", "weight"])

    return each


def resampled(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score, rank) of every row of ``documents``; rank is null where it is not drawn."""
    parts = chunked(documents, "doc_id")
    target = chunked(target.select("text", F.lit(None).cast("long").alias("none")), "none")
    gain = gains(bucket_counts(parts), bucket_counts(target))
    weighed = parts.select(ROW_ID, "own_id", "text", "owned").mapInArrow(_weigh(gain), f"{ROW_ID} long, own_id long, n_words long, n_features long, weight long")
    weighed = weighed.groupBy(ROW_ID, "own_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("own_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed.withColumns({"score": F.col("weight") + noise, "able": F.col("n_words") >= LEAST_WORDS})
    # one total order, dealt into ranges; documents that are too short come last
    order = [F.col("able").desc(), F.col("score").desc(), F.col("own_id").asc_nulls_last(), F.col(ROW_ID)]
    placed = stored(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "places")
    part = F.shiftright("place", 33)
    ranges = placed.groupBy(part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if("able").alias("able_n"))
    # a row a range: as many as shuffle partitions
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    drawn = F.floor(F.sum("able_n").over(Window.partitionBy()) * DRAWN_PERCENT / 100)
    ranges = ranges.select("part", F.col("first").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), drawn.alias("drawn"))
    rank = F.col("before") + F.col("place") - F.col("at") + 1
    ranked = placed.join(F.broadcast(ranges), part == F.col("part"))
    return ranked.select(ROW_ID, F.col("own_id").alias("doc_id"), "n_words", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank"))


def drawn(documents: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of ``documents``, with its columns, that are drawn."""
    chosen = resampled(documents, target).filter("rank is not null").select(F.col(ROW_ID).alias("__drawn"))
    return with_row_id(documents).join(chosen, F.col(ROW_ID) == F.col("__drawn"), "left_semi").select(*documents.columns)


def op11(spark, sf_dir: str) -> DataFrame:
    documents, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resampled(documents, target).drop(ROW_ID, "n_words")


OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v::UBIGINT, list_transform(range(8), lambda k: k::UBIGINT)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS nr, text FROM documents UNION ALL
  SELECT 'b', NULL, row_number() OVER (), text FROM benchmark),
words AS (
  SELECT side, doc_id, nr, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (
  SELECT side, doc_id, nr, len(w) AS n_words, flatten(list_transform(range(1, 4), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ')))) AS f FROM words),
each AS (SELECT side, nr, unnest(f) AS f FROM grams),
known AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM each)),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)),
         lambda c, b: xor(list_extract(t, (xor(c, b) & 255)::BIGINT + 1), c >> 8)), 4294967295::UBIGINT) % 10000 AS bucket FROM known, crc),
counted AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM each JOIN buckets USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM counted),
weights AS (SELECT nr, sum(g)::BIGINT AS weight FROM each JOIN buckets USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY nr),
scored AS (
  SELECT doc_id, nr, n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('42:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM grams LEFT JOIN weights USING (nr) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id ASC NULLS LAST, nr) AS r, count(*) FILTER (n_words >= 20) OVER () * 5 // 100 AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM ranked
"""
