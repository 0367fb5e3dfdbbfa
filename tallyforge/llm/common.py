"""Shared helpers of the corpus operators: tables, durable intermediates and vectorised tokens.

Rows are keyed by ``monotonically_increasing_id`` over a stored table (:func:`with_row_id`), because
``doc_id`` may be null or repeated.  The id depends only on the scan's partition and the row's place in
it, so a retried task and a second scan of the same table give the same ids.  How a scan is split depends on
the executors there are at the time unless ``spark.sql.files.minPartitionNum`` is set; the first use sets it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.durable import discard, fresh_path, stored  # noqa: F401  (the operators' one place for them)

ROW_ID = "__row"
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steady_splits(spark: SparkSession) -> None:
    """Make every scan of a file split alike, whatever executors there are."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def with_row_id(df: DataFrame) -> DataFrame:
    """``df``, read from files, with an id for each row that is the same in every scan, executors lost or won."""
    steady_splits(df.sparkSession)
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def fold(col: str, modulus: int):
    """crc32 of the id's text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """Yield (first row, end row, bytes, offsets) over whole texts, about ``limit`` bytes at a time.

    A text longer than ``limit`` is a chunk of its own.  Null texts count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Separators of the contracts' ``[^\x20\x09-\x0D]+`` words.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))


def token_bounds(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE):
    """Start and end of each token; a token never crosses a text's end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = offs[1:] - 1
    after[ends[ends >= 0]] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _mix
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 8 << 20:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Prefix sums of a polynomial hash: the hash of any byte range in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed 64-bit hash of bytes start..end; the length takes part."""
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mix(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def every(self, width: int) -> np.ndarray:
        """Hash of each ``width``-byte string, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return _mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def per_text(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index bounds of each text's tokens among all: ``bounds[i]:bounds[i+1]``."""
    return np.searchsorted(starts, offs)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]]; empty segments give zero."""
    total = np.zeros((len(bounds) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        total[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=total.dtype)
    return total
