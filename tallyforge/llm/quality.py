"""Quality rules: fixed counts of the text, then a calibrated hashed n-gram logistic regression.

Base counts (words, symbols, repeated lines, repeated 5-word windows) are vectorised over Arrow batches; lines and windows whose
hashes are equal are compared by their bytes.  The
model is logistic regression over the mean weight of a text's hashed words and word pairs and that of its 3-grams of code
points, trained by AdaGrad on a bounded sample of whole texts (``TRAIN_ROWS`` labelled rows and ``TRAIN_BYTES`` of text) and calibrated by Platt scaling on
the sample's fold ``CALIBRATION``, which training does not see.  Weights are broadcast as integers (8 * 2**BITS
bytes), so a text's score does not depend on its batch.  A text is kept if its probability is ``KEEP`` or more.

Defined cases: null and empty texts have no words and fail the base rules; without labels the model keeps
all; repeated rows get the same verdict; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Rolling, chunks, mix, per_text, segment_sum, token_bounds
from tallyforge.llm.sampling import labelled_sample

BITS = 18
TRAIN_ROWS = 6000
TRAIN_BYTES = 32 << 20
EPOCHS = 12
RATE, L2 = 0.5, 1e-4
SCALE = 20.0
# so many neutral words (with pairs) and 3-grams are added to each mean: short texts lean on the intercept
PRIOR_WORDS, PRIOR_GRAMS = 20, 100
KEEP = 0.5
MODULUS, CALIBRATION = 5, 1
WINDOW = 5
_UNIT = 1 << 16
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def coordinates(data: np.ndarray, offs: np.ndarray, rolling: Rolling, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates of words, of each word with the next (2**BITS at a text's last word: none), and of 3-grams of code points;
    the index of each text's first 3-gram, and one past the last."""
    shift = np.uint64(64 - BITS)
    pair = np.full(len(word), 1 << BITS, np.int64)
    if len(word) > 1:
        both = mix(word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) + word[1:] * np.uint64(0x9E3779B97F4A7C15)
        pair[:-1] = (both >> shift).astype(np.int64)
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    pair[last] = 1 << BITS
    at = np.flatnonzero((data & 0xC0) != 0x80)
    edge = np.append(at, len(data))
    gram = (rolling.span(edge[:-3], edge[3:]) >> shift).astype(np.int64) if len(at) > 2 else np.zeros(0, np.int64)
    first = np.searchsorted(at, offs)
    return (word >> shift).astype(np.int64), pair, gram, np.stack((first[:-1], np.maximum(first[:-1], first[1:] - 2)))


def _twins(key: np.ndarray) -> np.ndarray:
    """Places, in order, whose key stands elsewhere too."""
    order = np.argsort(key, kind="stable")
    twin = np.zeros(len(key), bool)
    if len(key) > 1:
        equal = key[order[1:]] == key[order[:-1]]
        twin[1:] |= equal
        twin[:-1] |= equal
    return np.sort(order[twin])


def base_counts(data: np.ndarray, offs: np.ndarray, rolling: Rolling, start: np.ndarray, end: np.ndarray, word: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    n_texts = len(offs) - 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out = {"n_words": np.diff(bounds), "word_chars": segment_sum(points[end] - points[start], bounds)}
    symbols = np.concatenate(([0], np.cumsum(_SYMBOLS[data])))
    out["n_symbols"] = symbols[offs[1:]] - symbols[offs[:-1]]
    text = np.repeat(np.arange(n_texts), np.diff(bounds))
    # lines: from a text's start or after \n, to the next \n or the text's end
    breaks = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate((offs[:-1], breaks + 1)))
    first = first[first < len(data)]
    first = np.unique(first)
    last = np.concatenate((first[1:], [len(data)])) if len(first) else first
    # a line ends before its \n, if it has one
    last = last - ((last > first) & (data[last - 1] == 10)) if len(first) else last
    worded = np.searchsorted(start, last) > np.searchsorted(start, first)
    first, last = first[worded], last[worded]
    owner = np.searchsorted(offs, first, "right") - 1
    key = mix(rolling.span(first, last) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out["n_dup_lines"] = np.zeros(n_texts, np.int64)
    seen: set[tuple[int, bytes]] = set()
    # equal hashes only nominate: lines are compared byte by byte
    for i in _twins(key):
        line = (int(owner[i]), data[first[i] : last[i]].tobytes())
        if line in seen:
            out["n_dup_lines"][line[0]] += 1
        seen.add(line)
    # words under a 5-word window that its text has twice
    n = len(word) - WINDOW + 1
    out["n_repeat_words"] = np.zeros(n_texts, np.int64)
    if n > 0:
        h = word[:n].copy()
        for k in range(1, WINDOW):
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n]
        whole = text[:n] == text[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        h = mix(h[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = at[_twins(h)]
        # windows with equal hashes are compared by their words, numbered by their bytes
        wanted = np.unique(at[:, None] + np.arange(WINDOW)) if len(at) else at
        number: dict[bytes, int] = {}
        numbers = np.zeros(len(word), np.int64)
        numbers[wanted] = [number.setdefault(data[a:b].tobytes(), len(number)) for a, b in zip(start[wanted], end[wanted], strict=True)]
        rows = np.column_stack((text[at], *(numbers[at + k] for k in range(WINDOW))))
        _, which, often = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        cover = np.zeros(len(word) + 1, np.int64)
        at = at[often[which.ravel()] > 1]
        cover[at] += 1
        cover[at + WINDOW] -= 1
        out["n_repeat_words"] = np.bincount(text[np.cumsum(cover)[:-1] > 0], minlength=n_texts)
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse rows of the training sample: coordinate (3-grams after words) and scaled mean."""
    for batch in batches:
        at: list[np.ndarray] = []
        value: list[np.ndarray] = []
        for a, b, data, offs in chunks(batch.column("text")):
            start, end = token_bounds(data, offs)
            rolling, bounds = Rolling(data), per_text(start, offs)
            words, pairs, grams, (lo, hi) = coordinates(data, offs, rolling, rolling.span(start, end), bounds)
            for i in range(b - a):
                own = np.concatenate((words[bounds[i] : bounds[i + 1]], pairs[bounds[i] : max(bounds[i], bounds[i + 1] - 1)]))
                w, wn = np.unique(own, return_counts=True)
                g, gn = np.unique(grams[lo[i] : hi[i]], return_counts=True)
                own = np.concatenate((w, g.astype(np.int64) + (1 << BITS))).astype(np.int32)
                mean = np.concatenate((wn / (wn.sum() + PRIOR_WORDS), gn / (gn.sum() + PRIOR_GRAMS))).astype(np.float32) * np.float32(SCALE)
                at.append(own)
                value.append(mean)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), batch.column("fold"), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["doc_id", "label", "fold", "at", "value"]
        )


def fit(label: np.ndarray, bounds: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, float]:
    """AdaGrad over mini-batches of 128 sparse rows."""
    w, g2 = np.zeros(2 << BITS), np.full(2 << BITS, 1e-8)
    b, b2 = 0.0, 1e-8
    shuffle = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = shuffle.permutation(len(label))
        for k in range(0, len(order), 128):
            rows = order[k : k + 128]
            n = bounds[rows + 1] - bounds[rows]
            flat = np.repeat(bounds[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, v = at[flat], value[flat]
            own = np.repeat(np.arange(len(rows)), n)
            z = np.bincount(own, w[i] * v, len(rows)) + b
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]
            which, back = np.unique(i, return_inverse=True)
            g = np.bincount(back, miss[own] * v) / len(rows) + L2 * w[which]
            g2[which] += g * g
            w[which] -= RATE * g / np.sqrt(g2[which])
            gb = miss.mean()
            b2 += gb * gb
            b -= RATE * gb / np.sqrt(b2)
    return w, b


def platt(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated log-odds, by Newton's method on smoothed targets."""
    pos, neg = label.sum(), (1 - label).sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    def loss(a: float, b: float) -> float:
        x = a * z + b
        return float((np.logaddexp(0, x) - t * x).sum())

    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([(d * z).sum(), d.sum()])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]]), g)
        # a full step may leap over the minimum where the classes lie far apart
        size, now = 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if abs(size * step).max() < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def train(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """Integer weights, intercept, and Platt slope and shift."""
    # no fold is held out here, but calibration needs one of its own
    sample = labelled_sample(documents, labels, "quality", TRAIN_ROWS, MODULUS, -1, TRAIN_BYTES).select("doc_id", "text", "label", F.col("fold").cast("int").alias("fold"))
    got = sample.mapInArrow(_hashed, "doc_id long, label int, fold int, at array<int>, value array<float>").toArrow()
    if not got.num_rows:
        return np.zeros(2 << BITS, np.int32), 30.0, 1.0, 0.0
    got = got.take(pa.array(np.argsort(mix(np.asarray(got.column("doc_id").combine_chunks()).astype(np.int64).view(np.uint64)), kind="stable")))
    at, value = got.column("at").combine_chunks(), got.column("value").combine_chunks()
    bounds, label = np.asarray(at.offsets) - np.asarray(at.offsets)[0], np.asarray(got.column("label")).astype(float)
    at, value = np.asarray(at.flatten()), np.asarray(value.flatten()).astype(float)
    tests = np.asarray(got.column("fold")) == CALIBRATION
    rows = np.flatnonzero(~tests) if not tests.all() else np.arange(len(label))
    n = np.diff(bounds)[rows]
    flat = np.repeat(bounds[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    w, b = fit(label[rows], np.concatenate(([0], np.cumsum(n))), at[flat], value[flat])
    z = np.bincount(np.repeat(np.arange(len(label)), np.diff(bounds)), w[at] * value, len(label)) + b
    return np.round(w * _UNIT).astype(np.int32), b, *platt(z[tests], label[tests])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept, slope, shift = model.value
        of_words, of_grams = np.append(weights[: 1 << BITS], 0), weights[1 << BITS :]
        for batch in batches:
            parts: dict[str, list] = {k: [] for k in (*_COUNTS, "z")}
            for _, _, data, offs in chunks(batch.column("text")):
                start, end = token_bounds(data, offs)
                rolling, bounds = Rolling(data), per_text(start, offs)
                word = rolling.span(start, end)
                for k, v in base_counts(data, offs, rolling, start, end, word, bounds).items():
                    parts[k].append(v)
                words, pairs, grams, (lo, hi) = coordinates(data, offs, rolling, word, bounds)
                sums = np.concatenate(([0], np.cumsum(of_grams[grams], dtype=np.int64)))
                size, n = len(sums) - 1, np.diff(bounds)
                mean = segment_sum(of_words[words].astype(np.int64) + of_words[pairs], bounds) / (2 * n - (n > 0) + PRIOR_WORDS)
                mean = mean + (sums[np.minimum(hi, size)] - sums[np.minimum(lo, size)]) / (hi - lo + PRIOR_GRAMS)
                parts["z"].append(SCALE * mean / _UNIT + intercept)
            col = {k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}
            p = 1 / (1 + np.exp(-np.clip(slope * col["z"] + shift, -30, 30)))
            failed = (col["n_words"] < 10) | (100 * col["n_repeat_words"] > 20 * col["n_words"])
            arrays = [batch.column("doc_id"), *(pa.array(col[k].astype(np.int64)) for k in _COUNTS), pa.array(failed), pa.array(~failed & (p >= KEEP)), pa.array(p)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *_COUNTS, "base_failed", "kept", "probability"])

    return score


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base verdict, verdict and probability of every row of ``documents``."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model), "doc_id long, " + ", ".join(f"{k} long" for k in _COUNTS) + ", base_failed boolean, kept boolean, probability double")


def op4(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(documents, labels)
