"""Language identification by prediction by partial matching with frozen statistics.

Training: byte n-grams of all labelled documents outside the held-out fold are counted by executors with
map-side sums, in one pass; nothing is sampled.  From these, per language, a context tree of
orders 0 to 3 is built: a seen symbol costs n / (N + q) of the context's mass, and the escape mass
q / (N + q) goes to the next shorter context with the seen symbols excluded, so every context's
predictions sum to one and code lengths are exact.  Order-3 contexts are kept if seen ``LEAST`` times
(at most ``CONTEXTS`` of them, most frequent first, told by Spark); elsewhere the order-2 context is the longest.
What reaches the driver, counts of three bytes and of four in those contexts, is no more than the costs below.

Frozen statistics make a symbol's cost a function of at most three bytes before it, so scoring is table
look-ups over whole Arrow batches: (A**2 + CONTEXTS) * A * languages 2-byte costs, with A the bytes seen and one class for
all others, are broadcast.  Costs are integers, so sums do not depend on batches.  Every language is learned: languages of
like bytes form groups of at most ``LANGUAGES`` and about ``CELLS`` costs, one broadcast at a time; with more than one group
the rows go through a pass a group, stored between, and keep their least code length and the sum for the score.

The pipeline's stage also rejects on code length a byte.  Each language's limit is the ``OUTER`` quantile over its
training documents of fold ``PROBE``, told by a model that has not seen that fold, plus ``SPREAD`` times the distance
from the median; ``SLACK`` nats a text are free, and a language with fewer than ``FEW`` such documents has no limit.
All documents of the fold count, their rates to 1 / ``RATES`` nat, so that a language's quantiles come from a short table.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything
if no labelled text exists; ties go to the first language by code point; repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import CHUNK_BYTES, chunks, fold, stored

LEAST = 24
CONTEXTS = 20_000
LANGUAGES = 64
CELLS = 64_000_000
MODULUS, TEST, PROBE = 4, 2, 1
OUTER, SPREAD, SLACK, FEW = 0.95, 8.0, 16.0, 15
RATES = 1 << 14
UNKNOWN = "und"
_UNIT = 1024
# A-Z count as a-z and digits as one: neither tells languages apart
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 0x20
_FOLDED[0x30:0x3A] = 0x30
_SPACE = 0x20


def _before(x: np.ndarray, offs: np.ndarray, back: int, fill: int) -> np.ndarray:
    """x shifted by ``back`` within each text; ``fill`` before a text's start."""
    out = np.empty_like(x)
    out[back:] = x[:-back] if back else x
    for k in range(back):
        at = offs[:-1] + k
        out[at[at < offs[1:]]] = fill
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, probe, gram, n): each byte with the three before it, packed into 32 bits."""
    for batch in batches:
        kinds = list(zip(batch.column("lang").to_pylist(), batch.column("probe").to_pylist(), strict=True))
        for a, b, data, offs in chunks(batch.column("text")):
            names = sorted(set(kinds[a:b]))
            at = {name: k for k, name in enumerate(names)}
            code = np.array([at[v] for v in kinds[a:b]], np.int64)
            langs, probes = pa.array([k for k, _ in names], pa.string()), pa.array([k for _, k in names], pa.bool_())
            # only a chunk of a single text is longer than a piece
            for start in range(0, len(data), CHUNK_BYTES):
                low = max(start - 3, 0)
                x = _FOLDED[data[low : start + CHUNK_BYTES]].astype(np.int64)
                own = offs if len(data) <= CHUNK_BYTES else np.array([0, len(x)])
                gram = (_before(x, own, 3, _SPACE) << 24) | (_before(x, own, 2, _SPACE) << 16) | (_before(x, own, 1, _SPACE) << 8) | x
                gram |= np.repeat(code << 32, np.diff(own))
                key, n = np.unique(gram[start - low :], return_counts=True)
                kind = pa.array(key >> 32)
                yield pa.RecordBatch.from_arrays([langs.take(kind), probes.take(kind), pa.array(key & 0xFFFFFFFF), pa.array(n)], ["lang", "probe", "gram", "n"])


class Model:
    """Cost tables of every language over one set of contexts."""

    def __init__(self, langs: list[str], lower: tuple[np.ndarray, ...], upper: tuple[np.ndarray, ...]):
        """lower, upper: language, packed bytes and count of all runs of three bytes, and of runs of four whose first three are a kept context."""
        self.langs = langs
        lang, gram, n = lower
        symbol = gram & 0xFF
        weight = np.bincount(symbol, n, 256)
        often = np.flatnonzero(weight > 0)
        self.classes = np.zeros(256, np.uint8)  # class 0: bytes not seen in training
        self.classes[often] = np.arange(1, len(often) + 1)
        self.classes[_FOLDED != np.arange(256)] = self.classes[_FOLDED[_FOLDED != np.arange(256)]]
        size = self.size = len(often) + 1
        c = self.classes.astype(np.int64)
        s2, s1, s0 = (c[(gram >> k) & 0xFF] for k in (16, 8, 0))
        lang3, gram3, n3 = upper
        t3, t2, t1, t0 = (c[(gram3 >> k) & 0xFF] for k in (24, 16, 8, 0))
        three = (t3 * size + t2) * size + t1
        kept = np.unique(three)
        self.third = np.full(size**3, -1, np.int32)
        self.third[kept] = size * size + np.arange(len(kept))
        rows = size * size + len(kept)
        cost = np.empty((rows, size, len(langs)), np.int16)
        spread = 256 - len(often)  # bytes that share class 0
        self.unseen = round(np.log(spread) * _UNIT)  # what tells one of them, so that groups compare
        for k in range(len(langs)):
            own = lang == k
            m, a, b, d = n[own], s2[own], s1[own], s0[own]
            base = np.full(size, 1.0 / 256)
            base[0] = spread / 256
            zero = self._mix(np.bincount(d, m, size)[None], base[None])
            one = self._mix(np.bincount(b * size + d, m, size**2).reshape(size, size), zero)
            two = self._mix(np.bincount((a * size + b) * size + d, m, size**3).reshape(size * size, size), np.tile(one, (size, 1)))
            deep = lang3 == k
            slot = self.third[three[deep]].astype(np.int64) - size * size
            counts = np.bincount(slot * size + t0[deep], n3[deep], len(kept) * size).reshape(-1, size)
            full = np.concatenate((two, self._mix(counts, two[kept % (size * size)])))
            cost[:, :, k] = np.round(-np.log(np.maximum(full, 1e-9)) * _UNIT)
        self.cost = cost.reshape(rows * size, len(langs))

    @staticmethod
    def _mix(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Predictions of each context from its counts and the shorter context's predictions."""
        seen = counts > 0
        n, q = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
        left = np.where(seen, 0.0, lower)
        rest = left.sum(1, keepdims=True)
        # a context that has seen every symbol has nothing to escape to
        escape = np.where(rest > 0, q, 0)
        mass = np.maximum(n + escape, 1e-12)
        out = counts / mass + np.where(rest > 0, left / np.maximum(rest, 1e-300), 0.0) * (escape / mass)
        return np.where(n > 0, out, lower)

    def lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in 1/1024 nat."""
        size, out = self.size, np.zeros((len(offs) - 1, len(self.langs)), np.int64)
        if not len(data):
            return out
        x = self.classes[data].astype(np.int32)
        fill = int(self.classes[_SPACE])
        p1, p2, p3 = (_before(x, offs, k, fill) for k in (1, 2, 3))
        two = p2 * size + p1
        three = self.third[p3 * (size * size) + two]
        row = np.where(three >= 0, three, two)
        row *= size
        row += x
        full = np.flatnonzero(offs[1:] > offs[:-1])
        for k in range(len(self.langs)):
            out[full, k] = np.add.reduceat(self.by_lang[k][row], offs[full], dtype=np.int64)
        out[full] += self.unseen * np.add.reduceat(x == 0, offs[full], dtype=np.int64)[:, None]
        return out

    def ready(self) -> Model:
        """Costs one language after another, for look-ups that stay in cache."""
        self.by_lang = [np.ascontiguousarray(self.cost[:, k]) for k in range(len(self.langs))]
        return self


def _groups(seen: dict[str, set[int]]) -> list[list[str]]:
    """Languages in groups of like bytes; each has ``LANGUAGES`` at most, and ``CELLS`` costs unless it is a single one."""
    out: list[list[str]] = []
    union: set[int] = set()
    for name in sorted(seen, key=lambda k: (sorted(seen[k], reverse=True), k)):
        size = len(union | seen[name]) + 1
        if not out or len(out[-1]) >= LANGUAGES or (size * size + CONTEXTS) * size * (len(out[-1]) + 1) > CELLS:
            out.append([])
            union = set()
        out[-1].append(name)
        union |= seen[name]
    return [sorted(x) for x in out]


class Grouped:
    """Models of several groups of languages, made one at a time."""

    def __init__(self, groups: list[list[str]], grams: DataFrame):
        self.groups, self.grams = groups, grams

    def __iter__(self) -> Iterator[Model]:
        return (_model(group, self.grams.filter(F.col("lang").isin(group))) for group in self.groups)


def _model(langs: list[str], grams: DataFrame) -> Model:
    code = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("short").alias("lang")
    own = grams.select(code, "gram", F.shiftright("gram", 8).alias("context"), "n")
    contexts = own.groupBy("context").agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST).orderBy(F.desc("total"), "context").limit(CONTEXTS)
    lower = own.groupBy("lang", F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n"))
    upper = own.join(F.broadcast(contexts.select("context")), "context").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = (x.select("lang", "gram", "n").toArrow() for x in (lower, upper))  # no more rows than the model has costs
    return Model(langs, *(tuple(x.column(k).to_numpy().astype(kind) for k, kind in (("lang", np.int64), ("gram", np.int64), ("n", float))) for x in found))


def counted(documents: DataFrame) -> DataFrame:
    """(lang, probe, gram, n), stored: the grams of ``text`` by ``lang`` outside the held-out fold; probe: those of fold ``PROBE``."""
    rows = _known(documents).select("lang", "text", (F.col("fold") == PROBE).alias("probe"))
    return stored(rows.mapInArrow(_counts, "lang string, probe boolean, gram long, n long").groupBy("lang", "probe", "gram").agg(F.sum("n").alias("n")), "grams")


def learned(grams: DataFrame) -> Model | Grouped | None:
    """A model from counted grams; None without any."""
    seen = {r["lang"]: set(r["bytes"]) for r in grams.groupBy("lang").agg(F.collect_set(F.col("gram").bitwiseAND(255)).alias("bytes")).collect()}
    if not seen:
        return None
    groups = _groups(seen)
    return _model(groups[0], grams) if len(groups) == 1 else Grouped(groups, grams)


def train(documents: DataFrame) -> Model | Grouped | None:
    """A model from ``text`` and ``lang`` of all documents outside the held-out fold; None without any labelled text."""
    return learned(counted(documents))


def _known(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), fold("doc_id", MODULUS).alias("fold")).filter(F.col("lang").isNotNull() & (F.col("fold") != TEST))


_STATE = ["__low", "__lang", "__sum"]


def _scorer(shared, names: list[str], first: bool):
    """Least code length (1/1024 nat), its language, and the sum of the languages' weights relative to it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if not hasattr(model, "by_lang"):
            model.ready()
        langs = np.array(model.langs, object)
        for batch in batches:
            n = batch.num_rows
            low, pred, total = np.zeros(n, np.int64), np.full(n, UNKNOWN, object), np.zeros(n)
            for a, b, data, offs in chunks(batch.column("text")):
                size = model.lengths(data, offs)
                low[a:b], pred[a:b] = size.min(1), langs[size.argmin(1)]
                total[a:b] = np.exp(-np.minimum((size - size.min(1, keepdims=True)) / _UNIT, 700)).sum(1)
            if not first:
                low0, pred0, total0 = (batch.column(k).to_numpy(zero_copy_only=False) for k in _STATE)
                least = np.minimum(low, low0)
                total = total * np.exp(-np.minimum((low - least) / _UNIT, 700)) + total0 * np.exp(-np.minimum((low0 - least) / _UNIT, 700))
                pred = np.where((low0 < low) | (low0 == low) & (pred0 < pred), pred0, pred)
                low = least
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(low), pa.array(pred, pa.string()), pa.array(total)], [*names, *_STATE])

    return score


def _scored(documents: DataFrame, model: Model | Grouped | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``documents`` with language, score, code length a byte and bytes."""
    extra = [] if "text" in keep else [F.col("text").cast("string").alias("text")]
    letter = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).alias("__bytes")
    rows = documents.select(*keep, *extra, letter, size)
    if model is None:
        return rows.select(*keep, F.lit(UNKNOWN).alias("__pred"), F.lit(0.0).alias("__score"), F.lit(None).cast("double").alias("__rate"), "__bytes")
    last = len(model.groups) - 1 if isinstance(model, Grouped) else 0
    for k, one in enumerate([model] if isinstance(model, Model) else model):
        names = [x for x in (rows.columns if k < last else [*keep, "__letter", "__bytes"]) if x not in _STATE]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
        rows = rows.mapInArrow(_scorer(documents.sparkSession.sparkContext.broadcast(one), names, k == 0), f"{schema}, __low long, __lang string, __sum double")
        if k < last:
            rows = stored(rows, "languages")
    told = lambda value, other: F.when(F.col("__letter"), value).otherwise(other)
    return rows.select(*keep, told(F.col("__lang"), F.lit(UNKNOWN)).alias("__pred"), told(1 / F.col("__sum"), F.lit(0.0)).alias("__score"), (F.col("__low") / _UNIT / F.greatest("__bytes", F.lit(1))).alias("__rate"), "__bytes")


def identify(documents: DataFrame, model: Model | Grouped | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``documents`` with lang_pred and score."""
    return _scored(documents, model, keep).select(*keep, F.col("__pred").alias("lang_pred"), F.col("__score").alias("score"))


def op6(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold("doc_id", MODULUS) == TEST).alias("held_out"))
    return identify(rows, train(documents), ["doc_id", "held_out"])


def limits(documents: DataFrame, grams: DataFrame) -> DataFrame:
    """(__pred, __most): the most nats a byte of each language with ``FEW`` documents of fold ``PROBE`` or more."""
    rows = _scored(_known(documents).filter(F.col("fold") == PROBE), learned(grams.filter(~F.col("probe"))), ["lang"]).filter(F.col("__pred") == F.col("lang"))
    rates = rows.groupBy("__pred", F.round(F.col("__rate") * RATES).alias("rate")).agg(F.count(F.lit(1)).alias("n"))
    rates = rates.groupBy("__pred").agg(F.sum("n").alias("of"), F.percentile("rate", F.array(F.lit(0.5), F.lit(OUTER)), F.col("n")).alias("at"))
    middle, outer = (F.get("at", F.lit(k)) / RATES for k in (0, 1))
    return rates.filter(F.col("of") >= FEW).select("__pred", (outer + SPREAD * (outer - middle)).alias("__most"))


def keep_identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """``documents`` whose language is told with a score of ``least`` or more, and whose code length is within its limit."""
    grams = counted(documents)
    found = _scored(documents, learned(grams), documents.columns).filter((F.col("__pred") != UNKNOWN) & (F.col("__score") >= least))
    known = found.join(F.broadcast(stored(limits(documents, grams), "limits")), "__pred", "left")
    fits = F.col("__most").isNull() | (F.col("__rate") * F.col("__bytes") <= F.col("__most") * F.col("__bytes") + SLACK)
    return known.filter(fits).select(documents.columns)
