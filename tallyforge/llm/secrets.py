r"""Secret scan with character Markov models, in DataFrame functions only.

Base rules find keyword assignments, access keys and long hexadecimal strings by regular expressions.  The
method adds tokens that no rule names: two first-order character models, of random strings and of ordinary
identifiers, are compared by log-likelihood ratio, and a token of ``SHORTEST`` characters or more whose
ratio is at least ``RATIO`` and ``RATIO_PER_CHAR`` a character is a ``markov`` span, unless a base span overlaps it.

Training: all documents.  Random: values of base spans and ``SYNTHETIC`` encoded digests, which count once for every
``DIGESTS_FOR`` documents.  Ordinary: the words that are too short to be judged, alone and joined to identifiers.  Equal words
are summed first, then character pairs of distinct words, at most 66 * 65 rows, so they fit a literal.

A text is scanned whole, in one pass without a shuffle.  Match positions come from the lengths of what
regular-expression splitting leaves between matches, summed in blocks so that a text with very many matches
stays far from quadratic cost.

Defined cases: null and empty texts have no spans; overlapping matches of different kinds all count;
repeated rows get the same result; positions count code points.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base rules' patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

SHORTEST = 20
RATIO = 15.0
RATIO_PER_CHAR = 0.5
DIGESTS_FOR = 2000
SYNTHETIC = 4000
_TOKEN = r"[A-Za-z0-9+/_=-]"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_BLOCK = 256


def _spans(df: DataFrame, name: str, pattern: str, kind: int, minimum_group: int | None = None) -> DataFrame:
    """Adds ``name``: array of (start, kind, stop, value) of each match; value is the last group or the match."""
    quoted = "r'" + pattern.replace("'", r"\x27") + "'"
    found = f"{name}_m"
    df = df.withColumn(found, F.expr(f"if(t rlike {quoted}, regexp_extract_all(t, {quoted}, 0), cast(array() as array<string>))"))
    df = df.withColumn(f"{name}_v", F.expr(f"if(size({found}) > 0, regexp_extract_all(t, {quoted}, 2), {found})") if minimum_group else F.col(found))
    df = df.withColumn(f"{name}_g", F.expr(f"if(size({found}) > 0, transform(split(t, {quoted}, -1), (x, i) -> length(x) + if(i > 0, length(get({found}, i - 1)), 0)), cast(array() as array<int>))"))
    blocks = f"transform(sequence(0, (size({name}_g) - 1) div {_BLOCK}), b -> aggregate(slice({name}_g, int(b * {_BLOCK} + 1), {_BLOCK}), 0, (a, x) -> a + x))"
    df = df.withColumn(f"{name}_b", F.expr(f"if(size({found}) > 0, {blocks}, cast(array() as array<int>))"))
    df = df.withColumn(f"{name}_b", F.expr(f"if(size({found}) > 0, transform(sequence(0, size({name}_b) - 1), b -> aggregate(slice({name}_b, 1, b), 0, (a, x) -> a + x)), {name}_b)"))
    start = f"get({name}_b, int(i div {_BLOCK})) + aggregate(slice({name}_g, int(i - i % {_BLOCK} + 1), int(i % {_BLOCK} + 1)), 0, (a, x) -> a + x)"
    spans = f"transform({found}, (x, i) -> named_struct('start', {start}, 'kind', {kind}, 'stop', length(x), 'value', get({name}_v, i)))"
    spans = f"transform({spans}, s -> named_struct('start', s.start, 'kind', s.kind, 'stop', s.start + s.stop, 'value', s.value))"
    if minimum_group:
        spans = f"filter({spans}, s -> length(s.value) >= {minimum_group})"
    return df.withColumn(name, F.expr(spans)).drop(found, f"{name}_v", f"{name}_g", f"{name}_b")


def _with_base(texts: DataFrame) -> DataFrame:
    """``texts`` (column t) with the spans of each base kind."""
    df = _spans(texts, "assign", ASSIGN, 0, minimum_group=6)
    df = _spans(df, "access", ACCESS, 1)
    return _spans(df, "hex", HEX, 2)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")


#: How often a kind of token counts: its first character, and the pairs after it.
_WEIGHTS = {"secret": (1, 1), "digest": (1, 1), "word": (1, 2), "first": (2, 2), "joint": (0, 1)}


def labelled_tokens(documents: DataFrame) -> DataFrame:
    """(kind, token, n) of all documents, and the encoded digests.

    A document's words stand alone and, as people write identifiers, joined by a sign.  So each word counts twice, without a
    start of its own in the identifier unless it is the ``first``; a ``joint`` is the sign with the characters beside it.
    """
    spark = documents.sparkSession
    based = _with_base(documents.select(_text()))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.filter(F.regexp_extract_all(rest, F.lit(_TOKEN + "{2,}"), F.lit(0)), lambda x: F.length(x) < SHORTEST)
    based = based.withColumn("w", words).withColumn("sign", F.substring(F.lit("_-/"), F.pmod(F.length("t"), F.lit(3)) + 1, F.lit(1)))
    known = "transform(concat(assign, access, hex), s -> named_struct('kind', 'secret', 'token', s.value))"
    plain = "transform(w, (x, i) -> named_struct('kind', if(i = 0, 'first', 'word'), 'token', x))"
    joint = "transform(slice(w, 2, size(w)), (x, i) -> named_struct('kind', 'joint', 'token', concat(right(get(w, i), 1), sign, left(x, 1))))"
    found = based.select(F.explode(F.expr(f"concat({known}, {plain}, {joint})")).alias("k")).groupBy("k.kind", "k.token").agg(F.count(F.lit(1)).alias("n"))
    digest = F.sha2(F.concat(F.lit("secret:"), F.col("id").cast("string")).cast("binary"), 512)
    forms = F.array(F.base64(F.unhex(digest)), F.substring(digest, 1, 64), F.upper(F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", "XYZ"), 1, 40)), F.translate(F.base64(F.unhex(digest)), "+/", "-_"))
    times = max(1, round(documents.count() / DIGESTS_FOR))
    made = spark.range(SYNTHETIC // 4, numPartitions=1).select(F.lit("digest").alias("kind"), F.explode(forms).alias("token"), F.lit(times).cast("long").alias("n"))
    return found.union(made)


def train(documents: DataFrame) -> list[float]:
    """128 * 128 log-likelihood ratios of a character after another (NUL: the token's start)."""
    tokens = labelled_tokens(documents).filter(F.col("token").rlike(f"^{_TOKEN}+$"))
    start, after = (F.create_map(*(F.lit(x) for kind, at in _WEIGHTS.items() for x in (kind, at[k])))[F.col("kind")] * F.col("n") for k in (0, 1))
    # characters by one pass of a pattern: positions in a long text cost its length each
    pairs = tokens.select(F.col("kind").isin("secret", "digest").alias("random"), start.alias("start"), after.alias("after"), F.regexp_extract_all("token", F.lit("."), F.lit(0)).alias("c"))
    pairs = pairs.select("random", "start", "after", F.explode(F.expr("zip_with(concat(array(''), slice(c, 1, size(c) - 1)), c, (x, y) -> named_struct('a', ascii(x), 'b', ascii(y)))")).alias("p"))
    n = F.sum(F.when(F.col("p.a") == 0, F.col("start")).otherwise(F.col("after")))
    counts = pairs.groupBy("random", "p.a", "p.b").agg(n.alias("n")).filter("n > 0").collect()  # at most 2 * 66 * 65 rows
    size = len(_ALPHABET)
    ratio = [0.0] * (128 * 128)
    seen: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for r in counts:
        seen[r["random"]][r["a"], r["b"]] = r["n"]
    single = {k: {ord(c): sum(n for (_, b), n in v.items() if b == ord(c)) for c in _ALPHABET} for k, v in seen.items()}
    for a in [0, *map(ord, _ALPHABET)]:
        total = {k: sum(v.get((a, ord(c)), 0) for c in _ALPHABET) for k, v in seen.items()}
        for c in map(ord, _ALPHABET):
            log = {}
            for k, v in seen.items():
                every = sum(single[k].values())
                back = (single[k][c] + 1) / (every + size)  # interpolated with the order-0 model
                log[k] = math.log((v.get((a, c), 0) + 8 * back) / (total[k] + 8))
            ratio[a * 128 + c] = round(log[True] - log[False], 4)
    return ratio


def scan(documents: DataFrame, ratio: list[float]) -> DataFrame:
    """``documents`` with ``assign``, ``access``, ``hex``, ``markov`` and ``spans`` (all, in order); own columns of these names are replaced."""
    # own columns travel in a struct, so that no working column can clash with one
    df = _with_base(documents.select(F.struct("*").alias("__own"), _text()))
    df = _spans(df, "tokens", _TOKEN + "{" + str(SHORTEST) + ",}", 3)
    base = "concat(assign, access, hex)"
    score = "aggregate(regexp_extract_all(s.value, '.', 0), named_struct('p', 0, 's', 0D), (a, c) -> named_struct('p', ascii(c), 's', a.s + get(llr, a.p * 128 + ascii(c))), a -> a.s)"
    df = df.withColumn("llr", F.from_json(F.lit(json.dumps(ratio)), "array<double>"))
    df = df.withColumn("markov", F.expr(f"filter(tokens, s -> not exists({base}, b -> b.start < s.stop and s.start < b.stop) and {score} >= greatest({RATIO}, {RATIO_PER_CHAR} * length(s.value)))"))
    df = df.withColumn("spans", F.array_sort(F.concat("assign", "access", "hex", "markov")))
    found = [*KINDS, "spans"]
    return df.select(*(F.col("__own").getField(c).alias(c) for c in documents.columns if c.lower() not in found), *found)


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.stop)), ',')")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(documents.select("doc_id", "text"), train(documents))
    base = _joined("array_sort(concat(assign, access, hex))")
    count = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *count, F.sha2(base, 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span replaced by ``mark`` (overlapping spans by one) and n_chars counted anew."""
    found = scan(documents.select(F.struct("*").alias("__row"), "text"), train(documents))
    # spans in order; one that begins inside an earlier one extends it
    merge = (
        "aggregate(spans, cast(array() as array<struct<a:int,b:int>>), (m, s) -> if(size(m) > 0 and s.start < element_at(m, -1).b, "
        "concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, s.stop)))), "
        "concat(m, array(named_struct('a', s.start, 'b', s.stop)))))"
    )
    found = found.withColumn("cut", F.expr(merge))
    pieces = "transform(sequence(0, size(cut)), i -> substring(text, if(i = 0, 1, get(cut, i - 1).b + 1), if(i = size(cut), 2147483647, get(cut, i).a) - if(i = 0, 0, get(cut, i - 1).b)))"
    found = found.withColumn("clean", F.when(F.size("cut") > 0, F.array_join(F.expr(pieces), mark)).otherwise(F.col("text")))
    out = {"text": F.col("clean")}
    if "n_chars" in documents.columns:
        out["n_chars"] = F.when(F.size("cut") > 0, F.length("clean").cast("long")).otherwise(F.col("__row.n_chars"))
    return found.select(*(out.get(c, F.col("__row").getField(c)).alias(c) for c in documents.columns))
