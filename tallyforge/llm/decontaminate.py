r"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

1. Items become windows of ``WINDOW`` words (a shorter item is one window) and shingles of three words
   (fewer in items that have fewer); a shingle is its 64-bit hash.
2. One pass over the whole documents keeps the places whose shingle is any item's.  A text goes on to exact
   checks only where a long enough run of such places exists (positional bound).
3. Shingles are ordered by their count in all documents.  A window can only occur where its rarest
   shingle does, so only that one is joined; windows that share it at one place of an item are one row.
4. The alignments of a text, bounded by its length, are gathered by row, and meet the text once to be compared word for word.

The item vocabulary goes into the pass as a literal set while it has at most ``LITERALS`` shingles (its
size is counted first); beyond that the places are exploded and joined, in as many tasks as needed.  Both ways give the
same hits and no case is dropped by either: the literal set only saves a shuffle of all places.

Defined cases: null and word-less texts and items have no words or windows; items with the same id are
one item; a null item_id counts as the empty text; repeated rows get the same figures each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import ROW_ID, stored, with_row_id

WINDOW = 13
SHINGLE = 3
LITERALS = 50_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _fold(text: Column) -> Column:
    """Folds more than A-Z, alike wherever a word stands (both small sigmas are one); step 4 is exact."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _split_words(text: Column) -> Column:
    """Words with at most an empty one before and after."""
    return F.split(_fold(text), _GAP, -1)


def _exact(words: Column) -> Column:
    return F.transform(words, lambda x: F.translate(x, _UPPER, _LOWER))


def _n_words(words: Column) -> Column:
    edge = (F.get(words, F.lit(0)) == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    return F.size(words) - edge


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(words, at + k) for k in range(size)))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, k, size, width, exact, h, at): each window's shingles; ``at`` counts words within the item."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text.alias("t")).distinct()
    items = items.select("item", F.filter(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), lambda x: x != "").alias("raw")).filter(F.size("raw") > 0)
    items = items.select("item", _exact(F.col("raw")).alias("exact"), F.transform("raw", _fold).alias("folded"))
    items = items.withColumns({"width": F.least(F.size("exact"), F.lit(WINDOW)), "size": F.least(F.size("exact"), F.lit(SHINGLE))})
    windows = items.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("exact") - F.col("width"))))
    windows = windows.withColumn("at", F.explode(F.sequence(F.col("k"), F.col("k") + F.col("width") - F.col("size"))))
    h = F.lit(None).cast("long")
    for size in range(1, SHINGLE + 1):
        h = F.when(F.col("size") == size, _shingle(F.col("folded"), F.col("at"), size)).otherwise(h)
    return windows.select("item", "k", "size", "width", "exact", h.alias("h"), "at")


def _hits(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``rows`` with ``hits``: (pos, h, size) of each place whose shingle some item has."""
    sizes = sorted(r["size"] for r in vocabulary.select("size").distinct().collect())
    if vocabulary.count() <= LITERALS:
        known: dict[int, list[str]] = {s: [] for s in sizes}
        for r in vocabulary.collect():
            known[r["size"]].append(f"{r['h']}L" if r["h"] > -(2**63) else "cast('-9223372036854775808' as bigint)")
        found = []
        for s in sizes:
            args = ", ".join(f"get(w, i + {k})" for k in range(s))
            places = f"filter(sequence(0, size(w) - 1), i -> xxhash64({args}) IN ({', '.join(known[s])}))"
            found.append(f"transform({places}, i -> named_struct('pos', i, 'h', xxhash64({args}), 'size', {s}))")
        none = "cast(array() as array<struct<pos:int,h:bigint,size:int>>)"
        return rows.withColumn("hits", F.expr(f"concat({', '.join([none, *found])})"))

    def places(s: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("pos"), _shingle(F.col("w"), i, s).alias("h"), F.lit(s).alias("size")))

    every = rows.select(ROW_ID, F.explode(F.concat(*map(places, sizes))).alias("p")).select(ROW_ID, "p.*")
    hits = every.join(vocabulary, ["h", "size"], "left_semi").groupBy(ROW_ID).agg(F.sort_array(F.collect_list(F.struct("pos", "h", "size"))).alias("hits"))
    return rows.join(hits, ROW_ID, "left").withColumn("hits", F.coalesce("hits", F.expr("cast(array() as array<struct<pos:int,h:bigint,size:int>>)")))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items, contaminated) of every row of ``documents``."""
    windows = stored(item_windows(benchmark), "windows")
    vocabulary = windows.select("h", "size").distinct()
    # the shortest run of shingles that a window of full shingles has
    run = windows.filter(F.col("size") == SHINGLE).agg(F.min(F.col("width") - SHINGLE + 1)).first()[0] or 1
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = with_row_id(documents).select(ROW_ID, F.col("doc_id").cast("long").alias("doc_id"), _split_words(text).alias("w"))
    rows = _hits(rows.withColumn("n_words", _n_words(F.col("w"))), vocabulary)
    full = F.expr(f"transform(filter(hits, x -> x.size = {SHINGLE}), x -> x.pos)")
    running = F.expr(f"size(hits) > size(places) or (size(places) >= {run} and exists(sequence(0, greatest(size(places) - {run}, 0)), i -> get(places, i + {run - 1}) - get(places, i) = {run - 1}))")
    rows = rows.withColumn("places", full)
    found = stored(rows.select(ROW_ID, "doc_id", "n_words", "hits", running.alias("candidate")), "hits")
    counts = found.select(F.explode("hits").alias("x")).groupBy("x.h").agg(F.count(F.lit(1)).alias("n"))
    rarity = windows.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rarity.groupBy("item", "k", "size", "width", "exact").agg(F.min(F.struct("n", "h", "at")).alias("least")).filter("least.n > 0")
    # windows of an item that share their shingle at one place are one row, and so are items with the same words there
    near = rarest.groupBy("item", "width", "exact", F.col("least.h").alias("h"), F.col("least.at").alias("at")).agg(F.min("k").alias("low"), F.max("k").alias("high"), F.array_sort(F.collect_list("k")).alias("ks"))
    words = F.expr("slice(exact, low + 1, high + width - low)")
    near = near.select("item", "width", "h", (F.col("at") - F.col("low")).alias("at"), F.transform("ks", lambda k: k - F.col("low")).alias("ks"), words.alias("words"))
    prefix = with_row_id(stored(near.groupBy("width", "h", "at", "ks", "words").agg(F.collect_set("item").alias("of")), "prefix")).withColumnRenamed(ROW_ID, "part")
    # alignments are narrow; they meet the text once, by row
    joined = found.filter("candidate").select(ROW_ID, F.explode("hits").alias("x")).select(ROW_ID, "x.h", "x.pos").join(prefix.drop("of"), "h")
    aligned = joined.groupBy(ROW_ID).agg(F.collect_list(F.struct("part", (F.col("pos") - F.col("at")).alias("shift"), "width", "ks", "words")).alias("aligned"))
    picked = with_row_id(documents).select(ROW_ID, text.alias("t")).join(aligned.hint("shuffle_hash"), ROW_ID)
    picked = picked.withColumn("w", F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1))
    fits = "k + a.shift >= 0 and k + a.shift + a.width <= size(w)"
    same = f"transform(slice(w, k + a.shift + 1, a.width), x -> translate(x, '{_UPPER}', '{_LOWER}')) = slice(a.words, k + 1, a.width)"
    verified = F.expr(f"filter(transform(aligned, a -> named_struct('part', a.part, 'width', a.width, 'starts', transform(filter(a.ks, k -> case when {fits} then {same} else false end), k -> k + a.shift))), a -> size(a.starts) > 0)")
    covered = F.expr("size(array_distinct(flatten(transform(verified, a -> flatten(transform(a.starts, s -> sequence(s, s + a.width - 1)))))))")
    occurs = picked.select(ROW_ID, verified.alias("verified")).filter(F.size("verified") > 0)
    occurs = stored(occurs.select(ROW_ID, covered.cast("long").alias("n_hit"), F.array_distinct("verified.part").alias("parts")), "occurs")
    items = occurs.select(ROW_ID, F.explode("parts").alias("part")).join(prefix.select("part", "of"), "part").groupBy(ROW_ID).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("of")))).alias("items"))
    by_row = occurs.select(ROW_ID, "n_hit").join(items, ROW_ID)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.join(by_row, ROW_ID, "left").select(
        ROW_ID, "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(documents, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item, len(x) AS width, array_to_string(x, ' ') AS key
  FROM (SELECT item, w[k:k + least(len(w), 13) - 1] AS x FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM b WHERE len(w) > 0))),
widths AS (SELECT DISTINCT width FROM win),
place AS (
  SELECT r, p, width, array_to_string(w[p:p + width - 1], ' ') AS key
  FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM d, widths WHERE len(w) >= width)),
occ AS (SELECT place.r, place.p, win.item, win.width FROM place JOIN win ON place.key = win.key AND place.width = win.width),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + width)) AS q FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows that :func:`contamination` calls contaminated."""
    bad = contamination(documents, benchmark).filter("contaminated").select(ROW_ID)
    return with_row_id(documents).join(bad.hint("shuffle_hash"), ROW_ID, "left_anti").select(documents.columns)
