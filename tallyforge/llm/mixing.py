r"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; a
source stops at twice its size and the excess goes to the others by weight.  That is a water level L with
target = min(cap, L * weight), found in closed form: a source is at its cap if the level at which it gets
there needs no more than the total.

Selection: within a source every document expects ``target / size`` copies.  Documents are ranked by size, so
the sample is stratified and a source's words stay near its target; the prefix sum of expected copies is
the rate times the rank.  With one offset a source, a document is emitted once for each integer that its
interval crosses, so never more than twice.  Ranks come from a total order of the narrow rows (source, size,
doc_id modulo ``TURNS``, doc_id, row) dealt into ranges, the row's place in its range, and a prefix sum over the ranges of
each source: a source with a third of all rows, or any number of equal rows, is spread over as many ranges as it fills.
Windows over all sources see a row a source: meant for up to some ten thousands of sources.

Defined cases: null and blank texts have size 0 and are never taken in words; a source of size 0 has target 0; a
null source is a source of its own; repeated rows and ids are separate documents, ranked by the row's place in the table;
null ids come last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import ROW_ID, stored, with_row_id

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
TURNS = 61


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size); one row a source."""
    total = Window.partitionBy()
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    s = by_source.withColumn("weight", weight.cast("long")).withColumn("cap", MOST * F.col("source_size"))
    s = s.withColumns({"level": F.col("cap") / F.col("weight"), "aim": SHARE * F.sum("source_size").over(total)})
    lower = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    need = F.sum("cap").over(lower) + F.col("level") * (F.sum("weight").over(total) - F.sum("weight").over(lower))
    s = s.withColumn("full", need <= F.col("aim"))
    rest = F.col("aim") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(total)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(total)
    s = s.withColumns({"rest": rest, "open_weight": open_weight})
    share = F.col("weight") * (F.col("rest") / F.col("open_weight"))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mixture(documents: DataFrame) -> DataFrame:
    """(row, doc_id, size, source_size, target, copies, taken) of every row of ``documents``."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    turn = F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(TURNS)), F.lit(0))
    sized = with_row_id(documents).select(ROW_ID, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), turn.alias("turn"))
    sized = stored(sized, "sizes")
    # ranges of one total order: no key, however frequent, is kept together
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("turn"), F.col("doc_id").asc_nulls_last(), F.col(ROW_ID)]
    placed = stored(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "places")
    # the id has the range above bit 33 and the row's place in it below
    part = F.shiftright("place", 33)
    ranges = placed.groupBy("source", part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    targets = source_targets(sized).withColumnRenamed("source", "s")
    ranges = ranges.join(targets, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("part").alias("p"), "first", "before", "source_size", "target")
    ranges = stored(ranges, "ranges")
    ranked = placed.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (part == F.col("p"))).withColumn("rank", F.col("before") + F.col("place") - F.col("first") + 1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    ranked = ranked.withColumns({"rate": rate, "offset": offset})
    copies = F.floor(F.col("offset") + F.col("rate") * F.col("rank")) - F.floor(F.col("offset") + F.col("rate") * (F.col("rank") - 1))
    return ranked.withColumn("copies", copies).select(ROW_ID, "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(ROW_ID, "copies")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(((doc_id % 61) + 61) % 61, 0) AS salt FROM documents),
s AS (
  SELECT source, source_size, [5, 2, 1][(((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
l AS (SELECT *, cap::DOUBLE / weight AS level, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS aim FROM s),
f AS (
  SELECT *, (sum(cap) OVER w)::DOUBLE + level * ((sum(weight) OVER ()) - (sum(weight) OVER w))::DOUBLE <= aim AS at_cap
  FROM l WINDOW w AS (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (
  SELECT source, source_size, CASE WHEN at_cap THEN cap::DOUBLE ELSE weight * ((aim - (sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER ())::DOUBLE) / (sum(CASE WHEN at_cap THEN 0 ELSE weight END) OVER ())::DOUBLE) END AS target
  FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.salt, d.doc_id ASC NULLS LAST) AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(u + rate * rank) - floor(u + rate * (rank - 1))) * size)::BIGINT AS taken FROM r
"""


def mixed(documents: DataFrame) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as it is drawn, numbered from 1 (words or not).

    The number's column is ``copy``, with underscores after it if ``documents`` has such a column itself.
    """
    name = "copy"
    while name.lower() in map(str.lower, documents.columns):
        name += "_"
    drawn = mixture(documents).filter("copies > 0").select(F.col(ROW_ID).alias("__drawn"), F.col("copies").cast("int").alias("__copies"))
    rows = with_row_id(documents).join(drawn.hint("shuffle_hash"), F.col(ROW_ID) == F.col("__drawn"))
    return rows.select(*documents.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias(name))
