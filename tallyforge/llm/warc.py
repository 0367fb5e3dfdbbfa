r"""WARC archives: written and read by Spark, records told apart by boundary chains.

Writing: a record ends with two line breaks, so Spark's own text writer with that line separator writes
valid gzip-compressed WARC files, with its commit protocol.  Equal payloads of ``REVISIT`` bytes or more are
stored once: digests are grouped with map-side combine in a narrow table, and the payload moves once.

Reading: Spark's text reader splits at the magic line, wherever it stands.  Tasks thus emit candidates:
offset, header and, by its Content-Length, the successor's offset.  A candidate inside a payload looks like a
record but no chain from the file's start leads to it.  Candidates whose successor is the next one
form runs; pointer jumping over runs (doubling each round, over narrow rows) keeps what is reachable.  A
record whose payload holds the magic is put together from its pieces.  Memory is bounded by a record.

Defined cases: a null html is an empty payload; a null page_id reads back as null and comes last among equal
payloads; of repeated rows one is the response, the others revisit it; empty tables give no rows; blanks, controls and line or
paragraph separators in a URL are percent-encoded in its header, so no URL can end its line or stand for another header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import ROW_ID, fresh_path, steady_splits, stored, with_row_id

REVISIT = 100
MAGIC = "WARC/1.1\r\n"
_BREAK = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_UNSAFE = r"[\x00-\x20\x7F-\x9F\u00A0\u2028\u2029]"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, *value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))


def _encoded(url: Column) -> Column:
    """``url`` with every blank, control and separator percent-encoded."""
    each = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(_UNSAFE), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
    return F.when(url.rlike(_UNSAFE), F.array_join(each, "")).otherwise(url)


def _field(block: str | Column, name: str, value: str = r"[^\r\n]*?") -> Column:
    """The first header line ``name`` of ``block``; only CR LF ends a line."""
    return F.regexp_extract(block, rf"(?i)(?:^|\r\n){name}:[ \t]*({value})[ \t]*(?=\r\n|\z)", 1)


def _id(page: str, row: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))


def revisits(rows: DataFrame) -> DataFrame:
    """(row, first_page, first_row) of rows (row, page_id, digest, size) whose payload an earlier row has."""
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col(ROW_ID).alias("row"))
    groups = rows.filter(F.col("size") >= REVISIT).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = rows.filter(F.col("size") >= REVISIT).join(groups, "digest").filter(F.col(ROW_ID) != F.col("first.row"))
    return found.select(ROW_ID, F.col("first.page").alias("first_page"), F.col("first.row").alias("first_row"))


def records(pages: DataFrame) -> DataFrame:
    """One column: each page's WARC record, without the two line breaks that end it."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = with_row_id(pages).select(ROW_ID, F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload")})
    again = revisits(stored(rows.select(ROW_ID, "page_id", "digest", "size"), "digests"))
    rows = rows.join(again.hint("shuffle_hash"), ROW_ID, "left")
    is_again = F.col("first_row").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_BREAK))
    block = F.when(is_again, http).otherwise(F.concat(http, F.col("payload")))
    refers = F.when(is_again, F.concat(_line("WARC-Profile", F.lit(_PROFILE)), _line("WARC-Refers-To", _id("first_page", "first_row")))).otherwise(F.lit(""))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(is_again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _id("page_id", ROW_ID)),
        _line("WARC-Date", F.lit(_DATE)),
        _line("WARC-Target-URI", _encoded(F.coalesce("url", F.lit("")))),
        _line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        refers,
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    records(pages).write.option("lineSep", _BREAK).option("compression", "gzip").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, at, value): what stands between magic lines, in the order of (part, at) in a file."""
    steady_splits(spark)
    meta = F.col("_metadata")
    return spark.read.option("lineSep", MAGIC).text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("part"), F.monotonically_increasing_id().alias("at"), "value")


def _parsed(value: str = "value") -> dict[str, Column]:
    """Header fields and payload of a candidate, as far as its piece goes."""
    head = F.substring_index(value, _BREAK, 1)
    return {
        "head": head,
        "block_bytes": F.octet_length(value) - F.octet_length("head") - len(_BREAK),
        "length": F.expr("try_cast(nullif(length_text, '') as bigint)"),
        "length_text": _field("head", "Content-Length", "[0-9]+"),
        "kind": _field("head", "WARC-Type"),
        "id": _field("head", "WARC-Record-ID"),
        "refers": _field("head", "WARC-Refers-To"),
        "said": F.regexp_extract(_field("head", "WARC-Payload-Digest"), r"\Asha256:([0-9a-f]+)\z", 1),
    }


def _with_payload(df: DataFrame, value: str) -> DataFrame:
    """payload_bytes and payload_digest of records whose whole text is in ``value``."""
    block = F.substring(F.col(value), F.length("head") + len(_BREAK) + 1, F.lit(2**31 - 1))
    http = F.substring_index("block", _BREAK, 1)
    payload = F.substring(F.col("block"), F.length("http") + len(_BREAK) + 1, F.length("block") - F.length("http") - 2 * len(_BREAK))
    df = df.withColumn("block", block).withColumn("http", http).withColumn("said_bytes", _field("http", "Content-Length", "[0-9]+"))
    full = F.expr("try_cast(nullif(said_bytes, '') as bigint)")
    is_again = F.col("kind") == "revisit"
    return df.withColumns(
        {
            "payload_bytes": F.when(is_again, full).otherwise(F.col("length") - F.octet_length("http") - len(_BREAK)),
            "payload_digest": F.when(is_again, F.col("said")).otherwise(F.sha2(payload.cast("binary"), 256)),
        }
    ).drop("block", "http", "said_bytes")


def _reachable(candidates: DataFrame) -> DataFrame:
    """``candidates`` (file, offset, next, successor) that a chain from offset 0 leads to."""
    by_file = Window.partitionBy("file").orderBy("offset")
    # a run goes on while each successor is the next candidate
    breaks = F.coalesce(F.lag(F.col("successor") != F.col("next")).over(by_file), F.lit(False)) | F.coalesce(F.lag(F.col("successor").isNull()).over(by_file), F.lit(False))
    candidates = stored(candidates.withColumn("run", F.sum(breaks.cast("long")).over(by_file)), "runs")
    ends = candidates.groupBy("file", "run").agg(F.max_by("successor", "offset").alias("successor"))
    landing = candidates.select("file", F.col("offset").alias("successor"), F.col("run").alias("to"), F.col("offset").alias("lands"))
    jumps = stored(ends.join(landing, ["file", "successor"]).select("file", "run", "to", "lands"), "jumps")
    first = candidates.filter("offset = 0").select("file", "run").distinct()
    if not jumps.limit(1).count():
        return candidates.join(first, ["file", "run"], "left_semi")
    reached, hop = stored(first, "reached"), jumps.select("file", "run", "to")
    size = reached.count()
    while True:
        step = reached.join(hop, ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = stored(reached.union(step).distinct(), "reached")
        hop = stored(hop.join(hop.select("file", F.col("run").alias("to"), F.col("to").alias("far")), ["file", "to"]).select("file", "run", F.col("far").alias("to")), "hops")
        grown = reached.count()
        # runs only go forward, so pointers run out; no new run means the chain has ended
        if grown == size:
            break
        size = grown
    entry = jumps.join(reached, ["file", "run"], "left_semi").groupBy("file", F.col("to").alias("run")).agg(F.min("lands").alias("entry"))
    entry = reached.join(entry, ["file", "run"], "left").select("file", "run", F.coalesce("entry", F.lit(0)).alias("entry"))
    return candidates.join(entry, ["file", "run"]).filter("offset >= entry").drop("entry")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the files of ``path``."""
    pieces = _pieces(spark, path)
    parse = _parsed()
    found = pieces.withColumn("head", parse["head"])
    found = found.withColumns({k: parse[k] for k in ("block_bytes", "length_text", "kind", "id", "refers", "said")}).withColumn("length", parse["length"])
    # whole: the piece ends where the record does
    found = found.withColumn("whole", F.col("block_bytes") == F.col("length") + len(_BREAK))
    found = _with_payload(found, "value").withColumn("bytes", F.octet_length("value").cast("long")).withColumn("head_bytes", F.octet_length("head"))
    narrow = ["file", "part", "at", "bytes", "head_bytes", "length", "kind", "id", "refers", "said", "whole", "payload_bytes", "payload_digest"]
    found = stored(found.select(narrow), "candidates")
    before = Window.partitionBy("file").orderBy("part", "at")
    # the first piece of a file stands before its first magic
    place = F.sum(F.col("bytes") + len(MAGIC)).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes") - 2 * len(MAGIC)
    found = found.withColumn("offset", place).filter("offset >= 0").withColumn("next", F.lead("offset").over(before))
    found = found.withColumn("successor", F.col("offset") + len(MAGIC) + F.col("head_bytes") + len(_BREAK) + F.col("length") + len(_BREAK))
    found = stored(found, "offsets")
    kept = stored(_reachable(found).select("file", "offset", "successor", "part", "at", *narrow[5:]), "reachable")
    whole = kept.filter("whole").select("kind", "id", "refers", "payload_bytes", "payload_digest")
    broken = kept.filter("not whole")
    if broken.limit(1).count():
        whole = whole.union(_joined(pieces, found, broken))
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]*):', 1), '') as bigint)")
    return whole.select(page("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page("refers").alias("refers_to"))


def _joined(pieces: DataFrame, found: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines, from all their pieces."""
    spans = broken.select("file", F.col("offset").alias("start"), F.col("successor").alias("stop"))
    # the record that a piece belongs to: the last that began at or before it in its file
    starts = found.select("file", "part", "at", "offset").join(spans.withColumn("offset", F.col("start")), ["file", "offset"], "left")
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = starts.withColumns({"start": F.last("start", True).over(upto), "stop": F.last("stop", True).over(upto)}).filter(F.col("offset") < F.col("stop"))
    text = pieces.join(own.select("file", "part", "at", "start", "offset").hint("shuffle_hash"), ["file", "part", "at"])
    text = text.groupBy("file", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    heads = broken.select("file", F.col("offset").alias("start"), "kind", "id", "refers", "said", "length")
    text = text.join(heads, ["file", "start"]).withColumn("head", F.substring_index("value", _BREAK, 1))
    return _with_payload(text, "value").select("kind", "id", "refers", "payload_bytes", "payload_digest")


def op10(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path)
