r"""URL filters by host-suffix and path-prefix expressions, in DataFrame functions only.

1. Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: from there up to ``?``, ``#`` or the end.
2. A rule is a host and the start of a path.  It is stored under its expression: the host and the path up to its last slash.
   A URL expands into its host's suffixes (at dots) times its path's prefixes (at slashes), as deep as any rule goes: if a
   rule fits, its expression is among them.
3. Expressions meet rules in an equi-join on the first four bytes of their SHA-256.  A hit is confirmed by the full digest, by the
   host and by what the rule's path has beyond its last slash.
4. Of the rules that fit, the longest text wins, then the longer host; a rule given with both verdicts blocks.  A URL without
   a rule is allowed.

Rules are broadcast while there are at most ``BROADCAST`` of them (they are counted first).  Beyond that both sides are shuffled by the
short hash and one of ``SALTS`` salts, so a host with a third of all URLs is spread; both ways give the same rows.  Only
expressions' hashes, the path and the row's id go through the join.

Defined cases: a null URL, and one without ``://``, has empty host and path; an empty host fits only a rule with an empty host; rules
with a null host or path are left out; an empty path fits only rules with an empty path; repeated rows are judged each; no
rules allow everything; other columns of the table may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import ROW_ID, with_row_id

#: Fixed values of the contract: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BROADCAST = 100_000
SALTS = 32


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def located(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _ruled(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, block, digest, short, labels, slashes): one row for each host and path."""
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").filter("rule_host is not null and rule_path is not null")
    known = known.groupBy("rule_host", "rule_path").agg(F.max(F.col("verdict") == "block").alias("block"))
    key = F.regexp_extract("rule_path", "^(?s:.*)/", 0)
    known = known.withColumn("digest", F.sha2(F.concat("rule_host", key), 256)).withColumn("short", _short(F.col("digest")))
    return known.withColumns({"labels": F.size(F.split("rule_host", "\\.")), "slashes": F.size(F.split(key, "/")) - 1})


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Digests of up to ``labels`` suffixes of the host times up to ``slashes`` + 1 prefixes of the path."""
    names = F.split(F.substring_index(host, ".", -labels), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, -k, k), "."))
    steps = F.split(path, "/", slashes + 1)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda j: F.when(j == 0, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, j), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, p), 256))))


def judged(pages: DataFrame, rules: DataFrame, own=()) -> DataFrame:
    """(row, columns ``own``, host, path, rule, verdict) of every row of ``pages``, a table read from files with a column ``url``."""
    host, path = located(F.col("url"))
    carried = F.struct(*own) if own else F.lit(None)
    urls = with_row_id(pages).select(ROW_ID, carried.alias("__own"), host.alias("host"), path.alias("path"))
    names = [ROW_ID, *(["__own.*"] if own else []), "host", "path"]
    ruled = _ruled(rules)
    n, labels, slashes = ruled.agg(F.count(F.lit(1)), F.max("labels"), F.max("slashes")).first()
    if not n:
        return urls.select(*names, F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    ruled = ruled.drop("labels", "slashes")
    tried = urls.select(ROW_ID, "host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, slashes)).alias("tried")).withColumn("short", _short(F.col("tried")))
    if n <= BROADCAST:
        met = tried.join(F.broadcast(ruled), "short")
    else:
        tried = tried.withColumn("salt", F.pmod(ROW_ID, F.lit(SALTS)))
        met = tried.join(ruled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["short", "salt"])
    met = met.filter((F.col("tried") == F.col("digest")) & F.col("path").startswith(F.col("rule_path")))
    met = met.filter((F.col("host") == F.col("rule_host")) | F.col("host").endswith(F.concat(F.lit("."), "rule_host")))
    text = F.concat("rule_host", "rule_path")
    best = met.groupBy(F.col(ROW_ID).alias("__met")).agg(F.max(F.struct(F.length(text).alias("long"), F.length("rule_host").alias("wide"), text.alias("rule"), "block")).alias("best"))
    out = urls.join(best, F.col(ROW_ID) == F.col("__met"), "left")
    return out.select(*names, F.col("best.rule").alias("rule"), F.when(F.col("best.block"), "block").otherwise("allow").alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``pages``, with its columns, that no rule blocks."""
    blocked = judged(pages, rules).filter("verdict = 'block'").select(F.col(ROW_ID).alias("__blocked"))
    return with_row_id(pages).join(blocked, F.col(ROW_ID) == F.col("__blocked"), "left_anti").select(*pages.columns)


def op13(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark), ["page_id"]).drop(ROW_ID)


OP13_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, row_number() OVER () AS nr FROM h),
r(rule_host, rule_path, said) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT p.*, r.rule_host || r.rule_path AS rule, r.said,
         row_number() OVER (PARTITION BY nr ORDER BY length(r.rule_host || r.rule_path) DESC, length(r.rule_host) DESC) AS place
  FROM p LEFT JOIN r ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND prefix(p.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(said, 'allow') AS verdict FROM f WHERE place = 1
"""
