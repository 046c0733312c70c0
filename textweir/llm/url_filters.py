"""Operator 3: URL allow and block rules by a sort-merge range join, in DataFrame functions alone.

A host's canonical key is its labels in reverse, each ended by U+0001, so a host
with all its subdomains is one interval of keys, and the intervals of rules nest
or are apart. The two ends of each rule host are boundaries; each carries the
stack of rules that are active from there on. Spark deals urls and boundaries out
by ranges of (key, salt), so a host that a third of all urls share spreads over
several ranges; every range begins with the stack of the last boundary before it.
One sorted sweep per range hands each url the last boundary's stack; of that
stack the longest rule whose path begins the url's path wins. Nothing of the
urls reaches the driver but Spark's own sample for the ranges.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule and the default verdict; host rules never fit an empty host; of rules of
equal length the longer host wins, then the smaller host and path; a rule given
twice counts once, as a block if the verdicts differ; an empty rule list gives
the default everywhere; repeated pages are judged one by one; null page ids are
kept; a url of any length is one row's work, its text never copied beyond host
and path; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, table

#: Ends a label; the next character ends the interval of all keys that go on from there.
END, PAST = "\u0001", "\u0002"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_u, instr(_u, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _ascii_lower(host), path


def _boundaries(rules: DataFrame) -> DataFrame:
    """key, stack: from each key on, the rules active, longest first. One join of the rule hosts with their own suffixes."""
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
    frames = rules.groupBy("host").agg(F.collect_list(F.struct((-F.length(F.concat("host", "path"))).alias("a"), (-F.length("host")).alias("b"), "host", "path", "verdict")).alias("frame"))
    labels = F.split("host", r"\.")
    above = frames.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up"))
    stacks = above.join(frames.select(F.col("host").alias("up"), "frame"), "up").groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("frame"))).alias("stack"))
    key = host_key(F.col("host"))
    stacks = stacks.withColumn("key", key)
    starts = stacks.select("key", "stack")
    ends = stacks.select(F.concat(F.expr("left(key, length(key) - 1)"), F.lit(PAST)).alias("key"), F.filter("stack", lambda r: r["host"] != F.col("host")).alias("stack"))
    return starts.unionByName(ends)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url); ``rules`` has verdict, host, path."""
    urls = pages.select("page_id", F.col("url").alias("_u"))
    host, path = split_url(F.col("_u"))
    urls = urls.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")).withColumn("key", host_key(F.col("host"))).withColumn("salt", F.xxhash64("page_id", "path"))

    low = F.lit(-(2**63)).cast("long")
    bounds = _boundaries(rules).withColumn("salt", low)
    kind = bounds.schema["stack"].dataType
    rows = urls.select("page_id", "host", "path", "key", "salt", F.lit(True).alias("is_url"), F.lit(None).cast(kind).alias("stack")).unionByName(bounds.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    # Written once, for a range is whatever Spark's own sample of the keys made of it.
    ranged = stage(rows.repartitionByRange("key", "salt").withColumn("part", F.spark_partition_id()), "ranges")
    # What is active where each range begins: the last boundary of the ranges before. One row a range goes through one task.
    tops = ranged.groupBy("part").agg(F.max_by("stack", F.when(~F.col("is_url"), F.col("key"))).alias("top"))
    opening = tops.select("part", F.last("top", True).over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("open"))

    last = F.last("stack", True).over(W.partitionBy("part").orderBy("key", "salt", "is_url").rowsBetween(W.unboundedPreceding, 0))
    swept = ranged.withColumn("last", last).where("is_url").join(F.broadcast(opening), "part")  # a row a range
    active = F.coalesce("last", "open")
    fits = F.filter(active, lambda r: F.startswith(F.col("path"), r["path"]) & ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))))
    best = F.get(fits, F.lit(0))
    return swept.withColumn("best", best).select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE_SQL = rf"""
WITH rules(verdict, rh, rp) AS (VALUES {_RULES_SQL}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
  (SELECT arg_max({{'rule': rh || rp, 'verdict': r.verdict}}, length(rh || rp)) FROM rules r
   WHERE starts_with(path, rp) AND (host = rh OR ends_with(host, '.' || rh))) AS best FROM parts) t
"""
