"""Derived views over the supplied tables, once for Spark and once as SQL text for the oracle engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


class Source:
    """The tables of one data set and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def segments(self) -> DataFrame:
        return self.table("documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("seq", "text")).withColumn("seq", F.col("seq").cast("long"))

    def cache(self) -> DataFrame:
        texts = self.segments().where(F.length("text") % 3 == 0).select("text", "lang").distinct()
        return texts.select(T.cache_key(F.col("text"), F.lit("English"), F.col("lang"), F.lit("m")).alias("key_hash"), "text", "lang", F.when(F.length("text") % 21 == 0, "").otherwise(F.concat(F.lit("<"), "text", F.lit(">"))).alias("translation"))

    def tmap(self) -> DataFrame:
        failed = (F.col("doc_id") + F.col("seq")) % 17 == 0
        value = F.when(failed, F.concat(F.lit("[Translation failed|Vietnamese] "), "text")).otherwise(F.concat(F.lit("<"), "text", F.lit(">")))
        return self.segments().select("doc_id", "seq", F.lit("Vietnamese").alias("target"), "text", value.alias("value"))

    def _terms(self) -> DataFrame:
        p = self.table("part")
        pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(by) % 4 + 1).cast("int"))
        return p.select(
            F.col("p_partkey").cast("long").alias("id"),
            F.col("p_name").alias("source_text"),
            F.lower("p_type").alias("target_text"),
            F.lit("English").alias("source_lang"),
            F.col("p_brand").alias("target_lang"),
            pick(["general", "technical", "finance", "legal"], "p_size").alias("domain"),
            ((F.col("p_partkey") % 101) / 100.0).alias("confidence"),
            F.col("p_size").cast("long").alias("usage_count"),
            pick(["approved", "unverified", "needs_review", "rejected"], "p_partkey").alias("status"),
        )

    def all_terms(self) -> DataFrame:
        return self._terms()

    def terms(self) -> DataFrame:
        """One row per (source_text, target_lang, domain), that of the least id."""
        t = self._terms()
        keys = t.groupBy("source_text", "target_lang", "domain").agg(F.min("id").alias("id"))
        return t.join(keys.select("id"), "id", "left_semi")

    def terms_import(self) -> DataFrame:
        t = self._terms().where(F.col("id") % 2 == 1)
        keys = t.groupBy("source_text", "target_lang", "domain").agg(F.min("id").alias("id"))
        t = t.join(keys.select("id"), "id", "left_semi").withColumn("target_text", F.concat("target_text", F.lit("2"))).withColumn("confidence", ((F.col("id") * 7) % 101) / 100.0)
        new = t.groupBy("source_text", "domain").agg(F.min("id").alias("id")).select("id")
        return t.unionByName(t.join(new, "id", "left_semi").withColumn("target_lang", F.lit("New#1")))

    def cells(self) -> DataFrame:
        from pyspark.sql import Window as W

        o = self.table("orders").join(self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
        o = o.withColumn("row", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
        cols = F.array(
            F.col("o_orderstatus"),
            F.col("o_orderpriority"),
            F.floor("o_totalprice").cast("string"),
            F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")),
        )
        return o.select(F.col("o_custkey").alias("table_id"), F.col("row").cast("long").alias("row"), F.posexplode(cols).alias("col", "content")).withColumn("col", F.col("col").cast("long"))

    def boxes(self) -> DataFrame:
        k = F.col("o_orderkey").cast("long")
        x0, y0 = (k * 37) % 500, (k * 61) % 700
        return self.table("orders").select(
            k.alias("element_id"),
            F.col("o_custkey").cast("long").alias("doc_id"),
            (k % 3 + 1).alias("page"),
            x0.cast("double").alias("x0"),
            y0.cast("double").alias("y0"),
            (x0 + 20 + (k * 13) % 150).cast("double").alias("x1"),
            (y0 + 8 + (k * 7) % 40).cast("double").alias("y1"),
            (k % 11 == 0).alias("truncated"),
            (k % 13 != 0).alias("should_translate"),
        )

    def spans(self) -> DataFrame:
        """A customer's orders as the text spans of a document, two a line."""
        from pyspark.sql import Window as W

        k = F.col("o_orderkey").cast("long")
        o = self.table("orders").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
        n = F.col("n")
        line = F.floor((n - 1) / 2).cast("long")
        x0, y0 = (k % 400).cast("double"), ((k * 7 + n * 31) % 780).cast("double")
        return o.select(
            F.col("o_custkey").cast("long").alias("doc_id"),
            (F.floor((n - 1) / 6) + 1).cast("long").alias("page"),
            (F.col("o_custkey") % 2 * line).cast("long").alias("block"),
            line.alias("line"),
            ((n - 1) % 2).alias("span"),
            k.alias("span_id"),
            F.when(n % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("text"),
            F.col("o_orderstatus").alias("font"),
            (n + 6).cast("double").alias("size"),
            (k % 32).alias("flags"),
            (k * 997 % 16_777_216).alias("color"),
            x0.alias("x0"),
            y0.alias("y0"),
            (x0 + 30 + n).alias("x1"),
            (y0 + 10).alias("y1"),
        )

    def rendered(self) -> DataFrame:
        k = F.col("element_id")
        return self.boxes().withColumns({"x0": F.col("x0") + k % 5, "x1": F.col("x1") + k % 5, "y0": F.col("y0") + k % 7, "y1": F.col("y1") + k % 7})

    def regions(self) -> DataFrame:
        bands = self.spark.createDataFrame([(0, 0.0, 200.0, "header", 0.3), (1, 200.0, 400.0, "text", 0.5), (2, 400.0, 700.0, "table", 0.9)], "region long, ry0 double, ry1 double, label string, confidence double")
        return self.boxes().select("doc_id", "page").distinct().crossJoin(F.broadcast(bands))  # three fixed rows


DUCK = {
    "segments_v": r"""SELECT doc_id, lang, CAST(i - 1 AS BIGINT) AS seq, parts[i] AS text
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents) d, LATERAL unnest(range(1, len(parts) + 1)) AS u(i)""",
    "cache_v": r"""SELECT sha256(concat_ws(chr(0), regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), 'english', lower(lang), 'm')) AS key_hash, text, lang,
  CASE WHEN length(text) % 21 = 0 THEN '' ELSE concat('<', text, '>') END AS translation FROM (SELECT DISTINCT text, lang FROM segments_v WHERE length(text) % 3 = 0) c""",
    "tmap_v": r"""SELECT doc_id, seq, 'Vietnamese' AS target, text,
  CASE WHEN (doc_id + seq) % 17 = 0 THEN concat('[Translation failed|Vietnamese] ', text) ELSE concat('<', text, '>') END AS value FROM segments_v""",
    "terms0_v": r"""SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS source_text, lower(p_type) AS target_text, 'English' AS source_lang, p_brand AS target_lang,
  ['general','technical','finance','legal'][p_size % 4 + 1] AS domain, (p_partkey % 101) / 100.0::DOUBLE AS confidence, CAST(p_size AS BIGINT) AS usage_count,
  ['approved','unverified','needs_review','rejected'][p_partkey % 4 + 1] AS status FROM part""",
    "terms_v": r"""SELECT * FROM terms0_v QUALIFY row_number() OVER (PARTITION BY source_text, target_lang, domain ORDER BY id) = 1""",
    "terms_import_v": r"""SELECT * FROM (WITH t AS (SELECT id, source_text, target_text || '2' AS target_text, source_lang, target_lang, domain, ((id * 7) % 101) / 100.0::DOUBLE AS confidence, usage_count, status
  FROM terms0_v WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY source_text, target_lang, domain ORDER BY id) = 1)
  SELECT * FROM t UNION ALL SELECT * REPLACE ('New#1' AS target_lang) FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source_text, domain ORDER BY id) = 1) n) i""",
    "cells_v": r"""SELECT o_custkey AS table_id, rn AS row, CAST(i - 1 AS BIGINT) AS col, c[i] AS content FROM (
  SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS rn,
  [o_orderstatus, o_orderpriority, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE c_mktsegment END] AS c
  FROM orders JOIN customer ON o_custkey = c_custkey) o, LATERAL unnest(range(1, 5)) AS u(i)""",
    "boxes_v": r"""SELECT CAST(o_orderkey AS BIGINT) AS element_id, CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey % 3 + 1 AS BIGINT) AS page,
  CAST((o_orderkey * 37) % 500 AS DOUBLE) AS x0, CAST((o_orderkey * 61) % 700 AS DOUBLE) AS y0,
  CAST((o_orderkey * 37) % 500 + 20 + (o_orderkey * 13) % 150 AS DOUBLE) AS x1, CAST((o_orderkey * 61) % 700 + 8 + (o_orderkey * 7) % 40 AS DOUBLE) AS y1,
  o_orderkey % 11 = 0 AS truncated, o_orderkey % 13 <> 0 AS should_translate FROM orders""",
    "spans_v": r"""SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST((n - 1) // 6 + 1 AS BIGINT) AS page, CAST(o_custkey % 2 * ((n - 1) // 2) AS BIGINT) AS block,
  CAST((n - 1) // 2 AS BIGINT) AS line, CAST((n - 1) % 2 AS BIGINT) AS span, CAST(k AS BIGINT) AS span_id, CASE WHEN n % 5 = 0 THEN '  ' ELSE concat(' ', o_orderpriority) END AS text, o_orderstatus AS font,
  CAST(n + 6 AS DOUBLE) AS size, CAST(k % 32 AS BIGINT) AS flags, k * 997 % 16777216 AS color, CAST(k % 400 AS DOUBLE) AS x0, CAST((k * 7 + n * 31) % 780 AS DOUBLE) AS y0,
  CAST(k % 400 + 30 + n AS DOUBLE) AS x1, CAST((k * 7 + n * 31) % 780 + 10 AS DOUBLE) AS y1 FROM (SELECT *, CAST(o_orderkey AS BIGINT) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) o""",
    "rendered_v": r"""SELECT element_id, doc_id, page, x0 + element_id % 5 AS x0, y0 + element_id % 7 AS y0, x1 + element_id % 5 AS x1, y1 + element_id % 7 AS y1, truncated, should_translate FROM boxes_v""",
    "regions_v": r"""SELECT * FROM (SELECT DISTINCT doc_id, page FROM boxes_v) p, (VALUES (0, 0.0, 200.0, 'header', 0.3), (1, 200.0, 400.0, 'text', 0.5), (2, 400.0, 700.0, 'table', 0.9)) AS b(region, ry0, ry1, label, confidence)""",
}
_NEEDS = {"cache_v": ["segments_v"], "tmap_v": ["segments_v"], "terms_v": ["terms0_v"], "terms_import_v": ["terms0_v"], "rendered_v": ["boxes_v"], "regions_v": ["boxes_v"]}


def with_views(sql: str, *views: str) -> str:
    """``sql`` with the views it needs in front."""
    order: list[str] = []
    for v in views:
        for n in (*_NEEDS.get(v, []), v):
            if n not in order:
                order.append(n)
    head = "WITH RECURSIVE " + ", ".join(f"{v} AS ({DUCK[v]})" for v in order)
    sql = sql.strip()
    return f"{head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"{head} {sql}"
