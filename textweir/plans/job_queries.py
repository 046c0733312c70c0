"""Queries on jobs: slots, aligned scores, totals, modes, clean-up, samples, reports, and flows around the model seams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fitting
from ..operators import cache, compose, jobs, quality, terms, translate
from ..sources.seams import Tagging
from ..sources.views import Source
from .registry import query


@query("WITH q AS (SELECT n_nationkey AS pos, CASE n_nationkey % 3 WHEN 0 THEN r_name WHEN 1 THEN concat('m', n_regionkey) ELSE n_name END AS name, n_nationkey % 3 AS k, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT pos, CASE k WHEN 0 THEN concat('m', n_regionkey) ELSE name END AS model, CASE k WHEN 2 THEN 'unknown' ELSE r_name END AS provider FROM q WHERE NOT (k = 0 AND n_regionkey = 4)")
def route_slots(src: Source) -> DataFrame:
    r = src.table("region")
    model = F.concat(F.lit("m"), F.col("r_regionkey").cast("string"))
    known = r.select(F.col("r_name").alias("provider"), F.col("r_regionkey").alias("pos"), F.when(F.col("r_regionkey") == 4, F.create_map(F.lit("judge"), model)).otherwise(F.create_map(F.lit("translate"), model)).alias("models"))
    n = src.table("nation").join(r.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    name = F.when(F.col("n_nationkey") % 3 == 0, F.col("r_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("m"), F.col("n_regionkey").cast("string"))).otherwise(F.col("n_name"))
    return jobs.resolve_slots(n.select(F.col("n_nationkey").alias("pos"), name.alias("name")), known)


@query("SELECT CAST(doc_id AS BIGINT) AS block_id, k, CASE k WHEN 0 THEN quality ELSE toxic END * 1.0::DOUBLE AS score FROM labels, (VALUES (0), (1)) AS v(k)")
def score_alignment(src: Source) -> DataFrame:
    """Two scores a block in a row, found again by place."""
    blocks = src.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    blocks = blocks.withColumn("idx", F.col("doc_id").cast("long"))
    scores = blocks.select(F.explode(F.array(F.struct((F.col("idx") * 2).alias("idx"), F.col("quality").cast("double").alias("score")), F.struct((F.col("idx") * 2 + 1).alias("idx"), F.col("toxic").cast("double").alias("score")))).alias("s")).select("s.*")
    return jobs.align_scores(blocks.select(F.col("doc_id").cast("long").alias("block_id"), "idx"), scores, 2)


@query("SELECT o_custkey AS job_id, CAST(sum(o_orderkey % 7) AS BIGINT) AS extracted, CAST(sum(o_orderkey % 3) AS BIGINT) AS skipped, CAST(sum(o_orderkey % 5) AS BIGINT) AS added FROM orders GROUP BY o_custkey")
def term_totals(src: Source) -> DataFrame:
    k = F.col("o_orderkey")
    return jobs.term_totals(src.table("orders").select(F.col("o_custkey").alias("job_id"), (k % 7).alias("extracted"), (k % 3).alias("skipped"), (k % 5).alias("added")))


@query("SELECT source_text, target_text, min(id) AS pos FROM terms0_v GROUP BY ALL", "terms0_v")
def term_unique_pairs(src: Source) -> DataFrame:
    return jobs.unique_terms(src.all_terms().withColumnRenamed("id", "pos"))


_MODES = ["append", "bilingual", "adjacent", "annotation", "replace"]
_EXTS = [".docx", ".xlsx", ".pptx", ".pdf"]
_MODE_SQL = f"SELECT CAST(p_partkey AS BIGINT) AS p_partkey, {_MODES}[p_partkey % 5 + 1] AS m, {_EXTS}[p_size % 4 + 1] AS e, p_size % 3 + 1 AS n FROM part"


@query(
    f"""SELECT p_partkey, CASE WHEN bad OR (m = 'replace' AND n > 1) THEN 'append' ELSE m END AS used, CASE WHEN bad THEN concat(CASE WHEN m = 'bilingual' THEN m ELSE concat('''', m, '''') END, ' output_mode is not supported for ''', e, ''' files; falling back to append')
      WHEN m = 'replace' AND n > 1 THEN 'replace output_mode takes one target; falling back to append' END AS warning
    FROM (SELECT *, (m = 'bilingual' AND e NOT IN ('.docx', '.doc')) OR (m IN ('adjacent', 'annotation') AND e NOT IN ('.xlsx', '.xls')) AS bad FROM ({_MODE_SQL}) a) b"""
)
def output_mode_warning(src: Source) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    used, warning = jobs.output_mode(pick(_MODES, F.col("p_partkey") % 5), pick(_EXTS, F.col("p_size") % 4), F.col("p_size") % 3 + 1)
    return src.table("part").select(F.col("p_partkey").cast("long").alias("p_partkey"), used.alias("used"), warning.alias("warning"))


@query("SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN '' ELSE string_agg(lower(substr(n_name, 1, 2)), '_' ORDER BY n_nationkey) END AS tag FROM nation GROUP BY n_regionkey")
def output_tag(src: Source) -> DataFrame:
    t = src.table("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("t"))
    return t.select("n_regionkey", jobs.output_tag(F.transform("t", lambda x: x["n_name"]), F.when(F.col("n_regionkey") % 2 == 0, 1).otherwise(2)).alias("tag"))


@query("SELECT DISTINCT c_custkey AS job_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_folders(src: Source) -> DataFrame:
    return jobs.orphans(src.table("customer").select(F.col("c_custkey").alias("job_id")).distinct(), src.table("orders").select(F.col("o_custkey").alias("job_id")))


@query("SELECT id, 'unverified' AS status FROM terms_v", "terms_v")
def term_migration(src: Source) -> DataFrame:
    return jobs.with_status(src.terms().drop("status")).select("id", "status")


@query("SELECT source_text, target_text, target_lang, domain, CASE WHEN id % 2 = 0 THEN concat('wikidata:Q', id) ELSE '' END AS context_snippet, 0.9::DOUBLE AS confidence, 'unverified' AS status, coalesce(CASE WHEN id % 3 = 0 THEN concat('a', id) END, CASE WHEN id % 3 = 1 THEN concat('b', id) END, concat('c', id)) AS label FROM terms_v", "terms_v")
def term_lookup_import(src: Source) -> DataFrame:
    t = src.terms()
    i = F.col("id").cast("string")
    labels = F.create_map(F.lit("zh-tw"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("a"), i)), F.lit("zh"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("b"), i)).otherwise(""), F.lit("en"), F.concat(F.lit("c"), i))
    t = t.withColumn("entity_id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Q"), i))).withColumn("label", jobs.label_of(labels, ["zh-tw", "zh", "en"]))
    rows = jobs.imported(t.withColumn("source_text", F.struct("source_text", "label")))
    return rows.select("source_text.source_text", "target_text", "target_lang", "domain", "context_snippet", "confidence", "status", F.col("source_text.label").alias("label"))


@query("SELECT job_id, provider FROM (SELECT o_orderkey AS job_id, ['a', 'Own', 'own', 'b'][o_orderkey % 4 + 1] AS provider FROM orders) j WHERE lower(provider) <> 'own'")
def judged_jobs(src: Source) -> DataFrame:
    j = src.table("orders").select(F.col("o_orderkey").alias("job_id"), F.element_at(F.array(*[F.lit(x) for x in ("a", "Own", "own", "b")]), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("provider"))
    return jobs.judged(j, ["OWN"])


@query()
def benchmark_sample(src: Source) -> DataFrame:
    """Fifty of each role's turns, by a seeded hash; held against the rule in the tests."""
    c = src.table("conversations").select(F.col("role").alias("pair"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("source"), F.col("text").alias("reference"))
    return jobs.benchmark_sample(c, 50, 7).select("pair", "pos", "id", "source")


@query("""WITH v AS (SELECT * FROM (SELECT o_custkey AS job_id, concat('f', o_orderkey % 2) AS file_name, o_orderkey AS page, 'old' AS view FROM orders) o WHERE NOT (file_name = 'f0' AND job_id % 2 = 0) UNION ALL SELECT o_custkey, 'f0', o_orderkey + 1, 'new' FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 2 = 0)
SELECT job_id, concat('{"files":{', string_agg(concat('"', file_name, '":{"file_name":"', file_name, '","total_pages":', n, ',"pages":[', p, ']}'), ',' ORDER BY file_name), '}}') AS view_json FROM (SELECT job_id, file_name, count(*) AS n, string_agg(concat('"', view, '"'), ',' ORDER BY page) AS p FROM v GROUP BY ALL) f GROUP BY job_id""")  # fmt: skip
def layout_views(src: Source) -> DataFrame:
    o = src.table("orders")
    old = o.select(F.col("o_custkey").alias("job_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 2).cast("string")).alias("file_name"), F.col("o_orderkey").alias("page"), F.lit("old").alias("view"))
    new = o.where("o_orderkey % 2 = 0 and o_custkey % 2 = 0").select(F.col("o_custkey").alias("job_id"), F.lit("f0").alias("file_name"), (F.col("o_orderkey") + 1).alias("page"), F.lit("new").alias("view"))
    return jobs.view_json(jobs.merged_views(old, new))


@query("WITH m AS (SELECT 'o_orderstatus' AS factor, o_orderstatus AS level, avg(o_totalprice) AS m FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, avg(o_totalprice) FROM orders GROUP BY 2) SELECT a.factor, a.level AS low, b.level AS high, round(b.m - a.m, 4) AS delta FROM m a JOIN m b ON a.factor = b.factor AND a.level < b.level")
def factor_deltas(src: Source) -> DataFrame:
    return jobs.all_deltas(src.table("orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("delta", F.round("delta", 4))


@query("SELECT round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS base, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'), 4) AS added, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS delta FROM orders")
def incremental_effect(src: Source) -> DataFrame:
    got = jobs.incremental(src.table("orders"), {"o_orderstatus": "F"}, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, "o_totalprice")
    return got.select(*[F.round(c, 4).alias(c) for c in got.columns])


_FACE = "SELECT p_name AS face, p_partkey AS pos, p_size * 1.0::DOUBLE AS x_height, p_retailprice AS cap_height, p_partkey % 17 * 1.0::DOUBLE AS advance FROM part"


@query(f"WITH f AS ({_FACE} WHERE p_partkey <= 20), w AS (SELECT n_name AS wanted, n_nationkey * 2.0::DOUBLE AS x, n_nationkey * 40.0::DOUBLE + 900 AS c, n_regionkey * 3.0::DOUBLE AS a FROM nation) SELECT wanted, face FROM (SELECT wanted, face, row_number() OVER (PARTITION BY wanted ORDER BY 3 * abs(x_height - x) + 2 * abs(cap_height - c) + abs(advance - a), pos) AS r FROM w, f) t WHERE r = 1")
def fallback_font(src: Source) -> DataFrame:
    faces = src.table("part").where("p_partkey <= 20").select(F.col("p_name").alias("face"), F.col("p_partkey").alias("pos"), F.col("p_size").cast("double").alias("x_height"), F.col("p_retailprice").cast("double").alias("cap_height"), (F.col("p_partkey") % 17).cast("double").alias("advance"))
    wanted = src.table("nation").select(F.col("n_name").alias("face"), (F.col("n_nationkey") * 2.0).alias("x_height"), (F.col("n_nationkey") * 40.0 + 900).alias("cap_height"), (F.col("n_regionkey") * 3.0).alias("advance"))
    return jobs.metric_fallback(faces, wanted)


@query("SELECT DISTINCT conv_id, turn FROM conversations WHERE NOT (turn % 2 = 0)")
def missing_ids(src: Source) -> DataFrame:
    c = src.table("conversations")
    return jobs.missing_ids(c, c.where("turn % 2 = 0"), ["conv_id", "turn"])


_MARKED = "concat('[', '{t}', '] ', text)"


@query(
    """WITH r AS (SELECT n_name AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'm1' ELSE 'm2' END AS model FROM nation WHERE n_nationkey < 4), s AS (SELECT DISTINCT text FROM conversations WHERE regexp_matches(regexp_replace(text, '[^\\p{L}]', '', 'g'), '.{3}'))
    SELECT text, target, concat('[', target, '] ', text) AS value, model FROM s, r""".replace("\\\\", "\\")
)
def routed_run(src: Source) -> DataFrame:
    """Targets that go to two models, one run each."""
    segs = src.table("conversations").select("text")
    n = src.table("nation").where("n_nationkey < 4")
    routes = n.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("target"), F.when(F.col("n_nationkey") % 2 == 0, "m1").otherwise("m2").alias("model"), F.lit("p").alias("provider"))
    none = src.spark.createDataFrame([], "key_hash string, translation string")
    return compose.run_routed(segs, routes, none, lambda model, provider: Tagging(), F.lit("auto")).select("text", "target", "value", "model")


@query("SELECT conv_id AS job, round(avg(length(text) / (length(text) + 2)::DOUBLE), 6) AS mean_score, count(*) AS blocks, 'available' AS qe_status FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def review_scores(src: Source) -> DataFrame:
    """Quality of blocks whose translations are two characters longer, and the audit of an empty glossary."""
    c = src.table("conversations").where("text is not null")
    blocks = c.select(F.col("conv_id").alias("job"), (F.col("conv_id") * 1000 + F.col("turn")).alias("block_id"), F.col("text").alias("source"), F.concat("text", F.lit("!!")).alias("translation"))
    from ..sources.seams import LengthScorer

    none = src.spark.createDataFrame([], "source_text string, target_text string, status string")
    return compose.review(blocks, none, LengthScorer()).select("job", F.round("mean_score", 6).alias("mean_score"), "blocks", "qe_status")


@query("SELECT o_custkey AS call_id, trim(string_agg(concat(o_orderpriority, ' '), '' ORDER BY o_orderkey) FILTER (WHERE o_orderkey <= coalesce(e, o_orderkey))) AS text, any_value(e) IS NOT NULL AS done FROM (SELECT *, min(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS e FROM orders) o GROUP BY o_custkey")
def token_streams(src: Source) -> DataFrame:
    from ..streaming.progress import replies

    return replies(src.table("orders").select(F.col("o_custkey").alias("call_id"), F.col("o_orderkey").alias("seq"), F.concat("o_orderpriority", F.lit(" ")).alias("token"), (F.col("o_orderkey") % 5 == 0).alias("done")))


@query("SELECT table_id, row, col, content, CASE WHEN content = '' THEN content WHEN regexp_matches(content, '^[0-9., /%-]+$') AND regexp_matches(content, '[0-9]') THEN content WHEN content = 'F' THEN concat('[Translation failed|Thai] ', content) ELSE concat('[Thai] ', content) END AS translated, CASE WHEN content = '' THEN 'skipped' WHEN regexp_matches(content, '^[0-9., /%-]+$') AND regexp_matches(content, '[0-9]') THEN 'passthrough' WHEN content = 'F' THEN 'failed' ELSE 'translated' END AS status FROM cells_v", "cells_v")
def translated_cells(src: Source) -> DataFrame:
    out = translate.translate_cells(src.cells(), "Thai", _FailsOn("F"))
    return out.select("table_id", "row", "col", "content", "translated", "status")


class _FailsOn(Tagging):
    """Fails for one exact text."""

    def translate_once(self, text: str, target: str, context: str = "") -> str | None:
        return None if text == self.fails_on else f"[{target}] {text}"


@query("SELECT CAST(o_orderkey AS BIGINT) AS job_id, concat(['technical_process', 'general', 'legal_contract'][o_orderkey % 3 + 1], CASE WHEN o_orderkey % 2 = 0 THEN '_ctx' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN '_glossary' ELSE '' END, CASE WHEN o_custkey % 3 = 0 THEN '_gabc' ELSE '' END, '_crit', ':c') AS variant FROM orders")
def cache_variant(src: Source) -> DataFrame:
    o = src.table("orders")
    name = F.element_at(F.array(*[F.lit(x) for x in ("technical_process", "general", "legal_contract")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    made = quality.cache_variant(name, F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 2 == 0, F.when(F.col("o_custkey") % 3 == 0, "abc").otherwise(""))
    return o.select(F.col("o_orderkey").cast("long").alias("job_id"), cache.critique_key(made).alias("variant"))


@query("SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN 'technical_process' WHEN 1 THEN 'business_finance' WHEN 2 THEN 'legal_contract' END AS scenario, CASE n_nationkey % 3 WHEN 0 THEN 'legal_contract' WHEN 1 THEN 'business_finance' ELSE n_name END AS canonical FROM nation")
def scenario_profiles(src: Source) -> DataFrame:
    k = F.col("n_nationkey")
    profile = F.element_at(F.array(*[F.lit(x) for x in (" Semiconductor", "FINANCIAL", "government ", "nobody")]), (k % 4 + 1).cast("int"))
    name = F.when(k % 3 == 0, "international_standard").when(k % 3 == 1, "business_email").otherwise(F.col("n_name"))
    return src.table("nation").select("n_name", quality.profile_scenario(profile).alias("scenario"), quality.canonical_scenario(name).alias("canonical"))


@query("SELECT id, replace(source_text, ' ', '_') AS source_text, row_number() OVER (PARTITION BY target_lang ORDER BY id) AS line, left(target_lang, 31) AS sheet FROM terms_v", "terms_v")
def term_sheets(src: Source) -> DataFrame:
    return terms.sheets(src.terms().withColumn("source_text", F.replace(F.col("source_text"), F.lit(" "), F.lit("_")))).select("id", "source_text", "line", "sheet")


_WORTH = "regexp_matches(regexp_replace(text, '[^\\p{L}]', '', 'g'), '.{3}')"


def _marks(src: Source) -> DataFrame:
    return src.spark.createDataFrame([("Thai",), ("German",)], "target string")  # two fixed rows


@query(f"SELECT text, target, CASE WHEN contains(text, 'the ') THEN concat('[Translation failed|', target, '] ', text) ELSE concat('[', target, '] ', text) END AS value, false AS cached FROM (SELECT DISTINCT text FROM conversations WHERE {_WORTH}) s, (VALUES ('Thai'), ('German')) AS t(target)")
def translated_texts(src: Source) -> DataFrame:
    """Distinct texts in two languages; those with a certain word fail."""
    none = src.spark.createDataFrame([], "key_hash string, translation string")
    said, _ = translate.translate_texts(src.table("conversations").select("text"), _marks(src), none, Tagging("the "), F.lit("auto"), "m")
    return said


@query(f"SELECT text, 'Thai' AS target, CASE WHEN contains(text, 'the ') AND contains(text, 'and ') THEN concat('[Translation failed|Thai] ', text) ELSE concat('[Thai] ', text) END AS value, contains(text, 'the ') AND NOT contains(text, 'and ') AS filled FROM (SELECT DISTINCT text FROM conversations WHERE {_WORTH}) s")
def filled_failures(src: Source) -> DataFrame:
    """A first model fails for one word, the one that fills in for another."""
    none = src.spark.createDataFrame([], "key_hash string, translation string")
    said, _ = translate.translate_texts(src.table("conversations").select("text"), _marks(src).where("target = 'Thai'"), none, Tagging("the "), F.lit("auto"), "m")
    return translate.verify_and_fill(said.drop("cached"), Tagging("and "), 1)


@query("SELECT conv_id * 1000 + turn AS block_id, text, concat('[Thai] ', substr(text, 1, 12)) AS value FROM conversations WHERE text IS NOT NULL AND length(text) >= 40")
def critiqued_drafts(src: Source) -> DataFrame:
    """Short drafts that a revision would double: it is no better by length once it is over the source's."""
    c = src.table("conversations").where("text is not null and length(text) >= 40")
    drafts = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("block_id"), "text", F.lit("Thai").alias("target"), F.substring("text", 1, 12).alias("value"))
    return translate.critique(drafts, Tagging(), _Nearer(), 1).select("block_id", "text", "value")


class _Nearer:
    """Scores a translation by its length alone."""

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        return [float(len(b)) for _, b in pairs]


@query("SELECT doc_id AS id, CASE WHEN short THEN again ELSE value END AS value FROM (SELECT *, length(n) >= 15 AND e > 0 AND length(value) < 0.3 * e AND length(again) > length(value) AS short FROM (SELECT doc_id, substr(text, 1, 20) AS value, lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))) AS n, length(regexp_replace(lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))), '[^\\p{L}]', '', 'g')) * 0.75::DOUBLE AS e, array_to_string(list_transform(string_split(text, chr(10)), lambda x: concat('[Vietnamese] ', x)), chr(10)) AS again FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]')) a) b")
def recovered_truncations(src: Source) -> DataFrame:
    """Replies of twenty characters, which are too short for most documents, asked for again line by line."""
    d = src.table("documents").where("text is not null").where(~F.col("text").rlike(r"[\x{4E00}-\x{9FFF}]"))
    rows = d.select(F.col("doc_id").alias("id"), "text", F.lit("Vietnamese").alias("target"), F.substring("text", 1, 20).alias("value"))
    return translate.recover_truncated(rows, Tagging()).select("id", "value")


@query("SELECT count(*) AS n FROM conversations")
def size_guard(src: Source) -> DataFrame:
    return translate.guard_size(src.table("conversations").select("text"), 10**12, 10**15).agg(F.count("*").alias("n"))


@query("WITH RECURSIVE e AS (SELECT o_custkey AS job_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT job_id, CAST(sum(CASE WHEN i % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS files, CAST(sum(CASE WHEN i % 4 IN (2, 3) THEN 1 ELSE 0 END) AS BIGINT) AS segments_done FROM e GROUP BY job_id")
def progress_fold(src: Source) -> DataFrame:
    """Log lines of files with two segments each, folded to the counters of each job; the last file may be open."""
    from pyspark.sql import Window as W

    from ..operators.folds import fold_sorted
    from ..streaming.progress import fold_progress

    i = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = src.table("orders").select(F.col("o_custkey").alias("job_id"), i.cast("long").alias("seq"))
    number = F.floor((F.col("seq") - 1) / 4).cast("long") + 1
    kind = (F.col("seq") - 1) % 4
    line = F.when(kind == 0, F.concat(F.lit("Processing: f.docx ("), number.cast("string"), F.lit("/99)"))).when(kind < 3, F.concat(F.lit("[TR] "), kind.cast("string"), F.lit("/2 text"))).otherwise("Done: f.docx -> out")
    lines = o.withColumn("message", line)
    states = fold_sorted(lines, "job_id", "seq", ["message"], lambda: (0, 0, 0, 0, 0), fold_progress, "files long, base long, segments_done long")
    return states.groupBy("job_id").agg(F.max_by("files", "seq").alias("files"), F.max_by("segments_done", "seq").alias("segments_done"))


@query()
def fitted_text(src: Source) -> DataFrame:
    """Part names fitted into boxes of their own sizes by the cascade; held against its rules in the tests."""
    p = src.table("part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_name").alias("text"), (F.col("p_size") * 4.0).alias("wide"), (F.col("p_size") * 1.0).alias("tall"), F.lit(12.0).alias("size"), F.lit(5.0).alias("below"))
    return p.select("p_partkey", fitting.fit_cascade("text", "wide", "tall", "size", "below").alias("f")).select("p_partkey", "f.*")
