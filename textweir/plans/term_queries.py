"""Queries on the terminology base and glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import glossary as G
from ..operators import segments as S
from ..operators import terms as O
from ..operators.folds import running
from ..sources.views import Source
from .registry import query

_COLS = "source_text, target_text, source_lang, target_lang, domain, confidence, usage_count, status"


@query("""SELECT 'target_lang' AS kind, target_lang AS value, count(*) AS n, count(*) FILTER (WHERE status = 'unverified') AS unverified FROM terms_v GROUP BY target_lang
UNION ALL SELECT 'domain', domain, count(*), count(*) FILTER (WHERE status = 'unverified') FROM terms_v GROUP BY domain
UNION ALL SELECT 'status', status, count(*), count(*) FILTER (WHERE status = 'unverified') FROM terms_v GROUP BY status
UNION ALL SELECT 'total', '', count(*), count(*) FILTER (WHERE status = 'unverified') FROM terms_v""", "terms_v")  # fmt: skip
def term_stats_grouping_sets(src: Source) -> DataFrame:
    return O.statistics(src.terms())


@query("SELECT id, source_text, usage_count FROM terms_v ORDER BY usage_count DESC, id LIMIT 30", "terms_v")
def term_top_by_usage(src: Source) -> DataFrame:
    return src.terms().select("id", "source_text", "usage_count").orderBy(F.desc("usage_count"), "id").limit(30)


@query("SELECT id, source_text, target_text, status, row_number() OVER (ORDER BY id DESC) AS position FROM terms_v WHERE status = 'unverified' AND domain = 'technical'", "terms_v")
def term_listing(src: Source) -> DataFrame:
    kept = src.terms().where("status = 'unverified' and domain = 'technical'")
    return running(kept, [F.desc("id")], F.lit(1)).select("id", "source_text", "target_text", "status", "position")


def _upsert_sql(strategy: str) -> str:
    free = "true" if strategy == "force" else "o.status NOT IN ('approved', 'rejected')"
    replaces = {"skip": "false", "overwrite": "true", "force": "true", "merge": "n.confidence > o.confidence"}[strategy]
    usage = "CASE WHEN a = 'inserted' THEN nu WHEN a = 'overwritten' THEN " + ("ou" if strategy == "merge" else "nu") + " ELSE ou END"
    return f"""WITH j AS (SELECT coalesce(o.source_text, n.source_text) AS source_text, coalesce(o.target_lang, n.target_lang) AS target_lang, coalesce(o.domain, n.domain) AS domain,
      CASE WHEN n.id IS NULL THEN NULL WHEN o.id IS NULL THEN 'inserted' WHEN {free} AND {replaces} THEN 'overwritten' ELSE 'skipped' END AS a,
      o.target_text AS ot, n.target_text AS nt, o.source_lang AS os, n.source_lang AS ns, o.confidence AS oc, n.confidence AS nc, o.usage_count AS ou, n.usage_count AS nu, o.status AS ost, n.status AS nst
      FROM terms_v o FULL JOIN terms_import_v n ON o.source_text = n.source_text AND o.target_lang = n.target_lang AND o.domain = n.domain)
    SELECT source_text, target_lang, domain, CASE WHEN a IN ('inserted', 'overwritten') THEN nt ELSE ot END AS target_text, CASE WHEN a IN ('inserted', 'overwritten') THEN ns ELSE os END AS source_lang,
      CASE WHEN a IN ('inserted', 'overwritten') THEN nc ELSE oc END AS confidence, {usage} AS usage_count, CASE WHEN a IN ('inserted', 'overwritten') THEN nst ELSE ost END AS status, a AS action FROM j"""


for _s in O.STRATEGIES:
    query(_upsert_sql(_s), "terms_v", "terms_import_v", name=f"term_upsert_{_s}")(lambda src, s=_s: O.upsert(src.terms(), src.terms_import(), s))


@query("SELECT id, CASE WHEN id % 8 = 3 THEN target_text || ' edited' ELSE target_text END AS target_text, CASE id % 8 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'approved' ELSE status END AS status FROM terms_v", "terms_v")
def term_status_transitions(src: Source) -> DataFrame:
    t = src.terms()
    decision = F.element_at(F.array(*[F.lit(x) for x in ("approve", "reject", "flag", "edit")]), (F.col("id") % 8 + 1).cast("int"))
    changes = t.where("id % 8 < 4").select("id", decision.alias("decision"), F.concat("target_text", F.lit(" edited")).alias("new_text"))
    return O.transition(t, changes).select("id", "target_text", "status")


@query("SELECT id, usage_count + (SELECT count(*) FROM lineitem l WHERE l.l_partkey = t.id) AS usage_count FROM terms_v t", "terms_v")
def term_usage_count(src: Source) -> DataFrame:
    used = src.table("lineitem").select(F.col("l_partkey").cast("long").alias("id"))
    return O.count_usage(src.terms(), used).select("id", "usage_count")


@query("SELECT DISTINCT n.source_text FROM terms_import_v n WHERE NOT EXISTS (SELECT 1 FROM terms_v o WHERE o.source_text = n.source_text AND o.target_lang = n.target_lang AND o.domain = n.domain)", "terms_v", "terms_import_v")
def term_unknown(src: Source) -> DataFrame:
    return src.terms_import().join(src.terms().select(*O.KEY), O.KEY, "left_anti").select("source_text").distinct()


@query("SELECT n.id FROM terms_import_v n WHERE EXISTS (SELECT 1 FROM terms_v o WHERE o.source_text = n.source_text AND o.target_lang = n.target_lang AND o.domain = n.domain)", "terms_v", "terms_import_v")
def term_exists(src: Source) -> DataFrame:
    return src.terms_import().join(src.terms().select(*O.KEY), O.KEY, "left_semi").select("id")


@query("SELECT id, source_text, status, confidence FROM terms_v WHERE status = 'approved' OR (status = 'unverified' AND confidence >= 0.9)", "terms_v")
def term_injectable(src: Source) -> DataFrame:
    return src.terms().where(O.injectable(True)).select("id", "source_text", "status", "confidence")


@query("SELECT id, source_text, row_number() OVER (ORDER BY confidence DESC, usage_count DESC, id) AS position FROM terms_v WHERE status = 'approved' AND source_text IN (SELECT p_name FROM part WHERE p_size > 25)", "terms_v")
def term_document(src: Source) -> DataFrame:
    """Approved terms that a document names, the surest first."""
    named = src.table("part").where("p_size > 25").select(F.col("p_name").alias("source_text"))
    found = src.terms().where(O.injectable()).join(named, "source_text", "left_semi")
    return running(found, [F.desc("confidence"), F.desc("usage_count"), F.col("id")], F.lit(1)).select("id", "source_text", "position")


@query("""SELECT id, domain FROM (SELECT id, domain, sum(CAST(floor(length(concat(source_text, target_text)) / 2.5) AS BIGINT)) OVER (PARTITION BY domain ORDER BY confidence DESC, usage_count DESC, id) AS run FROM terms_v) t WHERE run <= 1024""", "terms_v")
def term_budget_prefix(src: Source) -> DataFrame:
    """Terms of each domain that fit a quarter of a 4 096-token context; the first misfit ends the list."""
    cost = F.floor(F.length(F.concat("source_text", "target_text")) / 2.5)
    return S.budget_prefix(src.terms(), "domain", [F.desc("confidence"), F.desc("usage_count"), F.col("id")], cost, 1024).select("id", "domain")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT c.vec_id, round(max(list_cosine_similarity(q.e, c.e)), 6) AS score FROM v q, v c WHERE q.vec_id % 10 = 0 AND c.vec_id % 10 <> 0 GROUP BY c.vec_id HAVING max(list_cosine_similarity(q.e, c.e)) >= 0.4""")  # fmt: skip
def term_similarity(src: Source) -> DataFrame:
    v = src.table("embeddings")
    return G.similarity(v.where("vec_id % 10 = 0"), v.where("vec_id % 10 <> 0"), 0.4).select("vec_id", F.round("score", 6).alias("score"))


_WORDS = "SELECT id, source_text, lower(target_text) AS target_text FROM (SELECT min(p_partkey) AS id, source_text, min(target_text) AS target_text FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS source_text, p_type AS target_text FROM part) p GROUP BY source_text) w"


def _lines(src: Source) -> tuple[DataFrame, DataFrame]:
    """Part names with type and brand stand in as texts, so that terms occur."""
    p = src.table("part")
    texts = p.select(F.col("p_partkey").alias("line_id"), F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand").alias("text"))
    words = p.select("p_partkey", F.split("p_name", " ")[0].alias("source_text"), F.col("p_type")).groupBy("source_text").agg(F.min("p_partkey").alias("id"), F.min("p_type").alias("t"))
    return texts, words.select("id", "source_text", F.lower("t").alias("target_text"))


_HITS = f"WITH w AS ({_WORDS}), l AS (SELECT p_partkey AS line_id, concat_ws(' ', p_name, lower(p_type), p_brand) AS text FROM part), h AS (SELECT line_id, id, w.source_text, w.target_text FROM l, w WHERE contains(lower(text), lower(w.source_text)))"


@query(f"{_HITS} SELECT line_id, id AS term_id, source_text, target_text FROM h")
def glossary_applicable(src: Source) -> DataFrame:
    texts, terms = _lines(src)
    return G.applicable(texts, terms, ["line_id"])


@query("""WITH w AS (SELECT p_size AS id, min(p_name) AS source_text, min(p_type) AS target_text FROM part GROUP BY p_size), l AS (SELECT p_partkey AS line_id, concat_ws(' ', 'x' || p_name, lower(p_type), p_brand) AS text FROM part)
SELECT line_id, id AS term_id, source_text FROM l, w WHERE contains(lower(text), lower(w.source_text))""")  # fmt: skip
def glossary_applicable_phrases(src: Source) -> DataFrame:
    """Terms of several words, whose first is only the end of a word of the text."""
    p = src.table("part")
    texts = p.select(F.col("p_partkey").alias("line_id"), F.concat_ws(" ", F.concat(F.lit("x"), "p_name"), F.lower("p_type"), "p_brand").alias("text"))
    words = p.groupBy(F.col("p_size").alias("id")).agg(F.min("p_name").alias("source_text"), F.min("p_type").alias("target_text"))
    return G.applicable(texts, words, ["line_id"]).select("line_id", "term_id", "source_text")


@query(f"{_HITS} SELECT l.line_id, CASE WHEN t IS NULL THEN concat('<', text, '>') ELSE list_reduce(list_prepend(concat('<', text, '>'), t), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE concat(rtrim(a), ' ', x) END) END AS enforced FROM l LEFT JOIN (SELECT line_id, list(target_text ORDER BY id) AS t FROM h GROUP BY line_id) g USING (line_id)")
def glossary_enforced(src: Source) -> DataFrame:
    texts, terms = _lines(src)
    drafts = texts.select("line_id", F.concat(F.lit("<"), "text", F.lit(">")).alias("draft"))
    return G.enforce(drafts, G.applicable(texts, terms, ["line_id"]), ["line_id"]).select("line_id", "enforced")


@query(f"{_HITS} SELECT l.line_id, round(coalesce(r, 1.0), 6) AS rate FROM l LEFT JOIN (SELECT line_id, avg(CASE WHEN contains(lower(text), lower(target_text)) THEN 1.0 ELSE 0.0 END) AS r FROM h JOIN l USING (line_id) GROUP BY line_id) g USING (line_id)")
def glossary_match_rate(src: Source) -> DataFrame:
    texts, terms = _lines(src)
    return G.match_rate(texts, G.applicable(texts, terms, ["line_id"]), ["line_id"], "text").select("line_id", F.round("rate", 6).alias("rate"))


_AUDIT = """WITH t AS (SELECT source_text, target_text, status FROM terms_v WHERE status IN ('approved', 'rejected')),
 j AS (SELECT p_size AS job, lower(string_agg(lower(p_type), ' ' ORDER BY lower(p_type))) AS a FROM part GROUP BY p_size),
 r AS (SELECT job, source_text, status, CASE WHEN status = 'approved' THEN contains(a, target_text) ELSE regexp_matches(a, '\\b' || target_text || '\\b') END AS hit FROM j, t)"""


def _audit(src: Source) -> DataFrame:
    said = src.table("part").select(F.col("p_size").alias("job"), F.lower("p_type").alias("value"))
    return G.audit(said, src.terms(), "job", "value")


@query(_AUDIT.replace("\\\\", "\\") + " SELECT job, count(*) FILTER (WHERE status = 'approved') AS total, count(*) FILTER (WHERE status = 'approved' AND hit) AS matched, round(count(*) FILTER (WHERE status = 'approved' AND hit) / count(*) FILTER (WHERE status = 'approved'), 6) AS hit_rate FROM r GROUP BY job", "terms_v")
def term_audit_hits(src: Source) -> DataFrame:
    return _audit(src).select("job", "total", "matched", F.round("hit_rate", 6).alias("hit_rate"))


@query(_AUDIT.replace("\\\\", "\\") + " SELECT job, coalesce(string_agg(source_text, ';' ORDER BY source_text) FILTER (WHERE status = 'rejected' AND hit), '') AS rejected FROM r GROUP BY job", "terms_v")
def term_audit_rejected(src: Source) -> DataFrame:
    return _audit(src).select("job", F.array_join("rejected_injections", ";").alias("rejected"))


@query("SELECT domain, substr(sha256(string_agg(concat(source_text, chr(0), target_text), chr(10) ORDER BY concat(source_text, chr(0), target_text))), 1, 8) AS digest FROM terms_v WHERE status = 'approved' GROUP BY domain", "terms_v")
def glossary_digest(src: Source) -> DataFrame:
    return G.state_digest(src.terms().where("status = 'approved'"), "domain")


@query(f"SELECT id, {_COLS} FROM terms_v", "terms_v")
def term_export(src: Source) -> DataFrame:
    return src.terms().select("id", *O.COLUMNS)


@query("SELECT lower(p_brand) AS k, count(*) AS n FROM (SELECT p_brand FROM part UNION ALL SELECT lower(p_brand) FROM part) b GROUP BY ALL")
def term_candidates_union(src: Source) -> DataFrame:
    p = src.table("part").select(F.col("p_brand").alias("term"), F.col("p_partkey").alias("pos"))
    kept = O.union_candidates(p, p.withColumn("term", F.lower("term")))
    n = p.unionByName(p).groupBy(F.lower("term").alias("k")).agg(F.count("*").alias("n"))
    return kept.select(F.lower("term").alias("k")).join(n, "k")
