"""Queries on documents' lines: filtering, caching, context, sampling and measuring."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cache as C
from ..operators import chunks, folds
from ..operators import segments as S
from ..sources.views import Source
from .registry import query

STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
REASON = r"""CASE WHEN t = '' THEN 'empty' WHEN regexp_replace(t, '[^\p{L}\p{N}]', '', 'g') = '' THEN 'no_alnum'
 WHEN regexp_matches(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g'), '^\p{Nd}+$') THEN 'digits' WHEN regexp_matches(t, '^[-+]?\p{Nd}+([.,]\p{Nd}+)*[.]?$') THEN 'number'
 WHEN regexp_replace(t, '[^\p{L}]', '', 'g') = '' THEN 'no_letter'
 WHEN NOT regexp_matches(t, '[\x{4E00}-\x{9FFF}]') AND length(regexp_replace(t, '[^\p{L}]', '', 'g')) < 3 THEN 'short' ELSE 'ok' END"""
NORM = r"lower(trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g')))"


@query(
    f"""WITH s AS (SELECT lang, text, {STRIP.format("text")} AS t FROM segments_v), k AS (SELECT lang, text, t FROM s WHERE {REASON} = 'ok'),
    d AS (SELECT lang, text, count(*) AS n FROM k GROUP BY ALL),
    h AS (SELECT d.*, sha256(concat_ws(chr(0), {STRIP.format("text")}, 'english', lower(lang), 'm')) AS key_hash FROM d)
    SELECT h.lang, CAST(sum(n) AS BIGINT) AS segments, count(*) AS distinct_texts, count(c.key_hash) AS hits, count(*) - count(c.key_hash) AS misses, CAST(sum(n) - (count(*) - count(c.key_hash)) AS BIGINT) AS calls_avoided
    FROM h LEFT JOIN (SELECT DISTINCT key_hash FROM cache_v) c USING (key_hash) GROUP BY h.lang""",
    "segments_v", "cache_v",
)
def corpus_cache_plan(src: Source) -> DataFrame:
    """Translatable lines, distinct ones, cache hits and the model calls that neither repeats nor hits need."""
    # Rules and digests see each distinct line once.
    kept = src.segments().groupBy("lang", "text").agg(F.count("*").alias("n")).where(T.should_translate(F.col("text")))
    keyed = kept.withColumn("key_hash", T.cache_key(F.col("text"), F.lit("English"), F.col("lang"), F.lit("m")))
    found = C.lookup(keyed, src.cache())
    hit = F.count("translation")
    return found.groupBy("lang").agg(F.sum("n").alias("segments"), F.count("*").alias("distinct_texts"), hit.alias("hits"), (F.count("*") - hit).alias("misses"), (F.sum("n") - F.count("*") + hit).alias("calls_avoided"))


@query("SELECT doc_id, lang, seq, text FROM segments_v", "segments_v")
def segment_explode(src: Source) -> DataFrame:
    return src.segments()


@query("SELECT text, doc_id, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, seq) AS r, count(*) OVER (PARTITION BY text) AS n FROM segments_v) t WHERE r = 1", "segments_v")
def segment_first_seen(src: Source) -> DataFrame:
    return S.first_seen(src.segments(), "text", "doc_id", "seq")


@query(f"SELECT lang, reason, count(*) AS n FROM (SELECT lang, {REASON} AS reason FROM (SELECT lang, {STRIP.format('text')} AS t FROM segments_v) s) r GROUP BY ALL", "segments_v")
def translatable_filter_reasons(src: Source) -> DataFrame:
    return src.segments().groupBy("lang", T.translatable_reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    """WITH b AS (SELECT sha256(concat_ws(chr(0), role, 'english')) AS key_hash, conv_id, turn, text AS translation FROM conversations WHERE conv_id % 3 <> 0),
    e AS (SELECT DISTINCT sha256(concat_ws(chr(0), role, 'english')) AS key_hash FROM conversations WHERE conv_id % 3 = 0 AND role = 'user' AND turn = 0)
    SELECT key_hash, conv_id, turn, translation FROM (SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY conv_id, turn) AS r FROM b WHERE key_hash NOT IN (SELECT key_hash FROM e)) t WHERE r = 1"""
)
def cache_first_write_wins(src: Source) -> DataFrame:
    rows = src.table("conversations").withColumn("key_hash", F.sha2(F.concat_ws("\u0000", "role", F.lit("english")), 256))
    have = rows.where("conv_id % 3 = 0 and role = 'user' and turn = 0").select("key_hash").distinct()
    batch = rows.where("conv_id % 3 <> 0").select("key_hash", "conv_id", "turn", F.col("text").alias("translation"))
    return C.first_write_wins(batch, have, "conv_id", "turn")


_MODELS = "CASE length(text) % 5 WHEN 0 THEN 'M_' WHEN 1 THEN 'mx::ctx' WHEN 2 THEN 'm_other' WHEN 3 THEN 'm_::v' ELSE 'n' END"


@query(f"SELECT key_hash, model FROM (SELECT key_hash, {_MODELS} AS model FROM cache_v) c WHERE NOT (lower(model) = 'm_' OR lower(model) LIKE 'm_::%')", "cache_v")
def cache_clear_model(src: Source) -> DataFrame:
    return C.clear_model(src.cache().select("key_hash", F.expr(_MODELS).alias("model")), "m_")


@query("SELECT key_hash, translation FROM cache_v WHERE NOT regexp_matches(coalesce(translation, ''), '^[\\s\\p{Z}]*$')", "cache_v")
def cache_purge_blank(src: Source) -> DataFrame:
    return C.purge_blank(src.cache()).select("key_hash", "translation")


@query("SELECT lang, count(*) AS n_rows, CAST(sum(length(translation)) AS BIGINT) AS chars FROM cache_v GROUP BY lang", "cache_v")
def cache_stats(src: Source) -> DataFrame:
    return src.cache().groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum(F.length("translation")).alias("chars"))


@query("SELECT s.doc_id, s.seq, m.target, m.value FROM segments_v s LEFT JOIN (SELECT text, any_value(target) AS target, min(value) AS value FROM tmap_v GROUP BY text) m USING (text)", "segments_v", "tmap_v")
def restore_segments(src: Source) -> DataFrame:
    one = src.tmap().groupBy("text").agg(F.first("target").alias("target"), F.min("value").alias("value"))
    return S.restore(src.segments(), one, ["text"]).select("doc_id", "seq", "target", "value")


_CELL_MAP = "SELECT DISTINCT content AS text, CASE WHEN col = 2 THEN NULL ELSE col END AS col, t.target, concat(t.target, ':', content) AS value FROM cells_v, (VALUES ('Vietnamese', 2), ('German', 3)) AS t(target, m) WHERE length(content) % m = 0"


def _cell_map(src: Source) -> DataFrame:
    targets = src.spark.createDataFrame([("Vietnamese", 2), ("German", 3)], "target string, m int")
    pairs = src.cells().select(F.col("content").alias("text"), F.when(F.col("col") == 2, None).otherwise(F.col("col")).alias("col")).distinct()
    return pairs.crossJoin(F.broadcast(targets)).where("length(text) % m = 0").select("text", "col", "target", F.concat("target", F.lit(":"), "text").alias("value"))  # two fixed rows


@query(f"WITH m AS ({_CELL_MAP}), c AS (SELECT table_id, row, CASE WHEN col = 2 THEN NULL ELSE col END AS col, content AS text FROM cells_v) SELECT c.table_id, c.row, c.col, c.text, m.target, m.value FROM c LEFT JOIN m ON c.text = m.text AND c.col IS NOT DISTINCT FROM m.col", "cells_v")
def restore_null_safe(src: Source) -> DataFrame:
    cells = src.cells().select("table_id", "row", F.when(F.col("col") == 2, None).otherwise(F.col("col")).alias("col"), F.col("content").alias("text"))
    return S.restore(cells, _cell_map(src), ["text"], "col")


@query(f"WITH m AS ({_CELL_MAP}), c AS (SELECT table_id, row, col AS c0, CASE WHEN col = 2 THEN NULL ELSE col END AS col, content AS text FROM cells_v) SELECT c.table_id, c.row, c.c0, count(DISTINCT m.target) AS n_targets FROM c JOIN m ON c.text = m.text AND c.col IS NOT DISTINCT FROM m.col GROUP BY ALL HAVING count(DISTINCT m.target) = 2", "cells_v")
def restore_all_targets_required(src: Source) -> DataFrame:
    cells = src.cells().select("table_id", "row", F.col("col").alias("c0"), F.when(F.col("col") == 2, None).otherwise(F.col("col")).alias("col"), F.col("content").alias("text"))
    return S.with_all_targets(S.restore(cells, _cell_map(src), ["text"], "col"), ["table_id", "row", "c0"], 2)


@query("""WITH c AS (SELECT conv_id, turn, text, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS j FROM conversations)
SELECT conv_id, turn, CASE WHEN length(j) > 300 THEN right(j, 300) ELSE j END AS context FROM c""")  # fmt: skip
def context_window(src: Source) -> DataFrame:
    return S.context_window(src.table("conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("""SELECT doc_id, substr(string_agg(text, chr(10) ORDER BY seq), 1, 500) AS sample FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM segments_v) s WHERE b < 500 GROUP BY doc_id""", "segments_v")
def file_sample_prefix(src: Source) -> DataFrame:
    return S.sample_prefix(src.segments(), "doc_id", "seq", "text")


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, seq, length(text) AS n FROM segments_v),
    f AS (SELECT doc_id, seq, n AS used, CAST(0 AS BIGINT) AS batch FROM s WHERE seq = 0 UNION ALL
      SELECT s.doc_id, s.seq, CASE WHEN f.used + s.n > 2000 THEN s.n ELSE f.used + s.n END, CASE WHEN f.used + s.n > 2000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN s ON s.doc_id = f.doc_id AND s.seq = f.seq + 1)
    SELECT doc_id, seq, batch FROM f""".replace("WITH RECURSIVE", "WITH"),
    "segments_v",
)
def greedy_batches(src: Source) -> DataFrame:
    return folds.greedy_batches(src.segments(), "doc_id", "seq", F.length("text"), 2000)


@query("SELECT doc_id, seq, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 2.5) AS BIGINT)) END AS tokens FROM segments_v", "segments_v")
def token_estimates(src: Source) -> DataFrame:
    return src.segments().select("doc_id", "seq", T.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) AS cjk, length(regexp_replace(text, '[^\p{L}]', '', 'g')) - length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) AS other_letters FROM documents")
def composition_counts(src: Source) -> DataFrame:
    cjk, other = T.composition(F.col("text"))
    return src.table("documents").select("doc_id", cjk.alias("cjk"), other.alias("other_letters"))


@query(
    f"""SELECT doc_id, seq, CAST(length(n) AS BIGINT) AS source_chars, e AS expected, length(n) >= 15 AND e > 0 AND length(value) < 0.3 * e AS is_short FROM (
    SELECT doc_id, seq, substr(value, 1, 1 + CAST(seq % 3 AS BIGINT) * 40) AS value, n, round(length(regexp_replace(n, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) * 3.51::DOUBLE + (length(regexp_replace(n, '[^\\p{{L}}]', '', 'g')) - length(regexp_replace(n, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g'))) * 0.75::DOUBLE, 6) AS e
    FROM (SELECT *, {NORM.format("text")} AS n FROM tmap_v) a) b""",
    "tmap_v",
)
def length_guard(src: Source) -> DataFrame:
    return _guard(src.tmap())


def _guard(t: DataFrame) -> DataFrame:
    t = t.withColumn("value", F.expr("substr(value, 1, 1 + cast(seq % 3 as int) * 40)"))
    source = F.col("text")
    return t.select("doc_id", "seq", F.length(T.normalize(source)).cast("long").alias("source_chars"), F.round(T.expected_length(T.normalize(source), F.col("target")), 6).alias("expected"), T.is_suspiciously_short(source, F.col("value"), F.col("target")).alias("is_short"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '')"


@query(f"SELECT doc_id, seq, CAST(i - 1 AS BIGINT) AS pos, p[i] AS sentence FROM (SELECT doc_id, seq, {_SENTENCES} AS p FROM segments_v) s, LATERAL unnest(range(1, len(p) + 1)) AS u(i)", "segments_v")
def sentence_split(src: Source) -> DataFrame:
    return src.segments().select("doc_id", "seq", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, string_agg(line, chr(10) ORDER BY seq) AS text FROM (SELECT doc_id, seq, array_to_string({_SENTENCES}, ' ') AS line FROM segments_v) s GROUP BY doc_id", "segments_v")
def sentence_rejoin(src: Source) -> DataFrame:
    """Lines to sentences, sentences back to lines, lines back to documents, in order at both levels."""
    parts = src.segments().select("doc_id", "seq", F.posexplode_outer(T.sentences(F.col("text"))).alias("pos", "s"))
    lines = parts.groupBy("doc_id", "seq").agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("pos", "s")))).alias("p")).select("doc_id", "seq", F.array_join("p.s", " ").alias("line"))
    return lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l")).select("doc_id", F.array_join("l.line", "\n").alias("text"))


_FAILED = "|".join(map(re.escape, T.FAILURE_PREFIXES)).replace("\\ ", " ")


@query(rf"SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(value, '^\[({_FAILED})')) AS failed FROM tmap_v GROUP BY doc_id", "tmap_v")
def failure_scan(src: Source) -> DataFrame:
    return src.tmap().groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_failure(F.col("value"))).alias("failed"))


_REPLY = "CASE turn % 4 WHEN 0 THEN 'Could you provide the TEXT you''d like translated?' WHEN 1 THEN concat(text, ' no text was provided') WHEN 2 THEN text ELSE 'The translator needs more context to translate this.' END"


_REFUSED = " OR ".join("contains(lower(t), '" + p.replace("'", "''") + "')" for p in T.REFUSAL_PHRASES)


@query(f"SELECT conv_id, turn, t <> '' AND length(t) <= 200 AND ({_REFUSED}) AS refusal FROM (SELECT conv_id, turn, {STRIP.format(_REPLY)} AS t FROM conversations) c")
def refusal_scan(src: Source) -> DataFrame:
    return src.table("conversations").select("conv_id", "turn", T.is_refusal(F.expr(_REPLY)).alias("refusal"))


_TERM = """CASE p_partkey % 8 WHEN 0 THEN p_size || '~' || p_partkey || 'kg/cm2' WHEN 1 THEN p_size || '.5mm x' WHEN 2 THEN 'B' || (p_size % 10) WHEN 3 THEN 'QC-OC' || (100 + p_size)
      WHEN 4 THEN 'Password' WHEN 5 THEN p_size || 'V' WHEN 6 THEN '5S' ELSE p_name END"""
_NOISE = " OR ".join(f"regexp_matches(term, '{p}')" for p in T.NOISE_PATTERNS)


@query(f"SELECT CAST(p_partkey AS BIGINT) AS p_partkey, term, {_NOISE} OR lower(term) = 'acme' AS noise FROM (SELECT p_partkey, {_TERM} AS term FROM part) t")
def term_noise_filter(src: Source) -> DataFrame:
    term = F.expr(_TERM)
    return src.table("part").select(F.col("p_partkey").cast("long").alias("p_partkey"), term.alias("term")).withColumn("noise", T.is_noise_term(F.col("term"), ["Acme"]))


@query()
def chunk_document(src: Source) -> DataFrame:
    """Overlapping chunks of each document's lines; held against a plain model of the rule in the tests."""
    elements = src.segments().select("doc_id", F.col("seq"), F.lit("text").alias("element_type"), F.col("text").alias("content"))
    return chunks.chunk(elements, ceiling=200, overlap=20)


@query("SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS BIGINT) AS position FROM segments_v", "segments_v")
def chunk_reassemble(src: Source) -> DataFrame:
    elements = src.segments().select("doc_id", "seq", F.lit("text").alias("element_type"), F.col("text").alias("content"))
    return chunks.reassemble(chunks.chunk(elements, ceiling=200, overlap=20), elements)


@query(f"SELECT 'x' AS probe, {NORM.format('text')} AS norm, doc_id, seq FROM segments_v", "segments_v")
def normalized_text(src: Source) -> DataFrame:
    return src.segments().select(F.lit("x").alias("probe"), T.normalize(F.col("text")).alias("norm"), "doc_id", "seq")


@query("SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, substr(text, CAST((i - 1) * 1500 + 1 AS BIGINT), 1500) AS part FROM documents, LATERAL unnest(range(1, CAST(ceil(length(text) / 1500.0) AS BIGINT) + 1)) AS u(i)")
def force_split(src: Source) -> DataFrame:
    return src.table("documents").select("doc_id", F.posexplode(T.force_split(F.col("text"), 1500)).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))
