"""Queries on text rules, prompts, replies and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fitting, languages, prompts, replies
from ..functions import text as T
from ..operators import compose, folds, layout, segments
from ..sources.views import Source
from .registry import query

_ID = "CAST(p_partkey AS BIGINT) AS p_partkey"


def _part(src: Source) -> DataFrame:
    return src.table("part").withColumn("p_partkey", F.col("p_partkey").cast("long"))


_LANG = "CASE p_partkey % 8 WHEN 0 THEN 'Traditional Chinese' WHEN 1 THEN 'zh-TW' WHEN 2 THEN 'JAPANESE' WHEN 3 THEN 'Korean' WHEN 4 THEN 'French' WHEN 5 THEN 'german' WHEN 6 THEN 'fr' ELSE 'Klingon' END"
_MARKS = ", ".join(f"'{m}'" for m in T.CJK_LANGUAGE_MARKS)
_CODES = ", ".join(f"('{k.lower()}', '{v}')" for k, v in languages.CODES.items())
_NA = ", ".join(f"('{k}', '{v}')" for k, v in languages.NOT_AVAILABLE.items())
_SPLIT = "CASE " + " ".join(f"WHEN contains(lower(l), '{m}') THEN '{c}'" for m, c in languages.SPLITTERS) + " ELSE 'en' END"


@query(
    f"""WITH t AS (SELECT {_ID}, {_LANG} AS l FROM part), c(name, code) AS (VALUES {_CODES})
    SELECT p_partkey, l AS language, CASE WHEN contains(l, '-') OR length(l) <= 3 THEN l ELSE coalesce(code, l) END AS code, {_SPLIT} AS splitter, len(list_filter([{_MARKS}], lambda m: contains(lower(l), m))) > 0 AS is_cjk,
    contains(lower(l), 'traditional chinese') OR lower(l) IN ('zh-tw', 'zh-hant') AS is_traditional, CASE WHEN len(list_filter([{_MARKS}], lambda m: contains(lower(l), m))) > 0 THEN '' ELSE ' ' END AS joiner FROM t LEFT JOIN c ON c.name = lower(l)"""
)
def language_codes(src: Source) -> DataFrame:
    t = _part(src).select("p_partkey", F.expr(_LANG).alias("language"))
    lang = F.col("language")
    return t.select("p_partkey", "language", languages.code_of(lang).alias("code"), languages.splitter_code(lang).alias("splitter"), T.is_cjk_language(lang).alias("is_cjk"), T.is_traditional_chinese(lang).alias("is_traditional"), T.sentence_joiner(lang).alias("joiner"))


_TARGET = "CASE p_size % 4 WHEN 0 THEN 'German' WHEN 1 THEN 'Thai' WHEN 2 THEN 'Vietnamese' ELSE 'Polish' END"
_WORD = "CASE p_partkey % 4 WHEN 0 THEN ' 無 ' WHEN 1 THEN '无。' WHEN 2 THEN '無x' ELSE p_name END"


@query(f"WITH n(t, v) AS (VALUES {_NA}) SELECT p_partkey, CASE WHEN trim(w) IN ('无', '無', '无。', '無。') THEN coalesce(v, 'N/A') END AS said FROM (SELECT {_ID}, {_WORD} AS w, {_TARGET} AS t FROM part) p LEFT JOIN n USING (t)")
def nothing_bypass(src: Source) -> DataFrame:
    return _part(src).select("p_partkey", languages.bypass(F.expr(_WORD), F.expr(_TARGET)).alias("said"))


_WIDE = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}]"
_MIXED = "CASE p_partkey % 4 WHEN 0 THEN concat('目的', p_name, '。') WHEN 1 THEN concat('カタ ', p_type) WHEN 2 THEN concat('שלום ', substr(p_name, 1, 3)) ELSE p_name END"


@query(rf"SELECT p_partkey, t, CAST(length(regexp_replace(t, '[^' || substr('{_WIDE}', 2), '', 'g')) AS BIGINT) AS wide, round((length(regexp_replace(t, '[^' || substr('{_WIDE}', 2), '', 'g')) + length(regexp_replace(t, '{_WIDE}', '', 'g')) * 0.5::DOUBLE) * 12, 6) AS width FROM (SELECT {_ID}, {_MIXED} AS t FROM part) p")
def wide_text(src: Source) -> DataFrame:
    t = _part(src).select("p_partkey", F.expr(_MIXED).alias("t"))
    return t.select("p_partkey", "t", F.regexp_count("t", F.lit(T.WIDE_CJK)).cast("long").alias("wide"), F.round(T.text_width(F.col("t"), 12.0), 6).alias("width"))


@query(
    rf"""SELECT p_partkey, CASE WHEN n > 0 AND r * 2 > n THEN 'rtl' ELSE 'ltr' END AS direction FROM (SELECT {_ID}, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS n,
    length(regexp_replace(regexp_replace(t, '[^\p{{L}}]', '', 'g'), '[^\x{{0590}}-\x{{05FF}}\x{{0600}}-\x{{06FF}}\x{{0750}}-\x{{077F}}\x{{FB50}}-\x{{FDFF}}\x{{FE70}}-\x{{FEFF}}]', '', 'g')) AS r FROM (SELECT p_partkey, {_MIXED} AS t FROM part) a) b"""
)
def text_direction(src: Source) -> DataFrame:
    return _part(src).select("p_partkey", T.text_direction(F.expr(_MIXED)).alias("direction"))


@query(f"SELECT {_ID}, printf('#%06X', p_partkey * 7919 % 16777216) AS color, p_size & 16 <> 0 AS bold, p_size & 2 <> 0 AS italic, CASE WHEN p_size % 3 = 0 THEN 1.3::DOUBLE WHEN p_size % 3 = 1 THEN 1.2::DOUBLE ELSE 1.15::DOUBLE END AS factor FROM part")
def style_values(src: Source) -> DataFrame:
    bold, italic = T.font_flags(F.col("p_size"))
    target = F.element_at(F.array(F.lit("de"), F.lit("fr"), F.lit("xx")), (F.col("p_size") % 3 + 1).cast("int"))
    return _part(src).select("p_partkey", T.color_hex(F.col("p_partkey") * 7919 % 16_777_216).alias("color"), bold.alias("bold"), italic.alias("italic"), T.expansion_factor(F.lit("en"), target).alias("factor"))


_SHORT = "substr(p_name, 1, p_size % 14)"


@query(f"SELECT {_ID}, CASE WHEN length(s) < 10 AND length(r) > greatest(length(s) * 20, 100) THEN s ELSE r END AS kept FROM (SELECT p_partkey, {_SHORT} AS s, repeat(p_type, p_size % 9) AS r FROM part) p")
def short_reply_guard(src: Source) -> DataFrame:
    return _part(src).select("p_partkey", T.guard_short_reply(F.expr(_SHORT), F.expr("repeat(p_type, p_size % 9)")).alias("kept"))


_JSON_REPLY = """CASE p_partkey % 7 WHEN 0 THEN concat('{"translation": "', p_type, '"}') WHEN 1 THEN concat('{"translation": "', p_name, '"}') WHEN 2 THEN '{"translation": 5}' WHEN 3 THEN '[1]' WHEN 4 THEN 'not json' WHEN 5 THEN '' ELSE '{"x": "y"}' END"""


@query(
    f"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 5 THEN 'empty content' WHEN p_partkey % 7 = 4 THEN 'unparseable JSON' WHEN p_partkey % 7 = 3 THEN 'reply is not a JSON object' WHEN json_type(r, '$.translation') IS DISTINCT FROM 'VARCHAR' THEN 'missing or non-string ''translation'' key'
      WHEN json_extract_string(r, '$.translation') = p_name THEN 'echoed source (untranslated reply)' ELSE '' END AS reason, CASE WHEN p_partkey % 7 = 0 THEN json_extract_string(r, '$.translation') END AS said
    FROM (SELECT {_ID}, p_name, CASE WHEN p_partkey % 7 IN (4, 5) THEN NULL ELSE CAST({_JSON_REPLY} AS JSON) END AS r FROM part) p"""
)
def body_reply(src: Source) -> DataFrame:
    t = _part(src).select("p_partkey", "p_name", F.expr(_JSON_REPLY).alias("r"))
    return t.select("p_partkey", replies.body_reason(F.col("r"), F.col("p_name")).alias("reason"), replies.body_translation(F.col("r"), F.col("p_name")).alias("said"))


@query(f"SELECT {_ID}, concat('<<<SEG_0>>>', chr(10), p_name, chr(10), '<<<SEG_1>>>', chr(10), p_type) AS message, p_name AS first, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS second FROM part")
def segment_markers(src: Source) -> DataFrame:
    """Merged messages, and what is read back of a reply whose last segment is missing in every third."""
    m = replies.merged(F.array("p_name", "p_type"))
    t = _part(src).select("p_partkey", m.alias("message"))
    reply = F.when(F.col("p_partkey") % 3 == 0, F.substring_index("message", "\n<<<SEG_1>>>", 1)).otherwise(F.col("message"))
    got = replies.split_reply(reply, F.lit(2))
    return t.select("p_partkey", "message", F.get(got, F.lit(0)).alias("first"), F.get(got, F.lit(1)).alias("second"))


@query(f"SELECT {_ID}, concat(p_name, CASE WHEN p_partkey % 4 = 2 THEN chr(10) || p_type ELSE '' END) AS clean FROM part")
def reply_sanitised(src: Source) -> DataFrame:
    """Emphasis, tags, commentary and thoughts around a name, all of which go."""
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('**', p_name, '**') WHEN 1 THEN concat('Note: fine\n', p_name) WHEN 2 THEN concat('<<<SEP>>>', p_name, '\n', p_type, '\n') ELSE concat('<think>why\nnot</think>\n', p_name) END")
    return _part(src).select("p_partkey", replies.sanitize(T.strip_think(raw)).alias("clean"))


_TERMS_REPLY = """CASE p_partkey % 5 WHEN 0 THEN concat('[{"term": "', p_name, '"}, 5]') WHEN 1 THEN concat('{"terms": [{"term": "', p_name, '"}, {"term": "', p_type, '"}]}') WHEN 2 THEN concat('so: [{"term": "', p_name, '"}] end') WHEN 3 THEN 'none' ELSE '{"a": [], "b": []}' END"""


@query(f"SELECT p_partkey, t FROM (SELECT {_ID}, unnest(CASE p_partkey % 5 WHEN 0 THEN [p_name] WHEN 1 THEN [p_name, p_type] WHEN 2 THEN [p_name] ELSE CAST([] AS VARCHAR[]) END) AS t FROM part) p")
def extracted_terms(src: Source) -> DataFrame:
    t = _part(src).select("p_partkey", F.explode(prompts.extracted_terms(F.expr(_TERMS_REPLY))).alias("x"))
    return t.select("p_partkey", F.get_json_object("x", "$.term").alias("t"))


_TRANSLATED = """concat(CASE WHEN p_partkey % 2 = 0 THEN 'Here: ' ELSE '' END, '{"translations": [{"source": "', p_name, '", "target": "', p_type, '", "confidence": ', CAST(p_size AS VARCHAR), 'e-2}, {"source": "", "target": "x"}, {"source": "', p_brand, '"}]}')"""


@query(f"SELECT {_ID}, p_name AS source, p_type AS target, least(p_size / 100.0::DOUBLE, 0.85::DOUBLE) AS confidence FROM part UNION ALL SELECT p_partkey, p_brand, '', 0.85::DOUBLE FROM part")
def translated_terms(src: Source) -> DataFrame:
    t = _part(src).select("p_partkey", F.explode(prompts.translated_terms(F.expr(_TRANSLATED.replace("VARCHAR", "STRING")))).alias("x"))
    return t.select("p_partkey", "x.source", "x.target", "x.confidence")


_BODY_SQL = prompts.BODY.replace("{{", "{").replace("}}", "}").replace("\n", "' || chr(10) || '")


@query(f"""SELECT {_ID}, replace(replace('{_BODY_SQL}', '{{src}}', CASE WHEN p_size % 2 = 0 THEN 'auto' ELSE 'English' END), '{{tgt}}', p_brand) || concat('{{"text": "', replace(p_name, '"', '\\"'), '"}}') AS payload FROM part""")
def body_payload(src: Source) -> DataFrame:
    return _part(src).select("p_partkey", prompts.body_payload(F.col("p_name"), F.when(F.col("p_size") % 2 == 1, "English"), F.col("p_brand")).alias("payload"))


_TABLE_SQL = prompts.TABLE.replace("{{", "{").replace("}}", "}").replace("\n", "' || chr(10) || '").replace("{src}", "auto").replace("{tgt}", "Thai")


@query(f"""SELECT table_id, '{_TABLE_SQL}' || concat('{{"cells": [', coalesce(string_agg(concat('{{"row": ', row, ', "col": ', col, ', "text": "', content, '"}}'), ', ' ORDER BY row, col) FILTER (WHERE content <> '' AND col <> 2), ''), ']}}') AS payload FROM cells_v GROUP BY table_id""", "cells_v")
def table_payload(src: Source) -> DataFrame:
    cells = src.cells().groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "content", T.is_numeric_cell(F.col("content")).alias("is_numeric")))).alias("c"))
    return cells.select("table_id", prompts.table_payload(F.col("c"), F.lit(None).cast("string"), F.lit("Thai")).alias("payload"))


_PAIRS = "string_agg(concat('- ', source_text, ' => ', target_text), chr(10) ORDER BY source_text, target_text)"


@query(f"SELECT domain, concat('# Glossary', chr(10), {_PAIRS}) AS glossary, concat('Terminology constraints:', chr(10), {_PAIRS}) AS terminology, concat('# Translation examples', chr(10), string_agg(concat('Source: ', source_text, chr(10), 'Target: ', target_text), chr(10) || chr(10) ORDER BY source_text, target_text)) AS examples FROM terms_v WHERE status = 'approved' GROUP BY domain", "terms_v")
def prompt_blocks(src: Source) -> DataFrame:
    pair = F.array_sort(F.collect_list(F.struct("source_text", "target_text")))
    t = src.terms().where("status = 'approved'").groupBy("domain").agg(pair.alias("p"))
    shown = F.transform("p", lambda x: F.struct(x["source_text"].alias("source"), x["target_text"].alias("target")))
    return t.select("domain", prompts.glossary_block(F.col("p")).alias("glossary"), prompts.terminology_block(F.col("p")).alias("terminology"), prompts.fewshot_block(shown).alias("examples"))


@query("SELECT conv_id, turn, substr(text, 1, 200) AS context, substr(text, 1, 240) AS critique, substr(text, 1, 300) AS sample, substr(text, 1, 60) AS snippet FROM conversations")
def context_clips(src: Source) -> DataFrame:
    return src.table("conversations").select("conv_id", "turn", *[prompts.clip(F.col("text"), k).alias(k) for k in prompts.CLIPS])


@query(
    f"""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(trim(text)) AS n FROM conversations WHERE trim(text) <> ''),
    f AS (SELECT conv_id, i, n + 1 AS used, CAST(0 AS BIGINT) AS chunk FROM u WHERE i = 1 UNION ALL SELECT u.conv_id, u.i, CASE WHEN f.used + u.n + 1 > 400 THEN u.n ELSE f.used + u.n + 1 END, CASE WHEN f.used + u.n + 1 > 400 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN u ON u.conv_id = f.conv_id AND u.i = f.i + 1)
    SELECT conv_id, chunk, string_agg(trim(text), chr(10) ORDER BY u.i) AS text FROM f JOIN u USING (conv_id, i) GROUP BY conv_id, chunk""".replace("WITH u", "WITH RECURSIVE u")
)
def unit_chunks(src: Source) -> DataFrame:
    return folds.unit_chunks(src.table("conversations"), "conv_id", "turn", "text", 400)


@query(
    """WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS n FROM conversations WHERE trim(text) <> ''),
    f AS (SELECT conv_id, turn, i, n + 13 AS used, CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS place FROM u WHERE i = 1
      UNION ALL SELECT u.conv_id, u.turn, u.i, CASE WHEN f.used + u.n + 13 > 600 OR f.place >= 3 THEN u.n + 12 ELSE f.used + u.n + 13 END, CASE WHEN f.used + u.n + 13 > 600 OR f.place >= 3 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + u.n + 13 > 600 OR f.place >= 3 THEN 0 ELSE f.place + 1 END
      FROM f JOIN u ON u.conv_id = f.conv_id AND u.i = f.i + 1) SELECT conv_id, turn, batch, place FROM f"""
)
def marked_batches(src: Source) -> DataFrame:
    return folds.marked_batches(src.table("conversations"), "conv_id", "turn", "text", 600)


@query("SELECT conv_id, turn, tokens FROM (SELECT conv_id, turn, tokens, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM (SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 2.5) AS BIGINT)) END AS tokens FROM conversations) c) t WHERE later < 40")
def overlap_tail(src: Source) -> DataFrame:
    c = src.table("conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))
    return segments.overlap_tail(c, "conv_id", "turn", "tokens", 40)


@query("SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS pos, unnest(p) AS part FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '') AS p FROM documents WHERE length(text) > 1500 AND NOT contains(text, chr(10) || chr(10))) d WHERE list_max(list_transform(p, lambda x: length(x))) <= 1500 UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 1500 AND regexp_replace(text, '^[\\s\\p{Z}]+', '', 'g') <> ''")
def paragraph_parts(src: Source) -> DataFrame:
    """Short texts whole, long ones by lines; those with longer lines or paragraphs are in the tests."""
    d = src.table("documents")
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    plain = (F.length("text") <= 1500) | (~F.contains("text", F.lit("\n\n")) & F.forall(lines, lambda x: F.length(x) <= 1500))
    return d.where(plain).select("doc_id", F.posexplode(compose.split_paragraph(F.col("text"))).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT {_ID}, round(greatest(8.0::DOUBLE, least(72.0::DOUBLE, p_size * 4 / (p_partkey % 3 + 1)::DOUBLE * 0.85::DOUBLE / 1.2::DOUBLE)), 6) AS size FROM part")
def starting_size(src: Source) -> DataFrame:
    return _part(src).select("p_partkey", F.round(fitting.starting_size(F.col("p_size") * 4.0, (F.col("p_partkey") % 3 + 1).cast("double")), 6).alias("size"))


@query(
    f"""WITH RECURSIVE t AS (SELECT {_ID}, length(p_name) * 0.5::DOUBLE AS u, p_size * 6.0::DOUBLE AS w, p_size * 2.0::DOUBLE AS h FROM part),
    s AS (SELECT *, 30.0::DOUBLE AS z FROM t UNION ALL SELECT p_partkey, u, w, h, z * 0.9::DOUBLE FROM s WHERE z >= 8 AND NOT (u * z <= w AND z * 1.2::DOUBLE <= h))
    SELECT p_partkey, round(greatest(min(z), 8.0), 6) AS size, bool_or(z >= 8 AND u * z <= w AND z * 1.2::DOUBLE <= h) AS fits FROM s GROUP BY p_partkey"""
)
def shrink_fit(src: Source) -> DataFrame:
    got = fitting.shrink_fit(F.col("p_name"), F.col("p_size") * 6.0, F.col("p_size") * 2.0, F.lit(30.0))
    return _part(src).select("p_partkey", got.alias("g")).select("p_partkey", F.round("g.size", 6).alias("size"), "g.fits")


@query("SELECT table_id, count(DISTINCT row) AS rows, count(DISTINCT col) AS cols FROM (SELECT *, CAST(col * 30 AS DOUBLE) AS x0, CAST(col * 30 + 25 + table_id % 3 AS DOUBLE) AS x1, CAST(row * 9 AS DOUBLE) AS y0, CAST(row * 9 + 6 + table_id % 4 AS DOUBLE) AS y1 FROM cells_v) c GROUP BY table_id HAVING count(DISTINCT row) >= 2 AND count(DISTINCT col) >= 2 AND min(x1 - x0) > 2 AND min(y1 - y0) >= 8", "cells_v")
def sane_tables(src: Source) -> DataFrame:
    c, i = src.cells(), F.col("table_id")
    boxed = c.select("*", (F.col("col") * 30.0).alias("x0"), (F.col("col") * 30.0 + 25 + i % 3).alias("x1"), (F.col("row") * 9.0).alias("y0"), (F.col("row") * 9.0 + 6 + i % 4).alias("y1"))
    return layout.sane_tables(boxed)


@query(
    """WITH n AS (SELECT table_id, row, max(length(content)) % 7 * 1.0::DOUBLE AS need FROM cells_v GROUP BY ALL), s AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY table_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n)
    SELECT table_id, row, greatest(least(need, 20 - b), 0) AS growth, least(b, 20) AS shift FROM s""",
    "cells_v",
)
def row_growth(src: Source) -> DataFrame:
    need = src.cells().groupBy("table_id", "row").agg((F.max(F.length("content")) % 7 * 1.0).alias("need"))
    return layout.grow_rows(need, 20.0)
