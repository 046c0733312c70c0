"""Queries on page elements: from spans to blocks, grids, order, what is drawn and what is listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pages as P
from ..sources.views import Source
from .registry import query


@query(
    """WITH l AS (SELECT doc_id, page, block, line, trim(string_agg(text, '' ORDER BY span)) AS t, arg_min({'font': font, 'size': size, 'flags': flags, 'color': color}, span) AS st, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM spans_v WHERE text <> '' GROUP BY ALL),
    b AS (SELECT doc_id, page, block, string_agg(t, ' ' ORDER BY line) FILTER (WHERE t <> '') AS content, arg_min(st, line) AS st, min(x0) FILTER (WHERE t <> '') AS x0, min(y0) FILTER (WHERE t <> '') AS y0, max(x1) FILTER (WHERE t <> '') AS x1, max(y1) FILTER (WHERE t <> '') AS y1 FROM l GROUP BY ALL)
    SELECT doc_id, page, block, content, CASE WHEN y0 < 50 THEN 'header' WHEN y1 > 742 THEN 'footer' ELSE 'text' END AS element_type, NOT (y0 < 50 OR y1 > 742) AS should_translate, st.font AS font, st.size AS size, st.flags & 16 <> 0 AS bold, st.flags & 2 <> 0 AS italic, printf('#%06X', st.color) AS color, x0, y0, x1, y1 FROM b WHERE length(content) >= 1""",
    "spans_v",
)
def pdf_text_blocks(src: Source) -> DataFrame:
    return P.text_blocks(src.spans())


@query("SELECT conv_id AS doc_id, trim(text) AS content, min(CAST(turn AS BIGINT)) AS page, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY ALL")
def pdf_page_texts(src: Source) -> DataFrame:
    pages = src.table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("page"), "text")
    return P.page_texts(pages)


_TYPES = "CASE element_id % 6 WHEN 0 THEN 'formula' WHEN 1 THEN 'figure' WHEN 2 THEN 'table' WHEN 3 THEN 'table_cell' WHEN 4 THEN 'header' ELSE 'text' END"


def _typed(src: Source) -> DataFrame:
    return src.boxes().withColumn("element_type", F.expr(_TYPES)).withColumn("content", F.concat(F.lit("c"), F.col("element_id").cast("string"))).withColumn("translated", F.when(F.col("element_id") % 4 == 0, F.concat(F.lit("t"), F.col("element_id").cast("string"))))


_TYPED = f"SELECT *, {_TYPES} AS element_type, concat('c', element_id) AS content, CASE WHEN element_id % 4 = 0 THEN concat('t', element_id) END AS translated FROM boxes_v"


@query(f"SELECT element_id, element_type, should_translate AND element_type NOT IN ('formula', 'figure') AS should_translate, CASE WHEN element_type = 'formula' THEN coalesce(translated, content) ELSE translated END AS translated FROM ({_TYPED}) t", "boxes_v")
def formula_pass_through(src: Source) -> DataFrame:
    return P.pass_through(_typed(src)).select("element_id", "element_type", "should_translate", "translated")


@query(f"SELECT element_id, CASE WHEN element_type = 'table' AND element_id % 4 = 0 THEN 'cells' ELSE 'flat' END AS path FROM ({_TYPED}) t", "boxes_v")
def structured_tables(src: Source) -> DataFrame:
    own, rest = P.split_structured(_typed(src).withColumn("structured", F.col("element_id") % 4 == 0))
    return own.select("element_id", F.lit("cells").alias("path")).unionByName(rest.select("element_id", F.lit("flat").alias("path")))


@query("SELECT element_id, doc_id AS table_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM boxes_v WHERE should_translate AND element_id % 5 <> 0) t WHERE n >= 2", "boxes_v")
def table_groups(src: Source) -> DataFrame:
    cells = src.boxes().select("element_id", F.col("doc_id").alias("table_id"), F.when(F.col("should_translate"), F.col("page")).alias("row"), F.when(F.col("element_id") % 5 != 0, F.col("page")).alias("col"))
    return P.table_groups(cells).select("element_id", "table_id")


_CELLS = "SELECT doc_id, page, b.row * 4 + b.col AS cell, b.row, b.col, b.col * 160.0::DOUBLE AS x0, b.row * 200.0::DOUBLE AS y0, b.col * 160.0::DOUBLE + 160 AS x1, b.row * 200.0::DOUBLE + 200 AS y1 FROM (SELECT DISTINCT doc_id, page FROM {0}) p, (SELECT r.r AS row, c.c AS col FROM (VALUES (0), (1), (2), (3)) AS r(r), (VALUES (0), (1), (2), (3)) AS c(c)) b"


def _grid(src: Source, boxes: DataFrame) -> DataFrame:
    """A grid of four by four cells on every page."""
    at = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(i.cast("long").alias("cell"), F.floor(i / 4).cast("long").alias("row"), (i % 4).cast("long").alias("col")))
    g = boxes.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(at).alias("g")).select("doc_id", "page", "g.*")
    x, y = F.col("col") * 160.0, F.col("row") * 200.0
    return g.select("*", x.alias("x0"), y.alias("y0"), (x + 160).alias("x1"), (y + 200).alias("y1"))


@query(f"WITH g AS ({_CELLS.format('boxes_v')}) SELECT b.doc_id, b.page, b.element_id, count(*) AS cells FROM boxes_v b JOIN g ON g.doc_id = b.doc_id AND g.page = b.page WHERE least(b.x1, g.x1) - greatest(b.x0, g.x0) > 2 AND least(b.y1, g.y1) - greatest(b.y0, g.y0) > 2 GROUP BY ALL HAVING count(*) > 1", "boxes_v")
def box_spans_cells(src: Source) -> DataFrame:
    return P.spans_cells(src.boxes(), _grid(src, src.boxes()))


@query("SELECT a.doc_id AS table_id, a.element_id AS row, b.element_id AS col, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM boxes_v a JOIN boxes_v b ON a.doc_id = b.doc_id WHERE a.element_id % 2 = 0 AND b.element_id % 2 = 1 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)", "boxes_v")
def table_band_cells(src: Source) -> DataFrame:
    b = src.boxes().withColumnRenamed("doc_id", "table_id")
    return P.band_cells(b.where("element_id % 2 = 0").withColumn("row", F.col("element_id")), b.where("element_id % 2 = 1").withColumn("col", F.col("element_id")), ["table_id"])


@query(f"WITH g AS ({_CELLS.format('boxes_v')}) SELECT b.element_id, b.x0, b.y0, greatest(b.x1, coalesce(g.x1 - 2, b.x1)) AS x1, greatest(b.y1, coalesce(g.y1 - 2, b.y1)) AS y1 FROM boxes_v b LEFT JOIN g ON g.doc_id = b.doc_id AND g.page = b.page AND g.cell = b.element_id % 20", "boxes_v")
def cell_extend(src: Source) -> DataFrame:
    b = src.boxes().withColumn("cell", F.col("element_id") % 20)
    return P.extend_cells(b, _grid(src, src.boxes()), ["doc_id", "page", "cell"]).select("element_id", "x0", "y0", "x1", "y1")


@query(
    f"""WITH g AS ({_CELLS.format("spans_v")}), h AS (SELECT s.doc_id, s.page, s.span_id, s.text, s.x0, s.y0, s.x1, s.y1, arg_min({{'r': g.row, 'c': g.col, 'x': g.x1, 'y': g.y1}}, g.cell) AS k FROM spans_v s JOIN g ON g.doc_id = s.doc_id AND g.page = s.page
      WHERE trim(s.text) <> '' AND (s.x0 + s.x1) / 2 BETWEEN g.x0 AND g.x1 AND (s.y0 + s.y1) / 2 BETWEEN g.y0 AND g.y1 GROUP BY ALL),
    l AS (SELECT doc_id, page, k.r AS row, k.c AS col, round_even(y0 / 3, 0) AS ln, trim(string_agg(text, '' ORDER BY x0, span_id)) AS t, max(k.x) AS gx, max(k.y) AS gy, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM h GROUP BY ALL)
    SELECT doc_id, page, row, col, string_agg(t, ' ' ORDER BY ln) AS content, min(x0) AS x0, min(y0) AS y0, greatest(max(x1), max(gx) - 2) AS x1, greatest(max(y1), max(gy) - 2) AS y1 FROM l GROUP BY doc_id, page, row, col""",
    "spans_v",
)
def cell_rebuild(src: Source) -> DataFrame:
    return P.rebuild_cells(src.spans(), _grid(src, src.spans()))


@query(
    """WITH t AS (SELECT element_id AS table_id, doc_id, page, ['lines_strict', 'lines', 'text'][element_id % 3 + 1] AS strategy, element_id % 3 AS r, element_id % 7 <> 0 AS sane FROM boxes_v), k AS (SELECT * FROM t WHERE r = 0 OR sane)
    SELECT table_id, strategy FROM (SELECT *, min(r) OVER (PARTITION BY doc_id, page) AS f FROM k) q WHERE r = f""",
    "boxes_v",
)
def table_detection_fallback(src: Source) -> DataFrame:
    t = src.boxes().select(F.col("element_id").alias("table_id"), "doc_id", "page", F.element_at(F.array(*[F.lit(s) for s in P.STRATEGIES]), (F.col("element_id") % 3 + 1).cast("int")).alias("strategy"))
    return P.first_detection(t, t.where("table_id % 7 <> 0")).select("table_id", "strategy")


_REGIONS = "SELECT doc_id, page, r.* FROM (SELECT DISTINCT doc_id, page FROM boxes_v) p, (VALUES (0, 0.5, 0.0, 0.95, 0.45, 0.9), (1, 0.02, 0.0, 0.45, 0.5, 0.8), (2, 0.06, 0.5, 0.5, 0.9, 0.5), (3, 0.5, 0.45, 1.0, 0.9, 0.41), (4, 0.0, 0.0, 1.0, 1.0, 0.3)) AS r(region, x0, y0, x1, y1, confidence)"
_REGION_ROWS = [(0, 0.5, 0.0, 0.95, 0.45, 0.9), (1, 0.02, 0.0, 0.45, 0.5, 0.8), (2, 0.06, 0.5, 0.5, 0.9, 0.5), (3, 0.5, 0.45, 1.0, 0.9, 0.41), (4, 0.0, 0.0, 1.0, 1.0, 0.3)]


@query(
    f"""WITH r AS (SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM ({_REGIONS}) q WHERE confidence >= 0.4), c AS (SELECT *, coalesce(cx - lag(cx) OVER (PARTITION BY doc_id, page ORDER BY cx, region) > 0.1, false) AS fresh FROM r),
    d AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id, page ORDER BY cx, region) AS col FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY col, cy, cx, region) AS place FROM d),
    m AS (SELECT b.element_id, o.place, greatest(least(b.x1, o.x1 * 600) - greatest(b.x0, o.x0 * 600), 0) * greatest(least(b.y1, o.y1 * 800) - greatest(b.y0, o.y0 * 800), 0) AS a FROM boxes_v b JOIN o ON o.doc_id = b.doc_id AND o.page = b.page),
    w AS (SELECT element_id, min(place) AS place FROM (SELECT *, max(a) OVER (PARTITION BY element_id) AS top FROM m WHERE a > 0) q WHERE a = top GROUP BY element_id)
    SELECT b.doc_id, b.page, b.element_id, row_number() OVER (PARTITION BY b.doc_id, b.page ORDER BY place IS NULL, place, b.y0, b.x0, b.element_id) - 1 AS reading_order FROM boxes_v b LEFT JOIN w USING (element_id)""",
    "boxes_v",
)
def reading_order_regions(src: Source) -> DataFrame:
    rows = src.spark.createDataFrame(_REGION_ROWS, "region int, x0 double, y0 double, x1 double, y1 double, confidence double")
    regions = src.boxes().select("doc_id", "page").distinct().crossJoin(F.broadcast(rows))  # five fixed rows
    return P.region_order(src.boxes(), regions, 600.0, 800.0).select("doc_id", "page", "element_id", "reading_order")


@query("SELECT doc_id, element_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, CASE WHEN element_id % 4 = 0 THEN 999999 ELSE element_id % 3 END, y0, x0, element_id) - 1 AS reading_order FROM boxes_v", "boxes_v")
def reading_order_document(src: Source) -> DataFrame:
    own = src.boxes().withColumn("reading_order", F.when(F.col("element_id") % 4 != 0, F.col("element_id") % 3))
    return P.resequence(own).select("doc_id", "element_id", "reading_order")


_SEEN = "CASE conv_id % 4 WHEN 0 THEN concat('x ', upper(text), ' y') WHEN 1 THEN substr(text, 1, 5) WHEN 2 THEN text ELSE '' END"
_RES = f"SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS page, text AS content, {_SEEN} AS rendered FROM conversations"
_FOLD = "replace(replace(lower(trim(regexp_replace(coalesce({0}, ''), '[\\s\\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss'), 'ſ', 's')"
_RESIDUAL = f"SELECT doc_id, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM ({_RES}) r WHERE {_FOLD.format('content')} <> '' AND contains({_FOLD.format('rendered')}, {_FOLD.format('content')}) GROUP BY doc_id"


def _rendered(src: Source) -> DataFrame:
    return src.table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("page"), F.col("text").alias("content"), F.expr(_SEEN).alias("rendered"))


@query(_RESIDUAL)
def residual_pages(src: Source) -> DataFrame:
    return P.residual(_rendered(src)).select("doc_id", F.array_join("pages", ",").alias("pages"))


@query(f"WITH a AS (SELECT conv_id AS doc_id, CAST(turn AS BIGINT) AS page FROM conversations WHERE conv_id % 3 = 0 AND turn < 2), b AS (SELECT doc_id, CAST(unnest(string_split(pages, ',')) AS BIGINT) AS page FROM ({_RESIDUAL}) r), u AS (SELECT doc_id, page, 'biou' AS s FROM a UNION ALL SELECT doc_id, page, 'residual' FROM b) SELECT doc_id, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages, array_to_string(list_sort(list(DISTINCT s)), ',') AS signals FROM u GROUP BY doc_id")
def affected_pages(src: Source) -> DataFrame:
    regressed = src.table("conversations").where("conv_id % 3 = 0 and turn < 2").groupBy(F.col("conv_id").alias("doc_id")).agg(F.collect_set(F.col("turn").cast("long")).alias("pages"))
    return P.affected(regressed, P.residual(_rendered(src))).select("doc_id", F.array_join("pages", ",").alias("pages"), F.array_join("signals", ",").alias("signals"))


@query(f"SELECT element_id, drawn, drawn IS NULL AS missing FROM (SELECT element_id, CASE WHEN element_id % 9 = 0 THEN concat('over ', content) WHEN coalesce(translated, content) <> content THEN translated END AS drawn FROM ({_TYPED}) t) u", "boxes_v")
def overlay_choice(src: Source) -> DataFrame:
    placed = _typed(src).withColumn("text", F.coalesce("translated", "content"))
    said = _typed(src).where("element_id % 9 = 0").select(F.col("content").alias("source"), F.concat(F.lit("over "), "content").alias("value"))
    return P.overlay(placed, said).select("element_id", "drawn", "missing")


_BLOCKS = "SELECT conv_id AS doc_id, concat('chat', conv_id) AS stem, turn AS seq, text AS value, concat('docx:chat', conv_id, ':', row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS block_id FROM conversations"


@query(f"SELECT doc_id, block_id, CASE WHEN seq % 2 = 1 THEN concat('new ', block_id) ELSE value END AS value, seq % 2 = 1 AS overridden FROM ({_BLOCKS}) b")
def block_overrides(src: Source) -> DataFrame:
    blocks = src.table("conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("chat"), F.col("conv_id").cast("string")).alias("stem"), F.col("turn").alias("seq"), F.col("text").alias("value"))
    none = src.spark.createDataFrame([], "block_id string, value string")
    new = P.override(blocks, none, "docx").where("seq % 2 = 1").select("block_id", F.concat(F.lit("new "), "block_id").alias("value"))
    return P.override(blocks, new, "docx").select("doc_id", "block_id", "value", "overridden")


@query("SELECT doc_id, page FROM boxes_v WHERE should_translate UNION SELECT doc_id, page FROM rendered_v WHERE truncated", "boxes_v", "rendered_v")
def page_numbers(src: Source) -> DataFrame:
    return P.page_numbers(src.boxes().where("should_translate"), src.rendered().where("truncated"))


@query(
    f"""WITH e AS (SELECT *, coalesce(page <> lag(page) OVER (PARTITION BY doc_id ORDER BY page, element_id), true) AS fresh FROM ({_TYPED}) t),
    x AS (SELECT doc_id, page, element_id, 0 AS p, 'heading' AS kind, concat('-- Page ', page, ' --') AS line FROM e WHERE fresh
      UNION ALL SELECT doc_id, page, element_id, 1, 'source', concat(CASE element_type WHEN 'header' THEN '[Header] ' WHEN 'table_cell' THEN '[Table] ' ELSE '' END, content) FROM e
      UNION ALL SELECT doc_id, page, element_id, 2, 'German', coalesce(translated, concat('[No translation|German] ', content)) FROM e)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, element_id, p) - 1 AS pos, kind, line FROM x""",
    "boxes_v",
)
def page_listing(src: Source) -> DataFrame:
    e = _typed(src).withColumn("seq", F.struct("page", "element_id")).withColumn("translated", F.create_map(F.lit("German"), F.col("translated")))
    return P.listing(e, ["German"])


@query(
    """WITH v AS (SELECT DISTINCT table_id, CAST(row * 3 + col AS DOUBLE) AS x FROM cells_v), s AS (SELECT table_id, x, row_number() OVER (PARTITION BY table_id ORDER BY x) - 1 AS i FROM v WHERE CAST(x AS BIGINT) % 3 = 0)
    SELECT v.table_id, v.x, min(s.i) AS index FROM v LEFT JOIN s ON s.table_id = v.table_id AND abs(v.x - s.x) <= 2 GROUP BY ALL""",
    "cells_v",
)
def grid_index(src: Source) -> DataFrame:
    """Coordinates three apart, so that clusters start at each third."""
    v = src.cells().select("table_id", (F.col("row") * 3 + F.col("col")).cast("double").alias("x")).distinct()
    from ..operators import layout as L

    return P.grid_index(v, L.cluster_axis(v, ["table_id"], "x", 2.0), ["table_id"], "x")
