"""Queries on page geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout as L
from ..sources.views import Source
from .registry import query


def _ov(a: str, b: str) -> str:
    return f"greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0)"


def _ar(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


_IOU = f"{_ov('a', 'b')} / ({_ar('a')} + {_ar('b')} - {_ov('a', 'b')})"
_BEST = f"SELECT a.doc_id, a.page, a.element_id, max({_IOU}) AS best FROM boxes_v a JOIN rendered_v b ON a.doc_id = b.doc_id AND a.page = b.page GROUP BY ALL"


def _best(src: Source) -> DataFrame:
    return L.best_iou(src.boxes(), src.rendered())


@query(f"SELECT doc_id, page, element_id, round(best, 6) AS best FROM ({_BEST}) t", "boxes_v", "rendered_v")
def iou_pairs(src: Source) -> DataFrame:
    return _best(src).select("doc_id", "page", "element_id", F.round("best", 6).alias("best"))


@query(f"SELECT doc_id, page, round(avg(best), 6) AS biou, count(*) AS boxes FROM ({_BEST}) t GROUP BY ALL", "boxes_v", "rendered_v")
def biou_by_page(src: Source) -> DataFrame:
    return L.fidelity(_best(src), page_cap=None)[0].select("doc_id", "page", F.round("biou", 6).alias("biou"), "boxes")


@query(f"SELECT doc_id, round(avg(biou), 6) AS mean_biou, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (WHERE biou < 0.8), '') AS regressed FROM (SELECT doc_id, page, avg(best) AS biou FROM ({_BEST}) t GROUP BY ALL) p GROUP BY doc_id", "boxes_v", "rendered_v")
def layout_qa(src: Source) -> DataFrame:
    return L.fidelity(_best(src), page_cap=None)[1].select("doc_id", F.round("mean_biou", 6).alias("mean_biou"), F.array_join("regressed", ",").alias("regressed"))


@query(
    """SELECT b.doc_id, b.page, b.element_id, r.region, r.label FROM boxes_v b LEFT JOIN (SELECT a.element_id, r.region, r.label, row_number() OVER (PARTITION BY a.element_id ORDER BY (a.x1 - a.x0) * greatest(least(a.y1, r.ry1) - greatest(a.y0, r.ry0), 0) DESC, r.region) AS n
    FROM boxes_v a JOIN regions_v r ON a.doc_id = r.doc_id AND a.page = r.page WHERE r.confidence >= 0.4 AND least(a.y1, r.ry1) > greatest(a.y0, r.ry0)) r ON r.element_id = b.element_id AND n = 1""",
    "boxes_v", "regions_v",
)
def region_argmax(src: Source) -> DataFrame:
    return L.region_of(src.boxes(), src.regions())


_TABLES = "SELECT element_id AS table_id, doc_id, page, x0 - 40 AS x0, y0 - 60 AS y0, x1 + 60 AS x1, y1 + 80 AS y1 FROM boxes_v WHERE element_id % 4 = 0"


def _tables(src: Source) -> DataFrame:
    t = src.boxes().where("element_id % 4 = 0")
    return t.select("doc_id", "page", F.col("element_id").alias("table_id"), (F.col("x0") - 40).alias("x0"), (F.col("y0") - 60).alias("y0"), (F.col("x1") + 60).alias("x1"), (F.col("y1") + 80).alias("y1"))


@query(f"WITH t AS ({_TABLES}) SELECT b.doc_id, b.page, b.element_id, min(t.table_id) AS table_id FROM boxes_v b JOIN t ON b.doc_id = t.doc_id AND b.page = t.page AND b.x0 >= t.x0 - 5 AND b.y0 >= t.y0 - 5 AND b.x1 <= t.x1 + 5 AND b.y1 <= t.y1 + 5 GROUP BY ALL", "boxes_v")
def inside_table(src: Source) -> DataFrame:
    return L.inside(src.boxes(), _tables(src))


@query(f"WITH t AS ({_TABLES}) SELECT b.doc_id, b.page, b.element_id, min(t.table_id) AS cell FROM boxes_v b JOIN t ON b.doc_id = t.doc_id AND b.page = t.page AND (b.x0 + b.x1) / 2 BETWEEN t.x0 AND t.x1 AND (b.y0 + b.y1) / 2 BETWEEN t.y0 AND t.y1 GROUP BY ALL", "boxes_v")
def centre_in_cell(src: Source) -> DataFrame:
    return L.centre_cell(src.boxes(), _tables(src).withColumnRenamed("table_id", "cell"))


_BELOW = "SELECT a.doc_id, a.page, a.element_id, greatest(coalesce(min(b.y0), 792.0) - any_value(a.y1), 0.0) AS below FROM {0} a LEFT JOIN {0} b ON a.doc_id = b.doc_id AND a.page = b.page AND a.element_id <> b.element_id AND b.y0 >= a.y1 - 0.01 AND b.x0 < a.x1 AND b.x1 > a.x0 GROUP BY ALL"


@query(_BELOW.format("boxes_v"), "boxes_v")
def whitespace_below(src: Source) -> DataFrame:
    return L.whitespace_below(src.boxes())


_COARSE = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, round_even(y0 / 10, 0) * 10, x0, element_id) - 1 AS BIGINT)"


@query(f"SELECT doc_id, page, element_id, {_COARSE} AS reading_order FROM boxes_v", "boxes_v")
def reading_order_coarse(src: Source) -> DataFrame:
    return L.coarse_order(src.boxes()).select("doc_id", "page", "element_id", "reading_order")


@query(
    """WITH c AS (SELECT *, (x0 + x1) / 2 AS c FROM boxes_v), n AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY doc_id, page ORDER BY c, element_id) > 50 THEN 1 ELSE 0 END AS f FROM c),
    k AS (SELECT *, CAST(sum(f) OVER (PARTITION BY doc_id, page ORDER BY c, element_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "column" FROM n)
    SELECT doc_id, page, element_id, "column", CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY "column", y0, x0, element_id) - 1 AS BIGINT) AS reading_order FROM k""",
    "boxes_v",
)
def reading_order_columns(src: Source) -> DataFrame:
    return L.column_order(src.boxes()).select("doc_id", "page", "element_id", "column", "reading_order")


@query("SELECT doc_id, page, CAST(round_even(y0 / 3, 0) AS BIGINT) AS line, string_agg(CAST(element_id AS VARCHAR), ',' ORDER BY x0, element_id) AS elements, min(x0) AS ux0, min(y0) AS uy0, max(x1) AS ux1, max(y1) AS uy1 FROM boxes_v GROUP BY ALL", "boxes_v")
def visual_lines(src: Source) -> DataFrame:
    return L.visual_lines(src.boxes()).withColumn("elements", F.array_join(F.transform("elements", lambda e: e.cast("string")), ","))


@query()
def cluster_axis(src: Source) -> DataFrame:
    """Start of each x-cluster of a document's boxes; held against a plain fold in the tests."""
    return L.cluster_axis(src.boxes(), ["doc_id"], "x0", 12.0)


_KEPT = "(SELECT * FROM boxes_v WHERE should_translate)"
_PLACED = f"SELECT p.doc_id, p.page, p.element_id, p.reading_order, p.x0, p.y0, p.x1, p.y1, w.below FROM (SELECT *, {_COARSE} AS reading_order FROM {_KEPT} k) p JOIN ({_BELOW.format(_KEPT)}) w USING (element_id)"


@query(_PLACED, "boxes_v")
def placements(src: Source) -> DataFrame:
    return L.placements(src.boxes())


@query(f"WITH p AS ({_PLACED}) SELECT element_id, side, x0 + s AS x0, y0, x1 + s AS x1, y1 FROM p, (VALUES ('source', 0.0::DOUBLE), ('translation', 612.0::DOUBLE)) AS v(side, s)", "boxes_v")
def side_by_side(src: Source) -> DataFrame:
    return L.side_by_side(L.placements(src.boxes()), 612.0).select("element_id", "side", "x0", "y0", "x1", "y1")


@query("SELECT element_id, x0 + 0.5 AS x0, y0 + 0.5 AS y0, x1 - 0.5 AS x1, y1 - 0.5 AS y1 FROM boxes_v WHERE x1 - x0 - 1 >= 1 AND y1 - y0 - 1 >= 1", "boxes_v")
def whitening_rects(src: Source) -> DataFrame:
    return L.whitening(src.boxes()).select("element_id", *L.BOX)


@query("SELECT doc_id, count(*) FILTER (WHERE truncated) AS truncated, count(*) AS total, coalesce(sum((x1 - x0) * (y1 - y0)) FILTER (WHERE truncated), 0.0) AS overflow, coalesce(string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) FILTER (WHERE truncated), '') AS pages, round(count(*) FILTER (WHERE truncated) / count(*), 6) AS ratio FROM boxes_v GROUP BY doc_id", "boxes_v")
def truncation_rate(src: Source) -> DataFrame:
    return L.truncation(src.boxes()).select("doc_id", "truncated", "total", "overflow", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.round("ratio", 6).alias("ratio"))


@query("SELECT doc_id, CASE WHEN y0 < 50 THEN 'header' WHEN y1 > 742 THEN 'footer' ELSE 'body' END AS zone, count(*) AS n FROM boxes_v GROUP BY ALL", "boxes_v")
def header_footer_zones(src: Source) -> DataFrame:
    return L.header_footer(src.boxes(), 792.0).groupBy("doc_id", "zone").agg(F.count("*").alias("n"))


@query("SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM boxes_v GROUP BY ALL HAVING count(*) >= 2", "boxes_v")
def union_boxes(src: Source) -> DataFrame:
    return src.boxes().groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n")).where("n >= 2")


@query(
    """SELECT a.element_id, b.element_id AS other, round(sqrt(power(greatest(b.x0 - a.x1, a.x0 - b.x1, 0), 2) + power(greatest(b.y0 - a.y1, a.y0 - b.y1, 0), 2)), 6) AS distance, b.x0 >= a.x0 - 5 AND b.y0 >= a.y0 - 5 AND b.x1 <= a.x1 + 5 AND b.y1 <= a.y1 + 5 AS inside
    FROM boxes_v a JOIN rendered_v b ON a.doc_id = b.doc_id AND a.page = b.page""",
    "boxes_v", "rendered_v",
)
def box_distance(src: Source) -> DataFrame:
    j = L.prefixed(src.boxes(), "a_", "element_id").join(L.prefixed(src.rendered(), "b_", "element_id"), L.PAGE_KEY)
    return j.select(F.col("a_element_id").alias("element_id"), F.col("b_element_id").alias("other"), F.round(L.distance("a_", "b_"), 6).alias("distance"), L.contains("a_", "b_", 5.0).alias("inside"))


@query("SELECT element_id, x0, 800 - y1 AS y0, x1, 800 - y0 AS y1 FROM boxes_v", "boxes_v")
def boxes_upright(src: Source) -> DataFrame:
    turned = src.boxes().select("element_id", F.col("x1").alias("x0"), "y0", F.col("x0").alias("x1"), "y1")
    return L.upright(turned, F.lit(800.0)).select("element_id", "x0", "y0", "x1", "y1")
