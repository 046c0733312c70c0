"""Page geometry: overlap, reading order, nearest neighbours, placements and fidelity.

Every spatial join has (doc_id, page) as equi-key, so it is a hash or sort-merge
join with a residual condition, never a nested loop over all boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import fold_sorted

BOX = ["x0", "y0", "x1", "y1"]
PAGE_KEY = ["doc_id", "page"]


def area(x0, y0, x1, y1) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Overlap of two boxes whose columns are prefixed ``a`` and ``b``."""
    c = lambda p, n: F.col(f"{p}{n}")
    return area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))


def iou(a: str, b: str) -> Column:
    both = overlap(a, b)
    union = area(*[F.col(f"{a}{n}") for n in BOX]) + area(*[F.col(f"{b}{n}") for n in BOX]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def distance(a: str, b: str) -> Column:
    """The least distance of two boxes, 0 where they touch or overlap."""
    c = lambda p, n: F.col(f"{p}{n}")
    gap = lambda lo, hi: F.greatest(c(b, lo) - c(a, hi), c(a, lo) - c(b, hi), F.lit(0.0))
    return F.sqrt(F.pow(gap("x0", "x1"), F.lit(2.0)) + F.pow(gap("y0", "y1"), F.lit(2.0)))


def contains(outer: str, inner: str, tolerance: float = 0.0) -> Column:
    c = lambda p, n: F.col(f"{p}{n}")
    return (c(inner, "x0") >= c(outer, "x0") - tolerance) & (c(inner, "y0") >= c(outer, "y0") - tolerance) & (c(inner, "x1") <= c(outer, "x1") + tolerance) & (c(inner, "y1") <= c(outer, "y1") + tolerance)


def upright(df: DataFrame, height: Column) -> DataFrame:
    """Boxes measured from a page's bottom, as measured from its top; ends in order on both axes."""
    y0, y1 = height - F.col("y1"), height - F.col("y0")
    return df.withColumns({"x0": F.least("x0", "x1"), "x1": F.greatest("x0", "x1"), "y0": F.least(y0, y1), "y1": F.greatest(y0, y1)})


def prefixed(df: DataFrame, p: str, *keep: str) -> DataFrame:
    return df.select(*PAGE_KEY, *[F.col(k).alias(f"{p}{k}") for k in (*keep, *BOX)])


def best_iou(source: DataFrame, rendered: DataFrame) -> DataFrame:
    """Each source box with its best overlap among the page's rendered boxes; 0 where the page has none."""
    j = prefixed(source, "a_", "element_id").join(prefixed(rendered, "b_"), PAGE_KEY, "left")
    return j.groupBy(*PAGE_KEY, F.col("a_element_id").alias("element_id")).agg(F.coalesce(F.max(iou("a_", "b_")), F.lit(0.0)).alias("best"))


def steady_mean(c: str) -> Column:
    """Mean of values from 0 to 1 by an exact sum that is rounded once, so the order of rows doesn't decide on which side of a limit it falls."""
    scaled = F.col(c) * float(1 << 30)
    high = F.floor(scaled)
    low = F.floor((scaled - high) * float(1 << 40))
    return (F.sum(high) * 2.0**-30 + F.sum(low) * 2.0**-70) / F.count(c)


def fidelity(best: DataFrame, floor: float = 0.8, page_cap: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """Mean overlap by page (pages of more boxes than the cap, if there is one, aren't scored), and by document with its regressed pages."""
    pages = best.groupBy(*PAGE_KEY).agg(steady_mean("best").alias("biou"), F.count("*").alias("boxes"))
    if page_cap is not None:
        pages = pages.where(F.col("boxes") <= page_cap)
    docs = best.select("doc_id").distinct().join(pages.groupBy("doc_id").agg(steady_mean("biou").alias("m"), F.array_sort(F.collect_list(F.when(F.col("biou") < floor, F.col("page")))).alias("r")), "doc_id", "left")
    return pages, docs.select("doc_id", F.coalesce("m", F.lit(1.0)).alias("mean_biou"), F.coalesce("r", F.array().cast("array<bigint>")).alias("regressed"))


def region_of(boxes: DataFrame, regions: DataFrame, least: float = 0.4) -> DataFrame:
    """Each box with the region of enough confidence it overlaps most; of equals the first."""
    r = regions.where(F.col("confidence") >= least).select(*PAGE_KEY, "region", "label", F.col("ry0").alias("b_y0"), F.col("ry1").alias("b_y1"), F.lit(-1e9).alias("b_x0"), F.lit(1e9).alias("b_x1"))
    j = prefixed(boxes, "a_", "element_id").join(r, PAGE_KEY).withColumn("o", overlap("a_", "b_")).where("o > 0")
    best = j.groupBy(*PAGE_KEY, F.col("a_element_id").alias("element_id")).agg(F.min(F.struct((-F.col("o")).alias("n"), "region", "label")).alias("b"))
    return boxes.join(best, [*PAGE_KEY, "element_id"], "left").select(*PAGE_KEY, "element_id", F.col("b.region").alias("region"), F.col("b.label").alias("label"))


def inside(boxes: DataFrame, tables: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Boxes that lie in a table's box, with the first such table."""
    j = prefixed(boxes, "a_", "element_id").join(prefixed(tables, "b_", "table_id"), PAGE_KEY)
    inn = (F.col("a_x0") >= F.col("b_x0") - tolerance) & (F.col("a_y0") >= F.col("b_y0") - tolerance) & (F.col("a_x1") <= F.col("b_x1") + tolerance) & (F.col("a_y1") <= F.col("b_y1") + tolerance)
    return j.where(inn).groupBy(*PAGE_KEY, F.col("a_element_id").alias("element_id")).agg(F.min("b_table_id").alias("table_id"))


def centre_cell(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """The first cell, in cell order, that holds a box's centre."""
    j = prefixed(boxes, "a_", "element_id").join(prefixed(cells, "b_", "cell"), PAGE_KEY)
    cx, cy = (F.col("a_x0") + F.col("a_x1")) / 2, (F.col("a_y0") + F.col("a_y1")) / 2
    return j.where(cx.between(F.col("b_x0"), F.col("b_x1")) & cy.between(F.col("b_y0"), F.col("b_y1"))).groupBy(*PAGE_KEY, F.col("a_element_id").alias("element_id")).agg(F.min("b_cell").alias("cell"))


def whitespace_below(boxes: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Room under each box down to the nearest box below that shares some of its x-range, or the page's end."""
    j = prefixed(boxes, "a_", "element_id").join(prefixed(boxes, "b_", "element_id"), PAGE_KEY)
    below = j.where((F.col("a_element_id") != F.col("b_element_id")) & (F.col("b_y0") >= F.col("a_y1") - 0.01) & (F.col("b_x0") < F.col("a_x1")) & (F.col("b_x1") > F.col("a_x0")))
    near = below.groupBy(*PAGE_KEY, F.col("a_element_id").alias("element_id")).agg(F.min("b_y0").alias("n"))
    return boxes.join(near, [*PAGE_KEY, "element_id"], "left").select(*PAGE_KEY, "element_id", F.greatest(F.coalesce("n", F.lit(page_height)) - F.col("y1"), F.lit(0.0)).alias("below"))


def coarse_order(boxes: DataFrame) -> DataFrame:
    """Reading order by page, lines of ten points (half to even), then x; ties by input order."""
    w = W.partitionBy("doc_id").orderBy("page", F.bround(F.col("y0") / 10) * 10, "x0", "element_id")
    return boxes.withColumn("reading_order", (F.row_number().over(w) - 1).cast("long"))


def column_order(boxes: DataFrame, gap: float = 50.0) -> DataFrame:
    """Reading order by columns: x-centres further apart than ``gap`` from the one before begin a column; then y."""
    c = boxes.withColumn("_c", (F.col("x0") + F.col("x1")) / 2)
    w = W.partitionBy(*PAGE_KEY).orderBy("_c", "element_id")
    c = c.withColumn("_new", F.coalesce((F.col("_c") - F.lag("_c").over(w) > gap).cast("int"), F.lit(0)))
    c = c.withColumn("column", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    return c.withColumn("reading_order", (F.row_number().over(W.partitionBy(*PAGE_KEY).orderBy("column", "y0", "x0", "element_id")) - 1).cast("long")).drop("_c", "_new")


def visual_lines(boxes: DataFrame, size: float = 3.0) -> DataFrame:
    """Boxes that share a line of ``size`` points (half to even), joined from left to right with their union box."""
    line = F.bround(F.col("y0") / size)
    return boxes.groupBy(*PAGE_KEY, line.cast("long").alias("line")).agg(F.array_sort(F.collect_list(F.struct("x0", "element_id"))).alias("e"), *[(F.min if n in ("x0", "y0") else F.max)(n).alias(f"u{n}") for n in BOX]).select(*PAGE_KEY, "line", F.col("e.element_id").alias("elements"), *[f"u{n}" for n in BOX])


def cluster_axis(values: DataFrame, key: list[str], value: str, tolerance: float = 2.0) -> DataFrame:
    """key, start: sorted values open a cluster where they pass its start, not the value before, by more than the tolerance."""
    sorted_ = F.array_sort(F.collect_set(value))
    fold = lambda a, v: F.when((F.size(a) == 0) | (v - F.element_at(a, -1) > tolerance), F.concat(a, F.array(v))).otherwise(a)
    starts = values.groupBy(*key).agg(sorted_.alias("_v")).select(*key, F.aggregate("_v", F.array().cast("array<double>"), fold).alias("_s"))
    return starts.select(*key, F.explode("_s").alias("start"))


def placements(boxes: DataFrame, page_height: float = 792.0) -> DataFrame:
    """What is drawn: translatable elements with a box, in reading order, each with the room below."""
    kept = boxes.where("should_translate and x0 is not null")
    room = whitespace_below(kept, page_height)
    return coarse_order(kept).join(room, [*PAGE_KEY, "element_id"]).select("doc_id", "page", "element_id", "reading_order", *BOX, "below")


def side_by_side(placed: DataFrame, width: float) -> DataFrame:
    """Source at its place and translation a page's width to the right."""
    right = placed.withColumns({"x0": F.col("x0") + width, "x1": F.col("x1") + width})
    return placed.withColumn("side", F.lit("source")).unionByName(right.withColumn("side", F.lit("translation")))


def whitening(lines: DataFrame, inset: float = 0.5) -> DataFrame:
    """Rectangles that cover source lines, shrunk on every side; those thinner than a point are left out."""
    r = lines.withColumns({"x0": F.col("x0") + inset, "y0": F.col("y0") + inset, "x1": F.col("x1") - inset, "y1": F.col("y1") - inset})
    return r.where((F.col("x1") - F.col("x0") >= 1) & (F.col("y1") - F.col("y0") >= 1))


def truncation(boxes: DataFrame) -> DataFrame:
    """Per document: truncated boxes, all boxes, their ratio, overflow area and the pages concerned."""
    t = F.col("truncated")
    return boxes.groupBy("doc_id").agg(F.count_if(t).alias("truncated"), F.count("*").alias("total"), F.sum(F.when(t, area(*[F.col(n) for n in BOX])).otherwise(0.0)).alias("overflow"), F.array_sort(F.collect_set(F.when(t, F.col("page")))).alias("pages")).withColumn("ratio", F.when(F.col("total") == 0, 0.0).otherwise(F.col("truncated") / F.col("total")))


def header_footer(boxes: DataFrame, height: float, margin: float = 50.0) -> DataFrame:
    return boxes.withColumn("zone", F.when(F.col("y0") < margin, "header").when(F.col("y1") > height - margin, "footer").otherwise("body"))


def grow_rows(rows: DataFrame, budget: float) -> DataFrame:
    """Row growth per table: each row takes what it needs of the budget left, later rows shift by what earlier ones took."""

    def step(state: tuple, need: float) -> tuple:
        growth, shift, left = state
        take = min(max(need, 0.0), left)
        return take, shift + growth, left - take

    sized = rows.select("table_id", "row", F.coalesce(F.col("need").cast("double"), F.lit(0.0)).alias("need"))
    return fold_sorted(sized, "table_id", "row", ["need"], lambda: (0.0, 0.0, budget), step, "growth double, shift double")


def sane_tables(cells: DataFrame) -> DataFrame:
    """Tables of at least two rows and columns whose every cell is wider than 2 points and at least 8 high."""
    g = cells.groupBy("table_id").agg(F.count_distinct("row").alias("rows"), F.count_distinct("col").alias("cols"), F.min(F.col("x1") - F.col("x0")).alias("w"), F.min(F.col("y1") - F.col("y0")).alias("h"))
    return g.where("rows >= 2 and cols >= 2 and w > 2 and h >= 8").select("table_id", "rows", "cols")
