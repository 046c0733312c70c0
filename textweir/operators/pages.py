"""From text spans to page elements, their grids, their order, and what of them is drawn or listed.

Spans are rows (doc_id, page, block, line, span, text, font, size, flags, color
and a box); a parser seam makes them, all else is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import BOX, PAGE_KEY, overlap, prefixed

# Fixed values.
REGION_CONFIDENCE, REGION_GAP, PAD, GRAZE = 0.4, 0.1, 2.0, 2.0
UNORDERED = 999_999
TAGS = {"header": "[Header] ", "footer": "[Footer] ", "table_cell": "[Table] "}
STRATEGIES = ["lines_strict", "lines", "text"]


def _union() -> list[Column]:
    return [(F.min if n in ("x0", "y0") else F.max)(n).alias(n) for n in BOX]


def text_blocks(spans: DataFrame, page_height: float = 792.0, margin: float = 50.0, least: int = 1, skip_zones: bool = True) -> DataFrame:
    """One element per block: stripped lines joined by spaces, union box, style of the first span with text, header and footer zones."""
    said = spans.where(F.coalesce("text", F.lit("")) != "")
    lines = said.groupBy(*PAGE_KEY, "block", "line").agg(F.array_sort(F.collect_list(F.struct("span", "text"))).alias("s"), F.min_by(F.struct("font", "size", "flags", "color"), "span").alias("style"), *_union())
    lines = lines.withColumn("t", T.strip(F.array_join("s.text", "")))
    blocks = lines.groupBy(*PAGE_KEY, "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("line", "t")))).alias("l"),
        F.min_by("style", "line").alias("style"),
        *[(F.min if n in ("x0", "y0") else F.max)(F.when(F.col("t") != "", F.col(n))).alias(n) for n in BOX],
    )
    bold, italic = T.font_flags(F.col("style.flags"))
    zone = F.when(F.col("y0") < margin, "header").when(F.col("y1") > page_height - margin, "footer").otherwise("text")
    out = blocks.withColumn("content", F.array_join("l.t", " ")).where(F.length("content") >= least)
    out = out.withColumn("element_type", zone)
    translated = (F.col("element_type") == "text") if skip_zones else F.lit(True)
    return out.select(*PAGE_KEY, "block", "content", "element_type", translated.alias("should_translate"), F.col("style.font").alias("font"), F.col("style.size").alias("size"), bold.alias("bold"), italic.alias("italic"), T.color_hex(F.col("style.color")).alias("color"), *BOX)


def page_texts(pages: DataFrame) -> DataFrame:
    """The fallback scan: a page's whole text, stripped; the first page of each distinct text, blank ones left out."""
    kept = pages.withColumn("content", T.strip(F.coalesce("text", F.lit("")))).where("content <> ''")
    return kept.groupBy("doc_id", "content").agg(F.min("page").alias("page"), F.count("*").alias("n"))


def pass_through(elements: DataFrame) -> DataFrame:
    """Formulas and figures aren't translated; a formula without a translation stands as it is."""
    formula = F.col("element_type") == "formula"
    return elements.withColumn("should_translate", F.col("should_translate") & ~F.col("element_type").isin("formula", "figure")).withColumn("translated", F.when(formula, F.coalesce("translated", "content")).otherwise(F.col("translated")))


def split_structured(elements: DataFrame, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tables with a recognised structure, all other elements)."""
    own = F.lit(enabled) & (F.col("element_type") == "table") & F.col("structured")
    return elements.where(own), elements.where(~own)


def table_groups(cells: DataFrame, least: int = 2) -> DataFrame:
    """Cells that have a table and a place in it, of tables with at least ``least`` of them."""
    placed = cells.where("table_id is not null and row is not null and col is not null")
    return placed.withColumn("_n", F.count("*").over(W.partitionBy("table_id"))).where(F.col("_n") >= least).drop("_n")


def grid_index(values: DataFrame, starts: DataFrame, key: list[str], value: str, tolerance: float = 2.0) -> DataFrame:
    """Adds index: the place of the first cluster start within the tolerance of ``value``, null if none."""
    numbered = starts.withColumn("_i", (F.row_number().over(W.partitionBy(*key).orderBy("start")) - 1).cast("long"))
    near = values.join(numbered, key).where(F.abs(F.col(value) - F.col("start")) <= tolerance)
    first = near.groupBy(*key, value).agg(F.min("_i").alias("index"))
    return values.join(first, [*key, value], "left")


def band_cells(rows: DataFrame, cols: DataFrame, key: list[str]) -> DataFrame:
    """Cells where a row band and a column band of one table intersect: row, col and the intersection."""
    a = rows.select(*key, "row", *[F.col(n).alias(f"a_{n}") for n in BOX])
    b = cols.select(*key, "col", *[F.col(n).alias(f"b_{n}") for n in BOX])
    box = {n: (F.greatest if n in ("x0", "y0") else F.least)(f"a_{n}", f"b_{n}") for n in BOX}
    met = a.join(b, key).select(*key, "row", "col", *[c.alias(n) for n, c in box.items()])
    return met.where("x1 > x0 and y1 > y0")


def spans_cells(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Elements that overlap two or more cells by over two points on both axes."""
    j = prefixed(boxes, "a_", "element_id").join(prefixed(cells, "b_", "cell"), PAGE_KEY)
    wide = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    tall = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    return j.where((wide > GRAZE) & (tall > GRAZE)).groupBy(*PAGE_KEY, F.col("a_element_id").alias("element_id")).agg(F.count("*").alias("cells")).where("cells > 1")


def extend_cells(elements: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """Right and bottom of each element's box moved out to its cell's, less two points; left and top stay."""
    rect = cells.select(*key, F.col("x1").alias("_x1"), F.col("y1").alias("_y1"))
    return elements.join(rect, key, "left").withColumns({"x1": F.greatest("x1", F.col("_x1") - PAD), "y1": F.greatest("y1", F.col("_y1") - PAD)}).drop("_x1", "_y1")


def rebuild_cells(spans: DataFrame, cells: DataFrame, least: int = 1) -> DataFrame:
    """Spans of merged row blocks dealt into the first cell that holds their centre, by visual lines: row, col, content, box."""
    s = spans.where(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("_cx", (F.col("x0") + F.col("x1")) / 2).withColumn("_cy", (F.col("y0") + F.col("y1")) / 2)
    c = cells.select(*PAGE_KEY, "row", "col", F.col("cell").alias("_cell"), *[F.col(n).alias(f"c_{n}") for n in BOX])
    held = s.join(c, PAGE_KEY).where(F.col("_cx").between(F.col("c_x0"), F.col("c_x1")) & F.col("_cy").between(F.col("c_y0"), F.col("c_y1")))
    dealt = held.groupBy(*PAGE_KEY, "span_id").agg(F.min_by(F.struct("row", "col", "text", *BOX, "c_x1", "c_y1"), "_cell").alias("b")).select(*PAGE_KEY, "span_id", "b.*")
    lines = dealt.groupBy(*PAGE_KEY, "row", "col", F.bround(F.col("y0") / 3).alias("_line")).agg(F.array_sort(F.collect_list(F.struct("x0", "span_id", "text"))).alias("s"), F.max("c_x1").alias("c_x1"), F.max("c_y1").alias("c_y1"), *_union())
    lines = lines.withColumn("t", T.strip(F.array_join("s.text", ""))).where("t <> ''")
    out = lines.groupBy(*PAGE_KEY, "row", "col").agg(F.array_sort(F.collect_list(F.struct("_line", "t"))).alias("l"), F.max("c_x1").alias("c_x1"), F.max("c_y1").alias("c_y1"), *_union())
    out = out.withColumn("content", F.array_join("l.t", " ")).where(F.length("content") >= least)
    return out.select(*PAGE_KEY, "row", "col", "content", "x0", "y0", F.greatest("x1", F.col("c_x1") - PAD).alias("x1"), F.greatest("y1", F.col("c_y1") - PAD).alias("y1"))


def first_detection(tables: DataFrame, sane: DataFrame) -> DataFrame:
    """Per page the tables of the first strategy that found any: strict ones as they are, looser ones only if sane (table_id in ``sane``)."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy"))
    judged = tables.withColumn("_r", rank).join(sane.select("table_id", F.lit(True).alias("_sane")), "table_id", "left")
    kept = judged.where((F.col("_r") == 1) | F.coalesce("_sane", F.lit(False)))
    return kept.withColumn("_f", F.min("_r").over(W.partitionBy(*PAGE_KEY))).where("_r = _f").drop("_r", "_f", "_sane")


def region_order(boxes: DataFrame, regions: DataFrame, width: float, height: float) -> DataFrame:
    """Reading order by detected regions (region, confidence, a box in shares of the page).

    Regions of enough confidence sorted by their centre's x begin a column where
    it lies over a tenth of the page from the one before; columns from the left,
    in each regions from the top. Elements follow the region they overlap most
    (of equals the first), then y and x; those in none come last.
    """
    r = regions.where(F.col("confidence") >= REGION_CONFIDENCE).withColumn("_cx", (F.col("x0") + F.col("x1")) / 2).withColumn("_cy", (F.col("y0") + F.col("y1")) / 2)
    by_x = W.partitionBy(*PAGE_KEY).orderBy("_cx", "region")
    r = r.withColumn("_new", F.coalesce((F.col("_cx") - F.lag("_cx").over(by_x) > REGION_GAP).cast("int"), F.lit(0)))
    r = r.withColumn("_col", F.sum("_new").over(by_x.rowsBetween(W.unboundedPreceding, 0)))
    r = r.withColumn("_at", F.row_number().over(W.partitionBy(*PAGE_KEY).orderBy("_col", "_cy", "_cx", "region")))
    scaled = r.select(*PAGE_KEY, F.col("_at").alias("b__at"), *[(F.col(n) * (width if n[0] == "x" else height)).alias(f"b_{n}") for n in BOX])
    met = prefixed(boxes, "a_", "element_id").join(scaled, PAGE_KEY).withColumn("o", overlap("a_", "b_")).where("o > 0")
    best = met.groupBy(*PAGE_KEY, F.col("a_element_id").alias("element_id")).agg(F.min(F.struct((-F.col("o")).alias("n"), F.col("b__at").alias("at"))).alias("b")).select(*PAGE_KEY, "element_id", F.col("b.at").alias("_at"))
    order = W.partitionBy(*PAGE_KEY).orderBy(F.col("_at").isNull(), "_at", "y0", "x0", "element_id")
    return boxes.join(best, [*PAGE_KEY, "element_id"], "left").withColumn("reading_order", (F.row_number().over(order) - 1).cast("long")).drop("_at")


def resequence(elements: DataFrame) -> DataFrame:
    """One sequence for a document from its pages' own: by page, order on the page (none: last), y, x."""
    order = W.partitionBy("doc_id").orderBy("page", F.coalesce("reading_order", F.lit(UNORDERED)), "y0", "x0", "element_id")
    return elements.withColumn("reading_order", (F.row_number().over(order) - 1).cast("long"))


def residual(elements: DataFrame) -> DataFrame:
    """doc_id, pages where an element's own source text, spaces and case aside, still stands in what was rendered in its box."""
    own, seen = T.folded(F.col("content")), T.folded(F.col("rendered"))
    return elements.where((own != "") & F.contains(seen, own)).groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def affected(regressed: DataFrame, residual_pages: DataFrame) -> DataFrame:
    """doc_id, pages, signals: the union of regressed and residual pages (doc_id, pages) of documents that have either."""
    j = regressed.select("doc_id", F.col("pages").alias("_a")).join(residual_pages.select("doc_id", F.col("pages").alias("_b")), "doc_id", "full")
    none = F.array().cast("array<bigint>")
    j = j.withColumns({"_a": F.coalesce("_a", none), "_b": F.coalesce("_b", none)})
    signals = F.concat(F.when(F.size("_a") > 0, F.array(F.lit("biou"))).otherwise(F.array().cast("array<string>")), F.when(F.size("_b") > 0, F.array(F.lit("residual"))).otherwise(F.array().cast("array<string>")))
    return j.select("doc_id", F.array_sort(F.array_union("_a", "_b")).alias("pages"), signals.alias("signals")).where(F.size("pages") > 0)


def overlay(placed: DataFrame, translations: DataFrame) -> DataFrame:
    """What is drawn over each placed element (content, text): the translation of its stripped content, else the placement's own text if that differs; else missing."""
    t = translations.select(F.col("source").alias("_k"), F.col("value").alias("_v")).dropDuplicates(["_k"])
    j = placed.withColumn("_k", T.strip(F.col("content"))).join(t, "_k", "left")
    said = F.coalesce("_v", F.when(F.col("text") != F.col("content"), F.col("text")))
    return j.withColumn("drawn", F.when(T.strip(F.coalesce(said, F.lit(""))) != "", said)).withColumn("missing", F.col("drawn").isNull()).drop("_k", "_v")


def override(blocks: DataFrame, overrides: DataFrame, ext: str, by_element: bool = False) -> DataFrame:
    """Blocks (doc_id, stem, seq, value) with revised values by positional id ``ext:stem:place``, or by element id: block_id, value, overridden."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("seq")) - 1
    named = blocks.withColumn("block_id", F.col("element_id").cast("string") if by_element else F.concat_ws(":", F.lit(ext), "stem", place.cast("string")))
    j = named.join(overrides.select("block_id", F.col("value").alias("_new")), "block_id", "left")
    return j.withColumn("overridden", F.col("_new").isNotNull()).withColumn("value", F.coalesce("_new", "value")).drop("_new")


def page_numbers(placed: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that hold a placement or exist."""
    return placed.select(*PAGE_KEY).union(pages.select(*PAGE_KEY)).distinct()


def listing(elements: DataFrame, targets: list[str]) -> DataFrame:
    """doc_id, pos, kind, line of a plain listing: a heading where the page changes, the element under its tag, a line per target.

    ``elements`` has doc_id, seq, page, element_type, content and translated, a
    map by target.
    """
    before = F.lag("page").over(W.partitionBy("doc_id").orderBy("seq"))
    own = T.strip(F.col("content"))
    tag = F.coalesce(F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])[F.col("element_type")], F.lit(""))
    line = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("line"))
    head = F.when(before.isNull() | (before != F.col("page")), F.array(line("heading", F.concat(F.lit("-- Page "), F.col("page").cast("string"), F.lit(" --"))))).otherwise(F.array().cast("array<struct<kind:string,line:string>>"))
    rest = F.array(line("source", F.concat(tag, own)), *[line(t, F.coalesce(F.col("translated")[t], F.concat(F.lit(f"[No translation|{t}] "), own))) for t in targets])
    laid = elements.select("doc_id", "seq", F.concat(head, rest).alias("l")).select("doc_id", "seq", F.posexplode("l").alias("p", "x"))
    return laid.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "p")) - 1).cast("long").alias("pos"), "x.kind", "x.line")
