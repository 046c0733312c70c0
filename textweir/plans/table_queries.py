"""Queries on table cells, spreadsheet layouts and scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables as O
from ..sources import files
from ..sources.views import Source
from .registry import query

_GRID = "SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS grid FROM (SELECT table_id, row, string_agg({cell}, '{sep}' ORDER BY col) AS line FROM cells_v GROUP BY ALL) r GROUP BY table_id"
_BAR = "CASE WHEN col = 1 THEN replace(content, '-', '|') ELSE content END"
_PIPE = f"replace(replace({_BAR}, '|', '\\|'), chr(10), ' ')"


@query(_GRID.format(cell=_PIPE, sep=" | "), "cells_v")
def table_grid_serialize(src: Source) -> DataFrame:
    return O.grid(src.cells().withColumn("content", F.expr(_BAR)), O.pipe_cell(F.col("content")), " | ")


@query(
    """WITH s AS (SELECT table_id, max(row) + 1 AS n, count(*) AS cells FROM cells_v GROUP BY table_id)
    SELECT table_id, n AS n_rows, table_id % 5 <> 0 AS accepted, CASE WHEN table_id % 5 <> 0 THEN (SELECT max(trim(replace(content, '-', '|'))) FROM cells_v c WHERE c.table_id = s.table_id AND c.col = 1 AND c.row = 0) END AS first_cell FROM s""",
    "cells_v",
)
def table_parse_check(src: Source) -> DataFrame:
    """Grids, ruled below the first row and with one row lost in every fifth table, parsed again."""
    cells = src.cells().withColumn("content", F.expr(_BAR))
    grids = O.grid(cells, O.pipe_cell(F.col("content")), " | ").join(cells.groupBy("table_id").agg((F.max("row") + 1).alias("n_rows")), "table_id")
    broken = F.when(F.col("table_id") % 5 == 0, F.concat("grid", F.lit("\nlost | row"))).otherwise(F.regexp_replace("grid", r"\n", "\n--- | --- | --- | ---\n"))
    parsed = grids.withColumn("p", O.parse_grid(broken, F.col("n_rows"), F.lit(4)))
    return parsed.select("table_id", "n_rows", F.col("p").isNotNull().alias("accepted"), F.get(F.get("p", F.lit(0)), F.lit(1)).alias("first_cell"))


@query(
    r"""SELECT table_id, row, col, content, CASE WHEN table_id % 7 IN (0, 1) THEN false ELSE true END AS accepted,
    CASE WHEN table_id % 7 IN (0, 1) THEN NULL WHEN row = 0 AND col = 0 THEN content ELSE concat('<', content, '>') END AS value FROM cells_v""",
    "cells_v",
)
def table_reply_remap(src: Source) -> DataFrame:
    """Replies by coordinate: every seventh lacks a cell, the next echoes all, all have an extra and a duplicate cell."""
    cells = src.cells()
    said = F.when(F.col("table_id") % 7 == 1, F.col("content")).when((F.col("row") == 0) & (F.col("col") == 0), F.col("content")).otherwise(F.concat(F.lit("<"), "content", F.lit(">")))
    sent = cells.where(~((F.col("table_id") % 7 == 0) & (F.col("row") == 0) & (F.col("col") == 1)))
    one = F.struct(F.col("row").cast("string").alias("row"), F.col("col").cast("string").alias("col"), said.alias("content"))
    odd = F.array(F.struct(F.lit("999").alias("row"), F.lit("0").alias("col"), F.lit("extra").alias("content")), F.struct(F.lit("true").alias("row"), F.lit("0").alias("col"), F.lit("no").alias("content")), F.struct(F.lit("0").alias("row"), F.lit("2").alias("col"), F.lit("first").alias("content")))
    replies = sent.groupBy("table_id").agg(F.concat(odd, F.array_sort(F.collect_list(one))).alias("cells")).select("table_id", F.to_json(F.struct("cells")).alias("reply"))
    return O.remap(cells, O.reply_cells(replies)).select("table_id", "row", "col", "content", "accepted", "value")


@query(_GRID.format(cell="CASE WHEN col IN (1, 3) AND content <> '' THEN concat('<', content, '>') ELSE content END", sep="' || chr(9) || '"), "cells_v")
def table_tsv(src: Source) -> DataFrame:
    done = F.when(O.cell_route(F.col("content")) == "translate", F.when(F.col("col").isin(1, 3), F.concat(F.lit("<"), "content", F.lit(">"))).otherwise(F.col("content"))).otherwise(F.col("content"))
    return O.grid(src.cells(), done, "\t")


@query("SELECT table_id, count(*) FILTER (WHERE content = '') AS skipped, count(*) FILTER (WHERE content <> '' AND regexp_matches(content, '^[0-9., /%-]+$') AND regexp_matches(content, '[0-9]')) AS passthrough, count(*) FILTER (WHERE content <> '' AND NOT regexp_matches(content, '^[0-9., /%-]+$')) AS translate FROM cells_v GROUP BY table_id", "cells_v")
def table_cell_routes(src: Source) -> DataFrame:
    route = O.cell_route(F.col("content"))
    return src.cells().groupBy("table_id").agg(*[F.count_if(route == r).alias(r) for r in ("skipped", "passthrough", "translate")])


@query("SELECT table_id, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols FROM cells_v GROUP BY table_id", "cells_v")
def table_shape(src: Source) -> DataFrame:
    return src.cells().groupBy("table_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


@query("SELECT table_id, row, col, col + max(col) OVER (PARTITION BY table_id) + 1 AS target_col, content FROM cells_v", "cells_v")
def xlsx_adjacent_columns(src: Source) -> DataFrame:
    return O.adjacent(src.cells()).select("table_id", "row", "col", "target_col", "content")


@query("""WITH h AS (SELECT table_id, col, content AS name FROM cells_v WHERE row = 0)
SELECT c.table_id, c.row, string_agg(CASE WHEN c.row = 0 OR name = '' OR name = content THEN content ELSE concat(name, ': ', content) END, ' | ' ORDER BY c.col) AS line FROM cells_v c JOIN h ON h.table_id = c.table_id AND h.col = c.col WHERE content <> '' GROUP BY ALL""", "cells_v")  # fmt: skip
def xlsx_row_labels(src: Source) -> DataFrame:
    return O.labelled_rows(src.cells())


for _mode, _sql in {"append": "concat_ws(chr(10), text, value)", "replace": "coalesce(value, text)", "bilingual": "CASE WHEN lower(text) = lower(value) THEN text ELSE concat_ws(chr(10), text, value) END"}.items():
    query(f"SELECT doc_id, seq, {_sql} AS written FROM tmap_v", "tmap_v", name=f"write_mode_{_mode}")(
        lambda src, m=_mode: O.write_rows(src.tmap().withColumnRenamed("text", "source"), m).select("doc_id", "seq", "written")
    )


@query()
def page_elements(src: Source) -> DataFrame:
    """Elements of HTML pages by a parser; the tests hold it against literal pages."""
    return files.html_elements(src.table("pages").select("page_id", "html"))


@query("SELECT page_id, length(trim(html)) < 10 AS needs_ocr FROM pages")
def ocr_route(src: Source) -> DataFrame:
    return src.table("pages").select("page_id", (F.length(T.strip(F.coalesce("html", F.lit("")))) < 10).alias("needs_ocr"))


@query("SELECT conv_id, round(sum(length(text)) / greatest(count(*), 1), 6) AS per_page, sum(length(text)) / greatest(count(*), 1) >= 20 AS has_text_layer FROM conversations GROUP BY conv_id")
def text_layer(src: Source) -> DataFrame:
    rate = F.sum(F.length("text")) / F.greatest(F.count("*"), F.lit(1))
    return src.table("conversations").groupBy("conv_id").agg(F.round(rate, 6).alias("per_page"), (rate >= 20).alias("has_text_layer"))


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN sum(length(text)) > 40000 THEN 'long' ELSE 'short' END AS path FROM documents GROUP BY doc_id")
def long_document_path(src: Source) -> DataFrame:
    return src.table("documents").groupBy("doc_id").agg(F.when(F.sum(F.length("text")) > 40_000, "long").otherwise("short").alias("path"))


@query("SELECT table_id, row, col FROM cells_v WHERE row % 2 = 1 AND col = 3", "cells_v")
def table_missing_cells(src: Source) -> DataFrame:
    return O.missing_cells(src.cells(), src.cells().where("not (row % 2 = 1 and col = 3)"))


_SHAPES = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'smartart' WHEN 1 THEN 'text_frame' ELSE 'table_cell' END AS kind, CASE WHEN turn % 4 = 1 THEN concat(text, chr(10), 'a', chr(10), 'b') ELSE text END AS source, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'b' END AS b FROM conversations"


def _shapes(src: Source) -> DataFrame:
    t = F.col("turn")
    return src.table("conversations").select(
        "conv_id", "turn", F.when(t % 3 == 0, "smartart").when(t % 3 == 1, "text_frame").otherwise("table_cell").alias("kind"),
        F.when(t % 4 == 1, F.concat("text", F.lit("\na\nb"))).otherwise(F.col("text")).alias("source"), F.array(F.lit("a"), F.when(F.col("conv_id") % 3 != 0, "b")).alias("values"),
    )


for _mode, _sql in {"append": "CASE WHEN ends_with(source, chr(10) || 'a' || chr(10) || 'b') THEN source ELSE concat(source, chr(10), 'a', chr(10), 'b') END", "replace": "'a'"}.items():
    query(f"SELECT conv_id, turn, CASE WHEN b IS NULL THEN source WHEN kind = 'smartart' THEN concat(source, chr(10), 'a / b') ELSE {_sql} END AS written FROM ({_SHAPES}) s", name=f"slide_write_{_mode}")(
        lambda src, m=_mode: O.write_shapes(_shapes(src), m).select("conv_id", "turn", "written")
    )


@query("SELECT p_partkey, path, regexp_matches(lower(path), '\\.(docx|doc|pptx|ppt|xlsx|xls|pdf)$') AS ok FROM (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, concat('a/b.c', p_partkey, ['.DOCX', '.txt', '.pdf', '', '.doc'][p_partkey % 5 + 1]) AS path FROM part) p")
def supported_files(src: Source) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(x) for x in (".DOCX", ".txt", ".pdf", "", ".doc")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = src.table("part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.concat(F.lit("a/b.c"), F.col("p_partkey").cast("string"), end).alias("path"))
    return p.withColumn("ok", files.supported(F.col("path")))
