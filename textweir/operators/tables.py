"""Tables as cells (table_id, row, col, content): grids, parsing, replies by coordinate, spreadsheet layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def grid(cells: DataFrame, cell: Column, between: str) -> DataFrame:
    """table_id and text: rows a line, cells ``between``; a place without a cell is empty, of two cells in one place the greater counts."""
    said = cells.groupBy("table_id", "row", "col").agg(F.max(cell).alias("v"))
    shape = said.groupBy("table_id").agg(F.max("row").alias("r"), F.max("col").alias("c"))
    zero = F.lit(0).cast("long")
    places = shape.select("table_id", "c", F.explode(F.sequence(zero, F.col("r"))).alias("row")).select("table_id", "row", F.explode(F.sequence(zero, F.col("c"))).alias("col"))
    filled = places.join(said, ["table_id", "row", "col"], "left").withColumn("v", F.coalesce("v", F.lit("")))
    lines = filled.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("l")).select("table_id", "row", F.array_join("l.v", between).alias("line"))
    return lines.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("g")).select("table_id", F.array_join("g.line", "\n").alias("grid"))


def pipe_cell(content: Column) -> Column:
    return F.replace(F.replace(F.coalesce(content, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def parse_grid(text: Column, rows: Column, cols: Column) -> Column:
    """array<array<string>> of a pipe grid, null where its shape isn't ``rows`` by ``cols``. Ruled lines and lines without a pipe are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("|")) & ~(T.strip(x).rlike(r"(?U)^[|\-:\s]+$") & F.contains(x, F.lit("-"))))
    cells = F.transform(lines, lambda x: F.transform(F.split(x, r"(?<!\\)\|"), lambda c: T.strip(F.replace(c, F.lit("\\|"), F.lit("|")))))
    return F.when((F.size(cells) == rows) & F.forall(cells, lambda r: F.size(r) == cols), cells)


def cell_route(content: Column) -> Column:
    """Where a cell goes: empty ones are skipped, numbers pass through, the rest is translated."""
    return F.when(T.strip(F.coalesce(content, F.lit(""))) == "", "skipped").when(T.is_numeric_cell(content), "passthrough").otherwise("translate")


REPLY = "struct<cells:array<struct<row:string,col:string,content:string>>>"


def reply_cells(replies: DataFrame) -> DataFrame:
    """table_id, row, col, content of JSON replies; coordinates that aren't whole numbers are dropped, of duplicates the last counts."""
    cells = replies.select("table_id", F.posexplode(F.from_json("reply", REPLY)["cells"]).alias("p", "c"))
    whole = cells.where(F.col("c.row").rlike(r"^-?\d+$") & F.col("c.col").rlike(r"^-?\d+$") & F.col("c.content").isNotNull())
    return whole.groupBy("table_id", F.col("c.row").cast("long").alias("row"), F.col("c.col").cast("long").alias("col")).agg(F.max_by("c.content", "p").alias("reply"))


def remap(sent: DataFrame, replied: DataFrame) -> DataFrame:
    """Sent cells with their replies by coordinate; a table is rejected as a whole if one is missing or all are echoes."""
    j = sent.join(replied, ["table_id", "row", "col"], "left")
    w = W.partitionBy("table_id")
    ok = F.bool_and(F.col("reply").isNotNull()).over(w) & ~F.bool_and(F.coalesce(F.col("reply") == F.col("content"), F.lit(False))).over(w)
    return j.withColumn("accepted", ok).withColumn("value", F.when(F.col("accepted"), F.col("reply")))


def labelled_rows(cells: DataFrame) -> DataFrame:
    """Spreadsheet rows as text: the first row with content names the columns, later cells become ``name: value``."""
    filled = cells.withColumn("content", T.strip(F.coalesce("content", F.lit("")))).withColumn("_any", F.max(F.col("content") != "").over(W.partitionBy("table_id", "row")))
    head_row = F.min(F.when(F.col("_any"), F.col("row"))).over(W.partitionBy("table_id"))
    named = filled.withColumn("_h", head_row)
    named = named.withColumn("_name", F.max(F.when(F.col("row") == F.col("_h"), F.col("content"))).over(W.partitionBy("table_id", "col")))
    bare = (F.col("row") == F.col("_h")) | (F.coalesce("_name", F.lit("")) == "") | (F.col("_name") == F.col("content"))
    text = F.when(bare, F.col("content")).otherwise(F.concat("_name", F.lit(": "), "content"))
    return named.where((F.col("content") != "") & (F.col("row") >= F.col("_h"))).groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", text.alias("t")))).alias("l")).select("table_id", "row", F.array_join("l.t", " | ").alias("line"))


def write_rows(rows: DataFrame, mode: str) -> DataFrame:
    """Rows (.., source, value) as written: append keeps the source above the translations, replace drops it; others stand beside."""
    joined = F.concat_ws("\n", "source", "value")
    out = {"append": joined, "replace": F.coalesce("value", "source"), "bilingual": F.when(T.normalize(F.col("source")) == T.normalize(F.col("value")), F.col("source")).otherwise(joined), "annotation": F.col("source"), "adjacent": F.col("source")}[mode]
    return rows.withColumn("written", out).withColumn("note", F.col("value") if mode == "annotation" else F.lit(None).cast("string"))


def adjacent(cells: DataFrame) -> DataFrame:
    """Each translation as many columns to the right as its sheet is wide."""
    return cells.withColumn("target_col", F.col("col") + F.max("col").over(W.partitionBy("table_id")) + 1)


def missing_cells(sent: DataFrame, replied: DataFrame) -> DataFrame:
    """table_id, row, col of cells that were sent and have no reply."""
    return sent.select("table_id", "row", "col").join(replied.select("table_id", "row", "col"), ["table_id", "row", "col"], "left_anti")


def write_shapes(rows: DataFrame, mode: str) -> DataFrame:
    """Slides' texts (kind, source, values: an ordered array, null where one is missing) as written: below the source, or instead of it by the first; a diagram's in one line behind it. Texts that aren't fully translated, or already end so, stay."""
    full = F.col("values").isNotNull() & F.forall("values", lambda v: v.isNotNull())
    tail = F.array_join("values", "\n")
    append = F.when(F.endswith(F.col("source"), F.concat(F.lit("\n"), tail)), F.col("source")).otherwise(F.concat_ws("\n", "source", tail))
    diagram = F.concat_ws("\n", "source", F.array_join("values", " / "))
    shape = F.get("values", F.lit(0)) if mode == "replace" else append
    return rows.withColumn("written", F.when(~full, F.col("source")).when(F.col("kind") == "smartart", diagram).otherwise(shape))
