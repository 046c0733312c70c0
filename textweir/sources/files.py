"""File scans: HTML pages, Office containers and plain files, as one row per element.

Container formats are parsed in Arrow batches from ``binaryFile`` rows, so any
store Spark reads will do; a parser is a function from bytes to rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT_TYPES = ["text", "title", "header", "footer", "table_cell", "list_item", "caption", "footnote", "table", "figure", "formula", "list"]
SUPPORTED = [".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".pdf"]
TAG_TYPES = {"h1": "title", "h2": "title", "h3": "title", "p": "text", "li": "list_item", "td": "table_cell", "th": "table_cell", "figcaption": "caption"}
SKIPPED_TAGS = {"nav", "footer", "script", "style", "head"}
ELEMENTS = "seq long, element_type string, content string, style string, table_id long, row long, col long"


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str]] = []
        self.skip, self.open, self.text = 0, [], []

    def _close(self) -> None:
        said = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if self.open and said:
            self.rows.append((self.open[-1], said))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED_TAGS:
            self.skip += 1
        elif tag in TAG_TYPES and not self.skip:
            self._close()
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED_TAGS:
            self.skip = max(0, self.skip - 1)
        elif tag in self.open and not self.skip:
            self._close()
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.open and not self.skip:
            self.text.append(data)


def parse_html(html: str | None) -> list[tuple[str, str]]:
    """(tag, text) of a page's titles, paragraphs, list items and cells, in order; navigation, footer, script and style are left out."""
    p = _Elements()
    p.feed(html or "")
    p.close()
    p._close()
    return p.rows


def html_elements(pages: DataFrame) -> DataFrame:
    """page_id, seq, tag, element_type, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, tag, TAG_TYPES[tag], text) for i, html in zip(pdf["page_id"], pdf["html"]) for k, (tag, text) in enumerate(parse_html(html))]
            yield pd.DataFrame(rows, columns=["page_id", "seq", "tag", "element_type", "content"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, seq long, tag string, element_type string, content string")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_D = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
#: English Metric Units in a point.
EMU = 12_700
#: Depth to which tables in cells, and shapes in groups, are walked on their own; what lies deeper is flattened.
NESTING = 3


def _word_text(node) -> str:
    return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))


def _word_parts(raw: bytes) -> Iterator[tuple[str, ElementTree.Element]]:
    """The body, then headers, then footers."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        yield "text", ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        for kind in ("header", "footer"):
            for n in sorted(n for n in z.namelist() if re.match(rf"word/{kind}\d*\.xml$", n)):
                yield kind, ElementTree.fromstring(z.read(n))


def _own_paragraphs(cell) -> list:
    """A cell's paragraphs, those of content controls included, without those of tables in it."""
    out = []
    for x in cell:
        if x.tag == f"{_W}p":
            out.append(x)
        elif x.tag == f"{_W}sdt" and (inner := x.find(f"{_W}sdtContent")) is not None:
            out += _own_paragraphs(inner)
    return out


def _without_boxes(p):
    """Text of a paragraph, its text boxes left out, which are elements of their own."""
    skip = {t for box in p.iter(f"{_W}txbxContent") for t in box.iter()}
    return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br") and t not in skip)


def parse_docx(raw: bytes) -> list[tuple]:
    """Paragraphs and cells of the body, headers, footers, then text boxes, each box once; a nested table's text stays with its cell."""
    rows: list[tuple] = []
    boxes: list[tuple] = []
    tables = 0

    def of(x, kind: str) -> tuple[str, str]:
        style = x.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        return "title" if re.match(r"(?i)title|heading", name) else "list_item" if x.find(f"{_W}pPr/{_W}numPr") is not None or re.match(r"(?i)list", name) else kind, name

    def walk(node, kind: str) -> None:
        nonlocal tables
        for x in node:
            if x.tag == f"{_W}p":
                named, name = of(x, kind)
                if said := _without_boxes(x).strip():
                    rows.append((named, said, name, None, None, None))
            elif x.tag == f"{_W}tbl":
                me, tables = tables, tables + 1
                for r, tr in enumerate(x.findall(f"{_W}tr")):
                    for c, tc in enumerate(tr.findall(f"{_W}tc")):
                        rows.append(("table_cell", "\n".join(s for p in tc.iter(f"{_W}p") if (s := _without_boxes(p).strip())), "", me, r, c))
            elif x.tag == f"{_W}sdt":
                if (inner := x.find(f"{_W}sdtContent")) is not None:
                    walk(inner, kind)

    def in_boxes(node, kind: str) -> None:
        # A box may be written twice, for readers old and new: the fallback repeats it.
        old = {b for f in node.iter(f"{_D}Fallback") for b in f.iter(f"{_W}txbxContent")}
        for box in node.iter(f"{_W}txbxContent"):
            if box not in old:
                for p in box.iter(f"{_W}p"):
                    if said := _word_text(p).strip():
                        boxes.append((of(p, kind)[0], said, "textbox", None, None, None))

    for kind, part in _word_parts(raw):
        walk(part, kind)
        in_boxes(part, kind)
    return rows + boxes


def docx_segments(raw: bytes) -> list[tuple]:
    """(kind, text, context, table_id, row, col) as they are translated: paragraphs in place, every table its own group.

    A vertically merged cell counts once, a wide one takes its columns. A cell
    as wide as its table that holds tables is a frame: its paragraphs are
    paragraphs and it stays as an empty cell. Tables in cells are groups of
    their own down to ``NESTING``; the text of deeper ones joins their cell's.
    """
    rows: list[tuple] = []
    tables = 0

    def paragraph(p, context: str) -> None:
        if (said := _word_text(p)).strip():
            rows.append(("para", said, context, None, None, None))

    def flat(table) -> str:
        return "\n".join(s for tc in table.iter(f"{_W}tc") for p in _own_paragraphs(tc) if (s := _word_text(p)).strip())

    def span(tc) -> int:
        wide = tc.find(f"{_W}tcPr/{_W}gridSpan")
        return int(wide.get(f"{_W}val", "1")) if wide is not None else 1

    def table(t, context: str, depth: int) -> None:
        nonlocal tables
        tables += 1
        me, wide = tables, max((sum(map(span, tr.findall(f"{_W}tc"))) for tr in t.findall(f"{_W}tr")), default=0)
        for r, tr in enumerate(t.findall(f"{_W}tr")):
            c = 0
            for tc in tr.findall(f"{_W}tc"):
                at, c = c, c + span(tc)
                merged = tc.find(f"{_W}tcPr/{_W}vMerge")
                if merged is not None and merged.get(f"{_W}val") != "restart":
                    continue
                here, inner = f"{context} > Tbl(r{r},c{at})", tc.findall(f"{_W}tbl")
                deeper = "\n".join(filter(None, map(flat, inner))) if depth >= NESTING else ""
                if inner and span(tc) == wide:
                    for p in _own_paragraphs(tc):
                        paragraph(p, here)
                    own = ""
                else:
                    own = "\n".join(s for p in _own_paragraphs(tc) if (s := _word_text(p)).strip())
                rows.append(("cell", "\n".join(filter(None, (own, deeper))), here, me, r, at))
                if depth < NESTING:
                    for x in inner:
                        table(x, f"{here} > Nested", depth + 1)

    def walk(node, context: str) -> None:
        for x in node:
            if x.tag == f"{_W}p":
                paragraph(x, context)
            elif x.tag == f"{_W}tbl":
                table(x, context, 1)
            elif x.tag == f"{_W}sdt" and (inner := x.find(f"{_W}sdtContent")) is not None:
                walk(inner, context)

    for kind, part in _word_parts(raw):
        walk(part, {"text": "Body", "header": "Header", "footer": "Footer"}[kind])
    return rows


def _slides(z: zipfile.ZipFile) -> list[str]:
    return sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def _shape_box(shape) -> tuple:
    """x0, y0, x1, y1 of a shape in points, nulls if it states none."""
    for path in (f"{_P}spPr/{_A}xfrm", f"{_P}xfrm"):
        if (x := shape.find(path)) is not None and (off := x.find(f"{_A}off")) is not None and (ext := x.find(f"{_A}ext")) is not None:
            x0, y0 = int(off.get("x", 0)) / EMU, int(off.get("y", 0)) / EMU
            return x0, y0, x0 + int(ext.get("cx", 0)) / EMU, y0 + int(ext.get("cy", 0)) / EMU
    return None, None, None, None


def parse_pptx(raw: bytes, boxes: bool = False) -> list[tuple]:
    """Text frames and table cells of each slide in order, groups included; style names the slide. With ``boxes``, each shape's in points as well."""
    rows: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        tables = 0
        for number, n in enumerate(_slides(z), 1):
            for shape in ElementTree.fromstring(z.read(n)).iter():
                box = _shape_box(shape) if boxes and shape.tag in (f"{_P}sp", f"{_P}graphicFrame") else ()
                if shape.tag == f"{_P}sp":
                    ph, named = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph"), shape.find(f"{_P}nvSpPr/{_P}cNvPr")
                    kind = {"title": "title", "ctrTitle": "title", "subTitle": "title", "ftr": "footer", "hdr": "header"}.get(ph.get("type", "") if ph is not None else "")
                    kind = kind or ("title" if named is not None and named.get("name", "").lower().startswith("title") else "text")
                    for p in shape.iter(f"{_A}p"):
                        if said := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip():
                            rows.append((kind, said, f"slide {number}", None, None, None, *box))
                elif shape.tag == f"{_P}graphicFrame" and (t := next(shape.iter(f"{_A}tbl"), None)) is not None:
                    me, tables = tables, tables + 1
                    for r, tr in enumerate(t.findall(f"{_A}tr")):
                        for c, tc in enumerate(tr.findall(f"{_A}tc")):
                            rows.append(("table_cell", "\n".join("".join(x.text or "" for x in p.iter(f"{_A}t")) for p in tc.iter(f"{_A}p")), f"slide {number}", me, r, c, *box))
    return rows


def pptx_segments(raw: bytes) -> tuple[list[tuple], list[str]]:
    """(kind, text, where, table_id, row, col) as they are translated, and warnings: frames and cells of each slide, then the texts of diagrams.

    Groups are walked to a depth of ``NESTING``; what lies deeper comes all the
    same, with one warning.
    """
    rows: list[tuple] = []
    warnings: list[str] = []
    tables = 0

    def lines(body) -> str:
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in body.iter(f"{_A}p")).strip()

    def leaf(shape, where: str) -> None:
        nonlocal tables
        if (t := next(shape.iter(f"{_A}tbl"), None)) is not None:
            tables += 1
            rows.extend(("table_cell", said, where, tables, r, c) for r, tr in enumerate(t.findall(f"{_A}tr")) for c, tc in enumerate(tr.findall(f"{_A}tc")) if (said := lines(tc)))
        elif (body := shape.find(f"{_P}txBody")) is not None and (said := lines(body)):
            rows.append(("text_frame", said, where, None, None, None))

    def walk(tree, where: str, depth: int) -> None:
        for shape in tree:
            if shape.tag == f"{_P}grpSp":
                if depth == NESTING and not warnings:
                    warnings.append(f"groups deeper than {NESTING} are flattened")
                walk(shape, where, depth + 1)
            elif shape.tag in (f"{_P}sp", f"{_P}graphicFrame"):
                leaf(shape, where)

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for number, n in enumerate(_slides(z), 1):
            if (tree := ElementTree.fromstring(z.read(n)).find(f"{_P}cSld/{_P}spTree")) is not None:
                walk(tree, f"slide {number}", 0)
        for n in sorted(n for n in z.namelist() if n.startswith("ppt/diagrams/data") and n.endswith(".xml")):
            try:
                texts = [t.text.strip() for t in ElementTree.fromstring(z.read(n)).iter(f"{_A}t") if t.text and t.text.strip()]
            except ElementTree.ParseError:  # a broken diagram has no texts
                continue
            rows.extend(("smartart", said, f"{n}#{i}", None, None, None) for i, said in enumerate(texts))
    return rows, warnings


def parse_xlsx(raw: bytes) -> list[tuple]:
    """Cells of each sheet; a formula counts by its cached value, and only if that is text."""
    rows: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        sheets = sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for k, n in enumerate(sheets):
            for c in ElementTree.fromstring(z.read(n)).iter(f"{_S}c"):
                kind, value, formula = c.get("t", "n"), c.find(f"{_S}v"), c.find(f"{_S}f")
                said = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else shared[int(value.text)] if kind == "s" and value is not None else value.text if value is not None else ""
                if formula is not None and kind != "str":
                    continue
                letters, digits = re.match(r"([A-Z]+)(\d+)", c.get("r", "A1")).groups()
                col = 0
                for x in letters:
                    col = col * 26 + ord(x) - 64
                if said:
                    rows.append(("table_cell", said, "formula" if formula is not None else "", k, int(digits) - 1, col - 1))
    return rows


SEGMENTS = "seq long, kind string, text string, context string, table_id long, row long, col long"


def office_segments(spark: SparkSession, path: str) -> DataFrame:
    """path, error and segments of every .docx and .pptx file under ``path``, as they are translated."""
    walkers = {".docx": docx_segments, ".pptx": lambda raw: pptx_segments(raw)[0]}
    return _scan(spark, path, walkers, SEGMENTS)


PARSERS: dict[str, Callable[[bytes], list[tuple]]] = {".docx": parse_docx, ".pptx": parse_pptx, ".xlsx": parse_xlsx}


def register_parser(ending: str, parse: Callable[[bytes], list[tuple]]) -> None:
    """Have files of an ending read by ``parse``, from a file's bytes to its elements without their numbers."""
    PARSERS[ending.lower()] = parse


def office_elements(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[tuple]]] | None = None) -> DataFrame:
    """path, error and elements of every supported file under ``path``; a file that can't be parsed gives one row with its error."""
    return _scan(spark, path, parsers or PARSERS, ELEMENTS)


def _scan(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], list[tuple]]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    whole = [c.split()[0] for c in schema.split(", ") if c.endswith(" long")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(p, None, k, *e) for k, e in enumerate(parsers["." + p.rsplit(".", 1)[-1].lower()](bytes(raw)))]
                except Exception as e:  # a broken file is data, not a failed job
                    rows.append((p, f"{type(e).__name__}: {e}", *[None] * len(names)))
            yield pd.DataFrame(rows, columns=["path", "error", *names]).astype({c: "Int64" for c in whole})

    ends = "|".join(re.escape(x) for x in parsers)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(f"({ends})$"))
    return found.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def converted(spark: SparkSession, path: str, convert: Callable[[str, bytes], bytes | None]) -> DataFrame:
    """path, content of older files (.doc, .xls, .ppt) made into the newer kind by an external program behind ``convert``; null content where it failed."""
    newer = {".doc": ".docx", ".xls": ".xlsx", ".ppt": ".pptx"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = ["." + p.rsplit(".", 1)[-1].lower() for p in pdf["path"]]
            yield pd.DataFrame({"path": [p[: -len(e)] + newer[e] for p, e in zip(pdf["path"], ends)], "content": [convert(e, bytes(raw)) for e, raw in zip(ends, pdf["content"])]})

    old = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(doc|xls|ppt)$"))
    return old.select("path", "content").mapInPandas(run, "path string, content binary")


def supported(path: Column) -> Column:
    """Whether a path's ending is one that is read."""
    return F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1))).isin(SUPPORTED) & F.contains(path, F.lit("."))


def docx_of(lines: list[tuple[str, str]]) -> bytes:
    """A plain .docx of (kind, text) lines in order; headings are styled, all else is a paragraph."""
    from xml.sax.saxutils import escape

    def one(kind: str, text: str) -> str:
        style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' if kind in ("heading", "title") else ""
        runs = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(part)}</w:t>' for part in text.split("\n"))
        return f"<w:p>{style}<w:r>{runs}</w:r></w:p>"

    body = "".join(one(k, re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", t or "")) for k, t in lines)
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (
            ("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{main}"/></Types>'),
            ("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
            ("word/document.xml", f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>'),
        ):
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def render_docx(lines: DataFrame) -> DataFrame:
    """doc_id, content: a .docx of each document's lines (doc_id, pos, kind, line); a document is one value."""

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf.sort_values("pos", kind="stable")
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "content": [docx_of(list(zip(mine["kind"], mine["line"])))]})

    return lines.select("doc_id", "pos", "kind", "line").groupBy("doc_id").applyInPandas(render, "doc_id long, content binary")


def zip_outputs(outputs: DataFrame) -> DataFrame:
    """job_id, archive of rows (job_id, name, content): a job's files by name, packed; a job's outputs have to fit one value."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(pdf["name"], pdf["content"])):
                z.writestr(zipfile.ZipInfo(name), bytes(content))
        return pd.DataFrame({"job_id": [pdf["job_id"].iloc[0]], "archive": [held.getvalue()]})

    return outputs.select("job_id", "name", "content").groupBy("job_id").applyInPandas(pack, "job_id long, archive binary")


def write_benchmark(rows: DataFrame, path: str) -> None:
    """A benchmark's rows as CSV with a header and as JSON lines."""
    rows.write.option("header", True).csv(f"{path}/csv")
    rows.write.json(f"{path}/json")


TERM_SCHEMA = "source_text string, target_text string, source_lang string, target_lang string, domain string, context_snippet string, confidence double, usage_count long, status string"


def read_terms(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Terms of a JSON file (a list, or an object with ``terms``) or a CSV file with a header, with import defaults."""
    from ..operators.terms import import_defaults

    if kind == "csv":
        return import_defaults(spark.read.option("header", True).csv(path).transform(_typed))
    raw = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.terms"), "array<string>"))
    entry = raw.select(F.explode(items).alias("t")).where(F.col("t").rlike(r"^\s*\{"))
    return import_defaults(entry.select(F.from_json("t", TERM_SCHEMA).alias("t")).select("t.*"))


def _typed(df: DataFrame) -> DataFrame:
    kinds = dict(p.split(" ") for p in TERM_SCHEMA.split(", "))
    return df.select(*[F.expr(f"try_cast(`{c}` as {kinds[c]})").alias(c) for c in df.columns if c in kinds])


def write_terms(terms: DataFrame, path: str, kind: str) -> None:
    """Terms by id: one JSON-lines or CSV file set, or a folder per target language."""
    cols = [c.split(" ")[0] for c in TERM_SCHEMA.split(", ") if c.split(" ")[0] in terms.columns]
    ordered = terms.orderBy("id").select(*cols)
    if kind == "json":
        ordered.write.json(path)
    elif kind == "csv":
        ordered.write.option("header", True).csv(path)
    else:
        ordered.write.partitionBy("target_lang").option("header", True).csv(path)
