import io
import zipfile

from textweir.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


DOCX = packed(word__document_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Hello </w:t><w:t>you</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>c2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>', word__header1_xml=f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>")
PPTX = packed(ppt__slides__slide1_xml=f'<p:sld {A}><p:cSld><p:spTree><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>T</a:t></a:r></a:p></p:txBody></p:sp><p:grpSp><p:sp><p:txBody><a:p><a:r><a:t>in group</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp></p:spTree></p:cSld></p:sld>')
XLSX = packed(xl__sharedStrings_xml=f"<sst {S}><si><t>one</t></si></sst>", xl__worksheets__sheet1_xml=f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>7</v></c><c r="C1"><f>A1</f><v>5</v></c><c r="D1" t="str"><f>A1</f><v>txt</v></c></row></sheetData></worksheet>')


def test_parsers():
    assert [(r[0], r[1]) for r in files.parse_docx(DOCX)] == [("title", "Top"), ("text", "Hello you"), ("table_cell", "c1"), ("table_cell", "c2"), ("header", "Head")]
    assert [(r[0], r[1]) for r in files.parse_pptx(PPTX)] == [("title", "T"), ("text", "in group")]
    assert [(r[1], r[4], r[5]) for r in files.parse_xlsx(XLSX)] == [("one", 0, 0), ("7", 1, 27), ("txt", 0, 3)]


def test_html():
    page = "<html><head><title>x</title></head><nav><p>no</p></nav><h1>Big &amp; bold</h1><p>a <b>b</b>\n c<li>item</ul><script>p('</p>')</script><footer>end</footer>"
    assert files.parse_html(page) == [("h1", "Big & bold"), ("p", "a b c"), ("li", "item")]
    assert files.parse_html(None) == []


def test_office_scan_keeps_broken_files_as_rows(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.XLSX").write_bytes(XLSX)
    (tmp_path / "c.pptx").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"other")
    rows = files.office_elements(spark, f"file://{tmp_path}").collect()
    assert len([r for r in rows if r.error]) == 1 and len(rows) == 5 + 3 + 1


def test_term_files_round_trip(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"version": 1, "terms": [{"source_text": "a", "target_text": "b", "target_lang": "vi"}, 5, {"source_text": "c", "target_text": "d", "target_lang": "vi", "status": "rejected", "confidence": 0.5}]}')
    got = {r.source_text: r for r in files.read_terms(spark, f"file://{tmp_path}/t.json", "json").collect()}
    assert (got["a"].status, got["a"].confidence, got["a"].domain) == ("approved", 1.0, "general") and got["c"].status == "rejected"
    df = spark.createDataFrame([(2, "x", "y", "en", "vi", "d", 0.5, 3, "approved"), (1, "q", "r", "en", "de", "d", 0.25, 1, "rejected")], "id long, source_text string, target_text string, source_lang string, target_lang string, domain string, confidence double, usage_count long, status string")
    files.write_terms(df, f"file://{tmp_path}/out", "csv")
    back = files.read_terms(spark, f"file://{tmp_path}/out", "csv")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.select(*back.columns).collect())


def cell(text, inner="", props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{para(text) if text else ''}{inner}</w:tc>"


def para(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def grid(*rows):
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in rows) + "</w:tbl>"


def document(body):
    return packed(word__document_xml=f'<w:document {W} xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>{body}</w:body></w:document>', word__footer1_xml=f"<w:ftr {W}>{para('foot')}</w:ftr>")


def test_text_boxes_come_once_and_last():
    box = f"<w:txbxContent>{para('boxed')}</w:txbxContent>"
    raw = document(f"<w:p><w:r><w:t>body</w:t></w:r><mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback></mc:AlternateContent></w:p>")
    assert [(r[0], r[1], r[2]) for r in files.parse_docx(raw)] == [("text", "body", ""), ("footer", "foot", ""), ("text", "boxed", "textbox")]


def test_tables_in_tables():
    deep = grid([cell("d4")])
    for k in (3, 2):
        deep = grid([cell(f"d{k}", deep), cell("side")])
    raw = document(para("p") + grid([cell("a"), cell("b", deep)], [cell("", "", '<w:vMerge w:val="restart"/>'), cell("wide")], [cell("", "", "<w:vMerge/>"), cell("z")]))
    got = [(r[0], r[1], r[3], r[4], r[5]) for r in files.docx_segments(raw)]
    assert got == [
        ("para", "p", None, None, None),
        ("cell", "a", 1, 0, 0),
        ("cell", "b", 1, 0, 1),
        ("cell", "d2", 2, 0, 0),
        ("cell", "d3\nd4", 3, 0, 0),
        ("cell", "side", 3, 0, 1),
        ("cell", "side", 2, 0, 1),
        ("cell", "", 1, 1, 0),
        ("cell", "wide", 1, 1, 1),
        ("cell", "z", 1, 2, 1),
        ("para", "foot", None, None, None),
    ]


def test_a_frame_cell_gives_paragraphs():
    raw = document(grid([cell("framed", grid([cell("x"), cell("y")]))]))
    assert [(r[0], r[1], r[2]) for r in files.docx_segments(raw)][:3] == [("para", "framed", "Body > Tbl(r0,c0)"), ("cell", "", "Body > Tbl(r0,c0)"), ("cell", "x", "Body > Tbl(r0,c0) > Nested > Tbl(r0,c0)")]


def test_slides():
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    groups = shape("deep")
    for _ in range(4):
        groups = f"<p:grpSp>{groups}</p:grpSp>"
    table = "<p:graphicFrame><p:xfrm><a:off x='12700' y='25400'/><a:ext cx='127000' cy='127000'/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>c</a:t></a:r></a:p></a:txBody></a:tc><a:tc/></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    raw = packed(
        ppt__slides__slide1_xml=f"<p:sld {A}><p:cSld><p:spTree>{shape('one')}{groups}{table}</p:spTree></p:cSld></p:sld>",
        ppt__diagrams__data1_xml=f"<x {A}><a:t> art </a:t><a:t> </a:t><a:t>two</a:t></x>",
        ppt__diagrams__data2_xml="<broken",
    )
    rows, warnings = files.pptx_segments(raw)
    assert [(r[0], r[1], r[3]) for r in rows] == [("text_frame", "one", None), ("text_frame", "deep", None), ("table_cell", "c", 1), ("smartart", "art", None), ("smartart", "two", None)]
    assert len(warnings) == 1
    assert [r[6:] for r in files.parse_pptx(raw, boxes=True) if r[0] == "table_cell"] == [(1.0, 2.0, 11.0, 12.0)] * 2


def test_office_segments_conversion_and_archive(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(document(para("p")))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.doc").write_bytes(b"old")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, bool(r.error)) for r in files.office_segments(spark, f"file://{tmp_path}").where("coalesce(seq, 0) = 0").collect()}
    assert got == {"a.docx": ("p", False), "b.docx": (None, True)}
    made = files.converted(spark, f"file://{tmp_path}", lambda kind, raw: kind.encode() + raw).collect()
    assert [(r.path.rsplit("/", 1)[-1], bytes(r.content)) for r in made] == [("c.docx", b".docold")]
    packs = files.zip_outputs(spark.createDataFrame([(1, "b.txt", b"2"), (1, "a.txt", b"1"), (2, "c", b"3")], "job_id long, name string, content binary")).collect()
    read = {r.job_id: {n: zipfile.ZipFile(io.BytesIO(r.archive)).read(n) for n in zipfile.ZipFile(io.BytesIO(r.archive)).namelist()} for r in packs}
    assert read == {1: {"a.txt": b"1", "b.txt": b"2"}, 2: {"c": b"3"}}


def test_exports(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from textweir.operators import terms

    df = spark.createDataFrame([(2, "b", "B", "en", "vi", "g", 0.5, 1, "approved"), (1, "a", "A", "en", "th", "g", 0.25, 0, "unverified")], "id long, source_text string, target_text string, source_lang string, target_lang string, domain string, confidence double, usage_count long, status string")
    whole = json.loads(terms.export_json(df, F.lit("2020-01-01T00:00:00")).first().json)
    assert whole["version"] == "1.0" and whole["exported_at"] == "2020-01-01T00:00:00" and [t["source_text"] for t in whole["terms"]] == ["a", "b"] and "created_at" not in whole["terms"][0]
    files.write_benchmark(df, f"file://{tmp_path}/bench")
    assert spark.read.json(f"file://{tmp_path}/bench/json").count() == spark.read.option("header", True).csv(f"file://{tmp_path}/bench/csv").count() == 2


def test_a_listing_becomes_a_document_that_reads_back(spark):
    lines = [(1, 0, "heading", "-- Page 1 --"), (1, 1, "source", "a < b & c\nsecond\x07"), (2, 0, "source", "")]
    df = spark.createDataFrame(lines[::-1], "doc_id long, pos long, kind string, line string")
    got = {r.doc_id: [(e[0], e[1]) for e in files.parse_docx(bytes(r.content))] for r in files.render_docx(df).collect()}
    assert got == {1: [("title", "-- Page 1 --"), ("text", "a < b & c\nsecond")], 2: []}


def test_registered_parsers(spark, tmp_path):
    (tmp_path / "x.LOG").write_bytes(b"one line")
    files.register_parser(".log", lambda raw: [("text", raw.decode(), "", None, None, None)])
    try:
        assert [r.content for r in files.office_elements(spark, f"file://{tmp_path}", {".log": files.PARSERS[".log"]}).collect()] == ["one line"]
    finally:
        del files.PARSERS[".log"]
