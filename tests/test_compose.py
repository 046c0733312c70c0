import threading

import pytest
from pyspark.sql import functions as F

from textweir.functions import fitting
from textweir.operators import compose, folds, jobs, pages
from textweir.sources import seams
from textweir.sources.seams import Tagging

NONE = "key_hash string, translation string"


def test_a_document_goes_through_chunks_and_comes_back_in_order(spark):
    rows = [(1, i, "text", f"line number {i} " * (i % 4 + 1), i != 3) for i in range(12)] + [(2, 0, "title", "", True), (2, 1, "text", "fail here", True)]
    elements = spark.createDataFrame(rows, "doc_id long, seq long, element_type string, content string, should_translate boolean")
    targets = spark.createDataFrame([("Thai",), ("German",)], "target string")
    out, fresh = compose.translate_document(elements, targets, spark.createDataFrame([], NONE), Tagging("fail"), F.lit("en"), "m", 30, 6)
    got = {(r.doc_id, r.seq, r.target): (r.position, r.value) for r in out.collect()}
    assert len(got) == 28 and got[1, 0, "Thai"] == (0, "[Thai] line number 0 ")
    assert got[1, 3, "Thai"][1] is None and got[2, 0, "German"][1] is None
    assert got[2, 1, "Thai"][1] == "[Translation failed|Thai] fail here"
    assert [got[1, i, "Thai"][0] for i in range(12)] == list(range(12))
    assert fresh.where("target = 'Thai'").count() == 11


def test_context_of_a_chunk_is_the_end_of_the_one_before(spark):
    planned = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 1), (1, 1, 0, 2)], "doc_id long, chunk_index long, pos long, seq long")
    elements = spark.createDataFrame([(1, i, f"t{i}", i != 1) for i in range(3)], "doc_id long, seq long, content string, should_translate boolean")
    assert sorted((r.chunk_index, r.context) for r in compose.chunk_context(planned, elements).collect()) == [(0, ""), (1, "t0")]


def _json_():
    def ask(payload, context):
        for word, reply in {"alpha": '{"translation": "ALPHA"}', "broken": "nope", "refuse": '{"translation": "Could you provide the text?"}', "dead": None}.items():
            if word in payload:
                return reply
        return None

    return ask  # pickled by value


def test_paragraph_guards(spark):
    rows = [(1, i, t) for i, t in enumerate(["alpha one", "12345", "broken one", "refuse one", "dead one", "", "alpha one"])]
    segments = spark.createDataFrame(rows, "doc_id long, seq long, text string")
    got = {r.seq: (r.value, r.route) for r in compose.paragraphs(segments, "Thai", "en", _json_(), Tagging("dead")).collect()}
    assert got == {0: ("ALPHA", "json"), 1: ("12345", "passthrough"), 2: ("[Thai] broken one", "plain"), 3: ("refuse one", "refused"), 4: ("[翻譯失敗] dead one...", "failed"), 5: ("", "passthrough"), 6: ("ALPHA", "json")}


def test_long_paragraphs_are_cut_at_paragraphs_lines_and_sentences(spark):
    rows = [("a" * 5,), ("p one\n\n p two \n\n" + "s. " * 8,), ("l one\nl two is long enough",), (" ",), ("x" * 30,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(compose.split_paragraph(F.col("t"), 20)).collect()]
    assert got == [["a" * 5], ["p one", "p two", *["s."] * 8], ["l one", "l two is long enough"], [], ["x" * 30]]


def _extract_():
    def ask(payload, context):
        return '[{"term": "' + payload.split()[0] + '"}, {"term": "known"}, {"term": "5V"}]'

    return ask  # pickled by value


def _terms_():
    def ask(payload, context):
        import json

        return "so " + json.dumps({"translations": [{"source": t, "target": t.upper(), "confidence": 0.99} for t in json.loads(payload)]})

    return ask  # pickled by value


def test_new_terms_are_extracted_translated_and_capped(spark):
    schema = "source_text string, target_text string, source_lang string, target_lang string, domain string, confidence double, usage_count long, status string"
    known = spark.createDataFrame([("known", "k", "en", "Thai", "general", 1.0, 3, "approved")], schema)
    texts = spark.createDataFrame([("valve opens",), ("pump runs",), ("valve opens",)], "text string")
    new = compose.extract_terms(texts, known, "Thai", "general", _extract_(), _terms_(), None, 0.9)
    got = {r.source_text: (r.target_text, r.confidence, r.status, r.context_snippet) for r in new.collect()}
    assert got == {"valve": ("VALVE", 0.85, "unverified", "valve opens"), "pump": ("PUMP", 0.85, "unverified", "pump runs")}
    near = compose.extract_terms(texts, known.unionByName(known.withColumn("source_text", F.lit("Pump")).withColumn("target_lang", F.lit("Thai"))), "Thai", "general", _extract_(), _terms_(), lambda ts: [[1.0, 0.0] if t.lower() == "pump" else [0.0, 1.0 if t == "valve" else -1.0] for t in ts], 0.9)
    assert [r.source_text for r in near.collect()] == ["valve"]
    assert {r.source_text for r in compose.store_terms(known, new.select(*known.columns)).collect()} == {"known", "valve", "pump"}


def _judge_():
    def ask(source, value, feedback):
        if source == "mute":
            return None
        return ("高", "") if source == "good" or value.endswith(")") else ("低", f"fix {source}")

    return ask  # pickled by value


def test_judge_rounds(spark):
    rows = [(1, 10, "good", "g"), (1, 11, "bad", "b"), (2, 20, "good", "g"), (3, 30, "mute", "m"), (4, 40, "never", "n")]
    blocks = spark.createDataFrame(rows, "job long, block_id long, source string, value string")
    out = compose.judge_loop(blocks, _judge_(), lambda t, f: None if t == "never" else f"{t} ({f})")
    got = {r.block_id: (r.value, r.tier, r.attempts, r.status) for r in out.collect()}
    assert got[11] == ("bad (fix bad)", "高", 2, "available") and got[10] == ("good (fix bad)", "高", 2, "available")
    assert got[20] == ("g", "高", 1, "available") and got[30] == ("m", None, 1, "unavailable") and got[40] == ("n", "低", 3, "available")


def test_revisions_are_applied_to_finished_jobs_only(spark):
    blocks = spark.createDataFrame([(j, j, f"s{j}", i, f"v{i}") for j in (1, 2, 3) for i in range(2)], "job_id long, doc_id long, stem string, seq long, value string")
    jobs_ = spark.createDataFrame([(1, "completed", False), (2, "running", False), (3, "completed", True)], "job_id long, status string, applying boolean")
    new = spark.createDataFrame([("docx:s1:1", "new"), ("docx:s3:0", "no")], "block_id string, value string")
    assert sorted((r.block_id, r.value, r.overridden) for r in compose.apply_judged(blocks, new, jobs_, "docx").collect()) == [("docx:s1:0", "v0", False), ("docx:s1:1", "new", True)]


def test_layout_check_joins_both_signals(spark):
    box = "doc_id long, page long, element_id long, x0 double, y0 double, x1 double, y1 double"
    source = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 2, 0.0, 0.0, 10.0, 10.0), (3, 1, 3, 0.0, 0.0, 10.0, 10.0)], box)
    rendered = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 2, 5.0, 0.0, 15.0, 10.0), (3, 1, 3, 0.0, 0.0, 10.0, 10.0)], box)
    texts = spark.createDataFrame([(1, 1, "Straße  A", "x STRASSE a y"), (2, 1, "b", "c"), (3, 1, "b", "c")], "doc_id long, page long, content string, rendered string")
    got = {r.doc_id: (r.pages, r.signals, r.warned) for r in compose.layout_check(source, rendered, texts).collect()}
    assert got == {1: ([1], ["residual"], True), 2: ([1], ["biou"], True), 3: ([], [], False)}


def test_media_lines(spark):
    spans = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.2, 40.0), (1, 50.0, 51.0)], "rec long, start double, end double")
    totals = spark.createDataFrame([(1, 60.0), (2, 5.0)], "rec long, total double")
    plan = sorted((r.rec, r.start, r.end, r.speech) for r in compose.denoise_plan(spans, totals, "rec").collect())
    assert plan == [(1, 0.0, 1.0, False), (1, 1.0, 2.0, True), (1, 2.0, 2.2, False), (1, 2.2, 32.2, True), (1, 32.2, 40.0, True), (1, 40.0, 50.0, False), (1, 50.0, 51.0, True), (1, 51.0, 60.0, False), (2, 0.0, 5.0, False)]
    targets = spark.createDataFrame([(0, "Thai")], "pos int, target string")
    out = compose.media(spans, totals, "rec", lambda p, c: "" if p.startswith("1|50") else f"words {p.split('|')[1]}", targets, spark.createDataFrame([], NONE), Tagging())
    assert sorted(r.lines for r in out.collect()) == ["[00:00:01 - 00:00:31] [unknown] words 1.0\n  [Thai] [Thai] words 1.0", "[00:00:31 - 00:00:40] [unknown] words 31.0\n  [Thai] [Thai] words 31.0"]


def test_retries_ceiling_and_ladder():
    waits, calls = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise ValueError("no")
        return text.upper()

    assert seams.with_retries(flaky, "a", str.split, wait=waits.append) == "A" and waits == [1.6, 3.2]

    def short(text):
        if len(text) > 3:
            raise seams.TooLong
        return text

    assert seams.with_retries(short, "abc def", str.split, " ", waits.append) == "abc def"
    assert seams.with_retries(short, "abcdef", str.split, wait=waits.append) is None
    waits.clear()

    def busy(text):
        raise seams.Temporary

    assert seams.with_retries(busy, "a", str.split, wait=waits.append) is None and waits == [1.6, 3.2, 5.0, 10.0, 20.0]
    gate = threading.Event()
    assert seams.bounded(gate.wait, 0.1) == (None, "timeout")
    assert seams.bounded(lambda: "x") == ("x", "ok")
    stop = threading.Event()
    stop.set()
    assert seams.bounded(lambda: "x", cancelled=stop) == (None, "cancelled")
    gate.set()

    def hungry(pairs, size):
        if size > 1:
            raise MemoryError
        return [1.0] * len(pairs)

    assert seams.score_ladder(hungry, [("a", "b")] * 3) == [1.0] * 3
    assert seams.score_ladder(lambda p, n: 1 / 0, [("a", "b")]) == []


def test_lookup_recognition_and_hooks(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "text string")
    found = seams.lookup(asked, lambda t, lang: {"id": "Q1", "en": "x"} if (t, lang) == ("a", "en") else None, ["zh", "en"])
    assert [(r.text, r.entity_id, r.labels) for r in found.collect()] == [("a", "Q1", {"en": "x"})]
    scans = spark.createDataFrame([(1, 1, "", b"img"), (1, 2, "long enough text", b"img"), (1, 3, None, None)], "doc_id long, page long, text string, image binary")
    assert {r.page: r.text for r in seams.recognise(scans, lambda raw: ["seen", "lines"]).collect()} == {1: "seen\nlines", 2: "long enough text", 3: None}
    assert [r.text for r in seams.hooked(asked, [lambda d: d.where("text = 'a'")], lambda d: d, [lambda d: d.withColumn("text", F.upper("text"))]).collect()] == ["A"]


def test_variables_and_providers(spark):
    assert jobs.expand_variables("${A}/${B:-x}/${C:-}", {"A": "1"}) == ("1/x/", True)
    assert jobs.expand_variables("${A}", {}) == ("", False)
    got = {r.provider: (r.enabled, r.settings) for r in jobs.providers(spark, [{"id": "p", "url": "${U}", "models": {"translate": "m"}}, {"id": "q", "url": "${V:-http://x}"}], {}).collect()}
    assert got == {"p": (False, {"url": ""}), "q": (True, {"url": "http://x"})}


def test_benchmark_sample_is_fixed_fair_and_in_order(spark):
    rows = [("a", i, "x" * (i % 9), "ref" if i % 7 else "") for i in range(100)]
    df = spark.createDataFrame(rows, "pair string, id long, source string, reference string")
    got = [(r.pos, r.id) for r in jobs.benchmark_sample(df, 10, 3).orderBy("pos").collect()]
    assert len(got) == 10 and [p for p, _ in got] == list(range(10)) and [i for _, i in got] == sorted(i for _, i in got)
    assert all(i % 9 >= 4 and i % 7 for _, i in got)
    assert got == [(r.pos, r.id) for r in jobs.benchmark_sample(df.repartition(3), 10, 3).orderBy("pos").collect()]
    assert got != [(r.pos, r.id) for r in jobs.benchmark_sample(df, 10, 4).orderBy("pos").collect()]


def test_running_totals_need_no_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = folds.running(df, [F.desc("k")], F.col("k")).orderBy("position").collect()
    total = 0
    for i, r in enumerate(got):
        total += 999 - i
        assert (r.k, r.position, r.total) == (999 - i, i + 1, total)


def test_shrinking_equals_its_closed_form(spark):
    rows = [(t, w, h, s) for t in ("word", "two\nlines here", "", "目的") for w in (5.0, 40.0, 300.0) for h in (9.0, 30.0) for s in (7.0, 12.0, 60.0)]
    df = spark.createDataFrame(rows, "t string, w double, h double, s double").withColumn("g", fitting.shrink_fit(F.col("t"), F.col("w"), F.col("h"), F.col("s")))
    for r in df.collect():
        size, fits = fitting.shrink(r.t, r.w, r.h, r.s)
        assert (round(r.g.size, 9), r.g.fits) == (round(size, 9), fits), r


def test_empty_pages(spark):
    spans = spark.createDataFrame([], "doc_id long, page long, block long, line long, span long, text string, font string, size double, flags long, color long, x0 double, y0 double, x1 double, y1 double")
    assert pages.text_blocks(spans).count() == 0
    with pytest.raises(StopIteration):
        next(iter(pages.page_numbers(spans, spans).collect()))


def test_a_table_is_one_call_and_falls_back_to_cells(spark):
    def ask(payload, context):
        import json

        cells = json.loads(payload.split("\n\n")[1])["cells"]
        kind = cells[0]["text"]
        if kind == "dead":
            return None
        said = [{"row": c["row"], "col": c["col"], "translation": c["text"] if kind == "echo" else c["text"].upper()} for c in cells]
        return json.dumps({"cells": said[:-1] if kind == "lost" else said})

    rows = [(t, 0, c, x) for t, words in enumerate([["good", "two"], ["lost", "two"], ["echo", "two"], ["dead", "fail"]]) for c, x in enumerate([*words, "12", "", None])]
    cells = spark.createDataFrame(rows, "table_id long, row long, col long, content string")
    got = {(r.table_id, r.col): (r.translated, r.status) for r in compose.translate_tables(cells, "Thai", "en", ask, Tagging("fail")).collect()}
    assert got[0, 0] == ("GOOD", "table") and got[0, 1] == ("TWO", "table") and got[0, 2] == ("12", "passthrough") and got[0, 3] == ("", "skipped") and got[0, 4] == (None, "skipped")
    assert got[1, 0] == ("[Thai] lost", "cell") and got[2, 1] == ("[Thai] two", "cell")
    assert got[3, 0] == ("[Thai] dead", "cell") and got[3, 1] == ("[Translation failed|Thai] fail", "failed")


def test_sentences_by_a_library_or_by_rule(spark):
    rows = spark.createDataFrame([(1, "A b. C d!", "en"), (2, "甲。乙！", "zh"), (3, "x. y.", "ru"), (4, None, "en")], "id long, text string, code string")
    got = sorted((r.id, r.pos, r.sentence) for r in seams.split_sentences(rows, lambda t, c: [t, " "] if c == "en" else None).collect())
    assert got == [(1, 0, "A b. C d!"), (2, 0, "甲。"), (2, 1, "乙！"), (3, 0, "x."), (3, 1, "y.")]


def test_only_traditional_targets_are_converted(spark):
    rows = spark.createDataFrame([(1, "zh-TW", "后"), (2, "Thai", "后"), (3, "Traditional Chinese", None), (4, "zh-tw", "!")], "id long, target string, value string")
    got = {r.id: r.value for r in seams.to_traditional(rows, lambda t: {"后": "後"}[t]).collect()}
    assert got == {1: "後", 2: "后", 3: None, 4: "!"}
