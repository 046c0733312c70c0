import pytest
from pyspark.sql import functions as F

from textweir.functions import fitting, replies
from textweir.operators import translate as X
from textweir.sources.seams import LengthScorer, Tagging


def values(spark, rows, f, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(f).collect()]


def test_merged_replies(spark):
    assert spark.range(1).select(replies.merged(F.array(F.lit("a"), F.lit("b")))).first()[0] == "<<<SEG_0>>>\na\n<<<SEG_1>>>\nb"
    rows = [("<<<SEG_0>>> x\n<<<SEG_1>>>\ny",), ("x\n---\ny",), ("x\n\ny",), ("<<<SEG_1>>>only",), ("nothing",)]
    assert values(spark, rows, replies.split_reply(F.col("t"), F.lit(2))) == [["x", "y"], ["x", "y"], ["x", "y"], ["", "only"], ["", ""]]
    assert values(spark, [("<<<SEG_9>>> q",)], replies.split_reply(F.col("t"), F.lit(1))) == [["q"]]


def test_sanitizer(spark):
    rows = [("**bold** text",), ("Note: skip\nkeep",), ("Version History\nPhiên bản",), ("<SEC_GEN>x</SEC_GEN> <b>y</b>",), ("(a parenthesis longer than twenty)",), (None,), ("one\ntwo",)]
    assert values(spark, rows, replies.sanitize(F.col("t"))) == ["bold text", "keep", "Phiên bản", "x <b>y</b>", "(a parenthesis longer than twenty)", None, "one\ntwo"]


def test_body_replies(spark):
    rows = [("",), ("{",), ("[1]",), ('{"a": 1}',), ('{"translation": 5}',), ('{"translation": "src"}',), ('{"translation": "ok"}',)]
    got = values(spark, rows, replies.body_reason(F.col("t"), F.lit("src")))
    assert got == ["empty content", "unparseable JSON", "reply is not a JSON object", "missing or non-string 'translation' key", "missing or non-string 'translation' key", "echoed source (untranslated reply)", ""]
    assert values(spark, rows, replies.body_translation(F.col("t"), F.lit("src")))[-1] == "ok"


def test_second_run_calls_no_model(spark):
    segments = spark.createDataFrame([("hello there",), ("hello there",), ("12",), ("fail me",)], "text string")
    targets = spark.createDataFrame([("vi",), ("de",)], "target string")
    empty = spark.createDataFrame([], "key_hash string, text string, target string, translation string")
    first, rows = X.translate_texts(segments, targets, empty, Tagging("fail"), F.lit("en"), "m")
    got = {(r.text, r.target): (r.value, r.cached) for r in first.collect()}
    assert got == {("hello there", "vi"): ("[vi] hello there", False), ("hello there", "de"): ("[de] hello there", False), ("fail me", "vi"): ("[Translation failed|vi] fail me", False), ("fail me", "de"): ("[Translation failed|de] fail me", False)}
    again, more = X.translate_texts(segments, targets, rows, Tagging("fail"), F.lit("en"), "m")
    assert sorted(r.cached for r in again.collect()) == [False, False, True, True] and more.count() == 0
    filled = X.verify_and_fill(first, Tagging())
    assert filled.where("filled").count() == 2 and filled.where("value like '[Translation failed%'").count() == 0


def test_critique_adopts_strictly_better(spark):
    class Revise:
        def translate_batch(self, texts, target):
            return [t + "x" if len(t) < 6 else t[:-1] for t in texts]

    drafts = spark.createDataFrame([(1, "abcdef", "vi", "abcd"), (2, "abcdef", "vi", "abcdef"), (3, "a", "vi", "[Translation failed|vi] a")], "block_id long, text string, target string, value string")
    got = {r.block_id: r.value for r in X.critique(drafts, Revise(), LengthScorer()).collect()}
    assert got == {1: "abcdxx", 2: "abcdef", 3: "[Translation failed|vi] a"}


def test_cells_and_truncation(spark):
    cells = spark.createDataFrame([(1, 0, 0, "name"), (1, 0, 1, ""), (1, 0, 2, "12%"), (1, 0, 3, "fail")], "table_id long, row long, col long, content string")
    got = {r.col: (r.status, r.translated) for r in X.translate_cells(cells, "vi", Tagging("fail")).collect()}
    assert got == {0: ("translated", "[vi] name"), 1: ("skipped", ""), 2: ("passthrough", "12%"), 3: ("failed", "[Translation failed|vi] fail")}
    rows = spark.createDataFrame([(1, "a long first line\nand a second one", "Vietnamese", "x"), (2, "short", "Vietnamese", "y")], "id long, text string, target string, value string")
    assert {r.id: r.value for r in X.recover_truncated(rows, Tagging()).collect()} == {1: "[Vietnamese] a long first line\n[Vietnamese] and a second one", 2: "y"}


def test_size_guard(spark):
    df = spark.createDataFrame([("abc",), ("de",)], "text string")
    assert X.guard_size(df, 2, 5).count() == 2
    with pytest.raises(Exception, match="too many characters: 5"):
        X.guard_size(df, 2, 4).collect()


def test_fit_cascade(spark):
    assert fitting.fit("short", 300, 60, 11, 0)[:3] == (11, 1.15, 0.0)
    text = "some words that need a smaller type " * 4
    size, spacing, *_, truncated, fitted = fitting.fit(text, 300, 30, 11, 0)
    assert 8 <= size < 11 or spacing < 1.15 or truncated
    assert fitting.fit(text * 9, 100, 20, 11, 0)[4] and fitting.fit(text * 9, 100, 20, 11, 0)[5].endswith("…")
    df = spark.createDataFrame([("x", 10.0, 20.0, 9.0, 0.0)], "t string, w double, h double, s double, b double")
    assert df.select(fitting.fit_cascade("t", "w", "h", "s", "b").alias("f")).first().f.font_size == 9.0
