from pyspark.sql import functions as F

from textweir.functions import text as T


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_should_translate(spark):
    values = [None, "", "  ", "123", "-1.5", "3,900", "5.", "--", "ab", "abc", "目", "A1", "　全角　", "12 mm", "²³", "٣٤"]
    assert column(spark, values, T.translatable_reason) == ["empty"] * 3 + ["digits"] * 4 + ["no_alnum", "short", "ok", "ok", "short", "ok", "short", "no_letter", "digits"]


def test_numeric_cells(spark):
    assert column(spark, ["12%", "1/2", "1,234.5", "-", "12 mm", "  ", " 7\t", None, "-3"], T.is_numeric_cell) == [True, True, True, False, False, False, True, False, True]


def test_normalize_and_strip(spark):
    assert column(spark, ["　A \n b ", None], T.normalize) == ["a b", ""]
    assert column(spark, ["　全角　", " x "], T.strip) == ["全角", "x"]


def test_length_guard(spark):
    rows = [("字" * 20, "x" * 21, "Vietnamese"), ("字" * 20, "x" * 22, "vietnamese "), ("字" * 20, "x", "German"), ("字" * 14, "", "Vietnamese"), ("1" * 40, "", "Vietnamese")]
    df = spark.createDataFrame(rows, "s string, t string, l string")
    got = [r[0] for r in df.select(T.is_suspiciously_short(F.col("s"), F.col("t"), F.col("l"))).collect()]
    assert got == [True, False, False, False, False]


def test_sentences(spark):
    assert column(spark, ["你好。再见！ok? yes", "no stop", " ", None, "a.. b"], T.sentences) == [["你好。", "再见！", "ok?", "yes"], ["no stop"], [], [], ["a.", ".", "b"]]


def test_refusals_and_failures(spark):
    assert column(spark, ["Please provide the text", "provide the text " + "x" * 200, "The translator needs more context to translate it", "", None], T.is_refusal) == [True, False, False, False, False]
    assert column(spark, ["[Translation failed|x] a", "[Translation missing] b", "Translation failed|", None, "[No translation|"], T.is_failure) == [True, True, False, False, True]


def test_small_functions(spark):
    assert column(spark, ["שלום abc", "שלום a", "", "12"], T.text_direction) == ["rtl", "rtl", "ltr", "ltr"]
    assert column(spark, ["Traditional Chinese", "vi", "ja-JP", None], T.is_cjk_language) == [True, False, True, False]
    assert column(spark, ["", "abc", "a" * 10], T.token_estimate) == [0, 1, 4]
    df = spark.range(1).select(T.clock(F.lit(3725.9)), T.color_hex(F.lit(0x0A0B0C)), *T.font_flags(F.lit(0x12)), T.guard_short_reply(F.lit("ab"), F.lit("x" * 101)))
    assert tuple(df.first()) == ("01:02:05", "#0A0B0C", True, True, "ab")


def test_cache_key_is_the_plain_digest(spark):
    import hashlib

    got = spark.range(1).select(T.cache_key(F.lit(" Hi 　"), F.lit("English"), F.lit("DE"), F.lit("M"))).first()[0]
    assert got == hashlib.sha256("Hi\0english\0de\0m".encode()).hexdigest()
