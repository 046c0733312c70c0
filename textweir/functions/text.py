"""Text rules: normalising, filtering, measuring and splitting, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FAILURE_PREFIXES = [
    "Translation failed|",
    "翻譯失敗]",
    "No translation|",
    "Translation missing",
    "Extended retry failed",
    "Chunked translation failed",
    "Chunk translation failed]",
    "Missing translation result]",
]
REFUSAL_PHRASES = [
    "provide the text",
    "text you'd like translated",
    "text you would like translated",
    "what would you like me to translate",
    "which language would you like",
    "no text was provided",
    "no text provided",
    "i don't see any text",
    "i do not see any text",
    "i need more context to translate",
]
REFUSAL_MAX_CHARS = 200
NOISE_PATTERNS = [
    r"^[\d.,±~～<>≤≥]{2,}\s*[a-zA-Zμµ°Φ/%²³]*$",
    r"^[\d.,±~～<>≤≥]+\s*[a-zA-Zμµ°Φ/%²³]{2,}$",
    r"(?i)^\d+[\d.,]*\s*(mm|cm|um|μm|µm|kg|g|V|A|Hz|HZ|℃|°C|MPa|ppm)\b",
    r"^\d+[~～]\d+\s*\w+",
    r"^\d.*[VvAa]\s*$",
    r"^\d+[ΦΦ]",
    r"^[A-D]\d$",
    r"(?i)^[A-Z]{1,3}-[A-Z]{1,4}\d{2,}",
    r"(?i)^(username|usename|password)$",
    r"^.?$",
    r"(?i)^Profiling\s",
]
CJK_LANGUAGE_MARKS = ["zh", "zh-cn", "zh-tw", "chinese", "traditional chinese", "simplified chinese", "ja", "japanese", "ko", "korean"]
LENGTH_COEFFICIENTS = {"vietnamese": (3.51, 0.75)}
LENGTH_K, LENGTH_MIN_CHARS = 0.3, 15
EXPANSION_FACTORS = {("en", "de"): 1.30, ("en", "es"): 1.25, ("en", "fr"): 1.20}
EXPANSION_DEFAULT = 1.15
WIDE_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FF60}]"
RTL = r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """White space collapsed, ends stripped, lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def folded(c: Column) -> Column:
    """White space collapsed and case folded, for comparing; long s and sharp s count as the letters they stand for."""
    return F.replace(F.replace(F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss")), F.lit("ſ"), F.lit("s"))


def has_cjk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"[\x{4E00}-\x{9FFF}]")


def is_cjk_language(c: Column) -> Column:
    """Whether the language's name holds one of the marks, wherever it stands."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*[F.lit(m) for m in CJK_LANGUAGE_MARKS]), lambda m: F.contains(low, m))


def is_traditional_chinese(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.contains(low, F.lit("traditional chinese")) | low.isin("zh-tw", "zh-hant")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def translatable_reason(c: Column) -> Column:
    """Why a text isn't worth translating, or ``ok``."""
    t = strip(F.coalesce(c, F.lit("")))
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    alnum = F.regexp_replace(t, r"[^\p{L}\p{N}]", "")
    return (
        F.when(t == "", "empty")
        .when(alnum == "", "no_alnum")
        .when(alnum.rlike(r"^\p{Nd}+$"), "digits")
        .when(t.rlike(r"(?U)^[-+]?\d+([.,]\d+)*[.]?$"), "number")
        .when(letters == "", "no_letter")
        .when(~has_cjk(t) & (F.length(letters) < 3), "short")
        .otherwise("ok")
    )


def should_translate(c: Column) -> Column:
    return translatable_reason(c) == "ok"


def is_numeric_cell(c: Column) -> Column:
    """Digits with the usual separators, at least one digit; empty isn't numeric."""
    t = strip(F.coalesce(c, F.lit("")))
    return t.rlike(r"^[0-9., /\-%\t]+$") & t.rlike("[0-9]")


def composition(c: Column) -> tuple[Column, Column]:
    """Numbers of CJK ideographs and of other letters."""
    t = F.coalesce(c, F.lit(""))
    cjk = _count(t, r"[\x{4E00}-\x{9FFF}]")
    return cjk, _count(t, r"\p{L}") - _count(t, r"[\p{L}&&[\x{4E00}-\x{9FFF}]]")


def expected_length(source: Column, target: Column) -> Column:
    cjk, other = composition(source)
    key = strip(F.lower(F.coalesce(target, F.lit(""))))
    out = F.lit(0.0)
    for name, (a, b) in LENGTH_COEFFICIENTS.items():
        out = F.when(key == name, cjk * a + other * b).otherwise(out)
    return out


def is_suspiciously_short(source: Column, translation: Column, target: Column) -> Column:
    norm = normalize(source)
    expected = expected_length(norm, target)
    return (F.length(norm) >= LENGTH_MIN_CHARS) & (expected > 0) & (F.length(F.coalesce(translation, F.lit(""))) < expected * LENGTH_K)


def token_estimate(c: Column) -> Column:
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 2.5))).cast("long")


def is_failure(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^\[(?:" + "|".join(map(re.escape, FAILURE_PREFIXES)) + ")")


def is_refusal(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    return (t != "") & (F.length(t) <= REFUSAL_MAX_CHARS) & F.exists(F.array(*[F.lit(p) for p in REFUSAL_PHRASES]), lambda p: F.contains(F.lower(t), p))


def is_noise_term(c: Column, site_words: list[str] | None = None) -> Column:
    """Measures, codes, form labels; and ``site_words``, a site's own names, in any case."""
    out = F.lower(c).isin([w.lower() for w in site_words]) if site_words else F.lit(False)
    for p in NOISE_PATTERNS:
        out = out | c.rlike(p)
    return out


def guard_short_reply(source: Column, reply: Column) -> Column:
    """A reply many times as long as a very short source is taken for invented: the source stays."""
    n = F.length(source)
    return F.when((n < 10) & (F.length(reply) > F.greatest(n * 20, F.lit(100))), source).otherwise(reply)


def cache_key(text: Column, target: Column, source: Column, model: Column) -> Column:
    parts = [strip(F.coalesce(text, F.lit(""))), *(F.lower(F.coalesce(c, F.lit(""))) for c in (target, source, model))]
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def sentences(c: Column) -> Column:
    """Parts ended by a full stop, exclamation or question mark, Western or CJK; stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "(?<=[。！？.!?])"), strip), lambda s: s != "")


def sentence_joiner(target: Column) -> Column:
    return F.when(is_cjk_language(target), "").otherwise(" ")


def force_split(c: Column, size: int) -> Column:
    """Slices of ``size`` characters, in order."""
    n = F.length(c)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(c, i * size + 1, F.lit(size))))


def text_direction(c: Column) -> Column:
    letters = _count(c, r"\p{L}")
    return F.when((letters > 0) & (_count(c, r"[\p{L}&&" + RTL + "]") * 2 > letters), "rtl").otherwise("ltr")


def text_width(c: Column, size: Column | float) -> Column:
    """Stand-in for font metrics: 1 em for a wide character, half an em for any other."""
    wide = _count(c, WIDE_CJK)
    return (wide + (F.length(c) - wide) * 0.5) * size


def expansion_factor(source: Column, target: Column) -> Column:
    out = F.lit(EXPANSION_DEFAULT)
    for (s, t), f in EXPANSION_FACTORS.items():
        out = F.when((source == s) & (target == t), F.lit(f)).otherwise(out)
    return out


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", "")


def color_hex(c: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.hex(c.bitwiseAND(F.lit(0xFFFFFF))), 6, "0"))


def font_flags(c: Column) -> tuple[Column, Column]:
    """Bold and italic."""
    return c.bitwiseAND(F.lit(0x10)) != 0, c.bitwiseAND(F.lit(0x02)) != 0


def clock(seconds: Column) -> Column:
    """HH:MM:SS, cut to whole seconds."""
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(F.floor(c).cast("long").cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two(F.pmod(s, F.lit(3600)) / 60), two(F.pmod(s, F.lit(60))))
