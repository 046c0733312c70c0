"""Building what is sent to a model and reading its replies, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed values.
MARKER = r"<<<SEG_(\d+)>>>"
SEPARATORS = ["---SEGMENT_SEPARATOR---", "\n---\n", "\n\n---\n\n", "---"]
NOT_SAID = [(r"\*{1,2}(.+?)\*{1,2}", "$1"), (r"<<<?/?(?:SEP|END|SEG_\d+)>>>?", ""), (r"(?U)</?[A-Z][A-Z0-9_]*(?:\s[^>]*)?>", "")]
COMMENTARY = r"(?iU)^(?:(?:Final decision|Note|Output|Translation|Explanation|Answer|Result|Remark|Comment)\s*[:：]|→\s|\(Note[:：]|\((?:người|Revision|Version|Name|Date|Release|New Issue)[^)]*\)\s*$)"


def merged(texts: Column) -> Column:
    """Texts under numbered markers, one message."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("<<<SEG_"), i.cast("string"), F.lit(">>>\n"), t)), "\n")


def without_markers(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)<<<SEG_\d+>>>\s*", ""))


def split_reply(reply: Column, n: Column) -> Column:
    """``n`` texts of a merged reply: by markers (the last of equal numbers counts), else by the first separator that gives ``n`` parts, else marked ones alone; empty where missing."""
    pieces = F.filter(F.split(F.regexp_replace(reply, MARKER, "\u0001$1\u0002"), "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    number = lambda p: F.substring_index(p, "\u0002", 1).try_cast("int")
    body = lambda p: strip(F.substring_index(p, "\u0002", -1))
    marked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(F.reverse(F.transform(F.filter(pieces, lambda p: number(p) == i), body)), F.lit(0)), F.lit("")))
    filled = F.size(F.filter(marked, lambda t: t != ""))
    parts = lambda sep: F.transform(F.filter(F.transform(F.split(reply, r"\Q" + sep + r"\E"), strip), lambda t: t != ""), without_markers)
    out = F.when((F.size(pieces) > 0) & (filled >= n * 0.8), marked)
    for sep in [*SEPARATORS, "\n\n"]:
        out = out.when(F.size(parts(sep)) == n, parts(sep))
    return out.when(n == 1, F.array(without_markers(reply))).otherwise(marked)


def sanitize(c: Column) -> Column:
    """A translation without emphasis marks, markers, invented tags, commentary and a leading Latin preamble; never empty."""
    t = c
    for pattern, kept in NOT_SAID:
        t = F.regexp_replace(t, pattern, kept)
    dropped = lambda s: (s == "") | s.rlike(COMMENTARY) | (F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")")) & (F.length(s) > 20))
    lines = F.filter(F.split(t, "\n"), lambda x: ~dropped(strip(x)))
    foreign = F.array_position(F.transform(lines, lambda x: x.rlike(r"[\p{L}&&[^\x{00}-\x{7F}]]")), F.lit(True))
    before = F.slice(lines, 1, F.greatest(foreign - 1, F.lit(0)).cast("int"))
    latin = F.forall(before, lambda x: strip(x).rlike(r"^[\x{00}-\x{7F}“”…–—]*$"))
    kept = F.when((foreign > 1) & latin, F.slice(lines, foreign.cast("int"), F.size(lines))).otherwise(lines)
    out = strip(F.array_join(kept, "\n"))
    return F.when(F.coalesce(c, F.lit("")) == "", c).when(out == "", c).otherwise(out)


def body_reason(reply: Column, source: Column) -> Column:
    """Why a JSON reply isn't taken, empty where it is."""
    v = F.try_parse_json(reply)
    kind = F.schema_of_variant(v)
    said = F.try_variant_get(v, "$.translation", "string")
    held = F.schema_of_variant(F.try_variant_get(v, "$.translation", "variant"))
    return (
        F.when(F.coalesce(reply, F.lit("")) == "", "empty content")
        .when(v.isNull(), "unparseable JSON")
        .when(~F.startswith(kind, F.lit("OBJECT")), "reply is not a JSON object")
        .when(said.isNull() | (held != "STRING"), "missing or non-string 'translation' key")
        .when(said == source, "echoed source (untranslated reply)")
        .otherwise("")
    )


def body_translation(reply: Column, source: Column) -> Column:
    return F.when(body_reason(reply, source) == "", F.get_json_object(reply, "$.translation"))


def num_ctx_ok(n: Column, low: int, high: int) -> Column:
    return n.isNull() | ((n > 0) & n.between(low, high))
