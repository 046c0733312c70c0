"""What a model is told, and what its structured replies say, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed values.
BODY = 'Translate the "text" value in the JSON object below from {src} to {tgt}. Return: {{"translation": <your translation>}}\n\n'
TABLE = (
    'Translate the "text" value of each cell below from {src} to {tgt}. '
    "Each cell is identified by its row and col; use the exact same row/col values in your reply. "
    'Return: {{"cells": [{{"row": <int>, "col": <int>, "translation": <your translation>}}, ...]}}\n\n'
)
EXAMPLES_HEAD, GLOSSARY_HEAD, TERMS_HEAD = "# Translation examples", "# Glossary", "Terminology constraints:"
NO_EXAMPLES = EXAMPLES_HEAD + "\nNo curated examples available. Translate accurately and naturally."
CONFIDENCE_CAP = 0.85
#: Characters that are kept of a context line, a critique's context, a term's snippet and a log line.
CLIPS = {"context": 200, "critique": 240, "sample": 300, "snippet": 60}


def _framed(template: str, source: Column, target: Column, payload: Column) -> Column:
    before, rest = template.replace("{{", "{").replace("}}", "}").split("{src}")
    middle, after = rest.split("{tgt}")
    return F.concat(F.lit(before), F.coalesce(F.when(source != "", source), F.lit("auto")), F.lit(middle), target, F.lit(after), payload)


def spaced_json(c: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def body_payload(text: Column, source: Column, target: Column) -> Column:
    return _framed(BODY, source, target, F.concat(F.lit('{"text": '), spaced_json(text), F.lit("}")))


def table_payload(cells: Column, source: Column, target: Column) -> Column:
    """``cells``: an ordered array of (row, col, content, is_numeric); empty and numeric ones aren't sent."""
    sent = F.filter(cells, lambda c: (F.coalesce(c["content"], F.lit("")) != "") & ~c["is_numeric"])
    one = lambda c: F.concat(F.lit('{"row": '), c["row"].cast("string"), F.lit(', "col": '), c["col"].cast("string"), F.lit(', "text": '), spaced_json(c["content"]), F.lit("}"))
    return _framed(TABLE, source, target, F.concat(F.lit('{"cells": ['), F.array_join(F.transform(sent, one), ", "), F.lit("]}")))


def pairs_block(head: str, pairs: Column) -> Column:
    """``head`` and a line ``- source => target`` for each pair; empty without pairs."""
    return F.when(F.size(pairs) > 0, F.concat_ws("\n", F.lit(head), F.transform(pairs, lambda p: F.concat(F.lit("- "), p["source_text"], F.lit(" => "), p["target_text"])))).otherwise("")


def glossary_block(terms: Column) -> Column:
    return pairs_block(GLOSSARY_HEAD, terms)


def terminology_block(terms: Column) -> Column:
    return pairs_block(TERMS_HEAD, terms)


def fewshot_block(examples: Column) -> Column:
    """Examples (source, target) as a prompt's section; a fixed line where there are none."""
    shown = F.transform(examples, lambda e: F.concat(F.lit("Source: "), e["source"], F.lit("\nTarget: "), e["target"]))
    return F.when(F.size(examples) > 0, F.concat(F.lit(EXAMPLES_HEAD + "\n"), F.array_join(shown, "\n\n"))).otherwise(NO_EXAMPLES)


def clip(c: Column, kind: str) -> Column:
    return F.substring(c, 1, CLIPS[kind])


def extracted_terms(reply: Column) -> Column:
    """array<string>: the JSON objects of a reply that is a list, or an object whose one value is a list, or that holds a list somewhere; else empty."""
    t = strip(F.coalesce(reply, F.lit("")))
    whole = F.from_json(t, "array<string>")
    keys = F.json_object_keys(t)
    inner = F.when(F.size(keys) == 1, F.from_json(F.element_at(F.map_values(F.from_json(t, "map<string,string>")), 1), "array<string>"))
    found = F.from_json(F.regexp_extract(t, r"(?s)\[.*\]", 0), "array<string>")
    items = F.when(F.startswith(t, F.lit("[")), whole).when(F.startswith(t, F.lit("{")), inner)
    return F.filter(F.coalesce(items, found, F.array().cast("array<string>")), lambda x: F.startswith(F.ltrim(x), F.lit("{")))


def translated_terms(reply: Column) -> Column:
    """array of (source, target, confidence) of ``{"translations": [..]}``, whole or inside other text; those without a source left out, confidence capped."""
    t = F.regexp_extract(strip(F.coalesce(reply, F.lit(""))), r"(?s)\{.*\}", 0)
    items = F.coalesce(F.from_json(F.get_json_object(t, "$.translations"), "array<string>"), F.array().cast("array<string>"))
    of = lambda x, k: F.coalesce(F.get_json_object(x, f"$.{k}"), F.lit(""))
    kept = F.filter(items, lambda x: of(x, "source") != "")
    sure = lambda x: F.least(F.coalesce(F.get_json_object(x, "$.confidence").try_cast("double"), F.lit(1.0)), F.lit(CONFIDENCE_CAP))
    return F.transform(kept, lambda x: F.struct(of(x, "source").alias("source"), of(x, "target").alias("target"), sure(x).alias("confidence")))
