"""Compositions around the model seam: translate what is new, restore, verify, revise, translate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut
from ..sources.seams import Translator, score, translate
from . import cache as C
from . import tables as O
from .quality import adopt, adoptable


def failure_mark(target: Column, text: Column) -> Column:
    """A failed translation is data, never null."""
    return F.concat(F.lit("[Translation failed|"), target, F.lit("] "), text)


def translate_texts(segments: DataFrame, targets: DataFrame, cache: DataFrame, translator: Translator, source: Column, model: str) -> tuple[DataFrame, DataFrame]:
    """(translations: text, target, value, cached; new cache rows). Distinct texts meet the cache, only misses reach the model.

    ``targets`` is a job's list of target languages, a handful of rows.
    """
    wanted = segments.where(T.should_translate(F.col("text"))).select("text", source.alias("lang")).distinct().crossJoin(F.broadcast(targets))
    keyed = wanted.withColumn("key_hash", T.cache_key(F.col("text"), F.col("target"), F.col("lang"), F.lit(model)))
    found = C.lookup(keyed, cache)
    hits = found.where("translation is not null").select("text", "target", F.col("translation").alias("value"), F.lit(True).alias("cached"))
    fresh = translate(found.where("translation is null").select("text", "target").distinct(), translator)
    done = fresh.select("text", "target", F.coalesce("value", failure_mark(F.col("target"), F.col("text"))).alias("value"), F.lit(False).alias("cached"))
    rows = fresh.where("value is not null").join(keyed.select("text", "target", "key_hash"), ["text", "target"]).select("key_hash", "text", "target", F.col("value").alias("translation"))
    return hits.unionByName(done), C.first_write_wins(rows, cache, "text")


def verify_and_fill(translations: DataFrame, translator: Translator, retries: int = 2) -> DataFrame:
    """Failed translations tried again, at most ``retries`` times; adds filled."""
    out = translations.withColumn("filled", F.lit(False))
    for _ in range(retries):
        failed = out.where(T.is_failure(F.col("value"))).select("text", "target").distinct()
        again = translate(failed, translator).where(F.col("value").isNotNull()).select("text", "target", F.col("value").alias("_new"))
        out = out.join(again, ["text", "target"], "left").withColumn("filled", F.col("filled") | F.col("_new").isNotNull()).withColumn("value", F.coalesce("_new", "value")).drop("_new")
    return out


def critique(drafts: DataFrame, revise: Translator, scorer, rounds: int = 3) -> DataFrame:
    """Drafts (block_id, text, target, value) revised up to ``rounds`` times; a revision must be sound and score strictly better.

    A draft whose revision isn't adopted is left alone from then on. Each round
    ends in a checkpoint, so the model is asked once per round and draft.
    """
    state = drafts.where(~T.is_failure(F.col("value"))).withColumn("_open", F.lit(True))
    rest = drafts.where(T.is_failure(F.col("value")))
    for _ in range(min(rounds, 3)):
        new = translate(state.where("_open").select(F.col("value").alias("text"), "target").distinct(), revise).select(F.col("text").alias("value"), "target", F.col("value").alias("_new"))
        pairs = cut(state.join(new, ["value", "target"], "left"))
        before = score(pairs.select("block_id", F.col("text").alias("source"), F.col("value").alias("translation")), scorer).withColumnRenamed("score", "_a")
        after = score(pairs.select("block_id", F.col("text").alias("source"), F.col("_new").alias("translation")), scorer).withColumnRenamed("score", "_b")
        judged = pairs.join(before, "block_id").join(after, "block_id")
        takes = F.col("_open") & F.coalesce(adoptable(F.col("value"), F.col("_new")), F.lit(False)) & adopt(F.col("_a"), F.col("_b"))
        state = judged.select("block_id", "text", "target", F.when(takes, F.col("_new")).otherwise(F.col("value")).alias("value"), takes.alias("_open"))
    return state.drop("_open").unionByName(rest.select("block_id", "text", "target", "value"))


def translate_cells(cells: DataFrame, target: str, translator: Translator) -> DataFrame:
    """Cells with translated and status: empty ones skipped, numbers passed through, the rest translated or marked failed."""
    routed = cells.withColumn("_route", O.cell_route(F.col("content")))
    said = translate(routed.where("_route = 'translate'").select(F.col("content").alias("text"), F.lit(target).alias("target")).distinct(), translator).select(F.col("text").alias("content"), F.col("value").alias("_v"))
    out = routed.join(said, "content", "left")
    status = F.when(F.col("_route") != "translate", F.col("_route")).when(F.col("_v").isNull(), "failed").otherwise("translated")
    return out.withColumn("status", status).withColumn("translated", F.when(F.col("_route") == "translate", F.coalesce("_v", failure_mark(F.lit(target), F.col("content")))).otherwise(F.col("content"))).drop("_route", "_v")


def recover_truncated(rows: DataFrame, translator: Translator) -> DataFrame:
    """Rows (id, text, target, value) whose value is too short are translated line by line; the longer result stays."""
    short = rows.where(T.is_suspiciously_short(F.col("text"), F.col("value"), F.col("target")))
    lines = short.select("id", "target", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    said = translate(lines.select("text", "target").distinct(), translator)
    again = lines.join(said, ["text", "target"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l")).select("id", F.array_join("l.value", "\n").alias("_again"))
    return rows.join(again, "id", "left").withColumn("value", F.when(F.length("_again") > F.length("value"), F.col("_again")).otherwise(F.col("value"))).drop("_again")


def guard_size(segments: DataFrame, max_segments: int, max_chars: int) -> DataFrame:
    """The segments; raises while running where there are more of them, or of their characters, than allowed."""
    total = segments.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c"))
    ok = total.select(F.when(F.col("n") > max_segments, F.raise_error(F.concat(F.lit("too many segments: "), F.col("n").cast("string")))).when(F.col("c") > max_chars, F.raise_error(F.concat(F.lit("too many characters: "), F.col("c").cast("string")))).otherwise(F.lit(True)).alias("_ok"))
    return segments.crossJoin(F.broadcast(ok)).where("_ok").drop("_ok")  # one row
