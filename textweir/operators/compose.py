"""Whole dataflows around the model seams: documents, paragraphs, terms, routed jobs, reviews, layout checks and media."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import replies as R
from ..functions import text as T
from ..session import cut
from ..sources.seams import Translator, complete, embed, evaluate, score, translate
from . import chunks as K
from . import glossary as G
from . import layout as L
from . import pages
from . import quality as Q
from . import segments as S
from . import tables as B
from . import terms as O
from .translate import failure_mark, translate_texts

#: Characters of the source that a failed paragraph shows.
SHOWN = 30


def translate_document(elements: DataFrame, targets: DataFrame, cache: DataFrame, translator: Translator, source: Column, model: str, ceiling: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(elements in order with target and value; new cache rows) of documents in overlapping chunks.

    Every element is new in one chunk, and only there it is translated; an
    overlap is context. Distinct texts reach the model once, whichever chunks
    hold them. An element that isn't translated has no value; a failed one is
    marked. ``targets`` is a job's few languages.
    """
    planned = K.chunk(elements, ceiling, overlap)
    place = K.reassemble(planned, elements)
    asked = elements.where(F.col("should_translate") & (T.strip(F.coalesce("content", F.lit(""))) != "")).select(F.col("content").alias("text"))
    said, fresh = translate_texts(asked, targets, cache, translator, source, model)
    said = said.select(F.col("text").alias("content"), "target", "value")
    chunk_of = planned.where("not is_overlap").select("doc_id", "seq", "chunk_index")
    laid = elements.join(place, ["doc_id", "seq"]).join(chunk_of, ["doc_id", "seq"], "left").crossJoin(F.broadcast(targets))
    own = laid.join(said, ["content", "target"], "left").withColumn("value", F.when(F.col("should_translate"), F.col("value")))
    return own, fresh


def chunk_context(planned: DataFrame, elements: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, chunk_index, context: the last ``n`` translatable texts of the chunk before, a line each."""
    texts = planned.join(elements.where("should_translate and trim(content) <> ''").select("doc_id", "seq", "content"), ["doc_id", "seq"])
    back = texts.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", "chunk_index").orderBy(F.desc("pos")))).where(F.col("_r") <= n)
    tail = back.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("t")).select("doc_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.array_join("t.content", "\n").alias("context"))
    return planned.select("doc_id", "chunk_index").distinct().join(tail, ["doc_id", "chunk_index"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def paragraphs(segments: DataFrame, target: str, source: str, complete_json, translator: Translator, size: int = 2, chars: int = 300) -> DataFrame:
    """doc_id, seq, text, value, route of paragraphs, each its own call.

    What isn't worth translating passes; all else goes out as JSON, with the
    paragraphs before it as context where it is long enough; a reply that isn't
    sound is asked for again as plain text; a refusal keeps the source; what
    fails then is marked.
    """
    placed = S.context_window(segments, "doc_id", "seq", "text", size, chars)
    placed = placed.withColumn("_go", T.should_translate(F.col("text"))).withColumn("context", F.when(F.length(T.strip(F.coalesce("text", F.lit("")))) > 4, F.col("context")).otherwise(""))
    asked = placed.where("_go").select("text", "context").distinct().withColumn("payload", P.body_payload(F.col("text"), F.lit(source), F.lit(target)))
    told = cut(complete(asked, complete_json))
    told = told.withColumn("reason", R.body_reason(F.col("reply"), F.col("text"))).withColumn("said", R.body_translation(F.col("reply"), F.col("text")))
    again = translate(told.where("reason <> ''").select("text", F.lit(target).alias("target")).distinct(), translator).select("text", F.col("value").alias("plain"))
    answered = told.join(again, "text", "left").withColumn("_v", F.coalesce("said", "plain"))
    route = F.when(~F.col("_go"), "passthrough").when(F.col("_v").isNull(), "failed").when(T.is_refusal(F.col("_v")), "refused").when(F.col("said").isNotNull(), "json").otherwise("plain")
    failed = F.concat(F.lit("[翻譯失敗] "), F.substring("text", 1, SHOWN), F.lit("..."))
    out = placed.join(answered.select("text", "context", "said", "_v"), ["text", "context"], "left").withColumn("route", route)
    value = F.when(F.col("route").isin("passthrough", "refused"), F.coalesce("text", F.lit(""))).when(F.col("route") == "failed", failed).otherwise(F.col("_v"))
    return out.select("doc_id", "seq", "text", value.alias("value"), "route")


def translate_tables(cells: DataFrame, target: str, source: str, complete_json, translator: Translator) -> DataFrame:
    """Cells with translated and status, one JSON call a table.

    Empty cells are skipped and numbers passed through. A table whose reply lacks
    a cell, or echoes all of them, is translated cell by cell instead; what then
    fails is marked.
    """
    routed = cells.withColumn("_route", B.cell_route(F.col("content")))
    sent = routed.where("_route = 'translate'").select("table_id", "row", "col", "content")
    listed = sent.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "content", F.lit(False).alias("is_numeric")))).alias("c"))
    asked = listed.select(F.col("table_id").cast("string").alias("text"), P.table_payload(F.col("c"), F.lit(source), F.lit(target)).alias("payload"), F.lit("").alias("context"))
    told = cut(complete(asked, complete_json))
    replies_ = told.where("reply is not null").select(F.col("text").cast("long").alias("table_id"), F.regexp_replace("reply", '"translation"\\s*:', '"content":').alias("reply"))
    mapped = cut(B.remap(sent, B.reply_cells(replies_)))
    again = translate(mapped.where("not accepted").select(F.col("content").alias("text"), F.lit(target).alias("target")).distinct(), translator).select(F.col("text").alias("content"), F.col("value").alias("_one"))
    said = mapped.join(again, "content", "left").select("table_id", "row", "col", "accepted", F.coalesce("value", F.when(~F.col("accepted"), F.col("_one"))).alias("_v"))
    out = routed.join(said, ["table_id", "row", "col"], "left")
    status = F.when(F.col("_route") != "translate", F.col("_route")).when(F.col("_v").isNull(), "failed").when(F.col("accepted"), "table").otherwise("cell")
    return out.withColumn("status", status).withColumn("translated", F.when(F.col("_route") == "translate", F.coalesce("_v", failed(target, F.col("content")))).otherwise(F.col("content"))).drop("_route", "_v", "accepted")


def split_paragraph(c: Column, most: int = 1500) -> Column:
    """The parts a long block is translated in: paragraphs, or lines where it has none; of a part that is too long its sentences."""
    parts = F.filter(F.transform(F.when(F.contains(c, F.lit("\n\n")), F.split(c, "\n\n")).otherwise(F.split(c, "\n")), T.strip), lambda x: x != "")
    fine = F.flatten(F.transform(parts, lambda x: F.when((F.length(x) <= most) | (F.size(T.sentences(x)) == 0), F.array(x)).otherwise(T.sentences(x))))
    return F.when(T.strip(F.coalesce(c, F.lit(""))) == "", F.array().cast("array<string>")).when(F.length(c) <= most, F.array(c)).otherwise(fine)


def extract_terms(texts: DataFrame, known: DataFrame, target: str, domain: str, ask, ask_translate, embedder, similar: float, batch: int = 25) -> DataFrame:
    """New term rows of texts (text): those like a known term aside, what the model extracts, less what is known, translated, capped, unverified.

    ``known`` is the terminology base. Distinct texts are asked once; each call
    translates ``batch`` terms.
    """
    asked = complete(texts.select("text").distinct().withColumn("payload", F.col("text")).withColumn("context", F.lit("")), ask)
    found = asked.select("text", F.explode(P.extracted_terms(F.col("reply"))).alias("t")).select("text", T.strip(F.get_json_object("t", "$.term")).alias("source_text")).where("source_text <> ''")
    found = found.groupBy("source_text").agg(F.min(P.clip(F.col("text"), "snippet")).alias("context_snippet")).where(~T.is_noise_term(F.col("source_text")))
    mine = known.where((F.col("target_lang") == target) & (F.col("domain") == domain)).select("source_text").distinct()
    unknown = cut(found.join(mine, "source_text", "left_anti"))
    if embedder is not None:
        key = lambda df: embed(df.select(F.xxhash64("source_text").alias("vec_id"), F.col("source_text").alias("text")), embedder)
        near = G.similarity(key(mine), key(unknown), similar)
        unknown = unknown.join(near.select(F.col("vec_id").alias("_id")), F.xxhash64("source_text") == F.col("_id"), "left_anti")
    groups = unknown.withColumn("_b", F.pmod(F.xxhash64("source_text"), F.greatest(F.lit(1), F.ceil(F.lit(unknown.count()) / batch))))
    payload = groups.groupBy("_b").agg(F.to_json(F.array_sort(F.collect_list("source_text"))).alias("payload")).select(F.col("payload").alias("text"), "payload", F.lit("").alias("context"))
    said = complete(payload, ask_translate).select(F.explode(P.translated_terms(F.col("reply"))).alias("t")).select(F.col("t.source").alias("source_text"), F.col("t.target").alias("target_text"), F.col("t.confidence").alias("confidence"))
    best = said.groupBy("source_text").agg(F.max(F.struct("confidence", "target_text")).alias("b"))
    return unknown.join(best, "source_text").select("source_text", F.col("b.target_text").alias("target_text"), F.lit("auto").alias("source_lang"), F.lit(target).alias("target_lang"), F.lit(domain).alias("domain"), "context_snippet", F.col("b.confidence").alias("confidence"), F.lit(0).cast("long").alias("usage_count"), F.lit("unverified").alias("status"))


def store_terms(known: DataFrame, new: DataFrame) -> DataFrame:
    """The terminology base after a job's new terms: what is there stays."""
    return O.upsert(known, new, "skip")


def run_routed(segments: DataFrame, routes: DataFrame, cache: DataFrame, translators: Callable[[str, str], Translator], source: Column) -> DataFrame:
    """translations of a job whose targets go to several models: one run a group (model, provider), of which a job has a few."""
    out = None
    for g in Q.route_groups(routes).orderBy("first").collect():  # a row for each group of a job's targets
        targets = segments.sparkSession.createDataFrame([(t,) for t in g.targets.split(",")], "target string")
        said, _ = translate_texts(segments, targets, cache, translators(g.model, g.provider), source, g.model)
        one = said.withColumn("model", F.lit(g.model)).withColumn("provider", F.lit(g.provider))
        out = one if out is None else out.unionByName(one)
    return out


def review(blocks: DataFrame, terms: DataFrame, scorer) -> DataFrame:
    """Per job of blocks (job, block_id, source, translation): mean score (null if none was scored), its status, and the terminology audit."""
    scored = score(blocks, scorer)
    quality = blocks.join(scored, "block_id", "left").groupBy("job").agg(F.avg("score").alias("mean_score"), F.count("*").alias("blocks"))
    quality = quality.withColumn("qe_status", F.when(F.col("mean_score").isNull(), "unavailable").otherwise("available"))
    return quality.join(G.audit(blocks, terms, "job", "translation"), "job", "left")


def judge_loop(blocks: DataFrame, judge, retranslate, rounds: int = 3) -> DataFrame:
    """Per job of blocks (job, block_id, source, value): tier, feedback, attempts, status, and the blocks as they stand.

    Each round the judge sees every block of the jobs still open; a job's tier is
    its worst block's. The best tier ends a job; else all its blocks are
    translated again with its feedback, but for the last round. A block the judge
    has no answer for makes its job unavailable. Rounds end in a checkpoint.
    """
    state = cut(blocks.select("job", "block_id", "source", "value", F.lit("").alias("feedback"), F.lit(True).alias("_open"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("tier"), F.lit("available").alias("status")))
    for k in range(rounds):
        told = evaluate(state.where("_open").select("job", "block_id", "source", "value", "feedback"), judge)
        told = cut(told)
        rank = F.array_position(F.array(*[F.lit(t) for t in reversed(Q.TIERS)]), F.col("tier"))
        per = told.groupBy("job").agg(
            F.min_by("tier", F.when(rank > 0, rank)).alias("_t"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("said", F.lit("")) != "", F.struct("block_id", "said")))), lambda x: x["said"]), "; ").alias("_f"),
            F.bool_and("answered").alias("_ok"),
        )
        j = state.join(per, "job", "left").withColumn("_seen", F.col("_open") & F.col("_ok").isNotNull())
        j = j.withColumn("attempts", F.when(F.col("_seen"), k + 1).otherwise(F.col("attempts"))).withColumn("status", F.when(F.col("_seen") & ~F.col("_ok"), "unavailable").otherwise(F.col("status")))
        j = j.withColumn("tier", F.when(F.col("_seen"), F.when(F.col("_ok"), F.col("_t"))).otherwise(F.col("tier"))).withColumn("feedback", F.when(F.col("_seen"), F.col("_f")).otherwise(F.col("feedback")))
        j = j.withColumn("_open", F.col("_seen") & F.col("_ok") & ~F.coalesce(F.col("_t") == Q.TIERS[0], F.lit(False)))
        state = j.select(*state.columns)
        if k < rounds - 1:
            asked = state.where("_open").select(F.col("source").alias("text"), "feedback").distinct()
            new = complete(asked.withColumn("payload", F.col("text")).withColumn("context", F.col("feedback")), retranslate).select(F.col("text").alias("source"), F.col("context").alias("feedback"), F.col("reply").alias("_new"))
            state = state.join(new, ["source", "feedback"], "left").withColumn("value", F.when(F.col("_open"), F.coalesce("_new", "value")).otherwise(F.col("value"))).select(*state.columns)
        state = cut(state)
    return state.drop("_open")


def apply_judged(blocks: DataFrame, judged: DataFrame, jobs: DataFrame, ext: str) -> DataFrame:
    """Blocks of jobs (job_id, status, applying) that are done and not being applied, with the judge's revisions by positional id."""
    ready = jobs.where("status = 'completed' and not applying").select("job_id")
    return pages.override(blocks.join(ready, "job_id", "left_semi"), judged, ext)


def layout_check(source: DataFrame, rendered: DataFrame, texts: DataFrame, floor: float = 0.8) -> DataFrame:
    """doc_id, mean_biou, pages, signals, warned: placements against what was rendered, and source text left standing (doc_id, page, content, rendered)."""
    docs = L.fidelity(L.best_iou(source, rendered), floor)[1]
    hit = pages.affected(docs.select("doc_id", F.col("regressed").alias("pages")), pages.residual(texts))
    none = F.array().cast("array<bigint>")
    return docs.join(hit, "doc_id", "left").select("doc_id", "mean_biou", F.coalesce("pages", none).alias("pages"), F.coalesce("signals", F.array().cast("array<string>")).alias("signals"), F.col("pages").isNotNull().alias("warned"))


def denoise_plan(spans: DataFrame, totals: DataFrame, key: str, seconds: float = 30.0) -> DataFrame:
    """key, start, end, speech: a recording (key, total) as pieces in order; speech in pieces of at most ``seconds``, all else as it is."""
    speech = Q.split_spans(spans.select(key, "start", "end"), seconds).withColumn("speech", F.lit(True))
    w = W.partitionBy(key).orderBy("start")
    inner = spans.select(key, F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("_s"), F.col("start").alias("_e"))
    last = totals.join(spans.groupBy(key).agg(F.max("end").alias("_s")), key, "left").select(key, F.coalesce("_s", F.lit(0.0)).alias("_s"), F.col("total").alias("_e"))
    rest = inner.unionByName(last).where("_e > _s").select(key, F.col("_s").alias("start"), F.col("_e").alias("end"), F.lit(False).alias("speech"))
    return speech.unionByName(rest)


def media(spans: DataFrame, totals: DataFrame, key: str, transcribe, targets: DataFrame, cache: DataFrame, translator: Translator, gap: float = 0.5, seconds: float = 30.0) -> DataFrame:
    """Transcript lines of recordings: speech joined over short silences, cut to pieces, transcribed, translated, laid out with a line per target.

    ``targets`` is a job's few languages, in the order of its rows (pos, target).
    """
    voiced = Q.speech_sessions(spans, key, gap)
    pieces = denoise_plan(voiced.select(key, "start", "end"), totals, key, seconds).where("speech")
    said = complete(pieces.select(F.concat_ws("|", F.col(key).cast("string"), "start", "end").alias("text")).withColumn("payload", F.col("text")).withColumn("context", F.lit("")), transcribe)
    rows = pieces.withColumn("_t", F.concat_ws("|", F.col(key).cast("string"), "start", "end")).join(said.select(F.col("text").alias("_t"), F.col("reply").alias("text")), "_t").where("text <> ''").drop("_t")
    out, _ = translate_texts(rows.select("text"), targets.select("target"), cache, translator, F.lit("auto"), "media")
    by = out.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("target", "value"))).alias("translated"))
    names = [r.target for r in targets.orderBy("pos").collect()]  # a job's target languages
    full = rows.join(by, "text", "left").withColumn("translated", F.coalesce("translated", F.create_map().cast("map<string,string>"))).withColumn("language", F.lit(None).cast("string"))
    return Q.transcript_lines(full, names)


def failed(target: str, c: Column) -> Column:
    return failure_mark(F.lit(target), c)
