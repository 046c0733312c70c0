"""Quality scores, verdicts, adoption of revisions, scenarios, routing, jobs, benchmark effects and media timing."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
TIERS = ["高", "中", "低"]
TIER_SCORES = {"高": 1.0, "中": 0.5, "低": 0.0}
SCENARIOS = ["technical_process", "business_finance", "legal_contract", "marketing_pr", "daily_communication"]
SCENARIO_ALIASES = {
    "semiconductor_oi_cp_sop": "technical_process",
    "process_presentation": "technical_process",
    "international_standard": "legal_contract",
    "business_email": "business_finance",
}
PROFILE_SCENARIOS = {
    "technical_process": "technical_process",
    "business_finance": "business_finance",
    "legal_contract": "legal_contract",
    "marketing_pr": "marketing_pr",
    "daily_communication": "daily_communication",
    "semiconductor": "technical_process",
    "financial": "business_finance",
    "legal": "legal_contract",
    "government": "legal_contract",
}
DEGRADABLE = {"bilingual": [".docx", ".doc"], "adjacent": [".xlsx", ".xls"], "annotation": [".xlsx", ".xls"]}


def tier_score(tier: Column) -> Column:
    out = F.lit(0.0)
    for name, s in TIER_SCORES.items():
        out = F.when(tier == name, s).otherwise(out)
    return out


def worst_tier(scores: DataFrame, job: str) -> DataFrame:
    """Per job the lowest tier, mean score and all feedback in block order."""
    rank = F.array_position(F.array(*[F.lit(t) for t in reversed(TIERS)]), F.col("tier"))
    return scores.groupBy(job).agg(F.min_by("tier", rank).alias("tier"), F.avg(tier_score(F.col("tier"))).alias("mean"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("feedback") != "", F.struct("block", "feedback")))), lambda x: x["feedback"]), "; ").alias("feedback"))


def judge_tier(reply: Column) -> Column:
    """The tier of a judge's reply: the JSON score, else the first tier that is named, from high to low; null if none."""
    said = F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "$.score")
    named = F.coalesce(*[F.when(F.contains(reply, F.lit(t)), t) for t in TIERS])
    return F.coalesce(F.when(said.isin(*TIERS), said), named)


def adoptable(draft: Column, revised: Column) -> Column:
    """A revision that isn't blank or a failure, and 0.3 to 3 times as long as the draft."""
    ratio = F.length(revised) / F.greatest(F.length(draft), F.lit(1))
    return (T.strip(F.coalesce(revised, F.lit(""))) != "") & ~T.is_failure(revised) & ratio.between(0.3, 3.0)


def adopt(draft: Column, revised: Column) -> Column:
    """The strictly better score wins; a tie, or a score that is missing, keeps the draft."""
    return F.coalesce(revised > draft, F.lit(False))


def scenario(texts: DataFrame, keywords: DataFrame, key: str, text: str) -> DataFrame:
    """The scenario with most of its keywords in a text, the first of equals; general below two. ``keywords``: scenario, ord, words."""
    hay = F.lower(F.coalesce(text, F.lit("")))
    scored = texts.select(key, hay.alias("_t")).crossJoin(F.broadcast(keywords)).select(key, "scenario", "ord", F.size(F.filter("words", lambda w: F.contains(F.col("_t"), w))).alias("n"))  # one row per scenario
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "ord", "scenario")).alias("b"))
    return best.select(key, F.when(F.col("b.m") <= -2, F.col("b.scenario")).otherwise("general").alias("scenario"), (-F.col("b.m")).cast("long").alias("hits"))


def canonical_scenario(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SCENARIO_ALIASES.items() for x in kv])[c], c)


def profile_scenario(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PROFILE_SCENARIOS.items() for x in kv])[F.lower(T.strip(F.coalesce(c, F.lit(""))))]


def cache_variant(scenario_: Column, context: Column, translation_model: Column, digest: Column) -> Column:
    """Suffix that keeps cached results of another scenario, context or glossary apart."""
    return F.concat(scenario_, F.when(context, "_ctx").otherwise(""), F.when((scenario_ == "technical_process") & translation_model, "_glossary").otherwise(""), F.when(digest != "", F.concat(F.lit("_g"), digest)).otherwise(""), F.lit("_crit"))


def route(targets: DataFrame, rules: DataFrame, default: tuple[str, str]) -> DataFrame:
    """pos, target, model, provider: a rule counts only with both model and provider, else the default."""
    ok = rules.where("model is not null and model <> '' and provider is not null and provider <> ''")
    return targets.join(F.broadcast(ok), "target", "left").select("pos", "target", F.coalesce("model", F.lit(default[0])).alias("model"), F.coalesce("provider", F.lit(default[1])).alias("provider"))  # one rule per target language


def route_groups(routes: DataFrame) -> DataFrame:
    """Targets of each (model, provider), in their order, and the group's place."""
    g = routes.groupBy("model", "provider").agg(F.array_sort(F.collect_list(F.struct("pos", "target"))).alias("t"), F.min("pos").alias("first"))
    return g.select("model", "provider", "first", F.array_join("t.target", ",").alias("targets"))


def first_healthy(chains: DataFrame, providers: DataFrame, key: str) -> DataFrame:
    """The first provider in each chain that is enabled and healthy."""
    p = providers.where("enabled and healthy").select("provider")
    links = chains.select(key, F.posexplode("chain").alias("pos", "provider"))
    return links.join(F.broadcast(p), "provider", "left_semi").groupBy(key).agg(F.min_by("provider", "pos").alias("provider"))  # providers are a configuration table


def degrade_mode(mode: Column, ext: Column) -> Column:
    out = mode
    for m, exts in DEGRADABLE.items():
        out = F.when((mode == m) & ~ext.isin(*exts), "append").otherwise(out)
    return out


def output_name(stem: Column, ext: Column, as_pdf: Column, suffix: Column) -> Column:
    e = F.lower(ext)
    end = F.when(e == ".pdf", F.when(as_pdf, ".pdf").otherwise(".docx")).when(e == ".doc", ".docx").when(e == ".ppt", ".pptx").when(e == ".xls", ".xlsx").otherwise(e)
    return F.concat(stem, F.lit("_translated"), F.when(suffix == "", "").otherwise(F.concat(F.lit("_"), suffix)), end)


def evict(jobs: DataFrame, capacity: int, owner: str) -> DataFrame:
    """Jobs kept: the oldest finished ones go while an owner holds ``capacity`` or more; running ones stay."""
    finished = F.col("status").isin("completed", "failed")
    w = W.partitionBy(owner)
    ranked = jobs.withColumn("_all", F.count("*").over(w)).withColumn("_rank", F.row_number().over(W.partitionBy(owner, finished).orderBy("created_at", "job_id")))
    return ranked.where(~(finished & (F.col("_rank") <= F.col("_all") - capacity + 1))).drop("_all", "_rank")


def expire(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return jobs.where(~(F.col("status").isin("completed", "failed") & (F.col("created_at") < now - F.expr(f"interval {hours} hours"))))


def eta(done: Column, total: Column, elapsed: Column, critique_rounds: int, judge_rounds: int) -> Column:
    """Seconds left: segments at the rate so far, then critique and judge at their share of a segment's time."""
    rate = F.when(elapsed > 1.0, done / elapsed).otherwise(0.0)
    translate = F.when(rate > 0, F.greatest(total - done, F.lit(0)) / rate).otherwise(0.0)
    each = F.when(done > 0, elapsed / done).otherwise(0.0)
    return translate + total * each * max(critique_rounds, 1) + total * each * max(judge_rounds, 1)


def progress(status: Column, processed: Column, total: Column, file_done: Column, file_total: Column) -> Column:
    running = F.when(total > 0, (processed + F.when(file_total > 0, file_done / file_total).otherwise(0.0)) / total).otherwise(0.0)
    return F.when(status == "completed", 1.0).when(status.isin("stopped", "failed"), F.when(total > 0, processed / total).otherwise(0.0)).otherwise(running)


def composite(bleu: Column, chrf: Column, ter: Column) -> Column:
    return bleu * 0.40 + chrf * 0.45 + (F.lit(100.0) - ter) * 0.15


def effects(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """Grand mean, main effects and two-way cells in one pass over grouping sets: effect, level, mean, n."""
    sets = [[], *[[f] for f in factors], *[list(p) for p in combinations(factors, 2)]]
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets], *factors).agg(F.grouping_id(*factors).alias("_g"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    effect, level = F.lit(""), F.lit("")
    for s in sets:
        mask = sum(1 << (len(factors) - 1 - i) for i, f in enumerate(factors) if f not in s)
        effect = F.when(F.col("_g") == mask, "*".join(s)).otherwise(effect)
        level = F.when(F.col("_g") == mask, F.concat_ws("*", *[F.col(c).cast("string") for c in s])).otherwise(level)
    return g.select(effect.alias("effect"), level.alias("level"), "mean", "n")


def best_setting(rows: DataFrame, model: str, setting: list[str], value: str) -> DataFrame:
    means = rows.groupBy(model, *setting).agg(F.avg(value).alias("mean"))
    return means.withColumn("_r", F.row_number().over(W.partitionBy(model).orderBy(F.desc("mean"), *setting))).where("_r = 1").drop("_r")


def transcript_lines(rows: DataFrame, targets: list[str]) -> DataFrame:
    """Lines of a bilingual transcript: time span, language, text, and a line per target."""
    head = F.concat(F.lit("["), T.clock(F.col("start")), F.lit(" - "), T.clock(F.col("end")), F.lit("] ["), F.coalesce("language", F.lit("unknown")), F.lit("] "), F.col("text"))
    rest = [F.concat(F.lit(f"  [{t}] "), F.coalesce(F.when(F.col("translated")[t] != "", F.col("translated")[t]), F.lit("(untranslated)"))) for t in targets]
    return rows.withColumn("lines", F.concat_ws("\n", head, *rest))


def speech_sessions(rows: DataFrame, key: str, gap: float) -> DataFrame:
    """Speech intervals joined where the silence between them is shorter than ``gap`` seconds: key, start, end, n."""
    w = W.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    opened = rows.withColumn("_new", F.coalesce((F.col("start") - reach >= gap).cast("int"), F.lit(0)))
    opened = opened.withColumn("_s", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return opened.groupBy(key, "_s").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_s")


def silences(sessions: DataFrame, key: str) -> DataFrame:
    """The intervals between speech, from 0."""
    w = W.partitionBy(key).orderBy("start")
    return sessions.select(key, F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("start"), F.col("start").alias("end")).where(F.col("end") > F.col("start"))


def split_spans(spans: DataFrame, seconds: float) -> DataFrame:
    """Spans cut at every ``seconds``."""
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / seconds), F.lit(1))
    cut = spans.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return cut.withColumn("end", F.least("end", F.col("start") + (F.col("i") + 1) * seconds)).withColumn("start", F.col("start") + F.col("i") * seconds).drop("i")
