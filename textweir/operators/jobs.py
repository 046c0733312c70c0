"""Jobs around the translation: model slots, aligned scores, totals, warnings, clean-up, samples and reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quality import DEGRADABLE, degrade_mode

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-(.*?))?\}")
IMPORT_CONFIDENCE = 0.9


def expand_variables(value: str, env: dict[str, str]) -> tuple[str, bool]:
    """``${NAME}`` and ``${NAME:-default}`` filled in; False if one that has no default isn't set, which stays empty."""
    missing = [m[1] for m in _VARIABLE.finditer(value) if m[1] not in env and m[2] is None]
    return _VARIABLE.sub(lambda m: env.get(m[1], m[2] or ""), value), not missing


def providers(spark, registry: list[dict], env: dict[str, str]) -> DataFrame:
    """provider, pos, enabled, models, settings of a configuration's list; one whose variables can't all be filled in is disabled."""
    rows = []
    for pos, p in enumerate(registry):
        ok, settings, models = True, {}, {}
        for kind, source in ((settings, {k: v for k, v in p.items() if isinstance(v, str) and k != "id"}), (models, p.get("models") or {})):
            for k, v in source.items():
                kind[k], all_set = expand_variables(str(v), env)
                ok = ok and all_set
        rows.append((p["id"], pos, bool(p.get("enabled", True)) and ok, models, settings))
    return spark.createDataFrame(rows, "provider string, pos int, enabled boolean, models map<string,string>, settings map<string,string>")


def resolve_slots(requested: DataFrame, providers_: DataFrame) -> DataFrame:
    """pos, model, provider of each requested name (pos, name): a model of the first provider that has it, or a provider's own id, which stands for its translating model; else unknown.

    An id whose provider has no such model gives no slot. Providers are a
    configuration's few rows.
    """
    p = providers_.select("provider", F.col("pos").alias("_p"), "models")
    met = requested.join(F.broadcast(p), F.array_contains(F.map_values("models"), F.col("name")) | (F.col("name") == F.col("provider")), "left")
    first = met.groupBy("pos", "name").agg(F.min_by(F.struct("provider", "models"), "_p").alias("b"))
    by_model = F.array_contains(F.map_values("b.models"), F.col("name"))
    model = F.when(F.col("b").isNull() | by_model, F.col("name")).otherwise(F.col("b.models")["translate"])
    return first.select("pos", model.alias("model"), F.coalesce("b.provider", F.lit("unknown")).alias("provider")).where("model is not null")


def align_scores(blocks: DataFrame, scores: DataFrame, per_block: int = 1) -> DataFrame:
    """Scores (idx, score) to blocks (block_id, idx) by position; with several a block, its own are ``per_block`` in a row: block_id, k, score."""
    s = scores.select(F.floor(F.col("idx") / per_block).cast("long").alias("idx"), (F.col("idx") % per_block).cast("long").alias("k"), "score")
    return blocks.join(s, "idx").select("block_id", "k", "score")


def term_totals(files: DataFrame) -> DataFrame:
    """Sums over a job's files of what was extracted, skipped and added."""
    return files.groupBy("job_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("extracted", "skipped", "added")])


def unique_terms(found: DataFrame) -> DataFrame:
    """The first of equal (source_text, target_text) over all targets, in order (pos)."""
    return found.groupBy("source_text", "target_text").agg(F.min("pos").alias("pos"))


def judged(jobs: DataFrame, unjudged_providers: list[str]) -> DataFrame:
    """Jobs that the judge sees: not those whose provider is its own family."""
    return jobs.where(~F.lower(F.coalesce("provider", F.lit(""))).isin([p.lower() for p in unjudged_providers]))


def output_mode(mode: Column, ext: Column, n_targets: Column) -> tuple[Column, Column]:
    """The mode that is used and the warning that goes with it, null if none: several targets, and modes a file's kind lacks, mean append."""
    asked = F.when((mode == "replace") & (n_targets > 1), "append").otherwise(mode)
    used = degrade_mode(asked, ext)
    said = F.when(mode == "bilingual", F.lit("bilingual")).otherwise(F.concat(F.lit("'"), mode, F.lit("'")))
    fell = F.lit(False)
    for m, exts in DEGRADABLE.items():
        fell = fell | ((asked == m) & ~ext.isin(*exts))
    return used, F.when(fell, F.concat(said, F.lit(" output_mode is not supported for '"), ext, F.lit("' files; falling back to append"))).when(asked != mode, F.lit("replace output_mode takes one target; falling back to append"))


def output_tag(targets: Column, groups: Column) -> Column:
    """First two letters of each target, lower-cased, where there is more than one group of targets."""
    return F.when(groups > 1, F.array_join(F.transform(targets, lambda t: F.lower(F.left(t, F.lit(2)))), "_")).otherwise("")


def orphans(folders: DataFrame, jobs: DataFrame) -> DataFrame:
    """Folders (job_id) without a job."""
    return folders.join(jobs.select("job_id"), "job_id", "left_anti")


def with_status(terms: DataFrame) -> DataFrame:
    """Terms of an older table: a missing status column is added, unverified."""
    return terms if "status" in terms.columns else terms.withColumn("status", F.lit("unverified"))


def imported(looked_up: DataFrame) -> DataFrame:
    """Term rows of lookup results: fixed confidence, unverified, their entity in the snippet; to be merged."""
    snippet = F.when(F.coalesce("entity_id", F.lit("")) != "", F.concat(F.lit("wikidata:"), "entity_id")).otherwise("")
    return looked_up.select("source_text", "target_text", "source_lang", "target_lang", "domain", snippet.alias("context_snippet"), F.lit(IMPORT_CONFIDENCE).alias("confidence"), F.lit(0).cast("long").alias("usage_count"), F.lit("unverified").alias("status"))


def label_of(labels: Column, codes: list[str]) -> Column:
    """The first label that isn't empty, by the codes in their order."""
    return F.get(F.filter(F.array(*[labels[c] for c in codes]), lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))


def benchmark_sample(rows: DataFrame, per_pair: int, seed: int, low: int = 4, high: int = 500) -> DataFrame:
    """At most ``per_pair`` rows of each pair whose stripped source and reference aren't empty and whose source has a fair length, by a seeded hash, in the source's order."""
    fine = rows.withColumn("source", F.trim("source")).withColumn("reference", F.trim("reference")).where((F.col("reference") != "") & F.length("source").between(low, high))
    drawn = fine.withColumn("_r", F.row_number().over(W.partitionBy("pair").orderBy(F.xxhash64(F.lit(seed), "pair", "id"), "id"))).where(F.col("_r") <= per_pair)
    return drawn.withColumn("pos", (F.row_number().over(W.partitionBy("pair").orderBy("id")) - 1).cast("long")).drop("_r")


def merged_views(old: DataFrame, new: DataFrame) -> DataFrame:
    """Layout views (job_id, file_name, page, view) of a job by file: a file that comes again replaces its old pages."""
    kept = old.join(new.select("job_id", "file_name").distinct(), ["job_id", "file_name"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def view_json(views: DataFrame) -> DataFrame:
    """job_id, view_json: ``{"files": {name: {file_name, total_pages, pages}}}``, files by name, pages in order."""
    files = views.groupBy("job_id", "file_name").agg(F.count("*").alias("total_pages"), F.transform(F.array_sort(F.collect_list(F.struct("page", "view"))), lambda x: x["view"]).alias("pages"))
    whole = F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_name", F.struct("file_name", "total_pages", "pages").alias("f")))))
    return files.groupBy("job_id").agg(F.to_json(F.struct(whole.alias("files"))).alias("view_json"))


def deltas(rows: DataFrame, factor: str, value: str) -> DataFrame:
    """low, high, delta for every pair of a factor's levels: the mean at the greater level less that at the smaller. Levels are few."""
    means = rows.groupBy(F.col(factor).cast("string").alias("level")).agg(F.avg(value).alias("m"))
    listed = means.agg(F.array_sort(F.collect_list(F.struct("level", "m"))).alias("l"))
    pair = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda b: F.struct(a["level"].alias("low"), b["level"].alias("high"), (b["m"] - a["m"]).alias("delta")))))
    return listed.select(F.explode(pair).alias("p")).select("p.*")


def all_deltas(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """factor, low, high, delta over all factors."""
    out = None
    for f in factors:
        one = deltas(rows, f, value).select(F.lit(f).alias("factor"), "low", "high", "delta")
        out = one if out is None else out.unionByName(one)
    return out


def incremental(rows: DataFrame, base: dict, added: dict, value: str) -> DataFrame:
    """base, added, delta: the mean of rows with all of ``added`` less that of rows with all of ``base``."""
    meets = lambda want: F.expr(" and ".join(f"{k} = {v!r}" for k, v in want.items()) or "true")
    return rows.agg(F.avg(F.when(meets(base), F.col(value))).alias("base"), F.avg(F.when(meets(added), F.col(value))).alias("added")).withColumn("delta", F.col("added") - F.col("base"))


def metric_fallback(faces: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted face the registered one of nearest metrics, x-height counting three, cap height two, advance one; the first of equals, never itself.

    ``faces`` is a font registry's few rows (face, pos, x_height, cap_height, advance).
    """
    w = wanted.select(F.col("face").alias("wanted"), *[F.col(c).alias(f"_{c}") for c in ("x_height", "cap_height", "advance")])
    away = sum((weight * F.abs(F.col(c) - F.col(f"_{c}")) for c, weight in (("x_height", 3.0), ("cap_height", 2.0), ("advance", 1.0))), F.lit(0.0))
    met = w.join(F.broadcast(faces), F.col("face") != F.col("wanted"), "left").withColumn("d", away)
    return met.groupBy("wanted").agg(F.min_by("face", F.struct("d", "pos")).alias("face")).withColumn("face", F.coalesce("face", F.lit("Helvetica")))


def missing_ids(everything: DataFrame, included: DataFrame, key: list[str]) -> DataFrame:
    return everything.select(*key).distinct().join(included.select(*key).distinct(), key, "left_anti")

