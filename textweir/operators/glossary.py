"""Which glossary terms apply to a text, enforcing them, and auditing their use."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of the gram by which terms and tokens meet; shorter terms meet by all they have.
GRAM = 3
#: Query vectors in a broadcast block.
BLOCK = 4_096


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def occurring(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """_h, needle for every needle that a text (_h, _t) contains; a needle of spaces alone is none.

    Both sides are distinct and lower-cased by the caller. A needle's longest
    token lies within some token of a text that contains it; so the distinct
    tokens of all texts meet the needles by an equi-join on the first ``GRAM``
    characters of that longest token, exploded from each distinct token's own
    substrings, and texts get their needles from their tokens. Only a needle of
    several tokens is looked for in the text itself. No side is broadcast and
    nothing is compared with everything.
    """
    n = needles.withColumn("_k", F.element_at(F.array_sort(F.transform(_tokens(F.col("needle")), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]).where("_k is not null")
    n = n.withColumn("_g", F.left("_k", F.lit(GRAM)))
    postings = texts.select("_h", F.explode(F.array_distinct(_tokens(F.col("_t")))).alias("_w"))
    words = postings.select("_w").distinct()
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda k: F.when(F.length("_w") >= k, F.transform(F.sequence(F.lit(1), F.length("_w") - k + 1), lambda i: F.substring(F.col("_w"), i, k))).otherwise(F.array().cast("array<string>")))))
    met = words.select("_w", F.explode(grams).alias("_g")).join(n, "_g").where(F.contains(F.col("_w"), F.col("_k"))).select("_w", "needle", (F.col("needle") == F.col("_k")).alias("_whole"))
    pairs = postings.join(met, "_w").select("_h", "needle", "_whole").distinct()
    several = pairs.where("not _whole").join(texts, "_h").where(F.contains(F.col("_t"), F.col("needle"))).select("_h", "needle")
    return pairs.where("_whole").select("_h", "needle").unionByName(several)


def applicable(texts: DataFrame, terms: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, term_id, source_text, target_text for every term that occurs in a text, in any case; a blank term occurs nowhere."""
    low = texts.select(*key, F.lower(text).alias("_t")).where("_t <> ''").withColumn("_h", F.sha2("_t", 256))
    t = terms.select(F.col("id").alias("term_id"), "source_text", "target_text", F.lower("source_text").alias("needle"))
    hits = occurring(low.select("_h", "_t").distinct(), t.select("needle").distinct())
    return low.select(*key, "_h").join(hits, "_h").join(t, "needle").select(*key, "term_id", "source_text", "target_text")


def enforce(drafts: DataFrame, hits: DataFrame, key: list[str], draft: str = "draft") -> DataFrame:
    """Drafts with every applicable term's target that they lack appended, in term order; tested as the text grows, by case."""
    listed = hits.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("term_id", "target_text"))).alias("_h"))
    out = F.aggregate(F.coalesce("_h", F.array()), F.col(draft), lambda a, h: F.when(F.contains(a, h["target_text"]), a).otherwise(F.concat(F.regexp_replace(a, r"(?U)\s+$", ""), F.lit(" "), h["target_text"])))
    return drafts.join(listed, key, "left").withColumn("enforced", out).drop("_h")


def match_rate(drafts: DataFrame, hits: DataFrame, key: list[str], draft: str) -> DataFrame:
    """Share of each draft's applicable terms whose target it holds, in any case; 1 where none applies."""
    rated = drafts.join(hits, key).groupBy(*key).agg(F.avg(F.contains(F.lower(draft), F.lower("target_text")).cast("double")).alias("_r"))
    return drafts.join(rated, key, "left").select(*key, F.coalesce("_r", F.lit(1.0)).alias("rate"))


def audit(translations: DataFrame, terms: DataFrame, job: str, value: str) -> DataFrame:
    """Per job: hit rate of approved terms in its translations, those not applied, and rejected ones that leaked as words.

    A term is applied where a translation, or two in a row (sorted, a space
    between), contain its target in any case; so no job's whole text is ever one
    value, and a target has to lie within two translations. Distinct targets meet
    distinct texts through their tokens.
    """
    w = W.partitionBy(job).orderBy(F.lower(value))
    low = translations.where(F.col(value).isNotNull()).select(job, F.lower(value).alias("_v"), F.lag(F.lower(value)).over(w).alias("_before"))
    said = low.select(job, F.concat_ws(" ", "_before", "_v").alias("_t")).distinct().withColumn("_h", F.sha2("_t", 256))
    reviewed = terms.where("status in ('approved', 'rejected')").select("source_text", F.lower("target_text").alias("needle"), "status")
    texts = said.select("_h", "_t").distinct()
    found = occurring(texts, reviewed.select("needle").distinct())
    quoted = F.concat(F.lit(r"(?U)\b"), F.regexp_replace("needle", r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit(r"\b"))
    worded = found.join(texts, "_h").withColumn("_q", quoted).select("_h", "needle", F.expr("regexp_like(_t, _q)").alias("_word"))
    per = said.select(job, "_h").join(worded, "_h").groupBy(job, "needle").agg(F.bool_or("_word").alias("_word"))
    ok = F.col("status") == "approved"
    hits = per.join(reviewed, "needle").where((F.col("status") == "approved") | F.col("_word"))
    ok = F.col("status") == "approved"
    # One row: the approved terms, which every job's answer lists or counts.
    everything = reviewed.where(ok).agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct("source_text", "needle"))).alias("_all"))
    of_job = hits.groupBy(job).agg(F.count_if(ok).alias("_m"), F.collect_set(F.when(ok, F.col("needle"))).alias("_n"), F.array_sort(F.collect_list(F.when(~ok, F.col("source_text")))).alias("_r"))
    out = translations.select(job).distinct().crossJoin(F.broadcast(everything)).join(of_job, job, "left")
    none = F.array().cast("array<string>")
    missed = F.transform(F.filter("_all", lambda x: ~F.coalesce(F.array_contains("_n", x["needle"]), F.lit(False))), lambda x: x["source_text"])
    matched = F.coalesce("_m", F.lit(0)).cast("long")
    return out.select(job, "total", matched.alias("matched"), missed.alias("unapplied"), F.coalesce("_r", none).alias("rejected_injections"), F.when(F.col("total") == 0, 1.0).otherwise(matched / F.col("total")).alias("hit_rate"))


def state_digest(terms: DataFrame, group: str) -> DataFrame:
    """group, digest: first eight hex digits of the digest of all its pairs in order, streamed through one running digest a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done = None, None, []
        for pdf in batches:
            for g, pair in zip(pdf["_g"], pdf["_p"]):
                if state is None or g != now:
                    if state is not None:
                        done.append((now, state.hexdigest()[:8]))
                    now, state = g, hashlib.sha256()
                    state.update(pair.encode())
                else:
                    state.update(b"\n" + pair.encode())
            yield pd.DataFrame(done, columns=[group, "digest"])
            done = []
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest()[:8])], columns=[group, "digest"])

    pairs = terms.select(F.col(group).alias("_g"), F.concat_ws("\u0000", "source_text", "target_text").alias("_p"))
    return pairs.repartition("_g").sortWithinPartitions("_g", "_p").mapInPandas(run, f"{group} string, digest string")


def similarity(queries: DataFrame, candidates: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Candidates whose largest cosine to any query reaches ``least``; a zero vector, or one of another length, is none.

    Queries come in blocks of ``BLOCK`` unit vectors, each broadcast for one scan
    of the candidates: two matrices are multiplied per batch and block.
    """
    spark = queries.sparkSession
    some = lambda df: df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("_v")).where(F.exists("_v", lambda x: x != 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x)))
    schema = f"{key} long, s double"

    def scan(sent, n: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    c = np.stack(pdf["_v"].to_numpy())
                    yield pd.DataFrame({key: pdf[key], "s": ((c / np.linalg.norm(c, axis=1, keepdims=True)) @ sent.value.T).max(1)})

        return some(candidates).where(F.size("_v") == n).mapInPandas(run, schema)

    out, held = spark.createDataFrame([], schema), {}
    rows = some(queries).select("_v").toLocalIterator()
    for v in chain((r[0] for r in rows), [None]):
        if v is not None:
            held.setdefault(len(v), []).append(v)
        for n in [n for n, x in held.items() if len(x) >= BLOCK or v is None]:
            q = np.array(held.pop(n))
            out = out.unionByName(scan(spark.sparkContext.broadcast(q / np.linalg.norm(q, axis=1, keepdims=True)), n))
    return out.groupBy(key).agg(F.max("s").alias("score")).where(F.col("score") >= least)


def by_window(df: DataFrame, partition: str, order, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(partition).orderBy(*order))).where(F.col("rank") <= n)
