"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

Text is lower-cased and everything but letters becomes a space; the n-grams of
1 to 3 characters are hashed into a fixed number of buckets. Training counts
(language, bucket) over every training row, in the executors, and stores them.
The log-probability matrix is broadcast, ``SHARD_LANGS`` languages at a time, so
at most that many times ``BUCKETS`` numbers reach the driver at once. Scoring is
sparse: a batch's n-grams pick rows of the matrix, summed per document. With
more languages than a shard holds, documents are stored once with a number for
each row and scored shard by shard; the best totals and the normalisers meet by
that number.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no row can be learned from; of equal scores the smaller
language name wins; repeated rows are scored each; a null id is never held out;
a long text is cut into overlapping pieces, whose n-grams are the whole's; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, fold, map_text, masked, segment_sum, segments, stage, table

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Languages in a broadcast matrix.
SHARD_LANGS = 64
#: Characters of a text in a piece, and of all pieces that are worked on at once.
PIECE, RUN = 200_000, 400_000
#: Added to each count.
ALPHA = 0.5
UND = "und"
_kinds: tuple[np.ndarray, np.ndarray] | None = None


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and each code point's lower case, one for one."""
    global _kinds
    if _kinds is None:
        _kinds = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), np.fromiter((ord(chr(i).lower()[0]) for i in range(0x110000)), np.uint32, 0x110000)
    return _kinds


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Runs of pieces: whose each is, the piece with what its last n-grams reach into, and how many n-grams begin in it. Spaces stand around a text."""
    owner, part, own, size = [], [], [], 0
    for k, t in enumerate(texts):
        t = f" {t} "
        for a in range(0, len(t), PIECE):
            owner.append(k)
            part.append(t[a : a + PIECE + max(ORDERS) - 1])
            own.append(min(PIECE, len(t) - a))
            size += len(part[-1])
            if size >= RUN:
                yield owner, part, own
                owner, part, own, size = [], [], [], 0
    if part:
        yield owner, part, own


def ngrams(part: list[str], own: list[int]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order the buckets of the n-grams that begin in each piece and the bounds of each piece's; and whether each piece has a letter."""
    points = [code_points(t) for t in part]
    bounds = segments(np.array([len(p) for p in points], np.int64))
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    is_letter, lower = letters()
    flat = lower[flat]
    alpha = is_letter[flat]
    has = segment_sum(alpha, bounds) > 0
    c = np.where(alpha, flat, 32).astype(np.uint64)
    found, places = [], []
    starts = np.arange(len(c))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    begun = starts < np.repeat(bounds[:-1] + np.array(own, np.int64), np.diff(bounds))
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k : k + m]
        # Inside one piece, and not of spaces alone.
        ok = begun[:m] & (starts[:m] + n <= ends[:m]) & np.logical_or.reduce([alpha[k : k + m] for k in range(n)])
        found.append(((h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32))
        places.append(segments(ok.astype(np.int64))[np.minimum(bounds, m)])
    return found, places, has


def count(docs: DataFrame) -> DataFrame:
    """lang, bucket, n of all rows with text and language; the last bucket counts the rows. At most ``BUCKETS`` + 1 rows a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                mine = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                for _, part, own in pieces(texts.tolist()):
                    for h in ngrams(part, own)[0]:
                        mine[:BUCKETS] += np.bincount(h, minlength=BUCKETS)
                mine[BUCKETS] += len(texts)
                if len(held) > SHARD_LANGS:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    def rows(held: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": counts[at]})

    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def matrix_of(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Log probabilities (bucket, language), with the log priors, up to a constant, as the last row."""
    got = counts.where(F.col("lang").isin(langs)).toPandas()  # SHARD_LANGS * (BUCKETS + 1) rows at most
    matrix = np.zeros((BUCKETS + 1, len(langs)))
    place = {g: k for k, g in enumerate(langs)}
    np.add.at(matrix, (got["bucket"].to_numpy(), got["lang"].map(place).to_numpy(np.int64)), got["n"].to_numpy())
    grams = matrix[:BUCKETS] + ALPHA
    matrix[:BUCKETS] = np.log(grams) - np.log(grams.sum(0))
    matrix[BUCKETS] = np.log(matrix[BUCKETS] + 1)
    return matrix


def totals(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text with each language, and whether it has a letter."""
    total, has = np.tile(matrix[BUCKETS], (len(texts), 1)), np.zeros(len(texts), bool)
    for owner, part, own in pieces(texts):
        found, places, some = ngrams(part, own)
        for h, at in zip(found, places):
            np.add.at(total, owner, segment_sum(matrix[h], at))
        np.logical_or.at(has, owner, some)
    return total, has


def _scored(docs: DataFrame, counts: DataFrame, langs: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` with _lang (null without letters), _best (its log probability) and _all (that of all ``langs`` together)."""
    sent = docs.sparkSession.sparkContext.broadcast(matrix_of(counts, langs))  # SHARD_LANGS * (BUCKETS + 1) numbers at most

    def compute(texts: list[str]) -> list:
        total, has = totals(texts, sent.value)
        best = total.max(1)
        return [[langs[b] if ok else None for b, ok in zip(total.argmax(1), has)], best, best + np.log(np.exp(total - best[:, None]).sum(1))]

    return map_text(docs, keep, "_lang string, _best double, _all double", compute, RUN)


def predict(docs: DataFrame, training: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score, from the column ``text`` alone; learned from ``training`` (lang, text)."""
    counts = stage(count(training), "ngrams")
    langs = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]  # names of languages
    known = F.col("_lang").isNotNull()
    answer = [F.coalesce("_lang", F.lit(UND)).alias("lang_pred"), F.when(known, F.exp(F.col("_best") - F.col("_all"))).otherwise(0.0).alias("score")]
    if not langs:
        return docs.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(langs) <= SHARD_LANGS:
        return _scored(docs, counts, langs, keep).select(*keep, *answer)
    numbered = stage(docs.select(*keep, *[c for c in ("text",) if c not in keep]).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = None
    for a in range(0, len(langs), SHARD_LANGS):
        one = stage(_scored(numbered, counts, langs[a : a + SHARD_LANGS], ["_row"]).withColumn("_shard", F.lit(-a)), "shard")
        found = one if found is None else found.unionByName(one)
    top = found.groupBy("_row").agg(F.max(F.struct("_best", "_shard", "_lang")).alias("t"), F.collect_list("_all").alias("a"))  # a row a shard
    most = F.array_max("a")
    top = top.select("_row", F.col("t._lang").alias("_lang"), F.col("t._best").alias("_best"), (most + F.log(F.aggregate("a", F.lit(0.0), lambda s, x: s + F.exp(x - most)))).alias("_all"))
    return numbered.join(top, "_row").select(*keep, *answer)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return predict(docs.withColumn("held_out", held), docs.where(~held), ["doc_id", "held_out"])


def filter_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is identified with a score of ``least`` or more and isn't another than the one they claim, with their own columns.

    A claim counts where it is a language that was learned; a null one is none.
    """
    apart, names, back = masked(docs, "doc_id", "text", "lang")
    training = apart.where(F.coalesce(fold(F.col("doc_id"), 3) != 1, F.lit(True)))
    learned = [r.lang for r in training.where("lang is not null and text is not null").select("lang").distinct().collect()]  # names of languages
    claimed = F.coalesce(F.col("lang").isin(learned), F.lit(False)) if learned else F.lit(False)
    found = predict(apart, training, [*names, "lang"])
    return back(found.where((F.col("lang_pred") != UND) & (F.col("score") >= least) & (~claimed | (F.col("lang") == F.col("lang_pred")))))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
