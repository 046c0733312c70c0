"""Operators on ordered segments: first seen, context, running budgets and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .folds import running


def first_seen(df: DataFrame, text: str, *order: str) -> DataFrame:
    """One row per distinct text, the first in order, with its multiplicity."""
    firsts = df.groupBy(text).agg(F.min(F.struct(*order)).alias("_at"), F.count("*").alias("n"))
    return firsts.select(text, *[F.col(f"_at.{o}").alias(o) for o in order], "n")


def context_window(df: DataFrame, partition: str, order: str, text: str, size: int = 2, chars: int = 300) -> DataFrame:
    """Adds context: up to ``size`` texts before, one a line, the last ``chars`` characters of them."""
    w = W.partitionBy(partition).orderBy(order).rowsBetween(-size, -1)
    joined = F.array_join(F.collect_list(text).over(w), "\n")
    return df.withColumn("context", F.when(F.length(joined) > chars, F.right(joined, F.lit(chars))).otherwise(joined))


def sample_prefix(df: DataFrame, partition: str, order: str, text: str, chars: int = 500) -> DataFrame:
    """The first ``chars`` characters of each group's texts, one a line; reading stops once the texts before reach them."""
    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = df.withColumn("_before", before).where(F.col("_before") < chars)
    return kept.groupBy(partition).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_t")).select(partition, F.substring(F.array_join(F.col(f"_t.{text}"), "\n"), 1, chars).alias("sample"))


def budget_prefix(df: DataFrame, partition: str | None, order: list[Column], cost: Column, budget: Column | float) -> DataFrame:
    """Rows up to, and without, the first whose running cost passes the budget; without a partition over all rows."""
    if not partition:
        return running(df, order, cost).where(F.col("total") <= budget).drop("position", "total")
    w = W.partitionBy(partition).orderBy(*order)
    return df.withColumn("_run", F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("_run") <= budget).drop("_run")


def overlap_tail(df: DataFrame, partition: str, order: str, tokens: str, overlap: int) -> DataFrame:
    """The shortest run of last rows whose tokens reach ``overlap``."""
    later = F.coalesce(F.sum(tokens).over(W.partitionBy(partition).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_later", later).where(F.col("_later") < overlap).drop("_later")


def restore(segments: DataFrame, translations: DataFrame, keys: list[str], null_safe: str | None = None) -> DataFrame:
    """Every segment with its translation where there is one; ``null_safe`` names a key column where null equals null."""
    t = translations.select(*[F.col(k).alias(f"_{k}") for k in keys], *([F.col(null_safe).alias(f"_{null_safe}")] if null_safe else []), "target", "value")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    if null_safe:
        on = on & F.col(null_safe).eqNullSafe(F.col(f"_{null_safe}"))
    return segments.join(t, on, "left").drop(*[c for c in t.columns if c.startswith("_")])


def with_all_targets(restored: DataFrame, key: list[str], targets: int) -> DataFrame:
    """Keys for which every one of the targets has a translation."""
    return restored.where(F.col("value").isNotNull()).groupBy(*key).agg(F.count_distinct("target").alias("n_targets")).where(F.col("n_targets") == targets)
