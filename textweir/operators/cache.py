"""The translation cache as a Parquet table keyed by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts (key_hash) with their translation where it is cached: a hash equi-join."""
    return texts.join(cache.select("key_hash", "translation").dropDuplicates(["key_hash"]), "key_hash", "left")


def misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    return texts.join(cache.select("key_hash"), "key_hash", "left_anti")


def first_write_wins(batch: DataFrame, cache: DataFrame, *order: str) -> DataFrame:
    """Rows of a batch to append: the first of each key that the cache doesn't hold."""
    fresh = batch.join(cache.select("key_hash"), "key_hash", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(W.partitionBy("key_hash").orderBy(*order))).where("_n = 1").drop("_n")


def of_model(model: Column, name: str) -> Column:
    """Whether a cached row belongs to a model or one of its variants (``name::..``), in any case; ``_`` and ``%`` in the name are LIKE's."""
    return (F.lower(model) == name.lower()) | F.like(F.lower(model), F.lit(name.lower() + "::%"))


def clear_model(cache: DataFrame, name: str) -> DataFrame:
    return cache.where(~of_model(F.col("model"), name))


def purge_blank(cache: DataFrame) -> DataFrame:
    return cache.where(~F.coalesce(F.col("translation"), F.lit("")).rlike(r"(?U)^\s*$"))


def critique_key(key: Column) -> Column:
    """The key under which a critique's revision is cached."""
    return F.concat(key, F.lit(":c"))
