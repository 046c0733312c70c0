"""Order-dependent folds over sorted rows, streamed: no group is ever held whole, however many rows it has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def fold_sorted(df: DataFrame, key: str, order: str, costs: list[str], start: Callable[[], tuple], step: Callable[..., tuple], added: str) -> DataFrame:
    """key, order and the columns ``added``, the first of each state ``step(state, *costs)`` gives, row by row within a key.

    Keys are dealt out by hash and sorted; a task keeps one state, that of the
    key it is in, whatever the size of the group.
    """
    kinds = dict(df.dtypes)
    names = [c.split()[0] for c in added.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            rows = []
            for k, *xs in zip(pdf[key], *(pdf[c] for c in costs)):
                if k != now:
                    now, state = k, start()
                state = step(state, *xs)
                rows.append(state[: len(names)])
            yield pd.concat([pdf[[key, order]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    dealt = df.select(key, order, *costs).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {added}")


def batch_start() -> tuple:
    return (0, 0, 0)


def greedy_step(cap: int) -> Callable:
    """(batch, used, pieces): a row starts the next batch where it would take the open one over ``cap``."""

    def step(state: tuple, size: int) -> tuple:
        batch, used, pieces = state
        if pieces and used + size > cap:
            return batch + 1, size, 1
        return batch, used + size, pieces + 1

    return step


def marked_step(cap: int, most: int) -> Callable:
    """(batch, place, used): texts under numbered markers, a line end behind each; the first after a flush doesn't count its own."""

    def step(state: tuple, size: int) -> tuple:
        batch, place, used = state
        piece = size + len(f"<<<SEG_{place + 1}>>>\n") + 1
        if place >= 0 and (used + piece > cap or place + 1 >= most):
            return batch + 1, 0, size + len("<<<SEG_0>>>\n")
        return batch, place + 1, used + piece

    return step


def unit_step(cap: int) -> Callable:
    """(chunk, used): units joined by line ends; the first of a chunk after a flush counts its own length alone."""

    def step(state: tuple, size: int) -> tuple:
        chunk, used, pieces = state
        if pieces and used + size + 1 > cap:
            return chunk + 1, size, 1
        return chunk, used + size + 1, pieces + 1

    return step


def greedy_batches(df: DataFrame, partition: str, order: str, size: Column, cap: int) -> DataFrame:
    """partition, order, batch."""
    return fold_sorted(df.withColumn("_n", size.cast("long")), partition, order, ["_n"], batch_start, greedy_step(cap), "batch long")


def marked_batches(df: DataFrame, partition: str, order: str, text: str, cap: int, most: int = 4) -> DataFrame:
    """partition, order, batch, place of the texts that aren't blank: merged messages of at most ``most`` texts and about ``cap`` characters."""
    kept = df.where(~F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")).withColumn("_n", F.length(text).cast("long"))
    return fold_sorted(kept, partition, order, ["_n"], lambda: (0, -1, 0), marked_step(cap, most), "batch long, place long")


def unit_chunks(df: DataFrame, partition: str, order: str, text: str, cap: int) -> DataFrame:
    """partition, chunk, text: stripped units that aren't blank, a line each, in chunks of at most ``cap`` characters."""
    units = df.withColumn("_u", F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")).where("_u <> ''").withColumn("_n", F.length("_u").cast("long"))
    at = fold_sorted(units, partition, order, ["_n"], batch_start, unit_step(cap), "chunk long")
    return units.join(at, [partition, order]).groupBy(partition, "chunk").agg(F.array_sort(F.collect_list(F.struct(order, "_u"))).alias("u")).select(partition, "chunk", F.array_join("u._u", "\n").alias("text"))


def running(df: DataFrame, order: list[Column], cost: Column) -> DataFrame:
    """Adds position (from 1) and total, the running sum of ``cost``, over all rows in order, without one task for all rows.

    Rows are sorted in ranges and checkpointed; each range adds what the ranges
    before it hold, of which one row a range goes through one task.
    """
    placed = cut(df.withColumn("_c", cost).orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33))
    sums = placed.groupBy("_p").agg(F.sum("_c").alias("_s"), F.count("*").alias("_n"))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_k"))
    within = W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, 0)
    joined = placed.withColumn("_t", F.sum("_c").over(within)).join(F.broadcast(base), "_p")  # a row a range
    return joined.withColumn("position", (F.col("_k") + F.col("_m") - F.shiftleft(F.col("_p"), 33) + 1).cast("long")).withColumn("total", F.col("_b") + F.col("_t")).drop("_c", "_m", "_p", "_t", "_b", "_k")
