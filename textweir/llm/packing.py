"""Operator 5: best-fit packing of token sequences by minimum bin slack.

A document longer than the sequence length is cut into whole sequences, its
first piece taking what is left over; so each document leaves at most one piece
shorter than a sequence. Only the counts of those lengths, at most
``capacity - 1`` numbers, decide the packing: per bin, the longest waiting
length is set and a bitset subset-sum table over the available lengths finds
the fullest feasible completion, which is removed as often as its lengths last.
Each such plan row empties some length, so there are fewer rows than lengths.
Pieces then find their place from their rank among those of their length; ranks
come from counts by (length, salt), so a length that a third of all rows have
is spread over many tasks.

Defined cases: a null or empty text is the end id alone; rows with equal ids
are packed apart, as many as there are; a null id is kept; a long text is encoded
in runs and makes as many whole sequences as it holds; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, parallelism, settle, stage, table
from .token_output import END_ID, tokenizer

CAPACITY = 1024
#: With ``lean``: texts encoded at once, and pieces a worker keeps; less memory for more work.
LEAN_ROWS, LEAN_PIECES = 500, 100_000


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, times in each bin)])] that uses up ``counts``."""
    left = {n: c for n, c in counts.items() if c}
    plan = []
    while left:
        lengths = sorted(left, reverse=True)
        room = capacity - lengths[0]
        # reach[i]: sums of lengths[i:], as bits, with the multiplicities at hand.
        mask, reach = (1 << (room + 1)) - 1, [1]
        for n in reversed(lengths):
            bits, most = reach[-1], min(left[n] - (n == lengths[0]), room // n)
            step = 1
            while most > 0:  # binary split of the multiplicity
                use = min(step, most)
                bits |= (bits << (use * n)) & mask
                most, step = most - use, step * 2
            reach.append(bits)
            if bits >> room & 1 and n != lengths[0]:
                reach += [bits] * (len(lengths) + 1 - len(reach))
                break
        reach.reverse()
        want = reach[0].bit_length() - 1
        uses = {lengths[0]: 1}
        for i, n in enumerate(lengths):
            most = min(left[n] - uses.get(n, 0), want // n)
            # Most of the longest length after which the shorter ones still reach the rest.
            k = next(k for k in range(most, -1, -1) if reach[i + 1] >> (want - k * n) & 1)
            if k:
                uses[n] = uses.get(n, 0) + k
                want -= k * n
            if not want:
                break
        bins = min(left[n] // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
        plan.append((bins, sorted(uses.items(), reverse=True)))
    return plan


def tokenised(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, lean: bool = False) -> DataFrame:
    """doc_id, n (ids with the end id), piece_crcs: one row per document."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        settle()
        tok = tokenizer(vocabulary)
        tok.LIMIT = LEAN_PIECES if lean else type(tok).LIMIT
        if lean:
            give_back()  # what the stages before left
        rows = LEAN_ROWS if lean else 1 << 40
        for batch in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
            ids, k = batch.column(0), 0
            for n, flat, at in tok.closed(pc.fill_null(batch.column(1), ""), END_ID):
                raw, crcs = memoryview(flat.astype("<u4", copy=False)).cast("B"), []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    cuts = [a, *range(a + ((b - a) % capacity or capacity), b + 1, capacity)]
                    crcs.append([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cuts[:-1], cuts[1:])])
                yield pa.RecordBatch.from_arrays([ids.slice(k, n), pa.array(np.diff(at)), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n", "piece_crcs"])
                k += n
            if lean:
                give_back()
        tok.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, piece_crcs array<long>")


def _ranked(rows: DataFrame, key: str, salts: int) -> DataFrame:
    """Adds r, a rank from 0 within ``key``, without gathering a key's rows in one task."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy(key, "_s").count()
    base = counts.select(key, "_s", (F.sum("count").over(W.partitionBy(key).orderBy("_s")) - F.col("count")).alias("_b"))
    local = salted.withColumn("_r", F.row_number().over(W.partitionBy(key, "_s").orderBy("doc_id", "piece")) - 1)
    return local.join(base, [key, "_s"]).withColumn("r", (F.col("_b") + F.col("_r")).cast("long")).drop("_s", "_b", "_r")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, lean: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``lean`` spares the workers' memory."""
    lengths = stage(tokenised(docs, vocabulary, capacity, lean), "lengths")
    first = F.col("n") % capacity
    lead = F.when(first == 0, F.lit(capacity)).otherwise(first)
    pieces = lengths.select("doc_id", first.alias("first"), lead.alias("lead"), F.posexplode("piece_crcs").alias("piece", "ids_crc32")).select(
        "doc_id",
        "piece",
        F.when(F.col("piece") == 0, 0).otherwise(F.col("lead") + (F.col("piece") - 1) * capacity).cast("long").alias("start"),
        F.when(F.col("piece") == 0, F.col("lead")).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32",
    )
    # At most ``capacity`` rows, whatever the input.
    counts = {int(r.length): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    whole = counts.pop(capacity, 0)
    rows, sequence = [], whole
    used: dict[int, int] = {}
    for bins, uses in minimum_bin_slack(counts, capacity):
        at = 0
        for n, k in uses:
            rows.append((n, used.get(n, 0), k, sequence, at))
            used[n] = used.get(n, 0) + bins * k
            at += n * k
        sequence += bins
    if whole:
        rows.append((capacity, 0, 1, 0, 0))
    plan = sorted(rows)
    by_length = {n: np.array([p[1:] for p in plan if p[0] == n], np.int64) for n in {p[0] for p in plan}}
    sent = docs.sparkSession.sparkContext.broadcast(by_length)  # fewer than capacity plan rows of at most 45 lengths each

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            n, r = pdf["length"].to_numpy(), pdf["r"].to_numpy()
            for length in np.unique(n):
                here = n == length
                p = sent.value[int(length)]
                k = p[np.searchsorted(p[:, 0], r[here], "right") - 1]
                past = r[here] - k[:, 0]
                seq[here], off[here] = k[:, 2] + past // k[:, 1], k[:, 3] + past % k[:, 1] * length
            yield pdf.drop(columns="r").assign(sequence_id=seq, offset=off)

    salts = max(64, 4 * parallelism(docs))
    return _ranked(pieces, "length", salts).select("doc_id", "piece", "start", "length", "ids_crc32", "r").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
