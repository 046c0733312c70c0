"""Operator 9: token ids of every document in a binary format with a shared zstandard dictionary.

File format (a Parquet table in any store Spark writes, so commits are atomic
and a lost executor's half-written block never shows): one row is one block of
consecutive documents, ascending by id.

=============  ==========================================================
block          long, blocks ascend by the ids they hold
dict_sha256    hex digest of the zstandard dictionary the frames need
doc_ids        int64 little-endian, one per document (null_ids marks nulls)
null_ids       one byte per document, 1 where the id is null
offsets        int64 little-endian, n + 1 bounds of the frames in ``frames``
counts         int64 little-endian, ids of each document, end id included
frames         zstandard frames, one per document, of little-endian uint32
=============  ==========================================================

A short document is read alone: its frame lies between two offsets. The
dictionary is a second table of one row (dict_sha256, dictionary).

Defined cases: a null text counts as empty and holds the end id alone; rows
with equal ids are all kept, one after another in unspecified order; a null id
sorts first; a long text is encoded in runs cut where the vocabulary cuts too; an
empty table gives no blocks; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CachedTokenizer, settle, stage, table, unstage

#: Documents that the dictionary is trained on at most. It shapes compression alone, never results.
DICT_DOCS = 2_000
#: Characters of the text of each that training looks at, and bytes of the dictionary.
DICT_CHARS, DICT_BYTES = 4_000, 65_536
#: A block ends after so many documents or bytes of frames, whichever comes first.
BLOCK_DOCS, BLOCK_BYTES = 2_048, 4_000_000
END_ID = 2

_tokenizers: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


def train_dictionary(docs: DataFrame, vocabulary: str) -> bytes:
    """A dictionary from at most ``DICT_DOCS`` documents, taken by the hash of their ids; empty where there are too few."""
    # Narrow rows by hash first: each task then sends the driver a few short texts, however many tasks there are.
    share = min(1.0, 4 * DICT_DOCS / max(1, docs.count()))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    picked = docs.select(h.alias("_h"), F.substring("text", 1, DICT_CHARS).alias("text")).where((F.col("_h") <= int(share * (1 << 30))) & (F.length("text") > 0))
    rows = picked.orderBy("_h").limit(DICT_DOCS).collect()
    import pyarrow as pa

    samples = [flat[a:b].astype("<u4").tobytes() for _, flat, at in tokenizer(vocabulary)(pa.array([r.text for r in rows], pa.string())) for a, b in zip(at[:-1], at[1:])]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to train on: frames then stand without one
        return b""


def _codec(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary, zstandard.DICT_TYPE_FULLDICT) if dictionary else None


def encode(docs: DataFrame, vocabulary: str, dictionary: bytes) -> DataFrame:
    """doc_id, n_tokens and the compressed frame of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)  # DICT_BYTES at most

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        settle()
        tok = tokenizer(vocabulary)
        packer = zstandard.ZstdCompressor(level=3, dict_data=_codec(sent.value), write_content_size=True)
        for batch in batches:
            ids, a = batch.column(0), 0
            for n, flat, at in tok.closed(pc.fill_null(batch.column(1), ""), END_ID):
                raw = memoryview(flat.astype("<u4", copy=False)).cast("B")
                frames = [packer.compress(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(a, n), pa.array(np.diff(at)), pa.array(frames, pa.binary())], names=["doc_id", "n_tokens", "frame"])
                a += n
        tok.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, frame binary")


BLOCK_SCHEMA = "block long, dict_sha256 string, doc_ids binary, null_ids binary, offsets binary, counts binary, frames binary"


def _to_blocks(dict_sha: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def block() -> pd.DataFrame:
            ids, counts, frames = zip(*held)
            null = np.array([i is None for i in ids], np.uint8)
            row = ((part << 32) + made, dict_sha, np.array([i or 0 for i in ids], "<i8").tobytes(), null.tobytes(), np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<i8").tobytes(), np.array(counts, "<i8").tobytes(), b"".join(frames))
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for pdf in batches:
            for i, n, f in zip(pdf["doc_id"], pdf["n_tokens"], pdf["frame"]):
                held.append((None if pd.isna(i) else int(i), n, f))
                size += len(f)
                if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block()
                    held.clear()
                    made, size = made + 1, 0
        if held:
            yield block()

    return run


def write_tokens(docs: DataFrame, vocabulary: str) -> tuple[DataFrame, bytes]:
    """Write the blocks of all documents, ascending by id, to the shared folder; the reread table and the dictionary."""
    dictionary = train_dictionary(docs, vocabulary)
    dict_sha = hashlib.sha256(dictionary).hexdigest()
    frames = stage(encode(docs, vocabulary, dictionary), "frames")  # sorting samples its input first: it must not tokenise twice
    ordered = frames.repartitionByRange("doc_id", F.xxhash64("frame")).sortWithinPartitions("doc_id")
    blocks = stage(ordered.mapInPandas(_to_blocks(dict_sha), BLOCK_SCHEMA), "blocks")
    unstage(frames)
    return blocks, dictionary


def _array(raw: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(raw, kind)


def read_document(block: dict, k: int, dictionary: bytes) -> np.ndarray:
    """Ids of the k-th document of a block, by its offsets alone."""
    if hashlib.sha256(dictionary).hexdigest() != block["dict_sha256"]:
        raise ValueError("the block was written with another dictionary")
    bounds = _array(block["offsets"])
    return _array(zstandard.ZstdDecompressor(dict_data=_codec(dictionary)).decompress(bytes(block["frames"][bounds[k] : bounds[k + 1]])), "<u4")


def read_tokens(blocks: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and block of each document, from the files.

    Starts come from the totals of the blocks: a running sum over one row per
    ``BLOCK_DOCS`` documents, which alone goes through one task.
    """
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(dictionary)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"block": pdf["block"], "n": [int(_array(c).sum()) for c in pdf["counts"]]})

    sums = blocks.select("block", "counts").mapInPandas(totals, "block long, n long")
    base = _running(sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor(dict_data=_codec(sent.value))
        want = hashlib.sha256(sent.value).hexdigest()
        for pdf in batches:
            for b in pdf.to_dict("records"):
                if b["dict_sha256"] != want:
                    raise ValueError("the block was written with another dictionary")
                bounds, counts, frames = _array(b["offsets"]), _array(b["counts"]), b["frames"]
                raw = [unpack.decompress(bytes(frames[x:y])) for x, y in zip(bounds[:-1], bounds[1:])]
                ids = pd.array(_array(b["doc_ids"]), dtype="Int64")
                ids[_array(b["null_ids"], "u1").astype(bool)] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "in_block": np.cumsum(counts) - counts, "n_tokens": [len(r) // 4 for r in raw], "ids_crc32": [zlib.crc32(r) for r in raw], "block": b["block"]})

    # Only what was read meets the starts, not the frames.
    found = blocks.mapInPandas(run, "doc_id long, in_block long, n_tokens long, ids_crc32 long, block long")
    return found.join(base, "block").select("doc_id", (F.col("base") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32", "block")


def _running(sums: DataFrame) -> DataFrame:
    """block and base, the sum of n over all earlier blocks: within groups of partitions, then over the groups."""
    from pyspark.sql import Window as W

    group = F.shiftright("block", 32)
    per = sums.withColumn("g", group)
    inner = per.withColumn("in_group", F.sum("n").over(W.partitionBy("g").orderBy("block")) - F.col("n"))
    tops = per.groupBy("g").agg(F.sum("n").alias("t"))
    tops = tops.select("g", (F.sum("t").over(W.orderBy("g")) - F.col("t")).alias("before"))
    return inner.join(tops, "g").select("block", (F.col("in_group") + F.col("before")).alias("base"))


def token_output(docs: DataFrame, vocabulary: str) -> DataFrame:
    blocks, dictionary = write_tokens(docs, vocabulary)
    return read_tokens(blocks, dictionary)


def op9_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
