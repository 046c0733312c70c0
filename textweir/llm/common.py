"""What the training-data operators share: table access, staged tables, lookups, and exact cached tokenisation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settle() -> None:
    """Have Arrow take a worker's memory from the system, which takes it back."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Return a worker's free memory, which an idle one would keep for stages that need it more. Without glibc, Arrow's alone."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: Rows in an Arrow batch of a staged plan.
ARROW_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set. The path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; one of our own only in a local session where it is unset."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="textweir-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While a plan runs in here, at most ``ARROW_ROWS`` rows go to Python at once: rows here hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the reread table, so lost executors recompute nothing above it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textweir/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.partitionBy(*partition).parquet(path) if partition else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def masked(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """All columns under names that nothing clashes with, beside the ``needed`` ones; those names; and the way back."""
    names = [f"_keep{i}" for i in range(len(docs.columns))]
    apart = docs.toDF(*names)
    own = dict(zip(docs.columns, names))
    return apart.select(*names, *[F.col(own[n]).alias(n) for n in needed]), names, lambda df: df.select(*[F.col(k).alias(n) for n, k in own.items()])


def parallelism(df: DataFrame) -> int:
    """Shuffle partitions of the session, so a plan follows the cluster's own setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class HashLookup:
    """Index of each uint64 key in a fixed sorted key array, -1 if absent: one probe of an open table, binary search for the few that collide."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 1)
        slot = self._slot(keys)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        beaten = self.table[slot] != np.arange(len(keys))
        self.rest = np.flatnonzero(beaten).astype(np.int32)
        self.rest_keys = keys[self.rest]
        self.more = np.zeros(1 << self.bits, bool)
        self.more[slot[self.rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(codes), -1, np.int32)
        slot = self._slot(codes)
        at = self.table[slot]
        wrong = (at < 0) | (self.keys[at] != codes)
        at = np.where(wrong, np.int32(-1), at)
        again = np.flatnonzero(wrong & self.more[slot])
        if len(again) and len(self.rest):
            pos = np.minimum(np.searchsorted(self.rest_keys, codes[again]), len(self.rest) - 1)
            at[again] = np.where(self.rest_keys[pos] == codes[again], self.rest[pos], -1)
        return at


def segments(lengths: np.ndarray) -> np.ndarray:
    """Start of each segment when segments of these lengths lie one after another, and the end of all."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each segment; empty segments give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of slices [start, start + length) laid one after another."""
    bounds = segments(lengths)
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1] - starts, lengths)


def byte_runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of rows of about ``limit`` bytes; a row of more begins and ends a run of its own."""
    large = sizes > limit
    run = np.cumsum(sizes) // limit + np.cumsum(large) * 2 + np.concatenate([[0], np.cumsum(large)[:-1]])[: len(sizes)]
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    yield from ((a, b - a) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)


def word_runs(raw: bytes, size: int = 4_000_000) -> Iterator[list[bytes]]:
    """The words of ``raw``, which white space parts, in runs of about ``size`` bytes, so that no long text is ever all Python objects."""
    a = 0
    while a < len(raw):
        b = a + size
        while b < len(raw) and raw[b] not in b" \t\n\v\f\r":
            b += 1
        yield raw[a:b].split()
        a = b


def map_text(docs: DataFrame, keep: list[str], added: str, compute: Callable[[list[str]], list], chars: int = 1_000_000) -> DataFrame:
    """The columns ``keep`` of ``docs`` and those ``added`` (a schema), which ``compute`` gives for runs of whole texts, null as empty.

    Batches stay in Arrow: kept columns pass through untouched, and only a run of
    about ``chars`` bytes of text is ever Python objects.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    picked = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    new = StructType.fromDDL(added)
    schema = StructType([*picked.schema.fields[:-1], *new.fields])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in new.fields]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        settle()
        for batch in batches:
            text, kept = batch.column(batch.num_columns - 1), batch.columns[:-1]
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            run_of = np.cumsum(sizes) // chars
            cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    made = compute([t or "" for t in text.slice(a, b - a).to_pylist()])
                    columns = [c.slice(a, b - a) for c in kept] + [pa.array(x, type=t) for x, (_, t) in zip(made, kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *(n for n, _ in kinds)])
                    del made, columns
            give_back()

    return picked.mapInArrow(run, schema)


class CachedTokenizer:
    """Ids of whole texts by the tokenizers library, through a cache of the pieces between spaces and line ends.

    Both vocabularies split text before any merge. No pre-token runs from a
    non-space into a space or line end, nor from a letter or digit into a full
    stop or comma; so a text cut before these has the ids of its pieces, one
    after another. A text where white space is anything but single spaces and
    line ends, where a cut full stop or comma doesn't follow a letter or digit,
    or that holds a mark of ours, is encoded whole: there the cut is not proven.
    """

    #: Begin a text's first piece, and one after a line end; the others stand for the piece with its space before it.
    FIRST, LINE = "\x1e", "\x1f"
    #: Pieces on their own for a full stop and a comma before a space.
    STOP, COMMA = "\x1d", "\x1c"
    #: Pieces from which on those not met again are dropped (all, if half as many would stay), which changes no id.
    LIMIT = 300_000
    #: Bytes of text in one run; a longer text is cut into runs at spaces between letters or digits.
    RUN = 8_000_000
    #: Pieces encoded as one string, where each is letters alone and so one pre-token.
    JOINED = 1_000
    _odd = (
        "  | \\n|\\n |\\n\\n|[\\t\\r\\x0b\\x0c\\x1c-\\x1f]"
        "|[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
    )
    _seam = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        vocabulary = self.tok.get_vocab()
        # Which ids begin a word with its space, and which end one: the marks of the two kinds of vocabulary.
        self.opens, self.closes = np.zeros(max(vocabulary.values()) + 1, bool), np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i], self.closes[i] = token.startswith("\u0120"), token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.plain_end = np.zeros(0, bool)
        self.again = np.zeros(0, bool)
        self._learn([self.STOP, self.COMMA])

    def forget(self) -> None:
        """Drop the pieces not met again, at a task's end."""
        self._shrink()
        give_back()

    def _shrink(self) -> None:
        """Keep the pieces that were met again since they were learned."""
        self.again[:2] = True
        keep = np.flatnonzero(self.again)
        if len(keep) > self.LIMIT // 2:
            return self._clear()
        names = list(self.index)
        self.index = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.flat = self.flat[gather(self.start[keep], self.length[keep])]
        self.length, self.plain_end = self.length[keep], self.plain_end[keep]
        self.start, self.again = segments(self.length)[:-1], np.zeros(len(keep), bool)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        marks = {self.FIRST: "", self.LINE: "\n", self.STOP: ".", self.COMMA: ","}
        words = [p for p in pieces if p.isalpha()]
        others = [p for p in pieces if not p.isalpha()]
        ids = self._encode([marks[p[0]] + p[1:] if p[:1] in marks else " " + p for p in others])
        lengths, flat = self._joined(words)
        n, more = len(self.index), np.fromiter(map(len, ids), np.int64, len(ids))
        self.index.update(zip(chain(words, others), range(n, n + len(pieces))))
        self.length = np.concatenate([self.length, lengths, more])
        self.flat = np.concatenate([self.flat, flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(more.sum()))])
        self.start = segments(self.length)[:-1]
        self.plain_end = np.concatenate([self.plain_end, np.ones(len(words), bool), np.fromiter((p[-1:].isalnum() for p in others), bool, len(others))])
        self.again = np.concatenate([self.again, np.zeros(len(pieces), bool)])

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of words of letters alone with a space before each, many in one string; its marks tell them apart."""
        lengths, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a in range(0, len(words), self.JOINED):
            some = words[a : a + self.JOINED]
            ids = np.array(self._encode([" " + " ".join(some)])[0], np.uint32)
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(some) or first[0]:
                first = np.concatenate([[0], np.flatnonzero(self.closes[ids])[:-1] + 1])
            if len(first) == len(some):
                size = np.diff(first, append=len(ids))
            else:  # no marks: one by one
                each = self._encode([" " + w for w in some])
                size, ids = np.fromiter(map(len, each), np.int64, len(each)), np.fromiter(chain.from_iterable(each), np.uint32)
            lengths.append(size)
            flat.append(ids)
        return np.concatenate(lengths), np.concatenate(flat)

    def __call__(self, texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of an Arrow array of texts without nulls: runs (number of texts, their uint32 ids one after another, bounds of each text's)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        for a, n in byte_runs(pc.binary_length(texts).to_numpy(zero_copy_only=False), self.RUN):
            run = texts.slice(a, n)
            if n == 1 and len(run[0].as_buffer()) > 2 * self.RUN:
                made = [self._batch(pa.array([part])) for part in self._parts(run[0].as_py())]
                flat = np.concatenate([f for f, _ in made])
                yield 1, flat, np.array([0, len(flat)])
            else:
                yield n, *self._batch(run)

    def _parts(self, text: str) -> Iterator[str]:
        """A long text cut before spaces between letters or digits, where both vocabularies cut it too."""
        a = 0
        while a < len(text):
            found = self._seam.search(text, a + self.RUN)
            b = found.start() if found else len(text)
            yield text[a:b]
            a = b

    def _batch(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow.compute as pc

        if len(self.index) > self.LIMIT:
            self._shrink()
        odd = pc.match_substring_regex(texts, self._odd).to_numpy(zero_copy_only=False)
        cut = texts if not odd.any() else pc.if_else(odd, "", texts)
        for found, mark in (("\n", " " + self.LINE), (". ", f" {self.STOP} "), (", ", f" {self.COMMA} ")):
            cut = pc.replace_substring(cut, found, mark)
        cut = pc.split_pattern(pc.binary_join_element_wise(self.FIRST, cut, ""), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        pieces = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds -= bounds[0]
        distinct = pieces.dictionary.to_pylist()
        known = np.fromiter((self.index.get(p, -1) for p in distinct), np.int64, len(distinct))
        self.again[known[known >= 0]] = True
        new = np.flatnonzero(known < 0).tolist()
        if new:
            self._learn([distinct[k] for k in new])
            known[new] = [self.index[distinct[k]] for k in new]
        at = known[pieces.indices.to_numpy()]
        # A stop or comma that doesn't follow a letter or digit: there the cut isn't proven.
        marks = np.flatnonzero(at < 2)
        odd[np.searchsorted(bounds, marks[~self.plain_end[at[marks - 1]]], "right") - 1] = True
        lengths = self.length[at]
        flat = self.flat[gather(self.start[at], lengths)]
        ends = segments(lengths)[bounds]
        rest = np.flatnonzero(odd)
        if not len(rest):
            return flat, ends
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for k, ids in zip(rest.tolist(), self._encode(texts.take(rest).to_pylist())):
            out[k] = np.array(ids, np.uint32)
        return np.concatenate(out), segments(np.fromiter(map(len, out), np.int64, len(out)))

    def closed(self, texts, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As a call, with ``end_id`` behind each text's ids."""
        for n, flat, bounds in self(texts):
            yield n, np.insert(flat, bounds[1:], np.uint32(end_id)), bounds + np.arange(n + 1)
