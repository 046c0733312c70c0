"""Operator 10: language-model scoring by context-tree weighting over binary-decomposed bytes.

The text is its words, A-Z lower-cased, joined by spaces and closed by an end
byte. Each byte is eight binary decisions; each decision has a context tree over
the ``DEPTH`` bytes before, deepest context first mixed into shallower ones: a
node's Krichevsky-Trofimov estimate weighs against its children's mixture by
their probabilities of all training bits (context-tree weighting). A node that
training never visited leaves its parent's estimate as it is. The trees are
those of all training text; a document's score is the sum of its bytes' log
probabilities, its code length that number in bits.

A byte's probability depends on itself and ``DEPTH`` bytes, so only distinct
n-grams are gathered: a task writes the distinct n-grams and tokens of each run
of documents it reads (a block) and the block's documents, compressed. Counts
are summed over the corpus; the trees below each two nearest context bytes are
weighed together, in groups that hold several such pairs or one frequent one, at
most a few hundredths of all distinct n-grams; the two depths above them are met through 65,280 sums. Where the table of all n-grams passes the checked size it is
broadcast, else each block gets its own n-grams' part of it by a join; the word
counts of the base score always come that way.

Defined cases: a null or empty text is the end alone; rows with equal ids are
scored each; a null id counts as the empty text for the fold; without training
text every decision is even and the base score that of unknown tokens (N = 0,
V = 0); a long text takes about 100 bytes a byte while it is read and scored; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashLookup, byte_runs, fold, give_back, parallelism, segment_sum, segments, settle, stage, table, unstage

DEPTH = 5
#: Context bytes that the n-grams weighed in one group share; the trees above them are summed by node.
SHARED = 2
#: Groups that those contexts are dealt into at least, whole contexts each.
GROUPS = 256
#: Bytes of text in a block, and n-grams that are broadcast at most (12 bytes each).
BLOCK_BYTES, MAX_BROADCAST = 32_000_000, 4_000_000
#: Bytes of text scored at once.
RUN_BYTES = 1_000_000
#: The end of a text, as byte and as token: no word holds it.
END = b"\n"
TOKEN, GRAM, DOC = 0, 1, 2


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z alone; space and U+0009 to U+000D


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its context and itself as a number, oldest byte first, and the bounds of each text's."""
    pad = END * depth
    return _packed(np.frombuffer(b"".join(pad + t for t in texts), np.uint8), segments(np.array([len(t) + depth for t in texts], np.int64)), depth)


def _packed(flat: np.ndarray, bounds: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """As ``grams``, of texts that lie one after another, each behind ``depth`` ends."""
    flat = flat.astype(np.uint64)
    code = flat.copy()
    for k in range(1, depth + 1):
        code[k:] |= flat[:-k] << np.uint64(8 * k)
    keep = np.ones(len(flat), bool)
    for k in range(depth):
        keep[bounds[:-1] + k] = False
    return code[keep], bounds - depth * np.arange(len(bounds))


def _bytes_of(strings) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings one after another, and the bounds of each."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


STAGED = "kind int, block long, doc_id long, held_out boolean, code long, n long, data binary"
#: Rows in a batch that a task hands over.
OUT_ROWS = 65_536


def _batch(kind: int, block: int, size: int, **cols):
    """A record batch of ``STAGED`` in which what isn't given is null."""
    import pyarrow as pa

    kinds = {"kind": pa.int32(), "block": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "code": pa.int64(), "n": pa.int64(), "data": pa.binary()}
    fixed = {"kind": np.full(size, kind, np.int32), "block": np.full(size, block, np.int64)}
    have = {n: c if isinstance(c, pa.Array) else pa.array(c, type=kinds[n]) for n, c in (fixed | cols).items()}
    return pa.RecordBatch.from_arrays([have[n] if n in have else pa.nulls(size, t) for n, t in kinds.items()], names=list(kinds))


def _gather(batches: Iterator) -> Iterator:
    """Documents (doc_id, held_out, text) to blocks of ``STAGED`` rows. A block's memory is that of its distinct words and n-grams."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    settle()
    part, made, size = TaskContext.get().partitionId(), 0, 0
    packer = zstandard.ZstdCompressor(level=1)
    words: list = []
    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def merged():
        return pa.concat_tables(words).group_by("w").aggregate([("n", "sum")]).rename_columns(["w", "n"])

    def close(block: int) -> Iterator:
        if words:
            for found in merged().to_batches(OUT_ROWS):
                yield _batch(TOKEN, block, found.num_rows, data=found.column("w").cast(pa.binary()), n=found.column("n"))
        if codes:
            k, n = _merge(codes, counts)
            for a in range(0, len(k), OUT_ROWS):
                yield _batch(GRAM, block, len(k[a : a + OUT_ROWS]), code=k[a : a + OUT_ROWS].astype(np.int64), n=n[a : a + OUT_ROWS])
        words.clear(), codes.clear(), counts.clear()

    for batch in batches:
        ids, held, text = (batch.column(k) for k in range(3))
        text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
        for a, m in byte_runs(pc.binary_length(text).to_numpy(zero_copy_only=False), RUN_BYTES):
            own = pc.ascii_split_whitespace(text.slice(a, m))
            flag = held.slice(a, m).to_numpy(zero_copy_only=False).astype(bool)
            offsets = own.offsets.to_numpy().astype(np.int64)
            said = own.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            at = said.indices.to_numpy()
            trained = np.bincount(at[np.repeat(~flag, np.diff(offsets))], minlength=len(said.dictionary))
            mine = pa.table({"w": said.dictionary, "n": trained})
            words.append(mine.filter(pc.not_equal(mine["w"], "")))  # an empty text has no word
            flat = pc.binary_join_element_wise(END.decode() * DEPTH, pc.binary_join(own, " "), END.decode(), "")
            _count(flat, flag, codes, counts)
            if len(codes) > 8:
                k, n = _merge(codes, counts)
                codes[:], counts[:] = [k], [n]
                words[:] = [merged()]
            block = (part << 32) + made
            raw, bounds = _bytes_of(flat)
            view = memoryview(raw)
            packed = [packer.compress(view[x + DEPTH : y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield _batch(DOC, block, m, doc_id=ids.slice(a, m), held_out=held.slice(a, m), data=packed)
            size += len(raw) - DEPTH * m
            if size >= BLOCK_BYTES:
                yield from close(block)
                made, size = made + 1, 0
        give_back()
    if size:
        yield from close((part << 32) + made)


def _count(flat, held: np.ndarray, codes: list, counts: list) -> None:
    """Distinct n-grams of the texts trained on, counted, and of those held out, with count 0."""
    import pyarrow as pa

    for use, weight in ((~held, 1), (held, 0)):
        if use.any():
            k, n = np.unique(_packed(*_bytes_of(flat.filter(pa.array(use))))[0], return_counts=True)
            codes.append(k)
            counts.append(n * weight)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - np.log(np.pi) - _log_gamma(n0 + n1 + 1.0)


def weigh(codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH, shared: int = SHARED) -> tuple[np.ndarray, pd.DataFrame]:
    """For all n-grams of some groups of ``shared`` nearest context bytes: P(1) of each of the eight decisions at that depth (nan where never visited), and each node's counts and mixture there."""
    out = np.empty((len(codes), 8), np.float32)
    roots = []
    byte = codes & np.uint64(255)
    eight = np.uint64(8)
    for level in range(8):
        node = (byte >> np.uint64(8 - level)) | np.uint64(1 << level)
        one = ((byte >> np.uint64(7 - level)) & np.uint64(1)).astype(bool)
        keys = (codes & ~np.uint64(255)) | node  # all context bytes and the node
        unique, leaf = np.unique(keys, return_inverse=True)
        n1 = np.bincount(leaf, counts * one, len(unique))
        n0 = np.bincount(leaf, counts * ~one, len(unique))
        chain = []  # by depth from the leaves: P(1), weight, visited, place of the leaves' nodes
        place, weighted = np.arange(len(unique)), None
        for d in range(depth, shared - 1, -1):
            own = log_kt(n0, n1)
            if weighted is None:
                mixed, weight = own, np.ones(len(unique))
            else:
                mixed = np.logaddexp(own, weighted) - np.log(2)
                weight = np.exp(own - np.log(2) - mixed)
            chain.append(((n1 + 0.5) / (n0 + n1 + 1), weight, n0 + n1 > 0, place))
            if d == shared:
                roots.append(pd.DataFrame({"context": (unique >> eight).astype(np.int64) & (256**shared - 1), "node": (unique & np.uint64(255)).astype(np.int64), "n0": n0, "n1": n1, "mixed": mixed}))
                break
            mask = np.uint64(((1 << 8 * (d - 1)) - 1) << 8 | 255)
            unique, up = np.unique(unique & mask, return_inverse=True)
            n0, n1, weighted = np.bincount(up, n0, len(unique)), np.bincount(up, n1, len(unique)), np.bincount(up, mixed, len(unique))
            place = up[place]
        p = np.full(len(leaf) and len(chain[0][0]), np.nan)
        for kt, weight, visited, at in chain:
            here, w = kt[at], weight[at]
            p = np.where(np.isnan(p), np.where(visited[at], here, np.nan), w * here + (1 - w) * p)
        out[:, level] = p[leaf]
    return out, pd.concat(roots)


def upper(nodes: pd.DataFrame, shared: int = SHARED) -> list[tuple[np.ndarray, np.ndarray]]:
    """P(1) and weight of each node at the depths ``shared`` - 1 to 0, from the sums over its children (context, node, n0, n1, mixed); nan where never visited, but at the root."""
    size = 256**shared
    key = nodes["context"].to_numpy(np.int64) * 256 + nodes["node"].to_numpy(np.int64)
    n0, n1, below = (np.bincount(key, nodes[c].to_numpy(np.float64), size) for c in ("n0", "n1", "mixed"))
    out = []
    for d in range(shared - 1, -1, -1):
        own = log_kt(n0, n1)
        mixed = np.logaddexp(own, below) - np.log(2)
        out.append((np.where((n0 + n1 > 0) | (d == 0), (n1 + 0.5) / (n0 + n1 + 1), np.nan), np.exp(own - np.log(2) - mixed)))
        if d:
            n0, n1, below = (x.reshape(256, -1).sum(0) for x in (n0, n1, mixed))  # the farthest byte is the highest
    return out


def log10_bytes(codes: np.ndarray, inner: np.ndarray, up: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each n-gram's last byte: what stands below mixed into each depth up to the root."""
    byte = (codes & np.uint64(255)).astype(np.int64)
    context = (codes >> np.uint64(8)).astype(np.int64)
    total = np.zeros(len(codes))
    for level in range(8):
        node, one = (byte >> (8 - level)) | (1 << level), (byte >> (7 - level)) & 1
        p = inner[:, level].astype(np.float64)
        for d, (kt, weight) in zip(range(len(up) - 1, -1, -1), up):
            at = (context & (256**d - 1)) * 256 + node
            p = np.where(np.isnan(p), kt[at], weight[at] * kt[at] + (1 - weight[at]) * p)
        total += np.log10(np.where(one == 1, p, 1 - p))
    return total


def gram_table(counts: DataFrame) -> DataFrame:
    """code, lp (float): log10 probability of every n-gram in ``counts`` (code, n)."""
    names = [f"p{k}" for k in range(8)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = pdf["code"].to_numpy().astype(np.uint64)
        inner, root = weigh(codes, pdf["n"].to_numpy().astype(np.float64))
        mine = pd.DataFrame(inner, columns=names).assign(is_root=False, code=codes.astype(np.int64), node=0, n0=0.0, n1=0.0, mixed=0.0)
        return pd.concat([mine, root.assign(is_root=True, code=root["context"] * 256, **dict.fromkeys(names, 0.0)).drop(columns="context")])

    schema = "is_root boolean, code long, " + ", ".join(f"{n} float" for n in names) + ", node int, n0 double, n1 double, mixed double"
    near = F.shiftright("code", 8).bitwiseAND(F.lit(256**SHARED - 1))
    dealt = F.pmod(F.xxhash64(near), F.lit(max(GROUPS, 4 * parallelism(counts))))
    inner = stage(counts.groupBy(dealt.alias("dealt")).applyInPandas(run, schema), "trees")
    above = F.shiftright("code", 8).bitwiseAND(F.lit(256 ** (SHARED - 1) - 1)).alias("context")
    sums = inner.where("is_root").groupBy(above, "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("mixed").alias("mixed")).toPandas()  # 256 * 255 rows at most
    sent = counts.sparkSession.sparkContext.broadcast(upper(sums))  # as many numbers four times

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lp = log10_bytes(pdf["code"].to_numpy().astype(np.uint64), pdf[names].to_numpy(), sent.value)
            yield pd.DataFrame({"code": pdf["code"], "lp": lp.astype(np.float32)})

    done = stage(inner.where("not is_root").select("code", *names).mapInPandas(finish, "code long, lp float"), "grams")
    unstage(inner)
    return done


def _score(n_train: int, n_vocab: int, n_ends: int, sent):
    unit = float(n_train + n_vocab + 1)

    def run(batches: Iterator) -> Iterator:
        """Rows by block and kind: a block's tokens, its n-grams if they aren't broadcast, then its documents, a few at a time."""
        import pyarrow as pa

        unpack = zstandard.ZstdDecompressor()
        shared = (HashLookup(sent.value[0]), sent.value[1]) if sent else None
        block, c, held, look = None, {}, [], shared
        end = (np.log10((n_ends + 1) / unit), n_ends > 0)
        for batch in batches:
            keys = batch.column("block").to_numpy() * 4 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                at, kind = int(keys[a]) // 4, int(keys[a]) % 4
                if at != block:
                    block, c, held, look = at, {}, [], shared
                if kind == TOKEN:
                    c.update(zip(rows.column("data").cast(pa.string()).to_pylist(), rows.column("n").to_pylist()))
                elif kind == GRAM:
                    held.append((rows.column("code").to_numpy().astype(np.uint64), rows.column("lp").to_numpy()))
                else:
                    if look is None:
                        codes = np.concatenate([k for k, _ in held])
                        order = np.argsort(codes)
                        look, held = (HashLookup(codes[order]), np.concatenate([v for _, v in held])[order]), []
                    for k in range(0, b - a, 256):
                        yield _score_docs(rows.slice(k, 256), c, look, unit, end, unpack, n_train)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _score_docs(rows, c: dict, look: tuple, unit: float, end: tuple, unpack, n_train: int):
    import pyarrow as pa
    import pyarrow.compute as pc

    flat = [unpack.decompress(d) for d in rows.column("data").to_pylist()]
    size = np.fromiter(map(len, flat), np.int64, len(flat))
    score = []
    for a, m in byte_runs(size, RUN_BYTES):
        codes, bounds = grams(flat[a : a + m])
        score.append(segment_sum(look[1][look[0](codes)].astype(np.float64), bounds))
    score = np.concatenate(score)
    # Words stand between single spaces; the end is cut off, and an empty text is one empty word that counts for nothing.
    own = pc.split_pattern(pa.array([t[:-1] for t in flat], pa.string()), " ")
    said = own.values.dictionary_encode()
    known = np.fromiter((c[w] if w else np.nan for w in said.dictionary.to_pylist()), np.float64, len(said.dictionary))
    count = known[said.indices.to_numpy()]
    word = ~np.isnan(count)
    bounds = own.offsets.to_numpy().astype(np.int64)
    base = segment_sum(np.where(word, np.log10((np.nan_to_num(count) + 1) / unit), 0.0), bounds) + end[0]
    seen = segment_sum(word & (np.nan_to_num(count) > 0), bounds).astype(np.int64) + int(end[1])
    sizes = segment_sum(word, bounds).astype(np.int64) + 1
    columns = [rows.column("doc_id"), rows.column("held_out"), sizes, seen, np.full(len(flat), n_train, np.int64), base, score, -score * np.log2(10) / size]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[x.split()[0] for x in SCORES.split(", ")])


def score(docs: DataFrame, broadcast_limit: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of ``docs``."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    staged = stage(source.mapInArrow(_gather, STAGED), "blocks", "kind")
    token, gram, doc = (staged.where(F.col("kind") == k) for k in (TOKEN, GRAM, DOC))
    counts = stage(token.groupBy("data").agg(F.sum("n").alias("c")), "vocabulary")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = doc.where("not held_out").count()
    n_train, n_vocab = total.n + ends, total.v + (ends > 0)
    lp = gram_table(gram.groupBy("code").agg(F.sum("n").alias("n")))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("code", "long"), ("lp", "float"))]
    dealt = doc.select("block", "kind", "doc_id", "held_out", F.lit(None).cast("long").alias("n"), "data", *none)
    empty = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out")]
    dealt = dealt.unionByName(token.select("block", "kind", "data").join(counts, "data").select("block", "kind", *empty, F.col("c").alias("n"), "data", *none))
    sent = None
    if lp.count() <= broadcast_limit:  # checked: at most 12 bytes * MAX_BROADCAST
        got = lp.toArrow()
        codes, values = got["code"].to_numpy().astype(np.uint64), got["lp"].to_numpy()
        order = np.argsort(codes)
        sent = spark.sparkContext.broadcast((codes[order], values[order]))
    else:
        dealt = dealt.unionByName(gram.select("block", "kind", "code").join(lp, "code").select("block", "kind", *empty, F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("data"), "code", "lp"))
    # About a block a task.
    blocks = doc.select("block").distinct().count()
    ordered = dealt.repartition(max(blocks, parallelism(docs)), "block").sortWithinPartitions("block", "kind")
    return ordered.mapInArrow(_score(n_train, n_vocab, ends, sent), SCORES)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
