"""Operator 7: a quality classifier from interpolated modified Kneser-Ney models of trusted and of bad text.

The n-grams are bytes of the text as it stands, so case, symbols and layout
count. Trusted text is what ``labels`` calls good (quality 1, toxic 0), bad text
what it calls anything else. Every row of each trains: whole texts, whatever
their number and length. A trusted document is itself scored by a model of the
trusted texts of the other of two folds, dealt by the text's hash, so no copy of
it was seen there; all others are scored by the model of all trusted text. Every
trusted row counts for the thresholds with that unseen score.

N-gram counts are summed in the executors, sharded by n-gram. Where the models'
n-grams pass the checked size (``MAX_BROADCAST``) they are broadcast. Else n-grams that share their two nearest
context bytes meet in one group, with the counts of those that documents hold
there, and each block of documents gets its own n-grams' part by a join; only
the two lowest orders (65,792 n-grams at most) and the discounts are met globally.
Labelled ids are broadcast in parts, up to ``MAX_PARTS`` of ``MAX_IDS``; beyond, a join shuffles texts.

A document is rejected for one of two reasons. Its perplexity under the trusted
model is above its language's threshold, the ``QUANTILE`` of that of trusted
documents which the model hasn't seen; perplexity is taken with ``PRIOR`` bytes
of that language's median added, so that a few odd bytes don't reject a short
text. Or its worst word, by how many nats likelier the bad model finds it than
the trusted one, is above its language's threshold, the same quantile and
``WORD_MARGIN``: a few insults, which drown in the perplexity of a long text.

Defined cases: a null or empty text has perplexity 1 and is rejected; a null
language, or one with fewer than ``MIN_CALIBRATION`` trusted documents, takes
the thresholds of all languages together; without trusted text nothing with text
is rejected, and without bad text nothing for a word; where all trusted text is
of one fold, the model of all scores it; repeated rows are judged and counted
each, and so are rows that share a labelled id; a document whose labels
contradict each other is neither trusted nor bad; a long text is counted and
scored in slices cut between words, whose sums are the whole's; an empty table
gives no rows; further columns are kept by ``filter_quality`` and ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import HashLookup, byte_runs, give_back, masked, parallelism, segment_sum, segments, settle, stage, table, unstage

ORDER = 5
#: Documents, and distinct n-grams, that a task counts before it hands the sums over; all documents are counted.
FIT_DOCS, FIT_GRAMS = 4_000, 1_000_000
#: n-grams of highest order in all models together that are broadcast at most.
MAX_BROADCAST = 4_000_000
#: Labelled ids in one broadcast, and such broadcasts, at most.
MAX_IDS, MAX_PARTS = 1_000_000, 8
#: Bytes of text in a block, and scored in a run.
BLOCK_BYTES, RUN_BYTES = 32_000_000, 400_000
#: Nearest context bytes that the n-grams met in one group share, and groups that those contexts are dealt into at least, whole contexts each.
SHARED, GROUPS = 2, 256
QUANTILE, MARGIN, WORD_MARGIN = 0.995, 1.02, 2.0
PRIOR = 60
MIN_CALIBRATION = 50
#: Bytes of a text scored at once.
SLICE = 1_000_000


def _packed(raws: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte behind the first ``order`` - 1, packed into a number (oldest byte first), and the bounds of each text's."""
    flat = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    bounds = segments(np.array([len(r) for r in raws], np.int64))
    code = np.zeros(len(flat), np.uint64)
    for k in range(order):
        code[k:] |= flat[: len(flat) - k] << np.uint64(8 * k)
    keep = np.ones(len(flat), bool)
    for k in range(order - 1):
        keep[bounds[:-1] + k] = False
    return code[keep], bounds - (order - 1) * np.arange(len(bounds))


def byte_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, line ends standing before it, and the bounds of each text's."""
    return _packed([b"\n" * (order - 1) + t.encode("utf-8", "surrogatepass") for t in texts], order)


def discounts_of(n: list[float]) -> np.ndarray:
    """What n-grams seen 0, 1, 2 and 3 or more times give up, if ``n`` were seen 1, 2, 3 and 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return np.array([0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) if n[i - 1] else 0.5 for i in (1, 2, 3)])


class KneserNey:
    """Interpolated modified Kneser-Ney estimates from counts of the highest order; of a part of all n-grams, with the ``low`` orders (n-grams, counts) and the ``discounts`` of all."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER, low: dict | None = None, discounts: dict | None = None):
        self.order = order
        order_by = np.argsort(codes)
        grams, c = {order: codes[order_by]}, {order: counts[order_by].astype(np.float64)}
        for k in range(order - 1, 0, -1):  # in how many types of the next order each is the end
            grams[k], n = np.unique(grams[k + 1] & np.uint64((1 << 8 * k) - 1), return_counts=True)
            c[k] = n.astype(np.float64)
            if k in (low or {}):
                grams[k], c[k] = low[k]
        self.floor = np.log(1 / 256)
        self.logp, self.find, self.back, self.find_context = {}, {}, {}, {}
        below = None
        for k in range(1, order + 1):
            d = (discounts[k] if k in (discounts or {}) else self._discounts(c[k]))[np.minimum(c[k], 3).astype(int)]
            context, first = np.unique(grams[k] >> np.uint64(8), return_index=True) if k > 1 else (np.zeros(1, np.uint64), np.zeros(1, int))
            if not len(grams[k]):
                break
            size = np.diff([*first, len(grams[k])])
            total = np.repeat(np.add.reduceat(c[k], first), size)
            gamma = np.add.reduceat(d, first) / np.add.reduceat(c[k], first)
            lower = 1 / 256 if k == 1 else below[np.searchsorted(grams[k - 1], grams[k] & np.uint64((1 << 8 * (k - 1)) - 1))]
            below = (c[k] - d) / total + np.repeat(gamma, size) * lower
            self.logp[k], self.find[k] = np.log(below).astype(np.float32), HashLookup(grams[k])
            if k == 1:
                self.floor = float(np.log(gamma[0] / 256)) if gamma[0] > 0 else self.floor
            else:
                self.back[k], self.find_context[k] = np.log(np.maximum(gamma, 1e-9)).astype(np.float32), HashLookup(context)

    @staticmethod
    def _discounts(c: np.ndarray) -> np.ndarray:
        return discounts_of([float((c == i).sum()) for i in range(1, 5)])
    def score(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of each n-gram."""
        out = np.zeros(len(codes), np.float64)
        open_ = np.arange(len(codes))
        for k in range(self.order, 0, -1):
            if k not in self.logp:
                continue
            gram = codes[open_] & np.uint64((1 << 8 * k) - 1)
            at = self.find[k](gram)
            hit = at >= 0
            out[open_[hit]] += self.logp[k][at[hit]]
            open_, gram = open_[~hit], gram[~hit]
            if not len(open_):
                return out
            if k > 1:
                at = self.find_context[k](gram >> np.uint64(8))
                out[open_] += np.where(at >= 0, self.back[k][at], 0)
        out[open_] += self.floor
        return out


def marks(labels: DataFrame) -> DataFrame:
    """doc_id and _good of documents that are trusted (true) or bad (false)."""
    q, t = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))
    both = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(q).alias("q0"), F.max(q).alias("q1"), F.min(t).alias("t0"), F.max(t).alias("t1"))
    good, poor = F.expr("q0 >= 1 and t1 <= 0"), F.expr("q1 <= 0 or t0 >= 1")
    return both.where(good | poor).select("doc_id", good.alias("_good"))


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of trusted documents."""
    return marks(labels).where("_good").select("doc_id")


def bad(labels: DataFrame) -> DataFrame:
    """doc_id of bad documents."""
    return marks(labels).where("not _good").select("doc_id")


def flag(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` with _good of ``known``, which is broadcast in parts of about ``MAX_IDS`` ids, so no text is shuffled, unless it takes over ``MAX_PARTS``."""
    parts = max(1, -(-known.count() // MAX_IDS))
    if parts > MAX_PARTS:
        return docs.join(known.hint("merge"), "doc_id", "left")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    for j in range(parts):
        mine = known.where(part == j).select(F.col("doc_id").alias(f"_id{j}"), F.col("_good").alias(f"_good{j}"))
        docs = docs.join(F.broadcast(mine), F.col("doc_id") == F.col(f"_id{j}"), "left").drop(f"_id{j}")
    return docs.withColumn("_good", F.coalesce(*[f"_good{j}" for j in range(parts)])).drop(*[f"_good{j}" for j in range(parts)])


def _fold() -> Column:
    return F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")


def training_ids(rows: DataFrame) -> list[int]:
    """Ids among trusted ``rows`` (doc_id, text) that only a model which has seen them can score: none, unless all their text is of one fold."""
    some = rows.where(F.length("text") > 0)
    return [] if some.select(_fold()).distinct().count() > 1 else [r.doc_id for r in some.select("doc_id").distinct().collect()]


def _pieces(texts: list[str]) -> Iterator[list[bytes]]:
    """Texts in runs of about ``SLICE`` bytes, a longer one in slices, each with the bytes before it in front."""
    lead, run, size = ORDER - 1, [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass")
        if len(raw) > 2 * SLICE:
            yield from ([piece] for piece in slices(raw, SLICE, lead))
            continue
        run.append(b"\n" * lead + raw)
        size += len(raw)
        if size >= SLICE:
            yield run
            run, size = [], 0
    if run:
        yield run


def learn(flagged: DataFrame) -> DataFrame:
    """code and how often it occurs in trusted text of either fold (n0, n1) and in bad text (n2): all rows of ``flagged`` (text, _good) that are labelled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, sums, docs = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.concatenate(sums)
            return k, np.stack([np.bincount(at, n[:, j], len(k)) for j in range(3)], axis=1)

        def handed() -> pd.DataFrame:
            k, n = merged()
            keys.clear(), sums.clear()
            return pd.DataFrame({"code": k.astype(np.int64)} | {f"n{j}": n[:, j].astype(np.int64) for j in range(3)})

        for pdf in batches:
            for part, texts in pdf.groupby("part")["text"]:
                for raws in _pieces(texts.tolist()):
                    k, n = np.unique(_packed(raws, ORDER)[0], return_counts=True)
                    keys.append(k)
                    sums.append(n[:, None] * (np.arange(3) == part))
                    if len(keys) > 8:
                        k, n = merged()
                        keys[:], sums[:] = [k], [n]
                        if len(k) > FIT_GRAMS:
                            yield handed()
            docs += len(pdf)
            if docs >= FIT_DOCS and keys:
                docs = 0
                yield handed()
            give_back()
        if keys:
            yield handed()

    part = F.when(F.col("_good"), _fold()).otherwise(F.lit(2)).alias("part")
    mine = flagged.where(F.col("_good").isNotNull() & (F.length("text") > 0)).select(part, "text")
    return mine.mapInPandas(count, "code long, n0 long, n1 long, n2 long").groupBy("code").agg(*[F.sum(f"n{j}").alias(f"n{j}") for j in range(3)])


def _counts(n: list[np.ndarray], some: list[bool]) -> list[np.ndarray]:
    """Counts of the models of all trusted text, of what fold 0 and fold 1 haven't in them, and of bad text. ``some``: whether there is any of each part."""
    whole = n[0] + n[1]
    return [whole, n[1] if some[1] else whole, n[0] if some[0] else whole, n[2]]


def slices(raw: bytes, size: int, lead: int) -> Iterator[bytes]:
    """A long text in pieces of about ``size`` bytes that begin at a space, each with the ``lead`` bytes before it."""
    a = 0
    while a < len(raw):
        b = a + size
        while b < len(raw) and raw[b] not in b" \n":
            b += 1
        yield (b"\n" * lead + raw[:b])[-(b - a + lead) :] if a < lead else raw[a - lead : b]
        a = b


def measure(raws: list[bytes], model: KneserNey, other: KneserNey | None, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with the bytes before them in front: nats of each, and how many nats likelier ``other`` finds its worst word."""
    codes, bounds = _packed(raws, order)
    own = model.score(codes)
    nats = -segment_sum(own, bounds)
    worst = np.zeros(len(raws))
    some = np.flatnonzero(np.diff(bounds))
    if other is not None and len(some):
        byte = codes & np.uint64(255)
        opens = (byte == 32) | (byte == 10)
        opens[bounds[some]] = True
        starts = np.flatnonzero(opens)
        by_word = np.add.reduceat(other.score(codes) - own, starts)
        worst[some] = np.maximum.reduceat(by_word, np.searchsorted(starts, bounds[some]))
    return nats, worst


class Resolved:
    """A model's log probabilities of the n-grams of a block."""

    def __init__(self, find: HashLookup, logp: np.ndarray):
        self.find, self.logp = find, logp

    def score(self, codes: np.ndarray) -> np.ndarray:
        return self.logp[self.find(codes)].astype(np.float64)


def _nats(texts: list[str], which: np.ndarray, models: list) -> list[np.ndarray]:
    """Bytes, nats and worst word of each text, by the trusted model of its number and the bad one, the last."""
    *own, other = models
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    if own[0] is None:
        return [size, np.zeros(len(raws)), np.zeros(len(raws))]
    lead = ORDER - 1
    nats, worst = np.zeros(len(raws)), np.full(len(raws), -np.inf)
    for m, model in enumerate(own):
        short = np.flatnonzero((size <= 2 * SLICE) & (which == m))
        if len(short):
            nats[short], worst[short] = measure([b"\n" * lead + raws[k] for k in short.tolist()], model, other)
        for k in np.flatnonzero((size > 2 * SLICE) & (which == m)).tolist():
            for piece in slices(raws[k], SLICE, lead):
                n, w = measure([piece], model, other)
                nats[k], worst[k] = nats[k] + n[0], max(worst[k], w[0])
    return [size, nats, worst]


def _scored(batch, keep: int, names: list[str], models: list) -> Iterator:
    """The first ``keep`` columns of a batch with _bytes, _nats and _worst of its _which and _text, which follow them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text, which = batch.column(keep + 1), batch.column(keep).to_numpy()
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, n in byte_runs(sizes, RUN_BYTES):
        made = _nats([t or "" for t in text.slice(a, n).to_pylist()], which[a : a + n], models)
        yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in batch.columns[:keep]), *map(pa.array, made)], names=names)


def _by_broadcast(rows: DataFrame, keep: list[str], counts: DataFrame, schema: StructType) -> DataFrame:
    got = counts.toArrow()  # MAX_BROADCAST rows at most
    codes, n = got["code"].to_numpy().astype(np.uint64), [got[f"n{j}"].to_numpy() for j in range(3)]
    sent = []
    for c in _counts(n, [bool(x.any()) for x in n]):  # the driver holds one model at a time
        sent.append(rows.sparkSession.sparkContext.broadcast(KneserNey(codes[c > 0], c[c > 0]) if c.any() else None))
    del got, codes, n, c
    give_back()

    def run(batches: Iterator) -> Iterator:
        settle()
        for batch in batches:
            yield from _scored(batch, len(keep), schema.names, [m.value for m in sent])
            give_back()

    scored = stage(rows.mapInArrow(run, schema), "scored")
    for m in sent:  # the staged rows need them no more
        m.destroy()
    return scored


def _summary(pdf: pd.DataFrame, some: list[bool]) -> pd.DataFrame:
    """Of a group's n-grams, for each model: how many of orders above ``SHARED`` were seen 1, 2, 3 and 4 times, and in how many types each n-gram of order ``SHARED`` ends."""
    codes, out = pdf["code"].to_numpy().astype(np.uint64), []
    for m, n in enumerate(_counts([pdf[f"n{j}"].to_numpy() for j in range(3)], some)):
        grams, c = codes[n > 0], n[n > 0]
        for k in range(ORDER, SHARED, -1):
            if k < ORDER:
                grams, c = np.unique(grams & np.uint64((1 << 8 * k) - 1), return_counts=True)
            out += [(m, k, i, int((c == i).sum())) for i in range(1, 5)]
        grams, c = np.unique(grams & np.uint64((1 << 8 * SHARED) - 1), return_counts=True)
        out += [(m, SHARED, int(g), int(x)) for g, x in zip(grams, c)]
    return pd.DataFrame(out, columns=["m", "k", "key", "n"])


def resolve(counts: DataFrame, wanted: DataFrame, some: list[bool]) -> DataFrame:
    """code and its log probability under each model (l0 to l3) for the distinct codes of ``wanted``; n-grams meet their counts in groups that share ``SHARED`` context bytes."""
    near = F.shiftright("code", 8).bitwiseAND(F.lit(256**SHARED - 1))
    dealt = F.pmod(F.xxhash64(near), F.lit(max(GROUPS, 4 * parallelism(counts)))).alias("dealt")
    sums = counts.groupBy(dealt).applyInPandas(lambda pdf: _summary(pdf, some), "m int, k int, key long, n long").groupBy("m", "k", "key").agg(F.sum("n").alias("n")).toPandas()  # 4 * 65,548 rows at most
    low, discounts = [], []
    for m in range(4):
        mine = sums[sums["m"] == m]
        pairs = mine[mine["k"] == SHARED].sort_values("key")
        orders = {SHARED: (pairs["key"].to_numpy().astype(np.uint64), pairs["n"].to_numpy().astype(np.float64))}
        for k in range(SHARED - 1, 0, -1):
            grams, n = np.unique(orders[k + 1][0] & np.uint64((1 << 8 * k) - 1), return_counts=True)
            orders[k] = grams, n.astype(np.float64)
        low.append(orders)
        discounts.append({k: discounts_of([float(mine[(mine["k"] == k) & (mine["key"] == i)]["n"].sum()) for i in range(1, 5)]) for k in range(SHARED + 1, ORDER + 1)})
    sent = counts.sparkSession.sparkContext.broadcast((low, discounts))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, asked = pdf["code"].to_numpy().astype(np.uint64), pdf["asked"].to_numpy()
        out = {"code": pdf["code"].to_numpy()[asked]}
        for m, n in enumerate(_counts([pdf[f"n{j}"].to_numpy() for j in range(3)], some)):
            low, discounts = sent.value[0][m], sent.value[1][m]
            out[f"l{m}"] = KneserNey(codes[n > 0], n[n > 0], ORDER, low, discounts).score(codes[asked]).astype(np.float32)
        return pd.DataFrame(out)

    both = counts.withColumn("asked", F.lit(False)).unionByName(wanted.select("code", *[F.lit(0).cast("long").alias(f"n{j}") for j in range(3)], F.lit(True).alias("asked")).distinct())
    return both.groupBy(dealt).applyInPandas(score, "code long, l0 float, l1 float, l2 float, l3 float")


def _by_blocks(rows: DataFrame, keep: list[str], counts: DataFrame, some: list[bool], schema: StructType) -> DataFrame:
    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = block + (size + np.cumsum(sizes) - sizes) // BLOCK_BYTES
            size += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["_block", *batch.schema.names])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, texts in pdf.groupby("_block")["_text"]:
                for raws in _pieces(texts.tolist()):
                    yield pd.DataFrame({"_block": block, "code": np.unique(_packed(raws, ORDER)[0]).astype(np.int64)})

    docs = stage(rows.mapInArrow(cut, StructType([StructField("_block", LongType()), *rows.schema.fields])), "blocks")
    held = docs.where(F.length("_text") > 0).select("_block", "_text").mapInPandas(grams, "_block long, code long")
    held = stage(held.distinct(), "held")
    logp = stage(resolve(counts, held, some), "resolved")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    looked = held.join(logp, "code").select("_block", F.lit(0).alias("_kind"), *none, F.col("code").alias("_code"), *[F.col(f"l{m}").alias(f"_l{m}") for m in range(4)])
    blank = [F.lit(None).cast("long").alias("_code"), *[F.lit(None).cast("float").alias(f"_l{m}") for m in range(4)]]
    dealt = looked.unionByName(docs.select("_block", F.lit(1).alias("_kind"), *rows.columns, *blank))
    names, wide = rows.columns, len(rows.columns)
    there = [some[0] or some[1]] * 3 + [some[2]]

    def run(batches: Iterator) -> Iterator:
        """Rows by block and kind: a block's n-grams, then its documents."""
        import pyarrow as pa

        settle()
        block, found, models = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part, at = batch.slice(a, b - a), int(keys[a]) // 2
                if at != block:
                    block, found, models = at, [], None
                if keys[a] % 2 == 0:
                    found.append([part.column(wide + 2 + j).to_numpy() for j in range(5)])
                    continue
                if models is None:
                    code, *lp = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), *[np.zeros(0, np.float32)] * 4)
                    order = np.argsort(code)
                    find, found = HashLookup(code[order].astype(np.uint64)), []
                    models = [Resolved(find, x[order]) if t else None for x, t in zip(lp, there)]
                own = pa.RecordBatch.from_arrays(part.columns[2 : wide + 2], names=names)
                yield from _scored(own, len(keep), schema.names, models)
            give_back()

    blocks = docs.select("_block").distinct().count()
    ordered = dealt.repartition(max(blocks, parallelism(rows)), "_block").sortWithinPartitions("_block", "_kind")
    scored = stage(ordered.mapInArrow(run, schema), "scored")
    for done in (docs, held, logp):
        unstage(done)
    return scored


def perplexities(flagged: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and _good of ``flagged``, with _bytes, _nats (the negative log probability of the whole text) and _worst (of its worst word), stored."""
    keep = [*keep, "_good"]
    which = F.when(F.col("_good") & F.col("text").isNotNull(), _fold() + 1).otherwise(F.lit(0)).alias("_which")
    rows = flagged.select(*keep, which, F.col("text").cast("string").alias("_text"))
    schema = StructType([*rows.schema.fields[: len(keep)], *StructType.fromDDL("_bytes long, _nats double, _worst double").fields])
    counts = stage(learn(flagged), "counts")
    n = counts.select(*[F.count_if(F.col(f"n{j}") > 0).alias(f"n{j}") for j in range(3)], F.count_if(F.expr("n0 + n1 > 0")).alias("good")).first()
    if n.good + n.n0 + n.n1 + n.n2 <= MAX_BROADCAST:  # checked
        scored = _by_broadcast(rows, keep, counts, schema)
    else:
        scored = _by_blocks(rows, keep, counts, [n.n0 > 0, n.n1 > 0, n.n2 > 0], schema)
    unstage(counts)
    return scored


def _shrunk(nats, size, median):
    return (nats + PRIOR * median) / (size + PRIOR)


def thresholds(good: DataFrame) -> DataFrame:
    """lang (null: all together), median and limit, in nats a byte, and worst, the limit of a word, of all scored trusted rows ``good``.

    Values are rounded, so an exact percentile holds a bounded number of them.
    """
    scored = good.select("lang", "_bytes", "_nats", "_worst")
    each = scored.where("lang is not null").unionByName(scored.withColumn("lang", F.lit(None).cast("string")))
    medians = each.groupBy("lang").agg(F.percentile(F.round(F.col("_nats") / F.col("_bytes"), 4), 0.5).alias("median"), F.count("*").alias("n")).where((F.col("n") >= MIN_CALIBRATION) | F.col("lang").isNull())
    judged = each.join(F.broadcast(medians.withColumnRenamed("lang", "_l")), F.col("lang").eqNullSafe(F.col("_l")))  # a row for each language
    return judged.groupBy("lang").agg(
        F.first("median").alias("median"),
        (F.percentile(F.round(_shrunk(F.col("_nats"), F.col("_bytes"), F.col("median")), 4), QUANTILE) + float(np.log(MARGIN))).alias("limit"),
        (F.percentile(F.round("_worst", 2), QUANTILE) + WORD_MARGIN).alias("worst"),
    )


def classify(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (with doc_id and lang) and _perplexity, _judged, _threshold, _worst, _worst_threshold, _bytes, _accepted.

    Every document is scored once and stored with its scores.
    """
    spark = docs.sparkSession
    known = stage(marks(labels), "marks")
    flagged = flag(docs.select(*dict.fromkeys([*keep, "doc_id", "lang", "text"])), known)
    scored = perplexities(flagged, keep)
    unstage(known)
    limits = thresholds(scored.where("_good and _bytes > 0")).toPandas()  # a row for each language
    if limits.empty:
        limits = pd.DataFrame([(None, 0.0, float("inf"), float("inf"))], columns=["lang", "median", "limit", "worst"])
    everything = limits[limits["lang"].isna()].iloc[0]
    named = limits[limits["lang"].notna()]
    own = spark.createDataFrame([(r.lang, r.median, r.limit, r.worst) for r in named.itertuples()], "_l string, _median double, _limit double, _most double")
    scored = scored.join(F.broadcast(own), F.col("lang") == F.col("_l"), "left").drop("_l")  # a row for each language with MIN_CALIBRATION trusted documents
    median, limit, most = (F.coalesce(c, F.lit(float(everything[n]))) for c, n in (("_median", "median"), ("_limit", "limit"), ("_most", "worst")))
    shrunk = (F.col("_nats") + F.lit(PRIOR) * median) / (F.col("_bytes") + PRIOR)
    fine = (F.col("_bytes") > 0) & (shrunk <= limit) & (F.col("_worst") <= most)
    mean = F.when(F.col("_bytes") > 0, F.col("_nats") / F.col("_bytes")).otherwise(F.lit(0.0))
    return scored.select(*keep, F.exp(mean).alias("_perplexity"), F.exp(shrunk).alias("_judged"), F.exp(limit).alias("_threshold"), "_worst", most.alias("_worst_threshold"), "_bytes", fine.alias("_accepted"))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    apart, names, back = masked(docs, "doc_id", "text", "lang")
    return back(classify(apart, labels, [*names, "doc_id", "lang"]).where("_accepted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id", "lang"])
    return found.select("doc_id", "lang", F.col("_bytes").alias("n_bytes"), F.col("_perplexity").alias("perplexity"), F.col("_judged").alias("judged_perplexity"), F.col("_threshold").alias("threshold"), F.col("_worst").alias("worst_word"), F.col("_worst_threshold").alias("worst_word_threshold"), F.col("_accepted").alias("accepted"))
