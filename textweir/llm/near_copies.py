"""Near copies by word shingles: all pairs of texts whose shingle sets have a Jaccard similarity of ``SIMILARITY`` or more.

SimHash within few bits finds copies and the nearest of near copies; at a
similarity of 0.8 fingerprints differ in about ten of 64 bits, where a
pigeonhole on them would probe nearly everything. So near copies get candidates
of their own: ``BANDS`` keys of ``ROWS`` minimum hashes each. A pair at the
threshold misses all keys with a chance of (1 - 0.8^5)^32, 3 in a million, one
at 0.9 with 10^-12. Every candidate is verified on the whole sets.

Texts of equal words are one entry. Keys that at most ``CROWD`` texts share are
paired out, which is a bounded number of pairs a text. Above it, texts agree on
five minimum hashes and so resemble each other; there each meets one member: for
half of the keys the most central, which shares crowded keys with most others,
for the rest one by hash, so a large group costs a pair a text and key. Members
that aren't near theirs go on as a smaller crowd, ``ROUNDS`` times at most. Texts
of a crowd that are near each other, but to none of the ten or so members that
either meets over its keys, can miss their link; no row is left out.

Defined cases: a text of fewer words than a shingle is one shingle; a null text,
or one without words, has no shingle and no near copies; repeated rows are one
entry; an empty table gives no links. Shingles count by 64-bit hashes. A long
text takes about 60 bytes a word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, map_text, segments, stage, unstage
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
CROWD, ROUNDS = 8, 3
#: Rows of row numbers that are broadcast at most; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_factors = (np.random.default_rng(5).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased), text by text, and the bounds of each text's."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
    words = parts.values.dictionary_encode()
    names = words.dictionary.to_pylist()
    code = np.fromiter((xxhash.xxh64_intdigest(w) for w in names), np.uint64, len(names))
    at = words.indices.to_numpy()
    bounds = parts.offsets.to_numpy().astype(np.int64)
    empty = np.fromiter((not w for w in names), bool, len(names))[at] if len(names) else np.zeros(0, bool)
    return code[at[~empty]], segments(~empty)[bounds]


def shingles(code: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, or of a whole shorter text, repeats included, and the bounds of each text's."""
    n = np.diff(bounds)
    m = np.maximum(n - k + 1, n > 0)
    at, end = gather(bounds[:-1], m), np.repeat(bounds[1:], m)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = at + j < end
        h = np.where(inside, (h ^ (h >> np.uint64(29))) * _M + code[np.minimum(at + j, len(code) - 1)], h) if len(code) else h
    return (h ^ (h >> np.uint64(32))) * _M, segments(m)


def sketch(texts: list[str]) -> list:
    """For each text the digest of its words (null without any) and its keys."""
    code, bounds = word_codes(texts)
    same = [hashlib.md5(code[a:b].tobytes()).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    h, at = shingles(code, bounds)
    some = np.flatnonzero(np.diff(at))
    keys: list = [None] * len(texts)
    if len(some):
        low = (h >> np.uint64(32)).astype(np.uint32)
        made = np.zeros((len(some), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64) * _M
            for row in range(ROWS):
                least = np.minimum.reduceat(low * _factors[band * ROWS + row], at[some])
                key = (key ^ (key >> np.uint64(29))) * _M + least
            made[:, band] = key
        for k, row in zip(some.tolist(), made.view(np.int64)):
            keys[k] = row
    return [same, keys]


SKETCH = "_same binary, _keys array<bigint>"


def _sets(rows: DataFrame) -> DataFrame:
    """_place and _set, the distinct shingles of each text (_place, text)."""

    def compute(texts: list[str]) -> list:
        h, at = shingles(*word_codes(texts))
        return [[np.unique(h[a:b]).view(np.int64) for a, b in zip(at[:-1], at[1:])]]

    return map_text(rows, ["_place"], "_set array<bigint>", compute)


def only(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Rows by their _place, ``left_semi`` or ``left_anti``; few places are broadcast, after a count."""
    small = places.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(places) if small else places, "_place", how)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets are as similar as asked."""
    a = sets.select(F.col("_place").alias("u"), F.col("_set").alias("a"))
    b = sets.select(F.col("_place").alias("v"), F.col("_set").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    near = F.size("a") * similarity <= F.size("b")
    near = near & (F.size("b") * similarity <= F.size("a"))
    j = pairs.join(a, "u").join(b, "v").where(near)
    return j.where(both >= (F.size("a") + F.size("b") - both) * similarity).select("u", "v")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _paired(members: DataFrame) -> DataFrame:
    """All pairs of the few members (key, _place) of each key."""
    return members.withColumnRenamed("_place", "u").join(members.withColumnRenamed("_place", "v"), "key").where("u < v").select("u", "v").distinct()


def _first(share: float):
    """How many of m sorted shingles may hold the first shared one if ``share`` of m are shared at least."""
    return F.col("m") - F.ceil(F.col("m") * share - 1e-6) + 1


def _prefixed(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: pairs of ``members`` (_place, _of) of different components _of that can be as similar as asked; none that are is missing."""
    both = 2 * similarity / (1 + similarity)
    flat = members.join(sets, "_place").select("_place", "_of", F.size("_set").alias("m"), F.explode("_set").alias("s"))
    counted = flat.join(flat.groupBy("s").agg(F.count("*").alias("n")), "s")
    sorted_ = counted.groupBy("_place", "_of", "m").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("a"))
    head = sorted_.select("_place", "_of", "m", F.posexplode(F.slice("a", F.lit(1), _first(similarity).cast("int"))).alias("at", "x")).where("x.n > 1").select("_place", "_of", "m", "at", F.col("x.s").alias("s"))
    head = stage(head, "prefixes")
    # Pairs inside a shingle's largest component aren't even met.
    sizes = head.groupBy("s", "_of").agg(F.count("*").alias("n"))
    main = sizes.groupBy("s").agg(F.max_by("_of", F.struct("n", "_of")).alias("main"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = stage(head.join(main, "s").withColumn("out", F.col("_of") != F.col("main")).drop("main"), "met")
    low = met.where(F.col("at") < _first(both)).select("s", *[F.col(c).alias(f"{c}_a") for c in ("_place", "_of", "m", "at", "out")])
    high = met.select("s", *[F.col(c).alias(f"{c}_b") for c in ("_place", "_of", "m", "at", "out")])
    smaller = (F.col("m_a") < F.col("m_b")) | ((F.col("m_a") == F.col("m_b")) & (F.col("_place_a") < F.col("_place_b")))
    room = F.least(F.col("m_a") - F.col("at_a"), F.col("m_b") - F.col("at_b")) >= F.ceil((F.col("m_a") + F.col("m_b")) * (both / 2) - 1e-6)
    fits = (F.col("_of_a") != F.col("_of_b")) & smaller & (F.col("m_a") >= F.col("m_b") * similarity - 1e-6) & room
    found = low.where("out_a").join(high, "s").where(fits).unionByName(low.where("not out_a").join(high.where("out_b"), "s").where(fits))
    return _ordered(found.select(F.col("_place_a").alias("u"), F.col("_place_b").alias("v")))


def _rest(crowded: DataFrame, known: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The near pairs (u, v) that join components of ``known`` links within keys of ``crowded`` (key, _place)."""
    of = components(known).withColumnRenamed("node", "_place")
    mine = stage(crowded.join(of, "_place", "left").select("key", "_place", F.coalesce("component", "_place").alias("_of")), "crowded")
    mixed = mine.groupBy("key").agg(F.min("_of").alias("a"), F.max("_of").alias("b")).where("a <> b").select("key")
    members = stage(mine.join(mixed, "key", "left_semi").select("_place", "_of").distinct(), "members")
    return _verified(_prefixed(members, sets, similarity), sets, similarity)


def links(sketched: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """u, v: near copies by _place with the components of all, of stored rows (_place, text, and those of ``SKETCH``); of equal texts the least place stands for all."""
    entries = stage(sketched.where("_same is not null").groupBy("_same").agg(F.min("_place").alias("_place"), F.first("_keys").alias("_keys")).select("_place", "_keys"), "entries")
    keyed = entries.select("_place", F.explode("_keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(keyed.join(sizes, "key"), "shared")
    sets = stage(_sets(only(sketched.select("_place", "text"), shared.select("_place").distinct(), "left_semi")), "sets")
    calm = shared.where(F.col("n") <= CROWD).select("key", "_place")
    found = [stage(_verified(_paired(calm), sets, similarity), "near")]
    open_ = shared.where(F.col("n") > CROWD).select("key", "_place", "n")
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        central = open_.groupBy("_place").agg(F.sum("n").alias("t"))
        rank = F.struct(F.when(F.col("key") % 2 == 0, F.col("t")).otherwise(F.lit(0)), F.xxhash64("key", "_place"))
        leaders = open_.join(central, "_place").groupBy("key").agg(F.max_by("_place", rank).alias("leader"))
        led = open_.join(leaders, "key").where("_place <> leader")
        met = stage(_verified(_ordered(led.select(F.col("_place").alias("u"), F.col("leader").alias("v"))), sets, similarity), "near")
        found.append(met)
        both = met.unionByName(met.select(F.col("v").alias("u"), F.col("u").alias("v")))
        left = led.join(both.select(F.col("u").alias("_place"), F.col("v").alias("leader")), ["_place", "leader"], "left_anti").select("key", "_place")
        left = stage(left.join(left.groupBy("key").agg(F.count("*").alias("n")), "key"), "left")
        few = left.where(F.col("n") <= CROWD).select("key", "_place")
        found.append(stage(_verified(_paired(few), sets, similarity), "near"))
        open_ = left.where(F.col("n") > CROWD)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    crowded = shared.where(F.col("n") > CROWD).select("key", "_place")
    if not crowded.isEmpty():
        out = out.unionByName(stage(_rest(crowded, out, sets, similarity), "near"))
    for done in (entries, shared, sets):
        unstage(done)
    return out.distinct()
