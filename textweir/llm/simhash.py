"""Operator 4: SimHash near-duplicates by the generalised pigeonhole principle.

A document's 64-bit fingerprint comes from the XXH64 values of its word
shingles. Only distinct fingerprints are compared, so copies cost nothing more.
Fingerprints within ``radius`` bits are found so: the 64 bits are grouped into
partitions, correlated bits together, and partition i gets a threshold t_i of
its own, -1 for none, with sum(t_i + 1) = radius + 1; then two fingerprints
within the radius agree within t_i bits on some partition i. Grouping and
thresholds are chosen by dynamic programming on candidate counts estimated
from a bounded sample; they change the cost, never the result. Each fingerprint
probes all values within t_i of its own, candidates are verified on all bits.
A bucket of more than ``BUCKET`` fingerprints isn't paired out: each member
emits itself and its 64 neighbours at one bit, and those that meet at a value
are linked with the least that meets there. Two fingerprints within 2 bits of
each other always meet, and those that meet are within 2 bits, so no link is
lost and the work is linear. Links become components in rounds of stars.

Defined cases: a null or empty text, or one without words, has fingerprint 0,
linked like any other; fewer words than a shingle are one shingle; repeated rows
get the same answer each; a null id is in no component of its own number: its
component is the least id reachable, null if there is none; a long text is
hashed piece by piece; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import map_text, masked, segments, stage, table, word_runs
from .components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints sampled to choose partitions and thresholds.
PLAN_SAMPLE = 2_000
#: Members of a bucket that are still compared pair by pair.
BUCKET = 256
#: Characters from which on a text's shingles are counted piece by piece.
LONG = 8_000_000


def shingle_hashes(text: str | None, k: int = SHINGLE) -> list[int]:
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z alone; space and U+0009 to U+000D
    if not ws:
        return []
    of, join = xxhash.xxh64_intdigest, b" ".join
    if len(ws) < k:
        return [of(join(ws), SEED)]
    return [of(join(s), SEED) for s in zip(*(ws[i:] for i in range(k)))]


def fingerprints_of(texts: list[str | None], k: int = SHINGLE) -> np.ndarray:
    """One uint64 per text: the bits that over half of its shingle hashes have."""
    out = np.zeros(len(texts), np.uint64)
    long = [i for i, t in enumerate(texts) if len(t or "") > LONG]
    for i in long:
        out[i] = _long_fingerprint(texts[i], k)
    per = [shingle_hashes(t, k) if len(t or "") <= LONG else [] for t in texts]
    sizes = np.array([len(h) for h in per], np.int64)
    flat = np.fromiter((h for hs in per for h in hs), np.uint64, int(sizes.sum()))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = _majority(_bit_counts(flat, segments(sizes)[some], sizes[some]), sizes[some])
    return out


def _bit_counts(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of the hashes of each text (from ``starts``, one at least) have each bit."""
    out = np.zeros((len(sizes), 64), np.int64)
    lanes = np.uint64(0x0101010101010101)
    # Runs of at most 255 hashes, so eight counts at a time fit the bytes of one number.
    runs = -(-sizes // 255)
    begin = np.repeat(starts, runs) + 255 * gather_ranks(runs)
    first = segments(runs)[:-1]
    for b in range(8):
        byte = np.add.reduceat((flat >> np.uint64(b)) & lanes, begin)
        out[:, b::8] = np.add.reduceat(byte.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def _majority(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    bits = (counts * 2 > sizes[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1)


def _long_fingerprint(text: str, k: int) -> np.uint64:
    """That of a long text, whose shingles are counted piece by piece."""
    counts, n, held = np.zeros((1, 64), np.int64), 0, []
    of, join = xxhash.xxh64_intdigest, b" ".join
    for ws in word_runs(text.encode("utf-8", "surrogatepass").lower()):
        held += ws
        if len(held) >= k:
            h = np.fromiter((of(join(s), SEED) for s in zip(*(held[i:] for i in range(k)))), np.uint64, len(held) - k + 1)
            counts += _bit_counts(h, np.zeros(1, np.int64), np.array([len(h)]))
            n, held = n + len(h), held[len(held) - k + 1 :]
    if not n:
        return np.uint64(of(join(held), SEED)) if held else np.uint64(0)
    return _majority(counts, np.array([n]))[0]


def gather_ranks(runs: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run."""
    return np.arange(runs.sum()) - np.repeat(segments(runs)[:-1], runs)


def fingerprint(docs: DataFrame, keep: list[str], k: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and _fp, the fingerprint as a signed long."""
    return map_text(docs, keep, "_fp long", lambda texts: [fingerprints_of(texts, k).view(np.int64)])


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def _grouped(bits: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in ``parts`` groups: each starts with the freest bit and takes those that correlate with it most."""
    with np.errstate(all="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 2 else np.zeros((64, 64))
    free, out = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [min(free, key=lambda b: (corr[b, free].sum(), b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (corr[b, group].mean(), -b)))
            free.remove(group[-1])
        out.append(sorted(group))
    return out


def plan(fps: np.ndarray, total: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] with sum(threshold + 1) = radius + 1, the cheapest by estimated probes and candidates."""
    bits = _bits(fps) if len(fps) else np.zeros((0, 64))
    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, 7):
        groups = _grouped(bits, parts)
        costs = []
        for g in groups:
            p = bits[:, g].mean(0) if len(bits) else np.full(len(g), 0.5)
            same = np.clip(p * p + (1 - p) * (1 - p), 1e-9, 1)
            sub = bits[:, g]
            agree = sub @ sub.T + (1 - sub) @ (1 - sub).T
            away = len(g) - agree[np.triu_indices(len(sub), 1)] if len(sub) > 1 else np.zeros(0)
            near = np.zeros(len(g) + 1)
            near[0] = 1.0
            for s in same:  # distribution of the distance if the bits were independent
                near[1:] = near[1:] * s + near[:-1] * (1 - s)
                near[0] *= s
            row = [0.0]
            for t in range(radius + 1):
                chance = max(near[: t + 1].sum(), float((away <= t).mean()) if len(away) else 0)
                probes = sum(1 for d in range(t + 1) for _ in combinations(range(len(g)), d))
                row.append(total * (1 + probes) + chance * total * total / 2)
            costs.append(row)
        # least[b]: cheapest way to give the partitions so far b = sum(t + 1).
        least = {0: (0.0, [])}
        for g, row in zip(groups, costs):
            step: dict[int, tuple[float, list]] = {}
            for b, (cost, chosen) in least.items():
                for t1 in range(radius + 2 - b):
                    if t1 <= min(radius + 1, len(g) + 1):
                        at = (cost + row[t1], [*chosen, (g, t1 - 1)])
                        if b + t1 not in step or at[0] < step[b + t1][0]:
                            step[b + t1] = at
            least = step
        if radius + 1 in least and least[radius + 1][0] < best[0]:
            best = least[radius + 1]
    return [(g, t) for g, t in best[1] if t >= 0]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _probe(part: int, base):
    return lambda x: F.struct(F.lit(part).alias("part"), base.bitwiseXOR(x).alias("key"))


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: links whose components are those of all pairs of fingerprints (_fp) within ``radius`` (2 at most) bits."""
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0 to 2")
    sample = [r[0] for r in distinct.select("_fp").orderBy(F.xxhash64("_fp")).limit(PLAN_SAMPLE).collect()]
    chosen = plan(np.array(sample, np.int64).view(np.uint64), distinct.count(), radius)
    keys, probes = [], []
    for i, (bits, t) in enumerate(chosen):
        mask = F.lit(_signed(sum(1 << b for b in bits))).cast("long")
        flips = [_signed(sum(1 << b for b in c)) for d in range(t + 1) for c in combinations(bits, d)]
        keys.append(F.struct(F.lit(i).alias("part"), F.col("_fp").bitwiseAND(mask).alias("key")))
        base = F.col("_fp").bitwiseAND(mask)
        probes.append(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), _probe(i, base)))
    index = distinct.select("_fp", F.explode(F.array(*keys)).alias("k")).select("_fp", "k.part", "k.key")
    probing = distinct.select("_fp", F.explode(F.concat(*probes)).alias("k")).select(F.col("_fp").alias("other"), "k.part", "k.key") if any(t for _, t in chosen) else index.withColumnRenamed("_fp", "other")
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    crowded = sizes.where(F.col("n") > BUCKET).select("part", "key")
    calm = index.join(crowded, ["part", "key"], "left_anti")
    # A pair is verified on all bits inside the join.
    pairs = calm.join(probing, ["part", "key"]).where((F.col("_fp") < F.col("other") if not any(t for _, t in chosen) else F.col("_fp") != F.col("other")) & (F.bit_count(F.col("_fp").bitwiseXOR(F.col("other"))) <= radius))
    pairs = pairs.select(F.least("_fp", "other").alias("u"), F.greatest("_fp", "other").alias("v")).distinct()
    if not crowded.limit(1).count():
        return pairs
    probing_crowd = probing.join(crowded, ["part", "key"], "left_semi").select(F.col("other").alias("_fp"))
    crowd = index.join(crowded, ["part", "key"], "left_semi").select("_fp").unionByName(probing_crowd).distinct()
    return pairs.unionByName(_meeting(crowd, radius)).distinct()


def _meeting(fps: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints with the least one they meet at a value one bit away (radius 2), or at each other's (radius 1)."""
    flips = F.array(*[F.lit(_signed(1 << b)).cast("long") for b in range(64)]) if radius else F.array().cast("array<bigint>")
    spread = fps.select("_fp", F.explode(F.concat(F.array(F.col("_fp")), F.transform(flips, lambda x: F.col("_fp").bitwiseXOR(x)))).alias("at"))
    if radius == 1:  # meet only where one of the two stands
        spread = spread.join(fps.select(F.col("_fp").alias("at")), "at", "left_semi")
        direct = spread.where("_fp <> at")
        return direct.select(F.least("_fp", "at").alias("u"), F.greatest("_fp", "at").alias("v"))
    least = spread.groupBy("at").agg(F.min("_fp").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    return spread.join(least, "at").where("_fp <> u").select("u", F.col("_fp").alias("v"))


def _labelled(prints: DataFrame, keep: list[str], radius: int, more: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` of stored rows (doc_id, _fp), _fp and _component; ``more`` has further links of fingerprints (u, v)."""
    distinct = stage(prints.groupBy("_fp").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")), "distinct")
    links = near_links(distinct, radius)
    found = components(links if more is None else links.unionByName(more))
    # Only fingerprints with several documents or with links need an answer from elsewhere.
    labelled = distinct.join(found.withColumnRenamed("node", "_fp"), "_fp", "left")
    least = labelled.where("component is not null").groupBy("component").agg(F.min("_least").alias("_c"))
    shared = labelled.where("_n > 1 or component is not null").join(least, "component", "left").select("_fp", F.coalesce("_c", "_least").alias("_c"))
    return prints.join(shared, "_fp", "left").select(*keep, "_fp", F.coalesce("_c", "doc_id").alias("_component"))


def group(docs: DataFrame, keep: list[str], radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` (with doc_id), _fp and _component, the least doc_id reachable."""
    return _labelled(stage(fingerprint(docs, keep, k), "fingerprints"), keep, radius)


def deduplicate(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, similarity: float | None = near_copies.SIMILARITY) -> DataFrame:
    """One document of each component stays, that with the least id, with its own columns; of its repeated rows the first.

    Links are those of fingerprints, and near copies by shingles of five words
    (``near_copies``; none if ``similarity`` is None), whose equal fingerprints
    carry them. Rows are stored once, with a number each, and found by it again.
    """
    apart, names, back = masked(docs, "doc_id", "text")

    def compute(texts: list[str]) -> list:
        return [fingerprints_of(texts, k).view(np.int64), *near_copies.sketch(texts)]

    placed = map_text(apart.withColumn("_place", F.monotonically_increasing_id()), [*names, "doc_id", "_place"], f"_fp long, {near_copies.SKETCH}", compute)
    rows = stage(placed, "sketched")
    text = F.col(names[docs.columns.index("text")]).alias("text")
    more = None
    if similarity is not None:
        fps = rows.select("_place", "_fp")
        found = near_copies.links(rows.select("_place", text, "_same", "_keys"), similarity)
        more = found.join(fps.select(F.col("_place").alias("u"), F.col("_fp").alias("a")), "u").join(fps.select(F.col("_place").alias("v"), F.col("_fp").alias("b")), "v")
        more = more.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    grouped = _labelled(rows.select("doc_id", "_place", "_fp"), ["doc_id", "_place"], radius, more)
    first = grouped.groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_place")).alias("first"), F.count("*").alias("n"))
    several = first.where("n > 1").select(F.col("_component").alias("_c"), F.col("first._place").alias("_first"))
    met = grouped.select("_component", "_place").join(several, F.col("_component").eqNullSafe(F.col("_c")))
    dropped = stage(met.where("_place <> _first").select("_place"), "dropped")
    return back(near_copies.only(rows, dropped, "left_anti"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = group(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
