import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textweir.llm import simhash
from textweir.llm.components import components


def plain_fingerprint(text, k=3):
    ws = (text or "").encode().lower().split()
    parts = [b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(pairs):
    """{index: least index reachable} of (a, b) pairs."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_documents(docs, texts):
    got = simhash.group(docs, ["doc_id"]).collect()
    assert len(got) == len(texts)
    prints = [(i, plain_fingerprint(t)) for i, t, _ in texts]
    of = {i: f for i, f in prints if i != 407}
    assert all(r._fp & (2**64 - 1) == of[r.doc_id] for r in got if r.doc_id in of)
    distinct = sorted({f for _, f in prints})
    comp = plain_components([(a, b) for a in distinct for b in distinct if (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in prints:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    assert all(r._component == least.get(comp[r._fp & (2**64 - 1)]) for r in got)


@pytest.mark.parametrize("bucket", [256, 3, 0])
@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_lose_none(spark, radius, bucket, monkeypatch):
    """Clusters of close fingerprints, with buckets paired out or met at their neighbours."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(radius)
    fps = set()
    for _ in range(12):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(25):
            f ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "_fp long"), radius)
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    got = {r.node: r.component for r in components(links).collect()}
    want = plain_components([(a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= radius])
    assert {k: v for k, v in want.items()} == {k: got.get(k, k) for k in want}


@pytest.mark.parametrize("thresholds", [(1, 0), (0, 1), (2, -1), (0, 0, 0), (1, -1, 0)])
def test_links_under_any_thresholds(spark, thresholds, monkeypatch):
    width = 64 // len(thresholds)
    groups = [(list(range(i * width, (i + 1) * width if i + 1 < len(thresholds) else 64)), t) for i, t in enumerate(thresholds)]
    monkeypatch.setattr(simhash, "plan", lambda *_: [(g, t) for g, t in groups if t >= 0] if thresholds != (2, -1) else [(list(range(64)), 2)])
    test_links_lose_none(spark, 2, 256, monkeypatch)


def test_plans_hold_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    for total in (100, 10**6, 10**11):
        chosen = simhash.plan(fps, total)
        assert sum(t + 1 for _, t in chosen) == 3
        bits = [b for g, _ in chosen for b in g]
        assert len(bits) == len(set(bits))


def test_components_of_long_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}}


def test_a_long_text_has_the_fingerprint_of_its_pieces(monkeypatch):
    from textweir.llm import common

    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["ab", "Abc", "\t cab", "é", "bb"]) for _ in range(n)) for n in (0, 1, 2, 3, 900, 5_000)]
    want = simhash.fingerprints_of(texts).tolist()
    monkeypatch.setattr(simhash, "LONG", -1)
    monkeypatch.setattr(simhash, "word_runs", lambda raw: common.word_runs(raw, 100))
    assert simhash.fingerprints_of(texts).tolist() == want


def test_dedup_keeps_one_row_and_its_columns(docs):
    kept = simhash.deduplicate(docs, similarity=None)
    assert kept.columns == docs.columns
    found = simhash.group(docs, ["doc_id"])
    assert kept.count() == found.select("_component").distinct().count()
    assert kept.where(F.col("doc_id").between(201, 224)).count() == 0 and kept.where("doc_id = 407").count() <= 2


def test_nothing(no_docs):
    assert simhash.group(no_docs, ["doc_id"]).count() == 0 and simhash.deduplicate(no_docs).count() == 0
