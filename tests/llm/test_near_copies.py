import random

import pytest
from pyspark.sql import functions as F

from textweir.llm import near_copies, simhash
from textweir.llm.common import map_text


def sets(text, k=5):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + k]) for i in range(max(len(ws) - k + 1, min(len(ws), 1)))}


def similarity(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def varied(rnd, ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[rnd.randrange(len(ws))] = rnd.choice("xyzuvw") * 3
    return " ".join(ws)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    line = " ".join(word() for _ in range(8))
    texts = []
    for _ in range(12):
        ws = [word() for _ in range(rnd.randint(60, 160))]
        texts += [" ".join(ws)] + [varied(rnd, ws, rnd.randint(1, 4)) for _ in range(3)]
    crowd = [word() for _ in range(150)]  # a large group around its first text
    texts += [" ".join(crowd)] + [varied(rnd, crowd, 3) for _ in range(120)]
    texts += [" ".join([word() for _ in range(60)]) + " " + line for _ in range(90)]  # a common line is no near copy
    texts += ["short text", "Short  TEXT", "", None, "one", texts[0], texts[0].upper()]
    rows = [(i, t, i % 3) for i, t in enumerate(texts)]
    path = f"file://{tmp_path_factory.mktemp('near')}/d"
    spark.createDataFrame(rows, "doc_id long, text string, _place int").repartition(3).write.parquet(path)
    return texts, spark.read.parquet(path)


def groups(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("crowd", [64, 8, 3])
def test_links_are_those_of_all_pairs(corpus, crowd, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    texts, docs = corpus
    rows = map_text(docs.select(F.col("doc_id").alias("_place"), "text"), ["_place", F.col("text")], near_copies.SKETCH, near_copies.sketch)
    got = {(r.u, r.v) for r in near_copies.links(rows).collect()}
    n = len(texts)
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(" ".join((t or "").lower().split()), i)
    first = sorted(i for key, i in same.items() if key)
    true = {(a, b) for x, a in enumerate(first) for b in first[x + 1 :] if similarity(texts[a], texts[b]) >= 0.8}
    assert got <= true and len(true) > 120
    if crowd == 64:
        assert groups(got, n) == groups(true, n)
    else:  # a small crowd: central members stand for the rest
        assert sum(x == y for x, y in zip(groups(got, n), groups(true, n))) > 0.98 * n


def test_one_of_each_group_stays(corpus):
    texts, docs = corpus
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    fps = simhash.fingerprints_of(texts).tolist()
    linked = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (fps[a] ^ fps[b]).bit_count() <= 2 or similarity(texts[a], texts[b]) >= 0.8]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups(linked, len(texts))))
    copies = simhash.deduplicate(docs, similarity=None)
    assert copies.count() > kept.count()


def test_nothing(corpus):
    _, docs = corpus
    assert simhash.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd, rounds", [(8, 3), (3, 1), (2, 0)])
def test_no_component_of_a_crowd_is_missed(spark, tmp_path, crowd, rounds, monkeypatch):
    """Chains of texts, each near the next alone, and several groups around one common body, all in the same crowds."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    body = [word() for _ in range(100)]
    texts = []
    for _ in range(4):  # a chain drifts at its end, a few words a step
        tail = [word() for _ in range(30)]
        for step in range(25):
            tail = tail[3:] + [word() for _ in range(3)]
            texts.append(" ".join(body + tail))
    texts += [" ".join(body + [word() for _ in range(40)]) for _ in range(40)]  # near to none
    texts += [" ".join(body[: rnd.randint(80, 100)]) for _ in range(30)]  # of many sizes
    rnd.shuffle(texts)
    spark.createDataFrame(list(enumerate(texts)), "_place long, text string").repartition(3).write.parquet(f"file://{tmp_path}/c")
    docs = spark.read.parquet(f"file://{tmp_path}/c")
    got = {(r.u, r.v) for r in near_copies.links(map_text(docs, ["_place", F.col("text")], near_copies.SKETCH, near_copies.sketch)).collect()}
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    true = {(a, b) for a in first.values() for b in first.values() if a < b and similarity(texts[a], texts[b]) >= 0.8}
    n = len(texts)
    assert got <= true
    assert groups(got, n) == groups(true, n)
