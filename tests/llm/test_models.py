import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textweir.llm import language_id, lm_scoring, quality


def test_language_id(docs, texts):
    got = language_id.identify(docs).collect()
    assert len(got) == len(texts)
    pred = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 for r in got)
    assert {i for i, r in pred.items() if r.lang_pred == "und"} == {400, 401, 402, 403}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120]
    lang = {i: g for i, _, g in texts}
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95


def plain_grams(text):
    """Buckets of all n-grams of one text, one by one."""
    c = [ord(x) if x.isalpha() else 32 for x in (y.lower()[0] for y in f" {text} ")]
    out = []
    for n in language_id.ORDERS:
        for i in range(len(c) - n + 1):
            if any(x != 32 for x in c[i : i + n]):
                h = n
                for x in c[i : i + n]:
                    h = (h * 0x100000001B3 + x) % (1 << 64)
                out.append((h * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48)
    return out


@pytest.mark.parametrize(("shard", "piece"), [(64, 200_000), (1, 200_000), (2, 7)])
def test_language_id_is_plain_bayes(spark, docs, texts, shard, piece, monkeypatch):
    """Predictions and scores of every row, whatever the pieces and however many languages a matrix holds."""
    import zlib

    monkeypatch.setattr(language_id, "SHARD_LANGS", shard)
    monkeypatch.setattr(language_id, "PIECE", piece)
    rows = [(i, t, g) for i, t, g in texts if len(t or "") < 1_000 or piece > 7] + [(700 + i, "ab cab dab " * 3, "xx") for i in range(9)] + [(800, "İstanbul ΣΑΣ", "de")]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 3 == 1
    counts, n = {}, Counter()
    for i, t, g in rows:
        if g and t is not None and not held(i):
            counts.setdefault(g, Counter()).update(plain_grams(t))
            n[g] += 1
    want = Counter()
    for i, t, _ in rows:
        total = {g: math.log(n[g] + 1) for g in counts}
        grams = Counter(plain_grams(t or ""))
        for g, c in counts.items():
            size = sum(c.values()) + language_id.ALPHA * language_id.BUCKETS
            total[g] += sum(k * math.log((c[b] + language_id.ALPHA) / size) for b, k in grams.items())
        best = min(total, key=lambda g: (-total[g], g))
        fine = any(x.isalpha() for x in t or "")
        want[i, held(i), best if fine else "und", round(1 / sum(math.exp(v - total[best]) for v in total.values()), 5) if fine else 0.0] += 1
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert Counter((r.doc_id, r.held_out and r.doc_id is not None or held(r.doc_id), r.lang_pred, round(r.score, 5)) for r in got.collect()) == want


def test_language_filter_drops_false_claims(spark):
    rows = [(i, "the rain falls on the old stone road near the town", "en") for i in range(30)] + [(100 + i, "der regen fällt auf die alte straße in der stadt", "de") for i in range(30)]
    rows += [(200, "der regen fällt auf die straße", "en"), (201, "the rain falls", None), (301, "the rain falls", "tlh"), (203, "12 34", "en")]  # tlh is held out, so not learned
    kept = {r.doc_id for r in language_id.filter_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {i for i, *_ in rows} - {200, 203}


def test_language_filter_keeps_columns(docs, no_docs):
    kept = language_id.filter_language(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (400, 401, 402, 403)").count() == 0
    assert language_id.identify(no_docs).count() == 0 and language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_kneser_ney_sums_to_one():
    texts = ["abracadabra abra", "banana bandana", "the cat the hat"] * 3 + ["zebra"]
    codes, n = np.unique(quality.byte_grams(texts, 3)[0], return_counts=True)
    model = quality.KneserNey(codes, n, 3)
    for context in (b"ab", b"an", b"zz", b"th", b"\n\n"):
        grams = np.array([(context[0] << 16) | (context[1] << 8) | b for b in range(256)], np.uint64)
        assert abs(np.exp(model.score(grams)).sum() - 1) < 1e-3


def labels(spark, texts):
    return spark.createDataFrame([(i, 1, 0) for i, *_ in texts if i is not None and i < 100] + [(403, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, texts, no_docs):
    junk = docs.where("doc_id = 3").withColumns({"doc_id": F.lit(900).cast("long"), "text": F.lit("@@#! $$$ " * 60)})
    all_ = docs.unionByName(junk)
    lab = labels(spark, texts)
    ids = [r.doc_id for r in quality.trusted(lab).collect()]
    assert 7 not in ids and len(ids) == 99 and [r.doc_id for r in quality.bad(lab).collect()] == [403]
    got = {r.doc_id: r for r in quality.classify(all_, lab, ["doc_id", "lang"]).collect()}
    assert len(got) and not got[900]._accepted and not got[400]._accepted and not got[401]._accepted
    clean = [r for i, r in got.items() if i is not None and i < 120]
    assert sum(r._accepted for r in clean) / len(clean) > 0.9
    assert all(r._perplexity >= 1 for r in got.values())
    kept = quality.filter_quality(all_, lab)
    assert kept.columns == docs.columns and kept.where("doc_id = 900").count() == 0
    assert quality.filter_quality(no_docs, lab).count() == 0
    assert quality.filter_quality(docs, lab.limit(0)).where("text is not null and text <> ''").count() == docs.where("text is not null and text <> ''").count()


class PlainKneserNey:
    """Interpolated modified Kneser-Ney by its formula, on dictionaries and strings of bytes."""

    def __init__(self, texts, order):
        self.order, self.c = order, {order: Counter()}
        for t in texts:
            t = b"\n" * (order - 1) + t
            self.c[order].update(t[i : i + order] for i in range(len(t) - order + 1))
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d = {}
        for k, c in self.c.items():
            n = [sum(v == i for v in c.values()) for i in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
            self.d[k] = [0.0] + [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) if n[i - 1] else 0.5 for i in (1, 2, 3)]

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / 256
        after = {g: v for g, v in self.c[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return self.p(gram[1:])
        d, total = self.d[k], sum(after.values())
        own = after.get(gram, 0)
        return (own - d[min(own, 3)]) / total + sum(d[min(v, 3)] for v in after.values()) / total * self.p(gram[1:])

    def nats(self, t):
        t = b"\n" * (self.order - 1) + t
        return [-math.log(self.p(t[i - self.order + 1 : i + 1])) for i in range(self.order - 1, len(t))]


def test_scores_are_those_of_plain_kneser_ney():
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["ab", "abc", "cab", "é", "bb"]) for _ in range(12)).encode() for _ in range(10)]
    worse = [t + b" zz zap" for t in texts[:4]]
    models = []
    for ts in (texts, worse):
        models.append((PlainKneserNey(ts, 3), quality.KneserNey(*np.unique(quality.byte_grams([t.decode() for t in ts], 3)[0], return_counts=True), 3)))
    probe = [b"ab abc", b"", b"zap q", b"x", "é cab\nbb zz".encode()]
    nats, worst = quality.measure([b"\n\n" + t for t in probe], models[0][1], models[1][1], 3)
    for t, a, b in zip(probe, nats, worst):
        own, other = models[0][0].nats(t), models[1][0].nats(t)
        assert abs(a - sum(own)) < 1e-3
        words, at = [], 0
        for i, c in enumerate(t):
            if c in b" \n" and i:
                words.append((at, i))
                at = i
        words.append((at, len(t)))
        assert abs(b - max(sum(own[x:y]) - sum(other[x:y]) for x, y in words)) < 1e-3


def test_long_texts_are_scored_in_slices():
    rnd = random.Random(8)
    text = " ".join(rnd.choice(["ab", "abc", "cab", "bb", "zz"]) for _ in range(3_000)).encode()
    own, other = (quality.KneserNey(*np.unique(quality.byte_grams([t])[0], return_counts=True)) for t in ("ab abc cab bb " * 9, "ab zz bb " * 9))
    whole = quality.measure([b"\n" * 4 + text], own, other)
    parts = list(quality.slices(text, 500, 4))
    assert b"".join(p[4:] for p in parts) == text and len(parts) > 10
    got = [quality.measure([p], own, other) for p in parts]
    assert abs(sum(n[0] for n, _ in got) - whole[0][0]) < 1e-6 and abs(max(w[0] for _, w in got) - whole[1][0]) < 1e-9


def test_thresholds_are_plain_quantiles_and_few_insults_reject(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_DOCS", 150)
    rnd = random.Random(14)
    prose = lambda n: " ".join(rnd.choice("the quick brown fox jumps over lazy dogs while rain falls on old stone roads".split()) for _ in range(n))
    rows = [(i, prose(rnd.randint(30, 60)), "en", 1, 0) for i in range(900)]
    rows += [(1000 + i, prose(100) + " zounds thou knave " + prose(100), "en", 1, 1) for i in range(80)]
    rows += [(2000 + i, prose(150) + " what a knave " + prose(150), "en", None, None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int")
    lab = df.where("quality is not null").select("doc_id", "quality", "toxic", F.lit("x").alias("lang"), F.lit("y").alias("text"))
    got = {r.doc_id: r for r in quality.classify(df, lab, ["doc_id", "lang"]).collect()}
    assert not any(got[i]._accepted for i in got if i >= 2000)
    assert sum(got[i]._accepted for i in range(900)) > 885
    ids = quality.training_ids(df.where("quality = 1 and toxic = 0").withColumn("chars", F.length("text")))
    held = [got[i] for i in range(900) if i not in set(ids)]
    median = np.quantile([round(math.log(r._perplexity), 4) for r in held], 0.5)
    shrunk = [round((math.log(r._perplexity) * r._bytes + quality.PRIOR * median) / (r._bytes + quality.PRIOR), 4) for r in held]
    assert abs(math.log(got[0]._threshold) - np.quantile(shrunk, quality.QUANTILE) - math.log(quality.MARGIN)) < 3e-4
    assert abs(got[0]._worst_threshold - np.quantile([round(r._worst, 2) for r in held], quality.QUANTILE) - quality.WORD_MARGIN) < 0.02


def test_quality_calibrates_rare_languages(spark, monkeypatch):
    """A language of a tenth of the trusted documents has enough of them, however few the model may be fitted on."""
    monkeypatch.setattr(quality, "FIT_DOCS", 100)
    rnd = random.Random(4)
    words = {"en": "the quick brown fox jumps over a lazy dog while rain falls".split(), "de": "der schnelle braune fuchs springt über den faulen hund während".split()}
    rows = [(i, " ".join(rnd.choice(words[g]) for _ in range(rnd.randint(20, 40))), g) for i, g in enumerate(["en"] * 1_080 + ["de"] * 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    got = quality.classify(docs, lab, ["doc_id", "lang"]).collect()
    limits = {g: {r["_threshold"] for r in got if r.lang == g} for g in ("de", "en")}
    assert len(limits["de"]) == len(limits["en"]) == 1 and limits["de"] != limits["en"]
    for g in ("de", "en"):
        assert sum(r["_accepted"] for r in got if r.lang == g) >= 0.97 * sum(r.lang == g for r in got)


@pytest.mark.parametrize("plan", ["broadcast", "blocks", "no bad", "one fold"])
def test_quality_learns_from_all_labelled_text(spark, monkeypatch, plan):
    """Every labelled row trains, of any length and number, whether the n-grams are broadcast or joined; trusted rows are scored by the other fold."""
    limits = {"FIT_DOCS": 3, "BLOCK_BYTES": 300, "MAX_IDS": 8, "MAX_PARTS": 8 if plan == "broadcast" else 0}
    for name, value in (limits | ({} if plan == "broadcast" else {"MAX_BROADCAST": 0})).items():
        monkeypatch.setattr(quality, name, value)
    rnd = random.Random(23)
    prose = lambda n: " ".join(rnd.choice(["ab", "abc", "cab", "é", "bb"]) for _ in range(n))
    rows = [(i, prose(6), "en", 1, 0) for i in range(12)] + [(12, "bab " * 6_000, "en", 1, 0)] + [(13, f"cc {w} ab", "de", 1, 0) for w in ("xa", "xb", "xb")]
    if plan == "one fold":
        rows = [(i, "ab cab abc", "en", 1, 0) for i in range(5)]
    rows += [(20 + i, prose(3) + " zz", None, 0, 0) for i in range(6)] if plan != "no bad" else []
    rows += [(40, "cc xb bab zz", "en", None, None), (41, "", "en", 1, 0), (None, None, "de", None, None), (None, "é zz", "de", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, toxic int").repartition(3)
    fold = {r.text: r.f for r in df.select("text", F.expr("pmod(xxhash64(text), 2)").alias("f")).collect()}
    lab = df.where("quality is not null").select("doc_id", "quality", "toxic").distinct()
    good = [(t, fold[t]) for _, t, _, q, _ in rows if q == 1 and t]
    of = lambda f: [t.encode() for t, g in good if g != f] or [t.encode() for t, _ in good]
    own = {f: PlainKneserNey(of(f), quality.ORDER) for f in (None, 0, 1)}
    poor = [t.encode() for _, t, _, q, _ in rows if q == 0]
    other = PlainKneserNey(poor, quality.ORDER) if poor else None
    want = Counter()
    for i, t, _, q, _ in rows:
        if len(t or "") > 1_000:
            continue
        raw, model = (t or "").encode(), own[fold[t] if q == 1 and t else None]
        a = model.nats(raw)
        b = other.nats(raw) if other else a
        starts = [k for k in range(len(raw)) if not k or raw[k] in b" \n"]
        worst = max((sum(a[x:y]) - sum(b[x:y]) for x, y in zip(starts, [*starts[1:], len(raw)])), default=0.0)
        want[i, len(raw), round(sum(a) / max(len(raw), 1), 3), round(worst, 2)] += 1
    rows_of = [r for r in quality.classify(df, lab, ["doc_id", "lang"]).collect() if r._bytes <= 1_000]
    got = sorted((r.doc_id or -1, r._bytes, math.log(r._perplexity), r._worst) for r in rows_of)
    flat = sorted((i or -1, *rest) for (i, *rest), n in want.items() for _ in range(n))
    assert len(got) == len(flat)
    for g, w in zip(got, flat):
        assert g[:2] == tuple(w[:2]) and abs(g[2] - w[2]) < 2e-3 and abs(g[3] - w[3]) < 2e-2
    assert len(set(fold[t] for t, _ in good)) == (1 if plan == "one fold" else 2)


@pytest.mark.parametrize(("depth", "shared"), [(2, 1), (2, 2), (3, 2)])
def test_context_tree_matches_recursion(depth, shared):
    """The weighed tables against context-tree weighting by plain recursion."""
    data = [b"abab cab\n", b"abba\n", b"bab\n"]
    train = data[:2]
    codes = np.unique(lm_scoring.grams(data, depth)[0])
    seen = Counter(lm_scoring.grams(train, depth)[0].tolist())
    inner = np.empty((len(codes), 8), np.float32)
    roots = []
    near = (codes >> np.uint64(8)) & np.uint64(256**shared - 1)
    for f in np.unique(near):
        mine = near == f
        inner[mine], root = lm_scoring.weigh(codes[mine], np.array([seen[int(c)] for c in codes[mine]], float), depth, shared)
        roots.append(root.assign(context=root["context"] & (256 ** (shared - 1) - 1)))
    got = lm_scoring.log10_bytes(codes, inner, lm_scoring.upper(pd.concat(roots), shared))

    def counts(node, suffix):
        n = [0, 0]
        for c, k in seen.items():
            context, byte = c >> 8, c & 255
            path = [(1 << level) | (byte >> (8 - level)) for level in range(8)]
            if node in path and all(context >> 8 * d & 255 == s for d, s in enumerate(suffix)):
                n[byte >> (7 - path.index(node)) & 1] += k
        return n

    def kt(n0, n1):
        return math.exp(math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1))

    def weighted(node, suffix):
        own = kt(*counts(node, suffix))
        if len(suffix) == depth:
            return own
        return (own + math.prod(weighted(node, [*suffix, b]) for b in {c >> 8 >> 8 * len(suffix) & 255 for c in seen})) / 2

    def p_one(node, context, suffix):
        n0, n1 = counts(node, suffix)
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if len(suffix) == depth or not sum(counts(node, [*suffix, context >> 8 * len(suffix) & 255])):
            return own
        w = kt(n0, n1) / 2 / weighted(node, suffix)
        return w * own + (1 - w) * p_one(node, context, [*suffix, context >> 8 * len(suffix) & 255])

    for c, lp in zip(codes.tolist(), got):
        want = 0.0
        for level in range(8):
            p = p_one((1 << level) | ((c & 255) >> (8 - level)), c >> 8, [])
            want += math.log10(p if c >> (7 - level) & 1 else 1 - p)
        assert abs(lp - want) < 1e-4


def plain_tree_scores(train, texts, depth):
    """log10 probabilities by context-tree weighting over all depths, on dictionaries."""
    seen = Counter()
    children = {}
    for t in train:
        t = b"\n" * depth + t
        for i in range(depth, len(t)):
            for level in range(8):
                node, bit = (1 << level) | (t[i] >> (8 - level)), t[i] >> (7 - level) & 1
                for d in range(depth + 1):
                    context = t[i - d : i][::-1]
                    seen[node, context, bit] += 1
                    if d:
                        children.setdefault((node, context[:-1]), set()).add(context)

    def log_kt(node, context):
        a, b = seen[node, context, 0], seen[node, context, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def log_weighted(node, context):
        own = log_kt(node, context)
        if len(context) == depth:
            return own
        below = sum(log_weighted(node, c) for c in children.get((node, context), ()))
        return float(np.logaddexp(own, below)) - math.log(2)

    def p_one(node, past, d=0):
        context = past[:d]
        a, b = seen[node, context, 0], seen[node, context, 1]
        own = (b + 0.5) / (a + b + 1)
        if d == depth or not seen[node, past[: d + 1], 0] + seen[node, past[: d + 1], 1]:
            return own
        w = math.exp(log_kt(node, context) - math.log(2) - log_weighted(node, context))
        return w * own + (1 - w) * p_one(node, past, d + 1)

    out = []
    for t in texts:
        t, total = b"\n" * depth + t, 0.0
        for i in range(depth, len(t)):
            for level in range(8):
                p = p_one((1 << level) | (t[i] >> (8 - level)), t[i - depth : i][::-1])
                total += math.log10(p if t[i] >> (7 - level) & 1 else 1 - p)
        out.append(total)
    return out


def test_document_scores_are_those_of_plain_trees(spark):
    import zlib

    texts = ["Ab ab  cab", "abba cab ab", "", None, "bab\tzz é", "cab cab cab ab", "q", "ab", "abba", "zz top"]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    flat = [b" ".join(lm_scoring.tokens(t)) + b"\n" for t in texts]
    train = [t for i, t in enumerate(flat) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 0 < len(train) < len(flat)
    for i, want in enumerate(plain_tree_scores(train, flat, lm_scoring.DEPTH)):
        assert abs(got[i] - want) < 1e-4 * max(1, abs(want)), i


def test_scores(docs, texts, no_docs):
    import zlib

    got = lm_scoring.score(docs)
    rows = got.collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter()
    for i, t, _ in texts:
        if not held(i):
            c.update([*lm_scoring.tokens(t), b"\n"])
    n, unit = sum(c.values()), sum(c.values()) + len(c) + 1
    want = Counter()
    for i, t, _ in texts:
        ws = [*lm_scoring.tokens(t), b"\n"]
        want[i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / unit) for w in ws), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    joined = lm_scoring.score(docs, broadcast_limit=0)
    assert Counter((r.doc_id, round(r.score, 3)) for r in rows) == Counter((r.doc_id, round(r.score, 3)) for r in joined.collect())
    assert lm_scoring.score(no_docs).count() == 0
