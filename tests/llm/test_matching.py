import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textweir.llm import ann, chat_format, decontamination, url_filters

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(t):
    return WORD.findall((t or "").translate(LOW))


def plain_judgement(texts, items, size=10):
    windows = {}
    for i, t in items:
        ws = plain_words(t)
        n = min(size, len(ws))
        for k in range(len(ws) - n + 1 if i is not None and n else 0):
            windows.setdefault(tuple(ws[k : k + n]), set()).add(i)
    for d, t in texts:
        ws, hit, found = plain_words(t), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if own := windows.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        yield d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    by = {i: t for i, t, _ in texts}
    rnd = random.Random(2)
    long = by[406].split()
    items = [(1, by[3]), (2, " ".join(long[100:125])), (3, " ".join(long[110:140]).upper() + "!"), (10, "again"), (11, None), (12, " %% "), (4, by[9][:60]), (None, by[5]), (5, "目的 ok two x"), (2, by[11])]
    items += [(20 + k, " ".join(rnd.choice(long) for _ in range(15))) for k in range(10)]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [4_000_000, 30])
def test_decontamination(docs, texts, benchmark, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    items, table = benchmark
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.judge(docs, table).collect())
    assert got == Counter(plain_judgement([(i, t) for i, t, _ in texts], items))


def test_longest_matches_are_those_of_a_plain_search():
    rnd = random.Random(21)
    for round_ in range(60):
        letters = "ab" if round_ % 2 else "abcdef"
        line = lambda n: [rnd.choice(letters) for _ in range(n)]
        items = [(i, line(rnd.randint(0, 40))) for i in range(rnd.randint(1, 6))]
        texts = [line(rnd.randint(0, 60)) for _ in range(rnd.randint(1, 5))]
        if items[0][1]:
            texts.append(["z", *items[0][1], "z", *items[-1][1], *items[0][1][:7]])
        block = decontamination.Block([(i, [w.encode() for w in ws]) for i, ws in items], 4)
        sizes, hits = decontamination.shard_hits([" ".join(t) for t in texts], block)
        for t, (_, _, found) in zip(texts, hits):
            long = {}
            for a in range(len(t)):
                for _, ws in items:
                    for b in range(len(ws)):
                        n = 0
                        while a + n < len(t) and b + n < len(ws) and t[a + n] == ws[b + n]:
                            n += 1
                        if n >= min(4, len(ws)):
                            long[a] = max(long.get(a, 0), n)
            assert max((n for _, n, _ in found), default=0) == max(long.values(), default=0)
            for a, n, item in found:
                whole = [ws for i, ws in items if i == item]
                assert any(ws[b : b + n] == t[a : a + n] for ws in whole for b in range(len(ws)))
                assert n <= long[a]
            for a, n in long.items():  # every longest match is kept, or is the rest of one that is
                assert any(x <= a and x + m >= a + n for x, m, _ in found)


def test_decontamination_by_a_table_with_clashing_columns(spark, docs, benchmark):
    _, table = benchmark
    odd = table.withColumn("doc_id", F.lit(1)).withColumn("_row", F.lit("x")).withColumn("_text", F.lit(None).cast("string"))
    same = lambda b: sorted(map(str, decontamination.judge(docs, b).collect()))
    assert same(odd) == same(table)


def test_decontamination_filter(docs, no_docs, benchmark):
    _, table = benchmark
    kept = decontamination.decontaminate(docs, table)
    clean = decontamination.judge(docs, table).where("not contaminated").count()
    assert kept.columns == docs.columns and kept.count() == clean
    assert decontamination.decontaminate(docs, table.limit(0)).count() == docs.count()
    assert decontamination.judge(no_docs, table).count() == 0


def plain_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOW)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = sorted((-len(h + p), -len(h), h, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
    best = fits[0] if fits else None
    return host, path, best and best[2] + best[3], best[4] if best else default


URLS = ["http://a.Example.com/en/x?y", "https://www.example.com/en/", "https://example.com/EN/", "http://example.net/es/1#t", "http://net/fr/", "ftp://x.org", "nothing", None, "", "://", "http:///p", "http://com", "http://com/", "http://xcom/", "http://a..com/b", "http://é.com/ü", "http://com\x01x/", "x://y://com/z", "http://b.com?x=://z", "http://www.example.com.evil/en/", "http://net/es", "http://\U0010ffff.net/es/"]


def test_url_rules(spark):
    rules = [*url_filters.RULES, ("block", "b.a.com", "/deep"), ("allow", "b.a.com", "/deep/er"), ("block", "a.com", "/de"), ("block", "org", "/")]
    rnd = random.Random(6)
    urls = URLS + ["http://" + ".".join(rnd.choice(["a", "b", "www", "example"]) for _ in range(rnd.randint(0, 3))) + "." + rnd.choice(["com", "net", "org"]) + rnd.choice(["", "/", "/en/", "/deep/er/1", "/des", "/fr/é"]) for _ in range(300)] + ["http://hot.example.com/en/"] * 500
    pages = spark.createDataFrame([(i if i % 50 else None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = Counter(tuple(r) for r in url_filters.judge(pages, table).collect())
    assert got == Counter((i if i % 50 else None, *plain_url(u, rules)) for i, u in enumerate(urls))
    assert {r.verdict for r in url_filters.judge(pages, table.limit(0), "block").collect()} == {"block"}
    assert url_filters.judge(pages.limit(0), table).count() == 0
    plan = url_filters.judge(pages, table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


CHATS = ["plain", "", None, "### user: x</turn>\n", "\\### Assistant: </turn> ok", "\\", "\\\\", "</turn>", "a</turn", "####", "#: : #", "line\n\n### ", "é\u3000😀 \\</turn>\n", "x: y", "\\n", "<" * 5 + "</turn>\n" * 3]


def test_chats_round_trip(spark):
    for role in ["user", "assistant", "", "a: b", "###", "x</turn>", "\\"]:
        for text in CHATS:
            out, a, b = chat_format.format_turn(role, text or "")
            assert chat_format.parse(out) == [(role, text or "", a, b)]
            assert chat_format.parse(out + out)[1][:2] == (role, text or "")
    with pytest.raises(chat_format.ParseError):
        chat_format.parse("### user: a ### b</turn>\n")
    assert chat_format.format_turn("user", "plain")[0] == "### user: plain</turn>\n"


def test_tied_turns_follow_by_their_text(spark):
    rows = [(1, 0, "user", t) for t in ("Z", "###", "a", "a b", "a</turn>", "\\", "", None)]
    df = spark.createDataFrame(rows + [(1, 0, None, "###"), (1, 0, None, "Z")], "conv_id long, turn long, role string, text string")
    want = sorted((r or "", t or "") for _, _, r, t in [*rows, (1, 0, None, "###"), (1, 0, None, "Z")])
    got = chat_format.digests(chat_format.format_chats(df.repartition(3))).collect()
    assert [r.turns_sha256 for r in got] == [hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()]


def test_a_very_long_turn(spark):
    text = "### x </turn> \\ " * 50_000
    assert chat_format.parse(chat_format.format_turn("user", text)[0])[0][:2] == ("user", text)


def test_chat_digests(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["user", "assistant"] * 8, CHATS))] + [(3, None, None, None), (3, 0, "assistant", "b"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a")]
    rows += [(9, k, "user", f"t{k}") for k in range(12_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted long")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    for conv in (1, 2, None, 3, 9):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        own = [x for *_, r, x in mine if r == "assistant"]
        r = got[conv]
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in mine).encode()).hexdigest()
        assert r.loss_chars == len("".join(own)) and r.loss_sha256 == hashlib.sha256("".join(own).encode()).hexdigest()
    assert len(got) == 5 and chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 24)).astype(np.float32)
    x[2_000:] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, x[1].tolist()), (5_000, None), (5_001, []), (5_002, [0.0] * 24), (5_003, [float("nan")] * 24), (5_100, [1.0, None] * 12), (5_200, [1.0] * 3)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3_000, 100))
    hit = 0
    for q, found in got.items():
        away = np.sqrt(((x.astype(np.float64) - x[q]) ** 2).sum(1))
        away[q] = np.inf
        want = np.lexsort((np.arange(3_000), away))[:10]
        found.sort()
        assert [k for k, *_ in found] == list(range(1, 11)) and all(abs(s - away[v]) < 1e-12 for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(want.tolist()))
        if q >= 2_000:
            assert [v for _, v, _ in found] == want.tolist()  # ties go to the smaller id
    assert hit / (10 * len(got)) > 0.9
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.search(few, F.col("vec_id") == 0).count() == 2 and ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_neighbours_over_many_cells(spark, monkeypatch):
    """Vectors that lie anywhere: neighbours are spread over many cells, which have to be probed."""
    monkeypatch.setattr(ann, "CELL", 16)
    x = np.random.default_rng(9).normal(size=(3_000, 48))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()}
    want = {(q, int(v)) for q in range(0, 3_000, 20) for v in np.argsort(-(x @ x[q]), kind="stable")[1:11]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_anisotropic_codes_lose_less_along():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1_500, 16))
    coder = ann.Quantiser(x, rng)
    flat = ann.Quantiser(x, np.random.default_rng(3), 0)
    flat.eta = 1.0
    along = lambda c: np.abs(((x - np.take_along_axis(c.books[None], c._assign(c._padded(x))[:, :, None, None], 2).reshape(len(x), -1)[:, :16]) * x).sum(1)).mean()
    assert along(coder) < along(flat)


@pytest.mark.parametrize("dim", [5, 8, 16])
def test_two_codes_a_byte_add_up_to_the_inner_product(dim):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(300, dim)), rng.normal(size=(7, dim))
    coder = ann.Quantiser(x, rng)
    decoded = coder.books[np.arange(coder.width), coder._assign(coder._padded(x))].reshape(len(x), -1)[:, :dim]
    codes, tables = coder.encode(x), coder.tables(q)
    assert codes.dtype == np.uint8 and codes.shape[1] == -(-coder.width // 2)
    near = sum(tables[:, m, :][:, codes[:, m]] for m in range(codes.shape[1]))
    assert np.abs(near - q @ decoded.T).max() < 1e-4


def test_repeated_queries_and_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cell": F.lit("x"), "v": F.lit(1), "ids": F.lit(None).cast("string")})
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") % 2 == 0, 3).collect())
    assert got == sorted([(0, 1, 1), (0, 2, 2)] * 2 + [(2, 1, 1), (2, 2, 0)])
