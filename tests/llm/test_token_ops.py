import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from textweir.llm import packing, token_output


def ids_of(name, text):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(docs, texts, monkeypatch):
    monkeypatch.setattr(token_output, "BLOCK_DOCS", 16)
    blocks, dictionary = token_output.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    got = [tuple(r) for r in token_output.read_tokens(blocks, dictionary).orderBy("start").collect()]
    want = Counter((i, len(x := ids_of("word_bpe_49k.json", t)), crc(x)) for i, t, _ in texts)
    assert Counter((i, n, c) for i, _, n, c, _ in got) == want
    assert [s for _, s, *_ in got] == [0, *list(accumulate(n for _, _, n, *_ in got))[:-1]]
    order = [i for i, *_ in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    b = blocks.orderBy("block").first().asDict()
    assert crc(token_output.read_document(b, 1, dictionary)) == got[1][3]


def test_token_files_of_nothing(no_docs):
    assert token_output.token_output(no_docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing(docs, texts, spark):
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *list(accumulate(n for _, n in pieces))[:-1]] and sum(n for _, n in pieces) <= 1024
    want = Counter()
    for i, t, _ in texts:
        ids = ids_of("byte_bpe_50k.json", t)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    total = sum(n for _, _, _, n, _ in want.elements())
    assert len(bins) <= -(-total // 1024) + 1


def test_lean_packing_is_the_same(docs, monkeypatch):
    monkeypatch.setattr(packing, "LEAN_ROWS", 7)
    monkeypatch.setattr(packing, "LEAN_PIECES", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, lean = (Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack(docs, path, lean=x).collect()) for x in (False, True))
    assert plain == lean


def test_minimum_bin_slack_uses_all_and_fits():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = Counter(rng.integers(1, 64, 200).tolist())
        plan = packing.minimum_bin_slack(dict(counts), 64)
        used = Counter()
        for bins, uses in plan:
            assert sum(n * k for n, k in uses) <= 64
            for n, k in uses:
                used[n] += bins * k
        assert used == counts
        room = []  # first fit decreasing
        for n in sorted(counts.elements(), reverse=True):
            k = next((k for k, r in enumerate(room) if r >= n), None)
            if k is None:
                room.append(64 - n)
            else:
                room[k] -= n
        assert sum(b for b, _ in plan) <= len(room)


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
