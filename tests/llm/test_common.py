import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from textweir.llm.common import CachedTokenizer, HashLookup, gather, segment_sum, segments


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_library_s(name):
    rnd = random.Random(1)
    alphabet = ["a", "Bc", " ", " ", "  ", "\n", "\t", ".", ",", ". ", ", ", "'s", "'", "1", "2", "!", "é", "e\u0301", "\u0301", "\xa0", "\u3000", "目", "\x1c", "\x1d", "\x1e", "\x1f", "\u2028", "<|endoftext|>", "😀", "Σ", "²", "_", "ſ"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 16))) for _ in range(20_000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    cached = CachedTokenizer(public_tokenizers.path(name))
    cached.LIMIT = 3_000  # the cache starts anew now and then
    cached.RUN = 700
    got = [flat[a:b] for k in range(0, len(texts), 500) for _, flat, at in cached(pa.array(texts[k : k + 500])) for a, b in zip(at[:-1], at[1:])]
    assert len(got) == len(texts)
    for t, a, b in zip(texts, got, plain.encode_batch(texts, add_special_tokens=False)):
        assert a.tolist() == b.ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_long_text_is_cut_without_changing_an_id(name):
    rnd = random.Random(4)
    text = "".join(rnd.choice(["word", "Is ", " no", ". ", ", ", "\n", "  ", "7", "é", " x", "\t"]) for _ in range(20_000))
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    cached = CachedTokenizer(public_tokenizers.path(name))
    cached.RUN = 1_000
    (n, flat, at), (m, rest, _) = cached.closed(pa.array([text, ""]), 2)
    assert n == m == 1 and flat.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2] and rest.tolist() == [2]


def test_lookup_and_segments():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 60, 5_000).astype(np.uint64))
    probe = np.concatenate([keys, rng.integers(0, 1 << 60, 5_000).astype(np.uint64)])
    at = HashLookup(keys)(probe)
    want = {int(k): i for i, k in enumerate(keys)}
    assert at.tolist() == [want.get(int(p), -1) for p in probe]
    assert HashLookup(keys[:0])(probe[:3]).tolist() == [-1] * 3
    assert segment_sum(np.arange(5.0), segments(np.array([2, 0, 3]))).tolist() == [1, 0, 9]
    assert gather(np.array([4, 0]), np.array([2, 3])).tolist() == [4, 5, 0, 1, 2]
