import random

import numpy as np
import pyarrow as pa

from plumbline.llm import kernels, op07_substring_dedup, op10_minhash
from tests.llm import brute


def complements(doublings):
    """Two words that polynomial hashes modulo a power of two cannot tell apart, whatever base and byte values they take."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_and_hashes_of_any_text(monkeypatch):
    monkeypatch.setattr(kernels, "_BLOCK", 50)
    rng = random.Random(5)
    texts = [None, "", " ", "é\x0bÉ\x1fx", "y" * 300 + " z", *("".join(rng.choice("abAB \n\té-") for _ in range(rng.randrange(400))) for _ in range(60)), *(" ".join("w" * rng.randrange(1, 140) for _ in range(20)) for _ in range(20))]
    data, offsets = kernels.text_bytes(pa.array(texts))
    for lower in (False, True):
        starts, ends, first, second = kernels.words(data, offsets, lower=lower, seconds=True)
        bounds = kernels.word_bounds(offsets, starts)
        seen = {}
        for i, text in enumerate(texts):
            own = [bytes(data[s:e]) for s, e in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
            assert own == (text or "").encode().split()
            for word, pair in zip(own, zip(first[bounds[i] : bounds[i + 1]].tolist(), second[bounds[i] : bounds[i + 1]].tolist(), strict=True), strict=True):
                word = bytes(c + 32 if lower and 65 <= c <= 90 else c for c in word)
                assert seen.setdefault(word, pair) == pair
        assert len({x for x, _ in seen.values()}) == len({x for _, x in seen.values()}) == len(seen)
        assert not {x for x, _ in seen.values()} & {x for _, x in seen.values()}


def test_repetitive_words_do_not_collide():
    for n in range(2, 14):
        pair = complements(n)
        data, offsets = kernels.text_bytes(pa.array(pair))
        _, _, first, second = kernels.words(data, offsets, seconds=True)
        assert first[0] != first[1] and second[0] != second[1]
    runs = [c * n for c in "ab0" for n in range(1, 200)]
    data, offsets = kernels.text_bytes(pa.array(runs))
    _, _, first, second = kernels.words(data, offsets, seconds=True)
    assert len(np.unique(first)) == len(np.unique(second)) == len(runs)


def test_operators_tell_repetitive_words_apart(spark):
    for n in (5, 10, 12):
        a, b = complements(n)
        data = [(1, f"{a} x"), (2, f"{b} x"), (3, " ".join([a] * 13)), (4, " ".join([b] * 13)), (5, f"{a} X")]
        df = spark.createDataFrame(data, "doc_id long, text string")
        assert {r.id: (r.n_shingles, r.component_id) for r in op10_minhash.near_duplicates(df, 2, 80).collect()} == brute.near(data, 2, 80)
        got = {r.id: (r.n_words, r.n_removed) for r in op07_substring_dedup.deduplicated(df).collect()}
        assert got == {i: x[:2] for i, x in brute.without_repeats(data).items()}
