import random

import public_tokenizers
import pytest
import sentencepiece

from plumbline.llm import op03_token_counts as op

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_pre_tokens_add_up(model):
    rng, lengths = random.Random(1), op.Lengths({}, op.load(PATH))
    letters = [*"ab'1.é　\xa0\x85\x1c▁", *"      ", "\n", "\t", "\r", "\x0b", "🎉", "the", "ing", "<s>", "</s>", "<0x0A>"]
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(18)))
        assert lengths.count(text) == len(model.encode(text)), repr(text)


def test_cache_stays_bounded(model, monkeypatch):
    monkeypatch.setattr(op, "CACHE_SIZE", 10)
    lengths = op.Lengths({"▁a": 1}, op.load(PATH))
    for i in range(100):
        assert lengths.count(f"a w{i}") == len(model.encode(f"a w{i}"))
        assert len(lengths) <= 11
    lengths.count("x" * 1000)
    assert "▁" + "x" * 1000 not in lengths


def test_counts_with_and_without_the_table(spark, model):
    rows = [(1, "a b", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "é\n\n 🎉 <s>", 9), (4, "mot " * 30_000, 9), (5, "y" * 20_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for size in (0, 3, op.TABLE_SIZE):
        got = op.token_counts(df, PATH, 4096, size=size).collect()
        want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, _ in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert op.token_counts(df.limit(0), PATH, 4096).count() == 0


def test_query(spark, model):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in op.op3_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in docs.items()}


def test_summary_keeps_every_heavy_pre_token():
    rng, true, counts = random.Random(2), op.Counter(), op.Counter()
    for _ in range(300):
        batch = [f"t{min(int(rng.paretovariate(0.8)), 5000)}" for _ in range(100)]
        true.update(batch)
        counts.update(batch)
        if len(counts) > 40:
            counts = op.reduced(counts, 20)
    counts = op.reduced(counts, 20)
    assert len(counts) <= 20 and all(counts[t] <= n for t, n in true.items())
    assert {t for t, n in true.items() if n > 30_000 / 20} <= set(counts)


def test_table_covers_every_partition(spark):
    """A word that stands in the last rows only, and behind a long beginning, is in the table as well."""
    rows = [(i, "x y " * 5) for i in range(3000)] + [(4000 + i, "x " * 20_000 + "late " * 30) for i in range(3)]
    known = op.frequent_lengths(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, size=4)
    assert set(known) == {"▁", "▁x", "▁y", "▁late"}
