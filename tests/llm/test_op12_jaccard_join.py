import random
from pathlib import Path

import numpy as np
import pytest

from plumbline.llm import op12_jaccard_join as op
from tests.llm import brute


def family(rng, n, words, edits, name):
    base = [f"{name}{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


def collages(rng, n, passages, picks):
    """Texts of nothing but shared passages, so that no prefix has a rare token: many near misses, some links."""
    parts = [" ".join(f"p{k}x{i}" for i in range(20)) for k in range(passages)]
    for _ in range(n):
        yield " ".join(rng.sample(parts, picks))


@pytest.mark.parametrize("block", [128, 6])
def test_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "SHORT", block)
    if block == 6:  # tokens of four texts are frequent, and tokens meet in three blocks
        monkeypatch.setattr(op, "LEAST_HOT", 4)
        monkeypatch.setattr(op, "HOT", 0)
        monkeypatch.setattr(op, "MEETINGS", 3)
    rng = random.Random(block)
    texts = [*family(rng, 60, 200, 8, "a"), *family(rng, 40, 40, 3, "b"), *family(rng, 30, 9, 2, "c"), *collages(rng, 60, 12, 9), "one", "ONE", "two words", "Two Words", "é É x y z", None, "", " \n", "y" * 60_000, "x " * 30_000, "X " * 20_000]
    texts += texts[:25]
    rng.shuffle(texts)
    data = [(3 * i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in data], "doc_id long, text string, component_id string, token int").repartition(4)
    got = {r.id: (r.n_shingles, r.component_id) for r in op.linked(df).collect()}
    want = brute.near(data, 4, 85)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 60


@pytest.mark.parametrize("small", [True, False])
def test_prefixes_and_sets_are_deleted_once_links_are_stored(spark, monkeypatch, small):
    """With rows broadcast and with none, and the result can still be read again and again."""
    monkeypatch.setattr(op, "small_enough", lambda stored, rows=0: small)
    folders = {}

    def spy(rows, name, store=op.written):
        out = store(rows, name)
        folders[name] = Path(out.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
        assert folders[name].is_dir()
        return out

    monkeypatch.setattr(op, "written", spy)
    rng = random.Random(6)
    texts = [*family(rng, 40, 60, 4, "a"), *collages(rng, 30, 10, 8), "one", "ONE", None]
    data = list(enumerate(texts))
    got = op.linked(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    for _ in range(2):
        assert {r.id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.near(data, 4, 85)
    gone = {name for name, folder in folders.items() if not folder.exists()}
    assert gone == {"join-prefixes", "join-star-sets", "join-pair-sets"}


def test_equal_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d e f g"), (7, "h i j k l m n"), (3, "h i j k l m n"), (9, "a b c d e f g"), (None, "a b c d e f g"), (None, None)], "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in op.linked(df).collect()), key=str)
    assert got == [(3, 3), (7, 3), (7, 3), (9, 3), (None, None), (None, None)]
    assert op.linked(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        op.linked(df.selectExpr("cast(doc_id AS string) AS doc_id", "text"))


def test_any_prefixes_of_a_link_share_enough():
    """The rule that the join rests on, with every choice of matches on both sides."""
    rng = random.Random(4)
    links = 0
    for _ in range(3000):
        n = rng.randrange(1, 40)
        pool = rng.sample(range(200), n + 8)
        a, b = set(pool[:n]), set(pool[: n - rng.randrange(0, 4)]) | set(rng.sample(pool[n:], rng.randrange(0, 4)))
        if not b or 100 * len(a & b) < 85 * len(a | b):
            continue
        links += 1
        heads = []
        for x in (a, b):
            shared = op.least_shared(len(x), 85)
            heads.append([(k, set(sorted(x)[: len(x) - shared + k])) for k in range(1, min(8, shared) + 1)])
        assert all(len(p & q) >= min(k, l) for k, p in heads[0] for l, q in heads[1])
    assert links > 300


def test_prefixes_lengthen_with_cost():
    rare, common = np.zeros(100, np.uint8), np.full(100, 80, np.uint8)
    assert op.prefix(rare, 85) == (15 + 7, 7)
    assert op.prefix(common, 85)[1] > 7
    mixed = np.sort(np.concatenate([np.zeros(14, np.uint8), common[:86]]))
    length, matches = op.prefix(mixed, 85)
    assert length == 15 + matches and 7 <= matches <= 20
    assert op.prefix(np.array([40], np.uint8), 85) == (1, 1)
    for n in range(1, 300):
        length, matches = op.prefix(np.arange(n).astype(np.uint8), 85)
        assert 1 + n // op.LENGTHEN <= matches <= op.least_shared(n, 85) and length == n - op.least_shared(n, 85) + matches


def test_counts_are_exact_codes_where_cells_are_many(spark):
    df = spark.createDataFrame([(i, "a b c d" if i < 64 else f"a b c {i}") for i in range(100)], "doc_id long, text string").repartition(5)
    codes = op.frequencies(op.named(df, 4, "doc_id", "text"))
    assert sorted(codes[codes > 0]) == [48] and (codes == 0).sum() == len(codes) - 1


def test_prefixes_meet_whole(spark, monkeypatch):
    """Rows of (id, token, k) from packed blocks and from frequent tokens equal plain counts, ids of one text twice included."""
    rng = random.Random(8)
    rows = [(rng.choice([-5, i, i + 10**12]), [rng.randrange(-(2**62), 2**62) if rng.random() < 0.7 else k for k in range(rng.randrange(6))], [9, 8][: rng.randrange(3)]) for i in range(300)]
    got = sorted(tuple(r) for r in op.held(spark.createDataFrame(rows, "id long, tokens array<long>, hot array<long>").repartition(3), 5).collect())
    counts = {}
    for i, tokens, hot in rows:
        for t in [*tokens, *hot]:
            counts.setdefault((t in (8, 9), t), []).append(i)
    assert got == sorted((i, t, len(ids)) for (_, t), ids in counts.items() if len(ids) > 1 for i in ids)
    codes = np.zeros(1 << op.CELL_BITS, np.uint8)
    assert op.hot_code(codes) == 80 and op.hot_code(codes + np.uint8(80)) == 104
