import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import op10_minhash as op
from plumbline.llm.components import components
from tests.llm import brute


def family(rng, n, words, edits, name):
    base = [f"{name}{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("width", [2, 5])
def test_against_plain_python(spark, monkeypatch, width):
    monkeypatch.setattr(op, "BLOCK", 8)
    rng = random.Random(width)
    texts = [*family(rng, 60, 200, 12, "a"), *family(rng, 40, 30, 4, "b"), *family(rng, 30, 8, 2, "c"), "one", "ONE", "two words", "Two Words", "é É", None, "", " \n", "y" * 60_000, "x " * 30_000, "X " * 20_000]
    texts += texts[:25]
    rng.shuffle(texts)
    data = [(3 * i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in data], "doc_id long, text string, component_id string, n_shingles int").repartition(4)
    got = {r.id: (r.n_shingles, r.component_id) for r in op.near_duplicates(df, width, 80).collect()}
    want = brute.near(data, width, 80)
    assert got == want
    left = op.deduplicated(df, width, 80)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_equal_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a b c d e f g"), (7, "h i j k l m n"), (3, "h i j k l m n"), (9, "a b c d e f g"), (None, "a b c d e f g"), (None, None)], "doc_id long, text string")
    got = sorted(((r.id, r.component_id, r.kept) for r in op.near_duplicates(df).collect()), key=str)
    assert got == [(3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False), (None, None, True), (None, None, True)]
    assert sorted((r.doc_id for r in op.deduplicated(df).collect()), key=str) == [3, None, None]
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_sketches_are_full_unbiased_and_concentrated():
    rng = np.random.default_rng(3)
    errors = []
    for n in (1, 2, 5, 50, 1000):
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            k = rng.integers(0, n + 1)
            a, b = np.unique(pool[:n]), np.unique(pool[k : n + k])
            s = op.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert (s != op._UNSET).all()
            errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


def test_bytes_that_agree_by_chance_lose_no_pair():
    """The two share band 2 and all later ones.  In band 1 only the places' low bytes agree: no bucket of band 1 holds both."""
    sketch = np.stack([np.arange(op.COORDINATES, dtype=np.uint64)] * 2)
    sketch[1, : op.ROWS] += np.uint64(1)
    sketch[1, op.ROWS] += np.uint64(256)
    full = np.arange(50, dtype=np.uint64).tobytes()

    def compare(band, keys):
        group = {"id": [1, 2], "component": [1, 2], "is_left": [True, False], "band": [band] * 2, "sketch": [x.tobytes() for x in sketch.astype(np.uint8)], "shingles": [full] * 2, "keys": [x.tobytes() for x in keys]}
        return op._compare(80)(pa.table(group)).to_pylist()

    keys = op.bands(sketch)
    assert (keys[0] == keys[1]).tolist() == [False, False] + [True] * (op.BANDS - 2)
    assert compare(2, keys) == [{"a": 1, "b": 2}]
    assert compare(3, keys) == []  # left to the bucket of band 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(5, 5), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == brute.components(linked, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.op10_minhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute.near(docs, 2, 80)


def test_exact_setting_gives_the_same(spark):
    rng = random.Random(8)
    texts = [*family(rng, 50, 60, 14, "a"), *family(rng, 50, 20, 4, "b")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.near(list(enumerate(texts)), 2, 80)
    for least in (0.0, op.LEAST_AGREEMENT):
        assert {r.id: (r.n_shingles, r.component_id) for r in op.near_duplicates(df, 2, 80, least_agreement=least).collect()} == want


def test_the_least_of_a_bucket_is_compared_once(spark, monkeypatch):
    """Two buckets whose least class links with none.  The one of two classes is done with that; in the other, the rest still meet."""
    rng = random.Random(12)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    texts = [(1, words[0]), (2, words[1]), (3, words[0]), (4, words[2]), (5, [*words[2][:-1], "end"])]
    texts[2] = (3, [*words[0][:40], *words[1][:20]])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    # One bucket holds 1 and 3, another one 2, 4 and 5, whatever the texts are.
    sig = op.signatures(df, 2).withColumn("bands", F.array(F.when(F.col("id").isin(1, 3), 7).otherwise(8).cast("long")))
    stored = {}
    monkeypatch.setattr(op, "written", lambda rows, name, store=op.written: stored.setdefault(name, store(rows, name)))
    assert [(r.a, r.b) for r in op.links(df, sig, 2, 80).collect()] == [(4, 5)]
    assert {r.id for r in stored["minhash-buckets"].collect()} == {1, 2, 3, 4, 5}
    assert sorted((r.key, r.id) for r in stored["minhash-unsettled"].collect()) == [(8, 4), (8, 5)]


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole number"):
        op.near_duplicates(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))


def test_recall_near_the_threshold():
    """Share of linked pairs that meet in a bucket and pass the sketches' test, over likenesses from 0.8."""
    rng = np.random.default_rng(11)
    met = {0.80: [], 0.85: [], 0.90: []}
    for likeness in met:
        n = 300
        union = round(n * 2 / (1 + likeness))
        for _ in range(400):
            pool = rng.choice(2**62, union, replace=False).astype(np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[union - n :])
            s = op.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
            keys, low = op.bands(s), (s & np.uint64(255)).astype(np.uint8)
            met[likeness].append(bool((keys[0] == keys[1]).any()) and op._agreement(low[0], low[1]) >= op.LEAST_AGREEMENT)
    assert all(np.mean(x) == 1 for x in met.values())
