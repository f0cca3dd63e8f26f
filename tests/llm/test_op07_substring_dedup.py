import random

import numpy as np
import pytest

from plumbline.llm import op07_substring_dedup as op
from tests.llm import brute


def rows():
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(40)]
    out = []
    for i in range(120):
        own = [f"d{i}w{k}" for k in range(rng.randrange(60))]
        if i % 3 == 0:
            at, n = rng.randrange(len(own) + 1), rng.randrange(10, 40)
            own[at:at] = shared[:n]
        out.append((i * 2, "\t\n ".join(own)))
    out += [(1, "a b c " * 30), (3, "a b c " * 30), (5, None), (7, ""), (9, " \x85 \xa0x\n"), (11, " ".join(shared[:12])), (13, " ".join(shared[:13])), (15, "long " + "word" * 50_000), (301, out[0][1])]
    return out


@pytest.mark.parametrize("chunk", [4 << 20, 2000])
def test_against_plain_python(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(op, "MOST_CHUNK_BYTES", chunk)
    data = rows()
    df = spark.createDataFrame([(*r, 1, "clash") for r in data], "doc_id long, text string, chunk int, n_words string").repartition(3)
    got = {r.id: (r.n_words, r.n_removed, __import__("hashlib").sha256(r.kept.encode()).hexdigest()) for r in op.deduplicated(df).collect()}
    assert got == brute.without_repeats(data)


def test_equal_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(4, text), (4, text), (None, text), (9, text + " end")], "doc_id long, text string")
    got = sorted(((r.id, r.n_words, r.n_removed) for r in op.deduplicated(df).collect()), key=str)
    assert got == [(4, 20, 0), (4, 20, 0), (9, 21, 20), (None, 20, 20)]
    alone = spark.createDataFrame([(None, text), (None, text)], "doc_id long, text string")
    assert [r.n_removed for r in op.deduplicated(alone).collect()] == [0, 0]


def test_empty(spark):
    assert op.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_never_loses_a_repeat():
    rng = np.random.default_rng(1)
    cells = np.sort(rng.integers(0, 1 << 20, 50_000))
    kept = op._twice(cells)
    assert (op._unpacked(op._packed(kept), len(kept)) == kept).all()
    assert set(kept) == set(cells) and np.bincount(kept).max() == 2
    assert len(op._unpacked(op._packed(cells[:0]), 0)) == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op.op7_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute.without_repeats(docs)


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole number"):
        op.deduplicated(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))


def test_no_table_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert op.deduplicated(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count() == 1
    assert {t.name for t in spark.catalog.listTables()} == before
