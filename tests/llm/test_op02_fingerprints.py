import hashlib

import numpy as np
import pyarrow as pa

from plumbline.llm import op02_fingerprints as op
from tests.llm import brute


def test_estimates_likeness(spark):
    rng = np.random.default_rng(5)
    maker = op.Fingerprinter()
    errors = []
    for n in (3, 8, 40, 300, 2000):
        for share in (0.1, 0.5, 0.9):
            own = [f"w{x}" for x in rng.integers(0, 10**6, n + 4)]
            other = own[: int(share * n) + 4] + [f"v{x}" for x in rng.integers(0, 10**6, n - int(share * n))]
            a, b = " ".join(own), " ".join(other)
            codes, some = maker.codes(pa.array([a, b]))
            got = maker.likeness(codes[:1], some[:1], codes[1:], some[1:])[0]
            errors.append(got - brute.jaccard(brute.shingles(a, 5, False), brute.shingles(b, 5, False)))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.2


def test_every_bin_is_filled_and_order_does_not_matter():
    maker = op.Fingerprinter()
    rows = np.full((2, maker.bins), op._EMPTY)
    rows[0, 7] = 5
    out = maker.densified(rows)
    assert (out[0] == 5).all() and (out[1] == op._EMPTY).all()
    a = maker.packed(*maker.codes(pa.array(["a b c d e f g", None, "x y"])))
    b = maker.packed(*maker.codes(pa.array(["x y", "q" * 10_000, "a b c d e f g", ""])))
    assert a[0] == b[2] and a[2] == b[0] and a[1] == b[3] == ""
    assert len(a[0]) == op.BINS * op.BITS // 4


def test_report_over_ranges_ties_and_nulls(spark):
    texts = [f"doc {i} " + " ".join(f"w{(i * j) % 31}" for j in range(i % 40)) for i in range(200)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "no id at all"), (6, None), (6, ""), (597, "last \U0001f389 tie"), (30, "x" * 70_000)]
    df = spark.createDataFrame([(i, t, "k", 0.5) for i, t in rows], "doc_id long, text string, fingerprint string, near_next double").repartition(5)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want = sorted((i is None, i or 0, len(t or ""), hashlib.sha256(op.edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest()) for k, (i, t) in enumerate(order))
    for size in (1000, 10):
        got = op.edit_report(df, rows_per_range=size).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert op.edit_report(df.limit(0)).count() == 0
    alone = op.edit_report(df.where("doc_id = 33")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_query_on_the_small_table(spark):
    got = {r.doc_id: r for r in op.op2_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids, errors = sorted(docs), []
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        edited = op.edited(docs[i], docs[j])
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(got[i].near_edited - brute.jaccard(brute.shingles(docs[i], 5, False), brute.shingles(edited, 5, False)))
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.05


def test_wide_ids_and_many_null_ids(spark):
    """Ids beyond the doubles' exact range, and null ids in ranges of their own: every row has the next one's text."""
    base = 2**60
    rows = [(base + i, f"wide {i} " + "a b c " * (i % 7)) for i in range(150)] + [(None, f"null {i}") for i in range(150)]
    got = op.edit_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows_per_range=10).collect()
    assert len(got) == 300
    known = {r.doc_id: r.edited_sha256 for r in got if r.doc_id is not None}
    texts = dict(r for r in rows if r[0] is not None)
    for i in range(base, base + 149):
        assert known[i] == hashlib.sha256(op.edited(texts[i], texts[i + 1]).encode()).hexdigest()
    nulls = {t: hashlib.sha256(t.encode()).hexdigest() for i, t in rows if i is None}
    # A null id's successor is another null id, and the last one's is the least id.
    after = {hashlib.sha256(op.edited(t, u).encode()).hexdigest() for t in nulls for u in [*nulls, texts[base]]}
    assert all(r.edited_sha256 in after for r in got if r.doc_id is None)
    assert known[base + 149] in {hashlib.sha256(op.edited(texts[base + 149], t).encode()).hexdigest() for t in nulls}


def test_bins_that_copy_one_value_agree_independently():
    """One pair of unequal values copied into all bins: about one bin in sixteen agrees, not all or none."""
    maker = op.Fingerprinter()
    share = [(maker.low_bits(np.full((1, maker.bins), a, np.uint64)) == maker.low_bits(np.full((1, maker.bins), a + 16, np.uint64))).mean() for a in range(1, 200)]
    assert abs(np.mean(share) - 1 / 16) < 0.005 and max(share) < 0.15


def test_ids_must_be_whole_numbers(spark):
    import pytest

    with pytest.raises(TypeError, match="whole number"):
        op.edit_report(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))
