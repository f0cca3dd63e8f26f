import hashlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm import op06_line_dedup, op08_mixing  # noqa: E402
from tests.llm import brute  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def expected(rows):
    """Ids and texts that the first four stages leave, in plain Python."""
    rows = [r for r in rows if not any(brute.rules_fail(r[1]))]
    texts = brute.without_boilerplate([(r[0], r[3], r[1]) for r in rows], op06_line_dedup.MIN_SITES, spare_copies=True)
    rows = [(r[0], t, *r[2:]) for r, t in zip(rows, texts, strict=True)]
    groups = brute.near([(r[0], r[1]) for r in rows], 5, 80)
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    copies = brute.mix([(r[0], r[2], r[3], r[1]) for r in rows], pipeline.MIXTURE, op08_mixing.DOMAINS)
    return [rows[n] for n, k in copies.items() for _ in range(k)]


def test_run_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(COLUMNS).collect()]
    got = {r.doc_id: r.decoded_sha256 for r in pipeline.run(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in expected(rows)}


def test_stages_keep_columns_and_take_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (None, "few words", "en", "src1", 9, 2), (2, " ".join(f"w{i}" for i in range(80)), "en", None, 5, 3)], "doc_id long, text string, lang string, source string, n_chars long, line int")
    for frame in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, frame, "")
            assert out.columns == frame.columns and [x.dataType for x in out.schema] == [x.dataType for x in frame.schema]
            out.collect()
        assert pipeline.STAGES[-1][1](spark, frame, "").count() == frame.count()
