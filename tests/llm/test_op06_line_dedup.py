import pytest

from plumbline.llm import op06_line_dedup as op
from tests.llm import brute

FOOTER, SHARED = "Terms of use \t", "A line on three sites."


def rows():
    out = []
    for i in range(60):
        body = f"{FOOTER}\nText number {i} has a body of its own, with {i} words more.\n" + (f"{SHARED}\nmore body {i}, so that the line is not most of it" if i % 12 < 3 else "")
        out.append((i, f"site{i % 12}", body))
    out += [(100 + i, f"site{i}", FOOTER) for i in range(12)]  # copies of nothing but the footer
    out += [(200, None, f"{FOOTER}\nno site, and words enough to be kept"), (None, "site1", f" {FOOTER}\nno id, and words enough to be kept"), (201, "site1", None), (202, "site2", ""), (203, "site3", "\n \n\t"), (0, "site1", f"{FOOTER}\n{FOOTER}\nan id used twice, with words enough to be kept whole")]
    return out


CLASH = ["bad", "id", "line", "site", "row", "cut", "kept", "own_id", "_bad", "_id", "_cut", "_kept", "_n_lines", "_n_removed"]


@pytest.mark.parametrize("spare", [False, True])
@pytest.mark.parametrize("min_sites", [3, 4, 12, 13])
def test_against_plain_python(spark, min_sites, spare):
    data = rows()
    df = spark.createDataFrame([(*r, len(r[2] or ""), *CLASH) for r in data], "doc_id long, source string, text string, n_chars int, " + ", ".join(f"{c} string" for c in CLASH))
    want = sorted(((i, k) for (i, *_), k in zip(data, brute.without_boilerplate(data, min_sites, spare), strict=True)), key=str)
    got = op.without_boilerplate(df, "source", min_sites=min_sites, spare_copies=spare, length_col="n_chars")
    assert got.columns == df.columns and [x.dataType for x in got.schema] == [x.dataType for x in df.schema]
    got = got.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    assert all([r[c] for c in CLASH] == CLASH and r.n_chars == len(r.text or "") for r in got)
    report = op.line_report(df, "source", min_sites=min_sites, spare_copies=spare).collect()
    assert sorted(((r.doc_id, r.kept) for r in report), key=str) == want
    assert sorted((str(r.doc_id), r.n_lines - r.n_removed) for r in report if r.kept) == sorted((str(i), len(k.split("\n")) if k is not None else 0) for i, k in want if k)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_with_and_without_broadcasts(spark, monkeypatch, limit):
    data = rows()
    monkeypatch.setattr(op, "small_enough", lambda df: df.count() <= limit)
    df = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = op.line_report(df, "source", min_sites=3).collect()
    assert sorted(((r.doc_id, r.kept) for r in got), key=str) == sorted(((i, k) for (i, *_), k in zip(data, brute.without_boilerplate(data, 3), strict=True)), key=str)


def test_long_boilerplate_goes_where_a_document_has_lines_of_its_own(spark):
    """The licence is more than half of each text's words; in the pipeline a copy of nothing but the licence stays whole."""
    pipeline = pytest.importorskip("corpus_pipeline")
    licence = " ".join(f"clause{i}" for i in range(60))
    data = [(i, f"{licence}\n\nOwn line {i}" if i else f"{licence}\n", "en", f"site{i}", 9) for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {0: (f"{licence}\n", 9)} | {i: (f"\nOwn line {i}", len(f"\nOwn line {i}")) for i in range(1, 12)}
    assert {r.doc_id: r.kept for r in op.line_report(docs, "source").collect()} == {0: ""} | {i: f"\nOwn line {i}" for i in range(1, 12)}


def test_near_threshold_counts_are_exact(spark):
    """Lines on 9, 10 and 11 of many sites fall on the right side of 10."""
    data = [(k * 1000 + i, f"s{(i * 7 + k) % 97}", f"line of {9 + k % 3} sites, number {k}\nand its own body {k} {i} to keep the share low enough here") for k in range(60) for i in range(9 + k % 3)]
    got = op.boilerplate_lines(spark.createDataFrame(data, "doc_id long, source string, text string"), "source", min_sites=10)
    assert got.count() == 40


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert op.line_report(df, "source").count() == 0 and op.without_boilerplate(df, "source").count() == 0


def test_a_text_of_many_flagged_lines_and_null_ids(spark):
    lines = [f"line number {i}" for i in range(100_000)]
    rows = [(i, f"s{i}", "\n".join(lines)) for i in range(10)] + [(None, "s1", f"own {i}\nline number {i}") for i in range(300)] + [(77, "x", None), (None, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = op.line_report(df, "source").collect()
    assert sorted(r.n_removed for r in got) == [0, 0] + [1] * 300 + [100_000] * 10
    assert sorted(r.kept for r in got if r.n_removed == 1) == sorted(f"own {i}" for i in range(300))
    spared = op.without_boilerplate(df, "source", spare_copies=True).collect()
    assert sum((r.text or "").count("\n") == 99_999 for r in spared) == 10 and sum(r.text == f"own {i}" for i in range(300) for r in spared) == 300
