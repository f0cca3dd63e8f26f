"""Every query against DuckDB on the smallest tables."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    cursor = duck.execute(queries.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_extracted_labels_read_the_whole_text(spark, tmp_path):
    def within(name, text):
        letters = iter(text)
        return all(x in letters for x in name)

    def plain_label(text):
        boxed = re.search(r"\\boxed\{([^}]*)\}", text)
        said = (boxed and boxed[1] or text).strip().lower()
        names = ["positive", "negative", "neutral"]
        if named := [x for x in sorted(names, key=len, reverse=True) if said.startswith(x)]:
            return named[0], False
        # Only dropped letters are cheap (1 each, against 1000), so the longest name that is left by dropping is the nearest.
        whole = [x for x in names if within(x, said)]
        best = max(whole, key=len) if whole else None
        return best, best is None or len(said) - len(best) >= 1000

    texts = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    texts += ["The answer is, after some thought, \\boxed{Neutral}", "what is said here is on the whole negative", "xyz" * 9]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: (r.label, r.label_failed) for r in queries.extracted_labels(spark, str(tmp_path)).collect()}
    want = {i: plain_label(t) for i, t in enumerate(texts)}
    assert {i: (label if want[i][0] else None, failed) for i, (label, failed) in got.items()} == want


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
