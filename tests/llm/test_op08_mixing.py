import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import op08_mixing as op
from tests.llm import brute


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = [(i, rng.choice(["en", "en", "en", "de", "fr", None]), rng.choice(["src0", "src0", "src1", "src2", "src3", "src5", "other", None]), "w " * rng.randrange(60)) for i in range(n)]
    return [*out, (None, "en", "src0", "null id here"), (5, "en", "src0", "same id twice"), (5, "en", "src0", "same id thrice"), (900, "es", "src9", None), (901, "es", "src13", "")]


@pytest.mark.parametrize(("percent", "epochs"), [(0, 1), (30, 1), (80, 1), (100, 1), (150, 2), (60, 3), (1000, 2)])
def test_against_plain_python(spark, percent, epochs):
    mixture = op.Mixture(target_percent=percent, max_epochs=epochs, sources={"src0": 7, "src5": 3})
    data = rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "doc_id long, lang string, source string, text string, bucket string, have int")
    want = brute.mix(data, mixture, op.DOMAINS)
    got = [(r.doc_id, r.n_tokens, r.copies) for r in op.selected(df, mixture).collect()]
    assert sorted(got, key=str) == sorted(((data[n][0], len(brute.words(data[n][3])), c) for n, c in want.items()), key=str)
    clash = ["_leaf", "_copies", "_copy", "_epochs", "_cut", "_leaf_lang", "row", "copies", "copy", "epochs", "cut", "domain"]
    df = df.select("*", *[F.lit(c).alias(c) for c in clash])
    mixed = op.mix(df, mixture)
    assert mixed.columns == df.columns
    mixed = mixed.collect()
    assert all([r[c] for c in clash] == clash for r in mixed)
    assert sorted(((r.doc_id, r.text) for r in mixed), key=str) == sorted(((data[n][0], data[n][3]) for n, c in want.items() for _ in range(c)), key=str)


def test_shortage_goes_to_siblings_first(spark):
    """src4 (web, en) is short: src0, its sibling, takes what it leaves; other domains keep their own shares."""
    mixture = op.Mixture(domains={"web": 1, "books": 1}, langs={"en": 1}, sources={}, target_percent=50, max_epochs=1)
    data = [("src0", 1000), ("src4", 10), ("src1", 1010)]
    df = spark.createDataFrame([(i, "en", s, "w " * n) for i, (s, n) in enumerate(data)], "doc_id long, lang string, source string, text string")
    got = {r.source: r.budget for r in op.budgets(op.token_table(df), mixture).collect()}
    assert got == {"src0": 495, "src4": 10, "src1": 505}


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert op.selected(df, op.Mixture()).count() == 0 and op.mix(df, op.Mixture()).count() == 0
    plan = op.mix(df, op.Mixture())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_budgets_of_a_huge_corpus_do_not_overflow(spark):
    """10 ** 14 tokens of leaves whose weights make products beyond 64 bits."""
    leaves = spark.createDataFrame([(i, "en", f"src{4 * i}", 10**12) for i in range(100)], "doc_id long, lang string, source string, n_tokens long").withColumn("domain", F.lit("web"))
    got = op.budgets(leaves, op.Mixture(sources={f"src{4 * i}": 10**9 + i for i in range(100)}, target_percent=50, max_epochs=1))
    shares = [r.budget for r in got.collect()]
    assert len(shares) == 100 and 0 <= 50 * 10**12 - sum(shares) <= 100 and all(0 < x <= 10**12 for x in shares)
