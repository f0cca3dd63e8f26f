"""Seeded draws and bootstraps against what independent draws give."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions.hashing import draw, draw_sql, draws, draws_sql
from plumbline.operators import ranking


def test_same_numbers_in_sql(spark):
    import duckdb

    rows = spark.range(50).select("id", draw(7, F.col("id"), F.lit(3)).alias("one"), draws(F.lit(9), 7, F.col("id")).alias("many")).collect()
    sql = duckdb.sql(f"SELECT id, {draw_sql(7, 'id', '3')}, list_transform(range(0, 9), lambda k: {draws_sql('k', 7, 'id')}) FROM range(0, 50) t(id)").fetchall()
    assert sorted((r.id, r.one, list(r.many)) for r in rows) == sorted(sql)
    assert len({x for r in rows for x in r.many}) > 440 and all(0 <= x < 2**32 for r in rows for x in r.many)


def test_bootstrap_means_vary_as_they_should(spark):
    """One dataset, many models of n scores: the mean of n draws has a variance of s**2 / n, and most resamples differ."""
    for n in (4, 8, 16):
        values = np.linspace(0, 1, n).tolist()
        rows = [(f"m{m}", m, "x", k, v) for m in range(20) for k, v in enumerate(values)]
        scores = spark.createDataFrame(rows, "model string, model_no int, dataset string, position int, raw double")
        config = spark.createDataFrame([("da", "t", "x")], "language string, task string, dataset string")
        boot = ranking.bootstrap_scores(scores, config, 100).where("language = 'da'").collect()
        got = np.array([r.score for r in boot]) * np.std(values)
        assert len(got) == 2000 and abs(np.std(got) / (np.std(values) / np.sqrt(n)) - 1) < 0.08
        if n == 16:  # 31 ** 16 sums are possible; an affine step gave far fewer
            assert len({round(x, 9) for x in got}) > 100


def test_resamples_of_datasets_are_independent(spark):
    """Eight datasets of one task: nearly every replicate draws another combination, and each slot is uniform."""
    config = spark.createDataFrame([("da", "t", f"d{i}") for i in range(8)], "language string, task string, dataset string")
    rows = ranking.resampled_datasets(config, 1000, 1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.replicate, {})[r.slot] = r.dataset
    assert len({tuple(sorted(x.items())) for x in by.values()}) > 990
    for slot in range(8):
        counts = Counter(x[slot] for x in by.values())
        assert len(counts) == 8 and max(counts.values()) < 180
    pairs = Counter((x[0], x[1]) for x in by.values())
    assert len(pairs) == 64 and max(pairs.values()) < 40


def test_dataset_intervals_cover(spark):
    rows = [(f"m{m}", m, "x", k, float(k)) for m in range(30) for k in range(10)]
    scores = spark.createDataFrame(rows, "model string, model_no int, dataset string, position int, raw double")
    got = ranking.dataset_rank_intervals(scores, 100).collect()
    # All means are 4.5, so the true rank score is 1; its standard error is 1 / sqrt(10).
    width = np.mean([r.upper - r.lower for r in got])
    assert abs(width / (2 * 1.96 / np.sqrt(10)) - 1) < 0.15 and np.mean([r.lower <= 1 <= r.upper for r in got]) == 1
