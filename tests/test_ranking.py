import random

import numpy as np
import pytest

from plumbline import queries
from plumbline.operators import ranking


def frames(spark, scores, config):
    rows = [(m, i, d, k, float(x)) for i, (m, by) in enumerate(scores.items()) for d, values in by.items() for k, x in enumerate(values)]
    return spark.createDataFrame(rows, "model string, model_no int, dataset string, position int, raw double"), spark.createDataFrame([(lang, t, d) for lang, tasks in config.items() for t, ds in tasks.items() for d in ds], "language string, task string, dataset string")


def plain_board(scores, config):
    stats = {}
    for d in {d for by in scores.values() for d in by}:
        values = [by[d] for by in scores.values() if d in by]
        flat = [x for v in values for x in v]
        sd = np.std(flat) if len(flat) > 1 else 1.0
        stats[d] = max(map(np.mean, values)), sd if sd > 0 else 1.0
    out = {}
    for m, by in scores.items():
        languages = {}
        for lang, tasks in config.items():
            means = [np.mean(r) for ds in tasks.values() if (r := [1 + (stats[d][0] - np.mean(by[d])) / stats[d][1] for d in ds if d in by])]
            if means:
                languages[lang] = np.mean(means)
        out |= {(m, k): v for k, v in languages.items()} | {(m, None): np.mean(list(languages.values()))}
    return out


SCORES = {"a": {"x": [80, 82], "y": [50, 55], "z": [1, 2, 3]}, "b": {"x": [70, 75], "y": [60, 61]}, "c": {"x": [70, 71], "z": [2, 2, 2]}}
CONFIG = {"da": {"t1": ["x", "y"], "t2": ["z"]}, "sv": {"t1": ["x"]}}


def test_board_against_plain_python(spark):
    got = {(r.model, r.language): r.score for r in ranking.rank_board(*frames(spark, SCORES, CONFIG)).collect()}
    want = plain_board(SCORES, CONFIG)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_occurrences_count_as_often_as_they_come(spark):
    ranked = spark.createDataFrame([("m", "a", 1.0), ("m", "a", 3.0), ("m", "b", 5.0)], "model string, dataset string, rank_score double")
    config = spark.createDataFrame([("da", "t", "a"), ("da", "t", "b")], "language string, task string, dataset string")
    assert {r.score for r in ranking.hierarchy(ranked, config).collect()} == {3.0}


def test_zero_variance_is_skipped_or_one(spark):
    scores, config = frames(spark, {"a": {"x": [1, 1]}, "b": {"x": [1, 1]}}, {"da": {"t": ["x"]}})
    assert ranking.rank_scores(scores, "skip").count() == 0
    assert {r.rank_score for r in ranking.rank_scores(scores).collect()} == {1.0}


def test_nan_is_null_and_one_value_has_no_margin(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", 2.0), ("c", None)], "g string, v double")
    got = {r.g: (r["mean"], r.margin, r.n) for r in ranking.mean_interval(df, ["g"], "v").collect()}
    assert got["a"] == (2.0, pytest.approx(1.96 * np.std([1, 3], ddof=1) / np.sqrt(2)), 2) and got["b"] == (2.0, None, 1) and got["c"] == (None, None, 0)


def test_bootstrap_repeats_and_order_does_not_matter(spark):
    rng = random.Random(1)
    scores, config = frames(spark, {m: {d: [rng.random() * 100 for _ in range(5)] for d in "wxyz"} for m in "abc"}, {"da": {"t1": ["w", "x"], "t2": ["y", "z"]}})
    key = lambda df: sorted((r.replicate, r.model, str(r.language), round(r.score, 9)) for r in df.collect())
    first = key(ranking.bootstrap_scores(scores, config, 20, 7))
    assert first == key(ranking.bootstrap_scores(scores.orderBy("raw").repartition(3), config.orderBy("dataset"), 20, 7))
    assert first != key(ranking.bootstrap_scores(scores, config, 20, 8)) and len(first) == 20 * 3 * 2


def test_resampling_draws_within_tasks(spark):
    config = spark.createDataFrame([("da", f"t{i % 3}", f"d{i}") for i in range(12)], "language string, task string, dataset string")
    rows = ranking.resampled_datasets(config, 200, 3).collect()
    assert len(rows) == 200 * 12 and all(int(r.dataset[1:]) % 3 == int(r.task[1:]) for r in rows)
    counts = np.bincount([int(r.dataset[1:]) for r in rows])
    assert counts.min() > 120 and counts.max() < 280


def test_ranks_compare_with_the_first_of_the_group(spark):
    """b is not worse than a, c is not worse than b but than a: c starts a new rank."""
    rows = [("x", m, None, i, base + wobble[i]) for m, base, wobble in (("a", 1.0, [0] * 4), ("b", 1.1, [-0.2, 0.2, 0, 0]), ("c", 1.2, [0, 0.01, 0.02, 0]), ("d", 9.0, [0] * 4)) for i in range(4)]
    boot = spark.createDataFrame(rows, "category string, model string, language string, replicate int, score double")
    got = {r.model: r["rank"] for r in ranking.significance_ranks(boot, "category").collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 3}


def plain_ranks(boot):
    """{(category, model): rank} of rows (category, model, replicate, score), by the sequential fold."""
    out = {}
    for category in {r[0] for r in boot}:
        by = {}
        for c, m, k, x in boot:
            if c == category:
                by.setdefault(m, {})[k] = x
        anchor, rank = None, 0
        for m in sorted(by, key=lambda m: (np.median(list(by[m].values())), m)):
            both = [by[m][k] - by[anchor][k] for k in by[m] if k in by[anchor]] if anchor else []
            if anchor is None or (both and np.quantile(both, 0.025) > 0):
                anchor, rank = m, rank + 1
            out[category, m] = rank
    return out


def test_ranks_of_many_models_without_one_task_for_a_category(spark):
    """Also missing replicates, a model with none in common with the rest, equal medians and two categories."""
    rng = random.Random(5)
    rows = [(c, f"m{m}", k, 1 + m // 3 * 0.04 + rng.gauss(0, 0.1)) for c in "xy" for m in range(80) for k in range(30) if m % 7 or rng.random() < 0.8]
    rows += [("x", "apart", k, 2.0) for k in range(100, 110)] + [("y", n, k, 1.5) for n in ("same1", "same0") for k in range(30)]
    boot = spark.createDataFrame([(c, m, None, k, x) for c, m, k, x in rows], "category string, model string, language string, replicate int, score double")
    got = ranking.significance_ranks(boot.repartition(3), "category")
    assert {(r.category, r.model): r["rank"] for r in got.collect()} == (want := plain_ranks(rows)) and max(want.values()) > 3
    assert "InPandas" not in got._jdf.queryExecution().toString()


def test_significance_rank_takes_a_hundred_replicates(spark, monkeypatch):
    boots, whole = [], ranking.bootstrap_scores
    monkeypatch.setattr(ranking, "bootstrap_scores", lambda *a: boots.append(whole(*a)) or boots[-1])
    got = {("all", r.model): r["rank"] for r in queries.significance_rank(spark, "/root/testdata/sf0.001").collect()}
    rows = [("all", r.model, r.replicate, r.score) for r in boots[0].where("language IS NULL").collect()]
    assert {r[2] for r in rows} == set(range(100)) and got == plain_ranks(rows)


def test_ranks_of_no_models(spark):
    boot = spark.createDataFrame([], "category string, model string, language string, replicate int, score double")
    assert ranking.significance_ranks(boot, "category").count() == 0


def test_analytic_ranks(spark):
    ranked = spark.createDataFrame([("m", "x", 1.0, 0.5, 1.5), ("m", "y", 2.0, 1.0, 3.0)], "model string, dataset string, rank_score double, lower double, upper double")
    config = spark.createDataFrame([("da", "t", "x"), ("da", "t", "y")], "language string, task string, dataset string")
    got = {r.language: (r.score, r.margin) for r in ranking.analytic_ranks(ranked, config).collect()}
    assert got == {"da": (1.5, pytest.approx(np.sqrt(0.25 + 1) / 2, abs=1e-6)), None: (1.5, pytest.approx(np.sqrt(0.25 + 1) / 2, abs=1e-6))}


def test_eligible_and_ordinal(spark):
    results = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("a", "x"), ("b", "q")], "model string, dataset string")
    assert [r.model for r in ranking.eligible(results, spark.createDataFrame([("x",), ("y",)], "dataset string")).collect()] == ["a"]
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 1.0)], "m string, s double").withColumnRenamed("m", "model")
    assert [r.model for r in ranking.ordinal(df, [], "s", "model").orderBy("position").collect()] == ["c", "b", "a"]
