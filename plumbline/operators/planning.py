"""What remains to be evaluated: coverage, eligibility and jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected combinations that were not observed."""
    return expected.select(*keys).distinct().join(observed.select(*keys).distinct(), keys, "left_anti")


def observed_runs(runs: DataFrame) -> DataFrame:
    """Runs that count as coverage: on the validation split, or of no split."""
    return runs.where(F.coalesce(F.col("validation_split"), F.lit(True)))


def jobs(models: DataFrame, datasets: DataFrame, done: DataFrame) -> DataFrame:
    """``model``, ``language``, ``datasets``: those of the model's languages that have no run yet.

    Models and datasets meet on their language, an equi-join; finished pairs go by an anti join.
    """
    wanted = models.select("model", F.explode("languages").alias("language")).join(datasets, "language").select("model", "language", "dataset").distinct()
    left = wanted.join(done.select("model", "dataset").distinct(), ["model", "dataset"], "left_anti")
    return left.groupBy("model", "language").agg(F.sort_array(F.collect_set("dataset")).alias("datasets"))


def not_benchmarked(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests without a compatible record: same model, dataset and shots, and the same split or none."""
    r = records.select(F.col("model").alias("_m"), F.col("dataset").alias("_d"), F.col("few_shot").alias("_f"), F.col("validation_split").alias("_v"))
    same = (F.col("model") == F.col("_m")) & (F.col("dataset") == F.col("_d")) & (F.col("_f").isNull() | (F.col("few_shot") == F.col("_f"))) & (F.col("_v").isNull() | (F.col("validation_split") == F.col("_v")))
    return requests.join(r, same, "left_anti")


def having_all(df: DataFrame, key: str, item: str, items: list[str]) -> DataFrame:
    """Keys that have every one of a few items."""
    rows = df.where(F.col(item).isin(*items)).groupBy(key).agg(F.count_distinct(item).alias("n"))
    return rows.where(F.col("n") == len(set(items))).select(key)


def common_items(df: DataFrame, key: str, item: str) -> DataFrame:
    """Items that every key has."""
    counts = df.groupBy(item).agg(F.count_distinct(key).alias("n"))
    return counts.join(F.broadcast(df.agg(F.count_distinct(key).alias("all"))), F.col("n") == F.col("all")).select(item)


def by_shots(df: DataFrame, setting: str) -> DataFrame:
    """Few-shot or zero-shot rows; ``auto`` takes the only kind there is, and fails where a model has both."""
    if setting == "auto":
        both = df.groupBy("model").agg(F.count_distinct("few_shot").alias("n")).agg(F.max("n").alias("n")).head().n
        if both and both > 1:
            raise ValueError("some models have few-shot and zero-shot scores; choose one")
        return df
    return df.where(F.col("few_shot") == F.lit(setting == "few"))


def memory_needed(df: DataFrame, by: list[str], count: str, bits: str, overhead: float = 1.35) -> DataFrame:
    """Bytes of a model's tensors in whole bytes each, with room to run."""
    return df.groupBy(*by).agg((F.sum(F.ceil(F.col(count) * F.col(bits) / 8)) * overhead).alias("bytes"))


def union_of(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """All rows of the tables, repeated ones too unless ``distinct``; columns that one lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.distinct() if distinct else out


def pending(requests: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Requests without a result under the same keys; null keys are equal."""
    done = results.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return requests.join(done, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
