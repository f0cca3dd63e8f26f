"""From stored records to a ranked board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import ranking, records
from plumbline.operators.curation import dense_index
from plumbline.session import settled


def score_table(stored: DataFrame, tasks: DataFrame, config: DataFrame, banned_models: list[str] | None = None, api_models: list[str] | None = None, least_records: int = records.MIN_RECORDS) -> DataFrame:
    """Deduplicated, valid records of models with enough of them, as scores of the datasets on the board."""
    wanted = stored.where(records.is_record()).join(config.select("dataset").distinct(), records.dataset_name() == F.col("dataset"), "left_semi")
    wanted = wanted.where(~F.coalesce(T.flag(records.run_detail("use_bits_per_character")), F.lit(False)))
    valid = records.valid(records.deduplicated_rows(wanted), banned_models or [], api_models or [])
    flat = settled(records.scores(records.of_frequent_models(settled(valid), least_records), tasks))
    return settled(records.without_val_duplicates(settled(records.mirrored(flat))))


def long_scores(scores: DataFrame) -> DataFrame:
    """A row for each raw score of the primary metric, with the numbers that the bootstrap draws by."""
    rows = scores.where("slot = 'primary'").select("model", "dataset", F.posexplode("raw").alias("position", "raw"))
    return rows.join(dense_index(rows.select("model").distinct(), "model", "model_no"), "model")


def board(scores: DataFrame, config: DataFrame, metadata: DataFrame | None = None, replicates: int = 100, seed: int = 42) -> DataFrame:
    """A row for each model that has all datasets: rank, score with margin, and a column of each language.

    Rank and interval come from the same bootstrap; the score shown is its median.
    """
    rows = long_scores(scores)
    full = ranking.eligible(rows.select("model", "dataset").distinct(), config)
    rows = rows.join(full, "model", "left_semi")
    boot = settled(ranking.bootstrap_scores(settled(rows), config, replicates, seed))
    interval = ranking.bootstrap_intervals(boot)
    ranks = ranking.significance_ranks(boot.withColumn("category", F.lit("all")), "category").select("model", "rank")
    languages = [r.language for r in config.select("language").distinct().orderBy("language").collect()]
    by_language = boot.where("language IS NOT NULL").groupBy("model").pivot("language", languages).agg(F.percentile("score", F.lit(0.5)))
    out = interval.join(ranks, "model").join(by_language, "model", "left")
    if metadata is not None:
        out = out.join(metadata, T.plain_model_id(out["model"]) == metadata["model"], "left").drop(metadata["model"])
    shown = T.score_text(F.col("median"), F.col("upper") - F.col("median"))
    return out.withColumn("score", shown).orderBy(F.col("rank").asc_nulls_last(), "median", "model")


def category_scores(scores: DataFrame, config: DataFrame) -> DataFrame:
    """``category``, ``model``, ``language`` (null: overall) and ``score`` of the models that count in each.

    ``config`` has a row for each ``category``, ``language``, ``task`` and ``dataset``.  Overall a model needs every dataset of
    the category; in a language, every dataset of that language, whatever it lacks elsewhere.
    """
    have = scores.select("model", "dataset").distinct().join(config, "dataset")
    needed = config.groupBy("category", "language").agg(F.count_distinct("dataset").alias("needed"))
    needed = needed.unionByName(config.groupBy("category").agg(F.count_distinct("dataset").alias("needed")).withColumn("language", F.lit(None).cast("string")))
    counts = have.groupBy("category", "model", "language").agg(F.count_distinct("dataset").alias("n"))
    counts = counts.unionByName(have.groupBy("category", "model").agg(F.count_distinct("dataset").alias("n")).withColumn("language", F.lit(None).cast("string")))
    same = lambda a, b: (a["category"] == b["category"]) & a["language"].eqNullSafe(b["language"])
    full = counts.join(needed, same(counts, needed) & (counts["n"] == needed["needed"])).select(counts["category"], counts["model"], counts["language"])
    ranked = ranking.rank_scores(scores)
    tasks = ranked.join(config, "dataset").groupBy("category", "model", "language", "task").agg(F.avg("rank_score").alias("score"))
    languages = tasks.groupBy("category", "model", "language").agg(F.avg("score").alias("score"))
    overall = languages.groupBy("category", "model").agg(F.avg("score").alias("score")).withColumn("language", F.lit(None).cast("string"))
    every = languages.unionByName(overall)
    return every.join(full, same(every, full) & (every["model"] == full["model"]), "left_semi").select("category", "model", "language", "score")


def curated(df: DataFrame, text: str, label: str, key: str, low: int, high: int, shares: dict[str, int], seed: int = 4242) -> DataFrame:
    """A dataset as curated for a benchmark: length and repetition filters, one row for each text, stratified splits."""
    from plumbline.operators import curation

    kept = curation.not_repetitive(curation.length_between(df, text, low, high), text)
    return curation.stratified_split(curation.drop_exact_duplicates(kept, [text], key), label, key, shares, seed)
