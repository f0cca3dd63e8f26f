"""Rank scores, their hierarchy, bootstrap intervals and significance-grouped ranks.

Scores come as one row for each (model, dataset, raw score), and datasets belong to tasks of
languages through a small ``config`` table (language, task, dataset).  A rank score is one plus
the distance to the dataset's best mean in pooled standard deviations; lower is better.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import draw, draws
from plumbline.session import settled

Z = 1.96
#: Rows of a table of occurrences that may be broadcast: some ten megabytes.
BROADCAST_ROWS = 200_000


def clean(value: Column | str) -> Column:
    """NaN and infinities as null, once, at the boundary."""
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def model_means(scores: DataFrame) -> DataFrame:
    return scores.select("model", "dataset", clean("raw").alias("raw")).groupBy("model", "dataset").agg(F.avg("raw").alias("mean"), F.count("raw").alias("n")).where("mean IS NOT NULL")


def dataset_stats(scores: DataFrame) -> DataFrame:
    """Best mean and pooled population standard deviation (1 for a single value) of each dataset.

    The raw scores are reduced to count, sum and squares before the shuffle; one row for each dataset is left.
    """
    best = model_means(scores).groupBy("dataset").agg(F.max("mean").alias("best"))
    spread = scores.groupBy("dataset").agg(F.stddev_pop(clean("raw")).alias("sd"), F.count(clean("raw")).alias("n"))
    return best.join(spread, "dataset").select("dataset", "best", F.when(F.col("n") > 1, F.col("sd")).otherwise(1.0).alias("sd"))


def rank_scores(scores: DataFrame, zero_variance: str = "one") -> DataFrame:
    """``model``, ``dataset``, ``rank_score``.  A dataset whose scores are all equal is skipped, or has a deviation of one."""
    stats = dataset_stats(scores)
    stats = stats.where("sd > 0") if zero_variance == "skip" else stats.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    return model_means(scores).join(stats, "dataset").select("model", "dataset", (1 + (F.col("best") - F.col("mean")) / F.col("sd")).alias("rank_score"))


def hierarchy(ranked: DataFrame, config: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of means: occurrences of datasets within tasks, tasks within languages, languages.

    ``ranked`` may hold a dataset more than once (a bootstrap sample); occurrences count as often as
    they come.  Returns ``model``, ``language`` (null: overall) and ``score``, and ``by``.
    """
    own = [*(by or []), "model"]
    tasks = ranked.join(config, "dataset").groupBy(*own, "language", "task").agg(F.avg("rank_score").alias("score"))
    languages = tasks.groupBy(*own, "language").agg(F.avg("score").alias("score"))
    overall = languages.groupBy(*own).agg(F.avg("score").alias("score")).withColumn("language", F.lit(None).cast("string"))
    return languages.unionByName(overall)


def rank_board(scores: DataFrame, config: DataFrame, zero_variance: str = "one") -> DataFrame:
    return hierarchy(rank_scores(scores, zero_variance), config)


def score_matrix(scores: DataFrame, config: DataFrame, languages: list[str]) -> DataFrame:
    """A row for each model, a column for each of the given languages."""
    board = rank_board(scores, config).where("language IS NOT NULL")
    return board.groupBy("model").pivot("language", languages).agg(F.first("score"))


def axis_max(scores: DataFrame) -> DataFrame:
    """Upper end of a chart's axis: the largest score up to the next half, at least 2.5."""
    return scores.agg(F.greatest(F.ceil(F.max("score") * 2) / 2, F.lit(2.5)).alias("axis_max"))


def mean_interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and 1.96 standard errors (sample deviation; null for one value) of each group."""
    v = clean(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), (Z * F.stddev_samp(v) / F.sqrt(F.count(v))).alias("margin"), F.count(v).alias("n"))


def percentile_interval(df: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Median and the two-sided percentile interval, with linear interpolation."""
    return df.groupBy(*by).agg(F.percentile(clean(value), F.array(F.lit(alpha / 2), F.lit(0.5), F.lit(1 - alpha / 2))).alias("p")).select(*by, F.col("p")[0].alias("lower"), F.col("p")[1].alias("median"), F.col("p")[2].alias("upper"))


#: Bits of a value's ordered form that one round of ``selected_interval`` settles.
RADIX_BITS = 16
#: Wanted places (a few a group) that are broadcast to the values; more are joined.
BROADCAST_PLACES = 500_000


def _ordered(v: Column) -> Column:
    """A whole number that orders as the double does: its bits, those below the sign turned round if it is negative."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def _double(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(2**63 - 1))).otherwise(key)
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def selected_interval(df: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """``percentile_interval`` for groups of any size: exact selection that never holds a group's values.

    Values become whole numbers of the same order.  Each of four rounds counts the values by 16 more leading bits, adds
    the counts up to find in which bucket each wanted place falls, and goes on with the values of those buckets alone.
    A round's counts are combined in the tasks: at most 65,536 rows a group and task are shuffled.
    """
    shares = [alpha / 2, 0.5, 1 - alpha / 2]
    names = [f"_by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], clean(value).cast("double").alias("_v"))
    sizes = settled(rows.groupBy(*names).agg(F.count("_v").alias("_n")))
    position = lambda q: F.lit(q) * (F.col("_n") - 1)
    places = F.array_distinct(F.array(*[f(position(q)).cast("long") for q in shares for f in (F.floor, F.ceil)]))
    wanted = sizes.where("_n > 0").select(*names, F.explode(places).alias("place")).withColumns({"rest": F.col("place"), "prefix": F.lit(0).cast("long")})
    values = rows.where("_v IS NOT NULL").select(*names, _ordered(F.col("_v")).alias("key"))

    def same(a: str, b: str, more: Column) -> Column:
        out = more
        for n in names:
            out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
        return out

    def few(places: DataFrame) -> DataFrame:
        return F.broadcast(places) if places.count() <= BROADCAST_PLACES else places

    for low in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        prefix = F.shiftright("key", low)
        if low < 64 - RADIX_BITS:
            open_ = wanted.select(*names, "prefix").distinct()
            values = values.alias("v").join(few(open_).alias("w"), same("v", "w", F.shiftright("v.key", low + RADIX_BITS) == F.col("w.prefix")), "left_semi")
        above = [F.lit(0).cast("long") if low == 64 - RADIX_BITS else F.shiftright("key", low + RADIX_BITS)]
        counts = values.groupBy(*names, above[0].alias("above"), prefix.alias("bucket")).agg(F.count(F.lit(1)).alias("k"))
        upto = F.sum("k").over(Window.partitionBy(*names, "above").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        counts = settled(counts.withColumn("upto", upto))
        inside = (F.col("w.prefix") == F.col("c.above")) & (F.col("w.rest") < F.col("c.upto")) & (F.col("w.rest") >= F.col("c.upto") - F.col("c.k"))
        found = counts.alias("c").join(few(wanted).alias("w"), same("c", "w", inside))
        wanted = settled(found.select(*[F.col(f"w.{n}").alias(n) for n in names], "w.place", (F.col("w.rest") - (F.col("c.upto") - F.col("c.k"))).alias("rest"), F.col("c.bucket").alias("prefix")))
    picked = wanted.select(*[F.col(n).alias(f"p{n}") for n in names], "place", _double(F.col("prefix")).alias("picked"))
    by_place = picked.groupBy(*[f"p{n}" for n in names]).agg(F.map_from_entries(F.collect_list(F.struct("place", "picked"))).alias("at"))
    match = F.lit(True)
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"p{n}"))
    joined = sizes.join(by_place, match, "left")

    def quantile(q: float) -> Column:
        lower, upper = F.floor(position(q)).cast("long"), F.ceil(position(q)).cast("long")
        a, b = F.try_element_at("at", lower), F.try_element_at("at", upper)
        return F.when((lower == upper) | (a == b), a).otherwise((upper - position(q)) * a + (position(q) - lower) * b)

    return joined.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], *[quantile(q).alias(n) for q, n in zip(shares, ("lower", "median", "upper"), strict=True)])


def combined_margin(df: DataFrame, by: list[str], lower: str, upper: str) -> DataFrame:
    """Margin of the mean of independent estimates, from their intervals."""
    variance = F.pow((F.col(upper) - F.col(lower)) / (2 * Z), F.lit(2.0))
    return df.groupBy(*by).agg((Z * F.sqrt(F.sum(variance) / F.pow(F.count(variance), F.lit(2.0)))).alias("margin"))


def analytic_ranks(ranked: DataFrame, config: DataFrame, digits: int = 6) -> DataFrame:
    """``model``, ``language`` (null: overall), ``score``, ``margin``: intervals carried up the hierarchy.

    ``ranked`` has ``model``, ``dataset``, ``rank_score``, ``lower``, ``upper``.  Values are rounded at every level.
    """
    def up(df: DataFrame, by: list[str]) -> DataFrame:
        variance = F.pow(F.col("margin") / Z, F.lit(2.0))
        return df.groupBy(*by).agg(F.bround(F.avg("score"), digits).alias("score"), F.bround(Z * F.sqrt(F.sum(variance)) / F.count(variance), digits).alias("margin"))

    leaves = ranked.join(config, "dataset").select("model", "language", "task", F.col("rank_score").alias("score"), ((F.col("upper") - F.col("lower")) / 2).alias("margin"))
    languages = up(up(leaves, ["model", "language", "task"]), ["model", "language"])
    return languages.unionByName(up(languages, ["model"]).withColumn("language", F.lit(None).cast("string")))


def resampled_datasets(config: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``replicate``, ``task``, ``slot``, ``dataset``: as many datasets as the task has, drawn with replacement.

    The tasks are numbered by name and their datasets by name; both tables are small.
    """
    pairs = config.select("task", "dataset").distinct()
    placed = pairs.withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy("dataset")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("task")))
    numbers = pairs.select("task").distinct().withColumn("task_no", F.row_number().over(Window.orderBy("task")))
    slots = placed.join(numbers, "task").select("task", "task_no", "n", F.col("place").alias("slot")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = slots.withColumn("place", (draw(seed, F.col("replicate"), F.col("task_no"), F.col("slot")) % F.col("n")).cast("int"))
    return drawn.select("replicate", "task", "task_no", "slot", "place").join(placed.select("task", "place", "dataset"), ["task", "place"]).select("replicate", "task", "task_no", "slot", "dataset")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _raw_lists(scores: DataFrame) -> DataFrame:
    """A row for each model and dataset with its raw scores in their order, a short list.

    The lists are few bytes and become many rows of draws, so they are dealt to as many tasks as a shuffle has, which
    adaptive planning would join again by their size.
    """
    raw = scores.select("model", "model_no", "dataset", "position", clean("raw").alias("raw")).where("raw IS NOT NULL")
    return raw.repartition(_tasks(scores), "model", "dataset").groupBy("model", "model_no", "dataset").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "raw"))), lambda x: x["raw"]).alias("raws"))


def _resampled_mean(seed: int, *keys: Column) -> Column:
    """Mean of as many draws with replacement from ``raws`` as it has."""
    n = F.size("raws")
    return F.aggregate(draws(n, seed, *keys), F.lit(0.0), lambda a, x: a + F.get(F.col("raws"), (x % n).cast("int"))) / n


def bootstrap_scores(scores: DataFrame, config: DataFrame, replicates: int = 100, seed: int = 42) -> DataFrame:
    """``replicate``, ``model``, ``language`` (null: overall), ``score``.

    Datasets are drawn within tasks, the same for all models of a replicate; for every occurrence of a dataset a
    model's raw scores are drawn with replacement.  A model's raw scores on a dataset are a short list, so the draws
    of an occurrence are made within its row: rows grow with occurrences and not with draws.
    ``scores`` needs ``model_no`` (a whole number) and ``position`` (the order of a model's raw scores).
    """
    # Settled, so that the datasets' statistics are not computed again with the join.
    occurrences = settled(resampled_datasets(config, replicates, seed).join(dataset_stats(scores).where("sd > 0"), "dataset"))
    if occurrences.count() <= BROADCAST_ROWS:
        # Replicates times slots, whatever the number of models: the lists stay where they are, in as many tasks.
        occurrences = F.broadcast(occurrences)
    mean = _resampled_mean(seed + 1, F.col("replicate"), F.col("task_no"), F.col("slot"), F.col("model_no"))
    ranked = _raw_lists(scores).join(occurrences, "dataset").select("replicate", "model", "dataset", (1 + (F.col("best") - mean) / F.col("sd")).alias("rank_score"))
    return hierarchy(ranked, config, ["replicate"])


def bootstrap_intervals(boot: DataFrame, alpha: float = 0.05) -> DataFrame:
    return percentile_interval(boot.where("language IS NULL"), ["model"], "score", alpha)


def dataset_rank_intervals(scores: DataFrame, replicates: int = 100, seed: int = 42, alpha: float = 0.05, digits: int = 6) -> DataFrame:
    """``model``, ``dataset``, ``lower``, ``median``, ``upper`` of the rank score with the dataset's best mean and deviation fixed."""
    stats = dataset_stats(scores).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    rows = _raw_lists(scores).join(stats, "dataset").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    mean = _resampled_mean(seed, F.col("replicate"), F.col("model_no"))
    out = percentile_interval(rows.select("model", "dataset", (1 + (F.col("best") - mean) / F.col("sd")).alias("score")), ["model", "dataset"], "score", alpha)
    return out.select("model", "dataset", *[F.bround(c, digits).alias(c) for c in ("lower", "median", "upper")])


def significance_ranks(boot: DataFrame, category: str, alpha: float = 0.05) -> DataFrame:
    """``category``, ``model``, ``rank``: models in order of their median; a new rank starts at the first that is
    significantly worse than the first model of the current rank.

    Each model's replicates are one row's array, of bounded length.  A round takes each category's anchor (the first
    model of the current rank; one row a category, broadcast), tests every later model within its row and finds the
    next anchor by one aggregation, so there are as many rounds as ranks and no task holds a category.
    ``boot`` is computed once, at the call.
    """
    rows = boot.where("language IS NULL").select(F.col(category).cast("string").alias("category"), "model", F.col("replicate").cast("long").alias("replicate"), clean("score").alias("score"))
    rows = rows.where("model IS NOT NULL AND replicate IS NOT NULL AND score IS NOT NULL").repartition(_tasks(boot), "category", "model").groupBy("category", "model", "replicate").agg(F.avg("score").alias("score"))
    lists = rows.groupBy("category", "model").agg(F.sort_array(F.collect_list(F.struct("replicate", "score"))).alias("of"))
    scores = F.col("of.score")
    models = settled(lists.select("category", F.struct(_quantile(scores, 0.5).alias("median"), "model").alias("at"), F.col("of.replicate").alias("replicates"), scores.alias("scores")))
    spark, schema = boot.sparkSession, models.schema
    anchors, found = models.groupBy("category").agg(F.min_by(F.struct("at", "replicates", "scores"), "at").alias("first")).select("category", "first.*").collect(), []
    while anchors:
        found += [(r["category"], r["at"]) for r in anchors]
        now = spark.createDataFrame(anchors, schema).select(F.col("category").alias("_category"), F.col("at").alias("_at"), F.col("replicates").alias("_replicates"), F.col("scores").alias("_scores"))
        later = models.join(F.broadcast(now), F.col("category").eqNullSafe(F.col("_category"))).where("at > _at")
        of_anchor = F.map_from_arrays("_replicates", "_scores")
        matched = F.filter(F.zip_with("replicates", "scores", lambda r, x: x - F.try_element_at(of_anchor, r)), lambda x: x.isNotNull())
        differences = F.when(F.col("replicates") == F.col("_replicates"), F.zip_with("scores", "_scores", lambda x, y: x - y)).otherwise(matched)
        worse = later.withColumn("_differences", differences).where(_quantile(F.col("_differences"), alpha / 2) > 0)
        anchors = worse.groupBy("category").agg(F.min_by(F.struct("at", "replicates", "scores"), "at").alias("first")).select("category", "first.*").collect()
    starts = spark.createDataFrame(found, models.select("category", "at").schema).groupBy(F.col("category").alias("_category")).agg(F.collect_list("at").alias("_starts"))
    ranked = models.join(F.broadcast(starts), F.col("category").eqNullSafe(F.col("_category")))
    return ranked.select(F.col("category").alias(category), F.col("at.model").alias("model"), F.size(F.filter("_starts", lambda x: x <= F.col("at"))).alias("rank"))


def _quantile(values: Column, q: float) -> Column:
    """Quantile of an array of numbers with linear interpolation; null if it is empty."""
    ordered, place = F.sort_array(values), (F.size(values) - 1) * F.lit(q)
    low, high = (F.get(ordered, end(place).cast("int")) for end in (F.floor, F.ceil))
    return F.when(F.size(values) > 0, low + (high - low) * (place - F.floor(place)))


def eligible(results: DataFrame, required: DataFrame) -> DataFrame:
    """``model`` of those that have every required dataset (relational division)."""
    needed = required.select("dataset").distinct()
    have = results.join(needed, "dataset", "left_semi").groupBy("model").agg(F.count_distinct("dataset").alias("n"))
    return have.join(F.broadcast(needed.agg(F.count(F.lit(1)).alias("needed"))), F.col("n") == F.col("needed")).select("model")


def ordinal(df: DataFrame, by: list[str], score: str, key: str) -> DataFrame:
    """``df`` with ``position``: 1 for the least score, nulls last; ties by ``key``."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).asc_nulls_last(), key)))
