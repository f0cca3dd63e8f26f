"""Evaluation records: identity, deduplication, validity, metadata, and the flat score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.curation import dense_index

DETAILS = "model_info.additional_details"
#: Metadata fields that count as known when they are there.
RICHNESS_FIELDS = ["commercially_licensed", "open", "merge", "trained_from_scratch", "generative_type", "model_url"]
#: Tasks whose records are of no split and no number of shots.
FLAGLESS_TASKS = ["european-values"]
#: The oldest version that counts, versions that never do, and the records a model needs.
MIN_VERSION, BANNED_VERSIONS, MIN_RECORDS = "15.0.0", ["9.3.0", "10.0.0"], 7


def details(name: str) -> Column:
    return F.col(f"{DETAILS}.{name}")


def run_detail(name: str) -> Column:
    return F.col(f"eval_library.additional_details.{name}")


def dataset_name() -> Column:
    return F.coalesce(run_detail("dataset"), F.get(F.col("evaluation_results.source_data.dataset_name"), 0))


def few_shot() -> Column:
    return T.flag(run_detail("few_shot"))


def validation() -> Column:
    return T.flag(run_detail("validation_split"))


def richness() -> Column:
    return sum((details(f).isNotNull().cast("int") for f in RICHNESS_FIELDS), F.lit(0))


def row_key() -> Column:
    """What shows on one row of a board: plain name, dataset, split and shots; their defaults are test and few-shot."""
    return F.struct(T.strip_anchor(F.col("model_info.name")).alias("model"), dataset_name().alias("dataset"), F.coalesce(validation(), F.lit(False)).alias("validation"), F.coalesce(few_shot(), F.lit(True)).alias("few_shot"))


def storage_key() -> Column:
    """What names a stored record: id (or name), dataset, split and shots, where unknown is a value of its own."""
    model = T.strip_anchor(F.coalesce(F.col("model_info.id"), F.col("model_info.name")))
    return F.struct(model.alias("model"), dataset_name().alias("dataset"), F.coalesce(validation().cast("string"), F.lit("none")).alias("validation"), F.coalesce(few_shot().cast("string"), F.lit("none")).alias("few_shot"))


def newest_by(df: DataFrame, key: Column, preference: list[Column], order: str) -> DataFrame:
    """The row of each key that is first by preference (each larger is better), then by least ``order``.

    Only the preference, the order and the key are aggregated; the chosen rows follow by a semi join on ``order``,
    which must be unique, so records of any width are shuffled once at most.
    """
    slim = df.select(key.alias("_key"), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(preference)], (-F.col(order)).alias("o")).alias("_best"))
    best = slim.groupBy("_key").agg(F.max("_best").alias("_best")).select((-F.col("_best.o")).alias(order))
    return df.join(best, order, "left_semi")


def deduplicated_rows(df: DataFrame, order: str = "ord") -> DataFrame:
    """One record for each row of a board: newest version, then richest metadata, then first."""
    return newest_by(df, row_key(), [T.version(F.coalesce(F.col("eval_library.version"), F.lit("0.0.0"))), richness()], order)


def deduplicated_storage(df: DataFrame, order: str = "ord") -> DataFrame:
    """One record for each stored identity: newest version (none is lowest), then latest time, then first."""
    return newest_by(df, storage_key(), [F.coalesce(T.version(F.col("eval_library.version")), F.array().cast("array<int>")), T.epoch(F.col("retrieved_timestamp"))], order)


def collisions(df: DataFrame) -> DataFrame:
    """Paths that records of different identity would share; there should be none."""
    key = storage_key()
    path = T.record_path(key["model"], key["dataset"], validation(), few_shot())
    return df.select(path.alias("path"), F.to_json(key).alias("key")).groupBy("path").agg(F.count_distinct("key").alias("n")).where("n > 1")


def without_collisions(df: DataFrame) -> DataFrame:
    """The records, once no two identities among them share a path; the job fails where they do."""
    message = F.concat(F.lit("records of different identity share "), F.col("path"))
    clash = collisions(df).where(F.when(F.col("n") > 1, F.raise_error(message).cast("boolean")).otherwise(False))
    # There is no row to join with, or the job has failed; the join makes the check part of it.
    return df.join(F.broadcast(clash.select("path").limit(1)), F.lit(True), "left_anti")


def is_record() -> Column:
    """The fields that make an object a record."""
    return F.col("model_info.name").isNotNull() & F.col("eval_library.name").isNotNull() & F.col("evaluation_results").isNotNull() & F.col("schema_version").isNotNull()


def missing_metadata() -> Column:
    """Names of required flags that are not there or not booleans."""
    return F.array_compact(F.array(*[F.when(T.flag(details(f)).isNull(), F.lit(f)) for f in ("merge", "commercially_licensed", "open", "trained_from_scratch")]))


def with_metadata(df: DataFrame) -> DataFrame:
    """The records, whose required flags must be there; a record without one fails the job with their names."""
    gaps = missing_metadata()
    message = F.concat(F.lit("metadata missing for "), F.coalesce("model_info.name", F.lit("?")), F.lit(": "), F.array_join(gaps, ", "))
    return df.where(F.when(F.size(gaps) > 0, F.raise_error(message).cast("boolean")).otherwise(True))


def valid(df: DataFrame, banned_models: list[str], api_models: list[str], min_version: str = MIN_VERSION, banned_versions: list[str] | None = None, mode: str = "lexical") -> DataFrame:
    """Records of a version that counts, of a model not banned, and not few-shot for models behind an interface.

    ``lexical`` compares versions as text, as the boards have always done; ``semver`` compares their numbers.
    """
    version, model = F.col("eval_library.version"), T.strip_anchor(F.col("model_info.name"))
    new = version >= min_version if mode == "lexical" else T.version(version) >= T.version(F.lit(min_version))
    keep = version.isNotNull() & new & ~version.isin(*(banned_versions or BANNED_VERSIONS))
    for pattern in banned_models:
        keep &= ~model.rlike(pattern)
    for pattern in api_models:
        keep &= ~(model.rlike(f"^(?:{pattern})$") & F.coalesce(few_shot(), F.lit(True)))
    return df.where(keep)


def of_frequent_models(df: DataFrame, least: int = MIN_RECORDS) -> DataFrame:
    """Records of models that have ``least`` or more; counts are joined, so no model's records meet in one task."""
    model = T.strip_anchor(F.col("model_info.name"))
    counts = df.groupBy(model.alias("_model")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return df.join(counts, model == F.col("_model"), "left_semi")


def fixed(df: DataFrame, renamed_tasks: dict[str, str]) -> DataFrame:
    """Tasks under their present names; the split and shot flags of survey tasks, which have neither, become unknown."""
    task = run_detail("task")
    new = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in renamed_tasks.items() for x in kv]), task), task) if renamed_tasks else task
    library = F.col("eval_library").withField("additional_details.task", new)
    survey = new.isin(*FLAGLESS_TASKS)
    for flag in ("few_shot", "validation_split"):
        library = library.withField(f"additional_details.{flag}", F.when(~F.coalesce(survey, F.lit(False)), run_detail(flag)))
    return df.withColumn("eval_library", library)


def enriched(df: DataFrame, cache: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Missing metadata from a cache by model (``model`` and fields of the same names), else from defaults."""
    fields = [c for c in cache.columns if c != "model"]
    known = cache.select(F.col("model").alias("_model"), *[F.col(c).alias(f"_{c}") for c in fields])
    out = df.join(known, T.plain_model_id(F.col("model_info.name")) == F.col("_model"), "left")
    info = F.col("model_info")
    for f in fields:
        info = info.withField(f"additional_details.{f}", F.coalesce(details(f), F.col(f"_{f}").cast("string"), F.lit(defaults.get(f)).cast("string")))
    return out.withColumn("model_info", info).select(*df.columns)


def total_scores() -> Column:
    """Metric to total score."""
    return F.map_from_entries(F.transform(F.filter("evaluation_results", lambda x: x["evaluation_name"].isNotNull()), lambda x: F.struct(x["evaluation_name"], x["score_details"]["score"])))


def failed_instances() -> Column:
    """The first count that is a number and not negative."""
    counts = F.transform("evaluation_results", lambda x: x["score_details"]["details"]["num_failed_instances"].try_cast("int"))
    return F.get(F.filter(counts, lambda n: n >= 0), 0)


def raw_results() -> Column:
    """The iterations' scores as maps of text."""
    return F.from_json(run_detail("raw_results"), "array<map<string,string>>")


def languages() -> Column:
    text = run_detail("languages")
    return F.coalesce(F.from_json(text, "array<string>"), F.when(text.isNotNull(), F.array(text)))


def scores(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """``model``, ``dataset``, ``slot``, ``raw`` (array), ``total``, ``std_err``, ``split_agnostic``.

    ``tasks`` (small): ``task``, ``primary_metric``, ``secondary_metric``.  Negative scores are left out; scores of at
    most one are shares and become percent (the total stays); the error is that of the scores as they then are.
    """
    rows = df.select(T.variant_id(F.col("model_info.name"), few_shot(), validation()).alias("model"), dataset_name().alias("dataset"), run_detail("task").alias("task"), raw_results().alias("_raw"), total_scores().alias("_total"), validation().isNull().alias("split_agnostic"))
    rows = rows.join(tasks, "task").withColumn("_slots", F.array(F.struct(F.lit("primary").alias("slot"), F.col("primary_metric").alias("metric")), F.struct(F.lit("secondary").alias("slot"), F.col("secondary_metric").alias("metric"))))
    rows = rows.withColumn("_s", F.explode("_slots")).where("_s.metric IS NOT NULL")
    metric = F.col("_s.metric")
    raw = F.filter(F.transform("_raw", lambda m: F.coalesce(F.try_element_at(m, F.concat(F.lit("test_"), metric)), F.try_element_at(m, metric)).try_cast("double")), lambda x: x >= 0)
    rows = rows.withColumn("_r", raw).withColumn("total", F.coalesce(F.try_element_at("_total", F.concat(F.lit("test_"), metric)), F.try_element_at("_total", metric)))
    rows = rows.where("size(_r) > 0 AND total IS NOT NULL").withColumn("raw", F.transform("_r", lambda x: x * F.when(F.array_max("_r") <= 1, 100.0).otherwise(1.0)))
    n = F.size("raw")
    mean = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(F.transform("raw", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    error = F.when(n > 1, F.sqrt(squares / (n - 1)) / F.sqrt(n)).otherwise(0.0)
    return rows.select("model", "dataset", "task", F.col("_s.slot").alias("slot"), "raw", "total", error.alias("std_err"), "split_agnostic")


def mirrored(scores: DataFrame) -> DataFrame:
    """Scores of records that belong to no split, shown on the validation variant too where it lacks the dataset."""
    variants = scores.select(F.col("model").alias("val_model")).distinct().withColumn("model", T.strip_val(F.col("val_model"))).where("model IS NOT NULL")
    extra = scores.where("split_agnostic").join(variants, "model").drop("model").withColumnRenamed("val_model", "model")
    extra = extra.join(scores.select("model", "dataset").distinct(), ["model", "dataset"], "left_anti")
    return scores.unionByName(extra)


def without_val_duplicates(scores: DataFrame) -> DataFrame:
    """Without validation variants whose test variant has at least as many datasets."""
    counts = scores.groupBy("model").agg(F.count_distinct("dataset").alias("n"))
    val = counts.withColumn("other", T.strip_val(F.col("model"))).where("other IS NOT NULL")
    covered = val.join(counts.select(F.col("model").alias("other"), F.col("n").alias("n_other")), "other").where("n_other >= n").select("model")
    return scores.join(covered, "model", "left_anti")


def model_metadata(df: DataFrame, order: str = "ord") -> DataFrame:
    """The first informative value of each field of each model; False is informative, and an explicit address beats a made one."""
    model = T.plain_model_id(F.col("model_info.name"))
    numbers = ["num_model_parameters", "max_sequence_length", "vocabulary_size"]
    values = {f: T.number(details(f)) for f in numbers} | {f: T.flag(details(f)) for f in ("merge", "commercially_licensed", "open", "trained_from_scratch")} | {f: details(f) for f in ("generative_type", "model_url")}
    at = {f: F.when(v.isNotNull(), F.struct(F.lit(0).alias("made"), F.col(order).alias("at"))) for f, v in values.items()}
    # An address that was given beats one made from the model's name, wherever it comes.
    made = details("model_url") == F.concat(F.lit("https://hf.co/"), F.split(model, "[@#]")[0])
    at["model_url"] = F.when(values["model_url"].isNotNull(), F.struct(made.cast("int").alias("made"), F.col(order).alias("at")))
    return df.groupBy(model.alias("model")).agg(*[F.min_by(v, at[f]).alias(f) for f, v in values.items()])


def scored_count(scores: DataFrame, split_sizes: DataFrame) -> DataFrame:
    """Examples scored: iterations times the size of the split that was used (``dataset``, ``split``, ``n``)."""
    split = F.when(F.col("model").rlike(r"\bval\)"), "val").otherwise("test")
    return scores.withColumn("split", split).join(split_sizes, ["dataset", "split"], "left").withColumn("n_scored", F.size("raw") * F.col("n")).drop("n")


def flat_to_envelope(df: DataFrame) -> DataFrame:
    """Flat results (``model``, ``dataset``, ``task``, ``few_shot``, ``validation_split``, ``version``, ``raw`` array of
    maps, ``total`` map) as records."""
    options = {"ignoreNullFields": "true"}
    return df.select(
        F.lit("0.2.1").alias("schema_version"),
        F.concat_ws("/", "dataset", "model").alias("evaluation_id"),
        F.struct(F.col("model").alias("name"), F.col("model").alias("id")).alias("model_info"),
        F.struct(F.lit("plumbline").alias("name"), F.col("version"), F.struct("dataset", "task", F.col("few_shot").cast("string").alias("few_shot"), F.col("validation_split").cast("string").alias("validation_split"), F.to_json("raw", options).alias("raw_results")).alias("additional_details")).alias("eval_library"),
        F.transform(F.map_entries("total"), lambda e: F.struct(e["key"].alias("evaluation_name"), F.struct(F.col("dataset").alias("dataset_name")).alias("source_data"), F.struct(e["value"].alias("score")).alias("score_details"))).alias("evaluation_results"),
    )


def envelope_to_flat(df: DataFrame) -> DataFrame:
    """The other way: records as flat results, unknown flags and scores as null."""
    return df.select(
        F.coalesce("model_info.id", "model_info.name").alias("model"), dataset_name().alias("dataset"), run_detail("task").alias("task"), few_shot().alias("few_shot"), validation().alias("validation_split"),
        F.col("eval_library.version").alias("version"), F.from_json(run_detail("raw_results"), "array<map<string,double>>").alias("raw"), total_scores().alias("total"),
    )


def raw_as_list(raw: Column) -> Column:
    """Old raw results, a map of metric to its scores, as a list of maps, one for each iteration."""
    n = F.array_max(F.transform(F.map_values(raw), F.size))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform_values(raw, lambda _, v: F.get(v, i)))


def upgraded(df: DataFrame) -> DataFrame:
    """Old flat results: a note in the model's name becomes flags, a lone language a list."""
    note = F.regexp_extract("model", r"\(([^()]+)\)\s*$", 1)
    return df.withColumns({
        "validation_split": F.coalesce(T.flag(F.col("validation_split")), F.when(note.contains("val"), True)),
        "few_shot": F.coalesce(T.flag(F.col("few_shot")), F.when(note.contains("zero-shot"), False)),
        "languages": F.coalesce(F.from_json("languages", "array<string>"), F.array("languages")),
        "model": T.plain_model_id(F.col("model")),
    })


def recent(df: DataFrame, time: str, hours: int, now: Column | None = None) -> DataFrame:
    """Rows of a cache that have not run out."""
    return df.where(F.col(time) > (now if now is not None else F.current_timestamp()) - F.make_interval(hours=F.lit(hours)))


def to_run(prompts: DataFrame, cache: DataFrame, prompt: str = "prompt", order: str = "ord") -> DataFrame:
    """The first row of each prompt that the cache lacks; the others can be looked up once these have run."""
    fresh = prompts.join(cache.select(F.col("key").alias("_key")), F.md5(F.col(prompt).cast("binary")) == F.col("_key"), "left_anti")
    first = fresh.groupBy(F.md5(F.col(prompt).cast("binary")).alias("_key")).agg(F.min(order).alias(order))
    return fresh.join(first, order, "left_semi")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``ord``, a number from 0 in the order of the given columns, which name a row: range partitions are
    numbered apart and get their start from the counts of those before, so no window goes over the whole table."""
    ranged = df.withColumn("_by", F.struct(*order))
    return dense_index(ranged, "_by", "ord").drop("_by")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all columns that both have; an error if they have none in common."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the tables have no column in common")
    return left.join(right, common)


def matched(responses: DataFrame, sources: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Responses with their source, and the number of those without one, which are left out."""
    lost = responses.join(sources.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))
    return responses.join(sources, key), lost
