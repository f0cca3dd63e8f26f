"""Evaluation records on the driver's tables: an event is a record of the model ``user_id`` on the dataset ``event_type``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.catalog import query, r6, table
from plumbline.functions import text as T
from plumbline.operators import planning, ranking, records, serving
from plumbline.plans import leaderboard
from plumbline.queries import event_config, event_scores
from plumbline.session import settled
from plumbline.sources import files

#: A flat record of each event, by expressions that both engines read the same way.
_FIELDS = {
    "plain": "concat('org/m', CAST(user_id % 40 AS {text}))",
    "version": "CASE WHEN event_id % 17 = 0 THEN '9.3.0' WHEN event_id % 19 = 0 THEN NULL ELSE concat('15.', CAST(event_id % 4 AS {text}), '.', CAST(event_id % 11 AS {text})) END",
    "few": "CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN 'none' END",
    "val": "CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'none' END",
    "licensed": "CASE WHEN event_id % 3 = 0 THEN 'true' WHEN event_id % 3 = 1 THEN 'false' END",
    "open": "CASE WHEN event_id % 7 < 5 THEN 'True' END",
    "merge": "CASE WHEN event_id % 6 <> 0 THEN 'false' END",
    "scratch": "CASE WHEN event_id % 8 <> 0 THEN 'false' END",
    "url": "CASE WHEN event_id % 5 = 0 THEN concat('https://hf.co/org/m', CAST(user_id % 40 AS {text})) WHEN event_id % 5 = 1 THEN concat('https://x.org/', CAST(event_id % 13 AS {text})) END",
    "parameters": "CASE WHEN event_id % 9 = 0 THEN '-1' WHEN event_id % 9 = 1 THEN 'many' ELSE CAST(1000 * (user_id % 40 + 1) AS {text}) END",
    "failed": "CASE event_id % 6 WHEN 0 THEN '-2' WHEN 1 THEN 'x' ELSE CAST(event_id % 10 AS {text}) END",
    "score": "round(value, 3)",
}


def _sql(dialect: str) -> str:
    return ", ".join(f"{e.replace('{text}', dialect)} AS {k}" for k, e in _FIELDS.items())


_FLAT = f"flat AS (SELECT event_id AS ord, ts, event_type AS dataset, event_id, {_sql('VARCHAR')} FROM events)"
_FLAG = "CASE lower({0}) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END"
_PARTS = "list_transform(string_split({0}, '.'), lambda x: x::INT)"
_KEYED = f"""{_FLAT}, keyed AS (SELECT *, {_FLAG.format('few')} AS few_flag, {_FLAG.format('val')} AS val_flag,
    (licensed IS NOT NULL)::INT + (open IS NOT NULL)::INT + (merge IS NOT NULL)::INT + (scratch IS NOT NULL)::INT + (url IS NOT NULL)::INT AS richness FROM flat)"""


def stored_records(spark, d) -> DataFrame:
    """The envelopes of those records, with ``ord``."""
    flat = table(spark, d, "events").selectExpr("*", *[f"{e.replace('{text}', 'string')} AS {k}" for k, e in _FIELDS.items()])
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('<a href="https://x">'), "plain", F.lit("</a>"))).otherwise(F.col("plain"))
    raw = F.to_json(F.array(*[F.create_map(F.lit("test_mcc"), (F.col("score") / 100 + i).cast("string"), F.lit("macro_f1"), (F.col("score") / 50 + i).cast("string")) for i in range(2)]))
    result = lambda metric, score, failed: F.struct(F.lit(metric).alias("evaluation_name"), F.struct(F.col("event_type").alias("dataset_name")).alias("source_data"), F.struct(score.alias("score"), F.struct(failed.alias("num_failed_instances")).alias("details")).alias("score_details"))
    null = F.lit(None).cast("string")
    return flat.select(
        F.col("event_id").alias("ord"),
        F.lit("0.2.1").alias("schema_version"),
        F.concat("event_type", F.lit("/"), F.col("event_id").cast("string")).alias("evaluation_id"),
        F.when(F.col("event_id") % 3 == 0, F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("retrieved_timestamp"),
        F.struct(name.alias("name"), name.alias("id"), F.struct(F.col("parameters").alias("num_model_parameters"), null.alias("max_sequence_length"), null.alias("vocabulary_size"), "merge", null.alias("generative_type"), F.col("licensed").alias("commercially_licensed"), "open", F.col("scratch").alias("trained_from_scratch"), F.col("url").alias("model_url")).alias("additional_details")).alias("model_info"),
        F.struct(F.lit("any").alias("name"), "version", F.struct(F.when(F.col("event_id") % 10 > 0, F.col("event_type")).alias("dataset"), F.when(F.length("event_type") % 2 == 0, "task0").otherwise("task1").alias("task"), F.when(F.col("event_id") % 2 == 0, '["da", "en"]').otherwise("da").alias("languages"), F.col("few").alias("few_shot"), F.col("val").alias("validation_split"), F.when(F.col("event_id") % 23 == 0, "true").alias("use_bits_per_character"), raw.alias("raw_results")).alias("additional_details")).alias("eval_library"),
        F.array(result("test_mcc", F.col("score"), F.col("failed")), result("test_macro_f1", F.col("score") / 2, F.lit("5"))).alias("evaluation_results"),
    )


@query(f"""WITH {_KEYED} SELECT ord, plain || CASE WHEN few_flag = FALSE AND val_flag THEN ' (zero-shot, val)' WHEN few_flag = FALSE THEN ' (zero-shot)' WHEN val_flag THEN ' (val)' ELSE '' END AS variant,
    replace(plain, '/', '__') || '/' || dataset || '__' || CASE WHEN val_flag IS NULL THEN 'none' WHEN val_flag THEN 'val' ELSE 'test' END || '__' || CASE WHEN few_flag IS NULL THEN 'none' WHEN few_flag THEN 'fewshot' ELSE 'zeroshot' END || '.json' AS path,
    CASE WHEN ord % 3 = 2 THEN 0 ELSE floor(epoch(ts)) END::BIGINT AS retrieved, CASE WHEN try_cast(parameters AS DOUBLE) >= 0 THEN parameters::DOUBLE END AS parameters, CASE WHEN try_cast(failed AS INT) >= 0 THEN failed::INT ELSE 5 END AS n_failed,
    round(score, 6) AS mcc, round(score / 2, 6) AS macro_f1, richness, CASE WHEN ord % 2 = 0 THEN 'da,en' ELSE 'da' END AS languages,
    array_to_string(list_filter([CASE WHEN merge IS NULL THEN 'merge' END, CASE WHEN licensed IS NULL THEN 'commercially_licensed' END, CASE WHEN open IS NULL THEN 'open' END, CASE WHEN scratch IS NULL THEN 'trained_from_scratch' END], lambda x: x IS NOT NULL), ',') AS gaps, TRUE AS whole FROM keyed""")
def record_fields(spark, d):
    """Identity, path, time, sizes, scores, failures, languages and gaps of every record."""
    rows = stored_records(spark, d)
    few, val, name = records.few_shot(), records.validation(), F.col("model_info.name")
    return rows.select(
        "ord", T.variant_id(name, few, val).alias("variant"), T.record_path(T.plain_model_id(name), records.dataset_name(), val, few).alias("path"), T.epoch(F.col("retrieved_timestamp")).cast("long").alias("retrieved"),
        T.number(records.details("num_model_parameters")).alias("parameters"), records.failed_instances().alias("n_failed"), r6(F.element_at(records.total_scores(), "test_mcc")).alias("mcc"), r6(F.element_at(records.total_scores(), "test_macro_f1")).alias("macro_f1"),
        records.richness().alias("richness"), F.array_join(records.languages(), ",").alias("languages"), F.array_join(records.missing_metadata(), ",").alias("gaps"), records.is_record().alias("whole"),
    )


@query(f"""WITH {_KEYED} SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY plain, dataset, coalesce(val_flag, FALSE), coalesce(few_flag, TRUE)
    ORDER BY {_PARTS.format("coalesce(version, '0.0.0')")} DESC, richness DESC, ord) AS rn FROM keyed) WHERE rn = 1""")
def records_newest_richest(spark, d):
    return records.deduplicated_rows(stored_records(spark, d)).select("ord")


@query(f"""WITH {_KEYED} SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY plain, dataset, coalesce(val_flag::VARCHAR, 'none'), coalesce(few_flag::VARCHAR, 'none')
    ORDER BY version IS NOT NULL DESC, {_PARTS.format('version')} DESC, CASE WHEN ord % 3 = 2 THEN 0 ELSE floor(epoch(ts)) END DESC, ord) AS rn FROM keyed) WHERE rn = 1""")
def records_by_identity(spark, d):
    return records.deduplicated_storage(stored_records(spark, d)).select("ord")


_VALID = "version IS NOT NULL AND version >= '15.0.0' AND version NOT IN ('9.3.0', '10.0.0') AND plain <> 'org/m7' AND NOT (plain IN ('org/m8', 'org/m9') AND coalesce(few_flag, TRUE))"


@query(f"WITH {_KEYED}, good AS (SELECT ord, plain FROM keyed WHERE {_VALID}) SELECT ord FROM good WHERE plain IN (SELECT plain FROM good GROUP BY plain HAVING count(*) >= 7)")
def records_that_count(spark, d):
    """Valid records of models with enough of them; versions are compared as text."""
    good = records.valid(stored_records(spark, d), ["^org/m7$"], ["org/m[89]"])
    return records.of_frequent_models(good).select("ord")


@query(f"WITH {_KEYED} SELECT ord FROM keyed WHERE licensed IS NOT NULL AND open IS NOT NULL AND merge IS NOT NULL AND scratch IS NOT NULL")
def records_with_metadata(spark, d):
    """Records checked for required flags: those without are left out first, so that the check lets all pass."""
    whole = stored_records(spark, d).where(F.size(records.missing_metadata()) == 0)
    return records.with_metadata(records.without_collisions(whole)).select("ord")


_SCORES = f"""{_KEYED}, base AS (SELECT *, plain || CASE WHEN few_flag = FALSE AND val_flag THEN ' (zero-shot, val)' WHEN few_flag = FALSE THEN ' (zero-shot)' WHEN val_flag THEN ' (val)' ELSE '' END AS model FROM keyed),
    raws AS (SELECT model, dataset, 'primary' AS slot, [score / 100, score / 100 + 1] AS raw, score AS total, val_flag IS NULL AS agnostic FROM base
             UNION ALL SELECT model, dataset, 'secondary', [score / 50, score / 50 + 1], score / 2, val_flag IS NULL FROM base WHERE length(dataset) % 2 = 1),
    kept AS (SELECT model, dataset, slot, total, agnostic, list_transform(list_filter(raw, lambda x: x >= 0), lambda x: x::DOUBLE) AS raw FROM raws),
    scaled AS (SELECT model, dataset, slot, total, agnostic, list_transform(raw, lambda x: x * CASE WHEN list_max(raw) <= 1 THEN 100.0 ELSE 1.0 END) AS raw FROM kept WHERE len(raw) > 0)"""


def _scores(spark, d) -> DataFrame:
    tasks = spark.createDataFrame([("task0", "mcc", None), ("task1", "mcc", "macro_f1")], "task string, primary_metric string, secondary_metric string")
    return records.scores(stored_records(spark, d), tasks)


@query(f"WITH {_SCORES} SELECT model, dataset, slot, round(total, 6) AS total, len(raw) AS n, round(list_avg(raw), 6) AS mean, round(CASE WHEN len(raw) > 1 THEN list_stddev_samp(raw) / sqrt(len(raw)) ELSE 0 END, 6) AS std_err, agnostic AS split_agnostic FROM scaled")
def record_scores(spark, d):
    """Raw scores, totals and errors of each record's metrics: negative ones go, shares become percent before the error."""
    mean = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x) / F.size("raw")
    return _scores(spark, d).select("model", "dataset", "slot", r6("total").alias("total"), F.size("raw").cast("long").alias("n"), r6(mean).alias("mean"), r6("std_err").alias("std_err"), "split_agnostic")


_STRIPPED = "CASE WHEN model LIKE '% (val)' THEN left(model, length(model) - 6) WHEN model LIKE '%, val)' THEN left(model, length(model) - 6) || ')' END"
_THIN = f"{_SCORES}, thin AS (SELECT model, dataset, agnostic, count(*) AS n FROM scaled WHERE total > 50 GROUP BY ALL)"


def _thin(spark, d) -> DataFrame:
    # Computed once: the joins use it up to four times.
    return settled(_scores(spark, d).where("total > 50").groupBy("model", "dataset", "split_agnostic").agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {_THIN}, v AS (SELECT DISTINCT model AS val_model, {_STRIPPED} AS model FROM thin WHERE {_STRIPPED} IS NOT NULL)
    SELECT model, dataset, agnostic AS split_agnostic, n FROM thin UNION ALL SELECT val_model, t.dataset, agnostic, n FROM thin t JOIN v ON v.model = t.model WHERE agnostic AND NOT EXISTS (SELECT 1 FROM thin x WHERE x.model = val_model AND x.dataset = t.dataset)""")
def mirrored_scores(spark, d):
    return records.mirrored(_thin(spark, d)).select("model", "dataset", "split_agnostic", "n")


@query(f"""WITH {_THIN}, c AS (SELECT model, count(DISTINCT dataset) AS n FROM thin GROUP BY model)
    SELECT model, dataset, agnostic AS split_agnostic, n FROM thin WHERE model NOT IN (SELECT a.model FROM (SELECT model, n, {_STRIPPED} AS other FROM c) a JOIN c b ON b.model = a.other WHERE b.n >= a.n)""")
def scores_without_val_duplicates(spark, d):
    return records.without_val_duplicates(_thin(spark, d)).select("model", "dataset", "split_agnostic", "n")


@query(f"""WITH {_KEYED} SELECT plain AS model, (array_agg(try_cast(parameters AS DOUBLE) ORDER BY ord) FILTER (WHERE try_cast(parameters AS DOUBLE) >= 0))[1] AS parameters, (array_agg({_FLAG.format('licensed')} ORDER BY ord) FILTER (WHERE licensed IS NOT NULL))[1] AS licensed,
    (array_agg({_FLAG.format('open')} ORDER BY ord) FILTER (WHERE open IS NOT NULL))[1] AS open, coalesce((array_agg(url ORDER BY ord) FILTER (WHERE url LIKE 'https://x%'))[1], (array_agg(url ORDER BY ord) FILTER (WHERE url IS NOT NULL))[1]) AS url FROM keyed GROUP BY plain""")
def model_metadata(spark, d):
    """First informative value of each field; an address of a model's own beats one made from its name."""
    return records.model_metadata(stored_records(spark, d)).select("model", F.col("num_model_parameters").alias("parameters"), F.col("commercially_licensed").alias("licensed"), "open", F.col("model_url").alias("url"))


@query(f"""WITH {_KEYED}, cache AS (SELECT 'org/m' || n_nationkey AS model, CASE WHEN n_nationkey % 2 = 0 THEN 'true' END AS open, n_name AS generative_type FROM nation)
    SELECT ord, coalesce(k.open, c.open, 'false') AS open, coalesce(c.generative_type, 'base') AS generative_type FROM keyed k LEFT JOIN cache c ON c.model = k.plain""")
def enriched_records(spark, d):
    """Gaps filled from a cache by model, then from defaults."""
    cache = table(spark, d, "nation").select(F.concat(F.lit("org/m"), F.col("n_nationkey").cast("string")).alias("model"), F.when(F.col("n_nationkey") % 2 == 0, "true").alias("open"), F.col("n_name").alias("generative_type"))
    out = records.enriched(stored_records(spark, d), cache, {"open": "false", "generative_type": "base"})
    return out.select("ord", records.details("open").alias("open"), records.details("generative_type").alias("generative_type"))


@query(f"WITH {_KEYED} SELECT ord, CASE WHEN length(dataset) % 2 = 0 THEN 'european-values' ELSE 'task1' END AS task, CASE WHEN length(dataset) % 2 = 1 THEN few END AS few_shot, CASE WHEN length(dataset) % 2 = 1 THEN val END AS validation_split FROM keyed")
def renamed_tasks(spark, d):
    """Tasks under present names; those of surveys lose their flags."""
    out = records.fixed(stored_records(spark, d), {"task0": "european-values"})
    return out.select("ord", *[records.run_detail(c).alias(c) for c in ("task", "few_shot", "validation_split")])


@query("""SELECT event_id, 'org/m' || user_id AS model, CASE WHEN event_id % 3 = 1 THEN TRUE WHEN event_id % 5 = 0 THEN FALSE END AS validation_split, CASE WHEN event_id % 3 = 1 THEN FALSE WHEN event_id % 4 = 0 THEN TRUE END AS few_shot,
    CASE WHEN event_id % 2 = 0 THEN 'da,sv' ELSE 'da' END AS languages, 2 AS n_iterations, round(value + event_id, 6) AS second_f1 FROM events""")
def upgraded_results(spark, d):
    """Notes in names become flags, lone languages lists, and maps of scores a list of maps."""
    k = F.col("event_id")
    model = F.concat(F.lit("org/m"), F.col("user_id").cast("string"), F.when(k % 3 == 1, " (zero-shot, val)").otherwise(""))
    # Flags of their own only where the name has no note.
    own = lambda hit, value: F.when((k % 3 != 1) & hit, value)
    rows = table(spark, d, "events").select("event_id", model.alias("model"), own(k % 5 == 0, "false").alias("validation_split"), own(k % 4 == 0, "true").alias("few_shot"), F.when(k % 2 == 0, '["da", "sv"]').otherwise("da").alias("languages"), F.create_map(F.lit("f1"), F.array(F.col("value"), F.col("value") + k)).alias("raw"))
    raw = records.raw_as_list(F.col("raw"))
    return records.upgraded(rows).select("event_id", "model", "validation_split", "few_shot", F.array_join("languages", ",").alias("languages"), F.size(raw).alias("n_iterations"), r6(F.element_at(F.element_at(raw, 2), "f1")).alias("second_f1"))


@query("SELECT event_id, 'm' || user_id AS model, event_type AS dataset, event_id % 2 = 0 AS few_shot, CASE WHEN event_id % 3 > 0 THEN event_id % 3 = 1 END AS validation_split, round(value, 6) AS first_raw, round(value * 100, 6) AS total FROM events")
def envelope_round_trip(spark, d):
    """Flat results to envelopes and back."""
    k = F.col("event_id")
    flat = table(spark, d, "events").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"), F.col("event_type").alias("dataset"), F.lit("t").alias("task"), (k % 2 == 0).alias("few_shot"), F.when(k % 3 > 0, k % 3 == 1).alias("validation_split"), k.cast("string").alias("version"), F.array(F.create_map(F.lit("test_f1"), F.col("value"))).alias("raw"), F.create_map(F.lit("test_f1"), F.col("value") * 100).alias("total"))
    back = records.envelope_to_flat(records.flat_to_envelope(flat))
    return back.select(F.col("version").cast("long").alias("event_id"), "model", "dataset", "few_shot", "validation_split", r6(F.col("raw")[0]["test_f1"]).alias("first_raw"), r6(F.element_at("total", "test_f1")).alias("total"))


@query(f"""WITH {_SCORES}, thin AS (SELECT model, dataset, len(raw) AS k, CASE WHEN model LIKE '%val)' THEN 'val' ELSE 'test' END AS split FROM scaled WHERE slot = 'primary')
    SELECT model, dataset, split, k * n AS n_scored FROM thin LEFT JOIN (SELECT event_type AS ds, CASE WHEN event_id % 2 = 0 THEN 'val' ELSE 'test' END AS sp, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL) s ON ds = dataset AND sp = split""")
def scored_counts(spark, d):
    """Examples behind each score; datasets of unknown size have none."""
    sizes = table(spark, d, "events").where("event_type <> 'view'").groupBy(F.col("event_type").alias("dataset"), F.when(F.col("event_id") % 2 == 0, "val").otherwise("test").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return records.scored_count(_scores(spark, d).where("slot = 'primary'"), sizes).select("model", "dataset", "split", "n_scored")


@query("""SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0) GROUP BY text""")
def uncached_prompts(spark, d):
    """The first row of each text that a cache of every fourth document's lacks."""
    docs = table(spark, d, "documents")
    cache = docs.where("doc_id % 4 = 0").select(F.md5(F.col("text").cast("binary")).alias("key")).distinct()
    return records.to_run(docs.select("doc_id", "text"), cache, "text", "doc_id").select("doc_id")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def fresh_cache_rows(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts")).head()[0]
    return records.recent(events, "ts", 6, F.lit(now)).select("event_id")


@query(f"""WITH {_KEYED}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plain, dataset, coalesce(val_flag, FALSE), coalesce(few_flag, TRUE) ORDER BY {_PARTS.format("coalesce(version, '0.0.0')")} DESC, richness DESC, ord) AS rn FROM keyed WHERE event_id % 23 <> 0 AND dataset <> 'view') WHERE rn = 1),
    good AS (SELECT *, plain || CASE WHEN few_flag = FALSE AND val_flag THEN ' (zero-shot, val)' WHEN few_flag = FALSE THEN ' (zero-shot)' WHEN val_flag THEN ' (val)' ELSE '' END AS model FROM best WHERE {_VALID.replace("AND plain <> 'org/m7' AND NOT (plain IN ('org/m8', 'org/m9') AND coalesce(few_flag, TRUE))", "")}),
    often AS (SELECT * FROM good WHERE plain IN (SELECT plain FROM good GROUP BY plain HAVING count(*) >= 3) AND score >= -100),
    v AS (SELECT DISTINCT model AS val_model, {_STRIPPED} AS model FROM often WHERE {_STRIPPED} IS NOT NULL),
    every AS (SELECT model, dataset, score FROM often UNION ALL SELECT val_model, t.dataset, t.score FROM often t JOIN v ON v.model = t.model WHERE val_flag IS NULL AND NOT EXISTS (SELECT 1 FROM often x WHERE x.model = val_model AND x.dataset = t.dataset)),
    c AS (SELECT model, count(DISTINCT dataset) AS n FROM every GROUP BY model)
    SELECT model, dataset, round(score, 6) AS total FROM every WHERE model NOT IN (SELECT a.model FROM (SELECT model, n, {_STRIPPED} AS other FROM c) a JOIN c b ON b.model = a.other WHERE b.n >= a.n)""")
def score_table(spark, d):
    """From stored records to the table of scores on a board of all datasets but ``view``."""
    tasks = spark.createDataFrame([("task0", "mcc", None), ("task1", "mcc", None)], "task string, primary_metric string, secondary_metric string")
    config = event_config(spark, d).where("dataset <> 'view'")
    return leaderboard.score_table(stored_records(spark, d), tasks, config, least_records=3).select("model", "dataset", r6("total").alias("total"))


_RANKED = """scores AS (SELECT user_id::VARCHAR AS model, event_type AS dataset, value AS raw FROM events WHERE NOT (user_id % 3 = 0 AND event_type = 'view')),
    config AS (SELECT DISTINCT category, event_type AS dataset, 'task' || (length(event_type) % 2) AS task, 'lang' || (length(event_type) % 3) AS language FROM events, (SELECT unnest(['all', 'few']) AS category) WHERE category = 'all' OR length(event_type) > 4),
    means AS (SELECT model, dataset, avg(raw) AS mean FROM scores GROUP BY ALL),
    stats AS (SELECT m.dataset, max(mean) AS best, any_value(sd) AS sd FROM means m JOIN (SELECT dataset, CASE WHEN count(*) > 1 THEN stddev_pop(raw) ELSE 1.0 END AS sd FROM scores GROUP BY dataset) s ON s.dataset = m.dataset GROUP BY m.dataset),
    ranked AS (SELECT model, m.dataset, 1 + (best - mean) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS rank_score FROM means m JOIN stats s ON s.dataset = m.dataset)"""


@query(f"""WITH {_RANKED}, t AS (SELECT category, model, language, task, avg(rank_score) AS score FROM ranked r JOIN config c ON c.dataset = r.dataset GROUP BY ALL), l AS (SELECT category, model, language, avg(score) AS score FROM t GROUP BY ALL),
    every AS (SELECT * FROM l UNION ALL SELECT category, model, NULL, avg(score) FROM l GROUP BY category, model),
    have AS (SELECT category, model, language, count(DISTINCT r.dataset) AS n FROM ranked r JOIN config c ON c.dataset = r.dataset GROUP BY GROUPING SETS ((category, model, language), (category, model))), need AS (SELECT category, language, count(DISTINCT dataset) AS n FROM config GROUP BY GROUPING SETS ((category, language), (category)))
    SELECT e.category, e.model, e.language, round(e.score, 6) AS score FROM every e JOIN have h ON h.category = e.category AND h.model = e.model AND h.language IS NOT DISTINCT FROM e.language JOIN need d ON d.category = e.category AND d.language IS NOT DISTINCT FROM e.language AND d.n = h.n""")
def category_board(spark, d):
    """Scores by category and language, each of the models that have all of its own datasets."""
    scores = event_scores(spark, d).where("NOT (model_no % 3 = 0 AND dataset = 'view')")
    config = event_config(spark, d)
    config = planning.union_of(config.withColumn("category", F.lit("all")), config.where(F.length("dataset") > 4).withColumn("category", F.lit("few")))
    return leaderboard.category_scores(scores, config).withColumn("score", r6("score"))


@query("""WITH leaves AS (SELECT user_id::VARCHAR AS model, 'lang' || (length(event_type) % 3) AS language, 'task' || (length(event_type) % 2) AS task, avg(value) AS score, (max(value) - min(value)) / 2 AS margin FROM events GROUP BY user_id, event_type),
    t AS (SELECT model, language, task, round(avg(score), 9) AS score, round(1.96 * sqrt(sum(power(margin / 1.96, 2))) / count(*), 9) AS margin FROM leaves GROUP BY ALL), l AS (SELECT model, language, round(avg(score), 9) AS score, round(1.96 * sqrt(sum(power(margin / 1.96, 2))) / count(*), 9) AS margin FROM t GROUP BY ALL)
    SELECT model, language, round(score, 7) AS score, round(margin, 6) AS margin FROM l UNION ALL SELECT model, NULL, round(avg(score), 7), round(1.96 * sqrt(sum(power(margin / 1.96, 2))) / count(*), 6) FROM l GROUP BY model""")
def analytic_board(spark, d):
    """Intervals of each dataset carried up to tasks, languages and overall."""
    rows = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("model"), F.col("event_type").alias("dataset")).agg(F.avg("value").alias("rank_score"), F.min("value").alias("lower"), F.max("value").alias("upper"))
    return ranking.analytic_ranks(rows, event_config(spark, d), 9).select("model", "language", F.round("score", 7).alias("score"), F.round("margin", 6).alias("margin"))


@query("SELECT s_suppkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY CASE WHEN s_acctbal > 0 THEN s_acctbal END NULLS LAST, s_suppkey) AS position FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def ordinal_ranks(spark, d):
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).withColumn("score", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    return ranking.ordinal(rows, ["n_name"], "score", "s_suppkey").select("s_suppkey", "n_name", "position")


@query("""SELECT model, task, round(avg(v), 6) AS score FROM (SELECT DISTINCT 'm' || (user_id // 2) AS model, 'task' || (length(event_type) % 2) AS task, event_type, first_value(value) OVER (PARTITION BY user_id // 2, event_type ORDER BY event_id DESC) AS v FROM events WHERE event_type <> 'view') GROUP BY model, task""")
def orthogonal_scores(spark, d):
    """Means over a task's orthogonal datasets, the last variant of a model counting."""
    rows = table(spark, d, "events").select(F.floor(F.col("user_id") / 2).alias("pair"), F.col("event_type").alias("dataset"), F.col("value").alias("total"), "event_id")
    wanted = event_config(spark, d).where("dataset <> 'view'").select("dataset", "task")
    return serving.orthogonal_means(rows, wanted, F.concat(F.lit("m"), F.col("pair").cast("string")), "event_id").withColumn("score", r6("score"))


@query("SELECT p_partkey FROM part WHERE NOT (p_size % 3 = 0 AND p_size >= 20 AND p_retailprice <= 1500)")
def without_orthogonal_only(spark, d):
    """Rows with nothing in the value columns but scores in an orthogonal one go."""
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, "1.0").otherwise("-").alias("a"), F.when(F.col("p_retailprice") > 1500, "2").otherwise("-").alias("b"), F.when(F.col("p_size") >= 20, F.col("p_size")).alias("speed"))
    return serving.with_scores_of_their_own(rows, ["a", "b"], ["speed"]).select("p_partkey")


@query("""SELECT p_name AS model, list_sort(list(DISTINCT language)) AS languages FROM (SELECT p_name || p_partkey AS p_name, p_brand, 'lang' || l AS language, c, p_size, p_retailprice * (1 + l) AS rank FROM part, range(0, 3) t(l), range(0, 2) u(c) WHERE p_size % (c + 2) > 0) a
    WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size % (a.c + 2) > 0 AND b.p_size <= a.p_size AND b.p_retailprice * (1 + substr(a.language, 5)::INT) < a.rank) GROUP BY p_name""")
def pareto_languages(spark, d):
    """Languages in which a part is on its brand's frontier of size and price, in either of two categories."""
    rows = table(spark, d, "part").withColumn("l", F.explode(F.array(*map(F.lit, range(3))))).withColumn("c", F.explode(F.array(*map(F.lit, range(2))))).where("p_size % (c + 2) > 0")
    rows = rows.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("model"), "p_brand", "c", F.concat(F.lit("lang"), F.col("l").cast("string")).alias("language"), "p_size", (F.col("p_retailprice") * (1 + F.col("l"))).alias("rank"))
    return serving.pareto_languages(rows, ["p_brand", "c", "language"], "p_size", "rank")


@query("""WITH e AS (SELECT p_partkey, lower(p_name) AS name, p_size, [CASE WHEN p_partkey % 3 > 0 THEN p_brand || '/' || (p_partkey // 4) END, CASE WHEN p_partkey % 5 > 0 THEN p_type || '/' || p_partkey END] AS w FROM part WHERE p_size % 2 = 0),
    m AS (SELECT name, p_size, unnest(w) AS model, generate_subscripts(w, 1) AS place FROM (SELECT name, p_size, list_filter(w, lambda x: x IS NOT NULL) AS w FROM e)), f AS (SELECT model, min({'o': -p_size, 'n': name, 'p': place}) AS spot FROM m GROUP BY model)
    SELECT model, row_number() OVER (ORDER BY spot, model) AS rank FROM f ORDER BY spot, model LIMIT 12""")
def most_open_models(spark, d):
    k = F.col("p_partkey")
    weights = F.array(F.when(k % 3 > 0, F.concat("p_brand", F.lit("/"), F.floor(k / 4).cast("string"))), F.when(k % 5 > 0, F.concat("p_type", F.lit("/"), k.cast("string"))))
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("text").alias("kind"), (F.col("p_size") % 2 == 0).alias("required_open"), F.col("p_size").alias("open_count"), weights.alias("weights"))
    return serving.top_open(rows, 12).select("model", F.col("rank").cast("long").alias("rank"))


@query("SELECT s_suppkey AS rank, s_name AS model, s_acctbal AS mean_rank_score, 1 AS speed, 'x' AS generative_type, TRUE AS open, TRUE AS commercial, FALSE AS merge, FALSE AS trained_from_scratch, 5 AS parameters, 6 AS vocabulary_size, 7 AS context, s_nationkey AS danish, 8 AS scala_da, '1' AS scala_da_version, 0 AS scala_da_failures, 9 AS scala_da_scored FROM supplier")
def board_columns(spark, d):
    """A board's columns put in order from a jumble, one that is not wanted left out."""
    given = {"scala_da_scored": F.lit(9), "context": F.lit(7), "speed": F.lit(1), "danish": F.col("s_nationkey"), "model": F.col("s_name"), "unwanted": F.lit(0), "open": F.lit(True), "merge": F.lit(False), "commercial": F.lit(True), "rank": F.col("s_suppkey"), "scala_da": F.lit(8), "parameters": F.lit(5), "scala_da_failures": F.lit(0), "mean_rank_score": F.col("s_acctbal"), "trained_from_scratch": F.lit(False), "scala_da_version": F.lit("1"), "vocabulary_size": F.lit(6), "generative_type": F.lit("x")}
    return serving.in_order(table(spark, d, "supplier").select(*[c.alias(k) for k, c in given.items()]), ["speed"], ["danish"], ["scala-da"])


@query("SELECT doc_id, lang, source, quality FROM documents JOIN labels USING (doc_id)")
def natural_join(spark, d):
    return records.natural_join(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels").select("doc_id", "quality"))


@query("SELECT c.conv_id, turn, length(b.text) AS n FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id")
def matched_sources(spark, d):
    """Responses with their source; those without one are left out (and counted beside)."""
    rows, _ = records.matched(table(spark, d, "conversations").select("conv_id", "turn"), table(spark, d, "benchmark").select(F.col("item_id").alias("conv_id"), "text"), "conv_id")
    return rows.select("conv_id", "turn", F.length("text").alias("n"))


@query("""SELECT event_id FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_id % 2 = 1 AND r.user_id = e.user_id AND r.event_type = e.event_type AND (r.event_id % 3 = 0 OR (r.event_id % 3 = 1) = (e.event_id % 4 = 0)) AND (r.event_id % 5 = 0 OR (r.event_id % 5 = 1) = (e.event_id % 8 = 0)))""")
def requests_to_run(spark, d):
    """Requests without a record of the same model and dataset whose shots and split are the same or unknown."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("model"), F.col("event_type").alias("dataset"))
    requests = rows.where(k % 2 == 0).withColumns({"few_shot": k % 4 == 0, "validation_split": k % 8 == 0})
    done = rows.where(k % 2 == 1).withColumns({"few_shot": F.when(k % 3 > 0, k % 3 == 1), "validation_split": F.when(k % 5 > 0, k % 5 == 1)})
    return planning.not_benchmarked(requests, done).select("event_id")


@query("SELECT user_id, event_type, event_id FROM events WHERE event_id % 3 > 0 AND (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id % 3 = 0)")
def pending_pairs(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return planning.pending(rows.where("event_id % 3 > 0"), rows.where("event_id % 3 = 0"), ["user_id", "event_type"])


@query("SELECT user_id % 25 AS model, sum(value)::DOUBLE AS ignored, count(*) AS n FROM events WHERE event_id % 4 = 1 GROUP BY 1")
def zero_shot_runs(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 25).alias("model"), "value", (F.col("event_id") % 4 != 1).alias("few_shot"))
    return planning.by_shots(rows, "zero").groupBy("model").agg(F.sum("value").alias("ignored"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, sum(ceil(p_size * 1000003 * (p_partkey % 4 + 1) * 4 / 8.0)) * 1.35 AS bytes FROM part GROUP BY p_brand")
def memory_needed(spark, d):
    rows = table(spark, d, "part").select("p_brand", (F.col("p_size") * 1000003).alias("count"), ((F.col("p_partkey") % 4 + 1) * 4).alias("bits"))
    return planning.memory_needed(rows, ["p_brand"], "count", "bits")


@query("SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 2")
def having_both(spark, d):
    return planning.having_all(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT name, time, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY time DESC, name DESC ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (ORDER BY time DESC, name DESC) AS n FROM (SELECT s_name AS name, s_suppkey // 2 AS time, s_nationkey + 1 AS bytes FROM supplier)) WHERE total > 40 AND n > 1")
def snapshots_to_prune(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.floor(F.col("s_suppkey") / 2).alias("time"), (F.col("s_nationkey") + 1).alias("bytes"))
    return files.to_prune(rows, 40)


@query("SELECT url AS path FROM pages WHERE page_id % 3 > 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def files_to_download(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("path"), "page_id")
    return files.to_download(pages.where("page_id % 3 > 0").select("path"), pages.where("page_id % 3 = 0"))


@query("SELECT doc_id FROM documents WHERE doc_id > (SELECT max(doc_id) FROM documents WHERE doc_id < 100) ORDER BY doc_id LIMIT 50")
def next_batch(spark, d):
    """The rows after those that are stored."""
    docs = table(spark, d, "documents").select("doc_id")
    return files.next_batch(docs, docs.where("doc_id < 100"), "doc_id", 50)


@query("""WITH e AS (SELECT o_orderkey, o_orderpriority, o_orderkey % 3 = 0 AS slow, o_orderkey % 2 = 0 AS generative, o_orderstatus AS status_order, o_custkey % 4 AS size_order, o_orderdate AS created FROM orders WHERE o_custkey % 10 = 1)
    SELECT o_orderkey AS id, row_number() OVER (ORDER BY slow, generative DESC, status_order, size_order, created, o_orderkey) AS place FROM e""")
def request_queue(spark, d):
    """Requests in the order they are taken; the place shows the order."""
    from plumbline.operators.curation import dense_index

    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").where("o_custkey % 10 = 1").select(k.alias("id"), (k % 3 == 0).alias("slow"), (k % 2 == 0).alias("generative"), F.col("o_orderstatus").alias("status_order"), (F.col("o_custkey") % 4).alias("size_order"), F.col("o_orderdate").alias("created"))
    key = F.struct("slow", (~F.col("generative")).alias("last"), "status_order", "size_order", "created", "id")
    return dense_index(serving.queue(rows).withColumn("key", key), "key", "place").select("id", (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT a AS login, count(*) AS n FROM (SELECT DISTINCT o_orderkey, unnest(['u' || (o_custkey % 7), 'u' || (o_orderkey % 7), 'bot']) AS a FROM orders) WHERE a <> 'bot' GROUP BY a")
def contributors(spark, d):
    user = lambda c: F.concat(F.lit("u"), (F.col(c) % 7).cast("string"))
    rows = table(spark, d, "orders").select(F.array(user("o_custkey"), user("o_orderkey"), F.lit("bot")).alias("assignees"))
    return serving.contributor_counts(rows, "assignees", ["bot"])


@query("SELECT p_partkey, round(((log10(p_retailprice) - 2) + 0.1) / 2.2 * 500, 6) AS log_place, round((p_size - 1.0) / 49 * 300, 6) AS place FROM part")
def axis_places(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(serving.axis_place("p_retailprice", 100, 10_000, 500, padding=0.05)).alias("log_place"), r6(serving.axis_place("p_size", 1, 50, 300, log=False)).alias("place"))


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY n DESC NULLS LAST, t DESC NULLS LAST, s_suppkey) AS place FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS n, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN lower(s_name) ELSE s_acctbal::VARCHAR END AS t FROM supplier)""")
def sorted_board(spark, d):
    """A board by a column of numbers, texts and blanks, largest first; the place shows the order."""
    k = F.col("s_suppkey")
    cell = F.when(k % 5 == 0, "-").when(k % 7 == 0, F.col("s_name")).otherwise(F.col("s_acctbal").cast("string"))
    rows = serving.sorted_rows(table(spark, d, "supplier").withColumn("cell", cell), "cell", "s_suppkey", descending=True)
    # One page holds the whole board, a small table.
    return rows.limit(1 << 30).withColumn("place", F.monotonically_increasing_id() + 1).select("s_suppkey", "place")


@query("SELECT event_type AS dataset, round(avg(value), 6) AS mean, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS margin FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events WHERE length(event_type) > 4) GROUP BY event_type")
def board_datasets(spark, d):
    """Only the datasets on a board, by a semi join; then their means."""
    rows = event_scores(spark, d).join(event_config(spark, d).where(F.length("dataset") > 4), "dataset", "left_semi")
    out = ranking.mean_interval(rows, ["dataset"], "raw")
    return out.select("dataset", r6("mean").alias("mean"), r6("margin").alias("margin"))
