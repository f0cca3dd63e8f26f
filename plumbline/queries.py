"""The operators on the driver's tables, each with the same result in SQL where SQL can express it.

Averages and the like are rounded to six digits on both sides, since engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import ORACLES, QUERIES, query, r6, table  # noqa: F401
from plumbline.functions import labels as L
from plumbline.functions import text as T
from plumbline.functions.hashing import draw_sql, draws_sql
from plumbline.operators import constraints, curation, metrics, planning, ranking, serving
from plumbline.sources import files
from plumbline.streaming import ingest

REPLICATES = 100


def event_scores(spark: SparkSession, d: str) -> DataFrame:
    """Events as raw scores: users are models and event types datasets."""
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("model"), F.col("user_id").alias("model_no"), F.col("event_type").alias("dataset"), F.col("event_id").alias("position"), F.col("value").alias("raw"))


def event_config(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("dataset")).distinct().select("dataset", F.concat(F.lit("task"), F.length("dataset") % 2).alias("task"), F.concat(F.lit("lang"), F.length("dataset") % 3).alias("language"))


_SCORES = "scores AS (SELECT user_id::VARCHAR AS model, user_id AS model_no, event_type AS dataset, event_id AS position, value AS raw FROM events)"
_CONFIG = "config AS (SELECT DISTINCT event_type AS dataset, 'task' || (length(event_type) % 2) AS task, 'lang' || (length(event_type) % 3) AS language FROM events)"
_MEANS = "means AS (SELECT model, dataset, avg(raw) AS mean FROM scores GROUP BY ALL)"
_STATS = "stats AS (SELECT m.dataset, max(mean) AS best, any_value(sd) AS sd FROM means m JOIN (SELECT dataset, CASE WHEN count(*) > 1 THEN stddev_pop(raw) ELSE 1.0 END AS sd FROM scores GROUP BY dataset) s ON s.dataset = m.dataset GROUP BY m.dataset)"
_RANKED = "ranked AS (SELECT model, m.dataset, 1 + (best - mean) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS rank_score FROM means m JOIN stats s ON s.dataset = m.dataset)"


def _hierarchy_sql(source: str, by: str = "") -> str:
    return f"""tasks AS (SELECT {by} model, language, task, avg(rank_score) AS score FROM {source} r JOIN config c ON c.dataset = r.dataset GROUP BY ALL),
    languages AS (SELECT {by} model, language, avg(score) AS score FROM tasks GROUP BY ALL),
    board AS (SELECT {by} model, language, score FROM languages UNION ALL SELECT {by} model, NULL, avg(score) FROM languages GROUP BY {by} model)"""


_BOARD = f"WITH {_SCORES}, {_CONFIG}, {_MEANS}, {_STATS}, {_RANKED}, {_hierarchy_sql('ranked')}"


@query(f"{_BOARD} SELECT model, language, round(score, 6) AS score FROM board")
def rank_score_hierarchy(spark, d):
    return ranking.rank_board(event_scores(spark, d), event_config(spark, d)).select("model", "language", r6("score").alias("score"))


@query(f"{_BOARD} SELECT model, " + ", ".join(f"round(any_value(score) FILTER (WHERE language = 'lang{i}'), 6) AS lang{i}" for i in range(3)) + " FROM board WHERE language IS NOT NULL GROUP BY model")
def score_matrix(spark, d):
    names = [f"lang{i}" for i in range(3)]
    return ranking.score_matrix(event_scores(spark, d), event_config(spark, d), names).select("model", *[r6(n).alias(n) for n in names])


@query(f"{_BOARD} SELECT greatest(ceil(max(score) * 2) / 2, 2.5) AS axis_max FROM board")
def axis_max(spark, d):
    return ranking.axis_max(ranking.rank_board(event_scores(spark, d), event_config(spark, d)))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS margin, count(*) AS n FROM lineitem GROUP BY ALL")
def mean_ci_by_group(spark, d):
    return ranking.mean_interval(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity").select("l_returnflag", "l_linestatus", r6("mean").alias("mean"), r6("margin").alias("margin"), "n")


@query("SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.975), 6) AS upper FROM events GROUP BY ALL")
def percentile_ci(spark, d):
    return ranking.selected_interval(table(spark, d, "events"), ["event_type"], "value").select("event_type", *[r6(c).alias(c) for c in ("lower", "median", "upper")])


@query("SELECT o_orderpriority, round(1.96 * sqrt(sum(power((o_totalprice * 1.1 - o_totalprice * 0.9) / 3.92, 2)) / power(count(*), 2)), 4) AS margin FROM orders GROUP BY ALL")
def analytic_margin(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") * 0.9).alias("lower"), (F.col("o_totalprice") * 1.1).alias("upper"))
    return ranking.combined_margin(rows, ["o_orderpriority"], "lower", "upper").select("o_orderpriority", F.round("margin", 4).alias("margin"))


_PLACED = "placed AS (SELECT task, dataset, row_number() OVER (PARTITION BY task ORDER BY dataset) - 1 AS place, count(*) OVER (PARTITION BY task) AS n, dense_rank() OVER (ORDER BY task) AS task_no FROM (SELECT DISTINCT task, dataset FROM config))"
_BOOT = f"""WITH {_SCORES}, {_CONFIG}, {_MEANS}, {_STATS}, {_PLACED},
    slots AS (SELECT b AS replicate, task, task_no, n, place AS slot FROM placed, range(0, {REPLICATES}) t(b)),
    drawn AS (SELECT s.replicate, s.task, s.task_no, s.slot, p.dataset FROM (SELECT *, ({draw_sql(42, 'replicate', 'task_no', 'slot')}) % n AS place FROM slots) s JOIN placed p ON p.task = s.task AND p.place = s.place),
    lists AS (SELECT model, model_no, dataset, list(raw ORDER BY position, raw) AS raws, count(*) AS n FROM scores GROUP BY ALL),
    picks AS (SELECT o.replicate, l.model, o.dataset, o.task, o.slot, l.raws[(({draws_sql('k', 43, 'o.replicate', 'o.task_no', 'o.slot', 'l.model_no')}) % l.n)::BIGINT + 1] AS raw
              FROM (SELECT *, unnest(range(0, n)) AS k FROM lists) l JOIN drawn o ON o.dataset = l.dataset),
    ranked AS (SELECT replicate, model, p.dataset, task, slot, 1 + (any_value(best) - avg(raw)) / any_value(sd) AS rank_score FROM picks p JOIN stats s ON s.dataset = p.dataset WHERE sd > 0 GROUP BY replicate, model, p.dataset, task, slot),
    {_hierarchy_sql('(SELECT replicate, model, dataset, rank_score FROM ranked)', 'replicate, ')}"""


def _boot(spark, d, replicates: int = REPLICATES) -> DataFrame:
    return ranking.bootstrap_scores(event_scores(spark, d), event_config(spark, d), replicates)


@query(f"{_BOOT} SELECT model, round(quantile_cont(score, 0.025), 6) AS lower, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.975), 6) AS upper FROM board WHERE language IS NULL GROUP BY model")
def bootstrap_overall_ci(spark, d):
    return ranking.bootstrap_intervals(_boot(spark, d)).select("model", *[r6(c).alias(c) for c in ("lower", "median", "upper")])


@query()
def significance_rank(spark, d):
    return ranking.significance_ranks(_boot(spark, d).withColumn("category", F.lit("all")), "category")


@query(f"""WITH {_SCORES}, {_MEANS}, {_STATS}, lists AS (SELECT model, model_no, dataset, list(raw ORDER BY position, raw) AS raws, count(*) AS n FROM scores GROUP BY ALL),
    picks AS (SELECT replicate, model, dataset, raws[(({draws_sql('k', 42, 'replicate', 'model_no')}) % n)::BIGINT + 1] AS raw FROM (SELECT *, unnest(range(0, n)) AS k FROM lists), range(0, {REPLICATES}) t(replicate)),
    boots AS (SELECT model, p.dataset, replicate, 1 + (any_value(best) - avg(raw)) / CASE WHEN any_value(sd) > 0 THEN any_value(sd) ELSE 1.0 END AS score FROM picks p JOIN stats s ON s.dataset = p.dataset GROUP BY model, p.dataset, replicate)
    SELECT model, dataset, round(quantile_cont(score, 0.025), 5) AS lower, round(quantile_cont(score, 0.5), 5) AS median, round(quantile_cont(score, 0.975), 5) AS upper FROM boots GROUP BY ALL""")
def dataset_rank_ci(spark, d):
    return ranking.dataset_rank_intervals(event_scores(spark, d), REPLICATES, digits=12).select("model", "dataset", *[F.round(c, 5).alias(c) for c in ("lower", "median", "upper")])


@query("""WITH have AS (SELECT DISTINCT l_suppkey::VARCHAR AS model, l_returnflag || l_linestatus AS dataset FROM lineitem WHERE l_quantity > 49)
    SELECT model FROM have GROUP BY model HAVING count(*) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)""")
def eligible_by_division(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("model"), F.concat("l_returnflag", "l_linestatus").alias("dataset"), "l_quantity")
    return ranking.eligible(rows.where("l_quantity > 49"), rows)


@query("""SELECT p_partkey, p_brand, p_size, p_retailprice FROM part a WHERE NOT EXISTS
    (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size <= a.p_size AND b.p_retailprice < a.p_retailprice)""")
def pareto_frontier(spark, d):
    return serving.pareto(table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice")


@query("SELECT DISTINCT n_nationkey AS c_nationkey, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000")
def coverage_missing(spark, d):
    customers = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    segments = customers.agg(F.collect_set("c_mktsegment").alias("s"))
    expected = table(spark, d, "nation").join(F.broadcast(segments)).select(F.col("n_nationkey").alias("c_nationkey"), F.explode("s").alias("c_mktsegment"))
    return planning.missing(expected, customers.where("c_acctbal > 9000"), ["c_nationkey", "c_mktsegment"])


@query("SELECT n_regionkey::VARCHAR AS model, c_mktsegment AS language, list_sort(list(DISTINCT o_orderpriority)) AS datasets FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN (SELECT DISTINCT o_orderpriority FROM orders) ON TRUE WHERE NOT EXISTS (SELECT 1 FROM nation n2 WHERE n2.n_regionkey = nation.n_regionkey AND n2.n_regionkey::VARCHAR = substr(o_orderpriority, 1, 1)) GROUP BY ALL")
def evaluation_jobs(spark, d):
    pairs = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    models = pairs.groupBy(F.col("n_regionkey").cast("string").alias("model")).agg(F.collect_set("c_mktsegment").alias("languages"))
    kinds = table(spark, d, "orders").select(F.col("o_orderpriority").alias("dataset")).distinct()
    datasets = table(spark, d, "customer").select(F.col("c_mktsegment").alias("language")).distinct().crossJoin(F.broadcast(kinds))
    done = kinds.select(F.substring("dataset", 1, 1).alias("model"), "dataset")
    return planning.jobs(models, datasets, done)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def dedup_newest_richest(spark, d):
    from plumbline.operators.records import newest_by

    rows = table(spark, d, "events")
    return newest_by(rows, F.struct("user_id", "event_type"), [F.col("value"), F.col("ts")], "event_id").select("event_id", "user_id", "event_type")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def dedup_exact_documents(spark, d):
    return curation.drop_exact_duplicates(table(spark, d, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 200 AND 2000")
def length_filter(spark, d):
    return curation.length_between(table(spark, d, "documents"), "text", 200, 2000).select("doc_id", "n_chars")


@query(r"""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL) WHERE n > 50)""")
def repetition_filter(spark, d):
    return curation.not_repetitive(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id")


@query("""SELECT doc_id, lang, CASE WHEN (rn - 1) * 100 < n * 70 THEN 'train' WHEN (rn - 1) * 100 < n * 80 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('4242:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def stratified_split(spark, d):
    return curation.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", {"train": 70, "val": 10, "test": 20})


@query("""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('4242:' || doc_id), doc_id) AS rn FROM labels)
    WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def balanced_downsample(spark, d):
    return curation.balanced(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('4242:' || doc_id), doc_id LIMIT 100")
def exact_sample(spark, d):
    return curation.exact_sample(table(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query("SELECT doc_id, CASE WHEN rn <= 64 THEN 'train' WHEN rn <= 96 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('4242:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 160")
def fixed_split(spark, d):
    return curation.fixed_split(table(spark, d, "documents").select("doc_id"), "doc_id", {"train": 64, "val": 32, "test": 64})


@query("""SELECT doc_id, label, turn FROM (SELECT *, row_number() OVER (ORDER BY rn, label) AS turn FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY pos) AS rn FROM
    (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pos) AS first FROM (SELECT d.doc_id, text, quality::VARCHAR AS label, md5('4242:' || d.doc_id) || ':' || d.doc_id AS pos FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    WHERE length(text) < (SELECT min(b) FROM (SELECT b FROM (SELECT unnest([512, 1024, 2048, 4096, 8192]) AS b), (SELECT length(text) AS n FROM documents JOIN labels USING (doc_id)) GROUP BY b HAVING count(*) FILTER (WHERE n < b) >= 12)))) WHERE first = 1)) WHERE turn <= 12""")
def few_shot_round_robin(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    return curation.few_shot(rows, ["0", "1"], 12, "doc_id").select("doc_id", "label", "turn")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 40")
def frequent_sources(spark, d):
    return curation.value_counts(table(spark, d, "documents"), "source", 40)


@query("""SELECT doc_id, split FROM (SELECT *, min(p) OVER (PARTITION BY text) AS least FROM (SELECT *, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS p FROM
    (SELECT doc_id, text, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM documents))) WHERE p = least""")
def without_split_overlap(spark, d):
    split = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 < 8, "val").otherwise("test")
    return curation.first_split(table(spark, d, "documents").select("doc_id", "text", split.alias("split"))).select("doc_id", "split")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents WHERE n_chars > 300")
def dense_index(spark, d):
    return curation.dense_index(table(spark, d, "documents").where("n_chars > 300").select("doc_id"), "doc_id").select("doc_id", F.col("index").cast("long").alias("index"))


@query("SELECT doc_id, CASE WHEN a IS NULL OR b IS NULL OR a = b THEN ['negative', 'neutral', 'positive'][coalesce(a, b) + 2] WHEN abs(a - b) = 1 THEN ['negative', 'neutral', 'positive'][a + b + 2] END AS merged FROM (SELECT doc_id, quality - 1 AS a, toxic * 2 - 1 AS b FROM labels)")
def merged_annotations(spark, d):
    a, b = F.col("quality") - 1, F.col("toxic") * 2 - 1
    return table(spark, d, "labels").select("doc_id", curation.merged_ternary(a, b).alias("merged"))


@query("SELECT item_id, start, array_to_string(list_slice(w, start + 1, start + 16), ' ') AS window_text FROM (SELECT item_id, w, unnest(range(0, greatest(ceil((len(w) - 16) / 12.0), 0)::BIGINT * 12 + 1, 12)) AS start FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))")
def token_windows(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    return curation.windows(rows, "w", 16, 4).select("item_id", F.col("start").cast("long").alias("start"), F.array_join("window", " ").alias("window_text"))


_LABELS = "(SELECT toxic AS p, 1 - quality AS r FROM labels)"


def _predictions(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(F.lit("all").alias("g"), F.col("toxic").alias("prediction"), (1 - F.col("quality")).alias("reference"))


@query(f"SELECT 'all' AS g, round(avg((p = r)::INT), 6) AS accuracy FROM {_LABELS}")
def label_accuracy(spark, d):
    return metrics.accuracy(_predictions(spark, d), ["g"]).select("g", r6("accuracy").alias("accuracy"))


@query(f"SELECT 'all' AS g, round(avg(2.0 * tp / n), 6) AS macro_f1 FROM (SELECT k, sum((p = k AND r = k)::INT) AS tp, sum((p = k)::INT) + sum((r = k)::INT) AS n FROM {_LABELS}, (SELECT DISTINCT unnest([p, r]) AS k FROM {_LABELS}) GROUP BY k)")
def label_macro_f1(spark, d):
    return metrics.macro_f1(_predictions(spark, d), ["g"]).select("g", r6("macro_f1").alias("macro_f1"))


@query(f"SELECT 'all' AS g, round(CASE WHEN below > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt(below) ELSE 0 END, 6) AS mcc FROM (SELECT *, (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) AS below FROM (SELECT sum((p = 1 AND r = 1)::INT) AS tp, sum((p = 0 AND r = 0)::INT) AS tn, sum((p = 1 AND r = 0)::INT) AS fp, sum((p = 0 AND r = 1)::INT) AS fn FROM {_LABELS}))")
def label_mcc(spark, d):
    return metrics.mcc(_predictions(spark, d), ["g"]).select("g", r6("mcc").alias("mcc"))


@query("""SELECT lang, round(s - c, 6) AS bias, round(u, 6) AS accuracy, round(greatest(0, u - abs(s - c)), 6) AS adjusted FROM
    (SELECT lang, avg((doc_id % 3 = n_chars % 3)::INT) AS s, avg((doc_id % 3 = (n_chars + 1) % 3)::INT) AS c, avg((doc_id % 3 = (n_chars + 2) % 3)::INT) AS u FROM documents GROUP BY lang)""")
def bias_adjusted_accuracy(spark, d):
    rows = table(spark, d, "documents").select("lang", (F.col("doc_id") % 3).alias("prediction"), (F.col("n_chars") % 3).alias("stereo_idx"), ((F.col("n_chars") + 1) % 3).alias("counter_idx"), ((F.col("n_chars") + 2) % 3).alias("unknown_idx"))
    return metrics.bias(rows, ["lang"]).select("lang", *[r6(c).alias(c) for c in ("bias", "accuracy", "adjusted")])


@query("SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)) WHERE rn = 1")
def majority_vote(spark, d):
    return metrics.majority_vote(table(spark, d, "events"), ["user_id"], "event_type")


@query("SELECT event_type, round(avg(CASE WHEN value > 0 THEN ln(value) / ln(2) END), 6) AS bits_per_character FROM events GROUP BY ALL")
def mean_bits(spark, d):
    rows = table(spark, d, "events").select("event_type", F.when(F.col("value") > 0, F.log2("value")).otherwise(F.lit(float("inf"))).alias("bpc"))
    return metrics.bits_per_character(rows, ["event_type"]).select("event_type", r6("bits_per_character").alias("bits_per_character"))


@query(r"SELECT role, round(avg(m::INT), 6) AS instruction_accuracy FROM (SELECT role, unnest([NOT contains(text, ','), NOT regexp_matches(text, '\d'), text = lower(text) AND text <> upper(text), contains(text, 'the') OR contains(text, 'die')]) AS m FROM conversations) GROUP BY role")
def instruction_accuracy(spark, d):
    wanted = [("punctuation:no_comma", {}), ("content:no_digits", {}), ("case:lowercase", {}), ("format:options", {"options": ["the", "die"]}), ("no:such", {})]
    return constraints.instruction_accuracy(table(spark, d, "conversations"), ["role"], "text", wanted).select("role", r6("instruction_accuracy").alias("instruction_accuracy"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def props_json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn, role || ': ' || text) AS prompt FROM conversations GROUP BY conv_id")
def conversation_prompt(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return curation.grouped_lists(rows, "conv_id", "line", "turn").select("conv_id", F.array_join("lines", "\n\n").alias("prompt"))


@query("""SELECT doc_id, score::INTEGER AS score FROM (SELECT doc_id, CASE WHEN contains(lower(source), 'src') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'src') THEN 1 ELSE 0 END + CASE WHEN contains(lower(lang), 'src') THEN 3 ELSE 0 END
    + CASE WHEN contains(lower(source), 'en') THEN 10 ELSE 0 END + CASE WHEN contains(lower(lang), 'en') THEN 3 ELSE 0 END + CASE WHEN contains(lower(text), 'en') THEN 1 ELSE 0 END AS score, contains(lower(source), 'en') OR contains(lower(lang), 'en') OR contains(lower(text), 'en') AS hit FROM documents) WHERE hit ORDER BY score DESC, doc_id LIMIT 8""")
def search_topk(spark, d):
    return serving.search(table(spark, d, "documents"), "src EN", 8, "doc_id", "source", "lang", "text").select("doc_id", F.col("score").cast("int").alias("score"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 10 OFFSET 20")
def leaderboard_page(spark, d):
    return serving.page(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [F.desc_nulls_last("s_acctbal"), F.asc("s_suppkey")], 10, 2)


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 30 AND (contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring')) AND lower(p_type) = 'economy'")
def board_filters(spark, d):
    rows = table(spark, d, "part").where(serving.in_bucket("p_size", 10, 30) & serving.matches("p_name", "Red ring"))
    return serving.filtered(rows, {"p_type": "economy"}, {"p_type"}).select("p_partkey")


@query("SELECT o_custkey, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN a IS NULL OR b IS NULL THEN '' WHEN a <> b AND na <> nb THEN 'total,n' WHEN a <> b THEN 'total' ELSE 'n' END AS columns FROM (SELECT coalesce(x.o_custkey, y.o_custkey) AS o_custkey, x.total AS a, y.total AS b, x.n AS na, y.n AS nb FROM (SELECT o_custkey, round(max(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY ALL) x FULL JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY ALL) y ON x.o_custkey = y.o_custkey) WHERE a IS NULL OR b IS NULL OR a <> b OR na <> nb")
def board_diff(spark, d):
    by_year = lambda y: table(spark, d, "orders").where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.round(F.max("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    return serving.changes(by_year(1997), by_year(1998), "o_custkey")


@query("SELECT c AS column, round(min(v), 6) AS least, round(max(v), 6) AS largest, count(DISTINCT v) AS n_distinct FROM (SELECT unnest(['p_size', 'p_retailprice']) AS c, unnest([p_size::DOUBLE, p_retailprice]) AS v FROM part) GROUP BY c")
def column_profile(spark, d):
    return serving.profile(table(spark, d, "part"), ["p_size", "p_retailprice"]).select("column", r6("least").alias("least"), r6("largest").alias("largest"), "n_distinct")


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def distinct_customers(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n_customers"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderpriority FROM orders GROUP BY o_orderpriority HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def common_priorities(spark, d):
    return planning.common_items(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


_IDS = "(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '<a href=\"x\">org/' || c_name || '</a>' WHEN 1 THEN 'org/' || c_name || ' (val)' WHEN 2 THEN 'org/' || c_name || '@r2#think (zero-shot, val)' ELSE 'org/' || c_name || '-7B-instruct (zero-shot)' END AS model FROM customer)"


@query(rf"""SELECT c_custkey, regexp_replace(regexp_replace(model, '^<a[^>]*>(.*)</a>$', '\1'), '\s*\((zero-shot|val|zero-shot, val)\)$', '') AS plain,
    CASE c_custkey % 4 WHEN 1 THEN replace(model, ' (val)', '') WHEN 2 THEN replace(model, ', val', '') END AS without_val, CASE WHEN c_custkey % 4 = 3 THEN 7000000000 END AS parameters, CASE WHEN c_custkey % 4 = 3 THEN 'instruction_tuned' END AS kind, CASE WHEN c_custkey % 4 = 2 THEN 'r2' ELSE 'main' END AS revision FROM {_IDS}""")
def model_ids(spark, d):
    name, k = F.col("c_name"), F.col("c_custkey") % 4
    org = F.concat(F.lit("org/"), name)
    model = F.when(k == 0, F.concat(F.lit('<a href="x">'), org, F.lit("</a>"))).when(k == 1, F.concat(org, F.lit(" (val)"))).when(k == 2, F.concat(org, F.lit("@r2#think (zero-shot, val)"))).otherwise(F.concat(org, F.lit("-7B-instruct (zero-shot)")))
    rows = table(spark, d, "customer").select("c_custkey", model.alias("m"))
    plain = T.plain_model_id(F.col("m"))
    return rows.select("c_custkey", plain.alias("plain"), T.strip_val(F.col("m")).alias("without_val"), T.parameters_in(plain).alias("parameters"), T.type_of(plain).alias("kind"), T.split_model_id(plain)["revision"].alias("revision"))


@query("SELECT l_orderkey, max(v) AS newest FROM (SELECT l_orderkey, l_linenumber * 10000 + (l_quantity % 12)::BIGINT AS v FROM lineitem) GROUP BY l_orderkey")
def newest_version(spark, d):
    v = F.concat_ws(".", F.col("l_linenumber").cast("string"), (F.col("l_quantity") % 12).cast("long").cast("string"))
    best = table(spark, d, "lineitem").select("l_orderkey", T.version(v).alias("v")).groupBy("l_orderkey").agg(F.max("v").alias("v"))
    return best.select("l_orderkey", (F.col("v")[0].cast("long") * 10000 + F.col("v")[1]).alias("newest"))


@query("SELECT item_id, 'Question: ' || text || chr(10) || 'Options:' || chr(10) || 'a. yes' || chr(10) || 'b. no' AS prompt, CASE WHEN item_id % 2 = 0 THEN 'a' ELSE 'b' END AS letter FROM benchmark")
def multiple_choice_prompt(spark, d):
    rows = table(spark, d, "benchmark").withColumn("choices", F.array(F.lit("yes"), F.lit("no ")))
    merged = curation.with_choices(rows.withColumnRenamed("text", "question"), "question", "choices", "Options")
    return merged.select("item_id", F.concat(F.lit("Question: "), "text").alias("prompt"), curation.choice_letter((F.col("item_id") % 2).cast("string"), F.col("choices")).alias("letter"))


@query("SELECT item_id, '<x>' || substr(text, 1, 8) || '</x>' || substr(text, 9) AS tagged FROM benchmark")
def tagged_spans(spark, d):
    spans = F.array(F.struct(F.lit(5).alias("start"), F.lit(8).alias("end")), F.struct(F.lit(0).alias("start"), F.lit(6).alias("end")))
    return table(spark, d, "benchmark").select("item_id", L.tagged(F.col("text"), spans, "x").alias("tagged"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def windowed_scores(spark, d):
    return ingest.windowed_scores(table(spark, d, "events")).select(F.col("window.start").alias("start"), "event_type", "n", r6("mean").alias("mean"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
    (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s""")
def user_sessions(spark, d):
    return ingest.sessions(table(spark, d, "events")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT c_mktsegment, r_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (c_mktsegment, r_name, o_orderpriority)")
def rollup_board(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup("c_mktsegment", "r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join_customers(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return rows.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_name", "n_name")


@query()
def html_to_text(spark, d):
    return files.page_texts(table(spark, d, "pages"))


@query()
def generation_metrics(spark, d):
    """Text metrics of each conversation's turns against its first."""
    turns = table(spark, d, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("reference"))
    rows = turns.join(first, "conv_id")
    out = metrics.rouge_l(rows, ["role"], "text", "reference").join(metrics.chrf(rows, ["role"], "text", "reference"), "role")
    return out.select("role", r6("rouge_l").alias("rouge_l"), r6("chrf").alias("chrf"))


@query()
def extracted_labels(spark, d):
    return L.extracted_label(table(spark, d, "benchmark").select("item_id", F.col("text").alias("said")), "said", ["positive", "negative", "neutral"]).select("item_id", "label", "label_failed")
