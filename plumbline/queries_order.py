"""Joins on order, and changes in the order of arrival, on the driver's tables, with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.operators import intervals
from plumbline.session import scratch_folder


@query("""WITH e AS (SELECT event_id, event_type, user_id, epoch_us(ts) // 1000000 AS s, floor(value * 600)::BIGINT AS n FROM events)
    SELECT a.event_id, count(*) AS n_open, min(b.event_id) AS first_open, max(b.event_id) AS last_open FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type <> 'error'
    AND a.n > 0 AND b.n > 0 AND a.s < b.s + b.n AND b.s < a.s + a.n GROUP BY a.event_id""")
def overlapping_events(spark, d):
    """Events last as long as their values say; for each error, its user's other events that were open meanwhile."""
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = table(spark, d, "events").select("event_id", "event_type", "user_id", start.alias("s"), (start + F.floor(F.col("value") * 600)).alias("e"))
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "s", "e")
    others = events.where("event_type <> 'error'").select("user_id", F.col("event_id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = intervals.overlapping(errors, others, ["user_id"], ("s", "e"), ("s2", "e2"))
    return pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_open"), F.min("other").alias("first_open"), F.max("other").alias("last_open"))


@query("""WITH v AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'),
    m AS (SELECT p.event_id, max_by(v, (v.ts, v.event_id)) AS v FROM events p JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id)
    SELECT p.event_id, m.v.event_id AS view_id, m.v.value AS view_value FROM events p LEFT JOIN m USING (event_id) WHERE p.event_type = 'purchase'""")
def last_view_before(spark, d):
    """Each purchase with its user's last view at or before it."""
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return intervals.as_of(bought, views, ["user_id"], "ts", "ts", ["view_id", "view_value"], ["view_id"]).select("event_id", "view_id", "view_value")


@query("""WITH arrived AS (SELECT 'org/m' || (user_id % 40) AS model, event_type AS dataset, (event_id * 7919) % 3 AS run, max(event_id) AS newest FROM events GROUP BY ALL),
    changed AS (SELECT *, coalesce(max(newest) OVER (PARTITION BY model, dataset ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS held FROM arrived)
    SELECT model, dataset, count(*) FILTER (WHERE newest > held) AS n_changes, count(*) FILTER (WHERE newest > held AND held >= 0) AS n_replaced, max(newest) AS newest FROM changed GROUP BY ALL""")
def changed_records(spark, d):
    """Records that arrive in three runs of a stream with state: how often each identity's newest one changed, and the last."""
    from plumbline.streaming import ingest, state

    inbox, store, checkpoint = (f"{scratch_folder(spark)}/{x}-{uuid.uuid4().hex}" for x in ("inbox", "changes", "checkpoint"))
    event_id, name = F.col("event_id").cast("string"), F.concat(F.lit("org/m"), (F.col("user_id") % 40).cast("string"))
    library = F.struct(F.lit("any").alias("name"), F.concat(F.lit("15.0."), event_id).alias("version"), F.struct(F.col("event_type").alias("dataset")).alias("additional_details"))
    events = table(spark, d, "events").select("event_id", F.struct(F.lit("0.2.1").alias("schema_version"), event_id.alias("evaluation_id"), F.struct(name.alias("name")).alias("model_info"), library.alias("eval_library")).alias("r"))
    for run in range(3):
        events.where(F.col("event_id") * 7919 % 3 == run).select("r.*").write.mode("append").json(inbox)
        state.keep_changes(ingest.record_stream(spark, inbox), store, checkpoint).awaitTermination()
    what = F.from_json("record", "model_info struct<name string>, eval_library struct<additional_details struct<dataset string>>, evaluation_id string")
    rows = spark.read.parquet(store).select(what.alias("r"), "replaces").select(F.col("r.model_info.name").alias("model"), F.col("r.eval_library.additional_details.dataset").alias("dataset"), F.col("r.evaluation_id").cast("long").alias("id"), "replaces")
    return rows.groupBy("model", "dataset").agg(F.count(F.lit(1)).alias("n_changes"), F.count_if("replaces").alias("n_replaced"), F.max("id").alias("newest"))
