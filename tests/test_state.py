"""Ingest with state against a fold over batches."""

import json
import time

from plumbline.streaming import ingest, state
from tests.test_records import record


def run(spark, folder, number, rows, keep_ms=None):
    (folder / "in").mkdir(exist_ok=True)
    (folder / f"in/{number}.json").write_text("\n".join(map(json.dumps, rows)))
    query = state.keep_changes(ingest.record_stream(spark, str(folder / "in")), str(folder / "store"), str(folder / "check"), keep_ms)
    assert query.awaitTermination(90) and query.exception() is None
    rows = spark.read.parquet(str(folder / "store")).collect()
    return sorted((r.identity.split('"dataset":"')[1][:2], r.version.split(".")[1].lstrip("0"), r.at, r.replaces) for r in rows)


def test_only_changes_go_on_and_a_restart_knows_the_state(spark, tmp_path):
    before = {name: spark.conf.get(name, None) for name in state.SETTINGS}
    first = run(spark, tmp_path, 0, [record(version="15.1.0", stamp="5"), record(version="15.10.0", stamp="4"), record(dataset="d2", version="15.3.0", stamp="1")])
    assert first == [("d1", "10", 4.0, False), ("d2", "3", 1.0, False)]
    # Older, equal and again the same: nothing.  Each run is a new query on the checkpoint of the one before.
    assert run(spark, tmp_path, 1, [record(version="15.9.0", stamp="9"), record(version="15.10.0", stamp="4"), record(dataset="d2", version="15.3.0", stamp="0")]) == first
    third = run(spark, tmp_path, 2, [record(version="15.10.0", stamp="7"), record(dataset="d3", version="15.2.0", stamp="1")])
    assert third == sorted([*first, ("d1", "10", 7.0, True), ("d3", "2", 1.0, False)])
    last = state.current(spark, str(tmp_path / "store")).collect()
    assert sorted((r.eval_library.additional_details.dataset, r.eval_library.version, r.retrieved_timestamp) for r in last) == [("d1", "15.10.0", "7"), ("d2", "15.3.0", "1"), ("d3", "15.2.0", "1")]
    assert before == {name: spark.conf.get(name, None) for name in state.SETTINGS}


def test_an_expired_identity_is_new_again(spark, tmp_path):
    first = run(spark, tmp_path, 0, [record(version="15.2.0", stamp="5")], keep_ms=1)
    time.sleep(0.1)
    assert run(spark, tmp_path, 1, [record(version="15.1.0", stamp="5")], keep_ms=1) == sorted([*first, ("d1", "1", 5.0, False)])
