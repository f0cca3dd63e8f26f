import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import ranking
from plumbline.sources import store


def log(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, removed boolean").repartition(3)


def held(spark, path, version=None):
    rows = store.read(spark, path, version).collect()
    assert len({r.key for r in rows}) == len(rows)
    return {r.key: r.value for r in rows}


def test_writes_change_add_and_remove(spark, tmp_path):
    path, rng, want, seen = str(tmp_path / "s"), random.Random(3), {}, []
    assert held(spark, path) == {}
    for version in range(1, 5):
        keys = rng.sample([f"k{i}\n\"é" for i in range(200)], 60)
        changes = [(k, None if (gone := rng.random() < 0.3) else f"v{version}", gone) for k in keys]
        assert store.write(log(spark, changes), path, parts=7) == version
        want = {k: v for k, v in (want | {k: None if r else v for k, v, r in changes}).items() if v is not None}
        seen.append(dict(want))
        assert held(spark, path) == want
    assert [held(spark, path, v) for v in (1, 2, 3, 4)] == seen
    assert store.manifest(path)["parts"] == 7
    gone = store.vacuum(path)
    assert gone and store.versions(path) == [4] and held(spark, path) == want and store.vacuum(path) == 0


def test_only_changed_parts_are_rewritten_and_equal_content_is_one_file(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write(log(spark, [(f"k{i}", "a", False) for i in range(300)]), path, parts=16)
    before = store.manifest(path)["files"]
    store.write(log(spark, [("k5", "b", None)]), path)
    after = store.manifest(path)["files"]
    assert [p for p in before if before[p] != after[p]] == [str(store.part_of("k5", 16))]
    store.write(log(spark, [("k5", "a", False)]), path)
    assert store.manifest(path)["files"] == before and len(os.listdir(tmp_path / "s/files")) == len(before) + 1


def test_a_failed_write_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write(log(spark, [("a", "1", False), ("b", "1", False)]), path)
    for bad in ([("a", "2", False), (None, "x", False)], [("b", "2", False), ("b", "3", False)]):
        with pytest.raises(Exception, match="no key|two changes"):
            store.write(log(spark, bad), path)
    failing = log(spark, [("a", "2", False), ("b", "2", False)]).withColumn("value", F.when(F.col("key") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        store.write(failing, path)
    assert held(spark, path) == {"a": "1", "b": "1"} and store.versions(path) == [1]
    one, other = (store.RecordStore({"path": path}).writer(None, False) for _ in range(2))
    one.commit([None])
    with pytest.raises(RuntimeError, match="another job"):
        other.commit([None])
    two = [store._Written(2, {"1": "x"}), store._Written(2, {"1": "y"})]
    with pytest.raises(ValueError, match="two tasks"):
        store.RecordStore({"path": path}).writer(None, False).commit(two)


def test_changes_of_a_table(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.createDataFrame([("m1", 1), ("m2", 1), ("m3", None)], "id string, v int")
    store.write(store.changed(first, path, "id"), path)
    second = spark.createDataFrame([("m1", 2), ("m2", 1), ("m4", 9)], "id string, v int")
    assert {(r.key, r.removed) for r in store.changed(second, path, "id").collect()} == {("m1", False), ("m4", False)}
    assert {(r.key, r.removed) for r in store.changed(second, path, "id", remove_missing=True).collect()} == {("m1", False), ("m4", False), ("m3", True)}
    store.write(store.changed(second, path, "id", remove_missing=True), path)
    assert {k: json.loads(v)["v"] for k, v in held(spark, path).items()} == {"m1": 2, "m2": 1, "m4": 9}
    assert store.changed(second, path, "id", remove_missing=True).count() == 0


def test_selected_interval_is_the_percentile(spark):
    rng = random.Random(6)
    values = [*(rng.gauss(0, 10**rng.randrange(-200, 200)) for _ in range(500)), *(float(rng.randrange(-3, 4)) for _ in range(500)), -0.0, 0.0, 5e-324, -5e-324, 1.7e308, None, float("nan"), float("inf")]
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), v) for v in values] + [("one", 0, -2.5), ("none", 0, None), ("two", 1, 1.0), ("two", 1, 2.0)] + [("ties", 1, 7.25)] * 400
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(4)
    for alpha in (0.05, 0.5, 1.0, 0.0):
        got, want = ({(r.g, r.h): (r.lower, r.median, r.upper) for r in f(df, ["g", "h"], "v", alpha).collect()} for f in (ranking.selected_interval, ranking.percentile_interval))
        assert got.keys() == want.keys()
        for k, triple in want.items():
            assert all(x == y or x == pytest.approx(y, rel=1e-12) for x, y in zip(got[k], triple, strict=True)), (k, got[k], triple)
    assert "percentile" not in ranking.selected_interval(df, ["g"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert ranking.selected_interval(df.limit(0), ["g"], "v").count() == 0


def test_snippets(spark):
    def plain(text, term):
        at = text.lower().find(term.lower())
        if at < 0:
            return text[:140]
        start, end = max(0, at - 50), min(len(text), at + len(term) + 90)
        return ("…" if start else "") + text[start:end] + ("…" if end < len(text) else "")

    texts = ["", "Term", "x" * 139, "x" * 300] + ["a" * i + "teRM" + "b" * j for i in (0, 49, 50, 51, 52, 200) for j in (0, 89, 90, 91, 300)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.s for r in df.select("t", T.snippet(df.t, F.lit("Term")).alias("s")).collect()}
    assert got == {t: plain(t, "Term") for t in texts} | {None: None}
