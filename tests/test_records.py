import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import planning, records
from plumbline.plans import leaderboard
from plumbline.sources import files, store
from plumbline.sources.config import config_from, inferred_task
from plumbline.streaming import ingest


def record(name="org/m", dataset="d1", version="15.1.0", few_shot="True", validation="False", raw=None, score=50.0, stamp="100", task="classify", metric="acc", **extra):
    return {
        "schema_version": "0.2.1", "evaluation_id": f"{dataset}/{name}/{stamp}", "retrieved_timestamp": stamp,
        "model_info": {"name": name, "id": name, "additional_details": {"num_model_parameters": "7000000", **extra}},
        "eval_library": {"name": "lib", "version": version, "additional_details": {"dataset": dataset, "task": task, "languages": '["da"]', "few_shot": few_shot, "validation_split": validation, "raw_results": json.dumps(raw if raw is not None else [{f"test_{metric}": 0.5}, {f"test_{metric}": 0.7}])}},
        "evaluation_results": [{"evaluation_name": f"test_{metric}", "source_data": {"dataset_name": dataset}, "score_details": {"score": score, "details": {"num_failed_instances": "-1" if stamp == "1" else "3"}}}],
    }


def stored(spark, rows):
    text = spark.createDataFrame([(float(i), json.dumps(r)) for i, r in enumerate(rows)], "ord double, line string")
    return text.select("ord", F.from_json("line", files.RECORD_SCHEMA).alias("r")).select("r.*", "ord")


def tasks(spark):
    return spark.createDataFrame([("classify", "acc", None), ("pair", "acc", "f1")], "task string, primary_metric string, secondary_metric string")


def test_identity_and_precedence(spark):
    rows = [record(version="15.1.0"), record(name='<a href="u">org/m</a>', version="15.10.0"), record(version="15.10.0", open="False"), record(version="15.10.0", open="True"), record(few_shot="False"), record(validation=None), record(validation="True")]
    kept = sorted(r.ord for r in records.deduplicated_rows(stored(spark, rows)).collect())
    assert kept == [2.0, 4.0, 6.0]  # unknown split counts as test; of equal version and richness the first
    by_storage = sorted(r.ord for r in records.deduplicated_storage(stored(spark, [*rows, record(version="15.10.0", stamp="2024-01-01T00:00:00Z"), record(version=None)])).collect())
    assert by_storage == [4.0, 5.0, 6.0, 7.0]


def test_validity(spark):
    rows = [record(version=v) for v in ("14.9.0", "15.0.0", "9.3.0", "9.4.0", None)] + [record(name="bad/one"), record(name="api-1"), record(name="api-1", few_shot="False"), record(name="api-1x")]
    keep = lambda mode: [r.ord for r in records.valid(stored(spark, rows), ["^bad/"], ["api-[0-9]"], mode=mode).orderBy("ord").collect()]
    assert keep("lexical") == [1.0, 3.0, 7.0, 8.0]  # as text 9.4.0 is above 15.0.0
    assert keep("semver") == [1.0, 7.0, 8.0]
    df = stored(spark, [record(stamp=str(i)) for i in range(7)] + [record(name="few")])
    assert records.of_frequent_models(df).count() == 7
    assert stored(spark, [record(merge="True", open="maybe")]).select(records.missing_metadata()).head()[0] == ["commercially_licensed", "open", "trained_from_scratch"]
    assert stored(spark, [record(), {"schema_version": "1"}]).where(records.is_record()).count() == 1


def test_scores_variants_and_mirror(spark):
    rows = [
        record(raw=[{"test_acc": 0.5}, {"acc": 0.7}, {"test_acc": -1}, {"failed_instances": []}]), record(dataset="d2", raw=[{"test_acc": 50}, {"test_acc": 1}]), record(dataset="d3", raw=[]),
        record(dataset="d4", validation=None, few_shot="False"), record(dataset="d1", validation="True", few_shot="False"), record(dataset="d5", task="pair", raw=[{"test_acc": 0.1, "f1": 0.2}]),
    ]
    got = {(r.model, r.dataset, r.slot): r for r in records.mirrored(records.scores(stored(spark, rows), tasks(spark))).collect()}
    assert got["org/m", "d1", "primary"].raw == [50.0, 70.0] and got["org/m", "d1", "primary"].std_err == pytest.approx(10.0) and got["org/m", "d1", "primary"].total == 50.0
    assert got["org/m", "d2", "primary"].raw == [50.0, 1.0]
    assert ("org/m (zero-shot, val)", "d4", "primary") in got and ("org/m (zero-shot)", "d4", "primary") in got
    assert not any(k[1] == "d3" for k in got) and ("org/m", "d5", "secondary") not in got  # no total of the second metric
    s = spark.createDataFrame([("a (val)", "x"), ("a (val)", "y"), ("a", "x"), ("b (val)", "x"), ("b", "x"), ("c (val)", "x")], "model string, dataset string")
    assert sorted({r.model for r in records.without_val_duplicates(s).collect()}) == ["a", "a (val)", "b", "c (val)"]
    sizes = spark.createDataFrame([("d1", "test", 10), ("d1", "val", 4)], "dataset string, split string, n int")
    counted = {r.model: r.n_scored for r in records.scored_count(records.scores(stored(spark, [record(), record(validation="True")]), tasks(spark)), sizes).collect()}
    assert counted == {"org/m": 20, "org/m (val)": 8}


def test_metadata(spark):
    df = stored(spark, [record(open=None, merge="False"), record(open="False", merge="True", stamp="1"), record(open="True", model_url="u")])
    r = records.model_metadata(df).head()
    assert (r.open, r.merge, r.model_url, r.num_model_parameters) == (False, False, "u", 7e6)
    cache = spark.createDataFrame([("org/m", "instruct")], "model string, generative_type string")
    assert {x.model_info.additional_details.generative_type for x in records.enriched(df, cache, {}).collect()} == {"instruct"}
    assert [r[0] for r in df.orderBy("ord").select(records.failed_instances()).collect()] == [3, None, 3]
    assert df.select(records.languages()).head()[0] == ["da"]
    assert records.fixed(df, {"classify": "new"}).select(records.run_detail("task")).head()[0] == "new"
    assert records.collisions(stored(spark, [record(), record(name="org_m"), record(name="org/m")])).count() == 0
    flat = spark.createDataFrame([("m", "d", "classify", True, None, "15.0.0", [{"test_acc": 0.5}], {"test_acc": 50.0})], "model string, dataset string, task string, few_shot boolean, validation_split boolean, version string, raw array<map<string,double>>, total map<string,double>")
    envelope = records.flat_to_envelope(flat)
    r = envelope.select(records.raw_results(), records.total_scores(), records.few_shot()).head() if False else envelope.select("eval_library.additional_details.raw_results", "evaluation_results").head()
    assert json.loads(r.raw_results) == [{"test_acc": 0.5}] and r.evaluation_results[0].score_details.score == 50.0


def test_text_functions(spark):
    df = spark.createDataFrame([("org/M-7B-instruct@r1#p (zero-shot, val)",), ('<a href="x">org/80B-A3B</a>',), ("g-270m",), (None,)], "m string")
    rows = df.select(T.plain_model_id(F.col("m")), T.strip_val(F.col("m")), T.parameters_in(F.col("m")), T.type_of(F.col("m")), T.split_model_id(T.plain_model_id(F.col("m")))).collect()
    assert rows[0][:4] == ("org/M-7B-instruct@r1#p", "org/M-7B-instruct@r1#p (zero-shot)", 7_000_000_000, "instruction_tuned") and tuple(rows[0][4]) == ("org/M-7B-instruct", "r1", "p")
    assert rows[1][0] == "org/80B-A3B" and rows[1][2] == 80_000_000_000 and rows[2][2] == 270_000_000
    n = spark.createDataFrame([(950.0,), (1200.0,), (3e6,), (7.5e9,), (None,)], "x double")
    assert [r[0] for r in n.select(T.compact_number(F.col("x"))).collect()] == ["950", "1.2K", "3M", "7.5B", None]
    assert [r[0] for r in n.select(T.size_bucket(F.col("x"), {"small": 1e3, "medium": 1e7})).collect()] == ["small", "medium", "medium", "large", "unknown"]
    one = spark.createDataFrame([("<b>1,234.5 ± 2</b>@@9", ["a", "b", "c"], "say {'a': 1, b: 'x'} end", "a. x\nc. y")], "c string, l array<string>, j string, p string")
    r = one.select(T.cell(F.col("c")), T.listed(F.col("l")), T.json_object(F.col("j")), T.choices_named(F.col("p"), ["a", "b", "c"]), T.score_text(F.lit(1.234), F.lit(0.5)), T.last_match(F.col("p"), r"[a-z]\.")).head()
    assert tuple(r[0]) == ("1,234.5 ± 2", "9", 9.0) and r[1] == "'a', 'b' or 'c'" and r[2] == {"a": "1", "b": "x"} and r[3] == ["a", "c"] and r[4] == "1.23 ± 0.50" and r[5] == "c."
    e = spark.createDataFrame([("12.5",), ("1970-01-01T00:00:10Z",), ("x",)], "t string")
    assert [r[0] for r in e.select(T.epoch(F.col("t"))).collect()] == [12.5, 10.0, 0.0]


def test_lenient_lines_and_trees(spark, tmp_path):
    good = json.dumps(record())
    (tmp_path / "a.jsonl").write_text(f"\n{good}{good}\n[1]\nnot json\n\n")
    assert files.jsonl_records(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        files.jsonl_records(spark, str(tmp_path / "a.jsonl"), strict=True).collect()
    (tmp_path / "tree/x").mkdir(parents=True)
    (tmp_path / "tree/x/r.json").write_text(json.dumps(record(), indent=2))
    assert files.record_tree(spark, str(tmp_path / "tree")).select("model_info.name").head()[0] == "org/m"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.conllu").write_text("# text = Vi er\n# source = s1\n1-2\tVier\t_\t_\t_\n1\tVi\tvi\tPRON\t_\n2\ter\ter\tAUX\t_\n3\t.\t.\tPUNCT\t_\n\n# text = Ja\n1\tJa\tja\tINTJ\t_\n")
    rows = files.conllu(spark, str(tmp_path / "t.conllu")).collect()
    assert rows[0].ids == ["1-2", "3"] and rows[0].tokens == ["Vier", "."] and rows[0].tags == ["PRON", "PUNCT"] and rows[0].doc == "Vi er" and rows[1].tokens == ["Ja"] and rows[1].source is None
    (tmp_path / "b.csv").write_text('~~~ ,Task A,,Task B\nmodel,x,y,z\n"a, b",1,2,3\n')
    got = {(r.group, r.column): r.value for r in files.board_csv(spark, str(tmp_path / "b.csv")).collect()}
    assert got == {("", "model"): "a, b", ("Task A", "x"): "1", ("Task A", "y"): "2", ("Task B", "z"): "3"}
    df = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v long")
    path = str(tmp_path / "out")
    assert files.write_changed(df, path, "k") == 2 and files.write_changed(df, path, "k") == 0
    assert files.write_changed(df.withColumn("v", F.when(F.col("k") == "k2", 5).otherwise(F.col("v")).cast("long")), path, "k") == 1
    assert sorted(r.value for r in store.read(spark, path).collect()) == ['{"k":"k1","v":1}', '{"k":"k2","v":5}']
    assert files.content_hash(df) == files.content_hash(df.orderBy(F.desc("v")).repartition(2)) != files.content_hash(df.limit(1))
    snaps = spark.createDataFrame([("a", 1, 50), ("b", 2, 50), ("c", 3, 90)], "name string, time int, bytes long")
    assert sorted(r.name for r in files.to_prune(snaps, 100).collect()) == ["a", "b"]
    files.write_merged(df, str(tmp_path / "m"), ["k"])
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    assert files.find_split(["train", "test_long", "test"], "test") == "test" and files.find_split([], "x") is None
    with pytest.raises(ValueError, match="only csv"):
        files.csv_splits(spark, {"train": "x.json"})
    assert files.html_text("<p>a &amp; b<br>c<script>no</script></p><a href=x>d</a>") == ("a & b\nc\nd", 1)
    assert config_from("name: x\nlanguages: [da, sv]\ntask: classify").languages == ("da", "sv")
    assert inferred_task(["text", "label"]) == "sequence-classification"
    hints = config_from('{"tasks": [{"split": "dev", "config": "da", "field_spec": {"input": "q", "target": "literal:x", "choices": "opts"}, "solvers": [{"name": "multiple_choice"}]}]}', name="repo", languages=["da"])
    assert (hints.task, hints.columns, hints.splits[2], hints.source, hints.languages) == ("multiple-choice", {"q": "text", "opts": "choices"}, "dev", "da", ("da",))
    assert config_from('{"name": "x", "tasks": [{"scorers": [{"name": "model_graded_fact"}]}]}').task == "reference-free-qa"
    flat = config_from('{"name": "x", "input_column": "body", "target_column": "mark"}')
    assert flat.columns == {"body": "text", "mark": "label"} and flat.task == "sequence-classification" and flat.languages == ("en",)
    with pytest.raises(ValueError, match="unknown"):
        config_from('{"name": "x", "task": "t", "code": 1}')


def test_board_end_to_end(spark):
    config = spark.createDataFrame([("da", "classify", "d1"), ("sv", "classify", "d2")], "language string, task string, dataset string")
    rows = [record(name=m, dataset=d, raw=[{"test_acc": base + i / 100} for i in range(5)], score=base * 100) for m, base in (("good", 0.9), ("same", 0.9), ("poor", 0.1)) for d in ("d1", "d2")] + [record(name="half", dataset="d1")]
    scores = leaderboard.score_table(stored(spark, rows), tasks(spark), config, least_records=1)
    got = {r.model: r for r in leaderboard.board(scores, config, records.model_metadata(stored(spark, rows)), replicates=30).collect()}
    assert set(got) == {"good", "same", "poor"} and got["good"]["rank"] == got["same"]["rank"] == 1 and got["poor"]["rank"] == 2
    assert got["poor"].da > got["good"].da and "±" in got["good"].score


def test_streaming_ingest(spark, tmp_path):
    for i, rows in enumerate([[record(version="15.1.0"), record(dataset="d2")], [record(version="15.2.0", stamp="7")]]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.json").write_text("\n".join(map(json.dumps, rows)))
        query = ingest.keep_newest(ingest.record_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check"))
        query.awaitTermination()
    last = ingest.newest(spark, str(tmp_path / "store"))
    ingest.compacted(spark, str(tmp_path / "store"), str(tmp_path / "folded"))
    assert sorted(r.eval_library.version for r in ingest.newest(spark, str(tmp_path / "folded")).collect()) == ["15.1.0", "15.2.0"]
    assert sorted((r.eval_library.additional_details.dataset, r.eval_library.version) for r in last.collect()) == [("d1", "15.2.0"), ("d2", "15.1.0")]


def test_planning(spark):
    models = spark.createDataFrame([("m", ["da", "sv"])], "model string, languages array<string>")
    datasets = spark.createDataFrame([("da", "x"), ("da", "y"), ("sv", "z")], "language string, dataset string")
    done = spark.createDataFrame([("m", "x"), ("m", "z")], "model string, dataset string")
    assert [tuple(r) for r in planning.jobs(models, datasets, done).collect()] == [("m", "da", ["y"])]
    requests = spark.createDataFrame([("m", "x", True, False), ("m", "y", True, True), ("m", "y", True, False)], "model string, dataset string, few_shot boolean, validation_split boolean")
    known = spark.createDataFrame([("m", "x", None, None), ("m", "y", True, True)], "model string, dataset string, few_shot boolean, validation_split boolean")
    assert [tuple(r) for r in planning.not_benchmarked(requests, known).collect()] == [("m", "y", True, False)]
    assert [r[0] for r in planning.having_all(done.union(spark.createDataFrame([("n", "x")], "a string, b string")), "model", "dataset", ["x", "z"]).collect()] == ["m"]
    with pytest.raises(ValueError, match="choose one"):
        planning.by_shots(spark.createDataFrame([("m", True), ("m", False)], "model string, few_shot boolean"), "auto")
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "ord int, prompt string")
    cache = prompts.where("prompt = 'a'").select(F.md5(F.col("prompt").cast("binary")).alias("key"))
    assert [r.ord for r in records.to_run(prompts, cache).collect()] == [2]
