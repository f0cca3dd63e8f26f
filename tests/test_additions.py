"""Operators without a query in SQL, errors, and odd inputs."""

import html
import json
import re
import string
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import api, queries, queries_metrics
from plumbline.functions import labels as L
from plumbline.functions import text as T
from plumbline.operators import constraints, curation, metrics, planning, records
from plumbline.sources import files
from plumbline.sources.config import DatasetConfig

DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_pages_against_another_parser(spark):
    def text(page):
        page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>", "", page or "")
        page = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", page)
        blocks = "p|div|br|li|h[1-6]|tr|article|section|title"
        page = re.sub(rf"(?i)</?(?:{blocks})(?:\s[^>]*)?/?>", "\n", page)
        lines = (" ".join(x.split()) for x in html.unescape(re.sub(r"<[^>]*>", "", page)).split("\n"))
        return "\n".join(x for x in lines if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_links) for r in queries.html_to_text(spark, DIR).collect()}
    assert got == {i: (text(x), len(re.findall(r"(?i)<a[\s>]", x or ""))) for i, x in pages.items()}


def test_text_metrics_of_queries_against_plain_means(spark):
    turns = spark.read.parquet(f"{DIR}/conversations.parquet").collect()
    first = {r.conv_id: r.text for r in turns if r.turn == 0}

    def mean(role, score):
        values = [score(r.text, first[r.conv_id]) for r in turns if r.role == role]
        return round(sum(values) / len(values), 6)

    for r in queries.generation_metrics(spark, DIR).collect():
        assert (r.rouge_l, r.chrf) == (pytest.approx(mean(r.role, metrics.rouge_l_score), abs=2e-6), pytest.approx(mean(r.role, metrics.chrf_score), abs=2e-6))
    for r in queries_metrics.overlap_metrics(spark, DIR).collect():
        assert r.meteor == pytest.approx(mean(r.role, metrics.meteor_score), abs=2e-6)
        assert r.chrf_words == pytest.approx(mean(r.role, lambda p, q: metrics.chrf_score(p, q, words=2)), abs=2e-6)
        assert r.sari == pytest.approx(mean(r.role, lambda p, q: metrics.sari_score(q, p, [q, p.lower()])), abs=2e-6)


def test_tags_from_json_and_back(spark):
    for r in queries_metrics.nearest_label_tags(spark, DIR).collect():
        words = next(x.text for x in spark.read.parquet(f"{DIR}/benchmark.parquet").where(F.col("item_id") == r.item_id).collect()).split(" ") if r.item_id < 3 else None
        tagged = r.tags.split(" ")
        assert set(tagged) <= {"o", "b-per"} and len(json.loads(r.json)["per"]) == tagged.count("b-per")
        if words:
            assert json.loads(r.json)["per"] == [w for w, t in zip(words, tagged, strict=True) if t == "b-per"] and {w for w in words if w[:1] in string.ascii_uppercase and w} == set(json.loads(r.json)["per"])


def test_scorers_take_words_apart():
    assert metrics.rouge_l_score("The dog runs.", "the dog runs") == 1.0
    assert metrics._words_and_marks('He said "no", then left!') == ["He", "said", '"no"', ",", "then", "left", "!"]
    assert metrics.chrf_score("the dog.", "the dog .", words=2) > metrics.chrf_score("the dog;", "the dog .", words=2)
    # Six words in order: no penalty but that of one chunk.
    assert metrics.meteor_score("a b c d e f", "a b c d e f") == pytest.approx(1 - 0.5 * (1 / 6) ** 3)
    assert metrics.meteor_score("", "a") == 0.0 and metrics.meteor_score("walking dogs", "walked dog") > 0.8
    assert metrics.meteor_score("c b a", "a b c") < metrics.meteor_score("a b c", "a b c")


@pytest.mark.parametrize(
    ("name", "arguments", "good", "bad"),
    [
        ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[] and [b]", "[a\n]"), ("fr:detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* **both**", "*one* * *"),
        ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "***a***b", "a***\n***b"), ("ca:detectable_format:constrained_response", {}, "La meva resposta és no.", "My answer is no."),
        ("special_character:accents", {}, "é", "e"), ("es:keywords:letter_frequency", {"letter": "A", "let_relation": "menos de", "let_frequency": 2}, "a b", "aa"),
        ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "So"}, "a\n\nso", "so\n\na"), ("change_case:spanish_capital", {}, "SÍ", "Sí"),
    ],
)
def test_public_ids_of_instructions(spark, name, arguments, good, bad):
    own, given = constraints.by_id(name, arguments)
    df = spark.createDataFrame([(good,), (bad,)], "x string")
    assert [r[0] for r in df.select(constraints.met(F.col("x"), own, **given)).collect()] == [True, False]
    assert constraints.by_id("no:such", {}) is None
    assert all(n in constraints.CONSTRAINTS for n, _ in constraints.IDS.values())


def test_tag_repair(spark):
    cases = {"a <T>b</T> c": "a <T>b</T> c", "<T<T<T>>>x</T></T>": "<T>x</T>", "</T>y": "y", "<T>a<T>b</T>c</T>d</T>": "<T>abc</T>d", "open <T>end  ": "open <T>end</T>", "": "", "none": "none", "<T><T>z": "<T>z</T>"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r[0]: r[1] for r in df.select("x", L.repaired_tags(F.col("x"), "T")).collect()} == cases
    spans = spark.createDataFrame([("ab<T>cd</T>e<T></T><T>f</T>",)], "x string").select(L.tagged_to_spans(F.col("x"), "T").alias("s")).head().s
    assert spans.text == "abcdef" and [(x.start, x.end) for x in spans.spans] == [(2, 4), (5, 6)]


def test_entities_and_sentences_of_marked_text(spark):
    text = "O <P>rei <L TIPO='x'>Lisboa . Porto</L> foi</P>. Fim <Q>a b</Q> <P>c</P><P>d</P> ! z"
    tokens = spark.createDataFrame([(text,)], "x string").select(L.entity_tags(F.col("x"), {"P": "PER", "L": "LOC"}).alias("t"))
    got = [(t.token, t.label) for t in tokens.head().t]
    assert got == [("O", "O"), ("rei", "B-PER"), ("Lisboa", "B-LOC"), (".", "I-LOC"), ("Porto", "I-LOC"), ("foi", "B-PER"), (".", "O"), ("Fim", "O"), ("a", "B-MISC"), ("b", "I-MISC"), ("c", "B-PER"), ("d", "B-PER"), ("!", "O"), ("z", "O")]
    sentences = [" ".join(t.token for t in s) for s in tokens.select(L.sentences_of(F.col("t")).alias("s")).head().s]
    assert sentences == ["O rei Lisboa . Porto", "foi .", "Fim a b c d !", "z"]


def test_corruptions_keep_to_parts_of_speech(spark):
    tokens, tags = "the cat sat on big mats today .".split(), "DET NOUN VERB ADP ADJ NOUN ADV PUNCT".split()
    rows = spark.range(80).select("id", F.array(*map(F.lit, tokens)).alias("t"), F.array(*map(F.lit, tags)).alias("p"))
    rows = rows.unionByName(spark.createDataFrame([(99, ["a", "b"], ["ADJ", "ADJ"]), (98, [], [])], "id long, t array<string>, p array<string>"))
    got = {r.id: r.c for r in rows.select("id", L.corrupted(F.col("t"), F.col("p"), F.col("id")).alias("c")).collect()}
    assert got[99] is None and got[98] is None
    kinds = {got[i].kind for i in range(80)}
    assert kinds == {"delete", "flip_neighbours"}
    for i in range(80):
        out = got[i].tokens
        if got[i].kind == "delete":
            gone = [k for k in range(8) if tokens[:k] + tokens[k + 1 :] == out]
            assert gone and all(tags[k] in ("NOUN", "VERB", "ADP") for k in gone)
        else:
            assert sorted(x.lower() for x in out) == sorted(tokens) and out[-1] == "." and out != tokens
    assert len({tuple(got[i].tokens) for i in range(80)}) > 6


def test_ids_and_types(spark):
    cases = {"<a href='x'>org/m</a> (val)": "org/m", "org/m (val, zero-shot)": "org/m", "org/m (other)": "org/m (other)", "x <a b>y</a> z": "y", "<abbr>n</abbr>": "<abbr>n</abbr>"}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r[0]: r[1] for r in df.select("m", T.plain_model_id(F.col("m"))).collect()} == cases
    sizes = {"org/x-7B-it": 7 * 10**9, "x_270m": 27 * 10**7, "x-1.5b": 15 * 10**8, "80B-A3B": 80 * 10**9, "a3b": None, "7Bert": None, "x-12mn-8b": 8 * 10**9}
    df = spark.createDataFrame([(k,) for k in sizes], "m string")
    assert {r[0]: r[1] for r in df.select("m", T.parameters_in(F.col("m"))).collect()} == sizes
    kinds = {"org/bert-base": None, "m-base": "base", "m-it": "instruction_tuned", "o3-mini": "reasoning"}
    df = spark.createDataFrame([(k,) for k in kinds], "m string")
    assert {r[0]: r[1] for r in df.select("m", T.type_of(F.col("m"))).collect()} == kinds


def test_helper_names_do_not_clash(spark):
    clash = ["_h", "_b", "_n", "_rank", "_part", "_in", "_start", "_size", "_all", "_least", "_at", "_before"]
    rows = [(i, f"t{i % 40}", str(i % 2)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, text string, label string").select("*", *[F.lit(c).alias(c) for c in clash])
    for out in (
        curation.dense_index(df, "id"), curation.stratified_split(df, "label", "id", {"train": 50, "test": 50}), curation.fixed_split(df, "id", {"train": 30}), curation.balanced(df, "label", "id"),
        curation.balanced_splits(df, "label", "id", {"train": 20}), curation.few_shot(df, ["0", "1"], 6, "id"), curation.few_shot_distinct(df, 6, "id"), curation.first_split(df.withColumn("split", F.lit("val"))),
    ):
        found = out.collect()
        assert found and all([r[c] for c in clash] == clash for r in found)


def test_few_shot_choice_by_turns(spark):
    """Against the plain loop: one label after the other takes its first row that is left."""
    rows = [(i, [f"w{i % 17}"], [["b-per", "o", "B-LOC", "i-per"][(i * k) % 4] for k in (1, 2, 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, labels array<string>")
    for labels, n in ((["B-per", "b-loc"], 9), (["b-org", "b-loc"], 5), (["b-org"], 3), (["b-per"], 40)):
        got = [(r.id, r.turn) for r in curation.few_shot_tokens(df, labels, n, "id").orderBy("turn").collect()]
        import hashlib

        at = lambda i: f"{hashlib.md5(f'4242:{i}'.encode()).hexdigest()}:{i}"
        left, want, idle, k = sorted(rows, key=lambda r: at(r[0])), [], 0, 0
        seen = set()
        left = [r for r in left if not (tuple(r[1]) in seen or seen.add(tuple(r[1])))]
        while len(want) < n and idle < len(labels):
            label, k = labels[k % len(labels)].lower(), k + 1
            fit = [r for r in left if label in [x.lower() for x in r[2]]]
            idle = 0 if fit else idle + 1
            if fit:
                want.append(fit[0][0])
                left.remove(fit[0])
        assert got == [(i, t) for t, i in enumerate(want, 1)]
    with pytest.raises(ValueError, match="short"):
        curation.few_shot_distinct(spark.createDataFrame([(1, "x" * 9000)], "id int, text string"), 1, "id", short=True)


def test_checks_fail_when_they_should(spark, tmp_path):
    with pytest.raises(ValueError, match="split val"):
        curation.require_in_splits({"train": spark.createDataFrame([(1,)], "a int"), "val": spark.createDataFrame([(1,)], "b int")}, ["a"])
    with pytest.raises(Exception, match="lines"):
        spark.createDataFrame([("one line",)], "x string").select(curation.prompt_parts(F.col("x"))).collect()
    from plumbline.queries_records import stored_records

    stored = stored_records(spark, DIR)
    with pytest.raises(Exception, match="metadata missing"):
        records.with_metadata(stored).count()
    # Two identities whose paths are the same once odd characters are replaced.
    one = stored.where("ord = 1")
    info = F.col("model_info")
    clash = one.withColumn("model_info", info.withField("id", F.lit("a b"))).unionByName(one.withColumn("model_info", info.withField("id", F.lit("a!b"))))
    with pytest.raises(Exception, match="identity"):
        records.without_collisions(clash).count()
    assert records.without_collisions(one).count() == 1
    with pytest.raises(ValueError, match="common"):
        records.natural_join(spark.range(1), spark.range(1).withColumnRenamed("id", "x"))
    with pytest.raises(ValueError, match="not as they should"):
        files.checked_snapshot(spark.createDataFrame([("f1", None), ("f2", 1)], "path string, x int"), F.col("x").isNotNull())
    _, lost = records.matched(spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int"), "k")
    assert lost.head().n_unmatched == 2
    with pytest.raises(ValueError, match="choose one"):
        planning.by_shots(spark.createDataFrame([("m", True), ("m", False)], "model string, few_shot boolean"), "auto")


def test_numbering_needs_no_single_task(spark):
    df = records.numbered(spark.range(500).select(F.md5(F.col("id").cast("string").cast("binary")).alias("path")).repartition(7), "path")
    got = [r.path for r in df.orderBy("ord").collect()]
    assert got == sorted(got) and sorted(r.ord for r in df.collect()) == list(range(500))


def test_windows_line_ends_and_blank_lines_in_a_treebank(spark, tmp_path):
    sentence = "# text = {0} b\n1-2\t{0}b\t_\t_\n1\t{0}\t_\tX\n2\tb\t_\tY\n"
    text = sentence.format("a") + " \t\n" + sentence.format("c") + "\n\n\n" + sentence.format("d")
    for name, end in (("unix", "\n"), ("dos", "\r\n")):
        (tmp_path / name).write_bytes(text.replace("\n", end).encode())
        got = files.conllu(spark, str(tmp_path / name)).collect()
        assert [(r.doc, r.tokens, r.tags) for r in got] == [(f"{x} b", [f"{x}b"], ["X"]) for x in "acd"]


def test_batches_go_on_where_they_stopped(spark):
    rows = spark.range(25)
    done, seen = None, []
    while True:
        batch = [r.id for r in files.next_batch(rows, done, "id", 10).collect()]
        if not batch:
            break
        seen += batch
        done = spark.createDataFrame([(x,) for x in seen], "id long")
    assert seen == list(range(25))


def test_evaluation_object(spark):
    config = DatasetConfig("d", "sequence-classification", ("da",), columns={"body": "text", "mark": "label"})
    raw = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "", "x"), (3, "drop", "x")], "index int, body string, mark string")
    own = api.Evaluation(config, ["accuracy", "letters"], lambda df: df.where("text <> 'drop'"), {"letters": lambda df, by: df.groupBy(*by).agg(F.avg(F.length("text")).alias("letters"))})
    examples = own.examples(raw)
    assert sorted(r["index"] for r in examples.collect()) == [0, 1]
    outputs = spark.createDataFrame([("m", k, i, p) for k in range(3) for i, p in ((0, "x"), (1, "xy"[k % 2]))], "model string, iteration int, index int, prediction string")
    scores = own.scores(examples, outputs, ["model", "iteration"])
    assert sorted((r.iteration, r.accuracy, r.letters) for r in scores.collect()) == [(0, 0.5, 1.0), (1, 1.0, 1.0), (2, 0.5, 1.0)]
    stored = own.results(scores, "model", "16.0.0")
    back = records.envelope_to_flat(stored).head()
    assert (back.model, back.dataset, back.few_shot, back.validation_split) == ("m", "d", True, False)
    assert [x["test_accuracy"] for x in back.raw] == [0.5, 1.0, 0.5] and back.total["test_accuracy"] == pytest.approx(200 / 3)
    with pytest.raises(ValueError, match="unknown metrics"):
        api.Evaluation(config, ["nope"]).scores(examples, outputs, ["model"])


def test_board_command(spark, tmp_path):
    config = [{"language": "da", "task": "t", "dataset": d} for d in ("x", "y")]
    flat = spark.createDataFrame([(f"m{m}", d, "t", True, False, "16.0.0", [{"test_mcc": (m + k) / 20} for k in range(4)], {"test_mcc": 5.0 * m + 7.5}) for m in range(3) for d in ("x", "y") for _ in range(1)], "model string, dataset string, task string, few_shot boolean, validation_split boolean, version string, raw array<map<string,double>>, total map<string,double>")
    rows = [json.loads(r.value) for r in records.flat_to_envelope(flat).select(F.to_json(F.struct("*")).alias("value")).collect()]
    folder = tmp_path / "records"
    folder.mkdir()
    for i, r in enumerate(rows * 4):  # copies of one identity count once
        (folder / f"{i}.json").write_text(json.dumps(r))
    (tmp_path / "config.json").write_text("\n".join(map(json.dumps, config)))
    (tmp_path / "tasks.json").write_text(json.dumps({"task": "t", "primary_metric": "mcc", "secondary_metric": "mcc"}))
    stored = records.numbered(files.record_tree(spark, str(folder)), "path")
    from plumbline.plans import leaderboard

    scores = leaderboard.score_table(stored, spark.read.json(str(tmp_path / "tasks.json")), spark.read.json(str(tmp_path / "config.json")), least_records=2)
    board = leaderboard.board(scores, spark.read.json(str(tmp_path / "config.json"))).collect()
    assert [r.model for r in board] == ["m2", "m1", "m0"] and board[0]["rank"] == 1 and board[0].da is not None
    with pytest.raises(SystemExit):
        api.main(["board", "--records", str(folder)])


def test_an_emptied_subpackage_is_no_obstacle(tmp_path):
    copy = tmp_path / "copy"
    for path in [*ROOT.glob("*.py"), *ROOT.glob("plumbline/**/*.py")]:
        if "llm" not in path.parts and path.name != "corpus_pipeline.py":
            target = copy / path.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(path.read_bytes())
    code = "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op')] and 'pipeline' not in e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
        (copy / "plumbline" / "llm" / "__pycache__").mkdir(parents=True, exist_ok=True)
