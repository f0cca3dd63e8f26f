import pytest
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions import text as T
from plumbline.operators import curation as C
from plumbline.operators import serving as S


def test_columns_and_choices(spark):
    df = spark.createDataFrame([("q", "t", 1)], "input string, text string, n int")
    assert C.standardised(df, {"input": "text"}).columns == ["text", "n"]
    with pytest.raises(ValueError, match="missing"):
        C.standardised(df, {"nope": "text"})
    with pytest.raises(ValueError, match="missing"):
        C.require_columns(df, ["label"])
    rows = spark.createDataFrame([("x", "no"), ("x", "1"), ("x", "B"), ("x", "7"), ("x", None)], "q string, label string").withColumn("c", F.array(F.lit("yes"), F.lit("no")))
    assert [r[0] for r in rows.select(C.choice_letter(F.col("label"), F.col("c"))).collect()] == ["b", "b", "b", None, None]
    assert [r[0] for r in rows.select(C.mapped("label", {"no": "n"}, "same")).collect()] == ["n", "1", "B", "7", None]


def test_filters(spark):
    df = spark.createDataFrame([("a b a c a",), ("",), (None,), ("x\ty\nx",)], "t string")
    assert [r[0] for r in df.select(C.more_often_than(F.col("t"), 2)).collect()] == [True, False, None, False]
    assert [r[0] for r in df.select(C.more_often_than(F.col("t"), 1)).collect()] == [True, False, None, True]
    assert C.not_repetitive(df, "t", 2).count() == 2 and C.non_empty(df, "t").count() == 2 and C.length_between(df, "t", 5, 9).count() == 2
    options = spark.createDataFrame([(["aa", "bb"],), (["a", "bb"],), (["x x x", "bb"],)], "o array<string>")
    assert C.options_between(options, "o", 2, 9, 2).count() == 1
    answers = spark.createDataFrame([((["a"], [0]),), (([""], [0]),), (([], []),)], "answers struct<text:array<string>,answer_start:array<int>>")
    assert C.answerable(answers).count() == 1


def test_samples_and_splits(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, "big").when(F.col("id") < 990, "mid").alias("label")).repartition(7)
    split = C.stratified_split(df, "label", "id", {"train": 50, "val": 20, "test": 30})
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {("big", "train"): 350, ("big", "val"): 140, ("big", "test"): 210, ("mid", "train"): 145, ("mid", "val"): 58, ("mid", "test"): 87, (None, "train"): 5, (None, "val"): 2, (None, "test"): 3}
    assert sorted(map(tuple, split.collect()), key=str) == sorted(map(tuple, C.stratified_split(df.repartition(2), "label", "id", {"train": 50, "val": 20, "test": 30}).collect()), key=str)
    assert {r.label: r["count"] for r in C.balanced(df, "label", "id").groupBy("label").count().collect()} == {"big": 290, "mid": 290}
    fixed = C.fixed_split(df, "id", {"train": 64, "val": 32}).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in fixed} == {"train": 64, "val": 32}
    assert C.exact_sample(df, 10, "id").count() == 10 and C.exact_sample(df.limit(3), 10, "id").count() == 3
    assert C.adaptive_sizes(5000) == {"train": 1024, "val": 256, "test": 2048} and C.adaptive_sizes(1600) == {"train": 1024, "val": 256, "test": 256} and C.adaptive_sizes(200) == {"train": 64, "val": 32, "test": 104}
    index = C.bootstrap_indices(spark, 50, 4)
    assert index.count() == 200 and index.where("index < 0 OR index >= 50").count() == 0
    parts = C.without_overlap({"test": spark.createDataFrame([("a",), ("c",)], "text string"), "train": spark.createDataFrame([("a",), ("b",)], "text string")})
    assert sorted(r.text for r in parts["test"].collect()) == ["c"]
    shots = C.few_shot(spark.createDataFrame([(i, f"t{i % 9}", "ab"[i % 2]) for i in range(30)], "id int, text string, label string"), ["a", "b"], 6, "id").orderBy("turn").collect()
    assert [r.label for r in shots] == ["a", "b"] * 3 and len({r.text for r in shots}) == 6
    with pytest.raises(ValueError, match="not enough"):
        C.few_shot(spark.createDataFrame([(1, "x" * 9000, "a")], "id int, text string, label string"), ["a"], 1, "id")


def test_labels_offsets_and_tags(spark):
    pairs = spark.createDataFrame([(1, None), (None, None), (0, 0), (1, 0), (-1, 0), (1, -1)], "a int, b int")
    assert [r[0] for r in pairs.select(C.merged_ternary(F.col("a"), F.col("b"))).collect()] == ["positive", None, "neutral", "positive", "negative", None]
    one = spark.createDataFrame([(["cat", "dog"], "a cat", ["-", "F", "F", "-", "F"], [0, 4, 8], [3, 7, 12], [(0, 7, "PER")])], "a array<string>, c string, f array<string>, s array<int>, e array<int>, ents array<struct<start:int,end:int,label:string>>")
    r = one.select(C.answer_starts(F.col("a"), F.col("c")), C.runs_to_bio(F.col("f")), C.spans_to_bio(F.col("s"), F.col("e"), F.col("ents"))).head()
    assert [tuple(x) for x in r[0]] == [("cat", 2)] and r[1] == ["O", "B-ERR", "I-ERR", "O", "B-ERR"] and r[2] == ["B-PER", "I-PER", "O"]
    w = C.windows(spark.createDataFrame([(1, list("abcdefgh")), (2, ["x"])], "i int, t array<string>"), "t", 4, 2).orderBy("i", "start").collect()
    assert [("".join(r.window), r.start) for r in w] == [("abcd", 0), ("cdef", 2), ("efgh", 4), ("x", 0)]
    p = spark.createDataFrame([([None, 0, 0, 1, None], [5, 6])], "w array<int>, l array<int>")
    assert p.select(C.first_piece_labels(F.col("w"), F.col("w"), F.col("l"))).head()[0] == [-100, 5, -100, 6, -100]
    q = C.normalised_questions(spark.createDataFrame([(2, " Who? "), (1, "Who?.."), (3, "x.")], "i int, q string"), "q", "i")
    assert sorted(map(tuple, q.collect())) == [(1, "Who?"), (3, "x")]
    flat = spark.createDataFrame([("q", 2, "b", 0), ("q", 1, "a", 1)], "q string, o int, c string, l int")
    assert [x.c for x in C.regrouped_choices(flat, "q", "c", "o", "l").head().options] == ["a", "b"]


def test_generated_labels(spark):
    assert L.weighted_distance("abc", "ac", 1000, 1, 1000) == 1 and L.weighted_distance("ac", "abc", 1000, 1, 1000) == 1000
    df = spark.createDataFrame([("I say \\boxed{Negative}",), ("Positive, since",), ("xxneutralxx",), ("qqq",), (None,)], "t string")
    got = L.extracted_label(df, "t", ["positive", "neutral", "negative"]).collect()
    assert [(r.label, r.label_failed) for r in got][:4] == [("negative", False), ("positive", False), ("neutral", False), (got[3].label, True)]
    lp = spark.createDataFrame([("b1", [("pos", -0.1), ("neg", -2.0)]), ("b1", [(" ", -0.1), ("Neg", -0.5)]), ("b2", [("n", -0.1)])], "batch string, lp array<struct<token:string,logprob:double>>")
    assert sorted((r.batch, str(r.label)) for r in L.labels_from_logprobs(lp, "lp", ["positive", "neutral", "negative"], ["batch"]).collect()) == [("b1", "negative"), ("b1", "positive"), ("b2", "None")]
    t = spark.createDataFrame([(["Bo", "Li", "in", "Rome"], ["b-per", "i-per", "o", "b-loc"], '{"loc": ["rome"], "per": ["bo li"]}')], "w array<string>, t array<string>, j string")
    r = t.select(L.tags_to_json(F.col("w"), F.col("t"), ["per", "loc"]).alias("a"), L.json_to_tags(F.col("w"), F.col("j"), ["per", "loc"]).alias("b"), L.known_tags(F.col("t"), ["per", "misc"]).alias("c")).head()
    assert r.a == '{"per": ["Bo Li"], "loc": ["Rome"]}' and r.b == ["b-per", "i-per", "o", "b-loc"] and r.c == ["b-per", "i-per", "o", "b-misc"]
    p = spark.createDataFrame([("Why?\nMore\nChoices:\na. x\nb. y", "abcdefghij", [(6, 8), (1, 3), (3, 4)])], "p string, s string, spans array<struct<start:int,end:int>>")
    r = p.select(L.question_and_choices(F.col("p")).alias("q"), L.tagged(F.col("s"), F.col("spans"), "h").alias("t"), L.choice_text(F.lit("B"), F.array(F.lit("x"), F.lit("y"))).alias("c")).head()
    assert r.q.question == "Why?\nMore" and r.q.choices == ["x", "y"] and r.t == "a<h>bcd</h>ef<h>gh</h>ij" and r.c == "y"
    assert spark.range(1).select(T.joined_tokens(F.array(*map(F.lit, ["Hi", ",", "you", "(", "two", ")", "!"])))).head()[0] == "Hi, you (two)!"


def test_serving(spark):
    df = spark.createDataFrame([("a", "10"), ("b", "9"), ("c", "-"), ("d", None), ("e", "1,000")], "k string, v string")
    assert [r.k for r in S.sorted_rows(df, "v", "k").collect()][:3] == ["b", "a", "e"]
    assert [r.k for r in S.sorted_rows(df, "v", "k", descending=True).collect()][:3] == ["e", "a", "b"]
    n = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "x double")
    assert n.where(S.in_bucket("x", 1, 5)).count() == 1 and n.where(S.in_bucket("x", None, None)).count() == 2
    assert df.where(S.matches("k", "")).count() == 5 and df.where(S.matches("k", "A zz")).count() == 1
    board = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 5.0), ("x", 2, 4.0), ("x", 3, 4.5), ("x", None, 1.0), ("y", 9, 9.0)], "g string, p int, r double")
    assert sorted((r.g, r.p, r.r) for r in S.pareto(board, ["g"], "p", "r").collect()) == [("x", 1, 5.0), ("x", 2, 4.0), ("y", 9, 9.0)]
    old, new = (spark.createDataFrame(x, "k string, a int, b int") for x in ([("1", 1, None), ("2", 1, 1)], [("1", 1, None), ("3", 1, 1)]))
    assert sorted((r.k, r.change) for r in S.changes(old, new, "k").collect()) == [("2", "removed"), ("3", "added")]
    assert S.schema_changes(old, new.withColumnRenamed("b", "c")) == (["c"], ["b"])
    people = spark.createDataFrame([(["x", "x", "bot"],), (["y"],), (["x"],)], "a array<string>")
    assert [tuple(r) for r in S.contributor_counts(people, "a", ["bot"]).collect()] == [("x", 2), ("y", 1)]
