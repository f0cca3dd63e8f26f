import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import constraints, metrics


def one(df, name):
    return df.head()[name]


def test_classification_against_definitions(spark):
    rng = random.Random(2)
    p, r = [rng.choice("abc") for _ in range(200)], [rng.choice("abcd") for _ in range(200)]
    df = spark.createDataFrame([("g", *x) for x in zip(p, r, strict=True)], "g string, prediction string, reference string")
    labels = sorted(set(p) | set(r))
    c = np.array([[sum(a == x and b == y for a, b in zip(p, r, strict=True)) for y in labels] for x in labels], float)
    tp, pk, tk, s = np.diag(c), c.sum(1), c.sum(0), c.sum()
    assert one(metrics.accuracy(df, ["g"]), "accuracy") == pytest.approx(tp.sum() / s)
    assert one(metrics.macro_f1(df, ["g"]), "macro_f1") == pytest.approx(np.mean(2 * tp / (pk + tk)))
    assert one(metrics.mcc(df, ["g"]), "mcc") == pytest.approx((tp.sum() * s - pk @ tk) / np.sqrt((s * s - pk @ pk) * (s * s - tk @ tk)))
    same = df.withColumn("prediction", F.lit("a"))
    assert one(metrics.mcc(same, ["g"]), "mcc") == 0.0


def test_question_answering(spark):
    rows = [("g", "The  cat!", ["a cat"]), ("g", "dog dog", ["dog"]), ("g", "", []), ("g", "x", []), ("g", "one two", ["zzz", "two three"])]
    got = metrics.question_answering(spark.createDataFrame(rows, "g string, prediction string, answers array<string>"), ["g"]).head()
    assert got.em == pytest.approx(2 / 5) and got.f1 == pytest.approx((1 + 2 / 3 + 1 + 0 + 0.5) / 5)


def test_text_scores():
    assert metrics.rouge_l_score("the cat sat", "the cat") == pytest.approx(0.8)
    assert metrics.rouge_l_score("", "a") == 0.0
    assert metrics.chrf_score("abc", "abc") == pytest.approx(1.0) and metrics.chrf_score("", "") == 1.0 and metrics.chrf_score("abc", "xyz") == 0.0
    assert 0 < metrics.chrf_score("hello there", "hello where") < 1
    assert metrics.sari_score("a b c", "a b c", ["a b c"]) == pytest.approx(1.0)
    assert metrics.sari_score("about 95 species are accepted", "about 95 you now get in", ["about 95 species are known"]) < 0.5


def test_entities(spark):
    assert metrics.bio_chunks(["b-per", "i-per", "o", "i-loc", "b-loc", "i-per"]) == {("per", 0, 1), ("loc", 3, 3), ("loc", 4, 4), ("per", 5, 5)}
    rows = [("g", ["b-per", "o"], ["b-per", "b-misc"]), ("h", ["o"], ["o"])]
    df = spark.createDataFrame(rows, "g string, predicted array<string>, labels array<string>")
    assert {r.g: r.entity_f1 for r in metrics.entity_f1(df, ["g"]).collect()} == {"g": pytest.approx(2 / 3), "h": 1.0}
    assert {r.g: r.entity_f1 for r in metrics.entity_f1(df, ["g"], skip=["misc"]).collect()} == {"g": 1.0, "h": 1.0}


def test_bias_puzzles_tools_bits_judges(spark):
    df = spark.createDataFrame([("g", p, 0, 1, 2) for p in (0, 0, 1, 2, 2, 2, 5)], "g string, prediction int, stereo_idx int, counter_idx int, unknown_idx int")
    r = metrics.bias(df, ["g"]).head()
    assert (r.bias, r.accuracy, r.adjusted) == (pytest.approx(1 / 7), pytest.approx(3 / 7), pytest.approx(2 / 7))
    assert metrics.permuted_cells(json.dumps({"o1": ["a", "b"], "o2": ["c", "d"]}), json.dumps({"o1": ["C", "d"], "o2": ["a", "x"]})) == 0.75
    assert metrics.permuted_cells("no json", "{}") == 0.0
    functions = json.dumps([{"name": "f", "parameters": {"required": ["x"]}}])
    call = lambda **a: json.dumps([{"function": "f", "arguments": a}])
    want = json.dumps([{"f": {"x": [1, 2], "y": ["", "k"]}}])
    assert [metrics.tool_call_right(functions, c, want) for c in (call(x=2), call(x=3), call(y="k"), call(x=1, z=1), "[]", "{")] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    m = spark.createDataFrame([("g", {"a": ["x", "y"]}, {"a": ["x", "z"]}), ("g", {"a": ["q", "r"]}, {"a": ["q", "r"]})], "g string, prediction map<string,array<string>>, reference map<string,array<string>>")
    r = metrics.puzzle_accuracy(m, ["g"]).head()
    assert (r.cell_accuracy, r.puzzle_accuracy) == (0.75, 0.5)
    b = spark.createDataFrame([("g", 1.0), ("g", float("inf")), ("g", float("nan")), ("g", 3.0)], "g string, bpc double")
    assert one(metrics.bits_per_character(b, ["g"]), "bits_per_character") == 2.0
    j = spark.createDataFrame([("g", '{"score": 4}'), ("g", "none"), ("g", '{"score": "2"}')], "g string, answer string")
    assert one(metrics.judge_mean(j, ["g"]), "judge_mean") == 3.0
    assert set(metrics.REGISTRY) >= {"accuracy", "mcc", "macro_f1", "bias", "chrf", "rouge_l", "sari", "entity_f1", "tool_calling"}


def test_spans_votes_gates(spark):
    df = spark.createDataFrame([([0.1, 5.0, 0.2], [4.0, 0.0, 3.0])], "start_logits array<double>, end_logits array<double>")
    span = metrics.best_span(df, 3, 2).head().span
    assert (span.start, span.end) == (1, 2)
    v = spark.createDataFrame([("q", 2), ("q", 1), ("q", 2), ("q", 1), ("q", 9)], "q string, c int")
    assert tuple(metrics.majority_vote(v, ["q"], "c").head()) == ("q", 1, 2)
    g = spark.createDataFrame([({"da": 0.5, "no": 0.25},), ({"da": 0.5, "no": 0.26},)], "c map<string,double>").withColumn("w", F.array(F.lit("da"), F.lit("no"), F.lit("sv")))
    assert [r.gate for r in metrics.language_gate(g, "c", "w").collect()] == [0, 1]
    a = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1.0, float("nan")],)], "a array<double>")
    assert [r[0] for r in a.select(metrics.argmax(F.col("a"))).collect()] == [1, None]
    assert metrics.failed_instances(spark.createDataFrame([("A", "a"), ("b", "a"), (None, "a")], "p string, r string"), "p", "r").count() == 2


@pytest.mark.parametrize(
    ("name", "arguments", "good", "bad"),
    [
        ("case:capital", {}, "ALL CAPS 1", "Not caps"), ("case:lowercase", {}, "all low", "Low"), ("case:capital_words", {"relation": "at least", "n": 2}, "A BIG one", "a Big one"),
        ("format:options", {"options": ["yes", "no"]}, "well, yes", "well"), ("end:phrase", {"phrase": "The End"}, 'so: the end" ', "the end is near"), ("end:quotation", {}, ' "quoted" ', '"half'),
        ("repeat:prompt", {"prompt": "Say this"}, "say this, then more", "this"), ("keywords:forbidden", {"words": ["cat"]}, "concatenate", "a Cat!"), ("keywords:existence", {"words": ["cat", "dog"]}, "Dog and cat", "cat"),
        ("keywords:frequency", {"word": "cat", "relation": "less than", "n": 2}, "cat", "cat Cat"), ("keywords:letter", {"letter": "e", "relation": "at least", "n": 2}, "Ee", "e"), ("format:json", {}, '```json\n{"a": 1}\n```', "{a"),
        ("format:sections", {"mark": "Section", "n": 2}, "Section 1 a Section 2 b", "Section 1 a"), ("length:paragraphs", {"n": 2}, "a\n***\nb", "a"), ("length:nth_paragraph", {"n": 2, "nth": 2, "first": "so"}, "a\n\nSo it is", "so\n\nit is"),
        ("format:bullets", {"n": 2}, "* a\n- b", "* a"), ("format:highlights", {"n": 1}, "an *important* word", "none"), ("format:placeholders", {"n": 2}, "[a] [b]", "[a]"), ("format:title", {}, "<<title>>\nx", "<title>"),
        ("format:postscript", {"mark": "P.S."}, "x\nP.S. y", "x"), ("length:sentences", {"relation": "at least", "n": 2}, "One. Two!", "One."), ("length:words", {"relation": "moins de", "n": 3}, "one two", "one two three"),
        ("punctuation:no_comma", {}, "a b", "a, b"), ("content:no_digits", {}, "a", "a1"), ("content:no_accents", {}, "a", "é"), ("content:letters", {"letters": "œç"}, "oe", "œ"), ("content:informal", {"words": ["tu"]}, "vous statue", "Tu es"),
        ("combination:two_responses", {}, "a\n******\nb", "a\n******\na"),
    ],
)
def test_constraints(spark, name, arguments, good, bad):
    df = spark.createDataFrame([(good,), (bad,), ("  ",)], "x string")
    assert [r[0] for r in df.select(constraints.met(F.col("x"), name, **arguments)).collect()] == [True, False, False]


def test_instruction_accuracy_skips_unknown_names(spark):
    df = spark.createDataFrame([("g", "a, b"), ("g", "a")], "g string, x string")
    assert one(constraints.instruction_accuracy(df, ["g"], "x", [("punctuation:no_comma", {}), ("content:no_digits", {}), ("no:such", {})]), "instruction_accuracy") == 0.75


def test_puzzles_of_many_objects_and_exact_matching():
    right = {f"o{i}": [f"a{i}", f"b{i}"] for i in range(12)}
    moved = {k: right[f"o{(i * 5 + 1) % 12}"] for i, k in enumerate(right)}
    assert metrics.permuted_cells(json.dumps(moved), json.dumps(right)) == 1.0
    rng = random.Random(2)
    for n in range(1, 7):
        for _ in range(20):
            a, b = ([[rng.choice("abcdef") for _ in range(3)] for _ in range(n)] for _ in "ab")
            best = max(sum(len(set(x) & set(y)) for x, y in zip(order, b, strict=True)) for order in itertools.permutations(a))
            assert metrics.permuted_cells(json.dumps(dict(enumerate(a))), json.dumps(dict(enumerate(b)))) == best / (3 * n)
