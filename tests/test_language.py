"""Languages against a plain fit, and on held-out documents."""

import math
import re
from collections import Counter

import pytest

from plumbline import queries_metrics
from plumbline.operators import language

DIR = "/root/testdata/sf0.001"


def buckets(text):
    plain = " " + re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip() + " "
    c = [ord(x) for x in plain] if text is not None else []
    return [((a * 31 + b) * 31 + d) % 4096 for a, b, d in zip(c, c[1:], c[2:])]


def test_scores_equal_a_plain_fit(spark):
    rows = [(1, "en", "The dog runs, the dog sleeps."), (2, "da", "Hunden løber; hunden sover på gulvet"), (3, None, "ignored 漢字"), (4, "en", ""), (5, "da", None), (6, "de", "Der Hund läuft 😀 über die Straße"), (7, "x.y", "a"), (8, "en", "dogs " * 20_000)]
    df = spark.createDataFrame(rows, "id long, lang string, text string")
    model = language.learn(df, "text", "lang")
    assert model.languages == ["da", "de", "en", "x.y"]
    counts = {x: Counter(b for _, lang, t in rows if lang == x for b in buckets(t)) for x in model.languages}
    weight = lambda x, b: round(1000 * math.log((counts[x][b] + 1) / (counts[x].total() + 4096)))
    got = {r.id: r for r in model.scored(df, ["id"], "text").collect()}
    assert len(got) == len(rows)
    for i, _, text in rows:
        bag = buckets(text)
        if not bag:
            assert got[i].language is None and got[i].confidences is None
            continue
        scores = {x: sum(weight(x, b) for b in bag) for x in model.languages}
        top = max(scores.values())
        shares = {x: math.exp((s - top) / 1000) for x, s in scores.items()}
        assert got[i].language == min(x for x in scores if scores[x] == top)
        assert got[i].confidences == pytest.approx({x: s / sum(shares.values()) for x, s in shares.items()}, abs=1e-9)


def test_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    found = [r for r in queries_metrics.detected_languages(spark, DIR).collect() if r.held_out and truth[r.doc_id]]
    by = {x: [r.language == x for r in found if truth[r.doc_id] == x] for x in set(truth.values()) - {None}}
    shares = {x: sum(v) / len(v) for x, v in by.items() if v}
    print(shares)
    assert min(shares.values()) > 0.8


def test_no_language_is_an_error(spark):
    with pytest.raises(ValueError, match="no row"):
        language.learn(spark.createDataFrame([], "text string, lang string"), "text", "lang")


def test_scores_shuffle_nothing_and_make_no_row_for_a_letter(spark):
    df = spark.createDataFrame([(1, "en", "the dog"), (2, "de", "der Hund")], "id long, lang string, text string")
    plan = language.learn(df, "text", "lang").scored(df, ["id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_more_languages_than_a_task_holds_and_texts_longer_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(language, "_LANGUAGES", 2)
    names = [f"l{i}" for i in range(7)]
    rows = [(i, names[i % 7], f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} 𝒜ñ {i} {'dog ' * (300_000 if i == 7 else i % 5)}") for i in range(90)] + [(90, None, "dog"), (91, "l0", None), (92, "l1", " 1 ")]
    df = spark.createDataFrame(rows, "id long, lang string, text string").coalesce(1)
    model = language.learn(df, "text", "lang")
    counts = {x: Counter() for x in names}
    for _, lang, text in rows:
        if lang:
            counts[lang].update(buckets(text))
    weights = {r[0]: r[1] for r in model.weights.collect()}
    assert model.languages == names and len(weights) == 4096
    for i, x in enumerate(names):
        assert all(weights[b][i] == round(1000 * math.log((counts[x][b] + 1) / (counts[x].total() + 4096))) for b in {*counts[x], 0, 4095})
    found = {r.id: r.language for r in model.scored(df, ["id"], "text").collect()}
    assert len(found) == len(rows) and found[91] is None and found[92] is None
    for i, _, text in [*rows[:8], rows[90]]:
        bag = Counter(buckets(text))
        scores = {x: sum(n * weights[b][k] for b, n in bag.items()) for k, x in enumerate(names)}
        assert found[i] == min(x for x in names if scores[x] == max(scores.values()))
