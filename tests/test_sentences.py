"""Boundaries learnt by Spark against a plain version of the published method, and on texts whose sentences are known."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline import queries_metrics
from plumbline.operators import constraints, sentences

DIR = "/root/testdata/sf0.001"

CLOSE, OPEN = "\"'”’»)]}", "\"'“‘«([{¿¡"


def annotate(text):
    out = []
    for word in (text or "").split():
        core = word.lstrip(OPEN).rstrip(CLOSE)
        plain = core.rstrip(".,;:!?…").lower()
        kind = "##" if re.fullmatch(r"[-+]?[\d.,]*\d", plain) else plain
        out.append({"type": kind, "stop": core.endswith(".") and not core.endswith(".."), "mark": core.endswith(("!", "?", "…", "..")), "upper": core[:1].isupper(), "lower": core[:1].islower(), "initial": len(core) == 2 and core[0].isalpha() and core[1] == "."})
    return out


def log_l(k, n, p):
    return (k * math.log(p) if k > 0 else 0) + ((n - k) * math.log(1 - p) if n - k > 0 else 0)


def association(both, first, second, total):
    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    return 2 * (log_l(both, first, p1) + log_l(second - both, total - first, p2) - log_l(both, first, p) - log_l(second - both, total - first, p))


def learn(texts):
    docs = [annotate(t) for t in texts]
    n, k = Counter(), Counter()
    for ws in docs:
        for w in ws:
            if w["type"]:
                n[w["type"]] += 1
                k[w["type"]] += w["stop"]
    total, stops = sum(n.values()), sum(k.values())
    short = set()
    for t in n:
        if k[t] and t != "##" and re.search(r"[^\W\d_]", t) and stops < total:
            letters = len(t) - t.count(".")
            ratio = -2 * (k[t] * math.log(stops / total) + (n[t] - k[t]) * math.log(1 - stops / total) - k[t] * math.log(0.99) - (n[t] - k[t]) * math.log(0.01))
            if ratio * math.exp(-letters) * (t.count(".") + 1) * letters ** -(n[t] - k[t]) >= 0.3:
                short.add(t)
    after, lower, within, pairs = Counter(), set(), set(), Counter()
    for ws in docs:
        for i, w in enumerate(ws):
            before = ws[i - 1] if i else None
            following = ws[i + 1] if i + 1 < len(ws) else None
            if not w["type"]:
                continue
            after[w["type"]] += bool(before and (before["mark"] or (before["stop"] and before["type"] not in short and not before["initial"] and before["type"] != "##")))
            if w["lower"]:
                lower.add(w["type"])
            if w["upper"] and before and not before["mark"] and not before["stop"]:
                within.add(w["type"])
            if w["stop"] and following and following["type"] and (w["type"] in short or w["initial"] or w["type"] == "##"):
                pairs[w["type"], following["type"]] += 1
    ends = sum(after.values())
    starters = {t for t in n if after[t] and after[t] / ends > n[t] / total and association(after[t], ends, n[t], total) >= 30}
    found = {f"{a} {b}" for (a, b), c in pairs.items() if c > 1 and c * total > k[a] * n[b] and association(c, k[a], n[b], total) >= 7.88 and b not in starters}
    return short, found, starters, {t for t in lower - within if n[t] > 1}


def count(text, model):
    short, pairs, starters, lower = model
    ws, total = annotate(text), 0
    for i, w in enumerate(ws):
        if i + 1 == len(ws):
            total += 1
            continue
        after = ws[i + 1]
        if w["mark"]:
            total += not after["lower"]
        elif w["stop"]:
            if f"{w['type']} {after['type']}" in pairs:
                continue
            if w["type"] in short or w["initial"]:
                total += not w["initial"] and after["upper"] and (after["type"] in starters or after["type"] in lower)
            elif w["type"] == "##":
                total += not after["lower"]
            else:
                total += 1
    return total


NAMES = ["Smith", "Jones", "Brown", "Miller", "Olsen"]
FILLER = ["tree", "house", "walks", "slowly", "under", "green", "water", "often", "sees", "bright", "stone", "river", "cloud", "finds", "never"]


def corpus(rng, n):
    """Texts and their numbers of sentences: names after titles, initials and dates hold stops that end nothing."""
    for _ in range(n):
        made = []
        for _ in range(rng.randrange(1, 12)):
            words = [rng.choice(FILLER) for _ in range(rng.randrange(4, 12))]
            words[0] = rng.choice(["The", "However", "Then"]) if rng.random() < 0.8 else words[0].capitalize()
            for _ in range(rng.randrange(3)):
                words.insert(rng.randrange(1, len(words)), rng.choice([f"Dr. {rng.choice(NAMES)}", f"Mr. {rng.choice(NAMES)}", "e.g. water", f"J. {rng.choice(NAMES)}", "about 3. place", "\"etc.\" and"]))
            made.append(" ".join(words) + rng.choice([".", ".", ".", "!", "?", ".\"", "..."]))
        yield rng.choice([" ", "\n"]).join(made), len(made)


@pytest.fixture(scope="module")
def learnt(spark):
    texts = list(corpus(random.Random(8), 400))
    df = spark.createDataFrame([(t, "clash") for t, _ in texts] + [(None, ""), ("", ""), ("  ", "")], "text string, type string").repartition(5)
    return texts, sentences.learn(df)


def test_lists_are_those_of_the_plain_version(learnt):
    texts, got = learnt
    short, pairs, starters, lower = learn([t for t, _ in texts])
    assert (got.abbreviations, got.collocations, got.starters, got.lower) == (short, pairs, starters, lower)
    assert {"dr", "mr", "e.g"} <= got.abbreviations and {"the", "however", "then"} <= got.starters and not got.abbreviations & set(FILLER)


def test_counts(spark, learnt):
    texts, got = learnt
    fresh = list(corpus(random.Random(9), 300)) + [("", 0), ("   \n", 0), (None, 0), ("one", 1), ("Dr. Smith walks. " * 3000, 3000), ("x" * 100_000, 1)]
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(fresh)], "i int, text string, n int")
    rows = df.select("i", "text", "n", got.count(df.text).alias("got"), got.sentences(df.text).alias("parts")).collect()
    model = (got.abbreviations, got.collocations, got.starters, got.lower)
    for r in rows:
        assert r.got == count(r.text, model) == len(r.parts)
        assert " ".join(r.parts) == " ".join((r.text or "").split())
    right = sum(r.got == r.n for r in rows) / len(rows)
    naive = sum(len([s for s in re.split(r"(?<=[.!?])\s+", r.text or "") if s.strip()]) == r.n for r in rows) / len(rows)
    assert right > 0.9 and right > naive + 0.4


def test_constraint_takes_the_learnt_boundaries(spark, learnt):
    df = spark.createDataFrame([("Dr. Smith walks slowly.",)], "x string")
    for boundaries, want in ((None, False), (learnt[1], True)):
        name, arguments = constraints.by_id("length_constraints:number_sentences", {"relation": "less than", "num_sentences": 2}, boundaries)
        assert df.select(constraints.met(df.x, name, **arguments)).head()[0] is want


def test_empty_corpus(spark):
    got = sentences.learn(spark.createDataFrame([], "text string"))
    df = spark.createDataFrame([("A bee. C d",)], "x string")
    assert df.select(got.count(df.x)).head()[0] == 2


def test_counts_by_joins_where_lists_are_long(spark, learnt, monkeypatch):
    texts, got = learnt
    monkeypatch.setattr(sentences, "MOST_ENTRIES", 5)
    fresh = [t for t, _ in texts[:100]] + [t for t, _ in corpus(random.Random(10), 100)] + ["", " \n", None, "one", "one", "No. (3. \"Tree\" 4. tree) J. Tree, J. The", "Wait... \"The\" ? (the) . Dr.", "j,. Smith. Smith", "Dr.  \n The \t tree", "Mr. Smith. " * 2000]
    df = spark.createDataFrame(list(enumerate(fresh)), "i int, text string").repartition(3)
    counts = sentences.Boundaries(got.firsts, got.pairs, got.heads).counted(df.select(F.lit(1).alias("same"), "i", "text"), ["same", "i"])
    model = learn([t for t, _ in texts])
    assert sorted((r.i, r.n_sentences) for r in counts.collect()) == [(i, count(t, model)) for i, t in enumerate(fresh)]
    # Rows that are alike stay apart.
    assert [r.n for r in sentences.Boundaries(got.firsts, got.pairs, got.heads).counted(spark.createDataFrame([("A bee. C",)] * 3, "text string"), [], n="n").collect()] == [2, 2, 2]
    with pytest.raises(ValueError, match="more than 5"):
        sentences.Boundaries(got.firsts, got.pairs, got.heads).count(df.text)


def test_query_has_no_longest_list(spark, monkeypatch):
    monkeypatch.setattr(sentences, "MOST_ENTRIES", 5)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    model = learn([r.text for r in docs])
    want = {(r.doc_id, count(r.text, model)) for r in docs}
    rows = queries_metrics.sentence_counts(spark, DIR).collect()
    assert {(r.doc_id, r.n_sentences) for r in rows} == want and len(rows) == len(docs)
    assert all(r.at_least_10 is (r.n_sentences >= 10) for r in rows)
