import random
import re
from itertools import permutations

from plumbline.llm import op11_filter_audit as op


def plain(docs, labels):
    """(id, text, part) and (id, quality, toxic) -> rows of the audit, by walking every order over the documents."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        parts.setdefault(part or "", []).append((i, fails))
    out = {}
    for part, rows in parts.items():
        in_all = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            here = rows
            for step, f in enumerate(order, 1):
                gone, here = [r for r in here if r[1][f]], [r for r in here if not r[1][f]]
                before = order[: step - 1]
                in_all[f] += len(gone)
                out[part, "".join(order), step] = [len(here), len(gone), sum(x[f] and any(x[b] for b in before) for _, x in rows), sum(x[f] and sum(x.values()) == 1 for _, x in rows), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(in_all[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def texts(rng, n):
    for _ in range(n):
        words = [rng.choice(["a", "B", "word", "SHOUT", "x$", "é", "ß#"]) if rng.random() < 0.4 else f"w{rng.randrange(10**6)}" for _ in range(rng.choice([0, 5, 99, 100, 101, 150]))]
        yield rng.choice([" ", "\n", "  ", "\t"]).join(words)


def check(spark, docs, labels, partitions=3):
    d = spark.createDataFrame([(*r, 5, "x") for r in docs], "doc_id long, text string, lang string, mask int, part string").repartition(partitions)
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = op.audit(op.cells(d, l)).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows) and got == plain(docs, labels)
    return rows


def test_against_every_order_walked(spark):
    rng = random.Random(11)
    own = list(texts(rng, 60))
    docs = [(i, rng.choice(own) if rng.random() < 0.6 else next(texts(rng, 1)), rng.choice(["en", "de", None, ""])) for i in rng.sample(range(10**6), 250)]
    docs += [(10**7, "y " * 50_000, "en"), (10**7 + 1, "Y" * 300_000, "xx"), (10**7 + 2, None, "en"), (10**7 + 3, None, None), (10**7 + 4, "", "de")]
    docs += [docs[3], docs[3], (docs[4][0], docs[4][1], "other"), (docs[5][0], "another text of one id", "en"), (None, docs[6][1], "en"), (None, docs[6][1], "de"), (None, "alone", "en"), (None, "alone", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rng.sample(docs, 150)] + [(docs[0][0], 1, 0), (docs[0][0], 0, 1), (-5, 1, 1), (None, 1, 1)]
    rows = check(spark, docs, labels)
    assert {r.part for r in rows} == {"", "en", "de", "xx", "other"}
    by_order = {}
    for r in rows:
        by_order.setdefault((r.part, r.filter_order), []).append(r)
    for steps in by_order.values():
        steps.sort(key=lambda r: r.step)
        assert all(a.kept == b.kept + b.removed for a, b in zip(steps, steps[1:]))


def test_one_text_of_all_documents_and_empty_tables(spark):
    check(spark, [(i, "same text", "en" if i % 3 else "de") for i in range(3000, 0, -1)], [(1, 1, 1), (2, 1, 0)], 7)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.audit(op.cells(none, labels)).count() == 0
    check(spark, [(7, "x", None)], [])


def test_native_and_no_join_on_texts(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    plan = op.audit(op.cells(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Join") == 1
