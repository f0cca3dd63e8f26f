import zlib

import numpy as np
import pyarrow as pa

from plumbline.llm import op05_quality_classifier as op


def test_dual_coordinate_descent_meets_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    y = np.where(x @ [1, -2, 0.5, 0] + 0.3 * rng.normal(size=60) > 0, 1, -1)
    w, alpha, gaps = op.dual_coordinate_descent([(np.arange(4), row) for row in x], y, 4, np.full(60, 0.5), epochs=2000, gap=1e-9)
    assert gaps[-1] <= 1e-9 < gaps[0]
    assert ((alpha >= 0) & (alpha <= 0.5)).all() and np.allclose(w, (alpha * y) @ x)
    primal = lambda v: v @ v / 2 + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    best = primal(w)
    assert all(primal(w + rng.normal(size=4) * s) >= best - 1e-6 for s in (0.3, 0.03, 0.003) for _ in range(200))


def test_fit_against_plain_python(spark):
    """Ratios, the joint optimum, interpolation and margins, row by row with dictionaries."""
    docs, labels = _frames(spark)
    rows = {r.doc_id: r.text for r in docs.where("text IS NOT NULL AND doc_id < 400").collect()}
    marks = {}
    for r in labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").collect():
        if r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 5:
            marks[r.doc_id] = min(marks.get(r.doc_id, 1), r.quality)
    sample = op._sample(docs, labels, "doc_id", "text", "quality", op.SAMPLE_ROWS)
    places = {i: sorted(set(op.features(pa.array([rows[i]]))[0].tolist())) for i in marks}
    back = {tuple(np.frombuffer(r.places, np.int32)) for r in sample.where("kept_back").collect()}
    train = [i for i in marks if tuple(places[i]) not in back]
    assert len(train) + sample.where("kept_back").count() == len(marks)
    counts = [{}, {}]
    for i in train:
        for p in places[i]:
            counts[marks[i]][p] = counts[marks[i]].get(p, 0) + 1
    totals = [sum(c.values()) + op.PLACES for c in counts]
    ratio = lambda p: np.log((counts[1].get(p, 0) + 1) / totals[1]) - np.log((counts[0].get(p, 0) + 1) / totals[0])
    x = {}
    for i in train:
        r = np.array([ratio(p) for p in places[i]])
        x[i] = dict(zip(places[i], r / np.sqrt(r @ r), strict=True)) | {-1: 1.0}
    ones = sum(marks[i] for i in train)
    cost = {1: len(train) / (2 * ones), 0: len(train) / (2 * (len(train) - ones))}
    w, alpha, y = {}, dict.fromkeys(train, 0.0), {i: 2 * marks[i] - 1 for i in train}
    rng = np.random.default_rng(5)
    for _ in range(150):
        for i in rng.permutation(train).tolist():
            g = y[i] * sum(v * w.get(p, 0.0) for p, v in x[i].items()) - 1
            new = min(max(alpha[i] - g / sum(v * v for v in x[i].values()), 0.0), cost[marks[i]])
            for p, v in x[i].items():
                w[p] = w.get(p, 0.0) + (new - alpha[i]) * y[i] * v
            alpha[i] = new
    objective = lambda w: sum(v * v for v in w.values()) / 2 + sum(cost[marks[i]] * max(0.0, 1 - y[i] * sum(v * w.get(p, 0.0) for p, v in x[i].items())) for i in train)
    ratios = np.array([ratio(p) for p in range(op.PLACES)])
    got, gaps = op.solved(sample, ratios, np.array([cost[0], cost[1]]))
    assert gaps[-1] <= op.GAP
    joint = {p: got[p] for p in np.flatnonzero(got[:-1])} | {-1: got[-1]}
    assert objective(w) <= objective(joint) * (1 + 1e-4) <= objective(w) * (1 + op.GAP) * (1 + 1e-3)
    model = op.fit(docs, labels)
    assert np.allclose(model.ratios, ratios)
    mean = sum(abs(got[:-1])) / op.PLACES
    for i in train[:40]:
        want = sum(v * ((1 - op.INTERPOLATION) * mean + op.INTERPOLATION * got[p]) for p, v in x[i].items() if p >= 0) + got[-1]
        assert abs(model.margins(np.array(places[i], np.int32), np.array([0, len(places[i])]))[0] - want) < 1e-6


def test_log_count_ratios():
    r = op.log_count_ratios(np.array([9.0, 0.0, 4.0]), np.array([0.0, 9.0, 4.0]))
    assert r[0] == -r[1] > 0 and r[2] == 0


def test_sigmoid_orders_and_centres():
    m = np.linspace(-2, 2, 200)
    a, b = op.fit_sigmoid(m, (m > 0.5).astype(int))
    assert a > 0 and abs(-b / a - 0.5) < 0.1


def test_features_do_not_depend_on_neighbours():
    texts = ["one two three three three", None, "", "ÄÖ *** !!!", "x" * 50_000]
    places, bounds = op.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own, _ = op.features(pa.array([t], pa.string()))
        assert (places[bounds[i] : bounds[i + 1]] == own).all()
    assert bounds[2] == bounds[1] == bounds[3]


def _frames(spark, n=400):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choice(vocabulary, 40)) + ("" if i % 3 else " ### $$$ ***"), "clash", 1) for i in range(n)]
    labels = [(i, int(i % 3 > 0)) for i in range(n)] + [(None, 1), (5, None), (n + 9, 1), (7, 1)]
    return spark.createDataFrame([*docs, (None, None, "c", 1), (n, "", "c", 1), (n, "", "c", 1)], "doc_id long, text string, score string, predicted int"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learns_and_handles_edges(spark):
    docs, labels = _frames(spark)
    got = op.score(docs, op.fit(docs, labels)).collect()
    assert len(got) == 403
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= op.THRESHOLD)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    out = [(r.score > 0.5) == (r.doc_id % 3 > 0) for r in got if r.held_out and r.doc_id < 400]
    assert np.mean(out) > 0.95
    assert op.score(docs.limit(0), op.fit(docs, labels)).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs, labels = _frames(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = op.fit(docs, labels), op.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.offset) == (b.slope, b.offset)


def test_missing_classes(spark):
    docs, labels = _frames(spark, 20)
    assert {r.score for r in op.score(docs, op.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {round(r.score, 6) for r in op.score(docs, op.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}


def test_held_out_accuracy_of_the_query(spark):
    got = op.op5_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
