"""Quality classifier: naive Bayes support vectors.

A text becomes a set of n-gram indicators: word unigrams and bigrams, runs of one
word repeated, and 4-grams of character classes, all hashed into ``2 ** HASH_BITS``
places.  Each place is scaled by its class log-count ratio, each text to unit length,
and a linear model with hinge loss is fitted by dual coordinate descent.

Fitting takes at most ``SAMPLE_ROWS`` labelled rows, those of least hash of their id.
One task solves their dual, until the duality gap, which bounds the distance from the
optimum, is ``GAP`` of the objective, or for ``EPOCHS``: the sample's size is fixed, whatever
the corpus has, and its indicators are some hundred megabytes.  A share of the sample is
kept back to turn margins into probabilities.  The driver holds vectors of the hashed
size, and a margin for each row kept back.
Scoring is one pass over the documents, without a shuffle.

Edge cases: a null or empty text has no indicators and gets the score of the bias;
labels without an id or a value are left out, and of repeated ones the least value
counts; where the labelled rows lack a class, every score is the share of label 1,
or 0.5 without labelled rows; repeated documents and null ids are scored row by row
(a null id is not held out); an empty table gives an empty result; other columns of
either table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import kernels
from plumbline.llm.common import map_arrow, table, written
from plumbline.llm.kernels import U64, mix

HASH_BITS = 18
PLACES = 1 << HASH_BITS
SAMPLE_ROWS = 16_000
#: One row in so many is kept back.
KEPT_BACK = 5
FOLDS = 5
THRESHOLD = 0.3
COST = 1.0
#: The most passes over the sample, and the duality gap to reach, relative to the objective.
EPOCHS, GAP = 60, 0.01
#: Share of the model's own weights against their mean size, as in the published method.
INTERPOLATION = 0.25


def _classes() -> np.ndarray:
    """Sixteen classes of bytes: white space, letters, digits and kinds of marks."""
    out = np.full(256, 14, np.uint16)
    out[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
    out[0x0A] = 1
    out[ord("a") : ord("z") + 1] = 2
    out[0x80:] = 2
    out[ord("A") : ord("Z") + 1] = 3
    out[ord("0") : ord("9") + 1] = 4
    for k, marks in enumerate([".,;:", "!?", "#", "*", "$", "%", "&", "|", "<>"], 5):
        out[[ord(c) for c in marks]] = k
    out[[ord("'"), ord('"'), ord("-")]] = 15
    return out


_CLASS = _classes()


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of every text's indicators, each once and ascending, and the bounds of the texts."""
    data, offsets = kernels.text_bytes(texts)
    starts, _, h = kernels.words(data, offsets)
    bounds = kernels.word_bounds(offsets, starts)
    pairs, pair_bounds = kernels.shingles(h, bounds, 2, short=False)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1 if len(h) else np.zeros(0, np.int64)
    thrice = same[1:][np.diff(same) == 1] if len(same) else same
    shift = U64(64 - HASH_BITS)
    parts = [
        (doc, (h >> shift).astype(np.int64)),
        (np.repeat(np.arange(n), np.diff(pair_bounds)), (pairs >> shift).astype(np.int64)),
        (doc[same], np.full(len(same), 1)),
        (doc[thrice], np.full(len(thrice), 2)),
    ]
    seen = np.zeros(1 << 16, bool)
    place = (mix(np.arange(1 << 16, dtype=U64) + U64(0xC1A55)) >> shift).astype(np.int64)
    for i in range(n):
        c = _CLASS[data[offsets[i] : offsets[i + 1]]]
        if len(c) >= 4:
            seen[(c[:-3] << 12) | (c[1:-2] << 8) | (c[2:-1] << 4) | c[3:]] = True
            own = np.flatnonzero(seen)
            seen[own] = False
            parts.append((np.full(len(own), i), place[own]))
    key = np.unique(np.concatenate([(d.astype(np.int64) << HASH_BITS) | p for d, p in parts]))
    return (key & (PLACES - 1)).astype(np.int32), np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << HASH_BITS)


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margins(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Margin of each text: the scaled indicators at unit length against the weights, and the bias."""
        n = len(bounds) - 1
        doc = np.repeat(np.arange(n), np.diff(bounds))
        r = self.ratios[places]
        dot = np.bincount(doc, r * self.weights[places], n)
        length = np.sqrt(np.bincount(doc, r * r, n))
        return np.divide(dot, length, out=np.zeros(n), where=length > 0) + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(*features(texts)) + self.offset, -500, 500)))


def log_count_ratios(in_class: np.ndarray, in_other: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of a place in one class against the other."""
    p, q = in_class + 1.0, in_other + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = EPOCHS, gap: float = GAP, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Weights and dual variables of the L1-loss support vector machine, and the relative duality gap after each epoch.

    One dual variable at a time, in a fresh random order each epoch.
    """
    w, alpha, gaps = np.zeros(size), np.zeros(len(rows)), []
    norm = np.array([float(x @ x) for _, x in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            new = min(max(alpha[i] - (y[i] * (w[at] @ x) - 1) / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
        loss = sum(c * max(0.0, 1 - t * float(w[at] @ x)) for (at, x), t, c in zip(rows, y, cost, strict=True))
        objective = w @ w / 2 + loss
        gaps.append(float((objective + w @ w / 2 - alpha.sum()) / objective))
        if gaps[-1] <= gap:
            break
    return w, alpha, gaps


def fit_sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton's method on softened targets; the slope is positive."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, s = p - t, np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(d * margins).sum() + 1e-3 * (a - 1), d.sum()])
        hessian = np.array([[(s * margins * margins).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def held_out(id_col: Column | str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")) if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents as indicators: ``kept_back``, ``y``, ``key`` (to order rows by), ``places``."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) > 0).alias("_y"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    back = F.pmod(F.xxhash64(F.lit("kept back"), F.col("_id")), F.lit(KEPT_BACK)) == 0
    docs = docs.select(back.alias("kept_back"), F.col("_y").alias("y"), F.xxhash64("_id").alias("key"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, bounds = features(batch.column(3))
            packed = [places[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["kept_back", "y", "key", "places"])

    return written(map_arrow(docs, run, "kept_back boolean, y boolean, key long, places binary"), "classifier-sample")


def _rows_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.int32) for x in column]


def _class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class that have a place, summed task by task and then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, PLACES))
        for batch in batches:
            for y, places in zip(batch.column(0).to_pylist(), _rows_of(batch.column(1)), strict=True):
                counts[int(y)][places] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["place", "zeros", "ones"])

    total = map_arrow(sample.where("NOT kept_back").select("y", "places"), run, "place long, zeros double, ones double").groupBy("place").agg(F.sum("zeros"), F.sum("ones")).toArrow()
    counts = np.zeros((2, PLACES))
    for k in (0, 1):
        counts[k][total.column(0).to_numpy()] = total.column(k + 1).to_numpy()
    return counts[0], counts[1]


def scaled(places: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row's places and values at unit length, and one more place for the bias."""
    x = ratios[places]
    return np.append(places, PLACES).astype(np.int32), np.append(x / (np.sqrt(x @ x) or 1.0), 1.0).astype(np.float32)


def solved(sample: DataFrame, ratios: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Weights (the bias last) of the sample's support vector machine, and the relative duality gap after each epoch."""
    sent = sample.sparkSession.sparkContext.broadcast(ratios)

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("places", "ascending")])
        y = np.array(rows.column("y").to_pylist(), int)
        own = [scaled(places, sent.value) for places in _rows_of(rows.column("places").combine_chunks())]
        w, _, gaps = dual_coordinate_descent(own, 2 * y - 1, PLACES + 1, cost[y])
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "gaps": pa.array([gaps], pa.list_(pa.float64()))})

    one = sample.where("NOT kept_back").select(F.lit(0).alias("sample"), "y", "key", "places")
    found = one.groupBy("sample").applyInArrow(solve, "w binary, gaps array<double>").head()
    return np.frombuffer(found.w), list(found.gaps)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    sample = _sample(df, labels, id_col, text_col, label_col, rows)
    zeros, ones = sample.where("NOT kept_back").agg(F.count_if(~F.col("y")), F.count_if("y")).head()
    if not zeros or not ones:
        share = 0.5 if not zeros + ones else float(ones > 0)
        return Model(np.zeros(PLACES), np.zeros(PLACES), 0.0, 1.0, {0.0: -500.0, 0.5: 0.0, 1.0: 500.0}[share])
    counts = _class_counts(sample)
    ratios = log_count_ratios(counts[1], counts[0])
    w = solved(sample, ratios, np.array([COST * (zeros + ones) / (2 * zeros), COST * (zeros + ones) / (2 * ones)]))[0]
    own, bias = w[:PLACES], float(w[PLACES])
    model = Model(ratios, (1 - INTERPOLATION) * np.abs(own).mean() + INTERPOLATION * own, bias, 1.0, 0.0)
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _rows_of(batch.column(1))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.margins(np.concatenate([*own, np.zeros(0, np.int32)]), bounds))], names=["y", "margin"])

    back = map_arrow(sample.where("kept_back").select("y", "places"), margins, "y boolean, margin double").toArrow()
    if len(back):
        model.slope, model.offset = fit_sigmoid(back.column(1).to_numpy(), np.array(back.column(0).to_pylist(), int))
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    rows = df.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    return map_arrow(rows, run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
