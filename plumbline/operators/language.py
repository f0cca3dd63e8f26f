"""Languages of texts, by the letters that follow each other: learnt from labelled rows and applied in one scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import stored

#: Buckets of three letters in a row; a model is that many numbers for each language, whatever it was learnt from.
BUCKETS = 4096
#: Bytes of text that a task turns into numbers at once (a longer text is alone), and languages it adds up before it gives them on.
_PART_BYTES, _LANGUAGES = 1 << 20, 256


def letters(text: Column) -> Column:
    """The lower-case letters and single spaces of a text; whatever is no letter counts as a space, at the ends too."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch cut into runs of rows with a bounded number of bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PART_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _letter_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of every three code points in a row of all texts joined, and the places from and to which each text's own are."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(x or "" for x in texts.to_pylist()).encode("utf-32-le"), np.uint32)
    # At most 0x10FFFF * 993, which 32 bits hold.
    three = ((codes[:-2] * np.uint32(31) + codes[1:-1]) * np.uint32(31) + codes[2:]) % np.uint32(buckets)
    end = np.cumsum(lengths)
    start = end - lengths
    return three.astype(np.int64), start, np.maximum(start, end - 2)


@dataclass(frozen=True)
class LanguageModel:
    """Thousandths of log likelihoods for each bucket: whole numbers, so that sums do not depend on their order."""

    languages: list[str]
    weights: DataFrame
    buckets: int = BUCKETS

    def scored(self, df: DataFrame, key: list[str], text: str) -> DataFrame:
        """``key`` (unique) of every row with ``language``, ``confidence`` of it, and ``confidences`` by language.

        Languages count alike before a letter is read; of equals the first by name is taken.  A text without three letters
        and spaces in a row, or null, has none.  Texts are read in one scan and nothing is shuffled; a task gets the
        model, of fixed size, and looks its own texts' buckets up in it.
        """
        of_bucket = {r[0]: r[1] for r in self.weights.select("_bucket", "_weights").collect()}
        weights = np.array([of_bucket[b] for b in range(self.buckets)], np.int64).T.copy()
        buckets = self.buckets

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in _parts(batch, "_letters"):
                    three, start, end = _letter_buckets(part["_letters"], buckets)
                    sums = np.empty((part.num_rows, len(weights)), np.int64)
                    for i, of in enumerate(weights):
                        upto = np.concatenate(([0], np.cumsum(of[three])))
                        sums[:, i] = np.where(end > start, upto[np.minimum(end, len(three))] - upto[np.minimum(start, len(three))], 0)
                    ends = np.where(end > start, len(weights), 0).cumsum()
                    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32), mask=np.append(end <= start, False))
                    scores = pa.ListArray.from_arrays(offsets, pa.array(sums[end > start].ravel()))
                    yield pa.RecordBatch.from_arrays([*[part[k] for k in key], scores], [*key, "_scores"])

        given = df.select(*key, letters(F.col(text)).alias("_letters"))
        rows = given.mapInArrow(add_up, T.StructType([*given.schema.fields[:-1], T.StructField("_scores", T.ArrayType(T.LongType()))]))
        scores = F.col("_scores")
        shares = F.transform(scores, lambda s: F.exp((s - F.array_max(scores)) / 1000.0))
        total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
        best = F.array_position(scores, F.array_max(scores)).cast("int")
        names = F.array(*map(F.lit, self.languages))
        known = F.array_max(scores).isNotNull()
        return rows.select(*key, F.when(known, F.get(names, best - 1)).alias("language"), F.when(known, 1.0 / total).alias("confidence"), F.when(known, F.map_from_arrays(names, F.transform(shares, lambda x: x / total))).alias("confidences"))


def learn(df: DataFrame, text: str, language: str, buckets: int = BUCKETS) -> LanguageModel:
    """A model of the rows whose language is known: each bucket's share of a language's letters, one added to every count.

    Texts are read once; a task adds up its own and gives a row for each language and bucket.  The driver gets the
    languages' names alone.
    """
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def given_on(kind: pa.DataType) -> pa.RecordBatch:
            names, n = list(counts), np.array(list(counts.values()), np.int64).reshape(-1, buckets)
            of, bucket = np.nonzero(n)
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i in of], kind), pa.array(bucket.astype(np.int32)), pa.array(n[of, bucket])], ["_language", "_bucket", "_n"])

        for batch in batches:
            for part in _parts(batch, "_letters"):
                three, start, end = _letter_buckets(part["_letters"], buckets)
                names = part["_language"].dictionary_encode()
                of = names.indices.to_numpy()
                # Rows by language, so that each language's buckets are one run.
                rows = np.argsort(of, kind="stable")
                start, n = start[rows], (end - start)[rows]
                ends = np.cumsum(n)
                three = three[np.arange(n.sum()) + np.repeat(start - (ends - n), n)]
                upto = np.append(0, ends)[np.searchsorted(of[rows], np.arange(len(names.dictionary) + 1))]
                for name, begin, stop in zip(names.dictionary.to_pylist(), upto, upto[1:]):
                    if len(counts) >= _LANGUAGES and name not in counts:
                        yield given_on(names.dictionary.type)
                    counts[name] = counts.get(name, 0) + np.bincount(three[begin:stop], minlength=buckets)
        if counts:
            yield given_on(names.dictionary.type)

    known = df.where(F.col(language).isNotNull())
    seen = known.select(F.col(language).alias("_language"), letters(F.col(text)).alias("_letters")).mapInArrow(add_up, T.StructType([T.StructField("_language", df.schema[language].dataType), T.StructField("_bucket", T.IntegerType()), T.StructField("_n", T.LongType())]))
    counts = seen.groupBy("_language", "_bucket").agg(F.sum("_n").alias("_n"))
    languages = sorted(r[0] for r in known.select(language).distinct().collect())
    if not languages:
        raise ValueError("no row has a language")
    counts = stored(counts, "letters-of-languages")
    by_bucket = counts.groupBy("_bucket").pivot("_language", languages).agg(F.sum("_n"))
    # Buckets that no language has weigh what one added count weighs.
    every = df.sparkSession.range(buckets).select(F.col("id").alias("_bucket")).join(by_bucket, "_bucket", "left")
    totals = counts.groupBy().pivot("_language", languages).agg(F.sum("_n"))
    totals = totals.select(F.array(*[F.coalesce(F.col(f"`{x}`"), F.lit(0)) for x in languages]).alias("_totals"))
    n = F.array(*[F.coalesce(F.col(f"`{x}`"), F.lit(0)) for x in languages])
    weights = every.select("_bucket", n.alias("_n")).join(F.broadcast(totals))
    return LanguageModel(languages, weights.select("_bucket", F.zip_with("_n", "_totals", lambda k, t: F.round(1000 * F.log((k + 1) / (t + buckets))).cast("long")).alias("_weights")), buckets)
