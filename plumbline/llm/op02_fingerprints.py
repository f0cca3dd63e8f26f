"""Document fingerprints by one-permutation MinHash.

The word shingles of a text are hashed once.  A hash falls into one of ``BINS``
bins, and each bin keeps its least hash.  A bin that stays empty copies the bin
that a fixed random sequence of its own reaches first among the filled ones
(optimal densification), so that two texts' bins agree with the probability of
their likeness.  Of each bin the low ``BITS`` bits of its value, mixed with the
bin's number, are stored, two bins to a byte, written as hexadecimal.  Unequal bins
agree in ``BITS`` bits by chance with probability ``2 ** -BITS``, and bins that copy
the same two values do so independently, since their numbers differ; ``likeness``
takes that chance out.

A shingle is five consecutive words; a text of one to four words is one shingle.

Edge cases: a null or empty text, or one without words, has the empty
fingerprint, whose likeness is 1 to another empty one and 0 to any other; equal
texts have equal fingerprints whatever the rows around them; ids are whole
numbers, or the call fails; rows of equal id follow one another by text (an id
should not be that of a large share of the rows: they are one range), and null ids
come first, by a hash of their text and then the text, so that they are many ranges;
the last row's successor is the first, so one row alone is followed by itself; an
empty table gives an empty result; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import kernels
from plumbline.llm.common import map_arrow, table, whole_numbers
from plumbline.llm.kernels import U64, mix

WIDTH = 5
BINS = 512
BITS = 4
#: Rows of one range of ids, and the most ranges: the driver holds a cut point for each.
ROWS_PER_RANGE = 4000
MAX_RANGES = 20_000
_EMPTY = np.uint64(2**64 - 1)


def _probes(bins: int, tries: int) -> np.ndarray:
    """``tries`` random bins for each bin, the same on every machine."""
    at = np.arange(bins, dtype=U64)[:, None] * U64(1 << 20) + np.arange(tries, dtype=U64)[None, :]
    with np.errstate(over="ignore"):
        return (mix(at + U64(0x51ED27)) % U64(bins)).astype(np.int64)


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS, width: int = WIDTH):
        if 8 % bits or bins % (8 // bits):
            raise ValueError("bits must divide 8, and bins fill whole bytes")
        self.bins, self.bits, self.width = bins, bits, width
        self.probes = _probes(bins, 64)

    def minima(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Least hash of each bin, a row for each text; a text without shingles keeps empty bins."""
        n = len(bounds) - 1
        out = np.full(n * self.bins, _EMPTY)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        at = (hashes >> U64(40)) % U64(self.bins)
        # The bin comes from the hash's high bits and the order from a second mix of it, so that they are independent.
        np.minimum.at(out, doc * self.bins + at.astype(np.int64), mix(hashes ^ U64(0x6A09E667F3BCC909)) >> U64(1))
        return self.densified(out.reshape(n, self.bins))

    def densified(self, rows: np.ndarray) -> np.ndarray:
        """Each empty bin takes the value of the first filled bin on its own random sequence."""
        filled = rows != _EMPTY
        some = filled.any(axis=1)
        doc, at = np.nonzero(~filled & some[:, None])
        tries = 0
        out = rows.copy()
        while len(doc):
            probe = self.probes[at, tries] if tries < self.probes.shape[1] else self._walk(at, tries)
            hit = filled[doc, probe]
            out[doc[hit], at[hit]] = rows[doc[hit], probe[hit]]
            doc, at, tries = doc[~hit], at[~hit], tries + 1
        return out

    def _walk(self, at: np.ndarray, tries: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(at.astype(U64) * U64(1 << 20) + U64(tries) + U64(0x51ED27)) % U64(self.bins)).astype(np.int64)

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Low bits of every bin, a row for each text, and whether the text has shingles."""
        data, offsets = kernels.text_bytes(texts)
        starts, _, hashes = kernels.words(data, offsets)
        shingles, bounds = kernels.shingles(hashes, kernels.word_bounds(offsets, starts), self.width)
        return self.low_bits(self.minima(shingles, bounds)), np.diff(bounds) > 0

    def low_bits(self, rows: np.ndarray) -> np.ndarray:
        """Low bits of every bin's value mixed with the bin's number."""
        with np.errstate(over="ignore"):
            numbers = mix(np.arange(self.bins, dtype=U64) + U64(0x3C6EF372))
        return (mix(rows ^ numbers) & U64((1 << self.bits) - 1)).astype(np.uint8)

    def packed(self, codes: np.ndarray, some: np.ndarray) -> list[str]:
        per = 8 // self.bits
        parts = codes.reshape(len(codes), -1, per)
        whole = np.zeros(parts.shape[:2], np.uint8)
        for i in range(per):
            whole = (whole << self.bits) | parts[:, :, i] if i else parts[:, :, 0]
        return [row.tobytes().hex() if x else "" for row, x in zip(np.ascontiguousarray(whole), some, strict=True)]

    def likeness(self, a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
        """Unbiased but for being held within 0 and 1."""
        chance = 2.0**-self.bits
        match = (a == b).mean(axis=1) if len(a) else np.zeros(0)
        estimate = np.clip((match - chance) / (1 - chance), 0.0, 1.0)
        return np.where(a_some & b_some, estimate, np.where(a_some | b_some, 0.0, 1.0))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maker.packed(*maker.codes(batch.column(1))), pa.string())], names=[id_col, "fingerprint"])

    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_successor(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows in ranges of ascending id; each range also holds the row that follows it, marked ``_after``.

    Columns ``_range``, ``_after``, ``_id``, ``_text``, sorted so within partitions.  The cut points come from a
    quantile sketch (at most ``MAX_RANGES``) and need be no ids of the table: the least key that each range really
    has is found by one aggregation, and the rows of that key are copied to the range before it.  Null ids are
    dealt to ranges of their own by a hash of their text.  The texts are shuffled once; the driver sees the cut
    points and the least keys only.
    """
    whole_numbers(df, id_col)
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    rows = df.select(F.col(id_col).alias("_id"), key.alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col("_id").isNull())).head()
    ranges = max(1, min(MAX_RANGES, (n - nulls) // rows_per_range))
    picked = rows.agg(F.percentile_approx("_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).head()[0] if ranges > 1 else []
    cuts = sorted(set(picked or []))
    # Ranges of null ids come first: slices of equal width of the hash's upper half.
    slices = max(1, min(MAX_RANGES, nulls // rows_per_range)) if nulls else 0
    of_null = F.floor((F.shiftright("_key", 32) + (1 << 31)) * slices / (1 << 32)).cast("int")
    # Binary search: the number of cut points that are at most the id.
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    at = F.lit(0)
    if cuts:
        array = F.lit(cuts)
        at = F.aggregate(F.lit(steps), F.lit(0), lambda low, step: F.when((low + step <= len(cuts)) & (F.get(array, low + step - 1) <= F.col("_key")), low + step).otherwise(low))
    rows = rows.withColumn("_at", F.when(F.col("_id").isNull(), of_null).otherwise(at + slices).cast("int"))
    firsts = sorted(tuple(r) for r in rows.groupBy("_at").agg(F.min("_key")).collect())
    # The rows of a range's least key go to the range before it as well, those of the first range to the last.
    before = {at: firsts[i - 1][0] for i, (at, _) in enumerate(firsts)}
    size = max(before, default=0) + 1
    least, previous = [None] * size, [None] * size
    for at, key in firsts:
        least[at], previous[at] = key, before[at]
    copy = F.when(F.get(F.lit(least).cast("array<bigint>"), F.col("_at")) == F.col("_key"), F.get(F.lit(previous).cast("array<int>"), F.col("_at"))) if firsts else F.lit(None).cast("int")
    places = F.array_compact(F.array(F.struct(F.col("_at").alias("range"), F.lit(False).alias("after")), F.when(copy.isNotNull(), F.struct(copy.alias("range"), F.lit(True).alias("after")))))
    out = rows.select(F.explode(places).alias("p"), "_id", "_key", "_text").select(F.col("p.range").alias("_range"), F.col("p.after").alias("_after"), "_id", "_text", "_key")
    return out.repartitionById(size, F.col("_range")).sortWithinPartitions("_range", "_after", "_key", "_text").drop("_key")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; also that of the next document's."""
    types = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, last = Fingerprinter(), None
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            last = batch.slice(len(batch) - 1)
            own = np.flatnonzero(~batch.column(1).to_numpy(zero_copy_only=False)[:-1])
            texts = batch.column(3).to_pylist()
            codes, some = maker.codes(batch.column(3))
            changed = [edited(texts[i], texts[i + 1]) for i in own]
            new, new_some = maker.codes(pa.array(changed, pa.large_string()))
            columns = {
                "n_chars": [len(texts[i]) for i in own],
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed],
                "fingerprint": maker.packed(codes[own], some[own]),
                "edited_fingerprint": maker.packed(new, new_some),
                "near_edited": maker.likeness(codes[own], some[own], new, new_some),
                "near_next": maker.likeness(codes[own], some[own], codes[own + 1], some[own + 1]),
            }
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(own)), *(pa.array(x, types[k]) for k, x in columns.items())], names=[id_col, *columns])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_arrow(with_successor(df, id_col, text_col, rows_per_range), run, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))
