"""Substring deduplication with a count-min prefilter.

A window is ``WIDTH`` consecutive words of one text.  A word goes if a window that covers it
also starts in a text of smaller id.  Two passes find such windows:

1. Each chunk of texts makes a sketch of its windows: for two hash functions, the cells they
   fall into, with counts up to two.  The sketch has about four times as many cells as the
   corpus has windows, so no machine holds it whole: it is cut into blocks of cells, each
   block is merged by one task, and every chunk gets back which of its own cells hold two or
   more.  Counts are only ever too high, so no repeated window is lost.
2. Chunks send on the windows whose cells are repeated in both functions, by 128 bits
   (two hashes, each from a word hash of its own) and with the least id in the chunk: at most one row for each window and chunk, so a window
   of a third of all texts is no hot key.  The least id of all decides.

Texts equal to one of smaller id are settled beforehand (all their windows are repeated) and
take no part.  The chunks are a table bucketed by chunk in the shared folder: each pass joins
its answers to the texts without shuffling these.  All sizes follow the input: larger corpora
get larger chunks and blocks, up to sizes that a task's memory sets; a block's group is then its
``2 ** MOST_BLOCK_BITS`` counters and about a quarter as many windows, whatever the corpus has.

Words are maximal runs of bytes other than space and ``\\t \\n \\v \\f \\r``, unchanged.

Edge cases: ids are whole numbers, or the call fails; a null or empty text has no words; a text of fewer than ``WIDTH`` words has no
window and keeps all; rows of equal id do not take from each other; a null id counts as larger
than all others; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import kernels
from plumbline.llm.common import map_arrow, scratch_path, table, whole_numbers, written
from plumbline.llm.kernels import U64, mix

WIDTH = 13
FUNCTIONS = 2
#: Chunks of a corpus of 1 GB; their size grows as its square root, up to the larger figure.
CHUNK_BYTES, MOST_CHUNK_BYTES = 4 << 20, 64 << 20
#: Cells of a block, as powers of two.
BLOCK_BITS, MOST_BLOCK_BITS = 22, 28
CELLS_FOR_WINDOW = 4
_LAST = 2**63 - 1


def _chunk_bytes(total: int) -> int:
    return int(min(max(CHUNK_BYTES, CHUNK_BYTES * math.sqrt(total / 1e9)), MOST_CHUNK_BYTES))


def chunk_table(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Texts dealt to chunks in the order they are read, as a bucketed table; and the number of words.

    A chunk is named by its task's partition and its number there, so no two tasks share one and a task that is run
    again gives the same names.

    Columns ``chunk``, ``row``, ``id``, ``text``, ``digest`` (of the text) and ``n_words``.
    """
    whole_numbers(df, id_col)
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    size = _chunk_bytes(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, room, row = TaskContext.get().partitionId() << 32, 0, size, 0
        for batch in batches:
            chunk, place, digest, words = [], [], [], []
            for x in batch.column(1):
                text = x.as_py()
                if room < len(text) and row:
                    n, room, row = n + 1, size, 0
                chunk.append(own + n)
                place.append(row)
                digest.append(hashlib.blake2b(text, digest_size=16).digest())
                words.append(len(text.split()))
                room -= len(text) + 64
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(place, pa.int32()), batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(words, pa.int64())], names=["chunk", "row", "id", "text", "digest", "n_words"])

    name = f"substring_chunks_{uuid.uuid4().hex}"
    chunks = map_arrow(rows, run, "chunk long, row int, id long, text binary, digest binary, n_words long")
    buckets = max(1, min(20_000, math.ceil(total / (2 * size))))
    chunks.write.bucketBy(buckets, "chunk").option("path", scratch_path(spark, "substring-chunks")).saveAsTable(name)
    out = spark.table(name)
    n_words = out.agg(F.sum("n_words")).head()[0] or 0
    # ``out`` holds the files and their buckets; the catalog's entry is no longer needed.
    spark.sql(f"DROP TABLE {name}")
    return out, n_words


class Chunk:
    """Texts of one chunk in their order, without those that ``skip`` names, and their windows."""

    def __init__(self, rows: pa.Table, skip: set[int]):
        rows = rows.sort_by("row")
        self.ids = rows.column("id").to_numpy()
        self.texts = rows.column("text").combine_chunks()
        self.taken = np.array([r not in skip for r in rows.column("row").to_pylist()], bool)
        data, offsets = kernels.text_bytes(self.texts)
        starts, _, self.words, self.second_words = kernels.words(data, offsets, seconds=True)
        self.bounds = kernels.word_bounds(offsets, starts)
        first, bounds = kernels.shingles(self.words, self.bounds, WIDTH, short=False)
        size = np.diff(bounds)
        doc = np.repeat(np.arange(len(size)), size)
        on = self.taken[doc]
        self.first, self.doc = first[on], doc[on]
        #: Word at which each window starts, counted over the chunk.
        self.at = (np.arange(len(doc)) - np.repeat(bounds[:-1], size) + np.repeat(self.bounds[:-1], size))[on]

    def second(self, at: np.ndarray) -> np.ndarray:
        """Another 64 bits for the windows that start at these words, from an independent hash of each word."""
        total = np.zeros(len(at), U64)
        with np.errstate(over="ignore"):
            for i in range(WIDTH):
                total = total * U64(0xD6E8FEB86659FD93) + mix(self.second_words[at + i] ^ U64(0xA0761D6478BD642F))
        return mix(total)

    def cells(self, function: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(self.first ^ U64((function + 1) * 0x9FB21C651E98DF25 % 2**64)) >> U64(64 - bits)).astype(np.int64)


def _twice(cells: np.ndarray) -> np.ndarray:
    """Sorted, with no cell more than twice."""
    cells = np.sort(cells)
    keep = np.ones(len(cells), bool)
    keep[2:] = cells[2:] != cells[:-2]
    return cells[keep]


def _packed(cells: np.ndarray) -> bytes:
    """Gaps of ascending cells, as planes of bytes; the high planes are nearly empty and pack well."""
    gaps = np.diff(cells, prepend=0).astype("<u4")
    return pa.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))


def _rows_to_skip(answers: pa.Table) -> set[int]:
    return {r for r in answers.column("row").to_pylist() if r is not None}


def _sketch(bits: int, block_bits: int):
    """Cells of a chunk's windows, a row for each function and block."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"chunk": [], "function": [], "block": [], "n": [], "cells": []}
        if texts.num_rows:
            own, key = Chunk(texts, _rows_to_skip(answers)), texts.column("chunk")[0].as_py()
            for function in range(FUNCTIONS):
                cells = _twice(own.cells(function, bits))
                blocks, starts = np.unique(cells >> block_bits, return_index=True)
                for block, part in zip(blocks.tolist(), np.split(cells, starts[1:]), strict=False):
                    for k, x in (("chunk", key), ("function", function), ("block", block), ("n", len(part)), ("cells", _packed(part - (block << block_bits)))):
                        out[k].append(x)
        return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "function": pa.array(out["function"], pa.int32()), "block": pa.array(out["block"], pa.int64()), "n": pa.array(out["n"], pa.int32()), "cells": pa.array(out["cells"], pa.binary())})

    return run


def _merge(block_bits: int):
    """Sum of the sketches of one block; each chunk's cells that hold two or more, as bits in the order it sent them."""

    def run(rows: pa.Table) -> pa.Table:
        count = np.zeros(1 << block_bits, np.uint8)
        sent = [_unpacked(x.as_py(), n.as_py()) for x, n in zip(rows.column("cells"), rows.column("n"), strict=True)]
        for cells in sent:
            again = np.diff(cells, prepend=-1) == 0
            once = cells[~again]
            count[once] = np.minimum(count[once] + 1, 2)
            count[cells[again]] = 2
        bits = [np.packbits(count[cells] == 2) for cells in sent]
        some = [i for i, x in enumerate(bits) if x.any()]
        chosen = rows.take(pa.array(some, pa.int64()))
        return pa.table({"chunk": chosen.column("chunk"), "function": chosen.column("function"), "block": chosen.column("block"), "bits": pa.array([bits[i].tobytes() for i in some], pa.binary())})

    return run


def _candidates(bits: int, block_bits: int):
    """Windows whose cells are repeated in every function: their hash and the least id in the chunk."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        key, first, second, ids = 0, empty.view(U64), empty.view(U64), empty
        if texts.num_rows:
            own, key = Chunk(texts, _rows_to_skip(answers)), texts.column("chunk")[0].as_py()
            on = np.ones(len(own.first), bool)
            said = {(f, b): x for f, b, x in zip(*(answers.column(c).to_pylist() for c in ("function", "block", "bits")), strict=True) if f is not None}
            for function in range(FUNCTIONS):
                cells = own.cells(function, bits)
                sent = _twice(cells)
                blocks, starts, sizes = np.unique(sent >> block_bits, return_index=True, return_counts=True)
                repeated = [empty]
                for block, start, size in zip(blocks.tolist(), starts.tolist(), sizes.tolist(), strict=True):
                    if (function, block) in said:
                        repeated.append(sent[start : start + size][np.unpackbits(np.frombuffer(said[function, block], np.uint8), count=size).astype(bool)])
                repeated = np.concatenate(repeated)
                place = np.searchsorted(repeated, cells)
                on &= repeated[np.minimum(place, max(len(repeated) - 1, 0))] == cells if len(repeated) else False
            first, second, ids = own.first[on], own.second(own.at[on]), own.ids[own.doc[on]]
            order = np.lexsort((ids, second, first))
            first, second, ids = first[order], second[order], ids[order]
            new = np.ones(len(first), bool)
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
            first, second, ids = first[new], second[new], ids[new]
        return pa.table({"chunk": pa.array(np.full(len(ids), key, np.int64)), "h1": pa.array(first.view(np.int64)), "h2": pa.array(second.view(np.int64)), "id": pa.array(ids)})

    return run


def _removal(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Every text without the words that repeated windows cover."""
    ids, n_words, n_removed, kept = [], [], [], []
    if texts.num_rows:
        own = Chunk(texts, _rows_to_skip(answers))
        # Windows of which a smaller id stands in another chunk.
        h1, h2 = (np.array([x for x in answers.column(c).to_pylist() if x is not None], np.int64).view(U64) for c in ("h1", "h2"))
        order = np.lexsort((h2, h1))
        h1, h2 = h1[order], h2[order]
        gone = np.zeros(len(own.first), bool)
        second = own.second(own.at)
        if len(h1):
            place = np.minimum(np.searchsorted(h1, own.first), len(h1) - 1)
            gone = (h1[place] == own.first) & (h2[place] == second)
        # Windows of which a smaller id stands in this chunk.
        owner = own.ids[own.doc]
        order = np.lexsort((owner, second, own.first))
        a, b, o = own.first[order], second[order], owner[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = o[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))] if len(a) else o
        gone[order] |= o > least
        cover = np.zeros(len(own.words) + 1, np.int64)
        np.add.at(cover, own.at[gone], 1)
        np.add.at(cover, own.at[gone] + WIDTH, -1)
        stays = np.cumsum(cover)[:-1] == 0
        for i in range(len(own.ids)):
            words, here = own.texts[i].as_py().split(), stays[own.bounds[i] : own.bounds[i + 1]]
            n = len(words)
            if not own.taken[i] and n >= WIDTH:
                words = []
            elif not here.all():
                words = [w for w, k in zip(words, here.tolist(), strict=True) if k]
            ids.append(None if own.ids[i] == _LAST else int(own.ids[i]))
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words).decode())
    return pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())})


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space) of every row."""
    chunks, n_words = chunk_table(df, id_col, text_col)
    bits = max(BLOCK_BITS, math.ceil(math.log2(max(1, n_words * CELLS_FOR_WINDOW))))
    windows_of_chunk = max(1, _chunk_bytes(6 * n_words) // 6)
    block_bits = min(max(BLOCK_BITS, bits - int(math.log2(max(1, windows_of_chunk / 512)))), MOST_BLOCK_BITS)

    # Stored first, so that the join has an exchange of its own: a digest of a large share of the texts can be split there.
    least = written(chunks.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "least"), "substring-digests")
    copies = written(chunks.select("chunk", "row", "id", "digest").join(least, "digest").where("id > least").select("chunk", "row"), "substring-copies")
    by_chunk = chunks.select("chunk", "row", "id", "text").groupBy("chunk")

    def answered(answers: DataFrame, fn, schema: str) -> DataFrame:
        return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(fn, schema)

    slices = answered(copies, _sketch(bits, block_bits), "chunk long, function int, block long, n int, cells binary")
    repeated = slices.groupBy("function", "block").applyInArrow(_merge(block_bits), "chunk long, function int, block long, bits binary")
    found = answered(repeated.unionByName(copies, allowMissingColumns=True), _candidates(bits, block_bits), "chunk long, h1 long, h2 long, id long")
    elsewhere = found.withColumn("least", F.min("id").over(Window.partitionBy("h1", "h2"))).where("least < id").select("chunk", "h1", "h2")
    return answered(elsewhere.unionByName(copies, allowMissingColumns=True), _removal, "id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
