"""Token counts of a sentencepiece BPE model through a two-tier lookup of pre-token lengths.

A text is cut into pre-tokens at places no piece of the vocabulary runs across,
so the count of a text is the sum over its pre-tokens.  The cuts are: around a
line feed, and before a run of spaces.  ``load`` proves from the vocabulary that
they are safe, and refuses the model otherwise.

First tier: a broadcast table of at most ``TABLE_SIZE`` frequent pre-tokens and
their lengths.  Second tier: a cache of bounded size in each Python worker, which
encodes what the table lacks.  No text's pre-tokens are shuffled.  The table is learned
from every whole text: each task keeps a summary of at most ``SUMMARY_SIZE`` counters
(Misra and Gries' heavy hitters, in the mergeable form of Agarwal et al., 2012), which
holds every pre-token that makes up more than one part in ``SUMMARY_SIZE`` of the task's;
the summaries are added up by aggregation, and the driver gets the ``TABLE_SIZE`` first.
The table decides what is looked up where and never a count.

Edge cases: a null text counts as empty, with no bytes and no tokens; a text of
any length is counted whole, and one without a space is one pre-token; repeated
rows and null ids are kept one for one; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow, table

TABLE_SIZE = 1 << 16
#: Counters that a task's summary of its pre-tokens keeps.
SUMMARY_SIZE = 1 << 16
CACHE_SIZE = 1 << 18
#: Longer pre-tokens are encoded each time.
CACHED_CHARS = 64
_SPACE = "▁"
_PRE_TOKEN = re.compile(f"{_SPACE}+[^{_SPACE}\n]*|[^{_SPACE}\n]+|\n")


def load(path: str) -> sentencepiece.SentencePieceProcessor:
    """The model, once it is shown that its pieces allow the cuts."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if _SPACE in piece.lstrip(_SPACE) or "\n" in piece:
            raise ValueError(f"piece {piece!r} runs across a pre-token's edge")
    probe = "a  b\n\n c ① ﬁ\t"
    if model.normalize(probe) != _SPACE + probe.replace(" ", _SPACE):
        raise ValueError("the model rewrites its input, so pre-tokens cannot be cut beforehand")
    return model


def pre_tokens(text: str) -> list[str]:
    return _PRE_TOKEN.findall(_SPACE + text.replace(" ", _SPACE)) if text else []


class Lengths(dict):
    """Pre-token to number of tokens: the broadcast table, then the worker's own cache, then the model."""

    def __init__(self, known: dict[str, int], model: sentencepiece.SentencePieceProcessor):
        super().__init__(known)
        self.known, self.model = known, model

    def __missing__(self, token: str) -> int:
        # A line feed in front keeps the model from putting its own space there: two tokens more, the space and the feed.
        n = len(self.model.encode("\n" + token, num_threads=1)) - 2
        if len(token) <= CACHED_CHARS:
            if len(self) >= len(self.known) + CACHE_SIZE:
                self.clear()
                self.update(self.known)
            self[token] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


def reduced(counts: Counter[str], size: int) -> Counter[str]:
    """At most ``size`` counters: all are lowered by the largest count that does not fit."""
    if len(counts) <= size:
        return counts
    least = heapq.nlargest(size + 1, counts.values())[-1]
    return Counter({token: n - least for token, n in counts.items() if n > least})


def summaries(df: DataFrame, text_col: str = "text", size: int = SUMMARY_SIZE) -> DataFrame:
    """``token`` and ``n``: the pre-tokens that each task has most of, and at least how often; single ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(x for x in pre_tokens(text.as_py() or "") if len(x) <= CACHED_CHARS)
                if len(counts) > 4 * size:
                    counts = reduced(counts, size)
        kept = [(token, n) for token, n in reduced(counts, size).items() if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["token", "n"])

    return map_arrow(df.select(text_col), run, "token string, n long")


def frequent_lengths(df: DataFrame, path: str, text_col: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """The first tier: lengths of the most frequent pre-tokens of all texts."""
    first = summaries(df, text_col).groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(size)
    lengths = Lengths({}, load(path))
    return {token: lengths[token] for token in first.toArrow().column("token").to_pylist()}


def token_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row."""
    known = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, path, text_col, size) if size else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(known.value, load(path))
        for batch in batches:
            n = [lengths.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_bytes"))
    return map_arrow(rows, run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
