"""Sub-word pieces by longest match, with offsets: a trie packed into numpy arrays, walked for all words of a batch at once.

A vocabulary is a list of pieces, and a piece's number is its place in it.  ``##`` marks pieces that continue a word; the
others start one.  A word is cut into the longest piece that starts it, then the longest that continues it, and so on; a
word that cannot be cut so, or has more than ``LONGEST`` characters, is one piece of number ``UNKNOWN``.  Words of a text are
runs of letters and digits, and single other characters but white space.  Each word of a batch is cut once, however often it is met.

Null texts have null pieces, empty ones none; texts of any length are taken whole; of equal pieces in a vocabulary the first counts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.curation import windows

CONTINUES, UNKNOWN, LONGEST = "##", -1, 100
SPANS = "array<struct<piece: int, start: int, end: int, word: int>>"
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


class Trie:
    """Children by ``parent << 21 | code point`` in one sorted array; nodes 0 and 1 are the roots of starts and of continuations."""

    def __init__(self, pieces: Iterable[str]):
        children, ends = {}, [UNKNOWN, UNKNOWN]
        for number, piece in enumerate(pieces):
            node, rest = (1, piece[len(CONTINUES) :]) if piece.startswith(CONTINUES) and piece != CONTINUES else (0, piece)
            for c in rest:
                key = node << 21 | ord(c)
                if key not in children:
                    children[key] = len(ends)
                    ends.append(UNKNOWN)
                node = children[key]
            if rest and ends[node] == UNKNOWN:
                ends[node] = number
        keys = np.array([-1, *children], np.int64)
        order = np.argsort(keys)
        self.keys, self.child, self.ends = keys[order], np.array([0, *children.values()], np.int64)[order], np.array(ends, np.int64)

    def longest(self, points: np.ndarray, at: np.ndarray, last: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest piece from each place ``at`` on and where it ends."""
        piece, end, here, node = np.full(len(at), UNKNOWN), at.copy(), at.copy(), node.copy()
        live = np.arange(len(at))
        while len(live):
            key = node[live] << 21 | points[here[live]]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            live = live[hit]
            node[live] = self.child[place[hit]]
            here[live] += 1
            number = self.ends[node[live]]
            whole = live[number != UNKNOWN]
            piece[whole], end[whole] = number[number != UNKNOWN], here[whole]
            live = live[here[live] < last[live]]
        return piece, end

    def cut(self, words: list[str]) -> np.ndarray:
        """Rows of word, piece, start and end, in order."""
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        last = np.cumsum(size)
        first = last - size
        at, failed, found = first.copy(), size > LONGEST, [np.zeros((4, 0), np.int64)]
        open_words = np.flatnonzero((size > 0) & ~failed)
        while len(open_words):
            here = at[open_words]
            piece, end = self.longest(points, here, last[open_words], (here > first[open_words]).astype(np.int64))
            known = piece != UNKNOWN
            failed[open_words[~known]] = True
            open_words, piece, end = open_words[known], piece[known], end[known]
            found.append(np.stack([open_words, piece, at[open_words] - first[open_words], end - first[open_words]]))
            at[open_words] = end
            open_words = open_words[end < last[open_words]]
        rows = np.concatenate(found, axis=1)
        lost = np.flatnonzero(failed)
        rows = np.concatenate([rows[:, ~failed[rows[0]]], np.stack([lost, np.full(len(lost), UNKNOWN), np.zeros(len(lost), np.int64), size[lost]])], axis=1)
        return rows[:, np.lexsort((rows[2], rows[0]))]


def _spans(trie: Trie, texts: pa.Array) -> pa.Array:
    numbers: dict[str, int] = {}
    which, offset, place, n_words = [], [], [], []
    for text in texts.to_pylist():
        given = isinstance(text, list)
        words = [(w or "", 0) for w in text] if given else [(m[0], m.start()) for m in _WORD.finditer(text or "")]
        for i, (word, start) in enumerate(words):
            which.append(numbers.setdefault(word, len(numbers)))
            offset.append(start)
            place.append(i)
        n_words.append(len(words))
    rows = trie.cut(list(numbers))
    which = np.array(which, np.int64)
    n = np.bincount(rows[0], minlength=len(numbers))
    own = n[which]
    ends = np.concatenate([[0], np.cumsum(own)])
    flat = np.arange(ends[-1]) + np.repeat((np.cumsum(n) - n)[which] - ends[:-1], own)
    offset = np.repeat(np.array(offset, np.int64), own)
    columns = {"piece": rows[1][flat], "start": rows[2][flat] + offset, "end": rows[3][flat] + offset, "word": np.repeat(np.array(place, np.int64), own)}
    values = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in columns.values()], names=list(columns))
    bounds = ends[np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values, mask=texts.is_null())


def subwords(spark: SparkSession, pieces: Iterable[str]):
    """A column function: the pieces of a text (``start`` and ``end`` in the text, in characters) or of an array of words
    (``start`` and ``end`` in the word), each with its word's place.  The vocabulary, some 10,000 pieces, is broadcast."""
    trie = spark.sparkContext.broadcast(Trie(pieces))

    @F.arrow_udf(SPANS)
    def cut(texts: pa.Array) -> pa.Array:
        return _spans(trie.value, texts)

    return cut


def pieces_of_ranks(lines: Iterable[str]) -> list[str]:
    """Pieces from a byte-level rank file (base64 and rank in each line): with a leading space they start a word, else they
    continue one.  What is no UTF-8, or holds other white space, is left out."""
    out = []
    for line in lines:
        raw = base64.b64decode(line.split()[0]) if line.strip() else b""
        try:
            piece = raw.decode()
        except UnicodeDecodeError:
            continue
        rest = piece.removeprefix(" ")
        if rest and not re.search(r"\s", rest):
            out.append(rest if piece != rest else CONTINUES + rest)
    return out


def features(df: DataFrame, question: str, context: str, length: int, stride: int, special: int = 3) -> DataFrame:
    """Windows of ``context`` pieces that fit beside the whole ``question`` and ``special`` marks into ``length``; consecutive
    ones share ``stride`` pieces and all columns (so the example's id) stay.  A question that leaves no room is an error."""
    room = F.lit(length - special) - F.coalesce(F.size(question), F.lit(0))
    checked = F.when(room > stride, room).otherwise(F.raise_error(F.lit("a question leaves no room for a window")).cast("int"))
    return windows(df.withColumn("room", checked), context, F.col("room"), stride)
