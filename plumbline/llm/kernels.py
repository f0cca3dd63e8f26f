"""Vectorised text kernels used inside Arrow tasks.

Everything here works on one Arrow batch at a time.  A word is a maximal run of
bytes other than space and ``\\t \\n \\v \\f \\r``; those separators are ASCII, so
working on UTF-8 bytes gives the same words as working on code points.

Word hashes take a word by lanes of 8 bytes: each lane is folded into a 64-bit state that
is mixed again; words of more than ``LONG_WORD`` bytes are hashed by keyed BLAKE2b.  No
structure of the word (repeats, complements, shifts) makes two words equal more often than
by chance, 2**-64.  The constants are in this file, so one 64-bit hash is no defence against a
writer who solves for equal hashes on purpose; where an equal hash alone would remove or
link a text, a second hash with a state, constants and mixing order of its own is taken too.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLOCK = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Longer words are hashed by BLAKE2b, one call a word.
LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The bytes of a word's last lane that belong to it, by their number.
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
_SEEDS = (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344))
_FACTORS = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the published splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its ``n + 1`` offsets into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, buffers = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seconds: bool) -> list[np.ndarray]:
    """Hash of each byte range of ``data``; with ``seconds``, an independent second one as well."""
    size = ends - starts
    out = [mix(size.astype(U64) ^ seed) for seed in _SEEDS[: 1 + seconds]]
    # A view with a lane at every byte.
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    on = np.flatnonzero(size <= LONG_WORD)
    at, left = starts[on], size[on]
    while len(on):
        lane = lanes[at] & _LANE[np.minimum(left, 8)]
        out[0][on] = mix((out[0][on] ^ lane) * _FACTORS[0])
        if seconds:
            out[1][on] = mix(out[1][on] * _FACTORS[1] + mix(lane + _SEEDS[1]))
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        digest = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16, key=b"word").digest(), U64)
        for k, x in enumerate(out):
            x[i] = digest[k]
    return out


def _next_separator(data: np.ndarray, at: int, end: int) -> int:
    """The first place of ``at`` to ``end`` (excluded) that holds a separator, or ``end``."""
    while at < end:
        found = np.flatnonzero(_SEPARATOR[data[at : min(end, at + _BLOCK)]])
        if len(found):
            return at + int(found[0])
        at += _BLOCK
    return end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, seconds: bool = False) -> tuple[np.ndarray, ...]:
    """Start, end and hash (with ``seconds``, also the second hash) of every word, in order.  Words do not cross ``offsets``."""
    edges = np.unique(offsets)
    out, at, n = [], 0, len(data)
    with np.errstate(over="ignore"):
        while at < n:
            to = min(n, at + _BLOCK)
            if to < n:
                k = np.searchsorted(edges, to, "right") - 1
                if edges[k] > at:
                    to = int(edges[k])
                else:  # one long text: cut at a separator, so memory follows the block and not the text
                    to = _next_separator(data, to, int(edges[min(k + 1, len(edges) - 1)]))
            part = _LOWER[data[at:to]] if lower else data[at:to]
            inner = edges[np.searchsorted(edges, at) : np.searchsorted(edges, to)] - at
            inside = ~_SEPARATOR[part]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            first[inner] = inside[inner]
            cut = inner[inner > 0] - 1
            last[cut] = inside[cut]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            if len(s):
                out.append((s + at, e + at, *_word_hashes(part, s, e, seconds)))
            at = to
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, U64)] * (1 + seconds)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_bounds(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text, the index of its first word; one more entry at the end."""
    return np.searchsorted(starts, offsets, "left")


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` consecutive words and the bounds per text.

    With ``short``, a text of one to ``width - 1`` words has its whole word sequence as one shingle.
    """
    n = len(hashes)
    with np.errstate(over="ignore"):
        factor = [U64(mix(np.array([977 + i], U64))[0] | U64(1)) for i in range(width)]
        total = np.zeros(max(0, n - width + 1), U64)
        for i in range(width):
            total += hashes[i : n - width + 1 + i] * factor[i]
        total = mix(total)
        count = np.diff(bounds)
        full = np.maximum(count - width + 1, 0)
        extra = ((count > 0) & (count < width)) if short else np.zeros(len(count), bool)
        size = full + extra
        out_bounds = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(out_bounds[-1], U64)
        at = np.repeat(bounds[:-1] - out_bounds[:-1], size) + np.arange(out_bounds[-1])
        whole = np.repeat(full > 0, size)
        out[whole] = total[at[whole]]
        for k in np.flatnonzero(extra):
            own = hashes[bounds[k] : bounds[k + 1]]
            sums = U64(len(own))
            for i, h in enumerate(own):
                sums = sums + h * factor[i]
            out[out_bounds[k]] = mix(np.array([sums ^ U64(0x5BF03635)], U64))[0]
    return out, out_bounds
