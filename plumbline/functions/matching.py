"""Matching of token sequences within a row: longest common subsequence, weighted distance, alignment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Hashable, Sequence

import numpy as np

#: Partial alignments that are kept at each word; see ``fewest_crossings``.
BEAM = 64


def common_length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Length of the longest common subsequence, a row of the usual table being the bits of one number (Hyyrö, 2004).

    A bit is 0 where the row rises; adding carries each match to the next place that does not.
    """
    if len(a) < len(b):
        a, b = b, a
    places: dict[Hashable, int] = defaultdict(int)
    for j, y in enumerate(b):
        places[y] |= 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        if x in places:
            met = row & places[x]
            row = ((row + met) | (row - met)) & every
    return len(b) - row.bit_count()


def weighted_distance(a: str, b: str, insert: int, delete: int, substitute: int) -> int:
    """Least cost of turning ``a`` into ``b``: a step for each letter of ``b``, vectors along ``a``."""
    codes = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # Deleting a run of letters costs as much as the difference of two places on this ramp.
    ramp = np.arange(len(codes) + 1, dtype=np.int64) * delete
    column = ramp.copy()
    for y in b:
        step = column + insert
        np.minimum(step[1:], column[:-1] + np.where(codes == ord(y), 0, substitute), out=step[1:])
        column = np.minimum.accumulate(step - ramp) + ramp
    return int(column[-1])


def fewest_crossings(a: Sequence[Hashable], b: Sequence[Hashable], beam: int = BEAM) -> list[tuple[int, int]]:
    """Pairs of places with equal words, as many as there can be, with the fewest crossings; of these, in fewest runs.

    Two pairs cross where one comes first in ``a`` and last in ``b``.  Equal words never need to cross each other, so a
    partial alignment is named by the places of ``b`` that it uses and its last one.  Of these, ``beam`` are kept at each
    word, and as many places tried: the result is exact as long as no more are there, and good beyond.
    """
    here: dict[Hashable, list[int]] = defaultdict(list)
    for j, y in enumerate(b):
        here[y].append(j)
    total: dict[Hashable, int] = defaultdict(int)
    for x in a:
        total[x] += 1
    seen: dict[Hashable, int] = defaultdict(int)
    masks = {y: sum(1 << j for j in js) for y, js in here.items()}
    # used places, place of the word before or -2: (crossings, runs, chain of pairs)
    states: dict[tuple[int, int], tuple[int, int, tuple | None]] = {(0, -2): (0, 0, None)}
    for i, x in enumerate(a):
        js = here.get(x, [])
        t, m, n = seen[x], total[x], len(js)
        seen[x] += 1
        after: dict[tuple[int, int], tuple[int, int, tuple | None]] = {}

        def offer(key, value, after=after):
            if key not in after or value[:2] < after[key][:2]:
                after[key] = value

        for (used, last), (crossings, runs, chain) in states.items():
            done = (used & masks.get(x, 0)).bit_count()
            # The word may stay alone while enough of its kind follow to reach the full number of pairs.
            if min(m, n) - done <= m - t - 1:
                offer((used, -2), (crossings, runs, chain))
            if done == min(m, n):
                continue
            # Beyond the last used place of its kind, with places left for those that must still follow.
            start = (used & masks[x]).bit_length()
            need = max(0, min(m, n) - done - 1)
            options = [k for k in range(n - need) if js[k] >= start]
            if len(options) > beam:
                options = sorted(options, key=lambda k: (abs(js[k] - last - 1), k))[:beam]
            for k in options:
                j = js[k]
                offer((used | (1 << j), j), (crossings + (used >> (j + 1)).bit_count(), runs + (j != last + 1), (chain, (i, j))))
        if len(after) > beam:
            after = dict(sorted(after.items(), key=lambda s: (-s[0][0].bit_count(), s[1][0], s[1][1], s[0]))[:beam])
        states = after
    chain = min(states.items(), key=lambda s: (-s[0][0].bit_count(), s[1][0], s[1][1], s[0]))[1][2]
    pairs = []
    while chain:
        chain, pair = chain
        pairs.append(pair)
    return pairs[::-1]
