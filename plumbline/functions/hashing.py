"""Seeded orders and draws that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws that one digest gives, of 32 bits each.
PER_DIGEST = 4


def seeded_order(seed: int, *keys: Column | str) -> Column:
    """A text to sort by: the same rows in the same random order for the same seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]).cast("binary"))


def draw(seed: int, *keys: Column) -> Column:
    """A whole number in [0, 2 ** 32): the first digits of a digest of the seed and whole-number keys."""
    return F.conv(F.substring(seeded_order(seed, *keys), 1, 8), 16, 10).cast("long")


def draw_sql(seed: int, *keys: str) -> str:
    """The same number in SQL."""
    return f"('0x' || substr(md5({_joined(seed, *keys)}), 1, 8))::BIGINT"


def draws(n: Column, seed: int, *keys: Column) -> Column:
    """``n`` such numbers as an array, ``PER_DIGEST`` of each digest."""
    digests = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PER_DIGEST).cast("int")), lambda b: seeded_order(seed, *keys, b))
    four = F.transform(digests, lambda h: F.array(*[F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(PER_DIGEST)]))
    return F.slice(F.flatten(four), F.lit(1), n.cast("int"))


def draws_sql(k: str, seed: int, *keys: str) -> str:
    """The number at place ``k`` (from 0) of such an array in SQL."""
    return f"('0x' || substr(md5({_joined(seed, *keys, f'(({k}) // {PER_DIGEST})')}), ((({k}) % {PER_DIGEST}) * 8 + 1)::BIGINT, 8))::BIGINT"


def _joined(seed: int, *keys: str) -> str:
    return f"'{seed}:' || " + " || ':' || ".join(f"({k})::BIGINT" for k in keys)
