"""Joins on order against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import intervals


def spans(spark, rng, n, name, longest):
    rows = []
    for i in range(n):
        start = rng.randrange(-300, 300)
        rows.append((i, rng.choice("abc") if rng.random() < 0.9 else None, start, start + rng.randrange(-1, longest)))
    rows += [(n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, "a", -(2**40), 2**40)]
    return rows, spark.createDataFrame(rows, f"{name} long, k string, {name}_s long, {name}_e long")


@pytest.mark.parametrize("bin_rows", [100_000, 3])
def test_overlaps_equal_a_loop(spark, bin_rows):
    rng = random.Random(7)
    left, a = spans(spark, rng, 120, "l", 40)
    right, b = spans(spark, rng, 120, "r", 200)
    pairs = intervals.overlapping(a, b, ["k"], ("l_s", "l_e"), ("r_s", "r_e"), bin_rows=bin_rows)
    got = sorted((x.l, x.r) for x in pairs.collect())
    full = lambda x: None not in x and x[2] < x[3]
    want = sorted((x[0], y[0]) for x in left for y in right if full(x) and full(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 500
    assert set(pairs.columns) == {"k", "l", "l_s", "l_e", "r", "r_s", "r_e"}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_intervals_meet_nothing(spark):
    none = spark.createDataFrame([], "x long, s long, e long")
    some = spark.createDataFrame([(1, 0, 9)], "y long, t long, u long")
    assert intervals.overlapping(none, some, [], ("s", "e"), ("t", "u")).count() == 0
    whole = intervals.overlapping(spark.createDataFrame([(1, 8, 9), (2, 9, 10)], none.schema), some, [], ("s", "e"), ("t", "u"))
    assert [(r.x, r.y) for r in whole.collect()] == [(1, 1)]


@pytest.mark.parametrize("keys", [["k"], []])
def test_as_of_equals_a_loop_over_many_ranges(spark, keys):
    rng = random.Random(7)
    row = lambda i: (i, "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, *range(40)]))
    left, right = [row(i) for i in range(200)], [row(i) for i in range(150)]
    a = spark.createDataFrame(left, "id long, k string, t long")
    b = spark.createDataFrame(right, "n long, k string, t long").withColumn("twice", F.col("n") * 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.id: (r.as_of, r.n, r.twice) for r in intervals.as_of(a, b, keys, "t", "t", ["n", "twice"], ["n"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")

    def last(k, t):
        fits = [(y[2], y[0]) for y in right if None not in (y[2], t) and y[2] <= t and (not keys or (k is not None and y[1] == k))]
        return (max(fits)[0], max(fits)[1], 2 * max(fits)[1]) if fits else (None, None, None)

    assert got == {x[0]: last(x[1], x[2]) for x in left}
