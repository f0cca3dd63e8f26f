"""Joins on order instead of equality: overlapping intervals, and the last row at or before a time.

Both run as equality joins and windows on keys that Spark can spread; neither makes a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from plumbline.session import settled

#: Rows of one side under one bin that a task joins at most before the bin is split.
BIN_ROWS = 100_000


def _level(start: Column, end: Column) -> Column:
    """The least power of two of which the interval's length is no more: it then lies in two such bins at most."""
    return F.length(F.bin(F.greatest(end - start - 1, F.lit(0)))) - F.when(end - start <= 1, 1).otherwise(0)


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_rows: int = BIN_ROWS) -> DataFrame:
    """Pairs of rows, equal in ``on``, whose half-open intervals of whole numbers share a place; each pair once.

    Columns but ``on`` must have different names on the two sides.  An interval belongs to the level of its length
    (powers of two) and stands in at most two bins there and on each longer level that occurs, so no width is to be
    chosen and a long interval makes no more rows than a short one.  Two intervals meet on the longer one's level, in the
    bin of the later start.  A bin in which the left side has more than ``bin_rows`` rows is split: its left rows are
    dealt by their digest, its right rows copied to each part.  Empty intervals and nulls meet nothing.
    """
    (ls, le), (rs, re) = left_span, right_span
    sides = []
    for df, start, end in ((left, ls, le), (right, rs, re)):
        sides.append(df.where(F.col(start) < F.col(end)).withColumn("_own", _level(F.col(start), F.col(end))))
    # At most 64 numbers whatever the rows.
    levels = sorted({r[0] for s in sides for r in s.select("_own").distinct().collect()})
    if not levels:
        levels = [0]

    def placed(df: DataFrame, start: str, end: str) -> DataFrame:
        at = F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("_own")))
        rows = df.withColumn("_level", at)
        first, last = (F.expr(f"shiftright({x}, _level)") for x in (f"`{start}`", f"`{end}` - 1"))
        return rows.withColumn("_bin", F.explode(F.sequence(first, last)))

    a, b = placed(sides[0], ls, le).withColumnRenamed("_own", "_own_l"), placed(sides[1], rs, re).withColumnRenamed("_own", "_own_r")
    keys = [*on, "_level", "_bin"]
    crowded = settled(a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bin_rows).select(*keys, F.ceil(F.col("_n") / bin_rows).cast("int").alias("_parts")))
    # By content, so that a task that is run again deals its rows alike.
    dealt = F.xxhash64(*[f.name for f in left.schema if not isinstance(f.dataType, MapType)])
    a = a.join(crowded, keys, "left").withColumn("_part", F.pmod(dealt, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    b = b.join(crowded, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    pairs = a.join(b, [*keys, "_part"])
    here = (F.greatest("_own_l", "_own_r") == F.col("_level")) & (F.expr(f"shiftright(greatest(`{ls}`, `{rs}`), _level)") == F.col("_bin"))
    return pairs.where((F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & here).drop("_level", "_bin", "_part", "_own_l", "_own_r")


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], tie: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the right row of the same keys that is last at or before each row's time.

    Among right rows of one time the last by ``tie`` counts.  Rows of both sides are cut into ranges of keys and time, so
    that a hot key is many ranges; within one a window fills forward.  What a range's first key had before comes from the
    ranges before it: one row for each range is ordered, however many rows they hold.  Left rows of a null key or time
    get nulls.
    """
    none = F.lit(None)
    seen = F.struct(F.col(right_time).alias("_time"), *[F.col(v).alias(v) for v in values])
    order = F.struct(*[F.col(t) for t in tie])
    columns = left.columns
    kept = F.struct(*[F.col(c) for c in columns])
    a = left.select(*on, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), none.cast(right.select(order).schema[0].dataType).alias("_tie"), none.cast(right.select(seen).schema[0].dataType).alias("_seen"), kept.alias("_row"))
    b = right.where(F.col(right_time).isNotNull()).select(*on, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), order.alias("_tie"), seen.alias("_seen"), none.cast(left.select(kept).schema[0].dataType).alias("_row"))
    known = [F.col(k).isNotNull() for k in on]
    for k in known:
        b = b.where(k)
    # The ranges are sampled, so they are fixed before two passes read them.
    places = [*on, "_at", "_side", "_tie"]
    rows = settled(a.unionByName(b).repartitionByRange(*places).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *on).orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("_last", F.last("_seen", ignorenulls=True).over(within))
    # The last right row of a range's last key, and the first key of each range: all that can pass between ranges.
    key = F.struct(*[F.col(k) for k in on])
    ends = rows.groupBy("_range").agg(F.min(key).alias("_first"), F.max(key).alias("_final"), F.max(F.when(F.col("_side") == 0, F.struct(key.alias("k"), F.col("_at").alias("t"), F.col("_tie").alias("o"), F.col("_seen").alias("s")))).alias("_best"))
    ends = ends.withColumn("_best", F.when(F.col("_best.k") == F.col("_final"), F.col("_best")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_best", ignorenulls=True).over(before))
    carried = carried.where(F.col("_before.k") == F.col("_first")).select("_range", *[F.col(f"_first.{k}").alias(k) for k in on], F.col("_before.s").alias("_carried"))
    out = filled.where("_side = 1").join(carried, ["_range", *on], "left")
    got = F.coalesce("_last", "_carried")
    fits = F.col("_at").isNotNull()
    return out.select(*[F.col(f"_row.{c}").alias(c) for c in columns], *[F.when(fits, got[v]).alias(v) for v in ["_time", *values]]).withColumnRenamed("_time", "as_of")
