"""Filter interaction audit from a histogram of failure masks.

Every filter is evaluated once for each document, as one bit of its mask.  What any order
of the filters keeps, removes or finds redundant depends on the masks alone, so one
aggregation to at most 32 cells a part (a count of all documents, of good and of toxic
ones in each cell) answers all 120 orders; the documents are not read again.

Filter E fails a text that a smaller id has as well.  Texts are grouped by their SHA-256
digest with the least id; the rows of one digest are first added up by part in the tasks,
so that a text of a third of all documents is as many rows as there are tasks and parts,
and nothing is joined to the documents.

The Shapley value of a filter is given as a sum over the orders: a document that fails k
filters is removed by each of them in 120 / k orders.

Edge cases: a null text is an empty one, which fails A, and E where a smaller id has no
text either; a null part is the empty string; labels that are missing or null are neither
good nor toxic, and of several labels of one id one is enough; ids that are equal do not
make each other's text a copy; a null id is neither smaller nor larger than another, so its
row neither fails E nor makes others fail it; texts of any length are taken whole; an
empty table has no parts and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table

WORDS = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_UPPER_PERCENT = 100, 80, 10
SYMBOLS = "[#$%&*|]"
FILTERS = "ABCDE"
#: Bit of each filter in a mask.
BITS = {name: 1 << i for i, name in enumerate(FILTERS)}
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_mask(text: Column) -> Column:
    """The bits of the filters that a text fails by itself: all but E."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    # An array of one, so that the words are found once.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))[0]
    short_or_repetitive = F.transform(
        F.array(counts), lambda c: F.when(c["n"] < LEAST_WORDS, BITS["A"]).otherwise(0).bitwiseOR(F.when(100 * c["distinct"] < LEAST_DISTINCT_PERCENT * c["n"], BITS["B"]).otherwise(0))
    )[0]
    shouting = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MOST_UPPER_PERCENT * F.length(text), BITS["C"]).otherwise(0)
    symbols = F.when(text.rlike(SYMBOLS), BITS["D"]).otherwise(0)
    return short_or_repetitive.bitwiseOR(shouting).bitwiseOR(symbols).cast("int")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good`` and ``toxic``: documents of each part that fail just these filters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(F.col(text_col)).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    one = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # Rows of one id, text and part first: they are copies of no one among themselves.
    counts = ("n", "good", "toxic")
    by_id = one.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", *counts))).alias("first")
    no_id = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"{c}_no_id") for c in counts]
    by_text = by_id.groupBy("digest", "part", "mask").agg(*[F.sum(c).alias(c) for c in counts], *no_id, first)
    # A text's least id over its parts: the window holds a row for each part that has the text.
    placed = by_text.withColumn("is_first", F.coalesce(F.col("first.id") == F.min("first.id").over(Window.partitionBy("digest")), F.lit(False)))
    own = F.struct(*[(F.col(f"{c}_no_id") + F.when(F.col("is_first"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in counts])
    split = placed.withColumn("own", own).select(
        "part",
        F.explode(
            F.array(
                F.struct("mask", "own.n", "own.good", "own.toxic"),
                F.struct(F.col("mask").bitwiseOR(F.lit(BITS["E"])).alias("mask"), *[(F.col(c) - F.col(f"own.{c}")).alias(c) for c in counts]),
            )
        ).alias("cell"),
    )
    return split.groupBy("part", F.col("cell.mask").alias("mask")).agg(*[F.sum(f"cell.{c}").alias(c) for c in counts])


def audit(histogram: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the cells alone."""
    wide = histogram.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(CELLS)]).alias(c) for c in ("n", "good", "toxic")])
    orders = F.array(*[F.struct(F.lit(o).alias("name"), F.array(*[F.lit(BITS[x]) for x in o]).alias("places")) for o in ORDERS])
    parts = wide.withColumn("order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    places = F.col("order.places")
    earlier = F.aggregate(F.slice(places, F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b))
    parts = parts.withColumn("own", places[F.col("step") - 1]).withColumn("before", earlier)

    def total(of: str, where) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(where(m), F.get(F.col(of), m)).otherwise(0))

    def fails(m: Column) -> Column:
        return m.bitwiseAND(F.col("own")) != 0

    def passed(m: Column) -> Column:
        return m.bitwiseAND(F.col("before")) == 0

    in_orders = F.array(*[F.lit(len(ORDERS) // max(1, m.bit_count())) for m in range(CELLS)])
    shapley = F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(fails(m), F.get("n", m) * F.get(in_orders, m)).otherwise(0))
    return parts.select(
        "part",
        F.col("order.name").alias("filter_order"),
        F.col("step").cast("int").alias("step"),
        total("n", lambda m: passed(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: passed(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~passed(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", lambda m: passed(m) & fails(m)).alias("good_lost"),
        total("toxic", lambda m: passed(m) & fails(m)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
ORACLE = rf"""
WITH marks AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_UPPER_PERCENT} * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 8 ELSE 0 END
        + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask
    FROM w LEFT JOIN marks USING (doc_id)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
      FROM {_LETTERS} a(f, b), {_LETTERS} b(f, b), {_LETTERS} c(f, b), {_LETTERS} d(f, b), {_LETTERS} e(f, b)
      WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask)
SELECT part, filter_order, step,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & own <> 0), 0)::BIGINT AS shapley
FROM h, s GROUP BY part, filter_order, step
"""
