"""Serving boards: filters, sorting, paging, search, frontiers and change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matches(c: Column | str, query: str) -> Column:
    """Any white-space term of the query in the text, letter case aside; an empty query matches."""
    c = F.col(c) if isinstance(c, str) else c
    terms = query.lower().split()
    return reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(t)) for t in terms]) if terms else F.lit(True)


def in_bucket(c: str, low: float | None, high: float | None) -> Column:
    """Within ``[low, high)``; a value that is missing or not finite is in no bucket."""
    x = F.col(c).cast("double")
    keep = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return keep & (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x < high)


def filtered(df: DataFrame, wanted: dict[str, str], exact: set[str] = frozenset()) -> DataFrame:
    """Rows that meet all column filters: equal for the columns in ``exact``, else containing."""
    for column, value in wanted.items():
        text = F.lower(F.col(column).cast("string"))
        df = df.where(text == value.lower() if column in exact else F.contains(text, F.lit(value.lower())))
    return df


def sorted_rows(df: DataFrame, column: str, key: str, descending: bool = False, blanks: tuple[str, ...] = ("", "-", "?")) -> DataFrame:
    """By number where a cell has one, else by text; blank cells last in either direction."""
    text = F.trim(F.col(column).cast("string"))
    blank = text.isNull() | text.isin(*blanks)
    number = F.when(~blank, F.regexp_replace(text, ",", "").try_cast("double"))
    order = [F.desc_nulls_last, F.desc_nulls_last] if descending else [F.asc_nulls_last, F.asc_nulls_last]
    rows = df.withColumns({"_number": number, "_text": F.when(~blank, F.lower(text))})
    return rows.orderBy(order[0]("_number"), order[1]("_text"), key).drop("_number", "_text")


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page of a sorted board, numbered from 0: a top-k of the pages up to it, then the rest skipped."""
    return df.orderBy(*order).offset(size * number).limit(size)


def search(df: DataFrame, query: str, k: int, key: str, title: str, section: str, body: str) -> DataFrame:
    """The ``k`` best rows in which every term occurs: ten points for the title, three for the section, one for the body."""
    terms = query.strip().lower().split()
    if len(query.strip()) < 2:
        return df.limit(0).withColumn("score", F.lit(0))
    hit = lambda c, t: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t))
    points = [sum((F.when(hit(c, t), n).otherwise(0) for c, n in ((title, 10), (section, 3), (body, 1))), F.lit(0)) for t in terms]
    every = reduce(lambda a, b: a & b, [p > 0 for p in points])
    return df.where(every).withColumn("score", sum(points, F.lit(0))).orderBy(F.desc("score"), key).limit(k)


def pareto(df: DataFrame, by: list[str], cost: str, rank: str) -> DataFrame:
    """Rows that no other of their group beats: none at most as costly has a strictly lower rank.

    The pairwise test is the same as this: no lower rank among the costs up to one's own.  Costs are aggregated first, so
    the running minimum goes over distinct costs, and its result is joined back.
    """
    known = df.where(F.col(cost).isNotNull() & F.col(rank).isNotNull())
    least = known.groupBy(*by, cost).agg(F.min(rank).alias("_least"))
    running = least.withColumn("_best", F.min("_least").over(Window.partitionBy(*by).orderBy(cost).rowsBetween(Window.unboundedPreceding, 0)))
    return known.join(running.select(*by, cost, "_best"), [*by, cost]).where(F.col(rank) <= F.col("_best")).drop("_best").select(*df.columns)


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """``key``, ``change`` (added, removed, changed) and the columns that differ; null equals null."""
    common = columns or [c for c in old.columns if c in new.columns and c != key]
    a = old.select(F.col(key).alias("_ka"), *[F.col(c).alias(f"_a_{c}") for c in common])
    b = new.select(F.col(key).alias("_kb"), *[F.col(c).alias(f"_b_{c}") for c in common])
    rows = a.join(b, F.col("_ka") == F.col("_kb"), "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in common]))
    change = F.when(F.col("_ka").isNull(), "added").when(F.col("_kb").isNull(), "removed").when(F.size(differ) > 0, "changed")
    both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    return rows.select(F.coalesce("_ka", "_kb").alias(key), change.alias("change"), F.when(both, F.array_join(differ, ",")).otherwise("").alias("columns")).where("change IS NOT NULL")


def schema_changes(old: DataFrame, new: DataFrame) -> tuple[list[str], list[str]]:
    """Columns added and removed."""
    return sorted(set(new.columns) - set(old.columns)), sorted(set(old.columns) - set(new.columns))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least, largest and number of distinct finite values of each column, in one pass."""
    finite = {c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c).cast("double")) for c in columns}
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(v).alias("least"), F.max(v).alias("largest"), F.count_distinct(v).alias("n_distinct")).alias(f"_{i}") for i, (c, v) in enumerate(finite.items())])
    return one.select(F.explode(F.array(*[f"_{i}" for i in range(len(columns))])).alias("p")).select("p.*")


def queue(df: DataFrame) -> DataFrame:
    """Requests in the order they are taken: quick before slow, generative first, by status, size and age."""
    return df.orderBy("slow", F.desc("generative"), "status_order", "size_order", "created", "id")


def contributor_counts(df: DataFrame, assignees: str, excluded: list[str]) -> DataFrame:
    """Issues of each assignee, each issue once, most first."""
    rows = df.select(F.explode(F.array_distinct(assignees)).alias("login")).where(~F.col("login").isin(*excluded))
    return rows.groupBy("login").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "login")


def axis_place(c: str, low: float, high: float, pixels: int, log: bool = True, padding: float = 0.0) -> Column:
    """Place of a value on an axis from ``low`` to ``high``, logarithmic or linear, widened by a share at both ends."""
    scale = F.log10 if log else lambda x: x
    first, last = scale(F.lit(float(low))), scale(F.lit(float(high)))
    room = (last - first) * padding
    return (scale(F.col(c).cast("double")) - first + room) / (last - first + 2 * room) * pixels


#: A board's columns before and between those of its tasks, languages and datasets.
FIRST, ABOUT = ["rank", "model", "mean_rank_score"], ["generative_type", "open", "commercial", "merge", "trained_from_scratch", "parameters", "vocabulary_size", "context"]


def in_order(df: DataFrame, orthogonal: list[str], ranks: list[str], datasets: list[str]) -> DataFrame:
    """A board's columns in their order, those of each dataset's version, failures and sizes last; others are left out."""
    name = lambda x: x.replace("-", "_")
    own = [name(x) for x in datasets]
    extra = [f"{x}_{kind}" for kind in ("version", "failures", "scored") for x in own]
    wanted = [*FIRST, *[name(x) for x in orthogonal], *ABOUT, *ranks, *own, *extra]
    if missing := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"a board without {', '.join(missing)}")
    return df.select(*wanted)


def with_scores_of_their_own(df: DataFrame, values: list[str], orthogonal: list[str], blank: str = "-") -> DataFrame:
    """Without models that have orthogonal scores and, in the value columns, nothing but blanks."""
    has = lambda columns: reduce(lambda a, b: a | b, [F.col(c).isNotNull() & (F.col(c).cast("string") != blank) for c in columns], F.lit(False))
    return df.where(has(values) | ~has(orthogonal))


def orthogonal_means(scores: DataFrame, orthogonal: DataFrame, plain_id: Column, order: str) -> DataFrame:
    """``model`` (plain id), ``task`` and ``score``: mean over a task's orthogonal datasets (``dataset``, ``task``) of a
    model's score, the last of its variants' by ``order``."""
    rows = scores.join(orthogonal, "dataset").where(F.col("total").isNotNull() & ~F.isnan("total"))
    last = rows.groupBy(plain_id.alias("model"), "task", "dataset").agg(F.max_by("total", order).alias("total"))
    return last.groupBy("model", "task").agg(F.avg("total").alias("score"))


def pareto_languages(ranks: DataFrame, by: list[str], cost: str, rank: str) -> DataFrame:
    """``model`` and the sorted ``languages`` in which it is on its frontier, in any of its categories (``by`` holds kind,
    category and language)."""
    front = pareto(ranks.where(~F.isnan(F.col(cost).cast("double"))), by, cost, rank)
    return front.groupBy("model").agg(F.sort_array(F.collect_set("language")).alias("languages"))


def top_open(entries: DataFrame, n: int) -> DataFrame:
    """``model`` and ``rank`` of the ``n`` first checkpoints of the most open entries, each once.

    ``entries``: ``name``, ``kind``, ``required_open``, ``open_count`` and ``weights`` (array of model ids in order, null
    where a link names none).  The top-k keeps ``n`` entries at most, since each gives one model or more.
    """
    fit = entries.where((F.col("kind") == "text") & F.col("required_open")).withColumn("weights", F.array_compact("weights")).where(F.size("weights") > 0)
    rows = fit.select("open_count", F.lower("name").alias("name"), F.posexplode("weights").alias("place", "model"))
    first = rows.groupBy("model").agg(F.min(F.struct((-F.col("open_count")).alias("open"), "name", "place")).alias("at"))
    best = first.orderBy("at", "model").limit(n)
    return best.select("model", F.row_number().over(Window.orderBy("at", "model")).alias("rank"))
