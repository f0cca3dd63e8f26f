"""Mixing sources to target weights, in DataFrame functions only.

Leaves are (domain, language, source).  A leaf can give its tokens ``max_epochs`` times.
The budget goes down the tree: at each node it is shared among the children by weight;
a child that cannot take its share takes what its subtree has, and what is left over is
shared among its siblings in the same way.  Only what all siblings together cannot take
has lowered their parent's own limit, and so has gone to the parent's siblings.

A leaf then takes whole epochs of its documents and a prefix of one more: the documents in
the order of a hash of seed, epoch and id, while the sum of their tokens is within what is
left.  The prefix's end is found in steps, so that no leaf is ordered in one task: sums by
the hash's first two digits give the bucket in which it falls, sums by the next two the
bucket within that, and only that one's documents, one in 65,536, are ordered.  A token is a word (a maximal run without white space).

All sums are whole numbers; products of tokens and weights are decimals of 38 digits, so a
budget of 10 ** 14 tokens over 10 ** 6 sources is far from their end.  The children of one
node are ordered in one task, so a node should have less than some ten million of them.

Edge cases: a null text has no tokens; a null language or source is a leaf value of its
own; a leaf without tokens gives nothing; documents of equal id in a leaf fall on the same
side; an empty table gives an empty result; other columns pass through whatever their names (``mix``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table, written
from plumbline.llm.op04_quality_rules import WORD

LEVELS = ["domain", "lang", "source"]
DOMAINS = ["web", "books", "news", "code"]
#: Digits of the hash that name a bucket, step by step: a leaf has 256 buckets to order in each.
_BUCKET_DIGITS = [2, 4]
#: Leaves whose table may be broadcast: some megabytes.  With more, the documents are joined to it by a shuffle.
BROADCAST_LEAVES = 100_000


@dataclass(frozen=True)
class Mixture:
    """Weights are whole numbers; a value not named has weight 1."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 5, "books": 2, "news": 2, "code": 1})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    target_percent: int = 60
    max_epochs: int = 2
    seed: int = 17

    def weight(self, level: str) -> Column:
        named = {"domain": self.domains, "lang": self.langs, "source": self.sources}[level]
        out = F.lit(1)
        for value, weight in named.items():
            out = F.when(F.col(level) == value, weight).otherwise(out)
        return out.cast("long")


def _leaf_columns() -> list[Column]:
    """Domain, language and source of a document; the domain follows from the number in the source's name."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    return [F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(number, F.lit(len(DOMAINS))) + 1).cast("int")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]


def _id_text() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def token_table(docs: DataFrame) -> DataFrame:
    """Id, leaf and tokens of every document."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", *_leaf_columns(), n.alias("n_tokens"))


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def _shared_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``children`` with ``budget``: the parent's ``parent_budget`` shared by ``weight`` within ``cap``.

    In the order of cap for weight, the children that cannot take their share come first; each is tried
    against what those before it leave.
    """
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    group = Window.partitionBy(*parents)
    out = children.withColumn("_left", F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_weights", F.sum("weight").over(after))
    out = out.withColumn("_full", _wide("cap") * _wide("_weights") <= _wide("weight") * _wide("_left"))
    out = out.withColumn("_rest", F.col("parent_budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(group))
    out = out.withColumn("_rest_weights", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(group))
    budget = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("least(cap, cast(weight AS decimal(38, 0)) * cast(_rest AS decimal(38, 0)) div greatest(_rest_weights, 1))"))
    return out.withColumn("budget", budget).drop("_left", "_weights", "_full", "_rest", "_rest_weights")


def budgets(tokens: DataFrame, mixture: Mixture) -> DataFrame:
    """A row for each leaf: ``have`` (its tokens) and ``budget``.  The tree is small: it has no documents."""
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("have")).withColumn("cap", F.col("have") * mixture.max_epochs)
    level, parents = None, []
    for depth, name in enumerate(LEVELS, 1):
        nodes = leaves.groupBy(*LEVELS[:depth]).agg(F.sum("cap").alias("cap"), F.sum("have").alias("have")).withColumn("weight", mixture.weight(name))
        if level is None:
            total = Window.partitionBy()
            nodes = nodes.withColumn("parent_budget", F.expr(f"least(sum(have) over () * {mixture.target_percent} div 100, sum(cap) over ())"))
        else:
            nodes = nodes.join(level.select(*parents, F.col("budget").alias("parent_budget")), parents)
        level, parents = _shared_out(nodes, parents, name), LEVELS[:depth]
    return level.select(*LEVELS, "have", "budget")


def _hash(mixture: Mixture) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mixture.seed)), F.col("epochs").cast("string"), _id_text()).cast("binary"))


def _small(leaves: DataFrame) -> DataFrame:
    """A stored table with a row for each leaf, to be joined to documents: a leaf with a third of them stays spread out."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def leaf_cuts(tokens: DataFrame, mixture: Mixture) -> DataFrame:
    """For each leaf with a budget: whole ``epochs``, and the last hash of the prefix of the next (``cut``, null: none)."""
    leaves = written(budgets(tokens, mixture).where("have > 0").withColumn("epochs", F.expr("budget div have")).withColumn("rest", F.expr("budget % have")), "mix-leaves")
    rows = tokens.join(_small(leaves), LEVELS).select(*LEVELS, "n_tokens", _hash(mixture).alias("h"))
    edge, before = leaves.select(*LEVELS, F.lit("").alias("bucket"), F.col("rest").alias("room")), 0
    for digits in _BUCKET_DIGITS:
        edge, before = _edge(_within(rows, edge, before), digits), digits
    inside = _within(rows, edge, before).groupBy(*LEVELS, "h").agg(F.sum("n_tokens").alias("n"), F.first("room").alias("room"))
    along = Window.partitionBy(*LEVELS).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("total", F.sum("n").over(along)).where("total <= room").groupBy(*LEVELS).agg(F.max("h").alias("last"))
    cuts = leaves.join(edge.select(*LEVELS, "bucket"), LEVELS, "left").join(last, LEVELS, "left")
    # A prefix that ends before the edge bucket's first document ends just below the bucket.
    return written(cuts.select(*LEVELS, "have", "budget", "epochs", F.coalesce("last", "bucket").alias("cut")), "mix-cuts")


def _within(rows: DataFrame, edge: DataFrame, digits: int) -> DataFrame:
    """The rows of each leaf's edge bucket, with the ``room`` that is left in it."""
    return rows.withColumn("bucket", F.substring("h", 1, digits)).join(_small(edge), [*LEVELS, "bucket"]).drop("bucket")


def _edge(rows: DataFrame, digits: int) -> DataFrame:
    """For each leaf the first bucket that goes over the room, and what is left of it there; all buckets before are taken whole."""
    sums = rows.groupBy(*LEVELS, F.substring("h", 1, digits).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("room").alias("room"))
    along = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("total", F.sum("n").over(along)).where("total > room")
    first = over.groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("room") - F.col("total") + F.col("n")).alias("room")), "bucket").alias("e"))
    return written(first.select(*LEVELS, "e.bucket", "e.room"), "mix-edges")


def _copies(mixture: Mixture) -> Column:
    return (F.col("epochs") + F.when(_hash(mixture) <= F.col("cut"), 1).otherwise(0)).cast("long")


def selected(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """Id, leaf, tokens and ``copies`` (epochs that hold it) of every document taken at least once."""
    tokens = written(token_table(docs), "mix-tokens")
    return tokens.join(_small(leaf_cuts(tokens, mixture)), LEVELS).withColumn("copies", _copies(mixture)).where("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")


def mix(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as its leaf's epochs hold it.  Texts are not shuffled."""
    cuts = _small(leaf_cuts(written(token_table(docs), "mix-tokens"), mixture)).select(*LEVELS, "epochs", "cut")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_leaf_columns(), F.col("doc_id"))
    taken = rows.join(cuts, LEVELS).withColumn("copies", _copies(mixture)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), Mixture())


def _weight_sql(column: str, named: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in named.items()) + " ELSE 1 END" if named else "1"


def _level_sql(nodes: str, parents: list[str], name: str, weight: str) -> str:
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return f"""
    SELECT * EXCLUDE (lft, wts, ful, rst, rwt), CASE WHEN ful THEN cap ELSE least(cap, (weight * rst) // greatest(rwt, 1)) END AS budget
    FROM (SELECT *, parent_budget - sum(CASE WHEN ful THEN cap ELSE 0 END) OVER ({by}) AS rst, sum(CASE WHEN ful THEN 0 ELSE weight END) OVER ({by}) AS rwt
          FROM (SELECT *, cap * wts <= weight * lft AS ful
                FROM (SELECT *, parent_budget - coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
                             sum(weight) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wts
                      FROM (SELECT *, {weight} AS weight FROM ({nodes})))))"""


def sql(docs: str, mixture: Mixture) -> str:
    """Rows ``doc_id, domain, lang, source, n_tokens, copies``."""
    listed = ", ".join(f"'{d}'" for d in DOMAINS)
    one = _level_sql(f"SELECT *, least(sum(have) OVER () * {mixture.target_percent} // 100, sum(cap) OVER ()) AS parent_budget FROM (SELECT domain, sum(cap) AS cap, sum(have) AS have FROM leaves GROUP BY ALL)", [], "domain", _weight_sql("domain", mixture.domains))
    two = _level_sql("SELECT n.*, p.budget AS parent_budget FROM (SELECT domain, lang, sum(cap) AS cap, sum(have) AS have FROM leaves GROUP BY ALL) n JOIN one p USING (domain)", ["domain"], "lang", _weight_sql("lang", mixture.langs))
    three = _level_sql("SELECT n.*, p.budget AS parent_budget FROM leaves n JOIN two p USING (domain, lang)", ["domain", "lang"], "source", _weight_sql("source", mixture.sources))
    return rf"""
WITH tokens AS (
    SELECT doc_id, [{listed}][(coalesce(TRY_CAST(regexp_extract(source, '(\d+)$', 1) AS BIGINT), 0) % {len(DOMAINS)}) + 1] AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM {docs}),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS have, sum(n_tokens) * {mixture.max_epochs} AS cap FROM tokens GROUP BY ALL),
one AS ({one}), two AS ({two}), three AS ({three}),
taken AS (
    SELECT t.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h) AS total
    FROM (SELECT t.*, b.budget // b.have AS epochs, b.budget % b.have AS rest, md5('{mixture.seed}:' || (b.budget // b.have)::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')) AS h
          FROM tokens t JOIN three b USING (domain, lang, source) WHERE b.have > 0) t)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN total <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM taken WHERE epochs + CASE WHEN total <= rest THEN 1 ELSE 0 END > 0
"""


ORACLE = sql("documents", Mixture())
