"""Sentence boundaries learnt without labels, after Kiss and Strunk (Computational Linguistics, 2006).

What a full stop means in a corpus is learnt from counts of its words:

1. word types that carry a stop far more often than chance, short ones and ones with inner
   stops before others, are abbreviations (log-likelihood ratio, scaled by length);
2. pairs of words about a stop that stand together more often than chance are collocations,
   between which no sentence ends;
3. words that follow a sure end of a sentence more often than chance start sentences, and
   each type's spelling (seen in lower case, seen capitalised within a sentence) tells
   whether a capital after an abbreviation is a start.

The corpus is read once: its different words, and its different pairs of a word that ends with
a mark and the word after it, are counted as they are written, and only these are taken apart.
What is learnt stays in tables, of any size; ``Boundaries.counted`` joins them to a table's
texts.  As column expressions (``count``, ``sentences``) the lists go into the plan as constant
sets, and ``MostEntries`` is raised where one is longer than ``MOST_ENTRIES``.

Words are split at white space; a text of any length is one array of words.  A null text has
no sentence, as has one without words; the last word always ends one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import discard, stored

#: Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
_H1 = 0.99
MOST_ENTRIES = 200_000
_OPENERS, _CLOSERS, _MARKS = "\"'“‘«([{¿¡", "\"'”’»)]}", ".,;:!?…"
#: A word that ends with a mark of an end, quotes and brackets aside, with the word after it.
_MARKED = r"""(?<!\S)(?=(\S*[.!?…]["'”’»)\]}]*+\s+\S+))"""


class MostEntries(ValueError):
    """A learnt list is too long to be a constant of a plan."""


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def _marked(text: Column) -> Column:
    """Each word that may end a sentence with the word after it."""
    return F.regexp_extract_all(text, F.lit(_MARKED), F.lit(1))


def _core(word: Column) -> Column:
    """A word without quotes and brackets around it."""
    return F.rtrim(F.ltrim(word, F.lit(_OPENERS)), F.lit(_CLOSERS))


def _of(core: Column) -> dict[str, Column]:
    """A word's ``type`` (lower case, without the stop or other marks at its end; numbers are one), whether it ends with a
    stop or with another mark that ends sentences, and its first letter's case."""
    plain = F.lower(F.rtrim(core, F.lit(_MARKS)))
    stops = core.endswith("..")
    return {
        "type": F.when(plain.rlike(r"^[-+]?[\d.,]*\d$"), F.lit("##")).otherwise(plain),
        "stop": core.endswith(".") & ~stops,
        "mark": stops | core.endswith("!") | core.endswith("?") | core.endswith("…"),
        "upper": core.rlike(r"^\p{Lu}"),
        "lower": core.rlike(r"^\p{Ll}"),
        "initial": core.endswith(".") & (F.length(core) == 2) & core.rlike(r"^\p{L}"),
    }


def _annotated(text: Column) -> Column:
    """``_of`` each word of a text; arrays of one, so that a word is taken apart once."""
    return F.transform(words(text), lambda word: F.transform(F.array(_core(word)), lambda core: F.struct(*[c.alias(n) for n, c in _of(core).items()]))[0])


def _taken_apart(df: DataFrame, **written: Column) -> DataFrame:
    """``df`` with ``_of`` each of some words, under their names and an underscore."""
    df = df.withColumns({f"{x}_core": _core(word) for x, word in written.items()})
    return df.withColumns({f"{x}_{n}": c for x in written for n, c in _of(F.col(f"{x}_core")).items()}).drop(*[f"{x}_core" for x in written])


def _pair_apart(df: DataFrame, pair: str) -> DataFrame:
    return _taken_apart(df.withColumn(pair, F.split(pair, r"\s+")), a=F.get(pair, 0), b=F.get(pair, 1)).drop(pair)


def _log_l(k: Column, n: Column, p: Column) -> Column:
    """Logarithm of the likelihood of ``k`` in ``n`` at probability ``p``; nothing times the logarithm of nothing is nothing."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)


def association(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of two words that stand together ``both`` times."""
    p, p1 = second / total, both / first
    p2 = (second - both) / (total - first)
    return 2 * (_log_l(both, first, p1) + _log_l(second - both, total - first, p2) - _log_l(both, first, p) - _log_l(second - both, total - first, p))


@dataclass(frozen=True)
class Counted:
    """Numbers of sentences that a table has already, where ``Boundaries`` are asked for."""

    n: Column

    def count(self, text: Column) -> Column:
        return self.n


@dataclass(frozen=True)
class Boundaries:
    #: Types that a stop may follow within a sentence, and whether they are ``abbreviation``: others stand first in a collocation only.
    firsts: DataFrame
    #: Types ``first`` and ``next`` that stand about a stop within a sentence.
    pairs: DataFrame
    #: Types on which a capital starts a sentence: ``starter``, or ``lower``.
    heads: DataFrame

    @cached_property
    def abbreviations(self) -> frozenset[str]:
        return _list(self.firsts.where("abbreviation"), F.col("type"))

    @cached_property
    def collocations(self) -> frozenset[str]:
        return _list(self.pairs, F.concat("first", F.lit(" "), "next"))

    @cached_property
    def starters(self) -> frozenset[str]:
        return _list(self.heads.where("starter"), F.col("type"))

    @cached_property
    def lower(self) -> frozenset[str]:
        """Types seen in lower case and never capitalised within a sentence: a capital on them starts a sentence."""
        return _list(self.heads.where("lower"), F.col("type"))

    def counted(self, df: DataFrame, keep: list[str], text: str = "text", n: str = "n_sentences") -> DataFrame:
        """``keep`` of every row with its text's number of sentences: the same as ``count``, whatever the lists' lengths.

        Texts are read once and do not move; a shuffle has a row for each text and for each different pair of types
        in it that the lists decide on, not for each word.
        """
        # Rows are numbered before they are taken apart, so that equal ones stay two.
        rows = df.select(F.monotonically_increasing_id().alias("_row"), *keep, F.coalesce(F.col(text).rlike(r"\S"), F.lit(False)).cast("long").alias("_any"), _marked(F.col(text)).alias("_pairs"))
        rows = rows.select("_row", *keep, "_any", F.explode_outer("_pairs").alias("_pair"))
        rows = _pair_apart(rows, "_pair").join(self.firsts.withColumnRenamed("type", "a_type"), "a_type", "left")
        abbreviation, listed, number = F.coalesce("abbreviation", F.lit(False)), F.col("abbreviation").isNotNull(), F.col("a_type") == "##"
        # What ends a sentence unless the lists keep it together, of all that is no abbreviation's stop.
        unless = F.when(F.col("a_initial"), False).when(number, ~F.col("b_lower")).otherwise(True)
        asked = F.col("a_stop") & F.when(abbreviation, ~F.col("a_initial") & F.col("b_upper")).otherwise(listed & unless)
        sure = F.when(F.col("a_mark"), ~F.col("b_lower")).when(F.col("a_stop"), ~asked & ~abbreviation & unless).otherwise(False)
        names = ["_row", *keep, "_any"]
        rows = rows.select(*names, sure.cast("long").alias("_sure"), F.when(asked, F.col("a_type")).alias("first"), F.when(asked, F.col("b_type")).alias("next"), F.when(asked, abbreviation).alias("_short"))
        rows = stored(rows.groupBy(*names, "first", "next", "_short").agg(F.sum("_sure").alias("_sure"), F.count(F.lit(1)).alias("_n")), "sentences-of-texts")
        open_ = rows.where("first IS NOT NULL").join(self.pairs.withColumn("_kept", F.lit(True)), ["first", "next"], "left").join(self.heads.select(F.col("type").alias("next"), F.lit(True).alias("_head")), "next", "left")
        open_ = open_.select(*names, F.when(F.col("_kept").isNull() & (~F.col("_short") | F.col("_head").isNotNull()), F.col("_n")).otherwise(0).alias("_sure"))
        total = rows.select(*names, "_sure").unionByName(open_).groupBy(*names).agg(F.sum("_sure").alias("_sure"))
        return total.select(*keep, (F.col("_sure") + F.col("_any")).alias(n))

    def ends(self, text: Column) -> Column:
        """For each word of a text, whether a sentence ends with it."""

        def among(x: Column, names: frozenset[str]) -> Column:
            return x.isin(sorted(names)) if names else F.lit(False)

        def last(w: Column, following: Column) -> Column:
            kept = among(F.concat(w["type"], F.lit(" "), following["type"]), self.collocations)
            start = following["upper"] & (among(following["type"], self.starters) | among(following["type"], self.lower))
            after_abbreviation = ~w["initial"] & start
            after_number = ~following["lower"]
            stop = F.when(kept, False).when(among(w["type"], self.abbreviations) | w["initial"], after_abbreviation).when(w["type"] == "##", after_number).otherwise(True)
            return F.when(following.isNull(), True).when(w["mark"], ~following["lower"]).when(w["stop"], stop).otherwise(False)

        # An array of one, so that the words are taken apart once.
        return F.transform(F.array(_annotated(text)), lambda ws: F.transform(ws, lambda w, i: last(w, F.get(ws, i + 1))))[0]

    def count(self, text: Column) -> Column:
        return F.size(F.filter(self.ends(text), lambda x: x)).cast("long")

    def sentences(self, text: Column) -> Column:
        """A text's sentences, each its words joined by one space."""
        both = F.struct(words(text).alias("w"), F.filter(F.transform(self.ends(text), lambda e, i: F.when(e, i)), lambda x: x.isNotNull()).alias("at"))

        def cut(s: Column) -> Column:
            return F.transform(s["at"], lambda at, k: F.array_join(F.slice(s["w"], F.coalesce(F.get(s["at"], k - 1), F.lit(-1)) + 2, at - F.coalesce(F.get(s["at"], k - 1), F.lit(-1))), " "))

        return F.transform(F.array(both), cut)[0]


def _list(df: DataFrame, entry: Column) -> frozenset[str]:
    rows = df.select(entry).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise MostEntries(f"more than {MOST_ENTRIES} entries were learnt: use Boundaries.counted, which joins them, or raise the thresholds")
    return frozenset(r[0] for r in rows)


def _abbreviations(types: DataFrame) -> DataFrame:
    """The ``type`` of those that are abbreviations, of types with their numbers ``n`` and ``stops``."""
    n_all, k_all = types.agg(F.sum("n").cast("double"), F.sum("stops").cast("double")).head()
    if not k_all or k_all == n_all:
        return types.select("type").limit(0)
    k, n, chance = F.col("stops").cast("double"), F.col("n").cast("double"), k_all / n_all
    ratio = -2 * (k * log(chance) + (n - k) * log(1 - chance) - k * log(_H1) - (n - k) * log(1 - _H1))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    score = ratio * F.exp(-letters.cast("double")) * (inner + 1) * F.pow(letters.cast("double"), -(n - k))
    return types.where("stops > 0 AND type <> '##' AND type RLIKE '\\\\p{L}'").where(score >= ABBREVIATION).select("type")


def learn(df: DataFrame, text: str = "text") -> Boundaries:
    """What the texts of ``df`` tell about their sentences: one pass over them, then aggregations of what is different in it."""
    x = F.col(text)
    # As written: words, pairs about a mark (they hold white space), and each text's first word (behind a space).
    written = F.concat(F.split(x, r"\s+"), _marked(x), F.array(F.concat(F.lit(" "), F.regexp_extract(x, r"^\s*(\S+)", 1))))
    seen = stored(df.select(F.explode(written).alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    first, paired = F.col("w").startswith(" "), F.col("w").rlike(r"\s")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    words_ = _taken_apart(seen.where(~paired), w=F.col("w")).where("w_type <> ''")
    words_ = stored(words_.groupBy(F.col("w_type").alias("type")).agg(F.sum("n").alias("n"), count(F.col("w_stop")).alias("stops"), F.max("w_lower").alias("lower"), count(F.col("w_upper")).alias("upper")), "types")
    short = stored(_abbreviations(words_), "abbreviations")
    led = _pair_apart(seen.where(paired & ~first), "w").join(short.select(F.col("type").alias("a_type"), F.lit(True).alias("short")), "a_type", "left")
    short_ = F.col("short").isNotNull()
    ended = F.col("a_mark") | (F.col("a_stop") & ~short_ & ~F.col("a_initial") & (F.col("a_type") != "##"))
    # Pairs about a stop that may not be an end: after abbreviations, initials and numbers.
    about = F.col("a_stop") & (F.col("a_type") != "") & (short_ | F.col("a_initial") | (F.col("a_type") == "##"))
    led = stored(led.where("b_type <> ''").groupBy(F.when(about, F.col("a_type")).alias("first"), F.col("b_type").alias("type")).agg(F.sum("n").alias("n"), count(ended).alias("after_end"), count(F.col("b_upper")).alias("upper")), "led")
    # A capital within a sentence is one that neither starts a text nor follows a mark.
    starts = _taken_apart(seen.where(first), w=F.ltrim("w")).groupBy(F.col("w_type").alias("type")).agg((-count(F.col("w_upper"))).alias("upper"))
    types = words_.select("*", F.lit(0).cast("long").alias("after_end")).unionByName(starts, True).unionByName(led.select("type", (-F.col("upper")).alias("upper"), "after_end"), True)
    types = types.groupBy("type").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "stops", "upper", "after_end")], F.max("lower").alias("lower")).where("n > 0")
    n_all, n_ends = [F.lit(v or 0.0) for v in words_.agg(F.sum("n").cast("double")).head()] + [F.lit(v or 0.0) for v in led.agg(F.sum("after_end").cast("double")).head()]
    may_start = (F.col("after_end") > 0) & (F.col("after_end") * n_all > F.col("n") * n_ends) & (n_all > n_ends)
    starter = F.when(may_start, association(F.col("after_end"), n_ends, F.col("n"), n_all) >= STARTER).otherwise(False)
    types = stored(types.select("type", "n", "stops", (F.col("lower") & (F.col("upper") == 0) & (F.col("n") > 1)).alias("lower"), starter.alias("starter")), "types-and-starts")
    both = led.where("first IS NOT NULL AND n > 1").select("first", F.col("type").alias("next"), F.col("n").cast("double").alias("both"))
    scored = both.join(types.select(F.col("type").alias("first"), F.col("stops").alias("c1")), "first").join(types.select(F.col("type").alias("next"), F.col("n").alias("c2"), "starter"), "next")
    together = F.when((F.col("both") * n_all > F.col("c1") * F.col("c2")) & (n_all > F.col("c1")), association(F.col("both"), F.col("c1"), F.col("c2"), n_all) >= COLLOCATION).otherwise(False)
    pairs = stored(scored.where(together & ~F.col("starter")).select("first", "next"), "collocations")
    heads = stored(types.where("lower OR starter").select("type", "lower", "starter"), "starts")
    named = short.select("type", F.lit(True).alias("abbreviation")).unionByName(pairs.select(F.col("first").alias("type"), F.lit(False).alias("abbreviation")))
    firsts = stored(named.groupBy("type").agg(F.max("abbreviation").alias("abbreviation")), "firsts")
    for table in (seen, words_, short, led, types):
        discard(table)
    return Boundaries(firsts, pairs, heads)
