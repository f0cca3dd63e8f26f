"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once and keeps, for each row, the measurements
and one integer with a bit for each failed rule.  A policy is a versioned set of
rules: ``apply_policy`` keeps the rows without a bit of its mask.  ``ablations``
answers "what would leaving out this rule keep?" from one aggregation by the
bits, whose groups are at most ``2 ** len(RULES)`` and few in fact.

Words are maximal runs of characters other than space and ``\\t \\n \\v \\f \\r``.

Edge cases: a null or empty text has no words and fails the rules on length;
null and repeated ids are kept as rows of their own; ties cannot arise, since
rows do not meet; an empty table gives an empty ledger; columns of the input
whose names clash with the ledger's are left out (``ledger``) or kept as the
input has them (``filter_documents``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
_POSITION = (1 << 31) - 1

#: Name and predicate over the measurements, in the order of their bits.  Integer arithmetic throughout.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 10 * n_words"),
    ("capitals", "100 * n_upper > 40 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
]
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines"],
    "v2": [name for name, _ in RULES],
}
CURRENT = "v2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, whatever ``body`` does with it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _same_neighbour(items: Column, key) -> Column:
    """The entries of a sorted array whose key equals that of the entry before or after."""
    return F.filter(items, lambda x, k: (key(x) == key(F.get(items, k - 1))) | (key(x) == key(F.get(items, k + 1))))


def _repeat_words(words: Column) -> Column:
    """Number of words covered by a 3-word window that the array holds twice or more.

    Hashes tagged with positions are sorted, so that possible repeats are neighbours; only those are
    compared as words.  n log n for a text of n words.
    """
    hashed = F.transform(
        F.slice(words, F.lit(1), F.size(words) - 2),
        lambda x, i: F.shiftleft(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)), 31).bitwiseOR(i.cast("long")),
    )
    maybe = _let(F.sort_array(hashed), lambda s: _same_neighbour(s, lambda x: F.shiftright(x, 31)))

    def spelled(x: Column) -> Column:
        i = x.bitwiseAND(F.lit(_POSITION)).cast("int")
        return F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("window"), i.alias("at"))

    exact = _let(F.sort_array(F.transform(maybe, spelled)), lambda s: _same_neighbour(s, lambda x: x["window"]))
    covered = F.array_distinct(F.flatten(F.transform(exact, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))
    return F.when(F.size(words) >= 4, F.size(covered)).otherwise(0)


def measured(df: DataFrame, text_col: str = "text", into: str = "_m") -> DataFrame:
    """``df`` with a struct column ``into`` of the measurements; each text is split into words once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
        )

    by_words = _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of)
    by_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return df.withColumn(
        into,
        F.struct(
            by_words.alias("w"),
            by_lines.alias("l"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        ),
    )


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measurements and ``failed_bits`` of every row."""
    m = measured(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text").select(
        F.col("_id").alias(id_col), "_m.w.n_words", "_m.w.word_chars", "_m.n_symbols", "_m.l.n_dup_lines", "_m.w.n_repeat_words", "_m.n_upper", "_m.l.n_lines"
    )
    return m.withColumn("failed_bits", _bits())


def _bits(where: dict[str, str] | None = None) -> Column:
    """The rules that fail, as bits; ``where`` says in which columns the measurements are."""
    total = F.lit(0)
    for name, rule in RULES:
        rule = re.sub(r"[a-z_]+", lambda x: (where or {}).get(x[0], x[0]), rule)
        total = total.bitwiseOR(F.when(F.expr(rule), BITS[name]).otherwise(0))
    return total.cast("int")


def apply_policy(ledger_df: DataFrame, policy: str = CURRENT, into: str = "kept") -> DataFrame:
    return ledger_df.withColumn(into, F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(ledger_df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: rows that fail it, and rows that only it rejects."""
    groups = ledger_df.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BITS[name]).alias("bit")) for name in POLICIES[policy]])
    failed = F.col("failed_bits").bitwiseAND(F.lit(mask(policy)))
    return (
        groups.withColumn("r", F.explode(rules))
        .groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"))
        .agg(
            F.sum(F.when(failed.bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(failed == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def with_failed_bits(df: DataFrame, text_col: str = "text", into: str = "_failed_bits") -> DataFrame:
    """``df`` with its ledger's ``failed_bits`` as the column ``into``, which must not be one of its own."""
    m = "_measures_of_rules"
    where = {**{x: f"{m}.w.{x}" for x in ("n_words", "word_chars", "n_repeat_words")}, **{x: f"{m}.l.{x}" for x in ("n_lines", "n_dup_lines")}, **{x: f"{m}.{x}" for x in ("n_symbols", "n_upper")}}
    return measured(df, text_col, m).withColumn(into, _bits(where)).drop(m)


def filter_documents(df: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, without a bit of the policy's mask: every rule is evaluated once, into the bits."""
    own = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*own).alias("row"), F.col(text_col).alias("own_text"))
    bits = F.col("bits").bitwiseAND(F.lit(mask(policy)))
    return with_failed_bits(rows, "own_text", "bits").where(bits == 0).select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, and what only it does, of the documents."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0).alias("base_failed"),
        "kept",
        "failed_bits",
    )


_SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Rows by id; for a table whose ids are unique.
MEASURES_SQL = rf"""
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
       (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
       coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
       (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
       len(l)::BIGINT AS n_lines
FROM (SELECT doc_id, text, {_SQL_WORDS} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {{docs}}) d
LEFT JOIN (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
                FROM (SELECT doc_id, i, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c
                      FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_SQL_WORDS} AS w FROM {{docs}}))
                      WINDOW o AS (PARTITION BY doc_id ORDER BY i))
                WHERE c IS NOT NULL)
          WHERE n > 1)
    GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
BITS_SQL = " + ".join(f"CASE WHEN {rule} THEN {BITS[name]} ELSE 0 END" for name, rule in RULES)
ORACLE = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       ({BITS_SQL}) = 0 AS kept, ({BITS_SQL})::INTEGER AS failed_bits
FROM ({MEASURES_SQL.replace("{docs}", "documents")})
"""
#: Ablations of the current policy, whose mask is every rule.
ABLATIONS_ORACLE = f"""
SELECT rule, bit, coalesce(sum(CASE WHEN (failed & bit) <> 0 THEN 1 ELSE 0 END), 0)::BIGINT AS n_failed, coalesce(sum(CASE WHEN failed = bit THEN 1 ELSE 0 END), 0)::BIGINT AS n_only
FROM (SELECT {BITS_SQL} AS failed FROM ({MEASURES_SQL.replace("{docs}", "documents")})), (VALUES {", ".join(f"('{name}', {BITS[name]})" for name in POLICIES[CURRENT])}) r(rule, bit)
GROUP BY rule, bit
"""
