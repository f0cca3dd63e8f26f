"""Line deduplication by distinct-site spread.

A line that stands on many sites is boilerplate.  Each line's sites are counted by a
HyperLogLog sketch, merged in the tasks before the shuffle and again after it.  Lines
whose estimate is near the threshold get an exact distinct count, so that no decision
rests on the sketch's error.  Lines at or over the threshold go from every document.

With ``spare_copies`` a document without a word outside such lines stays as it is: it is
a copy of a text that stands on many sites, not a page around which boilerplate stands,
and where all copies lost all lines none would be left to choose from.

Two lines are the same if they are equal after white space at their ends is cut; lines
without a word are neither counted nor removed.

Edge cases: a null text has no lines and stays null; a null site adds nothing to a
line's spread; a line repeated in a document counts once, ties do not arise; repeated rows
and rows of equal or null id are handled each by its own text (what is flagged depends on
the lines only); a text of any length is handled whole, in work that follows its number of
lines however many are flagged; an empty table gives an empty result; other columns pass through whatever their names
(``without_boilerplate``) or are ignored (``line_report``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import small_enough, table, written
from plumbline.llm.op04_quality_rules import WORD

MIN_SITES = 10
#: Sketches of ``2 ** LG_K`` registers: a standard error of 1.04 / 64, so BAND is six of them.
LG_K = 12
BAND = 0.1
_ENDS = " \t\n\x0b\f\r"


def _key(line: Column) -> Column:
    # As text: arrays of binary values are made distinct without a hash table.
    return F.md5(F.btrim(line, F.lit(_ENDS)).cast("binary"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_sites(df: DataFrame, site_col: str, text_col: str = "text") -> DataFrame:
    """``line`` (128-bit hash) and ``site``: a row for each distinct line of each document."""
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text_col)), lambda x: x.rlike(WORD)), _key))
    return df.select(F.col(site_col).alias("site"), F.explode(keys).alias("line"))


def boilerplate_lines(df: DataFrame, site_col: str, text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """``line`` (128-bit hash) of the lines that stand on ``min_sites`` sites or more."""
    spread = line_sites(df, site_col, text_col)
    near = max(1.0, BAND * min_sites)
    # A line in fewer documents than ``min_sites`` cannot reach it, whatever the sketch says.
    sketched = spread.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    maybe = written(sketched.select("line", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites - near), "line-estimates")
    sure = maybe.where(F.col("estimate") > min_sites + near).select("line")
    close = written(maybe.where(F.col("estimate") <= min_sites + near).select("line"), "line-near")
    # A line in a third of all documents must not be one task's: each (line, site) is reduced to one row in the
    # tasks, before the count where the lines to count are few enough to broadcast, and before the join else.
    if small_enough(close):
        pairs = spread.join(F.broadcast(close), "line", "left_semi").distinct()
    else:
        pairs = spread.distinct().join(close, "line", "left_semi")
    exact = pairs.groupBy("line").agg(F.count("site").alias("n_sites"))
    return sure.unionByName(exact.where(F.col("n_sites") >= min_sites).select("line"))


def _cut(df: DataFrame, site_col: str, id_col: str, text_col: str, min_sites: int, spare_copies: bool) -> DataFrame:
    """``row`` (the input's columns) and ``cut``: ``kept`` (the text that stays), ``n_lines`` and ``n_removed``."""
    flagged = written(boilerplate_lines(df, site_col, text_col, min_sites), "boilerplate")
    if small_enough(flagged):
        flagged = F.broadcast(flagged)
    digest = F.md5(F.col(text_col).cast("binary"))
    # Places of flagged lines, by id and text: rows that are equal in both are alike, null ids are no one group.
    # The digest goes into the exploded array: beside it, it would be computed again for each line.
    keys = F.transform(_lines(F.col(text_col)), lambda x: F.when(x.rlike(WORD), _key(x)))
    placed = F.transform(F.array(digest), lambda d: F.transform(keys, lambda key, i: F.struct(d.alias("digest"), i.alias("place"), key.alias("line"))))[0]
    own = df.select(F.col(id_col).alias("id"), F.explode(placed).alias("own")).select("id", "own.*").where("line IS NOT NULL")
    bad = own.join(flagged, "line").groupBy("id", "digest").agg(F.collect_set("place").alias("bad"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("own_id"), digest.alias("own_digest"))
    rows = rows.join(bad, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest")), "left").select("row", "bad")
    text = F.col("row").getField(text_col)
    lines = _lines(text)
    touched = F.size("bad") > 0
    if spare_copies:
        touched = touched & (F.size(F.filter(lines, lambda x: x.rlike(WORD))) > F.size("bad"))
    touched = F.coalesce(F.col("bad").isNotNull() & touched, F.lit(False))
    # A hashed difference of places: the work follows the number of lines, however many are flagged.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "bad")
    remaining = F.transform(F.array(lines), lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n"))[0]
    kept = F.when(touched, remaining).otherwise(text)
    n_removed = F.when(touched, F.size("bad")).otherwise(0).cast("long")
    return rows.select("row", F.struct(kept.alias("kept"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), n_removed.alias("n_removed")).alias("cut"))


def line_report(df: DataFrame, site_col: str, id_col: str = "doc_id", text_col: str = "text", min_sites: int = MIN_SITES, spare_copies: bool = False) -> DataFrame:
    """``id_col``, ``kept`` (the text that stays), ``n_lines`` and ``n_removed`` of every row."""
    rows = _cut(df.select(*dict.fromkeys([id_col, site_col, text_col])), site_col, id_col, text_col, min_sites, spare_copies)
    return rows.select(F.col("row").getField(id_col).alias(id_col), "cut.kept", "cut.n_lines", "cut.n_removed")


def without_boilerplate(df: DataFrame, site_col: str, id_col: str = "doc_id", text_col: str = "text", min_sites: int = MIN_SITES, spare_copies: bool = False, length_col: str | None = None) -> DataFrame:
    """The rows of ``df``, its columns as they are but for the text, and the text's length (``length_col``) where it is cut."""
    rows = _cut(df, site_col, id_col, text_col, min_sites, spare_copies)
    new = {text_col: F.col("cut.kept")}
    if length_col:
        new[length_col] = F.when(F.col("cut.n_removed") > 0, F.length("cut.kept")).otherwise(F.col("row").getField(length_col)).cast(df.schema[length_col].dataType)
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_report(table(spark, sf_dir, "documents"), "source")
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_HAS_WORD = r"regexp_matches(line, '[^\x20\x09-\x0D]')"
#: Rows ``doc_id, kept, n_lines, n_removed``; for a table whose ids are unique.
SQL = rf"""
SELECT d.doc_id, d.text, coalesce(kept, d.text) AS kept, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_bad, 0)::BIGINT AS n_removed
FROM {{docs}} d LEFT JOIN (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_bad, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS kept
    FROM (SELECT l.doc_id, l.line, l.pos, f.key IS NOT NULL AND l.has_word AS bad
          FROM (SELECT doc_id, line, pos, trim(line, e'\t\n\x0b\x0c\r ') AS key, {_HAS_WORD} AS has_word
                FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {{docs}})) l
          LEFT JOIN (SELECT key FROM (SELECT source, trim(line, e'\t\n\x0b\x0c\r ') AS key
                                      FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM {{docs}}) WHERE {_HAS_WORD})
                     GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}) f ON f.key = l.key)
    GROUP BY doc_id) b ON b.doc_id = d.doc_id
"""
ORACLE = f"SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM ({SQL.replace('{docs}', 'documents')})"
