"""Readers and writers of records, boards, treebanks and pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import store, treebank

RECORD_SCHEMA = """schema_version string, evaluation_id string, evaluation_timestamp string, retrieved_timestamp string,
source_metadata struct<source_name string, source_type string, source_organization_name string, source_organization_url string, evaluator_relationship string>,
model_info struct<name string, id string, additional_details struct<num_model_parameters string, max_sequence_length string, vocabulary_size string, merge string, generative string, generative_type string, commercially_licensed string, open string, trained_from_scratch string, model_url string>, inference_engine struct<name string, version string>>,
eval_library struct<name string, version string, additional_details struct<dataset string, task string, languages string, few_shot string, validation_split string, use_bits_per_character string, raw_results string>>,
evaluation_results array<struct<evaluation_name string, source_data struct<dataset_name string, source_type string>, metric_config struct<lower_is_better boolean, score_type string, min_score int, max_score int>, score_details struct<score double, details struct<num_failed_instances string>, uncertainty struct<confidence_interval struct<lower double, upper double, confidence_level double, method string>, num_samples int>>>>"""


def record_tree(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder tree, one JSON object for each file; a file that is none fails the job."""
    df = spark.read.schema(RECORD_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)
    return df.withColumn("path", F.col("_metadata.file_path"))


def jsonl_records(spark: SparkSession, path: str, strict: bool = False, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Records of JSON lines.  Blank lines are skipped and objects glued together (``}{``) are parted; what is no object
    fails the job if ``strict``, else it is left out.  A ``}{`` within a text is parted too."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.explode(F.split(F.regexp_replace("value", r"\}\{", "}\n{"), "\n")).alias("line")).where(F.trim("line") != "")
    is_object = F.coalesce(F.typeof(F.try_parse_json("line")).isNotNull() & F.trim("line").startswith("{") & F.try_parse_json("line").isNotNull(), F.lit(False))
    if strict:
        lines = lines.withColumn("line", F.when(is_object, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("line", 1, 80)))))
    else:
        lines = lines.where(is_object)
    return lines.select(F.from_json("line", schema).alias("r"), "path").select("r.*", "path")


def csv_splits(spark: SparkSession, files: dict[str, str], delimiter: str = ",") -> DataFrame:
    """Local files of each split as one table with a ``split`` column; all must be CSV."""
    if wrong := sorted(f for f in files.values() if not f.endswith(".csv")):
        raise ValueError(f"only csv files can be read: {', '.join(wrong)}")
    parts = [spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", delimiter).csv(f).withColumn("split", F.lit(s)) for s, f in files.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def json_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of JSON files that each hold one array of objects; a file is read by one task, so these are small tables."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def find_split(names: list[str], keyword: str) -> str | None:
    """The shortest split name that holds the keyword."""
    return min((n for n in names if keyword in n), key=len, default=None)


def split_of_file(path: Column) -> Column:
    """The split that a Parquet file's name tells: ``test-00000-of-00001.parquet`` is of ``test``."""
    return F.regexp_extract(path, r"([^/]+?)(?:-\d+-of-\d+)?\.parquet$", 1)


def conllu(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Sentences of a treebank: ``doc``, ``source``, ``ids``, ``tokens``, ``tags``.

    Sentences end at lines that are empty or blank, whatever ends a line.  A token range (``3-4``) keeps its own form and
    the tag of its first part.  Each file is read whole by one task; with ``split_bytes``, by a task for each so many bytes.
    """
    if split_bytes:
        blocks = treebank.line_blocks(spark, path, split_bytes)
    else:
        blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r?\n(?:[ \t]*\r?\n)+")).alias("value")).where(F.trim("value") != "")
    blocks = blocks.select(F.regexp_replace("value", r"[\r\n]+\z", "").alias("value"))
    lines = F.split(F.trim("value"), "\r?\n")
    comment = lambda name: F.nullif(F.regexp_extract("value", rf"(?m)^# {name} = (.*?)\r?$", 1), F.lit(""))
    cells = F.transform(F.filter(lines, lambda x: ~x.startswith("#") & F.contains(x, F.lit("\t"))), lambda x: F.split(x, "\t"))
    rows = F.transform(cells, lambda c: F.struct(c[0].alias("id"), c[1].alias("token"), F.get(c, 3).alias("tag"), F.split(c[0], "-")[0].try_cast("double").alias("low"), F.try_element_at(F.split(c[0], "-"), F.lit(-1)).try_cast("double").alias("high"), F.contains(c[0], F.lit("-")).alias("is_range")))
    df = blocks.select(comment("text").alias("doc"), comment("source").alias("source"), rows.alias("_r"))
    ranges = F.filter("_r", lambda r: r["is_range"])
    alone = F.filter("_r", lambda r: r["is_range"] | ~F.exists(ranges, lambda g: (g["low"] <= r["low"]) & (r["low"] <= g["high"])))
    tag = lambda r: F.when(r["is_range"], F.get(F.filter("_r", lambda x: ~x["is_range"] & (x["low"] == r["low"])), 0)["tag"]).otherwise(r["tag"])
    return df.withColumn("_k", alone).select("doc", "source", F.transform("_k", lambda r: r["id"]).alias("ids"), F.transform("_k", lambda r: r["token"]).alias("tokens"), F.transform("_k", tag).alias("tags"))


class _Text(HTMLParser):
    """Text of a page without scripts and styles; block elements end a line."""

    BLOCKS = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "section", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden, self.links = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.links += tag == "a"
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str | None) -> tuple[str, int]:
    """Text of a page, a line for each block, and its number of links."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return "\n".join(x for x in lines if x), parser.links


def page_texts(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, ``text`` and ``n_links`` of every page, parsed on Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [html_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=[key, "text", "n_links"])

    return df.select(key, html).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, text string, n_links long")


def between_matches(text: Column, pattern: str) -> Column:
    """Pieces of a text from each match of a pattern to the next, for catalogues in one long line."""
    marked = F.regexp_replace(text, f"({pattern})", "\u0000$1")
    return F.slice(F.split(marked, "\u0000"), F.lit(2), F.size(F.split(marked, "\u0000")))


def board_csv(spark: SparkSession, path: str) -> DataFrame:
    """A board's CSV of two header rows (groups, columns) as ``row``, ``group``, ``column``, ``value``.

    A group's heading stands once and holds until the next; boards are small tables.
    """
    lines = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    numbered = lines.withColumn("row", F.monotonically_increasing_id()).coalesce(1)
    heads = [r.asDict() for r in numbered.orderBy("row").limit(2).collect()]
    names = [c for c in lines.columns]
    out, group = [], ""
    for c in names:
        group = (heads[0][c] or "").strip("~ ") or group
        out.append(F.struct(F.lit(group).alias("group"), F.lit(heads[1][c] or "").alias("column"), F.col(c).alias("value")))
    body = numbered.where(F.col("row") > heads[1]["row"])
    return body.select(F.col("row"), F.explode(F.array(*out)).alias("c")).select("row", "c.*")


def write_changed(df: DataFrame, path: str, key: str) -> int:
    """Puts the rows that are new, or differ from what is stored under their key, into the store at ``path``, in place of the old
    ones and in one transaction; how many they were.  Nothing is written where nothing has changed."""
    log = store.changed(df, path, key)
    n = log.count()
    if n:
        store.write(log, path)
    return n


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_merged(df: DataFrame, path: str, order: list[str]) -> None:
    """All records in order; range partitions keep the order across files, whatever their number."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def write_board(df: DataFrame, path: str) -> None:
    """A board is small: one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_board_files(df: DataFrame, folder: str, simple: list[str], note: dict[str, str]) -> None:
    """A board, its simplified form of a few columns, and a note as JSON, each a folder of one file."""
    write_board(df, f"{folder}/board")
    write_board(df.select(*simple), f"{folder}/simplified")
    df.sparkSession.createDataFrame([note], ", ".join(f"{k} string" for k in note)).coalesce(1).write.mode("overwrite").json(f"{folder}/note")


def hub_table(spark: SparkSession, path: str, config: str | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """Parquet files of a dataset (of one configuration's folder) with a ``split`` column from their names; splits may be renamed."""
    df = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{config}" if config else path)
    split = split_of_file(F.col("_metadata.file_path"))
    for old, new in (renamed or {}).items():
        split = F.when(split == old, new).otherwise(split)
    return df.withColumn("split", split)


def checked_snapshot(df: DataFrame, keep: Column, n: int = 5, seed: int = 4242) -> None:
    """Raises if any of ``n`` files' records, drawn by a seeded order of their paths, is no record."""
    picked = df.select("path").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), "path").cast("binary"))).limit(n)
    wrong = df.join(F.broadcast(picked), "path", "left_semi").where(~F.coalesce(keep, F.lit(False))).select("path").distinct().collect()
    if wrong:
        raise ValueError(f"{len(wrong)} of {n} files are not as they should be: {', '.join(sorted(r.path for r in wrong))}")


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def content_hash(df: DataFrame) -> str:
    """A hash of all rows, in any order and any partitioning: a sum and a count of row hashes, joined."""
    row = F.struct(*sorted(df.columns))
    total = df.agg(F.sum(F.xxhash64(F.to_json(row)).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit("b"), F.to_json(row)).cast("decimal(38,0)")).alias("b"), F.count(F.lit(1)).alias("n"))
    return total.select(F.sha2(F.concat_ws(":", "a", "b", "n"), 256)).head()[0]


def to_prune(snapshots: DataFrame, cap: int) -> DataFrame:
    """Snapshots (``name``, ``time``, ``bytes``) that go beyond the cap, the oldest first; the newest always stays."""
    from pyspark.sql import Window

    newest = Window.orderBy(F.desc("time"), F.desc("name"))
    rows = snapshots.withColumn("_total", F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(newest))
    return rows.where((F.col("_total") > cap) & (F.col("_n") > 1)).select(*snapshots.columns)


def to_download(listing: DataFrame, local: DataFrame) -> DataFrame:
    return listing.join(local.select("path"), "path", "left_anti")


def next_batch(df: DataFrame, done: DataFrame | None, key: str, size: int) -> DataFrame:
    """The ``size`` rows that follow what is stored: those of least key beyond the largest key done.

    The stored results are themselves the pointer, so a run that was broken off goes on where it stopped.
    """
    last = None if done is None else done.agg(F.max(key)).head()[0]
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(size)
