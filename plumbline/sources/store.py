"""A store of records by key whose writes are transactions: a Python data source.

A version of the store is a manifest: one small JSON file that names, for each part, the file
with its rows.  Keys are dealt to parts by their hash, so a write that changes some records
rewrites the parts that hold them and no others; the rest of the manifest is carried over.
Files are named by the SHA-256 of their content, so tasks that run twice, and writes that
repeat each other, leave one file.  Readers follow the newest manifest, which ``commit``
writes under the next number and without overwriting: a job that fails or is stopped before
it has written nothing that a reader sees, and of two writers one fails.

A write takes a change log, a row for each key at most: ``key``, ``value`` (the record as JSON) and
``removed``.  ``replace`` makes it from two tables.  Rows of one part are read and written by one
task; parts are so many that this fits (``parts``, settled by the first write).
"""

from __future__ import annotations

import contextlib
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "record_store"
SCHEMA = "key string, value string"
PARTS = 64


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def versions(path: str) -> list[int]:
    files, folder = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{folder}/manifests", allow_not_found=True))
    return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))


def manifest(path: str, version: int | None = None) -> dict:
    """The manifest of a version, the newest by default: ``version``, ``parts`` and ``files`` (name by part)."""
    known = versions(path)
    if not known:
        return {"version": 0, "parts": None, "files": {}}
    files, folder = _open(path)
    with files.open_input_stream(f"{folder}/manifests/{version or known[-1]}.json") as f:
        return json.loads(f.read())


def part_of(key: str, parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big") % parts


def _rows(files: fs.FileSystem, name: str) -> dict[str, str]:
    with files.open_input_stream(name, compression="gzip") as f:
        return dict(json.loads(line) for line in f.read().decode().splitlines())


@dataclass
class _Part(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, version: int | None):
        self.path, self.version = path, version

    def partitions(self) -> list[InputPartition]:
        _, folder = _open(self.path)
        return [_Part(f"{folder}/files/{name}") for _, name in sorted(manifest(self.path, self.version)["files"].items())] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[tuple[str, str]]:
        if partition.name:
            yield from sorted(_rows(_open(self.path)[0], partition.name).items())


@dataclass
class _Written(WriterCommitMessage):
    base: int
    files: dict[str, str | None] = field(default_factory=dict)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, parts: int):
        known = manifest(path)
        self.path, self.base, self.parts = path, known["version"], known["parts"] or parts
        self.files = known["files"]

    def write(self, rows: Iterator) -> _Written:
        files, folder = _open(self.path)
        changes: dict[int, dict[str, str | None]] = {}
        for row in rows:
            if row["key"] is None:
                raise ValueError("a record has no key")
            own = changes.setdefault(part_of(row["key"], self.parts), {})
            if row["key"] in own:
                raise ValueError(f"two changes for the key {row['key']!r}")
            own[row["key"]] = None if row["removed"] else row["value"]
        out = _Written(self.base)
        for part, own in changes.items():
            old = _rows(files, f"{folder}/files/{self.files[str(part)]}") if str(part) in self.files else {}
            kept = {k: v for k, v in sorted((old | own).items()) if v is not None}
            if not kept:
                out.files[str(part)] = None
                continue
            text = "".join(json.dumps([k, v]) + "\n" for k, v in kept.items()).encode()
            name = f"{hashlib.sha256(text).hexdigest()}.jsonl.gz"
            files.create_dir(f"{folder}/files", recursive=True)
            if files.get_file_info(f"{folder}/files/{name}").type == fs.FileType.NotFound:
                # Under a name of its own first: a file of a content's name is always whole.
                own_name = f"{folder}/files/_{name}.{part}.{id(rows)}"
                with files.open_output_stream(own_name, compression="gzip") as f:
                    f.write(text)
                files.move(own_name, f"{folder}/files/{name}")
            out.files[str(part)] = name
        return out

    def commit(self, messages: list[_Written | None]) -> None:
        named = dict(self.files)
        seen: set[str] = set()
        for message in filter(None, messages):
            if twice := seen & set(message.files):
                raise ValueError(f"parts {sorted(twice)} were written by two tasks: rows must be dealt by part")
            seen |= set(message.files)
            named |= message.files
        named = {k: v for k, v in named.items() if v is not None}
        files, folder = _open(self.path)
        files.create_dir(f"{folder}/manifests", recursive=True)
        target = f"{folder}/manifests/{self.base + 1}.json"
        if files.get_file_info(target).type != fs.FileType.NotFound:
            raise RuntimeError(f"version {self.base + 1} was written by another job meanwhile")
        with files.open_output_stream(f"{target}.new") as f:
            f.write(json.dumps({"version": self.base + 1, "parts": self.parts, "files": named}, sort_keys=True).encode())
        files.move(f"{target}.new", target)

    def abort(self, messages: list[_Written | None]) -> None:
        """Files that no manifest names are never read; ``vacuum`` removes them."""


class RecordStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        version = self.options.get("version")
        return _Reader(self.options["path"], int(version) if version else None)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("parts", PARTS)))


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``key`` and ``value`` of a version, the newest by default."""
    spark.dataSource.register(RecordStore)
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader.option("version", version) if version else reader).load()


def _dealt(changes: DataFrame, parts: int) -> DataFrame:
    """Changes by part: the writer's hash of the key in the first 8 bytes of BLAKE2b is not Spark's, so a small function gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array([part_of(k, parts) if k is not None else 0 for k in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=["key", "value", "removed", "part"])

    rows = changes.select(F.col("key").cast("string"), "value", F.coalesce("removed", F.lit(False)).alias("removed"))
    return rows.mapInArrow(run, "key string, value string, removed boolean, part int").repartition(parts, "part").drop("part")


def write(changes: DataFrame, path: str, parts: int = PARTS) -> int:
    """Commits a change log (``key``, ``value``, ``removed``); the new version's number."""
    spark = changes.sparkSession
    spark.dataSource.register(RecordStore)
    known = manifest(path)
    _dealt(changes, known["parts"] or parts).write.format(FORMAT).option("path", path).option("parts", parts).mode("append").save()
    return known["version"] + 1


def changed(df: DataFrame, path: str, key: str, remove_missing: bool = False) -> DataFrame:
    """The change log that brings the store to hold ``df``'s rows: those that differ from what is stored under their key, and,
    with ``remove_missing``, the keys that ``df`` has not.  Keys are compared by one join, values as JSON."""
    new = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    old = read(df.sparkSession, path).select(F.col("key").alias("old_key"), F.col("value").alias("old_value"))
    both = new.join(old, F.col("key") == F.col("old_key"), "full" if remove_missing else "left")
    differs = both.where("old_key IS NULL OR key IS NULL OR value <> old_value")
    return differs.select(F.coalesce("key", "old_key").alias("key"), "value", F.col("key").isNull().alias("removed") if remove_missing else F.lit(False).alias("removed"))


def vacuum(path: str, keep: int = 1) -> int:
    """Removes manifests but the newest ``keep`` and the files that those kept do not name; how many files.  Not beside a running write."""
    files, folder = _open(path)
    known = versions(path)
    for old in known[:-keep]:
        files.delete_file(f"{folder}/manifests/{old}.json")
    named = {name for v in known[-keep:] for name in manifest(path, v)["files"].values()}
    gone = [x.path for x in files.get_file_info(fs.FileSelector(f"{folder}/files", allow_not_found=True)) if x.base_name not in named]
    for name in gone:
        with contextlib.suppress(FileNotFoundError):
            files.delete_file(name)
    return len(gone)
