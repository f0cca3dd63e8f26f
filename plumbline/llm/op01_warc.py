"""WARC archives: writing, reading, and revisit resolution.

Archives are gzip members, one for each record, in files of bounded size.  Tasks write
them through the file system of ``spark.checkpoint.dir`` and return a manifest of what
they wrote; a manifest is stored before it is used, so files that a lost or repeated task
left behind belong to no manifest and are never read.

Revisit resolution reads the headers of every record (the digest is taken from the
payload), shuffles the headers by payload digest, and joins each record to the original of
its digest: of the responses, the one of least key.  Payloads are not shuffled: each
archive is rewritten from itself, with fresh headers, by a task that gets its archive's
decisions.  A revisit has the HTTP head of its response without the payload, and names
the original record, its address and date.

Payloads under ``min_bytes`` are all kept as responses.

Edge cases: a null payload counts as empty; null keys come after all others, and a record
of null key can be an original only of others of null key; of records with equal digest
and equal key one is the response and the others revisit it; a revisit in the input whose
digest has no response stays as it is; an empty table makes no archive and an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow, scratch_path, table, written

#: Size of one archive before compression; a record that is longer has one of its own.
ARCHIVE_BYTES = 16 << 20
MIN_BYTES = 100
#: Fetch date of records made from a table that has none.
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("5d0f8ce2-6f0f-4b3c-9a57-0f7d6c0e8a11")
_CHUNK = 1 << 20
#: What a record's headers count against the size of an archive, which bounds its number of records.
_HEAD_BYTES = 512

HEADER_SCHEMA = "path string, at long, length long, record_id string, page_id long, url string, date string, kind string, digest string, payload_bytes long, refers_to_id string, refers_to long"


def new_record_id(path: str, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{path}#{n}')}>"


def http_head(payload_bytes: int, kind: str = "text/html; charset=utf-8") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split()) if any(ord(c) < 32 for c in value) else value


def response(record_id: str, page_id: int | None, url: str | None, date: str, payload: bytes, digest: str) -> bytes:
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    fields += [("WARC-Target-URI", _clean(url))] if url else []
    fields += [("Page-Key", str(page_id))] if page_id is not None else []
    return warc_record(fields, http_head(len(payload)) + payload)


def revisit(head: dict, refers_to: dict) -> bytes:
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", head["record_id"]), ("WARC-Date", head["date"]), ("WARC-Profile", _PROFILE), ("WARC-Payload-Digest", f"sha256:{head['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    fields += [("WARC-Target-URI", head["url"])] if head["url"] else []
    fields += [("Page-Key", str(head["page_id"]))] if head["page_id"] is not None else []
    named = {"WARC-Refers-To": refers_to["record_id"], "WARC-Refers-To-Target-URI": refers_to["url"], "WARC-Refers-To-Date": refers_to["date"], "Refers-To-Key": refers_to["page_id"]}
    fields += [(k, str(v)) for k, v in named.items() if v is not None]
    return warc_record(fields, http_head(head["payload_bytes"]))


class ArchiveWriter:
    """Appends records to files under ``folder``, a new one whenever the last has ``size`` bytes of input."""

    def __init__(self, folder: str, size: int = ARCHIVE_BYTES):
        self.system, self.folder = pafs.FileSystem.from_uri(folder)
        self.uri, self.size, self.path, self.out, self.n, self.room = folder, size, "", None, 0, 0

    def place(self, size: int) -> tuple[str, int]:
        """The archive and number of the next record, of about ``size`` bytes."""
        if self.out is None or self.room < size:
            self.close()
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.path, self.n, self.room = self.system.open_output_stream(f"{self.folder}/{name}", compression=None), f"{self.uri}/{name}", 0, self.size
        self.room -= size + _HEAD_BYTES
        self.n += 1
        return self.path, self.n - 1

    def append(self, record: bytes) -> None:
        self.out.write(record)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for archives, made by the driver so that writers need not race for it."""
    path = scratch_path(spark, name)
    system, inner = pafs.FileSystem.from_uri(path)
    system.create_dir(inner, recursive=True)
    return path


def write_archives(df: DataFrame, id_col: str, url_col: str, payload_col: str, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Every row as a response record; the manifest of the archives (``path``, ``records``)."""
    folder = _folder(df.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, counts = ArchiveWriter(folder, size), {}
        for batch in batches:
            for page_id, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = payload or b""
                path, n = writer.place(len(payload))
                writer.append(response(new_record_id(path, n), page_id, url, DATE, payload, hashlib.sha256(payload).hexdigest()))
                counts[path] = counts.get(path, 0) + 1
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["path", "records"])

    rows = df.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("binary"))
    return written(map_arrow(rows, run, "path string, records long"), "warc-manifest")


def _members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member; no more than one is held at a time."""
    at, rest = 0, b""
    while True:
        rest = rest or stream.read(_CHUNK)
        if not rest:
            return
        unpacker, parts, length = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            parts.append(unpacker.decompress(rest))
            length += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data
            if not unpacker.eof and not (rest := stream.read(_CHUNK)):
                raise EOFError("an archive ends within a record")
        yield at, length, b"".join(parts)
        at += length


def parse(path: str, at: int, length: int, record: bytes) -> tuple[dict, bytes]:
    """Header fields as a row of ``HEADER_SCHEMA``, and the payload (empty for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"{path} at {at}: not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    inner, _, payload = block.partition(b"\r\n\r\n")
    declared = next((int(x.split(b":", 1)[1]) for x in inner.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), len(payload))
    kind = fields["warc-type"]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields.get("warc-payload-digest", "").removeprefix("sha256:")
    number = lambda k: int(fields[k]) if k in fields else None
    row = {
        "path": path, "at": at, "length": length, "record_id": fields["warc-record-id"], "page_id": number("page-key"), "url": fields.get("warc-target-uri"), "date": fields["warc-date"],
        "kind": kind, "digest": digest, "payload_bytes": len(payload) if kind == "response" else declared, "refers_to_id": fields.get("warc-refers-to"), "refers_to": number("refers-to-key"),
    }
    return row, payload if kind == "response" else b""


def records_of(path: str) -> Iterator[tuple[dict, bytes]]:
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_input_stream(inner, compression=None) as stream:
        for at, length, record in _members(stream):
            yield parse(path, at, length, record)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in HEADER_SCHEMA.split(", "))])


def _tasks(manifest: DataFrame) -> int:
    """About an archive for each task."""
    return max(1, min(manifest.count(), 20_000))


def read_headers(manifest: DataFrame) -> DataFrame:
    """A row of ``HEADER_SCHEMA`` for each record of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = [row for row, _ in records_of(path)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return map_arrow(manifest.select("path").repartition(_tasks(manifest), "path"), run, HEADER_SCHEMA)


def resolve(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``headers`` with ``original`` (struct; null for a record that is not to be a revisit).

    The originals are aggregated in the tasks before the shuffle and stored, so that the join has an exchange
    of its own, in which Spark can split a digest that a large share of the records has.
    """
    who = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id", "url", "date")
    originals = headers.where((F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes)).groupBy("digest").agg(F.min(who).alias("original"), F.count(F.lit(1)).alias("copies"))
    # A digest of one response alone changes nothing but for revisits that came with the input.
    revisits = headers.where(F.col("kind") == "revisit").select("digest").distinct().withColumn("asked", F.lit(True))
    originals = written(originals.join(revisits, "digest", "left").where((F.col("copies") > 1) | F.col("asked")).select("digest", "original"), "warc-originals")
    joined = headers.join(originals, "digest", "left")
    return joined.withColumn("original", F.when(F.col("original.record_id") != F.col("record_id"), F.col("original"))).select(*headers.columns, "original")


def rewrite(decisions: DataFrame, manifest: DataFrame, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives with fresh headers in which every record with an original is a revisit; their manifest.

    Record ids are kept, so that a revisit's reference holds whichever task writes the original.
    """
    folder = _folder(decisions.sparkSession, "warc-dedup")
    changes = decisions.where("original IS NOT NULL").select("path", F.struct("at", "original").alias("change"))
    todo = manifest.select("path").join(changes.groupBy("path").agg(F.collect_list("change").alias("changes")), "path", "left").repartition(_tasks(manifest), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, counts = ArchiveWriter(folder, size), {}
        for batch in batches:
            for path, changes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                originals = {x["at"]: x["original"] for x in changes or []}
                for head, payload in records_of(path):
                    target, _ = writer.place(len(payload))
                    original = originals.get(head["at"])
                    if original is not None:
                        record = revisit(head, original)
                    elif head["kind"] == "response":
                        record = response(head["record_id"], head["page_id"], head["url"], head["date"], payload, head["digest"])
                    else:
                        record = revisit(head, {"record_id": head["refers_to_id"], "url": None, "date": None, "page_id": head["refers_to"]})
                    writer.append(record)
                    counts[target] = counts.get(target, 0) + 1
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["path", "records"])

    return written(map_arrow(todo, run, "path string, records long"), "warc-manifest")


def deduplicate(manifest: DataFrame, min_bytes: int = MIN_BYTES, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Revisit resolution of the archives of a manifest; the manifest of the new ones."""
    return rewrite(written(resolve(written(read_headers(manifest), "warc-headers"), min_bytes), "warc-decisions"), manifest, size)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    headers = read_headers(deduplicate(write_archives(pages, "page_id", "url", "payload")))
    return headers.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


ORACLE = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (SELECT page_id, payload_bytes, payload_digest,
             CASE WHEN payload_bytes >= 100 AND page_id <> min(page_id) OVER (PARTITION BY payload_digest) THEN min(page_id) OVER (PARTITION BY payload_digest) END AS refers_to
      FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages))
"""
