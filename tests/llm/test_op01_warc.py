import gzip
import hashlib
import io

import pyarrow.fs as pafs
import pytest

from plumbline.llm import op01_warc as op


def payloads(df):
    out = {}
    for r in df.collect():
        for head, payload in op.records_of(r.path):
            out.setdefault(head["page_id"], []).append((head, payload))
    return out


BIG = ("é" * 300).encode()
ROWS = [(4, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (5, "http://b\r\nX: y", b"short"), (6, "http://c", b"short"), (7, "u", None), (None, "u", b"n" * 200), (3, "u", b"WARC/1.1\r\n\r\n\r\n\r\n\x00\xff" * 20), (8, "u", BIG), (8, "v", BIG), (10, "u", b"k" * 99), (11, "u", b"k" * 99), (12, "u", b"z" * 3_000_000)]


def pages(spark):
    return spark.createDataFrame([(*r, "clash", 0) for r in ROWS], "page_id long, url string, html binary, digest string, at int").repartition(3)


@pytest.mark.parametrize("size", [1 << 24, 1000])
def test_round_trip_and_resolution(spark, size):
    raw = op.write_archives(pages(spark), "page_id", "url", "html", size)
    back = payloads(raw)
    assert sorted((k is None, k or 0, p) for k, v in back.items() for _, p in v) == sorted((i is None, i or 0, p or b"") for i, _, p in ROWS)
    done = op.deduplicate(raw, size=size)
    heads = op.read_headers(done).collect()
    assert len(heads) == len(ROWS)
    for r in heads:
        assert r.payload_bytes in {len(p or b"") for i, _, p in ROWS if i == r.page_id}
        assert r.digest in {hashlib.sha256(p or b"").hexdigest() for i, _, p in ROWS if i == r.page_id}
    by_id = {}
    for r in heads:
        by_id.setdefault(r.page_id, []).append((r.kind, r.refers_to))
    assert by_id[2] == [("response", None)]
    assert by_id[4] == by_id[9] == [("revisit", 2)] and by_id[8] == [("revisit", 2)] * 2
    assert all(by_id[i] == [("response", None)] for i in (3, 5, 6, 7, None, 10, 11, 12))
    new = payloads(done)
    original = new[2][0][0]["record_id"]
    assert new[2][0][1] == BIG and new[4][0][1] == b"" and new[4][0][0]["refers_to_id"] == original
    again = op.read_headers(op.deduplicate(done, size=size)).collect()
    assert sorted((str(r.page_id), r.kind, str(r.refers_to), r.digest, r.payload_bytes) for r in again) == sorted((str(r.page_id), r.kind, str(r.refers_to), r.digest, r.payload_bytes) for r in heads)


def test_members_are_plain_gzip_and_warc(spark):
    path = op.write_archives(pages(spark).where("page_id = 4"), "page_id", "url", "html").head().path
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_input_stream(inner, compression=None) as f:
        text = gzip.GzipFile(fileobj=io.BytesIO(f.read())).read()
    head, _, block = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1") and fields["WARC-Type"] == "response" and len(block) == int(fields["Content-Length"]) + 4
    assert block.endswith(BIG + b"\r\n\r\n") and fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(BIG).hexdigest()


def test_empty(spark):
    raw = op.write_archives(pages(spark).limit(0), "page_id", "url", "html")
    assert op.read_headers(op.deduplicate(raw)).count() == 0


def test_cut_archive_is_an_error(spark):
    path = op.write_archives(pages(spark).where("page_id = 12"), "page_id", "url", "html").head().path
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_input_stream(inner, compression=None) as f:
        data = f.read()
    with system.open_output_stream(inner, compression=None) as f:
        f.write(data[:-20])
    with pytest.raises(EOFError):
        list(op.records_of(path))
