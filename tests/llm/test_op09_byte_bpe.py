import hashlib
import random

import public_tokenizers
import pytest

from plumbline.llm.op09_byte_bpe import Codec, blocks, decode_documents, encode_documents, encoding_digests, op9_byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH, PATTERN)


def test_blocks_are_safe(codec):
    rng = random.Random(3)
    letters = [*"ab'1.é　\xa0\x85\x1c_-①½一漢。、\u0301\u200d", *"    ", "\n", "\t", "\r", "🎉", "'s", "12"]
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(16)))
        parts = list(blocks(text, 2))
        assert "".join(parts) == text
        assert codec.encode(text, 2) == codec.encoding.encode_ordinary(text)


def test_round_trip_and_edges(spark, codec):
    long = ("mot " * 40_000) + "x" * 5000
    rows = [(1, "a b", "k"), (2, None, "k"), (3, "", "k"), (3, "", "k"), (None, "é\n\n🎉 <|endoftext|>", "k"), (4, long, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids = encode_documents(df, PATH, PATTERN)
    back = {r.doc_id: bytes(r.bytes).decode() for r in decode_documents(ids, PATH, PATTERN).collect()}
    assert back == {1: "a b", 2: "", 3: "", None: rows[4][1], 4: long}
    got = encoding_digests(df, PATH, PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        expected = codec.encoding.encode_ordinary(text)
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert encoding_digests(df.limit(0), PATH, PATTERN).count() == 0


def merged(ranks, piece):
    """Byte-pair merges of one piece by brute force: always the pair of least rank, the first of several."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[x] for x in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_query_against_brute_force_merges(spark):
    import base64

    import regex

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(PATH, "rb"))}
    known = {}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        ids = []
        for x in regex.findall(PATTERN, r.text or ""):
            if x not in known:
                known[x] = merged(ranks, x.encode())
            ids += known[x]
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_texts_without_spaces_are_cut(codec):
    for text in ("漢字かな。" * 40_000, "a=b;c(d);" * 30_000, "line\n" * 40_000):
        assert max(map(len, blocks(text))) < 70_000
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)


def test_query_decodes_every_document(spark):
    import duckdb

    got = {r.doc_id: r.decoded_sha256 for r in op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(duckdb.sql("select doc_id, sha256(coalesce(text, '')) from '/root/testdata/sf0.001/documents.parquet'").fetchall())
