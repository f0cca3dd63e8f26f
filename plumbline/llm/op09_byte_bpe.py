"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A long text is cut into blocks at safe boundaries: before a space, tab, line feed or
carriage return that follows a non-white character, and between a letter or digit and a
mark other than an apostrophe.  No match of the split pattern runs across such a place
or looks beyond it: a match is white space only, or an optional space and characters of
one kind, or an apostrophe and letters, and only matches of white space look ahead.  So
the blocks can be encoded alone, and their ids joined are the ids of the text.  What
stays whole is what the pattern itself takes as one match, such as a run of letters.

Edge cases: a null text counts as empty; an empty text has no ids, and both
digests are those of the empty string; rows are kept one for one, repeated rows
and null ids included; an empty table gives an empty result; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import map_arrow, table

#: Characters of a block, at least.
BLOCK_CHARS = 1 << 16
#: White space and marks that every version of the character tables has as such.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[^\W_])(?=[!-&(-/:-@\[-^`{-~\u3001\u3002\uff0c\uff01\uff1f\u300c\u300d])")


def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local_ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after each ``size`` characters; the blocks joined give the text again."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


class Codec:
    def __init__(self, path: str, pattern: str):
        self.encoding = load_encoding(path, pattern)
        self.decimal = [str(i) for i in range(self.encoding.n_vocab)]

    def encode(self, text: str, size: int = BLOCK_CHARS) -> list[int]:
        return [i for part in blocks(text, size) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def digests(self, text: str | None) -> tuple[int, str, str]:
        ids = self.encode(text or "")
        listed = " ".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def _per_text(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, columns: dict[str, pa.DataType], schema: str, rows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            out = [rows(codec, x) for x in batch.column(1).to_pylist()]
            arrays = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(columns), columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *columns])

    return map_arrow(df.select(id_col, text_col), run, schema)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every text."""
    kind = df.schema[id_col].dataType.simpleString()
    return _per_text(df, id_col, text_col, path, pattern, {"ids": pa.list_(pa.int32())}, f"{id_col} {kind}, ids array<int>", lambda codec, text: (codec.encode(text or ""),))


def decode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``bytes`` (binary) of every list of ids; ids need not end at a character's boundary."""
    kind = df.schema[id_col].dataType.simpleString()
    return _per_text(df, id_col, ids_col, path, pattern, {"bytes": pa.binary()}, f"{id_col} {kind}, bytes binary", lambda codec, ids: (codec.decode(ids or []),))


def encoding_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and their decoding in one pass, as counts and digests."""
    kind = df.schema[id_col].dataType.simpleString()
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _per_text(df, id_col, text_col, path, pattern, columns, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda codec, text: codec.digests(text))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
