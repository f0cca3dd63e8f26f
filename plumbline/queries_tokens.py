"""Sub-word pieces and treebanks read by ranges of bytes, on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.catalog import query, table
from plumbline.operators import curation, subwords
from plumbline.session import scratch_folder
from plumbline.sources import files

_LENGTH, _STRIDE, _SPECIAL = 128, 32, 3


def _cut(spark, path: str | None = None):
    """Longest matches over the pieces of a rank file: by default the public one of 50,000 pieces."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path) as lines:
        return subwords.subwords(spark, subwords.pieces_of_ranks(lines))


@query()
def subword_windows(spark, d):
    """Whole documents in windows of pieces beside a question, the source's name: where each window stands in its text."""
    cut = _cut(spark)
    rows = table(spark, d, "documents").select("doc_id", cut(F.coalesce("source", F.lit(""))).alias("question"), cut("text").alias("context"))
    w = subwords.features(rows, "question", "context", _LENGTH, _STRIDE, _SPECIAL)
    lost = F.size(F.filter("window", lambda p: p["piece"] == subwords.UNKNOWN))
    return w.select("doc_id", F.col("start").cast("long").alias("start"), F.size("window").alias("n_pieces"), F.get("window", 0)["start"].alias("first_char"), F.try_element_at("window", F.lit(-1))["end"].alias("end_char"), lost.alias("n_unknown"))


@query()
def subword_labels(spark, d):
    """A label for each word (its number of characters, up to 9) on its first piece, -100 on the others."""
    rows = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("words"))
    pieces = rows.select("item_id", "words", F.transform(_cut(spark)("words"), lambda p: p["word"]).alias("of"))
    labels = F.transform("words", lambda w: F.least(F.length(w), F.lit(9)))
    return pieces.select("item_id", F.array_join(F.transform(curation.first_piece_labels(F.col("words"), F.col("of"), labels), lambda x: x.cast("string")), " ").alias("labels"))


@query("""SELECT item_id, nullif(doc, '') AS doc, len(w) AS n_tokens, w[1] AS first_token FROM (SELECT item_id, doc, string_split(doc, ' ') AS w
FROM (SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS doc FROM benchmark WHERE text IS NOT NULL))""")
def treebank_ranges(spark, d):
    """A treebank in one file, read by a task for each 16 KB."""
    path = f"{scratch_folder(spark)}/treebank-ranges-{uuid.uuid4().hex}"
    rows = table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", F.trim(F.regexp_replace("text", r"[ \t\n\x0B\f\r]+", " ")).alias("doc"))
    lines = F.transform(F.split("doc", " "), lambda w, i: F.concat((i + 1).cast("string"), F.lit("\t"), w, F.lit("\t_\tX")))
    head = F.array(F.concat(F.lit("# source = "), F.col("item_id").cast("string")), F.concat(F.lit("# text = "), "doc"))
    rows.select(F.concat(F.array_join(F.concat(head, lines), "\n"), F.lit("\n")).alias("value")).coalesce(1).write.text(path)
    return files.conllu(spark, path, 16 << 10).select(F.col("source").cast("long").alias("item_id"), "doc", F.size("tokens").cast("long").alias("n_tokens"), F.get("tokens", 0).alias("first_token"))
