"""Sub-word pieces against a plain longest match, against another implementation, and in windows with labels."""

import random
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from plumbline import queries_tokens
from plumbline.operators import curation, subwords

DIR = "/root/testdata/sf0.001"


def plain_cut(word, pieces):
    if len(word) > 100:
        return [(-1, 0, len(word))]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in pieces:
                out.append((pieces[piece], at, end))
                at = end
                break
        else:
            return [(-1, 0, len(word))]
    return out


def plain_spans(text, pieces):
    words = list(re.finditer(r"[^\W_]+|[^\w\s]|_", text))
    return [(p, m.start() + a, m.start() + b, i) for i, m in enumerate(words) for p, a, b in plain_cut(m[0], pieces)]


def vocabulary(rng, letters, n):
    return ["[UNK]", *dict.fromkeys(rng.choice(["", "##"]) + "".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(n))]


def test_longest_match_equals_plain_and_other_implementation():
    rng = random.Random(3)
    for letters in ("ab", "abcé", "añ🙂字b"):
        pieces = vocabulary(rng, letters, 60)
        words = ["".join(rng.choices(letters + "z", weights=[9] * len(letters) + [1], k=rng.randint(0, 14))) for _ in range(400)] + ["a" * 100, "a" * 101]
        rows = subwords.Trie(pieces).cut(words)
        got = [[] for _ in words]
        for w, p, a, b in rows.T.tolist():
            got[w].append((p, a, b))
        numbers = {p: i for i, p in enumerate(pieces)}
        assert got == [plain_cut(w, numbers) for w in words]
        other = Tokenizer(models.WordPiece(numbers, unk_token="[UNK]", max_input_chars_per_word=100))
        for w, own in zip(words, got, strict=True):
            if w:
                assert [max(p, 0) for p, _, _ in own] == other.encode([w], is_pretokenized=True).ids


def test_texts_nulls_and_empty_vocabulary(spark):
    pieces = ["un", "##able", "##a", "b", "!", "_", "un"]
    rows = spark.createDataFrame([(0, "unable un_b!"), (1, None), (2, ""), (3, " \n"), (4, "b" * 300), (5, "unx b")], "i int, text string").repartition(3)
    got = {r.i: r.s and [tuple(p) for p in r.s] for r in rows.select("i", subwords.subwords(spark, pieces)("text").alias("s")).collect()}
    assert got[0] == [(0, 0, 2, 0), (1, 2, 6, 0), (0, 7, 9, 1), (5, 9, 10, 2), (3, 10, 11, 3), (4, 11, 12, 4)]
    assert got[1] is None and got[2] == [] and got[3] == [] and got[4] == [(-1, 0, 300, 0)] and got[5] == [(-1, 0, 3, 0), (3, 4, 5, 1)]
    assert [tuple(p) for p in rows.where("i = 5").select(subwords.subwords(spark, [])("text")).head()[0]] == [(-1, 0, 3, 0), (-1, 4, 5, 1)]
    words = spark.createDataFrame([(["unable", None, "b", ""],), (None,), ([],)], "w array<string>")
    assert [r[0] and [tuple(p) for p in r[0]] for r in words.select(subwords.subwords(spark, pieces)("w")).collect()] == [[(0, 0, 2, 0), (1, 2, 6, 0), (3, 0, 1, 2)], None, []]


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as lines:
        return {p: i for i, p in reversed(list(enumerate(subwords.pieces_of_ranks(lines))))}


def test_windows_of_whole_documents(spark):
    pieces, want = ranks(), set()
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        room = 128 - 3 - len(plain_spans(r.source or "", pieces))
        spans = plain_spans(r.text or "", pieces)
        start = 0
        while True:
            w = spans[start : start + room]
            want.add((r.doc_id, start, len(w), w[0][1] if w else None, w[-1][2] if w else None, sum(p[0] == -1 for p in w)))
            if start + room >= len(spans):
                break
            start += room - 32
    assert {tuple(r) for r in queries_tokens.subword_windows(spark, DIR).collect()} == want
    assert len(want) > 300


def test_labels_of_first_pieces(spark):
    pieces, want = ranks(), {}
    for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect():
        labels = [[min(len(w), 9)] + [-100] * (len(plain_cut(w, pieces)) - 1) for w in r.text.split(" ") if w]
        want[r.item_id] = " ".join(str(x) for own in labels for x in own)
    assert {r.item_id: r.labels for r in queries_tokens.subword_labels(spark, DIR).collect()} == want
    assert any("-100" in x for x in want.values())


def test_a_question_without_room_fails(spark):
    cut = subwords.subwords(spark, ["a"])
    rows = spark.createDataFrame([("a a a a", "a a a a a a a a")], "q string, c string").select(cut("q").alias("q"), cut("c").alias("c"))
    assert [len(r.window) for r in subwords.features(rows, "q", "c", 12, 2).orderBy("start").collect()] == [5, 5]
    try:
        subwords.features(rows, "q", "c", 9, 2).select(F.size("window")).collect()
    except Exception as e:
        assert "no room" in str(e)
    else:
        raise AssertionError("no error")
    assert curation.windows(rows, "c", 4, 2).count() == 3
