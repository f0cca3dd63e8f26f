"""Blocks of lines read by ranges of bytes: the same whatever the split size."""

import io
import random
import re

import pytest

from plumbline.sources import files, treebank


def plain(data):
    return [b for b in re.split(rb"(?:(?<=\n)|\A)(?:(?:[ \t\r]*\n)+(?:[ \t\r]+\Z)?|[ \t\r]+\Z)", data) if b.strip()]


def test_ranges_of_any_size_make_the_same_blocks():
    rng = random.Random(5)
    for case in range(150):
        end = rng.choice([b"\n", b"\r\n"])
        lines = [rng.choice([b"", b" \t", b"x", "é字".encode() * rng.randint(1, 5), b"y" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 25))]
        data = end.join(lines) + (end if case % 2 else b"")
        for size in (1, 2, 3, 7, 16, 50, 1000):
            got = [b for a in range(0, len(data), size) for b in treebank.blocks(io.BytesIO(data), a, min(a + size, len(data)))]
            assert got == plain(data), (data, size)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_sentences_do_not_depend_on_the_split(spark, tmp_path, end):
    folder = tmp_path / "bank"
    (folder / "sub").mkdir(parents=True)
    (folder / "_SUCCESS").write_text("no treebank\n")
    sentence = "# source = {0}\n# text = é{0} b\n1-2\té{0}b\t_\t_\n1\té{0}\t_\tX\n2\tb\t_\tY\n\n"
    for name, ids in (("a", range(300)), ("sub/b", range(300, 320))):
        (folder / name).write_bytes("".join(sentence.format(i) for i in ids).replace("\n", end).encode())
    (folder / "empty").write_bytes(b"")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    want = rows(spark.createDataFrame([(f"é{i} b", str(i), ["1-2"], [f"é{i}b"], ["X"]) for i in range(320)], files.conllu(spark, str(folder), 500).schema))
    for size in (500, 4096, 1 << 26):
        df = files.conllu(spark, str(folder), size)
        assert rows(df) == want
    assert files.conllu(spark, str(folder), 500).rdd.getNumPartitions() > 30
    assert len(rows(files.conllu(spark, str(folder / "sub" / "b"), 100))) == 20
