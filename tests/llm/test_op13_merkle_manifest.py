import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import op13_merkle_manifest as op

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """The root, and of each leaf its siblings of each level as (left, right) lists."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            start = at - at % fanout
            paths[i].append((nodes[start:at], nodes[at + 1 : start + fanout]))
            own[i] = at // fanout
        nodes = [digest(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def folded(node, path):
    for left, right in path:
        node = digest(*left, node, *right)
    return node


def plain(rows, fanout=2):
    of = {}
    for r in rows:
        of.setdefault(r[2], []).append(r)
    langs = sorted(of, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(of[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *tree([leaf(r) for r in own], fanout))
    root, above = tree([trees[x][1] for x in langs], fanout)
    out = []
    for lang, top in zip(langs, above, strict=True):
        own, subroot, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            path = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            start = leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r)
            out.append((r[0], leaf(r), subroot, root, digest(*[s for left, right in path for s in left + right]), folded(start, path)))
    return sorted(out, key=str)


def rows_of(rng, n, langs):
    return [(i, rng.choice(["s1", "s:2", None, ""]), rng.choice(langs), rng.choice([None, 0, 12, 10**12]), rng.choice([None, "", "é\n1:x", "-", "w" * rng.randrange(50)])) for i in rng.sample(range(10**7), n)]


def queried(df, fanout=2, levels=8):
    rows = op.manifest(df, altered={"n_chars": F.col("n_chars") + 1}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fanout=fanout, levels=levels)
    return rows, sorted(((r.id, r.leaf, r.subroot, r.root, hashlib.sha256(r.path).hexdigest(), r.folded) for r in rows.collect()), key=str)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2), (2, 8), (3, 1)])
def test_against_plain_trees(spark, fanout, levels):
    """With small blocks a tree takes up to seven rounds, and the tree over languages more than one."""
    rng = random.Random(fanout * 10 + levels)
    data = rows_of(rng, 150, ["en", "de", None, "é", "\U0001f600", "￮"]) + rows_of(rng, 7, [f"l{i}" for i in range(9)]) + [(5, "s", "one", 3, "alone"), (6, None, "two", None, "x" * 400_000)]
    data += [data[0], data[0], (data[1][0], "other", data[1][2], 1, "of one id"), (None, "a", "en", 4, "t"), (None, "b", "en", 4, "t")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], FIELDS + ", node string, index int").repartition(5)
    _, got = queried(df, fanout, levels)
    assert got == plain(data, fanout)
    assert sum(r[3] != r[5] for r in got) > 10


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_sizes_about_a_block(spark, n):
    data = [(i, "s", "en", i, f"t{i}") for i in range(n)]
    _, got = queried(spark.createDataFrame(data, FIELDS), 2, 1)
    assert got == plain(data)


def test_empty_table_and_one_readers_check(spark):
    empty = spark.createDataFrame([], FIELDS)
    out, got = queried(empty)
    assert got == [] and out.schema["root"].dataType.simpleString() == "string"
    data = [(i, None, "en" if i % 2 else None, i, f"t{i}") for i in range(40)]
    rows = op.manifest(spark.createDataFrame(data, FIELDS)).collect()
    by_id = {r[0]: list(r) for r in data}
    for r in rows:
        row = by_id[r.id]
        assert r.folded == r.root and op.verified(r.asDict(), row)
        assert not op.verified(r.asDict(), [*row[:4], row[4] + "!"])
