"""A Merkle manifest of a dataset: a tree of digests for each language, one root over all.

Leaves are digests of rows.  Each tree's leaves are numbered densely by one range shuffle:
tasks count their rows by tree, and the counts' running sums are where each task begins.
Aligned blocks of ``fanout ** LEVELS`` leaves are then hashed in tasks of their own: a block
is one contiguous numpy matrix of 64-byte hexadecimal rows; a level is made by reshaping it
to runs of ``fanout`` rows and hashing each, and a node's siblings follow from its index
alone.  Blocks' roots are numbered already and are the leaves of the next round, so a tree
of any size takes a few rounds of the same step, and no tree is one task's.

Proofs come back down the same tables: each block gets its own root's path once and puts
the path inside the block before it, so nothing but a block's own path is sent to it.

Hashing: every run of ``fanout`` consecutive nodes (the last may have fewer, even one) becomes
the SHA-256 of its digests, in hexadecimal text; a level of one node is the root.

Edge cases: a null of any column is ``-`` in its leaf, which no value gives; a null tree is
one of its own and comes first; rows of one id are ordered by their leaves, so rows that are
equal altogether have equal sets of proofs; null ids come first and are never tampered with;
a text of any length is one leaf, hashed in the JVM; an empty table has no leaves, no root
and gives no rows; a tree of one leaf has that leaf as its subroot, and one tree's subroot
is the root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small_enough, table, written

FANOUT = 2
#: Levels of a block: ``FANOUT ** LEVELS`` leaves are one task's group.
LEVELS = 8
DIGEST = 64
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = "tree string, index long, node string"


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: each value's UTF-8 length, a colon and the value, or ``-`` for a null."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]).cast("binary"), 256)


def numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """``nodes`` with ``index``, dense from 0 within each ``tree`` in the given order, stored.

    A task's rows are sorted, so those of a tree are consecutive; where they begin within the tree is a sum over
    the tasks before it: as many rows as tasks and trees, never one for each leaf.
    """
    placed = nodes.repartitionByRange(F.col("tree").asc_nulls_first(), *order).sortWithinPartitions(F.col("tree").asc_nulls_first(), *order)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "merkle-order").withColumn("task", F.shiftright("at", 33))
    counts = placed.groupBy("tree", "task").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select(F.col("tree").alias("_tree"), F.col("task").alias("_task"), (before - F.col("least")).alias("shift")), "merkle-starts")
    if small_enough(starts):
        starts = F.broadcast(starts)
    both = placed.join(starts, (F.col("task") == F.col("_task")) & F.col("tree").eqNullSafe(F.col("_tree")))
    return both.withColumn("index", F.col("at") + F.col("shift")).drop("at", "task", "_tree", "_task", "shift")


def level_up(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """Digests of the runs of a level's nodes, both as rows of hexadecimal bytes."""
    n, whole = len(nodes), len(nodes) // fanout
    runs = [row.tobytes() for row in np.ascontiguousarray(nodes[: whole * fanout]).reshape(whole, fanout * DIGEST)]
    if n > whole * fanout:
        runs.append(nodes[whole * fanout :].tobytes())
    return np.frombuffer("".join(hashlib.sha256(x).hexdigest() for x in runs).encode(), np.uint8).reshape(-1, DIGEST)


def block_levels(nodes: np.ndarray, fanout: int, levels: int, alone: bool) -> list[np.ndarray]:
    """The levels of a block, its nodes first and its root last.

    A block beside others is raised by all its ``levels``, however few nodes it has, so that roots of blocks are of
    one level; a tree of one block ends with the first level of one node.
    """
    out = [nodes]
    while len(out[-1]) > 1 or (not alone and len(out) <= levels):
        out.append(level_up(out[-1], fanout))
    return out


def siblings(levels: list[np.ndarray], fanout: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each node of a block: its siblings' digests from below to the block's root, left to right, and how many
    of each level stand to its left and to its right."""
    n, depth = len(levels[0]), len(levels) - 1
    left, right = np.zeros((n, depth), np.uint8), np.zeros((n, depth), np.uint8)
    rows, there = np.zeros((n, depth, max(fanout - 1, 1), DIGEST), np.uint8), np.zeros((n, depth, max(fanout - 1, 1)), bool)
    own = np.arange(n)
    for k in range(depth):
        size = len(levels[k])
        left[:, k] = own % fanout
        right[:, k] = np.minimum(own - own % fanout + fanout, size) - own - 1
        for j in range(fanout - 1):
            sibling = own - own % fanout + j + (j >= own % fanout)
            there[:, k, j] = sibling < size
            rows[:, k, j] = levels[k][np.minimum(sibling, size - 1)]
        own = own // fanout
    return [rows[i][there[i]].tobytes() for i in range(n)], left, right


def fold(node: bytes, path: bytes, left: bytes, right: bytes) -> bytes:
    """The root that a node and its siblings give."""
    at = 0
    for before, after in zip(left, right, strict=True):
        middle, end = at + before * DIGEST, at + (before + after) * DIGEST
        node = hashlib.sha256(path[at:middle] + node + path[middle:end]).hexdigest().encode()
        at = end
    return node


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, DIGEST)


@dataclass(frozen=True)
class Trees:
    """Numbered nodes of all rounds, leaves first; ``sizes`` says how many nodes each tree has in each round."""

    rounds: list[DataFrame]
    fanout: int
    levels: int

    def roots(self) -> DataFrame:
        """``tree``, ``node`` of every tree: what is left after the last round."""
        return self.rounds[-1].select("tree", "node")


def _blocked(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes with the ``block`` they are in and ``alone``: whether their tree is that block."""
    sizes = nodes.groupBy("tree").agg((F.max("index") + 1).alias("size")).select(F.col("tree").alias("_tree"), "size")
    size = fanout**levels
    out = nodes.join(F.broadcast(sizes), F.col("tree").eqNullSafe(F.col("_tree"))) if small_enough(sizes) else nodes.join(sizes, F.col("tree").eqNullSafe(F.col("_tree")))
    return out.withColumn("block", F.floor(F.col("index") / size)).withColumn("alone", F.col("size") <= size).drop("_tree", "size")


def trees(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Trees:
    """All rounds over numbered leaves (``tree``, ``index``, ``node``)."""

    def root(group: pa.Table) -> pa.Table:
        group = group.sort_by("index")
        top = block_levels(_matrix(group.column("node")), fanout, levels, group.column("alone")[0].as_py())[-1]
        return pa.table({"tree": group.column("tree").slice(0, 1).cast(pa.string()), "index": group.column("block").slice(0, 1).cast(pa.int64()), "node": pa.array([top[0].tobytes().decode()])})

    rounds = [leaves]
    while True:
        rows = _blocked(rounds[-1].select("tree", "index", "node"), fanout, levels)
        rounds.append(written(rows.groupBy("tree", "block").applyInArrow(root, _TOP), "merkle-roots"))
        if not rounds[-1].where("index > 0").head(1):
            return Trees(rounds, fanout, levels)


_PATH = "tree string, index long, path binary, left binary, right binary"


def _paths_of(group: pa.Table, above: pa.Table, fanout: int, levels: int) -> tuple[pa.Table, list[bytes], list[bytes], list[bytes]]:
    """A block's rows in order, and the path of each: its own within the block, then the block's."""
    group = group.sort_by("index")
    inner, left, right = siblings(block_levels(_matrix(group.column("node")), fanout, levels, group.column("alone")[0].as_py()), fanout)
    path, more_left, more_right = (above.column(c)[0].as_py() for c in ("path", "left", "right"))
    return group, [x + path for x in inner], [x.tobytes() + more_left for x in left], [x.tobytes() + more_right for x in right]


def with_paths(built: Trees, top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves in blocks and the path of each block's root (``tree``, ``block``); ``top`` has the paths of the trees' roots
    (``tree``, ``index`` 0, ``path``, ``left``, ``right``)."""
    fanout, levels = built.fanout, built.levels

    def run(group: pa.Table, above: pa.Table) -> pa.Table:
        group, path, left, right = _paths_of(group, above, fanout, levels)
        return pa.table({"tree": group.column("tree").cast(pa.string()), "index": group.column("index").cast(pa.int64()), "path": pa.array(path, pa.binary()), "left": pa.array(left, pa.binary()), "right": pa.array(right, pa.binary())})

    above = top
    for nodes in reversed(built.rounds[1:-1]):
        rows = _blocked(nodes, fanout, levels)
        above = written(rows.groupBy("tree", "block").cogroup(above.withColumnRenamed("index", "block").groupBy("tree", "block")).applyInArrow(run, _PATH), "merkle-paths")
    return _blocked(built.rounds[0], fanout, levels), above.withColumnRenamed("index", "block")


def manifest(df: DataFrame, tree_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = LEAF_COLUMNS, altered: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``path`` (siblings' digests), ``left``, ``right`` (siblings beside the node, a byte a level)
    and ``folded`` (the root that the row's leaf and its path give) of every row.

    With ``altered`` (new values of columns), ``folded`` starts from the altered leaf of the rows that ``where`` names.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    other = leaf([(altered or {}).get(c, values[c]) for c in columns]) if altered else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{tree_col}`").cast("string").alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf(list(values.values())).alias("node"), F.when(where, other).alias("other") if altered else other.alias("other"))
    leaves = numbered(rows, [F.col("id").asc_nulls_first(), F.col("node")])
    built = trees(leaves, fanout, levels)
    subroots = numbered(built.roots().select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node"), [F.col("of").asc_nulls_first()])
    over = trees(subroots, fanout, levels)
    whole = over.roots().head()
    root = whole["node"] if whole else None
    no_path = over.roots().select("tree", F.lit(0).cast("long").alias("index"), *[F.lit(b"").alias(c) for c in ("path", "left", "right")])
    blocks, above = with_paths(over, no_path)

    def tops(group: pa.Table, above: pa.Table) -> pa.Table:
        group, path, left, right = _paths_of(group, above, fanout, levels)
        return pa.table({"tree": group.column("of").cast(pa.string()), "index": pa.array([0] * len(path), pa.int64()), "path": pa.array(path, pa.binary()), "left": pa.array(left, pa.binary()), "right": pa.array(right, pa.binary())})

    top = written(blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(tops, _PATH), "merkle-top")
    blocks, above = with_paths(built, top)

    def proofs(group: pa.Table, above: pa.Table) -> pa.Table:
        group, path, left, right = _paths_of(group, above, fanout, levels)
        own, other = group.column("node").to_pylist(), group.column("other").to_pylist()
        folded = [fold((o or x).encode(), p, a, b).decode() for x, o, p, a, b in zip(own, other, path, left, right, strict=True)]
        return pa.table({"tree": group.column("tree").cast(pa.string()), "id": group.column("id"), "leaf": pa.array(own, pa.string()), "path": pa.array(path, pa.binary()), "left": pa.array(left, pa.binary()), "right": pa.array(right, pa.binary()), "folded": pa.array(folded, pa.string())})

    kind = df.schema[id_col].dataType.simpleString()
    out = blocks.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(proofs, f"tree string, id {kind}, leaf string, path binary, left binary, right binary, folded string")
    names = built.roots().select(F.col("tree").alias("_tree"), F.col("node").alias("subroot"))
    if small_enough(names):
        names = F.broadcast(names)
    return out.join(names, F.col("tree").eqNullSafe(F.col("_tree"))).select("id", "tree", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "path", "left", "right", "folded")


def verified(path_row: dict, columns: list) -> bool:
    """Whether a row's values, with its path from the manifest, give the manifest's root: what a reader of one row runs."""
    text = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in columns)
    return fold(hashlib.sha256(text.encode()).hexdigest().encode(), path_row["path"], path_row["left"], path_row["right"]).decode() == path_row["root"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"), altered={"n_chars": F.col("n_chars") + 1}, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("path", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _duck_leaf(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({v})::VARCHAR)::VARCHAR || ':' || ({v})::VARCHAR, '-')" for v in values) + ")"


#: CRC-32 bit by bit (the reflected polynomial 0xEDB88320), as DuckDB has no function for it.
_DUCK_CRC = """xor(4294967295::UBIGINT, list_reduce(
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::UBIGINT))"""
#: A level's runs of two, until one node is left; ``n`` is the number of nodes of the level.
_DUCK_UP = "SELECT tree, level, i, n, node FROM {0} UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM {1} WHERE n > 1 GROUP BY tree, level, n, i // 2"
ORACLE = f"""
WITH RECURSIVE rows AS (
    SELECT doc_id, lang AS tree, {_duck_leaf("n_chars")} AS node, {_duck_leaf("n_chars + 1")} AS other, coalesce({_DUCK_CRC} % 7 = 0, false) AS tampered FROM documents),
leaves AS (SELECT *, 0 AS level, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows),
up(tree, level, i, n, node) AS ({_DUCK_UP.format("leaves", "up")}),
subroots AS (SELECT tree AS lang, level AS height, node FROM up WHERE n = 1),
tops AS (SELECT 0 AS tree, lang, node, 0 AS level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM subroots),
over(tree, level, i, n, node) AS ({_DUCK_UP.format("tops", "over")}),
root AS (SELECT node AS root, level AS height FROM over WHERE n = 1),
steps AS (
    SELECT l.doc_id, k.k AS step, u.node AS sibling, (l.i >> k.k) & 1 AS is_right
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.tree CROSS JOIN (SELECT unnest(range(64))::INT AS k) k
    LEFT JOIN up u ON u.tree IS NOT DISTINCT FROM l.tree AND u.level = k.k AND u.i = xor(l.i >> k.k, 1) WHERE k.k < s.height
    UNION ALL
    SELECT l.doc_id, 64 + k.k, u.node, (t.i >> k.k) & 1
    FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.tree CROSS JOIN (SELECT unnest(range(64))::INT AS k) k CROSS JOIN root r
    LEFT JOIN over u ON u.level = k.k AND u.i = xor(t.i >> k.k, 1) WHERE k.k < r.height),
paths AS (SELECT doc_id, coalesce(string_agg(sibling, '' ORDER BY step), '') AS siblings, list({{'h': coalesce(sibling, ''), 'is_right': is_right}} ORDER BY step) AS path FROM steps GROUP BY doc_id),
folded AS (
    SELECT l.doc_id, l.node AS leaf, s.node AS subroot, root, coalesce(siblings, '') AS siblings,
        list_reduce(list_prepend({{'h': CASE WHEN tampered THEN other ELSE l.node END, 'is_right': 0::BIGINT}}, coalesce(path, [])),
            lambda a, x: {{'h': sha256(CASE WHEN x.is_right = 1 THEN x.h || a.h ELSE a.h || x.h END), 'is_right': 0::BIGINT}}).h AS folded_root
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.tree LEFT JOIN paths p ON p.doc_id = l.doc_id CROSS JOIN root)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
