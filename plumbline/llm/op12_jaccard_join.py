"""Jaccard self-join on word n-grams by adaptive multi-match prefixes.

A text's set is that of its distinct word shingles, its tokens.  All tokens are ordered, rare
ones first.  If two sets of which one has n tokens must share at least t, then their first
n - t + l tokens share at least l of them, for any l (Wang, Li, Feng, 2012).  Each text chooses
its own l: a longer prefix costs more entries in posting lists, but a partner must then share l
tokens of it before the two are compared.  With f the sum of the prefix's estimated
frequencies, l is that of least ``f + f * n / (VERIFY * l)``: the entries met, and the
comparisons they can lead to at most.  A pair must share the smaller l of the two.

1. One pass names each set (128 bits) and counts tokens into a sketch of fixed size, merged
   by blocks of cells; it decides the order and each l, never a result.  Texts of equal sets
   are one class and are joined once, by their least id.
2. A second pass writes prefixes.  A text keeps those tokens that other prefixes hold as well,
   in the order of how many do: prefixes meet by blocks of tokens, packed, so most of their
   tokens, which no other text has, never become rows.  Tokens that the sketch shows to be
   frequent are few and may be very frequent: they become rows, added up before any shuffle.  As every
   l is at least ``1 + n // LENGTHEN``, all partners of a text of m such tokens share at least
   some r of them: a text of fewer has no partner, and any other meets its partners in the
   posting lists of its first m - r + 1, its keys.
3. Every text is compared with one text of less id, that with which it shares most keys among
   those that head a posting list.  This links groups of near copies in linear work.
4. Where a posting list then still holds several components, texts of different components
   meet.  Lists of more than ``SHORT`` texts make no pairs: they are dealt in blocks to tasks
   of fixed size, which count and compare within the task.

In 3 and 4, two texts are compared on full sets only if they share as many tokens of their
prefixes as the smaller l of the two.

Tables of prefixes and of sets are deleted once what is derived from them is stored.

Links are confirmed on full sets of hashes.  No group's pairs are written, and every pair of
a sufficient likeness is in one component, whatever the estimates are.

Edge cases: ids are whole numbers, or the call fails; a null text, or one without words, has the
empty set and links with nothing; a text with fewer words than a shingle is one shingle; texts
of any length are taken whole, and one's prefix is a bounded share of it; repeated rows and
texts are one class; rows of equal id are one node, which has the links of all its texts; a
row of null id links with nothing and is a component of its own (null); ties in the order of tokens are broken by
their hashes; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, drop, map_arrow, small_enough, table, whole_numbers, written
from plumbline.llm.components import components
from plumbline.llm.kernels import U64, mix
from plumbline.llm.op10_minhash import named_sets, sets, similar

WIDTH, PERCENT = 4, 85
#: Cells of the sketch and of one block of it, as powers of two: 32 MB are broadcast and 64 MB kept by a task, whatever the corpus.
CELL_BITS, BLOCK_BITS = 25, 17
#: A text of n tokens asks for one shared token in its prefix, and one more for each LENGTHEN of n at least; for twice as
#: many and EXTRA at most.  A comparison costs as much as n / VERIFY entries of posting lists.
LENGTHEN, EXTRA, VERIFY = 16, 6, 16
#: Texts of a posting list whose pairs are joined, and of one block of a longer list; a task compares two blocks.
SHORT, BLOCK = 128, 256
#: A token is frequent if its cell's count is so many times the mean of all cells, and LEAST_HOT at least: what a packed block
#: holds of any other token is bounded.  Blocks have some MEETING tokens of prefixes, MEETINGS blocks at least; one piece of a
#: block comes from PIECE tokens of a task.
HOT, LEAST_HOT, MEETING, MEETINGS, PIECE = 8, 1024, 1 << 22, 64, 1 << 21
#: A code of the sketch is so many times the count's binary logarithm; 0 is a count of one.
_STEPS = 8


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens ^ U64(0x452821E638D01377)) >> U64(64 - CELL_BITS)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Small whole numbers as planes of bytes; the high planes are nearly empty and pack well."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def named(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each text: ``id``, ``n_shingles``, ``s1``, ``s2`` (which name its set); and each task's counts of tokens:
    ``block`` of cells, ``n`` cells, their ``gaps`` and ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint16)
        for batch in batches:
            hashes, bounds, names = named_sets(batch.column(1), width)
            cells, more = np.unique(_cell(hashes), return_counts=True)
            counts[cells] = np.minimum(counts[cells] + more, 65535)
            n = len(bounds) - 1
            yield _both(n, id=batch.column(0), n_shingles=pa.array(np.diff(bounds)), s1=pa.array(names[0].view(np.int64)), s2=pa.array(names[1].view(np.int64)))
        for block in range(1 << (CELL_BITS - BLOCK_BITS)):
            part = counts[block << BLOCK_BITS : (block + 1) << BLOCK_BITS]
            at = np.flatnonzero(part)
            if len(at):
                yield _both(1, block=pa.array([block], pa.int32()), n=pa.array([len(at)], pa.int32()), gaps=pa.array([_packed(np.diff(at, prepend=0))], pa.binary()), counts=pa.array([_packed(part[at])], pa.binary()))

    return map_arrow(df.select(F.col(id_col).cast("long"), F.col(text_col)), run, ", ".join(f"{k} {v}" for k, v in _NAMED.items()))


_NAMED = {"id": "long", "n_shingles": "long", "s1": "long", "s2": "long", "block": "int", "n": "int", "gaps": "binary", "counts": "binary"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _both(rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(rows, _ARROW[t])) for c, t in _NAMED.items()], names=list(_NAMED))


def frequencies(first: DataFrame) -> np.ndarray:
    """Code of each cell's count over all tasks: a sketch of fixed size, merged by blocks."""

    def merge(rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for n, gaps, counts in zip(*(rows.column(c).to_pylist() for c in ("n", "gaps", "counts")), strict=True):
            total[np.cumsum(_unpacked(gaps, n))] += _unpacked(counts, n)
        codes = np.minimum(np.round(_STEPS * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        return pa.table({"block": rows.column("block").slice(0, 1).cast(pa.int32()), "codes": pa.array([codes.tobytes()], pa.binary())})

    out = np.zeros(1 << CELL_BITS, np.uint8)
    merged = first.where("block IS NOT NULL").select("block", "n", "gaps", "counts").groupBy("block").applyInArrow(merge, "block int, codes binary")
    for row in merged.toArrow().to_pylist():
        out[row["block"] << BLOCK_BITS : (row["block"] + 1) << BLOCK_BITS] = np.frombuffer(row["codes"], np.uint8)
    return out


def least_shared(n: int, percent: int) -> int:
    """Tokens that a set of ``n`` shares with any set of sufficient likeness."""
    return -(-percent * n // 100)


def prefix(codes: np.ndarray, percent: int) -> tuple[int, int]:
    """Length of the prefix and number of its tokens that a partner must share, for a set's codes in order."""
    n = len(codes)
    shared = least_shared(n, percent)
    least = 1 + n // LENGTHEN
    matches = np.arange(least, min(2 * least + EXTRA, shared) + 1)
    others = np.exp2(codes[: n - shared + matches[-1]] / _STEPS) - 1
    entries = np.cumsum(others)[n - shared + matches - 1]
    best = int(np.argmin(entries * (1 + n / (VERIFY * matches))))
    return n - shared + int(matches[best]), int(matches[best])


def prefixes(df: DataFrame, width: int, percent: int, codes: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n``, ``s1``, ``s2``, ``l`` (tokens to share), and the prefix: ``hot`` tokens, which are frequent, and other ``tokens``."""
    known = df.sparkSession.sparkContext.broadcast(codes)
    frequent = hot_code(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds, names = named_sets(batch.column(1), width)
            size = np.diff(bounds)
            code = known.value[_cell(hashes)]
            order = np.lexsort((hashes, code, np.repeat(np.arange(len(size)), size)))
            hashes, code = hashes[order], code[order]
            matches, parts = np.zeros(len(size), np.int32), ([], [])
            for i in range(len(size)):
                own = slice(bounds[i], bounds[i + 1])
                if size[i]:
                    length, matches[i] = prefix(code[own], percent)
                    most = length - np.count_nonzero(code[own][:length] >= frequent)
                    parts[0].append(hashes[own][:most])
                    parts[1].append(hashes[own][most:length])
                else:
                    for part in parts:
                        part.append(hashes[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *[pa.array(x.view(np.int64)) for x in names], pa.array(matches), *map(_lists, parts)], names=["id", "n", "s1", "s2", "l", "tokens", "hot"])

    return map_arrow(df.select(F.col(id_col).cast("long"), F.col(text_col)), run, "id long, n long, s1 long, s2 long, l int, tokens array<long>, hot array<long>")


def _lists(tokens: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*tokens, np.zeros(0, U64)]).view(np.int64)))


def hot_code(codes: np.ndarray) -> int:
    """The least code of a frequent token."""
    counts = sum(np.bincount(part, minlength=256) for part in np.array_split(codes, max(1, len(codes) >> 18)))
    mean = np.exp2(np.arange(256) / _STEPS) @ counts / len(codes)
    return int(np.ceil(_STEPS * np.log2(max(LEAST_HOT, HOT * mean))))


def held(heads: DataFrame, blocks: int) -> DataFrame:
    """``id``, ``token`` and ``k`` (the prefixes that hold it) of tokens that several prefixes hold."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, size = [], [], 0
        for batch in batches:
            lists = batch.column(1)
            ids.append(np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)))
            tokens.append(lists.flatten().to_numpy())
            size += len(tokens[-1])
            if size >= PIECE:
                yield _pieces(np.concatenate(ids), np.concatenate(tokens), blocks)
                ids, tokens, size = [], [], 0
        if size:
            yield _pieces(np.concatenate(ids), np.concatenate(tokens), blocks)

    def meet(group: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("tokens").to_pylist()])
        order = np.argsort(tokens, kind="stable")
        ordered = tokens[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(starts, len(ordered)))
        k = np.repeat(counts, counts)
        kept = k > 1
        ids = np.concatenate([_ids(*x) for x in zip(*(group.column(c).to_pylist() for c in ("ids", "n", "owners")), strict=True)])
        return pa.table({"id": ids[order[kept]], "token": ordered[kept], "k": k[kept]})

    packed = map_arrow(heads.select("id", "tokens").where(F.size("tokens") > 0), pieces, "block int, tokens binary, owners binary, ids binary, n int")
    rare = packed.groupBy("block").applyInArrow(meet, "id long, token long, k long").select("id", "token", "k")
    postings = heads.select("id", F.explode("hot").alias("token"))
    counts = written(postings.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "join-held")
    return rare.unionByName(postings.join(counts, "token").select("id", "token", "k"))


def _pieces(ids: np.ndarray, tokens: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Postings as a row for each block: tokens, and their texts as places in the row's list of ids."""
    block = ((tokens.view(U64) >> U64(20)) % U64(blocks)).astype(np.int32)
    order = np.lexsort((ids, block))
    block, ids, tokens = block[order], ids[order], tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    rows = []
    for a, b in zip(starts, np.append(starts[1:], len(block)), strict=True):
        own, n = np.unique(ids[a:b], return_counts=True)
        gaps = np.diff(own.astype(np.int64), prepend=np.int64(0)).tobytes()
        rows.append((int(block[a]), tokens[a:b].tobytes(), _packed(n), pa.compress(gaps, codec="zstd", asbytes=True), len(own)))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "tokens", "owners", "ids", "n"])


def _ids(gaps: bytes, n: int, owners: bytes) -> np.ndarray:
    own = np.cumsum(np.frombuffer(pa.decompress(gaps, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64))
    return np.repeat(own, _unpacked(owners, n))


def contents(df: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``shingles`` (ascending hashes) of the texts whose id is in the stored ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = sets(batch.column(1), width)
            full = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, pa.binary())], names=["id", "shingles"])

    ids = F.broadcast(ids) if small_enough(ids) else ids
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")).join(ids, "id", "left_semi")
    return map_arrow(rows, run, "id long, shingles binary").where(F.octet_length("shingles") > 0)


def confirmed(df: DataFrame, pairs: DataFrame, width: int, percent: int, id_col: str, text_col: str, name: str) -> DataFrame:
    """The stored ``pairs`` (``a``, ``b``) that are alike enough, on full sets.  Partners of one text are dealt in parts of ``BLOCK``."""

    def run(group: pa.Table) -> pa.Table:
        own = group.column("a")[0].as_py()
        rows = list(zip(group.column("id").to_pylist(), [np.frombuffer(x, U64) for x in group.column("shingles").to_pylist()], strict=True))
        hubs = [x for i, x in rows if i == own]
        out = sorted({i for i, x in rows if i != own and any(similar(h, x, percent) for h in hubs)})
        return pa.table({"a": pa.array([own] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    sizes = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")), f"{name}-sizes")
    dealt = written(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part")), f"{name}-dealt")
    rows = dealt.select("a", "part", F.col("b").alias("id")).unionByName(dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("id")))
    content = written(contents(df, written(rows.select("id").distinct(), f"{name}-ids"), width, id_col, text_col), f"{name}-sets")
    # Sets move once, to their group, unless the rows are too many to broadcast.
    rows = F.broadcast(rows) if small_enough(dealt, BROADCAST_ROWS // 2) else rows
    found = written(content.join(rows, "id").groupBy("a", "part").applyInArrow(run, "a long, b long"), f"{name}-links")
    drop(content)
    return found


def _incidence(lists: list[np.ndarray]) -> np.ndarray:
    """A row for each list, a column for each number that two lists or more hold."""
    flat, of = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    held, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    out = np.zeros((len(lists), int((n > 1).sum())), np.float32)
    on = n[place] > 1
    out[of[on], column[place[on]]] = 1
    return out


def _within_blocks(percent: int):
    """Links between rows of different components of two blocks of one long list, as far as it is the first list of those whose
    keys both have; once two components are linked, they count as one."""

    def run(group: pa.Table) -> pa.Table:
        token = group.column("token")[0].as_py()
        ids, comps, matches, left = (group.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "l", "is_left"))
        tokens, keys = ([np.array(x, np.int64) for x in group.column(c).to_pylist()] for c in ("tokens", "keys"))
        full = [np.frombuffer(x, U64) for x in group.column("shingles").to_pylist()]
        size = np.array([len(x) for x in full])
        lefts, rights = np.flatnonzero(left), np.flatnonzero(~left)
        shared, earlier = _incidence(tokens), _incidence([x[x < token] for x in keys])
        near = (shared[lefts] @ shared[rights].T >= np.minimum.outer(matches[lefts], matches[rights])) & (earlier[lefts] @ earlier[rights].T == 0)
        near &= (comps[lefts][:, None] != comps[rights]) & (100 * np.minimum.outer(size[lefts], size[rights]) >= percent * np.maximum.outer(size[lefts], size[rights]))
        root = {c: c for c in comps.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x, y in np.argwhere(near):
            i, j = lefts[x], rights[y]
            a, b = find(int(comps[i])), find(int(comps[j]))
            if a != b and similar(full[i], full[j], percent):
                root[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _sharing(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) that share enough tokens of their prefixes to be linked."""
    a, b = (shared.select(F.col("id").alias(x), F.col("l").alias(f"l_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return both.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.least("l_a", "l_b")).select("a", "b")


def links(df: DataFrame, first: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``a``, ``b``: confirmed links that connect whatever is linked."""
    known = first.where("id IS NOT NULL AND n_shingles > 0").select("id", F.col("n_shingles").alias("n"), "s1", "s2")
    name = ["s1", "s2", "n"]
    repeated = written(known.groupBy(*name).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select(*name, "least"), "join-classes")
    same = known.join(repeated, name).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))

    texts = written(prefixes(df, width, percent, frequencies(first), id_col, text_col).where("id IS NOT NULL AND n > 0"), "join-prefixes")
    heads = texts.join(F.broadcast(repeated) if small_enough(repeated) else repeated, name, "left").where("least IS NULL OR id = least")
    meeting = texts.agg(F.sum(F.size("tokens")).alias("n")).head()["n"] or 0
    ranked = held(heads, max(MEETINGS, -(-meeting // MEETING))).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("ranked"))
    ranked = ranked.join(heads.groupBy("id").agg(F.min("n").alias("n"), F.min("l").alias("l")), "id")
    fewest = F.expr(f"1 + ({percent} * n + 99) div 100 div {LENGTHEN}").cast("int")
    # Rows of one id are one text here, with the tokens of all, the fewest to share and the least l.
    ranked = ranked.select("id", "l", F.array_distinct(F.transform("ranked", lambda x: x["token"])).alias("tokens"), fewest.alias("fewest"))
    shared = written(ranked.where(F.size("tokens") >= F.col("fewest")).select("id", "l", "tokens", F.slice("tokens", F.lit(1), F.size("tokens") - F.col("fewest") + 1).alias("keys")), "join-shared")
    drop(texts)

    keys = shared.select("id", F.explode("keys").alias("token"))
    lists = written(keys.groupBy("token").agg(F.min("id").alias("head"), F.max("id").alias("most")).where("head <> most").select("token", "head"), "join-lists")
    members = written(keys.join(lists, "token"), "join-members")
    by_head = members.where("id <> head").groupBy("head", "id").agg(F.count(F.lit(1)).alias("c"))
    stars = by_head.groupBy("id").agg(F.max(F.struct("c", (-F.col("head")).alias("less"))).alias("best")).select((-F.col("best.less")).alias("a"), F.col("id").alias("b"))
    found = confirmed(df, written(_sharing(stars, shared), "join-stars"), width, percent, id_col, text_col, "join-star")

    labels = written(components(found), "join-labels").withColumnRenamed("node", "id")
    placed = members.drop("head").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    open_lists = parts.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("n_all"), F.max(F.struct("k", "component")).alias("main")).where("parts > 1")
    open_lists = written(open_lists.select("token", F.col("main.component").alias("main"), "n_all", (F.col("n_all") - F.col("main.k")).alias("n_others")), "join-open")
    rows = written(placed.join(open_lists, "token"), "join-unsettled")

    short = rows.where(F.col("n_all") <= SHORT)
    a, b = (short.select("token", F.col("id").alias(x), F.col("component").alias(f"component_{x}")) for x in "ab")
    pairs = a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))).select("a", "b").distinct()
    more = confirmed(df, written(_sharing(pairs, shared), "join-pairs"), width, percent, id_col, text_col, "join-pair")

    # Every pair of different components has a row outside the main one: those rows, in blocks, meet all rows, in blocks.
    long_rows = rows.where(F.col("n_all") > SHORT)
    left_blocks, right_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_others", "n_all"))
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    lefts = long_rows.where("component <> main").withColumn("i", F.pmod(own, left_blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), right_blocks - 1))).withColumn("is_left", F.lit(True))
    rights = long_rows.withColumn("j", F.pmod(own, right_blocks).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), left_blocks - 1))).withColumn("is_left", F.lit(False))
    columns = ["token", "i", "j", "id", "component", "is_left"]
    content = written(contents(df, written(long_rows.select("id").distinct(), "join-long-ids"), width, id_col, text_col), "join-long-sets")
    blocks = lefts.select(columns).unionByName(rights.select(columns)).join(content.join(shared, "id"), "id")
    hot = written(blocks.groupBy("token", "i", "j").applyInArrow(_within_blocks(percent), "a long, b long"), "join-block-links")
    return same.unionByName(found).unionByName(more).unionByName(hot)


def linked(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` (the least id reachable by links) of every row."""
    whole_numbers(df, id_col)
    first = written(named(df, width, id_col, text_col), "join-names")
    labels = written(components(links(df, first, width, percent, id_col, text_col)), "join-components")
    texts = first.where("block IS NULL").select("id", "n_shingles")
    return texts.join(labels, texts["id"] == labels["node"], "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < {WIDTH} THEN [array_to_string(words, ' ')]
                                     ELSE list_transform(range(1, len(words) - {WIDTH - 2}), lambda i: array_to_string(words[i:i + {WIDTH - 1}], ' ')) END) AS shingle
      FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
linked AS (
    SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
    JOIN n ON n.doc_id = p.a JOIN n m ON m.doc_id = p.b WHERE 100 * k >= {PERCENT} * (n.n + m.n - k)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN linked l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
