"""MinHash near-duplicate detection by fast similarity sketching.

A text's set is that of its distinct word shingles.  Its sketch has ``COORDINATES`` places.
In rounds, every hash of the set falls into one place of each round; a place keeps the
least value of the first round that reaches it.  After as many rounds as there are places,
one round for each place takes every hash, so every place is filled.  Two sketches agree in
a place with the probability of the sets' likeness, and the number of agreements is as
concentrated as that of independent trials (Dahlgaard, Knudsen, Thorup, 2017).

Bands of ``ROWS`` places make buckets.  With 40 bands of 6, a pair of likeness 0.8 shares
no bucket with probability ``(1 - 0.8 ** 6) ** 40``, five in a million.

Links are confirmed on full sets, in two steps that never emit the pairs of a group:

1. Texts of equal sets are one class, named by its least id.  In each bucket every class
   is compared with the least one.
2. Where the others of a bucket, which that leaves uncompared with each other, then still
   hang in several components, classes of different components are compared, block by
   block; blocks have a fixed size, so a large bucket is many tasks' work.  A bucket of two
   classes is done after the first step.  Only confirmed links are emitted.

Classes of one bucket whose sketches agree in less than ``least_agreement`` of the places
are not compared on full sets.  By the Chernoff bound a pair of likeness 0.8 falls under
0.55 of 240 places with probability 3e-17, less than what 64-bit hashes confuse; 0 turns
the test off and compares all classes of a bucket on full sets.

Edge cases: ids are whole numbers, or the call fails; a null text, or one without words, has the empty set and links with nothing; a
text with fewer words than a shingle is one shingle; rows of equal id are one node, which
has the links of all its texts; a row of null id is kept and links with nothing; an empty
table gives an empty result; other columns are ignored (``near_duplicates``) or pass
through (``deduplicated``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import kernels
from plumbline.llm.common import map_arrow, small_enough, table, whole_numbers, written
from plumbline.llm.components import components
from plumbline.llm.kernels import U64, mix

COORDINATES, ROWS = 240, 6
BANDS = COORDINATES // ROWS
LEAST_AGREEMENT = 0.55
#: Classes of one block.  A task compares two blocks at most.
BLOCK = 128
_UNSET = np.uint64(2**64 - 1)


def _both_sets(texts: pa.Array, width: int, seconds: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = kernels.text_bytes(texts)
    starts, _, *words = kernels.words(data, offsets, lower=True, seconds=seconds)
    of_text = kernels.word_bounds(offsets, starts)
    hashes, bounds = kernels.shingles(words[0], of_text, width)
    firsts = [np.unique(hashes[bounds[i] : bounds[i + 1]], return_index=True)[1] + bounds[i] for i in range(len(bounds) - 1)]
    at = np.concatenate([*firsts, np.zeros(0, np.int64)])
    other = kernels.shingles(words[1], of_text, width)[0][at] if seconds else at[:0].astype(U64)
    return hashes[at], other, np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int64)


def sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and the bounds of the texts.  A-Z count as a-z."""
    hashes, _, bounds = _both_sets(texts, width, False)
    return hashes, bounds


def named_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``sets``, and two numbers of 64 bits that name each set: sums over its shingles, each from a word hash of its own."""
    hashes, other, bounds = _both_sets(texts, width, True)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    names = [np.zeros(len(bounds) - 1, U64) for _ in range(2)]
    with np.errstate(over="ignore"):
        for total, x in zip(names, (hashes, other), strict=True):
            np.add.at(total, of, mix(x ^ U64(0x2545F4914F6CDD1D)))
    return hashes, bounds, names


def sketches(hashes: np.ndarray, bounds: np.ndarray, places: int = COORDINATES) -> np.ndarray:
    """A row of places for each set; that of an empty set stays unset."""
    n, size = len(bounds) - 1, np.diff(bounds)
    flat = np.full(n * places, _UNSET)
    doc, todo = np.repeat(np.arange(n), size), size > 0
    for i in range(2 * places):
        if i:
            todo = (flat.reshape(n, places) == _UNSET).any(axis=1) & (size > 0)
            on = todo[doc]
            doc, hashes = doc[on], hashes[on]
        if not todo.any():
            break
        with np.errstate(over="ignore"):
            x = mix(hashes + U64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
            place = ((x >> U64(32)) * U64(places) >> U64(32)).astype(np.int64) if i < places else np.full(len(x), i - places)
            value = mix(x) >> U64(1)
        at = doc * places + place
        open_ = flat[at] == _UNSET
        fresh = np.full(n * places, _UNSET) if i == 0 else None
        if i == 0:
            np.minimum.at(fresh, at, value)
            flat = fresh
        else:
            at, value = at[open_], value[open_]
            order = np.lexsort((value, at))
            at, value = at[order], value[order]
            first = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
            flat[at[first]] = value[first]
    return flat.reshape(n, places)


def bands(sketch: np.ndarray) -> np.ndarray:
    """Key of each band: its places folded into one hash, with the number of the band."""
    with np.errstate(over="ignore"):
        parts = sketch.reshape(len(sketch), -1, ROWS)
        key = np.broadcast_to(mix(np.arange(parts.shape[1], dtype=U64)), parts.shape[:2]).copy()
        for i in range(ROWS):
            key = mix(key ^ parts[:, :, i])
    return key


def signatures(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, ``s1``, ``s2`` (128 bits that name the set), ``bands`` and ``sketch`` (a byte for each place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds, names = named_sets(batch.column(1), width)
            sketch = sketches(hashes, bounds)
            size = np.diff(bounds)
            names = [pa.array(x.view(np.int64)) for x in names]
            keys = bands(sketch)
            some = size > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(keys[some].reshape(-1).view(np.int64)))
            low = pa.array([x.tobytes() for x in (sketch & U64(255)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *names, lists, low], names=["id", "n_shingles", "s1", "s2", "bands", "sketch"])

    return map_arrow(df.select(F.col(id_col).cast("long"), F.col(text_col)), run, "id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of places in which rows of ``a`` and ``b`` agree, less what bytes agree by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _shared_before(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Whether rows of band keys share a band before ``band``: the keys that make the buckets, so that bucket exists."""
    return (a[..., :band] == b[..., :band]).any(axis=-1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on two sets of ascending hashes."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(percent: int, least_agreement: float = LEAST_AGREEMENT):
    """Confirmed links of a group: its left rows against its right rows, where their components differ.

    ``band`` is -1, or the bucket's band: then a pair that shares an earlier band's key as well (``keys``) is left to that one.
    """

    def run(group: pa.Table) -> pa.Table:
        ids, comps, left = (group.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "is_left"))
        band = group.column("band")[0].as_py()
        low = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in group.column("sketch")])
        full = [np.frombuffer(x.as_py(), U64) for x in group.column("shingles")]
        keys = np.stack([np.frombuffer(x.as_py(), U64) for x in group.column("keys")]) if band > 0 else None
        root = {c: c for c in comps.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out_a, out_b = [], []
        rows = np.flatnonzero(~left)
        for i in np.flatnonzero(left):
            near = rows[comps[rows] != comps[i]]
            if least_agreement > 0 and len(near):
                near = near[_agreement(low[near], low[i]) >= least_agreement]
            if band > 0 and len(near):
                near = near[~_shared_before(keys[near], keys[i], band)]
            for j in near:
                a, b = find(int(comps[i])), find(int(comps[j]))
                if a != b and similar(full[i], full[j], percent):
                    root[max(a, b)] = min(a, b)
                    out_a.append(int(ids[i]))
                    out_b.append(int(ids[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _with_content(rows: DataFrame, content: DataFrame) -> DataFrame:
    """The stored, narrow ``rows`` with their sets; these move once, to their group, unless the rows are too many to broadcast."""
    return content.join(F.broadcast(rows) if small_enough(rows) else rows, "id")


def links(df: DataFrame, sig: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text", least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """``a``, ``b``: confirmed links that connect whatever is linked, between texts of different sets, and
    from the least id to the others where sets are equal.

    What is aggregated by a key is stored before it is joined on that key: the join then has an exchange of its
    own, which Spark splits where a key is that of a large share of the rows, or broadcasts where it is small.
    """
    known = sig.where("id IS NOT NULL AND n_shingles > 0")
    name = ["s1", "s2", "n_shingles"]
    repeated = written(known.groupBy(*name).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*name, "least"), "minhash-classes")
    of_class = known.join(F.broadcast(repeated) if small_enough(repeated) else repeated, name, "left")
    same = of_class.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    heads = of_class.where("least IS NULL OR id = least")
    rows = heads.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = written(rows.groupBy("band", "key").agg(F.min("id").alias("centre"), F.max("id").alias("most")).where("centre <> most").select("band", "key", "centre"), "minhash-centres")
    members = written(rows.join(buckets, ["band", "key"]).select("band", "key", "id", "centre").distinct(), "minhash-buckets")

    taking_part = written(members.select("id").distinct(), "minhash-ids")
    if small_enough(taking_part):
        taking_part = F.broadcast(taking_part)
    content = written(_contents(df, taking_part, width, id_col, text_col), "minhash-sets")

    stars = members.where("id <> centre").select("centre", "id").distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))
    sizes = written(stars.groupBy("centre").agg(F.count(F.lit(1)).alias("n")), "minhash-sizes")
    stars = stars.join(sizes, "centre").select("centre", "id", F.pmod("part", F.ceil(F.col("n") / BLOCK)).alias("part"))
    spokes = stars.select("centre", "part", "id", F.lit(False).alias("is_left"))
    hubs = stars.select("centre", "part").distinct().select("centre", "part", F.col("centre").alias("id"), F.lit(True).alias("is_left"))
    first = _with_content(written(spokes.unionByName(hubs), "minhash-dealt"), content).select("centre", "part", "id", "is_left", F.lit(-1).alias("band"), F.xxhash64("id", "sketch", "n_shingles").alias("component"), "sketch", "shingles")
    found = written(first.groupBy("centre", "part").applyInArrow(_compare(percent, least_agreement), "a long, b long"), "minhash-stars")

    labels = written(components(found), "minhash-labels").withColumnRenamed("node", "id")
    # The least class of a bucket has been compared with all others there.
    open_ = members.where("id <> centre").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")).select("band", "key", "id", "component")
    parts = open_.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    unsettled = parts.groupBy("band", "key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n_all"), F.max(F.struct("n", "component")).alias("main")).where("parts > 1")
    unsettled = written(unsettled.select("band", "key", F.col("main.component").alias("main"), "n_all", (F.col("n_all") - F.col("main.n")).alias("n_others")), "minhash-open")
    rows = written(open_.join(unsettled, ["band", "key"]), "minhash-unsettled")
    # Every pair of different components has a row outside the main one: those rows, in blocks, meet all rows, in blocks.
    left_blocks, right_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_others", "n_all"))
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    lefts = rows.where("component <> main").withColumn("i", F.pmod(own, left_blocks).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), right_blocks - 1))).withColumn("is_left", F.lit(True))
    rights = rows.withColumn("j", F.pmod(own, right_blocks).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), left_blocks - 1))).withColumn("is_left", F.lit(False))
    columns = ["band", "key", "i", "j", "id", "component", "is_left"]
    second = _with_content(written(lefts.select(columns).unionByName(rights.select(columns)), "minhash-blocks"), content).select(*columns, "sketch", "shingles", "keys")
    more = written(second.groupBy("band", "key", "i", "j").applyInArrow(_compare(percent, least_agreement), "a long, b long"), "minhash-links")
    return same.unionByName(found).unionByName(more)


def _contents(df: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Sets and sketches of the texts whose id takes part: ``id``, ``n_shingles``, ``sketch``, ``shingles`` (ascending hashes), ``keys`` (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = sets(batch.column(1), width)
            sketch = sketches(hashes, bounds)
            low = (sketch & U64(255)).astype(np.uint8)
            full = [hashes[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array([x.tobytes() for x in low], pa.binary()), pa.array(full, pa.binary()), pa.array([x.tobytes() for x in bands(sketch)], pa.binary())], names=["id", "n_shingles", "sketch", "shingles", "keys"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")).join(ids, "id", "left_semi")
    return map_arrow(rows, run, "id long, n_shingles long, sketch binary, shingles binary, keys binary").where("n_shingles > 0")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` (the least id reachable) and ``kept`` of every row."""
    whole_numbers(df, id_col)
    sig = written(signatures(df, width, id_col, text_col), "minhash-signatures")
    labels = written(components(links(df, sig, width, percent, id_col, text_col, least_agreement)), "minhash-components")
    out = sig.select("id", "n_shingles").join(labels, sig["id"] == labels["node"], "left")
    component = F.coalesce("component", "id")
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicated(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """The rows of ``df``, all columns as they are, without those linked to a lesser id.  Texts are not shuffled unless
    the ids to drop are too many to broadcast.  Of rows of one id, all stay or none."""
    drop = written(near_duplicates(df, width, percent, id_col, text_col, least_agreement).where("NOT kept").select(F.col("id").alias("_drop")).distinct(), "minhash-dropped")
    if small_enough(drop):
        drop = F.broadcast(drop)
    return df.join(drop, df[id_col].cast("long") == drop["_drop"], "left_anti")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
