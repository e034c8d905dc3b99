"""Embedding near-duplicates through a pivot-permutation index: ordered nearest reference points, inverted pivot lists, exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import stored
from pulsegrid.llm.jaccard import components

THRESHOLD = 0.93
#: Nearest pivots that describe a vector; two vectors meet in the lists of each pair of pivots they share and are looked at if they share SHARED.
NEAREST, SHARED = 8, 3
#: Pivots of ``n`` vectors: so many times the root of n, so that the list of a pair of pivots stays as short as it is. Chosen from SAMPLED times as many vectors.
PIVOTS, SAMPLED = 2, 4
#: Pivots are no closer to each other than this cosine, or a large group of near copies would draw most of them.
APART = 0.7
#: Vectors with the same two nearest pivots beyond which their middle becomes a core, and the rows of one side of a block.
DENSE, BLOCK = 32, 2048
#: Angles are sure up to this.
SLACK = 1e-6
KEY = "d1 bigint, d2 bigint"


def _plus(df: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(c, t) for c, t in columns.items())])


def _vectors(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of numbers in double precision, scaled to a largest component of 1, filled with zeros up to ``width``."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width or int(lengths.max(initial=1))))
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out / np.maximum(np.abs(out).max(axis=1, initial=0), np.finfo(float).tiny)[:, None]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits that stand for a label and a vector; null where the vector links with nothing."""
    for batch in batches:
        keys = []
        for label, vector in zip(batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
            good = label is not None and vector and None not in vector and all(map(math.isfinite, vector)) and any(vector)
            digest = hashlib.blake2b(f"{label}:".encode() + np.array(vector, np.float64).tobytes(), digest_size=16).digest() if good else None
            keys.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)) if digest else (None, None))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))], ["id", "label", "v", "d1", "d2"])


def choose_pivots(points: DataFrame, count: int, width: int) -> np.ndarray:
    """Reference points: of the vectors with the least digests (a sample of SAMPLED for each pivot, two roots of all rows), those that lie apart."""
    wanted = max(2 * NEAREST, round(PIVOTS * math.sqrt(count)))
    sample = points.orderBy("d1", "d2").select("v").limit(SAMPLED * wanted).toArrow()
    vectors = _unit(_vectors(sample.column("v").combine_chunks(), width))
    chosen, size = np.zeros((wanted, width)), 0
    for vector in vectors:
        if size < wanted and (chosen[:size] @ vector).max(initial=-1) < APART:
            chosen[size] = vector
            size += 1
    # Too few directions in the data: the axes are reference points too.
    return chosen[:size] if size > NEAREST else np.vstack((chosen[:size], np.eye(width), -np.eye(width)))


def _described(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the ordered nearest pivots (fewer, if there are not NEAREST)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros((batch.num_rows, min(NEAREST, len(pivots))), np.int32)
            for at in range(0, batch.num_rows, BLOCK):
                cosines = _unit(_vectors(batch.column("v").slice(at, BLOCK), pivots.shape[1])) @ pivots.T
                near[at : at + BLOCK] = np.argsort(-cosines, axis=1, kind="stable")[:, : near.shape[1]]
            lists = pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1], pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "near"])

    return run


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Rows with equal keys, which come together, as tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        begin = 0
        for end in (np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist():
            yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
            held, begin = [], end
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of each cell, within a partition."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        vectors = _unit(_vectors(batch.column("v")))
        for row, cell in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "width", "cell")), strict=True)):
            sums[cell] = sums.get(cell, 0) + vectors[row, : cell[1]]
    if sums:
        cells = list(sums)
        columns = [pa.array([c[0] for c in cells], batch.schema.field("label").type), pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells], pa.int64()), pa.array([sums[c].tolist() for c in cells], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["label", "width", "cell", "v"])


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the angle between ``v`` and ``middle``."""
    for batch in batches:
        a, b = _unit(_vectors(batch.column("v"))), _unit(_vectors(batch.column("middle")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arccos(np.clip((a * b).sum(axis=1), -1, 1)))], [*batch.schema.names, "angle"])


def _with_angle(df: DataFrame) -> DataFrame:
    return df.mapInArrow(_angles, _plus(df, angle=T.DoubleType()))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a list of a pair of pivots that share SHARED pivots with another one, if no earlier list holds both."""
    for group in grouped(batches, "key", "i", "j"):
        a, b = _meet(group)
        if len(a):
            yield from group.select(["key", "i", "j", "side", "d1", "d2"]).take(pa.array(np.unique(np.concatenate((a, b))))).combine_chunks().to_batches()


def _meet(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = group.column("near").combine_chunks()
    rows = len(lists)
    near = lists.flatten().to_numpy().reshape(rows, -1)
    if rows < 2:
        return np.zeros(0, int), np.zeros(0, int)
    pivots, column = np.unique(near, return_inverse=True)
    member = np.zeros((rows, len(pivots)), np.float32)
    member[np.arange(rows)[:, None], column.reshape(near.shape)] = 1
    # The pair's own list is that of the two least pivots it shares.
    key = group.column("pair")[0].as_py()
    high = np.searchsorted(pivots, key & 0xFFFFFFFF)
    before = member[:, :high].copy()
    before[:, np.searchsorted(pivots, key >> 32)] = 0
    good = (member @ member.T >= min(SHARED, near.shape[1])) & (before @ before.T == 0)
    return _one_sided(np.triu(good, 1), group)


def _one_sided(good: np.ndarray, group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block with itself: all pairs; two blocks: pairs across."""
    side = group.column("side").to_numpy()
    if group.column("i")[0].as_py() != group.column("j")[0].as_py():
        good = good & (side[:, None] != side[None, :])
    return np.nonzero(good)


def _linked(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Exact cosines of a group: each vector's links, and the least vector it reaches in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "key", "i", "j"):
            if group.num_rows < 2:
                continue
            vectors = _vectors(group.column("v").combine_chunks())
            norms = np.linalg.norm(vectors, axis=1)
            cosines = np.triu((vectors @ vectors.T) / (norms[:, None] * norms[None, :]) >= threshold, 1)
            if "near" in group.schema.names:
                a, b = _meet(group)
                keep = cosines[a, b]
                a, b = a[keep], b[keep]
            else:
                a, b = _one_sided(cosines, group)
            if not len(a):
                continue
            weight = group.column("copies").to_numpy()
            links = np.bincount(a, weights=weight[b], minlength=len(norms)) + np.bincount(b, weights=weight[a], minlength=len(norms))
            root = np.arange(len(norms))
            while True:
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, b, root[a])
                low = low[low]
                if np.array_equal(low, root):
                    break
                root = low
            on = np.flatnonzero(links)
            d1, d2 = (group.column(c).to_numpy() for c in ("d1", "d2"))
            yield pa.RecordBatch.from_arrays([pa.array(d1[on]), pa.array(d2[on]), pa.array(links[on].astype(np.int64)), pa.array(d1[root[on]]), pa.array(d2[root[on]])], ["d1", "d2", "links", "r1", "r2"])

    return run


LINKS = f"{KEY}, links bigint, r1 bigint, r2 bigint"


def _pair(a, b):
    return F.shiftleft(F.least(a, b).cast("bigint"), 32) + F.greatest(a, b).cast("bigint")


def _pairs_of_pivots(df: DataFrame) -> DataFrame:
    """A row for every pair of pivots in ``near``."""
    pairs = F.flatten(F.transform("near", lambda x, i: F.transform(F.slice("near", 1, i), lambda y: _pair(x, y))))
    return df.withColumn("pair", F.explode_outer(pairs)).where("pair is not null").withColumn("key", F.xxhash64("label", "width", "pair"))


def _blocks(members: DataFrame, group: str) -> DataFrame:
    """Deals the rows of a group over blocks of about BLOCK rows, and each to all pairs of blocks it has a part in."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / (2 * BLOCK)).cast("bigint")
    dealt = members.join(sizes, group).withColumn("parts", F.when(parts > 1, 2 * parts).otherwise(1)).withColumn("side", F.pmod(F.xxhash64("d2", "d1"), "parts"))
    dealt = dealt.withColumn("other", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("size", "parts", "other")


def _cores(points: DataFrame, radius: float) -> DataFrame:
    """Points of dense cells within ``radius`` of the cell's middle: core, d1, d2, copies, v, near, middle, angle. Any two of a core are linked."""
    cell = ("label", "width", "cell")
    placed = points.withColumn("cell", _pair(F.get("near", F.lit(0)), F.get("near", F.lit(1))))
    dense = placed.groupBy(*cell).agg(F.count("*").alias("size")).where(F.col("size") > DENSE).drop("size")
    inside = stored(placed.join(dense, list(cell)))
    schema = _plus(inside.select(*cell), v=T.ArrayType(T.DoubleType()))
    partial = inside.select(*cell, "v").mapInArrow(_sums, schema)
    middles = partial.repartition(*cell).mapInArrow(_totals, schema).withColumnRenamed("v", "middle")
    near = _with_angle(inside.join(stored(middles), list(cell))).where(F.col("angle") <= radius)
    core = F.xxhash64(*cell).alias("core")
    return stored(near.select(core, "label", "width", "d1", "d2", "copies", "v", "near", "middle", "angle"))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for *cell, v in zip(*(batch.column(c).to_pylist() for c in ("label", "width", "cell", "v")), strict=True):
            sums[tuple(cell)] = sums.get(tuple(cell), 0) + np.array(v)
    good = {c: v for c, v in sums.items() if np.abs(v).max() > 0}
    if good:
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in good], batch.schema.field("label").type), pa.array([c[1] for c in good], pa.int32()), pa.array([c[2] for c in good], pa.int64()), pa.array([v.tolist() for v in good.values()], pa.list_(pa.float64()))], ["label", "width", "cell", "v"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other rows of the same label at cosine ``threshold`` or more), component_id (least id reached).

    Equal vectors are one point with a number of copies. A point is described by its NEAREST pivots in order. Points whose two
    nearest pivots are those of many others are measured against their common middle: all within half the angle of the
    threshold are linked for certain and become a core, which counts by its size. The other points meet in the
    lists of pairs of pivots; those that share SHARED pivots are compared exactly, in blocks, in the list of the two least pivots
    they share. A core stands in the lists of all its points: by the triangle inequality a shell of it (points
    at about one distance from the middle) is linked with a point or another shell as a whole, or not at all, or else
    compared exactly. So a large group of near copies never gives its pairs as rows.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite numbers, link with nothing. Vectors of
    different lengths are not compared. Only the pivots (PIVOTS times the root of the number of points) come to the driver.
    """
    theta = math.acos(threshold)
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    keyed = stored(base.mapInArrow(_digests, _plus(base, d1=T.LongType(), d2=T.LongType())))
    points = keyed.where("d1 is not null").groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("v").alias("v"))
    points = points.withColumn("width", F.size("v"))
    points = stored(points)
    count, width = points.agg(F.count("*"), F.max("width")).first()
    out = keyed.select("id", "d1", "d2")
    if not count:
        return out.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    described = stored(points.drop("least").mapInArrow(_described(choose_pivots(points, count, width)), _plus(points.drop("least"), near=T.ArrayType(T.IntegerType()))))
    key = ["d1", "d2"]
    # Two points within half the angle of a middle are within the angle; the slack is far above the error of an arc cosine near 1.
    members = _cores(described, theta / 2 - SLACK)
    singles = stored(described.join(members.select(*key), key, "left_anti"))

    # Points that are in no core: lists of pairs of pivots, then exact cosines of those that share enough.
    entries = _pairs_of_pivots(singles.drop("v", "copies"))
    listed = _blocks(entries.select("key", "pair", "d1", "d2", "near"), "key").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    met = stored(listed.mapInArrow(_candidates, f"key bigint, i bigint, j bigint, side bigint, {KEY}"))
    pair_of = entries.select("key", "pair", "d1", "d2")
    exact = met.join(pair_of, ["key", *key]).join(singles.select(*key, "copies", "v", "near"), key).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = [exact.mapInArrow(_linked(threshold), LINKS)]

    # Cores and their shells: half a degree each.
    shell = F.floor(F.col("angle") / math.radians(0.5)).cast("int").alias("shell")
    members = members.withColumn("shell", shell)
    shells = stored(members.groupBy("core", "shell").agg(F.sum("copies").alias("size"), F.count("*").alias("rows"), F.max("angle").alias("most"), F.min(F.struct("d1", "d2")).alias("head")))
    cores = stored(members.groupBy("core").agg(F.sum("copies").alias("size"), F.first("middle").alias("middle"), F.max("angle").alias("most"), F.min(F.struct("d1", "d2")).alias("head")))
    core_lists = stored(_pairs_of_pivots(members.select("core", "label", "width", "near").distinct()).select("key", "core").distinct())

    own = members.join(cores.select("core", "size", "head"), "core").select(*key, (F.col("size") - F.col("copies")).alias("links"), F.col("head.d1").alias("r1"), F.col("head.d2").alias("r2"))
    # (point, core) and (core, core) that share a list and are near enough.
    seen = entries.join(core_lists, "key").select(*key, "core").distinct().join(singles.select(*key, "copies", "v"), key).join(cores.select("core", "middle", F.col("most").alias("core_most")), "core")
    seen = _with_angle(seen).where(F.col("angle") - F.col("core_most") <= theta + SLACK).select(*key, "copies", "core", "angle")
    two = core_lists.select("key", F.col("core").alias("core_b")).join(core_lists, "key").where("core < core_b").select("core", "core_b").distinct()
    two = two.join(cores.select("core", F.col("middle").alias("v"), F.col("most").alias("most_a")), "core").join(cores.select(F.col("core").alias("core_b"), "middle", F.col("most").alias("most_b")), "core_b")
    two = _with_angle(two).where(F.col("angle") - F.col("most_a") - F.col("most_b") <= theta + SLACK).select("core", "core_b", "angle")
    point_shell = stored(seen.join(shells, "core").where(F.col("angle") - F.col("most") <= theta + SLACK))
    b = shells.select(F.col("core").alias("core_b"), F.col("shell").alias("shell_b"), F.col("size").alias("size_b"), F.col("rows").alias("rows_b"), F.col("most").alias("most_b"), F.col("head").alias("head_b"))
    two_shells = stored(two.join(shells, "core").join(b, "core_b").where(F.col("angle") - F.col("most") - F.col("most_b") <= theta + SLACK))
    sure, sure_two = F.col("angle") + F.col("most") <= theta - SLACK, F.col("angle") + F.col("most") + F.col("most_b") <= theta - SLACK
    head = (F.col("head.d1").alias("r1"), F.col("head.d2").alias("r2"))
    found.append(point_shell.where(sure).select(*key, F.col("size").alias("links"), *head))
    whole = point_shell.where(sure).groupBy("core", "shell").agg(F.sum("copies").alias("links"))
    whole = whole.unionByName(two_shells.where(sure_two).select("core", "shell", F.col("size_b").alias("links"))).unionByName(two_shells.where(sure_two).select(F.col("core_b").alias("core"), F.col("shell_b").alias("shell"), F.col("size").alias("links")))
    whole = whole.groupBy("core", "shell").agg(F.sum("links").alias("links"))
    found.append(own)
    found.append(members.join(whole, ["core", "shell"]).select(*key, "links", F.col("d1").alias("r1"), F.col("d2").alias("r2")))
    edges = two_shells.where(sure_two).select(F.col("head").alias("u"), F.col("head_b").alias("v"))

    # What the shells leave open is compared point by point: one side of a block is part of a shell, the other part of another or single points.
    point_open = point_shell.where(~sure).select("core", "shell", "rows", *key, F.lit(1).cast("bigint").alias("other_rows"), F.xxhash64("core", "shell").alias("key"))
    waiting = point_open.groupBy("key").agg(F.count("*").alias("other_rows"))
    point_open = point_open.drop("other_rows").join(waiting, "key")
    shells_open = two_shells.where(~sure_two).select(F.xxhash64("core", "shell", "core_b", "shell_b").alias("key"), "core", "shell", "rows", "core_b", "shell_b", F.col("rows_b").alias("other_rows"))
    a_side = point_open.select("key", "core", "shell", "rows", "other_rows").distinct().unionByName(shells_open.select("key", "core", "shell", "rows", "other_rows"))
    a_rows = a_side.join(members.select("core", "shell", *key), ["core", "shell"]).select("key", *key, F.lit(True).alias("first"), "rows", "other_rows")
    b_rows = point_open.select("key", *key, F.lit(False).alias("first"), F.col("other_rows").alias("rows"), F.col("rows").alias("other_rows"))
    b_side = shells_open.select("key", F.col("core_b").alias("core"), F.col("shell_b").alias("shell"), F.col("other_rows").alias("rows"), F.col("rows").alias("other_rows"))
    b_rows = b_rows.unionByName(b_side.join(members.select("core", "shell", *key), ["core", "shell"]).select("key", *key, F.lit(False).alias("first"), "rows", "other_rows"))
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("bigint")
    both = a_rows.unionByName(b_rows).withColumn("own", F.pmod(F.xxhash64("d2", "d1"), parts("rows"))).withColumn("other", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), parts("other_rows") - 1)))
    both = both.select("key", F.when(F.col("first"), F.col("own")).otherwise(F.col("other")).alias("i"), (F.when(F.col("first"), F.col("other")).otherwise(F.col("own")) + (1 << 40)).alias("j"), F.col("first").cast("bigint").alias("side"), *key)
    both = both.join(described.select(*key, "copies", "v"), key).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found.append(both.mapInArrow(_linked(threshold), LINKS))

    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = stored(every)
    links = every.groupBy(*key).agg(F.sum("links").alias("links"))
    roots = components(every.select(F.struct(*key).alias("u"), F.struct(F.col("r1").alias("d1"), F.col("r2").alias("d2")).alias("v")).unionByName(edges))
    named = points.select(*key, "copies", "least").join(links, key, "left").withColumn("node", F.struct(*key)).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "root").select(*key, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return out.join(named, key, "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
