"""N-gram Jaccard self-join by chosen paths: split on sampled shared tokens, brute-force what is left together, repeat. Dense groups stand once, around a pivot."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import bounded, mapped, stored, text_keys, whole
from pulsegrid.llm.tokens import gram_hashes, lower_ascii, mix64, span_hashes, text_parts, within, word_spans

SHINGLE, THRESHOLD = 5, 0.8
#: Min-hash coordinates of a set: each is one token sampled alike in all sets, so that sets share it with the probability of their similarity.
COORDINATES = 64
#: Sets beyond which a bucket is split further, how often, and the sets of a block that one step of brute force compares.
SPLIT_OVER, SPLITS, BLOCK = 256, 2, 1024
#: Shingles of a block, so that long texts make more blocks: 16 MB.
BLOCK_TOKENS = 2 << 20
#: The share of a pair's runs that a bucket of any depth keeps together: one token at the root, then 1 (3 in 4) or 2 tokens a level.
RECALL = 0.9999
#: A pair at the threshold has fewer equal coordinates than this with probability below 1e-6; such pairs are not compared exactly.
MIN_EQUAL = 34
#: Sets of a large root bucket that are looked at for pivots, and how many of them must be close to one.
SAMPLE, DENSE = 256, 16
#: Pivots a bucket may hold; the others are given up, and their sets stay in the buckets.
CROWD = 16
#: Root buckets of pivots up to which these are hinted for broadcast (about 30 MB).
BROADCAST_PIVOTS = 100_000
#: Parts that a set has around a pivot: linked for certain with the rest of the core; to be compared with all; compared with those two only.
CORE, OPEN, SHELL = 0, 1, 2


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, splits: int = SPLITS) -> int:
    """Runs after which a pair at the threshold has met in a bucket with probability ``recall``, if every bucket were split to the end."""
    level = 0.75 * threshold + 0.25 * (1 - (1 - threshold) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * level**splits))


def reach_for(runs: int, recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Coordinates in which a set may differ from its pivot, so that what is linked with it shares a root bucket with the pivot with probability ``recall``."""
    return math.floor(COORDINATES * ((1 - recall) ** (1 / runs) - (1 - threshold)))


_SEEDS = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each row (A-Z lower-cased); fewer words, but not none, are one shingle."""
    data = lower_ascii(data)
    starts, ends, of = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    grams, at = gram_hashes(words, n), within(of, n)
    grams = grams[at] if len(at) else grams[:0]
    counts = np.maximum(np.diff(of) - n + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    sets = []
    for i in range(len(counts)):
        if counts[i]:
            sets.append(np.unique(grams[bounds[i] : bounds[i + 1]]))
        elif of[i + 1] > of[i]:
            sets.append(gram_hashes(words[of[i] : of[i + 1]], int(of[i + 1] - of[i])) ^ np.uint64(of[i + 1] - of[i]))
        else:
            sets.append(grams[:0])
    return sets


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_parts(batch.column("text")):
            sets = shingle_sets(data, offsets)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            signature = np.zeros((end - first, COORDINATES), np.uint32)
            digests = np.zeros((2, end - first), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                cuts = np.concatenate(([0], np.cumsum(sizes[full])))[:-1]
                for j, seed in enumerate((0x51ED270B7A4F31C9, 0x2545F4914F6CDD1D)):
                    digests[j, full] = np.add.reduceat(mix64(flat ^ np.uint64(seed)), cuts)
                short = (flat >> np.uint64(32)).astype(np.uint32)
                for j in range(COORDINATES):
                    signature[full, j] = np.minimum.reduceat((short ^ _SEEDS[j]) * (_SEEDS[COORDINATES + j] | np.uint32(1)), cuts)
            rows = batch.slice(first, end - first)
            lists = pa.ListArray.from_arrays(np.arange(end - first + 1, dtype=np.int32) * COORDINATES, pa.array(signature.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("k"), pa.array(sizes), pa.array(digests[0].astype(np.int64)), pa.array(digests[1].astype(np.int64)), lists], ["id", "k", "n", "d1", "d2", "mh"])


_MEMBERS = "bit_xor(xxhash64(d1, d2))", "bit_xor(xxhash64(d2, d1, 1))"


def _sized(nodes: DataFrame, last: bool = False) -> DataFrame:
    """Buckets of more than one set, with their size. One of those with the same members stays.

    That holds for leaves only: a bucket still to be split draws its own coordinates, so each run's path of it goes on.
    """
    sizes = nodes.groupBy("path").agg(F.count("*").alias("size"), *(F.expr(m).alias(c) for m, c in zip(_MEMBERS, "ab", strict=True))).where("size > 1")
    going_on = F.when((F.col("size") > SPLIT_OVER) & F.lit(not last), F.col("path"))
    return nodes.join(sizes.groupBy("size", "a", "b", going_on.alias("own")).agg(F.min("path").alias("path")).select("path", "size"), "path")


def _paths(sets: DataFrame, runs: int, *columns: str) -> DataFrame:
    """(path, ...): the bucket of each run's first token."""
    return sets.select(*columns, F.posexplode_outer(F.slice("mh", 1, runs)).alias("run", "token")).select(F.xxhash64("run", "token").alias("path"), *columns)


def _leaves(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, d1, d2, size, tokens): the buckets in which sets are compared, from the root buckets ``nodes``."""
    done = [nodes.where(F.col("size") <= SPLIT_OVER)]
    for depth in range(SPLITS):
        large = nodes.where(F.col("size") > SPLIT_OVER).select("path", "d1", "d2", "n").join(sets.select("d1", "d2", "mh"), ["d1", "d2"])
        pick = lambda i: F.pmod(F.xxhash64("path", F.lit(i)), F.lit(COORDINATES)).cast("int")
        chosen = F.when(F.pmod(F.xxhash64("path", F.lit(2)), F.lit(4)) == 0, F.array(pick(0), pick(1))).otherwise(F.array(pick(0)))
        split = large.withColumn("at", F.explode(F.array_distinct(chosen))).select(F.xxhash64("path", "at", F.get("mh", F.col("at"))).alias("path"), "d1", "d2", "n")
        nodes = stored(_sized(split, last=depth == SPLITS - 1))
        done.append(nodes if depth == SPLITS - 1 else nodes.where(F.col("size") <= SPLIT_OVER))
    every = done[0].unionByName(done[1])
    for more in done[2:]:
        every = every.unionByName(more)
    groups = every.groupBy("path").agg(F.first("size").alias("size"), F.sum("n").alias("tokens"), *(F.expr(m).alias(c) for m, c in zip(_MEMBERS, "ab", strict=True)))
    return stored(every.drop("n").join(groups.groupBy("size", "tokens", "a", "b").agg(F.min("path").alias("path")).select("path", "tokens"), "path"))


def _equal(signature: np.ndarray) -> np.ndarray:
    """Coordinates that each two rows have equal."""
    equal = np.zeros((len(signature), len(signature)), np.int16)
    for c in range(COORDINATES):
        equal += signature[:, c, None] == signature[None, :, c]
    return equal


def _centres(reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pivots of each bucket's sample: the most frequent coordinates of the sets within ``reach`` of one, while it has DENSE of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("path",)):
            signature = _fixed(group.column("mh"), np.int32)
            near = _equal(signature) >= COORDINATES - reach
            left, chosen = np.ones(len(near), bool), []
            while (support := (near & left).sum(axis=1) * left).max() >= DENSE:
                close = near[support.argmax()] & left
                left &= ~close
                values = [np.unique(column, return_counts=True) for column in signature[close].T]
                chosen.append([v[c.argmax()] for v, c in values])
            if chosen:
                yield pa.RecordBatch.from_arrays([pa.array([list(map(int, c)) for c in chosen], pa.list_(pa.int32()))], ["mh"])

    return run


def _same_coordinates(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _uncrowded(at: DataFrame, most: int) -> DataFrame:
    """Without the pivots that are beyond the first ``most`` of a bucket."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("ball"))
    return at.join(at.withColumn("rank", rank).where(F.col("rank") > most).select("ball").distinct(), "ball", "left_anti")


def _balls(sets: DataFrame, nodes: DataFrame, runs: int, reach: int) -> DataFrame | None:
    """Sets with ``ball`` and ``owned``: members of the balls around pivots of dense groups.

    A ball owns the sets that differ from its pivot in at most ``reach`` coordinates (the lowest ball, if several do). What has
    MIN_EQUAL coordinates in common with an owned set differs from the pivot in so many more at most, so all that
    can link with an owned set is a member, unless a lower ball owns it. A pair belongs to the lower of its owners.
    """
    if reach < 0:
        return None
    large = nodes.where(F.col("size") > SPLIT_OVER).where(F.pmod(F.xxhash64("d2", "d1"), F.ceil(F.col("size") / SAMPLE).cast("bigint")) == 0)
    mh = sets.select("d1", "d2", "mh")
    large = bounded(stored(large.select("path", "d1", "d2")))  # so the sets need no shuffle
    sampled = large.join(mh, ["d1", "d2"]).repartition("path").sortWithinPartitions("path", "d1", "d2")
    centres = mapped(sampled, _centres(reach), T.StructType([T.StructField("mh", T.ArrayType(T.IntegerType()))]))
    centres = stored(centres.select(F.xxhash64("mh").alias("ball"), "mh").dropDuplicates(["ball"]))
    if centres.isEmpty():
        return None
    at = _uncrowded(_paths(centres, runs, "ball"), 4 * CROWD)
    two = at.join(at.select("path", F.col("ball").alias("low")), "path").where("low < ball").select("low", "ball").distinct()
    two = two.join(centres, "ball").join(centres.select(F.col("ball").alias("low"), F.col("mh").alias("low_mh")), "low")
    again = two.where(_same_coordinates("mh", "low_mh") >= COORDINATES - reach // 2).select("ball").distinct()
    at = stored(_uncrowded(at.join(again, "ball", "left_anti"), CROWD).join(centres.withColumnRenamed("mh", "middle"), "ball"))
    equal = _same_coordinates("mh", "middle").alias("equal")
    near = _paths(sets, runs, *sets.columns).join(bounded(at, BROADCAST_PIVOTS), "path").select("ball", *sets.columns, equal).where(F.col("equal") >= MIN_EQUAL - reach).distinct()
    own = F.when(F.col("equal") >= COORDINATES - reach, F.col("ball"))
    members = near.withColumn("owner", F.min(own).over(Window.partitionBy("d1", "d2"))).where("owner is null or owner >= ball")
    return stored(members.select("ball", *sets.columns, F.col("owner").eqNullSafe(F.col("ball")).alias("owned")))


def _measured(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets of each group that are at ``threshold`` or above with the group's middle, the row without a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            own = group.column("d1").is_valid().to_numpy()
            if own.all():
                continue
            shingles = group.column("shingles").combine_chunks()
            sizes = shingles.value_lengths().to_numpy()
            flat, cuts = shingles.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
            middle = int(np.flatnonzero(~own)[0])
            shared = np.add.reduceat(np.isin(flat, flat[cuts[middle] : cuts[middle + 1]]), cuts[:-1], dtype=np.int64)
            good = own & (shared / (sizes + sizes[middle] - shared) >= threshold)
            if good.any():
                yield from group.select(["path", "d1", "d2"]).filter(pa.array(good)).combine_chunks().to_batches()

    return run


def _parts(size: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(size / BLOCK), F.ceil(tokens / BLOCK_TOKENS)).cast("bigint")


def _with_parts(members: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """Members and their part in the ball, around a middle of the shingles that half of the owned sets have (of a sample, if there are many).

    Any two sets of the core are linked: each is within half the allowed distance of the middle, and the distance is a metric.
    """
    owned = members.where("owned").select(F.col("ball").alias("path"), "d1", "d2").join(tokens, ["d1", "d2"])
    parts = owned.groupBy("path").agg(_parts(F.count("*"), F.sum(F.size("shingles"))).alias("parts"), F.ceil(F.count("*") / SAMPLE).cast("bigint").alias("one_in"))
    owned = owned.join(parts, "path")
    some = owned.where(F.pmod(F.xxhash64("d2", "d1"), "one_in") == 0).select("path", "parts", "d1", "shingles")
    enough = some.groupBy("path").agg((F.count("*") / 2).alias("half"))
    shared = some.select("path", "parts", F.explode("shingles").alias("shingle")).groupBy("path", "parts", "shingle").agg(F.count("*").alias("sets"))
    middles = shared.join(enough, "path").where("sets >= half").groupBy("path", "parts").agg(F.collect_list("shingle").alias("shingles"))
    middles = middles.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = owned.select("path", F.pmod(F.xxhash64("d2", "d1"), "parts").alias("i"), "d1", "d2", "shingles")
    none = F.lit(None).cast("bigint")
    dealt = dealt.unionByName(middles.select("path", "i", none.alias("d1"), none.alias("d2"), "shingles")).withColumn("j", F.lit(0).cast("bigint"))
    dealt = dealt.repartition("path", "i").sortWithinPartitions("path", "i")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("path", "d1", "d2")])
    cores = mapped(dealt, _measured((1 + threshold) / 2 + 1e-9), schema).select(F.col("path").alias("ball"), "d1", "d2", F.lit(True).alias("core"))
    part = F.when(F.col("core"), CORE).when(F.col("owned"), OPEN).otherwise(SHELL)
    return stored(members.join(cores, ["ball", "d1", "d2"], "left").withColumn("part", part).drop("owned", "core"))


def _ball_blocks(members: DataFrame) -> DataFrame:
    """Deals members (ball, part, d1, d2, n, ...) over blocks of one part, and each to the pairs of blocks it is compared in: neither a core nor a shell with itself."""
    agg = [f(F.when(F.col("part") == p, c)).alias(f"{name}{p}") for p in (CORE, OPEN, SHELL) for f, c, name in ((F.count, F.lit(1), "size"), (F.sum, F.col("n"), "tokens"))]
    sizes = members.groupBy("ball").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"), *agg).where(f"size{CORE} + size{OPEN} > 0 and size{OPEN} + size{SHELL} > 0")
    at_once = (F.col("size") <= 2 * BLOCK) & (F.col("tokens") <= 2 * BLOCK_TOKENS)
    end = [F.lit(0).cast("bigint")]
    for p in (CORE, OPEN, SHELL):
        end.append(end[-1] + F.coalesce(_parts(F.col(f"size{p}"), F.col(f"tokens{p}")), F.lit(0)))
    sizes = sizes.select("ball", at_once.alias("at_once"), *(e.alias(f"end{i}") for i, e in enumerate(end)))
    by_part = lambda values: F.when(F.col("part") == CORE, values[0]).when(F.col("part") == OPEN, values[1]).otherwise(values[2])
    first, beyond = by_part([F.col("end1"), F.col("end0"), F.col("end0")]), by_part([F.col("end3"), F.col("end3"), F.col("end2")])
    side = by_part([F.col(f"end{p}") + F.pmod(F.xxhash64("d2", "d1"), F.col(f"end{p + 1}") - F.col(f"end{p}")) for p in (CORE, OPEN, SHELL)])
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    others = F.when(F.col("at_once"), F.array(zero)).when(beyond > first, F.sequence(first, beyond - 1)).otherwise(none)
    dealt = members.join(sizes, "ball").withColumn("side", F.when(F.col("at_once"), zero).otherwise(side)).withColumn("other", F.explode(others))
    return dealt.withColumn("path", F.col("ball")).withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))


def _blocks(leaves: DataFrame) -> DataFrame:
    """Deals a leaf over blocks of about BLOCK sets or BLOCK_TOKENS shingles, and each set to every pair of blocks it has a part in."""
    # One step holds the sets of two blocks anyway, so a leaf of that size is compared at once.
    at_once = (F.col("size") <= 2 * BLOCK) & (F.col("tokens") <= 2 * BLOCK_TOKENS)
    parts = F.when(at_once, F.lit(1).cast("bigint")).otherwise(_parts(F.col("size"), F.col("tokens")))
    dealt = leaves.withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("d2", "d1"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return dealt.select("path", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "d1", "d2")


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...] = ("path", "i", "j")) -> Iterator[pa.Table]:
    """Rows with equal (path, i, j), which come together; one group has at most two blocks' rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in by]
        ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in zip(by, keys, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        begin = 0
        for end in ends.tolist():
            yield pa.Table.from_batches([*held, batch.slice(begin, end - begin)])
            held, begin = [], end
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _fixed(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group that enough coordinates have equal, where no bucket of a lower path holds both, nor both are of one core or shell."""
    rows = group.num_rows
    side, i, j = group.column("side").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
    signature = _fixed(group.column("mh"), np.int32)
    path = group.column("path")[0].as_py()
    lists = group.column("paths").combine_chunks()
    part = group.column("part").to_numpy()
    if rows == 2:
        near = (part[0] != part[1] or part[0] == OPEN) and (i == j or side[0] != side[1]) and int((signature[0] == signature[1]).sum()) >= MIN_EQUAL and not any(p < path for p in set(lists[0].as_py()) & set(lists[1].as_py()))
        return (np.array([0]), np.array([1])) if near else (np.zeros(0, int), np.zeros(0, int))
    good = _equal(signature) >= MIN_EQUAL
    if (part != OPEN).any():
        good &= (part[:, None] != part[None, :]) | (part == OPEN)
    lower, owner = lists.flatten().to_numpy(), np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
    owner, lower = owner[lower < path], lower[lower < path]
    if len(lower):
        _, column, counts = np.unique(lower, return_inverse=True, return_counts=True)
        shared = counts[column] > 1
        if shared.any():
            _, column = np.unique(column[shared], return_inverse=True)
            member = np.zeros((rows, column.max() + 1), np.float32)
            member[owner[shared], column] = 1
            good &= (member @ member.T) == 0
    good &= np.triu(np.ones_like(good), 1)
    if i != j:
        good &= side[:, None] != side[None, :]
    return np.nonzero(good)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each group that stand in a pair worth an exact look."""
    for group in _groups(batches):
        a, b = _pairs(group)
        if len(a):
            some = group.take(pa.array(np.unique(np.concatenate((a, b))))).combine_chunks()
            yield from some.to_batches()


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tokens that each pair shares."""
    if len(a) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner, total, slab = owner[shared], np.zeros((len(sets), len(sets)), np.float32), 1 << 12
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, slab):
        lo, hi = np.searchsorted(column, (start, start + slab))
        member = np.zeros((len(sets), slab), np.float32)
        member[owner[lo:hi], column[lo:hi] - start] = 1
        total += member @ member.T
    return total[a, b].astype(np.int64)


def _linked(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            a, b = _pairs(group)
            if not len(a):
                continue
            column = group.column("shingles").combine_chunks()
            sets = [column[x].values.to_numpy().view(np.uint64) for x in range(len(column))]
            sizes = np.array([len(s) for s in sets], np.int64)
            shared = _overlaps(sets, a, b)
            good = shared / (sizes[a] + sizes[b] - shared) >= threshold
            a, b = a[good], b[good]
            if not len(a):
                continue
            weight = group.column("copies").to_numpy()
            links = np.bincount(a, weights=weight[b], minlength=len(sets)) + np.bincount(b, weights=weight[a], minlength=len(sets))
            root = np.arange(len(sets))
            while True:  # every set takes the lowest number among its links, until nothing changes
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


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: any ordered type): root is the least node of its component.

    Alternating large and small stars; every step is two groupings and joins, written to the shared folder. Only a count and
    a checksum come to the driver.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        joined = both.join(least, F.col("u") == F.col("w"))
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()

    pairs, seen = stored(edges.where("u <> v").select("u", "v").distinct()), None
    while True:
        pairs = stored(star(star(pairs, True), False))
        state = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents joined by Jaccard similarity of 5-word shingles of at least ``threshold``.

    Equal sets are one set with a number of copies. Sets are split on sampled tokens, buckets over SPLIT_OVER again; what shares a
    bucket is compared by coordinates and then exactly, in blocks, each pair only in the first bucket that holds it. A
    large group of near copies gives counts per set and a few edges, never all its pairs: pivots are sought in large root
    buckets, the sets close to a pivot leave the buckets and stand once, in its ball. Those within half the allowed distance of
    its middle are the core, linked for certain and counted by its size; the others are compared with the core, with each
    other and with the sets further out that could still link with them.
    One row per document row: id, k (text key), n (shingles), class_id (least id of the class), keeper (id and k of one
    document of it) and n_links (other documents at the threshold or above, copies included). Texts without words are linked to nothing
    and are a class of their own; shorter ones than a shingle are one shingle.
    """
    k, _ = text_keys(whole(text_col))
    base = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), k.alias("k"))
    id_field = T.StructField("id", base.schema["id"].dataType)
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    rows = stored(mapped(base, _signatures, T.StructType([id_field, *longs("k", "n", "d1", "d2"), T.StructField("mh", T.ArrayType(T.IntegerType()))])))
    sets = rows.where("n > 0").groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min(F.struct("id", "k")).alias("keeper"), F.min("id").alias("least"), F.max("n").alias("n"), F.first("mh").alias("mh"))
    sets = stored(sets)

    runs = runs_for(recall, threshold)
    nodes = stored(_sized(_paths(sets, runs, "d1", "d2", "n")))
    balls = _balls(sets.drop("least"), nodes, runs, reach_for(runs, recall, threshold))
    if balls is not None:
        owned = bounded(balls.where("owned").select("d1", "d2"))
        nodes = stored(_sized(nodes.drop("size").join(owned, ["d1", "d2"], "left_anti")))
    leaves = _leaves(sets, nodes)
    paths = leaves.groupBy("d1", "d2").agg(F.collect_list("path").alias("paths"))
    known = sets.select("d1", "d2", "copies", "keeper", "mh").join(paths, ["d1", "d2"]).withColumn("part", F.lit(OPEN))
    grouped = _blocks(leaves).join(known, ["d1", "d2"])
    by_group = lambda df: df.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j")
    grouped = by_group(grouped)
    compared = stored(mapped(grouped, _compared, grouped.schema))

    wanted = compared.select("d1", "d2", F.col("keeper.id").alias("__id"), F.col("keeper.k").alias("__k"))
    if balls is not None:
        wanted = wanted.unionByName(balls.select("d1", "d2", F.col("keeper.id").alias("__id"), F.col("keeper.k").alias("__k")))
    wanted = wanted.distinct()
    texts = base.join(wanted, _same(F.col("id"), F.col("__id")) & (F.col("k") == F.col("__k"))).select("d1", "d2", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_parts(batch.column("text")):
                found = [s.view(np.int64) for s in shingle_sets(data, offsets)]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column("d1"), part.column("d2"), pa.array(found, pa.list_(pa.int64()))], ["d1", "d2", "shingles"])

    tokens = mapped(texts, shingles, T.StructType([*longs("d1", "d2"), T.StructField("shingles", T.ArrayType(T.LongType()))]))
    tokens = tokens.dropDuplicates(["d1", "d2"])  # rows that repeat
    sure = None
    if balls is not None:
        tokens = stored(tokens)
        members = _with_parts(balls, tokens, threshold)
        around = by_group(_ball_blocks(members.withColumn("paths", F.array().cast("array<bigint>"))).select(*grouped.columns))
        compared = compared.unionByName(stored(mapped(around, _compared, grouped.schema)))
        cores = members.where(F.col("part") == CORE)
        heads = cores.groupBy("ball").agg(F.sum("copies").alias("weight"), F.min(F.struct("d1", "d2")).alias("head"))
        sure = cores.join(heads, "ball").select("d1", "d2", (F.col("weight") - F.col("copies")).alias("links"), F.col("head.d1").alias("r1"), F.col("head.d2").alias("r2")).where("links > 0")
    exact = by_group(compared.drop("keeper").join(tokens, ["d1", "d2"]))
    linked = mapped(exact, _linked(threshold), T.StructType(longs("d1", "d2", "links", "r1", "r2")))
    linked = stored(linked.unionByName(sure) if sure is not None else linked)

    node, root = F.struct("d1", "d2"), F.struct(F.col("r1").alias("d1"), F.col("r2").alias("d2"))
    roots = components(linked.select(node.alias("u"), root.alias("v")))
    links = linked.groupBy("d1", "d2").agg(F.sum("links").alias("links"))
    named = sets.select("d1", "d2", "copies", "keeper", "least").join(links, ["d1", "d2"], "left")
    named = named.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("root").agg(F.min("least").alias("class_id"), F.min("keeper").alias("class_keeper"))
    named = named.join(heads, "root").select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "class_id", "class_keeper", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("id", "k", "n", "d1", "d2").join(named, (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2")) & (F.col("n") > 0), "left")
    return out.select(
        "id", "k", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.coalesce("class_keeper", F.struct("id", "k")).alias("keeper"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class of near duplicates (the least id, then text key); texts without words all stay."""
    found = near_duplicates(docs, threshold, id_col=id_col, text_col=text_col).where("n > 0").where((F.col("class_id").isNull()) | (F.col("n_links") > 0))
    same = _same(F.col("id"), F.col("keeper.id")) & (F.col("k") == F.col("keeper.k"))
    marks = found.groupBy(F.col("id").alias("__id"), F.col("k").alias("__k")).agg(F.first(same).alias("__first"), F.count("*").alias("__rows"))
    keyed = docs.withColumn("__key", text_keys(whole(text_col))[0])
    both = keyed.join(marks, _same(keyed[id_col], F.col("__id")) & (keyed["__key"] == F.col("__k")), "left")
    once = both.where("__first is null or (__first and __rows = 1)").select(*docs.columns)
    rank = F.row_number().over(Window.partitionBy("__id", "__k").orderBy(F.lit(0)))
    again = both.where("__first and __rows > 1").withColumn("__rank", rank).where("__rank = 1").select(*docs.columns)
    return once.unionByName(again)
