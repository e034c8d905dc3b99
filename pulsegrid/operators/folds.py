"""Leakage-aware splits: subject-disjoint folds balanced by size, and leave-one-dataset-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.scale import null_safe_join, running_index


def _segments(classes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy assignment (largest group first, to the lightest fold) in closed form per size class.

    Groups of equal size n fill folds in rounds: every fold whose load is below the lightest load + n
    receives one group per round, in (load, fold) order, until the next heavier fold joins. Each
    stretch is one row (size, first index, length, repeating fold pattern), at most k per size.
    """
    loads = [0] * k
    out = []
    for n, m in classes:
        start, left = 0, m
        while left > 0:
            low = min(loads)
            active = sorted((f for f in range(k) if loads[f] < low + n), key=lambda f: (loads[f], f))
            rest = [loads[f] for f in range(k) if loads[f] >= low + n]
            take = left if not rest else min(left, len(active) * ((min(rest) - low) // n))
            out.append((n, start, take, active))
            for i, f in enumerate(active):
                loads[f] += n * (take // len(active) + (1 if i < take % len(active) else 0))
            start, left = start + take, left - take
    return out


def group_kfold(df: DataFrame, group: str, k: int, order: str | None = None) -> DataFrame:
    """One row per group with its size and fold; groups never straddle folds.

    The driver sees only (size, number of groups) pairs - distinct sizes grow at most with the square
    root of the row count - so the exact greedy result needs no gathered group list.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    if order is None:
        numeric = dict(sizes.dtypes)[group] in ("int", "bigint", "double", "float", "smallint", "tinyint")
        sizes = sizes.withColumn("__o", F.col(group).cast("double") if numeric else F.xxhash64(group))
        order = "__o"
    classes = [(r["rows"], r["m"]) for r in sizes.groupBy("rows").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("rows")).toLocalIterator()]
    folds = min(k, sum(m for _, m in classes)) or 1
    spark = df.sparkSession
    plan = spark.createDataFrame(_segments(classes, folds) or [(0, 0, 0, [0])], "rows long, __start long, __len long, __pattern array<int>")
    indexed = running_index(sizes, ["rows"], order, "__i", [group])
    hit = (F.col("__i") >= F.col("__start")) & (F.col("__i") < F.col("__start") + F.col("__len"))
    fold = F.get("__pattern", ((F.col("__i") - F.col("__start")) % F.size("__pattern")).cast("int"))
    return indexed.join(plan, "rows").where(hit).select(group, "rows", fold.alias("fold"))


def with_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    return null_safe_join(df, group_kfold(df, group, k).select(group, "fold"), [group], "inner")


def hash_folds(df: DataFrame, group: str, k: int, seed: int = 42) -> DataFrame:
    """Subject-disjoint folds without any counting pass: balanced in expectation."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), group), F.lit(k)).cast("int"))


def leave_one_out_stats(df: DataFrame, dataset: str, y: str) -> DataFrame:
    """Train/test sizes and class checks for every held-out dataset, from one aggregate over datasets."""
    per = df.where(F.col(y).isNotNull()).groupBy(dataset).agg(
        F.count(F.lit(1)).alias("test_rows"), F.sum((F.col(y) == 1).cast("long")).alias("test_pos"))
    total = per.agg(F.sum("test_rows"), F.sum("test_pos")).first()
    rows, pos = total[0] or 0, total[1] or 0
    train, train_pos = F.lit(rows) - F.col("test_rows"), F.lit(pos) - F.col("test_pos")
    both = (F.col("test_pos") > 0) & (F.col("test_pos") < F.col("test_rows")) & (train_pos > 0) & (train_pos < train)
    return per.select(
        F.col(dataset).alias("heldout"), train.alias("train_rows"), "test_rows", (F.col("test_pos") / F.col("test_rows")).alias("prevalence"),
        both.alias("usable"))
