"""Reproducible sampling, top-k and deduplication. Sampling here is the feature, never a shortcut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.align import dedupe_first
from pulsegrid.operators.scale import null_safe_join, running_index


def seeded_order(seed: int, *cols: str) -> Column:
    """Order-independent pseudo-random key: the same rows are drawn on every run and layout."""
    return F.xxhash64(F.lit(seed), *cols)


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per group; partial limits run before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*groups).orderBy(*order)
    out = df.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= k)
    return out.withColumnRenamed("__rk", rank) if rank else out.drop("__rk")


def balanced_sessions(rows: DataFrame, max_sessions: int, seed: int, dataset: str = "dataset_id") -> DataFrame:
    """Class-balanced cap on sessions per dataset: equal share per class, topped up from the rest."""
    sessions = dedupe_first(
        rows.select(dataset, "session_id", "y"), [dataset, "session_id"], [F.col("y").desc()]
    )
    shape = sessions.groupBy(dataset).agg(F.count(F.lit(1)).alias("__n"), F.countDistinct("y").alias("__classes"))
    s = null_safe_join(sessions, shape, [dataset]).withColumn("__h", seeded_order(seed, "session_id"))
    share = F.greatest(F.floor(F.lit(max_sessions) / F.col("__classes")), F.lit(1).cast("long"))
    in_class = F.row_number().over(Window.partitionBy(dataset, "y").orderBy("__h", "session_id"))
    # No session beyond the cap of its own class can be kept: this rank limit runs before the shuffle.
    ranked = s.withColumn("__c", in_class).where(F.col("__c") <= max_sessions).withColumn("__first", F.col("__c") <= share)
    # Per-class picks come first, then the remainder in seeded order, up to the cap.
    overall = F.row_number().over(Window.partitionBy(dataset).orderBy(F.col("__first").desc(), "__h", "session_id"))
    kept = ranked.withColumn("__r", overall).where(F.col("__r") <= max_sessions)
    return rows.join(kept.select(dataset, "session_id"), [dataset, "session_id"], "left_semi")


def even_positions(index: Column, count: Column, keep: int) -> Column:
    """True at the rounded (half to even) positions of ``keep`` points spread evenly over 0..count-1.

    Instead of generating the positions, each index checks the at most two points that can round to it.
    """
    if keep == 1:
        return (count <= keep) | (index == 0)
    step = (count - 1) / F.lit(keep - 1)
    guess = F.floor(index / step)

    def lands(j: Column) -> Column:
        return (j >= 0) & (j <= keep - 1) & (F.bround(j * step, 0) == index)

    return (count <= keep) | lands(guess) | lands(guess + 1) | lands(guess - 1)


def sample_windows(rows: DataFrame, max_windows: int, seed: int, keys: Sequence[str] = ("dataset_id", "session_id")) -> DataFrame:
    """At most ``max_windows`` per session: balanced over classes when mixed, evenly spaced when not."""
    keys = list(keys)
    shape = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.countDistinct("y").alias("__classes"))
    s = null_safe_join(rows, shape, keys)
    indexed = running_index(s, keys, "window_end_s", "__i", ["y"])
    even = indexed.where((F.col("__classes") <= 1) | (F.col("__n") <= max_windows)).where(even_positions(F.col("__i"), F.col("__n"), max_windows))
    mixed = indexed.where((F.col("__classes") > 1) & (F.col("__n") > max_windows)).withColumn("__h", seeded_order(seed, *keys, "window_end_s"))
    share = F.greatest(F.floor(F.lit(max_windows) / F.col("__classes")), F.lit(1).cast("long"))
    # Only the first max_windows of each class can be kept at all: this rank limit is pre-shuffle.
    in_class = F.row_number().over(Window.partitionBy(*keys, "y").orderBy("__h", "window_end_s"))
    near = mixed.withColumn("__c", in_class).where(F.col("__c") <= max_windows)
    overall = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("__c") <= share).desc(), "__h", "window_end_s"))
    picked = near.withColumn("__r", overall).where(F.col("__r") <= max_windows)
    drop = ("__n", "__classes", "__i", "__h", "__c", "__r")
    return even.drop(*drop).unionByName(picked.drop(*drop))


def anchor_table(windows: DataFrame, max_sessions: int = 40, max_windows: int = 10, seed: int = 20260609) -> DataFrame:
    """Sampled anchors of all labelled tasks, deduplicated and sorted."""
    from pulsegrid.functions.labels import task_rows

    rows = task_rows(windows)
    # (task, sessions cap, windows cap): fixed multiples of the two settings.
    plan = (
        ("pain_high_4_plus", max_sessions, max_windows), ("wesad_stress", None, max_windows * 3),
        ("stress_vs_exercise", None, max_windows), ("cognitive_load_vs_baseline", max_sessions * 2, max_windows),
    )
    out = None
    for task, cap, per_session in plan:
        part = rows.where(F.col("task") == task)
        if cap is not None:
            part = balanced_sessions(part, cap, seed)
        part = sample_windows(part, per_session, seed)
        out = part if out is None else out.unionByName(part)
    key = ["task", "dataset_id", "session_id", "window_end_s"]
    first = dedupe_first(out, key, [F.col("target_value")])
    return first.select("task", "dataset_id", "subject_id", "session_id", "condition", "window_end_s", "target_value", "y").orderBy(*key)


def finalists(screen: DataFrame) -> DataFrame:
    """Best overall, best watch-profile and best chest-profile run per target, without repeats."""
    order = [F.col("auc").desc_nulls_last(), F.col("profile"), F.col("arm")]
    picks = [
        top_k(screen, ["target"], order, 1),
        top_k(screen.where(F.col("profile") == "watch_core"), ["target"], order, 1),
        top_k(screen.where(F.col("profile") == "chest_reference"), ["target"], order, 1),
    ]
    return dedupe_first(picks[0].unionByName(picks[1]).unionByName(picks[2]), ["target", "profile", "arm"], order)
