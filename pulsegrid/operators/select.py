"""Feature-set selection with leakage guards. Decisions use column names plus one aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid import schema as S

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Non-null count of each column: one pass, one row."""
    if not columns:
        return {}
    row = df.agg(*[F.count(c).alias(c) for c in columns], F.count(F.lit(1)).alias("__rows")).first()
    return row.asDict()


def feature_columns(df: DataFrame, feature_set: str) -> list[str]:
    """Columns of a named set: sensor features, state columns, metadata; never ids, targets or leaky columns."""
    if feature_set not in S.FEATURE_SETS:
        raise KeyError(f"unknown feature set {feature_set}")
    spec = S.FEATURE_SETS[feature_set]
    prefixes = tuple(p for s in spec["sensors"] for p in S.SENSOR_PREFIXES[s])
    wanted = [c for c in df.columns if prefixes and c.startswith(prefixes)]
    wanted += [c for c in sorted(S.STATE_COLUMNS) if c in df.columns]
    wanted += [c for c in df.columns if "__delta_from_profile_median" in c or "__robust_z_from_profile" in c]
    if spec["metadata"]:
        wanted += [c for c in sorted(S.METADATA_COLUMNS) if c in df.columns]
    banned = {*S.ID_COLUMNS, *S.LEAKY_COLUMNS}
    ordered = [c for c in dict.fromkeys(wanted) if c not in banned and not c.startswith("target_")]
    counts = non_null_counts(df, ordered)
    return [c for c in ordered if counts[c] > 0]


def profile_arm_columns(df: DataFrame, profile: str, arm: str, max_features: int | None = None) -> list[str]:
    """Numeric base/shape columns of a device profile and literature arm, best-covered first; all unless a number is asked for."""
    prof, arms = S.PROFILE_PREFIXES[profile], S.ARM_PREFIXES[arm]
    chosen = []
    for c, t in df.dtypes:
        if t not in NUMERIC:
            continue
        if c == "window_s" or (
            ("__base__" in c or "__shape__" in c) and (not prof or c.startswith(prof)) and c.startswith(arms) and c.endswith(S.ALLOWED_SUFFIXES)
        ):
            chosen.append(c)
    counts = non_null_counts(df, chosen)
    chosen = [c for c in chosen if counts[c] > 0]
    return sorted(chosen, key=lambda c: (-counts[c], c))[:max_features]


def marked_columns(columns: Sequence[str], groups: Sequence[str]) -> list[str]:
    marks = [f"__{g}__" for g in groups]
    return [c for c in columns if any(m in c for m in marks)]


def temporal_split(columns: Sequence[str], group: str, temporal: bool) -> list[str]:
    mark = f"__{group}__"
    return [c for c in columns if mark in c and (c.split(mark, 1)[1] in S.TEMPORAL_FEATURE_NAMES) == temporal]


def shape_feature_sets(columns: Sequence[str]) -> dict[str, list[str]]:
    """Named column lists compared in the temporal-order experiments, controls included."""
    base, coupling = marked_columns(columns, ["base"]), marked_columns(columns, ["coupling"])
    temporal = temporal_split(columns, "shape", True)
    return {
        "base": base,
        "base_distribution": base + temporal_split(columns, "shape", False),
        "base_temporal": base + temporal,
        "base_temporal_coupling": base + temporal + coupling,
        "base_temporal_shuffle": base + temporal_split(columns, "shuffle", True),
        "base_temporal_reverse": base + temporal_split(columns, "reverse", True),
        "base_shape": marked_columns(columns, ["base", "shape"]),
        "base_shape_coupling": marked_columns(columns, ["base", "shape", "coupling"]),
        "base_shuffle": marked_columns(columns, ["base", "shuffle"]),
        "base_reverse": marked_columns(columns, ["base", "reverse"]),
        "quality_only": marked_columns(columns, ["quality"]),
    }


def feature_group(name):
    """Group of a long-form feature name column, from its marker."""
    chain = None
    for g in ("base", "shape", "shuffle", "reverse", "coupling", "quality"):
        cond = name.contains(f"__{g}__")
        chain = F.when(cond, g) if chain is None else chain.when(cond, g)
    return chain.otherwise("other")


def valid_features(long: DataFrame, groups: Sequence[str], rows_per_group: DataFrame | None = None) -> DataFrame:
    """Features with enough finite values (>= max(30, half the rows)) and more than two distinct ones.

    ``long`` has one row per (row, feature), NULL where missing. Distinctness is decided from min, max and
    whether any value differs from both, so no distinct set is gathered.
    """
    stats = long.groupBy(*groups, "feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("finite"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    inner = long.join(stats.select(*groups, "feature", "lo", "hi"), [*groups, "feature"]).groupBy(*groups, "feature").agg(
        F.max((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi"))).alias("third"))
    enough = F.col("finite") >= F.greatest(F.lit(30.0), F.col("rows") * 0.5)
    return stats.join(inner, [*groups, "feature"]).where(enough & F.col("third")).select(*groups, "feature", "rows", "finite")


def common_features(long: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """Features observed in every dataset, hence usable for any held-out split."""
    seen = long.groupBy("feature", dataset).agg(F.count("value").alias("n"))
    return seen.groupBy("feature").agg(F.min(F.col("n") > 0).alias("ok")).where("ok").select("feature")
