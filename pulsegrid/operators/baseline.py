"""Subject baselines and baseline-relative features; dataset-level robust scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.text import row_mean
from pulsegrid.operators.scale import exact_quantiles, null_safe_join
from pulsegrid.schema import BASELINE_TERMS

KEYS = ["dataset_id", "subject_id"]
MAD_SCALE = 1.4826


def baseline_feature_columns(df: DataFrame) -> list[str]:
    numeric = {"double", "float", "int", "bigint"}
    return [c for c, t in df.dtypes if t in numeric and c.endswith(("__mean", "__std", "__slope_per_s"))]


def baseline_profiles(windows: DataFrame, conditions: Sequence[str] = BASELINE_TERMS) -> DataFrame:
    """One row per (dataset, subject): ``{feature}__b_{stat}`` over the rest rows, window count and quality.

    A subject without rest rows still gets a row: quality 0 and an untrusted state.
    """
    features = baseline_feature_columns(windows)
    is_rest = F.lower("condition").isin(*conditions)
    rest = windows.where(is_rest).select(*KEYS, *features)
    q = exact_quantiles(rest, KEYS, features, (0.05, 0.5, 0.95))
    centred = null_safe_join(rest, q.select(*KEYS, *[f"{f}__q500" for f in features]), KEYS, "inner").select(
        *KEYS, *[F.abs(F.col(f) - F.col(f"{f}__q500")).alias(f) for f in features])
    mad = exact_quantiles(centred, KEYS, features, (0.5,))
    moments = rest.groupBy(*KEYS).agg(
        *[F.avg(f).alias(f"{f}__b_mean") for f in features], *[F.stddev_pop(f).alias(f"{f}__b_std") for f in features])
    counts = windows.groupBy(*KEYS).agg(F.sum(F.coalesce(is_rest, F.lit(False)).cast("long")).alias("n_windows"))
    out = null_safe_join(counts, moments, KEYS)
    out = null_safe_join(out, q.select(*KEYS, *[F.col(f"{f}__{s}").alias(f"{f}__b_{n}") for f in features
                                                for s, n in (("q050", "p05"), ("q500", "median"), ("q950", "p95"))]), KEYS)
    out = null_safe_join(out, mad.select(*KEYS, *[F.col(f"{f}__q500").alias(f"{f}__b_mad") for f in features]), KEYS)
    n = F.col("n_windows")
    quality = F.least(F.lit(1.0), n / F.lit(10.0)) if features else F.lit(0.0)
    return out.withColumns(
        {
            "baseline_profile_id": F.concat_ws("::", *KEYS, F.lit("explicit_rest"), F.lit("v1")),
            "baseline_source": F.when(n > 0, "explicit_rest").otherwise("none"),
            "baseline_label_state": F.when(n > 0, "relaxed_rest").otherwise("unknown_untrusted"),
            "quality_0_1": quality,
        }
    )


def attach_baseline(windows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Append ``x - median`` and ``(x - median) / (1.4826 MAD)`` per feature; raw columns stay untouched."""
    features = [c[: -len("__b_median")] for c in profiles.columns if c.endswith("__b_median")]
    features = [f for f in features if f in windows.columns]
    prof = profiles.select(
        *KEYS, *[f"{f}__b_{s}" for f in features for s in ("median", "mad")], "baseline_profile_id", "quality_0_1",
        "baseline_label_state")
    joined = null_safe_join(windows, prof.withColumnRenamed("baseline_profile_id", "__pid"), KEYS)
    cols = {}
    for f in features:
        delta = F.col(f) - F.col(f"{f}__b_median")
        cols[f"{f}__delta_from_profile_median"] = delta
        cols[f"{f}__robust_z_from_profile"] = F.when(F.col(f"{f}__b_mad") > 0, delta / (MAD_SCALE * F.col(f"{f}__b_mad")))
    available = F.coalesce(F.col("quality_0_1") > 0, F.lit(False)) if features else F.lit(False)
    out = joined.withColumns(cols)
    return out.withColumns(
        {
            "baseline_profile_id": F.when(available, F.col("__pid")),
            "baseline_profile_available": available,
            "baseline_profile_quality_0_1": F.coalesce("quality_0_1", F.lit(0.0)),
            "baseline_state_label": F.coalesce("baseline_label_state", F.lit("unknown_untrusted")),
            "baseline_distance_l1": row_mean([F.abs(F.col(f"{f}__delta_from_profile_median")) for f in features]),
        }
    ).drop("__pid", "quality_0_1", "baseline_label_state", *[f"{f}__b_{s}" for f in features for s in ("median", "mad")])


def dataset_robust_z(df: DataFrame, group: str, columns: Sequence[str], clip: float = 8.0, fill: float | None = 0.0) -> DataFrame:
    """Median/MAD z per dataset, standard deviation where MAD vanishes, clipped, gaps filled."""
    med = exact_quantiles(df.select(group, *columns), [group], list(columns), (0.5,))
    centred = null_safe_join(df.select(group, *columns), med, [group], "inner").select(
        group, *[F.abs(F.col(c) - F.col(f"{c}__q500")).alias(c) for c in columns])
    mad = exact_quantiles(centred, [group], list(columns), (0.5,)).select(
        group, *[(F.col(f"{c}__q500") * MAD_SCALE).alias(f"{c}__mad") for c in columns])
    sd = df.groupBy(group).agg(*[F.stddev_samp(c).alias(f"{c}__sd") for c in columns])
    params = null_safe_join(null_safe_join(med, mad, [group]), sd, [group])
    joined = null_safe_join(df, params, [group])
    out = {}
    for c in columns:
        scale = F.when(F.col(f"{c}__mad") > 1e-9, F.col(f"{c}__mad")).when(F.col(f"{c}__sd") > 1e-9, F.col(f"{c}__sd"))
        z = (F.col(c) - F.col(f"{c}__q500")) / scale
        z = F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))
        out[f"{c}__dataset_robust_z"] = z if fill is None else F.coalesce(z, F.lit(fill))
    return joined.withColumns(out).drop(*[f"{c}__{s}" for c in columns for s in ("q500", "mad", "sd")])
