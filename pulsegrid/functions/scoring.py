"""Row-level state scoring as generated expressions: usable unchanged in batch and on streams."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.schema import DEFAULT_EXPECTED_BLOCKS

EPS = 1e-9


def _null() -> Column:
    return F.lit(None).cast("double")


Types = dict[str, str]
NUMERIC_TYPES = ("double", "float", "int", "bigint", "smallint", "tinyint")


def finite(types: Types, name: str) -> Column:
    """The column as a finite double, NULL when missing from the table, NaN or infinite.

    ``types`` is ``dict(df.dtypes)``, read once per table.
    """
    if name not in types:
        return _null()
    x = f"CAST(`{name}` AS DOUBLE)"
    return F.expr(f"CASE WHEN abs({x}) < double('infinity') AND NOT isnan({x}) THEN {x} END")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def scaled(x: Column, center: float, scale: float, invert: bool = False) -> Column:
    z = (x - F.lit(center)) / F.lit(max(scale, EPS))
    return clamp(F.lit(0.5) + F.lit(0.25) * (-z if invert else z))


def null_mean(values: Sequence[Column]) -> Column:
    return weighted_mean([(v, 1.0) for v in values])


def weighted_mean(items: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean over the non-null values; NULL when there is none."""
    num, den = F.lit(0.0), F.lit(0.0)
    for value, weight in items:
        num = num + F.coalesce(value * F.lit(weight), F.lit(0.0))
        den = den + F.when(value.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0))
    return F.when(den > 0, num / den)


def robust_departure(types: Types, feature: str) -> Column:
    z = finite(types, f"{feature}__robust_z_from_profile")
    d = finite(types, f"{feature}__delta_from_profile_median")
    return F.coalesce(clamp(F.abs(z) / 3.0), clamp(F.abs(d) / 3.0))


def block_present(types: Types, prefix: str) -> Column:
    """Presence flag when given, else whether any feature of the block has a value."""
    members = [c for c, t in types.items() if c.startswith(f"{prefix}__") and t in NUMERIC_TYPES]
    any_value = F.coalesce(*[finite(types, c) for c in members]).isNotNull() if members else F.lit(False)
    flag = finite(types, f"{prefix}__present")
    return F.when(flag.isNotNull(), flag > 0).otherwise(any_value)


# Fixed values: (column, centre, scale, inverted) of every scaled input, and the mixing weights.
SCALED_INPUTS = {
    "eda_slope": ("eda__slope_per_s", 0.0, 0.02, False),
    "eda_peaks": ("eda__peak_count", 1.0, 4.0, False),
    "bvp_instability": ("bvp__std", 0.0, 35.0, False),
    "temp_drop": ("temperature__slope_per_s", 0.0, 0.03, True),
    "motion": ("acc__mag__std", 0.03, 0.20, False),
    "rmssd": ("ibi__rmssd_ms", 35.0, 45.0, False),
    "sdnn": ("ibi__sdnn_ms", 45.0, 55.0, False),
    "hr_recovery": ("hr__slope_per_s", 0.0, 0.6, True),
    "eda_recovery": ("eda__slope_per_s", 0.0, 0.02, True),
    "resp_regular": ("respiration__std", 0.0, 0.5, True),
    "stable_hr": ("hr__std", 20.0, 20.0, True),
    "stable_eda": ("eda__std", 0.8, 1.5, True),
}
SYMPATHETIC_WEIGHTS = {
    "eda_level": 1.4, "eda_slope": 1.1, "eda_peaks": 0.8, "hr_level": 1.0, "bvp_instability": 0.5, "temp_drop": 0.5,
    "departure": 0.9,
}
PARASYMPATHETIC_WEIGHTS = {
    "rmssd": 1.4, "sdnn": 0.9, "hr_recovery": 0.9, "eda_recovery": 0.6, "resp_regular": 0.8, "pns_baseline": 0.7,
}
HOMEOSTASIS_WEIGHTS = {"low_departure": 1.6, "low_arousal": 1.1, "low_motion": 0.7, "stable_hr": 0.5, "stable_eda": 0.5}
SCORED_BLOCKS = ("eda", "hr", "ibi", "bvp", "temperature", "acc", "respiration")


def ternary_score(df: DataFrame) -> DataFrame:
    """Append the ternary state balance, its plane position, quality, recovery and notes to window rows.

    Missing sensors lower quality and remove evidence; they never count as zero evidence. The stages
    are separate projections so that no shared subexpression is evaluated twice.
    """
    types = dict(df.dtypes)
    parts = {f"__{n}": scaled(finite(types, c), ctr, sc, inv) for n, (c, ctr, sc, inv) in SCALED_INPUTS.items()}
    parts["__eda_level"] = scaled(F.coalesce(finite(types, "eda__mean"), finite(types, "eda__last")), 0.5, 1.5)
    parts["__hr_level"] = scaled(F.coalesce(finite(types, "hr__mean"), finite(types, "hr__last")), 75.0, 35.0)
    departures = [robust_departure(types, f) for f in ("eda__mean", "hr__mean", "bvp__mean", "temperature__mean")]
    parts["__departure"] = clamp(null_mean([*departures, finite(types, "baseline_distance_l1")]))
    parts["__pns_baseline"] = 1.0 - clamp(null_mean([robust_departure(types, f) for f in ("ibi__rmssd_ms", "ibi__sdnn_ms")]))
    parts |= {f"__has_{b}": block_present(types, b) for b in SCORED_BLOCKS}
    one = df.withColumns(parts)

    def mixed(weights: dict[str, float]) -> Column:
        return weighted_mean([(F.col(f"__{n}"), w) for n, w in weights.items()])

    usable = F.lit(0)
    for b in SCORED_BLOCKS:
        usable = usable + F.col(f"__has_{b}").cast("int")
    two = one.withColumns(
        {"__s0": mixed(SYMPATHETIC_WEIGHTS), "__p0": mixed(PARASYMPATHETIC_WEIGHTS), "usable_sensor_count": usable}
    )
    three = two.withColumns(
        {"__s": F.coalesce("__s0", F.lit(0.33)), "__p": F.coalesce("__p0", F.lit(0.33)),
         "__low_departure": 1.0 - F.col("__departure"), "__low_motion": 1.0 - F.col("__motion")}
    ).withColumn("__low_arousal", 1.0 - F.col("__s"))
    four = three.withColumn("__h", mixed(HOMEOSTASIS_WEIGHTS))
    floor = {n: F.greatest(F.col(c), F.lit(EPS)) for n, c in (("s", "__s"), ("p", "__p"), ("h", "__h"))}
    total = floor["s"] + floor["p"] + floor["h"]
    five = four.withColumns(
        {"sympathetic": floor["s"] / total, "parasympathetic": floor["p"] / total, "homeostasis": floor["h"] / total}
    )
    s, p, h = F.col("sympathetic"), F.col("parasympathetic"), F.col("homeostasis")
    penalty = F.lit(0.15) * F.coalesce("__motion", F.lit(0.0))
    notes = F.array_compact(
        F.array(
            F.when(F.col("__s0").isNull(), "sympathetic_missing_core"),
            F.when(F.col("__p0").isNull(), "parasympathetic_missing_core"),
            F.when(F.col("usable_sensor_count") < 2, "low_sensor_support"),
            F.when(~F.col("__has_ibi"), "pns_hrv_missing"),
            F.when(~F.col("__has_eda"), "sns_eda_missing"),
        )
    )
    six = five.withColumns(
        {
            "ternary_x": p + 0.5 * h,
            "ternary_y": F.lit(math.sqrt(3.0) / 2.0) * h,
            "functional_pain_0_1": clamp(s * (1.0 - h) * (1.0 - penalty)),
            "recovery_0_1": clamp(0.65 * p + 0.35 * h),
            "sensor_quality_0_1": clamp(0.15 + 0.12 * F.col("usable_sensor_count")),
            "notes": notes,
        }
    )
    return six.drop(*[c for c in six.columns if c.startswith("__")])


def sensor_usage(df: DataFrame, expected: Sequence[str] = DEFAULT_EXPECTED_BLOCKS) -> tuple[Column, Column]:
    """(used, missing) block name arrays from the ``*__present`` flags."""
    used, missing = [], []
    for block in expected:
        flags = [c for c in df.columns if c.startswith(f"{block}__") and c.endswith("__present")]
        hit = F.lit(False)
        for c in flags:
            hit = hit | (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0)
        used.append(F.when(hit, block))
        missing.append(F.when(~hit, block))
    return F.array_compact(F.array(*used)), F.array_compact(F.array(*missing))


def score_quality(used: Column, missing: Column) -> Column:
    n_missing = F.size(missing)
    return F.when((F.size(used) == 0) & (n_missing > 0), 0.2).otherwise(
        F.greatest(F.lit(0.2), F.least(F.lit(1.0), 1.0 - 0.07 * n_missing))
    )


def confidence(probability: Column, quality: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.5 * quality + 0.5 * (F.abs(probability - 0.5) * 2.0)))


def conservative_confidence(probability: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.9), F.pow(F.abs(probability - 0.5) * 2.0, F.lit(1.6))))


def state_preferences(scores: Column, temperature: float = 1.6) -> Column:
    """Softmax over the available scores of a map column; unavailable heads are omitted, not zero."""
    if temperature <= 0:
        raise ValueError("temperature must be > 0")
    ok = F.map_filter(scores, lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    top = F.array_max(F.map_values(ok))
    exped = F.transform_values(ok, lambda k, v: F.exp((v - top) / F.lit(temperature)))
    total = F.aggregate(F.map_values(exped), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(exped, lambda k, v: v / total)


def portable_logistic(df: DataFrame, model: dict) -> Column:
    """Score an exported logistic model: impute, scale, dot, sigmoid - one generated expression."""
    types = dict(df.dtypes)
    z = F.lit(float(model["intercept"]))
    for name, med, mean, sd, coef in zip(
        model["numeric_features"], model["imputer_median"], model["scaler_mean"], model["scaler_scale"], model["coef"]
    ):
        x = F.coalesce(finite(types, name), F.lit(float(med)))
        z = z + F.lit(float(coef)) * ((x - F.lit(float(mean))) / F.lit(float(sd) if sd else 1.0))
    return 1.0 / (1.0 + F.exp(-z))


def autonomic_mode(sns: Column, pns: Column) -> Column:
    """Seven-way mode of a (sympathetic, parasympathetic) z pair; NULL between the regions."""
    return (
        F.when((sns >= 1) & (pns <= -1), "reciprocal_sympathetic")
        .when((sns <= -1) & (pns >= 1), "reciprocal_parasympathetic")
        .when((sns >= 1) & (pns >= 1), "coactivation")
        .when((sns <= -1) & (pns <= -1), "coinhibition")
        .when((F.abs(pns) < 0.5) & (F.abs(sns) >= 1), "uncoupled_sns")
        .when((F.abs(sns) < 0.5) & (F.abs(pns) >= 1), "uncoupled_pns")
        .when((F.abs(sns) < 0.5) & (F.abs(pns) < 0.5), "homeostatic")
    )
