"""Label routing, binning and task labels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import schema as S
from pulsegrid.functions.text import row_mean, strip
from pulsegrid.operators.scale import exact_quantiles


def _text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    return F.col(name).cast("string")


def _number(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def label_family(df: DataFrame) -> Column:
    """Route a row to its label family; the first matching rule wins.

    The condition is the first non-empty of condition / aux state / activity / pain type. Only rows of
    the direct datasets that carry a target become ``direct_pain``.
    """
    dataset = F.coalesce(F.lower(strip(_text(df, "dataset_id"))), F.lit(""))
    parts = [F.nullif(_text(df, c), F.lit("")) for c in ("condition", "aux_state_label", "activity_status", "pain_type")]
    condition = F.coalesce(F.lower(strip(F.coalesce(*parts))), F.lit(""))
    target, stress = _number(df, "target_pain_nrs_0_10"), _number(df, "target_stress_binary")
    task_set = dataset.isin(*S.COGNITIVE_TASK_DATASETS)
    active = condition.rlike("|".join(S.EXERCISE_TERMS))
    return (
        F.when(dataset.isin(*S.DIRECT_PAIN_DATASETS) & target.isNotNull(), "direct_pain")
        .when(stress.isNotNull() | dataset.isin(*S.STRESS_PROXY_DATASETS), "stress_proxy")
        .when(task_set & condition.isin(*S.BASELINE_TERMS), "baseline_context")
        .when(task_set & condition.isin(*S.COGNITIVE_TERMS), "cognitive_load_proxy")
        .when(dataset.isin(*S.EMOTION_PROXY_DATASETS), "emotion_proxy")
        .when(dataset.isin(*S.ACTIVITY_CONTEXT_DATASETS) | active, "exercise_context")
        .when(dataset.isin(*S.EEG_DATASETS), "pain_context_unlabeled")
        .when(condition.isin(*S.BASELINE_TERMS), "baseline_context")
        .otherwise("unlabeled")
    )


def ordinal_pain_bin(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x <= 0, 0.0).when(x < 4, 1.0).when(x < 7, 2.0).when(x >= 7, 3.0)


def right_closed_bin(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """(-inf, e0] -> labels[0], (e0, e1] -> labels[1], ..., above the last edge -> labels[-1]."""
    x = F.col(c) if isinstance(c, str) else c
    chain = None
    for edge, label in zip(edges, labels):
        chain = F.when(x <= edge, label) if chain is None else chain.when(x <= edge, label)
    return chain.when(x > edges[-1], labels[-1])


# The three right-closed schemes.
BIN_SCHEMES = {
    "nrs": ((0.0, 3.0, 6.0), ("zero", "mild", "moderate", "high")),
    "scale_1_5": ((0.0, 2.0, 4.0), ("zero", "low", "moderate", "high")),
    "transfer": ((0.0, 4.0, 7.0), ("zero", "mild", "moderate", "severe")),
}


def add_common_labels(df: DataFrame) -> DataFrame:
    out = df
    if "pain_intensity" not in df.columns and "target_pain_nrs_0_10" in df.columns:
        out = out.withColumn("pain_intensity", F.col("target_pain_nrs_0_10"))
    target = _number(out, "target_pain_nrs_0_10")
    return out.withColumns({"label_family": label_family(out), "target_pain_bin": ordinal_pain_bin(target)})


def rows_for_pain_training(df: DataFrame) -> DataFrame:
    return df.where((F.col("label_family") == "direct_pain") & F.col("target_pain_nrs_0_10").isNotNull())


def task_rows(windows: DataFrame) -> DataFrame:
    """The four labelled tasks as one table: one scan, each row emitted once per task it belongs to."""
    pain, stress = _number(windows, "target_pain_nrs_0_10"), _number(windows, "target_stress_binary")
    ds, cond = F.col("dataset_id"), F.col("condition")

    def task(name: str, keep: Column, value: Column, y: Column) -> Column:
        return F.when(keep, F.struct(F.lit(name).alias("task"), value.cast("double").alias("target_value"), y.cast("int").alias("y")))

    tasks = F.array(
        task("pain_high_4_plus", ds.isin(*S.ANCHOR_PAIN_DATASETS) & pain.isNotNull(), pain, pain >= 4.0),
        task("wesad_stress", (ds == "wesad") & stress.isNotNull(), stress, stress),
        task(
            "stress_vs_exercise",
            (ds == "induced_stress_exercise") & cond.isin("stress", "aerobic", "anaerobic"),
            (cond == "stress").cast("double"), cond == "stress",
        ),
        task("cognitive_load_vs_baseline", ds == "catsa", (~cond.eqNullSafe("baseline")).cast("double"), ~cond.eqNullSafe("baseline")),
    )
    keep = [c for c in windows.columns if c not in ("target_value", "y", "task")]
    return windows.select(*keep, F.explode_outer(F.array_compact(tasks)).alias("__t")).where("__t IS NOT NULL").select(
        *keep, "__t.task", "__t.target_value", "__t.y")


# Weak labels ----------------------------------------------------------------------------------

#: Recovery proxy parts (column, inverted).
PROXY_PARTS = (
    ("ibi__base__mean", False), ("hr__base__mean", True), ("eda__base__mean", True),
    ("eda__shape__late_minus_early_z", True), ("acc_mag__base__std", True),
)


def quantile_scaled(x: Column, lo: Column, hi: Column, invert: bool = False) -> Column:
    """Scale p05..p95 to 0..1, clipped; NULL where the range is empty."""
    scaled = F.when(x.isNotNull() & (hi > lo), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo))))
    return 1.0 - scaled if invert else scaled


def proxy_thresholds(df: DataFrame) -> dict[str, tuple[float | None, float | None]]:
    """p05/p95 of every available proxy part: one row, fitted on whatever rows are passed (e.g. a training fold)."""
    parts = [c for c, _ in PROXY_PARTS if c in df.columns]
    row = exact_quantiles(df, [], parts, (0.05, 0.95)).first()
    return {c: (row[f"{c}__q050"], row[f"{c}__q950"]) for c in parts}


def proxy_score(df: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Add ``pns_proxy_score``: mean of the available scaled parts."""
    limits = proxy_thresholds(df) if thresholds is None else thresholds
    parts = []
    for c, invert in PROXY_PARTS:
        lo, hi = limits.get(c, (None, None))
        if c in df.columns and lo is not None and hi is not None:
            parts.append(quantile_scaled(F.col(c), F.lit(float(lo)), F.lit(float(hi)), invert))
    return df.withColumn("pns_proxy_score", row_mean(parts))


def recovery_cuts(home_rows: DataFrame, min_candidates: int = 20) -> tuple[float | None, float | None]:
    """p30/p70 of the proxy over resting rows; (None, None) with too few candidates."""
    candidates = home_rows.where(F.col("pns_proxy_score").isNotNull()).select("pns_proxy_score")
    if candidates.limit(min_candidates).count() < min_candidates:
        return None, None
    row = exact_quantiles(candidates, [], ["pns_proxy_score"], (0.30, 0.70)).first()
    return row["pns_proxy_score__q300"], row["pns_proxy_score__q700"]


def weak_labels(
    df: DataFrame, min_candidates: int = 20, thresholds: dict | None = None, cuts: tuple[float | None, float | None] | None = None
) -> DataFrame:
    """Sympathetic / homeostasis / recovery / activity labels from (task, y, dataset); NULL where undefined.

    By default thresholds and cuts are fitted on all rows; pass those of a training fold to avoid leakage.
    """
    task, y = F.col("task"), F.col("y")
    arousal = task.isin("wesad_stress", "cognitive_load_vs_baseline", "pain_high_4_plus")
    positive = (arousal | (task == "stress_vs_exercise")) & (y == 1)
    calm = arousal & (y == 0)
    home = calm & ~((task == "pain_high_4_plus") & (F.col("dataset_id") == "painmonit_pmed"))
    scored = proxy_score(df, thresholds)
    low, high = cuts if cuts is not None else recovery_cuts(scored.where(home), min_candidates)
    score = F.col("pns_proxy_score")
    low, high = F.lit(low).cast("double"), F.lit(high).cast("double")
    recovery = (
        F.when(low.isNull() | score.isNull(), F.lit(None).cast("double"))
        .when(positive, 0.0)
        .when(home & (score <= low), 0.0)
        .when(home & (score >= high), 1.0)
    )
    return scored.withColumns(
        {
            "sympathetic_activation": F.when(positive, 1.0).when(calm, 0.0),
            "homeostasis": F.when(positive, 0.0).when(home, 1.0),
            "parasympathetic_recovery_proxy": recovery,
            "activity_control": F.when((task == "stress_vs_exercise") & (y == 0), 1.0).when(
                (task != "stress_vs_exercise") & y.isNotNull(), 0.0
            ),
        }
    )
