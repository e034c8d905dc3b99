"""Subject-level side tables: questionnaires, clinical workbooks and score matrices (CSV or Parquet input)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import text as X


def last_per_subject(rows: DataFrame, order: str) -> DataFrame:
    """The last row of every subject by ``order``, whole (its nulls included); among equal orders the greatest row."""
    kept = [c for c in rows.columns if c not in ("subject_id", order)]
    last = rows.groupBy("subject_id").agg(F.max(F.struct(F.col(order).alias("o"), *kept)).alias("row"))
    return last.select("subject_id", *[F.col(f"row.{c}").alias(c) for c in kept])


def _row_order(raw: DataFrame, row_order: str | None) -> DataFrame:
    return raw.withColumn("__order", F.col(f"`{row_order}`") if row_order else F.monotonically_increasing_id())


def clinical_workbook(raw: DataFrame, row_order: str | None = None) -> DataFrame:
    """One cleaned row per subject: the last by the column ``row_order``, without one the last as the file is read."""
    df = X.canonical_columns(_row_order(raw, row_order).withColumnRenamed("__order", "row_order"))
    rows = df.where(X.clean_text("uid").isNotNull()).select(
        "row_order", F.lower(X.clean_text("uid")).alias("subject_id"), X.clean_numeric("age").alias("workbook_age"),
        X.clean_text("gender").alias("workbook_sex"), X.clean_text("diagnosis").alias("workbook_diagnosis"),
        X.clean_numeric("pain_scale_rest").alias("workbook_pain_rest"), X.clean_numeric("pain_scale_exercise").alias("workbook_pain_exercise"),
        X.clean_text("exercise_durations_seconds").alias("workbook_exercise_duration_text"))
    return last_per_subject(rows, "row_order")


# Questionnaire column titles.
SURVEY_COLUMNS = {
    "survey_age": ("Age", X.clean_numeric),
    "survey_gender": ("Gender (Biological)", X.clean_text),
    "survey_sleep_hours_avg": ("How many hours do you sleep per day on average?", X.numeric_first),
    "survey_sleep_hours_before_test": ("How many hours did you sleep before this test?", X.numeric_first),
    "survey_daily_stress_ordinal": ("What do you think about your stress level in your daily life?", X.ordinal_text_score),
    "survey_chronic_pain_flag": ("Do you have any chronic pain conditions?", X.yes_no_flag),
    "survey_regular_medication_flag": ("Are there any medications or supplements you currently use regularly?", X.yes_no_flag),
    "survey_pain_type": ("What is your pain type?", X.clean_text),
}
SEVERITY_TITLE = "Rate the severity of your pain"


def survey_metrics(raw: DataFrame, row_order: str | None = None) -> DataFrame:
    """Questionnaire answers as numbers, one row per subject: the last by ``row_order``, without one the last as the file is read.

    Severity answers are averaged over the answered ones.
    """
    quoted = {c: F.col(f"`{c}`").cast("string") for c in raw.columns}
    out = {n: fn(quoted[title]) for n, (title, fn) in SURVEY_COLUMNS.items() if title in quoted}
    severity = [X.ordinal_text_score(quoted[c]) for c in raw.columns if SEVERITY_TITLE in c]
    if severity:
        out["survey_pain_context_score"] = X.row_mean(severity)
    subject = X.clean_text(quoted["id"])
    rows = _row_order(raw, row_order).where(subject.isNotNull()).select("__order", subject.alias("subject_id"), *[e.alias(n) for n, e in out.items()])
    return last_per_subject(rows, "__order")


def score_matrix(wide: DataFrame, subject: str, file_order: str | None = None) -> DataFrame:
    """Subject x phase matrix to mean and maximum score per subject; a later file replaces an earlier one."""
    skip = {subject, file_order}
    long = wide.unpivot(
        [subject, *([file_order] if file_order else [])], [c for c in wide.columns if c not in skip], "phase", "score")
    score = F.col("score").try_cast("double")
    keys = [F.lower(F.col(subject).cast("string")).alias("subject_id"), *([F.col(file_order)] if file_order else [])]
    per = long.where(score.isNotNull()).groupBy(*keys).agg(
        F.avg(score).alias("target_stress_score_mean_0_10"), F.max(score).alias("target_stress_score_0_10"))
    if not file_order:
        return per
    metrics = ["target_stress_score_mean_0_10", "target_stress_score_0_10"]
    return per.groupBy("subject_id").agg(F.max_by(F.struct(*metrics), F.col(file_order)).alias("m")).select("subject_id", "m.*")


def stack_files(frames: Sequence[DataFrame], file_order: str = "file_order") -> DataFrame:
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn(file_order, F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
