"""Queries along the rows of a session: short-gap filling, runs and bursts, beat quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as AR
from pulsegrid.operators import series as S
from pulsegrid.plans.registry import query
from pulsegrid.plans.views import SIGNAL_SQL, STREAM_SQL, events_stream, rounded, signals

KEYS, TIME, TIES, BUCKET = ["session_id"], "sample_offset_s", ["sample_index"], 16.0
TOLERANCES = {"hr": 3.0, "eda": 5.0, "temperature": 8.0}
OVER = "PARTITION BY session_id ORDER BY t, sample_index"


def _near_sql(c: str) -> str:
    return f"""last_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt_{c}, last_value({c} IGNORE NULLS) OVER p AS pv_{c},
      first_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) OVER f AS nt_{c}, first_value({c} IGNORE NULLS) OVER f AS nv_{c}"""


def _filled_sql(c: str, tolerance: float) -> str:
    return f"""{c} IS NOT NULL AS {c}__native, round(coalesce({c}, CASE WHEN nt_{c} - pt_{c} <= {tolerance} THEN
      CASE WHEN nt_{c} = pt_{c} THEN pv_{c} ELSE pv_{c} + (nv_{c} - pv_{c}) * ((t - pt_{c}) / (nt_{c} - pt_{c})) END END), 6) AS {c}"""


@query(
    "hydrate_short_gaps",
    f"""WITH {STREAM_SQL}, n AS (SELECT *, {", ".join(map(_near_sql, TOLERANCES))} FROM stream
      WINDOW p AS ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS ({OVER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT session_id, sample_index, {", ".join(_filled_sql(c, x) for c, x in TOLERANCES.items())} FROM n""",
)
def hydrate_short_gaps(spark, sf):
    filled = S.hydrate(events_stream(spark, sf), KEYS, TIME, TIES, TOLERANCES, BUCKET)
    return rounded(filled.select("session_id", "sample_index", *TOLERANCES, *[f"{c}__native" for c in TOLERANCES]))


@query(
    "device_profile",
    f"WITH {STREAM_SQL} SELECT session_id, count(*) AS rows, count(hr) AS hr, count(ibi) AS ibi, count(temperature) AS temperature FROM stream GROUP BY session_id",
)
def device_profile(spark, sf):
    """What a wrist device would have seen of each session: no skin conductance, no pulse wave."""
    sensors = {c: (c,) for c in ("hr", "eda", "bvp", "temperature", "ibi")}
    seen = S.project_profile(events_stream(spark, sf), "watch_core", sensors, ["session_id"])
    return seen.groupBy("session_id").agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in seen.columns if c in sensors])


#: Runs of high ratings: islands are numbered by the rows that end them.
RUN_SQL = f"""{STREAM_SQL}, flagged AS (SELECT session_id, sample_index, t, coalesce(covas >= 40, false) AS is_on FROM stream),
islands AS (SELECT *, sum(CASE WHEN is_on THEN 0 ELSE 1 END) OVER ({OVER}) AS island FROM flagged),
runs AS (SELECT *, CASE WHEN is_on THEN sum(CASE WHEN is_on THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY t, sample_index ROWS UNBOUNDED PRECEDING) ELSE 0 END AS run FROM islands)"""


def _high():
    return F.col("source_pain_covas_0_100") >= 40


@query("sustained_flag", f"WITH {RUN_SQL} SELECT session_id, sample_index, CAST(run AS BIGINT) AS run, run >= 3 AS sustained FROM runs")
def sustained_flag(spark, sf):
    s = S.run_lengths(events_stream(spark, sf), KEYS, TIME, TIES, _high(), BUCKET)
    return S.sustained(s, KEYS, TIME, TIES, _high(), 3, BUCKET).select("session_id", "sample_index", "run", "sustained")


@query(
    "burst_summary",
    f"""WITH {RUN_SQL}, b AS (SELECT *, max(run) OVER (PARTITION BY session_id, island) AS size, lag(is_on) OVER ({OVER}) AS was FROM runs)
    SELECT session_id, count(*) AS rows, count(*) FILTER (is_on AND size >= 2) AS burst_rows, count(*) FILTER (run = 2) AS bursts, CAST(max(run) AS BIGINT) AS longest_run,
      count(*) FILTER (was IS NOT NULL AND was <> is_on) AS transitions, round(count(*) FILTER (is_on AND size >= 2) / CAST(count(*) AS DOUBLE), 6) AS burst_fraction FROM b GROUP BY session_id""",
)
def burst_summary(spark, sf):
    return rounded(S.burst_summary(events_stream(spark, sf), KEYS, TIME, TIES, _high(), 2, BUCKET))


@query(
    "beat_quality",
    f"""WITH {STREAM_SQL}, beats AS (SELECT session_id, sample_index, t, ibi / 50.0 AS ibi, CASE WHEN ibi / 50.0 BETWEEN 0.3 AND 2.0 THEN ibi / 50.0 END AS beat FROM stream WHERE ibi IS NOT NULL),
    linked AS (SELECT *, last_value(beat IGNORE NULLS) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM beats),
    g AS (SELECT session_id, t, CASE WHEN was IS NULL OR abs(beat - was) <= 0.5 * was THEN beat END AS good, CASE WHEN abs(beat - was) <= 0.5 * was THEN (beat - was) * 1000.0 END AS d FROM linked),
    a AS (SELECT session_id, count(*) AS ibi_beat_count, 1.0 - count(good) / CAST(count(*) AS DOUBLE) AS frac, max(t) - min(t) AS seconds, median(good) AS median_ibi, sqrt(avg(d * d)) AS rmssd_ms,
      stddev_samp(good * 1000.0) AS sdnn_ms, avg(CASE WHEN abs(d) > 20.0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END) AS pnn20, avg(CASE WHEN abs(d) > 50.0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END) AS pnn50,
      var_samp(d) AS vd, var_samp(good * 1000.0) AS v, count(good) AS n FROM g GROUP BY session_id)
    SELECT session_id, ibi_beat_count, round(frac, 6) AS ibi_outlier_frac, round(seconds, 6) AS hrv_window_duration_s, round(median_ibi, 6) AS median_ibi, round(rmssd_ms, 6) AS rmssd_ms, round(sdnn_ms, 6) AS sdnn_ms,
      round(pnn20, 6) AS pnn20, CASE WHEN n >= 6 THEN round(pnn50, 6) END AS pnn50, round(sqrt(vd / 2.0), 6) AS poincare_sd1,
      CASE WHEN n >= 6 AND frac <= 0.6 THEN round(sqrt(greatest(0.0, 2.0 * v - vd / 2.0)), 6) END AS poincare_sd2, n >= 6 AND frac <= 0.6 AS hrv_valid_for_rmssd, n >= 6 AND frac <= 0.6 AND seconds >= 60 AS hrv_valid_for_sdnn FROM a""",
)
def beat_quality(spark, sf):
    s = events_stream(spark, sf).withColumn("ibi", F.col("ibi") / 50.0)
    return rounded(S.beat_statistics(s, KEYS, TIME, TIES, "ibi", BUCKET, change=0.5, min_beats=6, max_outliers=0.6))


@query(
    "signal_jerk",
    f"""WITH {SIGNAL_SQL}, d AS (SELECT signal_id, (v - lag(v) OVER (PARTITION BY signal_id ORDER BY i)) * 4.0 AS j FROM pt)
    SELECT signal_id, round(avg(abs(j)), 6) AS jerk_mean, round(sqrt(avg(j * j)), 6) AS jerk_rms FROM d GROUP BY signal_id""",
)
def signal_jerk(spark, sf):
    mean_abs, rms = AR.jerk(F.col("x"), 4.0)
    return rounded(signals(spark, sf).select("signal_id", mean_abs.alias("jerk_mean"), rms.alias("jerk_rms")))
