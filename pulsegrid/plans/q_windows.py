"""Event-time window queries over the event stream view."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import windows as win
from pulsegrid.plans.registry import query
from pulsegrid.plans.views import CHANNELS, SPEC, STREAM_SQL, WINDOW_SQL, events_stream, rounded

SENSORS = list(CHANNELS)
W_KEYS = "dataset_id, session_id, round(w_end, 6) AS window_end_s"


def _features(spark, sf, *columns, **kw):
    return win.window_features(events_stream(spark, sf), SPEC, all_blocks=False, columns=columns or None, **kw)


def _summary_sql(c: str) -> str:
    return f"""CAST(count({c}) > 0 AS INTEGER) AS {c}__present, count({c}) AS {c}__valid_count,
      round(count({c}) / CAST(count(*) AS DOUBLE), 6) AS {c}__valid_frac, round(avg({c}), 6) AS {c}__mean,
      round(stddev_pop({c}), 6) AS {c}__std, round(min({c}), 6) AS {c}__min, round(max({c}), 6) AS {c}__max,
      round(arg_max({c}, t), 6) AS {c}__last,
      CASE WHEN count({c}) > 1 THEN round(regr_slope({c}, t), 6) + 0.0 END AS {c}__slope_per_s"""


#: Peak counts: neighbours among the valid samples of a window, threshold mean + 0.25 std.
def _peaks_sql(c: str) -> str:
    return f"""peaks_{c} AS (
  SELECT dataset_id, session_id, k, count(*) FILTER (WHERE v > pv AND v >= nv AND v > m + 0.25 * s) AS {c}__peak_count
  FROM (SELECT dataset_id, session_id, k, {c} AS v,
      lag({c}) OVER g AS pv, lead({c}) OVER g AS nv, avg({c}) OVER (PARTITION BY dataset_id, session_id, k) AS m,
      stddev_pop({c}) OVER (PARTITION BY dataset_id, session_id, k) AS s
    FROM w WHERE {c} IS NOT NULL WINDOW g AS (PARTITION BY dataset_id, session_id, k ORDER BY t)) GROUP BY ALL)"""


HRV_SQL = """hrv AS (
  SELECT dataset_id, session_id, k, round(sqrt(avg(d * d)), 6) AS ibi__rmssd_ms,
    CASE WHEN count(*) > 1 THEN round(stddev_samp(v), 6) END AS ibi__sdnn_ms
  FROM (SELECT dataset_id, session_id, k, ibi * 1000.0 AS v,
      ibi * 1000.0 - lag(ibi * 1000.0) OVER (PARTITION BY dataset_id, session_id, k ORDER BY t) AS d
    FROM w WHERE ibi IS NOT NULL) GROUP BY ALL)"""

LABEL_SQL = """CAST(count(pain) > 0 AS INTEGER) AS target_available, round(avg(pain), 6) AS target_pain_nrs_0_10,
      round(min(pain), 6) AS target_pain_min, round(max(pain), 6) AS target_pain_max, count(pain) AS target_pain_count,
      round(count(pain) / CAST(count(*) AS DOUBLE), 6) AS target_pain_coverage"""


@query(
    "window_table_flagship",
    f"""WITH {WINDOW_SQL}, {", ".join(_peaks_sql(c) for c in SENSORS)}, {HRV_SQL},
base AS (
  SELECT dataset_id, session_id, k, any_value(subject_id) AS subject_id, round(w_end, 6) AS window_end_s,
    round(w_start, 6) AS window_start_s, round(w_end - w_start, 6) AS window_seconds, 1.0::DOUBLE AS target_hz,
    any_value(source_rows) AS source_rows, round(any_value(max_gap), 6) AS window_max_gap_s,
    round(any_value(allowed), 6) AS window_allowed_gap_s, 1 AS window_contiguous,
    arg_min(condition, t) AS condition,
    {", ".join(_summary_sql(c) for c in SENSORS)}, {LABEL_SQL}
  FROM w GROUP BY dataset_id, session_id, k, w_start, w_end)
SELECT base.* EXCLUDE (k), {", ".join(f"coalesce({c}__peak_count, 0) AS {c}__peak_count" for c in SENSORS)},
  ibi__rmssd_ms, ibi__sdnn_ms
FROM base {" ".join(f"LEFT JOIN peaks_{c} USING (dataset_id, session_id, k)" for c in SENSORS)}
  LEFT JOIN hrv USING (dataset_id, session_id, k)""",
)
def window_table_flagship(spark, sf):
    return rounded(_features(spark, sf))


@query(
    "window_anchors",
    f"WITH {WINDOW_SQL} SELECT dataset_id, session_id, k, round(w_end, 6) AS window_end_s FROM anchors",
)
def window_anchors(spark, sf):
    return rounded(win.window_anchors(events_stream(spark, sf), SPEC))


@query(
    "sliding_window_agg",
    f"""WITH {WINDOW_SQL} SELECT {W_KEYS}, round(w_start, 6) AS window_start_s, any_value(source_rows) AS source_rows,
    round(avg(hr), 6) AS hr__mean, round(max(eda), 6) AS eda__max FROM w GROUP BY dataset_id, session_id, k, w_start, w_end""",
)
def sliding_window_agg(spark, sf):
    return rounded(_features(
        spark, sf, "dataset_id", "session_id", "window_end_s", "window_start_s", "source_rows", "hr__mean", "eda__max"))


@query(
    "window_gap_filter",
    f"""WITH {WINDOW_SQL}, g AS (SELECT *, CASE WHEN n_gaps > 0 THEN max_gap_raw ELSE 0.0 END AS mg,
      CASE WHEN n_gaps > 0 THEN greatest(8.0, 2.0 * med_gap) ELSE 8.0 END AS ag FROM win)
    SELECT {W_KEYS}, source_rows, round(mg, 6) AS window_max_gap_s, round(ag, 6) AS window_allowed_gap_s,
      CAST(mg <= ag AS INTEGER) AS window_contiguous FROM g""",
)
def window_gap_filter(spark, sf):
    return rounded(_features(
        spark, sf, "dataset_id", "session_id", "window_end_s", "source_rows", "window_max_gap_s", "window_allowed_gap_s",
        "window_contiguous", keep_gapped=True))


@query(
    "window_context_first",
    f"""WITH {WINDOW_SQL} SELECT {W_KEYS}, any_value(subject_id) AS subject_id, arg_min(condition, t) AS condition
    FROM w GROUP BY dataset_id, session_id, k, w_end""",
)
def window_context_first(spark, sf):
    return rounded(_features(spark, sf, "dataset_id", "session_id", "window_end_s", "subject_id", "condition"))


@query("window_labels", f"WITH {WINDOW_SQL} SELECT {W_KEYS}, {LABEL_SQL} FROM w GROUP BY dataset_id, session_id, k, w_end")
def window_labels(spark, sf):
    return rounded(_features(
        spark, sf, "dataset_id", "session_id", "window_end_s", "target_available", "target_pain_nrs_0_10", "target_pain_min",
        "target_pain_max", "target_pain_count", "target_pain_coverage"))


ABSENT_SQL = """0 AS grip__present, CAST(0 AS BIGINT) AS grip__valid_count, 0.0::DOUBLE AS grip__valid_frac,
    CAST(NULL AS DOUBLE) AS grip__mean, CAST(0 AS BIGINT) AS grip__peak_count"""


@query(
    "sensor_summary",
    f"""WITH {WINDOW_SQL} SELECT {W_KEYS}, {", ".join(_summary_sql(c) for c in SENSORS)}, {ABSENT_SQL}
    FROM w GROUP BY dataset_id, session_id, k, w_end""",
)
def sensor_summary(spark, sf):
    cols = [f"{c}__{s}" for c in SENSORS for s in ("present", "valid_count", "valid_frac", *win.SUMMARY_STATS)]
    grip = [f"grip__{s}" for s in ("present", "valid_count", "valid_frac", "mean", "peak_count")]
    return rounded(win.window_features(events_stream(spark, sf), SPEC, columns=("dataset_id", "session_id", "window_end_s", *cols, *grip)))


@query(
    "window_slope",
    f"""WITH {WINDOW_SQL} SELECT {W_KEYS}, CASE WHEN count(hr) > 1 THEN round(regr_slope(hr, t), 6) + 0.0 END AS hr__slope_per_s,
    CASE WHEN count(eda) > 1 THEN round(regr_slope(eda, t), 6) + 0.0 END AS eda__slope_per_s
    FROM w GROUP BY dataset_id, session_id, k, w_end""",
)
def window_slope(spark, sf):
    return rounded(_features(
        spark, sf, "dataset_id", "session_id", "window_end_s", "hr__slope_per_s", "eda__slope_per_s"))


@query(
    "window_peaks",
    f"""WITH {WINDOW_SQL}, {_peaks_sql('hr')}, {_peaks_sql('eda')}
    SELECT dataset_id, session_id, round(w_end, 6) AS window_end_s, coalesce(hr__peak_count, 0) AS hr__peak_count,
      coalesce(eda__peak_count, 0) AS eda__peak_count
    FROM admitted LEFT JOIN peaks_hr USING (dataset_id, session_id, k) LEFT JOIN peaks_eda USING (dataset_id, session_id, k)""",
)
def window_peaks(spark, sf):
    return rounded(_features(
        spark, sf, "dataset_id", "session_id", "window_end_s", "hr__peak_count", "eda__peak_count"))


@query(
    "hrv_rmssd_sdnn",
    f"""WITH {WINDOW_SQL}, {HRV_SQL} SELECT dataset_id, session_id, round(w_end, 6) AS window_end_s, ibi__rmssd_ms, ibi__sdnn_ms
    FROM admitted LEFT JOIN hrv USING (dataset_id, session_id, k)""",
)
def hrv_rmssd_sdnn(spark, sf):
    return rounded(_features(
        spark, sf, "dataset_id", "session_id", "window_end_s", "ibi__rmssd_ms", "ibi__sdnn_ms"))


#: Three axes derived from the event rows themselves: value, rating, and sequence number modulo 7, all scaled.
ACC_SQL = "value / 1000.0 AS acc_x, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 1000.0 AS acc_y, (event_id % 7) / 100.0 AS acc_z"


def with_axes(spark, sf):
    s = events_stream(spark, sf)
    value = F.coalesce(*SENSORS)
    return s.withColumns({
        "acc_x": value / 1000.0, "acc_y": F.col("source_pain_covas_0_100") / 1000.0,
        "acc_z": (F.col("sample_index") % 7) / 100.0,
    })


@query(
    "acc_stillness",
    f"""WITH {WINDOW_SQL}, axes AS (SELECT event_id AS sample_index, {ACC_SQL} FROM events),
    m AS (SELECT w.dataset_id, w.session_id, w.k, w.w_end, w.t, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS mag
      FROM w JOIN axes USING (sample_index)),
    d AS (SELECT *, abs(mag - lag(mag) OVER (PARTITION BY dataset_id, session_id, k ORDER BY t)) AS dm FROM m)
    SELECT {W_KEYS}, round(avg(mag), 6) AS acc__mag__mean, round(stddev_pop(mag), 6) AS acc__mag__std,
      CAST(count(mag) > 0 AS INTEGER) AS acc__present,
      round(avg(CASE WHEN dm < 0.02 THEN 1.0 WHEN dm IS NOT NULL THEN 0.0 END), 6) AS acc__stillness_frac
    FROM d GROUP BY dataset_id, session_id, k, w_end""",
)
def acc_stillness(spark, sf):
    columns = ("dataset_id", "session_id", "window_end_s", "acc__mag__mean", "acc__mag__std", "acc__present", "acc__stillness_frac")
    return rounded(win.window_features(with_axes(spark, sf), SPEC, all_blocks=False, columns=columns))


def _scale_sql(width: float) -> str:
    return f"""SELECT dataset_id, session_id, round(w_end, 6) AS window_end_s, {width!r}::DOUBLE AS window_s, count(*) AS source_rows,
      round(avg(hr), 6) AS hr__mean, round(avg(eda), 6) AS eda__mean
    FROM (SELECT a.dataset_id, a.session_id, a.w_end, s.hr, s.eda FROM (
        SELECT dataset_id, session_id, t_min + {width} + unnest(generate_series(0, CAST(floor(t_max - (t_min + {width})) AS BIGINT))) AS w_end
        FROM bounds WHERE t_min + {width} <= t_max) a
      JOIN stream s ON s.session_id = a.session_id AND s.t > a.w_end - {width} AND s.t <= a.w_end)
    GROUP BY ALL HAVING count(*) >= 2"""


@query(
    "multiscale_union",
    f"""WITH {STREAM_SQL}, bounds AS (SELECT dataset_id, session_id, min(t) AS t_min, max(t) AS t_max FROM stream GROUP BY ALL)
    {_scale_sql(4.0)} UNION ALL {_scale_sql(8.0)} UNION ALL {_scale_sql(12.0)}""",
)
def multiscale_union(spark, sf):
    spec = win.WindowSpec(1.0, 12.0, False, 2, None)
    columns = ("dataset_id", "session_id", "window_end_s", "window_s", "source_rows", "hr__mean", "eda__mean")
    return rounded(win.multiscale(events_stream(spark, sf), spec, (4.0, 8.0, 12.0), all_blocks=False, columns=columns))


@query(
    "window_panes",
    f"""WITH {WINDOW_SQL} SELECT {W_KEYS}, count(*) AS source_rows, count(hr) AS valid_count, round(avg(hr), 6) AS mean,
      round(stddev_pop(hr), 6) AS std, round(min(hr), 6) AS min, round(max(hr), 6) AS max
    FROM member GROUP BY dataset_id, session_id, k, w_end HAVING count(*) >= 2""",
)
def window_panes(spark, sf):
    return rounded(win.pane_summary(events_stream(spark, sf), SPEC, "hr"))


@query(
    "window_manifest",
    f"""WITH {WINDOW_SQL} SELECT dataset_id, count(DISTINCT session_id) AS sessions_windowed, count(*) AS window_rows
    FROM admitted GROUP BY dataset_id""",
)
def window_manifest(spark, sf):
    return _features(spark, sf, "dataset_id", "session_id").groupBy("dataset_id").agg(
        F.countDistinct("session_id").alias("sessions_windowed"), F.count(F.lit(1)).alias("window_rows"))


@query(
    "session_cap",
    f"""WITH {STREAM_SQL}, r AS (SELECT *, dense_rank() OVER (PARTITION BY dataset_id ORDER BY session_id) AS r FROM stream)
    SELECT dataset_id, session_id, count(*) AS rows FROM r WHERE r <= 3 GROUP BY ALL""",
)
def session_cap(spark, sf):
    return win.cap_sessions(events_stream(spark, sf), 3).groupBy("dataset_id", "session_id").agg(F.count(F.lit(1)).alias("rows"))
