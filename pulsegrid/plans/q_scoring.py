"""Baseline, robust scaling and row-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import scoring as K
from pulsegrid.operators import baseline as B
from pulsegrid.operators.windows import window_features
from pulsegrid.plans.q_windows import HRV_SQL, SENSORS, _peaks_sql, _summary_sql
from pulsegrid.plans.registry import query, table
from pulsegrid.plans.views import BASELINE_SQL, SPEC, STREAM_SQL, WINDOW_SQL, baseline_rows, events_stream, r6, rounded

FEATURES = ("eda__mean", "hr__mean")
PROFILE_SQL = f"""{BASELINE_SQL},
rest AS (SELECT * FROM br WHERE lower(condition) = 'rest'),
med AS (SELECT dataset_id, subject_id, {', '.join(f'median({f}) AS m_{f}' for f in FEATURES)} FROM rest GROUP BY ALL),
prof AS (SELECT r.dataset_id, r.subject_id, count(*) AS n,
  {', '.join(f"any_value(m_{f}) AS {f}__b_median, avg({f}) AS {f}__b_mean, stddev_pop({f}) AS {f}__b_std, median(abs({f} - m_{f})) AS {f}__b_mad, quantile_cont({f}, 0.05) AS {f}__b_p05, quantile_cont({f}, 0.95) AS {f}__b_p95" for f in FEATURES)}
  FROM rest r JOIN med USING (dataset_id, subject_id) GROUP BY ALL),
subj AS (SELECT DISTINCT dataset_id, subject_id FROM br)"""
STATS = [f"{f}__b_{s}" for f in FEATURES for s in ("median", "mean", "std", "mad", "p05", "p95")]


@query(
    "baseline_profile",
    f"""WITH {PROFILE_SQL} SELECT dataset_id, subject_id, coalesce(n, 0) AS n_windows, {', '.join(f'round({s}, 6) AS {s}' for s in STATS)},
      dataset_id || '::' || subject_id || '::explicit_rest::v1' AS baseline_profile_id, CASE WHEN n > 0 THEN 'explicit_rest' ELSE 'none' END AS baseline_source,
      CASE WHEN n > 0 THEN 'relaxed_rest' ELSE 'unknown_untrusted' END AS baseline_label_state, round(least(1.0, coalesce(n, 0) / 10.0), 6) AS quality_0_1
    FROM subj LEFT JOIN prof USING (dataset_id, subject_id)""",
)
def baseline_profile(spark, sf):
    return rounded(B.baseline_profiles(baseline_rows(spark, sf)))


def _relative_sql(f: str) -> str:
    return f"""round({f} - {f}__b_median, 6) + 0.0 AS {f}__delta_from_profile_median,
      CASE WHEN {f}__b_mad > 0 THEN round(({f} - {f}__b_median) / (1.4826 * {f}__b_mad), 6) + 0.0 END AS {f}__robust_z_from_profile"""


@query(
    "baseline_relative",
    f"""WITH {PROFILE_SQL} SELECT row_id, round(eda__mean, 6) AS eda__mean, {', '.join(_relative_sql(f) for f in FEATURES)},
      round((abs(eda__mean - eda__mean__b_median) + abs(hr__mean - hr__mean__b_median)) / 2.0, 6) AS baseline_distance_l1,
      CASE WHEN n > 0 THEN dataset_id || '::' || subject_id || '::explicit_rest::v1' END AS baseline_profile_id, coalesce(n, 0) > 0 AS baseline_profile_available,
      round(least(1.0, coalesce(n, 0) / 10.0), 6) AS baseline_profile_quality_0_1, CASE WHEN n > 0 THEN 'relaxed_rest' ELSE 'unknown_untrusted' END AS baseline_state_label
    FROM br LEFT JOIN prof USING (dataset_id, subject_id)""",
)
def baseline_relative(spark, sf):
    rows = baseline_rows(spark, sf)
    out = B.attach_baseline(rows, B.baseline_profiles(rows))
    return rounded(out.drop("dataset_id", "subject_id", "condition", "hr__mean"))


@query(
    "dataset_robust_z",
    f"""WITH {BASELINE_SQL}, x AS (SELECT *, CASE WHEN row_id % 9 > 0 THEN power(eda__mean, 3) END AS v, CASE WHEN hr__mean < 30 THEN 1.0 ELSE hr__mean END AS w FROM br),
    m AS (SELECT dataset_id, median(v) AS mv, median(w) AS mw, stddev_samp(v) AS sv, stddev_samp(w) AS sw FROM x GROUP BY ALL),
    d AS (SELECT dataset_id, any_value(mv) AS mv, any_value(mw) AS mw, any_value(sv) AS sv, any_value(sw) AS sw, median(abs(v - mv)) * 1.4826 AS av, median(abs(w - mw)) * 1.4826 AS aw
      FROM x JOIN m USING (dataset_id) GROUP BY dataset_id)
    SELECT row_id, round(CASE WHEN v IS NULL THEN 0.0 ELSE greatest(-8.0, least(8.0, (v - mv) / CASE WHEN av > 1e-9 THEN av WHEN sv > 1e-9 THEN sv END)) END, 6) + 0.0 AS v__dataset_robust_z,
      round(coalesce(greatest(-8.0, least(8.0, (w - mw) / CASE WHEN aw > 1e-9 THEN aw WHEN sw > 1e-9 THEN sw END)), 0.0), 6) + 0.0 AS w__dataset_robust_z
    FROM x JOIN d USING (dataset_id)""",
)
def dataset_robust_z(spark, sf):
    rows = baseline_rows(spark, sf).select(
        "dataset_id", "row_id", F.when(F.col("row_id") % 9 > 0, F.pow("eda__mean", F.lit(3))).alias("v"),
        F.when(F.col("hr__mean") < 30, 1.0).otherwise(F.col("hr__mean")).alias("w"))
    return rounded(B.dataset_robust_z(rows, "dataset_id", ["v", "w"]).drop("dataset_id", "v", "w"))


def _scored_windows(spark, sf):
    return K.ternary_score(window_features(events_stream(spark, sf), SPEC, all_blocks=False))


def _scaled_sql(x: str, center: float, scale: float, invert: bool) -> str:
    z = f"({x} - {center}) / {scale}"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(1.0, 0.5 + 0.25 * {'-' if invert else ''}({z}))) END"


def _wmean_sql(items) -> str:
    num = " + ".join(f"coalesce({v} * {w}, 0)" for v, w in items)
    den = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN {w} ELSE 0 END" for v, w in items)
    return f"CASE WHEN ({den}) > 0 THEN ({num}) / ({den}) END"


_ABSENT = {"acc__mag__std", "respiration__std"}
_INPUT_SQL = ", ".join(
    f"{'CAST(NULL AS DOUBLE)' if c in _ABSENT else _scaled_sql(c, ctr, sc, inv)} AS s_{n}" for n, (c, ctr, sc, inv) in K.SCALED_INPUTS.items()
)
SCORE_SQL = f"""{WINDOW_SQL}, {", ".join(_peaks_sql(c) for c in SENSORS)}, {HRV_SQL},
feat AS (SELECT b.*, coalesce(eda__peak_count, 0) AS eda__peak_count, ibi__rmssd_ms, ibi__sdnn_ms FROM (
    SELECT dataset_id, session_id, k, w_end, {", ".join(_summary_sql(c) for c in SENSORS)} FROM w GROUP BY dataset_id, session_id, k, w_end) b
  LEFT JOIN peaks_eda USING (dataset_id, session_id, k) LEFT JOIN hrv USING (dataset_id, session_id, k)),
raw AS (SELECT dataset_id, session_id, k, w_end, {", ".join(
    f"(CASE WHEN count({c}) > 1 THEN regr_slope({c}, t) END) AS {c}__slope_per_s, avg({c}) AS {c}__mean, stddev_pop({c}) AS {c}__std, count({c}) AS {c}__n" for c in SENSORS)}
  FROM w GROUP BY dataset_id, session_id, k, w_end),
full_feat AS (SELECT raw.*, coalesce(p.eda__peak_count, 0) AS eda__peak_count, h.rm AS ibi__rmssd_ms, h.sd AS ibi__sdnn_ms FROM raw
  LEFT JOIN peaks_eda p USING (dataset_id, session_id, k)
  LEFT JOIN (SELECT dataset_id, session_id, k, sqrt(avg(d * d)) AS rm, CASE WHEN count(*) > 1 THEN stddev_samp(v) END AS sd FROM (
      SELECT dataset_id, session_id, k, ibi * 1000.0 AS v, ibi * 1000.0 - lag(ibi * 1000.0) OVER (PARTITION BY dataset_id, session_id, k ORDER BY t) AS d
      FROM w WHERE ibi IS NOT NULL) GROUP BY ALL) h USING (dataset_id, session_id, k)),
parts AS (SELECT *, {_INPUT_SQL}, {_scaled_sql('eda__mean', 0.5, 1.5, False)} AS s_eda_level, {_scaled_sql('hr__mean', 75.0, 35.0, False)} AS s_hr_level FROM full_feat),
mix AS (SELECT *, {_wmean_sql([(f's_{n}', w) for n, w in K.SYMPATHETIC_WEIGHTS.items() if n != 'departure'])} AS s0,
  {_wmean_sql([(f's_{n}', w) for n, w in K.PARASYMPATHETIC_WEIGHTS.items() if n != 'pns_baseline'])} AS p0,
  (eda__n > 0)::INT + (hr__n > 0)::INT + (ibi__n > 0)::INT + (bvp__n > 0)::INT + (temperature__n > 0)::INT AS usable FROM parts),
mix2 AS (SELECT *, coalesce(s0, 0.33) AS s1, coalesce(p0, 0.33) AS p1, 1.0 - coalesce(s0, 0.33) AS low_arousal FROM mix),
mix3 AS (SELECT *, {_wmean_sql([('low_arousal', 1.1), ('s_stable_hr', 0.5), ('s_stable_eda', 0.5)])} AS h1 FROM mix2),
tern AS (SELECT *, greatest(s1, 1e-9) / (greatest(s1, 1e-9) + greatest(p1, 1e-9) + greatest(h1, 1e-9)) AS s,
  greatest(p1, 1e-9) / (greatest(s1, 1e-9) + greatest(p1, 1e-9) + greatest(h1, 1e-9)) AS p,
  greatest(h1, 1e-9) / (greatest(s1, 1e-9) + greatest(p1, 1e-9) + greatest(h1, 1e-9)) AS h FROM mix3)"""


@query(
    "ternary_score",
    f"""WITH {SCORE_SQL} SELECT dataset_id, session_id, round(w_end, 6) AS window_end_s, round(s, 6) AS sympathetic, round(p, 6) AS parasympathetic,
      round(h, 6) AS homeostasis, round(p + 0.5 * h, 6) AS ternary_x, round(sqrt(3.0) / 2.0 * h, 6) AS ternary_y,
      round(greatest(0.0, least(1.0, s * (1.0 - h))), 6) AS functional_pain_0_1, round(greatest(0.0, least(1.0, 0.65 * p + 0.35 * h)), 6) AS recovery_0_1,
      round(0.15 + 0.12 * usable, 6) AS sensor_quality_0_1, usable AS usable_sensor_count,
      concat_ws(',', CASE WHEN s0 IS NULL THEN 'sympathetic_missing_core' END, CASE WHEN p0 IS NULL THEN 'parasympathetic_missing_core' END,
        CASE WHEN usable < 2 THEN 'low_sensor_support' END, CASE WHEN ibi__n = 0 THEN 'pns_hrv_missing' END, CASE WHEN eda__n = 0 THEN 'sns_eda_missing' END) AS notes
    FROM tern""",
)
def ternary_score(spark, sf):
    cols = ["sympathetic", "parasympathetic", "homeostasis", "ternary_x", "ternary_y", "functional_pain_0_1", "recovery_0_1",
            "sensor_quality_0_1", "usable_sensor_count"]
    return rounded(_scored_windows(spark, sf).select(
        "dataset_id", "session_id", "window_end_s", *cols, F.array_join("notes", ",").alias("notes")))


@query(
    "weighted_mean_nullskip",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN NULL ELSE
      (coalesce(a * 1.4, 0) + coalesce(b * 0.9, 0) + coalesce(c * 0.7, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 1.4 END + CASE WHEN b IS NULL THEN 0 ELSE 0.9 END
      + CASE WHEN c IS NULL THEN 0 ELSE 0.7 END) END, 6) AS score
    FROM (SELECT *, nullif(l_discount, 0.0) AS a, nullif(l_tax, 0.0) AS b, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS c FROM lineitem)""",
)
def weighted_mean_nullskip(spark, sf):
    items = [(F.nullif("l_discount", F.lit(0.0)), 1.4), (F.nullif("l_tax", F.lit(0.0)), 0.9), (F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity")), 0.7)]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(K.weighted_mean(items)).alias("score"))


BLOCKS = tuple(SENSORS) + ("acc", "gyro")


def _presence(spark, sf):
    return events_stream(spark, sf).groupBy("dataset_id", "session_id", "condition").agg(
        F.avg("pain_intensity").alias("pain"), *[F.max(F.col(c).isNotNull().cast("int")).alias(f"{c}__present") for c in SENSORS])


PRESENCE_SQL = f"{STREAM_SQL}, pr AS (SELECT dataset_id, session_id, condition, avg(pain) AS pain, {', '.join(f'max(({c} IS NOT NULL)::INT) AS {c}_p' for c in SENSORS)} FROM stream GROUP BY ALL)"
USED_SQL = f"concat_ws(',', {', '.join(f'''CASE WHEN {c}_p > 0 THEN '{c}' END''' for c in SENSORS)})"
MISSING_SQL = f"concat_ws(',', {', '.join(f'''CASE WHEN {c}_p = 0 THEN '{c}' END''' for c in SENSORS)}, 'acc', 'gyro')"


@query("sensor_blocks_used", f"WITH {PRESENCE_SQL} SELECT session_id, condition, {USED_SQL} AS sensors_used, {MISSING_SQL} AS missing_sensor_blocks FROM pr")
def sensor_blocks_used(spark, sf):
    rows = _presence(spark, sf)
    used, missing = K.sensor_usage(rows, BLOCKS)
    return rows.select("session_id", "condition", F.array_join(used, ",").alias("sensors_used"), F.array_join(missing, ",").alias("missing_sensor_blocks"))


@query(
    "quality_confidence",
    f"""WITH {PRESENCE_SQL}, q AS (SELECT session_id, condition, pain / 10.0 AS p, {' + '.join(f'(1 - {c}_p)' for c in SENSORS)} + 2 AS missing,
      {' + '.join(f'{c}_p' for c in SENSORS)} AS used FROM pr), z AS (SELECT *, CASE WHEN used = 0 THEN 0.2 ELSE greatest(0.2, least(1.0, 1.0 - 0.07 * missing)) END AS quality FROM q)
    SELECT session_id, condition, round(quality, 6) AS quality_0_1, round(greatest(0.05, least(0.95, 0.5 * quality + 0.5 * (abs(p - 0.5) * 2.0))), 6) AS confidence,
      round(greatest(0.05, least(0.9, power(abs(p - 0.5) * 2.0, 1.6))), 6) AS conservative FROM z""",
)
def quality_confidence(spark, sf):
    rows = _presence(spark, sf)
    used, missing = K.sensor_usage(rows, BLOCKS)
    q = rows.select("session_id", "condition", (F.col("pain") / 10.0).alias("p"), K.score_quality(used, missing).alias("quality_0_1"))
    return rounded(q.select("session_id", "condition", "quality_0_1", K.confidence(F.col("p"), F.col("quality_0_1")).alias("confidence"),
                            K.conservative_confidence(F.col("p")).alias("conservative")))


@query(
    "confidence_grid",
    """SELECT k / 100.0 AS raw_probability, count(*) AS rows, round(greatest(0.05, least(0.95, 0.5 + 0.5 * (abs(k / 100.0 - 0.5) * 2.0))), 6) AS old_confidence,
      round(greatest(0.05, least(0.9, power(abs(k / 100.0 - 0.5) * 2.0, 1.6))), 6) AS conservative_confidence
    FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY k""",
)
def confidence_grid(spark, sf):
    """Both confidence formulas over the probability grid that occurs in the data."""
    k = F.get_json_object("props", "$.k").cast("long")
    grid = table(spark, sf, "events").groupBy((k / 100.0).alias("raw_probability")).agg(F.count(F.lit(1)).alias("rows"))
    p = F.col("raw_probability")
    return rounded(grid.select("raw_probability", "rows", K.confidence(p, F.lit(1.0)).alias("old_confidence"),
                               K.conservative_confidence(p).alias("conservative_confidence")))


HEADS = {"pain": "hr", "stress": "eda", "activity": "bvp", "departure": "temperature"}
PREF_SQL = f"{STREAM_SQL}, hs AS (SELECT session_id, condition, sample_index, {', '.join(f'{c} / 100.0 AS {h}' for h, c in HEADS.items() if h != 'departure')}, pain / 10.0 AS departure FROM stream), long AS (UNPIVOT hs ON pain, stress, activity, departure INTO NAME state VALUE v)"


@query(
    "softmax_pref",
    f"""WITH {PREF_SQL}, e AS (SELECT sample_index, state, exp((v - max(v) OVER (PARTITION BY sample_index)) / 1.6) AS x FROM long)
    SELECT sample_index, state, round(x / sum(x) OVER (PARTITION BY sample_index), 6) AS preference, round(max(x) OVER (PARTITION BY sample_index)
      / sum(x) OVER (PARTITION BY sample_index), 6) AS max_state_pref FROM e""",
)
def softmax_pref(spark, sf):
    s = events_stream(spark, sf)
    scores = {h: F.col(c) / 100.0 for h, c in HEADS.items() if h != "departure"} | {"departure": F.col("pain_intensity") / 10.0}
    packed = F.create_map(*[x for h, e in scores.items() for x in (F.lit(h), e)])
    prefs = s.select("sample_index", K.state_preferences(packed).alias("m"))
    out = prefs.select("sample_index", F.array_max(F.map_values("m")).alias("max_state_pref"), F.explode_outer("m").alias("state", "preference"))
    return rounded(out.where(F.col("state").isNotNull()))


@query(
    "state_margin",
    f"""WITH {PREF_SQL}, e AS (SELECT sample_index, state, exp((v - max(v) OVER (PARTITION BY sample_index)) / 1.6) AS x FROM long),
    p AS (SELECT sample_index, state, x / sum(x) OVER (PARTITION BY sample_index) AS p FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample_index ORDER BY p DESC) AS rk FROM p)
    SELECT sample_index, round(max(p) FILTER (WHERE rk = 1) - coalesce(max(p) FILTER (WHERE rk = 2), 0.0), 6) AS margin FROM r GROUP BY sample_index""",
)
def state_margin(spark, sf):
    s = events_stream(spark, sf)
    scores = {h: F.col(c) / 100.0 for h, c in HEADS.items() if h != "departure"} | {"departure": F.col("pain_intensity") / 10.0}
    packed = F.create_map(*[x for h, e in scores.items() for x in (F.lit(h), e)])
    ordered = s.select("sample_index", F.sort_array(F.map_values(K.state_preferences(packed)), asc=False).alias("v"))
    return rounded(ordered.select("sample_index", (F.get("v", 0) - F.coalesce(F.get("v", 1), F.lit(0.0))).alias("margin")))


#: Portable model over the window features: fixed coefficients, as an exported model table would carry them.
MODEL = {
    "numeric_features": ["hr__mean", "eda__mean", "bvp__mean"], "imputer_median": [35.0, 35.0, 35.0], "scaler_mean": [50.0, 49.0, 48.0],
    "scaler_scale": [30.0, 31.0, 29.0], "coef": [0.8, -0.5, 0.25], "intercept": -0.1,
}
_DOT = " + ".join(f"{c} * ((coalesce({f}, {m}) - {mu}) / {sd})" for f, m, mu, sd, c in zip(
    [s.replace("__mean", "_m") for s in MODEL["numeric_features"]], MODEL["imputer_median"], MODEL["scaler_mean"], MODEL["scaler_scale"], MODEL["coef"]))


@query(
    "portable_logistic_score",
    f"""WITH {STREAM_SQL}, x AS (SELECT session_id, condition, avg(hr) AS hr_m, avg(eda) AS eda_m, avg(bvp) AS bvp_m FROM stream GROUP BY ALL)
    SELECT session_id, condition, round(1.0 / (1.0 + exp(-({MODEL['intercept']} + {_DOT}))), 6) AS probability FROM x""",
)
def portable_logistic_score(spark, sf):
    x = events_stream(spark, sf).groupBy("session_id", "condition").agg(*[F.avg(c).alias(f"{c}__mean") for c in ("hr", "eda", "bvp")])
    return x.select("session_id", "condition", r6(K.portable_logistic(x, MODEL)).alias("probability"))


@query(
    "autonomic_mode",
    f"""WITH {BASELINE_SQL}, z AS (SELECT row_id, (eda__mean - avg(eda__mean) OVER ()) / stddev_pop(eda__mean) OVER () AS s, (hr__mean - avg(hr__mean) OVER ()) / stddev_pop(hr__mean) OVER () AS p FROM br)
    SELECT CASE WHEN s >= 1 AND p <= -1 THEN 'reciprocal_sympathetic' WHEN s <= -1 AND p >= 1 THEN 'reciprocal_parasympathetic' WHEN s >= 1 AND p >= 1 THEN 'coactivation'
      WHEN s <= -1 AND p <= -1 THEN 'coinhibition' WHEN abs(p) < 0.5 AND abs(s) >= 1 THEN 'uncoupled_sns' WHEN abs(s) < 0.5 AND abs(p) >= 1 THEN 'uncoupled_pns'
      WHEN abs(s) < 0.5 AND abs(p) < 0.5 THEN 'homeostatic' END AS mode, count(*) AS rows, round(avg(p - s), 6) + 0.0 AS balance, round(avg(p + s), 6) + 0.0 AS regulation FROM z GROUP BY ALL""",
)
def autonomic_mode(spark, sf):
    rows = baseline_rows(spark, sf)
    m = rows.agg(F.avg("eda__mean"), F.stddev_pop("eda__mean"), F.avg("hr__mean"), F.stddev_pop("hr__mean")).first()
    s, p = (F.col("eda__mean") - m[0]) / m[1], (F.col("hr__mean") - m[2]) / m[3]
    z = rows.select(s.alias("s"), p.alias("p"))
    return rounded(z.groupBy(K.autonomic_mode(F.col("s"), F.col("p")).alias("mode")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("p") - F.col("s")).alias("balance"), F.avg(F.col("p") + F.col("s")).alias("regulation")))
