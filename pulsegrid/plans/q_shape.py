"""Temporal-shape queries over regular-grid signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import arrays as AR
from pulsegrid.functions import kernels as KE
from pulsegrid.operators import shape as SH
from pulsegrid.operators.windows import window_anchors
from pulsegrid.plans.q_windows import with_axes
from pulsegrid.plans.registry import query
from pulsegrid.plans.views import CHANNELS, SIGNAL_SQL, SPEC, STREAM_SQL, events_stream, rounded, signals

HZ = 4.0


def _shaped(spark, sf):
    return AR.shape_features(signals(spark, sf), "x", HZ)


@query("array_robust_z", f"WITH {SIGNAL_SQL} SELECT signal_id, CAST(i AS INTEGER) AS i, round(z, 6) + 0.0 AS z FROM z")
def array_robust_z(spark, sf):
    return rounded(AR.robust_z(signals(spark, sf), "x").select("signal_id", F.posexplode_outer("__z").alias("i", "z")))


@query(
    "shape_quantiles",
    f"""WITH {SIGNAL_SQL} SELECT signal_id, round(quantile_cont(v, 0.1), 6) + 0.0 AS q10, round(quantile_cont(v, 0.25), 6) + 0.0 AS q25, round(quantile_cont(v, 0.75), 6) + 0.0 AS q75,
      round(quantile_cont(v, 0.9), 6) + 0.0 AS q90, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(any_value(med), 6) + 0.0 AS median,
      round(any_value(mad), 6) AS mad FROM pt JOIN st USING (signal_id) GROUP BY signal_id""",
)
def shape_quantiles(spark, sf):
    return rounded(_shaped(spark, sf).select("signal_id", "q10", "q25", "q75", "q90", "iqr", "median", "mad"))


@query("shape_moments", f"WITH {SIGNAL_SQL} SELECT signal_id, round(skewness(z), 6) + 0.0 AS skew, round(kurtosis(z), 6) + 0.0 AS kurtosis, round(sqrt(avg(z * z)), 6) AS rms_z FROM z GROUP BY signal_id")
def shape_moments(spark, sf):
    return rounded(_shaped(spark, sf).select("signal_id", "skew", "kurtosis", "rms_z"))


TREND_SQL = """SELECT signal_id, round(avg(z) FILTER (WHERE i >= n // 2) - avg(z) FILTER (WHERE i < n // 2), 6) + 0.0 AS late_minus_early_z,
  round(max(z) FILTER (WHERE i = n - 1) - max(z) FILTER (WHERE i = 0), 6) + 0.0 AS last_minus_first_z,
  round(arg_max(i, z) / (any_value(n) - 1.0), 6) AS max_time_fraction, round(arg_min(i, z) / (any_value(n) - 1.0), 6) AS min_time_fraction"""


@query("shape_trend", f"WITH {SIGNAL_SQL} {TREND_SQL} FROM z GROUP BY signal_id")
def shape_trend(spark, sf):
    return rounded(_shaped(spark, sf).select("signal_id", "late_minus_early_z", "last_minus_first_z", "max_time_fraction", "min_time_fraction"))


@query(
    "shape_diff",
    f"""WITH {SIGNAL_SQL}, d AS (SELECT signal_id, i, z - lag(z) OVER w AS d1, z - 2 * lag(z) OVER w + lag(z, 2) OVER w AS d2 FROM z WINDOW w AS (PARTITION BY signal_id ORDER BY i))
    SELECT signal_id, round(avg(abs(d1)), 6) AS mean_abs_diff_z, round(stddev_pop(d1), 6) AS std_diff_z, round(max(abs(d1)), 6) AS max_abs_diff_z, round(avg(d2 * d2), 6) AS second_diff_energy FROM d GROUP BY signal_id""",
)
def shape_diff(spark, sf):
    return rounded(_shaped(spark, sf).select("signal_id", "mean_abs_diff_z", "std_diff_z", "max_abs_diff_z", "second_diff_energy"))


@query(
    "longest_run",
    f"""WITH {SIGNAL_SQL}, f AS (SELECT signal_id, i, n, z > 0 AS a, CASE WHEN (z > 0) <> lag(z > 0) OVER (PARTITION BY signal_id ORDER BY i) THEN 1 ELSE 0 END AS flip FROM z),
    g AS (SELECT *, sum(flip) OVER (PARTITION BY signal_id ORDER BY i) AS run FROM f), r AS (SELECT signal_id, a, run, count(*) AS len, any_value(n) AS n FROM g GROUP BY ALL)
    SELECT signal_id, CAST(max(run) AS DOUBLE) AS median_crossings, round(coalesce(max(len) FILTER (WHERE a), 0) / CAST(any_value(n) AS DOUBLE), 6) AS longest_above_median_frac,
      round(coalesce(max(len) FILTER (WHERE NOT a), 0) / CAST(any_value(n) AS DOUBLE), 6) AS longest_below_median_frac FROM r GROUP BY signal_id""",
)
def longest_run(spark, sf):
    return rounded(_shaped(spark, sf).select("signal_id", "median_crossings", "longest_above_median_frac", "longest_below_median_frac"))


@query(
    "autocorr",
    f"""WITH {SIGNAL_SQL}, l AS (SELECT signal_id, z, lead(z, 1) OVER w AS z1, lead(z, 2) OVER w AS z2, lead(z, 4) OVER w AS z4, lead(z, 8) OVER w AS z8 FROM z WINDOW w AS (PARTITION BY signal_id ORDER BY i))
    SELECT signal_id, round(corr(z, z1), 6) + 0.0 AS autocorr_025s, round(corr(z, z2), 6) + 0.0 AS autocorr_05s, round(corr(z, z4), 6) + 0.0 AS autocorr_1s, round(corr(z, z8), 6) + 0.0 AS autocorr_2s FROM l GROUP BY signal_id""",
)
def autocorr(spark, sf):
    return rounded(_shaped(spark, sf).select("signal_id", *[f"autocorr_{n}" for n in ("025s", "05s", "1s", "2s")]))


SPECTRUM_SQL = f"""{SIGNAL_SQL}, zm AS (SELECT signal_id, i, n, z - avg(z) OVER (PARTITION BY signal_id) AS c FROM z),
dft AS (SELECT signal_id, f, any_value(n) AS n, sum(c * cos(2 * pi() * f * i / n)) AS re, sum(c * sin(2 * pi() * f * i / n)) AS im FROM zm, range(1, 33) t(f) GROUP BY ALL),
pw AS (SELECT signal_id, f * 4.0 / n AS hz, re * re + im * im AS p, (re * re + im * im) / sum(re * re + im * im) OVER (PARTITION BY signal_id) AS q FROM dft)"""


@query(
    "spectral_features",
    f"""WITH {SPECTRUM_SQL} SELECT signal_id, round(arg_max(hz, p), 6) AS dominant_frequency, round(sum(hz * q), 6) AS spectral_centroid, round(-sum(q * ln(q)) / ln(count(*)), 6) AS spectral_entropy,
      round(coalesce(sum(q) FILTER (WHERE hz < 0.15), 0), 6) AS low_band_power, round(sum(q) FILTER (WHERE hz >= 0.15 AND hz < 0.5), 6) AS mid_band_power, round(sum(q) FILTER (WHERE hz >= 0.5), 6) AS high_band_power
    FROM pw GROUP BY signal_id""",
)
def spectral_features(spark, sf):
    z = AR.robust_z(signals(spark, sf), "x").select("signal_id", KE.spectral_features(HZ)("__z").alias("s"))
    return rounded(z.select("signal_id", "s.*"))


_LO, _HI = list(KE.DB2), [KE.DB2[3], -KE.DB2[2], KE.DB2[1], -KE.DB2[0]]


def _dwt_sql(src: str, name: str) -> str:
    """One analysis step in SQL: taps t = 0..3 over reflected positions."""
    refl = "CASE WHEN m < 0 THEN -1 - m WHEN m >= n THEN 2 * n - 1 - m ELSE m END"
    taps_lo, taps_hi = [float(v) for v in _LO], [float(v) for v in _HI]
    return f"""{name}_i AS (SELECT s.signal_id, s.n, k, tap, 2 * k - 2 + tap AS m FROM (SELECT signal_id, count(*) AS n FROM {src} GROUP BY ALL) s, range(0, 40) r(k), range(0, 4) t(tap) WHERE k < (n + 3) // 2),
{name}_r AS (SELECT signal_id, k, tap, {refl} AS i FROM {name}_i),
{name} AS (SELECT r.signal_id, k AS i, sum(x.v * ({taps_lo!r})[tap + 1]) AS v, sum(x.v * ({taps_hi!r})[tap + 1]) AS d FROM {name}_r r JOIN {src} x ON x.signal_id = r.signal_id AND x.i = r.i GROUP BY ALL)"""


@query(
    "wavelet_energy",
    f"""WITH {SIGNAL_SQL}, l0 AS (SELECT signal_id, i, z AS v FROM z), {_dwt_sql('l0', 'l1')}, {_dwt_sql('l1', 'l2')}, {_dwt_sql('l2', 'l3')},
    e AS (SELECT signal_id, e3a, e3d, e2, e1, e3a + e3d + e2 + e1 AS tot FROM (SELECT signal_id, sum(v * v) AS e3a, sum(d * d) AS e3d FROM l3 GROUP BY ALL)
      JOIN (SELECT signal_id, sum(d * d) AS e2 FROM l2 GROUP BY ALL) USING (signal_id) JOIN (SELECT signal_id, sum(d * d) AS e1 FROM l1 GROUP BY ALL) USING (signal_id))
    SELECT signal_id, round(e3a / tot, 6) AS wavelet_energy_0, round(e3d / tot, 6) AS wavelet_energy_1, round(e2 / tot, 6) AS wavelet_energy_2, round(e1 / tot, 6) AS wavelet_energy_3 FROM e""",
)
def wavelet_energy(spark, sf):
    z = AR.robust_z(signals(spark, sf), "x").select("signal_id", KE.wavelet_features()("__z").alias("w"))
    return rounded(z.select("signal_id", "w.*"))


@query(
    "cross_corr_lag",
    f"""WITH {SIGNAL_SQL}, a AS (SELECT signal_id, i, v FROM pt WHERE i < 32), b AS (SELECT signal_id, i - 32 AS i, v FROM pt WHERE i >= 32),
    c AS (SELECT a.signal_id, lag, corr(a.v, b.v) AS r FROM a, range(-8, 9) t(lag), b WHERE b.signal_id = a.signal_id AND b.i = a.i + lag GROUP BY ALL)
    SELECT signal_id, round(max(r) FILTER (WHERE lag = 0), 6) + 0.0 AS correlation, round(first(r ORDER BY abs(r) DESC, lag), 6) + 0.0 AS max_abs_lagged_correlation,
      round(first(lag ORDER BY abs(r) DESC, lag) / 4.0, 6) + 0.0 AS lag_at_max_correlation_s FROM c GROUP BY signal_id""",
)
def cross_corr_lag(spark, sf):
    s = signals(spark, sf).select("signal_id", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))
    return rounded(s.select("signal_id", KE.coupling_features(HZ)("a", "b").alias("c")).select("signal_id", "c.*"))


@query("reverse_control", f"WITH {SIGNAL_SQL}, zr AS (SELECT signal_id, n, n - 1 - i AS i, z FROM z) {TREND_SQL} FROM zr GROUP BY signal_id")
def reverse_control(spark, sf):
    v = SH.with_variants(signals(spark, sf).select("signal_id", "x"), "x", 7, ["signal_id"]).where("variant = 'reverse'")
    return rounded(AR.shape_features(v, "x", HZ).select("signal_id", "late_minus_early_z", "last_minus_first_z", "max_time_fraction", "min_time_fraction"))


@query(
    "shuffle_control",
    f"WITH {SIGNAL_SQL} SELECT signal_id, round(any_value(med), 6) + 0.0 AS median, round(any_value(mad), 6) AS mad, round(skewness(v), 6) + 0.0 AS skew FROM pt JOIN st USING (signal_id) GROUP BY signal_id",
)
def shuffle_control(spark, sf):
    """A shuffle keeps every order-free feature: those must equal the ones of the true order."""
    v = SH.with_variants(signals(spark, sf).select("signal_id", "x"), "x", 7, ["signal_id"]).where("variant = 'shuffle'")
    return rounded(AR.shape_features(v, "x", HZ).select("signal_id", "median", "mad", "skew"))


@query(
    "mean_shift",
    f"""WITH {SIGNAL_SQL}, c AS (SELECT signal_id, i, n, sum(v) OVER (PARTITION BY signal_id ORDER BY i) AS run, sum(v) OVER (PARTITION BY signal_id) AS tot FROM pt)
    SELECT signal_id, round(max(abs((tot - run) / (n - i - 1) - run / (i + 1))), 6) AS largest_mean_shift FROM c WHERE i < n - 1 GROUP BY signal_id""",
)
def mean_shift(spark, sf):
    return rounded(signals(spark, sf).select("signal_id", AR.largest_mean_shift(F.col("x")).alias("largest_mean_shift")))


ANCHORED_SQL = f"""{STREAM_SQL}, bounds AS (SELECT session_id, min(t) AS t_min, max(t) AS t_max FROM stream GROUP BY ALL),
an AS (SELECT session_id, k, t_min + 12.0 + k AS w_end FROM (SELECT session_id, t_min, unnest(generate_series(0, CAST(floor(t_max - (t_min + 12.0)) AS BIGINT))) AS k FROM bounds WHERE t_min + 12.0 <= t_max))"""


def _anchored(spark, sf, sensors):
    s = events_stream(spark, sf)
    anchors = window_anchors(s, SPEC, ["session_id"])
    return anchors, s


@query(
    "resample_linear",
    f"""WITH {ANCHORED_SQL}, m AS (SELECT an.session_id, k, w_end, count(*) AS c, max(t) - min(t) AS span, min(t) AS lo, max(t) AS hi FROM an JOIN stream s ON s.session_id = an.session_id
      AND s.t > w_end - 12.0 AND s.t <= w_end GROUP BY ALL HAVING count(*) >= 4 AND max(t) - min(t) >= 1.0),
    g AS (SELECT session_id, k, w_end, lo, hi, unnest(range(13)) AS i FROM m), gt AS (SELECT *, w_end - 12.0 + i AS gt, greatest(lo, least(hi, w_end - 12.0 + i)) AS ct FROM g),
    p AS (SELECT gt.*, s.t AS pt, s.covas AS pv FROM gt ASOF JOIN stream s ON s.session_id = gt.session_id AND gt.ct >= s.t),
    q AS (SELECT p.*, s.t AS nt, s.covas AS nv FROM p ASOF JOIN stream s ON s.session_id = p.session_id AND p.ct <= s.t)
    SELECT session_id, k, CAST(i AS INTEGER) AS i, round(CASE WHEN nt > pt THEN pv + (nv - pv) * (ct - pt) / (nt - pt) ELSE pv END, 6) AS value FROM q""",
)
def resample_linear(spark, sf):
    anchors, s = _anchored(spark, sf, None)
    g = SH.window_signals(anchors, s, ["session_id"], ["source_pain_covas_0_100"], 12.0, 1.0, "k").where("grid IS NOT NULL")
    return rounded(g.select("session_id", "k", F.posexplode_outer("grid").alias("i", "value")))


@query("shape_table")
def shape_table(spark, sf):
    """The whole assembler, a row per tick of every session: quality, base, shape, controls and coupling of every channel the events give."""
    s = with_axes(spark, sf)
    sensors = [*CHANNELS, "source_pain_covas_0_100", "acc_x", "acc_y", "acc_z"]
    return SH.shape_table(window_anchors(s, SPEC, ["session_id"]), s, ["session_id"], sensors, 12.0, 1.0, "k", digits=6)
