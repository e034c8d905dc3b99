"""Arrow kernels for what column expressions cannot state well: spectrum, wavelet, lag search, resampling.

Each is a small vectorised helper over one Arrow batch; grouping and distribution stay with Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

SPECTRAL_FIELDS = ("dominant_frequency", "spectral_centroid", "spectral_entropy", "low_band_power", "mid_band_power", "high_band_power")
WAVELET_FIELDS = tuple(f"wavelet_energy_{i}" for i in range(4))
COUPLING_FIELDS = ("correlation", "max_abs_lagged_correlation", "lag_at_max_correlation_s")
# Band edges in Hz; the four scaling taps of the Daubechies-2 wavelet.
BANDS = (0.0, 0.15, 0.5)
_R3 = math.sqrt(3.0)
DB2 = np.array([1 + _R3, 3 + _R3, 3 - _R3, 1 - _R3]) / (4.0 * math.sqrt(2.0))


def _schema(fields) -> str:
    return ", ".join(f"{f} double" for f in fields)


def _by_length(signals: pd.Series):
    """Rows of equal length as one matrix, so that each kernel runs once per length in the batch."""
    lengths = signals.map(lambda v: -1 if v is None else len(v))
    for n, idx in signals.groupby(lengths).groups.items():
        if n > 0:
            yield idx, np.stack(signals.loc[idx].to_list()).astype(float)


def spectrum_of(x: np.ndarray, hz: float) -> np.ndarray:
    """Spectrum descriptors of each row; all NaN for a flat one."""
    out = np.full((len(x), len(SPECTRAL_FIELDS)), np.nan)
    power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) ** 2
    power[:, 0] = 0.0
    freq = np.fft.rfftfreq(x.shape[1], d=1.0 / hz)
    total = power.sum(axis=1)
    ok = total > 0
    if ok.any():
        p = power[ok] / total[ok, None]
        used = p > 0
        entropy = -(p * np.log(np.where(used, p, 1.0))).sum(axis=1) / np.log(np.maximum(used.sum(axis=1), 2))
        edges = (*BANDS, hz / 2.0 + 1e-9)
        bands = [p[:, (freq >= a) & (freq < b)].sum(axis=1) for a, b in zip(edges, edges[1:])]
        out[ok] = np.column_stack([freq[p.argmax(axis=1)], p @ freq, entropy, *bands])
    return out


def spectral_features(hz: float):
    """Struct of spectrum descriptors of a signal column; all NULL for a flat signal."""

    @F.pandas_udf(_schema(SPECTRAL_FIELDS))
    def spectrum(signals: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=signals.index, columns=list(SPECTRAL_FIELDS))
        for idx, x in _by_length(signals):
            out.loc[idx, :] = spectrum_of(x, hz)
        return out

    return spectrum


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One analysis step with half-sample symmetric edges: (approximation, detail)."""
    n, taps = x.shape[1], len(DB2)
    padded = np.pad(x, ((0, 0), (taps - 1, taps)), mode="symmetric")
    count = (n + taps - 1) // 2
    at = 2 * np.arange(count)[:, None] + 1 + np.arange(taps)
    frames = padded[:, at]
    return frames @ DB2, frames @ (DB2[::-1] * np.array([1.0, -1.0, 1.0, -1.0]))


def wavelet_of(x: np.ndarray) -> np.ndarray:
    """Energy fractions of each row, coarse to fine, of a three-level (or shallower) decomposition."""
    out = np.full((len(x), len(WAVELET_FIELDS)), np.nan)
    levels = min(3, int(math.floor(math.log2(x.shape[1] / 3.0))) if x.shape[1] >= 3 else 0)
    if levels < 1:
        return out
    approx, energies = x, []
    for _ in range(levels):
        approx, detail = _split(approx)
        energies.append((detail**2).sum(axis=1))
    stacked = np.column_stack([(approx**2).sum(axis=1), *energies[::-1]])
    total = stacked.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        out[:, : levels + 1] = np.where(total > 0, stacked / total, np.nan)
    return out


def wavelet_features():
    """Struct of energy fractions, coarse to fine, of a three-level (or shallower) decomposition."""

    @F.pandas_udf(_schema(WAVELET_FIELDS))
    def wavelet(signals: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=signals.index, columns=list(WAVELET_FIELDS))
        for idx, x in _by_length(signals):
            out.loc[idx, :] = wavelet_of(x)
        return out

    return wavelet


#: Features of one signal, as `pulsegrid.functions.arrays.shape_features` states them for columns, then spectrum and wavelet.
SIGNAL_FIELDS = (
    "median", "mad", "q10", "q25", "q75", "q90", "iqr", "skew", "kurtosis", "rms_z", "late_minus_early_z", "last_minus_first_z", "max_time_fraction",
    "min_time_fraction", "mean_abs_diff_z", "std_diff_z", "max_abs_diff_z", "second_diff_energy", "median_crossings", "longest_above_median_frac",
    "longest_below_median_frac", "autocorr_025s", "autocorr_05s", "autocorr_1s", "autocorr_2s", *SPECTRAL_FIELDS, *WAVELET_FIELDS,
)


def described(x: np.ndarray, hz: float) -> dict[str, np.ndarray]:
    """All features (SIGNAL_FIELDS) of each row of a matrix of signals of at least 8 finite samples."""

    def quantile(ordered: np.ndarray, p: float) -> np.ndarray:
        pos = p * (ordered.shape[1] - 1)
        low, high = ordered[:, math.floor(pos)], ordered[:, math.ceil(pos)]
        return low + (high - low) * (pos - math.floor(pos))

    def longest(flags: np.ndarray) -> np.ndarray:
        run, best = np.zeros(len(flags)), np.zeros(len(flags))
        for column in flags.T:
            run = np.where(column, run + 1, 0)
            best = np.maximum(best, run)
        return best / flags.shape[1]

    def autocorrelation(z: np.ndarray, lag: int) -> np.ndarray:
        out, n = np.full(len(z), np.nan), z.shape[1] - lag
        if n > 0:
            a, b = z[:, :n] - z[:, :n].mean(axis=1, keepdims=True), z[:, lag:] - z[:, lag:].mean(axis=1, keepdims=True)
            xx, yy = (a * a).sum(axis=1), (b * b).sum(axis=1)
            ok = (np.sqrt(xx / n) >= 1e-12) & (np.sqrt(yy / n) >= 1e-12)
            out[ok] = (a * b).sum(axis=1)[ok] / np.sqrt(xx[ok] * yy[ok])
        return out

    n, ordered = x.shape[1], np.sort(x, axis=1)
    f = {"median": quantile(ordered, 0.5)}
    dev = np.abs(x - f["median"][:, None])
    f["mad"], std = quantile(np.sort(dev, axis=1), 0.5), x.std(axis=1)
    scale = np.where(f["mad"] * 1.4826 >= 1e-9, f["mad"] * 1.4826, np.where(std >= 1e-9, std, 1.0))
    z = (x - f["median"][:, None]) / scale[:, None]
    f |= {f"q{round(100 * p)}": quantile(ordered, p) for p in (0.1, 0.25, 0.75, 0.9)}
    c = z - z.mean(axis=1, keepdims=True)
    m2, m3, m4 = ((c**k).mean(axis=1) for k in (2, 3, 4))
    with np.errstate(invalid="ignore", divide="ignore"):
        skew = math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5
        kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3.0) + 6.0)
    half, d, above = max(n // 2, 1), np.diff(z, axis=1), z > 0
    f |= {
        "iqr": f["q75"] - f["q25"], "skew": np.where(m2 > 1e-300, skew, np.nan), "kurtosis": np.where(m2 > 1e-300, kurtosis, np.nan),
        "rms_z": np.sqrt((z * z).mean(axis=1)), "late_minus_early_z": z[:, half:].mean(axis=1) - z[:, :half].mean(axis=1),
        "last_minus_first_z": z[:, -1] - z[:, 0], "max_time_fraction": z.argmax(axis=1) / (n - 1), "min_time_fraction": z.argmin(axis=1) / (n - 1),
        "mean_abs_diff_z": np.abs(d).mean(axis=1), "std_diff_z": d.std(axis=1), "max_abs_diff_z": np.abs(d).max(axis=1),
        "second_diff_energy": (np.diff(d, axis=1) ** 2).mean(axis=1), "median_crossings": (above[:, 1:] != above[:, :-1]).sum(axis=1).astype(float),
        "longest_above_median_frac": longest(above), "longest_below_median_frac": longest(~above),
    }
    f |= {f"autocorr_{k}": autocorrelation(z, max(int(round(s * hz)), 1)) for k, s in (("025s", 0.25), ("05s", 0.5), ("1s", 1.0), ("2s", 2.0))}
    return f | dict(zip(SPECTRAL_FIELDS, spectrum_of(z, hz).T, strict=True)) | dict(zip(WAVELET_FIELDS, wavelet_of(z).T, strict=True))


def signal_features(hz: float):
    """Struct of all features of a signal of at least 8 finite samples; a batch of equal lengths is one matrix."""

    @F.pandas_udf(_schema(SIGNAL_FIELDS))
    def features(signals: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=signals.index, columns=list(SIGNAL_FIELDS))
        for idx, x in _by_length(signals):
            f = described(x, hz)
            out.loc[idx, :] = np.column_stack([f[c] for c in SIGNAL_FIELDS])
        return out

    return features


def coupled(x: np.ndarray, y: np.ndarray, hz: float) -> np.ndarray:
    """COUPLING_FIELDS of each pair of rows of two matrices of finite samples."""
    reach = max(int(round(2.0 * hz)), 1)

    def corr(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row-wise correlation of two matrices, with both row spreads."""
        dp, dq = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
        sp, sq = np.sqrt((dp * dp).mean(axis=1)), np.sqrt((dq * dq).mean(axis=1))
        with np.errstate(invalid="ignore", divide="ignore"):
            return (dp * dq).mean(axis=1) / (sp * sq), sp, sq

    out = np.full((len(x), 3), np.nan)
    n = x.shape[1]
    if n < 12:
        return out
    zero, sx, sy = corr(x, y)
    ok = (sx >= 1e-12) & (sy >= 1e-12)
    out[ok, 0] = zero[ok]
    best, at = np.full(len(x), np.nan), np.full(len(x), np.nan)
    for lag in range(-reach, reach + 1):
        if n - abs(lag) < 8:
            continue
        p, q = (x[:, -lag:], y[:, :lag]) if lag < 0 else (x[:, : n - lag], y[:, lag:])
        r, sp, sq = corr(p, q)
        # The first of equally strong lags is kept.
        win = ok & (sp > 0) & (sq > 0) & (np.isnan(best) | (np.abs(r) > np.abs(best)))
        best[win], at[win] = r[win], lag / hz
    out[:, 1], out[:, 2] = best, at
    return out


def coupling_features(hz: float):
    """Struct of zero-lag and strongest lagged correlation (within two seconds) of two signals."""

    @F.pandas_udf(_schema(COUPLING_FIELDS))
    def coupling(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        """Gap-free grids of equal length (the usual case) go through as one matrix per length."""
        rows = np.full((len(left), 3), np.nan)
        groups: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(left, right)):
            if a is not None and b is not None and len(a) == len(b):
                groups.setdefault(len(a), []).append(i)
        for members in groups.values():
            x = np.stack([left.iloc[i] for i in members]).astype(float)
            y = np.stack([right.iloc[i] for i in members]).astype(float)
            whole = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
            at = np.array(members)
            rows[at[whole]] = coupled(x[whole], y[whole], hz)
            for i in np.flatnonzero(~whole):
                ok = np.isfinite(x[i]) & np.isfinite(y[i])
                rows[at[i]] = coupled(x[i][ok][None, :], y[i][ok][None, :], hz)[0]
        return pd.DataFrame(rows, columns=list(COUPLING_FIELDS))

    return coupling


def resample(hz: float):
    """Linear resampling of (times, values) onto start, start + 1/hz, ..., end with held edges.

    NULL unless there are at least 4 samples at 4 distinct times spanning one second and 8 grid points.
    """

    @F.pandas_udf("array<double>")
    def to_grid(times: pd.Series, values: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for t, v, a, b in zip(times, values, start, end):
            grid = None
            if t is not None and len(t) >= 4:
                ux, first = np.unique(np.asarray(t, float), return_index=True)
                if ux.size >= 4 and ux[-1] - ux[0] >= 1.0:
                    ticks = np.arange(a, b + 0.5 / hz, 1.0 / hz)
                    if ticks.size >= 8:
                        grid = np.interp(ticks, ux, np.asarray(v, float)[first])
            out.append(grid)
        return pd.Series(out, dtype=object)

    # Not to be evaluated a second time inside a pushed-down NULL filter.
    return to_grid.asNondeterministic()
