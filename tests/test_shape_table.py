"""The table of shape features: every window, sensor and pair, against the plain definition and the long form."""

import math
import random

import numpy as np
import pytest

from pulsegrid.operators import shape
from pulsegrid.schema import COUPLING_PAIRS, SHAPE_SENSORS

HZ, SECONDS = 2.0, 10.0


def plain_signal(x):
    """Features of one signal that need neither a wavelet nor a draw."""
    med = np.median(x)
    mad = np.median(np.abs(x - med))
    scale = mad * 1.4826 if mad * 1.4826 >= 1e-9 else np.std(x) if np.std(x) >= 1e-9 else 1.0
    z, n = (x - med) / scale, len(x)
    d, half, above = np.diff(z), n // 2, z > 0
    out = {"median": med, "mad": mad, "iqr": np.quantile(x, 0.75) - np.quantile(x, 0.25), "rms_z": np.sqrt(np.mean(z * z)), "late_minus_early_z": z[half:].mean() - z[:half].mean(),
           "last_minus_first_z": z[-1] - z[0], "max_time_fraction": np.argmax(z) / (n - 1), "min_time_fraction": np.argmin(z) / (n - 1), "mean_abs_diff_z": np.abs(d).mean(),
           "std_diff_z": d.std(), "max_abs_diff_z": np.abs(d).max(), "second_diff_energy": np.mean(np.diff(d) ** 2), "median_crossings": np.count_nonzero(np.diff(above))}
    out |= {f"q{q}": np.quantile(x, q / 100) for q in (10, 25, 75, 90)}
    out |= {f"longest_{name}_median_frac": max(map(len, "".join("x" if f else " " for f in flags).split()), default=0) / n for name, flags in (("above", above), ("below", ~above))}
    for name, seconds in (("025s", 0.25), ("05s", 0.5), ("1s", 1.0), ("2s", 2.0)):
        lag = max(round(seconds * HZ), 1)
        flat = min(z[:-lag].std(), z[lag:].std()) < 1e-12
        out[f"autocorr_{name}"] = None if flat else np.corrcoef(z[:-lag], z[lag:])[0, 1]
    power, freq = np.abs(np.fft.rfft(z - z.mean())) ** 2, np.fft.rfftfreq(n, 1 / HZ)
    p = power[1:] / power[1:].sum() if power[1:].sum() > 0 else None
    out["dominant_frequency"] = None if p is None else freq[1:][np.argmax(p)]
    out["spectral_centroid"] = None if p is None else np.sum(freq[1:] * p)
    out["high_band_power"] = None if p is None else p[freq[1:] >= 0.5].sum()
    return out


def plain_coupling(x, y):
    if min(x.std(), y.std()) < 1e-12:
        return dict.fromkeys(("correlation", "max_abs_lagged_correlation", "lag_at_max_correlation_s"))
    found = []
    for lag in range(-4, 5):
        a, b = (x[-lag:], y[:lag]) if lag < 0 else (x[: len(x) - lag], y[lag:])
        if a.std() > 0 and b.std() > 0:
            found.append((np.corrcoef(a, b)[0, 1], lag))
    best = max(found, key=lambda f: abs(f[0]))
    return {"correlation": np.corrcoef(x, y)[0, 1], "max_abs_lagged_correlation": best[0], "lag_at_max_correlation_s": best[1] / HZ}


@pytest.fixture(scope="module")
def data():
    r = random.Random(11)
    rows, marks = [], []
    for session in ("a", None):
        t = 0.0
        for i in range(220):
            t += r.choice([0.0, 0.25, 0.5, 1.0])
            odd = r.choice([None, float("nan"), float("inf"), -float("inf")])
            rows.append((session, t, i, *[odd if r.random() < 0.15 else r.gauss(j, 3) if s != "emg" else 5.0 for j, s in enumerate(SHAPE_SENSORS)]))
        marks += [(session, n, 10.0 + 1.3 * n) for n in range(70)]
    return rows, [*marks, ("a", 900, None), ("none", 901, 5.0)]


@pytest.fixture
def args(spark, data):
    stream = spark.createDataFrame(data[0], "session string, sample_offset_s double, sample_index long, " + ", ".join(f"{s} double" for s in SHAPE_SENSORS))
    return spark.createDataFrame(data[1], "session string, n long, window_end_s double"), stream, ["session"], SHAPE_SENSORS, SECONDS, HZ, "n"


def near(got, want):
    if want is None or got is None:
        return got is None and want is None
    return got == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_every_window_has_the_features_of_all_sensors_and_pairs(args, data):
    rows, marks = data
    got = {(g["session"], g["n"]): g for g in shape.shape_table(*args).collect()}
    names = [*SHAPE_SENSORS, "acc_mag"]
    assert len(shape.feature_names()) == 1477 and [f for f in shape.shape_table(*args).columns] == ["session", "n", "window_end_s", "source_rows", *shape.feature_names()]
    gridded = 0
    for session, n, end in marks:
        inside = [s for s in rows if end is not None and s[0] == session and end - SECONDS < s[1] <= end]
        if not inside:
            assert (session, n) not in got
            continue
        g, grids = got[session, n], {}
        assert g["source_rows"] == len(inside) and g["window_end_s"] == end
        for i, sensor in enumerate(names):
            def value(s, i=i):
                v = [s[3 + names.index(a)] for a in ("acc_x", "acc_y", "acc_z")] if i == len(SHAPE_SENSORS) else [s[3 + i]]
                if any(x is None or not math.isfinite(x) for x in v):
                    return None
                return math.sqrt(sum(x * x for x in v)) if len(v) > 1 else v[0]

            own = [(s[1], value(s)) for s in inside if value(s) is not None]
            v = np.array([x for _, x in own])
            want = {"quality__valid_count": len(own), "quality__valid_frac": len(own) / len(inside)}
            want |= {f"base__{k}": f(v) if len(v) else None for k, f in (("mean", np.mean), ("std", np.std), ("min", np.min), ("max", np.max), ("last", lambda x: x[-1]))}
            times, first = np.unique([t for t, _ in own], return_index=True)
            if len(times) >= 4 and times[-1] - times[0] >= 1.0:
                grids[sensor] = grid = np.interp(end - SECONDS + np.arange(21) / HZ, times, v[first])
                if sensor == "emg":
                    assert g["emg__shape__dominant_frequency"] is None and g["emg__shape__median"] == 5.0
                for variant, signal in (("shape", grid), ("reverse", grid[::-1])) if sensor != "emg" else ():
                    want |= {f"{variant}__{k}": x for k, x in plain_signal(signal).items()}
                assert sensor == "emg" or near(g[f"{sensor}__shuffle__median"], np.median(grid)) and near(g[f"{sensor}__shuffle__mad"], g[f"{sensor}__shape__mad"])
            else:
                want |= {f"{variant}__{k}": None for variant in shape.VARIANTS for k in ("median", "autocorr_1s", "wavelet_energy_0")}
            for k, x in want.items():
                assert near(g[f"{sensor}__{k}"], x), (session, n, sensor, k, g[f"{sensor}__{k}"], x)
        gridded += len(grids)
        for a, b in COUPLING_PAIRS:
            want = plain_coupling(grids[a], grids[b]) if a in grids and b in grids else dict.fromkeys(shape.KE.COUPLING_FIELDS)
            assert all(near(g[f"{a}_x_{b}__coupling__{k}"], x) for k, x in want.items()), (session, n, a, b)
    assert gridded > 1000


@pytest.mark.parametrize("windows", [7, 1_000])
def test_table_equals_the_long_form(args, monkeypatch, windows):
    """Draws of the shuffles and wavelets included; in parts of any number of windows."""
    monkeypatch.setattr(shape, "TABLE_WINDOWS", windows)
    names = shape.feature_names()
    want = {(g["session"], g["n"]): g for g in shape.shape_wide(shape.shape_long(*args), ["session", "n"], names).collect()}
    got = shape.shape_table(*args).collect()
    assert len(got) == len(want) > 100
    for g in got:
        w = want[g["session"], g["n"]]
        assert all(near(g[c], w[c]) for c in names), [(c, g[c], w[c]) for c in names if not near(g[c], w[c])][:5]


def test_summary_counts_windows_with_odd_samples(args):
    """A NaN or infinite sample is missing; it does not take the features of its windows away."""
    got = {g["feature"]: g["windows"] for g in shape.shape_summary(*args).collect()}
    table = shape.shape_table(*args).toPandas()
    counts = table[shape.feature_names()].count()
    assert {f: n for f, n in got.items()} == {f: n for f, n in counts.items() if n} and got["acc_mag__shape__median"] > 50


def test_no_anchor_gives_no_row(args):
    marks, *rest = args
    assert shape.shape_table(marks.limit(0), *rest).count() == 0


def test_query_gives_a_row_per_window(spark):
    """All channels of the events, the axes and their magnitude: the summary's 663 rows had no window and no axis."""
    from pulsegrid.plans import catalog

    sf = "/root/testdata/sf0.001"
    table = catalog.QUERIES["shape_table"](spark, sf)
    grids = catalog.QUERIES["resample_linear"](spark, sf).select("session_id", "k").distinct().count()
    got = table.select("session_id", "k", "source_pain_covas_0_100__shape__median", "hr_x_acc_mag__coupling__correlation", "acc_mag__reverse__autocorr_1s").toPandas()
    assert len(got) == len(got[["session_id", "k"]].drop_duplicates()) >= grids == got["source_pain_covas_0_100__shape__median"].count() > 0
    assert got["hr_x_acc_mag__coupling__correlation"].count() > 0 and got["acc_mag__reverse__autocorr_1s"].count() > 0
