"""Operators along a session's rows against plain loops, over block sizes from one row to all."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import series as S

KEYS, TIES = ["session"], ["i"]


def rows():
    r = random.Random(6)
    out = []
    for session in ("a", "b", None):
        t = 0.0
        for i in range(160):
            t += r.choice([0.0, 0.5, 1.0, 1.0, 9.0])
            out.append((session, i, t, r.choice([None, None, r.gauss(0, 1)]), r.choice([None, 0.8, 0.82, 0.85, 1.4, 3.0]), r.choice([True, True, True, False, None])))
    out += [("on", i, float(i), 1.0, 0.8, True) for i in range(40)] + [("off", 0, 0.0, None, None, None), ("on", 99, None, 5.0, None, False)]
    return out


def frame(spark):
    return spark.createDataFrame(rows(), "session string, i long, t double, hr double, ibi double, flag boolean")


def sessions(timed=True):
    out = {}
    for r in rows():
        if r[2] is not None or not timed:
            out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[2] is not None, r[2] or 0, r[1])) for k, v in out.items()}


@pytest.mark.parametrize("bucket", [0.7, 20.0, 1e6])
def test_only_short_gaps_are_filled(spark, bucket):
    got = {(r["session"], r["i"]): r for r in S.hydrate(frame(spark), KEYS, "t", TIES, {"hr": 2.0}, bucket).collect()}
    assert len(got) == len(rows()) and got["on", 99]["hr"] == 5.0
    for session, own in sessions().items():
        for at, r in enumerate(own):
            before = next((x for x in reversed(own[:at]) if x[3] is not None), None)
            after = next((x for x in own[at + 1 :] if x[3] is not None), None)
            want = r[3]
            if want is None and before and after and after[2] - before[2] <= 2.0:
                want = before[3] if after[2] == before[2] else before[3] + (after[3] - before[3]) * (r[2] - before[2]) / (after[2] - before[2])
            out = got[session, r[1]]
            assert out["hr__native"] == (r[3] is not None) and (out["hr"] is None) == (want is None) and (want is None or out["hr"] == pytest.approx(want))


@pytest.mark.parametrize("bucket", [0.7, 20.0, 1e6])
def test_runs_go_on_across_blocks(spark, bucket):
    flagged = S.sustained(S.run_lengths(frame(spark), KEYS, "t", TIES, F.col("flag"), bucket), KEYS, "t", TIES, F.col("flag"), 4, bucket)
    got = {(r["session"], r["i"]): (r["run"], r["sustained"]) for r in flagged.collect()}
    summary = {r["session"]: r for r in S.burst_summary(frame(spark), KEYS, "t", TIES, F.col("flag"), 3, bucket).collect()}
    for session, own in sessions(timed=False).items():
        run, runs, on = 0, [], []
        for r in own:
            run = run + 1 if r[5] else 0
            assert got[session, r[1]] == (run, run >= 4)
            runs.append(run)
            on.append(bool(r[5]))
        ends = [n for n, after in zip(runs, [*runs[1:], 0], strict=True) if n and after == 0]
        s = summary[session]
        assert (s["rows"], s["bursts"], s["burst_rows"], s["longest_run"]) == (len(own), sum(n >= 3 for n in ends), sum(n for n in ends if n >= 3), max(runs))
        assert s["transitions"] == sum(a != b for a, b in zip(on, on[1:], strict=False))
    assert got["on", 39] == (40, True)


@pytest.mark.parametrize("bucket", [0.7, 1e6])
def test_beat_gates_and_differences(spark, bucket):
    got = {r["session"]: r for r in S.beat_statistics(frame(spark), KEYS, "t", TIES, "ibi", bucket, min_beats=10, max_outliers=0.7).collect()}
    assert "off" not in got
    for session, own in sessions().items():
        beats = [r for r in own if r[4] is not None]
        if not beats:
            continue
        good, diffs, before = [], [], None
        for r in beats:
            if 0.3 <= r[4] <= 2.0:
                if before is None or abs(r[4] - before) <= 0.2 * before:
                    good.append(r[4])
                    if before is not None:
                        diffs.append((r[4] - before) * 1000)
                before = r[4]
        s, d = got[session], np.array(diffs)
        assert s["ibi_beat_count"] == len(beats) and s["ibi_outlier_frac"] == pytest.approx(1 - len(good) / len(beats))
        assert s["rmssd_ms"] == pytest.approx(np.sqrt(np.mean(d * d))) and s["sdnn_ms"] == pytest.approx(np.std(np.array(good) * 1000, ddof=1))
        assert (s["pnn20"], s["pnn50"]) == (pytest.approx(np.mean(np.abs(d) > 20)), pytest.approx(np.mean(np.abs(d) > 50)))
        assert s["poincare_sd1"] == pytest.approx(np.sqrt(np.var(d, ddof=1) / 2)) and s["median_ibi"] == pytest.approx(np.median(good))
        assert s["hrv_valid_for_rmssd"] == (len(good) >= 10 and s["ibi_outlier_frac"] <= 0.7) and (s["poincare_sd2"] is None) == (not s["hrv_valid_for_rmssd"])


def test_a_device_profile_leaves_out_what_it_lacks(spark):
    sensors = {"hr": ("hr",), "ibi": ("ibi",), "eda": ("flag",)}
    assert S.project_profile(frame(spark), "watch_core", sensors, ["session"]).columns == ["session", "hr", "ibi"]
    assert S.project_profile(frame(spark), "native_full", sensors, ["session"]).columns == ["session", "hr", "ibi", "flag"]
    assert S.hydrate(frame(spark).limit(0), KEYS, "t", TIES, {"hr": 1.0}, 5.0).count() == 0
