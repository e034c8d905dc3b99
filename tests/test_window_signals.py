"""Signals of windows from one sweep against the plain definition."""

import random

import numpy as np
import pytest

from pulsegrid.operators import shape


@pytest.mark.parametrize("blocks", [1, 8, 500])
def test_signals_equal_plain_interpolation(spark, monkeypatch, blocks):
    monkeypatch.setattr(shape, "BLOCK_WINDOWS", blocks)
    r = random.Random(9)
    rows, anchors = [], []
    for session in ("a", None):
        t = -3.0
        for i in range(260):
            t += r.choice([0.0, 0.25, 0.5, 1.0, 4.0])
            rows.append((session, t, i, r.choice([None, r.gauss(0, 5)]), float(i % 7)))
        anchors += [(session, n, r.uniform(-5, 300)) for n in range(90)]
    anchors += [("a", 900, None), ("none", 901, 5.0), ("a", 902, rows[40][1])]
    stream = spark.createDataFrame([*rows, ("a", None, 999, 1.0, 1.0)], "session string, sample_offset_s double, sample_index long, x double, y double")
    marks = spark.createDataFrame(anchors, "session string, n long, window_end_s double")
    got = {(g["session"], g["n"], g["sensor"]): g for g in shape.window_signals(marks, stream, ["session"], ["x", "y"], 8.0, 2.0, "n").collect()}
    seen = 0
    for session, n, end in anchors:
        inside = [] if end is None else [s for s in rows if s[0] == session and end - 8.0 < s[1] <= end]
        for sensor, place in (("x", 3), ("y", 4)):
            if not inside:
                assert (session, n, sensor) not in got
                continue
            g, v = got[session, n, sensor], [(s[1], s[place]) for s in inside if s[place] is not None]
            assert (g["source_rows"], g["valid_count"], g["window_end_s"]) == (len(inside), len(v), end)
            assert g["last"] == (v[-1][1] if v else None) and (not v or g["mean"] == pytest.approx(np.mean([b for _, b in v])) and g["std"] == pytest.approx(np.std([b for _, b in v]), abs=1e-9))
            times, first = np.unique([a for a, _ in v], return_index=True)
            if len(times) >= 4 and times[-1] - times[0] >= 1.0:
                seen += 1
                assert g["grid"] == pytest.approx(np.interp(end - 8.0 + np.arange(17) / 2.0, times, np.array([b for _, b in v])[first]))
            else:
                assert g["grid"] is None
    assert seen > 150 and shape.window_signals(marks.limit(0), stream, ["session"], ["x"], 8.0, 2.0, "n").count() == 0


def test_summary_equals_the_long_table_and_signals_the_column_features(spark):
    from pyspark.sql import functions as F

    from pulsegrid.functions import arrays

    r = random.Random(4)
    rows = [("s", i * 0.5, i, r.choice([None, r.gauss(0, 5)]), 3.0 if i < 90 else float(i % 7)) for i in range(200)]
    stream = spark.createDataFrame(rows, "session string, sample_offset_s double, sample_index long, hr double, eda double")
    marks = spark.createDataFrame([("s", n, 10.0 + n) for n in range(80)], "session string, n long, window_end_s double")
    args = (marks, stream, ["session"], ["hr", "eda"], 12.0, 1.0, "n")
    want = shape.shape_long(*args).groupBy("feature").agg(F.count("*").alias("windows"), F.avg("value").alias("mean_value")).collect()
    got = {g["feature"]: g for g in shape.shape_summary(*args).collect()}
    assert len(got) == len(want) > 100
    for w in want:
        assert got[w["feature"]]["windows"] == w["windows"] and got[w["feature"]]["mean_value"] == pytest.approx(w["mean_value"], rel=1e-9, abs=1e-12)
    grids = shape.window_signals(*args).where("grid IS NOT NULL").select("n", "sensor", "grid")
    plain = {(g["n"], g["sensor"]): g for g in arrays.shape_features(grids, "grid", 1.0).drop("__z").collect()}
    described = shape.describe_signals(grids, "grid", 1.0).collect()
    assert len(described) == len(plain) > 100
    for g in described:
        for c, x in plain[g["n"], g["sensor"]].asDict().items():
            assert g[c] == x or g[c] == pytest.approx(x, rel=1e-9, abs=1e-9), c
