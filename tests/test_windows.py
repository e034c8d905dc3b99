import math

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.windows import WindowSpec, cap_sessions, multiscale, pane_summary, stable_window_table, window_anchors, window_features


def stream(spark, times, **cols):
    rows = []
    for i, t in enumerate(times):
        rows.append({"dataset_id": "rheumapain", "subject_id": "s1", "session_id": "s1_a", "sample_index": i, "sample_offset_s": float(t),
                     **{k: (v[i] if isinstance(v, list) else v) for k, v in cols.items()}})
    names = list(rows[0])
    types = {"sample_index": "long", "sample_offset_s": "double"}
    schema = ", ".join(f"{n} {types.get(n, 'string' if isinstance(next((r[n] for r in rows if r[n] is not None), 1.0), str) else 'double')}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_anchor_grid(spark):
    got = [r["window_end_s"] for r in window_anchors(stream(spark, range(35)), WindowSpec()).orderBy("k").collect()]
    assert got == [30.0, 31.0, 32.0, 33.0, 34.0]


def test_causal_half_open_window(spark):
    pain = [None] * 30 + [4.0, 5.0, None, None, 6.0]
    s = stream(spark, range(35), eda=[float(i) for i in range(35)], pain_intensity=pain, condition="rest")
    first = window_features(s, WindowSpec()).orderBy("window_end_s").first()
    assert (first["window_start_s"], first["window_end_s"], first["source_rows"], first["eda__max"]) == (0.0, 30.0, 30, 30.0)
    assert first["target_pain_nrs_0_10"] == 4.0 and first["target_pain_count"] == 1 and first["condition"] == "rest"
    assert first["grip__present"] == 0 and first["grip__mean"] is None and first["grip__valid_frac"] == 0.0


def test_gap_rule_with_partial_windows(spark):
    times = list(range(16)) + list(range(80, 96))
    s = stream(spark, times, eda=[float(t) for t in times])
    w = window_features(s, WindowSpec(window_seconds=10.0, include_partial_windows=True))
    after = w.where("window_end_s > 20").orderBy("window_end_s").collect()
    assert after[0]["window_end_s"] == 88.0
    assert max(r["window_max_gap_s"] for r in w.collect()) <= 2.0
    # The clipped first window never contains the first sample.
    assert w.orderBy("window_end_s").first()["source_rows"] == 2


def test_beat_intervals_peaks_and_last(spark):
    s = stream(spark, [0.0, 1.0, 2.0, 3.0, 4.0], ibi=[0.9, 0.80, 0.82, 0.78, 0.81], hr=[1.0, 5.0, 1.0, 7.0, None])
    r = window_features(s, WindowSpec(window_seconds=4.0)).first()
    d = [20.0, -40.0, 30.0]
    assert r["ibi__rmssd_ms"] == pytest.approx(math.sqrt(sum(x * x for x in d) / 3), abs=1e-6)
    assert r["ibi__sdnn_ms"] > 0 and r["hr__last"] == 7.0 and r["hr__peak_count"] == 0
    assert r["ibi__peak_count"] == 1


def test_block_split_equals_single_block(spark):
    n = 400
    s = stream(spark, [i * 0.5 for i in range(n)], eda=[math.sin(i / 5.0) * (i % 17) for i in range(n)])
    small = window_features(s, WindowSpec(window_seconds=10.0, blocks_of_windows=1), all_blocks=False)
    big = window_features(s, WindowSpec(window_seconds=10.0, blocks_of_windows=1000), all_blocks=False)
    assert small.count() == big.count() > 100
    cols = [c for c in small.columns]
    a = [tuple(r) for r in small.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in small.dtypes]).orderBy("window_end_s").collect()]
    b = [tuple(r) for r in big.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in big.dtypes]).orderBy("window_end_s").collect()]
    assert a == b and cols


def test_panes_match_windows(spark):
    s = stream(spark, [i / 8 for i in range(800)], eda=[float((i * 7) % 23) for i in range(800)])
    spec = WindowSpec(window_seconds=10.0)
    a = {r["window_end_s"]: r for r in window_features(s, spec, all_blocks=False).collect()}
    b = pane_summary(s, spec, "eda").collect()
    assert len(a) == len(b)
    for r in b:
        w = a[r["window_end_s"]]
        assert r["source_rows"] == w["source_rows"] and r["std"] == pytest.approx(w["eda__std"], abs=1e-9) and r["mean"] == pytest.approx(w["eda__mean"])


def test_acc_block_and_stillness(spark):
    s = stream(spark, range(12), acc_x=[0.0] * 12, acc_y=[1.0] * 6 + [1.5] * 6, acc_z=[0.0] * 12)
    r = window_features(s, WindowSpec(window_seconds=11.0)).first()
    assert r["acc__mag__max"] == 1.5 and r["acc__present"] == 1 and r["acc__stillness_frac"] == pytest.approx(0.9)


def test_spec_validation_and_table_order(spark):
    for bad in (WindowSpec(target_hz=0.5), WindowSpec(window_seconds=0), WindowSpec(min_window_rows=0), WindowSpec(max_gap_seconds=0.0)):
        with pytest.raises(ValueError):
            bad.check()
    s = stream(spark, range(35), eda=[1.0] * 35)
    t = stable_window_table(window_features(s, WindowSpec()))
    assert t.columns[:3] == ["dataset_id", "subject_id", "session_id"] and t.columns[12:] == sorted(t.columns[12:])
    assert dict(t.dtypes)["window_contiguous"] == "double" and dict(t.dtypes)["eda__present"] == "int"
    assert multiscale(s, WindowSpec(), (5, 10)).select("window_s").distinct().count() == 2
    assert cap_sessions(s, 1).count() == 35
