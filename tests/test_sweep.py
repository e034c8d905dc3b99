"""Range statistics from pane states against plain loops, and windows of several lengths against single ones."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import sweep
from pulsegrid.operators.windows import WindowSpec, multiscale, window_features


def ranges(n, count, random):
    lo = random.integers(0, n + 1, count)
    return lo, np.minimum(n, lo + random.integers(0, 40, count))


def test_moments_medians_and_counts_equal_loops(monkeypatch):
    monkeypatch.setattr(sweep, "EXPANDED", 37)  # many pieces
    random = np.random.default_rng(2)
    v, t = random.normal(size=300) * 1e3, np.cumsum(random.random(300)) + 1e6
    lo, hi = ranges(300, 500, random)
    m, med = sweep.moments(v, t, lo, hi), sweep.medians(v, lo, hi)
    limit = random.normal(size=500) * 500
    above, most, total = sweep.count_above(v, lo, hi, limit), sweep.reduced(v, lo, hi, np.maximum, -np.inf), sweep.reduced(v, lo, hi, np.add, 0.0)
    for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
        own, at = v[a:b], t[a:b]
        assert m["n"][i] == len(own) and above[i] == (own > limit[i]).sum() and total[i] == pytest.approx(own.sum(), abs=1e-6)
        if len(own):
            assert (m["min"][i], m["max"][i], most[i]) == (own.min(), own.max(), own.max()) and med[i] == pytest.approx(np.median(own))
            assert m["mean"][i] == pytest.approx(own.mean()) and m["m2"][i] == pytest.approx(((own - own.mean()) ** 2).sum(), rel=1e-9, abs=1e-6)
            assert m["vt"][i] == pytest.approx(((own - own.mean()) * (at - at.mean())).sum(), rel=1e-6, abs=1e-5)
        else:
            assert np.isnan(med[i]) and most[i] == -np.inf


def test_a_constant_range_beside_an_outlier_has_no_spread():
    v = np.array([0.1] * 20 + [1e12] + [0.3] * 20)
    m = sweep.moments(v, np.arange(41.0), np.array([0, 21, 0]), np.array([20, 41, 41]))
    assert m["m2"][0] == 0.0 and m["m2"][1] == 0.0 and m["mean"][0] == 0.1 and m["m2"][2] > 1e20
    assert (sweep.moments(v[:0], v[:0], np.zeros(2, int), np.zeros(2, int))["n"] == 0).all()


def samples(spark):
    random = np.random.default_rng(5)
    rows = []
    for session in ("a", "b", None):
        for i, t in enumerate(np.cumsum(random.choice([0.0, 0.25, 0.5, 1.0, 1.0, 7.0], 400))):
            x = float(random.normal())
            rows.append(("d", "s", session, i, float(t), None if i % 5 == 0 else x, float("nan") if i % 7 == 0 else x * x, "rest" if i % 3 else None, float(i % 11) if i % 2 else None))
    return spark.createDataFrame(rows, "dataset_id string, subject_id string, session_id string, sample_index long, sample_offset_s double, hr double, ibi double, condition string, pain_intensity double")


def table(df):
    kinds = dict(df.dtypes)
    shown = df.select(*[F.round(c, 7).alias(c) if kinds[c] == "double" else F.col(c) for c in sorted(df.columns)])
    return sorted((tuple(None if isinstance(x, float) and x != x else x for x in r) for r in shown.collect()), key=repr)


@pytest.mark.parametrize("partial", [False, True])
def test_lengths_swept_together_equal_each_alone(spark, partial):
    s, spec = samples(spark), WindowSpec(2.0, 20.0, partial, 2, 3.0, blocks_of_windows=2)
    both = multiscale(s, spec, (5.0, 20.0), all_blocks=False)
    for seconds in (5.0, 20.0):
        alone = window_features(s, WindowSpec(2.0, seconds, partial, 2, 3.0, blocks_of_windows=1000), all_blocks=False)
        assert table(both.where(F.col("window_s") == seconds).drop("window_s")) == table(alone) != []


def test_windows_equal_plain_loops(spark):
    s, spec = samples(spark), WindowSpec(1.0, 12.0, False, 2, 3.0)
    rows = [r.asDict() for r in s.collect()]
    got = {(r["session_id"], round(r["window_end_s"], 6)): r for r in window_features(s, spec, all_blocks=False, keep_gapped=True).collect()}
    seen = 0
    for session in ("a", "b", None):
        own = sorted((r for r in rows if r["session_id"] == session), key=lambda r: (r["sample_offset_s"], r["sample_index"]))
        t = np.array([r["sample_offset_s"] for r in own])
        for k in range(int(np.floor(t[-1] - t[0] - 12.0)) + 1):
            end = t[0] + 12.0 + k
            inside = [r for r in own if end - 12.0 < r["sample_offset_s"] <= end]
            if len(inside) < 2:
                assert (session, round(end, 6)) not in got
                continue
            seen += 1
            r, at = got[session, round(end, 6)], np.array([x["sample_offset_s"] for x in inside])
            gaps = np.diff(at)[np.diff(at) > 0]
            if len(gaps):
                assert r["window_allowed_gap_s"] == pytest.approx(max(3.0, 2 * np.median(gaps)))
                assert r["window_max_gap_s"] == pytest.approx(max(gaps.max(), at[0] - (end - 12.0), end - at[-1]))
            v = [x["hr"] for x in inside if x["hr"] is not None]
            assert r["hr__valid_count"] == len(v) and (not v or r["hr__last"] == v[-1])
            high = np.mean(v) + 0.25 * np.std(v) if v else 0
            assert r["hr__peak_count"] == sum(b > a and b >= c and b > high for a, b, c in zip(v, v[1:], v[2:], strict=False))
            beats = [x["ibi"] for x in inside if x["ibi"] == x["ibi"]]
            if len(beats) > 1:
                assert r["ibi__rmssd_ms"] == pytest.approx(np.sqrt(np.mean((np.diff(beats) * 1000) ** 2))) and r["ibi__sdnn_ms"] == pytest.approx(np.std(beats, ddof=1) * 1000)
            assert r["condition"] == next((x["condition"] for x in inside if x["condition"]), None)
            pain = [x["pain_intensity"] for x in inside if x["pain_intensity"] is not None]
            assert r["target_pain_count"] == len(pain) and (not pain or r["target_pain_nrs_0_10"] == pytest.approx(np.mean(pain)))
    assert seen == len(got) > 300


def test_memory_of_a_sweep_does_not_grow_with_its_blocks():
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import types as T

    from pulsegrid.operators.windows import SUMMARY_STATS, _Sweep

    double, long = T.DoubleType(), T.LongType()
    names = ["window_start_s", "window_end_s", "source_rows", "window_max_gap_s", "window_allowed_gap_s", "window_s", *[f"hr__{s}" for s in ("valid_count", *SUMMARY_STATS, "peak_count")]]
    fields = T.StructType([T.StructField("session_id", long), *[T.StructField(c, long if c.endswith(("rows", "count")) else double) for c in names]])
    kernel = _Sweep(WindowSpec(1.0, 12.0, True, 1, None), (12.0,), ("session_id",), (), (("hr", "hr"),), False, fields, True)

    def swept(cells):
        # Two samples at the ends of a block stand for nearly a hundred windows.
        t = np.tile([0.0, 95.0], cells)
        own = np.repeat(np.arange(cells), 2)
        same = {c: np.full(2 * cells, x) for c, x in (("t_min", 0.0), ("t_max", 95.0))}
        batch = pa.RecordBatch.from_pydict({"session_id": own, "block": np.zeros(2 * cells, np.int64), "__hash": own, "sample_offset_s": t, "hr": t, **same})
        tracemalloc.start()
        rows = sum(out.num_rows for out in kernel(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, peak

    (few, low), (many, high) = swept(400), swept(4000)
    assert many == 10 * few and few >= 400
    assert high < 2 * low


def test_samples_that_lie_in_many_files_meet_in_their_block(spark, tmp_path):
    samples(spark).repartition(7).write.parquet(str(tmp_path / "s"))  # small and written: the bounds are broadcast
    read, spec = spark.read.parquet(str(tmp_path / "s")), WindowSpec(1.0, 20.0, False, 2, 8.0)
    assert table(window_features(read, spec, all_blocks=False)) == table(window_features(samples(spark).coalesce(1), spec, all_blocks=False))


def test_a_sweep_reads_only_what_the_wanted_columns_need(spark):
    s, spec = samples(spark), WindowSpec(2.0, 20.0, False, 2, 8.0, blocks_of_windows=2)
    whole = window_features(s, spec)
    for names, unread in (
        (["session_id", "window_end_s", "condition"], ("hr", "ibi", "pain_intensity", "subject_id")),
        (["window_end_s", "source_rows", "hr__mean", "hr__valid_frac", "grip__present"], ("ibi", "pain_intensity", "condition")),
        (["window_end_s", "ibi__rmssd_ms", "ibi__peak_count", "target_pain_coverage"], ("hr", "condition")),
    ):
        some = window_features(s, spec, columns=names)
        assert some.columns == names and table(some) == table(whole.select(*names)) and some.count() > 300
        plan = some._jdf.queryExecution().optimizedPlan().toString()
        read = plan[plan.index("MapInArrow") :].splitlines()[1]  # the columns that go to Python
        assert "__hash" in read and not [c for c in unread if re.search(rf"\b{c}#", read)]
    both = multiscale(s, spec, (5.0, 20.0), columns=["window_s", "window_end_s", "hr__mean"])
    assert table(both) == table(multiscale(s, spec, (5.0, 20.0)).select("window_s", "window_end_s", "hr__mean"))
