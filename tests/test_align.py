import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import align as A


@pytest.mark.parametrize("direction,tolerance", [("nearest", 0.4), ("nearest", None), ("backward", None), ("backward", 0.3), ("forward", None), ("forward", 0.5)])
@pytest.mark.parametrize("bucket", [1.0, 100.0])
def test_asof_matches_sorted_merge(spark, direction, tolerance, bucket):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"s": ["a"] * 60, "t": np.sort(np.round(rng.uniform(0, 20, 60), 1)), "lid": range(60)})
    right = pd.DataFrame({"s": ["a"] * 40, "t": np.sort(np.round(rng.uniform(0, 20, 40), 1)), "v": [float(i) for i in range(40)]})
    right["rid"] = range(40)
    got = A.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["s"], "t", ["v"], direction, tolerance, bucket, "rid").toPandas()
    want = pd.merge_asof(left, right[["s", "t", "v"]], on="t", by="s", direction=direction, tolerance=tolerance)
    got = got.sort_values("lid").reset_index(drop=True)
    at = {i: t for i, t in enumerate(right["t"])}
    for a, b, t in zip(got["v"], want["v"], left["t"]):
        if pd.isna(b):
            assert pd.isna(a)
        elif direction == "forward" or at[int(b)] != at[int(a)]:
            assert at[int(a)] == at[int(b)]  # equal times on the right are interchangeable when searching forward
        else:
            assert a == b


def test_asof_tie_prefers_the_earlier_row(spark):
    left = spark.createDataFrame([("a", 1.0)], "s string, t double")
    right = spark.createDataFrame([("a", 0.5, 1.0, 0), ("a", 1.5, 2.0, 1), ("a", 0.5, 3.0, 2)], "s string, t double, v double, rid int")
    assert A.asof_join(left, right, ["s"], "t", ["v"], "nearest", 1.0, 1.0, "rid").first()["v"] == 3.0


def test_later_segment_wins_and_bounds_are_inclusive(spark):
    lines = spark.createDataFrame([("s1", "# ORDER;Base;TSST;;"), ("s1", "# START;1;2;;"), ("s1", "# END;2;3;")], "session_id string, value string")
    seg = A.protocol_segments(lines, ["session_id"])
    assert [(r["wesad_protocol_segment"], r["wesad_protocol_start_s"], r["wesad_protocol_end_s"]) for r in seg.orderBy("seg_no").collect()] == [
        ("base", 0.0, 60.0), ("tsst", 60.0, 120.0)]
    pts = spark.createDataFrame([("s1", i, float(t)) for i, t in enumerate((0, 60, 120, 121))], "session_id string, sample_index long, sample_offset_s double")
    got = {r["sample_offset_s"]: r for r in A.apply_protocol(pts, seg, ["session_id"], bucket=50.0).collect()}
    assert [got[t]["wesad_protocol_segment"] for t in (0.0, 60.0, 120.0, 121.0)] == ["base", "tsst", "tsst", "unknown"]
    assert got[60.0]["target_stress_score_0_10"] == 8.0 and got[121.0]["target_stress_binary"] is None


def test_interval_join_keeps_points_that_repeat_or_have_no_key(spark):
    points = spark.createDataFrame([("s", 1, 5.0), ("s", 1, 5.0), ("s", 1, 6.0), (None, 1, 5.0), (None, 1, 5.0)], "session_id string, sample_index long, t double")
    segments = spark.createDataFrame([("s", 0.0, 9.0, 1, "first"), ("s", 5.5, 7.0, 2, "later")], "session_id string, a double, b double, o int, label string")
    got = A.interval_join(points, segments, ["session_id"], "t", "a", "b", "o", ["label"], 2.0).collect()
    assert sorted((str(r["session_id"]), r["t"], str(r["label"])) for r in got) == [("None", 5.0, "None")] * 2 + [("s", 5.0, "first")] * 2 + [("s", 6.0, "later")]
