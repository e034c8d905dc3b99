"""Interval algebra against sets of units, over time buckets of every size."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import intervals as I
from pulsegrid.operators.align import archetype_label, minute_counts

SCHEMA = "person string, kind string, s long, e long, at long, until long"


def records():
    r = random.Random(8)
    rows = [(r.choice(["x", "x", "y", None]), r.choice(["a", "b", "c"]), s, s + r.choice([0, 1, 3, 9, 40])) for s in (r.randint(-200, 800) for _ in range(300))]
    return [*rows, ("x", "a", 5, 5), ("x", "a", 9, 2), ("x", "b", None, 4), ("z", "a", 0, 10), ("z", "a", 10, 20), ("z", "b", 20, 30)]


def frame(spark):
    return spark.createDataFrame([(*x, 0, 0) for x in records()], SCHEMA)


def units(kind):
    out = {}
    for person, k, s, e in records():
        if s is not None and k in kind:
            out.setdefault(person, set()).update(range(s, e))
    return out


@pytest.mark.parametrize("bucket", [1, 7, 100, 10_000])
def test_union_is_maximal_and_covers_the_same(spark, bucket):
    got = sorted((r["person"] or "", r["at"], r["until"]) for r in I.merged(frame(spark), ["person"], "s", "e", bucket).collect())
    for person, want in units("abc").items():
        own = [(a, b) for p, a, b in got if p == (person or "")]
        assert set().union(*(range(a, b) for a, b in own)) == want and all(b < a for (_, b), (a, _) in zip(own, own[1:], strict=False))
    sizes = {r["op"]: r["n"] for r in I.set_sizes(frame(spark), ["person"], "s", "e", F.col("kind") == "a", F.col("kind") == "b", bucket, "n").collect()}
    a, b = units("a"), units("b")
    pairs = [(a.get(p, set()), b.get(p, set())) for p in {*a, *b}]
    assert sizes == {"union": sum(len(x | y) for x, y in pairs), "intersect": sum(len(x & y) for x, y in pairs), "except": sum(len(x - y) for x, y in pairs)}


def test_changes_tell_the_state_at_any_time(spark):
    flags = {"a": F.col("kind") == "a", "b": F.col("kind") == "b"}
    changes = sorted(((r["person"] or "", r["at"], r["until"], r["a"], r["b"]) for r in I.coverage_changes(frame(spark), ["person"], "s", "e", flags, 50).collect()), key=lambda r: r[:2])
    for person in ("x", "y", None, "z"):
        own = [c for c in changes if c[0] == (person or "")]
        assert own[-1][2] is None and not own[-1][3] and all(c[2] == d[1] and c[3:] != d[3:] for c, d in zip(own, own[1:], strict=False))
        for t in range(-220, 860, 3):
            state = next((c[3:] for c in reversed(own) if c[1] <= t), (False, False))
            assert state == (t in units("a").get(person, ()), t in units("b").get(person, ()))


@pytest.mark.parametrize("bucket", [11, 5000])
def test_points_take_the_state_of_their_time(spark, bucket):
    points = spark.createDataFrame([(p, t, 1) for p in ("x", "y", None, "none") for t in range(-210, 860, 7)] + [("x", None, 1)], "person string, t long, at long")
    flags = {"a": F.col("kind") == "a", "b": F.col("kind") == "b"}
    got = I.covered_at(points, ["person"], F.col("t"), frame(spark), "s", "e", flags, bucket).collect()
    assert len(got) == points.count() and all((r["a"], r["b"]) == (r["t"] in units("a").get(r["person"], ()), r["t"] in units("b").get(r["person"], ())) for r in got)


def test_no_records(spark):
    none = frame(spark).limit(0)
    assert I.merged(none, ["person"], "s", "e", 10).count() == 0
    assert {r["n"] for r in I.set_sizes(none, ["person"], "s", "e", F.lit(True), F.lit(False), 10, "n").collect()} == {0}


def test_minutes_of_a_wrong_end_date_make_one_row(spark):
    day = dt.datetime(2024, 3, 1, 10, 0, 30)
    rows = [("p", "sleep", day, dt.datetime(9000, 1, 1)), ("p", "stand", day, day), ("p", "stand", day, day + dt.timedelta(minutes=2)), ("p", "workout", day, day - dt.timedelta(minutes=1)), ("p", "workout", None, day)]
    iv = spark.createDataFrame(rows, "person string, kind string, s timestamp, e timestamp")
    got = {r["kind"]: r["minutes"] for r in minute_counts(iv, ["person"], "s", "e", "kind").collect()}
    assert got["stand"] == 4 and got["sleep"] > 3_600_000_000 and "workout" not in got
    at = [(-1, "awake_nonworkout"), (0, "standing"), (3, "standing"), (4, "sleep"), (10**6, "sleep")]
    samples = spark.createDataFrame([("p", day + dt.timedelta(minutes=m), m) for m, _ in at] + [("q", day, 77), ("p", None, 88)], "person string, ts timestamp, m long")
    labels = {r["m"]: r["archetype"] for r in archetype_label(samples, iv, ["person"], "ts", "s", "e", "kind").collect()}
    assert labels == dict(at) | {77: "awake_nonworkout", 88: "awake_nonworkout"}
