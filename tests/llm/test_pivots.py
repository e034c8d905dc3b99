"""The pivot index against all cosines, on groups large and small, and on vectors that link with nothing."""

import numpy as np
import pytest

from pulsegrid.llm import pivots

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, near string, key bigint, core string"


def brute(rows, threshold=0.93):
    """(id, links, least id reached) by definition."""
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = {i: [j for j in good if j != i and rows[j][2] == rows[i][2] and len(rows[j][1]) == len(rows[i][1]) and np.dot(np.float64(rows[i][1]), np.float64(rows[j][1])) / (np.linalg.norm(np.float64(rows[i][1])) * np.linalg.norm(np.float64(rows[j][1]))) >= threshold] for i in good}
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        known = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((vec, len(near.get(i, [])), min(known, default=None)))
    return sorted(out, key=repr)


def around(middle, count, angle, random):
    """Unit vectors at up to ``angle`` degrees from ``middle``."""
    side = random.normal(size=(count, len(middle)))
    side -= (side @ middle)[:, None] * middle
    side /= np.linalg.norm(side, axis=1)[:, None]
    turn = np.radians(angle) * random.random((count, 1)) ** 0.3
    return np.cos(turn) * middle + np.sin(turn) * side


def dealt(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], label, 1, "n", 2, "c") for i, v, label in rows], SCHEMA)


def found(frame, threshold=0.93):
    return sorted(((r["id"], r["n_links"], r["component_id"]) for r in pivots.near_vectors(frame, threshold).collect()), key=repr)


@pytest.mark.parametrize("seed, angle, block", [(1, 6, 2048), (2, 14, 64), (3, 21, 64)])
def test_groups_of_any_width_equal_all_cosines(spark, monkeypatch, seed, angle, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    random = np.random.default_rng(seed)
    unit = lambda n: random.normal(size=(n, 24))
    middles = unit(6) / 5
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    some = [*unit(150), *around(middles[0], 260, angle, random), *around(middles[1], 60, 10, random), *around(middles[2], 8, 5, random), *around(middles[0], 30, 30, random)]
    rows = [(int(i), np.float32(v * random.uniform(0.1, 50)).tolist(), int(i % 7 == 0)) for i, v in enumerate(some)]
    rows += [(5000 + i, rows[200][1], rows[200][2]) for i in range(40)]  # equal vectors
    want, got = brute(rows), found(dealt(spark, rows))
    links = sum(w[1] for w in want)
    assert links - sum(g[1] for g in got) <= 0.001 * links and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    if angle < 20:
        assert got == want


def test_vectors_that_link_with_nothing(spark):
    one = [1.0, 2.0, 2.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 2.0], 0), (5, [float("nan"), 1.0, 1.0], 0), (6, [float("inf"), 1.0, 1.0], 0), (7, one, None), (8, one, 0), (8, one, 0), (None, one, 0), (9, [2.0, 4.0, 4.0], 0), (10, one, 1), (11, [1.0, 2.0], 0), (12, [1e-38, 2e-38, 2e-38], 0), (13, [1.1e38, 2.2e38, 2.2e38], 0), (None, None, None)]
    assert found(dealt(spark, rows)) == brute(rows)
    assert pivots.near_vectors(dealt(spark, rows).limit(0)).count() == 0 and pivots.near_vectors(dealt(spark, rows[:7])).count() == 7


def test_pivots_lie_apart(spark):
    random = np.random.default_rng(4)
    middle = np.eye(16)[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*around(middle, 300, 8, random), *random.normal(size=(100, 16))])]
    points = spark.createDataFrame([(i * 7919 % 400, i, v) for i, v, _ in rows], "d1 bigint, d2 bigint, v array<double>")
    chosen = pivots.choose_pivots(points, 400, 16)
    assert len(chosen) > pivots.NEAREST and (np.triu(chosen @ chosen.T, 1) < pivots.APART).all()
