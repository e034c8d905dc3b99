import math

import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import ml


def plain_fit(x, y, subject):
    """Newton's steps over the slope and a dummy for each subject; subjects of one class stand at infinity and are left out."""
    x = (x - x.mean()) / x.std(ddof=1)
    keep = np.array([0 < y[subject == s].sum() < (subject == s).sum() for s in subject])
    x, y, subject = x[keep], y[keep], subject[keep]
    a = np.column_stack([x, *[(subject == s).astype(float) for s in np.unique(subject)]])
    beta = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-a @ beta))
        info = a.T @ (a * (p * (1 - p))[:, None])
        beta += np.linalg.solve(info, a.T @ (y - p))
    return beta[0], math.erfc(abs(beta[0]) / math.sqrt(np.linalg.inv(info)[0, 0]) / math.sqrt(2))


def table(n=900, seed=4):
    r = np.random.default_rng(seed)
    subject = np.where(r.random(n) < 0.4, 0, r.integers(1, 12, n))  # a hot subject
    x, noise = np.round(r.normal(size=n) + subject / 6, 1), r.normal(size=n)
    y = (r.random(n) < 1 / (1 + np.exp(-(0.8 * x - subject / 4)))).astype(int)
    y[subject == 7], y[subject == 8] = 1, 0
    return x, noise, y, subject


@pytest.mark.parametrize("chunk", [4096, 8])
def test_slope_and_p_equal_a_fit_with_dummies(spark, monkeypatch, chunk):
    monkeypatch.setattr(ml, "CHUNK_VALUES", chunk)
    x, noise, y, subject = table()
    parts = [pd.DataFrame({"d": d, "feature": f, "subject_id": subject[at].astype(str), "y": y[at], "value": v[at]})
             for d, at in (("one", slice(0, 600)), (None, slice(600, 900))) for f, v in (("x", x), ("noise", noise))]
    got = ml.subject_logit(spark.createDataFrame(pd.concat(parts)), ["d"]).collect()
    assert len(got) == 4
    for row in got:
        at = slice(0, 600) if row["d"] else slice(600, 900)
        beta, p = plain_fit({"x": x, "noise": noise}[row["feature"]][at], y[at], subject[at])
        assert row["rows"] == at.stop - at.start and row["beta"] == pytest.approx(beta, abs=1e-6) and row["p"] == pytest.approx(p, rel=1e-4, abs=1e-6)


def test_features_without_a_fit_have_a_row_of_nulls(spark):
    rows = [("flat", 1.0, i % 2, "s") for i in range(60)] + [("few", float(i), i % 2, "s") for i in range(39)]
    rows += [("one_class", float(i), 1, "s") for i in range(60)] + [("between", float(i), int(i < 30), "ab"[i // 30]) for i in range(60)]
    rows += [("parted", float(i), int(i < 30), "s") for i in range(60)]
    rows += [("few", v, 1, "s") for v in (None, float("nan"), float("inf"))] + [("few", 1.0, None, "s"), ("few", 1.0, 1, None)]
    df = spark.createDataFrame(rows, "feature string, value double, y int, subject_id string")
    got = {r["feature"]: (r["rows"], r["beta"], r["p"]) for r in ml.subject_logit(df, []).collect()}
    assert got == {"flat": (60, None, None), "few": (39, None, None), "one_class": (60, None, None), "between": (60, None, None), "parted": (60, None, None)}
    assert ml.subject_logit(df.where("false"), []).count() == 0
