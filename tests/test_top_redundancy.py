import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import metrics as M


@pytest.mark.parametrize("k", [2, 4, 30])
def test_pairs_of_the_best_features_of_each_group(spark, k):
    r = np.random.default_rng(5)
    wide = pd.DataFrame(r.normal(size=(120, 6)), columns=list("abcdef")).assign(g=["x", "y", None] * 40)
    wide["b"], wide["c"] = wide["a"] * -2 + r.normal(size=120) / 50, wide["a"] + 1
    wide.loc[wide["g"] == "y", "d"] = 3.0
    wide.loc[::7, "c"] = np.nan
    wide.loc[wide["g"].isna(), "e"] = wide["f"]
    scores = [(g, f, None if (g, f) == ("x", "f") else 0.5 + ((3 * i + 5 * j) % 7) / 20) for j, g in enumerate(("x", "y", None)) for i, f in enumerate("abcdef")]
    scores += [("x", "other", 1.0), ("lonely", "a", 0.9), ("unseen", "a", 0.9), ("unseen", "b", 0.9)]
    ranking = spark.createDataFrame(scores, "g string, feature string, oriented_auc double")
    values = spark.createDataFrame([tuple(None if v != v else v for v in row) for row in wide[list("abcdefg")].itertuples(index=False)], "a double, b double, c double, d double, e double, f double, g string")
    got = {row["g"]: (row["top_features"], row["redundant_pairs"]) for row in M.top_redundancy(values, ranking, ["g"], list("abcdef"), k).collect()}
    want = {"unseen": (2, 0)}
    for g in ("x", "y", None):
        top = [f for _, f in sorted((-s, f) for h, f, s in scores if h == g and s is not None and f in "abcdef")][:k]
        corr = wide[wide["g"].isna() if g is None else wide["g"] == g][top].corr().abs().to_numpy()
        want[g] = (len(top), int((corr[np.triu_indices(len(top), 1)] >= 0.95).sum()))
    assert got == want
    assert M.top_redundancy(values.where("false"), ranking.where("false"), ["g"], list("abcdef"), k).count() == 0
