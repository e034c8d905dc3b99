import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.operators import metrics as M
from pulsegrid.operators.folds import group_kfold
from pulsegrid.operators.scale import exact_quantiles, running_index

RNG = np.random.default_rng(3)
PDF = pd.DataFrame({"g": ["hot"] * 900 + ["a"] * 10 + ["b"] * 5, "v": np.round(RNG.normal(size=915), 2), "y": RNG.integers(0, 2, 915), "i": range(915)})


def test_quantiles_on_the_hot_path(spark, hot):
    got = exact_quantiles(spark.createDataFrame(PDF), ["g"], ["v"], (0.05, 0.5, 0.9)).toPandas().set_index("g")
    for g, part in PDF.groupby("g"):
        for p, c in ((0.05, "v__q050"), (0.5, "v__q500"), (0.9, "v__q900")):
            assert abs(got.loc[g, c] - part["v"].quantile(p)) < 1e-12
    one = exact_quantiles(spark.createDataFrame(PDF), [], ["v"], (0.5,)).first()[0]
    assert abs(one - PDF["v"].median()) < 1e-12


def test_rank_metrics_on_the_hot_path(spark, hot):
    got = M.ranking_metrics(spark.createDataFrame(PDF), ["g"], "y", "v").toPandas().set_index("g")
    for g, part in PDF.groupby("g"):
        r = part["v"].rank()
        n1, n0 = part["y"].sum(), (1 - part["y"]).sum()
        if n1 and n0:
            assert abs(got.loc[g, "auc"] - (r[part["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) < 1e-12


def test_fdr_and_index_on_the_hot_path(spark, hot):
    pdf = PDF.assign(p=(PDF["v"] - PDF["v"].min()) / (PDF["v"].max() - PDF["v"].min()))
    got = M.bh_fdr(spark.createDataFrame(pdf), ["g"]).toPandas().set_index("i")
    for _, part in pdf.groupby("g"):
        p = part.sort_values("p")
        n = len(p)
        adj = np.minimum(1, np.minimum.accumulate((p["p"].to_numpy() * n / np.arange(1, n + 1))[::-1])[::-1])
        assert np.allclose(got.loc[p["i"], "fdr"], adj)
    idx = running_index(spark.createDataFrame(PDF), ["g"], "v", "pos", ["i"]).toPandas().sort_values(["g", "v", "i"])
    assert all(list(part["pos"]) == list(range(len(part))) for _, part in idx.groupby("g"))


def test_group_folds_are_the_greedy_ones(spark):
    sizes = [50, 1, 1, 1, 1, 1, 7, 7, 3, 3, 3, 20, 1, 1, 9]
    rows = [(g,) for g, n in enumerate(sizes) for _ in range(n)]
    got = {r["g"]: r["fold"] for r in group_kfold(spark.createDataFrame(rows, "g long"), "g", 4).collect()}
    loads, want = [0] * 4, {}
    for n, g in sorted(((n, g) for g, n in enumerate(sizes)), key=lambda t: (-t[0], t[1])):
        f = loads.index(min(loads))
        want[g], loads[f] = f, loads[f] + n
    assert got == want


def test_correlation_pairs(spark):
    pdf = pd.DataFrame({"g": ["a", "b"] * 30, "x": RNG.normal(size=60), "z": RNG.normal(size=60)})
    pdf["y"] = pdf["x"] * 2 + 1
    pdf.loc[:5, "z"] = None
    got = M.correlation_pairs(spark.createDataFrame(pdf), ["g"], ["x", "y", "z"]).toPandas()
    assert len(got) == 6
    for r in got.itertuples():
        part = pdf[pdf["g"] == r.g]
        assert abs(r.corr - part[r.feature_a].corr(part[r.feature_b])) < 1e-9
    assert M.calibration_error(spark.createDataFrame(pdf.assign(y=1, p=0.5)), ["g"]).agg(F.max("ece")).first()[0] == 0.5


def test_hot_quantiles_order_only_rows_near_them(spark, hot, monkeypatch):
    from pulsegrid.operators import scale

    pdf = pd.DataFrame({"g": (["hot"] * 3000 + [None] * 2000 + ["few"] * 9), "x": RNG.normal(size=5009) * 1e3, "y": np.where(RNG.random(5009) < 0.5, 7.0, np.inf)})
    pdf.loc[pdf["g"].isna(), "y"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, x double, y double").repartition(5).cache()
    for margins in (scale.MARGINS, (0.0, 1.0), (1.0,)):  # also when a sketch's bracket is missed
        monkeypatch.setattr(scale, "MARGINS", margins)
        got = exact_quantiles(df, ["g"], ["x", "y"], (0.0, 0.25, 0.5, 1.0)).toPandas().set_index("g")
        assert len(got) == 3
        for g, part in pdf.groupby(pdf["g"].fillna("-")):
            row = got.loc[g] if g != "-" else got[got.index.isna()].iloc[0]
            for p, n in ((0.0, "q000"), (0.25, "q250"), (0.5, "q500"), (1.0, "q1000")):
                assert abs(row[f"x__{n}"] - part["x"].quantile(p)) < 1e-9
            assert (g == "-") == bool(np.isnan(row["y__q000"])) and (g == "-" or row["y__q1000"] == np.inf)
