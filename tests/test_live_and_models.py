import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ml
from pulsegrid.operators import sampling as SA
from pulsegrid.operators.baseline import baseline_profiles
from pulsegrid.operators.windows import WindowSpec, window_features
from pulsegrid.functions.scoring import portable_logistic
from pulsegrid.plans import q_models, q_stream
from pulsegrid.plans.registry import table
from pulsegrid.streaming import live

SF = "/root/testdata/sf0.001"


def test_scores_on_the_stream_equal_batch(spark):
    static = q_stream.score_inputs(table(spark, SF, "events"))
    profiles = baseline_profiles(static)
    cols = ["event_id", "sympathetic", "homeostasis", "baseline_profile_available"]
    batch = {r["event_id"]: tuple(r) for r in live.score_stream(static, profiles).select(*cols).collect()}
    streamed = live.run_available(live.score_stream(q_stream.score_inputs(q_stream.event_stream(spark, SF)), profiles).select(*cols), "score")
    got = {r["event_id"]: tuple(r) for r in streamed.collect()}
    assert got.keys() == batch.keys() and all(got[k] == pytest.approx(batch[k]) for k in got)


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "ts timestamp, k string, v double"

    def land(rows):
        spark.createDataFrame(rows, "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)

    land([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 02:00:00", "a", 1.0)])
    stream = live.tumbling_counts(spark.readStream.schema(schema).parquet(path), ["k"], "ts", "1 minute", "10 minutes")

    def drain():
        q = (stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        q.awaitTermination()

    drain()
    land([("2024-01-01 00:00:20", "a", 1.0), ("2024-01-01 03:00:00", "a", 1.0)])
    drain()
    out = {str(r["window_start"]): r["rows"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out["2024-01-01 00:00:00"] == 1 and out["2024-01-01 02:00:00"] == 1


def test_portable_model_equals_pipeline(spark):
    df = spark.range(300).select(
        F.col("id"), (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") % 11).cast("double")).alias("b"),
        ((F.col("id") * 13 % 17) + (F.col("id") % 7) * 2 > 14).cast("int").alias("y"), (F.col("id") % 9).alias("g"), F.concat(F.lit("d"), F.col("id") % 3).alias("dataset_id"))
    exported = ml.export_portable(df, ["a", "b"], "y")
    fitted = {r["id"]: r["p"] for r in ml.fit("portable_logistic", df, ["a", "b"], "y").transform(df).collect()}
    scored = {r["id"]: r["p"] for r in df.select("id", portable_logistic(df, exported).alias("p")).collect()}
    assert all(abs(fitted[i] - scored[i]) < 1e-4 for i in fitted)
    oof = ml.out_of_fold(df, ["a", "b"], "y", "g", "gam_spline", 3)
    assert oof.count() == 300 and oof.groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    assert ml.evaluate(oof, [], "y").first()["auc"] > 0.6


def test_discriminant_and_distinct_forests(spark):
    rng = np.random.default_rng(4)
    y = (np.arange(240) % 3 == 0).astype(int)
    x = rng.normal(size=(240, 3)) + y[:, None] * np.array([1.0, 0.5, 0.0])
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    score = lambda name: [r["p"] for r in ml.fit(name, df, ["a", "b", "c"], "y").transform(df).orderBy("id").collect()]
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    pooled = 0.0
    for k in (0, 1):
        own = z[y == k] - z[y == k].mean(axis=0)
        scale = own.std(axis=0)
        own = own / scale
        n, cov = len(own), own.T @ own / len(own)
        target = np.trace(cov) / 3 * np.eye(3)
        spread = sum(((np.outer(r, r) - cov) ** 2).sum() for r in own) / n**2
        share = min(1.0, spread / ((cov - target) ** 2).sum())
        pooled = pooled + n / 240 * np.outer(scale, scale) * ((1 - share) * cov + share * target)
    m0, m1 = z[y == 0].mean(axis=0), z[y == 1].mean(axis=0)
    w = np.linalg.solve(pooled, m1 - m0)
    want = 1 / (1 + np.exp(-(z @ w - w @ (m0 + m1) / 2 + np.log(y.sum() / (240 - y.sum())))))
    assert np.allclose(score("lda"), want, atol=1e-9)
    forests = [score("random_forest"), score("extra_trees")]
    assert np.abs(np.subtract(*forests)).max() > 0.01 and all(np.mean((np.array(p) > 0.5) == y) > 0.7 for p in forests)
    assert len(score("stacked_vote")) == 240


def test_fill_is_the_exact_median(spark):
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate([1, 2, 4, 8])] + [(None, 0), (float("nan"), 1)], "a double, y int")
    assert ml.fit("portable_logistic", df, ["a"], "y").prep.stages[0].medians == {"a": 3.0}


def test_sampling_caps_and_balance(spark):
    rows = spark.range(4000).select(
        F.lit("d").alias("dataset_id"), (F.col("id") % 100).alias("session_id"), F.col("id").cast("double").alias("window_end_s"), (F.col("id") % 100 < 80).cast("int").alias("y"))
    picked = SA.balanced_sessions(rows, 20, 1)
    per = {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.countDistinct("session_id").alias("n")).collect()}
    assert per == {0: 10, 1: 10}
    assert picked.count() == 20 * 40  # kept sessions stay whole
    mixed = rows.withColumn("y", (F.col("window_end_s") % 200 < 100).cast("int"))
    w = SA.sample_windows(mixed, 6, 1)
    assert w.count() == 600 and w.groupBy("session_id").agg(F.sum("y").alias("s")).where("s != 3").count() == 0


def test_null_session_is_kept_as_one_session(spark):
    df = spark.createDataFrame([("d", None, i, float(i), 1.0) for i in range(35)], "dataset_id string, session_id string, sample_index long, sample_offset_s double, eda double")
    assert window_features(df, WindowSpec(), all_blocks=False).count() == 5


@pytest.mark.parametrize("n", [150, 199, 200, 600])
def test_glm_query_fits_all_base_features(spark, monkeypatch, n):
    names = q_models.BASE_FEATURES
    r = np.random.default_rng(3)
    x = r.normal(size=(n, len(names)))
    y = (r.random(n) < 1 / (1 + np.exp(-(x[:, 0] - x[:, -1]) / 2))).astype(float)
    rows = [[float(t), *map(float, v)] for t, v in zip(y, x)] + [[1.0, *[None] * len(names)]] * 100
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ["y", *names]))
    monkeypatch.setattr(q_models, "_rows", lambda spark, sf: df)
    got = {row["feature"]: row["beta"] for row in q_models.glm_binomial(spark, "").collect()}
    if n < 200:
        assert got == {}
        return
    a, beta = np.column_stack((x, np.ones(n))), np.zeros(len(names) + 1)
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-a @ beta))
        beta += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]), a.T @ (y - p))
    assert list(got) == [*names, "(intercept)"] and list(got.values()) == pytest.approx(beta.tolist(), abs=1e-4)


def test_rows_without_a_dataset_train_but_are_not_held_out(spark):
    rows = [(d, float(i % 7), int(i % 7 + i % 3 > 4)) for d in ("a", "b", None) for i in range(42)]
    df = spark.createDataFrame(rows, "dataset_id string, x double, y int")
    got = ml.leave_dataset_out(df, ["x"], "y", "portable_logistic").groupBy("split").agg(F.count("p").alias("n")).collect()
    assert {r["split"]: r["n"] for r in got} == {"leave_dataset_out:a": 42, "leave_dataset_out:b": 42}
