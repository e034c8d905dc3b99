"""Training and leakage-aware evaluation with MLlib pipelines.

Class weights, imputation and scaling are fitted inside the training rows of every split. Learners
without an MLlib counterpart use the nearest distributed one (noted per entry).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.folds import with_folds
from pulsegrid.operators.metrics import metric_table
from pulsegrid.operators.scale import exact_quantiles, null_safe_join
from pulsegrid.operators.select import non_null_counts
from pulsegrid.session import written

LEARNERS = (
    "portable_logistic", "elastic_net", "gam_spline", "lda", "rbf_svm", "random_forest", "extra_trees", "gradient_boosting",
    "small_mlp", "stacked_vote",
)


class ColumnBuilder(Transformer):
    """A pipeline stage that adds columns from SQL expressions (fixed after fitting)."""

    def __init__(self, exprs: dict[str, str]):
        super().__init__()
        self.exprs = exprs

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.expr(e) for n, e in self.exprs.items()})


class MedianFill(ColumnBuilder):
    """``{c}__filled``: the exact median of the training rows where a value is NULL or NaN."""

    def __init__(self, medians: dict[str, float]):
        super().__init__({f"{c}__filled": f"coalesce(nanvl(`{c}`, cast(NULL AS double)), {m!r}D)" for c, m in medians.items()})
        self.medians = medians


class RandomCuts(Transformer):
    """``target``: per input, how many of its fixed random cut points lie below the value."""

    def __init__(self, cuts: list[list[float]], source: str = "__x", target: str = "__xc"):
        super().__init__()
        self.cuts, self.source, self.target = cuts, source, target

    def _transform(self, df: DataFrame) -> DataFrame:
        table = F.array(*[F.array(*[F.lit(t) for t in row]) for row in self.cuts])
        below = F.zip_with(vector_to_array(self.source), table, lambda x, row: F.size(F.filter(row, lambda t: t < x)).cast("double"))
        return df.withColumn(self.target, array_to_vector(below))


def random_cuts(ready: DataFrame, width: int, cuts: int = 16, seed: int = 42) -> RandomCuts:
    """Cut points drawn evenly between the least and the largest training value of each input."""
    import numpy as np

    row = ready.agg(Summarizer.min(F.col("__x")).alias("lo"), Summarizer.max(F.col("__x")).alias("hi")).first()
    lo, hi = row["lo"].toArray(), row["hi"].toArray()
    drawn = np.sort(lo[:, None] + (hi - lo)[:, None] * np.random.default_rng(seed).random((width, cuts)), axis=1)
    return RandomCuts(drawn.tolist())


def spline_basis(train: DataFrame, columns: Sequence[str], knots: int = 4) -> tuple[ColumnBuilder, list[str]]:
    """Quadratic truncated-power spline per column, knots at equal quantiles of the training rows.

    It spans the same piecewise-quadratic functions as a B-spline basis with those knots.
    """
    probs = [i / (knots - 1) for i in range(knots)]
    row = exact_quantiles(train, [], columns, probs).first().asDict()
    exprs: dict[str, str] = {}
    for c in columns:
        ts = [v for n, v in row.items() if n.startswith(f"{c}__q") and v is not None]
        lo, hi = (min(ts), max(ts)) if ts else (0.0, 1.0)
        x = f"((least(greatest(`{c}`, {lo!r}D), {hi!r}D) - {lo!r}D) / {max(hi - lo, 1e-9)!r}D)"
        exprs[f"{c}__sp1"], exprs[f"{c}__sp2"] = x, f"{x} * {x}"
        for i, t in enumerate(sorted(ts)[1:-1], 3):
            u = (t - lo) / max(hi - lo, 1e-9)
            exprs[f"{c}__sp{i}"] = f"power(greatest({x} - {u!r}D, 0.0D), 2)"
    return ColumnBuilder(exprs), list(exprs)


def random_fourier(columns: Sequence[str], features: int = 64, gamma: float | None = None, seed: int = 42) -> tuple[ColumnBuilder, list[str]]:
    """Random cosine features of scaled inputs: a linear model on them approximates an RBF kernel machine."""
    import numpy as np

    rng = np.random.default_rng(seed)
    g = gamma or 1.0 / max(len(columns), 1)
    weights, phase = rng.normal(0.0, (2.0 * g) ** 0.5, (features, len(columns))), rng.uniform(0, 2 * np.pi, features)
    arr = "array(" + ", ".join(f"`{c}`" for c in columns) + ")"
    exprs = {}
    for i in range(features):
        w = "array(" + ", ".join(f"{v!r}D" for v in weights[i].tolist()) + ")"
        exprs[f"__rff{i}"] = f"{(2.0 / features) ** 0.5!r}D * cos(aggregate(zip_with({arr}, {w}, (a, b) -> a * b), {float(phase[i])!r}D, (s, v) -> s + v))"
    return ColumnBuilder(exprs), list(exprs)


def class_weights(train: DataFrame, y: str) -> DataFrame:
    """Balanced weights n / (classes x class size), as a column; class sizes are one tiny aggregate."""
    counts = {r[y]: r["n"] for r in train.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, weight = sum(counts.values()), F.lit(1.0)
    for label, n in counts.items():
        weight = F.when(F.col(y) == label, total / (len(counts) * n)).otherwise(weight)
    return train.withColumn("__w", weight)


class DiscriminantModel(Transformer):
    """Linear boundary of two classes with one covariance; the probability is the logistic of the distance."""

    def __init__(self, weights: list[float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def _transform(self, df: DataFrame) -> DataFrame:
        products = F.zip_with(vector_to_array("__x"), F.array(*[F.lit(w) for w in self.weights]), lambda x, w: x * w)
        return df.withColumn("__p", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(products, F.lit(self.bias), lambda a, v: a + v))))


class Discriminant:
    """Linear discriminant: class means, and the mean of the class covariances, each shrunk towards its diagonal.

    The shrinkage of a class is the Ledoit-Wolf estimate on its standardised rows. Two aggregates: moments per class,
    then sums of products, of which every task hands on one matrix per class. The driver sees features x features.
    """

    def __init__(self, y: str):
        self.y = y

    def fit(self, ready: DataFrame) -> DiscriminantModel:
        import numpy as np
        import pandas as pd

        y = self.y
        x = F.col("__x")
        found = ready.groupBy(y).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(x).alias("m"), Summarizer.variance(x).alias("v")).collect()
        if {r[y] for r in found} != {0.0, 1.0}:
            raise ValueError("a discriminant needs rows of both classes, 0 and 1")
        size, mean, scale = {}, {}, {}
        for r in found:
            size[r[y]], mean[r[y]] = r["n"], r["m"].toArray()
            sd = np.sqrt(r["v"].toArray() * (r["n"] - 1) / r["n"]) if r["n"] > 1 else np.zeros(len(mean[r[y]]))
            scale[r[y]] = np.where(sd > 0, sd, 1.0)

        def partial(batches):
            state = {c: [0.0, 0.0] for c in size}
            for pdf in batches:
                for c, part in pdf.groupby("c"):
                    z = (np.stack(part["z"].to_list()) - mean[c]) / scale[c]
                    state[c][0] = state[c][0] + z.T @ z
                    state[c][1] += float(((z * z).sum(axis=1) ** 2).sum())
            for c, (products, fourth) in state.items():
                if np.ndim(products):
                    yield pd.DataFrame({"c": c, "i": range(len(products)), "s": list(products), "f": [fourth] + [0.0] * (len(products) - 1)})

        rows = ready.select(F.col(y).cast("double").alias("c"), vector_to_array("__x").alias("z"))
        sums = rows.mapInPandas(partial, "c double, i int, s array<double>, f double")
        parts = sums.groupBy("c", "i").agg(Summarizer.sum(array_to_vector("s")).alias("s"), F.sum("f").alias("f")).collect()
        total, pooled = sum(size.values()), 0.0
        for c, n in size.items():
            own = sorted((r for r in parts if r["c"] == c), key=lambda r: r["i"])
            cov, p = np.stack([r["s"].toArray() for r in own]) / n, len(own)
            mu = np.trace(cov) / p
            delta = ((cov - mu * np.eye(p)) ** 2).sum() / p
            beta = (sum(r["f"] for r in own) / n - (cov**2).sum()) / (p * n)
            shrink = min(max(beta, 0.0), delta) / delta if delta > 0 else 0.0
            shrunk = (1 - shrink) * cov + shrink * mu * np.eye(p)
            pooled = pooled + n / total * scale[c][:, None] * shrunk * scale[c][None, :]
        weights = np.linalg.lstsq(pooled, mean[1.0] - mean[0.0], rcond=None)[0]
        bias = -0.5 * float(weights @ (mean[1.0] + mean[0.0])) + float(np.log(size[1.0] / size[0.0]))
        return DiscriminantModel(weights.tolist(), bias)


def _scaled_stages(inputs: Sequence[str], prefix: str = "__x") -> list:
    return [VectorAssembler(inputCols=list(inputs), outputCol=f"{prefix}_raw", handleInvalid="keep"),
            StandardScaler(inputCol=f"{prefix}_raw", outputCol=prefix, withMean=True, withStd=True)]


def estimators(name: str, y: str, width: int, rows: int) -> list[tuple[float, object]]:
    """(vote weight, estimator) list behind a learner name; one entry except for the soft vote.

    ``rows`` is the sum of the balanced weights: an inverse regularisation C on the sum of losses is 1 / (C rows) on their mean.
    """
    common = dict(featuresCol="__x", labelCol=y)

    def logistic(max_iter, c, mix=0.0):
        return LogisticRegression(weightCol="__w", maxIter=max_iter, regParam=1.0 / (c * rows), elasticNetParam=mix, standardization=False, **common)

    def forest(trees=80, leaf=5, **more):  # trees grow to the library's limit of depth
        return RandomForestClassifier(weightCol="__w", numTrees=trees, minInstancesPerNode=leaf, maxDepth=30, seed=42, featureSubsetStrategy="sqrt", **{**common, **more})

    def extra(trees):  # every tree sees all rows and splits at random cut points only
        return forest(trees, bootstrap=False, featuresCol="__xc")

    def mlp(hidden, iterations):
        return MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=iterations, seed=42, **common)

    # The learners' settings.
    table = {
        "portable_logistic": lambda: [(1.0, logistic(500, 0.7))],
        "elastic_net": lambda: [(1.0, logistic(700, 0.5, 0.35))],
        "gam_spline": lambda: [(1.0, logistic(600, 0.3))],
        "lda": lambda: [(1.0, Discriminant(y))],
        "rbf_svm": lambda: [(1.0, LinearSVC(weightCol="__w", maxIter=100, regParam=1.0 / rows, **common))],  # on random cosine features
        "random_forest": lambda: [(1.0, forest())],
        "extra_trees": lambda: [(1.0, extra(80))],
        "gradient_boosting": lambda: [(1.0, GBTClassifier(maxIter=60, stepSize=0.07, maxDepth=5, seed=42, **common))],
        "small_mlp": lambda: [(1.0, mlp(24, 180))],
        "stacked_vote": lambda: [(0.4, logistic(400, 0.7)), (0.4, extra(50)), (0.2, mlp(16, 140))],
    }
    if name not in table:
        raise KeyError(name)
    return table[name]()


class FittedLearner:
    """Fitted preprocessing plus one or more fitted classifiers; adds a probability column."""

    def __init__(self, prep: PipelineModel, models: list[tuple[float, object]], inputs: list[str]):
        self.prep, self.models, self.inputs = prep, models, inputs

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        rows = self.prep.transform(df)
        keep = df.columns
        total, weight = F.lit(0.0), sum(w for w, _ in self.models)
        for i, (w, m) in enumerate(self.models):
            if isinstance(m, DiscriminantModel):
                rows, p = m.transform(rows).withColumnRenamed("__p", f"__p{i}"), F.col(f"__p{i}")
            elif m.hasParam("probabilityCol"):
                m = m.copy({m.getParam("probabilityCol"): f"__p{i}", m.getParam("rawPredictionCol"): f"__r{i}", m.getParam("predictionCol"): f"__q{i}"})
                rows = m.transform(rows)
                p = vector_to_array(F.col(f"__p{i}"))[1]
            else:
                m = m.copy({m.getParam("rawPredictionCol"): f"__r{i}", m.getParam("predictionCol"): f"__q{i}"})
                rows = m.transform(rows)
                p = 1.0 / (1.0 + F.exp(-vector_to_array(F.col(f"__r{i}"))[1]))
            total = total + F.lit(w / weight) * p
        return rows.withColumn(out, total).select(*keep, out)


def fit(name: str, train: DataFrame, features: Sequence[str], y: str) -> FittedLearner:
    """Median imputation, standardisation, optional basis, then the named learner - all on these rows, which are kept while fitting."""
    base = train.where(F.col(y).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(y).cast("double").alias(y)).persist()
    try:
        return _fit(name, base, [c for c in features if non_null_counts(base, features).get(c, 0) > 0] if features else [], y)
    finally:
        base.unpersist()


def _fit(name: str, base: DataFrame, features: list[str], y: str) -> FittedLearner:
    rows = class_weights(base, y)
    medians = exact_quantiles(base.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in features]), [], features, (0.5,)).first().asDict()
    # A column of NaN alone has no median and is left out.
    features = [c for c in features if medians[f"{c}__q500"] is not None]
    imputer = MedianFill({c: medians[f"{c}__q500"] for c in features})
    filled = inputs = list(imputer.exprs)
    stages: list[Transformer] = [imputer]
    if name == "gam_spline":
        builder, inputs = spline_basis(imputer.transform(rows), filled)
        stages.append(builder)
    scaled = Pipeline(stages=_scaled_stages(inputs)).fit(PipelineModel(stages).transform(rows))
    stages += scaled.stages
    if name == "rbf_svm":
        arr = {f"__s{i}": f"__arr[{i}]" for i in range(len(inputs))}
        builder, rff = random_fourier(list(arr))
        stages += [VectorColumns("__x", "__arr"), ColumnBuilder(arr), builder, DropColumns("__x", "__x_raw"),
                   VectorAssembler(inputCols=rff, outputCol="__x", handleInvalid="keep")]
        inputs = rff
    if name in ("extra_trees", "stacked_vote"):
        stages.append(random_cuts(PipelineModel(stages).transform(rows), len(inputs)))
    prep = PipelineModel(stages)
    ready = prep.transform(rows)
    models = [(w, e.fit(ready)) for w, e in estimators(name, y, len(inputs), max(1, base.count()))]
    return FittedLearner(prep, models, features)


class VectorColumns(Transformer):
    def __init__(self, source: str, target: str):
        super().__init__()
        self.source, self.target = source, target

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.target, vector_to_array(F.col(self.source)))


class DropColumns(Transformer):
    def __init__(self, *names: str):
        super().__init__()
        self.names = names

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.names)


def out_of_fold(df: DataFrame, features: Sequence[str], y: str, group: str, learner: str, folds: int = 5) -> DataFrame:
    """Predictions for every row from models that never saw its group. Folds with one training class are left out."""
    data = with_folds(df.where(F.col(y).isNotNull()), group, folds)
    used = sorted(r["fold"] for r in data.select("fold").distinct().collect())
    parts = []
    for i in used:
        train, test = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
        if train.select(y).distinct().count() < 2:
            continue
        parts.append(fit(learner, train, features, y).transform(test))
    return reduce(DataFrame.unionByName, parts) if parts else data.withColumn("p", F.lit(None).cast("double"))


def leave_dataset_out(df: DataFrame, features: Sequence[str], y: str, learner: str, dataset: str = "dataset_id") -> DataFrame:
    """Held-out predictions with the model trained on all other datasets; single-class splits are skipped.

    Rows without a dataset are never held out and train every model.
    """
    data = df.where(F.col(y).isNotNull())
    counts = {r[dataset]: (r["n"], r["p"]) for r in data.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(y) == 1).cast("long")).alias("p")).collect()}
    rows, pos = sum(n for n, _ in counts.values()), sum(p for _, p in counts.values())
    parts = []
    for held in sorted(d for d in counts if d is not None):
        n, p = counts[held]
        if not (0 < p < n and 0 < pos - p < rows - n):
            continue
        model = fit(learner, data.where(~F.col(dataset).eqNullSafe(held)), features, y)
        parts.append(model.transform(data.where(F.col(dataset) == held)).withColumn("split", F.lit(f"leave_dataset_out:{held}")))
    return reduce(DataFrame.unionByName, parts) if parts else data.withColumns({"p": F.lit(None).cast("double"), "split": F.lit("")})


def evaluate(predictions: DataFrame, keys: Sequence[str], y: str, **labels) -> DataFrame:
    return metric_table(predictions, keys, y, "p").withColumns({k: F.lit(v) for k, v in labels.items()})


def screen(df: DataFrame, sets: dict[tuple[str, str], Sequence[str]], y: str, group: str, learner: str = "elastic_net", folds: int = 3) -> DataFrame:
    """One metric row per (profile, arm) with at least three usable features."""
    out = []
    for (profile, arm), features in sets.items():
        if len(features) < 3:
            continue
        p = out_of_fold(df, features, y, group, learner, folds)
        out.append(evaluate(p, [], y, target=y, profile=profile, arm=arm, learner=learner, features=len(features)))
    return reduce(DataFrame.unionByName, out)


def dataset_dummies(df: DataFrame, dataset: str = "dataset_id") -> tuple[DataFrame, list[str]]:
    """0/1 indicator columns for the datasets (the dataset-only control)."""
    names = sorted(r[0] for r in df.select(dataset).distinct().collect() if r[0] is not None)
    cols = {f"dataset_{n}": (F.col(dataset) == n).cast("double") for n in names}
    return df.withColumns(cols), list(cols)


def export_portable(df: DataFrame, features: Sequence[str], y: str) -> dict:
    """Coefficients, medians and scales of the final logistic model, ready for ``scoring.portable_logistic``."""
    model = fit("portable_logistic", df, features, y)
    imputer, scaler = model.prep.stages[0], model.prep.stages[2]
    lr = model.models[0][1]
    medians = imputer.medians
    stats = df.where(F.col(y).isNotNull()).agg(F.count(F.lit(1)), F.avg(F.col(y).cast("double"))).first()
    return {
        "rows": stats[0], "prevalence": stats[1], "numeric_features": model.inputs, "imputer_median": [float(medians[c]) for c in model.inputs],
        "scaler_mean": scaler.mean.toArray().tolist(), "scaler_scale": scaler.std.toArray().tolist(),
        "coef": lr.coefficients.toArray().tolist(), "intercept": float(lr.intercept), "activation": "sigmoid",
    }


def importance(model: FittedLearner, spark, top: int = 20) -> DataFrame:
    """Largest importances (trees) or absolute coefficients (linear) of a fitted learner."""
    m = model.models[0][1]
    raw = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())
    ranked = sorted(zip(model.inputs, map(float, raw)), key=lambda t: (-t[1], t[0]))[:top]
    return spark.createDataFrame(ranked, "feature string, importance double")


def glm_binomial(df: DataFrame, y: str, features: Sequence[str], min_rows: int = 200):
    """Binomial GLM on complete rows; None with too few rows or a single class."""
    rows = df.select(y, *features).na.drop().withColumn(y, F.col(y).cast("double"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(y).alias("c")).first()
    if stats["n"] < min_rows or stats["c"] < 2:
        return None
    va = VectorAssembler(inputCols=list(features), outputCol="__x")
    glr = GeneralizedLinearRegression(family="binomial", featuresCol="__x", labelCol=y, predictionCol="p", maxIter=25)
    return Pipeline(stages=[va, glr]).fit(rows)


def glm_table(model, features: Sequence[str], spark) -> DataFrame:
    """Coefficient and p value of every feature and the intercept; no rows where there is no model."""
    if model is None:
        return spark.createDataFrame([], "feature string, beta double, p double")
    s = model.stages[-1].summary
    glr = model.stages[-1]
    est = [*glr.coefficients.toArray().tolist(), float(glr.intercept)]
    rows = [(n, float(b), float(p)) for n, b, p in zip([*features, "(intercept)"], est, s.pValues)]
    return spark.createDataFrame(rows, "feature string, beta double, p double")


def within_subject_effect(long: DataFrame, groups: Sequence[str], subject: str = "subject_id", min_rows: int = 40) -> DataFrame:
    """Subject-fixed effect of every feature on a binary label, all features in one job.

    Linear within-subject estimator: label and feature are centred per subject, so the subject terms drop
    out; beta is per standard deviation of the feature, p from the normal approximation. This replaces one
    model fit per feature, each with thousands of subject dummies.
    """
    groups = [*groups, "feature"]
    rows = long.where(F.col("value").isNotNull() & F.col("y").isNotNull())
    per = rows.groupBy(*groups, subject).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mx"), F.avg("y").alias("my"), F.covar_pop("value", "y").alias("cxy"),
        F.var_pop("value").alias("vx"), F.var_pop("y").alias("vy"))
    n = F.col("n")
    total = per.groupBy(*groups).agg(
        F.sum(n).alias("rows"), F.count(F.lit(1)).alias("subjects"), F.sum(n * F.col("cxy")).alias("sxy"), F.sum(n * F.col("vx")).alias("sxx"),
        F.sum(n * F.col("vy")).alias("syy"), F.sum(n * F.col("mx")).alias("tx"), F.sum(n * (F.col("vx") + F.col("mx") * F.col("mx"))).alias("txx"))
    sd = F.sqrt((F.col("txx") - F.col("tx") * F.col("tx") / F.col("rows")) / (F.col("rows") - 1))
    dof = F.col("rows") - F.col("subjects") - 1
    slope = F.col("sxy") / F.col("sxx")
    residual = F.greatest(F.col("syy") - F.col("sxy") * slope, F.lit(0.0))
    z = slope / F.sqrt(residual / dof / F.col("sxx"))
    ok = (F.col("rows") >= min_rows) & (F.col("sxx") > 1e-12) & (dof > 0) & (residual > 0)
    return total.select(*groups, "rows", F.when(ok, slope * sd).alias("beta"), F.when(ok, normal_p(z)).alias("p"))


def normal_p(z: Column) -> Column:
    """Two-sided normal tail by the complementary error function (Numerical approximation, |error| < 1.2e-7)."""
    t = 1.0 / (1.0 + 0.5 * F.abs(z) / 2 ** 0.5)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return F.least(F.lit(1.0), t * F.exp(-z * z / 2.0 + poly))


#: Distinct values of one feature and subject in a packed row of the iterations.
CHUNK_VALUES = 4096


def subject_logit(
    long: DataFrame, groups: Sequence[str], subject: str = "subject_id", min_rows: int = 40, max_iter: int = 25, tol: float = 1e-8
) -> DataFrame:
    """Logistic regression of a binary label on every standardised feature with one intercept per subject: beta and Wald p.

    ``long`` holds ``feature``, ``value``, ``y`` and the subject; all features and groups are fitted together. The subject
    block of the Hessian is diagonal, so a Newton step needs six sums per (feature, subject) and a correction of the slope
    by them: no dummy columns, nothing but the number of open features on the driver. Equal values are counted once and
    packed in chunks spread by value, so a hot subject is many rows of every step. Subjects of one class have their
    intercept at infinity and take no part in the slope.

    One row per group and feature. NULL beta and p: fewer than ``min_rows`` rows, one class, no spread, no subject with
    both classes, or no convergence (the deviance still falls after ``max_iter`` steps: classes are separated).
    """
    names = [*groups, "feature"]
    keys = [f"__g{i}" for i in range(len(names))]
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rows = long.where(finite & F.col("y").isNotNull() & F.col(subject).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(names, keys)], F.col(subject).alias("__s"), F.col("value").cast("double").alias("__x"), F.col("y").cast("long").alias("__y"))
    values = rows.groupBy(*keys, "__s", "__x").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("k"))
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("__x").alias("__m"), F.stddev_samp("__x").alias("__sd"), F.min("__y").alias("__lo"), F.max("__y").alias("__hi"))
    stats = written(stats.withColumn("__ok", (F.col("rows") >= min_rows) & (F.col("__lo") < F.col("__hi")) & (F.col("__sd") >= 1e-12)))
    sizes = rows.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__n"), F.sum("__y").alias("__k")).where("__k > 0 and __k < __n")
    used = null_safe_join(sizes, stats.where("__ok").select(*keys, "__m", "__sd"), keys, "inner")
    chunk = F.pmod(F.xxhash64("__x"), F.ceil(F.col("__n") / CHUNK_VALUES))
    scaled = null_safe_join(values, used, [*keys, "__s"], "inner").withColumn("x", (F.col("__x") - F.col("__m")) / F.col("__sd"))
    chunks = written(scaled.groupBy(*keys, "__s", chunk.alias("__c")).agg(F.collect_list(F.struct("x", "n", "k")).alias("__v")))
    state = written(used.select(
        *keys, "__s", F.log(F.col("__k") / (F.col("__n") - F.col("__k"))).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("dev"), F.lit(False).alias("done"),
        F.lit(None).cast("double").alias("info")))
    eta = F.col("a") + F.col("b") * F.col("x")
    tail = F.log1p(F.exp(-F.abs(eta)))  # log(1 + e^-|eta|) does not overflow
    p = F.when(eta >= 0, 1.0 / (1.0 + F.exp(-F.abs(eta)))).otherwise(1.0 - 1.0 / (1.0 + F.exp(-F.abs(eta))))
    w, r = F.col("n") * F.col("p") * (1.0 - F.col("p")), F.col("k") - F.col("n") * F.col("p")
    deviance = 2.0 * (F.col("k") * (tail + F.greatest(-eta, F.lit(0.0))) + (F.col("n") - F.col("k")) * (tail + F.greatest(eta, F.lit(0.0))))
    for _ in range(max_iter):
        opened = null_safe_join(chunks, state.where("not done").select(*keys, "__s", "a", "b"), [*keys, "__s"], "inner")
        at = opened.select(*keys, "__s", "a", "b", F.inline("__v")).withColumns({"p": p, "d": deviance})
        sums = at.groupBy(*keys, "__s").agg(
            F.sum(r).alias("r"), F.sum(r * F.col("x")).alias("rx"), F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("x") * F.col("x")).alias("wxx"),
            F.sum("d").alias("d"))
        sums = sums.withColumn("w", F.greatest("w", F.lit(1e-300)))
        steps = sums.groupBy(*keys).agg(
            F.sum(F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")).alias("now_info"), F.sum(F.col("rx") - F.col("wx") * F.col("r") / F.col("w")).alias("g"), F.sum("d").alias("now_dev"))
        moved = null_safe_join(null_safe_join(state, sums.select(*keys, "__s", "r", "w", "wx"), [*keys, "__s"]), steps, keys)
        db = F.when(F.col("now_info") > 1e-12, F.col("g") / F.col("now_info")).otherwise(F.lit(0.0))
        settled = F.abs(F.col("now_dev") - F.col("dev")) / (F.abs(F.col("now_dev")) + 0.1) < tol
        state = written(moved.select(
            *keys, "__s", F.when(F.col("done"), F.col("a")).otherwise(F.col("a") + (F.col("r") - F.col("wx") * db) / F.col("w")).alias("a"),
            F.when(F.col("done"), F.col("b")).otherwise(F.col("b") + db).alias("b"), F.when(F.col("done"), F.col("dev")).otherwise(F.col("now_dev")).alias("dev"),
            (F.col("done") | settled).alias("done"), F.when(F.col("done"), F.col("info")).otherwise(F.col("now_info")).alias("info")))
        if not state.where("not done").take(1):
            break
    fits = state.groupBy(*keys).agg(F.min("b").alias("__b"), F.min("info").alias("__info"), F.every("done").alias("__done"))
    ok = F.col("__done") & (F.col("__info") > 1e-12)
    return null_safe_join(stats, fits, keys).select(
        *[F.col(k).alias(c) for c, k in zip(names, keys)], "rows", F.when(ok, F.col("__b")).alias("beta"), F.when(ok, normal_p(F.col("__b") * F.sqrt("__info"))).alias("p"))
