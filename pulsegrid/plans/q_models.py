"""Model queries. MLlib optimisers have no SQL twin: these are checked by rows here and by value in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.scoring import portable_logistic
from pulsegrid.operators import ml
from pulsegrid.operators.scale import exact_quantiles
from pulsegrid.plans.q_evaluation import FEAT_SQL, FEATURE_NAMES, feature_long, feature_wide
from pulsegrid.plans.registry import query
from pulsegrid.plans.views import rounded

BASE_FEATURES = [n for n in FEATURE_NAMES if "__base__" in n and n not in ("ibi__base__mean",)]


def _rows(spark, sf):
    wide = feature_wide(spark, sf)
    return wide.withColumn("subject_group", F.concat_ws("::", "dataset_id", F.col("subject_id").cast("string")))


_IMPUTED = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in BASE_FEATURES)


@query(
    "impute_scale",
    f"""WITH {FEAT_SQL}, wide AS (SELECT row_id, {', '.join(f"max(value) FILTER (WHERE feature = '{c}') AS {c}" for c in BASE_FEATURES)} FROM feat GROUP BY row_id),
    med AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in BASE_FEATURES)} FROM wide), f AS (SELECT row_id, {_IMPUTED} FROM wide, med)
    SELECT row_id, {', '.join(f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0 AS {c}' for c in BASE_FEATURES)} FROM f""",
)
def impute_scale(spark, sf):
    """Median imputation and standardisation as fitted constants: two one-row aggregates, then one projection."""
    cols = BASE_FEATURES
    rows = _rows(spark, sf).select("row_id", *cols)
    med = exact_quantiles(rows, [], cols, (0.5,)).first()
    filled = rows.fillna({c: med[f"{c}__q500"] for c in cols})
    stat = filled.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return rounded(filled.select("row_id", *[((F.col(c) - stat[f"{c}_m"]) / stat[f"{c}_s"]).alias(c) for c in cols]))


@query("ml_logistic")
def ml_logistic(spark, sf):
    rows = _rows(spark, sf)
    return rounded(ml.fit("portable_logistic", rows, BASE_FEATURES, "y").transform(rows).select("row_id", "y", "p"))


@query("ml_oof")
def ml_oof(spark, sf):
    return rounded(ml.evaluate(ml.out_of_fold(_rows(spark, sf), BASE_FEATURES, "y", "subject_group", "elastic_net", 3), ["fold"], "y", learner="elastic_net"))


@query("ml_leave_dataset_out")
def ml_leave_dataset_out(spark, sf):
    return rounded(ml.evaluate(ml.leave_dataset_out(_rows(spark, sf), BASE_FEATURES, "y", "portable_logistic"), ["split"], "y"))


@query("dataset_only_control")
def dataset_only_control(spark, sf):
    rows, dummies = ml.dataset_dummies(_rows(spark, sf))
    return rounded(ml.evaluate(ml.out_of_fold(rows, dummies, "y", "subject_group", "portable_logistic", 3), [], "y", feature_set="dataset_only"))


@query("ml_portable_export")
def ml_portable_export(spark, sf):
    """Exported constants scored by a generated expression: same probabilities as the fitted pipeline."""
    rows = _rows(spark, sf)
    return rounded(rows.select("row_id", portable_logistic(rows, ml.export_portable(rows, BASE_FEATURES, "y")).alias("p")))


@query("glm_binomial")
def glm_binomial(spark, sf):
    """All base features under the operator's own row guard: no rows where fewer rows are complete."""
    return rounded(ml.glm_table(ml.glm_binomial(_rows(spark, sf), "y", BASE_FEATURES), BASE_FEATURES, spark))


@query(
    "subject_fixed_effect",
    f"""WITH {FEAT_SQL}, v AS (SELECT * FROM feat WHERE value IS NOT NULL),
    c AS (SELECT dataset_id, feature, subject_id, value, value - avg(value) OVER w AS x, y - avg(y) OVER w AS yy FROM v WINDOW w AS (PARTITION BY dataset_id, feature, subject_id)),
    s AS (SELECT dataset_id, feature, count(*) AS rows, sum(x * yy) AS sxy, sum(x * x) AS sxx, stddev_samp(value) AS sd, count(DISTINCT subject_id) AS k, sum(yy * yy) AS syy FROM c GROUP BY ALL)
    SELECT dataset_id, feature, rows, CASE WHEN rows >= 40 AND sxx > 1e-12 AND rows - k - 1 > 0 THEN round(sxy / sxx * sd, 6) + 0.0 END AS beta FROM s""",
)
def subject_fixed_effect(spark, sf):
    return rounded(ml.within_subject_effect(feature_long(spark, sf), ["dataset_id"]).drop("p"))


def _newton_sql(steps: int) -> str:
    """The same Newton steps as a chain of tables: all of them are taken, a settled fit does not move any more."""
    out = f"""WITH {FEAT_SQL}, v AS MATERIALIZED (SELECT dataset_id, feature, subject_id, value, y FROM feat WHERE value IS NOT NULL),
    st AS (SELECT dataset_id, feature, count(*) AS rows, avg(value) AS m, stddev_samp(value) AS sd, min(y) < max(y) AS two FROM v GROUP BY ALL),
    su AS (SELECT dataset_id, feature, subject_id, sum(y) AS k, count(*) AS n FROM v GROUP BY ALL HAVING sum(y) BETWEEN 1 AND count(*) - 1),
    z AS MATERIALIZED (SELECT dataset_id, feature, subject_id, (value - m) / sd AS x, y, k, n FROM v JOIN su USING (dataset_id, feature, subject_id) JOIN st USING (dataset_id, feature) WHERE rows >= 40 AND two AND sd >= 1e-12),
    s0 AS MATERIALIZED (SELECT DISTINCT dataset_id, feature, subject_id, ln(k / (n - k)) AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS info, 0.0::DOUBLE AS db FROM z)"""
    for i in range(steps):
        out += f""",
    q{i} AS (SELECT dataset_id, feature, subject_id, x, y, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM z JOIN s{i} USING (dataset_id, feature, subject_id)),
    u{i} AS MATERIALIZED (SELECT dataset_id, feature, subject_id, any_value(a) AS a, any_value(b) AS b, sum(y - p) AS r, sum((y - p) * x) AS rx, greatest(sum(p * (1 - p)), 1e-300) AS w, sum(p * (1 - p) * x) AS wx, sum(p * (1 - p) * x * x) AS wxx FROM q{i} GROUP BY ALL),
    g{i} AS (SELECT dataset_id, feature, sum(wxx - wx * wx / w) AS info, sum(rx - wx * r / w) AS g FROM u{i} GROUP BY ALL),
    h{i} AS (SELECT *, CASE WHEN info > 1e-12 THEN g / info ELSE 0 END AS db FROM g{i}),
    s{i + 1} AS MATERIALIZED (SELECT dataset_id, feature, subject_id, a + (r - wx * db) / w AS a, b + db AS b, info, db FROM u{i} JOIN h{i} USING (dataset_id, feature))"""
    return out + f""", fit AS (SELECT dataset_id, feature, any_value(b) AS b, any_value(info) AS info, any_value(db) AS db FROM s{steps} GROUP BY ALL)
    SELECT dataset_id, feature, rows, CASE WHEN info > 1e-12 AND abs(db) < 1e-6 THEN round(b, 5) + 0.0 END AS beta FROM st LEFT JOIN fit USING (dataset_id, feature)"""


@query("subject_logit", _newton_sql(25))
def subject_logit(spark, sf):
    """Subject-fixed-effect logistic slope of every feature and dataset; p is checked in the tests."""
    fitted = ml.subject_logit(feature_long(spark, sf), ["dataset_id"])
    return fitted.select("dataset_id", "feature", "rows", (F.round("beta", 5) + 0.0).alias("beta"))
