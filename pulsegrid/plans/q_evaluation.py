"""Sampling, feature selection, splits, metrics and feature statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import folds as FO
from pulsegrid.operators import metrics as M
from pulsegrid.operators import sampling as SA
from pulsegrid.operators import select as SE
from pulsegrid.operators.scale import exact_quantiles, null_safe_join
from pulsegrid.plans.q_columns import task_input
from pulsegrid.plans.registry import query, table
from pulsegrid.plans.views import EVAL_SQL, evaluation, r6, rounded, signals

# Feature table: the 64 vector components named as sensor features, with gaps, ties and degenerate columns.
SENSOR_NAMES, GROUP_NAMES, STEMS = ("hr", "eda", "acc", "ibi"), ("base", "shape", "shuffle", "quality"), ("mean", "std", "median", "mad")
FEATURE_NAMES = [f"{SENSOR_NAMES[(i // 4) % 4]}__{GROUP_NAMES[i % 4]}__{STEMS[i // 16]}" for i in range(64)]

FEAT_SQL = f"""base AS (SELECT vec_id, 'g' || CAST(vec_id % 4 AS VARCHAR) AS dataset_id, vec_id % 25 AS subject_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
    unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings),
feat AS (SELECT vec_id AS row_id, dataset_id, subject_id, y, i, ({FEATURE_NAMES!r})[i + 1] AS feature,
    CASE WHEN (vec_id + i) % 13 = 0 OR i = 13 OR (i = 5 AND dataset_id = 'g1') THEN NULL WHEN i = 8 THEN CAST(e > 0 AS DOUBLE)
      ELSE round(CAST(e AS DOUBLE), 2) END AS value FROM base)"""


def feature_wide(spark, sf):
    cols = []
    for i, n in enumerate(FEATURE_NAMES):
        e = F.get("x", i)
        v = F.when(e > 0, 1.0).otherwise(0.0) if i == 8 else F.round(e, 2)
        gap = ((F.col("signal_id") + i) % 13 == 0) | F.lit(i == 13)
        if i == 5:
            gap = gap | (F.col("dataset_id") == "g1")
        cols.append(F.when(~gap, v).alias(n))
    return signals(spark, sf).select(F.col("signal_id").alias("row_id"), "dataset_id", "subject_id", "y", *cols)


def feature_long(spark, sf):
    return feature_wide(spark, sf).unpivot(["row_id", "dataset_id", "subject_id", "y"], FEATURE_NAMES, "feature", "value")


def _picked(spark, names):
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "position long, feature string")


@query(
    "feature_select",
    f"""WITH {FEAT_SQL} SELECT row_number() OVER (ORDER BY i) AS position, feature FROM (SELECT i, feature FROM feat
      WHERE regexp_matches(feature, '^(hr|acc|ibi)__') GROUP BY ALL HAVING count(value) > 0)""",
)
def feature_select(spark, sf):
    return _picked(spark, SE.feature_columns(feature_wide(spark, sf), "apple_watch_like"))


@query(
    "coverage_rank",
    f"""WITH {FEAT_SQL} SELECT row_number() OVER (ORDER BY n DESC, feature) AS position, feature FROM (SELECT feature, count(value) AS n FROM feat
      WHERE regexp_matches(feature, '^(hr|acc|ibi)__(base__(mean|std)|shape__(median|mad))$') GROUP BY ALL HAVING count(value) > 0)""",
)
def coverage_rank(spark, sf):
    return _picked(spark, SE.profile_arm_columns(feature_wide(spark, sf), "watch_core", "autonomic_space"))


@query("feature_group", f"WITH {FEAT_SQL} SELECT split_part(feature, '__', 2) AS feature_group, count(*) AS rows, count(value) AS finite FROM feat GROUP BY ALL")
def feature_group(spark, sf):
    return feature_long(spark, sf).groupBy(SE.feature_group(F.col("feature")).alias("feature_group")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("finite"))


VALID_SQL = f"""{FEAT_SQL}, valid AS (SELECT dataset_id, feature, count(*) AS rows, count(value) AS finite FROM feat GROUP BY ALL
  HAVING count(value) >= greatest(30, count(*) * 0.5) AND count(DISTINCT value) > 2)"""


@query("valid_features", f"WITH {VALID_SQL} SELECT * FROM valid")
def valid_features(spark, sf):
    return SE.valid_features(feature_long(spark, sf), ["dataset_id"])


@query(
    "common_features",
    f"WITH {FEAT_SQL} SELECT feature FROM (SELECT feature, dataset_id, count(value) AS n FROM feat GROUP BY ALL) GROUP BY feature HAVING min(n) > 0",
)
def common_features(spark, sf):
    return SE.common_features(feature_long(spark, sf))


AUC_SQL = """rk AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {s}) + (count(*) OVER (PARTITION BY {k}, {s}) - 1) / 2.0 AS r FROM {t} WHERE {s} IS NOT NULL),
auc AS (SELECT {k}, CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END AS auc FROM rk GROUP BY ALL)"""
FEAT_AUC_SQL = f"{VALID_SQL}, vf AS (SELECT feat.* FROM feat JOIN valid USING (dataset_id, feature)), " + AUC_SQL.format(
    k="dataset_id, feature", s="value", t="vf")


def _ranking(spark, sf):
    long = feature_long(spark, sf)
    keep = SE.valid_features(long, ["dataset_id"]).select("dataset_id", "feature")
    return M.univariate_ranking(long.join(keep, ["dataset_id", "feature"]), ["dataset_id"])


@query("univariate_auc_rank", f"WITH {FEAT_AUC_SQL} SELECT dataset_id, feature, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS oriented_auc FROM auc")
def univariate_auc_rank(spark, sf):
    return rounded(_ranking(spark, sf))


@query(
    "topk_per_group",
    f"""WITH {FEAT_AUC_SQL}, o AS (SELECT dataset_id, feature, round(greatest(auc, 1 - auc), 9) AS a FROM auc)
    SELECT dataset_id, feature, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY a DESC, feature) AS r FROM o) WHERE r <= 10""",
)
def topk_per_group(spark, sf):
    ranked = _ranking(spark, sf).withColumn("a", F.round("oriented_auc", 9))
    return SA.top_k(ranked, ["dataset_id"], [F.col("a").desc(), F.col("feature")], 10, "rank").select("dataset_id", "feature", "rank")


SVS_SQL = f"""{FEAT_AUC_SQL}, o AS (SELECT dataset_id, feature, greatest(auc, 1 - auc) AS a FROM auc),
svs AS (SELECT s.dataset_id, s.feature AS shape_feature, h.feature AS shuffle_feature, s.a AS sa, h.a AS ha FROM o s
  JOIN o h ON h.dataset_id = s.dataset_id AND h.feature = replace(s.feature, '__shape__', '__shuffle__') WHERE contains(s.feature, '__shape__'))"""


@query(
    "shape_vs_shuffle",
    f"WITH {SVS_SQL} SELECT dataset_id, shape_feature, shuffle_feature, round(sa, 6) AS shape_oriented_auc, round(ha, 6) AS shuffle_oriented_auc, round(sa - ha, 6) + 0.0 AS order_advantage FROM svs",
)
def shape_vs_shuffle(spark, sf):
    return rounded(M.shape_vs_shuffle(_ranking(spark, sf), ["dataset_id"]))


@query(
    "order_advantage",
    f"""WITH {SVS_SQL} SELECT dataset_id, round(median(sa - ha), 6) + 0.0 AS median_order_advantage, round(quantile_cont(sa - ha, 0.9), 6) + 0.0 AS p90_order_advantage,
      round(avg(CAST(sa - ha > 0.02 AS DOUBLE)), 6) AS fraction_order_advantage_gt_002 FROM svs GROUP BY dataset_id""",
)
def order_advantage(spark, sf):
    v = M.shape_vs_shuffle(_ranking(spark, sf), ["dataset_id"])
    q = exact_quantiles(v, ["dataset_id"], ["order_advantage"], (0.5, 0.9)).withColumnsRenamed(
        {"order_advantage__q500": "median_order_advantage", "order_advantage__q900": "p90_order_advantage"})
    frac = v.groupBy("dataset_id").agg(F.avg((F.col("order_advantage") > 0.02).cast("double")).alias("fraction_order_advantage_gt_002"))
    return rounded(null_safe_join(q, frac, ["dataset_id"]))


FDR_SQL = """pv AS (SELECT c_custkey, c_nationkey, c_mktsegment, CASE WHEN c_custkey % 7 > 0 THEN round(power((c_acctbal + 1000.0) / 11000.0, 6), 4) END AS p FROM customer),
rk AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS m, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS i FROM pv WHERE p IS NOT NULL),
adj AS (SELECT *, least(1.0, min(p * m / i) OVER (PARTITION BY c_nationkey ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM rk)"""


def _p_values(spark, sf):
    p = F.round(F.pow((F.col("c_acctbal") + 1000.0) / 11000.0, F.lit(6)), 4)
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 > 0, p).alias("p"))


@query("bh_fdr", f"WITH {FDR_SQL} SELECT c_custkey, round(pv.p, 6) AS p, round(fdr, 6) AS fdr FROM pv LEFT JOIN (SELECT c_custkey, fdr FROM adj) USING (c_custkey)")
def bh_fdr(spark, sf):
    return rounded(M.bh_fdr(_p_values(spark, sf), ["c_nationkey"]).select("c_custkey", "p", "fdr"))


@query("significant_counts", f"WITH {FDR_SQL} SELECT c_mktsegment AS feature_group, count(*) AS significant_features_fdr_005 FROM adj WHERE fdr < 0.05 GROUP BY ALL")
def significant_counts(spark, sf):
    f = M.bh_fdr(_p_values(spark, sf), ["c_nationkey"])
    return f.where(F.col("fdr") < 0.05).groupBy(F.col("c_mktsegment").alias("feature_group")).agg(
        F.count(F.lit(1)).alias("significant_features_fdr_005"))


CORR_NAMES = [n for n in FEATURE_NAMES if "__shape__" in n]


@query(
    "corr_redundancy",
    f"""WITH {FEAT_SQL}, s AS (SELECT * FROM feat WHERE contains(feature, '__shape__') AND value IS NOT NULL)
    SELECT a.dataset_id, a.feature AS feature_a, b.feature AS feature_b, count(*) AS n, round(corr(a.value, b.value), 6) + 0.0 AS corr, abs(corr(a.value, b.value)) >= 0.95 AS redundant
    FROM s a JOIN s b ON a.row_id = b.row_id AND a.i < b.i GROUP BY ALL""",
)
def corr_redundancy(spark, sf):
    pairs = M.correlation_pairs(feature_wide(spark, sf), ["dataset_id"], CORR_NAMES)
    return rounded(pairs.where(F.col("n") > 0).withColumn("redundant", F.abs("corr") >= 0.95))


@query(
    "top_redundancy",
    f"""WITH {FEAT_AUC_SQL}, o AS (SELECT dataset_id, feature, round(greatest(auc, 1 - auc), 9) AS a FROM auc WHERE contains(feature, '__shape__') AND auc IS NOT NULL),
    top AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY a DESC, feature) <= 30), t AS (SELECT row_id, dataset_id, feature, value FROM feat JOIN top USING (dataset_id, feature) WHERE value IS NOT NULL),
    c AS (SELECT a.dataset_id, a.feature AS fa, b.feature AS fb, corr(a.value, b.value) AS r FROM t a JOIN t b ON a.row_id = b.row_id AND a.feature < b.feature GROUP BY ALL),
    red AS (SELECT dataset_id, count(*) AS n FROM c WHERE NOT isnan(r) AND abs(r) >= 0.95 GROUP BY ALL)
    SELECT dataset_id, count(*) AS top_features, coalesce(any_value(n), 0) AS redundant_pairs FROM top LEFT JOIN red USING (dataset_id) GROUP BY ALL HAVING count(*) >= 2""",
)
def top_redundancy(spark, sf):
    ranking = _ranking(spark, sf).withColumn("oriented_auc", F.round("oriented_auc", 9))
    return M.top_redundancy(feature_wide(spark, sf), ranking, ["dataset_id"], CORR_NAMES)


# Binary metrics ---------------------------------------------------------------------------------

P_SQL = f"{EVAL_SQL}, pe AS (SELECT *, score / (score + 2000.0) AS p FROM ev)"


def _scored(spark, sf):
    return evaluation(spark, sf).withColumn("p", F.col("score") / (F.col("score") + 2000.0))


@query("metric_auc", f"WITH {EVAL_SQL}, {AUC_SQL.format(k='dataset_id', s='score', t='ev')} SELECT dataset_id, round(auc, 6) AS auc FROM auc")
def metric_auc(spark, sf):
    return rounded(M.ranking_metrics(evaluation(spark, sf), ["dataset_id"]).select("dataset_id", "auc"))


@query(
    "metric_ap",
    f"""WITH {EVAL_SQL}, g AS (SELECT dataset_id, score, sum(y) AS n1, count(*) AS n FROM ev GROUP BY ALL),
    c AS (SELECT *, sum(n1) OVER w AS tp, sum(n) OVER w AS tot, sum(n1) OVER (PARTITION BY dataset_id) AS pos FROM g WINDOW w AS (PARTITION BY dataset_id ORDER BY score DESC))
    SELECT dataset_id, CASE WHEN any_value(pos) > 0 AND any_value(pos) < sum(n) THEN round(sum(n1 / pos * (tp / tot)), 6) END AS average_precision FROM c GROUP BY dataset_id""",
)
def metric_ap(spark, sf):
    return rounded(M.ranking_metrics(evaluation(spark, sf), ["dataset_id"]).select("dataset_id", "average_precision"))


@query("metric_brier", f"WITH {P_SQL} SELECT dataset_id, count(*) AS rows, round(avg(y), 6) AS prevalence, round(avg((p - y) * (p - y)), 6) AS brier FROM pe GROUP BY dataset_id")
def metric_brier(spark, sf):
    return rounded(M.probability_metrics(_scored(spark, sf), ["dataset_id"]).select("dataset_id", "rows", "prevalence", "brier"))


@query(
    "metric_balanced_acc",
    f"""WITH {P_SQL} SELECT dataset_id, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy,
      round((avg(CAST(p >= 0.5 AS DOUBLE)) FILTER (WHERE y = 1) + avg(CAST(p < 0.5 AS DOUBLE)) FILTER (WHERE y = 0)) / 2, 6) AS balanced_accuracy FROM pe GROUP BY dataset_id""",
)
def metric_balanced_acc(spark, sf):
    return rounded(M.probability_metrics(_scored(spark, sf), ["dataset_id"]).select("dataset_id", "accuracy", "balanced_accuracy"))


@query(
    "auc_by_subject",
    f"""WITH {EVAL_SQL}, {AUC_SQL.format(k='subject_id', s='score', t='ev')} SELECT count(auc) AS subjects, round(median(auc), 6) AS subject_auc_median,
      round(min(auc), 6) AS subject_auc_min, round(max(auc), 6) AS subject_auc_max FROM auc""",
)
def auc_by_subject(spark, sf):
    per = M.ranking_metrics(evaluation(spark, sf), ["subject_id"])
    med = exact_quantiles(per, [], ["auc"], (0.5,)).first()[0]
    return rounded(per.agg(F.count("auc").alias("subjects"), F.lit(med).cast("double").alias("subject_auc_median"),
                           F.min("auc").alias("subject_auc_min"), F.max("auc").alias("subject_auc_max")))


@query(
    "calibration_error",
    f"""WITH {P_SQL}, b AS (SELECT dataset_id, least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM pe GROUP BY ALL)
    SELECT dataset_id, CAST(sum(n) AS BIGINT) AS rows, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b GROUP BY dataset_id""",
)
def calibration_error(spark, sf):
    return rounded(M.calibration_error(_scored(spark, sf), ["dataset_id"]))


@query(
    "lodo_split_stats",
    f"""WITH {EVAL_SQL}, t AS (SELECT count(*) AS n, sum(y) AS p FROM ev)
    SELECT dataset_id AS heldout, any_value(n) - count(*) AS train_rows, count(*) AS test_rows, round(avg(y), 6) AS prevalence,
      sum(y) > 0 AND sum(y) < count(*) AND any_value(p) - sum(y) > 0 AND any_value(p) - sum(y) < any_value(n) - count(*) AS usable FROM ev, t GROUP BY dataset_id""",
)
def lodo_split_stats(spark, sf):
    return rounded(FO.leave_one_out_stats(evaluation(spark, sf), "dataset_id", "y"))


@query(
    "group_kfold",
    """WITH RECURSIVE g AS (SELECT user_id, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, user_id) AS i FROM events GROUP BY user_id),
    a AS (SELECT 0 AS i, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS rows, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS l
      UNION ALL SELECT CAST(g.i AS INTEGER), g.user_id, g.rows, list_position(a.l, list_min(a.l)) - 1,
        list_transform(range(5), lambda j: a.l[j + 1] + CASE WHEN j = list_position(a.l, list_min(a.l)) - 1 THEN g.rows ELSE 0 END)
      FROM a JOIN g ON g.i = a.i + 1)
    SELECT user_id, rows, CAST(fold AS INTEGER) AS fold FROM a WHERE user_id IS NOT NULL""",
)
def group_kfold(spark, sf):
    return FO.group_kfold(table(spark, sf, "events").select("user_id"), "user_id", 5)


# Sampling -----------------------------------------------------------------------------------------


@query(
    "even_spaced_sample",
    """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, event_id FROM e WHERE n <= 10 OR i IN (SELECT unnest([CAST(round_even(j * (n - 1) / 9.0, 0) AS BIGINT) FOR j IN range(10)]))""",
)
def even_spaced_sample(spark, sf):
    rows = table(spark, sf, "events").select(
        F.lit("d").alias("dataset_id"), F.col("user_id").alias("session_id"), "event_id", (F.col("user_id") % 2).alias("y"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("window_end_s"))
    return SA.sample_windows(rows, 10, 42).select(F.col("session_id").alias("user_id"), "event_id")


@query("balanced_sample")
def balanced_sample(spark, sf):
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset_id"), F.col("user_id").cast("string").alias("session_id"),
        "event_id", ((F.col("user_id") / 3).cast("long") % 2).alias("y"))
    return SA.balanced_sessions(rows, 20, 20260609).groupBy("dataset_id", "session_id", "y").agg(F.count(F.lit(1)).alias("rows"))


@query("mixed_class_sample")
def mixed_class_sample(spark, sf):
    rows = table(spark, sf, "events").select(
        F.lit("d").alias("dataset_id"), F.col("user_id").alias("session_id"), "event_id", (F.col("value") > 40).cast("int").alias("y"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("window_end_s"))
    return SA.sample_windows(rows, 10, 42).select("session_id", "event_id", "y")


@query("anchor_table")
def anchor_table(spark, sf):
    return rounded(SA.anchor_table(task_input(spark, sf), 10, 6))


# Score cards: a metric table derived from the line items --------------------------------------------

SCREEN_SQL = """screen AS (SELECT l_returnflag AS target, (['watch_core', 'chest_reference', 'native_full', 'watch_plus_eda'])[l_linenumber % 4 + 1] AS profile,
    'arm' || CAST(l_suppkey % 6 AS VARCHAR) AS arm, round(avg(l_discount) * 10, 9) AS auc, count(*) AS rows FROM lineitem GROUP BY ALL)"""


def _screen(spark, sf):
    names = F.array(*[F.lit(n) for n in ("watch_core", "chest_reference", "native_full", "watch_plus_eda")])
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("target"), F.get(names, F.col("l_linenumber") % 4).alias("profile"),
        F.concat(F.lit("arm"), (F.col("l_suppkey") % 6).cast("string")).alias("arm"),
    ).agg(F.round(F.avg("l_discount") * 10, 9).alias("auc"), F.count(F.lit(1)).alias("rows"))


@query(
    "finalists_union",
    f"""WITH {SCREEN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY auc DESC, profile, arm) AS r0,
      row_number() OVER (PARTITION BY target, profile ORDER BY auc DESC, arm) AS r1 FROM screen)
    SELECT target, profile, arm, round(auc, 6) AS auc, rows FROM r WHERE r0 = 1 OR (r1 = 1 AND profile IN ('watch_core', 'chest_reference'))""",
)
def finalists_union(spark, sf):
    return rounded(SA.finalists(_screen(spark, sf)))


@query(
    "best_by_metric",
    f"WITH {SCREEN_SQL} SELECT target, profile, arm, round(auc, 6) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY target, profile ORDER BY auc DESC, arm) AS r FROM screen) WHERE r = 1",
)
def best_by_metric(spark, sf):
    return rounded(M.best_by(_screen(spark, sf), ["target", "profile"], "arm", "auc"))


@query("scorecard_slice", f"WITH {SCREEN_SQL} SELECT target, profile, arm, round(auc, 6) AS auc FROM screen WHERE profile LIKE 'watch%' AND arm IN ('arm1', 'arm3')")
def scorecard_slice(spark, sf):
    return rounded(_screen(spark, sf).where(F.col("profile").startswith("watch") & F.col("arm").isin("arm1", "arm3")).drop("rows"))
