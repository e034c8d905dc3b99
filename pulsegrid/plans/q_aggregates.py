"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.labels import BIN_SCHEMES, right_closed_bin
from pulsegrid.operators import aggregates as agg
from pulsegrid.operators.scale import exact_quantiles, null_safe_join
from pulsegrid.plans.q_columns import LABELED_SQL, _bin_sql, labeled_rows
from pulsegrid.plans.registry import query, table
from pulsegrid.plans.views import CHANNELS, STREAM_SQL, events_stream, r6, rounded

NRS = _bin_sql(*BIN_SCHEMES["nrs"])


@query(
    "label_distribution",
    f"""WITH {LABELED_SQL} SELECT dataset_id, round(target, 6) AS level, {NRS.replace('v ', 'target ')} AS pain_bin, count(*) AS rows,
      count(DISTINCT user_id) AS subjects, count(DISTINCT event_type) AS segments FROM fam GROUP BY dataset_id, target""",
)
def label_distribution(spark, sf):
    rows = labeled_rows(spark, sf).withColumn("level", r6("target_pain_nrs_0_10"))
    rows = rows.withColumn("pain_bin", right_closed_bin("target_pain_nrs_0_10", *BIN_SCHEMES["nrs"]))
    return agg.label_distribution(rows, ["dataset_id", "level", "pain_bin"], {"subjects": "user_id", "segments": "event_type"})


@query(
    "group_summary",
    f"""WITH {STREAM_SQL} SELECT dataset_id, {NRS.replace('v ', 'pain ')} AS pain_bin, {', '.join(f'''count({c}) AS {c}__count,
      round(median({c}), 6) AS {c}__median, round(avg({c}), 6) AS {c}__mean, round(stddev_samp({c}), 6) AS {c}__std''' for c in CHANNELS)}
    FROM stream GROUP BY ALL""",
)
def group_summary(spark, sf):
    rows = events_stream(spark, sf).withColumn("pain_bin", right_closed_bin("pain_intensity", *BIN_SCHEMES["nrs"]))
    return rounded(agg.group_summary(rows, ["dataset_id", "pain_bin"], list(CHANNELS)))


@query(
    "partial_final_counts",
    """SELECT l_returnflag, CASE WHEN l_linenumber < 6 THEN CAST(l_linenumber AS DOUBLE) END AS level, count(*) AS rows, count(DISTINCT l_suppkey) AS subjects
    FROM lineitem GROUP BY ALL""",
)
def partial_final_counts(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", F.when(F.col("l_linenumber") < 6, F.col("l_linenumber").cast("double")).alias("level"))
    return agg.label_distribution(li, ["l_returnflag", "level"], {"subjects": "l_suppkey"})


@query(
    "session_target_summary",
    f"WITH {STREAM_SQL} SELECT dataset_id, session_id, round(min(pain), 6) AS pain_min, round(max(pain), 6) AS pain_max, count(pain) AS pain_labeled_rows FROM stream GROUP BY ALL",
)
def session_target_summary(spark, sf):
    return rounded(agg.session_target_summary(events_stream(spark, sf), ["dataset_id", "session_id"], "pain_intensity"))


@query(
    "workout_summary",
    """SELECT o_orderpriority AS workout_type, count(*) AS workouts, round(median(o_totalprice), 6) AS duration_min_median,
      round(avg(o_totalprice), 6) AS duration_min_mean, round(median(e), 6) AS total_energy_median
    FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS DOUBLE) END AS e FROM orders) GROUP BY ALL""",
)
def workout_summary(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("workout_type"), F.col("o_totalprice").alias("duration_min"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("double")).alias("total_energy"))
    q = exact_quantiles(o, ["workout_type"], ["duration_min", "total_energy"], (0.5,))
    base = o.groupBy("workout_type").agg(F.count(F.lit(1)).alias("workouts"), F.avg("duration_min").alias("duration_min_mean"))
    out = null_safe_join(base, q, ["workout_type"])
    return rounded(out.withColumnsRenamed({"duration_min__q500": "duration_min_median", "total_energy__q500": "total_energy_median"}))


@query(
    "sensor_coverage",
    f"WITH {STREAM_SQL} SELECT dataset_id, {', '.join(f'round(avg(CAST({c} IS NOT NULL AS INTEGER)), 6) AS {c}__present' for c in CHANNELS)} FROM stream GROUP BY dataset_id",
)
def sensor_coverage(spark, sf):
    s = events_stream(spark, sf).select("dataset_id", *[F.col(c).isNotNull().cast("int").alias(f"{c}__present") for c in CHANNELS])
    return rounded(agg.sensor_coverage(s, "dataset_id", [f"{c}__present" for c in CHANNELS]))


@query(
    "state_means",
    """SELECT dataset_id, family, round(avg(a), 4) AS a, round(avg(b), 4) AS b FROM (SELECT n_name AS dataset_id, c_mktsegment AS family,
      c_acctbal / 7.0 AS a, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey AS DOUBLE) END AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)
    WHERE b IS NOT NULL GROUP BY ALL""",
)
def state_means(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf, "customer").join(n, "c_nationkey").select(
        F.col("n_name").alias("dataset_id"), F.col("c_mktsegment").alias("family"), (F.col("c_acctbal") / 7.0).alias("a"),
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey").cast("double")).alias("b"))
    return agg.group_means(c, ["dataset_id", "family"], ["a", "b"])


@query(
    "protocol_summary",
    """SELECT l_returnflag AS learner, CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_linestatus END AS protocol, count(*) AS rows,
      round(avg(l_discount), 6) AS mean, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
      round(quantile_cont(l_extendedprice, 0.75), 6) AS q75 FROM lineitem GROUP BY ALL""",
)
def protocol_summary(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("learner"), F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("protocol"),
        "l_extendedprice", "l_discount")
    keys = ["learner", "protocol"]
    q = exact_quantiles(li, keys, ["l_extendedprice"], (0.25, 0.5, 0.75)).withColumnsRenamed({
        "l_extendedprice__q250": "q25", "l_extendedprice__q500": "median", "l_extendedprice__q750": "q75"})
    return rounded(null_safe_join(li.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg("l_discount").alias("mean")), q, keys))


@query(
    "both_class_subjects",
    "WITH d AS (SELECT lang, source, count(DISTINCT quality) AS c FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT lang AS dataset_id, count(*) FILTER (WHERE c = 2) AS both_class_subjects FROM d GROUP BY lang",
)
def both_class_subjects(spark, sf):
    from pulsegrid.plans.views import evaluation

    return agg.both_class_subjects(evaluation(spark, sf), ["dataset_id"], "subject_id", "y")


@query(
    "class_counts_gsets",
    f"WITH {LABELED_SQL} SELECT dataset_id, label_family, count(*) AS rows, count(DISTINCT user_id) AS subjects FROM fam GROUP BY GROUPING SETS ((dataset_id), (dataset_id, label_family))",
)
def class_counts_gsets(spark, sf):
    from pulsegrid.functions.labels import add_common_labels

    rows = add_common_labels(labeled_rows(spark, sf)).select("dataset_id", "label_family", "user_id")
    sets = [[F.col("dataset_id")], [F.col("dataset_id"), F.col("label_family")]]
    return rows.groupingSets(sets, "dataset_id", "label_family").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("subjects"))


@query(
    "observed_values",
    f"WITH {STREAM_SQL} SELECT dataset_id, session_id, list_sort(list(DISTINCT covas // 10)) AS pain_values_observed FROM (SELECT *, CAST(covas AS BIGINT) AS c2 FROM stream) GROUP BY ALL".replace("covas // 10", "c2 // 10"),
)
def observed_values(spark, sf):
    s = events_stream(spark, sf).withColumn("v", F.floor(F.col("source_pain_covas_0_100") / 10))
    return agg.observed_values(s, ["dataset_id", "session_id"], "v", "pain_values_observed")


@query(
    "side_scores_unpivot",
    """WITH m AS (SELECT o_custkey, o_orderpriority, max(o_orderkey % 11) AS v FROM orders GROUP BY ALL)
    SELECT 's' || CAST(o_custkey AS VARCHAR) AS subject_id, round(avg(v), 6) AS target_stress_score_mean_0_10, CAST(max(v) AS DOUBLE) AS target_stress_score_0_10 FROM m GROUP BY ALL""",
)
def side_scores_unpivot(spark, sf):
    """A subject x phase score matrix (pivoted here) back to one mean and one maximum per subject."""
    from pulsegrid.sources.sidetables import score_matrix

    phases = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = table(spark, sf, "orders").withColumn("v", (F.col("o_orderkey") % 11).cast("double")).groupBy(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("subject")).pivot("o_orderpriority", phases).agg(F.max("v"))
    return rounded(score_matrix(wide, "subject"))
