"""Canonical views of the shared tables: measurement stream, signals, evaluation rows, baselines.

Each view exists twice, as a DataFrame and as a SQL common table expression with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.scale import null_safe_join
from pulsegrid.operators.windows import WindowSpec
from pulsegrid.plans.registry import table

#: Event time is counted in six-hour ticks, so that the 1-tick grid satisfies the rate contract.
TICK_US = 21_600_000_000
CHANNELS = {"hr": "view", "eda": "click", "bvp": "purchase", "temperature": "signup", "ibi": "error"}
SPEC = WindowSpec(target_hz=1.0, window_seconds=12.0, min_window_rows=2, max_gap_seconds=8.0)


def us(col: str) -> Column:
    """Integer microseconds of a zone-less timestamp column (session zone is UTC)."""
    return F.unix_micros(F.col(col).cast("timestamp"))


def r6(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to six places (and turn -0.0 into 0.0)."""
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("us", us("ts"))
    start = ev.groupBy("user_id").agg(F.min("us").alias("us0"))
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.join(start, "user_id").select(
        F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("dataset_id"),
        F.col("user_id").cast("string").alias("subject_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("sample_index"),
        ((F.col("us") - F.col("us0")).cast("double") / F.lit(float(TICK_US))).alias("sample_offset_s"),
        F.col("event_type").alias("condition"),
        *[F.when(F.col("event_type") == e, F.col("value")).alias(c) for c, e in CHANNELS.items()],
        k.alias("source_pain_covas_0_100"),
        (k / 10.0).alias("target_pain_nrs_0_10"),
        (k / 10.0).alias("pain_intensity"),
    )


STREAM_SQL = f"""stream AS (
  SELECT 'd' || CAST(user_id % 5 AS VARCHAR) AS dataset_id, CAST(user_id AS VARCHAR) AS subject_id,
    CAST(user_id AS VARCHAR) AS session_id, event_id AS sample_index,
    CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / {float(TICK_US)!r} AS t,
    event_type AS condition,
    {", ".join(f"CASE WHEN event_type = '{e}' THEN value END AS {c}" for c, e in CHANNELS.items())},
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS covas,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0 AS pain
  FROM events)"""

#: Anchors and window membership of the stream view, W = 12 ticks, step 1 tick.
WINDOW_SQL = f"""{STREAM_SQL},
bounds AS (SELECT dataset_id, session_id, min(t) AS t_min, max(t) AS t_max FROM stream GROUP BY ALL),
anchors AS (
  SELECT dataset_id, session_id, k, t_min + 12.0 + k * 1.0 AS w_end, t_min + 12.0 + k * 1.0 - 12.0 AS w_start FROM (
    SELECT dataset_id, session_id, t_min, unnest(generate_series(0, CAST(floor(t_max - (t_min + 12.0)) AS BIGINT))) AS k
    FROM bounds WHERE t_min + 12.0 <= t_max)),
member AS (
  SELECT a.dataset_id, a.session_id, a.k, a.w_start, a.w_end, s.* EXCLUDE (dataset_id, session_id),
    s.t - lag(s.t) OVER (PARTITION BY a.dataset_id, a.session_id, a.k ORDER BY s.t, s.sample_index) AS gap
  FROM anchors a JOIN stream s ON s.session_id = a.session_id AND s.dataset_id = a.dataset_id
    AND s.t > a.w_start AND s.t <= a.w_end),
win AS (
  SELECT dataset_id, session_id, k, w_start, w_end, count(*) AS source_rows,
    coalesce(greatest(max(gap) FILTER (WHERE gap > 0), min(t) - w_start, w_end - max(t), 0.0), 0.0) AS max_gap_raw,
    count(*) FILTER (WHERE gap > 0) AS n_gaps,
    median(gap) FILTER (WHERE gap > 0) AS med_gap
  FROM member GROUP BY dataset_id, session_id, k, w_start, w_end HAVING count(*) >= 2),
admitted AS (
  SELECT dataset_id, session_id, k, w_start, w_end, source_rows,
    CASE WHEN n_gaps > 0 THEN max_gap_raw ELSE 0.0 END AS max_gap,
    CASE WHEN n_gaps > 0 THEN greatest(8.0, 2.0 * med_gap) ELSE 8.0 END AS allowed
  FROM win
  WHERE CASE WHEN n_gaps > 0 THEN max_gap_raw ELSE 0.0 END <= CASE WHEN n_gaps > 0 THEN greatest(8.0, 2.0 * med_gap) ELSE 8.0 END),
w AS (
  SELECT m.*, a.source_rows, a.max_gap, a.allowed FROM member m JOIN admitted a USING (dataset_id, session_id, k))"""


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """One regular-grid signal per vector, 4 Hz."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("signal_id"),
        F.concat(F.lit("g"), (F.col("vec_id") % 4).cast("string")).alias("dataset_id"),
        (F.col("vec_id") % 25).alias("subject_id"),
        (F.col("label") >= 5).cast("int").alias("y"),
        F.transform("embedding", lambda v: v.cast("double")).alias("x"),
    )


SIGNAL_SQL = """sig AS (
  SELECT vec_id AS signal_id, 'g' || CAST(vec_id % 4 AS VARCHAR) AS dataset_id, vec_id % 25 AS subject_id,
    CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
pt AS (
  SELECT signal_id, dataset_id, subject_id, y, unnest(x) AS v, unnest(range(len(x))) AS i, len(x) AS n FROM sig),
st AS (
  SELECT p.signal_id, any_value(med) AS med, median(abs(v - med)) AS mad, stddev_pop(v) AS sd FROM pt p
    JOIN (SELECT signal_id, median(v) AS med FROM pt GROUP BY signal_id) m USING (signal_id) GROUP BY p.signal_id),
z AS (
  SELECT p.*, (v - med) / (CASE WHEN mad * 1.4826 >= 1e-9 THEN mad * 1.4826 WHEN sd >= 1e-9 THEN sd ELSE 1.0 END) AS z
  FROM pt p JOIN st USING (signal_id))"""


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Scored binary rows: y from the label table, score from text length, grouped by source and language."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("score"))
    return table(spark, sf, "labels").join(d, "doc_id").select(
        "doc_id", F.col("lang").alias("dataset_id"), F.col("source").alias("subject_id"),
        F.col("quality").alias("y"), "toxic", "score",
    )


EVAL_SQL = """ev AS (
  SELECT l.doc_id, d.lang AS dataset_id, d.source AS subject_id, l.quality AS y, l.toxic, CAST(d.n_chars AS DOUBLE) AS score
  FROM labels l JOIN documents d USING (doc_id))"""


def baseline_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order rows as windows: dataset = nation, subject = customer, rest rows = finished orders."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    o = table(spark, sf, "orders")
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("n_name").alias("dataset_id"), F.col("o_custkey").cast("string").alias("subject_id"),
            F.col("o_orderkey").alias("row_id"),
            F.when(F.col("o_orderstatus") == "F", "Rest").otherwise(F.col("o_orderstatus")).alias("condition"),
            (F.log("o_totalprice") * 10.0).alias("eda__mean"),
            (F.dayofyear(F.col("o_orderdate").cast("timestamp")).cast("double") / 7.0).alias("hr__mean"),
        )
    )


BASELINE_SQL = """br AS (
  SELECT n_name AS dataset_id, CAST(o_custkey AS VARCHAR) AS subject_id, o_orderkey AS row_id,
    CASE WHEN o_orderstatus = 'F' THEN 'Rest' ELSE o_orderstatus END AS condition,
    ln(o_totalprice) * 10.0 AS eda__mean, CAST(dayofyear(o_orderdate) AS DOUBLE) / 7.0 AS hr__mean
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
