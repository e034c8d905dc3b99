"""Streaming queries: the event table read as a stream, drained once, compared with a batch statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators.baseline import baseline_profiles
from pulsegrid.plans.registry import query, table
from pulsegrid.plans.views import rounded
from pulsegrid.streaming import live, ordered


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ts = F.col("ts").cast("timestamp")
    return raw.select("event_id", "user_id", "event_type", "value", ts.alias("ts"), F.unix_micros(ts).alias("us"))


# Rows become final once the watermark (newest event, whole milliseconds, minus one hour) passes them.
WM = "wm AS (SELECT (max(epoch_us(ts) {shift}) // 1000) * 1000 - 3600000000 AS wm FROM events)"


def _micros(df, *cols):
    return df.withColumns({c: F.unix_micros(c) for c in cols})


@query(
    "stream_sliding",
    f"""WITH {WM.format(shift='- 1')}, e AS (SELECT user_id, value, epoch_us(ts) - 1 AS us FROM events),
    m AS (SELECT user_id, value, (us // 21600000000 - j) * 21600000000 AS s FROM e, range(12) t(j))
    SELECT user_id, s AS window_start, s + 259200000000 AS window_end, count(*) AS source_rows, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
      round(min(value), 6) AS min, round(max(value), 6) AS max FROM m, wm WHERE s + 259200000000 <= wm GROUP BY user_id, s HAVING count(*) >= 2""",
)
def stream_sliding(spark, sf):
    s = live.sliding_summary(event_stream(spark, sf), ["user_id"], "ts", "value", "72 hours", "6 hours", "1 hour")
    return rounded(_micros(live.run_available(s, "sliding"), "window_start", "window_end"))


@query(
    "stream_tumbling",
    f"""WITH {WM.format(shift='')} SELECT event_type, (epoch_us(ts) // 21600000000) * 21600000000 AS window_start, (epoch_us(ts) // 21600000000 + 1) * 21600000000 AS window_end,
      count(*) AS rows FROM events, wm WHERE (epoch_us(ts) // 21600000000 + 1) * 21600000000 <= wm GROUP BY ALL""",
)
def stream_tumbling(spark, sf):
    s = live.tumbling_counts(event_stream(spark, sf), ["event_type"], "ts", "6 hours", "1 hour")
    return _micros(live.run_available(s, "tumbling"), "window_start", "window_end")


@query(
    "stream_gap_sessions",
    f"""WITH {WM.format(shift='')}, d AS (SELECT user_id, epoch_us(ts) AS us, event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 43200000000, TRUE) AS n FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(n::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM d)
    SELECT user_id, min(us) AS run_start, max(us) + 43200000000 AS run_close, count(*) AS rows FROM r GROUP BY user_id, run HAVING max(us) + 43200000000 <= (SELECT wm FROM wm)""",
)
def stream_gap_sessions(spark, sf):
    s = live.gap_sessions(event_stream(spark, sf), ["user_id"], "ts", "12 hours", "1 hour")
    return _micros(live.run_available(s, "gaps"), "run_start", "run_close")


@query(
    "stream_session_offset",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index,
      round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 6) AS offset_s FROM events""",
)
def stream_session_offset(spark, sf):
    return rounded(live.run_available(live.session_offsets(event_stream(spark, sf), "user_id", "us", "event_id"), "offsets"))


@query(
    "ewma_filter",
    """WITH l AS (SELECT user_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM events)
    SELECT user_id, event_id, round(list_reduce(v, lambda a, x: 0.3 * x + 0.7 * a), 6) AS level FROM l""",
)
def ewma_filter(spark, sf):
    return rounded(live.run_available(live.exponential_filter(event_stream(spark, sf), "user_id", "us", "event_id", "value", 0.3), "ewma"))


@query(
    "stream_ordered_signal",
    f"""WITH {WM.format(shift='')}, d AS (SELECT user_id, event_id, value, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 43200000000, TRUE) AS n
      FROM events WHERE epoch_us(ts) <= (SELECT wm FROM wm) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(n::INT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM d),
    l AS (SELECT *, row_number() OVER w - 1 AS sample_index, us - min(us) OVER w AS since, list(value) OVER w AS v FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, sample_index, round(since / 1e6, 6) AS offset_s, round(list_reduce(v, lambda a, x: x / 3.0 + a * (1.0 - 1.0::DOUBLE / 3.0)), 6) AS level FROM l""",
)
def stream_ordered_signal(spark, sf):
    # A third, not 0.3: levels of short runs would be short decimals and often exact halves at the sixth place, where engines may round differently.
    s = ordered.ordered_signal(event_stream(spark, sf), "user_id", "ts", "event_id", "value", 1 / 3, "1 hour", 12 * 3600)
    return rounded(live.run_available(s, "ordered", ordered.STATE_STORE))


def score_inputs(df):
    """Event rows shaped as one-sample windows: two sensors, presence flags and subject keys."""
    hr = F.when(F.col("event_type").isin("view", "click"), F.col("value"))
    eda = F.when(F.col("event_type").isin("purchase", "click"), F.col("value") / 50.0)
    return df.select(
        F.lit("live").alias("dataset_id"), F.col("user_id").cast("string").alias("subject_id"), "event_id",
        F.when(F.col("event_type") == "view", "rest").otherwise("task").alias("condition"), hr.alias("hr__mean"), eda.alias("eda__mean"),
        hr.isNotNull().cast("int").alias("hr__present"), eda.isNotNull().cast("int").alias("eda__present"))


@query("stream_score")
def stream_score(spark, sf):
    profiles = baseline_profiles(score_inputs(table(spark, sf, "events")))
    scored = live.score_stream(score_inputs(event_stream(spark, sf)), profiles)
    return rounded(live.run_available(scored.select("event_id", "sympathetic", "parasympathetic", "homeostasis", "baseline_profile_available"), "score"))
