"""Live counterparts of the batch operators as Structured Streaming transformations.

Every function takes and returns a (streaming) DataFrame; the same code runs on a static frame. State
is kept in the cluster's state store. That of windows, counts and runs ends with the watermark, and they
return only what it has passed. The two per-session operators here keep one small row per session for good, order rows
within a micro-batch only, and hold a session's rows of one micro-batch in one task; ``streaming.ordered`` orders by
event time and lets idle sessions go.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.functions.scoring import ternary_score
from pulsegrid.operators.baseline import attach_baseline
from pulsegrid.session import shared_dir


def half_open(ts: Column | str) -> Column:
    """Shift by one microsecond, so that Spark's [start, end) windows act as (start, end]."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_micros(F.unix_micros(c) - 1)


def sliding_summary(
    stream: DataFrame, keys: Sequence[str], ts: str, value: str, width: str, step: str, delay: str, min_rows: int = 2,
) -> DataFrame:
    """Trailing-window summary per session on the epoch-aligned tick grid; rows later than ``delay`` are dropped."""
    shifted = stream.withColumn("__ts", half_open(ts)).withWatermark("__ts", delay)
    out = shifted.groupBy(*keys, F.window("__ts", width, step)).agg(
        F.count(F.lit(1)).alias("source_rows"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"))
    return out.where(F.col("source_rows") >= min_rows).select(
        *keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "source_rows", "mean", "std", "min", "max")


def tumbling_counts(stream: DataFrame, keys: Sequence[str], ts: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width)).agg(F.count(F.lit(1)).alias("rows")).select(
        *keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "rows")


def gap_sessions(stream: DataFrame, keys: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Runs of a session separated by silent gaps; closed once the watermark passes the gap."""
    return stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("rows")).select(
        *keys, F.col("session_window.start").alias("run_start"), F.col("session_window.end").alias("run_close"), "rows")


def session_offsets(stream: DataFrame, key: str, ts_us: str, row_id: str) -> DataFrame:
    """Running sample index and seconds since the session's first row, carried across micro-batches."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([ts_us, row_id])
        first, count = state.get if state.exists else (int(rows[ts_us].iloc[0]), 0)
        yield pd.DataFrame({
            key: rows[key], row_id: rows[row_id], "sample_index": range(count, count + len(rows)), "offset_s": (rows[ts_us] - first) / 1e6})
        state.update((first, count + len(rows)))

    types = dict(stream.dtypes)
    schema = f"{key} {types[key]}, {row_id} {types[row_id]}, sample_index long, offset_s double"
    return stream.select(key, row_id, ts_us).groupBy(key).applyInPandasWithState(
        step, schema, "first long, n long", "append", GroupStateTimeout.NoTimeout)


def exponential_filter(stream: DataFrame, key: str, ts_us: str, row_id: str, value: str, alpha: float) -> DataFrame:
    """Exponentially smoothed value per session, in time order, with the level kept as state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([ts_us, row_id])
        level = state.get[0] if state.exists else None
        out = []
        for x in rows[value]:
            level = x if level is None else alpha * x + (1.0 - alpha) * level
            out.append(level)
        yield pd.DataFrame({key: rows[key], row_id: rows[row_id], "level": out})
        state.update((level,))

    types = dict(stream.dtypes)
    schema = f"{key} {types[key]}, {row_id} {types[row_id]}, level double"
    return stream.select(key, row_id, ts_us, value).groupBy(key).applyInPandasWithState(
        step, schema, "level double", "append", GroupStateTimeout.NoTimeout)


def score_stream(windows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Stream-static join of the baseline profiles, then the same scoring expressions as in batch."""
    return ternary_score(attach_baseline(windows, profiles))


def run_available(stream: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Process everything available into a table in the shared folder and return that table.

    ``settings`` hold for this query alone: it copies the session's when it starts.
    """
    spark: SparkSession = stream.sparkSession
    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/data")
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{root}/data")
