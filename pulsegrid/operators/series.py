"""Statistics along a session's rows, time block by time block: neighbours, runs, short-gap filling and beat quality.

A session is cut into time blocks, so a long one is many tasks. What a block needs from outside - the last value before it, the
first behind it, the length of a run that reaches into it - comes from a summary of one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.scale import null_safe_join

# Sensors of the device profiles.
PROFILES = {
    "native_full": None,
    "watch_core": ("hr", "ibi", "acc", "temperature"),
    "watch_guided_breath": ("hr", "ibi", "acc", "temperature", "guided_breath_phase"),
    "watch_plus_eda": ("hr", "ibi", "acc", "temperature", "eda"),
    "watch_plus_respiration": ("hr", "ibi", "acc", "temperature", "respiration"),
    "chest_reference": ("ecg", "respiration", "eda", "acc", "temperature"),
}


def _blocks(df: DataFrame, time: str, bucket: float) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(time) / F.lit(float(bucket))).cast("long"))


def neighbours(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], columns: Sequence[str], bucket: float) -> DataFrame:
    """Adds ``__p_`` and ``__n_`` of each column: time and value (t, v) of the nearest rows before and behind this one in the session where it is not null."""
    cell, order = [*keys, "__b"], ", ".join(f"`{c}`" for c in (time, *ties))
    over = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in cell)} ORDER BY {order})"
    between = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY __b"
    packed = {c: f"IF(`{c}` IS NULL OR `{time}` IS NULL, NULL, struct(`{time}` AS t, `{c}` AS v))" for c in columns}
    rows = _blocks(df, time, bucket)
    local = rows.withColumns({x: e for c, p in packed.items() for x, e in ((f"__p_{c}", F.expr(f"lag({p}) IGNORE NULLS {over}")), (f"__n_{c}", F.expr(f"lead({p}) IGNORE NULLS {over}")))})
    ends = rows.groupBy(*cell).agg(*[F.expr(f"{f}({p}, struct({order})) FILTER (WHERE {p} IS NOT NULL)").alias(f"{x}{c}") for c, p in packed.items() for f, x in (("max_by", "__l_"), ("min_by", "__f_"))])
    carried = ends.select(*cell, *[F.expr(e).alias(x) for c in columns for e, x in (
        (f"last(__l_{c}, true) {between} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"__cp_{c}"), (f"lead(__f_{c}) IGNORE NULLS {between})", f"__cn_{c}"))])
    joined = null_safe_join(local, carried, cell)
    return joined.withColumns({f"__{s}_{c}": F.coalesce(f"__{s}_{c}", f"__c{s}_{c}") for c in columns for s in "pn"}).drop("__b", *[f"__c{s}_{c}" for c in columns for s in "pn"])


def hydrate(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], tolerances: dict[str, float], bucket: float) -> DataFrame:
    """Fills gaps of each channel by a straight line where the samples around it are at most its tolerance apart; longer gaps stay null.

    Native values stay as they are, and ``{channel}__native`` tells them from filled ones, for gating only. No channel is made from another.
    """
    out, t = neighbours(df, keys, time, ties, list(tolerances), bucket), F.col(time)
    cols: dict[str, Column] = {}
    for c, tolerance in tolerances.items():
        p, n = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        gap = n["t"] - p["t"]
        line = F.when(gap == 0, p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * ((t - p["t"]) / gap))
        cols |= {f"{c}__native": F.col(c).isNotNull(), c: F.coalesce(c, F.when(gap <= tolerance, line))}
    return out.withColumns(cols).drop(*[f"__{s}_{c}" for c in tolerances for s in "pn"])


def project_profile(df: DataFrame, profile: str, sensors: dict[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the columns of those of ``sensors`` (sensor to its columns) that the device profile has; what it lacks is left out, never filled in."""
    wanted = PROFILES[profile]
    chosen = [c for s, columns in sensors.items() if wanted is None or s in wanted for c in columns if c in df.columns]
    return df.select(*keep, *chosen)


def run_lengths(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], flag: Column, bucket: float, name: str = "run") -> DataFrame:
    """Adds ``name``: how many rows in a row, up to this one, have a true ``flag`` (0 where it is false or null).

    A block is the pair (length of the run at its end, is all of it one run); the pairs of a session's blocks are added up in order.
    """
    keys = list(keys)
    cell, on = [*keys, "__b"], F.coalesce(flag, F.lit(False))
    rows = _blocks(df, time, bucket).withColumn("__on", on)
    order = Window.partitionBy(*cell).orderBy(time, *ties)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__i": F.row_number().over(order)})
    rows = rows.withColumn("__off", F.coalesce(F.max(F.when(~F.col("__on"), F.col("__i"))).over(upto), F.lit(0)))
    ends = rows.groupBy(*cell).agg(F.max("__i").alias("__n"), F.max("__off").alias("__last"))
    blocks = Window.partitionBy(*keys).orderBy("__b")
    # A block with a false row starts a new part; within a part, run lengths at block ends add up.
    ends = ends.withColumn("__part", F.sum((F.col("__last") > 0).cast("long")).over(blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.withColumn("__run", F.sum(F.col("__n") - F.col("__last")).over(Window.partitionBy(*keys, "__part").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    carry = ends.select(*cell, F.coalesce(F.lag("__run").over(blocks), F.lit(0)).alias("__carry"))
    joined = null_safe_join(rows, carry, cell)
    run = F.col("__i") - F.col("__off") + F.when(F.col("__off") == 0, F.col("__carry")).otherwise(F.lit(0))
    return joined.withColumn(name, run.cast("long")).drop("__b", "__on", "__i", "__off", "__carry")


def sustained(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], flag: Column, ticks: int, bucket: float, name: str = "sustained") -> DataFrame:
    """Adds ``name``: has ``flag`` held on this row and the ``ticks`` - 1 rows before it?"""
    return run_lengths(df, keys, time, ties, flag, bucket, "__run_length").withColumn(name, F.col("__run_length") >= ticks).drop("__run_length")


def burst_summary(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], flag: Column, least: int, bucket: float) -> DataFrame:
    """Per session: rows, burst_rows (rows in runs of ``least`` or more), bursts, longest_run, burst_fraction and transitions (changes of the flag between neighbours)."""
    runs = run_lengths(df, keys, time, ties, flag, bucket, "__run")
    position, on = F.struct(time, *ties), (F.col("__run") > 0).cast("long")
    out = runs.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum(F.when(F.col("__run") == least, least).when(F.col("__run") > least, 1).otherwise(0)).alias("burst_rows"),
        F.sum((F.col("__run") == least).cast("long")).alias("bursts"), F.max("__run").alias("longest_run"),
        (2 * F.sum((F.col("__run") == 1).cast("long")) - F.min_by(on, position) - F.max_by(on, position)).alias("transitions"))
    return out.withColumn("burst_fraction", F.col("burst_rows") / F.col("rows"))


def beat_statistics(
    df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], ibi: str, bucket: float, low: float = 0.3, high: float = 2.0, change: float = 0.2,
    min_beats: int = 20, max_outliers: float = 0.2, min_seconds: float = 60.0,
) -> DataFrame:
    """Heart-rate variability per session from beat intervals (seconds), with quality gates.

    A beat is an outlier outside ``low`` to ``high``, or if it differs by more than ``change`` of the last one inside them; differences
    count to a beat that is none. Columns: ibi_beat_count, ibi_outlier_frac, hrv_window_duration_s, median_ibi, rmssd_ms, sdnn_ms, pnn20, pnn50 (NULL below ``min_beats``),
    poincare_sd1, poincare_sd2 (NULL where rmssd is not valid), hrv_valid_for_rmssd and hrv_valid_for_sdnn. Only the previous beat comes from
    outside a block; everything else is summed in parts.
    """
    gated = df.where(F.col(ibi).isNotNull()).withColumn("__beat", F.when(F.col(ibi).between(low, high), F.col(ibi)))
    linked = neighbours(gated, keys, time, ties, ["__beat"], bucket)
    before = F.col("__p___beat.v")
    good = F.col("__beat").isNotNull() & (before.isNull() | (F.abs(F.col("__beat") - before) <= change * before))
    linked = linked.select(*keys, time, F.when(good, F.col("__beat")).alias("__good"), F.when(good, (F.col("__beat") - before) * 1000.0).alias("__d"))
    d = F.col("__d")
    share = lambda limit: F.avg(F.when(d.isNotNull(), (F.abs(d) > limit).cast("double")))
    out = linked.groupBy(*keys).agg(
        F.count("*").alias("ibi_beat_count"), (1.0 - F.count("__good") / F.count("*")).alias("ibi_outlier_frac"), (F.max(time) - F.min(time)).alias("hrv_window_duration_s"),
        F.median("__good").alias("median_ibi"), F.sqrt(F.avg(d * d)).alias("rmssd_ms"), F.stddev_samp(F.col("__good") * 1000.0).alias("sdnn_ms"), share(20.0).alias("pnn20"), share(50.0).alias("pnn50"),
        F.var_samp(d).alias("__vd"), F.var_samp(F.col("__good") * 1000.0).alias("__v"), F.count("__good").alias("__n"))
    enough = F.col("__n") >= min_beats
    valid = enough & (F.col("ibi_outlier_frac") <= max_outliers)
    out = out.withColumns({
        "pnn50": F.when(enough, F.col("pnn50")), "poincare_sd1": F.sqrt(F.col("__vd") / 2.0),
        "poincare_sd2": F.when(valid, F.sqrt(F.greatest(F.lit(0.0), 2.0 * F.col("__v") - F.col("__vd") / 2.0))),
        "hrv_valid_for_rmssd": valid, "hrv_valid_for_sdnn": valid & (F.col("hrv_window_duration_s") >= min_seconds),
    })
    return out.drop("__vd", "__v", "__n")
