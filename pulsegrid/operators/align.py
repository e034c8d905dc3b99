"""Aligning series: as-of, interval and dimension joins that split long sessions by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.intervals import MINUTE_US, covered_at, in_minutes, merged
from pulsegrid.operators.scale import null_safe_join, running_index


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    direction: str = "nearest",
    tolerance: float | Column | None = None,
    bucket: float = 3600.0,
    tie_breaker: str | None = None,
    time_out: str | None = None,
) -> DataFrame:
    """Attach to every left row the right row nearest in time (or nearest at/before, at/after it).

    Work is split by (keys, time bucket), so one long session spreads over many tasks. With a
    tolerance the right side is copied only into buckets it can reach. Without one, the last row of
    the preceding buckets (first row of the following ones) is carried in from a per-bucket summary.
    A tolerance may be an expression over the right row, such as one of its session's sample rate.
    Equal distances resolve to the earlier row; among equal times at/before, the last row wins.
    """
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(f"unknown direction {direction}")
    keys = list(keys)
    t, size = F.col(time), F.lit(float(bucket))
    home = F.floor(t / size).cast("long")
    seq = F.col(tie_breaker) if tie_breaker else F.lit(0)
    tol = tolerance if isinstance(tolerance, Column) or tolerance is None else F.lit(float(tolerance))
    reached = [] if tol is None else [tol.alias("__tol")]
    payload = F.struct(t.alias("t"), seq.alias("s"), *reached, *[F.col(v).alias(v) for v in values])
    lcols = left.columns
    lrows = left.select(*keys, t.alias("__t"), home.alias("__b"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__seq"),
                        F.struct(*lcols).alias("__row"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("__v"))
    if tol is not None:
        reach = F.explode_outer(F.sequence(F.floor((t - tol) / size).cast("long"), F.floor((t + tol) / size).cast("long")))
    else:
        reach = home
    rrows = right.where(t.isNotNull()).select(
        *keys, t.alias("__t"), reach.alias("__b"), F.lit(0).alias("__side"), seq.cast("long").alias("__seq"),
        F.lit(None).cast(lrows.schema["__row"].dataType).alias("__row"), payload.alias("__v"))
    both = lrows.unionByName(rrows)
    cell = [*keys, "__b"]
    names = ", ".join(f"`{c}`" for c in cell)
    over = f"OVER (PARTITION BY {names} ORDER BY __t, __side, __seq"
    back = F.expr(f"last(__v, true) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    fwd = F.expr(f"lead(__v) IGNORE NULLS {over})")
    found = both.withColumns({"__back": back, "__fwd": fwd}).where("__side = 1")
    if tol is None:
        found = _carry_in(found, both, keys, direction)
    dist_b, dist_f = F.col("__t") - F.col("__back.t"), F.col("__fwd.t") - F.col("__t")
    # A right row at the left row's own time sorts before it, so it counts as "at or before" and, for
    # a forward search, as an exact hit.
    if direction == "backward":
        pick = F.col("__back")
    elif direction == "forward":
        pick = F.when(dist_b == 0, F.col("__back")).otherwise(F.col("__fwd"))
    else:
        pick = F.when(F.col("__fwd").isNull() | (dist_b <= dist_f), F.col("__back")).otherwise(F.col("__fwd"))
    found = found.withColumn("__hit", pick)
    if tol is not None:
        found = found.withColumn("__hit", F.when(F.abs(F.col("__t") - F.col("__hit.t")) <= F.col("__hit.__tol"), F.col("__hit")))
    extra = [F.col("__hit.t").alias(time_out)] if time_out else []
    return found.select("__row.*", *[F.col(f"__hit.{v}").alias(v) for v in values], *extra)


def _carry_in(found: DataFrame, both: DataFrame, keys: list[str], direction: str) -> DataFrame:
    """Fill bucket-edge misses from per-bucket first/last rows (one small row per session and bucket)."""
    pos = F.struct("__t", "__seq")
    ends = both.groupBy(*keys, "__b").agg(
        F.max_by("__v", F.when(F.col("__side") == 0, pos)).alias("__last"),
        F.min_by("__v", F.when(F.col("__side") == 0, pos)).alias("__first"),
    )
    names = ", ".join(f"`{c}`" for c in keys)
    part = f"PARTITION BY {names}" if keys else ""
    carried = ends.select(
        *keys, "__b",
        F.expr(f"last(__last, true) OVER ({part} ORDER BY __b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("__cb"),
        F.expr(f"lead(__first) IGNORE NULLS OVER ({part} ORDER BY __b)").alias("__cf"),
    )
    joined = null_safe_join(found, carried, [*keys, "__b"])
    return joined.withColumns({"__back": F.coalesce("__back", "__cb"), "__fwd": F.coalesce("__fwd", "__cf")})


def fold_sensors(frames: dict[str, DataFrame], base: str, keys: Sequence[str], rates: dict[str, float], bucket: float = 60.0) -> DataFrame:
    """Combine per-sensor frames onto the densest one by nearest time, re-indexing at the end.

    Tolerance is half a sample period (at least 20 ms), and 15 ms for beat intervals.
    """
    out = frames[base].drop("sample_rate_hz")
    fixed = {"sample_index", "sample_offset_s", "sample_rate_hz", *keys}
    for sensor, frame in frames.items():
        if sensor == base:
            continue
        values = [c for c in frame.columns if c not in fixed]
        tol = 0.015 if sensor == "ibi" else max(0.02, 0.5 / rates[sensor])
        out = asof_join(out, frame, keys, "sample_offset_s", values, "nearest", tol, bucket, "sample_index")
    return running_index(out.withColumnRenamed("sample_index", "__old"), keys, "sample_offset_s", "sample_index", ["__old"]).drop("__old")


def dim_left_join(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Attach subject-level metrics. No hint: the planner broadcasts the side only when its measured size allows."""
    return facts.join(dim, key, "left")


def many_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join against the first right row per key (an explicit order decides which)."""
    return null_safe_join(left, dedupe_first(right, keys, order).select(*keys, *values), keys)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. The rank limit is applied before the shuffle, so repeats never travel."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def interval_join(
    points: DataFrame,
    segments: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    seg_order: str,
    values: Sequence[str],
    bucket: float,
) -> DataFrame:
    """Label every point with the segment containing it (both ends inclusive); the later segment wins.

    Points without a segment keep NULL values. Segments are cut into time buckets and matched by
    equality on (keys, bucket), so there is no nested-loop pass over a session.
    """
    size = F.lit(float(bucket))
    seg = segments.where(F.col(start) <= F.col(end)).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(F.col(seg_order).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"), F.struct(*values).alias("vals")).alias("__seg"),
        F.explode_outer(F.sequence(F.floor(F.col(start) / size).cast("long"), F.floor(F.col(end) / size).cast("long"))).alias("__kb"),
    )
    # One row per bucket, with the few segments that touch it: a point meets one row at most and cannot be lost or doubled.
    right = seg.groupBy(*[f"__k_{k}" for k in keys], "__kb").agg(F.collect_list("__seg").alias("__segs"))
    on = F.col("__b") == F.col("__kb")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    joined = points.withColumn("__b", F.floor(F.col(time) / size).cast("long")).join(right, on, "left")
    best = F.array_max(F.filter("__segs", lambda x: (F.col(time) >= x["s"]) & (F.col(time) <= x["e"])))
    return joined.withColumn("__best", best).select(*points.columns, *[F.col(f"__best.vals.{v}").alias(v) for v in values])


def protocol_segments(lines: DataFrame, keys: Sequence[str], text: str = "value") -> DataFrame:
    """Parse protocol headers (``# ORDER;..``, ``# START;..``, ``# END;..``, minutes) into segment rows.

    Times become seconds relative to the earliest start; a stress test segment carries the fixed
    binary/score labels 1 / 8, the others 0 / 2.
    """
    from pulsegrid.functions.text import clean_numeric, strip

    tidy = F.regexp_replace(F.col(text), ";+$", "")
    parts = F.transform(F.split(tidy, ";"), lambda p: strip(p))
    head = F.get(parts, 0)
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def row(tag: str) -> Column:
        return F.max(F.when(F.col("__h") == tag, F.col("__body")))

    packed = (
        lines.select(*keys, head.alias("__h"), body.alias("__body"))
        .where(F.col("__h").isin("# ORDER", "# START", "# END"))
        .groupBy(*keys).agg(row("# ORDER").alias("o"), row("# START").alias("s"), row("# END").alias("e"))
    )
    numbers = packed.select(
        *keys, "o", F.transform("s", lambda v: clean_numeric(v)).alias("s"), F.transform("e", lambda v: clean_numeric(v)).alias("e")
    )
    seg = numbers.select(*keys, F.array_min(F.filter("s", lambda v: v.isNotNull())).alias("__origin"),
                         F.posexplode_outer(F.arrays_zip("o", "s", "e")).alias("seg_no", "p"))
    name = F.lower(F.replace(F.col("p.o"), F.lit(" "), F.lit("_")))
    stress = name == "tsst"
    return seg.where((F.col("p.o") != "") & F.col("p.s").isNotNull() & F.col("p.e").isNotNull()).select(
        *keys, "seg_no", name.alias("wesad_protocol_segment"),
        ((F.col("p.s") - F.col("__origin")) * 60.0).alias("wesad_protocol_start_s"),
        ((F.col("p.e") - F.col("__origin")) * 60.0).alias("wesad_protocol_end_s"),
        F.when(stress, 1.0).otherwise(0.0).alias("target_stress_binary"),
        F.when(stress, 8.0).otherwise(2.0).alias("target_stress_score_0_10"),
        F.when(stress, "tsst_stress").otherwise(name).alias("aux_state_label"),
    )


def apply_protocol(stream: DataFrame, segments: DataFrame, keys: Sequence[str], bucket: float = 120.0) -> DataFrame:
    values = ["wesad_protocol_segment", "wesad_protocol_start_s", "wesad_protocol_end_s", "target_stress_binary",
              "target_stress_score_0_10", "aux_state_label"]
    seg = segments.withColumns({"__start": F.col("wesad_protocol_start_s"), "__end": F.col("wesad_protocol_end_s")})
    base = stream.drop(*values)
    out = interval_join(base, seg, keys, "sample_offset_s", "__start", "__end", "seg_no", values, bucket)
    return out.withColumn("wesad_protocol_segment", F.coalesce("wesad_protocol_segment", F.lit("unknown")))


#: A day, in minutes; interval records go to time buckets of 30.
DAY = 1440


def minute_counts(intervals: DataFrame, keys: Sequence[str], start: str, end: str, kind: str) -> DataFrame:
    """Number of different minutes that the intervals of a key and kind touch: from the lengths of their union, not from minutes."""
    union = merged(in_minutes(intervals, start, end), [*keys, kind], "__from", "__to", 30 * DAY)
    return union.groupBy(*keys, kind).agg(F.sum(F.col("until") - F.col("at")).alias("minutes"))


def archetype_label(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, kind: str) -> DataFrame:
    """Archetype of each sample from the minutes covered by interval records.

    Priority, highest first: workout or exercise, standing, sleep; otherwise awake. Records and samples run through one
    sweep over time.
    """
    flags = {"__active": F.col(kind).isin("workout", "exercise"), "__stand": F.col(kind) == "stand", "__sleep": F.col(kind) == "sleep"}
    minute = F.floor(F.unix_micros(ts) / F.lit(MINUTE_US))
    found = covered_at(samples, keys, minute, in_minutes(intervals, start, end), "__from", "__to", flags, 30 * DAY)
    label = (
        F.when(F.col("__active"), "workout_or_exercise").when(F.col("__stand"), "standing").when(F.col("__sleep"), "sleep")
        .otherwise("awake_nonworkout")
    )
    return found.withColumn("archetype", label).drop(*flags)


def anchor_samples(
    anchors: DataFrame, stream: DataFrame, keys: Sequence[str], window_seconds: float, columns: Sequence[str],
    anchor_time: str = "window_end_s", time: str = "sample_offset_s",
) -> DataFrame:
    """Samples in ``(end - W, end]`` of every anchor, by equality on (keys, time bucket of width W)."""
    size = F.lit(float(window_seconds))
    a = anchors.withColumn("__b", F.explode_outer(F.sequence(
        F.floor((F.col(anchor_time) - size) / size).cast("long"), F.floor(F.col(anchor_time) / size).cast("long"))))
    s = stream.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.floor(F.col(time) / size).cast("long").alias("__kb"),
                      F.col(time), *columns)
    on = (F.col("__b") == F.col("__kb")) & (F.col(time) <= F.col(anchor_time)) & (F.col(time) > F.col(anchor_time) - size)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    return a.join(s, on).drop("__b", "__kb", *[f"__k_{k}" for k in keys])


def relative_offset(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], scale: float, name: str) -> DataFrame:
    """(ts - first non-null ts of the session in row order) / scale, via one small per-session aggregate."""
    position = F.struct(*order)
    first = df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.min_by(ts, position).alias("__t0"))
    return null_safe_join(df, first, keys).withColumn(name, (F.col(ts) - F.col("__t0")) / F.lit(scale)).drop("__t0")


def decimate(df: DataFrame, index: str, every: int, phase: int = 0) -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(every)) == phase)


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, gap: float, tie_breaker: str, bucket: float) -> DataFrame:
    """Split a series where consecutive rows are at least ``gap`` apart: one row per run.

    Runs are numbered in two levels: per (keys, time bucket) first, then across the small bucket summary.
    """
    keys = list(keys)
    cell = [*keys, "__b"]
    rows = df.select(*keys, time, tie_breaker, F.floor(F.col(time) / F.lit(float(bucket))).cast("long").alias("__b"))
    over_buckets = Window.partitionBy(*keys).orderBy("__b")
    edges = rows.groupBy(*cell).agg(F.max(time).alias("__end")).select(*cell, F.lag("__end").over(over_buckets).alias("__prev_end"))
    local = Window.partitionBy(*cell).orderBy(time, tie_breaker)
    joined = null_safe_join(rows, edges, cell)
    since = F.col(time) - F.coalesce(F.lag(time).over(local), F.col("__prev_end"))
    flagged = joined.withColumn("__new", F.when(since.isNull() | (since >= gap), 1).otherwise(0))
    counts = flagged.groupBy(*cell).agg(F.sum("__new").alias("__n"))
    before = counts.select(
        *cell, F.coalesce(F.sum("__n").over(over_buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__carry"))
    local_runs = flagged.withColumn("__r", F.sum("__new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    part = local_runs.groupBy(*cell, "__r").agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count(F.lit(1)).alias("n"))
    numbered = null_safe_join(part, before, cell).withColumn("run", F.col("__r") + F.col("__carry"))
    return numbered.groupBy(*keys, "run").agg(
        F.min("lo").alias("run_start"), F.max("hi").alias("run_end"), F.sum("n").alias("rows"))
