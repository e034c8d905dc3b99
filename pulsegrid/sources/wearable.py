"""Wrist-device sensor files and health exports as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schema as S
from pulsegrid.functions.text import clean_numeric
from pulsegrid.operators.align import asof_join
from pulsegrid.operators.scale import running_index
from pulsegrid.session import pinned

CHANNELS = {"acc": ("acc_x", "acc_y", "acc_z"), "bvp": ("bvp",), "eda": ("eda",), "hr": ("hr",), "temp": ("temperature",)}


def sensor_frame(lines: DataFrame, keys: list[str], sensor: str) -> DataFrame:
    """Samples of one sensor: line 0 start epoch, line 1 rate (1.0 when absent or zero), then the samples.

    Beat intervals have no rate line; their rows are (offset, interval) events.
    """
    own = lines.where(F.col("sensor") == sensor)
    parts = F.split("value", ",")
    if sensor == "ibi":
        rows = own.where("line_no >= 1").select(*keys, "line_no", clean_numeric(F.get(parts, 0)).alias("sample_offset_s"), clean_numeric(F.get(parts, 1)).alias("ibi"))
        rows = rows.where("sample_offset_s IS NOT NULL AND ibi IS NOT NULL")
        return running_index(rows, keys, "line_no", "sample_index").drop("line_no").withColumn("sample_rate_hz", F.lit(None).cast("double"))
    rate = F.coalesce(F.nullif(clean_numeric(F.get(F.split(F.get("head", 1), ","), 0)), F.lit(0.0)), F.lit(1.0))
    index = F.col("line_no") - 2
    return own.where("line_no >= 2").where(F.trim("value") != "").select(
        *keys, index.alias("sample_index"), (index.cast("double") / rate).alias("sample_offset_s"), rate.alias("sample_rate_hz"),
        *[clean_numeric(F.get(parts, i)).alias(c) for i, c in enumerate(CHANNELS[sensor])])


def combine_sessions(lines: DataFrame, keys: list[str], bucket: float = 60.0) -> DataFrame:
    """All sensors of every session on the time base of the session's densest sensor, nearest in time.

    The base differs by session, so the fold runs once per possible base over the sessions that use it;
    tolerance is half a sample period of the session's own sensor (at least 20 ms), 15 ms for beat intervals.
    """
    sensors = [*CHANNELS, "ibi"]
    # Every sensor is a pass over these lines: inflate the archives once, not once per sensor.
    lines = pinned(lines.where(F.col("sensor").isin(*sensors)))
    minimum = F.when(F.col("sensor") == "ibi", 1).otherwise(2)
    sizes = lines.where(F.col("line_no") >= minimum).groupBy(*keys, "sensor").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_position(F.array(*[F.lit(s) for s in sensors]), F.col("sensor"))
    base = sizes.groupBy(*keys).agg(
        F.min_by("sensor", F.struct((-F.col("n")).alias("n"), order.alias("o"))).alias("base"))
    present = {(r["base"], r["sensor"]) for r in sizes.join(base, keys).select("base", "sensor").distinct().collect()}
    frames = {s: sensor_frame(lines, keys, s) for s in sensors}
    out = None
    for b in sensors:
        if (b, b) not in present:
            continue
        chosen = base.where(F.col("base") == b).select(*keys)
        folded = frames[b].join(chosen, keys, "left_semi").drop("sample_rate_hz")
        for s in sensors:
            if s == b or (b, s) not in present:
                continue
            values = ["ibi"] if s == "ibi" else list(CHANNELS[s])
            tol = 0.015 if s == "ibi" else F.greatest(F.lit(0.02), 0.5 / F.col("sample_rate_hz"))
            folded = asof_join(folded, frames[s], keys, "sample_offset_s", values, "nearest", tol, bucket, "sample_index")
        indexed = running_index(folded.withColumnRenamed("sample_index", "__old"), keys, "sample_offset_s", "sample_index", ["__old"]).drop("__old")
        out = indexed if out is None else out.unionByName(indexed, allowMissingColumns=True)
    return out


RECORD_FIELDS = {"type": "_type", "source": "_sourceName", "unit": "_unit", "start": "_startDate", "end": "_endDate", "value": "_value"}
WORKOUT_FIELDS = {"workout_type": "_workoutActivityType", "start": "_startDate", "end": "_endDate", "duration_min": "_duration",
                  "duration_unit": "_durationUnit", "total_energy": "_totalEnergyBurned", "energy_unit": "_totalEnergyBurnedUnit",
                  "total_distance": "_totalDistance", "distance_unit": "_totalDistanceUnit"}


def _timestamps(df: DataFrame) -> DataFrame:
    def parse(c):
        return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss Z")), c.try_cast("timestamp"))

    return df.withColumns({"start_dt": parse(F.col("start")), "end_dt": parse(F.col("end"))})


def health_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the kept types from a health export (Spark's XML source splits the file by element)."""
    schema = ", ".join(f"{a} string" for a in RECORD_FIELDS.values())
    raw = spark.read.format("xml").option("rowTag", "Record").schema(schema).load(path)
    rows = raw.select(*[F.col(a).alias(n) for n, a in RECORD_FIELDS.items()])
    return _timestamps(rows.where(F.col("type").isin(*S.HEALTH_RECORD_TYPES)).withColumn("numeric_value", F.col("value").try_cast("double")))


def health_workouts(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{a} string" for a in WORKOUT_FIELDS.values())
    raw = spark.read.format("xml").option("rowTag", "Workout").schema(schema).load(path)
    rows = raw.select(*[F.col(a).alias(n) for n, a in WORKOUT_FIELDS.items()])
    return _timestamps(rows.withColumns({c: F.col(c).try_cast("double") for c in ("duration_min", "total_energy", "total_distance")}))


def health_type_counts(spark: SparkSession, path: str) -> DataFrame:
    """Row count of every record type, kept or not, plus workouts."""
    r = spark.read.format("xml").option("rowTag", "Record").schema("_type string").load(path).select(F.coalesce("_type", F.lit("unknown")).alias("type"))
    w = spark.read.format("xml").option("rowTag", "Workout").schema("_workoutActivityType string").load(path).select(F.lit("Workout").alias("type"))
    return r.unionByName(w).groupBy("type").agg(F.count(F.lit(1)).alias("rows"))


def interval_kinds(records: DataFrame, workouts: DataFrame) -> DataFrame:
    """Sleep, stand, exercise and workout intervals as one table for the minute cover."""
    kind = (
        F.when((F.col("type") == "HKCategoryTypeIdentifierSleepAnalysis") & F.col("value").contains("Asleep"), "sleep")
        .when(F.col("type") == "HKQuantityTypeIdentifierAppleExerciseTime", "exercise")
        .when(F.col("type") == "HKQuantityTypeIdentifierAppleStandTime", "stand")
    )
    a = records.select(kind.alias("kind"), "start_dt", "end_dt").where("kind IS NOT NULL")
    return a.unionByName(workouts.select(F.lit("workout").alias("kind"), "start_dt", "end_dt"))
