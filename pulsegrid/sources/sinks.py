"""Writers: partitioned stream, session-clustered window table, labels/subjects/manifest, CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.windows import WindowSpec, cap_sessions, stable_window_table, window_features
from pulsegrid.sources.datasets import conform, label_table, subject_table


def write_stream(stream: DataFrame, path: str) -> None:
    """zstd Parquet by dataset. There is no shuffle: every task writes its own file per dataset, so none owns a dataset."""
    extra = [c for c in stream.columns if c not in conform(stream).columns]
    if extra:
        raise ValueError(f"columns outside the stream schema: {extra}")
    conform(stream).write.mode("overwrite").option("compression", "zstd").partitionBy("dataset_id").parquet(path)


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned stream table, or single-dataset streams found below ``path``."""
    return spark.read.option("recursiveFileLookup", False).parquet(path)


def discover_streams(spark: SparkSession, root: str) -> DataFrame:
    """All ``measurement_stream.parquet`` below a root, single files or written tables, columns united.

    A table that write_stream() partitioned names the dataset in its path only; it is read from there.
    """
    path = F.col("_metadata.file_path")
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True).parquet(root)
    streams = found.where(path.rlike(r"/measurement_stream\.parquet(/|$)"))
    named = F.nullif(F.url_decode(F.regexp_extract(path, r"/dataset_id=([^/]+)/", 1)), F.lit(""))
    return streams.withColumn("dataset_id", F.coalesce("dataset_id", named) if "dataset_id" in found.columns else named)


def write_windows(windows: DataFrame, path: str) -> None:
    """Rows clustered by (dataset, session, hour of session), so that row-group statistics prune by session."""
    table = stable_window_table(windows)
    keys = ["dataset_id", "session_id"]
    slot = F.floor(F.col("window_end_s") / 3600.0)
    table.repartition(*keys, slot).sortWithinPartitions(*keys, "window_end_s").write.mode("overwrite").option("compression", "zstd").parquet(path)


def manifest(table: DataFrame, kind: str, path: str) -> DataFrame:
    return table.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows")).select(
        "dataset_id", F.lit(kind).alias("output_kind"), F.lit(path).alias("path"), "rows", F.current_timestamp().alias("created_at"))


def finalize(spark: SparkSession, stream_path: str, out: str) -> DataFrame:
    """Labels, subjects and the manifest of a written stream; returns the manifest."""
    stream = spark.read.parquet(stream_path)
    label_table(stream).write.mode("overwrite").parquet(f"{out}/labels")
    subject_table(stream).write.mode("overwrite").parquet(f"{out}/subjects")
    m = manifest(stream, "measurement_stream", stream_path)
    for kind in ("labels", "subjects"):
        m = m.unionByName(manifest(spark.read.parquet(f"{out}/{kind}"), kind, f"{out}/{kind}"))
    m.write.mode("overwrite").json(f"{out}/manifest")
    return spark.read.json(f"{out}/manifest")


def build_window_table(stream: DataFrame, out: str, spec: WindowSpec = WindowSpec(), max_sessions: int | None = None) -> DataFrame:
    """Stream to window table on disk; returns the per-dataset summary."""
    if not {"session_id", "sample_offset_s"} <= set(stream.columns):
        raise ValueError("a stream needs session_id and sample_offset_s")
    rows = cap_sessions(stream, max_sessions) if max_sessions else stream
    write_windows(window_features(rows, spec), out)
    written = stream.sparkSession.read.parquet(out)
    return written.groupBy("dataset_id").agg(F.countDistinct("session_id").alias("sessions_windowed"), F.count(F.lit(1)).alias("window_rows"))


def export_csv(table: DataFrame, path: str) -> None:
    flat = table.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in table.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)
