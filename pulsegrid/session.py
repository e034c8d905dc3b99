"""Session settings and stable materialisation points."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Groups larger than this many rows take the range-bucketed (multi-task) path.
HOT_GROUP_ROWS = "spark.pulsegrid.hotGroupRows"
HOT_GROUP_ROWS_DEFAULT = 4_000_000


def build_session(app: str = "pulsegrid", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every job here expects; cluster settings are left alone."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Stages after an exchange multiply their rows here (windows per sample), so keep partitions small.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared scratch folder: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is used only for a local master, where one machine is the cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
        return path
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")


def pinned(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that every later use sees the same rows.

    Needed where a table comes from a merge-order-dependent sketch: two branches of one plan must
    not see different cut points, also after an executor loss.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again. For loops: a checkpoint carries its plan's constraints along, which
    double from round to round."""
    path = f"{shared_dir(df.sparkSession)}/pulsegrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_GROUP_ROWS, str(HOT_GROUP_ROWS_DEFAULT)))
