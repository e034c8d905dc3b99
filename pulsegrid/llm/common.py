"""Column helpers shared by the operators: words, document keys, sizes that decide on a broadcast."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a two-number side table is hinted for broadcast (about 30 MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of an Arrow batch. Spark's 10,000 rows of texts are some 30 MB and more, which the JVM lays out in buffers that double and Python holds again.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text. With the id they name a document, whether ids are null, repeated or neither."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def bounded(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` with a broadcast hint if it was counted to be small. It must be cheap to count (a written table)."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def mapped(df: DataFrame, kernel: Callable, schema: T.StructType) -> DataFrame:
    """``df`` through an Arrow kernel in batches of about BATCH_BYTES (a longer row is a batch of its own)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()  # the worker is used again; what its pool keeps is gone for the executor

    return df.mapInArrow(run, schema)


#: Paths made inside the open scopes, the innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the scratch tables made inside it. Write results before: frames built in the scope read these tables."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCOPES.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder of the cluster."""
    path = f"{shared_dir(spark).rstrip('/')}/pulsegrid-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: compressed, and no lineage behind it."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
