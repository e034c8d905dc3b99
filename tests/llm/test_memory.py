"""What a task holds at once: Arrow batches are bounded by bytes, and training vectors keep no empty buckets."""

import pyarrow as pa
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import common, quality


def test_batches_of_long_texts_are_cut_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "b"])

    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 500).alias("text"))
    longs = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "b")])
    found = common.mapped(docs, sizes, longs).collect()
    assert sum(r["n"] for r in found) == 3000 and sum(r["b"] for r in found) > 12_000_000
    assert max(r["b"] for r in found) < 1.5 * common.BATCH_BYTES


def test_the_quality_stage_bounds_its_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "mapped", lambda df, kernel, schema: seen.append(kernel) or common.mapped(df, kernel, schema))
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert quality.quality(docs, None).count() == 2 and len(seen) == 1


def test_training_vectors_are_sparse(spark, monkeypatch):
    rows = [(i, f"good words about {i} rivers and boats" if i % 2 else f"bad $$$ {i} !!! click") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    kinds, fit = [], quality.LogisticRegression.fit
    monkeypatch.setattr(quality.LogisticRegression, "fit", lambda self, table: kinds.append(type(table.first()["features"])) or fit(self, table))
    model = quality.train(docs, labels)
    assert kinds[0] is SparseVector and len(model.weights) == quality.FAMILIES * quality.BUCKETS
    kept = {r["doc_id"]: r["probability"] for r in quality.quality(docs, model).collect()}
    assert min(p for i, p in kept.items() if i % 2) > max(p for i, p in kept.items() if not i % 2)
