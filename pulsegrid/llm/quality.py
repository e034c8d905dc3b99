"""Quality rules: fixed text statistics, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import mapped
from pulsegrid.llm.tokens import SPACE, gram_hashes, mix64, rows_of, span_hashes, text_parts, within, word_spans

#: Hash buckets for words, word pairs and byte trigrams (in this order); the model is one number for each.
BUCKETS = 1 << 12
FAMILIES = 3
#: Labelled rows that training uses at most, those with the lowest seeded hash: the bound of the fit.
TRAIN_ROWS = 6_000
#: Fixed threshold on the calibrated probability of good quality.
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def hashed_grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every word, word pair and byte trigram of the rows."""
    starts, ends, of = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    pairs = within(of, 2)
    thrice = within(offsets, 3)
    wide = data.astype(np.uint64)
    chars = mix64(wide[thrice] | wide[thrice + 1] << np.uint64(8) | wide[thrice + 2] << np.uint64(16)) if len(thrice) else np.zeros(0, np.uint64)
    found = []
    for k, (hashes, at, ends_at) in enumerate(((words, np.arange(len(words)), of), (gram_hashes(words, 2)[pairs] if len(pairs) else words[:0], pairs, of), (chars, thrice, offsets))):
        found.append(((hashes & np.uint64(BUCKETS - 1)).astype(np.int64) + k * BUCKETS, rows_of(at, ends_at)))
    return found


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text -> label, features: the share of each bucket among the row's n-grams of its family."""
    for batch in batches:
        for first, end, data, offsets in text_parts(batch.column("text"), rows=128):
            table = np.zeros((end - first, FAMILIES * BUCKETS), np.float32)
            for buckets, rows in hashed_grams(data, offsets):
                if len(rows):
                    np.add.at(table, (rows, buckets), np.float32(1) / np.bincount(rows, minlength=end - first)[rows].astype(np.float32))
            lists = pa.ListArray.from_arrays(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1], pa.array(table.ravel().astype(np.float64)))
            kept = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([kept.column("label"), kept.column("fold"), lists], ["label", "fold", "features"])


class QualityModel:
    """Weights of the hashed n-grams, and slope and offset that turn a margin into a calibrated probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.full(len(offsets) - 1, self.bias)
        for buckets, rows in hashed_grams(data, offsets):
            n = np.bincount(rows, minlength=len(total))
            total += np.bincount(rows, weights=self.weights[buckets], minlength=len(total)) / np.maximum(n, 1)
        return total

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.offset, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    """Fits on at most ``rows`` labelled documents (lowest hashes); a fifth of them only calibrates (Platt scaling).

    Null labels, ids or texts don't train. None if the labels have fewer than two classes: then there is nothing to learn.
    """
    # The sample is taken among the labels, so only its documents are looked up.
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label"))
    some = some.withColumn("h", F.xxhash64(F.lit(5), "__id")).orderBy("h", "__id", "label").limit(rows)
    found = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(some), F.col(id_col) == F.col("__id")).select("label", (F.pmod("h", F.lit(5)) == 0).cast("int").alias("fold"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("fold", T.IntegerType()), T.StructField("features", T.ArrayType(T.DoubleType()))])
    dense = mapped(found.repartition(12), _frequencies, schema).select("label", "fold", array_to_vector("features").alias("dense"))
    # Most buckets of a text are empty; the assembler makes sparse vectors of such, so that the fit's copies of the table are small.
    # Told the size, it doesn't read a first row for it.
    dense = VectorSizeHint(inputCol="dense", size=FAMILIES * BUCKETS, handleInvalid="optimistic").transform(dense)
    table = VectorAssembler(inputCols=["dense"], outputCol="features").transform(dense).drop("dense").persist()
    classes = {(r["label"], r["fold"]) for r in table.select("label", "fold").distinct().collect()}  # four at most
    if len({c for c, f in classes if f == 0}) < 2:
        table.unpersist()
        return None
    fit = LogisticRegression(regParam=1e-3, maxIter=30, standardization=True).fit(table.where("fold = 0"))
    weights, bias = fit.coefficients.toArray(), float(fit.intercept)
    slope, offset = 1.0, 0.0
    if len({c for c, f in classes if f == 1}) == 2:
        margin = fit.transform(table.where("fold = 1")).select("label", array_to_vector(F.array(vector_to_array("rawPrediction")[1])).alias("features"))
        platt = LogisticRegression(regParam=1e-3, maxIter=30).fit(margin)
        slope, offset = float(platt.coefficients[0]), float(platt.intercept)
    table.unpersist()
    return QualityModel(weights, bias, slope, offset)


def _repeats(words: np.ndarray, of: np.ndarray, window: int) -> np.ndarray:
    """Per row: words inside a window of ``window`` words that stands at least twice in the row."""
    out = np.zeros(len(of) - 1, np.int64)
    at = within(of, window)
    if not len(at):
        return out
    rows = rows_of(at, of)
    keys = mix64(gram_hashes(words, window)[at] + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    edge = np.zeros(int(of[-1]) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + window, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    return covered[of[1:]] - covered[of[:-1]]


def text_statistics(data: np.ndarray, offsets: np.ndarray, texts: list[str]) -> dict[str, np.ndarray]:
    starts, ends, of = word_spans(data, offsets)
    sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    lead = (data & 0xC0) != 0x80  # the first byte of a code point
    dup = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(of),
        "word_chars": sums(lead & ~SPACE[data]),
        "n_symbols": sums(SYMBOLS[data]),
        "n_dup_lines": dup,
        "n_repeat_words": _repeats(span_hashes(data, starts, ends), of, REPEAT_WINDOW),
    }


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, model: QualityModel | None, keep_from: float = KEEP_FROM, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability and kept (names after ``prefix``).

    One pass in Arrow batches, no shuffle; rows keep all their columns, but for those with
    one of these names, which are replaced. A null or empty text has no words, so its base rules
    fail. Without a model the base rules decide alone (probability null).
    """
    names = [prefix + x for x in (*STATISTICS, "base_failed", "probability", "kept")]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            column = batch.column(text_col)
            for first, end, data, offsets in text_parts(column):
                stats = text_statistics(data, offsets, [x or "" for x in column.slice(first, end - first).to_pylist()])
                failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])
                p = fitted.probabilities(data, offsets) if fitted else np.full(end - first, np.nan)
                kept = ~failed & ((p >= keep_from) | np.isnan(p))
                added = [pa.array(stats[x].astype(np.int64)) for x in STATISTICS]
                added += [pa.array(failed), pa.array(p, mask=np.isnan(p)), pa.array(kept)]
                rows = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, *names])

    kinds = [T.LongType()] * len(STATISTICS) + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    return mapped(docs, score, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]]))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that quality() rejects, with a model trained on ``labels``; their columns are untouched."""
    return quality(docs, train(docs, labels), text_col=text_col, prefix="__").where("__kept").select(*docs.columns)

