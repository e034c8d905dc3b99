"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned by every training window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower, text_keys

#: Everything that is neither a digit, a-z nor beyond ASCII (A-Z are lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark windows in one broadcast set (some 50 MB). More of them are scanned for in blocks of this size.
BLOCK_WINDOWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _gram_key(hashes: Column, at: Column | int, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(hashes, at + F.lit(j)) for j in range(length)])


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: gram (words), items (ids as strings). Shorter items are one window, empty ones none; a null id is ''."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words"))
    size = F.size("words")
    long = F.least(size, F.lit(n))
    grams = items.where(size > 0).select("item", F.explode_outer(F.transform(F.sequence(F.lit(0), size - long), lambda i: F.slice("words", i + 1, long))).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_WINDOWS) -> DataFrame:
    """Words of each document that lie inside a benchmark window, and the items these windows are from.

    The distinct windows of the benchmark are counted and broadcast, ``block`` at most at a time, by a 64-bit key; every
    position of every document asks for its key once, and a find is verified word by word. One row per document row:
    id_col, k1, k2 (the text's key), n_words, n_hit, spans (start, words; sorted), items (sorted strings). Null or empty texts have
    no words; rows that repeat give as many rows; the benchmark may be empty.
    """
    windows = benchmark_windows(benchmark, n).withColumn("long", F.size("gram")).withColumn("h", F.transform("gram", lambda w: F.xxhash64(w)))
    stats = windows.agg(F.collect_set("long").alias("lengths"), F.count("*").alias("n")).first()  # at most n lengths
    lengths, blocks = sorted(stats["lengths"]), max(1, -(-stats["n"] // block))
    keyed = windows.select(
        reduce(lambda c, k: c.when(F.col("long") == k, _gram_key(F.col("h"), 0, k)), lengths, F.when(F.lit(False), F.lit(0).cast("bigint"))).alias("key"), "gram", "items"
    )

    k1, k2 = text_keys(F.coalesce(F.col(text_col), F.lit("")))
    scan = docs.select(F.col(id_col), k1.alias("k1"), k2.alias("k2"), words_of(F.col(text_col)).alias("words"))
    scan = scan.withColumn("n", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    # One row per position, keyed in generated code; the last one stands for the document, so that one without a hit stays.
    scan = scan.select(id_col, "k1", "k2", "n", "words", "h", F.posexplode_outer(F.concat("h", F.array("k1"))).alias("at", "own"))
    if len(lengths) > 1:
        scan = scan.withColumn("long", F.explode(F.array(*[F.lit(k) for k in lengths]))).where((F.col("at") < F.col("n")) | (F.col("long") == lengths[0]))
    else:
        scan = scan.withColumn("long", F.lit(lengths[0] if lengths else 0))
    itself = F.col("at") == F.col("n")
    key = reduce(lambda c, k: c.when(F.col("long") == k, _gram_key(F.col("h"), F.col("at"), k)), lengths, F.when(itself, F.col("own")))
    scan = scan.select(id_col, "k1", "k2", "n", "at", "words", "long", key.alias("key"))

    parts = []
    for b in range(blocks):
        some = keyed if blocks == 1 else keyed.where(F.pmod("key", F.lit(blocks)) == b)
        rows = scan if b == 0 else scan.where(~itself)
        parts.append(rows.join(F.broadcast(some), "key", "left"))
    found = reduce(DataFrame.unionByName, parts)

    hit = ~itself & F.col("gram").isNotNull() & (F.col("long") == F.size("gram")) & (F.slice("words", F.col("at") + 1, F.size("gram")) == F.col("gram"))
    found = found.where(itself | hit).select(
        id_col, "k1", "k2", "n", itself.alias("itself"), F.when(~itself, F.struct(F.col("at").alias("start"), F.col("long").alias("words"))).alias("span"), F.when(~itself, F.col("items")).alias("items")
    )
    per = found.groupBy(id_col, "k1", "k2").agg(
        F.max("n").cast("bigint").alias("n_words"), F.count_if("itself").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    zero = F.lit(0).cast("bigint")
    union = F.aggregate(
        "spans",
        F.struct(zero.alias("upto"), zero.alias("total")),
        lambda a, s: F.struct(
            F.greatest(a["upto"], (s["start"] + s["words"]).cast("bigint")).alias("upto"),
            (a["total"] + F.greatest(zero, s["start"] + s["words"] - F.greatest(a["upto"], s["start"].cast("bigint")))).alias("total"),
        ),
        lambda a: a["total"],
    )
    return per.select(id_col, "k1", "k2", "n_words", union.alias("n_hit"), "spans", "items", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_")).drop("_")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all its columns stay as they are."""
    hit = contamination(docs, benchmark, n, id_col, text_col).where("n_hit > 0").select(F.col(id_col).alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    k1, k2 = text_keys(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(hit, docs[id_col].eqNullSafe(hit["__id"]) & (k1 == hit["__k1"]) & (k2 == hit["__k2"]), "left_anti")
