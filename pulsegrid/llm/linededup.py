"""Line dedup: lines that stand in many documents are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower, bounded, text_keys, whole
from pulsegrid.session import pinned

#: Stripped at both ends of a line: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the lines whose key (stripped, A-Z lower-cased, ``min_chars`` code points) at least ``min_docs`` documents hold.

    Lines are exploded and hashed to 128 bits, counted once per document with partial sums before each shuffle, and the
    dropped positions go back to their document. The set of common hashes is written, counted, and broadcast only if small.
    One row per document row: id_col, kept (text), n_lines, n_dropped. A null text is one empty line; documents are told
    apart by id and text, so rows that repeat count once and each gets its own result.
    """
    k1, k2 = text_keys(whole(text_col))
    base = docs.select(F.col(id_col), whole(text_col).alias("text"), k1.alias("k1"), k2.alias("k2"))
    lines = base.select(id_col, "k1", "k2", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", ascii_lower(F.btrim("line", F.lit(BLANKS)))).where(F.char_length("key") >= min_chars)
    a, b = text_keys(F.col("key"))
    lines = lines.select(id_col, "k1", "k2", "pos", a.alias("a"), b.alias("b"))
    counts = lines.groupBy("a", "b", id_col, "k1", "k2").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("*").alias("n"))
    common = bounded(pinned(counts.where(F.col("n") >= min_docs).select("a", "b")))
    gone = lines.join(common, ["a", "b"], "left_semi").groupBy(id_col, "k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    gone = gone.withColumnsRenamed({id_col: "__id", "k1": "__k1", "k2": "__k2"})
    both = base.join(gone, base[id_col].eqNullSafe(gone["__id"]) & (base["k1"] == gone["__k1"]) & (base["k2"] == gone["__k2"]), "left")
    both = both.select(id_col, "text", F.split("text", "\n").alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # The runs of lines between two dropped ones, in order: work in proportion to lines, whatever is dropped.
    runs = F.zip_with(
        F.concat(F.array(F.lit(-1)), F.col("gone")), F.concat(F.col("gone"), F.array(F.size("lines"))), lambda s, e: F.slice("lines", s + 2, e - s - 1)
    )
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return both.select(id_col, kept.alias("kept"), F.size("lines").cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_dropped"))
