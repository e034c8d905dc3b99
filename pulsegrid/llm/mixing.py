"""Mixing sources to target weights: integer block quotas by highest quotients, then seeded blocks of shuffled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import whole
from pulsegrid.session import pinned

SPACES = r"[\x20\x09-\x0D]+"
#: Words of a block and (about) of a shard of a source.
BLOCK_WORDS, SHARD_WORDS = 32, 1 << 20


def sainte_lague(parts: DataFrame, group: list[str], key: list[str], value: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group dealt to its rows by the highest quotients value / (2k + 1).

    All seats below a proven floor (share - share of rows / 2 - 2) are dealt at once; only the few quotients around the share
    are ranked, so the work grows with the rows and not with the seats. Ties go to the lower ``key``; rows of value 0 get none.
    """
    over = Window.partitionBy(*group)
    part = F.try_divide(F.col(value), F.sum(value).over(over))
    ranged = parts.withColumn("__part", F.coalesce(part, F.lit(0.0))).withColumn("__n", F.count(F.lit(1)).over(over))
    share = F.floor(F.col("__part") * F.col(seats))
    slack = F.ceil(F.col("__part") * F.col("__n") / 2) + 2
    ranged = ranged.withColumn("__floor", F.when(F.col(value) > 0, F.greatest(F.lit(0), share - slack)).otherwise(F.lit(0)))
    ranged = ranged.withColumn("__rest", F.col(seats) - F.sum("__floor").over(over)).withColumn("__top", share + slack)
    tries = ranged.where(F.col(value) > 0).select("*", F.explode_outer(F.sequence("__floor", "__top")).alias("__k"))
    tries = tries.withColumn("__q", F.col(value) / (2 * F.col("__k") + 1))
    rank = F.row_number().over(over.orderBy(F.desc("__q"), *[F.asc_nulls_last(c) for c in key], "__k"))
    won = tries.withColumn("__won", rank <= F.col("__rest")).groupBy(*group, *key).agg((F.first("__floor") + F.count_if("__won")).alias("quota"))
    ids = [*group, *key]
    won = won.withColumnsRenamed({c: f"__{c}" for c in ids})
    joined = parts.join(won, [parts[c].eqNullSafe(won[f"__{c}"]) for c in ids], "left")
    return joined.drop(*[f"__{c}" for c in ids]).withColumn("quota", F.coalesce("quota", F.lit(0).cast("bigint")))


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size -> target: weights 1, 2, 3, repeating over the sources by code point (null last) share all words;

    a target stops at ``most`` times its source, and what is left over is shared again by weight until none is above.
    With sources by cap / weight, the capped ones come first, so the final level is found by running sums.
    """
    every = Window.partitionBy()
    s = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1)
    s = s.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("__try", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level")))
    s = s.withColumn("__level", F.min("__try").over(every)["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce("__level", F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: int = 1, most: int = 3, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes which words of each document.

    A source is cut into shards of about ``shard_words`` by a seeded hash of its documents, and a shard, its documents in seeded
    order, into equal-token blocks. Sources get integer block quotas for their targets, then shards for their source's
    quota. A shard gives all its blocks as often as its quota allows and the rest once more from a seeded block
    on, round its end: so a document is taken whole but at the two ends of that run. No task sees more than a shard.
    One row per document row: id_col, source, md5, occurrence (among equal rows), size, source_size, target, full (times that all
    words are taken), cuts (array of first word, words: taken once more), taken. Null texts have size 0; equal rows are taken each
    for itself; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col), F.col(source_col).alias("source"), F.md5(whole(text_col)).alias("md5"), F.size(F.array_remove(F.split(whole(text_col), SPACES), "")).cast("bigint").alias("size"))
    slim = slim.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), "md5")))
    slim = pinned(slim)
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    target = source_targets(per_source, most).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)))
    target = target.withColumnRenamed("source", "__source")
    rows = slim.join(target, slim["source"].eqNullSafe(target["__source"])).drop("__source")
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.col("shards")))

    shards = rows.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").alias("shard_size"))
    shards = shards.withColumn("blocks", F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words))).otherwise(F.lit(0)).cast("bigint"))
    sources = shards.groupBy("source", "source_size", "target").agg(F.sum("blocks").alias("blocks"))
    sources = sources.withColumn("want", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))).withColumn("all", F.lit(0))
    sources = sources.withColumn("seats", F.round(F.sum("want").over(Window.partitionBy("all"))).cast("bigint"))
    sources = sainte_lague(sources, ["all"], ["source"], "want", "seats").select(F.col("source").alias("__source"), F.least("quota", most * F.col("blocks")).alias("seats"))
    shards = shards.join(sources, shards["source"].eqNullSafe(sources["__source"])).drop("__source")
    shards = sainte_lague(shards, ["source"], ["shard"], "blocks", "seats").withColumn("quota", F.least("quota", most * F.col("blocks")))
    # From here on a shard is a range of words [0, shard_size): the extra run of blocks is one range of it, or two.
    n, size = F.greatest("blocks", F.lit(1)), F.col("shard_size")
    first = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("-")), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("bigint"), n)
    at = lambda b: F.floor((b * size + n - 1) / n)
    rest = F.pmod("quota", n)
    shards = shards.select(
        F.col("source").alias("__source"), F.col("shard").alias("__shard"), F.floor(F.col("quota") / n).alias("full"), at(first).alias("a0"),
        F.least(size, at(first + rest)).alias("a1"), F.greatest(F.lit(0), at(first + rest - n)).alias("b1"),
    )
    order = Window.partitionBy("source", "shard").orderBy("h", "size")
    rows = rows.withColumn("hi", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("size"))
    rows = rows.withColumn("occurrence", F.row_number().over(order) - F.rank().over(order))  # equal rows tie in this order
    rows = rows.join(shards, rows["source"].eqNullSafe(shards["__source"]) & (rows["shard"] == shards["__shard"]))
    cut = lambda a, b: F.struct((F.greatest("lo", a) - F.col("lo")).alias("first"), F.greatest(F.lit(0), F.least("hi", b) - F.greatest("lo", a)).alias("words"))
    cuts = F.filter(F.array(cut(F.lit(0).cast("bigint"), F.col("b1")), cut(F.col("a0"), F.col("a1"))), lambda c: c["words"] > 0)
    rows = rows.withColumn("cuts", cuts)
    taken = F.col("full") * F.col("size") + F.aggregate("cuts", F.lit(0).cast("bigint"), lambda t, c: t + c["words"])
    return rows.select(id_col, "source", "md5", "occurrence", "size", "source_size", "target", "full", "cuts", taken.alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 1, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document as often as it is taken whole, and once with the words of its cuts.

    Documents of which nothing is taken go. Cut texts are their words, joined by spaces; ``chars_col`` is counted anew there.
    """
    plan = mix(docs, seed, most, id_col=id_col, text_col=text_col, source_col=source_col).where("taken > 0")
    plan = plan.select(F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("md5").alias("__plan_md5"), F.col("occurrence").alias("__plan_occ"), F.col("full").alias("__full"), F.col("cuts").alias("__cuts"))
    keyed = docs.withColumn("__md5", F.md5(whole(text_col)))
    same = Window.partitionBy(id_col, source_col, "__md5").orderBy(F.lit(0))
    keyed = keyed.withColumn("__occ", F.row_number().over(same) - 1)
    both = keyed.join(plan, keyed[id_col].eqNullSafe(plan["__id"]) & keyed[source_col].eqNullSafe(plan["__source"]) & (keyed["__md5"] == plan["__plan_md5"]) & (keyed["__occ"] == plan["__plan_occ"]))
    words = F.array_remove(F.split(whole(text_col), SPACES), "")
    piece = F.array_join(F.flatten(F.transform("__cuts", lambda c: F.slice(words, c["first"].cast("int") + 1, c["words"].cast("int")))), " ")
    copies = F.array_repeat(F.lit(None).cast("string"), F.col("__full").cast("int"))
    pieces = F.when(F.size("__cuts") > 0, F.array_append(copies, piece)).otherwise(copies)
    out = both.withColumn("__piece", F.explode_outer(pieces))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.coalesce("__piece", F.col(c)).alias(c))
        elif c == chars_col:
            cols.append(F.when(F.col("__piece").isNotNull(), F.char_length("__piece").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)
