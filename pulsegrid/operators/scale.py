"""Exact order statistics that stay distributed when one group holds a large share of the rows.

``Window.partitionBy(key)`` and ``percentile`` put a whole group into one task. That is right for
the usual many-small-groups case and wrong for a group with billions of rows. Every function here
checks the largest group with one column-pruned count. Above the limit, quantiles are selected inside brackets of a
sketch; the others split the hot range
into buckets of roughly equal size: bucket totals give each bucket its carry-in, and the ordering
work is done per (group, bucket). Results are identical on both paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import hot_group_rows, pinned

BUCKETS = 256


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join that also matches NULL keys; the right key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def has_hot_group(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when some group exceeds the limit. One partial-aggregated pass over the key columns."""
    limit = limit or hot_group_rows(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return bool(counts.where(F.col("__n") > limit).take(1))


def range_bucket(df: DataFrame, keys: Sequence[str], order: str, buckets: int = BUCKETS, limit: int | None = None) -> DataFrame:
    """Add ``__bucket``, monotone in ``order`` within each group: roughly equal buckets for hot groups, 0 for others.

    Cut points come from a mergeable sketch (fixed size per group) and are pinned, because a sketch
    may differ between two evaluations of the same plan. At most rows / limit groups can be hot.
    """
    limit = limit or hot_group_rows(df.sparkSession)
    probs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sketch = F.percentile_approx(F.col(order).cast("double"), probs, buckets * 16).alias("__cuts")
    cuts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), sketch).where(F.col("__n") > limit).drop("__n")
    joined = null_safe_join(df, pinned(cuts), keys) if keys else df.withColumn("__cuts", F.lit(pinned(cuts).first()[0]))
    below = F.size(F.filter("__cuts", lambda c: c < F.col(order).cast("double")))
    bucket = F.when(F.col("__cuts").isNotNull(), below).otherwise(F.lit(0))
    return joined.withColumn("__bucket", bucket).drop("__cuts")


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str | Column],
    tie_breakers: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """For each output name add the sum of its expression over all *earlier* rows of the group.

    ``order`` must be numeric; with ``tie_breakers`` the rows must be unique under (order, *ties).
    """
    terms = {name: (F.col(e) if isinstance(e, str) else e) for name, e in sums.items()}
    zero = F.lit(0)
    if not has_hot_group(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(order, *tie_breakers).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(e).over(w), zero) for n, e in terms.items()})
    bucketed = range_bucket(df, keys, order, limit=limit)
    cell = [*keys, "__bucket"]
    totals = bucketed.groupBy(*cell).agg(*[F.sum(e).alias(f"__t_{n}") for n, e in terms.items()])
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *cell, *[F.coalesce(F.sum(f"__t_{n}").over(before), zero).alias(f"__c_{n}") for n in terms]
    )
    local = Window.partitionBy(*cell).orderBy(order, *tie_breakers).rowsBetween(Window.unboundedPreceding, -1)
    joined = null_safe_join(bucketed, carry, cell)
    out = joined.withColumns(
        {n: F.coalesce(F.sum(e).over(local), zero) + F.col(f"__c_{n}") for n, e in terms.items()}
    )
    return out.drop("__bucket", *[f"__c_{n}" for n in terms])


def running_index(
    df: DataFrame, keys: Sequence[str], order: str, name: str, tie_breakers: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """0-based position of each row in its group (a per-session running counter)."""
    if not has_hot_group(df, keys, limit):
        w = Window.partitionBy(*keys).orderBy(order, *tie_breakers)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    out = prefix_sums(df, keys, order, {name: F.lit(1)}, tie_breakers, limit)
    return out.withColumn(name, F.col(name).cast("long"))


def quantile_names(column: str, probs: Sequence[float]) -> list[str]:
    return [f"{column}__q{int(round(p * 1000)):03d}" for p in probs]


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], limit: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per group and column, one row per group.

    Output columns are ``{column}__qPPP`` (per mille). NULLs are ignored; an empty column gives NULL.
    """
    keys, probs = list(keys), [float(p) for p in probs]
    names = [n for c in columns for n in quantile_names(c, probs)]

    def packed(rows: DataFrame) -> DataFrame:
        arr = F.array(*[F.lit(p) for p in probs])
        arrays = rows.groupBy(*keys).agg(*[F.percentile(F.col(c), arr).alias(c) for c in columns])
        return arrays.select(*keys, *[F.get(F.col(c), i).alias(n) for c in columns for i, n in enumerate(quantile_names(c, probs))])

    above = F.col("__rows") > (limit or hot_group_rows(df.sparkSession))
    counts = pinned(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")))
    hot = counts.where(above).select(*keys, F.lit(1).alias("__hot"))
    if not hot.take(1):
        return packed(df)
    if not counts.where(~above).take(1):
        return _selected(df, hot, keys, columns, probs).select(*keys, *names)
    chosen = _selected(null_safe_join(df, hot, keys, "left_semi"), hot, keys, columns, probs).select(*keys, *names)
    return packed(null_safe_join(df, hot, keys, "left_anti")).unionByName(chosen)


#: Entries of the quantile sketch of a hot group, and the shares of its rows on either side of a quantile that are looked at
#: exactly. The next one serves only if the sketch was off by more; the last one takes all rows.
SKETCH, MARGINS = 10_000, (2e-4, 1e-2, 1.0)


def _selected(df: DataFrame, groups: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of the large ``groups`` by selection: a sketch brackets each one, rows outside of the brackets are counted and only
    those inside are put in order. No step moves more of the rows than the brackets hold."""
    values = df.select(*keys, *[F.col(c).cast("double").alias(f"__v{j}") for j, c in enumerate(columns)])
    cells = [(j, i) for j in range(len(columns)) for i in range(len(probs))]
    picked = None
    for margin in MARGINS:
        sketches = [F.count(f"__v{j}").alias(f"__n{j}") for j in range(len(columns))]
        if margin < 1:
            ends = F.array(*[F.lit(min(1.0, max(0.0, p + side * margin))) for p in probs for side in (-1, 1)])
            sketches += [F.percentile_approx(f"__v{j}", ends, SKETCH).alias(f"__e{j}") for j in range(len(columns))]
        else:  # NaN is above all other numbers
            whole = F.array(*[F.lit(float(x)) for _ in probs for x in ("-inf", "nan")])
            sketches += [F.first(whole).alias(f"__e{j}") for j in range(len(columns))]
        brackets = pinned(values.groupBy(*keys).agg(*sketches))
        near = null_safe_join(values, F.broadcast(brackets), keys, "inner")
        parts = []
        for j in range(len(columns)):
            v = F.col(f"__v{j}")
            ends = [(F.get(f"__e{j}", 2 * i), F.get(f"__e{j}", 2 * i + 1)) for i in range(len(probs))]
            # Grows with the value; rows of one region are all inside of a bracket or all outside.
            region, inside = F.lit(0), F.lit(False)
            for low, high in ends:
                region, inside = region + (v >= low).cast("int") + (v > high).cast("int"), inside | ((v >= low) & (v <= high))
            rows = near.where(v.isNotNull()).select(*keys, F.lit(j).alias("j"), region.alias("region"), inside.alias("inside"), F.when(inside, v).alias("v"))
            parts.append(rows.groupBy(*keys, "j", "region", "inside", "v").agg(F.count(F.lit(1)).alias("__c")))
        ties = parts[0]
        for more in parts[1:]:
            ties = ties.unionByName(more)
        flat = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.lit(probs[i]).alias("p"), F.col(f"__n{j}").alias("n")) for j, i in cells])
        asked = brackets.select(*keys, F.explode_outer(flat).alias("a")).select(*keys, "a.*").where("n > 0")
        asked = asked.withColumn("__pos", F.col("p") * (F.col("n") - 1))
        before = F.sum("__c").over(Window.partitionBy(*keys, "j").orderBy("region", "v").rowsBetween(Window.unboundedPreceding, -1))
        ranked = null_safe_join(ties.withColumn("__before", F.coalesce(before, F.lit(0))), F.broadcast(asked), [*keys, "j"], "inner")
        at = lambda rank: F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__c")), F.col("v")))
        found = ranked.groupBy(*keys, "j", "i", "__pos").agg(at(F.floor("__pos")).alias("lo"), at(F.ceil("__pos")).alias("hi")).drop("__pos")
        picked = pinned(null_safe_join(asked, found, [*keys, "j", "i"], "left"))
        if not picked.where("lo is null or hi is null").take(1):
            break
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("__pos") - F.floor("__pos")))
    wide = picked.withColumn("__q", value).groupBy(*keys).agg(
        *[F.max(F.when((F.col("j") == j) & (F.col("i") == i), F.col("__q"))).alias(quantile_names(columns[j], probs)[i]) for j, i in cells])
    return null_safe_join(groups, wide, keys) if keys else wide
