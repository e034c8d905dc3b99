"""Rank metrics and feature statistics, exact and distributed.

Scores are collapsed to (group, score) counts first; ordering work then runs over distinct scores with
two-level prefix sums, so neither ties nor one dominating group end up in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.scale import has_hot_group, null_safe_join, prefix_sums, range_bucket


def _score_counts(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    s = F.col(score).cast("double")
    ok = F.col(y).isNotNull() & s.isNotNull() & ~F.isnan(s)
    return df.where(ok).groupBy(*keys, (-s).alias("__neg")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("n0"))


def ranking_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Per group: rank AUC with average ties, and average precision; NULL when only one class is present."""
    keys = list(keys)
    counts = _score_counts(df, keys, y, score)
    ranked = prefix_sums(counts, keys, "__neg", {"__tp": "n1", "__fp": "n0"})
    # Descending scores: __tp/__fp are the positives/negatives ranked strictly above this score.
    above1, above0 = F.col("__tp").cast("double"), F.col("__fp").cast("double")
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    tp, fp = above1 + n1, above0 + n0
    agg = ranked.groupBy(*keys).agg(
        F.sum(n1).alias("__p"), F.sum(n0).alias("__n"), F.sum(n1 * (above0 + n0 / 2.0)).alias("__lost"),
        F.sum(F.when(F.col("n1") > 0, n1 * tp / (tp + fp)).otherwise(0.0)).alias("__ap"))
    both = (F.col("__p") > 0) & (F.col("__n") > 0)
    return agg.select(
        *keys, F.when(both, 1.0 - F.col("__lost") / (F.col("__p") * F.col("__n"))).alias("auc"),
        F.when(both, F.col("__ap") / F.col("__p")).alias("average_precision"),
        F.col("__p").cast("long").alias("positives"), F.col("__n").cast("long").alias("negatives"))


def probability_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Rows, prevalence, Brier, accuracy and balanced accuracy at a threshold; one pass."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    yes, positive = F.col(p) >= threshold, F.col(y) == 1
    hit1 = F.avg(F.when(positive, yes.cast("double")))
    hit0 = F.avg(F.when(~positive, (~yes).cast("double")))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(y).cast("double")).alias("prevalence"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg((yes == positive).cast("double")).alias("accuracy"),
        ((hit1 + hit0) / 2.0).alias("balanced_accuracy"))


def metric_table(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    return null_safe_join(
        probability_metrics(df, keys, y, p), ranking_metrics(df, keys, y, p).select(*keys, "auc", "average_precision"), list(keys))


def univariate_ranking(long: DataFrame, groups: Sequence[str]) -> DataFrame:
    """AUC and oriented AUC (max(a, 1-a)) of every feature and group in one job over the long form."""
    r = ranking_metrics(long, [*groups, "feature"], "y", "value")
    return r.select(*groups, "feature", "auc", F.greatest(F.col("auc"), 1.0 - F.col("auc")).alias("oriented_auc"))


def shape_vs_shuffle(ranking: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Order advantage of each true-order feature over its shuffled twin."""
    shape = ranking.where(F.col("feature").contains("__shape__")).select(
        *groups, F.col("feature").alias("shape_feature"), F.col("oriented_auc").alias("shape_oriented_auc"),
        F.replace("feature", F.lit("__shape__"), F.lit("__shuffle__")).alias("shuffle_feature"))
    shuffle = ranking.where(F.col("feature").contains("__shuffle__")).select(
        *groups, F.col("feature").alias("shuffle_feature"), F.col("oriented_auc").alias("shuffle_oriented_auc"))
    return shape.join(shuffle, [*groups, "shuffle_feature"]).withColumn(
        "order_advantage", F.col("shape_oriented_auc") - F.col("shuffle_oriented_auc"))


def bh_fdr(df: DataFrame, groups: Sequence[str], p: str = "p", out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p values within each group (NULL p stays NULL)."""
    groups = list(groups)
    pv = df.where(F.col(p).isNotNull()).groupBy(*groups, F.col(p).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    total = pv.groupBy(*groups).agg(F.sum("__c").alias("__m"))
    ranked = null_safe_join(prefix_sums(pv, groups, "__p", {"__before": "__c"}), total, groups)
    raw = ranked.withColumn("__raw", F.col("__p") * F.col("__m") / (F.col("__before") + F.col("__c")))
    adjusted = _suffix_min(raw, groups, "__p", "__raw").withColumn(out, F.least(F.lit(1.0), F.col("__raw_min")))
    joined = df.withColumn("__p", F.col(p))
    return null_safe_join(joined, adjusted.select(*groups, "__p", out), [*groups, "__p"]).drop("__p")


def _suffix_min(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Minimum of ``value`` over the rows at or after each row; bucketed for hot groups."""
    name = f"{value}_min"
    if not has_hot_group(df, keys):
        w = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.min(value).over(w))
    b = range_bucket(df, keys, order)
    cell = [*keys, "__bucket"]
    mins = b.groupBy(*cell).agg(F.min(value).alias("__m1"))
    after = Window.partitionBy(*keys).orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = mins.select(*cell, F.min("__m1").over(after).alias("__carry"))
    local = Window.partitionBy(*cell).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = null_safe_join(b, carry, cell).withColumn(name, F.least(F.min(value).over(local), F.col("__carry")))
    return out.drop("__bucket", "__carry")


def correlation_pairs(wide: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of all feature pairs per group, without a self join.

    Each task folds its rows into one small matrix of sums per group (features x features); only those
    matrices are shuffled. Values are shifted by the overall feature means first, for precision.
    """
    groups, features = list(groups), list(features)
    means = wide.agg(*[F.avg(f).alias(f) for f in features]).first()
    shift = [float(means[f] or 0.0) for f in features]
    m = len(features)
    names = [f.name for f in wide.select(*groups).schema.fields]

    def partial(batches):
        import numpy as np
        import pandas as pd

        state: dict = {}
        for pdf in batches:
            parts = pdf.groupby(names, dropna=False, sort=False) if names else [((), pdf)]
            for key, part in parts:
                key = key if isinstance(key, tuple) else (key,)
                x = part[features].to_numpy(dtype=float) - np.array(shift)
                ok = np.isfinite(x)
                v, k = np.where(ok, x, 0.0), ok.astype(float)
                sums = np.stack([k.T @ k, v.T @ k, k.T @ v, (v * v).T @ k, k.T @ (v * v), v.T @ v])
                tag = tuple(None if pd.isna(part) else part for part in key)
                state[tag] = state.get(tag, 0.0) + sums
        i, j = np.triu_indices(m, 1)
        for tag, s in state.items():
            out = pd.DataFrame({n: pd.Series([val] * len(i), dtype=object) for n, val in zip(names, tag)}, index=range(len(i)))
            out["i"], out["j"] = i.astype("int32"), j.astype("int32")
            for c, mat in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), s):
                out[c] = mat[i, j]
            yield out

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wide.select(*groups).schema.fields)
    schema += "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    sums = wide.select(*groups, *[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(partial, schema)
    total = sums.groupBy(*groups, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    label = F.array(*[F.lit(f) for f in features])
    return total.select(
        *groups, F.get(label, F.col("i")).alias("feature_a"), F.get(label, F.col("j")).alias("feature_b"),
        F.col("n").cast("long").alias("n"), F.when((F.col("n") > 1) & (vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy)).alias("corr"))


def top_redundancy(
    wide: DataFrame, ranking: DataFrame, groups: Sequence[str], features: Sequence[str], k: int = 30, limit: float = 0.95
) -> DataFrame:
    """How many of each group's ``k`` best features repeat each other: ``top_features`` and ``redundant_pairs`` (|corr| >= ``limit``).

    ``ranking`` has the groups, ``feature`` and ``oriented_auc`` (ties: by name; NULL is no rank); those of ``features`` count. Every row puts the
    values of its group's own features into k slots, so the matrices have k columns however many features there are and
    the wide rows are not shuffled by row. Correlations are pairwise complete; a constant feature repeats none. Groups with fewer than two ranked
    features have no row.
    """
    groups, features = list(groups), list(features)
    ranked = ranking.where(F.col("oriented_auc").isNotNull() & F.col("feature").isin(features)).select(*groups, "feature", "oriented_auc")
    best = ranked.withColumn("__rk", F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("oriented_auc").desc(), "feature"))).where(F.col("__rk") <= k)
    picked = best.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("__rk", "feature"))).alias("__top")).where(F.size("__top") >= 2)
    names, values = F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features])
    rows = null_safe_join(wide.select(*groups, values.alias("__v")), picked, groups, "inner")
    slots = [f"__s{i}" for i in range(min(k, len(features)))]
    filled = rows.select(*groups, *[F.get("__v", F.array_position(names, F.get("__top.feature", i)).cast("int") - 1).alias(c) for i, c in enumerate(slots)])
    pairs = correlation_pairs(filled, groups, slots).where(F.abs("corr") >= limit).groupBy(*groups).agg(F.count(F.lit(1)).alias("__pairs"))
    return null_safe_join(picked, pairs, groups).select(
        *groups, F.size("__top").cast("long").alias("top_features"), F.coalesce("__pairs", F.lit(0).cast("long")).alias("redundant_pairs"))


def calibration_error(df: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p", bins: int = 10) -> DataFrame:
    """Expected calibration error from equal-width probability bins."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1).cast("long"))
    per = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, b.alias("__bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(F.col(y).cast("double")).alias("my"))
    return per.groupBy(*keys).agg(
        F.sum("n").alias("rows"), (F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def best_by(df: DataFrame, groups: Sequence[str], label: str, metric: str) -> DataFrame:
    """Label with the highest metric per group (ties: smallest label)."""
    best = F.min_by(F.struct(label, metric), F.struct((-F.col(metric)).alias("m"), F.col(label).alias("l")))
    return df.where(F.col(metric).isNotNull()).groupBy(*groups).agg(best.alias("b")).select(*groups, f"b.{label}", f"b.{metric}")
