"""Label, sensor and coverage summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.scale import exact_quantiles, null_safe_join


def label_distribution(df: DataFrame, groups: Sequence[str], distinct: dict[str, str]) -> DataFrame:
    """Rows and distinct counts per group; NULL groups are kept."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), *[F.countDistinct(c).alias(n) for n, c in distinct.items()]
    )


def group_summary(df: DataFrame, groups: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """count / median / mean / std (sample) of every sensor per group, flat ``sensor__stat`` columns."""
    aggs: list[Column] = []
    for s in sensors:
        aggs += [F.count(s).alias(f"{s}__count"), F.avg(s).alias(f"{s}__mean"), F.stddev_samp(s).alias(f"{s}__std")]
    medians = exact_quantiles(df, groups, list(sensors), (0.5,))
    renamed = medians.select(*groups, *[F.col(f"{s}__q500").alias(f"{s}__median") for s in sensors])
    return null_safe_join(df.groupBy(*groups).agg(*aggs), renamed, list(groups))


def quantile_summary(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """n / median / mean / p10 / p90 per group; an empty series gives n = 0 and NULLs."""
    q = exact_quantiles(df, groups, [value], (0.1, 0.5, 0.9))
    base = df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    named = q.select(*groups, F.col(f"{value}__q500").alias("median"), F.col(f"{value}__q100").alias("p10"),
                     F.col(f"{value}__q900").alias("p90"))
    return null_safe_join(base, named, list(groups))


def session_target_summary(df: DataFrame, groups: Sequence[str], target: str) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.min(target).alias("pain_min"), F.max(target).alias("pain_max"), F.count(target).alias("pain_labeled_rows"))


def observed_values(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Sorted distinct values per group: deduplicated before grouping, so heavy repeats never gather."""
    return df.select(*groups, value).distinct().groupBy(*groups).agg(F.sort_array(F.collect_set(value)).alias(name))


def sensor_coverage(df: DataFrame, group: str, flags: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in flags])


def group_means(df: DataFrame, groups: Sequence[str], columns: Sequence[str], places: int = 4) -> DataFrame:
    """Rounded means over complete rows only (a row with any missing column is left out)."""
    return df.na.drop(subset=[*groups, *columns]).groupBy(*groups).agg(*[F.round(F.avg(c), places).alias(c) for c in columns])


def both_class_subjects(df: DataFrame, groups: Sequence[str], subject: str, y: str) -> DataFrame:
    per = df.where(F.col(y).isNotNull()).groupBy(*groups, subject).agg(F.min(y).alias("lo"), F.max(y).alias("hi"))
    return per.groupBy(*groups).agg(F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("both_class_subjects"))
