"""Statistics of one dense signal held in an array column, as higher-order function expressions.

Computed arrays are always exploded with the outer variants in this package: a plain explode makes the
optimizer infer a non-empty filter on the array expression and inline it, nested lambdas included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolated quantile of an ascending array."""
    pos = F.lit(float(p)) * (F.size(ordered) - 1)
    lo = F.floor(pos).cast("int")
    low, high = F.get(ordered, lo), F.get(ordered, F.ceil(pos).cast("int"))
    return low + (high - low) * (pos - lo)


def mean(arr: Column) -> Column:
    return _sum(arr) / F.size(arr)


def diffs(arr: Column) -> Column:
    """Successive differences (one element shorter)."""
    n = F.size(arr)
    return F.zip_with(F.slice(arr, 2, F.greatest(n - 1, F.lit(0))), F.slice(arr, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def pop_std(arr: Column, mu: Column) -> Column:
    return F.sqrt(_sum(F.transform(arr, lambda v: (v - mu) * (v - mu))) / F.size(arr))


def longest_run(flags: Column) -> Column:
    """Length of the longest stretch of true values."""
    zero = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best"))

    def step(s, f):
        cur = F.when(f, s["cur"] + 1).otherwise(F.lit(0))
        return F.struct(cur.alias("cur"), F.greatest(s["best"], cur).alias("best"))

    return F.aggregate(flags, zero, step)["best"]


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two equally long arrays; NULL where either spread is below 1e-12."""
    ma, mb = mean(a), mean(b)
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("xx", "yy", "xy")], ma.alias("ma"), mb.alias("mb"))

    def step(s, p):
        dx, dy = p["x"] - s["ma"], p["y"] - s["mb"]
        return F.struct((s["xx"] + dx * dx).alias("xx"), (s["yy"] + dy * dy).alias("yy"), (s["xy"] + dx * dy).alias("xy"),
                        s["ma"].alias("ma"), s["mb"].alias("mb"))

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def done(s):
        n = F.size(a)
        ok = (F.sqrt(s["xx"] / n) >= 1e-12) & (F.sqrt(s["yy"] / n) >= 1e-12)
        return F.when(ok, s["xy"] / F.sqrt(s["xx"] * s["yy"]))

    return F.aggregate(pairs, zero, step, done)


def autocorrelation(arr: Column, lag: int) -> Column:
    n = F.size(arr)
    head = F.slice(arr, 1, F.greatest(n - lag, F.lit(0)))
    tail = F.slice(arr, lag + 1, F.greatest(n - lag, F.lit(0)))
    return F.when(n > lag, pearson(head, tail))


def lag_samples(seconds: float, hz: float) -> int:
    return max(int(round(seconds * hz)), 1)


def robust_z(df: DataFrame, column: str, out: str = "__z") -> DataFrame:
    """Add median, MAD and the robust z array of a signal (std, then 1, where the MAD vanishes)."""
    x = F.col(column)
    step1 = df.withColumn("__sorted", F.sort_array(x))
    step2 = step1.withColumns({"median": sorted_quantile(F.col("__sorted"), 0.5), "__mean": mean(x)})
    step3 = step2.withColumns(
        {
            "__dev": F.sort_array(F.transform(x, lambda v: F.abs(v - F.col("median")))),
            "__std": pop_std(x, F.col("__mean")),
        }
    ).withColumn("mad", sorted_quantile(F.col("__dev"), 0.5))
    scale = F.when(F.col("mad") * 1.4826 >= 1e-9, F.col("mad") * 1.4826).when(F.col("__std") >= 1e-9, F.col("__std")).otherwise(1.0)
    step4 = step3.withColumn("__scale", scale)
    return step4.withColumn(out, F.transform(x, lambda v: (v - F.col("median")) / F.col("__scale")))


def shape_features(df: DataFrame, column: str, hz: float) -> DataFrame:
    """Append the distribution, trend, change and memory features of a signal of at least 8 samples."""
    z = F.col("__z")
    n = F.size(z)
    staged = robust_z(df.where(F.size(column) >= 8), column).withColumns(
        {"__d": diffs(z), "__zmean": mean(z), "__above": F.transform(z, lambda v: v > 0), "__n": n})
    staged = staged.withColumns({"__dd": diffs(F.col("__d")), "__dmean": mean(F.col("__d"))})
    moments = F.aggregate(
        z, F.struct(*[F.lit(0.0).alias(c) for c in ("m2", "m3", "m4", "sq")]),
        lambda s, v: F.struct(
            *[(s[f"m{k}"] + F.pow(v - F.col("__zmean"), F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)], (s["sq"] + v * v).alias("sq")))
    staged = staged.withColumn("__m", moments)
    nn = F.col("__n").cast("double")
    m2, m3, m4 = (F.col(f"__m.m{k}") / nn for k in (2, 3, 4))
    varied = m2 > 1e-300
    half = F.greatest(F.floor(F.col("__n") / 2).cast("int"), F.lit(1))
    d, dd, above = F.col("__d"), F.col("__dd"), F.col("__above")
    flips = F.zip_with(F.slice(above, 2, F.col("__n") - 1), F.slice(above, 1, F.col("__n") - 1), lambda b, a: (b != a).cast("int"))
    s = F.col("__sorted")
    last = F.greatest(F.col("__n") - 1, F.lit(1))
    features = {
        "q10": sorted_quantile(s, 0.10), "q25": sorted_quantile(s, 0.25), "q75": sorted_quantile(s, 0.75), "q90": sorted_quantile(s, 0.90),
        "iqr": sorted_quantile(s, 0.75) - sorted_quantile(s, 0.25),
        # Bias-corrected moments.
        "skew": F.when(varied & (nn > 2), F.sqrt(nn * (nn - 1)) / (nn - 2) * m3 / F.pow(m2, F.lit(1.5))),
        "kurtosis": F.when(varied & (nn > 3), (nn - 1) / ((nn - 2) * (nn - 3)) * ((nn + 1) * (m4 / (m2 * m2) - 3.0) + 6.0)),
        "rms_z": F.sqrt(F.col("__m.sq") / nn),
        "late_minus_early_z": mean(F.slice(z, half + 1, F.col("__n") - half)) - mean(F.slice(z, F.lit(1), half)),
        "last_minus_first_z": F.get(z, F.col("__n") - 1) - F.get(z, 0),
        "max_time_fraction": (F.array_position(z, F.array_max(z)) - 1) / last,
        "min_time_fraction": (F.array_position(z, F.array_min(z)) - 1) / last,
        "mean_abs_diff_z": mean(F.transform(d, lambda v: F.abs(v))),
        "std_diff_z": pop_std(d, F.col("__dmean")),
        "max_abs_diff_z": F.array_max(F.transform(d, lambda v: F.abs(v))),
        "second_diff_energy": mean(F.transform(dd, lambda v: v * v)),
        "median_crossings": F.aggregate(flips, F.lit(0), lambda a, v: a + v).cast("double"),
        "longest_above_median_frac": longest_run(above) / F.col("__n"),
        "longest_below_median_frac": longest_run(F.transform(above, lambda v: ~v)) / F.col("__n"),
    }
    for name, seconds in (("025s", 0.25), ("05s", 0.5), ("1s", 1.0), ("2s", 2.0)):
        features[f"autocorr_{name}"] = autocorrelation(z, lag_samples(seconds, hz))
    out = staged.withColumns(features)
    return out.drop(*[c for c in out.columns if c.startswith("__") and c != "__z"])


def seeded_shuffle(arr: Column, *seed: Column) -> Column:
    """Permute a signal by a hash of (seed, position): reproducible on any partitioning."""
    keyed = F.transform(arr, lambda v, i: F.struct(F.xxhash64(*seed, i).alias("h"), i.alias("i"), v.alias("v")))
    return F.transform(F.sort_array(keyed), lambda s: s["v"])


def rmssd(arr: Column) -> Column:
    return F.sqrt(mean(F.transform(diffs(arr), lambda d: d * d)))


def jerk(arr: Column, hz: float) -> tuple[Column, Column]:
    """Mean absolute and root mean square rate of change per second."""
    rate = F.transform(diffs(arr), lambda d: d * F.lit(float(hz)))
    return mean(F.transform(rate, lambda r: F.abs(r))), F.sqrt(mean(F.transform(rate, lambda r: r * r)))


def largest_mean_shift(arr: Column) -> Column:
    """Largest absolute difference between the means before and after a split point."""
    n = F.size(arr)
    total = _sum(arr)
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("i"), F.lit(0.0).alias("best"))

    def step(s, v):
        run, i = s["run"] + v, s["i"] + 1
        gap = F.when(i < n, F.abs((total - run) / (n - i) - run / i)).otherwise(F.lit(0.0))
        return F.struct(run.alias("run"), i.alias("i"), F.greatest(s["best"], gap).alias("best"))

    return F.aggregate(arr, zero, step)["best"]
