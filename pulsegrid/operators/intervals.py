"""Interval algebra: unions, set operations and coverage of interval records, without a row per unit of time.

Every record is two changes of a counter, +1 at its start and -1 behind its end. Running sums of the changes say what
is covered between two of them, so all results are maximal pieces whose number is bounded by that of the records, however
long these are. A long key is split into time buckets: a bucket starts from the sum of all buckets before it, which
comes from a summary of one row per bucket that has records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.scale import null_safe_join

MINUTE_US = 60_000_000


def _steps(records: DataFrame, keys: Sequence[str], start: str, end: str, flags: dict[str, Column]) -> DataFrame:
    """Two rows per record that lasts: keys, ``at`` and by how much each flag's counter (``__d_``) changes there."""
    on = [F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"__f_{n}") for n, c in flags.items()]
    lasting = records.where(F.col(start) < F.col(end)).select(*keys, F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e"), *on)
    two = F.explode_outer(F.array(F.struct(F.col("__s").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("__e").alias("at"), F.lit(-1).alias("sign"))))
    return lasting.withColumn("__x", two).select(*keys, F.col("__x.at").alias("at"), *[(F.col(f"__f_{n}") * F.col("__x.sign")).alias(f"__d_{n}") for n in flags])


def _counters(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Adds ``__n_``: each counter after the row. ``rows`` have a time bucket ``__b``; its start comes from a row per bucket."""
    cell = [*keys, "__b"]
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*cell).agg(*[F.sum(f"__d_{n}").alias(f"__t_{n}") for n in flags]).select(*cell, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in flags])
    upto = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return null_safe_join(rows, carry, cell).withColumns({f"__n_{n}": F.col(f"__c_{n}") + F.sum(f"__d_{n}").over(upto) for n in flags})


def coverage_changes(records: DataFrame, keys: Sequence[str], start: str, end: str, flags: dict[str, Column], bucket: int) -> DataFrame:
    """Times at which the coverage of a key changes: keys, ``at``, the time of the next change ``until`` (null: none), and the state from ``at`` on.

    ``start`` and ``end`` are whole numbers, the end being the first unit that is not covered any more; records that do not last are left out.
    Each of ``flags`` is true while a record with its condition covers the time.
    """
    cell = [*keys, "__b"]
    net = _steps(records, keys, start, end, flags).groupBy(*keys, "at").agg(*[F.sum(f"__d_{n}").alias(f"__d_{n}") for n in flags]).withColumn("__b", F.floor(F.col("at") / F.lit(bucket)))
    run = _counters(net, keys, ["at"], flags)
    changed = F.lit(False)
    for n in flags:
        changed = changed | ((F.col(f"__n_{n}") > 0) != (F.col(f"__n_{n}") - F.col(f"__d_{n}") > 0))
    changes = run.where(changed).select(*cell, "at", *[(F.col(f"__n_{n}") > 0).alias(n) for n in flags])
    edges = changes.groupBy(*cell).agg(F.min("at").alias("__first")).select(*cell, F.lead("__first").over(Window.partitionBy(*keys).orderBy("__b")).alias("__next"))
    joined = null_safe_join(changes, edges, cell)
    return joined.select(*keys, "at", F.coalesce(F.lead("at").over(Window.partitionBy(*cell).orderBy("at")), F.col("__next")).alias("until"), *flags)


def covered_at(points: DataFrame, keys: Sequence[str], at: Column, records: DataFrame, start: str, end: str, flags: dict[str, Column], bucket: int) -> DataFrame:
    """``points`` with each of ``flags``: does a record with its condition cover ``at`` (whole numbers; null: no)?

    Points run along in the sweep as changes of 0, so they need no join with the records.
    """
    none = F.lit(None).cast(points.select(F.struct(*points.columns).alias("r")).schema["r"].dataType)
    steps = _steps(records, keys, start, end, flags).withColumns({"__row": none, "__side": F.lit(0)})
    own = points.select(*keys, at.cast("long").alias("at"), *[F.lit(0).cast("long").alias(f"__d_{n}") for n in flags], F.struct(*points.columns).alias("__row"), F.lit(1).alias("__side"))
    both = steps.unionByName(own).withColumn("__b", F.floor(F.col("at") / F.lit(bucket)))
    found = _counters(both, keys, ["at", "__side"], flags).where("__side = 1")
    return found.select("__row.*", *[F.coalesce(F.col("at").isNotNull() & (F.col(f"__n_{n}") > 0), F.lit(False)).alias(n) for n in flags])


def pieces(records: DataFrame, keys: Sequence[str], start: str, end: str, flags: dict[str, Column], bucket: int) -> DataFrame:
    """Maximal pieces in which at least one flag holds: keys, ``at``, ``until`` (exclusive) and the flags."""
    covered = F.lit(False)
    for n in flags:
        covered = covered | F.col(n)
    return coverage_changes(records, keys, start, end, flags, bucket).where(covered)


def merged(records: DataFrame, keys: Sequence[str], start: str, end: str, bucket: int) -> DataFrame:
    """Union of the records of each key as disjoint pieces ``[at, until)``; records that touch become one."""
    return pieces(records, keys, start, end, {"__any": F.lit(True)}, bucket).drop("__any")


def set_sizes(records: DataFrame, keys: Sequence[str], start: str, end: str, a: Column, b: Column, bucket: int, name: str = "units") -> DataFrame:
    """Length of the union, the intersection and the difference (``a`` without ``b``) of two sets of records: op, ``name``."""
    found = pieces(records.where(a | b), keys, start, end, {"__a": a, "__b_set": b}, bucket)
    length = F.col("until") - F.col("at")
    held = {"union": F.lit(True), "intersect": F.col("__a") & F.col("__b_set"), "except": F.col("__a") & ~F.col("__b_set")}
    sums = found.agg(*[F.coalesce(F.sum(F.when(c, length)), F.lit(0)).alias(op) for op, c in held.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(op).alias(name)) for op in held])).alias("x")).select("x.*")


def in_minutes(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Adds ``__from`` and ``__to``: the minutes that an interval of times touches, the one that holds its end rounded up included."""
    minute = lambda us: F.floor(us / F.lit(MINUTE_US))
    known = intervals.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start)))
    return known.withColumns({"__from": minute(F.unix_micros(start)), "__to": minute(F.unix_micros(end) + F.lit(MINUTE_US - 1)) + 1})
