"""Temporal-shape features of windows: resample, describe, couple, and control for order.

Signals are handled in long form, one row per (window, sensor, variant), so the plan stays the same size
whatever the number of sensors; the variants are the true order, a seeded shuffle and the reversal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import arrays as AR
from pulsegrid.functions import kernels as KE
from pulsegrid.functions import sweep
from pulsegrid.operators.windows import finite, whole_cells
from pulsegrid.schema import COUPLING_PAIRS, SHAPE_SENSORS

VARIANTS = ("shape", "shuffle", "reverse")


def recent_targets(samples: DataFrame, keys: Sequence[str], target: str, recent_s: float = 1.0) -> DataFrame:
    """Target at the anchor: from the last second when labelled there, else from the whole window.

    Gives the median and the last value; anchors whose window has no label are dropped.
    """
    near = f"sample_offset_s > window_end_s - {recent_s}D AND `{target}` IS NOT NULL"
    pos = "struct(sample_offset_s, sample_index)"
    out = samples.groupBy(*keys).agg(
        F.count(target).alias("__n"),
        F.coalesce(F.expr(f"percentile(`{target}`, 0.5D) FILTER (WHERE {near})"), F.percentile(target, 0.5)).alias("target_median"),
        F.coalesce(F.expr(f"max_by(`{target}`, {pos}) FILTER (WHERE {near})"),
                   F.expr(f"max_by(`{target}`, {pos}) FILTER (WHERE `{target}` IS NOT NULL)")).alias("target_last"))
    return out.where(F.col("__n") > 0).drop("__n")


def describe_signals(signals: DataFrame, column: str, hz: float) -> DataFrame:
    """All single-signal features of an array column (spectral and wavelet ones on the robust z)."""
    packed = signals.where(F.size(column) >= 8).withColumn("__shape", KE.signal_features(hz)(column))
    return packed.select("*", "__shape.*").drop("__shape")


def with_variants(signals: DataFrame, column: str, seed: int, keys: Sequence[str]) -> DataFrame:
    """Each signal three times: true order, seeded shuffle, reversed."""
    x = F.col(column)
    shuffled = AR.seeded_shuffle(x, F.lit(seed), *[F.col(k) for k in keys])
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), e.alias("signal")) for n, e in
                         (("shape", x), ("shuffle", shuffled), ("reverse", F.reverse(x)))])
    keep = [c for c in signals.columns if c != column]
    return signals.select(*keep, F.explode_outer(variants).alias("__v")).select(*keep, "__v.variant", F.col("__v.signal").alias(column))


#: Windows in a time block of samples and anchors.
BLOCK_WINDOWS = 8
#: Windows whose rows of the shape table are held at once: a row has a thousand columns and more.
TABLE_WINDOWS = 1_000


class _Windows(NamedTuple):
    """The windows of a part that have a sample: their anchors' rows, their end, their first and end position among the samples, and the
    first window of each cell; then the samples' rows and times, and the first sample of each cell."""

    anchors: pa.Table
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    of_cell: np.ndarray
    sample: np.ndarray
    t: np.ndarray
    first_sample: np.ndarray


@dataclass(frozen=True)
class _Signals:
    """Arrow kernel: samples (side 0) and anchors (side 1) of a block in time order, to one row per anchor and sensor."""

    sensors: tuple[str, ...]
    window_seconds: float
    hz: float
    fields: T.StructType

    #: Rows of whole blocks that are taken at once.
    ROWS = 30_000

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cells in whole_cells(batches, ("__hash", "__b"), self.ROWS):
            windows = self._windows(table, cells)
            if len(windows.end):
                yield from self._rows(table, windows)

    def _windows(self, table: pa.Table, cells: np.ndarray) -> _Windows:
        side, time = table.column("__side").to_numpy(), table.column("__t").to_numpy()
        sample, anchor = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        t, end = time[sample], time[anchor]
        bounds = np.append(cells, table.num_rows)
        first_sample, first_anchor = np.searchsorted(sample, bounds), np.searchsorted(anchor, bounds)
        lo, hi = self._between(t, end - self.window_seconds, end, first_sample, first_anchor)
        full = np.flatnonzero(hi > lo)
        return _Windows(table.take(pa.array(anchor[full])), end[full], lo[full], hi[full], np.searchsorted(full, first_anchor), sample, t, first_sample)

    def _summary(self, table: pa.Table, w: _Windows, sensor: str) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
        """(quality and base values of each window; the sensor's values, their times, the first of each cell, each window's first and end)."""
        column = table.column(sensor).take(pa.array(w.sample)).combine_chunks()
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        v, own = column.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.float64), w.t[at]
        a, b = np.searchsorted(at, w.lo), np.searchsorted(at, w.hi)
        m = sweep.moments(v, own, a, b)
        some = m["n"] > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            std = np.sqrt(m["m2"] / m["n"])
        values = {
            "valid_count": m["n"], "valid_frac": m["n"] / (w.hi - w.lo), "mean": np.where(some, m["mean"], np.nan), "std": std,
            "min": np.where(some, m["min"], np.nan), "max": np.where(some, m["max"], np.nan), "last": np.where(some, np.append(v, np.nan)[b - 1], np.nan),
        }
        return values, (v, own, np.searchsorted(at, w.first_sample), a, b)

    def _rows(self, table: pa.Table, w: _Windows) -> Iterator[pa.RecordBatch]:
        for sensor in self.sensors:
            summary, signal = self._summary(table, w, sensor)
            points, good = self._grids(*signal, w.end, w.of_cell)
            offsets = np.concatenate(([0], np.cumsum(np.where(good, points.shape[1], 0)))).astype(np.int32)
            grid = pa.ListArray.from_arrays(offsets, pa.array(points[good].ravel()), mask=pa.array(~good))
            values = {"sensor": pa.array([sensor] * len(w.end), pa.string()), "source_rows": w.hi - w.lo, **summary, "grid": grid}
            yield from self._table(w.anchors, values).to_batches(20_000)

    def _table(self, anchors: pa.Table, values: dict) -> pa.Table:
        """The rows' table by its fields: ``values``, and the rest from the anchors."""
        columns = [anchors.column("__t" if f.name == "window_end_s" else f.name) if f.name not in values else values[f.name] if isinstance(values[f.name], pa.Array) else pa.array(values[f.name], from_pandas=True) for f in self.fields]
        return pa.Table.from_arrays(columns, [f.name for f in self.fields]).combine_chunks()

    @staticmethod
    def _between(t: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the samples in (start, end] of each window, block by block."""
        lo, hi = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        for i, (a, b) in enumerate(zip(windows[:-1].tolist(), windows[1:].tolist(), strict=True)):
            if a < b:
                own = t[first[i] : first[i + 1]]
                lo[a:b], hi[a:b] = first[i] + np.searchsorted(own, start[a:b], side="right"), first[i] + np.searchsorted(own, end[a:b], side="right")
        return lo, hi

    def _grids(self, v: np.ndarray, t: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Straight lines between the samples at start, start + 1/hz, ..., end, with held edges; of samples at one time the first counts.

        Also whether a window has one: it needs 4 samples at 4 different times that span a second, and 8 grid points.
        """
        points = grid_points(self.window_seconds, self.hz)
        out, good = np.zeros((len(end), points)), np.zeros(len(end), bool)
        for i, (w, x) in enumerate(zip(windows[:-1].tolist(), windows[1:].tolist(), strict=True)):
            own = slice(int(first[i]), int(first[i + 1]))
            if w == x or own.stop - own.start < 4 or points < 8:
                continue
            times, at = np.unique(t[own], return_index=True)
            values = v[own][at]
            lo, hi = np.searchsorted(at, a[w:x] - own.start), np.searchsorted(at, b[w:x] - own.start)
            fit = np.flatnonzero((hi - lo >= 4) & (times[np.minimum(hi - 1, len(times) - 1)] - times[np.minimum(lo, len(times) - 1)] >= 1.0))
            if not len(fit):
                continue
            lo, hi = lo[fit, None], hi[fit, None]
            ticks = np.clip((end[w:x][fit] - self.window_seconds)[:, None] + np.arange(points) / self.hz, times[lo], times[hi - 1])
            j = np.clip(np.searchsorted(times, ticks, side="right") - 1, lo, hi - 2)
            out[w + fit] = values[j] + (values[j + 1] - values[j]) * ((ticks - times[j]) / (times[j + 1] - times[j]))
            good[w + fit] = True
        return out, good


@dataclass(frozen=True)
class _Assembled(_Signals):
    """Arrow kernel: the same blocks, to one row per anchor with every feature of every sensor and pair in a column of its own."""

    windows: int
    digits: int | None

    ROWS = 10_000

    def _rows(self, table: pa.Table, w: _Windows) -> Iterator[pa.RecordBatch]:
        summaries = [self._summary(table, w, sensor) for sensor in self.sensors]
        for begin in range(0, len(w.end), self.windows):
            part = slice(begin, min(begin + self.windows, len(w.end)))
            rows, bounds = part.stop - part.start, np.clip(w.of_cell, part.start, part.stop) - part.start
            anchors = w.anchors.slice(begin, rows)
            draws = pc.list_flatten(pc.list_flatten(anchors.column("__draws"))).to_numpy().reshape(rows, len(self.sensors), -1)
            values, grids = {"window_end_s": w.end[part], "source_rows": (w.hi - w.lo)[part]}, {}
            for i, (sensor, (summary, (v, own, first, a, b))) in enumerate(zip(self.sensors, summaries, strict=True)):
                for group, names in (("quality", QUALITY), ("base", BASE)):
                    values |= {f"{sensor}__{group}__{n}": summary[n][part].astype(np.float64) for n in names}
                grid, good = grids[sensor] = self._grids(v, own, first, a[part], b[part], w.end[part], bounds)
                at = np.flatnonzero(good)
                shuffled = np.take_along_axis(grid[at], np.argsort(draws[at, i], axis=1, kind="stable"), axis=1)
                for variant, signal in zip(VARIANTS, (grid[at], shuffled, grid[at, ::-1]), strict=True):
                    found = KE.described(signal, self.hz) if len(at) else {}
                    values |= {f"{sensor}__{variant}__{n}": self._placed(found.get(n), at, rows) for n in KE.SIGNAL_FIELDS}
            for left, right in _coupled_pairs(self.sensors):
                at = np.flatnonzero(grids[left][1] & grids[right][1])
                found = KE.coupled(grids[left][0][at], grids[right][0][at], self.hz)
                values |= {f"{left}_x_{right}__coupling__{n}": self._placed(x, at, rows) for n, x in zip(KE.COUPLING_FIELDS, found.T, strict=True)}
            if self.digits is not None:
                values |= {n: np.round(x, self.digits) + 0.0 for n, x in values.items() if x.dtype == np.float64}
            yield from self._table(anchors, values).to_batches()

    @staticmethod
    def _placed(found: np.ndarray | None, at: np.ndarray, rows: int) -> np.ndarray:
        """``found`` at the windows it belongs to, NaN elsewhere."""
        out = np.full(rows, np.nan)
        if found is not None:
            out[at] = found
        return out


def grid_points(window_seconds: float, hz: float) -> int:
    return len(np.arange(0.0, window_seconds + 0.5 / hz, 1.0 / hz))


def _coupled_pairs(sensors: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for a, b in COUPLING_PAIRS if a in sensors and b in sensors]


def with_magnitude(stream: DataFrame, sensors: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Stream and sensors with the magnitude of acceleration, where the sensors have all three axes."""
    if not {"acc_x", "acc_y", "acc_z"} <= set(sensors) or "acc_mag" in sensors:
        return stream, list(sensors)
    if "acc_mag" not in stream.columns:
        x, y, z = (finite(c) for c in ("acc_x", "acc_y", "acc_z"))
        stream = stream.withColumn("acc_mag", F.sqrt(x * x + y * y + z * z))
    return stream, [*sensors, "acc_mag"]


def _dealt(anchors: DataFrame, stream: DataFrame, keys: Sequence[str], sensors: Sequence[str], window_seconds: float, anchor_id: str) -> DataFrame:
    """Samples (side 0; NaN and infinities are missing) and anchors (side 1) of the time blocks they meet in, in time order."""
    size = F.lit(float(window_seconds) * BLOCK_WINDOWS)
    block = lambda x: F.floor(x / size).cast("long")
    t = finite("sample_offset_s")
    reach = F.explode_outer(F.sequence(block(t), block(t + F.lit(float(window_seconds)))))
    samples = stream.where(t.isNotNull()).select(*keys, reach.alias("__b"), t.alias("__t"), F.lit(0).alias("__side"), F.col("sample_index").cast("long").alias("__s"), *[finite(s).alias(s) for s in sensors])
    ends = finite("window_end_s")
    marks = anchors.where(ends.isNotNull()).select(*keys, block(ends).alias("__b"), ends.alias("__t"), F.lit(1).alias("__side"), anchor_id)
    both = samples.unionByName(marks, allowMissingColumns=True)
    dealt = both.repartition(*keys, "__b").sortWithinPartitions(*keys, "__b", "__t", "__side", "__s")
    return dealt.withColumn("__hash", F.xxhash64(F.struct(*keys)))


def window_signals(
    anchors: DataFrame, stream: DataFrame, keys: Sequence[str], sensors: Sequence[str], window_seconds: float, hz: float, anchor_id: str,
) -> DataFrame:
    """One row per (anchor, sensor) whose window has a sample: counts, summary of the raw values, and the resampled grid.

    Samples and anchors meet once, in time blocks of BLOCK_WINDOWS windows with a halo of one; samples are not copied per
    anchor, and all sensors come from the same pass.
    """
    flat = _dealt(anchors, stream, keys, sensors, window_seconds, anchor_id)
    double, long = T.DoubleType(), T.LongType()
    fields = [T.StructField(c, flat.schema[c].dataType) for c in [*keys, anchor_id]] + [T.StructField("window_end_s", double), T.StructField("sensor", T.StringType())]
    fields += [T.StructField(c, long if c in ("source_rows", "valid_count") else double) for c in ("source_rows", "valid_count", "mean", "std", "min", "max", "valid_frac", "last")]
    schema = T.StructType([*fields, T.StructField("grid", T.ArrayType(double))])
    return flat.mapInArrow(_Signals(tuple(sensors), float(window_seconds), float(hz), schema), schema)


QUALITY, BASE = ("valid_count", "valid_frac"), ("mean", "std", "min", "max", "last")


def shape_table(
    anchors: DataFrame, stream: DataFrame, keys: Sequence[str], sensors: Sequence[str], window_seconds: float, hz: float, anchor_id: str,
    seed: int = 20260609, digits: int | None = None,
) -> DataFrame:
    """One row per anchor whose window has a sample, with all of ``feature_names`` as columns: what ``shape_wide`` makes of ``shape_long``.

    The kernel that lays the signals out describes them too: nothing is exchanged but samples and anchors, and no feature gets a row.
    With ``digits`` it rounds them and the window's end as well, which as a thousand column expressions would take longer than the features.
    """
    stream, sensors = with_magnitude(stream, sensors)
    flat = _dealt(anchors, stream, keys, sensors, window_seconds, anchor_id)
    # The order of a shuffle hangs on the window, the sensor and the place, not on values: hashes as in ``seeded_shuffle``.
    places = F.sequence(F.lit(0), F.lit(grid_points(window_seconds, hz) - 1))
    draw = lambda sensor: F.transform(places, lambda i: F.xxhash64(F.lit(seed), *keys, anchor_id, F.lit(sensor), i))
    flat = flat.withColumn("__draws", F.when(F.col("__side") == 1, F.array(*[draw(s) for s in sensors])))
    names = feature_names(sensors)
    fields = [T.StructField(c, flat.schema[c].dataType) for c in [*keys, anchor_id]] + [T.StructField("window_end_s", T.DoubleType()), T.StructField("source_rows", T.LongType())]
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return flat.mapInArrow(_Assembled(tuple(sensors), float(window_seconds), float(hz), schema, TABLE_WINDOWS, digits), schema)


def _described(signals: DataFrame, ids: Sequence[str], hz: float, seed: int) -> tuple[DataFrame, list[str]]:
    """(one row per gridded signal and variant, names of its features)."""
    gridded = signals.where("grid IS NOT NULL").select(*ids, "sensor", "grid")
    described = describe_signals(with_variants(gridded, "grid", seed, [*ids, "sensor"]), "grid", hz)
    return described, [c for c in described.columns if c not in {*ids, "sensor", "variant", "grid"}]


def shape_long(
    anchors: DataFrame, stream: DataFrame, keys: Sequence[str], sensors: Sequence[str], window_seconds: float, hz: float, anchor_id: str,
    seed: int = 20260609,
) -> DataFrame:
    """Features in long form: (anchor, feature, value), with sensor__group__name feature names."""
    stream, sensors = with_magnitude(stream, sensors)
    signals = window_signals(anchors, stream, keys, sensors, window_seconds, hz, anchor_id)
    ids = [*keys, anchor_id]

    def melt(df: DataFrame, group, names: Sequence[str]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).cast("double").alias("v")) for n in names])
        flat = df.select(*ids, "sensor", group.alias("g"), F.explode_outer(items).alias("i"))
        return flat.select(*ids, F.concat_ws("__", "sensor", "g", "i.n").alias("feature"), F.col("i.v").alias("value"))

    quality = melt(signals, F.lit("quality"), QUALITY)
    base = melt(signals.where("valid_count > 0"), F.lit("base"), BASE)
    described, names = _described(signals, ids, hz, seed)
    shape = melt(described, F.col("variant"), names)
    coupling = coupling_long(signals.where("grid IS NOT NULL").select(*ids, "sensor", "grid"), ids, hz)
    return quality.unionByName(base).unionByName(shape).unionByName(coupling).where("value IS NOT NULL")


def shape_summary(
    anchors: DataFrame, stream: DataFrame, keys: Sequence[str], sensors: Sequence[str], window_seconds: float, hz: float, anchor_id: str,
    seed: int = 20260609,
) -> DataFrame:
    """Windows and mean of every feature of ``shape_long``, without a row per feature and window: columns are summed up per sensor and
    variant, and only those sums get names."""
    stream, sensors = with_magnitude(stream, sensors)
    signals = window_signals(anchors, stream, keys, sensors, window_seconds, hz, anchor_id)
    ids = [*keys, anchor_id]

    def summed(df: DataFrame, groups: Sequence, named: dict[str, Sequence]) -> DataFrame:
        """``named``: column to the parts of its feature's name."""
        sums = [x for c in named for x in (F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"s_{c}"))]
        items = F.array(*[F.struct(F.concat_ws("__", *parts).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("s")) for c, parts in named.items()])
        return df.groupBy(*groups).agg(*sums).select(F.explode_outer(items).alias("i")).select("i.*").where("n > 0")

    sensor = F.col("sensor")
    plain = {c: (sensor, F.lit(g), F.lit(c)) for g, names in (("quality", QUALITY), ("base", BASE)) for c in names}
    described, names = _described(signals, ids, hz, seed)
    shape = summed(described, ["sensor", "variant"], {c: (sensor, F.col("variant"), F.lit(c)) for c in names})
    coupled = _coupled(signals.where("grid IS NOT NULL").select(*ids, "sensor", "grid"), ids, hz).select("pair", "c.*")
    coupling = summed(coupled, ["pair"], {c: (F.col("pair"), F.lit("coupling"), F.lit(c)) for c in KE.COUPLING_FIELDS})
    found = summed(signals, ["sensor"], plain).unionByName(shape).unionByName(coupling)
    return found.select("feature", F.col("n").alias("windows"), (F.col("s") / F.col("n")).alias("mean_value"))


def _coupled(gridded: DataFrame, ids: Sequence[str], hz: float) -> DataFrame:
    """(ids, pair, struct of its coupling) of the fixed sensor pairs; sensors of a window meet on the window key."""
    coupled = {s for pair in COUPLING_PAIRS for s in pair}
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in COUPLING_PAIRS])
    by_window = gridded.where(F.col("sensor").isin(*coupled)).groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("sensor", "grid"))).alias("m"))
    paired = by_window.where(F.size("m") > 1).select(*ids, "m", F.explode_outer(pairs).alias("p")).select(
        *ids, F.concat_ws("_x_", "p.a", "p.b").alias("pair"), F.try_element_at("m", F.col("p.a")).alias("x"),
        F.try_element_at("m", F.col("p.b")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return paired.withColumn("c", KE.coupling_features(hz)("x", "y"))


def coupling_long(gridded: DataFrame, ids: Sequence[str], hz: float) -> DataFrame:
    """Cross-sensor coupling of the fixed sensor pairs, in long form."""
    items = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"c.{n}").alias("v")) for n in KE.COUPLING_FIELDS])
    return _coupled(gridded, ids, hz).select(*ids, "pair", F.explode_outer(items).alias("i")).select(
        *ids, F.concat_ws("__", "pair", F.lit("coupling"), "i.n").alias("feature"), F.col("i.v").alias("value"))


def feature_names(sensors: Sequence[str] = (*SHAPE_SENSORS, "acc_mag")) -> list[str]:
    """Every column the wide table can have for these sensors."""
    out = [f"{s}__quality__{q}" for s in sensors for q in QUALITY]
    out += [f"{s}__base__{b}" for s in sensors for b in BASE]
    out += [f"{s}__{g}__{n}" for s in sensors for g in VARIANTS for n in KE.SIGNAL_FIELDS]
    out += [f"{a}_x_{b}__coupling__{n}" for a, b in _coupled_pairs(sensors) for n in KE.COUPLING_FIELDS]
    return out


def shape_wide(long: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long features to one wide row per anchor (the column list is known, so no pivot discovery job)."""
    return long.groupBy(*ids).pivot("feature", list(names)).agg(F.first("value"))
