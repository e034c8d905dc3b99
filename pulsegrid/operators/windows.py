"""Causal trailing windows on a regular tick grid.

Layout of the job: session bounds (one partial-aggregated pass) are cut into time blocks; every
sample goes to the block of its own time and, near a block end, also to the following blocks its
windows reach into (a halo of the longest window). Samples and bounds meet on (session, block), and
everything after that exchange is a sweep over the block's samples in time order. A block holds a fixed span of
one session, so a long session is spread over many tasks and shuffle volume grows by
halo/block only. The sweep works on mergeable pane states (`pulsegrid.functions.sweep`): no sample is copied per
window, least and greatest values are not searched again, and windows of any number of lengths come from one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import sweep
from pulsegrid.schema import CONTEXT_COLUMNS, CONTEXT_NUMERIC, CONTEXT_TEXT, SENSOR_BLOCKS, SUMMARY_STATS, WINDOW_PREFERRED_ORDER

TIME = "sample_offset_s"
LABEL_COLUMNS = ("target_available", "target_pain_coverage", "target_pain_nrs_0_10", "target_pain_min", "target_pain_max", "target_pain_count")


@dataclass(frozen=True)
class WindowSpec:
    """Tick rate, trailing length and admission rules for one window table."""

    target_hz: float = 1.0
    window_seconds: float = 30.0
    include_partial_windows: bool = False
    min_window_rows: int = 2
    max_gap_seconds: float | None = 2.0
    blocks_of_windows: int = 8

    @property
    def step_seconds(self) -> float:
        return 1.0 / self.target_hz

    @property
    def block_seconds(self) -> float:
        return self.window_seconds * self.blocks_of_windows

    def check(self) -> "WindowSpec":
        if not 1.0 <= self.target_hz <= 10.0:
            raise ValueError("target_hz must lie in [1, 10]")
        if self.window_seconds <= 0:
            raise ValueError("window_seconds must be > 0")
        if self.min_window_rows < 1:
            raise ValueError("min_window_rows must be >= 1")
        if self.max_gap_seconds is not None and self.max_gap_seconds <= 0:
            raise ValueError("max_gap_seconds must be > 0 or None")
        return self


def session_bounds(stream: DataFrame, spec: WindowSpec, keys: Sequence[str]) -> DataFrame:
    """Per session: first/last time, first anchor and number of anchors (sessions with none are dropped)."""
    first = F.col("t_min") if spec.include_partial_windows else F.col("t_min") + F.lit(spec.window_seconds)
    return (
        stream.where(F.col(TIME).isNotNull())
        .groupBy(*keys)
        .agg(F.min(TIME).alias("t_min"), F.max(TIME).alias("t_max"))
        .withColumn("first_anchor", first)
        .where(F.col("first_anchor") <= F.col("t_max"))
        .withColumn(
            "n_anchors",
            (F.floor((F.col("t_max") - F.col("first_anchor")) / F.lit(spec.step_seconds)) + 1).cast("long"),
        )
    )


def anchor_time(spec: WindowSpec) -> Column:
    return F.col("first_anchor") + F.col("k") * F.lit(spec.step_seconds)


def window_anchors(stream: DataFrame, spec: WindowSpec, keys: Sequence[str] = ("dataset_id", "session_id")) -> DataFrame:
    """The anchor grid itself: one row per (session, tick)."""
    bounds = session_bounds(stream, spec.check(), keys)
    grid = bounds.select(*keys, "first_anchor", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("n_anchors") - 1)).alias("k"))
    return grid.select(*keys, "k", anchor_time(spec).alias("window_end_s"))


def _assign_blocks(stream: DataFrame, spec: WindowSpec, keys: Sequence[str], extra: Sequence[str], lengths: Sequence[float]) -> DataFrame:
    """Samples joined with their session bounds on (session, block), halo copies included.

    The cell is one struct column: struct equality keeps NULL session ids.
    """
    longest = max(lengths)
    size = F.lit(longest * spec.blocks_of_windows)
    cell = F.struct(*keys, "block").alias("__cell")
    shortest = WindowSpec(spec.target_hz, min(lengths), spec.include_partial_windows)
    blocks = session_bounds(stream, shortest, keys).withColumn(
        "block",
        F.explode_outer(
            F.sequence(
                F.floor(F.col("first_anchor") / size).cast("long"),
                F.floor((F.col("t_max") + F.lit(spec.step_seconds)) / size).cast("long"),
            )
        ),
    ).select(cell, "t_min", "t_max")
    reach = F.lit(longest + spec.step_seconds)
    samples = stream.where(F.col(TIME).isNotNull()).withColumn(
        "block",
        F.explode_outer(F.sequence(F.floor(F.col(TIME) / size).cast("long"), F.floor((F.col(TIME) + reach) / size).cast("long"))),
    )
    # Dealt before the join: a broadcast or a split skewed join would leave a block's samples in several tasks.
    return samples.select(cell, TIME, *extra).repartition("__cell").join(blocks, "__cell")


def sensor_channels(columns: Sequence[str]) -> dict[str, str]:
    """Channel column -> feature prefix, for the sensors present in ``columns``."""
    out: dict[str, str] = {}
    for block, cols in SENSOR_BLOCKS.items():
        if block == "acc":
            out.update({axis: axis for axis in cols if axis in columns})
            if "acc_mag" in columns:
                out["acc_mag"] = "acc__mag"
        elif cols[0] in columns:
            out[cols[0]] = block
    return out


def whole_cells(batches: Iterator[pa.RecordBatch], marks: Sequence[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole cells, at least ``least`` but at the end; first row of each): cells are runs of rows with equal ``marks``."""

    def firsts(table: pa.Table) -> np.ndarray:
        columns = [table.column(c).to_numpy() for c in marks]
        return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cells = firsts(table)
        cut = int(cells[-1])  # the last cell may go on
        if cut:
            yield table.slice(0, cut), cells[:-1]
        held, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, firsts(table)


@dataclass(frozen=True)
class _Sweep:
    """Arrow kernel of one job: which columns a block has and what its windows give."""

    spec: WindowSpec
    lengths: tuple[float, ...]
    keys: tuple[str, ...]
    context: tuple[str, ...]
    channels: tuple[tuple[str, str], ...]
    label: bool
    fields: T.StructType
    keep_gapped: bool

    #: Rows of whole cells that are held, and windows that are computed, at once: both bound a task's memory.
    ROWS, WINDOWS = 30_000, 20_000

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cells in whole_cells(batches, ("__hash", "block"), self.ROWS):
            for part, own in self._parts(table, cells):
                yield from self._swept(part, own)

    def _parts(self, table: pa.Table, cells: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Runs of cells that have WINDOWS windows or so: few samples can stand for many windows."""
        of_cell = math.ceil(max(self.lengths) * self.spec.blocks_of_windows / self.spec.step_seconds) + 1
        many, bounds = max(1, self.WINDOWS // of_cell), np.append(cells, table.num_rows)
        for i in range(0, len(cells), many):
            own = cells[i : i + many]
            yield table.slice(int(own[0]), int(bounds[i + len(own)] - own[0])), own - own[0]

    def _ticks(self, t: np.ndarray, table: pa.Table, cells: np.ndarray, length: float) -> tuple[np.ndarray, ...]:
        """(first row of the cell, start, end, first and end position) of the windows whose end lies in their cell's block."""
        step, size = self.spec.step_seconds, max(self.lengths) * self.spec.blocks_of_windows
        found = []
        t_min, t_max, block = (table.column(c).to_numpy() for c in ("t_min", "t_max", "block"))
        for begin, stop in zip(cells.tolist(), [*cells[1:].tolist(), len(t)], strict=True):
            first = t_min[begin] if self.spec.include_partial_windows else t_min[begin] + length
            if first > t_max[begin]:
                continue
            last = math.floor((t_max[begin] - first) / step)
            low = max(0, math.ceil((block[begin] * size - first) / step) - 1)
            ends = first + np.arange(low, min(last, math.floor(((block[begin] + 1) * size - first) / step) + 1) + 1) * step
            ends = ends[np.floor(ends / size) == block[begin]]
            starts = np.maximum(t_min[begin], ends - length) if self.spec.include_partial_windows else ends - length
            own = t[begin:stop]
            found.append((np.full(len(ends), begin), starts, ends, begin + np.searchsorted(own, starts, side="right"), begin + np.searchsorted(own, ends, side="right")))
        if not found:
            return tuple(np.zeros(0) for _ in range(3)) + (np.zeros(0, np.int64),) * 2
        return tuple(np.concatenate(f) for f in zip(*found, strict=True))

    def _swept(self, table: pa.Table, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = table.column(TIME).to_numpy()
        for length in self.lengths:
            cell, start, end, lo, hi = self._ticks(t, table, cells, length)
            enough = hi - lo >= self.spec.min_window_rows
            cell, start, end, lo, hi = cell[enough].astype(np.int64), start[enough], end[enough], lo[enough], hi[enough]
            if not len(lo):
                continue
            gap, allowed = self._gaps(t, start, end, lo, hi)
            if not self.keep_gapped:
                good = gap <= allowed
                cell, start, end, lo, hi, gap, allowed = (x[good] for x in (cell, start, end, lo, hi, gap, allowed))
            out = {"window_start_s": start, "window_end_s": end, "source_rows": hi - lo, "window_max_gap_s": gap, "window_allowed_gap_s": allowed, "window_s": np.full(len(lo), length)}
            columns = {k: table.column(k).take(pa.array(cell)) for k in self.keys}
            for c in self.context:
                columns[c] = self._first(table.column(c).combine_chunks(), lo, hi)
            for c, prefix in self.channels:
                out |= self._channel(table.column(c), t, lo, hi, prefix)
            if self.label:
                v, at, a, b = self._valid(table.column("pain_intensity"), lo, hi)
                m = sweep.moments(v, t[at], a, b)
                some = m["n"] > 0
                out |= {"target_pain_count": m["n"], **{name: np.where(some, m[k], np.nan) for name, k in (("target_pain_nrs_0_10", "mean"), ("target_pain_min", "min"), ("target_pain_max", "max"))}}
            columns |= {k: pa.array(v, from_pandas=True) for k, v in out.items() if k in self.fields.names}
            yield from pa.Table.from_arrays([columns[f.name] for f in self.fields], [f.name for f in self.fields]).combine_chunks().to_batches(10_000)

    def _gaps(self, t: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest gap and the one allowed: the limit, or twice the median gap where that is more."""
        limit = math.inf if self.spec.max_gap_seconds is None else float(self.spec.max_gap_seconds)
        step = np.diff(t, prepend=t[:1])
        positive = np.flatnonzero(step > 0)
        a, b = np.searchsorted(positive, lo + 1), np.searchsorted(positive, hi)
        b = np.maximum(a, b)
        inner = sweep.reduced(step[positive], a, b, np.maximum, -np.inf)
        measured = b > a
        edges = np.maximum(np.maximum(t[lo] - start, end - t[hi - 1]), 0.0)
        allowed = np.full(len(lo), limit)
        open_ = np.flatnonzero(measured & (2 * inner > limit))  # elsewhere twice the median is no more than the limit
        allowed[open_] = np.maximum(limit, 2.0 * sweep.medians(step[positive], a[open_], b[open_]))
        return np.where(measured, np.maximum(inner, edges), 0.0), allowed

    @staticmethod
    def _first(column: pa.Array, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """First value of each window."""
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        position = np.append(at, len(column))[np.searchsorted(at, lo)]
        return column.take(pa.array(np.where(position < hi, position, 0), mask=position >= hi))

    @staticmethod
    def _valid(column: pa.ChunkedArray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(values that are there, their rows, the windows' first and end position among them)."""
        column = column.combine_chunks()
        at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        return column.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.float64), at, np.searchsorted(at, lo), np.searchsorted(at, hi)

    def _channel(self, column: pa.ChunkedArray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
        v, at, a, b = self._valid(column, lo, hi)
        m = sweep.moments(v, t[at], a, b)
        n = m["n"]
        some = n > 0
        with np.errstate(invalid="ignore", divide="ignore"):
            std = np.sqrt(m["m2"] / n)
            out = {
                f"{prefix}__valid_count": n, f"{prefix}__mean": np.where(some, m["mean"], np.nan), f"{prefix}__std": std,
                f"{prefix}__min": np.where(some, m["min"], np.nan), f"{prefix}__max": np.where(some, m["max"], np.nan),
                f"{prefix}__last": np.where(some, np.append(v, np.nan)[b - 1], np.nan),
                f"{prefix}__slope_per_s": np.where((n > 1) & (m["t2"] > 0), m["vt"] / m["t2"], np.nan),
            }
            if f"{prefix}__peak_count" in self.fields.names:
                # A peak is above the value before and not below the one after, both in the window.
                peak = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:])) + 1
                first, stop = np.searchsorted(peak, a + 1), np.searchsorted(peak, b - 1)
                out[f"{prefix}__peak_count"] = sweep.count_above(v[peak], first, np.maximum(first, stop), np.where(some, m["mean"] + 0.25 * std, np.inf))
            if prefix in ("ibi", "acc__mag"):
                change = np.diff(v, prepend=v[:1])
                pairs = np.maximum(n - 1, 0)
                inner = np.minimum(a + 1, b)
                per_pair = np.square(change * 1000.0) if prefix == "ibi" else (np.abs(change) < 0.02).astype(np.float64)
                mean = sweep.reduced(per_pair, inner, b, np.add, 0.0) / pairs
                if prefix == "ibi":
                    out |= {"ibi__rmssd_ms": np.sqrt(mean), "ibi__sdnn_ms": np.where(n > 1, 1000.0 * np.sqrt(m["m2"] / (n - 1)), np.nan)}
                else:
                    out["acc__stillness_frac"] = mean
        return out


def _channel_columns(prefix: str) -> dict[str, Column]:
    """Final columns of one channel from those of the sweep."""
    n = F.col(f"{prefix}__valid_count")
    cols = {
        f"{prefix}__present": F.when(n > 0, F.lit(1)).otherwise(F.lit(0)),
        f"{prefix}__valid_count": n,
        f"{prefix}__valid_frac": n / F.col("source_rows"),
        **{f"{prefix}__{s}": F.col(f"{prefix}__{s}") for s in (*SUMMARY_STATS, "peak_count")},
    }
    if prefix == "ibi":
        cols |= {c: F.col(c) for c in ("ibi__rmssd_ms", "ibi__sdnn_ms")}
    if prefix == "acc__mag":
        cols["acc__present"] = cols["acc__mag__present"]
        cols["acc__valid_count"] = n
        cols["acc__valid_frac"] = cols["acc__mag__valid_frac"]
        cols["acc__stillness_frac"] = F.col("acc__stillness_frac")
    return cols


def absent_columns(prefix: str) -> dict[str, Column]:
    """Explicit absence: zero counts and NULL statistics, never fabricated readings."""
    null = F.lit(None).cast("double")
    cols = {
        f"{prefix}__present": F.lit(0),
        f"{prefix}__valid_count": F.lit(0).cast("long"),
        f"{prefix}__valid_frac": F.lit(0.0),
        **{f"{prefix}__{s}": null for s in SUMMARY_STATS},
        f"{prefix}__peak_count": F.lit(0).cast("long"),
    }
    if prefix == "ibi":
        cols |= {"ibi__rmssd_ms": null, "ibi__sdnn_ms": null}
    if prefix == "acc__mag":
        cols |= {
            "acc__present": F.lit(0), "acc__valid_count": F.lit(0).cast("long"), "acc__valid_frac": F.lit(0.0),
            "acc__stillness_frac": null,
        }
    return cols


def all_prefixes() -> list[str]:
    out: list[str] = []
    for block, cols in SENSOR_BLOCKS.items():
        out += [*cols, "acc__mag"] if block == "acc" else [block]
    return out


def finite(name: str) -> Column:
    """NULL for NaN and infinities."""
    x = F.col(name).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def window_features(
    stream: DataFrame,
    spec: WindowSpec,
    keys: Sequence[str] = ("dataset_id", "session_id"),
    all_blocks: bool = True,
    keep_gapped: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The window feature table: one row per admitted (session, tick).

    A window covers ``(end - W, end]``. It needs ``min_window_rows`` rows and must not contain a gap
    wider than max(configured gap, twice its median positive gap), boundaries included. With ``columns`` only
    these are made: the sweep reads no other channel, and a select() behind it could not tell it so.
    """
    return _window_features(stream, spec, (spec.window_seconds,), keys, all_blocks, keep_gapped, columns).drop("window_s")


def _window_features(
    stream: DataFrame, spec: WindowSpec, lengths: Sequence[float], keys: Sequence[str], all_blocks: bool, keep_gapped: bool, columns: Sequence[str] | None
) -> DataFrame:
    """Windows of all ``lengths`` (column window_s), from one exchange of the samples."""

    def asked(names: Iterable[str]) -> list[str]:
        return [n for n in names if columns is None or n in columns]

    for seconds in lengths:
        replace(spec, window_seconds=float(seconds)).check()
    have = set(stream.columns)
    channels = sensor_channels(stream.columns)
    clean = stream.withColumns({c: finite(c) for c in [TIME, *[c for c in channels if c != "acc_mag"]]})
    if {"acc_x", "acc_y", "acc_z"} <= have and "acc_mag" not in have:
        x, y, z = F.col("acc_x"), F.col("acc_y"), F.col("acc_z")
        clean = clean.withColumn("acc_mag", F.sqrt(x * x + y * y + z * z))
        channels["acc_mag"] = "acc__mag"
    elif "acc_mag" in have:
        clean = clean.withColumn("acc_mag", finite("acc_mag"))
    if "pain_intensity" in have:
        clean = clean.withColumn("pain_intensity", finite("pain_intensity"))
    context = asked(c for c in CONTEXT_COLUMNS if c in have and c not in keys)
    identity = asked(c for c in ("dataset_id", "subject_id", "session_id") if c in have and c not in keys)
    seq = ["sample_index"] if "sample_index" in have else []
    label = ["pain_intensity"] if "pain_intensity" in have and asked(LABEL_COLUMNS) else []
    channels = {c: prefix for c, prefix in channels.items() if asked(_channel_columns(prefix))}

    placed = _assign_blocks(clean, spec, keys, [*seq, *identity, *context, *label, *channels], lengths)
    sorted_ = placed.sortWithinPartitions("__cell", TIME, *seq)
    values = list(dict.fromkeys([*identity, *context, *label, *channels]))
    flat = sorted_.select(*[F.col(f"__cell.{k}").alias(k) for k in keys], F.col("__cell.block").alias("block"), F.xxhash64("__cell").alias("__hash"), TIME, "t_min", "t_max", *values)
    double, long = T.DoubleType(), T.LongType()
    fields = [T.StructField(c, flat.schema[c].dataType) for c in [*keys, *identity, *context]]
    fields += [T.StructField(c, long if c == "source_rows" else double) for c in ("window_start_s", "window_end_s", "source_rows", "window_max_gap_s", "window_allowed_gap_s", "window_s")]
    for prefix in channels.values():
        stats = [f"{prefix}__valid_count", *asked(f"{prefix}__{s}" for s in (*SUMMARY_STATS, "peak_count"))]
        fields += [T.StructField(c, long if c.endswith("_count") else double) for c in stats]
        fields += [T.StructField(c, double) for c in asked({"ibi": ("ibi__rmssd_ms", "ibi__sdnn_ms"), "acc__mag": ("acc__stillness_frac",)}.get(prefix, ()))]
    if label:
        fields += [T.StructField("target_pain_count", long), *[T.StructField(c, double) for c in ("target_pain_nrs_0_10", "target_pain_min", "target_pain_max")]]
    schema = T.StructType(fields)
    kernel = _Sweep(spec, tuple(float(s) for s in lengths), tuple(keys), (*identity, *context), tuple(channels.items()), bool(label), schema, keep_gapped)
    rows = flat.mapInArrow(kernel, schema)

    contiguous = F.col("window_max_gap_s") <= F.col("window_allowed_gap_s")
    out: dict[str, Column] = {
        "window_seconds": F.col("window_end_s") - F.col("window_start_s"),
        "target_hz": F.lit(float(spec.target_hz)),
        "window_contiguous": F.when(contiguous, F.lit(1)).otherwise(F.lit(0)),
    }
    present = list(channels.values())
    for prefix in all_prefixes() if all_blocks else present:
        out |= _channel_columns(prefix) if prefix in present else absent_columns(prefix)
    if label:
        n = F.col("target_pain_count")
        out |= {
            "target_available": F.when(n > 0, F.lit(1)).otherwise(F.lit(0)),
            "target_pain_coverage": n / F.col("source_rows"),
            **{c: F.col(c) for c in ("target_pain_nrs_0_10", "target_pain_min", "target_pain_max", "target_pain_count")},
        }
    lead = [*keys, *identity, "window_start_s", "window_end_s", "source_rows", "window_max_gap_s", "window_allowed_gap_s"]
    made = rows.select(*lead, *context, *[out[n].alias(n) for n in asked(out)], "window_s")
    return made if columns is None else made.select(*dict.fromkeys((*columns, "window_s")))


def stable_window_table(windows: DataFrame) -> DataFrame:
    """Fixed column order (identity first, then alphabetical) and fixed types, all context columns present."""
    have = set(windows.columns)
    add = {c: F.lit(None).cast("string") for c in CONTEXT_TEXT if c not in have}
    add |= {c: F.lit(None).cast("double") for c in CONTEXT_NUMERIC if c not in have}
    full = windows.withColumns(add) if add else windows
    integral = ("__present", "__valid_count", "__peak_count")
    keep_int = {"source_rows", "target_available", "target_pain_count"}
    ordered = [c for c in WINDOW_PREFERRED_ORDER if c in full.columns]
    ordered += sorted(c for c in full.columns if c not in ordered)
    types = {f.name: f.dataType for f in full.schema.fields}
    cols = []
    for c in ordered:
        if isinstance(types[c], (T.IntegerType, T.LongType)) and not (c.endswith(integral) or c in keep_int):
            cols.append(F.col(c).cast("double").alias(c))
        else:
            cols.append(F.col(c))
    return full.select(*cols)


def cap_sessions(stream: DataFrame, max_sessions: int, keys: Sequence[str] = ("dataset_id", "session_id")) -> DataFrame:
    """Keep the first ``max_sessions`` sessions (by id) of every dataset: a feature of the table builder."""
    dataset, session = keys
    w = Window.partitionBy(dataset).orderBy(F.col(session).asc_nulls_last())
    kept = (
        stream.select(dataset, session).distinct().withColumn("__r", F.row_number().over(w))
        .where(F.col("__r") <= max_sessions).select(F.col(dataset).alias("__d"), F.col(session).alias("__s"))
    )
    return stream.join(kept, F.col(dataset).eqNullSafe(F.col("__d")) & F.col(session).eqNullSafe(F.col("__s")), "left_semi")


def multiscale(
    stream: DataFrame, spec: WindowSpec, lengths: Sequence[float], keys: Sequence[str] = ("dataset_id", "session_id"), all_blocks: bool = True, keep_gapped: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The same table at several history lengths, stacked with a ``window_s`` column; the samples are exchanged once."""
    return _window_features(stream, spec, lengths, keys, all_blocks, keep_gapped, columns)


def pane_summary(
    stream: DataFrame, spec: WindowSpec, column: str, keys: Sequence[str] = ("dataset_id", "session_id")
) -> DataFrame:
    """Mean/std/min/max/count per tick for dense streams, from one-step panes.

    Samples are reduced to one row per (session, step) before any shuffle, then a frame of W/step
    panes is combined per block. Use when a step holds many samples (64-700 Hz); W must be a
    multiple of the step. Values are centred by the pane's own mean, so no precision is lost.
    """
    spec.check()
    per = spec.window_seconds / spec.step_seconds
    if abs(per - round(per)) > 1e-9:
        raise ValueError("window_seconds must be a multiple of the step")
    per = int(round(per))
    bounds = session_bounds(stream, spec, keys)
    if spec.include_partial_windows:
        raise ValueError("panes support full windows only")
    # Pane p covers (first + (p-1)*step, first + p*step]; the window at tick k is panes k-per+1 .. k.
    from pulsegrid.operators.scale import null_safe_join

    step = F.lit(spec.step_seconds)
    x, t = finite(column), F.col(TIME)
    raw = F.ceil((t - F.col("first_anchor")) / step).cast("long")
    edge = F.col("first_anchor") + F.col("__raw") * step
    pane = F.when(t > edge, F.col("__raw") + 1).when(t <= edge - step, F.col("__raw") - 1).otherwise(F.col("__raw"))
    panes = (
        null_safe_join(stream.where(t.isNotNull()).select(*keys, TIME, column), bounds.drop("t_min", "t_max"), keys, "inner")
        .withColumn("__raw", raw).withColumn("pane", pane)
        .where((F.col("pane") <= F.col("n_anchors") - 1) & (F.col("pane") > -per))
        .groupBy(*keys, "n_anchors", "first_anchor", "pane")
        .agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.avg(x).alias("m"),
             F.var_pop(x).alias("v"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    )
    # A block of anchors holds its own panes and those of one window before; panes are merged there, none is copied per tick.
    size = 8 * per
    block = lambda x: F.floor(x / F.lit(size)).cast("long")
    pane_no = F.col("pane")
    placed = panes.withColumn("__b", F.explode_outer(F.sequence(block(pane_no), block(pane_no + (per - 1))))).where("__b >= 0")
    dealt = placed.repartition(*keys, "__b").sortWithinPartitions(*keys, "__b", "pane").withColumn("__hash", F.xxhash64(F.struct(*keys)))
    double, long = T.DoubleType(), T.LongType()
    kinds = {"first_anchor": double, "k": long, "source_rows": long, "valid_count": long, "mean": double, "std": double, "min": double, "max": double}
    schema = T.StructType([*[T.StructField(c, dealt.schema[c].dataType) for c in keys], *[T.StructField(c, k) for c, k in kinds.items()]])
    combined = dealt.mapInArrow(_Panes(tuple(keys), per, size, schema), schema)
    return combined.where(F.col("source_rows") >= spec.min_window_rows).select(*keys, anchor_time(spec).alias("window_end_s"), "source_rows", "valid_count", "mean", "std", "min", "max")


@dataclass(frozen=True)
class _Panes:
    """Arrow kernel: the panes of a block in order, to one row per anchor of the block whose window has rows."""

    keys: tuple[str, ...]
    per: int
    size: int
    fields: T.StructType

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cells in whole_cells(batches, ("__hash", "__b"), 30_000):
            pane, block, anchors = (table.column(c).to_numpy() for c in ("pane", "__b", "n_anchors"))
            found = []
            for begin, stop in zip(cells.tolist(), [*cells[1:].tolist(), len(pane)], strict=True):
                k = np.arange(block[begin] * self.size, min((block[begin] + 1) * self.size, anchors[begin]))
                found.append((np.full(len(k), begin), k, begin + np.searchsorted(pane[begin:stop], k - self.per, side="right"), begin + np.searchsorted(pane[begin:stop], k, side="right")))
            cell, k, lo, hi = (np.concatenate(f).astype(np.int64) for f in zip(*found, strict=True))
            full = hi > lo
            cell, k, lo, hi = cell[full], k[full], lo[full], hi[full]
            plain = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)  # noqa: B023, E731
            n = plain("n")
            m = sweep.merged_panes(n, np.nan_to_num(plain("m")), np.nan_to_num(plain("v")) * n, np.where(n > 0, plain("lo"), np.inf), np.where(n > 0, plain("hi"), -np.inf), lo, hi)
            some = m["n"] > 0
            with np.errstate(invalid="ignore", divide="ignore"):
                std = np.sqrt(m["m2"] / m["n"])
            out = {"first_anchor": table.column("first_anchor").take(pa.array(cell)), "k": k, "source_rows": sweep.reduced(plain("rows"), lo, hi, np.add, 0.0).astype(np.int64), "valid_count": m["n"].astype(np.int64), "std": std}
            out |= {c: np.where(some, m[c], np.nan) for c in ("mean", "min", "max")}
            columns = [table.column(f.name).take(pa.array(cell)) if f.name in self.keys else out[f.name] if isinstance(out[f.name], pa.ChunkedArray) else pa.array(out[f.name], from_pandas=True) for f in self.fields]
            yield from pa.Table.from_arrays(columns, [f.name for f in self.fields]).combine_chunks().to_batches(10_000)
