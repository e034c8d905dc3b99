import os
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.streaming import live, ordered

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
DELAY, IDLE, ALPHA = 20, 600, 0.3


def plain(batches):
    """Rows not behind the watermark of the batches before theirs, in time order, cut at long silences; those the last watermark reached."""
    kept, newest = [], None
    for batch in batches:
        mark = None if newest is None else newest - DELAY
        kept += [r for r in batch if r[2] is not None and (mark is None or r[2] > mark)]
        newest = max([r[2] for r in batch if r[2] is not None] + ([] if newest is None else [newest]))
    out, past = {}, {}
    for key, row, t, v in sorted(kept, key=lambda r: (r[2], r[1])):
        if t > newest - DELAY:
            continue
        first, last, n, level = past.get(key, (t, None, 0, None))
        if last is not None and t - last >= IDLE:
            first, n, level = t, 0, None
        level = level if v is None else v if level is None else ALPHA * v + (1 - ALPHA) * level
        out[row] = (key, n, t - first, level)
        past[key] = (first, t, n + 1, level)
    return out


BATCHES = [
    [("a", 1, 0.0, 1.0), ("a", 2, 10.0, 5.0), ("a", 3, 5.0, None), ("b", 4, 0.5, 2.0), (None, 5, 1.0, 3.0)],
    [("a", 6, 7.0, 9.0), ("a", 7, 30.0, 4.0), ("b", 8, None, 8.0), ("a", 9, 10.0, 6.0), ("c", 10, 12.0, None)],
    [("a", 11, 3.0, 100.0), ("a", 12, 100.0, 2.0), (None, 13, 90.0, 7.0)],
    [("a", 14, 95.0, 8.0), ("a", 15, 699.9, 1.0), ("a", 16, 2000.0, 3.0), ("c", 17, 2000.0, 3.0)],
    [("a", 18, 1990.0, 4.0), ("a", 19, 2100.0, 5.0), ("b", 20, 2100.0, 6.0)],
    [("b", 21, 9000.0, 1.0), ("a", 22, 8990.0, 1.0)],
]


def test_late_rows_take_their_place_and_idle_runs_end(spark, tmp_path):
    for i, batch in enumerate(BATCHES):
        rows = pd.DataFrame([(k, r, None if t is None else START + timedelta(seconds=t), v) for k, r, t, v in batch], columns=["s", "row", "ts", "v"])
        path = tmp_path / f"{i}.parquet"
        rows.astype({"ts": "datetime64[us, UTC]"}).to_parquet(path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("s string, row long, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = live.run_available(ordered.ordered_signal(stream, "s", "ts", "row", "v", ALPHA, f"{DELAY} seconds", IDLE), "t", ordered.STATE_STORE).collect()
    want = plain(BATCHES)
    assert len(got) == len(want) and 11 not in want and want[2][1] == 3 and want[16][1] == 1
    for r in got:
        key, n, offset, level = want[r["row"]]
        assert (r["s"], r["sample_index"]) == (key, n) and r["offset_s"] == pytest.approx(offset)
        assert r["level"] is None if level is None else r["level"] == pytest.approx(level)


def test_an_empty_stream_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], "s string, row long, ts timestamp, v double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("s string, row long, ts timestamp, v double").parquet(str(tmp_path / "e"))
    got = live.run_available(ordered.ordered_signal(stream, "s", "ts", "row", "v", ALPHA, "1 second", 5), "e", ordered.STATE_STORE)
    assert got.select(F.count("*")).first()[0] == 0
