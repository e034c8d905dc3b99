"""The Arrow kernels and the protocol parser as SQL functions, for users who write SQL."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pulsegrid.functions import kernels as KE


@udtf(returnType="seg_no int, segment string, start_s double, end_s double")
class ProtocolSegments:
    """``SELECT * FROM t, LATERAL protocol_segments(t.header)`` - one row per segment of one header text."""

    def eval(self, text: str):
        if text is None:
            return
        rows = {}
        for line in text.splitlines():
            head, *rest = [p.strip() for p in line.rstrip(";").split(";")]
            rows[head] = rest

        def number(s):
            try:
                value = float(s.replace(",", "."))
            except ValueError:
                return None
            return value if math.isfinite(value) else None  # words such as "nan" and "inf" are no times

        starts, ends = [[number(s) for s in rows.get(k, [])] for k in ("# START", "# END")]
        known = [s for s in starts if s is not None]
        for i, (name, a, b) in enumerate(zip(rows.get("# ORDER", []), starts, ends)):
            if name and a is not None and b is not None:
                yield i, name.lower().replace(" ", "_"), (a - min(known)) * 60.0, (b - min(known)) * 60.0


def register(spark: SparkSession, hz: float = 4.0) -> None:
    """Register ``spectral_features``, ``wavelet_features``, ``coupling_features``, ``resample_linear`` and ``protocol_segments``."""
    spark.udf.register("spectral_features", KE.spectral_features(hz))
    spark.udf.register("wavelet_features", KE.wavelet_features())
    spark.udf.register("coupling_features", KE.coupling_features(hz))
    spark.udf.register("resample_linear", KE.resample(hz))
    spark.udtf.register("protocol_segments", ProtocolSegments)
