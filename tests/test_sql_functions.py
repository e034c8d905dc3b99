import math

from pulsegrid.functions.sql import register


def test_sql_surface(spark):
    register(spark, 4.0)
    wave = ", ".join(f"{math.sin(2 * math.pi * i / 8)!r}D" for i in range(64))
    r = spark.sql(f"SELECT spectral_features(array({wave})) AS s, wavelet_features(array({wave})) AS w, coupling_features(array({wave}), array({wave})) AS c").first()
    assert r["s"]["dominant_frequency"] == 0.5 and abs(sum(r["w"]) - 1.0) < 1e-9 and abs(r["c"]["correlation"] - 1.0) < 1e-12
    header = "# ORDER;Base;TSST;Rest\n# START;1;2;nan\n# END;2;3;inf"
    seg = spark.createDataFrame([("a", header)], "id string, header string")
    seg.createOrReplaceTempView("headers")
    rows = spark.sql("SELECT id, segment, start_s, end_s FROM headers, LATERAL protocol_segments(header) ORDER BY seg_no").collect()
    assert [tuple(x) for x in rows] == [("a", "base", 0.0, 60.0), ("a", "tsst", 60.0, 120.0)]
    grid = spark.sql("SELECT resample_linear(array(0.0D, 1.0D, 2.0D, 3.0D), array(0.0D, 2.0D, 4.0D, 6.0D), 0.0D, 3.0D) AS g").first()["g"]
    assert len(grid) == 13 and grid[2] == 1.0
