"""Join and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import text as X
from pulsegrid.operators import aggregates as agg
from pulsegrid.operators import align as A
from pulsegrid.operators import intervals as I
from pulsegrid.plans.registry import query, table
from pulsegrid.plans.views import STREAM_SQL, events_stream, r6, rounded

SESSION = ["dataset_id", "session_id"]


def _sides(spark, sf):
    s = events_stream(spark, sf)
    left = s.where(F.col("eda").isNotNull()).select(*SESSION, "sample_index", "sample_offset_s", "eda")
    right = s.where(F.col("bvp").isNotNull()).select(*SESSION, "sample_offset_s", "bvp", F.col("sample_index").cast("double").alias("right_index"))
    return left, right


ASOF_SQL = f"""{STREAM_SQL},
l AS (SELECT dataset_id, session_id, sample_index, t, eda FROM stream WHERE eda IS NOT NULL),
r AS (SELECT session_id, sample_index AS right_index, t AS rt, bvp FROM stream WHERE bvp IS NOT NULL),
b AS (SELECT l.*, r.bvp AS b_bvp, r.rt AS b_t, r.right_index AS b_i FROM l ASOF LEFT JOIN r ON l.session_id = r.session_id AND l.t >= r.rt),
f AS (SELECT b.*, r.bvp AS f_bvp, r.rt AS f_t, r.right_index AS f_i FROM b ASOF LEFT JOIN r ON b.session_id = r.session_id AND b.t <= r.rt),
near AS (SELECT *, f_t IS NULL OR (b_t IS NOT NULL AND t - b_t <= f_t - t) AS use_b FROM f),
hit AS (SELECT *, CASE WHEN use_b THEN abs(t - b_t) ELSE abs(t - f_t) END AS d, CASE WHEN use_b THEN b_bvp ELSE f_bvp END AS n_bvp,
  CASE WHEN use_b THEN b_i ELSE f_i END AS n_i FROM near)"""


@query(
    "asof_nearest",
    f"""WITH {ASOF_SQL} SELECT sample_index, round(eda, 6) AS eda, round(CASE WHEN d <= 2.0 THEN n_bvp END, 6) AS bvp,
      CASE WHEN d <= 2.0 THEN CAST(n_i AS DOUBLE) END AS right_index FROM hit""",
)
def asof_nearest(spark, sf):
    left, right = _sides(spark, sf)
    out = A.asof_join(left, right, SESSION, "sample_offset_s", ["bvp", "right_index"], "nearest", 2.0, 24.0, "right_index")
    return rounded(out.select("sample_index", "eda", "bvp", "right_index"))


@query(
    "asof_backward",
    f"WITH {ASOF_SQL} SELECT sample_index, round(eda, 6) AS eda, round(b_bvp, 6) AS bvp, CAST(b_i AS DOUBLE) AS right_index FROM f",
)
def asof_backward(spark, sf):
    left, right = _sides(spark, sf)
    out = A.asof_join(left, right, SESSION, "sample_offset_s", ["bvp", "right_index"], "backward", None, 24.0, "right_index")
    return rounded(out.select("sample_index", "eda", "bvp", "right_index"))


@query(
    "asof_nearest_untimed",
    f"WITH {ASOF_SQL} SELECT sample_index, round(n_bvp, 6) AS bvp, CAST(n_i AS DOUBLE) AS right_index FROM hit",
)
def asof_nearest_untimed(spark, sf):
    left, right = _sides(spark, sf)
    out = A.asof_join(left, right, SESSION, "sample_offset_s", ["bvp", "right_index"], "nearest", None, 24.0, "right_index")
    return rounded(out.select("sample_index", "bvp", "right_index"))


@query(
    "dim_left_join",
    """SELECT o_orderkey, o_custkey, o_orderdate, c_mktsegment, round(c_acctbal, 6) AS c_acctbal
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def dim_left_join(spark, sf):
    dim = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    out = A.dim_left_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), dim, "o_custkey")
    return rounded(out)


#: Protocol headers written from the event rows: per session, segment k covers part of its own span, with overlaps.
SEG_SQL = f"""{STREAM_SQL},
span AS (SELECT session_id, max(t) AS t_max FROM stream GROUP BY session_id),
seg AS (SELECT session_id, seg_no, seg_no * floor(t_max / 6) AS s, seg_no * floor(t_max / 6) + floor(t_max / 5) AS e,
  (ARRAY['base', 'tsst', 'medi 1', 'fun'])[seg_no + 1] AS name
  FROM (SELECT session_id, t_max, unnest(range(4)) AS seg_no FROM span))"""


def _protocol_lines(spark, sf):
    """Three header lines per session, times written in minutes as the protocol files do."""
    span = events_stream(spark, sf).groupBy("session_id").agg(F.max("sample_offset_s").alias("t_max"))
    idx = F.array(*[F.lit(i) for i in range(4)])
    start = F.transform(idx, lambda i: (i * F.floor(F.col("t_max") / 6)).cast("string"))
    end = F.transform(idx, lambda i: (i * F.floor(F.col("t_max") / 6) + F.floor(F.col("t_max") / 5)).cast("string"))
    names = F.array(*[F.lit(n) for n in ("Base", "TSST", "Medi 1", "Fun")])
    lines = F.array(
        F.concat(F.lit("# ORDER;"), F.array_join(names, ";"), F.lit(";;")),
        F.concat(F.lit("# START;"), F.array_join(start, ";"), F.lit(";;")),
        F.concat(F.lit("# END;"), F.array_join(end, ";"), F.lit(";")),
    )
    return span.select("session_id", F.explode(lines).alias("value"))


@query(
    "protocol_parse",
    f"""WITH {SEG_SQL} SELECT session_id, CAST(seg_no AS INTEGER) AS seg_no, replace(name, ' ', '_') AS wesad_protocol_segment,
      round(s * 60.0, 6) AS wesad_protocol_start_s, round(e * 60.0, 6) AS wesad_protocol_end_s,
      CASE WHEN name = 'tsst' THEN 1.0::DOUBLE ELSE 0.0 END AS target_stress_binary,
      CASE WHEN name = 'tsst' THEN 8.0::DOUBLE ELSE 2.0 END AS target_stress_score_0_10,
      CASE WHEN name = 'tsst' THEN 'tsst_stress' ELSE replace(name, ' ', '_') END AS aux_state_label FROM seg""",
)
def protocol_parse(spark, sf):
    return rounded(A.protocol_segments(_protocol_lines(spark, sf), ["session_id"]))


@query(
    "interval_join",
    f"""WITH {SEG_SQL}, m AS (SELECT st.sample_index, st.t, max(seg_no) AS seg_no FROM stream st
      LEFT JOIN seg ON st.session_id = seg.session_id AND st.t >= s AND st.t <= e GROUP BY ALL)
    SELECT sample_index, round(t, 6) AS sample_offset_s, coalesce(replace(name, ' ', '_'), 'unknown') AS wesad_protocol_segment,
      CASE WHEN name IS NULL THEN NULL WHEN name = 'tsst' THEN 1.0::DOUBLE ELSE 0.0 END AS target_stress_binary
    FROM m JOIN (SELECT sample_index, session_id FROM stream) USING (sample_index) LEFT JOIN seg USING (session_id, seg_no)""",
)
def interval_join(spark, sf):
    seg = A.protocol_segments(_protocol_lines(spark, sf), ["session_id"]).withColumns({
        "wesad_protocol_start_s": F.col("wesad_protocol_start_s") / 60.0, "wesad_protocol_end_s": F.col("wesad_protocol_end_s") / 60.0})
    out = A.apply_protocol(events_stream(spark, sf).drop("condition"), seg, ["session_id"], bucket=30.0)
    return rounded(out.select("sample_index", "sample_offset_s", "wesad_protocol_segment", "target_stress_binary"))


@query(
    "equi_left_m2o",
    """WITH d AS (SELECT * FROM (SELECT l_orderkey, l_shipdate, l_quantity, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1)
    SELECT o_orderkey, o_custkey, l_shipdate, round(l_quantity, 6) AS l_quantity FROM orders LEFT JOIN d ON o_orderkey = l_orderkey""",
)
def equi_left_m2o(spark, sf):
    right = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    order = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    out = A.many_to_one_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), right, ["o_orderkey"], ["l_shipdate", "l_quantity"], order)
    return rounded(out)


@query(
    "dedupe_first",
    """SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
      ORDER BY value, event_id) AS rn FROM events) WHERE rn = 1""",
)
def dedupe_first(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return rounded(A.dedupe_first(ev, ["user_id", "event_type"], [F.col("value"), F.col("event_id")]))


#: Interval records: a non-view event opens an interval of (value modulo 50) minutes; kinds by event type.
KINDS = {"signup": "sleep", "click": "stand", "purchase": "workout", "error": "exercise"}
MINUTE_SQL = f"""iv AS (SELECT user_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS kind, ts AS s,
    ts + to_microseconds(CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 60000000 AS BIGINT)) AS e FROM events WHERE event_type <> 'view'),
mins AS (SELECT DISTINCT user_id, kind, unnest(generate_series(date_trunc('minute', s),
    date_trunc('minute', e) + CASE WHEN date_trunc('minute', e) < e THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END, INTERVAL 1 MINUTE)) AS minute FROM iv),
fl AS (SELECT user_id, minute, bool_or(kind = 'sleep') AS sl, bool_or(kind = 'stand') AS sd, bool_or(kind IN ('workout', 'exercise')) AS ac FROM mins GROUP BY ALL),
hrs AS (SELECT event_id, user_id, value, CASE WHEN ac THEN 'workout_or_exercise' WHEN sd THEN 'standing' WHEN sl THEN 'sleep' ELSE 'awake_nonworkout' END AS archetype
  FROM events ev LEFT JOIN fl ON ev.user_id = fl.user_id AND date_trunc('minute', ev.ts) = fl.minute)"""
MINUTE_SQL = MINUTE_SQL.replace("SELECT event_id, user_id, value, CASE WHEN ac", "SELECT event_id, ev.user_id AS user_id, value, CASE WHEN ac")


def _intervals(spark, sf):
    kind = F.lit(None).cast("string")
    for e, k in KINDS.items():
        kind = F.when(F.col("event_type") == e, k).otherwise(kind)
    start = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").where("event_type <> 'view'").select(
        "user_id", kind.alias("kind"), start.alias("s"), F.timestamp_micros(F.unix_micros(start) + k * 60_000_000).alias("e"))


def _archetypes(spark, sf):
    samples = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return A.archetype_label(samples, _intervals(spark, sf), ["user_id"], "ts", "s", "e", "kind")


@query("minute_membership", f"WITH {MINUTE_SQL} SELECT kind, user_id, count(*) AS minutes FROM mins GROUP BY ALL")
def minute_membership(spark, sf):
    return A.minute_counts(_intervals(spark, sf), ["user_id"], "s", "e", "kind").select("kind", "user_id", "minutes")


@query("archetype_label", f"WITH {MINUTE_SQL} SELECT event_id, archetype FROM hrs")
def archetype_label(spark, sf):
    return _archetypes(spark, sf).select("event_id", "archetype")


@query(
    "summary_quantiles",
    f"""WITH {MINUTE_SQL} SELECT archetype, count(value) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean,
      round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM hrs GROUP BY archetype""",
)
def summary_quantiles(spark, sf):
    return rounded(agg.quantile_summary(_archetypes(spark, sf), ["archetype"], "value"))


@query(
    "interval_union",
    f"""WITH {MINUTE_SQL}, u AS (SELECT user_id, kind, s, e FROM iv WHERE e >= s),
    m AS (SELECT user_id, kind, CAST(floor(epoch_us(s) / 60000000) AS BIGINT) AS a, CAST(floor((epoch_us(e) + 59999999) / 60000000) AS BIGINT) + 1 AS b FROM u),
    g AS (SELECT *, max(b) OVER (PARTITION BY user_id, kind ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
    r AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, kind ORDER BY a, b) AS n FROM g)
    SELECT user_id, kind, min(a) AS at, max(b) AS until FROM r GROUP BY user_id, kind, n""",
)
def interval_union(spark, sf):
    """Disjoint pieces of each person's records of a kind, in minutes."""
    return I.merged(I.in_minutes(_intervals(spark, sf), "s", "e"), ["user_id", "kind"], "__from", "__to", 30 * A.DAY)


@query(
    "minute_set_ops",
    f"""WITH {MINUTE_SQL}, a AS (SELECT user_id, minute FROM mins WHERE kind = 'workout'), b AS (SELECT user_id, minute FROM mins WHERE kind = 'exercise')
    SELECT 'union' AS op, count(*) AS minutes FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL
    SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL
    SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def minute_set_ops(spark, sf):
    records = I.in_minutes(_intervals(spark, sf), "s", "e")
    return I.set_sizes(records, ["user_id"], "__from", "__to", F.col("kind") == "workout", F.col("kind") == "exercise", 30 * A.DAY, "minutes")


ANCHOR_SQL = f"""{STREAM_SQL},
an AS (SELECT session_id, sample_index AS anchor_id, t AS w_end FROM stream WHERE condition = 'view'),
mem AS (SELECT an.session_id, anchor_id, w_end, s.t, s.pain, s.covas, s.sample_index FROM an JOIN stream s ON an.session_id = s.session_id AND s.t <= w_end AND s.t > w_end - 6.0)"""


def _anchor_samples(spark, sf):
    s = events_stream(spark, sf)
    anchors = s.where(F.col("condition") == "view").select("session_id", F.col("sample_index").alias("anchor_id"), F.col("sample_offset_s").alias("window_end_s"))
    return A.anchor_samples(anchors, s, ["session_id"], 6.0, ["pain_intensity", "source_pain_covas_0_100", "sample_index"])


@query(
    "anchor_range_join",
    f"WITH {ANCHOR_SQL} SELECT anchor_id, round(w_end, 6) AS window_end_s, count(*) AS source_rows, round(avg(covas), 6) AS mean_rating FROM mem GROUP BY anchor_id, w_end",
)
def anchor_range_join(spark, sf):
    return rounded(_anchor_samples(spark, sf).groupBy("anchor_id", "window_end_s").agg(
        F.count(F.lit(1)).alias("source_rows"), F.avg("source_pain_covas_0_100").alias("mean_rating")))


@query(
    "recent_label",
    f"""WITH {ANCHOR_SQL}, m2 AS (SELECT *, CASE WHEN sample_index % 3 > 0 THEN pain END AS p FROM mem)
    SELECT anchor_id, round(coalesce(median(p) FILTER (WHERE t > w_end - 1.0), median(p)), 6) AS target_median,
      round(coalesce(arg_max(p, t) FILTER (WHERE t > w_end - 1.0 AND p IS NOT NULL), arg_max(p, t) FILTER (WHERE p IS NOT NULL)), 6) AS target_last
    FROM m2 GROUP BY anchor_id HAVING count(p) > 0""",
)
def recent_label(spark, sf):
    from pulsegrid.operators.shape import recent_targets

    rows = _anchor_samples(spark, sf).withColumn("p", F.when(F.col("sample_index") % 3 > 0, F.col("pain_intensity")))
    return rounded(recent_targets(rows, ["anchor_id"], "p"))


@query(
    "pair_by_key",
    """WITH f AS (SELECT user_id || '_' || event_type || CASE WHEN event_id % 2 = 1 THEN '_runUp' ELSE '' END || '.csv' AS path, value FROM events),
    g AS (SELECT path, count(*) AS rows FROM f GROUP BY path)
    SELECT m.path AS main_path, r.path AS runup_path, m.rows AS main_rows, CAST(r.rows AS DOUBLE) AS runup_rows FROM g m
      LEFT JOIN g r ON replace(r.path, '_runUp.csv', '.csv') = m.path AND contains(r.path, '_runUp') WHERE NOT contains(m.path, '_runUp')""",
)
def pair_by_key(spark, sf):
    path = F.concat_ws("", F.col("user_id"), F.lit("_"), "event_type", F.when(F.col("event_id") % 2 == 1, "_runUp").otherwise(""), F.lit(".csv"))
    files = table(spark, sf, "events").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    main = files.where(~F.col("path").contains("_runUp")).select(F.col("path").alias("main_path"), F.col("rows").alias("main_rows"))
    runup = files.where(F.col("path").contains("_runUp")).select(
        F.replace("path", F.lit("_runUp.csv"), F.lit(".csv")).alias("main_path"), F.col("path").alias("runup_path"), F.col("rows").cast("double").alias("runup_rows"))
    return main.join(runup, "main_path", "left")


@query("anti_join", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, sf):
    picked = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(picked, "c_custkey", "left_anti")


@query(
    "sample_index",
    f"WITH {STREAM_SQL} SELECT dataset_id, session_id, sample_index AS event_id, row_number() OVER (PARTITION BY dataset_id, session_id ORDER BY t, sample_index) - 1 AS position FROM stream",
)
def sample_index(spark, sf):
    s = events_stream(spark, sf).select(*SESSION, F.col("sample_index").alias("event_id"), "sample_offset_s")
    return A.running_index(s, SESSION, "sample_offset_s", "position", ["event_id"]).drop("sample_offset_s")


@query(
    "relative_offset",
    """SELECT event_id, round((us - first_value(us IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 1e6, 6) AS offset_s
    FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 > 0 THEN epoch_us(ts) END AS us FROM events)""",
)
def relative_offset(spark, sf):
    us = F.when(F.col("event_id") % 4 > 0, F.unix_micros(F.col("ts").cast("timestamp")))
    ev = table(spark, sf, "events").select("event_id", "user_id", us.alias("us"))
    return rounded(A.relative_offset(ev, ["user_id"], "us", ["event_id"], 1e6, "offset_s").select("event_id", "offset_s"))


@query("decimate", "SELECT event_id, user_id FROM events WHERE event_id % 11 = 0")
def decimate(spark, sf):
    """Every eleventh sample: decimation is the operator itself, not a row cap."""
    return A.decimate(table(spark, sf, "events").select("event_id", "user_id"), "event_id", 11)


@query(
    "session_gap_split",
    f"""WITH {STREAM_SQL}, d AS (SELECT session_id, t, sample_index, CASE WHEN t - lag(t) OVER w >= 3.0 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS n
      FROM stream WINDOW w AS (PARTITION BY session_id ORDER BY t, sample_index)),
    r AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY t, sample_index) AS run FROM d)
    SELECT session_id, CAST(run AS BIGINT) AS run, round(min(t), 6) AS run_start, round(max(t), 6) AS run_end, count(*) AS rows FROM r GROUP BY session_id, run""",
)
def session_gap_split(spark, sf):
    s = events_stream(spark, sf).select("session_id", "sample_offset_s", "sample_index")
    return rounded(A.gap_sessions(s, ["session_id"], "sample_offset_s", 3.0, "sample_index", 24.0))
