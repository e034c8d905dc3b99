"""Projection, predicate and label queries: text cleaning, numbers, routing, bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import schema as S
from pulsegrid.functions import labels as L
from pulsegrid.functions import text as X
from pulsegrid.operators.scale import exact_quantiles
from pulsegrid.plans.registry import query, table
from pulsegrid.plans.views import STREAM_SQL, events_stream, r6, rounded

CANON = "regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '[^0-9A-Za-z]+', '_', 'g')"


@query(
    "canon_text",
    f"""SELECT page_id AS id, 'url' AS kind, lower(trim({CANON.format(c='url')}, '_')) AS canonical,
      nullif(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '') AS cleaned FROM pages
    UNION ALL SELECT item_id, 'item', lower(trim({CANON.format(c='text')}, '_')),
      nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') FROM benchmark""",
)
def canon_text(spark, sf):
    def part(name, key, kind, col):
        return table(spark, sf, name).select(
            F.col(key).alias("id"), F.lit(kind).alias("kind"), X.canonical_name(col).alias("canonical"), X.clean_text(col).alias("cleaned"))

    return part("pages", "page_id", "url", "url").unionByName(part("benchmark", "item_id", "item", "text"))


#: Numbers as messy text: decimal comma, padding, missing tokens, junk - chosen by line number.
MESSY_SQL = """CASE l_linenumber % 4 WHEN 0 THEN replace(CAST(l_extendedprice AS VARCHAR), '.', ',')
  WHEN 1 THEN '  ' || CAST(l_quantity AS VARCHAR) || ' ' WHEN 2 THEN 'NaN' ELSE l_returnflag || CAST(l_tax AS VARCHAR) END"""


def _messy():
    n = F.col("l_linenumber") % 4
    return (
        F.when(n == 0, F.replace(F.col("l_extendedprice").cast("string"), F.lit("."), F.lit(",")))
        .when(n == 1, F.concat(F.lit("  "), F.col("l_quantity").cast("string"), F.lit(" ")))
        .when(n == 2, F.lit("NaN")).otherwise(F.concat("l_returnflag", F.col("l_tax").cast("string")))
    )


@query(
    "clean_numeric",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN regexp_full_match(m, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?')
      THEN TRY_CAST(m AS DOUBLE) END, 6) AS value
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, replace(trim({MESSY_SQL}), ',', '.') AS m FROM lineitem)""",
)
def clean_numeric(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(X.clean_numeric(_messy())).alias("value"))


@query(
    "numeric_first",
    """SELECT doc_id, round(TRY_CAST(nullif(regexp_extract(replace(text, ',', '.'), '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE), 6) AS value
    FROM documents""",
)
def numeric_first(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r6(X.numeric_first("text")).alias("value"))


def _any_sql(t: str, words, parts) -> str:
    quoted = ", ".join(f"'{w}'" for w in words)
    return f"({t} IN ({quoted}) OR " + " OR ".join(f"contains({t}, '{p}')" for p in parts) + ")"


@query(
    "yes_no_flag",
    f"""SELECT conv_id, turn, CASE WHEN {_any_sql('t', X.YES_WORDS, X.YES_PARTS)} THEN 1.0::DOUBLE
      WHEN {_any_sql('t', X.NO_WORDS, X.NO_PARTS)} THEN 0.0::DOUBLE END AS flag
    FROM (SELECT conv_id, turn, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM conversations)""",
)
def yes_no_flag(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.yes_no_flag("text").alias("flag"))


ORDINAL_SQL = "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN {s}::DOUBLE" for w, s in X.ORDINAL_KEYWORDS) + " END"


@query(
    "ordinal_text_score",
    f"""SELECT doc_id, round(coalesce(TRY_CAST(nullif(regexp_extract(replace(text, ',', '.'), '[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE),
      {ORDINAL_SQL}), 6) AS score FROM documents""",
)
def ordinal_text_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r6(X.ordinal_text_score("text")).alias("score"))


@query(
    "row_nanmean",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN NULL ELSE
      (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT) END, 6) AS mean
    FROM (SELECT *, nullif(l_discount, 0.0) AS a, nullif(l_tax, 0.0) AS b, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity END AS c FROM lineitem)""",
)
def row_nanmean(spark, sf):
    parts = [F.nullif("l_discount", F.lit(0.0)), F.nullif("l_tax", F.lit(0.0)), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity"))]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(X.row_mean(parts)).alias("mean"))


@query(
    "split_pair",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS first_value,
      CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS DOUBLE) END AS second_value FROM lineitem""",
)
def split_pair(spark, sf):
    pair = F.concat(F.col("l_quantity").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("/"), "l_linenumber")).otherwise(""))
    return table(spark, sf, "lineitem").withColumn("bp", pair).select(
        "l_orderkey", "l_linenumber", "l_partkey", X.split_part_number("bp", 0).alias("first_value"),
        X.split_part_number("bp", 1).alias("second_value"))


@query(
    "zfill",
    """SELECT user_id, CASE WHEN length(CAST(user_id AS VARCHAR)) >= 3 THEN CAST(user_id AS VARCHAR)
      ELSE lpad(CAST(user_id AS VARCHAR), 3, '0') END AS padded, count(*) AS rows FROM events GROUP BY user_id""",
)
def zfill(spark, sf):
    raw = F.concat(F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, ".0").otherwise(""))
    return table(spark, sf, "events").select("user_id", X.zero_padded_id(raw).alias("padded")).groupBy("user_id", "padded").agg(
        F.count(F.lit(1)).alias("rows"))


@query(
    "session_key",
    """SELECT CAST(user_id AS VARCHAR) || '_' || event_type || '_scale_' ||
      coalesce(CAST(CASE WHEN event_id % 3 > 0 THEN event_id % 3 END AS VARCHAR), 'unknown') AS session_id, count(*) AS rows
    FROM events GROUP BY ALL""",
)
def session_key(spark, sf):
    scale = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3)
    return table(spark, sf, "events").select(
        X.session_key(F.col("user_id").cast("string"), "event_type", scale).alias("session_id")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rows"))


@query(
    "rescale",
    f"""WITH {STREAM_SQL} SELECT sample_index, round(covas / 10.0, 6) AS nrs, round(ibi * 1000.0, 6) AS ibi_ms,
      round(sample_index / 64.0, 6) AS offset_s, round(t, 6) AS ticks FROM stream""",
)
def rescale(spark, sf):
    return events_stream(spark, sf).select(
        "sample_index", r6(F.col("source_pain_covas_0_100") / 10.0).alias("nrs"), r6(F.col("ibi") * 1000.0).alias("ibi_ms"),
        r6(F.col("sample_index") / 64.0).alias("offset_s"), r6("sample_offset_s").alias("ticks"))


@query(
    "vector_magnitude",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity * l_quantity + l_discount * l_discount + t * t), 6) AS magnitude
    FROM (SELECT *, nullif(l_tax, 0.0) AS t FROM lineitem)""",
)
def vector_magnitude(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r6(X.magnitude("l_quantity", "l_discount", F.nullif("l_tax", F.lit(0.0)))).alias("magnitude"))


@query(
    "minute_interval",
    """SELECT event_id, epoch_us(date_trunc('minute', ts)) AS floor_us,
      epoch_us(date_trunc('minute', ts) + CASE WHEN date_trunc('minute', ts) < ts THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END) AS ceil_us
    FROM events""",
)
def minute_interval(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        "event_id", F.unix_micros(X.minute_floor(ts)).alias("floor_us"), F.unix_micros(X.minute_ceil(ts)).alias("ceil_us"))


@query(
    "json_props",
    """SELECT event_type, '{"event_type":"' || event_type || '","rows":' || count(*) || ',"k_sum":' ||
      CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS VARCHAR) || '}' AS manifest FROM events GROUP BY event_type""",
)
def json_props(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    agg = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum(k).alias("k_sum"))
    return agg.select("event_type", F.to_json(F.struct("event_type", "rows", "k_sum")).alias("manifest"))


@query(
    "path_keys",
    """SELECT event_id, 'p' || CAST(user_id AS VARCHAR) AS subject_id, 'p' || CAST(user_id AS VARCHAR) || '_' || CAST(event_id % 4 AS VARCHAR) AS session_id,
      CAST(event_id % 4 AS INTEGER) AS session_number, 'S' || CAST(user_id AS VARCHAR) AS activity_subject, event_type AS activity FROM events""",
)
def path_keys(spark, sf):
    name = F.concat(F.lit("P"), F.col("user_id"), F.lit("_"), F.col("event_id") % 4)
    clinical = F.concat(F.lit("raw-data/"), name, F.lit("/"), name, F.lit(".csv"))
    activity = F.concat(F.lit("root/Wearable_Dataset/"), F.col("event_type"), F.lit("/S"), F.col("user_id"), F.lit("/EDA.csv"))
    ev = table(spark, sf, "events").select("event_id", clinical.alias("p"), activity.alias("a"))
    keys = X.path_keys("a", "activity")
    return ev.select("event_id", *[c.alias(n) for n, c in X.clinical_session_keys("p").items()],
                     keys["subject"].alias("activity_subject"), keys["condition"].alias("activity"))


# Labels -----------------------------------------------------------------------------------------

# The event rows relabelled onto the known datasets and conditions, so that every routing rule is met.
DATASETS = ("painmonit", "wesad", "catsa", "epm_e4", "induced_stress_exercise", "physiopain_eeg", "other_set", "silver_pain", "painmonit_pmed")
CONDITIONS = {"view": " Rest", "click": "logic", "purchase": "Aerobic session", "signup": "baseline", "error": ""}
CLEAN_CONDITIONS = {"view": "stress", "click": "logic", "purchase": "aerobic", "signup": "baseline", "error": "anaerobic"}

LABELED_SQL = f"""rows_in AS (SELECT event_id, user_id, ts, event_type,
    (ARRAY[{', '.join(repr(d) for d in DATASETS)}])[CAST(user_id % {len(DATASETS)} AS INTEGER) + 1] AS dataset_id,
    CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CONDITIONS.items())} END AS condition,
    CASE WHEN k % 3 = 0 THEN 'stroop' WHEN k % 5 = 0 THEN 'Neutral' END AS aux_state_label,
    CASE WHEN k % 2 = 0 THEN k / 10.0 END AS target, CASE WHEN k % 7 = 0 THEN CAST((k // 7) % 2 AS DOUBLE) END AS stress
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
norm AS (SELECT *, lower(trim(coalesce(nullif(condition, ''), aux_state_label, ''))) AS c FROM rows_in),
fam AS (SELECT *, CASE
    WHEN dataset_id IN {S.DIRECT_PAIN_DATASETS} AND target IS NOT NULL THEN 'direct_pain'
    WHEN stress IS NOT NULL OR dataset_id IN {S.STRESS_PROXY_DATASETS} THEN 'stress_proxy'
    WHEN dataset_id = 'catsa' AND c IN {S.BASELINE_TERMS} THEN 'baseline_context'
    WHEN dataset_id = 'catsa' AND c IN {S.COGNITIVE_TERMS} THEN 'cognitive_load_proxy'
    WHEN dataset_id = 'epm_e4' THEN 'emotion_proxy'
    WHEN dataset_id IN {S.ACTIVITY_CONTEXT_DATASETS} OR contains(c, 'exercise') OR contains(c, 'aerobic') OR contains(c, 'active') THEN 'exercise_context'
    WHEN dataset_id IN {S.EEG_DATASETS} THEN 'pain_context_unlabeled'
    WHEN c IN {S.BASELINE_TERMS} THEN 'baseline_context' ELSE 'unlabeled' END AS label_family,
  CASE WHEN target <= 0 THEN 0.0::DOUBLE WHEN target < 4 THEN 1.0 WHEN target < 7 THEN 2.0 WHEN target >= 7 THEN 3.0 END AS target_pain_bin FROM norm)"""


def labeled_rows(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    cond = F.lit(None).cast("string")
    for event, text in CONDITIONS.items():
        cond = F.when(F.col("event_type") == event, text).otherwise(cond)
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", "event_type",
        F.get(F.array(*[F.lit(d) for d in DATASETS]), (F.col("user_id") % len(DATASETS)).cast("int")).alias("dataset_id"),
        cond.alias("condition"),
        F.when(k % 3 == 0, "stroop").when(k % 5 == 0, "Neutral").alias("aux_state_label"),
        F.when(k % 2 == 0, k / 10.0).alias("target_pain_nrs_0_10"),
        F.when(k % 7 == 0, (F.floor(k / 7) % 2).cast("double")).alias("target_stress_binary"))


@query("label_family", f"WITH {LABELED_SQL} SELECT event_id, label_family, target_pain_bin, round(target, 6) AS pain_intensity FROM fam")
def label_family(spark, sf):
    out = L.add_common_labels(labeled_rows(spark, sf))
    return out.select("event_id", "label_family", "target_pain_bin", r6("pain_intensity").alias("pain_intensity"))


@query("ordinal_bin", f"WITH {LABELED_SQL} SELECT target_pain_bin, count(*) AS rows FROM fam GROUP BY target_pain_bin")
def ordinal_bin(spark, sf):
    rows = labeled_rows(spark, sf).select(L.ordinal_pain_bin("target_pain_nrs_0_10").alias("target_pain_bin"))
    return rows.groupBy("target_pain_bin").agg(F.count(F.lit(1)).alias("rows"))


def _bin_sql(edges, labels):
    return "CASE " + " ".join(f"WHEN v <= {e} THEN '{n}'" for e, n in zip(edges, labels)) + f" WHEN v > {edges[-1]} THEN '{labels[-1]}' END"


@query(
    "right_closed_bin",
    f"""SELECT {', '.join(f'{_bin_sql(*s)} AS bin_{n}' for n, s in L.BIN_SCHEMES.items())}, count(*) AS rows
    FROM (SELECT CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity / 5.0 - 1.0 END AS v FROM lineitem) GROUP BY ALL""",
)
def right_closed_bin(spark, sf):
    v = F.when(F.col("l_linenumber") != 5, F.col("l_quantity") / 5.0 - 1.0)
    li = table(spark, sf, "lineitem").select(v.alias("v"))
    bins = [L.right_closed_bin("v", *s).alias(f"bin_{n}") for n, s in L.BIN_SCHEMES.items()]
    return li.select(*bins).groupBy(*[f"bin_{n}" for n in L.BIN_SCHEMES]).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "training_rows",
    f"WITH {LABELED_SQL} SELECT event_id, dataset_id, round(target, 6) AS target_pain_nrs_0_10 FROM fam WHERE label_family = 'direct_pain' AND target IS NOT NULL",
)
def training_rows(spark, sf):
    rows = L.rows_for_pain_training(L.add_common_labels(labeled_rows(spark, sf)))
    return rows.select("event_id", "dataset_id", r6("target_pain_nrs_0_10").alias("target_pain_nrs_0_10"))


TASKS_SQL = f"""{LABELED_SQL},
cc AS (SELECT *, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CLEAN_CONDITIONS.items())} END AS cond FROM fam),
tasks AS (
  SELECT 'pain_high_4_plus' AS task, *, target AS target_value, CAST(target >= 4.0 AS INTEGER) AS y FROM cc
    WHERE dataset_id IN {S.ANCHOR_PAIN_DATASETS} AND target IS NOT NULL
  UNION ALL SELECT 'wesad_stress', *, stress, CAST(stress AS INTEGER) FROM cc WHERE dataset_id = 'wesad' AND stress IS NOT NULL
  UNION ALL SELECT 'stress_vs_exercise', *, CAST(cond = 'stress' AS DOUBLE), CAST(cond = 'stress' AS INTEGER) FROM cc
    WHERE dataset_id = 'induced_stress_exercise' AND cond IN ('stress', 'aerobic', 'anaerobic')
  UNION ALL SELECT 'cognitive_load_vs_baseline', *, CAST(cond <> 'baseline' AS DOUBLE), CAST(cond <> 'baseline' AS INTEGER) FROM cc
    WHERE dataset_id = 'catsa')"""


def task_input(spark, sf):
    """Labeled rows shaped like window rows (session = user, end = event time in ticks)."""
    rows = labeled_rows(spark, sf)
    cond = F.lit(None).cast("string")
    for event, text in CLEAN_CONDITIONS.items():
        cond = F.when(F.col("event_type") == event, text).otherwise(cond)
    return rows.withColumns({
        "condition": cond, "subject_id": F.col("user_id").cast("string"), "session_id": F.col("user_id").cast("string"),
        "window_end_s": F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6,
    })


@query("task_labels", f"WITH {TASKS_SQL} SELECT task, event_id, dataset_id, round(target_value, 6) AS target_value, y FROM tasks")
def task_labels(spark, sf):
    return L.task_rows(task_input(spark, sf)).select("task", "event_id", "dataset_id", r6("target_value").alias("target_value"), "y")


#: Feature columns for the weak labels, taken from the event rows.
WEAK_FEATURES = {
    "ibi__base__mean": ("value / 100.0D", "value / 100.0"),
    "hr__base__mean": ("CASE WHEN event_id % 4 > 0 THEN value END", "CASE WHEN event_id % 4 > 0 THEN value END"),
    "eda__base__mean": ("(event_id % 97) / 10.0D", "(event_id % 97) / 10.0"),
    "eda__shape__late_minus_early_z": ("(event_id % 31) / 5.0D", "(event_id % 31) / 5.0"),
    "acc_mag__base__std": ("(user_id % 13) / 13.0D", "(user_id % 13) / 13.0"),
}


def weak_input(spark, sf):
    value = table(spark, sf, "events").select(F.col("event_id").alias("__e"), "value")
    rows = task_input(spark, sf).join(value, F.col("event_id") == F.col("__e")).drop("__e")
    rows = rows.withColumns({n: F.expr(s).cast("double") for n, (s, _) in WEAK_FEATURES.items()}).drop("value")
    return L.task_rows(rows)


def _part_sql(c: str, invert: bool) -> str:
    s = f"greatest(0.0, least(1.0, ({c} - lo_{c}) / (hi_{c} - lo_{c})))"
    return f"CASE WHEN {c} IS NOT NULL THEN {'1.0 - ' + s if invert else s} END"


_AROUSAL = "task IN ('wesad_stress', 'cognitive_load_vs_baseline', 'pain_high_4_plus')"
WEAK_SQL = f"""{TASKS_SQL},
wf AS (SELECT t.*, {', '.join(f'CAST({s} AS DOUBLE) AS {n}' for n, (_, s) in WEAK_FEATURES.items())}
  FROM tasks t JOIN (SELECT event_id, value FROM events) USING (event_id)),
lim AS (SELECT {', '.join(f'quantile_cont({c}, 0.05) AS lo_{c}, quantile_cont({c}, 0.95) AS hi_{c}' for c in WEAK_FEATURES)} FROM wf),
parts AS (SELECT wf.*, [{', '.join(_part_sql(c, i) for c, i in L.PROXY_PARTS)}] AS p FROM wf, lim),
scored AS (SELECT * EXCLUDE (p), list_avg(list_filter(p, lambda v: v IS NOT NULL)) AS score FROM parts),
flags AS (SELECT *, y = 1 AS pos, {_AROUSAL} AND y = 0 AS calm,
    {_AROUSAL} AND y = 0 AND NOT (task = 'pain_high_4_plus' AND dataset_id = 'painmonit_pmed') AS home FROM scored),
cut AS (SELECT quantile_cont(score, 0.3) AS lo, quantile_cont(score, 0.7) AS hi, count(score) AS n FROM flags WHERE home AND score IS NOT NULL)"""


@query(
    "weak_labels",
    f"""WITH {WEAK_SQL} SELECT task, event_id, CASE WHEN pos THEN 1.0::DOUBLE WHEN calm THEN 0.0 END AS sympathetic_activation,
      CASE WHEN pos THEN 0.0::DOUBLE WHEN home THEN 1.0 END AS homeostasis,
      CASE WHEN n < 20 OR score IS NULL THEN NULL WHEN pos THEN 0.0::DOUBLE WHEN home AND score <= lo THEN 0.0
        WHEN home AND score >= hi THEN 1.0 END AS parasympathetic_recovery_proxy,
      CASE WHEN task = 'stress_vs_exercise' AND y = 0 THEN 1.0::DOUBLE WHEN task <> 'stress_vs_exercise' THEN 0.0 END AS activity_control
    FROM flags, cut""",
)
def weak_labels(spark, sf):
    return L.weak_labels(weak_input(spark, sf)).select(
        "task", "event_id", "sympathetic_activation", "homeostasis", "parasympathetic_recovery_proxy", "activity_control")


@query("proxy_score", f"WITH {WEAK_SQL} SELECT task, event_id, round(score, 9) AS pns_proxy_score FROM scored")
def proxy_score(spark, sf):
    return L.proxy_score(weak_input(spark, sf)).select("task", "event_id", F.round("pns_proxy_score", 9).alias("pns_proxy_score"))


@query(
    "quantile_scale",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.95) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(1.0 - greatest(0.0, least(1.0, (l_extendedprice - lo) / (hi - lo))), 6) AS scaled FROM lineitem, q""",
)
def quantile_scale(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    q = exact_quantiles(li, [], ["l_extendedprice"], (0.05, 0.95))
    lo, hi = (F.lit(v) for v in q.first())
    return li.select("l_orderkey", "l_linenumber", "l_partkey", r6(L.quantile_scaled(F.col("l_extendedprice"), lo, hi, True)).alias("scaled"))


@query(
    "complete_cases",
    f"WITH {LABELED_SQL} SELECT event_id, dataset_id FROM fam WHERE target IS NOT NULL AND stress IS NOT NULL AND aux_state_label IS NOT NULL",
)
def complete_cases(spark, sf):
    return labeled_rows(spark, sf).na.drop(subset=["target_pain_nrs_0_10", "target_stress_binary", "aux_state_label"]).select("event_id", "dataset_id")


@query("scan_pruned", "SELECT l_returnflag, round(sum(l_quantity), 6) AS qty FROM lineitem GROUP BY l_returnflag")
def scan_pruned(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.sum("l_quantity")).alias("qty"))


@query(
    "scan_filtered",
    "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000",
)
def scan_filtered(spark, sf):
    return rounded(table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000)).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
