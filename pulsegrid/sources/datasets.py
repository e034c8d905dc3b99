"""Table-driven normalisation of the known source archives into the measurement stream.

Each source is a description (archive, member pattern, columns, constants); the differences that cannot be
a description are small column rules. All sources end in the same labelling and the same schema, so the
unified stream is one union of independent plans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid import schema as S
from pulsegrid.functions import text as X
from pulsegrid.functions.labels import add_common_labels
from pulsegrid.operators.align import apply_protocol, decimate, protocol_segments, relative_offset
from pulsegrid.operators.scale import running_index
from pulsegrid.sources.archives import archive_members, csv_columns, member_lines, tab_columns
from pulsegrid.sources.wearable import combine_sessions


@dataclass(frozen=True)
class CsvSource:
    """A source whose members are CSV files with a header."""

    dataset_id: str
    archive: str
    member: str
    sensors: dict[str, str]
    extra: tuple[str, ...] = ()
    nested: str | None = None
    sep: str = ","
    constants: dict = field(default_factory=dict)


# Archive names, member patterns, source column names and constants of every source.
E4_WATCH = {"bvp": "bvp", "eda": "eda", "acc_x": "x", "acc_y": "y", "acc_z": "z", "temperature": "temperature"}
EEG = {c: c.removeprefix("eeg_") for c in S.EEG_COLUMNS}
WATCH_MEMBER = r"PROCESSED WATCH DATA/combined/combined_all_data/all_watch_data_64hz\.csv$"
CSV_SOURCES = {
    s.dataset_id: s
    for s in (
        CsvSource("painmonit", "PainMonit Database.zip", r"(?i)(/raw-data/.*\.csv|_runup\.csv)$",
                  {"bvp": "bvp", "eda": "eda_e4", "temperature": "tmp", "respiration": "resp", "emg": "emg", "grip": "grip"},
                  ("seconds", "pain_rates", "pain_labels"), r"^PMCD\.zip$", ";",
                  {"device": "empatica_e4_respiratory_belt_emg_grip", "sample_rate_hz": 250.0, "pain_protocol_kind": "clinical", "pain_scale_type": "nrs_0_10"}),
        CsvSource("painmonit_pmed", "PainMonit Database.zip", r"-synchronised-data\.csv$",
                  {"bvp": "bvp", "eda": "eda_e4", "temperature": "tmp", "ibi": "ibi", "hr": "hr", "respiration": "resp", "ecg": "ecg", "emg": "emg",
                   "heater_c": "heater_c"}, ("seconds", "covas"), r"^PMED\.zip$", ";",
                  {"device": "empatica_e4_respiratory_belt_ecg_emg_heater", "sample_rate_hz": 250.0, "condition": "experimental_heat_pain",
                   "record_type": "heat_main", "pain_protocol_kind": "experimental_heat", "pain_scale_type": "covas_0_100_scaled_to_nrs_0_10"}),
        CsvSource("rheumapain", "RheumaPain Dataset.zip", r"/Processed Data/64Hz/.*\.csv$", E4_WATCH, ("person_id", "exercise_rest", "pain_scale"),
                  constants={"device": "empatica_e4", "sample_rate_hz": 64.0, "pain_scale_type": "wong_baker_source"}),
        CsvSource("physiopain_watch", "PhysioPain Dataset.zip", WATCH_MEMBER, E4_WATCH, ("person_id", "pain_type", "pain_scale"),
                  constants={"device": "processed_watch", "sample_rate_hz": 64.0, "pain_scale_type": "source_1_5"}),
        CsvSource("multimodal_pain_watch", "Multimodal Pain Dataset.zip", WATCH_MEMBER, E4_WATCH, ("person_id", "pain_type", "pain_scale"),
                  constants={"device": "processed_watch", "sample_rate_hz": 64.0, "pain_scale_type": "source_1_5"}),
        CsvSource("silver_pain", "SILVER-Pain Dataset.zip", r"/(older|young)_adults\.csv$",
                  {"bvp": "bvp", "eda": "eda", "temperature": "temperature", "hr": "hr"}, ("timestamp_ns", "segment", "painlevel", "trial", "subject"),
                  constants={"device": "empatica_like_merged", "pain_scale_type": "silver_source"}),
        CsvSource("wearable_sports_health", "Wearable Sports Health Monitoring Dataset.zip", r"\.csv$",
                  {"hr": "heart_rate", "temperature": "body_temperature", "spo2": "blood_oxygen", "steps": "step_count"},
                  ("athlete_id", "activity_status", "blood_pressure", "record_id"), constants={"device": "sports_health_csv"}),
        CsvSource("physiopain_eeg", "PhysioPain Dataset.zip", r"/PROCESSED EEG DATA/1Hz/[^/]+_1hz/S\d+\.csv$", EEG, ("person_id", "pain_version", "pain_intensity"),
                  constants={"device": "mindwave_eeg_processed", "sample_rate_hz": 1.0, "pain_scale_type": "source_1_5"}),
        CsvSource("multimodal_pain_eeg", "Multimodal Pain Dataset.zip", r"/PROCESSED EEG DATA/1Hz/[^/]+_1hz/S\d+\.csv$", EEG,
                  ("person_id", "pain_version", "pain_intensity"),
                  constants={"device": "mindwave_eeg_processed", "sample_rate_hz": 1.0, "pain_scale_type": "source_1_5"}),
    )
}
STRESS_ARCHIVE = "wearable-device-dataset-from-induced-stress-and-structured-exercise-sessions-1.0.1.zip"
RESPIBAN_COLUMNS = ["nseq", "digital", "ecg", "eda", "emg", "temperature", "acc_x", "acc_y", "acc_z", "respiration", "empty"]
STRESS_SCORES = ["target_stress_score_mean_0_10", "target_stress_score_0_10"]


def _members(spark: SparkSession, root: str, archive: str, pattern: str, nested: str | None = None) -> DataFrame:
    rows = archive_members(spark, root, nested).where((F.col("archive") == archive) & F.col("member").rlike(pattern))
    return rows.where(F.col("nested").rlike(nested) if nested else F.col("nested").isNull())


def conform(df: DataFrame) -> DataFrame:
    """Exactly the stream schema: missing columns NULL, known ones cast, unknown ones left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.MEASUREMENT_STREAM.fields])


def _finish(df: DataFrame, dataset_id: str, constants: dict) -> DataFrame:
    fixed = {k: F.lit(v) for k, v in constants.items() if k not in df.columns}
    out = df.withColumns({"dataset_id": F.lit(dataset_id), "source_archive": F.col("archive"), "source_member": F.col("member"), **fixed})
    if "target_pain_nrs_0_10" not in out.columns:
        out = out.withColumn("target_pain_nrs_0_10", F.lit(None).cast("double"))
    return conform(add_common_labels(out))


Rule = Callable[[DataFrame, dict], DataFrame]


def _clinical(df: DataFrame, side: dict) -> DataFrame:
    runup = F.lower("member").endswith("_runup.csv")
    keys = X.clinical_session_keys(F.regexp_replace("member", "(?i)_runup\\.csv$", ".csv"))
    rows = df.withColumns({"__runup": runup, "subject_id": keys["subject_id"], "baseline_pair_session_id": keys["session_id"]})
    return rows.withColumns(
        {
            "session_id": F.concat("baseline_pair_session_id", F.when(F.col("__runup"), "_runup").otherwise("")),
            "condition": F.when(F.col("__runup"), "clinical_runup_baseline").otherwise("clinical_physiotherapy"),
            "record_type": F.when(F.col("__runup"), "clinical_runup_baseline").otherwise("clinical_main"),
            "sample_offset_s": F.coalesce(X.clean_numeric("seconds"), F.col("sample_index") / 250.0),
            "target_pain_nrs_0_10": F.when(~F.col("__runup"), X.clean_numeric("pain_rates")),
            "pain_label": F.col("pain_labels"),
        }
    )


def _heat(df: DataFrame, side: dict) -> DataFrame:
    number = X.path_keys("member", "heat")["subject"]
    stem = F.regexp_extract("member", r"([^/]+)\.csv$", 1)
    rows = df.withColumns({"subject_id": F.coalesce(F.concat(F.lit("s"), number), stem), "source_pain_covas_0_100": X.clean_numeric("covas")})
    return rows.withColumns(
        {
            "session_id": F.concat("subject_id", F.lit("_heat")),
            "sample_offset_s": F.coalesce(X.clean_numeric("seconds"), F.col("sample_index") / 250.0),
            "target_pain_nrs_0_10": F.col("source_pain_covas_0_100") / 10.0,
        }
    )


def _rheuma(df: DataFrame, side: dict) -> DataFrame:
    stem = F.lower(F.regexp_extract("member", r"([^/]+)\.csv$", 1))
    rows = df.withColumns({"__file": stem, "subject_id": F.lower(F.coalesce("person_id", stem)), "condition": F.lower(F.coalesce("exercise_rest", F.lit("unknown")))})
    pain = X.clean_numeric("pain_scale")
    if "workbook" in side:
        rows = rows.join(side["workbook"].withColumnRenamed("subject_id", "__file"), "__file", "left")
        pain = F.coalesce(F.when(F.col("condition") == "rest", F.col("workbook_pain_rest")).when(F.col("condition") == "exercise", F.col("workbook_pain_exercise")), pain)
    return rows.withColumns({"session_id": F.concat_ws("_", "subject_id", "condition"), "sample_offset_s": F.col("sample_index") / 64.0, "target_pain_nrs_0_10": pain})


def _watch(df: DataFrame, side: dict) -> DataFrame:
    pain = X.clean_numeric("pain_scale")
    rows = df.withColumns({"subject_id": F.coalesce("person_id", F.lit("unknown")), "pain_type": F.coalesce("pain_type", F.lit("unknown")), "target_pain_nrs_0_10": pain})
    rows = rows.withColumns({"session_id": X.session_key("subject_id", "pain_type", "target_pain_nrs_0_10"), "condition": F.col("pain_type")})
    indexed = running_index(rows.withColumnRenamed("sample_index", "__line"), ["archive", "member", "session_id"], "__line", "sample_index")
    indexed = indexed.withColumn("sample_offset_s", F.col("sample_index") / 64.0)
    return indexed.join(side["survey"], "subject_id", "left") if "survey" in side else indexed


def _silver(df: DataFrame, side: dict) -> DataFrame:
    cohort = F.concat(F.regexp_extract("member", r"/(older|young)_adults\.csv$", 1), F.lit("_adults"))
    rows = df.withColumns({"cohort": cohort, "__s": F.coalesce("subject", F.lit("unknown")), "trial": F.coalesce("trial", F.lit("unknown")), "__ts": X.clean_numeric("timestamp_ns")})
    rows = rows.withColumn("__s", F.when(F.col("cohort") == "older_adults", X.zero_padded_id("__s")).otherwise(F.col("__s")))
    rows = rows.withColumns(
        {"subject_id": F.concat_ws("_", "cohort", "__s"), "session_id": F.concat(F.col("cohort"), F.lit("_"), F.col("__s"), F.lit("_trial_"), F.col("trial")),
         "condition": F.coalesce("segment", F.lit("unknown")), "target_pain_nrs_0_10": X.clean_numeric("painlevel")})
    return relative_offset(rows, ["session_id"], "__ts", ["sample_index"], 1e9, "sample_offset_s")


def _sports(df: DataFrame, side: dict) -> DataFrame:
    athlete = F.coalesce("athlete_id", F.lit("unknown"))
    status = F.lower(F.coalesce("activity_status", F.lit("unknown")))
    return df.withColumns(
        {"subject_id": athlete, "session_id": F.concat(athlete, F.lit("_sports_synthetic_like")), "condition": status, "activity_status": status,
         "sample_offset_s": F.col("sample_index") * 300.0, "systolic_bp": X.split_part_number("blood_pressure", 0), "diastolic_bp": X.split_part_number("blood_pressure", 1)}
    ).withColumn("sample_index", F.coalesce(X.clean_numeric("record_id").cast("long"), F.col("sample_index")))


def _eeg(df: DataFrame, side: dict) -> DataFrame:
    keys = X.path_keys("member", "eeg")
    rows = df.withColumns(
        {"subject_id": F.coalesce("person_id", keys["subject"]), "session_id": F.concat_ws("_", keys["subject"], keys["pain_type"], F.lit("eeg")), "condition": keys["pain_type"],
         "pain_type": F.coalesce("pain_version", keys["pain_type"]), "sample_offset_s": F.col("sample_index").cast("double"),
         "target_pain_nrs_0_10": X.clean_numeric("pain_intensity")}).drop("pain_intensity")
    return rows.join(side["survey"], "subject_id", "left") if "survey" in side else rows


RULES: dict[str, Rule] = {
    "painmonit": _clinical, "painmonit_pmed": _heat, "rheumapain": _rheuma, "physiopain_watch": _watch, "multimodal_pain_watch": _watch,
    "silver_pain": _silver, "wearable_sports_health": _sports, "physiopain_eeg": _eeg, "multimodal_pain_eeg": _eeg,
}


def normalize_csv(spark: SparkSession, root: str, dataset_id: str, side: dict) -> DataFrame:
    src = CSV_SOURCES[dataset_id]
    lines = member_lines(_members(spark, root, src.archive, src.member, src.nested))
    raw = csv_columns(lines, [*dict.fromkeys([*src.sensors.values(), *src.extra])], src.sep)
    # Sensor columns get their stream names under a prefix first: a rule may still need the raw columns.
    held = raw.withColumns({f"__v_{out}": X.clean_numeric(col) for out, col in src.sensors.items()})
    ruled = RULES[dataset_id](held, side)
    named = ruled.withColumns({out: F.col(f"__v_{out}") for out in src.sensors})
    return _finish(named, dataset_id, src.constants)


def _wrist(lines: DataFrame, keys: list[str], dataset_id: str, constants: dict[str, Column]) -> DataFrame:
    out = combine_sessions(lines, keys)
    cols = {"dataset_id": F.lit(dataset_id), "device": F.lit("empatica_e4"), "target_pain_nrs_0_10": F.lit(None).cast("double"), **constants}
    return out.withColumns(cols)


def normalize_task_wrist(spark: SparkSession, root: str, side: dict) -> DataFrame:
    """Cognitive-task sessions: one wrist file per sensor, context labels only."""
    k = X.path_keys("member", "task")
    lines = member_lines(_members(spark, root, "CATSA.zip", X.PATH_PATTERNS["task"][0])).withColumns(
        {"subject_id": F.lower(k["subject"]), "condition": F.lower(k["condition"]), "sensor": F.lower(k["sensor"])})
    keyed = lines.withColumn("session_id", F.concat_ws("_", "subject_id", "condition"))
    out = _wrist(keyed, ["subject_id", "session_id", "condition"], "catsa", {"source_archive": F.lit("CATSA.zip")})
    return conform(add_common_labels(out))


def normalize_activity_wrist(spark: SparkSession, root: str, side: dict) -> DataFrame:
    """Stress and exercise sessions: stress rows carry a binary label and the subject's scores."""
    k = X.path_keys("member", "activity")
    lines = member_lines(_members(spark, root, STRESS_ARCHIVE, X.PATH_PATTERNS["activity"][0])).withColumns(
        {"subject_id": F.lower(k["subject"]), "condition": F.lower(k["condition"]), "sensor": F.lower(k["sensor"])})
    keyed = lines.withColumn("session_id", F.concat_ws("_", "subject_id", "condition"))
    out = _wrist(keyed, ["subject_id", "session_id", "condition"], "induced_stress_exercise",
                 {"source_archive": F.lit(STRESS_ARCHIVE), "aux_state_label": F.col("condition")})
    stress = F.col("condition") == "stress"
    if "stress_scores" in side:
        out = out.join(side["stress_scores"], "subject_id", "left").withColumns({c: F.when(stress, F.col(c)) for c in STRESS_SCORES})
    return conform(add_common_labels(out.withColumn("target_stress_binary", F.when(stress, 1.0))))


def _protocols(spark: SparkSession, root: str) -> DataFrame:
    lines = member_lines(_members(spark, root, "WESAD.zip", r"WESAD/S\d+/S\d+_quest\.csv$"))
    keyed = lines.withColumn("subject_id", F.lower(F.regexp_extract("member", r"/(S\d+)_quest\.csv$", 1)))
    return protocol_segments(keyed, ["subject_id"])


def normalize_protocol_wrist(spark: SparkSession, root: str, side: dict) -> DataFrame:
    """Stress-protocol wrist sessions from inner archives, labelled by protocol segment."""
    nested = r"WESAD/S\d+/S\d+_E4_Data\.zip$"
    lines = member_lines(_members(spark, root, "WESAD.zip", r"^(ACC|BVP|EDA|HR|IBI|TEMP)\.csv$", nested)).withColumns(
        {"subject_id": F.lower(F.regexp_extract("nested", r"/(S\d+)_E4_Data", 1)), "sensor": F.lower(F.regexp_extract("member", r"^(\w+)\.csv$", 1))})
    keyed = lines.withColumn("session_id", F.concat("subject_id", F.lit("_e4_full")))
    out = _wrist(keyed, ["subject_id", "session_id"], "wesad", {"source_archive": F.lit("WESAD.zip"), "condition": F.lit("wesad_full_protocol")})
    return conform(add_common_labels(apply_protocol(out, _protocols(spark, root), ["subject_id"])))


def normalize_protocol_chest(spark: SparkSession, root: str, side: dict) -> DataFrame:
    """700 Hz chest sessions, every eleventh sample kept, labelled by protocol segment."""
    lines = member_lines(_members(spark, root, "WESAD.zip", r"WESAD/S\d+/S\d+_respiban\.txt$"))
    kept = decimate(tab_columns(lines, RESPIBAN_COLUMNS), "sample_index", 11)
    sensors = ("ecg", "eda", "emg", "temperature", "acc_x", "acc_y", "acc_z", "respiration")
    subject = F.lower(F.regexp_extract("member", r"/(S\d+)_respiban\.txt$", 1))
    rows = kept.withColumns(
        {"subject_id": subject, "session_id": F.concat(subject, F.lit("_respiban_full")), "sample_index": F.coalesce(X.clean_numeric("nseq").cast("long"), F.col("sample_index")),
         "condition": F.lit("wesad_full_protocol"), "source_sample_rate_hz": F.lit(700.0), "sample_rate_hz": F.lit(700.0 / 11.0), **{s: X.clean_numeric(s) for s in sensors}})
    rows = rows.withColumn("sample_offset_s", F.col("sample_index") / 700.0)
    return _finish(apply_protocol(rows, _protocols(spark, root), ["subject_id"]), "wesad_respiban", {"device": "respiban_chest"})


NORMALIZERS: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {
    **{d: (lambda spark, root, side, d=d: normalize_csv(spark, root, d, side)) for d in CSV_SOURCES},
    "catsa": normalize_task_wrist, "induced_stress_exercise": normalize_activity_wrist, "wesad": normalize_protocol_wrist,
    "wesad_respiban": normalize_protocol_chest,
}


def ingest(spark: SparkSession, root: str, dataset_ids: Iterable[str] | None = None, side: dict | None = None) -> DataFrame:
    """One measurement stream from the named datasets (all by default); side tables are optional frames."""
    ids = list(dataset_ids or NORMALIZERS)
    return reduce(DataFrame.unionByName, [NORMALIZERS[d](spark, root, side or {}) for d in ids])


def label_table(stream: DataFrame) -> DataFrame:
    """Per session: target range, number of labelled rows and sorted distinct target values."""
    keys = ["dataset_id", "subject_id", "session_id", "condition"]
    from pulsegrid.operators.aggregates import observed_values, session_target_summary
    from pulsegrid.operators.scale import null_safe_join

    t = "target_pain_nrs_0_10"
    return null_safe_join(session_target_summary(stream, keys, t), observed_values(stream, keys, t, "pain_values_observed"), keys)


def subject_table(stream: DataFrame) -> DataFrame:
    from pulsegrid.operators.align import dedupe_first

    cols = [c for c in stream.columns if c.startswith(("survey_", "workbook_"))] + ["cohort"]
    return dedupe_first(stream.select("dataset_id", "subject_id", *cols), ["dataset_id", "subject_id"], [F.col("cohort")])
