"""Fixed vocabulary of the measurement stream: columns, sensor blocks, label sets, feature sets."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# Column names, sensor blocks and vocabularies that must match existing data.
# ---------------------------------------------------------------------------------------------

SENSOR_BLOCKS: dict[str, tuple[str, ...]] = {
    "bvp": ("bvp",),
    "bvp_rb": ("bvp_rb",),
    "eda": ("eda",),
    "eda_rb": ("eda_rb",),
    "temperature": ("temperature",),
    "acc": ("acc_x", "acc_y", "acc_z"),
    "hr": ("hr",),
    "ibi": ("ibi",),
    "ecg": ("ecg",),
    "respiration": ("respiration",),
    "emg": ("emg",),
    "grip": ("grip",),
    "steps": ("steps",),
    "spo2": ("spo2",),
}

CONTEXT_TEXT = (
    "condition",
    "label_family",
    "pain_type",
    "device",
    "cohort",
    "record_type",
    "baseline_pair_session_id",
    "pain_protocol_kind",
    "aux_state_label",
    "survey_gender",
    "survey_pain_type",
    "workbook_sex",
    "workbook_diagnosis",
    "workbook_exercise_duration_text",
    "wesad_protocol_segment",
)
CONTEXT_NUMERIC = (
    "target_stress_binary",
    "target_stress_score_0_10",
    "target_stress_score_mean_0_10",
    "survey_age",
    "survey_sleep_hours_avg",
    "survey_sleep_hours_before_test",
    "survey_daily_stress_ordinal",
    "survey_chronic_pain_flag",
    "survey_regular_medication_flag",
    "survey_pain_context_score",
    "workbook_age",
    "workbook_pain_rest",
    "workbook_pain_exercise",
    "wesad_protocol_start_s",
    "wesad_protocol_end_s",
)
CONTEXT_COLUMNS = CONTEXT_TEXT + CONTEXT_NUMERIC

IDENTITY_TEXT = ("dataset_id", "source_archive", "source_member", "subject_id", "session_id")
EEG_COLUMNS = (
    "eeg_delta", "eeg_theta", "eeg_alpha1", "eeg_alpha2", "eeg_beta1", "eeg_beta2",
    "eeg_gamma1", "eeg_gamma2", "eeg_attention", "eeg_meditation",
)
SENSOR_COLUMNS = (
    "bvp", "bvp_rb", "eda", "eda_rb", "temperature", "acc_x", "acc_y", "acc_z", "hr", "ibi", "ecg",
    "respiration", "emg", "grip", "steps", "spo2",
)

WINDOW_PREFERRED_ORDER = (
    "dataset_id", "subject_id", "session_id", "condition", "label_family", "pain_type", "device",
    "cohort", "record_type", "baseline_pair_session_id", "pain_protocol_kind", "aux_state_label",
)

DIRECT_PAIN_DATASETS = ("painmonit", "painmonit_pmed", "rheumapain", "physiopain_watch", "multimodal_pain_watch", "silver_pain")
STRESS_PROXY_DATASETS = ("stress_reference_real", "stress_reference_synthetic", "merged_wearable_stress", "wesad", "wesad_respiban")
EMOTION_PROXY_DATASETS = ("epm_e4",)
ACTIVITY_CONTEXT_DATASETS = ("induced_stress_exercise", "wearable_sports_health")
EEG_DATASETS = ("physiopain_eeg", "multimodal_pain_eeg")
COGNITIVE_TASK_DATASETS = ("catsa",)
BASELINE_TERMS = ("baseline", "rest", "resting", "neutral", "no_pain", "nopain", "no pain")
COGNITIVE_TERMS = ("logic", "stroop", "sudoku")
EXERCISE_TERMS = ("exercise", "aerobic", "anaerobic", "active")
ANCHOR_PAIN_DATASETS = ("painmonit", "painmonit_pmed", "physiopain_watch", "rheumapain", "silver_pain")

SENSOR_PREFIXES: dict[str, tuple[str, ...]] = {
    "bvp": ("bvp__",),
    "bvp_rb": ("bvp_rb__",),
    "hr": ("hr__",),
    "ibi": ("ibi__",),
    "ecg": ("ecg__",),
    "eda": ("eda__",),
    "eda_rb": ("eda_rb__",),
    "temperature": ("temperature__",),
    "acc": ("acc_x__", "acc_y__", "acc_z__", "acc__"),
    "gyro": ("gyro_x__", "gyro_y__", "gyro_z__", "gyro__"),
    "respiration": ("respiration__",),
    "emg": ("emg__",),
    "grip": ("grip__",),
    "bp": ("bp_systolic__", "bp_diastolic__"),
    "spo2": ("spo2__",),
    "steps": ("steps__",),
}
FEATURE_SETS: dict[str, dict] = {
    "apple_watch_like": {"sensors": ("acc", "gyro", "bvp", "hr", "ibi", "ecg", "temperature", "spo2"), "metadata": False},
    "e4_like": {"sensors": ("acc", "bvp", "eda", "temperature", "hr", "ibi"), "metadata": False},
    "autonomic_core": {"sensors": ("bvp", "hr", "ibi", "ecg", "eda", "temperature", "respiration"), "metadata": False},
    "motion_only": {"sensors": ("acc", "gyro", "steps"), "metadata": False},
    "metadata_probe": {"sensors": (), "metadata": True},
}
ID_COLUMNS = (
    "subject_id", "session_id", "phase3_eval_group", "phase3_window_id", "baseline_anchor_id", "original_all_window_id",
)
LEAKY_COLUMNS = ("window_start_s", "window_end_s", "source_archive", "source_member", "source_table", "phase3_source_table")
METADATA_COLUMNS = (
    "dataset_id", "source_family", "collection_protocol", "label_family", "pain_label_regime", "condition", "record_type",
    "device", "diagnosis", "sex", "age", "pain_scale_type", "source_modality", "source_dataset", "aux_state_label",
    "aux_stress_label", "proxy_label", "pain_type", "activity_status", "window_sampling",
)
STATE_COLUMNS = (
    "baseline_candidate", "baseline_anchor_available", "baseline_feature_count", "baseline_abs_delta_mean",
    "baseline_abs_delta_max", "baseline_l2_delta", "baseline_state_bin", "state_cluster_id", "baseline_missing",
    "baseline_distance_l1", "baseline_profile_available", "baseline_profile_quality_0_1",
)
DEFAULT_EXPECTED_BLOCKS = ("hr", "acc", "gyro", "temperature", "spo2", "bvp", "eda", "ibi")

PROFILE_PREFIXES: dict[str, tuple[str, ...]] = {
    "native_full": (),
    "watch_core": ("hr__", "ibi__", "acc_", "acc__", "temperature__", "spo2__"),
    "watch_plus_eda": ("hr__", "ibi__", "acc_", "acc__", "temperature__", "spo2__", "eda__"),
    "watch_plus_respiration": ("hr__", "ibi__", "acc_", "acc__", "temperature__", "spo2__", "respiration__"),
    "chest_reference": (
        "ecg__", "ibi__", "hr__", "respiration__", "eda__", "acc_", "acc__", "temperature__", "emg__",
    ),
}
ARM_PREFIXES: dict[str, tuple[str, ...]] = {
    "autonomic_space": ("hr__", "ibi__", "eda__", "temperature__", "respiration__", "acc_", "acc__", "bvp__"),
    "stress_ensemble": ("hr__", "eda__"),
    "wesad_multimodal": ("bvp__", "eda__", "hr__", "ibi__", "temperature__", "acc_", "acc__", "respiration__"),
    "cvxeda_proxy": ("eda__",),
    "hrv_biofeedback": ("ibi__", "hr__", "respiration__"),
    "multimodal_pain": (
        "bvp__", "eda__", "hr__", "ibi__", "temperature__", "acc_", "acc__", "respiration__", "ecg__", "emg__",
    ),
}
ALLOWED_SUFFIXES = (
    "__base__mean", "__base__std", "__base__min", "__base__max", "__base__last",
    "__shape__median", "__shape__mad", "__shape__iqr", "__shape__late_minus_early_z", "__shape__last_minus_first_z",
    "__shape__mean_abs_diff_z", "__shape__std_diff_z", "__shape__autocorr_05s", "__shape__autocorr_1s",
    "__shape__autocorr_2s", "__shape__dominant_frequency", "__shape__spectral_entropy", "__shape__low_band_power",
    "__shape__mid_band_power", "__shape__high_band_power",
)
COUPLING_PAIRS = (
    ("hr", "eda"), ("bvp", "eda"), ("hr", "respiration"), ("eda", "temperature"),
    ("hr", "acc_mag"), ("eda", "acc_mag"), ("bvp", "acc_mag"),
)
TEMPORAL_FEATURE_NAMES = (
    "late_minus_early_z", "last_minus_first_z", "max_time_fraction", "min_time_fraction", "mean_abs_diff_z",
    "std_diff_z", "max_abs_diff_z", "second_diff_energy", "median_crossings", "longest_above_median_frac",
    "longest_below_median_frac", "autocorr_025s", "autocorr_05s", "autocorr_1s", "autocorr_2s",
    "dominant_frequency", "spectral_centroid", "spectral_entropy", "low_band_power", "mid_band_power",
    "high_band_power", "wavelet_energy_0", "wavelet_energy_1", "wavelet_energy_2", "wavelet_energy_3",
)
SHAPE_SENSORS = (
    "bvp", "eda", "temperature", "hr", "ibi", "ecg", "respiration", "emg", "grip", "acc_x", "acc_y", "acc_z",
)
HEALTH_RECORD_TYPES = (
    "HKQuantityTypeIdentifierHeartRate",
    "HKQuantityTypeIdentifierRestingHeartRate",
    "HKQuantityTypeIdentifierWalkingHeartRateAverage",
    "HKQuantityTypeIdentifierHeartRateVariabilitySDNN",
    "HKQuantityTypeIdentifierRespiratoryRate",
    "HKQuantityTypeIdentifierOxygenSaturation",
    "HKQuantityTypeIdentifierVO2Max",
    "HKQuantityTypeIdentifierPhysicalEffort",
    "HKQuantityTypeIdentifierAppleExerciseTime",
    "HKQuantityTypeIdentifierAppleStandTime",
    "HKQuantityTypeIdentifierActiveEnergyBurned",
    "HKQuantityTypeIdentifierStepCount",
    "HKCategoryTypeIdentifierSleepAnalysis",
    "HKCategoryTypeIdentifierAppleStandHour",
    "HKCategoryTypeIdentifierMindfulSession",
)

# ---------------------------------------------------------------------------------------------


def _fields(names, dtype) -> list[T.StructField]:
    return [T.StructField(n, dtype) for n in names]


_S, _D = T.StringType(), T.DoubleType()

#: One row per sample. Text identity and context, double measurements, one bigint index.
MEASUREMENT_STREAM = T.StructType(
    _fields(IDENTITY_TEXT, _S)
    + [T.StructField("sample_index", T.LongType())]
    + _fields(("sample_offset_s", "sample_rate_hz", "source_sample_rate_hz"), _D)
    + _fields(CONTEXT_TEXT, _S)
    + _fields(("activity_status", "pain_label", "pain_scale_type"), _S)
    + _fields(CONTEXT_NUMERIC, _D)
    + _fields(SENSOR_COLUMNS, _D)
    + _fields(("heater_c", "systolic_bp", "diastolic_bp"), _D)
    + _fields(EEG_COLUMNS, _D)
    + _fields(("source_pain_covas_0_100", "target_pain_nrs_0_10", "pain_intensity", "target_pain_bin"), _D)
)

SUMMARY_STATS = ("mean", "std", "min", "max", "last", "slope_per_s")
