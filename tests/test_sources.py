import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.align import archetype_label
from pulsegrid.operators.windows import WindowSpec
from pulsegrid.sources import archives, datasets, sidetables, sinks, wearable


def write_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, text in members.items():
            zf.writestr(name, text)


def zip_bytes(members):
    buf = io.BytesIO()
    write_zip(buf, members)
    return buf.getvalue()


def test_inventory_skips_junk(spark, tmp_path):
    write_zip(tmp_path / "sample.zip", {"a.csv": "1", "folder/b.txt": "22", "__MACOSX/c.csv": "x", "folder/.DS_Store": "x", "._d.csv": "x"})
    totals, ext = archives.inventory(archives.archive_members(spark, str(tmp_path)))
    assert totals.first()["members"] == 2 and totals.first()["uncompressed_bytes"] == 3
    assert {r["extension"]: r["members"] for r in ext.collect()} == {".csv": 1, ".txt": 1}


def test_csv_of_any_width(spark, tmp_path):
    names = ",".join(f"c{i}" for i in range(70))
    rows = ",".join(str(i) for i in range(70)) + "\n" + ",".join(['"a, ""b"""', "", '"x"', *["y"] * 66, '""']) + "\nshort,1\n"
    write_zip(tmp_path / "wide.zip", {"w.csv": names + "\n" + rows, "t.csv": "c0;c1\n,1;2,5\n"})
    lines = archives.member_lines(archives.archive_members(spark, str(tmp_path)))
    got = archives.csv_columns(lines.where("member = 'w.csv'"), ["c0", "c1", "c2", "c69", "none"]).orderBy("sample_index").collect()
    assert [tuple(r)[4:] for r in got] == [("0", "1", "2", "69", None), ('a, "b"', None, "x", None, None), ("short", "1", None, None, None)]
    one = archives.csv_columns(lines.where("member = 't.csv'"), ["c0", "c1"], ";").first()
    assert one["c0"] == ",1" and one["c1"] == "2,5"


def test_last_side_row_wins(spark):
    titles = "n int, UID string, Age string, Gender string, Diagnosis string, `Pain Scale Rest` string, `Pain Scale Exercise` string, `Exercise Durations (seconds)` string"
    book = sidetables.clinical_workbook(spark.createDataFrame([(2, "p01", "61", None, "RA", "6", "8", "1"), (1, "P01", "60", "F", "RA", "6", "8", "1")], titles), "n").collect()
    assert [(r["subject_id"], r["workbook_age"], r["workbook_sex"]) for r in book] == [("p01", 61.0, None)]
    survey = sidetables.survey_metrics(spark.createDataFrame([("S1", "44"), ("S2", "30"), ("S1", "45")], "id string, Age string").coalesce(1)).collect()
    assert {r["subject_id"]: r["survey_age"] for r in survey} == {"S1": 45.0, "S2": 30.0}


def test_wrist_tolerance_is_the_sessions_own(spark):
    def session(name, rate):
        bvp = [(name, "bvp", i, str(float(i)), ["0", "64"]) for i in range(2, 258)]
        return bvp + [(name, "eda", i, str(float(i)), ["0", str(rate)]) for i in range(2, 2 + 4 * rate)]

    schema = "session_id string, sensor string, line_no long, value string, head array<string>"
    slow, both = session("slow", 1), session("slow", 1) + session("fast", 4)
    alone = wearable.combine_sessions(spark.createDataFrame(slow, schema), ["session_id"]).where("eda IS NOT NULL").count()
    beside = wearable.combine_sessions(spark.createDataFrame(both, schema), ["session_id"]).where("eda IS NOT NULL AND session_id = 'slow'").count()
    assert alone == beside > 200


def test_streams_are_found_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 1), ("c", 2)], "dataset_id string, sample_index long")
    sinks.write_stream(rows, str(tmp_path / "x/measurement_stream.parquet"))
    rows.where("sample_index = 2").coalesce(1).write.parquet(str(tmp_path / "y/measurement_stream.parquet"))
    rows.write.parquet(str(tmp_path / "y/labels"))
    got = sinks.discover_streams(spark, str(tmp_path)).select("dataset_id", "sample_index").collect()
    assert sorted(map(tuple, got)) == [("a b", 1), ("c", 2), ("c", 2)]


def test_watch_source(spark, tmp_path):
    csv = "﻿BVP,EDA,X,Y,Z,Temperature,Pain Scale,Pain Type,Person ID\n1,2,0.1,0.2,0.3,33,3,head,S1\n1.5,2.5,0.1,0.2,0.3,33,3,head,S1\n9,9,0,0,0,33,,head,S1\n"
    write_zip(tmp_path / "PhysioPain Dataset.zip", {"PROCESSED WATCH DATA/combined/combined_all_data/all_watch_data_64hz.csv": csv})
    survey = sidetables.survey_metrics(spark.createDataFrame(
        [("S1", "44", "moderate", "Evet", "2", "high")],
        "id string, Age string, `What do you think about your stress level in your daily life?` string, `Do you have any chronic pain conditions?` string, `Rate the severity of your pain (a)` string, `Rate the severity of your pain (b)` string"))
    rows = datasets.ingest(spark, str(tmp_path), ["physiopain_watch"], {"survey": survey}).orderBy("session_id", "sample_index").collect()
    assert [r["sample_offset_s"] for r in rows] == [0.0, 1 / 64, 0.0]
    assert [r["label_family"] for r in rows] == ["direct_pain", "direct_pain", "unlabeled"]
    assert rows[2]["session_id"] == "S1_head_scale_unknown" and rows[0]["survey_pain_context_score"] == 3.0 and rows[0]["survey_chronic_pain_flag"] == 1.0


def test_heat_source_in_nested_archive(spark, tmp_path):
    csv = "Seconds;COVAS;Bvp;EDA_E4\n0,0;0;1,5;2\n0,004;50;NaN;2,5\n0,008;100;1;3\n"
    write_zip(tmp_path / "PainMonit Database.zip", {"PMED.zip": zip_bytes({"d/S_07-synchronised-data.csv": csv}), "PMCD.zip": zip_bytes({
        "PMCD/raw-data/P3_1/P3_1.csv": "Seconds;Pain_rates;BVP\n0,0;4;1\n0,5;;2\n", "PMCD/raw-data/P3_1/P3_1_runUp.csv": "Seconds;Pain_rates;BVP\n0,0;9;1\n"})})
    heat = datasets.ingest(spark, str(tmp_path), ["painmonit_pmed"]).orderBy("sample_index").collect()
    assert [r["target_pain_nrs_0_10"] for r in heat] == [0.0, 5.0, 10.0] and heat[1]["source_pain_covas_0_100"] == 50.0
    assert heat[0]["subject_id"] == "s07" and heat[1]["bvp"] is None and heat[1]["sample_offset_s"] == pytest.approx(0.004)
    clinical = datasets.ingest(spark, str(tmp_path), ["painmonit"]).orderBy("session_id", "sample_index").collect()
    assert [r["session_id"] for r in clinical] == ["p3_1", "p3_1", "p3_1_runup"]
    assert clinical[2]["target_pain_nrs_0_10"] is None and clinical[2]["baseline_pair_session_id"] == "p3_1"


def test_cohort_source(spark, tmp_path):
    head = "timestamp_ns,datetime_utc,segment,bvp,eda,temperature,hr,section,PainLevel,Trial,subject\n"
    write_zip(tmp_path / "SILVER-Pain Dataset.zip", {
        "d/older_adults.csv": head + "1000000000,x,base,1,2,33,70,a,0,1,7.0\n3000000000,x,base,1,2,33,70,a,5,1,7.0\n", "d/young_adults.csv": head + "5,x,,1,2,33,70,a,,1,9\n"})
    rows = datasets.ingest(spark, str(tmp_path), ["silver_pain"]).orderBy("subject_id", "sample_index").collect()
    assert [r["subject_id"] for r in rows] == ["older_adults_007", "older_adults_007", "young_adults_9"]
    assert [r["sample_offset_s"] for r in rows] == [0.0, 2.0, 0.0] and rows[0]["target_pain_bin"] == 0.0


E4 = {
    "ACC.csv": "0,0,0\n32,32,32\n" + "\n".join(f"{i},0,1" for i in range(96)), "BVP.csv": "0\n64\n" + "\n".join(str(float(i)) for i in range(192)),
    "EDA.csv": "0\n4\n" + "\n".join(str(i / 10) for i in range(12)), "TEMP.csv": "0\n4\n33\n", "HR.csv": "0\n0\n70\n71\n72\n", "IBI.csv": "0,IBI\n0.5,0.8\n1.51,0.82\n",
}


def test_wrist_sources(spark, tmp_path):
    write_zip(tmp_path / "CATSA.zip", {f"CATSA/Sub1/baseline/{n}": t for n, t in E4.items() if n != "IBI.csv"})
    rows = datasets.ingest(spark, str(tmp_path), ["catsa"]).orderBy("sample_index").collect()
    assert len(rows) == 192 and rows[0]["label_family"] == "baseline_context" and rows[0]["target_pain_nrs_0_10"] is None
    assert rows[1]["acc_x"] == 0.0 and rows[64]["acc_x"] == 32.0 and rows[100]["hr"] == 72.0 and rows[16]["eda"] == 0.1 and rows[8]["eda"] == 0.0
    quest = "# ID;S2\n# ORDER;Base;TSST;;\n# START;0;0.02;;\n# END;0.02;1;\n"
    inner = zip_bytes(E4)
    resp = "h1\nh2\nh3\n" + "\n".join("\t".join([str(i), "0", *[str(i + j) for j in range(8)], ""]) for i in range(45)) + "\n"
    write_zip(tmp_path / "WESAD.zip", {"WESAD/S2/S2_E4_Data.zip": inner, "WESAD/S2/S2_quest.csv": quest, "WESAD/S2/S2_respiban.txt": resp})
    both = datasets.ingest(spark, str(tmp_path), ["wesad", "wesad_respiban"]).cache()
    w = both.where("dataset_id = 'wesad'").orderBy("sample_index").collect()
    assert len(w) == 192 and w[32]["ibi"] == 0.8 and w[31]["ibi"] is None and w[97]["ibi"] == 0.82
    assert w[0]["wesad_protocol_segment"] == "base" and w[191]["aux_state_label"] == "tsst_stress" and w[191]["label_family"] == "stress_proxy"
    r = both.where("dataset_id = 'wesad_respiban'").orderBy("sample_index").collect()
    assert [x["sample_index"] for x in r] == [0, 11, 22, 33, 44] and r[1]["ecg"] == 11.0 and r[1]["sample_offset_s"] == pytest.approx(11 / 700)


def test_other_sources_and_sinks(spark, tmp_path):
    write_zip(tmp_path / "RheumaPain Dataset.zip", {"R/Processed Data/64Hz/P01.csv": "BVP,EDA,X,Y,Z,Temperature,person_id,exercise_rest,pain_scale\n1,2,0,0,1,33,P01,Rest,2\n1,2,0,0,1,33,P01,Rest,2\n"})
    book = sidetables.clinical_workbook(spark.createDataFrame([("P01", "60", "F", "RA", "6", "8", "120")], "UID string, Age string, Gender string, Diagnosis string, `Pain Scale Rest` string, `Pain Scale Exercise` string, `Exercise Durations (seconds)` string"))
    write_zip(tmp_path / "Wearable Sports Health Monitoring Dataset.zip", {"x.csv": "Record_ID,Athlete_ID,Activity_Status,Blood_Pressure,Heart_Rate,Body_Temperature,Blood_Oxygen,Step_Count\n1,A1,Running,120/80,90,36,98,100\n2,A1,Rest,110,91,36,97,101\n"})
    write_zip(tmp_path / "Multimodal Pain Dataset.zip", {"M/PROCESSED EEG DATA/1Hz/back_1hz/S3.csv": "person_id,pain_version,pain_intensity,delta,theta\nS3,v1,2,5,6\n"})
    prefix = "p/Wearable_Dataset/"
    write_zip(tmp_path / datasets.STRESS_ARCHIVE, {f"{prefix}{a}/S01/{n}": t for a in ("STRESS", "AEROBIC") for n, t in E4.items()})
    scores = sidetables.score_matrix(spark.createDataFrame([("S01", "3", "5"), ("S02", "x", None)], "subject string, a string, b string"), "subject")
    side = {"workbook": book, "stress_scores": scores}
    s = datasets.ingest(spark, str(tmp_path), ["rheumapain", "wearable_sports_health", "multimodal_pain_eeg", "induced_stress_exercise"], side).cache()
    by = {r["dataset_id"]: r for r in s.orderBy("sample_index").collect() if r["sample_index"] in (0, 1)}
    assert by["rheumapain"]["target_pain_nrs_0_10"] == 6.0 and by["rheumapain"]["session_id"] == "p01_rest" and by["rheumapain"]["workbook_sex"] == "F"
    assert s.where("dataset_id = 'wearable_sports_health' AND systolic_bp = 120 AND diastolic_bp = 80 AND label_family = 'exercise_context'").count() == 1
    assert by["multimodal_pain_eeg"]["eeg_delta"] == 5.0 and by["multimodal_pain_eeg"]["label_family"] == "pain_context_unlabeled"
    stress = s.where("condition = 'stress'").first()
    assert stress["target_stress_score_mean_0_10"] == 4.0 and stress["target_stress_binary"] == 1.0
    assert s.where("condition = 'aerobic' AND target_stress_binary IS NULL AND label_family = 'exercise_context'").count() == 192
    out = str(tmp_path / "out")
    sinks.write_stream(s, out + "/stream")
    m = {(r["dataset_id"], r["output_kind"]): r["rows"] for r in sinks.finalize(spark, out + "/stream", out).collect()}
    assert m[("rheumapain", "measurement_stream")] == 2 and m[("rheumapain", "subjects")] == 1
    assert spark.read.parquet(out + "/labels").where("dataset_id = 'rheumapain'").first()["pain_values_observed"] == [6.0]
    with pytest.raises(ValueError):
        sinks.write_stream(s.withColumn("late_column", F.lit(1)), out + "/bad")
    summary = sinks.build_window_table(spark.read.parquet(out + "/stream"), out + "/windows", WindowSpec(window_seconds=2.0)).collect()
    assert {r["dataset_id"]: r["window_rows"] for r in summary}["induced_stress_exercise"] == 2
    sinks.export_csv(spark.read.parquet(out + "/labels"), out + "/csv")
    assert spark.read.option("header", True).csv(out + "/csv").count() == 6  # one sports session has two conditions


def test_health_export(spark, tmp_path):
    rec = '<Record type="HKQuantityTypeIdentifierHeartRate" sourceName="w" unit="c" startDate="2024-01-01 10:0{}:30 +0000" endDate="2024-01-01 10:0{}:31 +0000" value="{}"/>'
    xml = "<HealthData>" + "".join(rec.format(i, i, 60 + i) for i in range(4)) + """<Record type="HKCategoryTypeIdentifierSleepAnalysis" startDate="2024-01-01 10:01:10 +0000"
        endDate="2024-01-01 10:01:50 +0000" value="HKCategoryValueSleepAnalysisAsleepCore"/><Record type="Other" value="1"/>
        <Workout workoutActivityType="Run" duration="1.5" startDate="2024-01-01 12:03:00 +0200" endDate="2024-01-01 12:03:00 +0200"/></HealthData>"""
    path = str(tmp_path / "export.xml")
    with open(path, "w") as f:
        f.write(xml)
    records, workouts = wearable.health_records(spark, path), wearable.health_workouts(spark, path)
    assert {r["type"]: r["rows"] for r in wearable.health_type_counts(spark, path).collect()}["Other"] == 1
    iv = wearable.interval_kinds(records, workouts).withColumn("person", F.lit(1))
    hr = records.where("type LIKE '%HeartRate'").withColumn("person", F.lit(1))
    got = [r["archetype"] for r in archetype_label(hr, iv, ["person"], "start_dt", "start_dt", "end_dt", "kind").orderBy("start_dt").collect()]
    assert got == ["awake_nonworkout", "sleep", "sleep", "workout_or_exercise"]
