"""Documents to results to scores, end to end."""

import json
import math

import pytest
from pyspark.sql import functions as F

from kinespark import pipeline
from kinespark.operators import scoring

META = "Index int, Prompt_ID string, Video_File string, Module string, Metric string, Tracking_Objects string, Num_Objects int, View string, Motion_Axis string, Scale_Mode string, Calibration_Value_m double, Target_Type string, Target_Value double, Target_Unit string, Known_Parameters_JSON string"


def square(step, valid=lambda f: True):
    """30 frames of a square of 10 pixels that moves by so many a frame."""
    frames = []
    for f in range(30):
        x = 20 + step * f
        frames.append({"frame_idx": f, "time_sec": f / 30, "object_id": 1, "valid": valid(f), "x": x + 4.5, "y": 24.5, "centroid": [x + 4.5, 24.5], "bbox": [x, 20, x + 9, 29], "area": 100})
    return json.dumps({"video_info": {"fps": 30, "total_frames": 30}, "object_id": 1, "frames": frames})


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, p, f"{p}.mp4", "B1", "velocity", "object_center", 1, "side", "x", "object_diameter", 0.1, "target_speed", 0.3, "m/s", params) for i, (p, params) in enumerate([("V001", None), ("V002", '{"g": 9.8}'), ("V003", ""), ("V004", "no json"), ("V005", None)])]
    docs = [("V001", square(1)), ("V002", square(0)), ("V003", square(1, lambda f: f < 5)), ("V005", "[]")]
    return spark.createDataFrame(rows, META), spark.createDataFrame(docs, "video string, text string")


def test_documents_to_results(tables):
    got = {r.prompt_id: r for r in pipeline.evaluate(*tables).collect()}
    first = got["V001"]
    assert math.isclose(first.measured, 0.26586807763582726, rel_tol=1e-12) and (first.status, first.tracking, first.mask_status) == ("valid", "pass", "pass")
    assert math.isclose(first.rel_error, abs(first.measured - 0.3) / 0.3) and first.actual_objects == 1
    assert got["V002"].tracking_reasons == "no_meaningful_motion" and got["V003"].tracking_reasons == "no_counted_object;object_count_mismatch"
    assert got["V004"].tracking_reasons == "tracking_json_missing" and got["V004"].failure_reason == "tracking_missing"
    assert got["V005"].tracking_reasons == "tracking_frames_missing" and got["V005"].status == "failed" and len(got) == 5
    skipped = {r.prompt_id: r for r in pipeline.evaluate(*tables, unstable="skip").collect()}
    assert skipped["V001"].status == "valid" and skipped["V003"].failure_reason in ("mask_area_unstable", got["V003"].failure_reason)


def test_results_to_reports(spark, tables, tmp_path):
    meta, docs = tables
    results = pipeline.evaluate(meta, docs).withColumn("model", F.lit("m"))
    scored = {r.prompt_id: r for r in pipeline.score(results, meta).collect()}
    want = 100 * math.exp(-scored["V001"].rel_error / 0.30)
    assert math.isclose(scored["V001"].adjusted_score, want, rel_tol=1e-9) and scored["V002"].adjusted_score == 0
    pipeline.report(pipeline.score(results, meta), str(tmp_path / "out"))
    metric = spark.read.option("header", True).csv(str(tmp_path / "out/metric_scores")).first()
    assert metric.n_total == "5" and json.loads(metric.status_counts) == {"failed": 2, "valid": 3} and json.loads(metric.discard_overlap_counts)["tracking_only"] == 2
    model = spark.read.json(str(tmp_path / "out/score_summary")).first()
    assert model.n_total == 5 and math.isclose(model.overall_effective_score, want, rel_tol=1e-9)
    with pytest.raises(scoring.IncompleteResults):
        pipeline.score(results.filter("prompt_id <> 'V002'"), meta)
    told = {(r.problem, r.id) for r in pipeline.refusal(results.filter("prompt_id <> 'V002'"), meta, str(tmp_path / "no")).collect()}
    assert told == {("missing", "V002")}
