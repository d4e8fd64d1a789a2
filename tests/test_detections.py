"""Detector output, overrides, listings and mask series against plain versions."""

import json

import numpy as np
import controls
import pytest
from pyspark.sql import functions as F

from kinespark.operators import detections
from kinespark.sources import metadata, overrides, tracking
from test_sources import png


def test_scan_frames_are_numpy_s(spark):
    rows = [(n, f) for n in (1, 2, 5, 7, 29, 50) for f in range(n)]
    frames = spark.createDataFrame(rows, "video int, frame int")
    for k in (1, 4, 7):
        got = {}
        for r in detections.scan_frames(frames, ["video"], k).collect():
            got.setdefault(r.video, []).append(r.frame)
        assert {n: sorted(f) for n, f in got.items()} == {n: sorted(set(np.linspace(0, n - 1, min(max(2, k), n), dtype=int).tolist())) for n in (1, 2, 5, 7, 29, 50)}
    with pytest.raises(ValueError):
        detections.scan_frames(frames, ["video"], 3, "end")


def test_classes(spark):
    rows = [("0", "person", "a Person", None), ("1", "dog", "person", None), ("2", "dog", "red ball", None), ("32", "sports ball", "steel-sphere", None), ("5", "toy car", "car_standard", None), ("6", "cat", "car", None), ("7", "cat", "solid object", None), ("8", "cat", None, " Dog, 8"), ("9", "cat", None, "dog"), ("9", "cat", "", " , ")]
    df = spark.createDataFrame(rows, "id string, name string, hint string, classes string")
    got = [r.ok for r in df.select(detections.class_allowed("id", "name", "hint", "classes").alias("ok")).collect()]
    assert got == [True, False, False, True, True, False, True, True, False, True]
    like = df.select(detections.hint_like("hint", detections.BALL_LIKE).alias("ball")).collect()
    assert [r.ball for r in like] == [False, False, True, True, True, False, False, False, False, False]


def test_penalties_and_regions(spark):
    df = spark.createDataFrame([(90.0, 100.0, 100.0, 1.0, 0.9), (10.0, 60.0, 100.0, 4.0, 0.2), (30.0, 40.0, 100.0, 3.5, 0.8), (5.0, 6.0, 0.0, 1.0, 1.0), (None, 6.0, 10.0, 1.0, 1.0)], "a double, b double, r double, s double, f double")
    got = [r.p for r in df.select(detections.spread_penalty("a", "b", "r", "s", "f").alias("p")).collect()]
    assert got[:4] == pytest.approx([0.85, 0.35, 0.25, 0.0])
    low = spark.createDataFrame([(50.0, 100.0, 9.0, 5.0), (50.0, 100.0, 3.0, 5.0), (55.0, 100.0, 9.0, 5.0)], "s double, v double, y double, seed double")
    assert [r.p for r in low.select(detections.reflection_penalty("s", "v", "y", "seed").alias("p")).collect()] == [0.35, 0.0, 0.0]
    regions = spark.createDataFrame([(50.0, 10, 10), (50.0, 1, 60), (5.0, 10, 10), (50.0, 50, 2), (20.0, 10, 10)], "area double, w int, h int")
    assert [(r.area, r.w) for r in detections.motion_candidates(regions, 10, 90, 0.3, 8).collect()] == [(50.0, 10)]


def test_first_eligible_and_pass(spark):
    rows = [("a", 0, 50, 0, 5, 9, 9), ("a", 3, 50, 4, 5, 13, 9), ("a", 2, 2, 4, 5, 5, 5), ("a", 5, 50, 4, 5, 13, 9), ("b", 0, 1, 0, 0, 0, 0)]
    shapes = spark.createDataFrame(rows, "video string, frame int, area int, x1 int, y1 int, x2 int, y2 int").withColumns({"cx": F.col("x1"), "cy": F.col("y1"), "image_w": F.lit(16), "image_h": F.lit(12)})
    got = detections.first_eligible(shapes, min_area=10, min_side=3, min_margin=1, padding=6).collect()
    assert [tuple(r) for r in got] == [("a", 3, 4, 5, 0, 0, 15, 11)]
    both = spark.createDataFrame([("a", 0, 1, 1), ("a", 1, 1, 0), ("a", 1, 2, 0), ("a", 1, 1, 1)], "video string, frame int, object int, pass int")
    assert sorted((r.frame, r.object, r["pass"]) for r in detections.first_pass(both, ["video"]).collect()) == [(0, 1, 1), (1, 1, 0), (1, 2, 0)]


def test_overrides(spark):
    texts = {
        "good": {"num_objects": "2", "threshold": 3, "yolo_conf": 0.5, "object_refine": 1, "scan_mode": "middle", "yolo_classes": None, "detector": "yolo_then_motion"},
        "bad": {"num_objects": True, "threshold": 0, "yolo_conf": "nan", "object_refine": 2, "scan_mode": "end", "yolo_classes": 5, "detector": "motion", "x": 1},
        "twice": {"min_area": 4, "auto_init_min_area": 4}, "list": [1], "none": None, "empty": {},
    }
    rows = [(k, json.dumps(v), None) for k, v in texts.items()] + [("broken", "{", None), ("null", None, None), ("known", "", json.dumps({"tracking_overrides": {"box_expand": 1.5}, "object": "None", "target_object": "cube"}))]
    df = overrides.tracking_overrides(spark.createDataFrame(rows, "id string, Tracking_Overrides_JSON string, Known_Parameters_JSON string"))
    got = {r.id: r for r in df.collect()}
    assert got["good"].overrides == {"num_objects": "2", "auto_init_threshold": "3.0", "yolo_conf": "0.5", "auto_init_object_refine": "true", "auto_init_scan_mode": "middle", "yolo_classes": None, "detector": "yolo_then_motion"}
    assert len(got["bad"].override_errors) == 8 and got["bad"].overrides is None
    assert got["twice"].override_errors == ["repeated setting auto_init_min_area"]
    assert got["list"].override_errors == got["broken"].override_errors == ["overrides are no JSON object"]
    assert all(got[k].overrides == {} for k in ("none", "empty", "null")) and got["known"].overrides == {"auto_init_box_expand": "1.5"}
    hints = df.withColumns({"Calibration_Object": F.when(F.col("id") == "good", "ruler"), "Tracking_Objects": F.when(F.col("id") == "bad", "ball_center"), "Num_Objects": F.when(F.col("id") == "good", "x").when(F.col("id") == "bad", "0").otherwise(" 3")})
    told = {r.id: (r.hint, r.n) for r in hints.select("id", overrides.target_hint().alias("hint"), overrides.object_count(hints, "Tracking_Num_Objects", "Num_Objects").alias("n")).collect()}
    assert told["good"] == ("ruler", 1) and told["bad"] == ("ball", 1) and told["known"] == ("cube", 3) and told["null"] == ("object", 3)


def test_listings(spark):
    files = spark.createDataFrame([("/b/x.mp4", "x.mp4", "x"), ("/a/y.mov", "y.mov", "y")], "path string, name string, stem string")
    assert [(r.Index, r.Prompt_ID, r.Video_File, r.Metric) for r in metadata.videos_as_metadata(files).orderBy("Index").collect()] == [(1, "y", "y.mov", "tracking_only"), (2, "x", "x.mp4", "tracking_only")]
    wanted = spark.createDataFrame([("p", "/n/x.mp4", "/b/x.mp4"), ("q", None, "/n"), ("r", "/a/y.mov", "/b/x.mp4"), ("s", "/b/x.mp4", "/a/y.mov")], "id string, one string, two string")
    got = {r.id: r.path for r in metadata.first_existing(wanted, F.array("one", "two"), files).collect()}
    assert got == {"p": "/b/x.mp4", "q": None, "r": "/a/y.mov", "s": "/b/x.mp4"}


def test_mask_series(spark):
    image = np.zeros((4, 6), np.uint8)
    image[1:3, 2:5] = 255
    images = spark.createDataFrame([("/s/v1/masks/000002.png", png(image, 0)), ("/s/v2/7.png", png(image * 0, 0)), ("/s/v2/x.png", png(image, 0))], "path string, content binary")
    got = {(r.video, r.frame): r for r in metadata.series_from_masks(images).collect()}
    assert set(got) == {("v1", 2), ("v2", 7)} and got["v2", 7].area is None
    r = got["v1", 2]
    assert (r.area, r.box_x, r.box_y, r.box_w, r.box_h, r.cx, r.cy) == (6.0, 2, 1, 3, 2, 3.0, 1.5)
    doc = {"frames": [{"frame_idx": 0, "area": 9}, {"frame_idx": 1, "area": 0}, {"frame_idx": 2, "valid": False}, {"frame_idx": 3, "objects": [{"area": 4}, {"area": 5}]}]}
    raw = tracking.records(spark.createDataFrame([("v", json.dumps(doc))], "path string, text string"))
    own = spark.createDataFrame([("v", "1", f, 6.0) for f in range(3)], "video string, object_id string, frame long, area double")
    areas = lambda prefer: {r.frame: r.area for r in metadata.with_mask_areas(raw, own, prefer).collect()}
    assert areas(False) == {0: 9.0, 1: 6.0, 2: None, 3: 4.0} and areas(True) == {0: 6.0, 1: 6.0, 2: None, 3: 4.0}


def test_controls_tell_stable_from_right(spark):
    got = {r.case: r for r in controls.mask_controls(spark).collect()}
    assert got["correct_mask"].mask_quality_score == got["stable_wrong_target_30px_offset"].mask_quality_score == 1.0
    assert got["alternating_width"].mask_quality_score == 0.0 and got["stable_wrong_target_30px_offset"].ground_truth_mask_iou == 0.0
