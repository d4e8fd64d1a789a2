"""Documents, metadata, images and streams."""

import json
import struct
import zlib

import numpy as np
import pytest

from kinespark.operators import masks
from kinespark.sources import metadata, preflight, tracking
from kinespark.streaming import landing

DOCS = {
    "flat": {"video_info": {"fps": 30, "total_frames": 3}, "object_id": 1, "frames": [{"frame_idx": 0, "x": 1, "y": 2, "valid": True}, {"frame_idx": 1, "valid": False, "x": None, "y": None}, {"frame_idx": 2, "bbox": [0, 0, 9, 9], "area": 100}]},
    "nested": {"video_info": {"fps": 10}, "frames": [{"frame_idx": 4, "objects": [{"object_id": 1, "centroid": [3, 4]}, {"object_id": 2, "cx": 5, "cy": 6, "area": float("nan")}]}]},
    "no_points": {"frames": [{"frame_idx": 0, "valid": False}]},
    "no_frames": {"a": 1},
    "no_rate": {"frames": [{"frame_idx": 0, "x": 1, "y": 1}]},
}


def test_documents(spark):
    rows = [(k, json.dumps(v)) for k, v in DOCS.items()] + [("list", json.dumps([{"frame": 0, "t": 0.5, "x": 1, "y": 1}])), ("broken", "{")]
    raw = tracking.records(spark.createDataFrame(rows, "path string, text string"))
    points = tracking.normalised(raw)
    got = {(r.video, r.object_id, r.frame): r for r in points.collect()}
    assert got["flat", "1", 2].cx == 5.0 and abs(got["flat", "1", 2].t - 2 / 30) < 1e-12 and got["flat", "1", 2].box_w == 10
    assert ("flat", "1", 1) not in got and got["nested", "2", 4].cx == 5 and got["nested", "2", 4].area is None and got["nested", "1", 4].t == 0.4
    assert got["list", "1", 0].t == 0.5
    errors = {r.video: r.error for r in tracking.track_errors(raw, points).collect()}
    assert errors == {"no_points": "no valid points", "no_frames": "no list of frames", "no_rate": "no time and no frame rate", "broken": "not JSON"}


def test_canonical_problems(spark):
    doc = {"video_info": {"total_frames": 1}, "frames": [{"frame_idx": 0, "x": 1, "y": 1}, {"frame_idx": 0, "x": 2, "y": 2}]}
    raw = tracking.records(spark.createDataFrame([("v", json.dumps(doc))], "path string, text string"))
    assert {r.problem for r in tracking.canonical(raw).collect()} == {"repeated object and frame"}


def png(pixels: np.ndarray, kind: int) -> bytes:
    h, w = pixels.shape
    before, lines = np.zeros(w, np.int64), []
    for row in pixels.astype(np.int64):
        left = np.r_[0, row[:-1]]
        coded = {0: row, 1: row - left, 2: row - before}[kind]
        lines.append(bytes([kind]) + (coded & 255).astype(np.uint8).tobytes())
        before = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_png_runs(spark):
    image = np.zeros((6, 9), np.uint8)
    image[2:4, 3:7] = 255
    image[4, 0] = image[4, 8] = 9
    for kind in range(3):
        assert (metadata.decode_png(png(image, kind)) == image).all()
    df = spark.createDataFrame([("m", bytearray(png(image, 1)))], "path string, content binary")
    got = {(r.y, r.x0, r.x1) for r in metadata.mask_runs(df).collect()}
    assert got == {(2, 3, 6), (3, 3, 6), (4, 0, 0), (4, 8, 8)}


def test_metadata(spark, tmp_path):
    cols = [*metadata.REQUIRED, "Known_Parameters_JSON"]
    row = ["1", "V001", "V001.mp4", "B", "velocity", "o", "1", "side", "x", "none", "speed", "0.18", "m/s", '"{""mass_kg"": 0.25, ""gravity_environment"": ""moon""}"']
    path = tmp_path / "m.csv"
    path.write_text(",".join(cols) + "\n" + ",".join(row) + "\n")
    got = metadata.with_parameters(metadata.read_metadata(spark, str(path))).first()
    assert got.mass == 0.25 and got.gravity_environment == "moon" and got.Target_Value == 0.18
    path.write_text("Index\n1\n")
    with pytest.raises(ValueError, match="lacks"):
        metadata.read_metadata(spark, str(path))


def test_stream_lands_whole_videos(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(DOCS["flat"]))
    seen = []
    q = landing.land_tracks(landing.stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, i: seen.append((i, df.count())))
    q.awaitTermination(60)
    assert seen == [(0, 2)]


def test_prompts(spark):
    good = [{"object_id": 1, "point": [3, 4], "box": [0, 0, 9, 9]}]
    rows = [
        ("a", json.dumps(good), 1), ("b", json.dumps(good), 2), ("c", "{", 1), ("d", json.dumps([{"points": [[1, 2], [3, -4]]}]), 1), ("e", json.dumps([{"point": [30, 4], "box": [0, 0, 9, 9]}]), 1), ("f", json.dumps([{"box": [0, 0, 9, 9]}]), 1),
    ]
    got = {r.id: r for r in preflight.prompts(spark.createDataFrame(rows, "id string, Tracking_Prompts_JSON string, Num_Objects int")).collect()}
    assert got["a"].error is None and got["a"].positive_points == [[3.0, 4.0]] and got["a"].source == "manual"
    assert got["b"].error == "prompt count differs from the number of objects" and got["c"].error == "prompts are no JSON list"
    assert got["d"].error == "points are pairs of numbers that are not negative" and got["e"].error == "box leaves out a positive point" and got["f"].error == "no positive point"


def test_video_report(spark, tmp_path):
    body = b"\0\0\0\x18ftypisom" + b"\0" * 20 + b"stsz" + b"\0" * 8 + struct.pack(">I", 42) + b"\0\0"
    (tmp_path / "a.mp4").write_bytes(body)
    (tmp_path / "b.mp4").write_bytes(b"version of something else")
    videos = preflight.read_videos(spark, str(tmp_path))
    a = {r.name: r for r in videos.collect()}["a.mp4"]
    assert a.header_ok and 42 in a.sample_counts and a.size == len(body)
    manifest = spark.createDataFrame([("a.mp4", len(body), a.sha256.lower()), ("b.mp4", 1, "x"), ("c.mp4", 1, "x")], "name string, size long, sha256 string")
    assert {(r.name, r.problem) for r in preflight.video_report(videos, manifest).collect()} == {("b.mp4", "size differs"), ("c.mp4", "missing")}


def test_hash_of_the_rules():
    assert masks.rules_hash(masks.rules()) == "bd6de9c8be36f3499ca2e55c1d3c0a99021dcccdecbaa24d45a535eda8dffc08"
    with pytest.raises(ValueError):
        masks.rules(gamma=0)


def test_names_with_separators_and_other_case(spark):
    """A wanted stem may hold separators; suffix and case as in the file system's listing; two files are ambiguous."""
    files = spark.createDataFrame([("/v/model_VEL_001.mp4", "model_VEL_001.mp4", "model_VEL_001"), ("/v/a-x_9.mov", "a-x_9.mov", "a-x_9"), ("/v/p_two.mp4", "p_two.mp4", "p_two"), ("/v/q-two.mp4", "q-two.mp4", "q-two"), ("/v/xVEL_002.mp4", "xVEL_002.mp4", "xVEL_002")], "path string, name string, stem string")
    wanted = spark.createDataFrame([(x,) for x in ("VEL_001.mp4", "vel_001.mp4", "X_9.mov", "x_9.mp4", "two.mp4", "VEL_002.mp4", "a-x_9.mov")], "Video_File string")
    got = {r.Video_File: (r.path, r.matches) for r in metadata.resolve_videos(wanted, files).collect()}
    assert got == {"VEL_001.mp4": ("/v/model_VEL_001.mp4", 1), "vel_001.mp4": ("/v/model_VEL_001.mp4", 1), "X_9.mov": ("/v/a-x_9.mov", 1), "x_9.mp4": (None, None), "two.mp4": (None, 2), "VEL_002.mp4": (None, None), "a-x_9.mov": ("/v/a-x_9.mov", 1)}
