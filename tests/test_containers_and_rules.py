"""Boxes of containers, rules over rows and groups, and metadata against its videos."""

import hashlib
import io
import random
import struct

from pyspark.sql import functions as F

from kinespark.operators import rules
from kinespark.sources import containers, preflight


def box(kind: bytes, body: bytes = b"", wide: bool = False, open_end: bool = False) -> bytes:
    if wide:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", 0 if open_end else len(body) + 8, kind) + body


def track(handler: bytes, samples: int, timescale: int = 600, duration: int = 1200, version: int = 0, table: bytes = b"stsz") -> bytes:
    times = struct.pack(">QQIQ", 0, 0, timescale, duration) if version else struct.pack(">IIII", 0, 0, timescale, duration)
    mdhd = box(b"mdhd", bytes([version, 0, 0, 0]) + times)
    hdlr = box(b"hdlr", b"\0" * 8 + handler + b"\0" * 13)
    return box(b"trak", box(b"mdia", mdhd + hdlr + box(b"minf", box(b"stbl", box(table, b"\0" * 8 + struct.pack(">I", samples))))))


def video(*tracks: bytes, noise: bytes = b"stsz" + b"\0" * 8 + b"\0\0\0\x63", wide: bool = False) -> bytes:
    return box(b"ftyp", b"isom") + box(b"mdat", noise, wide) + box(b"moov", b"".join(tracks))


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def look(content: bytes, digest: bool = False):
    return containers.facts(io.BytesIO(content), len(content), digest)


def test_walk():
    ok, tracks, counts, damage, sha = look(video(track(b"vide", 48), track(b"soun", 7, version=1), track(b"text", 0, table=b"stz2")), True)
    assert ok and damage is None and counts == [48, 7]  # the mark within mdat is no table
    assert [(t["handler"], t["samples"], t["timescale"], t["duration"]) for t in tracks] == [("vide", 48, 600, 1200), ("soun", 7, 600, 1200), ("text", 0, 600, 1200)]
    assert look(video(track(b"vide", 5), wide=True))[2] == [5]
    assert look(box(b"ftyp", b"isom") + box(b"moov", track(b"vide", 6), open_end=True))[2] == [6]
    big = video(track(b"vide", 9), noise=b"\0" * (8 << 20))
    f = Counted(big)
    assert containers.facts(f, len(big), digest=False)[2] == [9] and f.taken < 1000


def test_walk_of_damaged_files():
    whole = video(track(b"vide", 48), noise=b"\0" * 50)
    for cut in range(len(whole)):  # never fails, never runs on
        look(whole[:cut])
    rng = random.Random(3)
    for _ in range(300):
        bad = bytearray(whole)
        for _ in range(3):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        look(bytes(bad))
    assert look(b"") == (False, [], [], None, None)
    assert look(box(b"ftyp", b"isom") + struct.pack(">I4s", 4, b"moov"))[3] == "box at 12 does not fit"
    far = b"x" * (containers.CHUNK - 6) + b"stsz" + b"\0" * 8 + struct.pack(">I", 77)  # a mark across two pieces, no box
    assert look(far)[2] == [77]


def test_files_and_columns(spark, tmp_path):
    body = {"a.mp4": video(track(b"vide", 30)), "in/b c.mp4": b"no video", "in/d.mp4": video(track(b"vide", 2), track(b"soun", 3))}
    (tmp_path / "in").mkdir()
    for name, content in body.items():
        (tmp_path / name).write_bytes(content)
    got = {r.relative: r for r in containers.read_containers(spark, str(tmp_path)).collect()}
    assert {k: (r.size, r.sha256, r.header_ok, r.sample_counts) for k, r in got.items()} == {
        k: (len(c), hashlib.sha256(c).hexdigest().upper(), k != "in/b c.mp4", look(c)[2]) for k, c in body.items()
    }
    plan = containers.read_containers(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("FileScan", 1)[1].split("\n", 1)[0]  # Spark reads no content itself
    rows = spark.createDataFrame([(1, bytearray(body["a.mp4"])), (2, None), (3, bytearray())], "id int, content binary")
    got = {r.id: r for r in containers.container_facts(rows).withColumn("rate", containers.frame_rate(F.get("tracks", F.lit(0)))).collect()}
    assert got[1].sample_counts == [30] and got[1].rate == 15 and got[2].header_ok is None and got[3].tracks == [] and got[3].rate is None


def test_rules(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", None, "x"), (None, 2, "z"), ("c", 2, None)], "id string, k int, v string")
    c = F.col
    own = [
        rules.RowRule("x_bad", "error", F.when(c("v") == "x", "is x")), rules.RowRule("seen", "ok", F.when(c("k").isNotNull(), "has k")),
        rules.GroupRule("k_once", "error", c("k"), c("id")), rules.GroupRule("id_one_v", "warning", c("id"), c("v"), differ=True),
    ]
    got = {tuple(r) for r in rules.report(rows, own, c("id")).collect()}
    assert got == {
        ("x_bad", "error", "row", "a", "is x", 1), ("x_bad", "error", "row", "b", "is x", 1), ("seen", "ok", "row", None, "has k", 4),
        ("k_once", "error", "table", "1", "a", 2), ("k_once", "error", "table", "2", "c", 2), ("id_one_v", "warning", "table", "a", "x and y", 2),
    }
    assert rules.readiness(rules.report(rows, own, c("id"))).first().asDict() == {"ok": 1, "warnings": 1, "errors": 4, "ready": False}
    none = rules.report(rows.limit(0), own, c("id"))
    assert none.count() == 0 and rules.readiness(none).first().asDict() == {"ok": 0, "warnings": 0, "errors": 0, "ready": True}
    plan = rules.report(rows, own, c("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_metadata_against_videos(spark, tmp_path):
    whole = video(track(b"vide", 30), noise=b"\0" * 2000)
    (tmp_path / "good.mp4").write_bytes(whole)
    (tmp_path / "short.mp4").write_bytes(video(track(b"vide", 30)))
    (tmp_path / "text.mp4").write_bytes(b"x" * 5000)
    (tmp_path / "bare.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"mdat", b"\0" * 2000))
    oracle = '{"gt_mask_pattern": "m_{frame:04d}.png", "gt_rgba": [255, 0, %s]}'
    rows = [
        (1, "A1", "eval_velocity", None, "1", "good.mp4", "30"), (2, "A.1", "eval_velocity", "", None, "good.mp4", "31"), (2, "A_1", "", "[]", "0", "short.mp4", "30"), (None, None, "eval_x", "{", "-2", "text.mp4", None),
        (5, "A5", "eval_gravity", "{}", "two", "bare.mp4", "3"), (6, "A6", "eval_oracle_tracking", oracle % "0", "1.0", "good.mp4", "30.0"), (7, "A7", "eval_oracle_tracking", oracle % "0.5", "1", "good.mp4", None),
        (8, "A8", "eval_velocity", None, "1", "none.mp4", "1"), (9, "A9", "eval_velocity", None, "1", "v\\w.mp4", "1"), (10, "A10", "eval_velocity", None, "1", "a/../b.mp4", "1"), (11, " A11\n", "eval_velocity", None, "1", "D:v.mp4", "1"),
    ]
    meta = spark.createDataFrame(rows, "Index int, Prompt_ID string, Evaluator string, Known_Parameters_JSON string, Num_Objects string, Video_File string, Expected_Frame_Count string")
    got = {(r.rule, r.subject, r.detail) for r in preflight.metadata_report(meta, containers.read_containers(spark, str(tmp_path))).collect()}
    assert got == {
        ("index_unique", "2", "A.1 and A_1"), ("folder_unique", "A_1", "A.1 and A_1"), ("index_given", None, "no index"), ("id_given", None, "no id"), ("id_safe", "A.1", "id is not safe in paths"), ("id_safe", None, "id is not safe in paths"),
        ("evaluator_known", "A_1", "unknown evaluator "), ("evaluator_known", None, "unknown evaluator eval_x"), ("evaluator_known", "A6", "unknown evaluator eval_oracle_tracking"),
        ("evaluator_known", "A7", "unknown evaluator eval_oracle_tracking"), ("parameters", "A_1", "parameters are no JSON object"), ("parameters", None, "parameters are no JSON object"), ("objects_positive", None, "number of objects is not positive"),
        ("objects_positive", "A5", "number of objects is not positive"), ("video_once", "good.mp4", "A.1 and A7"), ("video_plausible", "A_1", "no plausible MP4"), ("video_plausible", None, "no plausible MP4"), ("video_there", "A8", "video missing"),
        ("video_path", "A9", "path has backslashes"), ("video_path", "A10", "path leaves its folder"), ("video_path", " A11\n", "path is not relative"), ("frames_match", "A.1", "expected 31 frames, declared 30"), ("frames_declared", "A5", "no frame count declared"),
        ("renderer", "A7", "colour is not of bytes"), ("videos_verified", None, "plausible MP4"), ("frames_verified", None, "frame count declared"),
    }
    assert preflight.metadata_report(meta.limit(0).select("Index"), containers.read_containers(spark, str(tmp_path))).count() == 0
