"""What made queries slow on large tables (findings of round 3)."""

from pyspark.sql import functions as F

from kinespark.operators import rules
from kinespark.sources import preflight


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_compiled_and_shared_terms_read_once(spark):
    """a function over all entries made Spark interpret every rule, and each rule parsed the parameters again."""
    rows = spark.createDataFrame([("a", 1), (None, 1)], "id string, k int")
    report = rules.report(rows, [rules.RowRule("given", "error", F.when(F.col("id").isNull(), "none")), rules.GroupRule("once", "error", F.col("k"), F.col("id"))], F.col("id"))
    assert {tuple(r) for r in report.collect()} == {("given", "error", "row", None, "none", 1), ("once", "error", "table", "1", "a", 2)}
    assert "filter(array(" not in plan_of(report)
    meta = spark.createDataFrame([("A", '{"a": 1}')], "Prompt_ID string, Known_Parameters_JSON string")
    videos = spark.createDataFrame([], "relative string, size long, header_ok boolean, sample_counts array<long>")
    assert plan_of(preflight.metadata_report(meta, videos)).lower().count("parsejson") <= 1


def test_alike_images_are_undone_together(spark, monkeypatch):
    """each image took its own walk along the diagonals."""
    import zlib

    import numpy as np

    from kinespark.sources import png

    rng = np.random.default_rng(3)
    chunk = lambda kind, body: len(body).to_bytes(4) + kind + body + zlib.crc32(kind + body).to_bytes(4)

    def image(w, h):
        lines = rng.integers(0, 256, (h, 1 + 4 * w)).astype(np.uint8)
        lines[:, 0] = rng.integers(0, 5, h)
        return png.MARK + chunk(b"IHDR", w.to_bytes(4) + h.to_bytes(4) + bytes([8, 6, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")

    every = [image(*size) for size in [(7, 5), (1, 4), (7, 5), (5, 7), (7, 1)] * 20]
    alone = [png.decode(x).samples for x in every]
    walks, walk = [], png._along_diagonals
    monkeypatch.setattr(png, "_along_diagonals", lambda rows, step: walks.append(len(rows)) or walk(rows, step))
    got = list(png.decode_each([*every[:50], None, b"no image", *every[50:]]))
    assert len(walks) <= 3 and sum(walks) > 20  # one walk a size
    assert got[50] is None and isinstance(got[51], ValueError)
    assert all((g.samples == a).all() for g, a in zip(got[:50] + got[52:], alone, strict=True))


def test_streamed_frames_are_folded_as_rows():
    """each object's rows went through pandas tables, 8 ms an object."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from kinespark.streaming import frames

    class State(list):
        get = put = iterator = lambda self, *_: []
        update = clear = lambda self, *_: None

    own = frames.Frames(1000)
    own.handle = SimpleNamespace(registerTimer=lambda _: None, deleteTimer=lambda _: None)
    own.summary, own.due = SimpleNamespace(get=lambda: None, update=lambda _: None), SimpleNamespace(get=lambda: None, update=lambda _: None)
    own.waiting, own.sizes = State(), State()
    names = ["video", "object_id", "ts", *[c.split()[0] for c in frames.ROW.split(", ")]]
    row = Row(*names)
    rows = [row("v", "o", None, 2, 1, 3.0, 4.0, True, 6.0), row("v", "o", None, 1, 0, 0.0, 0.0, None, float("nan")), row("v", "o", None, 3, 2, float("nan"), 1.0, True, None)]
    (got,) = own.handleInputRows(("v", "o"), iter(rows), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))
    assert (got.frames, got.n_valid, got.path, got.extent, got.diameter, got.first_ms, got.closed) == (3, 2, 5.0, 5.0, 6.0, 1, False)


ODD_DOCUMENTS = [
    '{"object_id": 7, "fps": "30", "frames": [{"frame": "4", "x": "1.5", "y": true, "bbox": [1, "2", null, {}], "valid": "false", "area": 1e400}, 5, null, [1], {"t": 0.5, "cx": null, "cx_px": 2, "centroid": 3, "obj_id": 1.0}]}',
    ' \\n[{"frame_idx": 2.7, "objects": []}, {"objects": {"x": 1}, "x": 2}, {"objects": [null, 3, {"x": NaN, "cx": 4, "area_px2": -Infinity, "bbox": [1, 2.5]}], "x": 9}, {"objects": null, "y": 1, "frame_idx": null, "frame": 8}]',
    '{"frames": {"x": 1}}', '{"frames": []}', "[]", "7", '"{"', "", " \\n ", "{", '{"frames": [{"x": 1, "x": 2}]}', '{"frames": null, "video_info": {"fps": 0, "num_frames": 3}}', '{"frames": [{"X": 1, "x ": 2, "object_id": {"a": 1}}]}', None,
    '{"frames": [{"object_id": "NaN, Infinity", "x": 12345678901234567890, "equivalent_diameter_px": 1.25e1, "frame_idx": 9223372036854775808, "frame": 3, "time_sec": "x", "t": 2}]}',
]


def test_a_frame_is_read_in_one_walk(spark):
    """each frame's fields were looked up one by one, 20 walks a frame; fields of any kind come out as by single look-ups."""
    from kinespark.sources import tracking

    docs = spark.createDataFrame([(str(i), d and d.replace("\\n", "\n")) for i, d in enumerate(ODD_DOCUMENTS)], "video string, text string")
    got = tracking.records(docs, "video", "text")
    assert plan_of(got).lower().count("variant_get(") <= 10
    rows = [tuple(r) for r in got.orderBy("video", "pos", "place").collect()]
    of = lambda n: [r for r in rows if r[0] == str(n)]
    first = ("0", 0, 0, 4, "7", None, False, 1.5, 1.0, None, [1.0, 2.0, None, None], float("inf"), None, 30.0, None, None)
    assert of(0)[0] == first and [r[1:5] for r in of(0)[1:]] == [(1, 0, 1, "7"), (2, 0, 2, "7"), (3, 0, 3, "7"), (4, 0, 4, "1")] and of(0)[4][5:10] == (0.5, None, 2.0, None, None)
    assert [r[1:5] + r[7:12] for r in of(1)] == [
        (0, None, 2, "1", None, None, None, None, None), (1, 0, 1, "1", 2.0, None, None, None, None), (2, 0, 2, "1", None, None, None, None, None), (2, 1, 2, "1", None, None, None, None, None),
        (2, 2, 2, "1", 4.0, None, None, [1.0, 2.5], None), (3, 0, 8, "1", None, 1.0, None, None, None),
    ]
    assert [(r[0], r[1], r[-1]) for r in rows if r[-1]] == [(str(n), None, e) for n, e in sorted({10: "not JSON", 11: "no list of frames", 13: "not JSON", 2: "no list of frames", 5: "neither object nor list", 6: "neither object nor list", 7: "not JSON", 8: "not JSON", 9: "not JSON"}.items(), key=lambda x: str(x[0]))]
    assert of(14)[0][3:8] == (3, "NaN, Infinity", 2.0, None, float(12345678901234567890))


def test_what_is_told_together_is_told_in_one_pass(spark, sf):
    """F16: the evaluators took two passes more and another sort, and grouping events' objects moved all rows again."""
    from kinespark.operators import evaluators
    from kinespark.plans import adapters

    tracks, meta = adapters.golden(spark)
    assert plan_of(evaluators.summary(tracks, meta)).count("Window [") <= 9
    grouped = adapters.event_tracks(spark, sf).groupBy("object_id", (F.col("object_id") % 12).alias("k")).agg(F.collect_list("frame"))
    assert grouped._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
