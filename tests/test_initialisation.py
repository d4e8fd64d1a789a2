"""How tracking begins: every protocol and every refusal."""

import json

import numpy as np
from pyspark.sql import functions as F
from test_images import write

from kinespark.operators import initialisation as I

COLUMNS = "Prompt_ID string, Tracking_Init_Mode string, Tracking_Prompts_JSON string, Known_Parameters_JSON string, Tracking_Overrides_JSON string, Num_Objects int, Expected_Frame_Count string, Tracking_Objects string"
RED = [255, 0, 0, 255]


def row(name, mode=None, prompts=None, known=None, own=None, n=1, frames=None):
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    return (name, mode, text(prompts), text(known), text(own), n, frames, "ball")


def gt(pattern="m/{frame:04d}.png", rgba=RED, visible=None, **init):
    return {"gt_mask_pattern": pattern, "gt_rgba": rgba, "tracking_init": {"mode": "renderer_gt", **init}} | ({"gt_visible_frames": visible} if visible is not None else {})


def picture(x1, y1, x2, y2, alpha=255, h=12, w=16) -> bytes:
    s = np.zeros((h, w, 4), int)
    s[y1 : y2 + 1, x1 : x2 + 1] = (255, 0, 0, alpha)
    return write(s, 8, 6, np.random.default_rng(0))


IMAGES = {"m/0000.png": picture(0, 0, 3, 3, alpha=254), "m/0001.png": picture(5, 5, 5, 5), "m/0003.png": picture(0, 2, 9, 9), "m/0004.png": picture(4, 3, 8, 7), "m/0005.png": b"broken", "7.png": picture(1, 1, 2, 2)}
P, BOX = {"point": [3, 4]}, {"point": [3, 4], "box": [0, 0, 9, 9]}


def both(spark, rows, **conf):
    out = I.resolve(spark.createDataFrame(rows, COLUMNS), images=spark.createDataFrame([(k, bytearray(v)) for k, v in IMAGES.items()], "path string, content binary"), **conf)
    return {r.Prompt_ID: r for r in out.collect()}


def test_protocols(spark):
    rows = [
        row("auto"), row("spaces", " AUTO "), row("nested", known={"tracking_init": {"mode": "manual", "prompts": [P]}}), row("void", known={"tracking_init": None}),
        row("points", "manual", [P, {"points": [[1, 2], [5, 6]], "object_id": 7}], n=2), row("boxes", "manual", [BOX]), row("no_box", "manual", [BOX], own={"no_auto_init_box": True}), row("count", "manual", [P, P], own={"num_objects": 2}),
        row("visible", known=gt(), frames="6"), row("eligible", known=gt(min_mask_area_px=10, min_border_margin_px=1, box_padding_px=5), frames="6.0"), row("listed", known=gt(visible=[4, 1]), frames="1"), row("short", known=gt("./a/../{frame}.png", visible=[7])),
    ]
    got = both(spark, rows, allow_renderer=True)
    assert {k: r.init_error for k, r in got.items() if r.init_error} == {}
    assert {k: r.init.protocol for k, r in got.items()} == {
        "auto": "video_only_auto", "spaces": "video_only_auto", "void": "video_only_auto", "nested": "one_frame_manual_point", "points": "one_frame_manual_point", "boxes": "one_frame_manual_point_box", "no_box": "one_frame_manual_point",
        "count": "one_frame_manual_point", "visible": "renderer_first_visible_gt_point_box", "eligible": "renderer_first_eligible_gt_point_box", "listed": "renderer_first_visible_gt_point_box", "short": "renderer_first_visible_gt_point_box",
    }
    first = {k: got[k].init.prompts[0] for k in ("visible", "eligible", "listed", "short")}
    assert {k: (p.frame_idx, p.positive_points, p.box) for k, p in first.items()} == {
        "visible": (1, [[5.0, 5.0]], [5.0, 5.0, 5.0, 5.0]), "eligible": (4, [[6.0, 5.0]], [0.0, 0.0, 13.0, 11.0]), "listed": (4, [[6.0, 5.0]], [4.0, 3.0, 8.0, 7.0]), "short": (7, [[1.5, 1.5]], [1.0, 1.0, 2.0, 2.0]),
    }
    assert first["visible"].source == "renderer_gt_first_visible_exact_color" and first["eligible"].source == "renderer_gt_first_eligible_exact_color"
    i = got["eligible"].init
    assert i.uses_renderer_ground_truth and i.renderer_gt_eligibility.min_mask_area_px == 10 and i.resolved_prompt_count == 1 and i.prompt_count_matches_expected and i.target_description == "ball"
    assert got["auto"].init.resolved_prompt_count is None and got["count"].init.num_objects == 2 and got["no_box"].init.tracking_overrides == {"no_auto_init_box": "true"} and got["no_box"].init.prompts[0].box == [0, 0, 9, 9]
    assert both(spark, rows[5:6], no_box=True)["boxes"].init.protocol == "one_frame_manual_point"


def test_refusals(spark):
    want = {
        "json": ("parameters are no JSON object", row("json", known="{")), "init": ("tracking_init is no object", row("init", known={"tracking_init": [1]})), "mode": ("unsupported mode magic", row("mode", "Magic")),
        "own": ("unsupported setting speed", row("own", own={"speed": 1})), "none": ("prompts are no JSON list", row("none", "manual")), "many": ("prompt count differs from the number of objects", row("many", "manual", [P, P])),
        "same": ("object ids are not unique", row("same", "manual", [{**P, "object_id": 2}, P], n=2)), "thing": ("prompt is no object", row("thing", "manual", [3])), "point": ("no positive point", row("point", "manual", [{}])),
        "mixed": ("prompts of a row have boxes or have none", row("mixed", "manual", [P, BOX], n=2)), "pattern": ("mask pattern has no frame", row("pattern", known=gt("m.png"), frames="3")), "colour": ("colour is not of four bytes", row("colour", known=gt(rgba=RED[:3]), frames="3")),
        "gate": ("min_mask_area_px must be a nonnegative integer", row("gate", known=gt(min_mask_area_px=True), frames="3")), "half": ("min_bbox_side_px must be a nonnegative integer", row("half", known=gt(min_bbox_side_px=1.5), frames="3")),
        "pad": ("padding must be a nonnegative integer", row("pad", known=gt(box_padding_px=-1), frames="3")), "frames": ("no visible frames and no frame count", row("frames", known=gt())), "empty": ("no visible frames and no frame count", row("empty", known=gt(visible=[]), frames="3")),
        "two": ("a renderer's mask gives one prompt, other numbers of objects are expected", row("two", known=gt(), n=2, frames="6")), "unseen": ("no visible mask passes the gates", row("unseen", known=gt(min_mask_area_px=1000), frames="5")),
        "out": ("mask pattern leaves its folder", row("out", known=gt("m/../../{frame}.png"), frames="3")), "root": ("mask pattern leaves its folder", row("root", known=gt("/m/{frame}.png"), frames="3")),
        "field": ("mask pattern has other fields", row("field", known=gt("m/{frame:x}.png"), frames="3")), "broken": ("not a PNG", row("broken", known=gt(visible=[9, 5, 4]))),
    }
    got = both(spark, [r for _, r in want.values()], allow_renderer=True)
    assert {k: r.init_error for k, r in got.items()} == {k: e for k, (e, _) in want.items()}
    assert all(r.init is None for r in got.values())
    assert both(spark, [row("a", "renderer_gt", known=gt(), frames="6")])["a"].init_error == "a renderer's masks are not allowed"
    none = I.resolve(spark.createDataFrame([], "Prompt_ID string, mode int"))
    assert none.count() == 0 and none.columns == ["Prompt_ID", "mode", "init", "init_error"]


def test_masks_in_files_and_tracker_prompts(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for name, content in IMAGES.items():
        (tmp_path / name).write_bytes(content)
    rows = [row("r", known=gt(), frames="6"), row("b", "manual", [{**BOX, "object_id": 9}, {**BOX, "object_id": 4, "frame": 2, "source": "me"}], n=2), row("p", "manual", [P]), row("n", "manual", [BOX], own={"box_disabled": 1}), row("a"), row("e", "x")]
    out = I.resolve(spark.createDataFrame(rows, COLUMNS), root=str(tmp_path), allow_renderer=True)
    got = {(r.Prompt_ID, r.obj_id): r for r in I.tracker_prompts(out, first_id=3).orderBy("Prompt_ID", F.col("obj_id")).collect()}
    assert list(got) == [("b", 3), ("b", 4), ("n", 3), ("p", 3), ("r", 3)]
    assert got["b", 4].frame_idx == 2 and got["b", 4].box == [0, 0, 9, 9] and got["b", 4].area == 100 and got["b", 4].method == "me" and got["b", 4].prompt_mode == "metadata_manual"
    assert got["p", 3].box is None and got["p", 3].bbox == [1, 2, 5, 6] and got["p", 3].area == 25 and got["n", 3].box is None and got["n", 3].bbox == [0, 0, 9, 9]
    assert got["r", 3].frame_idx == 1 and got["r", 3].point == [5, 5] and got["r", 3].aspect_ratio == 1 and got["r", 3].prompt_mode == "metadata_renderer_gt"
