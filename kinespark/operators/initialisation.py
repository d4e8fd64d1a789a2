"""How tracking of each video begins: by detectors, by prompts given by hand, or by the first eligible mask of a renderer.

Modes, prompts and their refusals are an ordered table of rules on columns, so any number of videos is resolved in one pass,
and a video that is refused says why. Only renderers' masks need more: the frames that may be used are rows, the tasks that
hold them look for the row's exact colour, and one partial minimum a video chooses the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions.exprs import clean_json
from kinespark.sources import metadata, overrides, preflight
from kinespark.sources.containers import open_file

#: Modes, least values of an eligible mask, and protocols by mode and whether boxes are used.
MODES = ("auto", "manual", "renderer_gt")
GATES = {"min_mask_area_px": 1, "min_bbox_side_px": 1, "min_border_margin_px": 0}
PROTOCOLS = {
    "auto": ("video_only_auto", "video_only_auto"),
    "manual": ("one_frame_manual_point", "one_frame_manual_point_box"),
    "first_visible": ("renderer_first_visible_gt_point", "renderer_first_visible_gt_point_box"),
    "first_eligible": ("renderer_first_eligible_gt_point", "renderer_first_eligible_gt_point_box"),
}
SOURCE = "renderer_gt_{}_exact_color"
PROMPTS = "array<struct<object_id:int,frame_idx:int,positive_points:array<array<double>>,negative_points:array<array<double>>,box:array<double>,source:string>>"
NEEDED = ("Known_Parameters_JSON", "Tracking_Init_Mode", "Tracking_Prompts_JSON", "Tracking_Overrides_JSON", "Num_Objects", "Expected_Frame_Count", "Tracking_Objects", "Calibration_Object")


def _first(rules: Sequence[tuple[Column, str | Column]]) -> Column:
    """The text of the first rule that holds, else null; a condition that is null doesn't hold."""
    return F.coalesce(*[F.when(c, t) for c, t in rules])


def inside(path: Column) -> Column:
    """The path without . and .. ; null where it leaves its folder or is absolute."""
    step = lambda done, part: F.when(part.isin("", "."), done).when(part != "..", F.array_append(done, part)).when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~path.startswith("/"), F.array_join(parts, "/"))


def frame_path(pattern: Column, frame: Column) -> Column:
    """The pattern with {frame}, {frame:d} or {frame:04d} filled in; other fields stay."""
    number = frame.cast("string")
    digits = F.regexp_extract(pattern, r"\{frame:0(\d+)d\}", 1).try_cast("int")
    plain = F.regexp_replace(pattern, F.lit(r"\{frame(:d)?\}"), number)
    return F.regexp_replace(plain, F.lit(r"\{frame:0\d+d\}"), F.lpad(number, F.greatest(F.coalesce(digits, F.lit(1)), F.length(number)), "0"))


def _whole_number(v: Column, default: int) -> Column:
    """A whole number that is not negative, the default where nothing is given; null for all else, truth values too."""
    n = F.when(F.schema_of_variant(v) != "BOOLEAN", F.try_variant_get(v, "$", "double"))
    return F.when(v.isNull(), F.lit(default)).when((n >= 0) & (n == F.floor(n)), n.cast("int"))


def requests(rows: DataFrame, allow_renderer: bool = False) -> DataFrame:
    """Rows with what they ask for: mode, expected, overrides, prompts (given by hand), gates, padding, frames and init_error, the
    first rule that refuses the row. Columns of NEEDED that are absent count as null."""
    own = reduce(lambda d, c: d if c in d.columns else d.withColumn(c, F.lit(None).cast("string")), NEEDED, rows)
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    own = overrides.tracking_overrides(own).withColumns({"_given": blank(F.col("Known_Parameters_JSON"))}).withColumn("_known", F.try_parse_json(clean_json("_given")))
    at = lambda name, kind="variant", of="_known": F.try_variant_get(of, f"$.{name}", kind)
    own = own.withColumn("_init", at("tracking_init"))
    mode = F.lower(F.trim(F.coalesce(blank(F.col("Tracking_Init_Mode")), F.nullif(at("mode", "string", "_init"), F.lit("")), F.lit("auto"))))
    expected = F.coalesce(F.try_element_at("overrides", F.lit("num_objects")).cast("int"), overrides.object_count(own, "Num_Objects"))
    own = own.withColumns({"mode": mode, "expected": expected})
    hand = F.coalesce(blank(F.col("Tracking_Prompts_JSON")), F.to_json(at("prompts", of="_init")))
    listed, wrong = preflight.prompt_list(hand, F.col("expected"))
    own = own.withColumns({"_hand": preflight.checked_prompts(listed), "_wrong": wrong, **{g: _whole_number(at(g, of="_init"), v) for g, v in GATES.items()}, "padding": _whole_number(at("box_padding_px", of="_init"), 0)})
    is_mode = lambda m: F.col("mode") == m
    counted = F.sequence(F.lit(0), F.greatest(F.col("Expected_Frame_Count").try_cast("double").try_cast("int"), F.lit(1)) - 1)
    frames = F.when(at("gt_visible_frames").isNotNull(), at("gt_visible_frames", "array<int>")).when(F.col("Expected_Frame_Count").try_cast("double") >= 1, counted)
    hidden = F.when(is_mode("renderer_gt"), preflight.renderer_problem(F.col("_known")))
    object_like = lambda v, more="": F.schema_of_variant(v).rlike(f"^(OBJECT{more})")
    ids = F.transform("_hand", lambda p: p["object_id"])
    rules = [
        (F.col("_given").isNotNull() & ~F.coalesce(object_like("_known"), F.lit(False)), "parameters are no JSON object"), (~object_like("_init", "|VOID"), "tracking_init is no object"),
        (~F.col("mode").isin(*MODES), F.concat(F.lit("unsupported mode "), F.col("mode"))), (F.size("override_errors") > 0, F.array_join("override_errors", "; ")),
        (is_mode("manual"), F.col("_wrong")), (is_mode("manual"), F.array_join(F.array_distinct(F.array_compact(F.transform("_hand", lambda p: p["error"]))), "; ")),
        (is_mode("manual") & (F.size(F.array_distinct(ids)) < F.size(ids)), "object ids are not unique"),
        (is_mode("renderer_gt") & F.lit(not allow_renderer), "a renderer's masks are not allowed"), (is_mode("renderer_gt"), hidden),
        (is_mode("renderer_gt") & (F.size(at("gt_rgba", "array<variant>")) != 4), "colour is not of four bytes"),
        *[(is_mode("renderer_gt") & F.col(g).isNull(), f"{g} must be a nonnegative integer") for g in (*GATES, "padding")],
        (is_mode("renderer_gt") & (F.coalesce(F.size(frames), F.lit(0)) < 1), "no visible frames and no frame count"), (is_mode("renderer_gt") & (F.col("expected") != 1), "a renderer's mask gives one prompt, other numbers of objects are expected"),
    ]
    own = own.withColumn("init_error", F.nullif(_first([(c, F.nullif(t, F.lit("")) if isinstance(t, Column) else t) for c, t in rules]), F.lit("")))
    given = F.when(is_mode("manual") & F.col("init_error").isNull(), F.transform("_hand", lambda p: p.dropFields("error"))).otherwise(F.array().cast(PROMPTS))
    named = {"prompts": given.cast(PROMPTS), "frames": F.when(is_mode("renderer_gt") & F.col("init_error").isNull(), frames), "pattern": at("gt_mask_pattern", "string"), "rgba": at("gt_rgba", "array<int>")}
    return own.withColumns(named).drop("_given", "_known", "_init", "_hand", "_wrong")


def renderer_prompts(asked: DataFrame, id: str, images: DataFrame | None, root: str | None) -> DataFrame:
    """id, prompt, mask_error: the first frame, in the order given, whose exact colour passes the row's gates, or what
    stopped the search before."""
    # no filter on the mode or the error: Catalyst would push it down to the rows and write all rules out in it
    each = asked.select(id, "pattern", "rgba", "padding", *GATES, F.posexplode_outer("frames").alias("pos", "frame")).filter("pos is not null")
    each = each.withColumn("named", frame_path(F.col("pattern"), F.col("frame"))).withColumn("path", inside(F.when(~F.contains("named", F.lit("{")), F.col("named"))))
    if images is not None:
        shaped = metadata.colour_shapes(each.join(images.select("path", "content"), "path", "left"))
    else:
        shaped = metadata.colour_shapes(each.withColumn("content", F.concat(F.lit((root or ".").rstrip("/") + "/"), "path")), opened=open_file)
    c = F.col
    low, high = lambda a: F.greatest(c(a) - c("padding"), F.lit(0)).cast("double"), lambda a, n: F.least(c(a) + c("padding"), c(n) - 1).cast("double")
    side, margin = F.least(c("x2") - c("x1"), c("y2") - c("y1")) + 1, F.least(c("x1"), c("y1"), c("image_w") - 1 - c("x2"), c("image_h") - 1 - c("y2"))
    eligible = (c("area") > 0) & (c("area") >= c("min_mask_area_px")) & (side >= c("min_bbox_side_px")) & (margin >= c("min_border_margin_px"))
    error = F.when(c("path").isNull(), F.when(F.contains("named", F.lit("{")), "mask pattern has other fields").otherwise("mask pattern leaves its folder")).otherwise(c("error"))
    point = F.array(c("cx"), c("cy"))
    prompt = F.struct(F.lit(1).alias("object_id"), c("frame").alias("frame_idx"), F.array(point).alias("positive_points"), F.array().cast("array<array<double>>").alias("negative_points"), F.array(low("x1"), low("y1"), high("x2", "image_w"), high("y2", "image_h")).alias("box"), F.lit("").alias("source"))
    stop = shaped.withColumn("mask_error", error).filter(eligible | c("mask_error").isNotNull())
    return stop.groupBy(id).agg(F.min_by(F.struct(prompt.alias("prompt"), "mask_error"), "pos").alias("b")).select(id, "b.*")


def resolve(rows: DataFrame, id: str = "Prompt_ID", images: DataFrame | None = None, root: str | None = None, allow_renderer: bool = False, no_box: bool = False) -> DataFrame:
    """Rows with init, a struct of how tracking begins and where that comes from, and init_error; one of them is null. id is
    unique (``preflight.metadata_report`` says where it isn't). Renderers' masks are in images (path, content) or, without, in
    files below root that tasks open; masks that are not there are passed over. no_box: prompts don't use boxes, as the
    setting no_auto_init_box says for single videos. No rows: none."""
    asked = requests(rows, allow_renderer)
    if allow_renderer:
        asked = asked.join(renderer_prompts(asked, id, images, root), id, "left")
    else:
        asked = asked.withColumns({"prompt": F.lit(None).cast(PROMPTS[6:-1]), "mask_error": F.lit(None).cast("string")})
    c = F.col
    renderer, plain = c("mode") == "renderer_gt", reduce(lambda a, b: a & b, [c(g) == v for g, v in GATES.items()])
    selector = F.when(plain, "first_visible").otherwise("first_eligible")
    source = F.when(plain, SOURCE.format("first_visible")).otherwise(SOURCE.format("first_eligible"))
    own = F.when(renderer & c("prompt").isNotNull(), F.array(c("prompt").withField("source", source))).otherwise(c("prompts"))
    asked = asked.withColumn("prompts", own).withColumn("_boxes", F.size(F.filter("prompts", lambda p: p["box"].isNotNull())))
    error = _first([
        (c("init_error").isNotNull(), c("init_error")), (renderer, c("mask_error")), (renderer & c("prompt").isNull(), "no visible mask passes the gates"), ((c("_boxes") > 0) & (c("_boxes") < F.size("prompts")), "prompts of a row have boxes or have none"),
    ])
    used = (c("_boxes") > 0) & ~F.lit(no_box) & (F.coalesce(F.try_element_at("overrides", F.lit("no_auto_init_box")), F.lit("false")) != "true")
    asked = asked.withColumns({"_error": error, "_used": used})
    names = F.create_map(*[F.lit(x) for m, pair in PROTOCOLS.items() for k in (0, 1) for x in (f"{m} {'ft'[k]}", pair[k])])
    protocol = F.try_element_at(names, F.concat(F.when(renderer, selector).otherwise(c("mode")), F.when(c("_used"), " t").otherwise(" f")))
    counted = F.when(c("mode") != "auto", F.size("prompts"))
    told = F.struct(
        F.lit(1).alias("schema_version"), c("mode"), protocol.alias("protocol"), c("expected").alias("num_objects"), c("prompts"), F.coalesce(c("overrides"), F.create_map().cast("map<string,string>")).alias("tracking_overrides"), renderer.alias("uses_renderer_ground_truth"),
        F.lit(False).alias("uses_ground_truth_after_initialization"), c("_used").alias("box_prompts_used"), F.when(renderer, F.struct(*GATES)).alias("renderer_gt_eligibility"),
        F.coalesce(F.nullif("Tracking_Objects", F.lit("")), F.nullif("Calibration_Object", F.lit(""))).alias("target_description"), counted.alias("resolved_prompt_count"), (counted == c("expected")).alias("prompt_count_matches_expected"),
    )
    return asked.select(*rows.columns, F.when(c("_error").isNull(), told).alias("init"), c("_error").alias("init_error"))


def tracker_prompts(resolved: DataFrame, first_id: int = 1, label: int = 1) -> DataFrame:
    """The prompts of resolved rows for a tracker, one row each, with consecutive obj_id in their order: point, positive_points,
    negative_points, box (null where none is used), and what stands in for a detector's findings: bbox (four pixels about the
    point without a box), area, aspect_ratio, method. Rows for detectors (auto) and refused rows have none."""
    keep = [x for x in resolved.columns if x not in ("init", "init_error")]
    each = resolved.select(*keep, F.col("init.mode").alias("_mode"), F.col("init.box_prompts_used").alias("_boxes"), F.posexplode_outer("init.prompts").alias("_k", "_p")).filter("_k is not null")
    point = F.col("_p.positive_points")[0]
    bbox = F.coalesce("_p.box", F.array(point[0] - 2, point[1] - 2, point[0] + 2, point[1] + 2))
    w, h = (F.greatest(F.lit(1.0), bbox[i + 2] - bbox[i] + 1) for i in (0, 1))
    return each.select(
        *keep, (F.col("_k") + first_id).alias("obj_id"), F.concat(F.lit("metadata_"), "_mode").alias("prompt_mode"), F.col("_p.frame_idx").alias("frame_idx"), point.alias("point"), F.col("_p.positive_points").alias("positive_points"),
        F.lit(label).alias("label"), F.when(F.col("_boxes"), F.col("_p.box")).alias("box"), F.col("_p.negative_points").alias("negative_points"), bbox.alias("bbox"), F.bround(w * h).cast("long").alias("area"), F.greatest(w / h, h / w).alias("aspect_ratio"), F.col("_p.source").alias("method"),
    )
