"""How stable an object's mask is, from areas, boxes and places over time or from the pixels."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.exprs import EPS, component_score, finite, ln, positive, reasons
from kinespark.operators import fits, windows

#: Good and bad value of each component, and whether a high value is bad.
COMPONENTS = {
    "area_ratio_p95_p05": (2.0, 4.0, True),
    "area_cv": (0.25, 0.7, True),
    "bbox_width_cv": (0.2, 0.6, True),
    "bbox_height_cv": (0.2, 0.6, True),
    "bbox_aspect_cv": (0.2, 0.6, True),
    "max_log_jump": (0.45, 1.2, True),
    "trend_scale_ratio": (1.6, 3.0, True),
    "max_centroid_step_norm_by_diameter": (2.5, 5.0, True),
    "translation_aligned_iou_median": (0.65, 0.3, False),
    "middle_coverage": (0.7, 0.5, False),
}
GAMMA, WINDOW, MIN_VALID = 0.35, (0.15, 0.85), 6


def rules(components: dict = COMPONENTS, gamma: float = GAMMA, window: tuple[float, float] = WINDOW) -> dict:
    """The scoring rules as a document, checked."""
    if not (math.isfinite(gamma) and gamma > 0):
        raise ValueError("gamma must be a positive number")
    if not 0 <= window[0] < window[1] <= 1 or not components:
        raise ValueError("a window inside 0 .. 1 and components are needed")
    for name, (good, bad, high) in components.items():
        if not (math.isfinite(good) and math.isfinite(bad)) or (good >= bad if high else good <= bad):
            raise ValueError(f"{name}: good and bad value contradict the direction")
    each = {n: {"good_value": g, "bad_value": b, "direction": "high_bad" if h else "low_bad"} for n, (g, b, h) in components.items()}
    return {"gamma": gamma, "window_fractions": list(window), "components": each}


def rules_hash(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def diagnostics(rows: DataFrame, keys: list[str], ious: DataFrame | None = None, zero: bool = False) -> DataFrame:
    """One row an object from its listed frames (keys, frame, area, box_w, box_h, cx, cy; nulls where there is no mask): the
    statistics of the middle window, reasons and decision. ious: keys and iou_median, from the pixels. zero: areas and sides of 0 are a mask's too, with an
    infinite aspect, jump and logarithm; else they are none."""
    own = windows.middle(windows.numbered(rows, keys), *WINDOW)
    w = windows.ordered(keys)
    a = F.when(finite("area") >= 0, finite("area")) if zero else positive("area")
    own = own.withColumn("a", a).withColumn("step", windows.step("cx", "cy", w))
    aspect = F.greatest(F.try_divide("box_w", "box_h"), F.try_divide("box_h", "box_w"))
    if zero:
        aspect = F.when((F.col("box_w") == 0) | (F.col("box_h") == 0), F.lit(float("inf"))).otherwise(aspect)
    varies = lambda c: fits.variation(c, zero)
    diameter = F.sqrt(4 * F.col("a") / F.pi())
    shape = own.groupBy(*keys).agg(
        F.count("*").alias("n_middle"), F.count("a").alias("n_valid"), F.percentile("a", F.lit(0.05)).alias("p05"), F.percentile("a", F.lit(0.5)).alias("p50"), F.percentile("a", F.lit(0.95)).alias("p95"),
        F.avg("a").alias("area_mean"), varies("a").alias("area_cv"), varies("box_w").alias("bbox_width_cv"), varies("box_h").alias("bbox_height_cv"), varies(aspect).alias("bbox_aspect_cv"),
        F.max("step").alias("max_step"), (F.percentile(diameter, F.lit(0.5)) if zero else fits.median_positive(diameter)).alias("diameter"), F.min("a").alias("least"),
    )
    valid = windows.numbered(own.filter("a is not null").drop("i", "n"), keys).withColumn("jump", windows.log_jump("a", w))
    valid = valid.withColumn("u", F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))).withColumn("ln_a", ln("a"))
    jumps = valid.groupBy(*keys).agg(
        F.max("jump").alias("max_log_jump"), F.max_by("frame", F.struct("jump", -F.col("i"))).alias("jump_frame"), F.exp(F.abs(F.max_by("ln_a", "i") - F.min_by("ln_a", "i"))).alias("trend_scale_ratio")
    )
    trend = fits.linear_fit(valid, keys, "u", "ln_a").select(*keys, F.coalesce("slope", F.lit(0.0)).alias("trend_slope"), F.coalesce("r2", F.lit(0.0)).alias("trend_r2"))
    out = shape.join(jumps, keys, "left").join(trend, keys, "left")
    out = out.withColumn("trend_r2", F.when(F.col("least") == 0, float("nan")).otherwise(F.col("trend_r2"))).drop("least")
    out = out.join(ious, keys, "left") if ious is not None else out.withColumn("iou_median", F.lit(None).cast("double"))
    enough = F.col("n_valid") >= MIN_VALID
    out = out.withColumns({
        "middle_coverage": F.col("n_valid") / F.greatest("n_middle", F.lit(1)), "area_ratio_p95_p05": F.when(enough & (F.col("p05") > 0), F.col("p95") / F.col("p05")),
        **{c: F.when(enough, F.col(c)) for c in ("area_cv", "area_mean", "p05", "p50", "p95", "trend_slope", "trend_r2", "trend_scale_ratio")},
        "max_centroid_step_norm_by_diameter": F.try_divide("max_step", "diameter"), "translation_aligned_iou_median": F.col("iou_median"),
    }).drop("iou_median")
    found = mask_reasons()
    return out.withColumn("reasons", found).withColumn("decision", decision(F.col("reasons"))).withColumn("status", mask_status(F.col("reasons")))


def mask_reasons() -> Column:
    c = F.col
    jump = c("max_log_jump") > 0.45
    depth = (c("trend_scale_ratio") >= 1.6) & (c("trend_r2") >= 0.65) & ~F.coalesce(jump, F.lit(False))
    return reasons(
        (c("n_valid") < MIN_VALID, "insufficient_valid_middle_frames"), (c("middle_coverage") < 0.7, "low_middle_coverage"), (c("area_ratio_p95_p05") > 2.0, "large_area_ratio"), (c("area_cv") > 0.25, "large_area_cv"),
        (jump, "sudden_area_jump"), (c("bbox_width_cv") > 0.2, "large_bbox_width_cv"), (c("bbox_height_cv") > 0.2, "large_bbox_height_cv"), (c("bbox_aspect_cv") > 0.2, "large_bbox_aspect_cv"),
        (c("translation_aligned_iou_median") < 0.65, "low_translation_aligned_mask_iou"), (c("max_centroid_step_norm_by_diameter") > 2.5, "large_centroid_jump"), (depth, "smooth_scale_change_possible_depth_motion"),
    )


def decision(found: Column) -> Column:
    has = lambda *names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    return (
        F.when(F.size(found) == 0, "keep").when(has("large_centroid_jump"), "rerun_tracking").when(has("sudden_area_jump"), "rerun_tracking_or_reject")
        .when(has("smooth_scale_change_possible_depth_motion"), "reject_or_verify_plane_motion").when(has("low_translation_aligned_mask_iou"), "review_segmentation_or_object_deformation")
        .when(has("large_area_ratio", "large_area_cv", "large_bbox_width_cv", "large_bbox_height_cv", "large_bbox_aspect_cv"), "review_or_reject_plane_motion").otherwise("rerun_tracking")
    )


def mask_status(found: Column) -> Column:
    bad = F.arrays_overlap(found, F.array(F.lit("insufficient_valid_middle_frames"), F.lit("low_middle_coverage")))
    return F.when(F.size(found) == 0, "pass").when(bad, "fail").otherwise("warn")


def component_scores(objects: DataFrame, keys: list[str], gamma: float = GAMMA) -> DataFrame:
    """Long form: keys, component, value, score. Missing values have no score."""
    long = objects.unpivot(keys, list(COMPONENTS), "component", "value")
    table = F.create_map(*[F.lit(x) for name, (g, b, h) in COMPONENTS.items() for x in (name, F.struct(F.lit(g).alias("good"), F.lit(b).alias("bad"), F.lit(h).alias("high")))])
    rule = F.element_at(table, F.col("component"))
    return long.select(*keys, "component", "value", component_score(F.col("value"), rule["good"], rule["bad"], rule["high"], F.lit(float(gamma))).alias("score"))


def object_score(gamma: Column | float = GAMMA) -> Column:
    """The least score of an object's components, in the row that has them; reasons can add a zero."""
    g = F.lit(float(gamma)) if isinstance(gamma, float) else gamma
    each = [component_score(F.col(n), F.lit(a), F.lit(b), F.lit(h), g) for n, (a, b, h) in COMPONENTS.items()]
    few = F.when(F.coalesce(F.exists("reasons", lambda r: F.contains(r, F.lit("insufficient_valid_middle_frames"))), F.lit(False)), F.lit(0.0))
    low = F.when(F.coalesce(F.array_contains("reasons", "low_middle_coverage"), F.lit(False)) & F.col("middle_coverage").isNull(), F.lit(0.0))
    return F.array_min(F.array_compact(F.array(*each, few, low)))


def video_quality(objects: DataFrame, video: list[str], gamma: float = GAMMA) -> DataFrame:
    """score (null if any object has no component), status and reasons of each video: the least of its objects."""
    scored = objects.withColumn("score", object_score(gamma))
    out = scored.groupBy(*video).agg(
        F.count("*").alias("objects"), F.when(F.count_if(F.col("score").isNull()) == 0, F.min("score")).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons")
    )
    flagged = F.size("reasons") > 0
    status = F.when(F.col("score") <= 0, "fail").when((F.col("score") >= 0.999) & ~flagged, "pass").when(F.col("score").isNotNull(), "weak")
    return out.withColumn("status", status)


def mask_geometry(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Area, inclusive box and mean place of each mask from its runs (y, x0, x1 inclusive)."""
    n = F.col("x1") - F.col("x0") + 1
    mean = lambda c: F.sum(c * n) / F.sum(n)
    box = [F.min("x0").alias("x1"), F.min("y").alias("y1"), F.max("x1").alias("x2"), F.max("y").alias("y2")]
    return runs.groupBy(*keys, "frame").agg(F.sum(n).cast("long").alias("area"), *box, mean((F.col("x0") + F.col("x1")) / 2).alias("cx"), mean(F.col("y")).alias("cy"))


def aligned_iou(runs: DataFrame, keys: list[str], frames: DataFrame | None = None, stride: int = 5, window: tuple[float, float] = WINDOW, size: tuple[int, int] | None = None) -> DataFrame:
    """frame, ref and iou of sampled masks of the middle window with the middle one of them, moved onto it by whole pixels
    (halves to even); what falls out of the image doesn't count. frames: keys and all frames that are listed, with or
    without a mask, which the window is taken from; size: width and height of the images. Runs meet the reference's runs of
    their row, so no pixel is ever a row."""
    places = mask_geometry(runs, keys).select(*keys, "frame", F.struct("frame", "area", "cx", "cy").alias("m"))
    there = F.first("m", ignorenulls=True).alias("m")
    if frames is not None:  # a listed frame and its mask become one row by grouping, without a join
        listed = frames.select(*keys, "frame").withColumn("listed", F.lit(True)).unionByName(places, allowMissingColumns=True)
        listed = listed.groupBy(*keys, "frame").agg(there, F.max("listed").alias("listed")).filter("listed").drop("listed")
    else:
        listed = places
    usable = windows.numbered(windows.middle(windows.numbered(listed, keys), *window).filter("m is not null").drop("i", "n"), keys)
    mid = F.floor(F.col("n") / 2)
    ref = F.max(F.when((F.col("i") == mid) & (F.col("n") >= 2), F.col("m"))).over(Window.partitionBy(*keys))
    chosen = usable.withColumn("ref", ref).filter(((F.col("i") % max(1, stride) == 0) | (F.col("i") == mid)) & F.col("ref").isNotNull())
    shift = lambda c: F.bround(F.col("ref")[c] - F.col("m")[c]).cast("int").alias(f"d{c[1]}")
    chosen = chosen.select(*keys, "frame", (F.col("i") == mid).alias("is_ref"), F.col("ref.frame").alias("ref"), F.col("ref.area").alias("ref_area"), shift("cx"), shift("cy"))
    # merges: tables that look small on disk are many times that as runs, too much to go to the driver and out again
    own = runs.select(*keys, "frame", "y", "x0", "x1").join(chosen.hint("merge"), [*keys, "frame"])
    rows = own.filter("is_ref").groupBy(*keys, "y").agg(F.collect_list(F.struct("x0", "x1")).alias("there"))
    moved = own.filter(~F.col("is_ref")).select(*keys, "frame", "ref", "ref_area", (F.col("y") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("a0"), (F.col("x1") + F.col("dx")).alias("a1"))
    if size:
        moved = moved.withColumn("a0", F.greatest("a0", F.lit(0))).withColumn("a1", F.least("a1", F.lit(size[0] - 1)))
        moved = moved.withColumn("a1", F.when(F.col("y").between(0, size[1] - 1), F.col("a1")).otherwise(F.col("a0") - 1))
    overlap = lambda r: F.greatest(F.least("a1", r["x1"]) - F.greatest("a0", r["x0"]) + 1, F.lit(0)).cast("long")
    common = F.coalesce(F.aggregate("there", F.lit(0).cast("long"), lambda n, r: n + overlap(r)), F.lit(0))
    both = moved.join(rows.hint("merge"), [*keys, "y"], "left")
    out = both.groupBy(*keys, "frame", "ref", "ref_area").agg(F.sum(F.greatest(F.col("a1") - F.col("a0") + 1, F.lit(0))).alias("area"), F.sum(common).alias("common"))
    return out.select(*keys, "frame", "ref", (F.col("common") / F.greatest(F.col("area") + F.col("ref_area") - F.col("common"), F.lit(EPS))).alias("iou"))


def iou_stats(ious: DataFrame, keys: list[str]) -> DataFrame:
    """Median, least and number of an object's overlaps, and the frame they were taken with."""
    return ious.groupBy(*keys).agg(F.percentile("iou", F.lit(0.5)).alias("iou_median"), F.min("iou").alias("iou_min"), F.count("*").alias("iou_n"), F.first("ref").alias("iou_frame"))


def target_errors(runs: DataFrame, keys: list[str]) -> DataFrame:
    """For masks whose target is known (keys, frame, y, x0, x1 of the mask and t0, t1 of the target): root mean square of the
    distance of their places, and mean overlap."""
    n, m = F.col("x1") - F.col("x0") + 1, F.col("t1") - F.col("t0") + 1
    common = F.greatest(F.least("x1", "t1") - F.greatest("x0", "t0") + 1, F.lit(0))
    mean = lambda a, b, k: F.sum((F.col(a) + F.col(b)) / 2 * k) / F.sum(k)
    frames = runs.groupBy(*keys, "frame").agg((mean("x0", "x1", n) - mean("t0", "t1", m)).alias("dx"), (F.sum(F.col("y") * n) / F.sum(n) - F.sum(F.col("y") * m) / F.sum(m)).alias("dy"), (F.sum(common) / F.sum(n + m - common)).alias("iou"))
    return frames.groupBy(*keys).agg(F.sqrt(F.avg(F.col("dx") ** 2 + F.col("dy") ** 2)).alias("centroid_rmse_px"), F.avg("iou").alias("ground_truth_mask_iou"))


def frame_details(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame: change of the logarithm of area, way since the last place that is known, over the diameter."""
    w = windows.ordered(keys)
    d = rows.withColumn("a", positive("area"))
    way = windows.bridged_step("cx", "cy", w)
    return d.withColumn("step", F.when(F.col("cx").isNotNull(), way)).withColumn("step_norm", F.try_divide("step", F.sqrt(4 * F.col("a") / F.pi())))
