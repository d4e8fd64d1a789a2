"""Masks made by rule, whose errors are known: one that follows its target, one that follows another place as steadily,
one of changing width and one that jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.operators import masks

#: The cases, as shift and width in pixels in even and in odd frames; the target is 10 wide.
CASES = {
    "correct_mask": ((0, 10), (0, 10)),
    "stable_wrong_target_30px_offset": ((30, 10), (30, 10)),
    "alternating_width": ((0, 28), (0, 3)),
    "centroid_jitter": ((0, 10), (15, 10)),
}
FRAMES, SIZE, ROWS, LEFT, SIDE = 40, (180, 80), (30, 39), 30, 10


def mask_runs(spark: SparkSession) -> DataFrame:
    """video, frame, y, x0, x1 of the masks, and t0, t1 of the target, which moves by a pixel a frame."""
    each = F.array(*[F.struct(F.lit(n).alias("video"), *[F.array(F.lit(even[k]), F.lit(odd[k])).alias(c) for k, c in enumerate(("shift", "width"))]) for n, (even, odd) in CASES.items()])
    own = spark.range(FRAMES).select(F.col("id").alias("frame"), F.explode(each).alias("c")).select("frame", "c.*")
    turn = (F.col("frame") % 2).cast("int")
    own = own.withColumns({"t0": F.lit(LEFT) + F.col("frame"), "x0": F.lit(LEFT) + F.col("frame") + F.get("shift", turn), "w": F.get("width", turn)})
    return own.select("video", F.lit("1").alias("object_id"), "frame", F.explode(F.sequence(F.lit(ROWS[0]), F.lit(ROWS[1]))).alias("y"), "x0", (F.col("x0") + F.col("w") - 1).alias("x1"), "t0", (F.col("t0") + SIDE - 1).alias("t1"))


def mask_controls(spark: SparkSession) -> DataFrame:
    """case, centroid_rmse_px, ground_truth_mask_iou and the score that the masks get without knowing the target."""
    keys, runs = ["video", "object_id"], mask_runs(spark)
    shapes = masks.mask_geometry(runs, keys).withColumns({"box_w": F.col("x2") - F.col("x1") + 1, "box_h": F.col("y2") - F.col("y1") + 1})
    ious = masks.iou_stats(masks.aligned_iou(runs.select(*keys, "frame", "y", "x0", "x1"), keys, size=SIZE), keys)
    scored = masks.video_quality(masks.diagnostics(shapes, keys, ious.select(*keys, "iou_median")), ["video"])
    return masks.target_errors(runs, ["video"]).join(scored.select("video", F.col("score").alias("mask_quality_score")), "video").withColumnRenamed("video", "case")
