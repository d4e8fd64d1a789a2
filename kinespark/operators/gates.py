"""Is a video's tracking fit for measuring?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.exprs import positive, reasons

MIN_SHARE, MIN_EXTENT = 0.50, 0.75


def tracking_gate(records: DataFrame, expected: DataFrame | int = 1, video: str = "video", total: str | None = None, min_share: float = MIN_SHARE, min_extent: float = MIN_EXTENT) -> DataFrame:
    """records: video, object_id, frame, x, y, valid, diameter; a video without frame entries has rows without frame and
    object. An object counts when it is valid in half of the video's frame entries; the one with most valid records among
    those tells how far things moved; of equal ones the one that was met first (by pos and place where records have them, else
    by frame, then the smaller id). expected: objects a video, a number or a table (video,
    expected), one at least. total names a column with the number of frame entries; without it, distinct frames count."""
    there = F.col("frame").isNotNull()
    valid = there & F.coalesce("valid", F.lit(True)) & F.col("x").isNotNull() & F.col("y").isNotNull()
    frames = records.groupBy(video).agg((F.coalesce(F.max(total), F.lit(0)) if total else F.count_distinct("frame")).alias("frames"))
    met = ["pos", "place"] if {"pos", "place"} <= set(records.columns) else ["frame"]
    w = Window.partitionBy(video, "object_id").orderBy(*met)
    points = records.filter(valid).withColumn("way", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    moved = points.groupBy(video, "object_id").agg(
        F.count("*").alias("n_valid"), F.coalesce(F.sum("way"), F.lit(0.0)).alias("path"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent")
    )
    sizes = records.filter(there).groupBy(video, "object_id").agg(F.percentile(positive("diameter"), F.lit(0.5)).alias("diameter"), F.min(F.struct(*met)).alias("met"))
    objects = sizes.join(moved, [video, "object_id"], "left").join(frames, video).withColumn("n_valid", F.coalesce("n_valid", F.lit(0)))
    return decided(objects, frames, expected, video, min_share, min_extent)


def decided(objects: DataFrame, frames: DataFrame, expected: DataFrame | int = 1, video: str = "video", min_share: float = MIN_SHARE, min_extent: float = MIN_EXTENT) -> DataFrame:
    """The gate from what is known of each object (video, object_id, n_valid, path, extent, diameter, met, frames) and each
    video (video, frames)."""
    counted = F.col("n_valid") / F.greatest("frames", F.lit(1)) >= min_share
    order = F.struct(-F.col("n_valid"), "met", "object_id")
    first = F.min_by(F.when(counted, F.struct("object_id", "n_valid", "path", "extent", "diameter")), F.when(counted, order)).alias("primary")
    told = frames.join(objects.groupBy(video).agg(F.count_if(counted).alias("counted"), first), video, "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    told = told.withColumn("expected", F.lit(expected)) if isinstance(expected, int) else told.join(expected, video, "left")
    told = told.withColumn("expected", F.greatest(F.coalesce("expected", F.lit(1)), F.lit(1)))
    norm = lambda c: F.try_divide(F.col(f"primary.{c}"), F.col("primary.diameter"))
    some = F.col("frames") > 0
    why = reasons(
        (some & (norm("extent") < min_extent), "no_meaningful_motion"), (some & (F.col("counted") == 0), "no_counted_object"), (some & (F.col("counted") != F.col("expected")), "object_count_mismatch"),
        (~some, "tracking_frames_missing"),
    )
    return told.select(
        video, "frames", "expected", "counted", F.col("primary.object_id").alias("primary_object"), norm("path").alias("path_norm"), norm("extent").alias("extent_norm"), F.array_sort(why).alias("reasons"),
        F.when(F.size(why) == 0, "pass").otherwise("flagged").alias("status"),
    )
