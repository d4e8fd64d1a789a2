"""Tracking documents, one JSON text a video: an object with frames or a bare list of them, each frame of one object or
with a list of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.functions.exprs import clean_json, equivalent_diameter, track_centre


NOT_JSON, NO_DOCUMENT = "not JSON", "neither object nor list"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every file below path."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: What an object's record may hold, and a frame; what can't be read as its kind is null.
RECORD = (
    "object_id string, obj_id string, valid boolean, x double, cx double, cx_px double, y double, cy double, cy_px double, "
    "centroid array<double>, bbox array<double>, area double, area_px2 double, equivalent_diameter_px double"
)
FRAME = f"frame_idx long, frame long, time_sec double, t double, objects array<struct<{RECORD}>>, {RECORD}"


def _first(v: str, kind: str, *names: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])


def _of(v: str, *names: str) -> Column:
    return F.coalesce(*[F.col(f"{v}.{n}") for n in names])


def records(documents: DataFrame, video: str = "path", text: str = "text") -> DataFrame:
    """A row for each frame and object as written, invalid ones too: video, pos, place, frame, object_id, t, valid, x, y,
    centroid, box, area, given_diameter, fps, total_frames; error says why a document has none. A frame without an index has
    its place in the list; objects of a frame share its index and time."""
    bare = F.contains(F.col(text), F.lit("NaN")) | F.contains(F.col(text), F.lit("Infinity"))  # few texts need cleaning
    d = documents.select(F.col(video).alias("video"), F.try_parse_json(F.when(bare, clean_json(text)).otherwise(F.col(text))).alias("doc"), F.rlike(text, F.lit(r"^\s*[{\[]")).alias("nested"))
    # a frame's fields are read in one walk over what it has, not looked up one by one
    frames = F.coalesce(*[F.try_variant_get("doc", p, f"array<struct<{FRAME}>>") for p in ("$.frames", "$")])
    d = d.withColumn("frames", frames).withColumns({
        "fps": _first("doc", "double", "video_info.fps", "fps"), "total_frames": _first("doc", "long", "video_info.total_frames", "video_info.num_frames", "total_frames"), "doc_object": _first("doc", "string", "object_id"),
        "error": F.when(F.col("doc").isNull(), NOT_JSON).when(~F.col("nested"), NO_DOCUMENT).when(frames.isNull(), "no list of frames"),
    })
    each = d.select("video", "fps", "total_frames", "doc_object", "error", F.posexplode_outer("frames").alias("pos", "f"))
    own = F.coalesce("f.objects", F.array(F.struct(*[F.col(f"f.{c.split()[0]}") for c in RECORD.split(", ")])))
    each = each.withColumns({"frame_outer": F.coalesce("f.frame_idx", "f.frame", F.col("pos").cast("long")), "t_outer": _of("f", "time_sec", "t")})
    o = each.select("*", F.posexplode_outer(own).alias("place", "o"))
    return o.select(
        "video", "pos", "place", F.col("frame_outer").alias("frame"), F.coalesce("o.object_id", "o.obj_id", "doc_object", F.lit("1")).alias("object_id"),
        F.col("t_outer").alias("t"), F.col("o.valid").alias("valid"), _of("o", "x", "cx", "cx_px").alias("x"), _of("o", "y", "cy", "cy_px").alias("y"),
        F.col("o.centroid").alias("centroid"), F.col("o.bbox").alias("box"), _of("o", "area", "area_px2").alias("area"), F.col("o.equivalent_diameter_px").alias("given_diameter"),
        "fps", "total_frames", "error",
    )


def normalised(raw: DataFrame, fps_override: float | None = None) -> DataFrame:
    """Valid points: video, object_id, frame, t, cx, cy, area, box_x, box_y, box_w, box_h, diameter. Time is as written, else
    frame over the document's rate, else over the one given. Rows of error explain videos without points."""
    fps = F.coalesce("fps", F.lit(fps_override).cast("double"))
    cx, cy = track_centre("centroid", "x", "y", "box")
    b = F.col("box")
    side = lambda i: F.get(b, F.lit(i + 2)) - F.get(b, F.lit(i)) + 1
    t = F.coalesce("t", F.col("frame") / F.when(fps > 0, fps))
    out = raw.filter(F.coalesce("valid", F.lit(True))).select(
        "video", "object_id", "frame", t.alias("t"), cx.alias("cx"), cy.alias("cy"), "area", F.get(b, F.lit(0)).alias("box_x"), F.get(b, F.lit(1)).alias("box_y"), side(0).alias("box_w"), side(1).alias("box_h"), "given_diameter",
        F.when(fps <= 0, "frame rate is not positive").otherwise(F.col("error")).alias("error"),
    )
    out = out.withColumn("diameter", F.coalesce("given_diameter", equivalent_diameter("area", "box_w", "box_h"))).drop("given_diameter")
    return out.filter(F.col("cx").isNotNull() & F.col("cy").isNotNull() & F.col("frame").isNotNull())


def track_errors(raw: DataFrame, points: DataFrame) -> DataFrame:
    """(video, error) of documents that give no track."""
    every = raw.groupBy("video").agg(F.max("error").alias("error"))
    told = points.groupBy("video").agg(F.count("*").alias("n"), F.count_if(F.col("t").isNull()).alias("untimed"), F.max("error").alias("point_error"))
    why = F.coalesce("error", "point_error", F.when(F.col("n").isNull(), "no valid points").when(F.col("untimed") > 0, "no time and no frame rate"))
    return every.join(told, "video", "left").select("video", why.alias("error")).filter("error is not null")


def canonical(raw: DataFrame, exclusive_boxes: bool = False) -> DataFrame:
    """For masks: integer object ids, inclusive boxes, one record for each object and frame. Repeats, negative frames and a
    declared length below what is there are problems, in column problem."""
    shift = 1.0 if exclusive_boxes else 0.0
    box = F.when(F.size("box") == 4, F.array(F.col("box")[0], F.col("box")[1], F.col("box")[2] - shift, F.col("box")[3] - shift))
    out = raw.filter("frame is not null").withColumn("box", box).withColumn("object_id", F.expr("try_cast(object_id as int)"))
    counts = out.groupBy("video", "object_id", "frame").agg(F.count("*").alias("same"))
    last = out.groupBy("video").agg(F.max("frame").alias("last"))
    out = out.join(counts, ["video", "object_id", "frame"]).join(last, "video")
    problem = F.when(F.col("same") > 1, "repeated object and frame").when(F.col("frame") < 0, "negative frame").when(F.col("total_frames") <= F.col("last"), "more frames than declared")
    return out.withColumn("problem", problem).withColumn("total_frames", F.coalesce("total_frames", F.col("last") + 1)).drop("same", "last")
