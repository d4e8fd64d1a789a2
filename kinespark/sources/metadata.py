"""Sample metadata, result documents, files on disk and mask images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinespark.functions.exprs import clean_json, positive
from kinespark.session import ship_package
from kinespark.sources import png

#: The columns that a metadata table must have.
REQUIRED = ("Index", "Prompt_ID", "Video_File", "Module", "Metric", "Tracking_Objects", "Num_Objects", "View", "Motion_Axis", "Scale_Mode", "Target_Type", "Target_Value", "Target_Unit")
VIDEO_SUFFIXES = ("mp4", "mov", "avi", "mkv", "webm")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header or Parquet; all else is kept as it is."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    return df.withColumns({c: F.col(c).try_cast(k) for c, k in (("Index", "int"), ("Num_Objects", "int"), ("Target_Value", "double"), ("Calibration_Value_m", "double")) if c in df.columns})


def filter_rows(df: DataFrame, index: int | None = None, prompt_id: str | None = None, limit: int | None = None) -> DataFrame:
    if index is not None:
        df = df.filter(F.col("Index") == index)
    if prompt_id is not None:
        df = df.filter(F.col("Prompt_ID") == prompt_id)
    return df.orderBy("Index").limit(limit) if limit is not None else df


def with_parameters(df: DataFrame, column: str = "Known_Parameters_JSON") -> DataFrame:
    """Typed parameters from the open JSON object; parameter_error where it is none."""
    v = F.try_parse_json(clean_json(F.nullif(F.trim(column), F.lit(""))))
    number = lambda *names: F.coalesce(*[F.try_variant_get("_p", f"$.{n}", "double") for n in names])
    given = F.nullif(F.trim(column), F.lit("")).isNotNull()
    out = df.withColumn("_p", v).withColumn("parameter_error", F.when(given & (F.col("_p").isNull() | ~F.schema_of_variant("_p").startswith("OBJECT")), "parameters are no JSON object"))
    return out.withColumns({
        "g": number("g"), "gravity": number("gravity"), "gravity_reference": number("reference_g_mps2"), "gravity_environment": F.try_variant_get("_p", "$.gravity_environment", "string"), "mass": number("mass_kg"),
        "m1": number("m1_kg"), "m2": number("m2_kg"), "liquid_density": number("liquid_density_kg_m3"), "solid_density": number("solid_density_kg_m3"),
    }).drop("_p")


def read_results(spark: SparkSession, root: str, metric: str | None = None) -> DataFrame:
    """Result documents below root/<metric>/<prompt>/result.json, or root/<model>/<metric>/..., with the names of the path."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").text(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    out = df.select(F.try_parse_json(clean_json("value")).alias("doc"), F.element_at(parts, -2).alias("prompt_id"), F.element_at(parts, -3).alias("metric"), F.element_at(parts, -4).alias("model"))
    return out.filter(F.col("metric") == metric) if metric else out


def discover_videos(spark: SparkSession, root: str) -> DataFrame:
    """path, name and stem of videos below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(VIDEO_SUFFIXES) + "}").load(root).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "length", name.alias("name"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"))


def resolve_videos(wanted: DataFrame, files: DataFrame, column: str = "Video_File") -> DataFrame:
    """For each wanted name the file with that name, else the only one with its suffix whose stem ends in _stem or -stem,
    in any case; matches counts them. Each file is listed under all ends of its stem, so this is a join by equality."""
    stem, suffix = (lambda c: F.lower(F.regexp_replace(c, r"\.[^.]+$", ""))), (lambda c: F.regexp_extract(c, r"(\.[^.]+)?$", 0))
    last = F.element_at(F.split(column, "/"), -1)
    w = wanted.select(column, last.alias("_name"), stem(last).alias("_stem"), suffix(last).alias("_suffix")).distinct()
    by_name = w.join(files, w["_name"] == files["name"]).select(column, "path", F.lit(0).alias("rank"))
    cuts = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("low"), i, 1).isin("_", "-"))
    ends = files.withColumn("low", stem("name")).select("path", suffix("name").alias("suffix"), F.explode(F.transform(cuts, lambda i: F.substring(F.col("low"), i + 1, F.length("low")))).alias("end"))
    by_stem = w.join(ends, (w["_stem"] == ends["end"]) & (w["_suffix"] == ends["suffix"])).select(column, "path", F.lit(1).alias("rank"))
    both = by_name.unionByName(by_stem).groupBy(column).agg(F.min("rank").alias("rank"), F.collect_set(F.struct("rank", "path")).alias("all"))
    best = F.filter("all", lambda x: x["rank"] == F.col("rank"))
    return wanted.join(both.select(column, F.size(best).alias("matches"), F.when(F.size(best) == 1, F.array_min(best)["path"]).alias("path")), column, "left")


def videos_as_metadata(videos: DataFrame) -> DataFrame:
    """Metadata where there is none: each video is tracked alone and not measured. Videos are numbered in order of path."""
    order = Window.orderBy("path")  # names of files only: a listing, not data
    return videos.select(
        F.row_number().over(order).alias("Index"), F.col("stem").alias("Prompt_ID"), F.col("name").alias("Video_File"), F.lit("tracking_only").alias("Metric"), F.lit(1).alias("Num_Objects"),
        F.lit("object_center").alias("Tracking_Objects"), F.lit("none").alias("Calibration_Object"), F.lit("{}").alias("Known_Parameters_JSON"),
    )


def first_existing(wanted: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """Adds path, the first of a row's candidate paths (an array, nulls skipped) that files has, else null, and searched, the
    candidates as text. Each candidate meets the listing by equality."""
    own = wanted.withColumn("_candidates", F.array_compact(candidates))
    tried = own.select("_candidates").distinct().select("_candidates", F.posexplode("_candidates").alias("place", "path"))
    found = tried.join(files.select("path").distinct(), "path").groupBy("_candidates").agg(F.min_by("path", "place").alias("path"))
    return own.join(found, "_candidates", "left").withColumn("searched", F.array_join("_candidates", ", ")).drop("_candidates")


def series_from_masks(images: DataFrame) -> DataFrame:
    """video (the folder, or the one above a folder named masks), path, frame, area, box and place of every mask image whose
    name is a number; area and box are null where no pixel is set."""
    parts = F.split("path", "/")
    video = F.when(F.element_at(parts, -2) == "masks", F.element_at(parts, -3)).otherwise(F.element_at(parts, -2))
    listed = images.withColumn("frame", F.regexp_extract("path", r"/([0-9]+)\.[^./]+$", 1).try_cast("long")).filter("frame is not null").withColumn("video", video)
    n = F.col("x1") - F.col("x0") + 1
    shape = mask_runs(listed).groupBy("path").agg(
        F.sum(n).cast("double").alias("area"), F.min("x0").alias("box_x"), F.min("y").alias("box_y"), (F.max("x1") - F.min("x0") + 1).alias("box_w"), (F.max("y") - F.min("y") + 1).alias("box_h"),
        (F.sum((F.col("x0") + F.col("x1")) / 2 * n) / F.sum(n)).alias("cx"), (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"),
    )
    return listed.select("video", "path", "frame").join(shape, "path", "left")


def with_mask_areas(records: DataFrame, masks: DataFrame, prefer_masks: bool = False) -> DataFrame:
    """Tracking records, the first of each object and frame, with area from their own number, if positive, or from masks
    (video, object_id, frame, area), whichever comes first; null for those marked invalid without an area."""
    keys = ["video", "object_id", "frame"]
    order = Window.partitionBy(*keys).orderBy("pos", "place")
    own = records.filter("frame is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    joined = own.join(masks.select(*keys, F.col("area").alias("_mask")), keys, "left")
    lost = F.coalesce(F.col("valid") == F.lit(False), F.lit(False)) & (F.coalesce("area", F.lit(0.0)) == 0)
    both = [positive("area"), F.col("_mask")]
    return joined.withColumn("area", F.when(~lost, F.coalesce(*(both[::-1] if prefer_masks else both)))).drop("_mask")


def decode_png(data: bytes) -> np.ndarray:
    """First channel of a PNG."""
    return png.first_channel(data)


def mask_runs(images: DataFrame) -> DataFrame:
    """Images (path, content) as runs of pixels that are set: path, y, x0, x1 inclusive."""
    ship_package(images.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in frames:
            for path, content in zip(some["path"], some["content"], strict=True):
                edges = np.diff(np.pad((decode_png(content) > 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
                y, x0 = np.nonzero(edges == 1)
                yield pd.DataFrame({"path": path, "y": y.astype("int32"), "x0": x0.astype("int32"), "x1": (np.nonzero(edges == -1)[1] - 1).astype("int32")})

    return images.select("path", "content").mapInPandas(run, "path string, y int, x0 int, x1 int")


SHAPE = "image_w int, image_h int, area long, x1 int, y1 int, x2 int, y2 int, cx double, cy double, error string"


def colour_shapes(images: DataFrame, content: str = "content", colour: str = "rgba", opened: Callable[[object], bytes] = bytes) -> DataFrame:
    """Rows of images with the pixels that have exactly the row's colour (four bytes; three mean opaque): size of the image,
    area, inclusive box, mean place. No such pixel: area 0, no box. Null content or colour: all null. What is no image, or no
    colour, has an error. opened turns what the column content holds, as a path, into bytes, within the task."""
    ship_package(images.sparkSession)
    fields = [f.split() for f in SHAPE.split(", ")]

    def found(v, want):
        """The image's bytes, or what stands for it."""
        if v is None or want is None:
            return None
        if len(want) not in (3, 4) or any(c is None or not 0 <= c <= 255 for c in want):
            return ValueError("colour is not of bytes")
        try:
            return bytes(opened(v))
        except FileNotFoundError:
            return None
        except ValueError as e:
            return e

    def shape(image, want) -> tuple:
        if image is None:
            return (None,) * len(fields)
        if isinstance(image, ValueError):
            return (None,) * (len(fields) - 1) + (str(image),)
        same = png.coloured(image).view(np.uint32)[:, :, 0] == np.array([*want, 255][:4], np.uint8).view(np.uint32)
        y, x = np.nonzero(same)
        size = (same.shape[1], same.shape[0], len(x))
        return (*size, int(x.min()), int(y.min()), int(x.max()), int(y.max()), float(x.mean()), float(y.mean()), None) if len(x) else (*size, *[None] * 7)

    @F.pandas_udf(f"struct<{','.join(f'{n}:{t}' for n, t in fields)}>")
    def look(contents: pd.Series, colours: pd.Series) -> pd.DataFrame:
        decoded = png.decode_each(found(v, c) for v, c in zip(contents, colours, strict=True))
        return pd.DataFrame([shape(i, c) for i, c in zip(decoded, colours, strict=True)], columns=[n for n, _ in fields]).astype({n: {"int": "Int32", "long": "Int64", "double": "Float64"}[t] for n, t in fields[:-1]})

    return images.withColumn("_shape", look(content, F.col(colour).cast("array<int>"))).select(*images.columns, "_shape.*")
