"""Tables in the shape that the operators take, from the driver's tables or generated."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinespark.operators.windows import whole

#: The analytic control tracks, as place in pixels at t seconds over 120 frames at 30 a second.
GOLDEN_TRACKS = {
    "velocity": ("100 + 100 * t", "80"),
    "acceleration": ("100 + 40 * t * t", "80"),
    "gravity": ("100", "80 + 980 * t * t"),
    "friction_coefficient": ("100 + 200 * t - 20 * t * t", "80"),
    "restitution_coefficient": ("100 + 60 * least(t, 1) - 30 * greatest(0, t - 1)", "80"),
    "density_from_initial_acceleration": ("100", "80 + 490 * t * t"),
    "fluid_viscosity": ("100", "80 + 100 * t"),
    "spring_constant": ("100 + 30 * sin(2 * pi() * t)", "80"),
    "mechanical_energy_conservation": ("100", "80 + 980 * t * t"),
    "momentum_conservation_1d": ("100 + 60 * least(t, 2)", "80"),
}
SECOND_OBJECT = ("220 + 60 * greatest(0, t - 2)", "80")

META = (
    "video string, metric string, motion_axis string, scale_mode string, calibration_dimension string, calibration_value double, target_value double, "
    "g double, reference_g double, liquid_density double, solid_density double, mass double, m1 double, m2 double"
)


def golden(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Tracks and metadata of the analytic controls, one video a metric."""
    frames = spark.range(120).select(F.col("id").alias("frame"), (F.col("id") / 30).alias("t"))
    both = [(m, "1", *xy) for m, xy in GOLDEN_TRACKS.items()] + [("momentum_conservation_1d", "2", *SECOND_OBJECT)]
    x = F.coalesce(*[F.when((F.col("video") == m) & (F.col("object_id") == o), F.expr(f"double({a})")) for m, o, a, _ in both])
    y = F.coalesce(*[F.when((F.col("video") == m) & (F.col("object_id") == o), F.expr(f"double({b})")) for m, o, _, b in both])
    objects = spark.createDataFrame([(m, o) for m, o, *_ in both], "video string, object_id string")
    tracks = frames.withColumn("_", F.lit(1)).join(F.broadcast(objects.withColumn("_", F.lit(1))), "_").drop("_")
    tracks = tracks.select("video", "object_id", "frame", "t", x.alias("cx"), y.alias("cy"), F.lit(20.0).alias("diameter"), F.lit(20.0).alias("box_w"), F.lit(20.0).alias("box_h"))
    meta = [(m, m, "x", "object_diameter", None, 0.1, 1.0, 9.8, 9.8, 1000.0, 2000.0, 0.2, 1.0, 1.0) for m in GOLDEN_TRACKS]
    return tracks, spark.createDataFrame(meta, META)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as objects, their events as frames: t in hours from the first, x the value, y the number in props."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("object_id"), "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("y"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = Window.partitionBy("object_id").orderBy("ts", "event_id")  # by its final name: groupings by object keep this partitioning
    return e.select(
        "object_id", (F.row_number().over(w) - 1).cast("long").alias("frame"), ((seconds - F.min(seconds).over(whole(w))) / 3600).alias("t"),
        F.col("value").alias("x"), "y", F.col("value").alias("area"), (F.col("event_type") != "error").alias("valid"), "event_type",
    )


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of videos: regions as models, priorities as metrics, the sum of the lines as measurement and the
    order's total as target; status by order status; flagged tracking where the first line was returned."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lines.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("measured"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("flag"),
        F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"), F.avg("l_tax").alias("tax"), F.count("*").alias("lines"),
    )
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    status = F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "weak_valid").otherwise("failed")
    return joined.select(
        F.col("r_name").alias("model"), F.col("o_orderpriority").alias("metric"), F.col("o_orderkey").alias("prompt_id"), F.col("o_totalprice").alias("target"), "measured", status.alias("status"),
        F.when(F.col("flag") == "R", "flagged").otherwise("pass").alias("tracking"), "discount", "quantity", "tax", "lines",
    )


def coloured_frames(spark: SparkSession, sf_dir: str, width: int = 24, height: int = 16) -> DataFrame:
    """Ten events of a user as a PNG (video, frame, content, rgba): the events' places in the colour rgba, all else in one that
    only differs in alpha; each line in the filter that looks at three neighbours."""
    tracks = event_tracks(spark, sf_dir)
    cell = (F.floor("y") % height * width + F.floor("x") % width).cast("int")
    cells = tracks.groupBy(F.col("object_id").alias("video"), F.floor(F.col("frame") / 10).alias("frame")).agg(F.collect_set(cell).alias("cells"))

    @F.pandas_udf("binary")
    def draw(videos: pd.Series, cells: pd.Series) -> pd.Series:
        def chunk(kind: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

        def some(videos: np.ndarray, cells: list) -> list[bytes]:
            image = np.zeros((len(videos), height + 1, width + 1, 4), np.int16)
            image[:, 1:, 1:] = (200, 0, 0, 254)
            image[:, 1:, 1:, 1] = (videos % 256)[:, None, None]
            which, at = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells)
            image[which, 1 + at // width, 1 + at % width, 3] = 255
            here, left, up, corner = image[:, 1:, 1:], image[:, 1:, :-1], image[:, :-1, 1:], image[:, :-1, :-1]
            by_left, by_up, far = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where(by_left <= np.minimum(by_up, far), left, np.where(by_up <= far, up, corner))
            lines = np.full((len(videos), height, 1 + 4 * width), 4, np.uint8)
            lines[:, :, 1:] = ((here - guess) & 255).reshape(len(videos), height, -1)
            head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0))
            return [head + chunk(b"IDAT", zlib.compress(x.tobytes())) + chunk(b"IEND", b"") for x in lines]

        # 512 images at a time, as arrays of all would be large
        return pd.Series([b for k in range(0, len(videos), 512) for b in some(videos.to_numpy()[k : k + 512], list(cells[k : k + 512]))], dtype=object)

    return cells.select("video", "frame", draw("video", "cells").alias("content"), F.array(F.lit(200), (F.col("video") % 256).cast("int"), F.lit(0), F.lit(255)).alias("rgba"))
