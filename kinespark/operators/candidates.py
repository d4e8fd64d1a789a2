"""Choosing what to track: candidates' boxes, greedy choices in order, and the fall-back between detectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinespark.functions.exprs import box_iou
from kinespark.session import ship_package


def distinct_candidates(boxes: DataFrame, k: int, min_distance: float, max_iou: float = 0.20, inclusive: bool = True) -> DataFrame:
    """video, candidate, score, x1, y1, x2, y2: of each video the k best that stand apart, taken greedily by score, ties to
    the smaller candidate; rank is the order. Each round takes the best one left of each video and drops what is too near
    it, so a video's candidates are never gathered."""
    box = ["x1", "y1", "x2", "y2"]
    rest, chosen = boxes.select("video", "candidate", "score", *box), []
    for rank in range(1, k + 1):
        best = rest.groupBy("video").agg(F.max_by(F.struct("candidate", *box), F.struct(F.col("score"), -F.col("candidate"))).alias("b"))
        chosen.append(best.select("video", F.col("b.candidate").alias("candidate"), F.lit(rank).alias("rank")))
        middle = lambda a, b, of="": (F.col(f"{of}{a}") + F.col(f"{of}{b}")) / 2
        apart = F.hypot(middle("x1", "x2") - middle("x1", "x2", "b."), middle("y1", "y2") - middle("y1", "y2", "b.")) >= min_distance
        rest = rest.join(best, "video").filter(apart & (box_iou(box, [f"b.{c}" for c in box], inclusive) <= max_iou) & (F.col("candidate") != F.col("b.candidate"))).drop("b")
    return reduce(DataFrame.unionByName, chosen)


def cluster_candidates(points: DataFrame, radius: float) -> DataFrame:
    """video, candidate, score, x, y: in order of score each joins the first cluster, in order of their beginning, whose
    centre is within the radius, or begins one; a centre is the mean weighted by score. Adds cluster. Every choice depends
    on all before it, so a video's candidates, which a scan of some dozen frames gives, are one task's."""
    ship_package(points.sparkSession)

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "candidate"], ascending=[False, True])
        sums, own = np.zeros((0, 3)), []
        for x, y, score in zip(group["x"], group["y"], np.maximum(group["score"], 1e-6), strict=True):
            near = np.flatnonzero(np.hypot(sums[:, 0] / sums[:, 2] - x, sums[:, 1] / sums[:, 2] - y) <= radius)
            if not len(near):
                sums, near = np.vstack([sums, np.zeros(3)]), [len(sums)]
            sums[near[0]] += (x * score, y * score, score)
            own.append(near[0])
        return group.assign(cluster=np.array(own, np.int32))

    return points.groupBy("video").applyInPandas(assign, T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType())]))


def cluster_scores(clustered: DataFrame, preferred_frame: int | None = None, stable_share: float = 0.65) -> DataFrame:
    """One row a cluster: its score (median of its candidates' scores times ln(1 + frames)), frames, candidates, and the
    stable one among those of at least a share of its best score: the earliest, or the nearest to the preferred frame."""
    best = F.max("score").over(Window.partitionBy("video", "cluster"))
    order = F.struct("frame", "candidate") if preferred_frame is None else F.struct(F.abs(F.col("frame") - preferred_frame), -F.col("score"), F.col("candidate"))
    stable = F.col("score") >= stable_share * F.col("_best")
    out = clustered.withColumn("_best", best).groupBy("video", "cluster").agg(
        F.count_distinct("frame").alias("n_frames"), F.count("*").alias("n_candidates"), F.percentile("score", F.lit(0.5)).alias("median"), F.min_by(F.when(stable, F.col("candidate")), F.when(stable, order)).alias("candidate")
    )
    return out.withColumn("cluster_score", F.col("median") * F.log1p("n_frames")).drop("median")


def near_best(rows: DataFrame, keys: list[str], share: float, score: str = "score") -> DataFrame:
    """Rows with at least that share of their group's best score."""
    return rows.withColumn("_best", F.max(score).over(Window.partitionBy(*keys))).filter(F.col(score) >= share * F.col("_best")).drop("_best")


def choose_detector(first: DataFrame, second: DataFrame, expected: DataFrame, key: str = "video") -> DataFrame:
    """The first detector's prompts where it found as many as expected, else the second's if that did; source says which,
    none that neither did. first, second: key and what a prompt holds; expected: key, expected."""
    def enough(df: DataFrame) -> DataFrame:
        n = df.groupBy(key).agg(F.count("*").alias("n"))
        return expected.join(n, key).filter("n = expected").select(key)

    ok1, ok2 = enough(first), enough(second)
    ok2 = ok2.join(ok1, key, "left_anti")
    neither = expected.select(key).join(ok1.unionByName(ok2), key, "left_anti")
    tag = lambda ok, name: ok.withColumn("source", F.lit(name))
    chosen = tag(ok1, "first").unionByName(tag(ok2, "second")).unionByName(tag(neither, "none"))
    prompts = first.withColumn("source", F.lit("first")).unionByName(second.withColumn("source", F.lit("second")))
    return chosen.join(prompts, [key, "source"], "left")
