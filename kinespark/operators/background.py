"""What moves in a video: images as rows of arrays, their temporal median, and regions of pixels that differ from it.

rows: keys, frame, y and values, an array of the grey values of one row of one scanned frame. A pixel is never a row of a
table: medians, differences, thresholds and morphology are functions of arrays, and runs go on to ``regions``. A cell's median
needs the row at y of all scanned frames together (some dozen arrays); morphology needs neighbouring rows, by windows over a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.operators import regions


def median_background(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, background: the median over frames of each cell, without its fraction."""
    v = F.col("v")
    low, high = F.floor((F.size(v) - 1) / 2).cast("int"), F.floor(F.size(v) / 2).cast("int")

    def cell(i: Column) -> Column:
        own = F.array(F.array_sort(F.transform(v, lambda a: F.get(a, i))))
        return F.get(F.transform(own, lambda s: F.floor((F.get(s, low) + F.get(s, high)) / 2).cast("int")), F.lit(0))

    every = F.sequence(F.lit(0), F.size(F.get(v, F.lit(0))) - 1)
    return rows.groupBy(*keys, "y").agg(F.collect_list("values").alias("v")).select(*keys, "y", F.transform(every, cell).alias("background"))


def from_background(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with diff, the distance from the background."""
    joined = rows.join(median_background(rows, keys), [*keys, "y"])
    return joined.withColumn("diff", F.zip_with("values", "background", lambda a, b: F.abs(a - b))).drop("background")


def from_last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with diff, the distance from the scanned frame before; the first frame has none."""
    before = F.lag("values").over(Window.partitionBy(*keys, "y").orderBy("frame"))
    return rows.withColumn("before", before).filter("before is not null").withColumn("diff", F.zip_with("values", "before", lambda a, b: F.abs(a - b))).drop("before")


def _spread(masks: DataFrame, keys: list[str], pick) -> DataFrame:
    """Each cell becomes the greatest or least of its 3 by 3 neighbours; what lies outside of the image doesn't count."""
    m, w = F.col("mask"), Window.partitionBy(*keys, "frame").orderBy("y")
    beside = F.transform(m, lambda v, i: pick(F.get(m, i - 1), v, F.get(m, i + 1)))
    out = masks.withColumn("mask", beside)
    near = lambda r: F.coalesce(r, F.col("mask"))
    out = out.withColumns({"up": near(F.lag("mask").over(w)), "down": near(F.lead("mask").over(w))})
    joined = F.zip_with(F.zip_with("up", "mask", lambda a, b: pick(a, b)), "down", lambda a, b: pick(a, b))
    return out.withColumn("mask", joined).drop("up", "down")


def cleaned(masks: DataFrame, keys: list[str]) -> DataFrame:
    """mask (arrays of 0 and 1, a row for each y of a frame) opened once, so specks go, and closed twice, so gaps close."""
    for pick in (F.least, F.greatest, F.greatest, F.greatest, F.least, F.least):
        masks = _spread(masks, keys, pick)
    return masks


def runs_of(masks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, y, x0, x1 of the stretches of ones."""
    m = F.col("mask")
    every = F.sequence(F.lit(0), F.size(m) - 1)
    edge = lambda step: F.filter(every, lambda i: (F.get(m, i) == 1) & (F.coalesce(F.get(m, i + step), F.lit(0)) == 0))
    pairs = F.arrays_zip(edge(-1).alias("x0"), edge(1).alias("x1"))
    return masks.filter(F.size(m) > 0).select(*keys, "frame", "y", F.explode(pairs).alias("r")).select(*keys, "frame", "y", "r.x0", "r.x1")


def moving_regions(rows: DataFrame, keys: list[str], threshold: float = 28, least: int = 80, clean: bool = True) -> DataFrame:
    """The regions (``regions.regions``) of at least so many pixels over the threshold from the background, with method
    median_background; of videos that have none anywhere, those against the frame before: pairwise_frame_difference."""

    def found(diffs: DataFrame, method: str) -> DataFrame:
        masks = diffs.select(*keys, "frame", "y", F.transform("diff", lambda v: (v > threshold).cast("int")).alias("mask"))
        own = regions.regions(runs_of(cleaned(masks, keys) if clean else masks, keys), keys, least)
        return own.withColumn("method", F.lit(method))

    first = found(from_background(rows, keys), "median_background")
    rest = rows.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.unionByName(found(from_last(rest, keys), "pairwise_frame_difference"))
