"""Sequence functions over one object's frames. All share the partitioning of their keys, so one shuffle serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.exprs import ln


def ordered(keys: list[str], by: str = "frame"):
    return Window.partitionBy(*keys).orderBy(by)


def whole(w):
    """All rows of the group, in w's order: one pass over the rows then serves these and w's own functions."""
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def gradient(s: str, t: str, w) -> Column:
    """Second order inside, by uneven steps; one-sided at the ends; null for a single row."""
    before, after = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    last, following = F.lag(s).over(w), F.lead(s).over(w)
    inside = (before**2 * following + (after**2 - before**2) * F.col(s) - after**2 * last) / (before * after * (before + after))
    return F.coalesce(inside, (following - F.col(s)) / after, (F.col(s) - last) / before)


def moving_average(s: str, keys: list[str], width: int = 5, by: str = "frame") -> Column:
    """Box filter with the end values repeated beyond the ends; series shorter than the width stay."""
    half = width // 2
    w, every = ordered(keys, by), whole(ordered(keys, by))
    i, n = F.row_number().over(w) - 1, F.count("*").over(every)
    inside = F.sum(s).over(w.rowsBetween(-half, half))
    low = F.greatest(half - i, F.lit(0)) * F.first(s).over(every)
    high = F.greatest(i - (n - 1 - half), F.lit(0)) * F.last(s).over(every)
    return F.when(n < width, F.col(s)).otherwise((inside + low + high) / width)


def numbered(df: DataFrame, keys: list[str], by: str = "frame") -> DataFrame:
    """Adds i, the place of a row, and n, the rows of its group."""
    w = ordered(keys, by)
    return df.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(whole(w))})


def middle(df: DataFrame, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Of numbered rows, those in the middle window."""
    return df.filter((F.col("i") >= F.floor(F.col("n") * low)) & (F.col("i") < F.ceil(F.col("n") * high)))


def log_jump(area: str, w) -> Column:
    """Change of the logarithm from the last row; infinite to or from 0."""
    return F.abs(ln(area) - ln(F.lag(area).over(w)))


def step(x: str, y: str, w) -> Column:
    """Way from the last row, if both have a place."""
    return F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w))


def bridged_step(x: str, y: str, w) -> Column:
    """Way from the last row that has a place."""
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return F.hypot(F.col(x) - F.last(x, ignorenulls=True).over(before), F.col(y) - F.last(y, ignorenulls=True).over(before))


def primary(df: DataFrame, video: list[str], object_id: str = "object_id", k: int = 1) -> DataFrame:
    """The rows of each video's k objects with most points, ties to the smaller id; adds place. Counts are ranked, not rows,
    so a video of any size is no single task's."""
    counts = df.groupBy(*video, object_id).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(*video).orderBy(F.desc("_n"), object_id))
    chosen = counts.withColumn("place", place).filter(F.col("place") <= k).drop("_n")
    return df.join(chosen, [*video, object_id])


def densified(df: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """A row for each frame from 0 to the last, null where there was none."""
    spans = df.groupBy(*keys).agg(F.max(frame).alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias(frame))
    return spans.join(df.withColumn(frame, F.col(frame).cast("long")), [*keys, frame], "left")


def uniform_sample(df: DataFrame, keys: list[str], k: int, by: str = "frame") -> DataFrame:
    """At most k rows of each group at even places, the first and the last among them."""
    d = numbered(df, keys, by)
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.floor(j * (F.col("n") - 1) / (k - 1)).cast("int"))
    return d.filter((F.col("n") <= k) | F.array_contains(picked, F.col("i").cast("int")))


def stride_sample(df: DataFrame, keys: list[str], stride: int = 5, by: str = "frame") -> DataFrame:
    """Every so many rows of each group, and the middle one."""
    d = numbered(df, keys, by)
    return d.filter((F.col("i") % stride == 0) | (F.col("i") == F.floor(F.col("n") / 2)))
