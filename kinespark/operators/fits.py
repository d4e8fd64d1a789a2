"""Fits and statistics of series by closed forms: one shuffle on the keys, sums about the group's own means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.exprs import EPS, finite, positive


def centred(df: DataFrame, keys: list[str], **columns) -> DataFrame:
    """Adds each column less its mean over the group. Only rows where all of them are finite stay."""
    w = Window.partitionBy(*keys)
    values = {n: finite(c) for n, c in columns.items()}
    out = df.withColumns(values).dropna(subset=[*values])
    return out.withColumns({n: F.col(n) - F.avg(n).over(w) for n in values} | {f"{n}_mean": F.avg(n).over(w) for n in values})


def _r2(left: Column, total: Column) -> Column:
    """1 - left / total; a constant series is fitted perfectly or not at all."""
    flat = F.when(left <= EPS, 1.0).otherwise(0.0)
    return F.when(total <= EPS, flat).otherwise(1 - left / total)


def line_of(n: str, uu: str, uv: str, vv: str) -> Column:
    """slope and r2 from centred sums; null below three points."""
    slope = F.when((F.col(n) >= 3) & (F.col(uu) > 0), F.try_divide(uv, uu))
    left = F.greatest(F.col(vv) - slope * F.col(uv), F.lit(0.0))
    return F.struct(slope.alias("slope"), F.when(slope.isNotNull(), _r2(left, F.col(vv))).alias("r2"))


def parabola_of(n: str, s2: str, s3: str, s4: str, uv: str, uuv: str, vv: str) -> Column:
    """a of a t^2 + b t + c and r2 from centred sums; null below four points."""
    spread = F.col(s4) - F.col(s2) ** 2 / F.col(n)
    det = F.col(s2) * spread - F.col(s3) ** 2
    a = F.when((F.col(n) >= 4) & (det > 0), F.try_divide(F.col(s2) * F.col(uuv) - F.col(s3) * F.col(uv), det))
    b = F.try_divide(F.col(uv) * spread - F.col(s3) * F.col(uuv), det)
    left = F.greatest(F.col(vv) - b * F.col(uv) - a * F.col(uuv), F.lit(0.0))
    return F.struct(a.alias("a"), F.when(a.isNotNull(), _r2(left, F.col(vv))).alias("r2"))


def axis_of(n: str, xx: str, yy: str, xy: str) -> Column:
    """x, y of the main axis and one_dim = 1 - smaller / larger eigenvalue, from centred sums. The axis points to where its
    larger part is positive."""
    sum_, gap, cross = F.col(xx) + F.col(yy), F.col(xx) - F.col(yy), 2 * F.col(xy)
    root, angle = F.hypot(gap, cross), F.atan2(cross, gap) / 2
    large, small = (sum_ + root) / 2, F.greatest((sum_ - root) / 2, F.lit(0.0))
    flip = F.when(F.when(F.abs(F.cos(angle)) >= F.abs(F.sin(angle)), F.cos(angle)).otherwise(F.sin(angle)) < 0, -1.0).otherwise(1.0)
    one = F.when(F.col(n) < 3, 0.0).when(F.sqrt(large) <= EPS, 1.0).otherwise(1 - F.try_divide(small, large))
    return F.struct((F.cos(angle) * flip).alias("x"), (F.sin(angle) * flip).alias("y"), one.alias("one_dim"))


def linear_fit(df: DataFrame, keys: list[str], t: str = "t", s: str = "s") -> DataFrame:
    """n, slope, intercept, r2; null fits below three points."""
    c = centred(df, keys, _u=F.col(t), _v=F.col(s))
    m = c.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_u") ** 2).alias("uu"), F.sum(F.col("_u") * F.col("_v")).alias("uv"), F.sum(F.col("_v") ** 2).alias("vv"), F.first("_u_mean").alias("mu"), F.first("_v_mean").alias("mv")
    )
    m = m.withColumn("f", line_of("n", "uu", "uv", "vv"))
    return m.select(*keys, "n", "f.slope", (F.col("mv") - F.col("f.slope") * F.col("mu")).alias("intercept"), "f.r2")


def quadratic_fit(df: DataFrame, keys: list[str], t: str = "t", s: str = "s") -> DataFrame:
    """n, a, b, c of a t^2 + b t + c, and r2; null fits below four points."""
    c = centred(df, keys, _u=F.col(t), _v=F.col(s))
    u, v = F.col("_u"), F.col("_v")
    m = c.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(u**2).alias("s2"), F.sum(u**3).alias("s3"), F.sum(u**4).alias("s4"), F.sum(u * v).alias("uv"), F.sum(u**2 * v).alias("uuv"), F.sum(v**2).alias("vv"),
        F.first("_u_mean").alias("mu"), F.first("_v_mean").alias("mv"),
    )
    spread = F.col("s4") - F.col("s2") ** 2 / F.col("n")
    m = m.withColumn("det", F.col("s2") * spread - F.col("s3") ** 2)
    a = F.try_divide(F.col("s2") * F.col("uuv") - F.col("s3") * F.col("uv"), F.col("det"))
    m = m.withColumn("a", F.when((F.col("n") >= 4) & (F.col("det") > 0), a))
    m = m.withColumn("b0", F.try_divide(F.col("uv") * spread - F.col("s3") * F.col("uuv"), F.col("det")))
    m = m.withColumn("b", F.col("b0") - 2 * F.col("a") * F.col("mu"))
    m = m.withColumn("c", F.col("mv") - F.col("a") * F.col("s2") / F.col("n") - F.col("b0") * F.col("mu") + F.col("a") * F.col("mu") ** 2)
    left = F.greatest(F.col("vv") - F.col("b0") * F.col("uv") - F.col("a") * F.col("uuv"), F.lit(0.0))
    return m.withColumn("r2", F.when(F.col("a").isNotNull(), _r2(left, F.col("vv")))).select(*keys, "n", "a", "b", "c", "r2")


def principal_axis(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n, axis_x, axis_y, mean_x, mean_y and one_dim = 1 - smaller / larger eigenvalue. The axis points to where its larger
    part is positive."""
    c = centred(df, keys, _x=F.col(x), _y=F.col(y))
    m = c.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_x") ** 2).alias("xx"), F.sum(F.col("_y") ** 2).alias("yy"), F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.first("_x_mean").alias("mean_x"), F.first("_y_mean").alias("mean_y")
    )
    return m.withColumn("f", axis_of("n", "xx", "yy", "xy")).select(*keys, "n", F.col("f.x").alias("axis_x"), F.col("f.y").alias("axis_y"), "mean_x", "mean_y", "f.one_dim")


def axis_fit(df: DataFrame, keys: list[str], t: str = "t", x: str = "x", y: str = "y") -> DataFrame:
    """n, slope and r2 of the place along the main axis against t: the axis turns the sums, so one grouping does both."""
    c = centred(df, keys, _u=F.col(t), _x=F.col(x), _y=F.col(y))
    u, v, w = F.col("_u"), F.col("_x"), F.col("_y")
    m = c.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(u * u).alias("uu"), F.sum(u * v).alias("ux"), F.sum(u * w).alias("uy"), F.sum(v * v).alias("xx"), F.sum(w * w).alias("yy"), F.sum(v * w).alias("xy"))
    m = m.withColumn("f", axis_of("n", "xx", "yy", "xy"))
    a, b = F.col("f.x"), F.col("f.y")
    m = m.withColumn("uv", a * F.col("ux") + b * F.col("uy")).withColumn("vv", a * a * F.col("xx") + b * b * F.col("yy") + 2 * a * b * F.col("xy"))
    return m.withColumn("g", line_of("n", "uu", "uv", "vv")).select(*keys, "n", "g.slope", "g.r2")


def variation(c, zero: bool = False) -> Column:
    """Standard deviation over mean of the positive values, or with zero of all values; null below two (with zero, below one)."""
    if zero:
        return F.stddev_pop(c) / F.greatest(F.avg(c), F.lit(EPS))
    v = positive(c)
    return F.when(F.count(v) >= 2, F.stddev_pop(v) / F.greatest(F.avg(v), F.lit(EPS)))


def median_positive(c) -> Column:
    return F.percentile(positive(c), F.lit(0.5))


def coverage(frame="frame") -> Column:
    """Rows over the frames between first and last."""
    return F.count("*") / (F.max(frame) - F.min(frame) + 1)
