"""Exact percentiles of groups of any size: no task ever holds a group's values.

A double's bits, with those of negative numbers turned, order like the double itself. Four rounds find 16 bits each: all
groups at once count their values by the next 16 bits, among the values that share the bits found so far; running counts
tell in which bin a rank lies, and the next round looks into that bin alone. Only counts are gathered, at most 65,536 for a
rank and round, and they are summed where the rows are before they move. So a group that holds most rows costs no more than others.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, BITS = 4, 16


def ordered_bits(value: Column) -> Column:
    """A long that orders like the double. Minus zero is zero; what isn't a number comes last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF)))


def _bin(bits: Column, k: int) -> Column:
    """The next 16 bits in round k; the first ones keep the sign."""
    moved = F.shiftright(bits, 64 - BITS * (k + 1))
    return moved if k == 0 else moved.bitwiseAND(F.lit((1 << BITS) - 1))


def percentiles(df: DataFrame, keys: list[str], stats: dict[str, tuple[str, float]], values: dict[str, Column]) -> DataFrame:
    """keys and a column for each of stats: (name of a value, share from 0 to 1). Nulls don't count; a group without a value
    has null. Between two values the percentile lies on the line between them, like Spark's ``percentile``. Keys may be null."""
    if any(not 0 <= share <= 1 for _, share in stats.values()) or any(name not in values for name, _ in stats.values()):
        raise ValueError("shares lie between 0 and 1, of values that are given")
    one = F.array(*[F.struct(F.lit(n).alias("series"), v.cast("double").alias("value")) for n, v in values.items()])
    group = F.struct(*[F.col(k) for k in keys], "e.series")
    long = df.select(*keys, F.explode(one).alias("e")).filter("e.value is not null").select(group.alias("g"), (F.col("e.value") + F.lit(0.0)).alias("value"))
    long = long.withColumn("bits", ordered_bits(F.col("value"))).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = long.groupBy("g").agg(F.count("*").alias("n"))
    place = {s: F.when(F.col("g.series") == name, (F.col("n") - 1) * F.lit(float(share))) for s, (name, share) in stats.items()}
    ranks = F.array_distinct(F.array_compact(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)])))
    wanted = sizes.select("g", F.explode(ranks).alias("rank")).select("*", F.col("rank").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for k in range(ROUNDS):
        last = k == ROUNDS - 1
        before = F.shiftright("bits", 64 - BITS * k) if k else F.lit(0).cast("long")
        some = long.select("g", before.alias("prefix"), _bin(F.col("bits"), k).alias("bin"), "value")
        some = some.join(wanted.select("g", "prefix").distinct(), ["g", "prefix"], "left_semi") if k else some
        counts = some.groupBy("g", "prefix", "bin").agg(F.count("*").alias("c"), *([F.min("value").alias("value")] if last else []))
        w = Window.partitionBy("g", "prefix").orderBy("bin")
        counts = counts.withColumn("through", F.sum("c").over(w))
        found = wanted.join(counts, ["g", "prefix"]).filter((F.col("left") < F.col("through")) & (F.col("left") >= F.col("through") - F.col("c")))
        own = [(F.col("left") - F.col("through") + F.col("c")).alias("left"), (F.shiftleft("prefix", BITS) + F.col("bin") if k else F.col("bin")).alias("prefix")]
        # a few rows a group, used twice by the next round
        wanted = found.select("g", "rank", *own, *(["value"] if last else [])).persist(StorageLevel.MEMORY_AND_DISK)
    both = wanted.select("g", "rank", "value").join(sizes, "g")
    at = lambda s, f: F.max(F.when(F.col("rank") == f(place[s]), F.col("value")))
    share = {s: F.max(p - F.floor(p)) for s, p in place.items()}
    out = both.groupBy("g").agg(*[F.struct(at(s, F.floor).alias("low"), at(s, F.ceil).alias("high"), share[s].alias("share")).alias(s) for s in stats])
    line = lambda s: F.when(F.col(f"{s}.share") > 0, F.col(f"{s}.low") * (1 - F.col(f"{s}.share")) + F.col(f"{s}.high") * F.col(f"{s}.share")).otherwise(F.col(f"{s}.low"))
    flat = out.select(*[F.col(f"g.{k}").alias(k) for k in keys], *[line(s).alias(s) for s in stats])
    return flat.groupBy(*keys).agg(*[F.max(s).alias(s) for s in stats])
