"""Is a table still what it was? Fingerprints of tables as multisets of rows.

A row's hash covers every column and whether it is null; a table's fingerprint has the number of rows, two sums of hashes of
different seeds and the exclusive or of a third. None depends on order or partitioning, and partial ones add up, so a fingerprint is
one aggregate whose rows don't move. A tree has one fingerprint for each bucket of a key: two trees are compared first, then only
rows of buckets that differ, which tells what was changed, lost or repeated without moving the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, PARTS = 1024, ["n", "sum_a", "sum_b", "mixed"]


class ChangedInputs(ValueError):
    """A table that was to stay the same did not."""


def _hashable(df: DataFrame, columns: list[str]) -> list[Column]:
    """Maps have no hash: their JSON, by sorted entries, stands in, as does that of variants."""
    out = []
    for c in columns:
        kind, col = df.schema[c].dataType, F.col(f"`{c}`")
        own = F.to_json(F.array_sort(F.map_entries(col))) if isinstance(kind, T.MapType) else F.to_json(col) if isinstance(kind, T.VariantType) else col
        out += [col.isNull(), own]
    return out


def row_hash(df: DataFrame, seed: int, columns: list[str] | None = None) -> Column:
    """Nulls count by their place."""
    return F.xxhash64(F.lit(seed), *_hashable(df, sorted(columns or df.columns)))


def _parts(df: DataFrame, columns: list[str] | None) -> list[Column]:
    whole = T.DecimalType(38, 0)
    sums = [F.sum(row_hash(df, k, columns).cast(whole)).cast("string").alias(name) for k, name in ((1, "sum_a"), (2, "sum_b"))]
    return [F.count("*").alias("n"), *sums, F.bit_xor(row_hash(df, 3, columns)).alias("mixed")]


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: n, sum_a, sum_b, mixed. The columns' order doesn't matter, their names and types do."""
    return df.agg(*_parts(df, columns))


def tree(df: DataFrame, keys: list[str], buckets: int = BUCKETS, columns: list[str] | None = None) -> DataFrame:
    """The fingerprint of each bucket of the keys."""
    return df.groupBy(bucket(df, keys, buckets).alias("bucket")).agg(*_parts(df, columns))


def bucket(df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(row_hash(df, 0, keys), F.lit(buckets)).cast("int")


def differing(before: DataFrame, after: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """keys, change (new, lost, repeated, fewer, changed), and how many rows of the key were there before and after. Both
    tables have the same columns; keys may be null and needn't be unique."""
    a, b = tree(before, keys, buckets), tree(after, keys, buckets)
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in PARTS])
    odd = a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full_outer").filter(~same).select(F.coalesce("a.bucket", "b.bucket").alias("bucket"))
    names = ["_bucket", "_key", "_row", "_side"]
    while {*names} & {*before.columns}:
        names = [f"_{n}" for n in names]
    at, key, row, side = names

    def rows(df: DataFrame, which: int) -> DataFrame:
        own = df.select(bucket(df, keys, buckets).alias(at), F.struct(*[F.col(f"`{k}`") for k in keys]).alias(key), F.struct(row_hash(df, 1), row_hash(df, 2)).alias(row), F.lit(which).alias(side))
        return own.join(odd.withColumnRenamed("bucket", at), at, "left_semi")

    both = rows(before, 0).unionByName(rows(after, 1))
    on = lambda k, c: F.count_if(F.col(side) == k).alias(c)
    each = both.groupBy(key, row).agg(on(0, "before"), on(1, "after"))
    out = each.groupBy(key).agg(F.sum("before").alias("n_before"), F.sum("after").alias("n_after"), F.count_if((F.col("before") > 0) & (F.col("after") == 0)).alias("gone"), F.count_if((F.col("before") == 0) & (F.col("after") > 0)).alias("fresh"), F.count_if(F.col("before") != F.col("after")).alias("off")).filter("off > 0")
    change = F.when(F.col("n_before") == 0, "new").when(F.col("n_after") == 0, "lost").when((F.col("gone") == 0) & (F.col("fresh") == 0) & (F.col("n_after") > F.col("n_before")), "repeated").when((F.col("gone") == 0) & (F.col("fresh") == 0) & (F.col("n_after") < F.col("n_before")), "fewer").otherwise("changed")
    return out.select(*[F.col(f"{key}.`{k}`").alias(k) for k in keys], change.alias("change"), "n_before", "n_after")


def proven(read: Callable[[], DataFrame], study: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]) -> dict:
    """Reads a table, writes what a study makes of it, reads the table again and refuses if it isn't the same; the
    fingerprint that both have."""
    df = read()
    before = fingerprint(df).first().asDict()
    write(study(df))
    after = fingerprint(read()).first().asDict()
    if before != after:
        raise ChangedInputs(f"inputs changed while they were studied: {before} became {after}")
    return before
