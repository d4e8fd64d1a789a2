"""Data-quality rules over rows and over groups of rows, reported in one pass.

A rule about rows gives a text where a row breaks it. A rule about groups gives each row a key and a value; keys that come
more than once, or with more than one value, break it. All rows give their findings and keys together, and one grouping
with partial sums does the rest, however many rules there are and however hot a key is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowRule:
    """detail: null where the row is right, else what is wrong. severity ok counts rows that pass a check."""

    name: str
    severity: str
    detail: Column


@dataclass(frozen=True)
class GroupRule:
    """key: null where the row takes no part. Broken by a key that comes twice or, with differ, that has two values."""

    name: str
    severity: str
    key: Column
    value: Column
    differ: bool = False


Rule = RowRule | GroupRule


def report(rows: DataFrame, rules: Sequence[Rule], subject: Column) -> DataFrame:
    """rule, severity, scope (row or table), subject, detail, n. Of a row rule, subject names the row and n counts rows of
    that subject and detail (for severity ok there is one line, without subject); of a group rule, subject is the key, detail
    the smallest and largest value and n the rows. No rows, or none that break a rule: no lines. Nulls break no rule by
    themselves."""
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    entries = []
    for k, r in enumerate(rules):
        if isinstance(r, RowRule):
            ok = r.severity == "ok"
            entries.append(F.when(r.detail.isNotNull(), F.struct(F.lit(k).alias("k"), (none if ok else text(subject)).alias("subject"), text(r.detail).alias("detail"), none.alias("value"))))
        else:
            entries.append(F.when(r.key.isNotNull(), F.struct(F.lit(k).alias("k"), text(r.key).alias("subject"), none.alias("detail"), text(r.value).alias("value"))))
    # the entries are a column of their own, and nulls go after they are dealt out: a function over the array, or the array
    # within explode, would make Spark interpret all rules instead of compiling them; where explode isn't outer, Spark first
    # drops rows without entries, for which it applies all rules once more
    each = rows.select(F.array(*entries).alias("_all")).select(F.explode_outer("_all").alias("e")).filter("e is not null").select("e.*")
    # the subject first: its first bytes, unlike the rule's number, tell most rows apart when Spark sorts them
    found = each.groupBy("subject", "k", "detail").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    by = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in rules]), F.col("k") + 1)
    kind = by(lambda r: "row" if isinstance(r, RowRule) else "differ" if r.differ else "twice")
    broken = F.when(kind == "row", True).when(kind == "differ", F.col("low") != F.col("high")).otherwise(F.col("n") > 1)
    values = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.concat_ws(" and ", "low", "high"))
    return found.filter(broken).select(
        by(lambda r: r.name).alias("rule"), by(lambda r: r.severity).alias("severity"), F.when(kind == "row", "row").otherwise("table").alias("scope"), "subject",
        F.when(kind == "row", F.col("detail")).otherwise(F.nullif(values, F.lit(""))).alias("detail"), "n",
    )


def readiness(found: DataFrame) -> DataFrame:
    """One row: ok, warnings and errors (lines of the report) and ready, which no errors are."""
    n = lambda s: F.coalesce(F.count_if(F.col("severity") == s), F.lit(0))
    return found.agg(n("ok").alias("ok"), n("warning").alias("warnings"), n("error").alias("errors"), (n("error") == 0).alias("ready"))
