"""Reports and tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions.exprs import slug


def write_estimates(df: DataFrame, path: str) -> None:
    """The system of record: Parquet by metric."""
    df.write.mode("overwrite").partitionBy("metric").parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def reason_report(counts: DataFrame) -> DataFrame:
    """The most frequent reason first, ties by name."""
    return counts.orderBy(F.desc("n"), "reason")


def output_path(metric: str = "metric", prompt_id: str = "prompt_id"):
    """Where a video's own outputs go, as a column."""
    return F.concat_ws("/", slug(metric), slug(prompt_id))
