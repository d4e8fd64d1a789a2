"""Re-runs that touch only what changed.

A store is a folder with results by bucket of their video, each row with the hash of what it was made from (its metadata and
its document). A run hashes the inputs, compares hashes by a join on video (texts don't move), evaluates the videos that are
new or changed, and rewrites the buckets that hold changed or lost videos by dynamic partition overwrite; other buckets'
files stay as they are. A run over unchanged inputs writes nothing. The rewritten buckets replace the old ones when all tasks
have ended, so a failed run leaves the store as it was and may be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark import pipeline
from kinespark.session import scratch

BUCKETS = 64


def fingerprints(metadata: DataFrame, documents: DataFrame, version: str = "1") -> DataFrame:
    """prompt_id and the hash of its metadata and document; version names the rules, so that new rules change all."""
    rows = metadata.select(F.col("Prompt_ID").alias("prompt_id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(metadata.columns)]), {"ignoreNullFields": "false"}).alias("row"))
    texts = documents.select(F.col("video").alias("prompt_id"), F.sha2("text", 256).alias("text"))
    said = F.concat_ws("|", F.lit(version), "row", F.coalesce("text", F.lit("-")))
    return rows.join(texts, "prompt_id", "left").select("prompt_id", F.sha2(said, 256).alias("made_from"))


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The rows of a store; none before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(store)


def run(metadata: DataFrame, documents: DataFrame, store: str, version: str = "1", buckets: int = BUCKETS, **options) -> dict[str, int]:
    """Brings the store up to date; counts of videos: new, changed, lost, same. options go to ``pipeline.evaluate``."""
    spark = metadata.sparkSession
    now, old = fingerprints(metadata, documents, version), stored(spark, store)
    had = old.select("prompt_id", F.col("made_from").alias("had")) if old is not None else spark.createDataFrame([], "prompt_id string, had string")
    state = F.when(F.col("had").isNull(), "new").when(F.col("made_from").isNull(), "lost").when(F.col("had") == F.col("made_from"), "same").otherwise("changed")
    path = scratch(spark, "states")
    now.join(had, "prompt_id", "full_outer").withColumns({"state": state, "bucket": F.pmod(F.xxhash64("prompt_id"), F.lit(buckets)).cast("int")}).write.parquet(path)
    states = spark.read.parquet(path)
    counts = {"new": 0, "changed": 0, "lost": 0, "same": 0} | {r["state"]: r["n"] for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    if not counts["new"] + counts["changed"] + counts["lost"]:
        return counts
    todo = states.filter("state in ('new', 'changed')").select("prompt_id", "made_from", "bucket")
    ids = todo.select("prompt_id")
    some = metadata.join(ids.withColumnRenamed("prompt_id", "Prompt_ID"), "Prompt_ID", "left_semi")
    texts = documents.join(ids.withColumnRenamed("prompt_id", "video"), "video", "left_semi")
    out = pipeline.evaluate(some, texts, **options).join(todo, "prompt_id")
    if old is not None:
        touched = states.filter("state <> 'same'").select("bucket").distinct()
        kept = old.join(touched, "bucket", "left_semi").join(states.filter("state = 'same'").select("prompt_id"), "prompt_id", "left_semi")
        out = out.unionByName(kept, allowMissingColumns=True)
        emptied = touched.join(out.select("bucket").distinct(), "bucket", "left_anti")
        gone = [r["bucket"] for r in emptied.collect()]  # at most so many as there are buckets
    path = scratch(spark, "results")
    out.write.parquet(path)
    fresh = spark.read.parquet(path).repartition("bucket")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(store)
    if old is not None:
        for bucket in gone:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/bucket={bucket}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return counts
