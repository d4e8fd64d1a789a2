"""Frame streams in any split against the batch gate, timers, and evaluators of one's own."""

import random

import pytest
from pyspark.sql import functions as F

from kinespark.operators import gates, own
from kinespark.streaming import frames

ROWS = "video string, object_id string, ts timestamp, frame long, x double, y double, valid boolean, diameter double"


def frame_rows(videos=6, n=40):
    rng, out = random.Random(4), []
    for v in range(videos):
        for o in range(1 + v % 2):
            for f in range(n):
                lost = rng.random() < 0.2 + 0.1 * v
                place = (None, None) if lost else (rng.uniform(0, 9), f * (0.2 + v % 3))
                out.append((f"v{v}", f"o{o}", (f + 1) * 1000, f, *place, None if rng.random() < 0.3 else not lost, rng.choice([None, 4.0, 5.5, 7.0])))
    return out


def streamed(spark, rows, parts, tmp_path, late="10 minutes", silence_ms=10**9):
    for k, v in frames.STORE.items():
        spark.conf.set(k, v)
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, ROWS.replace("ts timestamp", "ms long")).withColumn("ts", F.timestamp_millis("ms"))
        df.select("video", "object_id", "ts", "frame", "x", "y", "valid", "diameter").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={k:03}"))
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/part=*"))
    out = str(tmp_path / "out")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    frames.running_objects(stream, late, silence_ms).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def gate_rows(df):
    return sorted((r.video, r.frames, r.counted, r.primary_object, r.path_norm and round(r.path_norm, 9), r.extent_norm and round(r.extent_norm, 9), tuple(r.reasons), r.status) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 4])
def test_any_split_gives_the_batch_gate(spark, tmp_path, batches):
    rows = frame_rows()
    random.Random(batches).shuffle(rows)
    parts = [rows[k::batches] for k in range(batches)]
    out = streamed(spark, rows, parts, tmp_path)
    batch = spark.createDataFrame(rows, ROWS.replace("ts timestamp", "ms long"))
    expected = spark.createDataFrame([(f"v{k}", 1 + k % 2) for k in range(6)], "video string, expected int")
    assert gate_rows(frames.gate_of(frames.latest(out.drop("batch")), expected)) == gate_rows(gates.tracking_gate(batch, expected))


def test_silent_objects_are_closed(spark, tmp_path):
    early = [("v", "o", (k + 1) * 1000, k, float(k), 0.0, True, 5.0) for k in range(10)]
    later = [("w", "o", 3_600_000 + k, k, 1.0, 1.0, True, 5.0) for k in range(3)]
    out = streamed(spark, early + later, [early[:5], early[5:], later, [("w", "o", 3_700_000, 9, 2.0, 1.0, True, 5.0)]], tmp_path, "1 minute", 60_000)
    closed = out.filter("closed").collect()
    assert [(r.video, r.frames, r.n_valid, r.path, r.extent, r.diameter) for r in closed] == [("v", 10, 10, 9.0, 9.0, 5.0)]
    assert {(r.video, r.frames) for r in frames.latest(out.drop("batch")).collect()} == {("v", 10), ("w", 4)}


def test_own_evaluators(spark):
    tracks = [(v, "1", f, f / 30, 5.0 * f * (v == "a") + (f % 3 if v == "b" else 0), 1.0) for v in "abc" for f in range(20)]
    tracks = spark.createDataFrame(tracks, "video string, object_id string, frame long, t double, cx double, cy double").repartition(3)
    meta = spark.createDataFrame([("a", "line", 100.0), ("b", "breaks", 1.0), ("c", "other", 1.0), ("d", "line", 1.0)], "video string, evaluator string, target_value double")

    def breaks(track, row):
        raise ValueError(f"no {row['video']}")

    got = {r.video: r for r in own.estimate(tracks, meta, {"line": own.line_speed, "breaks": breaks}).collect()}
    assert set(got) == {"a", "b", "d"}
    assert got["a"].measured == pytest.approx(150) and got["a"].status == "valid" and got["a"].error == pytest.approx(0.5)
    assert (got["b"].status, got["b"].reason, got["b"].measured) == ("failed", "ValueError: no b", None)
    assert (got["d"].status, got["d"].reason) == ("failed", "tracking_missing")


def test_table_functions_in_sql(spark):
    tracks = spark.createDataFrame([("a", k, k / 30, 3.0 * k) for k in range(9)] + [("b", 0, 0.0, 1.0)], "video string, frame long, t double, cx double").repartition(4)
    worker = own.table_function(own.LineWorker, own.LineWorker.SCHEMA)
    own.name_worker(spark, "line_worker", worker)
    tracks.createOrReplaceTempView("some_tracks")
    got = spark.sql("select * from line_worker(table(some_tracks) partition by video order by frame)").collect()
    assert [(r.video, r.n) for r in got] == [("a", 9)] and got[0].speed == pytest.approx(90) and got[0].r2 == pytest.approx(1)
    assert own.rows(worker, tracks).collect() == got
