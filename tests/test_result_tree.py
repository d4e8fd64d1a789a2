"""The tree of documents as a data source, its two-phase commit, and incremental runs."""

import json
import os
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_pipeline import META, square

from kinespark import incremental, pipeline
from kinespark.sources import result_tree, results


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in Path(root).rglob("*") if p.is_file()}


def docs_of(spark, n, metrics=("a", "b", "c"), text="x"):
    rows = [(metrics[k % len(metrics)], f"p{k:02}", json.dumps({"k": k, "text": text})) for k in range(n)]
    return spark.createDataFrame(rows, result_tree.SCHEMA).repartition(4), {f"{m}/{p}/result.json": d for m, p, d in rows}


def test_round_trip_and_replacement(spark, tmp_path):
    root = str(tmp_path / "tree")
    df, want = docs_of(spark, 20)
    result_tree.write_tree(df, root)
    assert files(root) == want  # no staged file, no manifest is left
    read = result_tree.read_tree(spark, root)
    assert read.rdd.getNumPartitions() == 3 and {f"{r.metric}/{r.prompt_id}/result.json": r.document for r in read.collect()} == want
    some, new = docs_of(spark, 5, text="ünlike\n")
    result_tree.write_tree(some, root)
    assert files(root) == want | new
    result_tree.write_tree(some, root, overwrite=True)
    assert files(root) == new
    assert result_tree.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_a_filter_opens_only_its_files(spark, tmp_path):
    """Reading a folder in place of a file fails, so what isn't asked for must not be opened."""
    root = tmp_path / "tree"
    result_tree.write_tree(docs_of(spark, 12)[0], str(root))
    (root / "b" / "broken" / "result.json").mkdir(parents=True)
    read = result_tree.read_tree(spark, str(root))
    assert read.filter("metric = 'a'").count() == 4
    assert read.filter("metric in ('a', 'c') and document like '%1%'").count() == len([k for k in range(12) if k % 3 != 1 and "1" in str(k)])
    assert [r.prompt_id for r in read.filter("metric = 'b' and prompt_id = 'p04'").collect()] == ["p04"]
    assert read.filter("metric = 'a' and metric = 'c'").count() == 0
    plan = read.filter("metric = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("Filters", "")
    with pytest.raises(PySparkException):
        read.filter("metric like 'b%'").collect()


def test_a_failing_task_leaves_the_tree_as_it_was(spark, tmp_path):
    root = str(tmp_path / "tree")
    result_tree.write_tree(docs_of(spark, 6)[0], root)
    before = files(root)
    bad, _ = docs_of(spark, 30, text="new")
    bad = bad.withColumn("document", F.when(F.col("prompt_id") == "p29", F.raise_error(F.lit("late"))).otherwise(F.col("document")))
    with pytest.raises(PySparkException):
        result_tree.write_tree(bad, root)
    assert files(root) == before
    for name in ("../out", "", ".x", "_staging"):
        odd = docs_of(spark, 3)[0].withColumn("prompt_id", F.lit(name))
        with pytest.raises(PySparkException):
            result_tree.write_tree(odd, root)
    with pytest.raises(PySparkException):
        result_tree.write_tree(docs_of(spark, 4, metrics=("a",))[0].withColumn("prompt_id", F.lit("same")), root)
    assert files(root) == before


def test_interrupted_commits_are_finished(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tree")
    result_tree.write_tree(docs_of(spark, 3)[0], root)
    writer = result_tree.TreeWriter(root, True)
    from pyspark.sql import Row

    done = [writer.write(iter([Row(metric="a", prompt_id=f"q{k}", document=f"{k}")])) for k in range(4)]
    lost = result_tree.TreeWriter(root, False)
    lost.write(iter([Row(metric="z", prompt_id="never", document="0")]))
    moves, real = [], result_tree._moved

    def dies(system, path, some):
        real(system, path, some[:2])
        moves.append(1)
        raise OSError("driver lost")

    monkeypatch.setattr(result_tree, "_moved", dies)
    with pytest.raises(OSError):
        writer.commit(done)
    monkeypatch.setattr(result_tree, "_moved", real)
    assert moves and result_tree.recover(root) == 1
    assert files(root) == {f"a/q{k}/result.json": f"{k}" for k in range(4)}
    assert result_tree.recover(root) == 0


def sample(spark, odd=()):
    rows = [(i, f"V{i:03}", f"V{i:03}.mp4", "B1", "velocity", "object_center", 1, "side", "x", "object_diameter", 0.1, "target_speed", 0.0 if i == 3 else 0.3 + (i in odd), "m/s", None) for i in range(12)]
    docs = [(f"V{i:03}", square(1 + (i in odd) + i / 10)) for i in range(11)]
    return spark.createDataFrame(rows, META), spark.createDataFrame(docs, "video string, text string")


def test_results_as_rows_and_documents(spark, tmp_path):
    meta, docs = sample(spark)
    out = pipeline.evaluate(meta, docs)
    rows = {r.Prompt_ID: r for r in results.fixed_rows(out, meta).collect()}
    assert results.fixed_rows(out, meta).columns == results.COLUMNS and len(rows) == 12
    assert rows["V003"].Relative_Error == rows["V003"].Absolute_Error == rows["V003"].Measured_Value
    assert rows["V001"].Relative_Error == pytest.approx(abs(rows["V001"].Measured_Value - 0.3) / 0.3)
    assert (rows["V011"].Status, rows["V011"].Failure_Reason, rows["V011"].Relative_Error) == ("failed", "tracking_missing", None)
    result_tree.write_tree(results.documents(out, meta), str(tmp_path / "tree"))
    one = json.loads((tmp_path / "tree/velocity/V003/result.json").read_text())
    assert one["physics_result"]["Relative_Error"] == rows["V003"].Relative_Error and one["tracking_quality"]["reasons"] == [] and one["metadata"]["Target_Value"] == 0.0
    got = {r.prompt_id: r for r in results.parsed(result_tree.read_tree(spark, str(tmp_path / "tree"))).collect()}
    for r in out.collect():
        assert (r.status, r.tracking, r.tracking_reasons) == (got[r.prompt_id].status, got[r.prompt_id].tracking, got[r.prompt_id].tracking_reasons)
        assert r.rel_error == pytest.approx(got[r.prompt_id].rel_error) if r.rel_error is not None else got[r.prompt_id].rel_error is None


def test_incremental_runs(spark, tmp_path):
    store, columns = str(tmp_path / "store"), ["prompt_id", "measured", "rel_error", "status", "tracking"]
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    at = lambda: {p: os.stat(p).st_mtime_ns for p in Path(store).rglob("*.parquet")}
    meta, docs = sample(spark)
    assert incremental.run(meta, docs, store, buckets=8) == {"new": 12, "changed": 0, "lost": 0, "same": 0}
    assert rows(spark.read.parquet(store)) == rows(pipeline.evaluate(meta, docs))
    first = at()
    assert incremental.run(meta, docs, store, buckets=8) == {"new": 0, "changed": 0, "lost": 0, "same": 12} and at() == first
    meta, docs = sample(spark, odd=(2, 5))
    meta, docs = meta.filter("Prompt_ID <> 'V007'"), docs.filter("video <> 'V007'")
    touched = {r.bucket for r in spark.read.parquet(store).filter("prompt_id in ('V002', 'V005', 'V007')").collect()}
    assert incremental.run(meta, docs, store, buckets=8) == {"new": 0, "changed": 2, "lost": 1, "same": 9}
    assert rows(spark.read.parquet(store)) == rows(pipeline.evaluate(meta, docs))
    second = at()
    of = lambda p: int(p.parent.name.removeprefix("bucket="))
    assert {p: t for p, t in second.items() if of(p) not in touched} == {p: t for p, t in first.items() if of(p) not in touched}
    assert not {p for p in second if of(p) in touched} & set(first)
    assert incremental.run(meta, docs, store, version="2", buckets=8)["changed"] == 11
