"""Fingerprints that find one changed, repeated or lost row, and regions against a flood fill of pixels."""

import random

import pytest
from pyspark.sql import functions as F

from kinespark.operators import regions, unchanged

ROWS = [(k % 50 if k % 7 else None, f"t{k}" if k % 5 else None, k / 3, {"a": k}) for k in range(300)]
SCHEMA = "k int, t string, x double, m map<string, int>"


def print_of(df):
    return unchanged.fingerprint(df).first()


def test_fingerprints_know_rows_but_not_their_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    shuffled = spark.createDataFrame(random.Random(1).sample(ROWS, len(ROWS)), SCHEMA).repartition(7).select("x", "m", "t", "k")
    assert print_of(df) == print_of(shuffled)
    one = [*ROWS]
    one[17] = (*ROWS[17][:2], ROWS[17][2] + 1e-9, ROWS[17][3])
    swapped = [(None, "1", 0.0, None), ("1", None, 0.0, None)]
    for other in (one, [*ROWS, ROWS[4]], ROWS[:-1], [*ROWS[1:], ROWS[1]], [*ROWS, ROWS[4], ROWS[4]]):
        assert print_of(spark.createDataFrame(other, SCHEMA)) != print_of(df)
    a, b = (spark.createDataFrame([r], "k string, t string, x double, m map<string, int>") for r in swapped)
    assert print_of(a) != print_of(b) and print_of(a.filter("false"))["n"] == 0


def test_differences_are_found_by_key(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = [*ROWS]
    rows[8] = (8, "other", 0.0, None)
    edited = spark.createDataFrame([*[r for r in rows if r[0] != 33], rows[20], (99, "new", 1.0, None), (None, "new", 1.0, None)], SCHEMA).repartition(5)
    got = {r.k: (r.change, r.n_after - r.n_before) for r in unchanged.differing(df, edited, ["k"], buckets=16).collect()}
    gone = len([r for r in ROWS if r[0] == 33])
    assert got == {8: ("changed", 0), 33: ("lost", -gone), rows[20][0]: ("repeated", 1), 99: ("new", 1), None: ("changed", 1)}
    assert unchanged.differing(df, df.repartition(3), ["k"]).count() == 0


def test_a_study_of_changing_inputs_is_refused(spark, tmp_path):
    path, out = str(tmp_path / "in"), []
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    told = unchanged.proven(read, lambda df: df.groupBy("k").count(), lambda df: out.append(df.count()))
    assert told["n"] == 300 and out
    with pytest.raises(unchanged.ChangedInputs):
        unchanged.proven(read, lambda df: df, lambda df: df.limit(1).write.mode("append").parquet(path))


def flood(pixels):
    """Regions in order of their first pixel by row and place."""
    left, out = set(pixels), []
    for p in sorted(pixels):
        if p in left:
            region, todo = set(), [p]
            left.discard(p)
            while todo:
                y, x = todo.pop()
                region.add((y, x))
                near = [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (y + a, x + b) in left]
                left.difference_update(near)
                todo += near
            out.append(region)
    return out


def test_regions_equal_a_flood_fill(spark):
    rng, rows, want = random.Random(6), [], {}
    for f in range(25):
        own = [(rng.randrange(14), x0 := rng.randrange(30), x0 + rng.randrange(-1, 2 + f % 9)) for _ in range(rng.randrange(1, 45))]
        rows += [("v", f, *r) for r in own]
        for k, r in enumerate(flood({(y, x) for y, a, b in own for x in range(a, b + 1)})):
            ys, xs = zip(*r, strict=True)
            want[f, k] = (len(r), min(xs), min(ys), max(xs), max(ys), pytest.approx(sum(xs) / len(r)), pytest.approx(sum(ys) / len(r)))
    found = regions.regions(spark.createDataFrame(rows, "v string, frame long, y int, x0 int, x1 int").repartition(5), ["v"])
    got = {(r.frame, r.region): (r.area, r.x1, r.y1, r.x2, r.y2, r.cx, r.cy) for r in found.collect()}
    assert got == want
    best = {r.frame: r.area for r in regions.largest(found, ["v"]).collect()}
    assert best == {f: max(v[0] for (g, _), v in want.items() if g == f) for f in {f for f, _ in want}}
    assert regions.regions(spark.createDataFrame([], "v string, frame long, y int, x0 int, x1 int"), ["v"]).count() == 0


def test_frames_are_labelled_many_at_a_time(spark):
    runs = spark.createDataFrame([(v, f, y, 3 * y, 3 * y + 2) for v in (0, None) for f in range(40) for y in (0, 1, 2, 4)], "video int, frame int, y int, x0 int, x1 int")
    found = regions.regions(runs, ["video"])
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # a call for each frame
    assert sorted((r.frame, r.region, r.area) for r in found.collect()) == sorted(2 * [(f, k, n) for f in range(40) for k, n in ((0, 9), (1, 3))])
