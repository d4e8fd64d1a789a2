"""Operators against numpy and plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.functions import exprs as X
from kinespark.operators import candidates, evaluators, fits, gates, masks, scoring, sensitivity, windows
from kinespark.plans import adapters, registry


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(6):
        t = np.cumsum(rng.uniform(0.5, 1.5, 30))
        rows += [(k, i, float(t[i]), float(rng.normal(0, 10)), float(rng.normal(0, 3))) for i in range(30)]
    return spark.createDataFrame(rows, "object_id long, frame long, t double, x double, y double"), rows


def by(rows, k):
    own = [r for r in rows if r[0] == k]
    return (np.array([r[i] for r in own]) for i in (2, 3, 4))


def test_fits_agree_with_numpy(series):
    df, rows = series
    lin = {r.object_id: r for r in fits.linear_fit(df, ["object_id"], "t", "x").collect()}
    quad = {r.object_id: r for r in fits.quadratic_fit(df, ["object_id"], "t", "x").collect()}
    axis = {r.object_id: r for r in fits.principal_axis(df, ["object_id"]).collect()}
    for k in range(6):
        t, x, y = by(rows, k)
        p1, p2 = np.polyfit(t, x, 1), np.polyfit(t, x, 2)
        assert np.allclose([lin[k].slope, lin[k].intercept], p1, rtol=1e-8)
        assert np.allclose([quad[k].a, quad[k].b, quad[k].c], p2, rtol=1e-7)
        r2 = 1 - ((x - np.polyval(p2, t)) ** 2).sum() / ((x - x.mean()) ** 2).sum()
        assert math.isclose(quad[k].r2, r2, rel_tol=1e-8)
        _, s, vt = np.linalg.svd(np.column_stack([x - x.mean(), y - y.mean()]), full_matrices=False)
        assert abs(abs(vt[0] @ [axis[k].axis_x, axis[k].axis_y]) - 1) < 1e-9
        assert math.isclose(axis[k].one_dim, 1 - s[1] ** 2 / s[0] ** 2, rel_tol=1e-8)


def test_degenerate_fits(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 5.0), (1, 2.0, 5.0), (2, 0.0, 1.0), (2, 1.0, None), (3, 0.0, float("nan"))], "object_id long, t double, x double")
    got = {r.object_id: r for r in fits.linear_fit(df, ["object_id"], "t", "x").collect()}
    assert got[1].slope == 0 and got[1].r2 == 1.0
    assert got[2].slope is None and 3 not in got


def test_windows_agree_with_numpy(series):
    df, rows = series
    w = windows.ordered(["object_id"])
    got = df.select("object_id", "frame", windows.gradient("x", "t", w).alias("v"), windows.moving_average("x", ["object_id"]).alias("m")).orderBy("object_id", "frame").toPandas()
    for k in range(6):
        t, x, _ = by(rows, k)
        own = got[got.object_id == k]
        assert np.allclose(own.v, np.gradient(x, t), rtol=1e-9)
        padded = np.pad(x, 2, mode="edge")
        assert np.allclose(own.m, np.convolve(padded, np.ones(5) / 5, "valid"), rtol=1e-9)


#: Results of the analytic controls.
GOLDEN = {
    "velocity": (0.5, "valid", ""), "acceleration": (0.4, "valid", ""), "gravity": (9.8, "valid", ""), "friction_coefficient": (0.020408163265306152, "valid", ""), "restitution_coefficient": (0.5, "valid", ""),
    "density_from_initial_acceleration": (2000.0, "valid", ""), "fluid_viscosity": (10.888888888888898, "valid", ""), "spring_constant": (7.895683520871486, "weak_valid", "period_detection_weak"),
    "mechanical_energy_conservation": (0.991614292775941, "valid", ""), "momentum_conservation_1d": (0.0, "valid", ""),
}


def test_controls(spark):
    t, m = adapters.golden(spark)
    got = {r.metric: r for r in evaluators.estimate(t, m).collect()}
    for metric, (value, status, reason) in GOLDEN.items():
        assert math.isclose(got[metric].measured, value, rel_tol=1e-9, abs_tol=1e-12), metric
        assert (got[metric].status, got[metric].reason) == (status, reason)
    one = evaluators.estimate(t.filter("frame = 0"), m).collect()
    assert {r.status for r in one} == {"failed"} and {r.reason for r in one} == {"insufficient_frames"}
    none = evaluators.estimate(t.filter("frame < 0"), m).collect()
    assert {r.reason for r in none} == {"tracking_missing"}


def test_unknown_g_is_earths(spark):
    """Friction, energy and gravity without g, and where the environment has none."""
    t, m = adapters.golden(spark)
    some = m.filter("metric in ('friction_coefficient', 'mechanical_energy_conservation', 'gravity')").drop("g", "reference_g")
    got = {r.metric: r for r in evaluators.estimate(t, some).collect()}
    for metric in got:
        assert math.isclose(got[metric].measured, GOLDEN[metric][0], rel_tol=1e-12) and got[metric].status == "valid"
    free = some.filter("metric = 'gravity'").withColumn("gravity_environment", F.lit("zero"))
    slow = t.withColumn("cy", 80 + (F.col("cy") - 80) / 10000 + F.when(F.col("frame") % 2 == 0, 3.0).otherwise(-3.0))
    r = evaluators.estimate(slow, free).first()
    assert r.measured < 0.2 and r.status == "valid" and evaluators.estimate(slow, some.filter("metric = 'gravity'")).first().status == "invalid"


def test_goldens_to_the_last_digits(spark):
    t, m = adapters.golden(spark)
    for r in evaluators.estimate(t, m).collect():
        assert math.isclose(r.measured, GOLDEN[r.metric][0], rel_tol=1e-12, abs_tol=1e-12), (r.metric, r.measured)


def test_momentum_of_objects_that_never_meet(spark):
    t, m = adapters.golden(spark)
    own = m.filter("metric = 'momentum_conservation_1d'")
    apart = t.withColumn("frame", F.col("frame") + F.when(F.col("object_id") == "2", 1000).otherwise(0))
    assert evaluators.estimate(apart, own).first().reason == "tracking_missing"
    assert evaluators.estimate(apart, own.withColumn("m1", F.lit(None).cast("double"))).first().reason == "failed"
    assert evaluators.estimate(t.filter("object_id = '1'"), own).first().reason == "tracking_missing"


def test_period_by_autocorrelation():
    t = np.arange(120) / 30
    p, confidence, how = evaluators.period(t, 20 * np.sin(2 * np.pi * t), "autocorrelation")
    assert how == "autocorrelation" and abs(p - 1) < 0.04 and confidence > 0.2
    p, confidence, how = evaluators.period(t, 20 * np.sin(2 * np.pi * t))
    assert how == "peaks" and math.isclose(p, 1.0) and math.isclose(confidence, 4 / 120)


def test_scores_of_two_results(spark):
    r = spark.createDataFrame([("gravity", "valid", "pass", 0.2, 1.0, "pass"), ("gravity", "weak_valid", "pass", 0.2, 1.0, "pass"), ("gravity", "valid", "flagged", 0.2, 1.0, "pass"), ("gravity", "failed", "pass", None, None, None), ("gravity", "valid", "pass", None, 1.0, "pass")], "metric string, status string, tracking string, rel_error double, qmask double, mask_status string")
    got = scoring.score_videos(r).select("adjusted_score", "exclusion_reasons", "score_available", "measurement_status", "discard_overlap").collect()
    assert math.isclose(got[0].adjusted_score, 51.3417119032592, rel_tol=1e-12)
    assert math.isclose(got[1].adjusted_score, 41.073369522607365, rel_tol=1e-12)
    assert got[2].adjusted_score == 0 and got[2].exclusion_reasons == "tracking_quality_failed" and got[2].discard_overlap == "tracking_only"
    assert got[3].measurement_status == "not_evaluated" and got[3].exclusion_reasons == "physics_status_not_valid"
    assert got[4].adjusted_score is None and not got[4].score_available
    with pytest.raises(scoring.IncompleteResults):
        scoring.require_scores(scoring.score_videos(r))
    assert math.isclose(scoring.score_videos(r, policy="penalty").collect()[2].adjusted_score, 51.3417119032592 / 2, rel_tol=1e-12)


def test_component_curve(spark):
    row = spark.range(1).select(*[X.component_score(F.lit(v), F.lit(2.0), F.lit(4.0), F.lit(True), F.lit(0.35)).alias(f"c{i}") for i, v in enumerate((1.0, 2.5, 3.0, 4.0, 9.0))], X.component_score(F.lit(None).cast("double"), F.lit(2.0), F.lit(4.0), F.lit(True), F.lit(0.35)).alias("none")).first()
    want = [1.0, 1 - 0.25**0.35, 1 - 0.5**0.35, 0.0, 0.0]
    assert np.allclose([row[f"c{i}"] for i in range(5)], want) and row["none"] is None


def test_mask_overlap_ignores_whole_shifts(spark):
    """Frames 1 .. 9 of 11 are the middle; the reference frame isn't compared with itself."""
    runs = spark.createDataFrame([(1, f, y, 2 + f, 6 + f) for f in range(11) for y in range(3, 8)], "video int, frame int, y int, x0 int, x1 int")
    got = masks.aligned_iou(runs, ["video"], stride=2).collect()
    assert {r.frame for r in got} == {1, 3, 7, 9} and all(r.iou == 1.0 and r.ref == 5 for r in got)
    lone = masks.aligned_iou(runs.filter("frame = 5"), ["video"])
    assert lone.count() == 0


def test_masks_cut_by_the_edge(spark):
    """A mask twice as wide, half of which falls out of the image when it is moved back, counts only what stays."""
    runs = spark.createDataFrame([(1, 0, 0, 0, 9), (1, 1, 0, 4, 9), (1, 2, 0, 0, 9)], "video int, frame int, y int, x0 int, x1 int")
    got = {r.frame: r.iou for r in masks.aligned_iou(runs, ["video"], stride=1, window=(0.0, 1.0), size=(10, 1)).collect()}
    # frame 1 is the reference (4 .. 9, mean 6.5); 0 .. 9 (mean 4.5) moves by 2 to 2 .. 9
    assert got == {0: 6 / 8, 2: 6 / 8}


def test_gate_reasons(spark):
    rows = [("still", "1", f, 5.0, 5.0, True, 10.0) for f in range(10)] + [("moves", "1", f, 5.0 * f, 5.0, True, 10.0) for f in range(10)] + [("lost", "1", f, 5.0 * f, 5.0, f < 3, 10.0) for f in range(10)]
    df = spark.createDataFrame(rows, "video string, object_id string, frame long, x double, y double, valid boolean, diameter double")
    got = {r.video: (r.status, r.reasons) for r in gates.tracking_gate(df, 1).collect()}
    assert got["moves"] == ("pass", []) and got["still"] == ("flagged", ["no_meaningful_motion"])
    assert got["lost"] == ("flagged", ["no_counted_object", "object_count_mismatch"])
    odd = [("still lost", "1", f, 5.0, 5.0, f < 3, 10.0) for f in range(10)] + [("two", o, f, 5.0 * f * (o == "2"), 5.0, True, 10.0) for o in "12" for f in range(10)] + [("none", None, None, None, None, None, None)]
    got = {r.video: r for r in gates.tracking_gate(spark.createDataFrame(odd, df.schema), 0).collect()}
    assert got["still lost"].reasons == ["no_counted_object", "object_count_mismatch"] and got["still lost"].primary_object is None
    assert got["none"].reasons == ["tracking_frames_missing"] and got["none"].expected == 1 and got["two"].primary_object == "1" and got["two"].reasons == ["no_meaningful_motion", "object_count_mismatch"]


def test_greedy_choice(spark):
    boxes = [(1, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.8, 1.0, 1.0, 11.0, 11.0), (1, 2, 0.7, 50.0, 50.0, 60.0, 60.0), (1, 3, 0.6, 90.0, 0.0, 99.0, 9.0)]
    df = spark.createDataFrame(boxes, "video long, candidate long, score double, x1 double, y1 double, x2 double, y2 double")
    assert [r.candidate for r in candidates.distinct_candidates(df, 2, 5.0).orderBy("rank").collect()] == [0, 2]


def test_first_cluster_in_reach(spark):
    """Against plain Python: the first cluster within the radius takes a point, not the nearest."""
    rng = np.random.default_rng(3)
    rows = [(v, c, int(rng.integers(0, 8)), float(rng.integers(1, 9)) / 8, float(rng.uniform(0, 60)), float(rng.uniform(0, 60))) for v in (1, 2) for c in range(60)]
    df = spark.createDataFrame(rows, "video long, candidate long, frame long, score double, x double, y double")
    want, best = {}, {}
    for v in (1, 2):
        clusters = []
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (-r[3], r[1])):
            for k, items in enumerate(clusters):
                w = [i[3] for i in items]
                if math.hypot(r[4] - np.average([i[4] for i in items], weights=w), r[5] - np.average([i[5] for i in items], weights=w)) <= 20:
                    break
            else:
                k = len(clusters)
                clusters.append([])
            clusters[k].append(r)
            want[v, r[1]] = k
        for k, items in enumerate(clusters):
            stable = [i for i in items if i[3] >= 0.65 * max(x[3] for x in items)]
            best[v, k] = (float(np.median([i[3] for i in items]) * np.log1p(len({i[2] for i in items}))), min(stable, key=lambda i: (abs(i[2] - 4), -i[3], i[1]))[1])
    got = candidates.cluster_candidates(df, 20.0)
    assert {(r.video, r.candidate): r.cluster for r in got.collect()} == want and len({*want.values()}) > 3
    scores = {(r.video, r.cluster): (r.cluster_score, r.candidate) for r in candidates.cluster_scores(got, 4).collect()}
    assert scores.keys() == best.keys() and all(math.isclose(scores[k][0], best[k][0]) and scores[k][1] == best[k][1] for k in best)


def test_study_conditions(spark):
    r = spark.createDataFrame([("m", "gravity", "p1", "valid", 0.1, 0.0, 0.9), ("m", "gravity", "p2", "valid", 5.0, 0.0, 0.7), ("m", "gravity", "p3", "weak_valid", 5.0, 0.0, None), ("m", "spring_constant", "p4", "valid", 1.0, 9.8, 0.1)], "model string, metric string, prompt_id string, status string, measured double, reference_g double, fit_r2 double")
    found = {x.problem: x.n for x in sensitivity.problems(r, ("gravity",), {"all": 5}).collect()}
    assert found == {"status is not the baseline's": 1, "no R2": 1, "spring status is not its confidence's": 1, "number of all": 1}
    with pytest.raises(ValueError, match="no R2: 1"):
        sensitivity.require(r, ("gravity",))


def test_completeness(spark):
    res = spark.createDataFrame([("kling_A001",), ("kling_A001",), ("B002",)], "id string")
    meta = spark.createDataFrame([("A001",), ("C003",)], "id string")
    got = {(r.problem, r.id) for r in scoring.completeness(res, meta, "id", "id").collect()}
    assert got == {("missing", "C003"), ("unexpected", "B002"), ("repeated_result", "A001")}
    with pytest.raises(scoring.IncompleteResults):
        scoring.require_complete(res, meta, "id", "id")


def test_grid_size():
    assert len(sensitivity.scenarios()) == 25


def test_aligned_iou_sends_no_runs_to_the_driver(spark, sf):
    plan = registry.queries()["mask_run_iou"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
