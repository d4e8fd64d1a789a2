"""Percentiles by counts against all values in memory, and that no task gets a group's values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import scoring, selection

STATS = {"low": ("x", 0.0), "q": ("x", 0.05), "mid": ("x", 0.5), "p90": ("x", 0.9), "top": ("x", 1.0), "half_mid": ("half", 0.5)}


def plain(values, share):
    at = sorted(values)
    pos = (len(at) - 1) * share
    low = int(pos)
    return at[low] if pos == low else at[low] * (1 - (pos - low)) + at[low + 1] * (pos - low)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    kinds = [lambda: rng.gauss(0, 1), lambda: rng.choice([-1.5, 0.0, -0.0, 2.0]), lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), lambda: float(rng.randrange(5)), lambda: rng.choice([5e-324, -5e-324, float("inf"), float("-inf"), 1.0])]
    out = [(None if g == 4 else f"g{g}", kinds[g]()) for g in range(5) for _ in range(rng.randrange(1, 90))]
    out += [("hot", rng.lognormvariate(0, 9)) for _ in range(9 * len(out))]
    return out + [("g0", None), ("none", None), ("one", 3.25)]


def test_percentiles_equal_all_values(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r["g"]: r for r in selection.percentiles(df, ["g"], STATS, {"x": F.col("x"), "half": F.col("x") / 2}).collect()}
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    assert set(got) == set(by)
    for g, values in by.items():
        for name, (series, share) in STATS.items():
            want = plain([v / 2 for v in values] if series == "half" else values, share)
            assert np.isnan(want) and np.isnan(got[g][name]) or got[g][name] == pytest.approx(want, rel=1e-15), (g, name)


def test_no_task_gets_the_values_of_a_hot_group(spark):
    """One group of 90 % of 60,000 rows: what goes through exchanges is counts."""
    df = spark.range(60_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("g"), (F.rand(3) * 1000).alias("x"))
    out = selection.percentiles(df, ["g"], {"m": ("x", 0.5)}, {"x": F.col("x")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan and "ObjectHashAggregate" not in plan
    gathered = df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    assert {tuple(r) for r in out.filter("g < 100").collect()} == {tuple(r) for r in gathered.filter("g < 100").collect()}


def test_refusals_and_empty_tables(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert selection.percentiles(df, ["g"], {"m": ("x", 0.5)}, {"x": F.col("x")}).count() == 0
    with pytest.raises(ValueError):
        selection.percentiles(df, ["g"], {"m": ("x", 1.5)}, {"x": F.col("x")})


def test_summaries_are_equal_both_ways(spark):
    scored = spark.range(400).select(
        F.when(F.col("id") % 9 > 0, (F.col("id") % 3).cast("string")).alias("model"), *[(F.col("id") % 5 != k).alias(c) for k, c in enumerate(["both_gates_pass", "physics_pass", "tracking_pass", "mask_pass"])],
        F.lit("pass").alias("measurement_status"), (F.col("id") % 4 > 0).alias("effective"), *[F.rand(k).alias(c) for k, c in enumerate(["relative_error", "adjusted_score", "base_score", "mask_score", "measurement_multiplier"])],
    )
    a, b = (sorted(map(tuple, scoring.summarise(scored, ["model"], way).collect()), key=repr) for way in (True, False))
    assert len(a) == 4 and all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))
