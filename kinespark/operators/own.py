"""Evaluators of one's own, in Python: a function of a video's track, or a table function that gives rows.

    own.register("eval_drift", drift)            # drift(track, row) -> {"measured": ..., "unit": ..., "status": ...}
    own.estimate(tracks, metadata)               # for rows whose evaluator is registered here

    worker = own.table_function(Worker, "video string, n long, speed double")
    own.rows(worker, tracks)                     # or SQL: select * from worker(table(tracks) partition by video order by frame)

A function gets one video's track (ordered by object and frame) and its row of metadata, by a grouped map over both, dealt by
video. A table function sees a video's rows one by one in order, keeps what it needs, and gives rows for each or at the end;
so it needs no memory for a video.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from kinespark.functions.exprs import estimate_error
from kinespark.session import ship_package

Evaluator = Callable[[pd.DataFrame, dict], dict]
EVALUATORS: dict[str, Evaluator] = {}
_OUT = "video string, measured double, unit string, fit_r2 double, scale double, status string, reason string"
_FIELDS = [c.split()[0] for c in _OUT.split(", ")]


def register(name: str, evaluator: Evaluator) -> None:
    EVALUATORS[name] = evaluator


def estimate(tracks: DataFrame, meta: DataFrame, evaluators: dict[str, Evaluator] | None = None) -> DataFrame:
    """A row for each row of meta (video, evaluator, target_value, ...) whose evaluator is known: video, measured, unit, fit_r2, scale,
    status, reason and error. A function that raises makes its video failed, with the error as reason; a video without a track is
    tracking_missing. A video has one row of meta."""
    ship_package(tracks.sparkSession)
    known = dict(EVALUATORS if evaluators is None else evaluators)
    rows = meta.filter(F.col("evaluator").isin(*known))

    def one(key: tuple, track: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=_FIELDS)
        row = {k: None if pd.isna(v) else v for k, v in own.iloc[0].items()}
        try:
            found = {"status": "failed", "reason": "tracking_missing"} if track.empty else known[row["evaluator"]](track.sort_values(["object_id", "frame"]), row)
        except Exception as e:  # a user's function: its failure is that video's
            found = {"status": "failed", "reason": f"{type(e).__name__}: {e}"}
        made = {"video": key[0], "status": "valid", "reason": ""} | {k: v for k, v in found.items() if k in _FIELDS}
        return pd.DataFrame({f: [made.get(f)] for f in _FIELDS}).astype({"unit": "object", "measured": "float64", "fit_r2": "float64", "scale": "float64"})

    found = tracks.groupBy("video").cogroup(rows.groupBy("video")).applyInPandas(one, _OUT)
    target = F.col("target_value").cast("double") if "target_value" in meta.columns else F.lit(None).cast("double")
    out = found.join(rows.select("video", target.alias("target_value")), "video")
    return out.withColumn("error", estimate_error("measured", "target_value"))


def table_function(worker: type, schema: str) -> UserDefinedTableFunction:
    """worker: a class with eval(row) and terminate(), which may give tuples of the schema."""
    return F.udtf(worker, returnType=schema)


def rows(worker: UserDefinedTableFunction, tracks: DataFrame, by: str = "video", order: str = "frame") -> DataFrame:
    """The rows that the worker gives of each video's track, in its order."""
    ship_package(tracks.sparkSession)
    return worker(tracks.asTable().partitionBy(by).orderBy(order))


def name_worker(spark: SparkSession, name: str, worker: UserDefinedTableFunction) -> None:
    """Makes the worker callable in SQL."""
    spark.udtf.register(name, worker)


class LineWorker:
    """Speed and fit of a straight line through x over t, from running means and centred sums; an example and a test."""

    SCHEMA = "video string, n long, speed double, r2 double"

    def __init__(self):
        self.video, self.n, self.t, self.x, self.tt, self.tx, self.xx = None, 0, 0.0, 0.0, 0.0, 0.0, 0.0

    def eval(self, row):
        self.video = row["video"]
        self.n += 1
        dt, dx = row["t"] - self.t, row["cx"] - self.x
        self.t, self.x = self.t + dt / self.n, self.x + dx / self.n
        self.tt += dt * (row["t"] - self.t)
        self.tx += dt * (row["cx"] - self.x)
        self.xx += dx * (row["cx"] - self.x)

    def terminate(self):
        if self.n > 1 and self.tt > 0 and self.xx > 0:
            yield self.video, self.n, abs(self.tx / self.tt), self.tx**2 / (self.tt * self.xx)


def line_speed(track: pd.DataFrame, row: dict) -> dict:
    """The same as a function of a whole track."""
    t, x = track["t"] - track["t"].mean(), track["cx"] - track["cx"].mean()
    slope = (t * x).sum() / (t * t).sum()
    r2 = (t * x).sum() ** 2 / ((t * t).sum() * (x * x).sum())
    return {"measured": abs(slope), "unit": "px/s", "fit_r2": r2, "status": "valid" if r2 >= 0.85 else "weak_valid" if r2 >= 0.65 else "invalid"}
