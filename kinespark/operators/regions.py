"""Regions of masks: 8-connected components of runs (y, x0, x1 inclusive), without a row for any pixel.

Runs of a row that overlap or touch become one first. Two runs of neighbouring rows are of one region when they overlap or
meet at a corner. A frame's runs go to one task (a frame's height times the runs of a row at most), where a search finds
the neighbours of all runs at once and roots spread along them, for the many frames of a batch together; frames, not videos,
are what is dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.session import ship_package


def merged_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame, y, x0, x1 with the runs of a row disjoint and apart."""
    w = Window.partitionBy(*keys, "frame", "y").orderBy("x0", "x1")
    own = runs.filter("x0 <= x1").select(*keys, "frame", *[F.col(c).cast("long").alias(c) for c in ("y", "x0", "x1")])
    own = own.withColumn("reach", F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.withColumn("island", F.sum(F.when(F.col("x0") > F.col("reach") + 1, 1).otherwise(0)).over(w))
    return own.groupBy(*keys, "frame", "y", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")


def joined(frame: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For each run (in order of frame, row and place) the first run of its region."""
    root, n = np.arange(len(y)), len(y)
    if not n:
        return root
    row = np.cumsum(np.r_[False, (frame[1:] != frame[:-1]) | (y[1:] != y[:-1])])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    # rows laid out one after the other on a line, so that one search finds the runs of the next row that each run meets
    low, width = int(x0.min()), int(x1.max()) - int(x0.min()) + 5
    follows = np.r_[(frame[first][1:] == frame[first][:-1]) & (y[first][1:] == y[first][:-1] + 1), False][row]
    at, left, right = row * width, x0 - low + 2, x1 - low + 2
    begin = np.searchsorted(at + right, at + width + left - 1, "left")
    count = np.where(follows, np.maximum(np.searchsorted(at + left, at + width + right + 1, "right") - begin, 0), 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    while True:  # each run takes the least root that it or a neighbour has, and roots are followed to their ends
        i, j = root[a], root[b]
        if (i == j).all():
            return root
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (root[root] != root).any():
            root = root[root]


def labelled(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The merged runs with region: regions of a frame are numbered from 0 in order of their first run (row, then place)."""
    ship_package(runs.sparkSession)
    own = merged_runs(runs, keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", region long"

    def numbered(rows: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        root = joined(of, *(rows[c].to_numpy() for c in ("y", "x0", "x1")))
        new = root == np.arange(len(root))
        before = np.cumsum(new) - new  # regions that begin before a run
        return rows.assign(region=(before[root] - before[np.flatnonzero(np.r_[True, of[1:] != of[:-1]])][of]))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition's rows in order of frames: all frames that a batch ends are labelled together."""
        held = None
        for rows in batches:
            rows = pd.concat([held, rows], ignore_index=True) if held is not None else rows
            names = rows[[*keys, "frame"]]
            differs = ~((names == names.shift()) | (names.isna() & names.shift().isna())).all(axis=1).to_numpy()
            differs[:1] = False
            of = np.cumsum(differs)
            last = int(np.searchsorted(of, of[-1])) if len(of) else 0
            if last:
                yield numbered(rows.iloc[:last], of[:last])
            held = rows.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield numbered(held, np.zeros(len(held), np.int64))

    dealt = own.repartition(*keys, "frame").sortWithinPartitions(*keys, "frame", "y", "x0")
    return dealt.mapInPandas(frames, schema)


def regions(runs: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """A row for each region of at least so many pixels: area, box (x1, y1, x2, y2) and mean place (cx, cy)."""
    n = F.col("x1") - F.col("x0") + 1
    mean = lambda c: F.sum(c * n) / F.sum(n)
    out = labelled(runs, keys).groupBy(*keys, "frame", "region").agg(
        F.sum(n).alias("area"), F.min("x0").alias("left"), F.min("y").alias("y1"), F.max("x1").alias("x2"), F.max("y").alias("y2"), mean((F.col("x0") + F.col("x1")) / 2).alias("cx"), mean(F.col("y")).alias("cy")
    )
    return out.filter(F.col("area") >= least).withColumnRenamed("left", "x1")


def largest(found: DataFrame, keys: list[str]) -> DataFrame:
    """The largest region of each frame, the first of equal ones."""
    place = F.row_number().over(Window.partitionBy(*keys, "frame").orderBy(F.desc("area"), "region"))
    return found.withColumn("_place", place).filter("_place = 1").drop("_place")
