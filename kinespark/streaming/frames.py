"""Frames as they arrive, one row for each frame and object: the gate's numbers as a stream.

Each object has its own state: running count, coverage, way and extent of the rows that are settled (older than the
watermark, so none before them can still come), a list of rows that aren't, and how often each diameter occurred. Rows are
folded in order of time whatever micro-batch brings them, so any split gives the numbers of the batch gate; what comes out
at any time counts the waiting rows too. A timer closes an object that has been silent for so many milliseconds; its last row says so, and its state goes. State is kept by RocksDB and doesn't
grow with the way an object has gone; rows that wait for the watermark are as many as come in within ``late``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kinespark.operators.gates import decided
from kinespark.session import ship_package

ROW = "ms long, frame long, x double, y double, valid boolean, diameter double"
SUMMARY = "frames long, n_valid long, path double, x0 double, x1 double, y0 double, y1 double, x double, y double, first_ms long, first_frame long"
OUT = "video string, object_id string, frames long, n_valid long, coverage double, path double, extent double, diameter double, first_ms long, first_frame long, closed boolean"
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_OUT = Row(*[c.split()[0] for c in OUT.split(", ")])


class Frames(StatefulProcessor):
    def __init__(self, silence_ms: int):
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", SUMMARY)
        self.waiting = handle.getListState("waiting", ROW)
        self.sizes = handle.getMapState("sizes", "diameter double", "n long")
        self.due = handle.getValueState("due", "ms long")

    @staticmethod
    def _folded(s: dict | None, rows: list[tuple]) -> tuple[dict | None, dict[float, int]]:
        """A summary with rows, in order, added, and how often their diameters occurred."""
        s, seen = dict(s) if s else None, {}
        for ms, frame, x, y, valid, diameter in rows:
            s = s or {"frames": 0, "n_valid": 0, "path": 0.0, "x0": None, "x1": None, "y0": None, "y1": None, "x": None, "y": None, "first_ms": ms, "first_frame": frame}
            s["frames"] += 1
            if diameter is not None and diameter > 0 and math.isfinite(diameter):
                seen[diameter] = seen.get(diameter, 0) + 1
            if valid is False or x is None or y is None:
                continue
            if s["n_valid"]:
                s["path"] += math.hypot(x - s["x"], y - s["y"])
                s |= {"x0": min(s["x0"], x), "x1": max(s["x1"], x), "y0": min(s["y0"], y), "y1": max(s["y1"], y)}
            else:
                s |= {"x0": x, "x1": x, "y0": y, "y1": y}
            s |= {"n_valid": s["n_valid"] + 1, "x": x, "y": y}
        return s, seen

    def _known(self) -> dict | None:
        known = self.summary.get()
        return dict(zip([c.split()[0] for c in SUMMARY.split(", ")], known, strict=True)) if known else None

    def _fold(self, rows: list[tuple]) -> None:
        if not rows:
            return
        s, seen = self._folded(self._known(), rows)
        self.summary.update(tuple(s.values()))
        for diameter, n in seen.items():
            had = self.sizes.getValue((diameter,)) if self.sizes.containsKey((diameter,)) else (0,)
            self.sizes.updateValue((diameter,), (had[0] + n,))

    def _median(self, more: dict[float, int]) -> float | None:
        counts = dict(more)
        for d, n in self.sizes.iterator():
            counts[d[0]] = counts.get(d[0], 0) + n[0]
        total = sum(counts.values())
        if not total:
            return None
        at = lambda k: next(d for d, n in _through(sorted(counts.items())) if k < n)
        return (at((total - 1) // 2) + at(total // 2)) / 2

    def _told(self, key: tuple, waiting: list[tuple], closed: bool) -> Iterator[Row]:
        """What is known now, with the rows that wait."""
        s, more = self._folded(self._known(), waiting)
        if s is None:
            return
        frames, n = s["frames"], s["n_valid"]
        extent = math.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"]) if n else None
        yield _OUT(key[0], key[1], frames, n, n / frames, s["path"], extent, self._median(more), s["first_ms"], s["first_frame"], closed)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        # rows as they are: a pandas table an object costs more than all the rest
        mark = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        held += [tuple(None if v != v else v for v in r[-6:]) for r in rows]
        held.sort(key=lambda r: r[:2])
        last = held[-1][0]
        self._fold([r for r in held if r[0] < mark])
        left = [r for r in held if r[0] >= mark]
        self.waiting.put(left) if left else self.waiting.clear()
        due = self.due.get()
        if due is None or last + self.silence > due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self.handle.registerTimer(last + self.silence)
            self.due.update((last + self.silence,))
        yield from self._told(key, left, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self._fold(sorted(tuple(r) for r in self.waiting.get()))
        yield from self._told(key, [], True)
        for state in (self.summary, self.waiting, self.sizes, self.due):
            state.clear()

    def close(self) -> None:
        pass


def _through(counts: list[tuple[float, int]]) -> Iterator[tuple[float, int]]:
    total = 0
    for value, n in counts:
        total += n
        yield value, total


def running_objects(frames: DataFrame, late: str = "10 minutes", silence_ms: int = 3_600_000) -> DataFrame:
    """frames: a stream of video, object_id, ts, frame, x, y, valid, diameter. A row (``OUT``) for each object that a
    micro-batch touches or closes; write it in update mode. The session must keep state by RocksDB (``STORE``)."""
    ship_package(frames.sparkSession)
    own = frames.select(
        F.col("video").cast("string").alias("video"), F.col("object_id").cast("string").alias("object_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),  # from here on as in ROW
        F.col("frame").cast("long").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "valid", F.col("diameter").cast("double").alias("diameter"),
    )
    keyed = own.filter("ts is not null").withWatermark("ts", late).groupBy("video", "object_id")
    return keyed.transformWithState(statefulProcessor=Frames(silence_ms), outputStructType=OUT, outputMode="update", timeMode="eventtime")


def latest(objects: DataFrame) -> DataFrame:
    """Of all rows that came out, the last one of each object."""
    return objects.groupBy("video", "object_id").agg(F.max_by(F.struct(*objects.columns), F.struct("frames", "closed")).alias("o")).select("o.*")


def gate_of(objects: DataFrame, expected: DataFrame | int = 1, **limits) -> DataFrame:
    """The tracking gate of objects (``latest``). A video has as many frames as the object with most of them."""
    frames = objects.groupBy("video").agg(F.max("frames").alias("frames"))
    own = objects.select("video", "object_id", "n_valid", "path", "extent", "diameter", F.struct("first_ms", "first_frame").alias("met"))
    return decided(own.join(frames, "video"), frames, expected, **limits)
