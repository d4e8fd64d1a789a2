"""Backgrounds, morphology and moving regions against numpy on whole images."""

import numpy as np
import pytest
from test_unchanged_and_regions import flood

from kinespark.operators import background


def rows_of(spark, videos):
    rows = [(v, f, y, [int(x) for x in row]) for v, frames in videos.items() for f, image in enumerate(frames) for y, row in enumerate(image)]
    return spark.createDataFrame(rows, "video string, frame long, y int, values array<int>").repartition(5)


@pytest.fixture(scope="module")
def videos():
    """Noise with a square that moves; the same, so slow and faint that only neighbours differ; a still image."""
    rng = np.random.default_rng(3)
    moving = rng.integers(0, 20, (9, 24, 31))
    for f in range(9):
        moving[f, 5 : 5 + 6 + f % 2, 2 * f : 2 * f + 8] = 200
    blinking = np.zeros((6, 12, 14), int)
    blinking[1::2, 2:9, 3:11] = 90  # as often there as not: the median lies between
    return {"moving": moving, "blinking": blinking, "still": np.full((4, 8, 8), 7)}


def spread(m, pick):
    padded = np.pad(m.astype(float), 1, constant_values=np.nan)
    near = np.stack([padded[a : a + m.shape[0], b : b + m.shape[1]] for a in range(3) for b in range(3)])
    return pick(near, axis=0).astype(int)


def plain(frames, threshold, least, clean):
    def some(diffs):
        out = []
        for f, diff in diffs:
            m = (diff > threshold).astype(int)
            for pick in (np.nanmin, np.nanmax, np.nanmax, np.nanmax, np.nanmin, np.nanmin) if clean else ():
                m = spread(m, pick)
            for r in flood(set(zip(*map(list, np.nonzero(m)), strict=True))):
                if len(r) >= least:
                    ys, xs = zip(*r, strict=True)
                    out.append((f, len(r), int(min(xs)), int(min(ys)), int(max(xs)), int(max(ys))))
        return out

    still = np.floor(np.median(frames, axis=0))
    first = some([(f, abs(image - still)) for f, image in enumerate(frames)])
    return [(*r, "median_background") for r in first] or [(*r, "pairwise_frame_difference") for r in some([(f, abs(frames[f] - frames[f - 1])) for f in range(1, len(frames))])]


@pytest.mark.parametrize(("threshold", "least", "clean"), [(28, 20, True), (60, 20, True), (28, 2, False)])
def test_moving_regions_equal_whole_images(spark, videos, threshold, least, clean):
    got = background.moving_regions(rows_of(spark, videos), ["video"], threshold, least, clean).collect()
    own = sorted((r.video, r.frame, r.area, r.x1, r.y1, r.x2, r.y2, r.method) for r in got)
    assert own == sorted((v, *r) for v, frames in videos.items() for r in plain(frames, threshold, least, clean))
    if threshold == 60:
        assert {(r.video, r.method) for r in got} == {("moving", "median_background"), ("blinking", "pairwise_frame_difference")}


def test_medians(spark, videos):
    got = {(r.video, r.y): r.background for r in background.median_background(rows_of(spark, videos), ["video"]).collect()}
    for v, frames in videos.items():
        for y, row in enumerate(np.floor(np.median(frames, axis=0))):
            assert got[v, y] == row.tolist()
