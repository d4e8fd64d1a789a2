"""Detector output as tables: which boxes may be targets, how good they are, and which frames and passes count. All are
column rules on (video, frame, x1, y1, x2, y2, ...); only the choices by video shuffle, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.operators import windows

#: What a detector calls the targets that hints name, the hints in order of precedence.
HINT_CLASSES = {"ball": ["sports ball"], "sphere": ["sports ball"], "tennis": ["sports ball"], "basket": ["sports ball"], "basketball": ["sports ball"], "person": ["person"]}
#: Words of a hint that name no class, and those that tell boxes and balls.
IGNORED = ("standard", "solid", "object", "calibration", "tracking")
BOX_LIKE = ("slider", "cube", "block", "box", "square")
BALL_LIKE = ("ball", "sphere", "puck", "standard", "bearing")


def _low(c: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def hint_like(hint: Column | str, words: tuple[str, ...]) -> Column:
    """Whether the hint holds one of the words, in any case."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(_low(hint), w))


def class_allowed(class_id: Column | str, name: Column | str, hint: Column | str, classes: Column | str | None = None) -> Column:
    """A class listed by number or name (comma-separated, if any are); else one that the hint's known target has; else one
    that holds, or is held by, a word of the hint; any, where the hint has no word."""
    of_id, of_name = (F.col(class_id) if isinstance(class_id, str) else class_id).cast("string"), _low(name)
    given = F.filter(F.transform(F.split(_low(F.lit("") if classes is None else classes), ","), lambda c: F.trim(c)), lambda c: c != "")
    words = F.filter(F.split(_low(hint), r"[-_/\s]+"), lambda w: (w != "") & ~w.isin(*IGNORED))
    out = F.when(F.size(given) > 0, F.array_contains(given, of_id) | F.array_contains(given, of_name))
    for word, names in HINT_CLASSES.items():
        out = out.when(F.contains(_low(hint), F.lit(word)), of_name.isin(*names))
    return out.when(F.size(words) > 0, F.exists(words, lambda w: F.contains(of_name, w) | F.contains(w, of_name))).otherwise(F.lit(True))


def detector_candidates(boxes: DataFrame, hint: Column | str = "", classes: Column | str | None = None, max_share: float = 0.70, max_aspect: float = 8.0) -> DataFrame:
    """Boxes (x1, y1, x2, y2, confidence, class_id, class_name, image_w, image_h) that may be targets, with cx, cy, area,
    aspect and score: confidence, raised for the middle of the image and for size. A side counts as one pixel at least."""
    hint = F.lit("") if isinstance(hint, str) and hint == "" else hint
    side = lambda a, b: F.greatest(F.col(b) - F.col(a), F.lit(1.0))
    image = F.col("image_w") * F.col("image_h")
    own = boxes.filter(class_allowed("class_id", "class_name", hint, classes)).withColumns({
        "cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "area": side("x1", "x2") * side("y1", "y2"),
        "aspect": F.greatest(side("x1", "x2") / side("y1", "y2"), side("y1", "y2") / side("x1", "x2")),
    })
    own = own.filter((F.col("area") > 4) & (F.col("area") <= max_share * image) & (F.col("aspect") <= max_aspect))
    away = F.hypot(F.col("cx") - F.col("image_w") / 2, F.col("cy") - F.col("image_h") / 2) / F.greatest(F.hypot("image_w", "image_h") / 2, F.lit(1.0))
    central = 1 - F.least(away, F.lit(1.0))
    return own.withColumn("score", F.col("confidence") * (0.75 + 0.25 * central) * (0.70 + 0.30 * F.least(F.col("area") / (0.18 * image), F.lit(1.0))))


def motion_candidates(regions: DataFrame, min_area: float, max_area: float, min_fill: float, max_aspect: float) -> DataFrame:
    """Regions (area, w, h) within the bounds, wider and higher than a pixel, with fill and aspect."""
    w, h = F.col("w"), F.col("h")
    own = regions.filter(F.col("area").between(min_area, max_area) & (w > 1) & (h > 1)).withColumn("fill", F.col("area") / (w * h)).withColumn("aspect", F.greatest(w / h, h / w))
    return own.filter((F.col("fill") >= min_fill) & (F.col("aspect") <= max_aspect))


def spread_penalty(area: str, box_area: str, region_area: str, aspect: str, fill: str) -> Column:
    """How much a region looks like background: it fills its surroundings, spreads thinly over them, or is a long strip of
    them; 0.95 at most."""
    share = F.col(area) / F.col(region_area)
    filled = F.when(share > 0.45, F.least((share - 0.45) / 0.35, F.lit(0.85))).otherwise(0.0)
    thin = F.when((F.col(box_area) / F.col(region_area) > 0.55) & (F.col(fill) < 0.55), 0.35).otherwise(0.0)
    strip = F.when((F.col(aspect) > 3) & (share > 0.20), 0.25).otherwise(0.0)
    return F.when(F.col(region_area) > 0, F.least(filled + thin + strip, F.lit(0.95))).otherwise(0.0)


def reflection_penalty(saturation: str, value: str, y: str, seed_y: str) -> Column:
    """0.35 for what is below the seed, pale and dark on average."""
    return F.when((F.col(y) > F.col(seed_y)) & (F.col(saturation) < 55) & (F.col(value) < 170), 0.35).otherwise(0.0)


def negative_points(width: Column, height: Column, margin: float = 12.0) -> Column:
    """Points [x, y] above, below, left and right of the box (x1, y1, x2, y2), moved into the image; none in the box."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    within = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), n.cast("double") - 1)
    around = F.array(*[F.array(within(x, width), within(y, height)) for x, y in ((mx, y1 - margin), (mx, y2 + margin), (x1 - margin, my), (x2 + margin, my))])
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), F.filter(around, lambda p: ~(p[0].between(x1, x2) & p[1].between(y1, y2)))).otherwise(F.array().cast("array<array<double>>"))


def scan_frames(frames: DataFrame, keys: list[str], k: int, mode: str = "uniform", by: str = "frame") -> DataFrame:
    """Of each group's rows the frames to scan, at least two: the first (start), those about the middle, or evenly apart
    from the first to the last (uniform); all, where there are no more."""
    k, own = max(2, k), windows.numbered(frames, keys, by)
    i, n = F.col("i"), F.col("n")
    if mode == "start":
        chosen = i < k
    elif mode == "middle":
        end = F.least(n, F.greatest(F.floor(n / 2) - k // 2, F.lit(0)) + k)
        chosen = (i >= end - k) & (i < end)
    elif mode == "uniform":
        step = (n - 1) / F.lit(float(k - 1))
        chosen = F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.when(j == k - 1, n - 1).otherwise(F.floor(j * step)).cast("long")), i.cast("long"))
    else:
        raise ValueError(f"no way of scanning is named {mode}")
    return own.filter((n <= k) | chosen).drop("i", "n")


def first_eligible(shapes: DataFrame, video: str = "video", min_area: int = 1, min_side: int = 1, min_margin: int = 0, padding: int = 0) -> DataFrame:
    """Each video's first frame whose mask (area, inclusive box x1 .. y2, image_w, image_h) is large enough and far enough
    from the border; its box, widened but kept in the image, and the place (cx, cy) to prompt. Videos without one have no row."""
    if min(min_area, min_side, min_margin, padding) < 0:
        raise ValueError("gates and padding must not be negative")
    c = F.col
    margin = F.least(c("x1"), c("y1"), c("image_w") - 1 - c("x2"), c("image_h") - 1 - c("y2"))
    large = (c("area") >= min_area) & (F.least(c("x2") - c("x1"), c("y2") - c("y1")) + 1 >= min_side)
    first = shapes.filter(large & (margin >= min_margin)).groupBy(video).agg(F.min(F.struct("frame", "cx", "cy", "x1", "y1", "x2", "y2", "image_w", "image_h")).alias("b")).select(video, "b.*")
    low = lambda a: F.greatest(c(a) - padding, F.lit(0))
    high = lambda a, n: F.least(c(a) + padding, c(n) - 1)
    return first.select(video, "frame", "cx", "cy", low("x1").alias("x1"), low("y1").alias("y1"), high("x2", "image_w").alias("x2"), high("y2", "image_h").alias("y2"))


def first_pass(records: DataFrame, keys: list[str], order: str = "pass", by: str = "frame") -> DataFrame:
    """Of each frame the rows of the pass that wrote it first, all its objects (order: 0 forward, 1 reverse)."""
    return records.withColumn("_first", F.min(order).over(Window.partitionBy(*keys, by))).filter(F.col(order) == F.col("_first")).drop("_first")
