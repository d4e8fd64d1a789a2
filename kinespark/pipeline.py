"""End to end: sample metadata and tracking documents to results, results to scores and reports. Every step is a plan keyed
by video; nothing is collected but the counts that decide whether a report is refused."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinespark.functions.exprs import canonical_id, equivalent_diameter, finite, mask_centre, relative_error
from kinespark.operators import evaluators, gates, masks, scoring
from kinespark.sources import metadata as meta_source
from kinespark.sources import sinks, tracking

SCORE_COLUMNS = ["model", "metric", "prompt_id"]


def parameters(metadata: DataFrame) -> DataFrame:
    """Metadata rows (columns of sample metadata) as the evaluators take them, keyed by prompt."""
    own = evaluators.with_task_defaults(metadata)
    own = meta_source.with_parameters(own) if "Known_Parameters_JSON" in own.columns else own
    names = {"Motion_Axis": "motion_axis", "Scale_Mode": "scale_mode", "Calibration_Dimension": "calibration_dimension", "Calibration_Value_m": "calibration_value", "Target_Value": "target_value"}
    own = own.withColumns({b: F.col(a) for a, b in names.items() if a in own.columns})
    return own.withColumns({"evaluator": F.col("Evaluator"), "video": F.col("Prompt_ID"), "metric": F.col("Metric"), "expected": F.greatest(F.coalesce(F.col("Num_Objects").try_cast("int"), F.lit(1)), F.lit(1))})


def gate_records(records: DataFrame) -> DataFrame:
    """Tracking records as the gate takes them: a place is the centroid's or else the coordinates', a diameter that of the
    area or else of the box; entries: how many frames are listed."""
    two = F.size("centroid") >= 2
    place = lambda i, c: F.when(two, F.get("centroid", F.lit(i))).otherwise(F.col(c))
    side = lambda i: F.get("box", F.lit(i + 2)) - F.get("box", F.lit(i)) + 1
    entries = F.max(F.col("pos") + 1).over(Window.partitionBy("video"))
    own = [finite(place(0, "x")).alias("x"), finite(place(1, "y")).alias("y"), "valid", equivalent_diameter("area", side(0), side(1)).alias("diameter")]
    return records.select("video", "object_id", F.when(F.col("pos").isNotNull(), F.col("frame")).alias("frame"), *own, "pos", "place", F.coalesce(entries, F.lit(0)).alias("entries"))


def without_documents(estimates: DataFrame, errors: DataFrame) -> DataFrame:
    """Videos whose document gives no track (errors: video, error) failed, unless their evaluator isn't known."""
    bad = F.col("format_error").isNotNull() & ~F.startswith("failure_reason", F.lit("unknown_evaluator:"))
    out = estimates.join(errors.withColumnRenamed("error", "format_error"), "video", "left")
    lost = {c: F.when(~bad, F.col(c)) for c in ("measured", "unit", "fit_r2", "scale_m_per_px", "given")}
    return out.withColumns(lost | {"status": F.when(bad, "failed").otherwise(F.col("status")), "failure_reason": F.when(bad, "failed").otherwise(F.col("failure_reason"))}).drop("format_error")


def mask_series(records: DataFrame) -> DataFrame:
    """What the masks of each object are in each listed frame, from tracking records: no mask where one is marked invalid
    and has no area."""
    b, side = F.col("box"), lambda i: F.get("box", F.lit(i + 2)) - F.get("box", F.lit(i)) + 1
    cx, cy = mask_centre("centroid", "box")
    lost = (F.col("valid") == False) & (F.coalesce("area", F.lit(0.0)) == 0)  # noqa: E712
    area = F.when(~F.coalesce(lost, F.lit(False)), F.coalesce("area", F.when(b.isNotNull(), side(0) * side(1))))
    return records.filter("frame is not null").select("video", "object_id", "frame", area.alias("area"), side(0).alias("box_w"), side(1).alias("box_h"), F.coalesce(cx, "x").alias("cx"), F.coalesce(cy, "y").alias("cy"))


def evaluate(metadata: DataFrame, documents: DataFrame, ious: DataFrame | None = None, strict: bool = False, unstable: str = "warn") -> DataFrame:
    """metadata: sample metadata; documents: video (the prompt) and text, the tracking JSON; ious: video, object_id and
    iou_median from the pixels. One result for each row of metadata: measurement, its error, the tracking gate and the
    quality of the masks. unstable="skip" makes a video fail whose masks are to be kept out, with mask_area_unstable."""
    own = parameters(metadata)
    # four branches read the records: texts are dealt by video, parsed once and kept as far as memory and disk allow
    raw = tracking.records(documents.select("video", "text").repartition("video"), "video", "text").persist(StorageLevel.MEMORY_AND_DISK)
    points = tracking.normalised(raw)
    estimates = evaluators.estimate(points, own, strict).select("video", "status", "measured", "unit", "fit_r2", F.col("scale").alias("scale_m_per_px"), F.col("reason").alias("failure_reason"), F.col("error").alias("given"))
    estimates = without_documents(estimates, tracking.track_errors(raw, points))
    gate = gates.tracking_gate(gate_records(raw), own.select("video", "expected"), total="entries")
    broken = raw.groupBy("video").agg(F.max(F.when(F.col("error") == tracking.NOT_JSON, "tracking_json_unreadable:JSONDecodeError").when(F.col("error") == tracking.NO_DOCUMENT, "tracking_json_unreadable:ValueError")).alias("broken"))
    gate = gate.join(broken, "video").select("video", F.col("status").alias("tracking"), F.coalesce("broken", F.concat_ws(";", "reasons")).alias("tracking_reasons"), F.col("counted").alias("actual_objects"), "path_norm", "extent_norm")
    objects = masks.diagnostics(mask_series(raw), ["video", "object_id"], ious)
    keep = F.bool_and(F.col("decision") == "keep").alias("stable")
    quality = masks.video_quality(objects, ["video"]).join(objects.groupBy("video").agg(keep), "video")
    quality = quality.select("video", F.col("score").alias("qmask"), F.col("status").alias("mask_status"), F.concat_ws(";", "reasons").alias("mask_reasons"), "stable")
    kept = [F.col(c) for c in ("model", "Module", "Target_Unit", "Target_Type") if c in own.columns]
    out = own.select("video", F.col("Prompt_ID").alias("prompt_id"), "metric", "expected", F.col("target_value").cast("double").alias("target"), *kept)
    out = out.join(estimates, "video", "left").join(gate, "video", "left").join(quality, "video", "left")
    lost = F.col("tracking").isNull()
    out = out.withColumns({"tracking": F.coalesce("tracking", F.lit("flagged")), "tracking_reasons": F.when(lost, "tracking_json_missing").otherwise(F.col("tracking_reasons"))})
    if unstable == "skip":
        bad = F.coalesce(~F.col("stable"), F.lit(False))
        gone = {"given": F.when(~bad, F.col("given")), "measured": F.when(~bad, F.col("measured")), "fit_r2": F.when(~bad, F.col("fit_r2")), "status": F.when(bad, "failed").otherwise(F.col("status")), "failure_reason": F.when(bad, "mask_area_unstable").otherwise(F.col("failure_reason"))}
        out = out.withColumns(gone)
    energy = F.col("metric").isin("energy", "mechanical_energy_conservation") | (F.coalesce(F.col("Target_Type"), F.lit("")) == "energy_conservation_ratio" if "Target_Type" in own.columns else F.lit(False))
    error = relative_error("measured", "target", "given", "unit", "Target_Unit" if "Target_Unit" in own.columns else None, energy)
    return out.withColumn("rel_error", error).drop("video", "stable", "given")


def score(results: DataFrame, metadata: DataFrame | None = None, **options) -> DataFrame:
    """Scores of results (``evaluate``); refuses results without a score, and, with metadata, sets of results that lack
    prompts, have others or repeat some."""
    scored = scoring.score_videos(results, **options)
    if not options.get("allow_contract_errors"):
        scoring.require_scores(scored)
    if metadata is not None:
        scoring.require_complete(results, metadata, "prompt_id", "Prompt_ID")
    return scored


def report(scored: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """The score reports below path: videos, metrics and reasons as CSV, models as JSON."""
    keys = keys or [c for c in ("model", "metric") if c in scored.columns]
    plain = scored.drop(*[f.name for f in scored.schema if f.dataType.typeName() in ("array", "map", "struct")])
    sinks.write_csv(plain, f"{path}/per_video_scores")
    summary = scoring.full_summary(scored, keys)
    nested = {f.name: F.to_json(f.name) for f in summary.schema if f.dataType.typeName() in ("map", "struct")}
    sinks.write_csv(summary.withColumns(nested), f"{path}/metric_scores", single=True)
    sinks.write_csv(sinks.reason_report(scoring.token_counts(scored, "exclusion_reasons")), f"{path}/score_exclusion_reasons", single=True)
    if "model" in scored.columns:
        sinks.write_json(scoring.macro(scored), f"{path}/score_summary", single=True)


def refusal(results: DataFrame, metadata: DataFrame, path: str, **options) -> DataFrame:
    """What keeps a set of results from being scored, also written below path: (problem, id, n)."""
    unscored = scoring.score_videos(results, **options).filter(~F.col("score_available"))
    lacks = unscored.select(F.lit("score_unavailable").alias("problem"), F.coalesce(canonical_id("prompt_id"), "prompt_id").alias("id"), F.lit(1).cast("long").alias("n"))
    every = lacks.unionByName(scoring.completeness(results, metadata, "prompt_id", "Prompt_ID"))
    sinks.write_json(every, f"{path}/incomplete_report", single=True)
    return every
