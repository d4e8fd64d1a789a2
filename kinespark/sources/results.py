"""Results of ``pipeline.evaluate`` in their two outer forms: rows of twenty fixed columns, and one JSON document a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions.exprs import finite, slug

#: The columns of a result, in order.
COLUMNS = [
    "Index", "Prompt_ID", "Video_File", "Tracking_JSON", "Module", "Metric", "Evaluator", "Measurement_Method", "Target_Type", "Target_Value", "Target_Unit",
    "Measured_Value", "Measured_Unit", "Absolute_Error", "Relative_Error", "Fit_R2", "Scale_m_per_px", "Status", "Failure_Reason", "Extra_JSON",
]
_GIVEN = COLUMNS[:11]


def fixed_rows(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """The twenty columns of each row of metadata. Errors stand where measurement and target are finite numbers: the relative
    one is against the target's size, or plain where the target is zero."""
    own = metadata.select("Prompt_ID", *[(F.col(c) if c in metadata.columns else F.lit(None).cast("string")).alias(c) for c in _GIVEN if c != "Prompt_ID"])
    got = results.select(F.col("prompt_id").alias("Prompt_ID"), F.col("measured").alias("Measured_Value"), F.col("unit").alias("Measured_Unit"), F.col("fit_r2").alias("Fit_R2"), F.col("scale_m_per_px").alias("Scale_m_per_px"), F.col("status").alias("Status"), F.col("failure_reason").alias("Failure_Reason"))
    out = own.join(got, "Prompt_ID", "left")
    target = finite("Target_Value")
    off = F.abs(F.col("Measured_Value") - target)
    size = F.when(F.abs(target) > 1e-12, F.abs(target)).otherwise(F.lit(1.0))
    return out.withColumns({"Absolute_Error": off, "Relative_Error": off / size, "Status": F.coalesce("Status", F.lit("failed")), "Failure_Reason": F.coalesce("Failure_Reason", F.lit("")), "Extra_JSON": F.lit("{}")}).select(*COLUMNS)


def folder(name: Column, fallback: Column) -> Column:
    """A name as a folder: letters, digits, dash and underscore."""
    own = slug(F.trim(F.coalesce(name.cast("string"), F.lit(""))))
    return F.when(own != "", own).otherwise(fallback)


def documents(results: DataFrame, metadata: DataFrame) -> DataFrame:
    """metric and prompt_id (names of folders) and document, the JSON of one video: its metadata, measurement, gate and masks."""
    rows = fixed_rows(results, metadata)
    physics = F.struct(*[F.col(c) for c in COLUMNS if c != "Extra_JSON"]).alias("physics_result")
    told = results.select(F.col("prompt_id").alias("Prompt_ID"), "tracking", "tracking_reasons", "actual_objects", "path_norm", "extent_norm", "mask_status", "qmask", "mask_reasons", "expected")
    split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda t: t != "")
    gate = F.struct(F.col("tracking").alias("status"), "actual_objects", F.col("expected").alias("expected_objects"), split("tracking_reasons").alias("reasons"), F.col("extent_norm").alias("motion_extent_norm_by_diameter"), F.col("path_norm").alias("path_length_norm_by_diameter"))
    masks = F.struct(F.coalesce("mask_status", F.lit("not_evaluated")).alias("status"), F.col("qmask").alias("score"), split("mask_reasons").alias("reasons"))
    row = F.struct(*[F.col(f"`{c}`") for c in metadata.columns]).alias("metadata")
    own = rows.select("Prompt_ID", physics).join(metadata.select("Prompt_ID", row), "Prompt_ID").join(told, "Prompt_ID", "left")
    m, p = F.col("metadata"), F.col("Prompt_ID")
    body = F.struct(F.lit(1).alias("schema_version"), p.alias("prompt_id"), m["Metric"].alias("metric"), "metadata", "physics_result", masks.alias("mask_qc"), gate.alias("tracking_quality"))
    return own.select(folder(m["Metric"], F.lit("unknown_metric")).alias("metric"), folder(p, F.lit("unnamed")).alias("prompt_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def parsed(tree: DataFrame) -> DataFrame:
    """What scoring needs of each document, typed: metric, prompt_id, status, measured, target, rel_error, tracking, reasons."""
    v = F.try_parse_json("document")
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    return tree.select(
        F.coalesce(get("metric", "string"), "metric").alias("metric"), F.coalesce(get("prompt_id", "string"), "prompt_id").alias("prompt_id"), get("physics_result.Status", "string").alias("status"), get("physics_result.Measured_Value", "double").alias("measured"),
        get("physics_result.Target_Value", "double").alias("target"), get("physics_result.Relative_Error", "double").alias("rel_error"), get("tracking_quality.status", "string").alias("tracking"), F.array_join(get("tracking_quality.reasons", "array<string>"), ";").alias("tracking_reasons"),
    )
