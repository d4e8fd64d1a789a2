"""Tracking settings of single videos: checked overrides, the number of objects and the hint of what to track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions.exprs import clean_json, finite

#: Other names of settings.
ALIASES = {
    "auto_init_num_objects": "num_objects",
    "tracking_num_objects": "num_objects",
    "auto_init_detector": "detector",
    "scan_frames": "auto_init_scan_frames",
    "scan_mode": "auto_init_scan_mode",
    "threshold": "auto_init_threshold",
    "min_area": "auto_init_min_area",
    "max_area_ratio": "auto_init_max_area_ratio",
    "min_fill_ratio": "auto_init_min_fill_ratio",
    "max_aspect_ratio": "auto_init_max_aspect_ratio",
    "object_refine": "auto_init_object_refine",
    "box_expand": "auto_init_box_expand",
    "target_hint": "auto_init_target_hint",
    "shadow_filter_disabled": "disable_auto_init_shadow_filter",
    "negative_points_disabled": "no_auto_init_negative_points",
    "box_disabled": "no_auto_init_box",
    "bidirectional_propagation_disabled": "no_bidirectional_propagation",
}
#: The settings by what they may be.
KINDS = {
    "count": ("num_objects", "auto_init_scan_frames", "auto_init_min_area"),
    "share": ("yolo_conf", "yolo_iou", "auto_init_max_area_ratio", "auto_init_min_fill_ratio"),
    "positive": ("auto_init_threshold", "auto_init_max_aspect_ratio", "auto_init_box_expand"),
    "flag": ("auto_init_object_refine", "disable_auto_init_shadow_filter", "no_auto_init_negative_points", "no_auto_init_box", "no_bidirectional_propagation", "offload_video_to_cpu"),
    "text": ("yolo_classes", "auto_init_target_hint"),
    "detector": ("detector",),
    "scan mode": ("auto_init_scan_mode",),
}
DETECTOR, SCAN_MODES = "yolo_then_motion", ("start", "middle", "uniform")
_WANTED = {"count": "a positive integer", "share": "in [0, 1]", "positive": "> 0", "flag": "a boolean", "text": "a string or null", "detector": DETECTOR, "scan mode": "start, middle or uniform"}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _value(kind: Column, v: Column) -> Column:
    """The value as text if it is of its kind, else null; numbers may be written as text, but truth values are none."""
    written, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = F.when(written != "BOOLEAN", finite(text))
    low = F.when(written == "STRING", F.trim(F.lower(text))).when(written == "BOOLEAN", text).when(number.isin(0.0, 1.0), number.cast("int").cast("string"))
    flag = F.when(low.isin("true", "yes", "1"), "true").when(low.isin("false", "no", "0"), "false")
    plain = F.when(written == "STRING", text)
    return (
        F.when(kind == "count", F.when((number >= 1) & (number == F.floor(number)), number.cast("long").cast("string"))).when(kind == "share", F.when(number.between(0, 1), number.cast("string")))
        .when(kind == "positive", F.when(number > 0, number.cast("string"))).when(kind == "flag", flag).when(kind == "text", plain).when(kind == "detector", F.when(plain == DETECTOR, plain)).when(kind == "scan mode", F.when(plain.isin(*SCAN_MODES), plain))
    )


def tracking_overrides(rows: DataFrame, column: str = "Tracking_Overrides_JSON", parameters: str = "Known_Parameters_JSON") -> DataFrame:
    """Adds overrides, a map of settings under their own names to checked values as text, and override_errors. They come from
    the column or, where it is null or empty, from tracking_overrides among the parameters. Nothing is collected: rules are
    maps in the plan, so any number of videos is checked in one pass. JSON that names a key twice counts as no object."""
    known = lambda c: F.try_parse_json(clean_json(F.nullif(F.trim(c), F.lit("")))) if c in rows.columns else F.lit(None).cast("variant")
    given = F.nullif(F.trim(column), F.lit("")).isNotNull() if column in rows.columns else F.lit(False)
    raw = F.when(given, known(column)).otherwise(F.try_variant_get(known(parameters), "$.tracking_overrides", "variant"))
    found = F.map_entries(F.try_variant_get("_raw", "$", "map<string,variant>"))
    kinds = _map({name: kind for kind, names in KINDS.items() for name in names})
    name = lambda e: F.coalesce(F.try_element_at(_map(ALIASES), e["key"]), e["key"])
    kind = lambda e: F.try_element_at(kinds, name(e))
    checked = F.transform(found, lambda e: F.struct(e["key"].alias("given"), name(e).alias("key"), kind(e).alias("kind"), _value(kind(e), e["value"]).alias("value"), ((kind(e) == "text") & (F.schema_of_variant(e["value"]) == "VOID")).alias("none")))
    out = rows.withColumn("_raw", raw).withColumn("_all", F.coalesce(checked, F.array().cast("array<struct<given:string,key:string,kind:string,value:string,none:boolean>>")))
    bad = F.transform(
        "_all",
        lambda e: F.when(e["kind"].isNull(), F.concat(F.lit("unsupported setting "), e["given"])).when(F.size(F.filter("_all", lambda o: o["key"] == e["key"])) > 1, F.concat(F.lit("repeated setting "), e["key"]))
        .when(e["value"].isNull() & ~F.coalesce(e["none"], F.lit(False)), F.concat(e["key"], F.lit(" must be "), F.element_at(_map(_WANTED), e["kind"]))),
    )
    no_object = F.when(given & (F.col("_raw").isNull() | ~F.schema_of_variant("_raw").rlike("^(OBJECT|VOID)")), F.lit("overrides are no JSON object"))
    out = out.withColumn("override_errors", F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(no_object), bad)))))
    good = F.transform("_all", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return out.withColumn("overrides", F.when(F.size("override_errors") == 0, F.map_from_entries(good))).drop("_raw", "_all")


def object_count(rows: DataFrame, *columns: str) -> Column:
    """The first of these columns that is a whole number, one at least; one without."""
    return F.greatest(F.coalesce(*[F.trim(F.col(c).cast("string")).try_cast("int") for c in columns if c in rows.columns], F.lit(1)), F.lit(1))


def target_hint(parameters: str = "Known_Parameters_JSON", calibration: str = "Calibration_Object", tracked: str = "Tracking_Objects") -> Column:
    """What to track: the first that is named, and isn't none, of the parameters' object, tracking_target and target_object
    and the object of known size; else what the table says is tracked, without _center."""
    known = F.try_parse_json(clean_json(F.nullif(F.trim(parameters), F.lit(""))))
    named = [F.try_variant_get(known, f"$.{n}", "string") for n in ("object", "tracking_target", "target_object")] + [F.col(calibration)]
    told = [F.when((F.lower(c) != "none") & (c != ""), c) for c in named]
    return F.coalesce(*told, F.replace(F.coalesce(F.nullif(F.col(tracked), F.lit("")), F.lit("object")), F.lit("_center"), F.lit("")))
