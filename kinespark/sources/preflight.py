"""Checks before a run: metadata with its videos, videos against a manifest, and starting prompts. Each rule is a column;
reports are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.functions.exprs import clean_json
from kinespark.operators import evaluators
from kinespark.operators.rules import GroupRule, Rule, RowRule, report
from kinespark.sources.containers import read_containers


def read_videos(spark: SparkSession, root: str) -> DataFrame:
    """path, name, size, sha256, whether it begins like an MP4 and the sample counts its tables declare."""
    return read_containers(spark, root).select("path", "name", "size", "sha256", "header_ok", "sample_counts")


def video_report(videos: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest: name, size, sha256. (severity, name, problem) of files that are missing, unlisted or other than listed."""
    both = manifest.alias("m").join(videos.alias("v"), "name", "full")
    problem = (
        F.when(F.col("v.path").isNull(), "missing").when(F.col("m.size").isNull(), "not in the manifest").when(F.col("v.size") != F.col("m.size").cast("long"), "size differs")
        .when(F.col("v.sha256") != F.upper("m.sha256"), "content differs").when(~F.col("v.header_ok"), "no MP4 header")
    )
    found = both.select("name", problem.alias("problem")).filter("problem is not null")
    return found.select(F.when(F.col("problem") == "not in the manifest", "warning").otherwise("error").alias("severity"), "name", "problem")


def _points(v: Column, *names: str) -> Column:
    """A list of places; a single pair is a list of one."""
    many = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "array<array<double>>") for n in names])
    one = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "array<double>") for n in names])
    nested = F.exists(many, lambda p: p.isNotNull()) | (F.size(many) == 0)
    return F.coalesce(F.when(nested, many), F.when(one.isNotNull(), F.array(one)))


def _place_ok(p: Column) -> Column:
    return (F.size(p) == 2) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))


def checked_prompts(listed: Column) -> Column:
    """A list of prompts (array of variant) as structs: object_id, frame_idx, positive_points, negative_points, box, source, error."""
    get = lambda p, kind, *names: F.coalesce(*[F.try_variant_get(p, f"$.{x}", kind) for x in names])
    read = F.transform(
        listed,
        lambda p, k: F.struct(
            F.coalesce(get(p, "int", "object_id"), k + 1).alias("object_id"), F.coalesce(get(p, "int", "frame_idx", "frame"), F.lit(0)).alias("frame_idx"), _points(p, "positive_points", "points", "point").alias("positive_points"),
            F.coalesce(_points(p, "negative_points"), F.array().cast("array<array<double>>")).alias("negative_points"), get(p, "array<double>", "box").alias("box"), F.coalesce(get(p, "string", "source"), F.lit("manual")).alias("source"),
            F.schema_of_variant(p).startswith("OBJECT").alias("is_object"),
        ),
    )

    def error(p: Column) -> Column:
        box, pos, points = p["box"], p["positive_points"], F.concat(p["positive_points"], p["negative_points"])
        bad_box = box.isNotNull() & ~((F.size(box) == 4) & F.forall(box, lambda x: x >= 0) & (F.get(box, F.lit(2)) >= F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) >= F.get(box, F.lit(1))))
        outside = box.isNotNull() & F.exists(pos, lambda q: ~(q[0].between(box[0], box[2]) & q[1].between(box[1], box[3])))
        return (
            F.when(~p["is_object"], "prompt is no object").when(p["object_id"] < 1, "object ids are positive").when(p["frame_idx"] < 0, "frames are not negative")
            .when(F.coalesce(F.size(pos), F.lit(0)) < 1, "no positive point").when(F.exists(points, lambda q: ~F.coalesce(_place_ok(q), F.lit(False))), "points are pairs of numbers that are not negative")
            .when(F.coalesce(bad_box, F.lit(True)) & box.isNotNull(), "box is no x1, y1, x2, y2").when(outside, "box leaves out a positive point")
        )

    names = ("object_id", "frame_idx", "positive_points", "negative_points", "box", "source")
    return F.transform(read, lambda p: F.struct(*[p[n].alias(n) for n in names], error(p).alias("error")))


def prompt_list(text: Column, expected: Column) -> tuple[Column, Column]:
    """The list in a JSON text, and what is wrong with it as a whole."""
    listed = F.try_variant_get(F.try_parse_json(clean_json(text)), "$", "array<variant>")
    return listed, F.when(listed.isNull(), "prompts are no JSON list").when(F.size(listed) != expected, "prompt count differs from the number of objects")


def prompts(rows: DataFrame, column: str = "Tracking_Prompts_JSON", expected: str = "Num_Objects") -> DataFrame:
    """Each row's prompts, one row a prompt: all columns of rows, object_id, frame_idx, positive_points, negative_points, box
    and source; error says what is wrong with the row's prompts as a whole or with this one."""
    listed, whole = prompt_list(F.col(column), F.greatest(F.coalesce(F.col(expected).cast("int"), F.lit(1)), F.lit(1)))
    each = rows.withColumns({"_whole": whole, "_list": checked_prompts(listed)}).select("*", F.explode_outer("_list").alias("_p"))
    fields = [F.col(f"_p.{n}").alias(n) for n in ("object_id", "frame_idx", "positive_points", "negative_points", "box", "source")]
    return each.select(*rows.columns, *fields, F.coalesce("_whole", "_p.error").alias("error"))


#: The least bytes of a plausible video, and the evaluator whose tracks come from a renderer's masks.
LEAST_BYTES, RENDERED = 1024, "eval_oracle_tracking"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), r"^\s+|\s+$", "")


def path_problem(path: Column) -> Column:
    """Why a path can't be used on another machine, else null."""
    text = _stripped(F.coalesce(path.cast("string"), F.lit("")))
    return (
        F.when(text == "", "path is empty").when(F.contains(text, F.lit("\\")), "path has backslashes").when(text.rlike("^(/|[A-Za-z]:)"), "path is not relative")
        .when(F.array_contains(F.split(text, "/"), ".."), "path leaves its folder")
    )


def folder_name(name: Column) -> Column:
    """The name with _ for all but letters, digits, - and _, and none of these at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")


def renderer_problem(known: Column) -> Column:
    """What a renderer's masks lack in the parameters (variant): a pattern with a frame, and a colour of 3 or 4 bytes."""
    pattern = F.when(F.schema_of_variant(F.try_variant_get(known, "$.gt_mask_pattern", "variant")) == "STRING", F.try_variant_get(known, "$.gt_mask_pattern", "string"))
    colour = F.try_variant_get(known, "$.gt_rgba", "array<variant>")
    byte = lambda v: F.schema_of_variant(v).rlike("^(BIGINT|BOOLEAN)$") & F.coalesce(F.try_variant_get(v, "$", "int").between(0, 255), F.lit(False))
    return (
        F.when(~F.coalesce(F.contains(pattern, F.lit("{frame")), F.lit(False)), "mask pattern has no frame").when(colour.isNull() | ~F.size(colour).isin(3, 4), "colour is no list of 3 or 4")
        .when(~F.forall(colour, lambda v: F.coalesce(byte(v), F.lit(False))), "colour is not of bytes")
    )


def with_terms(rows: DataFrame) -> DataFrame:
    """Rows with what several rules look at, read once: _name, _given, _known (variant), _number, _evaluator, _expected."""
    number = F.nullif(F.trim(F.col("Num_Objects").cast("string")), F.lit(""))
    given = F.nullif(F.trim("Known_Parameters_JSON"), F.lit(""))
    return rows.withColumns({
        "_name": _stripped(F.coalesce(F.col("Prompt_ID").cast("string"), F.lit(""))), "_given": given, "_known": F.try_parse_json(clean_json(given)), "_number": F.when(number.isNotNull(), F.coalesce(number.try_cast("double"), F.lit(-1.0))),
        "_evaluator": F.coalesce(F.col("Evaluator").cast("string"), F.lit("")), "_expected": F.trim(F.col("Expected_Frame_Count").cast("string")).try_cast("double").try_cast("long"),
    })


def metadata_rules() -> list[Rule]:
    """The rules for rows of metadata (``with_terms``) joined with their containers (_path_problem, _path, _found, _size,
    _header, _counts)."""
    c, no = F.col, F.lit(None).cast("string")
    name, given, known, number, evaluator, expected = [c(f"_{n}") for n in ("name", "given", "known", "number", "evaluator", "expected")]
    path, at, listed = c("_path_problem"), c("_path"), F.size("_counts") > 0
    plausible = c("_found") & (c("_size") >= LEAST_BYTES) & c("_header")
    verified = plausible & F.array_contains("_counts", expected)
    return [
        RowRule("index_given", "error", F.when(c("Index").isNull(), "no index")), GroupRule("index_unique", "error", c("Index"), name),
        RowRule("id_given", "error", F.when(c("Prompt_ID").isNull(), "no id")), GroupRule("id_unique", "error", c("Prompt_ID"), name),
        RowRule("id_safe", "error", F.when(~name.rlike(r"\A[A-Za-z0-9_-]+\z"), "id is not safe in paths")), GroupRule("folder_unique", "error", folder_name(name), name, differ=True),
        RowRule("evaluator_known", "error", F.when(~evaluator.isin(*evaluators.NAMES), F.concat(F.lit("unknown evaluator "), evaluator))),
        RowRule("parameters", "error", F.when(given.isNotNull() & ~F.coalesce(F.schema_of_variant(known).startswith("OBJECT"), F.lit(False)), "parameters are no JSON object")),
        RowRule("objects_positive", "error", F.when(number.isNotNull() & (number != 0) & (number < 1), "number of objects is not positive")),
        RowRule("video_path", "error", path), GroupRule("video_once", "warning", at, name),
        RowRule("video_there", "error", F.when(at.isNotNull() & ~c("_found"), "video missing")), RowRule("video_plausible", "error", F.when(c("_found") & ~plausible, "no plausible MP4")),
        RowRule("frames_match", "error", F.when(plausible & listed & ~F.array_contains("_counts", expected), F.concat(F.lit("expected "), expected, F.lit(" frames, declared "), F.array_join(F.transform("_counts", lambda n: n.cast("string")), ", ")))),
        RowRule("frames_declared", "warning", F.when(plausible & ~listed & expected.isNotNull(), "no frame count declared")),
        RowRule("renderer", "error", F.when(plausible & (evaluator == RENDERED), renderer_problem(known)).otherwise(no)),
        RowRule("videos_verified", "ok", F.when(plausible, "plausible MP4")), RowRule("frames_verified", "ok", F.when(verified, "frame count declared")),
    ]


def metadata_report(metadata: DataFrame, videos: DataFrame, extra: list[Rule] | None = None) -> DataFrame:
    """Lines (``rules.report``) of metadata against the containers of its videos (relative, size, header_ok, sample_counts, as
    ``read_containers`` gives them). Columns that metadata lacks count as null; of rows of one path in videos the largest
    counts. Video rules stop at the first that fails: path, file, header, frames. One join and one grouping."""
    for column in ("Index", "Prompt_ID", "Evaluator", "Known_Parameters_JSON", "Num_Objects", "Video_File", "Expected_Frame_Count"):
        if column not in metadata.columns:
            metadata = metadata.withColumn(column, F.lit(None).cast("string"))
    own = videos.groupBy(F.col("relative").alias("_path")).agg(F.max(F.struct("size", "header_ok", "sample_counts")).alias("_v"))
    rows = with_terms(metadata).withColumn("_path_problem", path_problem(F.col("Video_File"))).withColumn("_path", F.when(F.col("_path_problem").isNull(), _stripped(F.col("Video_File"))))
    both = rows.join(own, "_path", "left").withColumns({
        "_found": F.col("_v").isNotNull(), "_size": F.col("_v.size"), "_header": F.coalesce("_v.header_ok", F.lit(False)), "_counts": F.coalesce("_v.sample_counts", F.array().cast("array<bigint>")),
    })
    return report(both, metadata_rules() + (extra or []), F.col("Prompt_ID"))
