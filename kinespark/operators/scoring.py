"""Scores of videos and their summaries: one projection, then one grouping for each level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions.exprs import base_score, canonical_id, reasons
from kinespark.operators import selection

#: Tolerance of each metric; others have 0.25.
TOLERANCES = {
    "velocity": 0.30,
    "acceleration": 0.35,
    "gravity": 0.30,
    "friction": 0.35,
    "friction_coefficient": 0.35,
    "restitution": 0.30,
    "restitution_coefficient": 0.30,
    "density": 0.35,
    "density_acceleration": 0.35,
    "density_from_initial_acceleration": 0.35,
    "viscosity": 0.40,
    "fluid_viscosity": 0.40,
    "spring": 0.35,
    "spring_constant": 0.35,
    "energy": 0.35,
    "mechanical_energy_conservation": 0.35,
    "momentum": 0.35,
    "momentum_1d": 0.35,
    "momentum_conservation_1d": 0.35,
}
DEFAULT_TOLERANCE, WEAK_VALID = 0.25, 0.8
OVERLAPS = ("tracking_only", "physics_only", "both_tracking_and_physics", "neither")


class IncompleteResults(ValueError):
    """Results that can't be summarised: unscored, missing, unexpected or repeated."""


def tolerance(metric: str = "metric", custom: dict[str, float] | None = None, tau: float | None = None) -> Column:
    if tau is not None:
        if tau <= 0:
            raise ValueError("tau must be positive")
        return F.lit(float(tau))
    table = F.create_map(*[F.lit(x) for m, t in (TOLERANCES | (custom or {})).items() for x in (m, float(t))])
    return F.coalesce(F.try_element_at(table, F.col(metric)), F.lit(DEFAULT_TOLERANCE))


def score_videos(results: DataFrame, policy: str = "hard_fail", flag_multiplier: float = 0.5, weak_valid: float = WEAK_VALID, tau: float | None = None, tolerances: dict[str, float] | None = None, allow_contract_errors: bool = False, weak_column: str | None = None) -> DataFrame:
    """results: metric, status, tracking (pass or flagged), rel_error, qmask, mask_status, and what else is to stay.

    policy: flagged tracking is refused (hard_fail), costs flag_multiplier (penalty) or nothing (ignore). Error and mask
    count only where both gates pass. score_available is false where they pass and no score can be computed; without
    allow_contract_errors such rows are to be refused by ``require_scores``."""
    c, passes = F.col, F.col("tracking") == "pass"
    by_policy = {"hard_fail": F.lit(0.0), "penalty": F.lit(float(flag_multiplier)), "ignore": F.lit(1.0)}
    track = F.when(passes, F.lit(1.0)).otherwise(by_policy[policy])
    admitted = passes | (track > 0)
    physics = c("status").isin("valid", "weak_valid")
    both = admitted & physics
    weak = F.col(weak_column) if weak_column else F.lit(float(weak_valid))
    validity = F.when(admitted, F.when(c("status") == "valid", 1.0).when(c("status") == "weak_valid", weak).otherwise(0.0)).otherwise(0.0)
    rel = F.when(both, c("rel_error"))
    base = F.when(both, base_score(c("rel_error"), tolerance("metric", tolerances, tau)))
    quality = F.when(both, c("qmask"))
    combined = F.when(~admitted, 0.0).when(both, track * c("qmask"))
    measured = (
        F.when(~admitted, "fail").when(~physics, "not_evaluated").when(combined.isNull(), "score_unavailable").when(combined <= 0, "fail")
        .when(passes & (c("mask_status") == "pass") & (combined >= 0.999), "pass").otherwise("weak")
    )
    overlap = F.when(~passes & ~physics, "both_tracking_and_physics").when(~passes, "tracking_only").when(~physics, "physics_only").otherwise("neither")
    contract = both & base.isNull()
    excluded = F.when(~admitted, F.array(F.lit("tracking_quality_failed"))).otherwise(reasons((contract, "evaluator_contract_error"), (~both, "physics_status_not_valid")))
    available = ~both | (base.isNotNull() & quality.isNotNull())
    adjusted = F.when(~available, F.lit(None)).when((F.size(excluded) == 0) & base.isNotNull() & quality.isNotNull(), base * validity * track * quality).otherwise(0.0)
    return results.withColumns({
        "both_gates_pass": both, "physics_pass": physics, "tracking_pass": passes, "relative_error": rel, "base_score": base, "status_multiplier": validity, "tracking_multiplier": track,
        "mask_score": quality, "mask_pass": F.when(both, c("mask_status") == "pass").otherwise(False), "measurement_multiplier": combined, "measurement_status": measured, "discard_overlap": overlap,
        "exclusion_reasons": F.concat_ws(";", excluded), "effective": F.size(excluded) == 0, "score_available": available, "adjusted_score": adjusted.cast("double"),
    })


def require_scores(scored: DataFrame) -> DataFrame:
    """The rows, or an error where a score can't be computed."""
    n = scored.filter(~F.col("score_available")).count()
    if n:
        raise IncompleteResults(f"{n} results pass both gates without a score")
    return scored


def _mean(c: str, when: Column | None = None) -> Column:
    return F.avg(F.when(when, F.col(c)) if when is not None else F.col(c))


#: Rows of a group whose values one task may hold.
GATHERED = 1 << 20


def summarise(scored: DataFrame, keys: list[str], gathered: bool | None = None) -> DataFrame:
    """Counts, rates, means, medians and the 90th percentile of a group. Percentiles are exact: where no group has over
    ``GATHERED`` rows (counted first, unless the caller knows), from a group's values in one task; else selected by counts of
    all groups at once (``selection``)."""
    if gathered is None:
        gathered = (scored.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= GATHERED
    flags = {"both_gates_pass": F.col("both_gates_pass"), "physics_pass": F.col("physics_pass"), "tracking_pass": F.col("tracking_pass"), "mask_pass": F.col("mask_pass"), "measurement_pass": F.col("measurement_status") == "pass", "effective": F.col("effective")}
    counts = [F.count_if(v).alias(f"n_{n}") for n, v in flags.items()]
    rates = [(F.count_if(v) / F.count("*")).alias(f"{n}_rate") for n, v in flags.items()]
    errors = {"effective": F.when(F.col("effective"), F.col("relative_error")), "both": F.when(F.col("both_gates_pass"), F.col("relative_error"))}
    stats = {"median_error_effective": ("effective", 0.5), "median_error_both_gates": ("both", 0.5), "p90_error_effective": ("effective", 0.9)}
    own = [F.percentile(errors[e], F.lit(share)).alias(name) for name, (e, share) in stats.items()] if gathered else []
    out = scored.groupBy(*keys).agg(
        F.count("*").alias("n_total"), *counts, *rates, _mean("adjusted_score", F.col("effective")).alias("effective_score"), _mean("base_score", F.col("effective")).alias("effective_base_score"),
        F.avg(F.coalesce("adjusted_score", F.lit(0.0))).alias("end_to_end_score"), F.avg("mask_score").alias("mean_mask_score"), F.avg("measurement_multiplier").alias("mean_measurement_multiplier"), *own,
    )
    if gathered:
        return out
    found = selection.percentiles(scored, keys, stats, errors).select(F.struct(*keys).alias("_group"), *stats)
    return out.withColumn("_group", F.struct(*keys)).join(found, "_group", "left").drop("_group")


#: Columns of statuses and of lists of reasons, with the name of the map of counts that a summary has of each.
STATUS_MAPS = {"status": "status_counts", "mask_status": "mask_qc_counts", "tracking": "tracking_quality_counts", "measurement_status": "measurement_quality_counts"}
REASON_MAPS = {"exclusion_reasons": "score_exclusion_counts", "failure_reason": "failure_reason_counts", "mask_reasons": "mask_qc_reason_counts", "tracking_reasons": "tracking_quality_reason_counts"}


def count_maps(scored: DataFrame, keys: list[str]) -> DataFrame:
    """For each group a map of counts by status and by reason, for each of those columns that is there. Values are counted
    before they are put together, so a map holds as many entries as there are different ones."""
    one = lambda name, value: F.struct(F.lit(name).alias("map"), value.alias("value"))
    tokens = lambda c, name: F.transform(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda t: t != ""), lambda t: one(name, t))
    statuses = [F.array(one(m, F.coalesce(F.col(c).cast("string"), F.lit("None")))) for c, m in STATUS_MAPS.items() if c in scored.columns]
    reasons_ = [tokens(c, m) for c, m in REASON_MAPS.items() if c in scored.columns]
    counted = scored.select(*keys, F.explode(F.concat(*statuses, *reasons_)).alias("e")).groupBy(*keys, "e.map", "e.value").agg(F.count("*").alias("n"))
    of = lambda m: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("map") == m, F.struct("value", "n"))))).alias(m)
    return counted.groupBy(*keys).agg(*[of(m) for c, m in (STATUS_MAPS | REASON_MAPS).items() if c in scored.columns])


def full_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """summarise with the maps of count_maps and the counts and rates of discards."""
    overlaps = overlap_counts(scored, keys)
    counts = overlaps.select(*keys, F.struct(*[F.col(o) for o in OVERLAPS]).alias("discard_overlap_counts"), F.struct(*[F.col(f"{o}_rate").alias(o) for o in OVERLAPS]).alias("discard_overlap_rates"))
    return summarise(scored, keys).join(count_maps(scored, keys), keys).join(counts, keys)


def macro(scored: DataFrame, model: str = "model", metric: str = "metric") -> DataFrame:
    """A model's scores are the means of its metrics' scores; metrics without one don't count. Sums by model and metric,
    then by model: nothing else is gathered."""
    sums = scored.groupBy(model, metric).agg(
        F.count("*").alias("n"), F.count_if("effective").alias("e"), F.sum("mask_score").alias("mask"), F.count("mask_score").alias("masks"),
        _mean("adjusted_score", F.col("effective")).alias("effective_score"), F.avg(F.coalesce("adjusted_score", F.lit(0.0))).alias("end_to_end_score"),
    )
    return sums.groupBy(model).agg(
        F.sum("n").alias("n_total"), F.sum("e").alias("n_effective"), (F.sum("e") / F.sum("n")).alias("effective_rate"), F.try_divide(F.sum("mask"), F.sum("masks")).alias("mean_mask_score"),
        F.avg("effective_score").alias("overall_effective_score"), F.avg("end_to_end_score").alias("overall_end_to_end_score"),
    )


def token_counts(scored: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """How often each reason of a list with semicolons occurs."""
    tokens = scored.select(*(keys or []), F.explode(F.filter(F.split(column, ";"), lambda t: t != "")).alias("reason"))
    return tokens.groupBy(*(keys or []), "reason").agg(F.count("*").alias("n"))


def overlap_counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    each = [F.count_if(F.col("discard_overlap") == o).alias(o) for o in OVERLAPS[:3]]
    neither = F.count_if(~F.col("discard_overlap").isin(*OVERLAPS[:3])).alias("neither")
    rates = [(F.count_if(F.col("discard_overlap") == o) / F.count("*")).alias(f"{o}_rate") for o in OVERLAPS]
    return scored.groupBy(*keys).agg(*each, neither, *rates)


def histogram(scored: DataFrame, column: str, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def completeness(results: DataFrame, metadata: DataFrame, result_id: str, metadata_id: str, canonical: bool = True) -> DataFrame:
    """(problem, id, n) of ids that are missing among the results, unexpected there, or repeated in either table."""
    pick = (lambda c: F.coalesce(canonical_id(c), F.col(c))) if canonical else F.col
    got = results.select(pick(result_id).cast("string").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    want = metadata.select(pick(metadata_id).cast("string").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    tag = lambda df, problem: df.select(F.lit(problem).alias("problem"), "id", "n")
    missing, unexpected = want.join(got, "id", "left_anti"), got.join(want, "id", "left_anti")
    parts = [tag(missing, "missing"), tag(unexpected, "unexpected"), tag(got.filter("n > 1"), "repeated_result"), tag(want.filter("n > 1"), "repeated_metadata")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def require_complete(results: DataFrame, metadata: DataFrame, result_id: str, metadata_id: str) -> None:
    found = {r["problem"]: r["n"] for r in completeness(results, metadata, result_id, metadata_id).groupBy("problem").agg(F.count("*").alias("n")).collect()}
    if found:
        raise IncompleteResults(", ".join(f"{n} {p}" for p, n in sorted(found.items())))
