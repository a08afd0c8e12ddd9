"""Integrity audits: every function returns the rows that break a release rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.columns import finite, has_bit
from nightgrid.operators import rules

EPOCH_KEYS = ["recording_id", "channel", "epoch_in_record"]


def problems(df: DataFrame, keys: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """One row per broken check; a check that cannot be decided counts as broken."""
    tags = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]),
                    lambda x: x.isNotNull())
    return df.select(*keys, F.explode(tags).alias("problem"))


def flag_violations(qc: DataFrame) -> DataFrame:
    """Hits must be evaluated, evaluations applicable, bit 7 unused."""
    flags, seen = F.col("hard_flags"), F.col("hard_evaluated_flags")
    mask = rules.applicable_mask(F.col("channel"))
    return problems(qc, EPOCH_KEYS, {
        "hit_without_evaluation": flags.bitwiseAND(F.bitwise_not(seen)).bitwiseAND(127) == 0,
        "inapplicable_evaluation": seen.bitwiseAND(F.bitwise_not(mask)).bitwiseAND(127) == 0,
        "reserved_bit": flags.bitwiseOR(seen).bitwiseAND(128) == 0})


def code_violations(qc: DataFrame) -> DataFrame:
    return problems(qc, EPOCH_KEYS, {"primary_code": F.col("hard_code") == rules.primary_code(F.col("hard_flags"))})


def mask_violations(qc: DataFrame) -> DataFrame:
    checks = {"artifact_valid": F.col("artifact_valid") == rules.artifact_valid(),
              "valid": F.col("valid") == (F.col("channel_available") & F.col("coverage_valid")
                                          & F.col("processing_valid") & rules.artifact_valid())}
    if "channel_status_code" in qc.columns:
        checks["available"] = F.col("channel_available") == (F.col("channel_status_code") == 0)
    return problems(qc, EPOCH_KEYS, checks)


def index_violations(epochs: DataFrame, keys: Sequence[str], epoch_seconds: float = 30.0) -> DataFrame:
    """Records whose epochs are not exactly 0..n-1, once each, with the right offsets.

    Plain aggregates: n rows with distinct values between 0 and n-1 are the whole range.
    """
    e, ns = F.col("epoch_in_record"), int(round(epoch_seconds * 1e9))
    once = epochs.groupBy(*keys, "epoch_in_record").agg(
        F.count("*").alias("_n"), F.count_if(F.col("epoch_start_offset_ns") != e * ns).alias("_bad"))
    per = once.groupBy(*keys).agg(
        F.count("*").alias("_distinct"), F.sum("_n").alias("_rows"), F.min("epoch_in_record").alias("_min"),
        F.max("epoch_in_record").alias("_max"), F.sum("_bad").alias("_bad"))
    return problems(per, keys, {
        "repeated_epoch": F.col("_rows") == F.col("_distinct"),
        "gap": (F.col("_min") == 0) & (F.col("_max") == F.col("_distinct") - 1),
        "offset": F.col("_bad") == 0})


def sample_violations(signals: DataFrame, size: int = m.EPOCH_SAMPLES) -> DataFrame:
    return problems(signals, EPOCH_KEYS, {
        "length": F.size("samples") == size,
        "finite": F.forall("samples", lambda x: finite(x.cast("double")))})


def grade_violations(qc: DataFrame, published: DataFrame, hours: DataFrame,
                     hours_per_epoch: float = 1 / 120) -> DataFrame:
    """Grades and usable hours recomputed from the masks against the published ones, either way round:
    what is graded but not published is reported like what is published otherwise."""
    again = rules.usable_hours(qc, hours_per_epoch)
    graded = rules.night_grade(again).select("recording_id", F.col("night_grade").alias("_grade"))
    wrong_grade = (published.join(graded, "recording_id", "full_outer")
                   .where(~F.col("night_grade").eqNullSafe(F.col("_grade")))
                   .select("recording_id", F.lit("").alias("channel"), F.lit("night_grade").alias("problem")))
    other = again.select("recording_id", "channel", F.col("usable_hours").alias("_hours"))
    wrong_hours = (hours.join(other, ["recording_id", "channel"], "full_outer")
                   .where(F.coalesce(F.abs(F.col("usable_hours") - F.col("_hours")) > 1e-12, F.lit(True)))
                   .select("recording_id", "channel", F.lit("usable_hours").alias("problem")))
    return wrong_grade.unionByName(wrong_hours)


def metric_violations(qc: DataFrame, spec: m.RuleSpec = m.RuleSpec()) -> DataFrame:
    """Stored metric and stored flag must agree, away from the rounded thresholds."""
    def near(name, limit):
        return F.abs(F.col(name).cast("double") - F.lit(limit)) <= 1e-7

    def agree(code, name, hit, exact=False, limit=0.0):
        skip = ~has_bit(F.col("hard_evaluated_flags"), code)
        if not exact:
            skip = skip | near(name, limit)
        return skip | (has_bit(F.col("hard_flags"), code) == hit)

    s = spec
    return problems(qc, EPOCH_KEYS, {
        "saturation_fraction": agree(3, "saturation_fraction", F.col("saturation_fraction") >= s.saturation_threshold,
                                     limit=s.saturation_threshold),
        "high_amplitude_duration_seconds": agree(
            4, "high_amplitude_duration_seconds", F.col("high_amplitude_duration_seconds") == s.amplitude_windows, True),
        "power_line_fraction": agree(5, "power_line_fraction", F.col("power_line_fraction") > s.line_threshold,
                                     limit=s.line_threshold),
        "high_frequency_fraction": agree(6, "high_frequency_fraction",
                                         F.col("high_frequency_fraction") > s.high_frequency_threshold,
                                         limit=s.high_frequency_threshold),
        "spo2_in_range_fraction": agree(7, "spo2_in_range_fraction",
                                        F.col("spo2_in_range_fraction") < s.spo2_min_fraction,
                                        limit=s.spo2_min_fraction)})


def binding_violations(signal_epochs: DataFrame, task_epochs: DataFrame,
                       keys: Sequence[str] = ("recording_id", "epoch_in_record")) -> DataFrame:
    """Epochs present on one side only, or with different offsets."""
    keys = list(keys)
    left = signal_epochs.select(*keys, F.col("epoch_start_offset_ns").alias("_s"))
    right = task_epochs.select(*keys, F.col("epoch_start_offset_ns").alias("_t"))
    both = left.join(right, keys, "full_outer")
    problem = (F.when(F.col("_t").isNull(), "task_missing").when(F.col("_s").isNull(), "signal_missing")
               .when(F.col("_s") != F.col("_t"), "offset"))
    return both.select(*keys, problem.alias("problem")).where(F.col("problem").isNotNull())


def task_code_violations(epochs: DataFrame) -> DataFrame:
    """Codes outside 0-7, stage-only codes on numeric tasks, validity that disagrees."""
    stage_only = F.col("qc_code").isin(6, 7) & (F.col("task") != "sleep_stage")
    return problems(epochs, ["recording_id", "epoch_in_record", "task"], {
        "qc_code": F.col("qc_code").between(0, 7) & ~stage_only,
        "valid": F.col("valid") == (F.col("qc_code") == 0) if "valid" in epochs.columns else F.lit(True)})


def field_code_violations(fields: DataFrame, epochs: DataFrame) -> DataFrame:
    """The task code must be the smallest non-zero field code."""
    keys = ["recording_id", "epoch_in_record", "task"]
    again = fields.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("field_qc_code") > 0, F.col("field_qc_code"))), F.lit(0)).alias("_code"))
    return (epochs.join(again, keys, "left").where(~F.col("qc_code").eqNullSafe(F.col("_code")))
            .select(*keys, F.lit("main_code").alias("problem")))


def structure_violations(structure: DataFrame, key: str = "recording_id") -> DataFrame:
    return structure.where(F.col("structure_code") >= 2).select(key, F.lit("structure_code").alias("problem"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; must be empty."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side missing from the other, as multisets.

    One hash aggregation over both sides instead of two set differences.
    """
    cols = left.columns
    both = (left.withColumn("_w", F.lit(1)).unionByName(right.select(*cols).withColumn("_w", F.lit(-1))))
    return (both.groupBy(*cols).agg(F.sum("_w").alias("surplus")).where(F.col("surplus") != 0))
