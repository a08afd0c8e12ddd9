"""Epoch quality rules: evidence columns to flags, codes, masks and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.columns import bit_union, finite, has_bit, ratio, set_bit

METRICS = tuple(m.METRIC_SENTINELS)


def primary_code(flags: Column) -> Column:
    """Highest-priority rule that is set, 0 if none."""
    out = F.lit(0)
    for code in reversed(m.HARD_PRIORITY):
        out = F.when(has_bit(flags, code), F.lit(code)).otherwise(out)
    return out


def rule_verdicts(spec: m.RuleSpec = m.RuleSpec()) -> dict[int, tuple[Column, Column]]:
    """Per code: (was evaluated, was hit) from metric columns, NULL metric = not evaluated."""
    kind = m.kind_column(F.col("channel"))
    src = F.coalesce(F.col("nonfinite_source_count"), F.lit(0)) > 0
    has_output = F.col("nonfinite_output_count").isNotNull()
    out = F.coalesce(F.col("nonfinite_output_count"), F.lit(0)) > 0
    flat_limit = m.channel_map(spec.flat_std, kind)
    flat_wave = F.col("std_physical") < flat_limit
    flat_code = ((F.col("digital_peak_to_peak_codes") <= spec.flat_code_span)
                 & (F.col("digital_unique_count_capped3") <= spec.flat_code_unique))
    flat_seen = F.col("std_physical").isNotNull() | F.col("digital_peak_to_peak_codes").isNotNull()
    seen = lambda name: F.col(name).isNotNull()
    return {
        1: (F.col("coverage_valid") & (has_output | src), F.col("coverage_valid") & (src | out)),
        2: (flat_seen, F.coalesce(flat_wave, flat_code)),
        3: (seen("saturation_fraction"), F.col("saturation_fraction") >= spec.saturation_threshold),
        4: (seen("high_amplitude_duration_seconds"),
            F.col("high_amplitude_duration_seconds") == spec.amplitude_windows),
        5: (seen("power_line_fraction"), F.col("power_line_fraction") > spec.line_threshold),
        6: (seen("high_frequency_fraction"),
            F.col("high_frequency_fraction") > spec.high_frequency_threshold),
        7: (seen("spo2_in_range_fraction"), F.col("spo2_in_range_fraction") < spec.spo2_min_fraction),
    }


def with_flags(df: DataFrame, spec: m.RuleSpec = m.RuleSpec()) -> DataFrame:
    verdicts = rule_verdicts(spec)
    evaluated = bit_union([set_bit(c, e) for c, (e, _) in verdicts.items()])
    hit = bit_union([set_bit(c, e & F.coalesce(x, F.lit(False))) for c, (e, x) in verdicts.items()])
    return (df.withColumn("hard_evaluated_flags", evaluated).withColumn("hard_flags", hit)
            .withColumn("hard_code", primary_code(F.col("hard_flags"))))


def applicable_mask(channel: Column) -> Column:
    return m.channel_map({c: m.APPLICABLE_MASK[m.channel_kind(c)] for c in m.CHANNELS}, channel)


def artifact_valid() -> Column:
    mask = applicable_mask(F.col("channel"))
    return ((F.col("hard_evaluated_flags").bitwiseAND(mask) == mask) & (F.col("hard_flags") == 0))


def valid_conjunction() -> Column:
    return (F.col("channel_available") & F.col("coverage_valid")
            & F.col("processing_valid") & F.col("artifact_valid"))


def epoch_qc(df: DataFrame, spec: m.RuleSpec = m.RuleSpec()) -> DataFrame:
    """Metrics plus coverage, processing and availability to the full QC row."""
    return (with_flags(df, spec).withColumn("artifact_valid", artifact_valid())
            .withColumn("valid", valid_conjunction()))


def placeholders(grid: DataFrame, qc: DataFrame) -> DataFrame:
    """Every (recording, channel, epoch) of the grid; absent ones become invalid, unflagged rows.

    A grid that knows its own ``coverage_valid`` keeps it for the rows it fills in.
    """
    keys = ["recording_id", "channel", "epoch_in_record"]
    known = "coverage_valid" in grid.columns
    left = grid.withColumnRenamed("coverage_valid", "_covered") if known else grid
    out = left.join(qc.select(*keys, *[c for c in qc.columns if c not in left.columns]), keys, "left")
    if known:
        out = out.withColumn("coverage_valid", F.coalesce("coverage_valid", "_covered")).drop("_covered")
    masks = [c for c in ("coverage_valid", "processing_valid", "artifact_valid", "valid",
                         "channel_available") if c in out.columns]
    flags = [c for c in ("hard_flags", "hard_evaluated_flags", "hard_code") if c in out.columns]
    return out.fillna(False, masks).fillna(0, flags)


def spo2_near_zero(rows: DataFrame) -> DataFrame:
    """Recordings whose SpO2 is unusable: 90 % of values below 5, or median below 5.

    ``rows`` carries partial counts (finite, low, low_max, high_min) of any granularity. The
    even-count median needs only the largest value below 5 and the smallest above it.
    """
    n, low = F.col("finite"), F.col("low")
    tie = (low * 2 == n) & ((F.col("low_max") + F.col("high_min")) / 2 < 5)
    near = (n > 0) & ((low.cast("double") / F.nullif(n, F.lit(0)) >= 0.90) | (low * 2 > n) | tie)
    return (rows.groupBy("recording_id")
            .agg(F.sum("finite").alias("finite"), F.sum("low").alias("low"),
                 F.max("low_max").alias("low_max"), F.min("high_min").alias("high_min"))
            .select("recording_id", "finite", "low", F.coalesce(near, F.lit(False)).alias("near_zero")))


def usable_hours(qc: DataFrame, hours_per_epoch: float = 1 / 120) -> DataFrame:
    return (qc.groupBy("recording_id", "channel")
            .agg(F.sum(F.col("valid").cast("int")).alias("valid_epochs"))
            .withColumn("usable_hours", F.col("valid_epochs") * F.lit(float(hours_per_epoch))))


GRADE_GROUPS = ("eeg", "eog", "ecg", "emg", "airflow", "snore", "spo2")


def night_grade(hours: DataFrame) -> DataFrame:
    """Best channel per group, then the five-step grade of the night."""
    kind = m.kind_column(F.col("channel"))
    best = [F.coalesce(F.max(F.when(kind == g, F.col("usable_hours"))), F.lit(0.0)).alias(g)
            for g in GRADE_GROUPS]
    usable = hours.groupBy("recording_id").agg(*best)

    def above(limit, *groups):
        cond = F.lit(True)
        for g in groups:
            cond = cond & (F.col(g) > limit)
        return cond

    grade = (F.when(above(5, "eeg", "eog", "emg", "ecg", "airflow", "spo2"), F.lit(5))
             .when(above(5, "eeg", "eog", "emg", "airflow", "spo2"), F.lit(4))
             .when(above(5, "eeg", "airflow", "spo2"), F.lit(3))
             .when(above(4, "eeg", "airflow", "spo2"), F.lit(2)).otherwise(F.lit(1)))
    return usable.withColumn("night_grade", grade)


def _rule_rows(spark: SparkSession) -> DataFrame:
    rows = [(c, code, m.HARD_CODES[code], bool(m.APPLICABLE_MASK[m.channel_kind(c)] >> (code - 1) & 1))
            for c in m.CHANNELS for code in range(1, 8)]
    return m.inline_table(spark, rows, ("channel", "code", "name", "applicable"))


def rule_summary(qc: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per channel and rule: evaluated and hit epochs, with rows for rules never evaluated."""
    totals = []
    for code in range(1, 8):
        totals += [F.sum(has_bit(F.col("hard_evaluated_flags"), code).cast("bigint")).alias(f"e{code}"),
                   F.sum(has_bit(F.col("hard_flags"), code).cast("bigint")).alias(f"h{code}")]
    wide = qc.groupBy(*keys, "channel").agg(*totals)
    stack = "stack(7, " + ", ".join(f"{c}, e{c}, h{c}" for c in range(1, 8)) + ") as (code, evaluated_epochs, hard_epochs)"
    long = wide.selectExpr(*keys, "channel", stack)
    rules = F.broadcast(_rule_rows(qc.sparkSession))  # always 105 rows
    if keys:
        rules = qc.select(*keys).distinct().crossJoin(rules)
    out = rules.join(long, [*keys, "channel", "code"], "left").fillna(0, ["evaluated_epochs", "hard_epochs"])
    return out.withColumn("hit_rate", ratio(F.col("hard_epochs"), F.col("evaluated_epochs")))


def roll_up(summary: DataFrame) -> DataFrame:
    """Shard summaries to release totals."""
    return (summary.groupBy("channel", "code", "name", "applicable")
            .agg(F.sum("evaluated_epochs").alias("evaluated_epochs"), F.sum("hard_epochs").alias("hard_epochs")))


def hard_events(qc: DataFrame, id_column: str = "recording_id", epoch_seconds: int = 30) -> DataFrame:
    """One row per hit with its half-open time span."""
    codes = F.filter(F.array(*[F.when(has_bit(F.col("hard_flags"), c), F.lit(c)) for c in range(1, 8)]),
                     lambda c: c.isNotNull())
    return (qc.where(F.col("hard_flags") > 0)
            .select(id_column, "channel", "epoch_in_record", F.explode(codes).alias("hard_code"))
            .withColumn("start_seconds", F.col("epoch_in_record") * epoch_seconds)
            .withColumn("end_seconds", (F.col("epoch_in_record") + 1) * epoch_seconds)
            .withColumn("name", m.channel_map(m.HARD_CODES, F.col("hard_code"))))


def to_sentinels(df: DataFrame) -> DataFrame:
    """Metrics with the stored fill values of the published arrays instead of NULL."""
    for name, fill in m.METRIC_SENTINELS.items():
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(fill)))
    return df


def zero_fill(samples: Column) -> Column:
    """Stored waveform: non-finite samples become zero after they were counted as evidence."""
    return F.transform(samples, lambda x: F.when(finite(x.cast("double")), x).otherwise(F.lit(0.0).cast("float")))


def all_finite(samples: Column) -> Column:
    return F.forall(samples, lambda x: finite(x.cast("double")))
