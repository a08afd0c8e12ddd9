"""Task labels on the signal grid: value checks, event evidence, codes and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.columns import finite, isclose, ratio
from nightgrid.operators.scan import islands, running

KEYS = ["recording_id", "epoch_in_record"]
FIELDS = [(task, field) for task, fields in m.TASK_FIELDS.items() for field in fields]


def check_columns(df: DataFrame) -> None:
    missing = {"Epoch", *m.TASK_SOURCE_COLUMNS.values()} - set(df.columns)
    if missing:
        raise ValueError(f"label source lacks columns {sorted(missing)}")


def source_epoch(text: Column) -> Column:
    """One-based epoch text as a zero-based index; NULL when it is not a positive integer."""
    number = F.when(text.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text.cast("string")).try_cast("bigint"))
    return F.when(number >= 1, number - 1)


def label_key_errors(rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """Recordings whose label file cannot be keyed: invalid or repeated epoch numbers."""
    at = rows.select(key, source_epoch(F.col("Epoch")).alias("_e"))
    # Counting by (recording, epoch) spreads even one giant recording over all tasks.
    seen = at.groupBy(key, "_e").agg(F.count("*").alias("_n"))
    bad = seen.where(F.col("_e").isNull() | (F.col("_n") > 1))
    detail = F.when(F.max(F.col("_e").isNull().cast("int")) == 1, "invalid source epoch").otherwise(
        "duplicate source epoch")
    return (bad.groupBy(key).agg(detail.alias("detail"))
            .select(key, F.lit("labels").alias("stage"), F.lit("TASK_EPOCH_KEY_MISMATCH").alias("code"), "detail"))


def keyed_labels(rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """Label rows of the recordings without key errors, with their zero-based epoch."""
    good = rows.join(label_key_errors(rows, key).select(key), key, "left_anti")
    return good.withColumn("epoch_in_record", source_epoch(F.col("Epoch")))


def stage_token(text: Column) -> Column:
    return F.coalesce(m.channel_map(m.STAGE_TOKENS, F.upper(F.trim(F.coalesce(text, F.lit(""))))), F.lit(0))


def stage_code(text: Column) -> Column:
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.when(stage_token(text) > 0, 0).when(blank, 2).otherwise(3)


def number_value(text: Column) -> Column:
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(finite(value), value)


def number_code(value: Column, task: str) -> Column:
    """2 for missing, non-finite or the placeholder 0; 3 outside the plausible range."""
    low, high = m.TASK_LIMITS[task]
    return F.when(value.isNull() | (value == 0), 2).when(~value.between(low, high), 3).otherwise(0)


def label_epochs(grid: DataFrame, labels: DataFrame) -> DataFrame:
    """Grid left-joined to label rows; one row per epoch with value_* and code_* columns.

    Code 1 marks epochs without a label row. Label rows beyond the grid drop out here and
    are counted by :func:`label_structure`.
    """
    source = labels.select(*KEYS, *[F.col(f"`{c}`").alias(f"_src_{f}") for f, c in m.TASK_SOURCE_COLUMNS.items()],
                           F.lit(True).alias("_present"))
    rows = grid.select(*KEYS).join(source, KEYS, "left").fillna(False, ["_present"])
    rows = rows.withColumn("value_stage", F.when(F.col("_present"), stage_token(F.col("_src_stage"))).otherwise(0)
                           .cast("double"))
    rows = rows.withColumn("code_stage", F.when(~F.col("_present"), 1).otherwise(stage_code(F.col("_src_stage"))))
    for task in ("heart_rate", "sao2"):
        fields = m.TASK_FIELDS[task]
        rows = rows.withColumns({f"_v_{f}": number_value(F.col(f"_src_{f}")) for f in fields})
        rows = rows.withColumns({f"_c_{f}": F.when(~F.col("_present"), 1).otherwise(
            number_code(F.col(f"_v_{f}"), task)) for f in fields})
        # Order is judged on the stored single-precision values.
        v = {f: F.col(f"_v_{f}").cast("float") for f in fields}
        low, high = v[fields[1]], v[fields[0]]
        ordered = low <= high
        if len(fields) == 3:
            ordered = (low <= v[fields[2]]) & (v[fields[2]] <= high)
        clean = F.lit(True)
        for f in fields:
            clean = clean & (F.col(f"_c_{f}") == 0)
        rows = rows.withColumn("_swap", clean & ~F.coalesce(ordered, F.lit(True)))
        rows = rows.withColumns({f"code_{f}": F.when(F.col("_swap"), 4).otherwise(F.col(f"_c_{f}")) for f in fields})
        rows = rows.withColumns({f"value_{f}": F.col(f"_v_{f}").cast("float").cast("double") for f in fields})
    keep = [f"{p}_{f}" for _, f in FIELDS for p in ("value", "code")]
    tokens = [F.when(F.col("_present"), F.coalesce(F.nullif(F.col(f"_src_{f}").cast("string"), F.lit("")), F.lit("<empty>")))
              .otherwise("<epoch missing>").alias(f"token_{f}") for _, f in FIELDS]
    return rows.select(*KEYS, "_present", *keep, *tokens).withColumnRenamed("_present", "label_present")


def events_from_arrays(df: DataFrame, default_duration: float = 30.0) -> DataFrame:
    """Parallel starts/codes (and durations, if any) arrays to one row per event."""
    names = ["starts", "codes"] + (["durations"] if "durations" in df.columns else [])
    rows = df.select("recording_id", F.posexplode(F.arrays_zip(*names)).alias("event_idx", "_e"))
    duration = F.col("_e.durations") if "durations" in names else F.lit(None).cast("double")
    return rows.select("recording_id", "event_idx", F.col("_e.starts").cast("double").alias("start_s"),
                       F.coalesce(duration, F.lit(default_duration)).alias("duration_s"),
                       F.col("_e.codes").cast("int").alias("code"))


def event_epochs(events: DataFrame, records: DataFrame, epoch_seconds: float = 30.0) -> DataFrame:
    """Explicit stage of each grid epoch: last event wins, differing codes are a conflict.

    Events without finite times mark nothing (``event_time_errors`` rejects their recordings).
    """
    k = F.col("start_s") / F.lit(epoch_seconds)
    on_grid = finite(F.col("start_s")) & finite(F.col("end_s")) & (F.col("start_s") >= 0) & isclose(k, F.rint(k), tol=1e-6)
    rows = (events.where(on_grid & (F.col("end_s") > F.col("start_s")))
            .join(records.select("recording_id", "n_epochs"), "recording_id")
            .withColumn("_first", F.rint(k).cast("bigint"))
            .withColumn("_stop", F.least(F.col("n_epochs"), F.floor((F.col("end_s") + 1e-6) / epoch_seconds)))
            .where(F.col("_first") < F.col("_stop"))
            # Spans are cut at the record's own length, so a sequence is never longer than a night.
            .withColumn("epoch_in_record", F.explode(F.sequence(F.col("_first"), F.col("_stop") - 1))))
    return (rows.groupBy(*KEYS)
            .agg(F.max_by("code", "event_idx").alias("event_code"),
                 (F.min("code") != F.max("code")).alias("event_conflict")))


def event_defects(events: DataFrame, epoch_seconds: float = 30.0) -> DataFrame:
    """Per recording: off-grid, non-positive and non-finite event counts."""
    k = F.col("start_s") / F.lit(epoch_seconds)
    real = F.coalesce(finite(F.col("start_s")) & finite(F.col("end_s")), F.lit(False))
    off = real & ~((F.col("start_s") >= 0) & isclose(k, F.rint(k), tol=1e-6))
    return events.groupBy("recording_id").agg(
        F.count_if(off).alias("off_grid_events"),
        F.count_if(real & ~off & (F.col("end_s") <= F.col("start_s"))).alias("nonpositive_events"),
        F.count_if(~real).alias("nonfinite_events"))


def _rejected(recordings: DataFrame, detail: str) -> DataFrame:
    return recordings.select("recording_id", F.lit("labels").alias("stage"), F.lit("TASK_EPOCH_KEY_MISMATCH").alias("code"),
                             F.lit(detail).alias("detail"))


def event_time_errors(events: DataFrame) -> DataFrame:
    """Recordings with an event whose start or end is no finite number."""
    return _rejected(events.where(~(finite(F.col("start_s")) & finite(F.col("end_s")))).select("recording_id").distinct(), "nonfinite event time")


def missing_source_errors(records: DataFrame, rows: DataFrame, detail: str) -> DataFrame:
    """Recordings of which a source says nothing at all."""
    return _rejected(records.join(rows.select("recording_id"), "recording_id", "left_anti"), detail)


def event_map_errors(maps: DataFrame, column: str = "event_map") -> DataFrame:
    """Recordings whose stage map is missing or does not name the five stages at keys 1-5."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    ok = F.lit(True)
    for i, name in enumerate(m.EVENT_STAGES, 1):
        ok = ok & (F.upper(F.try_element_at(parsed, F.lit(str(i)))) == name)
    return _rejected(maps.where(~F.coalesce(ok, F.lit(False))), "stage map")


def overlay_events(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Add time evidence: 5 unverified (all tasks), 6 conflict and 7 mismatch (stage only).

    A code already set stays; 5 is tried before 6 before 7.
    """
    rows = labels.join(events, KEYS, "left").fillna(False, ["event_conflict"])
    stage = F.col("value_stage")
    known = F.col("code_stage") == 0
    unverified = F.col("label_present") & F.col("event_code").isNull()
    mismatch = known & ~F.col("event_conflict") & (F.col("event_code") != stage)
    rows = (rows.withColumn("time_unverified", unverified)
            .withColumn("stage_mismatch", F.coalesce(mismatch, F.lit(False)))
            .withColumn("known_anchor", known & ~F.col("time_unverified") & ~F.col("event_conflict")
                        & ~F.col("stage_mismatch")))
    new = {f"code_{f}": F.when((F.col(f"code_{f}") == 0) & F.col("time_unverified"), 5).otherwise(F.col(f"code_{f}"))
           for _, f in FIELDS}
    new["code_stage"] = (F.when(F.col("code_stage") != 0, F.col("code_stage")).when(F.col("time_unverified"), 5)
                         .when(F.col("event_conflict"), 6).when(F.col("stage_mismatch"), 7).otherwise(0))
    return rows.withColumns(new)


def task_fields(rows: DataFrame) -> DataFrame:
    """Long form (recording, epoch, task, field, value, field_qc_code, source token)."""
    parts = ", ".join(f"'{t}', '{f}', value_{f}, code_{f}, token_{f}" for t, f in FIELDS)
    return rows.selectExpr(*KEYS, f"stack({len(FIELDS)}, {parts}) AS (task, field, value, field_qc_code, token)")


def _task_code(task: str) -> Column:
    """Smallest non-zero field code of one task, 0 if every field is clean."""
    codes = [F.when(F.col(f"code_{f}") > 0, F.col(f"code_{f}")) for f in m.TASK_FIELDS[task]]
    return F.coalesce(codes[0] if len(codes) == 1 else F.least(*codes), F.lit(0))


def task_epochs(rows: DataFrame) -> DataFrame:
    """Long form (recording, epoch, task, qc_code, valid) without another shuffle."""
    wide = rows.withColumns({f"_qc_{t}": _task_code(t) for t in m.TASK_FIELDS})
    parts = ", ".join(f"'{t}', _qc_{t}" for t in m.TASK_FIELDS)
    return (wide.selectExpr(*KEYS, f"stack({len(m.TASK_FIELDS)}, {parts}) AS (task, qc_code)")
            .withColumn("valid", F.col("qc_code") == 0))


def label_structure(grid: DataFrame, labels: DataFrame) -> DataFrame:
    """Per recording: label rows, grid epochs without one, rows beyond the grid, structure code."""
    both = (grid.select(*KEYS, F.lit(1).alias("_g"))
            .join(labels.select(*KEYS, F.lit(1).alias("_l")), KEYS, "full_outer"))
    out = both.groupBy("recording_id").agg(
        F.count("_l").alias("source_rows"),
        F.count_if(F.col("_l").isNull()).alias("missing_signal_epochs"),
        F.count_if(F.col("_g").isNull()).alias("extra_source_epochs"))
    code = F.when((F.col("missing_signal_epochs") > 0) | (F.col("extra_source_epochs") > 0), 1).otherwise(0)
    return (out.withColumn("structure_code", code)
            .withColumn("structure", m.channel_map(m.TASK_STRUCTURE, F.col("structure_code"))))


DEFECTS = (("time_unverified", 5), ("event_conflict", 6), ("stage_mismatch", 7))


def alignment_defects(rows: DataFrame) -> DataFrame:
    """One row per defective epoch and kind, instead of unbounded lists."""
    parts = ", ".join(f"{code}, {name}" for name, code in DEFECTS)
    return (rows.selectExpr(*KEYS, f"stack({len(DEFECTS)}, {parts}) AS (code, hit)").where("hit")
            .drop("hit"))


def alignment_summary(rows: DataFrame, defects: DataFrame) -> DataFrame:
    """Per recording: anchors, defect counts, event counts and PASS/PARTIAL."""
    counts = rows.groupBy("recording_id").agg(
        F.count_if("known_anchor").alias("known_anchors"),
        *[F.count_if(name).alias(f"{name}_epochs") for name, _ in DEFECTS])
    any_defect = F.lit(False)
    for name, _ in DEFECTS:
        any_defect = any_defect | (F.col(f"{name}_epochs") > 0)
    return (counts.join(defects, "recording_id", "left")
            .fillna(0, ["off_grid_events", "nonpositive_events", "nonfinite_events"])
            .withColumn("status", F.when(any_defect, "PARTIAL").otherwise("PASS")))


def defect_ranges(rows: DataFrame, keys: Sequence[str], epoch: str = "epoch_in_record",
                  epoch_seconds: int = 30, shown: int = 8) -> DataFrame:
    """First few [start, stop) second spans of consecutive epochs, with the number of spans."""
    from pyspark.sql import Window

    spans = islands(rows, keys, epoch)
    total = spans.groupBy(*keys).agg(F.count("*").alias("span_count"))
    order = Window.partitionBy(*keys).orderBy("first")
    top = spans.withColumn("span_no", F.row_number().over(order)).where(F.col("span_no") <= shown)
    return (top.join(total, list(keys))
            .withColumn("start_seconds", F.col("first") * epoch_seconds)
            .withColumn("end_seconds", (F.col("last") + 1) * epoch_seconds).drop("first", "last"))


def code_distribution(epochs: DataFrame) -> DataFrame:
    """Task x code 0-7: epochs and share of the task; codes never seen stay as zero rows."""
    spark = epochs.sparkSession
    codes = m.inline_table(spark, [(t, c, n) for t in m.TASK_FIELDS for c, n in m.TASK_QC.items()],
                           ("task", "qc_code", "name"))
    seen = epochs.groupBy("task", "qc_code").agg(F.count("*").alias("epochs"))
    # Both sides are at most 24 rows here.
    full = codes.join(seen, ["task", "qc_code"], "left").fillna(0, ["epochs"])
    total = seen.groupBy("task").agg(F.sum("epochs").alias("_all"))
    return full.join(total, "task", "left").withColumn("fraction", ratio(F.col("epochs"), F.col("_all"))).drop("_all")


def task_totals(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("task").agg(F.count_if("valid").alias("valid_epochs"),
                                      F.count_if(~F.col("valid")).alias("excluded_epochs"))


def task_processing(epochs: DataFrame, structure: DataFrame, alignment: DataFrame) -> DataFrame:
    """Per recording and task: code histogram with coverage and alignment facts."""
    hist = epochs.groupBy("recording_id", "task").agg(
        F.count("*").alias("n_epochs"),
        *[F.count_if(F.col("qc_code") == c).alias(f"code_{c}") for c in m.TASK_QC])
    return (hist.join(structure.select("recording_id", "source_rows", "missing_signal_epochs",
                                       "extra_source_epochs", "structure_code"), "recording_id")
            .join(alignment.select("recording_id", "status", "known_anchors"), "recording_id"))


def token_ranking(fields: DataFrame, keys: Sequence[str], top: int = 8) -> DataFrame:
    """Most frequent source tokens behind each non-zero code, ties by token."""
    from pyspark.sql import Window

    counts = (fields.where(F.col("field_qc_code") != 0)
              .groupBy(*keys, "task", "field", "field_qc_code", "token").agg(F.count("*").alias("n")))
    order = Window.partitionBy(*keys, "task", "field", "field_qc_code").orderBy(F.desc("n"), "token")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def as_of_stage(events: DataFrame, centres: DataFrame, bucket_seconds: float = 900.0,
                default_duration: float = 30.0) -> DataFrame:
    """Last event at or before each epoch centre, if it still lasts; stage -1 otherwise.

    events: recording_id, event_idx, start_s, duration_s, code. centres: recording_id,
    epoch_in_record, centre_s.
    """
    source = events.select(
        "recording_id", F.lit(None).cast("bigint").alias("epoch_in_record"), F.col("start_s").alias("_t"),
        F.lit(0).alias("_kind"), F.col("event_idx").cast("bigint").alias("_i"),
        F.struct("start_s", F.coalesce("duration_s", F.lit(default_duration)).alias("d"), "code").alias("_e"))
    asked = centres.select(
        "recording_id", F.col("epoch_in_record").cast("bigint").alias("epoch_in_record"),
        F.col("centre_s").alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_i"),
        F.lit(None).cast(source.schema["_e"].dataType).alias("_e"))
    rows = running(source.unionByName(asked), ["recording_id"], ["_t", "_kind", "_i"],
                   F.floor(F.col("_t") / bucket_seconds), {"_last": ("last", F.col("_e"))})
    live = F.col("_t") < F.col("_last.start_s") + F.col("_last.d") + 1e-6
    return (rows.where(F.col("_kind") == 1)
            .select("recording_id", "epoch_in_record",
                    F.when(live, F.col("_last.code")).otherwise(F.lit(-1).cast(events.schema["code"].dataType))
                    .alias("stage"),
                    F.coalesce(live, F.lit(False)).alias("stage_mask")))
