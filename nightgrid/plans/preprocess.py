"""A cohort from headers, native chunks, labels and events to publishable tables."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.columns import epoch_offset_ns
from nightgrid.operators import calibrate, grid, kernels, labels, rules
from nightgrid.session import write_once

EPOCH_KEYS = ["recording_id", "channel", "epoch_in_record"]


class Preprocessed(NamedTuple):
    processing: DataFrame
    signals: DataFrame
    qc: DataFrame
    grades: DataFrame


def accepted_chunks(headers: DataFrame, chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Chunks of available channels with what the kernel needs; rejected waveforms are not read.

    Headers and records are thousands of times smaller than chunks, and the join is on the
    chunk key, so the gate works whether Spark broadcasts it or shuffles it.
    """
    gate = calibrate.with_gain(headers.where(F.col("channel_available") & ~F.col("filter_unsupported")))
    gate = gate.drop("duration_sec").join(records.select("recording_id", "duration_sec", "epoch_count"), "recording_id")
    keep = ["recording_id", "channel", "fs", "duration_sec", "epoch_count", "dig_min", "dig_max", "phys_min",
            "gain", "scale", "band_low", "band_high"]
    return chunks.select("recording_id", "channel", "chunk_no", "codes").join(gate.select(*keep), ["recording_id", "channel"])


def preprocess(headers: DataFrame, chunks: DataFrame, records: DataFrame,
               spec: m.RuleSpec = m.RuleSpec(), materialise: bool = True) -> Preprocessed:
    """Signals, masks, flags, processing states and grades.

    records: recording_id, duration_sec, epoch_count of admitted recordings (30 s to 72 h).
    The kernel output feeds four tables, so it is written once to the shared folder.
    """
    processing = calibrate.channel_processing(headers.join(records.select("recording_id"), "recording_id", "left_semi"))
    epochs = kernels.channel_epochs(accepted_chunks(processing, chunks, records), spec)
    if materialise:
        epochs = write_once(epochs, "channel-epochs")
    runs = epochs.where("epoch_in_record = 0").select(
        "recording_id", "channel", "processed_runs", "failed_runs", "filter_guard_seconds", "run_errors",
        F.col("spo2_finite").alias("finite"), F.col("spo2_low").alias("low"), F.col("spo2_low_max").alias("low_max"),
        F.col("spo2_high_min").alias("high_min"))
    near = (rules.spo2_near_zero(runs.where("channel = 'spo2'"))
            .where("near_zero").select("recording_id", F.lit("spo2").alias("channel"), F.lit(True).alias("_near")))
    states = calibrate.run_states(
        F.col("fs"), F.col("band_low").isNotNull(), F.col("filter_unsupported"),
        F.coalesce("processed_runs", F.lit(0)), F.coalesce("failed_runs", F.lit(0)))
    live = F.col("channel_status_code") == 0
    filterless = live & (F.col("channel") == "spo2")
    processing = (processing.join(runs.drop("finite", "low", "low_max", "high_min"), ["recording_id", "channel"], "left")
                  .join(near, ["recording_id", "channel"], "left").fillna(False, ["_near"]))
    processing = processing.withColumns({
        name: F.when(live & ~(filterless & (F.lit(name) == "effective_filter_state")), state).otherwise(F.col(name))
        for name, state in states.items()})
    processing = (processing.withColumn("channel_status_code", F.when(F.col("_near"), m.CHANNEL_STATUS["SPO2_NEAR_ZERO"])
                                        .otherwise(F.col("channel_status_code")))
                  .withColumn("channel_available", F.col("channel_status_code") == 0).drop("_near"))

    names = F.broadcast(m.channel_dimension(headers.sparkSession).select("channel"))  # fifteen rows
    slots = (grid.epoch_grid(records, ["recording_id"], F.col("epoch_count")).crossJoin(names)
             .join(processing.select("recording_id", "channel", "channel_available", "coverage_detection", "fs", "source_samples"),
                   ["recording_id", "channel"], "left"))
    covered = (F.col("coverage_detection") == 1) & calibrate.epoch_covered(
        F.col("epoch_in_record"), F.col("fs"), F.col("source_samples"), spec.epoch_seconds)
    slots = (slots.withColumn("coverage_valid", F.coalesce(covered, F.lit(False)))
             .withColumn("channel_available", F.coalesce("channel_available", F.lit(False)))
             .drop("coverage_detection", "fs", "source_samples"))
    evidence = epochs.select(*EPOCH_KEYS, *kernels.METRIC_TYPES)
    flat = slots.join(evidence, EPOCH_KEYS, "left")
    processed = F.col("coverage_valid") & F.coalesce(F.col("nonfinite_output_count") == 0, F.lit(False))
    flat = flat.withColumn("processing_valid", processed)
    qc = rules.epoch_qc(flat, spec)
    # Waveforms stay where the kernel wrote them; only keys are compared to find the epochs it did not produce.
    produced = epochs.select(*EPOCH_KEYS, epoch_offset_ns(F.col("epoch_in_record"), spec.epoch_seconds).alias("epoch_start_offset_ns"),
                             kernels.zero_filled(F.col("samples"), spec.epoch_samples).alias("samples"))
    absent = slots.join(epochs.select(*EPOCH_KEYS), EPOCH_KEYS, "left_anti").select(*EPOCH_KEYS, "epoch_start_offset_ns")
    silence = F.array_repeat(F.lit(0.0).cast("float"), spec.epoch_samples)
    signals = produced.unionByName(absent.withColumn("samples", silence))
    grades = rules.night_grade(rules.usable_hours(qc, spec.epoch_seconds / 3600))
    return Preprocessed(processing, signals, qc, grades)


def label_tables(records: DataFrame, label_rows: DataFrame, events: DataFrame,
                 stage_maps: DataFrame | None = None) -> dict[str, DataFrame]:
    """Task tables and their summaries for admitted recordings, and what rejected the others.

    A recording with an unusable epoch number, without labels or stage events, with an event at no finite time or (where
    ``stage_maps`` has recording_id and event_map) with another stage map is listed in ``errors`` and in no other table.
    """
    found = [labels.label_key_errors(label_rows), labels.missing_source_errors(records, label_rows, "no label rows"),
             labels.missing_source_errors(records, events, "no stage grid"), labels.event_time_errors(events)]
    if stage_maps is not None:
        found.append(labels.event_map_errors(stage_maps))
    errors = reduce(DataFrame.unionByName, found).join(records.select("recording_id"), "recording_id", "left_semi")
    rejected = errors.select("recording_id").distinct()
    accepted, label_rows, events = (df.join(rejected, "recording_id", "left_anti") for df in (records, label_rows, events))
    lengths = accepted.select("recording_id", F.col("epoch_count").alias("n_epochs"))
    slots = grid.epoch_grid(accepted, ["recording_id"], F.col("epoch_count"))
    keyed = (label_rows.join(accepted.select("recording_id"), "recording_id", "left_semi")
             .withColumn("epoch_in_record", labels.source_epoch(F.col("Epoch"))))
    rows = labels.overlay_events(labels.label_epochs(slots, keyed), labels.event_epochs(events, lengths))
    return {"task_fields": labels.task_fields(rows), "task_epochs": labels.task_epochs(rows),
            "task_structure": labels.label_structure(slots, keyed),
            "task_alignment": labels.alignment_summary(rows, labels.event_defects(events)),
            "task_defects": labels.alignment_defects(rows), "errors": errors}
