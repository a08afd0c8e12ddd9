"""Headline queries on one machine; prints a single JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the threads, BENCH_QUERIES a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from nightgrid.plans.catalog import QUERIES  # noqa: E402
from nightgrid.operators import release  # noqa: E402
from nightgrid.session import build_session, scratch_path  # noqa: E402

HEADLINE = (
    "A2_night_grade", "A3_rule_summary", "A5_hard_events", "Q6_line_power_fraction", "Q14_placeholder_rows", "U4_channel_night_kernel",
    "L5_time_grid_overlay", "L8_alignment_summary", "A8_token_ranking", "J7_events_on_grid", "J8_point_in_interval", "W6_gaps_and_islands",
    "W2_record_offset_in_shard", "W3_window_members", "W5_global_index_lookup", "W10_order_violations", "W11_greedy_shards", "W12_grade_batches",
    "W13_pad_batches", "D1_exact_once_batches", "P7_record_admission", "K1_signal_sink", "K8_idempotent_publish", "S14_committed_release_scan",
    "J3_h5_edf_compare", "J5_expected_channel_missing", "A9_issue_counts", "A10_filter_distribution", "A13_duration_quantiles", "A22_combination_completeness",
    "A25_joint_filter_top3", "A29_calibration_completeness", "A34_header_field_distribution", "P16_channel_selection", "A42_manifest_summary",
    "A38_histogram_quantiles", "A43_masked_mean_pooling", "X3_rational_resample", "D2_class_metrics", "D3_regression_metrics")


def contiguous_read(spark, folder: str, repeats: int = 9) -> tuple[float, float]:
    """Median seconds to plan and read 32 consecutive 15-channel epochs of one recording (11.5 MB), and of planning alone.

    Vectors are repeated to 6000 samples and published as the library publishes signals: several recordings a
    shard, row groups of 8 MB. The release is opened once; each read asks it for one recording and a range of epochs.
    """
    from pyspark.sql import functions as F

    tiled = F.slice(F.flatten(F.array_repeat("embedding", 94)), 1, 6000)
    recording = F.floor(F.col("vec_id") / 480)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 1920").select(
        F.concat(F.lit("r"), recording).alias("recording_id"), F.floor(F.col("vec_id") % 480 / 15).cast("int").alias("epoch_in_record"),
        F.concat(F.lit("c"), F.col("vec_id") % 15).alias("channel"), tiled.alias("samples"), F.floor(recording / 2).cast("string").alias("shard_id"))
    root = scratch_path(spark, "bench-release")
    release.publish(root, {"signal_epochs": rows}, gates={"signal_epochs": lambda df: df.select("recording_id").limit(0)})
    stored = release.read_published(spark, root, "signal_epochs", pinned=True)
    reads, plans = [], []
    for i in range(repeats):
        start = time.perf_counter()
        one = stored.where((F.col("recording_id") == f"r{i % 4}") & F.col("epoch_in_record").between(0, 31))
        one._jdf.queryExecution().executedPlan()
        plans.append(time.perf_counter() - start)
        one.write.format("noop").mode("overwrite").save()
        reads.append(time.perf_counter() - start)
    return tuple(round(sorted(t)[repeats // 2], 3) for t in (reads, plans))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(f"local[{cpus}]", app="nightgrid-bench", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's compiler and the Python workers before timing anything.
    for name in names[:1]:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    if "BENCH_QUERIES" not in os.environ:
        seconds["read_32_epochs"], seconds["plan_32_epochs"] = contiguous_read(spark, folder)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
