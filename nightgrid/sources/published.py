"""Reader of releases written by this package."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.operators import grid, release
from nightgrid.sources.registry import BUILT_IN, Release


def read_release(spark: SparkSession, root: str, version: str = m.RELEASE_VERSION,
                 status: str = "COMPLETE", tasks: Sequence[str] = (), verify: bool = False) -> Release:
    """A release this package published, as it is committed now; ``verify`` leaves out shards whose content no longer has its digest."""
    release.check_release(version, status, tasks)

    def task_table(task: str) -> DataFrame:
        if task not in tasks:
            raise ValueError(f"task {task!r} was not requested")
        return release.read_published(spark, root, "task_epochs").where(F.col("task") == task)

    return Release(BUILT_IN, version, float(m.EPOCH_SECONDS), m.channel_dimension(spark),
                   release.read_published(spark, root, "records", verify),
                   release.read_published(spark, root, "signal_epochs", verify, pinned=True), task_table)


def read_windows(source: Release, context: int, stride: int | None = None, drop_last: bool = False,
                 split: str | None = None, seed: int = 42, ratios=(0.8, 0.1, 0.1),
                 grades: Sequence[int] | None = None, tasks: Sequence[str] = (),
                 transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Epoch rows of every window: filters first, then each stored epoch finds its windows; waveforms do not move.

    ``transform`` is the caller's own step over the finished rows, part of the same plan.
    """
    chosen = grid.select_records(source.records, source.name, split, seed, ratios, grades)
    rows = grid.epochs_in_windows(source.signals, chosen, context, stride, drop_last)
    for task in tasks:
        t = source.tasks(task).select("recording_id", "epoch_in_record", F.col("qc_code").alias(f"{task}_qc_code"),
                                      F.col("valid").alias(f"{task}_valid"))
        rows = rows.join(t, ["recording_id", "epoch_in_record"], "left")
    seconds = F.lit(source.epoch_seconds)
    rows = (rows.withColumn("start_sec", F.col("start_epoch") * seconds)
            .withColumn("duration_sec", F.col("n_epochs") * seconds))
    return rows if transform is None else transform(rows)
