"""Record admission, the 30-second grid, and context windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.columns import epoch_offset_ns, finite, release_split
from nightgrid.operators.scan import data_bucket, dense_index, number_bucket, running
from nightgrid.session import sent

_STEP = 4096


def explode_range(df: DataFrame, stop: Column, name: str, start: Column | None = None) -> DataFrame:
    """One row per integer in [start, stop), built from blocks that never grow with the range.

    A long range is cut into blocks, the few block rows are spread over a fixed number of
    tasks (so that adaptive coalescing does not undo it), and only then opened.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = (F.lit(0) if start is None else start).cast("bigint")
    last = stop.cast("bigint")
    blocks = F.when(last > first, F.sequence(first, last - 1, F.lit(_STEP).cast("bigint")))
    rows = (df.withColumn("_range_stop", last).withColumn("_range_from", F.explode(blocks))
            .repartition(tasks, F.xxhash64("_range_from", *df.columns)))
    until = F.least(F.col("_range_from") + F.lit(_STEP), F.col("_range_stop")) - 1
    return (rows.withColumn(name, F.explode(F.sequence(F.col("_range_from"), until)))
            .drop("_range_from", "_range_stop"))


def epoch_count(duration: Column, epoch_seconds: float = 30.0) -> Column:
    return F.floor(duration / F.lit(float(epoch_seconds))).cast("bigint")


def tail_seconds(duration: Column, epoch_seconds: float = 30.0) -> Column:
    return duration - epoch_count(duration, epoch_seconds) * F.lit(float(epoch_seconds))


def epoch_grid(records: DataFrame, keys: Sequence[str], epochs: Column,
               epoch_seconds: float = 30.0) -> DataFrame:
    """Half-open fixed slots of each record with their offset in nanoseconds."""
    rows = explode_range(records.select(*keys, epochs.alias("_n")), F.col("_n"), "epoch_in_record")
    return rows.select(*keys, "epoch_in_record",
                       epoch_offset_ns(F.col("epoch_in_record"), epoch_seconds).alias("epoch_start_offset_ns"))


def admit_records(inventory: DataFrame, fixed_exclusions: DataFrame | None = None,
                  key: str = "session_key", duration: str = "h5_duration_seconds",
                  bytes_per_epoch: int = 15 * m.EPOCH_SAMPLES * 4) -> DataFrame:
    """Every inventory row with status PLANNED, FIXED_EXCLUDED or RECORD_EXCLUDED.

    Use :func:`planned` and :func:`excluded` for the two ledgers.
    """
    d = F.col(duration)
    rows = inventory
    if fixed_exclusions is None:
        rows = rows.withColumn("_fixed", F.lit(False))
    else:
        listed = fixed_exclusions.select(F.col(key), F.lit(True).alias("_fixed")).distinct()
        rows = rows.join(listed, key, "left").fillna(False, ["_fixed"])
    in_range = finite(d.cast("double")) & d.between(m.MIN_DURATION_SECONDS, m.MAX_DURATION_SECONDS)
    status = (F.when(F.col("_fixed"), "FIXED_EXCLUDED").when(~in_range, "RECORD_EXCLUDED")
              .otherwise("PLANNED"))
    n = F.when(F.col("status") == "PLANNED", epoch_count(d))
    return (rows.withColumn("status", status)
            .withColumn("reason", F.when(F.col("status") == "FIXED_EXCLUDED", "SOURCE_DURATION_CONFLICT")
                        .when(F.col("status") == "RECORD_EXCLUDED", "INVALID_ROOT_DURATION"))
            .withColumn("epoch_count", n)
            .withColumn("estimated_bytes", F.col("epoch_count") * F.lit(bytes_per_epoch))
            .drop("_fixed"))


def planned(admission: DataFrame) -> DataFrame:
    return admission.where(F.col("status") == "PLANNED").drop("status", "reason")


def excluded(admission: DataFrame, key: str = "session_key") -> DataFrame:
    return admission.where(F.col("status") != "PLANNED").select(key, "status", "reason")


def first_epoch(records: DataFrame, shard: str, position: str, epochs: str = "n_epochs") -> DataFrame:
    """Row offset of each record inside its shard."""
    return running(records, [shard], [position], data_bucket(records, position),
                   {"first_epoch": ("sum", F.col(epochs))})


def check_window_arguments(context: int, stride: int | None, split: str | None = None,
                           grades: Sequence[int] | None = None) -> int:
    """Caller errors are raised at once; returns the stride to use."""
    step = context if stride is None else stride
    if context <= 0 or step <= 0:
        raise ValueError("context and stride must be positive")
    if split not in (None, "train", "validation", "test"):
        raise ValueError("split must be train, validation, test or None")
    if grades is not None and (not grades or any(type(g) is not int or not 1 <= g <= 5 for g in grades)):
        raise ValueError("grades must be a nonempty list of integers from 1 to 5")
    return step


def select_records(records: DataFrame, dataset: str, split: str | None = None, seed: int = 42,
                   ratios: Sequence[float] = (0.8, 0.1, 0.1),
                   grades: Sequence[int] | None = None) -> DataFrame:
    """Split and grade filters, applied before any window exists."""
    check_window_arguments(1, None, split, grades)
    subject_split = release_split(dataset, F.col("subject_id"), seed, ratios)
    if grades is not None:
        records = records.where(F.col("night_grade").isin(*grades))
    return records if split is None else records.where(subject_split == split)


def window_count(epochs: Column, context: int, stride: int, drop_last: bool = False) -> Column:
    n = epochs.cast("bigint")
    if drop_last:
        return F.greatest(F.lit(0), F.floor((n - context) / stride) + 1)
    return F.ceil(n / stride)


def context_windows(records: DataFrame, context: int, stride: int | None = None,
                    drop_last: bool = False, keys: Sequence[str] = ("recording_id",),
                    epochs: str = "n_epochs") -> DataFrame:
    """Record-bounded windows as (keys, window_no, start_epoch, n_epochs)."""
    step = check_window_arguments(context, stride)
    rows = records.select(*keys, F.col(epochs).cast("bigint").alias("_n"))
    count = window_count(F.col("_n"), context, step, drop_last)
    return (explode_range(rows, count, "window_no")
            .withColumn("start_epoch", F.col("window_no") * step)
            .withColumn("n_epochs", F.least(F.lit(context).cast("bigint"), F.col("_n") - F.col("start_epoch")))
            .drop("_n"))


def window_epochs(windows: DataFrame) -> DataFrame:
    """Members of each window; a window is at most ``context`` epochs long."""
    return windows.withColumn("epoch_in_record", F.explode(F.sequence(
        F.col("start_epoch"), F.col("start_epoch") + F.col("n_epochs") - 1)))


def epochs_in_windows(epochs: DataFrame, records: DataFrame, context: int, stride: int | None = None, drop_last: bool = False,
                      key: str = "recording_id") -> DataFrame:
    """Epoch rows with every window they are in: the rows of ``window_epochs`` joined to ``epochs``, which stay where they are.

    Which windows hold an epoch follows from its number and its record's length, so only one narrow row a
    record meets the epochs; as long as these rows are few enough to be sent, no epoch is shuffled.
    """
    step = check_window_arguments(context, stride)
    lengths = records.select(key, F.col("n_epochs").cast("bigint").alias("_n"))
    at, last_window = F.col("epoch_in_record"), window_count(F.col("_n"), context, step, drop_last) - 1
    first = F.greatest(F.lit(0), F.ceil((at - context + 1) / step))
    last = F.least(F.floor(at / step), last_window)
    rest = [c for c in epochs.columns if c not in (key, "epoch_in_record")]
    rows = epochs.join(sent(lengths), key).where((at >= 0) & (at < F.col("_n")) & (first <= last))
    rows = rows.withColumn("window_no", F.explode(F.sequence(first, last))).withColumn("start_epoch", F.col("window_no") * step)
    return rows.withColumn("n_epochs", F.least(F.lit(context).cast("bigint"), F.col("_n") - F.col("start_epoch"))).select(
        key, "epoch_in_record", "window_no", "start_epoch", "n_epochs", *rest)


def window_ends(records: DataFrame, order: str, context: int, stride: int | None = None,
                drop_last: bool = False, epochs: str = "n_epochs") -> DataFrame:
    """Global index range [window_start, window_end) of each record's windows."""
    step = check_window_arguments(context, stride)
    rows = records.withColumn("n_windows", window_count(F.col(epochs), context, step, drop_last).cast("bigint"))
    rows = rows.where(F.col("n_windows") > 0)
    rows = running(rows, [], [order], data_bucket(rows, order), {"window_start": ("sum", F.col("n_windows"))})
    return rows.withColumn("window_end", F.col("window_start") + F.col("n_windows"))


def locate(ends: DataFrame, indices: DataFrame, stride: int, context: int, total: int | None = None,
           width: int = 64, epochs: str = "n_epochs") -> DataFrame:
    """Global window index to (record, start epoch, length); negative counts from the end.

    A range lookup turned into an equi-join: ranges and indices meet in index blocks.
    """
    n = ends.agg(F.max("window_end").alias("_total"))
    want = (indices.crossJoin(F.broadcast(n))  # one row
            .withColumn("_i", F.when(F.col("index") < 0, F.col("index") + F.col("_total"))
                        .otherwise(F.col("index")))
            .withColumn("_block", F.floor(F.col("_i") / width)))
    span = explode_range(ends, F.floor((F.col("window_end") - 1) / width) + 1, "_block",
                         F.floor(F.col("window_start") / width))
    hit = want.join(span, "_block").where(
        (F.col("_i") >= F.col("window_start")) & (F.col("_i") < F.col("window_end")))
    return (hit.withColumn("start_epoch", (F.col("_i") - F.col("window_start")) * stride)
            .withColumn("length", F.least(F.lit(context), F.col(epochs) - F.col("start_epoch")))
            .drop("_block", "_i", "_total"))


def order_violations(rows: DataFrame, keys: Sequence[str], start: str, length: int,
                     real: Column | None = None, order: str | None = None,
                     width: int = 4096 * m.EPOCH_NS) -> DataFrame:
    """Real rows that begin before an earlier real row of the same key has ended.

    ``width`` is the span of one scan bucket in units of the order column: wide enough to
    hold many rows, narrow enough for one task.
    """
    real = F.lit(True) if real is None else real
    order = order or start
    out = running(rows, keys, [order], number_bucket(F.col(order), width),
                  {"previous_start": ("max", F.when(real, F.col(start)))})
    return out.where(real & (F.col("previous_start") >= 0)
                     & (F.col(start) - F.col("previous_start") < length))


def global_positions(records: DataFrame, order: str) -> DataFrame:
    return dense_index(records, [order], data_bucket(records, order), "position")
