"""Shards and batches: capacity packing, sampling orders, padding, masks and scales."""

from __future__ import annotations

import math
from collections.abc import Sequence
from numbers import Real

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.columns import hash_unit
from nightgrid.operators.scan import data_bucket, dense_index
from nightgrid.session import write_once


def _next_start(sizes: np.ndarray, max_records: int, target: float) -> np.ndarray:
    """For each position: where the following batch starts if one starts here."""
    n = len(sizes)
    stop = np.arange(n) + 1
    load = sizes.astype(np.float64).copy()
    open_ = np.ones(n, bool)
    for _ in range(max_records - 1):
        fits = open_ & (stop < n)
        extra = np.where(fits, sizes[np.minimum(stop, n - 1)], 0)
        open_ = fits & (load + extra <= target)
        load += np.where(open_, extra, 0)
        stop = stop + open_
    return stop


def oversized(planned: DataFrame, size: str = "estimated_bytes", cap: int = 8 * m.GIB) -> DataFrame:
    """Records above the hard cap; greedy packing must not be run while any exist."""
    return planned.where(F.col(size) > cap)


def greedy_batches(planned: DataFrame, key: str, order: str, size: str = "estimated_bytes",
                   max_records: int = 16, target: float = 6 * m.GIB, block: int = 16_384) -> DataFrame:
    """Add ``shard_no``: in order, a batch closes at max_records or when target would be passed.

    The rule looks sequential, but a batch never holds more than ``max_records`` rows, so a
    block of rows is a function from "offset of the first batch start" (fewer than
    max_records choices) to the same offset in the next block. Blocks compute their
    functions in parallel, a tree composes them sixty-four at a time, and blocks then number
    their rows in parallel. ``order`` may be of any orderable type and need not be unique: rows equal in it go by key,
    then by size. Positions are written once, and rows get their batch by position.
    """
    flat = write_once(dense_index(planned, list(dict.fromkeys([order, key, size])), data_bucket(planned, order), "_pos"), "batch-order")
    # Neighbouring blocks are worked on together, some 16,384 rows in one call.
    unit = block * max(1, 16_384 // block)
    narrow = flat.select("_pos", F.col(size).cast("double").alias("_size"))
    home = F.floor(F.col("_pos") / unit)
    # A unit also sees the first rows of the next one, where its last batch may end.
    copies = F.when((F.col("_pos") % unit < max_records) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    seen = narrow.select("_pos", "_size", F.explode(copies).alias("_unit"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        base = int(pdf["_unit"].iloc[0]) * unit
        stops = _next_start(pdf["_size"].to_numpy(), max_records, target).tolist()
        inside, out = int((pdf["_pos"] - base < unit).sum()), []
        for low in range(0, inside, block):
            high = min(low + block, inside)
            leave, count = [0] * (high - low), [0] * (high - low)
            for i in range(high - low - 1, -1, -1):
                j = stops[low + i]
                leave[i], count[i] = (j - high, 1) if j >= high else (leave[j - low], count[j - low] + 1)
            out += [((base + low) // block, e, leave[e], count[e], high - low) for e in range(min(max_records, high - low))]
        return pd.DataFrame(out, columns=["_block", "_entry", "_leave", "_count", "_rows"])

    steps = seen.groupBy("_unit").applyInPandas(chain, _STEPS)

    starts = _block_starts(write_once(steps, "block-steps"), -(-flat.count() // block), max_records)

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        stop = _next_start(pdf["_size"].to_numpy(), max_records, target)
        n, i, no = len(pdf), int(pdf["_entry"].iloc[0]), int(pdf["_done"].iloc[0])
        shard = np.full(n, no - 1, np.int64)
        while i < n:
            shard[i : stop[i]] = no
            i, no = int(stop[i]), no + 1
        return pd.DataFrame({"_pos": pdf["_pos"], "shard_no": shard})

    # What enters a unit is what enters its first block.
    entered = starts.where(F.col("_block") % (unit // block) == 0).select((F.col("_block") * block / unit).cast("bigint").alias("_unit"), "_entry", "_done")
    numbered = narrow.withColumn("_unit", home).join(entered, "_unit").groupBy("_unit").applyInPandas(number, "_pos bigint, shard_no bigint")
    return flat.join(numbered, "_pos").select(*planned.columns, F.col("_pos").alias("position"), "shard_no")


_STEPS = "_block bigint, _entry int, _leave bigint, _count bigint, _rows bigint"


class _Walk:
    """Blocks of one group in order, each a function from the row where it is entered."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["_block", "_entry"])
        self.blocks, first = np.unique(pdf["_block"].to_numpy(), return_index=True)
        self.first, self.rows = first.tolist(), pdf["_rows"].to_numpy()[first].tolist()
        self.leave, self.count = pdf["_leave"].tolist(), pdf["_count"].tolist()

    def enter(self, entry: int) -> tuple[list[tuple[int, int]], int, int]:
        """(entry, batches begun before) of each block, then what leaves the last one and all batches begun."""
        met, done = [], 0
        for first, rows in zip(self.first, self.rows):
            met.append((entry, done))
            if entry >= rows:
                entry -= rows
            else:
                entry, done = self.leave[first + entry], done + self.count[first + entry]
        return met, entry, done


def _block_starts(steps: DataFrame, blocks: int, max_records: int, fan: int = 64) -> DataFrame:
    """(_block, _entry, _done) of every block, from the functions of all blocks.

    Up the tree, ``fan`` neighbouring functions become one; down it, each group hands its entry to
    its blocks. A task sees ``fan`` blocks at a time, whatever their number.
    """

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        walk = _Walk(pdf)
        size = sum(walk.rows)
        out = [(key[0], entry, *walk.enter(entry)[1:], size) for entry in range(min(max_records, size))]
        return pd.DataFrame(out, columns=["_block", "_entry", "_leave", "_count", "_rows"])

    def descend(key: tuple, pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        base = int(above["_done"].iloc[0])
        walk = _Walk(pdf)
        out = [(int(b), e, base + d) for b, (e, d) in zip(walk.blocks, walk.enter(int(above["_entry"].iloc[0]))[0])]
        return pd.DataFrame(out, columns=["_block", "_entry", "_done"])

    group = F.floor(F.col("_block") / fan).cast("bigint")
    levels = [steps]
    while blocks > fan:
        levels.append(levels[-1].groupBy(group.alias("_group")).applyInPandas(compose, _STEPS))
        blocks = -(-blocks // fan)
    starts = steps.sparkSession.createDataFrame([(0, 0, 0)], "_group bigint, _entry bigint, _done bigint")
    for level in reversed(levels):
        down = level.withColumn("_group", group).groupBy("_group").cogroup(starts.groupBy("_group"))
        starts = down.applyInPandas(descend, "_block bigint, _entry bigint, _done bigint").withColumnRenamed("_block", "_group")
    return starts.withColumnRenamed("_group", "_block")


def grade_batches(windows: DataFrame, batch_size: int, num_batches: int, seed: int = 42,
                  order: str = "window_index", grade: str = "night_grade") -> DataFrame:
    """Batches of one grade each: grade uniform, then windows uniform within it, with replacement."""
    ranked = dense_index(windows, [order], data_bucket(windows, order), "_rank", [grade])
    # At most five rows.
    grades = (windows.groupBy(grade).agg(F.count("*").alias("_n"))
              .withColumn("_g", F.row_number().over(Window.orderBy(grade)) - 1)
              .withColumn("_grades", F.count("*").over(Window.partitionBy())))
    spark = windows.sparkSession
    draws = (spark.range(num_batches * batch_size)
             .select(F.floor(F.col("id") / batch_size).alias("batch_no"), (F.col("id") % batch_size).alias("slot")))
    pick = hash_unit(str(seed), "grade", F.col("batch_no").cast("string"))
    place = hash_unit(str(seed), "window", F.col("batch_no").cast("string"), F.col("slot").cast("string"))
    chosen = (draws.crossJoin(F.broadcast(grades)).where(F.floor(pick * F.col("_grades")) == F.col("_g"))
              .withColumn("_rank", F.floor(place * F.col("_n"))))
    return chosen.join(ranked, [grade, "_rank"]).drop("_rank", "_n", "_g", "_grades")


def exact_once_batches(windows: DataFrame, batch_size: int, seed: int, epoch_pass: int,
                       order: str = "window_index", grade: str = "night_grade") -> DataFrame:
    """One pass: every window once, shuffled, one grade per batch, last batch may be short."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch_pass)), F.col(order).cast("string")), 256)
    rows = windows.withColumn("_h", digest)
    # Leading hex digits are uniform, so the buckets of a large grade are even.
    bucket = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    rows = dense_index(rows, ["_h", order], bucket, "_rank", [grade])
    return (rows.withColumn("batch_no", F.floor(F.col("_rank") / batch_size))
            .withColumn("slot", F.col("_rank") % batch_size).drop("_h", "_rank"))


#: Rounds of a shuffle without sorting, and how often an index may leave [0, n) on the way.
ROUNDS, WALKS = 4, 64


def permuted(index: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """Where a keyed permutation of [0, n) sends ``index``, computed from the index alone.

    Four Feistel rounds permute the square of side ceil(sqrt(n)), at most 2 sqrt(n) + 1 larger than n; what lands outside
    [0, n) is sent on until it is inside, which keeps the map one-to-one. Where the square has more than ``WALKS`` places
    outside, n is above 1,000 and 64 walks in a row fall outside with a probability below 10^-70; the query then
    fails. ``inverse`` undoes it.
    """
    side = F.ceil(F.sqrt(n.cast("double")))
    half = lambda i, x: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", key, i.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("bigint"), side)

    def step(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        pair = (F.pmod(right - half(i, left), side), left) if inverse else (right, F.pmod(left + half(i, right), side))
        return F.struct(pair[0].alias("l"), pair[1].alias("r"))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / side).alias("l"), F.pmod(x, side).alias("r"))
        order = F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])
        return F.aggregate(order, start, step, lambda s: s["l"] * side + s["r"])

    walks = F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(WALKS).cast("bigint"), side * side - n)))
    lost = F.raise_error(F.lit("no place found by the permutation")).cast("bigint")
    return F.aggregate(walks, once(index.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(once(x)), lambda x: F.when(x < n, x).otherwise(lost))


def permuted_batches(indexed: DataFrame, batch_size: int, seed: int, epoch_pass: int, index: str = "grade_index",
                     size: str = "grade_size", grade: str = "night_grade") -> DataFrame:
    """One pass over windows that carry a dense index within their grade and the grade's size: batch_no and slot, without a sort.

    The index is made once; a pass is an expression on each row. Which windows batch k holds follows from k too:
    ``permuted(position, n, batch_key(...))`` for its positions, so a pass resumes at any batch.
    """
    place = permuted(F.col(index), F.col(size), batch_key(seed, epoch_pass, F.col(grade)), inverse=True)
    return (indexed.withColumn("_place", place).withColumn("batch_no", F.floor(F.col("_place") / batch_size))
            .withColumn("slot", F.col("_place") % batch_size).drop("_place"))


def batch_key(seed: int, epoch_pass: int, grade: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch_pass)), grade.cast("string"))


def fixed_subset(windows: DataFrame, size: int, seed: int, split: str = "split",
                 order: str = "window_index") -> DataFrame:
    """Uniform sample without replacement per split, the same on every run.

    The sample is the ``size`` smallest hashes. Counting rows per leading hash digits shows
    which digits can hold them, so only about ``size`` rows of a split are ever ordered.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string")), 256)
    rows = windows.withColumn("_h", digest).withColumn("_d", F.substring("_h", 1, 4))
    counts = rows.groupBy(split, "_d").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(split).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    last = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .where(F.col("_before") < size).groupBy(split).agg(F.max("_d").alias("_last")))
    # One row a split goes to every task: rows are sifted where they are read, and a split is never gathered.
    near = rows.join(F.broadcast(last), split).where(F.col("_d") <= F.col("_last"))
    w = Window.partitionBy(split).orderBy("_h", order)
    return near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k", "_h", "_d", "_last")


def pad_batches(samples: DataFrame, epochs: DataFrame, batch: str = "batch_no", slot: str = "slot",
                length: str = "n_epochs", position: str = "position") -> DataFrame:
    """Fill each batch to its longest window with masked rows (index and offset -1)."""
    longest = samples.groupBy(batch).agg(F.max(length).alias("_max"))
    # A window is at most the context length, so this sequence is short.
    full = (samples.select(batch, slot).join(longest, batch)
            .withColumn(position, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_max") - 1))).drop("_max"))
    rows = full.join(epochs.withColumn("epoch_mask", F.lit(True)), [batch, slot, position], "left")
    return rows.fillna(False, ["epoch_mask"]).fillna(-1, [c for c in ("epoch_in_record", "epoch_start_offset_ns")
                                                         if c in rows.columns])


def pad_samples(values: Column, width: Column) -> tuple[Column, Column]:
    """Array padded with zeros to ``width`` and its validity mask."""
    extra = F.greatest(width - F.size(values), F.lit(0))
    mask = F.concat(F.array_repeat(F.lit(True), F.size(values)), F.array_repeat(F.lit(False), extra))
    return F.concat(values, F.array_repeat(F.lit(0.0).cast("float"), extra)), mask


def data_valid() -> Column:
    return F.col("valid") & F.col("epoch_mask")


def active_samples(samples: Column, active: Column, sample_visible: Column | None = None) -> Column:
    """Samples kept only where valid and visible; everything else is exactly zero."""
    zero = F.lit(0.0).cast("float")
    if sample_visible is not None:
        samples = F.zip_with(samples, sample_visible, lambda x, v: F.when(v, x).otherwise(zero))
    return F.when(active, samples).otherwise(F.transform(samples, lambda x: zero))


def fixed_scale(spec) -> tuple[float, float]:
    """(offset, divisor) from a number or an {offset, divisor} mapping."""
    if isinstance(spec, dict):
        if set(spec) != {"offset", "divisor"}:
            raise ValueError("a scale needs exactly offset and divisor")
        offset, divisor = spec["offset"], spec["divisor"]
    else:
        offset, divisor = 0.0, spec
    for x in (offset, divisor):
        if isinstance(x, bool) or not isinstance(x, Real) or not math.isfinite(x):
            raise ValueError("scale values must be finite numbers")
    if divisor <= 0:
        raise ValueError("the divisor must be positive")
    return float(offset), float(divisor)


def _affine(samples: Column, offset: float, divisor: float) -> Column:
    return F.transform(samples, lambda x: ((x.cast("double") - offset) / divisor).cast("float"))


def scale_groups(rows: DataFrame, scales: dict, known: Sequence[str], samples: str = "samples",
                 group: str = "grp", unit: str = "unit") -> DataFrame:
    """Fixed affine scale per encoding group, with the unit label that says so."""
    unknown = set(scales) - set(known)
    if unknown:
        raise ValueError(f"scales name unknown groups {sorted(unknown)}")
    value, label = F.col(samples), F.col(unit)
    for name, spec in scales.items():
        offset, divisor = fixed_scale(spec)
        moved = _affine(F.col(samples), offset, divisor)
        text = (F.concat(F.lit("("), F.col(unit), F.lit(f"-{offset:g})/{divisor:g}")) if offset
                else F.col(unit) if divisor == 1 else F.concat(F.col(unit), F.lit(f"/{divisor:g}")))
        value = F.when(F.col(group) == name, moved).otherwise(value)
        label = F.when(F.col(group) == name, text).otherwise(label)
    return rows.withColumn("_v", value).withColumn("_u", label).drop(samples, unit).withColumnsRenamed(
        {"_v": samples, "_u": unit})


def split_spo2(rows: DataFrame, group: str = "grp", channel: str = "channel") -> DataFrame:
    """SpO2 becomes its own encoding group; other groups stay."""
    return rows.withColumn(group, F.when((F.col(group) == "respiratory") & (F.col(channel) == "spo2"), "spo2")
                           .otherwise(F.col(group)))


def split_conflicts(rows: DataFrame, group: str = "grp", channel: str = "channel") -> DataFrame:
    """Batches that carry SpO2 both on its own and inside the respiratory group."""
    return rows.where(F.col(channel) == "spo2").agg(
        F.count_if(F.col(group) == "spo2").alias("own"), F.count_if(F.col(group) == "respiratory").alias("inside")
    ).where((F.col("own") > 0) & (F.col("inside") > 0))


def channel_dropout(rows: DataFrame, probability: float, min_remaining: int = 1, seed: int = 42,
                    keys: Sequence[str] = ("window_id", "modality"), groups: Sequence[str] = ("eeg",),
                    index: str = "channel_idx", mask: str = "channel_mask") -> DataFrame:
    """Hide proposed channels, lowest index first, always leaving ``min_remaining`` visible.

    A window has at most fifteen channels, so the window function runs on tiny groups.
    """
    if not 0 <= probability <= 1 or min_remaining < 0:
        raise ValueError("probability must be in [0,1] and min_remaining nonnegative")
    u = hash_unit(str(seed), *[F.col(k).cast("string") for k in keys], F.col(index).cast("string"))
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_try", F.col(mask) & F.col(keys[-1]).isin(*groups) & (u < probability))
    rows = (rows.withColumn("_visible", F.sum(F.col(mask).cast("int")).over(w))
            .withColumn("_place", F.sum(F.col("_try").cast("int")).over(w.orderBy(index))))
    drop = F.col("_try") & (F.col("_place") <= F.col("_visible") - min_remaining)
    return rows.withColumn("dropped", drop).withColumn(mask, F.col(mask) & ~drop).drop("_try", "_visible", "_place")
