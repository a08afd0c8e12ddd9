"""Calibrated-range audit: histograms of digital codes, order statistics, profile summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightgrid.operators.kernels import Rows

# The selection tag decides which nights are sampled.
SELECTION_TAG = "f3-m2-calibrated-range-v1"
RAILS = (-32768, -32767, 32766, 32767)
PROFILE = ("dig_min", "dig_max", "phys_min", "phys_max", "unit")
POINTS = {"observed_min": 0.0, "p001": 0.001, "p01": 0.01, "median": 0.5, "p99": 0.99, "p999": 0.999, "observed_max": 1.0}


def profile_sample(channels: DataFrame, k: int = 100, key: str = "session_key", profile: Sequence[str] = PROFILE,
                   tag: str = SELECTION_TAG) -> DataFrame:
    """First k nights per profile in hash order, with the profile's night count.

    The top-k filter runs on every task before the shuffle, so a dominant profile stays small.
    """
    digest = F.sha2(F.concat(F.lit(tag + ":"), F.col(key).cast("string")), 256)
    rows = channels.withColumn("_h", digest)
    w = Window.partitionBy(*profile).orderBy("_h", key)
    top = rows.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= k).drop("_h")
    size = channels.groupBy(*profile).agg(F.count("*").alias("profile_total_nights"))
    right = size.select(*[F.col(c).alias(f"_{c}") for c in profile], "profile_total_nights")
    same = F.lit(True)
    for c in profile:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return top.join(right, same).drop(*[f"_{c}" for c in profile])


def code_histogram(samples: DataFrame, key: str = "session_key", code: str = "code") -> DataFrame:
    return samples.groupBy(key, code).agg(F.count("*").alias("n"))


def chunk_histogram(chunks: DataFrame, key: str = "session_key") -> DataFrame:
    """``code_histogram`` of (key, codes) rows whose codes are arrays: counted per batch, then summed."""
    kind = dict(chunks.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Rows(batch.column("codes"))
            counted = [np.unique(rows.values[a:a + n], return_counts=True) for a, n in zip(rows.start, rows.length)]
            owner = np.repeat(np.arange(len(counted)), [len(v) for v, _ in counted])
            values = np.concatenate([v for v, _ in counted]) if counted else np.zeros(0)
            times = np.concatenate([c for _, c in counted]) if counted else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owner)), pa.array(values.astype(np.int32)),
                                              pa.array(times.astype(np.int64))], [key, "code", "n"])

    parts = chunks.select(key, "codes").mapInArrow(run, f"`{key}` {kind}, code int, n bigint")
    return parts.groupBy(key, "code").agg(F.sum("n").alias("n"))


def histogram_statistics(histogram: DataFrame, key: str = "session_key", code: str = "code",
                         points: dict[str, float] = POINTS, rails: Sequence[int] = RAILS) -> DataFrame:
    """Lower order statistics, rail share and distinct codes per night.

    A night has at most 65,536 distinct 16-bit codes, which bounds the window below.
    """
    w = Window.partitionBy(key)
    rows = (histogram.withColumn("_cum", F.sum("n").over(w.orderBy(code).rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_total", F.sum("n").over(w)))
    at = lambda q: F.min(F.when(F.col("_cum") >= F.floor(F.lit(q) * (F.col("_total") - 1)) + 1, F.col(code)))
    return rows.groupBy(key).agg(
        *[at(q).alias(name) for name, q in points.items()], F.sum("n").alias("sample_count"),
        F.count("*").alias("unique_digital_codes"),
        (F.sum(F.when(F.col(code).isin(*rails), F.col("n")).otherwise(0)) / F.sum("n")).alias("rail_fraction"))


def to_physical(code: Column) -> Column:
    return F.col("phys_min") + (code - F.col("dig_min")) * (F.col("phys_max") - F.col("phys_min")) / (F.col("dig_max") - F.col("dig_min"))


def calibrated_detail(sample: DataFrame, statistics: DataFrame, key: str = "session_key") -> DataFrame:
    rows = sample.join(statistics, key)
    rows = rows.withColumns({p: to_physical(F.col(p)) for p in POINTS})
    lsb = (F.col("phys_max") - F.col("phys_min")) / (F.col("dig_max") - F.col("dig_min"))
    return rows.withColumn("lsb_physical", lsb).withColumn("span_p001_p999", F.col("p999") - F.col("p001"))


def representative_rank(detail: DataFrame, key: str = "session_key", profile: Sequence[str] = PROFILE) -> DataFrame:
    """Distance from the profile's median span; groups are samples of at most k nights."""
    w = Window.partitionBy(*profile)
    rows = detail.withColumn("_median", F.percentile("span_p001_p999", F.lit(0.5)).over(w))
    order = w.orderBy(F.abs(F.col("span_p001_p999") - F.col("_median")), key)
    return rows.withColumn("representative_rank", F.row_number().over(order)).drop("_median")


def profile_summary(detail: DataFrame, profile: Sequence[str] = PROFILE) -> DataFrame:
    """Medians over the sampled nights of each profile."""
    median = lambda c: F.percentile(c, F.lit(0.5))
    return detail.groupBy(*profile).agg(
        F.max("profile_total_nights").alias("profile_total_nights"), F.count("*").alias("sample_nights"),
        median("lsb_physical").alias("lsb_physical"), median("p001").alias("night_median_p001"), median("p01").alias("night_median_p01"),
        median("median").alias("night_median_p50"), median("p99").alias("night_median_p99"), median("p999").alias("night_median_p999"),
        median("span_p001_p999").alias("night_median_span_p001_p999"), F.percentile("span_p001_p999", F.lit(0.05)).alias("night_p05_span_p001_p999"),
        F.percentile("span_p001_p999", F.lit(0.95)).alias("night_p95_span_p001_p999"), median("rail_fraction").alias("median_rail_fraction"),
        F.max("rail_fraction").alias("max_rail_fraction"), median("unique_digital_codes").alias("median_unique_digital_codes"))


def comparison_windows(record_count: Column, window: int = 60) -> Column:
    """Start records of the five comparison windows at 10, 30, 50, 70 and 90 percent."""
    return F.array(*[F.greatest(F.lit(0), F.least(record_count - (window + 1), F.floor(record_count * F.lit(f)))) for f in (0.1, 0.3, 0.5, 0.7, 0.9)])


def compare_samples(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("session_key", "channel"),
                    index: str = "sample_idx", code: str = "code") -> DataFrame:
    """Equal share and largest difference of samples at the same position of two sources."""
    a = left.select(*keys, index, F.col(code).alias("_a"))
    b = right.select(*keys, index, F.col(code).alias("_b"))
    d = F.abs(F.col("_a") - F.col("_b"))
    return a.join(b, [*keys, index]).groupBy(*keys).agg(
        F.count("*").alias("comparison_sample_count"), F.avg((d == 0).cast("double")).alias("digital_equal_fraction"),
        F.max(d).alias("max_abs_digital_code_difference"))


def compare_chunks(left: DataFrame, right: DataFrame, spans: DataFrame, keys: Sequence[str] = ("session_key",)) -> DataFrame:
    """Two sources of the same samples inside chosen spans, chunk against chunk.

    left, right: keys, chunk_no, first_sample, codes (array), chunked alike. spans: keys, lsb_physical and spans, an array of
    (first, stop) sample numbers. Only chunks that a span touches are joined; a position in two spans
    counts twice, and where one source has fewer samples only the common ones count.
    """
    keys = list(keys)
    reach = F.col("first_sample") + F.size("codes")
    touched = F.exists("spans", lambda s: (s["first"] < reach) & (s["stop"] > F.col("first_sample")))
    a = left.join(spans, keys).where(touched).select(*keys, "chunk_no", "first_sample", "spans", "lsb_physical", F.col("codes").alias("_a"))
    both = a.join(right.select(*keys, "chunk_no", F.col("codes").alias("_b")), [*keys, "chunk_no"])

    @F.arrow_udf("struct<n:bigint,equal:bigint,most:bigint>")
    def compare(a: pa.Array, b: pa.Array, first: pa.Array, spans: pa.Array) -> pa.Array:
        left, right, out = Rows(a), Rows(b), []
        for i, (start, wanted) in enumerate(zip(first.to_pylist(), spans.to_pylist())):
            size = min(left.length[i], right.length[i])
            gap = np.abs(left.values[left.start[i]:left.start[i] + size].astype(np.int64) - right.values[right.start[i]:right.start[i] + size])
            parts = [gap[max(0, s["first"] - start):max(0, s["stop"] - start)] for s in wanted]
            gap = np.concatenate(parts) if parts else gap[:0]
            out.append({"n": len(gap), "equal": int((gap == 0).sum()), "most": int(gap.max(initial=0))})
        return pa.array(out, pa.struct([("n", pa.int64()), ("equal", pa.int64()), ("most", pa.int64())]))

    rows = both.select(*keys, "lsb_physical", compare("_a", "_b", "first_sample", "spans").alias("r"))
    return rows.groupBy(*keys).agg(
        F.sum("r.n").alias("comparison_sample_count"), (F.sum("r.equal") / F.sum("r.n")).alias("digital_equal_fraction"),
        F.max("r.most").alias("max_abs_digital_code_difference"), F.max(F.col("r.most") * F.col("lsb_physical")).alias("max_abs_physical_difference"))


def compare_metadata(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("session_key", "channel"),
                     fields: Sequence[str] = ("fs_hz", *PROFILE)) -> DataFrame:
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))
    return left.alias("l").join(right.alias("r"), list(keys)).select(*keys, same.alias("metadata_equal"))
