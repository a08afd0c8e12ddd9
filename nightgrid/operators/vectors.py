"""Patches, position features, pooling over vectors, and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.columns import finite, ratio


def patches(rows: DataFrame, patch: int, epoch_samples: int, sample_rate: float, samples: str = "samples",
            crop: Column | None = None) -> DataFrame:
    """Non-overlapping patches inside an epoch with their time intervals; padding is -1.

    Needs epoch_start_offset_ns, epoch_mask and, for validity, data_valid.
    """
    if epoch_samples % patch:
        raise ValueError("epoch samples must be divisible by the patch length")
    count = epoch_samples // patch
    length_ns = round(patch * 1e9 / sample_rate)
    cut = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(samples, i * patch + 1, patch))
    out = rows.select(*[c for c in rows.columns if c != samples], F.posexplode(cut).alias("patch_in_epoch", "values"))
    shift = F.lit(0) if crop is None else crop.cast("bigint") * F.lit(round(1e9 / sample_rate))
    start = F.col("epoch_start_offset_ns") + F.col("patch_in_epoch").cast("bigint") * length_ns + shift
    return (out.withColumn("start_ns", F.when(F.col("epoch_mask"), start).otherwise(-1))
            .withColumn("end_ns", F.when(F.col("epoch_mask"), start + length_ns).otherwise(-1))
            .withColumn("sample_start", F.col("patch_in_epoch") * patch))


def sinusoidal(position: Column, dim: int) -> Column:
    """Interleaved sine and cosine features, base 10000, cut to ``dim`` entries."""
    step = -F.log(F.lit(10000.0)) / dim
    angle = lambda i: position.cast("double") * F.exp((i - i % 2).cast("double") * step)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def _weighted_mean(df: DataFrame, keys: Sequence[str], vector: str, weight: Column, dim: int, name: str) -> DataFrame:
    """Weighted mean per position as plain partial sums: one shuffled row per key and task."""
    rows = df.withColumn("_w", weight)
    term = lambda i: F.when(F.col("_w") > 0, F.get(F.col(vector), i).cast("double") * F.col("_w")).otherwise(0.0)
    sums = rows.groupBy(*keys).agg(F.sum("_w").alias("_total"), F.array(*[F.sum(term(i)) for i in range(dim)]).alias("_sums"))
    total = F.greatest(F.col("_total"), F.lit(1e-12))
    return sums.select(*keys, F.transform("_sums", lambda s: s / total).alias(name))


def mean_pool(df: DataFrame, keys: Sequence[str], vector: str, active: Column, dim: int) -> DataFrame:
    """Mean over active rows; exact zeros when none is active."""
    return _weighted_mean(df, keys, vector, F.when(active, 1.0).otherwise(0.0), dim, "pooled")


def attention_pool(df: DataFrame, keys: Sequence[str], vector: str, active: Column,
                   query: Sequence[float], scale: float = 2.0) -> DataFrame:
    """Softmax pooling with cosine scores against a fixed query vector.

    Scores lie in [-scale, scale], so exponentials need no running maximum and the softmax
    is a ratio of two sums.
    """
    norm = max(sum(q * q for q in query) ** 0.5, 1e-6)
    unit = F.array(*[F.lit(float(q) / norm) for q in query])
    x = F.col(vector)
    dot = F.aggregate(F.zip_with(x, unit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    score = dot / F.greatest(size, F.lit(1e-6)) * F.lit(float(scale))
    return _weighted_mean(df, keys, vector, F.when(active, F.exp(score)).otherwise(0.0), len(query), "pooled")


def bounding_interval(df: DataFrame, keys: Sequence[str], active: Column, start: str = "start_ns",
                      end: str = "end_ns") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(active, F.col(start))), F.lit(-1)).alias("start_ns"),
        F.coalesce(F.max(F.when(active, F.col(end))), F.lit(-1)).alias("end_ns"))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, classes: Sequence[int], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1, support and predicted count per class, zero where undefined."""
    c = confusion(df, label, predicted)
    names = m.inline_table(df.sparkSession, [(int(k),) for k in classes], ("class",))
    # Two small aggregates over at most classes x classes rows.
    true = c.groupBy(F.col(label).alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).alias("hits"))
    said = c.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("predicted_count"))
    out = names.join(true, "class", "left").join(said, "class", "left").fillna(0)
    z = lambda x: F.coalesce(x, F.lit(0.0))
    out = (out.withColumn("precision", z(ratio(F.col("hits"), F.col("predicted_count"))))
           .withColumn("recall", z(ratio(F.col("hits"), F.col("support")))))
    both = F.col("support") + F.col("predicted_count")
    return out.withColumn("f1", z(ratio(2 * F.col("hits"), both)))


def class_summary(metrics: DataFrame) -> DataFrame:
    """Accuracy, macro-F1 over all classes, balanced accuracy over classes with support."""
    return metrics.agg(
        ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.sum("support").alias("total"))


def regression_metrics(df: DataFrame, field: str = "field", target: str = "target", predicted: str = "predicted",
                       valid: Column | None = None) -> DataFrame:
    """Per field: count, MAE, RMSE and R2 (absent for fewer than two or constant targets)."""
    use = finite(F.col(target)) & (F.lit(True) if valid is None else valid)
    y, e = F.when(use, F.col(target)), F.when(use, F.col(predicted) - F.col(target))
    out = df.groupBy(field).agg(
        F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_sse"),
        F.var_pop(y).alias("_var"), (F.min(y) == F.max(y)).alias("_flat"))
    r2 = F.when((F.col("n") >= 2) & ~F.col("_flat"), 1 - F.col("_sse") / (F.col("_var") * F.col("n")))
    return out.withColumn("r2", r2).drop("_sse", "_var", "_flat")


def pooled_errors(df: DataFrame, target: str = "target", predicted: str = "predicted", valid: Column | None = None) -> DataFrame:
    use = finite(F.col(target)) & (F.lit(True) if valid is None else valid)
    e = F.when(use, F.col(predicted) - F.col(target))
    return df.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def level_feature(values: Column, offset: float = 95.0, divisor: float = 5.0) -> Column:
    """Mean of a patch after the fixed affine scale."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v.cast("double") - offset) / divisor)
    return total / F.size(values)
