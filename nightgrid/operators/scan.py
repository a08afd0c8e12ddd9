"""Order-dependent operators that stay balanced when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sends a key to one task. Here the key's rows
are first cut into value buckets; each bucket is scanned on its own, and only one row per
(key, bucket) takes part in the scan that links buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampType

from nightgrid.functions.columns import finite

_BUCKET = "_bucket"


def number_bucket(x: Column, width: int = 65_536) -> Column:
    return F.floor(x / F.lit(width))


def data_bucket(df: DataFrame, order: str, parts: int = 128, sample: int = 4096) -> Column:
    """Bucket of a row by boundaries taken from the column's own values, of any orderable type.

    Numbers and times are cut at approximate percentiles, which one mergeable aggregation gives. For other types a hash picks
    about ``sample`` values (never more than four times as many), whose quantiles are the boundaries. So buckets are even
    for dense numbers, sparse ids and text alike. Null comes first.
    """
    values = df.select(order).where(F.col(order).isNotNull())
    if isinstance(df.schema[order].dataType, (NumericType, DateType, TimestampType)):
        cuts = values.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], sample)).first()[0]
        return _place(order, cuts or [])
    total = values.count()
    if total > sample:
        values = values.where(F.xxhash64(order, F.lit("bucket")) < F.lit(int(sample / total * (1 << 64)) - (1 << 63)))
    seen = sorted({r[0] for r in values.limit(4 * sample).collect()})
    cuts = [seen[len(seen) * i // parts] for i in range(1, parts)] if len(seen) > parts else seen[1:]
    return _place(order, cuts)


def _place(order: str, cuts: Sequence) -> Column:
    """How many cuts are at or below a value, -1 for null: a search tree of plain comparisons.

    No lambda: in a self join Spark has moved conditions over a lambda to the side that lacks the column.
    """
    cuts, value = sorted(set(cuts)), F.col(order)

    def among(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(value < F.lit(cuts[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return F.when(value.isNull(), F.lit(-1)).otherwise(among(0, len(cuts))) if cuts else F.lit(0)


def _over(how: str, value: Column, window) -> Column:
    if how in ("sum", "count"):
        return F.sum(value).over(window)
    if how == "max":
        return F.max(value).over(window)
    return F.last(value, ignorenulls=True).over(window)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column,
            columns: dict[str, tuple[str, Column]], inclusive: bool = False) -> DataFrame:
    """Add running aggregates over the earlier rows of each key.

    ``columns`` maps an output name to (how, value); how is sum, count, max or last (last
    non-null). ``bucket`` must not decrease along ``order``. Keys must not be null.
    """
    keys = list(keys)
    base = df.withColumn(_BUCKET, bucket)
    position = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    parts = []
    for name, (how, value) in columns.items():
        if how == "sum":
            agg = F.sum(value)
        elif how == "count":
            agg = F.count(F.when(value, 1))
        elif how == "max":
            agg = F.max(value)
        else:
            agg = F.max_by(value, F.when(value.isNotNull(), position))
        parts.append(agg.alias(f"_part_{name}"))
    sums = base.groupBy(*keys, _BUCKET).agg(*parts)
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, _BUCKET, *[
        _over(how, F.col(f"_part_{name}"), earlier).alias(f"_carry_{name}")
        for name, (how, _) in columns.items()])
    inside = (Window.partitionBy(*keys, _BUCKET).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    # Per-row arguments are materialised first so that the window sees plain columns.
    for name, (how, value) in columns.items():
        base = base.withColumn(f"_value_{name}", value.cast("int") if how == "count" else value)
    out = base.join(carry, [*keys, _BUCKET], "left")
    for name, (how, _) in columns.items():
        local = _over(how, F.col(f"_value_{name}"), inside)
        before = F.col(f"_carry_{name}")
        if how in ("sum", "count"):
            full = F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif how == "max":
            full = F.greatest(local, before)
        else:
            full = F.coalesce(local, before)
        out = out.withColumn(name, full)
    drop = [f"_{kind}_{n}" for n in columns for kind in ("value", "carry")]
    return out.drop(_BUCKET, *drop)


def dense_index(df: DataFrame, order: Sequence[Column | str], bucket: Column,
                name: str = "row_no", keys: Sequence[str] = ()) -> DataFrame:
    """Zero-based position in a total order, without one global sort task."""
    return running(df, keys, order, bucket, {name: ("count", F.lit(True))})


def islands(df: DataFrame, keys: Sequence[str], position: str, width: int = 65_536) -> DataFrame:
    """Maximal runs of consecutive integers per key as (keys, first, last).

    Runs are found inside position buckets; only the runs that touch a bucket edge, at most
    two per bucket, are linked across buckets.
    """
    keys = list(keys)
    p = F.col(position).cast("bigint")
    rows = df.select(*keys, p.alias("_p")).distinct().withColumn(
        _BUCKET, number_bucket(F.col("_p"), width))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy("_p")
    local = (rows.withColumn("_g", F.col("_p") - F.row_number().over(inside))
             .groupBy(*keys, _BUCKET, "_g")
             .agg(F.min("_p").alias("first"), F.max("_p").alias("last")))
    touches = ((F.col("first") == F.col(_BUCKET) * width)
               | (F.col("last") == F.col(_BUCKET) * width + (width - 1)))
    done = local.where(~touches).select(*keys, "first", "last")
    chain = Window.partitionBy(*keys).orderBy("first")
    edge = (local.where(touches)
            .withColumn("_new", F.coalesce(F.lag("last").over(chain) + 1 != F.col("first"), F.lit(True)))
            .withColumn("_run", F.sum(F.col("_new").cast("int")).over(chain))
            .groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            .select(*keys, "first", "last"))
    return done.unionByName(edge)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, points: dict[str, float],
                    method: str = "linear", accuracy: int = 10_000) -> DataFrame:
    """Exact order statistics per key with count and mean, for groups of any size.

    A mergeable sketch gives each key cut values close to the wanted ranks. The stretches between cuts are
    counted exactly, so it is known, not assumed, in which stretch a rank lies; only those stretches, a few in ten
    thousand of a large group, are ordered. No group is ever sorted or held as a whole, and every size takes this path.
    ``linear`` interpolates between neighbours, ``lower`` takes the value at floor(q*(n-1)).
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("_v")).where(finite(F.col("_v")))
    margin = 2.0 / accuracy
    edges = sorted({min(max(q + side * margin, 0.0), 1.0) for q in points.values() for side in (-1, 1)})
    head = rows.groupBy(*keys).agg(F.count("*").alias("count"), F.avg("_v").alias("mean"),
                                   F.percentile_approx("_v", edges, accuracy).alias("_cuts"))
    wanted = []
    for q in points.values():
        at = (F.col("count") - 1) * F.lit(float(q))
        wanted += [F.floor(at)] + ([F.ceil(at)] if method == "linear" else [])
    head = head.withColumn("_ranks", F.array_distinct(F.array(*wanted)))

    def with_head(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, keys) if keys else left.crossJoin(F.broadcast(right))  # one row

    v = F.col("_v")
    # A stretch holds the values above one cut up to the next.
    placed = with_head(rows, head.select(*keys, "_cuts")).select(*keys, F.size(F.filter("_cuts", lambda c: v > c)).alias("_s"), "_v")
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    stretches = (placed.groupBy(*keys, "_s").agg(F.count("*").alias("_total"))
                 .withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))))
    inside = F.filter("_ranks", lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_total")))
    chosen = (with_head(stretches, head.select(*keys, "_ranks")).withColumn("_here", inside).where(F.size("_here") > 0)
              .select(*keys, "_s", "_start", "_here"))
    counts = placed.join(chosen.select(*keys, "_s"), [*keys, "_s"], "left_semi").groupBy(*keys, "_s", "_v").agg(F.count("*").alias("_n"))
    local = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (counts.join(chosen, [*keys, "_s"])
             .withColumn("_stop", F.col("_start") + F.sum("_n").over(local))
             .withColumn("_rank", F.explode(F.filter("_here", lambda r: (r >= F.col("_stop") - F.col("_n")) & (r < F.col("_stop")))))
             .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")))
    full = with_head(head, found)
    cols = []
    for name, q in points.items():
        at = (F.col("count") - 1) * F.lit(float(q))
        result = F.col("_at")[F.floor(at)]
        if method == "linear":
            upper, t = F.col("_at")[F.ceil(at)], at - F.floor(at)
            step = upper - result
            result = F.when(t >= 0.5, upper - step * (1 - t)).otherwise(result + step * t)
        cols.append(result.alias(name))
    return full.select(*keys, "count", "mean", *cols)
