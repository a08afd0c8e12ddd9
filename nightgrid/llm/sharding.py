"""Contiguous shards of near-equal size, by global prefix sums of bytes.

Everything here is DataFrame work: sizes are summed per partition of the order, partition totals
are summed up, and each row's place among all bytes decides its shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightgrid.session import write_once

#: Partitions of the order over which prefix sums are taken, and rows in a slice of one group.
ORDER_PARTS, GROUP_ROWS = 16_384, 4_096


def _before(value: Column, window) -> Column:
    """Running sum of the earlier rows."""
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def group_prefixes(groups: DataFrame) -> DataFrame:
    """Add _first_byte and _first_row to (_key, _bytes, _rows, _size): what lies before each group in key order.

    The order's partitions are ranges of the leading bits of the key, a digest, so they are even.
    """
    parts = groups.withColumn("_part", _div(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), F.lit((1 << 32) // ORDER_PARTS)))
    over = Window.orderBy("_part")  # one row for each of at most ORDER_PARTS parts
    totals = (parts.groupBy("_part").agg(F.sum("_bytes").alias("_b"), F.sum("_rows").alias("_r"))
              .select("_part", _before(F.col("_b"), over).alias("_b"), _before(F.col("_r"), over).alias("_r")))
    inside = Window.partitionBy("_part").orderBy("_key")
    return (parts.join(F.broadcast(totals), "_part")
            .select("_key", "_bytes", "_rows", "_size", (F.col("_b") + _before(F.col("_bytes"), inside)).alias("_first_byte"),
                    (F.col("_r") + _before(F.col("_rows"), inside)).alias("_first_row")))


def byte_shards(rows: DataFrame, shards: int, key: Column, size: Column, tie: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot`` to rows, cutting their order at equal byte targets.

    Rows are ordered by ``key``, the hex digest of the text, so that equal texts lie side by side, and
    by column ``tie``; rows of one key have one ``size``, at least 1. The byte total T is cut at the
    multiples of T / shards and a row goes where its first byte lies; a group of equal texts no larger
    than the largest row goes as a whole where its first byte lies. Shards so differ from T / shards
    by at most the largest row at either end; larger groups are cut like any other rows. ``slot``
    numbers the rows of a shard from 0 without gaps. T times ``shards`` stays below 2^63. Rows with
    null in ``tie`` come first in their group; equal rows are interchangeable; an empty table gives no rows.
    Columns named shard or slot are replaced; names that begin with an underscore are reserved.

    One group may hold any share of the rows: groups are pre-aggregated, and the position of a row
    in a large group comes from counts over slices of it.
    """
    rows = rows.drop("shard", "slot").withColumns({"_key": key, "_size": size.cast("long")})
    groups = rows.groupBy("_key").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"), F.max("_size").alias("_size"))
    placed = write_once(group_prefixes(groups), "shard-groups")
    total, largest = placed.agg(F.sum("_bytes"), F.max("_size")).first()
    total = F.lit(total or 1).cast("long")
    n = F.lit(shards).cast("long")
    at = lambda byte: _div(byte * n, total).cast("int")
    whole = F.col("_bytes") <= F.lit(largest or 0)
    placed = placed.withColumn("_whole", whole).withColumn("_slices", F.ceil(F.col("_rows") / GROUP_ROWS).cast("int"))

    # Which row begins each shard: every group that reaches into a shard says with which of its rows.
    last = F.when(F.col("_whole"), F.col("_first_byte")).otherwise(F.col("_first_byte") + F.col("_bytes") - F.col("_size"))
    reach = placed.withColumn("shard", F.explode(F.sequence(at(F.col("_first_byte")), at(last))))
    into = F.col("shard") * total - F.col("_first_byte") * n
    step = F.col("_size") * n
    begins = F.when(into > 0, _div(into + step - 1, step)).otherwise(F.lit(0))
    starts = reach.groupBy("shard").agg(F.min(F.col("_first_row") + begins).alias("_start"))

    joined = (rows.drop("_size").join(placed, "_key")
              .withColumn("_slice", F.pmod(F.xxhash64(tie), F.col("_slices")).cast("int")))
    counts = (rows.select("_key", tie).join(placed.where("_slices > 1").select("_key", "_slices"), "_key")
              .groupBy("_key", F.pmod(F.xxhash64(tie), F.col("_slices")).cast("int").alias("_slice")).agg(F.count("*").alias("_n")))
    offsets = counts.select("_key", "_slice", _before(F.col("_n"), Window.partitionBy("_key").orderBy("_slice")).alias("_before"))
    inside = Window.partitionBy("_key", "_slice").orderBy(tie)
    position = F.coalesce("_before", F.lit(0)) + F.row_number().over(inside) - 1
    return (joined.join(offsets, ["_key", "_slice"], "left").withColumn("_pos", position)
            .withColumn("shard", at(F.col("_first_byte") + F.when(F.col("_whole"), F.lit(0)).otherwise(F.col("_pos") * F.col("_size"))))
            .join(F.broadcast(starts), "shard")  # one row a shard
            .withColumn("slot", F.col("_first_row") + F.col("_pos") - F.col("_start"))
            .drop("_key", "_bytes", "_rows", "_size", "_first_byte", "_first_row", "_whole", "_slices", "_slice", "_before", "_pos", "_start"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``byte_shards`` of (doc_id, text): adds size, the UTF-8 bytes of the text (null: none) plus 16, and text_crc32."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.withColumns({"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(text.cast("binary"))})
    return byte_shards(sized, shards, F.md5(text.cast("binary")), F.col("size"))
