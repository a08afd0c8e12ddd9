"""Digests of stored files of any size: streamed checksums, block trees, and ranges checked by their branch.

Files are listed by Spark (no content is opened for that) and read by tasks in pieces of a few MiB,
so neither the size of a file nor the number of files is held anywhere. A whole-file SHA-256 is
sequential by definition: one file is one task's stream. A block tree has no such limit: blocks of a
file are hashed by different tasks, and nodes above them are folded by grouping.

Tree of a file: leaf ``i`` is SHA-256 of ``leaf:`` and the bytes of block ``i``; a node above is SHA-256 of
``node:`` and the comma-joined digests of up to ``fan`` nodes below it; the root is the only node of
its level. Digests are lowercase hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid.session import write_once
from nightgrid.sources.files import open_file

BLOCK, FAN = 8 << 20, 64
#: Bytes that one task hashes, about; pieces in which it reads them.
TASK_BYTES, PIECE = 256 << 20, 4 << 20


def stored_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes) of the files below a folder; their content is not read. Spark's scan leaves out files without bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def _dealt(rows: DataFrame, size: str) -> DataFrame:
    """Rows dealt to tasks by the bytes they stand for; a plain repartition would be merged into one task, as the rows are short."""
    total, count = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    wide = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(count, max(wide, -(-int(total) // TASK_BYTES)), 100_000)))


def _hash_range(handle, at: int, size: int, start: bytes = b"") -> tuple[str, int]:
    """(SHA-256 of ``start`` and the bytes of a range, how many there were)."""
    held, left = hashlib.sha256(start), size
    handle.seek(at)
    while left:
        piece = handle.read(min(PIECE, left))
        if not piece:
            break
        held.update(piece)
        left -= len(piece)
    return held.hexdigest(), size - left


def _hashed(ranges: DataFrame, start: bytes) -> DataFrame:
    """``ranges`` (path, at, size, ...) with the digest of each range, null where the file is gone or shorter."""
    names = ranges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size"))):
                try:
                    with open_file(path) as handle:
                        digest, read = _hash_range(handle, at, size, start) if at <= handle.size() else (None, -1)
                except FileNotFoundError:
                    digest, read = None, -1
                found.append(digest if read == size else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, "digest"])

    return _dealt(ranges, "size").mapInArrow(run, ranges.schema.add("digest", "string"))


def file_digests(files: DataFrame) -> DataFrame:
    """SHA-256 of the bytes of each file of (path, bytes), read as a stream, whatever its size; null if it is gone or shorter."""
    whole = files.select("path", F.lit(0).cast("bigint").alias("at"), F.col("bytes").alias("size"))
    return _hashed(whole, b"").select("path", F.col("size").alias("bytes"), F.col("digest").alias("sha256"))


def _above(level: int, fan: int):
    """Nodes of a level for a file of ``blocks`` blocks."""
    return F.ceil(F.col("blocks") / float(fan ** level))


def _fold(nodes: DataFrame, fan: int) -> DataFrame:
    """The next level: (path, bytes, blocks, level, node, digest) of the parents of ``nodes``; null where one below is null."""
    children = F.array_sort(F.collect_list(F.struct("node", F.coalesce("digest", F.lit("")).alias("digest"))))
    joined = F.concat(F.lit("node:"), F.concat_ws(",", F.transform(children, lambda c: c["digest"])))
    return (nodes.groupBy("path", "bytes", "blocks", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / fan).alias("_up"))
            .agg(F.when(F.count("digest") == F.count("*"), F.sha2(joined, 256)).alias("digest"))
            .select("path", "bytes", "blocks", "level", F.col("_up").alias("node"), "digest"))


def block_tree(files: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """All nodes of the trees of files (path, bytes): path, bytes, blocks, level (0: leaves), node, digest.

    Leaves are written to the shared folder once, so that no level reads the files again.
    """
    files = files.select("path", "bytes").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("bytes") / float(block))))
    leaves = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("node")).withColumn("at", F.col("node") * block)
    leaves = _hashed(leaves.withColumn("size", F.least(F.lit(block).cast("bigint"), F.col("bytes") - F.col("at"))), b"leaf:")
    level = write_once(leaves.select("path", "bytes", "blocks", F.lit(0).alias("level"), "node", "digest"), "block-tree")
    nodes, top, depth = level, files.agg(F.max("blocks")).first()[0] or 1, 0
    while fan ** depth < top:
        level = _fold(level.where(_above(depth, fan) > 1), fan)
        nodes, depth = nodes.unionByName(level), depth + 1
    return nodes


def roots(nodes: DataFrame) -> DataFrame:
    """(path, bytes, digest) of the root of each file's tree."""
    return nodes.groupBy("path", "bytes").agg(F.max_by("digest", "level").alias("digest"))


def check_ranges(nodes: DataFrame, wanted: DataFrame, trusted: DataFrame | None = None, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``wanted`` (path, at, size, ...) with ``intact``: do these bytes still lead to the root of their file?

    Only the blocks that the ranges touch are read. Each branch is built anew from their digests and the stored
    siblings and compared with ``trusted`` (path, digest), by default the stored roots: a changed block, a changed stored node
    on the way and a lost file all show. Ranges that pass the end of the file as it was sealed, empty
    or negative ranges, and files without a tree are not intact. The touched blocks of a file meet in one root, so its
    ranges are judged together. Repeated ranges and other columns stay.
    """
    anchor = (roots(nodes) if trusted is None else trusted).select("path", F.col("digest").alias("_root"))
    files = nodes.where("level = 0 AND node = 0").select("path", "bytes", "blocks")
    inside = (F.col("at") >= 0) & (F.col("size") > 0) & (F.col("at") + F.col("size") <= F.col("bytes"))
    asked = wanted.select("path", "at", "size").distinct().join(files, "path").where(inside)
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    touched = asked.select("path", "bytes", "blocks", F.explode(F.sequence(first, last)).alias("node")).distinct().withColumn("at", F.col("node") * block)
    read = _hashed(touched.withColumn("size", F.least(F.lit(block).cast("bigint"), F.col("bytes") - F.col("at"))), b"leaf:")
    level = write_once(read.select("path", "bytes", "blocks", F.lit(0).alias("level"), "node", "digest"), "checked-blocks")
    results, depth = level.where(_above(0, fan) <= 1), 0
    top = asked.agg(F.max("blocks")).first()[0] or 1
    while fan ** depth < top:
        below = level.where(_above(depth, fan) > 1).withColumn("_up", F.floor(F.col("node") / fan))
        siblings = (nodes.where(F.col("level") == depth).withColumn("_up", F.floor(F.col("node") / fan))
                    .join(below.select("path", "_up").distinct(), ["path", "_up"], "left_semi")
                    .join(below.select("path", "node"), ["path", "node"], "left_anti"))
        level = _fold(below.drop("_up").unionByName(siblings.drop("_up")), fan)
        depth += 1
        results = results.unionByName(level.where((_above(depth, fan) <= 1) & (_above(depth - 1, fan) > 1)))
    judged = results.join(anchor, "path").select("path", (F.col("digest").eqNullSafe(F.col("_root"))).alias("_intact"))
    fits = files.select("path", F.col("bytes").alias("_bytes"))
    ends = F.col("at") + F.col("size") <= F.col("_bytes")
    return (wanted.join(fits, "path", "left").join(judged, "path", "left")
            .withColumn("intact", F.coalesce((F.col("at") >= 0) & (F.col("size") > 0) & ends & F.col("_intact"), F.lit(False))).drop("_bytes", "_intact"))


def group_ranges(files: DataFrame, within: dict[str, tuple] | None) -> DataFrame:
    """Byte ranges (path, at, size) of Parquet files that may hold rows with each named column in its closed interval.

    These are the row groups whose stored bounds meet the intervals, and the footers of their files, or of every file
    only the footer if ``within`` is None; only footers are read, so nothing unchecked is decoded. A footer that cannot
    be read gives a range that no file has (-1).
    """

    def meets(group, places) -> bool:
        for name, (low, high) in within.items():
            stored = group.column(places[name]).statistics if name in places else None
            if stored is not None and stored.has_min_max and (stored.max < low or stored.min > high):
                return False
        return True

    def ranges(path: str) -> list[tuple[int, int]]:
        import pyarrow.parquet as pq

        with open_file(path) as handle:
            try:
                footer = pq.ParquetFile(handle).metadata
            except (pa.ArrowInvalid, OSError):
                return [(-1, 0)]
            length = footer.serialized_size + 8
            end = handle.size() - length
        places = {footer.schema.column(c).path: c for c in range(footer.num_columns)}
        first = lambda chunk: chunk.dictionary_page_offset if chunk.has_dictionary_page else chunk.data_page_offset
        groups = [footer.row_group(i) for i in range(footer.num_row_groups)]
        # Row groups lie one behind the other: each reaches to where the next begins.
        edges = [*(min(first(group.column(c)) for c in range(group.num_columns)) for group in groups), end]
        if within is None:
            return [(end, length)]
        chosen = [(at, stop - at) for group, at, stop in zip(groups, edges, edges[1:]) if meets(group, places)]
        return [*chosen, (end, length)] if chosen else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, *r) for path in batch.column("path").to_pylist() for r in ranges(path)]
            paths, at, size = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())], names=["path", "at", "size"])

    dealt = _dealt(files.select("path", F.lit(1 << 20).alias("size")), "size").select("path")
    return dealt.mapInArrow(run, "path string, at bigint, size bigint")
