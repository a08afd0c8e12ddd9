"""Near-copies by SimHash fingerprints and covering locality-sensitive hashing.

Each of the 2^(r+1) - 1 tables of the covering family masks the fingerprint: bit position i holds
a non-zero vector m(i) of r+1 bits, and table v keeps the positions where m(i) and v have odd
overlap. At most r differing positions span at most r dimensions, so some non-zero v is
orthogonal to all of them: in that table both fingerprints have the same key. Every pair within
the radius is found, by construction and not by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.common import binary_column, only, slices
from nightgrid.session import write_once

RADIUS = 3
#: Fingerprints of one bucket compared at a time; larger buckets are cut into blocks of this size, pair by pair.
BLOCK = 2_048


def cover_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering family's masks, as unsigned integers."""
    vectors = (1 << (radius + 1)) - 1
    at = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (at[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns and fp of each row; fp is the fingerprint of ``text`` as a signed 64-bit integer.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are ``shingle`` words
    joined by a space, repeats included; a text of fewer words is one shingle, a text of none (or
    null) has fingerprint zero. A bit is set if it is set in over half the shingles' XXH64. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from xxhash import xxh64_intdigest

        def fingerprint(text: bytes | None) -> int:
            words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
            if not words:
                return 0
            joined = b" ".join(words)
            stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            begins = np.concatenate(([0], stops[:-1] + 1))
            span = min(shingle, len(words)) - 1
            hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins.tolist(), stops[span:].tolist())),
                                 np.uint64, len(words) - span)
            ones = np.zeros(64, np.int64)
            for at in range(0, len(hashes), 65_536):
                ones += np.unpackbits(hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])

        for batch in slices(batches):
            found = pa.array([fingerprint(t) for t in binary_column(batch, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], found], [*keys, "fp"])

    given = only(docs, *keys, "text")
    kinds = dict(given.dtypes)
    return given.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "fp long"]))


def close_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b), a < b, between distinct values of ``fp`` at most ``radius`` bits apart.

    Not every such pair comes out, but enough to join all of them: of each bucket, or pair of
    blocks of a large bucket, only links that join parts not yet joined there. A bucket with more
    than ``block`` fingerprints is cut into blocks by hash and every pair of blocks is compared in
    a task of its own, so no task holds more than two blocks and nothing is dropped.
    """
    masks = F.array(*[F.lit(signed(m)) for m in cover_masks(radius)])
    keyed = fps.select("fp", F.posexplode(masks).alias("table", "mask")).select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    crowded = (keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
               .select("table", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = (keyed.join(crowded, ["table", "key"]).withColumn("mine", mine).withColumn("other", other)
             .groupBy("table", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
             .agg(F.collect_list(F.struct("fp", "mine")).alias("members")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def forest(same: bool, values, side) -> Iterator[tuple[int, int]]:
            """Links of a spanning forest, breadth first: whoever is reached leaves the unseen."""
            unseen = [np.unique(values), None] if same else [np.unique(values[~side]), np.unique(values[side])]
            while len(unseen[0]):
                queue, unseen[0] = [(0, unseen[0][0])], unseen[0][1:]
                for mine, a in queue:  # grows while it is read
                    across = mine if same else 1 - mine
                    near = np.bitwise_count((unseen[across] ^ a).view(np.uint64)) <= radius  # of signed numbers it counts the magnitude
                    if near.any():
                        reached, unseen[across] = unseen[across][near], unseen[across][~near]
                        for b in reached:
                            queue.append((across, b))
                            yield (int(a), int(b)) if a < b else (int(b), int(a))

        for batch in batches:
            out = set()
            for low, high, members in zip(*[batch.column(n).to_pylist() for n in ("low", "high")], batch.column("members")):
                values = members.values.field("fp").to_numpy(zero_copy_only=False)
                side = members.values.field("mine").to_numpy(zero_copy_only=False) != low
                out.update(forest(low == high, values, side))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return pairs.select("low", "high", "members").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of links (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps: each node's neighbours are linked to the
    smallest of them, until every link runs straight to its smallest node. Each round is
    written to the shared folder, so a lost executor costs one round.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = write_once(edges.distinct(), "links")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_once(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u <> v").distinct())
        small = write_once(small, "links")
        # Settled: no node is both a larger and a smaller end, and each has one smaller end.
        ups = small.groupBy("u").agg(F.count("*").alias("n"))
        chained = small.select(F.col("v").alias("u")).join(ups.select("u"), "u", "left_semi")
        edges = small
        if ups.where("n > 1").isEmpty() and chained.isEmpty():
            break
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_copies(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, seed: int = 42, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of (doc_id, text): the key columns, fingerprint (16 hex digits), component (a fingerprint) and component_id.

    Documents are linked where their fingerprints differ in at most ``radius`` bits, empty ones
    (fingerprint zero) like any other; component_id is the smallest doc_id reachable over links, itself
    included (null if none reachable has one). Repeated rows stay. An empty table gives no rows.

    Equal fingerprints are merged before anything is compared, so copies cost nothing further.
    """
    marked = write_once(fingerprints(docs, shingle, seed, keys), "fingerprints")
    groups = write_once(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "fingerprint-groups")
    joined = components(close_links(groups.select("fp"), radius))
    part = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = part.groupBy("component").agg(F.min("smallest").alias("component_id"))
    part = part.join(roots, "component").select("fp", "component", "component_id")
    return marked.join(part, "fp").select(*keys, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, without near-copies: one row of each component stays.

    It is the one with the smallest doc_id (rows without one come last; then by a hash of the text); of rows equal in
    doc_id and text one stays. Column _key is reserved. Only keys are compared and counted; texts
    move once, to meet the keys that stay.
    """
    keyed = docs.withColumn("_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string")))
    marked = near_copies(keyed, shingle, radius, keys=("doc_id", "_key"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first")
    stay = marked.groupBy("component").agg(first).select("first._key")
    return keyed.join(stay, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")
