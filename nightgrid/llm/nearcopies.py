"""Near-copies by exact Jaccard similarity of word shingles; SimHash, leading hashes and parity sketches find and sift the pairs.

Copies that are nearly identical lie within three bits of each other: the covering tables find
them and a spanning forest of each bucket joins them, so a large group costs no more than its size.
Pairs down to the similarity itself lie up to a third of the bits apart, for which a covering family would need
2^(r+1) - 1 tables. They meet under shingles instead. Rounds under the few smallest hashes of each set come first: nearly all
similar pairs share one of four, and of each meeting only a spanning forest of sets whose sketches lie close is verified.
So the members of a group are joined by about as many links as it has members. What is left is found for certain: in any one
order of all shingles, two sets of similarity t share one of the first n - ceil(t n) + 1 of each. The order here is by how often a shingle
occurs in a sample of the documents, rarest first, so that what many documents share brings few of them together; the sample decides the order,
not what is found. Every such pair of parts not yet joined is sifted by length and by a bound on the difference of the sets that loses
none. Whatever the source, only pairs whose exact similarity reaches t are links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightgrid.llm import simhash
from nightgrid.llm.common import binary_column, only, slices
from nightgrid.session import discard, sent, write_once

SHINGLE = 5
#: Similarity of a link, as a fraction of whole numbers so that equality is exact.
SIMILARITY = (4, 5)
#: Bits of the smallest parity sketch. Each element of a set turns a bit over, so two sketches differ in no more bits than the sets in elements.
SKETCH = 1_024
#: Rounds before the complete one: smallest hashes of each set that count.
ROUNDS = (4,)
#: Documents, about, whose shingles are counted for the order, and the number of shingles that come last in it; all others go by hash.
ORDER_DOCS, ORDER_KEPT = 10_000, 100_000
#: Pairs that a task holds before it hands them on.
HELD_PAIRS = 50_000


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE, seed: int = 42):
    """Hashes of the distinct shingles in ascending order; A-Z are lower-cased, a text of fewer words is one shingle."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], stops[:-1] + 1))
    span = min(shingle, len(words)) - 1
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(begins.tolist(), stops[span:].tolist())),
                                 np.uint64, len(words) - span))


def sign_bits(hashes) -> int:
    """SimHash of a set of hashes, as a signed 64-bit integer."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at:at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _mixed(hashes):
    """A second hash of each hash (the finaliser of splitmix64)."""
    import numpy as np

    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parity_sketch(hashes) -> bytes:
    """Bits, each set if an odd number of the hashes falls on it: SKETCH doubled until there are two for each hash."""
    import numpy as np

    bits = max(SKETCH, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else SKETCH
    falls = np.bincount((_mixed(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((falls & 1).astype(bool)).tobytes()


def folded(sketch):
    """The sketch of half as many bits (arrays of words, along the last axis)."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def least_difference(x: bytes, y: bytes) -> int:
    """A number of elements by which the sets of two sketches differ at least."""
    import numpy as np

    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(y) > len(x):
        y = folded(y)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _sifted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of ids whose whole sketches allow them to be similar enough."""
    up, down = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes = batch.column("sizes").to_pylist()
            near = [(down + up) * least_difference(x, y) <= (down - up) * n
                    for x, y, n in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    x, y = (nodes.select(F.col("id").alias(i), F.col("wide").alias(to), F.col("n").alias(f"n{to}")) for i, to in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("sizes")).mapInArrow(run, "a long, b long")


def _frequent(keyed: DataFrame):
    """Shingle hashes, ascending, that occur in three or more of about ORDER_DOCS documents, and in how many; the most frequent ones."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [shingle_hashes(t) for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view("i8"), pa.int64())], ["key"])

    given = keyed.select("_key", "text")
    share = -(-given.count() // ORDER_DOCS)
    if share > 1:
        given = given.where(F.pmod(F.xxhash64("_key"), F.lit(share)) == 0)
    counted = given.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    kept = counted.orderBy(F.desc("n"), "key").limit(ORDER_KEPT).toPandas()
    keys = kept["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], kept["n"].to_numpy(np.int64)[order]


def _marks(docs: DataFrame, frequent) -> DataFrame:
    """Key columns of each row with its set's digest, size, fingerprint, sketch (short and whole), smallest hashes and, rarest first, leading hashes."""
    up, down = SIMILARITY
    common, often = frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        import numpy as np

        def rarest_first(hashes):
            if not len(common) or not len(hashes):
                return hashes
            at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
            return hashes[np.argsort(np.where(common[at] == hashes, often[at], 0), kind="stable")]

        for batch in slices(batches):
            digests, sizes, bits, odd, wide, least, leads = [], [], [], [], [], [], []
            for text in binary_column(batch, "text"):
                hashes = shingle_hashes(text)
                n = len(hashes)
                digests.append(blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest())
                sizes.append(n)
                bits.append(sign_bits(hashes))
                wide.append(parity_sketch(hashes))
                narrow = np.frombuffer(wide[-1], np.uint64)
                while 64 * len(narrow) > SKETCH:
                    narrow = folded(narrow)
                odd.append(narrow.tobytes())
                least.append(hashes[:max(ROUNDS)].view("i8"))
                leads.append(rarest_first(hashes)[:n + up * -n // down + 1 if n else 0].view("i8"))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_key"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.int64()),
                 pa.array(odd, pa.binary()), pa.array(wide, pa.binary()), pa.array(least, longs), pa.array(leads, longs)],
                ["doc_id", "_key", "digest", "n", "f", "odd", "wide", "least", "lead"])

    given = only(docs, "doc_id", "_key", "text")
    return given.mapInArrow(
        run, f"doc_id {dict(given.dtypes)['doc_id']}, _key string, digest binary, n long, f long, odd binary, wide binary, least array<long>, lead array<long>")


def _verified(pairs: DataFrame, nodes: DataFrame, keyed: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of ids whose shingle sets are similar enough; texts of other documents do not move."""
    pairs = write_once(pairs, "near-pairs")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = write_once(nodes.select("id", "_key").join(ends, "id", "left_semi"), "near-ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_hashes(t).view("i8") for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])

    texts = keyed.select("_key", "text").join(sent(wanted), "_key").select("id", "text")
    # Repeated rows give the same set again; one of each is joined.
    sets = texts.mapInArrow(run, "id long, hashes array<long>").groupBy("id").agg(F.first("hashes").alias("hashes"))
    sets = write_once(sets, "near-sets")
    up, down = SIMILARITY
    a, b = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # both / (x + y - both) >= up / down
    links = write_once(pairs.join(a, "a").join(b, "b").where((up + down) * both >= up * (F.size("x") + F.size("y"))).select("a", "b"), "near-links")
    discard(pairs, wanted, sets)
    return links


def _apart(nodes: DataFrame, block: int, leads: int | None = None) -> DataFrame:
    """Pairs (a, b) of ids of different parts that share a leading hash and may be similar enough.

    With ``leads`` only that many smallest hashes count, and of each meeting a spanning forest of its parts comes out; without,
    every pair, so none that is similar gets lost.
    """
    up, down = SIMILARITY
    lead = F.col("lead") if leads is None else F.slice("least", 1, leads)
    # Keys, ids and parts move once; all else is looked up for those that meet another part.
    key = Window.partitionBy("key")
    met = (nodes.select(F.explode(lead).alias("key"), "id", "part")
           .select("key", "id", F.min("part").over(key).alias("low"), F.max("part").over(key).alias("high"), F.count("*").over(key).alias("rows"))
           .where("low <> high").select("key", "id", F.ceil(F.col("rows") / block).cast("int").alias("blocks")))
    met = write_once(met, "near-meets")
    about = nodes.select("id", "part", "n", "odd").join(met.select("id").distinct(), "id", "left_semi")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # For a forest each block of a large meeting is compared with the first one, which goes to all; otherwise each with each.
    other = F.explode(every if leads is None else F.when(F.col("mine") == 0, every).otherwise(F.array(F.lit(0))))
    cells = (met.join(about, "id").withColumn("mine", mine).withColumn("other", other)
             .groupBy("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
             .agg(F.collect_list(F.struct("id", "part", "n", "mine", "odd")).alias("members")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def pairs_of(low, high, members) -> Iterator[tuple[int, int]]:
            ids, part, n, side = (members.values.field(c).to_numpy(zero_copy_only=False) for c in ("id", "part", "n", "mine"))
            odd = np.frombuffer(b"".join(members.values.field("odd").to_pylist()), np.uint64).reshape(len(ids), -1)

            def close(i, js):
                js = js[(part[js] != part[i]) & (down * np.minimum(n[js], n[i]) >= up * np.maximum(n[js], n[i]))]
                # Of similar sets no more than (down - up) / (down + up) of all elements lie in one only; the sketches' bits are a lower bound of that.
                return js[(down + up) * np.bitwise_count(odd[js] ^ odd[i]).sum(axis=1, dtype=np.int64) <= (down - up) * (n[js] + n[i])]

            if leads is None:
                left = np.arange(len(ids)) if low == high else np.flatnonzero(side == low)
                right = left if low == high else np.flatnonzero(side == high)
                for at, i in enumerate(left):
                    for j in close(i, right[at + 1:] if low == high else right):
                        yield i, j
                return
            # Breadth first over parts: whichever member is reached brings its whole part along.
            unseen = np.arange(len(ids))
            while len(unseen):
                first = part[unseen] == part[unseen[0]]
                queue, unseen = unseen[first].tolist(), unseen[~first]
                for i in queue:  # grows while it is read
                    if not len(unseen):
                        break
                    found = close(i, unseen)
                    if len(found):
                        reached, at = np.unique(part[found], return_index=True)
                        for j in found[at]:
                            yield i, j
                        come = np.isin(part[unseen], reached)
                        queue += unseen[come].tolist()
                        unseen = unseen[~come]

        def handed(out: set) -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
            out.clear()
            return found

        out: set = set()
        for batch in slices(batches, 64):
            ids = batch.column("members")
            for low, high, members in zip(*[batch.column(c).to_pylist() for c in ("low", "high")], ids):
                named = members.values.field("id").to_numpy(zero_copy_only=False)
                for i, j in pairs_of(low, high, members):
                    out.add((int(min(named[i], named[j])), int(max(named[i], named[j]))))
                    if len(out) >= HELD_PAIRS:
                        yield handed(out)
        yield handed(out)

    # The cells hold short sketches, as a set comes to many; the few pairs that they leave meet the whole ones.
    return _sifted(cells.select("low", "high", "members").mapInArrow(run, "a long, b long").distinct(), nodes)


def keep_one(docs: DataFrame, block: int = simhash.BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, without near-copies: one row of each component stays.

    Documents are linked where their sets of five-word shingles have a Jaccard similarity of 0.8 or more. The row
    that stays has the smallest doc_id (rows without one come last; then by a hash of the text); of rows equal in
    doc_id and text one stays. Texts without words count as equal. Columns _key and twice are reserved.
    """
    keyed = docs.withColumn("_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string")))
    marked = write_once(_marks(keyed, _frequent(keyed)), "near-marks")
    # Written once: an id must not change between reads.
    nodes = write_once(marked.groupBy("digest").agg(F.min("_key").alias("_key"), *[F.first(c).alias(c) for c in ("n", "f", "odd", "wide", "least", "lead")])
                       .withColumn("id", F.monotonically_increasing_id()), "near-nodes")

    heads = write_once(nodes.groupBy("f").agg(F.min("id").alias("head")), "near-heads")
    same = nodes.select("id", "f").join(heads, "f").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    bits = simhash.close_links(heads.select(F.col("f").alias("fp")))
    bits = (bits.join(heads.select(F.col("f").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("f").alias("b"), F.col("head").alias("y")), "b")
            .select(F.col("x").alias("a"), F.col("y").alias("b")))
    close = _verified(same.unionByName(bits), nodes, keyed)

    def parts(links: DataFrame) -> DataFrame:
        joined = simhash.components(links)
        return joined.select(F.col("node").alias("id"), F.col("component").alias("part"))

    for leads in (*ROUNDS, None):
        settled = nodes.join(parts(close), "id", "left").withColumn("part", F.coalesce("part", "id"))
        close = close.unionByName(_verified(_apart(settled, block, leads), nodes, keyed))
    done = nodes.select("id", "digest").join(parts(close), "id", "left").select("digest", F.coalesce("part", "id").alias("part"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first")
    # Each digest's best row first, so that a large group of equal texts is not one task.
    best = marked.groupBy("digest").agg(first)
    stay = write_once(best.join(done, "digest").groupBy("part").agg(F.min("first").alias("first")).select("first._key"), "near-kept")
    rows = marked.groupBy("_key").agg(F.count("*").alias("rows")).join(stay.withColumn("stays", F.lit(True)), "_key", "left")
    # Most rows stay, once: only the keys of others are looked up, so texts move only where these are too many to send.
    odd = write_once(rows.where("stays is null or rows > 1").select("_key", F.col("stays").isNotNull().alias("twice")), "near-odd")
    met = keyed.join(sent(odd), "_key", "left")
    discard(marked, nodes, heads, stay)
    again = met.where("twice").dropDuplicates(["_key"])
    return met.where("twice is null").unionByName(again).drop("_key", "twice")
