"""Token ids in binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents, one after the other, and two Elias-Fano
sequences: where each document begins (with the end as last entry) and the document ids. An
Elias-Fano sequence of n values below u takes about 2 + log2(u / n) bits a value; one 32-bit
sample for every 512 values lets ``select`` jump to any of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightgrid.llm.common import END_ID, TOKENIZER, TextEncoder, binary_column, only, open_store, shared_folder, slices
from nightgrid.session import write_once

MAGIC = b"NGIDS001"
HEAD = "<8sIIQQqQ"  # magic, id width, reserved, documents, ids, smallest doc_id, documents without doc_id
PART = "<QQIQQ"  # values, largest, low bits, bytes of low part, bytes of high part
SAMPLE = 512


class EliasFano:
    """Non-decreasing unsigned integers: low bits packed, high bits in unary, sampled select."""

    def __init__(self, n: int, top: int, low_bits: int, low, high, samples):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def build(cls, values) -> EliasFano:
        import numpy as np

        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shift = np.uint64(low_bits)
        ones = (v >> shift).astype(np.int64) + np.arange(n)  # a set bit for each value, after one clear bit per step of the high part
        bits = np.zeros((int(ones[-1]) // 8 + 1) * 8 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        low = b""
        if low_bits:
            places, parts = np.arange(low_bits, dtype=np.uint64), []
            for at in range(0, n, 65_536):
                parts.append(np.packbits(((v[at:at + 65_536, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
            low = np.concatenate(parts).tobytes()
        return cls(n, top, low_bits, np.frombuffer(low, np.uint8), np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return (struct.pack(PART, self.n, self.top, self.low_bits, len(self.low), len(self.high))
                + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes())

    @classmethod
    def read(cls, buffer, at: int) -> tuple[EliasFano, int]:
        """The sequence at byte ``at`` of a buffer, and the byte after it."""
        import numpy as np

        n, top, low_bits, low_size, high_size = struct.unpack_from(PART, buffer, at)
        at += struct.calcsize(PART)
        low = np.frombuffer(buffer, np.uint8, low_size, at)
        high = np.frombuffer(buffer, np.uint8, high_size, at + low_size)
        count = -(-n // SAMPLE)
        samples = np.frombuffer(buffer, "<u4", count, at + low_size + high_size)
        return cls(n, top, low_bits, low, high, samples), at + low_size + high_size + 4 * count

    def block(self, k: int):
        """The values k * SAMPLE up to the next sample, reading no other part."""
        import numpy as np

        first = k * SAMPLE
        count = min(SAMPLE, self.n - first)
        begin = int(self.samples[k])
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[begin // 8:stop // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits[begin % 8:])[:count] + begin
        value = (ones - first - np.arange(count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = first * self.low_bits  # a multiple of 8, as SAMPLE is
            size = -(-count * self.low_bits // 8)
            raw = np.unpackbits(self.low[at // 8:at // 8 + size], bitorder="little")[:count * self.low_bits].reshape(count, self.low_bits)
            value |= (raw.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return value

    def select(self, i: int) -> int:
        """The i-th value (from 0)."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // SAMPLE)[i % SAMPLE])

    def blocks(self) -> Iterator:
        for k in range(len(self.samples)):
            yield self.block(k)


class TokenFile:
    """One file: ids of documents in ascending doc_id order (those without doc_id first)."""

    def __init__(self, buffer):
        import numpy as np

        magic, self.width, _, self.n_docs, self.n_ids, self.base, self.n_null = struct.unpack_from(HEAD, buffer, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ids = np.frombuffer(buffer, f"<u{self.width}", self.n_ids, struct.calcsize(HEAD))
        self.bounds, at = EliasFano.read(buffer, struct.calcsize(HEAD) + self.width * self.n_ids)
        self.keys, _ = EliasFano.read(buffer, at)

    @staticmethod
    def to_bytes(doc_ids: list, parts: list[bytes], width: int) -> bytes:
        import numpy as np

        known = [d for d in doc_ids if d is not None]
        base = known[0] if known else 0
        ends = np.cumsum([0, *(len(p) // width for p in parts)], dtype=np.uint64)
        keys = np.array([d - base for d in known], dtype=np.uint64)
        head = struct.pack(HEAD, MAGIC, width, 0, len(doc_ids), int(ends[-1]), base, len(doc_ids) - len(known))
        return b"".join([head, *parts, EliasFano.build(ends).to_bytes(), EliasFano.build(keys).to_bytes()])

    def document(self, i: int):
        """Ids of the i-th document."""
        return self.ids[self.bounds.select(i):self.bounds.select(i + 1)]

    def documents(self) -> Iterator[tuple]:
        """(doc_id, first id in this file, ids) of every document, decoded a block of boundaries at a time."""
        keys = (int(k) + self.base for block in self.keys.blocks() for k in block)
        start = None
        i = -1
        for block in self.bounds.blocks():
            for bound in block.tolist():
                if start is not None:
                    yield (None if i < self.n_null else next(keys)), start, self.ids[start:bound]
                start, i = bound, i + 1


#: Tasks that read files back at most; of fewer files each gets one.
READ_TASKS = 10_000


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str = TOKENIZER, end_id: int | None = END_ID,
                      ids_per_file: int = 4_000_000) -> DataFrame:
    """Encode every whole text of (doc_id, text) and write the ids in ascending doc_id order.

    Returns the manifest, itself written to the shared folder: part, file, path, n_docs, n_ids, start
    (ids in all files before). A file takes documents until it has ``ids_per_file`` ids. Task
    attempts write under names of their own and only files of the attempts that succeeded come
    into the manifest, so a lost executor leaves no half-written or doubled file behind it.
    A null text is empty; rows without doc_id come first; repeated doc_ids stay, ordered by text within a task and by a hash of it across tasks.
    An empty table gives an empty manifest. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, root = open_store(folder)
        encoder = TextEncoder.shared(tokenizer)
        end = encoder.pack([end_id]) if end_id is not None else b""
        made, doc_ids, parts, held = 0, [], [], 0

        def close() -> pa.RecordBatch:
            path = f"{root}/part-{part:06d}-{made:05d}-{attempt}.ids"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(path) as out:
                out.write(TokenFile.to_bytes(doc_ids, parts, encoder.width))
            row = {"part": part, "file": made, "path": path, "n_docs": len(doc_ids), "n_ids": held // encoder.width}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(binary_column(batch, "text"))):
                doc_ids.append(doc_id)
                parts.append(ids + end)
                held += len(ids) + len(end)
                if held >= ids_per_file * encoder.width:
                    yield close()
                    made, doc_ids, parts, held = made + 1, [], [], 0
        if doc_ids:
            yield close()

    # The text itself is the last sort key: a doc_id that many rows share is still dealt to many tasks.
    ordered = only(docs, "doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    written = write_once(ordered.mapInArrow(run, "part int, file int, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per writing task takes part in the global running sum.
    parts = (written.groupBy("part").agg(F.sum("n_ids").alias("_n"))
             .select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    return (written.join(parts, "part")
            .withColumn("start", F.col("_base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("_base")
            .withColumn("path", F.concat(F.lit(_scheme(folder)), "path")))


def _scheme(folder: str) -> str:
    """What turns a path of the store back into a URI."""
    root = open_store(folder)[1]
    return folder[: folder.index(root)] if root in folder else ""


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of written files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and ids.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers;
    ``ids`` (array<int>) is left out on request.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    kinds = pa.schema(kinds + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["path"])
                with store.open_input_file(path) as f:
                    found = TokenFile(f.read())
                rows: list[list] = [[] for _ in kinds]
                for doc_id, start, ids in found.documents():
                    values = [doc_id, row["start"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())]
                    for to, value in zip(rows, values + ([ids.astype("int32")] if with_ids else [])):
                        to.append(value)
                    if len(rows[0]) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(r, k.type) for r, k in zip(rows, kinds)], schema=kinds)
                        rows = [[] for _ in kinds]
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(r, k.type) for r, k in zip(rows, kinds)], schema=kinds)

    # A stated number of tasks: a table of short rows would otherwise be merged into one that reads every file.
    tasks = max(1, min(manifest.count(), READ_TASKS))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(run, schema)
