"""Best-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.common import END_ID, TOKENIZER, TextEncoder, binary_column, only, slices

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """Encode each whole text of (doc_id, text), append ``end_id`` and cut it at ``capacity``.

    One row per piece: doc_id, piece (from 0), start, length, ids_crc32 and, on request, ids
    (little-endian unsigned integers of 2 or 4 bytes). Only documents longer than ``capacity`` are cut. A null or
    empty text is the end id alone. Repeated rows, and rows without doc_id, are documents of their own. Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        encoder = TextEncoder.shared(tokenizer)
        kind, end = f"<u{encoder.width}", encoder.pack([end_id])
        for batch in slices(batches):
            rows = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(binary_column(batch, "text"))):
                whole = np.frombuffer(ids + end, kind)
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    part = whole[start:start + capacity]
                    for name, value in zip(rows, (doc_id, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes()))):
                        rows[name].append(value)
                    if with_ids:
                        rows["ids"].append(part.tobytes())
            columns = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), pa.array(rows["start"], pa.int64()),
                       pa.array(rows["length"], pa.int64()), pa.array(rows["ids_crc32"], pa.int64())]
            names = list(rows)[:5]
            if with_ids:
                columns.append(pa.array(rows["ids"], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return only(docs, "doc_id", "text").mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


class OpenBins:
    """A fixed number of open sequences, kept in a bitset keyed by free space.

    ``place`` finds the fullest open sequence with room for the piece, the lowest set bit at or
    above its length. Where none has room and all are open, the fullest closes.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to ``capacity`` tokens."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 16_384, partitions: int = 1) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    Pieces are dealt evenly over ``partitions`` tasks, each of which packs its own, longest
    first, and streams: it holds the open sequences only. Every piece is placed once; offsets in
    a sequence are gapless from 0. Each task leaves about one sequence less than full, so
    ``partitions`` should keep tens of thousands of pieces a task. An empty table gives no rows.
    Sequences of different tasks have different ids; equal pieces in a task are interchangeable.
    """
    names = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                [*names, "sequence_id", "offset"])

    # Round robin after Spark's own sort of the rows: even for any key, and the same when a task is run again.
    rest = [c for c in names if c not in ("length", "ids")]
    return (pieces.repartition(max(1, partitions)).sortWithinPartitions(F.col("length").desc(), *[F.col(f"`{c}`") for c in rest])
            .mapInArrow(run, schema))


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                   rows_per_task: int = 50_000, with_ids: bool = False) -> DataFrame:
    """Whole documents packed into sequences: the columns of ``token_pieces``, sequence_id and offset."""
    tasks = -(-docs.count() // rows_per_task)
    return pack(token_pieces(docs, capacity, tokenizer, end_id, with_ids), capacity, partitions=tasks)
