"""Passages of a benchmark inside documents, within a budget of character edits.

An item with an error budget of k is cut into k + 1 pieces. An occurrence with at most k edits
leaves at least one piece untouched, so exact piece hits (one Aho-Corasick pass over a text) point
at every possible place, and Myers' bit-parallel distance settles each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.llm.common import only, slices

#: Characters of a piece at least: an item of n characters has a budget of n // PIECE - 1 edits, but 0 at least.
PIECE = 16
#: Characters of benchmark text that one automaton holds; more items are handled by more passes.
GROUP_CHARS = 4_000_000

MATCH = "doc_id long, item_id long, start long, end long, distance int"


def plain_text(text: str) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join(text.lower().split())


def budget(length: int, piece: int = PIECE) -> int:
    return max(0, length // piece - 1)


def cuts(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


def myers(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the best occurrence of ``pattern`` in ``text``, the first such end.

    An occurrence begins anywhere, or at the start of the text if ``anchored``.
    Bit i of the vertical vectors says whether the distance grows or falls between rows i and i+1
    of the edit matrix; one column is a few operations on whole integers.
    """
    m = len(pattern)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = places.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (full & ~(diagonal | up))
        left = up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 | anchored, left << 1  # row 0 stays zero unless the text must begin here
        up = (left & full) | (full & ~((diagonal | right) & full))
        down = right & diagonal & full
        if score < best:
            best, end = score, j
    return best, end


class PieceIndex:
    """Pieces of a bounded group of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], piece: int = PIECE):
        import ahocorasick

        self.items = [(item_id, p) for item_id, text in items if (p := plain_text(text))]
        self.piece = piece
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            k = budget(len(text), piece)
            if k == 0:  # a short item counts as whole words only
                held.setdefault(f" {text} ", []).append((n, -1))
                continue
            at = cuts(len(text), k + 1)
            for a, b in zip(at, at[1:]):
                held.setdefault(text[a:b], []).append((n, a))
        for text, places in held.items():
            self.automaton.add_word(text, (len(text), places))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of the best occurrence of each item in a text.

        Positions are those of ``plain_text``; among equally good occurrences the one that ends first counts.
        """
        if self.empty:
            return []
        whole = f" {plain_text(text)} "
        windows: dict[int, list[list[int]]] = {}
        for last, (size, places) in self.automaton.iter(whole):
            for n, offset in places:
                length = len(self.items[n][1])
                k = budget(length, self.piece)
                begin = last + 1 - size - offset
                # The spaces put around the text mark word ends for whole items; no edit may be spent on them.
                a, b = max(k > 0, begin - k), min(len(whole) - (k > 0), begin + length + k)
                spans = windows.setdefault(n, [])
                if spans and a <= spans[-1][1] and spans[-1][0] <= b:
                    spans[-1] = [min(a, spans[-1][0]), max(b, spans[-1][1])]
                else:
                    spans.append([a, b])
        found = []
        for n, spans in windows.items():
            item_id, item = self.items[n]
            k = budget(len(item), self.piece)
            best = None
            for a, b in spans:
                distance, end = myers(item, whole[a:b])
                if distance <= k and (best is None or (distance, a + end) < best):
                    best = (distance, a + end)
                    if distance == 0:
                        break
            if best:
                distance, end = best
                _, back = myers(item[::-1], whole[max(k > 0, end - len(item) - k):end][::-1], anchored=True)
                found.append((item_id, end - back - 1, end - 1, distance))
        return sorted(found)


def benchmark_groups(benchmark: DataFrame, group_chars: int = GROUP_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in groups of about ``group_chars`` characters, each fetched when its turn comes."""
    items = only(benchmark, "item_id", "text").where("text is not null")
    groups = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // group_chars) + 1
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()
        yield sorted(((r.item_id, r.text) for r in rows), key=repr)


def leaks(docs: DataFrame, benchmark: DataFrame, piece: int = PIECE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Which benchmark items occur in which documents: doc_id, item_id, start, end, distance.

    One row per document row and item that occurs in it with at most ``length // piece - 1`` edits
    (insertions, deletions, substitutions of characters) after lower-casing and collapsing white
    space; items too short for a budget must occur as they are, as whole words. ``start`` and ``end``
    bound the best occurrence in the text so prepared. Null or empty texts and items match nothing; repeated
    documents and repeated items each have their rows; empty tables give no rows. Each text is read
    whole; a benchmark of any size is handled, ``group_chars`` at a time.
    """
    docs = only(docs, "doc_id", "text")
    found = None
    for items in benchmark_groups(benchmark, group_chars):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(items, piece)
            for batch in slices(batches):
                rows = [(doc_id, *m) for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                        for m in index.matches(text or "")]
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int64(),) * 4 + (pa.int32(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start", "end", "distance"])

        part = docs.mapInArrow(run, MATCH)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, piece: int = PIECE, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item occurs within its budget (``leaks``)."""

    def occurs(items: list[tuple[int, str]]):
        def hit(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = PieceIndex(items, piece)
            for batch in texts:
                yield pd.Series([bool(index.matches(t or "")) for t in batch], dtype=bool)

        return F.pandas_udf(hit, "boolean")

    for items in benchmark_groups(benchmark, group_chars):
        docs = docs.where(~occurs(items)("text"))
    return docs
