"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are integers. A block of the index keeps, for each dimension, posting segments: the rows
whose component has one quantised impact, from the largest magnitude down. Queries
add segment after segment, in descending impact, to their accumulators. What is not yet added
of a row is bounded by the length of its remainder (Cauchy-Schwarz), so after each impact level every query knows
which rows can still reach its k best. It stops when few are left and scores those exactly; no row is
ever given up without such a proof.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an index block and queries that meet it in one task; both bound its memory, not the result.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 512
#: Width of an impact level, and the share of (query, row) pairs still possible below which exact scoring pays.
LEVEL, RESCORE_SHARE = 6, 0.03


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as long; null unless every component is a finite number."""
    x = lambda c: c.cast("double")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(x(c)) != float("inf")))
    return F.when(fine, F.transform(vector, lambda c: F.floor(x(c) * factor)))


class ImpactBlock:
    """Posting segments of a block of integer vectors, by descending quantised impact."""

    def __init__(self, vectors, level: int = LEVEL):
        import numpy as np

        self.vectors = vectors.astype(np.int64)
        magnitude = np.abs(self.vectors)
        impact = magnitude // level
        rows, dims = np.nonzero(impact)
        sign = np.sign(self.vectors[rows, dims])
        size = impact[rows, dims]
        order = np.lexsort((rows, sign, dims, -size))
        rows, dims, sign, size = rows[order], dims[order], sign[order], size[order]
        edge = np.flatnonzero((np.diff(size) != 0) | (np.diff(dims) != 0) | (np.diff(sign) != 0)) + 1 if len(rows) else np.zeros(0, np.int64)
        starts = np.concatenate(([0], edge)) if len(rows) else edge
        self.levels: list[tuple[list, object]] = []
        left = self.vectors.astype(np.float64)
        self.first = self._lengths(left)
        segments = [(int(size[a]), int(dims[a]), int(sign[a] * (size[a] * level + level // 2)), rows[a:b])
                    for a, b in zip(starts, [*starts[1:], len(rows)])]
        at = 0
        while at < len(segments):
            stop = at
            while stop < len(segments) and segments[stop][0] == segments[at][0]:
                _, dim, value, members = segments[stop]
                left[members, dim] -= value
                stop += 1
            self.levels.append(([s[1:] for s in segments[at:stop]], self._lengths(left)))
            at = stop

    @staticmethod
    def _lengths(left):
        """Lengths of the remainders, rounded up."""
        import numpy as np

        return np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9) + 1e-6

    def search(self, queries, k: int, own_row, share: float = RESCORE_SHARE):
        """(query, row, score) of every row that may be among the k best of each query, and surely of those that are.

        ``own_row(q)`` gives the rows that do not count for query q.
        """
        import numpy as np

        n, count = len(self.vectors), len(queries)
        weights = queries.astype(np.float64)
        length = np.sqrt((weights * weights).sum(axis=1)) * (1 + 1e-9) + 1e-6
        sums = np.zeros((n, count))
        barred = [(row, q) for q in range(count) for row in own_row(q)]
        own = tuple(np.array(x, dtype=np.int64) for x in zip(*barred)) if barred else (np.zeros(0, np.int64),) * 2
        kth = min(k, n) - 1

        def possible(slack):
            """Pairs whose upper bound reaches the k-th best lower bound of the query."""
            low = sums - slack[:, None] * length
            low[own] = -np.inf
            floor = np.partition(low, n - 1 - kth, axis=0)[n - 1 - kth] if n > kth else np.full(count, -np.inf)
            high = sums + slack[:, None] * length
            high[own] = -np.inf
            return (high >= floor) & (high > -np.inf)

        slack, keep = self.first, None
        for number, (segments, after) in enumerate(self.levels):
            for dim, value, members in segments:
                sums[members] += value * weights[:, dim]
            slack = after
            # A level's remainders only pay a look when they have become short.
            if number % 3 == 2 or number == len(self.levels) - 1:
                keep = possible(slack)
                if keep.sum() <= share * keep.size:
                    break
        if keep is None:
            keep = possible(slack)
        rows, found = np.nonzero(keep)
        score = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), 65_536):
            part = slice(at, at + 65_536)
            score[part] = np.einsum("ij,ij->i", self.vectors[rows[part]], queries[found[part]])
        return found, rows, score


def top_k(queries: DataFrame, index: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k best rows of ``index`` for every row of ``queries``: query_id, rank (from 1), vec_id, score.

    Both have (vec_id long, codes array<long>); the score is the inner product, higher is better, ties go to the smaller
    vec_id. A row does not count for a query of its own vec_id; fewer than k others give all
    of them. Rows with a null vec_id or null codes take no part; vectors meet those of the same number of components only.
    Repeated rows of the index are candidates each; equal query rows count once, and different vectors
    under one query id give k rows each. Components stay below 2^28. Empty tables give no rows.

    Every pair of an index block and a query block is one task's work; only each block's k best per query leave it.
    """
    queries = queries.where("vec_id is not null and codes is not null").select("vec_id", "codes").distinct()
    index = index.where("vec_id is not null and codes is not null").select("vec_id", "codes")
    rows, asked = index.count(), queries.count()
    grid = -(-rows // block_rows) or 1, -(-asked // block_queries) or 1
    place = lambda salt, n: F.pmod(F.xxhash64("vec_id", "codes", F.lit(salt)), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("dims", F.size("codes")).withColumn("i", place(1, grid[0])).withColumn("q", spread(grid[1]))
    right = queries.withColumn("dims", F.size("codes")).withColumn("q", place(2, grid[1])).withColumn("i", spread(grid[0]))

    def meet(key: tuple, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = ["query_id", "query_mark", "vec_id", "score"]
        if mine.empty or theirs.empty:
            return pd.DataFrame({n: pd.Series(dtype="int64") for n in names})
        ids, asked_ids = mine["vec_id"].to_numpy(np.int64), theirs["vec_id"].to_numpy(np.int64)
        vectors = np.array(mine["codes"].tolist(), dtype=np.int64).reshape(len(ids), -1)
        wanted = np.array(theirs["codes"].tolist(), dtype=np.int64).reshape(len(asked_ids), -1)
        where: dict[int, list[int]] = {}
        for row, vec_id in enumerate(ids.tolist()):
            where.setdefault(vec_id, []).append(row)
        index_block, parts = ImpactBlock(vectors), []
        for at in range(0, len(asked_ids), 128):
            mine_ids = asked_ids[at:at + 128].tolist()
            found, at_rows, score = index_block.search(wanted[at:at + 128], k, lambda q: where.get(mine_ids[q], ()))  # noqa: B023
            order = np.lexsort((ids[at_rows], -score, found))
            found, at_rows, score = found[order], at_rows[order], score[order]
            first = np.searchsorted(found, found)
            best = np.arange(len(found)) - first < k
            parts.append(pd.DataFrame({"query_id": asked_ids[at + found[best]], "query_mark": theirs["mark"].to_numpy(np.int64)[at + found[best]],
                                       "vec_id": ids[at_rows[best]], "score": score[best]}))
        return pd.concat(parts, ignore_index=True)

    met = (left.groupBy("i", "q", "dims").cogroup(right.withColumn("mark", F.xxhash64("codes")).groupBy("i", "q", "dims"))
           .applyInPandas(meet, "query_id long, query_mark long, vec_id long, score long"))
    # Ranks over at most k rows of each block.
    best = Window.partitionBy("query_id", "query_mark").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(vectors: DataFrame, step: int = 50, k: int = 5) -> DataFrame:
    """``top_k`` with the rows of (vec_id, embedding) whose vec_id is divisible by ``step`` as queries, against all rows."""
    coded = vectors.select("vec_id", scaled(F.col("embedding")).alias("codes"))
    return top_k(coded.where(F.col("vec_id") % step == 0), coded, k)
