"""Whitening of embeddings: the covariance is fitted on distinct vectors with their counts, each is whitened once.

Vectors become integers, so equal ones can be grouped. A group's count (or one) is its weight in the
fit: exact sums first, then a centred product per task, added up by cell. Only the sums and one dims x dims
matrix reach the driver. The distinct vectors are projected and joined back to their rows; a vector that very many
rows share is spread over salts, so no task gets all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid.session import write_once

#: Entries whose scaled size reaches this are not exact as doubles; they count as not finite.
LARGEST = float(1 << 53)
#: Rows of one vector are dealt over so many parts (at most 64, one bit each).
PARTS = 32
#: Components whose share of the trace is not above this have no variance but rounding.
LEAST_SHARE = 1e-12


def integers(vector: Column, scale: int = 1024, shift: int = 100_000) -> Column:
    """floor(scale * c) + shift of each entry as long; null unless every entry is a number of usable size."""
    scaled = lambda c: c.cast("double") * scale
    # NaN compares above every number.
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(scaled(c)) < LARGEST))
    return F.when(fine, F.transform(vector, lambda c: F.floor(scaled(c)) + F.lit(shift).cast("long")))


def by_length(batch: pa.RecordBatch):
    """(dims, row numbers, matrix of x, counts) for each number of entries in a batch of distinct vectors."""
    import numpy as np

    sizes = batch.column("dims").to_numpy()
    counts = batch.column("n").to_numpy()
    lists = batch.column("x")
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        part = lists if len(at) == len(sizes) else lists.take(pa.array(at))
        yield dims, at, part.flatten().to_numpy().reshape(len(at), dims), counts[at]


def exact_sums(x, weights) -> list[int]:
    """Weighted sums of the columns as Python integers."""
    import numpy as np

    if float(np.abs(x).max()) * float(weights.sum()) >= 2.0 ** 62:
        x, weights = x.astype(object), weights.astype(object)
    return [int(v) for v in weights @ x]


@dataclass
class Moments:
    """Number of vectors and exact sums of their entries; mean = whole + part / n."""

    n: int
    sums: list[int]

    def __post_init__(self):
        import numpy as np

        self.whole = [s // self.n for s in self.sums]
        self.part = [s - w * self.n for s, w in zip(self.sums, self.whole)]
        self.shift = np.array(self.whole, dtype=np.int64)
        self.rest = np.array([p / self.n for p in self.part])

    def centred(self, x):
        """x - S/n; the difference to the whole part is exact."""
        return (x - self.shift).astype(float) - self.rest

    def deviations(self, x) -> list[int]:
        """Sum over the entries of (n * x - S)^2, exactly."""
        import numpy as np

        gap = x - self.shift
        largest = (float(np.abs(gap).max()) + 1) * self.n
        if largest >= 2.0 ** 62:
            gap = gap.astype(object)
        gap = gap * self.n - np.array(self.part, dtype=gap.dtype)
        if largest * largest * x.shape[1] >= 2.0 ** 62:
            return [sum(v * v for v in row) for row in gap.tolist()]
        return (gap * gap).sum(axis=1).tolist()


@dataclass
class Whitener:
    """Projection of one vector length on its leading components, scaled to unit variance."""

    moments: Moments
    projection: object  # dims x components
    explained: list[float]
    error: float = 0.0

    @classmethod
    def of(cls, moments: Moments, covariance, components: int) -> Whitener:
        import numpy as np

        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        total = float(np.trace(covariance))
        shares = [float(values[i] / total) if total > 0 else 0.0 for i in order]
        scale = np.array([1 / np.sqrt(values[i]) if share > LEAST_SHARE else np.nan for i, share in zip(order, shares)])
        return cls(moments, vectors[:, order] * scale, [s if s > LEAST_SHARE else 0.0 for s in shares])

    def whiten(self, x):
        return self.moments.centred(x) @ self.projection


def _added(groups: DataFrame, cells: Callable[[int, object, object], list], kind: str) -> dict[int, dict[tuple[int, int], object]]:
    """Sums over all tasks of the (i, j, value) cells that ``cells(dims, x, counts)`` gives for their vectors, by dims."""
    decimal = kind != "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dims, _, x, counts in by_length(batch):
                new = cells(dims, x, counts)
                held[dims] = [a + b for a, b in zip(held[dims], new)] if dims in held else new
        for dims, values in held.items():
            i, j, v = [], [], []
            for number, row in enumerate(values):
                row = row if isinstance(row, list) else row.tolist() if hasattr(row, "tolist") else [row]
                i += [number] * len(row)
                j += range(len(row))
                v += [Decimal(y) if decimal else y for y in row]
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims] * len(i), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(v, pa.decimal128(38, 0) if decimal else pa.float64())], names=["dims", "i", "j", "value"])

    found = (groups.mapInArrow(run, f"dims int, i int, j int, value {kind}").groupBy("dims", "i", "j")
             .agg(F.sum("value").alias("value")).toArrow().to_pylist())
    out: dict[int, dict] = {}
    for r in found:
        out.setdefault(r["dims"], {})[r["i"], r["j"]] = r["value"]
    return out


def _square(cells: dict[tuple[int, int], float], size: int):
    import numpy as np

    out = np.zeros((size, size))
    for (i, j), value in cells.items():
        out[i, j] = value
    return out


def fit(groups: DataFrame, components: int = 8, weighted: bool = True) -> dict[int, Whitener]:
    """Whiteners by vector length from distinct vectors (dims int, x array<long>, n long).

    ``weighted``: a vector weighs as many as its count, which is the fit over all rows; otherwise each weighs one.
    Components number at most ``components`` and at most the vector length. One without variance
    (its share of the trace at most ``LEAST_SHARE``) is explained 0 and whitened to NaN. The error is the largest absolute entry of the
    whitened covariance minus the identity, over components with variance; 0 if there are none.
    """
    import numpy as np

    if not weighted:
        groups = groups.withColumn("n", F.lit(1).cast("long"))
    totals = _added(groups, lambda dims, x, counts: [int(counts.sum()), *exact_sums(x, counts)], "decimal(38,0)")
    moments = {dims: Moments(int(c[0, 0]), [int(c[i, 0]) for i in range(1, dims + 1)]) for dims, c in totals.items()}

    def product(dims, x, counts):
        gap = moments[dims].centred(x)
        return [*((gap * counts[:, None]).T @ gap)]

    spread = _added(groups, product, "double") if moments else {}
    models = {dims: Whitener.of(moments[dims], _square(c, dims) / moments[dims].n, min(components, dims)) for dims, c in spread.items()}

    def white(dims, x, counts):
        z = models[dims].whiten(x)
        # The last row holds the sums, so that the products below are centred even where rounding left a mean.
        return [*((z * counts[:, None]).T @ z), counts @ z]

    for dims, cells in (_added(groups, white, "double") if models else {}).items():
        model, size = models[dims], min(components, dims)
        mean = np.array([cells[size, j] for j in range(size)]) / model.moments.n
        gap = _square({k: v for k, v in cells.items() if k[0] < size}, size) / model.moments.n - np.outer(mean, mean) - np.eye(size)
        live = np.flatnonzero(np.array(model.explained) > 0)
        model.error = float(np.abs(gap[np.ix_(live, live)]).max()) if len(live) else 0.0
    return models


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, weighted: bool = True) -> DataFrame:
    """Whitened components of every usable row of (vec_id, embedding array of numbers).

    Returns vec_id, component (from 1, by falling variance), n (vectors in the fit), deviation decimal(38,0) (null
    beyond 38 digits), whitened, explained and identity_error; one row for each row and component.

    Rows whose vector is null, empty, or holds a null, a non-finite number or one of at least 2^53 once scaled take no part.
    Rows with a null vec_id do, repeated rows count and come back each. Vectors of different lengths
    cannot share a covariance: each length is a fit of its own. A component without variance (all of
    them if all vectors are equal) has explained 0 and a null whitened. Other columns are not looked
    at; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", integers(F.col("embedding"), scale, shift).alias("x")).where("x is not null and size(x) > 0")
    # Numbered rows are written before use: a task that runs again cannot deal a row to another part.
    rows = write_once(rows.withColumn("part", (F.monotonically_increasing_id() % PARTS).cast("int")), "whitening-rows")
    groups = write_once(rows.groupBy("x").agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, part))").alias("parts"))
                        .select(F.size("x").alias("dims"), "x", "n", "parts"), "whitening-groups")
    models = fit(groups, components, weighted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, at, x, _ in by_length(batch):
                model = models[dims]
                size = len(model.explained)
                exact = [Decimal(d) if d < 10 ** 38 else None for d in model.moments.deviations(x)]
                white = pa.array(model.whiten(x).reshape(-1), from_pandas=True)  # NaN: null
                picked = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [picked.column("x"), picked.column("parts"), pa.array([model.moments.n] * len(at), pa.int64()), pa.array(exact, pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(pa.array(range(0, size * len(at) + 1, size), pa.int32()), white),
                     pa.array([model.explained] * len(at), pa.list_(pa.float64())), pa.array([model.error] * len(at), pa.float64())],
                    names=["x", "parts", "n", "deviation", "white", "shares", "identity_error"])

    done = groups.mapInArrow(run, "x array<long>, parts long, n long, deviation decimal(38,0), white array<double>, shares array<double>, identity_error double")
    dealt = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.call_function("getbit", F.col("parts"), p) == 1)
    done = done.withColumn("part", F.explode(dealt)).drop("parts")
    key = lambda df: df.withColumn("mark", F.xxhash64("x"))
    joined = key(rows).join(key(done), ["mark", "part", "x"])
    each = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("white")).alias("component"), F.col("white").alias("whitened"), F.col("shares").alias("explained")))
    return (joined.select("vec_id", "n", "deviation", "identity_error", each.alias("e"))
            .select("vec_id", "e.component", "n", "deviation", "e.whitened", "e.explained", "identity_error"))
