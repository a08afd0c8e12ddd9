"""Signal kernels over chunks, so that no task holds more than one block of a signal.

A signal is a set of rows (keys, first, values): stretches of samples that start at sample ``first``. Its
finite runs may span any number of rows. ``pieces`` deals the samples to blocks of fixed size with a little context (halo) from
their neighbours and never leaves a run a stump at a block edge. On top of it:

* resampling, holding and decimation are local, since their kernels end inside the halo;
* zero-phase recursive filtering couples a whole run, but linearly: a piece is an affine element
  that takes filter states from both sides and gives states to both sides. Elements are composed in a tree (up), the states at
  every edge follow from the root (down), and each piece is then filtered once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from nightgrid.functions import dsp
from nightgrid.operators import scan
from nightgrid.operators.kernels import finite_run_column
from nightgrid.session import write_once

#: Samples of a block (half a megabyte) and children of a node of the tree; both bound a task, not the signal.
BLOCK, FANOUT = 1 << 16, 64
#: Samples of the blocks, and nodes of the tree (2 kB each), that one call works on; small groups share a call.
CALL_SAMPLES, CALL_NODES = 1 << 20, 2048
_DOUBLES = ArrayType(DoubleType())


def _shared(df: DataFrame, group: Sequence[str], calls: int) -> DataFrame:
    """Rows with the number of the call that works on their group, among others."""
    return df.withColumn("_call", F.pmod(F.xxhash64(*group), F.lit(max(1, calls))))


def _groups(table: pa.Table, names: Sequence[str]) -> dict[tuple, list[int]]:
    """Places of the rows of each group."""
    found: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(*[table[n].to_pylist() for n in names])):
        found.setdefault(key, []).append(at)
    return found


def finite_runs(chunks: DataFrame, keys: Sequence[str], bucket: int = 1 << 24) -> DataFrame:
    """(keys, run_first, run_stop) of the finite runs of whole signals; only run edges move.

    Runs of neighbouring rows are linked by scans over buckets of ``bucket`` samples, so a
    signal of any length is never one task.
    """
    keys = list(keys)
    edges = chunks.select(*keys, "first", F.explode(finite_run_column(F.col("values"))).alias("r")).select(
        *keys, (F.col("first") + F.col("r.first")).alias("a"), (F.col("first") + F.col("r.stop")).alias("z"))
    place = F.floor(F.col("a") / F.lit(bucket))
    linked = scan.running(edges, keys, ["a"], place, {"reached": ("max", F.col("z"))})
    head = F.when(F.col("reached").isNull() | (F.col("reached") < F.col("a")), F.col("a"))
    runs = scan.running(linked.select(*keys, "a", "z", head.alias("head")), keys, ["a"], place, {"run_first": ("last", F.col("head"))}, inclusive=True)
    return runs.groupBy(*keys, "run_first").agg(F.max("z").alias("run_stop"))


def _cut(edge: int, first: int, stop: int, least: int) -> int:
    """Where a block edge cuts a run: not within ``least`` samples of its ends."""
    return first if edge - first < least else stop if stop - edge < least else edge


def pieces(chunks: DataFrame, keys: Sequence[str], context: int = 0, least: int = 16, block: int = BLOCK) -> DataFrame:
    """(keys, run_first, run_stop, first, stop, before, values, after): every finite run cut into blocks.

    ``before`` and ``after`` are up to ``context`` samples of the run beside the piece. A piece at either end of its run has
    at least ``least`` samples, a run of fewer than twice as many is one piece. A sample goes to its block, and to the
    next one if it lies within the halo; with notes on the runs they are the only rows that move. A call holds some
    ``CALL_SAMPLES`` samples.
    """
    if block < 2 * least:
        raise ValueError("a block holds at least two least pieces")
    keys, halo = list(keys), context + least
    reach = lambda a, z: F.explode(F.sequence(F.floor((a - halo) / F.lit(block)), F.floor((z - 1 + halo) / F.lit(block))))
    stop = F.col("first") + F.size("values")
    slices = chunks.where(F.size("values") > 0).select(*keys, "first", stop.alias("stop"), "values", reach(F.col("first"), stop).alias("block"))
    low, high = F.greatest("first", F.col("block") * block - halo), F.least("stop", (F.col("block") + 1) * block + halo)
    slices = slices.where(high > low).select(*keys, "block", low.alias("at"), F.slice(
        "values", (low - F.col("first") + 1).cast("int"), (high - low).cast("int")).cast("array<double>").alias("values"))
    notes = finite_runs(chunks, keys)
    notes = notes.select(*keys, reach(F.col("run_first"), F.col("run_stop")).alias("block"), "run_first", "run_stop")
    schema = StructType([chunks.schema[k] for k in keys])
    for name in ("run_first", "run_stop", "first", "stop"):
        schema = schema.add(name, "long")
    for name in ("before", "values", "after"):
        schema = schema.add(name, _DOUBLES)
    size = block + 2 * halo

    # Both sides come from the same rows: the names of one are changed so that the keys are told apart.
    group, other = [*keys, "block"], [f"_{k}" for k in [*keys, "block"]]

    def deal(samples: pa.Table, runs: pa.Table) -> pa.Table:
        here, lists, starts = _groups(samples, group), samples["values"].combine_chunks(), samples["at"].to_pylist()
        firsts, lasts = runs["run_first"].to_pylist(), runs["run_stop"].to_pylist()
        ids, rows = [], []
        for key, noted in _groups(runs, other).items():
            at = key[-1] * block - halo
            held = np.full(size, np.nan)
            for i in here.get(key, ()):
                part = lists[i].values.to_numpy(zero_copy_only=False)
                held[starts[i] - at:starts[i] - at + len(part)] = part
            for first, last in sorted((firsts[i], lasts[i]) for i in noted):
                a, z = (_cut(at + halo + side, first, last, least) for side in (0, block))
                if a < z:
                    left, right = max(first, a - context), min(last, z + context)
                    ids.append(key[:-1])
                    rows.append((first, last, a, z, held[left - at:a - at], held[a - at:z - at], held[z - at:right - at]))
        columns = list(zip(*rows)) or [()] * 7
        data = {k: pa.array([i[n] for i in ids], samples.schema.field(k).type) for n, k in enumerate(keys)}
        data |= {n: pa.array(c, pa.int64()) for n, c in zip(("run_first", "run_stop", "first", "stop"), columns)}
        data |= {n: pa.array(c, pa.list_(pa.float64())) for n, c in zip(("before", "values", "after"), columns[4:])}
        return pa.table(data)

    notes = notes.select(*[F.col(k).alias(f"_{k}") for k in group], "run_first", "run_stop")
    total = chunks.agg(F.sum(F.size("values").cast("long"))).first()[0] or 0
    calls = -(-total // CALL_SAMPLES)
    slices, notes = _shared(slices, group, calls), _shared(notes, other, calls)
    return slices.groupBy("_call").cogroup(notes.groupBy("_call")).applyInArrow(deal, schema)


# -- zero-phase band filter -----------------------------------------------------------------------

_SHAPE, _SIDE = (4, 2, 2), 8  # passes, sections, state of a section; states of the two passes that enter from one side
_RIGHTWARD, _LEFTWARD = [0, 2], [1, 3]


class Element:
    """States that leave a stretch, as an affine function of those that enter it.

    ``right`` and ``left`` are what leaves on that side; columns of the matrices are what enters from the left, then from the right.
    """

    def __init__(self, matrix: np.ndarray, offset: np.ndarray):
        self.matrix, self.offset = matrix, offset

    def parts(self):
        m, c, n = self.matrix, self.offset, _SIDE
        return m[:n, :n], m[:n, n:], m[n:, :n], m[n:, n:], c[:n], c[n:]

    @classmethod
    def of(cls, band: dsp.BandFilter, x: np.ndarray, head: bool, tail: bool, cache: dict) -> Element:
        """The element of one piece; its matrix depends on the length and the ends only."""
        order = _RIGHTWARD + _LEFTWARD
        leaving = lambda states: states[order].reshape(-1)
        key = len(x), head, tail
        if key not in cache:
            unit = np.eye(2 * _SIDE).reshape(-1, *_SHAPE)
            quiet = np.zeros(len(x))
            cache[key] = np.array([leaving(band.chain(quiet, u[np.argsort(order)], head, tail)[1]) for u in unit]).T
        return cls(cache[key], leaving(band.chain(x, np.zeros(_SHAPE), head, tail)[1]))

    def before(self, other: Element) -> tuple[Element, np.ndarray, np.ndarray]:
        """This stretch and the next one as one; and what flows right between them, from (left, right) input and offset."""
        ll, lr, rl, rr, c, d = self.parts()
        ll2, lr2, rl2, rr2, c2, d2 = other.parts()
        # A pass feeds only later passes, so going to and fro ends after one turn.
        turn = np.eye(_SIDE) + lr @ rl2
        flow = np.hstack([turn @ ll, turn @ lr @ rr2])
        still = turn @ (c + lr @ d2)
        back = np.hstack([rl2 @ flow[:, :_SIDE], rl2 @ flow[:, _SIDE:] + rr2])
        back_still = rl2 @ still + d2
        matrix = np.vstack([np.hstack([ll2 @ flow[:, :_SIDE], ll2 @ flow[:, _SIDE:] + lr2]), np.hstack([rl + rr @ back[:, :_SIDE], rr @ back[:, _SIDE:]])])
        return Element(matrix, np.concatenate([ll2 @ still + c2, d + rr @ back_still])), flow, still


def _element(matrix: pa.ListScalar, offset: pa.ListScalar) -> Element:
    return Element(matrix.values.to_numpy().reshape(2 * _SIDE, 2 * _SIDE), offset.values.to_numpy())


def _entering(elements: list[Element], left: np.ndarray, right: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """States that enter each of neighbouring stretches, from those that enter all of them."""
    joined, flows = elements[0], []
    for nxt in elements[1:]:
        joined, flow, still = joined.before(nxt)
        flows.append((flow, still))
    out, outer = [], right
    for at in range(len(elements) - 1, 0, -1):
        flow, still = flows[at - 1]
        rightward = flow @ np.concatenate([left, outer]) + still
        out.append((rightward, outer))
        _, _, rl, rr, _, d = elements[at].parts()
        outer = rl @ rightward + rr @ outer + d
    out.append((left, outer))
    return out[::-1]


def band_filter(chunks: DataFrame, keys: Sequence[str], band: dsp.BandFilter, block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """(keys, run_first, run_stop, first, stop, values): zero-phase band filter over finite runs, equal to ``BandFilter.apply`` on each whole run.

    A run not longer than the filter's reflection cannot be filtered; its values are null. Pieces are
    written once, then read to make their elements and to be filtered; between these only states move (2 kB for a piece).
    """
    keys = list(keys)
    pad = dsp.reflection(band.stages[0])
    cut = write_once(pieces(chunks, keys, 0, pad + 1, block).drop("before", "after"), "band-pieces")
    long_enough = F.col("run_stop") - F.col("run_first") > pad
    fine = cut.where(long_enough)
    ident = StructType([chunks.schema[k] for k in keys]).add("run_first", "long")
    kind = ident.add("place", "long").add("matrix", _DOUBLES).add("offset", _DOUBLES)
    states = StructType([chunks.schema[k] for k in keys]).add("run_first", "long").add("place", "long").add("entering", _DOUBLES)

    def elements(batches):
        cache: dict = {}
        for batch in batches:
            rows = batch.select(["run_first", "run_stop", "first", "stop"]).to_pylist()
            found = [Element.of(band, x.values.to_numpy(zero_copy_only=False), r["first"] == r["run_first"], r["stop"] == r["run_stop"], cache)
                     for r, x in zip(rows, batch.column("values"))]
            columns = [batch.column(k) for k in [*keys, "run_first"]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([r["first"] // block for r in rows], pa.int64()), pa.array([e.matrix.reshape(-1) for e in found], pa.list_(pa.float64())),
                 pa.array([e.offset for e in found], pa.list_(pa.float64()))], names=kind.names)

    levels = [write_once(fine.mapInArrow(elements, kind), "band-elements")]
    ends = levels[0].agg(F.min("place"), F.max("place"), F.count("*")).first()
    node = [*keys, "run_first", "parent"]
    calls = -(-ends[2] // CALL_NODES)

    def joined(part: pa.Table) -> pa.Table:
        places, matrices, offsets = part["place"].to_pylist(), part["matrix"].combine_chunks(), part["offset"].combine_chunks()
        ids, found = [], []
        for key, rows in _groups(part, node).items():
            rows.sort(key=places.__getitem__)
            whole = _element(matrices[rows[0]], offsets[rows[0]])
            for i in rows[1:]:
                whole = whole.before(_element(matrices[i], offsets[i]))[0]
            ids.append(key)
            found.append(whole)
        data = {k: pa.array([i[n] for i in ids], part.schema.field(name).type) for n, (k, name) in enumerate(zip(kind.names, node))}
        return pa.table(data | {"matrix": pa.array([e.matrix.reshape(-1) for e in found], pa.list_(pa.float64())),
                                "offset": pa.array([e.offset for e in found], pa.list_(pa.float64()))})

    over = lambda df: df.withColumn("parent", F.floor(F.col("place") / F.lit(fanout)))
    low, high = ends[:2] if ends[0] is not None else (0, 0)
    # Up: until each run is below one node.
    while low != high:
        low, high = low // fanout, high // fanout
        if low != high:
            levels.append(write_once(_shared(over(levels[-1]), node, calls).groupBy("_call").applyInArrow(joined, kind), f"band-level-{len(levels)}"))

    def spread(children: pa.Table, parents: pa.Table) -> pa.Table:
        """Down: from what enters a node to what enters its children."""
        places, matrices, offsets = children["place"].to_pylist(), children["matrix"].combine_chunks(), children["offset"].combine_chunks()
        above, entering = _groups(parents, node), parents["entering"].combine_chunks()
        ids, found = [], []
        for key, rows in _groups(children, node).items():
            rows.sort(key=places.__getitem__)
            enters = entering[above[key][0]].values.to_numpy() if key in above else np.zeros(2 * _SIDE)
            inside = _entering([_element(matrices[i], offsets[i]) for i in rows], enters[:_SIDE], enters[_SIDE:])
            ids += [(*key[:-1], places[i]) for i in rows]
            found += [np.concatenate(pair) for pair in inside]
        data = {k: pa.array([i[n] for i in ids], children.schema.field(k).type) for n, k in enumerate(states.names[:-1])}
        return pa.table(data | {"entering": pa.array(found, pa.list_(pa.float64()))})

    # Nothing enters a whole run from outside.
    known = fine.sparkSession.createDataFrame([], states)
    for level in reversed(levels):
        known = (_shared(over(level), node, calls).groupBy("_call")
                 .cogroup(_shared(known.withColumnRenamed("place", "parent"), node, calls).groupBy("_call")).applyInArrow(spread, states))

    rest = [n for n in cut.columns if n != "values"]

    def filtered(batches):
        order = np.argsort(_RIGHTWARD + _LEFTWARD)
        for batch in batches:
            rows = batch.select(["run_first", "run_stop", "first", "stop", "entering"]).to_pylist()
            out = [None if r["entering"] is None else
                   band.chain(x.values.to_numpy(zero_copy_only=False), np.array(r["entering"]).reshape(_SHAPE)[order], r["first"] == r["run_first"], r["stop"] == r["run_stop"])[0]
                   for r, x in zip(rows, batch.column("values"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(out, pa.list_(pa.float64()))], names=[*rest, "values"])

    met = cut.withColumn("place", F.floor(F.col("first") / F.lit(block))).join(known, [*keys, "run_first", "place"], "left").select(*rest, "values", "entering")
    out_schema = StructType([cut.schema[n] for n in rest]).add("values", _DOUBLES)
    return met.mapInArrow(filtered, out_schema)


# -- local kernels --------------------------------------------------------------------------------

def _mapped(cut: DataFrame, keys: list[str], name: str, fn) -> DataFrame:
    """(keys, run_first, run_stop, ``name``, values) of each piece; ``fn(row, before, values, after)`` gives the two last."""
    schema = StructType([cut.schema[k] for k in [*keys, "run_first", "run_stop"]]).add(name, "long").add("values", _DOUBLES)
    extra = [n for n in cut.columns if n not in (*keys, "before", "values", "after")]

    def run(batches):
        for batch in batches:
            rows = batch.select(extra).to_pylist()
            lists = [[x.values.to_numpy(zero_copy_only=False) for x in batch.column(n)] for n in ("before", "values", "after")]
            out = [fn(r, *parts) for r, *parts in zip(rows, *lists)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in [*keys, "run_first", "run_stop"]], pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.float64()))],
                names=schema.names)

    return cut.mapInArrow(run, schema)


def hold(chunks: DataFrame, keys: Sequence[str], fs: float, target: float = 200.0, block: int = BLOCK) -> DataFrame:
    """(keys, run_first, run_stop, tick, values): the latest native sample at every output tick of each run; ``tick`` is the first one's number."""
    keys, grid = list(keys), dsp.SampleGrid(fs, target)

    def run(row, before, x, after):
        ticks = grid.ticks(row["first"], row["stop"], 1 << 62)
        return ticks[0], grid.held(x, row["first"], ticks)

    return _mapped(pieces(chunks, keys, 0, 1, block), keys, "tick", run)


def resample(chunks: DataFrame, keys: Sequence[str], fs: float, target: float = 200.0, block: int = BLOCK) -> DataFrame:
    """(keys, run_first, run_stop, tick, values): rational resampling of each finite run, equal to ``SampleGrid.resampled`` on the whole run.

    The halo is half the kernel. Only pieces whose kernel reaches over an end of the run need to know
    the run's end values; those few are joined to them.
    """
    keys, grid = list(keys), dsp.SampleGrid(fs, target)
    if not grid.regular or grid.step.numerator > 10_000:
        raise ValueError("the rate is no small fraction of the output rate")
    up, down = grid.step.denominator, grid.step.numerator
    wing = dsp.kernel_reach(up, down) + down + 1
    cut = write_once(pieces(chunks, keys, wing, down + 1, block), "resample-pieces")
    at_end = (F.col("first") - F.col("run_first") < wing) | (F.col("run_stop") - F.col("stop") < wing)

    def mirrored(row, x) -> np.ndarray:
        """The run from the last native sample on a tick, where it begins in ``x``."""
        lead = row["run_first"] % down
        return dsp.mirrored_lead(x, lead)

    def ends(row, before, x, after):
        edge = [None, None]
        if row["first"] == row["run_first"]:
            edge[0] = float(np.r_[mirrored(row, np.r_[x, after]), x][0])
        if row["stop"] == row["run_stop"]:
            edge[1] = float(x[-1])
        return row["first"], [np.nan if v is None else v for v in edge]

    found = (_mapped(cut.where((F.col("first") == F.col("run_first")) | (F.col("stop") == F.col("run_stop"))), keys, "at", ends)
             .groupBy(*keys, "run_first").agg(F.max(F.nanvl(F.col("values")[0], F.lit(None).cast("double"))).alias("start_value"), F.max(F.nanvl(F.col("values")[1], F.lit(None).cast("double"))).alias("end_value")))

    def run(row, before, x, after):
        first, stop = row["run_first"], row["run_stop"]
        ticks = grid.ticks(row["first"], row["stop"], 1 << 62)
        if up == down:
            return ticks[0], x
        held, at = np.r_[before, x, after], row["first"] - len(before)
        if at == first:
            lead = mirrored(row, held)
            held, at = np.r_[lead, held], at - len(lead)
        begin = first - first % down
        slope = 0.0
        if row.get("end_value") is not None and stop - begin > 1:
            slope = (row["end_value"] - row["start_value"]) / (stop - begin - 1)
        line = np.arange(1, wing + 1)
        if at == begin:
            held, at = np.r_[held[0] - slope * line[::-1], held], at - wing
        if row["stop"] + len(after) == stop:
            held = np.r_[held, held[-1] + slope * line]
        return ticks[0], dsp.polyphase_at(held, at, ticks, up, down)

    inner = _mapped(cut.where(~at_end), keys, "tick", run)
    return inner.unionByName(_mapped(cut.where(at_end).join(found, [*keys, "run_first"]), keys, "tick", run))


def decimate(chunks: DataFrame, keys: Sequence[str], factor: int, block: int = BLOCK) -> DataFrame:
    """(keys, run_first, run_stop, place, values): each finite run at 1/factor of its rate, equal to ``dsp.decimate`` on the whole run.

    ``place`` numbers the outputs of a run from 0.
    """
    keys = list(keys)
    if factor <= 0:
        raise ValueError("decimation factor must be positive")
    half = 10 * factor if factor > 1 else 0

    def run(row, before, x, after):
        first, size = row["run_first"], row["run_stop"] - row["run_first"]
        count = int(round(size / factor))
        low, high = (min(-(-(p - first) // factor), count) for p in (row["first"], row["stop"]))
        if factor == 1:
            return low, x
        held, at = np.r_[before, x, after], row["first"] - len(before) - first
        # Beyond the run its samples are mirrored; a run shorter than the kernel is held whole and goes on with its end values.
        need = np.arange(low * factor - half, (high - 1) * factor + half + 1)
        if size > half:
            need = np.where(need < 0, -need, np.where(need >= size, 2 * (size - 1) - need, need))
        else:
            need = np.clip(need, 0, size - 1)
        if high <= low:
            return low, x[:0]
        view = np.lib.stride_tricks.sliding_window_view(held[need - at], 2 * half + 1)[::factor]
        return low, view @ dsp.decimation_taps(factor)

    return _mapped(pieces(chunks, keys, 2 * half, half + 1, max(block, 2 * half + 2)), keys, "place", run)


def joined_values(parts: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(keys, place, value) rows of the kernels' output, a row for each sample."""
    return parts.select(*keys, name, F.posexplode("values").alias("i", "value")).select(*keys, (F.col(name) + F.col("i")).alias("place"), "value")


def as_signal(rows: DataFrame, keys: Sequence[str], order: str, values: Column, bucket: Column | None = None) -> DataFrame:
    """(keys, first, values) of rows whose vectors follow each other by ``order``: ``first`` is the running number of samples."""
    sized = rows.select(*keys, order, values.cast("array<double>").alias("values")).withColumn("size", F.size("values").cast("long"))
    placed = scan.running(sized, list(keys), [order], F.floor(F.col(order) / F.lit(1 << 16)) if bucket is None else bucket, {"first": ("sum", F.col("size"))})
    return placed.select(*keys, F.coalesce("first", F.lit(0)).cast("long").alias("first"), "values")
