"""Kernels over chunked signals against the same kernels on whole signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.functions import dsp
from nightgrid.operators import chunked


def cut(spark, signals, sizes, seed=1):
    """Rows (sig, first, values) of signals in chunks of random sizes, in no order."""
    rng, rows = np.random.default_rng(seed), []
    for name, x in signals.items():
        at = 0
        while at < len(x):
            n = int(rng.choice(sizes))
            rows.append((name, at, [None if np.isnan(v) else float(v) for v in x[at:at + n]]))
            at += n
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "sig string, first long, values array<double>").repartition(3)


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(3)
    wave = lambda n: np.cumsum(rng.normal(size=n)) / 5 + rng.normal(size=n)
    holes = wave(3000)
    holes[[0, 700, 705, 1023, 1025, 2040]] = np.nan
    holes[1500:1530] = np.nan
    return {"whole": wave(2500), "holes": holes, "short": wave(40), "tiny": wave(9), "none": np.full(5, np.nan)}


def collect(parts, name):
    out = {}
    for r in parts.collect():
        out.setdefault((r.sig, r.run_first, r.run_stop), []).append((r[name], r["values"]))
    return {k: [(at, v) for at, v in sorted(rows, key=lambda x: x[0])] for k, rows in out.items()}


def runs(signals):
    return {(name, a, z): x[a:z] for name, x in signals.items() for a, z in dsp.finite_runs(x)}


def check(parts, name, want):
    got = collect(parts, name)
    assert set(got) == set(want)
    for key, (start, values) in want.items():
        place, joined = start, []
        for at, part in got[key]:
            assert at == place or not part, (key, at, place)
            place += len(part)
            joined += part
        assert len(joined) == len(values) and np.allclose(joined, values, atol=1e-9, rtol=1e-9), key


@pytest.mark.parametrize("block", [64, 1000, 1 << 16])
def test_pieces_cover_every_run_once(spark, signals, block):
    parts = chunked.pieces(cut(spark, signals, [7, 50, 333]), ["sig"], context=5, least=16, block=block).collect()
    want = runs(signals)
    for r in parts:
        x = want[r.sig, r.run_first, r.run_stop]
        a, z = r.first - r.run_first, r.stop - r.run_first
        assert r["values"] == x[a:z].tolist() and r.before == x[max(a - 5, 0):a].tolist() and r.after == x[z:z + 5].tolist()
        assert len(r["values"]) >= 16 or (r.first, r.stop) == (r.run_first, r.run_stop)
        assert len(r["values"]) <= block + 32
    assert sum(len(r["values"]) for r in parts) == sum(map(len, want.values()))


@pytest.mark.parametrize("block,fanout", [(64, 2), (100, 7), (1 << 16, 64)])
def test_band_filter_equals_the_whole_run(spark, signals, block, fanout):
    band = dsp.BandFilter(0.3, 35.0, 200.0)
    got = collect(chunked.band_filter(cut(spark, signals, [31, 200]), ["sig"], band, block, fanout), "first")
    for key, x in runs(signals).items():
        values = [p for _, p in got.pop(key)]
        if len(x) <= 15:
            assert values == [None]
        else:
            assert np.allclose(np.concatenate(values), band.apply(x), atol=1e-9, rtol=1e-9), key
    assert not got


@pytest.mark.parametrize("fs,target", [(500.0, 200.0), (128.0, 200.0), (200.0, 200.0), (25.0, 200.0)])
def test_resampling_equals_the_whole_run(spark, signals, fs, target):
    grid = dsp.SampleGrid(fs, target)
    want = {}
    for (name, a, z), x in runs(signals).items():
        ticks = grid.ticks(a, z, 1 << 40)
        want[name, a, z] = (ticks[0], grid.resampled(x, a, ticks))
    check(chunked.resample(cut(spark, signals, [31, 200]), ["sig"], fs, target, block=128), "tick", want)


def test_hold_and_decimate_equal_the_whole_run(spark, signals):
    chunks, grid = cut(spark, signals, [31, 200]), dsp.SampleGrid(25.0, 200.0)
    want = {}
    for (name, a, z), x in runs(signals).items():
        ticks = grid.ticks(a, z, 1 << 40)
        want[name, a, z] = (ticks[0], grid.held(x, a, ticks))
    check(chunked.hold(chunks, ["sig"], 25.0, block=64), "tick", want)
    for factor in (1, 2, 5):
        check(chunked.decimate(chunks, ["sig"], factor, block=256), "place", {k: (0, dsp.decimate(x, factor)) for k, x in runs(signals).items()})


def test_empty_signals(spark):
    none = spark.createDataFrame([], "sig string, first long, values array<double>")
    band = dsp.BandFilter(0.3, 35.0, 200.0)
    assert chunked.band_filter(none, ["sig"], band).collect() == [] and chunked.resample(none, ["sig"], 500.0).collect() == []
    assert chunked.band_filter(none.union(spark.createDataFrame([("a", 0, [])], none.schema)), ["sig"], band).collect() == []


def test_no_exchange_by_signal(spark, signals):
    """Samples move by (signal, block) only; no plan groups a whole signal."""
    plan = chunked.pieces(cut(spark, signals, [100]), ["sig"], block=64)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "block" in plan


def test_chunk_position_by_running_size(spark):
    rows = spark.createDataFrame([(1, 5, [1.0, 2.0]), (1, 3, [0.5]), (2, 9, [4.0]), (1, 8, [3.0])], "k long, n long, v array<double>")
    got = sorted((r.k, r.first, r["values"]) for r in chunked.as_signal(rows, ["k"], "n", F.col("v")).collect())
    assert got == [(1, 0, [0.5]), (1, 1, [1.0, 2.0]), (1, 3, [3.0]), (2, 0, [4.0])]


@pytest.mark.parametrize("samples, nodes", [(128, 2), (1 << 20, 2048)])
def test_small_groups_share_a_call(spark, monkeypatch, samples, nodes):
    """Blocks and nodes of many short signals are worked on together, in any number of calls."""
    monkeypatch.setattr(chunked, "CALL_SAMPLES", samples)
    monkeypatch.setattr(chunked, "CALL_NODES", nodes)
    signals = {k: np.random.default_rng(k).normal(size=300) for k in range(6)}
    rows = [(k, at, x[at:at + 50].tolist()) for k, x in signals.items() for at in range(0, 300, 50)]
    band = dsp.BandFilter(0.3, 35.0, 200.0)
    out = chunked.band_filter(spark.createDataFrame(rows, "signal bigint, first bigint, values array<double>"), ["signal"], band, block=64, fanout=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_call" in plan and "InPandas" not in plan
    got = {k: np.full(300, np.nan) for k in signals}
    for r in out.collect():
        got[r.signal][r.first:r.stop] = r["values"]
    for k, x in signals.items():
        assert np.allclose(got[k], band.apply(x.copy()), atol=1e-9)
