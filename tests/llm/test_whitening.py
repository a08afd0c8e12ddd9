"""Whitening against NumPy over all rows and Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from nightgrid.llm import whitening


def brute(rows, components=8):
    """(vec_id, component) to the expected values; rows of (vec_id, vector), all usable."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    gap = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    v = gap.T @ gap / n
    e, q = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    return n, deviation, gap @ q[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def check(found, rows, components=8):
    n, deviation, white, share = brute(rows, components)
    k = white.shape[1]
    assert len(found) == len(rows) * k
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = {}
    for row, (vec_id, _) in enumerate(rows):
        mine = by[vec_id, deviation[row]]
        assert sorted(mine) == list(range(1, k + 1))
        for c in range(k):
            r = mine[c + 1][0]
            assert r.n == n and r.explained == pytest.approx(share[c], rel=1e-6) and r.identity_error <= 1e-4
            signs.setdefault(c, np.sign(r.whitened * white[row, c]))
            assert r.whitened == pytest.approx(signs[c] * white[row, c], abs=1e-7)
    assert len({r.identity_error for r in found}) == 1


def test_query_equals_numpy(spark, data_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data_dir}/embeddings.parquet").collect()]
    check(driver.queries()["op11_weighted_whitening"](spark, data_dir).collect(), rows)


def test_repeated_rows_weigh_by_count_and_come_back(spark):
    rng = np.random.default_rng(5)
    base = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows = base + [(100 + i, base[3][1]) for i in range(90)] + [base[7]] * 4 + [(None, base[9][1])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, x string, n int, part int").repartition(5)
    found = whitening.whiten(df)
    check(found.collect(), rows, 5)
    assert {(r.vec_id, r["count"]) for r in found.where("component = 1").groupBy("vec_id").count().where("count > 1").collect()} == {(7, 5)}
    once = whitening.whiten(df, weighted=False)
    assert once.select("n").distinct().collect()[0].n == 40
    white = np.array([r.white for r in once.where("vec_id < 40").dropDuplicates(["vec_id", "component"]).groupBy("vec_id")
                      .agg(F.expr("transform(sort_array(collect_list(struct(component, whitened))), s -> s.whitened)").alias("white")).collect()])
    assert np.cov(white.T, bias=True) == pytest.approx(np.eye(5), abs=1e-6)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [0.5, -2.0]), (3, [3.0, 0.25]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-inf, 0.0]),
            (9, []), (10, [1e300, 1.0]), (11, [4.0, 4.0, 4.0]), (12, [4.0, 4.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.whiten(df).collect()
    check([r for r in found if r.vec_id < 4], rows[:3])
    # Another length is its own fit; equal vectors have no variance.
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found if r.vec_id > 3) == [
        (i, c, 2, 0, None, 0.0, 0.0) for i in (11, 12) for c in (1, 2, 3)]
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id = 1")).select("n", "whitened").distinct().collect() == [(1, None)]


def test_exact_beyond_64_bits(spark):
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(2 ** 39, 2 ** 38), (-2 ** 40, 2 ** 39), (12345, -2 ** 40), (7, 3)])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(found, rows)
    assert max(r.deviation for r in found) > 1 << 63
