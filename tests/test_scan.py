"""Order-dependent operators against brute force, with one key holding a third of the rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.operators import batches, grid
from nightgrid.operators.scan import _place, data_bucket, dense_index, exact_quantiles, islands, number_bucket, running


def skewed(n=600, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(8)}", i, rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_running_matches_brute_force(spark, width):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    out = running(df, ["k"], ["t"], number_bucket(F.col("t"), width), {
        "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "n": ("count", F.col("v") > 50),
        "last": ("last", F.when(F.col("v") % 3 == 0, F.col("v")))})
    got = {(r["k"], r["t"]): (r["total"], r["top"], r["n"], r["last"]) for r in out.collect()}
    for k, t, _ in rows:
        before = [v for kk, tt, v in rows if kk == k and tt < t]
        thirds = [v for v in before if v % 3 == 0]
        assert got[(k, t)] == (sum(before), max(before, default=None), sum(v > 50 for v in before), thirds[-1] if thirds else None)


def test_dense_index_is_a_permutation(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("x"))
    got = [(r["x"], r["row_no"]) for r in dense_index(df, ["x"], number_bucket(F.col("x"), 64)).collect()]
    assert [x for x, _ in sorted(got, key=lambda p: p[1])] == sorted(x for x, _ in got)
    assert sorted(i for _, i in got) == list(range(1000))


@pytest.mark.parametrize("width", [3, 16, 100_000])
def test_islands_cross_buckets(spark, width):
    rng = random.Random(4)
    points = {("hot", i) for i in range(300) if rng.random() < 0.8} | {("b", i) for i in range(40, 90)}
    df = spark.createDataFrame(sorted(points), "k string, p bigint")
    want = set()
    for k in ("hot", "b"):
        run = None
        for p in sorted(q for kk, q in points if kk == k) + [10**9]:
            if run and p == run[1] + 1:
                run[1] = p
            else:
                if run:
                    want.add((k, *run))
                run = [p, p]
    assert {(r["k"], r["first"], r["last"]) for r in islands(df, ["k"], "p", width).collect()} == want


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(2)
    data = {"hot": rng.lognormal(size=7000), "few": rng.normal(size=3), "same": np.full(50, 2.5)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", float("nan")), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.95, "e": 1.0}
    for r in exact_quantiles(df, ["k"], F.col("v"), points, accuracy=accuracy).collect():
        assert r["count"] == len(data[r["k"]])
        assert np.allclose([r[p] for p in points], np.quantile(data[r["k"]], list(points.values())), rtol=1e-12)
    low = exact_quantiles(df, ["k"], F.col("v"), points, method="lower", accuracy=accuracy).where("k = 'hot'").first()
    ranked = np.sort(data["hot"])
    assert [low[p] for p in points] == [ranked[int(q * 6999)] for q in points.values()]


def greedy(sizes, limit, target):
    out, n, load, no = [], 0, 0, 0
    for s in sizes:
        if n and (n >= limit or load + s > target):
            no, n, load = no + 1, 0, 0
        out.append(no)
        n, load = n + 1, load + s
    return out


@pytest.mark.parametrize("seed, block", [(1, 20), (2, 33), (3, 16), (4, 4096)])
def test_greedy_batches_over_blocks(spark, seed, block):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 9, 30, 80, 120]) for _ in range(500)]
    df = spark.createDataFrame([(i * 3, s) for i, s in enumerate(sizes)], "id bigint, estimated_bytes bigint")
    got = batches.greedy_batches(df, "id", "id", max_records=16, target=100, block=block).orderBy("id").collect()
    assert [r["shard_no"] for r in got] == greedy(sizes, 16, 100)


def test_plan_sixteen_sixteen_three(spark):
    inventory = spark.createDataFrame([(i, 28_800.0) for i in range(36)], "session_key bigint, h5_duration_seconds double")
    admission = grid.admit_records(inventory, spark.createDataFrame([(35,)], "session_key bigint"))
    assert [r["status"] for r in grid.excluded(admission).collect()] == ["FIXED_EXCLUDED"]
    got = batches.greedy_batches(grid.planned(admission), "session_key", "session_key")
    assert [r["n"] for r in got.groupBy("shard_no").agg(F.count("*").alias("n")).orderBy("shard_no").collect()] == [16, 16, 3]


def test_windows_and_padding(spark):
    records = spark.createDataFrame([("r0", 3), ("r1", 2), ("r2", 2)], "recording_id string, n_epochs bigint")
    w = grid.context_windows(records, 2)
    assert w.count() == 4
    tail = w.where("recording_id = 'r0' AND window_no = 1").first()
    assert (tail["start_epoch"], tail["n_epochs"]) == (2, 1)
    r0 = w.where("recording_id = 'r0'").withColumn("batch_no", F.lit(0)).withColumn("slot", F.col("window_no"))
    members = grid.window_epochs(r0).select("batch_no", "slot", (F.col("epoch_in_record") - F.col("start_epoch")).alias("position"), "epoch_in_record")
    rows = batches.pad_batches(r0, members).orderBy("slot", "position").collect()
    assert [r["epoch_mask"] for r in rows] == [True, True, True, False] and rows[3]["epoch_in_record"] == -1
    assert grid.context_windows(records, 3, drop_last=True).count() == 1


def test_window_arguments():
    for call in (lambda: grid.check_window_arguments(0, None), lambda: grid.check_window_arguments(2, 0),
                 lambda: grid.check_window_arguments(2, None, "dev"), lambda: grid.check_window_arguments(2, None, None, []),
                 lambda: grid.check_window_arguments(2, None, None, [True]), lambda: grid.check_window_arguments(2, None, None, [6])):
        with pytest.raises(ValueError):
            call()


def test_grade_batches_are_homogeneous_and_repeatable(spark):
    rows = spark.range(300).select(F.col("id").alias("window_index"), F.when(F.col("id") < 200, 5).otherwise(F.col("id") % 3 + 1).cast("int").alias("night_grade"))
    one = batches.grade_batches(rows, 8, 20, seed=3)
    assert one.count() == 160
    assert one.groupBy("batch_no").agg(F.count_distinct("night_grade").alias("g")).where("g > 1").count() == 0
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, batches.grade_batches(rows, 8, 20, seed=3).collect()))
    once = batches.exact_once_batches(rows, 8, 3, 0)
    assert once.select("window_index").distinct().count() == once.count() == 300


def test_fixed_subset_is_exact(spark):
    rows = spark.range(2000).select(F.col("id").alias("window_index"), F.when(F.col("id") % 10 == 0, "test").otherwise("train").alias("split"))
    got = batches.fixed_subset(rows, 50, 1)
    assert {r["split"]: r["n"] for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 50, "test": 50}
    assert batches.fixed_subset(rows, 500, 1).where("split = 'test'").count() == 200


def test_scale_arguments():
    assert batches.fixed_scale({"offset": 95, "divisor": 5}) == (95.0, 5.0) and batches.fixed_scale(50) == (0.0, 50.0)
    for bad in (0, -1, True, float("nan"), "x", {"offset": 1}, {"offset": 1, "divisor": 0}):
        with pytest.raises(ValueError):
            batches.fixed_scale(bad)


@pytest.mark.parametrize("size, spread", [(1, 1), (2, 2), (9_999, 10**6), (10_001, 10**6), (10_001, 1), (40_000, 3)])
def test_quantiles_take_one_path_for_every_size(spark, size, spread):
    values = np.random.default_rng(size + spread).integers(0, spread, size).astype(float)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 7.0)], "k string, v double").repartition(3)
    points = {"low": 0.0, "p01": 0.01, "mid": 0.5, "p99": 0.99, "high": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], F.col("v"), points).collect()}
    assert got["a"]["count"] == size and got["b"]["p99"] == 7.0
    for name, q in points.items():
        assert got["a"][name] == pytest.approx(np.quantile(values, q), abs=1e-9)
    lower = exact_quantiles(df.where("k = 'a'"), [], F.col("v"), points, "lower").first()
    assert [lower[n] for n in points] == [np.sort(values)[int(q * (size - 1))] for q in points.values()]


@pytest.mark.parametrize("make", [lambda i: f"night-{i:06d}", lambda i: i * 10**15, lambda i: i])
def test_order_by_any_key(spark, make):
    """Text, sparse and dense keys: positions, packing and window ends as in a plain loop."""


    keys = [make(i) for i in range(900)]
    sizes = np.random.default_rng(1).integers(1, 40, 900).tolist()
    df = spark.createDataFrame(list(zip(keys, sizes)), ["key", "size"]).repartition(5)
    want, load, n, no = {}, 0, 0, -1
    for k, s in zip(keys, sizes):
        if n == 0 or n == 4 or load + s > 90:
            load, n, no = 0, 0, no + 1
        load, n = load + s, n + 1
        want[k] = no
    for block in (4, 7, 1000):  # one, two and more levels of the tree
        got = {r.key: r.shard_no for r in batches.greedy_batches(df, "key", "key", "size", 4, 90, block).collect()}
        assert got == want
    placed = {r.key: r.position for r in grid.global_positions(df, "key").collect()}
    assert [placed[k] for k in keys] == list(range(900))
    buckets = df.groupBy(data_bucket(df, "key").alias("b")).count().collect()
    assert len(buckets) > 100 and max(r["count"] for r in buckets) < 40


def test_text_order_joined_to_its_own_buckets(spark, tmp_path):
    """The buckets of a text key are joined back to its rows; Spark once moved the condition to the side without the key."""
    spark.range(15_000).select(F.format_string("Customer#%09d", "id").alias("name"), "id").write.parquet(str(tmp_path / "named"))
    df = spark.read.parquet(str(tmp_path / "named")).select(F.col("name").alias("key"), "id")
    placed = dense_index(df, ["key"], data_bucket(df, "key"), "at")
    assert placed.where("at <> id").count() == 0 and placed.count() == 15_000
    for value, bucket in spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string").select("v", _place("v", ["b", "c"])).collect():
        assert bucket == {"a": 0, "b": 1, "c": 2, None: -1}[value]


@pytest.mark.parametrize("block", [4, 50, 1000])
def test_greedy_batches_with_equal_keys(spark, block):
    """Rows that share a key stay as many as they are, and go by size."""
    rows = [(f"night-{i % 70:03d}", 1 + i * 7919 % 40) for i in range(700)] + [(None, 3), (None, 2)]
    df = spark.createDataFrame(rows, "key string, size bigint").repartition(3)
    got = batches.greedy_batches(df, "key", "key", "size", 4, 90, block).orderBy("position").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.key, r["size"]) for r in got] == order and [r.position for r in got] == list(range(702))
    assert [r.shard_no for r in got] == greedy([s for _, s in order], 4, 90)


def test_fixed_subset_gathers_no_split(spark):
    """However large the tables are taken to be, rows of a split are sifted before they move."""
    rows = [(i, "train" if i % 10 else "test") for i in range(3000)]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = batches.fixed_subset(spark.createDataFrame(rows, "window_index bigint, split string"), 25, 5)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        want = set()
        for split in ("train", "test"):
            want |= set(sorted((i for i, s in rows if s == split), key=lambda i: hashlib.sha256(f"5:{i}".encode()).hexdigest())[:25])
        assert {r.window_index for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
