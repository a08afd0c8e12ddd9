"""Digests of files of any size: streams, block trees, ranges checked by their branch, sealed releases."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F
from test_release import tables

from nightgrid.operators import digests, release


def tree_of(data: bytes, block: int, fan: int) -> list[list[str]]:
    level = [hashlib.sha256(b"leaf:" + data[i:i + block]).hexdigest() for i in range(0, max(1, len(data)), block)]
    levels = [level]
    while len(level) > 1:
        level = [hashlib.sha256(("node:" + ",".join(level[i:i + fan])).encode()).hexdigest() for i in range(0, len(level), fan)]
        levels.append(level)
    return levels


@pytest.fixture
def folder(tmp_path):
    for name, size in (("empty.bin", 0), ("one.bin", 7), ("even.bin", 64), ("odd.bin", 1001), ("a b+c%.bin", 130)):
        (tmp_path / name).write_bytes(os.urandom(size))
    return tmp_path


def test_streams_and_trees(spark, folder):
    listed = digests.stored_files(spark, str(folder))
    name = lambda path: path.rsplit("/", 1)[1]
    got = {name(r.path): (r.bytes, r.sha256) for r in digests.file_digests(listed).collect()}
    data = {p.name: p.read_bytes() for p in folder.iterdir() if p.name != "empty.bin"}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in data.items()}
    for block, fan in ((16, 2), (8, 4), (64, 64)):
        nodes = {(name(r.path), r.level, r.node): r.digest for r in digests.block_tree(listed, block, fan).collect()}
        assert nodes == {(n, i, k): h for n, d in data.items() for i, level in enumerate(tree_of(d, block, fan)) for k, h in enumerate(level)}
    none = digests.stored_files(spark, str(folder), "*.none")
    assert digests.file_digests(none).count() == 0 and digests.block_tree(none).count() == 0


def test_ranges_by_branch(spark, folder):
    block, fan = 16, 4
    listed = digests.stored_files(spark, str(folder))
    nodes = digests.write_once(digests.block_tree(listed, block, fan), "trees")
    path = {r.path.rsplit("/", 1)[1]: r.path for r in listed.collect()}
    asked = [("odd.bin", 0, 5), ("odd.bin", 500, 40), ("odd.bin", 500, 40), ("odd.bin", 990, 11), ("odd.bin", 990, 12), ("odd.bin", -1, 3), ("odd.bin", 4, 0),
             ("even.bin", 60, 4), ("a b+c%.bin", 100, 20), ("one.bin", 0, 7), ("empty.bin", 0, 1)]
    wanted = spark.createDataFrame([(path.get(n, "/none"), a, s, i) for i, (n, a, s) in enumerate(asked)] + [("/nowhere", 0, 1, 99)], "path string, at bigint, size bigint, digest int")
    check = lambda n=nodes, w=wanted, **kw: {r.digest: r.intact for r in digests.check_ranges(n, w, block=block, fan=fan, **kw).collect()}
    want = {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True, 8: True, 9: True, 10: False, 99: False}
    assert check() == want
    # Another root, and a stored sibling changed on the way: the branch no longer leads to the root.
    trusted = digests.roots(nodes)
    other = trusted.withColumn("digest", F.when(F.col("path").endswith("even.bin"), "x").otherwise(F.col("digest")))
    assert check(trusted=other) == want | {7: False}
    forged = nodes.withColumn("digest", F.when(F.col("path").endswith("even.bin") & (F.col("level") == 0) & (F.col("node") == 0), "x").otherwise(F.col("digest")))
    assert check(forged, trusted=trusted) == want | {7: False}
    # A byte changed in one block is seen by ranges in that block, and by no others.
    data = bytearray((folder / "odd.bin").read_bytes())
    data[505] ^= 1
    (folder / "odd.bin").write_bytes(data)
    single = lambda i: digests.check_ranges(nodes, wanted.where(F.col("digest") == i), block=block, fan=fan).first().intact
    assert [single(i) for i in (0, 1, 3)] == [True, False, True]
    (folder / "one.bin").unlink()
    assert not single(9) and single(7)


def test_file_above_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12_345
    with open(tmp_path / "large.bin", "wb") as out:  # sparse: takes no room on the disk
        out.truncate(size - 3)
        out.seek(size - 3)
        out.write(b"end")
    held, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range((size - 3) >> 20):
        held.update(zeros)
    held.update(bytes((size - 3) & ((1 << 20) - 1)) + b"end")
    listed = digests.stored_files(spark, str(tmp_path))
    row = digests.file_digests(listed).first()
    assert (row.bytes, row.sha256) == (size, held.hexdigest())
    nodes = digests.write_once(digests.block_tree(listed), "large")
    assert nodes.where("level = 0").count() == -(-size // digests.BLOCK) and nodes.agg(F.max("level")).first()[0] == 2
    wanted = listed.select("path", F.lit(size - 10).alias("at"), F.lit(10).alias("size"))
    assert digests.check_ranges(nodes, wanted).first().intact


def test_sealed_release(spark, tmp_path):
    root, every = str(tmp_path / "release"), ("a", "z")
    release.publish(root, tables(spark, {"00000"}))
    read = lambda low="a", high="z", **more: sorted(
        (r.recording_id, r.epoch_in_record) for r in release.read_verified(spark, root, "signal_epochs", {"recording_id": (low, high), **more}).collect())
    with pytest.raises(ValueError):
        read()
    release.seal(spark, root, "signal_epochs")
    release.publish(root, tables(spark, {"00000", "00001"}))
    assert {r for r, _ in read()} == {"a1", "b1"}  # not sealed yet: the later shard
    for _ in range(2):  # a repeated seal adds nothing
        release.seal(spark, root, "signal_epochs")
        assert release.trees(spark, root, "signal_epochs").where("level = 0").count() == 2
    got = release.read_verified(spark, root, "signal_epochs", {"recording_id": every})
    assert got.count() == 7 and set(got.columns) == set(release.read_published(spark, root, "signal_epochs").columns)
    assert {r.shard_id for r in got.collect()} == {"00000", "00001"}
    assert read("b1", "b1", epoch_in_record=(1, 9)) == [("b1", 1)] and read("c", "d") == []
    # A byte of one shard's file changes: its rows go, those of the other shard stay, and nothing of it is decoded.
    file = next((tmp_path / "release" / "signal_epochs").glob("run_id=*/shard_id=00001/*.parquet"))
    whole = file.read_bytes()
    for at in (5, len(whole) - 6, len(whole) - 40):
        data = bytearray(whole)
        data[at] ^= 1
        file.write_bytes(data)
        assert {r for r, _ in read()} == {"a1", "b1"}
    assert read("a2", "a2") == []


def test_no_damaged_file_gives_the_schema(spark, tmp_path):
    root = str(tmp_path / "release")
    release.publish(root, tables(spark, {"00000", "00001"}))
    release.seal(spark, root, "signal_epochs")
    read = lambda low="a", high="z": {r.recording_id for r in release.read_verified(spark, root, "signal_epochs", {"recording_id": (low, high)}).collect()}
    owned = {r.shard_id: r.recording_id for r in release.read_published(spark, root, "signal_epochs").select("shard_id", "recording_id").distinct().collect()}
    # Spark takes the schema from the first file: each is damaged in its turn.
    files = sorted((tmp_path / "release" / "signal_epochs").glob("run_id=*/shard_id=*/*.parquet"))
    shards = [f.parent.name.removeprefix("shard_id=") for f in files]
    assert len(set(shards)) == len(shards) == 2
    for file, shard in zip(files, shards):
        whole = file.read_bytes()
        file.write_bytes(whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:])
        assert owned[shard] not in read() and read()
        assert read(owned[shard], owned[shard]) == set() == read("zz", "zzz")
        file.write_bytes(whole)
    assert set(owned.values()) <= read()
    for file in files:
        file.write_bytes(file.read_bytes()[:-6] + b"\0" * 6)
    with pytest.raises(ValueError, match="sealed"):
        read()
