"""Publication, resume, committed reads, reader registration, audits on mutated rows."""

import re

import pytest
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.operators import audits, grid, release
from nightgrid.sources import published, registry
from nightgrid.streaming.incremental import publish_arrivals

DIGEST = {"signal_epochs": ["recording_id", "epoch_in_record"], "records": ["recording_id", "n_epochs"]}


def tables(spark, shards):
    lengths = {"a1": ("00000", 3, 5), "b1": ("00000", 2, 1), "a2": ("00001", 2, 5)}
    recs = [(r, r[0], r[1], s, n, g) for r, (s, n, g) in lengths.items() if s in shards]
    records = spark.createDataFrame(recs, "recording_id string, subject_id string, session_id string, shard_id string, n_epochs bigint, night_grade int")
    rows = [(r[0], "e1", e, e * m.EPOCH_NS, [float(e + 1)] * 4, r[3]) for r in recs for e in range(r[4])]
    signals = spark.createDataFrame(rows, "recording_id string, channel string, epoch_in_record int, epoch_start_offset_ns bigint, samples array<float>, shard_id string")
    return {"signal_epochs": signals, "records": records}


def test_publish_resume_and_windows(spark, tmp_path):
    root = str(tmp_path / "release")
    first = release.publish(root, tables(spark, {"00000"}), DIGEST)
    second = release.publish(root, tables(spark, {"00000", "00001"}), DIGEST)
    commits = release.read_commits(spark, root)
    assert {(r["shard_id"], r["run_id"]) for r in commits.where("artifact = 'records'").collect()} == {("00000", first), ("00001", second)}
    assert release.read_published(spark, root, "signal_epochs").count() == 7
    # A run that wrote data but never committed stays invisible.
    stray = tables(spark, {"00001"})["signal_epochs"].withColumn("epoch_in_record", F.col("epoch_in_record") + 50)
    release.write_table(stray, f"{root}/signal_epochs/run_id=dead")
    assert release.read_published(spark, root, "signal_epochs").where("epoch_in_record >= 50").count() == 0
    source = published.read_release(spark, root)
    rows = published.read_windows(source, 2)
    assert rows.select("recording_id", "window_no").distinct().count() == 4
    assert published.read_windows(source, 1, grades=[5]).count() == 5
    # Waveforms stay where they are stored: nothing above their scan is shuffled.
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(source.signals) and re.search(r"\w*(?=Join)", plan(rows))[0] == "BroadcastHash"
    for context, stride, drop_last in ((2, 1, False), (3, 2, True), (1, 3, False), (2, 5, False), (9, 4, True)):
        chosen = source.records
        want = grid.window_epochs(grid.context_windows(chosen, context, stride, drop_last)).join(source.signals, ["recording_id", "epoch_in_record"])
        got = grid.epochs_in_windows(source.signals, chosen, context, stride, drop_last)
        names = ["recording_id", "window_no", "start_epoch", "n_epochs", "epoch_in_record", "channel"]
        assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect()))
    tail = rows.where("recording_id = 'a1' AND window_no = 1").collect()
    assert [(r["epoch_in_record"], r["start_sec"], r["epoch_start_offset_ns"]) for r in tail] == [(2, 60.0, 60 * 10**9)]


def test_damage_later_artifacts_and_two_runs(spark, tmp_path):
    root, both = str(tmp_path / "release"), {"00000", "00001"}
    release.publish(root, {"records": tables(spark, both)["records"]})
    # An artifact that comes later is written for shards that others have already.
    run = release.publish(root, tables(spark, both))
    read = lambda **kw: release.read_published(spark, root, "signal_epochs", **kw)
    assert read().count() == 7 and read(verify=True).count() == 7 and {r.shard_id for r in read().collect()} == both
    # A second run that did not see the first one's commits: each shard is read once.
    release.write_table(tables(spark, both)["signal_epochs"], f"{root}/signal_epochs/run_id=other")
    again = release.read_commits(spark, root).where("artifact = 'signal_epochs'").withColumn("run_id", F.lit("other"))
    spark.createDataFrame(again.collect(), again.schema).write.mode("append").parquet(f"{root}/commits")
    assert read().count() == 7
    # Changed samples: the digest covers every column.
    chosen = {r.shard_id: r.run_id for r in release.visible(spark, root, "signal_epochs").collect()}
    path = f"{root}/signal_epochs/run_id={chosen['00001']}/shard_id=00001"
    changed = spark.read.parquet(path).withColumn("samples", F.transform("samples", lambda x: x + 1)).collect()
    schema = spark.read.parquet(path).schema
    spark.createDataFrame(changed, schema).write.mode("overwrite").parquet(path)
    assert [r.shard_id for r in release.damaged_shards(spark, root, "signal_epochs").collect()] == ["00001"]
    assert {r.shard_id for r in read(verify=True).collect()} == {"00000"}
    assert run


def test_gate_keeps_bad_shards_back(spark, tmp_path):
    root, rows = str(tmp_path / "release"), tables(spark, {"00000", "00001"})
    broken = rows["signal_epochs"].where("recording_id <> 'a1' OR epoch_in_record <> 1")  # a gap in one night
    release.publish(root, {"signal_epochs": broken})
    assert {r.shard_id for r in release.read_published(spark, root, "signal_epochs").collect()} == {"00001"}
    assert {(r.shard_id, r.status) for r in release.read_commits(spark, root).collect()} == {("00000", "QC_FAILED"), ("00001", "QC_PASSED")}
    release.publish(root, {"signal_epochs": rows["signal_epochs"]})
    assert release.read_published(spark, root, "signal_epochs").count() == 7


def test_incremental_publish(spark, tmp_path):
    root, ledger = str(tmp_path / "release"), str(tmp_path / "ledger")
    schema = "recording_id string, shard_id string"

    def arrive(*shards):
        tables(spark, set(shards))["records"].select("recording_id", "shard_id").write.mode("append").parquet(ledger)
        build = lambda batch: {k: v.join(batch.select("recording_id"), "recording_id", "left_semi") for k, v in tables(batch.sparkSession, {"00000", "00001"}).items()}
        publish_arrivals(spark, ledger, schema, root, str(tmp_path / "cp"), build, DIGEST).awaitTermination()
        return release.read_published(spark, root, "signal_epochs").count()

    assert arrive("00000") == 5
    assert arrive("00001") == 7
    assert arrive("00001") == 7


def test_reader_registration():
    registry.register_reader("toy-reader", lambda spark: "toy")
    assert registry.open_release(None, "toy-reader") == "toy"
    for name in ("", "toy-reader", registry.BUILT_IN):
        with pytest.raises(ValueError):
            registry.register_reader(name, None)
    with pytest.raises(ValueError):
        registry.open_release(None, "nobody")


def test_release_conditions():
    release.check_release("v1.0.0", "COMPLETE", ("sao2",))
    for args in (("v2", "COMPLETE"), ("v1.0.0", "RUNNING"), ("v1.0.0", "COMPLETE", ("x",)), ("v1.0.0", "COMPLETE", ("sao2", "sao2"))):
        with pytest.raises(ValueError):
            release.check_release(*args)


def test_export_constants(spark, tmp_path):
    release.export_constants(spark, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/config/channels").count() == 15
    labels = spark.read.json(f"{tmp_path}/config/enums")
    assert labels.where("enum = 'hard_code' AND code = 3").first()["label"] == "SATURATION"


QC = ("recording_id string, channel string, epoch_in_record int, hard_flags int, hard_evaluated_flags int, hard_code int, "
      "artifact_valid boolean, valid boolean, channel_available boolean, coverage_valid boolean, processing_valid boolean")
CLEAN = ("r", "e1", 0, 0, 63, 0, True, True, True, True, True)


@pytest.mark.parametrize("audit, change", [
    (audits.flag_violations, {"hard_flags": 128}), (audits.flag_violations, {"hard_evaluated_flags": 127}),
    (audits.flag_violations, {"hard_flags": 4, "hard_evaluated_flags": 3}), (audits.code_violations, {"hard_flags": 5, "hard_code": 3}),
    (audits.mask_violations, {"artifact_valid": False}), (audits.mask_violations, {"hard_evaluated_flags": 31})])
def test_audits_fire(spark, audit, change):
    clean = spark.createDataFrame([CLEAN], QC)
    assert audit(clean).count() == 0
    assert audit(clean.withColumns({k: F.lit(v) for k, v in change.items()})).count() > 0


def test_difference_and_index_audit(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert audits.difference(a, a).count() == 0
    assert [tuple(r) for r in audits.difference(a, a.distinct()).collect()] == [(1, "x", 1)]
    rows = [("r", e, e * m.EPOCH_NS) for e in range(4)]
    good = spark.createDataFrame(rows, "recording_id string, epoch_in_record int, epoch_start_offset_ns bigint")
    assert audits.index_violations(good, ["recording_id"]).count() == 0
    assert audits.index_violations(good.where("epoch_in_record <> 1"), ["recording_id"]).count() == 1
    assert audits.index_violations(good.withColumn("epoch_start_offset_ns", F.col("epoch_start_offset_ns") + 1), ["recording_id"]).count() == 1
