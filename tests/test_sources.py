"""File sources: EDF, text tables, sidecars, discovery and manifests."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid.operators import raw
from nightgrid.operators import digests
from nightgrid.sources import edf, files


def write_edf(path, labels, per_record, records, seconds=1.0, cut=None):
    n = len(labels)
    pad = lambda text, width: str(text).ljust(width)[:width]
    head = pad("0", 8) + pad("X", 80) + pad("R", 80) + "01.02.03" + "22.00.00" + pad(256 * (n + 1), 8) + pad("", 44) + pad(records, 8) + pad(seconds, 8) + pad(n, 4)
    for values, width in ((labels, 16), ([""] * n, 80), (["uV"] * n, 8), ([-100] * n, 8), ([100] * n, 8), ([-32768] * n, 8), ([32767] * n, 8),
                          (["HP:0.3Hz LP:35Hz"] * n, 80), (per_record, 8), ([""] * n, 32)):
        head += "".join(pad(v, width) for v in values)
    data = {label: np.arange(p * records, dtype="<i2") * (i + 1) for i, (label, p) in enumerate(zip(labels, per_record))}
    body = b"".join(data[label][r * p : (r + 1) * p].tobytes() for r in range(records) for label, p in zip(labels, per_record))
    blob = head.encode("latin-1") + body
    with open(path, "wb") as handle:
        handle.write(blob if cut is None else blob[:cut])
    return data


def test_edf_sources(spark, tmp_path):
    data = write_edf(tmp_path / "a.edf", ["F3-M2", "SpO2"], [4, 1], 10)
    write_edf(tmp_path / "b.edf", ["F3-M2"], [4], 3, cut=300)
    edf.register(spark)
    heads = spark.read.format("edf_header").load(str(tmp_path)).orderBy("path", "channel_no").collect()
    assert [(os.path.basename(r["path"]), r["raw_channel"], r["fs_hz"], r["sample_count"]) for r in heads] == [
        ("a.edf", "F3-M2", 4.0, 40), ("a.edf", "SpO2", 1.0, 10), ("b.edf", None, None, None)]
    assert heads[2]["error"].startswith("short_header")
    got = (spark.read.format("edf_samples").option("channel", "f3-m2").option("firstRecord", 2).option("stopRecord", 7)
           .option("bytesPerPartition", 25).load(str(tmp_path / "a.edf")).orderBy("sample_idx").collect())
    assert [r["code"] for r in got] == data["F3-M2"][8:28].tolist() and got[0]["sample_idx"] == 8


@pytest.mark.parametrize("records, cut, error", [(10, None, None), (-1, None, None), (12, None, "missing_records"), (10, 7, "cut_record")])
def test_edf_tails(spark, tmp_path, records, cut, error):
    """What is there is read whatever the header states, and what is not is said."""
    path = tmp_path / "a.edf"
    data = write_edf(path, ["F3-M2", "SpO2"], [4, 1], 10)
    blob = bytearray(path.read_bytes())
    blob[236:244] = str(records).ljust(8).encode()
    path.write_bytes(bytes(blob[: len(blob) - cut] if cut else blob))
    edf.register(spark)
    for size in (25, 1 << 20):
        rows = spark.read.format("edf_samples").option("channel", "F3-M2").option("bytesPerPartition", size).load(f"file://{path}").collect()
        codes = [r["code"] for r in sorted((r for r in rows if r["error"] is None), key=lambda r: r["sample_idx"])]
        assert codes == data["F3-M2"][: 36 if cut else 40].tolist()
        errors = [r["error"].split(":")[0] for r in rows if r["error"]]
        assert errors == ([error, "missing_records"] if cut else [error] if error else [])
    missing = spark.read.format("edf_samples").option("channel", "none").load(str(path)).collect()
    assert [r["error"] for r in missing] == ["no_signal: none"]


def test_edf_ranges_and_listed_scans(spark, tmp_path):
    """Sample ranges give the rows that a filter gives; scans over a listing give the rows of the sources."""
    for i, n in enumerate("abcd"):
        write_edf(tmp_path / f"{n}.edf", ["F3-M2", "SpO2"], [4, 1], 10 + i, cut=300 if n == "d" else None)
    edf.register(spark)
    path = lambda n: str(tmp_path / f"{n}.edf")
    rows = lambda df: sorted(map(str, df.withColumn("path", F.regexp_extract("path", "[^/]+$", 0)).collect()))
    every = spark.read.format("edf_samples").option("channel", "f3-m2").load(str(tmp_path)).cache()
    listed = digests.stored_files(spark, str(tmp_path), "*.edf")
    for low, high in ((9, 22), (39, None), (5, 5), (7, 3), (0, 10_000)):
        source = spark.read.format("edf_samples").option("channel", "f3-m2").option("bytesPerPartition", 25).option("fromSample", low)
        got = (source if high is None else source.option("toSample", high)).load(str(tmp_path))
        want = every.where(f"error IS NOT NULL OR sample_idx BETWEEN {low} AND {high or 1 << 40}")
        assert rows(got) == rows(want) == rows(edf.scan_samples(listed, "f3-m2", step=33, within=(low, high))), (low, high)
    # A condition on the listing decides which files are opened.
    some = listed.where(F.col("path").endswith("/a.edf") | F.col("path").endswith("/d.edf"))
    assert rows(edf.scan_samples(some, "f3-m2")) == rows(every.where(F.col("path").isin(path("a"), path("d"))))
    heads = spark.read.format("edf_header").load(str(tmp_path))
    assert rows(edf.scan_headers(listed)) == rows(heads) and heads.count() == 7
    gone = spark.createDataFrame([(path("gone"), 900)], "path string, bytes bigint")
    assert "gone.edf" in edf.scan_headers(gone).first().error and "gone.edf" in edf.scan_samples(gone, "x", step=100).collect()[0].error
    none = digests.stored_files(spark, str(tmp_path), "*.none")
    assert edf.scan_headers(none).count() == edf.scan_samples(none, "x").count() == 0
    every.unpersist()


def test_metadata_and_labels(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿BIDSFolder,SessionID,BDSPPatientID,RecordingDuration,StartDateTime,EndDateTime\nsub-b,2,p2,nan,2001,\nsub-a,ses-1,p1, 60 ,1999,\n", encoding="utf-8")
    df = files.read_metadata(spark, str(tmp_path / "m.csv"), limit=1)
    row = files.session_columns(df).first()
    assert (row["session_key"], row["metadata_duration_seconds"], row["patient_id"]) == ("sub-a/ses-1", 60.0, "p1")
    (tmp_path / "l.csv").write_text("Epoch,Stage\n1,W\n")
    with pytest.raises(ValueError, match="lacks columns"):
        files.read_labels(spark, str(tmp_path / "l.csv"))


def test_tsv_and_sidecars(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("name\ttype\tunits\tsampling_frequency\tlowcutoff\thigh_cutoff\n F3-M2 \tEEG\tuV\t200\t0.3\tn/a\n \tx\ty\t1\t1\t1\n")
    rows = files.read_channels_tsv(spark, str(tmp_path / "c.tsv")).collect()
    assert [(r["raw_channel"], r["fs_hz"], r["hp_hz"], r["lp_hz"], r["prefilter_raw"]) for r in rows] == [("F3-M2", 200.0, 0.3, None, "HP:0.3 LP:None")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps({"Manufacturer": " X ", "SamplingFrequency": 200, "Other": [1]}, indent=2))
    (tmp_path / "j/b.json").write_text("{broken")
    side = {os.path.basename(r["path"]): r for r in files.read_sidecars(spark, str(tmp_path / "j")).collect()}
    assert side["a.json"]["manufacturer"] == "X" and side["a.json"]["bids_sampling_frequency"] == 200.0
    assert side["b.json"]["bids_json_error"] and side["a.json"]["bids_json_error"] is None


def test_discovery_and_selection(spark, tmp_path):
    for sub, names in {"sub-1/ses-1": ["x.h5", "x_ann.csv", "x_auto_ann.csv"], "sub-2/ses-1": ["y.h5", "z.h5", "y_ann.csv"]}.items():
        folder = tmp_path / sub / "eeg"
        folder.mkdir(parents=True)
        for n in names:
            (folder / n).write_text("x")
    found = files.list_files(spark, str(tmp_path), "*")
    assert files.list_files(spark, str(tmp_path)).count() == 3
    good, bad = files.exactly_one(found, {"h5": F.col("path").endswith(".h5"), "csv": F.col("path").endswith("ann.csv")}, "auto")
    assert [r["session_key"] for r in good.collect()] == ["sub-1/ses-1"]
    assert [(r["session_key"], r["detail"]) for r in bad.collect()] == [("sub-2/ses-1", "h5=2, csv=1")]


def recordings(spark):
    channel = lambda p, n, fs, seconds: (p, n, int(fs * seconds), "int16", float(fs), "uV", "", -100.0, 100.0, -10.0, 10.0, 1)
    names = ["c3-m2", "C4-M1", "e1"]
    rows = [channel(p, n, 4, d) for p, d in (("a1", 120), ("a2", 90)) for n in names] + [channel("b1", "c3-m2", 4, 60), channel("b1", "e1", 20, 60)]
    channels = spark.createDataFrame(rows, "path string, source_name string, length bigint, dtype string, fs double, unit string, type string, dig_min double, dig_max double, phys_min double, phys_max double, ndim int")
    heads = [("a1", "a1", "sub-a", "ses-1", 120.0, None, 1), ("a2", "a2", "sub-a", "ses-2", None, None, 1), ("b1", "b1", "sub-b", "ses-1", 60.0, ["x"], 1), ("zz", "zz", "s", "t", 1.0, None, 1)]
    fs = spark.createDataFrame(heads, "path string, relative_path string, subject_id string, session_id string, duration_sec double, annotations array<string>, file_size bigint")
    return raw.manifest_records(fs, channels)


def test_raw_selection_and_windows(spark, tmp_path):
    path = str(tmp_path / "manifest")
    raw.write_manifest(recordings(spark), path)
    records = raw.read_manifest(spark, path)
    assert {r["path"]: r["status"] for r in records.collect()} == {"a1": "ok", "a2": "ok", "b1": "ok", "zz": "error"}
    ok = records.where("status = 'ok'")
    assert ok.where("path = 'a2'").first()["duration_sec"] == 90.0
    sel = raw.select_channels(ok, raw.manifest_channels(records), raw.profile_slots(spark, groups={"eeg": ["C3-M2", "c4-m1"]}))
    kept = raw.apply_missing_policy(sel, "drop")
    assert {r["path"] for r in kept.collect()} == {"a1", "a2"}
    with pytest.raises(ValueError, match="b1: eeg/c4-m1"):
        raw.apply_missing_policy(sel, "error")
    lengths = raw.raw_lengths(ok, kept)
    assert raw.raw_windows(lengths, "context", 2, 1).count() == 3 + 2
    assert raw.raw_windows(lengths, "night").count() == 2
    mixed = raw.select_channels(ok, raw.manifest_channels(records), raw.profile_slots(spark, groups={"m": ["c3-m2", "e1"]}))
    rate = lambda target: {(r["path"], r["problem"]) for r in raw.modality_rates(mixed, target).collect()}
    assert ("b1", "mixed_rates") in rate(None) and ("b1", None) in rate({"m": 4.0}) and ("a1", "unsupported_resampling") in rate({"m": 8.0})
    (tmp_path / "old.json").write_text('{"manifest_version": 2}\n')
    with pytest.raises(ValueError, match="version"):
        raw.read_manifest(spark, str(tmp_path / "old.json"))
    for bad in ({"eeg": []}, {}, {"eeg": [[]]}):
        with pytest.raises(ValueError):
            raw.profile_slots(spark, groups=bad)
    assert raw.profile_slots(spark, "full").select("modality", "slot").distinct().count() == 14
    assert raw.profile_slots(spark, "compact7").select("modality", "slot").distinct().count() == 7
