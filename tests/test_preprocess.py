"""Golden verdicts of whole channels: digital codes in, masks, flags and grades out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.plans.preprocess import label_tables, preprocess

GOOD = "HP:0.300Hz LP:35Hz N:60Hz"


def codes(physical, low=-3200.0, high=3200.0):
    return np.rint((np.asarray(physical) - low) / ((high - low) / 65535.0) - 32768.0)


def tone(hz, seconds, fs=200, amplitude=100.0):
    return amplitude * np.sin(2 * np.pi * hz * np.arange(int(seconds * fs)) / fs)


def case(channel, physical, seconds, fs=200.0, unit="uV", low=-3200.0, high=3200.0, prefilter=GOOD, raw=None, **extra):
    values = codes(physical, low, high) if raw is None else raw
    header = dict(channel=channel, source_present=True, read_error=None, fs=float(fs), source_samples=len(values),
                  duration_sec=float(seconds), unit=unit, dig_min=-32768.0, dig_max=32767.0, phys_min=low, phys_max=high,
                  prefilter=prefilter)
    header.update(extra)
    return header, values


@pytest.fixture(scope="module")
def results(spark):
    nan_raw = codes(tone(10, 90))
    nan_raw[7000] = np.nan
    rails = codes(tone(10, 60))
    rails[:100] = 32767
    rails[6000:6300] = 32767
    spikes = tone(10, 90)
    for second in range(30):
        spikes[6000 + second * 200] += 3000  # every second of the middle epoch
        if second < 29:
            spikes[12000 + second * 200] += 3000
    spikes[0] += 3000
    steps = np.repeat([95.0, 96.0, 94.0], 250)
    cases = {
        "tone10": case("f3-m2", tone(10, 60), 60), "tone50": case("f4-m1", tone(50, 60), 60), "tone60": case("c3-m2", tone(60, 60), 60),
        "tone80": case("c4-m1", tone(80, 60), 60), "flat": case("o1-m2", np.full(12000, 77.0), 60),
        "emg80": case("lat", tone(80, 60), 60, prefilter="HP:10Hz LP:100Hz"), "nan": case("e1", None, 90, raw=nan_raw), "rails": case("e2", None, 60, raw=rails),
        "spikes": case("o2-m1", spikes, 90), "short": case("ecg", tone(10, 40), 60, prefilter="HP:0.3Hz LP:70Hz"),
        "gate": case("airflow", tone(1, 60), 60, phys_min=-12003000.0), "flow0": case("airflow", np.zeros(12000), 60, prefilter="HP:0.159Hz LP:15Hz"),
        "snore0": case("snore", np.zeros(12000), 60, prefilter="HP:10Hz LP:100Hz"), "spo2": case("spo2", steps, 30, fs=25, unit="%", low=0.0, high=100.0),
        "spo2low": case("spo2", np.full(750, 2.0), 30, fs=25, unit="%", low=0.0, high=100.0), "unknown": case("f3-m2", tone(10, 90), 90, prefilter="HP:0Hz LP:0Hz"),
        "fast": case("f3-m2", tone(10, 60, fs=500), 60, fs=500), "badunit": case("f3-m2", tone(10, 60), 60, unit="pascal"),
        "unread": case("f3-m2", tone(10, 60), 60, read_error="OSError"), "badrate": case("f3-m2", tone(10, 60), 60, fs=-1.0),
    }
    headers = [{"recording_id": r, **h} for r, (h, _) in cases.items()]
    chunks = [(r, h["channel"], i, i * 6000, [float(v) for v in part])
              for r, (h, v) in cases.items() for i, part in enumerate(np.array_split(v, max(1, len(v) // 6000)))]
    records = [(r, h["duration_sec"], int(h["duration_sec"] // 30)) for r, (h, _) in cases.items()]
    order = [f.split(" ")[0] for f in m.CHANNEL_HEADER_SCHEMA.split(", ")]
    done = preprocess(
        spark.createDataFrame([tuple(h[c] for c in order) for h in headers], m.CHANNEL_HEADER_SCHEMA),
        spark.createDataFrame(chunks, m.NATIVE_CHUNK_SCHEMA),
        spark.createDataFrame(records, "recording_id string, duration_sec double, epoch_count bigint"))
    channel = {r: h["channel"] for r, (h, _) in cases.items()}
    qc = {}
    for row in done.qc.collect():
        if channel[row["recording_id"]] == row["channel"]:
            qc.setdefault(row["recording_id"], {})[row["epoch_in_record"]] = row
    states = {r["recording_id"]: r for r in done.processing.collect()}
    qc = {k: [v[i] for i in sorted(v)] for k, v in qc.items()}
    return done, qc, states, channel


def bits(rows, code):
    return [bool(r["hard_flags"] >> (code - 1) & 1) for r in rows]


def test_spectral_verdicts(results):
    _, qc, _, _ = results
    line = {k: bits(qc[k], 5)[0] for k in ("tone10", "tone50", "tone60", "tone80")}
    high = {k: bits(qc[k], 6)[0] for k in line}
    assert list(line.values()) == [False, True, True, False] and list(high.values()) == [False, False, False, True]
    assert all(r["valid"] for r in qc["tone10"])


def test_flat_and_emg(results):
    _, qc, _, _ = results
    assert bits(qc["flat"], 2) == [True, True] and qc["flat"][0]["power_line_fraction"] == 0
    row = qc["emg80"][0]
    assert row["high_frequency_fraction"] is None and row["hard_evaluated_flags"] == 29


def test_nan_evidence(results):
    done, qc, _, _ = results
    rows = qc["nan"]
    assert [r["processing_valid"] for r in rows] == [True, False, True]
    assert bits(rows, 1) == [False, True, False]
    assert rows[1]["hard_evaluated_flags"] == 1 and rows[1]["nonfinite_source_count"] == 1
    stored = done.signals.where("recording_id = 'nan' AND channel = 'e1' AND epoch_in_record = 1").first()["samples"]
    assert len(stored) == 6000 and stored[1000] == 0.0


def test_saturation_and_amplitude(results):
    _, qc, _, _ = results
    assert bits(qc["rails"], 3) == [False, True]
    assert [r["high_amplitude_duration_seconds"] for r in qc["spikes"]] == [1, 30, 29]
    assert bits(qc["spikes"], 4) == [False, True, False]


def test_coverage_and_gate(results):
    done, qc, states, _ = results
    assert [r["coverage_valid"] for r in qc["short"]] == [True, False]
    assert [r["processing_valid"] for r in qc["short"]] == [True, False] and states["short"]["channel_available"]
    gate = qc["gate"]
    assert all(r["coverage_valid"] and not r["valid"] and r["hard_evaluated_flags"] == 0 for r in gate)
    assert states["gate"]["channel_status_code"] == 4 and states["gate"]["filter_reapply_result"] == 5
    assert [states[k]["channel_status_code"] for k in ("badunit", "unread", "badrate")] == [3, 2, 3]
    grid = done.qc.groupBy("recording_id").agg(F.count("*").alias("n"), F.count_distinct("channel").alias("c")).collect()
    assert all(r["c"] == 15 for r in grid)


def test_respiratory_rules(results):
    _, qc, _, _ = results
    assert bits(qc["flow0"], 2) == [True, True] and qc["flow0"][0]["hard_code"] == 2
    assert all(r["valid"] and r["hard_evaluated_flags"] == 1 for r in qc["snore0"])


def test_spo2(results):
    done, qc, states, _ = results
    assert qc["spo2"][0]["valid"]
    x = np.array(done.signals.where("recording_id = 'spo2' AND channel = 'spo2'").first()["samples"]).reshape(-1, 8)
    assert (x == x[:, :1]).all() and set(np.round(x[:, 0])) == {94.0, 95.0, 96.0}
    low = states["spo2low"]
    assert low["channel_status_code"] == 5 and not low["channel_available"] and not qc["spo2low"][0]["valid"]
    kept = done.signals.where("recording_id = 'spo2low' AND channel = 'spo2'").first()["samples"]
    assert abs(kept[0] - 2.0) < 0.01


def test_filter_and_resample_states(results):
    done, qc, states, _ = results
    u = states["unknown"]
    assert (u["source_filter_state"], u["effective_filter_state"], u["filter_reapply_result"]) == (2, 2, 2)
    assert (u["effective_hp_hz"], u["effective_lp_hz"]) == (0.3, 35.0) and u["resample_result"] == 1
    assert all(r["valid"] for r in qc["unknown"])
    f = states["fast"]
    assert f["resample_result"] == 2 and f["effective_filter_state"] == 1
    x = np.array(done.signals.where("recording_id = 'fast' AND channel = 'f3-m2' AND epoch_in_record = 0").first()["samples"])
    assert np.abs(x - tone(10, 30))[200:-200].max() < 1.0


def test_grades_present(results):
    done, _, _, channel = results
    grades = {r["recording_id"]: r["night_grade"] for r in done.grades.collect()}
    assert set(grades) == set(channel) and set(grades.values()) == {1}


def label_frame(spark, rows):
    cols = "recording_id string, Epoch string, Stage string, `Heart Rate Max` string, `Heart Rate Min` string, `Heart Rate Avg` string, `SaO2 Max` string, `SaO2 Min` string"
    return spark.createDataFrame(rows, cols)


def label_row(r, epoch, stage="W", hr=("90", "60", "70"), sao2=("98", "95")):
    return (r, str(epoch), stage, *hr, *sao2)


def test_labels_and_alignment(spark):
    rows = ([label_row("a", i) for i in (1, 2, 3)]
            + [label_row("b", 1, "L")]
            + [label_row("c", i) for i in (1, 2, 3, 4)] + [label_row("c", 5, "L"), label_row("c", 8)]
            + [label_row("d", 1, hr=("90", "0", "70"))] + [label_row("e", 1, hr=("40", "60", "70"))] + [label_row("f", 1, sao2=("101", "95"))]
            + [label_row("g", 1), label_row("g", 1)])
    events = [("a", 0, 0.0, 30.0, 5), ("a", 1, 30.0, 60.0, 5), ("a", 2, 30.0, 60.0, 4), ("a", 3, 60.0, 90.0, 2), ("b", 0, 0.0, 30.0, 0)]
    events += [("c", i, 30.0 * i, 30.0 * (i + 1), 5) for i in range(6)] + [(x, 0, 0.0, 30.0, 5) for x in "defg"]
    events += [("h", 0, 30.0, 60.0, 5)]
    rows.append(label_row("h", 1))
    counts = {"a": 3, "b": 1, "c": 6, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1}
    records = spark.createDataFrame([(k, float(v * 30), v) for k, v in counts.items()], "recording_id string, duration_sec double, epoch_count bigint")
    out = label_tables(records, label_frame(spark, rows), spark.createDataFrame(events, m.STAGE_EVENT_SCHEMA))
    fields = {}
    for r in out["task_fields"].collect():
        fields.setdefault((r["recording_id"], r["field"]), {})[r["epoch_in_record"]] = r["field_qc_code"]
    code = lambda r, f: [fields[(r, f)][i] for i in sorted(fields[(r, f)])]
    assert code("a", "stage") == [0, 6, 7] and code("a", "max_bpm") == [0, 0, 0]
    assert code("b", "stage") == [3] and code("b", "mean_bpm") == [0]
    assert code("c", "stage") == [0, 0, 0, 0, 3, 1]
    assert [code("d", f)[0] for f in ("max_bpm", "min_bpm", "mean_bpm")] == [0, 2, 0]
    assert [code("e", f)[0] for f in ("max_bpm", "min_bpm", "mean_bpm")] == [4, 4, 4]
    assert [code("f", f)[0] for f in ("max_percent", "min_percent")] == [3, 0]
    assert code("h", "stage") == [5] and code("h", "min_percent") == [5]
    align = {r["recording_id"]: r for r in out["task_alignment"].collect()}
    assert align["a"]["known_anchors"] == 1 and align["a"]["status"] == "PARTIAL" and align["b"]["status"] == "PASS"
    structure = {r["recording_id"]: r for r in out["task_structure"].collect()}
    assert structure["c"]["extra_source_epochs"] == 1 and structure["c"]["structure_code"] == 1
    assert [(r["recording_id"], r["detail"]) for r in out["errors"].collect()] == [("g", "duplicate source epoch")]
    assert all(df.where("recording_id = 'g'").isEmpty() for name, df in out.items() if name != "errors")


def test_rejected_recordings(spark):
    """A recording that fails in any way is in no task table."""
    rows = [label_row(x, 1) for x in "abcde"]
    events = [("a", 0, 0.0, float("inf"), 5), ("b", 0, float("nan"), 30.0, 5), ("d", 0, 0.0, 30.0, 5), ("e", 0, 0.0, 30.0, 5), ("f", 0, 0.0, 30.0, 5)]
    records = spark.createDataFrame([(x, 30.0, 1) for x in "abcdef"], "recording_id string, duration_sec double, epoch_count bigint")
    good, bad = ('{"1":"N3","2":"N2","3":"N1","4":"REM","5":"%s"}' % x for x in ("wake", "awake"))
    maps = spark.createDataFrame([(x, bad if x == "d" else good) for x in "abcdef"], "recording_id string, event_map string")
    out = label_tables(records, label_frame(spark, rows), spark.createDataFrame(events, m.STAGE_EVENT_SCHEMA), maps)
    assert {(r["recording_id"], r["detail"]) for r in out["errors"].collect()} == {
        ("a", "nonfinite event time"), ("b", "nonfinite event time"), ("c", "no stage grid"), ("d", "stage map"), ("f", "no label rows")}
    for name, df in out.items():
        if name != "errors":
            assert {r["recording_id"] for r in df.collect()} <= {"e"}
    assert out["task_epochs"].count() == 3
