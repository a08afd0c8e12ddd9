"""Signal operators on the embeddings table, read as digital epochs.

Vector v is one epoch of one channel: recording v div 120, epoch (v mod 120) div 15, channel
v mod 15. Sixty-four components are the samples; codes are thousandths, with the far tail as
NaN. The label of a channel's first vector decides what its header looks like.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions import columns as c
from nightgrid.functions import headers as h
from nightgrid.operators import calibrate, grid, kernels, rules
from nightgrid.plans import preprocess
from nightgrid.plans.registry import Tables, query
from nightgrid.sources import synthetic

SPEC = m.RuleSpec(
    epoch_samples=64, amplitude_windows=8,
    amplitude_limit={"eeg": 3600.0, "eog": 3700.0, "ecg": 3800.0, "emg": 3500.0},
    flat_std={"eeg": 1250.0, "eog": 1250.0, "ecg": 1300.0}, psd_segment=16, psd_overlap=8,
    line_threshold=0.22, high_frequency_threshold=0.5, flat_code_span=500.0, flat_code_unique=62,
    spo2_range=(15.0, 110.0), spo2_min_fraction=0.9)

_KEYS = [
    "CAST(floor(vec_id / 120) AS BIGINT) AS recording_id",
    "CAST(vec_id % 15 AS INT) AS channel_idx",
    "CAST(floor((vec_id % 120) / 15) AS INT) AS epoch_in_record",
    "label",
]
_CHANNEL = "CASE vec_id % 15 " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, name in enumerate(m.CHANNELS)) + " END AS channel"
_HEADER = [
    "label <> 0 AS source_present",
    "CASE WHEN label = 1 THEN 'unreadable' END AS read_error",
    "CAST(CASE label WHEN 2 THEN -1 WHEN 5 THEN 25 WHEN 9 THEN 500 ELSE 200 END AS DOUBLE) AS fs",
    "CAST(CASE label WHEN 5 THEN 750 WHEN 9 THEN 15000 ELSE 6000 END * (8 - label % 3) AS BIGINT) AS source_samples",
    "CAST(240 AS DOUBLE) AS duration_sec",
    "CASE WHEN label = 4 THEN 'volts?' WHEN vec_id % 15 = 14 THEN 'Percent' WHEN label = 7 THEN ' mV'"
    " WHEN label = 8 THEN 'µV' ELSE 'uV' END AS unit",
    "CAST(-280 AS DOUBLE) AS dig_min", "CAST(280 AS DOUBLE) AS dig_max",
    "CAST(CASE WHEN label = 3 THEN -12003000 WHEN vec_id % 15 = 14 THEN 0 ELSE -3200 END AS DOUBLE) AS phys_min",
    "CAST(CASE WHEN vec_id % 15 = 14 THEN 100 ELSE 3200 END AS DOUBLE) AS phys_max",
    "CASE label WHEN 5 THEN 'HP:0.300Hz LP:35Hz N:60Hz' WHEN 6 THEN 'HP:0Hz LP:0Hz' WHEN 7 THEN"
    " 'HP:0.53Hz LP:35Hz' WHEN 9 THEN 'hp 10 Hz lp:100Hz NOTCH:50Hz N:60Hz' ELSE '' END AS prefilter",
]


def headers(t: Tables) -> DataFrame:
    """The header of each recording and channel is that of its first stored epoch, whichever it is."""
    first = (t.embeddings.selectExpr(*_KEYS[:2], _CHANNEL, "vec_id", "label").groupBy("recording_id", "channel")
             .agg(F.min("vec_id").alias("vec_id"), F.min_by("label", "vec_id").alias("label")))
    return first.selectExpr("recording_id", "channel", *_HEADER)


def epochs(t: Tables) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    codes = F.transform(x, lambda v: F.when(F.abs(v) > 42e-2, F.lit(float("nan"))).otherwise(F.rint(v * 1000e0)))
    return t.embeddings.select(
        *[F.expr(e) for e in (*_KEYS, _CHANNEL)], codes.alias("codes"), F.col("embedding").alias("samples"))


def processed(t: Tables) -> DataFrame:
    return calibrate.channel_processing(headers(t))


def live_epochs(t: Tables) -> DataFrame:
    """Epochs of available channels with physical float samples; the gate comes first."""
    gate = processed(t).where("channel_available").select(
        "recording_id", "channel", "channel_available", "fs", "source_samples", "unit",
        *calibrate.CALIBRATION)
    rows = epochs(t).join(gate, ["recording_id", "channel"])
    physical = calibrate.physical(F.col("codes")).cast("array<float>")
    return (rows.withColumn("samples", physical)
            .withColumn("coverage_valid", calibrate.epoch_covered(
                F.col("epoch_in_record"), F.col("fs"), F.col("source_samples"))))


def evidence(t: Tables) -> DataFrame:
    rows = live_epochs(t).withColumn("processing_valid", F.col("coverage_valid") & rules.all_finite(F.col("samples")))
    metric = kernels.epoch_metrics(F.col("samples"), F.col("codes"), F.col("channel"), F.col("dig_min"),
                                   F.col("dig_max"), F.col("coverage_valid"), SPEC)
    return (rows.withColumn("_m", metric)
            .select("recording_id", "channel", "epoch_in_record", "channel_available",
                    "coverage_valid", "processing_valid", "_m.*"))


def qc(t: Tables) -> DataFrame:
    return rules.epoch_qc(evidence(t), SPEC)


def full_qc(t: Tables) -> DataFrame:
    """QC rows for the whole recording x channel x epoch grid, placeholders included."""
    shape = (t.embeddings.selectExpr(*_KEYS).groupBy("recording_id")
             .agg((F.max("epoch_in_record") + 1).alias("n")))
    slots = grid.epoch_grid(shape, ["recording_id"], F.col("n")).drop("epoch_start_offset_ns")
    names = F.broadcast(m.channel_dimension(t.spark).select("channel"))  # fifteen rows
    status = processed(t).select("recording_id", "channel", "fs", "source_samples", "coverage_detection")
    cover = calibrate.epoch_covered(F.col("epoch_in_record"), F.col("fs"), F.col("source_samples"))
    slots = (slots.crossJoin(names).join(status, ["recording_id", "channel"], "left")
             .withColumn("coverage_valid", F.coalesce((F.col("coverage_detection") == 1) & cover, F.lit(False)))
             .drop("fs", "source_samples", "coverage_detection"))
    return rules.placeholders(slots, qc(t))


# --- the same projection and rules as SQL --------------------------------------------------
_BIT = "(CASE WHEN {} THEN {} ELSE 0 END)"
_NAMES = "(VALUES " + ",".join(
    f"('{n}','{m.channel_kind(n)}',{m.APPLICABLE_MASK[m.channel_kind(n)]})" for n in m.CHANNELS
) + ") AS names(channel, kind, appl)"
_UNIT = "replace(replace(lower(trim(unit)), 'µ', 'u'), 'μ', 'u')"
CTE = f"""WITH hdr AS (SELECT {', '.join(_KEYS[:2])}, {_CHANNEL}, {', '.join(_HEADER)}
  FROM embeddings WHERE vec_id % 120 < 15),
raw AS (SELECT {', '.join(_KEYS)}, {_CHANNEL}, list_transform(embedding, lambda v:
    CASE WHEN abs(v::DOUBLE) > 42e-2 THEN 'nan'::DOUBLE ELSE round_even(v::DOUBLE * 1000e0, 0) END) AS codes,
    embedding AS samples FROM embeddings),
st AS (SELECT *, CASE WHEN read_error IS NOT NULL THEN 2 WHEN NOT source_present THEN 1
    WHEN fs <= 0 THEN 3
    WHEN (channel = 'airflow' AND NOT (phys_min = -3200 AND phys_max = 3200 AND {_UNIT} = 'uv'))
      OR (channel = 'spo2' AND NOT (phys_min = 0 AND phys_max = 100 AND {_UNIT} IN ('%','percent','percentage'))) THEN 4
    WHEN NOT (dig_max > dig_min AND phys_max > phys_min AND CASE WHEN channel = 'spo2'
      THEN {_UNIT} IN ('%','percent','percentage') ELSE {_UNIT} IN ('uv','mv','v','microvolt','microvolts') END) THEN 3
    ELSE 0 END AS status, CASE WHEN channel = 'spo2' THEN 1.0::DOUBLE WHEN {_UNIT} = 'mv' THEN 1000.0::DOUBLE
      WHEN {_UNIT} = 'v' THEN 1000000.0::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM hdr),
live AS (SELECT r.recording_id, r.channel, r.epoch_in_record, r.codes, st.dig_min, st.dig_max, kind, appl,
    (r.epoch_in_record + 1) * round_even(30 * st.fs, 0) <= st.source_samples AS cov,
    list_transform(r.codes, lambda c: ((st.phys_min + (c - st.dig_min) * ((st.phys_max - st.phys_min) / (st.dig_max - st.dig_min))) * st.scale)::FLOAT) AS x
  FROM raw r JOIN st ON r.recording_id = st.recording_id AND r.channel = st.channel AND st.status = 0
  JOIN {_NAMES} ON names.channel = r.channel),
base AS (SELECT *, len(list_filter(codes, lambda c: NOT isfinite(c)))::BIGINT AS src,
    CASE WHEN len(list_filter(x, lambda v: isfinite(v))) > 0 THEN len(list_filter(x, lambda v: NOT isfinite(v)))::INT END AS outn,
    list_transform(x, lambda v: v::DOUBLE) AS d FROM live),
ev AS (SELECT *, cov AND coalesce(outn = 0, false) AS processing_valid,
    cov AND coalesce(outn = 0, false) AND src = 0 AS good FROM base),
seg AS (SELECT recording_id, channel, epoch_in_record, s, d[s*8+1:s*8+16] AS w FROM ev, range(7) t(s)
  WHERE good AND kind IN ('eeg','eog','ecg','emg')),
ctr AS (SELECT *, list_transform(w, lambda v, i: (v - list_avg(w)) * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 16))) AS z FROM seg),
pw AS (SELECT recording_id, channel, epoch_in_record, k, avg((CASE WHEN k = 8 THEN 1 ELSE 2 END) * (
    pow(list_sum(list_transform(z, lambda v, i: v * cos(2 * pi() * k * (i - 1) / 16))), 2)
    + pow(list_sum(list_transform(z, lambda v, i: v * sin(2 * pi() * k * (i - 1) / 16))), 2))) AS p
  FROM ctr, range(1, 9) u(k) GROUP BY 1, 2, 3, 4),
psd AS (SELECT recording_id, channel, epoch_in_record, sum(p) AS tot, sum(CASE WHEN k = 4 THEN p ELSE 0 END) AS line,
    sum(CASE WHEN k >= 6 THEN p ELSE 0 END) AS high FROM pw GROUP BY 1, 2, 3),
met AS (SELECT ev.*, CASE WHEN good AND kind IN ('eeg','eog','ecg') THEN list_stddev_pop(d) END AS std,
    CASE WHEN good AND kind IN ('eeg','eog','ecg','emg') THEN len(list_filter(range(8), lambda s:
      list_max(d[s*8+1:s*8+8]) - list_min(d[s*8+1:s*8+8]) > CASE kind WHEN 'eeg' THEN 3600 WHEN 'eog' THEN 3700 WHEN 'ecg' THEN 3800 ELSE 3500 END))::INT END AS amp,
    CASE WHEN good AND kind IN ('eeg','eog','ecg','emg') THEN len(list_filter(codes, lambda c: c <= dig_min + 1 OR c >= dig_max - 1)) / 64.0::DOUBLE END AS sat,
    CASE WHEN good AND kind = 'airflow' THEN list_max(codes) - list_min(codes) END AS span,
    CASE WHEN good AND kind = 'airflow' THEN CASE WHEN list_max(codes) - list_min(codes) <= 500 THEN least(63, list_unique(codes)) ELSE 63 END::INT END AS uniq,
    CASE WHEN good AND kind = 'spo2' THEN len(list_filter(d, lambda v: v >= 15 AND v <= 110)) / 64.0::DOUBLE END AS inside,
    CASE WHEN tot > 0 THEN line / tot WHEN tot = 0 THEN 0 END AS linef,
    CASE WHEN kind <> 'emg' THEN CASE WHEN tot > 0 THEN high / tot WHEN tot = 0 THEN 0 END END AS highf
  FROM ev LEFT JOIN psd USING (recording_id, channel, epoch_in_record)),
fl AS (SELECT *, {_BIT.format("cov AND (outn IS NOT NULL OR src > 0)", 1)}
    + {_BIT.format("std IS NOT NULL OR span IS NOT NULL", 2)} + {_BIT.format("sat IS NOT NULL", 4)}
    + {_BIT.format("amp IS NOT NULL", 8)} + {_BIT.format("linef IS NOT NULL", 16)}
    + {_BIT.format("highf IS NOT NULL", 32)} + {_BIT.format("inside IS NOT NULL", 64)} AS evaluated,
    {_BIT.format("cov AND (src > 0 OR coalesce(outn, 0) > 0)", 1)}
    + {_BIT.format("std < CASE kind WHEN 'ecg' THEN 1300 ELSE 1250 END OR (span <= 500 AND uniq <= 62)", 2)}
    + {_BIT.format("sat >= 0.05", 4)} + {_BIT.format("amp = 8", 8)} + {_BIT.format("linef > 0.22", 16)}
    + {_BIT.format("highf > 0.5", 32)} + {_BIT.format("inside < 0.9", 64)} AS flags FROM met),
qc AS (SELECT *, CASE WHEN flags & 1 > 0 THEN 1 WHEN flags & 4 > 0 THEN 3 WHEN flags & 8 > 0 THEN 4
    WHEN flags & 2 > 0 THEN 2 WHEN flags & 16 > 0 THEN 5 WHEN flags & 32 > 0 THEN 6 WHEN flags & 64 > 0 THEN 7 ELSE 0 END AS code,
    (evaluated & appl) = appl AND flags = 0 AS artifact_valid,
    cov AND processing_valid AND (evaluated & appl) = appl AND flags = 0 AS valid FROM fl)
"""
_ID = "recording_id, channel, epoch_in_record"


def _id(df: DataFrame, *cols) -> DataFrame:
    return df.select("recording_id", "channel", "epoch_in_record", *cols)


@query("P1_calibrate_strict", CTE + f"""SELECT {_ID}, 'x' AS tag,
  CASE WHEN channel = 'spo2' THEN '%' ELSE 'uV' END AS output_unit,
  round(list_sum(list_filter(list_transform(x, lambda v: v::DOUBLE), lambda v: isfinite(v))), 3) AS total FROM live""")
def p1(t):
    x = F.filter(F.transform("samples", lambda v: v.cast("double")), c.finite)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return _id(live_epochs(t), F.lit("x").alias("tag"), calibrate.output_unit().alias("output_unit"),
               F.round(total, 3).alias("total"))


@query("P3_profile_gate", CTE + "SELECT recording_id, channel, status <> 4 AS accepted FROM st WHERE status IN (0, 4)")
def p3(t):
    s = processed(t).where(F.col("channel_status_code").isin(0, 4))
    return s.select("recording_id", "channel", calibrate.profile_accepted().alias("accepted"))


@query("P4_channel_status", CTE + "SELECT recording_id, channel, status AS channel_status_code, status = 0 AS channel_available FROM st")
def p4(t):
    return processed(t).select("recording_id", "channel", "channel_status_code", "channel_available")


@query("P5_rate_validity", """SELECT l_linenumber, l_quantity, count(*) AS n,
  bool_and(l_quantity / 8 > 0 AND abs(l_quantity / 8 * 30 - round_even(l_quantity / 8 * 30, 0)) <= 1e-8) AS rate_valid
  FROM lineitem GROUP BY 1, 2""")
def p5(t):
    ok = calibrate.rate_valid(F.col("l_quantity") / 8)
    return (t.lineitem.groupBy("l_linenumber", "l_quantity")
            .agg(F.count("*").alias("n"), F.bool_and(ok).alias("rate_valid")))


@query("P6_coverage_mask", CTE + f"SELECT {_ID}, cov AS coverage_valid FROM live")
def p6(t):
    return _id(live_epochs(t), "coverage_valid")


@query("P8_valid_conjunction", CTE + f"SELECT {_ID}, artifact_valid, valid FROM qc")
def p8(t):
    return _id(qc(t), "artifact_valid", "valid")


@query("P9_processing_mask", CTE + f"SELECT {_ID}, processing_valid FROM ev")
def p9(t):
    return _id(evidence(t), "processing_valid")


@query("P10_zero_fill", CTE + f"""SELECT {_ID}, len(list_filter(x, lambda v: NOT isfinite(v) OR v = 0))::INT AS zeros,
  round(list_max(list_filter(list_transform(x, lambda v: v::DOUBLE), lambda v: isfinite(v))), 3) AS top FROM live""")
def p10(t):
    s = rules.zero_fill(F.col("samples"))
    return _id(live_epochs(t), F.size(F.filter(s, lambda v: v == 0)).alias("zeros"),
               F.round(F.array_max(F.transform(F.filter("samples", lambda v: c.finite(v.cast("double"))), lambda v: v.cast("double"))), 3).alias("top"))


@query("P19_prefilter_state", CTE + """SELECT recording_id, channel, CASE WHEN status <> 0 OR channel = 'spo2' THEN 0
  WHEN prefilter = '' OR prefilter = 'HP:0Hz LP:0Hz' THEN 2 ELSE 1 END AS source_filter_state FROM st""")
def p19(t):
    return processed(t).select("recording_id", "channel", "source_filter_state")


_BAND = """band AS (SELECT st.*, kind, CASE WHEN prefilter LIKE 'HP:0.300%' THEN 0.3::DOUBLE WHEN prefilter LIKE 'HP:0.53%' THEN 0.53::DOUBLE
   WHEN prefilter LIKE 'hp 10%' THEN 10::DOUBLE WHEN prefilter LIKE 'HP:0Hz%' THEN 0::DOUBLE END AS hp, CASE WHEN prefilter LIKE '%LP:35%' THEN 35::DOUBLE WHEN prefilter LIKE 'hp 10%' THEN 100::DOUBLE WHEN prefilter LIKE 'HP:0Hz%' THEN 0::DOUBLE END AS lp,
   CASE kind WHEN 'eeg' THEN 0.3::DOUBLE WHEN 'eog' THEN 0.3::DOUBLE WHEN 'ecg' THEN 0.3::DOUBLE WHEN 'emg' THEN 10::DOUBLE WHEN 'airflow' THEN 0.159::DOUBLE WHEN 'snore' THEN 10::DOUBLE END AS tl,
   CASE kind WHEN 'eeg' THEN 35::DOUBLE WHEN 'eog' THEN 35::DOUBLE WHEN 'ecg' THEN 70::DOUBLE WHEN 'emg' THEN 100::DOUBLE WHEN 'airflow' THEN 15::DOUBLE WHEN 'snore' THEN 100::DOUBLE END AS th
  FROM st JOIN """ + _NAMES + """ USING (channel))"""


@query("P20_filter_relation", CTE + ", " + _BAND + """SELECT recording_id, channel, CASE WHEN status <> 0 THEN 0 WHEN channel = 'spo2' THEN 6
  WHEN hp IS NULL OR hp + lp = 0 THEN 5 WHEN (hp > tl OR lp < th) AND (hp < tl OR lp > th) THEN 4 WHEN hp > tl OR lp < th THEN 3
  WHEN hp < tl OR lp > th THEN 2 ELSE 1 END AS filter_relation FROM band""")
def p20(t):
    return processed(t).select("recording_id", "channel", "filter_relation")


@query("P21_processing_result", """SELECT l_returnflag, l_linestatus, l_linenumber, effective_filter_state, filter_reapply_result, resample_result, count(*) AS n FROM (
 SELECT l_returnflag, l_linestatus, l_linenumber,
  CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_linestatus = 'O' AND l_linenumber - 1 > 0 THEN 2 WHEN l_linestatus = 'O' THEN 4 ELSE 1 END AS effective_filter_state,
  CASE WHEN l_returnflag = 'R' THEN 4 WHEN l_linestatus <> 'O' THEN 1 WHEN l_linenumber > 1 AND l_quantity > 25 THEN 6 WHEN l_linenumber > 1 THEN 2 ELSE 3 END AS filter_reapply_result,
  CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linenumber > 1 AND l_quantity > 25 THEN 6 WHEN l_linenumber = 1 THEN 3 WHEN l_suppkey % 2 = 0 THEN 1 ELSE 2 END AS resample_result
 FROM lineitem) GROUP BY ALL""")
def p21(t):
    states = calibrate.run_states(
        F.when(F.col("l_suppkey") % 2 == 0, F.lit(200.0)).otherwise(F.lit(500.0)), F.col("l_linestatus") == "O",
        F.col("l_returnflag") == "R", F.col("l_linenumber") - 1, F.floor(F.col("l_quantity") / 26))
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    rows = t.lineitem.select(*keys, *[v.alias(k) for k, v in states.items()])
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("P22_enum_decode", "SELECT enum, e.code, label, n FROM (VALUES " + ", ".join(
    f"('{k}', {code}, '{label}')" for k, table in (("hard_code", m.HARD_CODES), ("task_qc", m.TASK_QC))
    for code, label in table.items()) + """) AS e(enum, code, label)
  JOIN (SELECT l_linenumber AS code, count(*) AS n FROM lineitem GROUP BY 1) USING (code)""")
def p22(t):
    seen = t.lineitem.groupBy(F.col("l_linenumber").alias("code")).agg(F.count("*").alias("n"))
    enums = m.enum_dimension(t.spark).where(F.col("enum").isin("hard_code", "task_qc"))
    return seen.join(F.broadcast(enums), "code").select("enum", "code", "label", "n")  # fixed rows


@query("J9_record_channel_to_epoch", CTE + f"""SELECT r.recording_id, r.channel, r.epoch_in_record, st.status = 0 AS channel_available
  FROM raw r JOIN st ON r.recording_id = st.recording_id AND r.channel = st.channel""")
def j9(t):
    return _id(epochs(t).drop("samples", "codes").join(
        processed(t).select("recording_id", "channel", "channel_available"), ["recording_id", "channel"]),
        "channel_available")


def _metric(name, key, sql_col, digits=None):
    sql_value = f"round({sql_col}, {digits})" if digits else sql_col

    @query(name, CTE + f"SELECT {_ID}, {sql_value} AS {key} FROM met WHERE {sql_col} IS NOT NULL")
    def run(t, key=key, digits=digits):
        col = F.round(key, digits) if digits else F.col(key)
        return _id(evidence(t).where(F.col(key).isNotNull()), col.alias(key))

    return run


_metric("Q1_nonfinite_source_count", "nonfinite_source_count", "src")
_metric("Q2_nonfinite_output_count", "nonfinite_output_count", "outn")
_metric("Q4_epoch_std", "std_physical", "std", 4)
_metric("Q5_amplitude_windows", "high_amplitude_duration_seconds", "amp")
_metric("Q6_line_power_fraction", "power_line_fraction", "linef", 6)
_metric("Q6_high_frequency_fraction", "high_frequency_fraction", "highf", 6)
_metric("Q8_saturation_fraction", "saturation_fraction", "sat", 6)
_metric("Q10_spo2_in_range", "spo2_in_range_fraction", "inside", 6)


@query("Q9_airflow_digital_flatness", CTE + f"""SELECT {_ID}, span AS digital_peak_to_peak_codes, uniq AS digital_unique_count_capped3,
  span <= 500 AND uniq <= 62 AS flat FROM met WHERE span IS NOT NULL""")
def q9(t):
    flat = (F.col("digital_peak_to_peak_codes") <= 500) & (F.col("digital_unique_count_capped3") <= 62)
    return _id(evidence(t).where("digital_peak_to_peak_codes IS NOT NULL"),
               "digital_peak_to_peak_codes", "digital_unique_count_capped3", flat.alias("flat"))


@query("Q3_nan_rule", CTE + f"SELECT {_ID}, evaluated & 1 = 1 AS evaluated, flags & 1 = 1 AS hit FROM qc")
def q3(t):
    return _id(qc(t), c.has_bit(F.col("hard_evaluated_flags"), 1).alias("evaluated"),
               c.has_bit(F.col("hard_flags"), 1).alias("hit"))


@query("Q7_spectral_flags", CTE + f"""SELECT {_ID}, flags & 16 > 0 AS power_line, flags & 32 > 0 AS high_frequency
  FROM qc WHERE evaluated & 16 > 0""")
def q7(t):
    rows = qc(t).where(c.has_bit(F.col("hard_evaluated_flags"), 5))
    return _id(rows, c.has_bit(F.col("hard_flags"), 5).alias("power_line"),
               c.has_bit(F.col("hard_flags"), 6).alias("high_frequency"))


@query("Q11_flag_bitsets", CTE + f"SELECT {_ID}, flags AS hard_flags, evaluated AS hard_evaluated_flags FROM qc")
def q11(t):
    return _id(qc(t), "hard_flags", "hard_evaluated_flags")


@query("Q12_primary_code", CTE + f"SELECT {_ID}, code AS hard_code FROM qc")
def q12(t):
    return _id(qc(t), "hard_code")


@query("Q13_artifact_mask", CTE + f"SELECT {_ID}, appl AS applicable, artifact_valid FROM qc")
def q13(t):
    return _id(qc(t), rules.applicable_mask(F.col("channel")).alias("applicable"), "artifact_valid")


FULL = CTE + f""", shape AS (SELECT recording_id, max(epoch_in_record) AS last FROM raw GROUP BY 1),
full_qc AS (SELECT s.recording_id, names.channel, e::INT AS epoch_in_record, names.appl,
   coalesce(qc.cov, (e + 1) * round_even(30 * st.fs, 0) <= st.source_samples AND st.status IN (0, 3, 4) AND st.fs > 0, false) AS coverage_valid,
   coalesce(qc.processing_valid, false) AS processing_valid, coalesce(qc.artifact_valid, false) AS artifact_valid,
   coalesce(qc.valid, false) AS valid, coalesce(flags, 0) AS hard_flags, coalesce(evaluated, 0) AS hard_evaluated_flags, coalesce(code, 0) AS hard_code
  FROM shape s CROSS JOIN {_NAMES}, range(0, s.last + 1) g(e)
  LEFT JOIN st ON st.recording_id = s.recording_id AND st.channel = names.channel
  LEFT JOIN qc ON qc.recording_id = s.recording_id AND qc.channel = names.channel AND qc.epoch_in_record = e)
"""


@query("Q14_placeholder_rows", FULL + f"SELECT {_ID}, coverage_valid, processing_valid, artifact_valid, valid, hard_flags, hard_evaluated_flags, hard_code FROM full_qc")
def q14(t):
    return _id(full_qc(t), "coverage_valid", "processing_valid", "artifact_valid", "valid",
               "hard_flags", "hard_evaluated_flags", "hard_code")


@query("Q15_spo2_near_zero", """SELECT user_id AS recording_id, count(*) AS finite, count(*) FILTER (value / 10 < 5) AS low,
  count(*) FILTER (value / 10 < 5) / count(*) >= 0.9 OR median(value / 10) < 5 AS near_zero FROM events GROUP BY 1""")
def q15(t):
    v = F.col("value") / 10
    rows = t.events.select(
        F.col("user_id").alias("recording_id"), F.lit(1).alias("finite"), (v < 5).cast("int").alias("low"),
        F.when(v < 5, v).alias("low_max"), F.when(v >= 5, v).alias("high_min"))
    return rules.spo2_near_zero(rows)


@query("A1_usable_hours", CTE + """SELECT recording_id, channel, sum(valid::INT)::BIGINT AS valid_epochs,
  sum(valid::INT)::DOUBLE AS usable_hours FROM qc GROUP BY 1, 2""")
def a1(t):
    return rules.usable_hours(qc(t), 1.0)


_GRADES = """, hrs AS (SELECT recording_id, channel, sum(valid::INT)::DOUBLE AS h FROM qc GROUP BY 1, 2),
best AS (SELECT recording_id, """ + ", ".join(
    f"coalesce(max(h) FILTER (kind = '{g}'), 0) AS {g}" for g in rules.GRADE_GROUPS) + """
  FROM hrs JOIN """ + _NAMES + """ USING (channel) GROUP BY 1),
grades AS (SELECT *, CASE WHEN least(eeg, eog, emg, ecg, airflow, spo2) > 5 THEN 5 WHEN least(eeg, eog, emg, airflow, spo2) > 5 THEN 4
  WHEN least(eeg, airflow, spo2) > 5 THEN 3 WHEN least(eeg, airflow, spo2) > 4 THEN 2 ELSE 1 END AS night_grade FROM best)
"""


def grades(t: Tables) -> DataFrame:
    return rules.night_grade(rules.usable_hours(qc(t), 1.0))


@query("A2_night_grade", CTE + _GRADES + "SELECT * FROM grades")
def a2(t):
    return grades(t)


_RULES = "(VALUES " + ",".join(
    f"('{n}',{k},'{m.HARD_CODES[k]}',{'true' if m.APPLICABLE_MASK[m.channel_kind(n)] >> (k - 1) & 1 else 'false'})"
    for n in m.CHANNELS for k in range(1, 8)) + ") AS r(channel, code, name, applicable)"


@query("A3_rule_summary", CTE + f"""SELECT r.channel, r.code, r.name, r.applicable,
  coalesce(sum((qc.evaluated >> (r.code - 1)) & 1), 0)::BIGINT AS evaluated_epochs,
  coalesce(sum((qc.flags >> (r.code - 1)) & 1), 0)::BIGINT AS hard_epochs,
  sum((qc.flags >> (r.code - 1)) & 1) / nullif(sum((qc.evaluated >> (r.code - 1)) & 1), 0) AS hit_rate
  FROM {_RULES} LEFT JOIN qc ON qc.channel = r.channel GROUP BY ALL""")
def a3(t):
    return rules.rule_summary(qc(t))


@query("A4_rule_roll_up", CTE + f"""SELECT r.channel, r.code, r.name, r.applicable,
  coalesce(sum((qc.evaluated >> (r.code - 1)) & 1), 0)::BIGINT AS evaluated_epochs,
  coalesce(sum((qc.flags >> (r.code - 1)) & 1), 0)::BIGINT AS hard_epochs
  FROM {_RULES} LEFT JOIN qc ON qc.channel = r.channel GROUP BY ALL""")
def a4(t):
    shards = qc(t).withColumn("shard_id", F.floor(F.col("recording_id") / 2))
    return rules.roll_up(rules.rule_summary(shards, ("shard_id",)))


@query("A5_hard_events", CTE + f"""SELECT qc.{_ID.replace(', ', ', qc.')}, r.code AS hard_code, qc.epoch_in_record * 30 AS start_seconds,
  (qc.epoch_in_record + 1) * 30 AS end_seconds, r.name FROM qc JOIN {_RULES} ON r.channel = qc.channel AND (qc.flags >> (r.code - 1)) & 1 = 1""")
def a5(t):
    return rules.hard_events(qc(t))


@query("S9_gate_before_waveform", CTE + "SELECT recording_id, channel, count(*) AS epochs FROM live GROUP BY 1, 2")
def s9(t):
    """Each stored epoch is one chunk; the pipeline's own gate lets it through or not."""
    rows = epochs(t).withColumn("chunk_no", F.col("epoch_in_record"))
    lengths = rows.groupBy("recording_id").agg(F.lit(240.0).alias("duration_sec"), F.lit(8).alias("epoch_count"))
    passed = preprocess.accepted_chunks(processed(t), rows, lengths)
    return passed.groupBy("recording_id", "channel").agg(F.count("*").alias("epochs"))


@query("X6_cut_into_epochs", """SELECT vec_id, (k - 1)::INT AS epoch_in_record, round(list_sum(list_transform(embedding[(k-1)*16+1:k*16], lambda v: v::DOUBLE)), 6) AS total
  FROM embeddings, range(1, 5) t(k)""")
def x6(t):
    cut = F.posexplode(kernels.epochs_column(F.col("embedding"), 16, F.lit(4)))
    rows = t.embeddings.select("vec_id", cut.alias("epoch_in_record", "part"))
    return rows.select("vec_id", "epoch_in_record", F.round(
        F.aggregate("part", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"))


@query("W15_spectral_segments", """SELECT vec_id, s::INT AS segment_no, (s * 8)::INT AS first_sample,
  round(list_avg(list_transform(embedding[s*8+1:s*8+16], lambda v: v::DOUBLE)), 6) AS level FROM embeddings, range(7) t(s)""")
def w15(t):
    cut = F.posexplode(kernels.segments_column(F.col("embedding"), 16, 8))
    rows = t.embeddings.select("vec_id", cut.alias("segment_no", "part"))
    return rows.select("vec_id", "segment_no", (F.col("segment_no") * 8).alias("first_sample"), F.round(
        F.aggregate("part", F.lit(0.0), lambda a, v: a + v.cast("double")) / 16, 6).alias("level"))


@query("S15_synthetic_source", """SELECT r.c_custkey AS recording_no, c.ch::INT AS channel_idx, e::INT AS epoch_in_record,
  NOT (r.c_custkey % 2 = 1 AND c.ch = 5) AS available, 8 AS n_samples,
  CASE WHEN r.c_custkey % 2 = 1 AND c.ch = 5 THEN 8 ELSE 0 END AS nan_samples, c.ch = 14 OR NOT (r.c_custkey % 2 = 1 AND c.ch = 5) AS near_wave
  FROM customer r, range(15) c(ch), range(2 - r.c_custkey % 2) g(e)""")
def s15(t):
    rows = synthetic.synthetic_epochs(t.customer.select(F.col("c_custkey").alias("recording_no")), epochs=2,
                                      sample_rate=4, epoch_seconds=2)
    # Away from the noise, at most 0.05 times the square root of three, each sample is its channel's sine.
    place = m.channel_map({c: i + 1 for cs in m.GROUP_CHANNELS.values() for i, c in enumerate(cs)}, F.col("channel"))
    slow = lambda i: 95 + 2 * F.sin(2 * math.pi * 0.025 * i / 4 + F.col("recording_no"))
    wave = lambda i: F.when(F.col("channel") == "spo2", slow(i)).otherwise(F.sin(2 * math.pi * place * i / 4))
    near = F.forall(F.transform("samples", lambda v, i: F.abs(v.cast("double") - wave(i)) < 0.0867), lambda ok: ok)
    return rows.select("recording_no", "channel_idx", "epoch_in_record", "available", F.size("samples").alias("n_samples"),
                       F.size(F.filter("samples", F.isnan)).alias("nan_samples"), near.alias("near_wave"))


@query("F10_time_offsets", """SELECT conv_id, turn, turn * 30000000000 AS epoch_start_offset_ns,
  turn * 30000000000 + 15000000000 AS patch_end_ns FROM conversations""")
def f10(t):
    start = c.epoch_offset_ns(F.col("turn"))
    return t.conversations.select("conv_id", "turn", start.alias("epoch_start_offset_ns"),
                                  (start + 15_000_000_000).alias("patch_end_ns"))


@query("F11_bit_functions", """SELECT l_linenumber, l_quantity::INT AS flags, bit_or(1 << (l_linenumber - 1))::INT AS merged,
  bool_or((l_quantity::INT >> 2) & 1 = 1) AS has_saturation,
  max(CASE WHEN l_quantity::INT & 1 > 0 THEN 1 WHEN l_quantity::INT & 4 > 0 THEN 3 WHEN l_quantity::INT & 8 > 0 THEN 4 WHEN l_quantity::INT & 2 > 0 THEN 2
   WHEN l_quantity::INT & 16 > 0 THEN 5 WHEN l_quantity::INT & 32 > 0 THEN 6 ELSE 0 END) AS code FROM lineitem GROUP BY 1, 2""")
def f11(t):
    q = F.col("l_quantity").cast("int")
    return (t.lineitem.groupBy("l_linenumber", q.alias("flags"))
            .agg(F.bit_or(F.expr("shiftleft(1, l_linenumber - 1)")).alias("merged"),
                 F.bool_or(c.has_bit(q, 3)).alias("has_saturation"),
                 F.max(rules.primary_code(q)).alias("code")))


_PART_TEXT = ("CASE p_partkey % 6 WHEN 0 THEN concat('HP:', p_size, 'Hz LP:', p_size * 2, 'Hz N:60Hz')"
              " WHEN 1 THEN concat('hp ', p_size, ' hz, lp:35.5Hz NOTCH:50Hz') WHEN 2 THEN concat('HP:', p_size, 'Hz')"
              " WHEN 3 THEN concat('HP:1Hz LP:35Hz HP:', p_size % 2, 'Hz') WHEN 4 THEN concat('LP:-', p_size, 'Hz HP:1Hz') ELSE p_name END")
_PARSED = f"""WITH src AS (SELECT p_partkey, p_size, {_PART_TEXT} AS txt FROM part),
k AS (SELECT *, list_transform(regexp_extract_all(txt, '(?i)\\b(HP|LP)\\s*:?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*Hz', 1), lambda v: upper(v)) AS ks,
  list_transform(regexp_extract_all(txt, '(?i)\\b(HP|LP)\\s*:?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*Hz', 2), lambda v: v::DOUBLE) AS ns FROM src),
b AS (SELECT *, list_distinct(list_filter(ns, lambda v, i: ks[i] = 'HP')) AS hs, list_distinct(list_filter(ns, lambda v, i: ks[i] = 'LP')) AS ls FROM k),
r AS (SELECT *, len(hs) = 1 AND len(ls) = 1 AND hs[1] >= 0 AND ls[1] >= 0 AS ok FROM b)
"""


@query("F2_parse_prefilter_strict", _PARSED + "SELECT p_partkey, CASE WHEN ok THEN hs[1] END AS hp, CASE WHEN ok THEN ls[1] END AS lp FROM r")
def f2(t):
    rows = t.part.select("p_partkey", h.prefilter_band(F.expr(_PART_TEXT)).alias("band"))
    return rows.select("p_partkey", F.col("band.hp").alias("hp"), F.col("band.lp").alias("lp"))


@query("F3_parse_prefilter_lenient", _PARSED + """, g AS (SELECT p_partkey, txt, nullif(regexp_extract(txt, '(?i)\\bHP\\s*:?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*Hz', 1), '')::DOUBLE AS hp_hz,
  nullif(regexp_extract(txt, '(?i)\\bLP\\s*:?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*Hz', 1), '')::DOUBLE AS lp_hz,
  nullif(regexp_extract(txt, '(?i)\\bN\\s*:?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*Hz', 1), '')::DOUBLE AS notch_hz FROM r)
  SELECT p_partkey, hp_hz, lp_hz, notch_hz, coalesce(hp_hz, lp_hz, notch_hz) IS NOT NULL AS filter_parse_ok FROM g""")
def f3(t):
    return t.part.select("p_partkey", *[v.alias(k) for k, v in h.prefilter_first(F.expr(_PART_TEXT)).items()])


@query("F4_notch_list", _PARSED + """SELECT p_partkey, list_transform(regexp_extract_all(txt, '(?i)\\b(?:N|NOTCH)\\s*:?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*Hz', 1), lambda v: v::DOUBLE)[1] AS first_notch,
  len(regexp_extract_all(txt, '(?i)\\b(?:N|NOTCH)\\s*:?\\s*([-+]?\\d+(?:\\.\\d+)?)\\s*Hz', 1)) AS notches FROM r""")
def f4(t):
    n = h.notch_list(F.expr(_PART_TEXT))
    return t.part.select("p_partkey", F.get(n, 0).alias("first_notch"), F.size(n).alias("notches"))


_UNIT_TEXT = "CASE p_size % 6 WHEN 0 THEN ' uV ' WHEN 1 THEN 'µV' WHEN 2 THEN 'MV' WHEN 3 THEN 'microvolts' WHEN 4 THEN 'v' ELSE p_type END"


@query("F5_unit_scale", f"""SELECT p_partkey, replace(replace(lower(trim({_UNIT_TEXT})), 'µ', 'u'), 'μ', 'u') AS unit,
  CASE replace(replace(lower(trim({_UNIT_TEXT})), 'µ', 'u'), 'μ', 'u') WHEN 'uv' THEN 1::DOUBLE WHEN 'microvolts' THEN 1::DOUBLE
   WHEN 'mv' THEN 1000::DOUBLE WHEN 'v' THEN 1000000::DOUBLE END AS scale FROM part""")
def f5(t):
    u = F.expr(_UNIT_TEXT)
    return t.part.select("p_partkey", h.unit_name(u).alias("unit"), h.unit_scale(u).alias("scale"))


@query("F8_release_split", """SELECT c_custkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT c_custkey, ('0x' || substr(sha256('42:nights:' || c_custkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 AS u FROM customer)""")
def f8(t):
    return t.customer.select("c_custkey", c.release_split("nights", F.col("c_custkey")).alias("split"))


@query("F9_raw_split", """SELECT c_custkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT c_custkey, ('0x' || substr(sha256('7:' || c_custkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 AS u FROM customer)""")
def f9(t):
    return t.customer.select("c_custkey", c.raw_split(F.col("c_custkey"), 7, (0.7, 0.15, 0.15)).alias("split"))


@query("F15_dictionary_lookup", """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'SMALL' THEN 2 END AS code FROM part""")
def f15(t):
    return t.part.select("p_partkey", m.channel_map({"ECONOMY": 1, "SMALL": 2}, F.col("p_type")).alias("code"))


@query("W1_epoch_grid", """SELECT o_orderkey, e AS epoch_in_record, e * 3600000000000 AS epoch_start_offset_ns
  FROM orders, range(CAST(floor(o_totalprice / 36000) AS BIGINT)) g(e)""")
def w1(t):
    rows = t.orders.select("o_orderkey", (F.col("o_totalprice") / 10).alias("d"))
    return grid.epoch_grid(rows, ["o_orderkey"], grid.epoch_count(F.col("d"), 3600.0), 3600.0)
