"""Label operators on conversations (turns as epochs) and events (timed annotations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.operators import audits, grid, labels
from nightgrid.operators.scan import islands
from nightgrid.plans import preprocess
from nightgrid.plans.registry import Tables, query

# One label row per turn; the role is the stage token and the text length drives the numbers.
_LABEL = [
    "conv_id AS recording_id", "CAST(turn + 1 AS STRING) AS Epoch",
    "CASE WHEN length(text) % 17 = 0 THEN ' ' WHEN role = 'user' THEN 'w' WHEN role = 'assistant' THEN ' N2 ' ELSE 'L' END AS Stage",
    "CASE WHEN length(text) % 19 = 0 THEN '0' ELSE CAST(60 + length(text) % 50 AS STRING) END AS `Heart Rate Max`",
    "CAST(40 + length(text) % 30 AS STRING) AS `Heart Rate Min`",
    "CAST(52 + length(text) % 15 AS STRING) AS `Heart Rate Avg`",
    "CAST(90 + length(text) % 13 AS STRING) AS `SaO2 Max`",
    "CASE WHEN length(text) % 10 = 0 THEN 'x' ELSE CAST(80 + length(text) % 15 AS STRING) END AS `SaO2 Min`",
]
_EVENT = [
    "conv_id AS recording_id", "CAST(turn AS INT) AS event_idx",
    "CASE WHEN (conv_id + turn) % 31 = 3 THEN CAST('NaN' AS DOUBLE) ELSE CAST(turn * 30 + CASE WHEN (conv_id + turn) % 9 = 0 THEN 10 WHEN turn % 5 = 4 THEN -30 ELSE 0 END AS DOUBLE) END AS start_s",
    "CASE WHEN (conv_id + turn) % 29 = 5 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(turn * 30 + CASE WHEN (conv_id + turn) % 11 = 0 THEN -60 WHEN turn % 3 = 0 THEN 60 ELSE 30 END AS DOUBLE) END AS end_s",
    "CASE role WHEN 'user' THEN 5 WHEN 'assistant' THEN 2 ELSE 1 END AS code",
]


def label_rows(t: Tables) -> DataFrame:
    return t.conversations.selectExpr(*_LABEL)


def events(t: Tables) -> DataFrame:
    return t.conversations.selectExpr(*_EVENT)


def records(t: Tables) -> DataFrame:
    """Grid lengths: one epoch too few, exact, or one too many."""
    return (t.conversations.groupBy(F.col("conv_id").alias("recording_id"))
            .agg((F.max("turn") + 1).alias("_n"))
            .select("recording_id", (F.col("_n") + F.col("recording_id") % 3 - 1).alias("n_epochs")))


def slots(t: Tables) -> DataFrame:
    return grid.epoch_grid(records(t), ["recording_id"], F.col("n_epochs"))


def keyed(t: Tables) -> DataFrame:
    return labels.keyed_labels(label_rows(t))


def labelled(t: Tables) -> DataFrame:
    return labels.label_epochs(slots(t), keyed(t))


def overlaid(t: Tables) -> DataFrame:
    return labels.overlay_events(labelled(t), labels.event_epochs(events(t), records(t)))


_Q = [e.replace("`", '"').replace(" AS STRING)", " AS VARCHAR)") for e in _LABEL]
_CODE = "CASE WHEN NOT present THEN 1 WHEN {v} IS NULL OR {v} = 0 THEN 2 WHEN {v} NOT BETWEEN {lo} AND {hi} THEN 3 ELSE 0 END"
_HR = {f: _CODE.format(v=f, lo=20, hi=300) for f in ("max_bpm", "min_bpm", "mean_bpm")}
_SA = {f: _CODE.format(v=f, lo=20, hi=100) for f in ("max_percent", "min_percent")}
CTE = f"""WITH lab AS (SELECT {', '.join(_Q)}, turn AS epoch_in_record FROM conversations),
evt AS (SELECT {', '.join(_EVENT)} FROM conversations),
rec AS (SELECT conv_id AS recording_id, max(turn) + 1 + conv_id % 3 - 1 AS n_epochs FROM conversations GROUP BY 1),
slot AS (SELECT recording_id, e AS epoch_in_record FROM rec, range(rec.n_epochs) g(e)),
j AS (SELECT s.recording_id, s.epoch_in_record, lab.recording_id IS NOT NULL AS present, trim(Stage) AS tok,
  CASE upper(trim(Stage)) WHEN 'W' THEN 5 WHEN 'N2' THEN 2 ELSE 0 END AS stage,
  TRY_CAST("Heart Rate Max" AS DOUBLE) AS max_bpm, TRY_CAST("Heart Rate Min" AS DOUBLE) AS min_bpm, TRY_CAST("Heart Rate Avg" AS DOUBLE) AS mean_bpm,
  TRY_CAST("SaO2 Max" AS DOUBLE) AS max_percent, TRY_CAST("SaO2 Min" AS DOUBLE) AS min_percent,
  Stage AS t_stage, "Heart Rate Max" AS t_max_bpm, "Heart Rate Min" AS t_min_bpm, "Heart Rate Avg" AS t_mean_bpm, "SaO2 Max" AS t_max_percent, "SaO2 Min" AS t_min_percent
  FROM slot s LEFT JOIN lab USING (recording_id, epoch_in_record)),
k AS (SELECT *, CASE WHEN NOT present THEN 1 WHEN stage > 0 THEN 0 WHEN tok = '' THEN 2 ELSE 3 END AS c_stage,
  {', '.join(f'{v} AS r_{k}' for k, v in {**_HR, **_SA}.items())} FROM j),
o AS (SELECT *, r_max_bpm + r_min_bpm + r_mean_bpm = 0 AND NOT (min_bpm <= mean_bpm AND mean_bpm <= max_bpm) AS hr_swap,
  r_max_percent + r_min_percent = 0 AND NOT (min_percent <= max_percent) AS sa_swap FROM k),
base AS (SELECT *, {', '.join(f'CASE WHEN hr_swap THEN 4 ELSE r_{f} END AS c_{f}' for f in _HR)},
  {', '.join(f'CASE WHEN sa_swap THEN 4 ELSE r_{f} END AS c_{f}' for f in _SA)} FROM o),
ok AS (SELECT evt.*, TRY_CAST(round_even(start_s / 30, 0) AS BIGINT) AS first, TRY_CAST(least(n_epochs, floor((end_s + 1e-6) / 30)) AS BIGINT) AS stop
  FROM evt JOIN rec USING (recording_id) WHERE isfinite(start_s) AND isfinite(end_s) AND start_s >= 0 AND start_s % 30 = 0 AND end_s > start_s),
ev AS (SELECT recording_id, e AS epoch_in_record, arg_max(code, event_idx) AS event_code, count(DISTINCT code) > 1 AS event_conflict
  FROM ok, range(first, stop) g(e) WHERE first < stop GROUP BY 1, 2),
ov AS (SELECT base.*, event_code, coalesce(event_conflict, false) AS event_conflict, present AND event_code IS NULL AS time_unverified,
  coalesce(c_stage = 0 AND NOT coalesce(event_conflict, false) AND event_code <> stage, false) AS stage_mismatch
  FROM base LEFT JOIN ev USING (recording_id, epoch_in_record)),
fin AS (SELECT *, c_stage = 0 AND NOT time_unverified AND NOT event_conflict AND NOT stage_mismatch AS known_anchor,
  CASE WHEN c_stage <> 0 THEN c_stage WHEN time_unverified THEN 5 WHEN event_conflict THEN 6 WHEN stage_mismatch THEN 7 ELSE 0 END AS f_stage,
  {', '.join(f'CASE WHEN c_{f} = 0 AND time_unverified THEN 5 ELSE c_{f} END AS f_{f}' for f in (*_HR, *_SA))} FROM ov),
te AS (SELECT recording_id, epoch_in_record, 'sleep_stage' AS task, f_stage AS qc_code FROM fin UNION ALL
  SELECT recording_id, epoch_in_record, 'heart_rate', coalesce(least(nullif(f_max_bpm, 0), nullif(f_min_bpm, 0), nullif(f_mean_bpm, 0)), 0) FROM fin UNION ALL
  SELECT recording_id, epoch_in_record, 'sao2', coalesce(least(nullif(f_max_percent, 0), nullif(f_min_percent, 0)), 0) FROM fin)
"""
_FIELD_UNION = " UNION ALL ".join(
    f"SELECT recording_id, epoch_in_record, '{t}' AS task, '{f}' AS field, "
    f"CASE WHEN present THEN coalesce(nullif(t_{f}, ''), '<empty>') ELSE '<epoch missing>' END AS token, f_{f} AS field_qc_code FROM fin"
    for t, f in labels.FIELDS)
_E = "recording_id, epoch_in_record"


@query("S7_label_scan_errors", """WITH src AS (SELECT conv_id AS recording_id, CASE WHEN conv_id % 7 = 0 THEN CAST(turn // 2 + 1 AS VARCHAR)
   WHEN conv_id % 7 = 1 AND turn = 1 THEN '1.5' WHEN conv_id % 7 = 2 AND turn = 0 THEN '0' ELSE ' ' || (turn + 1) END AS ep FROM conversations),
 k AS (SELECT recording_id, CASE WHEN regexp_full_match(ep, '\\s*[+-]?\\d+\\s*') AND ep::INT >= 1 THEN ep::INT END AS e, count(*) AS n FROM src GROUP BY 1, 2)
 SELECT recording_id, 'labels' AS stage, 'TASK_EPOCH_KEY_MISMATCH' AS code, CASE WHEN bool_or(e IS NULL) THEN 'invalid source epoch' ELSE 'duplicate source epoch' END AS detail
 FROM k WHERE e IS NULL OR n > 1 GROUP BY 1""")
def s7(t):
    text = ("CASE WHEN conv_id % 7 = 0 THEN CAST(floor(turn / 2) + 1 AS STRING) WHEN conv_id % 7 = 1 AND turn = 1 THEN '1.5'"
            " WHEN conv_id % 7 = 2 AND turn = 0 THEN '0' ELSE concat(' ', turn + 1) END AS Epoch")
    return labels.label_key_errors(t.conversations.selectExpr("conv_id AS recording_id", text))


@query("S7_rejected_recordings", CTE + """, src AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN CAST(turn // 2 + 1 AS VARCHAR) ELSE CAST(turn + 1 AS VARCHAR) END AS ep FROM conversations WHERE conv_id % 17 <> 2),
 ec AS (SELECT * FROM evt WHERE recording_id % 13 <> 5),
 er AS (SELECT DISTINCT conv_id AS recording_id, 'duplicate source epoch' AS detail FROM (SELECT conv_id, ep FROM src GROUP BY 1, 2 HAVING count(*) > 1)
   UNION ALL SELECT recording_id, 'no label rows' FROM rec WHERE recording_id % 17 = 2 UNION ALL SELECT recording_id, 'no stage grid' FROM rec WHERE recording_id % 13 = 5
   UNION ALL SELECT DISTINCT recording_id, 'nonfinite event time' FROM ec WHERE NOT isfinite(start_s) OR NOT isfinite(end_s)
   UNION ALL SELECT recording_id, 'stage map' FROM rec WHERE recording_id % 19 = 4)
 SELECT recording_id, detail, 0::BIGINT AS task_rows FROM er UNION ALL SELECT recording_id, NULL, 3 * n_epochs FROM rec WHERE n_epochs > 0 AND recording_id NOT IN (SELECT recording_id FROM er)""")
def s7b(t):
    """The whole label path: every kind of failure, and no task row of a recording that has one."""
    epoch = "CASE WHEN conv_id % 7 = 0 THEN CAST(floor(turn / 2) + 1 AS STRING) ELSE CAST(turn + 1 AS STRING) END AS Epoch"
    rows = t.conversations.where("conv_id % 17 <> 2").selectExpr(*[epoch if "AS Epoch" in e else e for e in _LABEL])
    names = "CASE WHEN recording_id % 19 = 4 THEN 'N4' ELSE 'N3' END"
    maps = records(t).select("recording_id", F.expr(f"""concat('{{"1":"', {names}, '","2":"N2","3":"N1","4":"REM","5":"Wake"}}')""").alias("event_map"))
    out = preprocess.label_tables(records(t).withColumnRenamed("n_epochs", "epoch_count"), rows, events(t).where("recording_id % 13 <> 5"), maps)
    kept = out["task_epochs"].groupBy("recording_id").agg(F.lit(None).cast("string").alias("detail"), F.count("*").alias("task_rows"))
    return out["errors"].select("recording_id", "detail", F.lit(0).cast("bigint").alias("task_rows")).unionByName(kept)


@query("S8_stage_event_scan", """SELECT vec_id AS recording_id, (i - 1)::INT AS event_idx, (i - 1) * 30::DOUBLE AS start_s, 30::DOUBLE AS duration_s,
  round_even(embedding[i]::DOUBLE * 10, 0)::INT AS code FROM embeddings, range(1, 65) g(i)""")
def s8(t):
    codes = F.transform("embedding", lambda v: F.rint(v.cast("double") * 10).cast("int"))
    starts = F.transform("embedding", lambda v, i: (i * 30).cast("double"))
    rows = t.embeddings.select(F.col("vec_id").alias("recording_id"), starts.alias("starts"), codes.alias("codes"))
    return labels.events_from_arrays(rows)


@query("J6_labels_on_grid", CTE + f"SELECT {_E}, present AS label_present, c_stage AS code_stage FROM base")
def j6(t):
    return labelled(t).select("recording_id", "epoch_in_record", "label_present", "code_stage")


@query("J7_events_on_grid", CTE + f"SELECT {_E}, event_code, event_conflict FROM ev")
def j7(t):
    return labels.event_epochs(events(t), records(t))


@query("L1_stage_token", CTE + f"SELECT {_E}, stage::INT AS stage, c_stage AS code FROM base")
def l1(t):
    return labelled(t).select("recording_id", "epoch_in_record", F.col("value_stage").cast("int").alias("stage"),
                              F.col("code_stage").alias("code"))


@query("L2_numeric_field_check", """SELECT event_id, CASE WHEN value IS NULL OR value = 0 THEN 2 WHEN value NOT BETWEEN 20 AND 300 THEN 3 ELSE 0 END AS hr_code,
  CASE WHEN value IS NULL OR value = 0 THEN 2 WHEN value NOT BETWEEN 20 AND 100 THEN 3 ELSE 0 END AS sao2_code FROM events""")
def l2(t):
    v = labels.number_value(F.col("value").cast("string"))
    return t.events.select("event_id", labels.number_code(v, "heart_rate").alias("hr_code"),
                           labels.number_code(v, "sao2").alias("sao2_code"))


@query("L3_field_order", CTE + f"SELECT {_E}, c_max_bpm AS code_max_bpm, c_min_bpm AS code_min_bpm, c_mean_bpm AS code_mean_bpm, c_max_percent AS code_max_percent, c_min_percent AS code_min_percent FROM base")
def l3(t):
    return labelled(t).select("recording_id", "epoch_in_record", "code_max_bpm", "code_min_bpm", "code_mean_bpm",
                              "code_max_percent", "code_min_percent")


@query("L4_primary_code", CTE + f"SELECT {_E}, task, qc_code, qc_code = 0 AS valid FROM te")
def l4(t):
    return labels.task_epochs(overlaid(t))


@query("L5_time_grid_overlay", CTE + f"SELECT {_E}, time_unverified, event_conflict, stage_mismatch, f_stage AS code_stage, f_max_bpm AS code_max_bpm FROM fin")
def l5(t):
    return overlaid(t).select("recording_id", "epoch_in_record", "time_unverified", "event_conflict",
                              "stage_mismatch", "code_stage", "code_max_bpm")


@query("L6_event_resolution", """SELECT user_id AS recording_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS epoch_in_record,
  arg_max(event_type, event_id) AS event_code, count(DISTINCT event_type) > 1 AS event_conflict FROM events GROUP BY 1, 2""")
def l6(t):
    """Each event stands on its own hour, written as one epoch of the grid."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    rows = t.events.select(F.col("user_id").alias("recording_id"), (slot * 30.0).alias("start_s"), ((slot + 1) * 30.0).alias("end_s"),
                           F.col("event_type").alias("code"), F.col("event_id").alias("event_idx"))
    lengths = rows.groupBy("recording_id").agg((F.max("end_s") / 30).cast("bigint").alias("n_epochs"))
    return labels.event_epochs(rows, lengths)


_MAP = ("concat('{\"0\":\"Unknown\",\"1\":\"N3\",\"2\":\"n2\",\"3\":\"N1\",\"4\":\"REM\",\"5\":\"', "
        "CASE WHEN c_custkey % 4 = 0 THEN 'Awake' ELSE 'Wake' END, '\"}')")


@query("L7_event_map_guard", """SELECT c_custkey AS recording_id, 'labels' AS stage, 'TASK_EPOCH_KEY_MISMATCH' AS code, 'stage map' AS detail
  FROM customer WHERE c_custkey % 4 = 0 OR c_nationkey = 3""")
def l7(t):
    maps = t.customer.selectExpr("c_custkey AS recording_id", f"CASE WHEN c_nationkey <> 3 THEN {_MAP} END AS event_map")
    return labels.event_map_errors(maps)


def alignment(t: Tables) -> DataFrame:
    return labels.alignment_summary(overlaid(t), labels.event_defects(events(t)))


_ALIGN = """, al AS (SELECT recording_id, count(*) FILTER (known_anchor) AS known_anchors, count(*) FILTER (time_unverified) AS time_unverified_epochs,
  count(*) FILTER (event_conflict) AS event_conflict_epochs, count(*) FILTER (stage_mismatch) AS stage_mismatch_epochs,
  CASE WHEN bool_or(time_unverified OR event_conflict OR stage_mismatch) THEN 'PARTIAL' ELSE 'PASS' END AS status FROM fin GROUP BY 1),
df AS (SELECT recording_id, count(*) FILTER (isfinite(start_s) AND isfinite(end_s) AND (start_s < 0 OR start_s % 30 <> 0)) AS off_grid_events,
  count(*) FILTER (isfinite(start_s) AND isfinite(end_s) AND start_s >= 0 AND start_s % 30 = 0 AND end_s <= start_s) AS nonpositive_events,
  count(*) FILTER (NOT isfinite(start_s) OR NOT isfinite(end_s)) AS nonfinite_events FROM evt GROUP BY 1)
"""


@query("L8_alignment_summary", CTE + _ALIGN + "SELECT * FROM al JOIN df USING (recording_id)")
def l8(t):
    return alignment(t)


@query("L8_alignment_defects", CTE + f"""SELECT {_E}, 5 AS code FROM fin WHERE time_unverified UNION ALL SELECT {_E}, 6 FROM fin WHERE event_conflict
  UNION ALL SELECT {_E}, 7 FROM fin WHERE stage_mismatch""")
def l8b(t):
    return labels.alignment_defects(overlaid(t))


_STRUCT = """, sx AS (SELECT recording_id, count(*) FILTER (l IS NOT NULL) AS source_rows, count(*) FILTER (l IS NULL) AS missing_signal_epochs,
  count(*) FILTER (g IS NULL) AS extra_source_epochs FROM (SELECT recording_id, epoch_in_record, 1 AS g FROM slot) a
  FULL JOIN (SELECT recording_id, epoch_in_record, 1 AS l FROM lab) b USING (recording_id, epoch_in_record) GROUP BY 1),
st AS (SELECT *, CASE WHEN missing_signal_epochs + extra_source_epochs > 0 THEN 1 ELSE 0 END AS structure_code FROM sx)
"""


@query("L9_structure_code", CTE + _STRUCT + """SELECT *, CASE structure_code WHEN 1 THEN 'TASK_SOURCE_COVERAGE_MISMATCH' ELSE 'TASK_STRUCTURE_PASS' END AS structure FROM st""")
def l9(t):
    return labels.label_structure(slots(t), keyed(t))


@query("A6_task_code_distribution", CTE + """SELECT c.task, c.qc_code, c.name, count(te.task) AS epochs,
  count(te.task) / any_value(n)::DOUBLE AS fraction FROM (VALUES """ + ",".join(
    f"('{t}',{c},'{n}')" for t in m.TASK_FIELDS for c, n in m.TASK_QC.items()) + """) AS c(task, qc_code, name)
  LEFT JOIN te ON te.task = c.task AND te.qc_code = c.qc_code JOIN (SELECT task, count(*) AS n FROM te GROUP BY 1) a ON a.task = c.task GROUP BY ALL""")
def a6(t):
    return labels.code_distribution(labels.task_epochs(overlaid(t)))


@query("A6_task_totals", CTE + "SELECT task, count(*) FILTER (qc_code = 0) AS valid_epochs, count(*) FILTER (qc_code <> 0) AS excluded_epochs FROM te GROUP BY 1")
def a6b(t):
    return labels.task_totals(labels.task_epochs(overlaid(t)))


@query("A7_task_processing", CTE + _ALIGN + _STRUCT + "SELECT recording_id, task, count(*) AS n_epochs, " + ", ".join(
    f"count(*) FILTER (qc_code = {c}) AS code_{c}" for c in m.TASK_QC) + """, any_value(source_rows) AS source_rows, any_value(missing_signal_epochs) AS missing_signal_epochs,
  any_value(extra_source_epochs) AS extra_source_epochs, any_value(structure_code) AS structure_code, any_value(status) AS status, any_value(known_anchors) AS known_anchors
  FROM te JOIN st USING (recording_id) JOIN al USING (recording_id) GROUP BY 1, 2""")
def a7(t):
    return labels.task_processing(labels.task_epochs(overlaid(t)), labels.label_structure(slots(t), keyed(t)), alignment(t))


@query("A8_token_ranking", CTE + f""", f AS ({_FIELD_UNION}), n AS (SELECT epoch_in_record AS slot_no, task, field, field_qc_code, token, count(*) AS n FROM f
  WHERE field_qc_code <> 0 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY slot_no, task, field, field_qc_code ORDER BY n DESC, token)::INT AS rank
  FROM n QUALIFY row_number() OVER (PARTITION BY slot_no, task, field, field_qc_code ORDER BY n DESC, token) <= 8""")
def a8(t):
    f = labels.task_fields(overlaid(t)).withColumnRenamed("epoch_in_record", "slot_no")
    return labels.token_ranking(f, ["slot_no"])


@query("W6_gaps_and_islands", """WITH e AS (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h FROM events),
  g AS (SELECT *, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS grp FROM e),
  r AS (SELECT user_id, min(h) AS first, max(h) AS last FROM g GROUP BY user_id, grp),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first)::INT AS span_no, count(*) OVER (PARTITION BY user_id) AS span_count FROM r)
  SELECT user_id, span_no, span_count, first * 30 AS start_seconds, (last + 1) * 30 AS end_seconds FROM k WHERE span_no <= 8""")
def w6(t):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return labels.defect_ranges(t.events.select("user_id", hour.alias("h")), ["user_id"], "h")


@query("W6_islands_across_buckets", """WITH e AS (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 43200000000) AS BIGINT) AS h FROM events),
  g AS (SELECT *, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS grp FROM e)
  SELECT user_id, min(h) AS first, max(h) AS last FROM g GROUP BY user_id, grp""")
def w6b(t):
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 43_200_000_000)
    return islands(t.events.select("user_id", slot.alias("h")), ["user_id"], "h", width=4)


@query("J8_point_in_interval", """WITH e AS (SELECT user_id AS recording_id, event_id, epoch_us(ts) / 1e6 - 1704067200 AS s, value * 100 AS d, event_type AS code FROM events),
  c AS (SELECT recording_id, g.k AS epoch_in_record, (g.k + 5e-1) * 21600 AS centre FROM (SELECT recording_id, greatest(0, ceil(max(s) / 21600))::BIGINT + 1 AS n FROM e GROUP BY 1), range(n) g(k)),
  a AS (SELECT c.recording_id, c.epoch_in_record, c.centre, arg_max(e.s, (e.s, e.event_id)) AS s, arg_max(e.d, (e.s, e.event_id)) AS d, arg_max(e.code, (e.s, e.event_id)) AS code
   FROM c LEFT JOIN e ON e.recording_id = c.recording_id AND e.s <= c.centre GROUP BY 1, 2, 3)
  SELECT recording_id, epoch_in_record, CASE WHEN centre < s + d + 1e-6 THEN code ELSE '-1' END AS stage, coalesce(centre < s + d + 1e-6, false) AS stage_mask FROM a""")
def j8(t):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - 1704067200
    e = t.events.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("event_idx"), sec.alias("start_s"),
                        (F.col("value") * 100).alias("duration_s"), F.col("event_type").alias("code"))
    # As many slots as the recording's own events reach, and one after them.
    reach = F.greatest(F.lit(0), F.ceil(F.max("start_s") / 21600)).cast("int")
    centres = (e.groupBy("recording_id").agg(reach.alias("last"))
               .select("recording_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("epoch_in_record"))
               .withColumn("centre_s", (F.col("epoch_in_record") + F.lit(0.5)) * 21600))
    return labels.as_of_stage(e, centres)


@query("V9_task_code_audit", CTE + f"""SELECT {_E}, task, 'qc_code' AS problem FROM te WHERE qc_code = 7 AND task = 'sleep_stage'""")
def v9(t):
    """Clean rows pass; stage mismatches relabelled as a numeric task must be reported."""
    te = labels.task_epochs(overlaid(t))
    moved = te.withColumn("qc_code", F.when(F.col("qc_code") == 7, 8).otherwise(F.col("qc_code")))
    return audits.task_code_violations(moved).where("problem = 'qc_code'")
