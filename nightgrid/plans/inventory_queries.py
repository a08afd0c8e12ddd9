"""Inventory operators: customers as patients, orders as sessions, line items as channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions import columns as c
from nightgrid.functions import headers as h
from nightgrid.operators import inventory as inv
from nightgrid.plans.registry import Tables, query
from nightgrid.session import scratch_path
from nightgrid.sources import files

_D = "o_totalprice / CAST(8 AS DOUBLE) - 1000"
_SESSION = [
    "o_orderkey AS session_key", "o_custkey AS patient_id", "o_custkey AS subject_id", "o_orderkey % 3 AS session_id",
    "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE concat('on ', CAST(CAST(o_orderdate AS DATE) AS STRING)) END AS metadata_start",
    f"{_D} AS metadata_duration_seconds", "o_orderkey % 50 <> 0 AS h5_exists", "o_orderkey % 20 <> 0 AS edf_exists",
    "o_orderpriority <> '5-LOW' AS channels_tsv_exists", "o_orderkey % 3 <> 0 AS bids_json_exists",
    "o_orderstatus <> 'P' AS manual_sleep_csv_exists",
    "CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey * 1000 + 500000 END AS h5_bytes",
    "CASE WHEN o_orderkey % 20 <> 0 THEN o_custkey * 3000 + 700000 END AS edf_bytes",
    f"CASE WHEN o_orderkey % 50 <> 0 THEN {_D} + CASE o_orderkey % 10 WHEN 1 THEN 40 WHEN 2 THEN 2 ELSE 0 END END AS h5_duration_seconds",
    f"CASE WHEN o_orderkey % 20 <> 0 THEN {_D} + CASE o_orderkey % 11 WHEN 0 THEN -35 WHEN 1 THEN 1 ELSE 0 END END AS edf_duration_seconds",
    "CASE WHEN o_orderkey % 97 = 5 THEN 'OSError: truncated' END AS h5_error",
    "CASE WHEN o_orderkey % 89 = 5 THEN 'ValueError: header' END AS edf_error",
    "CASE WHEN o_orderkey % 83 = 5 THEN 'ValueError: tsv' END AS tsv_error",
    "CASE WHEN o_orderkey % 79 = 5 THEN 'ValueError: json' END AS bids_json_error",
    "CAST(CASE WHEN o_orderkey % 61 = 3 THEN 0 ELSE o_custkey END AS STRING) AS h5_subject_id", "CAST(o_orderkey % 3 AS STRING) AS h5_session_id",
    "o_orderpriority AS manufacturer", "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN '50' ELSE '60' END AS power_line_frequency",
    "CAST(o_orderkey % 30 AS DOUBLE) / 4 AS bids_sampling_frequency", "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 25 END AS edf_signal_count",
]
_CHANNEL = [
    "l_orderkey AS session_key", "CASE l_returnflag WHEN 'R' THEN 'h5' WHEN 'A' THEN 'edf' ELSE 'tsv' END AS source",
    # Orders repeat line numbers, so the position inside the file has to tell all rows apart.
    "CAST(floor(l_extendedprice * 100 + 5e-1) AS BIGINT) * 1000000000 + (l_partkey * 1000 + l_suppkey) % 1000000000 AS channel_no",
    "CASE l_linenumber WHEN 1 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'F3_M2' ELSE ' f3–m2 ' END WHEN 2 THEN 'E1' WHEN 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'ECG' ELSE 'EKG' END"
    " WHEN 4 THEN CASE WHEN l_suppkey % 3 = 0 THEN 'chin' ELSE 'Chin1 - Chin2' END WHEN 5 THEN CASE l_suppkey % 3 WHEN 0 THEN 'Airflow' WHEN 1 THEN 'PTAF' ELSE 'npt' END"
    " WHEN 6 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'SpO2' ELSE 'SaO2' END ELSE 'Position' END AS raw_channel",
    "CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'uV' WHEN 2 THEN 'UV' ELSE 'mV' END AS unit",
    "CAST(CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 500 WHEN 2 THEN 200.0000001 ELSE 200 END AS DOUBLE) AS fs_hz",
    "CASE WHEN l_partkey % 11 <> 0 THEN l_discount END AS hp_hz", "30 + l_tax AS lp_hz",
    "CAST(CASE WHEN l_partkey % 3 = 0 THEN 60 END AS DOUBLE) AS notch_hz", "l_partkey % 11 <> 0 AS filter_parse_ok",
    "CAST(CASE WHEN l_partkey % 17 <> 0 THEN -32768 END AS DOUBLE) AS dig_min", "CAST(CASE WHEN l_partkey % 19 <> 0 THEN 32767 END AS DOUBLE) AS dig_max",
    "CAST(CASE WHEN l_partkey % 23 <> 0 THEN CASE WHEN l_suppkey % 5 = 0 THEN -1600 ELSE -3200 END END AS DOUBLE) AS phys_min",
    "CAST(CASE WHEN l_suppkey % 5 = 0 THEN 1600 ELSE 3200 END AS DOUBLE) AS phys_max",
    "l_quantity * 700 AS duration_seconds", "CASE WHEN l_suppkey % 6 = 0 THEN 'float32' ELSE 'int16' END AS dtype",
    "CASE WHEN l_linestatus = 'O' THEN 'digital' ELSE '' END AS value_domain",
    "concat('HP:', CAST(l_quantity AS INT) % 5, 'Hz') AS prefilter_raw",
]


def sessions(t: Tables) -> DataFrame:
    return t.orders.selectExpr(*_SESSION)


def raw_channels(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*_CHANNEL)


def channels(t: Tables) -> DataFrame:
    return inv.select_preferred(inv.identify(raw_channels(t)))


def chosen(t: Tables) -> DataFrame:
    """Selected rows only; reports that ignore the other candidates start here."""
    return inv.preferred(inv.identify(raw_channels(t)))


def named(t: Tables) -> DataFrame:
    return inv.identify(raw_channels(t))


def total(t: Tables) -> DataFrame:
    return inv.session_total(t.orders)


_NORM = "replace(replace(replace(regexp_replace(lower(trim(raw_channel)), '\\s+', '', 'g'), '–', '-'), '—', '-'), '_', '-')"
CTE = f"""WITH ses AS (SELECT {', '.join(_SESSION)} FROM orders),
c0 AS (SELECT {', '.join(_CHANNEL)} FROM lineitem),
c1 AS (SELECT *, {_NORM} AS normalised_channel FROM c0),
c2 AS (SELECT *, CASE normalised_channel WHEN 'f3-m2' THEN 'f3-m2' WHEN 'e1' THEN 'e1' WHEN 'ecg' THEN 'ecg' WHEN 'ekg' THEN 'ecg' WHEN 'chin' THEN 'chin1-chin2'
  WHEN 'chin1-chin2' THEN 'chin1-chin2' WHEN 'airflow' THEN 'airflow' WHEN 'npt' THEN 'airflow' WHEN 'ptaf' THEN 'airflow' WHEN 'spo2' THEN 'spo2' WHEN 'sao2' THEN 'spo2' ELSE '' END AS canonical_channel,
  CASE normalised_channel WHEN 'ekg' THEN 1 WHEN 'chin' THEN 1 WHEN 'npt' THEN 1 WHEN 'ptaf' THEN 2 WHEN 'sao2' THEN 1 ELSE 0 END AS alias_rank FROM c1),
ch AS (SELECT *, canonical_channel <> '' AND row_number() OVER (PARTITION BY session_key, source, canonical_channel ORDER BY alias_rank, normalised_channel, channel_no) = 1 AS selected_for_model FROM c2),
sel AS (SELECT *, canonical_channel AS channel FROM ch WHERE selected_for_model),
he AS (SELECT * FROM sel WHERE source IN ('h5', 'edf')),
tot AS (SELECT count(*) AS total FROM orders),
names(channel) AS (VALUES {','.join(f"('{x}')" for x in m.CHANNELS)})
"""
_PCT = "100 * {} / nullif({}, 0)::DOUBLE"


@query("S5_channels_tsv_scan", """SELECT p_partkey, trim(p_name) AS raw_channel, p_type AS channel_type, p_size::DOUBLE AS fs_hz, CASE WHEN p_size % 3 > 0 THEN p_size / 2::DOUBLE END AS hp_hz, NULL::DOUBLE AS lp_hz,
  p_size % 3 > 0 AS filter_parse_ok, CASE WHEN p_size % 3 > 0 THEN 'HP:' || p_size / 2::DOUBLE || ' LP:None' ELSE 'HP:None LP:None' END AS prefilter_raw FROM part WHERE p_size % 10 <> 0""")
def s5(t):
    path = scratch_path(t.spark, "tsv")
    rows = t.part.select(
        "p_partkey", F.when(F.col("p_size") % 10 == 0, "  ").otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("type"),
        F.lit(" uV").alias("units"), F.col("p_size").cast("string").alias("sampling_frequency"),
        F.when(F.col("p_size") % 3 > 0, (F.col("p_size") / 2).cast("string")).otherwise("n/a").alias("lowcutoff"), F.lit("inf").alias("high_cutoff"))
    rows.write.option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)
    back = files.read_channels_tsv(t.spark, path)
    return back.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "raw_channel", "channel_type", "fs_hz", "hp_hz", "lp_hz", "filter_parse_ok", "prefilter_raw")


@query("S1_metadata_scan", """SELECT CAST(o_custkey AS VARCHAR) AS patient_id, 'sub-' || o_custkey AS subject_id, 'ses-' || o_orderkey AS session_id, 'sub-' || o_custkey || '/ses-' || o_orderkey AS session_key,
  CASE WHEN o_orderkey % 9 > 0 THEN o_totalprice END AS metadata_duration_seconds FROM orders""")
def s1(t):
    path = scratch_path(t.spark, "metadata")
    k = F.col("o_orderkey")
    t.orders.select(
        F.concat(F.lit("sub-"), F.col("o_custkey")).alias("BIDSFolder"), F.when(k % 2 == 0, F.concat(F.lit("ses-"), k)).otherwise(k.cast("string")).alias("SessionID"),
        F.col("o_custkey").cast("string").alias("BDSPPatientID"), F.when(k % 9 > 0, F.col("o_totalprice").cast("string")).otherwise("nan").alias("RecordingDuration"),
        F.lit("2001-01-01").alias("StartDateTime"), F.lit("").alias("EndDateTime")).write.option("header", True).csv(path)
    return files.session_columns(files.read_metadata(t.spark, path)).select(
        "patient_id", "subject_id", "session_id", "session_key", "metadata_duration_seconds")


@query("S6_sidecar_scan", """SELECT 'M' || s_nationkey AS manufacturer, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey::DOUBLE END AS bids_sampling_frequency, 'PSG' AS recording_type, '' AS eeg_reference, count(*) AS n
  FROM supplier GROUP BY ALL""")
def s6(t):
    path = scratch_path(t.spark, "sidecar")
    rows = t.supplier.select(F.concat(F.lit("M"), F.col("s_nationkey")).alias("Manufacturer"), F.lit(" PSG ").alias("RecordingType"),
                             F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey").cast("string")).otherwise("unknown").alias("SamplingFrequency"))
    rows.write.json(path)
    keep = ["manufacturer", "bids_sampling_frequency", "recording_type", "eeg_reference"]
    # JSON lines here, so that one file can hold many sidecars.
    back = files.sidecar_fields(t.spark.read.schema(files.SIDECAR_SCHEMA + ", _corrupt_record string").json(path))
    return back.groupBy(*keep).agg(F.count("*").alias("n"))


@query("S4_channel_header_inventory", CTE + "SELECT session_key, source, channel_no, raw_channel, fs_hz, dig_min, phys_max FROM c0")
def s4(t):
    path = scratch_path(t.spark, "headers")
    rows = raw_channels(t)
    rows.write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path).select("session_key", "source", "channel_no", "raw_channel", "fs_hz", "dig_min", "phys_max")


@query("S10_projected_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'")
def s10(t):
    return (t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")))
            .select("l_orderkey", "l_linenumber", "l_quantity"))


@query("S13_exactly_one_source", """WITH f AS (SELECT page_id // 3 AS k, page_id, CASE page_id % 3 WHEN 0 THEN 'h5' ELSE 'csv' END AS kind, page_id % 5 = 1 AS skip FROM pages),
  n AS (SELECT k, count(*) FILTER (kind = 'h5' AND NOT skip) AS h, count(*) FILTER (kind = 'csv' AND NOT skip) AS c FROM f GROUP BY 1)
  SELECT k AS session_key, 'ok' AS code, '' AS detail FROM n WHERE h = 1 AND c = 1 UNION ALL SELECT k, 'SOURCE_COUNT', 'h5=' || h || ', csv=' || c FROM n WHERE NOT (h = 1 AND c = 1)""")
def s13(t):
    name = F.concat(F.lit("a\\b\\"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 5 == 1, "-Old").otherwise(""),
                    F.when(F.col("page_id") % 3 == 0, ".h5").otherwise(".csv"))
    rows = t.pages.select(F.floor(F.col("page_id") / 3).alias("session_key"), name.alias("path"))
    good, bad = files.exactly_one(rows, {"h5": F.col("path").endswith(".h5"), "csv": F.col("path").endswith(".csv")}, "old")
    return good.select("session_key", F.lit("ok").alias("code"), F.lit("").alias("detail")).unionByName(bad.select("session_key", "code", "detail"))


@query("K6_inventory_sink", CTE + """SELECT 'sessions' AS tbl, session_key::VARCHAR AS key, patient_id::VARCHAR AS value, 1::BIGINT AS n FROM ses
  UNION ALL SELECT 'channels', session_key::VARCHAR, source || '/' || canonical_channel || '/' || selected_for_model::VARCHAR, count(*) FROM ch GROUP BY ALL
  UNION ALL SELECT 'channel_coverage', s.source, names.channel, count(DISTINCT session_key) FROM names CROSS JOIN (VALUES ('h5'),('edf'),('tsv')) s(source) LEFT JOIN sel ON sel.source = s.source AND sel.channel = names.channel GROUP BY ALL""")
def k6(t):
    root = scratch_path(t.spark, "inventory")
    ch = channels(t)
    inv.write_inventory({"sessions": sessions(t), "channels": ch, "channel_coverage": inv.channel_coverage(ch, total(t))}, root)
    text = lambda c: F.col(c).cast("string")
    back = {name: t.spark.read.parquet(f"{root}/{name}") for name in ("sessions", "channels", "channel_coverage")}
    detail = F.concat_ws("/", "source", "canonical_channel", text("selected_for_model"))
    return (back["sessions"].select(F.lit("sessions").alias("tbl"), text("session_key").alias("key"), text("patient_id").alias("value"), F.lit(1).cast("bigint").alias("n"))
            .unionByName(back["channels"].groupBy(text("session_key").alias("key"), detail.alias("value")).agg(F.count("*").alias("n")).withColumn("tbl", F.lit("channels")))
            .unionByName(back["channel_coverage"].select(F.lit("channel_coverage").alias("tbl"), F.col("source").alias("key"), F.col("channel").alias("value"),
                                                         F.col("recording_count").cast("bigint").alias("n"))))


_SI = " UNION ALL ".join([
    f"SELECT session_key, '{code}' AS code, NULL AS field FROM ses WHERE {cond}" for code, cond in (
        ("H5_MISSING", "NOT h5_exists"), ("H5_HEADER_ERROR", "h5_error IS NOT NULL"),
        ("H5_IDENTITY_MISMATCH", "h5_exists AND h5_error IS NULL AND (h5_subject_id <> subject_id::VARCHAR OR h5_session_id <> session_id::VARCHAR)"),
        ("EDF_MISSING", "NOT edf_exists"), ("EDF_HEADER_ERROR", "edf_error IS NOT NULL"), ("CHANNELS_TSV_MISSING", "NOT channels_tsv_exists"),
        ("TSV_READ_ERROR", "tsv_error IS NOT NULL"), ("BIDS_JSON_ERROR", "bids_json_error IS NOT NULL"), ("MANUAL_SLEEP_CSV_MISSING", "NOT manual_sleep_csv_exists"))]
    + [f"SELECT session_key, 'DURATION_MISMATCH_GT30S', '{f}' FROM ses WHERE abs({f} - metadata_duration_seconds) > 30" for f in ("h5_duration_seconds", "edf_duration_seconds")])


@query("P24_session_findings", CTE + _SI)
def p24(t):
    return inv.session_issues(sessions(t)).select("session_key", "code", "field")


@query("J1_session_assembly", """SELECT o_orderkey AS session_key, o_custkey AS patient_id, h.n AS h5_channel_count, e.n AS edf_signal_count, t.n AS tsv_channel_count FROM orders
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) h ON h.l_orderkey = o_orderkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) e ON e.l_orderkey = o_orderkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) t ON t.l_orderkey = o_orderkey""")
def j1(t):
    per = lambda s, name: raw_channels(t).where(F.col("source") == s).groupBy("session_key").agg(F.count("*").alias(name))
    return inv.assemble_sessions(sessions(t).select("session_key", "patient_id"), [
        per("h5", "h5_channel_count"), per("edf", "edf_signal_count"), per("tsv", "tsv_channel_count")])


@query("J2_alias_to_canonical", CTE + "SELECT session_key, source, channel_no, normalised_channel, canonical_channel FROM c2")
def j2(t):
    return inv.identify(raw_channels(t)).select("session_key", "source", "channel_no", "normalised_channel", "canonical_channel")


@query("W8_preferred_alias", CTE + "SELECT session_key, source, channel_no, normalised_channel, selected_for_model FROM ch")
def w8(t):
    return channels(t).select("session_key", "source", "channel_no", "normalised_channel", "selected_for_model")


def _mismatch(fields, left, right, code, unknown=None):
    parts = []
    for f, tol in fields.items():
        case = f"CASE WHEN l.{f} IS NOT NULL AND r.{f} IS NOT NULL AND abs(l.{f} - r.{f}) > greatest(1e-8 * greatest(abs(l.{f}), abs(r.{f})), {tol!r}::DOUBLE) THEN '{code}'"
        case += f" WHEN (l.{f} IS NULL) <> (r.{f} IS NULL) THEN '{unknown}' END" if unknown else " END"
        parts.append(f"SELECT l.session_key, {case} AS code, l.channel, '{f}' AS field FROM sel l JOIN sel r ON l.source = '{left}' AND r.source = '{right}' AND l.session_key = r.session_key AND l.channel = r.channel")
    return " UNION ALL ".join(parts)


_HE = (f"SELECT * FROM ({_mismatch(inv.H5_EDF_FIELDS, 'h5', 'edf', 'H5_EDF_METADATA_MISMATCH', 'H5_EDF_METADATA_UNKNOWN')}) WHERE code IS NOT NULL UNION ALL "
       "SELECT l.session_key, 'H5_EDF_UNIT_MISMATCH', l.channel, 'unit' FROM sel l JOIN sel r ON l.source = 'h5' AND r.source = 'edf' AND l.session_key = r.session_key AND l.channel = r.channel AND lower(l.unit) <> lower(r.unit)")
_HT = f"SELECT * FROM ({_mismatch(inv.H5_TSV_FIELDS, 'h5', 'tsv', 'H5_TSV_METADATA_MISMATCH')}) WHERE code IS NOT NULL"
_J5 = ("SELECT session_key, upper(s.source) || '_SELECTED_CHANNEL_MISSING' AS code, names.channel, NULL::VARCHAR AS field FROM ses CROSS JOIN names CROSS JOIN (VALUES ('h5'),('edf'),('tsv')) s(source) "
       "WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.session_key = ses.session_key AND sel.source = s.source AND sel.channel = names.channel)")
_ISS = ["session_key", "code", "channel", "field"]


@query("J3_h5_edf_compare", CTE + _HE)
def j3(t):
    return inv.h5_edf_issues(named(t)).select(*_ISS)


@query("J4_h5_tsv_compare", CTE + _HT)
def j4(t):
    return inv.h5_tsv_issues(named(t)).select(*_ISS)


@query("J5_expected_channel_missing", CTE + _J5)
def j5(t):
    return inv.missing_channels(sessions(t), inv.candidates(named(t))).select(*_ISS)


_MASK = """, mk AS (SELECT session_key, channel, bool_or(source = 'h5') AS h, bool_or(source = 'edf') AS e, bool_or(source = 'tsv') AS s FROM sel GROUP BY 1, 2),
  cov AS (SELECT names.channel, count(*) FILTER (h) AS h5, count(*) FILTER (e) AS edf, count(*) FILTER (s) AS tsv, count(*) FILTER (h AND NOT e) AS h5_only, count(*) FILTER (e AND NOT h) AS edf_only,
   count(*) FILTER (h AND e) AS paired, count(*) FILTER (h AND s) AS paired_tsv FROM names LEFT JOIN mk USING (channel) GROUP BY 1)"""


@query("J15_left_right_paired", CTE + _MASK + "SELECT channel, h5_only, edf_only, paired FROM cov")
def j15(t):
    return inv.coverage_comparison(inv.candidates(named(t)), total(t)).select("channel", "h5_only", "edf_only", "paired")


@query("A21_coverage_comparison", CTE + _MASK + ", ".join(["SELECT channel, h5, edf, tsv, h5_only, edf_only, paired"] + [
    f"100 * {s} / total::DOUBLE AS {s}_percent" for s in ("h5", "edf", "tsv")]) + " FROM cov, tot")
def a21(t):
    return inv.coverage_comparison(inv.candidates(named(t)), total(t))


@query("A9_issue_counts", CTE + f", iss AS (SELECT session_key, code FROM ({_SI}) UNION ALL SELECT session_key, code FROM ({_HE}) UNION ALL SELECT session_key, code FROM ({_HT}) UNION ALL SELECT session_key, code FROM ({_J5}))"
       " SELECT code, count(*) AS findings, count(DISTINCT session_key) AS sessions, 100 * count(DISTINCT session_key) / any_value(total)::DOUBLE AS percent FROM iss, tot GROUP BY 1")
def a9(t):
    return inv.issue_counts(inv.all_issues(sessions(t), named(t)), total(t))


@query("A10_filter_distribution", CTE + """SELECT source, CASE WHEN canonical_channel <> '' THEN canonical_channel ELSE normalised_channel END AS channel, raw_channel, selected_for_model, prefilter_raw, hp_hz, lp_hz, notch_hz, fs_hz, unit,
  count(DISTINCT session_key) AS recording_count, 100 * count(DISTINCT session_key) / any_value(total)::DOUBLE AS percent_of_all_recordings FROM ch, tot GROUP BY 1,2,3,4,5,6,7,8,9,10""")
def a10(t):
    return inv.filter_distribution(channels(t), total(t))


@query("O1_multi_key_sort", CTE + """SELECT source, channel, n, first_raw, row_number() OVER (ORDER BY source, channel, n DESC)::INT AS place FROM (SELECT source, canonical_channel AS channel, count(*) AS n, min(raw_channel) AS first_raw FROM ch GROUP BY 1, 2)""")
def o1(t):
    """The table is one row per source and channel, so numbering the sorted rows is one small task."""
    from pyspark.sql import Window
    per = (inv.identify(raw_channels(t)).groupBy("source", F.col("canonical_channel").alias("channel"))
           .agg(F.count("*").alias("n"), F.min("raw_channel").alias("first_raw")))
    order = Window.orderBy("source", "channel", F.desc("n"))
    return per.withColumn("place", F.row_number().over(order)).orderBy("source", "channel", F.desc("n"))


@query("O2_first_n_limit", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 120")
def o2(t):
    return t.orders.select("o_custkey", "o_orderkey").orderBy("o_custkey", "o_orderkey").limit(120)


@query("O3_top_k_per_group", CTE + """SELECT source, raw_channel, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, raw_channel)::INT AS rank, 100 * n / g::DOUBLE AS percent_of_group
  FROM (SELECT source, raw_channel, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS g FROM c0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, raw_channel) <= 8""")
def o3(t):
    return inv.distribution(raw_channels(t), ["source"], ["raw_channel"], 8)


@query("A11_channel_coverage", CTE + """SELECT s.source, names.channel, count(DISTINCT session_key) AS recording_count, 100 * count(DISTINCT session_key) / any_value(total)::DOUBLE AS percent
  FROM names CROSS JOIN (VALUES ('h5'),('edf'),('tsv')) s(source) CROSS JOIN tot LEFT JOIN sel ON sel.source = s.source AND sel.channel = names.channel GROUP BY 1, 2""")
def a11(t):
    return inv.channel_coverage(inv.candidates(named(t)), total(t))


@query("A12_inventory_totals", CTE + """SELECT count(*) AS recording_count, count(DISTINCT subject_id) AS subject_count, count(DISTINCT patient_id) AS patient_count, count(*) FILTER (h5_exists) AS h5_found,
  count(*) FILTER (edf_exists) AS edf_found, count(*) FILTER (channels_tsv_exists) AS channels_tsv_found, count(*) FILTER (manual_sleep_csv_exists) AS manual_sleep_csv_found FROM ses""")
def a12(t):
    return inv.inventory_totals(sessions(t))


_QP = ", ".join(f"round(quantile_cont(v, {q}), 6) AS {n}" for n, q in inv.QUANTILE_POINTS.items())


def _rounded(df: DataFrame, *keys: str, extra: tuple = ()) -> DataFrame:
    return df.select(*keys, "count", *[F.round(x, 6).alias(x) for x in ("mean", *inv.QUANTILE_POINTS, *extra)])


@query("A13_duration_quantiles", CTE + f"""SELECT source, count(v) AS count, round(avg(v), 6) AS mean, {_QP} FROM (SELECT 'metadata' AS source, metadata_duration_seconds / 3600 AS v FROM ses
  UNION ALL SELECT 'h5', h5_duration_seconds / 3600 FROM ses UNION ALL SELECT 'edf', edf_duration_seconds / 3600 FROM ses) GROUP BY 1""")
def a13(t):
    return _rounded(inv.quantile_table(sessions(t), {"metadata": "metadata_duration_seconds", "h5": "h5_duration_seconds", "edf": "edf_duration_seconds"}, 3600.0), "source")


@query("A13_event_value_quantiles", f"SELECT user_id, count(v) AS count, round(avg(v), 10) AS mean, {_QP} FROM (SELECT user_id, value AS v FROM events) GROUP BY 1")
def a13b(t):
    from nightgrid.operators.scan import exact_quantiles
    q = exact_quantiles(t.events, ["user_id"], F.col("value"), inv.QUANTILE_POINTS)
    return _rounded(q, "user_id").drop("mean").join(q.select("user_id", F.round("mean", 10).alias("mean")), "user_id")


@query("A14_sessions_per_patient", CTE + "SELECT sessions, count(*) AS patients, 100 * count(*) / sum(count(*)) OVER ()::DOUBLE AS percent FROM (SELECT patient_id, count(*) AS sessions FROM ses GROUP BY 1) GROUP BY 1")
def a14(t):
    return inv.sessions_per_patient(sessions(t))


@query("A14_patient_summary", CTE + "SELECT count(*) AS patients, count(*) FILTER (n > 1) AS multi_session_patients, max(n) AS max_sessions FROM (SELECT patient_id, count(*) AS n FROM ses GROUP BY 1)")
def a14b(t):
    return inv.patient_summary(sessions(t))


@query("A15_year_distribution", CTE + """SELECT coalesce(nullif(regexp_extract(metadata_start, '(19|20)\\d{2}', 0), ''), 'unknown') AS year, count(*) AS nights, 100 * count(*) / any_value(total)::DOUBLE AS percent FROM ses, tot GROUP BY 1""")
def a15(t):
    return inv.year_distribution(sessions(t))


@query("A16_file_presence", CTE + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) FILTER ({k}_exists) AS present, count(*) FILTER (NOT {k}_exists) AS missing, 100 * count(*) FILTER ({k}_exists) / count(*)::DOUBLE AS percent FROM ses"
    for k in ("h5", "edf", "channels_tsv", "bids_json", "manual_sleep_csv")))
def a16(t):
    return inv.file_presence(sessions(t))


@query("A17_file_sizes", CTE + f"""SELECT source, count(v) AS count, round(avg(v), 6) AS mean, round(sum(v) / 1024, 6) AS total_gib, round(sum(v) / 1048576, 6) AS total_tib, {_QP}
  FROM (SELECT 'h5' AS source, h5_bytes / 1048576::DOUBLE AS v FROM ses UNION ALL SELECT 'edf', edf_bytes / 1048576::DOUBLE FROM ses) GROUP BY 1""")
def a17(t):
    return _rounded(inv.file_sizes(sessions(t)), "source", extra=("total_gib", "total_tib"))


@query("A17_size_ratio", CTE + f"SELECT count(v) AS count, round(avg(v), 6) AS mean, {_QP} FROM (SELECT h5_bytes / edf_bytes::DOUBLE AS v FROM ses WHERE h5_bytes IS NOT NULL AND edf_bytes <> 0)")
def a17b(t):
    return _rounded(inv.size_ratio(sessions(t)))


_DUR = ", dur AS (SELECT 'h5' AS source, h5_duration_seconds AS v FROM ses WHERE h5_duration_seconds IS NOT NULL UNION ALL SELECT 'edf', edf_duration_seconds FROM ses WHERE edf_duration_seconds IS NOT NULL)"


@query("A18_duration_bins", CTE + _DUR + """, b AS (SELECT source, CASE WHEN v < 3600 THEN '<1h' WHEN v < 14400 THEN '1-<4h' WHEN v < 18000 THEN '4-<5h' WHEN v < 28800 THEN '5-<8h' WHEN v <= 43200 THEN '8-12h' ELSE '>12h' END AS bin FROM dur)
  SELECT s.source, x.bin, count(b.bin) AS nights, 100 * count(b.bin) / (SELECT count(*) FROM b c WHERE c.source = s.source)::DOUBLE AS percent FROM (VALUES ('h5'),('edf')) s(source)
  CROSS JOIN (VALUES ('<1h'),('1-<4h'),('4-<5h'),('5-<8h'),('8-12h'),('>12h')) x(bin) LEFT JOIN b ON b.source = s.source AND b.bin = x.bin GROUP BY 1, 2""")
def a18(t):
    return inv.duration_bins(sessions(t))


@query("A19_duration_thresholds", CTE + _DUR + """SELECT source, th AS threshold, count(*) FILTER (hit) AS nights, 100 * count(*) FILTER (hit) / count(*)::DOUBLE AS percent FROM (SELECT source, th,
  CASE th WHEN '<30s' THEN v < 30 WHEN '<5min' THEN v < 300 WHEN '<30min' THEN v < 1800 WHEN '<1h' THEN v < 3600 WHEN '>4h' THEN v > 14400 ELSE v > 18000 END AS hit
  FROM dur, (VALUES ('<30s'),('<5min'),('<30min'),('<1h'),('>4h'),('>5h')) x(th)) GROUP BY 1, 2""")
def a19(t):
    return inv.duration_thresholds(sessions(t))


@query("A20_paired_duration_classes", CTE + """, d AS (SELECT edf_duration_seconds - h5_duration_seconds AS d FROM ses WHERE edf_duration_seconds IS NOT NULL AND h5_duration_seconds IS NOT NULL)
  SELECT k AS comparison, count(*) FILTER (CASE k WHEN 'exact' THEN abs(d) <= 1e-6 WHEN 'differ' THEN abs(d) > 1e-6 WHEN 'abs_gt_1s' THEN abs(d) > 1 WHEN 'abs_gt_30s' THEN abs(d) > 30 WHEN 'edf_longer' THEN d > 1e-6 ELSE d < -1e-6 END) AS nights,
  100 * count(*) FILTER (CASE k WHEN 'exact' THEN abs(d) <= 1e-6 WHEN 'differ' THEN abs(d) > 1e-6 WHEN 'abs_gt_1s' THEN abs(d) > 1 WHEN 'abs_gt_30s' THEN abs(d) > 30 WHEN 'edf_longer' THEN d > 1e-6 ELSE d < -1e-6 END) / count(*)::DOUBLE AS percent
  FROM d, (VALUES ('exact'),('differ'),('abs_gt_1s'),('abs_gt_30s'),('edf_longer'),('h5_longer')) x(k) GROUP BY 1""")
def a20(t):
    return inv.paired_duration_classes(sessions(t))


@query("A20_duration_outliers", CTE + "SELECT session_key, h5_duration_seconds, edf_duration_seconds, edf_duration_seconds - h5_duration_seconds AS difference FROM ses WHERE abs(edf_duration_seconds - h5_duration_seconds) > 1e-6")
def a20b(t):
    return inv.duration_outliers(sessions(t))


_SETS = {"head": ("f3-m2", "e1"), "heart": ("ecg",), "breath": ("airflow", "spo2"), "mixed": ("ecg", "airflow", "f3-m2")}


@query("A22_combination_completeness", CTE + """, mk AS (SELECT session_key, source, list(DISTINCT channel) AS have FROM sel GROUP BY 1, 2)
  SELECT s.source, k.combination, count(mk.have) FILTER (list_has_all(mk.have, k.need)) AS nights, 100 * count(mk.have) FILTER (list_has_all(mk.have, k.need)) / any_value(total)::DOUBLE AS percent
  FROM (VALUES ('h5'),('edf'),('tsv')) s(source) CROSS JOIN (VALUES """ + ",".join(f"('{k}', {list(v)!r})" for k, v in _SETS.items()) + """) k(combination, need) CROSS JOIN tot
  LEFT JOIN (SELECT mk.* FROM mk SEMI JOIN ses USING (session_key)) mk ON mk.source = s.source GROUP BY 1, 2""")
def a22(t):
    return inv.combination_completeness(sessions(t), inv.candidates(named(t)), _SETS)


@query("A23_channel_duration_agreement", CTE + """, p AS (SELECT session_key, channel, max(duration_seconds) FILTER (source = 'h5') AS h, max(duration_seconds) FILTER (source = 'edf') AS e, bool_or(source = 'h5') AS ih, bool_or(source = 'edf') AS ie FROM he GROUP BY 1, 2)
  SELECT channel, count(*) FILTER (ih AND ie) AS paired, count(*) FILTER (ih AND ie AND abs(e - h) <= 1e-6) AS exact, count(*) FILTER (ih AND ie AND abs(e - h) > 1) AS gt_1s, count(*) FILTER (ih AND ie AND abs(e - h) > 30) AS gt_30s,
  count(*) FILTER (ih AND NOT ie) AS h5_only, count(*) FILTER (ie AND NOT ih) AS edf_only, max(abs(e - h)) FILTER (ih AND ie) AS max_abs_difference FROM p GROUP BY 1""")
def a23(t):
    return inv.channel_duration_agreement(chosen(t))


def _dist_sql(rows, keys, values, top=None, all_share=False):
    k, v = ", ".join(keys), ", ".join(values)
    part = f"PARTITION BY {k}" if keys else ""
    order = "ORDER BY n DESC, " + ", ".join(f"{x} NULLS FIRST" for x in values)
    cols = ", ".join([*keys, *values, "n", "100 * n / g::DOUBLE AS percent_of_group"]
                     + ([f"row_number() OVER ({part} {order})::INT AS rank"] if top else [])
                     + (["100 * n / total::DOUBLE AS percent_of_all"] if all_share else []))
    tail = f" QUALIFY row_number() OVER ({part} {order}) <= {top}" if top else ""
    return (f"SELECT {cols} FROM (SELECT {', '.join([*keys, *values])}, count(*) AS n, sum(count(*)) OVER ({part}) AS g FROM {rows} GROUP BY {', '.join([*keys, *values])}), tot{tail}")


_SC = ["source", "channel"]
_BL = "(SELECT * REPLACE (coalesce(nullif(unit, ''), '(blank)') AS unit, coalesce(nullif(value_domain, ''), '(blank)') AS value_domain) FROM {})"


@query("A24_sampling_rates", CTE + _dist_sql("he", _SC, ["fs_hz"], all_share=True))
def a24(t):
    return inv.sampling_rates(chosen(t), total(t))


@query("A25_joint_filter_top3", CTE + _dist_sql("he", _SC, ["fs_hz", "hp_hz", "lp_hz", "notch_hz"], 3, True))
def a25(t):
    return inv.joint_filters(chosen(t), total(t))


@query("A25_filter_summary", CTE + """SELECT source, channel, count(*) AS nights, count(*) FILTER (filter_parse_ok) AS parsed, count(DISTINCT {'a': fs_hz, 'b': hp_hz, 'c': lp_hz, 'd': notch_hz}) AS profiles,
  100 * count(*) FILTER (filter_parse_ok) / count(*)::DOUBLE AS parsed_percent FROM he GROUP BY 1, 2""")
def a25b(t):
    return inv.filter_summary(chosen(t))


@query("A26_unit_distribution", CTE + _dist_sql(_BL.format("he"), _SC, ["unit"], all_share=True))
def a26(t):
    return inv.unit_distribution(chosen(t), total(t))


@query("A27_raw_name_top5", CTE + _dist_sql("he", _SC, ["raw_channel"], 5))
def a27(t):
    return inv.raw_names(chosen(t))


@query("A28_storage_top3", CTE + _dist_sql(_BL.format("he"), _SC, ["dtype", "value_domain"], 3))
def a28(t):
    return inv.storage_profiles(chosen(t))


@query("A28_calibration_top3", CTE + _dist_sql(_BL.format("he"), _SC, ["dig_min", "dig_max", "phys_min", "phys_max", "unit"], 3))
def a28b(t):
    return inv.calibration_profiles(chosen(t))


_COMP = """count(*) AS instances, count(dig_min) AS dig_min_present, count(dig_max) AS dig_max_present, count(phys_min) AS phys_min_present, count(phys_max) AS phys_max_present,
  count(dig_min + dig_max + phys_min + phys_max) AS all_four, count(*) - count(dig_min + dig_max + phys_min + phys_max) AS any_missing, 100 * count(dig_min + dig_max + phys_min + phys_max) / count(*)::DOUBLE AS complete_percent"""


@query("A29_calibration_completeness", CTE + f"SELECT 'all' AS scope, {_COMP} FROM ch WHERE source = 'h5' UNION ALL SELECT 'selected', {_COMP} FROM sel WHERE source = 'h5' UNION ALL SELECT 'channel:' || channel, {_COMP} FROM sel WHERE source = 'h5' GROUP BY channel")
def a29(t):
    return inv.calibration_completeness(raw_channels(t), chosen(t))


@query("A30_missing_combinations", CTE + """SELECT concat_ws('+', CASE WHEN dig_min IS NULL THEN 'dig_min' END, CASE WHEN dig_max IS NULL THEN 'dig_max' END, CASE WHEN phys_min IS NULL THEN 'phys_min' END,
  CASE WHEN phys_max IS NULL THEN 'phys_max' END) AS missing_fields, count(*) AS instances FROM ch WHERE source = 'h5' AND dig_min + dig_max + phys_min + phys_max IS NULL GROUP BY 1""")
def a30(t):
    return inv.missing_combinations(raw_channels(t))


@query("A31_h5_edf_by_channel", CTE + _MASK + f", i AS ({_HE}) SELECT cov.channel, any_value(paired) AS paired, count(code) AS findings, count(DISTINCT session_key) AS sessions, 100 * count(DISTINCT session_key) / nullif(any_value(paired), 0)::DOUBLE AS percent_of_paired FROM cov LEFT JOIN i ON i.channel = cov.channel AND code = 'H5_EDF_METADATA_MISMATCH' GROUP BY 1")
def a31(t):
    ch = inv.candidates(named(t))
    return inv.mismatch_by_channel(inv.h5_edf_issues(ch), inv.coverage_comparison(ch, total(t)))


@query("A31_h5_edf_by_field", CTE + f", i AS ({_HE}) SELECT channel, field, count(*) AS findings, count(DISTINCT session_key) AS sessions, 100 * count(DISTINCT session_key) / any_value(total)::DOUBLE AS percent FROM i, tot WHERE code IN ('H5_EDF_METADATA_MISMATCH', 'H5_EDF_UNIT_MISMATCH') GROUP BY 1, 2")
def a31b(t):
    return inv.mismatch_by_field(inv.h5_edf_issues(named(t)), total(t), ["H5_EDF_METADATA_MISMATCH", "H5_EDF_UNIT_MISMATCH"])


@query("A32_h5_tsv_by_channel", CTE + _MASK + f", i AS ({_HT}) SELECT cov.channel, any_value(paired_tsv) AS paired, count(code) AS findings, count(DISTINCT session_key) AS sessions, 100 * count(DISTINCT session_key) / nullif(any_value(paired_tsv), 0)::DOUBLE AS percent_of_paired FROM cov LEFT JOIN i ON i.channel = cov.channel GROUP BY 1")
def a32(t):
    ch = inv.candidates(named(t))
    return inv.mismatch_by_channel(inv.h5_tsv_issues(ch), inv.paired_counts(ch), "H5_TSV_METADATA_MISMATCH")


@query("A32_h5_tsv_by_field", CTE + f", i AS ({_HT}) SELECT channel, field, count(*) AS findings, count(DISTINCT session_key) AS sessions, 100 * count(DISTINCT session_key) / any_value(total)::DOUBLE AS percent FROM i, tot GROUP BY 1, 2")
def a32b(t):
    return inv.mismatch_by_field(inv.h5_tsv_issues(named(t)), total(t), ["H5_TSV_METADATA_MISMATCH"])


@query("A33_missing_edf_channels", CTE + f", i AS ({_J5}) SELECT names.channel, any_value(p.n) AS present, count(i.code) AS missing, 100 * count(i.code) / any_value(total)::DOUBLE AS missing_percent FROM names CROSS JOIN tot"
       " LEFT JOIN (SELECT names.channel, count(DISTINCT session_key) AS n FROM names LEFT JOIN sel ON sel.channel = names.channel AND sel.source = 'edf' GROUP BY 1) p ON p.channel = names.channel LEFT JOIN i ON i.channel = names.channel AND i.code = 'EDF_SELECTED_CHANNEL_MISSING' GROUP BY 1")
def a33(t):
    ch = inv.candidates(named(t))
    return inv.missing_edf_channels(inv.missing_channels(sessions(t), ch, ("edf",)), ch, total(t))


_SHOW = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} = floor({0}) THEN CAST({0}::BIGINT AS VARCHAR) ELSE regexp_replace(printf('%.3f', {0}::DOUBLE), '\\.?0+$', '') END"


@query("A34_header_field_distribution", CTE + ", v AS (SELECT 'manufacturer' AS field, manufacturer AS value FROM ses UNION ALL SELECT 'power_line_frequency', coalesce(nullif(power_line_frequency, ''), '(blank)') FROM ses UNION ALL SELECT 'bids_sampling_frequency', "
       + _SHOW.format("bids_sampling_frequency") + " FROM ses UNION ALL SELECT 'edf_signal_count', " + _SHOW.format("edf_signal_count") + """ FROM ses),
  k AS (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS rank FROM v GROUP BY 1, 2)
  SELECT field, least(rank, 21)::INT AS rank, CASE WHEN rank > 20 THEN 'other' ELSE value END AS value, sum(n)::BIGINT AS n, 100 * sum(n)::BIGINT / any_value(total)::DOUBLE AS percent FROM k, tot GROUP BY 1, 2, 3""")
def a34(t):
    return inv.header_fields(sessions(t), ["manufacturer", "power_line_frequency"], ["bids_sampling_frequency", "edf_signal_count"])


_STRICT = ", sx AS (SELECT * FROM ch WHERE source = 'h5' AND lower(trim(raw_channel)) = 'airflow')"


@query("A35_strict_airflow_presence", CTE + _STRICT + """, n AS (SELECT (SELECT count(DISTINCT session_key) FROM sx) AS p, (SELECT count(DISTINCT session_key) FROM sel WHERE source = 'h5' AND channel = 'airflow' AND session_key NOT IN (SELECT session_key FROM sx)) AS f, total FROM tot)
  SELECT 'present' AS item, p AS nights, 100 * p / total::DOUBLE AS percent FROM n UNION ALL SELECT 'missing', total - p, 100 * (total - p) / total::DOUBLE FROM n UNION ALL SELECT 'fallback', f, 100 * f / total::DOUBLE FROM n""")
def a35(t):
    return inv.strict_presence(sessions(t), raw_channels(t), chosen(t))


@query("A35_strict_airflow_filters", CTE + _STRICT + _dist_sql("sx", [], ["fs_hz", "hp_hz", "lp_hz", "notch_hz"]))
def a35b(t):
    return inv.strict_profiles(raw_channels(t), ["fs_hz", "hp_hz", "lp_hz", "notch_hz"])


@query("A36_range_unit_audit", CTE + """, r AS (SELECT *, coalesce(nullif(trim(unit), ''), '(blank)') AS u FROM sel WHERE source = 'h5' AND (channel <> 'airflow' OR lower(trim(raw_channel)) = 'airflow'))
  SELECT channel, count(DISTINCT session_key) AS present, 100 * count(DISTINCT session_key) / any_value(total)::DOUBLE AS present_percent, count(DISTINCT {'a': dig_min, 'b': dig_max, 'c': phys_min, 'd': phys_max, 'e': u}) AS profiles,
  count(*) FILTER (u = '(blank)') AS missing_units, count(*) FILTER (dig_min + dig_max + phys_min + phys_max IS NULL) AS missing_ranges, string_agg(DISTINCT u, ', ' ORDER BY u) AS units, 100 * count(*) FILTER (u = '(blank)') / count(*)::DOUBLE AS missing_unit_percent FROM r, tot GROUP BY 1""")
def a36(t):
    return inv.range_audit(sessions(t), chosen(t))


@query("F1_normalise_channel", CTE + "SELECT raw_channel, normalised_channel, count(*) AS n FROM c1 GROUP BY 1, 2")
def f1(t):
    rows = raw_channels(t)
    return rows.groupBy("raw_channel", h.channel_name(F.col("raw_channel")).alias("normalised_channel")).agg(F.count("*").alias("n"))


_NUM = "CASE c_custkey % 6 WHEN 0 THEN concat(' ', c_nationkey, '.5 ') WHEN 1 THEN 'inf' WHEN 2 THEN 'NaN' WHEN 3 THEN '' WHEN 4 THEN '12abc' ELSE CAST(c_nationkey AS STRING) END"


@query("F6_tolerant_number", f"SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN c_nationkey + 0.5::DOUBLE WHEN c_custkey % 6 = 5 THEN c_nationkey::DOUBLE END AS number, trim({_NUM}) AS txt FROM customer")
def f6(t):
    x = F.expr(_NUM)
    return t.customer.select("c_custkey", c.tolerant_number(x).alias("number"), c.decode_text(F.encode(x, "UTF-8")).alias("txt"))


@query("F12_percent", "SELECT c_nationkey, 100 * count(*) FILTER (c_acctbal < 0) / nullif(count(*) FILTER (c_mktsegment = 'BUILDING'), 0)::DOUBLE AS share FROM customer GROUP BY 1")
def f12(t):
    return t.customer.groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < 0).alias("a"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("b")).select(
        "c_nationkey", c.percent(F.col("a"), F.col("b")).alias("share"))
