"""Publication, committed reads, ledgers and release audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.headers import path_is_safe, path_key
from nightgrid.operators import audits, batches, digests, grid, inventory, labels, release, rules
from nightgrid.plans import label_queries as lq
from nightgrid.plans import signal_queries as sq
from nightgrid.plans.registry import Tables, query
from nightgrid.session import scratch_path, write_once
from nightgrid.sources import published, registry

CTE, FULL = sq.CTE, sq.FULL
_ID = "recording_id, channel, epoch_in_record"


def stored_signals(t: Tables) -> DataFrame:
    x = rules.zero_fill(F.col("samples"))
    return sq.live_epochs(t).select(
        "recording_id", "channel", "epoch_in_record",
        (F.col("epoch_in_record").cast("bigint") * 30_000_000_000).alias("epoch_start_offset_ns"), x.alias("samples"),
        F.lpad(F.floor(F.col("recording_id") / 2).cast("string"), 5, "0").alias("shard_id"))


_TOTAL = "round(list_sum(list_transform(x, lambda v: CASE WHEN isfinite(v) THEN v::DOUBLE ELSE 0 END)), 3)"


@query("K1_signal_sink", CTE + f"SELECT {_ID}, lpad((recording_id // 2)::VARCHAR, 5, '0') AS shard_id, epoch_in_record::BIGINT * 30000000000 AS epoch_start_offset_ns, {_TOTAL} AS total FROM live")
def k1(t):
    path = scratch_path(t.spark, "signals")
    rows = stored_signals(t)
    release.write_signals(rows, path)
    back = t.spark.read.schema(rows.schema).parquet(path)
    total = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return back.select(*_ID.split(", "), "shard_id", "epoch_start_offset_ns", F.round(total, 3).alias("total"))


@query("K2_qc_sink", CTE + f"SELECT {_ID}, flags AS hard_flags, evaluated AS hard_evaluated_flags, code AS hard_code, coalesce(amp, 255)::INT AS high_amplitude_duration_seconds FROM qc")
def k2(t):
    path = scratch_path(t.spark, "qc")
    rows = sq.qc(t).withColumn("shard_id", F.floor(F.col("recording_id") / 2).cast("string"))
    release.write_table(rows, path, order=("recording_id", "epoch_in_record", "channel"))
    back = rules.to_sentinels(t.spark.read.schema(rows.schema).parquet(path))
    return back.select(*_ID.split(", "), "hard_flags", "hard_evaluated_flags", "hard_code",
                       F.col("high_amplitude_duration_seconds").cast("int").alias("high_amplitude_duration_seconds"))


@query("K3_task_sink", lq.CTE + "SELECT recording_id, epoch_in_record, task, qc_code, qc_code = 0 AS valid FROM te")
def k3(t):
    path = scratch_path(t.spark, "tasks")
    rows = labels.task_epochs(lq.overlaid(t)).withColumn("shard_id", F.floor(F.col("recording_id") / 16).cast("string"))
    release.write_table(rows, path, order=("recording_id", "epoch_in_record", "task"))
    return t.spark.read.schema(rows.schema).parquet(path).drop("shard_id")


@query("K4_channel_processing_sink", CTE + ", " + sq._BAND + """SELECT recording_id, channel, status AS channel_status_code,
  CASE WHEN status = 0 THEN hp END AS source_hp_hz, CASE WHEN status = 0 THEN lp END AS source_lp_hz,
  CASE WHEN status <> 0 THEN NULL WHEN channel <> 'spo2' AND (hp IS NULL OR hp + lp = 0) AND (CASE WHEN fs = 200 AND (kind = 'emg' OR channel = 'snore') THEN 95 ELSE th END) < fs / 2 THEN tl ELSE hp END AS effective_hp_hz,
  CASE WHEN status = 0 THEN CASE label_no WHEN 5 THEN 60::DOUBLE WHEN 9 THEN 50::DOUBLE END END AS notch_hz
  FROM (SELECT band.*, CASE WHEN prefilter LIKE 'HP:0.300%' THEN 5 WHEN prefilter LIKE 'hp 10%' THEN 9 END AS label_no FROM band)""")
def k4(t):
    path = scratch_path(t.spark, "processing")
    rows = sq.processed(t)
    rows.write.parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path).select(
        "recording_id", "channel", "channel_status_code", "source_hp_hz", "source_lp_hz", "effective_hp_hz", "notch_hz")


@query("K7_report_sinks", CTE + f"""SELECT 'summary' AS report, r.channel, r.code::INT AS code, NULL::BIGINT AS recording_id, NULL::BIGINT AS start_seconds, coalesce(sum((evaluated >> (r.code - 1)) & 1), 0)::BIGINT AS n FROM {sq._RULES} LEFT JOIN qc ON r.channel = qc.channel GROUP BY ALL
  UNION ALL SELECT 'events', qc.channel, r.code::INT, recording_id, qc.epoch_in_record * 30, 1 FROM qc JOIN {sq._RULES} ON r.channel = qc.channel AND (qc.flags >> (r.code - 1)) & 1 = 1""")
def k7(t):
    root = scratch_path(t.spark, "reports")
    q = sq.qc(t)
    rules.rule_summary(q).write.parquet(f"{root}/qc_summary")
    rules.hard_events(q).write.option("header", True).csv(f"{root}/epoch_hard")
    a = t.spark.read.parquet(f"{root}/qc_summary")
    b = t.spark.read.option("header", True).csv(f"{root}/epoch_hard")
    none = F.lit(None).cast("bigint")
    return a.select(F.lit("summary").alias("report"), "channel", F.col("code").cast("int").alias("code"), none.alias("recording_id"), none.alias("start_seconds"),
                    F.col("evaluated_epochs").cast("bigint").alias("n")).unionByName(
        b.select(F.lit("events").alias("report"), "channel", F.col("hard_code").cast("int").alias("code"), F.col("recording_id").cast("bigint").alias("recording_id"),
                 F.col("start_seconds").cast("bigint").alias("start_seconds"), F.lit(1).cast("bigint").alias("n")))


def publish_all(t: Tables, root: str) -> None:
    """Two runs: even shards first, then everything; the second run must leave the first alone."""
    rows = stored_signals(t)
    recs = (rows.groupBy("recording_id", "shard_id").agg(
        F.count_distinct("epoch_in_record").alias("n_epochs"))
        .withColumn("subject_id", F.col("recording_id")).withColumn("night_grade", F.lit(5)))
    even = F.col("shard_id").cast("int") % 2 == 0
    release.publish(root, {"signal_epochs": rows.where(even), "records": recs.where(even)})
    release.publish(root, {"signal_epochs": rows, "records": recs})


@query("K8_idempotent_publish", CTE + "SELECT lpad((recording_id // 2)::VARCHAR, 5, '0') AS shard_id, 'signal_epochs' AS artifact, count(*) AS epochs, count(*) AS visible_rows FROM live GROUP BY 1")
def k8(t):
    root = scratch_path(t.spark, "release")
    publish_all(t, root)
    seen = release.read_published(t.spark, root, "signal_epochs").groupBy("shard_id").agg(F.count("*").alias("visible_rows"))
    done = release.read_commits(t.spark, root).where("artifact = 'signal_epochs'")
    return done.join(seen, "shard_id").select("shard_id", "artifact", "epochs", "visible_rows")


@query("U1_registered_reader_windows", CTE + """, r AS (SELECT recording_id, count(DISTINCT epoch_in_record) AS n FROM live GROUP BY 1)
  SELECT live.recording_id, w AS window_no, live.epoch_in_record, live.channel, w * 2 * 30::DOUBLE AS start_sec FROM r, range(CAST(ceil(n / 2) AS BIGINT)) g(w), range(w * 2, w * 2 + least(3, n - w * 2)) h(e)
  JOIN live ON live.recording_id = r.recording_id AND live.epoch_in_record = h.e""")
def u1(t):
    root = scratch_path(t.spark, "release")
    publish_all(t, root)
    if "archive" not in registry._READERS:
        registry.register_reader("archive", published.read_release)
    source = registry.open_release(t.spark, "archive", root)
    rows = published.read_windows(source, 3, 2)
    return rows.select("recording_id", "window_no", F.col("epoch_in_record").cast("int").alias("epoch_in_record"), "channel", "start_sec")


# --- ledgers on orders: one order is one recording ------------------------------------------
_RECORDS = [
    "o_orderkey AS recording_id", "CAST(o_custkey % 40 AS STRING) AS shard_id", "1 + o_orderkey % 5 AS n_epochs",
    "CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'QC_PASSED' END AS status", "CAST(o_orderkey % 6 AS INT) AS night_grade"]


def order_records(t: Tables) -> DataFrame:
    return grid.first_epoch(t.orders.selectExpr(*_RECORDS), "shard_id", "recording_id")


def artifacts(t: Tables) -> DataFrame:
    per = order_records(t).groupBy("shard_id").agg(F.sum("n_epochs").alias("epochs"))
    sep = F.when(F.col("shard_id").cast("int") % 3 == 0, "\\").otherwise("/")
    path = F.concat(F.when(F.col("shard_id").cast("int") % 11 == 5, "../").otherwise(""), F.lit("signals"), sep, F.lit("signal-"), "shard_id", F.lit(".h5"))
    return per.select(path.alias("artifact"), (F.col("epochs") * 360_000).alias("bytes"),
                      F.sha2("shard_id", 256).alias("sha256"), F.col("epochs").cast("bigint").alias("epochs"), "shard_id")


def commits(t: Tables) -> DataFrame:
    n = F.col("shard_id").cast("int")
    return (artifacts(t).where(n % 13 != 1)
            .withColumn("epochs", F.col("epochs") + F.when(n % 7 == 2, 1).otherwise(0))
            .withColumn("status", F.when(n % 17 == 3, "NO_PUBLISHABLE_RECORDS").otherwise("QC_PASSED")))


_LEDGER = f"""WITH rec0 AS (SELECT {', '.join(_RECORDS)} FROM orders),
  rec AS (SELECT *, coalesce(sum(n_epochs) OVER (PARTITION BY shard_id ORDER BY recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_epoch FROM rec0),
  art AS (SELECT CASE WHEN shard_id::INT % 11 = 5 THEN '../' ELSE '' END || 'signals' || CASE WHEN shard_id::INT % 3 = 0 THEN chr(92) ELSE '/' END || 'signal-' || shard_id || '.h5' AS artifact,
    sum(n_epochs)::BIGINT * 360000 AS bytes, sha256(shard_id) AS sha256, sum(n_epochs)::BIGINT AS epochs, shard_id FROM rec GROUP BY shard_id),
  bad AS (SELECT *, CASE WHEN shard_id::INT % 13 = 1 THEN 'not_committed' WHEN shard_id::INT % 17 = 3 THEN 'not_passed' WHEN shard_id::INT % 7 = 2 THEN 'manifest_commit_differ'
    WHEN shard_id::INT % 11 = 5 THEN 'unsafe_path' END AS problem FROM art)
"""


@query("J11_manifest_commit_agreement", _LEDGER + "SELECT shard_id, epochs, problem FROM bad")
def j11(t):
    return release.agreement(artifacts(t), commits(t)).select("shard_id", "epochs", "problem")


@query("J12_range_within_artifact", _LEDGER + """SELECT recording_id, shard_id, first_epoch, r.n_epochs FROM rec r JOIN art USING (shard_id)
  WHERE shard_id::INT % 5 = 0 OR first_epoch + r.n_epochs > art.epochs - r.recording_id % 3""")
def j12(t):
    a = artifacts(t).where(F.col("shard_id").cast("int") % 5 != 0)
    r = order_records(t).withColumn("n_epochs", F.col("n_epochs") + F.col("recording_id") % 3)
    out = release.range_violations(r, a)
    return out.select("recording_id", "shard_id", "first_epoch", (F.col("n_epochs") - F.col("recording_id") % 3).alias("n_epochs"))


@query("S14_committed_release_scan", _LEDGER + "SELECT recording_id, shard_id, first_epoch, n_epochs, bad.epochs AS artifact_epochs FROM rec JOIN bad USING (shard_id) WHERE status = 'QC_PASSED' AND problem IS NULL")
def s14(t):
    return release.committed_records(order_records(t), artifacts(t), commits(t)).select(
        "recording_id", "shard_id", "first_epoch", "n_epochs", "artifact_epochs")


@query("V11_release_conditions", _LEDGER + "SELECT problem, count(*) AS artifacts, 4 AS refused_conditions FROM bad WHERE problem IS NOT NULL GROUP BY 1")
def v11(t):
    """What keeps artifacts from being read, and which callers' conditions the release check refuses."""
    counts = (release.agreement(artifacts(t), commits(t)).where("problem IS NOT NULL")
              .groupBy("problem").agg(F.count("*").alias("artifacts")))
    refused = 0
    for version, status, tasks in ((m.RELEASE_VERSION, "COMPLETE", ("sao2",)), ("v9", "COMPLETE", ()), (m.RELEASE_VERSION, "RUNNING", ()),
                                   (m.RELEASE_VERSION, "COMPLETE", ("sao2", "sao2")), (m.RELEASE_VERSION, "COMPLETE", ("weight",))):
        try:
            release.check_release(version, status, tasks)
        except ValueError:
            refused += 1
    return counts.withColumn("refused_conditions", F.lit(refused))


@query("V12_record_audit", _LEDGER + """SELECT recording_id, 'grade' AS problem FROM rec WHERE night_grade = 0 UNION ALL SELECT recording_id, 'grade' FROM rec WHERE night_grade = 0 AND recording_id % 10 = 0
  UNION ALL SELECT recording_id, 'duplicate' FROM rec WHERE recording_id % 10 = 0""")
def v12(t):
    r = order_records(t)
    return release.record_violations(r.unionByName(r.where("recording_id % 10 = 0")))


@query("V12_overlapping_ranges", _LEDGER + """, s AS (SELECT shard_id, recording_id, first_epoch - (recording_id % 4 = 0)::INT AS a, n_epochs FROM rec),
  p AS (SELECT *, max(a + n_epochs) OVER (PARTITION BY shard_id ORDER BY a, recording_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
  SELECT shard_id, recording_id, a AS first_epoch FROM p WHERE before > a""")
def v12b(t):
    from nightgrid.operators.scan import number_bucket, running
    r = order_records(t).withColumn("first_epoch", F.col("first_epoch") - (F.col("recording_id") % 4 == 0).cast("int"))
    out = running(r, ["shard_id"], ["first_epoch", "recording_id"], number_bucket(F.col("first_epoch"), 1024),
                  {"before": ("max", F.col("first_epoch") + F.col("n_epochs"))})
    return out.where(F.col("before") > F.col("first_epoch")).select("shard_id", "recording_id", "first_epoch")


@query("J13_pending_records", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j13(t):
    pub = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return release.pending_records(t.customer.select("c_custkey", "c_acctbal"), pub, "c_custkey")


@query("J13_recovery_plan", """WITH RECURSIVE src AS (SELECT c_custkey, CAST(abs(c_acctbal) * 100 AS BIGINT) AS size, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_custkey % 4 <> 0),
  w(pos, n, load, shard_no) AS (SELECT pos, 1, size, 10::BIGINT FROM src WHERE pos = 0 UNION ALL
   SELECT s.pos, CASE WHEN w.n >= 16 OR w.load + s.size > 6000000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 16 OR w.load + s.size > 6000000 THEN s.size ELSE w.load + s.size END,
    w.shard_no + CASE WHEN w.n >= 16 OR w.load + s.size > 6000000 THEN 1 ELSE 0 END FROM w JOIN src s ON s.pos = w.pos + 1)
  SELECT c_custkey, size, shard_no FROM w JOIN src USING (pos) UNION ALL SELECT c_custkey, CAST(abs(c_acctbal) * 100 AS BIGINT), c_custkey % 10 FROM customer WHERE c_custkey % 4 = 0
  AND c_custkey % 10 <> 9 UNION ALL SELECT c_custkey, CAST(abs(c_acctbal) * 100 AS BIGINT), 9 FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 10 = 9""")
def j13b(t):
    rows = t.customer.select("c_custkey", F.expr("CAST(round(abs(c_acctbal) * 100) AS BIGINT)").alias("size"))
    kept = t.customer.where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_custkey") % 10).alias("shard_no"))
    # Highest committed shard number is nine, so new shards start at ten.
    floor_ = t.customer.where("c_custkey = 0").select(F.lit(-1).cast("bigint").alias("c_custkey"), F.lit(9).cast("bigint").alias("shard_no"))
    return release.recovery_plan(rows, kept.unionByName(floor_), "c_custkey", "c_custkey", size="size", target=6_000_000)


def admission(t: Tables) -> DataFrame:
    inv = t.orders.select(F.col("o_orderkey").alias("session_key"),
                          F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_totalprice") / 1.5 - 2000).alias("h5_duration_seconds"))
    fixed = t.customer.select(F.col("c_custkey").alias("session_key")).where("session_key % 100 = 7")
    return grid.admit_records(inv, fixed)


_ADMIT = """WITH inv AS (SELECT o_orderkey AS session_key, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice / 1.5::DOUBLE - 2000 END AS d FROM orders),
  fixed AS (SELECT c_custkey AS session_key FROM customer WHERE c_custkey % 100 = 7),
  adm AS (SELECT session_key, CASE WHEN session_key IN (SELECT session_key FROM fixed) THEN 'FIXED_EXCLUDED' WHEN d IS NULL OR d NOT BETWEEN 30 AND 259200 THEN 'RECORD_EXCLUDED' ELSE 'PLANNED' END AS status, d FROM inv)
"""


@query("P7_record_admission", _ADMIT + """SELECT session_key, status, CASE status WHEN 'FIXED_EXCLUDED' THEN 'SOURCE_DURATION_CONFLICT' WHEN 'RECORD_EXCLUDED' THEN 'INVALID_ROOT_DURATION' END AS reason,
  CASE WHEN status = 'PLANNED' THEN floor(d / 30)::BIGINT END AS epoch_count, CASE WHEN status = 'PLANNED' THEN floor(d / 30)::BIGINT * 360000 END AS estimated_bytes FROM adm""")
def p7(t):
    return admission(t).select("session_key", "status", "reason", "epoch_count", "estimated_bytes")


def ledger(t: Tables) -> DataFrame:
    a = admission(t)
    ok = grid.planned(a).where("session_key % 9 <> 4").select("session_key", "epoch_count", (F.col("session_key") % 20).alias("shard_no"))
    failed = t.lineitem.where("l_orderkey % 9 = 4 OR l_orderkey % 50 = 1").select(
        F.col("l_orderkey").alias("session_key"), F.concat(F.lit("error "), F.col("l_suppkey").cast("string")).alias("error"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("failed_at"))
    return release.release_ledger(ok, grid.excluded(a), failed)


_LEDGER2 = _ADMIT + """, ok AS (SELECT session_key, floor(d / 30)::BIGINT AS epoch_count, session_key % 20 AS shard_no FROM adm WHERE status = 'PLANNED' AND session_key % 9 <> 4),
  fl AS (SELECT l_orderkey AS session_key, arg_max('error ' || l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS reason FROM lineitem WHERE l_orderkey % 9 = 4 OR l_orderkey % 50 = 1 GROUP BY 1),
  led AS (SELECT session_key, epoch_count, shard_no, 'QC_PASSED' AS status, NULL AS reason FROM ok UNION ALL
   SELECT session_key, NULL, NULL, status, CASE status WHEN 'FIXED_EXCLUDED' THEN 'SOURCE_DURATION_CONFLICT' ELSE 'INVALID_ROOT_DURATION' END FROM adm WHERE status <> 'PLANNED'
   UNION ALL SELECT session_key, NULL, NULL, 'FAILED_PENDING_REVIEW', reason FROM fl WHERE session_key NOT IN (SELECT session_key FROM ok))
"""


@query("K9_release_ledger", _LEDGER2 + "SELECT * FROM led")
def k9(t):
    return ledger(t)


@query("O4_heterogeneous_union", _LEDGER2 + "SELECT status, count(*) AS rows, count(epoch_count) AS with_epochs, count(reason) AS with_reason FROM led GROUP BY 1")
def o4(t):
    return ledger(t).groupBy("status").agg(F.count("*").alias("rows"), F.count("epoch_count").alias("with_epochs"),
                                           F.count("reason").alias("with_reason"))


@query("A41_release_totals", _LEDGER2 + """SELECT count(*) AS candidate_records, count(*) FILTER (status = 'QC_PASSED') AS published_records, count(*) FILTER (status = 'FAILED_PENDING_REVIEW') AS failed_records,
  count(*) FILTER (status IN ('FIXED_EXCLUDED', 'RECORD_EXCLUDED')) AS excluded_records, count(DISTINCT shard_no) AS committed_shards,
  (SELECT count(DISTINCT session_key % 25) FROM adm WHERE status = 'PLANNED') AS planned_shards FROM led""")
def a41(t):
    shards = grid.planned(admission(t)).select((F.col("session_key") % 25).alias("shard_no"))
    return release.release_totals(ledger(t), shards)


@query("O5_key_set_operations", """SELECT 'left_only' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
  SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL
  SELECT 'right_only', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)""")
def o5(t):
    return inventory.key_sets(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), ["k"])


@query("O6_last_wins", """SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey)) AS l_partkey FROM lineitem GROUP BY 1, 2""")
def o6(t):
    return inventory.last_wins(t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"),
                               ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("O7_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def o7(t):
    return audits.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


_PATH = ("CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('signals\\\\shards\\\\s-', page_id, '.h5') WHEN 2 THEN concat('a/../../s-', page_id, '.h5')"
         " WHEN 3 THEN concat('C:\\\\x-', page_id, '.h5') WHEN 4 THEN concat('a/b/../s-', page_id, '.h5') ELSE concat('tasks/t-', page_id, '.h5.partial') END")


@query("F13_path_safety", """SELECT page_id, replace(p, chr(92), '/') AS key, page_id % 6 IN (1, 4) OR (page_id % 6 = 0 AND url LIKE '%.h5') AS safe FROM (SELECT page_id, url, """
       + _PATH.replace("\\\\", "\\") + " AS p FROM pages)")
def f13(t):
    key = path_key(F.expr(_PATH))
    return t.pages.select("page_id", key.alias("key"), path_is_safe(key).alias("safe"))


@query("F14_index_digest", """WITH h AS (SELECT conv_id // 16 AS shard_id, conv_id, turn, sha256(conv_id || ':' || turn || ':' || turn * 30000000000) AS h FROM conversations),
  b AS (SELECT shard_id, conv_id, turn // 3 AS b, sha256(string_agg(h, ',' ORDER BY turn)) AS h FROM h GROUP BY 1, 2, 3), r AS (SELECT shard_id, conv_id, sha256(string_agg(h, ',' ORDER BY b)) AS h FROM b GROUP BY 1, 2),
  g AS (SELECT shard_id, substr(sha256(conv_id::VARCHAR), 1, 3) AS g, sha256(string_agg(h, ',' ORDER BY conv_id)) AS h FROM r GROUP BY 1, 2)
  SELECT shard_id, sha256(string_agg(h, ',' ORDER BY g)) AS index_digest FROM g GROUP BY 1""")
def f14(t):
    rows = t.conversations.select(F.floor(F.col("conv_id") / 16).alias("shard_id"), F.col("conv_id").alias("recording_id"),
                                  F.col("turn").alias("epoch_in_record"), (F.col("turn") * 30_000_000_000).alias("epoch_start_offset_ns"))
    return release.index_digest(rows, block=3)


_LINES = """f AS (SELECT s_nationkey, string_agg(line, '' ORDER BY s_suppkey) AS body FROM (SELECT *, s_suppkey || '|' || s_name || chr(10) AS line FROM supplier) GROUP BY 1)"""


def nation_files(t: Tables) -> DataFrame:
    """One text file a nation, its lines in key order: (path, bytes)."""
    path = scratch_path(t.spark, "files")
    lines = t.supplier.select("s_nationkey", "s_suppkey", F.concat_ws("|", "s_suppkey", "s_name").alias("value"))
    (lines.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").drop("s_suppkey")
     .write.partitionBy("s_nationkey").text(path))
    return digests.stored_files(t.spark, path, "*.txt")


def nation_key():
    return F.regexp_extract("path", r"s_nationkey=(\d+)/", 1).cast("int").alias("s_nationkey")


@query("F14_file_checksums", f"WITH {_LINES} SELECT s_nationkey, octet_length(encode(body))::BIGINT AS bytes, sha256(body) AS sha256 FROM f")
def f14b(t):
    """Files hashed as streams."""
    return digests.file_digests(nation_files(t)).select(nation_key(), "bytes", "sha256")


_TREE = f"""WITH {_LINES}, n AS (SELECT *, length(body) AS bytes, ceil(length(body) / 16)::BIGINT AS blocks FROM f),
  l0 AS (SELECT s_nationkey, blocks, 0 AS level, i AS node, sha256('leaf:' || substr(body, i * 16 + 1, 16)) AS digest FROM n, range(blocks) g(i)),
  """ + ", ".join(f"""l{k} AS (SELECT s_nationkey, blocks, {k} AS level, node // 8 AS node, sha256('node:' || string_agg(digest, ',' ORDER BY node)) AS digest
  FROM l{k - 1} WHERE blocks > {8 ** (k - 1)} GROUP BY 1, 2, 4)""" for k in range(1, 7))


@query("F14_block_tree", _TREE + " SELECT s_nationkey, blocks, level::INT AS level, node, digest FROM (" + " UNION ALL ".join(f"FROM l{k}" for k in range(7)) + ")")
def f14c(t):
    """Trees of eight nodes to a parent over blocks of 16 bytes, every node of every file."""
    return digests.block_tree(nation_files(t), block=16, fan=8).select(nation_key(), "blocks", "level", "node", "digest")


@query("F14_checked_ranges", f"""WITH {_LINES}, w AS (SELECT s_suppkey, s_nationkey, (s_suppkey * 37 % 2000)::BIGINT AS "at", (s_suppkey % 50)::BIGINT AS size FROM supplier)
  SELECT s_suppkey, "at", size, size > 0 AND "at" + size <= length(body) AND s_nationkey % 5 <> 2 AS intact FROM w JOIN f USING (s_nationkey)""")
def f14d(t):
    """One range a supplier against trusted roots, of which every fifth nation's is another file's."""
    files = nation_files(t)
    nodes = write_once(digests.block_tree(files, block=16, fan=8), "nation-trees")
    trusted = digests.roots(nodes).withColumn("digest", F.when(nation_key() % 5 == 2, F.lit("other")).otherwise(F.col("digest")))
    asked = t.supplier.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") * 37 % 2000).alias("at"), (F.col("s_suppkey") % 50).alias("size"))
    wanted = asked.join(files.select(nation_key(), "path"), "s_nationkey")
    return digests.check_ranges(nodes, wanted, trusted, block=16, fan=8).select("s_suppkey", "at", "size", "intact")


@query("J10_signal_task_binding", lq.CTE + """, s AS (SELECT recording_id, epoch_in_record, epoch_in_record * 30000000000 + (recording_id % 20 = 3)::INT AS ns FROM slot),
  kk AS (SELECT recording_id, epoch_in_record, epoch_in_record * 30000000000 AS ns FROM lab)
  SELECT recording_id, epoch_in_record, CASE WHEN kk.ns IS NULL THEN 'task_missing' WHEN s.ns IS NULL THEN 'signal_missing' ELSE 'offset' END AS problem
  FROM s FULL JOIN kk USING (recording_id, epoch_in_record) WHERE kk.ns IS DISTINCT FROM s.ns""")
def j10(t):
    left = lq.slots(t).withColumn("epoch_start_offset_ns", F.col("epoch_start_offset_ns") + (F.col("recording_id") % 20 == 3).cast("int"))
    right = lq.keyed(t).withColumn("epoch_start_offset_ns", F.col("epoch_in_record") * 30_000_000_000)
    return audits.binding_violations(left, right)


@query("V8_binding_documents_labels", "SELECT doc_id, 'task_missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def v8(t):
    ns = F.lit(0).alias("epoch_start_offset_ns")
    return audits.binding_violations(t.documents.select("doc_id", ns), t.labels.select("doc_id", ns), ["doc_id"])


# --- audits on mutated QC rows: each must report exactly the mutated rows ---------------------
_MUT = "(recording_id * 7 + epoch_in_record * 3 + length(channel)) % 10"


@query("V1_flag_audit", CTE + f""", z AS (SELECT *, CASE WHEN {_MUT} = 1 THEN flags | 128 ELSE flags END AS f, CASE WHEN {_MUT} = 2 THEN 0 WHEN {_MUT} = 3 THEN 127 ELSE evaluated END AS e FROM qc)
  SELECT {_ID}, 'reserved_bit' AS problem FROM z WHERE (f | e) & 128 > 0 UNION ALL SELECT {_ID}, 'hit_without_evaluation' FROM z WHERE f & ~e & 127 > 0
  UNION ALL SELECT {_ID}, 'inapplicable_evaluation' FROM z WHERE e & ~appl & 127 > 0""")
def v1(t):
    k = F.expr(_MUT)
    z = (sq.qc(t).withColumn("hard_flags", F.when(k == 1, F.col("hard_flags").bitwiseOR(128)).otherwise(F.col("hard_flags")))
         .withColumn("hard_evaluated_flags", F.when(k == 2, 0).when(k == 3, 127).otherwise(F.col("hard_evaluated_flags"))))
    return audits.flag_violations(z)


@query("V2_code_audit", CTE + f"SELECT {_ID}, 'primary_code' AS problem FROM qc WHERE {_MUT} = 4")
def v2(t):
    k = F.expr(_MUT)
    return audits.code_violations(sq.qc(t).withColumn("hard_code", F.when(k == 4, F.col("hard_code") + 1).otherwise(F.col("hard_code"))))


@query("V3_mask_audit", CTE + f"SELECT {_ID}, 'valid' AS problem FROM qc WHERE {_MUT} = 5 UNION ALL SELECT {_ID}, 'artifact_valid' FROM qc WHERE {_MUT} = 6")
def v3(t):
    k = F.expr(_MUT)
    z = (sq.qc(t).withColumn("valid", F.when(k == 5, ~F.col("valid")).otherwise(F.col("valid")))
         .withColumn("artifact_valid", F.when(k == 6, ~F.col("artifact_valid")).otherwise(F.col("artifact_valid"))))
    return audits.mask_violations(z)


@query("V4_index_contiguity", """SELECT conv_id, CASE WHEN conv_id % 6 = 0 THEN 'gap' ELSE 'offset' END AS problem FROM conversations
  GROUP BY conv_id HAVING conv_id % 6 = 0 OR (conv_id % 6 = 1 AND max(turn) >= 1)""")
def v4(t):
    r = F.col("conv_id") % 6
    rows = t.conversations.select("conv_id", F.when(r == 0, F.col("turn") + 1).otherwise(F.col("turn")).alias("epoch_in_record"))
    ns = F.col("epoch_in_record") * 30_000_000_000 + F.when((F.col("conv_id") % 6 == 1) & (F.col("epoch_in_record") == 1), 5).otherwise(0)
    return audits.index_violations(rows.withColumn("epoch_start_offset_ns", ns), ["conv_id"])


@query("V5_sample_audit", CTE + f"SELECT {_ID}, 'finite' AS problem FROM ev WHERE coalesce(outn, 1) > 0 UNION ALL SELECT {_ID}, 'length' FROM ev WHERE {_MUT} = 7")
def v5(t):
    z = sq.live_epochs(t).withColumn("samples", F.when(F.expr(_MUT) == 7, F.concat(F.col("samples"), F.array(F.lit(0.0).cast("float")))).otherwise(F.col("samples")))
    return audits.sample_violations(z, 64)


@query("V6_grade_audit", CTE + sq._GRADES + """SELECT recording_id, '' AS channel, 'night_grade' AS problem FROM grades WHERE recording_id % 2 = 0 OR recording_id % 5 = 1
  UNION ALL SELECT recording_id, channel, 'usable_hours' FROM hrs WHERE channel IN ('e1', 'e2')""")
def v6(t):
    q = sq.qc(t)
    hours = rules.usable_hours(q, 1.0)
    # Some nights have another grade and some are not published; one channel's hours differ and one's are absent.
    published_ = rules.night_grade(hours).where("recording_id % 5 <> 1").withColumn("night_grade", F.col("night_grade") + (F.col("recording_id") % 2 == 0).cast("int"))
    moved = hours.withColumn("usable_hours", F.col("usable_hours") + F.when(F.col("channel") == "e1", 1e-9).otherwise(0.0)).where("channel <> 'e2'")
    return audits.grade_violations(q, published_, moved, 1.0)


@query("V7_metric_flag_audit", CTE + f"SELECT {_ID}, 'saturation_fraction' AS problem FROM qc WHERE sat IS NOT NULL AND {_MUT} = 8")
def v7(t):
    flipped = F.when(F.col("saturation_fraction").isNotNull() & (F.expr(_MUT) == 8), F.col("hard_flags").bitwiseXOR(4)).otherwise(F.col("hard_flags"))
    return audits.metric_violations(sq.qc(t).withColumn("hard_flags", flipped), sq.SPEC)


@query("V10_structure_audit", "SELECT o_orderkey, 'structure_code' AS problem FROM orders WHERE o_orderkey % 6 >= 2")
def v10(t):
    return audits.structure_violations(t.orders.select("o_orderkey", (F.col("o_orderkey") % 6).alias("structure_code")), "o_orderkey")


@query("V13_batch_contract", CTE + f"SELECT {_ID}, 'channel_mask' AS problem FROM qc WHERE {_MUT} = 1 UNION ALL SELECT {_ID}, 'data_valid' FROM qc WHERE {_MUT} = 2 AND valid UNION ALL SELECT {_ID}, 'rate' FROM qc WHERE {_MUT} = 3 UNION ALL SELECT {_ID}, 'valid' FROM qc WHERE valid AND {_MUT} = 1")
def v13(t):
    k = F.expr(_MUT)
    rows = sq.qc(t).join(sq.live_epochs(t).select("recording_id", "channel", "epoch_in_record", rules.zero_fill(F.col("samples")).alias("samples")),
                         ["recording_id", "channel", "epoch_in_record"])
    rows = (rows.withColumn("epoch_mask", F.lit(True)).withColumn("channel_mask", F.lit(True))
            .withColumn("channel_available", k != 1).withColumn("data_valid", F.col("valid") & (k != 2))
            .withColumn("sample_rate_hz", F.when(k == 3, 0.0).otherwise(200.0)))
    return release.batch_contract_violations(rows, ["recording_id", "channel", "epoch_in_record"])


@query("V14_batch_compatibility", """SELECT o_custkey, CASE WHEN c.p = 1 THEN 'units' ELSE 'night_grade' END AS problem FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS u, count(*) AS n,
  count(CASE WHEN o_orderkey % 5 <> 0 THEN 1 END) AS g FROM orders GROUP BY 1) s, (VALUES (1), (2)) c(p) WHERE (c.p = 1 AND u > 1) OR (c.p = 2 AND g NOT IN (0, n))""")
def v14(t):
    rows = t.orders.select("o_custkey", F.lit("nights").alias("dataset"), F.col("o_orderstatus").alias("units"),
                           F.when(F.col("o_orderkey") % 5 != 0, 3).alias("night_grade"))
    return release.incompatible_batches(rows, "o_custkey", ["dataset", "units"], ["night_grade"])


@query("V15_packed_equal_inputs", "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 40 = 0 THEN 1 ELSE -1 END AS surplus FROM customer WHERE c_custkey % 40 IN (0, 1)")
def v15(t):
    a = t.customer.select("c_custkey", "c_nationkey")
    return audits.difference(a.where("c_custkey % 40 <> 1"), a.where("c_custkey % 40 <> 0"))


# --- adapters on stored epochs ----------------------------------------------------------------
@query("P12_data_valid", CTE + f"SELECT {_ID}, valid AND epoch_in_record < 6 AS data_valid FROM qc")
def p12(t):
    return sq._id(sq.qc(t).withColumn("epoch_mask", F.col("epoch_in_record") < 6), batches.data_valid().alias("data_valid"))


@query("P13_visibility", """SELECT vec_id, round(CASE WHEN label % 2 = 0 THEN list_sum(list_transform(embedding, lambda v, i: CASE WHEN (i - 1) % 4 <> 0 THEN v::DOUBLE ELSE 0 END)) ELSE 0 END, 6) AS total,
  len(list_filter(embedding, lambda v, i: label % 2 = 1 OR (i - 1) % 4 = 0))::INT AS zeros FROM embeddings""")
def p13(t):
    seen = F.transform("embedding", lambda v, i: i % 4 != 0)
    x = batches.active_samples(F.col("embedding"), F.col("label") % 2 == 0, seen)
    return t.embeddings.select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"),
                               F.size(F.filter(x, lambda v: v == 0)).alias("zeros"))


def grouped(t: Tables) -> DataFrame:
    rows = sq.epochs(t).withColumn("grp", m.group_column(F.col("channel"))).withColumn(
        "unit", F.when(F.col("channel") == "spo2", "%").otherwise("uV"))
    return batches.split_spo2(rows)


_GRP = "CASE WHEN vec_id % 15 = 14 THEN 'spo2' WHEN vec_id % 15 >= 12 THEN 'respiratory' WHEN vec_id % 15 >= 9 THEN 'emg' WHEN vec_id % 15 = 8 THEN 'ecg' WHEN vec_id % 15 >= 6 THEN 'eog' ELSE 'eeg' END"


@query("P14_fixed_scale", f"""SELECT vec_id // 120 AS recording_id, ((vec_id % 120) // 15)::INT AS epoch_in_record, {_GRP} AS grp, (vec_id % 15)::INT AS channel_idx,
  CASE {_GRP} WHEN 'spo2' THEN '(%-95)/5' WHEN 'eeg' THEN 'uV/50' ELSE 'uV' END AS unit,
  round(list_avg(list_transform(embedding, lambda v: CASE {_GRP} WHEN 'spo2' THEN (v::DOUBLE - 95) / 5 WHEN 'eeg' THEN v::DOUBLE / 50 ELSE v::DOUBLE END)), 5) AS level FROM embeddings""")
def p14(t):
    rows = batches.scale_groups(grouped(t), {"spo2": {"offset": 95, "divisor": 5}, "eeg": 50}, ["eeg", "eog", "ecg", "emg", "respiratory", "spo2"])
    level = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double")) / 64
    return rows.select("recording_id", "epoch_in_record", "grp", "channel_idx", "unit", F.round(level, 5).alias("level"))


@query("P15_group_split", f"SELECT {_GRP} AS grp, count(*) AS epochs, count(DISTINCT vec_id % 15) AS channels FROM embeddings GROUP BY 1")
def p15(t):
    return grouped(t).groupBy("grp").agg(F.count("*").alias("epochs"), F.count_distinct("channel").alias("channels"))


@query("P23_tasks_on_demand", lq.CTE + "SELECT recording_id, epoch_in_record, qc_code AS heart_rate_qc_code FROM te WHERE task = 'heart_rate'")
def p23(t):
    wanted = ("heart_rate",)
    release.check_release(m.RELEASE_VERSION, "COMPLETE", wanted)
    te = labels.task_epochs(lq.overlaid(t))
    return te.where(F.col("task").isin(*wanted)).select("recording_id", "epoch_in_record", F.col("qc_code").alias("heart_rate_qc_code"))
