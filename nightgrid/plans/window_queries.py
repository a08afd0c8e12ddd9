"""Windows, batches and samplers on conversations, orders, customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid.operators import batches, grid
from nightgrid.plans.registry import Tables, query


def records(t: Tables) -> DataFrame:
    """One recording per conversation; its turns are the epochs."""
    return (t.conversations.groupBy(F.col("conv_id").alias("recording_id"))
            .agg((F.max("turn") + 1).alias("n_epochs"))
            .withColumn("subject_id", F.floor(F.col("recording_id") / 2))
            .withColumn("night_grade", (F.col("recording_id") % 5 + 1).cast("int")))


_REC = """WITH rec AS (SELECT conv_id AS recording_id, max(turn) + 1 AS n_epochs, conv_id // 2 AS subject_id, (conv_id % 5 + 1)::INT AS night_grade
  FROM conversations GROUP BY conv_id)"""
_U = "('0x' || substr(sha256({}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616"


@query("W2_record_offset_in_shard", """SELECT o_orderkey, o_custkey % 50 AS shard, o_orderkey % 9 AS n_epochs,
  coalesce(sum(o_orderkey % 9) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_epoch FROM orders""")
def w2(t):
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 50).alias("shard"), (F.col("o_orderkey") % 9).alias("n_epochs"))
    return grid.first_epoch(rows, "shard", "o_orderkey")


@query("W3_context_windows_keep_tail", _REC + """SELECT recording_id, w AS window_no, w * 2 AS start_epoch, least(3, n_epochs - w * 2) AS n_epochs
  FROM rec, range(CAST(ceil(n_epochs / 2) AS BIGINT)) g(w)""")
def w3(t):
    return grid.context_windows(records(t), 3, 2)


@query("W3_context_windows_drop_last", _REC + """SELECT recording_id, w AS window_no, w * 2 AS start_epoch, least(3, n_epochs - w * 2) AS n_epochs
  FROM rec, range(CAST(greatest(0, floor((n_epochs - 3) / 2) + 1) AS BIGINT)) g(w)""")
def w3b(t):
    return grid.context_windows(records(t), 3, 2, drop_last=True)


@query("W3_window_members", _REC + """SELECT recording_id, w AS window_no, w * 2 AS start_epoch, least(3, n_epochs - w * 2) AS n_epochs, e AS epoch_in_record
  FROM rec, range(CAST(ceil(n_epochs / 2) AS BIGINT)) g(w), range(w * 2, w * 2 + least(3, n_epochs - w * 2)) h(e)""")
def w3c(t):
    return grid.window_epochs(grid.context_windows(records(t), 3, 2))


_ENDS = _REC + """, ends AS (SELECT recording_id, n_epochs, ceil(n_epochs / 2)::BIGINT AS n_windows,
  sum(ceil(n_epochs / 2)::BIGINT) OVER (ORDER BY recording_id)::BIGINT AS window_end FROM rec)"""


@query("W5_global_index_lookup", _ENDS + """, idx AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 7919 % w.total ELSE -1 - o_orderkey * 7919 % w.total END AS index FROM orders, (SELECT max(window_end) AS total FROM ends) w),
  r AS (SELECT o_orderkey, index, CASE WHEN index < 0 THEN index + (SELECT max(window_end) FROM ends) ELSE index END AS i FROM idx)
  SELECT o_orderkey, index, recording_id, (i - (window_end - n_windows)) * 2 AS start_epoch, least(3, n_epochs - (i - (window_end - n_windows)) * 2) AS length
  FROM r JOIN ends ON i >= window_end - n_windows AND i < window_end""")
def w5(t):
    ends = grid.window_ends(records(t), "recording_id", 3, 2)
    total = ends.agg(F.max("window_end").alias("total"))
    k = F.col("o_orderkey") * 7919 % F.col("total")
    idx = (t.orders.crossJoin(F.broadcast(total))  # one row
           .select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, k).otherwise(-1 - k).alias("index")))
    return grid.locate(ends, idx, 2, 3).select("o_orderkey", "index", "recording_id", "start_epoch", "length")


@query("W10_order_violations", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS start_us, value < 400 AS real FROM events),
  p AS (SELECT *, max(CASE WHEN real THEN start_us END) OVER (PARTITION BY user_id ORDER BY start_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_start FROM e)
  SELECT user_id, event_id, start_us, previous_start FROM p WHERE real AND previous_start >= 0 AND start_us - previous_start < 3600000000""")
def w10(t):
    rows = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"),
                           (F.col("value") < 400).alias("real"))
    out = grid.order_violations(rows, ["user_id"], "start_us", 3_600_000_000, F.col("real"), width=900_000_000)
    return out.select("user_id", "event_id", "start_us", "previous_start")


@query("W11_greedy_shards", """WITH RECURSIVE src AS (SELECT c_custkey, CAST(abs(c_acctbal) * 100 AS BIGINT) AS size, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
  w(pos, n, load, shard_no) AS (SELECT pos, 1, size, 0::BIGINT FROM src WHERE pos = 0 UNION ALL
   SELECT s.pos, CASE WHEN w.n >= 16 OR w.load + s.size > 6000000 THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n >= 16 OR w.load + s.size > 6000000 THEN s.size ELSE w.load + s.size END,
    w.shard_no + CASE WHEN w.n >= 16 OR w.load + s.size > 6000000 THEN 1 ELSE 0 END FROM w JOIN src s ON s.pos = w.pos + 1)
  SELECT c_custkey, size, shard_no, pos AS position FROM w JOIN src USING (pos)""")
def w11(t):
    size = F.expr("CAST(round(abs(c_acctbal) * 100) AS BIGINT)")
    rows = t.customer.select("c_custkey", size.alias("size"))
    return batches.greedy_batches(rows, "c_custkey", "c_custkey", "size", 16, 6_000_000, block=512)


@query("W11_text_key_shards", """WITH RECURSIVE src AS (SELECT c_name AS session_key, CAST(abs(c_acctbal) * 100 AS BIGINT) AS size, row_number() OVER (ORDER BY c_name) - 1 AS pos FROM customer),
  w(pos, n, load, shard_no) AS (SELECT pos, 1, size, 0::BIGINT FROM src WHERE pos = 0 UNION ALL
   SELECT s.pos, CASE WHEN w.n >= 5 OR w.load + s.size > 2000000 THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n >= 5 OR w.load + s.size > 2000000 THEN s.size ELSE w.load + s.size END,
    w.shard_no + CASE WHEN w.n >= 5 OR w.load + s.size > 2000000 THEN 1 ELSE 0 END FROM w JOIN src s ON s.pos = w.pos + 1)
  SELECT session_key, size, shard_no, pos AS position FROM w JOIN src USING (pos)""")
def w11b(t):
    """Packing in the order of a text key; small blocks, so that the tree has several levels."""
    rows = t.customer.select(F.col("c_name").alias("session_key"), F.expr("CAST(round(abs(c_acctbal) * 100) AS BIGINT)").alias("size"))
    return batches.greedy_batches(rows, "session_key", "session_key", "size", 5, 2_000_000, block=8)


def windows(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("window_index"),
                           F.when(F.col("o_custkey") % 3 == 0, 5).otherwise(F.col("o_orderkey") % 4 + 1).cast("int").alias("night_grade"),
                           F.when(F.col("o_custkey") % 10 == 0, "test").when(F.col("o_custkey") % 10 == 1, "validation")
                           .otherwise("train").alias("split"))


_WIN = """WITH win AS (SELECT o_orderkey AS window_index, CASE WHEN o_custkey % 3 = 0 THEN 5 ELSE o_orderkey % 4 + 1 END::INT AS night_grade,
  CASE o_custkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM orders)"""


@query("W12_grade_batches", _WIN + f""", g AS (SELECT night_grade, count(*) AS n, row_number() OVER (ORDER BY night_grade) - 1 AS gi, count(*) OVER () AS gs FROM win GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY night_grade ORDER BY window_index) - 1 AS rank FROM win),
  d AS (SELECT b AS batch_no, s AS slot, floor({_U.format("'42:grade:' || b")} * 5) AS gi, {_U.format("'42:window:' || b || ':' || s")} AS u FROM range(200) x(b), range(16) y(s))
  SELECT batch_no, slot, r.night_grade, window_index, split FROM d JOIN g ON g.gi = d.gi JOIN r ON r.night_grade = g.night_grade AND r.rank = floor(d.u * g.n)""")
def w12(t):
    return batches.grade_batches(windows(t), 16, 200)


@query("D1_exact_once_batches", _WIN + """, r AS (SELECT *, row_number() OVER (PARTITION BY night_grade ORDER BY sha256('9:1:' || window_index), window_index) - 1 AS k FROM win)
  SELECT window_index, night_grade, split, k // 32 AS batch_no, k % 32 AS slot FROM r""")
def d1(t):
    return batches.exact_once_batches(windows(t), 32, 9, 1)


@query("D1_permuted_batches", _WIN.replace("WITH win", "WITH RECURSIVE win") + """, k AS (SELECT *, row_number() OVER (PARTITION BY night_grade ORDER BY window_index) - 1 AS k, count(*) OVER (PARTITION BY night_grade) AS n FROM win),
  p AS (SELECT window_index, night_grade, split, n, ceil(sqrt(n))::BIGINT AS a, k // ceil(sqrt(n))::BIGINT AS l, k % ceil(sqrt(n))::BIGINT AS r, 0 AS i FROM k
   UNION ALL SELECT window_index, night_grade, split, n, a, (r + a - ('0x' || substr(sha256('9:1:' || night_grade || ':' || (3 - i % 4) || ':' || l), 1, 12))::BIGINT % a) % a, l, i + 1 FROM p WHERE i % 4 <> 0 OR i = 0 OR l * a + r >= n)
  SELECT window_index, night_grade, split, (l * a + r) // 32 AS batch_no, (l * a + r) % 32 AS slot FROM p WHERE i > 0 AND i % 4 = 0 AND l * a + r < n""")
def d1b(t):
    """A pass as an expression on rows indexed once; no sort by a hash per pass."""
    rows = windows(t)
    # At most five rows.
    sizes = rows.groupBy("night_grade").agg(F.count("*").alias("grade_size"))
    indexed = batches.dense_index(rows, ["window_index"], batches.data_bucket(rows, "window_index"), "grade_index", ["night_grade"])
    return batches.permuted_batches(indexed.join(F.broadcast(sizes), "night_grade"), 32, 9, 1).drop("grade_index", "grade_size")


@query("D4_fixed_subset", _WIN + """SELECT window_index, night_grade, split FROM win
  QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256('5:' || window_index), window_index) <= 100""")
def d4(t):
    return batches.fixed_subset(windows(t), 100, 5)


_PADQ = _REC + """, w AS (SELECT recording_id, w AS window_no, w * 2 AS start_epoch, least(3, n_epochs - w * 2) AS n_epochs, recording_id // 4 AS batch_no, (recording_id % 4) * 4 + w AS slot
  FROM rec, range(CAST(ceil(n_epochs / 2) AS BIGINT)) g(w)), mx AS (SELECT batch_no, max(n_epochs) AS m FROM w GROUP BY 1)"""


@query("W13_pad_batches", _PADQ + """SELECT batch_no, slot, p AS position, p < n_epochs AS epoch_mask, CASE WHEN p < n_epochs THEN start_epoch + p ELSE -1 END AS epoch_in_record,
  CASE WHEN p < n_epochs THEN (start_epoch + p) * 30000000000 ELSE -1 END AS epoch_start_offset_ns FROM w JOIN mx USING (batch_no), range(m) g(p)""")
def w13(t):
    w = grid.context_windows(records(t), 3, 2)
    w = (w.withColumn("batch_no", F.floor(F.col("recording_id") / 4))
         .withColumn("slot", (F.col("recording_id") % 4) * 4 + F.col("window_no")))
    e = grid.window_epochs(w).select(
        "batch_no", "slot", (F.col("epoch_in_record") - F.col("start_epoch")).alias("position"), "epoch_in_record",
        (F.col("epoch_in_record") * 30_000_000_000).alias("epoch_start_offset_ns"))
    return batches.pad_batches(w, e)


@query("W14_pad_samples", """SELECT vec_id, 80 AS width, len(list_filter(embedding[1:40 + label], lambda v: true))::INT AS real_samples, 80 - (40 + label) AS padded FROM embeddings""")
def w14(t):
    part = F.slice("embedding", F.lit(1), F.lit(40) + F.col("label"))
    values, mask = batches.pad_samples(part, F.lit(80))
    return t.embeddings.select("vec_id", F.size(values).alias("width"), F.size(F.filter(mask, lambda v: v)).alias("real_samples"),
                               F.size(F.filter(mask, lambda v: ~v)).alias("padded"))


@query("W16_channel_dropout", f"""WITH c AS (SELECT vec_id // 6 AS window_id, 'eeg' AS modality, (vec_id % 6)::INT AS channel_idx, label > 1 AS vis FROM embeddings),
  p AS (SELECT *, vis AND {_U.format("'3:' || window_id || ':eeg:' || channel_idx")} < 0.6 AS try FROM c),
  k AS (SELECT *, sum(vis::INT) OVER (PARTITION BY window_id) AS n, sum(try::INT) OVER (PARTITION BY window_id ORDER BY channel_idx) AS place FROM p)
  SELECT window_id, modality, channel_idx, try AND place <= n - 1 AS dropped, vis AND NOT (try AND place <= n - 1) AS channel_mask FROM k""")
def w16(t):
    rows = t.embeddings.select(F.floor(F.col("vec_id") / 6).alias("window_id"), F.lit("eeg").alias("modality"),
                               (F.col("vec_id") % 6).cast("int").alias("channel_idx"), (F.col("label") > 1).alias("channel_mask"))
    return batches.channel_dropout(rows, 0.6, 1, 3)


@query("P11_split_and_grade_filter", _REC + f"""SELECT recording_id, n_epochs, subject_id, night_grade FROM rec
  WHERE night_grade IN (2, 5) AND {_U.format("'42:nights:' || subject_id")} < 0.8""")
def p11(t):
    return grid.select_records(records(t), "nights", "train", grades=[2, 5])


@query("F16_time_columns", _REC + """SELECT recording_id, w AS window_no, w * 60::DOUBLE AS start_sec, least(3, n_epochs - w * 2) * 30::DOUBLE AS duration_sec, n_epochs * 30::DOUBLE AS recording_duration_sec
  FROM rec, range(CAST(ceil(n_epochs / 2) AS BIGINT)) g(w)""")
def f16(t):
    r = records(t)
    w = grid.context_windows(r.withColumn("total", F.col("n_epochs")), 3, 2, keys=("recording_id", "total"))
    return w.select("recording_id", "window_no", (F.col("start_epoch") * 30.0).alias("start_sec"),
                    (F.col("n_epochs") * 30.0).alias("duration_sec"), (F.col("total") * 30.0).alias("recording_duration_sec"))


@query("V16_window_inside_recording", _REC + """SELECT recording_id, w AS window_no, w * 2 AS start_epoch, least(3, n_epochs - w * 2) + w % 2 AS n_epochs
  FROM rec, range(CAST(ceil(n_epochs / 2) AS BIGINT)) g(w) WHERE w * 2 + least(3, n_epochs - w * 2) + w % 2 > n_epochs""")
def v16(t):
    from nightgrid.operators import release
    r = records(t)
    w = grid.context_windows(r, 3, 2).withColumn("n_epochs", F.col("n_epochs") + F.col("window_no") % 2)
    return release.window_violations(w, r)
