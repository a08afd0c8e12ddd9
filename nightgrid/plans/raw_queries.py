"""Raw recordings, binary files, kernels, range audit, vectors and evaluation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions import columns as c
from nightgrid.functions import dsp
from nightgrid.operators import calibrate, chunked, digests, kernels, ranges, raw, rules, scan, vectors
from nightgrid.plans import preprocess
from nightgrid.plans import signal_queries as sq
from nightgrid.plans.registry import Tables, query
from nightgrid.session import scratch_path, spread
from nightgrid.sources import edf, files, published, registry

# --- manifest: orders are files, line items are their channels ---------------------------------
_FILE = ["concat('/n/', o_orderkey, '.h5') AS path", "concat(o_orderkey, '.h5') AS relative_path", "CAST(o_custkey AS STRING) AS subject_id",
         "CAST(o_orderkey AS STRING) AS session_id", "CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice / CAST(50 AS DOUBLE) ELSE 0 END AS duration_sec",
         "o_orderkey * 10 AS file_size"]
_CHAN = ["concat('/n/', l_orderkey, '.h5') AS path",
         "CASE l_linenumber WHEN 1 THEN 'C4-M1' WHEN 2 THEN 'c3-m2' WHEN 3 THEN 'E1' WHEN 4 THEN 'e2' WHEN 5 THEN 'ptaf' WHEN 6 THEN 'airflow' ELSE 'SpO2' END AS source_name",
         "CAST(l_partkey % 50 * 1000 AS BIGINT) AS length", "CAST(CASE l_linenumber % 3 WHEN 0 THEN 100 WHEN 1 THEN 200 ELSE 50 END AS DOUBLE) AS fs",
         "'int16' AS dtype", "'uV' AS unit", "'' AS type", "CAST(-100 AS DOUBLE) AS dig_min", "CAST(100 AS DOUBLE) AS dig_max",
         "CAST(-10 AS DOUBLE) AS phys_min", "CAST(10 AS DOUBLE) AS phys_max", "CASE WHEN l_partkey % 40 = 0 THEN 2 ELSE 1 END AS ndim"]


def channel_rows(t: Tables) -> DataFrame:
    path, *fields = _CHAN
    # Dealt by file before anything is grouped: a task holds its share of the files, not of the table.
    rows = spread(t.lineitem.selectExpr(path, "l_linenumber", "l_partkey"), "path").selectExpr("path", *fields)
    rest = [x for x in rows.columns if x not in ("path", "source_name")]
    # Line numbers repeat inside an order; the longest of equal names stands for the channel.
    best = rows.groupBy("path", "source_name").agg(F.max(F.struct("length", *[x for x in rest if x != "length"])).alias("r"))
    return best.select("path", "source_name", "r.*")


def manifest(t: Tables) -> DataFrame:
    f = t.orders.selectExpr(*_FILE).withColumn("annotations", F.array(F.lit("expert/stage")))
    return raw.manifest_records(f, channel_rows(t))


def inspected(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Files and their channels in long form; no maps are folded only to be opened again."""
    named = raw.long_channels(channel_rows(t))
    f = t.orders.selectExpr(*_FILE).withColumn("annotations", F.array(F.lit("expert/stage")))
    return raw.inspect_files(f, named), named


_U = "('0x' || substr(sha256('42:' || subject_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616"
CTE = f"""WITH fil AS (SELECT {', '.join(_FILE)} FROM orders),
cr AS (SELECT *, row_number() OVER (PARTITION BY path, source_name ORDER BY length DESC, fs DESC, ndim DESC) AS k FROM (SELECT {', '.join(_CHAN)} FROM lineitem)),
chn AS (SELECT *, lower(source_name) AS channel FROM cr WHERE k = 1 AND ndim = 1),
agg AS (SELECT path, count(*) AS channels, min(length / fs) FILTER (fs > 0) AS short FROM chn GROUP BY 1),
man AS (SELECT fil.* EXCLUDE (duration_sec), channels, CASE WHEN duration_sec > 0 THEN duration_sec ELSE coalesce(short, 0) END AS d,
  CASE WHEN channels IS NULL THEN 'missing signals' WHEN (CASE WHEN duration_sec > 0 THEN duration_sec ELSE coalesce(short, 0) END) <= 0 THEN 'recording duration is missing or non-positive' END AS error FROM fil LEFT JOIN agg USING (path))
"""


@query("S4_raw_manifest_inspection", CTE + f"""SELECT path, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error, CASE WHEN error IS NULL THEN d END AS duration_sec, CASE WHEN error IS NULL THEN channels END AS channels,
  CASE WHEN error IS NULL THEN CASE WHEN {_U} < 0.8 THEN 'train' WHEN {_U} < 0.9 THEN 'validation' ELSE 'test' END END AS split FROM man""")
def s4(t):
    return inspected(t)[0].select("path", "status", "error", "duration_sec", "channels", "split")


@query("K5_manifest_sink_and_S11_scan", CTE + "SELECT path, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, CASE WHEN error IS NULL THEN channels END AS channels FROM man")
def k5(t):
    path = scratch_path(t.spark, "manifest")
    raw.write_manifest(manifest(t), path)
    return raw.read_manifest(t.spark, path).select("path", "status", F.when(F.col("status") == "ok", F.size("signals").cast("bigint")).alias("channels"))


@query("A42_manifest_summary", CTE + """, ok AS (SELECT chn.* FROM chn JOIN man USING (path) WHERE error IS NULL)
  SELECT 'status' AS kind, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS key, '' AS rate, count(*) AS n FROM man GROUP BY ALL UNION ALL SELECT 'channel', channel, '', count(*) FROM ok GROUP BY ALL
  UNION ALL SELECT 'rate', channel, fs::INT::VARCHAR, count(*) FROM ok GROUP BY ALL""")
def a42(t):
    return raw.manifest_summary(*inspected(t))


GROUPS = {"eeg": (("c4-m1", "c3-m2"),), "eog": ("e1", "e2"), "resp": (("airflow", "ptaf"), "abd")}
_SLOTS = "(VALUES ('eeg',0,'c4-m1',0,'c4-m1'),('eeg',0,'c4-m1',1,'c3-m2'),('eog',0,'e1',0,'e1'),('eog',1,'e2',0,'e2'),('resp',0,'airflow',0,'airflow'),('resp',0,'airflow',1,'ptaf'),('resp',1,'abd',0,'abd')) AS sl(modality, slot, slot_name, priority, channel)"
SEL = CTE + f""", okr AS (SELECT path, d FROM man WHERE error IS NULL), pick AS (SELECT path, modality, slot, arg_min(channel, priority) AS channel, arg_min(fs, priority) AS fs, arg_min(length, priority) AS length FROM chn JOIN {_SLOTS} USING (channel) GROUP BY 1, 2, 3),
  sel AS (SELECT okr.path, s.modality, s.slot, s.slot_name, coalesce(fs > 0 AND length > 0, false) AS available, CASE WHEN fs > 0 AND length > 0 THEN channel END AS source_channel, CASE WHEN fs > 0 AND length > 0 THEN fs END AS source_fs, CASE WHEN fs > 0 AND length > 0 THEN length END AS source_length,
   CASE WHEN channel IS NULL THEN s.modality || '/' || s.slot_name WHEN NOT (fs > 0 AND length > 0) THEN s.modality || '/' || s.slot_name || '(invalid)' END AS missing
   FROM okr CROSS JOIN (SELECT DISTINCT modality, slot, slot_name FROM {_SLOTS}) s LEFT JOIN pick ON pick.path = okr.path AND pick.modality = s.modality AND pick.slot = s.slot)
"""


def selection(t: Tables, groups=GROUPS) -> DataFrame:
    records, named = inspected(t)
    return raw.select_channels(records.where("status = 'ok'"), named, raw.profile_slots(t.spark, groups=groups))


@query("P16_channel_selection", SEL + "SELECT path, modality, slot, slot_name, source_channel, available, missing FROM sel")
def p16(t):
    return selection(t).select("path", "modality", "slot", "slot_name", "source_channel", "available", "missing")


@query("U3_custom_channel_groups", CTE + """SELECT path, bool_or(channel = 'e2') AS has_e2 FROM (SELECT path FROM man WHERE error IS NULL) LEFT JOIN chn USING (path) GROUP BY 1""")
def u3(t):
    records, named = inspected(t)
    named = named.withColumn("length", F.greatest("length", F.lit(1)))
    s = raw.select_channels(records.where("status = 'ok'"), named, raw.profile_slots(t.spark, groups={"eog": ["E2"]}))
    return s.select("path", F.col("available").alias("has_e2"))


@query("P17_missing_channel_policy", SEL + "SELECT path, count(*) AS slots FROM sel WHERE path NOT IN (SELECT path FROM sel WHERE missing IS NOT NULL AND modality <> 'resp') AND modality <> 'resp' GROUP BY 1")
def p17(t):
    s = selection(t).where("modality <> 'resp'")
    return raw.apply_missing_policy(s, "drop").groupBy("path").agg(F.count("*").alias("slots"))


@query("P18_modality_rates", SEL + """, fr AS (SELECT path, modality, arg_min(source_fs, slot) FILTER (source_fs IS NOT NULL) AS first, min(source_fs) AS lo, max(source_fs) AS hi FROM sel GROUP BY 1, 2),
  r AS (SELECT sel.*, coalesce(CASE modality WHEN 'resp' THEN 25::DOUBLE END, first, CASE modality WHEN 'resp' THEN 25::DOUBLE ELSE 100::DOUBLE END) AS rate, modality <> 'resp' AND lo < hi AS mixed FROM sel JOIN fr USING (path, modality))
  SELECT path, modality, slot, rate AS sample_rate, round_even(source_fs / rate, 0)::INT AS factor, CASE WHEN mixed THEN 'mixed_rates' WHEN source_fs / rate < 1 THEN 'unsupported_resampling' END AS problem FROM r""")
def p18(t):
    return raw.modality_rates(selection(t), {"resp": 25.0}).select("path", "modality", "slot", "sample_rate", "factor", "problem")


_LEN = SEL + ", len AS (SELECT sel.path, least(any_value(d), min(source_length / source_fs)) AS d, CAST(floor((least(any_value(d), min(source_length / source_fs)) + 1e-6) / 30) AS BIGINT) AS n FROM sel JOIN okr USING (path) GROUP BY 1)"


def lengths(t: Tables) -> DataFrame:
    return raw.raw_lengths(inspected(t)[0].where("status = 'ok'"), selection(t))


@query("W4_raw_windows_context", _LEN + "SELECT path, w AS window_no, w * 3 AS start_epoch, 4::BIGINT AS n_epochs FROM len, range(CASE WHEN n >= 4 THEN 1 + (n - 4) // 3 ELSE 0 END) g(w)")
def w4(t):
    return raw.raw_windows(lengths(t), "context", 4, 3)


@query("W4_raw_windows_night", _LEN + "SELECT path, 0::BIGINT AS window_no, 0::BIGINT AS start_epoch, n AS n_epochs FROM len WHERE n > 0")
def w4b(t):
    return raw.raw_windows(lengths(t), "night")


@query("P2_calibrate_lenient", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CASE WHEN label % 3 = 0 THEN v::DOUBLE ELSE (v::DOUBLE + 1) * 5 - 10 END)), 3) AS total FROM embeddings""")
def p2(t):
    rows = t.embeddings.select("vec_id", "embedding", F.when(F.col("label") % 3 != 0, -1.0).alias("dig_min"), F.lit(1.0).alias("dig_max"),
                               F.lit(-10.0).alias("phys_min"), F.lit(0.0).alias("phys_max"))
    x = calibrate.physical_lenient(F.col("embedding"))
    return rows.select("vec_id", F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double")), 3).alias("total"))


_FIR = """WITH tp AS (SELECT list_transform(range(-20, 21), lambda j: (CASE WHEN j = 0 THEN 1 ELSE sin(pi() * 0.45 * j) / (pi() * 0.45 * j) END) * (0.5 + 0.5 * cos(pi() * j / 20))) AS h),
  x AS (SELECT vec_id, list_transform(range(-20, 84), lambda i: embedding[(CASE WHEN i < 0 THEN -i WHEN i > 63 THEN 126 - i ELSE i END) + 1]::DOUBLE) AS w FROM embeddings)"""


@query("X7_integer_decimation", _FIR + "SELECT vec_id, k::INT AS place, round(list_sum(list_transform(range(1, 42), lambda j: h[j] * w[2 * k + j])) / list_sum(h), 6) AS value FROM x, tp, range(32) g(k)")
def x7(t):
    y = kernels.decimate_column(F.col("embedding"), F.lit(2))
    return t.embeddings.select("vec_id", F.posexplode(y).alias("place", "value")).withColumn("value", F.round("value", 6))


_I0 = "list_sum(list_transform(range(30), lambda k: pow({} * {} / 4, k) / pow(gamma(k + 1), 2)))"
_KAI = f"""WITH tp AS (SELECT list_transform(range(-50, 51), lambda j: (CASE WHEN j = 0 THEN 1 ELSE sin(pi() * j / 5) / (pi() * j / 5) END) * {_I0.format('(5 * sqrt(greatest(1 - pow(j / 50.0::DOUBLE, 2), 0)))', '(5 * sqrt(greatest(1 - pow(j / 50.0::DOUBLE, 2), 0)))')}) AS h),
  x AS (SELECT vec_id, list_transform(range(-40, 104), lambda i: CASE WHEN i < 0 THEN embedding[1] + i * (embedding[64]::DOUBLE - embedding[1]) / 63 WHEN i > 63 THEN embedding[64] + (i - 63) * (embedding[64]::DOUBLE - embedding[1]) / 63 ELSE embedding[i + 1]::DOUBLE END) AS w FROM embeddings)"""


@query("X3_rational_resample", _KAI + "SELECT vec_id, o::INT AS place, round(2 * list_sum(list_transform(list_filter(range(-40, 104), lambda i: o * 5 - i * 2 BETWEEN -50 AND 50), lambda i: h[o * 5 - i * 2 + 51] * w[i + 41])) / list_sum(h), 6) AS value FROM x, tp, range(26) g(o)")
def x3(t):
    y = kernels.resample_column(F.col("embedding"), 500.0)
    return t.embeddings.select("vec_id", F.posexplode(y).alias("place", "value")).withColumn("value", F.round("value", 6))


def _impulse(sections, n: int) -> list[float]:
    """First n outputs of a biquad cascade for a unit impulse, sample by sample."""
    x = [1.0] + [0.0] * (n - 1)
    for b0, b1, b2, a1, a2 in sections:
        y = []
        for i in range(n):
            at = lambda v, k: v[i - k] if i >= k else 0.0  # noqa: B023,E731
            y.append(b0 * at(x, 0) + b1 * at(x, 1) + b2 * at(x, 2) - a1 * at(y, 1) - a2 * at(y, 2))
        x = y
    return x


def _zero_phase_sql() -> str:
    """Forward and backward filtering as sums over the impulse response: what precedes the first value is that value."""
    steps, source = [], "x0"
    for k, (sections, gain) in enumerate(zip(dsp.BandFilter(0.3, 35.0, 200.0).stages, (0, 1)), 1):
        taps = "[" + ",".join(f"{v!r}::DOUBLE" for v in _impulse(sections, 94)) + "]"
        run = (f"SELECT vec_id, list_transform(range(1, 95), lambda i: {gain} * w[1] + list_sum(list_transform(range(1, i + 1), lambda j: h[i - j + 1] * (w[j] - w[1])))) AS w "
               f"FROM {{}}, (SELECT {taps} AS h)")
        steps += [f"p{k} AS (SELECT vec_id, list_concat(list_transform(range(15, 0, -1), lambda i: 2 * v[1] - v[i + 1]), v, list_transform(range(1, 16), lambda i: 2 * v[64] - v[64 - i])) AS w FROM {source})",
                  f"f{k} AS ({run.format(f'p{k}')})", f"r{k} AS (SELECT vec_id, list_reverse(w) AS w FROM f{k})", f"b{k} AS ({run.format(f'r{k}')})",
                  f"x{k} AS (SELECT vec_id, list_reverse(w)[16:79] AS v FROM b{k})"]
        source = f"x{k}"
    return ("WITH x0 AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), " + ", ".join(steps)
            + " SELECT vec_id, i::INT AS place, round(v[i + 1], 6) AS value FROM x2, range(64) g(i)")


@query("X2_zero_phase_band_filter", _zero_phase_sql())
def x2(t):
    y = kernels.band_filter_column(F.col("embedding"), 0.3, 35.0, 200.0)
    return t.embeddings.select("vec_id", F.posexplode(y).alias("place", "value")).withColumn("value", F.round("value", 6))


# --- the same kernels over signals cut into rows: four vectors make one signal, no task sees it whole ---------------
_SIG = """sig AS (SELECT vec_id // 4 AS signal, flatten(list(list_transform(embedding, lambda v: v::DOUBLE) ORDER BY vec_id)) AS v FROM embeddings GROUP BY 1)"""


def signals(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("signal"), "vec_id", "embedding")
    return chunked.as_signal(rows, ["signal"], "vec_id", F.col("embedding"))


def samples(parts: DataFrame, name: str) -> DataFrame:
    return chunked.joined_values(parts, ["signal"], name).withColumn("value", F.round("value", 6))


def _chunked_zero_phase_sql() -> str:
    steps, source = [], "sig"
    for k, (sections, gain) in enumerate(zip(dsp.BandFilter(0.3, 35.0, 200.0).stages, (0, 1)), 1):
        taps = "[" + ",".join(f"{v!r}::DOUBLE" for v in _impulse(sections, 286)) + "]"
        run = (f"SELECT signal, list_transform(range(1, len(w) + 1), lambda i: {gain} * w[1] + list_sum(list_transform(range(1, i + 1), lambda j: h[i - j + 1] * (w[j] - w[1])))) AS w "
               f"FROM {{}}, (SELECT {taps} AS h)")
        steps += [f"p{k} AS (SELECT signal, list_concat(list_transform(range(15, 0, -1), lambda i: 2 * v[1] - v[i + 1]), v, list_transform(range(1, 16), lambda i: 2 * v[len(v)] - v[len(v) - i])) AS w FROM {source})",
                  f"f{k} AS ({run.format(f'p{k}')})", f"r{k} AS (SELECT signal, list_reverse(w) AS w FROM f{k})", f"b{k} AS ({run.format(f'r{k}')})",
                  f"x{k} AS (SELECT signal, list_reverse(w)[16:len(w) - 15] AS v FROM b{k})"]
        source = f"x{k}"
    return f"WITH {_SIG}, " + ", ".join(steps) + " SELECT signal, i AS place, round(v[i + 1], 6) AS value FROM x2, range(256) g(i) WHERE i < len(v)"


@query("X2_chunked_band_filter", _chunked_zero_phase_sql())
def x2_chunked(t):
    """Filter states composed over chunks in a tree, forwards and backwards."""
    return samples(chunked.band_filter(signals(t), ["signal"], dsp.BandFilter(0.3, 35.0, 200.0), block=64, fanout=2), "first")


@query("X3_chunked_resample", f"""WITH {_SIG}, {_KAI.removeprefix("WITH ").split("  x AS")[0].strip().rstrip(",")},
  x AS (SELECT signal, len(v) AS n, list_transform(range(-40, len(v) + 40), lambda i: CASE WHEN i < 0 THEN v[1] + i * (v[len(v)] - v[1]) / (len(v) - 1) WHEN i >= len(v) THEN v[len(v)] + (i - len(v) + 1) * (v[len(v)] - v[1]) / (len(v) - 1) ELSE v[i + 1] END) AS w FROM sig)
  SELECT signal, o AS place, round(2 * list_sum(list_transform(range(greatest(-40, (o * 5 - 50) // 2), (o * 5 + 50) // 2 + 1), lambda i: CASE WHEN o * 5 - i * 2 BETWEEN -50 AND 50 THEN h[o * 5 - i * 2 + 51] * w[i + 41] ELSE 0 END)) / list_sum(h), 6) AS value FROM x, tp, range(103) g(o) WHERE o * 5 < n * 2""")
def x3_chunked(t):
    """Each chunk with the samples beside it, at the exact phase of the whole signal."""
    return samples(chunked.resample(signals(t), ["signal"], 500.0, block=64), "tick")


@query("X4_chunked_hold", f"""WITH {_SIG} SELECT signal, o AS place, round(v[o // 8 + 1], 6) AS value FROM sig, range(2048) g(o) WHERE o < 8 * len(v)""")
def x4_chunked(t):
    return samples(chunked.hold(signals(t), ["signal"], 25.0, block=64), "tick")


@query("X7_chunked_decimation", f"""WITH {_SIG}, tp AS (SELECT list_transform(range(-20, 21), lambda j: (CASE WHEN j = 0 THEN 1 ELSE sin(pi() * 0.45 * j) / (pi() * 0.45 * j) END) * (0.5 + 0.5 * cos(pi() * j / 20))) AS h)
  SELECT signal, k AS place, round(list_sum(list_transform(range(1, 42), lambda j: h[j] * v[(CASE WHEN 2 * k + j < 21 THEN 21 - j - 2 * k WHEN 2 * k + j - 21 >= len(v) THEN 2 * (len(v) - 1) - (2 * k + j - 21) ELSE 2 * k + j - 21 END) + 1])) / list_sum(h), 6) AS value
  FROM sig, tp, range(128) g(k) WHERE 2 * k < len(v)""")
def x7_chunked(t):
    return samples(chunked.decimate(signals(t), ["signal"], 2, block=64), "place")


@query("X1_finite_runs", """WITH s AS (SELECT vec_id, i - 1 AS i, abs(embedding[i]::DOUBLE) <= 0.2 AS ok FROM embeddings, range(1, 65) g(i)), g AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS grp FROM s WHERE ok)
  SELECT vec_id, min(i) AS first, max(i) AS last FROM g GROUP BY vec_id, grp""")
def x1(t):
    kept = F.transform("embedding", lambda v: F.when(F.abs(v.cast("double")) <= 0.2, v.cast("double")).otherwise(float("nan")))
    runs = t.embeddings.select("vec_id", F.inline(kernels.finite_run_column(kept)))
    return runs.select("vec_id", "first", (F.col("stop") - 1).alias("last"))


@query("X4_previous_sample_hold", """SELECT vec_id, o::INT AS place, embedding[floor(o * 25 / 200::DOUBLE + 1e-10)::INT + 1]::DOUBLE AS value FROM embeddings, range(512) g(o)""")
def x4(t):
    y = kernels.hold_column(F.col("embedding"), 25.0)
    return t.embeddings.select("vec_id", F.posexplode(y).alias("place", "value"))


@query("X5_output_placement", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, ceil(l_partkey * 200 / 500::DOUBLE)::BIGINT AS first_output, least(3000, ceil((l_partkey + l_quantity) * 200 / 500::DOUBLE))::BIGINT AS stop_output,
  ceil(l_quantity * 12.5::DOUBLE)::BIGINT AS clip_samples FROM lineitem""")
def x5(t):
    left, right, clip = kernels.placement(F.col("l_partkey"), F.col("l_partkey") + F.col("l_quantity"), F.lit(500.0), F.lit(3000), F.col("l_quantity") / 40)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", left.alias("first_output"), right.alias("stop_output"), clip.alias("clip_samples"))


@query("X8_normalise_zscore", """SELECT vec_id, i::INT AS place, round(least(2, greatest(-2, (embedding[i + 1]::DOUBLE - list_avg(d)) / list_stddev_pop(d)))::FLOAT::DOUBLE, 4) AS value FROM (SELECT vec_id, embedding, list_transform(embedding, lambda v: v::DOUBLE) AS d FROM embeddings), range(64) g(i)""")
def x8(t):
    y = raw.normalise(F.col("embedding"), "zscore", 2.0)
    return t.embeddings.select("vec_id", F.posexplode(y).alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("X8_normalise_robust", """SELECT vec_id, i::INT AS place, round(least(2, greatest(-2, (embedding[i + 1]::DOUBLE - s[32]) / ((list_aggregate(s, 'quantile_cont', 0.75) - list_aggregate(s, 'quantile_cont', 0.25)) / 1.349::DOUBLE)))::FLOAT::DOUBLE, 4) AS value FROM (SELECT vec_id, embedding, list_sort(list_transform(embedding, lambda v: v::DOUBLE)) AS s FROM embeddings), range(64) g(i)""")
def x8b(t):
    y = raw.normalise(F.col("embedding"), "robust", 2.0)
    return t.embeddings.select("vec_id", F.posexplode(y).alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("X9_patchify", """SELECT vec_id, p::INT AS patch_in_epoch, (p * 16)::INT AS sample_start, CASE WHEN label <> 0 THEN vec_id % 8 * 30000000000 + p * 80000000 + label * 5000000 ELSE -1 END AS start_ns,
  CASE WHEN label <> 0 THEN vec_id % 8 * 30000000000 + (p + 1) * 80000000 + label * 5000000 ELSE -1 END AS end_ns, round(list_sum(list_transform(embedding[p*16+1:p*16+16], lambda v: v::DOUBLE)), 6) AS total FROM embeddings, range(4) g(p)""")
def x9(t):
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").alias("samples"), (F.col("vec_id") % 8 * 30_000_000_000).alias("epoch_start_offset_ns"), (F.col("label") != 0).alias("epoch_mask"))
    out = vectors.patches(rows, 16, 64, 200.0, crop=F.col("label"))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return out.select("vec_id", "patch_in_epoch", "sample_start", "start_ns", "end_ns", F.round(total, 6).alias("total"))


@query("X10_sinusoidal_positions", """SELECT conv_id, turn, i::INT AS place, round(CASE WHEN i % 2 = 0 THEN sin(turn * 30 * exp(-ln(10000) / 6 * i)) ELSE cos(turn * 30 * exp(-ln(10000) / 6 * (i - 1))) END, 6) AS value FROM conversations, range(6) g(i)""")
def x10(t):
    y = vectors.sinusoidal(F.col("turn") * 30, 6)
    return t.conversations.select("conv_id", "turn", F.posexplode(y).alias("place", "value")).withColumn("value", F.round("value", 6))


_ACTIVE = "vec_id % 3 <> 0 AND label <> 4"


@query("A43_masked_mean_pooling", f"""SELECT label, i::INT AS place, round(coalesce(avg(embedding[i + 1]::DOUBLE) FILTER ({_ACTIVE}), 0), 6) AS value FROM embeddings, range(64) g(i) GROUP BY 1, 2""")
def a43(t):
    out = vectors.mean_pool(t.embeddings, ["label"], "embedding", F.expr(_ACTIVE), 64)
    return out.select("label", F.posexplode("pooled").alias("place", "value")).withColumn("value", F.round("value", 6))


_QV = [math.cos(i) for i in range(64)]


@query("A44_masked_attention_pooling", f"""WITH s AS (SELECT label, embedding, {_ACTIVE} AS active, exp(2 * list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * cos(i - 1))) / sqrt(list_sum(list_transform(range(64), lambda i: pow(cos(i), 2)))) / greatest(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 1e-6)) AS w FROM embeddings)
  SELECT label, i::INT AS place, round(coalesce(sum(w * embedding[i + 1]::DOUBLE) FILTER (active) / sum(w) FILTER (active), 0), 6) AS value FROM s, range(64) g(i) GROUP BY 1, 2""")
def a44(t):
    out = vectors.attention_pool(t.embeddings, ["label"], "embedding", F.expr(_ACTIVE), _QV)
    return out.select("label", F.posexplode("pooled").alias("place", "value")).withColumn("value", F.round("value", 6))


@query("A45_bounding_interval", "SELECT conv_id, coalesce(min(turn * 30) FILTER (role = 'assistant'), -1) AS start_ns, coalesce(max((turn + 1) * 30) FILTER (role = 'assistant'), -1) AS end_ns FROM conversations GROUP BY 1")
def a45(t):
    rows = t.conversations.select("conv_id", "role", (F.col("turn") * 30).alias("start_ns"), ((F.col("turn") + 1) * 30).alias("end_ns"))
    return vectors.bounding_interval(rows, ["conv_id"], F.col("role") == "assistant")


@query("F7_json_safe", """SELECT vec_id, label, len(list_filter(embedding, lambda v: abs(v::DOUBLE) > 0.3))::INT AS nulls FROM embeddings""")
def f7(t):
    x = F.transform("embedding", lambda v: F.when(F.abs(v.cast("double")) > 0.3, F.lit(float("inf"))).otherwise(v.cast("double")))
    js = F.to_json(F.struct(c.json_safe(x).alias("x")))
    back = F.from_json(js, "x array<double>")["x"]
    return t.embeddings.select("vec_id", "label", F.size(F.filter(back, lambda v: v.isNull())).alias("nulls"))


@query("U2_sample_transform_hook", """WITH r AS (SELECT conv_id AS recording_id, max(turn) + 1 AS n FROM conversations GROUP BY 1)
  SELECT r.recording_id, w AS window_no, e AS epoch_in_record, length(text) * 2::BIGINT AS doubled FROM r, range(CAST(ceil(n / 2) AS BIGINT)) g(w), range(w * 2, w * 2 + least(3, n - w * 2)) h(e)
  JOIN conversations c ON c.conv_id = r.recording_id AND c.turn = h.e""")
def u2(t):
    """A caller's own column, computed inside the window reader."""
    per = t.conversations.groupBy(F.col("conv_id").alias("recording_id")).agg((F.max("turn") + 1).alias("n_epochs"))
    turns = t.conversations.select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("epoch_in_record"), F.length("text").alias("samples"))
    records = per.withColumn("subject_id", F.col("recording_id")).withColumn("night_grade", F.lit(5))
    source = registry.Release("turns", m.RELEASE_VERSION, 30.0, m.channel_dimension(t.spark), records, turns, lambda task: None)
    double = lambda df: df.withColumn("doubled", (F.col("samples") * 2).cast("bigint"))
    return published.read_windows(source, 3, 2, transform=double).select("recording_id", "window_no", "epoch_in_record", "doubled")


# --- range audit: every vector is a night of 64 codes, the label is its profile -----------------
def nights(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("session_key"), F.lit(-32768.0).alias("dig_min"), F.lit(32767.0).alias("dig_max"),
                               (-100.0 * (F.col("label") + 1)).alias("phys_min"), (100.0 * (F.col("label") + 1)).alias("phys_max"), F.lit("uV").alias("unit"))


def night_codes(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("session_key"), F.posexplode("embedding").alias("sample_idx", "_v")).select(
        "session_key", "sample_idx", F.rint(F.col("_v").cast("double") * 100).cast("int").alias("code"))


def night_chunks(t: Tables) -> DataFrame:
    """The same codes as arrays, one chunk a night."""
    codes = F.transform("embedding", lambda v: F.rint(v.cast("double") * 100).cast("int"))
    return t.embeddings.select(F.col("vec_id").alias("session_key"), F.lit(0).alias("chunk_no"), F.lit(0).alias("first_sample"), codes.alias("codes"))


_NIGHT = """WITH ng AS (SELECT vec_id AS session_key, label, -32768::DOUBLE AS dig_min, 32767::DOUBLE AS dig_max, -100::DOUBLE * (label + 1) AS phys_min, 100::DOUBLE * (label + 1) AS phys_max, 'uV' AS unit FROM embeddings),
  cd AS (SELECT vec_id AS session_key, (i - 1)::INT AS sample_idx, round_even(embedding[i]::DOUBLE * 100, 0)::INT AS code FROM embeddings, range(1, 65) g(i)),
  smp AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('f3-m2-calibrated-range-v1:' || session_key), session_key)::INT AS sample_rank, count(*) OVER (PARTITION BY label) AS profile_total_nights FROM ng QUALIFY sample_rank <= 20),
  st AS (SELECT session_key, list_sort(list(code)) AS s, count(*) AS sample_count, count(DISTINCT code) AS unique_digital_codes, count(*) FILTER (code IN (-20, -19, 19, 20)) / 64::DOUBLE AS rail_fraction FROM cd GROUP BY 1)"""
_PICK = {k: f"s[floor({v!r}::DOUBLE * 63)::INT + 1]" for k, v in ranges.POINTS.items()}
_CAL = lambda e: f"(phys_min + ({e} - dig_min) * (phys_max - phys_min) / (dig_max - dig_min))"


@query("W7_hash_top_k_sample", _NIGHT + "SELECT session_key, phys_min, phys_max, sample_rank, profile_total_nights FROM smp")
def w7(t):
    return ranges.profile_sample(nights(t), 20).select("session_key", "phys_min", "phys_max", "sample_rank", "profile_total_nights")


@query("A37_code_histogram", _NIGHT + "SELECT session_key, code, count(*) AS n FROM cd GROUP BY 1, 2")
def a37(t):
    return ranges.chunk_histogram(night_chunks(t))


def statistics(t: Tables, chosen: DataFrame | None = None) -> DataFrame:
    """Order statistics of the chosen nights only: the others' codes never reach the counting."""
    chunks = night_chunks(t)
    if chosen is not None:
        chunks = chunks.join(chosen.select("session_key"), "session_key", "left_semi")
    return ranges.histogram_statistics(ranges.chunk_histogram(chunks), rails=(-20, -19, 19, 20))


@query("A38_histogram_quantiles", _NIGHT + "SELECT session_key, " + ", ".join(f"{v} AS {k}" for k, v in _PICK.items()) + " FROM st")
def a38(t):
    return statistics(t).select("session_key", *ranges.POINTS)


def detail(t: Tables) -> DataFrame:
    sample = ranges.profile_sample(nights(t), 20)
    return ranges.representative_rank(ranges.calibrated_detail(sample, statistics(t, sample)))


_DET = _NIGHT + ", det AS (SELECT smp.*, sample_count, unique_digital_codes, rail_fraction, (phys_max - phys_min) / (dig_max - dig_min) AS lsb, " + ", ".join(
    f"{_CAL(v)} AS {k}" for k, v in _PICK.items()) + f", {_CAL(_PICK['p999'])} - {_CAL(_PICK['p001'])} AS span FROM smp JOIN st USING (session_key))"


@query("A39_rail_lsb_span", _DET + "SELECT session_key, rail_fraction, unique_digital_codes, round(lsb, 9) AS lsb_physical, round(span, 6) AS span_p001_p999, round(observed_max, 6) AS observed_max FROM det")
def a39(t):
    return detail(t).select("session_key", "rail_fraction", "unique_digital_codes", F.round("lsb_physical", 9).alias("lsb_physical"),
                            F.round("span_p001_p999", 6).alias("span_p001_p999"), F.round("observed_max", 6).alias("observed_max"))


@query("W9_representative_rank", _DET + """, m AS (SELECT label, median(span) AS md FROM det GROUP BY 1) SELECT session_key, row_number() OVER (PARTITION BY label ORDER BY abs(span - md), session_key)::INT AS representative_rank FROM det JOIN m USING (label)""")
def w9(t):
    return detail(t).select("session_key", "representative_rank")


@query("A40_profile_summary", _DET + """SELECT phys_min, phys_max, max(profile_total_nights) AS profile_total_nights, count(*) AS sample_nights, round(median(span), 6) AS span, round(quantile_cont(span, 0.95), 6) AS span_p95, median(rail_fraction) AS median_rail_fraction,
  max(rail_fraction) AS max_rail_fraction, median(unique_digital_codes) AS median_unique_digital_codes FROM det GROUP BY 1, 2""")
def a40(t):
    s = ranges.profile_summary(detail(t))
    return s.select("phys_min", "phys_max", "profile_total_nights", "sample_nights", F.round("night_median_span_p001_p999", 6).alias("span"),
                    F.round("night_p95_span_p001_p999", 6).alias("span_p95"), "median_rail_fraction", "max_rail_fraction", "median_unique_digital_codes")


@query("J16_sample_session_paths", _NIGHT + "SELECT session_key, sample_rank, item_id, 'files/' || session_key AS path FROM smp LEFT JOIN benchmark ON item_id = session_key")
def j16(t):
    paths = t.embeddings.select(F.col("vec_id").alias("session_key"), F.concat(F.lit("files/"), F.col("vec_id")).alias("path"))
    s = ranges.profile_sample(nights(t), 20).select("session_key", "sample_rank").join(paths, "session_key")
    return s.join(t.benchmark.select(F.col("item_id"), F.col("item_id").alias("session_key")), "session_key", "left").select("session_key", "sample_rank", "item_id", "path")


@query("J14_comparison_windows", """WITH r AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS n FROM orders) SELECT o_orderkey, k::INT AS place, greatest(0, least(n - 61, floor(n * [0.1::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE][k + 1])))::BIGINT AS start FROM r, range(5) g(k)""")
def j14(t):
    rows = t.orders.select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("n"))
    return rows.select("o_orderkey", F.posexplode(ranges.comparison_windows(F.col("n"))).alias("place", "start"))


@query("J14_windowed_comparison", _NIGHT + """, w AS (SELECT greatest(0, least(64 - 7, floor(64 * f))) AS a FROM (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(f)),
  d AS (SELECT session_key, CASE WHEN sample_idx % 7 = session_key % 7 THEN session_key % 5 + 1 ELSE 0 END AS d FROM cd JOIN w ON sample_idx >= a AND sample_idx < a + 6)
  SELECT session_key, count(*) AS comparison_sample_count, avg((d = 0)::INT) AS digital_equal_fraction, max(d) AS max_abs_digital_code_difference, round(max(d) * any_value(phys_max - phys_min) / 65535, 9) AS max_abs_physical_difference FROM d JOIN ng USING (session_key) GROUP BY 1""")
def j14c(t):
    """Two sources in five windows of six records, one sample a record, compared chunk by chunk."""
    left = night_chunks(t)
    other = F.transform("codes", lambda v, i: v + F.when(i % 7 == F.col("session_key") % 7, (F.col("session_key") % 5 + 1).cast("int")).otherwise(0))
    starts = ranges.comparison_windows(F.lit(64), 6)
    spans = nights(t).select("session_key", ((F.col("phys_max") - F.col("phys_min")) / (F.col("dig_max") - F.col("dig_min"))).alias("lsb_physical"),
                             F.transform(starts, lambda a: F.struct(a.alias("first"), (a + 6).alias("stop"))).alias("spans"))
    out = ranges.compare_chunks(left, left.withColumn("codes", other), spans)
    return out.withColumn("max_abs_physical_difference", F.round("max_abs_physical_difference", 9))


@query("J14_sample_comparison", _NIGHT + """SELECT session_key, count(*) AS comparison_sample_count, avg((sample_idx % 7 <> session_key % 7)::INT) AS digital_equal_fraction, max(CASE WHEN sample_idx % 7 = session_key % 7 THEN abs(session_key % 5 + 1) ELSE 0 END) AS max_abs_digital_code_difference FROM cd GROUP BY 1""")
def j14b(t):
    a = night_codes(t)
    moved = F.when(F.col("sample_idx") % 7 == F.col("session_key") % 7, F.col("session_key") % 5 + 1).otherwise(0)
    return ranges.compare_samples(a, a.withColumn("code", F.col("code") + moved), ["session_key"])


# --- EDF bytes that Spark builds from the tables ------------------------------------------------
def _field(values: str, width: int) -> str:
    return f"array_join(transform(sequence(1, ns), i -> rpad({values}, {width}, ' ')), '')"


_EDF = ("concat(rpad('0', 8, ' '), rpad('X', 80, ' '), rpad('R', 80, ' '), '01.02.03', '22.00.00', rpad(CAST(256 * (ns + 1) AS STRING), 8, ' '), rpad('EDF+C', 44, ' '), rpad(CAST(records AS STRING), 8, ' '), "
        "rpad('2', 8, ' '), rpad(CASE WHEN p_size % 9 = 0 THEN '0' ELSE CAST(ns AS STRING) END, 4, ' '), " + ", ".join([
            _field("concat('CH', i)", 16), _field("'AgCl'", 80), _field("'uV'", 8), _field("CAST(-i * 100 AS STRING)", 8), _field("CASE WHEN i = 2 THEN 'bad' ELSE CAST(i * 100 AS STRING) END", 8), _field("'-32768'", 8),
            _field("'32767'", 8), _field("concat('HP:', i, 'Hz')", 80), _field("CAST(100 * i AS STRING)", 8), _field("''", 32)]) + ")")


@query("S2_edf_header_scan", """WITH p AS (SELECT p_partkey, p_size, p_size % 3 + 1 AS ns, p_size * 10 AS records FROM part)
  SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'bad_layout: 0 signals in ' || 256 * (ns + 1) || ' header bytes' WHEN p_size % 9 = 1 THEN 'short_header: 300 of ' || 256 * (ns + 1) || ' bytes' END AS error, CASE WHEN ok THEN i - 1 END::INT AS channel_no, CASE WHEN ok THEN 'CH' || i END AS raw_channel,
   CASE WHEN ok THEN 50.0::DOUBLE * i END AS fs_hz, CASE WHEN ok THEN 100 * i * records END AS sample_count, CASE WHEN ok THEN records * 2::DOUBLE END AS duration_seconds, CASE WHEN ok THEN -100::DOUBLE * i END AS phys_min, CASE WHEN ok AND i <> 2 THEN 100::DOUBLE * i END AS phys_max
  FROM (SELECT *, p_size % 9 > 1 AS ok FROM p), range(1, CASE WHEN ok THEN ns + 1 ELSE 2 END) g(i)""")
def s2(t):
    rows = t.part.selectExpr("p_partkey", "p_size", "p_size % 3 + 1 AS ns", "p_size * 10 AS records")
    text = F.expr(f"encode({_EDF}, 'ISO-8859-1')")
    cut = F.when(F.col("p_size") % 9 == 1, F.substring(text, 1, 300)).otherwise(text)
    out = edf.parse_headers(rows.select(F.col("p_partkey").cast("string").alias("path"), cut.alias("content")))
    return out.select(F.col("path").cast("bigint").alias("p_partkey"), "error", "channel_no", "raw_channel", "fs_hz", "sample_count", "duration_seconds", "phys_min", "phys_max")


_LE = "transform(embedding, v -> pmod(CAST(rint(CAST(v AS DOUBLE) * 1000) AS INT), 65536))"
_HEX = f"array_join(transform({_LE}, v -> concat(lpad(hex(v % 256), 2, '0'), lpad(hex(CAST(floor(v / 256) AS INT)), 2, '0'))), '')"


def edf_bytes(t: Tables) -> DataFrame:
    """One signal of eight records with eight samples each."""
    head = ("concat(rpad('0', 8, ' '), rpad('X', 80, ' '), rpad('R', 80, ' '), '01.02.03', '22.00.00', rpad('512', 8, ' '), rpad('', 44, ' '), rpad('8', 8, ' '), rpad('1', 8, ' '), rpad('1', 4, ' '), "
            "rpad('F3-M2', 16, ' '), rpad('', 80, ' '), rpad('uV', 8, ' '), rpad('-100', 8, ' '), rpad('100', 8, ' '), rpad('-32768', 8, ' '), rpad('32767', 8, ' '), rpad('', 80, ' '), rpad('8', 8, ' '), rpad('', 32, ' '))")
    return t.embeddings.selectExpr("CAST(vec_id AS STRING) AS path", f"concat(encode({head}, 'ISO-8859-1'), unhex({_HEX})) AS content")


@query("S3_edf_sample_window", "SELECT vec_id, (i - 1)::BIGINT AS sample_idx, round_even(embedding[i]::DOUBLE * 1000, 0)::INT AS code FROM embeddings, range(17, 49) g(i)")
def s3(t):
    out = edf.parse_samples(edf_bytes(t), "f3-m2", 2, 6)
    return out.select(F.col("path").cast("bigint").alias("vec_id"), "sample_idx", "code")


@query("S2_edf_header_files", "SELECT vec_id, 'F3-M2' AS raw_channel, 8.0::DOUBLE AS fs_hz, 64::BIGINT AS sample_count, 8.0::DOUBLE AS duration_seconds, 'uV' AS unit FROM embeddings")
def s2b(t):
    """Headers through the data source, from files that hold each vector as one signal."""
    folder = scratch_path(t.spark, "edf")
    files.write_binary(edf_bytes(t).withColumn("path", F.concat("path", F.lit(".edf"))), folder)
    edf.register(t.spark)
    rows = t.spark.read.format("edf_header").load(folder)
    return rows.select(F.regexp_extract("path", r"(\d+)\.edf$", 1).cast("bigint").alias("vec_id"), "raw_channel", "fs_hz", "sample_count", "duration_seconds", "unit")


@query("S3_edf_sample_files", "SELECT vec_id, (i - 1)::BIGINT AS sample_idx, round_even(embedding[i]::DOUBLE * 1000, 0)::INT AS code, NULL::VARCHAR AS error FROM embeddings, range(9, 65) g(i)")
def s3b(t):
    """Samples from record 1 on through the data source, in parts of a few records."""
    folder = scratch_path(t.spark, "edf")
    files.write_binary(edf_bytes(t).withColumn("path", F.concat("path", F.lit(".edf"))), folder)
    edf.register(t.spark)
    rows = (t.spark.read.format("edf_samples").option("channel", "f3-m2").option("firstRecord", 1)
            .option("bytesPerPartition", 1 << 20).load(folder))
    return rows.select(F.regexp_extract("path", r"(\d+)\.edf$", 1).cast("bigint").alias("vec_id"), "sample_idx", "code", "error")


def edf_cohort(t: Tables) -> str:
    """Folder of EDF files that hold up to 100 vectors each, in order of vec_id: one record a vector, two signals of 32 samples."""
    folder = scratch_path(t.spark, "edf")
    rows = t.embeddings.selectExpr("vec_id", "CAST(floor(vec_id / 100) AS BIGINT) AS file_no", f"unhex({_HEX}) AS body")
    per = rows.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("vec_id", "body"))).alias("all"))
    two = lambda a, b, width: f"rpad('{a}', {width}, ' '), rpad('{b}', {width}, ' ')"
    head = ("concat(rpad('0', 8, ' '), rpad('X', 80, ' '), rpad('R', 80, ' '), '01.02.03', '22.00.00', rpad('768', 8, ' '), rpad('', 44, ' '), rpad(CAST(size(all) AS STRING), 8, ' '), rpad('2', 8, ' '), rpad('2', 4, ' '), "
            + ", ".join([two("F3-M2", "SpO2", 16), two("", "", 80), two("uV", "%", 8), two("-100", "0", 8), two("100", "120", 8), two("-32768", "-32768", 8), two("32767", "32767", 8), two("", "", 80), two("32", "32", 8), two("", "", 32)]) + ")")
    content = f"concat(encode({head}, 'ISO-8859-1'), aggregate(all, CAST('' AS BINARY), (a, r) -> concat(a, r.body)))"
    files.write_binary(per.selectExpr("concat(file_no, '.edf') AS path", f"{content} AS content"), folder)
    return folder


def file_no():
    return F.regexp_extract("path", r"(\d+)[.]edf$", 1).cast("bigint").alias("file_no")


_COHORT = "WITH c AS (SELECT vec_id // 100 AS file_no, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) - 1 AS record, embedding FROM embeddings) "


@query("S2_edf_listed_headers", _COHORT + """SELECT file_no, label AS raw_channel, unit, 16.0::DOUBLE AS fs_hz, 32 * count(*)::BIGINT AS sample_count, 2.0::DOUBLE * count(*) AS duration_seconds
  FROM c, (VALUES ('F3-M2', 'uV'), ('SpO2', '%')) v(label, unit) GROUP BY file_no, label, unit""")
def s2c(t):
    """Headers of files that Spark lists."""
    listed = digests.stored_files(t.spark, edf_cohort(t), "*.edf")
    return edf.scan_headers(listed).select(file_no(), "raw_channel", "unit", "fs_hz", "sample_count", "duration_seconds")


@query("S3_edf_listed_samples", _COHORT + "SELECT file_no, record * 32 + i AS sample_idx, round_even(embedding[i + 1]::DOUBLE * 1000, 0)::INT AS code FROM c, range(32) g(i) WHERE record BETWEEN 3 AND 90")
def s3c(t):
    """Records 3 to 90 of the first signal of files that Spark lists, in stretches of 4 KiB."""
    listed = digests.stored_files(t.spark, edf_cohort(t), "*.edf")
    return edf.scan_samples(listed, "f3-m2", 3, 91, step=4096).select(file_no(), "sample_idx", "code")


@query("S3_edf_sample_range", _COHORT + "SELECT file_no, record * 32 + i AS sample_idx, round_even(embedding[i + 33]::DOUBLE * 1000, 0)::INT AS code FROM c, range(32) g(i) WHERE record * 32 + i BETWEEN 1000 AND 1999")
def s3d(t):
    """Samples 1000 to 1999 of the second signal; only the records that hold them are read."""
    edf.register(t.spark)
    source = t.spark.read.format("edf_samples").option("channel", "SPO2").option("fromSample", 1000).option("toSample", 1999)
    return source.load(edf_cohort(t)).select(file_no(), "sample_idx", "code")


@query("S12_file_discovery", """SELECT 'sub-' || s_nationkey || '/ses-' || s_suppkey % 2 AS session_key, count(*) AS suppliers FROM supplier GROUP BY 1""")
def s12(t):
    """Files named by the table's keys, found again by their folder pattern."""
    root = scratch_path(t.spark, "tree")
    rows = t.supplier.withColumn("sub", F.concat(F.lit("sub-"), F.col("s_nationkey"))).withColumn("ses", F.col("s_suppkey") % 2)
    rows.repartition("sub", "ses").write.partitionBy("sub", "ses").json(root)
    found = files.list_files(t.spark, root, "*.json", r"/sub=(sub-[^/]+)/ses=([^/]+)/[^/]+$")
    data = t.spark.read.json(root).withColumn("session_key", F.concat_ws("/", "sub", F.concat(F.lit("ses-"), F.col("ses"))))
    keys = found.select(F.concat_ws("/", "subject_id", F.concat(F.lit("ses-"), F.col("session_id"))).alias("session_key")).distinct()
    return data.join(keys, "session_key", "left_semi").groupBy("session_key").agg(F.count("*").alias("suppliers"))


# --- evaluation ---------------------------------------------------------------------------------
_PRED = "CASE WHEN l_partkey % 4 = 0 THEN l_suppkey % 5 ELSE l_linenumber % 5 END"


def predictions(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr("CASE WHEN l_linenumber % 5 = 3 THEN 0 ELSE l_linenumber % 5 END AS label", f"CAST({_PRED} AS INT) AS predicted")


_D2 = f"""WITH c AS (SELECT CASE WHEN l_linenumber % 5 = 3 THEN 0 ELSE l_linenumber % 5 END AS label, {_PRED} AS predicted FROM lineitem),
  k AS (SELECT x.class, count(*) FILTER (label = x.class) AS support, count(*) FILTER (label = x.class AND predicted = x.class) AS hits, count(*) FILTER (predicted = x.class) AS predicted_count FROM c, range(5) x(class) GROUP BY 1),
  m AS (SELECT *, coalesce(hits / nullif(predicted_count, 0)::DOUBLE, 0) AS precision, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * hits / nullif(support + predicted_count, 0)::DOUBLE, 0) AS f1 FROM k)"""


@query("D2_class_metrics", _D2 + "SELECT class::INT AS class, support, hits, predicted_count, precision, recall, f1 FROM m")
def d2(t):
    return vectors.class_metrics(predictions(t), range(5))


@query("D2_class_summary", _D2 + "SELECT round(sum(hits) / sum(support)::DOUBLE, 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(avg(recall) FILTER (support > 0), 9) AS balanced_accuracy, sum(support)::BIGINT AS total FROM m")
def d2b(t):
    s = vectors.class_summary(vectors.class_metrics(predictions(t), range(5)))
    return s.select(*[F.round(x, 9).alias(x) for x in ("accuracy", "macro_f1", "balanced_accuracy")], "total")


_D3 = """WITH r AS (SELECT l_linenumber AS field, CASE WHEN l_linenumber = 7 THEN 5::DOUBLE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity END AS target, l_quantity + l_tax * 10 AS predicted, l_returnflag <> 'N' AS ok FROM lineitem),
  u AS (SELECT *, ok AND target IS NOT NULL AS live, predicted - target AS e FROM r)"""


def regression(t: Tables) -> DataFrame:
    y = F.when(F.col("l_linenumber") == 7, 5.0).when(F.col("l_partkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return t.lineitem.select(F.col("l_linenumber").alias("field"), y.alias("target"), (F.col("l_quantity") + F.col("l_tax") * 10).alias("predicted"), (F.col("l_returnflag") != "N").alias("ok"))


@query("D3_regression_metrics", _D3 + """SELECT field, count(*) FILTER (live) AS n, round(avg(abs(e)) FILTER (live), 6) AS mae, round(sqrt(avg(e * e) FILTER (live)), 6) AS rmse,
  round(CASE WHEN count(*) FILTER (live) >= 2 AND min(target) FILTER (live) < max(target) FILTER (live) THEN 1 - sum(e * e) FILTER (live) / (var_pop(target) FILTER (live) * count(*) FILTER (live)) END, 6) AS r2 FROM u GROUP BY 1""")
def d3(t):
    out = vectors.regression_metrics(regression(t), valid=F.col("ok"))
    return out.select("field", "n", *[F.round(x, 6).alias(x) for x in ("mae", "rmse", "r2")])


@query("D3_pooled_errors", _D3 + "SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM u WHERE live")
def d3b(t):
    out = vectors.pooled_errors(regression(t), valid=F.col("ok"))
    return out.select("n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


@query("D5_level_feature", "SELECT vec_id, p::INT AS patch_in_epoch, round(list_avg(list_transform(embedding[p*16+1:p*16+16], lambda v: (v::DOUBLE - 95) / 5)), 5) AS level FROM embeddings, range(4) g(p)")
def d5(t):
    rows = t.embeddings.select("vec_id", F.col("embedding").alias("samples"), F.lit(0).cast("bigint").alias("epoch_start_offset_ns"), F.lit(True).alias("epoch_mask"))
    out = vectors.patches(rows, 16, 64, 16.0)
    return out.select("vec_id", "patch_in_epoch", F.round(vectors.level_feature(F.col("values")), 5).alias("level"))


# --- the whole channel kernel on native chunks ---------------------------------------------------
def native(t: Tables):
    """Each vector repeated to 30 seconds of its channel's native rate: one chunk per epoch."""
    h = sq.headers(t).withColumn("recording_id", F.col("recording_id").cast("string"))
    h = h.withColumn("source_samples", F.lit(240).cast("bigint") * F.when(F.col("fs") > 0, F.col("fs")).otherwise(200).cast("bigint"))
    rate = h.select("recording_id", "channel", "fs")
    e = sq.epochs(t).withColumn("recording_id", F.col("recording_id").cast("string")).join(rate, ["recording_id", "channel"])
    size = (F.greatest(F.col("fs"), F.lit(1.0)) * 30).cast("int")
    tiled = F.slice(F.flatten(F.array_repeat("codes", F.ceil(size / 64).cast("int"))), F.lit(1), size)
    chunks = e.select("recording_id", "channel", F.col("epoch_in_record").alias("chunk_no"), tiled.alias("codes"))
    n = e.groupBy("recording_id").agg((F.max("epoch_in_record") + 1).cast("bigint").alias("epoch_count"))
    records = n.withColumn("duration_sec", F.col("epoch_count") * 30.0)
    return h, chunks, records


@query("U4_channel_night_kernel")
def u4(t):
    """Calibrate, filter, resample, cut, measure and flag whole channel nights."""
    h, chunks, records = native(t)
    done = preprocess.preprocess(h, chunks, records)
    return done.qc.groupBy("recording_id", "channel").agg(
        F.count("*").alias("epochs"), F.count_if("coverage_valid").alias("covered"), F.count_if("processing_valid").alias("processed"),
        F.bit_or("hard_flags").alias("flags"), F.count_if("valid").alias("valid"))
