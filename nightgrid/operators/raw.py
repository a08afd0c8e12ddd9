"""Raw recordings: manifest rows, channel selection, rates, windows and normalization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions.columns import raw_split
from nightgrid.operators.grid import explode_range
from nightgrid.operators.kernels import Rows

SIGNAL_TYPE = ("struct<source_name:string,length:bigint,dtype:string,fs:double,unit:string,type:string,"
               "dig_min:double,dig_max:double,phys_min:double,phys_max:double>")
MANIFEST_SCHEMA = ("manifest_version int, path string, relative_path string, status string, error string, "
                   "subject_id string, session_id string, split string, duration_sec double, "
                   f"signals map<string,{SIGNAL_TYPE}>, annotations array<string>, file_size bigint")


def long_channels(channels: DataFrame) -> DataFrame:
    """One row per (path, channel), channel in lower case, with its header fields.

    Names that differ only in case: the later source name wins, as in a dictionary.
    """
    entry = F.struct(
        F.col("source_name"), F.col("length"), F.col("dtype"), F.coalesce("fs", F.lit(0.0)).alias("fs"),
        F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("type", F.lit("")).alias("type"),
        "dig_min", "dig_max", "phys_min", "phys_max")
    shortest = F.min(F.when(F.col("fs") > 0, F.col("length") / F.col("fs")))
    named = channels.where(F.col("ndim") == 1).groupBy("path", F.lower("source_name").alias("channel")).agg(
        F.max_by(entry, "source_name").alias("info"), shortest.alias("shortest"))
    return named.select("path", "channel", "info.*", "shortest")


def inspect_files(files: DataFrame, channels: DataFrame, seed: int = 42,
                  ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """One row per file with status, split, duration and channel count, from ``long_channels`` rows.

    A missing or non-positive declared duration falls back to the shortest channel; a record
    with neither is an error row.
    """
    per = channels.groupBy("path").agg(F.count("*").alias("channels"), F.min("shortest").alias("_short"))
    declared = F.coalesce(F.col("duration_sec"), F.lit(0.0))
    rows = files.join(per, "path", "left").withColumn(
        "_duration", F.when(declared > 0, declared).otherwise(F.coalesce("_short", F.lit(0.0))))
    error = (F.when(F.col("channels").isNull(), "missing signals")
             .when(F.col("_duration") <= 0, "recording duration is missing or non-positive"))
    ok = error.isNull()
    return rows.select(
        F.lit(m.MANIFEST_VERSION).alias("manifest_version"), "path", "relative_path",
        F.when(ok, "ok").otherwise("error").alias("status"), error.alias("error"),
        F.when(ok, F.col("subject_id")).alias("subject_id"), F.when(ok, F.col("session_id")).alias("session_id"),
        F.when(ok, raw_split(F.col("subject_id"), seed, ratios)).alias("split"),
        F.when(ok, F.col("_duration")).alias("duration_sec"), F.when(ok, F.col("channels")).alias("channels"),
        F.when(ok, F.array_sort(F.coalesce("annotations", F.array().cast("array<string>")))).alias("annotations"),
        "file_size")


def manifest_records(files: DataFrame, channels: DataFrame, seed: int = 42,
                     ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """``inspect_files`` with each file's channels as a map, the form the JSON manifest stores.

    A file has as many map entries as it has channels, a few dozen.
    """
    named = long_channels(channels)
    fields = ["source_name", "length", "dtype", "fs", "unit", "type", "dig_min", "dig_max", "phys_min", "phys_max"]
    maps = named.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct(*fields)))).alias("signals"))
    rows = inspect_files(files, named, seed, ratios).join(maps, "path", "left")
    names = [c.split()[0] for c in MANIFEST_SCHEMA.split(", ") if c.split()[0] != "signals"]
    return rows.select(*names[:9], F.when(F.col("status") == "ok", F.col("signals")).alias("signals"), *names[9:])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines manifest; any row of another version is an error."""
    df = spark.read.schema(MANIFEST_SCHEMA).json(path)
    wrong = df.where(~F.col("manifest_version").eqNullSafe(F.lit(m.MANIFEST_VERSION))).limit(1).count()
    if wrong:
        raise ValueError(f"unsupported manifest version, expected {m.MANIFEST_VERSION}")
    return df


def write_manifest(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def manifest_channels(records: DataFrame) -> DataFrame:
    ok = records.where(F.col("status") == "ok")
    return ok.select("path", F.explode("signals").alias("channel", "info")).select("path", "channel", "info.*")


def manifest_summary(records: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """Files per status, records per channel, and per channel and rate, in one long table.

    ``channels``: the long rows of the records, where the records carry no maps.
    """
    status = records.groupBy(F.lit("status").alias("kind"), F.col("status").alias("key"), F.lit("").alias("rate")).agg(F.count("*").alias("n"))
    if channels is None:
        ch = manifest_channels(records)
    else:
        ch = channels.join(records.where("status = 'ok'").select("path"), "path", "left_semi")
    per = ch.groupBy(F.lit("channel").alias("kind"), F.col("channel").alias("key"), F.lit("").alias("rate")).agg(F.count("*").alias("n"))
    rate = F.regexp_replace(F.format_string("%.6f", F.col("fs")), r"\.?0+$", "")
    both = ch.groupBy(F.lit("rate").alias("kind"), F.col("channel").alias("key"), rate.alias("rate")).agg(F.count("*").alias("n"))
    return status.unionByName(per).unionByName(both)


def profile_slots(spark: SparkSession, profile: str = "full",
                  groups: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Candidate table (modality, slot, slot_name, priority, channel) of a profile or custom lists."""
    built_in = groups is None
    asked = m.CHANNEL_PROFILES.get(profile, {}) if built_in else groups
    slots = [(modality, slot, [c.lower() for c in ([entry] if isinstance(entry, str) else entry)])
             for modality, entries in asked.items() for slot, entry in enumerate(entries)]
    # One look at the finished table: every modality is in it and every slot can be filled.
    if not slots or {s[0] for s in slots} != set(asked) or not all(s[2] for s in slots):
        raise ValueError(f"no complete slot table from {profile if built_in else dict(asked)!r}: each modality needs slots, each slot a channel "
                         f"(built in: {', '.join(sorted(m.CHANNEL_PROFILES))})")
    label = m.PROFILE_SLOT_NAMES if built_in else {}
    rows = [(modality, slot, label.get((profile, modality, slot), options[0]), rank, channel)
            for modality, slot, options in slots for rank, channel in enumerate(options)]
    return m.inline_table(spark, rows, ("modality", "slot", "slot_name", "priority", "channel"))


def select_channels(records: DataFrame, channels: DataFrame, slots: DataFrame, key: str = "path") -> DataFrame:
    """Every record x slot with the first present candidate; an invalid one counts as missing.

    channels: key, channel, fs, length. The slot table is a few dozen rows at most.
    """
    match = (channels.join(F.broadcast(slots), "channel")
             .groupBy(key, "modality", "slot").agg(F.min_by(F.struct("channel", "fs", "length"), "priority").alias("_c")))
    want = records.select(key).crossJoin(F.broadcast(slots.select("modality", "slot", "slot_name").distinct()))
    out = want.join(match, [key, "modality", "slot"], "left")
    valid = (F.col("_c.fs") > 0) & (F.col("_c.length") > 0)
    usable = F.coalesce(valid, F.lit(False))
    label = F.concat_ws("/", "modality", "slot_name")
    return out.select(
        key, "modality", "slot", "slot_name", F.when(usable, F.col("_c.channel")).alias("source_channel"),
        F.when(usable, F.col("_c.fs")).alias("source_fs"), F.when(usable, F.col("_c.length")).alias("source_length"),
        usable.alias("available"),
        F.when(F.col("_c").isNull(), label).when(~usable, F.concat(label, F.lit("(invalid)"))).alias("missing"))


def apply_missing_policy(selection: DataFrame, policy: str, key: str = "path") -> DataFrame:
    """mask keeps every slot; drop removes records with a gap; error raises naming up to five."""
    if policy not in ("mask", "drop", "error"):
        raise ValueError(f"{policy!r} is none of mask, drop and error")
    if policy == "mask":
        return selection
    bad = selection.where(F.col("missing").isNotNull())
    if policy == "error":
        shown = bad.select(key, "missing").orderBy(key, "missing").limit(5).collect()
        if shown:
            raise ValueError("records without a usable source for a slot, among them " + "; ".join(f"{r[0]}: {r[1]}" for r in shown))
        return selection
    return selection.join(bad.select(key).distinct(), key, "left_anti")


def modality_rates(selection: DataFrame, requested: Mapping[str, float] | None = None,
                   defaults: Mapping[str, float] | None = None, key: str = "path") -> DataFrame:
    """Output rate per (record, modality) and what makes it unusable, if anything.

    Requested rate, else the first available channel's, else the default. Without a request
    mixed rates are an error; only integer down-sampling is allowed.
    """
    if requested and any(r <= 0 for r in requested.values()):
        raise ValueError("an output rate has to be above zero")
    ask = m.channel_map(dict(requested), F.col("modality")) if requested else F.lit(None).cast("double")
    fallback = m.channel_map({**m.DEFAULT_RATES, **(defaults or {})}, F.col("modality"))
    per = selection.groupBy(key, "modality").agg(
        F.min_by("source_fs", F.when(F.col("source_fs").isNotNull(), F.col("slot"))).alias("_first"),
        F.min("source_fs").alias("_min"), F.max("source_fs").alias("_max"), F.count("source_fs").alias("channels"))
    rate = F.coalesce(ask, F.col("_first"), fallback)
    per = per.withColumn("sample_rate", rate)
    tol = F.greatest(F.lit(1e-6), F.lit(1e-9) * F.abs("sample_rate"))
    mixed = ask.isNull() & (F.greatest(F.abs(F.col("_min") - F.col("sample_rate")), F.abs(F.col("_max") - F.col("sample_rate"))) > tol)
    out = selection.join(per, [key, "modality"])
    ratio = F.col("source_fs") / F.col("sample_rate")
    broken = (ratio < 1 - 1e-6) | (F.abs(ratio - F.rint(ratio)) > 1e-6)
    problem = (F.when(F.coalesce(F.col("sample_rate"), F.lit(0.0)) <= 0, "no_rate").when(mixed, "mixed_rates")
               .when(F.coalesce(broken, F.lit(False)), "unsupported_resampling"))
    return out.withColumn("factor", F.rint(ratio).cast("int")).withColumn("problem", problem).drop("_first", "_min", "_max")


def raw_lengths(records: DataFrame, selection: DataFrame, epoch_seconds: float = 30.0, key: str = "path") -> DataFrame:
    """Usable duration (shortest of declared and selected channels) and epoch count."""
    short = selection.groupBy(key).agg(F.min(F.col("source_length") / F.col("source_fs")).alias("_short"))
    d = F.least(F.col("duration_sec"), F.col("_short"))
    return (records.select(key, "duration_sec").join(short, key)
            .select(key, d.alias("duration_sec"), F.floor((d + 1e-6) / epoch_seconds).alias("n_epochs")))


def raw_windows(lengths: DataFrame, mode: str = "epoch", context: int = 1, stride: int = 1, key: str = "path") -> DataFrame:
    """epoch, context or night samples; incomplete windows are dropped."""
    if mode not in ("epoch", "context", "night"):
        raise ValueError("sampling mode must be epoch, context or night")
    if context <= 0 or stride <= 0:
        raise ValueError("context and stride must be positive")
    n = F.col("n_epochs")
    if mode == "night":
        return lengths.where(n > 0).select(key, F.lit(0).cast("bigint").alias("window_no"), F.lit(0).cast("bigint").alias("start_epoch"),
                                           n.cast("bigint").alias("n_epochs"))
    need = 1 if mode == "epoch" else context
    count = F.when(n >= need, 1 + F.floor((n - need) / stride)).otherwise(0)
    rows = explode_range(lengths.select(key, "n_epochs"), count, "window_no")
    return rows.select(key, "window_no", (F.col("window_no") * stride).alias("start_epoch"), F.lit(need).cast("bigint").alias("n_epochs"))


def normalise(values: Column, method: str, clip: float | None = 20.0) -> Column:
    """Scale one channel of one window; non-finite samples become zero."""
    if method not in ("none", "zscore", "robust"):
        raise ValueError(f"{method!r} is no way to scale a window: none, zscore or robust")
    if method == "none":
        return values

    def one(x: np.ndarray) -> np.ndarray:
        ok = np.isfinite(x)
        good = x[ok]
        if not len(good):
            return np.zeros_like(x)
        if method == "zscore":
            centre, scale = good.mean(), good.std()
        else:
            ranked = np.sort(good)
            centre = ranked[(len(ranked) - 1) // 2]
            scale = np.subtract(*np.quantile(ranked, [0.75, 0.25])) / 1.349
        y = x - centre
        if np.isfinite(scale) and scale > 1e-8:
            y = y / scale
        y = np.where(ok, y, 0.0)
        return y if clip is None else np.clip(y, -clip, clip)

    @F.arrow_udf("array<float>")
    def run(v: pa.Array) -> pa.Array:
        rows = Rows(v)
        return pa.array([None if rows.null[i] else one(rows.values[s : s + n].astype(np.float64)).astype(np.float32)
                         for i, (s, n) in enumerate(zip(rows.start, rows.length))], pa.list_(pa.float32()))

    return run(values)
