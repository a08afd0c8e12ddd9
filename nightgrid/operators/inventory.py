"""Source inventory: assembly of sessions and channels, findings, and report tables.

Reports aggregate before they rank, and rank with a top-k filter where a limit is part of
the report, so a source or channel with most of the rows is reduced on every task first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions import headers as h
from nightgrid.functions.columns import finite, isclose, percent
from nightgrid.operators.scan import exact_quantiles

SOURCES = ("h5", "edf", "tsv")
QUANTILE_POINTS = {"min": 0.0, "p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75,
                   "p95": 0.95, "p99": 0.99, "max": 1.0}
CALIBRATION = ("dig_min", "dig_max", "phys_min", "phys_max")
# Field and absolute tolerance of the header comparisons.
H5_EDF_FIELDS = {"fs_hz": 1e-6, "hp_hz": 5e-4, "lp_hz": 5e-4, "dig_min": 1e-6, "dig_max": 1e-6,
                 "phys_min": 1e-6, "phys_max": 1e-6}
H5_TSV_FIELDS = {"fs_hz": 1e-6, "hp_hz": 5e-4, "lp_hz": 5e-4}
ISSUE_COLUMNS = ("session_key", "code", "channel", "field", "left_value", "right_value")
MODALITY_SETS = {
    "all_eeg": m.GROUP_CHANNELS["eeg"], "all_eog": m.GROUP_CHANNELS["eog"], "ecg": m.GROUP_CHANNELS["ecg"],
    "all_emg": m.GROUP_CHANNELS["emg"], "all_respiratory": m.GROUP_CHANNELS["respiratory"], "all_channels": m.CHANNELS}


# --- assembly ---------------------------------------------------------------------------------
def assemble_sessions(metadata: DataFrame, sources: Sequence[DataFrame], key: str = "session_key") -> DataFrame:
    """Every metadata row once, with whatever each source knows about it."""
    out = metadata
    for source in sources:
        out = out.join(source, key, "left")
    return out


def identify(channels: DataFrame) -> DataFrame:
    name = h.channel_name(F.col("raw_channel"))
    return (channels.withColumn("normalised_channel", name)
            .withColumn("canonical_channel", h.canonical_channel(F.col("normalised_channel"))))


def select_preferred(channels: DataFrame, order: str = "channel_no",
                     key: str = "session_key") -> DataFrame:
    """Flag one row per (session, source, canonical): lowest alias rank, then name, then order.

    ``order`` is the row's position in its source and must be unique there. A minimum per key with map-side combine instead of a window over all rows of a key.
    """
    keys = [key, "source", "canonical_channel"]
    place = F.struct(h.alias_rank(F.col("normalised_channel")).alias("rank"), "normalised_channel", order)
    named = channels.where(F.col("canonical_channel") != "")
    best = named.groupBy(*keys).agg(F.min(place).alias("_best"))
    return (channels.join(best, keys, "left")
            .withColumn("selected_for_model", F.coalesce(place == F.col("_best"), F.lit(False))).drop("_best"))


def selected(channels: DataFrame) -> DataFrame:
    return channels.where(F.col("selected_for_model") & (F.col("canonical_channel") != ""))


def candidates(channels: DataFrame) -> DataFrame:
    """Every row that could be selected, for reports that only ask whether a channel is there.

    A session has a selected row for a channel exactly when it has a candidate, so no pick is needed.
    """
    return channels.where(F.col("canonical_channel") != "").withColumn("selected_for_model", F.lit(True))


def preferred(channels: DataFrame, order: str = "channel_no", key: str = "session_key") -> DataFrame:
    """Only the rows :func:`select_preferred` would flag; most reports read nothing else.

    The rank-one filter becomes a group limit that runs before the shuffle, so a key with
    very many candidates sends one row per task.
    """
    w = Window.partitionBy(key, "source", "canonical_channel").orderBy(
        h.alias_rank(F.col("normalised_channel")), "normalised_channel", order)
    return (channels.where(F.col("canonical_channel") != "").withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") == 1).drop("_r").withColumn("selected_for_model", F.lit(True)))


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order per key, by aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def key_sets(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes of left-only, common and right-only key sets in one pass."""
    both = (left.select(*keys, F.lit(1).alias("_side")).unionByName(right.select(*keys, F.lit(2).alias("_side")))
            .groupBy(*keys).agg(F.bit_or("_side").alias("_in")))
    sides = {"left_only": 1, "right_only": 2, "both": 3}
    wide = both.agg(*[F.count_if(F.col("_in") == v).alias(k) for k, v in sides.items()])
    return wide.selectExpr("stack(3, " + ", ".join(f"'{k}', {k}" for k in sides) + ") AS (side, n)")


# --- findings -----------------------------------------------------------------------------------
def _issue(df: DataFrame, code: Column | str, channel: Column | None = None, field: Column | None = None,
           left: Column | None = None, right: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string")
    pick = lambda c: text if c is None else c.cast("string")
    return df.select("session_key", (F.lit(code) if isinstance(code, str) else code).alias("code"),
                     pick(channel).alias("channel"), pick(field).alias("field"),
                     pick(left).alias("left_value"), pick(right).alias("right_value"))


def session_findings(tolerance: float = 30.0) -> Column:
    """All findings that one session row shows, as an array of (code, field, left_value, right_value).

    A missing sidecar JSON is no finding; an unreadable one is.
    """
    missing = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    wrong_id = (F.col("h5_exists") & F.col("h5_error").isNull()
                & ((F.coalesce("h5_subject_id", F.lit("")) != F.col("subject_id").cast("string"))
                   | (F.coalesce("h5_session_id", F.lit("")) != F.col("session_id").cast("string"))))
    none = F.lit(None).cast("string")

    def entry(cond, code, field=None, left=None, right=None):
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(code).alias("code"), (none if field is None else F.lit(field)).alias("field"),
            (none if left is None else left.cast("string")).alias("left_value"),
            (none if right is None else right.cast("string")).alias("right_value")))

    def late(field):
        gap = F.col(field) - F.col("metadata_duration_seconds")
        return entry(F.abs(gap) > tolerance, "DURATION_MISMATCH_GT30S", field, F.col(field), F.col("metadata_duration_seconds"))

    found = F.array(
        entry(missing("h5_exists"), "H5_MISSING"), entry(F.col("h5_error").isNotNull(), "H5_HEADER_ERROR"),
        entry(wrong_id, "H5_IDENTITY_MISMATCH"), entry(missing("edf_exists"), "EDF_MISSING"),
        entry(F.col("edf_error").isNotNull(), "EDF_HEADER_ERROR"),
        entry(missing("channels_tsv_exists"), "CHANNELS_TSV_MISSING"),
        entry(F.col("tsv_error").isNotNull(), "TSV_READ_ERROR"),
        entry(F.col("bids_json_error").isNotNull(), "BIDS_JSON_ERROR"),
        entry(missing("manual_sleep_csv_exists"), "MANUAL_SLEEP_CSV_MISSING"),
        late("h5_duration_seconds"), late("edf_duration_seconds"))
    return F.filter(found, lambda e: e.isNotNull())


def session_issues(sessions: DataFrame, tolerance: float = 30.0) -> DataFrame:
    """One row per finding of ``session_findings``."""
    rows = sessions.select("session_key", F.explode(session_findings(tolerance)).alias("e"))
    return rows.select("session_key", "e.code", F.lit(None).cast("string").alias("channel"), "e.field", "e.left_value", "e.right_value")


def missing_channels(sessions: DataFrame, channels: DataFrame, sources: Sequence[str] = SOURCES,
                     expected: Sequence[str] = m.CHANNELS) -> DataFrame:
    """Expected (source, channel) pairs that a session has no selected row for.

    What a session has fits in one bit mask, so the expected grid is opened only after a
    join at session grain.
    """
    pairs = [(s, c) for s in sources for c in expected]
    if len(pairs) > 63:
        raise ValueError("more than 63 expected pairs do not fit the mask")
    place = m.channel_map({f"{s}/{c}": i for i, (s, c) in enumerate(pairs)},
                          F.concat_ws("/", "source", "canonical_channel"))
    have = (selected(channels).select("session_key", place.alias("_i")).where(F.col("_i").isNotNull())
            .groupBy("session_key").agg(F.bit_or(F.expr("shiftleft(1L, _i)")).alias("_have")))
    rows = sessions.select("session_key").join(have, "session_key", "left")
    gone = F.filter(F.sequence(F.lit(0), F.lit(len(pairs) - 1)),
                    lambda i: F.getbit(F.coalesce("_have", F.lit(0).cast("bigint")), i) == 0)
    out = rows.select("session_key", F.explode(gone).alias("_i"))
    text = lambda items: F.get(F.expr("array(" + ", ".join(f"'{x}'" for x in items) + ")"), F.col("_i"))
    return _issue(out, text([f"{s.upper()}_SELECTED_CHANNEL_MISSING" for s, _ in pairs]), text([c for _, c in pairs]))


def channel_bit(expected: Sequence[str] = m.CHANNELS) -> Column:
    return F.coalesce(m.channel_map({c: 1 << i for i, c in enumerate(expected)}, F.col("canonical_channel")), F.lit(0))


def _by_source(channels: DataFrame, sources: Sequence[str], fields: Sequence[str], order: str = "channel_no") -> DataFrame:
    """One row per (session, channel) with a struct per source: its preferred row.

    The pick is part of the aggregation, with map-side combine: no window, and one shuffle
    serves every comparison, where joining the sources pairwise would take one per side.
    """
    place = F.struct(h.alias_rank(F.col("normalised_channel")).alias("rank"), "normalised_channel", order)
    rows = channels.where((F.col("canonical_channel") != "") & F.col("source").isin(*sources)).withColumn("_place", place)
    value = F.struct(*fields)
    return rows.groupBy("session_key", "canonical_channel").agg(
        *[F.min_by(value, F.when(F.col("source") == s, F.col("_place"))).alias(s) for s in sources])


def _mismatch(left: str, right: str, field: str, tol: float, mismatch: str, unknown: str | None) -> Column:
    l, r = F.col(left)[field], F.col(right)[field]
    code = F.when(~isclose(l, r, 1e-8, tol), mismatch)
    if unknown is not None:
        code = F.when(l.isNull() != r.isNull(), unknown).otherwise(code)
    return _finding(F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), code), field, l, r)


def _finding(code: Column, field: str, left: Column, right: Column) -> Column:
    return F.struct(code.alias("code"), F.lit(field).alias("field"), left.cast("string").alias("left_value"),
                    right.cast("string").alias("right_value"))


def _h5_edf() -> list[Column]:
    text = lambda s: F.lower(F.coalesce(F.col(s)["unit"], F.lit("")))
    unit = F.when(F.col("h5").isNotNull() & F.col("edf").isNotNull() & (text("h5") != text("edf")), "H5_EDF_UNIT_MISMATCH")
    return [_mismatch("h5", "edf", f, t, "H5_EDF_METADATA_MISMATCH", "H5_EDF_METADATA_UNKNOWN")
            for f, t in H5_EDF_FIELDS.items()] + [_finding(unit, "unit", F.col("h5")["unit"], F.col("edf")["unit"])]


def _h5_tsv() -> list[Column]:
    return [_mismatch("h5", "tsv", f, t, "H5_TSV_METADATA_MISMATCH", None) for f, t in H5_TSV_FIELDS.items()]


def _header_issues(channels: DataFrame, sources: Sequence[str], checks: list[Column]) -> DataFrame:
    rows = _by_source(channels, sources, [*H5_EDF_FIELDS, "unit"])
    found = F.filter(F.array(*checks), lambda e: e["code"].isNotNull())
    out = rows.select("session_key", "canonical_channel", F.explode(found).alias("e"))
    return out.select("session_key", "e.code", F.col("canonical_channel").alias("channel"), "e.field",
                      "e.left_value", "e.right_value")


def h5_edf_issues(channels: DataFrame) -> DataFrame:
    return _header_issues(channels, ("h5", "edf"), _h5_edf())


def h5_tsv_issues(channels: DataFrame) -> DataFrame:
    return _header_issues(channels, ("h5", "tsv"), _h5_tsv())


def header_issues(channels: DataFrame) -> DataFrame:
    """Both header comparisons in one pass."""
    return _header_issues(channels, SOURCES, _h5_edf() + _h5_tsv())


def all_issues(sessions: DataFrame, channels: DataFrame, expected: Sequence[str] = m.CHANNELS) -> DataFrame:
    """Session findings, missing channels and header comparisons from identified channel rows.

    One aggregation per (session, channel) gives the preferred row of each source, hence both what is
    compared and what is there; folded to one row a session it meets the sessions once.
    """
    pairs = _by_source(channels, SOURCES, [*H5_EDF_FIELDS, "unit"])
    at = m.channel_map({c: i for i, c in enumerate(expected)}, F.col("canonical_channel"))
    bits = [F.when(F.col(s).isNotNull(), F.call_function("shiftleft", F.lit(1).cast("bigint"), at + i * len(expected))).otherwise(0)
            for i, s in enumerate(SOURCES)]
    checks = F.filter(F.array(*_h5_edf(), *_h5_tsv()), lambda e: e["code"].isNotNull())
    shaped = F.transform(checks, lambda e: F.struct(e["code"].alias("code"), F.col("canonical_channel").alias("channel"), e["field"].alias("field"),
                                                    e["left_value"].alias("left_value"), e["right_value"].alias("right_value")))
    # At most one row for each of the model's channels.
    have = (pairs.select("session_key", shaped.alias("_found"), sum(bits[1:], bits[0]).alias("_bits"))
            .groupBy("session_key").agg(F.flatten(F.collect_list("_found")).alias("_found"), F.bit_or("_bits").alias("_have")))
    wanted = [(s, c) for s in SOURCES for c in expected]
    names = F.expr("array(" + ", ".join(f"'{s.upper()}_SELECTED_CHANNEL_MISSING'" for s, _ in wanted) + ")")
    channel = F.expr("array(" + ", ".join(f"'{c}'" for _, c in wanted) + ")")
    none = F.lit(None).cast("string")
    gone = F.transform(F.filter(F.sequence(F.lit(0), F.lit(len(wanted) - 1)), lambda i: F.getbit(F.coalesce("_have", F.lit(0).cast("bigint")), i) == 0),
                       lambda i: F.struct(F.get(names, i).alias("code"), F.get(channel, i).alias("channel"), none.alias("field"),
                                          none.alias("left_value"), none.alias("right_value")))
    own = F.transform(session_findings(), lambda e: F.struct(e["code"].alias("code"), none.alias("channel"), e["field"].alias("field"),
                                                             e["left_value"].alias("left_value"), e["right_value"].alias("right_value")))
    # Channels of a session that is not listed are compared, but nothing is missing from it.
    listed = F.col("_listed").isNotNull()
    empty = F.expr("array()").cast("array<struct<code:string,channel:string,field:string,left_value:string,right_value:string>>")
    found = F.concat(F.coalesce("_found", empty), F.when(listed, gone).otherwise(empty), F.when(listed, own).otherwise(empty))
    return (sessions.withColumn("_listed", F.lit(True)).join(have, "session_key", "full_outer")
            .select("session_key", F.explode(found).alias("e")).select("session_key", "e.*"))


# --- report tables ------------------------------------------------------------------------------
def with_share(df: DataFrame, total: DataFrame, count: str, name: str = "percent") -> DataFrame:
    """Share of a one-row total."""
    return (df.crossJoin(F.broadcast(total.select(F.col(total.columns[0]).alias("_total"))))  # one row
            .withColumn(name, percent(F.col(count), F.col("_total"))).drop("_total"))


def session_total(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count("*").alias("total"))


def distribution(rows: DataFrame, keys: Sequence[str], values: Sequence[str], top: int | None = None,
                 total: DataFrame | None = None) -> DataFrame:
    """Counts of value combinations per key, share within the key and of all sessions.

    With ``top``, only the most frequent k per key; ties go to the smaller values.
    """
    counts = rows.groupBy(*keys, *values).agg(F.count("*").alias("n"))
    if keys:
        per_key = counts.groupBy(*keys).agg(F.sum("n").alias("_key"))
        out = counts.join(per_key, list(keys))
    else:
        out = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_key"))))  # one row
    out = out.withColumn("percent_of_group", percent(F.col("n"), F.col("_key"))).drop("_key")
    if top is not None:
        order = Window.partitionBy(*keys).orderBy(F.desc("n"), *[F.col(v).asc_nulls_first() for v in values])
        out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out if total is None else with_share(out, total, "n", "percent_of_all")


def issue_counts(issues: DataFrame, total: DataFrame) -> DataFrame:
    out = issues.groupBy("code").agg(F.count("*").alias("findings"), F.count_distinct("session_key").alias("sessions"))
    return with_share(out, total, "sessions")


FILTER_KEY = ("source", "channel", "raw_channel", "selected_for_model", "prefilter_raw", "hp_hz", "lp_hz",
              "notch_hz", "fs_hz", "unit")


def filter_distribution(channels: DataFrame, total: DataFrame) -> DataFrame:
    name = F.when(F.col("canonical_channel") != "", F.col("canonical_channel")).otherwise(F.col("normalised_channel"))
    rows = (channels.withColumn("channel", name)
            .withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("prefilter_raw", "unit")}))
    out = rows.groupBy(*FILTER_KEY).agg(F.count_distinct("session_key").alias("recording_count"))
    return with_share(out, total, "recording_count", "percent_of_all_recordings")


def channel_coverage(channels: DataFrame, total: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Source x channel with zeros kept; a fixed grid of rows."""
    spark = channels.sparkSession
    grid = m.inline_table(spark, [(s, c) for s in sources for c in m.CHANNELS], ("source", "channel"))
    seen = (selected(channels).groupBy("source", F.col("canonical_channel").alias("channel"))
            .agg(F.count_distinct("session_key").alias("recording_count")))
    return with_share(grid.join(seen, ["source", "channel"], "left").fillna(0, ["recording_count"]),
                      total, "recording_count")


def inventory_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count("*").alias("recording_count"), F.count_distinct("subject_id").alias("subject_count"),
        F.count_distinct("patient_id").alias("patient_count"),
        *[F.count_if(F.coalesce(F.col(f"{x}_exists"), F.lit(False))).alias(f"{x}_found")
          for x in ("h5", "edf", "channels_tsv", "manual_sleep_csv")])


def quantile_table(rows: DataFrame, columns: dict[str, str], divisor: float = 1.0,
                   sources: Sequence[str] | None = None) -> DataFrame:
    """Nine-point quantiles, count and mean of several columns; empty ones keep count 0."""
    parts = ", ".join(f"'{label}', CAST({c} AS DOUBLE)" for label, c in columns.items())
    long = rows.selectExpr(f"stack({len(columns)}, {parts}) AS (source, value)")
    found = exact_quantiles(long, ["source"], F.col("value") / F.lit(divisor), QUANTILE_POINTS)
    labels = m.inline_table(rows.sparkSession, [(c,) for c in columns], ("source",))
    return labels.join(found, "source", "left").fillna(0, ["count"])


def sessions_per_patient(sessions: DataFrame) -> DataFrame:
    per = sessions.groupBy("patient_id").agg(F.count("*").alias("sessions"))
    out = per.groupBy("sessions").agg(F.count("*").alias("patients"))
    return with_share(out, out.agg(F.sum("patients").alias("t")), "patients")


def patient_summary(sessions: DataFrame) -> DataFrame:
    per = sessions.groupBy("patient_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("patients"), F.count_if(F.col("n") > 1).alias("multi_session_patients"),
                   F.max("n").alias("max_sessions"))


def year_distribution(sessions: DataFrame, column: str = "metadata_start") -> DataFrame:
    year = F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"(19|20)\d{2}", 0)
    out = sessions.groupBy(F.when(year == "", "unknown").otherwise(year).alias("year")).agg(F.count("*").alias("nights"))
    return with_share(out, out.agg(F.sum("nights").alias("t")), "nights")


def file_presence(sessions: DataFrame, kinds: Sequence[str] = (
        "h5", "edf", "channels_tsv", "bids_json", "manual_sleep_csv")) -> DataFrame:
    wide = sessions.agg(F.count("*").alias("total"), *[
        F.count_if(F.coalesce(F.col(f"{k}_exists"), F.lit(False))).alias(k) for k in kinds])
    stack = ", ".join(f"'{k}', {k}" for k in kinds)
    return (wide.selectExpr("total", f"stack({len(kinds)}, {stack}) AS (kind, present)")
            .withColumn("missing", F.col("total") - F.col("present"))
            .withColumn("percent", percent(F.col("present"), F.col("total"))).drop("total"))


def file_sizes(sessions: DataFrame) -> DataFrame:
    """Totals in GiB and TiB, quantiles in MiB."""
    q = quantile_table(sessions, {"h5": "h5_bytes", "edf": "edf_bytes"}, 1024.0**2)
    gib = F.col("mean") * F.col("count") / 1024
    return q.withColumn("total_gib", gib).withColumn("total_tib", gib / 1024)


def size_ratio(sessions: DataFrame) -> DataFrame:
    rows = sessions.where(F.col("h5_bytes").isNotNull() & (F.col("edf_bytes") != 0))
    return exact_quantiles(rows, [], F.col("h5_bytes") / F.col("edf_bytes"), QUANTILE_POINTS)


def duration_bin(seconds: Column) -> Column:
    return (F.when(seconds < 3600, "<1h").when(seconds < 14400, "1-<4h").when(seconds < 18000, "4-<5h")
            .when(seconds < 28800, "5-<8h").when(seconds <= 43200, "8-12h").otherwise(">12h"))


def _durations(sessions: DataFrame) -> DataFrame:
    return sessions.selectExpr(
        "stack(2, 'h5', h5_duration_seconds, 'edf', edf_duration_seconds) AS (source, value)").where("value IS NOT NULL")


def duration_bins(sessions: DataFrame) -> DataFrame:
    rows = _durations(sessions).withColumn("bin", duration_bin(F.col("value")))
    bins = m.inline_table(sessions.sparkSession, [
        (s, b) for s in ("h5", "edf") for b in ("<1h", "1-<4h", "4-<5h", "5-<8h", "8-12h", ">12h")], ("source", "bin"))
    counts = rows.groupBy("source", "bin").agg(F.count("*").alias("nights"))
    total = counts.groupBy("source").agg(F.sum("nights").alias("_t"))
    return (bins.join(counts, ["source", "bin"], "left").fillna(0, ["nights"]).join(total, "source", "left")
            .withColumn("percent", percent(F.col("nights"), F.col("_t"))).drop("_t"))


def duration_thresholds(sessions: DataFrame) -> DataFrame:
    v = F.col("value")
    tests = {"<30s": v < 30, "<5min": v < 300, "<30min": v < 1800, "<1h": v < 3600, ">4h": v > 14400, ">5h": v > 18000}
    wide = _durations(sessions).groupBy("source").agg(
        F.count("*").alias("total"), *[F.count_if(c).alias(f"t{i}") for i, c in enumerate(tests.values())])
    stack = ", ".join(f"'{k}', t{i}" for i, k in enumerate(tests))
    return (wide.selectExpr("source", "total", f"stack({len(tests)}, {stack}) AS (threshold, nights)")
            .withColumn("percent", percent(F.col("nights"), F.col("total"))).drop("total"))


def paired_duration_classes(sessions: DataFrame) -> DataFrame:
    d = F.col("edf_duration_seconds") - F.col("h5_duration_seconds")
    classes = {"exact": F.abs(d) <= 1e-6, "differ": F.abs(d) > 1e-6, "abs_gt_1s": F.abs(d) > 1, "abs_gt_30s": F.abs(d) > 30,
               "edf_longer": d > 1e-6, "h5_longer": d < -1e-6}
    wide = sessions.where(d.isNotNull()).agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in classes.items()])
    stack = ", ".join(f"'{k}', {k}" for k in classes)
    return (wide.selectExpr("total", f"stack({len(classes)}, {stack}) AS (comparison, nights)")
            .withColumn("percent", percent(F.col("nights"), F.col("total"))).drop("total"))


def duration_outliers(sessions: DataFrame) -> DataFrame:
    d = F.col("edf_duration_seconds") - F.col("h5_duration_seconds")
    return (sessions.where(F.abs(d) > 1e-6)
            .select("session_key", "h5_duration_seconds", "edf_duration_seconds", d.alias("difference"))
            .orderBy(F.desc(F.abs(F.col("difference"))), "session_key"))


def source_masks(channels: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Which sources have a channel, as bits, per (session, channel)."""
    bit = m.channel_map({s: 1 << i for i, s in enumerate(sources)}, F.col("source"))
    return (selected(channels).groupBy("session_key", F.col("canonical_channel").alias("channel"))
            .agg(F.bit_or(F.coalesce(bit, F.lit(0))).alias("mask")))


def coverage_comparison(channels: DataFrame, total: DataFrame) -> DataFrame:
    """Per channel: sessions per source, h5-only and edf-only counts."""
    has = lambda b: F.col("mask").bitwiseAND(b) != 0
    names = m.inline_table(channels.sparkSession, [(c,) for c in m.CHANNELS], ("channel",))
    out = source_masks(channels).groupBy("channel").agg(
        F.count_if(has(1)).alias("h5"), F.count_if(has(2)).alias("edf"), F.count_if(has(4)).alias("tsv"),
        F.count_if(has(1) & ~has(2)).alias("h5_only"), F.count_if(has(2) & ~has(1)).alias("edf_only"),
        F.count_if(has(1) & has(2)).alias("paired"))
    out = names.join(out, "channel", "left").fillna(0)
    for s in SOURCES:
        out = with_share(out, total, s, f"{s}_percent")
    return out


def combination_completeness(sessions: DataFrame, channels: DataFrame, sets: dict = MODALITY_SETS,
                             sources: Sequence[str] = SOURCES) -> DataFrame:
    """Sessions whose source has every channel of a set, via one bit mask per session and source."""
    have = selected(channels).groupBy("session_key", "source").agg(F.bit_or(channel_bit()).alias("mask"))
    have = have.join(sessions.select("session_key"), "session_key", "left_semi")
    bits = {k: sum(1 << m.CHANNELS.index(c) for c in v) for k, v in sets.items()}
    wide = have.groupBy("source").agg(*[F.count_if(F.col("mask").bitwiseAND(b) == b).alias(f"c{i}") for i, b in enumerate(bits.values())])
    stack = ", ".join(f"'{k}', c{i}" for i, k in enumerate(bits))
    names = m.inline_table(sessions.sparkSession, [(s,) for s in sources], ("source",))
    long = names.join(wide, "source", "left").fillna(0).selectExpr("source", f"stack({len(bits)}, {stack}) AS (combination, nights)")
    return with_share(long, session_total(sessions), "nights")


def channel_duration_agreement(channels: DataFrame) -> DataFrame:
    """Per channel: paired nights and how far the two sources' durations differ."""
    sel = selected(channels).where(F.col("source").isin("h5", "edf"))
    pick = lambda s: F.max(F.when(F.col("source") == s, F.col("duration_seconds")))
    per = sel.groupBy("session_key", F.col("canonical_channel").alias("channel")).agg(
        pick("h5").alias("_h"), pick("edf").alias("_e"), F.bit_or(F.when(F.col("source") == "h5", 1).otherwise(2)).alias("_in"))
    d = F.abs(F.col("_e") - F.col("_h"))
    both = F.col("_in") == 3
    return per.groupBy("channel").agg(
        F.count_if(both).alias("paired"), F.count_if(both & (d <= 1e-6)).alias("exact"), F.count_if(both & (d > 1)).alias("gt_1s"),
        F.count_if(both & (d > 30)).alias("gt_30s"), F.count_if(F.col("_in") == 1).alias("h5_only"),
        F.count_if(F.col("_in") == 2).alias("edf_only"), F.max(F.when(both, d)).alias("max_abs_difference"))


def model_rows(channels: DataFrame, sources: Sequence[str] = ("h5", "edf")) -> DataFrame:
    return (selected(channels).where(F.col("source").isin(*sources))
            .withColumn("channel", F.col("canonical_channel")))


def sampling_rates(channels: DataFrame, total: DataFrame) -> DataFrame:
    return distribution(model_rows(channels), ["source", "channel"], ["fs_hz"], total=total)


def joint_filters(channels: DataFrame, total: DataFrame, top: int = 3) -> DataFrame:
    return distribution(model_rows(channels), ["source", "channel"], ["fs_hz", "hp_hz", "lp_hz", "notch_hz"], top, total)


def filter_summary(channels: DataFrame) -> DataFrame:
    profile = F.struct("fs_hz", "hp_hz", "lp_hz", "notch_hz")
    return model_rows(channels).groupBy("source", "channel").agg(
        F.count("*").alias("nights"), F.count_if(F.coalesce("filter_parse_ok", F.lit(False))).alias("parsed"),
        F.count_distinct(profile).alias("profiles")).withColumn("parsed_percent", percent(F.col("parsed"), F.col("nights")))


def _blank(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("(blank)"))


def unit_distribution(channels: DataFrame, total: DataFrame) -> DataFrame:
    return distribution(model_rows(channels).withColumn("unit", _blank("unit")), ["source", "channel"], ["unit"], total=total)


def raw_names(channels: DataFrame, top: int = 5) -> DataFrame:
    return distribution(model_rows(channels).withColumn("raw_channel", _blank("raw_channel")), ["source", "channel"], ["raw_channel"], top)


def storage_profiles(channels: DataFrame, top: int = 3) -> DataFrame:
    rows = model_rows(channels).withColumns({"dtype": _blank("dtype"), "value_domain": _blank("value_domain")})
    return distribution(rows, ["source", "channel"], ["dtype", "value_domain"], top)


def calibration_profiles(channels: DataFrame, top: int = 3) -> DataFrame:
    return distribution(model_rows(channels).withColumn("unit", _blank("unit")), ["source", "channel"], [*CALIBRATION, "unit"], top)


def calibration_completeness(channels: DataFrame, chosen: DataFrame) -> DataFrame:
    """Non-null counts for all h5 rows, the selected ones, and each selected channel.

    The selected scope adds up the few channel rows instead of reading again.
    """
    whole = F.lit(True)
    for f in CALIBRATION:
        whole = whole & F.col(f).isNotNull()
    sums = ["instances", *[f"{f}_present" for f in CALIBRATION], "all_four"]
    count = lambda df, scope: df.where(F.col("source") == "h5").groupBy(scope.alias("scope")).agg(
        F.count("*").alias("instances"), *[F.count(f).alias(f"{f}_present") for f in CALIBRATION],
        F.count_if(whole).alias("all_four"))
    per = count(chosen, F.concat(F.lit("channel:"), F.col("canonical_channel")))
    added = per.groupBy(F.lit("selected").alias("scope")).agg(*[F.sum(c).alias(c) for c in sums])
    out = count(channels, F.lit("all")).unionByName(added).unionByName(per)
    return (out.withColumn("any_missing", F.col("instances") - F.col("all_four"))
            .withColumn("complete_percent", percent(F.col("all_four"), F.col("instances"))))


def missing_combinations(channels: DataFrame) -> DataFrame:
    combo = F.concat_ws("+", *[F.when(F.col(f).isNull(), F.lit(f)) for f in CALIBRATION])
    rows = channels.where(F.col("source") == "h5").withColumn("missing_fields", combo).where(F.col("missing_fields") != "")
    return rows.groupBy("missing_fields").agg(F.count("*").alias("instances"))


def mismatch_by_channel(issues: DataFrame, coverage: DataFrame, code: str = "H5_EDF_METADATA_MISMATCH") -> DataFrame:
    """Findings and affected sessions per channel, as a share of paired sessions."""
    found = issues.where(F.col("code") == code).groupBy("channel").agg(
        F.count("*").alias("findings"), F.count_distinct("session_key").alias("sessions"))
    return (coverage.select("channel", "paired").join(found, "channel", "left").fillna(0)
            .withColumn("percent_of_paired", percent(F.col("sessions"), F.col("paired"))))


def mismatch_by_field(issues: DataFrame, total: DataFrame, codes: Sequence[str]) -> DataFrame:
    out = issues.where(F.col("code").isin(*codes)).groupBy("channel", "field").agg(
        F.count("*").alias("findings"), F.count_distinct("session_key").alias("sessions"))
    return with_share(out, total, "sessions")


def paired_counts(channels: DataFrame, left: str = "h5", right: str = "tsv") -> DataFrame:
    a, b = 1 << SOURCES.index(left), 1 << SOURCES.index(right)
    both = (F.col("mask").bitwiseAND(a) != 0) & (F.col("mask").bitwiseAND(b) != 0)
    names = m.inline_table(channels.sparkSession, [(c,) for c in m.CHANNELS], ("channel",))
    found = source_masks(channels).groupBy("channel").agg(F.count_if(both).alias("paired"))
    return names.join(found, "channel", "left").fillna(0)


def missing_edf_channels(issues: DataFrame, channels: DataFrame, total: DataFrame) -> DataFrame:
    """Missing and present counts per channel, most missing first."""
    gone = issues.where(F.col("code") == "EDF_SELECTED_CHANNEL_MISSING").groupBy("channel").agg(F.count("*").alias("missing"))
    here = channel_coverage(channels, total, ("edf",)).select("channel", F.col("recording_count").alias("present"))
    out = with_share(here.join(gone, "channel", "left").fillna(0), total, "missing", "missing_percent")
    order = m.channel_map({c: i for i, c in enumerate(m.CHANNELS)}, F.col("channel"))
    return out.orderBy(F.desc("missing"), order)


def shown_number(x: Column) -> Column:
    """Integers without a point, others with up to three decimals, NULL as unknown."""
    short = F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")
    return (F.when(x.isNull() | ~finite(x), "unknown").when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(short))


def shown_text(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x == "", "(blank)").otherwise(x)


def header_fields(sessions: DataFrame, text: Sequence[str], numbers: Sequence[str], top: int = 20) -> DataFrame:
    """Top values per header field and one remainder row for the rest."""
    parts = [f"'{f}', _t_{f}" for f in (*text, *numbers)]
    shown = {f"_t_{f}": shown_text(F.col(f)) for f in text}
    shown |= {f"_t_{f}": shown_number(F.col(f).cast("double")) for f in numbers}
    long = sessions.withColumns(shown).selectExpr(f"stack({len(parts)}, {', '.join(parts)}) AS (field, value)")
    ranked = distribution(long, ["field"], ["value"], top).select("field", "rank", "value", "n")
    total = session_total(sessions)
    rest = (ranked.groupBy("field").agg(F.sum("n").alias("_top")).crossJoin(F.broadcast(total))  # one row
            .where(F.col("total") > F.col("_top"))
            .select("field", F.lit(top + 1).alias("rank"), F.lit("other").alias("value"), (F.col("total") - F.col("_top")).alias("n")))
    return with_share(ranked.unionByName(rest), total, "n")


def strict_rows(channels: DataFrame, name: str = "airflow") -> DataFrame:
    return channels.where((F.col("source") == "h5") & (F.lower(F.trim("raw_channel")) == name))


def strict_presence(sessions: DataFrame, channels: DataFrame, chosen: DataFrame, name: str = "airflow") -> DataFrame:
    """Sessions with the exact name, without it, and served by another name."""
    exact = strict_rows(channels, name).select("session_key").distinct()
    canon = (selected(chosen).where((F.col("source") == "h5") & (F.col("canonical_channel") == name))
             .select("session_key").distinct())
    fallback = canon.join(exact, "session_key", "left_anti").agg(F.count("*").alias("fallback"))
    present = exact.agg(F.count("*").alias("present"))
    total = session_total(sessions)
    wide = total.crossJoin(F.broadcast(present)).crossJoin(F.broadcast(fallback))  # one row each
    return (wide.selectExpr("total", "stack(3, 'present', present, 'missing', total - present, 'fallback', fallback) AS (item, nights)")
            .withColumn("percent", percent(F.col("nights"), F.col("total"))).drop("total"))


def strict_profiles(channels: DataFrame, values: Sequence[str], name: str = "airflow") -> DataFrame:
    rows = strict_rows(channels, name).withColumn("unit", _blank("unit"))
    return distribution(rows, [], list(values))


def range_audit(sessions: DataFrame, channels: DataFrame, strict: str = "airflow") -> DataFrame:
    """Per channel: presence, number of calibration profiles, units, missing units and ranges."""
    exact = F.lower(F.trim("raw_channel")) == strict
    rows = (model_rows(channels, ("h5",)).where((F.col("channel") != strict) | exact)
            .withColumn("_unit", F.coalesce(F.nullif(F.trim("unit"), F.lit("")), F.lit("(blank)"))))
    broken = F.lit(False)
    for f in CALIBRATION:
        broken = broken | F.col(f).isNull()
    # Profiles and units are reduced to their distinct values before anything is gathered.
    per = rows.groupBy("channel", *CALIBRATION, "_unit").agg(
        F.count("*").alias("n"), F.count_if(broken).alias("_broken"))
    facts = per.groupBy("channel").agg(
        F.count("*").alias("profiles"), F.sum(F.when(F.col("_unit") == "(blank)", F.col("n")).otherwise(0)).alias("missing_units"),
        F.sum("_broken").alias("missing_ranges"), F.sum("n").alias("nights_rows"))
    units = (per.select("channel", "_unit").distinct().groupBy("channel")
             .agg(F.concat_ws(", ", F.array_sort(F.collect_list("_unit"))).alias("units")))
    nights = rows.groupBy("channel").agg(F.count_distinct("session_key").alias("present"))
    out = nights.join(facts, "channel").join(units, "channel")
    out = with_share(out, session_total(sessions), "present", "present_percent")
    return out.withColumn("missing_unit_percent", percent(F.col("missing_units"), F.col("nights_rows"))).drop("nights_rows")


def write_inventory(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}")
