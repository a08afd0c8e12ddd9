"""Channel headers to processing decisions: calibration, gates, status and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.functions import headers as h
from nightgrid.functions.columns import finite, isclose

CALIBRATION = ("dig_min", "dig_max", "phys_min", "phys_max")


def calibration_finite() -> Column:
    ok = finite(F.col(CALIBRATION[0]))
    for name in CALIBRATION[1:]:
        ok = ok & finite(F.col(name))
    return ok


def calibration_valid() -> Column:
    """Finite, ordered calibration and a unit the channel allows."""
    unit = h.unit_name(F.col("unit"))
    unit_ok = F.when(F.col("channel") == "spo2", unit.isin(*m.PERCENT_UNITS)).otherwise(
        unit.isin(*m.UNIT_SCALE))
    ordered = (F.col("dig_max") > F.col("dig_min")) & (F.col("phys_max") > F.col("phys_min"))
    return calibration_finite() & ordered & unit_ok


def _gain() -> Column:
    """Physical units per code; NULL when the code range is empty."""
    return ((F.col("phys_max") - F.col("phys_min"))
            / F.nullif(F.col("dig_max") - F.col("dig_min"), F.lit(0.0)))


def _scale() -> Column:
    return F.when(F.col("channel") == "spo2", F.lit(1.0)).otherwise(h.unit_scale(F.col("unit")))


def with_gain(df: DataFrame) -> DataFrame:
    """Add gain and scale: physical = (phys_min + (code - dig_min)*gain)*scale."""
    return df.withColumn("gain", _gain()).withColumn("scale", _scale())


def physical(codes: Column) -> Column:
    """Strict calibration of an array of codes; NULL when the header does not allow it."""
    step, scale = _gain(), _scale()
    values = F.transform(codes, lambda c: (
        F.col("phys_min") + (c.cast("double") - F.col("dig_min")) * step) * scale)
    return F.when(calibration_valid(), values)


def physical_lenient(codes: Column) -> Column:
    """Float32 calibration where possible, codes unchanged where not."""
    dmin, dmax, pmin, pmax = (F.col(c).cast("double") for c in CALIBRATION)
    step = ((pmax - pmin) / F.nullif(dmax - dmin, F.lit(0.0))).cast("float")
    usable = calibration_finite() & (dmax > dmin)
    raw = F.transform(codes, lambda c: c.cast("float"))
    moved = F.transform(raw, lambda c: (
        ((c - dmin.cast("float")).cast("float") * step).cast("float") + pmin.cast("float")).cast("float"))
    return F.when(usable, moved).otherwise(raw)


def output_unit() -> Column:
    return F.when(F.col("channel") == "spo2", "%").otherwise("uV")


def profile_accepted() -> Column:
    unit = h.unit_name(F.col("unit"))
    span = lambda low, high: (F.col("phys_min") == low) & (F.col("phys_max") == high)
    verdict = (F.when(F.col("channel") == "airflow", span(-3200.0, 3200.0) & (unit == "uv"))
               .when(F.col("channel") == "spo2", span(0.0, 100.0) & unit.isin(*m.PERCENT_UNITS))
               .otherwise(F.lit(True)))
    return F.coalesce(verdict, F.lit(False))


def rate_valid(fs: Column, epoch_seconds: float = 30.0) -> Column:
    per_epoch = fs * F.lit(epoch_seconds)
    return F.coalesce(
        finite(fs) & (fs > 0) & isclose(per_epoch, F.rint(per_epoch), tol=1e-8), F.lit(False))


def epoch_covered(epoch: Column, fs: Column, source_samples: Column,
                  epoch_seconds: float = 30.0) -> Column:
    need = (epoch.cast("bigint") + 1) * F.rint(fs * F.lit(epoch_seconds)).cast("bigint")
    return F.coalesce(need <= source_samples, F.lit(False))


def channel_status() -> Column:
    """First failing check decides, in this fixed order."""
    s = m.CHANNEL_STATUS
    bad_rate = ~rate_valid(F.col("fs")) | F.col("source_samples").isNull()
    return (F.when(F.col("read_error").isNotNull(), F.lit(s["CHANNEL_UNREADABLE"]))
            .when(~F.coalesce(F.col("source_present"), F.lit(False)), F.lit(s["CHANNEL_MISSING"]))
            .when(bad_rate, F.lit(s["CALIBRATION_OR_UNIT_INVALID"]))
            .when(~profile_accepted(), F.lit(s["PROFILE_EXCLUDED"]))
            .when(~F.coalesce(calibration_valid(), F.lit(False)), F.lit(s["CALIBRATION_OR_UNIT_INVALID"]))
            .otherwise(F.lit(s["AVAILABLE"])))


def supplement_band(channel: Column, fs: Column) -> tuple[Column, Column]:
    """Target band of the supplementary filter; 95 Hz top for EMG and snore at 200 Hz."""
    kind = m.kind_column(channel)
    low = m.channel_map({k: v[0] for k, v in m.FILTER_TARGETS.items()}, kind)
    high = m.channel_map({k: v[1] for k, v in m.FILTER_TARGETS.items()}, kind)
    capped = (fs == 200.0) & ((kind == "emg") | (channel == "snore"))
    return low, F.when(capped, F.lit(95.0)).otherwise(high)


def channel_processing(headers: DataFrame) -> DataFrame:
    """Header rows with every decision that needs no waveform."""
    band = h.prefilter_band(F.col("prefilter"))
    low, high = supplement_band(F.col("channel"), F.col("fs"))
    s, e, p, d = m.CHANNEL_STATUS, m.EFFECTIVE_FILTER, m.PROCESS_RESULT, m.COVERAGE_DETECTION
    df = (headers.withColumn("channel_status_code", channel_status())
          .withColumn("_band", band)
          .withColumn("_live", F.col("channel_status_code") == s["AVAILABLE"])
          .withColumn("_unknown", F.col("_live") & (F.col("channel") != "spo2")
                      & h.filter_unknown(F.col("_band")))
          .withColumn("_unsupported", F.col("_unknown") & (high >= F.col("fs") / 2)))
    excluded = F.col("channel_status_code") == s["PROFILE_EXCLUDED"]
    rate_known = (F.col("read_error").isNull() & F.col("source_present")
                  & rate_valid(F.col("fs")) & F.col("source_samples").isNotNull())
    live = F.col("_live")
    effective = (F.when(excluded, F.lit(e["PROCESSING_SKIPPED_PROFILE_EXCLUDED"]))
                 .when(~live, F.lit(e["NOT_EVALUATED"]))
                 .when(F.col("_unsupported"), F.lit(e["REAPPLY_FAILED"]))
                 .when(F.col("_unknown"), F.lit(e["SOURCE_FILTER_REAPPLY"]))
                 .when(F.col("channel") == "spo2", F.lit(e["FILTER_NOT_REQUIRED"]))
                 .otherwise(F.lit(e["SOURCE_FILTER_AS_RECORDED"])))
    reapply = (F.when(excluded, F.lit(p["NOT_RUN_PROFILE_EXCLUDED"]))
               .when(~live, F.lit(p["NOT_EVALUATED"]))
               .when(F.col("_unsupported"), F.lit(p["UNSUPPORTED"]))
               .when(F.col("_unknown"), F.lit(p["SUCCESS"]))
               .otherwise(F.lit(p["NOT_REQUIRED"])))
    resample = (F.when(excluded, F.lit(p["NOT_RUN_PROFILE_EXCLUDED"]))
                .when(~live | F.col("_unsupported"), F.lit(p["NOT_EVALUATED"]))
                .when(F.col("fs") == float(m.FS), F.lit(p["NOT_REQUIRED"]))
                .otherwise(F.lit(p["SUCCESS"])))
    applied = F.col("_unknown") & ~F.col("_unsupported")
    return df.select(
        *headers.columns, "channel_status_code",
        (F.col("channel_status_code") == s["AVAILABLE"]).alias("channel_available"),
        F.when(rate_known, F.lit(d["LENGTH_ONLY"])).otherwise(F.lit(d["NOT_EVALUATED"]))
        .alias("coverage_detection"),
        F.when(live, h.source_filter_state(F.col("channel"), F.col("_band")))
        .otherwise(F.lit(0)).alias("source_filter_state"),
        F.when(live, h.filter_relation(F.col("channel"), F.col("_band")))
        .otherwise(F.lit(0)).alias("filter_relation"),
        effective.alias("effective_filter_state"),
        reapply.alias("filter_reapply_result"),
        resample.alias("resample_result"),
        F.when(live, F.col("_band")["hp"]).alias("source_hp_hz"),
        F.when(live, F.col("_band")["lp"]).alias("source_lp_hz"),
        F.coalesce(F.when(applied, low), F.when(live, F.col("_band")["hp"])).alias("effective_hp_hz"),
        F.coalesce(F.when(applied, high), F.when(live, F.col("_band")["lp"])).alias("effective_lp_hz"),
        F.when(live, F.get(h.notch_list(F.col("prefilter")), 0)).alias("notch_hz"),
        F.when(applied, low).alias("band_low"), F.when(applied, high).alias("band_high"),
        F.col("_unsupported").alias("filter_unsupported"))


def run_states(fs: Column, unknown: Column, unsupported: Column, runs: Column,
               failures: Column) -> dict[str, Column]:
    """Processing results once the numbers of processed and failed runs are known."""
    e, p = m.EFFECTIVE_FILTER, m.PROCESS_RESULT
    some, broken = runs > 0, failures > 0
    return {
        "effective_filter_state": (
            F.when(unsupported, F.lit(e["REAPPLY_FAILED"]))
            .when(unknown & some, F.lit(e["SOURCE_FILTER_REAPPLY"]))
            .when(unknown, F.lit(e["REAPPLY_FAILED"]))
            .otherwise(F.lit(e["SOURCE_FILTER_AS_RECORDED"]))),
        "filter_reapply_result": (
            F.when(unsupported, F.lit(p["UNSUPPORTED"]))
            .when(~unknown, F.lit(p["NOT_REQUIRED"]))
            .when(some & broken, F.lit(p["PARTIAL"]))
            .when(some, F.lit(p["SUCCESS"])).otherwise(F.lit(p["FAILED"]))),
        "resample_result": (
            F.when(unsupported, F.lit(p["NOT_EVALUATED"]))
            .when(some & broken, F.lit(p["PARTIAL"]))
            .when(~some, F.lit(p["FAILED"]))
            .when(fs == float(m.FS), F.lit(p["NOT_REQUIRED"])).otherwise(F.lit(p["SUCCESS"]))),
    }
