"""Text functions for channel headers: names, units and filter descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightgrid import model as m
from nightgrid.model import channel_map as lookup

# The patterns that decide which filter descriptions are readable.
BAND_PATTERN = r"(?i)\b(HP|LP)\s*:?\s*([-+]?\d+(?:\.\d+)?)\s*Hz"
NOTCH_PATTERN = r"(?i)\b(?:N|NOTCH)\s*:?\s*([-+]?\d+(?:\.\d+)?)\s*Hz"
FIRST_PATTERN = r"(?i)\b{key}\s*:?\s*([-+]?\d+(?:\.\d+)?)\s*Hz"


# The characters Python's \s matches. Java's \s knows only the ASCII ones.
WHITE_SPACE = ("\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def channel_name(raw: Column) -> Column:
    """Lower case, dashes unified, white space dropped, underscore to dash.

    One character table does it all: characters without a counterpart are deleted.
    """
    return F.translate(F.lower(raw), "–—_" + WHITE_SPACE, "---")


def canonical_channel(normalised: Column) -> Column:
    table = {alias: name for name, aliases in m.CHANNEL_ALIASES.items() for alias in aliases}
    return F.coalesce(lookup(table, normalised), F.lit(""))


def alias_rank(normalised: Column) -> Column:
    table = {a: i for aliases in m.CHANNEL_ALIASES.values() for i, a in enumerate(aliases)}
    return F.coalesce(lookup(table, normalised), F.lit(10_000))


def unit_name(unit: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.translate(text, "µμ", "uu")


def unit_scale(unit: Column) -> Column:
    return lookup(m.UNIT_SCALE, unit_name(unit))


def prefilter_band(text: Column) -> Column:
    """Strict reading: one HP and one LP value, repeats must agree, else NULL."""
    src = F.coalesce(text, F.lit(""))
    keys = F.regexp_extract_all(src, F.lit(BAND_PATTERN), F.lit(1))
    nums = F.regexp_extract_all(src, F.lit(BAND_PATTERN), F.lit(2))
    pairs = F.zip_with(keys, nums, lambda k, n: F.struct(
        F.upper(k).alias("k"), (n.cast("double") + F.lit(0.0)).alias("n")))

    def values(key: str) -> Column:
        return F.array_distinct(F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: p["n"]))

    hp, lp = values("HP"), values("LP")
    ok = ((F.size(hp) == 1) & (F.size(lp) == 1)
          & F.get(hp, 0).between(0.0, 1e308) & F.get(lp, 0).between(0.0, 1e308))
    return F.when(ok, F.struct(F.get(hp, 0).alias("hp"), F.get(lp, 0).alias("lp")))


def notch_list(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NOTCH_PATTERN), F.lit(1))
    return F.transform(found, lambda n: n.cast("double"))


def prefilter_first(text: Column) -> dict[str, Column]:
    """Lenient reading: first HP, LP and N match, each on its own."""
    src = F.coalesce(text, F.lit(""))
    out = {}
    for name, key in (("hp_hz", "HP"), ("lp_hz", "LP"), ("notch_hz", "N")):
        hit = F.regexp_extract(src, FIRST_PATTERN.format(key=key), 1)
        out[name] = F.when(hit != "", hit.cast("double"))
    out["filter_parse_ok"] = (src != "") & F.coalesce(
        out["hp_hz"], out["lp_hz"], out["notch_hz"]).isNotNull()
    return out


def filter_unknown(band: Column) -> Column:
    return band.isNull() | ((band["hp"] == 0.0) & (band["lp"] == 0.0))


def filter_relation(channel: Column, band: Column) -> Column:
    """Recorded band against the target band of the channel kind."""
    kind = m.kind_column(channel)
    low = lookup({k: v[0] for k, v in m.FILTER_TARGETS.items()}, kind)
    high = lookup({k: v[1] for k, v in m.FILTER_TARGETS.items()}, kind)
    narrower = (band["hp"] > low) | (band["lp"] < high)
    wider = (band["hp"] < low) | (band["lp"] > high)
    r = m.FILTER_RELATION
    return (F.when(channel == "spo2", F.lit(r["NOT_REQUIRED"]))
            .when(filter_unknown(band), F.lit(r["UNKNOWN"]))
            .when(narrower & wider, F.lit(r["MIXED"]))
            .when(narrower, F.lit(r["SOURCE_NARROWER"]))
            .when(wider, F.lit(r["SOURCE_WIDER"]))
            .otherwise(F.lit(r["MATCH"])))


def source_filter_state(channel: Column, band: Column) -> Column:
    s = m.FILTER_STATE
    return (F.when(channel == "spo2", F.lit(s["NOT_EVALUATED"]))
            .when(filter_unknown(band), F.lit(s["SOURCE_FILTER_UNKNOWN"]))
            .otherwise(F.lit(s["SOURCE_FILTER_EXPLICIT"])))


def path_key(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def path_is_safe(key: Column, suffix: str = ".h5") -> Column:
    """Relative, stays below the root, and ends in the published suffix."""
    absolute = key.rlike(r"^(/|[A-Za-z]:)")
    # "." and empty parts do not move; every ".." must be paid for by an earlier real part.
    steps = F.filter(F.split(key, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"),
            F.least(acc["low"], acc["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")),
        lambda acc: acc["low"])
    return ~absolute & (depth >= 0) & key.endswith(suffix)
