"""Column helpers with the numeric semantics the rules rely on."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for a real number. Spark orders NaN above everything, so rules test this first."""
    return F.coalesce(x.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def isclose(a: Column, b: Column, rel: float = 1e-9, tol: float = 0.0) -> Column:
    scale = F.greatest(F.abs(a), F.abs(b)) * F.lit(rel)
    return F.abs(a - b) <= F.greatest(scale, F.lit(tol))


def round_half_even(x: Column) -> Column:
    return F.rint(x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator/denominator as a double, NULL when there is nothing to divide by."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator.cast("double") * F.lit(100.0), denominator)


def tolerant_number(text: Column) -> Column:
    """Trimmed text as a double; unparsable or non-finite becomes NULL."""
    return finite_or_null(F.trim(text).try_cast("double"))


def tolerant_text(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def decode_text(value: Column) -> Column:
    return F.trim(F.decode(value, "UTF-8"))


def json_safe(array: Column) -> Column:
    """Non-finite members become JSON null."""
    return F.transform(array, finite_or_null)


def set_bit(code: int, evaluated_or_hit: Column) -> Column:
    """Bit of a rule code (1..7) when the condition holds, else 0."""
    if not 1 <= code <= 7:
        raise ValueError(f"rule code {code} has no bit")
    return F.when(evaluated_or_hit, F.lit(1 << (code - 1))).otherwise(F.lit(0))


def has_bit(flags: Column, code: int) -> Column:
    return flags.bitwiseAND(F.lit(1 << (code - 1))) != 0


def bit_union(parts: Sequence[Column]) -> Column:
    """Bits of different rules never overlap, so adding them is a union."""
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total.cast("int")


def epoch_offset_ns(epoch: Column, epoch_seconds: float = 30.0) -> Column:
    return epoch.cast("bigint") * F.lit(int(round(epoch_seconds * 1e9)))


def hash_unit(*parts: Column | str) -> Column:
    """Uniform [0,1) from the first eight bytes of a SHA-256, the same on every engine."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def _check_ratios(ratios: Sequence[float], rel: float, tol: float) -> None:
    if len(ratios) != 3 or any(r < 0 for r in ratios):
        raise ValueError("split ratios must be three nonnegative values")
    if not math.isclose(sum(ratios), 1.0, rel_tol=rel, abs_tol=tol):
        raise ValueError("split ratios must sum to 1")


def _split(unit: Column, ratios: Sequence[float]) -> Column:
    return (F.when(unit < F.lit(float(ratios[0])), "train")
            .when(unit < F.lit(float(sum(ratios[:2]))), "validation")
            .otherwise("test"))


def release_split(dataset: str, subject: Column, seed: int = 42,
                  ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> Column:
    """Stable subject split of a published release; the key includes the dataset name."""
    _check_ratios(ratios, 1e-9, 0.0)
    return _split(hash_unit(str(seed), dataset, subject.cast("string")), ratios)


def raw_split(subject: Column, seed: int = 42,
              ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> Column:
    """Stable subject split of raw recordings; the key is seed and subject only."""
    _check_ratios(ratios, 0.0, 1e-8)
    return _split(hash_unit(str(seed), subject.cast("string")), ratios)
