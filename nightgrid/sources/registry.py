"""Named dataset readers: functions that return the core DataFrames of a release."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Release(NamedTuple):
    """What every reader provides: identity, records and lazily evaluated tables."""

    name: str
    version: str
    epoch_seconds: float
    channels: DataFrame
    records: DataFrame
    signals: DataFrame
    tasks: Callable[[str], DataFrame]


BUILT_IN = "nights"
_READERS: dict[str, Callable[..., Release]] = {}


def register_reader(name: str, factory: Callable[..., Release]) -> None:
    if not name or name == BUILT_IN or name in _READERS:
        raise ValueError(f"reader name is empty, built in or taken: {name!r}")
    _READERS[name] = factory


def open_release(spark: SparkSession, name: str, *args, **options) -> Release:
    if name == BUILT_IN:
        from nightgrid.sources.published import read_release
        return read_release(spark, *args, **options)
    if name not in _READERS:
        raise ValueError(f"unknown dataset reader {name!r}")
    return _READERS[name](spark, *args, **options)
