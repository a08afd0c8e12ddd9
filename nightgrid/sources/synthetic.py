"""Deterministic synthetic signal source for smoke tests and demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightgrid import model as m


def synthetic_epochs(recordings: DataFrame, epochs: int = 2, sample_rate: int = 200,
                     epoch_seconds: int = 30, seed: int = 7) -> DataFrame:
    """Sines whose frequency is the channel's place in its group, plus small noise.

    Odd recordings have one epoch fewer and lose the last EEG channel (NaN). SpO2 is a slow
    level around 95. Noise is drawn per row from the seed, so a row is repeatable alone.
    """
    spark = recordings.sparkSession
    places = {c: i + 1 for cs in m.GROUP_CHANNELS.values() for i, c in enumerate(cs)}
    dims = m.channel_dimension(spark).withColumn("_hz", m.channel_map(places, F.col("channel")))
    odd = F.col("recording_no") % 2 == 1
    count = F.greatest(F.lit(1), F.lit(epochs) - F.when(odd, 1).otherwise(0))
    rows = (recordings.withColumn("epoch_in_record", F.explode(F.sequence(F.lit(0), count - 1)))
            .crossJoin(F.broadcast(dims))  # fifteen rows
            .withColumn("available", ~(odd & (F.col("channel") == m.GROUP_CHANNELS["eeg"][-1]))))
    size = sample_rate * epoch_seconds
    time = lambda i: i.cast("double") / F.lit(float(sample_rate))
    turn = F.lit(2 * 3.141592653589793)
    noise = lambda i: (F.xxhash64(F.lit(seed), "recording_no", "channel_idx", "epoch_in_record", i)
                       / F.lit(float(2**63))) * F.lit(0.05 * 3**0.5)
    wave = lambda i: (F.when(F.col("channel") == "spo2", 95 + 2 * F.sin(turn * 0.025 * time(i) + F.col("recording_no")))
                      .when(~F.col("available"), F.lit(float("nan")))
                      .otherwise(F.sin(turn * F.col("_hz") * time(i)) + noise(i)))
    samples = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: wave(i).cast("float"))
    return (rows.withColumn("samples", samples).withColumn("sample_rate_hz", F.lit(float(sample_rate)))
            .withColumn("epoch_start_offset_ns",
                        F.col("epoch_in_record").cast("bigint") * F.lit(epoch_seconds * 1_000_000_000))
            .drop("_hz"))
