"""Incremental publication: new ledger rows arrive as files, each run publishes what is pending.

The batch functions do the work; the stream only remembers which ledger files were seen. A
micro-batch that is replayed after a failure publishes nothing twice, because committed
shards are skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from nightgrid.operators import release


def publish_arrivals(spark: SparkSession, ledger_path: str, ledger_schema: str, root: str, checkpoint: str,
                     build: Callable[[DataFrame], dict[str, DataFrame]],
                     digest_columns: dict[str, Sequence[str]] | None = None) -> StreamingQuery:
    """Publish every shard named by newly arrived ledger files, then stop.

    A ledger file lists whole shards (one row per recording with its shard_id); ``build``
    turns its rows into the tables of those shards.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            release.publish(root, build(batch), digest_columns)

    return (spark.readStream.schema(ledger_schema).parquet(ledger_path).writeStream
            .foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
