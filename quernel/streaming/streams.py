"""Structured Streaming forms of the routing operators."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quernel.plans.model import Config
from quernel.streaming.routing import matches_stream


def read_folder(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of one table's Parquet files in a folder, with the table's own schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def routed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each event with each subscription it goes to."""
    return matches_stream(events, subscriptions)


def deduplicated(events: DataFrame, key: str, at: str, within: str = "10 minutes") -> DataFrame:
    """The first event of each key within a time; state is kept that long only. NTZ times are cast."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def round_robin(events: DataFrame, members: dict[str, list[str]], group: str, order: str, schema: str, out: str = "member") -> DataFrame:
    """events with member, dealt in turn within each group; the counter is state, so turns go on over batches.

    schema is the DDL of events. Members are taken in order; a group without any drops its events.
    """
    ranks = {g: sorted(m) for g, m in members.items()}

    def deal(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (turn,) = state.get if state.exists else (0,)
        mine = ranks.get(key[0], [])
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        if mine:
            rows[out] = [mine[(turn + i) % len(mine)] for i in range(len(rows))]
            state.update((turn + len(rows),))
            yield rows

    return events.groupBy(group).applyInPandasWithState(deal, f"{schema}, {out} string", "turn bigint", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs what is there now to Parquet, exactly once over restarts."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_outbox(stream: DataFrame, deliver, dead_letters: str, checkpoint: str, retries: int = Config.outbox_retries, pause_s: float = Config.outbox_interval_s) -> None:
    """Hands each batch to deliver(frame, batch_id), again after a pause where that fails; a batch that fails `retries`
    times goes to the dead letters.

    The checkpoint replays a batch that was cut short, so deliver must be idempotent per batch_id.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        for turn in range(retries):
            try:
                return deliver(batch, batch_id)
            except Exception:  # noqa: BLE001 - whatever the sink raises counts as a failed attempt
                if turn < retries - 1:
                    time.sleep(pause_s)
                else:
                    batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(dead_letters)

    stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
