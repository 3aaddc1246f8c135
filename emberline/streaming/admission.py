"""Streaming forms of admission, bucketing, rate limits and coalescing. Batch twins are in operators.store.

Watermarks bound the state: an event later than the watermark is dropped by deduplication and windows, as the batch
form would not; the tests run both over the same events in order and compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

FUTURE_TOLERANCE = "5 minutes"


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def reject_future(events: DataFrame, received: Column) -> DataFrame:
    """Events whose time is at most five minutes after they were received; put before the watermark, which they would move."""
    return events.filter(F.col("ts") <= received + F.expr(f"INTERVAL {FUTURE_TOLERANCE}"))


def admit(events: DataFrame, key: Column, late: str = "10 minutes") -> DataFrame:
    """The first event of each idempotency key within the watermark."""
    return events.withColumn("idempotency_key", key).withWatermark("ts", late).dropDuplicatesWithinWatermark(["idempotency_key"])


def bucket_counts(events: DataFrame, keys: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events in each tumbling bucket of the keys, once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(*keys, F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        *keys, F.col("w.start").alias("start"), "events")


def over_limit(events: DataFrame, key: str, width: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """Keys and windows with more than `limit` requests, and how many were over."""
    counted = bucket_counts(events, [key], width, late)
    return counted.filter(F.col("events") > limit).withColumn("rejected", F.col("events") - limit)


def coalesced(events: DataFrame, wait_seconds: int = 5, most_seconds: int = 30, late: str = "1 minute") -> DataFrame:
    """Jobs that collect an incident's events while they wait (event time): due `wait` after the last, but never later than `most` after the first; an event after that opens a new job.

    `events`: incident, ts, ordinal. State is one open job for each incident; it is closed by a later event or by the
    watermark. Groups are read in batches, so a hot incident needs no more memory than a batch.
    """
    schema = "incident string, created timestamp, last timestamp, events long, payload long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        held = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], *held)], columns=["incident", "created", "last", "events", "payload"])
            return
        for batch in batches:
            ordered = batch.sort_values(["ts", "ordinal"])
            for ts, ordinal in zip(ordered["ts"], ordered["ordinal"], strict=True):
                if held is not None and (ts > held[1] + pd.Timedelta(seconds=wait_seconds) or ts > held[0] + pd.Timedelta(seconds=most_seconds)):
                    done.append((key[0], *held))
                    held = None
                if held is None:
                    held = [ts.to_pydatetime(), ts.to_pydatetime(), 1, int(ordinal)]
                else:
                    held[1:] = [ts.to_pydatetime(), held[2] + 1, int(ordinal)]
        state.update(tuple(held))
        state.setTimeoutTimestamp(max(int(held[1].timestamp() * 1000) + wait_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=["incident", "created", "last", "events", "payload"])

    jobs = events.withWatermark("ts", late).groupBy("incident").applyInPandasWithState(
        run, schema, "created timestamp, last timestamp, events long, payload long", "append", GroupStateTimeout.EventTimeTimeout)
    due = F.least(F.unix_seconds("last") + wait_seconds, F.unix_seconds("created") + most_seconds)
    return jobs.withColumn("available_at", due)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there and stop; files and offsets are committed together by the file sink."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
