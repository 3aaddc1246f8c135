"""Event-store semantics in batch: idempotent admission, buckets, rate limits, versions, diffs, queues, ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from emberline.storage import unused

BUCKET_SECONDS = 300


def admit(events: DataFrame, key: Column, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """Events with admitted true for the first of each idempotency key that `known` (idempotency_key) does not hold."""
    rows = events.withColumn("idempotency_key", key)
    first = F.row_number().over(Window.partitionBy("idempotency_key").orderBy(order)) == 1
    rows = rows.withColumn("admitted", first)
    if known is None:
        return rows
    before = unused(rows, "seen")
    seen = known.select("idempotency_key").distinct().withColumn(before, F.lit(True))
    return rows.join(seen, "idempotency_key", "left").withColumn("admitted", F.col("admitted") & F.col(before).isNull()).drop(before)


def bucket_start(time: Column, seconds: int = BUCKET_SECONDS) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(time) / seconds) * seconds)


def incident_buckets(alerts: DataFrame, tenant: str = "default") -> DataFrame:
    """Alerts grouped by fingerprint, service and 5-minute bucket into incidents, numbered by first arrival from 100001.

    Numbers come from ranks within hours and the hours' running totals, so no task ranks all incidents.
    """
    key = F.sha2(F.concat_ws("|", "fingerprint", "service", F.date_format(bucket_start(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ssxxx"), F.lit(tenant)), 256)
    found = alerts.withColumn("bucket_key", key).groupBy("bucket_key").agg(
        F.min(F.struct("ts", "ordinal")).alias("first"), F.count(F.lit(1)).alias("events"), F.first("service").alias("service"), F.max("ts").alias("last_at")
    )
    found = found.select("bucket_key", "events", "service", F.col("first.ts").alias("first_at"), F.col("first.ordinal").alias("ordinal"), "last_at")
    found = found.withColumn("hour", F.date_trunc("hour", "first_at"))
    per_hour = found.groupBy("hour").agg(F.count(F.lit(1)).alias("c"))
    before = per_hour.select("hour", (F.sum("c").over(Window.orderBy("hour")) - F.col("c")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("hour").orderBy("first_at", "ordinal"))
    return found.join(before, "hour").select("bucket_key", "service", "events", "first_at", "last_at", (F.lit(100000) + F.col("before") + rank).alias("incident_number"))


def rate_limited(requests: DataFrame, key: str, seconds: int, limit: int) -> DataFrame:
    """Requests with allowed and retry_after (seconds) under a fixed-window limit."""
    start = F.floor(F.unix_seconds("ts") / seconds) * seconds
    order = Window.partitionBy(key, "window_start").orderBy("ts", "ordinal")
    rows = requests.withColumn("window_start", start).withColumn("position", F.row_number().over(order))
    return rows.withColumn("allowed", F.col("position") <= limit).withColumn(
        "retry_after", F.when(~F.col("allowed"), F.col("window_start") + seconds - F.unix_seconds("ts")).otherwise(0)
    )


def versions(records: DataFrame, key: str, order: list[str], content: list[str]) -> DataFrame:
    """Versions of each key: a record that repeats the content before it is reused, any other supersedes it."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    by_key = Window.partitionBy(key).orderBy(order)
    rows = records.withColumn("content_sha256", digest).withColumn("before", F.lag("content_sha256").over(by_key))
    changed = rows.filter(F.col("before").isNull() | (F.col("before") != F.col("content_sha256")))
    return changed.withColumn("version", F.row_number().over(by_key)).withColumnRenamed("before", "supersedes")


def revision_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """added, removed, changed or unchanged for every key of two revisions."""
    a, b = old.select(key, F.col(digest).alias("old_digest")), new.select(key, F.col(digest).alias("new_digest"))
    change = (
        F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed")
        .when(F.col("old_digest") == F.col("new_digest"), "unchanged").otherwise("changed")
    )
    return a.join(b, key, "full_outer").withColumn("change", change)


def coalesced_jobs(events: DataFrame, wait_seconds: int = 5, most_seconds: int = 30) -> DataFrame:
    """Jobs that collect an incident's events while they wait: a job is due `wait` after its last event but never later than `most` after its first,
    and an event that comes after that opens a new one. The payload of the last event counts.

    Where a job ends depends on where it began, so each incident's events are gone through in order, as a stream of sorted batches.
    """
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, job, first, last = None, 0, 0, 0
        for batch in batches:
            out = []
            for incident, at in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if job == 0 or incident != now:
                    now, job, first = incident, 1, at
                elif at > min(last + wait_seconds * 1_000_000, first + most_seconds * 1_000_000):
                    job, first = job + 1, at
                last = at
                out.append(job)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=["incident", "ts", "ordinal", "job"])

    ordered = events.select("incident", "ts", "ordinal", F.unix_micros("ts").alias("at")).repartition("incident").sortWithinPartitions("incident", "at", "ordinal")
    rows = ordered.mapInArrow(numbered, StructType([*(ordered.schema[c] for c in ("incident", "ts", "ordinal")), StructField("job", LongType())]))
    jobs = rows.groupBy("incident", "job").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("created"), F.max("ts").alias("last"), F.max_by("ordinal", F.struct("ts", "ordinal")).alias("payload"))
    due = F.least(F.unix_seconds("last") + wait_seconds, F.unix_seconds("created") + most_seconds)
    return jobs.withColumn("available_at", due)


def queue_snapshot(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "leased", "completed", "dead_letter")],
        F.max(F.when(F.col("status") == "pending", F.unix_seconds(now) - F.unix_seconds("created"))).alias("oldest_pending_seconds"),
        F.count_distinct(F.when(F.col("status") == "leased", F.col("worker"))).alias("active_workers"),
    )


def usage_ledger(calls: DataFrame, input_price: float, output_price: float, budget: float) -> DataFrame:
    """Calls, tokens and cost of each incident, and whether the budget (in currency) is left."""
    return calls.groupBy("incident").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    ).withColumn("cost", F.round((F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1e6, 8)).withColumn("within_budget", F.col("cost") <= budget)
