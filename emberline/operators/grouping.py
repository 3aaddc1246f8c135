"""Label aggregation: logs to evidence groups, with buckets, bursts, dimensions, lineage and samples.

Every function takes all incidents at once; `incident` is the first grouping key throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.storage import unused

GROUP_KEYS = ["service", "level", "error_type", "event_name", "status_code", "signature"]
#: Fixed values.
DIMENSIONS = ["route", "dependency", "region", "pod", "host", "status_code", "workload_id", "execution_id"]
#: What a record says of its origin, and the set of it that a group has.
LINEAGE_SETS = {
    "source": "sources", "query_id": "source_query_ids", "source_schema_id": "source_schema_ids", "connector_version": "connector_versions", "clock_quality": "clock_qualities",
    "source_timestamp_quality": "source_timestamp_qualities", "timestamp_ordering_scope": "timestamp_ordering_scopes",
}
BURST_SCHEMA = "event-burst/v1"


def with_signature(logs: DataFrame) -> DataFrame:
    """Add `incident` (the UTC day, where the input has none) and `signature`, the message's fingerprint."""
    if "incident" not in logs.columns:
        logs = logs.withColumn("incident", F.date_format("ts", "yyyy-MM-dd"))
    shape = unused(logs, "shape")
    own = F.col("error_fingerprint") if "error_fingerprint" in logs.columns else F.lit(None).cast("string")
    shaped = text.with_fingerprint(logs, shape, "message")
    return shaped.withColumn("signature", F.coalesce(F.nullif(own, F.lit("")), F.col(shape))).drop(shape)


def event_id(keys: list[Column]) -> Column:
    return text.scoped_id("log-", F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]), 12)


def label_groups(logs: DataFrame) -> DataFrame:
    """One row for each incident and key: counts, first and last record (ties: first arrival), dimensions, lineage.

    One shuffle: everything is an aggregate over the group keys, combined before it.
    """
    return signed_groups(with_signature(logs))


def signed_groups(signed: DataFrame) -> DataFrame:
    """label_groups of records that have their signature."""
    keys = ["incident", *GROUP_KEYS]
    order = F.struct("ts", "ordinal")
    return (
        signed.groupBy(keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.min_by("message", order).alias("example_message"),
            F.max_by("message", F.struct("ts", -F.col("ordinal"))).alias("last_message"),
            F.min("ordinal").alias("ordinal"),
            F.count_distinct("pod").alias("pods"),
            F.array_sort(F.collect_set("host")).alias("hosts"),
        )
        .withColumn("event_id", event_id([F.col(k) for k in keys]))
    )


def honesty(groups: DataFrame, total_of: DataFrame, truncated: bool) -> DataFrame:
    """Say what a group's count stands for: exact, or the part of a sample. `total_of`: (incident, total)."""
    return groups.join(total_of, "incident", "left").select(
        groups["*"],
        F.lit(not truncated).alias("count_is_exact"),
        F.lit("sampled" if truncated else "window").alias("count_scope"),
        F.round(F.least(F.col("n") / F.col("total"), F.lit(1.0)), 4).alias("sampled_fraction"),
    )


def minute_buckets(logs: DataFrame) -> DataFrame:
    """(incident, event_id, bucket, n): records a minute; records without time are in bucket "unknown"."""
    keys = ["incident", *GROUP_KEYS]
    bucket = F.coalesce(F.date_format(F.date_trunc("minute", F.col("ts")), "yyyy-MM-dd'T'HH:mm'Z'"), F.lit("unknown"))
    return (
        with_signature(logs)
        .groupBy(*keys, bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("incident", event_id([F.col(k) for k in keys]).alias("event_id"), "bucket", "n")
    )


def burst_summary(logs: DataFrame) -> DataFrame:
    """Onset, end, duration, repetitions and the peak minute (ties: the earliest) of each group."""
    keys = ["incident", *GROUP_KEYS]
    minute = F.date_trunc("minute", F.col("ts"))
    per_minute = (
        with_signature(logs).groupBy(*keys, minute.alias("minute")).agg(F.count(F.lit(1)).alias("c"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    )
    return (
        per_minute.groupBy(keys)
        .agg(
            F.min("a").alias("onset"), F.max("b").alias("end"), F.sum("c").alias("repetitions"),
            F.count(F.col("minute")).alias("distinct_buckets"),
            F.max_by("minute", F.struct("c", -F.unix_seconds("minute"))).alias("peak_bucket"), F.max("c").alias("peak_count"),
        )
        .select(
            "incident", event_id([F.col(k) for k in keys]).alias("event_id"), "onset", "end",
            F.round((F.unix_micros("end") - F.unix_micros("onset")) / 1e6, 3).alias("duration_seconds"),
            "repetitions", "distinct_buckets", "peak_bucket", "peak_count",
        )
    )


def dimension_top(logs: DataFrame, dimensions: list[str] = DIMENSIONS, keep: int = 5) -> DataFrame:
    """Distinct values of each dimension of a group and its most frequent ones (ties: by value)."""
    keys = ["incident", *GROUP_KEYS]
    stacked = with_signature(logs).select(
        *keys, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("d")
    )
    counted = stacked.select(*keys, "d.*").filter("value IS NOT NULL AND value <> ''").groupBy(*keys, "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = Window.partitionBy(*keys, "dimension").orderBy(F.desc("n"), "value")
    return (
        counted.withColumn("rank", F.row_number().over(ranked))
        .groupBy(*keys, "dimension")
        .agg(
            F.count(F.lit(1)).alias("unique_values"),
            F.array_sort(F.collect_list(F.when(F.col("rank") <= keep, F.struct("rank", "value", "n")))).alias("top"),
        )
        .select(
            "incident", event_id([F.col(k) for k in keys]).alias("event_id"), "dimension", "unique_values",
            F.array_join(F.transform("top", lambda t: F.concat(t["value"], F.lit("="), t["n"].cast("string"))), ",").alias("top_values"),
        )
    )


def lineage(logs: DataFrame) -> DataFrame:
    """Sorted distinct sets of what a group was seen in, and of the origins that its records name (columns of LINEAGE_SETS, where there are any)."""
    keys = ["incident", *GROUP_KEYS]
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit("")))), ",")
    origins = {name: found for name, found in LINEAGE_SETS.items() if name in logs.columns}
    return (
        with_signature(logs).groupBy(keys).agg(joined("pod").alias("pods"), joined("host").alias("hosts"), F.count_distinct("user_id").alias("users"), *[joined(c).alias(f) for c, f in origins.items()])
        .select("incident", event_id([F.col(k) for k in keys]).alias("event_id"), "pods", "hosts", "users", *origins.values())
    )


def first_messages(logs: DataFrame, keep: int = 3) -> DataFrame:
    """The first `keep` distinct messages of each group by arrival."""
    keys = ["incident", *GROUP_KEYS]
    distinct = with_signature(logs).groupBy(*keys, "message").agg(F.min("ordinal").alias("ordinal"))
    ranked = Window.partitionBy(keys).orderBy("ordinal")
    return (
        distinct.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= keep)
        .select("incident", event_id([F.col(k) for k in keys]).alias("event_id"), "rank", "message")
    )


def histogram(logs: DataFrame, minutes: int = 5, levels: tuple[str, ...] = ("error", "warn")) -> DataFrame:
    """Records of the given levels in epoch-aligned buckets, with a bar in proportion to the fullest."""
    width = 60 * minutes
    start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / width) * width)
    counted = logs.filter(F.col("level").isin(*levels) & F.col("ts").isNotNull()).groupBy(start.alias("bucket"), "level").agg(F.count(F.lit(1)).alias("n"))
    most = counted.agg(F.max("n").alias("most"))
    return counted.crossJoin(F.broadcast(most)).select("bucket", "level", "n", F.repeat(F.lit("█"), F.floor(F.col("n") * 40 / F.col("most")).cast("int")).alias("bar"))


def representative(groups: DataFrame, keep: int) -> DataFrame:
    """The `keep` most frequent groups of each incident (ties: first arrival)."""
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy("incident").orderBy(F.desc("n"), "ordinal"))).filter(F.col("rank") <= keep)
