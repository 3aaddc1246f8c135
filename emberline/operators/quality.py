"""Record quality: time normalisation, required fields, quarantine and deduplication with conserved counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import text

#: Canonical field <- candidate labels in order of preference, by schema in order of detection.
SCHEMAS = {
    "loki_default": {
        "service": ["service", "app", "kubernetes_container_name", "container_name"],
        "level": ["level", "severity", "log_level", "loglevel"],
        "error_type": ["error_type", "error_code", "exception_class", "err_type"],
        "trace_id": ["trace_id", "traceId", "trace", "x-trace-id"],
        "user_id": ["user_id", "userId", "uid"],
        "request_id": ["request_id", "requestId", "req_id", "x-request-id"],
        "commit_sha": ["commit", "commit_sha", "git_sha", "version"],
        "pod": ["pod", "pod_name", "kubernetes_pod_name"],
        "host": ["host", "hostname", "node"],
        "route": ["route", "http_route", "path_template", "handler"],
        "dependency": ["dependency", "upstream_service", "peer_service", "target_service"],
        "region": ["region", "cloud_region", "zone"],
        "event_name": ["event_name", "event", "log_event"],
        "error_fingerprint": ["error_fingerprint", "error_signature", "exception_fingerprint"],
        "status_code": ["status_code", "http_status_code", "code"],
        "workload_id": ["workload_id"],
        "execution_id": ["execution_id"],
    },
    "cloudwatch": {"service": ["logGroup", "serviceName", "service"], "level": ["level", "priority", "severity"]},
}
FUTURE_TOLERANCE_SECONDS = 300


def detect_schema(labels: Column) -> Column:
    """The first schema that has any of its candidate labels; the default schema without one."""
    found = F.lit(None).cast("string")
    for name, fields in reversed(SCHEMAS.items()):
        names = sorted({c for candidates in fields.values() for c in candidates})
        found = F.when(F.arrays_overlap(F.map_keys(labels), F.array(*map(F.lit, names))), name).otherwise(found)
    return F.coalesce(found, F.lit("loki_default"))


def pick(labels: Column, candidates: list[str]) -> Column:
    """The first candidate label that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(labels, F.lit(c))), F.lit("")) for c in candidates])


def normalize_time(raw: Column, received: Column) -> tuple[Column, Column]:
    """(event time in UTC or null, quality): missing, invalid, future, assumed_utc or verified."""
    cleaned = F.nullif(F.trim(raw), F.lit(""))
    parsed = F.try_to_timestamp(F.regexp_replace(cleaned, "Z$", "+00:00"))
    zoned = F.rlike(cleaned, F.lit(r"(?:Z|[+-]\d{2}:?\d{2})$"))
    late = F.unix_micros(parsed) > F.unix_micros(received) + FUTURE_TOLERANCE_SECONDS * 1_000_000
    quality = F.when(cleaned.isNull(), "missing").when(parsed.isNull(), "invalid").when(late, "future").when(zoned, "verified").otherwise("assumed_utc")
    return F.when(quality.isin("verified", "assumed_utc"), parsed), quality


def normalize_logs(raw: DataFrame, source: str = "loki") -> DataFrame:
    """Raw records (timestamp, message, labels map, received, ordinal) to canonical ones with evidence ids.

    Labels are redacted, the schema is detected, each canonical field is picked by preference, levels are mapped
    to one vocabulary, and the record gets a content hash and an id, both of the canonical JSON of what was kept (for the id with source and type).
    """
    labels = text.redact_labels(F.col("labels"))
    when, quality = normalize_time(F.col("timestamp"), F.col("received"))
    schema = detect_schema(F.col("labels"))
    fields = []
    for field in SCHEMAS["loki_default"]:
        value = F.lit(None).cast("string")
        for name, candidates in SCHEMAS.items():
            if field in candidates:
                value = F.when(F.col("schema") == name, pick(F.col("clean"), candidates[field])).otherwise(value)
        fields.append((text.normalize_level(value) if field == "level" else value).alias(field))
    base = raw.withColumns({"schema": schema, "clean": labels, "event_time": when, "time_quality": quality, "clean_message": text.redact_message(F.col("message"))})
    canonical = base.select("ordinal", "schema", "event_time", "time_quality", F.col("timestamp").alias("original_time"), F.col("clean_message").alias("message"), *fields)
    fields = F.create_map(*[x for name in SCHEMAS["loki_default"] for x in (F.lit(name), F.col(name))])
    payload = F.struct(
        text.redact_data(text.sorted_map(fields)).alias("labels"), "message", F.lit(None).cast("string").alias("operation_feature"), "schema", F.col("original_time").alias("timestamp"))
    record = F.struct(payload.alias("payload"), F.lit(source).alias("source"), F.lit("log").alias("type"))
    return canonical.withColumn("integrity_hash", F.concat(F.lit("sha256:"), F.sha2(text.canonical_json(payload), 256))).withColumn(
        "evidence_id", text.scoped_id("evd-log-", text.canonical_json(record), 20))


def assess(records: DataFrame, required: list[str], identity: list[str], quarantine_missing_time: bool = False) -> DataFrame:
    """Flag every record: quarantined (with reason), duplicate, or usable. Order matters: duplicates come last.

    `records` has time_quality, ordinal and the named columns. The repeat of an identity is any but its first arrival
    among records that are not quarantined.
    """
    missing = F.lit(False)
    for name in required:
        missing = missing | F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")
    reason = F.when(missing, "missing_required")
    if quarantine_missing_time:
        reason = F.when(reason.isNull() & F.col("time_quality").isin("missing", "invalid", "future"), "unusable_time").otherwise(reason)
    flagged = records.withColumn("quarantine", reason).withColumn("identity", F.sha2(text.canonical(*[F.col(c) for c in identity]), 256))
    first = Window.partitionBy("identity", F.col("quarantine").isNull()).orderBy("ordinal")
    return flagged.withColumn("duplicate", F.col("quarantine").isNull() & (F.row_number().over(first) > 1)).withColumn(
        "usable", F.col("quarantine").isNull() & ~F.col("duplicate")
    )


def quality_report(assessed: DataFrame, keys: list[str], time: str = "ts") -> DataFrame:
    """Counters that conserve: input = usable + quarantined + duplicates. An empty input has no row."""
    return assessed.groupBy(keys).agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_if("usable").alias("usable_records"),
        F.count_if(F.col("quarantine").isNotNull()).alias("quarantined_records"),
        F.count_if("duplicate").alias("duplicate_records"),
        F.count_if(F.col("time_quality") == "assumed_utc").alias("assumed_utc"),
        F.count_if(F.col("time_quality") == "future").alias("future_times"),
        F.min(F.when(F.col("usable"), F.col(time))).alias("first_time"),
        F.max(F.when(F.col("usable"), F.col(time))).alias("last_time"),
    )


def status_of(count: Column, truncated: Column, stale: Column) -> Column:
    """Status of a source's answer: stale before partial before ok or empty; an unknown count is a failure."""
    return F.when(count.isNull(), "failed").when(stale, "stale").when(truncated, "partial").when(count > 0, "ok").otherwise("empty")
