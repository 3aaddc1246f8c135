"""The work queue in batch: capacity, leases and retries from their history, replays, revisions, drafts, nonces; alerts as they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.storage import unused

MAX_ATTEMPTS, RETRY_SECONDS = 3, 30


def capacity_gate(arrivals: DataFrame, active: DataFrame, key: str, most: int) -> DataFrame:
    """Arrivals with `accepted`: those that fit, in order of arrival, beside the key's active jobs. `active`: key, n. `ordinal` is unique in a key.

    Each task ranks and sends the first `most` arrivals of a key only; the others need no place to be refused.
    """
    place, n, fits = (unused(arrivals, c) for c in ("place", "n", "fits"))
    first = arrivals.select(key, "ordinal", F.row_number().over(Window.partitionBy(key).orderBy("ts", "ordinal")).alias(place)).filter(F.col(place) <= most)
    taken = first.join(active.select(key, F.col("n").alias(n)), key, "left").filter(F.col(place) <= most - F.coalesce(n, F.lit(0))).select(key, "ordinal", F.lit(True).alias(fits))
    same = F.col(f"a.{key}").eqNullSafe(F.col(f"t.{key}")) & (F.col("a.ordinal") == F.col("t.ordinal"))
    return arrivals.alias("a").join(taken.alias("t"), same, "left").select("a.*", F.coalesce(F.col(f"t.{fits}"), F.lit(False)).alias("accepted"))


def job_outcomes(history: DataFrame, attempts: int = MAX_ATTEMPTS, delay: int = RETRY_SECONDS) -> DataFrame:
    """State of each job from its outcomes (job, ts, ordinal, outcome: completed or failed).

    The first completion ends a job unless as many failures came before it as there are attempts; then it is a dead letter. Otherwise it
    waits for its next attempt, `delay` seconds after the last failure.
    """
    order = Window.partitionBy("job").orderBy("ts", "ordinal")
    rows = history.withColumn("failures", F.count_if(F.col("outcome") == "failed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ended = F.when((F.col("outcome") == "completed") & (F.col("failures") < attempts), "completed").when((F.col("outcome") == "failed") & (F.col("failures") == attempts), "dead_letter")
    found = rows.withColumn("ended", ended).groupBy("job").agg(
        F.min_by("ended", F.when(F.col("ended").isNotNull(), F.struct("ts", "ordinal"))).alias("ended"), F.max("failures").alias("failures"),
        F.max(F.when(F.col("outcome") == "failed", F.unix_seconds("ts"))).alias("failed_at"), F.max_by("ordinal", F.struct("ts", "ordinal")).alias("payload"),
    )
    status = F.coalesce("ended", F.lit("pending"))
    return found.select("job", status.alias("status"), F.least("failures", F.lit(attempts)).alias("failures"), F.when(status == "pending", F.col("failed_at") + delay).alias("available_at"), "payload")


def replays(jobs: DataFrame) -> DataFrame:
    """A new pending job for each dead letter, with the latest payload."""
    return jobs.filter("status = 'dead_letter'").select(F.concat(F.lit("replay-"), F.col("job").cast("string")).alias("job"), F.col("job").alias("replay_of"), F.lit("pending").alias("status"), "payload")


def revisions(analyses: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Analyses of each key numbered from 1, with the head marked."""
    up = Window.partitionBy(key).orderBy(order)
    return analyses.withColumn("revision", F.row_number().over(up)).withColumn("is_head", F.lead(F.lit(1)).over(up).isNull())


def drafts(texts: DataFrame, key: str, order: list[str], body: str) -> DataFrame:
    """Every draft of each key as a version with its SHA-256 and that of the one it supersedes; equal drafts are appended too."""
    up = Window.partitionBy(key).orderBy(order)
    rows = texts.withColumn("sha256", F.sha2(F.coalesce(body, F.lit("")), 256))
    return rows.withColumn("version", F.row_number().over(up)).withColumn("supersedes", F.lag("sha256").over(up))


def nonce_guard(calls: DataFrame, window_seconds: int) -> DataFrame:
    """Calls (nonce, signed_at, ts, ordinal) with `verdict`: a missing or long nonce, a time outside the window, a nonce used before, or accepted."""
    bounded = F.coalesce(F.length("nonce").between(1, 128), F.lit(False))
    near = F.abs(F.unix_micros("ts") - F.unix_micros("signed_at")) <= window_seconds * 1_000_000
    usable = unused(calls, "usable")
    rows = calls.withColumn(usable, bounded & F.coalesce(near, F.lit(False)))
    # Only usable calls are ranked by nonce; the others, however many share one, are spread by their ordinals.
    key = F.when(F.col(usable), F.col("nonce")).otherwise(F.col("ordinal").cast("string"))
    first = F.row_number().over(Window.partitionBy(F.col(usable), key).orderBy("ts", "ordinal")) == 1
    verdict = F.when(~bounded, "invalid_signature_nonce").when(~F.col(usable), "signature_timestamp_outside_window").when(~first, "replayed_signature_nonce").otherwise("accepted")
    return rows.withColumn("verdict", verdict).drop(usable)


def _first(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def normalize_alerts(alerts: DataFrame, environment: str = "production") -> DataFrame:
    """Alerts (service, environment, severity, alertname, message, status, labels and annotations maps) with fields filled from labels and annotations; texts are redacted."""
    label = lambda name: F.try_element_at("labels", F.lit(name))
    note = lambda name: F.try_element_at("annotations", F.lit(name))
    fields = {
        "service": _first(F.col("service"), label("service"), label("job"), F.lit("unknown")),
        "environment": _first(F.col("environment"), label("environment"), label("env"), F.lit(environment)),
        "severity": _first(F.col("severity"), label("severity"), F.lit("unknown")),
        "alertname": _first(F.col("alertname"), label("alertname"), F.col("service"), F.lit("unknown")),
        "message": text.redact_message(_first(F.col("message"), note("summary"), note("description"))),
        "status": _first(F.col("status"), F.lit("firing")),
    }
    return alerts.select(*[fields[c].alias(c) if c in fields else F.col(c) for c in alerts.columns])


def alarm_alerts(events: DataFrame, mapping: DataFrame, source: str = "aws.cloudwatch", kind: str = "CloudWatch Alarm State Change") -> DataFrame:
    """Alarm events (source, kind, alarm, state, reason) to alerts by a mapping that the owner keeps (alarm, service, environment, severity); `error_code` where an event is none."""
    found = events.join(F.broadcast(mapping.withColumn("mapped", F.lit(True))), "alarm", "left")  # configuration
    state = F.upper(F.trim("state"))
    code = (
        F.when((F.col("source") != source) | (F.col("kind") != kind), "unsupported_cloudwatch_event").when(F.col("mapped").isNull(), "unsupported_cloudwatch_alarm")
        .when(_first(F.col("service")).isNull() | _first(F.col("environment")).isNull(), "invalid_cloudwatch_mapping").when(~F.coalesce(state.isin("ALARM", "OK"), F.lit(False)), "unsupported_cloudwatch_state")
    )
    status = F.when(code.isNull(), F.when(state == "ALARM", "firing").otherwise("resolved"))
    return found.select(*events.columns, "service", "environment", _first(F.col("severity"), F.lit("unknown")).alias("severity"), status.alias("status"), code.alias("error_code"))
