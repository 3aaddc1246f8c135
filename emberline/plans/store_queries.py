"""Queries with event-store semantics, parsing, alerts and search; batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import scoring, store
from emberline.plans.log_queries import shown
from emberline.sources import raw_logs
from emberline.sources.relations import duck, logs, read


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as alerts; a fingerprint is the error type."""
    return logs(spark, sf_dir).filter("event_name = 'error'").select("ordinal", "ts", "service", F.col("error_type").alias("fingerprint"), "user_id", "k")


def q_incident_bucketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.incident_buckets(alerts(spark, sf_dir))
    return found.select("bucket_key", "service", "events", shown("first_at"), shown("last_at"), "incident_number")


def q_idempotent_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the same service, fingerprint and 10 minutes are one; those of the first two days are known."""
    rows = alerts(spark, sf_dir)
    key = F.sha2(F.concat_ws("|", "service", "fingerprint", F.unix_seconds(store.bucket_start(F.col("ts"), 600)).cast("string")), 256)
    known = rows.filter("ts < '2024-01-03'").select(key.alias("idempotency_key"))
    found = store.admit(rows, key, ["ts", "ordinal"], known)
    return found.groupBy("service").agg(F.count(F.lit(1)).alias("sent"), F.count_if("admitted").alias("admitted"))


def q_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.rate_limited(logs(spark, sf_dir), "service", 600, 2)
    return found.groupBy("service").agg(F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed"), F.sum("retry_after").alias("retry_after"))


def q_evidence_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.versions(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return found.select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"), F.substring("content_sha256", 1, 12).alias("content"), F.substring("supersedes", 1, 12).alias("supersedes"))


def q_revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's status by last order before and after a date."""
    orders = read(spark, sf_dir, "orders")
    digest = F.max_by(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("digest")
    old, new = (orders.filter(c).groupBy("o_custkey").agg(digest) for c in ("o_orderkey % 2 = 0", "o_orderkey % 3 = 0"))
    return store.revision_diff(old, new, "o_custkey", "digest").groupBy("change").agg(F.count(F.lit(1)).alias("keys"), F.min("o_custkey").alias("first_key"))


def q_coalesced_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).select(F.col("service").alias("incident"), "ts", "ordinal")
    return store.coalesced_jobs(rows, 240, 600).select("incident", "job", "events", shown("created"), shown("last"), "payload", "available_at")


def q_lifecycle_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of users' histories against the legal transitions."""
    states = F.element_at(F.array(*map(F.lit, ["received", "collecting", "analyzing", "awaiting_review", "approved", "failed"])), (F.col("k") % 6 + 1).cast("int"))
    history = logs(spark, sf_dir).select(F.col("user_id").alias("entity"), F.col("ordinal").alias("version"), states.alias("state"))
    return scoring.illegal_transitions(history).groupBy("before", "state").agg(F.count(F.lit(1)).alias("n"))


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in scoring.LIFECYCLE.items() for b in bs)


def q_queue_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("CASE k % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'leased' WHEN 4 THEN 'dead_letter' ELSE 'completed' END")
    jobs = logs(spark, sf_dir).select(status.alias("status"), F.col("ts").alias("created"), F.col("pod").alias("worker"))
    return store.queue_snapshot(jobs, F.lit("2024-02-01 00:00:00").cast("timestamp"))


def q_usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = logs(spark, sf_dir).select(F.col("service").alias("incident"), F.col("k").alias("input_tokens"), (F.col("k") % 7).alias("output_tokens"))
    return store.usage_ledger(calls, 0.25, 2.0, 0.03)


def q_knowledge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten records by distinct query terms of three letters or more that they hold, then by recency (here: the largest id)."""
    terms = ["the", "and", "that", "onesen", "erblest"]
    score = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    rows = read(spark, sf_dir, "documents").filter((F.col("lang").isNull()) | (F.col("lang") == "en")).select("doc_id", score.cast("long").alias("score"))
    return rows.filter("score > 0").orderBy(F.desc("score"), F.desc("doc_id")).limit(10)


def q_alert_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error code of each alert: identity, status, time, service."""
    rows = logs(spark, sf_dir).select("ordinal", F.when(F.col("k") % 9 != 0, F.col("service")).alias("service"), F.when(F.col("k") % 7 == 0, "unknown").otherwise("firing").alias("status"),
                                      F.when(F.col("k") % 8 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("starts_at"), F.when(F.col("k") % 10 == 0, "").otherwise(F.col("trace_id")).alias("fingerprint"))
    code = (
        F.when(F.coalesce(F.col("fingerprint"), F.lit("")) == "", "missing_identity").when(~F.col("status").isin("firing", "resolved"), "invalid_status")
        .when(F.try_to_timestamp("starts_at").isNull(), "invalid_timestamp").when(F.col("service").isNull(), "missing_service").otherwise("accepted")
    )
    return rows.groupBy(code.alias("error_code")).agg(F.count(F.lit(1)).alias("n"))


def q_incident_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window of each day's incident: 10 minutes before the first error to the last, at most two hours; 15 minutes if empty."""
    day = alerts(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("incident"), "service").agg(F.min("ts").alias("anchor"), F.max("ts").alias("ended"))
    start, micros = F.unix_micros("anchor") - 600_000_000, F.unix_micros("ended")
    end = F.least(micros, start + 7_200_000_000)
    end = F.when(end <= start, start + 900_000_000).otherwise(end)
    return day.select("incident", "service", F.date_format(F.timestamp_micros(start), "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format(F.timestamp_micros(end), "yyyy-MM-dd HH:mm:ss").alias("end"),
                      (micros > start + 7_200_000_000).alias("truncated"), F.greatest(F.round((end - start) / 60e6, 1), F.lit(1.0)).alias("minutes"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs printed as lines of the Hadoop layout, with continuation lines after errors, one file a service; orphans first."""
    rows = logs(spark, sf_dir)
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 "), F.upper("level"), F.lit(" ["), F.col("pod"), F.lit("] "), F.col("message"))
    texts = F.when(F.col("level") == "error", F.array(head, F.lit("java.io.IOException: broken"), F.concat(F.lit("  at step "), F.col("k").cast("string")))).otherwise(F.array(head))
    printed = rows.select(F.col("service").alias("file"), "ordinal", F.posexplode(texts)).select("file", (F.col("ordinal") * 10 + F.col("pos")).alias("line_no"), F.col("col").alias("line"))
    orphans = rows.select(F.col("service").alias("file")).distinct().select("file", F.lit(-1).cast("long").alias("line_no"), F.lit("  at orphan").alias("line"))
    return printed.unionByName(orphans)


def q_parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raw_logs.parse(raw_lines(spark, sf_dir), raw_logs.HADOOP)
    return found.groupBy("file", "level", "thread").agg(F.count(F.lit(1)).alias("records"), F.sum("continuations").alias("continuations"), F.max(F.length("message")).alias("longest"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def q_parse_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_logs.accounting(raw_lines(spark, sf_dir), raw_logs.HADOOP)


def q_time_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling selection windows inside the hour with their cohort label: signal-bearing if any record is an error."""
    start = F.timestamp_seconds(F.unix_seconds(F.date_trunc("hour", "ts")) + F.floor(F.minute("ts") / 10) * 600)
    rows = logs(spark, sf_dir).groupBy("service", start.alias("start")).agg(F.bool_or(F.col("level") == "error").alias("alert"), F.count(F.lit(1)).alias("n"))
    return rows.groupBy("service", F.when(F.col("alert"), "signal_bearing").otherwise("quiet").alias("cohort")).agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("records"))


def q_audit_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten events of one user, newest first, with their total."""
    rows = logs(spark, sf_dir).filter("user_id = 7").withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("user_id")))
    return rows.orderBy(F.desc("ordinal")).limit(10).select("ordinal", "event_name", "total", (F.col("total") > 10).alias("truncated"))


def q_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs(spark, sf_dir).groupBy("service", "level").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.format_string('log_records_total{level="%s",service="%s"} %d', "level", "service", "n").alias("line"))


def q_targeted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targeted rows that the existing ones do not hold, by service: the anti join before a re-run."""
    rows = logs(spark, sf_dir)
    existing, targeted = rows.filter("k % 3 <> 0"), rows.filter("level = 'error'")
    keys = ["ts", "message", "service"]
    return targeted.join(existing.select(keys), keys, "left_anti").groupBy("service").agg(F.count(F.lit(1)).alias("fresh"), F.min("ordinal").alias("first"))


def q_document_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole documents: how many shapes a language has, and how many texts share one."""
    found = read(spark, sf_dir, "documents").groupBy("lang", text.fingerprint(F.col("text")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("shapes"), F.sum("n").alias("documents"), F.max("n").alias("most"))


QUERIES = {
    "incident_bucketing": (q_incident_bucketing, duck("""WITH a AS (SELECT ordinal, ts, service, sha256(error_type || '|' || service || '|' || strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%dT%H:%M:%S+00:00') || '|default') AS bucket_key FROM logs WHERE event_name = 'error')
      SELECT bucket_key, any_value(service) AS service, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at, 100000 + row_number() OVER (ORDER BY min(ts), min(ordinal)) AS incident_number FROM a GROUP BY bucket_key""")),
    "idempotent_admission": (q_idempotent_admission, duck("""WITH a AS (SELECT ordinal, ts, service, service || '|' || error_type || '|' || floor(epoch(ts) / 600) AS k2 FROM logs WHERE event_name = 'error'),
      b AS (SELECT *, row_number() OVER (PARTITION BY k2 ORDER BY ts, ordinal) = 1 AND k2 NOT IN (SELECT k2 FROM a WHERE ts < TIMESTAMP '2024-01-03') AS ok FROM a) SELECT service, count(*) AS sent, count(*) FILTER (ok) AS admitted FROM b GROUP BY service""")),
    "rate_limit": (q_rate_limit, duck("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY service, floor(epoch(ts) / 600) ORDER BY ts, ordinal) <= 2 AS ok, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM logs)
      SELECT service, count(*) AS requests, count(*) FILTER (ok) AS allowed, CAST(sum(CASE WHEN ok THEN 0 ELSE s // 600 * 600 + 600 - s END) AS BIGINT) AS retry_after FROM r GROUP BY service""")),
    "evidence_versions": (q_evidence_versions, """WITH r AS (SELECT *, sha256(o_orderstatus || chr(31) || o_orderpriority) AS c, lag(sha256(o_orderstatus || chr(31) || o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
      SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, substr(c, 1, 12) AS content, substr(p, 1, 12) AS supersedes FROM r WHERE p IS NULL OR p <> c"""),
    "revision_diff": (q_revision_diff, """WITH a AS (SELECT o_custkey, arg_max(o_orderstatus || '|' || o_orderpriority, (o_orderdate, o_orderkey)) AS d FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
      b AS (SELECT o_custkey, arg_max(o_orderstatus || '|' || o_orderpriority, (o_orderdate, o_orderkey)) AS d FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
      SELECT CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' WHEN a.d = b.d THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS keys, min(o_custkey) AS first_key FROM a FULL JOIN b USING (o_custkey) GROUP BY 1"""),
    "coalesced_jobs": (q_coalesced_jobs, duck("""WITH RECURSIVE g AS (SELECT service, ts, ordinal, row_number() OVER w AS i, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 240000000 THEN 0 ELSE 1 END AS s FROM logs WINDOW w AS (PARTITION BY service ORDER BY ts, ordinal)),
      n AS (SELECT *, least(coalesce(min(CASE WHEN s = 1 THEN i END) OVER (PARTITION BY service ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1000000000), 1 + count(*) OVER (PARTITION BY service ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 600000000 FOLLOWING)) AS nxt FROM g),
      b(service, i, job) AS (SELECT service, CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM n WHERE i = 1 UNION ALL SELECT b.service, n.nxt, b.job + 1 FROM b JOIN n ON n.service = b.service AND n.i = b.i WHERE EXISTS (SELECT 1 FROM n m WHERE m.service = b.service AND m.i = n.nxt)),
      j AS (SELECT g.*, b.job FROM g ASOF JOIN b ON g.service = b.service AND g.i >= b.i)
      SELECT service AS incident, job, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "last", arg_max(ordinal, (ts, ordinal)) AS payload,
        least(CAST(floor(epoch(max(ts))) AS BIGINT) + 240, CAST(floor(epoch(min(ts))) AS BIGINT) + 600) AS available_at FROM j GROUP BY service, job""")),
    "lifecycle_replay": (q_lifecycle_replay, duck(f"""WITH h AS (SELECT ['received', 'collecting', 'analyzing', 'awaiting_review', 'approved', 'failed'][k % 6 + 1] AS state, user_id, ordinal FROM logs),
      s AS (SELECT state, lag(state) OVER (PARTITION BY user_id ORDER BY ordinal) AS before FROM h) SELECT before, state, count(*) AS n FROM s WHERE before <> state AND (before, state) NOT IN ({_LEGAL}) GROUP BY ALL""")),
    "queue_snapshot": (q_queue_snapshot, duck("""SELECT count(*) FILTER (k % 5 = 0) AS pending, count(*) FILTER (k % 5 = 1) AS leased, count(*) FILTER (k % 5 IN (2, 3)) AS completed, count(*) FILTER (k % 5 = 4) AS dead_letter,
      CAST(max(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) FILTER (k % 5 = 0) AS BIGINT) AS oldest_pending_seconds, count(DISTINCT pod) FILTER (k % 5 = 1) AS active_workers FROM logs""")),
    "usage_ledger": (q_usage_ledger, duck("""SELECT *, cost <= 0.03 AS within_budget FROM (SELECT service AS incident, count(*) AS calls, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k % 7) AS BIGINT) AS output_tokens,
      round(CAST((sum(k) * 0.25 + sum(k % 7) * 2.0) AS DOUBLE) / 1000000, 8) AS cost FROM logs GROUP BY service)""")),
    "knowledge_topk": (q_knowledge_topk, "SELECT * FROM (SELECT doc_id, " + " + ".join(f"CAST(contains(lower(text), '{t}') AS BIGINT)" for t in ("the", "and", "that", "onesen", "erblest")) + " AS score FROM documents WHERE lang IS NULL OR lang = 'en') WHERE score > 0 ORDER BY score DESC, doc_id DESC LIMIT 10"),
    "alert_contract": (q_alert_contract, duck("""SELECT CASE WHEN k % 10 = 0 THEN 'missing_identity' WHEN k % 7 = 0 THEN 'invalid_status' WHEN k % 8 = 0 THEN 'invalid_timestamp' WHEN k % 9 = 0 THEN 'missing_service' ELSE 'accepted' END AS error_code, count(*) AS n FROM logs GROUP BY 1""")),
    "incident_window": (q_incident_window, duck("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS incident, service, epoch_us(min(ts)) - 600000000 AS s, epoch_us(max(ts)) AS e FROM logs WHERE event_name = 'error' GROUP BY ALL), w AS (SELECT *, least(e, s + 7200000000) AS f FROM d)
      SELECT incident, service, strftime(make_timestamp(s), '%Y-%m-%d %H:%M:%S') AS start, strftime(make_timestamp(f), '%Y-%m-%d %H:%M:%S') AS "end", e > s + 7200000000 AS truncated, greatest(round((f - s) / 60000000.0, 1), 1.0) AS minutes FROM w""")),
    "parse_records": (q_parse_records, duck("""SELECT service AS file, upper(level) AS level, pod AS thread, count(*) AS records, CAST(sum(CASE WHEN level = 'error' THEN 2 ELSE 0 END) AS BIGINT) AS continuations,
      CAST(max(length(message) + CASE WHEN level = 'error' THEN length('java.io.IOException: broken') + length('  at step ' || k) + 2 ELSE 0 END) AS INTEGER) AS longest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM logs GROUP BY ALL""")),
    "parse_accounting": (q_parse_accounting, duck("SELECT service AS file, count(*) + 2 * count(*) FILTER (level = 'error') + 1 AS physical, count(*) AS primary, 2 * count(*) FILTER (level = 'error') AS continuation, CAST(1 AS BIGINT) AS orphan FROM logs GROUP BY service".replace("AS primary", 'AS "primary"'))),
    "window_cohorts": (q_time_slices, duck("""SELECT service, CASE WHEN a THEN 'signal_bearing' ELSE 'quiet' END AS cohort, count(*) AS windows, CAST(sum(n) AS BIGINT) AS records FROM (SELECT service, time_bucket(INTERVAL '10 minutes', ts) AS w, bool_or(level = 'error') AS a, count(*) AS n FROM logs GROUP BY ALL) GROUP BY ALL""")),
    "audit_list": (q_audit_list, duck("SELECT ordinal, event_name, count(*) OVER () AS total, count(*) OVER () > 10 AS truncated FROM logs WHERE user_id = 7 ORDER BY ordinal DESC LIMIT 10")),
    "metrics_exposition": (q_exposition, duck("""SELECT 'log_records_total{level="' || level || '",service="' || service || '"} ' || count(*) AS line FROM logs GROUP BY level, service""")),
    "targeted_merge": (q_targeted_merge, duck("SELECT service, count(*) AS fresh, min(ordinal) AS first FROM logs t WHERE level = 'error' AND NOT EXISTS (SELECT 1 FROM logs e WHERE e.k % 3 <> 0 AND e.ts = t.ts AND e.message = t.message AND e.service = t.service) GROUP BY service".replace("AS first", 'AS "first"'))),
    "document_shapes": (q_document_shapes, None),
}
