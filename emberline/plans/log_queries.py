"""Queries over the logs relation: normalisation, grouping, quality, rules, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import grouping, quality, rules
from emberline.sources import relations
from emberline.sources.relations import duck, logs, read
from emberline.storage import written

#: Text of a timestamp in both engines.
SHOW = "yyyy-MM-dd HH:mm:ss"


def shown(column: str) -> Column:
    return F.date_format(column, SHOW).alias(column)


def d_shown(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


# What the fingerprint makes of the messages of the logs relation, in RE2 (which has no lookaround): codes are
# taken out and put back, the hex rule is applied where these messages have hex, the measure rule keeps what is before it.
_T0 = "regexp_replace(regexp_replace(regexp_replace(lower(message), 'sqlstate\\[[0-9a-z]{5}\\]', '__sa__'), '\\b(?:http(?:\\s+status)?|status(?:_code)?)[=:\\s]+[1-5][0-9]{2}\\b', '__sb__'), 'error_code=[0-9a-z_-]{2,16}', '__sc__')"
for _p, _r in (
    ('trace[_-]?id[=:\\s"]+[a-z0-9-]+', "trace_id=?"), ('(?:req(?:uest)?[_-]?id|x-request-id)[=:\\s"]+[a-z0-9-]+', "request_id=?"),
    ('user[_-]?id[=:\\s"]+[a-z0-9-]+', "user_id=?"), ("\\b(peer|host|node|pod|instance|container)(?:[_-]?id)?[=:]+[a-z0-9._-]+", "\\1=?"),
    ("\\b0x[0-9a-f]+\\b", "<hex>"), ("commit [0-9]*[a-f][0-9a-f]*\\b", "commit <hex>"),
    ("(^|[^a-z0-9])[-+]?\\d+(?:\\.\\d+)?\\s*(?:bytes?|[kmgt]?i?b|milliseconds?|ms|seconds?|secs?)\\b", "\\1<measure>"),
    ("[-+]?\\d+(?:\\.\\d+)?", "<num>"), ("\\s+", " "),
):
    _T0 = f"regexp_replace({_T0}, '{_p}', '{_r}', 'g')"
FINGERPRINT = (
    f"replace(replace(replace(trim({_T0}), '__sa__', 'sqlstate=' || regexp_extract(lower(message), 'sqlstate\\[([0-9a-z]{{5}})\\]', 1)), "
    "'__sb__', 'http_status=' || regexp_extract(lower(message), '\\b(?:http(?:\\s+status)?|status(?:_code)?)[=:\\s]+([1-5][0-9]{2})\\b', 1)), "
    "'__sc__', 'error_code=' || regexp_extract(lower(message), 'error_code=([0-9a-z_-]{2,16})', 1))"
)
SIGNED = f"signed AS (SELECT *, strftime(ts, '%Y-%m-%d') AS incident, {FINGERPRINT} AS signature FROM logs)"
_ID = "'log-' || substr(sha256(concat_ws('|', incident, service, level, coalesce(error_type, ''), event_name, coalesce(status_code, ''), signature)), 1, 12)"
GROUPED = f"""grouped AS (SELECT incident, service, level, error_type, event_name, status_code, signature, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen,
  arg_min(message, ordinal) AS example_message, min(ordinal) AS ordinal, count(DISTINCT pod) AS pods, list_sort(list_distinct(list(host))) AS hosts, {_ID} AS event_id
  FROM signed GROUP BY ALL)"""


def with_signed(query: str) -> str:
    return duck(f"WITH {SIGNED} {query}")


def with_groups(query: str, more: str = "") -> str:
    return duck(f"WITH {SIGNED}, {GROUPED}{', ' + more if more else ''} {query}")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.label_groups(logs(spark, sf_dir))


def q_label_groups_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark, sf_dir)
    total = found.groupBy("incident").agg(F.sum("n").alias("total"))
    return grouping.honesty(found, total, truncated=False).select(
        "incident", "event_id", "service", "level", "error_type", "event_name", "status_code", "signature", "n", shown("first_seen"), shown("last_seen"),
        "example_message", "pods", F.array_join("hosts", ",").alias("hosts"), "count_is_exact", "count_scope", "sampled_fraction",
    )


D_LABEL_GROUPS = with_groups(f"""SELECT incident, event_id, service, level, error_type, event_name, status_code, signature, n, {d_shown('first_seen')} AS first_seen,
  {d_shown('last_seen')} AS last_seen, example_message, pods, array_to_string(hosts, ',') AS hosts, true AS count_is_exact, 'window' AS count_scope,
  round(least(n / sum(n) OVER (PARTITION BY incident), 1.0), 4) AS sampled_fraction FROM grouped""")


def q_fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy("service", "level", text.fingerprint(F.col("message")).alias("signature")).agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), SHOW).alias("first_seen"))


def q_minute_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.minute_buckets(logs(spark, sf_dir))


def q_minute_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.histogram(logs(spark, sf_dir), minutes=60).select(shown("bucket"), "level", "n", F.length("bar").cast("long").alias("bar"))


def q_burst_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.burst_summary(logs(spark, sf_dir)).select(
        "incident", "event_id", shown("onset"), shown("end"), "duration_seconds", "repetitions", "distinct_buckets", shown("peak_bucket"), "peak_count")


def q_dimension_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.dimension_top(logs(spark, sf_dir))


#: Where records come from, in both engines.
LINEAGE = {
    "source": "CASE WHEN k % 2 = 0 THEN 'loki' ELSE 'cloudwatch' END", "query_id": "concat('qry-', k % 3)", "source_schema_id": "CASE WHEN k % 2 = 0 THEN 'loki_default' END", "connector_version": "concat('v', user_id % 2)",
    "clock_quality": "CASE WHEN k % 4 = 0 THEN 'assumed_utc' ELSE 'verified' END", "source_timestamp_quality": "CASE WHEN k % 5 = 0 THEN 'inferred' ELSE '' END", "timestamp_ordering_scope": "CASE WHEN k % 6 = 0 THEN 'source_relative' ELSE 'global' END",
}
_D_LINEAGE = ", ".join(f"coalesce(string_agg(DISTINCT nullif({made}, ''), ',' ORDER BY nullif({made}, '')), '') AS {grouping.LINEAGE_SETS[name]}" for name, made in LINEAGE.items())


def q_lineage_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What groups were seen in: dimensions, and sources as connectors would name them."""
    rows = logs(spark, sf_dir)
    for name, made in LINEAGE.items():
        rows = rows.withColumn(name, F.expr(made))
    return grouping.lineage(rows)


def q_first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.first_messages(logs(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as a source would send them: text times of several kinds, label names of two schemas."""
    labels = F.when(F.col("k") % 2 == 0, F.create_map(
        F.lit("app"), F.col("service"), F.lit("severity"), F.expr("CASE event_name WHEN 'error' THEN 'FATAL' WHEN 'view' THEN 'Warning' WHEN 'click' THEN 'notice' ELSE ' Verbose ' END"),
        F.lit("user_id"), F.col("user_id").cast("string"), F.lit("hostname"), F.col("host"), F.lit("err_type"), F.coalesce("error_type", F.lit("")),
    )).otherwise(F.create_map(F.lit("logGroup"), F.col("service"), F.lit("priority"), F.expr("CASE event_name WHEN 'error' THEN 'crit' ELSE 'custom' END")))
    stamp = F.expr("""CASE WHEN ordinal % 11 = 0 THEN '' WHEN ordinal % 11 = 1 THEN 'yesterday'
      WHEN ordinal % 11 = 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") WHEN ordinal % 11 = 3 THEN date_format(ts + INTERVAL 1 DAY, "yyyy-MM-dd'T'HH:mm:ss'Z'")
      ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") END""")
    return logs(spark, sf_dir).select("ordinal", stamp.alias("timestamp"), "message", labels.alias("labels"), F.col("ts").alias("received"), "service", "k")


def q_normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.normalize_logs(raw_records(spark, sf_dir).drop("service", "k"))
    return found.select("ordinal", "schema", "service", "level", "error_type", "user_id", "host", "time_quality", F.date_format("event_time", SHOW).alias("event_time"), "evidence_id", "integrity_hash")


#: What redaction makes of the messages of the logs relation, in RE2.
_D_REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, 'token=[^\s,]+', 'token=[REDACTED]', 'g'), '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b', '[EMAIL_REDACTED]', 'g'),
  '\bhost=[^\s,;]+', 'host=[HOST_REDACTED]', 'g'), '(?:\d{1,3}\.){3}\d{1,3}', '[IP_REDACTED]', 'g')"""

D_NORMALIZE_RECORDS = duck("""SELECT ordinal, CASE WHEN k % 2 = 0 THEN 'loki_default' ELSE 'cloudwatch' END AS schema, service,
  CASE WHEN k % 2 = 0 THEN CASE event_name WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' WHEN 'click' THEN 'info' ELSE 'debug' END
       ELSE CASE event_name WHEN 'error' THEN 'error' ELSE 'custom' END END AS level,
  CASE WHEN k % 2 = 0 THEN error_type END AS error_type,
  CASE WHEN k % 2 = 0 THEN 'redacted-' || substr(sha256(':' || CAST(user_id AS VARCHAR)), 1, 12) END AS user_id,
  CASE WHEN k % 2 = 0 THEN host END AS host,
  CASE ordinal % 11 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' WHEN 2 THEN 'assumed_utc' WHEN 3 THEN 'future' ELSE 'verified' END AS time_quality,
  CASE WHEN ordinal % 11 IN (0, 1, 3) THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_time,
  'evd-log-' || substr(sha256('{"payload":' || payload || ',"source":"loki","type":"log"}'), 1, 20) AS evidence_id, 'sha256:' || sha256(payload) AS integrity_hash
  FROM (SELECT *, '{"labels":{' || CASE WHEN k % 2 = 0 THEN CASE WHEN error_type IS NULL THEN '' ELSE '"error_type":"' || error_type || '",' END || '"host":"' || host || '","level":"'
      || CASE event_name WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' WHEN 'click' THEN 'info' ELSE 'debug' END || '","service":"' || service || '","user_id":"redacted-' || substr(sha256(':' || CAST(user_id AS VARCHAR)), 1, 12) || '"'
      ELSE '"level":"' || CASE event_name WHEN 'error' THEN 'error' ELSE 'custom' END || '","service":"' || service || '"' END
    || '},"message":"' || """ + _D_REDACTED + r""" || '","operation_feature":null,"schema":"' || CASE WHEN k % 2 = 0 THEN 'loki_default' ELSE 'cloudwatch' END || '","timestamp":"'
    || CASE ordinal % 11 WHEN 0 THEN '' WHEN 1 THEN 'yesterday' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END || '"}' AS payload FROM logs)""")


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with faults: some without a service, some sent twice."""
    rows = logs(spark, sf_dir).withColumn("service", F.when(F.col("ordinal") % 13 != 0, F.col("service"))).withColumn(
        "time_quality", F.when(F.col("ordinal") % 7 == 0, "assumed_utc").when(F.col("ordinal") % 17 == 0, "future").otherwise("verified"))
    again = rows.filter("ordinal % 5 = 0").withColumn("ordinal", F.col("ordinal") + 100_000_000)
    return quality.assess(rows.unionByName(again), ["service", "message"], ["ts", "service", "message"], quarantine_missing_time=True)


_ASSESSED = """faulty AS (SELECT * REPLACE (CASE WHEN ordinal % 13 <> 0 THEN service END AS service),
    CASE WHEN ordinal % 7 = 0 THEN 'assumed_utc' WHEN ordinal % 17 = 0 THEN 'future' ELSE 'verified' END AS time_quality FROM logs),
  twice AS (SELECT * FROM faulty UNION ALL SELECT * REPLACE (ordinal + 100000000 AS ordinal) FROM faulty WHERE ordinal % 5 = 0),
  quarantined AS (SELECT *, CASE WHEN service IS NULL THEN 'missing_required' WHEN time_quality = 'future' THEN 'unusable_time' END AS quarantine FROM twice),
  assessed AS (SELECT *, quarantine IS NULL AND row_number() OVER (PARTITION BY ts, service, message, quarantine IS NULL ORDER BY ordinal) > 1 AS duplicate FROM quarantined)"""


def q_dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(assessed(spark, sf_dir), ["event_name"]).withColumns({c: F.date_format(c, SHOW) for c in ("first_time", "last_time")})


D_DQ_REPORT = duck(f"""WITH {_ASSESSED} SELECT event_name, count(*) AS input_records, count(*) FILTER (quarantine IS NULL AND NOT duplicate) AS usable_records,
  count(*) FILTER (quarantine IS NOT NULL) AS quarantined_records, count(*) FILTER (duplicate) AS duplicate_records, count(*) FILTER (time_quality = 'assumed_utc') AS assumed_utc,
  count(*) FILTER (time_quality = 'future') AS future_times, strftime(min(ts) FILTER (quarantine IS NULL AND NOT duplicate), '%Y-%m-%d %H:%M:%S') AS first_time,
  strftime(max(ts) FILTER (quarantine IS NULL AND NOT duplicate), '%Y-%m-%d %H:%M:%S') AS last_time FROM assessed GROUP BY event_name""")


def q_dedup_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).filter("usable").groupBy("service", "event_name").agg(F.count(F.lit(1)).alias("records"), F.max("ordinal").alias("last_ordinal"))


def q_search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source that hold a literal, ignoring case: how many, and the first ten."""
    hits = read(spark, sf_dir, "documents").filter((F.col("source") == "src1") & F.contains(F.lower("text"), F.lit("the"))).select("doc_id", F.substring("text", 1, 60).alias("preview"))
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy("doc_id").limit(10).crossJoin(F.broadcast(total))


def q_redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails and addresses in documents, redacted; the word edges are those of ASCII in both engines."""
    cleaned = F.regexp_replace(F.col("text"), r"(?i)(?<![A-Za-z0-9_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Za-z0-9_])", "[EMAIL_REDACTED]")
    return read(spark, sf_dir, "documents").select("doc_id", cleaned.alias("text")).filter(F.contains("text", F.lit("[EMAIL_REDACTED]"))).select(
        "doc_id", F.size(F.split("text", r"\[EMAIL_REDACTED\]")).alias("parts"), F.sha2("text", 256).alias("text_sha256"))


def q_redact_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy("event_name", F.regexp_replace(text.redact_message(F.col("message")), r"[0-9a-f]{7,}|\d+", "#").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


D_REDACT_LOGS = duck(r"""SELECT event_name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '(?i)(authorization|api[_-]?key|token|password|secret)\s*[=:]\s*[^\s,]+', '\1=[REDACTED]', 'g'),
  '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL_REDACTED]', 'g'), '(?i)\b(rhost|remote_host|hostname|host)\s*=\s*[^\s,;]+', '\1=[HOST_REDACTED]', 'g'),
  '(^|[^\d.])(?:\d{1,3}\.){3}\d{1,3}($|[^\d.])', '\1[IP_REDACTED]\2', 'g'), '[0-9a-f]{7,}|\d+', '#', 'g') AS shape, count(*) AS n FROM logs GROUP BY ALL""")


def q_redact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("pod"), F.col("pod"), F.lit("Token"), F.lit("redacted-abc"))
    clean = text.redact_labels(labels)
    return logs(spark, sf_dir).select("ordinal", *[F.element_at(clean, k).alias(k.lower()) for k in ("user_id", "pod", "Token")])


def q_pivot_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pivot values of the first twenty by arrival, by service and field."""
    from pyspark.sql import Window

    found = logs(spark, sf_dir).select("service", "ordinal", F.explode(F.array(*[
        F.struct(F.lit(n).alias("field"), text.pivots(F.col("message"), n).alias("values")) for n in text.PIVOTS
    ])).alias("p")).select("service", "ordinal", "p.field", F.explode("p.values").alias("value"))
    first = found.groupBy("service", "field", "value").agg(F.min("ordinal").alias("ordinal"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("service", "field").orderBy("ordinal"))).filter("rank <= 20").select("service", "field", "value", F.col("rank").cast("long").alias("rank"))


D_PIVOTS = duck("WITH found AS (" + " UNION ALL ".join(
    f"""SELECT service, ordinal, '{name}' AS field, unnest(regexp_extract_all(message, '{pattern}', 1)) AS value FROM logs""" for name, pattern in text.PIVOTS.items()
) + """), ranked AS (SELECT service, field, value, row_number() OVER (PARTITION BY service, field ORDER BY min(ordinal)) AS rank FROM found GROUP BY service, field, value)
  SELECT * FROM ranked WHERE rank <= 20""")


def q_code_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs(spark, sf_dir).select("service", F.explode(text.decode_codes(F.col("message"))).alias("c"))
    return found.groupBy("service", "c.label", "c.code", "c.meaning").agg(F.count(F.lit(1)).alias("n"))


D_CODES = duck("WITH found AS (" + " UNION ALL ".join(
    f"""SELECT service, '{label}' AS label, regexp_extract(message, '{pattern}', 1) AS code FROM logs""" for pattern, label, _ in text.CODES
) + "), meanings(label, code, meaning) AS (VALUES " + ", ".join(f"('{label}', '{c}', '{m}')" for _, label, table in text.CODES for c, m in table.items()) + """)
  SELECT service, label, code, meaning, count(*) AS n FROM found JOIN meanings USING (label, code) GROUP BY ALL""")


def q_suppress_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark, sf_dir).withColumn("rule_id", F.coalesce(rules.suppression_of(F.col("example_message")), F.lit("kept")))
    return found.groupBy("incident", "rule_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("records"))


def q_detect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).select("incident", "event_id", "rule_id", "rule_level", "category", "rule_rank", "n")


def detected(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    from emberline.operators import correlation

    found = found or written(groups(spark, sf_dir), "groups")
    nearest = correlation.deploys_before(found.select("event_id", "service", "first_seen"), relations.deploys(spark, sf_dir)).groupBy("event_id").agg(
        F.min("minutes_before").alias("after_deploy"), F.count(F.lit(1)).alias("deploys"))
    return rules.detections(found.join(nearest, "event_id", "left"))


DEPLOYED = """near AS (SELECT event_id, min(round(epoch_us(first_seen) / 60000000.0 - epoch_us(deployed_at) / 60000000.0, 1)) AS after_deploy, count(*) AS deploys
  FROM grouped g JOIN deploys d ON g.service = d.service AND d.deployed_at <= g.first_seen AND epoch_us(first_seen) - epoch_us(deployed_at) <= 900000000 GROUP BY event_id)"""
DETECTED = DEPLOYED + ", detected AS (" + " UNION ALL ".join(
    f"SELECT grouped.*, near.deploys, '{r['id']}' AS rule_id, '{r['level']}' AS rule_level, '{r['category']}' AS category, {rules.RULE_LEVELS[r['level']]} AS rule_rank FROM grouped LEFT JOIN near USING (event_id) WHERE true"
    + (f" AND regexp_matches(example_message, '(?i){r['message_regex']}')" if "message_regex" in r else "")
    + (f" AND level IN ({', '.join(repr(x) for x in r['levels'])})" if "levels" in r else "")
    + (f" AND after_deploy BETWEEN 0 AND {r['minutes_after_deploy']}" if "minutes_after_deploy" in r else "")
    for r in rules.DETECTIONS
) + ")"


def q_signal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark, sf_dir).select("incident", "event_id", F.explode(text.detect_signals(F.col("example_message"), F.col("level"))).alias("s"))
    return found.select("incident", "event_id", "s.*")


SIGNALLED = "matched AS (" + " UNION ALL ".join(
    f"SELECT incident, event_id, '{r}' AS rule_id, '{f}' AS signal_family, '{d}' AS directness, '{s}' AS status, '{c}' AS scope, 'versioned_regex' AS match_method FROM grouped WHERE regexp_matches(example_message, '{p}')"
    for r, f, d, s, c, p in text.SIGNALS
) + """), signals AS (SELECT * FROM matched UNION ALL SELECT incident, event_id, 'source-level-unclassified-error', 'unclassified_error', 'direct', 'error_logged', 'service', 'structured_source_level'
  FROM grouped WHERE level IN ('error', 'fatal', 'critical') AND event_id NOT IN (SELECT event_id FROM matched))"""


def q_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE event_name WHEN 'error' THEN ' FATAL' WHEN 'view' THEN 'Warning' WHEN 'click' THEN 'notice' WHEN 'purchase' THEN 'verbose' ELSE 'Custom' END")
    return logs(spark, sf_dir).groupBy(text.normalize_level(raw).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def q_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy("service").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("level")), ",").alias("levels"))


def q_log_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts of a bounded window with a literal line filter; the filters reach the scan of events."""
    hit = logs(spark, sf_dir).filter((F.col("ts") >= "2024-01-03") & (F.col("ts") < "2024-01-10") & F.contains("message", F.lit("user_id=")))
    found = hit.groupBy("service").agg(F.count(F.lit(1)).alias("total_count"))
    return found.select("service", "total_count", F.lit(True).alias("count_is_exact"), quality.status_of(F.col("total_count"), F.lit(False), F.lit(False)).alias("status"))


QUERIES = {
    "normalize_levels": (q_levels, duck("SELECT CASE event_name WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' WHEN 'click' THEN 'info' WHEN 'purchase' THEN 'debug' ELSE 'custom' END AS level, count(*) AS n FROM logs GROUP BY 1")),
    "normalize_records": (q_normalize_records, D_NORMALIZE_RECORDS),
    "fingerprint_groups": (q_fingerprint_groups, with_signed(f"SELECT service, level, signature, count(*) AS n, {d_shown('min(ts)')} AS first_seen FROM signed GROUP BY ALL")),
    "label_groups_full": (q_label_groups_full, D_LABEL_GROUPS),
    "minute_buckets": (q_minute_buckets, with_signed(f"SELECT incident, {_ID} AS event_id, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%MZ') AS bucket, count(*) AS n FROM signed GROUP BY incident, service, level, error_type, event_name, status_code, signature, 3")),
    "minute_histogram": (q_minute_histogram, duck("""WITH c AS (SELECT time_bucket(INTERVAL '60 minutes', ts) AS bucket, level, count(*) AS n FROM logs WHERE level IN ('error', 'warn') GROUP BY 1, 2)
      SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, level, n, CAST(floor(n * 40 / (SELECT max(n) FROM c)) AS BIGINT) AS bar FROM c""")),
    "burst_summary": (q_burst_summary, with_signed(f"""SELECT incident, {_ID} AS event_id, {d_shown('min(a)')} AS onset, {d_shown('max(b)')} AS "end", round((epoch_us(max(b)) - epoch_us(min(a))) / 1000000.0, 3) AS duration_seconds,
      CAST(sum(c) AS BIGINT) AS repetitions, count(m) AS distinct_buckets, {d_shown('arg_max(m, c * 10000000000 - epoch(m))')} AS peak_bucket, max(c) AS peak_count
      FROM (SELECT incident, service, level, error_type, event_name, status_code, signature, date_trunc('minute', ts) AS m, count(*) AS c, min(ts) AS a, max(ts) AS b FROM signed GROUP BY ALL)
      GROUP BY incident, service, level, error_type, event_name, status_code, signature""")),
    "dimension_top5": (q_dimension_top5, with_signed(f"""SELECT incident, event_id, dimension, count(*) AS unique_values, string_agg(value || '=' || n, ',' ORDER BY rank) FILTER (rank <= 5) AS top_values
      FROM (SELECT *, row_number() OVER (PARTITION BY incident, event_id, dimension ORDER BY n DESC, value) AS rank FROM (
        SELECT incident, event_id, dimension, value, count(*) AS n FROM (
          SELECT incident, {_ID} AS event_id, unnest(['route', 'dependency', 'region', 'pod', 'host', 'status_code', 'workload_id', 'execution_id']) AS dimension,
            unnest([route, dependency, region, pod, host, status_code, workload_id, execution_id]) AS value FROM signed) WHERE value <> '' GROUP BY ALL)) GROUP BY ALL""")),
    "lineage_sets": (q_lineage_sets, with_signed(f"""SELECT incident, {_ID} AS event_id, string_agg(DISTINCT pod, ',' ORDER BY pod) AS pods, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts, count(DISTINCT user_id) AS users, {_D_LINEAGE}
      FROM signed GROUP BY incident, service, level, error_type, event_name, status_code, signature""")),
    "first_messages": (q_first_messages, with_signed(f"""SELECT incident, event_id, rank, message FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o) AS rank FROM (
      SELECT incident, {_ID} AS event_id, message, min(ordinal) AS o FROM signed GROUP BY incident, service, level, error_type, event_name, status_code, signature, message)) WHERE rank <= 3""")),
    "dq_report": (q_dq_report, D_DQ_REPORT),
    "dedup_records": (q_dedup_records, duck(f"WITH {_ASSESSED} SELECT service, event_name, count(*) AS records, max(ordinal) AS last_ordinal FROM assessed WHERE quarantine IS NULL AND NOT duplicate GROUP BY ALL")),
    "search_summary": (q_search_summary, "SELECT doc_id, substr(text, 1, 60) AS preview, count(*) OVER () AS total FROM documents WHERE source = 'src1' AND contains(lower(text), 'the') ORDER BY doc_id LIMIT 10"),
    "redact_documents": (q_redact_documents, r"""SELECT doc_id, CAST(len(string_split(t, '[EMAIL_REDACTED]')) AS INTEGER) AS parts, sha256(t) AS text_sha256 FROM (
      SELECT doc_id, regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[EMAIL_REDACTED]', 'g') AS t FROM documents) WHERE contains(t, '[EMAIL_REDACTED]')"""),
    "redact_logs": (q_redact_logs, D_REDACT_LOGS),
    "redact_labels": (q_redact_labels, duck("SELECT ordinal, 'redacted-' || substr(sha256(':' || CAST(user_id AS VARCHAR)), 1, 12) AS user_id, pod, 'redacted-abc' AS token FROM logs")),
    "pivot_extract": (q_pivot_extract, D_PIVOTS),
    "code_decode": (q_code_decode, D_CODES),
    "suppress_groups": (q_suppress_groups, with_groups("""SELECT incident, CASE WHEN level = 'info' AND regexp_matches(example_message, 'broken pipe|EPIPE') THEN 'broken-pipe-info' ELSE 'kept' END AS rule_id,
      count(*) AS groups, CAST(sum(n) AS BIGINT) AS records FROM grouped GROUP BY ALL""")),
    "detect_rules": (q_detect_rules, with_groups("SELECT incident, event_id, rule_id, rule_level, category, rule_rank, n FROM detected", DETECTED)),
    "signal_matches": (q_signal_matches, with_groups("SELECT * FROM signals", SIGNALLED)),
    "service_discovery": (q_discovery, duck("SELECT service, count(*) AS n, string_agg(DISTINCT level, ',' ORDER BY level) AS levels FROM logs GROUP BY service")),
    "log_stats": (q_log_stats, duck("""SELECT service, count(*) AS total_count, true AS count_is_exact, 'ok' AS status FROM logs
      WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' AND contains(message, 'user_id=') GROUP BY service""")),
}
