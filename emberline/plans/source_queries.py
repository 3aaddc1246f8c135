"""Queries over paged ranges, budgeted scans, metric pages, deployments, counters and histograms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import sanitize
from emberline.operators import correlation, counters, grouping, rule_matcher, rules, scans
from emberline.plans import log_queries
from emberline.plans.log_queries import d_shown, shown
from emberline.plans.store_queries import raw_lines
from emberline.sources import paged, raw_logs, rule_files, split_logs, tabular_logs
from emberline.sources.relations import deploys, duck, logs
from emberline.storage import shared_path, written

DAY = 86_400
PAGE_ROWS = 200
#: Pages that are written to one file.
FILE_PAGES = 500
PAGE_FIELDS = "ordinal long, ts timestamp, service string, level string, message string"
SCAN_LIMIT = 40
METRIC_PAGE_ROWS, METRIC_PAGES = 50, 20
#: Seconds over which rates are taken: the events are sparse.
SPAN = 1800
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0]


def q_budgeted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs as pages of a range API, read with the range pushed down, and sampled by service and day."""
    fields = [f.split()[0] for f in PAGE_FIELDS.split(", ")]
    path = paged.write_pages(logs(spark, sf_dir).select(*fields), shared_path(spark, "log-pages"), DAY, PAGE_ROWS, file_pages=FILE_PAGES)
    rows = paged.read_pages(spark, path, PAGE_FIELDS, DAY).filter((F.col("ts") >= "1970-01-02") & (F.col("ts") < "2100-01-01"))
    day = F.date_trunc("day", "ts")
    rows = rows.withColumns({"start": day, "end": day + F.expr("INTERVAL 1 DAY"), "incident": F.date_format("ts", "yyyy-MM-dd")})
    loud = sanitize.is_high_signal(F.col("level"), F.col("message"))
    return scans.budgeted_scan(rows, ["service", "incident"], "start", "end", SCAN_LIMIT, loud, ["ts", "message", "level"]).select("service", "incident", "ordinal", shown("ts"))


_LOUD = "(level IN ('error', 'warn') OR regexp_matches(message, '(?i)(error|exception|timeout|failed|lost|refused|exhausted|oomkilled|no space left|disk full|exit code|killed)'))"
_GENERAL = SCAN_LIMIT * 3 // 4
_EARLY, _LATE = (str([f(q) for q in scans.quotas(_GENERAL, 4)]) for f in (lambda q: q - q // 2, lambda q: q // 2))
D_BUDGETED = duck(f"""WITH r AS (SELECT service, strftime(ts, '%Y-%m-%d') AS incident, ordinal, ts, message, level, {_LOUD} AS loud,
    least((epoch_us(ts) - epoch_us(date_trunc('day', ts))) * 4 // 86400000000, 3) + 1 AS slice FROM logs),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY service, incident, slice ORDER BY ts, ordinal) <= {_EARLY}[slice]
      OR row_number() OVER (PARTITION BY service, incident, slice ORDER BY ts DESC, ordinal DESC) <= {_LATE}[slice]
      OR (loud AND row_number() OVER (PARTITION BY service, incident, slice, loud ORDER BY ts, ordinal) <= {scans.quotas(SCAN_LIMIT - _GENERAL, 4)}[slice]) AS taken,
    row_number() OVER (PARTITION BY service, incident ORDER BY ts DESC, ordinal DESC) AS back FROM r),
  once AS (SELECT service, incident, ts, message, level, min(ordinal) AS ordinal, bool_or(taken) AS taken, min(back) AS back FROM ranked WHERE taken OR back <= {SCAN_LIMIT} GROUP BY ALL),
  found AS (SELECT * FROM (SELECT *, count(*) FILTER (taken) OVER (PARTITION BY service, incident) AS n FROM once) WHERE taken OR back <= {SCAN_LIMIT} - n)
  SELECT service, incident, ordinal, {d_shown('ts')} AS ts FROM found QUALIFY row_number() OVER (PARTITION BY service, incident ORDER BY ts, ordinal) <= {SCAN_LIMIT}""")


def q_page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader with a page limit read of each day: a day with unread pages is partial."""
    path = paged.write_pages(logs(spark, sf_dir).select("ordinal", "ts", "message"), shared_path(spark, "status-pages"), DAY, 100, file_pages=FILE_PAGES)
    return paged.read_status(spark, path, DAY, max_pages=3).select("slice", "pages", "pages_read", "rows_read", "partial")


D_PAGE_STATUS = duck("""SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS slice, CAST(ceil(count(*) / 100.0) AS INTEGER) AS pages, CAST(least(ceil(count(*) / 100.0), 3) AS INTEGER) AS pages_read,
  least(count(*), 300) AS rows_read, count(*) > 300 AS partial FROM logs GROUP BY 1""")


def q_metric_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by service and pod as pages of results; the status of a page tells whether its last record was an error."""
    by_time = Window.partitionBy("service", "pod").orderBy("ts", "ordinal")
    rows = logs(spark, sf_dir).withColumn("page", F.floor((F.row_number().over(by_time) - 1) / METRIC_PAGE_ROWS))
    last = F.max_by("level", F.struct("ts", "ordinal")).over(Window.partitionBy("service", "pod", "page"))
    rows = rows.withColumn("status", F.when(last == "error", "PartialData").otherwise("Complete"))
    found = scans.metric_results(rows, ["service", "pod"], METRIC_PAGES)
    return found.select("service", "pod", "value", shown("last_at"), "peak_value", shown("peak_at"), "first_value", "trend", "samples", "partial", "truncated", "error")


D_METRIC_RESULTS = duck(f"""WITH p AS (SELECT *, (row_number() OVER (PARTITION BY service, pod ORDER BY ts, ordinal) - 1) // {METRIC_PAGE_ROWS} AS page FROM logs),
  s AS (SELECT *, arg_max(level, (ts, ordinal)) OVER (PARTITION BY service, pod, page) = 'error' AS bad FROM p),
  t AS (SELECT service, pod, max(page) >= {METRIC_PAGES} AS truncated, coalesce(bool_or(bad) FILTER (page < {METRIC_PAGES}), false) AS partial FROM s GROUP BY ALL),
  d AS (SELECT DISTINCT service, pod, ts, value FROM s WHERE page < {METRIC_PAGES}),
  a AS (SELECT service, pod, arg_max(value, (ts, value)) AS value, max(ts) AS seen, max(value) AS peak_value, arg_min(value, (ts, value)) AS first_value, count(*) AS samples FROM d GROUP BY ALL)
  SELECT service, pod, value, {d_shown('seen')} AS last_at, peak_value, (SELECT {d_shown('min(ts)')} FROM d WHERE d.service = a.service AND d.pod = a.pod AND d.value = a.peak_value) AS peak_at, first_value,
    CASE WHEN value > first_value THEN 'rising' WHEN value < first_value THEN 'falling' ELSE 'flat' END AS trend, samples, partial, truncated, NULL AS error FROM a JOIN t USING (service, pod)""")


def q_recent_deploys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployments that the last error of a service and day sees."""
    windows = logs(spark, sf_dir).filter("level = 'error'").groupBy("service", F.date_format("ts", "yyyy-MM-dd").alias("incident")).agg(F.max("ts").alias("window_end"))
    return scans.recent_deploys(deploys(spark, sf_dir), windows).select("service", "incident", "deploy_id", "commit", "rank")


D_RECENT = duck("""WITH w AS (SELECT service, strftime(ts, '%Y-%m-%d') AS incident, max(ts) AS window_end FROM logs WHERE level = 'error' GROUP BY ALL),
  d AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY deployed_at DESC, deploy_id DESC) AS rank FROM deploys QUALIFY rank <= 30)
  SELECT service, incident, deploy_id, substr(commit, 1, 7) AS commit, rank FROM w JOIN d USING (service) WHERE deployed_at >= window_end - INTERVAL 48 HOURS""")


def q_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.insights(logs(spark, sf_dir), ["service"], ["route", "status_code"], 25).select("service", "ordinal", "route", "status_code", "rank")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request counters of each service, pod and class of status: they count from 0 each day and from each kill of the pod for memory on."""
    rows = logs(spark, sf_dir).withColumns({"code": F.coalesce(F.substring("status_code", 1, 1), F.lit("-")), "day": F.to_date("ts")})
    pod = Window.partitionBy("service", "pod", "day").orderBy("ts", "ordinal")
    rows = rows.withColumn("life", F.count_if(F.coalesce(F.col("error_type") == "oom", F.lit(False))).over(pod))
    return rows.withColumn("value_of", F.row_number().over(Window.partitionBy("service", "pod", "code", "day", "life").orderBy("ts", "ordinal")).cast("double"))


def q_counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests a second and share of server errors by service at every minute that has them, summed up by day."""
    samples = counted(spark, sf_dir).select("service", "pod", "code", "ts", F.col("value_of").alias("value"))
    rates = counters.rate_on_grid(samples, ["service", "pod", "code"], span=SPAN)
    at = rates.groupBy("service", "at").agg(F.sum("rate").alias("all"), F.sum(F.when(F.col("code") == "5", F.col("rate")).otherwise(0.0)).alias("bad"))
    day = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd").alias("day")
    share = F.when(F.col("all") > 0, F.col("bad") / F.col("all"))
    return at.groupBy("service", day).agg(
        F.count(F.lit(1)).alias("points"), F.round(F.max("all"), 8).alias("peak_rate"), F.round(F.avg("all"), 8).alias("mean_rate"), F.round(F.avg(share), 6).alias("error_rate")
    )


_RATES = """g AS (SELECT service, pod, series, le, t, v, lost, unnest(range(CAST(ceil(t / 60) * 60 AS BIGINT), CAST(ceil((t + {span}) / 60) * 60 AS BIGINT), 60)) AS point FROM s),
  a AS (SELECT service, pod, series, le, point, count(*) AS n, min(t) AS a, max(t) AS z, arg_min(v, t) AS va, arg_max(v, t) - arg_min(v, t) + sum(lost) - arg_min(lost, t) AS inc FROM g GROUP BY ALL HAVING count(*) > 1),
  e AS (SELECT *, z - a AS d, (z - a) / (n - 1) AS m, a - (point - {span}) AS sa, point - z AS sz FROM a),
  f AS (SELECT *, CASE WHEN sa < m * 1.1 THEN sa ELSE m / 2 END AS s0, CASE WHEN sz < m * 1.1 THEN sz ELSE m / 2 END AS s1 FROM e),
  rates AS (SELECT service, pod, series, le, point, inc * (d + CASE WHEN inc > 0 AND va >= 0 THEN least(s0, d * va / inc) ELSE s0 END + s1) / d / {span} AS rate FROM f)"""
_LIVES = """c AS (SELECT *, coalesce(substr(status_code, 1, 1), '-') AS code, date_trunc('day', ts) AS day, count(*) FILTER (error_type = 'oom') OVER (PARTITION BY service, pod, date_trunc('day', ts) ORDER BY ts, ordinal ROWS UNBOUNDED PRECEDING) AS life FROM logs)"""
D_COUNTER_RATES = duck(f"""WITH {_LIVES}, o AS (SELECT service, pod, code AS series, 0.0 AS le, epoch_us(ts) / 1000000.0 AS t, CAST(row_number() OVER (PARTITION BY service, pod, code, day, life ORDER BY ts, ordinal) AS DOUBLE) AS v FROM c),
  u AS (SELECT service, pod, series, le, t, max(v) AS v FROM o GROUP BY ALL),
  s AS (SELECT *, CASE WHEN v < lag(v) OVER w THEN lag(v) OVER w ELSE 0 END AS lost FROM u WINDOW w AS (PARTITION BY service, pod, series ORDER BY t)),
  {_RATES.format(span=SPAN)}, p AS (SELECT service, point, sum(rate) AS r, coalesce(sum(rate) FILTER (series = '5'), 0) AS bad FROM rates GROUP BY ALL)
  SELECT service, strftime(make_timestamp(point * 1000000), '%Y-%m-%d') AS day, count(*) AS points, round(max(r), 8) AS peak_rate, round(avg(r), 8) AS mean_rate, round(avg(CASE WHEN r > 0 THEN bad / r END), 6) AS error_rate FROM p GROUP BY ALL""")


def q_histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p95 of the values of a service's pods at every minute, from rates of cumulative bucket counters, summed up by day."""
    rows = counted(spark, sf_dir)
    bounds = F.array(*map(F.lit, [*BOUNDS, counters.INFINITY]))
    under = rows.select("service", "pod", "day", "life", "ts", "ordinal", F.explode(F.transform(bounds, lambda b: F.struct(b.alias("le"), (F.col("value") <= b).cast("double").alias("c")))).alias("b"))
    so_far = Window.partitionBy("service", "pod", "day", "life", "b.le").orderBy("ts", "ordinal").rowsBetween(Window.unboundedPreceding, 0)
    samples = under.select("service", "pod", "b.le", "ts", F.sum("b.c").over(so_far).alias("value"))
    found = counters.histogram_quantile(counters.rate_on_grid(samples, ["service", "pod", "le"], span=SPAN), ["service", "at"], 0.95)
    day = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd").alias("day")
    return found.groupBy("service", day).agg(F.count("quantile").alias("points"), F.round(F.max("quantile") * 1000, 3).alias("most_ms"), F.round(F.avg("quantile") * 1000, 3).alias("mean_ms"))


D_HISTOGRAM = duck(f"""WITH {_LIVES}, b AS (SELECT c.*, le, CAST(value <= le AS DOUBLE) AS i FROM c, (SELECT unnest({BOUNDS} || ['inf'::DOUBLE]) AS le)),
  o AS (SELECT service, pod, '' AS series, le, epoch_us(ts) / 1000000.0 AS t, sum(i) OVER (PARTITION BY service, pod, day, life, le ORDER BY ts, ordinal ROWS UNBOUNDED PRECEDING) AS v FROM b),
  u AS (SELECT service, pod, series, le, t, max(v) AS v FROM o GROUP BY ALL),
  s AS (SELECT *, CASE WHEN v < lag(v) OVER w THEN lag(v) OVER w ELSE 0 END AS lost FROM u WINDOW w AS (PARTITION BY service, pod, le ORDER BY t)),
  {_RATES.format(span=SPAN)}, h AS (SELECT service, point, le, sum(rate) AS r FROM rates GROUP BY ALL),
  x AS (SELECT *, max(r) OVER w AS c, max(r) OVER (PARTITION BY service, point) AS n, row_number() OVER w AS i, count(*) OVER (PARTITION BY service, point) AS k FROM h WINDOW w AS (PARTITION BY service, point ORDER BY le)),
  y AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS before FROM x WINDOW w AS (PARTITION BY service, point ORDER BY le)),
  q AS (SELECT service, point, arg_min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.95 * n - before) / (c - before) END, i) AS q FROM y WHERE c >= 0.95 * n AND n > 0 AND k > 1 GROUP BY ALL)
  SELECT service, strftime(make_timestamp(point * 1000000), '%Y-%m-%d') AS day, count(q) AS points, round(max(q) * 1000, 3) AS most_ms, round(avg(q) * 1000, 3) AS mean_ms
  FROM (SELECT service, point, q FROM (SELECT DISTINCT service, point FROM h) LEFT JOIN q USING (service, point)) GROUP BY ALL""")


def printed_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records and accounting of the logs printed as text files: a service's lines lie in parts that may begin within a record."""
    path = shared_path(spark, "printed")
    lines = raw_lines(spark, sf_dir)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines.repartitionByRange(parts, "file", "line_no").sortWithinPartitions("file", "line_no").select("file", "line").write.partitionBy("file").text(path)
    within = lambda before, after: F.substring_index(F.substring_index("file", before, -1), after, 1)
    read = split_logs.read_splits(spark, path).withColumn("split", F.shiftleft(within("/part-", "-").cast("long"), 40) + F.col("split")).withColumn("file", within("/file=", "/"))
    return split_logs.assemble(read, raw_logs.HADOOP)


def q_split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = printed_records(spark, sf_dir)
    events = split_logs.hadoop_events(split_logs.parsed(records, raw_logs.HADOOP), F.col("file"))
    return events.groupBy("file", "level", "thread", "component", "error_type", "workload_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum("continuations").alias("continuations"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def q_split_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed_records(spark, sf_dir)[1]


def rule_texts(spark: SparkSession) -> DataFrame:
    """The built-in rules as files with a front matter."""

    def text(rule: dict) -> str:
        chosen = [f"  {k}: {v}" for k, v in (("message_regex", json.dumps(rule.get("message_regex"))), ("level", rule.get("levels")), ("first_seen_within_minutes_after_deploy", rule.get("minutes_after_deploy"))) if v not in (None, "null")]
        return "\n".join(["---", f"id: {rule['id']}", f"level: {rule['level']}", f"category: {rule['category']}", "selection:", *chosen, "condition: selection", "---", "", f"# {rule['id']}", "", "Look at it."]).replace("'", "")

    return spark.createDataFrame([(f"{r['id']}.md", text(r)) for r in rules.DETECTIONS], "name string, text string")


def q_rule_file_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from files, matched against all messages of a group."""
    found = rule_files.read_rules(spark, rule_files.write_rules(rule_texts(spark), shared_path(spark, "rules")))
    keys = ["incident", *grouping.GROUP_KEYS]
    patterns = [r["message_regex"] for r in found if r["message_regex"]]
    signed = written(grouping.with_signature(logs(spark, sf_dir)).select(*keys, "ts", "ordinal", "message", "pod", "host"), "signed")
    matched = rule_matcher.group_matches(signed, keys, patterns).select(grouping.event_id([F.col(k) for k in keys]).alias("event_id"), "rules")
    grouped = written(grouping.signed_groups(signed), "groups")
    nearest = correlation.deploys_before(grouped.select("event_id", "service", "first_seen"), deploys(spark, sf_dir)).groupBy("event_id").agg(F.min("minutes_before").alias("after_deploy"))
    return rule_matcher.detections(grouped.join(nearest, "event_id", "left"), matched, ["event_id"], found).select("incident", "event_id", "rule_id", "rule_level", "category", "rule_rank", "n")


def _any_message(rule: dict) -> str:
    inside = f" AND event_id IN (SELECT {log_queries._ID} FROM signed WHERE regexp_matches(message, '(?i){rule['message_regex']}'))" if "message_regex" in rule else ""
    inside += f" AND level IN ({', '.join(repr(x) for x in rule['levels'])})" if "levels" in rule else ""
    inside += f" AND after_deploy BETWEEN 0 AND {rule['minutes_after_deploy']}" if "minutes_after_deploy" in rule else ""
    return f"SELECT incident, event_id, '{rule['id']}' AS rule_id, '{rule['level']}' AS rule_level, '{rule['category']}' AS category, {rules.RULE_LEVELS[rule['level']]} AS rule_rank, n FROM grouped LEFT JOIN near USING (event_id) WHERE true{inside}"


def q_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written as a structured corpus and read back; the event id is joined to the records at the end."""
    path = shared_path(spark, "corpus")
    rows = logs(spark, sf_dir)
    rows.select(F.col("ordinal").cast("string").alias("LineId"), F.date_format("ts", "yyMMdd").alias("Date"), F.date_format("ts", "HHmmss").alias("Time"), F.upper("level").alias("Level"), F.col("service").alias("Component"),
                F.concat(F.lit('said "'), "message", F.lit('", blk_1')).alias("Content"), F.concat(F.lit("E"), (F.col("k") % 7).cast("string")).alias("EventId")).write.options(header=True, escape='"').csv(path)
    found, truth = tabular_logs.records(tabular_logs.read_csv(spark, path), "hdfs")
    return found.join(truth, "line_id").groupBy("component", "level", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.endswith("message", F.lit('", blk_[ID]'))).alias("cleaned"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def q_trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each user and day, one chosen for each day."""
    rows = logs(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "MMdd")).alias("TaskID"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("FirstSeen"),
                                      F.col("event_name").alias("OpName"), F.col("message").alias("Description"), F.col("host").alias("Agent"))
    chosen = tabular_logs.chosen_traces(rows.groupBy("day", "TaskID").agg(F.min("FirstSeen").alias("FirstSeen")), "day")
    found = tabular_logs.trace_records(rows.drop("FirstSeen"), chosen, "day")
    return found.groupBy("day", "execution_id", "level", "component", "event_name").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"))


QUERIES = {
    "csv_records": (q_csv_records, duck("SELECT service AS component, level, 'E' || (k % 7) AS event_id, count(*) AS n, count(*) AS cleaned, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM logs GROUP BY ALL")),
    "trace_records": (q_trace_records, duck("""WITH r AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, user_id || '-' || strftime(ts, '%m%d') AS task FROM logs),
      c AS (SELECT * FROM (SELECT day, task, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY day ORDER BY sha256(task)) = 1)
      SELECT day, 'trace-' || substr(sha256(task), 1, 16) AS execution_id, CASE WHEN regexp_matches(event_name || ': ' || message, '(?i)(connection\\s+(?:reset|refused)|broken\\s+pipe|\\b(?:error|failed|failure)\\b)') THEN 'error' ELSE 'info' END AS level,
        host AS component, event_name, count(*) AS n, max(first_seen) AS first_seen FROM r JOIN c USING (day, task) GROUP BY ALL""")),
    "rule_file_matches": (q_rule_file_matches, log_queries.with_groups(" UNION ALL ".join(_any_message(r) for r in rules.DETECTIONS), log_queries.DEPLOYED)),
    "split_records": (q_split_records, duck("""SELECT service AS file, level, pod AS thread, CASE WHEN contains(message, ': ') THEN split_part(message, ': ', 1) ELSE 'unknown' END AS component,
      CASE WHEN level = 'error' THEN 'java.io.IOException' END AS error_type, 'workload-' || substr(sha256(service), 1, 12) AS workload_id, count(*) AS records,
      CAST(sum(CASE WHEN level = 'error' THEN 2 ELSE 0 END) AS BIGINT) AS continuations, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM logs GROUP BY ALL""")),
    "split_accounting": (q_split_accounting, duck("""SELECT service AS file, count(*) + 2 * count(*) FILTER (level = 'error') + 1 AS physical, count(*) AS "primary", 2 * count(*) FILTER (level = 'error') AS continuation, CAST(1 AS BIGINT) AS orphan FROM logs GROUP BY service""")),
    "budgeted_scan": (q_budgeted_scan, D_BUDGETED),
    "page_status": (q_page_status, D_PAGE_STATUS),
    "metric_results": (q_metric_results, D_METRIC_RESULTS),
    "recent_deploys": (q_recent_deploys, D_RECENT),
    "insights_scan": (q_insights, duck("SELECT service, ordinal, route, status_code, row_number() OVER (PARTITION BY service ORDER BY ts, ordinal) AS rank FROM logs WHERE route IS NOT NULL AND status_code IS NOT NULL QUALIFY rank <= 25")),
    "counter_rates": (q_counter_rates, D_COUNTER_RATES),
    "histogram_quantiles": (q_histogram_quantiles, D_HISTOGRAM),
}
