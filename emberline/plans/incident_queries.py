"""Queries over sanitizers, further candidates, contradictions, audits, traces, the work queue and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import sanitize, text
from emberline.operators import grouping, incidents, queue, ranking, scoring, statistics
from emberline.plans.evidence_queries import _CANDIDATES, _IMPACTS, _TIMELINE, anchored, candidates, impacts, kept_groups, timeline
from emberline.plans.log_queries import DETECTED, SIGNED, d_shown, groups, shown, with_groups
from emberline.plans.statistics_queries import _TRACES, traces
from emberline.sources import relations
from emberline.sources.relations import duck, logs, read
from emberline.storage import written

# Messages in both engines: each names what its sanitizer takes out.
PUBLIC_MESSAGE = "concat('Receiving block blk_-', ordinal, ' src: /10.', k * 4, '.', ordinal % 256, '.1:50010 dest: /user/u', user_id, '/part')"
SPARK_MESSAGE = """CASE k % 4 WHEN 0 THEN concat('Changing view acls to: u', user_id) WHEN 1 THEN concat('container at mesos-slave-', k, ' application_', ordinal, '_', k)
  WHEN 2 THEN concat('file hdfs://10.0.0.', k, ':9000/joe', user_id, '/data') ELSE concat('Set(a, u', k, ') done /usercache/u', user_id, '/appcache') END"""
HADOOP_MESSAGE = "concat('Container_14_', ordinal, '_', k, ' on MSRA-SA-', k, ' /tmp/hadoop-u', user_id, '/x job_14_', k, 'Job from /10.1.1.', k, ':8020')"
INSTANCE_MESSAGE = "concat('[instance: ', substr(md5(CAST(ordinal AS STRING)), 1, 8), '-', substr(md5(CAST(ordinal AS STRING)), 9, 4), '-', substr(md5(CAST(ordinal AS STRING)), 13, 4), '-', substr(md5(CAST(ordinal AS STRING)), 17, 4), '-', substr(md5(CAST(ordinal AS STRING)), 21, 12), '] from 10.400.', k, '.1 up')"
CONFIDENCE_TEXT = "CASE k % 5 WHEN 0 THEN concat('Confidence: High (', k, ')') WHEN 1 THEN concat('cause (low confidence, ~', k, '%)') WHEN 2 THEN 'medium confidence here' WHEN 3 THEN concat('We have HIGH confidence of ', k) ELSE 'none' END"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
_D_PUBLIC = f"regexp_replace(regexp_replace(regexp_replace(%s, '/(?:{_OCTET}\\.){{3}}{_OCTET}:', '/[IP]:', 'g'), '\\bblk_-?\\d+\\b', 'blk_[ID]', 'g'), '/user/[^/\\s,]+', '/user/[USER]', 'g')"


def _rewritten_sql(inner: str, rules: list[tuple[str, str]]) -> str:
    for pattern, instead in rules:
        inner = f"regexp_replace({inner}, '{pattern}', '{instead}', 'g')"
    return inner


def _sanitized(message: str, rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return logs(spark, sf_dir).select("ordinal", rule(F.expr(message)).alias("message"))

    return run


def q_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).select(F.expr(CONFIDENCE_TEXT).alias("said")).select(sanitize.stated_confidence(F.col("said")).alias("c"))
    return rows.groupBy("c.label", "c.percent").agg(F.count(F.lit(1)).alias("n"))


def q_high_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy("service", sanitize.is_high_signal(F.col("level"), F.col("message")).alias("high_signal")).agg(F.count(F.lit(1)).alias("n"))


def q_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", sanitize.shorten(F.col("text")).alias("short"))


def q_hour_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs(spark, sf_dir).groupBy("service", sanitize.hour_cohort(F.col("ts")).alias("cohort")).agg(F.collect_set("level").alias("levels"), F.count(F.lit(1)).alias("n"))
    return found.select("service", "cohort", "n", sanitize.first_by_precedence(F.col("levels"), ["error", "warn", "info"]).alias("status"))


def q_json_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs(spark, sf_dir).groupBy("service").agg(F.sum(sanitize.json_bytes(F.struct("ordinal", "service", "message", "error_type"))).alias("bytes"))


def q_dedup_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping pulls of the logs: the later one wins."""
    rows = logs(spark, sf_dir).select("ts", "message", "service", "level", "ordinal", "k")
    pulls = [rows.filter("k % 3 <> 0").withColumn("pull", F.lit("first")), rows.filter("k % 2 = 0").withColumn("pull", F.lit("second"))]
    return incidents.dedup_union(pulls, ["ts", "message", "service", "level"], "ordinal").groupBy("service", "pull").agg(F.count(F.lit(1)).alias("rows"), F.sum("ordinal").alias("ordinals"))


def rate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change ratio of hourly request counts by day and service: the peak over the first."""
    points = logs(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("incident"), "service", F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return statistics.series_summary(points, ["incident", "service"])


def q_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.traffic_candidates(rate_features(spark, sf_dir).select(F.concat_ws("/", "incident", "service").alias("incident"), "change_ratio"))


D_TRAFFIC = duck("""WITH p AS (SELECT strftime(ts, '%Y-%m-%d') || '/' || service AS incident, date_trunc('hour', ts) AS h, count(*) AS v FROM logs GROUP BY ALL),
  r AS (SELECT incident, round(max(v) / arg_min(v, h), 2) AS ratio FROM p GROUP BY incident)
  SELECT incident, 'candidate-traffic-change' AS candidate_id, 'traffic_change' AS category, CAST(least(55, 15 + floor(ratio * 10)) AS INTEGER) AS score FROM r WHERE ratio >= 1.5""")


def q_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.dependency_candidates(groups(spark, sf_dir))


def q_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and services with error groups whose rate of gateway timeouts is zero."""
    rate = logs(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("incident"), "service").agg((F.count_if(F.col("status_code") == "504") / F.count(F.lit(1))).alias("error_rate"))
    return incidents.contradictions(groups(spark, sf_dir), rate, ["incident", "service"]).select("incident", "service", "error_groups", "error_rate")


def q_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to abstain of every day; days whose last digit is 5 lack a source."""
    found = kept_groups(spark, sf_dir)
    ranked = scoring.rank_candidates(scoring.merge_candidates(candidates(spark, sf_dir, found)), F.lit(False), keep=1 << 20)
    per = ranked.groupBy("incident").agg(F.count(F.lit(1)).alias("candidates"), F.max("top_gap").alias("top_gap"))
    seen = impacts(spark, sf_dir, found).withColumn("category", incidents.direct_category(F.col("signal_family"), F.col("status"))).groupBy("incident").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if("cause_candidate_eligible").alias("eligible"), F.collect_set("category").alias("categories"))
    days = logs(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("incident")).distinct()
    rows = days.join(per, "incident", "left").join(seen, "incident", "left").withColumns({
        "candidates": F.coalesce("candidates", F.lit(0)), "observations": F.coalesce("observations", F.lit(0)), "eligible": F.coalesce("eligible", F.lit(0)),
        "categories": F.coalesce("categories", F.array().cast("array<string>")), "failed_sources": F.when(F.endswith("incident", F.lit("5")), F.array(F.lit("metrics"))).otherwise(F.array().cast("array<string>")),
    })
    return incidents.abstention_reasons(rows).select("incident", "abstain", F.array_join("reasons", "; ").alias("reasons"))


D_ABSTENTION = with_groups("""SELECT incident, len(r) > 0 AS abstain, array_to_string(r, '; ') AS reasons FROM (SELECT incident, list_filter([
    CASE WHEN c = 0 THEN 'no deterministic candidate has supporting evidence' END, CASE WHEN c = 0 AND o > 0 AND e = 0 THEN 'direct signals were observed without an incident-impact link' END,
    CASE WHEN ends_with(incident, '5') THEN 'required evidence source failed: metrics' END, CASE WHEN gap < 15 THEN 'top deterministic candidates are materially tied' END,
    CASE WHEN cats > 1 THEN 'direct observations span competing failure categories' END], lambda x: x IS NOT NULL) AS r
  FROM (SELECT incident, coalesce(c, 0) AS c, gap, coalesce(o, 0) AS o, coalesce(e, 0) AS e, coalesce(cats, 0) AS cats FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS incident FROM logs)
    LEFT JOIN (SELECT incident, count(*) AS c, max(CASE WHEN rank = 1 THEN least(score, 100) - nxt END) AS gap FROM (SELECT *, row_number() OVER w AS rank, lead(least(score, 100)) OVER w AS nxt FROM merged WINDOW w AS (PARTITION BY incident ORDER BY score DESC, merge_key)) GROUP BY incident) USING (incident)
    LEFT JOIN (SELECT incident, count(*) AS o, count(*) FILTER (cause_candidate_eligible) AS e, count(DISTINCT CASE signal_family || '/' || status WHEN 'machine_availability/unavailable' THEN 'machine_down' WHEN 'network_transport/unreachable' THEN 'network_disconnection'
      WHEN 'network_transport/disconnected' THEN 'network_disconnection' WHEN 'storage_capacity/exhausted' THEN 'disk_full' END) AS cats FROM impacts GROUP BY incident) USING (incident)))""", _CANDIDATES)


def q_incident_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections, signals, dependency and traffic in one ranking of each day; a day without deployments lacks that source, gateway timeouts are its error rate."""
    found = kept_groups(spark, sf_dir)
    seen = written(impacts(spark, sf_dir, found).drop("s"), "impacts")
    rows = logs(spark, sf_dir).withColumn("incident", F.date_format("ts", "yyyy-MM-dd"))
    hourly = rows.groupBy("incident", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("value"), F.count_if(F.col("status_code") == "504").alias("bad"), F.count_if(F.col("event_name") == "signup").alias("deploys"))
    hourly = written(hourly, "hourly")
    features = statistics.series_summary(hourly.withColumnRenamed("hour", "ts"), ["incident"]).select("incident", "change_ratio")
    kinds = [ranking.from_detections(anchored(spark, sf_dir, found)), ranking.from_signals(seen), ranking.from_dependencies(found), ranking.from_traffic(features)]
    category = incidents.direct_category(F.col("signal_family"), F.col("status"))
    observed = seen.groupBy("incident").agg(F.count(F.lit(1)).alias("observations"), F.count_if("cause_candidate_eligible").alias("eligible"), F.collect_set(category).alias("observed_categories"))
    loud = found.groupBy("incident").agg(F.bool_or(F.col("level").isin("error", "fatal")).alias("loud"))
    none = F.array().cast("array<string>")
    context = hourly.groupBy("incident").agg(F.sum("bad").alias("bad"), F.sum("deploys").alias("deploys")).join(observed, "incident", "left").join(loud, "incident", "left").select(
        "incident", F.when(F.col("deploys") == 0, F.array(F.lit("deploys"))).otherwise(none).alias("failed_sources"), ((F.col("bad") == 0) & F.coalesce("loud", F.lit(False))).alias("contradicted"),
        F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("eligible", F.lit(0)).alias("eligible"), F.coalesce("observed_categories", none).alias("observed_categories"))
    out = ranking.ranked(reduce(DataFrame.unionByName, kinds), context)
    return out.select("incident", "rank", "candidate_id", "category", F.array_join("categories", ",").alias("categories"), "score", "label", F.array_join("reasons", "; ").alias("reasons"),
                      F.array_join("weaknesses", "; ").alias("weaknesses"), "top_gap", "abstain", F.array_join("abstain_reasons", "; ").alias("abstain_reasons"), "expansion_recommended")


_CASES = f"""{DETECTED}, {_TIMELINE}, {_IMPACTS},
  parts AS (SELECT d.incident, 0 AS kind, ordinal AS place, 'candidate-' || event_id AS id, event_id AS key, category,
      least(100, CASE rule_level WHEN 'critical' THEN 35 WHEN 'high' THEN 30 WHEN 'medium' THEN 18 WHEN 'low' THEN 8 ELSE 10 END + CASE WHEN level IN ('error', 'fatal') THEN 12 ELSE 0 END
      + CASE WHEN epoch_us(anchor_at) - epoch_us(first_seen) BETWEEN 0 AND 900000000 THEN 14 ELSE 0 END + CASE WHEN deploys > 0 THEN 16 ELSE 0 END + CASE WHEN pods >= 2 THEN 5 ELSE 0 END) AS score,
      list_filter(['{ranking.RULE_MATCHED}', CASE WHEN level IN ('error', 'fatal') THEN '{ranking.ERROR_LEVEL}' END, CASE WHEN epoch_us(anchor_at) - epoch_us(first_seen) BETWEEN 0 AND 900000000 THEN '{ranking.BEFORE_ANCHOR}' END,
        CASE WHEN deploys > 0 THEN '{ranking.AFTER_DEPLOY}' END], lambda x: x IS NOT NULL) AS reasons, CAST([] AS VARCHAR[]) AS weaknesses FROM detected d LEFT JOIN anchors USING (incident)
    UNION ALL SELECT incident, 1, 0, 'candidate-signal-' || category, array_to_string(list_sort(list_distinct(list(event_id)))[1:12], ','), category, max(score), ['{ranking.DIRECT}'], [] FROM (
      SELECT *, CASE WHEN recovery THEN least(b, 60) ELSE b END AS score FROM (
        SELECT *, CASE WHEN adverse THEN 78 WHEN category = 'disk_full' THEN 68 ELSE 60 END AS b FROM (
          SELECT *, CASE signal_family WHEN 'machine_availability' THEN 'machine_down' WHEN 'network_transport' THEN 'network_disconnection' ELSE 'disk_full' END AS category FROM impacts WHERE cause_candidate_eligible)))
    GROUP BY incident, category
    UNION ALL SELECT incident, 2, 0, 'candidate-dependency-' || e, e, 'dependency_failure', 42, ['{ranking.NAMED}'], ['{ranking.UNCONFIRMED}'] FROM (SELECT incident, arg_min(event_id, (-n, ordinal)) AS e FROM grouped
      WHERE contains(lower(concat_ws(' ', coalesce(error_type, ''), signature)), 'upstream') OR contains(lower(concat_ws(' ', coalesce(error_type, ''), signature)), 'dependency') GROUP BY incident)
    UNION ALL SELECT incident, 3, 0, 'candidate-traffic-change', 'traffic_change|candidate-traffic-change', 'traffic_change', CAST(least(55, 15 + floor(ratio * 10)) AS INTEGER), ['request rate rose ' || ratio || 'x from first sample'], ['{ranking.NO_BASELINE}']
      FROM (SELECT incident, round(max(v) / arg_min(v, h), 2) AS ratio FROM (SELECT strftime(ts, '%Y-%m-%d') AS incident, date_trunc('hour', ts) AS h, CAST(count(*) AS DOUBLE) AS v FROM logs GROUP BY ALL) GROUP BY incident) WHERE ratio >= 1.5),
  merged_parts AS (SELECT incident, key, min((kind, place, id, category)) AS first_at, max(score) AS score, list(category ORDER BY (kind, place, id, category)) AS cats, flatten(list(reasons ORDER BY (kind, place, id, category))) AS reasons,
    flatten(list(weaknesses ORDER BY (kind, place, id, category))) AS weaknesses FROM parts GROUP BY ALL),
  context AS (SELECT d.incident, deploys = 0 AS failed, bad = 0 AND loud AS contradicted, coalesce(o, 0) AS o, coalesce(e, 0) AS e, coalesce(rivals, 0) AS rivals
    FROM (SELECT strftime(ts, '%Y-%m-%d') AS incident, count(*) FILTER (status_code = '504') AS bad, count(*) FILTER (event_name = 'signup') AS deploys, bool_or(level = 'error') AS loud FROM logs GROUP BY 1) d
    LEFT JOIN (SELECT incident, count(*) AS o, count(*) FILTER (cause_candidate_eligible) AS e, count(DISTINCT CASE signal_family || '/' || status WHEN 'machine_availability/unavailable' THEN 'machine_down' WHEN 'network_transport/unreachable' THEN 'network_disconnection'
      WHEN 'network_transport/disconnected' THEN 'network_disconnection' WHEN 'storage_capacity/exhausted' THEN 'disk_full' END) AS rivals FROM impacts GROUP BY incident) USING (incident)),
  capped AS (SELECT * REPLACE (least(score, CASE WHEN failed THEN 60 ELSE 100 END) AS score) FROM context LEFT JOIN merged_parts USING (incident)),
  placed AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt, count(key) OVER (PARTITION BY incident) AS c FROM capped WINDOW w AS (PARTITION BY incident ORDER BY score DESC, first_at)),
  gaps AS (SELECT *, max(CASE WHEN rank = 1 THEN score - nxt END) OVER (PARTITION BY incident) AS gap FROM placed)"""


def _distinct_sql(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


D_INCIDENT_RANKING = with_groups(f"""SELECT incident, CASE WHEN c > 0 THEN rank END AS rank, first_at[3] AS candidate_id, first_at[4] AS category, array_to_string({_distinct_sql('cats')}, ',') AS categories, score,
    CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score IS NOT NULL THEN 'low' END AS label, array_to_string({_distinct_sql('reasons')}, '; ') AS reasons,
    CASE WHEN key IS NOT NULL THEN array_to_string(list_filter(list_concat({_distinct_sql('weaknesses')}, [CASE WHEN failed THEN 'Missing source data: deploys' END, CASE WHEN contradicted THEN '{ranking.CONFLICT}' END]), lambda x: x IS NOT NULL), '; ') END AS weaknesses,
    gap AS top_gap, failed OR c = 0 OR coalesce(gap < 15, false) OR rivals > 1 AS abstain, array_to_string(list_filter([
    CASE WHEN c = 0 THEN 'no deterministic candidate has supporting evidence' END, CASE WHEN c = 0 AND o > 0 AND e = 0 THEN 'direct signals were observed without an incident-impact link' END,
    CASE WHEN failed THEN 'required evidence source failed: deploys' END, CASE WHEN gap < 15 THEN 'top deterministic candidates are materially tied' END,
    CASE WHEN rivals > 1 THEN 'direct observations span competing failure categories' END], lambda x: x IS NOT NULL), '; ') AS abstain_reasons, failed OR c = 0 OR coalesce(gap < 15, false) OR rivals > 1 AS expansion_recommended
  FROM gaps WHERE rank <= 3""", _CASES)


def q_candidate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates made of logs, with broken fields, by broken rule."""
    rows = logs(spark, sf_dir).select(
        F.col("ordinal").alias("candidate_id"), F.expr("CASE WHEN k % 9 = 0 THEN ' ' ELSE event_name END").alias("title"), F.expr("CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'sure' END").alias("confidence_label"),
        (F.col("k") * 3 - 20).alias("score"), (F.col("k") % 4).alias("rank"), F.expr("CASE WHEN k % 50 = 0 THEN 'known' END").alias("mechanism"))
    return incidents.candidate_violations(rows).groupBy("violation").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first_id"))


def q_impact_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept_groups(spark, sf_dir)
    return incidents.audited_impacts(impacts(spark, sf_dir, found), timeline(spark, sf_dir, found))


D_IMPACT_AUDIT = with_groups("""SELECT incident, count(*) FILTER (impact_status = 'established') AS established, count(*) FILTER (impact_status = 'not_established') AS not_established, count(*) FILTER (impact_status = 'contradicted') AS contradicted,
    count(*) FILTER (cause_candidate_eligible AND m) AS mismatch_candidates, count(*) FILTER (cause_candidate_eligible AND b) AS pre_signal_candidates, count(DISTINCT event_id) FILTER (event_id NOT IN (SELECT event_id FROM timeline)) AS unknown_ids
  FROM impacts LEFT JOIN (SELECT event_id, bool_and(entity_match = 'mismatch') AS m, bool_and(time_relation = 'before') AS b FROM related GROUP BY event_id) USING (event_id) GROUP BY incident""", f"{_TIMELINE}, {_IMPACTS}")


def q_peer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peer features in the finer of two cohort grains (cohort and line), without the policy's verdict."""
    fine = relations.operations(spark, sf_dir).withColumn("cohort", F.concat_ws("|", "cohort", F.split("operation_id", "-")[1]))
    return statistics.peer_baselines(fine).select("operation_id", "peer_count", *[F.round(c, 4).alias(c) for c in ("center", "ratio", "percentile_rank")])


D_PEER_AUDIT = duck("""WITH o AS (SELECT operation_id, cohort || '|' || split_part(operation_id, '-', 2) AS cohort, duration FROM operations),
  p AS (SELECT a.operation_id, a.duration, count(b.operation_id) AS peer_count, median(b.duration) AS center, count(*) FILTER (b.duration <= a.duration) AS below FROM o a LEFT JOIN o b ON a.cohort = b.cohort AND a.operation_id <> b.operation_id GROUP BY ALL)
  SELECT operation_id, peer_count, round(center, 4) AS center, round(CASE WHEN center > 0 THEN duration / center END, 4) AS ratio, round(CASE WHEN peer_count > 0 THEN 100.0 * below / peer_count END, 4) AS percentile_rank FROM p""")


def q_trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).withColumn("trace", F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    found = incidents.trace_spans(rows, F.col("event_name") == "view", F.col("event_name") == "purchase")
    return found.select("trace", shown("first_seen"), shown("last_seen"), "events", "seconds")


def q_trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.trace_lookup(logs(spark, sf_dir).withColumn("trace", F.col("k")))


def q_candidate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all groups by signature in the first ten days of January against the rest."""
    found = grouping.with_signature(logs(spark, sf_dir)).withColumn("candidate", F.concat_ws("|", "service", "signature"))
    parts = [found.filter(when).groupBy("candidate").agg(F.least(F.count(F.lit(1)), F.lit(100)).alias("score")) for when in ("incident <= '2024-01-10'", "incident > '2024-01-10'")]
    return incidents.candidate_changes(*parts, "candidate").groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("new_score", F.lit(0)) - F.coalesce("old_score", F.lit(0))).alias("moved"))


D_CHANGES = duck(f"""WITH {SIGNED}, c AS (SELECT service || '|' || signature AS candidate, least(count(*) FILTER (incident <= '2024-01-10'), 100) AS a, least(count(*) FILTER (incident > '2024-01-10'), 100) AS b FROM signed GROUP BY 1)
  SELECT CASE WHEN a = 0 THEN 'added' WHEN b = 0 THEN 'removed' WHEN a = b THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS moved FROM c GROUP BY 1""")


def q_normal_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that no anomaly names."""
    rows = traces(spark, sf_dir)
    normal = rows.join(rows.filter("event = 'error'").select("trace").distinct(), "trace", "left_anti")
    return normal.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace").alias("traces"))


def q_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_day = logs(spark, sf_dir).groupBy("service", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.create_map(F.lit("error"), F.count_if(F.col("level") == "error"), F.lit("all"), F.count(F.lit(1))).alias("counters"))
    return incidents.merged_counters(per_day, ["service"], "counters")


def q_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.first_per(groups(spark, sf_dir), ["incident", "service"], 2).select("incident", "service", "event_id", "n", F.col("place").cast("long").alias("place"))


def q_scope_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = logs(spark, sf_dir).select("service", F.expr("repeat(event_name, CAST(k AS INT))").alias("pattern"))
    scope = logs(spark, sf_dir).select("service").filter("service <> 'catalog'").distinct()
    return incidents.in_scope(requests, scope).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def q_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir)
    active = rows.filter("event_name = 'click' AND k % 5 IN (0, 1)").groupBy("service").agg(F.count(F.lit(1)).alias("n"))
    found = queue.capacity_gate(rows.filter("event_name = 'error'"), active, "service", 150)
    return found.groupBy("service").agg(F.count(F.lit(1)).alias("sent"), F.count_if("accepted").alias("accepted"), F.max(F.when(F.col("accepted"), F.col("ordinal"))).alias("last_accepted"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).filter("event_name IN ('error', 'purchase')")
    return queue.job_outcomes(rows.select(F.col("user_id").alias("job"), "ts", "ordinal", F.when(F.col("event_name") == "error", "failed").otherwise("completed").alias("outcome")))


def q_job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir)


_OUTCOMES = """h AS (SELECT user_id AS job, ts, ordinal, event_name = 'error' AS failed, count(*) FILTER (event_name = 'error') OVER (PARTITION BY user_id ORDER BY ts, ordinal ROWS UNBOUNDED PRECEDING) AS f FROM logs WHERE event_name IN ('error', 'purchase')),
  e AS (SELECT *, CASE WHEN NOT failed AND f < 3 THEN 'completed' WHEN failed AND f = 3 THEN 'dead_letter' END AS ended FROM h),
  o AS (SELECT job, coalesce(arg_min(ended, (ts, ordinal)) FILTER (ended IS NOT NULL), 'pending') AS status, least(max(f), 3) AS failures, CAST(floor(epoch(max(ts) FILTER (failed))) AS BIGINT) + 30 AS due, arg_max(ordinal, (ts, ordinal)) AS payload FROM e GROUP BY job)"""


def q_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.replays(outcomes(spark, sf_dir))


def q_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = queue.revisions(logs(spark, sf_dir).filter("event_name = 'error'"), "user_id", ["ts", "ordinal"])
    return found.select("user_id", "ordinal", F.col("revision").cast("long").alias("revision"), "is_head")


def q_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assistant's turns as drafts of their conversation."""
    rows = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return queue.drafts(rows, "conv_id", ["turn", "text"], "text").select("conv_id", F.col("version").cast("long").alias("version"), "sha256", "supersedes")


def q_nonces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).select(
        "service", "ts", "ordinal", F.expr("CASE WHEN k % 20 = 0 THEN '' WHEN k % 21 = 0 THEN repeat('n', 129) ELSE concat('n', CAST(floor(ordinal / 2) AS STRING)) END").alias("nonce"),
        F.expr("timestamp_micros(unix_micros(ts) - k * 10000000)").alias("signed_at"))
    return queue.nonce_guard(rows, 300).groupBy("service", "verdict").agg(F.count(F.lit(1)).alias("n"))


def q_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = F.expr("CASE k % 3 WHEN 0 THEN map('service', concat('svc', k % 4), 'severity', 'high') WHEN 1 THEN map('job', concat('job', k % 4), 'env', 'stage', 'alertname', 'Up') ELSE CAST(map() AS MAP<STRING, STRING>) END")
    notes = F.expr("CASE WHEN k % 2 = 0 THEN map('summary', concat('seen ', k)) ELSE map('description', concat('about ', k)) END")
    rows = logs(spark, sf_dir).filter("event_name = 'error'").select(
        "ordinal", F.expr("CASE WHEN k % 5 = 0 THEN service END").alias("service"), F.lit("").alias("environment"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("alertname"),
        F.expr("CASE WHEN k % 7 = 0 THEN 'direct' ELSE '' END").alias("message"), F.lit(None).cast("string").alias("status"), maps.alias("labels"), notes.alias("annotations"))
    return queue.normalize_alerts(rows).drop("labels", "annotations")


D_ALERTS = duck("""SELECT ordinal, coalesce(own, CASE k % 3 WHEN 0 THEN 'svc' || k % 4 WHEN 1 THEN 'job' || k % 4 END, 'unknown') AS service, CASE WHEN k % 3 = 1 THEN 'stage' ELSE 'production' END AS environment, CASE WHEN k % 3 = 0 THEN 'high' ELSE 'unknown' END AS severity,
  coalesce(CASE WHEN k % 3 = 1 THEN 'Up' END, own, 'unknown') AS alertname, CASE WHEN k % 7 = 0 THEN 'direct' WHEN k % 2 = 0 THEN 'seen ' || k ELSE 'about ' || k END AS message, 'firing' AS status
  FROM (SELECT *, CASE WHEN k % 5 = 0 THEN service END AS own FROM logs WHERE event_name = 'error')""")


def q_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = logs(spark, sf_dir).select(
        "ordinal", F.expr("CASE WHEN k % 13 = 0 THEN 'aws.other' ELSE 'aws.cloudwatch' END").alias("source"), F.lit("CloudWatch Alarm State Change").alias("kind"),
        F.concat(F.lit("alarm-"), (F.col("k") % 5).cast("string")).alias("alarm"), F.expr("CASE k % 3 WHEN 0 THEN 'ALARM' WHEN 1 THEN ' ok' ELSE 'INSUFFICIENT_DATA' END").alias("state"))
    mapping = spark.createDataFrame([("alarm-0", "payments", "prod", "high"), ("alarm-1", "auth", "prod", None), ("alarm-2", "search", "stage", ""), ("alarm-3", "", "prod", "low")], "alarm string, service string, environment string, severity string")
    return queue.alarm_alerts(events, mapping).groupBy("service", "environment", "severity", "status", "error_code").agg(F.count(F.lit(1)).alias("n"))


D_ALARMS = duck("""WITH m(alarm, service, environment, severity) AS (VALUES ('alarm-0', 'payments', 'prod', 'high'), ('alarm-1', 'auth', 'prod', NULL), ('alarm-2', 'search', 'stage', ''), ('alarm-3', '', 'prod', 'low')),
  c AS (SELECT m.*, k, CASE WHEN k % 13 = 0 THEN 'unsupported_cloudwatch_event' WHEN m.alarm IS NULL THEN 'unsupported_cloudwatch_alarm' WHEN m.service = '' THEN 'invalid_cloudwatch_mapping' WHEN k % 3 = 2 THEN 'unsupported_cloudwatch_state' END AS error_code
    FROM logs LEFT JOIN m ON m.alarm = 'alarm-' || k % 5)
  SELECT service, environment, coalesce(nullif(severity, ''), 'unknown') AS severity, CASE WHEN error_code IS NULL THEN CASE k % 3 WHEN 0 THEN 'firing' ELSE 'resolved' END END AS status, error_code, count(*) AS n FROM c GROUP BY ALL""")


QUERIES = {
    "sanitized_public": (_sanitized(PUBLIC_MESSAGE, sanitize.public_message), duck(f"SELECT ordinal, {_D_PUBLIC % PUBLIC_MESSAGE} AS message FROM logs")),
    "sanitized_spark": (_sanitized(SPARK_MESSAGE, sanitize.spark_message), duck(f"""SELECT ordinal, {_rewritten_sql(_D_PUBLIC % ('(' + SPARK_MESSAGE + ')'), [
        (r'\bapplication_\d+_\d+\b', 'application_[ID]'), (r'\bmesos-slave-\d+\b', 'mesos-slave-[ID]'), (r'(/usercache/)[^/\s]+', r'\1[USER]'), (r'(hdfs://(?:\[IP\]|[^/\s:]+)(?::\d+)?)/[^/\s]+', r'\1/[USER]'),
        (r'Set\([^)]*\)', 'Set([USER_SET])'), (r'(Changing view acls to: ).*$', r'\1[USER_SET]')])} AS message FROM logs""")),
    "sanitized_hadoop": (_sanitized(HADOOP_MESSAGE, sanitize.hadoop_message), duck(f"""SELECT ordinal, {_rewritten_sql(_D_PUBLIC % HADOOP_MESSAGE, [
        (r'/tmp/hadoop-[^/\s,:]+', '/tmp/hadoop-[USER]'), (r'\bMSRA-SA-\d+\b', '[HOST]'), (r'\bContainer_\d+(?:_\d+)+\b', 'container_[ID]'), (r'\bjob_\d+(?:_\d+)+Job\b', 'job_[ID]Job')])} AS message FROM logs""")),
    "sanitized_instance": (_sanitized(INSTANCE_MESSAGE, sanitize.instance_message), duck("SELECT ordinal, '[instance: [UUID]] from [IP] up' AS message FROM logs")),
    "stated_confidence": (q_confidence, duck("SELECT CASE k % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' END AS label, CASE k % 5 WHEN 2 THEN '' WHEN 4 THEN NULL ELSE CAST(k AS VARCHAR) END AS percent, count(*) AS n FROM logs GROUP BY ALL")),
    "incident_ranking": (q_incident_ranking, D_INCIDENT_RANKING),
    "high_signal": (q_high_signal, duck("SELECT service, level IN ('error', 'warn') OR regexp_matches(message, '(?i)(error|exception|timeout|failed|lost|refused|exhausted|oomkilled|no space left|disk full|exit code|killed)') AS high_signal, count(*) AS n FROM logs GROUP BY ALL")),
    "shortened_texts": (q_shortened, "SELECT doc_id, CASE WHEN length(t) <= 70 THEN t ELSE substr(t, 1, 67) || '...' END AS short FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents)"),
    "hour_cohorts": (q_hour_cohorts, duck("SELECT service, strftime(ts, '%Y-%m-%dT%H:00Z') AS cohort, count(*) AS n, CASE WHEN bool_or(level = 'error') THEN 'error' WHEN bool_or(level = 'warn') THEN 'warn' ELSE 'info' END AS status FROM logs GROUP BY 1, 2")),
    "json_sizes": (q_json_sizes, duck("SELECT service, CAST(sum(strlen(to_json({'ordinal': ordinal, 'service': service, 'message': message, 'error_type': error_type}))) AS BIGINT) AS bytes FROM logs GROUP BY service")),
    "dedup_union": (q_dedup_union, duck("""WITH u AS (SELECT *, 'first' AS pull, 0 AS i FROM logs WHERE k % 3 <> 0 UNION ALL SELECT *, 'second', 1 FROM logs WHERE k % 2 = 0)
      SELECT service, pull, count(*) AS rows, CAST(sum(ordinal) AS BIGINT) AS ordinals FROM (SELECT *, row_number() OVER (PARTITION BY ts, message, service, level ORDER BY i DESC, ordinal DESC) AS r FROM u) WHERE r = 1 GROUP BY ALL""")),
    "traffic_candidates": (q_traffic, D_TRAFFIC),
    "dependency_candidates": (q_dependency, with_groups("""SELECT incident, arg_min(event_id, (-n, ordinal)) AS event_id, 'candidate-dependency-' || arg_min(event_id, (-n, ordinal)) AS candidate_id, 'dependency_failure' AS category, 42 AS score
      FROM grouped WHERE contains(lower(coalesce(error_type, '') || ' ' || signature), 'upstream') OR contains(lower(coalesce(error_type, '') || ' ' || signature), 'dependency') GROUP BY incident""")),
    "contradictions": (q_contradictions, with_groups("""SELECT incident, service, error_groups, error_rate FROM (SELECT incident, service, count(*) AS error_groups FROM grouped WHERE level IN ('error', 'fatal') GROUP BY ALL)
      JOIN (SELECT strftime(ts, '%Y-%m-%d') AS incident, service, count(*) FILTER (status_code = '504') / count(*) AS error_rate FROM logs GROUP BY ALL) USING (incident, service) WHERE error_rate <= 0""")),
    "abstention_reasons": (q_abstention, D_ABSTENTION),
    "candidate_contract": (q_candidate_contract, duck("""WITH v AS (SELECT ordinal, unnest(list_filter([CASE WHEN k % 9 = 0 THEN 'missing_text' END, CASE WHEN k % 4 >= 2 THEN 'confidence_label' END, CASE WHEN k * 3 - 20 NOT BETWEEN 0 AND 100 THEN 'score_range' END,
      CASE WHEN k % 4 < 1 THEN 'rank_range' END, CASE WHEN k % 50 = 0 THEN 'claims_mechanism' END], lambda x: x IS NOT NULL)) AS violation FROM logs) SELECT violation, count(*) AS n, min(ordinal) AS first_id FROM v GROUP BY violation""")),
    "impact_audit": (q_impact_audit, D_IMPACT_AUDIT),
    "peer_audit": (q_peer_audit, D_PEER_AUDIT),
    "trace_spans": (q_trace_spans, duck(f"""SELECT trace, {d_shown('min(ts)')} AS first_seen, {d_shown('max(ts)')} AS last_seen, count(*) AS events,
      CASE WHEN epoch_us(min(ts) FILTER (event_name = 'purchase')) >= epoch_us(min(ts) FILTER (event_name = 'view')) THEN round((epoch_us(min(ts) FILTER (event_name = 'purchase')) - epoch_us(min(ts) FILTER (event_name = 'view'))) / 1000000.0, 3) END AS seconds
      FROM (SELECT *, user_id || '/' || strftime(ts, '%Y-%m-%d') AS trace FROM logs) GROUP BY trace""")),
    "trace_lookup": (q_trace_lookup, duck("""SELECT trace, string_agg(service, ',' ORDER BY service) AS services, CAST(sum(least(n, 50)) AS BIGINT) AS total, bool_and(n <= 50) AS exact FROM (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY service) AS r FROM
      (SELECT k AS trace, service, count(*) AS n FROM logs GROUP BY ALL)) WHERE r <= 3 GROUP BY trace""")),
    "candidate_changes": (q_candidate_changes, D_CHANGES),
    "normal_traces": (q_normal_traces, duck(f"WITH {_TRACES} SELECT event, count(*) AS n, count(DISTINCT trace) AS traces FROM traces WHERE trace NOT IN (SELECT trace FROM traces WHERE event = 'error') GROUP BY event")),
    "merged_counters": (q_counters, duck("SELECT service, 'all' AS name, count(*) AS value FROM logs GROUP BY service UNION ALL SELECT service, 'error', count(*) FILTER (level = 'error') FROM logs GROUP BY service")),
    "top_groups": (q_top_groups, with_groups("SELECT incident, service, event_id, n, row_number() OVER (PARTITION BY incident, service ORDER BY n DESC, ordinal) AS place FROM grouped QUALIFY place <= 2")),
    "scope_guard": (q_scope_guard, duck("SELECT CASE WHEN service = 'catalog' THEN 'out_of_scope' WHEN length(event_name) * k > 240 THEN 'pattern_too_long' ELSE 'ok' END AS verdict, count(*) AS n FROM logs GROUP BY 1")),
    "capacity_gate": (q_capacity, duck("""WITH a AS (SELECT service, count(*) FILTER (event_name = 'click' AND k % 5 IN (0, 1)) AS n FROM logs GROUP BY service), e AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts, ordinal) AS r FROM logs WHERE event_name = 'error')
      SELECT service, count(*) AS sent, count(*) FILTER (r <= greatest(150 - n, 0)) AS accepted, max(ordinal) FILTER (r <= greatest(150 - n, 0)) AS last_accepted FROM e JOIN a USING (service) GROUP BY service""")),
    "job_outcomes": (q_job_outcomes, duck(f"WITH {_OUTCOMES} SELECT job, status, failures, CASE WHEN status = 'pending' THEN due END AS available_at, payload FROM o")),
    "replayed_jobs": (q_replays, duck(f"WITH {_OUTCOMES} SELECT 'replay-' || job AS job, job AS replay_of, 'pending' AS status, payload FROM o WHERE status = 'dead_letter'")),
    "analysis_revisions": (q_revisions, duck("SELECT user_id, ordinal, row_number() OVER (PARTITION BY user_id ORDER BY ts, ordinal) AS revision, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, ordinal DESC) = 1 AS is_head FROM logs WHERE event_name = 'error'")),
    "draft_versions": (q_drafts, "SELECT conv_id, row_number() OVER w AS version, sha256(coalesce(text, '')) AS sha256, lag(sha256(coalesce(text, ''))) OVER w AS supersedes FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)"),
    "nonce_guard": (q_nonces, duck("""WITH c AS (SELECT *, CASE WHEN k % 20 = 0 THEN '' WHEN k % 21 = 0 THEN repeat('n', 129) ELSE 'n' || CAST(floor(ordinal / 2) AS BIGINT) END AS nonce FROM logs), d AS (SELECT *, length(nonce) BETWEEN 1 AND 128 AS b, length(nonce) BETWEEN 1 AND 128 AND k * 10 <= 300 AS u FROM c),
      e AS (SELECT *, row_number() OVER (PARTITION BY nonce, u ORDER BY ts, ordinal) AS r FROM d) SELECT service, CASE WHEN NOT b THEN 'invalid_signature_nonce' WHEN NOT u THEN 'signature_timestamp_outside_window' WHEN r > 1 THEN 'replayed_signature_nonce' ELSE 'accepted' END AS verdict, count(*) AS n FROM e GROUP BY ALL""")),
    "alert_fields": (q_alerts, D_ALERTS),
    "alarm_alerts": (q_alarms, D_ALARMS),
}
