"""Queries over evidence groups: deployments, anchors, links, signals, impact, candidates, severity, scope, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import correlation, sampling, scoring
from emberline.plans.log_queries import DEPLOYED, DETECTED, SIGNALLED, d_shown, detected, groups, shown, with_groups
from emberline.sources import relations
from emberline.sources.relations import duck, logs
from emberline.storage import written

# Services as a registry: tier and customer-facing by name, each depending on the two before it.
REGISTRY = [("payments", 0, True, ["auth"]), ("checkout", 1, True, ["payments", "auth"]), ("auth", 1, False, ["catalog"]), ("search", 2, True, ["catalog"])]
_REGISTRY = "registry(service, tier, customer_facing) AS (VALUES ('payments', 0, true), ('checkout', 1, true), ('auth', 1, false), ('search', 2, true))"
_EDGES = """down(service, related) AS (VALUES ('payments', 'auth'), ('checkout', 'payments'), ('checkout', 'auth'), ('auth', 'catalog'), ('search', 'catalog')),
  edges AS (SELECT service, related, 'depends_on' AS direction FROM down UNION SELECT related, service, 'depended_on_by' FROM down)"""


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTRY, "service string, tier int, customer_facing boolean, dependencies array<string>")


def enriched(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Tier 2 and not customer-facing where the registry doesn't know a service. The registry is configuration and small."""
    return found.join(F.broadcast(registry(spark).drop("dependencies")), "service", "left").fillna({"tier": 2, "customer_facing": False})


def q_service_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, groups(spark, sf_dir)).groupBy("service", "tier", "customer_facing").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("records"))


def q_deploy_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlation.deploys_before(groups(spark, sf_dir).select("event_id", "service", "first_seen"), relations.deploys(spark, sf_dir))
    return found.select("event_id", "deploy_id", "commit", "minutes_before")


def q_deploy_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept_groups(spark, sf_dir)
    near = correlation.deploys_before(found.select("event_id", "service", "first_seen"), relations.deploys(spark, sf_dir)).select("event_id")
    return found.join(near, "event_id", "left_semi").groupBy("service").agg(F.count(F.lit(1)).alias("groups"))


def q_latest_deploy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlation.latest_deploy(groups(spark, sf_dir).select("event_id", "service", "first_seen"), relations.deploys(spark, sf_dir))
    return found.select("event_id", "deploy_id", "commit")


def kept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, written once for queries that use them several times."""
    return written(groups(spark, sf_dir), "groups")


def timeline(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Groups (`found`, if they are at hand) and deployments as events of their day."""
    g = (found or groups(spark, sf_dir)).select("incident", "event_id", F.lit("log_group").alias("kind"), "service", "level", F.col("first_seen").alias("at"), "ordinal")
    d = relations.deploys(spark, sf_dir).select(
        F.date_format("deployed_at", "yyyy-MM-dd").alias("incident"), F.concat(F.lit("dep-"), F.col("deploy_id").cast("string")).alias("event_id"), F.lit("deploy").alias("kind"),
        "service", F.lit(None).cast("string").alias("level"), F.col("deployed_at").alias("at"), F.col("deploy_id").alias("ordinal"))
    return g.unionByName(d)


def kept_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline, written once for queries that join its events with their anchors."""
    return written(timeline(spark, sf_dir), "timeline")


_TIMELINE = """timeline AS (SELECT incident, event_id, 'log_group' AS kind, service, level, first_seen AS happened, ordinal FROM grouped
  UNION ALL SELECT strftime(deployed_at, '%Y-%m-%d'), 'dep-' || deploy_id, 'deploy', service, NULL, deployed_at, deploy_id FROM deploys),
  anchors AS (SELECT incident, event_id AS anchor_id, service AS anchor_service, happened AS anchor_at FROM timeline
    QUALIFY row_number() OVER (PARTITION BY incident ORDER BY CASE WHEN kind = 'log_group' AND level IN ('error', 'warn') THEN 1 ELSE 2 END, happened, ordinal) = 1)"""


def q_anchor_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.pick_anchor(timeline(spark, sf_dir)).select("incident", "anchor_id", "anchor_service", shown("anchor_at"))


def q_temporal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = kept_timeline(spark, sf_dir)
    return correlation.temporal_links(events, correlation.pick_anchor(events)).select("incident", "event_id", "anchor_id", "relationship", "confidence", "offset")


def q_entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = kept_timeline(spark, sf_dir)
    links = correlation.with_anchors(events, correlation.pick_anchor(events)).filter("service = anchor_service")
    return links.groupBy("incident", "anchor_service").agg(F.count(F.lit(1)).alias("links"))


def q_change_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = correlation.change_links(groups(spark, sf_dir).select("incident", "event_id", "service", "first_seen"), relations.deploys(spark, sf_dir))
    return links.groupBy("incident", "service").agg(F.count(F.lit(1)).alias("links"), F.max("deploy_id").alias("last_deploy"))


def q_topology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = correlation.dependency_edges(registry(spark))
    events = timeline(spark, sf_dir)
    near = events.join(correlation.pick_anchor(events), "incident").join(
        F.broadcast(edges.select(F.col("service").alias("anchor_service"), F.col("related").alias("service"), "direction")), ["anchor_service", "service"])
    return near.groupBy("incident", "anchor_service", "service", "direction").agg(F.count(F.lit(1)).alias("events"))


def q_scope_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timeline(spark, sf_dir)
    alerted = correlation.pick_anchor(events).select("incident", F.col("anchor_service").alias("service"))
    loud = groups(spark, sf_dir).filter("level = 'error' AND n >= 3").select("incident", "service").distinct()
    found = correlation.scope(alerted, loud, correlation.dependency_edges(registry(spark)), keep=3)
    return found.select("incident", "service", "step", F.col("position").cast("long").alias("position"))


def signals(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    found = found or groups(spark, sf_dir)
    return found.select(
        "incident", "event_id", "service", "n", "hosts", "first_seen", "last_seen", text.operation_effect(F.col("example_message")).alias("effect"),
        F.explode(text.detect_signals(F.col("example_message"), F.col("level"))).alias("s"),
    ).select("*", "s.signal_family", "s.status", "s.scope").drop("s")


def lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as finished jobs (one in three failed, one in three resumed) by day and host, with executions by pod."""
    status = F.expr("CASE k % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'succeeded' ELSE 'resumed' END")
    rows = logs(spark, sf_dir).filter("event_name = 'purchase'").select(F.date_format("ts", "yyyy-MM-dd").alias("incident"), status.alias("status"), "host", "ts", "ordinal")
    return rows.groupBy("incident", "status", "host").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.concat(F.lit("job-"), F.min("ordinal").cast("string")).alias("event_id"),
    ).select("incident", "event_id", "status", "first_seen", "last_seen", F.array(F.concat(F.lit("x"), "host")).alias("execution_ids"),
             F.array().cast("array<string>").alias("workload_ids"), F.array("host").alias("hosts"), F.array().cast("array<string>").alias("pods"))


def _related(found: DataFrame) -> DataFrame:
    """Groups with a classified signal, one row each. `found`: signals."""
    return found.filter("signal_family <> 'unclassified_error'").select(
        "incident", "event_id", "first_seen", "last_seen", F.when(F.size("hosts") == 1, F.transform("hosts", lambda h: F.concat(F.lit("x"), h))).otherwise(F.array(F.lit("other"))).alias("execution_ids"),
        F.array().cast("array<string>").alias("workload_ids"), "hosts", F.array().cast("array<string>").alias("pods")).distinct()


def lifecycle_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.lifecycle_relations(_related(signals(spark, sf_dir)), lifecycles(spark, sf_dir))


_RELATED = SIGNALLED + """, jobs AS (SELECT strftime(ts, '%Y-%m-%d') AS incident, CASE k % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'succeeded' ELSE 'resumed' END AS l_status, host,
    min(ts) AS l_first, max(ts) AS l_last, 'job-' || min(ordinal) AS l_event_id FROM logs WHERE event_name = 'purchase' GROUP BY ALL),
  lefts AS (SELECT DISTINCT g.incident, g.event_id, g.first_seen, g.last_seen, g.hosts, CASE WHEN len(g.hosts) = 1 THEN ['x' || g.hosts[1]] ELSE ['other'] END AS xs
    FROM signals s JOIN grouped g USING (event_id) WHERE signal_family <> 'unclassified_error'),
  r0 AS (SELECT l.*, j.l_event_id, j.l_status, list_contains(xs, 'x' || j.host) AS same_x, list_contains(hosts, j.host) AS same_host,
    CASE WHEN l_last < first_seen THEN 'before' WHEN l_first > last_seen THEN 'after' ELSE 'during' END AS time_relation,
    CASE l_status WHEN 'failed' THEN 'adverse' WHEN 'succeeded' THEN 'successful_completion' ELSE 'recovery' END AS outcome_role FROM lefts l JOIN jobs j USING (incident)),
  r1 AS (SELECT *, CASE WHEN same_x OR same_host THEN 'exact' ELSE 'mismatch' END AS entity_match, NOT same_x AS conflict FROM r0),
  related AS (SELECT *, entity_match = 'exact' AND time_relation IN ('during', 'after') AND NOT (outcome_role = 'adverse' AND conflict) AS accepted FROM r1)"""


def q_lifecycle_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle_relations(spark, sf_dir).select("incident", "event_id", "l_event_id", "entity_match", "time_relation", "outcome_role", "accepted", "rejection_reason", "confidence")


def impacts(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """Signals with their impact; no pair of a signal and a lifecycle group is formed that is rejected."""
    seen = signals(spark, sf_dir, found or kept_groups(spark, sf_dir))
    return correlation.assessed_impacts(seen, correlation.relation_summary(_related(seen), written(lifecycles(spark, sf_dir), "lifecycles")))


_IMPACTS = _RELATED + """, per AS (SELECT event_id, bool_or(accepted AND outcome_role = 'adverse') AS adverse, bool_or(accepted AND outcome_role = 'recovery') AS recovery,
    bool_or(accepted AND outcome_role = 'successful_completion') AS completion, count(*) FILTER (accepted) AS accepted_links, count(*) FILTER (NOT accepted) AS rejected_links FROM related GROUP BY event_id),
  i0 AS (SELECT s.*, g.service, g.n, g.first_seen, g.last_seen, g.hosts, coalesce(adverse, false) AS adverse, coalesce(recovery, false) AS recovery, coalesce(completion, false) AS completion,
    coalesce(accepted_links, 0) AS accepted_links, coalesce(rejected_links, 0) AS rejected_links,
    CASE s.signal_family WHEN 'network_transport' THEN 'transport_failure' WHEN 'storage_capacity' THEN 'capacity_failure' END AS failure_condition
    FROM signals s JOIN grouped g USING (event_id) LEFT JOIN per USING (event_id)),
  i1 AS (SELECT *, adverse OR (failure_condition IS NOT NULL AND NOT (recovery OR completion)) AS established FROM i0),
  impacts AS (SELECT *, CASE WHEN established THEN 'established' WHEN recovery OR completion THEN 'contradicted' ELSE 'not_established' END AS impact_status,
    established AND signal_family || '/' || status IN ('machine_availability/unavailable', 'network_transport/unreachable', 'network_transport/disconnected', 'storage_capacity/exhausted') AS cause_candidate_eligible FROM i1)"""


def q_impact_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts(spark, sf_dir).select("incident", "event_id", "signal_family", "status", "failure_condition", "adverse", "recovery", "completion", "accepted_links", "rejected_links", "impact_status", "cause_candidate_eligible")


def q_observation_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = correlation.observation_patterns(impacts(spark, sf_dir))
    return found.select("incident", "service", "signal_family", "status", "scope", "impact_status", "cause_candidate_eligible", "occurrences", "groups", shown("first_seen"), shown("last_seen"), "entity_unique", "entity_sample")


def anchored(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Detections with the anchor of their day."""
    anchors = correlation.pick_anchor(timeline(spark, sf_dir, found)).select("incident", "anchor_at")
    return detected(spark, sf_dir, found).join(anchors, "incident", "left")


def candidates(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    found = found or kept_groups(spark, sf_dir)
    return scoring.detection_candidates(anchored(spark, sf_dir, found)).unionByName(scoring.signal_candidates(impacts(spark, sf_dir, found)))


_CANDIDATES = f"""{DETECTED}, {_TIMELINE}, {_IMPACTS},
  candidates AS (SELECT d.incident, event_id, 'candidate-' || event_id AS candidate_id, category,
      CASE rule_level WHEN 'critical' THEN 35 WHEN 'high' THEN 30 WHEN 'medium' THEN 18 WHEN 'low' THEN 8 ELSE 10 END + CASE WHEN level IN ('error', 'fatal') THEN 12 ELSE 0 END
      + CASE WHEN epoch_us(anchor_at) - epoch_us(first_seen) BETWEEN 0 AND 900000000 THEN 14 ELSE 0 END + CASE WHEN deploys > 0 THEN 16 ELSE 0 END + CASE WHEN pods >= 2 THEN 5 ELSE 0 END AS score
    FROM detected d LEFT JOIN anchors USING (incident)
    UNION ALL SELECT incident, array_to_string(list_sort(list_distinct(list(event_id)))[1:12], ','), 'candidate-signal-' || category, category, max(score) FROM (
      SELECT *, CASE WHEN recovery THEN least(b, 60) ELSE b END AS score FROM (
        SELECT *, CASE WHEN adverse THEN 78 WHEN category = 'disk_full' THEN 68 ELSE 60 END AS b FROM (
          SELECT *, CASE signal_family WHEN 'machine_availability' THEN 'machine_down' WHEN 'network_transport' THEN 'network_disconnection' ELSE 'disk_full' END AS category FROM impacts WHERE cause_candidate_eligible)))
    GROUP BY incident, category),
  merged AS (SELECT incident, event_id AS merge_key, max(score) AS score, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS rules FROM candidates GROUP BY ALL)"""


def q_candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = scoring.rank_candidates(scoring.merge_candidates(candidates(spark, sf_dir)), F.lit(False))
    return ranked.select("incident", "merge_key", "score", "categories", "rules", F.col("rank").cast("long").alias("rank"), "top_gap", "label", "abstain")


D_CANDIDATE_RANKING = with_groups("""SELECT * FROM (SELECT incident, merge_key, score, categories, rules, rank, max(CASE WHEN rank = 1 THEN score - nxt END) OVER (PARTITION BY incident) AS top_gap,
    CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS label, coalesce(max(CASE WHEN rank = 1 THEN score - nxt END) OVER (PARTITION BY incident), 100) < 15 AS abstain
  FROM (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM merged WINDOW w AS (PARTITION BY incident ORDER BY score DESC, merge_key))) WHERE rank <= 3""", _CANDIDATES)


def q_severity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = groups(spark, sf_dir).groupBy("incident", "service").agg(F.when(F.max(F.when(F.col("level") == "error", 2).when(F.col("level") == "warn", 1).otherwise(0)) == 2, "critical").otherwise("warning").alias("alert"), F.sum("n").alias("records"))
    found = enriched(spark, worst).withColumn("severity", scoring.severity(F.col("tier"), F.col("alert"), F.col("customer_facing")))
    return found.select("incident", "service", "alert", "severity", scoring.fetch_limit(F.col("severity")).alias("fetch_limit"))


_WORST = _REGISTRY + """, worst AS (SELECT incident, service, CASE WHEN bool_or(level = 'error') THEN 'critical' ELSE 'warning' END AS alert FROM grouped GROUP BY ALL),
  ranked AS (SELECT incident, service, alert, coalesce(tier, 2) AS tier, coalesce(customer_facing, false) AS facing FROM worst LEFT JOIN registry USING (service)),
  severed AS (SELECT *, CASE WHEN tier = 0 THEN 'SEV2' WHEN tier = 1 AND alert = 'critical' THEN 'SEV2' WHEN tier = 1 THEN 'SEV3' WHEN alert = 'critical' AND facing THEN 'SEV3' ELSE 'SEV4' END AS severity FROM ranked)"""


def q_severity_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = logs(spark, sf_dir).withColumn("incident", F.date_format("ts", "yyyy-MM-dd")).groupBy("incident", "service").agg((F.count_if(F.col("level") == "error") / F.count(F.lit(1))).alias("error_rate"))
    found = enriched(spark, rate).withColumn("before", F.lit("SEV4"))
    return found.select("incident", "service", F.round("error_rate", 4).alias("error_rate"), scoring.escalate(F.col("before"), F.col("tier"), F.col("error_rate")).alias("severity"))


def q_family_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = kept_groups(spark, sf_dir).withColumn("signals", text.detect_signals(F.col("example_message"), F.col("level")))
    found = seen.withColumn("families", F.array_distinct(F.transform("signals", lambda s: s["signal_family"]))).withColumn("direct", F.exists("signals", lambda s: s["directness"] == "direct"))
    return sampling.family_cover(found, keep=5).select("incident", "event_id", F.col("rank").cast("long").alias("rank"))


def q_rare_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rarest(groups(spark, sf_dir)).select("incident", "event_id", "n", F.col("rank").cast("long").alias("rank"))


def q_review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's hypotheses (ranks from its events) against candidates (ranks of its levels)."""
    day = logs(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("incident")).agg(
        F.array_sort(F.collect_set((F.col("k") % 4).cast("int"))).alias("a"), F.sum("k").alias("total"))
    rows = day.select("incident", F.filter("a", lambda x: x != F.pmod("total", F.lit(4))).alias("hypothesis_ranks"), F.array(F.pmod("total", F.lit(4)).cast("int"), F.lit(2)).alias("candidate_ranks"),
                      (F.col("total") % 5 != 0).alias("quality_ok"), (F.col("total") % 7 != 0).alias("grounding_ok"), (F.col("total") % 11 == 0).alias("abstained"))
    return scoring.review_gate(rows).select("incident", "reason", F.array_join("approvable", ",").alias("approvable"))


D_REVIEW_GATE = duck("""WITH day AS (SELECT strftime(ts, '%Y-%m-%d') AS incident, list_sort(list_distinct(list(CAST(k % 4 AS INTEGER)))) AS a, CAST(sum(k) AS BIGINT) AS total FROM logs GROUP BY 1),
  r AS (SELECT incident, total, list_filter(a, lambda x: x <> total % 4) AS h, list_distinct([CAST(total % 4 AS INTEGER), 2]) AS c FROM day),
  s AS (SELECT *, list_sort(list_intersect(h, c)) AS shared FROM r),
  t AS (SELECT *, CASE WHEN total % 11 = 0 THEN 'analysis_abstained' WHEN total % 5 = 0 THEN 'quality_failed' WHEN total % 7 = 0 THEN 'grounding_failed' WHEN len(shared) = 0 THEN 'no_shared_rank' END AS reason FROM s)
  SELECT incident, reason, CASE WHEN reason IS NULL THEN array_to_string(shared, ',') ELSE '' END AS approvable FROM t""")


def q_claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that cite events of their day, one in three with an id that doesn't exist."""
    found = groups(spark, sf_dir).filter("level = 'error'")
    claims = found.select("incident", F.concat(F.lit("claim-"), "event_id").alias("claim_id"), F.lit("cause").alias("role"), F.when(F.col("n") % 3 == 0, F.array("event_id", F.lit("log-none"))).when(
        F.col("n") % 3 == 1, F.array("event_id")).otherwise(F.array(F.lit("log-none"))).alias("evidence_ids"), F.lit(85).alias("confidence"))
    known = found.groupBy("incident").agg(F.collect_set("event_id").alias("ids")).withColumn("role", F.lit("cause"))
    return scoring.ground_claims(claims, known).select("incident", "claim_id", F.array_join("grounded_ids", ",").alias("grounded_ids"), "verdict", "confidence")


def q_action_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE k % 4 WHEN 0 THEN 'Check pool size' WHEN 1 THEN concat('Restart pod ', pod) WHEN 2 THEN 'We restarted the service' ELSE 'unclear' END")
    return logs(spark, sf_dir).groupBy(text.action_class(said).alias("action_class")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "service_enrich": (q_service_enrich, with_groups("SELECT service, coalesce(tier, 2) AS tier, coalesce(customer_facing, false) AS customer_facing, count(*) AS groups, CAST(sum(n) AS BIGINT) AS records FROM grouped LEFT JOIN registry USING (service) GROUP BY ALL", _REGISTRY)),
    "deploy_interval_join": (q_deploy_interval, with_groups("""SELECT event_id, deploy_id, commit, round((epoch_us(first_seen) - epoch_us(deployed_at)) / 60000000.0, 1) AS minutes_before FROM grouped g JOIN deploys d
      ON g.service = d.service AND d.deployed_at <= g.first_seen AND epoch_us(first_seen) - epoch_us(deployed_at) <= 900000000""")),
    "deploy_window_semi": (q_deploy_semi, with_groups("SELECT service, count(*) AS groups FROM grouped WHERE event_id IN (SELECT event_id FROM near) GROUP BY service", DEPLOYED)),
    "latest_deploy_asof": (q_latest_deploy, with_groups("SELECT event_id, deploy_id, commit FROM grouped g ASOF LEFT JOIN deploys d ON g.service = d.service AND g.first_seen >= d.deployed_at")),
    "anchor_pick": (q_anchor_pick, with_groups(f"SELECT incident, anchor_id, anchor_service, {d_shown('anchor_at')} AS anchor_at FROM anchors", _TIMELINE)),
    "temporal_links": (q_temporal_links, with_groups("""SELECT incident, event_id, anchor_id, CASE WHEN happened < anchor_at THEN 'precedes_anchor' WHEN happened > anchor_at THEN 'follows_anchor' ELSE 'coincides_with_anchor' END AS relationship, 95 AS confidence,
      'T' || CASE WHEN happened < anchor_at THEN '-' ELSE '+' END || CASE WHEN s >= 3600 THEN (s // 3600) || 'h' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' ELSE (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' END AS "offset"
      FROM (SELECT *, abs(epoch_us(happened) - epoch_us(anchor_at)) // 1000000 AS s FROM timeline JOIN anchors USING (incident)) WHERE event_id <> anchor_id""", _TIMELINE)),
    "entity_links": (q_entity_links, with_groups("SELECT incident, anchor_service, count(*) AS links FROM timeline JOIN anchors USING (incident) WHERE event_id <> anchor_id AND service = anchor_service GROUP BY ALL", _TIMELINE)),
    "change_links": (q_change_links, with_groups("""SELECT incident, g.service, count(*) AS links, max(deploy_id) AS last_deploy FROM grouped g JOIN deploys d ON g.service = d.service AND incident = strftime(deployed_at, '%Y-%m-%d')
      AND deployed_at <= first_seen GROUP BY ALL""")),
    "topology_edges": (q_topology_edges, with_groups("""SELECT incident, anchor_service, t.service, direction, count(*) AS events FROM timeline t JOIN anchors USING (incident) JOIN edges e ON e.service = anchor_service AND e.related = t.service GROUP BY ALL""", f"{_TIMELINE}, {_EDGES}")),
    "scope_expansion": (q_scope_expansion, with_groups("""SELECT incident, service, step, position FROM (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY step, service) AS position FROM (SELECT incident, service, min(step) AS step FROM (
      SELECT incident, anchor_service AS service, 0 AS step FROM anchors UNION ALL SELECT incident, service, 1 FROM grouped WHERE level = 'error' AND n >= 3
      UNION ALL SELECT incident, related, 2 FROM anchors JOIN edges ON anchor_service = edges.service) GROUP BY ALL)) WHERE position <= 3""", f"{_TIMELINE}, {_EDGES}")),
    "lifecycle_relations": (q_lifecycle_relations, with_groups("""SELECT incident, event_id, l_event_id, entity_match, time_relation, outcome_role, accepted, CASE WHEN accepted THEN NULL WHEN outcome_role = 'adverse' AND conflict THEN 'adverse_outcome_execution_mismatch'
      WHEN entity_match = 'mismatch' THEN 'entity_mismatch' ELSE 'outcome_precedes_signal' END AS rejection_reason, CASE WHEN accepted THEN 90 END AS confidence FROM related""", _RELATED)),
    "impact_assessment": (q_impact_assessment, with_groups("SELECT incident, event_id, signal_family, status, failure_condition, adverse, recovery, completion, accepted_links, rejected_links, impact_status, cause_candidate_eligible FROM impacts", _IMPACTS)),
    "observation_patterns": (q_observation_patterns, with_groups(f"""SELECT incident, service, signal_family, status, scope, impact_status, cause_candidate_eligible, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS groups, {d_shown('min(first_seen)')} AS first_seen, {d_shown('max(last_seen)')} AS last_seen,
      CAST(len(list_distinct(flatten(list(hosts)))) AS INTEGER) AS entity_unique, array_to_string(list_sort(list_distinct(flatten(list(hosts))))[1:5], ',') AS entity_sample FROM impacts GROUP BY incident, service, signal_family, status, scope, impact_status, cause_candidate_eligible""", _IMPACTS)),
    "candidate_ranking": (q_candidate_ranking, D_CANDIDATE_RANKING),
    "severity_matrix": (q_severity_matrix, with_groups("SELECT incident, service, alert, severity, CASE severity WHEN 'SEV2' THEN 1500 ELSE 500 END AS fetch_limit FROM severed", _WORST)),
    "severity_escalation": (q_severity_escalation, duck(f"""WITH {_REGISTRY}, rate AS (SELECT strftime(ts, '%Y-%m-%d') AS incident, service, count(*) FILTER (level = 'error') / count(*) AS e FROM logs GROUP BY ALL)
      SELECT incident, service, round(e, 4) AS error_rate, CASE WHEN tier = 0 AND e >= 0.5 THEN 'SEV1' WHEN e >= 0.1 THEN 'SEV2' ELSE 'SEV4' END AS severity FROM rate LEFT JOIN registry USING (service)""")),
    "family_cover": (q_family_cover, with_groups("""SELECT incident, event_id, rank FROM (SELECT incident, event_id, row_number() OVER (PARTITION BY incident ORDER BY NOT direct, first_seen, ordinal) AS rank FROM
      (SELECT g.*, (SELECT bool_or(s.directness = 'direct') FROM signals s WHERE s.event_id = g.event_id) AS direct FROM grouped g) WHERE event_id IN (
      SELECT event_id FROM (SELECT grouped.incident, grouped.event_id, first_seen, ordinal, signal_family, bool_or(directness = 'direct') OVER (PARTITION BY grouped.event_id) AS direct FROM signals JOIN grouped ON signals.event_id = grouped.event_id)
      QUALIFY row_number() OVER (PARTITION BY incident, signal_family ORDER BY NOT direct, first_seen, ordinal) = 1)) WHERE rank <= 5""", SIGNALLED)),
    "rare_groups": (q_rare_groups, with_groups("SELECT incident, event_id, n, row_number() OVER (PARTITION BY incident ORDER BY n, first_seen, ordinal) AS rank FROM grouped WHERE level IN ('error', 'warn') QUALIFY rank <= 3")),
    "review_gate": (q_review_gate, D_REVIEW_GATE),
    "claim_grounding": (q_claim_grounding, with_groups("""SELECT incident, 'claim-' || event_id AS claim_id, CASE WHEN n % 3 = 2 THEN '' ELSE event_id END AS grounded_ids, CASE n % 3 WHEN 0 THEN 'downgraded' WHEN 1 THEN 'accepted' ELSE 'rejected' END AS verdict,
      CASE n % 3 WHEN 0 THEN 60 WHEN 1 THEN 85 ELSE 0 END AS confidence FROM grouped WHERE level = 'error'""")),
    "action_classes": (q_action_classes, duck("SELECT CASE k % 4 WHEN 0 THEN 'read_only' WHEN 1 THEN 'proposal' WHEN 2 THEN 'execution_claim' ELSE 'unknown' END AS action_class, count(*) AS n FROM logs GROUP BY 1")),
}
