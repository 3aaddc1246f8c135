"""Candidate scores, ranks and abstention; severity matrix and escalation; review and grounding rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LEVEL_POINTS = {"critical": 35, "high": 30, "medium": 18, "low": 8}
SIGNAL_CATEGORIES = {
    ("machine_availability", "unavailable"): "machine_down", ("network_transport", "unreachable"): "network_disconnection",
    ("network_transport", "disconnected"): "network_disconnection", ("storage_capacity", "exhausted"): "disk_full",
}
ALERT_RANKS = {"critical": 3, "high": 3, "error": 3, "warning": 2, "warn": 2, "medium": 2, "info": 1, "low": 1}
LIFECYCLE = {
    "received": ["collecting", "failed"], "collecting": ["analyzing", "failed"], "analyzing": ["awaiting_review", "failed"],
    "awaiting_review": ["approved", "rejected", "reinvestigating"], "reinvestigating": ["awaiting_review", "failed"],
    "approved": ["publishing"], "publishing": ["published", "failed"], "published": ["resolved"], "resolved": ["received"],
    "rejected": ["received"], "failed": ["received"],
}


def lookup(table: dict[str, object], key: Column, default: object = None) -> Column:
    return reduce(lambda other, item: F.when(key == item[0], F.lit(item[1])).otherwise(other), table.items(), F.lit(default))


def detection_candidates(detections: DataFrame) -> DataFrame:
    """Scores of detections: rule level, error level, before the anchor, related deployment, several pods.

    Reads rule_level, level, first_seen, anchor_at, deploys (count), pods.
    """
    lead = F.unix_micros("anchor_at") - F.unix_micros("first_seen")
    score = (
        lookup(LEVEL_POINTS, F.col("rule_level"), 10)
        + F.when(F.col("level").isin("error", "fatal"), 12).otherwise(0)
        + F.when(lead.between(0, 15 * 60 * 1_000_000), 14).otherwise(0)
        + F.when(F.col("deploys") > 0, 16).otherwise(0)
        + F.when(F.col("pods") >= 2, 5).otherwise(0)
    )
    return detections.select("incident", "event_id", F.concat(F.lit("candidate-"), "event_id").alias("candidate_id"), "category", score.cast("int").alias("score"))


def signal_candidates(observations: DataFrame) -> DataFrame:
    """One candidate for each category of observations that may be causes; the best score counts."""
    category = F.lit(None).cast("string")
    for (family, status), name in SIGNAL_CATEGORIES.items():
        category = F.when((F.col("signal_family") == family) & (F.col("status") == status), name).otherwise(category)
    base = F.when(F.col("adverse"), 78).when(F.col("category") == "disk_full", 68).otherwise(60)
    score = F.when(F.col("recovery"), F.least(base, F.lit(60))).otherwise(base)
    rows = observations.filter("cause_candidate_eligible").withColumn("category", category).filter("category IS NOT NULL")
    return rows.groupBy("incident", "category").agg(F.max(score).cast("int").alias("score"), F.array_sort(F.collect_set("event_id")).alias("event_ids")).select(
        "incident", F.array_join(F.slice("event_ids", 1, 12), ",").alias("event_id"), F.concat(F.lit("candidate-signal-"), "category").alias("candidate_id"), "category", "score"
    )


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """Several rules on one event are evidence for one cause: the best score, all categories."""
    key = F.coalesce(F.nullif(F.col("event_id"), F.lit("")), F.concat_ws("|", "category", "candidate_id"))
    return candidates.groupBy("incident", key.alias("merge_key")).agg(
        F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count(F.lit(1)).alias("rules")
    )


def rank_candidates(merged: DataFrame, failed_sources: Column, keep: int = 3) -> DataFrame:
    """Ranked candidates of each incident with the gap between the first two, and whether to abstain."""
    capped = merged.withColumn("score", F.least(F.col("score"), F.when(failed_sources, 60).otherwise(100)))
    order = Window.partitionBy("incident").orderBy(F.desc("score"), "merge_key")
    whole = Window.partitionBy("incident")
    ranked = capped.withColumn("rank", F.row_number().over(order)).withColumn("next_score", F.lead("score").over(order))
    gap = F.max(F.when(F.col("rank") == 1, F.col("score") - F.col("next_score"))).over(whole)
    label = F.when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").otherwise("low")
    return ranked.withColumn("top_gap", gap).withColumn("label", label).withColumn("abstain", failed_sources | (F.coalesce(F.col("top_gap"), F.lit(100)) < 15)).filter(
        F.col("rank") <= keep
    ).drop("next_score")


def severity(tier: Column, alert: Column, customer_facing: Column) -> Column:
    """Severity from a service's tier and the alert's rank."""
    rank = F.coalesce(lookup(ALERT_RANKS, F.lower(alert)), F.lit(1))
    return (
        F.when((tier == 0) & (rank >= 2), "SEV2").when((tier == 1) & (rank >= 3), "SEV2").when((tier == 1) & (rank == 2), "SEV3")
        .when((tier >= 2) & (rank >= 3) & customer_facing, "SEV3").otherwise("SEV4")
    )


def escalate(current: Column, tier: Column, error_rate: Column) -> Column:
    """Half of all requests failing on a tier-0 service is SEV1, a tenth on any SEV2; severity never falls."""
    raised = F.when((tier == 0) & (error_rate >= 0.5), "SEV1").when(error_rate >= 0.1, "SEV2")
    return F.least(current, F.coalesce(raised, current))


def fetch_limit(severity_: Column) -> Column:
    return F.least(F.when(severity_ == "SEV1", 3000).when(severity_ == "SEV2", 1500).otherwise(500), F.lit(5000))


def illegal_transitions(history: DataFrame) -> DataFrame:
    """Steps of entities' histories that the lifecycle doesn't allow. `history`: entity, version, state."""
    order = Window.partitionBy("entity").orderBy("version")
    legal = [f"{a}>{b}" for a, bs in LIFECYCLE.items() for b in bs]
    steps = history.withColumn("before", F.lag("state").over(order)).filter("before IS NOT NULL AND before <> state")
    return steps.filter(~F.concat_ws(">", "before", "state").isin(legal))


def review_gate(rows: DataFrame) -> DataFrame:
    """Which ranks a reviewer may approve, and the first reason why not.

    `rows`: hypothesis_ranks, candidate_ranks (arrays), quality_ok, grounding_ok, abstained.
    """
    ranks = F.array_sort(F.array_intersect("hypothesis_ranks", "candidate_ranks"))
    reason = (
        F.when(F.col("abstained"), "analysis_abstained").when(~F.col("quality_ok"), "quality_failed").when(~F.col("grounding_ok"), "grounding_failed")
        .when(F.size("candidate_ranks") == 0, "no_candidates").when(F.size(ranks) == 0, "no_shared_rank")
    )
    return rows.withColumn("reason", reason).withColumn("approvable", F.when(F.col("reason").isNull(), ranks).otherwise(F.array().cast("array<int>")))


def ground_claims(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claims against the evidence of their incident: cited ids that exist, verdict, capped confidence.

    `claims`: incident, claim_id, role, evidence_ids, confidence; `known`: incident, role, ids. A claim without any
    supported id is rejected, one with unknown ids as well is downgraded.
    """
    joined = claims.join(known, ["incident", "role"], "left")
    good = F.array_intersect("evidence_ids", F.coalesce("ids", F.array().cast("array<string>")))
    verdict = F.when(F.size(good) == 0, "rejected").when(F.size(good) < F.size(F.array_distinct("evidence_ids")), "downgraded").otherwise("accepted")
    cap = F.when(F.col("verdict") == "accepted", 100).when(F.col("verdict") == "downgraded", 60).otherwise(0)
    return joined.withColumn("grounded_ids", F.array_sort(good)).withColumn("verdict", verdict).withColumn("confidence", F.least("confidence", cap)).drop("ids")


def clean_links(links: DataFrame, known: DataFrame, relations: tuple[str, ...] = ("causes", "precedes", "correlates")) -> DataFrame:
    """Links whose ends exist and whose relation is allowed; confidence is capped at 60, 80 or 100 by how many ids support it."""
    ids = known.select("incident", "event_id")
    kept = links.filter(F.col("relation").isin(*relations)).join(ids.withColumnRenamed("event_id", "source"), ["incident", "source"], "left_semi").join(
        ids.withColumnRenamed("event_id", "target"), ["incident", "target"], "left_semi"
    )
    cap = F.when(F.col("support") >= 3, 100).when(F.col("support") == 2, 80).otherwise(60)
    return kept.withColumn("confidence", F.least("confidence", cap))
