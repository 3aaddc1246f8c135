"""Suppressions and detection rules as data: rule lists become expressions, no rule is a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules in order.
SUPPRESSIONS = [
    {"id": "healthcheck-benign", "service": "payments", "error_type": "healthcheck"},
    {"id": "context-canceled", "message_regex": "context canceled|context deadline exceeded on shutdown"},
    {"id": "broken-pipe-info", "level": "info", "message_regex": "broken pipe|EPIPE"},
    {"id": "k8s-probe-noise", "message_regex": "readiness probe failed.*i/o timeout", "min_count": 1},
]
DETECTIONS = [
    {"id": "cert-expiry", "level": "critical", "category": "config_change", "message_regex": "certificate (has expired|is not yet valid|verify failed)|x509:|SSL_ERROR_BAD_CERT"},
    {"id": "db-connection-pool-exhausted", "level": "high", "category": "resource_exhaustion", "message_regex": "connection pool exhausted|too many connections|pool timeout|acquire connection timeout", "levels": ["error", "warn"]},
    {"id": "deploy-regression", "level": "high", "category": "deploy_regression", "levels": ["error"], "minutes_after_deploy": 15},
    {"id": "dns-resolution-failure", "level": "high", "category": "dependency_failure", "message_regex": "no such host|dns lookup failed|name resolution|SERVFAIL|NXDOMAIN|EAI_AGAIN", "levels": ["error", "warn"]},
    {"id": "oom-killed", "level": "high", "category": "resource_exhaustion", "message_regex": "OOMKilled|Out of memory|Memory cgroup out of memory|killed by (the )?kernel"},
    {"id": "rate-limited", "level": "medium", "category": "capacity", "message_regex": r"HTTP\s+429|rate limit(ed)?|too many requests"},
    {"id": "upstream-timeout", "level": "medium", "category": "dependency_failure", "message_regex": r"upstream (timeout|timed out)|gateway timeout|HTTP\s+504|context deadline exceeded", "levels": ["error", "warn"]},
]
RULE_LEVELS = {"critical": 4, "high": 3, "medium": 2, "low": 1, "informational": 0}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def suppression_of(message: Column, rules: list[dict] = SUPPRESSIONS) -> Column:
    """Id of the first rule whose fields all match, or null. Reads columns service, level, error_type, n."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        parts = [F.col(f) == rule[f] for f in ("service", "level", "error_type") if f in rule]
        if "message_regex" in rule:
            parts.append(F.rlike(message, F.lit(rule["message_regex"])))
        if "min_count" in rule:
            parts.append(F.col("n") >= rule["min_count"])
        found = F.when(F.coalesce(_all(parts), F.lit(False)), rule["id"]).otherwise(found)
    return found


def detections(groups: DataFrame, message: str = "example_message", rules: list[dict] = DETECTIONS) -> DataFrame:
    """A row for every rule that a group matches. `after_deploy` (minutes, null for none) is read by rules on deployments."""
    checks = []
    for rule in rules:
        parts = []
        if "message_regex" in rule:
            parts.append(F.rlike(F.col(message), F.lit("(?i)" + rule["message_regex"])))
        if "levels" in rule:
            parts.append(F.col("level").isin(rule["levels"]))
        if "minutes_after_deploy" in rule:
            parts.append(F.col("after_deploy").between(0, rule["minutes_after_deploy"]))
        row = F.struct(
            F.lit(rule["id"]).alias("rule_id"), F.lit(rule["level"]).alias("rule_level"), F.lit(rule["category"]).alias("category"),
            F.lit(RULE_LEVELS[rule["level"]]).alias("rule_rank"),
        )
        checks.append(F.when(F.coalesce(_all(parts), F.lit(False)), row))
    return groups.withColumn("d", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull()))).select(groups["*"], "d.*")
