"""Joins of evidence in time and by entity: deployments, anchors, links, lifecycle relations, scope.

Interval joins carry an equality on service and on a time bucket as wide as the interval, so they are hash or
sort-merge joins with a residual range condition and never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.storage import join_spread

DEPLOY_WINDOW_MINUTES = 15


def deploys_before(groups: DataFrame, deploys: DataFrame, minutes: int = DEPLOY_WINDOW_MINUTES) -> DataFrame:
    """Group x deployment of the same service at most `minutes` before the group's first record.

    A null or empty service on either side matches any: named services also look under a key for deployments of no
    service, and every deployment is also entered under a key for groups of no service. One equi-join on key and time
    bucket; a pair meets in one bucket and under one key.
    """
    width = minutes * 60
    seen, at = F.unix_micros("first_seen") / 1e6, F.unix_micros("deployed_at") / 1e6
    named = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    key = lambda c: F.concat(F.lit("="), F.col(c))
    any_deploy, any_group = F.lit("any deployment"), F.lit("any group")
    left = groups.withColumn("bucket", F.explode(F.array(F.floor(seen / width), F.floor(seen / width) - 1))).withColumn(
        "key", F.explode(F.when(named("service"), F.array(key("service"), any_deploy)).otherwise(F.array(any_group)))
    )
    right = deploys.select(
        F.col("service").alias("deploy_service"), "deploy_id", "commit", "deployed_at", F.floor(at / width).alias("bucket"),
        F.explode(F.when(named("service"), F.array(key("service"), any_group)).otherwise(F.array(any_deploy, any_group))).alias("key"),
    )
    delta = F.unix_micros("first_seen") - F.unix_micros("deployed_at")
    return (
        left.join(right, ["bucket", "key"])
        .filter((delta >= 0) & (delta <= width * 1_000_000))
        .withColumn("minutes_before", F.round(delta / 60e6, 1))
        .drop("bucket", "key")
    )


def latest_deploy(groups: DataFrame, deploys: DataFrame) -> DataFrame:
    """As-of join (an extension): the last deployment of the service at or before the group's first record.

    Both sides are sorted once by service and time and the last deployment is carried forward.
    """
    marks = deploys.select("service", F.col("deployed_at").alias("t"), F.struct("deploy_id", "commit", "deployed_at").alias("deploy"))
    rows = groups.select("service", F.col("first_seen").alias("t"), F.struct(*groups.columns).alias("g"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy("service").orderBy("t", F.col("g").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.last("deploy", ignorenulls=True).over(order)).filter("g IS NOT NULL").select("g.*", "last.deploy_id", "last.commit", "last.deployed_at")


def pick_anchor(events: DataFrame) -> DataFrame:
    """One event for each incident: the earliest alert, else the earliest error or warn group, else the earliest dated one.

    `events`: incident, event_id, kind, level, at, ordinal.
    """
    priority = F.when(F.col("kind") == "alert", 0).when((F.col("kind") == "log_group") & F.col("level").isin("error", "warn"), 1).otherwise(2)
    best = events.filter(F.col("at").isNotNull()).groupBy("incident").agg(
        F.min_by(F.struct("event_id", "service", "at"), F.struct(priority, F.col("at"), F.col("ordinal"))).alias("anchor")
    )
    return best.select("incident", F.col("anchor.event_id").alias("anchor_id"), F.col("anchor.service").alias("anchor_service"), F.col("anchor.at").alias("anchor_at"))


def with_anchors(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """Events beside the anchor of their incident, without the anchor itself; one incident's events are dealt to many tasks."""
    return join_spread(events, anchors, "incident", "event_id").filter("event_id <> anchor_id")


def temporal_links(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every other event of an incident against its anchor: precedes, follows, coincides or unknown, with confidence and offset."""
    joined = with_anchors(events, anchors)
    relation = (
        F.when(F.col("at").isNull() | F.col("anchor_at").isNull(), "temporal_relation_unknown")
        .when(F.col("at") < F.col("anchor_at"), "precedes_anchor").when(F.col("at") > F.col("anchor_at"), "follows_anchor").otherwise("coincides_with_anchor")
    )
    return joined.withColumn("relationship", relation).withColumn("confidence", F.when(F.col("relationship") == "temporal_relation_unknown", 20).otherwise(95)).withColumn(
        "offset", offset_label((F.unix_micros("at") - F.unix_micros("anchor_at")) / 1e6)
    )


def offset_label(seconds: Column) -> Column:
    """T+3m05s or T-2h07m; T? for null. Seconds are cut towards zero."""
    whole = F.abs(seconds).cast("long")
    sign = F.when(seconds < 0, "-").otherwise("+")
    hours = F.format_string("T%s%dh%02dm", sign, F.floor(whole / 3600), F.floor(whole % 3600 / 60))
    minutes = F.format_string("T%s%dm%02ds", sign, F.floor(whole / 60), whole % 60)
    return F.when(seconds.isNull(), "T?").when(whole >= 3600, hours).otherwise(minutes)


def change_links(groups: DataFrame, deploys: DataFrame) -> DataFrame:
    """Deployment -> group of the same known service in the same incident, no later than the group."""
    d = deploys.withColumn("incident", F.date_format("deployed_at", "yyyy-MM-dd"))
    return (
        groups.filter("service IS NOT NULL AND service NOT IN ('', 'unknown')")
        .join(d.select("incident", "service", "deploy_id", "deployed_at"), ["incident", "service"])
        .filter("deployed_at <= first_seen")
    )


def entity_match(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """exact, workload_only, mismatch or unknown, from sets of execution, workload, host and pod ids."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    both = lambda k: some(left[k]) & some(right[k])
    shared = lambda k: F.coalesce(F.arrays_overlap(left[k], right[k]), F.lit(False))
    conflict = both("execution_id") & ~shared("execution_id")
    return (
        F.when(both("execution_id") & shared("execution_id"), "exact").when(both("workload_id") & shared("workload_id"), "workload_only")
        .when(both("host") & shared("host"), "exact").when(both("pod") & shared("pod"), "exact").when(conflict, "mismatch").otherwise("unknown")
    )


def execution_conflict(left: Column, right: Column) -> Column:
    return F.coalesce((F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right), F.lit(False))


def time_relation(first: Column, last: Column, other_first: Column, other_last: Column, comparable: Column) -> Column:
    """Where the other interval lies: before, during or after this one; unknown where times can't be compared."""
    known = comparable & first.isNotNull() & last.isNotNull() & other_first.isNotNull() & other_last.isNotNull()
    return F.when(~known, "unknown").when(other_last < first, "before").when(other_first > last, "after").otherwise("during")


def comparable_scopes(left: Column, right: Column, left_sources: Column, right_sources: Column) -> Column:
    """Whether two ordering scopes may be compared; source_relative needs a shared source."""
    never = F.array(*map(F.lit, ["trace_only", "not_comparable", "unknown"]))
    relative = F.array_contains(left, "source_relative") | F.array_contains(right, "source_relative")
    return F.when(F.arrays_overlap(left, never) | F.arrays_overlap(right, never), False).when(
        relative, F.coalesce(F.arrays_overlap(left_sources, right_sources), F.lit(False))).otherwise(True)


def outcome_role(status: Column) -> Column:
    return F.when(status == "failed", "adverse").when(status == "succeeded", "successful_completion").when(status.isin("started", "resumed"), "recovery").otherwise("neutral")


def lifecycle_relations(signals: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Signal groups against the lifecycle groups of their incident, accepted or with the reason of rejection.

    Rejected relations count too, so all pairs of an incident are formed: the join is on incident, and a
    lifecycle group is one row for each shape, not for each record.

    Both sides: incident, event_id, first_seen, last_seen, execution_ids, workload_ids, hosts, pods; lifecycles also status.
    """
    r = lifecycles.select("incident", *[F.col(c).alias(f"l_{c}") for c in lifecycles.columns if c != "incident"])
    joined = signals.join(r, "incident")
    match = entity_match({k: F.col(v) for k, v in ENTITIES.items()}, {k: F.col(f"l_{v}") for k, v in ENTITIES.items()})
    relation = time_relation(F.col("first_seen"), F.col("last_seen"), F.col("l_first_seen"), F.col("l_last_seen"), F.lit(True))
    role = outcome_role(F.col("l_status"))
    conflict = execution_conflict(F.col("execution_ids"), F.col("l_execution_ids"))
    rows = joined.withColumns({"entity_match": match, "time_relation": relation, "outcome_role": role, "conflict": conflict})
    accepted = F.col("entity_match").isin("exact", "workload_only") & F.col("time_relation").isin("during", "after") & ~((F.col("outcome_role") == "adverse") & F.col("conflict"))
    reason = (
        F.when(F.col("accepted"), None).when((F.col("outcome_role") == "adverse") & F.col("conflict"), "adverse_outcome_execution_mismatch")
        .when(F.col("entity_match") == "mismatch", "entity_mismatch").when(F.col("entity_match") == "unknown", "entity_scope_unknown")
        .when(F.col("time_relation") == "before", "outcome_precedes_signal").otherwise("time_relation_unknown")
    )
    return rows.withColumn("accepted", accepted).withColumn("rejection_reason", reason).withColumn(
        "confidence", F.when(F.col("accepted"), F.when(F.col("entity_match") == "exact", 90).otherwise(70))
    )


ENTITIES = {"execution_id": "execution_ids", "workload_id": "workload_ids", "host": "hosts", "pod": "pods"}


def _entity_keys(prefix: str = "") -> Column:
    """Ids of all kinds as one set of texts."""

    def named(kind: str, ids: Column) -> Column:
        return F.coalesce(F.transform(F.array_compact(ids), lambda v: F.concat(F.lit(f"{kind}="), v)), F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.array(*[named(kind, F.col(prefix + c)) for kind, c in ENTITIES.items()])))


def accepted_relations(signals: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """The rows of `lifecycle_relations` that are accepted, without forming others.

    Only groups that share an id can match, so each side goes under its ids, and the join on incident and id carries the conditions of time and
    conflict; of the ids that two groups share only the least one makes the pair, so each comes once.
    """
    left = signals.withColumn("keys", _entity_keys()).withColumn("key", F.explode("keys"))
    right = lifecycles.select(*[F.col(c).alias("incident" if c == "incident" else f"l_{c}") for c in lifecycles.columns])
    right = right.withColumn("l_keys", _entity_keys("l_")).withColumn("key", F.explode("l_keys"))
    times = ["first_seen", "last_seen", "l_first_seen", "l_last_seen"]
    left, right = left.dropna(subset=times[:2]), right.dropna(subset=times[2:])
    conflict = execution_conflict(F.col("execution_ids"), F.col("l_execution_ids"))
    fits = (F.col("l_last_seen") >= F.col("first_seen")) & (F.array_min(F.array_intersect("keys", "l_keys")) == F.col("a.key")) & ~(F.coalesce(F.col("l_status") == "failed", F.lit(False)) & conflict)
    same = (F.col("a.incident") == F.col("b.incident")) & (F.col("a.key") == F.col("b.key"))
    rows = left.alias("a").join(right.alias("b"), same & fits).select("a.*", *[F.col(f"b.{c}") for c in right.columns if c.startswith("l_")]).drop("key", "keys", "l_keys")
    match = entity_match({k: F.col(v) for k, v in ENTITIES.items()}, {k: F.col(f"l_{v}") for k, v in ENTITIES.items()})
    return rows.withColumns({
        "entity_match": match, "time_relation": time_relation(*map(F.col, times), F.lit(True)), "outcome_role": outcome_role(F.col("l_status")), "accepted": F.lit(True),
    }).withColumn("confidence", F.when(F.col("entity_match") == "exact", 90).otherwise(70))


def relation_summary(signals: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """What `lifecycle_relations` says of each signal group, with no row for a rejected pair.

    incident, event_id, adverse, recovery, completion, accepted_links, rejected_links, all_miss (no pair but mismatches), all_before. Rejected
    pairs are those of the incident that aren't accepted; the others follow from totals of the incident's lifecycle groups and shared ids.
    """
    whole = lifecycles.groupBy("incident").agg(
        F.count(F.lit(1)).alias("lifecycles"), F.max("last_seen").alias("latest"), F.bool_and(F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull()).alias("dated"),
        F.bool_and(F.coalesce(F.size("execution_ids") > 0, F.lit(False))).alias("all_executed"),
    )
    known = lifecycles.select("incident", F.explode(_entity_keys()).alias("key")).distinct()
    touched = signals.select("incident", "event_id", F.explode(_entity_keys()).alias("key")).join(known, ["incident", "key"], "left_semi").select("incident", "event_id").distinct().withColumn("touched", F.lit(True))
    has = lambda role: F.bool_or(F.col("outcome_role") == role)
    links = accepted_relations(signals, lifecycles).groupBy("incident", "event_id").agg(
        has("adverse").alias("adverse"), has("recovery").alias("recovery"), has("successful_completion").alias("completion"), F.count(F.lit(1)).alias("accepted_links"))
    rows = signals.join(whole, "incident").join(links, ["incident", "event_id"], "left").join(touched, ["incident", "event_id"], "left")
    no, none = F.lit(False), F.lit(0)
    accepted = F.coalesce("accepted_links", none)
    return rows.select(
        "incident", "event_id", *[F.coalesce(c, no).alias(c) for c in ("adverse", "recovery", "completion")], accepted.alias("accepted_links"), (F.col("lifecycles") - accepted).alias("rejected_links"),
        (F.col("touched").isNull() & F.coalesce(F.size("execution_ids") > 0, no) & F.col("all_executed")).alias("all_miss"),
        F.coalesce(F.col("dated") & F.col("last_seen").isNotNull() & (F.col("latest") < F.col("first_seen")), no).alias("all_before"),
    )


def impact_assessment(signals: DataFrame, relations: DataFrame) -> DataFrame:
    """`assessed_impacts` from the rows of `lifecycle_relations`."""
    has = lambda role: F.coalesce(F.bool_or(F.col("accepted") & (F.col("outcome_role") == role)), F.lit(False))
    return assessed_impacts(signals, relations.groupBy("incident", "event_id").agg(
        has("adverse").alias("adverse"), has("recovery").alias("recovery"), has("successful_completion").alias("completion"),
        F.count_if("accepted").alias("accepted_links"), F.count_if(~F.col("accepted")).alias("rejected_links"),
    ))


def assessed_impacts(signals: DataFrame, summary: DataFrame) -> DataFrame:
    """Whether a signal's impact is established, contradicted or neither, and whether it may be a cause.

    `signals`: incident, event_id, signal_family, status, effect (of the operation, or null); `summary`: relation_summary.
    """
    family = F.col("signal_family")
    condition = (
        F.when(family == "network_transport", "transport_failure").when(family == "storage_capacity", "capacity_failure")
        .when(family == "operation_latency", "operation_latency_deviation")
    )
    rows = signals.join(summary, ["incident", "event_id"], "left").fillna(False, ["adverse", "recovery", "completion"]).fillna(0, ["accepted_links", "rejected_links"])
    same_event = F.col("effect").isNotNull() | condition.isNotNull()
    contradicted = (F.col("recovery") | F.col("completion")) & (family != "operation_latency")
    established = F.col("adverse") | (same_event & ~contradicted)
    may_cause = F.concat_ws("/", family, "status").isin(
        "machine_availability/unavailable", "network_transport/unreachable", "network_transport/disconnected", "storage_capacity/exhausted"
    )
    return rows.withColumns({
        "failure_condition": condition,
        "impact_status": F.when(established, "established").when(contradicted, "contradicted").otherwise("not_established"),
        "cause_candidate_eligible": may_cause & established,
    })


def observation_patterns(observations: DataFrame) -> DataFrame:
    """Observations of one service, signal and impact as one pattern, with occurrence of distinct groups and sampled entities."""
    keys = ["incident", "service", "signal_family", "status", "scope", "impact_status", "cause_candidate_eligible"]
    groups = observations.groupBy(*keys, "event_id").agg(F.first("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.first("hosts").alias("hosts"))
    pattern = groups.groupBy(keys).agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("groups"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hosts")))).alias("entities"),
    )
    return pattern.select(
        *keys, "occurrences", "groups", "first_seen", "last_seen", F.size("entities").alias("entity_unique"), F.array_join(F.slice("entities", 1, 5), ",").alias("entity_sample"),
        F.substring(F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), 256), 1, 16).alias("pattern_id"),
    )


def dependency_edges(services: DataFrame) -> DataFrame:
    """(service, related, direction): dependencies and, turned round, dependents. `services`: service, dependencies array."""
    down = services.select("service", F.explode("dependencies").alias("related"))
    return down.withColumn("direction", F.lit("depends_on")).unionByName(
        down.select(F.col("related").alias("service"), F.col("service").alias("related"), F.lit("depended_on_by").alias("direction"))
    ).distinct()


def scope(alerted: DataFrame, observed: DataFrame, edges: DataFrame, keep: int = 12) -> DataFrame:
    """Services in scope of each incident, at most `keep`: the alerted, then the observed, then their neighbours."""
    base = alerted.select("incident", "service", F.lit(0).alias("step")).unionByName(observed.select("incident", "service", F.lit(1).alias("step")))
    near = alerted.join(edges, "service").select("incident", F.col("related").alias("service"), F.lit(2).alias("step"))
    best = base.unionByName(near).groupBy("incident", "service").agg(F.min("step").alias("step"))
    order = Window.partitionBy("incident").orderBy("step", "service")
    return best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= keep)
