"""Union of sources, further candidates, contradictions, abstention, contract audits, traces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import sanitize
from emberline.operators.scoring import SIGNAL_CATEGORIES, lookup
from emberline.storage import unused


def dedup_union(sources: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Rows of all sources, one for each key: that of the last source, and in it the last by `order`. Combined before the one shuffle."""
    number, row = unused(sources[0], "source_no"), unused(sources[0], "row")
    whole = reduce(DataFrame.unionByName, [s.withColumn(number, F.lit(i)) for i, s in enumerate(sources)])
    rest = [c for c in sources[0].columns if c not in keys]
    last = whole.groupBy(keys).agg(F.max_by(F.struct(*rest), F.struct(number, order)).alias(row))
    return last.select(*keys, *[F.col(row).getField(c).alias(c) for c in rest])


def traffic_candidates(features: DataFrame, least_ratio: float = 1.5) -> DataFrame:
    """A candidate where the request rate rose. `features`: incident, change_ratio."""
    # Points of a change of traffic.
    score = F.least(F.lit(55), F.lit(15) + F.floor(F.col("change_ratio") * 10)).cast("int")
    return features.filter(F.col("change_ratio") >= least_ratio).select("incident", F.lit("candidate-traffic-change").alias("candidate_id"), F.lit("traffic_change").alias("category"), score.alias("score"))


def dependency_candidates(groups: DataFrame) -> DataFrame:
    """The first group of each incident, by count, whose error type or signature names an upstream or a dependency."""
    named = groups.filter(sanitize.names_dependency(F.col("error_type"), F.col("signature")))
    first = named.groupBy("incident").agg(F.min_by("event_id", F.struct(-F.col("n"), F.col("ordinal"))).alias("event_id"))
    return first.select("incident", "event_id", F.concat(F.lit("candidate-dependency-"), "event_id").alias("candidate_id"), F.lit("dependency_failure").alias("category"), F.lit(42).alias("score"))


def contradictions(groups: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with error groups although their error rate is not above zero. `metrics`: keys, error_rate (null: unknown)."""
    loud = groups.filter(F.col("level").isin("error", "fatal")).groupBy(keys).agg(F.count(F.lit(1)).alias("error_groups"))
    return loud.join(metrics.filter("error_rate <= 0"), keys)


def abstention_reasons(incidents: DataFrame) -> DataFrame:
    """incident, reasons (array in a fixed order) from incident, candidates (count), top_gap, observations, eligible (counts), failed_sources (array), categories (array)."""
    none = F.col("candidates") == 0
    # Sentences of reasons, in order.
    said = [
        (none, F.lit("no deterministic candidate has supporting evidence")),
        (none & (F.col("observations") > 0) & (F.col("eligible") == 0), F.lit("direct signals were observed without an incident-impact link")),
        (F.size("failed_sources") > 0, F.concat(F.lit("required evidence source failed: "), F.array_join("failed_sources", ", "))),
        (F.col("top_gap") < 15, F.lit("top deterministic candidates are materially tied")),
        (F.size("categories") > 1, F.lit("direct observations span competing failure categories")),
    ]
    reasons = F.array_compact(F.array(*[F.when(when, text) for when, text in said]))
    return incidents.withColumn("reasons", reasons).withColumn("abstain", F.size("reasons") > 0)


def direct_category(family: Column, status: Column) -> Column:
    """The failure category that a direct observation stands for."""
    return lookup({f"{f}/{s}": c for (f, s), c in SIGNAL_CATEGORIES.items()}, F.concat_ws("/", family, status))


def candidate_violations(candidates: DataFrame) -> DataFrame:
    """One row for each rule of the candidate contract that a row breaks: candidate_id, violation."""
    rules = {
        "missing_text": F.coalesce(F.trim("title"), F.lit("")) == "",
        "confidence_label": ~F.coalesce(F.col("confidence_label").isin("low", "medium", "high"), F.lit(False)),
        "score_range": ~F.coalesce(F.col("score").between(0, 100), F.lit(False)),
        "rank_range": ~F.coalesce(F.col("rank") >= 1, F.lit(False)),
        "claims_mechanism": F.col("mechanism").isNotNull(),
    }
    return candidates.select("candidate_id", F.explode(F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))).alias("violation"))


def impact_audit(impacts: DataFrame, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """`audited_impacts` from rows of relations. `links`: incident, event_id, entity_match, time_relation."""
    worst = links.groupBy("incident", "event_id").agg(F.bool_and(F.col("entity_match") == "mismatch").alias("all_miss"), F.bool_and(F.col("time_relation") == "before").alias("all_before"))
    return audited_impacts(impacts.join(worst, ["incident", "event_id"], "left"), nodes)


def audited_impacts(impacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counters of each incident's impact records: statuses, eligible ones whose links all miss or all come before, cited ids that the graph has not.

    `impacts`: incident, event_id, impact_status, cause_candidate_eligible, all_miss, all_before; `nodes`: event_id.
    """
    known = nodes.select("event_id").distinct()
    unknown = impacts.select("incident", "event_id").distinct().join(known, "event_id", "left_anti").groupBy("incident").agg(F.count(F.lit(1)).alias("unknown_ids"))
    yes = lambda c: F.count_if(F.col("cause_candidate_eligible") & F.coalesce(F.col(c), F.lit(False)))
    found = impacts.groupBy("incident").agg(
        *[F.count_if(F.col("impact_status") == s).alias(s) for s in ("established", "not_established", "contradicted")],
        yes("all_miss").alias("mismatch_candidates"), yes("all_before").alias("pre_signal_candidates"),
    )
    return found.join(unknown, "incident", "left").withColumn("unknown_ids", F.coalesce("unknown_ids", F.lit(0)))


def trace_spans(events: DataFrame, begins: Column, ends: Column) -> DataFrame:
    """trace, first and last time, events, and seconds from its first beginning to its first end (null without both)."""
    found = events.groupBy("trace").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("events"),
        F.min(F.when(begins, F.unix_micros("ts"))).alias("begun"), F.min(F.when(ends, F.unix_micros("ts"))).alias("ended"),
    )
    seconds = F.when(F.col("ended") >= F.col("begun"), F.round((F.col("ended") - F.col("begun")) / 1e6, 3))
    return found.select("trace", "first_seen", "last_seen", "events", seconds.alias("seconds"))


def trace_lookup(events: DataFrame, services: int = 3, exact_up_to: int = 50) -> DataFrame:
    """Counts of each trace in its first `services` services by name; the total is exact only if each count is (capped at `exact_up_to`)."""
    per = events.groupBy("trace", "service").agg(F.count(F.lit(1)).alias("n"))
    ranked = per.withColumn("place", F.row_number().over(Window.partitionBy("trace").orderBy("service"))).filter(F.col("place") <= services)
    return ranked.groupBy("trace").agg(
        F.array_join(F.array_sort(F.collect_list("service")), ",").alias("services"), F.sum(F.least("n", F.lit(exact_up_to))).alias("total"), F.bool_and(F.col("n") <= exact_up_to).alias("exact")
    )


def candidate_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """added, removed, changed or unchanged of each candidate, with scores; nulls compare as equal. Both: key, score."""
    a, b = before.select(key, F.col("score").alias("old_score"), F.lit(True).alias("old")), after.select(key, F.col("score").alias("new_score"), F.lit(True).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old_score").eqNullSafe(F.col("new_score")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, "old_score", "new_score", change.alias("change"))


def merged_counters(rows: DataFrame, keys: list[str], counters: str) -> DataFrame:
    """Sums of map columns by name."""
    return rows.select(*keys, F.explode(counters).alias("name", "value")).groupBy(*keys, "name").agg(F.sum("value").alias("value"))


def first_per(groups: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The first groups of each key in order of count, then arrival."""
    order = Window.partitionBy(keys).orderBy(F.desc("n"), "ordinal")
    return groups.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)


def in_scope(requests: DataFrame, scope: DataFrame, longest: int = 240) -> DataFrame:
    """Requests with `verdict`: out_of_scope unless their service is in `scope` (service), pattern_too_long, else ok."""
    marked = requests.join(scope.select("service").distinct().withColumn("known", F.lit(True)), "service", "left")
    verdict = F.when(F.col("known").isNull(), "out_of_scope").when(F.length("pattern") > longest, "pattern_too_long").otherwise("ok")
    return marked.withColumn("verdict", verdict).drop("known")
