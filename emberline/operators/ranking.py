"""One ranking of causes for each incident: detections, direct signals, a dependency and a change of traffic, with what speaks against them.

Candidates of all kinds come as rows (incident, kind, place, candidate_id, event_key, category, score, reasons, weaknesses). Rows on the same
events are evidence for one cause. Ranks go by score and, where scores tie, by kind and place, in the order in which they were found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators import incidents, scoring

KINDS = {"detection": 0, "signal": 1, "dependency": 2, "traffic": 3}
#: Scores that a failed source leaves, points between candidates that are tied, and sentences of reasons.
FAILED_CAP, TIED, KEPT = 60, 15, 3
RULE_MATCHED, ERROR_LEVEL, BEFORE_ANCHOR, AFTER_DEPLOY = "detection rule matched", "error-level template", "template precedes anchor", "same-service deploy precedes template"
DIRECT, NAMED = "direct versioned signal plus explicit impact context", "timeout template names an upstream dependency"
UNCONFIRMED, NO_BASELINE = "No dependency-specific error metric or shared trace has confirmed the edge.", "No historical baseline was collected."
CONFLICT = "error-level log evidence conflicts with error_rate=0 from Prometheus"
EXPANSION = [
    "source failure or competing candidates require targeted evidence", "no supported deterministic candidate; collect discriminating evidence",
    "current deterministic evidence is sufficient for initial review",
]
LEAD_MICROS = 15 * 60 * 1_000_000

TEXTS = "array<string>"


def _texts(*values: Column) -> Column:
    return F.array_compact(F.array(*values)).cast(TEXTS)


def _row(kind: str, place: Column, candidate_id: Column, event_key: Column, category: Column, score: Column, reasons: Column, weaknesses: Column) -> list[Column]:
    return ["incident", F.lit(KINDS[kind]).alias("kind"), place.cast("long").alias("place"), candidate_id.alias("candidate_id"), event_key.alias("event_key"),
            category.alias("category"), score.cast("int").alias("score"), reasons.alias("reasons"), weaknesses.alias("weaknesses")]


def from_detections(detections: DataFrame) -> DataFrame:
    """Reads incident, event_id, ordinal, rule_level, category, level, first_seen, anchor_at, deploys (count), pods."""
    scored = detections.join(scoring.detection_candidates(detections).select("event_id", "category", "score").distinct(), ["event_id", "category"])
    lead = F.unix_micros("anchor_at") - F.unix_micros("first_seen")
    reasons = _texts(
        F.lit(RULE_MATCHED), F.when(F.col("level").isin("error", "fatal"), ERROR_LEVEL), F.when(lead.between(0, LEAD_MICROS), BEFORE_ANCHOR), F.when(F.col("deploys") > 0, AFTER_DEPLOY)
    )
    return scored.select(*_row("detection", F.col("ordinal"), F.concat(F.lit("candidate-"), "event_id"), F.col("event_id"), F.col("category"), F.col("score"), reasons, _texts()))


def from_signals(observations: DataFrame) -> DataFrame:
    found = scoring.signal_candidates(observations)
    return found.select(*_row("signal", F.lit(0), F.col("candidate_id"), F.col("event_id"), F.col("category"), F.col("score"), _texts(F.lit(DIRECT)), _texts()))


def from_dependencies(groups: DataFrame) -> DataFrame:
    found = incidents.dependency_candidates(groups)
    return found.select(*_row("dependency", F.lit(0), F.col("candidate_id"), F.col("event_id"), F.col("category"), F.col("score"), _texts(F.lit(NAMED)), _texts(F.lit(UNCONFIRMED))))


def from_traffic(features: DataFrame) -> DataFrame:
    """`features`: incident, change_ratio."""
    found = incidents.traffic_candidates(features).join(features.select("incident", "change_ratio"), "incident")
    reason = F.concat(F.lit("request rate rose "), F.col("change_ratio").cast("string"), F.lit("x from first sample"))
    return found.select(*_row("traffic", F.lit(0), F.col("candidate_id"), F.concat_ws("|", "category", "candidate_id"), F.col("category"), F.col("score"), _texts(reason), _texts(F.lit(NO_BASELINE))))


def _union(values: str, order: Column) -> Column:
    """Distinct texts of arrays in the order of their rows."""
    lists = F.array_sort(F.collect_list(F.struct(order.alias("at"), F.col(values).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: x["v"])))


def merged(candidates: DataFrame) -> DataFrame:
    """One candidate for each incident and event key: best score, the first one's id and category, all categories, reasons and weaknesses."""
    order = F.struct("kind", "place", "candidate_id", "category")
    return candidates.groupBy("incident", "event_key").agg(
        F.min(order).alias("at"), F.max("score").alias("score"), F.array_distinct(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["category"])).alias("categories"),
        _union("reasons", order).alias("reasons"), _union("weaknesses", order).alias("weaknesses"),
    )


def ranked(candidates: DataFrame, context: DataFrame, keep: int = KEPT) -> DataFrame:
    """The first `keep` candidates of each incident, and for each incident whether to abstain and to look for more.

    `context`, one row an incident: failed_sources (array), contradicted (boolean), observations, eligible (counts), observed_categories (array).
    An incident without candidates has one row without a candidate. Sums over an incident are made before its candidates are cut.
    """
    rows = context.join(merged(candidates).withColumnRenamed("reasons", "support"), "incident", "left")
    failed = F.size("failed_sources") > 0
    missing = F.when(failed, F.concat(F.lit("Missing source data: "), F.array_join("failed_sources", ", ")))
    rows = rows.withColumns({
        "score": F.least("score", F.when(failed, FAILED_CAP).otherwise(100)),
        "weaknesses": F.when(F.col("event_key").isNotNull(), F.concat("weaknesses", _texts(missing, F.when(F.col("contradicted"), CONFLICT)))),
    })
    order = Window.partitionBy("incident").orderBy(F.desc("score"), "at")
    ranked_rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(keep, 2))
    first = Window.partitionBy("incident")
    best = lambda n: F.max(F.when(F.col("rank") == n, F.col("score"))).over(first)
    ranked_rows = ranked_rows.withColumns({"top_gap": best(1) - best(2), "candidates": F.count("event_key").over(first)}).filter(F.col("rank") <= keep)
    none, tied = F.col("candidates") == 0, F.coalesce(F.col("top_gap") < TIED, F.lit(False))
    rivals = F.size("observed_categories") > 1
    judged = incidents.abstention_reasons(ranked_rows.withColumn("categories_", F.col("categories")).withColumn("categories", F.col("observed_categories"))).drop("categories").withColumnRenamed("categories_", "categories")
    label = F.when(F.col("score") >= 70, "high").when(F.col("score") >= 40, "medium").when(F.col("score").isNotNull(), "low")
    return judged.select(
        "incident", F.when(~none, F.col("rank")).alias("rank"), F.col("at.candidate_id").alias("candidate_id"), F.col("at.category").alias("category"), "categories", "score", label.alias("label"),
        F.col("support").alias("reasons"), "weaknesses", "top_gap", "abstain", F.col("reasons").alias("abstain_reasons"), (failed | none | tied | rivals).alias("expansion_recommended"),
        F.when(failed | tied | rivals, EXPANSION[0]).when(none, EXPANSION[1]).otherwise(EXPANSION[2]).alias("expansion_reason"),
    )
