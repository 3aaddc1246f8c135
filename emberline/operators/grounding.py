"""Claims of an interpretation against the evidence of its candidate, by the role that each piece of evidence may play.

A claim of a field (cause, mechanism, impact) may cite evidence that its candidate has in that role; a mechanism besides needs a link between events.
Ids of claims, candidates and links meet as rows, so the evidence of an incident may be of any number. Claims have at most `IDS` ids, texts are cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles by fields of a candidate, statuses, limits, reasons.
ROLES = {"event_ids": "cause", "impact_event_ids": "impact", "adverse_outcome_event_ids": "impact"}
STATUSES = ("observed", "inferred", "hypothesis", "unknown")
IDS, ID_LENGTH, TEXT_LENGTH = 12, 500, 700
REASONS = {
    "empty": "claim text is empty", "unknown": "claim cites unknown evidence IDs", "incompatible": "claim lacks compatible validated hypothesis evidence IDs",
    "cause": "correlation evidence does not establish root cause", "unlinked": "mechanism lacks a validated cross-event semantic link",
    "linked": "validated semantic links remain model inference", "impact": "impact linkage is not directly established", "supported": "claim references validated hypothesis evidence",
}
NO_CAUSE, NO_CANDIDATE = "no cause claim is grounded in validated evidence", "deterministic evidence is insufficient"


def id_list(values: Column) -> Column:
    """The first ids that are not blank, cut; an empty array for null."""
    some = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))
    return F.slice(F.transform(some, lambda v: F.substring(v, 1, ID_LENGTH)), 1, IDS)


def evidence_roles(candidates: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """incident, rank, role, id: what the evidence of a candidate may support, ids that the incident knows only.

    `candidates`: incident, rank and the arrays of ROLES; `links`: incident, link_id, supporting_event_ids; `known`: incident, event_id. A link adds
    its ids to a candidate's mechanism if it has two known ones and one of them is among the causes.
    """
    ids = known.select("incident", F.col("event_id").alias("id")).distinct()
    rows = [candidates.select("incident", "rank", F.lit(role).alias("role"), F.explode(id_list(F.col(field))).alias("id")) for field, role in ROLES.items() if field in candidates.columns]
    own = reduce(DataFrame.unionByName, rows).distinct().join(ids, ["incident", "id"], "left_semi").select("incident", "rank", "role", "id")
    linked = links.select("incident", "link_id", F.explode(F.array_distinct(id_list(F.col("supporting_event_ids")))).alias("id")).join(ids, ["incident", "id"], "left_semi")
    wide = linked.groupBy("incident", "link_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("incident", "link_id")
    anchored = linked.join(wide, ["incident", "link_id"]).join(own.filter("role = 'cause'").select("incident", "rank", "id"), ["incident", "id"]).select("incident", "link_id", "rank").distinct()
    mechanism = anchored.join(linked, ["incident", "link_id"]).select("incident", "rank", F.lit("mechanism").alias("role"), "id").distinct()
    return own.unionByName(mechanism)


def grounded_claims(claims: DataFrame, roles: DataFrame, links: DataFrame, known: DataFrame) -> DataFrame:
    """Claims (incident, rank, field, text, status, evidence_ids; one a field and rank) with decision, reason, final status and their ids sorted apart.

    decision: supported, downgraded or rejected. Ids keep the claim's order and repeats; null texts are empty, statuses of no kind are unknown.
    """
    key = ["incident", "rank", "field"]
    base = claims.withColumn("ids", id_list(F.col("evidence_ids")))
    cited = base.select(*key, F.posexplode("ids").alias("at", "id"))
    ids = known.select("incident", F.col("event_id").alias("id")).distinct().withColumn("is_known", F.lit(True))
    fits = roles.select("incident", "rank", F.col("role").alias("field"), "id").distinct().withColumn("fits", F.lit(True))
    judged = cited.join(ids, ["incident", "id"], "left").join(fits, [*key, "id"], "left").select(*key, "at", "id", F.coalesce("is_known", F.lit(False)).alias("is_known"), F.coalesce("fits", F.lit(False)).alias("fits"))
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("at", "id")))), lambda x: x["id"])
    lists = judged.groupBy(key).agg(listed(F.col("fits")).alias("valid_ids"), listed(~F.col("is_known")).alias("unknown_ids"), listed(F.col("is_known") & ~F.col("fits")).alias("incompatible_ids"))
    # A link carries a mechanism if all its ids, two at least, are valid ones of the claim.
    parts = links.select("incident", "link_id", F.array_distinct(F.coalesce("supporting_event_ids", F.array().cast("array<string>"))).alias("all"), F.size("supporting_event_ids").alias("given")).filter("given > 1")
    met = parts.select("incident", "link_id", F.size("all").alias("size"), F.explode("all").alias("id")).join(judged.filter("field = 'mechanism' AND fits").select("incident", "rank", "id").distinct(), ["incident", "id"])
    carried = met.groupBy("incident", "rank", "link_id", "size").agg(F.count(F.lit(1)).alias("n")).filter("n = size").select("incident", "rank").distinct().withColumn("carried", F.lit(True))
    none = F.array().cast("array<string>")
    rows = base.drop("ids", "evidence_ids").join(lists, key, "left").join(carried, ["incident", "rank"], "left").withColumns({
        "text": F.substring(F.trim(F.coalesce("text", F.lit(""))), 1, TEXT_LENGTH), "original_status": F.coalesce(F.when(F.lower("status").isin(*STATUSES), F.lower("status")), F.lit("unknown")),
        **{c: F.coalesce(c, none) for c in ("valid_ids", "unknown_ids", "incompatible_ids")},
    })
    status, field = F.col("original_status"), F.col("field")
    case = (
        F.when(F.col("text") == "", "empty").when(F.size("unknown_ids") > 0, "unknown").when((F.size("incompatible_ids") > 0) | (F.size("valid_ids") == 0), "incompatible")
        .when((field == "cause") & (status == "observed"), "cause").when((field == "mechanism") & F.col("carried").isNull(), "unlinked").when((field == "mechanism") & (status == "observed"), "linked")
        .when((field == "impact") & (status == "observed"), "impact").otherwise("supported")
    )
    rows = rows.withColumn("case", case)
    rejected, lowered = F.col("case").isin("empty", "unknown", "incompatible", "unlinked"), F.col("case").isin("cause", "linked", "impact")
    final = F.when(rejected, "unknown").when(F.col("case") == "cause", "hypothesis").when(lowered, "inferred").otherwise(status)
    reason = reduce(lambda other, item: F.when(F.col("case") == item[0], item[1]).otherwise(other), REASONS.items(), F.lit(None).cast("string"))
    return rows.select(*key, "text", "original_status", final.alias("status"), F.when(rejected, "rejected").when(lowered, "downgraded").otherwise("supported").alias("decision"), reason.alias("reason"),
                       "valid_ids", "unknown_ids", "incompatible_ids")


def enforced_abstention(claims: DataFrame, assessments: DataFrame) -> DataFrame:
    """incident, abstained, reason: an incident abstains where its assessment does, and where no claim of a cause stands. `claims`: grounded_claims; `assessments`: incident, abstain."""
    standing = claims.filter("field = 'cause' AND decision <> 'rejected'").select("incident").distinct().withColumn("stands", F.lit(True))
    rows = assessments.join(standing, "incident", "left")
    abstain = F.coalesce("abstain", F.lit(True))
    return rows.select("incident", (abstain | F.col("stands").isNull()).alias("abstained"), F.when(abstain, NO_CANDIDATE).when(F.col("stands").isNull(), NO_CAUSE).alias("reason"))
