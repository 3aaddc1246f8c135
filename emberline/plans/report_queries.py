"""Report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import grouping, reports, sampling, similarity
from emberline.plans import statistics_queries
from emberline.plans.log_queries import d_shown, groups, shown, with_groups
from emberline.sources.relations import duck, logs, read
from emberline.storage import written


def q_pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First messages of different groups of a day, service, level and event that are alike, and the first and last variant of each group."""
    block = ["incident", "service", "level", "event_name"]
    keys = ["incident", *grouping.GROUP_KEYS]
    signed = written(grouping.with_signature(logs(spark, sf_dir)).select(*keys, "ts", "ordinal", "message", "pod", "host"), "signed")
    grouped = written(grouping.signed_groups(signed), "groups")
    near = similarity.near_pairs(grouped, block, "example_message").select("pair_id", F.lit("nearby_different_group").alias("candidate_type"), "left_id", "right_id", "ratio")
    records = signed.select(*keys, F.col("ordinal").alias("id"), "message")
    return near.unionByName(similarity.variant_pairs(records, keys).select("pair_id", F.lit("same_group_variant").alias("candidate_type"), "left_id", "right_id", "ratio"))


def _signalled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("incident", F.date_format("ts", "yyyy-MM-dd")).select(
        "incident", F.explode(text.detect_signals(F.col("message"), F.col("level"))["signal_family"]).alias("signal_family"))


def q_stage_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir)
    return reports.stage_scorecard(_signalled(rows), _signalled(sampling.lowest_hash(rows, "service", "ordinal", 300)))


def q_grouping_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.grouping_gate(statistics_queries.q_pairwise(spark, sf_dir)).select("case", "precision", "recall", "passed")


def q_unsupported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).select("ordinal", F.concat(F.lit("errors rose "), F.col("k").cast("string"), F.lit("% and then 12.5 %")).alias("claim"), "message")
    return rows.select("ordinal", F.array_join(reports.unsupported_percentages(F.col("claim"), F.col("message")), ",").alias("unsupported"))


def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(reports.backend(F.col("url")).alias("backend")).agg(F.count(F.lit(1)).alias("records"))


def q_timeline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timeline_items(groups(spark, sf_dir)).select("incident", "event_id", "kind", shown("start"), shown("end"))


_FAMILIES = " ".join(f"WHEN regexp_matches(message, '{p}') THEN '{f}'" for _, f, _, _, _, p in text.SIGNALS)
QUERIES = {
    "pair_candidates": (q_pair_candidates, None),
    "stage_scorecard": (q_stage_scorecard, duck("""WITH hit AS (SELECT ordinal, service, strftime(ts, '%Y-%m-%d') AS incident, unnest(list_filter([""" + ", ".join(
        f"CASE WHEN regexp_matches(message, '{p}') THEN '{f}' END" for _, f, _, _, _, p in text.SIGNALS) + f""", CASE WHEN level = 'error' AND CASE {_FAMILIES} END IS NULL THEN 'unclassified_error' END], lambda x: x IS NOT NULL)) AS signal_family FROM logs),
      kept AS (SELECT ordinal FROM logs QUALIFY row_number() OVER (PARTITION BY service ORDER BY sha256(service || '|' || ordinal), ordinal) <= 300)
      SELECT incident, signal_family, count(*) AS raw_records, count(k.ordinal) AS sampled_records, count(k.ordinal) = 0 AS lost FROM hit LEFT JOIN kept k USING (ordinal) GROUP BY ALL""")),
    "grouping_gate": (q_grouping_gate, statistics_queries.D_PAIRWISE.replace("SELECT 'all' AS \"case\", rows, groups", "SELECT \"case\", precision, recall, precision >= 0.98 AND recall >= 0.9 AS passed FROM (SELECT 'all' AS \"case\", rows, groups", 1) + ")"),
    "unsupported_claims": (q_unsupported_claims, duck("SELECT ordinal, array_to_string(list_sort(list_filter(list_distinct([CAST(k AS VARCHAR), '12.5']), lambda x: NOT contains(message, x))), ',') AS unsupported FROM logs")),
    "source_provenance": (q_provenance, "SELECT regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/?#]*)', 1) AS backend, count(*) AS records FROM pages GROUP BY 1"),
    "timeline_items": (q_timeline_items, with_groups(f"SELECT incident, event_id, CASE WHEN last_seen > first_seen THEN 'range' ELSE 'point' END AS kind, {d_shown('first_seen')} AS start, CASE WHEN last_seen > first_seen THEN {d_shown('last_seen')} END AS \"end\" FROM grouped")),
}
