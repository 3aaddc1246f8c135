"""Evaluation reports: stage scorecards, grouping gates, unsupported numbers, provenance, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def stage_scorecard(raw: DataFrame, sampled: DataFrame, family: str = "signal_family") -> DataFrame:
    """Signal families of each incident before and after sampling, and which were lost."""
    a = raw.groupBy("incident", family).agg(F.count(F.lit(1)).alias("raw_records"))
    b = sampled.groupBy("incident", family).agg(F.count(F.lit(1)).alias("sampled_records"))
    return a.join(b, ["incident", family], "left").fillna(0, ["sampled_records"]).withColumn("lost", F.col("sampled_records") == 0)


def grouping_gate(metrics: DataFrame, precision: float = 0.98, recall: float = 0.90) -> DataFrame:
    return metrics.withColumn("passed", (F.col("precision") >= precision) & (F.col("recall") >= recall))


def unsupported_percentages(claim: Column, evidence: Column) -> Column:
    """Percentages that a claim states and its evidence does not."""
    stated = F.array_distinct(F.regexp_extract_all(claim, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)))
    return F.array_sort(F.filter(stated, lambda x: ~F.contains(evidence, x)))


def backend(url: Column) -> Column:
    """scheme://host[:port] of a source's address, without user, path or query."""
    return F.concat(F.regexp_extract(url, r"^([a-z]+)://", 1), F.lit("://"), F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/?#]*)", 1))


def timeline_items(groups: DataFrame) -> DataFrame:
    """A range where a group's last record is after its first, else a point."""
    ranged = F.col("last_seen") > F.col("first_seen")
    return groups.select("incident", "event_id", F.when(ranged, "range").otherwise("point").alias("kind"), F.col("first_seen").alias("start"), F.when(ranged, F.col("last_seen")).alias("end"))
