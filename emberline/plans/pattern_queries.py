"""Queries over ordered patterns in traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import patterns
from emberline.operators.patterns import Step
from emberline.plans.statistics_queries import _TRACES, traces
from emberline.sources.relations import duck

#: An error, directly after it a view, and later a purchase.
RETRIED = [Step(frozenset(["error"])), Step(frozenset(["view"]), next=True), Step(frozenset(["purchase"]))]
MARKERS = ["error", "signup"]


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each user: all days."""
    return traces(spark, sf_dir).withColumn("trace", F.substring_index("trace", "/", 1))


def q_ordered_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.matched(by_user(spark, sf_dir), RETRIED)


D_PATTERNS = duck(f"""WITH {_TRACES}, w AS (SELECT split_part(trace, '/', 1) AS trace, position, event FROM traces),
  n AS (SELECT *, lead(event) OVER o AS nxt, lead(position) OVER o AS nxt_position FROM w WINDOW o AS (PARTITION BY trace ORDER BY position, event))
  SELECT trace, count(*) AS events, coalesce(min(nxt_position) FILTER (event = 'error' AND nxt = 'view') < max(position) FILTER (event = 'purchase'), false) AS matched FROM n GROUP BY trace""")


def q_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the last error or signup of a user, by whether the user ever bought."""
    rows = by_user(spark, sf_dir)
    truth = rows.groupBy("trace").agg(F.bool_or(F.col("event") == "purchase").alias("label"))
    return patterns.follow_ups(patterns.after_last(rows, MARKERS), truth)


D_FOLLOW_UPS = duck(f"""WITH {_TRACES}, w AS (SELECT split_part(trace, '/', 1) AS trace, position, event FROM traces),
  n AS (SELECT *, coalesce(lead(event) OVER (PARTITION BY trace ORDER BY position, event), 'end') AS follow_up, bool_or(event = 'purchase') OVER (PARTITION BY trace) AS label FROM w),
  l AS (SELECT trace, label, event AS marker, follow_up FROM n WHERE event IN ('error', 'signup') QUALIFY row_number() OVER (PARTITION BY trace ORDER BY position DESC, event DESC) = 1)
  SELECT marker, label, follow_up, count(*) AS traces, row_number() OVER (PARTITION BY marker, label ORDER BY count(*) DESC, follow_up) AS rank FROM l GROUP BY marker, label, follow_up QUALIFY rank <= 8""")

QUERIES = {"ordered_patterns": (q_ordered_patterns, D_PATTERNS), "follow_ups": (q_follow_ups, D_FOLLOW_UPS)}
