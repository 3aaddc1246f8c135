"""URL rules by a sort-merge range join, in DataFrame functions only.

A host is turned round label by label ("sub.example.org" -> "org.example.sub."), so a rule for a
host and its subdomains is the interval of keys that start with the rule's key. The intervals nest
or are disjoint. The rules' ends cut the key space into segments, each with the stack of the rules
that are open there (built by one sweep over the rules, which are configuration on the driver).
The join sorts URL keys and segment starts together by range and carries the last segment start
forward: within a partition with a window, between partitions through one row a partition. Rows of
one host are spread by a salt in the sort key, so a hot host is no hot task. The path then picks
the longest fitting rule of the stack.

Defined results: a URL that is null or has no "://" has empty host and path; the empty host fits no
rule. Length is that of host plus path; of equal lengths the longer host, then the rule listed first.
No fitting rule: rule null and `default`. Rows may repeat; empty tables give empty results; other
columns of the table are left aside by the query and kept by `match_rules`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.common import LOWER, UPPER, checkpointed, quoted, table

#: (host, path prefix, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def segments(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """One sweep over the rules' interval ends: (first key, open rules from outer to inner), by key."""
    opens: dict[str, list[tuple[str, str, str]]] = {}
    for rule in rules:
        key = ".".join(reversed(rule[0].split("."))) + "."
        opens.setdefault(key, []).append(rule)
    after = lambda key: key[:-1] + "/"  # noqa: E731  "/" follows "."
    events = sorted([(k.encode(), 1, k) for k in opens] + [(after(k).encode(), 0, k) for k in opens])
    stack: list[str] = []
    found: dict[bytes, list[tuple[str, str, str]]] = {b"": []}
    for at, is_open, key in events:
        if is_open:
            stack.append(key)
        else:
            stack.remove(key)
        found[at] = [r for k in stack for r in opens[k]]
    return [(k.decode(), v) for k, v in sorted(found.items())]


def _segment_rows(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    schema = "start string, stack array<struct<host string, path string, verdict string, ord int>>"
    order = {rule: i for i, rule in reversed(list(enumerate(rules)))}
    rows = [(start, [(*rule, order[rule]) for rule in stack]) for start, stack in segments(rules)]
    return spark.createDataFrame(rows, schema)


def match_rules(
    urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", url: str = "url"
) -> DataFrame:
    """`urls` with host, path, rule and verdict added (columns of these names are replaced)."""
    spark = urls.sparkSession
    rules = [tuple(r) for r in rules]
    host, path = url_host(quoted(url)), url_path(quoted(url))
    # Fields by number: names of columns may hold any sign.
    held = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(urls.columns)], host.alias("host"), path.alias("path"))
    rows = urls.select(
        host_key(host).alias("key"), F.lit(1).alias("kind"), F.xxhash64(*[quoted(url), F.monotonically_increasing_id()]).alias("salt"), held.alias("held")
    )
    marks = _segment_rows(spark, rules).select(F.col("start").alias("key"), F.lit(0).alias("kind"), F.lit(-(1 << 63)).alias("salt"), "stack")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Checkpointed: two reads of one range partitioning need not cut at the same keys.
    dealt = checkpointed(
        rows.unionByName(marks, allowMissingColumns=True)
        .repartitionByRange(parts, "key", "kind", "salt")
        .withColumn("part", F.spark_partition_id())
    )
    within = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("own", F.last("stack", ignorenulls=True).over(within))
    # One row a partition: the segment that is open where the partition begins.
    last = dealt.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(
        spark.range(parts).select(F.col("id").cast("int").alias("part")).join(last, "part", "left")
        .select("part", F.last("stack", ignorenulls=True).over(before).alias("from_stack"))
    )
    joined = swept.filter("kind = 1").join(carried, "part", "left")
    fits = F.filter(
        F.coalesce("own", "from_stack"), lambda r: F.startswith(F.col("held.path"), r["path"])
    )
    best = F.array_max(
        F.transform(fits, lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), (-r["ord"]).alias("o"),
            F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"),
        ))
    )
    taken = {"host", "path", "rule", "verdict"}
    return joined.withColumn("best", best).select(
        *[F.col("held").getField(f"c{i}").alias(c) for i, c in enumerate(urls.columns) if c not in taken],
        F.col("held.host").alias("host"), F.col("held.path").alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return match_rules(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS rn
  FROM pages),
r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT rn, max_by(rh || rp, length(rh) + length(rp)) AS rule, max_by(v, length(rh) + length(rp)) AS v
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (rn)
"""
