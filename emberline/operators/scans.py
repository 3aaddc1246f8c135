"""Range scans with budgets and partial results: time-stratified logs, metric pages, deployments, sorted and cut records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.storage import unused

#: Most time slices of a scan, hours and number of deployments that count as recent, digits of a commit.
SLICES = 4
LOOKBACK_HOURS, RECENT_DEPLOYS, COMMIT_DIGITS = 48, 30, 7
COMPLETE, WITH_POINTS = "Complete", ("Complete", "PartialData")


def quotas(total: int, count: int) -> list[int]:
    """`total` dealt to `count` slices; the first ones get what is left over."""
    return [total // count + (i < total % count) for i in range(count)]


def budgeted_scan(logs: DataFrame, keys: list[str], start: str, end: str, limit: int, signal: Column, unique: list[str]) -> DataFrame:
    """At most `limit` records of each key in [start, end), in time order.

    Three quarters of the limit go to all records, one to those with `signal`. Up to four equal time slices have their quota each: of all
    records the earliest and the latest of the slice by halves (the odd one is early), of those with signal the earliest. Records alike in
    `unique` count once. Where less than the limit was found, the latest records of the whole range fill it up, and the earliest are kept.
    Ties in time go by `ordinal`. A record without time or outside its range is in no slice.

    Every record goes once into each ranking that it may win, and each task keeps no more than `limit` records of a ranking before the one shuffle.
    """
    general = max(1, limit * 3 // 4)
    loud, count = limit - general, min(SLICES, max(1, general // 2))
    of_slice = quotas(general, count)
    early, late, loud_of = [q - q // 2 for q in of_slice], [q // 2 for q in of_slice], quotas(loud, count)
    slice_, role, rank, order, n = (unused(logs, c) for c in ("slice", "role", "rank", "order", "n"))
    at, low, high = (F.unix_micros(c) for c in ("ts", start, end))
    rows = logs.filter((at >= low) & (at < high)).withColumn(slice_, F.least(F.floor((at - low) * count / (high - low)), F.lit(count - 1)).cast("int"))

    def ranking(name: str, sign: int, within: Column, wanted: Column, quota: list[int]) -> Column:
        allowed = F.element_at(F.array(*map(F.lit, quota)), within + 1)
        return F.when(wanted & (allowed > 0), F.struct(F.lit(name).alias("name"), within.alias("within"), allowed.alias("allowed"), F.struct((at * sign).alias("t"), (F.col("ordinal") * sign).alias("o")).alias("order")))

    every, place = F.lit(True), F.col(slice_)
    roles = F.array_compact(F.array(
        ranking("early", 1, place, every, early), ranking("late", -1, place, every, late),
        ranking("loud", 1, place, F.coalesce(signal, F.lit(False)), loud_of), ranking("fill", -1, F.lit(0), every, [limit]),
    ))
    ranked = rows.withColumn(role, F.explode(roles)).withColumn(
        rank, F.row_number().over(Window.partitionBy(*keys, F.col(f"{role}.name"), F.col(f"{role}.within")).orderBy(F.col(f"{role}.order")))
    )
    near = ranked.filter(F.col(rank) <= limit).filter(F.col(rank) <= F.col(f"{role}.allowed"))
    # One row a distinct record: whether a slice took it, and its place among those that fill up.
    once = near.groupBy(*keys, *[c for c in unique if c not in keys]).agg(
        F.min_by(F.struct(*[c for c in logs.columns if c not in keys]), "ordinal").alias(role),
        F.max(F.col(f"{role}.name") != "fill").alias(slice_), F.min(F.when(F.col(f"{role}.name") == "fill", F.col(rank))).alias(rank),
    )
    found = once.withColumn(n, F.count_if(slice_).over(Window.partitionBy(*keys))).filter(F.col(slice_) | (F.col(rank) <= limit - F.col(n)))
    found = found.select(*keys, f"{role}.*")
    by_time = Window.partitionBy(*keys).orderBy("ts", "ordinal")
    return found.withColumn(order, F.row_number().over(by_time)).filter(F.col(order) <= limit).drop(order).select(*logs.columns)


def insights(records: DataFrame, keys: list[str], fields: list[str], limit: int) -> DataFrame:
    """`fields | sort ts | limit`: the first records of each key that have all fields, ranked."""
    have = records.dropna(subset=["ts", *fields]).select(*keys, "ts", "ordinal", *[f for f in fields if f not in keys])
    return have.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "ordinal"))).filter(F.col("rank") <= limit)


def metric_results(results: DataFrame, keys: list[str], page_limit: int) -> DataFrame:
    """Summary of each series from paged results (keys, page, status, ts, value; ts null in a result without points).

    Pages from `page_limit` on aren't read: the series that has some is truncated. A status other than Complete makes a series partial; the one of
    its last page that had such counts. A series without points is an error if its status promises none, and has no row otherwise.
    """
    read = results.filter(F.col("page") < page_limit)
    bad = F.when(F.col("status") != COMPLETE, F.struct("page", "status"))
    states = results.groupBy(keys).agg(
        F.coalesce(F.max(F.when(F.col("page") < page_limit, bad)).getField("status"), F.lit(COMPLETE)).alias("status"), F.max(F.col("page") >= page_limit).alias("truncated")
    )
    point = F.when(F.col("ts").isNotNull() & F.col("value").isNotNull(), F.struct("ts", "value"))
    order = F.struct("ts", "value")
    points = read.filter(point.isNotNull()).select(*keys, "ts", "value").distinct().groupBy(keys).agg(
        F.min_by("value", order).alias("first_value"), F.max_by(F.struct("ts", "value"), order).alias("last"),
        F.max_by(F.struct("ts", "value"), F.struct(F.col("value"), -F.unix_micros("ts"))).alias("peak"), F.count(F.lit(1)).alias("samples"),
    )
    rows = states.join(points, keys, "left").filter(F.col("samples").isNotNull() | ~F.col("status").isin(*WITH_POINTS))
    last, first = F.col("last.value"), F.col("first_value")
    trend = F.when(last > first, "rising").when(last < first, "falling").when(last.isNotNull(), "flat")
    return rows.select(
        *keys, last.alias("value"), F.col("last.ts").alias("last_at"), F.col("peak.value").alias("peak_value"), F.col("peak.ts").alias("peak_at"), "first_value",
        trend.alias("trend"), F.coalesce("samples", F.lit(0)).alias("samples"), (F.col("status") != COMPLETE).alias("partial"), "truncated",
        F.when(F.col("samples").isNull(), F.col("status")).alias("error"),
    )


def recent_deploys(deploys: DataFrame, windows: DataFrame, hours: int = LOOKBACK_HOURS, most: int = RECENT_DEPLOYS) -> DataFrame:
    """Deployments of a window's service from `hours` before the window's end: of the latest `most` of the service, as a list sorted by time has them.

    `windows`: service, window_end and what names it. Joined on service and a bucket of time as wide as the interval; deployments after the window's end stay.
    """
    width = hours * 3600
    latest = deploys.withColumn("rank", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("deployed_at"), F.desc("deploy_id")))).filter(F.col("rank") <= most)
    found = latest.select("service", "deploy_id", "deployed_at", F.substring("commit", 1, COMMIT_DIGITS).alias("commit"), "rank")
    return windows.join(found, "service").filter(F.unix_micros("deployed_at") >= F.unix_micros("window_end") - width * 1_000_000)
