"""Rates of counters on a grid of evaluation times, and quantiles of cumulative histograms.

A counter only rises, but for resets to zero. Its samples are corrected by running differences, each partition of which is one series
and one day; each sample then goes to the evaluation times whose window holds it, where first, last, number and resets are aggregates.
Histograms are counters by upper bound `le`, so their rates add up over series before a quantile is read from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.text import let

STEP, RANGE = 60, 300
INFINITY = float("inf")


def with_resets(samples: DataFrame, series: list[str]) -> DataFrame:
    """Adds `lost`: what the counter had reached where a sample is less than the one before it in the series, else 0.

    The sample before the first one of a day is the last of the series' last day with samples, so a series is never one partition.
    Of samples of one time the largest counts.
    """
    once = samples.groupBy(*series, "ts").agg(F.max("value").alias("value")).withColumn("day", F.to_date("ts"))
    ends = once.groupBy(*series, "day").agg(F.max_by("value", "ts").alias("end"))
    ends = ends.withColumn("carried", F.lag("end").over(Window.partitionBy(*series).orderBy("day"))).drop("end")
    before = F.coalesce(F.lag("value").over(Window.partitionBy(*series, "day").orderBy("ts")), F.col("carried"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*series, "day"]]
    joined = once.alias("s").join(ends.alias("e"), same).select("s.*", "carried")
    return joined.withColumn("lost", F.when(F.col("value") < before, before).otherwise(F.lit(0.0))).drop("day", "carried")


def rate_on_grid(samples: DataFrame, series: list[str], step: int = STEP, span: int = RANGE) -> DataFrame:
    """series, at, rate: per-second rate of a counter over (at - span, at], for every multiple of `step` seconds with two samples in it.

    The increase between first and last sample is carried on to the ends of the window where these are near (1.1 times the mean
    distance of samples; else half of it), but at the start no further than to where the counter would have been 0.
    """
    t = F.unix_micros("ts") / 1e6
    first = (F.ceil(t / step) * step).cast("long")
    sample = F.struct(t.alias("t"), "value", "lost")
    once = with_resets(samples, series).select(*series, first.alias("first"), "lost", sample.alias("sample"), t.alias("t"))
    if span % step == 0:  # samples between two evaluation times are in the same windows: they are summed up before they are dealt to these
        last = F.col("first") + (span - step)
        cells = once.groupBy(*series, "first").agg(F.min("sample").alias("a"), F.max("sample").alias("z"), F.count(F.lit(1)).alias("n"), F.sum("lost").alias("lost"))
    else:
        last = (F.ceil((F.col("t") + span) / step) * step).cast("long") - step
        cells = once.withColumns({"a": F.col("sample"), "z": F.col("sample"), "n": F.lit(1).cast("long")})
    times = F.when(last >= F.col("first"), F.sequence("first", last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<long>"))
    on_grid = cells.select(*series, "a", "z", "n", "lost", F.explode(times).alias("at"))
    found = on_grid.groupBy(*series, "at").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("n").alias("n"), F.sum("lost").alias("lost")).filter("n > 1")
    increase = F.col("z.value") - F.col("a.value") + F.col("lost") - F.col("a.lost")
    sampled = F.col("z.t") - F.col("a.t")
    mean = sampled / (F.col("n") - 1)
    near = lambda gap: F.when(gap < mean * 1.1, gap).otherwise(mean / 2)
    start, end = near(F.col("a.t") - (F.col("at") - span)), near(F.col("at") - F.col("z.t"))
    to_zero = F.when((increase > 0) & (F.col("a.value") >= 0), sampled * F.col("a.value") / increase)
    start = F.least(start, F.coalesce(to_zero, start))
    return found.select(*series, "at", (increase * (sampled + start + end) / sampled / span).alias("rate"))


def quantile(share: float, bounds: Column, counts: Column) -> Column:
    """The value under which `share` of a histogram lies: counts are cumulative, by ascending upper bound, and the last bound is infinite.

    Straight line within a bucket, the first of which begins at 0 (or is its bound, if that isn't positive); in the last bucket the bound
    before it. Counts that fall are lifted to the ones before. Null without an infinite bound, with fewer than two buckets or without counts.
    """
    n = F.size(bounds)

    def read(s: Column) -> Column:
        lifted, at = s["lifted"], s["at"]
        total = F.element_at(lifted, n)
        rank = share * total
        before = F.greatest(at - 1, F.lit(1))
        low, under = (F.when(at > 1, F.element_at(c, before)).otherwise(F.lit(0.0)) for c in (bounds, lifted))
        high = F.element_at(bounds, at)
        inside = low + (high - low) * (rank - under) / F.nullif(F.element_at(lifted, at) - under, F.lit(0.0))
        usable = (n > 1) & (F.element_at(bounds, -1) == INFINITY) & (total > 0)
        value = F.when(at == n, F.element_at(bounds, F.greatest(n - 1, F.lit(1)))).when((at == 1) & (high <= 0), high).otherwise(inside)
        return F.when(F.coalesce(usable, F.lit(False)), value)

    def placed(lifted: Column) -> Column:
        at = F.array_position(F.transform(lifted, lambda c: c >= share * F.element_at(lifted, n)), True).cast("int")
        return let(F.struct(lifted.alias("lifted"), at.alias("at")), read)

    start = F.array().cast("array<double>")
    lifted = F.aggregate(counts, start, lambda done, c: F.concat(done, F.array(F.greatest(c, F.coalesce(F.try_element_at(done, F.lit(-1)), c)))))
    return let(lifted, placed)


def histogram_quantile(rates: DataFrame, keys: list[str], share: float, value: str = "rate") -> DataFrame:
    """keys, quantile: from rows by `le`, which are added up over everything but keys and le."""
    sums = rates.groupBy(*keys, "le").agg(F.sum(value).alias("c"))
    buckets = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("le", "c"))).alias("b"))
    return buckets.select(*keys, quantile(share, F.col("b.le"), F.col("b.c")).alias("quantile"))
