"""Peer baselines, distributions, series, clustering and confusion metrics, sequences. Truth is joined last, by scoring functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The policy of the peer baseline.
MIN_PEERS, MIN_PERCENTILE, MIN_RATIO, MIN_Z = 20, 95.0, 1.25, 3.5


def running_counts(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values of each key with `c` (how often), `upto` (how many are at most as large) and `size` (how many in all).

    Rows are combined by value before the shuffle; a window then runs over distinct values in order, and holds none of them.
    """
    counted = values.groupBy(*keys, value).agg(F.sum("c").alias("c"))
    sizes = counted.groupBy(keys).agg(F.sum("c").alias("size"))
    order = Window.partitionBy(keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("upto", F.sum("c").over(order)).join(sizes, keys)


def value_at(place: Column, value: str) -> Column:
    """Aggregate over running counts: the value at a place (from 1) in sorted order."""
    return F.max(F.when((F.col("upto") - F.col("c") < place) & (place <= F.col("upto")), F.col(value)))


def _without_one(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """For each key the four values from which the median without any one value follows (see _median_without)."""
    n = F.col("size") - 1
    low, high = F.floor((n + 1) / 2), F.floor(n / 2) + 1
    return counts.groupBy(keys).agg(*[value_at(place, value).alias(f"{name}{i}") for i, place in enumerate((low, low + 1, high, high + 1))])


def _median_without(x: Column, name: str) -> Column:
    """Median of the others. What lies below x keeps its place when x goes, what doesn't moves up one."""
    part = lambda i: F.when(F.col(f"{name}{i}") < x, F.col(f"{name}{i}")).otherwise(F.col(f"{name}{i + 1}"))
    return F.when(F.col("peer_count") > 0, (part(0) + part(2)) / 2)


def peer_baselines(operations: DataFrame, cohort: str = "cohort", value: str = "duration") -> DataFrame:
    """Leave-one-out baseline of every operation in its cohort: median, MAD, ratio, percentile rank, robust z.

    Rows with equal durations have equal peers, so the work is by distinct duration. The median of the others is one of three
    neighbours in the whole cohort's order (or a mean of two), so a cohort has few centres; for each of them the cohort is sorted by distance once,
    and the MAD follows in the same way. Work is a few sorts of the distinct durations, however large the cohort.
    """
    counts = running_counts(operations.select(cohort, F.col(value), F.lit(1).alias("c")), [cohort], value)
    rows = counts.join(_without_one(counts, [cohort], value, "m"), cohort).withColumn("peer_count", F.col("size") - 1)
    rows = rows.withColumn("center", _median_without(F.col(value), "m")).drop("m0", "m1", "m2", "m3")
    centers = rows.filter("center IS NOT NULL").select(cohort, "center").distinct()
    distances = counts.select(cohort, value, "c").join(centers, cohort).select(cohort, "center", F.abs(F.col(value) - F.col("center")).alias("distance"), "c")
    spread = _without_one(running_counts(distances, [cohort, "center"], "distance"), [cohort, "center"], "distance", "d")
    rows = rows.join(spread, [cohort, "center"], "left").withColumn("mad", _median_without(F.abs(F.col(value) - F.col("center")), "d"))
    rows = rows.withColumns({
        "ratio": F.when(F.col("center") > 0, F.col(value) / F.col("center")),
        "percentile_rank": F.when(F.col("peer_count") > 0, 100.0 * (F.col("upto") - 1) / F.col("peer_count")),
        "robust_z": F.when(F.col("mad") > 0, 0.6745 * (F.col(value) - F.col("center")) / F.col("mad")),
    })
    sufficient = (F.col("peer_count") >= MIN_PEERS) & F.coalesce(F.col("mad") > 0, F.lit(False))
    deviates = sufficient & (F.col("percentile_rank") >= MIN_PERCENTILE) & (F.col("ratio") >= MIN_RATIO) & (F.col("robust_z") >= MIN_Z)
    rows = rows.withColumn("status", F.when(deviates, "deviation_observed").when(sufficient, "within_peer_baseline").otherwise("insufficient_baseline"))
    found = rows.select(cohort, value, "peer_count", "center", "mad", "ratio", "percentile_rank", "robust_z", "status")
    return operations.join(found, [cohort, value])


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, median, p90 (the lower of the two, not interpolated), max and MAD of each group, from running counts of distinct values."""
    counts = running_counts(df.filter(F.col(value).isNotNull()).select(*keys, value, F.lit(1).alias("c")), keys, value)
    n = F.col("size")
    half = lambda name: (value_at(F.floor((n + 1) / 2), name) + value_at(F.floor(n / 2) + 1, name)) / 2
    found = counts.groupBy(keys).agg(
        F.max("size").alias("n"), F.min(value).alias("least"), half(value).alias("median"), value_at(F.floor(0.9 * (n - 1)) + 1, value).alias("p90"),
        F.max(value).alias("most"), value_at(F.floor(n / 2) + 1, value).alias("upper_median"),
    )
    distances = counts.select(*keys, value, "c").join(found.select(*keys, "median"), keys).select(*keys, F.abs(F.col(value) - F.col("median")).alias("distance"), "c")
    mads = running_counts(distances, keys, "distance").groupBy(keys).agg(half("distance").alias("mad"))
    return found.join(mads, keys).select(*keys, "n", "least", "median", "p90", "most", "mad", "upper_median")


def series_summary(points: DataFrame, keys: list[str], time: str = "ts", value: str = "value") -> DataFrame:
    """First, last, peak with its time, trend and number of distinct points of each series."""
    order = F.struct(time, value)
    return (
        points.select(*keys, time, value).dropDuplicates().groupBy(keys)
        .agg(
            F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.max(value).alias("peak_value"),
            F.min_by(time, F.struct(-F.col(value), F.col(time))).alias("peak_time"), F.count(F.lit(1)).alias("samples"),
        )
        .withColumn("trend", F.when(F.col("last_value") > F.col("first_value"), "rising").when(F.col("last_value") < F.col("first_value"), "falling").otherwise("flat"))
        .withColumn("change_ratio", F.when(F.col("first_value") != 0, F.round(F.col("peak_value") / F.col("first_value"), 2)))
    )


def rates(logs: DataFrame, window: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Error rate and requests a second by service over sliding windows."""
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return logs.groupBy("service", F.window("ts", window, step).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.startswith("status_code", F.lit("5"))).alias("errors")
    ).select(
        "service", F.col("w.start").alias("start"), "requests", F.round(F.col("errors") / F.col("requests"), 6).alias("error_rate"),
        F.round(F.col("requests") / seconds, 6).alias("rate"),
    )


def _pairs(c: Column) -> Column:
    return c * (c - 1) / 2


def ratio(a: Column, b: Column, empty: float) -> Column:
    """a / b to 4 places; `empty` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(F.round(a / b, 4))


def pairwise_grouping(assigned: DataFrame, truth: DataFrame, row: str = "ordinal") -> DataFrame:
    """Pairwise clustering metrics of frozen groups against truth, which is joined here and nowhere before.

    `assigned`: case, predicted and the row key; `truth`: row key, label. All from one contingency table.
    """
    cells = assigned.join(truth, row).groupBy("case", "predicted", "label").agg(F.count(F.lit(1)).alias("c"))
    by_group = cells.groupBy("case", "predicted").agg(F.sum("c").alias("c"), F.max("c").alias("most"), F.count(F.lit(1)).alias("labels"))
    by_label = cells.groupBy("case", "label").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("groups"))
    # The three roll-ups are laid under each other and meet in one aggregate: as joins they would be cross joins where there is one case only.
    parts = [
        cells.select("case", _pairs(F.col("c")).cast("long").alias("tp")),
        by_group.select("case", _pairs(F.col("c")).cast("long").alias("predicted_pairs"), F.col("c").alias("rows"), F.col("most").alias("dominant"), (F.col("labels") > 1).cast("int").alias("collisions"), F.lit(1).alias("groups")),
        by_label.select("case", _pairs(F.col("c")).cast("long").alias("truth_pairs"), (F.col("groups") > 1).cast("int").alias("fragmented"), F.lit(1).alias("labels")),
    ]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = whole.groupBy("case").agg(*[F.sum(c).alias(c) for c in whole.columns if c != "case"])
    precision, recall = ratio(F.col("tp"), F.col("predicted_pairs"), 1.0), ratio(F.col("tp"), F.col("truth_pairs"), 1.0)
    return sums.withColumn("precision", precision).withColumn("recall", recall).select(
        "case", "rows", "groups", "labels", "tp", (F.col("predicted_pairs") - F.col("tp")).alias("fp"), (F.col("truth_pairs") - F.col("tp")).alias("fn"),
        "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 1.0).alias("f1"),
        ratio(F.col("dominant"), F.col("rows"), 1.0).alias("purity"), "collisions", "fragmented",
    )


RARE_LABEL = 10


def label_coverage(rows: DataFrame) -> DataFrame:
    """How many of a case's labels its sample has: of all, of those with a high-signal row, of rare ones (at most RARE_LABEL rows); empty sets are covered.

    `rows`: case, label, sampled, high_signal (booleans). A high-signal label counts as sampled if one of its high-signal rows is.
    """
    per = rows.groupBy("case", "label").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("sampled").alias("seen"), F.bool_or("high_signal").alias("loud"), F.bool_or(F.col("sampled") & F.col("high_signal")).alias("loud_seen"))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rare = F.col("n") <= RARE_LABEL
    found = per.groupBy("case").agg(
        F.count(F.lit(1)).alias("labels"), yes(F.col("seen")).alias("sampled_labels"), yes(F.col("loud")).alias("high_signal_labels"), yes(F.col("loud_seen")).alias("sampled_high_signal"),
        yes(rare).alias("rare_labels"), yes(rare & F.col("seen")).alias("sampled_rare"), F.sum("n").alias("rows"),
    )
    covered = [("sampled_labels", "labels", "coverage"), ("sampled_high_signal", "high_signal_labels", "high_signal_coverage"), ("sampled_rare", "rare_labels", "rare_coverage")]
    return found.select("*", *[ratio(F.col(a), F.col(b), 1.0).alias(name) for a, b, name in covered])


def interpolated(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys, quantile: straight line between the two values next to the place, from running counts of distinct values."""
    counts = running_counts(df.filter(F.col(value).isNotNull()).select(*keys, value, F.lit(1).alias("c")), keys, value)
    place = F.lit(share) * (F.col("size") - 1)
    found = counts.groupBy(keys).agg(F.max("size").alias("size"), value_at(F.floor(place) + 1, value).alias("low"), value_at(F.ceil(place) + 1, value).alias("high"))
    return found.select(*keys, (F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))).alias("quantile"))


def confusion(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates of boolean predictions against boolean truth."""
    p, t = F.col("predicted"), F.col("truth")
    counted = pairs.groupBy(keys).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn")
    )
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    return counted.select(
        *keys, *c.values(), ratio(c["tp"], c["tp"] + c["fp"], 1.0).alias("precision"), ratio(c["tp"], c["tp"] + c["fn"], 1.0).alias("recall"),
        ratio(c["tn"], c["tn"] + c["fp"], 1.0).alias("specificity"), ratio(c["tp"] + c["tn"], c["tp"] + c["fp"] + c["fn"] + c["tn"], 1.0).alias("accuracy"),
    )


def event_association(traces: DataFrame, truth: DataFrame) -> DataFrame:
    """For each event of the traces: in how many it occurs, and how well it marks failed ones. `truth`: trace, failed."""
    present = traces.select("trace", "event").distinct().join(truth, "trace")
    failed = truth.filter("failed").count()
    return present.groupBy("event").agg(F.count(F.lit(1)).alias("support"), F.count_if("failed").alias("failed_support")).select(
        "event", "support", "failed_support", ratio(F.col("failed_support"), F.col("support"), 0.0).alias("precision"),
        ratio(F.col("failed_support"), F.lit(failed), 0.0).alias("recall"),
    )


def sequences(records: DataFrame, marker: str) -> DataFrame:
    """Each trace as an ordered sequence: length, distinct events, first, last, what follows the last marker, whether it ends there."""
    order = Window.partitionBy("trace").orderBy("position")
    stepped = records.withColumn("next", F.lead("event").over(order))
    marked = F.when(F.col("event") == marker, F.struct("position", F.coalesce("next", F.lit("end")).alias("next")))
    return stepped.groupBy("trace").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("event").alias("distinct_events"), F.min_by("event", "position").alias("first_event"),
        F.max_by("event", "position").alias("last_event"), F.max(marked)["next"].alias("after_marker"),
    ).withColumn("ends_in_marker", F.coalesce(F.col("after_marker") == "end", F.lit(False)))


def shared_sequences(records: DataFrame) -> DataFrame:
    """How many traces share each ordered sequence of events."""
    per = records.groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("position", "event"))).alias("a"))
    signature = F.sha2(F.array_join(F.transform("a", lambda x: x["event"]), ">"), 256)
    return per.groupBy(signature.alias("sequence")).agg(F.count(F.lit(1)).alias("traces"), F.max(F.size("a")).alias("length"))
