"""Paged ranges, budgeted scans, metric pages, counters and histograms against small cases and brute force."""

import bisect
import datetime as dt
import glob
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import counters, scans
from emberline.plans import catalogue
from emberline.sources import paged
from emberline.storage import shared_dir

FIELDS = "ordinal long, ts timestamp, message string"
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture()
def pages(spark, tmp_path):
    rows = [(i, at(i * 40), None if i % 9 == 0 else f"m{i}") for i in range(300)]
    path = paged.write_pages(spark.createDataFrame(rows, FIELDS), str(tmp_path / "pages"), 3600, 20)
    return path, rows


def test_pages_come_back(spark, pages):
    path, rows = pages
    df = paged.read_pages(spark, path, FIELDS, 3600)
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == rows
    assert paged.read_pages(spark, path, "ordinal long, absent string", 3600).filter("absent IS NULL").count() == 300
    assert paged.read_pages(spark, path + "/none", FIELDS, 3600).count() == 0


def test_range_is_pushed(spark, pages):
    path, rows = pages
    df = paged.read_pages(spark, path, FIELDS, 3600).filter((F.col("ts") > at(4000)) & (F.col("ts") <= at(8000)) & (F.col("ordinal") != 120))
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [GreaterThan(ts" in plan and df.rdd.getNumPartitions() == 2  # of 4 slices
    assert sorted(r["ordinal"] for r in df.collect()) == [i for i, t, _ in rows if at(4000) < t <= at(8000) and i != 120]
    assert paged.read_pages(spark, path, FIELDS, 3600).filter((F.col("ts") >= at(4000)) & (F.col("ts") < at(4000))).count() == 0


def test_unread_and_broken_pages_are_partial(spark, pages):
    path, _ = pages
    assert {tuple(r) for r in paged.read_status(spark, path, 3600).select("pages", "pages_read", "partial").collect()} == {(5, 5, False), (2, 2, False)}
    first = min(f for f in os.listdir(path) if f.startswith("slice="))
    folder = os.path.join(path, first, "page=1")
    broken = next(f for f in os.listdir(folder) if f.endswith(".json"))
    with open(os.path.join(folder, broken), "w") as f:
        f.write('{"ordinal": 1\n')
    rows = {r["slice"]: r for r in paged.read_status(spark, path, 3600).collect()}
    start = int(first.split("=")[1])
    assert (rows[start]["pages_read"], rows[start]["rows_read"], rows[start]["partial"]) == (4, 70, True)
    assert sum(r["partial"] for r in rows.values()) == 1
    assert paged.read_pages(spark, path, FIELDS, 3600).count() == 280
    cut = paged.read_status(spark, path, 3600, max_pages=2)
    assert {(r["pages_read"], r["partial"]) for r in cut.collect() if r["slice"] != start} == {(2, True), (2, False)}
    assert paged.read_pages(spark, path, FIELDS, 3600, max_pages=1).count() == 80


def test_files_are_fewer_than_pages(spark, tmp_path, monkeypatch):
    """Several pages a file: the same records and status as a file a page; a broken line breaks its own page only; tasks and batches read blocks."""
    rows = [(i, at(i * 40), None if i % 9 == 0 else f"m{i}\u2028x") for i in range(300)]
    df = spark.createDataFrame(rows, FIELDS)
    plain = paged.write_pages(df, str(tmp_path / "plain"), 3600, 20)
    path = paged.write_pages(df, str(tmp_path / "blocks"), 3600, 20, file_pages=2)
    files = sorted(glob.glob(f"{path}/*/*/*.json"))
    assert sorted(f.split("/")[-2] for f in files) == ["pages=0-2-20"] * 4 + ["pages=2-2-20"] * 3 + ["pages=4-1-20"] * 3
    assert sorted(map(tuple, paged.read_pages(spark, path, FIELDS, 3600).collect()), key=lambda r: r[0]) == rows
    for most in (0, 1, 3):
        both = [sorted(map(tuple, paged.read_status(spark, p, 3600, most).collect())) for p in (plain, path)]
        assert both[0] == both[1] and len(both[0]) == 4
        assert paged.read_pages(spark, plain, FIELDS, 3600, most).exceptAll(paged.read_pages(spark, path, FIELDS, 3600, most)).count() == 0
    blocks = paged._listed(path)[1704067200]
    monkeypatch.setattr(paged, "TASK_PAGES", 2)
    reader = paged.RangeReader({"path": path, "max_pages": "3"}, df.schema)
    tasks = list(reader._tasks(1704067200, blocks))
    assert [t.before for t in tasks] == [0, 2, 4] and [sum(len(b) for b in reader.read(t)) for t in tasks] == [40, 20, 0]
    stream = paged.PageStream({"path": path}, df.schema)
    assert stream.latestOffset()["1704067200"] == 5
    assert [b.first for t in stream.partitions({"1704067200": 2}, {"1704067200": 5}) for b, _ in t.blocks] == [2, 4]
    name = next(f for f in files if "slice=1704067200/pages=2-2-20" in f)
    with open(name, encoding="utf-8") as f:
        lines = f.read().split("\n")
    with open(name, "w", encoding="utf-8") as f:
        f.write("\n".join([*lines[:5], "{", *lines[6:]]))
    broken = {r["slice"]: r for r in paged.read_status(spark, path, 3600).collect()}[1704067200]
    assert (broken["pages"], broken["pages_read"], broken["rows_read"], broken["partial"]) == (5, 4, 70, True)


def test_queries_write_few_files(spark):
    """A day of these tables has several pages; the queries wrote a file for each of them."""
    found = catalogue.queries()["page_status"](spark, "/root/testdata/sf0.01").collect()
    folder = max(glob.glob(f"{shared_dir(spark)}/status-pages-*"), key=os.path.getmtime)
    assert len(glob.glob(f"{folder}/**/*.json", recursive=True)) == len(found) < sum(r["pages"] for r in found)


def test_stream_reads_each_page_once(spark, pages, tmp_path):
    path, rows = pages
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    paged.register(spark)

    def run():
        stream = spark.readStream.format("paged_ranges").schema(FIELDS).options(path=path, seconds=3600).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["ordinal"] for r in spark.read.parquet(out).collect())

    assert run() == list(range(300))
    slice_, page = sorted(os.listdir(path))[-1], "page=9"  # a page that comes later, in an old slice
    slice_ = max(f for f in os.listdir(path) if f.startswith("slice="))
    os.makedirs(os.path.join(path, slice_, page))
    with open(os.path.join(path, slice_, page, "late.json"), "w") as f:
        f.write(json.dumps({"ordinal": 1000, "ts": 5}) + "\n")
    assert run() == [*range(300), 1000]
    assert run() == [*range(300), 1000]


def scan_by_hand(rows, low, high, limit, count_of=lambda g: min(4, max(1, g // 2))):
    """rows of one key: (ordinal, ts, message, loud)."""
    general = max(1, limit * 3 // 4)
    n = count_of(general)
    rows = sorted((r for r in rows if r[1] is not None and low <= r[1] < high), key=lambda r: (r[1], r[0]))
    micros = lambda t: round((t - low).total_seconds() * 1e6)
    place = lambda r: min(micros(r[1]) * n // micros(high), n - 1)
    quotas = lambda total: [total // n + (i < total % n) for i in range(n)]
    taken = []
    for i, (q, loud) in enumerate(zip(quotas(general), quotas(limit - general), strict=True)):
        own = [r for r in rows if place(r) == i]
        taken += own[: q - q // 2] + (own[::-1][: q // 2]) + [r for r in own if r[3]][:loud]
    first = {}
    for r in sorted(taken):
        first.setdefault(r[1:3], r)
    if len(first) < limit:
        for r in sorted(rows[::-1][: limit - len(first)]):
            first.setdefault(r[1:3], r)
    return [r[0] for r in sorted(first.values(), key=lambda r: (r[1], r[0]))][:limit]


@pytest.mark.parametrize("limit", [1, 2, 7, 16, 40, 1000])
def test_budgeted_scan(spark, limit):
    """Ties, repeats, null times and messages, uneven slices; some columns have the names of helpers."""
    rng = random.Random(limit)
    rows = [(k, i, None if rng.random() < 0.05 else at(int(rng.random() ** 3 * 900)), rng.choice([None, "a", "b", "timeout"]), rng.random() < 0.3) for k in "xy" for i in range(150)]
    df = spark.createDataFrame(rows, "key string, ordinal long, ts timestamp, message string, loud boolean").withColumns(
        {"start": F.lit(at(10)), "end": F.lit(at(800)), "slice": F.lit("s"), "rank": F.lit("r"), "n": F.lit(-1)}
    )
    found = scans.budgeted_scan(df, ["key"], "start", "end", limit, F.col("loud"), ["ts", "message"])
    assert found.columns == df.columns
    for k in "xy":
        got = [r["ordinal"] for r in found.filter(F.col("key") == k).orderBy("ts", "ordinal").collect()]
        assert got == scan_by_hand([r[1:] for r in rows if r[0] == k], at(10), at(800), limit) and len(got) <= limit
    assert scans.budgeted_scan(df.limit(0), ["key"], "start", "end", limit, F.col("loud"), ["ts", "message"]).count() == 0


def test_budgeted_scan_keeps_few_rows_a_task(spark):
    df = spark.range(10).selectExpr("id AS ordinal", "current_timestamp() AS ts", "'m' AS message", "'k' AS key", "timestamp'1970-01-01' AS start", "timestamp'2100-01-01' AS end")
    plan = scans.budgeted_scan(df, ["key"], "start", "end", 8, F.lit(True), ["message"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_metric_results(spark):
    rows = [
        ("a", 0, "Complete", at(0), 1.0), ("a", 0, "Complete", at(0), 1.0), ("a", 1, "Complete", at(9), 5.0), ("a", 1, "Complete", at(5), 9.0), ("a", 1, "Complete", at(4), 9.0),
        ("b", 0, "InternalError", None, None), ("c", 0, "PartialData", None, None), ("d", 0, "PartialData", at(1), 2.0), ("e", 0, "Complete", at(1), 2.0), ("e", 2, "InternalError", at(2), 7.0),
        ("f", 0, "Complete", None, 3.0),
    ]
    df = spark.createDataFrame(rows, "metric string, page int, status string, ts timestamp, value double")
    found = {r["metric"]: r for r in scans.metric_results(df, ["metric"], 2).collect()}
    assert set(found) == {"a", "b", "d", "e"}
    a = found["a"]
    assert (a["value"], a["last_at"], a["peak_value"], a["peak_at"], a["first_value"], a["trend"], a["samples"], a["partial"], a["truncated"]) == (5.0, at(9), 9.0, at(4), 1.0, "rising", 4, False, False)
    assert (found["b"]["error"], found["b"]["samples"], found["b"]["trend"]) == ("InternalError", 0, None)
    assert (found["d"]["partial"], found["d"]["trend"]) == (True, "flat")
    assert (found["e"]["truncated"], found["e"]["partial"], found["e"]["value"]) == (True, False, 2.0)
    assert scans.metric_results(df.limit(0), ["metric"], 2).count() == 0


def test_recent_deploys(spark):
    deploys = spark.createDataFrame([(i, "s" if i < 40 else None, at(3600 * i), f"abcdef{i:04d}") for i in range(45)], "deploy_id long, service string, deployed_at timestamp, commit string")
    windows = spark.createDataFrame([("w", "s", at(3600 * 60)), ("old", "s", at(0)), ("none", None, at(0))], "window string, service string, window_end timestamp")
    found = scans.recent_deploys(deploys, windows).collect()
    assert sorted(r["deploy_id"] for r in found if r["window"] == "w") == list(range(12, 40))
    assert sorted(r["deploy_id"] for r in found if r["window"] == "old") == list(range(10, 40)) and {len(r["commit"]) for r in found} == {7}


def rate_by_hand(samples, t, span):
    once = {}
    for s, v in samples:
        once[s] = max(v, once.get(s, v))
    inside = sorted((s, v) for s, v in once.items() if t - span < s <= t)
    if len(inside) < 2:
        return None
    increase = inside[-1][1] - inside[0][1] + sum(a[1] for a, b in zip(inside, inside[1:], strict=False) if b[1] < a[1])
    sampled = inside[-1][0] - inside[0][0]
    mean = sampled / (len(inside) - 1)
    start, end = inside[0][0] - (t - span), t - inside[-1][0]
    start = start if start < mean * 1.1 else mean / 2
    if increase > 0 and inside[0][1] >= 0:
        start = min(start, sampled * inside[0][1] / increase)
    end = end if end < mean * 1.1 else mean / 2
    return increase * (sampled + start + end) / sampled / span


def test_rates_with_resets(spark):
    """Resets within and across days, gaps, samples of one time, one sample alone, a null label, samples on the grid."""
    rng = random.Random(3)
    series = {}
    for name in ("a", None, "b"):
        value, t, rows = 0.0, 86_400 - 900, []
        while t < 86_400 + 1500:
            t += rng.choice([5, 15, 15.5, 60, 200])
            value = 0.0 if rng.random() < 0.15 else value + rng.randrange(5)
            rows.append((t, value))
        series[name] = rows
    series["a"] += [series["a"][4], (series["a"][4][0], 99.0)]
    series["alone"] = [(86_400.0, 5.0)]
    rows = [(name, T0 + dt.timedelta(seconds=s), v) for name, all_of in series.items() for s, v in all_of]
    found = {(r["name"], r["at"]): r["rate"] for r in counters.rate_on_grid(spark.createDataFrame(rows, "name string, ts timestamp, value double"), ["name"]).collect()}
    epoch = (T0 - dt.datetime(1970, 1, 1)).total_seconds()
    expected = {}
    for name, all_of in series.items():
        for t in range(86_400 - 1200, 86_400 + 2400, 60):
            if (rate := rate_by_hand(all_of, t, 300)) is not None:
                expected[name, int(epoch) + t] = rate
    assert set(found) == set(expected) and all(math.isclose(found[k], expected[k], rel_tol=1e-9, abs_tol=1e-12) for k in found)


def quantile_by_hand(share, buckets):
    buckets = sorted(buckets)
    bounds, counts = [b for b, _ in buckets], []
    for _, c in buckets:
        counts.append(max(c, counts[-1] if counts else c))
    if len(bounds) < 2 or bounds[-1] != math.inf or counts[-1] <= 0:
        return None
    rank = share * counts[-1]
    i = bisect.bisect_left(counts, rank)
    if i == len(bounds) - 1:
        return bounds[-2]
    if i == 0 and bounds[0] <= 0:
        return bounds[0]
    low, under = (bounds[i - 1], counts[i - 1]) if i else (0.0, 0.0)
    return low + (bounds[i] - low) * (rank - under) / (counts[i] - under)


def test_quantiles_of_histograms(spark):
    """Empty buckets, all in the last one, counts that fall, bounds below zero, no infinite bound, one bucket, no counts; halves add up to the whole."""
    inf = math.inf
    cases = [
        [(1.0, 0.0), (2.0, 0.0), (5.0, 10.0), (inf, 10.0)], [(1.0, 0.0), (inf, 7.0)], [(1.0, 4.0), (2.0, 3.0), (4.0, 8.0), (inf, 8.0)], [(-1.0, 5.0), (1.0, 6.0), (inf, 6.0)],
        [(1.0, 3.0), (2.0, 4.0)], [(inf, 4.0)], [(1.0, 0.0), (inf, 0.0)], [(0.0, 5.0), (inf, 5.0)], [(0.5, 1.0), (1.0, 2.0), (1.5, 2.0), (2.0, 2.0), (inf, 100.0)],
    ]
    rows = [(i, half, le, c / 2) for i, case in enumerate(cases) for le, c in case for half in (0, 1)]
    df = spark.createDataFrame(rows, "case int, half int, le double, rate double")
    for share in (0.01, 0.5, 0.95, 1.0):
        found = {r["case"]: r["quantile"] for r in counters.histogram_quantile(df, ["case"], share).collect()}
        for i, case in enumerate(cases):
            expected = quantile_by_hand(share, case)
            assert found[i] == expected or math.isclose(found[i], expected), (case, share)
    assert counters.histogram_quantile(df.limit(0), ["case"], 0.5).count() == 0
