"""Evidence packs, contexts and stage retention on small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberline.operators import packs

LINES = "incident string, section string, place long, event_id string, text string"


def pack_by_hand(rows, sections, budget):
    text, size, kept, over_rows, over_bytes = "", 0, 0, 0, 0
    for title, keep in sections.items():
        own = sorted((r for r in rows if r[1] == title), key=lambda r: (r[2], r[3], r[4] or ""))
        over_rows += len(own[keep:])
        for i, r in enumerate(own[:keep]):
            line = (f"## {title}\n" if i == 0 else "") + (r[4] or "") + "\n"
            size += len(line.encode())
            if size <= budget:
                text, kept = text + line, kept + 1
            else:
                over_bytes += 1
    return text, len(text.encode()), kept, over_rows, over_bytes


@pytest.mark.parametrize("budget", [0, 8, 30, 60, 75, 10_000])
def test_budgets_hold(spark, budget):
    """Ties, null and long texts, signs of several bytes, unknown sections, one more byte than fits."""
    sections = {"Å": 2, "B": 3, "Empty": 1}
    rows = [("i", "B", 2, "e2", "zwei ü"), ("i", "B", 1, "e1", "eins"), ("i", "B", 1, "e0", None), ("i", "B", 3, "e4", "over"), ("i", "Å", 5, "a", "x" * 20), ("i", "other", 0, "z", "never"), ("j", "B", 1, "b", "日本" * 300), ("j", "Å", 1, "b", "short")]
    chosen = packs.chosen_lines(spark.createDataFrame(rows, LINES), sections, budget)
    for r in packs.packs(chosen).collect():
        assert tuple(r)[1:] == pack_by_hand([x for x in rows if x[0] == r["incident"]], sections, budget) and r["bytes"] <= budget
    assert chosen.count() == 7 and {r["fate"] for r in chosen.collect()} <= {"kept", "rows", "bytes"}
    assert packs.packs(packs.chosen_lines(spark.createDataFrame([], LINES), sections, budget)).count() == 0


def test_contexts(spark):
    a = spark.createDataFrame([("i", "x", 3), ("i", "y", 5), ("i", "z", 5), ("j", None, 1)], "incident string, id string, n int")
    b = spark.createDataFrame([("i", 'say "hi"')], "incident string, note string")
    parts = packs.top_parts({"a": (a, [F.desc("n"), F.col("id")], 2), "b": (b, [F.col("note")], 1)})
    found = {r["incident"]: json.loads(r["context"]) for r in packs.contexts(parts, ["a", "b"]).collect()}
    assert found == {"i": {"a": [{"id": "y", "n": 5}, {"id": "z", "n": 5}], "b": [{"note": 'say "hi"'}]}, "j": {"a": [{"n": 1}], "b": []}}


def test_retention(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    make = lambda rows: spark.createDataFrame(rows, "incident string, signal string, at timestamp")
    raw = make([("i", "disk", at(0)), ("i", "net", at(100)), ("i", "net", at(50)), ("one", "x", at(5)), ("none", "y", None)])
    sample, pack = make([("i", "disk", at(0)), ("i", "disk", at(25)), ("one", "x", at(5)), ("i", "new", at(500))]), make([("i", "disk", at(0))])
    found = {(r["incident"], r["stage"]): tuple(r)[2:] for r in packs.stage_retention([("raw", raw), ("sample", sample), ("pack", pack)]).collect()}
    assert found["i", "raw"] == (2, 2, [], 1.0) and found["i", "sample"] == (2, 1, ["net"], 1.0) and found["i", "pack"] == (1, 1, ["net"], 0.0)
    assert found["one", "sample"] == (1, 1, [], 1.0) and found["one", "pack"] == (0, 0, ["x"], 0.0) and found["none", "raw"] == (1, 1, [], 1.0)
    assert packs.stage_retention([("raw", raw.limit(0)), ("pack", pack.limit(0))]).count() == 0
