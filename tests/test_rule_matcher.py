"""Rule files, and the shared matcher against each expression alone."""

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.functions.text import SIGNALS
from emberline.operators import rule_matcher, rules
from emberline.sources import rule_files

FILES = {
    "b.md": "---\nid: b-rule\ntitle: 'It''s b'\nlevel: high\ncategory: c # why\ntags:\n  - x\n  - y\nselection:\n  message_regex: \"a \\\"b\\\"|c\\\\d\"\n  level: [error, warn]\n---\n# Title\n\nLook here.\nAnd there.\n",
    "a.yaml": "# comment\nid: a-rule\nlevel: low\nselection:\n  level: error\n  first_seen_within_minutes_after_deploy: 15\nrunbook: https://x.example/y\nempty:\n",
    "c.md": "only a body", "notes.txt": "id: no",
}


def test_files(spark, tmp_path):
    rule_files.write_rules(spark.createDataFrame(list(FILES.items()), "name string, text string"), str(tmp_path / "rules"))
    a, b, c = rule_files.read_rules(spark, str(tmp_path / "rules"))
    assert (a["id"], a["levels"], a["minutes_after_deploy"], a["message_regex"], a["runbook"]) == ("a-rule", ["error"], 15, None, "https://x.example/y")
    assert (b["id"], b["title"], b["category"], b["message_regex"], b["levels"], b["hint"]) == ("b-rule", "It's b", "c", 'a "b"|c\\d', ["error", "warn"], "Look here.\nAnd there.")
    assert (c["id"], c["hint"]) == (None, "only a body")
    assert rule_files.parse_fields("") == {} and rule_files.parse_fields("x: [1, 2.5, true, null]") == {"x": [1, 2.5, True, None]}
    for bad in ("a b", "- x\n- y", "a:\n    b: 1\n  c: 2"):
        with pytest.raises(ValueError):
            rule_files.parse_fields(bad)


def test_literals():
    known = {
        "abc": {"abc"}, "(?:abc|def)x+": {"abc", "def"}, "a.*bcd": {"bcd"}, "(abcd)?": None, "[ab]c": None, "(foo|)bar": {"bar"}, "x{0,3}": None, "(abc){2}": {"abc"},
        "ABC": {"abc"}, "a|bcd": None, "(?=abc)de": None, "abc(?!def)": {"abc"}, "éabc": {"abc"}, r"\babc\b": {"abc"}, "(?i:ABC)d": {"abc"},
    }
    for pattern, expected in known.items():
        assert rule_matcher.literals(pattern) == (frozenset(expected) if expected else None), pattern


@settings(max_examples=150, deadline=None)
@given(st.lists(st.from_regex(r"\A(a|b|ab|[ab]|x\?|\(ab\|ba\)\+?|\(abc\|cab\)|abb\*|c\{1,2\}){1,5}\Z"), min_size=1, max_size=8), st.lists(st.text("abcABCx é", max_size=12), max_size=8))
def test_matcher_equals_each_expression(patterns, texts):
    matcher = rule_matcher.Matcher(patterns)
    for text in [*texts, None, ""]:
        assert matcher.match(text) == [i for i, p in enumerate(patterns) if re.search(p, text or "", rule_matcher.FLAGS)]


def test_matches_equal_rlike(spark):
    """All built-in rules and signals against Spark's own matching, over messages that they match and some in odd case."""
    patterns = [r["message_regex"] for r in rules.DETECTIONS + rules.SUPPRESSIONS if "message_regex" in r] + [s[5].removeprefix("(?i)") for s in SIGNALS]
    texts = ["OOMKILLED now", "http 429", "HTTP\t504 x", "x509: bad", "", None, "connection reset by peer", "no space left on device", "Kunde K", "disk full", "java.lang.OutOfMemoryError", "Failed over", "killed by the kernel", "upstream  timeout"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, m string")
    own = F.array_compact(F.array(*[F.when(F.rlike(F.coalesce("m", F.lit("")), F.lit("(?i)" + p)), i) for i, p in enumerate(patterns)]))
    rows = df.select("id", rule_matcher.matches(F.col("m"), patterns).alias("found"), own.alias("own")).collect()
    assert all(r["found"] == r["own"] for r in rows) and sum(len(r["found"]) for r in rows) > 5


def test_a_thousand_rules_cost_little_more_than_ten():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=20)) for _ in range(3000)]

    def cost(n):
        matcher = rule_matcher.Matcher([rf"{rng.choice(words)}\s+{rng.choice(words)}|code=\d+ x{i}" for i in range(n)])
        begun = time.process_time()
        for t in texts:
            matcher.match(t)
        return time.process_time() - begun

    assert cost(1000) < 20 * cost(10)


def test_groups_and_conditions(spark):
    """A later message of a group counts; levels, deployments, a rule without expression, groups without match, null fields, no rows."""
    records = spark.createDataFrame([("g", "nothing"), ("g", "disk FULL"), ("g", "disk full"), ("h", None), ("i", "disk full")], "event_id string, message string")
    chosen = [
        {"id": "late", "level": "low", "category": "x", "minutes_after_deploy": 15}, {"id": "disk", "level": "high", "category": "y", "message_regex": "disk full", "levels": ["error"]},
        {"id": "empty", "level": "odd", "category": None, "message_regex": "^$"},
    ]
    matched = rule_matcher.group_matches(records, ["event_id"], ["disk full", "^$"])
    assert {r["event_id"]: r["rules"] for r in matched.collect()} == {"g": [0], "h": [1], "i": [0]}
    groups = spark.createDataFrame([("g", "error", 3.0), ("h", None, None), ("i", "info", 15.1), ("j", "error", 15.0)], "event_id string, level string, after_deploy double")
    found = rule_matcher.detections(groups, matched, ["event_id"], chosen)
    assert {(r["event_id"], r["rule_id"], r["rule_rank"]) for r in found.collect()} == {("g", "late", 1), ("g", "disk", 3), ("h", "empty", 0), ("j", "late", 1)}
    assert rule_matcher.detections(groups.limit(0), matched, ["event_id"], chosen).count() == 0
    assert rule_matcher.detections(groups, matched, ["event_id"], chosen[:1]).count() == 2
    assert rule_matcher.group_matches(records.limit(0), ["event_id"], ["a"]).count() == 0
