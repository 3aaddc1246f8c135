"""Many regular expressions over many messages: one automaton of literals decides which expressions are tried at all.

Of each expression literals are worked out of which every match holds at least one. All of them go into one automaton, which reads a message
once, whatever the number of rules; only rules with a literal in it (and the few that have none) are tried as expressions. The result
is that of each expression alone, letters A-Z in either case. A task compiles the rules once, and tries each distinct message of a batch once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.literals import FLAGS, literals
from emberline.operators.rules import RULE_LEVELS
from emberline.storage import find_package


class Matcher:
    """Which of a list of expressions a text has a match of."""

    def __init__(self, patterns: list[str]) -> None:
        self.expressions = [re.compile(p, FLAGS) for p in patterns]
        owners: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, p in enumerate(patterns):
            known = literals(p)
            for text in known or ():
                owners.setdefault(text, []).append(i)
            if known is None:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for text, rules in owners.items():
            self.automaton.add_word(text, tuple(rules))
        if owners:
            self.automaton.make_automaton()
        self.known = bool(owners)

    def candidates(self, text: str) -> list[int]:
        found = set(self.always)
        if self.known:
            for _, rules in self.automaton.iter(text.lower()):
                found.update(rules)
        return sorted(found)

    def match(self, text: str | None) -> list[int]:
        """Indexes, ascending; null and empty texts are matched as empty."""
        text = text or ""
        return [i for i in self.candidates(text) if self.expressions[i].search(text)]


def matches(message: Column, patterns: list[str]) -> Column:
    """array<int>: indexes of the expressions that a message has a match of."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(patterns)
        for texts in batches:
            codes, distinct = pd.factorize(texts, use_na_sentinel=False)
            found = [matcher.match(t if isinstance(t, str) else None) for t in distinct]
            yield pd.Series([found[c] for c in codes], index=texts.index)

    return run(message)


def group_matches(records: DataFrame, keys: list[str], patterns: list[str], message: str = "message") -> DataFrame:
    """keys, rules (array<int>, ascending): the expressions that any message of a group matches. Groups without a match have an empty array.

    Each task sends one row a group and rule; groups of any size are fine.
    """
    find_package(records.sparkSession)
    found = records.select(*keys, F.explode_outer(matches(F.col(message), patterns)).alias("rule")).distinct()
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def detections(groups: DataFrame, matched: DataFrame, keys: list[str], rules: list[dict[str, Any]]) -> DataFrame:
    """A row for every rule that a group matches: its expression (by any message), its levels, its deployment window.

    `matched`: group_matches over the rules that have an expression, in their order. `groups` has level and after_deploy (minutes, or null).
    """
    with_regex = [i for i, r in enumerate(rules) if r.get("message_regex")]
    without = [i for i, r in enumerate(rules) if not r.get("message_regex")]
    to_rule = F.array(*map(F.lit, with_regex)) if with_regex else F.array().cast("array<int>")
    ids = F.concat(F.transform(F.coalesce("rules", F.array().cast("array<int>")), lambda i: F.try_element_at(to_rule, i + 1)), F.array(*map(F.lit, without)).cast("array<int>"))
    rows = groups.join(matched, keys, "left").withColumn("rule", F.explode(F.array_distinct(ids)))
    fields = "rule int, rule_id string, rule_level string, category string, rule_rank int, levels array<string>, minutes int"
    table = groups.sparkSession.createDataFrame(
        [(i, r["id"], r["level"], r["category"], RULE_LEVELS.get(r["level"], 0), r.get("levels"), r.get("minutes_after_deploy")) for i, r in enumerate(rules)], fields
    )
    level = F.col("levels").isNull() | F.array_contains("levels", F.col("level"))
    deployed = F.col("minutes").isNull() | F.col("after_deploy").between(0, F.col("minutes"))
    return rows.join(F.broadcast(table), "rule").filter(F.coalesce(level & deployed, F.lit(False))).drop("rules", "rule", "levels", "minutes")
