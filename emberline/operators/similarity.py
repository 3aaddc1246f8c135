"""Pairs of messages that are alike by matching blocks (Ratcliff-Obershelp ratio), exactly, without comparing all pairs of a block.

The ratio of two texts is twice the length of their matching blocks by their length in all. It can't exceed twice the shorter length, nor twice the
signs that they share (counted in `CLASSES` classes of signs), by their length in all. Lengths of a pair at or over the bound differ by a factor at most, so texts meet
by blocking keys and length bands, each with its own band and the next; the shared signs of what meets are counted by built-in expressions, and only what
is left is compared, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from emberline.storage import find_package

#: Ratio from which two messages of different groups are a pair to be reviewed.
NEAR = 0.55
CLASSES = 48


def matching_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the matching blocks: the longest common run (of equally long ones the first in a, then in b), and again left and right of it."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        best, at, bt = 0, 0, 0
        runs = np.zeros(bhi - blo + 1, dtype=np.int32)
        part = b[blo:bhi]
        for i in range(alo, ahi):
            runs[1:] = np.where(part == a[i], runs[:-1] + 1, 0)
            j = int(runs.argmax())
            if runs[j] > best:
                best, at, bt = int(runs[j]), i + 1, blo + j
        if best:
            total += best
            if alo < at - best and blo < bt - best:
                todo.append((alo, at - best, blo, bt - best))
            if at < ahi and bt < bhi:
                todo.append((at, ahi, bt, bhi))
    return total


def matching_ratio(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    x, y = (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (a, b))
    return 2.0 * matching_length(x, y) / (len(x) + len(y))


@F.pandas_udf(DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([matching_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sign_counts(text: Column) -> Column:
    """How many signs of each class a text has; a class is the sign's number modulo CLASSES."""
    signs = F.transform(F.split(text, ""), lambda c: F.pmod(F.ascii(c), F.lit(CLASSES)))
    return F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.size(F.filter(signs, lambda s: s == k)))


def band(length: Column, ratio: float) -> Column:
    """Texts whose bands differ by more than one have lengths that differ by more than the ratio allows (and a little, against rounding)."""
    return F.floor(F.log(1.0001 * (2 - ratio) / ratio, F.greatest(length, F.lit(1)))).cast("int")


def candidate_pairs(texts: DataFrame, block: list[str], ratio: float = NEAR) -> DataFrame:
    """Pairs of a block, earlier `ordinal` on the left, that may reach `ratio`: block, left_id, left_at, a, right_id, right_at, b. `texts`: block, id, ordinal, text."""
    rows = texts.select(*block, "id", "ordinal", F.col("text").alias("t"), F.length("text").alias("n"), sign_counts(F.col("text")).alias("signs")).withColumn("band", band(F.col("n"), ratio))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in block]
    left, right = rows.alias("l"), rows.withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("r")
    both = F.col("l.n") + F.col("r.n")
    shared = F.aggregate(F.zip_with("l.signs", "r.signs", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    fits = (2 * F.least("l.n", "r.n") >= ratio * both - 1e-9) & (2 * shared >= ratio * both - 1e-9)
    met = left.join(right, [*keys, F.col("l.band") == F.col("r.near"), F.col("l.ordinal") < F.col("r.ordinal")]).filter(fits)
    return met.select(*[F.col(f"l.{c}").alias(c) for c in block], F.col("l.id").alias("left_id"), F.col("l.ordinal").alias("left_at"), F.col("l.t").alias("a"),
                      F.col("r.id").alias("right_id"), F.col("r.ordinal").alias("right_at"), F.col("r.t").alias("b"))


def _pair_id(a: str, b: str) -> Column:
    return F.concat(F.lit("pair-"), F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 16))


def near_pairs(groups: DataFrame, block: list[str], text: str, ratio: float = NEAR) -> DataFrame:
    """For each group its most similar later one of the block, where similar enough (ties: the larger id): block, left_id, right_id, ratio, pair_id.

    `groups`: one row a group with event_id, ordinal and a text, compared in lower case; null texts are empty, two empty texts are alike.
    """
    find_package(groups.sparkSession)
    texts = groups.select(*block, F.col("event_id").alias("id"), "ordinal", F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    scored = candidate_pairs(texts, block, ratio).withColumn("ratio", _ratio("a", "b")).filter(F.col("ratio") >= ratio)
    best = Window.partitionBy("left_id").orderBy(F.desc("ratio"), F.desc("right_id"))
    first = scored.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return first.select(*block, "left_id", "right_id", F.round("ratio", 6).alias("ratio"), _pair_id("left_id", "right_id").alias("pair_id"))


def variant_pairs(records: DataFrame, group: list[str]) -> DataFrame:
    """The first and the last variant of each group with two messages or more: group, left_id, right_id, ratio, pair_id. `records`: group, id, message.

    A variant is a distinct message under its first id; ids order variants.
    """
    find_package(records.sparkSession)
    variants = records.groupBy(*group, F.coalesce("message", F.lit("")).alias("message")).agg(F.min("id").alias("id"))
    ends = variants.groupBy(*group).agg(F.min(F.struct("id", "message")).alias("a"), F.max(F.struct("id", "message")).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = ends.select(*group, F.col("a.id").cast("string").alias("left_id"), F.col("b.id").cast("string").alias("right_id"), _ratio(F.lower("a.message"), F.lower("b.message")).alias("ratio"))
    return found.select(*group, "left_id", "right_id", F.round("ratio", 6).alias("ratio"), _pair_id("left_id", "right_id").alias("pair_id"))
