"""Evidence packs under budgets of rows and bytes, bounded parts of a context, and what each stage of the way there keeps of the signals.

Lines of all sections come as rows (incident, section, place, event_id, text). A section has a limit of rows and a pack one of bytes (UTF-8,
headers and line ends included): lines are taken by section and place as long as all up to them fit. What is left out is counted with its reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.scoring import lookup


def header(title: str) -> str:
    return f"## {title}"


def chosen_lines(lines: DataFrame, sections: dict[str, int], budget: int) -> DataFrame:
    """Lines with `position` (order in the pack), `bytes` so far and `fate`: kept, rows (over its section's limit) or bytes (over the budget).

    `sections`: titles in order with their limits of rows; lines of other sections are left out. Ties of place go by event_id and text; a null
    text is an empty line. Only lines within a section's limit take part in the sums over a pack, so these are short.
    """
    order = {title: i for i, title in enumerate(sections)}
    known = lines.filter(F.col("section").isin(*order)).withColumn("text", F.coalesce("text", F.lit("")))
    ranked = known.withColumn("row", F.row_number().over(Window.partitionBy("incident", "section").orderBy("place", "event_id", "text")))
    size = F.octet_length("text") + 1 + F.when(F.col("row") == 1, lookup({t: len(header(t).encode()) + 1 for t in sections}, F.col("section"), 0)).otherwise(0)
    ranked = ranked.withColumn("over", F.col("row") > lookup(sections, F.col("section"), 0)).withColumn("order", lookup(order, F.col("section"), 0))
    inside = ranked.filter("NOT over")
    whole = Window.partitionBy("incident").orderBy("order", "row")
    inside = inside.withColumn("position", F.row_number().over(whole)).withColumn("bytes", F.sum(size).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    inside = inside.withColumn("fate", F.when(F.col("bytes") <= budget, "kept").otherwise("bytes"))
    outside = ranked.filter("over").withColumns({"position": F.lit(None).cast("int"), "bytes": F.lit(None).cast("long"), "fate": F.lit("rows")})
    return inside.unionByName(outside).drop("over", "order")


def packs(chosen: DataFrame) -> DataFrame:
    """incident, pack (text), bytes, lines, and how many lines were left out for which reason. A pack may be empty."""
    line = F.when(F.col("row") == 1, F.concat(F.lit("## "), "section", F.lit("\n"), "text", F.lit("\n"))).otherwise(F.concat("text", F.lit("\n")))
    kept = F.col("fate") == "kept"
    found = chosen.groupBy("incident").agg(
        F.array_sort(F.collect_list(F.when(kept, F.struct(F.col("position").alias("p"), line.alias("t"))))).alias("t"), F.count_if(kept).alias("lines"),
        F.count_if(F.col("fate") == "rows").alias("over_rows"), F.count_if(F.col("fate") == "bytes").alias("over_bytes"),
    )
    pack = F.array_join(F.transform("t", lambda x: x["t"]), "")
    return found.select("incident", pack.alias("pack"), F.octet_length(pack).alias("bytes"), "lines", "over_rows", "over_bytes")


def top_parts(parts: dict[str, tuple[DataFrame, list[Column], int]]) -> DataFrame:
    """incident, part, rank, value (JSON of the row's other columns): of each part the first rows of an incident in an order."""

    def first(name: str, df: DataFrame, order: list[Column], keep: int) -> DataFrame:
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("incident").orderBy(*order))).filter(F.col("rank") <= keep)
        return ranked.select("incident", F.lit(name).alias("part"), "rank", F.to_json(F.struct(*[c for c in df.columns if c != "incident"])).alias("value"))

    return reduce(DataFrame.unionByName, [first(name, *part) for name, part in parts.items()])


def contexts(parts: DataFrame, names: list[str]) -> DataFrame:
    """incident, context: a JSON object with a list for each part, empty where an incident has none."""
    lists = parts.groupBy("incident").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == n, F.struct("rank", "value")))).alias(n) for n in names])
    fields = [F.concat(F.lit(f'"{n}":['), F.array_join(F.transform(n, lambda x: x["value"]), ","), F.lit("]")) for n in names]
    return lists.select("incident", F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("context"))


def stage_retention(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """What each stage has of the signals of the first: stage, incident, signals (distinct), retained, dropped (ids, sorted), span_ratio.

    `stages`: rows of incident, signal, at, from raw records to the pack. A signal that only a later stage has is not retained but counts.
    span_ratio: time from first to last row against that of the first stage, at most 1; 1 where that is 0. An incident that a
    stage has no rows of has zeros there. Each stage is combined by signal before the one shuffle.
    """
    rows = reduce(DataFrame.unionByName, [df.select("incident", "signal", "at", F.lit(i).alias("stage")) for i, (_, df) in enumerate(stages)])
    signals = rows.groupBy("incident", "signal", "stage").agg(F.min("at").alias("a"), F.max("at").alias("z"))
    per = signals.groupBy("incident", "signal").agg(F.collect_set("stage").alias("stages"), F.collect_list(F.struct("stage", "a", "z")).alias("spans"))
    raw = F.array_contains("stages", 0)
    out = []
    for i, (name, _) in enumerate(stages):
        has = F.array_contains("stages", i)
        span = lambda k, f, c: f(F.get(F.filter("spans", lambda s: s["stage"] == k), F.lit(0))[c])
        length = lambda k: F.coalesce(F.unix_micros(span(k, F.max, "z")) - F.unix_micros(span(k, F.min, "a")), F.lit(0))
        found = per.groupBy("incident").agg(
            F.count_if(has).alias("signals"), F.count_if(has & raw).alias("retained"), F.array_sort(F.collect_list(F.when(raw & ~has, F.col("signal")))).alias("dropped"),
            length(i).alias("own"), length(0).alias("whole"),
        )
        ratio = F.when(F.col("whole") == 0, F.when(F.col("signals") > 0, 1.0).otherwise(0.0)).otherwise(F.round(F.least(F.col("own") / F.nullif("whole", F.lit(0)), F.lit(1.0)), 4))
        out.append(found.select("incident", F.lit(name).alias("stage"), "signals", "retained", "dropped", ratio.alias("span_ratio")))
    return reduce(DataFrame.unionByName, out)
