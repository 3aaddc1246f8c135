"""Ordered patterns in traces: "a marker, then directly X, later a success", for traces of any length.

A pattern becomes a small automaton. Its effect on a run of events is a function of states, an array with an entry per state, and
functions compose; so a trace is cut into chunks by position, each chunk is folded for itself, and the functions of chunks are composed in levels.
One trace may hold a third of all rows: no task sees more than `CHUNK` events or functions of it at once (positions are distinct and dense; sparse ones only
make more, smaller chunks). Everything is an aggregation over built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Events of a chunk, and functions that are composed at once.
CHUNK = 4096


@dataclass(frozen=True)
class Step:
    """Events that a step takes; `next`: directly after the step before, otherwise anywhere after it."""

    events: frozenset[str]
    next: bool = False


@dataclass(frozen=True)
class Automaton:
    """Class of each named event (others: 0), next state by class and state, and accepting states. State 0 is the start."""

    classes: dict[str, int]
    moves: list[list[int]]
    accepting: frozenset[int]


def compiled(steps: list[Step]) -> Automaton:
    """The automaton of the traces that hold the steps in order. A state is the set of numbers of steps that may have been taken so far."""
    if not steps:
        raise ValueError("a pattern has a step")
    fits = {e: tuple(e in s.events for s in steps) for s in steps for e in s.events}
    kinds = {tuple(False for _ in steps): 0}
    for fit in fits.values():
        kinds.setdefault(fit, len(kinds))
    # After k steps one may wait for the next one, unless that has to come directly; after the last one for ever.
    waits = [k for k in range(len(steps) + 1) if k == len(steps) or k == 0 or not steps[k].next]

    def move(state: frozenset[int], fit: tuple[bool, ...]) -> frozenset[int]:
        return frozenset(k for k in state if k in waits) | {k + 1 for k in state if k < len(steps) and fit[k]}

    numbers, moves, todo = {frozenset([0]): 0}, [[] for _ in kinds], [frozenset([0])]
    for state in todo:
        for fit, kind in kinds.items():
            after = move(state, fit)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            moves[kind].append(numbers[after])
    return Automaton({e: kinds[f] for e, f in fits.items()}, moves, frozenset(n for s, n in numbers.items() if len(steps) in s))


def _identity(states: int) -> Column:
    return F.sequence(F.lit(0), F.lit(states - 1))


def matched(records: DataFrame, pattern: list[Step], chunk: int = CHUNK) -> DataFrame:
    """trace, events, matched: whether the trace holds the steps of the pattern in order.

    `records`: trace, position (long), event. Events of one position are taken in the order of their names, null ones first; a null event fits no step.
    Traces without rows have none; a null trace is a trace.
    """
    if chunk < 2:
        raise ValueError("a chunk has two events at least")
    machine = compiled(pattern)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in machine.classes.items() for x in item]), F.col("event")), F.lit(0)) if machine.classes else F.lit(0)
    moves = F.array(*[F.array(*map(F.lit, row)) for row in machine.moves])
    start = _identity(len(machine.moves[0]))
    bounds = records.agg(F.min("position"), F.max("position")).first()
    low, span = bounds[0] or 0, (bounds[1] or 0) - (bounds[0] or 0)
    block = F.floor((F.col("position") - low) / chunk).cast("long")
    folded = records.select("trace", "position", "event", block.alias("block")).groupBy("trace", "block").agg(
        F.array_sort(F.collect_list(F.struct("position", "event", kind.alias("kind")))).alias("run"), F.count(F.lit(1)).alias("events")
    ).select("trace", "block", "events", F.aggregate(
        F.transform("run", lambda x: F.element_at(moves, x["kind"] + 1)), start, lambda f, move: F.transform(f, lambda s: F.element_at(move, s + 1))).alias("f"))
    blocks = span // chunk
    while blocks:
        blocks //= chunk
        folded = _composed(folded.withColumn("at", F.col("block")).withColumn("block", F.floor(F.col("block") / chunk).cast("long")), start)
    state = F.element_at("f", 1)
    return folded.select("trace", "events", state.isin(sorted(machine.accepting)).alias("matched"))


def _composed(functions: DataFrame, start: Column) -> DataFrame:
    return functions.groupBy("trace", "block").agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("fs"), F.sum("events").alias("events")).select(
        "trace", "block", "events", F.aggregate("fs", start, lambda f, g: F.transform(f, lambda s: F.element_at(g["f"], s + 1))).alias("f")
    )


def after_last(records: DataFrame, markers: list[str], chunk: int = CHUNK) -> DataFrame:
    """trace, marker (the last event that is one of `markers`), follow_up (the event after it, null at the end), ends_in_marker. Traces without a marker have no row.

    Events are ordered within chunks; each chunk also gives its first event to the chunk before.
    """
    block = F.floor(F.col("position") / chunk).cast("long")
    inside = Window.partitionBy("trace", "block").orderBy("position", "event")
    stepped = records.select("trace", "position", "event", block.alias("block")).withColumns({"after": F.lead(F.struct("event")).over(inside), "place": F.row_number().over(inside)})
    mark = F.when(F.col("event").isin(markers), F.struct("place", "event", "after"))
    chunks = stepped.groupBy("trace", "block").agg(F.max_by(mark, F.when(mark.isNotNull(), F.col("place"))).alias("mark"), F.min_by(F.struct("event"), "place").alias("first"))
    chunks = chunks.withColumn("beyond", F.lead("first").over(Window.partitionBy("trace").orderBy("block")))
    last = chunks.filter("mark IS NOT NULL").groupBy("trace").agg(F.max_by(F.struct("mark", "beyond"), "block").alias("m"))
    after = F.coalesce("m.mark.after", "m.beyond")
    return last.select("trace", F.col("m.mark.event").alias("marker"), after["event"].alias("follow_up"), after.isNull().alias("ends_in_marker"))


def follow_ups(found: DataFrame, truth: DataFrame, keep: int = 8) -> DataFrame:
    """marker, label, follow_up, traces, rank: what most often follows a marker in traces of a label. `truth` (trace, label) is joined here and not before."""
    counted = found.join(truth, "trace").groupBy("marker", "label", F.coalesce("follow_up", F.lit("end")).alias("follow_up")).agg(F.count(F.lit(1)).alias("traces"))
    order = Window.partitionBy("marker", "label").orderBy(F.desc("traces"), "follow_up")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
