"""Analysis revisions under late evidence and review decisions: one step function, folded over a stream's state or over a table.

Events of an incident, in the order of their time: `evidence` (evidence_id) and `decision` (expected revision, decision, selected hypothesis,
request_id). Evidence goes to the current revision; a decided revision is frozen, so evidence after it opens the next one. Evidence that the incident has
already is a duplicate. A decision must name the current revision: one for another is stale, one more for a decided revision is refused
unless it is the same decision again.

The stream keeps a head of fixed size and the known evidence ids of each incident in its state store (RocksDB: on disk, with change logs in the
checkpoint), and tells when a revision has been quiet for some time by a timer. Batches are committed under their number, so a replayed one replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from datetime import datetime, timedelta
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from emberline.storage import find_package

EVENT = "incident string, ts timestamp, ordinal long, kind string, evidence_id string, expected int, decision string, selected string, request_id string"
OUTCOME = "incident string, ordinal long, kind string, revision int, outcome string, reason string"
FIELDS = [f.split()[0] for f in OUTCOME.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Decisions, and outcomes with their reasons.
DECISIONS = ("approved", "rejected", "request_more_evidence")
OPENED = {"": "first_evidence", "approved": "late_evidence", "rejected": "late_evidence", "request_more_evidence": "requested_evidence"}


@dataclass
class Head:
    """An incident's current revision (0: none), whether it is decided, by which decision, and the key of that."""

    revision: int = 0
    frozen: bool = False
    decision: str = ""
    decided: str = ""


def decision_key(expected: Any, decision: str, selected: str | None, request_id: str | None) -> str:
    return "|".join(str(x) for x in (expected, decision, selected or "", request_id or ""))


def step(head: Head, known: bool, kind: str, expected: Any, decision: str | None, selected: str | None, request_id: str | None) -> tuple[Head, str, str | None]:
    """The head after an event, its outcome and the reason. `known`: the incident has this evidence already."""
    if kind == "evidence":
        if known:
            return head, "duplicate", None
        if head.revision and not head.frozen:
            return head, "added", None
        return Head(head.revision + 1), "opened", OPENED[head.decision]
    if not head.revision:
        return head, "refused", "no_revision"
    if expected is None or int(expected) != head.revision:
        return head, "refused", "stale_revision"
    if decision not in DECISIONS or (decision == "approved" and not selected):
        return head, "refused", "invalid_decision" if decision not in DECISIONS else "no_selection"
    key = decision_key(int(expected), decision, selected, request_id)
    if head.frozen:
        return head, *(("repeated", None) if key == head.decided else ("refused", "already_decided"))
    return Head(head.revision, True, decision, key), "decided", None


def replayed(events: DataFrame) -> DataFrame:
    """Outcomes of a table of events (as EVENT): rows of an incident are sorted and folded one after the other, holding its head and evidence ids."""
    find_package(events.sparkSession)
    names = [f.split()[0] for f in EVENT.split(", ")]
    schema = pa.schema([("incident", pa.string()), ("ordinal", pa.int64()), ("kind", pa.string()), ("revision", pa.int32()), ("outcome", pa.string()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, known = None, Head(), set()
        for batch in batches:
            out = []
            for incident, _, ordinal, kind, evidence, expected, decision, selected, request in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if incident != now:
                    now, head, known = incident, Head(), set()
                head, outcome, reason = step(head, evidence in known, kind, expected, decision, selected, request)
                if kind == "evidence":
                    known.add(evidence)
                out.append((incident, ordinal, kind, head.revision, outcome, reason))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return events.select(*names).repartition("incident").sortWithinPartitions("incident", "ts", "ordinal").mapInArrow(run, OUTCOME)


class Revisions(StatefulProcessor):
    """The same steps over a stream; `quiet` seconds of event time after its last evidence an undecided revision is said to be ready."""

    def __init__(self, quiet: int) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "revision int, frozen boolean, decision string, decided string, timer long")
        self.known = handle.getMapState("known", "evidence_id string", "revision int")

    def _load(self) -> tuple[Head, int]:
        found = self.head.get() if self.head.exists() else None
        return (Head(*found[:4]), int(found[4])) if found else (Head(), 0)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        head, timer = self._load()
        out = []
        for part in rows:
            for r in part.sort_values(["ts", "ordinal"]).itertuples(index=False):
                plain = lambda v: None if v is None or pd.isna(v) else v
                evidence = str(plain(r.evidence_id) or "")
                known = r.kind == "evidence" and self.known.containsKey((evidence,))
                head, outcome, reason = step(head, known, r.kind, plain(r.expected), plain(r.decision), plain(r.selected), plain(r.request_id))
                if r.kind == "evidence" and not known:
                    self.known.updateValue((evidence,), (head.revision,))
                    due = int((r.ts.to_pydatetime() + timedelta(seconds=self.quiet) - datetime(1970, 1, 1)).total_seconds() * 1000)
                    if due > timer:
                        if timer:
                            self.handle.deleteTimer(timer)
                        self.handle.registerTimer(due)
                        timer = due
                out.append((key[0], int(r.ordinal), r.kind, head.revision, outcome, reason))
        self.head.update((*astuple(head), timer))
        yield pd.DataFrame(out, columns=FIELDS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        head, _ = self._load()
        self.head.update((*astuple(head), 0))
        rows = [] if head.frozen else [(key[0], None, "timer", head.revision, "ready", None)]
        yield pd.DataFrame(rows, columns=FIELDS)

    def close(self) -> None:
        """Nothing is held outside the state."""


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    find_package(spark)


def revision_stream(events: DataFrame, late: str, quiet: int) -> DataFrame:
    """Outcomes of a stream of events (as EVENT); later than the watermark they still count, as late evidence does."""
    use_state_store(events.sparkSession)
    return events.withWatermark("ts", late).groupBy("incident").transformWithStateInPandas(Revisions(quiet), OUTCOME, "Append", "EventTime")


def commit_batch(path: str, df: DataFrame, batch_id: int) -> None:
    """Write a batch under its number; doing it again replaces it by the same."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def committed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there and stop."""
    return stream.writeStream.foreachBatch(lambda df, number: commit_batch(path, df, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
