"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens (its documents one after the other, each closed by an end id). In every
round a queue with share s of the mixture is credited WINDOW * s tokens and gives the whole tokens of its
credit to the window; a queue that is credited less than `QUANTUM` tokens a round saves up until it can give a
piece of QUANTUM tokens. What is not given, its deficit, is carried on to the next round. So what a queue
has given after r rounds is known in closed form:

    given(r) = min(total, whole quanta of (floor(r * WINDOW * s) + phase))

The phase (below one quantum, by a hash of the name) keeps rare queues from all giving in the same round. The
place of a token in the packed stream is a sum over queues of this form, and every task finds the windows of its own
documents without seeing others: deficits carry across windows and partitions because they follow from
the round number. Queues that have run dry give nothing and the others close ranks. The stream is cut every
WINDOW tokens: only the last sequence is short. Shares default to the sources' token totals, so all queues end
together. Over whole windows a queue is off its share by less than a quantum.

Where a document starts in its queue is the sum of what its partition holds before it (counted while
tokenising, when ids are written to the shared folder) and what earlier partitions hold (one row for each
partition and source). Nothing is gathered by source, so a hot source is no hot task. Up to `CLOSED_QUEUES` sources the
totals of all queues go to every task. With more, no list of the queues is kept anywhere: each queue's own total is joined
to its documents, their pieces are sorted by (round, queue, start), and the places are running sums over that order. Both
ways put each token in the same place; only the closed form joins pieces of a document that follow on each other.

Defined results: null text is the empty text: its end id alone; a null source is a queue of its own; repeated
rows are packed each; rows with a null doc_id are packed like others; a text is never cut off; an empty
table gives no pieces; columns other than doc_id, text and source are ignored by the operator.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.bpe import ROWS, Encoder, vocabulary_path
from emberline.llm.common import find_package, table, written

WINDOW = 1024
END_ID = 0
#: Least piece that a queue gives in a round, where its share of the window is smaller.
QUANTUM = 64
#: Shares are kept as fractions of about this many parts.
SHARE_PARTS = 1 << 16
#: Queues up to which every task knows all totals (some 100 bytes each); more are sorted.
CLOSED_QUEUES = 20_000
#: Rows of the table of partition totals up to which it is broadcast.
BROADCAST_ROWS = 200_000
#: Cells of rounds x queues, and pieces, that are worked on at once.
CELLS, PIECES_AT_ONCE = 1 << 20, 1 << 20

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, ids binary"
)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, queue, part, before (its queue's tokens in this partition before it), n_tokens, ids; in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, so_far = Encoder(path), {}
        part = TaskContext.get().partitionId()
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            queues = batch.column(2).to_pylist()
            for at, ids in encoder.blocks(batch.column(1).to_pylist()):
                before, counts, packed = [], [], []
                for queue, x in zip(queues[at : at + len(ids)], ids, strict=True):
                    n = len(x) + 1
                    before.append(so_far.get(queue, 0))
                    so_far[queue] = before[-1] + n
                    counts.append(n)
                    packed.append(x.tobytes() + END_ID.to_bytes(4, "little"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(ids)), batch.column(2).slice(at, len(ids)), pa.array([part] * len(ids), pa.int32()),
                     pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "queue", "part", "before", "n_tokens", "ids"],
                )

    rows = docs.mapInArrow(run, "doc_id long, queue string, part int, before long, n_tokens long, ids binary")
    return written(rows, "packing-tokens")


def with_queue(docs: DataFrame) -> DataFrame:
    """doc_id, text, queue: the source after a letter, or N for none."""
    return docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("S"), F.col("source")), F.lit("N")).alias("queue"))


def weight_of(share: float, whole: float) -> int:
    """Parts of the mixture, at least 1."""
    return max(1, math.floor(share / (whole or 1.0) * SHARE_PARTS + 0.5))


def phase_of(queue: str) -> int:
    return zlib.crc32(queue.encode()) % QUANTUM


def _scaled(x: np.ndarray, by: np.ndarray, over: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """floor(x * by / over) and the rest, without overflow of x * by."""
    whole, rest = np.divmod(x, over)
    more, rest = np.divmod(rest * by, over)
    return whole * by + more, rest


def given(rounds: np.ndarray, totals: np.ndarray, weights: np.ndarray, phases: np.ndarray, parts: int) -> np.ndarray:
    """Tokens that queues have given when so many rounds are over (arrays that broadcast)."""
    credit, _ = _scaled(rounds, WINDOW * weights, parts)
    saved = (credit + phases) // QUANTUM * QUANTUM
    return np.minimum(np.where(WINDOW * weights < QUANTUM * parts, saved, credit), totals)


def round_of(token: np.ndarray, weights: np.ndarray, phases: np.ndarray, parts: int) -> np.ndarray:
    """The round in which a queue gives its token of this number, if it has that many."""
    rare = WINDOW * weights < QUANTUM * parts
    due = np.where(rare, (token // QUANTUM + 1) * QUANTUM - phases, token + 1)
    whole, rest = _scaled(due, np.int64(parts), WINDOW * weights)
    return whole + (rest > 0) - 1


def pieces(first: np.ndarray, count: np.ndarray, weights: np.ndarray, phases: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, round, start in its queue, length) of what is given of documents (first token, tokens >= 1) in one round each."""
    last = first + count - 1
    rare = WINDOW * weights < QUANTUM * parts
    low = np.where(rare, first // QUANTUM, round_of(first, weights, phases, parts))
    each = np.where(rare, last // QUANTUM, round_of(last, weights, phases, parts)) - low + 1
    which = np.repeat(np.arange(len(first)), each)
    step = np.repeat(low - np.cumsum(each) + each, each) + np.arange(len(which))
    w, rare = weights[which], rare[which]
    begin = np.where(rare, step * QUANTUM, _scaled(step, WINDOW * w, parts)[0])
    end = np.where(rare, begin + QUANTUM, _scaled(step + 1, WINDOW * w, parts)[0])
    start = np.maximum(begin, first[which])
    length = np.minimum(end, last[which] + 1) - start
    rounds = np.where(rare, round_of(start, w, phases[which], parts), step)
    some = length > 0
    return which[some], rounds[some], start[some], length[some]


class Schedule:
    """Places in the stream from the totals of all queues."""

    def __init__(self, totals: Mapping[str, int], shares: Mapping[str, float]) -> None:
        self.names = sorted(totals, key=str.encode)
        self.at = {q: i for i, q in enumerate(self.names)}
        self.totals = np.array([totals[q] for q in self.names], dtype=np.int64)
        whole = float(sum(shares.get(q, 0) for q in self.names))
        self.weights = np.array([weight_of(shares.get(q, 0), whole) for q in self.names], dtype=np.int64)
        self.phases = np.array([phase_of(q) for q in self.names], dtype=np.int64)
        self.parts = int(self.weights.sum())

    def places(self, queue: np.ndarray, rounds: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Place in the stream of the token `start` of a queue that is given in a round."""
        out = np.empty(len(queue), dtype=np.int64)
        distinct, which = np.unique(rounds, return_inverse=True)
        order = np.argsort(which, kind="stable")
        step = max(1, CELLS // len(self.names))
        for i in range(0, len(distinct), step):
            r = distinct[i : i + step, None]
            before = given(r, self.totals, self.weights, self.phases, self.parts)
            gives = given(r + 1, self.totals, self.weights, self.phases, self.parts) - before
            ahead = np.cumsum(gives, axis=1) - gives + before.sum(axis=1)[:, None] - before
            at = order[np.searchsorted(which, i, sorter=order) : np.searchsorted(which, i + step, sorter=order)]
            out[at] = ahead[which[at] - i, queue[at]] + start[at]
        return out


def cut(which: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join runs of a document that follow on each other in the stream, then cut them at window ends."""
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1] + length[:-1]) | (which[1:] != which[:-1])])
    which, start, place, length = which[head], start[head], place[head], np.add.reduceat(length, head)
    windows = (place + length - 1) // WINDOW - place // WINDOW + 1
    each = np.repeat(np.arange(len(start)), windows)
    k = np.arange(len(each)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.maximum(place[each], (place[each] // WINDOW + k) * WINDOW)
    end = np.minimum(place[each] + length[each], (place[each] // WINDOW + k + 1) * WINDOW)
    return which[each], start[each] + begin - place[each], end - begin, begin


def _blocks(batches: Iterator[pa.RecordBatch], column: int, bound: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches in which the numbers of a column add up to about `bound` at most, or of one row."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).to_numpy())
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + bound)))
            yield batch.slice(at, to - at)
            at = to


def _out(doc_ids: pa.Array, queues: pa.Array, n: np.ndarray, which: np.ndarray, ids: pa.Array, offset: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, with_ids: bool) -> pa.RecordBatch:
    """Finished pieces. `offset`: the token of a row's document at which its ids begin; `start`: from the document's first token."""
    bounds = ids.buffers()[1]
    at = np.frombuffer(bounds, dtype=np.int32)[ids.offset : ids.offset + len(ids)].astype(np.int64)
    data = memoryview(ids.buffers()[2])
    low = at[which] + (start - offset[which]) * 4
    edges = list(zip(low.tolist(), (low + length * 4).tolist(), strict=True))
    crcs = np.fromiter((zlib.crc32(data[a:b]) for a, b in edges), dtype=np.int64, count=len(edges))
    parts = pa.array([bytes(data[a:b]) for a, b in edges], pa.binary()) if with_ids else pa.nulls(len(edges), pa.binary())
    each = pa.array(which)
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(each), pa.array(start), pa.array(length), pa.array(crcs), pa.array(n[which]), pa.array(place // WINDOW), pa.array(place % WINDOW), queues.take(each), parts],
        names=[x.split()[0] for x in PIECES.split(", ")],
    )


def place_closed(rows: DataFrame, plan: Schedule, with_ids: bool) -> DataFrame:
    """Pieces of rows (doc_id, queue, first, n_tokens, ids) by the closed form; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A document has at most as many pieces as tokens, and mostly far fewer.
        for batch in _blocks(batches, 3, PIECES_AT_ONCE * 4):
            queue = np.array([plan.at[q] for q in batch.column(1).to_pylist()])
            first, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            which, rounds, start, length = pieces(first, n, plan.weights[queue], plan.phases[queue], plan.parts)
            place = plan.places(queue[which], rounds, start)
            which, start, length, place = cut(which, start, length, place)
            yield _out(batch.column(0), batch.column(1), n, which, batch.column(4), np.zeros_like(first), start - first[which], length, place, with_ids)

    return rows.mapInArrow(run, PIECES)


def place_sorted(rows: DataFrame, totals: DataFrame, parts: int, with_ids: bool) -> DataFrame:
    """The same for any number of queues. `totals`: queue, weight of each; pieces are sorted, places are running sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, 3, PIECES_AT_ONCE):
            first, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            phases = np.array([phase_of(q) for q in batch.column(1).to_pylist()], dtype=np.int64)
            which, rounds, start, length = pieces(first, n, batch.column(5).to_numpy(), phases, parts)
            at = np.frombuffer(batch.column(4).buffers()[1], dtype=np.int32)[batch.column(4).offset :].astype(np.int64)[which] + (start - first[which]) * 4
            data = memoryview(batch.column(4).buffers()[2])
            ids = pa.array([bytes(data[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)], pa.binary())
            each = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rounds), batch.column(1).take(each), pa.array(start), pa.array(length), batch.column(0).take(each), pa.array(first[which]), pa.array(n[which]), ids],
                names=["round", "queue", "start", "length", "doc_id", "first", "n_tokens", "ids"],
            )

    found = rows.join(totals, "queue").select("doc_id", "queue", "first", "n_tokens", "ids", "weight")
    found = found.mapInArrow(run, "round long, queue string, start long, length long, doc_id long, first long, n_tokens long, ids binary")
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written: two reads of one range partitioning need not cut at the same keys.
    found = written(found.repartitionByRange(number, "round", "queue", "start").sortWithinPartitions("round", "queue", "start").withColumn("part", F.spark_partition_id()), "packing-pieces")
    # One row a partition.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skips = found.groupBy("part").agg(F.sum("length").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ahead = Window.partitionBy("part").orderBy("round", "queue", "start").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.join(F.broadcast(skips), "part").withColumn("place", F.col("skip") + F.coalesce(F.sum("length").over(ahead), F.lit(0)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, 3, PIECES_AT_ONCE):
            first, n, start = (batch.column(i).to_numpy() for i in (5, 6, 2))
            offset = start - first
            which, begin, length, place = cut(np.arange(len(batch)), offset, batch.column(3).to_numpy(), batch.column(8).to_numpy())
            yield _out(batch.column(4), batch.column(1), n, which, batch.column(7), offset, begin, length, place, with_ids)

    columns = ["round", "queue", "start", "length", "doc_id", "first", "n_tokens", "ids", "place"]
    return placed.select(columns).mapInArrow(finish, PIECES)


def pack(docs: DataFrame, path: str | None = None, shares: Mapping[str, float] | None = None, with_ids: bool = True, closed_queues: int = CLOSED_QUEUES) -> DataFrame:
    """Pieces of all documents with their sequence and offset; `ids` is null without `with_ids`.

    `shares` maps sources to parts of the mixture; a source left out has the least share and fills in at the end.
    """
    spark = docs.sparkSession
    find_package(spark)
    tokens = tokenised(with_queue(docs), path or vocabulary_path())
    per_part = tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    rows = tokens.join(offsets, ["part", "queue"]).select("doc_id", "queue", (F.col("skip") + F.col("before")).alias("first"), "n_tokens", "ids")
    totals = per_part.groupBy("queue").agg(F.sum("n").alias("n"))
    named = None if shares is None else {("N" if k is None else f"S{k}"): float(v) for k, v in shares.items()}
    if totals.count() <= closed_queues:
        of = {r["queue"]: r["n"] for r in totals.collect()}
        return place_closed(rows, Schedule(of, of if named is None else named), with_ids)
    if named is None:
        totals = totals.select("queue", F.col("n").cast("double").alias("share"))
    else:
        given_shares = spark.createDataFrame(list(named.items()), "queue string, share double")
        totals = totals.join(given_shares, "queue", "left").select("queue", F.coalesce("share", F.lit(0.0)).alias("share"))
    whole = totals.agg(F.sum("share")).first()[0] or 1.0
    weight = F.greatest(F.lit(1), F.floor(F.col("share") / whole * SHARE_PARTS + 0.5)).cast("long")
    totals = totals.select("queue", weight.alias("weight"))
    return place_sorted(rows, totals, totals.agg(F.sum("weight")).first()[0], with_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
