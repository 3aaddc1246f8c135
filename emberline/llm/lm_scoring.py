"""Language-model scores of whole texts: a numpy self-attention model over subword ids, and a word-count base.

What is gathered from the corpus covers all training documents and grows with it:
1. One scan deals the documents into chunks of about `CHUNK_BYTES` of text where they lie and writes them to the
   shared folder once: each text as subword ids and as word numbers of its chunk, each chunk's distinct words with their
   training counts, packed by `PARTS` parts of a hash. All later steps read these rows, so chunks can't change between
   steps or after a lost executor.
2. The rows of a part meet in one of twice as many tasks as there are chunks (or as many as there are parts), which adds
   up each word's counts and gives them back by chunk. A word occurs at most once a chunk, and a chunk has far more
   distinct words than any one, so no word is more than a small share of its part.
3. Counts of subword ids, then of class follow-ups, are summed over all training texts.
4. Queries, keys, values and output weights are trained data-parallel in `ROUNDS` rounds: every partition streams its
   training texts in blocks of windows, starts from the weights of the round before and takes a step for each batch; the
   weights are averaged by the number of windows. Each window of each training text is trained on in exactly one round.
   Steps follow the windows alone, at every size. Sums meet in levels of `FAN_IN`, so no task gets them all.
5. Each token of each text is scored once in overlapping windows, where the text lies.
6. Chunks meet the corpus counts of their words (cogroup), and the base is summed.

Texts are lower-cased in A-Z; tokens are words `[^\\x20\\x09-\\x0D]+` and one end. A word's subword ids are those it has
after a space, the end is an id of its own, so the model's probability is over texts as token sequences.

Defined results: null and empty texts have the end token alone; without training documents N and V are 0 and the model
is its untrained start; a null doc_id hashes as the empty text; rows may repeat; an empty table gives an empty
result; extra columns are ignored. A group in a cogroup is one chunk: bounded, but for a text that is longer. Weights, and
so scores, depend on how the input is partitioned; counts and base do not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import attention_lm as model
from emberline.llm.bpe import Encoder, _laid, _ragged, load, vocabulary_path
from emberline.llm.common import table, written

CHUNK_BYTES = 32_000_000
ROUNDS = 2
#: Windows that are shuffled and trained on at once.
BLOCK_WINDOWS = 30_000
#: Bytes of ids that are turned into windows at once.
SLICE_BYTES = 1_000_000
#: Parts that words are dealt to by a hash. The words of a part meet in one task: a corpus of many terabytes takes more.
PARTS = 4096
#: Bytes of numbers and ids, and words, in a batch of rows.
ROW_BYTES, ROW_WORDS = 8_000_000, 200_000
#: Rows of sums that one task adds up.
FAN_IN = 32
LM_ROWS = "chunk long, doc_id long, held_out boolean, numbers binary, ids binary, part int, words binary, lengths binary, k binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(chunk, its rows): a chunk is closed when its texts reach CHUNK_BYTES."""
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < len(batch):
            to = min(len(batch), int(np.searchsorted(ends, done + CHUNK_BYTES - size)) + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - done
            at, done = to, int(ends[to - 1])
            if size >= CHUNK_BYTES:
                yield part << 24 | number, pa.Table.from_batches(held)
                number, held, size = number + 1, [], 0
    if held:
        yield part << 24 | number, pa.Table.from_batches(held)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts laid end to end, A-Z lower-cased, and how many each text has."""
    plain = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.ascii_split_whitespace(plain)
    words = parts.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    seen = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return words.filter(some), np.diff(seen[offsets])


def with_ends(numbers: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts with `end` after each text, and the new sizes."""
    out = np.empty(len(numbers) + len(counts), dtype=numbers.dtype)
    last = np.cumsum(counts + 1) - 1
    inside = np.ones(len(out), dtype=bool)
    inside[last] = False
    out[inside] = numbers
    out[last] = end
    return out, counts + 1


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary column of pieces of an array."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def word_parts(words: pa.Array, parts: int) -> np.ndarray:
    """The part of each word (not empty), by a hash of its bytes alone."""
    data, lengths = _laid(words)
    starts = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
    found = np.add.reduceat(powers.take(_ragged(np.zeros_like(lengths), lengths)) * (data + np.uint64(1)), starts)
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return ((found >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What _binary packed: all pieces laid end to end, and the size of each."""
    data, lengths = _laid(column.cast(pa.large_binary()))
    return data.view(kind), lengths // np.dtype(kind).itemsize


def _kind(size: int) -> str:
    """Type of subword ids, the end's included."""
    return "<u2" if size < 1 << 16 else "<u4"


def prepare(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Texts (chunk, doc_id, held_out, numbers, ids) and words, in the shared folder.

    Words have one row for a chunk and part: chunk, part, numbers, words laid end to end, their lengths, k (their counts in training texts).
    """
    kind = _kind(load(path).size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end_id = encoder.vocab.size
        schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("numbers", pa.binary()), ("ids", pa.binary()),
                            ("part", pa.int32()), ("words", pa.binary()), ("lengths", pa.binary()), ("k", pa.binary())])

        def out(n: int, chunk: int, **columns: pa.Array) -> pa.RecordBatch:
            columns["chunk"] = pa.array(np.full(n, chunk))
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        for chunk, rows in _chunks(batches):
            words, counts = split_words(rows.column("text").combine_chunks())
            found = words.dictionary_encode()
            numbers, distinct = found.indices.to_numpy(), found.dictionary
            train = ~rows.column("held_out").to_numpy(zero_copy_only=False)
            k = np.bincount(numbers[np.repeat(train, counts)], minlength=len(distinct))
            ids, per = encoder.encode_words(distinct)
            if len(distinct):
                part = word_parts(distinct, PARTS)
                order = np.argsort(part, kind="stable")
                part, laid = part.take(order), distinct.take(pa.array(order))
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                at = 0
                while at < len(cuts) - 1:
                    to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + ROW_WORDS, side="right")) - 1)
                    first, end, sizes = int(cuts[at]), int(cuts[to]), np.diff(cuts[at : to + 1])
                    data, lengths = _laid(laid.slice(first, end - first))
                    yield out(to - at, chunk, part=pa.array(part[cuts[at:to]]), numbers=_binary(order[first:end].astype("<i4"), sizes),
                              words=_binary(data, np.add.reduceat(lengths, np.cumsum(sizes) - sizes)), lengths=_binary(lengths.astype("<i4"), sizes),
                              k=_binary(k.take(order[first:end]).astype("<i8"), sizes))
                    at = to
            starts = np.cumsum(per) - per
            ends = np.cumsum(counts)
            at = 0
            while at < len(rows):  # texts of some megabytes at a time
                first = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, first + ROW_BYTES // 4)))
                own, sizes = numbers[first : int(ends[to - 1])], counts[at:to]
                n_ids = np.add.reduceat(np.append(per[own], 0), np.minimum(np.cumsum(sizes) - sizes, len(own))) * (sizes > 0)
                flat, id_sizes = with_ends(ids[_ragged(starts[own], per[own])], n_ids, end_id)
                piece = rows.slice(at, to - at)
                yield out(to - at, chunk, doc_id=piece.column("doc_id").combine_chunks(), held_out=piece.column("held_out").combine_chunks(),
                          numbers=_binary(own.astype("<i4"), sizes), ids=_binary(flat.astype(kind), id_sizes))
                at = to

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, LM_ROWS)
    rows = written(rows, "lm-rows")
    texts = rows.filter("part is null").select("chunk", "doc_id", "held_out", "numbers", "ids")
    return texts, rows.filter("part is not null").select("chunk", "part", "numbers", "words", "lengths", "k")


def corpus_counts(words: DataFrame, tasks: int) -> DataFrame:
    """chunk, numbers, c (counts of these words in all training texts), fresh (how many occur there and were not met in another row); in the shared folder.

    The rows of a part meet in one of `tasks` tasks, which gives one row for a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(len(b) for b in held):
            return
        rows = pa.Table.from_batches(held)
        rows = rows.cast(pa.schema([f.with_type(pa.large_binary()) if f.type == pa.binary() else f for f in rows.schema])).combine_chunks().to_batches()[0]
        (numbers, sizes), (lengths, _), (k, _) = (_numbers(rows.column(name), kind) for name, kind in (("numbers", "<i4"), ("lengths", "<i4"), ("k", "<i8")))
        # Words are numbered as they come: one is met first where the numbers rise.
        which = _binary(_laid(rows.column("words"))[0], lengths.astype(np.int64)).dictionary_encode().indices.to_numpy()
        first = np.diff(np.maximum.accumulate(which), prepend=-1) > 0
        total = np.zeros(int(which.max()) + 1, dtype=np.int64)
        np.add.at(total, which, k)
        chunk = np.repeat(rows.column("chunk").to_numpy(), sizes)
        order = np.argsort(chunk, kind="stable")
        c, found, numbers = total.take(which), chunk.take(order), numbers.take(order)
        cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        fresh = np.add.reduceat((first & (c > 0)).take(order), cuts, dtype=np.int64)
        sizes = np.diff(np.r_[cuts, len(found)])
        columns = [pa.array(found.take(cuts)), _binary(numbers, sizes).cast(pa.binary()), _binary(c.take(order).astype("<i8"), sizes).cast(pa.binary()), pa.array(fresh)]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "numbers", "c", "fresh"])

    packed = words.repartition(tasks, "part").mapInArrow(run, "chunk long, numbers binary, c binary, fresh long")
    return written(packed, "lm-counts")


def _met(df: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, last: int = 4) -> list:
    """Rows of sums, one a partition, added up in levels of FAN_IN until `last` are left for the driver."""
    parts = df.rdd.getNumPartitions()
    while parts > last:
        parts = max(last, -(-parts // FAN_IN))
        df = df.repartition(parts).mapInArrow(add, schema)
    return df.collect()


def summed(rows: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of an array of `size` numbers; tasks send one row each."""

    def row(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += count(batch)
        yield row(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), dtype="<i8")
        yield row(total)

    out = np.zeros(size)
    for r in _met(rows.mapInArrow(run, "sums binary"), add, "sums binary"):
        out += np.frombuffer(r["sums"], dtype="<i8")
    return out


def class_pairs(training: DataFrame, of: np.ndarray, kind: str) -> np.ndarray:
    """How often class b follows class a in training texts; START stands before a text."""
    n, small = model.CLASSES, of.astype(np.int32)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        ids, sizes = _numbers(batch.column(0), kind)
        after = small.take(ids)
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[np.cumsum(sizes) - sizes] = model.START
        return np.bincount(before * n + after, minlength=n * n)

    return summed(training, count, n * n).reshape(n, n)


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about SLICE_BYTES in a binary column, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + SLICE_BYTES)))
            yield batch.slice(at, to - at)
            at = to


def train(training: DataFrame, of: np.ndarray, direct: model.Params, kind: str, rounds: int = ROUNDS) -> model.Params:
    """Local steps over all windows of every partition, averaged, in rounds that take turns at the windows. `training` has ids."""
    weights = model.new_params()
    names, shapes = list(weights), {k: v.shape for k, v in weights.items()}
    small = of.astype(np.int16)

    def row(n: int, flat: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["n", "flat"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, flat = 0, None
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(x.as_buffer(), dtype=np.float64)
                n, flat = n + k, part if flat is None else flat + part
        yield from row(n, flat)

    for number in range(rounds):

        def steps(batches: Iterator[pa.RecordBatch], start=weights, number=number) -> Iterator[pa.RecordBatch]:
            model.keep_memory()
            trainer, total, seen = model.Trainer(start, direct, [TaskContext.get().partitionId(), number]), 0, 0
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def see(last: bool) -> None:
                nonlocal held, total
                c, y = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = len(c) if last else len(c) // model.TRAIN_BATCH * model.TRAIN_BATCH
                trainer.see(c[:whole], y[:whole])
                total += whole
                held = [(c[whole:], y[whole:])]

            for batch in _slices(batches, "ids"):
                ids, sizes = _numbers(batch.column(0), kind)
                c, y, count = model.windows(small.take(ids), sizes, slice((number - seen) % rounds, None, rounds))
                seen += count
                held.append((c, y))
                if sum(len(x) for x, _ in held) >= BLOCK_WINDOWS:
                    see(False)
            if sum(len(x) for x, _ in held):
                see(True)
            yield from row(total, np.concatenate([trainer.p[k].ravel() for k in names]).astype(np.float64) * total)

        sums = _met(training.mapInArrow(steps, "n long, flat binary"), add, "n long, flat binary")
        total = sum(r["n"] for r in sums)
        if not total:
            return {k: np.zeros_like(v) for k, v in weights.items()}
        flat = sum(np.frombuffer(r["flat"], dtype=np.float64) for r in sums) / total
        cuts = np.cumsum([math.prod(shapes[k]) for k in names])[:-1]
        weights = {k: x.reshape(shapes[k]).astype(np.float32) for k, x in zip(names, np.split(flat, cuts), strict=True)}
    return weights


@dataclass
class Fitted:
    """What scoring needs: class of each subword id (the end's is the last), log probability in its class, tables, weights."""

    of: np.ndarray
    in_class: np.ndarray
    direct: model.Params
    weights: model.Params
    kind: str

    def log10_probs(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts laid end to end; sizes are positive."""
        c, y, _ = model.windows(self.of.astype(np.int16).take(ids), sizes)
        rows = model.log_probs(self.weights, self.direct, c, y).sum(axis=1, dtype=np.float64)
        per = -(-sizes // model.STEP)
        total = np.add.reduceat(rows, np.cumsum(per) - per) + np.add.reduceat(self.in_class.take(ids), np.cumsum(sizes) - sizes, dtype=np.float64)
        return total / math.log(10)


def fit(texts: DataFrame, path: str) -> Fitted:
    """The model of the texts that are not held out (`texts` as prepare makes them)."""
    vocab = load(path)
    kind, size = _kind(vocab.size), vocab.size + 1
    training = texts.filter(~F.col("held_out")).select("ids")
    counts = summed(training, lambda batch: np.bincount(_numbers(batch.column(0), kind)[0], minlength=size), size)
    begins = np.array([vocab.bytes_of.get(i, b"")[:1] == b" " for i in range(vocab.size)] + [False])
    of, in_class = model.class_tables(counts, begins, vocab.size)
    direct = model.direct_tables(class_pairs(training, of, kind))
    return Fitted(of, in_class, direct, train(training, of, direct, kind), kind)


def score_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Scores of every row of documents."""
    path = path or vocabulary_path()
    texts, words = prepare(docs, path)
    # Twice as many partitions as chunks, which are alike: few chunks meet in one task, at every size.
    number = max(1, 2 * texts.select("chunk").distinct().count())
    counted = corpus_counts(words, number)
    # The row of a training text's end is no word's: ends are counted apart.
    sizes = texts.filter(~F.col("held_out")).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("numbers")), F.lit(0))).first()
    ends = sizes[0]
    n, v = sizes[1] // 4 + ends, (counted.agg(F.sum("fresh")).first()[0] or 0) + (1 if ends else 0)
    fitted = fit(texts, path)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.keep_memory()
        for batch in _slices(batches, "ids"):
            found = fitted.log10_probs(*_numbers(batch.column(4), fitted.kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found)], names=["chunk", "doc_id", "held_out", "numbers", "score"])

    scored = texts.mapInArrow(score, "chunk long, doc_id long, held_out boolean, numbers binary, score double")
    floor = math.log10(n + v + 1)

    def base(left: pa.Table, right: pa.Table) -> pa.Table:
        corpus = np.full(1, float(ends))
        if len(right):  # none where all texts of a chunk are empty
            own, c = (_numbers(right.column(name).combine_chunks(), kind)[0] for name, kind in (("numbers", "<i4"), ("c", "<i8")))
            corpus = np.full(len(own) + 1, float(ends))
            corpus[own] = c
        numbers, counts = _numbers(left.column("numbers").combine_chunks(), "<i4")
        at, counts = with_ends(numbers, counts, len(corpus) - 1)
        starts = np.cumsum(counts) - counts
        known = np.add.reduceat(corpus.take(at) > 0, starts, dtype=np.int64)
        logs = np.add.reduceat((np.log10(corpus + 1) - floor).take(at), starts)
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(counts), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(len(left), n)), "base_score": pa.array(logs), "score": left.column("score"),
        })

    left, right = (df.repartition(number, "chunk").groupBy("chunk") for df in (scored, counted.select("chunk", "numbers", "c")))
    return left.cogroup(right).applyInArrow(base, SCORES)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
