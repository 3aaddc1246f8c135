"""Product codes of integer vectors, with codebooks by an Exponion search.

Components become floor(1024 x); a vector is cut into `PARTS` equal consecutive parts, and each part position has a codebook of
at most `ENTRIES` entries. In each of `ROUNDS` rounds every part goes to its nearest entry and every entry becomes the floor of
its parts' mean; unused entries stay. Then parts are assigned once more.

The search of a part starts at the entry it had before (entry 0 in the first round) with exact squared distance d. An entry
nearer than that, or as near, lies within twice the distance of the old entry (triangle inequality), so the old entry's
neighbours, sorted by squared distance, are scanned up to 4 d and no further. Ties go to the lower index. Distances are integers:
in float64 while all terms stay under 2^53, where it is exact, in Python's integers beyond.

A round reads vectors with their codes, writes both with the new codes, and writes each task's sums per entry beside them, in
one job, by a commit that holds for both. Sums are added in Spark; what comes to the driver are codebooks, whose size is a
parameter. Files lie in the shared folder, so a lost executor costs its tasks only.

Defined results: rows whose vector is null, empty or holds a null, a non-finite component or one of 2^52 or more in size (its
1024-fold fits no long) are dropped; so are rows whose length is not a multiple of `PARTS` or not that of the vector with the smallest vec_id.
A vec_id that repeats gives the codebook one entry, from its smallest vector; a null vec_id gives none, but its row is coded.
Without any entry the result is empty. Fewer ids than `ENTRIES` give a smaller codebook. Repeated rows and ties stay. An error or
a sum that fits no long is null. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import join_spread, shared_path, table, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Groups of partitions that the search for the smallest ids narrows the table down to.
SEED_TASKS = 64
#: Part rows that meet the codebook at once.
BLOCK_ROWS = 16_384
LONG_MAX = (1 << 63) - 1

STATE = "kind string, vec_id long, label string, ints array<long>, codes binary, error long, part int, entry int, sums array<decimal(38,0)>, used long"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as JSON, so that a null label is a key like others), ints: rows whose components are all finite."""
    size = F.col("embedding")
    bad = F.exists(size, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) >= float(1 << 52)), F.lit(True)))
    ints = F.transform(size, lambda x: F.floor(x.cast("double") * SCALE))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.to_json(F.struct("label")).alias("label"), ints.alias("ints"))


def _smallest(ids: DataFrame, entries: int) -> DataFrame:
    """Of each partition the `entries` smallest ids, each with its smallest vector; holds no more than that and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            known = batch.column(0).to_numpy(zero_copy_only=False)
            near = np.flatnonzero(known <= max(held)) if len(held) == entries else np.arange(len(known))
            for key, vector in zip(known[near].tolist(), batch.column(1).take(pa.array(near)).to_pylist(), strict=True):
                held[key] = min(held.get(key, vector), vector)
            held = {k: held[k] for k in sorted(held)[:entries]}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["vec_id", "ints"])

    return ids.mapInArrow(run, "vec_id long, ints array<long>")


def first_vectors(valid: DataFrame, entries: int = ENTRIES) -> list[list[int]]:
    """Vectors of the smallest ids, ascending. `entries` rows a task are shuffled, and at most `SEED_TASKS` x `entries` come out of that."""
    ids = valid.filter("vec_id is not null").select("vec_id", "ints")
    near = _smallest(_smallest(ids, entries).repartition(F.pmod(F.spark_partition_id(), F.lit(SEED_TASKS))), entries)
    rows = near.groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").limit(entries).collect()
    return [r["ints"] for r in rows]


def _numbers(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 where every squared distance and its terms stay under 2^53, as Python integers otherwise."""
    low = min((int(x.min()) for x in (rows, entries) if x.size), default=0)
    high = max((int(x.max()) for x in (rows, entries) if x.size), default=0)
    exact = 4 * rows.shape[1] * max(-low, high, 1) ** 2 < 1 << 53
    kind = np.float64 if exact else object
    return rows.astype(kind), entries.astype(kind)


class Codebook:
    """Entries of one part position, and for each entry all entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        ours, _ = _numbers(entries, entries)
        self.apart = ((ours[:, None, :] - ours[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.apart, self.order, axis=1)

    def assign(self, rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: lower) and squared distance for every row, starting from entry `before`."""
        ours, entries = _numbers(rows, self.entries)
        codes, errors = before.copy(), np.zeros(len(rows), dtype=object if ours.dtype == object else np.int64)
        by_entry = np.argsort(before, kind="stable")
        cuts = np.flatnonzero(np.diff(before[by_entry])) + 1
        for same in np.split(by_entry, cuts) if len(rows) else []:
            start = before[same[0]]
            distance = ((ours[same] - entries[start]) ** 2).sum(axis=1)
            reach = np.searchsorted(self.sorted[start], 4 * distance, side="right")
            # Rows of like reach go together, so that few scan further than they must.
            for block in np.array_split(np.argsort(reach, kind="stable"), -(-len(same) // 256)):
                at, seen = same[block], self.order[start, : max(1, int(reach[block].max()))]
                near, picked = ours[at], entries[seen]
                found = (near**2).sum(axis=1)[:, None] - 2 * (near @ picked.T) + (picked**2).sum(axis=1)[None, :]
                least = found.min(axis=1)
                codes[at] = np.where(found == least[:, None], seen[None, :], len(entries)).min(axis=1)
                errors[at] = least
        return codes, errors


def _cut(ints: pa.Array, parts: int) -> list[np.ndarray]:
    flat = ints.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(flat.reshape(len(ints), -1), parts, axis=1)


def _long(value: int) -> int | None:
    return value if abs(value) <= LONG_MAX else None


def assign_round(state: DataFrame, codebooks: list[np.ndarray], sums: bool) -> DataFrame:
    """Rows of `state` (vec_id, label, ints, codes) with codes and errors by these codebooks; with `sums` also rows of kind "sum", one per task, part and used entry."""
    parts = len(codebooks)
    types = {"vec_id": pa.int64(), "label": pa.string(), "ints": pa.list_(pa.int64()), "codes": pa.binary(), "error": pa.int64()}
    total = {"part": pa.int32(), "entry": pa.int32(), "sums": pa.list_(pa.decimal128(38, 0)), "used": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(c) for c in codebooks]
        added = [np.zeros(c.shape, dtype=object) for c in codebooks]
        used = [np.zeros(len(c), dtype=np.int64) for c in codebooks]
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, parts).astype(np.int64)
                errors = np.zeros(batch.num_rows, dtype=np.int64)
                for p, rows in enumerate(_cut(batch.column(2), parts)):
                    codes[:, p], error = books[p].assign(rows, codes[:, p])
                    errors = errors + error
                    if sums:
                        order = np.argsort(codes[:, p], kind="stable")
                        entries, first, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                        wide = np.abs(rows).max(initial=0) < 1 << 40
                        added[p][entries] += np.add.reduceat(rows[order] if wide else rows[order].astype(object), first, axis=0).astype(object)
                        used[p][entries] += n
                columns = [*batch.columns[:3], pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary()), pa.array([_long(int(e)) for e in errors], pa.int64())]
                none = [pa.nulls(batch.num_rows, t) for t in total.values()]
                yield pa.RecordBatch.from_arrays([pa.array(["row"] * batch.num_rows), *columns, *none], names=["kind", *types, *total])
        if sums:
            found = [(p, int(e), [decimal.Decimal(int(x)) for x in added[p][e]], int(used[p][e])) for p in range(parts) for e in np.flatnonzero(used[p])]
            columns = [pa.array([r[i] for r in found], t) for i, t in enumerate(total.values())]
            yield pa.RecordBatch.from_arrays([pa.array(["sum"] * len(found), pa.string()), *[pa.nulls(len(found), t) for t in types.values()], *columns], names=["kind", *types, *total])

    return state.select("vec_id", "label", "ints", "codes").mapInArrow(run, STATE)


def _written_round(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows and sums of one round, written by one job."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    return found.filter("kind = 'row'"), found.filter("kind = 'sum'")


def moved_entries(codebooks: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Each used entry becomes the floor of its parts' mean. One row an entry comes to the driver."""
    width = codebooks[0].shape[1]
    totals = sums.groupBy("part", "entry").agg(F.sum("used").alias("used"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    moved = [c.copy() for c in codebooks]
    for r in totals.collect():
        moved[r["part"]][r["entry"]] = [int(r[f"s{i}"]) // r["used"] for i in range(width)]
    return moved


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for e in c for x in e).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every valid row; works at once."""
    valid = valid_vectors(vectors)
    first = first_vectors(valid, entries)
    length = len(first[0]) if first and len(first[0]) % parts == 0 else 0
    state = valid.filter(F.size("ints") == (length or -1)).withColumn("codes", F.lit(bytes(parts)))
    codebooks: list[np.ndarray] = []
    if length:
        codebooks = np.split(np.array([v for v in first if len(v) == length], dtype=np.int64), parts, axis=1)
        for k in range(rounds):
            state, sums = _written_round(assign_round(state, codebooks, True), f"codes-{k}")
            codebooks = moved_entries(codebooks, sums)
        last = written(assign_round(state, codebooks, False).select("vec_id", "label", "codes", "error"), "codes-last")
    else:
        last = state.select("vec_id", "label", "codes", F.lit(0).cast("long").alias("error"))
    by_label = last.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_sum(error)")).alias("label_error"))
    return join_spread(last, by_label, "label", "codes").select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int) -> str:
    """Nearest entries by the codebooks of round k, and the codebooks they give."""
    return f"""
assigned{k} AS MATERIALIZED (
  SELECT rid, p, min(d * {ENTRIES} + e) % {ENTRIES} AS e, min(d * {ENTRIES} + e) // {ENTRIES} AS d
  FROM (SELECT a.rid, a.p, b.e, sum((a.x - b.x) * (a.x - b.x))::HUGEINT AS d FROM cells a JOIN book{k} b ON a.p = b.p AND a.i = b.i GROUP BY ALL)
  GROUP BY rid, p),
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x
  FROM book{k} b LEFT JOIN (SELECT a.p, a.e, c.i, sum(c.x)::HUGEINT AS s, count(*) AS n FROM assigned{k} a JOIN cells c ON a.rid = c.rid AND a.p = c.p GROUP BY ALL) m
    ON m.p = b.p AND m.e = b.e AND m.i = b.i)"""


ORACLE = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT rid, j // (n // {PARTS}) AS p, j % (n // {PARTS}) AS i, x
  FROM (SELECT rid, len(ints) AS n, unnest(range(len(ints))) AS j, unnest(ints) AS x FROM kept)),
seeds AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
book0 AS MATERIALIZED (SELECT c.p, s.e, c.i, c.x FROM seeds s JOIN cells c ON c.rid = s.rid),
{",".join(_round_sql(k) for k in range(ROUNDS + 1))},
coded AS (SELECT rid, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM assigned{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""
