"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: 64 bits over the XXH64 (seed 42) of word shingles; a bit is 1 if set in over half of them.
Fingerprints link at `RADIUS` or fewer differing bits.

Links are found by ball hashing. Of the three bands of about 21 bits, two fingerprints within 4 bits
differ in one band by 2 or more bits, or in none by more than 1; leaving out the band with the most
differences leaves at most 2. So each distinct fingerprint is looked at three times, once without
each band, and in each view emits every variant within half of what is left, that is 1 bit: 131
variants. (One view of all 64 bits with variants within 2 bits, `bands=1`, is the plain form: 2,081
variants and no false candidates. Both give the same links; README has the figures.) The shuffle is on
variants of distinct fingerprints, so copies cost nothing. In a bucket all colliding pairs are
verified by a breadth-first walk that compares one fingerprint with all not yet reached at once and
emits a spanning forest, not all pairs: n-1 links for n fingerprints, at a cost of n times the number of
link groups. Forests make the same components as all links.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of fewer words
than a shingle hash their whole word sequence; repeated rows and null doc_ids keep their rows (a null id
is never smallest); empty tables give empty results; extra columns are ignored by the query and kept by
`keep_representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import checkpointed, find_package, join_spread, table, unused
from emberline.llm.components import connected_components

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Shingles hashed at once, so that a very long text needs bounded memory.
BLOCK = 1 << 16
#: Ids of dropped documents up to which they are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and the white space of the word rule.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    count = len(found) - words + 1
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, count, BLOCK):
        part = found[at : min(at + BLOCK, count) + words - 1]
        shingles = zip(*(part[k:] for k in range(words)), strict=False)
        packed = b"".join([digest(join(s), SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(packed, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (signed bigint) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def views(bands: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(mask, variant radius) of each view: without one of `bands` bands, or of all bits if bands is 1."""
    if bands == 1:
        return [((1 << 64) - 1, (radius + 1) // 2)]
    edges = [64 * k // bands for k in range(bands + 1)]
    left = radius - -(-radius // bands)  # the band left out has at least its share of the differences
    return [(((1 << 64) - 1) ^ (((1 << hi) - 1) ^ ((1 << lo) - 1)), (left + 1) // 2) for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball(mask: int, radius: int) -> list[int]:
    """All flips of up to `radius` bits inside `mask`."""
    bits = [1 << k for k in range(64) if mask >> k & 1]
    found = level = [(0, -1)]
    for _ in range(radius):
        level = [(x | bits[k], k) for x, last in level for k in range(last + 1, len(bits))]
        found = found + level
    return [x for x, _ in found]


def _forest(members: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning forest of the links among distinct fingerprints (uint64)."""
    left, right = [], []
    waiting = members
    while len(waiting) > 1:
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            at = frontier.pop()
            near = np.bitwise_count(waiting ^ at) <= radius
            if near.any():
                new = waiting[near]
                left.append(np.full(len(new), at, dtype=np.uint64))
                right.append(new)
                frontier.extend(new)
                waiting = waiting[~near]
    return left, right


def links(distinct: DataFrame, radius: int = RADIUS, bands: int = 3) -> DataFrame:
    """Spanning links (u, v) between the distinct fingerprints in column fp."""
    looks = views(bands, radius)
    flips = F.array(*[
        F.struct(F.lit(i).cast("byte").alias("view"), F.lit(_signed(mask)).alias("mask"), F.lit(_signed(x)).alias("flip"))
        for i, (mask, r) in enumerate(looks) for x in ball(mask, r)
    ])
    masks = np.array([m for m, _ in looks], dtype=np.uint64)
    # Dealt out first: few small partitions of fingerprints would make all variants.
    dealt = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    variants = dealt.select("fp", F.explode(flips).alias("f")).select(
        F.col("f.view").alias("view"), F.col("fp").bitwiseAND(F.col("f.mask")).bitwiseXOR(F.col("f.flip")).alias("key"), "fp"
    )

    def pairs(view: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        """Links in sorted whole buckets."""
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (view[1:] != view[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        left, right = [], []
        two = starts[sizes == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        left.append(fp[two][near])
        right.append(fp[two + 1][near])
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            members = fp[at : at + n]
            own = members & masks[view[at]]
            # Fingerprints alike in this view meet in the bucket of that view itself; here they would only meet again.
            if own[0] != key[at] and (own == own[0]).all():
                continue
            a, b = _forest(members, radius)
            left += a
            right += b
        u, v = np.concatenate(left), np.concatenate(right)
        if not len(u):
            return None
        # Order as signed numbers, as Spark compares them; each link once in this block of buckets.
        both = np.sort(np.stack([u.view(np.int64), v.view(np.int64)]), axis=0)
        both = np.unique(both, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[1]), pa.array(both[0])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def block(last: bool) -> pa.RecordBatch | None:
            nonlocal held, rows
            view, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(key)
            if not last:  # the last bucket may go on in the next batch
                cut = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (view[1:] != view[:-1])])[-1])
            held, rows = [(view[cut:], key[cut:], fp[cut:])], len(key) - cut
            return pairs(view[:cut], key[:cut], fp[:cut]) if cut else None

        for batch in batches:
            view, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append((view, key.view(np.uint64), fp.view(np.uint64)))
            rows += len(batch)
            if rows >= 100_000 and (out := block(False)) is not None:
                yield out
        if rows and (out := block(True)) is not None:
            yield out

    return (
        variants.repartition("view", "key").sortWithinPartitions("view", "key", "fp").mapInArrow(run, "u long, v long").distinct()
    )


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS, bands: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that chains of links reach) for every row."""
    prints = checkpointed(fingerprints(docs, words))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(links(distinct.select("fp"), radius, bands))
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_print = join_spread(member, least, "component", "fp").select("fp", "component_id")
    return join_spread(prints, of_print, "fp", "doc_id").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each near-duplicate group: the smallest doc_id.

    Rows with a null doc_id stay; rows that repeat the kept doc_id stay with it.
    """
    find_package(docs.sparkSession)
    gone = unused(docs, "gone")
    dropped = checkpointed(near_duplicate_groups(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct())
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
