"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one sends one number a document through a shuffle, its slot in a Bloom filter, combined on the map side; slots that were hit
twice or more become a bitmap whose size follows the number of rows up to a fixed bound (`FILTER_BITS` / 8 bytes), so it may be broadcast.
Pass two tests each row against the bitmap: a row whose slot was hit once has no equal and passes straight through; only
possibly repeated rows are shuffled with their SHA-256 (and, where texts are kept, their texts) and compared.

One slot a row, because a second one would cost every document another shuffled number, and saves under one in `BITS_A_ROW` documents a digest.
Bitmaps made by each task would ship the whole filter from each task: more than a number a document as soon as there are a few tasks.
A Bloom filter has no false negatives, so the result is exact at any load. Where there are more rows than bits, the filter would tell
next to nothing: it is not built, and each document's digest and id take the one shuffle of a plain group-by. A group of copies is combined
before the shuffle and meets its rows again spread over many tasks.

Defined results: a null text counts as the empty text; equal means identical after
lower-casing A-Z; a null doc_id loses to any other, and a group of only null ids has keep_id
null and keeps its rows; rows that repeat both doc_id and text are the same row twice: the
annotated form marks both kept, `drop_duplicates` leaves one. Empty tables give empty results.
Extra columns stay; helper columns are built under names that no input column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import ascii_lower, checkpointed, join_spread, quoted, table, unused

#: Bits of the broadcast filter: 16 MiB at most, whatever the input.
FILTER_BITS = 1 << 27
BITS_A_ROW = 32
#: Bits in one bitmap row, as bitmap_construct_agg lays them out.
CHUNK_BITS = 32768


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _slot(h: Column, bits: int) -> Column:
    """Slot number, 1-based as bitmap_bucket_number wants it."""
    return F.pmod(h, F.lit(bits)) + 1


def filter_bits(rows: int) -> int:
    """`BITS_A_ROW` bits a row and more, in whole bitmap rows, up to FILTER_BITS: under one in `BITS_A_ROW` unique rows takes the second shuffle."""
    return min(FILTER_BITS, max(CHUNK_BITS, 1 << max(0, BITS_A_ROW * rows - 1).bit_length()))


def repeat_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """Bitmap rows (chunk, bitmap) of the slots that more than one row hit."""
    slot = F.col("slot")
    return (
        hashes.select(_slot(F.col(column), bits).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("hits"))
        .filter("hits > 1")
        .groupBy(F.bitmap_bucket_number(slot).alias("chunk"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
    )


def _bit(bitmap: Column, slot: Column) -> Column:
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def flag_possible_repeats(df: DataFrame, hashed: Column, chunks: DataFrame, flag: str, bits: int) -> DataFrame:
    """Add boolean `flag`: false means that no other row has this hash. `chunks`: repeat_filter of the same hashes."""
    chunk, bitmap, columns = unused(df, "chunk"), unused(df, "bitmap"), df.columns
    slot = _slot(hashed, bits)
    part = chunks.select(F.col("chunk").alias(chunk), F.col("bitmap").alias(bitmap))
    out = df.join(F.broadcast(part), F.bitmap_bucket_number(slot) == F.col(chunk), "left")
    return out.select(*map(quoted, columns), _bit(F.col(bitmap), slot).alias(flag))


def annotate_duplicates(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents."""
    digests = checkpointed(
        docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")).withColumn(
            "h", F.xxhash64("text_sha256")
        )
    )
    rows = digests.count()
    bits, told = bits or filter_bits(rows), bits or rows <= FILTER_BITS
    flagged = flag_possible_repeats(digests, F.col("h"), repeat_filter(digests, "h", bits), "maybe", bits) if told else digests.withColumn("maybe", F.lit(True))
    alone = flagged.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = flagged.filter("maybe").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    compared = join_spread(maybe, groups, "text_sha256", "doc_id").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(compared)


def drop_duplicates(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """`docs` with one row for each distinct text: of equal texts the row with the largest doc_id.

    Ties on doc_id go to the row whose other columns, as JSON, have the largest SHA-256. Unique rows are not
    shuffled; of the others each task sends one row a group.
    """
    rows = docs.count()
    bits, told = bits or filter_bits(rows), bits or rows <= FILTER_BITS
    h, flag, digest = (unused(docs, n) for n in ("h", "maybe", "digest"))
    sha = F.sha2(normalised(F.col("text")), 256)
    if told:
        chunks = checkpointed(repeat_filter(docs.select(F.xxhash64(sha).alias("h")), "h", bits))
        out = flag_possible_repeats(docs.withColumn(h, F.xxhash64(sha)), F.col(h), chunks, flag, bits)
    else:
        out = docs.withColumn(flag, F.lit(True))
    # Fields by number: names of columns may hold any sign, and types any that has no order.
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rest = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "doc_id"])
    largest = (
        out.filter(F.col(flag))
        .select(sha.alias(digest), row.alias("row"), F.struct("doc_id", F.sha2(F.to_json(rest), 256)).alias("place"))
        .groupBy(digest)
        .agg(F.max_by("row", "place").alias("row"))
        .select(*[F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    )
    return out.filter(~F.col(flag)).select(*map(quoted, docs.columns)).unionByName(largest)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate_duplicates(table(spark, sf_dir, "documents"))


ORACLE = f"""
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents)
"""
