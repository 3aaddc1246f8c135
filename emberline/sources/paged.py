"""Pages of a range API as a data source: files `slice=<epoch second>/page=<number>/*.json` of JSON lines.

A slice is a span of time of fixed length, and a page a bounded part of its records in time order, as a paging API returns them;
`write_pages` lays a DataFrame out so. Where a slice has many pages, a file holds several: `slice=<epoch second>/pages=<first>-<count>-<rows>/*.json`
has the lines of `count` pages one after the other, `rows` a page (the last may have fewer), so that files are as many as there are blocks of records
and no page is opened to be counted. `paged_ranges` reads them with a task a slice, or several where it has many pages:

* comparisons with `ts` are pushed to the source: slices outside the range are not listed as tasks, and rows are tested as pages are read;
* `max_pages` bounds the pages read of each slice; a page that is not read, or can't be parsed, makes its slice `partial` and is
  counted in `status=true`, which gives one row a slice (slice, pages, pages_read, rows_read, partial) in place of records;
* as a stream, an offset is the number of pages of each slice; a batch is the pages that came since. A broken page is skipped there too.

Files are read through pyarrow's file systems (local, HDFS, object stores). Timestamps are stored as microseconds. Records missing
a field have null there. An empty or absent folder has no rows.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, TimestampType

from emberline.storage import find_package, unused

TIME = "ts"
STATUS = "slice long, pages int, pages_read int, rows_read long, partial boolean"
_PLACE = re.compile(r"slice=(-?\d+)/(?:page=(\d+)|pages=(\d+)-(\d+)-(\d+))/[^/]+\.json$")
#: Rows that are turned into one Arrow batch.
BATCH_ROWS = 10_000
#: Pages of a slice that are read by one task, or those of one file.
TASK_PAGES = 500


def write_pages(df: DataFrame, path: str, seconds: int, page_rows: int, order: str = "ordinal", file_pages: int = 1) -> str:
    """Lay rows with a `ts` out as pages of `page_rows` rows in slices of `seconds` seconds, `file_pages` pages a file; returns `path`."""
    place, size = unused(df, "place"), unused(df, "size")
    first = F.floor(F.unix_seconds(TIME) / seconds) * seconds
    by_slice = Window.partitionBy("slice")
    rows = df.withColumn("slice", first).withColumn(place, F.row_number().over(by_slice.orderBy(TIME, order)) - 1)
    if file_pages == 1:
        paged = rows.withColumn("page", F.floor(F.col(place) / page_rows).cast("int")).withColumn(TIME, F.unix_micros(TIME)).drop(place)
        paged.repartition("slice", "page").sortWithinPartitions("slice", "page", TIME, order).write.partitionBy("slice", "page").json(path)
        return path
    begin = F.floor(F.col(place) / (page_rows * file_pages)) * file_pages
    count = F.least(F.lit(file_pages), F.ceil(F.col(size) / page_rows) - begin)
    rows = rows.withColumn(size, F.count(F.lit(1)).over(by_slice)).withColumn("pages", F.concat_ws("-", begin, count, F.lit(page_rows)))
    paged = rows.withColumn(TIME, F.unix_micros(TIME)).drop(place, size)
    paged.sortWithinPartitions("slice", "pages", TIME, order).write.partitionBy("slice", "pages").json(path)
    return path


def _micros(value: datetime) -> int:
    value = value if value.tzinfo else value.replace(tzinfo=UTC)
    whole = value.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (whole.days * 86_400 + whole.seconds) * 1_000_000 + whole.microseconds


@dataclass(frozen=True, order=True)
class Block:
    """Pages of a slice that lie together: the first one's number, how many, and rows a page (0: one page, however many rows)."""

    first: int
    count: int
    rows: int


@dataclass
class SlicePages(InputPartition):
    """Files of blocks of one slice, in order; `before`: its pages in blocks before these."""

    slice: int
    blocks: list[tuple[Block, list[str]]]
    before: int = 0


def _listed(path: str) -> dict[int, dict[Block, list[str]]]:
    """Files by slice and block."""
    fs, root = pafs.FileSystem.from_uri(path)
    found: dict[int, dict[Block, list[str]]] = {}
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if m := _PLACE.search(info.path):
            block = Block(int(m[2]), 1, 0) if m[2] else Block(int(m[3]), int(m[4]), int(m[5]))
            found.setdefault(int(m[1]), {}).setdefault(block, []).append(info.path)
    return found


def _records(lines: Sequence[bytes]) -> list[dict] | None:
    """Records of a page's lines; None where they aren't JSON objects."""
    try:
        rows = [json.loads(line.decode("utf-8")) for line in lines if line.strip()]
    except ValueError:
        return None
    return rows if all(isinstance(r, dict) for r in rows) else None


def _lines(fs: pafs.FileSystem, files: Sequence[str]) -> Iterator[bytes]:
    for name in sorted(files):
        with fs.open_input_stream(name, buffer_size=1 << 20) as stream, io.BufferedReader(stream) as lines:
            yield from lines


def _pages_of(fs: pafs.FileSystem, block: Block, files: Sequence[str], wanted: int) -> Iterator[list[dict] | None]:
    """Records of each of a block's first `wanted` pages; None for one that can't be read as JSON lines."""
    lines = _lines(fs, files)
    for done in range(min(wanted, block.count)):
        try:
            page = list(islice(lines, block.rows or None))
        except OSError:  # nor can what comes after it
            yield from [None] * (min(wanted, block.count) - done)
            return
        yield _records(page) if page or not block.rows else None


class _Range:
    """Bounds of `ts` in microseconds, both inclusive."""

    def __init__(self) -> None:
        self.low, self.high = -(1 << 63), (1 << 63) - 1

    def add(self, f: Filter) -> bool:
        """Narrow by a filter; false if it is none on `ts`."""
        if getattr(f, "attribute", None) != (TIME,) or not isinstance(getattr(f, "value", None), datetime):
            return False
        at = _micros(f.value)
        match f:
            case GreaterThan():
                self.low = max(self.low, at + 1)
            case GreaterThanOrEqual():
                self.low = max(self.low, at)
            case LessThan():
                self.high = min(self.high, at - 1)
            case LessThanOrEqual():
                self.high = min(self.high, at)
            case _:
                return False
        return True


class _Pages:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.seconds = int(options.get("seconds", "86400"))
        self.max_pages = int(options.get("max_pages", "0"))
        self.status = options.get("status", "false").lower() == "true"
        self.range = _Range()

    def _batches(self, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        times = {f.name for f in self.schema if isinstance(f.dataType, TimestampType)}
        for at in range(0, len(rows), BATCH_ROWS):
            part = rows[at : at + BATCH_ROWS]
            columns = [pa.array([r.get(f.name) for r in part], pa.int64()).cast(f.type) if f.name in times else pa.array([r.get(f.name) for r in part], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    def _wanted(self, rows: list[dict]) -> list[dict]:
        """Rows in the range; a row without a time is in the range of all times only."""
        every = self.range.low == -(1 << 63) and self.range.high == (1 << 63) - 1
        return [r for r in rows if (every if r.get(TIME) is None else self.range.low <= r[TIME] <= self.range.high)]

    def read(self, partition: SlicePages | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark reads where there is no partition
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        here = sum(block.count for block, _ in partition.blocks)
        left = max(0, self.max_pages - partition.before) if self.max_pages else here
        done = seen = 0
        for block, files in partition.blocks:
            if left <= 0:
                break
            for rows in _pages_of(fs, block, files, left):
                left -= 1
                if rows is None:
                    continue
                rows = self._wanted(rows)
                done, seen = done + 1, seen + len(rows)
                if not self.status:
                    yield from self._batches(rows)
        if self.status:
            row = {"slice": partition.slice, "pages": here, "pages_read": done, "rows_read": seen, "partial": done < here}
            yield from self._batches([row])

    def _tasks(self, at: int, blocks: dict[Block, list[str]]) -> Iterator[SlicePages]:
        """A slice's blocks by tasks: all in one where there is one row a slice."""
        held, here, before = [], 0, 0
        for block, files in sorted(blocks.items()):
            if held and not self.status and here + block.count > TASK_PAGES:
                yield SlicePages(at, held, before)
                held, here, before = [], 0, before + here
            held.append((block, files))
            here += block.count
        yield SlicePages(at, held, before)


class RangeReader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.status or not self.range.add(f):
                yield f

    def partitions(self) -> list[SlicePages]:
        low, high = self.range.low // 1_000_000 - self.seconds, self.range.high // 1_000_000
        return [task for at, blocks in sorted(_listed(self.path).items()) if low < at <= high for task in self._tasks(at, blocks)]


class PageStream(_Pages, DataSourceStreamReader):
    """Pages of each slice in the order of their numbers, each once."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {str(at): max(b.first + b.count for b in blocks) for at, blocks in _listed(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[SlicePages]:
        listed = _listed(self.path)
        found = []
        for at, last in end.items():
            blocks = {b: files for b, files in listed.get(int(at), {}).items() if start.get(at, 0) <= b.first < last}
            if blocks:
                found.extend(self._tasks(int(at), blocks))
        return found

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class PagedRanges(DataSource):
    """Options: path; seconds (length of a slice, 86400); max_pages (of a slice; 0: all); status (rows a slice instead of records)."""

    @classmethod
    def name(cls) -> str:
        return "paged_ranges"

    def schema(self) -> str:
        if self.options.get("status", "false").lower() == "true":
            return STATUS
        raise ValueError("name the fields of the pages with .schema(...)")

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    find_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedRanges)


def read_pages(spark: SparkSession, path: str, schema: str, seconds: int, max_pages: int = 0) -> DataFrame:
    register(spark)
    return spark.read.format("paged_ranges").schema(schema).options(path=path, seconds=seconds, max_pages=max_pages).load()


def read_status(spark: SparkSession, path: str, seconds: int, max_pages: int = 0) -> DataFrame:
    register(spark)
    return spark.read.format("paged_ranges").options(path=path, seconds=seconds, max_pages=max_pages, status="true").load()
