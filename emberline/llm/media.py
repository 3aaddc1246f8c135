"""Texts as PNG media columns, and low-frequency cosine-transform hashes of what is read back.

A text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, become the 8-bit grey samples of an
image 64 wide. Writing picks for each line the filter none, sub or up with the least sum of absolute
differences, deflates the lines and splits the stream into IDAT chunks of at most `CHUNK` bytes, each with
its CRC-32. Reading tests the signature and every chunk's checksum, inflates, and undoes all five filters
in numpy (lines of sub at once, runs of up by cumulative sums, average and Paeth line by line). The hash:
block means on 32 x 32, a cosine transform, the 8 x 8 lowest frequencies against their median: 64 bits.
The query writes the media column to the shared folder and computes all features from the stored bytes.

Defined results: null counts as empty: one line of 64 zero bytes; a surrogate that UTF-8 can't hold is
written as "?"; texts are never cut; equal texts give equal bytes; repeated rows and null ids stay; an
empty table gives an empty result; extra columns are ignored. Media that fail a test raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberline.llm.common import table, written

WIDTH = 64
CHUNK = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1
GRID, LOW = 32, 8
#: Texts' bytes that go into one output batch.
BATCH_BYTES = 16_000_000


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: bytes, width: int = WIDTH) -> bytes:
    """Grey 8-bit PNG of whole lines."""
    lines = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    sub, up = lines.copy(), lines.copy()
    sub[:, 1:] -= lines[:, :-1]
    up[1:] -= lines[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (lines, sub, up)])
    best = cost.argmin(axis=0)
    out = np.empty((len(lines), width + 1), dtype=np.uint8)
    out[:, 0] = best
    out[:, 1:] = np.where(best[:, None] == 0, lines, np.where(best[:, None] == 1, sub, up))
    stream = zlib.compress(out.tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    data = [_chunk(b"IDAT", stream[i : i + CHUNK]) for i in range(0, len(stream), CHUNK)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", head), *data, _chunk(b"IEND", b"")])


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of each chunk, checksums tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("PNG chunk is cut off")
        size = struct.unpack_from(">I", media, at)[0]
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if at + 12 + size > len(media) or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"PNG chunk {kind!r} fails its checksum")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("PNG has no end")


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of filtered 8-bit grey lines."""
    out = lines.copy()
    own = kinds == 1
    out[own] = np.cumsum(lines[own], axis=1, dtype=np.uint8)
    above = np.flatnonzero(kinds >= 2)
    # Runs of neighbouring lines that lean on the line above.
    for run in np.split(above, np.flatnonzero((np.diff(above) != 1) | (np.diff(kinds[above]) != 0)) + 1) if len(above) else ():
        first, kind = run[0], kinds[run[0]]
        before = out[first - 1] if first else np.zeros(lines.shape[1], dtype=np.uint8)
        if kind == 2:
            out[run] = np.cumsum(np.vstack([before, lines[run]]), axis=0, dtype=np.uint8)[1:]
            continue
        for y in run:
            up, row, left, corner = before.astype(np.int64), lines[y], 0, 0
            for x in range(len(row)):
                b = int(up[x])
                if kind == 3:
                    guess = (left + b) // 2
                elif kind == 4:
                    near = [(abs(b - corner), left), (abs(left - corner), b), (abs(left + b - 2 * corner), corner)]
                    guess = min(near, key=lambda p: p[0])[1]
                else:
                    raise ValueError(f"PNG filter {kind} is unknown")
                left, corner = (int(row[x]) + guess) & 255, b
                out[y, x] = left
            before = out[y]
    return out


def read_png(media: bytes) -> np.ndarray:
    """Lines of samples of a grey 8-bit PNG that is not interlaced."""
    head, stream = None, []
    for kind, data in chunks(media):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            stream.append(data)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a grey 8-bit PNG without interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(stream)), dtype=np.uint8).reshape(head[1], head[0] + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


def _cosines(n: int = GRID, low: int = LOW) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_COSINES = _cosines()


def image_hash(lines: np.ndarray) -> str:
    """64 bits as 16 hex digits: which of the lowest 8 x 8 cosine coefficients lie over their median."""
    tall, wide = lines.shape

    def edges(n: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(GRID) * n // GRID
        return a, np.maximum((np.arange(GRID) + 1) * n // GRID, a + 1)

    (top, bottom), (left, right) = edges(tall), edges(wide)
    sums = np.zeros((tall + 1, wide))
    np.cumsum(lines, axis=0, out=sums[1:])
    rows = (sums[bottom] - sums[top]) / (bottom - top)[:, None]
    sums = np.zeros((GRID, wide + 1))
    np.cumsum(rows, axis=1, out=sums[:, 1:])
    small = (sums[:, right] - sums[:, left]) / (right - left)
    low = (_COSINES @ small @ _COSINES.T).ravel().round(6)
    return np.packbits(low > np.median(low)).tobytes().hex()


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (PNG bytes) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, sizes, media = 0, 0, [], []
            for i, text in enumerate(batch.column(1)):
                n, samples = payload(text.as_py())
                sizes.append(n)
                media.append(write_png(samples))
                held += len(media[-1])
                if held >= BATCH_BYTES or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(media)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    start, held, sizes, media = i + 1, 0, [], []

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """What reading a media column back gives, for every row of doc_id, n_bytes, media."""
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                media = x.as_buffer().to_pybytes()
                lines = read_png(media)
                back = lines.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), image_hash(lines)))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], names=["doc_id", "n_bytes", *kinds])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(written(media_columns(table(spark, sf_dir, "documents")), "media", "uncompressed"))
