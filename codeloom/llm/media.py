"""Media columns: PNG images in binary columns, read back with checksum tests, and cosine-transform hashes.

Payloads become 8-bit grey images of 64 samples a row. A damaged file raises ValueError.

Cases: a null text is an empty one; an empty payload still has one row of 64 bytes 0; very long texts make tall
images, cut into many zlib chunks; a null id stays null; repeated rows give repeated results; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, utf8

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK_BYTES = 1 << 16
LEVEL = 4
#: Side of the reduced image and of the block of low frequencies.
SIDE, LOW = 32, 8


def pad(raw: bytes, unit: int = WIDTH) -> bytes:
    """``raw`` with bytes 0 after it, up to a positive multiple of ``unit``."""
    return raw + bytes(-len(raw) % unit if raw else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: np.ndarray, row_filter: int = 0) -> bytes:
    """A grey 8-bit PNG. Filter 0 keeps rows as they are, which suits text; 2 predicts from the row above, which suits pictures."""
    h, w = samples.shape
    rows = np.empty((h, w + 1), np.uint8)
    rows[:, 0] = row_filter
    rows[:, 1:] = samples
    if row_filter == 2:
        np.subtract(samples[1:], samples[:-1], out=rows[1:, 1:])
    elif row_filter:
        raise ValueError("only the filters 0 and 2 are written")
    packed = zlib.compress(rows.tobytes(), LEVEL)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", packed[i : i + CHUNK_BYTES]) for i in range(0, len(packed), CHUNK_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("a chunk is cut short")
        (n,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(body) < n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("the end chunk is missing")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the five row filters of 8-bit grey images. Runs of rows with one filter go through numpy together."""
    h, w = rows.shape
    out = np.zeros((h + 1, w), np.uint8)  # row 0 stands above the image
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, h]):
        part, kind = rows[a:b], kinds[a]
        if kind == 0:
            out[a + 1 : b + 1] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[a + 1 : b + 1])
        elif kind == 2:
            np.cumsum(np.vstack([out[a : a + 1], part]), axis=0, dtype=np.uint8, out=out[a : b + 1])
        elif kind in (3, 4):
            for y in range(a, b):
                left = corner = 0
                above, line = out[y].tolist(), rows[y].tolist()
                for x, up in enumerate(above):
                    if kind == 3:
                        guess = (left + up) >> 1
                    else:
                        near = left + up - corner
                        guess = min((left, up, corner), key=lambda v: abs(near - v))
                    line[x] = left = (line[x] + guess) & 255
                    corner = up
                out[y + 1] = line
        else:
            raise ValueError(f"unknown row filter {kind}")
    return out[1:]


def decode_png(png: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG without interlacing."""
    head, data = None, []
    for kind, body in _chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only grey 8-bit images without interlacing are read")
    w, h = head[:2]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != h * (w + 1):
        raise ValueError("the image has other rows than its header says")
    rows = np.frombuffer(raw, np.uint8).reshape(h, w + 1)
    return _unfilter(rows[:, 0], rows[:, 1:])


@lru_cache(maxsize=4)
def _cosines(n: int, k: int) -> np.ndarray:
    x = np.arange(n)
    return np.cos(np.pi * (2 * x[None, :] + 1) * np.arange(k)[:, None] / (2 * n))


def _shrink(a: np.ndarray, n: int) -> np.ndarray:
    """Means of n equal spans of the first axis; a short axis repeats its rows."""
    size = len(a)
    start = np.arange(n) * size // n
    stop = np.maximum(start + 1, (np.arange(n) + 1) * size // n)
    sums = np.vstack([np.zeros((1, a.shape[1])), np.cumsum(a, axis=0, dtype=np.float64)])
    return (sums[stop] - sums[start]) / (stop - start)[:, None]


def frequency_hash(samples: np.ndarray) -> str:
    """64 bits as hex: which low frequencies of the reduced image lie over their median."""
    small = _shrink(_shrink(samples, SIDE).T, SIDE).T
    c = _cosines(SIDE, LOW)
    low = (c @ small @ c.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the payload's PNG in the binary column ``media``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            raws = utf8(b.column("text").to_pylist())
            images = [encode_png(np.frombuffer(pad(r), np.uint8).reshape(-1, WIDTH)) for r in raws]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "n_bytes": pa.array([len(r) for r in raws], pa.int64()),
                "media": pa.array(images, pa.binary())})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(write, "id long, n_bytes long, media binary")


def media_features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the stored images back and describe payload and picture."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            rows = []
            for png in b.column("media").to_pylist():
                samples = decode_png(png)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png),
                    hashlib.sha256(png).hexdigest(), frequency_hash(samples)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "n_bytes": b.column("n_bytes"), "payload_bytes": pa.array(cols[0], pa.int64()),
                    "payload_sha256": pa.array(cols[1], pa.string()), "tail_crc32": pa.array(cols[2], pa.int64()),
                "media_bytes": pa.array(cols[3], pa.int64()), "media_sha256": pa.array(cols[4], pa.string()), "feature": pa.array(cols[5], pa.string()),
            })

    return stored.mapInArrow(read, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image in a written table, then read the table."""
    return media_features(cut(store_media(df, id_col, text_col), "media"), id_col)
