"""Media columns: payloads stored as lossless WebP images, read back, and described by features of their pixels.

A payload is the text's UTF-8 followed by bytes 255 up to a positive multiple of `unit`; it becomes a grey image of rows of `unit`
pixels. The format allows 16,384 rows, so longer payloads are a sequence of such files, one after the other.

Null and empty texts are one unit of padding. Equal texts give equal files and features, repeated rows all stay, an empty table
gives no rows; nothing is truncated. Added columns replace input columns of their names, all others pass through.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, of_row, row_of
from .webp import decode, encode_grey

UNIT = 576
MOST_ROWS = 16_384


def to_payload(text: bytes, unit: int = UNIT) -> bytes:
    return text + b"\xff" * (-len(text) % unit if text else unit)


def to_media(payload: bytes, unit: int = UNIT) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, unit)
    return b"".join(encode_grey(rows[i : i + MOST_ROWS]) for i in range(0, len(rows), MOST_ROWS))


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixels of each file in the sequence."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield decode(media[at : at + size])
        at += size


def pixels_of(media: bytes) -> np.ndarray:
    """Grey pixels (rows x width); the other channels must agree."""
    parts = []
    for argb in images(media):
        grey = (argb & np.uint32(255)).astype(np.uint8)
        if not np.array_equal(argb, grey.astype(np.uint32) * np.uint32(0x10101) | np.uint32(0xFF000000)):
            raise ValueError("not a grey image")
        parts.append(grey)
    return np.concatenate(parts)


def describe(pixels: np.ndarray) -> str:
    """Size, mean in hundredths, number of values, and the share of each sixteenth of the range in thousandths."""
    flat = pixels.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    total = int(counts @ np.arange(256))
    shares = (counts.reshape(16, 16).sum(1) * 1000 // len(flat)).tolist()
    return f"{pixels.shape[1]}x{pixels.shape[0]};mean={total * 100 // len(flat)};values={np.count_nonzero(counts)};hist={'.'.join(map(str, shares))}"


def store_media(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes and media, the stored form of the text's payload."""
    added = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def work(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([to_media(to_payload(t)) for t in texts], pa.binary())]

    return map_text(docs, text_col, added, work, keep)


READ = T.StructType([T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))])


def read_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """The rows without the media column, with digests of the payload that was read back from it and features of its pixels."""
    kept = [c for c in stored.columns if c != media_col and c.lower() not in READ.names]
    rows = stored.select(row_of(kept).alias("row"), F.col(f"`{media_col}`").alias("media"))
    schema = T.StructType([rows.schema["row"], *READ.fields])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for media in batch.column(1):
                raw = media.as_py()
                pixels = pixels_of(raw)
                payload = pixels.tobytes()
                found.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), sha256(raw).hexdigest(), describe(pixels)))
            made = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], schema.names)

    return rows.mapInArrow(run, schema).select(*of_row(kept), *READ.names)
