"""Media columns: payloads stored as lossless WebP images, read back to pixel arrays, with features of the pixels."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import text_bytes
from quire.llm.webp import MAX_SIDE, decode, encode_stored

UNIT = 576
PIXELS = UNIT // 4
TAIL = 32


def padded(payload: bytes) -> bytes:
    """The payload with bytes 255 up to a positive multiple of UNIT."""
    return payload + b"\xff" * (UNIT - len(payload) if not payload else -len(payload) % UNIT)


def store(payload: bytes) -> bytes:
    """A padded payload as images 144 pixels wide, one row for each unit; payloads beyond 16,384 rows take several files."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PIXELS, 4)
    return b"".join(encode_stored(rows[i : i + MAX_SIDE]) for i in range(0, len(rows), MAX_SIDE))


def load(media: bytes) -> np.ndarray:
    """The pixels of all files in a stored form, one below the other."""
    images, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        images.append(decode(media[at : at + size]))
        at += size
    return images[0] if len(images) == 1 else np.concatenate(images)


def feature(x: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, mean difference of rows and of columns in thousandths, and share of each eighth of the byte range."""
    n = x.shape[0] * x.shape[1]
    means = x.reshape(-1, 4).sum(axis=0, dtype=np.int64) * 1000 // n
    wide = x.astype(np.int16)
    across = int(np.abs(np.diff(wide, axis=1)).sum(dtype=np.int64)) * 1000 // max(1, x.shape[0] * (x.shape[1] - 1) * 4)
    down = int(np.abs(np.diff(wide, axis=0)).sum(dtype=np.int64)) * 1000 // max(1, (x.shape[0] - 1) * x.shape[1] * 4)
    shares = np.bincount(x.reshape(-1) >> 5, minlength=8) * 1000 // (4 * n)
    return f"{x.shape[1]}x{x.shape[0]};mean={','.join(map(str, means))};dx={across};dy={down};hist={','.join(map(str, shares))}"


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for each row.

    All but n_bytes come from the stored bytes read back. A null text counts as empty (one unit of padding). Equal texts
    give equal values; repeated rows give repeated results; other columns are not read; an empty table gives an empty
    result. Narrow map, one text at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                raw = data[off[i] : off[i + 1]].tobytes()
                media = store(padded(raw))
                x = load(media)
                back = x.tobytes()
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(x)))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
