"""Shared helpers of the training-data operators: shared-folder tables, Arrow text access, word hashing."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.plans.shared import shared_dir

#: Bytes of text that one numpy step works on at a time (a longer single text is one step).
PIECE_BYTES = 1 << 20

#: Threshold and shingle width that near-duplicate stages use unless told otherwise.
SHINGLE_WORDS = 5
JACCARD = (75, 100)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- tables in the folder that all executors share -------------------------------------------------


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor rereads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, hashes: bool = False) -> DataFrame:
        """df as a table. hashes: its columns are mostly hash values, on which dictionaries and strong compression are lost time."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        how = {"compression": "lz4_raw", "parquet.enable.dictionary": "false"} if hashes else {"compression": "zstd"}
        df.write.options(**how).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quire_path = path
        return out

    def settle(self) -> None:
        """Let Spark delete the shuffle files of finished steps now, not whenever the driver next collects garbage."""
        # the last step is held until its listeners have heard of its end, so its own files go with the second collection
        for wait in (0.5, 0):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(wait)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of save() that no later plan reads."""
        for df in frames:
            path = getattr(df, "_quire_path", None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


# --- Arrow text columns as bytes --------------------------------------------------------------------


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (n + 1); null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE_BYTES):
    """Row ranges (first, last + 1) of about limit bytes each."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def row_pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES):
    """Slices of a record batch with about limit bytes of text, each with its bytes and offsets."""
    data, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    for i, j in pieces(off, limit):
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]


# --- hashing ----------------------------------------------------------------------------------------

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE64 = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_ORDER = (_rng.integers(1, 2**63, 64, dtype=np.uint64) << _U(1)) | _U(1)
_BYTE64_LOWER = _BYTE64.copy()
_BYTE64_LOWER[65:91] = _BYTE64[97:123]
_MULT = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_MULT, -1, 1 << 64)
        out = []
        for base in (_MULT, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        if size > 1 << 24:
            return out[0][:n], out[1][:n]
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray, lower: bool) -> np.ndarray:
    """Running sums of which any substring's hash is (p[e] - p[s]) * M**s."""
    table = _BYTE64_LOWER if lower else _BYTE64
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[1], out=out[1:])
    return out


def words(data: np.ndarray, off: np.ndarray):
    """Words [^\\x20\\x09-\\x0D]+ of all rows: hashes with A-Z lower-cased, first bytes, ends, first word of each row (n + 1)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    start = solid & (before | edge[:n])
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    end = solid & (after | edge[1:])
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    p = prefix_hash(data, True)
    h = mix64((p[e] - p[s]) * powers(n)[0][s] + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(s, off)


def shingles(word_hash: np.ndarray, first: np.ndarray, width: int = SHINGLE_WORDS):
    """Hashes of all shingles in order, and the first shingle of each row (n + 1). Fewer words than width: the whole sequence as one."""
    count = np.diff(first)
    per_row = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(per_row)))
    out = np.empty(at[-1], np.uint64)
    if not len(word_hash):
        return out, at
    row = np.repeat(np.arange(len(count)), per_row)
    pos = np.arange(at[-1]) - at[row] + first[row]
    whole = count[row] >= width
    acc = np.zeros(at[-1], np.uint64)
    for k in range(width):
        idx = pos + k
        ok = idx < first[row + 1]
        acc += np.where(ok, word_hash[np.minimum(idx, len(word_hash) - 1)] * _ORDER[k], _U(0))
    size = np.where(whole, width, count[row]).astype(np.uint64)
    out[:] = mix64(acc + size * _ORDER[63])
    return out, at


def shingle_set(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    data = np.frombuffer(text, np.uint8)
    h, _, _, first = words(data, np.array([0, len(data)]))
    return np.unique(shingles(h, first, width)[0])


def spread(n: int, salt: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    r = np.random.Generator(np.random.PCG64(salt))
    return (r.integers(1, 2**63, n, dtype=np.uint64) << _U(1)) | _U(1)
