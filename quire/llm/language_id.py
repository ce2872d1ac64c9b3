"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (1 to 3 bytes, letters only, lower case), weighted by ln(1 + count) times
inverse document frequency and normalised. Every language has several centroids, found by spherical k-means over a
bounded, hash-chosen sample of its labelled rows. A text gets the language of the centroid with the largest cosine; it
is rejected when that cosine is below the limit of its language and length, which comes from the sample's distances:
short texts lie further from every centroid, so whole texts and pieces of the sample give a limit for each length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import row_pieces

DIMENSIONS = 4096
CENTROIDS = 3
#: At most about this many labelled rows of each language are fitted on (the documented bound of the sample).
SAMPLE_ROWS = 600
ROUNDS = 10
#: A text is rejected below this quantile of the similarities in the sample, of its language and length class.
REJECT_QUANTILE = 0.01
#: Length classes: powers of two of the bytes that are letters; the last takes all longer texts.
CLASSES = 13
UNKNOWN = "und"

_U32 = np.uint32
_BLANK = re.compile(rb"\s")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def vectors(data: np.ndarray, off: np.ndarray, dims: int = DIMENSIONS) -> np.ndarray:
    """One row of ln(1 + count) per text over its hashed n-grams; counts of n-grams that are only blanks are left out."""
    rows = len(off) - 1
    out = np.zeros(rows * dims, np.float32)
    b = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(off))
    code = np.zeros(len(b), np.uint32)
    for width in (1, 2, 3):
        n = len(b) - width + 1
        if n <= 0:
            break
        code = (code[:n] << _U32(8)) | b[width - 1 :]
        same = row[:n] == row[width - 1 :]
        same &= (b[:n] != 32) | (b[width - 1 :] != 32)
        h = (code + _U32(width * 0x01000193)) * _U32(0x9E3779B1)
        h ^= h >> _U32(15)
        h = (h * _U32(0x85EBCA77)) >> _U32(20)
        cell = row[:n][same] * dims + (h[same] % _U32(dims))
        out += np.bincount(cell, minlength=rows * dims).astype(np.float32)
    np.log1p(out, out=out, where=out > 0)
    return out.reshape(rows, dims)


def normalised(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate(([0], np.cumsum(ascii_letter)))
    found = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~found & (np.diff(off) > 0)):
        found[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; starts from rows at even ranks of similarity to the mean. Clusters under one row in twenty dissolve."""
    rank = np.argsort(x @ normalised(x.mean(axis=0, keepdims=True))[0], kind="stable")
    centres = x[rank[(np.arange(k) * 2 + 1) * len(x) // (2 * k)]]
    for _ in range(rounds):
        which = (x @ centres.T).argmax(axis=1)
        kept = [c for c in range(len(centres)) if (which == c).sum() >= max(1, len(x) // 20)]
        centres = normalised(np.vstack([x[which == c].mean(axis=0) for c in kept]))
    which = (x @ centres.T).argmax(axis=1)
    kept = np.unique(which)
    return centres[kept], np.searchsorted(kept, which)


def length_classes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(_FOLD[data] != 32)))
    n = np.maximum(total[off[1:]] - total[off[:-1]], 1)
    return np.minimum(np.frexp(n)[1] - 1, CLASSES - 1)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text, and one piece of whole words for each length class below its own, from a place chosen by a hash."""
    yield text
    for k in range(CLASSES - 1):
        size = (3 << k) // 2
        if size >= len(text):
            return
        start = _BLANK.search(text, zlib.crc32(text, k) % (len(text) - size))
        end = _BLANK.search(text, start.end() + size) if start else None
        if end:
            yield text[start.end() : end.start()]


@dataclass
class Model:
    """idf by dimension; centroids with their language and rejection limits by length class."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    limits: np.ndarray


def fit(x: np.ndarray, langs: list[str], centroids: int = CENTROIDS) -> Model:
    """A model that rejects nothing yet."""
    if not len(x):
        return Model(np.ones(x.shape[1], np.float32), np.empty((0, x.shape[1]), np.float32), [], np.zeros((0, CLASSES)))
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = normalised(x * idf)
    names = np.array(langs, dtype=object)
    centres, owners = [], []
    for lang in sorted(set(langs)):
        c, _ = cluster(x[names == lang], centroids)
        centres.extend(c)
        owners += [lang] * len(c)
    return Model(idf, np.vstack(centres).astype(np.float32), owners, np.zeros((len(owners), CLASSES)))


def limits(langs: list[str], found: list[tuple[str, int, float]], quantile: float = REJECT_QUANTILE) -> np.ndarray:
    """A row of limits by length class for each of langs. found: language, length class and similarity of texts and pieces.

    A class without texts has the limit of the next shorter one that has some, and 0 if there is none.
    """
    by: dict[tuple[str, int], list[float]] = {}
    for lang, k, similar in found:
        by.setdefault((lang, k), []).append(similar)
    out = np.zeros((len(langs), CLASSES))
    for i, lang in enumerate(langs):
        for k in range(CLASSES):
            own = by.get((lang, k))
            out[i, k] = np.quantile(own, quantile) if own else out[i, k - 1] if k else 0
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, dims: int = DIMENSIONS) -> Model:
    """Fit on the rows given, which carry doc_id, text and lang; null languages and texts are left out.

    The sample is chosen by a hash of doc_id whose range follows each language's row count, so it is the same in every
    run and its size stays near sample_rows a language at every input size. Only the sample's vectors, and the
    similarities of its texts and pieces, reach the driver.
    """
    labelled = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.empty((0, dims), np.float32), [])
    scale = 1 << 30
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(scale, scale * sample_rows // n))])
    sample = labelled.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit("")), F.lit(17)), F.lit(scale)) < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in row_pieces(batch, "text"):
                x = vectors(data, off, dims)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["doc_id", "lang", "v"])

    rows = sorted(sample.mapInArrow(run, "doc_id string, lang string, v binary").collect(), key=lambda r: (r["lang"], r["doc_id"] or "", bytes(r["v"])))
    x = np.vstack([np.frombuffer(r["v"], np.float16) for r in rows]).astype(np.float32) if rows else np.empty((0, dims), np.float32)
    model = fit(x, [r["lang"] for r in rows])
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        own = {lang: np.array([name == lang for name in m.langs]) for lang in m.langs}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parts = list(pieces(text.as_py().encode()))
                off = np.concatenate(([0], np.cumsum([len(b) for b in parts])))
                data = np.frombuffer(b"".join(parts), np.uint8)
                letters = has_letter(data, off)
                cos = normalised(vectors(data, off, dims) * m.idf) @ m.centroids[own[lang]].T
                k, similar = length_classes(data, off)[letters], cos.max(axis=1)[letters].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(similar)], ["lang", "k", "similar"])

    if model.langs:
        found = sample.select("text", "lang").mapInArrow(measure, "lang string, k int, similar double").collect()
        model.limits = limits(model.langs, [(r["lang"], r["k"], r["similar"]) for r in found])
    return model


def predict(docs: DataFrame, model: Model, dims: int = DIMENSIONS) -> DataFrame:
    """The columns of docs with lang_pred, score (the cosine, 0 to 1) and rejected.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every row if there was nothing to
    learn from. Columns of docs that clash with the three new ones are replaced. The model is a few dozen centroids,
    whatever the input's size. Narrow map, no shuffle; only doc_id-free text crosses to Python.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for batch in batches:
            for part, data, off in row_pieces(batch, "text"):
                letters = has_letter(data, off)
                n = part.num_rows
                best, score, low = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
                if m.langs:
                    cos = normalised(vectors(data, off, dims) * m.idf) @ m.centroids.T
                    best = cos.argmax(axis=1)
                    score = np.clip(cos[np.arange(n), best].astype(np.float64), 0, 1)
                    low = score < m.limits[best, length_classes(data, off)]
                known = letters & bool(m.langs)
                lang = [m.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(low | ~known)], [*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def held_out():
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Train on the rows that are not held out and predict all rows: columns, held_out, lang_pred, score, rejected."""
    model = train(docs.where(~held_out()))
    keep = columns if columns is not None else docs.columns
    return predict(docs.select(*keep), model).withColumn("held_out", held_out())
