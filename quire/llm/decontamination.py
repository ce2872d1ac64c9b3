"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact weighted-shingle similarity.

A benchmark item is a bag of 5-word shingles. In a document, windows of as many shingles as an item has are
fingerprinted with a 64-bit SimHash (each shingle counts as often as it occurs). Fingerprints are split into eight
blocks of eight bits; within Hamming radius 23 at least one block differs in two bits at most, so the item index lists
every block value within two bits and misses no fingerprint of the radius. Windows without a single shingle of the
items are passed over, since their similarity is 0. Candidates are verified by weighted Jaccard similarity.

At similarity 0.75 two equally long bags differ in 11 of 64 bits on average, with a standard deviation of 3: radius 23
is four deviations above.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import JACCARD, SHINGLE_WORDS, mix64, row_pieces, shingles, words

RADIUS = 23
BLOCKS = 8
#: Bytes of item text that one broadcast index covers; more text is worked through in several blocks.
INDEX_BYTES = 2 << 20

_U = np.uint64
_NEAR = [m for n in range(RADIUS // BLOCKS + 1) for m in (sum(1 << b for b in c) for c in itertools.combinations(range(8), n))]


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 by bit of each hash, as (n, 64)."""
    bits = np.unpackbits(mix64(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Bits set where a sum is positive, as (n, 8) bytes."""
    return np.packbits(sums > 0, axis=1)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Index:
    """Items of one block: their shingle bags, fingerprints by size, and the multi-index over fingerprint blocks."""

    def __init__(self, items: list[tuple[int, str | None]], width: int, threshold):
        self.width, self.threshold, self.source = width, threshold, items
        self.ids: list[int] = []
        self.words: list[int] = []
        self.bags: list[Counter] = []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        prints, sizes = [], []
        owners: dict[int, set[int]] = defaultdict(set)
        for item, text in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or "")):
            data = np.frombuffer((text or "").encode(), np.uint8)
            h, _, _, first = words(data, np.array([0, len(data)]))
            if not len(h):
                continue
            s = shingles(h, first, width)[0]
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(len(h))
            self.bags.append(Counter(s.tolist()))
            prints.append(fingerprints(signs(s).sum(axis=0, keepdims=True))[0])
            sizes.append(len(s))
            if len(h) < width:
                # a sequence shorter than a shingle occurs where just these words stand
                self.short[len(h)][int(s[0])].append(k)
                continue
            for x in set(s.tolist()):
                owners[x].add(k)
        self.prints = np.array(prints, np.uint8).reshape(-1, 8)
        self.sizes = np.array(sizes, np.int64)
        self.known = np.array(sorted(owners), np.uint64)
        #: sizes of the items that have a shingle
        self.owner_sizes = [sorted({sizes[k] for k in owners[x]}) for x in self.known.tolist()]
        self.low = np.zeros(1 << 20, bool)
        self.low[self.known & _U((1 << 20) - 1)] = True
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for k, size in enumerate(sizes):
            if self.words[k] < width:
                continue
            tables = self.tables.setdefault(size, [defaultdict(list) for _ in range(BLOCKS)])
            for b in range(BLOCKS):
                for m in _NEAR:
                    tables[b][int(self.prints[k][b]) ^ m].append(k)

    def candidates(self, size: int, prints: np.ndarray) -> dict[int, np.ndarray]:
        """By item of this size, the places in prints whose fingerprint is within the radius."""
        by_item: dict[int, list[np.ndarray]] = defaultdict(list)
        for b, table in enumerate(self.tables[size]):
            order = np.argsort(prints[:, b], kind="stable")
            values, starts = np.unique(prints[order, b], return_index=True)
            for v, places in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                for k in table.get(v, ()):
                    by_item[k].append(places)
        out = {}
        for k, lists in by_item.items():
            at = np.unique(np.concatenate(lists))
            at = at[_ONES[prints[at] ^ self.prints[k]].sum(axis=1) <= RADIUS]
            if len(at):
                out[k] = at
        return out

    def best_window(self, k: int, s: np.ndarray, starts: np.ndarray, size: int) -> tuple[float, int] | None:
        """The highest similarity of the item with a window at one of starts, and the first such window; None below the threshold."""
        p, q = self.threshold
        bag = self.bags[k]
        total = sum(bag.values())
        best = None
        lo, hi = int(starts[0]), int(starts[-1]) + size
        window: Counter = Counter()
        common = 0
        values = s[lo:hi].tolist()
        wanted = set((starts - lo).tolist())
        for i, x in enumerate(values):
            if x in bag:
                window[x] += 1
                common += window[x] <= bag[x]
            if i >= size and (y := values[i - size]) in bag:
                common -= window[y] <= bag[y]
                window[y] -= 1
            at = i - size + 1
            if at in wanted:
                union = total + size - common
                if q * common >= p * union and (best is None or common * best[1] > best[0] * union):
                    best = (common, union, lo + at)
        return None if best is None else (best[0] / best[1], best[2])

    def matches(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) for each document row and item that match."""
        h, _, _, first = words(data, off)
        s, at = shingles(h, first, self.width)
        found = []
        maybe = np.flatnonzero(self.low[s & _U((1 << 20) - 1)])
        where = np.searchsorted(self.known, s[maybe])
        hit = (where < len(self.known)) & (self.known[np.minimum(where, max(len(self.known) - 1, 0))] == s[maybe]) if len(self.known) else np.zeros(len(maybe), bool)
        maybe, where = maybe[hit], where[hit]
        rows = np.searchsorted(at, maybe, "right") - 1
        for row in np.unique(rows):
            own = rows == row
            found += self._in_row(int(row), s[at[row] : at[row + 1]], maybe[own] - at[row], where[own])
        for n, table in self.short.items():
            t, start = shingles(h, first, n)
            keys = np.array(sorted(table), np.uint64)
            place = np.minimum(np.searchsorted(keys, t), len(keys) - 1)
            seen = set()
            for i in np.flatnonzero(keys[place] == t):
                row = int(np.searchsorted(start, i, "right") - 1)
                for k in table[int(t[i])]:
                    if (row, k) not in seen:
                        seen.add((row, k))
                        found.append((row, k, 1.0, int(i - start[row]), n))
        return found

    def _in_row(self, row: int, s: np.ndarray, hits: np.ndarray, which: np.ndarray) -> list:
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, x in zip(hits.tolist(), which.tolist(), strict=True):
            for size in self.owner_sizes[x]:
                by_size[size].append(i)
        out = []
        lo, hi = int(hits[0]), int(hits[-1]) + 1
        for size, places in by_size.items():
            span = min(size, len(s))
            cover = np.zeros(len(s) - span + 2, np.int64)
            places = np.array(places)
            np.add.at(cover, np.maximum(places - span + 1, 0), 1)
            np.add.at(cover, np.minimum(places, len(s) - span) + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            # stretches of windows that follow one another share one running sum
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for i in range(0, len(part), 1 << 14):
                    run = part[i : i + (1 << 14)]
                    total = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(signs(s[run[0] : run[-1] + span]), axis=0, dtype=np.int32)))
                    prints = fingerprints(total[run - run[0] + span] - total[run - run[0]])
                    for k, inside in self.candidates(size, prints).items():
                        got = self.best_window(k, s, run[inside], span)
                        if got:
                            out.append((row, k, got[0], got[1], span + self.width - 1))
        best: dict[int, tuple] = {}
        for m in out:
            if m[1] not in best or (-m[2], m[3]) < (-best[m[1]][2], best[m[1]][3]):
                best[m[1]] = m
        return list(best.values())


def item_blocks(items: DataFrame, width: int, threshold, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over all items, each of a bounded amount of text, chosen by a hash of item_id."""
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-size // limit))
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield Index([(r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()], width, threshold)


def contaminated(docs: DataFrame, items: DataFrame, width: int = SHINGLE_WORDS, threshold=JACCARD) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: each document and item that match, with the best window.

    Only matching documents have rows. Null texts and items without words match nothing. An item of fewer than five
    words matches where just these words follow one another. A document shorter than an item is one window. Equal items
    all match; repeated rows of documents have rows each; ties go to the first window. Other columns are not read;
    empty tables give an empty result. One narrow pass over the documents for each block of items.
    """
    spark = docs.sparkSession
    out = None
    slim = docs.select("doc_id", "text")
    for index in item_blocks(items, width, threshold):
        shared = spark.sparkContext.broadcast(index_parts(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value)
            for batch in batches:
                for part, data, off in row_pieces(batch, "text"):
                    m = index.matches(data, off)
                    ids = part.column(0).take(pa.array([x[0] for x in m], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[x[1]] for x in m], pa.int64()), *(pa.array([x[i] for x in m], k) for i, k in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        kind = docs.schema["doc_id"].dataType.simpleString()
        part = slim.mapInArrow(run, f"doc_id {kind}, item_id long, similarity double, start_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, width: int = SHINGLE_WORDS, threshold=JACCARD) -> DataFrame:
    """The rows of docs that match no item, with all their columns: a filter without a shuffle."""
    spark = docs.sparkSession
    for index in item_blocks(items, width, threshold):
        shared = spark.sparkContext.broadcast(index_parts(index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = index_of(shared.value)
            for batch in batches:
                for part, data, off in row_pieces(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in index.matches(data, off)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def index_parts(index: Index) -> tuple:
    """What an index is built from, small enough to broadcast."""
    return index.width, index.threshold, index.source


_BUILT: list[tuple[tuple, Index]] = []


def index_of(parts: tuple) -> Index:
    """The index of these parts; a worker keeps the last one it built."""
    if not _BUILT or _BUILT[0][0] != parts:
        _BUILT[:] = [(parts, Index(parts[2], parts[0], parts[1]))]
    return _BUILT[0][1]
