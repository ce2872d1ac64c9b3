"""Token counts by heap-and-linked-list byte-pair merging.

The number of tokens of a word is its initial symbols minus the merges that byte-pair encoding makes; no token
identifiers are produced. Merges are found by popping the lowest-ranked adjacent pair from a heap over a doubly linked
list of symbols. The vocabulary file is a parameter and is opened on each executor.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import text_bytes

#: Distinct words whose counts a Python worker remembers before it starts anew.
CACHE_WORDS = 1_000_000
TOKEN_LIMIT = 2048

_BLANKS = str.maketrans("\t\n\r", "   ")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def merges_in(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes in this word: the lowest rank first, the leftmost among equals."""
    n = len(symbols)
    if n < 2:
        return 0
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    part: list[str | None] = list(symbols)
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    merged = 0
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if part[i] != left or j >= n or part[j] != right:
            continue
        part[i] = both = left + right
        part[j] = None
        k = after[i] = after[j]
        merged += 1
        if k < n:
            before[k] = i
            rank = ranks.get((both, part[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, both, part[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((part[h], both))
            if rank is not None:
                heapq.heappush(heap, (rank, h, part[h], both))
    return merged


class WordCounter(dict):
    """Token counts by blank-separated chunk of text; missing ones are computed."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain byte-pair vocabularies are supported")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.known = frozenset(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        self.limit = limit
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        marks = [t["content"] for t in spec["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if marks else None

    def __missing__(self, chunk: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[chunk] = self.pieces(chunk)
        return found

    def pieces(self, text: str) -> int:
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        total = 0
        for piece, _ in self.splitter.pre_tokenize_str(text):
            symbols = list(piece)
            symbols[-1] += self.suffix
            # a symbol outside the vocabulary has no identifier and, without an unknown token, is left out
            unknown = sum(s not in self.known for s in symbols)
            total += len(symbols) - unknown - merges_in(symbols, self.ranks)
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.specials is not None and "<" in text and (n := len(self.specials.findall(text))):
            return n + sum(map(self.count, filter(None, self.specials.split(text))))
        # only these four blanks part chunks here: the library's own rules see all others inside a chunk
        return sum(map(self.__getitem__, filter(None, text.translate(_BLANKS).split(" "))))


_COUNTERS: dict[str, WordCounter] = {}


def _counter(path: str) -> WordCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each. Other columns are not read, so
    clashing names do not matter. An empty table gives an empty result. The work is a narrow map: no shuffle.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            _, off = text_bytes(batch.column(1))
            n = np.fromiter((counter.count(t.as_py() or "") for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
