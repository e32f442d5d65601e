"""Benchmark passages in documents.

Every item gives a 256-bit SimHash of its five-word shingles. Windows of an item's size slide over a document word by word;
the SimHash of each is looked up among the items of that size by multi-index hashing, which finds every item within the
radius: fingerprints of BLOCKS blocks that differ by at most RADIUS bits differ by at most FLIPS bits in one of them. Of
unrelated items a block's lookup brings about 1 in 94, all blocks about 1 in 6, and the whole distance none. What the index
finds is verified by the exact weighted similarity of its shingles, a shingle's weight being how often it occurs: the sum of
the lesser weights over the sum of the greater. Windows that share no shingle with any item of their size have similarity
zero and are not hashed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_BYTES, keep_rows, map_batches, utf8
from quern.llm.license_scan import words_of

#: Words of a shingle; blocks of a fingerprint and bits of a block; bits that a lookup changes.
WIDTH, BLOCKS, BLOCK_BITS, FLIPS = 5, 16, 16, 3
#: What the blocks guarantee. Fingerprints of similarity 0.8 differ by 39 bits, with a deviation of 6: one in 100,000 is beyond.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Windows that are hashed at once (or an item's shingles, if these are more): 1 KB each.
PIECE = 4096


def shingles(words: list[bytes], width: int = WIDTH) -> list[tuple[bytes, ...]]:
    """Runs of `width` words; fewer words: the whole sequence; none: nothing."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(width)), strict=False))


def shingle_bits(own: Iterable[tuple[bytes, ...]]) -> np.ndarray:
    """A row of 256 bits for each shingle."""
    joined = [b" ".join(x) for x in own]
    raw = b"".join([xxhash.xxh3_128_digest(x) + xxhash.xxh3_128_digest(x, 1) for x in joined])
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 32), axis=1)


def blocks_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 16-bit blocks."""
    return np.packbits(bits, axis=1).view(np.uint16)


def fingerprint(own: Counter) -> np.ndarray:
    """The blocks of a multiset's SimHash: a bit is 1 if set in over half of the shingles."""
    ones = np.array(list(own.values()), np.int64) @ shingle_bits(own).astype(np.int64)
    return blocks_of((2 * ones > own.total())[None, :])[0]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = a.total() + b.total() - shared
    return shared / total if total else 0.0


def changes(flips: int) -> np.ndarray:
    """All changes of up to `flips` bits of a block."""
    return np.array([sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(BLOCK_BITS), k)], np.uint16)


#: Of the FLIPS bits, up to OWN are changed in the table, which holds each item under all values that this gives, the others in
#: the lookup: 17 entries an item and 137 lookups a window for each block, where looking all changes up would take 697.
OWN = 1
TABLED, ASKED = changes(OWN), changes(FLIPS - OWN)


class MultiIndex:
    """Items by the values of each of their blocks and those up to OWN bits from them; a lookup asks for all values up to the other bits away."""

    def __init__(self, fingerprints: np.ndarray):
        self.fingerprints = fingerprints  # a row of blocks each
        self.tables = []  # by block: distinct values, the first entry of each, items by value
        for block in range(BLOCKS):
            values = (fingerprints[:, block, None] ^ TABLED[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            distinct, first = np.unique(values[order], return_index=True)
            self.tables.append((distinct, np.append(first, len(order)), (order // len(TABLED)).astype(np.int32)))

    def candidates(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row of fps, item) that are at most FLIPS bits apart in one block or more."""
        n = len(self.fingerprints)
        pairs = []
        for a in range(0, len(fps), 256):
            found = [np.zeros(0, np.int64)]
            for block, (distinct, first, items) in enumerate(self.tables):
                asked = (fps[a : a + 256, block, None] ^ ASKED[None, :]).ravel()
                place = np.minimum(np.searchsorted(distinct, asked), len(distinct) - 1)
                hit = np.flatnonzero(distinct[place] == asked)
                low, high = first[place[hit]], first[place[hit] + 1]
                size = high - low
                stop = np.cumsum(size)
                entry = np.repeat(low - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)
                found.append((np.repeat(hit // len(ASKED), size) + a) * n + items[entry])
            pairs.append(np.unique(np.concatenate(found)))
        pairs = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        return pairs // n, pairs % n

    def within(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of fps, item) of every item at most RADIUS bits away."""
        row, item = self.candidates(fps)
        near = np.bitwise_count(fps[row] ^ self.fingerprints[item]).sum(axis=1, dtype=np.int64) <= RADIUS
        return row[near], item[near]


class BenchmarkIndex:
    """The items of a benchmark by their number of words."""

    def __init__(self, items: Iterable[tuple[int | None, str]], threshold: float = 0.8):
        self.threshold = threshold
        by_size: dict[int, list[tuple[int | None, Counter]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of((text or "").encode())
            if words:
                by_size[len(words)].append((item_id, Counter(shingles(words))))
        self.sizes = {}
        self.owners: dict[tuple[bytes, ...], list[int]] = defaultdict(list)  # shingle -> sizes of the items that hold it
        for size, held in sorted(by_size.items()):
            self.sizes[size] = (held, MultiIndex(np.array([fingerprint(c) for _, c in held])))
            for s in {s for _, c in held for s in c}:
                self.owners[s].append(size)
        self.short = sorted({len(s) for s in self.owners if len(s) < WIDTH})
        self.owners = dict(self.owners)

    def find(self, words: list[bytes]) -> list[tuple[int | None, int, int, float]]:
        """(item_id, first word, number of words, similarity) of each item's best window of at least the threshold."""
        owners = self.owners
        hits: dict[int, list[int]] = defaultdict(list)  # size -> places of shared shingles
        for i, s in enumerate(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)):
            if s in owners:
                for size in owners[s]:
                    hits[size].append(i)
        for k in self.short:
            for i, s in enumerate(zip(*(words[j:] for j in range(k)), strict=False)):
                for size in owners.get(s, ()):
                    if size == k or len(words) < WIDTH:
                        hits[size].append(i)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}  # by size and place among the items of that size
        for size, places in hits.items():
            for item, start, n, share in self._windows(words, size, places):
                if (size, item) not in best or (share, -start) > (best[size, item][0], -best[size, item][1]):
                    best[size, item] = (share, start, n)
        return [(self.sizes[size][0][item][0], start, n, share) for (size, item), (share, start, n) in sorted(best.items())]

    def _windows(self, words: list[bytes], size: int, places: list[int]) -> Iterator[tuple[int, int, int, float]]:
        held, index = self.sizes[size]
        size = min(size, len(words))
        width = min(WIDTH, size)
        per = size - width + 1  # shingles of a window
        last = len(words) - size
        piece = max(PIECE, per)
        for low, high in _pieces(places, size, per, last, piece):
            own = [tuple(words[i : i + width]) for i in range(low, high + per)]
            shared = np.cumsum([0] + [s in self.owners for s in own])
            asked = np.flatnonzero(shared[per:] > shared[:-per])
            sums = np.zeros((len(own) + 1, 256), np.int32)
            np.cumsum(shingle_bits(own), axis=0, out=sums[1:], dtype=np.int32)
            fps = blocks_of((sums[asked + per] - sums[asked]) * 2 > per)
            row, item = index.within(fps)
            window, at = Counter(), -1
            for k, i in zip(asked[row].tolist(), item.tolist(), strict=True):
                if k != at:
                    window, at = Counter(own[k : k + per]), k
                share = similarity(window, held[i][1])
                if share >= self.threshold:
                    yield i, low + k, size, share


def _pieces(places: list[int], size: int, per: int, last: int, piece: int) -> Iterator[tuple[int, int]]:
    """(first, last) windows of runs of places whose windows touch, a bounded number at a time."""
    a = 0
    while a < len(places):
        b = a
        while b + 1 < len(places) and places[b + 1] - places[b] <= 2 * size:
            b += 1
        low, high = max(0, places[a] - per + 1), min(last, places[b])
        a = b + 1
        for start in range(low, high + 1, piece):
            yield start, min(high, start + piece - 1)


SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double"


#: What an item's fingerprint and its entries in the tables take.
ITEM_BYTES = 300 + BLOCKS * len(TABLED) * 10


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct items in blocks of a bounded size, read one partition at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r.item_id, r.text))
        size += 24 * len(r.text) + ITEM_BYTES
        if size > most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, start_word, n_words, similarity (the best window; ties: the first).

    An item is a distinct pair of id and text: rows that repeat both are one, different texts of one id, or of null ids, are
    items of their own with a row for each. Words are runs of letters and digits, A-Z lower-cased. A document shorter than
    an item is one window. Null texts and items without words match nothing. Documents with null or repeated ids are
    reported row by row; further columns are not read; an empty table on either side gives an empty result. Items are
    broadcast in blocks of a bounded size, one scan each; how they are dealt to blocks changes nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block in _blocks(benchmark, max_broadcast_bytes):
        one = _scan(rows, BenchmarkIndex(block, threshold))
        found = one if found is None else found.unionAll(one)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.8, max_broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; null texts stay."""
    for block in _blocks(benchmark, max_broadcast_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(block, threshold))
        docs = keep_rows(docs, text_col, lambda texts, sent=sent: [not sent.value.find(words_of((t or "").encode())) for t in texts])
    return docs


def _scan(rows: DataFrame, index: BenchmarkIndex) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sent.value.find
        for b in batches:
            out = [(doc, *hit) for doc, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True) for hit in find(words_of(text))]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return map_batches(rows, run, SCHEMA)
