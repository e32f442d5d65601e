"""Repeated passages across documents, found with compressed FM-indexes.

A window is `least` consecutive words. Every window is owned by its anchor, the 16-word run of least hash in it, so equal
windows in any two documents have equal anchors; the windows of one anchor make a context, the passage they cover. Contexts
are dealt to shards by their anchors, and only anchors that stand in two documents or more go there. A shard keeps one
copy of equal contexts with their least doc_id. Its FM-index is a wavelet matrix over the Burrows-Wheeler transform of its
contexts. Every context is then streamed through the index by backward search, which extends a match to the left while
some occurrence belongs to a smaller doc_id: matching statistics towards smaller documents. Matches of at least a window's
length are the intervals that documents lose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Powers, map_batches, materialize, mixed, rehashed, release, utf8

GRAM = 16
#: The owner of an empty range; owners are places of ids in a shard, far below.
NOBODY = (1 << 63) - 1
#: Words that a shard's index holds, about, and contexts of one anchor beyond which they are compared window by window.
SHARD_WORDS, CROWD = 1 << 18, 1 << 11

def contexts(words: list[bytes], least: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Arrays (anchor hash, context hash, first window, number of windows) that cover every window of a document."""
    n = len(words)
    if n < least:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    up, down = powers(n)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(np.array([digest(w) for w in words], np.uint64) * up[:n], out=h[1:])
    gram = min(GRAM, least)
    grams = mixed((h[gram:] - h[:-gram]) * down[: n - gram + 1])
    span = least - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(n - least + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    place = at[first]
    whole = (h[first + count + least - 1] - h[first]) * down[first]
    own = mixed(whole ^ mixed((place - first).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64)))
    return grams[place], own, first, count


class BitVector:
    """Packed bits with a running count for each 64."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are 1."""
        block = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)


class FMIndex:
    """Backward search over symbols 1 and up; every text ends with a 0.

    owner: for each text the number that a match reports, the least of its occurrences.
    """

    def __init__(self, texts: list[np.ndarray], owner: np.ndarray):
        total = sum(map(len, texts)) + len(texts)
        s = np.zeros(total, np.int64)
        own = np.zeros(total, np.int64)
        at = 0
        for t, o in zip(texts, owner.tolist(), strict=True):
            s[at : at + len(t)] = t
            own[at : at + len(t) + 1] = o
            at += len(t) + 1
        order = self._suffixes(s, max(map(len, texts), default=0) + 1)
        bwt = s[order - 1]  # before the first symbol stands the last one, a 0
        self.levels = max(1, int(s.max(initial=0)).bit_length())
        self.bits: list[BitVector] = []
        x = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level & 1).astype(bool)
            self.bits.append(BitVector(bit))
            x = np.concatenate([x[~bit], x[bit]])
        counts = np.bincount(s, minlength=(1 << self.levels) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.size = total
        every = np.arange(1 << self.levels) if self.levels < 22 else np.unique(s)
        self.base = np.zeros(1 << self.levels, np.int64)
        self.base[every] = self._down(every, np.zeros(len(every), np.int64))
        self.least = [own[order]]
        while 2 << (len(self.least) - 1) <= total:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _suffixes(s: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes in the order of their first `depth` symbols, by doubling."""
        rank, k, n = s.copy(), 1, len(s)
        while True:
            ahead = np.zeros(n, np.int64)
            ahead[: n - k] = rank[k:]
            key = rank * (int(rank.max(initial=0)) + 1) + ahead
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else 0
            k *= 2
            if k >= depth or n == 0 or int(rank.max()) == n - 1:
                return order

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            one = (c >> level & 1).astype(bool)
            r = bits.ones(i)
            i = np.where(one, bits.zeros + r, i - r)
        return i

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of symbol c before the strings of ranges [low, high)."""
        both = self._down(np.concatenate([c, c]), np.concatenate([low, high]))
        shift = self.first[c] - self.base[c]
        return both[: len(c)] + shift, both[len(c) :] + shift

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner in each range; the largest number for an empty one."""
        n = high - low
        out = np.full(len(low), NOBODY, np.int64)
        full = np.flatnonzero(n > 0)
        level = np.frexp(n[full].astype(np.float64))[1] - 1
        for k in np.unique(level):
            rows = full[level == k]
            table = self.least[k]
            out[rows] = np.minimum(table[low[rows]], table[high[rows] - (1 << int(k))])
        return out


def repeated_windows(texts: list[np.ndarray], owner: np.ndarray, least: int) -> list[int]:
    """For each text the bit set of its windows (bit: first word) that also stand in a text of a smaller owner.

    A search that breaks off after s words tells that no window with those s + 1 words can match, so the next one tried
    starts behind them. A window that matches is grown to the longest match from its first word on, by halving.
    """
    index = FMIndex(texts, owner)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    found = [0] * len(texts)

    def matched(rows: np.ndarray, end: np.ndarray, want: np.ndarray) -> np.ndarray:
        """How many words before `end`, at most `want`, stand in a smaller owner's text."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), index.size, np.int64)
        length = np.zeros(len(rows), np.int64)
        at, own, going = starts[rows] + end - 1, owner[rows], np.arange(len(rows))
        while len(going):
            a, b = index.extend(flat[at[going] - length[going]], low[going], high[going])
            smaller = index.least_owner(a, b) < own[going]
            going, a, b = going[smaller], a[smaller], b[smaller]
            low[going], high[going] = a, b
            length[going] += 1
            going = going[length[going] < want[going]]
        return length

    rows = np.flatnonzero(lengths >= least)
    # the window tried starts at `low`; `good` is the end of its longest match known (0: none yet), `bad` of one that fails
    low, good, bad = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), lengths[rows] + 1
    while len(rows):
        size = lengths[rows]
        end = np.where(good == 0, low + least, np.where(bad > size, size, (good + bad) // 2))
        s = matched(rows, end, end - low)
        whole, fresh = s == end - low, good == 0
        low = np.where(fresh & ~whole, end - s, low)
        good = np.where(whole, end, good)
        bad = np.where(~whole & ~fresh, end, bad)
        done = (good > 0) & ((good == size) | (bad - good <= 1))
        for k in np.flatnonzero(done).tolist():
            found[int(rows[k])] |= (1 << (int(good[k]) - least + 1)) - (1 << int(low[k]))
        low = np.where(done, good - least + 1, low)
        good, bad = np.where(done, 0, good), np.where(done, size + 1, bad)
        going = low + least <= size
        rows, low, good, bad = rows[going], low[going], good[going], bad[going]
    return found


def _words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


ANCHORS = pa.list_(pa.struct([("g", pa.int64()), ("c", pa.int64()), ("at", pa.int64())]))


def _scan(least: int):
    """Every document's digest, and its contexts: anchor, hash, and first window * 64 + number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            counts, digests, offsets, parts = [], [], [0], ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)])
            for text in utf8(b.column(2)):
                words = _words(text)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                g, c, first, count = contexts(words, least, powers)
                offsets.append(offsets[-1] + len(g))
                for p, x in zip(parts, (g, c, first * 64 + count), strict=True):
                    p.append(x)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(p).view(np.int64)) for p in parts], fields=list(ANCHORS.value_type))
            anchors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, type=ANCHORS)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(digests), anchors], ["id", "key", "n_words", "sha256", "anchors"])

    return run


def _cut(least: int):
    """Documents with places, as rows of contexts with their words; of crowded anchors as rows of windows with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, places in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = _words(text)
                for p in places:
                    first, count = divmod(p["at"], 64)
                    if p["shard"] >= 0:
                        out.append((p["shard"], p["g"], p["c"], doc, None, b" ".join(words[first : first + count + least - 1])))
                    else:
                        for i in range(count):
                            own = hashlib.blake2b(b" ".join(words[first + i : first + i + least]), digest_size=16).digest()
                            out.append((-1, p["g"], p["c"], doc, i, own))
            for a in range(0, len(out), 2048):
                columns = zip(*out[a : a + 2048], strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["shard", "g", "c", "id", "bit", "words"])

    return run


def _match(least: int):
    """A shard's contexts as rows (g, c, bits) of those with windows in smaller documents."""

    def search(rows: list[tuple[int, int, int | None, bytes]]) -> pa.RecordBatch:
        symbols: dict[bytes, int] = {}
        texts = [np.array([symbols.setdefault(w, len(symbols) + 1) for w in words.split(b" ")], np.int64) for *_, words in rows]
        place = {doc: i for i, doc in enumerate(sorted({doc for _, _, doc, _ in rows if doc is not None}))}
        bits = repeated_windows(texts, np.array([place.get(doc, len(place)) for _, _, doc, _ in rows], np.int64), least)
        hit = [i for i, x in enumerate(bits) if x]
        return pa.record_batch([pa.array([f(i) for i in hit], pa.int64()) for f in (lambda i: rows[i][0], lambda i: rows[i][1], lambda i: bits[i])], ["g", "c", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for b in batches:
            for s, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if s != shard:
                    if rows:
                        yield search(rows)
                    shard, rows = s, []
                rows.append(tuple(row))
        if rows:
            yield search(rows)

    return run


def remove_covered(words: list[bytes], places: list[tuple[int, int]], least: int) -> tuple[list[bytes], int]:
    """(kept words, number removed); places: a first window and the bit set of the windows from there that go."""
    edge = np.zeros(len(words) + 1, np.int64)
    for first, bits in places:
        starts = [first + i for i in range(bits.bit_length()) if bits >> i & 1]
        np.add.at(edge, starts, 1)
        np.add.at(edge, [s + least for s in starts], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x], int(gone.sum())


def _rewrite(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, places in zip(utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = _words(text)
                left, n = remove_covered(words, [(p["at"] >> 6, p["bits"]) for p in places], least)
                kept = b" ".join(left)
                out.append((len(words), n, hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([b.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, shard_words: int = SHARD_WORDS, crowd: int = CROWD) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by a blank; null if none goes).

    Words are cut at ASCII white space. A word goes if a window of `least` words that covers it also starts in a document
    with a smaller doc_id; windows are judged on the input. Equal ids are no smaller than each other; a null id is larger
    than any. A null text has no words. Rows that repeat an id are judged one by one. Further columns are not read; an
    empty table gives an empty one. least: 2 to 60, as a context's windows are the bits of a long.

    An anchor with over `crowd` different contexts (a passage that very many documents surround with text of their own)
    would overfill a shard: its windows are compared by 128-bit hashes in an aggregation instead, with the same outcome.
    For those windows the FM-index decides nothing; the choice between the two follows from the number of contexts alone.
    """
    if not 2 <= least <= 60:
        raise ValueError("least must be 2 to 60")
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    )
    held = materialize(map_batches(rows, _scan(least), "id long, key long, n_words long, sha256 string, anchors array<struct<g:long,c:long,at:long>>"), "anchors")
    places = held.select("id", "key", F.explode("anchors").alias("a")).select("id", "key", "a.*")
    # the anchors that stand in two documents, and every place of theirs; written first, so that Spark can split a common anchor in the join
    apart = "low < high or (known > 0 and known < n)"
    known = [F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("known"), F.count("*").alias("n")]
    twice = materialize(places.groupBy("g").agg(*known).where(apart).select("g"), "twice")
    again = materialize(places.join(twice, "g", "left_semi"), "places")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "at")).alias("m")
    ones = again.groupBy("g", "c").agg(first).select("g", "c", "m.id", "m.key", "m.at")
    ones = materialize(ones, "contexts")
    release(spark)
    total = ones.agg(F.sum(F.pmod("at", F.lit(64)) + F.lit(least - 1))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    crowded = ones.groupBy("g").count().where(F.col("count") > crowd).select("g", F.lit(True).alias("many"))
    shard = F.when(F.col("many"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("g"), F.lit(shards))).cast("int")
    asked = rehashed(ones, crowded, "g", "left").groupBy("id", "key").agg(F.collect_list(F.struct(shard.alias("shard"), "g", "c", "at")).alias("places"))
    # rows that repeat an id and a text would repeat their contexts, which changes nothing
    cut = rows.join(asked, _same(rows, asked)).select(rows["id"], "text", "places")
    cut = materialize(map_batches(cut, _cut(least), "shard int, g long, c long, id long, bit int, words binary"), "cut")
    release(spark)
    cold = cut.where("shard >= 0").select("shard", "g", "c", "id", "words").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    found = map_batches(cold, _match(least), "g long, c long, bits long", 4096)
    windows = cut.where("shard < 0").select("g", "c", "id", "bit", "words")
    firsts = windows.groupBy("words").agg(*known).where(apart).select("words", F.col("low").alias("m"))
    hot = windows.join(firsts, "words").where(_later("id", "m")).groupBy("g", "c").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    found = materialize(found.unionAll(hot), "found")
    release(spark)
    # a context's least document loses what smaller ones hold elsewhere, all others lose the whole context
    every_one = materialize(ones.select("g", "c", F.col("id").alias("m")).join(found, ["g", "c"], "left"), "known")
    every = F.expr("shiftleft(1L, cast(pmod(at, 64) as int)) - 1L")
    bits = F.when(_later("id", "m"), every).otherwise(F.coalesce("bits", F.lit(0).cast("long")))
    lost = again.join(every_one, ["g", "c"]).select("id", "key", "at", bits.alias("bits")).where("bits <> 0")
    lost = materialize(lost.groupBy("id", "key").agg(F.collect_set(F.struct("at", "bits")).alias("places")), "lost")
    release(spark)
    whole = held.join(lost, _same(held, lost), "left_anti").select(F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    cut_down = map_batches(rows.join(lost, _same(rows, lost)).select(rows["id"], "text", "places"), _rewrite(least), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return whole.unionAll(cut_down.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    """One id, a null being like a null, and one text."""
    return a["id"].eqNullSafe(b["id"]) & (a["key"] == b["key"])


def _later(a: str, b: str) -> Column:
    """a comes after b in the order of ids, in which null is last."""
    return F.coalesce(F.col(a) > F.col(b), F.col(a).isNull() & F.col(b).isNotNull())
