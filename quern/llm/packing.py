"""Best-fit decreasing packing of tokenized documents into windows of a fixed size.

Documents longer than a window are first cut into full windows; the rest of each, and every shorter document, goes whole
into the tightest open window that holds it, longest first. A segment tree indexed by remaining capacity finds that
window. Windows that stay emptier than `slack` tokens are topped up by cutting pieces of the emptiest ones.

Packing runs inside each task over blocks of bounded size, so there is no shuffle and a lost task is simply run again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Powers, map_batches, mixed, tokenizer_path

#: Pieces and tokens that one block gathers before it is packed.
BLOCK_PIECES, BLOCK_TOKENS = 16384, 4 << 20
#: Code points that the array path knows, and the classes of characters.
PLAIN_END = 0x2070
BLANK, LETTER, NUMBER, MARK, ODD = range(5)
#: Characters that one pass of the encoder takes; distinct runs, their characters and tokens that its table holds before it
#: starts anew; bits of its slots.
CHARS_AT_ONCE, MOST_RUNS, MOST_CHARS, SLOT_BITS = 1 << 19, 1 << 21, 1 << 25, 22
#: Sequence ids of a task start at its partition's place times this.
IDS_PER_PARTITION = 1 << 40

POWERS = Powers()


class CapacityTree:
    """Stacks of open windows by remaining capacity, under a segment tree that knows which are not empty."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.size)  # open windows below each node
        self.stacks: dict[int, list[int]] = {}

    def push(self, capacity: int, window: int) -> None:
        self.stacks.setdefault(capacity, []).append(window)
        self._add(capacity, 1)

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.used[i] += n
            i >>= 1

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window with the least capacity of `need` or more, taken out."""
        used, i = self.used, need + self.size
        if not used[i]:
            while i > 1 and (i & 1 or not used[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i <<= 1
                if not used[i]:
                    i += 1
        capacity = i - self.size
        window = self.stacks[capacity].pop()
        self._add(capacity, -1)
        return capacity, window


def pack(lengths: list[int], capacity: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, start in the item, length), for items of 1 to any number of tokens.

    Every token of every item is in exactly one piece. At most one window of the result has over `slack` tokens free.
    """
    windows: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for item, n in enumerate(lengths):
        full = n // capacity
        windows += [[(item, k * capacity, capacity)] for k in range(full)]
        if n % capacity:
            rest.append((item, full * capacity, n % capacity))
    first = len(windows)
    tree = CapacityTree(capacity)
    for piece in sorted(rest, key=lambda p: (-p[2], p[0])):
        found = tree.pop_tightest(piece[2])
        if found is None:
            found = (capacity, len(windows))
            windows.append([])
        windows[found[1]].append(piece)
        if found[0] > piece[2]:
            tree.push(found[0] - piece[2], found[1])
    return windows[:first] + _topped_up(windows[first:], capacity, slack)


def _topped_up(windows: list[list[tuple[int, int, int]]], capacity: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Fill gaps over slack with cuts from the emptiest windows."""
    order = sorted(windows, key=lambda w: -sum(p[2] for p in w))
    free = [capacity - sum(p[2] for p in w) for w in order]
    i, last = 0, len(order) - 1
    while i < last:
        if free[i] <= slack:
            i += 1
            continue
        item, start, n = order[last].pop()
        cut = min(n, free[i])
        order[i].append((item, start, cut))
        free[i] -= cut
        free[last] += cut
        if cut < n:
            order[last].append((item, start + cut, n - cut))
        if not order[last]:
            last -= 1
    return [w for w in order if w]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of each code point below PLAIN_END.

    Class ODD: characters that may act on their neighbours, controls, and scripts whose tables still grow between versions.
    """
    kind, lower = np.full(PLAIN_END + 1, ODD, np.uint8), np.zeros(PLAIN_END + 1, np.uint32)
    for cp in range(PLAIN_END):
        c = chr(cp)
        low, group = c.lower(), unicodedata.category(c)
        lower[cp] = ord(low[0])
        joins = group[0] == "M" or 0x1100 <= cp < 0x1200 or cp == 0x3A3 or len(low) > 1 or unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFC", low) != low
        blank = c in "\t\n\r \xa0"
        if joins or group[0] in "CZ" and not blank or 0x250 <= cp < 0x2010 and not (0x391 <= cp <= 0x3C9 or 0x410 <= cp <= 0x44F):
            continue
        kind[cp] = BLANK if blank else LETTER if group[0] == "L" else NUMBER if group[0] == "N" else MARK
    return kind, lower


class WordEncoder:
    """Token ids of whole texts by a byte-pair tokenizer that first lowers case and cuts texts into letters, digits and marks.

    Such a tokenizer encodes each run of letters, each digit, each run of other marks and each English contraction on its
    own, and ends it with a token of its own kind. Texts are cut the same way with arrays; runs are looked up by a 64-bit
    hash in a table of those seen, whose characters must then be the same, and only new ones go through the tokenizer.
    Texts with characters outside PLAIN_END, or that combine with neighbours, or with the tokenizer's own marks, are encoded
    by the tokenizer whole, and so are those with a run that shares its hash with a different one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.lower = _tables()
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(1 << 16, np.uint64)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, "<u4")
        self.chars = np.zeros(1 << 18, np.uint16)  # the runs themselves; PLAIN_END fits
        self.char_start = np.zeros(1 << 16, np.int64)
        self.char_length = np.zeros(1 << 16, np.int64)
        self.n = self.used = self.char_used = 0
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null text counts as empty. Long texts are encoded piece by piece, cut before blanks."""
        out = self._encode_at_once([t if t and len(t) <= CHARS_AT_ONCE else None for t in texts])
        for i, t in enumerate(texts):
            if t and len(t) > CHARS_AT_ONCE:
                out[i] = b"".join([self._encode_at_once([part])[0] for part in cut_at_blanks(t, CHARS_AT_ONCE)])
        return out

    def _encode_at_once(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        some, size = [], 0
        for i, t in enumerate(texts):
            if t:
                some.append(i)
                size += len(t) + 1
            if size > CHARS_AT_ONCE or some and i == len(texts) - 1:
                self._encode(texts, some, out)
                some, size = [], 0
        if some:
            self._encode(texts, some, out)
        return out

    def _encode(self, texts: list[str], rows: list[int], out: list[bytes]) -> None:
        codes = np.frombuffer(("\n".join([texts[i] for i in rows]) + "\n").encode("utf-32-le"), "<u4")
        at = np.minimum(codes, PLAIN_END)
        kind = self.kind[at]
        stops = np.cumsum([len(texts[i]) + 1 for i in rows])
        odd = np.unique(np.searchsorted(stops, np.flatnonzero(kind == ODD), side="right")).tolist()
        odd = sorted({*odd, *(k for k, i in enumerate(rows) if any(m in texts[i] for m in self.marks))})
        whole = dict(zip(odd, self.tokenizer.encode_batch_fast([texts[rows[k]] for k in odd], add_special_tokens=False), strict=True)) if odd else {}
        for k in odd:
            kind[stops[k] - len(texts[rows[k]]) - 1 : stops[k]] = BLANK
        low = self.lower[at]
        opens = np.empty(len(kind), bool)
        opens[0] = True
        np.not_equal(kind[1:], kind[:-1], out=opens[1:])
        opens |= kind == NUMBER
        self._contractions(low, kind, opens)
        opens &= kind != BLANK
        # a run ends where the next opens or a blank stands
        first = np.flatnonzero(opens)
        edge = np.flatnonzero(opens | (kind == BLANK))
        last = edge[np.searchsorted(edge, first) + 1]
        up, down = POWERS(len(codes))
        h = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(low * up[: len(codes)], out=h[1:])
        key = mixed((h[last] - h[first]) * down[first] + (last - first).astype(np.uint64))
        found = self._find(key)
        gone = np.flatnonzero(found < 0)
        if len(gone):
            if not self._learn(low, key, first, last, gone):  # never seen; the tokenizer itself decides then
                for i, e in zip(rows, self.tokenizer.encode_batch_fast([texts[i] for i in rows], add_special_tokens=False), strict=True):
                    out[i] = np.array(e.ids, "<u4").tobytes()
                return
            found = self._find(key)
        other = self._others(low[kind != BLANK], last - first, found)
        if len(other):
            for k in np.unique(np.searchsorted(stops, first[other], side="right")).tolist():
                whole[k] = self.tokenizer.encode(texts[rows[k]], add_special_tokens=False)
        count, begin = self.length[found], self.start[found]
        stop = np.cumsum(count)
        ids = self.pool[np.repeat(begin - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)]
        ends = np.concatenate([[0], stop])[np.searchsorted(first, stops)]
        a = 0
        for k, (i, b) in enumerate(zip(rows, ends.tolist(), strict=True)):
            out[i] = np.array(whole[k].ids, "<u4").tobytes() if k in whole else ids[a:b].tobytes()
            a = b

    @staticmethod
    def _contractions(low: np.ndarray, kind: np.ndarray, opens: np.ndarray) -> None:
        """Let 's 't 're 've 'm 'll 'd be runs of their own where the apostrophe opens its run and letters follow."""
        for i in np.flatnonzero((low[:-1] == 0x27) & opens[:-1] & (kind[1:] == LETTER)).tolist():
            after = "".join(map(chr, low[i + 1 : i + 3].tolist()))
            n = 1 if after[0] in "stmd" else 2 if after in ("re", "ve", "ll") else 0
            if n:
                opens[i + 1] = False
                opens[i + 1 + n] = True

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for those that are new."""
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        place = self.slots[slot].astype(np.int64)
        wrong = np.flatnonzero((place >= 0) & (self.keys[place] != key))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << SLOT_BITS) - 1)
            place[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(place[wrong] >= 0) & (self.keys[place[wrong]] != key[wrong])]
        return place

    def _others(self, chars: np.ndarray, size: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The runs that are not, character by character, those that the table holds under their hashes. chars: of all runs, in order."""
        wrong = size != self.char_length[found]
        stop = np.cumsum(size)
        # a wrong size reads some other characters, within the table
        held = np.repeat((np.where(wrong, 0, self.char_start[found]) - stop + size).astype(np.int32), size)
        held += np.arange(len(chars), dtype=np.int32)
        differ = chars != self.chars[np.minimum(held, len(self.chars) - 1, out=held)]
        if differ.any():
            wrong[np.searchsorted(stop, np.flatnonzero(differ), side="right")] = True
        return np.flatnonzero(wrong)

    def _learn(self, low: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray, gone: np.ndarray) -> bool:
        """Put the new runs into the table; False if they are too many, or the tokenizer cuts them otherwise than expected."""
        new, where = np.unique(key[gone], return_index=True)
        rows = gone[where]
        if self.n + len(new) > MOST_RUNS or self.char_used + int((last[rows] - first[rows]).sum()) > MOST_CHARS:
            self._reset()
            new, rows = np.unique(key, return_index=True)
            if len(new) > MOST_RUNS or int((last[rows] - first[rows]).sum()) > MOST_CHARS:
                return False
        made = []
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            text = " ".join([low[x:y].tobytes().decode("utf-32-le") for x, y in zip(first[part].tolist(), last[part].tolist(), strict=True)])
            made.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))
        ids = np.concatenate(made)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(rows):
            return False
        n, used = self.n + len(new), self.used + len(ids)
        size = last[rows] - first[rows]
        ends = np.cumsum(size)
        chars = self.char_used + (int(ends[-1]) if len(ends) else 0)
        while len(self.keys) < n:
            self.keys, self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.start, self.length))
            self.char_start, self.char_length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.char_start, self.char_length))
        while len(self.pool) < used:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.chars) < chars:
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.chars[self.char_used : chars] = low[np.repeat(first[rows] - ends + size, size) + np.arange(chars - self.char_used)]
        place = np.arange(self.n, n)
        self.char_start[place] = self.char_used + ends - size
        self.char_length[place] = size
        self.char_used = chars
        self.keys[place] = new
        self.start[place] = self.used + np.concatenate([[0], stop[:-1]])
        self.length[place] = np.diff(stop, prepend=0)
        self.pool[self.used : used] = ids
        self.n, self.used = n, used
        slot = (new >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(place):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = place[free]
            lost = self.slots[slot] != place
            place, slot = place[lost], (slot[lost] + 1) & ((1 << SLOT_BITS) - 1)
        return True


def cut_at_blanks(text: str, most: int) -> Iterator[str]:
    """The text in parts of at most `most` characters that start with a blank, but for the first; a part without blanks stays whole.

    Blanks open no run and end every one, and neither composition nor case looks past them, so parts encode as the whole does.
    """
    a = 0
    while len(text) - a > most:
        b = max(text.rfind(" ", a + 1, a + most), text.rfind("\n", a + 1, a + most))
        if b < 0:
            b = min((x for x in (text.find(" ", a + most), text.find("\n", a + most)) if x >= 0), default=len(text))
        yield text[a:b]
        a = b
    if a < len(text):
        yield text[a:]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its table lasts over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, window: int = 2048, slack: int = 16) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `window` tokens.

    One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens
    (with the closing end_id), sequence_id and offset, gapless from 0 in a sequence. tokenizer: a file of the tokenizers
    library whose pre-tokenizer drops white space; by default the public word_bpe_49k.json. A null or empty text is its
    end_id alone. Null and repeated ids are packed row by row; further columns are not read; an empty table has no pieces.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def emit(block: list[tuple[int | None, bytes]], sequence: int) -> Iterator[pa.RecordBatch | int]:
        made, out = pack([len(x) // 4 for _, x in block], window, slack), []
        for w in made:
            at = 0
            for item, start, n in w:
                doc, data = block[item]
                out.append((doc, start, n, data[4 * start : 4 * (start + n)], len(data) // 4, sequence, at))
                at += n
            sequence += 1
        for a in range(0, len(out), 1024):
            columns = zip(*out[a : a + 1024], strict=True)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)
        yield sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, tokens = encoder(path), [], 0
        sequence = TaskContext.get().partitionId() * IDS_PER_PARTITION
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), words.encode(b.column(1).to_pylist()), strict=True):
                data += end
                block.append((doc, data))
                tokens += len(data) // 4
                if len(block) >= BLOCK_PIECES or tokens >= BLOCK_TOKENS:
                    for x in emit(block, sequence):
                        if isinstance(x, int):
                            sequence = x
                        else:
                            yield x
                    block, tokens = [], 0
        if block:
            yield from (x for x in emit(block, sequence) if not isinstance(x, int))

    return map_batches(rows, run, SCHEMA)
