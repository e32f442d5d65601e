"""Byte-level BPE through a sentencepiece model that is written straight from a rank file, and decoding by the inverse mapping.

Byte b stands in the model as the character 256 + b, a token as the string of its bytes' characters, scored by its negative
rank; normalisation is the identity. sentencepiece then merges the best-scored pair first, the leftmost of equals, which is what
ranks ask for.
"""

from __future__ import annotations

import base64
import itertools
import re
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_batches, tokenizer_path

#: Pre-tokens that are looked up at once, bytes that sentencepiece gets in one string, characters that are split at once, and
#: strings that a worker remembers.
CHUNK = 1 << 16
WINDOW = 1 << 15
WHOLE = 1 << 20
REMEMBERED = 1 << 18


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank a line), by rank; ranks are gapless and hold all single bytes."""
    with open(path, "rb") as f:
        held = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    tokens = [held[k] for k in range(len(held))]
    if not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError(f"{path} lacks single bytes")
    return tokens


def mapped(data: bytes) -> str:
    return (np.frombuffer(data, np.uint8).astype("<u2") + 256).tobytes().decode("utf-16-le")


def unmapped(text: str) -> bytes:
    return (np.frombuffer(text.encode("utf-16-le"), "<u2") - 256).astype(np.uint8).tobytes()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose ids are the tokens' ranks; the id after them is the unknown piece, which never arises."""
    normal, unknown = 1, 2
    pieces = [_field(1, mapped(t).encode()) + _field(2, -float(rank)) + _field(3, normal) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


def _ranges(points: np.ndarray) -> str:
    """Code points as the inside of a character class."""
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1) if len(points) else []
    return "".join(rf"\U{int(r[0]):08x}-\U{int(r[-1]):08x}" for r in runs)


class Splitter:
    """Matches of a tiktoken pattern. Its engine knows other Unicode tables than the regex module, so letters and digits on
    which the two differ are asked of it once; texts that hold any of them are split by classes mended accordingly."""

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        singles = {bytes([b]): b for b in range(256)}
        odd, mended = set(), pattern
        for name in (r"\p{L}", r"\p{N}"):
            asked = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=singles, special_tokens={})
            theirs = set(map(ord, bytes(asked.encode_ordinary(every)).decode()))
            ours = {ord(c) for c in regex.findall(name, every)}
            more, less = (_ranges(np.array(sorted(x))) for x in (theirs - ours, ours - theirs))
            odd |= theirs ^ ours
            mended = mended.replace(name, f"[{name}{more}--[{less}]]" if less else f"[{name}{more}]")
        self.plain, self.mended = regex.compile(pattern), regex.compile(mended, regex.V1)
        self.odd = regex.compile(f"[{_ranges(np.array(sorted(odd)))}]") if odd else None
        self.high = re.compile(f"[{chr(min(odd))}-\U0010ffff]") if odd else None

    def __call__(self, text: str) -> Iterator[str]:
        chosen = self.mended if self.odd and self.high.search(text) and self.odd.search(text) else self.plain
        return iter(chosen.findall(text)) if len(text) < WHOLE else (m.group() for m in chosen.finditer(text))


class Codec:
    def __init__(self, path: str, pattern: str):
        import sentencepiece

        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        self.whole = {t: rank.to_bytes(4, sys.byteorder) for rank, t in enumerate(tokens)}
        self.data = [unmapped(self.model.id_to_piece(k)) for k in range(len(tokens))]
        self.longest = max(map(len, tokens))
        self.split = Splitter(pattern)
        self.seen: dict[str, bytes] = {}  # a pre-token's ids, four bytes each

    def _merge(self, data: bytes) -> list[int]:
        return self.model.encode(mapped(data))

    def _long(self, data: bytes) -> list[int]:
        """A pre-token beyond WINDOW bytes, window by window: a sequence of tokens is what merging makes exactly if each two
        neighbours are what merging makes of their bytes, so windows may be cut after a token that the next window's first may follow."""
        out, at, size = [], 0, WINDOW
        ids = self._merge(data[:size])
        while at + size < len(data):
            k = len(ids)
            while k := max(k - 8, 0):
                start = at + sum(len(self.data[i]) for i in ids[:k])
                following = self._merge(data[start : start + size])
                pair = [ids[k - 1], following[0]]
                if self._merge(self.data[pair[0]] + self.data[pair[1]]) == pair:
                    break
            if k:
                out += ids[:k]
                at, ids = start, following
            else:
                size *= 2
                ids = self._merge(data[at : at + size])
        return out + ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; pre-tokens that are tokens themselves are theirs, others are merged, each distinct one once."""
        out, words = [], self.split(text)
        while chunk := list(itertools.islice(words, CHUNK)):
            fresh = set(chunk).difference(self.seen)
            if len(self.seen) + len(fresh) > REMEMBERED:
                self.seen, fresh = {}, set(chunk)
            long, short = {}, []
            for w in fresh:
                data = w.encode()
                if (own := self.whole.get(data)) is not None:
                    self.seen[w] = own
                elif len(data) > WINDOW:
                    long[w] = array("i", self._long(data)).tobytes()
                else:
                    short.append((w, data))
            for a in range(0, len(short), 1024):
                part = short[a : a + 1024]
                at, whole = list(itertools.accumulate((len(d) for _, d in part), initial=0)), mapped(b"".join([d for _, d in part]))
                ids = self.model.encode([whole[x:y] for x, y in itertools.pairwise(at)], num_threads=1)
                self.seen.update((w, array("i", x).tobytes()) for (w, _), x in zip(part, ids, strict=True))
            known = self.seen | long if long else self.seen
            out.append(b"".join(map(known.__getitem__, chunk)))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids; an id beyond the vocabulary is an error."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.data):
            raise ValueError("ids beyond the vocabulary")
        return b"".join(b"".join([self.data[i] for i in ids[a : a + CHUNK].tolist()]) for a in range(0, len(ids), CHUNK))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _defaults(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return ranks or tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row: ids of the whole text, array<int>, as tiktoken's encode_ordinary gives them.

    ranks: a tiktoken rank file, by default the public byte_bpe_multi_50k; pattern splits texts into pre-tokens. A null or empty
    text has no ids, null and repeated doc_ids stay row by row, further columns are not read, an empty table stays empty. A text
    is worked on in chunks of pre-tokens and long pre-tokens in windows, so memory follows one batch of at most 8 MB or one text.
    """
    path, split = _defaults(ranks, pattern)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split)
        for b in batches:
            ids = [own.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], names=["doc_id", "ids"])

    return map_batches(rows, run, "doc_id long, ids array<int>", most_bytes=8 << 20)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def decode_documents(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, data): the bytes that the ids of each row of (doc_id, ids) stand for; null ids have null bytes."""
    path, split = _defaults(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split)
        for b in batches:
            data = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, data binary", most_bytes=8 << 20)
