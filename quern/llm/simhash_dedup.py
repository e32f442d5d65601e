"""Near-duplicate documents by SimHash: exact links within a Hamming radius through vantage-point trees.

Equal fingerprints are one node. A top tree, built on a bounded sample of fingerprints, deals the nodes to shards by their
Hamming distances to vantage points; a node also visits the shards whose region its radius touches (only those after its
own, as a link needs to be seen once). Each shard holds its members in a vantage-point tree, streams its visitors through
it, prunes branches by the triangle inequality, and emits a spanning forest of the links it has seen instead of all pairs.

At 4 of 64 bits a node visits about 84 % of each half of a tree, so work grows as about the power 1.75 of the nodes.

With `similarity` the same top tree and shards find the nodes (sets of distinct shingles) whose first 64 bits are at most 4
apart. A similarity of 0.8 needs a far wider radius, at which bounds prune nothing between unrelated texts, whose distances
are all nearly the same; what lies beyond the 4 bits is found by min-hashes as well, nodes that agree in a band of them. What
either way connects is a family. Within a family, where distances do spread, a vantage-point tree over 256-bit fingerprints
finds the pairs within the radius, and a link counts only if the exact Jaccard similarity reaches the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import LOWER_BYTES, by_place, map_batches, materialize, mixed, place_of, rehashed, utf8
from quern.llm.components import components

#: Fingerprints that the top tree is fit on, and nodes that a shard should hold at most.
SAMPLE, SHARD_NODES, LEAST_LEVELS = 4096, 1 << 18, 4
#: Nodes of a leaf.
LEAF = 24
#: Bands of min-hashes and rows of a band: sets of similarity 0.8 agree in none by a chance of 3 in a million.
BANDS, ROWS = 24, 4
#: Seeds of the words of a fingerprint.
SEEDS = (42, 0x5EED, 0xC0DE, 0xFACE)
#: Bits of the first word of a fingerprint within which the top tree's shards find members of a family.
NEAR_BITS = 4
#: Nodes and shingles of a block of a family; larger families are verified by pairs of blocks.
FAMILY_NODES, FAMILY_SHINGLES = 1 << 11, 1 << 21
#: Links that a shard holds before it reduces them to a spanning forest.
PAIRS = 1 << 20


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `width` words joined by a blank (fewer words: the whole sequence; none: nothing)."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(np.ascontiguousarray(hashes[a : a + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """SimHash of a text's words after lower-casing A-Z."""
    return simhash(shingle_hashes((text or b"").translate(LOWER_BYTES).split(), width))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    return np.unique(shingle_hashes((text or b"").translate(LOWER_BYTES).split(), width))


def long_simhash(h: np.ndarray, words: int) -> bytes:
    """A fingerprint of several 64-bit words; those after the first mix the hashes with a seed."""
    parts = [simhash(h if k == 0 else mixed(h ^ np.uint64(SEEDS[k]))) for k in range(words)]
    return b"".join(p.to_bytes(8, "little") for p in parts)


#: Fixed numbers that make BANDS * ROWS orders of the hashes' upper halves, which arrays multiply far faster than whole ones.
TURNS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
TURN, SPREAD = (TURNS >> np.uint64(32)).astype(np.uint32)[:, None], (TURNS.astype(np.uint32) | np.uint32(1))[:, None]


def band_keys(h: np.ndarray) -> np.ndarray:
    """A key for each band of a set's min-hashes; sets that agree in a band have its key in common. None of an empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    upper = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(TURNS), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(h), 1 << 11):
        order = upper[None, a : a + (1 << 11)] ^ TURN
        order *= SPREAD
        np.minimum(least, order.min(axis=1), out=least)
    key, least = np.arange(BANDS, dtype=np.uint64), least.astype(np.uint64)
    for row in range(ROWS):
        key = mixed(key ^ least[row::ROWS]) + np.uint64(row)
    return key.view(np.int64)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, words: int = 1, sets: bool = False) -> DataFrame:
    """doc_id, key (a hash of the text), fp (a signed long), code (all words of the fingerprint), size (shingles), bands of every row.

    fp is the fingerprint where it has one word, else a hash of it. With `sets` repeated shingles count once, fp is a hash of
    the set, so that rows of one fp have the same shingles, and bands are its min-hash keys (else none). A null text counts
    as empty and gives 0 bits alone.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, ids, bands = [], np.zeros(b.num_rows, np.uint64), []
            for i, t in enumerate(utf8(b.column(2))):
                h = shingle_set(t, width) if sets else shingle_hashes((t or b"").translate(LOWER_BYTES).split(), width)
                c = long_simhash(h, words)
                ids[i] = xxhash.xxh64_intdigest(h.tobytes()) if sets else int.from_bytes(c, "little") if words == 1 else xxhash.xxh64_intdigest(c)
                made.append((c, len(h)))
                bands.append(band_keys(h) if sets else None)
            columns = [pa.array(ids.view(np.int64)), pa.array([c for c, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch([b.column(0), b.column(1), *columns], ["doc_id", "key", "fp", "code", "size", "bands"])

    return map_batches(rows, run, "doc_id long, key long, fp long, code binary, size long, bands array<long>")


def codes(column: pa.Array, words: int) -> np.ndarray:
    """A column of fingerprints as an array with a row for each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits between fingerprints, whose words are the last axis."""
    d = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int16)
    for k in range(1, x.shape[-1]):
        d += np.bitwise_count(x[..., k] ^ y[..., k])
    return d


class TopTree:
    """The upper levels of a vantage-point tree: deals fingerprints to shards numbered from 0."""

    def __init__(self, sample: np.ndarray, levels: int):
        pivots, radii = [], []  # a heap
        parts = [sample]
        for _ in range(levels):
            below = []
            for x in parts:
                pivot = x[len(x) // 2] if len(x) else np.zeros(sample.shape[1], np.uint64)
                d = distance(x, pivot[None, :])
                radius = int(np.median(d)) if len(x) else 32 * sample.shape[1]
                pivots.append(pivot)
                radii.append(radius)
                below += [x[d <= radius], x[d > radius]]
            parts = below
        self.pivots, self.radii = np.array(pivots, np.uint64), np.array(radii, np.int64)
        self.levels, self.shards = levels, 1 << levels

    def deal(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into fps, shard, is a visitor) of every fingerprint's own shard and of the later ones it must visit."""
        at = np.zeros(len(fps), np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + (distance(fps, self.pivots[at]) > self.radii[at])
        home = at - len(self.radii)
        index, shard, todo = [], [], [(0, np.arange(len(fps)))]
        while todo:
            node, rows = todo.pop()
            if node >= len(self.radii):
                index.append(rows)
                shard.append(np.full(len(rows), node - len(self.radii), np.int64))
                continue
            d, mu = distance(fps[rows], self.pivots[node][None, :]), self.radii[node]
            todo += [(2 * node + 1, rows[d <= mu + radius]), (2 * node + 2, rows[d > mu - radius])]
        index, shard = np.concatenate(index), np.concatenate(shard)
        keep = shard >= home[index]
        index, shard = index[keep], shard[keep]
        return index, shard, shard != home[index]


class VantageTree:
    """A vantage-point tree over the members of a shard, for batches of queries; both carry their node's id."""

    def __init__(self, ids: np.ndarray, members: np.ndarray, radius: int):
        self.ids, self.members, self.radius = ids, members, radius
        # where the radius spans most distances little is pruned, and large leaves cost less
        self.leaf = LEAF if radius <= 6 * members.shape[1] else 512
        self.root = self._build(np.arange(len(members)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        pivot = self.members[rows[len(rows) // 2]]
        d = distance(self.members[rows], pivot[None, :])
        mu = int(np.median(d))
        inner = d <= mu
        if inner.all():
            mu = int(d.max()) - 1
            inner = d <= mu
            if not inner.any() or inner.all():
                return rows
        return (pivot, mu, self._build(rows[inner]), self._build(rows[~inner]))

    def links(self, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (query id, member id) at most `radius` bits apart, a node with itself left out."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if isinstance(node, np.ndarray):
                step = max(1, (1 << 18) // max(1, len(node)))
                for a in range(0, len(q), step):
                    part = q[a : a + step]
                    i, j = np.nonzero(distance(queries[part][:, None, :], self.members[node][None, :, :]) <= self.radius)
                    u, v = ids[part[i]], self.ids[node[j]]
                    other = u != v
                    if other.any():
                        yield u[other], v[other]
                continue
            pivot, mu, inner, outer = node
            d = distance(queries[q], pivot[None, :])
            todo += [(inner, q[d <= mu + self.radius]), (outer, q[d > mu - self.radius])]


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the links connect: (node, least signed node of its component), the latter's own left out."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        if (label == before).all():
            break
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


class Forest:
    """Gathers links, holding a spanning forest and at most PAIRS links beside it."""

    def __init__(self):
        self.u: list[np.ndarray] = []
        self.v: list[np.ndarray] = []
        self.n = self.least = 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.n += len(u)
        if self.n > self.least + PAIRS:
            self.stars()

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, root = spanning(np.concatenate(self.u), np.concatenate(self.v))
        self.u, self.v, self.n, self.least = [x], [root], len(x), len(x)
        return x, root


DEALT = "shard int, visitor boolean, fp long, code binary"


def _by_distance(nodes: DataFrame, radius: int, words: int) -> tuple[DataFrame, int]:
    """Nodes dealt to shards by the top tree, and the number of shards."""
    n = nodes.count()
    levels = max(LEAST_LEVELS, int(np.ceil(np.log2(max(1, n / SHARD_NODES)))))
    sample = nodes.select("code").orderBy(F.xxhash64("code"), "code").limit(SAMPLE).collect()
    sample = np.frombuffer(b"".join(r.code for r in sample), "<u8").reshape(-1, words)
    top = nodes.sparkSession.sparkContext.broadcast(TopTree(sample, levels))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                index, shard, visitor = top.value.deal(codes(b.column(1), words), radius)
                yield pa.record_batch([pa.array(shard.astype(np.int32)), pa.array(visitor), b.column(0).take(pa.array(index)), b.column(1).take(pa.array(index))], ["shard", "visitor", "fp", "code"])

    return map_batches(nodes.select("fp", "code"), deal, DEALT, 1 << 13), 1 << levels


def link_nodes(nodes: DataFrame, radius: int = 4, words: int = 1) -> DataFrame:
    """Links (u, v) of fp that connect the nodes (fp, code) exactly as all pairs within the radius would."""
    dealt, shards = _by_distance(nodes, radius, words)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members, tree, forest = None, [], None, Forest()

        def out() -> Iterator[pa.RecordBatch]:
            u, v = forest.stars()
            for a in range(0, len(u), 1 << 16):
                yield pa.record_batch([pa.array(u[a : a + (1 << 16)]), pa.array(v[a : a + (1 << 16)])], ["u", "v"])

        def grown() -> VantageTree:
            ids = np.concatenate([i for i, _ in members]) if members else np.zeros(0, np.int64)
            own = np.concatenate([c for _, c in members]) if members else np.zeros((0, words), np.uint64)
            t = VantageTree(ids, own, radius)
            for a in range(0, len(own), 1 << 14):
                for pair in t.links(ids[a : a + (1 << 14)], own[a : a + (1 << 14)]):
                    forest.add(*pair)
            return t

        for b in batches:
            shards_of = b.column(0).to_numpy(zero_copy_only=False)
            guests = b.column(1).to_numpy(zero_copy_only=False)
            ids, fps = b.column(2).to_numpy(zero_copy_only=False), codes(b.column(3), words)
            for s in np.unique(shards_of):  # sorted, as the rows are
                if s != shard:
                    if shard is not None:
                        if tree is None:
                            grown()
                        yield from out()
                    shard, members, tree, forest = s, [], None, Forest()
                own, visiting = (shards_of == s) & ~guests, (shards_of == s) & guests
                members.append((ids[own], fps[own]))
                if visiting.any():
                    if tree is None:
                        tree = grown()
                    for pair in tree.links(ids[visiting], fps[visiting]):
                        forest.add(*pair)
        if shard is not None:
            if tree is None:
                grown()
            yield from out()

    held = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "visitor")
    return map_batches(held, link, "u long, v long", 1 << 13)


def similar_pairs(sets: list[np.ndarray], fps: np.ndarray, blocks: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets that connect what all pairs of at least the Jaccard similarity connect, within one block or between two.

    A vantage-point tree over the fingerprints of one block is asked for those of the other (or its own) within the radius.
    A pair that others connect already is not compared.
    """
    sizes = np.array([len(x) for x in sets])
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    low = np.flatnonzero(blocks == blocks.min())
    high = np.flatnonzero(blocks != blocks.min())
    one = not len(high)
    if one:
        high = low
    for u, v in VantageTree(low, fps[low], radius).links(high, fps[high]):
        near = np.minimum(sizes[u], sizes[v]) * (1 + similarity) >= similarity * (sizes[u] + sizes[v]) - 1e-9
        if one:
            near &= u < v
        u, v = u[near], v[near]
        label = {x: root(x) for x in np.union1d(u, v).tolist()}
        apart = np.array([label[x] != label[y] for x, y in zip(u.tolist(), v.tolist(), strict=True)], bool)
        u, v = u[apart], v[apart]
        for k in np.argsort(distance(fps[u], fps[v]), kind="stable").tolist():
            x, y = int(u[k]), int(v[k])
            p, q = root(x), root(y)
            if p == q:
                continue
            both = np.concatenate([sets[x], sets[y]])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if shared * (1 + similarity) >= similarity * len(both) - 1e-9:
                parent[max(p, q)] = min(p, q)
                found.append((x, y))
    return found


def near_links(nodes: DataFrame, radius: int = NEAR_BITS) -> DataFrame:
    """Links (u, v) of fp that connect nodes (fp, code) whose first 64 bits differ by at most `radius`, by link_nodes; equal words are one node there."""
    first = nodes.select("fp", F.substring("code", 1, 8).alias("code"))
    words = materialize(first.groupBy("code").agg(F.min("fp").alias("u"), F.max("fp").alias("most")), "words")
    several = words.where("u < most").select(F.hex("code").alias("word"), "u")
    same = rehashed(first.select("fp", F.hex("code").alias("word")), several, "word").where("fp <> u").select("u", F.col("fp").alias("v"))
    return same.unionAll(link_nodes(words.select(F.col("u").alias("fp"), "code"), radius, 1))


def family_links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) of fp that connect nodes (fp, bands) with a min-hash key in common: each with the least node of a key."""
    keyed = nodes.select("fp", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).where("u < most").select("band", "u")
    return rehashed(keyed, least, "band").where("fp <> u").select("u", F.col("fp").alias("v"))


def verified_links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int, radius: int, words: int, similarity: float) -> DataFrame:
    """Links (u, v) of fp that connect the nodes as all pairs would whose shingle sets have at least the Jaccard similarity.

    Nodes that the top tree's shards or min-hash keys connect form families. A family's texts meet in one task, those of a large
    one in a task for each pair of its blocks, and every link is verified there.
    """
    # two different sets, the larger of n shingles, share n - 1 of n at most
    least = max(1, int(np.ceil(1 / (1 - similarity) - 1e-9)) - 1) if similarity < 1 else 1 << 62
    able = nodes.where(F.col("size") >= least)
    families = components(near_links(able).unionAll(family_links(able))).select(F.col("node").alias("fp"), F.col("label").alias("family"))
    families = materialize(families.join(nodes, "fp").select("fp", "code", "size", "family", F.col("rep.doc_id").alias("_id"), F.col("rep.key").alias("_key")), "families")
    counted = families.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / FAMILY_NODES), F.ceil(F.sum("size") / FAMILY_SHINGLES)).cast("int").alias("parts"))
    large = counted.where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    placed = rehashed(families, large, "family", "left").withColumn("block", F.pmod(F.xxhash64("fp"), parts.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fp", "code", "_id", "_key")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), text_key(text).alias("_text_key"), text.alias("text"))
    met = texts.join(placed, texts["_doc"].eqNullSafe(placed["_id"]) & (texts["_text_key"] == placed["_key"])).select("family", "low", "high", "block", "fp", "code", "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def out() -> pa.RecordBatch:
            ids = np.array(list(held), np.int64)
            blocks, fps, sets = zip(*held.values(), strict=True)
            blocks = np.array(blocks)
            pairs = []
            if now[1] == now[2] or len(np.unique(blocks)) == 2:
                pairs = similar_pairs(list(sets), np.frombuffer(b"".join(fps), "<u8").reshape(-1, words), blocks, radius, similarity)
            return pa.record_batch([pa.array([ids[x] for x, _ in pairs], pa.int64()), pa.array([ids[y] for _, y in pairs], pa.int64())], ["u", "v"])

        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(6)]
            for *place, block, fp, code, t in zip(*columns, utf8(b.column(6)), strict=True):
                if place != now:
                    if held:
                        yield out()
                    now, held = place, {}
                if fp not in held:  # rows that repeat an id and a text
                    held[fp] = (block, code, shingle_set(t, width))
        if held:
            yield out()

    keys = ["family", "low", "high"]
    return map_batches(met.repartition(*keys).sortWithinPartitions(*keys), verify, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, words: int = 1, similarity: float | None = None) -> DataFrame:
    """One row per document: doc_id, key, fp, label (one fingerprint of its component), component_id (the least doc_id that links reach).

    similarity: links are pairs of at least this Jaccard similarity of their distinct shingles; the top tree's shards, min-hashes
    and fingerprints within the radius only find them. A null text counts as empty; documents without words have fingerprint 0, which links like any
    other. A null doc_id takes part but is never a component's id unless all of its ids are null. Repeated rows are all
    returned. Fingerprints that thousands of rows share are one node. Further columns are not read; an empty table gives
    an empty one.
    """
    held = materialize(fingerprints(docs, id_col, text_col, width, words, similarity is not None), "fingerprints")
    # texts of one fingerprint have one size but for rare chances; the larger then stands for both
    rep = [] if similarity is None else [F.min(F.struct("doc_id", "key")).alias("rep"), F.any_value("bands").alias("bands")]
    nodes = materialize(held.groupBy("fp", "code").agg(F.min("doc_id").alias("least"), F.max("size").alias("size"), *rep), "nodes")
    links = link_nodes(nodes, radius, words) if similarity is None else verified_links(docs, nodes, id_col, text_col, width, radius, words, similarity)
    labels = materialize(components(links), "labels")
    linked = labels.join(nodes, labels.node == nodes.fp).select("fp", "label", "least")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = rehashed(linked, least, "label").select("fp", "label", "component_id")
    # nodes that no link touches answer for themselves
    known = nodes.join(linked, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "least").alias("component_id"))
    # written first, so that Spark can split a fingerprint that very many documents share in the join
    return held.join(materialize(known, "known"), "fp").select("doc_id", "key", "fp", "label", "component_id")


#: Words of a fingerprint, bits that candidates may differ by, and the similarity that a link needs. Fingerprints of sets of
#: similarity 0.8 differ by 39 of 256 bits, with a deviation of 6 (sets of 4 and 5 shingles: by 48, deviation 6), so 80 bits
#: lose under one pair in a million; those of unrelated texts differ by 128, with a deviation of 8.
NEAR_WORDS, NEAR_RADIUS, NEAR_SIMILARITY = 4, 80, 0.8


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = NEAR_RADIUS, words: int = NEAR_WORDS, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """One document of each component, that with the least doc_id, with all its columns; a null id stays only where no other is.

    Links join documents of at least the Jaccard similarity of their distinct five-word shingles, verified exactly; the top
    tree's shards, min-hashes and 256-bit fingerprints at most NEAR_RADIUS bits apart find them.
    """
    groups = simhash_groups(docs, id_col, text_col, width, radius, words, similarity)
    first = groups.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    first = first.select(F.col("m.doc_id").alias("first_id"), F.col("m.key").alias("first_key"))
    # the documents' own columns travel in a struct under other names, so that no names can clash
    plain = by_place(docs)
    doc_id, text = (F.col(plain.columns[place_of(docs, c)]) for c in (id_col, text_col))
    rows = plain.select(F.struct(*plain.columns).alias("row"), doc_id.cast("long").alias("id"), text_key(text.cast("string")).alias("key"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
    # rows that repeat an id and a text
    once = Window.partitionBy("id", "key").orderBy("key")
    return kept.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*").toDF(*docs.columns)
