"""Graphs as edge lists: pieces after cuts, and hashes of neighbourhoods."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.sampling import mark
from quern.storage import materialize


#: Pieces that are held before they are counted, and rows of an output batch.
PIECES, BATCH = 1 << 16, 1 << 16


def cut_pieces(weights: list[int], edges: list[tuple[int, int]]) -> Counter:
    """Weight -> number of ways: each connected graph as it is, and both pieces of every cut of one edge, or of two edges of a ring, that parts it.

    An edge's label says which cycles of a depth-first tree's basis hold it: the exclusive or of 128 random bits for each edge
    outside the tree (different sets of cycles share a label by a chance of 2**-128). Without cycles an edge alone parts the graph; two edges do together exactly if their labels are equal, and then every ring that
    holds one holds the other. Such edges lie on one path down the tree, so pieces are differences of subtrees' weights, and
    work follows the edges and the cuts. Loops and repeated edges are rings of their own.
    """
    n = len(weights)
    around: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(edges):
        around[a].append((b, k))
        if a != b:
            around[b].append((a, k))
    depth, parent, label = [-1] * n, [(-1, -1)] * n, [0] * n  # label: of the edge to the parent
    total, found = list(weights), Counter()
    bits = Random(0)
    for root in range(n):
        if depth[root] >= 0:
            continue
        depth[root], order, stack = 0, [root], [(root, iter(around[root]))]
        alone: dict[int, None] = {}  # labels of the edges outside the tree
        while stack:
            x, rest = stack[-1]
            for y, k in rest:
                if k == parent[x][1]:
                    continue
                if depth[y] < 0:
                    depth[y], parent[y] = depth[x] + 1, (x, k)
                    order.append(y)
                    stack.append((y, iter(around[y])))
                    break
                if depth[y] < depth[x]:
                    bit = bits.getrandbits(128)
                    label[x] ^= bit
                    label[y] ^= bit
                    alone[bit] = None
            else:
                stack.pop()
        below: dict[int, list[int]] = defaultdict(list)  # label -> weights under its tree edges, deepest first
        for x in reversed(order[1:]):
            p = parent[x][0]
            total[p] += total[x]
            label[p] ^= label[x]
            below[label[x]].append(total[x])
        whole = total[root]
        found[whole] += 1
        for piece in below.pop(0, ()):
            found[piece] += 1
            found[whole - piece] += 1
        parts, held = [], 0

        def count() -> None:
            if parts:
                pieces, times = np.unique(np.concatenate(parts), return_counts=True)
                for weight, n in zip(pieces.tolist(), times.tolist(), strict=True):
                    found[weight] += n
                    found[whole - weight] += n  # noqa: B023

        for key, pieces in below.items():
            under = np.array(sorted(pieces) if min(weights) >= 0 else pieces, np.int64)
            ends = np.append(under, whole) if key in alone else under  # with the edge outside the tree, the piece below is cut off
            for k in range(1, len(ends)):
                parts.append(ends[k] - under[:k] if k < len(under) else under)
                held += k
                if held >= PIECES:
                    count()
                    parts, held = [], 0
        count()
    return found


def fragments(nodes: DataFrame, edges: DataFrame, graph: str, node: str, weight: str, a: str, b: str) -> DataFrame:
    """graph, weight, ways: how often each weight arises as a whole connected graph or as a piece of a cut (see cut_pieces).

    nodes: graph, node, weight (a whole number, such as thousandths; null: 0); edges: graph and two of its nodes; edges to
    unknown nodes, and rows without a graph or node, don't count; repeated nodes count once, with the least weight. A graph is
    worked on by one task, in time and memory by its edges and by the squares of its rings; the counts of all graphs combine
    before the shuffle.
    """
    kind = nodes.schema[graph].dataType.simpleString()
    own = nodes.where(F.col(graph).isNotNull() & F.col(node).isNotNull()).groupBy(graph, node).agg(F.min(F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long"))).alias("_w"))
    lists = own.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct(F.col(node).alias("node"), F.col("_w").alias("w")))).alias("nodes"))
    links = edges.groupBy(graph).agg(F.array_sort(F.collect_list(F.struct(F.col(a).alias("a"), F.col(b).alias("b")))).alias("edges"))
    both = lists.join(links, graph, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0)
            graphs, weights, ways = [], [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([names.take(pa.array(graphs, pa.int64())), pa.array(weights, pa.int64()), pa.array(ways, pa.int64())], names=[graph, "weight", "ways"])  # noqa: B023

            lists = [b.column(k).to_pylist() for k in range(1, 5)]
            for i, (held, heavy, left, right) in enumerate(zip(*lists, strict=True)):
                place = {x: k for k, x in enumerate(held)}
                known = [(place[x], place[y]) for x, y in zip(left or (), right or (), strict=True) if x in place and y in place]
                made = sorted(cut_pieces(heavy, known).items())
                graphs += [i] * len(made)
                weights += [w for w, _ in made]
                ways += [n for _, n in made]
                if len(graphs) >= BATCH:
                    yield out()
                    graphs, weights, ways = [], [], []
            yield out()

    flat = lambda c, *names: [F.col(f"{c}.{n}").alias(f"_{n}") for n in names]
    return both.select(graph, *flat("nodes", "node", "w"), *flat("edges", "a", "b")).mapInArrow(cut, f"{graph} {kind}, weight long, ways long")


def neighbourhood_hashes(nodes: DataFrame, edges: DataFrame, graph: str, node: str, label: str, a: str, b: str, bond: str, radius: int) -> DataFrame:
    """graph, node, radius, hash (hexadecimal): a node's label with all that lies within 0 to `radius` steps.

    A node's next hash is over the radius, its own hash and the sum of marks of its neighbours' (bond, hash). A sum has no
    order, so it combines before the shuffle, and hubs gather numbers instead of lists. Edges are undirected and may repeat,
    each counting; nodes without edges keep hashing themselves; null labels and bonds are empty. Each radius is written.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    both = edges.select(graph, F.col(a).alias("_a"), F.col(b).alias("_b"), text(bond).alias("_bond"))
    both = both.unionAll(both.select(graph, F.col("_b"), F.col("_a"), "_bond"))
    now = materialize(nodes.groupBy(graph, node).agg(F.md5(F.min(text(label))).alias("hash")), "hashes")
    out = now.select(graph, node, F.lit(0).alias("radius"), "hash")
    for r in range(1, radius + 1):
        seen = both.join(now.select(graph, F.col(node).alias("_b"), F.col("hash").alias("_h")), [graph, "_b"])
        # marks have 52 bits: sums of halves fit longs, which are added far faster than wide decimals
        m = seen.select(graph, F.col("_a").alias(node), mark(F.concat_ws("/", "_bond", "_h"), r).alias("_m"))
        sums = m.groupBy(graph, node).agg(F.sum(F.shiftright("_m", 26)).alias("_high"), F.sum(F.col("_m").bitwiseAND((1 << 26) - 1)).alias("_low"))
        whole = F.col("_high").cast("decimal(20,0)") * F.lit(1 << 26).cast("decimal(8,0)") + F.col("_low")
        around = F.coalesce(whole.cast("decimal(38,0)"), F.lit(0)).cast("string")
        now = materialize(now.join(sums, [graph, node], "left").select(graph, node, F.md5(F.concat_ws(":", F.lit(str(r)), "hash", around)).alias("hash")), "hashes")
        out = out.unionAll(now.select(graph, node, F.lit(r).alias("radius"), "hash"))
    return out


def folded_bits(hashes: DataFrame, graph: str, n_bits: int) -> DataFrame:
    """graph, bits: the sorted distinct places below n_bits of a graph's hashes; at most n_bits numbers a graph."""
    bit = (F.conv(F.substring("hash", 1, 13), 16, 10).cast("long") % n_bits).cast("int").alias("_bit")
    return hashes.select(graph, bit).distinct().groupBy(graph).agg(F.array_sort(F.collect_list("_bit")).alias("bits"))
