"""Ranking by gradient-boosted trees: rank-aware gradients, quantile bins, leaf-wise trees grown from histograms.

Rows never leave the executors. They are packed once into blocks of whole queries; a round's blocks (bins, scores, gradients)
are one written table. What reaches the driver are histograms of whole-number gradients by node, feature and bin, whose sums
don't depend on how rows are partitioned. Tables with a query too long for a block stay rows, ranked by windows that spill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import evaluate, learn
from quern.operators.rank import sorted_positions
from quern.operators.sampling import mark, uniform
from quern.storage import materialize

#: Gradients are whole multiples of 1/SCALE; their sums stay whole up to 10**11 rows.
SCALE = 1 << 26
#: Rows that a block gathers, and rows of the longest query that is packed at all.
BLOCK_ROWS, QUERY_ROWS = 1 << 16, 1 << 18


def bin_edges(df: DataFrame, feature: str, most: int) -> list[float]:
    """Upper ends of at most `most` bins: every distinct value if these are few, else the values at equal shares of the sorted rows and the largest.

    As many values as bins reach the driver. Nulls and NaN don't count.
    """
    values = df.select(F.col(feature).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    few = [r.x for r in values.distinct().limit(most + 1).collect()]
    if len(few) <= most:
        return sorted(few)
    placed = materialize(sorted_positions(values, ["x"], ["x"]), "placed")
    n = placed.agg(F.max("n")).first()[0]
    places = sorted({max(1, k * n // most) for k in range(1, most + 1)} | {n})
    return sorted({r.x for r in placed.where(F.col("n").isin(places)).select("x").distinct().collect()})


def binned(df: DataFrame, edges: dict[str, list[float]]) -> Column:
    """array<smallint>: for each feature the first bin whose upper end is not below the value, the last one beyond; nulls and NaN: 0."""
    sent = df.sparkSession.sparkContext.broadcast([np.array(e or [0.0]) for e in edges.values()])

    @F.pandas_udf("array<smallint>")
    def bins(*columns: pd.Series) -> pd.Series:
        made = []
        for c, e in zip(columns, sent.value, strict=True):
            x = c.astype(float).to_numpy()
            made.append(np.where(np.isnan(x), 0, np.minimum(np.searchsorted(e, x), len(e) - 1)))
        return pd.Series(list(np.column_stack(made).astype(np.int16)))

    return bins(*[F.col(f).cast("double") for f in edges])


def gradients(rows: DataFrame, metric: str, sigma: float, normalize: bool) -> DataFrame:
    """rows (q, item, truth, w, used, score, ...) with g and h, whole multiples of 1/SCALE: pulls and curvatures of pairs with the truth.

    A pair's weight is what a swap of its two ranks would change in 1 / rank (mrr) or 1 / log2(1 + rank) (ndcg). Queries that
    are not used, lack a truth or weigh nothing get zeros. Pairs grow with the candidates, not with their square.
    """
    own = Window.partitionBy("q")
    gain = 1.0 / F.col("_r") if metric == "mrr" else 1.0 / F.log2(1.0 + F.col("_r"))
    ranked = rows.withColumn("_r", F.row_number().over(own.orderBy(F.col("score").desc(), "item"))).withColumn("_gain", gain)
    first = F.max(F.when(F.col("truth"), F.struct("score", "_gain"))).over(own)
    pairs = ranked.withColumn("_t", first).withColumn("_rho", F.coalesce(1 / (1 + F.exp(sigma * (F.col("_t.score") - F.col("score")))), F.lit(0.0)))
    swap = F.when(F.col("truth") | F.col("_t").isNull() | ~F.col("used"), 0.0).otherwise(sigma * F.abs(F.col("_t._gain") - F.col("_gain")))
    pairs = pairs.withColumn("_l", swap * F.col("_rho")).withColumn("_h", sigma * swap * F.col("_rho") * (1 - F.col("_rho")))
    pairs = pairs.withColumn("_sum", F.sum("_l").over(own)).withColumn("_sum_h", F.sum("_h").over(own))
    factor = F.col("w") * (F.when(F.col("_sum") > 0, F.log2(1 + 2 * F.col("_sum")) / (2 * F.col("_sum"))).otherwise(1.0) if normalize else F.lit(1.0))
    whole = lambda x: F.round(x * factor * SCALE).cast("long")
    g, h = F.when(F.col("truth"), F.col("_sum")).otherwise(-F.col("_l")), F.when(F.col("truth"), F.col("_sum_h")).otherwise(F.col("_h"))
    return pairs.select(*rows.columns, whole(g).alias("g"), whole(h).alias("h"))


BLOCK = "counts binary, names array<string>, truth binary, w binary, held binary, score binary, bins binary, g binary, h binary, used binary, gained double, held_weight double"


def packed(rows: DataFrame, names: bool) -> DataFrame:
    """rows (q, item, truth, w, held, score, bins) as blocks of whole queries, items in order, so that ties of scores need no item."""
    columns = [F.col("q").cast("string").alias("name") if names else F.lit(None).cast("string").alias("name"), "q", "truth", "w", "held", "score", "bins"]
    dealt = rows.repartition("q").sortWithinPartitions("q", "item").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def starts(table: pa.Table) -> np.ndarray:
            keys = table.column(1).combine_chunks().dictionary_encode(null_encoding="encode")
            return np.flatnonzero(np.diff(keys.indices.to_numpy(), prepend=-1))

        def block(table: pa.Table) -> pa.RecordBatch:
            at = starts(table)
            truth, held_out = (table.column(k).to_numpy().astype(np.uint8) for k in (2, 4))
            bins = _bins_of(table.column(6).combine_chunks(), table.num_rows)
            sent = [np.diff(at, append=table.num_rows).astype(np.int32), truth, table.column(3).to_numpy(), held_out, table.column(5).to_numpy(), np.ascontiguousarray(bins.T)]
            counts, *rest = [pa.array([x.tobytes()], pa.binary()) for x in sent]
            q = pa.array([table.column(0).take(pa.array(at)).to_pylist() if names else []], pa.list_(pa.string()))
            empty = [pa.array([b""], pa.binary())] * 3 + [pa.array([0.0])] * 2
            return pa.RecordBatch.from_arrays([counts, q, *rest, *empty], names=_BLOCK_NAMES)

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                cut = int(starts(table)[-1])  # the last query may go on
                if cut:
                    yield block(table[:cut])
                    held = table[cut:].to_batches()
                    n = sum(x.num_rows for x in held)
        if held:
            yield block(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, BLOCK)


_BLOCK_NAMES = [x.split(" ")[0] for x in BLOCK.split(", ")]


def block_gradients(counts: np.ndarray, truth: np.ndarray, w: np.ndarray, score: np.ndarray, used: np.ndarray, metric: str, sigma: float, normalize: bool) -> tuple[np.ndarray, np.ndarray]:
    """g and h of the rows of whole queries, items in order: what gradients() gives."""
    starts, query = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((-score, query))  # stable
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score)) - np.repeat(starts, counts) + 1
    gain = 1.0 / rank if metric == "mrr" else 1.0 / np.log2(1.0 + rank)
    # the best of the true rows of a query
    at = order[truth[order]]
    known, first = np.unique(query[at], return_index=True)
    best = np.full(len(counts), -1)
    best[known] = at[first]
    of = best[query]
    with np.errstate(over="ignore"):
        rho = 1 / (1 + np.exp(sigma * (score[of] - score)))
    swap = np.where(truth | (of < 0) | ~used, 0.0, sigma * np.abs(gain[of] - gain))
    pull, bend = swap * rho, sigma * swap * rho * (1 - rho)
    total, total_h = np.add.reduceat(pull, starts), np.add.reduceat(bend, starts)
    factor = w
    if normalize:
        some = np.where(total > 0, total, 1.0)
        factor = w * np.where(total > 0, np.log2(1 + 2 * some) / (2 * some), 1.0)[query]
    g, h = np.where(truth, total[query], -pull), np.where(truth, total_h[query], bend)
    return np.rint(g * factor * SCALE).astype(np.int64), np.rint(h * factor * SCALE).astype(np.int64)


def block_standing(counts: np.ndarray, truth: np.ndarray, w: np.ndarray, score: np.ndarray) -> tuple[float, float]:
    """The weighted sum of reciprocal ranks up to 25 over whole queries, ties averaged, and the sum of the weights."""
    if not len(counts):
        return 0.0, 0.0
    starts, query = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    own = np.maximum.reduceat(np.where(truth, score, -np.inf), starts)
    known = np.maximum.reduceat(truth, starts)
    better = np.add.reduceat((score > own[query]).astype(np.int64), starts)
    tied = np.add.reduceat((score == own[query]).astype(np.int64), starts) - 1
    weight = np.maximum.reduceat(w, starts)
    value = np.where(known & (better < 25), 1.0 / (better + 1 + np.where(known, tied, 0) / 2), 0.0)
    return float(weight @ value), float(weight.sum())


def next_blocks(blocks: DataFrame, tree: tuple[list, list[float]] | None, bag: Column | None, metric: str, sigma: float, normalize: bool) -> DataFrame:
    """Blocks after one more tree: scores, gradients and the held-out queries' standing. bag: which names take part (none: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                counts = np.frombuffer(row["counts"], np.int32)
                truth, held = (np.frombuffer(row[c], np.uint8).astype(bool) for c in ("truth", "held"))
                w, score = np.frombuffer(row["w"]), np.frombuffer(row["score"])
                if tree:
                    score = score + np.array(tree[1])[walked(np.frombuffer(row["bins"], np.int16).reshape(-1, len(score)).T, tree[0])]
                used = ~held & (w > 0)
                if row["bag"] is not None:
                    used &= np.repeat(np.array(row["bag"], bool), counts)
                g, h = block_gradients(counts, truth, w, score, used, metric, sigma, normalize)
                mine = np.add.reduceat(held.astype(np.int32), np.cumsum(counts) - counts)
                gained, weight = block_standing(mine[mine > 0], truth[held], w[held], score[held])
                row |= {"score": score.tobytes(), "g": g.tobytes(), "h": h.tobytes(), "used": used.tobytes(), "gained": gained, "held_weight": weight}
                made = [pa.array([row[c]], t) for c, t in zip(_BLOCK_NAMES, [pa.binary(), pa.list_(pa.string()), *[pa.binary()] * 8, pa.float64(), pa.float64()], strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=_BLOCK_NAMES)

    return blocks.withColumn("bag", F.lit(None).cast("array<boolean>") if bag is None else bag).mapInArrow(run, BLOCK)


def _arrays_of_blocks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for bins, g, h, used in zip(*(c.to_pylist() for c in b.columns), strict=True):
        used = np.frombuffer(used, bool)
        bins = np.frombuffer(bins, np.int16).reshape(-1, len(used)).T
        yield bins[used], np.frombuffer(g, np.int64)[used], np.frombuffer(h, np.int64)[used]


def _arrays_of_rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    keep = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
    yield _bins_of(b.column(0), b.num_rows)[keep], b.column(1).to_numpy()[keep], b.column(2).to_numpy()[keep]


@dataclass
class Node:
    """A node while a tree grows: sums over its rows, its best split, and its children once their histograms are known."""

    rows: int
    g: int
    h: int
    depth: int
    histogram: np.ndarray = field(repr=False)  # feature x bin x (g, h, rows)
    split: tuple[float, int, int] | None = None
    children: tuple[int, int] | None = None


@dataclass(frozen=True)
class Growth:
    """How trees grow."""

    leaves: int = 15
    depth: int = 6
    least_rows: int = 40
    least_hessian: float = 1e-3
    l2: float = 1.0


def best_split(histogram: np.ndarray, how: Growth) -> tuple[float, int, int] | None:
    """(gain, feature, last bin of the left side) of the largest gain over 0; ties go to the first feature, then the first bin."""
    left = np.cumsum(histogram, axis=1)[:, :-1]
    whole = histogram.sum(axis=1, keepdims=True)
    right = whole - left
    (gl, hl), (gr, hr), (g, h) = ((x[..., 0] / SCALE, x[..., 1] / SCALE) for x in (left, right, whole))
    gain = gl**2 / (hl + how.l2) + gr**2 / (hr + how.l2) - g**2 / (h + how.l2)
    fits = (left[..., 2] >= how.least_rows) & (right[..., 2] >= how.least_rows) & (hl >= how.least_hessian) & (hr >= how.least_hessian)
    gain = np.where(fits, gain, 0.0)
    if not gain.size or gain.max() <= 0:
        return None
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def grow(histograms: Callable[[list[Node], list[int]], dict[int, np.ndarray]], how: Growth) -> tuple[list[Node], list[int]]:
    """(nodes, order of the splits): always the leaf of the largest gain is split, until there are enough leaves.

    histograms(nodes, wanted) gives the left children's histograms of the wanted nodes (of the root: its own, for [-1]); the
    right ones follow by subtraction. All leaves that might be split next are asked for together, so a tree takes about as many
    passes as levels, and as splits are taken by gain alone the tree is that of one split at a time.
    """

    def made(histogram: np.ndarray, depth: int) -> Node:
        g, h, n = (int(x) for x in histogram[0].sum(axis=0)) if len(histogram) else (0, 0, 0)
        node = Node(n, g, h, depth, histogram)
        if depth < how.depth and n >= 2 * how.least_rows:
            node.split = best_split(histogram, how)
        return node

    nodes: list[Node] = [made(histograms([], [-1])[-1], 0)]
    leaves, order = [0], []
    while len(leaves) < how.leaves:
        open_ones = [k for k in leaves if nodes[k].split]
        if not open_ones:
            break
        best = max(open_ones, key=lambda k: (nodes[k].split[0], -k))
        if nodes[best].children is None:
            wanted = [k for k in open_ones if nodes[k].children is None]
            found = histograms(nodes, wanted)
            for k in wanted:
                nodes[k].children = (len(nodes), len(nodes) + 1)
                nodes += [made(found[k], nodes[k].depth + 1), made(nodes[k].histogram - found[k], nodes[k].depth + 1)]
        order.append(best)
        leaves.remove(best)
        leaves += nodes[best].children
    return nodes, order


def walked(bins: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The node where each row of bins ends. nodes: (feature or -1, last bin of the left side, left, right)."""
    table = np.array(nodes, np.int64).reshape(-1, 4)
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = table[at, 0]
        inner = f >= 0
        if not inner.any():
            return at
        left = bins[rows, np.maximum(f, 0)] <= table[at, 1]
        at = np.where(inner, np.where(left, table[at, 2], table[at, 3]), at)


def _bins_of(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def _histograms(rows: DataFrame, arrays: Callable, n_bins: int, features: list[int], n_features: int) -> Callable[[list[Node], list[int]], dict[int, np.ndarray]]:
    """One pass over the rows or blocks, which arrays() reads, for the histograms of some nodes' left children."""

    def asked(nodes: list[Node], wanted: list[int]) -> dict[int, np.ndarray]:
        table = [(n.split[1], n.split[2], *n.children) if n.children else (-1, 0, 0, 0) for n in nodes] or [(-1, 0, 0, 0)]
        place = {k: i for i, k in enumerate(wanted)}
        lefts = [(k, nodes[k].split[1], nodes[k].split[2]) for k in wanted if k >= 0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(wanted) * len(features) * n_bins), np.int64)
            for bins, g, h in (x for b in batches for x in arrays(b)):
                if lefts:
                    at, which = walked(bins, table), np.full(len(bins), -1)
                    for k, f, last in lefts:
                        which[(at == k) & (bins[:, f] <= last)] = place[k]
                    keep = np.flatnonzero(which >= 0)
                    bins, g, h, which = bins[keep], g[keep], h[keep], which[keep]
                else:
                    which = np.zeros(len(bins), np.int64)
                for i, f in enumerate(features):
                    cell = (which * len(features) + i) * n_bins + bins[:, f]
                    for k, w in enumerate((g, h, None)):
                        total[k] += np.bincount(cell, w, total.shape[1]).astype(np.int64)
            cells = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(t[cells]) for t in total)], names=["cell", "g", "h", "n"])

        sums = rows.select("bins", "g", "h", "used").mapInArrow(run, "cell long, g long, h long, n long").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
        out = np.zeros((len(wanted), n_features, n_bins, 3), np.int64)
        flat = np.zeros((len(wanted) * len(features) * n_bins, 3), np.int64)
        for r in sums.collect():  # nodes x features x bins at most
            flat[r.cell] = (r.g, r.h, r.n)
        out[:, features] = flat.reshape(len(wanted), len(features), n_bins, 3)
        # features that this tree may not use still count rows and sums, in one bin without a split
        whole = out[:, features[0]].sum(axis=1)
        for f in set(range(n_features)) - set(features):
            out[:, f, 0] = whole
        return {k: out[i] for k, i in place.items()}

    return asked


@dataclass(frozen=True)
class RankingModel:
    """Trees as text (see learn.tree_scores), their features, and the score of each round on the held-out queries, the base's first."""

    text: str
    features: list[str]
    base: tuple[str, float] | None
    validation: list[float]

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """df with the model's score: the base feature by its coefficient, and the trees."""
        scored = learn.tree_scores(df, self.features, self.text, name)
        return scored.withColumn(name, F.col(name) + F.coalesce(F.col(self.base[0]).cast("double"), F.lit(0.0)) * self.base[1]) if self.base else scored


def lambda_mart(
    df: DataFrame,
    query: str,
    item: str,
    truth: str,
    features: list[str],
    trees: int = 100,
    rate: float = 0.05,
    how: Growth = Growth(),  # noqa: B008
    bins: int = 255,
    metric: str = "ndcg",
    sigma: float = 1.0,
    normalize: bool = True,
    weight: str | None = None,
    held_out: str | None = None,
    patience: int = 20,
    row_share: float = 1.0,
    column_share: float = 1.0,
    base: tuple[str, float] | None = None,
    seed: int = 0,
) -> RankingModel:
    """Trees that rank each query's true item first.

    df: one row per query and item, truth at most once per query (a query without one doesn't train), weight per query. Rows
    whose held_out is true never train; MRR@25 (ties averaged, weighted) over their queries stops the fit after `patience`
    rounds without a gain, and the trees up to the best round stay; without held_out all stay. A row's score starts at base's
    feature times its coefficient. row_share of the queries and column_share of the features take part in a tree, by hashes.
    Ties of scores are ranked by item. An empty table gives no trees.

    df is written once, and packed by one shuffle by query; a round is one written table and as many aggregations as the tree
    has levels. Queries of over QUERY_ROWS rows make each round a shuffle of rows by query instead.
    """
    if metric not in ("mrr", "ndcg"):
        raise ValueError("metric is mrr or ndcg")
    df = materialize(df.select(*dict.fromkeys([query, item, truth, *features, *([weight] if weight else []), *([held_out] if held_out else []), *([base[0]] if base else [])])), "candidates")
    edges = {f: bin_edges(df, f, bins) for f in features}
    start = F.coalesce(F.col(base[0]).cast("double"), F.lit(0.0)) * base[1] if base else F.lit(0.0)
    state = df.select(
        F.col(query).alias("q"),
        F.col(item).alias("item"),
        F.coalesce(F.col(truth), F.lit(False)).alias("truth"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (F.coalesce(F.col(held_out), F.lit(False)) if held_out else F.lit(False)).alias("held"),
        start.alias("score"),
        binned(df, edges).alias("bins"),
    )
    n_bins = max([2, *(len(e) for e in edges.values())])
    made: list[str] = []
    validation: list[float] = []
    best = 0
    long = bool(df.groupBy(query).count().where(F.col("count") > QUERY_ROWS).limit(1).collect())
    if not long:
        state = materialize(packed(state, row_share < 1), "blocks")
    tree = None
    for k in range(1, trees + 2):
        drawn = _drawn(k, seed, row_share)
        if long:
            bag = ~F.col("held") & (F.col("w") > 0) & (drawn(F.col("q")) if row_share < 1 else F.lit(True))
            rows = materialize(gradients((_rescored(state, *tree) if tree else state).withColumn("used", bag), metric, sigma, normalize), "round")
        else:
            bag = F.transform("names", drawn) if row_share < 1 else None
            rows = materialize(next_blocks(state, tree, bag, metric, sigma, normalize), "round")
        if held_out:
            validation.append(_validation(rows) if long else _block_validation(rows))
            if validation[-1] > validation[best] + 1e-6:
                best = k - 1
        else:
            best = k - 1
        if k > trees or held_out and k - 1 - best >= patience:
            break
        chosen = _columns(features, column_share, k, seed)
        asked = _histograms(rows, _arrays_of_rows if long else _arrays_of_blocks, n_bins, chosen, len(features))
        nodes, order = grow(asked, how)
        if not order:
            break
        text, table, values = _written(nodes, order, list(edges.values()), rate, how.l2)
        made.append(text)
        state, tree = rows, (table, values)
    return RankingModel("".join(made[:best]), features, base, validation)


def _drawn(tree: int, seed: int, share: float) -> Callable[[Column], Column]:
    return lambda q: uniform(F.concat_ws("/", q.cast("string"), F.lit(str(tree))), seed) < share


def _columns(features: list[str], share: float, tree: int, seed: int) -> list[int]:
    import hashlib

    part = lambda f: int(hashlib.md5(f"{f}/{tree}|{seed}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return [i for i, f in enumerate(features) if part(f) < share] or list(range(len(features)))


def _written(nodes: list[Node], order: list[int], edges: list[list[float]], rate: float, l2: float) -> tuple[str, list[tuple[int, int, int, int]], list[float]]:
    """The tree as text by raw thresholds, and as bins and leaf values; nodes are numbered in the order of the splits."""
    number, made = {0: 0}, [0]
    for k in order:
        for child in nodes[k].children:
            number[child] = len(made)
            made.append(child)
    lines, table, values = ["tree"], [], []
    for k in made:
        node = nodes[k]
        if k in order:
            f, b = node.split[1:]
            left, right = (number[c] for c in node.children)
            lines.append(f"{f} {edges[f][b]!r} {left} {right} 0")
            table.append((f, b, left, right))
            values.append(0.0)
        else:
            value = rate * (node.g / SCALE) / (node.h / SCALE + l2)
            lines.append(f"-1 0 0 0 {value!r}")
            table.append((-1, 0, 0, 0))
            values.append(value)
    return "\n".join(lines) + "\n", table, values


def _rescored(rows: DataFrame, table: list[tuple[int, int, int, int]], values: list[float]) -> DataFrame:
    @F.pandas_udf("double")
    def leaf(bins: pd.Series) -> pd.Series:
        return pd.Series(np.array(values)[walked(np.stack(bins.to_numpy()), table)] if len(bins) else np.zeros(0))

    return rows.select("q", "item", "truth", "w", "held", (F.col("score") + leaf("bins")).alias("score"), "bins")


def _validation(rows: DataFrame) -> float:
    held = rows.where("held")
    standing = evaluate.truth_standing(held, "q", "score", "truth").join(held.groupBy("q").agg(F.max("w").alias("w")), "q")
    value = F.when(F.col("better") < 25, 1.0 / (F.col("better") + 1 + F.col("tied") / 2)).otherwise(0.0)
    found = standing.agg((F.sum(F.col("w") * value) / F.sum("w")).alias("m")).first()
    return round(found.m, 12) if found.m is not None else 0.0


def _block_validation(blocks: DataFrame) -> float:
    sums = blocks.agg(F.sum("gained").alias("gained"), F.sum("held_weight").alias("w")).first()
    return round(sums.gained / sums.w, 12) if sums.w else 0.0


def permuted_truth(df: DataFrame, query: str, item: str, truth: str, seed: int) -> DataFrame:
    """df with another truth, the control of a ranker: of each query that has one, the item of the least hash is the truth."""
    own = Window.partitionBy(query)
    at = F.struct(mark(F.concat_ws("/", F.col(query).cast("string"), F.col(item).cast("string")), seed), F.col(item))
    drawn = (at == F.min(at).over(own)) & F.max(F.coalesce(F.col(truth), F.lit(False))).over(own)
    return df.withColumn(truth, drawn)


def class_mix_weights(queries: DataFrame, group: str, shares: dict[str, float]) -> DataFrame:
    """queries with weight: each group's share of the mixture by its share of the queries, so that all weights sum to their number.

    Groups that the mixture doesn't name weigh 0; without shares every query weighs 1. The groups' counts are joined as one small map.
    """
    if not shares:
        return queries.withColumn("weight", F.lit(1.0))
    total = sum(shares.values())
    share = F.lit(0.0)
    for name, part in shares.items():
        share = F.when(F.col(group) == name, part / total).otherwise(share)
    sizes = queries.groupBy(group).agg(F.count("*").alias("_n"))
    whole = queries.agg(F.count("*").alias("_all"))  # one row
    return queries.join(sizes, group).crossJoin(F.broadcast(whole)).withColumn("weight", share * F.col("_all") / F.col("_n")).drop("_n", "_all")
