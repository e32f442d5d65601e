"""Small models fit by driver loops over distributed aggregations; parameters alone reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.rank import sorted_positions
from quern.operators.sampling import mark
from quern.storage import materialize


def hash_fold(key: Column, folds: int, seed: int = 0) -> Column:
    return mark(key, seed) % folds


def interleaved_fold(df: DataFrame, key: str, folds: int) -> DataFrame:
    """key and fold, its position in the sorted table modulo folds."""
    return sorted_positions(df, [key], [key]).select(key, ((F.col("n") - 1) % folds).cast("long").alias("fold"))


#: Rows of a block of conditional_logit.
LOGIT_ROWS = 1 << 16
#: Scores of a block that lie no farther apart need no greatest one of each query: their exponentials stay far from 0.
LOGIT_SPAN = 600.0


def conditional_logit(df: DataFrame, query: str, truth: str, features: list[str], steps: int = 600, rate: float = 0.1, l2: float = 1e-3, weight: str | None = None) -> dict[str, float]:
    """Weights that maximize the weighted mean log-probability of each query's true candidate, by Adam.

    weight: a number per query (the largest of its rows; null: 0). Queries without a true candidate, and several rows of one
    query that are true, count as their mean or not at all. Rows are packed once into written blocks, sorted by query over all
    tasks: a block's distinct rows of features, and of each candidate only which of them it has. A step is one pass over the
    blocks, which return their share of the gradient. Blocks end with a query; the sums of those that reach over blocks or
    tasks come apart, two rows a task and a block of a longer query.
    """
    own = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = df.select(F.col(query).alias("q"), own.alias("w"), F.coalesce(F.col(truth), F.lit(False)).alias("t"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)])
    columns = [f"x{i}" for i in range(len(features))]
    known = rows.groupBy("q").agg(F.max("w").alias("_w"), F.count_if("t").alias("_true")).where("_true > 0")
    rows = rows.join(known, "q").select("q", F.col("_w").alias("w"), (F.col("t").cast("double") / F.col("_true")).alias("t"), *columns)
    dealt = rows.repartitionByRange("q", *columns).sortWithinPartitions("q")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, opened = 0, True  # the first query may have begun before

        def starts(table: pa.Table) -> np.ndarray:
            keys = table.column(0).combine_chunks().dictionary_encode()
            return np.flatnonzero(np.diff(keys.indices.to_numpy(), prepend=-1))

        def block(table: pa.Table, open_end: bool) -> pa.RecordBatch:
            at = starts(table)
            counts = np.diff(at, append=table.num_rows).astype(np.int32)
            w, t, *x = (c.to_numpy() for c in table.columns[1:])
            x = np.column_stack(x)
            values, codes = np.unique(x, axis=0, return_inverse=True)
            codes = codes.reshape(-1).astype(np.min_scalar_type(len(values)))
            q = table.column(0)
            ends = [str(q[0].as_py()) if opened else None, str(q[len(q) - 1].as_py()) if open_end else None]
            sent = [w[at].tobytes(), counts.tobytes(), codes.tobytes(), values.tobytes()]
            return pa.RecordBatch.from_arrays([*(pa.array([e], pa.string()) for e in ends), *(pa.array([s], pa.binary()) for s in sent), pa.array([((w * t) @ x).tolist()], pa.list_(pa.float64()))], names=["first", "last", "own", "counts", "codes", "values", "pull"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= LOGIT_ROWS:
                table = pa.Table.from_batches(held)
                cut = int(starts(table)[-1])  # where the last query begins; one that fills the block is cut anywhere
                yield block(table[:cut] if cut else table, not cut)
                held, opened = table[cut:].to_batches() if cut else [], not cut
                n = sum(h.num_rows for h in held)
        if held:
            yield block(pa.Table.from_batches(held), True)

    blocks = materialize(dealt.mapInArrow(pack, "first string, last string, own binary, counts binary, codes binary, values binary, pull array<double>"), "blocks")
    blocks = blocks.coalesce(max(1, min(blocks.rdd.getNumPartitions(), blocks.sparkSession.sparkContext.defaultParallelism))).persist()
    pull = blocks.agg(*[F.coalesce(F.sum(F.get("pull", F.lit(i))), F.lit(0.0)) for i in range(len(features))]).first() if features else []
    w, m, v = (np.zeros(len(features)) for _ in range(3))
    for t in range(1, steps + 1):
        push, total = _logit_push(blocks, w)
        g = (push - np.array(pull, float)) / (total or 1.0) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    blocks.unpersist()
    return dict(zip(features, w.tolist(), strict=True))


def _logit_push(blocks: DataFrame, w: np.ndarray) -> tuple[np.ndarray, float]:
    """The weighted sum of the queries' expected features, which less that of their true ones is the gradient, and the sum of their weights."""
    f = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, edges = np.zeros(f + 1), []
        for b in batches:
            for first, last, own, counts, codes, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own, counts, values = np.frombuffer(own).copy(), np.frombuffer(counts, np.int32), np.frombuffer(values).reshape(-1, f)
                ends = np.cumsum(counts)
                starts, codes = ends - counts, np.frombuffer(codes, f"u{len(codes) // ends[-1]}").astype(np.intp)
                s = values @ w
                most = s.max()
                if most - s.min() < LOGIT_SPAN:
                    top, e = np.full(len(counts), most), np.exp(s - most)[codes]
                else:
                    s = s[codes]
                    top = np.maximum.reduceat(s, starts)
                    e = np.exp(s - np.repeat(top, counts))
                z = np.add.reduceat(e, starts)
                for k, name in dict((k, name) for k, name in ((0, first), (len(counts) - 1, last)) if name is not None).items():
                    part = slice(starts[k], ends[k])
                    edges.append((name, [own[k], top[k], z[k], *(e[part] @ values[codes[part]])]))
                    own[k] = 0.0
                whole[:f] += np.bincount(codes, e * np.repeat(own / z, counts), len(values)) @ values
                whole[f] += own.sum()
        edges.append((None, whole.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in edges], pa.string()), pa.array([[float(y) for y in x] for _, x in edges], pa.list_(pa.float64()))], names=["q", "sums"])

    push, total, open_ones = np.zeros(f), 0.0, {}
    for name, sums in blocks.select("first", "last", "own", "counts", "codes", "values").mapInArrow(run, "q string, sums array<double>").collect():
        if name is None:
            push, total = push + sums[:f], total + sums[f]
        else:
            open_ones.setdefault(name, []).append(np.array(sums))
    for parts in open_ones.values():
        most = max(p[1] for p in parts)
        scale = [np.exp(p[1] - most) for p in parts]
        z, ex = sum(c * p[2] for c, p in zip(scale, parts, strict=True)), sum(c * p[3:] for c, p in zip(scale, parts, strict=True))
        push, total = push + parts[0][0] * ex / z, total + parts[0][0]
    return push, total


def lambda_gradients(df: DataFrame, query: str, item: str, score: str, truth: str, k: int = 25) -> DataFrame:
    """LambdaMART's gradient of each candidate for one relevant item per query: pairs of the truth with each other candidate.

    The swap of two ranks changes the reciprocal rank by abs(1/r1 - 1/r2), ranks beyond k counting 0. Pairs grow with the
    candidates, not with their square, as only those with the truth count.
    """
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), item))
    ranked = df.withColumn("_r", rank).withColumn("_g", F.when(F.col("_r") <= k, 1.0 / F.col("_r")).otherwise(0.0))
    own = ranked.where(F.col(truth)).select(query, F.col(score).alias("_ts"), F.col("_g").alias("_tg"))
    pairs = ranked.join(own, query).withColumn("_rho", 1 / (1 + F.exp(F.col("_ts") - F.col(score))) * F.abs(F.col("_tg") - F.col("_g")))
    total = F.sum(F.when(F.col(truth), 0.0).otherwise(F.col("_rho"))).over(Window.partitionBy(query))
    return pairs.select(query, item, F.when(F.col(truth), total).otherwise(-F.col("_rho")).alias("gradient"))


def parse_trees(text: str) -> list[list[tuple[int, float, int, int, float]]]:
    """Trees of a text model: a line "tree", then nodes "feature threshold left right value"; a leaf has feature -1."""
    trees: list[list[tuple[int, float, int, int, float]]] = []
    for line in text.splitlines():
        if line.strip() == "tree":
            trees.append([])
        elif line.strip():
            f, t, a, b, v = line.split()
            trees[-1].append((int(f), float(t), int(a), int(b), float(v)))
    return trees


def tree_scores(df: DataFrame, features: list[str], model: str, name: str = "score") -> DataFrame:
    """df with the sum of its trees' leaves; a feature up to the threshold goes left, a null counts as minus infinity.

    Whole batches walk a tree level by level; the model is of the size of its text.
    """
    sent = df.sparkSession.sparkContext.broadcast([np.array(t, float) for t in parse_trees(model)])

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.astype(float).fillna(-np.inf).to_numpy() for c in columns])
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for tree in sent.value:
            at = np.zeros(len(x), int)
            while True:
                f = tree[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                left = x[rows, np.maximum(f, 0)] <= tree[at, 1]
                at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(int), at)
            total += tree[at, 4]
        return pd.Series(total)

    return df.withColumn(name, score(*features))


def mlp_scores(df: DataFrame, features: list[str], layers: list[tuple[list[list[float]], list[float]]], name: str = "score") -> DataFrame:
    """df with the one output of a saved network of dense layers (weights by input, biases), rectified between layers.

    Whole batches are multiplied; a null feature counts as 0. The network is of the size of its layers.
    """
    sent = df.sparkSession.sparkContext.broadcast([(np.array(w, float), np.array(b, float)) for w, b in layers])

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.astype(float).fillna(0.0).to_numpy() for c in columns])
        for k, (w, b) in enumerate(sent.value):
            x = (np.maximum(x, 0.0) if k else x) @ w + b
        return pd.Series(x[:, 0])

    return df.withColumn(name, score(*features))


def coordinate_descent(start: dict[str, float], grids: dict[str, list[float]], score: Callable[[dict[str, float]], tuple[float, float]], rounds: int = 3) -> dict[str, float]:
    """One parameter at a time over its grid; a move counts only if it lifts both halves' scores."""
    best, held = dict(start), score(start)
    for _ in range(rounds):
        moved = False
        for name, values in grids.items():
            for value in values:
                if value == best[name]:
                    continue
                now = score({**best, name: value})
                if now[0] > held[0] and now[1] > held[1]:
                    best, held, moved = {**best, name: value}, now, True
        if not moved:
            break
    return best


def step_halving(start: dict[str, float], steps: dict[str, float], score: Callable[[dict[str, float]], float], halvings: int = 4) -> dict[str, float]:
    """Each parameter up and down by its step while that lifts the score, then steps are halved."""
    best, held, size = dict(start), score(start), dict(steps)
    for _ in range(halvings):
        for name in start:
            for sign in (1, -1):
                while (now := score({**best, name: best[name] + sign * size[name]})) > held:
                    best, held = {**best, name: best[name] + sign * size[name]}, now
        size = {k: v / 2 for k, v in size.items()}
    return best


def mixture_weights(df: DataFrame, parts: list[str], target: str, grid: int) -> DataFrame:
    """Shares of the parts (multiples of 1/grid, summing to 1) with the least squared error: one row, w_<part> and error.

    Sums of products are gathered once; the grid, of fixed size, is searched on them.
    """
    names = [*parts, target]
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[: i + 1]])
    rows = sums
    left: Column = F.lit(grid)
    for p in parts[:-1]:
        rows = rows.withColumn(f"_k_{p}", F.explode(F.sequence(F.lit(0), left)))
        left = left - F.col(f"_k_{p}")
    rows = rows.withColumn(f"_k_{parts[-1]}", left)
    weight = {p: F.col(f"_k_{p}") / grid for p in parts} | {target: F.lit(-1.0)}
    product = lambda i, j: F.col(f"`{names[max(i, j)]}*{names[min(i, j)]}`")
    error = sum((weight[a] * weight[b] * product(i, j) for i, a in enumerate(names) for j, b in enumerate(names)), F.lit(0.0))
    keep = F.struct(error.alias("e"), *[F.col(f"_k_{p}") for p in parts])
    return rows.agg(F.min(keep).alias("_m")).select(*[(F.col(f"_m._k_{p}") / grid).alias(f"w_{p}") for p in parts], F.col("_m.e").alias("error"))
