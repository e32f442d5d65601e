"""Exact top-k search by inner product without random access, on sorted lists.

The rows come in blocks. A block holds one list per dimension, its rows sorted by that component, and the rows' norms. A
query reads lists in the order of its weights, a few at a time, each from the end that its weight favours and without the
last part. What has been read gives every row a lower and an upper bound: a component in a list's unread part lies beyond
the value read last, and lists not read at all are bounded by what the norm leaves (Cauchy and Schwarz). The query's
threshold is the k-th best score so far, of this block's lower bounds or of earlier blocks. Once the rows whose upper bound
reaches it are few, nothing outside can qualify: reading stops, and the final scores of these few are resolved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import map_batches, materialize

#: Rows of a block, components of the queries that one pass over all rows answers (16 MB, broadcast), the share of a list that
#: is read, and the shares of all lists after which the bounds are compared.
BLOCK_ROWS, QUERY_COMPONENTS, DEPTH, STOPS = 2048, 1 << 21, 0.75, (0.375, 0.5, 0.625, 0.75, 0.875)
#: Up to this magnitude sums of products are exact in float64.
EXACT = float(1 << 53)


def quantized(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component x as double, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    infinite = F.lit(float("inf"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == infinite))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def _most(x: np.ndarray) -> float:
    """The largest magnitude, as a float, which the least long has too."""
    return max(float(x.max(initial=0)), -float(x.min(initial=0)))


class _Block:
    """The sorted lists of a block of rows, cut at DEPTH from either end, as four tables for each end.

    For a row in a list: the most that its component can be, the least that its square can be, the component if it was read
    (else 0), and whether it lies beyond what was read.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.squares = x, (x * x).sum(axis=1)
        columns = np.ascontiguousarray(x.T)
        ordered = np.sort(columns, axis=1)
        self.depth = max(1, int(np.ceil(DEPTH * len(x))))
        self.ends = [self._tables(columns, ordered[:, -self.depth, None]), self._tables(-columns, -ordered[:, self.depth - 1, None])]
        self.both = [np.concatenate(t) for t in zip(*self.ends, strict=True)]

    @staticmethod
    def _tables(y: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, ...]:
        beyond = y < edge
        return np.maximum(y, edge), np.where(beyond, np.minimum(edge, 0.0), y) ** 2, np.where(beyond, 0.0, y), beyond.astype(np.float64)

    def read(self, sign: np.ndarray, lists: np.ndarray, rows: np.ndarray, all_four: bool) -> Iterator[np.ndarray]:
        """The tables (else the first two) of some rows in some lists, each read from the end that the sign favours."""
        at = (lists + self.x.shape[1] * (sign < 0))[:, None]
        return (t[at, rows] for t in (self.both if all_four else self.both[:2]))

    def bounds(self, queries: np.ndarray, lists: np.ndarray, all_four: bool) -> tuple[np.ndarray, ...]:
        """For each query and row, over the query's lists: the most, the square, then (else zeros) the sum read and the squared weights beyond."""
        mask = np.zeros(queries.shape)
        np.put_along_axis(mask, lists, 1.0, axis=1)
        low = queries < 0
        weight = [np.where(low, 0.0, mask * queries), np.where(low, -mask * queries, 0.0)]
        part = [np.where(low, 0.0, mask), np.where(low, mask, 0.0)]
        one = lambda k, w: w[0] @ self.ends[0][k] + w[1] @ self.ends[1][k]
        most, square = one(0, weight), one(1, part)
        if not all_four:
            return most, square, np.broadcast_to(0.0, most.shape), np.broadcast_to(0.0, most.shape)
        return most, square, one(2, weight), one(3, [w * w for w in weight])


class Search:
    """The k best rows of every query over the blocks seen so far; ties go to the smaller id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.q, self.own, self.k = queries, own, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        self.threshold = np.full(len(queries), -np.inf)
        self.weight = np.abs(queries).astype(np.float64)
        self.lists = np.argsort(-self.weight, axis=1, kind="stable")
        self.read = self.entries = 0  # of the lists, over blocks and queries: read, or resolved at the end; all

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Read a block of rows."""
        n, d = x.shape
        if _most(x) * _most(self.q) * d >= EXACT:
            return self._plain(ids, x)
        block = _Block(x.astype(np.float64))
        stops = [*dict.fromkeys(int(np.ceil(share * d)) for share in STOPS)]
        for a in range(0, len(self.q), 256):
            first = block.bounds(self.q[a : a + 256], self.lists[a : a + 256, : stops[0]], bool(np.isinf(self.threshold[a : a + 256]).any()))
            for j, *held in zip(range(a, len(self.q)), *first, strict=False):
                rows = np.flatnonzero(ids != self.own[j])
                rows = self._candidates(j, block, stops, rows, *(h[rows] for h in held))
                self.entries += n * d
                self.read += len(rows) * d
                if len(rows):
                    self._keep(j, ids[rows], (block.x[rows] @ self.q[j]).astype(np.int64))
        return None

    def _candidates(self, j: int, block: _Block, stops: list[int], rows: np.ndarray, upper: np.ndarray, found: np.ndarray, lower: np.ndarray, unseen: np.ndarray) -> np.ndarray:
        """The rows that can still be among query j's best once these are few or all lists are read."""
        lists, few = self.lists[j], max(2 * self.k, len(block.x) // 64)
        rest = np.append(np.cumsum((self.weight[j, lists] ** 2)[::-1])[::-1], 0.0)  # squared weights of the lists from each on
        slack = 1 + 1e-9 * np.sqrt(rest[0] * block.squares.max(initial=0.0))
        fresh = np.isinf(self.threshold[j])  # lower bounds make a query's first threshold, then scores do
        for before, at in zip([0, *stops], stops, strict=False):
            if before:
                now = lists[before:at]
                up, square, *rest_of = block.read(np.sign(self.q[j, now]), now, rows, fresh)
                weight = self.weight[j, now]
                upper, found = upper + weight @ up, found + square.sum(axis=0)
                if fresh:
                    lower, unseen = lower + weight @ rest_of[0], unseen + weight**2 @ rest_of[1]
            self.read += block.depth * (at - before)
            reach = np.sqrt(np.maximum(block.squares[rows] - found, 0.0))
            if fresh and len(rows) >= self.k:
                sure = lower - reach * np.sqrt(rest[at] + unseen) - slack
                self.threshold[j] = max(self.threshold[j], float(np.partition(sure, len(rows) - self.k)[len(rows) - self.k]))
            can = upper + reach * np.sqrt(rest[at]) + slack >= self.threshold[j]
            rows, upper, found = rows[can], upper[can], found[can]
            if fresh:
                lower, unseen = lower[can], unseen[can]
            if len(rows) <= few:
                break
        return rows

    def _plain(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Components so large that float64 would round: whole numbers of any size, row by row."""
        for j in range(len(self.q)):
            q = [int(v) for v in self.q[j]]
            scores = np.array([sum(int(a) * b for a, b in zip(row, q, strict=True)) for row in x.tolist()], object)
            rows = np.flatnonzero(ids != self.own[j])
            if len(rows):
                self._keep(j, ids[rows], np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores[rows]], np.int64))

    def _keep(self, j: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.best[j][0], ids]), np.concatenate([self.best[j][1], scores])
        order = np.lexsort((ids, ~scores))[: self.k]  # not -scores, which the least long has not
        self.best[j] = (ids[order], scores[order])
        if len(order) == self.k:
            self.threshold[j] = max(self.threshold[j], float(scores[order[-1]]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows by integer inner product, ties to smaller ids.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take no part. Vectors of
    another length than the query's are not compared; empty ones score 0 with each other. A query never finds rows of its own id; rows that repeat another id
    count each; a repeated query id is answered once, for its first vector in order. Fewer than k rows: all of them. Scores
    beyond a long are cut to its ends. Further columns are not read; empty tables give an empty result.

    Queries reach the driver in blocks of bounded size, each broadcast for one scan of all rows.
    """
    ready = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v"))
    rows, out = ready(vectors), None
    for block in _blocks(ready(queries).groupBy("id").agg(F.min("v").alias("v"))):
        found = _scan(rows, block, k)
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        # a query is answered in one block, so each block's answers are written once
        found = materialize(found, "found")
        out = found if out is None else out.unionAll(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def _blocks(queries: DataFrame) -> Iterator[dict[int, list[tuple[int, list[int]]]]]:
    """Queries by their number of dimensions, with QUERY_COMPONENTS at a time."""
    block: dict[int, list[tuple[int, list[int]]]] = {}
    n = 0
    for r in queries.toLocalIterator():
        block.setdefault(len(r.v), []).append((r.id, r.v))
        n += len(r.v) + 1
        if n >= QUERY_COMPONENTS:
            yield block
            block, n = {}, 0
    if n:
        yield block


def _scan(rows: DataFrame, block: dict[int, list[tuple[int, list[int]]]], k: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast({d: (np.array([v for _, v in qs], np.int64), np.array([i for i, _ in qs], np.int64)) for d, qs in block.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: Search(q, own, k) for d, (q, own) in sent.value.items()}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            column = b.column(1)
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(offsets)
            for d, search in searches.items():
                own = np.flatnonzero(lengths == d)
                if len(own):
                    search.add(ids[own], flat[offsets[own][:, None] + np.arange(d)[None, :]])
        for search in searches.values():
            n = [len(i) for i, _ in search.best]
            yield pa.record_batch(
                [
                    pa.array(np.repeat(search.own, n)),
                    pa.array(np.concatenate([i for i, _ in search.best])),
                    pa.array(np.concatenate([s for _, s in search.best])),
                ],
                ["query_id", "vec_id", "score"],
            )

    return map_batches(rows, run, "query_id long, vec_id long, score long", BLOCK_ROWS)
