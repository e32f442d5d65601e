"""Toxicity of texts: a linear classifier on character n-grams, their presence scaled by naive Bayes log-count ratios.

Fitting reads a bounded sample of labelled rows (max_rows, drawn by the order of a hash of the id, each class at most half
of it but for what the other leaves). Executors count the n-grams and pick each row's significant ones; the driver gets
these and solves for their weights, but no text. Scoring reads every whole text, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import keep_rows, map_batches, materialize

ORDERS = (4, 5, 6, 7)
BITS = 20
#: Partitions that count n-grams, and hashes of one part of their tables: 8 MB go from each partition to the sums.
PARTS, CHUNK = 8, 1 << 14
#: Odd multipliers of the rolling hash and of its final mixing.
ROLL, MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between blanks, white space as single code."""
    raw = f" {text.lower()} ".replace("\n", " ").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32)


def features(text: str, keep: np.ndarray | None = None, bits: int = BITS) -> np.ndarray:
    """Distinct hashed character n-grams of a text; keep: a boolean table of the hashes that count."""
    x = _codes(text)
    found = []
    h = np.zeros(len(x), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * ROLL + x[n - 1 :]
        if n in ORDERS:
            key = ((h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * MIX) >> np.uint32(32 - bits)
            found.append(key if keep is None else key[keep[key]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    """weights and keep are tables over the 2**bits hashes; a score is the logistic of bias plus the weights present."""

    weights: np.ndarray
    keep: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[features(text or "", self.keep)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


#: A feature counts if a class has it in so many rows, and its log-count ratio is so many deviations from 0.
LEAST_DOCS, LEAST_Z = 3, 3.0


def significant(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> tuple[np.ndarray, np.ndarray]:
    """(which features count, naive Bayes log-count ratios of all) from the rows of either class that hold each."""
    ratio = np.log((ones + 0.5) / (n1 + 1)) - np.log((zeros + 0.5) / (n0 + 1))
    spread = np.sqrt(1 / (ones + 1) + 1 / (zeros + 1))
    return (np.maximum(ones, zeros) >= least_docs) & (np.abs(ratio) >= least_z * spread), ratio


def constant(n1: int, n0: int) -> Model | None:
    """The model of no rows (every score is 0) or of one class (that class's share, shrunk towards a half)."""
    size = 1 << BITS
    if not n1 and not n0:
        return Model(np.zeros(size), np.zeros(size, bool), -500.0)
    if n1 and n0:
        return None
    p = (n1 + 0.5) / (n1 + n0 + 1)
    return Model(np.zeros(size), np.zeros(size, bool), float(np.log(p / (1 - p))))


def solve(rows: list[np.ndarray], labels: np.ndarray, keep: np.ndarray, ratio: np.ndarray, prior: float, l2: float = 0.1, steps: int = 200) -> Model:
    """The classifier on rows of features that count, each scaled by its ratio; prior: the share of ones where the rows come from."""
    y = np.asarray(labels, np.float64)
    n1, n0 = int(y.sum()), len(y) - int(y.sum())
    column = (np.cumsum(keep) - 1).astype(np.int32)
    # chunks of rows: where they lie, each feature's row among them, and the features
    chunks = []
    for k in range(0, len(rows), 512):
        part = [column[x] for x in rows[k : k + 512]]
        chunks.append((slice(k, k + len(part)), np.repeat(np.arange(len(part), dtype=np.int16), [len(x) for x in part]), np.concatenate(part)))
    r = ratio[keep]
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0) * len(y)

    def by_row(values: np.ndarray) -> np.ndarray:
        """The sum of a value for each feature over every row's features."""
        return np.concatenate([np.bincount(at, values[cols], place.stop - place.start) for place, at, cols in chunks])

    def by_feature(values: np.ndarray) -> np.ndarray:
        """The sum of a value for each row over every feature's rows."""
        return sum(np.bincount(cols, values[place][at], len(r)) for place, at, cols in chunks)

    w, b = np.zeros(len(r)), float(np.log(prior / (1 - prior)))
    # Nesterov's method on the log loss; the step follows the largest row, so it can't diverge.
    norm = by_row(r * r)
    step = 1 / (0.25 * float((weight * (norm + 1)).max()) + l2) if len(r) else 0.0
    step = max(step, 4.0 / (0.25 * float((weight * (norm + 1)).sum()) + l2))
    wv, bv = w.copy(), b
    loss_before = np.inf
    for k in range(steps):
        z = by_row(r * wv) + bv
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * l2 * wv @ wv)
        if loss > loss_before * 1.0001:
            step, wv, bv = step / 2, w.copy(), b
            loss_before = np.inf
            continue
        loss_before = loss
        w_new = wv - step * (r * by_feature(g) + l2 * wv)
        b_new = bv - step * float(g.sum())
        m = k / (k + 3)
        wv, bv, w, b = w_new + m * (w_new - w), b_new + m * (b_new - b), w_new, b_new
    weights = np.zeros(1 << BITS)
    weights[keep] = w * r
    return Model(weights, keep, b)


def fit_model(texts: list[str], labels: np.ndarray, prior: float | None = None) -> Model:
    """The fit on a list of texts with labels 0 and 1, all in one process."""
    y = np.asarray(labels, np.int64)
    n1, n0 = int(y.sum()), len(y) - int(y.sum())
    if flat := constant(n1, n0):
        return flat
    counts = np.zeros((2, 1 << BITS), np.int64)
    for t, label in zip(texts, y, strict=True):
        counts[label][features(t)] += 1
    keep, ratio = significant(counts[1], counts[0], n1, n0)
    return solve([features(t, keep) for t in texts], y, keep, ratio, (n1 + 0.5) / (n1 + n0 + 1) if prior is None else prior)


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, folds: int) -> tuple[DataFrame, float]:
    """(doc_id, y, text of at most max_rows labelled documents outside the held-out fold; the share of ones among all those labelled).

    Rows with a null id, label or text don't count. Of labels that repeat an id the largest counts, of documents that do the
    least text.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    take1 = min(n1, max(max_rows // 2, max_rows - n0))
    take0 = min(n0, max_rows - take1)
    order = F.xxhash64("doc_id")
    drawn = rows.where("y = 1").orderBy(order, "doc_id").limit(take1).unionAll(rows.where("y = 0").orderBy(order, "doc_id").limit(take0))
    # at most max_rows ids, so the broadcast is bounded
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").where(F.col("text").isNotNull())
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")), (n1 + 0.5) / (n1 + n0 + 1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 6000, folds: int = 5) -> Model:
    """Fit on at most max_rows labelled documents, as training_sample draws them. The driver gets their features that count, no text."""
    drawn, prior = training_sample(docs, labels, label_col, max_rows, folds)
    sample = materialize(drawn.repartition(PARTS, "doc_id"), "sample")
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if flat := constant(n1, n0):
        return flat

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[y][features(t)] += 1
        for k in range(0, 1 << BITS, CHUNK):
            one = [pa.array([c[k : k + CHUNK].tobytes()], pa.binary()) for c in (counts[1], counts[0])]
            yield pa.record_batch([pa.array([k], pa.int32()), *one], ["first", "ones", "zeros"])

    def add(part: pa.Table) -> pa.Table:
        first = part.column("first")[0].as_py()
        ones, zeros = (sum(np.frombuffer(x, np.int32).astype(np.int64) for x in part.column(c).to_pylist()) for c in ("ones", "zeros"))
        keep = np.flatnonzero(significant(ones, zeros, n1, n0)[0])
        return pa.table({"feature": pa.array(keep + first, pa.int32()), "ones": pa.array(ones[keep], pa.int64()), "zeros": pa.array(zeros[keep], pa.int64())})

    tables = map_batches(sample.select("y", "text"), count, "first int, ones binary, zeros binary")
    found = tables.groupBy("first").applyInArrow(add, "feature int, ones long, zeros long").collect()
    keep, ones, zeros = np.zeros(1 << BITS, bool), np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    at = [r.feature for r in found]
    keep[at], ones[at], zeros[at] = True, [r.ones for r in found], [r.zeros for r in found]
    sent = sample.sparkSession.sparkContext.broadcast(np.packbits(keep))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.unpackbits(sent.value).astype(bool)
        for b in batches:
            held = [features(t, counted).astype("<u4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(held, pa.binary())], ["doc_id", "y", "features"])

    rows = sorted(map(tuple, map_batches(sample.select("doc_id", "y", "text"), pick, "doc_id long, y int, features binary").collect()))
    y = np.array([y for _, y, _ in rows], np.int64)
    rows = [np.frombuffer(x, "<u4") for _, _, x in rows]
    return solve(rows, y, keep, significant(ones, zeros, n1, n0)[1], prior)


def _sent(docs: DataFrame, model: Model):
    """The model as a broadcast of 4 MB and a little."""
    return docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), np.packbits(model.keep), model.bias))


def _received(sent) -> Model:
    w, k, bias = sent.value
    return Model(w, np.unpackbits(k, count=len(w)).astype(bool), bias)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns; a null text is scored as an empty one."""
    sent = _sent(docs, model)

    def keep(texts: list[str | None]) -> list[bool]:
        m = _received(sent)
        return [m.score(t) < threshold for t in texts]

    return keep_rows(docs, text_col, keep)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    A null text is scored as an empty one, which the model's bias alone decides. Null and repeated ids are scored row by
    row, texts of any length whole; further columns are not read.
    """
    held = is_held_out(F.col(id_col), folds)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    sent = _sent(docs, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(sent)
        for b in batches:
            s = np.array([m.score(t) for t in b.column(2).to_pylist()], np.float64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(rows, score, SCHEMA)
