"""Samples and holdouts that depend on keys and seeds alone, never on partitioning."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import materialize


def mark(key: Column, seed: int) -> Column:
    """A number from 0 below 2**52 from a key and a seed: 13 hexadecimal digits of an MD5, which other engines can follow."""
    text = F.concat_ws("|", key.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def hash_share(df: DataFrame, key: str, share_of: int, keep: int, seed: int = 0) -> DataFrame:
    """Rows whose hashed key falls into `keep` of `share_of` classes."""
    return df.where(mark(F.col(key), seed) % share_of < keep)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a key and a seed."""
    return (mark(key, seed).cast("double") + 0.5) / float(1 << 52)


def draw(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by the order of a hash; ties by the key."""
    return df.orderBy(mark(F.col(key), seed), key).limit(n)


def matched_sample(source: DataFrame, target: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of source, drawn so that strata come in the target's proportions.

    A row's weight is its stratum's share in the target over that in the source; the rows of largest log(u) / weight are
    drawn, which is sampling without replacement with those weights.
    """
    a = source.groupBy(stratum).agg(F.count("*").alias("_a"))
    b = target.groupBy(stratum).agg(F.count("*").alias("_b"))
    weights = a.join(b, stratum).select(stratum, (F.col("_b") / F.col("_a")).alias("_w"))
    ranked = source.join(weights, stratum).withColumn("_k", F.ln(uniform(F.col(key), seed)) / F.col("_w"))
    return ranked.orderBy(F.col("_k").desc(), key).limit(n).drop("_w", "_k")


def holdout(df: DataFrame, key: str, row: str, eligible: Column, least: int, n_keys: int, cap: int, mode: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(queries, library): keys with `least` eligible rows or more, n_keys of them drawn, up to `cap` rows each as queries.

    mode sibling leaves an eligible row of each key in the library; denovo takes all other rows of the drawn keys out;
    other_kind keeps only the drawn keys' rows that are not eligible. Rows are taken in the order of `row`.
    """
    keys = df.where(eligible).groupBy(key).agg(F.count("*").alias("_m")).where(F.col("_m") >= least)
    drawn = draw(keys, key, n_keys, seed)
    limit = F.least(F.lit(cap), F.col("_m") - 1) if mode == "sibling" else F.lit(cap)
    rows = df.where(eligible).join(drawn, key)
    queries = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(row))).where(F.col("_n") <= limit).select(*df.columns)
    rest = df.join(queries.select(row), row, "left_anti")
    if mode == "denovo":
        rest = rest.join(drawn.select(key), key, "left_anti")
    elif mode == "other_kind":
        own = rest.join(drawn.select(key, F.lit(True).alias("_drawn")), key, "left")
        rest = own.where(F.col("_drawn").isNull() | ~F.coalesce(eligible, F.lit(False))).select(*df.columns)
    return queries, rest.select(*df.columns)


#: Shares of a Poisson variable of mean 1 that are at most 0, 1, 2, 3, 4 and 5.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


#: MD5's sines and turns.
SINES = np.array([math.floor(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)], np.uint32)
ROLLS = [r[i % 4] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]


def md5_marks(texts: np.ndarray) -> np.ndarray:
    """First 13 hexadecimal digits of the MD5 of each row of bytes, as numbers; all at once, for rows of at most 55 bytes."""
    n, size = texts.shape
    if size > 55:
        return np.array([int(hashlib.md5(t.tobytes()).hexdigest()[:13], 16) for t in texts], np.int64)
    block = np.zeros((n, 64), np.uint8)
    block[:, :size] = texts
    block[:, size] = 0x80
    word = np.ascontiguousarray(block.view("<u4").T)
    word[14] = 8 * size
    used = size // 4 + 1  # words after these are 0 but for the length
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    for i, roll in enumerate(ROLLS):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += SINES[i]
        if g < used or g == 14:
            f += word[g]
        left = f << np.uint32(roll)
        f >>= np.uint32(32 - roll)
        f |= left
        f += b
        a, b, c, d = d, f, b, c
    a, b = (a + np.uint32(start[0])).byteswap().astype(np.int64), (b + np.uint32(start[1])).byteswap().astype(np.int64)
    return (a << 20) | (b >> 12)


def bootstrap_mean(df: DataFrame, key: str, value: str, rounds: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean of value with a percentile interval from Poisson bootstrap rounds: mean, low, high.

    A row counts k times in a round with the chance of a Poisson variable of mean 1, drawn from a hash of key and round. That
    is a hash for each row and round: rows are dealt to all tasks, and a task hashes arrays and puts out its sums for the rounds.
    """
    # the least mark whose uniform number is over the share
    least = np.array([math.floor(Fraction(p) * (1 << 52) - Fraction(1, 2)) + 1 for p in POISSON], np.int64)
    rows = materialize(df.select(F.coalesce(F.concat(F.col(key).cast("string"), F.lit("|")), F.lit("")).cast("binary").alias("_key"), F.col(value).cast("double").alias("_v")), "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums, some = np.zeros(rounds, np.int64), np.zeros(rounds), np.zeros(rounds, np.int64)
        for batch in batches:
            keys, v = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            # a null value takes a weight but adds nothing
            known = np.array(batch.column(1).is_valid())
            lengths = np.fromiter(map(len, keys), np.int64, len(keys))
            for size in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == size)
                heads = np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), size)
                for digits in range(1, len(str(rounds)) + 1):
                    first, last = 10 ** (digits - 1), min(10**digits - 1, rounds)
                    tails = np.frombuffer(b"".join(f"{k}|{seed}".encode() for k in range(first, last + 1)), np.uint8).reshape(last - first + 1, -1)
                    step = max(1, (1 << 14) // len(tails))
                    for i in range(0, len(at), step):
                        mine = at[i : i + step]
                        texts = np.empty((len(mine), len(tails), size + tails.shape[1]), np.uint8)
                        texts[:, :, :size] = heads[i : i + step, None]
                        texts[:, :, size:] = tails
                        marks = md5_marks(texts.reshape(-1, texts.shape[2]))
                        w = sum((marks >= x).astype(np.int8) for x in least).reshape(len(mine), len(tails))
                        weights[first - 1 : last] += w.sum(0, dtype=np.int64)
                        sums[first - 1 : last] += np.where(known[mine], v[mine], 0.0) @ w
                        some[first - 1 : last] += known[mine].sum()
        yield pa.record_batch([pa.array(np.arange(1, rounds + 1)), pa.array(weights), pa.array(sums), pa.array(some)], ["round", "w", "s", "some"])

    tasks = 8 * df.sparkSession.sparkContext.defaultParallelism
    drawn = rows.repartition(tasks).mapInArrow(run, "round long, w long, s double, some long")
    # a round without weight has no mean
    mean = F.when((F.sum("w") > 0) & (F.sum("some") > 0), F.sum("s") / F.nullif(F.sum("w"), F.lit(0)))
    means = drawn.groupBy("round").agg(mean.alias("_m"))
    whole = rows.agg(F.avg("_v").alias("mean"))
    return means.agg(F.percentile("_m", F.lit(low)).alias("low"), F.percentile("_m", F.lit(high)).alias("high")).crossJoin(whole).select("mean", "low", "high")
