"""All-pairs search on packed bit sets: the most similar others of every set, exactly, with blocks left out by bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.rank import sorted_positions, top_k
from quern.storage import materialize

#: Sets of a block.
BLOCK_ROWS = 4096


def packed(flags: Column) -> Column:
    """An array of booleans as an array of longs, 64 flags each, the first in the highest bit; nulls count as false."""
    words = F.sequence(F.lit(0), F.greatest(F.floor((F.size(flags) - 1) / 64), F.lit(0)).cast("int"))
    value = lambda i: F.lit(1 << (63 - i) if i else -(1 << 63))
    bit = lambda w, i: F.when(F.coalesce(F.get(flags, w * 64 + i), F.lit(False)), value(i)).otherwise(F.lit(0).cast("long"))
    return F.transform(words, lambda w: reduce(lambda a, b: a.bitwiseOR(b), [bit(w, i) for i in range(64)]))


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bits of rows of words and rows of words, in as few bytes as hold them."""
    shared = np.bitwise_count(a[:, 0, None] & b[None, :, 0]).astype(np.uint8 if a.shape[1] == 1 else np.int32, copy=False)
    for w in range(1, a.shape[1]):
        shared += np.bitwise_count(a[:, w, None] & b[None, :, w])
    return shared


def _best(ids: np.ndarray, words: np.ndarray, others: np.ndarray, theirs: np.ndarray, k: int, least: np.ndarray) -> list[np.ndarray]:
    """(id, other, similarity) of each row's k best others of at least `least` and over 0, ties to lesser ids; a row is no other of its own id.

    A similarity of t or more needs t / (1 + t) of both sets' bits in common: rows with a bound get exact similarities, and are
    sorted, only where single precision, less a margin, allows that.
    """
    out = []
    order = np.argsort(others, kind="stable")
    others, theirs = others[order], theirs[order]
    bits, their_bits = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (words, theirs))
    for a in range(0, len(ids), 256):
        z = min(a + 256, len(ids))
        shared = _shared(words[a:z], theirs)
        floor = least[a:z].copy()
        bare = np.flatnonzero(floor <= 0)
        if len(bare) and len(others) > k:  # the k-th best of this block is a bound, too; its own id may be one of the k
            sim = shared[bare] / np.maximum(bits[a:z][bare, None] + their_bits[None, :] - shared[bare], 1)
            sim[others[None, :] == ids[a:z][bare, None]] = 0.0
            floor[bare] = np.partition(sim, len(others) - k, axis=1)[:, len(others) - k]
        part = (floor / (1 + floor) * (1 - 1e-4)).astype(np.float32)
        need = part[:, None] * bits[a:z, None].astype(np.float32) + part[:, None] * their_bits[None, :].astype(np.float32)
        row, place = np.nonzero((shared >= need) & (shared > 0))
        both = shared[row, place].astype(np.int64)
        value = both / (bits[a:z][row] + their_bits[place] - both)
        kept = (value >= floor[row]) & (others[place] != ids[a:z][row])
        row, place, value = row[kept], place[kept], value[kept]
        order = np.lexsort((place, -value, row))
        row, place, value = row[order], place[order], value[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append([ids[a:z][row[best]], others[place[best]], value[best]])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _words(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(n, -1)


def blocks_of(sets: DataFrame, key: str, bits: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, keys, words, low, high, union, shared): sets in order of their number of bits, then of the bits, `rows` a block.

    low and high: the least and most bits of a set; union and shared: bits that some, and that all sets of the block have.
    """
    counted = sets.select(F.col(key).alias("key"), F.col(bits).alias("words"), F.aggregate(bits, F.lit(0), lambda n, w: n + F.bit_count(w)).alias("n"))
    placed = sorted_positions(counted, ["key", "words", "n"], ["n", "words", "key"], "at").withColumn("block", F.floor((F.col("at") - 1) / rows))
    held = placed.groupBy("block").agg(F.collect_list(F.struct("key", "words")).alias("sets"), F.min("n").alias("low"), F.max("n").alias("high"))
    fold = lambda f: F.aggregate(F.slice("sets", F.lit(2), F.size("sets")), F.get("sets", F.lit(0)).words, lambda a, s: F.zip_with(a, s.words, f))
    return held.select(
        "block",
        F.transform("sets", lambda s: s.key).alias("keys"),
        F.flatten(F.transform("sets", lambda s: s.words)).alias("words"),
        "low",
        "high",
        fold(lambda x, y: x.bitwiseOR(y)).alias("union"),
        fold(lambda x, y: x.bitwiseAND(y)).alias("shared"),
    )


def _bound(a: str, b: str) -> Column:
    """The most that two blocks' sets can have in common, by their numbers of bits and by the bits themselves."""
    bits = lambda x: F.aggregate(x, F.lit(0), lambda n, w: n + F.bit_count(w))
    col = lambda t, c: F.col(f"{t}_{c}")
    shared = bits(F.zip_with(col(a, "union"), col(b, "union"), lambda x, y: x.bitwiseAND(y)))
    whole = bits(F.zip_with(col(a, "shared"), col(b, "shared"), lambda x, y: x.bitwiseOR(y)))
    counts = F.when(col(a, "high") < col(b, "low"), col(a, "high") / col(b, "low")).when(col(b, "high") < col(a, "low"), col(b, "high") / col(a, "low")).otherwise(1.0)
    return F.least(counts, F.when(whole > 0, shared / whole).otherwise(1.0))


def top_similar_bits(sets: DataFrame, key: str, bits: str, k: int, rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """((key, other, similarity, rank), (block, other) that were compared): every set's k best others by the Tanimoto index of its bits, of those over 0.

    sets: a whole-number key (once each) and an array of longs of one length; null keys or bits take no part; ties go to lesser
    keys. Sets are sorted and cut into blocks. Each is first searched in its own block and the two beside it; the least of a
    block's k-th best scores then bounds where it has to look: blocks whose numbers of bits can reach it meet by an equi-join,
    and of these only the ones whose bits can are compared. A block is one row of bounded size, and so is a pair of blocks.
    """
    usable = sets.where(F.col(key).isNotNull() & F.col(bits).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(bits).alias("bits"))
    blocks = materialize(blocks_of(usable, "key", "bits", rows), "blocks")
    near = blocks.select("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("other"))
    near = near.join(blocks.select(F.col("block").alias("other")), "other", "left_semi")
    first = materialize(_compared(blocks, near, k, None), "near")
    kept = top_k(first, ["block", "key"], [F.col("similarity").desc(), F.col("other_key")], k)
    worst = kept.where(F.col("rank") == k).groupBy("block").agg(F.min("similarity").alias("least"), F.count("*").alias("full"))
    size = F.size("keys")
    bound = blocks.join(worst, "block", "left").select("block", "low", "high", "union", "shared", F.when(F.col("full") == size, F.col("least")).otherwise(0.0).alias("least"))
    a = bound.select("block", *[F.col(c).alias(f"a_{c}") for c in ("low", "high", "union", "shared")], "least")
    b = bound.select(F.col("block").alias("other"), *[F.col(c).alias(f"b_{c}") for c in ("low", "high", "union", "shared")])
    # similar enough sets have from least * n to n / least bits; without a bound all that have a bit
    most = bound.agg(F.max("high").alias("most"))  # one row
    reach = a.crossJoin(F.broadcast(most)).withColumn("n", F.explode(F.sequence(F.ceil(F.col("least") * F.col("a_low") - 1e-9).cast("int"), F.when(F.col("least") > 0, F.least(F.col("most"), F.floor(F.col("a_high") / F.col("least") + 1e-9).cast("int"))).otherwise(F.col("most")))))
    meet = reach.drop("most").join(b.withColumn("n", F.explode(F.sequence("b_low", "b_high"))), "n").where(F.abs(F.col("block") - F.col("other")) > 1)
    pairs = meet.drop("n").dropDuplicates(["block", "other"]).where(_bound("a", "b") >= F.col("least") - 1e-9).select("block", "other")
    pairs = materialize(pairs, "pairs")
    scores = kept.groupBy("block").agg(F.collect_list(F.struct("key", "similarity", "rank")).alias("scores"))
    more = _compared(blocks, pairs, k, scores.select("block", F.map_from_entries(F.transform(F.filter("scores", lambda s: s["rank"] == k), lambda s: F.struct(s.key, s.similarity))).alias("least")))
    found = top_k(first.unionAll(more), ["key"], [F.col("similarity").desc(), F.col("other_key")], k)
    return found.select("key", F.col("other_key").alias("other"), "similarity", "rank"), near.select("block", "other").unionAll(pairs)


def _compared(blocks: DataFrame, pairs: DataFrame, k: int, least: DataFrame | None) -> DataFrame:
    """(block, key, other_key, similarity): the k best of each set of a block in the other block of a pair, of at least its bound."""
    own = blocks.select("block", "keys", "words") if least is None else blocks.select("block", "keys", "words").join(least, "block", "left")
    bound = F.lit(None).cast("array<double>") if least is None else F.transform("keys", lambda x: F.try_element_at("least", x))
    both = pairs.join(own.select("block", "keys", "words", bound.alias("least")), "block").join(blocks.select(F.col("block").alias("other"), F.col("keys").alias("other_keys"), F.col("words").alias("other_words")), "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                block, keys, words, bounds, others, theirs = (b.column(j).slice(i, 1) for j in range(6))
                ids, other_ids = keys.flatten().to_numpy(), others.flatten().to_numpy()
                low = np.nan_to_num(bounds.flatten().to_numpy(zero_copy_only=False).astype(float)) if bounds.is_valid()[0].as_py() else np.zeros(len(ids))
                made = _best(ids, _words(words, len(ids)), other_ids, _words(theirs, len(other_ids)), k, low)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made[0]), block[0].as_py())), *(pa.array(c) for c in made)], names=["block", "key", "other_key", "similarity"])

    # pairs are few bytes and much work: without a stated number of partitions Spark would leave them to one task
    dealt = both.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "other")
    return dealt.select("block", "keys", "words", "least", "other_keys", "other_words").mapInArrow(run, "block long, key long, other_key long, similarity double")
