"""Per-group standardization, ranks, top-k, list merges and rank fusion."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import materialize


def zscore(x: Column, group: list[str], eps: float = 1e-6) -> Column:
    """(x - mean) / (population deviation + eps) within the group."""
    w = Window.partitionBy(*group)
    return (x - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + F.lit(eps))


def zscore_or_zero(x: Column, group: list[str], least: float = 1e-12) -> Column:
    """(x - mean) / population deviation, 0 where the deviation is at most `least`."""
    w = Window.partitionBy(*group)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > least, (x - F.avg(x).over(w)) / sd).otherwise(F.lit(0.0))


def capped_rank(x: Column, group: list[str], cap: int = 50) -> Column:
    """Rank from 0 by falling x, ties sharing the best, at most cap."""
    return F.least(F.rank().over(Window.partitionBy(*group).orderBy(x.desc())) - 1, F.lit(cap)).cast("long")


def with_capped_rank(df: DataFrame, group: list[str], value: str, name: str, cap: int = 50) -> DataFrame:
    """df with capped_rank of a column, for groups of any size: no task holds a group's rows.

    Only the cap + 1 greatest distinct values of a group have ranks under the cap: these are counted and met by equality,
    all others have the cap. Null groups are one group, null values come last.
    """
    keys = [*group, value]
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*group).orderBy(F.col(value).desc())
    first = top_k(counted, group, [F.col(value).desc()], cap + 1, "_place")
    ranks = first.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    return df.join(ranks, same, "left").select(*df.columns, F.least(F.coalesce("_above", F.lit(cap)), F.lit(cap)).cast("long").alias(name))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their rank from 1 as a long."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def best_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in a total order, in no order of their own."""
    return top_k(df, group, order, k, "_place").drop("_place")


def sorted_positions(df: DataFrame, keep: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Position from 1 in a full sort by `order`: a range partition, positions within its parts, and the parts' sizes.

    Ranges come from a sample, so rows are written with their part before parts are counted.
    """
    columns = list(dict.fromkeys([*keep, *order]))
    parts = materialize(df.select(*columns).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").count()  # as many rows as partitions
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_n", n).join(F.broadcast(before), "_part").select(*keep, (F.col("_n") + F.col("_before")).alias(name))


def slot_rerank(df: DataFrame, query: str, position: str, group: str, score: str) -> DataFrame:
    """Members of a group of a query trade places among the group's own positions, best score first; a null group stays.

    Ties keep the order of position. Returns all columns with new_position.
    """
    by = Window.partitionBy(query, group)
    slots = df.withColumn("_slot", F.row_number().over(by.orderBy(position))).select(query, group, "_slot", F.col(position).alias("new_position"))
    ranked = df.withColumn("_slot", F.row_number().over(by.orderBy(F.col(score).desc(), position)))
    moved = ranked.where(F.col(group).isNotNull()).join(slots.where(F.col(group).isNotNull()), [query, group, "_slot"]).select(*df.columns, "new_position")
    return moved.unionByName(df.where(F.col(group).isNull()).withColumn("new_position", F.col(position)))


def gated_refill(df: DataFrame, query: str, position: str, movable: Column, gate: Column, score: str, bonus: Column, head: int = 60) -> DataFrame:
    """Movable rows among the first `head` positions are dealt anew over their own positions by z-score plus a bonus.

    Only where the gate holds and a query has two such rows or more; ties keep the old order.
    """
    flagged = df.withColumn("_g", F.when(gate & movable & (F.col(position) <= head), F.lit("m")))
    w = Window.partitionBy(query, "_g")
    flagged = flagged.withColumn("_z", (F.col(score) - F.avg(score).over(w)) / (F.stddev_pop(score).over(w) + 1e-6) + bonus)
    return slot_rerank(flagged, query, position, "_g", "_z").drop("_g", "_z")


def ordered_union(lists: list[DataFrame], query: str, item: str, position: str, k: int) -> DataFrame:
    """Lists one after another, each item at its first place, cut to k: query, item, place (from 1)."""
    parts = [df.select(query, item, F.lit(i).alias("_list"), F.col(position).alias("_p")) for i, df in enumerate(lists)]
    first = reduce(DataFrame.unionAll, parts).groupBy(query, item).agg(F.min(F.struct("_list", "_p")).alias("_at"))
    return top_k(first, [query], [F.col("_at"), F.col(item)], k, "place").drop("_at")


def segment_merge(a: DataFrame, b: DataFrame, tight: DataFrame, query: str, item: str, position: str, k: int) -> DataFrame:
    """The first tight_count items of a, then b, then the rest of a; each item at its first place, cut to k."""
    t = a.join(tight, query, "left").withColumn("_list", F.when(F.col(position) <= F.coalesce("tight_count", F.lit(0)), 0).otherwise(2))
    parts = t.select(query, item, "_list", F.col(position).alias("_p")).unionAll(b.select(query, item, F.lit(1), F.col(position)))
    first = parts.groupBy(query, item).agg(F.min(F.struct("_list", "_p")).alias("_at"))
    return top_k(first, [query], [F.col("_at"), F.col(item)], k, "place").drop("_at")


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, query: str, item: str, position: str, k: float, weight: float, depth: int) -> DataFrame:
    """1 / (k + rank in a) + weight / (k + rank in b) over the first `depth` of each; ties by the rank in a, then the item."""
    left = a.where(F.col(position) <= depth).select(query, item, F.col(position).alias("_ra"))
    right = b.where(F.col(position) <= depth).select(query, item, F.col(position).alias("_rb"))
    both = left.join(right, [query, item], "full")
    score = F.coalesce(1.0 / (k + F.col("_ra")), F.lit(0.0)) + F.coalesce(weight / (k + F.col("_rb")), F.lit(0.0))
    scored = both.withColumn("score", score)
    order = [F.col("score").desc(), F.col("_ra").asc_nulls_last(), F.col(item)]
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order)).cast("long")).select(query, item, "score", "place")


def insert_top(a: DataFrame, b: DataFrame, query: str, item: str, position: str, at: int = 2) -> DataFrame:
    """b's first item at place `at` of a, unless a has it by then already: query, item, place."""
    best = b.where(F.col(position) == 1).select(query, F.col(item).alias("_best"))
    joined = a.join(best, query, "left")
    early = F.max(F.when((F.col(item) == F.col("_best")) & (F.col(position) <= at), 1).otherwise(0)).over(Window.partitionBy(query)) == 1
    joined = joined.withColumn("_early", early)
    rest = joined.where(F.col("_early") | F.col("_best").isNull() | (F.col(item) != F.col("_best"))).select(query, item, F.when(F.col("_early") | F.col("_best").isNull() | (F.col(position) < at), F.col(position) * 2).otherwise(F.col(position) * 2 + 1).alias("_key"))
    added = joined.where(~F.col("_early") & F.col("_best").isNotNull()).select(query, F.col("_best").alias(item), F.lit(2 * at).cast("long").alias("_key")).distinct()
    order = Window.partitionBy(query).orderBy("_key", item)
    return rest.unionAll(added).withColumn("place", F.row_number().over(order).cast("long")).drop("_key")


def slot_interleave(a: DataFrame, b: DataFrame, query: str, item: str, position: str, slots: list[int], n: int) -> DataFrame:
    """Places 1 to n of each query: the slots take b's items in order, the others a's; where one runs out the other goes on.

    Places follow from counts alone: b's r-th item takes the r-th slot if a can fill what stands before it, else the place
    behind all of a; a's k-th item stands behind the items of b whose slots need fewer of a than k. Duplicates between the
    lists are not looked for.
    """
    own = Window.partitionBy(query)
    both = a.where(F.col(position) <= n).select(query, item, F.lit(0).alias("_list"), F.col(position).alias("_p"))
    both = both.unionAll(b.where(F.col(position) <= len(slots)).select(query, item, F.lit(1), F.col(position)))
    both = both.withColumn("_r", F.row_number().over(Window.partitionBy(query, "_list").orderBy("_p", item)))
    both = both.withColumns({f"_n{k}": F.count(F.when(F.col("_list") == k, 1)).over(own) for k in (0, 1)}).where((F.col("_list") == 0) | (F.col("_r") <= len(slots)))
    before = [slot - r for r, slot in enumerate(sorted(slots), 1)]  # items of a that each slot needs before it
    needs = F.array(*map(F.lit, before)) if before else F.array().cast("array<int>")
    taken = F.size(F.filter(F.slice(needs, F.lit(1), F.greatest(F.least(F.col("_n1"), F.lit(len(slots))), F.lit(0)).cast("int")), lambda x: x < F.col("_r")))
    place = F.when(F.col("_list") == 0, F.col("_r") + taken).otherwise(F.least(F.get(needs, F.col("_r") - 1), F.col("_n0")) + F.col("_r"))
    return both.select(query, item, place.cast("long").alias("place")).where(F.col("place") <= n)


def threshold_merge(a: DataFrame, b: DataFrame, query: str, item: str, score: str, n: int, margin: float = 0.0) -> DataFrame:
    """Two lists in their orders of falling score: b's next goes in where it beats a's next by more than the margin.

    As both fall, that is one order by score, a's raised by the margin and first among equals; an item that comes again is
    passed over.
    """
    # n places take 2 * n of a list at most, as only items of the other list are passed over
    part = lambda df, k: best_k(df.select(query, item, score), [query], [F.col(score).desc(), F.col(item)], 2 * n).withColumn("_list", F.lit(k))
    both = part(a, 0).unionAll(part(b, 1)).withColumn("_key", F.when(F.col("_list") == 0, F.col(score) + F.lit(float(margin))).otherwise(F.col(score)))
    order = [F.col("_key").desc(), F.col("_list"), F.col(score).desc(), F.col(item)]
    first = both.withColumn("_again", F.row_number().over(Window.partitionBy(query, item).orderBy(*order))).where("_again = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order)).cast("long")).where(F.col("place") <= n).select(query, item, "place")


def log_sum_exp(x: Column, group: list[str]) -> Column:
    """log of the sum of exp(x) within a group, safe for large x."""
    w = Window.partitionBy(*group)
    most = F.max(x).over(w)
    return most + F.ln(F.sum(F.exp(x - most)).over(w))


def boltzmann_merge(a: DataFrame, b: DataFrame, query: str, item: str, score: str, t1: float, t2: float, share: Column, k: int, gate: DataFrame | None = None) -> DataFrame:
    """Both lists as one by log-probability: (1 - share) softmax(score / t1) and share softmax(score / t2); the first k.

    share: a column of a's and b's rows between 0 and 1. gate: query and open; closed queries keep list a alone. An item in
    both lists counts twice, as two candidates. Ties: list a first, then the item.
    """
    one = a.withColumn("_e", F.col(score) / t1).withColumn("_l", F.col("_e") - log_sum_exp(F.col("_e"), [query]) + F.ln(1 - share)).withColumn("_list", F.lit(0))
    two = b.withColumn("_e", F.col(score) / t2).withColumn("_l", F.col("_e") - log_sum_exp(F.col("_e"), [query]) + F.ln(share)).withColumn("_list", F.lit(1))
    if gate is not None:
        two = two.join(gate.where("open"), query, "left_semi")
    both = one.select(query, item, "_l", "_list").unionAll(two.select(query, item, "_l", "_list"))
    return top_k(both, [query], [F.col("_l").desc(), F.col("_list"), F.col(item)], k, "place").select(query, item, F.col("_l").alias("log_p"), "place")


def mmr(df: DataFrame, query: str, item: str, position: str, vector: str, k: int, weight: float) -> DataFrame:
    """Maximal marginal relevance: the first item stays; then argmax of (1 - weight) * relevance - weight * greatest cosine
    similarity to those taken. Relevance falls evenly from 1 to 0 over the list; ties keep its order."""
    import numpy as np

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([position, item])
        x = np.array([np.asarray(v, float) for v in pdf[vector]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rel, taken = np.linspace(1, 0, len(x)), [0]
        near = x @ x[0]
        while len(taken) < min(k, len(x)):
            value = (1 - weight) * rel - weight * near
            value[taken] = -np.inf
            best = int(np.argmax(value))
            taken.append(best)
            near = np.maximum(near, x @ x[best])
        return pd.DataFrame({query: pdf[query].iloc[0], item: pdf[item].iloc[taken].to_list(), "place": range(1, len(taken) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(query).applyInPandas(pick, f"{query} {kinds[query]}, {item} {kinds[item]}, place long")
