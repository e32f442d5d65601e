"""Retrieval evaluation over (query, candidate, score, is_truth) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def truth_standing(df: DataFrame, query: str, score: str, truth: str) -> DataFrame:
    """Per query: n, better (scores over the truth's), tied (others that equal it); null counts where no truth is among them.

    The truth's score is a window over the query, which the aggregation's partitioning then serves: one scan, one shuffle.
    """
    rows = df.withColumn("_t", F.max(F.when(F.col(truth), F.col(score))).over(Window.partitionBy(query)))
    known = F.max("_t").isNotNull()
    return rows.groupBy(query).agg(
        F.count("*").alias("n"),
        F.when(known, F.count_if(F.col(score) > F.col("_t"))).alias("better"),
        F.when(known, F.count_if(F.col(score) == F.col("_t")) - 1).alias("tied"),
    )


def mean_reciprocal_rank(standing: DataFrame, k: int, ties: str) -> DataFrame:
    """One row: mrr over all queries, a query without truth or beyond k counting 0.

    ties "pessimistic": tied candidates stand before the truth; "averaged": half of them do, gated on better < k.
    """
    rank = F.col("better") + 1 + (F.col("tied") if ties == "pessimistic" else F.col("tied") / 2)
    inside = rank <= k if ties == "pessimistic" else F.col("better") < k
    return standing.agg(F.avg(F.when(inside, 1.0 / rank).otherwise(F.lit(0.0))).alias("mrr"))


def hit_rates(standing: DataFrame, ks: list[int]) -> DataFrame:
    """Share of queries whose truth is among the first k, ties against it."""
    rank = F.col("better") + F.col("tied") + 1
    return standing.agg(*[F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias(f"top{k}") for k in ks])


def recall_summary(standing: DataFrame, ks: list[int]) -> DataFrame:
    """mrr_in (queries that hold their truth), mrr_all, recall at each k over all, and the upper median rank."""
    rank = F.col("better") + 1
    ranks = F.array_sort(F.collect_list(rank))
    return standing.agg(
        F.avg(1.0 / rank).alias("mrr_in"),
        F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr_all"),
        *[F.avg(F.when(rank <= k, 1.0).otherwise(0.0)).alias(f"recall{k}") for k in ks],
        F.try_element_at(ranks, (F.floor(F.size(ranks) / 2) + 1).cast("int")).cast("long").alias("median_rank"),
    )


def paired_error(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean difference b - a, and its standard error."""
    d = F.col(b) - F.col(a)
    return df.agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("standard_error"))
