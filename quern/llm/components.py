"""Connected components of a link table, by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, rehashed


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least one around it."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    out = rehashed(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    out = rehashed(down, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with a link: label is the least node reachable, itself included.

    edges: two long columns u and v. Self-links and repeated links change nothing; an empty table gives an empty one. Each
    round's links are written to the shared folder, so a lost executor costs one round at most. Rounds go on until the links
    settle, which they do in about the square of the logarithm of their number.
    """
    edges = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "links")
    mark = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = now
