"""Aggregations with payloads, profiles, histograms and document frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.rank import sorted_positions
from quern.storage import materialize


def first_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row per key, the first in a total order, without a window: a struct minimum combines before the shuffle."""
    parts = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    return df.groupBy(*keys).agg(F.min(F.struct(*parts, *[F.col(c) for c in keep])).alias("_m")).select(*keys, *[F.col(f"_m.{c}") for c in keep])


def profile(df: DataFrame, key: str, category: str, value: str, exact: bool = False) -> DataFrame:
    """Rows, mean of value (exact: the total instead) and the counts of each category as text ("a:3;b:1", by category), per key."""
    per = df.groupBy(key, category).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(category, "n"))), lambda x: F.concat_ws(":", x[category], x["n"].cast("string"))), ";")
    measure = F.sum("s").alias("total") if exact else (F.sum("s") / F.sum("n")).alias("mean_value")
    return per.groupBy(key).agg(F.sum("n").alias("n_rows"), measure, text.alias("categories"))


def exact_quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """groups, n and a column for each share: exact quantiles with linear interpolation, of groups of any size.

    All values are sorted once over all tasks; a quantile is read at its one or two places in its group's part of that
    order, so no task holds the values of a group. Nulls don't count.
    """
    order = [*groups, value]
    placed = materialize(sorted_positions(df.where(F.col(value).isNotNull()), order, order, "_at"), "placed")
    counted = placed.groupBy(*groups).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    places = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("x")) for name, p in shares.items()])
    asked = counted.withColumn("_q", F.explode(places)).select(*groups, "n", "_first", "_q.name", F.col("_q.x").alias("_x"), F.floor("_q.x").alias("_low"))
    weight = F.when(F.col("_step") == 0, 1 - (F.col("_x") - F.col("_low"))).otherwise(F.col("_x") - F.col("_low"))
    asked = asked.withColumn("_step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_weight", weight).withColumn("_at", F.col("_first") + F.col("_low") + F.col("_step")).where("_weight > 0")
    read = asked.select(*groups, "n", "name", "_weight", "_at").join(placed.select("_at", value), "_at")
    return read.groupBy(*groups, "n").agg(*[F.sum(F.when(F.col("name") == name, F.col("_weight") * F.col(value))).alias(name) for name in shares])


def clamped_histogram(df: DataFrame, value: str, most: int) -> DataFrame:
    return df.groupBy(F.least(F.col(value), F.lit(most)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def document_frequency(df: DataFrame, key: str, items: Column, least: int, n: int) -> DataFrame:
    """The n items that stand in most rows, of those in at least `least` rows; ties by the item."""
    rows = df.select(key, F.explode(F.array_distinct(items)).alias("item"))
    return rows.groupBy("item").agg(F.count("*").alias("df")).where(F.col("df") >= least).orderBy(F.col("df").desc(), "item").limit(n)


def binary_entropy(p: Column) -> Column:
    """Entropy of a share in bits; 0 at 0 and 1."""
    return F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(F.lit(0.0))


def mean_feature_entropy(df: DataFrame, group: str, row: str, feature: str) -> DataFrame:
    """For each feature the mean over groups of the entropy of its share among the group's rows."""
    sizes = df.groupBy(group).agg(F.countDistinct(row).alias("_n"))
    groups = sizes.agg(F.count("*").alias("_groups"))  # one row
    share = df.select(group, row, feature).distinct().groupBy(group, feature).agg(F.count("*").alias("_c")).join(sizes, group)
    return share.groupBy(feature).agg(F.sum(binary_entropy(F.col("_c") / F.col("_n"))).alias("_h")).crossJoin(F.broadcast(groups)).select(feature, (F.col("_h") / F.col("_groups")).alias("entropy"))


def smoothed_log_prior(df: DataFrame, category: str, hit: str, alpha: float) -> DataFrame:
    """log((hits + alpha * p0) / (n + alpha)) per category, where p0 = (all hits + 1) / (all rows + 1)."""
    per = df.groupBy(category).agg(F.sum(hit).alias("_h"), F.count("*").alias("_n"))
    whole = per.agg(((F.sum("_h") + 1) / (F.sum("_n") + 1)).alias("_p0"))  # one row
    return per.crossJoin(F.broadcast(whole)).select(category, F.ln((F.col("_h") + alpha * F.col("_p0")) / (F.col("_n") + alpha)).alias("log_prior"))


def surrogate_ids(df: DataFrame, key: str, name: str = "uid") -> DataFrame:
    """A dense id from 0 for each distinct key in ascending order: counts per range of keys, then ids within each range.

    Ranges come from a sample and would differ from run to run, so rows are written with theirs before they are counted.
    """
    keys = materialize(df.select(key).distinct().repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r._part: r["count"] for r in keys.groupBy("_part").count().collect()}  # as many rows as partitions
    start, held = 0, {}
    for part in sorted(sizes):
        held[part] = start
        start += sizes[part]
    n = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    offset = F.create_map(*[F.lit(x) for k, v in (held or {0: 0}).items() for x in (k, v)])
    return keys.withColumn(name, (n + offset[F.col("_part")]).cast("long")).select(key, name)
