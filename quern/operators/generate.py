"""Enumeration: chains of operations that hit a difference, bounded compositions and their counts."""

from __future__ import annotations

import sys
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import formulas
from quern.operators.joins import absolute_band_join
from quern.storage import materialize


#: Operations whose pairs `chains` makes; one side is broadcast.
MOST_OPS = 4096


def chains(queries: DataFrame, ops: DataFrame, query: str, delta: str, op: str, shift: str, tol: float) -> DataFrame:
    """Chains of one or two operations whose shifts sum to delta within tol: query, first, second (null), total.

    Two-step chains are unordered (first <= second) and never an operation with its exact opposite. ops: at most MOST_OPS
    rows, more are an error; their pairs are made once, and the queries meet the sums in a band join.
    """
    if ops.limit(MOST_OPS + 1).count() > MOST_OPS:
        raise ValueError(f"over {MOST_OPS} operations")
    one = ops.select(F.col(op).alias("first"), F.lit(None).cast(ops.schema[op].dataType).alias("second"), F.col(shift).alias("total"))
    a, b = ops.select(F.col(op).alias("first"), F.col(shift).alias("_x")), ops.select(F.col(op).alias("second"), F.col(shift).alias("_y"))
    two = F.broadcast(a).join(b, F.col("first") <= F.col("second")).where(F.abs(F.col("_x") + F.col("_y")) > 1e-9).select("first", "second", (F.col("_x") + F.col("_y")).alias("total"))
    return absolute_band_join(queries, one.unionAll(two), delta, "total", tol).select(query, "first", "second", "total")


def compositions(targets: DataFrame, key: str, mass: str, units: dict[str, float], most: dict[str, int], tol: float) -> DataFrame:
    """Counts of units (each from 0 to its maximum) whose masses sum to the target within tol, one row per solution.

    All counts but the last unit's come from an explode that stops at the remaining mass; the last's follow by division, one
    more on either side for the rounding. A unit's multiple is its decimal text's, rounded once; multiples are taken from the
    mass in the units' order, and what is left then is judged. Null and non-finite masses have no solution.
    """
    names = list(units)
    multiple = lambda name: (F.col(name) * F.lit(Decimal(repr(float(units[name]))))).cast("double")
    upto = lambda name: F.least(F.lit(most[name]).cast("double"), F.floor((F.col("_left") + tol) / units[name]) + 1).cast("int")
    rows = targets.select(key, F.col(mass).cast("double").alias("_left")).where(F.col("_left").between(-tol, sys.float_info.max))
    for name in names[:-1]:
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), upto(name)))).withColumn("_left", F.col("_left") - multiple(name)).where(F.col("_left") >= -tol)
    last = names[-1]
    least = F.greatest(F.ceil((F.col("_left") - tol) / units[last]) - 1, F.lit(0).cast("long"))
    rows = rows.withColumn("_least", least).where(F.col("_least") <= most[last])
    rows = rows.withColumn(last, F.explode(F.sequence(F.col("_least").cast("int"), F.greatest(F.col("_least").cast("int"), upto(last)))))
    return rows.where(F.abs(F.col("_left") - multiple(last)) <= tol).select(key, *names)


def sub_compositions(rows: DataFrame, key: str, counts: dict[str, str], units: dict[str, float], mass: str, tol: float) -> DataFrame:
    """How many sub-multisets of a row's units weigh `mass` within tol: key, n. counts: unit -> column of its number.

    The units before the last are exploded up to the row's own counts; for the last the fitting numbers follow by division.
    """
    names = list(units)
    df = rows.select(key, F.col(mass).alias("_left"), *[F.col(c).alias(f"_n_{u}") for u, c in counts.items()])
    for u in names[:-1]:
        df = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col(f"_n_{u}").cast("int")))).withColumn("_left", F.col("_left") - F.col("_k") * F.lit(units[u]))
        df = df.where(F.col("_left") >= -tol)
    u = names[-1]
    low = F.greatest(F.ceil((F.col("_left") - tol) / units[u]), F.lit(0).cast("long"))
    high = F.least(F.floor((F.col("_left") + tol) / units[u]), F.col(f"_n_{u}").cast("long"))
    found = df.groupBy(key).agg(F.sum(F.greatest(high - low + 1, F.lit(0).cast("long"))).alias("n"))
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def composition_counts(rows: DataFrame, key: str, counts: dict[str, str], units: dict[str, int], mass: str, tol: int = 0) -> DataFrame:
    """key, n: how many sub-multisets of a row's units have a whole mass from mass - tol to mass + tol; counts: unit -> column of its number.

    A table of counts by mass is folded unit by unit: with m and k of a unit, entry x becomes the sum of the entries x - j * m,
    j from 0 to k. The table is as long as the wanted mass, whatever the count. Rows with the same numbers are worked out once;
    null or negative numbers count 0, a null mass or one below -tol gives 0. Counts beyond a long are an error under ANSI rules.
    """
    names = list(units)
    number = [F.greatest(F.coalesce(F.col(counts[u]).cast("long"), F.lit(0)), F.lit(0)).alias(f"_n_{u}") for u in names]
    asked = rows.select(key, *number, F.coalesce(F.col(mass).cast("long"), F.lit(-tol - 1)).alias("_m"))
    same = [*(f"_n_{u}" for u in names), "_m"]
    top = F.col("_m") + tol
    table = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(top, F.lit(0))), lambda x: F.when(x == 0, 1).otherwise(0).cast("long"))
    own = F.array(*[F.struct(F.lit(units[u]).cast("long").alias("m"), F.col(f"_n_{u}").alias("n")) for u in names])

    def folded(held: Column, unit: Column) -> Column:
        none, step = F.lit(0).cast("long"), lambda i: F.sequence(F.lit(0).cast("long"), F.least(unit.n, F.floor(i / unit.m)))
        return F.transform(held, lambda _, i: F.aggregate(step(i), none, lambda total, j: total + F.get(held, (i - j * unit.m).cast("int"))))

    distinct = asked.select(*same).distinct().withColumn("_t", F.aggregate(own, table, folded))
    first = F.greatest(F.col("_m") - tol, F.lit(0))
    found = F.aggregate(F.slice("_t", (first + 1).cast("int"), (top - first + 1).cast("int")), F.lit(0).cast("long"), lambda total, x: total + x)
    solved = distinct.select(*same, F.when(top >= 0, found).otherwise(0).alias("n"))
    return asked.join(solved, same).select(key, "n")


def generated_products(analogs: DataFrame, ops: DataFrame, query: str, units: str, similarity: str, rank: str, op: str, change: str) -> DataFrame:
    """query, product, best_sim, best_rank, n_ops, support: formulas that operations make of a query's analogs, folded by their keys.

    analogs: query, units (see functions.formulas), similarity and rank; ops: at most MOST_OPS operations with the units that
    they add or, where negative, take away; products that lack a unit that is taken away don't arise. Analogs of one formula
    are folded before they meet the operations; support counts all of them. An unknown similarity or rank counts for neither.
    A formula's products are worked out once, however many queries have it, and a query's folded analogs are shuffled, not its products.
    """
    if ops.limit(MOST_OPS + 1).count() > MOST_OPS:
        raise ValueError(f"over {MOST_OPS} operations")
    few = analogs.where(F.col(units).isNotNull()).groupBy(query, units).agg(F.max(similarity).alias("_sim"), F.min(rank).alias("_rank"), F.count("*").alias("_n"))
    few = materialize(few, "analogs")
    changes = F.broadcast(ops.select(F.col(op).alias("_op"), F.col(change).alias("_change")))
    made = few.select(units).distinct().crossJoin(changes).withColumn("_made", formulas.added(F.col(units), F.col("_change"))).where("_made IS NOT NULL")
    products = materialize(made.select(units, "_op", formulas.key(F.col("_made")).alias("product")), "products")
    keyed = few.repartition(query).join(products, units).groupBy(query, "product", "_op").agg(F.max("_sim").alias("_sim"), F.min("_rank").alias("_rank"), F.sum("_n").alias("_n")).groupBy(query, "product")
    return keyed.agg(F.max("_sim").alias("best_sim"), F.min("_rank").alias("best_rank"), F.count("_op").alias("n_ops"), F.sum("_n").alias("support"))


def multisets(units: dict[str, float], most: dict[str, int], heaviest: float, keep: Callable[[], Column] | None, spark) -> DataFrame:
    """All numbers of the units up to their maxima that weigh at most `heaviest` and pass keep: a column each, and mass.

    Its size depends on the units alone. Numbers are added unit by unit, and what is too heavy goes at once.
    """
    rows = spark.range(1).select(F.lit(0.0).alias("mass"))
    for u, m in units.items():
        rows = rows.withColumn(u, F.explode(F.sequence(F.lit(0), F.lit(min(most[u], int(heaviest // m)))))).withColumn("mass", F.col("mass") + F.col(u) * F.lit(m)).where(F.col("mass") <= heaviest)
    return rows.where(keep()) if keep else rows


def ruled_compositions(targets: DataFrame, key: str, mass: str, halves: tuple[dict[str, float], dict[str, float]], most: dict[str, int], tol: float, rules: tuple[Callable[[], Column], Callable[[], Column], Callable[[], Column]]) -> DataFrame:
    """key and numbers of units whose masses sum to the target within tol and that pass the rules, one row per solution.

    The units are cut into halves, whose tables meet in the middle: each distinct target takes the first half's rows up to its
    mass, and what is left meets the second half's rows in a band join. rules: those of the first half, of the second, and those
    over both. Tables depend on the units alone; targets that are null, or not positive, have no solution.
    """
    spark = targets.sparkSession
    wanted = targets.select(F.col(mass).cast("double").alias("_m")).where("_m > 0").distinct()
    top = wanted.agg(F.max("_m")).first()[0]
    names = [*halves[0], *halves[1]]
    if top is None:
        return targets.select(key, *[F.lit(0).alias(n) for n in names]).where("false")
    first, second = (materialize(multisets(h, most, top + tol, r, spark).withColumnRenamed("mass", f"_mass{k}"), "half") for k, (h, r) in enumerate(zip(halves, rules[:2], strict=True)))
    # a target takes the rows of the first half up to its mass, by buckets of mass
    step = max(tol, top / 64)
    bucket = F.floor(F.col("_mass0") / step)
    started = wanted.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") + tol) / step)))).join(first.withColumn("_b", bucket), "_b").where(F.col("_mass0") <= F.col("_m") + tol)
    left = started.withColumn("_left", F.col("_m") - F.col("_mass0"))
    met = absolute_band_join(left, second, "_left", "_mass1", tol).where(F.abs(F.col("_m") - (F.col("_mass0") + F.col("_mass1"))) <= tol).where(rules[2]())
    return targets.join(met.select(F.col("_m"), *names), F.col(mass).cast("double") == F.col("_m")).select(key, *names)


def log_posterior(df: DataFrame, query: str, source: str, candidate: str, weight: str, temperature: float) -> DataFrame:
    """Candidates of several sources as one distribution per query: log-softmax of log(weight summed over sources) / T."""
    per = df.groupBy(query, candidate).agg(F.sum(weight).alias("_w"), F.countDistinct(source).alias("n_sources")).where("_w > 0")
    x = F.ln("_w") / temperature
    w = Window.partitionBy(query)
    most = F.max("_x").over(w)
    return per.withColumn("_x", x).withColumn("log_p", F.col("_x") - most - F.ln(F.sum(F.exp(F.col("_x") - most)).over(w))).select(query, candidate, "n_sources", "log_p")


def hydrogen_shifts(pieces: DataFrame, mass: str, step: float, reach: int = 2) -> DataFrame:
    """Each piece's mass moved by -reach to reach steps: adds shift and shifted."""
    moved = pieces.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    return moved.withColumn("shifted", F.col(mass) + F.col("shift") * F.lit(step))


def explained_share(peaks: DataFrame, candidates: DataFrame, query: str, value: str, intensity: str, mass: str, tol: float) -> DataFrame:
    """Per query: the share of peaks, and of intensity, within tol of some candidate mass of the same query."""
    size = F.lit(2.0 * tol)
    windows = peaks.withColumn("_row", F.monotonically_increasing_id()).withColumn("_w", F.explode(F.sequence(F.floor((F.col(value) - tol) / size), F.floor((F.col(value) + tol) / size))))
    masses = candidates.select(query, F.col(mass).alias("_m"), F.floor(F.col(mass) / size).alias("_w"))
    hit = windows.join(masses, [query, "_w"], "left").groupBy(query, "_row").agg(F.max(intensity).alias("_i"), F.max(F.coalesce(F.abs(F.col("_m") - F.col(value)) <= tol, F.lit(False))).alias("_hit"))
    flag: Column = F.col("_hit").cast("double")
    return hit.groupBy(query).agg(F.avg(flag).alias("share_peaks"), (F.sum(flag * F.col("_i")) / F.sum("_i")).alias("share_intensity"))


def absorbing_chain(edges: DataFrame, starts: DataFrame, graph: str, source: str, target: str, share: str, node: str, depth: int, keep_last: bool = False) -> DataFrame:
    """graph, node, observed: how much of a unit of mass at each start is seen at a node after `depth` steps at most.

    A step moves a node's mass along its edges by their shares; what the shares leave is observed there. Mass that is still
    moving after the last step is lost, or with keep_last observed where it is. Every step is a join and a sum over nodes,
    so paths are never listed.
    """
    out = edges.groupBy(graph, F.col(source).alias(node)).agg(F.sum(share).alias("_out"))
    moving, seen = starts.groupBy(graph, node).agg(F.count("*").cast("double").alias("_mass")), None
    for step in range(depth + 1):
        moving = materialize(moving, "moving")
        stays = F.lit(1.0) if keep_last and step == depth else 1 - F.coalesce("_out", F.lit(0.0))
        now = moving.join(out, [graph, node], "left").select(graph, node, (F.col("_mass") * stays).alias("_seen"))
        seen = now if seen is None else seen.unionAll(now)
        moved = moving.withColumnRenamed(node, source).join(edges, [graph, source])
        moving = moved.groupBy(graph, F.col(target).alias(node)).agg(F.sum(F.col("_mass") * F.col(share)).alias("_mass"))
    return seen.groupBy(graph, node).agg(F.sum("_seen").alias("observed")).where("observed > 0")
