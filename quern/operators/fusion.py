"""Feature vectors and fused scores of candidates, by windows over each query's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import by_rows

# Weights of the hand-made score over the standardized model scores, the library score's power and the generation terms.
HAND_MODELS = {"phys": 1.0, "mlp": 0.25, "rev": 1.0}
HAND_LIBRARY, HAND_POWER, HAND_ANALOG = 8.0, 32.0, 24.0
HAND_GENERATION = (-2.0, 0.0, -1.0, 4.0, 0.0, 1.5)

#: The raw columns of a candidate and of its query.
RAW = ("phys", "mlp", "rev", "lib", "ana", "a_cos", "a_mcos", "a_shift2", "a_shift4", "a_pairs", *(f"g{k}" for k in range(6)), "error")
META = ("n_records", "mass", "polarity", "category", "instrument")

#: Ranks and errors count up to this.
MOST = 50


def standardized(x: Column, query: str, eps: float = 1e-6) -> Column:
    """(x - mean) / (population deviation + eps) within the query; null where x is, which counts neither in the mean."""
    own = Window.partitionBy(query)
    return (x - F.avg(x).over(own)) / (F.stddev_pop(x).over(own) + F.lit(eps))


def feature_vectors(df: DataFrame, query: str, keep: list[str], digits: int = 9) -> DataFrame:
    """query, keep and 48 features of each candidate from RAW and META: three stages of windows over one shuffle by query,
    with more tasks the more rows there are.

    Of each model score: standardized, rank from 0 (ties share the best, at most MOST), rank by the number of others, and the
    distance to the best. Of the hand score, the model part of it, the library and the analog score: value, rank, distance to the
    best where it has one. Of the query: best and second library score, how many reach 0.8, the best analog score, size, share
    of generated candidates, and META. Fused scores are ranked by `digits` digits, so that rounding never parts equals. Nulls
    count as 0; a query's rows are ordered by one value at a time and never gathered.
    """
    rows = by_rows(df, query).select(query, *keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in (*RAW, *META)])
    own = Window.partitionBy(query)
    rank = lambda c: F.rank().over(own.orderBy(F.col(c).desc())) - 1
    capped = lambda c: F.least(rank(c), F.lit(MOST)).cast("double")
    models = ("phys", "mlp", "rev")
    rows = rows.withColumns({f"z_{m}": standardized(F.col(m), query) for m in models} | {"_n": F.count("*").over(own).cast("double"), "_place": F.row_number().over(own.orderBy(F.col("lib").desc()))})
    spec = sum((w * F.col(f"z_{m}") for m, w in HAND_MODELS.items()), F.lit(0.0))
    hand = spec + HAND_LIBRARY * F.pow(F.greatest("lib", F.lit(0.0)), F.lit(HAND_POWER)) + HAND_ANALOG * F.col("ana")
    hand = sum((w * F.col(f"g{k}") for k, w in enumerate(HAND_GENERATION)), hand)
    rows = rows.withColumns({"hand": F.round(hand, digits), "spec": F.round(spec, digits)})
    best = lambda c: F.max(c).over(own)
    made: dict[str, Column] = {}
    for m in models:
        made |= {f"z_{m}": F.col(f"z_{m}"), f"rank_{m}": capped(m), f"share_{m}": rank(m) / F.greatest(F.col("_n") - 1, F.lit(1.0)), f"gap_{m}": F.col(f"z_{m}") - best(f"z_{m}")}
    made |= {"hand": F.col("hand"), "rank_hand": capped("hand"), "gap_hand": F.col("hand") - best("hand"), "spec": F.col("spec"), "rank_spec": capped("spec")}
    second = F.coalesce(F.max(F.when(F.col("_place") > 1, F.col("lib"))).over(own), F.lit(0.0))
    made |= {"lib": F.col("lib"), "gap_lib": F.col("lib") - best("lib"), "rank_lib": capped("lib"), "q_lib": best("lib"), "q_lib2": second, "q_lib80": F.count_if(F.col("lib") >= 0.8).over(own).cast("double")}
    made |= {"ana": F.col("ana"), "gap_ana": F.col("ana") - best("ana"), "rank_ana": capped("ana"), "q_ana": best("ana")}
    made |= {c: F.col(c) for c in ("a_cos", "a_mcos", "a_shift2", "a_shift4", "a_pairs", *(f"g{k}" for k in range(6)))}
    made |= {"error": F.least("error", F.lit(float(MOST))), "q_size": F.ln("_n"), "q_generated": F.count_if(F.col("g0") > 0.5).over(own) / F.col("_n")}
    made |= {f"q_{c}": F.col(c) for c in META} | {"raw_phys": F.col("phys"), "raw_rev": F.col("rev")}
    return rows.select(query, *keep, *[c.alias(name) for name, c in made.items()])


def fused_score(df: DataFrame, query: str, standard: dict[str, float], plain: dict[str, float], powers: dict[str, tuple[float, float]]) -> Column:
    """The weighted sum of terms, a null one adding nothing: standardized within the query, as they are, and as powers (power, weight).

    A term that a query lacks altogether is null in all of its rows. Non-negative values alone are raised to a power.
    """
    terms = [w * standardized(F.col(c), query) for c, w in standard.items()] + [w * F.col(c) for c, w in plain.items()]
    terms += [w * F.pow(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(p))) for c, (p, w) in powers.items()]
    return sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
