"""Per-query standardization, ranks, top-k, merges of ordered lists, fusion."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import fusion
from quern.operators import rank as R
from quern.plans.registry import query

# two rankings of parts within a brand
LIST_A = "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part"
LIST_B = "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS pos FROM part"


def lists(t):
    order = lambda c: F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col(c).desc(), "p_partkey")).cast("long").alias("pos")
    p = t("part")
    return p.select("p_brand", "p_partkey", order("p_retailprice")), p.select("p_brand", "p_partkey", order("p_size"))


@query("w1_zscore", "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / (stddev_pop(o_totalprice) OVER w + 1e-6), 4) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def w1(t):
    return t("orders").select("o_orderkey", F.round(R.zscore(F.col("o_totalprice"), ["o_custkey"]), 4).alias("z"))


@query("w2_zscore_or_zero", """
SELECT o_orderkey, round(CASE WHEN stddev_pop(o_totalprice) OVER w > 1e-12 THEN (o_totalprice - avg(o_totalprice) OVER w) / stddev_pop(o_totalprice) OVER w ELSE 0 END, 4) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey)
""")
def w2(t):
    return t("orders").select("o_orderkey", F.round(R.zscore_or_zero(F.col("o_totalprice"), ["o_custkey"]), 4).alias("z"))


@query("w3_capped_rank", "SELECT l_orderkey, l_partkey, l_quantity, least(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) - 1, 50) AS r FROM lineitem")
def w3(t):
    rows = R.with_capped_rank(t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag"), ["l_returnflag"], "l_quantity", "r")
    return rows.drop("l_returnflag")


@query("w4_relative_rank", "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC), 6) AS r FROM orders")
def w4(t):
    return t("orders").select("o_orderkey", F.round(F.percent_rank().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc())), 6).alias("r"))


@query("w5_gap_to_best", """
SELECT o_orderkey, round(o_totalprice - max(o_totalprice) OVER w, 4) AS gap, round(nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS second,
count(CASE WHEN o_totalprice >= 400000 THEN 1 END) OVER w AS n_high FROM orders WINDOW w AS (PARTITION BY o_custkey)
""")
def w5(t):
    w = Window.partitionBy("o_custkey")
    ordered = w.orderBy(F.col("o_totalprice").desc(), "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t("orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.max("o_totalprice").over(w), 4).alias("gap"), F.round(F.nth_value("o_totalprice", 2).over(ordered), 4).alias("second"), F.count(F.when(F.col("o_totalprice") >= 400000, 1)).over(w).alias("n_high"))


@query("w6_rank_features", """
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / (stddev_pop(o_totalprice) OVER w + 1e-6), 4) AS z, least(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) - 1, 50) AS r,
round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC), 6) AS rel, round(o_totalprice - max(o_totalprice) OVER w, 4) AS gap, count(*) OVER w AS n, round(ln(1 + o_totalprice), 6) AS logv FROM orders WINDOW w AS (PARTITION BY o_custkey)
""")
def w6(t):
    w, down = Window.partitionBy("o_custkey"), Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc())
    v = F.col("o_totalprice")
    return t("orders").select("o_orderkey", F.round(R.zscore(v, ["o_custkey"]), 4).alias("z"), R.capped_rank(v, ["o_custkey"]).alias("r"), F.round(F.percent_rank().over(down), 6).alias("rel"), F.round(v - F.max(v).over(w), 4).alias("gap"), F.count("*").over(w).alias("n"), F.round(F.log1p(v), 6).alias("logv"))


#: Raw columns of a candidate and its query, from a line and its order.
RAW_SQL = {
    "phys": "l_quantity", "mlp": "l_discount", "rev": "l_extendedprice / 1000", "lib": "l_tax * 12", "ana": "l_discount * l_tax * 100",
    "a_cos": "l_tax", "a_mcos": "l_discount / 2", "a_shift2": "l_partkey % 3", "a_shift4": "l_partkey % 4", "a_pairs": "l_linenumber",
    "g0": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "g1": "l_tax * 2", "g2": "l_suppkey % 2", "g3": "l_discount", "g4": "l_linenumber % 3", "g5": "l_tax",
    "error": "l_quantity * 1.5", "n_records": "l_orderkey % 7", "mass": "l_orderkey % 1000", "polarity": "l_orderkey % 2", "category": "l_orderkey % 5", "instrument": "l_orderkey % 3",
}
RANK = "CAST(rank() OVER (PARTITION BY q ORDER BY {x} DESC) - 1 AS DOUBLE)"
MODELS = "".join(f"z_{m}, least({RANK.format(x=m)}, 50) AS rank_{m}, {RANK.format(x=m)} / greatest(n - 1, 1) AS share_{m}, z_{m} - max(z_{m}) OVER w AS gap_{m}, " for m in ("phys", "mlp", "rev"))
VECTOR_SQL = f"""
WITH r AS (SELECT l_orderkey AS q, l_partkey, l_linenumber, {", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in RAW_SQL.items())} FROM lineitem),
z AS (SELECT *, {", ".join(f"({m} - avg({m}) OVER w) / (stddev_pop({m}) OVER w + CAST(1e-6 AS DOUBLE)) AS z_{m}" for m in ("phys", "mlp", "rev"))}, CAST(count(*) OVER w AS DOUBLE) AS n, row_number() OVER (PARTITION BY q ORDER BY lib DESC) AS place FROM r WINDOW w AS (PARTITION BY q)),
h AS (SELECT *, round(z_phys + CAST(0.25 AS DOUBLE) * z_mlp + z_rev, 9) AS spec, round(z_phys + CAST(0.25 AS DOUBLE) * z_mlp + z_rev + 8 * pow(greatest(lib, 0), 32) + 24 * ana - 2 * g0 - g2 + 4 * g3 + CAST(1.5 AS DOUBLE) * g5, 9) AS hand FROM z),
f AS (SELECT q, l_partkey, l_linenumber, {MODELS} hand, least({RANK.format(x="hand")}, 50) AS rank_hand, hand - max(hand) OVER w AS gap_hand, spec, least({RANK.format(x="spec")}, 50) AS rank_spec,
  lib, lib - max(lib) OVER w AS gap_lib, least({RANK.format(x="lib")}, 50) AS rank_lib, max(lib) OVER w AS q_lib, coalesce(max(CASE WHEN place > 1 THEN lib END) OVER w, 0) AS q_lib2, CAST(count(CASE WHEN lib >= CAST(0.8 AS DOUBLE) THEN 1 END) OVER w AS DOUBLE) AS q_lib80,
  ana, ana - max(ana) OVER w AS gap_ana, least({RANK.format(x="ana")}, 50) AS rank_ana, max(ana) OVER w AS q_ana, a_cos, a_mcos, a_shift2, a_shift4, a_pairs, g0, g1, g2, g3, g4, g5,
  least(error, 50) AS error, ln(n) AS q_size, count(CASE WHEN g0 > CAST(0.5 AS DOUBLE) THEN 1 END) OVER w / n AS q_generated, n_records AS q_n_records, mass AS q_mass, polarity AS q_polarity, category AS q_category, instrument AS q_instrument, phys AS raw_phys, rev AS raw_rev
  FROM h WINDOW w AS (PARTITION BY q))
SELECT q, l_partkey, l_linenumber, {{columns}} FROM f
"""
VECTOR = [f"{x}_{m}" for m in ("phys", "mlp", "rev") for x in ("z", "rank", "share", "gap")]
VECTOR += ["hand", "rank_hand", "gap_hand", "spec", "rank_spec", "lib", "gap_lib", "rank_lib", "q_lib", "q_lib2", "q_lib80", "ana", "gap_ana", "rank_ana", "q_ana", "a_cos", "a_mcos", "a_shift2", "a_shift4", "a_pairs"]
VECTOR += [*(f"g{k}" for k in range(6)), "error", "q_size", "q_generated", *(f"q_{c}" for c in fusion.META), "raw_phys", "raw_rev"]


@query("w6_feature_vector", VECTOR_SQL.format(columns=", ".join(f"round({c}, 5) AS {c}" for c in VECTOR)))
def w6_vector(t):
    """All 48 features of a candidate within its query."""
    raw = t("lineitem").select(F.col("l_orderkey").alias("q"), "l_partkey", "l_linenumber", *[F.expr(f"CAST({x} AS DOUBLE)").alias(c) for c, x in RAW_SQL.items()])
    return fusion.feature_vectors(raw, "q", ["l_partkey", "l_linenumber"]).select("q", "l_partkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in VECTOR])


@query("w7_running_offset", "SELECT o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS off FROM orders")
def w7(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return t("orders").select("o_orderkey", F.round(F.coalesce(F.sum("o_totalprice").over(w), F.lit(0.0)), 3).alias("off"))


@query("w8_slot_rerank", """
WITH p AS (SELECT o_custkey, o_orderkey, o_orderpriority AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos, o_orderkey % 101 AS score FROM orders),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, g ORDER BY pos) AS slot, row_number() OVER (PARTITION BY o_custkey, g ORDER BY score DESC, pos) AS ord FROM p)
SELECT a.o_orderkey, a.pos, b.pos AS new_position FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.g = b.g AND a.ord = b.slot
""")
def w8(t):
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long")
    df = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("g"), pos.alias("pos"), (F.col("o_orderkey") % 101).alias("score"))
    return R.slot_rerank(df, "o_custkey", "pos", "g", "score").select("o_orderkey", "pos", "new_position")


@query("w9_gated_refill", """
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos, CAST(o_orderkey % 89 AS DOUBLE) AS score, o_orderstatus = 'O' AND o_custkey % 3 <> 0 AS m FROM orders),
z AS (SELECT *, round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-6) + 0.15 * (o_orderkey % 7), 9) AS z FROM p WHERE m AND pos <= 60 WINDOW w AS (PARTITION BY o_custkey)),
s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS slot, row_number() OVER (PARTITION BY o_custkey ORDER BY z DESC, pos) AS ord FROM z),
n AS (SELECT a.o_orderkey, b.pos AS np FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.ord = b.slot)
SELECT p.o_orderkey, pos, coalesce(np, pos) AS new_position FROM p LEFT JOIN n USING (o_orderkey)
""")
def w9(t):
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long")
    df = t("orders").select("o_custkey", "o_orderkey", pos.alias("pos"), (F.col("o_orderkey") % 89).cast("double").alias("score"), (F.col("o_orderstatus") == "O").alias("m"))
    bonus = F.lit(0.15) * (F.col("o_orderkey") % 7)
    return R.gated_refill(df, "o_custkey", "pos", F.col("m"), F.col("o_custkey") % 3 != 0, "score", bonus).select("o_orderkey", "pos", "new_position")


@query("w10_paired_deltas", f"WITH a AS ({LIST_A}), b AS ({LIST_B}) SELECT p_brand, p_partkey, a.pos - b.pos AS delta FROM a JOIN b USING (p_brand, p_partkey)")
def w10(t):
    a, b = lists(t)
    return a.join(b.withColumnRenamed("pos", "pos_b"), ["p_brand", "p_partkey"]).select("p_brand", "p_partkey", (F.col("pos") - F.col("pos_b")).alias("delta"))


@query("w11_frames", "SELECT event_id, value - lag(value) OVER w AS d1, lead(value) OVER w - value AS d2, CAST(ntile(4) OVER w AS BIGINT) AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def w11(t):
    w = Window.partitionBy("user_id").orderBy("event_id")
    v = F.col("value")
    return t("events").select("event_id", (v - F.lag(v).over(w)).alias("d1"), (F.lead(v).over(w) - v).alias("d2"), F.ntile(4).over(w).cast("long").alias("q"))


@query("t1_two_key_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders")
def t1(t):
    """Positions in a full sort by two keys."""
    return R.sorted_positions(t("orders"), ["o_orderkey"], ["o_orderdate", "o_orderkey"])


@query("t2_topk_skip_empty", """
SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'P') WHERE rank <= 3
""")
def t2(t):
    filled = t("orders").where("o_orderstatus <> 'P'")
    return R.top_k(filled, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("t3_unsorted_best", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 5
""")
def t3(t):
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return R.best_k(t("lineitem"), ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("t4_bounded_top", "SELECT o_custkey, list_slice(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), 1, 3) AS top FROM orders GROUP BY 1")
def t4(t):
    best = R.top_k(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return best.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))), lambda x: x.o_orderkey).alias("top"))


@query("t5_stable_fused_sort", f"""
WITH a AS ({LIST_A}), b AS ({LIST_B}) SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY a.pos // 3 + b.pos // 5, a.pos) AS place FROM a JOIN b USING (p_brand, p_partkey)
""")
def t5(t):
    a, b = lists(t)
    both = a.join(b.withColumnRenamed("pos", "pos_b"), ["p_brand", "p_partkey"])
    fused = F.floor(F.col("pos") / 3) + F.floor(F.col("pos_b") / 5)
    return both.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(fused, "pos")).cast("long").alias("place"))


@query("t6_mmr", """
WITH RECURSIVE v AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
c AS (SELECT a.label, a.i, list(list_cosine_similarity(a.x, b.x) ORDER BY b.i) AS row FROM v a JOIN v b ON a.label = b.label GROUP BY 1, 2),
l AS (SELECT label, count(*) AS n, list(row ORDER BY i) AS near_to FROM c GROUP BY 1),
m AS (
  SELECT label, CAST(1 AS BIGINT) AS place, CAST(1 AS BIGINT) AS best, [CAST(1 AS BIGINT)] AS taken, near_to[1] AS near FROM l
  UNION ALL
  SELECT label, place + 1, pick, list_append(taken, pick), list_transform(near, lambda x, i: greatest(x, near_to[pick][i]))
  FROM (SELECT m.label, place, taken, near, near_to, list_position(value, list_max(value)) AS pick FROM (
    SELECT m.label, place, taken, near, near_to, list_transform(near, lambda x, i: CASE WHEN list_contains(taken, i) THEN -9 ELSE CAST(0.6 AS DOUBLE) * (1 - (i - 1) / (n - 1)) - CAST(0.4 AS DOUBLE) * x END) AS value
    FROM m JOIN l ON l.label = m.label WHERE place < least(10, n)) m)
)
SELECT m.label, vec_id, place FROM m JOIN v ON v.label = m.label AND v.i = m.best
""")
def t6(t):
    pos = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    df = t("embeddings").withColumn("pos", pos)
    return R.mmr(df.select("label", "vec_id", "pos", "embedding"), "label", "vec_id", "pos", "embedding", 10, 0.4)


@query("m1_ordered_union", f"""
WITH a AS ({LIST_A}), b AS ({LIST_B}), u AS (SELECT p_brand, p_partkey, 0 AS l, pos FROM a WHERE pos <= 10 UNION ALL SELECT p_brand, p_partkey, 1, pos FROM b WHERE pos <= 30),
f AS (SELECT p_brand, p_partkey, min((l, pos)) AS k FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k) AS place FROM f)
SELECT p_brand, p_partkey, place FROM r WHERE place <= 25
""")
def m1(t):
    a, b = lists(t)
    return R.ordered_union([a.where("pos <= 10"), b.where("pos <= 30")], "p_brand", "p_partkey", "pos", 25).select("p_brand", "p_partkey", "place")


@query("m2_segment_merge", f"""
WITH a AS ({LIST_A}), b AS ({LIST_B}), c AS (SELECT p_brand, count(*) % 4 AS tc FROM part GROUP BY 1),
u AS (SELECT p_brand, p_partkey, CASE WHEN pos <= tc THEN 0 ELSE 2 END AS l, pos FROM a JOIN c USING (p_brand) WHERE pos <= 25 UNION ALL SELECT p_brand, p_partkey, 1, pos FROM b WHERE pos <= 10),
f AS (SELECT p_brand, p_partkey, min((l, pos)) AS k FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY k) AS place FROM f)
SELECT p_brand, p_partkey, place FROM r WHERE place <= 25
""")
def m2(t):
    a, b = lists(t)
    tight = t("part").groupBy("p_brand").agg((F.count("*") % 4).alias("tight_count"))
    return R.segment_merge(a.where("pos <= 25"), b.where("pos <= 10"), tight, "p_brand", "p_partkey", "pos", 25).select("p_brand", "p_partkey", "place")


@query("m3_reciprocal_rank_fusion", f"""
WITH a AS (SELECT * FROM ({LIST_A}) WHERE pos <= 40), b AS (SELECT * FROM ({LIST_B}) WHERE pos <= 40),
s AS (SELECT p_brand, p_partkey, coalesce(1 / (60.0 + a.pos), 0) + coalesce(0.7 / (60.0 + b.pos), 0) AS s, a.pos AS ra FROM a FULL JOIN b USING (p_brand, p_partkey))
SELECT p_brand, p_partkey, round(s, 6) AS score, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(s AS DOUBLE) DESC, ra NULLS LAST, p_partkey) AS place FROM s
""".replace("60.0 + a", "CAST(60 AS DOUBLE) + a").replace("0.7 / (60.0", "CAST(0.7 AS DOUBLE) / (CAST(60 AS DOUBLE)"))
def m3(t):
    a, b = lists(t)
    return R.reciprocal_rank_fusion(a, b, "p_brand", "p_partkey", "pos", 60.0, 0.7, 40).withColumn("score", F.round("score", 6))


@query("m4_insert_second", f"""
WITH a AS (SELECT * FROM ({LIST_A}) WHERE pos <= 10), b AS (SELECT p_brand, p_partkey AS best FROM ({LIST_B}) WHERE pos = 1),
j AS (SELECT a.*, best, bool_or(p_partkey = best AND pos <= 2) OVER (PARTITION BY p_brand) AS early FROM a JOIN b USING (p_brand)),
u AS (SELECT p_brand, p_partkey, CASE WHEN early OR pos < 2 THEN 2 * pos ELSE 2 * pos + 1 END AS k FROM j WHERE early OR p_partkey <> best UNION ALL SELECT DISTINCT p_brand, best, 4 FROM j WHERE NOT early)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY k, p_partkey) AS place FROM u
""")
def m4(t):
    a, b = lists(t)
    return R.insert_top(a.where("pos <= 10"), b, "p_brand", "p_partkey", "pos").select("p_brand", "p_partkey", "place")


@query("m5_slot_interleave", f"""
WITH a AS ({LIST_A}), b AS ({LIST_B}), s AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
p AS (SELECT p_brand, n, unnest([4, 8, 12, 16, 20]) AS slot, unnest([1, 2, 3, 4, 5]) AS k FROM s)
SELECT p.p_brand, b.p_partkey, p.slot AS place FROM p JOIN b ON p.p_brand = b.p_brand AND p.k = b.pos WHERE n >= 25
UNION ALL SELECT a.p_brand, a.p_partkey, a.pos + (a.pos - 1) // 3 AS place FROM a JOIN s USING (p_brand) WHERE a.pos <= 15 AND n >= 25
UNION ALL SELECT a.p_brand, a.p_partkey, a.pos + 5 FROM a JOIN s USING (p_brand) WHERE a.pos BETWEEN 16 AND 20 AND n >= 25
""")
def m5(t):
    a, b = lists(t)
    big = t("part").groupBy("p_brand").count().where("count >= 25").select("p_brand")
    both = [x.join(big, "p_brand", "left_semi") for x in (a, b)]
    return R.slot_interleave(*both, "p_brand", "p_partkey", "pos", [4, 8, 12, 16, 20], 25).withColumn("place", F.col("place").cast("long"))


@query("m6_threshold_merge", """
WITH RECURSIVE a AS (SELECT p_brand, p_partkey, p_retailprice - 900 AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice - 900 DESC, p_partkey) AS i FROM part),
b AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) * 2 AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS j FROM part),
m AS (
  SELECT DISTINCT p_brand, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS item FROM part
  UNION ALL
  SELECT m.p_brand, CASE WHEN two THEN m.i ELSE m.i + 1 END, CASE WHEN two THEN m.j + 1 ELSE m.j END, step + 1, CASE WHEN two THEN b.p_partkey ELSE a.p_partkey END
  FROM m LEFT JOIN a ON a.p_brand = m.p_brand AND a.i = m.i LEFT JOIN b ON b.p_brand = m.p_brand AND b.j = m.j, LATERAL (SELECT b.s IS NOT NULL AND (a.s IS NULL OR b.s > a.s + CAST(0.5 AS DOUBLE)) AS two) w
  WHERE step < 50 AND (a.s IS NOT NULL OR b.s IS NOT NULL)
), f AS (SELECT p_brand, item, min(step) AS step FROM m WHERE step > 0 GROUP BY 1, 2)
SELECT p_brand, item AS p_partkey, place FROM (SELECT p_brand, item, row_number() OVER (PARTITION BY p_brand ORDER BY step) AS place FROM f) WHERE place <= 25
""")
def m6(t):
    a, b = (t("part").select("p_brand", "p_partkey", x.alias("s")) for x in (F.col("p_retailprice") - 900, F.col("p_size") * 2.0))
    return R.threshold_merge(a, b, "p_brand", "p_partkey", "s", 25, margin=0.5)


@query("m7_boltzmann_merge", """
WITH e AS (SELECT p_brand, p_partkey, p_retailprice / 10 AS a, CAST(p_size AS DOUBLE) / 5 AS b FROM part),
l AS (SELECT p_brand, p_partkey, 0 AS l, a - (max(a) OVER w + ln(sum(exp(a - m)) OVER w)) + ln(0.6) AS lp FROM (SELECT *, max(a) OVER (PARTITION BY p_brand) AS m FROM e) WINDOW w AS (PARTITION BY p_brand)
UNION ALL SELECT p_brand, p_partkey, 1, b - (max(b) OVER w + ln(sum(exp(b - m)) OVER w)) + ln(0.4) FROM (SELECT *, max(b) OVER (PARTITION BY p_brand) AS m FROM e) WINDOW w AS (PARTITION BY p_brand)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(lp, 9) DESC, l, p_partkey) AS place FROM l)
SELECT p_brand, place, round(lp, 5) AS log_p FROM r WHERE place <= 25
""")
def m7(t):
    a = t("part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 10).alias("s"))
    b = t("part").select("p_brand", "p_partkey", (F.col("p_size").cast("double") / 5).alias("s"))
    return R.boltzmann_merge(a, b, "p_brand", "p_partkey", "s", 1.0, 1.0, F.lit(0.4), 25).select("p_brand", "place", F.round("log_p", 5).alias("log_p"))


@query("m8_dedup_refill", f"""
WITH a AS ({LIST_A}), k AS (SELECT a.*, p_type FROM a JOIN part USING (p_partkey)), f AS (SELECT p_brand, p_type, min(pos) AS pos FROM (SELECT k.p_brand, p_type, pos FROM k) GROUP BY 1, 2)
SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS place FROM f QUALIFY place <= 10
""".replace("SELECT a.*, p_type FROM a JOIN part USING (p_partkey)", "SELECT a.p_brand, a.p_partkey, a.pos, part.p_type FROM a JOIN part ON a.p_partkey = part.p_partkey"))
def m8(t):
    """One entry for each identity key, at its first place, later ones moving up."""
    a, _ = lists(t)
    first = a.join(t("part").select("p_partkey", "p_type"), "p_partkey").groupBy("p_brand", "p_type").agg(F.min("pos").alias("pos"))
    return R.top_k(first, ["p_brand"], [F.col("pos")], 10, "place").select("p_brand", "p_type", "place")


@query("m10_priority_union", """
WITH u AS (SELECT c_nationkey AS k, 0 AS p, c_name AS v FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 1, s_name FROM supplier) SELECT k, (min((p, v)))[2] AS v FROM u GROUP BY 1
""")
def m10(t):
    a = t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit(0).alias("p"), F.col("c_name").alias("v"))
    b = t("supplier").select("s_nationkey", F.lit(1), "s_name")
    return a.unionAll(b).groupBy("k").agg(F.min(F.struct("p", "v")).alias("m")).select("k", "m.v")


@query("m11_template_alignment", """
WITH o AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ';' ORDER BY o_totalprice DESC, o_orderkey) AS answer FROM orders WHERE o_totalprice > 450000 GROUP BY 1)
SELECT c_custkey, coalesce(answer, 'none') AS answer FROM customer LEFT JOIN o ON c_custkey = o_custkey
""")
def m11(t):
    rows = t("orders").where("o_totalprice > 450000").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("s"), "o_orderkey"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x.o_orderkey.cast("string")), ";")
    return t("customer").join(rows, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(text, F.lit("none")).alias("answer"))


@query("m12_set_operations", """
(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000) EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000
""")
def m12(t):
    k = t("orders").select(F.col("o_custkey").alias("k"))
    return k.intersect(t("customer").where("c_acctbal > 5000").select("c_custkey")).subtract(t("orders").where("o_totalprice > 400000").select("o_custkey"))


@query("m13_gated_promotion", f"""
WITH a AS (SELECT * FROM ({LIST_A}) WHERE pos <= 10), g AS (SELECT p_brand, max(p_size) AS s FROM part GROUP BY 1), b AS (SELECT p_brand, p_partkey AS best FROM ({LIST_B}) WHERE pos = 1),
j AS (SELECT a.p_brand, p_partkey, pos, s >= 50 AS open, best FROM a JOIN g USING (p_brand) JOIN b USING (p_brand)),
u AS (SELECT p_brand, p_partkey, pos AS k FROM j WHERE NOT open OR p_partkey <> best UNION ALL SELECT DISTINCT p_brand, best, 0 FROM j WHERE open)
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY k) AS place FROM u
""")
def m13(t):
    """The second list's first item leads where its evidence passes the threshold."""
    a, b = lists(t)
    gate = t("part").groupBy("p_brand").agg((F.max("p_size") >= 50).alias("open"))
    best = b.where("pos = 1").select("p_brand", F.col("p_partkey").alias("best"))
    j = a.where("pos <= 10").join(gate, "p_brand").join(best, "p_brand")
    u = j.where(~F.col("open") | (F.col("p_partkey") != F.col("best"))).select("p_brand", "p_partkey", F.col("pos").alias("k"))
    u = u.unionAll(j.where("open").select("p_brand", "best", F.lit(0).cast("long")).distinct())
    return u.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("k")).cast("long").alias("place"))
