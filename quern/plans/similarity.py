"""Similarity joins and scoring functions. Documents' words and vectors' components stand for peaks and bits."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import formulas
from quern.functions import peaks as P
from quern.functions import vectors as V
from quern.operators import bits as B
from quern.operators import fusion
from quern.operators import generate as G
from quern.operators import graphs
from quern.operators import joins as J
from quern.operators import rank as R
from quern.plans.registry import query
from quern.storage import materialize

SETS = "SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark"
WEIGHTS = "SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) GROUP BY 1, 2"


def item_words(t):
    return t("benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))


def counts(t):
    return item_words(t).groupBy("item_id", "w").agg(F.count("*").alias("n"))


@query("j15_tanimoto_topk", f"""
WITH s AS ({SETS}), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS c FROM s x JOIN s y ON x.w = y.w AND x.item_id <> y.item_id GROUP BY 1, 2),
r AS (SELECT a, b, c / (na.n + nb.n - c) AS sim FROM p JOIN n na ON a = na.item_id JOIN n nb ON b = nb.item_id), k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM r)
SELECT a, b, round(sim, 6) AS sim, rank FROM k WHERE rank <= 5
""")
def j15(t):
    """For each item the five most similar others by the Tanimoto index of their word sets."""
    best = J.top_similar_sets(item_words(t).distinct(), "item_id", "w", 5)
    return best.select(F.col("item_id").alias("a"), F.col("other").alias("b"), F.round("similarity", 6).alias("sim"), "rank")


@query("j15_bit_topk", """
WITH v AS (SELECT vec_id AS a, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS v FROM embeddings), n AS (SELECT *, list_sum(v) AS n FROM v),
p AS (SELECT x.a, y.a AS b, list_sum(list_transform(list_zip(x.v, y.v), lambda z: z[1] * z[2])) AS c, x.n AS na, y.n AS nb FROM n x JOIN n y ON x.a <> y.a),
k AS (SELECT a, b, c / (na + nb - c) AS sim, row_number() OVER (PARTITION BY a ORDER BY c / (na + nb - c) DESC, b) AS rank FROM p WHERE c > 0)
SELECT a, b, round(sim, 6) AS sim, rank FROM k WHERE rank <= 10
""")
def j15_bits(t):
    """For each vector the ten most similar others by the Tanimoto index of their signs, packed into words."""
    signs = t("embeddings").select("vec_id", B.packed(F.transform("embedding", lambda x: x > 0)).alias("bits"))
    best, _ = B.top_similar_bits(signs, "vec_id", "bits", 10)
    return best.select(F.col("key").alias("a"), F.col("other").alias("b"), F.round("similarity", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("j16_two_stage_search", f"""
WITH c AS ({WEIGHTS}), f AS (SELECT w, count(*) AS df FROM c GROUP BY 1), l AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.n * y.n) AS s FROM c x JOIN c y USING (w) JOIN f USING (w) WHERE x.item_id <> y.item_id GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM l), g AS (SELECT a, b FROM k WHERE r <= 10), z AS (SELECT item_id, sqrt(sum(n * n)) AS z FROM c GROUP BY 1),
e AS (SELECT a, b, coalesce(sum(x.n * y.n), 0) / (any_value(za.z) * any_value(zb.z)) AS cos FROM g JOIN c x ON x.item_id = a JOIN c y ON y.item_id = b AND x.w = y.w JOIN z za ON za.item_id = a JOIN z zb ON zb.item_id = b GROUP BY 1, 2)
SELECT a, b, round(cos, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cos, 9) DESC, b) AS r FROM e) WHERE r <= 3
""")
def j16(t):
    """A shortlist by all shared words, then an exact cosine on the shortlist alone."""
    c = counts(t)
    left, right = c.withColumnsRenamed({"item_id": "a", "n": "x"}), c.withColumnsRenamed({"item_id": "b", "n": "y"})
    short = R.top_k(J.index_join(left, right, "a", "b", "w", "x", "y").where("a <> b"), ["a"], [F.col("score").desc(), F.col("b")], 10).select("a", "b")
    norms = c.groupBy("item_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("z"))
    full = short.join(c.withColumnsRenamed({"item_id": "a", "n": "x"}), "a").join(c.withColumnsRenamed({"item_id": "b", "n": "y"}), ["b", "w"])
    dots = full.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(norms.withColumnsRenamed({"item_id": "a", "z": "za"}), "a").join(norms.withColumnsRenamed({"item_id": "b", "z": "zb"}), "b")
    scored = scored.withColumn("cos", F.col("dot") / (F.col("za") * F.col("zb")))
    return R.top_k(scored, ["a"], [F.round("cos", 9).desc(), F.col("b")], 3).select("a", "b", F.round("cos", 5).alias("score"))


@query("j17_best_posting_retrieval", """
WITH b AS (SELECT vec_id, label, y, d, CAST(floor(y / 0.02) AS BIGINT) AS bin FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS y, generate_subscripts(embedding, 1) AS d FROM embeddings)),
p AS (SELECT q.vec_id AS q, l.label AS lib, q.d, max(1 - abs(q.y - l.y) / 0.02) AS s FROM b q JOIN b l ON q.d = l.d AND abs(q.bin - l.bin) <= 1 AND abs(q.y - l.y) <= 0.02 AND q.vec_id <> l.vec_id GROUP BY 1, 2, 3),
s AS (SELECT q, lib, round(sum(s), 6) AS score FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, lib) AS rank FROM s)
SELECT q, lib, rank FROM r WHERE rank <= 3
""".replace("0.02", "CAST(0.02 AS DOUBLE)"))
def j17(t):
    """Retrieval over bins and their neighbours: each query component counts its best posting per library entry once."""
    v = t("embeddings").select(F.col("vec_id").alias("q"), F.col("label").alias("lib"), F.posexplode("embedding").alias("d", "y")).withColumn("y", F.col("y").cast("double"))
    best = J.best_postings(v, "q", "lib", "d", "y", 0.02).groupBy("q", "lib").agg(F.round(F.sum("best"), 6).alias("score"))
    return R.top_k(best, ["q"], [F.col("score").desc(), F.col("lib")], 3).select("q", "lib", "rank")


ENTROPY = "p AS (SELECT item_id, w, n / sum(n) OVER (PARTITION BY item_id) AS p FROM c), h AS (SELECT item_id, -sum(p * ln(p)) AS s FROM p GROUP BY 1), r AS (SELECT item_id, w, CASE WHEN s < 3 THEN pow(p, 0.25 + 0.25 * s) ELSE p END AS v FROM p JOIN h USING (item_id)), e AS (SELECT item_id, w, v / sum(v) OVER (PARTITION BY item_id) AS p FROM r)"


def shares(t):
    lists = counts(t).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("l"))
    p = V.entropy_weighted(F.transform("l", lambda x: x.n))
    return lists.select("item_id", F.explode(F.arrays_zip(F.transform("l", lambda x: x.w).alias("w"), p.alias("p"))).alias("z")).select("item_id", "z.w", "z.p")


@query("f1_entropy_weighting", f"WITH c AS ({WEIGHTS}), {ENTROPY} SELECT item_id, round(-sum(p * ln(p)), 5) AS entropy, round(max(p), 6) AS largest FROM e GROUP BY 1")
def f1(t):
    return shares(t).groupBy("item_id").agg(F.round(-F.sum(F.col("p") * F.ln("p")), 5).alias("entropy"), F.round(F.max("p"), 6).alias("largest"))


@query("f2_entropy_similarity", f"""
WITH c AS ({WEIGHTS}), {ENTROPY}, m AS (SELECT x.item_id AS a, y.item_id AS b, sum((x.p + y.p) * ln(x.p + y.p) - x.p * ln(x.p) - y.p * ln(y.p)) / ln(4) AS s FROM e x JOIN e y USING (w) WHERE x.item_id < y.item_id GROUP BY 1, 2)
SELECT a, b, round(least(1, greatest(0, s)), 5) AS similarity FROM m WHERE s >= 0.15
""")
def f2(t):
    """Unmatched peaks cancel in the entropy similarity, so only shared ones are joined.

    A word adds most where the other side's share of it is the largest that any item has. The most frequent words whose
    bounds together stay under the threshold can't make a pair alone, so pairs are found by the others and then scored whole.
    """
    e = materialize(shares(t), "shares")
    x, y = F.col("x"), F.col("y")
    gain = (x + y) * F.ln(x + y) - x * F.ln(x) - y * F.ln(y)
    words = e.groupBy("w").agg(F.count("*").alias("df"), F.max("p").alias("y"))
    frequent = Window.partitionBy("item_id").orderBy(F.col("df").desc(), "w").rowsBetween(Window.unboundedPreceding, 0)
    bounded = e.withColumnRenamed("p", "x").join(words, "w").withColumn("most", F.sum(gain).over(frequent))
    asks = bounded.where(F.col("most") >= 0.15 * math.log(4) - 1e-9).select(F.col("item_id").alias("a"), "w")
    pairs = asks.join(e.select(F.col("item_id").alias("b"), "w"), "w").where("a < b").select("a", "b").distinct()
    whole = pairs.join(e.select(F.col("item_id").alias("a"), "w", F.col("p").alias("x")), "a").join(e.select(F.col("item_id").alias("b"), "w", F.col("p").alias("y")), ["b", "w"])
    s = F.sum(gain) / F.ln(F.lit(4.0))
    return whole.groupBy("a", "b").agg(s.alias("s")).where("s >= 0.15").select("a", "b", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "s")), 5).alias("similarity"))


def _peak_pairs(t):
    """Vectors of one label, each with the next, as peak lists: place and positive component."""
    peaks = F.filter(F.transform("embedding", lambda v, i: F.struct((i * 0.01 + v.cast("double") * 0.01).alias("x"), v.cast("double").alias("y"))), lambda p: p.y > 0)
    w = Window.partitionBy("label").orderBy("vec_id")
    pairs = t("embeddings").withColumn("a", peaks).select("vec_id", "a", F.lead("a").over(w).alias("b")).where("b is not null")
    # labels are few and pairs much work for few bytes: without a stated number of partitions some tasks would do it all
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "vec_id")


#: The same in SQL: vec_id with two lists, and their peaks by place.
PEAKS = """e AS (
  SELECT vec_id, label, list_filter(list_transform(embedding, lambda v, i: {'x': CAST(i - 1 AS DOUBLE) * CAST(0.01 AS DOUBLE) + CAST(v AS DOUBLE) * CAST(0.01 AS DOUBLE), 'y': CAST(v AS DOUBLE)}), lambda p: p.y > 0) AS a FROM embeddings
), l AS (
  SELECT * FROM (SELECT vec_id, list_sort(a) AS a, list_sort(lead(a) OVER (PARTITION BY label ORDER BY vec_id)) AS b FROM e) WHERE b IS NOT NULL
), pa AS (
  SELECT vec_id, generate_subscripts(a, 1) AS i, unnest(a, recursive := true) FROM l
), pb AS (
  SELECT vec_id, generate_subscripts(b, 1) AS j, unnest(b, recursive := true) FROM l
), norm AS (
  SELECT vec_id, sqrt(coalesce(list_sum(list_transform(a, lambda p: p.y)), 0) * coalesce(list_sum(list_transform(b, lambda p: p.y)), 0)) AS z FROM l
)"""

GREEDY = """g AS (
  SELECT vec_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ui, CAST([] AS BIGINT[]) AS uj, CAST(0 AS DOUBLE) AS cost FROM l
  UNION ALL
  SELECT g.vec_id, c.k, CASE WHEN free THEN list_append(ui, i) ELSE ui END, CASE WHEN free THEN list_append(uj, j) ELSE uj END, g.cost + CASE WHEN free THEN c.cost ELSE 0 END
  FROM g JOIN c ON c.vec_id = g.vec_id AND c.k = g.k + 1, LATERAL (SELECT NOT list_contains(ui, i) AND NOT list_contains(uj, j) AS free) f
), done AS (
  SELECT vec_id, arg_max(ui, k) AS ui, arg_max(cost, k) AS cost FROM g GROUP BY 1
)"""


@query("f2_tolerance_entropy", f"""
WITH RECURSIVE {PEAKS}, sa AS (SELECT vec_id, i, x, y / sum(y) OVER (PARTITION BY vec_id) AS p FROM pa), sb AS (SELECT vec_id, j, x, y / sum(y) OVER (PARTITION BY vec_id) AS p FROM pb),
ha AS (SELECT vec_id, -sum(p * ln(p)) AS h FROM sa GROUP BY 1), hb AS (SELECT vec_id, -sum(p * ln(p)) AS h FROM sb GROUP BY 1),
ra AS (SELECT vec_id, i, x, CASE WHEN h < 3 THEN pow(p, 0.25 + 0.25 * h) ELSE p END AS v FROM sa JOIN ha USING (vec_id)), rb AS (SELECT vec_id, j, x, CASE WHEN h < 3 THEN pow(p, 0.25 + 0.25 * h) ELSE p END AS v FROM sb JOIN hb USING (vec_id)),
wa AS (SELECT vec_id, i, x, v / sum(v) OVER (PARTITION BY vec_id) AS w FROM ra), wb AS (SELECT vec_id, j, x, v / sum(v) OVER (PARTITION BY vec_id) AS w FROM rb),
walk AS (
  SELECT vec_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(0 AS DOUBLE) AS s FROM l
  UNION ALL
  SELECT k.vec_id, CASE WHEN near OR a.x < b.x THEN k.i + 1 ELSE k.i END, CASE WHEN near OR a.x >= b.x THEN k.j + 1 ELSE k.j END,
         s + CASE WHEN near THEN (a.w + b.w) * ln(a.w + b.w) - a.w * ln(a.w) - b.w * ln(b.w) ELSE 0 END
  FROM walk k JOIN wa a ON a.vec_id = k.vec_id AND a.i = k.i JOIN wb b ON b.vec_id = k.vec_id AND b.j = k.j, LATERAL (SELECT abs(a.x - b.x) <= CAST(0.01 AS DOUBLE) AS near) n
)
SELECT vec_id, round(least(1, greatest(0, arg_max(s, i + j) / ln(4))), 6) AS similarity FROM walk GROUP BY 1
""")
def f2t(t):
    return _peak_pairs(t).select("vec_id", F.round(P.tolerance_entropy_similarity(F.col("a"), F.col("b"), 0.01), 6).alias("similarity"))


@query("f3_best_peak_cosine", f"""
WITH {PEAKS}, m AS (SELECT pa.vec_id, i, sqrt(any_value(pa.y)) * sqrt(max(pb.y)) AS s FROM pa JOIN pb ON pb.vec_id = pa.vec_id AND abs(pa.x - pb.x) <= CAST(0.01 AS DOUBLE) GROUP BY 1, 2)
SELECT vec_id, round(CASE WHEN z > 0 THEN coalesce(s, 0) / z ELSE 0 END, 6) AS similarity FROM norm LEFT JOIN (SELECT vec_id, sum(s) AS s FROM m GROUP BY 1) USING (vec_id)
""")
def f3(t):
    return _peak_pairs(t).select("vec_id", F.round(P.best_peak_cosine(F.col("a"), F.col("b"), 0.01), 6).alias("similarity"))


@query("f4_modified_cosine", f"""
WITH RECURSIVE {PEAKS}, c AS (
  SELECT pa.vec_id, i, j, sqrt(pa.y) * sqrt(pb.y) AS cost, row_number() OVER (PARTITION BY pa.vec_id ORDER BY sqrt(pa.y) * sqrt(pb.y) DESC, i, j) AS k
  FROM pa JOIN pb ON pb.vec_id = pa.vec_id AND (abs(pa.x - pb.x) <= CAST(0.004 AS DOUBLE) OR abs(pa.x - pb.x - CAST(0.02 AS DOUBLE)) <= CAST(0.004 AS DOUBLE))
), {GREEDY}
SELECT vec_id, round(CASE WHEN z > 0 THEN cost / z ELSE 0 END, 6) AS similarity FROM done JOIN norm USING (vec_id)
""")
def f4(t):
    return _peak_pairs(t).select("vec_id", F.round(P.modified_cosine(F.col("a"), F.col("b"), 0.02, 0.004), 6).alias("similarity"))


_L = "l AS (\n  SELECT * FROM (SELECT vec_id, list_sort(a) AS a, list_sort(lead(a) OVER (PARTITION BY label ORDER BY vec_id)) AS b FROM e) WHERE b IS NOT NULL\n)"
VARIANTS = PEAKS.replace(_L, """l0 AS (
  SELECT * FROM (SELECT vec_id, list_sort(a) AS a, list_sort(lead(a) OVER (PARTITION BY label ORDER BY vec_id)) AS b FROM e) WHERE b IS NOT NULL
), m AS (
  SELECT *, list_max(list_transform(a, lambda p: p.x)) + CAST(0.01 AS DOUBLE) * (vec_id % 3) AS ma, list_max(list_transform(b, lambda p: p.x)) AS mb FROM l0
), l AS (
  SELECT vec_id * 3 + v AS vec_id, v, coalesce(ma - mb, 0) AS s, CASE WHEN v = 2 THEN list_filter(a, lambda p: p.x <= ma - CAST(0.05 AS DOUBLE)) ELSE a END AS a,
         CASE WHEN v = 2 THEN list_filter(b, lambda p: p.x <= mb - CAST(0.05 AS DOUBLE)) ELSE b END AS b FROM m, (VALUES (0), (1), (2)) t(v)
)""")


@query("f4_cosine_variants", f"""
WITH RECURSIVE {VARIANTS}, c AS (
  SELECT pa.vec_id, i, j, sqrt(pa.y) * sqrt(pb.y) AS cost, row_number() OVER (PARTITION BY pa.vec_id ORDER BY sqrt(pa.y) * sqrt(pb.y) DESC, i, j) AS k
  FROM pa JOIN pb ON pb.vec_id = pa.vec_id JOIN l ON l.vec_id = pa.vec_id
  WHERE abs(pa.x - pb.x) <= CAST(0.004 AS DOUBLE) OR v > 0 AND abs(s) > CAST(0.004 AS DOUBLE) AND abs(pa.x - pb.x - s) <= CAST(0.004 AS DOUBLE)
), {GREEDY}, r AS (SELECT vec_id // 3 AS vec_id, vec_id % 3 AS v, CASE WHEN z > 0 THEN least(cost / z, 1) ELSE 0 END AS score, len(ui) AS n FROM done JOIN norm USING (vec_id))
SELECT vec_id, round(max(CASE WHEN v = 0 THEN score END), 6) AS direct, round(max(CASE WHEN v = 1 THEN score END), 6) AS moved, round(max(CASE WHEN v = 2 THEN score END), 6) AS lower,
       CAST(max(CASE WHEN v = 0 THEN n END) AS INTEGER) AS n_direct, CAST(max(CASE WHEN v = 1 THEN n END) AS INTEGER) AS n_moved, CAST(max(CASE WHEN v = 2 THEN n END) AS INTEGER) AS n_lower FROM r GROUP BY 1
""")
def f4_variants(t):
    """Direct, moved, and moved without the region at the upper end; the whole value is the last peak's place, a little further for some."""
    last = lambda c: F.array_max(F.transform(c, lambda p: p.x))
    whole = last(F.col("a")) + F.lit(0.01) * (F.col("vec_id") % 3)
    scored = _peak_pairs(t).select("vec_id", P.modified_cosines(F.col("a"), F.col("b"), whole, last(F.col("b")), 0.004, 0.05).alias("s"))
    names = ("direct", "moved", "lower")
    return scored.select("vec_id", *[F.round(f"s.{n}.score", 6).alias(n) for n in names], *[F.col(f"s.{n}.matches").alias(f"n_{n}") for n in names])


@query("f5_closest_matches", f"""
WITH RECURSIVE {PEAKS}, c AS (
  SELECT pa.vec_id, i, j, abs(pa.x - pb.x) AS cost, row_number() OVER (PARTITION BY pa.vec_id ORDER BY abs(pa.x - pb.x), i, j) AS k FROM pa JOIN pb ON pb.vec_id = pa.vec_id AND abs(pa.x - pb.x) <= CAST(0.004 AS DOUBLE)
), {GREEDY}
SELECT vec_id, len(ui) AS matches FROM done
""")
def f5(t):
    return _peak_pairs(t).select("vec_id", P.closest_matches(F.col("a"), F.col("b"), 0.004).cast("long").alias("matches"))


@query("f6_chain_merge", """
WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i FROM orders),
r AS (SELECT o_custkey, i, x AS anchor FROM o WHERE i = 1 UNION ALL SELECT o.o_custkey, o.i, CASE WHEN o.x - r.anchor <= 20000 THEN r.anchor ELSE o.x END FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.i = r.i + 1)
SELECT o_custkey, count(DISTINCT anchor) AS n_runs, count(*) AS n FROM r GROUP BY 1
""")
def f6(t):
    """Runs are anchored at their first value, so they are not sessions."""
    lists = t("orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_totalprice").alias("x"), F.lit(1.0).alias("y"))).alias("l"))
    runs = V.chain_merged(F.col("l"), 20000.0)
    return lists.select("o_custkey", F.size(runs).cast("long").alias("n_runs"), V.total(F.transform(runs, lambda p: p.y)).cast("long").alias("n"))


@query("f7_bit_tanimoto", """
WITH b AS (SELECT vec_id, label, list_reduce(list_prepend(0::UBIGINT, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::UBIGINT << (i - 1)) ELSE 0::UBIGINT END)), lambda x, y: x | y) AS b FROM embeddings), n AS (SELECT *, lead(b) OVER (PARTITION BY label ORDER BY vec_id) AS c FROM b)
SELECT vec_id, round(bit_count(b & c) / bit_count(b | c), 6) AS tanimoto FROM n WHERE c IS NOT NULL
""")
def f7(t):
    rows = t("embeddings").select("vec_id", "label", V.sign_bits(F.col("embedding")).alias("b"))
    nxt = F.lead("b").over(Window.partitionBy("label").orderBy("vec_id"))
    return rows.withColumn("c", nxt).where("c is not null").select("vec_id", F.round(V.bit_tanimoto(F.col("b"), F.col("c")), 6).alias("tanimoto"))


@query("f8_set_tanimoto", f"""
WITH s AS (SELECT item_id, list(w) AS l FROM ({SETS}) GROUP BY 1) SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.l, y.l)) / len(list_distinct(list_concat(x.l, y.l))), 6) AS tanimoto FROM s x JOIN s y ON y.item_id = x.item_id + 1
""")
def f8(t):
    s = item_words(t).groupBy("item_id").agg(F.collect_set("w").alias("l"))
    nxt = s.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("l").alias("m"))
    return s.join(nxt, "item_id").select(F.col("item_id").alias("a"), "b", F.round(V.set_tanimoto(F.col("l"), F.col("m")), 6).alias("tanimoto"))


BITS = "q AS (SELECT label AS q, CAST(i AS BIGINT) AS bit, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT vec_id, CAST(i AS BIGINT) AS bit FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE v > 0)"


def bit_rows(t):
    v = t("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("bit", "v"))
    q = v.groupBy(F.col("label").alias("q"), "bit").agg(F.avg((F.col("v") > 0).cast("double")).alias("p"))
    return q, v.where("v > 0").select("vec_id", "bit")


@query("f9_continuous_tanimoto", f"""
WITH {BITS}, s AS (SELECT q, vec_id, sum(p) AS sp, count(*) AS n FROM c JOIN q USING (bit) GROUP BY 1, 2), t AS (SELECT q, sum(p) AS total FROM q GROUP BY 1), r AS (SELECT q, vec_id, sp / (n + total - sp) AS s FROM s JOIN t USING (q)),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, vec_id) AS rank FROM r) SELECT q, vec_id, round(s, 6) AS score, rank FROM k WHERE rank <= 5
""")
def f9(t):
    q, c = bit_rows(t)
    s = c.join(q, "bit").groupBy("q", "vec_id").agg(F.sum("p").alias("sp"), F.count("*").alias("n"))
    s = s.join(q.groupBy("q").agg(F.sum("p").alias("total")), "q").withColumn("s", F.col("sp") / (F.col("n") + F.col("total") - F.col("sp")))
    return R.top_k(s, ["q"], [F.round("s", 9).desc(), F.col("vec_id")], 5).select("q", "vec_id", F.round("s", 6).alias("score"), "rank")


@query("f10_log_odds", f"""
WITH {BITS}, s AS (SELECT q, vec_id, sum(ln(least(greatest(p, 0.001), 0.999) / (1 - least(greatest(p, 0.001), 0.999)))) AS s FROM c JOIN q USING (bit) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 8) DESC, vec_id) AS rank FROM s) SELECT q, vec_id, round(s, 5) AS score, rank FROM k WHERE rank <= 5
""")
def f10(t):
    q, c = bit_rows(t)
    p = F.least(F.greatest("p", F.lit(0.001)), F.lit(0.999))
    s = c.join(q, "bit").groupBy("q", "vec_id").agg(F.sum(F.ln(p / (1 - p))).alias("s"))
    return R.top_k(s, ["q"], [F.round("s", 8).desc(), F.col("vec_id")], 5).select("q", "vec_id", F.round("s", 5).alias("score"), "rank")


@query("f11_mixture_likelihood", f"""
WITH {BITS}, b AS (SELECT bit, avg(p) AS bg FROM q GROUP BY 1) SELECT q, round(sum(sqrt(p) * ln(0.8 * p + 0.2 * bg + 1e-6)), 5) AS loglik FROM q JOIN b USING (bit) GROUP BY 1
""")
def f11(t):
    """A query's likelihood under a mixture of its own and a background rate, weighted by square roots."""
    q, _ = bit_rows(t)
    bg = q.groupBy("bit").agg(F.avg("p").alias("bg"))
    return q.join(bg, "bit").groupBy("q").agg(F.round(F.sum(F.sqrt("p") * F.ln(0.8 * F.col("p") + 0.2 * F.col("bg") + 1e-6)), 5).alias("loglik"))


@query("f12_mass_prior", "SELECT p_partkey, round(-0.5 * pow((p_retailprice - 950) / 950 * 1e6 / 20000, 2) + CASE WHEN p_size > 25 THEN 0.1 ELSE 0 END, 6) AS prior FROM part")
def f12(t):
    ppm = (F.col("p_retailprice") - 950) / 950 * 1e6
    return t("part").select("p_partkey", F.round(-0.5 * F.pow(ppm / 20000, F.lit(2.0)) + F.when(F.col("p_size") > 25, 0.1).otherwise(0.0), 6).alias("prior"))


@query("f13_analog_propagation", f"""
WITH s AS ({SETS}), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS c FROM s x JOIN s y ON x.w = y.w AND x.item_id <> y.item_id GROUP BY 1, 2)
SELECT a, round(max((b % 10) * pow(c / (na.n + nb.n - c), 3)), 6) AS best FROM p JOIN n na ON a = na.item_id JOIN n nb ON b = nb.item_id GROUP BY 1
""")
def f13(t):
    """The best of what others pass on: their own score by the cube of the similarity. Own scores are 9 at most."""
    cubed = lambda similarity, other: (other % 10) * F.pow(similarity, F.lit(3.0))
    best = J.top_similar_sets(item_words(t).distinct(), "item_id", "w", 1, score=cubed, least=lambda bound: F.pow(bound / 9, F.lit(1 / 3)))
    return best.select(F.col("item_id").alias("a"), F.round("score", 6).alias("best"))


@query("f14_softmax_attention", """
WITH t AS (SELECT o_custkey, o_totalprice, o_orderkey % 2 AS bit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), m AS (SELECT *, max(o_totalprice) OVER (PARTITION BY o_custkey) AS mx FROM t WHERE k <= 5), f AS (SELECT avg(o_orderkey % 2) AS f FROM orders)
SELECT o_custkey, round(0.9 * sum(exp((o_totalprice - mx) / 50000) * bit) / sum(exp((o_totalprice - mx) / 50000)) + 0.1 * any_value(f), 6) AS p FROM m, f GROUP BY 1
""")
def f14(t):
    top = R.top_k(t("orders").withColumn("bit", F.col("o_orderkey") % 2), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)
    e = F.exp((F.col("o_totalprice") - F.max("o_totalprice").over(Window.partitionBy("o_custkey"))) / 50000)
    f = t("orders").agg(F.avg(F.col("o_orderkey") % 2).alias("f"))  # one row
    got = top.withColumn("e", e).groupBy("o_custkey").agg((F.sum(F.col("e") * F.col("bit")) / F.sum("e")).alias("s"))
    return got.crossJoin(F.broadcast(f)).select("o_custkey", F.round(0.9 * F.col("s") + 0.1 * F.col("f"), 6).alias("p"))


Z = "(({x} - avg({x}) OVER w) / (stddev_pop({x}) OVER w + 1e-6))"


@query("f15_linear_fusion", f"""
SELECT l_orderkey, l_partkey, l_quantity, round({Z.format(x='l_quantity')} + 0.25 * {Z.format(x='l_discount')} + {Z.format(x='l_tax')} + 8 * pow(l_discount * 10, 32) + 24 * l_tax, 4) AS fused FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)
""")
def f15(t):
    z = lambda c: R.zscore(F.col(c), ["l_orderkey"])
    fused = z("l_quantity") + 0.25 * z("l_discount") + z("l_tax") + 8 * F.pow(F.col("l_discount") * 10, F.lit(32.0)) + 24 * F.col("l_tax")
    return t("lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.round(fused, 4).alias("fused"))


@query("f16_fusion_absent_terms", f"""
WITH a AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN l_discount END AS d FROM lineitem) SELECT l_orderkey, l_partkey, l_quantity, round({Z.format(x='l_quantity')} + coalesce(0.5 * {Z.format(x='d')}, 0), 4) AS fused FROM a WINDOW w AS (PARTITION BY l_orderkey)
""")
def f16(t):
    df = t("lineitem").withColumn("d", F.when(F.col("l_returnflag") == "R", F.col("l_discount")))
    fused = R.zscore(F.col("l_quantity"), ["l_orderkey"]) + F.coalesce(0.5 * R.zscore(F.col("d"), ["l_orderkey"]), F.lit(0.0))
    return df.select("l_orderkey", "l_partkey", "l_quantity", F.round(fused, 4).alias("fused"))


# Weights of fifteen terms; the library score counts by its 32nd power.
FUSION_STANDARD = {"phys": 1.0, "mlp": 0.25, "rev": 1.0, "att": 2.0, "cnn": 2.0, "ft": 2.0, "fp": 1.0}
FUSION_PLAIN = {"ana": 24.0, "g0": -2.0, "g1": 0.0, "g2": -1.0, "g3": 4.0, "g4": 0.0, "g5": 1.5}
FUSION_POWERS = {"lib": (32.0, 8.0)}
#: Some queries lack a model altogether, some candidates a library or analog score.
FUSION_TERMS = {
    "phys": "l_quantity", "mlp": "l_discount", "rev": "l_extendedprice / 1000", "att": "CASE WHEN l_orderkey % 3 <> 0 THEN l_tax END", "cnn": "CASE WHEN l_orderkey % 4 <> 1 THEN l_partkey % 100 END",
    "ft": "CASE WHEN l_orderkey % 5 <> 2 THEN l_linenumber END", "fp": "CASE WHEN l_orderkey % 7 <> 3 THEN l_suppkey % 10 END", "lib": "CASE WHEN l_returnflag <> 'N' THEN l_discount * 10 END", "ana": "CASE WHEN l_returnflag <> 'A' THEN l_tax END",
    "g0": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END", "g1": "l_tax * 2", "g2": "l_suppkey % 2", "g3": "l_discount", "g4": "l_linenumber % 3", "g5": "l_tax",
}
FUSED_SQL = " + ".join(
    [f"coalesce({w} * ({c} - avg({c}) OVER w) / (stddev_pop({c}) OVER w + CAST(1e-6 AS DOUBLE)), 0)" for c, w in FUSION_STANDARD.items()]
    + [f"coalesce({w} * {c}, 0)" for c, w in FUSION_PLAIN.items()]
    + [f"coalesce({w} * pow(greatest({c}, 0), {p}), 0)" for c, (p, w) in FUSION_POWERS.items()]
)


@query("f16_fusion_terms", f"""
WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, {", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in FUSION_TERMS.items())} FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, round({FUSED_SQL}, 4) AS fused FROM r WINDOW w AS (PARTITION BY l_orderkey)
""")
def f16_terms(t):
    """Fifteen terms, of which queries or candidates may lack some."""
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *[F.expr(f"CAST({x} AS DOUBLE)").alias(c) for c, x in FUSION_TERMS.items()])
    fused = fusion.fused_score(rows, "l_orderkey", FUSION_STANDARD, FUSION_PLAIN, FUSION_POWERS)
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.round(fused, 4).alias("fused"))


@query("f17_gated_blend", "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'O' THEN 0.7 * o_totalprice + 0.3 * o_custkey ELSE o_totalprice END, 4) AS blend FROM orders")
def f17(t):
    return t("orders").select("o_orderkey", F.round(F.when(F.col("o_orderstatus") == "O", 0.7 * F.col("o_totalprice") + 0.3 * F.col("o_custkey")).otherwise(F.col("o_totalprice")), 4).alias("blend"))


@query("f18_cascade", f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part), c AS (SELECT * FROM s WHERE k <= 30),
z AS (SELECT p_brand, p_partkey, round(0.6 * {Z.format(x='p_size')} + 0.4 * {Z.format(x='p_retailprice')} + 0.05 * (p_partkey % 10), 6) AS s FROM c WINDOW w AS (PARTITION BY p_brand))
SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) AS rank FROM z) WHERE rank <= 10
""")
def f18(t):
    """A cheap score cuts a shortlist; the fused score ranks that alone."""
    short = R.top_k(t("part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 30, "k")
    s = 0.6 * R.zscore(F.col("p_size"), ["p_brand"]) + 0.4 * R.zscore(F.col("p_retailprice"), ["p_brand"]) + 0.05 * (F.col("p_partkey") % 10)
    return R.top_k(short.withColumn("s", F.round(s, 6)), ["p_brand"], [F.col("s").desc(), F.col("p_partkey")], 10).select("p_brand", "p_partkey", "rank")


@query("f19_key_hash", """
WITH k AS (SELECT o_custkey, md5(count(*) || '|' || string_agg(CAST(CAST(round(o_totalprice / 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(round(o_totalprice / 1000) AS BIGINT))) AS h FROM orders GROUP BY 1) SELECT o_custkey, h FROM k
""")
def f19(t):
    """A hash of rounded, sorted content, by which equal records meet."""
    l = F.array_sort(F.collect_list(F.round(F.col("o_totalprice") / 1000).cast("long")))  # noqa: E741
    return t("orders").groupBy("o_custkey").agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), F.array_join(l.cast("array<string>"), ","))).alias("h"))


@query("f20_neighbourhood_hash", """
WITH e AS (SELECT DISTINCT o_custkey AS a, 100000000 + l_partkey AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT a, count(*) AS h FROM u GROUP BY 1),
n AS (SELECT u.a, md5(any_value(d0.h) || ':' || string_agg(CAST(d.h AS VARCHAR), ',' ORDER BY d.h)) AS h FROM u JOIN d ON u.b = d.a JOIN d d0 ON d0.a = u.a GROUP BY 1) SELECT a AS node, h FROM n
""")
def f20(t):
    """One round of neighbourhood hashing on a graph: a node's own label with the sorted labels around it."""
    e = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("a"), (F.lit(100000000).cast("long") + F.col("l_partkey")).alias("b")).distinct()
    u = e.unionAll(e.select("b", "a"))
    d = u.groupBy("a").agg(F.count("*").alias("h"))
    around = u.join(d.select(F.col("a").alias("b"), F.col("h").alias("nh")), "b").groupBy("a").agg(F.array_sort(F.collect_list("nh")).alias("l"))
    return around.join(d, "a").select(F.col("a").alias("node"), F.md5(F.concat_ws(":", F.col("h").cast("string"), F.array_join(F.col("l").cast("array<string>"), ","))).alias("h"))


MARK = "CAST('0x' || substr(md5({x} || '|{r}'), 1, 13) AS BIGINT)"
HASHES = ", ".join(f"""s{r} AS (SELECT e.g, e.a, sum({MARK.format(x="bond || '/' || h", r=r)}) AS s FROM u e JOIN h{r - 1} n ON n.g = e.g AND n.a = e.b GROUP BY 1, 2),
h{r} AS (SELECT h.g, h.a, md5('{r}:' || h || ':' || CAST(coalesce(s, 0) AS VARCHAR)) AS h FROM h{r - 1} h LEFT JOIN s{r} s USING (g, a))""" for r in (1, 2))


@query("f20_neighbourhood_bits", f"""
WITH e AS (SELECT o_custkey AS g, o_orderkey AS a, -l_suppkey - 1 AS b, min(l_returnflag) AS bond FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
u AS (SELECT * FROM e UNION ALL SELECT g, b, a, bond FROM e),
h0 AS (SELECT o_custkey AS g, o_orderkey AS a, md5(o_orderstatus) AS h FROM orders UNION ALL SELECT DISTINCT g, b, md5('S') FROM e), {HASHES},
b AS (SELECT DISTINCT g, CAST('0x' || substr(h, 1, 13) AS BIGINT) % 2048 AS bit FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2))
SELECT g AS o_custkey, count(*) AS n, md5(string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit)) AS bits FROM b GROUP BY 1
""")
def f20_bits(t):
    """Neighbourhoods of up to two steps in each customer's graph, folded to 2,048 bits."""
    nodes, edges = order_graphs(t)
    hashes = graphs.neighbourhood_hashes(nodes, edges, "o_custkey", "node", "label", "o_orderkey", "s", "bond", 2)
    bits = graphs.folded_bits(hashes, "o_custkey", 2048)
    return bits.select("o_custkey", F.size("bits").cast("long").alias("n"), F.md5(F.array_join(F.col("bits").cast("array<string>"), ",")).alias("bits"))


@query("f21_formula_mass", """
SELECT p_partkey, p_size // 10 AS c, p_size % 10 AS h, round((p_size // 10) * 12.0 + (p_size % 10) * 1.00782503207, 6) AS mass, 'C' || (p_size // 10) || 'H' || (p_size % 10) AS key FROM part
""")
def f21(t):
    c, h = F.floor(F.col("p_size") / 10).cast("int"), F.col("p_size") % 10
    return t("part").select("p_partkey", c.alias("c"), h.alias("h"), F.round(c * 12.0 + h * 1.00782503207, 6).alias("mass"), F.concat(F.lit("C"), c.cast("string"), F.lit("H"), h.cast("string")).alias("key"))


#: A formula of a part: units in no order, some twice, some of number 0.
FORMULA = "concat('H', 2 * p_size + 2, 'C', p_size, 'O', p_size % 3, 'N', p_size % 4, 'Cl', p_size % 2, 'O2', CASE WHEN p_size % 5 = 0 THEN 'Xx' ELSE '' END)"
KEY_SQL = "'C' || CASE WHEN c > 1 THEN CAST(c AS VARCHAR) ELSE '' END || 'H' || h || " + " || ".join(f"CASE WHEN {u} = 0 THEN '' WHEN {u} = 1 THEN '{n}' ELSE '{n}' || {u} END" for u, n in (("cl", "Cl"), ("n", "N"), ("o", "O")))


@query("f21_parsed_formulas", f"""
WITH x AS (SELECT p_partkey, p_size AS c, 2 * p_size + 2 AS h, p_size % 2 AS cl, p_size % 4 AS n, p_size % 3 + 2 AS o, p_size % 5 = 0 AS odd FROM part)
SELECT p_partkey, {KEY_SQL} || CASE WHEN odd THEN 'Xx' ELSE '' END AS key, CASE WHEN NOT odd THEN round(c * 12.0 + h * CAST(1.00782503207 AS DOUBLE) + cl * CAST(34.96885268 AS DOUBLE) + n * CAST(14.0030740048 AS DOUBLE) + o * CAST(15.99491461956 AS DOUBLE), 5) END AS mass FROM x
""")
def f21_parsed(t):
    """Keys and masses of formulas as texts; a unit without a mass leaves the key alone."""
    units = t("part").select("p_partkey", formulas.parsed(F.expr(FORMULA)).alias("u"))
    return units.select("p_partkey", formulas.key(F.col("u")).alias("key"), F.round(formulas.mass(F.col("u")), 5).alias("mass"))


@query("f22_metric_identity", """
WITH d AS (SELECT DISTINCT p_type FROM part), k AS (SELECT p_type, left(md5(upper(regexp_replace(p_type, '[^A-Za-z ]', '', 'g'))), 14) AS key FROM d) SELECT key, count(*) AS n FROM part JOIN k USING (p_type) GROUP BY 1
""")
def f22(t):
    """An identity key worked out once per distinct string and joined back, as costly canonical forms are."""
    names = t("part").select("p_type").distinct()
    keys = names.withColumn("key", F.left(F.md5(F.upper(F.regexp_replace("p_type", "[^A-Za-z ]", ""))), F.lit(14)))
    return t("part").join(keys, "p_type").groupBy("key").agg(F.count("*").alias("n"))


@query("f23_half_even_bucket", "SELECT event_id, 5 * round_even(coalesce(value, 20) / 5, 0) AS bucket FROM events")
def f23(t):
    return t("events").select("event_id", V.half_even_bucket(F.col("value"), 5.0, 20.0).alias("bucket"))


@query("f24_merged_values", """
WITH m AS (SELECT l_suppkey, round(l_extendedprice, -2) AS x, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY y DESC, x) AS k FROM m) SELECT l_suppkey, x, y FROM r WHERE k <= 100
""")
def f24(t):
    m = t("lineitem").groupBy("l_suppkey", F.round("l_extendedprice", -2).alias("x")).agg(F.sum("l_quantity").alias("y"))
    return R.top_k(m, ["l_suppkey"], [F.col("y").desc(), F.col("x")], 100, "k").select("l_suppkey", "x", "y")


def order_graphs(t):
    """(nodes, edges) of a graph per customer: its orders and their suppliers, an edge for each pair that a line joins."""
    lines = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", (-F.col("l_suppkey") - 1).alias("s"), "l_returnflag")
    edges = materialize(lines.groupBy("o_custkey", "o_orderkey", "s").agg(F.min("l_returnflag").alias("bond")), "edges")
    orders = t("orders").select("o_custkey", F.col("o_orderkey").alias("node"), F.round(F.col("o_totalprice")).cast("long").alias("w"), F.col("o_orderstatus").alias("label"))
    ends = edges.select("o_custkey", F.col("s").alias("node")).distinct()
    return orders.unionAll(ends.select("o_custkey", "node", (-F.col("node")).alias("w"), F.lit("S"))), edges


@query("g1_fragment_enumeration")
def g1(t):
    """How often each weight arises as a piece of a customer's graph of orders and suppliers after a cut."""
    nodes, edges = order_graphs(t)
    return graphs.fragments(nodes, edges, "o_custkey", "node", "w", "o_orderkey", "s")


@query("g2_shifted_fragments", """
SELECT p_partkey, CAST(s AS INTEGER) AS shift, round(p_retailprice + s * 1.00783, 5) AS shifted FROM part, unnest([-2, -1, 0, 1, 2]) u(s)
""")
def g2(t):
    return G.hydrogen_shifts(t("part").select("p_partkey", "p_retailprice"), "p_retailprice", 1.00783).select("p_partkey", "shift", F.round("shifted", 5).alias("shifted"))


@query("g3_compositions", """
WITH x AS (SELECT c_custkey, round(c_acctbal / 100, 2) AS m FROM customer WHERE c_acctbal > 0)
SELECT c_custkey, CAST(a.range AS INTEGER) AS c, CAST(b.range AS INTEGER) AS o, CAST(h.range AS INTEGER) AS h FROM x, range(0, 9) a, range(0, 7) b, range(0, 21) h WHERE abs(m - a.range * 12.0 - b.range * 15.9949 - h.range * 1.00783) <= 0.02
""")
def g3(t):
    # as round() of SQL: the hundredfold is rounded, not the decimal text
    m = F.round(F.col("c_acctbal") / 100 * 100, 0) / 100
    x = t("customer").where("c_acctbal > 0").select("c_custkey", m.alias("m"))
    return G.compositions(x, "c_custkey", "m", {"c": 12.0, "o": 15.9949, "h": 1.00783}, {"c": 8, "o": 6, "h": 20}, 0.02)


# Masses of the units, and the ratio limits that sensible formulas keep.
UNIT_MASSES = {"c": 12.0, "h": 1.00782503207, "n": 14.0030740048, "o": 15.99491461956, "p": 30.97376163, "s": 31.972071, "f": 18.99840322, "cl": 34.96885268, "br": 78.9183371}
UNIT_LIMITS = {"c": 12, "h": 40, "n": 12, "o": 40, "p": 2, "s": 3, "f": 6, "cl": 4, "br": 3}
HETERO_RULE = "CAST(br > 0 AS INT) + CAST(cl > 0 AS INT) + CAST(f > 0 AS INT) <= 1 AND br + cl + f + s + p <= 4"
FRAME_RULE = "c >= 1 AND h <= 3.1 * c + 3 AND h >= 0.1 * c - 1"
FORMULA_RULE = """n <= 1.3 * c AND o <= 1.2 * c + 1 AND p <= 0.3 * c + 1 AND s <= 0.8 * c + 1 AND f <= 1.5 * c AND cl <= 0.8 * c AND br <= 0.8 * c
  AND 2 * c + n + p - h - f - cl - br + 2 >= 0 AND (2 * c + n + p - h - f - cl - br + 2) % 2 = 0
  AND 4 * c + h + 3 * n + 2 * o + 3 * p + 2 * s + f + cl + br >= 2 * (c + h + n + o + p + s + f + cl + br - 1)"""
HETERO, FRAME = ("n", "o", "p", "s", "f", "cl", "br"), ("c", "h")


def mass_sql(units):
    return " + ".join(f"{u} * CAST({UNIT_MASSES[u]!r} AS DOUBLE)" for u in units)


@query("g3_ruled_compositions", f"""
WITH x AS (SELECT c_custkey, 2 * c_acctbal / 100 AS m FROM customer WHERE c_acctbal > 0), {", ".join(f"r{u} AS (SELECT CAST(range AS INTEGER) AS {u} FROM range({UNIT_LIMITS[u] + 1}))" for u in UNIT_MASSES)},
a AS (SELECT *, {mass_sql(HETERO)} AS ma FROM {", ".join(f"r{u}" for u in HETERO)} WHERE {mass_sql(HETERO)} <= 201 AND {HETERO_RULE}), b AS (SELECT *, {mass_sql(FRAME)} AS mb FROM rc, rh WHERE {FRAME_RULE}),
y AS (SELECT * FROM a JOIN b ON {FORMULA_RULE.replace(chr(10), " ")})
SELECT c_custkey, {", ".join(UNIT_MASSES)} FROM x JOIN y ON m BETWEEN ma + mb - 0.02 AND ma + mb + 0.02 WHERE abs(m - (ma + mb)) <= 0.002
""")
def g3_ruled(t):
    """Formulas of nine units for a mass, by two half tables that meet in the middle, with limits on ratios and valences."""
    x = t("customer").where("c_acctbal > 0").select("c_custkey", (2 * F.col("c_acctbal") / 100).alias("m"))
    halves = tuple({u: UNIT_MASSES[u] for u in half} for half in (HETERO, FRAME))
    rules = tuple((lambda r=r: F.expr(r)) for r in (HETERO_RULE, FRAME_RULE, FORMULA_RULE))
    return G.ruled_compositions(x, "c_custkey", "m", halves, UNIT_LIMITS, 0.002, rules).select("c_custkey", *UNIT_MASSES)


@query("g4_log_posterior", """
WITH w AS (SELECT o_custkey AS q, o_orderpriority AS c, sum(o_totalprice) AS w, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1, 2), x AS (SELECT *, ln(w) / 0.5 AS x, max(ln(w) / 0.5) OVER (PARTITION BY q) AS m FROM w)
SELECT q, c, n AS n_sources, round(x - m - ln(sum(exp(x - m)) OVER (PARTITION BY q)), 5) AS log_p FROM x
""")
def g4(t):
    rows = t("orders").select(F.col("o_custkey").alias("q"), F.col("o_orderpriority").alias("c"), "o_orderstatus", "o_totalprice")
    return G.log_posterior(rows, "q", "o_orderstatus", "c", "o_totalprice", 0.5).withColumn("log_p", F.round("log_p", 5))


@query("g5_sub_compositions", """
WITH x AS (SELECT p_partkey, p_size // 10 AS c, p_size % 10 AS h, p_size / 2 AS m FROM part)
SELECT p_partkey, (SELECT count(*) FROM range(0, 7) a, range(0, 11) b WHERE a.range <= c AND b.range <= h AND abs(m - a.range * 12 - b.range * CAST(1.00783 AS DOUBLE)) <= CAST(0.8 AS DOUBLE)) AS n FROM x
""")
def g5(t):
    """How many sub-formulas of a formula have a given mass."""
    rows = t("part").select("p_partkey", F.floor(F.col("p_size") / 10).alias("c"), (F.col("p_size") % 10).alias("h"), (F.col("p_size") / 2).alias("m"))
    return G.sub_compositions(rows, "p_partkey", {"c": "c", "h": "h"}, {"c": 12.0, "h": 1.00783}, "m", 0.8)


@query("g5_composition_counts", """
WITH x AS (SELECT DISTINCT p_size, p_size // 5 AS c, p_size AS h, p_size % 7 AS o, p_size % 4 AS n FROM part),
y AS (SELECT *, (12 * c + h + 16 * o + 14 * n) // 2 AS m FROM x),
k AS (SELECT p_size, (SELECT count(*) FROM range(0, 11) a(i), range(0, 51) b(j), range(0, 7) d(k), range(0, 4) e(l) WHERE i <= c AND j <= h AND k <= o AND l <= n AND abs(12 * i + j + 16 * k + 14 * l - m) <= 1) AS n FROM y)
SELECT p_partkey, k.n FROM part JOIN k USING (p_size)
""")
def g5_counts(t):
    """How many sub-formulas have about half a formula's whole mass, by tables of counts instead of the formulas themselves."""
    size = F.col("p_size").cast("long")
    rows = t("part").select("p_partkey", F.floor(size / 5).alias("c"), size.alias("h"), (size % 7).alias("o"), (size % 4).alias("n"))
    rows = rows.withColumn("m", F.floor((12 * F.col("c") + F.col("h") + 16 * F.col("o") + 14 * F.col("n")) / 2))
    return G.composition_counts(rows.withColumnRenamed("n", "k"), "p_partkey", {"c": "c", "h": "h", "o": "o", "n": "k"}, {"c": 12, "h": 1, "o": 16, "n": 14}, "m", 1)


@query("g6_operation_chains", """
WITH ops AS (SELECT n_nationkey AS op, (n_nationkey - 12) * CAST(3.7 AS DOUBLE) AS s FROM nation), c AS (SELECT op AS a, NULL AS b, s FROM ops UNION ALL SELECT x.op, y.op, x.s + y.s FROM ops x JOIN ops y ON x.op <= y.op WHERE abs(x.s + y.s) > 1e-9)
SELECT s_suppkey, a AS first, b AS second FROM supplier JOIN c ON abs(s_acctbal / 100 - c.s) <= 0.0503
""")
def g6(t):
    ops = t("nation").select(F.col("n_nationkey").alias("op"), ((F.col("n_nationkey") - 12) * F.lit(3.7)).alias("s"))
    q = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("d"))
    return G.chains(q, ops, "s_suppkey", "d", "op", "s", 0.0503).select("s_suppkey", "first", "second")


@query("g7_generated_products", """
WITH p AS (SELECT l_partkey AS analog, l_suppkey AS op, l_discount AS sim, l_linenumber AS rank FROM lineitem), k AS (SELECT (analog * 31 + op) % 1000 AS product, sim, rank, op FROM p)
SELECT product, max(sim) AS best_sim, min(rank) AS best_rank, count(DISTINCT op) AS n_ops, count(*) AS support FROM k GROUP BY 1
""")
def g7(t):
    """Products of operations on analogs, folded by their key."""
    k = t("lineitem").select(((F.col("l_partkey") * 31 + F.col("l_suppkey")) % 1000).alias("product"), "l_discount", "l_linenumber", "l_suppkey")
    return k.groupBy("product").agg(F.max("l_discount").alias("best_sim"), F.min("l_linenumber").alias("best_rank"), F.countDistinct("l_suppkey").alias("n_ops"), F.count("*").alias("support"))


@query("g7_formula_products", f"""
WITH a AS (SELECT l_suppkey AS q, p_size AS c, 2 * p_size + 2 AS h, p_size % 2 AS cl, p_size % 4 AS n, p_size % 3 + 2 AS o, l_discount AS sim, l_linenumber AS rank FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 5 <> 0),
op AS (SELECT n_nationkey AS op, n_nationkey % 3 - 1 AS dc, 2 * (n_nationkey % 3 - 1) AS dh, n_nationkey % 5 - 2 AS d_o, -(n_nationkey % 2) AS dcl FROM nation),
p AS (SELECT q, op, c + dc AS c, h + dh AS h, cl + dcl AS cl, n, o + d_o AS o, sim, rank FROM a, op WHERE c + dc >= 0 AND h + dh >= 0 AND cl + dcl >= 0 AND o + d_o >= 0)
SELECT q, CASE WHEN c = 0 THEN concat(CASE WHEN cl = 0 THEN '' WHEN cl = 1 THEN 'Cl' ELSE 'Cl' || cl END, CASE WHEN h = 0 THEN '' WHEN h = 1 THEN 'H' ELSE 'H' || h END, CASE WHEN n = 0 THEN '' WHEN n = 1 THEN 'N' ELSE 'N' || n END,
  CASE WHEN o = 0 THEN '' WHEN o = 1 THEN 'O' ELSE 'O' || o END) ELSE {KEY_SQL} END AS product,
  max(sim) AS best_sim, min(rank) AS best_rank, count(DISTINCT op) AS n_ops, count(*) AS support FROM p GROUP BY 1, 2
""")
def g7_formulas(t):
    """Formulas that operations make of a supplier's parts, each with its best source."""
    parts = t("part").where("p_size % 5 <> 0").select("p_partkey", formulas.parsed(F.expr(FORMULA)).alias("u"))
    analogs = t("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("q"), "u", "l_discount", "l_linenumber")
    step = F.col("n_nationkey") % 3 - 1
    change = F.array(*[F.struct(F.lit(u).alias("unit"), n.cast("long").alias("n")) for u, n in (("C", step), ("H", 2 * step), ("O", F.col("n_nationkey") % 5 - 2), ("Cl", -(F.col("n_nationkey") % 2)))])
    ops = t("nation").select("n_nationkey", change.alias("change"))
    return G.generated_products(analogs, ops, "q", "u", "l_discount", "l_linenumber", "n_nationkey", "change")


@query("g8_absorbing_chain", """
WITH RECURSIVE n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
e AS (SELECT a.o_custkey, a.i AS i, b.i AS j, CASE WHEN b.i = a.i + 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS p FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND b.i IN (a.i + 1, a.i + 2)),
o AS (SELECT o_custkey, i, sum(p) AS gone FROM e GROUP BY 1, 2),
m AS (SELECT o_custkey, i, CAST(1 AS DOUBLE) AS m, 0 AS k FROM n WHERE i = 1 UNION ALL SELECT m.o_custkey, j, m * p, k + 1 FROM m JOIN e ON e.o_custkey = m.o_custkey AND e.i = m.i WHERE k < 4)
SELECT m.o_custkey, m.i AS node, round(sum(m * (1 - coalesce(gone, 0))), 6) AS observed FROM m LEFT JOIN o ON o.o_custkey = m.o_custkey AND o.i = m.i GROUP BY 1, 2
""")
def g8(t):
    """Mass that starts at a customer's first order, steps to the next or the one after, and stays with what is left."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    nodes = t("orders").select("o_custkey", place.alias("node"))
    sizes = nodes.groupBy("o_custkey").agg(F.max("node").alias("n"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("d"), F.lit(0.5).alias("share")), F.struct(F.lit(2).alias("d"), F.lit(0.25).alias("share"))))
    edges = nodes.join(sizes, "o_custkey").withColumn("s", step).select("o_custkey", F.col("node").alias("a"), (F.col("node") + F.col("s.d")).alias("b"), "s.share", "n").where("b <= n").drop("n")
    chain = G.absorbing_chain(edges, nodes.where("node = 1"), "o_custkey", "a", "b", "share", "node", 4)
    return chain.select("o_custkey", "node", F.round("observed", 6).alias("observed"))


@query("g9_explained_share", """
WITH p AS (SELECT o_custkey AS q, o_totalprice AS v, o_orderkey FROM orders), m AS (SELECT o_custkey AS q, o_totalprice + 1000 AS m FROM orders WHERE o_orderstatus = 'O'),
h AS (SELECT q, v, EXISTS (SELECT 1 FROM m WHERE m.q = p.q AND abs(m.m - p.v) <= 2500) AS hit FROM p) SELECT q, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS share_peaks, round(sum(CASE WHEN hit THEN v ELSE 0 END) / sum(v), 6) AS share_intensity FROM h GROUP BY 1
""")
def g9(t):
    p = t("orders").select(F.col("o_custkey").alias("q"), F.col("o_totalprice").alias("v"))
    m = t("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("q"), (F.col("o_totalprice") + 1000).alias("m"))
    got = G.explained_share(p, m, "q", "v", "v", "m", 2500.0)
    return got.select("q", F.round("share_peaks", 6).alias("share_peaks"), F.round("share_intensity", 6).alias("share_intensity"))
