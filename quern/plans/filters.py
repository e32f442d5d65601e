"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import sampling
from quern.operators.joins import optional_equal
from quern.plans.registry import query, uniform_sql


@query("p1_pair_truncation", """
SELECT vec_id, least(len(embedding), 48) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS x1, round(CAST(embedding[2] AS DOUBLE), 5) AS y1 FROM embeddings WHERE len(embedding) > 0
""")
def p1(t):
    pairs = V.pair_truncated(F.slice("embedding", 1, 48), F.slice("embedding", 2, 64))
    df = t("embeddings").withColumn("p", pairs).where(F.size("p") > 0)
    return df.select("vec_id", F.size("p").cast("long").alias("n"), F.round(F.col("p")[0].x.cast("double"), 5).alias("x1"), F.round(F.col("p")[0].y.cast("double"), 5).alias("y1"))


@query("p2_intensity_floor", """
WITH a AS (SELECT vec_id, list_max(embedding) AS m, embedding FROM embeddings)
SELECT vec_id, CAST(CASE WHEN m > 0 THEN len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) >= 0.2 * CAST(m AS DOUBLE))) ELSE len(embedding) END AS BIGINT) AS n_kept FROM a
""")
def p2(t):
    peaks = F.transform("embedding", lambda x, i: F.struct(i.cast("double").alias("x"), x.cast("double").alias("y")))
    return t("embeddings").select("vec_id", F.size(V.above_floor(peaks, 0.2)).cast("long").alias("n_kept"))


@query("p3_strongest_in_order", """
WITH u AS (SELECT vec_id, unnest(embedding) AS y, generate_subscripts(embedding, 1) AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, i) AS rn FROM u)
SELECT vec_id, string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i) AS places FROM r WHERE rn <= 5 GROUP BY vec_id
""")
def p3(t):
    peaks = F.transform("embedding", lambda x, i: F.struct(i.alias("x"), x.alias("y")))
    return t("embeddings").select("vec_id", F.array_join(F.transform(V.strongest(peaks, 5), lambda p: p.x.cast("string")), ",").alias("places"))


@query("p4_range_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def p4(t):
    return t("orders").where(F.col("o_totalprice").between(100000, 120000)).select("o_orderkey", "o_totalprice")


@query("p5_reject_composite", "SELECT page_id, url FROM pages WHERE NOT contains(url, '?') AND length(url) <= 45")
def p5(t):
    return t("pages").where(~F.col("url").contains("?") & (F.length("url") <= 45)).select("page_id", "url")


@query("p6_optional_equality", """
WITH a AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS s FROM orders)
SELECT o_orderkey, o_orderpriority FROM a WHERE s IS NULL OR s = 'O'
""")
def p6(t):
    known = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return t("orders").where(optional_equal(known, F.lit("O"))).select("o_orderkey", "o_orderpriority")


@query("p7_category_normalisation", """
SELECT regexp_replace(replace(o_orderpriority, ' ', ''), '[0-9]', '', 'g') AS category, count(*) AS n FROM orders GROUP BY 1
""")
def p7(t):
    name = F.regexp_replace(F.replace("o_orderpriority", F.lit(" "), F.lit("")), "[0-9]", "")
    return t("orders").groupBy(name.alias("category")).agg(F.count("*").alias("n"))


@query("p8_substring_category", """
SELECT CASE WHEN contains(p_type, 'BRASS') THEN 'brass' WHEN contains(p_type, 'STEEL') THEN 'steel' WHEN contains(p_type, 'COPPER') THEN 'copper' ELSE 'other' END AS metal, count(*) AS n FROM part GROUP BY 1
""")
def p8(t):
    metal = F.lit("other")
    for word in ("COPPER", "STEEL", "BRASS"):  # the last asked wins
        metal = F.when(F.col("p_type").contains(word), word.lower()).otherwise(metal)
    return t("part").groupBy(metal.alias("metal")).agg(F.count("*").alias("n"))


@query("p9_key_prefix", """
SELECT split_part(o_orderpriority, '-', 1) AS prefix, count(*) AS n FROM orders WHERE length(split_part(o_orderpriority, '-', 1)) = 1 GROUP BY 1
""")
def p9(t):
    prefix = F.substring_index("o_orderpriority", "-", 1)
    return t("orders").where(F.length(prefix) == 1).groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))


@query("p10_shifted_value", """
SELECT c_custkey, round((c_acctbal - coalesce(n_regionkey * 1.5, 1.00728)) / CASE WHEN c_nationkey IN (8, 9) THEN 2 ELSE 1 END, 4) AS neutral
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey
""")
def p10(t):
    shifts = t("nation").where("n_nationkey < 20").select("n_nationkey", (F.col("n_regionkey") * 1.5).alias("shift"))
    df = t("customer").join(shifts, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    halved = F.when(F.col("c_nationkey").isin(8, 9), 2).otherwise(1)
    return df.select("c_custkey", F.round((F.col("c_acctbal") - F.coalesce("shift", F.lit(1.00728))) / halved, 4).alias("neutral"))


@query("p11_fractional_digits", "SELECT l_returnflag, round(avg(CASE WHEN abs(l_extendedprice - round(l_extendedprice, 1)) < 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS share FROM lineitem GROUP BY 1")
def p11(t):
    whole = F.abs(F.col("l_extendedprice") - F.round("l_extendedprice", 1)) < 1e-9
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg(whole.cast("double")), 6).alias("share"))


@query("p12_seeded_noise", f"""
SELECT o_orderkey, round(o_totalprice * (1 + sqrt(-2 * ln({uniform_sql('o_orderkey', 1)})) * cos(2 * 3.141592653589793 * {uniform_sql('o_orderkey', 2)}) * 3e-6), 3) AS jittered FROM orders
""")
def p12(t):
    """Values jittered by up to a few millionths; noise comes from the key, so reruns agree."""
    u, v = sampling.uniform(F.col("o_orderkey"), 1), sampling.uniform(F.col("o_orderkey"), 2)
    gauss = F.sqrt(-2 * F.ln(u)) * F.cos(2 * 3.141592653589793 * v)
    return t("orders").select("o_orderkey", F.round(F.col("o_totalprice") * (1 + gauss * 3e-6), 3).alias("jittered"))


@query("p13_two_bins", """
WITH b AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS k, o_totalprice / 1000 - floor(o_totalprice / 1000) AS f FROM orders),
e AS (SELECT o_orderkey, k AS bin FROM b UNION ALL SELECT o_orderkey, CASE WHEN f < 0.5 THEN k - 1 ELSE k + 1 END FROM b)
SELECT bin, count(*) AS n FROM e GROUP BY bin
""")
def p13(t):
    scaled = F.col("o_totalprice") / 1000
    k = F.floor(scaled)
    near = F.when(scaled - k < 0.5, k - 1).otherwise(k + 1)
    return t("orders").select(F.explode(F.array(k, near)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("p14_bucketise", """
SELECT CAST(CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 100 THEN 1 WHEN c_acctbal < 1000 THEN 2 WHEN c_acctbal < 5000 THEN 3 ELSE 4 END AS BIGINT) AS bucket, count(*) AS n FROM customer GROUP BY 1
""")
def p14(t):
    edges = F.array(*[F.lit(float(x)) for x in (0, 100, 1000, 5000)])
    bucket = F.coalesce(F.size(F.filter(edges, lambda e: e <= F.col("c_acctbal"))), F.lit(0)).cast("long")
    return t("customer").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("p15_feature_encoding", """
WITH u AS (SELECT vec_id, label, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
f AS (SELECT vec_id, CAST(floor(i / 4) AS BIGINT) AS feature, sqrt(CAST(y AS DOUBLE)) AS v FROM u WHERE y > 0
UNION ALL SELECT vec_id, 100 + CAST(floor((63 - i) / 4) AS BIGINT), sqrt(CAST(y AS DOUBLE)) FROM u WHERE y > 0
UNION ALL SELECT DISTINCT vec_id, 200 + CAST(label AS BIGINT), 1.0 FROM embeddings)
SELECT vec_id, feature, round(max(v), 6) AS value FROM f GROUP BY 1, 2
""")
def p15(t):
    rows = t("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "y")).where("y > 0")
    v = F.sqrt(F.col("y").cast("double"))
    bins = F.array(F.floor(F.col("i") / 4), 100 + F.floor((63 - F.col("i")) / 4))
    spread = rows.select("vec_id", F.explode(bins).alias("feature"), v.alias("v"))
    hot = t("embeddings").select("vec_id", (200 + F.col("label").cast("long")).alias("feature"), F.lit(1.0).alias("v"))
    return spread.unionByName(hot).groupBy("vec_id", "feature").agg(F.round(F.max("v"), 6).alias("value"))
