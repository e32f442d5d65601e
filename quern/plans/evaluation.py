"""Retrieval evaluation. Queries are orders, candidates their lines, the score is the discount."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import evaluate as E
from quern.operators import sampling
from quern.operators import joins as J
from quern.plans.registry import mark_sql, query, uniform_sql

CANDIDATES = "SELECT l_orderkey AS q, l_discount AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_discount, l_extendedprice) = 1 AND l_orderkey % 9 <> 0 AS truth FROM lineitem"
STANDING = f"WITH c AS ({CANDIDATES}), t AS (SELECT q, max(s) FILTER (WHERE truth) AS ts, count(*) AS n FROM c GROUP BY 1), d AS (SELECT c.q, any_value(n) AS n, CASE WHEN any_value(ts) IS NULL THEN NULL ELSE count(CASE WHEN s > ts THEN 1 END) END AS better, CASE WHEN any_value(ts) IS NULL THEN NULL ELSE count(CASE WHEN s = ts THEN 1 END) - 1 END AS tied FROM c JOIN t USING (q) GROUP BY 1)"


def candidates(t):
    first = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc(), "l_partkey", "l_discount", "l_extendedprice")
    truth = (F.row_number().over(first) == 1) & (F.col("l_orderkey") % 9 != 0)
    return t("lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_discount").alias("s"), truth.alias("truth"))


def standing(t):
    return E.truth_standing(candidates(t), "q", "s", "truth")


@query("e0_truth_standing", f"{STANDING} SELECT q, n, better, tied FROM d")
def e0(t):
    return standing(t)


@query("e1_mrr_pessimistic", f"{STANDING} SELECT round(avg(CASE WHEN better + 1 + tied <= 3 THEN 1 / (better + 1 + tied) ELSE 0 END), 6) AS mrr FROM d")
def e1(t):
    return E.mean_reciprocal_rank(standing(t), 3, "pessimistic").select(F.round("mrr", 6).alias("mrr"))


@query("e2_mrr_averaged", f"{STANDING} SELECT round(avg(CASE WHEN better < 3 THEN 1 / (better + 1 + tied / 2) ELSE 0 END), 6) AS mrr FROM d")
def e2(t):
    return E.mean_reciprocal_rank(standing(t), 3, "averaged").select(F.round("mrr", 6).alias("mrr"))


@query("e3_hit_rates", f"{STANDING} SELECT round(avg(CASE WHEN better + tied + 1 <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN better + tied + 1 <= 5 THEN 1.0 ELSE 0.0 END), 6) AS top5 FROM d")
def e3(t):
    return E.hit_rates(standing(t), [1, 5]).select(F.round("top1", 6).alias("top1"), F.round("top5", 6).alias("top5"))


@query("e4_recall_summary", f"""
{STANDING}, m AS (SELECT list(better + 1 ORDER BY better) FILTER (WHERE better IS NOT NULL) AS l FROM d)
SELECT round(avg(1 / (better + 1)), 6) AS mrr_in, round(avg(coalesce(1 / (better + 1), 0)), 6) AS mrr_all, round(avg(CASE WHEN better + 1 <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall1, round(avg(CASE WHEN better + 1 <= 25 THEN 1.0 ELSE 0.0 END), 6) AS recall25, (SELECT l[len(l) // 2 + 1] FROM m) AS median_rank FROM d
""")
def e4(t):
    r = E.recall_summary(standing(t), [1, 25])
    return r.select(*[F.round(c, 6).alias(c) for c in ("mrr_in", "mrr_all", "recall1", "recall25")], "median_rank")


@query("e5_list_similarity", """
WITH p AS (SELECT l_orderkey AS q, l_discount AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_discount, l_extendedprice) AS k FROM lineitem)
SELECT q, max(v) AS most, max(CASE WHEN k = 1 THEN v END) AS first, round(avg(v), 6) AS mean, round(sum(v / k) / sum(1 / k), 6) AS weighted, count(CASE WHEN v >= 0.05 THEN 1 END) AS n_over, max(CASE WHEN k <= 3 THEN v END) AS most3 FROM p GROUP BY 1
""")
def e5(t):
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc(), "l_partkey", "l_discount", "l_extendedprice"))
    p = t("lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_discount").alias("v"), k.alias("k"))
    return p.groupBy("q").agg(F.max("v").alias("most"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("first"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.sum(F.col("v") / F.col("k")) / F.sum(1 / F.col("k")), 6).alias("weighted"), F.count_if(F.col("v") >= 0.05).alias("n_over"), F.max(F.when(F.col("k") <= 3, F.col("v"))).alias("most3"))


@query("e6_bootstrap", f"""
{STANDING}, r AS (SELECT q, coalesce(1 / (better + 1), 0) AS rr FROM d),
u AS (SELECT rr, k, {uniform_sql("q, '|', k", 3)} AS u FROM r, (SELECT unnest(range(1, 1001)) AS k)),
w AS (SELECT k, rr, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183], lambda p: u > CAST(p AS DOUBLE))) AS w FROM u),
m AS (SELECT k, sum(w * rr) / sum(w) AS m FROM w GROUP BY 1)
SELECT round((SELECT avg(rr) FROM r), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m
""")
def e6(t):
    rows = standing(t).select("q", F.coalesce(1 / (F.col("better") + 1), F.lit(0.0)).alias("rr"))
    return sampling.bootstrap_mean(rows, "q", "rr", 1000, seed=3).select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query("e7_paired_error", "SELECT count(*) AS n, round(avg(o_totalprice - 1000 * (o_custkey % 300)), 4) AS mean_delta, round(stddev_samp(o_totalprice - 1000 * (o_custkey % 300)) / sqrt(count(*)), 4) AS standard_error FROM orders")
def e7(t):
    df = t("orders").select((1000 * (F.col("o_custkey") % 300)).alias("a"), F.col("o_totalprice").alias("b"))
    return E.paired_error(df, "a", "b").select("n", F.round("mean_delta", 4).alias("mean_delta"), F.round("standard_error", 4).alias("standard_error"))


@query("e8_weighted_mixture", """
WITH s AS (SELECT o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY 1), w(o_orderstatus, w) AS (VALUES ('F', 0.5), ('O', 0.42), ('P', 0.08)) SELECT round(sum(m * w) / sum(w), 4) AS mixture FROM s JOIN w USING (o_orderstatus)
""")
def e8(t):
    s = t("orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    w = F.create_map(*[F.lit(x) for kv in {"F": 0.5, "O": 0.42, "P": 0.08}.items() for x in kv])[F.col("o_orderstatus")]
    return s.agg(F.round(F.sum(F.col("m") * w) / F.sum(w), 4).alias("mixture"))


@query("e9_failure_decomposition", f"""
{STANDING} SELECT count(*) AS n, count(better) AS present, count(CASE WHEN better + tied < 5 THEN 1 END) AS reachable, count(CASE WHEN better = 0 AND tied = 0 THEN 1 END) AS ranked_first FROM d
""")
def e9(t):
    return standing(t).agg(F.count("*").alias("n"), F.count("better").alias("present"), F.count_if(F.col("better") + F.col("tied") < 5).alias("reachable"), F.count_if((F.col("better") == 0) & (F.col("tied") == 0)).alias("ranked_first"))


@query("e10_source_ceiling", """
SELECT c_custkey, bool_or(coalesce(o_custkey = c_custkey, false)) AS reachable, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_totalprice BETWEEN 20 * c_acctbal * (1 - 0.01) AND 20 * c_acctbal * (1 + 0.01) WHERE c_acctbal > 0 GROUP BY 1
""")
def e10(t):
    """Whether a band of candidates holds the row's own."""
    left = t("customer").where("c_acctbal > 0").select("c_custkey", (20 * F.col("c_acctbal")).alias("m"))
    low, high = F.col("m") * F.lit(1 - 0.01), F.col("m") * F.lit(1 + 0.01)
    bands = left.select("m").distinct().select("m", low.alias("low"), high.alias("high"))
    counts = J.counts_between(bands, t("orders").where("o_orderkey IS NOT NULL"), "o_totalprice", "n").select("m", "n")
    mine = (F.col("c_custkey") == F.col("o_custkey")) & F.col("o_totalprice").between(low, high)
    own = left.join(t("orders").select("o_custkey", "o_totalprice"), mine, "left_semi").select("c_custkey", F.lit(True).alias("r")).distinct()
    return left.join(counts, "m").join(own, "c_custkey", "left").select("c_custkey", F.coalesce("r", F.lit(False)).alias("reachable"), "n")


@query("e11_records_under_other_keys", """
WITH h AS (SELECT user_id, md5(event_type || '|' || CAST(CAST(round(value, 0) AS BIGINT) AS VARCHAR) || '|' || props) AS h FROM events), k AS (SELECT h FROM h GROUP BY 1 HAVING count(DISTINCT user_id) > 1)
SELECT user_id, count(*) AS n_shared FROM h WHERE h IN (SELECT h FROM k) GROUP BY 1
""")
def e11(t):
    """Leakage: records whose content also stands under another key."""
    h = t("events").select("user_id", F.md5(F.concat_ws("|", "event_type", F.round("value", 0).cast("long").cast("string"), "props")).alias("h"))
    shared = h.groupBy("h").agg((F.min("user_id") != F.max("user_id")).alias("leak")).where("leak").select("h")
    return h.join(shared, "h", "left_semi").groupBy("user_id").agg(F.count("*").alias("n_shared"))


@query("e12_shifted_control", """
WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT a.o_orderkey, round(b.o_totalprice, 4) AS control FROM n a JOIN n b ON b.i = (a.i + 7) % a.n
""")
def e12(t):
    """Every query with the score of the one seven places on."""
    from quern.operators.aggregate import surrogate_ids

    rows = t("orders").select("o_orderkey", "o_totalprice")
    ids = surrogate_ids(rows, "o_orderkey", "i")
    n = ids.count()
    numbered = rows.join(ids, "o_orderkey")
    other = numbered.select(F.pmod(F.col("i") - 7, F.lit(n)).alias("i"), F.round("o_totalprice", 4).alias("control"))
    return numbered.select("o_orderkey", "i").join(other, "i").select("o_orderkey", "control")


HOLDOUT = f"""
WITH k AS (SELECT o_custkey, count(*) AS m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) >= 2), d AS (SELECT * FROM k ORDER BY {mark_sql('o_custkey', 1)}, o_custkey LIMIT 50),
n AS (SELECT o_custkey, o_orderkey, m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders JOIN d USING (o_custkey) WHERE o_orderstatus = 'O')
"""


@query("e13_holdout_sibling", f"""{HOLDOUT}, q AS (SELECT * FROM n WHERE n <= least(3, m - 1))
SELECT o_custkey, (SELECT count(*) FROM q WHERE q.o_custkey = d.o_custkey) AS n_query, (SELECT count(*) FROM orders o WHERE o.o_custkey = d.o_custkey AND o_orderkey NOT IN (SELECT o_orderkey FROM q)) AS n_library FROM d
""")
def e13(t):
    """Holdout keys with a sibling left in the library: per drawn key the sizes of both sides."""
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    queries, library = sampling.holdout(rows, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "O", 2, 50, 3, "sibling", seed=1)
    q = queries.groupBy("o_custkey").agg(F.count("*").alias("n_query"))
    return q.join(library.groupBy("o_custkey").agg(F.count("*").alias("n_library")), "o_custkey")


@query("e13_holdout_other_kind", f"""{HOLDOUT}, q AS (SELECT * FROM n WHERE n <= 3)
SELECT o_custkey, o_orderkey, 'query' AS side FROM q UNION ALL
SELECT o_custkey, o_orderkey, 'library' FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM q) AND (o_custkey NOT IN (SELECT o_custkey FROM d) OR o_orderstatus <> 'O')
""")
def e13b(t):
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    queries, library = sampling.holdout(rows, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "O", 2, 50, 3, "other_kind", seed=1)
    return queries.select("o_custkey", "o_orderkey", F.lit("query").alias("side")).unionAll(library.select("o_custkey", "o_orderkey", F.lit("library")))


@query("e13_holdout_denovo", f"""{HOLDOUT}, q AS (SELECT * FROM n WHERE n <= 3)
SELECT o_custkey, o_orderkey, 'query' AS side FROM q UNION ALL SELECT o_custkey, o_orderkey, 'library' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM d)
""")
def e13c(t):
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    queries, library = sampling.holdout(rows, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "O", 2, 50, 3, "denovo", seed=1)
    return queries.select("o_custkey", "o_orderkey", F.lit("query").alias("side")).unionAll(library.select("o_custkey", "o_orderkey", F.lit("library")))


@query("e14_list_fill", """
WITH l AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT count(*) AS n_lists, count(CASE WHEN n >= 10 THEN 1 END) AS n_full, min(n) AS shortest, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM l
""")
def e14(t):
    l = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))  # noqa: E741
    return l.agg(F.count("*").alias("n_lists"), F.count_if(F.col("n") >= 10).alias("n_full"), F.min("n").alias("shortest"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("coverage"))


@query("e15_list_difference", """
WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a, list(o_orderkey ORDER BY o_totalprice, o_orderkey) AS b FROM orders GROUP BY 1)
SELECT o_custkey, a = b AS same, CAST(list_position(list_transform(range(1, len(a) + 1), lambda i: a[i] <> b[i]), true) AS BIGINT) AS first_difference FROM l
""")
def e15(t):
    row = F.struct("o_totalprice", "o_orderkey")
    l = t("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"), F.transform(F.array_sort(F.collect_list(row)), lambda x: x.o_orderkey).alias("b"))  # noqa: E741
    at = F.array_position(F.zip_with("a", "b", lambda x, y: x != y), F.lit(True))
    return l.select("o_custkey", (F.col("a") == F.col("b")).alias("same"), F.nullif(at, F.lit(0).cast("long")).alias("first_difference"))


@query("e16_score_rollup", """
SELECT o_custkey, round(sum(least(pow(o_orderkey % 7 / 5, 2), 1.15) * (1 + o_orderkey % 3)) / sum(1 + o_orderkey % 3), 6) AS score FROM orders GROUP BY 1
""")
def e16(t):
    w = 1 + F.col("o_orderkey") % 3
    v = F.least(F.pow((F.col("o_orderkey") % 7) / 5, F.lit(2.0)), F.lit(1.15))
    return t("orders").groupBy("o_custkey").agg(F.round(F.sum(v * w) / F.sum(w), 6).alias("score"))


@query("e17_threshold_counts", f"""
{STANDING} SELECT count(CASE WHEN better = 0 THEN 1 END) AS zero, count(CASE WHEN better < 3 THEN 1 END) AS under3, count(CASE WHEN better < 5 THEN 1 END) AS under5, count(CASE WHEN better < 25 THEN 1 END) AS under25 FROM d
""")
def e17(t):
    b = F.col("better")
    return standing(t).agg(F.count_if(b == 0).alias("zero"), F.count_if(b < 3).alias("under3"), F.count_if(b < 5).alias("under5"), F.count_if(b < 25).alias("under25"))


@query("e18_density", """
WITH n AS (SELECT unnest([50, 100, 200]) AS width, unnest([
    count(*) OVER (ORDER BY o_totalprice RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING), count(*) OVER (ORDER BY o_totalprice RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING),
    count(*) OVER (ORDER BY o_totalprice RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING)]) AS n FROM orders)
SELECT width, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS most FROM n GROUP BY width
""")
def e18(t):
    """How many rows lie within each of three widths of a row, over every row."""
    widths = {f"n{w}": float(w) for w in (50, 100, 200)}
    counts = J.window_counts(t("orders").select("o_totalprice"), "o_totalprice", t("orders"), "o_totalprice", widths)
    each = F.explode(F.array(*[F.struct(F.lit(int(w)).alias("width"), F.col(name).alias("n")) for name, w in widths.items()])).alias("r")
    # few distinct counts, each with its rows
    sizes = counts.select(each).groupBy("r.width", "r.n").agg(F.count("*").alias("rows"))
    return sizes.groupBy("width").agg(F.round(F.sum(F.col("n") * F.col("rows")) / F.sum("rows"), 6).alias("mean"), F.percentile("n", F.lit(0.5), F.col("rows")).alias("median"), F.max("n").alias("most"))


@query("e19_group_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 5) AS r FROM lineitem GROUP BY 1")
def e19(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 5).alias("r"))


@query("e20_score_agreement", """
WITH a AS (SELECT o_custkey, max(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT count(*) AS n, round(avg(abs(a.s - b.s)), 4) AS mean_gap, round(max(abs(a.s - b.s)), 4) AS max_gap, round(corr(a.s, b.s), 5) AS r FROM a JOIN b USING (o_custkey)
""")
def e20(t):
    part = lambda k, c: t("orders").where(f"o_orderstatus = '{k}'").groupBy("o_custkey").agg(F.max("o_totalprice").alias(c))
    gap = F.abs(F.col("a") - F.col("b"))
    return part("O", "a").join(part("F", "b"), "o_custkey").agg(F.count("*").alias("n"), F.round(F.avg(gap), 4).alias("mean_gap"), F.round(F.max(gap), 4).alias("max_gap"), F.round(F.corr("a", "b"), 5).alias("r"))
