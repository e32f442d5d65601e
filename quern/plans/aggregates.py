"""Aggregations, distinct rows, samples, and the grid and model operators' roll-ups."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import aggregate as A
from quern.operators import boosting, grid, learn, sampling
from quern.plans.registry import mark_sql, query, uniform_sql
from quern.storage import by_rows
from quern.streaming.windows import windowed

WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def words():
    return F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))


@query("a1_max_per_key", "SELECT o_custkey, o_orderpriority, max(o_totalprice) AS best FROM orders GROUP BY 1, 2")
def a1(t):
    return t("orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("best"))


@query("a2_argmax_payload", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1
""")
def a2(t):
    return A.first_by(t("orders"), ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("a3_representative", """
SELECT l_orderkey, l_quantity, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1
""")
def a3(t):
    order = [-F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")]
    return A.first_by(t("lineitem"), ["l_orderkey"], order, ["l_quantity", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("a4_first_seen_backfill", """
SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type <> 'view') AS first_type, min(event_id) AS first_id FROM events GROUP BY 1
""")
def a4(t):
    """The first value that is not empty, in the order of event_id."""
    value = F.when(F.col("event_type") != "view", F.col("event_type"))
    return t("events").groupBy("user_id").agg(F.min_by(value, F.when(value.isNotNull(), F.col("event_id"))).alias("first_type"), F.min("event_id").alias("first_id"))


@query("a5_count_per_key", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def a5(t):
    return t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("a6_popularity", """
WITH a AS (SELECT l_partkey, count(*) AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_partkey, count(*) AS c FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
p AS (SELECT p_partkey, ln(1 + coalesce(a.c, 0)) + ln(1 + coalesce(r.c, 0)) AS pop FROM part LEFT JOIN a ON p_partkey = a.l_partkey LEFT JOIN r ON p_partkey = r.l_partkey)
SELECT count(*) AS n, round(avg(pop), 6) AS mean_pop, count(CASE WHEN pop > 0 THEN 1 END) AS n_seen FROM p
""")
def a6(t):
    counts = t("lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    pop = F.log1p(F.coalesce("a", F.lit(0))) + F.log1p(F.coalesce("r", F.lit(0)))
    df = t("part").join(counts, F.col("p_partkey") == F.col("l_partkey"), "left").withColumn("pop", pop)
    return df.agg(F.count("*").alias("n"), F.round(F.avg("pop"), 6).alias("mean_pop"), F.count_if(F.col("pop") > 0).alias("n_seen"))


@query("a7_conditional_having", "SELECT user_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS n FROM events GROUP BY 1 HAVING count(CASE WHEN event_type = 'click' THEN 1 END) >= 2")
def a7(t):
    return t("events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n")).where("n >= 2")


@query("a8_profile", """
WITH p AS (SELECT user_id, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS s FROM events GROUP BY 1, 2)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n_rows, CAST((100 * sum(s)) // sum(n) AS BIGINT) AS mean_hundredths_of_cents, string_agg(event_type || ':' || n, ';' ORDER BY event_type) AS categories FROM p GROUP BY 1
""")
def a8(t):
    """The mean in whole hundredths of cents, from an exact sum of cents."""
    events = t("events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    profile = A.profile(events, "user_id", "event_type", "cents", exact=True)
    return profile.select("user_id", "n_rows", F.expr("100 * total div n_rows").alias("mean_hundredths_of_cents"), "categories")


@query("a9_clamped_histogram", "SELECT CAST(least(n, 10) AS BIGINT) AS bucket, count(*) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def a9(t):
    return A.clamped_histogram(t("orders").groupBy("o_custkey").agg(F.count("*").alias("m")), "m", 10)


@query("a10_spread", """
WITH s AS (SELECT l_partkey, (max(l_extendedprice) - min(l_extendedprice)) / avg(l_extendedprice) * 1e6 AS d FROM lineitem GROUP BY 1)
SELECT round(quantile_cont(d, 0.5), 2) AS p50, round(quantile_cont(d, 0.9), 2) AS p90, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM s
""")
def a10(t):
    d = (F.max("l_extendedprice") - F.min("l_extendedprice")) / F.avg("l_extendedprice") * 1e6
    spread = t("lineitem").groupBy("l_partkey").agg(d.alias("d"))
    q = A.exact_quantiles(spread, [], "d", {"p50": 0.5, "p90": 0.9}).select(F.round("p50", 2).alias("p50"), F.round("p90", 2).alias("p90"))
    return q.crossJoin(spread.agg(F.round(F.avg((F.col("d") == 0).cast("double")), 6).alias("zero_share")))  # one row each


@query("a11_group_quantiles", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(abs(l_extendedprice - 50000), 0.5), 4) AS q50, round(quantile_cont(abs(l_extendedprice - 50000), 0.9), 4) AS q90, round(quantile_cont(abs(l_extendedprice - 50000), 0.99), 4) AS q99 FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 10
""")
def a11(t):
    off = F.abs(F.col("l_extendedprice") - 50000)
    rows = t("lineitem").select("l_returnflag", "l_linestatus", off.alias("off"))
    q = A.exact_quantiles(rows, ["l_returnflag", "l_linestatus"], "off", {"q50": 0.5, "q90": 0.9, "q99": 0.99}).where("n >= 10")
    return q.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 4).alias(c) for c in ("q50", "q90", "q99")])


@query("a12_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def a12(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n_parts"))


@query("a13_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def a13(t):
    return t("lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


@query("a14_group_key_flags", "SELECT l_orderkey, l_suppkey % 7 AS k, max(l_quantity) AS pop, bool_or(l_returnflag = 'R') AS is_truth FROM lineitem GROUP BY 1, 2")
def a14(t):
    return t("lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 7).alias("k")).agg(F.max("l_quantity").alias("pop"), F.bool_or(F.col("l_returnflag") == "R").alias("is_truth"))


@query("a15_surrogate_ids", "SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS uid FROM (SELECT DISTINCT p_brand FROM part)")
def a15(t):
    return A.surrogate_ids(t("part"), "p_brand")


@query("a16_document_frequency", f"""
WITH w AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS item FROM documents)
SELECT item, count(*) AS df FROM w GROUP BY 1 HAVING count(*) >= 5 ORDER BY df DESC, item LIMIT 50
""")
def a16(t):
    return A.document_frequency(t("documents"), "doc_id", words(), 5, 50)


@query("a17_feature_entropy", """
WITH n AS (SELECT o_orderpriority AS g, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT o_orderpriority AS g, o_custkey % 11 AS feature, count(*) AS c FROM orders GROUP BY 1, 2),
h AS (SELECT feature, c / n AS p FROM c JOIN n USING (g))
SELECT feature, round(sum(CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0 END) / (SELECT count(*) FROM n), 6) AS entropy FROM h GROUP BY 1
""")
def a17(t):
    rows = t("orders").select("o_orderpriority", "o_orderkey", (F.col("o_custkey") % 11).alias("feature"))
    return A.mean_feature_entropy(rows, "o_orderpriority", "o_orderkey", "feature").withColumn("entropy", F.round("entropy", 6))


@query("a18_stride_sample", "SELECT vec_id, list_transform(range(8), lambda k: round(CAST(embedding[CAST(floor(k * len(embedding) / 8) AS BIGINT) + 1] AS DOUBLE), 6)) AS picked FROM embeddings")
def a18(t):
    return t("embeddings").select("vec_id", F.transform(V.stride_sample(F.col("embedding"), 8), lambda x: F.round(x.cast("double"), 6)).alias("picked"))


@query("a19_hash_sample", f"SELECT o_orderkey, o_custkey FROM orders WHERE {mark_sql('o_orderkey', 7)} % 10 < 3")
def a19(t):
    return sampling.hash_share(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 10, 3, seed=7)


@query("a20_draw", f"SELECT c_custkey, c_mktsegment FROM customer ORDER BY {mark_sql('c_custkey', 11)}, c_custkey LIMIT 100")
def a20(t):
    return sampling.draw(t("customer").select("c_custkey", "c_mktsegment"), "c_custkey", 100, seed=11)


@query("a21_matched_sample", f"""
WITH a AS (SELECT c_mktsegment, count(*) AS a FROM customer GROUP BY 1), b AS (SELECT c_mktsegment, count(*) AS b FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
SELECT c_custkey, c_mktsegment FROM customer JOIN a USING (c_mktsegment) JOIN b USING (c_mktsegment) ORDER BY ln({uniform_sql('c_custkey', 5)}) / (b / a) DESC, c_custkey LIMIT 120
""")
def a21(t):
    source = t("customer").select("c_custkey", "c_mktsegment")
    target = t("customer").where("c_acctbal > 5000").select("c_mktsegment")
    return sampling.matched_sample(source, target, "c_mktsegment", "c_custkey", 120, seed=5)


@query("a22_log_prior", """
WITH g AS (SELECT source, sum(toxic) AS h, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), w AS (SELECT (sum(h) + 1) / (sum(n) + 1) AS p0 FROM g)
SELECT source, round(ln((h + 5 * p0) / (n + 5)), 6) AS log_prior FROM g, w
""")
def a22(t):
    rows = t("documents").select("doc_id", "source").join(t("labels"), "doc_id")
    return A.smoothed_log_prior(rows, "source", "toxic", 5.0).withColumn("log_prior", F.round("log_prior", 6))


@query("a23_fold", """
SELECT l_partkey, max(l_discount) AS best, min(l_linenumber) AS least_rank, count(DISTINCT l_suppkey) AS support, list_sort(list(DISTINCT l_returnflag)) AS ops FROM lineitem GROUP BY 1
""")
def a23(t):
    return t("lineitem").groupBy("l_partkey").agg(F.max("l_discount").alias("best"), F.min("l_linenumber").alias("least_rank"), F.countDistinct("l_suppkey").alias("support"), F.array_sort(F.collect_set("l_returnflag")).alias("ops"))


@query("a24_duplicate_count", "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def a24(t):
    return t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") - 1).alias("n_duplicates"))


@query("a25_stage_counters", """
SELECT count(*) AS n_read, count(CASE WHEN n_chars < 200 THEN 1 END) AS n_short, count(CASE WHEN n_chars >= 200 AND lang <> 'en' THEN 1 END) AS n_other, count(CASE WHEN n_chars >= 200 AND lang = 'en' THEN 1 END) AS n_kept FROM documents
""")
def a25(t):
    long = F.col("n_chars") >= 200
    return t("documents").agg(F.count("*").alias("n_read"), F.count_if(~long).alias("n_short"), F.count_if(long & (F.col("lang") != "en")).alias("n_other"), F.count_if(long & (F.col("lang") == "en")).alias("n_kept"))


@query("a26_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a26(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("x2_frame_diff", """
WITH f AS (SELECT user_id, event_id % 2 AS k, arg_min(value, event_id) AS y, arg_min(hour(ts), event_id) AS x FROM events GROUP BY 1, 2), a AS (SELECT * FROM f WHERE k = 0), b AS (SELECT * FROM f WHERE k = 1)
SELECT user_id, CASE WHEN b.y IS NULL THEN 'vanished' WHEN a.y IS NULL THEN 'appeared' ELSE 'moved' END AS event, round(b.y - a.y, 6) AS dy, CAST(b.x - a.x AS INTEGER) AS dx
FROM a FULL JOIN b USING (user_id) WHERE a.y IS NULL OR b.y IS NULL OR a.y <> b.y OR a.x <> b.x
""")
def x2(t):
    place = (F.min_by("value", "event_id").alias("y"), F.min_by(F.hour("ts"), "event_id").alias("x"))
    frame = lambda k: t("events").where(f"event_id % 2 = {k}").groupBy("user_id").agg(*place)
    return grid.frame_diff(frame(0), frame(1), "user_id", "y", "x").select("user_id", "event", F.round("dy", 6).alias("dy"), "dx")


@query("x1_grid_components", """
WITH RECURSIVE c AS (SELECT vec_id AS frame, (generate_subscripts(embedding, 1) - 1) // 8 AS y, (generate_subscripts(embedding, 1) - 1) % 8 AS x, unnest(embedding) > 0 AS colour FROM embeddings),
r AS (SELECT frame, y, x, colour, y * 8 + x AS label FROM c UNION SELECT c.frame, c.y, c.x, c.colour, r.label FROM r JOIN c ON c.frame = r.frame AND c.colour = r.colour AND abs(c.y - r.y) + abs(c.x - r.x) = 1)
SELECT frame, label, count(*) AS area FROM (SELECT frame, y, x, min(label) AS label FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def x1(t):
    """Connected components of the vectors' sign patterns, seen as 8 x 8 boards."""
    cells = t("embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "v"))
    cells = cells.select("frame", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), (F.col("v") > 0).alias("colour"))
    got = grid.grid_components(cells, "frame", "y", "x", "colour")
    return got.groupBy("frame", (F.col("label.y") * 8 + F.col("label.x")).alias("label")).agg(F.count("*").alias("area"))


@query("x1_grid_objects", """
WITH RECURSIVE c AS (SELECT vec_id AS frame, (generate_subscripts(embedding, 1) - 1) // 8 AS y, (generate_subscripts(embedding, 1) - 1) % 8 AS x, CAST(floor(4 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS colour FROM embeddings),
r AS (SELECT frame, y, x, colour, y * 8 + x AS label FROM c UNION SELECT c.frame, c.y, c.x, c.colour, r.label FROM r JOIN c ON c.frame = r.frame AND c.colour = r.colour AND abs(c.y - r.y) + abs(c.x - r.x) = 1),
k AS (SELECT frame, y, x, colour, min(label) AS label FROM r GROUP BY 1, 2, 3, 4), s AS (SELECT frame, colour FROM c GROUP BY 1, 2 HAVING count(*) <= 8),
o AS (SELECT frame, label, colour, count(*) AS area, (min(y) + max(y)) // 2 AS y, (min(x) + max(x)) // 2 AS x FROM k JOIN s USING (frame, colour) GROUP BY 1, 2, 3)
SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY area DESC, x DESC, y DESC, label) AS place, colour, area, y, x FROM o
""")
def x1_objects(t):
    """The boards' objects, largest first, at the middle of their extent; colours of over an eighth of a board are scenery."""
    cells = t("embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "v"))
    cells = cells.select("frame", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.floor(4 * F.col("v").cast("double")).alias("colour"))
    return grid.grid_objects(grid.grid_components(cells, "frame", "y", "x", "colour"), "frame", "y", "x", "colour")


@query("x3_clock_cells", """
WITH a AS (SELECT o_custkey, year(o_orderdate) AS y, min(o_orderstatus) = max(o_orderstatus) AS same, min(o_orderstatus) AS v FROM orders GROUP BY 1, 2)
SELECT o_custkey FROM a GROUP BY 1 HAVING bool_and(same) AND min(v) <> max(v)
""")
def x3(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"), "o_orderstatus")
    return grid.clock_cells(rows, ["o_custkey"], "o_orderkey", "y", "o_orderstatus")


@query("x4_shortest_per_state", "SELECT lang, source, min(n_chars) AS n_chars, arg_min(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY 1, 2")
def x4(t):
    return grid.shortest_per_state(t("documents"), ["lang", "source"], "n_chars", "doc_id")


@query("x5_shape_pairs", """
SELECT a.p_partkey AS piece, min(b.p_partkey) AS region FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand <> b.p_brand WHERE a.p_size >= 2 GROUP BY 1 ORDER BY 1 LIMIT 12
""")
def x5(t):
    pieces = t("part").select(F.col("p_partkey").alias("piece"), "p_type", F.col("p_size").alias("area"), F.col("p_brand").alias("place"))
    regions = t("part").select(F.col("p_partkey").alias("region"), "p_type", F.col("p_brand").alias("place"))
    return grid.shape_pairs(pieces, regions, "p_type", "piece", "region", "area", "place")


@query("x6_completion_share", "SELECT l_returnflag, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1")
def x6(t):
    n = t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("x8_prefix_difference", """
WITH r AS (SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS v FROM orders)
SELECT o_orderkey, round(v - coalesce(lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0), 4) AS step FROM r
""")
def x8(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    rows = t("orders").withColumn("v", F.max("o_totalprice").over(w))
    return grid.prefix_difference(rows, ["o_custkey"], ["o_orderkey"], "v").select("o_orderkey", F.round("step", 4).alias("step"))


@query("x9_cost_model", "SELECT l_returnflag, round(sum(l_quantity * l_extendedprice * (1 + l_tax)) / 1e6, 4) AS cost FROM lineitem GROUP BY 1")
def x9(t):
    cost = F.col("l_quantity") * F.col("l_extendedprice") * (1 + F.col("l_tax"))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.sum(cost) / 1e6, 4).alias("cost"))


@query("l2_interleaved_folds", "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) % 5 AS fold FROM customer")
def l2(t):
    return learn.interleaved_fold(t("customer"), "c_custkey", 5)


@query("l5_hash_folds", f"SELECT c_custkey, {mark_sql('c_custkey', 0)} % 5 AS fold FROM customer")
def l5(t):
    return t("customer").select("c_custkey", learn.hash_fold(F.col("c_custkey"), 5).alias("fold"))


def _moments(t, half=None):
    """Sums for the searches below, of both halves of the lines, or by another split: mean squared errors of l_tax by a * l_discount and of l_quantity / 50 by b."""
    x, y, z = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50
    half = (F.col("l_orderkey") % 2 if half is None else half).alias("half")
    return t("lineitem").groupBy(half).agg(F.avg(x * x).alias("xx"), F.avg(x * y).alias("xy"), F.avg(y * y).alias("yy"), F.avg(z).alias("z"), F.avg(z * z).alias("zz")).orderBy("half").collect()


@query("l6_coordinate_descent", """
WITH RECURSIVE h AS (SELECT l_orderkey % 2 AS half, avg(l_discount * l_discount) AS xx, avg(l_discount * l_tax) AS xy, avg(l_tax * l_tax) AS yy, avg(l_quantity / 50) AS z, avg(l_quantity / 50 * l_quantity / 50) AS zz FROM lineitem GROUP BY 1),
g AS (SELECT a.range / 10 AS a, b.range / 10 AS b, max(CASE WHEN half = 0 THEN yy - 2 * a.range / 10 * xy + pow(a.range / 10, 2) * xx + zz - 2 * b.range / 10 * z + pow(b.range / 10, 2) END) AS e0,
  max(CASE WHEN half = 1 THEN yy - 2 * a.range / 10 * xy + pow(a.range / 10, 2) * xx + zz - 2 * b.range / 10 * z + pow(b.range / 10, 2) END) AS e1 FROM range(0, 11) a, range(0, 11) b, h GROUP BY 1, 2),
s AS (SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b UNION ALL
  SELECT step + 1, CASE WHEN t.e0 < o.e0 AND t.e1 < o.e1 THEN t.a ELSE s.a END, CASE WHEN t.e0 < o.e0 AND t.e1 < o.e1 THEN t.b ELSE s.b END FROM s
  JOIN g o ON abs(o.a - s.a) < 0.01 AND abs(o.b - s.b) < 0.01
  JOIN g t ON CASE WHEN step % 22 < 11 THEN abs(t.a - step % 11 / 10) < 0.01 AND abs(t.b - s.b) < 0.01 ELSE abs(t.b - step % 11 / 10) < 0.01 AND abs(t.a - s.a) < 0.01 END
  WHERE step < 66)
SELECT 'a' AS parameter, a AS best FROM s WHERE step = 66 UNION ALL SELECT 'b', b FROM s WHERE step = 66
""")
def l6(t):
    """Two parameters over grids, one at a time; a move counts only where both halves of the lines gain."""
    halves = _moments(t)
    loss = lambda m, p: m.yy - 2 * p["a"] * m.xy + p["a"] ** 2 * m.xx + m.zz - 2 * p["b"] * m.z + p["b"] ** 2
    grid = [k / 10 for k in range(11)]
    best = learn.coordinate_descent({"a": 0.0, "b": 0.0}, {"a": grid, "b": grid}, lambda p: tuple(-loss(m, p) for m in halves))
    return t("region").sparkSession.createDataFrame(sorted(best.items()), "parameter string, best double")


@query("l7_step_halving", """
WITH s AS (SELECT avg(l_discount * l_tax) / avg(l_discount * l_discount) AS a, avg(l_quantity / 50) AS b FROM lineitem)
SELECT 'a' AS parameter, round(a / 0.0625) * 0.0625 AS best FROM s UNION ALL SELECT 'b', round(b / 0.0625) * 0.0625 FROM s
""")
def l7(t):
    """The errors of all lines by steps of a half that are halved three times: the nearest sixteenth."""
    m = _moments(t, F.lit(0)).pop()
    score = lambda p: -(m.yy - 2 * p["a"] * m.xy + p["a"] ** 2 * m.xx + m.zz - 2 * p["b"] * m.z + p["b"] ** 2)
    best = learn.step_halving({"a": 0.0, "b": 0.0}, {"a": 0.5, "b": 0.5}, score)
    return t("region").sparkSession.createDataFrame(sorted(best.items()), "parameter string, best double")


@query("l8_mixture_weights", """
WITH g AS (SELECT a.range AS a, b.range AS b, 20 - a.range - b.range AS c FROM range(21) a, range(21) b WHERE a.range + b.range <= 20),
x AS (SELECT l_discount AS x, l_tax AS y, l_quantity / 500 AS z, 0.5 * l_discount + 0.3 * l_tax + 0.2 * l_quantity / 500 AS t FROM lineitem),
s AS (SELECT sum(x*x) xx, sum(y*y) yy, sum(z*z) zz, sum(t*t) tt, sum(x*y) xy, sum(x*z) xz, sum(y*z) yz, sum(x*t) xt, sum(y*t) yt, sum(z*t) zt FROM x),
e AS (SELECT a / 20 AS w_x, b / 20 AS w_y, c / 20 AS w_z, a*a/400*xx + b*b/400*yy + c*c/400*zz + tt + 2*(a*b/400*xy + a*c/400*xz + b*c/400*yz - a/20*xt - b/20*yt - c/20*zt) AS err FROM g, s)
SELECT w_x, w_y, w_z FROM e ORDER BY err LIMIT 1
""")
def l8(t):
    rows = t("lineitem").select(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") / 500).alias("z"))
    rows = rows.withColumn("t", 0.5 * F.col("x") + 0.3 * F.col("y") + 0.2 * F.col("z"))
    return learn.mixture_weights(rows, ["x", "y", "z"], "t", 20).select("w_x", "w_y", "w_z")


@query("l1_conditional_logit")
def l1(t):
    """Weights of a conditional logit over lineitem candidates of orders, 600 steps; the truth is the line of the largest quantity, orders weigh 1 to 3."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("q"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"))
    rows = rows.withColumn("truth", F.row_number().over(Window.partitionBy("q").orderBy(F.col("a").desc(), "b")) == 1)
    rows = rows.withColumn("w", 1 + F.col("q") % 3)
    fit = learn.conditional_logit(rows, "q", "truth", ["a", "b"], weight="w")
    return t("region").sparkSession.createDataFrame([(k, v) for k, v in fit.items()], "feature string, weight double")


TREES = """tree
0 25 1 2 0
-1 0 0 0 0.5
1 0.05 3 4 0
-1 0 0 0 -1
-1 0 0 0 2
tree
1 0.02 1 2 0
-1 0 0 0 0.25
-1 0 0 0 -0.125
"""


@query("l4_tree_scores", """
SELECT l_returnflag, round(sum(CASE WHEN l_quantity <= 25 THEN 0.5 WHEN l_discount <= 0.05 THEN -1 ELSE 2 END + CASE WHEN l_discount <= 0.02 THEN 0.25 ELSE -0.125 END), 4) AS total FROM lineitem GROUP BY 1
""".replace("0.05 THEN", "CAST(0.05 AS DOUBLE) THEN").replace("0.02 THEN", "CAST(0.02 AS DOUBLE) THEN").replace("sum(", "sum(CAST(").replace("-0.125 END)", "-0.125 END AS DOUBLE))"))
def l4(t):
    """Scores of a tree ensemble given as text."""
    scored = learn.tree_scores(t("lineitem").select("l_returnflag", "l_quantity", "l_discount"), ["l_quantity", "l_discount"], TREES)
    return scored.groupBy("l_returnflag").agg(F.round(F.sum("score"), 4).alias("total"))


NETWORK = [([[0.02, -0.04, 0.01], [10.0, 5.0, -20.0]], [0.1, 1.0, 0.25]), ([[1.5], [-0.5], [2.0]], [-0.25])]


@query("l9_network_scores", """
SELECT l_returnflag, round(sum(CAST(1.5 AS DOUBLE) * greatest(0, l_quantity * CAST(0.02 AS DOUBLE) + l_discount * 10 + CAST(0.1 AS DOUBLE)) - CAST(0.5 AS DOUBLE) * greatest(0, l_quantity * CAST(-0.04 AS DOUBLE) + l_discount * 5 + 1)
  + 2 * greatest(0, l_quantity * CAST(0.01 AS DOUBLE) - l_discount * 20 + CAST(0.25 AS DOUBLE)) - CAST(0.25 AS DOUBLE)), 3) AS total FROM lineitem GROUP BY 1
""")
def l9(t):
    """The forward pass of a saved network."""
    rows = t("lineitem").select("l_returnflag", "l_quantity", "l_discount")
    return learn.mlp_scores(rows, ["l_quantity", "l_discount"], NETWORK).groupBy("l_returnflag").agg(F.round(F.sum("score"), 3).alias("total"))


@query("l3_lambda_gradients", """
WITH r AS (SELECT l_orderkey AS q, l_partkey * 1000 + l_linenumber AS c, l_discount AS s, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber, l_extendedprice) = 1 AS truth, l_extendedprice FROM lineitem),
d AS (SELECT q, c, max(s) AS s, bool_or(truth) AS truth FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rk FROM d), g AS (SELECT *, CASE WHEN rk <= 25 THEN 1 / rk ELSE 0 END AS g FROM k),
o AS (SELECT q, s AS ts, g AS tg FROM g WHERE truth), p AS (SELECT g.q, c, truth, 1 / (1 + exp(ts - s)) * abs(tg - g) AS rho FROM g JOIN o USING (q))
SELECT q, c, round(CASE WHEN truth THEN sum(CASE WHEN truth THEN 0 ELSE rho END) OVER (PARTITION BY q) ELSE -rho END, 6) AS gradient FROM p
""")
def l3(t):
    first = Window.partitionBy("l_orderkey").orderBy(F.col("l_quantity").desc(), "l_partkey", "l_linenumber", "l_extendedprice")
    rows = t("lineitem").withColumn("truth", F.row_number().over(first) == 1)
    rows = rows.groupBy(F.col("l_orderkey").alias("q"), (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("c")).agg(F.max("l_discount").alias("s"), F.bool_or("truth").alias("truth"))
    return learn.lambda_gradients(rows, "q", "c", "s", "truth").withColumn("gradient", F.round("gradient", 6))


def ranking_rows(t):
    """Lines of orders as candidates: the truth is the line of the largest price less its discount; a fifth of the orders is held out."""
    first = Window.partitionBy("l_orderkey").orderBy((F.col("l_extendedprice") * (1 - F.col("l_discount"))).desc(), "l_partkey", "l_linenumber", "l_extendedprice")
    rows = by_rows(t("lineitem"), "l_orderkey").withColumn("truth", F.row_number().over(first) == 1)
    same = ["l_extendedprice", "l_discount", "l_tax"]
    rows = rows.groupBy(F.col("l_orderkey").alias("q"), (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("c")).agg(F.bool_or("truth").alias("truth"), *[F.max(c).alias(c) for c in same])
    return rows.withColumn("held", learn.hash_fold(F.col("q"), 5) == 0)


@query("l3_lambda_mart")
def l3_fit(t):
    """Held-out candidates' scores by trees fit on the other orders, beside the base score that the fit starts at."""
    rows = ranking_rows(t)
    model = boosting.lambda_mart(rows, "q", "c", "truth", ["l_extendedprice", "l_discount", "l_tax"], trees=8, rate=0.3, how=boosting.Growth(leaves=8, depth=4), bins=64, held_out="held", base=("l_discount", 1.0))
    return model.score(rows.where("held")).select("q", "c", "truth", F.col("l_discount").alias("base"), F.round("score", 6).alias("score"))


@query("l5_permuted_truth", f"""
WITH r AS (SELECT DISTINCT l_orderkey AS q, l_partkey * 1000 + l_linenumber AS c FROM lineitem), m AS (SELECT *, {mark_sql("q || '/' || c", 3)} AS m FROM r)
SELECT q, arg_min(c, m) AS c FROM m GROUP BY 1
""")
def l5_permuted(t):
    """The control of a ranker: of each order a candidate drawn by a hash in place of the truth."""
    return boosting.permuted_truth(ranking_rows(t), "q", "c", "truth", 3).where("truth").select("q", "c")


@query("l5_class_mix", """
WITH n AS (SELECT o_orderstatus AS s, count(*) AS n, sum(count(*)) OVER () AS all_n FROM orders GROUP BY 1), p AS (SELECT *, CASE s WHEN 'O' THEN 0.5 WHEN 'F' THEN 0.42 WHEN 'P' THEN 0.08 ELSE 0 END AS p FROM n)
SELECT o_orderkey, round(CAST(p AS DOUBLE) * all_n / n, 6) AS weight FROM orders JOIN p ON o_orderstatus = s
""")
def l5_mix(t):
    """Weights that bring groups of queries into given proportions."""
    weighted = boosting.class_mix_weights(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"O": 0.5, "F": 0.42, "P": 0.08})
    return weighted.select("o_orderkey", F.round("weight", 6).alias("weight"))


@query("ext_windowed_events", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows(t):
    """Extension beyond the operators above: tumbling windows, which run on streams as well."""
    return windowed(t("events"), "1 day").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))
