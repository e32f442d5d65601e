"""Steps whose work must not grow faster than their input."""

from pyspark.sql import functions as F

from quern.functions import peaks as P


def test_whole_values_of_cosines_are_worked_out_once_a_row(spark):
    column = str(P.modified_cosines(F.col("a"), F.col("b"), F.col("whole_a"), F.col("whole_b"), 0.004, 0.05))
    assert column.count("whole_a") == 2 and column.count("whole_b") == 2  # themselves and their difference


def test_peak_pairs_are_dealt_over_all_tasks(spark):
    from quern.plans import similarity

    rows = spark.createDataFrame([(i, 0, [0.5, 0.25]) for i in range(64)], "vec_id long, label int, embedding array<float>")
    made = similarity._peak_pairs(lambda _: rows)
    parts = made.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and sum(r["count"] for r in parts) == 63


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_products_are_not_shuffled(spark):
    from quern.operators import generate

    units = "array<struct<unit:string,n:bigint>>"
    rows = spark.createDataFrame([(q, [("C", 1 + q % 3)], 0.5, 1) for q in range(20)], f"q long, u {units}, s double, r int")
    ops = spark.createDataFrame([(1, [("C", 1)]), (2, [("C", -1)]), (3, [("C", 1), ("H", 0)])], f"op long, c {units}")
    made = generate.generated_products(rows, ops, "q", "u", "s", "r", "op", "c")
    assert "hashpartitioning(q" in plan(made) and "hashpartitioning(q#" in plan(made) and "product#" not in "".join(x for x in plan(made).splitlines() if "Exchange hashpartitioning" in x)
    assert {(r.q, r.product): (r.n_ops, r.support) for r in made.where("q < 2").collect()} == {(0, "C2"): (2, 2), (0, ""): (1, 1), (1, "C3"): (2, 2), (1, "C"): (1, 1)}


def test_best_postings_need_no_second_shuffle_and_ask_one_bin(spark):
    from quern.operators import joins

    rows = spark.createDataFrame([(k, f"e{k % 3}", 0, k * 0.4) for k in range(30)], "k long, e string, d long, y double")
    made = joins.best_postings(rows, "k", "e", "d", "y", 1.0)
    assert not [x for x in plan(made).splitlines() if "Exchange hashpartitioning(_key" in x]
    assert made.count() == made.select("k", "e", "d").distinct().count()


def test_pieces_of_many_graphs_are_put_out_together(spark):
    from quern.operators import graphs

    nodes = spark.createDataFrame([(g, n, 1) for g in range(40) for n in range(3)], "g long, n long, w long").coalesce(1)
    edges = spark.createDataFrame([(g, 0, 1) for g in range(40)], "g long, a long, b long").coalesce(1)
    made = graphs.fragments(nodes, edges, "g", "n", "w", "a", "b")
    assert "MapInArrow" in plan(made) and "MapInPandas" not in plan(made)
    assert {(r.g, r.weight): r.ways for r in made.collect()} == {(g, w): n for g in range(40) for w, n in ((1, 3), (2, 1))}


def test_cut_pieces_are_counted_in_parts(monkeypatch):
    from quern.operators import graphs

    ring = [(k, (k + 1) % 9) for k in range(9)]
    whole = graphs.cut_pieces(list(range(1, 10)), ring)
    monkeypatch.setattr(graphs, "PIECES", 4)
    assert graphs.cut_pieces(list(range(1, 10)), ring) == whole and sum(whole.values()) == 1 + 9 * 8


def test_sums_of_marks_are_longs(spark):
    from quern.operators import graphs

    nodes = spark.createDataFrame([(1, n, "x") for n in range(3)], "g long, n long, l string")
    edges = spark.createDataFrame([(1, 0, 1, "-"), (1, 0, 2, "-")], "g long, a long, b long, e string")
    seen = graphs.neighbourhood_hashes(nodes, edges, "g", "n", "l", "a", "b", "e", 1)
    assert seen.where("radius = 1").select("hash").distinct().count() == 2


def test_graphs_of_orders_join_their_lines_once(spark):
    from quern.plans import similarity

    edges = similarity.order_graphs(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))[1]
    assert not [f for f in edges.inputFiles() if "lineitem" in f]


def test_tasks_of_windows_grow_in_number_with_the_rows(spark):
    from quern import storage

    few, many = (storage.by_rows(spark.range(200), "id", rows=n) for n in (100, 10))
    assert "Exchange" not in plan(few) and many.rdd.getNumPartitions() == 20 and many.count() == 200


def test_feature_vectors_and_ranking_rows_are_dealt_by_rows(spark, monkeypatch):
    from quern import storage
    from quern.plans import aggregates, ranking

    monkeypatch.setitem(storage.by_rows.__kwdefaults__, "rows", 1000)
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    assert "REPARTITION_BY_NUM" in plan(aggregates.ranking_rows(t)) and "REPARTITION_BY_NUM" in plan(ranking.w6_vector(t))


def test_best_in_band_sums_up_no_pairs_and_takes_little_room(spark, tmp_path):
    from quern.plans import reference

    spark.range(2000).selectExpr("id AS p_partkey", "CAST(950 AS DOUBLE) AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1000).selectExpr("id AS o_orderkey", "id * 7919 AS o_custkey", "95000 + id / 10 AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(9).selectExpr("id AS c_custkey", "9500 + CAST(id AS DOUBLE) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    made = reference.QUERIES["j6_two_source_band"](spark, str(tmp_path))
    assert "Aggregate" not in plan(made) and "Generate" in plan(made)
    made.write.parquet(f"{tmp_path}/made")
    files = list((tmp_path / "made").glob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/made").distinct().count() == 2000 * 1008
    assert sum(f.stat().st_size for f in files) < 2000 * 1008 / 2


def test_next_values_run_over_tasks(spark):
    from quern.operators import joins

    rows = spark.createDataFrame([(k, float(v)) for k in (1, 2, None) for v in (5, 1, 3, 3)], "k long, v double").repartition(4)
    for following, want in ((True, {1.0: 3.0, 3.0: 5.0, 5.0: None}), (False, {1.0: None, 3.0: 1.0, 5.0: 3.0})):
        got = {(r.k, r.v): r.n for r in joins.previous_values(rows, "k", "v", "n", following).collect()}
        assert got == {(k, v): n for k in (1, 2, None) for v, n in want.items()}
