"""Rows at the very edge of a tolerance or a threshold, where the order of roundings decides."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import joins, rank, sampling
from quern.plans import reference


def both(spark, path, name, **tables):
    """The query's rows and its SQL's, of the tables given as SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    got = reference.QUERIES[name](spark, str(path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({reference.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_shares_are_normalized_again_whatever_their_entropy(spark, tmp_path):
    got, want = both(spark, tmp_path, "f2_entropy_similarity", benchmark="SELECT * FROM '/root/testdata/sf0.1/benchmark.parquet' WHERE item_id IN (64, 106, 120)")
    assert got == want and {(64, 120), (106, 120)}.isdisjoint(r[:2] for r in got)


def test_compositions_at_the_tolerance(spark, tmp_path):
    # balances whose hundredth has a 5 behind its cents, or that units miss by 0.02
    balances = "SELECT CAST(range AS BIGINT) AS c_custkey, CAST(range / 100 AS DOUBLE) AS c_acctbal FROM range(50, 360000, 100)"
    got, want = both(spark, tmp_path, "g3_compositions", customer=balances)
    assert len(got) > 300 and got == want


def test_chains_at_the_tolerance(spark, tmp_path):
    rows = "SELECT CAST(range AS BIGINT) AS s_suppkey, CAST(range / 100 AS DOUBLE) AS s_acctbal FROM range(-50000, 50000)"
    got, want = both(spark, tmp_path, "g6_operation_chains", supplier=rows, nation="SELECT * FROM '/root/testdata/sf0.001/nation.parquet'")
    assert len(got) > 1000 and got == want


def test_band_counts_equal_the_pairs(spark):
    rnd = random.Random(3)
    left = [(i, rnd.choice([None, 0.0, -5.0, float("nan"), rnd.uniform(1, 400), 77.0])) for i in range(80)]
    right = [(rnd.choice([None, *range(40)]), rnd.choice([None, 0.0, -4.0, rnd.uniform(1, 400), 77.0, 77.77])) for _ in range(400)]
    left, right = spark.createDataFrame(left, "a long, x double"), spark.createDataFrame(right, "b long, y double")
    for first, passes in ((0.01, 3), (0.2, 4)):
        pairs = joins.adaptive_band_join(left, right, "a", "b", "x", "y", first, 6, passes=passes)
        want = pairs.groupBy("a", "x", "pass", "tight_count").agg(F.countDistinct("b").alias("n_keys"), F.count("*").alias("n_pairs"))
        got = joins.adaptive_band_counts(left, right, "b", "x", "y", first, 6, passes=passes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def band_rows(n):
    """Tables of n parts of one price and n orders and customers around it: every part meets every order."""
    return {
        "part": f"SELECT range AS p_partkey, CAST(950 AS DOUBLE) AS p_retailprice FROM range({n})",
        "orders": f"SELECT range AS o_orderkey, range % 50 AS o_custkey, 95000 + CAST(range % 90 AS DOUBLE) AS o_totalprice FROM range({n})",
        "customer": f"SELECT range AS c_custkey, 4750 + CAST(range % 9 AS DOUBLE) AS c_acctbal FROM range({n})",
        "lineitem": "SELECT CAST(1 AS BIGINT) AS l_partkey, CAST(50 AS DOUBLE) AS l_quantity",
    }


@pytest.mark.parametrize("name", ["e10_source_ceiling", "j2_adaptive_band", "j3_adaptive_band_unmatched", "j6_two_source_band"])
def test_parts_of_one_price_are_not_paired_one_by_one(spark, tmp_path, monkeypatch, name):
    got, want = both(spark, tmp_path, name, **band_rows(300))
    assert got == want
    met = []
    joined = joins.relative_band_join
    monkeypatch.setattr(joins, "relative_band_join", lambda *a, **k: met.append(joined(*a, **k)) or met[-1])
    reference.QUERIES[name](spark, str(tmp_path)).count()
    assert sum(df.count() for df in met) <= 600


def test_marks_of_arrays_are_those_of_md5():
    rnd = random.Random(5)
    for size in (0, 1, 3, 4, 17, 54, 55, 56, 80):
        texts = np.frombuffer(rnd.randbytes(20 * size), np.uint8).reshape(20, size)
        assert sampling.md5_marks(texts).tolist() == [int(hashlib.md5(t.tobytes()).hexdigest()[:13], 16) for t in texts]


def test_bootstrap_is_dealt_and_hashes_arrays(spark):
    """The same draws by plain code, a null key and a null value among them; no row of a round ever stands alone in a plan."""
    rows = [(i if i % 11 else None, None if i % 7 == 3 else float(i % 5)) for i in range(0, 3000, 41)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = sampling.bootstrap_mean(df, "k", "v", 120, seed=3)
    means = []
    for r in range(1, 121):
        u = [(int(hashlib.md5("|".join([*([] if k is None else [str(k)]), str(r), "3"]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for k, _ in rows]
        w = [sum(x > p for p in sampling.POISSON) for x in u]
        means.append(sum(a * v for a, (_, v) in zip(w, rows, strict=True) if v is not None) / sum(w))
    r = got.first()
    assert np.allclose([r.low, r.high], np.quantile(means, [0.025, 0.975]), rtol=1e-12)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_capped_ranks_without_a_window_over_rows(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, "a", "b", "c"]), rnd.choice([None, float("nan"), 0.0, -0.0, *map(float, range(9 if i % 2 else 400))]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, i long")
    for cap in (0, 3, 50):
        want = df.select("i", rank.capped_rank(F.col("x"), ["g"], cap).alias("r"))
        got = rank.with_capped_rank(df, ["g"], "x", "r", cap).select("i", "r")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    plan = reference.QUERIES["w3_capped_rank"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    tree = plan[plan.index("Window") :]
    assert "Aggregate" in tree


def test_best_in_band_groups_part_keys_as_sql(spark, tmp_path):
    """Part keys that come again, at one price or several, null keys, and prices whose window is one value."""
    got, want = both(
        spark,
        tmp_path,
        "j6_two_source_band",
        part="SELECT CASE WHEN range % 9 > 0 THEN range % 30 END AS p_partkey, [0, NULL, '-inf'::DOUBLE, -5, 900, 901, 901.5][1 + range % 7] AS p_retailprice FROM range(90)",
        orders="SELECT range AS o_orderkey, CASE WHEN range % 20 > 0 THEN range % 20 END AS o_custkey, [0, NULL, '-inf'::DOUBLE, -500, 89999.00004, 90100, 90250, 90300][1 + range % 8] AS o_totalprice FROM range(400)",
        customer="SELECT range AS c_custkey, [0, NULL, '-inf'::DOUBLE, -50, 9010.5][1 + range % 5] AS c_acctbal FROM range(40)",
    )
    assert got == want and len({r[0] for r in got}) > 20 and len(got) == len({r[:2] for r in got})


def test_best_in_band_is_cut_into_cells(spark, monkeypatch):
    rnd = random.Random(8)
    left = [(i, rnd.choice([10.0, 10.0, 10.01, rnd.uniform(9, 11)])) for i in range(300)]
    right = [(rnd.randrange(40), rnd.uniform(9, 11)) for _ in range(300)]
    a, b = spark.createDataFrame(left, "a long, x double"), spark.createDataFrame(right, "b long, y double")
    want = joins.relative_band_join(a, b, "x", "y", 0.02).groupBy("a", "b").agg(F.max("y").alias("best"))
    for name, n in (("CELL_KEYS", 16), ("CELL_ROWS", 16), ("RUN_KEYS", 8), ("BLOCK_KEYS", 20), ("LEAST_PAIRS", 100)):
        monkeypatch.setattr(joins, name, n)
    got = joins.band_best(a, b, "a", "x", "b", "y", 0.02, "best")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
