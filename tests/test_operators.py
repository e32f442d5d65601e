"""Properties and edge cases of the operators that SQL on the driver's tables does not reach."""

import itertools
import math
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import peaks as P
from quern.functions import vectors as V
from quern.operators import generate, grid, joins, learn, rank, sampling
from quern.operators import evaluate as E
from quern.sources import records as S


def test_intermediate_tables_can_be_discarded(spark):
    import os

    from quern import storage

    path = storage.shared_dir(spark)
    spark.range(5).write.parquet(f"{path}/table")
    assert os.path.isdir(path.removeprefix("file:")) and storage.discard(spark) >= 1 and not os.path.exists(path.removeprefix("file:")) and storage.discard(spark) == 0


def test_whole_tables_are_bounded(spark):
    assert len(S.to_pandas(spark.range(5), ["id"], 5)) == 5
    with pytest.raises(ValueError, match="rows"):
        S.to_pandas(spark.range(6), ["id"], 5)


def test_line_numbers_over_files_and_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        for k in range(3):
            (tmp_path / f"{k}.txt").write_text("".join(f"line {k} {i}\n" for i in range(20 * k + 5)))
        got = [r.value for r in S.read_lines(spark, str(tmp_path)).orderBy("number").collect()]
        numbers = sorted(r.number for r in S.read_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"line {k} {i}" for k in range(3) for i in range(20 * k + 5)] and numbers == list(range(75))


def test_band_join_equals_the_plain_condition(spark):
    rnd = random.Random(1)
    left = [(i, rnd.uniform(1, 1000)) for i in range(60)]
    right = [(i, rnd.uniform(1, 1000)) for i in range(300)] + [(1000 + i, left[i][1] * 1.01) for i in range(5)] + [(2000, -5.0)]
    got = joins.relative_band_join(spark.createDataFrame(left, "a long, x double"), spark.createDataFrame(right, "b long, y double"), "x", "y", 0.01)
    want = {(a, b) for a, x in left for b, y in right if x * (1 - 0.01) <= y <= x * (1 + 0.01)}
    assert {(r.a, r.b) for r in got.collect()} == want
    got = joins.absolute_band_join(spark.createDataFrame(left, "a long, x double"), spark.createDataFrame(right, "b long, y double"), "x", "y", 2.0)
    assert {(r.a, r.b) for r in got.collect()} == {(a, b) for a, x in left for b, y in right if x - 2.0 <= y <= x + 2.0}


def test_window_edges_are_inclusive_and_half_open(spark):
    left, right = spark.createDataFrame([(1, 10.0)], "a long, x double"), spark.createDataFrame([(1, 8.0), (2, 12.0)], "b long, y double")
    assert joins.absolute_band_join(left, right, "x", "y", 2.0).count() == 2
    assert [r.b for r in joins.absolute_band_join(left, right, "x", "y", 2.0, half_open=True).collect()] == [1]


def test_adaptive_band_stops_at_the_first_pass_with_enough(spark):
    left = spark.createDataFrame([("few", 100.0), ("many", 1000.0), ("none", 1e7)], "a string, x double")
    right = spark.createDataFrame([(i, 1000.0 + 0.01 * i) for i in range(5)] + [(10, 100.5), (11, 99.0)], "b long, y double")
    got = joins.adaptive_band_join(left, right, "a", "b", "x", "y", 0.001, 2, passes=4).collect()
    assert {(r.a, r["pass"], r.tight_count) for r in got} == {("many", 0, 5), ("few", 3, 0)}
    assert sum(r.a == "few" for r in got) == 2


def test_bag_anti_join_takes_one_row_for_one(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), (None, 4), (None, 5)], "k string, n long")
    right = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted(r.n for r in joins.bag_anti_join(left, right, ["k"], ["n"]).collect()) == [3, 5]


def test_optional_equality_with_nulls(spark):
    rows = spark.createDataFrame([(None, "x"), ("x", None), ("x", "x"), ("x", "y")], "a string, b string")
    assert [r.k for r in rows.select(joins.optional_equal(F.col("a"), F.col("b")).alias("k")).collect()] == [True, True, True, False]


@pytest.mark.parametrize("size", [3, 1 << 16])
def test_nearest_join(spark, monkeypatch, size):
    monkeypatch.setattr(joins, "RANGE_VALUES", size)
    rnd = random.Random(2)
    left, right = [(i, rnd.uniform(-50, 1050)) for i in range(80)] + [(90, None)], [rnd.uniform(0, 1000) for _ in range(40)] + [None, 5.0, 5.0]
    got = joins.nearest_join(spark.createDataFrame(left, "a long, x double"), spark.createDataFrame([(y,) for y in right], "y double"), "a", "x", "y").collect()
    assert len(got) == 81
    for r in got:
        want = r.x is not None and min(abs(r.x - y) for y in right if y is not None)
        assert r.distance is None if r.x is None else r.distance == want
    assert [r.distance for r in joins.nearest_join(spark.createDataFrame([(1, 2.0)], "a long, x double"), spark.createDataFrame([], "y double"), "a", "x", "y").collect()] == [None]


@pytest.mark.parametrize("size", [4, 1 << 16])
def test_band_top_k_equals_sorting_all_pairs(spark, monkeypatch, size):
    """Dense and sparse places, repeated values, ties by rounding, windows over many ranges or none."""
    monkeypatch.setattr(joins, "RANGE_VALUES", size)
    rnd = random.Random(7)
    left = [(i, round(rnd.uniform(50, 1000), 1)) for i in range(60)] + [(70, 500.0), (71, 500.0), (72, 1e9), (73, None)]
    right = [(i, round(rnd.choice([rnd.uniform(0, 1100), rnd.gauss(500, 0.5), 500.0]), 2)) for i in range(400)] + [(999, None)]
    score = F.round(-F.pow((F.col("y") - F.col("x")) / F.col("x") * 10, F.lit(2.0)), 3)
    # halves of 0.001 in squares of ten times the share: 1e-5 of its square
    got = joins.band_top_k(spark.createDataFrame(left, "a long, x double"), spark.createDataFrame(right, "b long, y double"), "a", "x", "y", 0.02, 5, score, "b", 0.0033)
    want = []
    for a, x in left:
        inside = [(round(-(((y - x) / x * 10) ** 2) + 0.0, 3), b) for b, y in right if x is not None and y is not None and x * (1 - 0.02) <= y <= x * (1 + 0.02)]
        want += [(a, b, n + 1) for n, (_, b) in enumerate(sorted(inside, key=lambda p: (-p[0], p[1]))[:5])]
    assert sorted((r.a, r.b, r["rank"]) for r in got.collect()) == sorted(want) and want


def test_adaptive_windows_down_to_zero(spark):
    left, right = [("a", 3.0), ("b", 1e6)], [(1, -5.0), (2, 0.0), (3, 1e-9), (4, 5.9), (5, 6.1), (6, 1e5), (7, None)]
    got = joins.adaptive_band_join(spark.createDataFrame(left, "a string, x double"), spark.createDataFrame(right, "b long, y double"), "a", "b", "x", "y", 0.01, 50, passes=6)
    w = joins.widths(0.01, 6)[-1]
    want = {(a, b) for a, x in left for b, y in right if y is not None and x * (1 - w) <= y <= x * (1 + w)}
    assert {(r.a, r.b) for r in got.collect()} == want and w > 1


def test_closest_pairs_and_intervals_equal_all_pairs(spark):
    import datetime

    rnd = random.Random(9)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [[(rnd.randrange(6), rnd.choice([float(rnd.randrange(40)), None]), t0 + datetime.timedelta(seconds=rnd.randrange(400))) for _ in range(60)] for _ in range(2)]
    rows[0].append((77, 1.0, t0))
    a, b = (spark.createDataFrame(r, f"k long, {c} double, {t} timestamp") for r, c, t in zip(rows, "xy", ("s", "t"), strict=True))
    want = {}
    for k, x, _ in rows[0]:
        for m, y, _ in rows[1]:
            if k == m and x is not None and y is not None:
                want[k] = min(want.get(k, 1e9), abs(x - y))
    assert {r.k: r.distance for r in joins.closest_pairs(a, b, "k", "x", "y").collect()} == want
    got = sorted((r.k, r.s, r.t) for r in joins.interval_join(a.drop("x"), b.drop("y"), "k", "s", "t", 30).collect())
    assert got == sorted((k, s, u) for k, _, s in rows[0] for m, _, u in rows[1] if k == m and s < u <= s + datetime.timedelta(seconds=30)) and got


def test_exact_quantiles(spark):
    from quern.operators import aggregate

    rnd = random.Random(13)
    rows = [(k, g, rnd.choice([rnd.uniform(0, 9), 3.0, None])) for k in ("a", "b", None) for g in (1, 2) for _ in range(rnd.randint(1, 40))] + [("z", 1, 5.0)]
    got = aggregate.exact_quantiles(spark.createDataFrame(rows, "k string, g long, v double"), ["k", "g"], "v", {"low": 0.0, "mid": 0.5, "most": 0.93}).collect()
    held = {}
    for k, g, v in rows:
        if v is not None:
            held.setdefault((k, g), []).append(v)
    assert len(got) == len(held)
    for r in got:
        v = held[r.k, r.g]
        assert r.n == len(v) and np.allclose([r.low, r.mid, r.most], np.quantile(v, [0, 0.5, 0.93]))


def test_shape_pairs_by_brute_force(spark):
    rnd = random.Random(14)
    pieces = [(i, rnd.choice("xyz"), rnd.randint(1, 3), rnd.choice("pq")) for i in range(30)]
    regions = [(i, rnd.choice("xyw"), rnd.choice("pqr")) for i in range(9)] + [(20, "z", "p")]
    got = grid.shape_pairs(spark.createDataFrame(pieces, "a long, s string, n long, w string"), spark.createDataFrame(regions, "b long, s string, w string"), "s", "a", "b", "n", "w", 100)
    want = {a: min(b for b, t, v in regions if t == s and v != w) for a, s, n, w in pieces if n >= 2 and any(t == s and v != w for _, t, v in regions)}
    assert {r.a: r.b for r in got.collect()} == want and want


def test_best_postings_by_brute_force(spark):
    rnd = random.Random(17)
    rows = [(i, rnd.choice("abc"), d, float(rnd.randrange(40))) for i in range(30) for d in range(3)]
    entry = {i: rnd.choice("abc") for i in range(30)}
    rows = [(i, entry[i], d, y) for i, _, d, y in rows]
    got = {(r.k, r.e, r.d): r.best for r in joins.best_postings(spark.createDataFrame(rows, "k long, e string, d long, y double"), "k", "e", "d", "y", 3.0).collect()}
    want = {}
    for i, _, d, y in rows:
        for j, e, f, z in rows:
            if i != j and d == f and abs(y - z) <= 3.0:
                want[i, e, d] = max(want.get((i, e, d), 0.0), 1 - abs(y - z) / 3.0)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)


def test_top_similar_sets_by_brute_force(spark):
    rnd = random.Random(15)
    sets = {i: {rnd.choice("abc") if rnd.random() < 0.4 else f"w{rnd.randrange(60)}" for _ in range(rnd.randint(1, 12))} for i in range(50)}
    sets |= {60: {"only"}, 61: sets[3], 62: sets[3]}
    df = spark.createDataFrame([(i, w) for i, s in sets.items() for w in s], "k long, w string")
    for probe in (1, 8):
        got = [(r.k, r.other, round(r.similarity, 9), r["rank"]) for r in joins.top_similar_sets(df, "k", "w", 4, probe).collect()]
        want = []
        for i, s in sets.items():
            scored = sorted((-len(s & t) / len(s | t), j) for j, t in sets.items() if j != i and s & t)
            want += [(i, j, round(-x, 9), n + 1) for n, (x, j) in enumerate(scored[:4])]
        assert sorted(got) == sorted(want)


def test_chain_merge_is_anchored_at_the_first_value(spark):
    rows = spark.createDataFrame([([(0.0, 1.0), (0.9, 1.0), (1.8, 1.0)],), ([],)], "p array<struct<x:double,y:double>>")
    got = [r.m for r in rows.select(V.chain_merged(F.col("p"), 1.0).alias("m")).collect()]
    assert [(p.x, p.y) for p in got[0]] == [(0.0, 2.0), (1.8, 1.0)] and got[1] == []


def test_array_functions_on_edges(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0]), ([], [1.0])], "a array<double>, b array<double>")
    assert [r.n for r in rows.select(F.size(V.pair_truncated(F.col("a"), F.col("b"))).alias("n")).collect()] == [1, 0]
    zero = spark.createDataFrame([([(1.0, 0.0), (2.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert len(zero.select(V.above_floor(F.col("p")).alias("k")).first().k) == 2
    assert zero.select(F.size(V.strongest(F.col("p"), 1)).alias("n")).first().n == 1


def test_scores_of_single_and_constant_groups(spark):
    df = spark.createDataFrame([("one", 5.0), ("same", 2.0), ("same", 2.0)], "q string, x double")
    got = df.select("q", rank.zscore(F.col("x"), ["q"]).alias("z"), rank.zscore_or_zero(F.col("x"), ["q"]).alias("s"), rank.capped_rank(F.col("x"), ["q"]).alias("r")).collect()
    assert all((r.z, r.s, r.r) == (0.0, 0.0, 0) for r in got)


def test_reranking_keeps_positions_of_null_groups(spark):
    df = spark.createDataFrame([("q", 1, "a", 1.0), ("q", 2, None, 9.0), ("q", 3, "a", 2.0), ("q", 4, "b", 0.0)], "q string, pos long, g string, s double")
    got = {r.pos: r.new_position for r in rank.slot_rerank(df, "q", "pos", "g", "s").collect()}
    assert got == {1: 3, 2: 2, 3: 1, 4: 4}


def test_merges_are_distinct_and_bounded(spark):
    a = spark.createDataFrame([("q", f"a{i}", i) for i in range(1, 8)], "q string, item string, pos long")
    b = spark.createDataFrame([("q", "a2", 1), ("q", "b1", 2), ("r", "b1", 1)], "q string, item string, pos long")
    got = rank.ordered_union([a, b], "q", "item", "pos", 6).orderBy("q", "place").collect()
    assert [r.item for r in got if r.q == "q"] == ["a1", "a2", "a3", "a4", "a5", "a6"] and [r.item for r in got if r.q == "r"] == ["b1"]
    slots = [r.item for r in rank.slot_interleave(a, b, "q", "item", "pos", [1, 3], 5).where("q = 'q'").orderBy("place").collect()]
    assert slots == ["a2", "a1", "b1", "a2", "a3"]


def test_threshold_merge_is_stateful(spark):
    a = spark.createDataFrame([("q", "a1", 9.0), ("q", "a2", 5.0)], "q string, item string, s double")
    b = spark.createDataFrame([("q", "b1", 7.0), ("q", "a2", 6.0)], "q string, item string, s double")
    assert [r.item for r in rank.threshold_merge(a, b, "q", "item", "s", 10).orderBy("place").collect()] == ["a1", "b1", "a2"]


def test_mmr_prefers_what_differs(spark):
    df = spark.createDataFrame([("q", "a", 1, [1.0, 0.0]), ("q", "b", 2, [1.0, 0.01]), ("q", "c", 3, [0.0, 1.0])], "q string, item string, pos long, v array<double>")
    assert [r.item for r in rank.mmr(df, "q", "item", "pos", "v", 3, 0.7).orderBy("place").collect()] == ["a", "c", "b"]


def test_truth_absent_and_tied(spark):
    df = spark.createDataFrame([("none", 1.0, False), ("tie", 1.0, True), ("tie", 1.0, False), ("top", 2.0, True), ("top", 1.0, False)], "q string, s double, t boolean")
    standing = E.truth_standing(df, "q", "s", "t")
    assert math.isclose(E.mean_reciprocal_rank(standing, 25, "pessimistic").first().mrr, (0 + 0.5 + 1) / 3)
    assert math.isclose(E.mean_reciprocal_rank(standing, 25, "averaged").first().mrr, (0 + 1 / 1.5 + 1) / 3)


def greedy(weights):
    left, right, out = set(), set(), []
    for w, i, j in sorted(weights):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append(w)
    return out


def test_peak_similarities_by_brute_force(spark):
    rnd = random.Random(3)
    rows = [(k, *[sorted((round(rnd.uniform(0, 4), 2), rnd.uniform(0.01, 1)) for _ in range(rnd.randint(0, 9))) for _ in range(2)]) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    a, b = F.col("a"), F.col("b")
    got = df.select("k", P.best_peak_cosine(a, b, 0.3).alias("best"), P.modified_cosine(a, b, 1.0, 0.2).alias("modified"), P.closest_matches(a, b, 0.3).alias("closest"), P.tolerance_entropy_similarity(a, b, 0.2).alias("entropy"), P.tolerance_entropy_similarity(a, a, 1e-6).alias("own")).collect()
    assert len(got) == len(rows)

    def weights(p):
        y = np.array([y for _, y in p])
        y = y / y.sum()
        h = -(y * np.log(y)).sum()
        y = y ** (0.25 + 0.25 * h) if h < 3 else y
        return y / y.sum()

    for r in got:
        _, p, q = rows[r.k]
        norm = math.sqrt(sum(y for _, y in p) * sum(y for _, y in q))
        best = sum(math.sqrt(y) * max((math.sqrt(v) for u, v in q if abs(x - u) <= 0.3), default=0) for x, y in p)
        assert math.isclose(r.best, best / norm if norm else 0, abs_tol=1e-9)
        near = [(i, j, x - u, math.sqrt(y) * math.sqrt(v)) for i, (x, y) in enumerate(p) for j, (u, v) in enumerate(q)]
        modified = -sum(greedy([(-w, i, j) for i, j, d, w in near if abs(d) <= 0.2 or abs(d - 1.0) <= 0.2]))
        assert math.isclose(r.modified, modified / norm if norm else 0, abs_tol=1e-9)
        assert r.closest == len(greedy([(abs(d), i, j) for i, j, d, _ in near if abs(d) <= 0.3]))
        entropy = 0.0
        if p and q:
            assert math.isclose(r.own, 1, abs_tol=1e-9)
            w, v, i, j, mix = weights(p), weights(q), 0, 0, []
            while i < len(p) and j < len(q):
                if abs(p[i][0] - q[j][0]) <= 0.2:
                    mix.append((w[i] + v[j]) / 2)
                    i, j = i + 1, j + 1
                elif p[i][0] < q[j][0]:
                    mix.append(w[i] / 2)
                    i += 1
                else:
                    mix.append(v[j] / 2)
                    j += 1
            mix = np.array([*mix, *(w[i:] / 2), *(v[j:] / 2)])
            h = lambda z: -(z * np.log(z)).sum()
            entropy = 1 - (2 * h(mix) - h(w) - h(v)) / math.log(4)
        assert math.isclose(r.entropy, entropy, abs_tol=1e-9)


def test_bootstrap_brackets_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(300)], "k long, v double")
    r = sampling.bootstrap_mean(df, "k", "v", 100, seed=1).first()
    assert r.low < r["mean"] < r.high


def test_holdouts_keep_sides_apart(spark):
    df = spark.createDataFrame([(k, 10 * k + i, i % 2 == 0) for k in range(30) for i in range(6)], "k long, row long, ok boolean")
    for mode in ("sibling", "denovo", "other_kind"):
        q, lib = sampling.holdout(df, "k", "row", F.col("ok"), 2, 8, 3, mode, seed=4)
        queries, library = q.collect(), lib.collect()
        drawn = {r.k for r in queries}
        assert len(drawn) == 8 and not {r.row for r in queries} & {r.row for r in library}
        own = [r for r in library if r.k in drawn]
        if mode == "sibling":
            assert all(any(r.k == k and r.ok for r in own) for k in drawn)
        elif mode == "denovo":
            assert not own
        else:
            assert own and not any(r.ok for r in own)


def test_matched_sample_follows_the_target(spark):
    src = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(2000)], "k long, s string")
    tgt = spark.createDataFrame([(("b",)) for _ in range(90)] + [(("a",)) for _ in range(10)], "s string")
    got = [r.s for r in sampling.matched_sample(src, tgt, "s", "k", 100, seed=2).collect()]
    assert len(got) == 100 and got.count("b") > 60


def test_absorbing_chain_by_hand(spark):
    edges = spark.createDataFrame([("g", "a", "b", 0.5), ("g", "a", "c", 0.25), ("g", "b", "c", 1.0), ("g", "c", "d", 0.5), ("h", "a", "b", 1.0)], "g string, u string, v string, p double")
    starts = spark.createDataFrame([("g", "a"), ("h", "a"), ("lone", "x")], "g string, n string")
    got = lambda depth, last: {(r.g, r.n): r.observed for r in generate.absorbing_chain(edges, starts, "g", "u", "v", "p", "n", depth, last).collect()}
    assert got(3, False) == {("g", "a"): 0.25, ("g", "c"): 0.375, ("g", "d"): 0.375, ("h", "b"): 1.0, ("lone", "x"): 1.0}
    assert got(1, False) == {("g", "a"): 0.25, ("g", "c"): 0.125, ("h", "b"): 1.0, ("lone", "x"): 1.0}
    assert got(1, True) == {("g", "a"): 0.25, ("g", "b"): 0.5, ("g", "c"): 0.25, ("h", "b"): 1.0, ("lone", "x"): 1.0}


def test_grid_components_match_a_flood_fill(spark):
    rng = np.random.default_rng(5)
    board = rng.integers(0, 2, (12, 12))
    cells = spark.createDataFrame([(0, y, x, int(board[y, x])) for y in range(12) for x in range(12)], "f long, y long, x long, c long")
    got = {(r.y, r.x): (r.label.y, r.label.x) for r in grid.grid_components(cells, "f", "y", "x", "c").collect()}
    for start in got:
        seen, todo = {start}, [start]
        while todo:
            y, x = todo.pop()
            for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if n in got and n not in seen and board[n] == board[y, x]:
                    seen.add(n)
                    todo.append(n)
        assert got[start] == min(seen)


def test_coordinate_searches():
    both = lambda p: (-((p["a"] - 2) ** 2), -((p["a"] - 2) ** 2) - (p["b"] - 1) ** 2)
    assert learn.coordinate_descent({"a": 0.0, "b": 0.0}, {"a": [0, 1, 2, 3], "b": [0, 1]}, both)["a"] == 2
    assert abs(learn.step_halving({"a": 0.0}, {"a": 1.0}, lambda p: -((p["a"] - 2.25) ** 2))["a"] - 2.25) <= 0.25


def test_conditional_logit_finds_the_sign(spark):
    rnd = random.Random(6)
    rows = []
    for q in range(40):
        xs = [rnd.gauss(0, 1) for _ in range(5)]
        rows += [(q, x == max(xs), x, rnd.gauss(0, 1)) for x in xs]
    w = learn.conditional_logit(spark.createDataFrame(rows, "q long, t boolean, a double, b double"), "q", "t", ["a", "b"], steps=15)
    assert w["a"] > 0.5 > abs(w["b"])


def test_heads_with_unknown_tags(spark, tmp_path):
    data = S.pack_heads([(1.5, 7, 0, 3, 2, 4), (2.5, 8, 3, 1, 3, None), (3.5, 9, 4, 1, None, None)])
    (tmp_path / "x.bin").write_bytes(data)
    got = {r.mol: (r.category, r.instrument, r.n) for r in S.read_heads(spark, str(tmp_path)).collect()}
    # category 0 with an unknown instrument can't be told from an unknown category, as the format is ambiguous there
    assert got[7] == (2, 4, 3) and got[8] == (3, None, 1) and got[9][1] is None


def test_bit_rows_lines_and_digest(spark, tmp_path):
    import struct

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.bin").write_bytes(struct.pack("<II", 2, 100) + struct.pack("<HHH", 2, 3, 9) + struct.pack("<H", 0))
    assert [(r.row, list(r.bits)) for r in S.read_bit_rows(spark, str(folder)).collect()] == [(0, [3, 9]), (1, [])]
    a = S.folder_digest(spark, str(folder)).first()
    (folder / "c.txt").write_text("x")
    assert a.files == 1 and a.digest != S.folder_digest(spark, str(folder)).first().digest
    text = tmp_path / "lines"
    text.mkdir()
    (text / "1.txt").write_text("a\tx y\r\nb\n")
    (text / "2.txt").write_text("c\tz\n")
    assert [(r.number, r.name, r.rest) for r in S.read_named_lines(spark, str(text)).orderBy("number").collect()] == [(0, "a", "x y"), (1, "b", ""), (2, "c", "z")]


def test_ion_records(spark, tmp_path):
    (tmp_path / "x.mgf").write_text("BEGIN IONS\nPEPMASS=10.5\nSPECTRUMID=s1\n1.0 2.0\n3.0 4e1\nEND IONS\n\nBEGIN IONS\nPEPMASS=11\nEND IONS\n")
    got = S.read_ion_records(spark, str(tmp_path), ["SPECTRUMID", "PEPMASS"]).collect()
    assert [(r.spectrumid, r.pepmass, [(p.x, p.y) for p in r.peaks]) for r in got] == [("s1", "10.5", [(1.0, 2.0), (3.0, 40.0)]), (None, "11", [])]


@pytest.mark.parametrize("width", ["1 day", "6 hours"])
def test_stream_and_batch_agree(spark, tmp_path, width):
    from quern.streaming.windows import event_stream, run_to_table, windowed

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = {(r.start, r.event_type): r.n for r in windowed(events, width).collect()}
    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in")
    stream = event_stream(spark, str(tmp_path / "in"), events.schema)
    name = f"out_{width.replace(' ', '_')}"
    got = {(r.start, r.event_type): r.n for r in run_to_table(windowed(stream, width), name, "complete", str(tmp_path / "c")).collect()}
    assert got == batch


def test_interleaving_and_merging_by_plain_loops(spark):
    """Lists of all lengths, some empty, against walks along both."""
    import random

    rnd = random.Random(14)
    lists = {f"q{k}": ([f"a{i}" for i in range(rnd.randint(0, 7))], [f"b{i}" for i in range(rnd.randint(0, 5))]) for k in range(60)}
    rows = lambda k: [(q, x, i + 1) for q, ab in lists.items() for i, x in enumerate(ab[k])]
    a, b = (spark.createDataFrame(rows(k), "q string, item string, pos long") for k in (0, 1))
    for slots, n in (([2, 3], 6), ([1, 4, 9], 7), ([5], 3), ([], 4)):
        want = []
        for q, (one, two) in lists.items():
            one, two, out = one[:n], two[: len(slots)], []
            while len(out) < n and (one or two):
                out.append(two.pop(0) if two and (len(out) + 1 in slots or not one) else one.pop(0))
            want += [(q, x, i + 1) for i, x in enumerate(out)]
        assert sorted(map(tuple, rank.slot_interleave(a, b, "q", "item", "pos", slots, n).select("q", "item", "place").collect())) == sorted(want)
    scored = [{q: sorted(((rnd.randrange(6) / 2, f"i{rnd.randrange(9)}") for _ in range(rnd.randint(0, 6))), key=lambda x: (-x[0], x[1])) for q in lists} for _ in range(2)]
    scored = [{q: list({i: (s, i) for s, i in reversed(held)}.values()) for q, held in part.items()} for part in scored]
    a, b = (spark.createDataFrame([(q, i, s) for q, held in part.items() for s, i in held], "q string, item string, s double") for part in scored)
    for n, margin in ((4, 0.0), (9, 0.5), (3, 1.0)):
        want = []
        for q in lists:
            one, two = (sorted(part[q], key=lambda x: (-x[0], x[1])) for part in scored)
            out = []
            while len(out) < n and (one or two):
                _, item = two.pop(0) if two and (not one or two[0][0] > one[0][0] + margin) else one.pop(0)
                if item not in out:
                    out.append(item)
            want += [(q, x, i + 1) for i, x in enumerate(out)]
        assert sorted(map(tuple, rank.threshold_merge(a, b, "q", "item", "s", n, margin).collect())) == sorted(want)


def test_nearest_of_infinite_values(spark):
    left = spark.createDataFrame([(1, float("inf")), (2, 3.0), (3, float("-inf")), (4, None), (5, float("nan"))], "k long, x double")
    both = spark.createDataFrame([(float("inf"),), (1.0,)], "y double")
    got = {r.k: r.distance for r in joins.nearest_join(left, both, "k", "x", "y").collect()}
    assert got == {1: 0.0, 2: 2.0, 3: float("inf"), 4: None, 5: None}
    assert {r.k: r.distance for r in joins.nearest_join(left, both.where("y < 2"), "k", "x", "y").collect()} == {1: float("inf"), 2: 2.0, 3: float("inf"), 4: None, 5: None}
