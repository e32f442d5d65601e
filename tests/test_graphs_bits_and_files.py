"""Graph pieces, neighbourhood hashes, packed bits, window counts, composition counts, and binary files."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import bits, generate, graphs, joins
from quern.sources import fixed_width
from quern.sources import records as S

# -- graphs


def pieces_by_search(weights, edges):
    """Cuts of single edges that lie on no ring, and of all pairs of others, by taking them out."""

    def parts(gone):
        at = list(range(len(weights)))

        def root(x):
            while at[x] != x:
                x = at[x]
            return x

        for i, (a, b) in enumerate(edges):
            if i not in gone:
                at[root(a)] = root(b)
        held = {}
        for x in range(len(weights)):
            held.setdefault(root(x), []).append(x)
        return [tuple(p) for p in held.values()]

    whole = parts(())
    found, bridges = Counter(sum(weights[x] for x in p) for p in whole), set()
    for n in (1, 2):
        for gone in itertools.combinations(range(len(edges)), n):
            if n == 2 and bridges & set(gone):
                continue
            now = parts(gone)
            if len(now) > len(whole):
                bridges |= set(gone) if n == 1 else set()
                found.update(sum(weights[x] for x in p) for p in now if p not in whole)
    return found


def test_pieces_of_trees_rings_and_fused_rings():
    assert graphs.cut_pieces([1, 2, 4], [(0, 1), (1, 2)]) == {7: 1, 1: 1, 6: 1, 3: 1, 4: 1}
    ring = graphs.cut_pieces([1, 2, 4], [(0, 1), (1, 2), (2, 0)])
    assert ring == pieces_by_search([1, 2, 4], [(0, 1), (1, 2), (2, 0)]) and ring[7] == 1
    fused = [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4), (4, 5), (5, 3), (0, 6)]
    assert graphs.cut_pieces([1, 2, 4, 8, 16, 32, 64], fused) == pieces_by_search([1, 2, 4, 8, 16, 32, 64], fused)
    rnd = random.Random(3)
    for t in range(400):
        n, m = rnd.randint(1, 8), rnd.randint(0, 11)
        w = [rnd.randint(-3, 9) if t % 2 else rnd.randint(0, 5) for _ in range(n)]
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        assert graphs.cut_pieces(w, edges) == pieces_by_search(w, edges), (w, edges)


def test_large_graphs_take_linear_work_but_for_rings():
    n = 100_000
    assert len(graphs.cut_pieces([1] * n, [(i, i + 1) for i in range(n - 1)])) == n
    # a hub with triangles: a hundred thousand rings of three edges
    found = graphs.cut_pieces([1] * (2 * 20_000 + 1), [e for k in range(20_000) for e in ((0, 2 * k + 1), (2 * k + 1, 2 * k + 2), (2 * k + 2, 0))])
    assert found == {40_001: 1, 1: 40_000, 40_000: 40_000, 2: 20_000, 39_999: 20_000}


def test_fragments_of_odd_rows(spark):
    nodes = spark.createDataFrame([("g", 1, 5), ("g", 2, None), ("g", 2, 7), ("g", 3, 1), (None, 4, 1), ("h", 1, 2), ("g", None, 3)], "g string, n long, w long")
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 99), ("g", None, 1), (None, 1, 2)], "g string, a long, b long")
    got = {(r.g, r.weight): r.ways for r in graphs.fragments(nodes, edges, "g", "n", "w", "a", "b").collect()}
    assert got == {("g", 6): 1, ("g", 5): 2, ("g", 1): 2, ("h", 2): 1}  # 5: node 1 alone, and nodes 1 and 2
    assert graphs.fragments(nodes.where("false"), edges, "g", "n", "w", "a", "b").count() == 0


def test_fragment_query_by_search(spark):
    from quern.plans import reference, similarity

    sf = "/root/testdata/sf0.001"
    nodes, edges = similarity.order_graphs(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    held, links = {}, {}
    for r in nodes.collect():
        held.setdefault(r.o_custkey, {})[r.node] = r.w
    for r in edges.collect():
        links.setdefault(r.o_custkey, []).append((r.o_orderkey, r.s))
    got = {}
    for r in reference.QUERIES["g1_fragment_enumeration"](spark, sf).collect():
        got.setdefault(r.o_custkey, {})[r.weight] = r.ways
    assert set(got) == set(held)
    small = sorted(held, key=lambda c: len(links.get(c, [])))[:60]
    for c in small:
        place = {n: k for k, n in enumerate(held[c])}
        assert got[c] == pieces_by_search(list(held[c].values()), [(place[a], place[b]) for a, b in links.get(c, [])])
    assert any(len(links.get(c, [])) >= len(held[c]) for c in small) or max(len(links.get(c, [])) for c in small) > 5


def test_neighbourhoods_of_equal_shape_share_hashes(spark):
    rows = [("a", x, y) for x, y in ((1, 2), (2, 3), (3, 4))] + [("b", x, y) for x, y in ((9, 7), (7, 5), (5, 8))] + [("c", 1, 2), ("c", 2, 3), ("c", 3, 1)]
    edges = spark.createDataFrame([(*r, "s") for r in rows], "g string, a long, b long, bond string")
    nodes = spark.createDataFrame(sorted({(g, n, "x") for g, *ab in rows for n in ab}) + [("d", 1, None)], "g string, n long, label string")
    got = {}
    for r in graphs.neighbourhood_hashes(nodes, edges, "g", "n", "label", "a", "b", "bond", 2).collect():
        got.setdefault(r.g, {}).setdefault(r.radius, []).append(r.hash)
    assert all(sorted(got["a"][r]) == sorted(got["b"][r]) for r in range(3)) and got["a"][1] != got["c"][1]
    assert [len(set(got["a"][r])) for r in range(3)] == [1, 2, 2] and len(set(got["c"][2])) == 1 and len(got["d"][2]) == 1


# -- bits


def similar_by_search(rows, k):
    out = []
    for a, x in rows:
        found = []
        for b, y in rows:
            shared, whole = (x & y).bit_count(), (x | y).bit_count()
            if a != b and shared:
                found.append((-shared / whole, b))
        out += [(a, b, -s, n + 1) for n, (s, b) in enumerate(sorted(found)[:k])]
    return sorted(out)


def as_sets(spark, rows, words=2):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return spark.createDataFrame([(a, [signed(x >> (64 * w) & ((1 << 64) - 1)) for w in range(words)]) for a, x in rows], "id long, b array<long>")


@pytest.mark.parametrize("block", [8, 4096])
def test_similar_bits_equal_all_pairs(spark, block):
    rnd = random.Random(block)
    rows = [(k, rnd.getrandbits(128) & rnd.getrandbits(128) & (rnd.getrandbits(128) if k % 3 else -1 & (1 << 128) - 1)) for k in range(90)] + [(200, 0), (201, 0), (202, 1 << 127), (203, 1 << 127)]
    best, _ = bits.top_similar_bits(as_sets(spark, rows), "id", "b", 3, block)
    got = sorted((r.key, r.other, r.similarity, r["rank"]) for r in best.collect())
    assert [(a, b, round(s, 12), r) for a, b, s, r in got] == [(a, b, round(s, 12), r) for a, b, s, r in similar_by_search(rows, 3)]


def test_bounds_leave_most_blocks_out(spark):
    """On clustered bits under half of all pairs of blocks are compared."""
    rnd = random.Random(5)
    rows = []
    for c in range(40):
        core = rnd.getrandbits(128)
        for _ in range(c):
            core &= rnd.getrandbits(128) | rnd.getrandbits(128) | rnd.getrandbits(128) | rnd.getrandbits(128)
        rows += [(100 * c + k, core ^ (1 << rnd.randrange(128)) ^ (1 << rnd.randrange(128))) for k in range(24)]
    best, pairs = bits.top_similar_bits(as_sets(spark, rows), "id", "b", 3, 32)
    n = (len(rows) + 31) // 32
    assert pairs.count() < 0.5 * n * n
    got = sorted((r.key, r.other, round(r.similarity, 12)) for r in best.collect())
    assert got == [(a, b, round(s, 12)) for a, b, s, _ in similar_by_search(rows, 3)]


def test_packed_flags(spark):
    df = spark.createDataFrame([([True, None, False] + [False] * 60 + [True],), ([],), ([False] * 64 + [True],)], "f array<boolean>")
    assert [r.b for r in df.select(bits.packed(F.col("f")).alias("b")).collect()] == [[1 - (1 << 63)], [0], [0, -(1 << 63)]]


# -- windows


def test_window_counts_by_search(spark):
    rnd = random.Random(2)
    left = [(k, rnd.choice([None, float("nan"), 5.0, rnd.randrange(60) / 2])) for k in range(80)]
    right = [rnd.choice([None, 5.0, float("nan"), rnd.randrange(60) / 2]) for _ in range(300)]
    a, b = spark.createDataFrame(left, "k long, v double"), spark.createDataFrame([(x,) for x in right], "y double")
    real = [y for y in right if y is not None and y == y]
    for half_open in (False, True):
        got = {r.k: (r.near, r.far) for r in joins.window_counts(a, "v", b, "y", {"near": 1.5, "far": 8.0}, half_open).collect()}
        count = lambda x, w: 0 if x is None or x != x else sum(x - w <= y and (y < x + w if half_open else y <= x + w) for y in real)  # noqa: B023, E731
        assert got == {k: (count(x, 1.5), count(x, 8.0)) for k, x in left}
    assert {r.near for r in joins.window_counts(a, "v", b.where("false"), "y", {"near": 1.0}).collect()} == {0}


@pytest.mark.parametrize("values", [7, 1 << 16])
def test_distinct_keys_in_windows_by_search(spark, monkeypatch, values):
    """Over one range and over many; a key that holds a third of the rows, keys that come again, ends exactly on values."""
    monkeypatch.setattr(joins, "RANGE_VALUES", values)
    rnd = random.Random(values)
    right = [(rnd.choice([1, rnd.randrange(40)]) if rnd.random() < 0.6 else None, float(rnd.randrange(1, 80))) for _ in range(400)]
    right = [(None if k is None else k, v) for k, v in right]
    asked = sorted({float(rnd.randrange(1, 90)) for _ in range(50)})
    held = joins._distinct_ranges(spark.createDataFrame(right, "k long, v double"), "k", "v")
    for rel in (0.1, 0.5, 1.5):
        got = {r.m: r.n for r in joins.distinct_in_windows(spark.createDataFrame([(m,) for m in asked], "m double"), held, rel).collect()}
        assert got == {m: len({k for k, v in right if k is not None and m * (1 - rel) <= v <= m * (1 + rel)}) for m in asked}


def test_dominance_counts_by_search():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 100):
        reach = rng.integers(-3, 9, n).astype(float)
        low, high, least = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200), rng.integers(-4, 10, 200).astype(float)
        assert joins.dominated(low, high, least, reach).tolist() == [int((reach[a:b] < x).sum()) for a, b, x in zip(low, high, least, strict=True)]


# -- compositions


def test_composition_counts_beyond_rows(spark):
    rows = [(1, 60, 60, 60, 600), (2, 3, 2, 1, 10), (3, None, -1, 2, 4), (4, 1, 1, 1, None), (5, 2, 2, 2, -5), (6, 2, 2, 2, 0)]
    df = spark.createDataFrame(rows, "k long, a long, b long, c long, m long")
    got = {r.k: r.n for r in generate.composition_counts(df, "k", {"a": "a", "b": "b", "c": "c"}, {"a": 1, "b": 2, "c": 3}, "m", 1).collect()}

    def want(a, b, c, m):
        if m is None:
            return 0
        return sum(abs(i + 2 * j + 3 * k - m) <= 1 for i in range(max(a or 0, 0) + 1) for j in range(max(b or 0, 0) + 1) for k in range(max(c or 0, 0) + 1))

    assert got == {k: want(*r) for k, *r in rows}
    many = spark.createDataFrame([(1, 4000)], "k long, n long").withColumn("m", F.lit(2000))
    (r,) = generate.composition_counts(many, "k", dict.fromkeys("abcd", "n"), {"a": 1, "b": 1, "c": 2, "d": 3}, "m").collect()
    table = [1] + [0] * 2000
    for m in (1, 1, 2, 3):
        for x in range(m, 2001):
            table[x] += table[x - m]
    assert r.n == table[2000] > 10**8


def test_ruled_compositions_of_odd_targets(spark):
    df = spark.createDataFrame([(1, None), (2, -3.0), (3, 0.0), (4, 5.0)], "k long, m double")
    rules = (lambda: F.lit(True), lambda: F.lit(True), lambda: F.expr("a + b <= 4"))
    got = sorted(map(tuple, generate.ruled_compositions(df, "k", "m", ({"a": 1.0}, {"b": 2.0}), {"a": 9, "b": 9}, 1e-6, rules).collect()))
    assert got == [(4, 1, 2), (4, 3, 1)]
    assert generate.ruled_compositions(df.where("k < 3"), "k", "m", ({"a": 1.0}, {"b": 2.0}), {"a": 9, "b": 9}, 1e-6, rules).count() == 0


# -- files

PAIRS = np.dtype([("k", "<i4"), ("v", "<f8"), ("s", "<u2")])


def test_a_file_is_read_by_byte_ranges(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = np.zeros(1000, PAIRS)
    a["k"], a["v"], a["s"] = np.arange(1000), np.sort(rng.normal(size=1000)), rng.integers(0, 1 << 16, 1000)
    (tmp_path / "one.bin").write_bytes(b"HEAD" + a.tobytes())
    path = str(tmp_path / "one.bin")
    df = S.read_records(spark, path, PAIRS, header=4, row_column="row", partition_bytes=125 * PAIRS.itemsize)
    assert df.rdd.getNumPartitions() == 8 and df.schema.simpleString() == "struct<k:int,v:double,s:int,row:bigint>"
    assert sorted(map(tuple, df.collect())) == [(int(r["k"]), float(r["v"]), int(r["s"]), i) for i, r in enumerate(a)]
    low, high = float(a["v"][300]), float(a["v"][340])
    part = S.read_records(spark, path, PAIRS, ["k"], {"v": (low, high)}, "v", header=4, partition_bytes=10 * PAIRS.itemsize)
    assert part.rdd.getNumPartitions() == 5 and sorted(r.k for r in part.collect()) == list(range(300, 341)) and part.columns == ["k"]
    assert S.read_records(spark, path, PAIRS, ["s"], {"k": (5, 7), "v": (-9, 9)}, header=4).count() == 3
    with pytest.raises(Exception, match="behind the last record"):
        S.read_records(spark, path, PAIRS).count()


def test_filters_reach_the_reader(spark, tmp_path):
    a = np.zeros(100, PAIRS)
    a["k"] = np.arange(100)
    (tmp_path / "x.bin").write_bytes(a.tobytes())
    options = fixed_width._options(str(tmp_path), PAIRS, None, None, "k", 0, 10 * PAIRS.itemsize)
    reader = fixed_width.PushedReader(options)
    pushed = [fixed_width.GreaterThan(("k",), 41), fixed_width.LessThanOrEqual(("k",), 45), fixed_width.EqualTo(("other",), 1)]
    assert list(reader.pushFilters(pushed)) == pushed and reader.ranges == {"k": (41.0, 45.0)}
    assert [(p.low, p.high) for p in reader.partitions()] == [(41, 46)]
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = S.read_records(spark, str(tmp_path), PAIRS, sorted_by="k").where("k > 41 AND k <= 45")
        assert sorted(r.k for r in got.collect()) == [42, 43, 44, 45]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_written_records_and_lists_come_back(spark, tmp_path):
    rows = [(k, k / 7, k % 5) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v double, s int").repartition(6)
    S.write_records(df, str(tmp_path / "r"), PAIRS)
    names = sorted(p.name for p in (tmp_path / "r").iterdir())
    assert len(names) == 6 and all(n.startswith("part-") for n in names)
    assert sorted(map(tuple, S.read_records(spark, str(tmp_path / "r"), PAIRS).collect())) == rows
    texts = [(k, "ä" * (k % 4) + str(k) if k % 9 else "") for k in range(300)]
    places = np.dtype([("k", "<i8"), ("at", "<u4"), ("n", "<u4")])
    S.write_lists(spark.createDataFrame(texts, "k long, values string").repartition(3), str(tmp_path / "p"), places, str(tmp_path / "t"), "u1", "at", "n", text=True)
    got = S.read_lists(spark, str(tmp_path / "p"), places, str(tmp_path / "t"), "u1", "at", "n", text=True, columns=["k"], partition_bytes=160)
    assert sorted(map(tuple, got.collect())) == texts and got.rdd.getNumPartitions() > 20
    S.write_bit_rows(spark.createDataFrame([(1, [3, 9, 65535]), (2, [])], "row long, values array<int>"), str(tmp_path / "b"))
    assert sorted(map(tuple, S.read_bit_places(spark, str(tmp_path / "b")).collect())) == [(1, [3, 9, 65535]), (2, [])]
    with pytest.raises(Exception, match="holds nulls"):
        S.write_records(spark.createDataFrame([(None, 1.0, 1)], "k int, v double, s int"), str(tmp_path / "n"), PAIRS)
    assert not list((tmp_path / "n").glob("part-*")) and not list((tmp_path / "n").glob("_*"))


def test_lists_that_share_and_overlap(spark, tmp_path):
    """One payload, lists in any order, some over the same numbers: two values a place, as pairs of coordinates are held."""
    values = np.arange(40, dtype="<f4")
    (tmp_path / "v.bin").write_bytes(values.tobytes())
    places = np.dtype([("id", "<i4"), ("off", "<i4"), ("n", "<i4")])
    held = [(0, 15, 5), (1, 0, 3), (2, 2, 4), (3, 0, 0), (4, 18, 2), (5, 0, 20)]
    (tmp_path / "p.bin").write_bytes(np.array(held, places).tobytes())
    got = S.read_lists(spark, str(tmp_path / "p.bin"), places, str(tmp_path / "v.bin"), "<f4", "off", "n", unit=8, per=2)
    assert {r.id: list(r["values"]) for r in got.collect()} == {i: values[2 * o : 2 * (o + n)].tolist() for i, o, n in held}


# -- formulas


def test_formulas_of_odd_texts(spark):
    from quern.functions import formulas

    rows = ["C6H12O6", "", None, "H2O", "ClNaCl2", "CH3CH2OH", "c6", "C6 H12", "C0H4", "Xx3", "Br1", "C99999999999"]
    df = spark.createDataFrame([(r,) for r in rows], "f string").select("f", formulas.parsed(F.col("f")).alias("u"))
    got = {r.f: (r.k, r.m) for r in df.select("f", formulas.key(F.col("u")).alias("k"), F.round(formulas.mass(F.col("u")), 4).alias("m")).collect()}
    assert got == {"C6H12O6": ("C6H12O6", 180.0634), "": ("", 0.0), None: (None, None), "H2O": ("H2O", 18.0106), "ClNaCl2": ("Cl3Na", 127.8963), "CH3CH2OH": ("C2H6O", 46.0419),
                   "c6": (None, None), "C6 H12": (None, None), "C0H4": ("H4", 4.0313), "Xx3": ("Xx3", None), "Br1": ("Br", 78.9183), "C99999999999": (None, None)}
    pairs = spark.createDataFrame([("C2H6O",)], "f string").select(formulas.parsed(F.col("f")).alias("u"))
    change = lambda u: pairs.select(formulas.key(formulas.added(F.col("u"), formulas.changed(u))).alias("k")).first().k
    assert change({"C": 1, "H": 2}) == "C3H8O" and change({"O": -1}) == "C2H6" and change({"O": -2}) is None and change({"N": -1}) is None
