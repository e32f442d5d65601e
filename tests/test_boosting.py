"""Boosted ranking trees and logits against plain in-memory versions, their controls and their edges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import boosting, learn
from quern.operators.boosting import SCALE, Growth
from quern.plans import aggregates

SF = "/root/testdata/sf0.001"
FEATURES = ["l_extendedprice", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def rows(spark):
    return aggregates.ranking_rows(lambda name: spark.read.parquet(f"{SF}/{name}.parquet")).persist()


def plain_fit(df, features, trees, rate, how, bins, base, metric="ndcg"):
    """The same method over arrays, one split at a time: (trees as (feature, threshold, left, right, value), MRR of held-out queries by round)."""
    df = df.sort_values(["q", "c"]).reset_index(drop=True)
    x = df[features].to_numpy(float)
    edges = []
    for j in range(x.shape[1]):
        v = np.sort(x[:, j])
        u = np.unique(v)
        if len(u) > bins:
            u = np.unique(np.append([v[max(1, k * len(v) // bins) - 1] for k in range(1, bins + 1)], v[-1]))
        edges.append(u)
    b = np.column_stack([np.minimum(np.searchsorted(e, x[:, j]), len(e) - 1) for j, e in enumerate(edges)])
    score = df[base[0]].to_numpy(float) * base[1]
    groups = [g.to_numpy() for _, g in df.groupby("q").groups.items()]
    truth, held = df.truth.to_numpy(), df.held.to_numpy()
    made, mrr = [], []

    def standing():
        out = []
        for g in groups:
            if held[g[0]]:
                t = score[g[truth[g]][0]]
                better, tied = (score[g] > t).sum(), (score[g] == t).sum() - 1
                out.append(1 / (better + 1 + tied / 2) if better < 25 else 0.0)
        return float(np.mean(out))

    mrr.append(standing())
    for _ in range(trees):
        grad, hess = np.zeros(len(df)), np.zeros(len(df))
        for g in groups:
            if held[g[0]]:
                continue
            order = g[np.lexsort((df.c.to_numpy()[g], -score[g]))]
            place = {r: k + 1 for k, r in enumerate(order)}
            gain = (lambda k: 1 / np.log2(1 + k)) if metric == "ndcg" else (lambda k: 1 / k)
            (t,) = g[truth[g]]
            own, own_h = {}, {}
            for r in g:
                if r != t:
                    rho = 1 / (1 + math.exp(score[t] - score[r]))
                    d = abs(gain(place[t]) - gain(place[r]))
                    own[r], own_h[r] = d * rho, d * rho * (1 - rho)
            total = sum(own.values())
            nf = math.log2(1 + 2 * total) / (2 * total) if total > 0 else 1.0
            for r, lam in own.items():
                grad[r], hess[r] = -lam * nf, own_h[r] * nf
            grad[t], hess[t] = total * nf, sum(own_h.values()) * nf
        grad, hess = np.round(grad * SCALE) / SCALE, np.round(hess * SCALE) / SCALE

        def split(r, depth):
            best = None
            if depth >= how.depth or len(r) < 2 * how.least_rows:
                return None
            g, h = grad[r].sum(), hess[r].sum()
            for j, e in enumerate(edges):
                for k in range(len(e) - 1):
                    left = b[r, j] <= k
                    n, gl, hl = left.sum(), grad[r][left].sum(), hess[r][left].sum()
                    if n < how.least_rows or len(r) - n < how.least_rows or hl < how.least_hessian or h - hl < how.least_hessian:
                        continue
                    value = gl**2 / (hl + how.l2) + (g - gl) ** 2 / (h - hl + how.l2) - g**2 / (h + how.l2)
                    if value > (best[0] if best else 0) + 1e-12:
                        best = (value, j, k)
            return best

        used = np.flatnonzero(~held)
        nodes, leaves = [[-1, 0, 0, 0, 0.0]], [(0, used, 0, split(used, 0))]
        while len(leaves) < how.leaves and any(s for *_, s in leaves):
            chosen = max((leaf for leaf in leaves if leaf[3]), key=lambda leaf: leaf[3][0])
            leaves = [leaf for leaf in leaves if leaf is not chosen]
            at, r, depth, (_, j, k) = chosen
            nodes[at] = [j, edges[j][k], len(nodes), len(nodes) + 1, 0.0]
            for part in (r[b[r, j] <= k], r[b[r, j] > k]):
                leaves.append((len(nodes), part, depth + 1, split(part, depth + 1)))
                nodes.append([-1, 0, 0, 0, 0.0])
        for at, r, *_ in leaves:
            nodes[at][4] = rate * grad[r].sum() / (hess[r].sum() + how.l2)
        for i in range(len(df)):
            at = 0
            while nodes[at][0] >= 0:
                at = nodes[at][2] if x[i, nodes[at][0]] <= nodes[at][1] else nodes[at][3]
            score[i] += nodes[at][4]
        made.append(nodes)
        mrr.append(standing())
    return made, mrr


@pytest.mark.parametrize("metric", ["ndcg", "mrr"])
def test_trees_are_those_of_a_plain_fit(rows, metric):
    how = Growth(leaves=6, depth=3, least_rows=40)
    args = {"trees": 3, "rate": 0.3, "how": how, "bins": 24}
    model = boosting.lambda_mart(rows.repartition(7, "c"), "q", "c", "truth", FEATURES, held_out="held", base=("l_discount", 1.0), metric=metric, **args)
    want, mrr = plain_fit(rows.toPandas(), FEATURES, base=("l_discount", 1.0), metric=metric, **args)
    assert [round(v, 9) for v in model.validation] == [round(v, 9) for v in mrr]
    got = learn.parse_trees(model.text)
    assert len(got) == int(np.argmax(mrr)) and len(got) >= 2
    for a, b in zip(got, want, strict=False):
        assert [n[:4] for n in a] == [tuple(n[:4]) for n in b]
        assert np.allclose([n[4] for n in a], [n[4] for n in b], atol=1e-9)


def test_blocks_fit_as_rows_do(rows, monkeypatch):
    """Small blocks, drawn queries and features, against the way of rows, which tables with a long query take."""
    args = {"trees": 2, "rate": 0.3, "how": Growth(leaves=4, depth=3), "bins": 16, "held_out": "held", "base": ("l_discount", 1.0), "row_share": 0.6, "column_share": 0.7}
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    kept, passes = boosting.gradients, []
    monkeypatch.setattr(boosting, "gradients", lambda *a: (passes.append(1), kept(*a))[1])
    blocks = boosting.lambda_mart(rows, "q", "c", "truth", FEATURES, **args)
    assert not passes  # no window over rows
    monkeypatch.setattr(boosting, "QUERY_ROWS", 2)
    whole = boosting.lambda_mart(rows, "q", "c", "truth", FEATURES, **args)
    assert passes and blocks.validation == pytest.approx(whole.validation, abs=1e-9)
    a, b = (np.array([n for t in learn.parse_trees(m.text) for n in t]) for m in (blocks, whole))
    assert len(a) and np.allclose(a, b, atol=1e-9)


def test_fit_ranks_better_than_its_base(spark):
    from quern.plans import reference

    got = reference.QUERIES["l3_lambda_mart"](spark, SF).toPandas()

    def mrr(name):
        place = got.groupby("q")[name].rank(ascending=False, method="average")
        return (1 / place[got.truth]).mean()

    assert mrr("score") > mrr("base") + 0.15


def test_permuted_truth_teaches_nothing(rows):
    """The control: one drawn truth an order, which a fit on the others' ranks no better than chance."""
    drawn = boosting.permuted_truth(rows, "q", "c", "truth", 1)
    assert drawn.where("truth").groupBy("q").count().where("count <> 1").count() == 0 and drawn.where("truth").count() == rows.where("truth").count()
    model = boosting.lambda_mart(drawn, "q", "c", "truth", FEATURES, trees=3, rate=0.3, how=Growth(leaves=4), bins=16)
    held = boosting.permuted_truth(rows, "q", "c", "truth", 2)  # other draws than those that it was fit on
    got = model.score(held).toPandas()
    value = 1 / got.groupby("q").score.rank(ascending=False, method="average")
    chance, found = value.groupby(got.q).mean(), value[got.truth].to_numpy()
    assert abs(found.mean() - chance.mean()) < 4 * found.std() / len(found) ** 0.5


def test_fit_edges(spark, rows):
    none = rows.where("false")
    assert boosting.lambda_mart(none, "q", "c", "truth", FEATURES, trees=2).text == ""
    odd = spark.createDataFrame([(1, 1, True, None, 1.0), (1, 2, False, float("nan"), 1.0), (2, 1, None, 3.0, 1.0), (2, 2, False, 4.0, None), (3, 1, True, 2.0, 0.0)], "q long, c long, t boolean, x double, w double")
    model = boosting.lambda_mart(odd, "q", "c", "t", ["x"], trees=2, how=Growth(least_rows=1), weight="w", row_share=0.9, column_share=0.5)
    assert model.score(odd).where("score IS NULL OR isnan(score)").count() == 0
    with pytest.raises(ValueError, match="metric"):
        boosting.lambda_mart(odd, "q", "c", "t", ["x"], metric="auc")


def test_bins_of_many_values(spark):
    df = spark.range(1000).select((F.col("id") % 500).cast("double").alias("x"))
    edges = boosting.bin_edges(df, "x", 10)
    assert len(edges) == 10 and edges[-1] == 499.0 and all(40 <= b - a <= 60 for a, b in zip(edges, edges[1:], strict=False))
    assert boosting.bin_edges(df, "x", 500) == [float(k) for k in range(500)]
    bins = df.limit(0).unionAll(spark.createDataFrame([(-5.0,), (None,), (float("nan"),), (49.0,), (10.0**9,)], "x double"))
    assert [r.b[0] for r in bins.select(boosting.binned(bins, {"x": [0.0, 49.0, 99.0]}).alias("b")).collect()] == [0, 0, 0, 1, 2]


def test_mixture_weights_sum_to_the_queries(spark):
    df = spark.createDataFrame([(k, "ab"[k % 3 == 0] if k % 5 else "c") for k in range(100)], "q long, g string")
    got = {r.g: r.weight for r in boosting.class_mix_weights(df, "g", {"a": 3.0, "b": 1.0}).collect()}
    n = {r.g: r["count"] for r in df.groupBy("g").count().collect()}
    assert got["c"] == 0 and math.isclose(got["a"] * n["a"], 75) and math.isclose(got["b"] * n["b"], 25)


def test_logit_of_queries_over_blocks(spark, monkeypatch):
    """Blocks of few rows, a query that holds a third of all rows, weights, nulls and several truths."""
    monkeypatch.setattr(learn, "LOGIT_ROWS", 50)
    rng = np.random.default_rng(3)
    q = np.where(rng.random(3000) < 0.34, 7, rng.integers(0, 200, 3000))
    pdf = pd.DataFrame({"q": q, "a": rng.normal(size=3000), "b": rng.normal(size=3000), "w": q % 4})
    score = pdf.a - 0.5 * pdf.b + rng.gumbel(size=3000)
    pdf["truth"] = score == score.groupby(pdf.q).transform("max")
    pdf.loc[pdf.q == 11, "truth"] = False
    got = learn.conditional_logit(spark.createDataFrame(pdf).repartition(5), "q", "truth", ["a", "b"], steps=40, weight="w")
    pdf = pdf[pdf.q != 11]
    x, code = pdf[["a", "b"]].to_numpy(), pd.factorize(pdf.q)[0]
    own, truth = pdf.w.to_numpy(), pdf.truth.to_numpy()
    w, m, v = np.zeros(2), np.zeros(2), np.zeros(2)
    for t in range(1, 41):
        e = np.exp(x @ w)
        g = -((truth - e / np.bincount(code, e)[code]) * own @ x) / own[truth].sum() + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose([got["a"], got["b"]], w, rtol=1e-6)


def test_logit_blocks_hold_distinct_rows_and_end_with_queries(spark, monkeypatch):
    """What a step reads: two bytes or fewer a candidate beside a block's distinct features, and few queries that come apart."""
    seen = []
    push = learn._logit_push
    monkeypatch.setattr(learn, "_logit_push", lambda blocks, w: (seen.append(blocks), push(blocks, w))[1])
    monkeypatch.setattr(learn, "LOGIT_ROWS", 1000)
    df = spark.range(40000, numPartitions=2).select((F.col("id") / 4).cast("long").alias("q"), (F.col("id") % 4 == 1).alias("t"), ((F.col("id") * 7 % 13) / 13).alias("a"), (F.col("id") % 3 * 400.0).alias("b"))
    fits = []
    for span in (600.0, 0.0):  # the same by the greatest score of each query
        monkeypatch.setattr(learn, "LOGIT_SPAN", span)
        fits.append(learn.conditional_logit(df, "q", "t", ["a", "b"], steps=4))
    assert np.allclose(list(fits[0].values()), list(fits[1].values()), rtol=1e-9)
    blocks = seen[0].withColumn("n", F.length("codes")).toPandas()
    assert blocks.n.sum() == 40000 and len(blocks) >= 4 and (blocks["values"].map(len) <= 39 * 16).all()
    assert blocks["first"].notna().sum() + blocks["last"].notna().sum() <= 2 * 8


def test_logit_of_nothing(spark):
    none = spark.createDataFrame([], "q long, t boolean, a double")
    assert learn.conditional_logit(none, "q", "t", ["a"], steps=2) == {"a": 0.0}
    wild = spark.createDataFrame([(1, True, 1e4), (1, False, -1e4), (2, False, 3e4), (2, True, 0.0), (3, False, 1.0), (None, True, 1.0)], "q long, t boolean, a double")
    assert np.isfinite(learn.conditional_logit(wild, "q", "t", ["a"], steps=5)["a"])
