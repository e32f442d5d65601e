"""Every query of the record-identification operators against its SQL, on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern.plans import reference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    return str(v)


def rows(df, columns):
    return sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(reference.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = reference.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(reference.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-5)), (x, y)


def test_only_these_have_no_sql():
    """Each has a test of its own: g1 against all cuts in test_operators, l1 below, l3 in test_boosting."""
    assert set(reference.QUERIES) - set(reference.ORACLE_SQL) == {"g1_fragment_enumeration", "l1_conditional_logit", "l3_lambda_mart"}


def test_conditional_logit_by_brute_force(spark, duck):
    """The same 600 steps of Adam over plain arrays, orders weighing 1 to 3."""
    rows = duck.execute("SELECT l_orderkey AS q, l_quantity / 50 AS a, l_discount * 10 AS b FROM lineitem ORDER BY 1, 2 DESC, 3").df()
    truth = ~rows.q.duplicated().to_numpy()
    x, q = rows[["a", "b"]].to_numpy(), pd.factorize(rows.q)[0]
    own = 1 + rows.q.to_numpy() % 3
    total = own[truth].sum()
    w, m, v = np.zeros(2), np.zeros(2), np.zeros(2)
    for t in range(1, 601):
        e = np.exp(x @ w)
        p = e / np.bincount(q, e)[q]
        g = -((truth - p) * own @ x) / total + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    got = {r.feature: r.weight for r in reference.QUERIES["l1_conditional_logit"](spark, SF).collect()}
    assert math.isclose(got["a"], w[0], rel_tol=1e-6) and math.isclose(got["b"], w[1], rel_tol=1e-6)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
