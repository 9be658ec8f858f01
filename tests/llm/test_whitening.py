"""Whitening against exact integers and a plain eigendecomposition, and the cases that must not break it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import whitening as W
from tracemill.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def quantised(vectors):
    return np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000


def test_query_against_exact_integers(spark, sf):
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = quantised([r["embedding"] for r in given])
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s).astype(object)
    v = np.array([[a / n**3 for a in row] for row in (y.T @ y).tolist()])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - s / n) @ axes[:, :8] / np.sqrt(values[:8])
    at = {r["vec_id"]: i for i, r in enumerate(given)}
    rows = QUERIES["op11_whitening"](spark, sf).collect()
    assert len(rows) == 8 * n and {(r["vec_id"], r["component"]) for r in rows} == {(i, c) for i in at for c in range(1, 9)}
    got = np.zeros_like(want)
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum(a * a for a in y[at[r["vec_id"]]].tolist())
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-12)
        assert r["identity_error"] < 1e-12
    got *= np.sign((got * want).sum(axis=0))
    assert np.abs(got - want).max() < 1e-10
    assert np.abs(got.T @ got / n - np.eye(8)).max() < 1e-12


def test_scatter_is_exact_beyond_doubles(spark):
    rng = random.Random(3)
    x = [[rng.randrange(-(1 << 40), 1 << 40) for _ in range(5)] for _ in range(3000)]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(x)], "vec_id long, x array<long>").repartition(3)
    c = W.centre(rows)
    y = np.array(x, object) * len(x) - np.array(x, object).sum(axis=0)
    assert W.scatter(rows, c) == (y.T @ y).tolist() and len(W.primes(2 * c.n * (c.n * (c.far + 1)) ** 2)) > 4
    d = np.array(x, np.int64) - c.mid
    assert W._deviations(d, c) == (y**2).sum(axis=1).tolist()


@pytest.mark.parametrize("n", [10, 10**6, 10**13])
def test_deviations_by_all_ways(n):
    rng = np.random.default_rng(1)
    c = W.Centre(n, np.array([5, 7, -3]), np.array([n // 2, 0, n - 1]), 900)
    d = rng.integers(-900, 900, (50, 3))
    assert W._deviations(d, c) == [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, c.rest, strict=True)) for row in d]


def test_remainders():
    moduli = W.primes(10**40)
    values = [0, 1, -1, 10**19, -(10**19), 3 * 10**39]
    assert all(p < W.TOP and all(p % q for q in range(2, 2100)) for p in moduli)
    assert W.remaindered([[v % p for v in values] for p in moduli], moduli) == values


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    kept = [[0.5, -0.25], [0.125, 2.0], [-1.0], [], [0.5, -0.25]]
    rows = [(1, kept[0]), (2, kept[1]), (3, kept[2]), (None, kept[3]), (1, kept[4]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1e300, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("x")).withColumn("x", F.lit(1))
    out = W.whitened(df).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in out) == sorted([(1, 1), (1, 2), (1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (0, 1), (0, 2)])
    x = quantised([[*r, *[0.0] * (2 - len(r))] for r in kept])
    w = np.array([[r["whitened"] for r in sorted(out, key=lambda r: r["component"]) if r["component"] == k] for k in (1, 2)])
    assert np.abs(w @ w.T / 5 - np.eye(2)).max() < 1e-12 and all(r["n"] == 5 and r["identity_error"] < 1e-12 for r in out)
    by = {(r["vec_id"], r["component"]): r["deviation"] for r in out}
    assert by[2, 1] == sum((5 * int(a) - int(b)) ** 2 for a, b in zip(x[1], x.sum(axis=0), strict=True))


def test_no_spread_and_nothing(spark):
    same = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], SCHEMA)
    rows = W.whitened(same).collect()
    assert len(rows) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in rows)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], SCHEMA)
    rows = W.whitened(line).collect()
    assert [r["whitened"] is None for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"]))] == [False, True, True] * 9 and rows[0]["identity_error"] < 1e-12
    assert W.whitened(same.limit(0)).count() == 0
    assert W.whitened(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    assert W.whitened(spark.createDataFrame([(1, [2.0])], SCHEMA)).count() == 1
    with pytest.raises(ValueError, match="dimensions"):
        W.whitened(spark.createDataFrame([(1, [0.0] * (W.WIDEST + 1))], SCHEMA))
