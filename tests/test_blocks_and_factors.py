"""Block products, fold moments and orthogonal factors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentab.operators import factors as Fa
from lumentab.operators.blocks import multiply_blocks, to_blocks


def cells(spark, x, known=None):
    rows = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(x) if known is None or known[i, j]]
    return spark.createDataFrame(rows, "i long, j long, v double")


@pytest.mark.parametrize("shape, side", [((5, 40, 3), 4), ((33, 7, 20), 8), ((2, 2, 2), 16)])
def test_block_product(spark, shape, side):
    rng = np.random.default_rng(sum(shape))
    n, k, m = shape
    a, b = rng.normal(size=(n, k)), rng.normal(size=(k, m))
    ka, kb = rng.random((n, k)) < 0.4, rng.random((k, m)) < 0.4
    got = {(r["i"], r["j"]): r["v"] for r in multiply_blocks(cells(spark, a, ka), cells(spark, b, kb), side).collect()}
    fed = ka.astype(int) @ kb.astype(int) > 0
    want = (a * ka) @ (b * kb)
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(fed))}
    assert all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_blocks_are_shuffled_instead_of_cells(spark):
    a = cells(spark, np.ones((32, 32)))
    assert to_blocks(a, 8).count() == 16
    empty = a.filter("i < 0")
    assert multiply_blocks(empty, a, 8).count() == 0 and multiply_blocks(a, empty, 8).count() == 0


def folds_by_hand(x, y, k, penalty):
    size = len(y) // k
    x, y, out = x[: size * k], y[: size * k], {}
    for f in range(k):
        valid = np.arange(len(y)) // size == f
        xt, yt = x[~valid], y[~valid]
        c = xt - xt.mean(axis=0)
        w = np.linalg.solve(c.T @ c / len(c) + penalty * np.eye(x.shape[1]), c.T @ (yt - yt.mean()) / len(c))
        gap = np.log(np.maximum(x @ w + yt.mean() - w @ xt.mean(axis=0), 1)) - np.log(y)
        out[f, "train"], out[f, "valid"] = np.sqrt((gap[~valid] ** 2).mean()), np.sqrt((gap[valid] ** 2).mean())
    return out


@pytest.mark.parametrize("penalty", [0.0, 0.7])
def test_folds_from_moments(spark, penalty):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(103, 3)) * [1, 5, 0.2] + [1000, 0, -4]
    y = np.exp(rng.normal(size=103)) * 10 + x @ [0.1, 2, 3]
    y = y - y.min() + 5
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, t double").repartition(5)
    got = {(r["fold"], r["part"]): r["log_rmse"] for r in Fa.k_fold_log_rmse(df, "id", "t", ["a", "b", "c"], 5, penalty).collect()}
    want = folds_by_hand(x, y, 5, penalty)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_folds_scan_the_rows_once(spark):
    df = spark.range(60).select("id", F.rand(1).alias("a"), (F.rand(2) + 1).alias("t"))
    plan = Fa.k_fold_log_rmse(df, "id", "t", ["a"], 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan and "Union" not in plan


def test_moments_add_and_subtract():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 3)) + 1e6, rng.normal(size=(12, 3)) + 1e6
    of = lambda z: Fa.Moments(float(len(z)), z.mean(axis=0), (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)))
    both = of(x) + of(y)
    whole = of(np.concatenate([x, y]))
    assert np.allclose(both.products, whole.products, atol=1e-6) and np.allclose((whole - of(y)).products, of(x).products, atol=1e-6)


def test_high_degrees_by_orthogonal_factors(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, 400)
    y = np.sin(3 * x) + 0.05 * rng.normal(size=400)
    powers = np.stack([x**i for i in range(20)], axis=1)
    df = spark.createDataFrame([("train" if i % 3 else "test", p.tolist(), float(t)) for i, (p, t) in enumerate(zip(powers, y))], "part string, poly array<double>, t double").repartition(7)
    got = {r["degree"]: (r["train_mse"], r["test_mse"]) for r in Fa.nested_fits(df, "t", [1, 3, 12, 19]).collect()}
    train = np.arange(400) % 3 > 0
    for d, (a, b) in got.items():
        w = np.linalg.lstsq(powers[train, : d + 1], y[train], rcond=None)[0]
        e = (powers[:, : d + 1] @ w - y) ** 2
        assert abs(a - e[train].mean()) < 1e-9 and abs(b - e[~train].mean()) < 1e-7


def test_ridge_sweep(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -3.0] + 4 + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, y double").repartition(3)
    for r in Fa.ridge_sweep(df, "y", ["a", "b"], [0.0, 0.5, 20.0]).collect():
        c = x - x.mean(axis=0)
        w = np.linalg.solve(c.T @ c / 200 + r["penalty"] * np.eye(2), c.T @ (y - y.mean()) / 200)
        bias = y.mean() - w @ x.mean(axis=0)
        assert abs(r["weight_norm"] - np.linalg.norm(w)) < 1e-9 and abs(r["intercept"] - bias) < 1e-9
        assert abs(r["mse"] - ((x @ w + bias - y) ** 2).mean()) < 1e-9
    assert Fa.ridge_sweep(df.filter("a > 100"), "y", ["a", "b"], [1.0]).first()["weight_norm"] == 0
