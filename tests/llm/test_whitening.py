import numpy as np
import pytest

from lumentab.llm import whitening as W

SMALL = "/root/testdata/sf0.001"
ROWS = "vec_id bigint, embedding array<float>, label int, x double, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 3) for i, v in rows], ROWS)


def plain(rows, components=16):
    """The same numbers by a library's eigenvectors, in one place."""
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return x, n, s, e, q, np.trace(v)


def check(got, rows, components=16):
    x, n, s, e, q, trace = plain(rows)
    live = [k for k in range(min(components, len(e))) if e[k] > 1e-9 * e[0]]
    assert len(got) == len(rows) * len(live)
    signs = {}
    for r in got:
        k = r["component"] - 1
        own = x[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, s))
        assert abs(r["explained"] - e[k] / trace) <= 1e-9 * e[k] / trace and 0 <= r["identity_error"] <= 1e-9
        want = float((own - s / n) @ q[:, k]) / e[k] ** 0.5
        if k not in signs and abs(want) > 1e-3:
            signs[k] = np.sign(want * r["whitened"])
        assert abs(r["whitened"] - signs.get(k, 1) * want) < 1e-6


def test_whole_table(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = W.whiten(vectors).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    check(got, rows)


def test_repeated_rows_and_few_dimensions(spark):
    rng = np.random.default_rng(1)
    base = [[float(a) for a in v] for v in rng.normal(size=(40, 3)) * [5, 1, 0.3]]
    rows = [(i, base[0] if i % 3 == 0 else base[i % 40]) for i in range(300)]
    check(W.whiten(table(spark, rows)).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(30, 4)))]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, []), (105, [1.0])]
    got = W.whiten(table(spark, good + odd)).collect()
    check(got, good)
    assert W.whiten(table(spark, [])).count() == 0
    assert W.whiten(table(spark, odd[:4])).count() == 0
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    null_id = W.whiten(table(spark, good + [(None, good[0][1])])).filter("vec_id is null or vec_id = 0").collect()
    assert len(null_id) == 8 and len({r["whitened"] for r in null_id}) == 4
    big = W.whiten(table(spark, good + [(7, [1e30, 0.0, 0.0, 0.0])])).collect()
    assert all(np.isfinite(r["whitened"]) for r in big) and {r["deviation"] is None for r in big if r["vec_id"] == 7} <= {True, False}


def test_directions_without_spread(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(2 * round(a * 64) / 64), 1.0]) for i, a in enumerate(np.round(rng.normal(size=50) * 64) / 64)]
    got = W.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1}
    check(got, rows)


@pytest.mark.parametrize("seed", range(6))
def test_counts_equal_the_spectrum(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 30))
    a = rng.normal(size=(n, n)) * rng.choice([0, 1], size=(n, n), p=[0.4, 0.6])
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    for shift in [0.0, *rng.normal(size=8) * 3]:
        if np.abs(values - shift).min() > 1e-9:
            assert W.count_above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize("values", [[5, 5, 5, 1], [1, 1 - 1e-13, 1e-3, 1e-3], [1e6, 1, 1e-6, 1e-6], [3, 2, 0, 0], [2.0] * 6, [1 + 1e-7, 1, 1 - 1e-7, 0.5]])
def test_close_and_equal_values(values):
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    e, v = W.spectrum(a)
    want = np.array([x for x in values if x > 0], float)
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-9, atol=1e-9 * want[0])
    assert np.abs(v.T @ v - np.eye(len(want))).max() < 1e-12
    assert np.abs(a @ v - v * e).max() < 1e-11 * want[0]


def test_counts_certify_the_numbering(monkeypatch):
    """Without true counts the wrong eigenvalue would be taken: the counts carry the method."""
    a = np.diag([4.0, 3.0, 2.0, 1.0])
    assert np.allclose(W.spectrum(a, 2)[0], [4, 3])
    right = W.count_above
    monkeypatch.setattr(W, "count_above", lambda m, s: max(0, right(m, s) - 1))
    assert not np.allclose(W.spectrum(a, 2)[0], [4, 3])
