import numpy as np
from test_graph_ann import frame

from lumentab.llm import collisions as C


def brute(rows, cosine=0.95):
    good = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[n] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = {n: [m for m in good if m != n and len(good[m]) == len(good[n]) and good[n] @ good[m] >= cosine] for n in good}
    out = []
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        head = min(ids, default=None)
        out.append((i, len(links.get(n, ())), head, head is None or i == head))
    return sorted(out, key=repr)


def found(df, **kw):
    return sorted((tuple(r) for r in C.near_vectors(df, **kw).collect()), key=repr)


def test_links_over_blocks(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(500, 24))
    for i in range(200, 500):
        data[i] = data[i % 60] + rng.normal(0, 0.2, 24)
    data[400:450] = data[0] * 2
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(data)]
    want = brute(rows)
    assert sum(w[1] for w in want) > 1000
    assert found(frame(spark, rows)) == want
    assert found(frame(spark, rows), block=60) == want


def test_odd_rows(spark):
    rows = [(3, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.02]), (None, None)]
    assert found(frame(spark, rows)) == brute(rows)
    assert C.near_vectors(frame(spark, []).limit(0)).count() == 0


def test_count_is_calibrated():
    need = C.least_count(C.PROJECTIONS, C.WIDTH, C.MISS)
    assert 24 <= need < C.PROJECTIONS
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.9505 * x + np.sqrt(1 - 0.9505**2) * other
    pairs = {(int(a), int(b)) for p, q in C.block_links(x, y, 0.95) for a, b in zip(p, q)}
    assert sum((i, i) in pairs for i in range(4000)) >= 3990
