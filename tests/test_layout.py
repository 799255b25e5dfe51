"""The map's directions against a dense decomposition."""

import numpy as np

from inkwell.operators.layout import layout, strongest


def dense(edges, names):
    at = {n: i for i, n in enumerate(names)}
    w = np.eye(len(names))
    for a, b, v in edges:
        w[at[a], at[b]] += v
        w[at[b], at[a]] += v
    return w


def test_directions_equal_dense_ones(spark):
    r = np.random.default_rng(31)
    names = [f"n{i:02d}" for i in range(24)]
    edges = [(names[i], names[j], float(r.random() + (4.0 if i < 8 and j < 8 else 2.5 if i >= 16 and j >= 16 else 0.0))) for i in range(24) for j in range(i + 1, 24) if r.random() < 0.6]
    names = sorted({x for e in edges for x in e[:2]})
    w = dense(edges, names)
    u, s, _ = np.linalg.svd(w)
    found, values = strongest(spark.createDataFrame(edges, "a string, b string, weight double"), 2)
    rows = {x.node: x.x for x in found.collect()}
    got = np.array([rows[n] for n in names])
    assert np.allclose(np.abs(values), s[:2], rtol=1e-6)
    for k in (0, 1):
        assert abs(abs(got[:, k] @ u[:, k]) - 1) < 1e-5
    placed = {x.node: (x.x, x.y) for x in layout(spark.createDataFrame(edges, "a string, b string, weight double")).collect()}
    for k in (0, 1):
        v = u[:, k] * (1 if u[:, k].max() >= -u[:, k].min() else -1)
        assert np.allclose([placed[n][k] for n in names], (v - v.min()) / (v.max() - v.min()), atol=1e-4)


def test_small_graphs(spark):
    kind = "a string, b string, weight double"
    assert layout(spark.createDataFrame([], kind)).count() == 0
    two = {x.node: (round(x.x, 6), round(x.y, 6)) for x in layout(spark.createDataFrame([("p", "q", 0.5)], kind)).collect()}
    assert set(two) == {"p", "q"} and all(0 <= v <= 1 for xy in two.values() for v in xy)
