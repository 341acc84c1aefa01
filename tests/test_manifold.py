"""The neighbour layout against principal components, and its weights against plain numbers."""

import math

import numpy as np

from loomgraph.operators import layout, manifold


def clustered(seed=5, n=400, dims=40, kinds=40):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((kinds, dims))
    rows = []
    for i in range(n):
        v = centres[i % kinds] + 0.35 * rng.standard_normal(dims)
        rows.append((i, (v / np.linalg.norm(v)).tolist()))
    return rows


def test_neighbours_are_kept_better_than_by_components(spark):
    rows = clustered()
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    points = manifold.project_neighbours(df, rounds=6, rows=100)
    got = {r.id: (r.x, r.y, r.z) for r in points.collect()}
    assert set(got) == {i for i, _ in rows} and all(math.isfinite(c) for p in got.values() for c in p)
    plain = layout.project_pca(df)
    for k, more in ((9, 0.15), (15, 0.03)):  # kinds have ten vectors, so that nine neighbours can all be kept
        assert manifold.neighbour_preservation(df, points, k) > manifold.neighbour_preservation(df, plain, k) + more


def test_weights_by_hand(spark):
    rows = clustered(n=40, kinds=4)
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    d, k = 1 - x @ x.T, 6
    w = np.zeros((40, 40))
    for i in range(40):
        order = [j for j in np.argsort(d[i], kind="stable") if j != i][:k]
        lo, hi = 1e-9, 100.0
        for _ in range(100):
            s = (lo + hi) / 2
            lo, hi = (lo, s) if sum(math.exp(-max(d[i, j] - d[i, order[0]], 0) / s) for j in order) > math.log2(k) else (s, hi)
        for j in order:
            w[i, j] = math.exp(-max(d[i, j] - d[i, order[0]], 0) / s)
    both = w + w.T - w * w.T
    got = {(r.u, r.v): r.w for r in manifold.fuzzy_graph(df, k).collect()}
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(both > 1e-4))}
    assert all(abs(got[i, j] - both[i, j]) < 1e-6 for i, j in got)


def test_few_rows(spark):
    schema = "id long, embedding array<double>"
    assert manifold.project_neighbours(spark.createDataFrame([], schema)).collect() == []
    assert manifold.project_neighbours(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], schema)).collect() == []
    three = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None)], schema)
    assert {r.id for r in manifold.project_neighbours(three, rounds=2).collect()} == {1, 2, 3}


def test_no_round_takes_the_points_through_the_driver(spark, monkeypatch):
    plans, real = [], manifold.staged

    def noted(df, name):
        if name == "layout":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(manifold, "staged", noted)
    df = spark.createDataFrame(clustered(n=60, kinds=6), "id long, embedding array<double>")
    assert manifold.project_neighbours(df, k=4, rounds=2, rows=30).count() == 60
    rounds = plans[1:]
    assert len(rounds) == 2 and all(p.count("SortMergeJoin") == 5 and p.count("BroadcastHashJoin") <= 1 for p in rounds)  # one: the offsets of a numbering
