"""The cluster hierarchy against a plain tree: all distances, edges one by one, the condensed tree from the top down."""

import math
import random

import pytest

from loomgraph.operators import hierarchy as H


def plain_tree(points, k):
    ids = sorted(points)
    d = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(points[a], points[b])))
    core = {a: sorted(d(a, b) for b in ids if b != a)[min(k, len(ids) - 1) - 1] for a in ids}
    edges = sorted((max(d(a, b), core[a], core[b]), a, b) for a in ids for b in ids if a < b)
    root, tree = {a: a for a in ids}, []
    for w, a, b in edges:
        x, y = a, b
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            tree.append((w, a, b))
    return tree


def plain_clusters(points, tree, m):
    """Label by id: a part is cut at its longest edge; parts of fewer than m points fall out, two large ones are new clusters."""
    links = {}

    def reach(start, edges):
        near = {}
        for _, a, b in edges:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        seen, todo = {start}, [start]
        while todo:
            for b in near.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    def grow(members, edges, birth):
        """(stability, best stability, labels chosen) of the cluster that begins as these points."""
        own, members, edges = 0.0, set(members), sorted(edges)
        while True:
            w, a, b = edges.pop()
            dense = 1 / max(w, H.LEAST)
            left, right = reach(a, edges), reach(b, edges)
            split = [(s, [e for e in edges if e[1] in s]) for s in (left, right)]
            large = [x for x in split if len(x[0]) >= m]
            own += sum(len(s) for s, _ in split if len(s) < m) * (dense - birth)
            if len(large) == 2:
                own += sum(len(s) for s, _ in large) * (dense - birth)
                parts = [grow(s, e, dense) for s, e in large]
                inner = sum(p[0] for p in parts)
                chosen = [members] if own >= inner else [c for p in parts for c in p[1]]
                return max(own, inner), chosen, [c for p in parts for c in p[1]]
            if not large:
                return own, [members], []
            edges = large[0][1]

    if len(points) < max(m, 2):
        return dict.fromkeys(points)
    _, chosen, within = grow(points, tree, 0.0)
    label = dict.fromkeys(points)
    for c in within:  # all points together are no cluster
        label.update(dict.fromkeys(c, min(c)))
    return label


def blobs(rng, n, centres, noise):
    out = []
    for _ in range(n):
        c, s = rng.choice(centres)
        out.append(tuple(rng.gauss(x, s) for x in c))
    return out + [tuple(rng.uniform(-5, 15) for _ in range(3)) for _ in range(noise)]


@pytest.mark.parametrize("seed, n, noise, batch", [(1, 150, 25, 1000), (2, 90, 10, 17)])
def test_against_a_plain_tree(spark, seed, n, noise, batch):
    rng = random.Random(seed)
    rows = blobs(rng, n, [((0, 0, 0), 0.3), ((0, 0, 2.5), 0.3), ((8, 8, 8), 0.8), ((9, 0, 3), 0.1)], noise)
    points = {k * 3 + 1: p for k, p in enumerate(rows)}
    df = spark.createDataFrame([(k, *p) for k, p in points.items()], "id long, x double, y double, z double")
    tree = plain_tree(points, 5)
    got = sorted((r.w, r.lo, r.hi) for r in H.spanning_tree(df, 5, rows=24, listed=6).collect())
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in tree] and all(abs(x[0] - y[0]) < 1e-9 for x, y in zip(got, tree))
    label = {r.id: r.cluster_id for r in H.cluster_hierarchy(df, rows=24, batch_edges=batch).collect()}
    assert label == plain_clusters(points, tree, 5) and len(set(label.values()) - {None}) >= 3


def test_few_and_equal_points(spark):
    schema = "id long, x double, y double, z double"
    assert H.cluster_hierarchy(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in H.cluster_hierarchy(spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 1.0, 1.0)], schema)).collect()] == [(1, None)]
    same = [(k, 0.0, 0.0, 0.0) for k in range(8)] + [(k, 5.0, 5.0, 5.0) for k in range(8, 15)]
    got = {r.id: r.cluster_id for r in H.cluster_hierarchy(spark.createDataFrame(same, schema), rows=4).collect()}
    assert got == {k: 0 if k < 8 else 8 for k in range(15)}


def test_nearest_lists_grow_with_the_points(spark):
    """Lists as by brute force, copies included; and blocks that are too far apart hand nothing on."""
    rng = random.Random(3)
    rows = blobs(rng, 300, [((10.0 * k, 0, 0), 0.2) for k in range(6)], 20) + [(1.0, 2.0, 3.0)] * 40
    points = {k * 2 + 1: p for k, p in enumerate(rows)}
    df = spark.createDataFrame([(k, *p) for k, p in points.items()], "id long, x double, y double, z double")
    found = sorted(tuple(r) for r in H.nearest(df, 4, rows=16).collect())
    got = {}
    for u, v, d2 in found:
        got.setdefault(u, []).append((d2, v))
    sq = lambda x: x * x
    d2 = lambda a, b: sq(a[0] - b[0]) + sq(a[1] - b[1]) + sq(a[2] - b[2])
    want = {a: sorted((d2(p, q), b) for b, q in points.items() if b != a)[:4] for a, p in points.items()}
    assert {a: sorted(m)[:4] for a, m in got.items()} == want
    assert len(found) < 4 * len(points) * 4  # four a point and block before, 23 blocks
