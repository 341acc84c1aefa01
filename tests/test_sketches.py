"""Pairs found by banded signs against all pairs: recall at the threshold, nothing false, hot buckets whole."""

import math
import random

import numpy as np
import pytest

from loomgraph.operators import vectors as K


def unit(v):
    return (v / np.linalg.norm(v)).tolist()


@pytest.mark.parametrize("least", [0.9, 0.7])
def test_recall_at_the_threshold(spark, least):
    """300 pairs whose cosines are just above the threshold, among strangers; the recall asked for is met."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        a = np.array(unit(rng.standard_normal(48)))
        o = rng.standard_normal(48)
        o = np.array(unit(o - a * (a @ o)))
        c = least + 0.01
        rows += [(2 * k, a.tolist()), (2 * k + 1, unit(c * a + math.sqrt(1 - c * c) * o))]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5)
    exact = {(r.a, r.b) for r in K.threshold_pairs(df, least).collect()}
    got = [(r.a, r.b, r.cosine) for r in K.sketch_pairs(df, least, recall=0.95).collect()]
    found = {(a, b) for a, b, _ in got}
    assert len(got) == len(found) and found <= exact and len(found) >= 0.9 * len(exact) and len(exact) >= 300
    assert all(c >= least for *_, c in got)


def test_a_hot_bucket_is_whole(spark):
    """Equal vectors share every band: each pair of them once, whatever the tiles."""
    rng = random.Random(1)
    hot = unit(np.array([rng.gauss(0, 1) for _ in range(8)]))
    rows = [(k, hot) for k in range(60)] + [(100 + k, unit(np.array([rng.gauss(0, 1) for _ in range(8)]))) for k in range(40)] + [(500, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = [(r.a, r.b) for r in K.sketch_pairs(df, 0.999, tile=7).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2
    assert K.sketch_pairs(df.limit(0), 0.9).collect() == []


def test_bands():
    for least, recall, width in ((0.9, 0.95, 8), (0.5, 0.9, 4), (0.99, 0.999, 16)):
        b, p = K.bands_for(least, recall, width), 1 - math.acos(least) / math.pi
        assert 1 - (1 - p**width) ** b >= recall > 1 - (1 - p**width) ** (b - 1)
    assert K.bands_for(1.0, 0.9, 8) == 1


def test_blocks_meet_in_cells(spark, monkeypatch):
    """More blocks than a cell has: every pair of blocks once, nearest neighbours and pairs as by hand."""
    rng = np.random.default_rng(9)
    x = np.array([unit(v) for v in rng.standard_normal((150, 6))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    monkeypatch.setattr(K, "CELL", 2)
    c = x @ x.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if c[i, j] >= 0.8}
    assert sorted((r.a, r.b) for r in K.threshold_pairs(df, 0.8, rows=20).collect()) == sorted(want)
    queries = df.where("id % 3 = 0").withColumnRenamed("id", "cand")
    got = {(r.cand, r.id, r["rank"]) for r in K.knn(queries, df, 4, rows=9).collect()}
    assert got == {(i, int(j), k + 1) for i in range(0, 150, 3) for k, j in enumerate(np.lexsort((np.arange(150), ((x - x[i]) ** 2).sum(1)))[:4])}


def test_a_low_threshold_needs_few_bands(spark):
    """At cosine 0.3 in 100,000 vectors, bands of 11 signs would be some 870 and move each vector as often."""
    n = 100_000
    width = K.band_width(n, 0.3, 0.95, K.BLOCK)
    assert K.bands_for(0.3, 0.95, width) <= 40 < 500 < K.bands_for(0.3, 0.95, math.ceil(math.log2(n / 64)))
    assert K.band_width(10_000_000, 0.95, 0.95, K.BLOCK) > 8
    rng = np.random.default_rng(2)
    rows = [(k, unit(v)) for k, v in enumerate(rng.standard_normal((400, 32)))] + [(1000 + k, unit(np.ones(32))) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    exact = {(r.a, r.b) for r in K.threshold_pairs(df, 0.3).collect()}
    got = [(r.a, r.b) for r in K.sketch_pairs(df, 0.3, tile=9).collect()]
    assert len(got) == len(set(got)) and set(got) <= exact and len(got) >= 0.95 * len(exact)
