"""Page rank in blocks and tiles against plain sums."""

import random

import pyarrow.parquet as pq
import pytest

from loomgraph.operators import graph as G
from loomgraph.staging import staged


def plain(edges, variant, rounds=20, damping=0.85):
    moves = [(u, v, c) for s, t, c in edges for u, v in ((s, t), (t, s))]
    nodes = sorted({u for u, _, _ in moves})
    weight, degree = (dict.fromkeys(nodes, 0.0) for _ in range(2))
    for u, _, c in moves:
        weight[u] += c
        degree[u] += 1
    rank = {u: 1 / len(nodes) for u in nodes}
    for _ in range(rounds):
        lost = sum(rank[u] for u in nodes if weight[u] <= 0) if variant == "standard" else 0.0
        nxt = dict.fromkeys(nodes, (1 - damping + damping * lost) / len(nodes))
        for u, v, c in moves:
            if weight[u] > 0:
                nxt[v] += damping * rank[u] * c / (weight[u] if variant == "standard" else degree[u])
        rank = nxt
    top = max(rank.values()) if variant == "standard" else 1.0
    return {u: r / top for u, r in rank.items()}


@pytest.mark.parametrize("variant, side", [("standard", 7), ("plain", None)])
def test_in_tiles(spark, monkeypatch, variant, side):
    """A hot node, loops, repeated edges, edges of no weight; tiles of several parts and rows."""
    monkeypatch.setattr(G, "PART_EDGES", 3)
    monkeypatch.setattr(G, "ROW_EDGES", 2)
    rng = random.Random(8)
    edges = [(rng.randint(1, 30) * 5, rng.randint(1, 30) * 5, round(rng.random(), 2)) for _ in range(80)]
    edges += [(5, k * 5, 0.5) for k in range(1, 31)] + [(10, 10, 1.0), (10, 10, 1.0), (1001, 1002, 0.0)]
    df = spark.createDataFrame(edges, "source long, target long, confidence double")
    got = {r.node: r.rank for r in G.page_rank(df, rounds=4, variant=variant, side=side).collect()}
    want = plain(edges, variant, 4)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_edges(spark):
    assert G.page_rank(spark.createDataFrame([], "source long, target long, confidence double")).collect() == []


def test_tiles_are_read_in_small_groups(spark, monkeypatch):
    """A tile's rows are small, a file's row groups have a few of them, in order, and the ranks are the same."""
    monkeypatch.setattr(G, "GROUP_ROWS", 2)
    made = []

    def spied(df, name):
        if name == "tile-names":
            made.extend(df.inputFiles())
        return staged(df, name)

    monkeypatch.setattr(G, "staged", spied)
    rng = random.Random(3)
    edges = [(rng.randint(1, 300), rng.randint(1, 300), 1.0) for _ in range(60_000)]
    df = spark.createDataFrame(edges, "source long, target long, confidence double")
    got = {r.node: r.rank for r in G.page_rank(df, rounds=2).collect()}
    want = plain(edges, "standard", 2)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    tables = [pq.ParquetFile(f.removeprefix("file:")) for f in made]
    groups = [t.read_row_group(g).to_pylist() for t in tables for g in range(t.num_row_groups)]
    rows = [r for g in groups for r in g]
    assert max(map(len, groups)) == 2 and max(len(r["i"]) // 4 for r in rows) < G.ROW_EDGES + 10_000
    assert [r["seq"] for r in rows] == list(range(len(rows))) and sum(len(r["i"]) // 4 for r in rows) == 120_000 and len(rows) > 4
