"""Neighbourhoods and rank over typed edges."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import bucketed, numbered, staged


def neighbourhood(seeds: DataFrame, engrams: DataFrame, edges: DataFrame, hops: int = 2, predicate: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (seed, node, hop) and edges (seed, edge) within ``hops`` of each seed (column seed), undirected.

    Edges are those that touch what is within hops - 1, so one between two nodes of the last hop isn't among them.
    Seeds that aren't concepts have no rows. All seeds expand together, a join a hop."""
    edges = edges if predicate is None else edges.where(F.col("predicate") == predicate)
    both = edges.select("id", F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges.select("id", F.col("target").alias("node"), F.col("source").alias("other")))
    known = seeds.join(engrams.select(F.col("id").alias("seed")), "seed", "left_semi").distinct()
    nodes = known.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier, found = nodes, None
    for hop in range(1, hops + 1):
        step = staged(frontier.select("seed", "node").join(both, "node").select("seed", "id", "other"), "hop")
        found = step.select("seed", F.col("id").alias("edge")) if found is None else found.unionByName(step.select("seed", F.col("id").alias("edge")))
        frontier = step.select("seed", F.col("other").alias("node")).distinct().join(nodes.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        nodes = staged(nodes.unionByName(frontier), "reached")
        frontier = nodes.where(F.col("hop") == hop)
    empty = known.select("seed", F.lit(None).cast(edges.schema["id"].dataType).alias("edge")).limit(0)
    return nodes, (empty if found is None else found.distinct())


#: Nodes in a block of ranks: one numpy array of 8 MB. Where nodes have few edges blocks grow, to four times as many at most.
SIDE = 1 << 20
#: Edges in a row of a tile (256 KB), in a part of a tile, and rows in a row group of their file: what a reader holds is rows of one group.
ROW_EDGES, PART_EDGES, GROUP_ROWS = 1 << 14, 1 << 24, 64
#: Parts that there are at least, if each has STEP_EDGES edges; also the edges that are multiplied at once.
LEAST_PARTS, STEP_EDGES = 16, 1 << 20


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (tile, i, j, share) as rows (tile, seq, i, j, share) of up to ROW_EDGES edges of one tile, numbered from 0 in each tile; the
    last three columns are the bytes of arrays."""
    held: dict[int, list] = {}
    size, rows = Counter(), Counter()

    def row(tile: int) -> pa.RecordBatch:
        parts = held.pop(tile)
        packed = [np.concatenate([p[k] for p in parts]).tobytes() for k in range(3)]
        columns = [pa.array([tile]), pa.array([rows[tile]], pa.int32()), *[pa.array([b], pa.binary()) for b in packed]]
        del size[tile]
        rows[tile] += 1
        return pa.RecordBatch.from_arrays(columns, names=["tile", "seq", "i", "j", "share"])

    for b in batches:
        tile, i, j, share = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "i", "j", "share"))
        order = np.argsort(tile, kind="stable")
        names, starts = np.unique(tile[order], return_index=True)
        for name, at in zip(names.tolist(), np.split(order, starts[1:])):
            held.setdefault(name, []).append((i[at].astype(np.int32), j[at].astype(np.int32), share[at]))
            size[name] += len(at)
            if size[name] >= ROW_EDGES:
                yield row(name)
        while sum(size.values()) >= 64 * ROW_EDGES:  # the largest goes first
            yield row(max(size, key=size.get))
    for name in list(held):
        yield row(name)


def _products(side: int):
    """Rows of tiles, the first of each with its block of ranks: for each block of the other end, what arrives there, summed as far as a
    task has it. Rows of one tile stand together, the first one first, as they were written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        most = max(1, 8 * SIDE // side)  # 64 MB
        out = lambda k: pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sums.pop(k).tobytes()], pa.binary())], names=["block", "sums"])
        known, ranks = None, None
        for b in batches:
            tile, to, first = b.column("tile").to_numpy(), b.column("to").to_numpy(), b.column("ranks").is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            array = lambda c, kind, lo, hi: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in b.column(c)[lo:hi]])  # noqa: B023, E731
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(tile)]):
                if first[lo]:
                    known, ranks = tile[lo], np.frombuffer(b.column("ranks")[lo].as_py(), np.float64)
                if known != tile[lo] or first[lo + 1 : hi].any():
                    raise ValueError("rows of a tile don't stand together")
                if (k := int(to[lo])) not in sums:
                    if len(sums) >= most:
                        yield out(min(sums))
                    sums[k] = np.zeros(side)
                step = max(1, STEP_EDGES // ROW_EDGES)
                for r in range(lo, hi, step):
                    i, j, share = (array(c, kind, r, min(r + step, hi)) for c, kind in (("i", np.int32), ("j", np.int32), ("share", np.float64)))
                    sums[k] += np.bincount(j, ranks[i] * share, side)
        for k in list(sums):
            yield out(k)

    return run


def _next_ranks(base: float, damping: float):
    def step(blocks: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        idle = np.frombuffer(blocks["dangling"].iloc[0], np.uint8)
        total = np.zeros(len(idle))
        for b in came["sums"]:
            total += np.frombuffer(b, np.float64)[: len(idle)]
        ranks = base + damping * total
        return pd.DataFrame({"block": blocks["block"].iloc[:1], "ranks": [ranks.tobytes()], "lost": [float(ranks[idle > 0].sum())], "top": [float(ranks.max())]})

    return step


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 20, variant: str = "standard", side: int | None = None) -> DataFrame:
    """(node, rank) over undirected edges (source, target, confidence); only ends of edges are nodes.

    'standard': shares by confidence, what dangling nodes hold is spread evenly, and the greatest rank is 1.
    'plain': a neighbour passes rank / degree times confidence, nothing is spread, no scaling. A loop counts at
    both its ends. Nodes are numbered in the order of a hash, so that edges spread over the blocks, and ranks are blocks of ``side`` of
    them (SIDE if not given) at most. The edges are stored once, in tiles by the blocks of both ends and, where a tile has very many, by
    part; a round sends a block of ranks to each tile and a block of sums from it, so what it moves grows with nodes times the root of
    the edges a node, not with the edges. A task reads its tile in rows of ROW_EDGES edges, so it holds some rows and two blocks."""
    edges = staged(edges.select("source", "target", "confidence"), "rank-edges")  # read four times
    both = edges.select(F.col("source").alias("u"), "confidence").unionByName(edges.select(F.col("target").alias("u"), "confidence"))
    ends = both.groupBy("u").agg(F.sum("confidence").cast("double").alias("weight"), F.count(F.lit(1)).alias("degree"))
    nodes = staged(numbered(ends, F.xxhash64("u"), F.col("u")).withColumn("number", F.col("rank") - 1).drop("rank"), "nodes")
    n, n_edges = nodes.count(), 2 * edges.count()
    if not n:
        return nodes.select(F.col("u").alias("node"), F.lit(0.0).alias("rank"))
    side = min(side or max(SIDE, min(4 * SIDE, n * n // max(n_edges, 1))), n)
    n_blocks = -(-n // side)
    side = -(-n // n_blocks)

    end = lambda c, k: nodes.select(F.col("u").alias(c), F.col("number").alias(f"n{k}"), F.when(F.col("weight") > 0, F.col("weight" if variant == "standard" else "degree")).alias(f"w{k}"))
    ended = edges.join(end("source", 1), "source").join(end("target", 2), "target").withColumn("c", F.col("confidence").cast("double"))
    way = lambda a, b: F.struct(F.col(f"n{a}").alias("u"), F.col(f"n{b}").alias("v"), (F.col("c") / F.col(f"w{a}")).alias("share"))
    moves = ended.select(F.explode(F.array(way(1, 2), way(2, 1))).alias("m")).select("m.*").where("share is not null")
    block = lambda c: F.floor(F.col(c) / side)
    most = max(-(-n_edges // PART_EDGES), min(LEAST_PARTS, n_edges // STEP_EDGES))  # parts that there are to be
    part = F.pmod(F.xxhash64("u", "v"), F.lit(max(1, -(-most // (n_blocks * n_blocks)))))
    tile = ((block("u") * n_blocks + block("v")) * (1 << 20) + part).cast("long")
    cut = moves.select(tile.alias("tile"), (F.col("u") % side).cast("int").alias("i"), (F.col("v") % side).cast("int").alias("j"), "share")
    dealt = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n_blocks * n_blocks + most, 1000))
    rows = cut.repartition(dealt, "tile").mapInArrow(_tiles, "tile long, seq int, i binary, j binary, share binary")

    fields = "block long, ranks binary, lost double, top double"
    first = lambda df: pd.DataFrame({"block": df["block"].iloc[:1], "dangling": [df.sort_values("number")["idle"].to_numpy(np.uint8).tobytes()]})
    idle = nodes.select(block("number").cast("long").alias("block"), "number", F.coalesce(F.col("weight") <= 0, F.lit(False)).alias("idle"))
    blocks = staged(idle.groupBy("block").applyInPandas(first, "block long, dangling binary"), "blocks")
    even = lambda df: _next_ranks(1.0 / n, 0.0)(df, pd.DataFrame({"sums": []}))
    rank = staged(blocks.groupBy("block").applyInPandas(even, fields), "rank")
    with bucketed(rows, ["tile"], "tiles", dealt=dealt, order=["tile", "seq"], group_rows=GROUP_ROWS) as stored:
        tiles = staged(stored.select("tile").distinct().withColumn("block", F.floor(F.floor(F.col("tile") / (1 << 20)) / n_blocks)), "tile-names")
        for _ in range(rounds):
            lost = rank.agg(F.sum("lost")).first()[0] if variant == "standard" else 0.0
            sent = rank.join(tiles, "block").select("tile", "ranks")
            met = stored.join(sent.hint("shuffle_hash"), "tile").select("tile", (F.floor(F.col("tile") / (1 << 20)) % n_blocks).alias("to"), "i", "j", "share", F.when(F.col("seq") == 0, F.col("ranks")).alias("ranks"))
            came = met.mapInArrow(_products(side), "block long, sums binary")
            step = _next_ranks((1 - damping) / n + damping * lost / n, damping)
            rank = staged(blocks.groupBy("block").cogroup(came.groupBy("block")).applyInPandas(step, fields), "rank")
    top = rank.agg(F.max("top")).first()[0] if variant == "standard" else 1.0

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                values = np.frombuffer(b.column("ranks")[r].as_buffer(), np.float64)
                numbers = b.column("block")[r].as_py() * side + np.arange(len(values))
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(values / (top if top > 0 else 1.0))], names=["number", "rank"])

    return rank.mapInArrow(each, "number long, rank double").join(nodes.select("number", F.col("u").alias("node")), "number").select("node", "rank")
