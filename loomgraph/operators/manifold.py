"""A layout that keeps neighbours together: a fuzzy graph of nearest neighbours, pulled into shape round by round.

Each vector's nearest neighbours by cosine get weights that fall from one at the nearest, at a rate of its own; both ends' views of
an edge are joined into one weight. From principal components on, neighbours pull each other by their weight and points
picked at random push each other away, along the gradients of the fuzzy graph's cross-entropy, with steps that shrink.

A round deals points to blocks of those that lie close together at the moment. Each gets its neighbours' places and its random
others' by joins on the point, and a block takes some steps by itself: neighbours in the block move with it, others stand still until
the next round. So a task holds a block, its edges and nothing else, and what is exchanged grows with the edges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import numbered, split_join, staged
from .hierarchy import blocked
from .layout import project_pca
from .vectors import knn

#: The curve 1 / (1 + A d^2B) that falls off beyond a least distance of 0.1; fixed values.
A, B = 1.577, 0.895
#: The greatest move along an axis that one pull or push asks for.
CLIP = 4.0


def rates(d: Column, k: int) -> Column:
    """The rate sigma at which weights exp(-(d - nearest) / sigma) of sorted distances add up to log2(k); by halving."""

    @F.pandas_udf("double")
    def solve(lists: pd.Series) -> pd.Series:
        x = np.full((len(lists), max(map(len, lists), default=1)), np.inf)
        for i, row in enumerate(lists):
            x[i, : len(row)] = row
        x = np.maximum(x - x[:, :1], 0.0)
        lo, hi = np.zeros(len(x)), np.full(len(x), np.inf)
        s = np.ones(len(x))
        for _ in range(64):
            over = np.exp(-x / s[:, None]).sum(axis=1) > math.log2(max(k, 2))
            hi, lo = np.where(over, s, hi), np.where(over, lo, s)
            s = np.where(np.isinf(hi), s * 2, (lo + hi) / 2)
            s = np.clip(s, 1e-9, 1e9)
        return pd.Series(s)

    return solve(d)


def fuzzy_graph(vectors: DataFrame, k: int = 15) -> DataFrame:
    """(u, v, w), each edge once in each direction: the weights of the nearest-neighbour graph of vectors (id, embedding),
    w + w' - w w' of both ends' views."""
    unit = vectors.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = staged(unit.select("id", F.transform("v", lambda x: x / F.when(norm > 0, norm).otherwise(1.0)).alias("embedding")), "unit")
    near = knn(unit.withColumnRenamed("id", "u"), unit, k + 1, "u").where("u <> id").where(F.col("rank") <= k + 1)
    listed = near.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.greatest(F.col("d2") / 2, F.lit(0.0)).alias("d"), "id"))), 1, k).alias("m"))
    rated = listed.withColumn("sigma", rates(F.col("m.d"), k)).withColumn("least", F.col("m")[0]["d"])
    seen = rated.select("u", "sigma", "least", F.explode("m").alias("e")).select("u", F.col("e.id").alias("v"), F.exp(-F.greatest(F.col("e.d") - F.col("least"), F.lit(0.0)) / F.col("sigma")).alias("w"))
    both = seen.unionByName(seen.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    one = both.groupBy("u", "v").agg(F.max("w").alias("a"), F.min("w").alias("b"), F.count(F.lit(1)).alias("n"))
    return one.select("u", "v", F.when(F.col("n") == 1, F.col("a")).otherwise(F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w")).where("w > 1e-4")


def _stepper(steps: int, rate: float, fall: float, others: int):
    """Some gradient steps of a block, from ``rate`` down by ``fall`` a step."""

    def move(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].to_numpy()
        at = rows[["x", "y", "z"]].to_numpy(float).copy()
        place = {i: k for k, i in enumerate(ids.tolist())}
        own, own_v, w_in, out, out_at, w_out = [], [], [], [], [], []
        for k, m in enumerate(rows["near"]):
            for e in m:
                if e["v"] in place:
                    own.append(k)
                    own_v.append(place[e["v"]])
                    w_in.append(e["w"])
                else:
                    out.append(k)
                    out_at.append((e["x"], e["y"], e["z"]))
                    w_out.append(e["w"])
        own, own_v, out = np.array(own, int), np.array(own_v, int), np.array(out, int)
        w = np.concatenate((w_in, w_out)).astype(float)
        still = np.array(out_at, float).reshape(-1, 3)
        one = np.concatenate((own, out)).astype(int)
        degree = np.bincount(one, w, len(ids)) if len(one) else np.zeros(len(ids))
        far_of = np.array([k for k, m in enumerate(rows["far"]) for _ in m], int)
        far_at = np.array([(e["x"], e["y"], e["z"]) for m in rows["far"] for e in m], float).reshape(-1, 3)
        n_far = np.maximum(np.bincount(far_of, minlength=len(ids)), 1) if len(far_of) else np.ones(len(ids))
        for s in range(steps):
            moved = np.zeros_like(at)
            if len(one):
                d = at[one] - np.concatenate((at[own_v], still))
                d2 = (d * d).sum(axis=1)
                pull = -2 * A * B * np.power(d2, B - 1, where=d2 > 0, out=np.zeros_like(d2)) / (1 + A * np.power(d2, B))
                np.add.at(moved, one, np.clip(pull[:, None] * d, -CLIP, CLIP) * w[:, None])
            if len(far_of):
                d = at[far_of] - far_at
                d2 = (d * d).sum(axis=1)
                push = 2 * B / ((0.001 + d2) * (1 + A * np.power(d2, B)))
                np.add.at(moved, far_of, np.clip(push[:, None] * d, -CLIP, CLIP) * (others * degree / n_far)[far_of][:, None])
            at += (rate - s * fall) * moved
        return pd.DataFrame({"id": ids, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})

    return move


def project_neighbours(vectors: DataFrame, k: int = 15, rounds: int = 12, steps: int = 12, others: int = 5, sampled: int = 12, rows: int = 2048, seed: int = 42) -> DataFrame:
    """(id, x, y, z) of vectors (id, embedding): the layout of their neighbour graph. Nothing under two rows; null vectors
    are left out. The same table and seed give the same layout, to rounding.

    rounds times steps gradient steps are taken; each point sees ``sampled`` random others a round, weighted as if it saw
    ``others`` for each unit of its weights."""
    rows_of = vectors.where("embedding is not null")
    start = project_pca(rows_of)
    n = start.count()
    if n < 2:
        return start.limit(0)
    edges = staged(fuzzy_graph(rows_of, min(k, n - 1)), "fuzzy")
    most = start.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in "xyz"]))).first()[0] or 1.0
    jitter = lambda c, i: F.col(c) * (10.0 / most) + (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3
    at = numbered(start.select("id", *[jitter(c, i).alias(c) for i, c in enumerate("xyz")]), F.col("id")).withColumn("number", F.col("rank") - 1).drop("rank")
    at = staged(at, "layout")
    kind = vectors.schema["id"].dataType.simpleString()
    every = rounds * steps
    for r in range(rounds):
        # merge joins whatever the size: a broadcast would take all points through the driver, round after round
        point = lambda c: at.select(F.col("id").alias(c), *"xyz").hint("merge")  # noqa: B023, E731
        near = split_join(edges, point("v"), ["v"]).groupBy("u").agg(F.sort_array(F.collect_list(F.struct("v", "w", *"xyz"))).alias("near"))
        picks = at.select(F.col("id").alias("u"), F.posexplode(F.sequence(F.lit(1), F.lit(sampled))).alias("place", "pick"))
        picks = picks.withColumn("number", F.pmod(F.xxhash64("u", "pick", F.lit(seed), F.lit(r)), F.lit(n)))
        far = picks.join(at.select("number", F.col("id").alias("other"), *"xyz").hint("merge"), "number").where("other <> u").groupBy("u").agg(F.sort_array(F.collect_list(F.struct("place", *"xyz"))).alias("far"))
        laid = blocked(at, rows).join(near.withColumnRenamed("u", "id").hint("merge"), "id", "left").join(far.withColumnRenamed("u", "id").hint("merge"), "id", "left")
        laid = laid.withColumn("near", F.coalesce("near", F.expr(f"cast(array() as array<struct<v:{kind},w:double,x:double,y:double,z:double>>)"))).withColumn("far", F.coalesce("far", F.expr("cast(array() as array<struct<place:int,x:double,y:double,z:double>>)")))
        move = _stepper(steps, 1.0 - r * steps / every, 1.0 / every, others)
        moved = laid.select("block", "id", *"xyz", "near", "far").groupBy("block").applyInPandas(move_sorted(move), f"id {kind}, x double, y double, z double")
        at = staged(moved.join(at.select("id", "number").hint("merge"), "id"), "layout")
    return at.select("id", *"xyz")


def move_sorted(move):
    """A block's rows in the order of their ids, however they came."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return move(rows.drop(columns="block").sort_values("id", ignore_index=True))

    return run


def neighbour_preservation(vectors: DataFrame, points: DataFrame, k: int = 15) -> float:
    """The share of points' k nearest by vector that are among their k nearest on the map."""
    flat = points.select("id", F.array(*"xyz").alias("embedding"))
    near = lambda df: knn(df.select(F.col("id").alias("u"), "embedding"), df, k + 1, "u").where("u <> id").select("u", "id")
    mine, theirs = near(vectors.join(points.select("id"), "id", "left_semi").select("id", "embedding")), near(flat)
    n = mine.agg(F.count(F.lit(1)).alias("n")).first().n
    return mine.join(theirs, ["u", "id"]).count() / n if n else 1.0
