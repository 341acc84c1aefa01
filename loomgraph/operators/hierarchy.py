"""Clusters over all densities at once: a spanning tree of mutual reachability, its condensed tree, and the clusters that last.

The distance of two points is the greatest of their own distance and of the distances that each has to its ``min_size``-th
neighbour. The tree that spans all points by the least of these is grown in Borůvka's rounds: each round joins every component
to another by its least edge. A point's nearest neighbours, found once among blocks that lie close, give most of these; where they
can't rule out a nearer point beyond, blocks of points that lie close together are compared, and block pairs that are too far apart or all in
one component are not. Edges of equal weight go by their ends' ids, so there is one tree.

The tree's edges, from the shortest on, are folded into clusters in batches of a bounded number of edges. Within a batch the
trees of the forest are independent groups; between batches a component is one row: its size, its cluster and that cluster's
stability, or the few points of one that is too small to be a cluster. So no group holds more than a batch, however many
points there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..staging import numbered, staged
from .components import components
from .vectors import BLOCK

#: Distances below count as this: equal points would be infinitely dense.
LEAST = 1e-12


def blocked(points: DataFrame, rows: int) -> DataFrame:
    """points with block: ``rows`` of them that lie close together, by a curve through a grid of 1024 cells a side."""
    box = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)])
    cell = lambda c: F.least(F.floor((F.col(c) - F.col(f"min_{c}")) / F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(1e-300)) * 1024), F.lit(1023)).cast("long")
    spread = lambda v: sum((F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), 3 * b) for b in range(1, 10)), v.bitwiseAND(F.lit(1)))
    curve = sum((F.shiftleft(spread(cell(c)), k) for k, c in ((1, "y"), (2, "z"))), spread(cell("x")))
    placed = points.join(F.broadcast(box)).select(*points.columns, curve.alias("curve"))  # one row
    return numbered(placed, F.col("curve"), F.col("id")).withColumn("block", F.floor((F.col("rank") - 1) / rows).cast("int")).drop("curve", "rank")


def _box() -> list[Column]:
    return [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("l", F.min), ("h", F.max))]


def _boxes(blocks: DataFrame, mark: str) -> DataFrame:
    """blocks without their points, columns named after mark."""
    return blocks.select(*[F.col(c).alias(f"{mark}_{c}") for c in blocks.columns if c != "m"])


def _gap() -> Column:
    """The square of the distance of the boxes a and b of a pair."""
    one = lambda c: F.pow(F.greatest(F.col(f"a_l{c}") - F.col(f"b_h{c}"), F.col(f"b_l{c}") - F.col(f"a_h{c}"), F.lit(0.0)), 2)
    return one("x") + one("y") + one("z")


def _listed(k: int, first: bool, kind: T.DataType):
    """Over pairs of blocks, the k nearest others of each point of the first in the second, equal distances by id. The first pair of a
    block gives one row: its lists, its points' bounds (their k-th distance squared) and the greatest; later ones give rows
    (u, v, d2) within the bounds."""
    entry = pa.struct([("u", to_arrow_type(kind)), ("v", to_arrow_type(kind)), ("d2", pa.float64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v1, v2 = batch.column("m1")[r].values, batch.column("m2")[r].values
                x, y = (v.field("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3) for v in (v1, v2))
                u, v = (m.field("id").to_numpy(zero_copy_only=False) for m in (v1, v2))
                bound, of = np.full(len(x), np.inf), np.arange(len(x))
                if not first:
                    bound = batch.column("bounds")[r].values.to_numpy(zero_copy_only=False)
                    away = np.maximum(np.maximum(y.min(axis=0) - x, x - y.max(axis=0)), 0.0)
                    of = np.flatnonzero((away**2).sum(axis=1) <= bound * (1 + 1e-12))
                by = np.argsort(v, kind="stable")
                y, v, named = y[by], v[by], v2.field("id").take(pa.array(by))
                i, j, d2 = [], [], []
                for at in range(0, len(of), 256):  # a stripe at a time
                    some = of[at : at + 256]
                    d = sum((x[some][:, None, c] - y[None, :, c]) ** 2 for c in range(3))
                    d[u[some][:, None] == v[None]] = np.inf
                    few = min(k, len(v))
                    most = np.minimum(np.partition(d, few - 1, axis=1)[:, few - 1], bound[some])
                    a, b = np.nonzero((d <= most[:, None]) & np.isfinite(d))
                    order = np.lexsort((b, d[a, b], a))
                    a, b = a[order], b[order]
                    good = np.arange(len(a)) - np.searchsorted(a, a) < k
                    a, b = a[good], b[good]
                    i.append(some[a])
                    j.append(b)
                    d2.append(d[a, b])
                i, j, d2 = (np.concatenate([np.array([], t), *z]) for z, t in ((i, int), (j, int), (d2, float)))
                columns = [v1.field("id").take(pa.array(i)), named.take(pa.array(j)), pa.array(d2)]
                if not first:
                    yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "d2"])
                    continue
                n = np.bincount(i, minlength=len(x))
                full = n == k
                bound[full] = d2[np.cumsum(n)[full] - 1]
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                lists = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, entry)], fields=list(entry))
                yield pa.RecordBatch.from_arrays([batch.column("a_block").slice(r, 1), batch.column("b_block").slice(r, 1), pa.array([bound.max()]), one(pa.array(bound)), one(lists)], names=["a_block", "b_block", "most", "bounds", "lists"])

    return compare


def nearest(points: DataFrame, k: int, rows: int = BLOCK) -> DataFrame:
    """(u, v, d2): the k nearest others of each point (id, x, y, z) by the square of their distance, equal distances by id, and some
    that aren't among them.

    Points are dealt to blocks that lie close together. A block's first look at the block nearest to it bounds how far its
    points' neighbours can be, and only blocks within that are looked at then, by the points within it of them: what is handed on
    grows with the points. Of equal points the k + 1 least ids are looked for, as a list holds no more."""
    kind = points.schema["id"].dataType
    pack = lambda df: staged(blocked(df, rows).groupBy("block").agg(F.collect_list(F.struct("id", F.array(*"xyz").alias("p"))).alias("m"), *_box()), "near-blocks")
    a = pack(points)
    b = pack(points.withColumn("spot", F.row_number().over(W.partitionBy(*"xyz").orderBy("id"))).where(F.col("spot") <= k + 1).drop("spot"))
    apart = sum((F.abs(F.col(f"a_l{c}") + F.col(f"a_h{c}") - F.col(f"b_l{c}") - F.col(f"b_h{c}")) for c in "xyz"), F.lit(0.0))
    met = _boxes(a, "a").crossJoin(_boxes(b, "b")).select("a_block", "b_block", _gap().alias("gap"), apart.alias("apart"))  # blocks, not points
    nearby = met.groupBy("a_block").agg(F.min(F.struct("gap", "apart", "b_block"))["b_block"].alias("b_block"))
    side = lambda df, c, m: df.select(F.col("block").alias(c), F.col("m").alias(m))
    with_points = lambda pairs: pairs.join(side(a, "a_block", "m1"), "a_block").join(side(b, "b_block", "m2"), "b_block")
    entry = f"struct<u:{kind.simpleString()},v:{kind.simpleString()},d2:double>"
    looked = staged(with_points(nearby).select("a_block", "b_block", "m1", "m2").mapInArrow(_listed(k, True, kind), f"a_block int, b_block int, most double, bounds array<double>, lists array<{entry}>"), "first-looks")
    others = met.join(looked.select("a_block", F.col("b_block").alias("seen"), "most"), "a_block").where((F.col("b_block") != F.col("seen")) & (F.col("gap") <= F.col("most") * (1 + 1e-12))).select("a_block", "b_block")
    more = with_points(others).join(looked.select("a_block", "bounds"), "a_block").select("m1", "m2", "bounds").mapInArrow(_listed(k, False, kind), f"u {kind.simpleString()}, v {kind.simpleString()}, d2 double")
    return looked.select(F.explode("lists").alias("e")).select("e.*").unionByName(more)


def nearest_lists(points: DataFrame, neighbours: int, listed: int, rows: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """points with core (the distance to the neighbours-th other point, or the farthest if there are fewer) and beyond (no point
    that isn't listed is nearer), and the lists (u, v, d)."""
    near = nearest(points.select("id", *"xyz"), listed, rows)
    place = F.row_number().over(W.partitionBy("u").orderBy("d2", "v"))
    near = staged(near.select("u", "v", F.sqrt("d2").alias("d"), place.alias("place")).where(F.col("place") <= listed), "nearest")
    by_point = near.groupBy("u").agg(F.max(F.when(F.col("place") <= neighbours, F.col("d"))).alias("core"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n"))
    beyond = F.when(F.col("n") < listed, F.lit(float("inf"))).otherwise(F.greatest("core", "last"))
    known = points.join(by_point.select(F.col("u").alias("id"), "core", beyond.alias("beyond")), "id")
    return known, near.select("u", "v", "d")


EDGE = ("w", "lo", "hi", "other")


def _closest(points: DataFrame, asked: DataFrame) -> DataFrame:
    """(comp, w, lo, hi, other): for each component of asked (points with bound, null if there is none yet), in each pair of
    blocks, its least edge to another component."""
    kind = points.schema["id"].dataType
    schema = T.StructType([T.StructField("comp", kind), T.StructField("w", T.DoubleType()), T.StructField("lo", kind), T.StructField("hi", kind), T.StructField("other", kind)])
    pack = [F.collect_list(F.struct("id", "comp", "core", F.array(*"xyz").alias("p"))).alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), *_box()]
    a = staged(asked.groupBy("block").agg(F.max(F.coalesce("bound", F.lit(float("inf")))).alias("bound"), *pack), "asked-blocks")
    b = staged(points.groupBy("block").agg(*pack), "point-blocks")
    last = b.agg(F.max("block").alias("n")).first().n
    sides = _boxes(a, "a").withColumn("b_block", F.explode(F.sequence(F.lit(0), F.lit(last)))).join(_boxes(b, "b"), "b_block")
    one = (F.col("a_c0") == F.col("a_c1")) & (F.col("b_c0") == F.col("b_c1")) & (F.col("a_c0") == F.col("b_c0"))
    sides = sides.where((F.sqrt(_gap()) <= F.col("a_bound") * (1 + 1e-12)) & ~one).select(F.col("a_block").alias("block"), "b_block")
    pairs = sides.join(a.select("block", F.col("m").alias("m1")), "block").join(b.select(F.col("block").alias("b_block"), F.col("m").alias("m2")), "b_block").select("m1", "m2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = lambda v, c: v.field(c).to_numpy(zero_copy_only=False)
        for batch in batches:
            for r in range(batch.num_rows):
                v1, v2 = batch.column(0)[r].values, batch.column(1)[r].values
                x, y = (v.field("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3) for v in (v1, v2))
                c1, c2 = part(v1, "comp"), part(v2, "comp")
                w = np.sqrt(sum((x[:, None, k] - y[None, :, k]) ** 2 for k in range(3)))
                np.maximum(w, part(v1, "core")[:, None], out=w)
                np.maximum(w, part(v2, "core")[None], out=w)
                w[c1[:, None] == c2[None]] = np.inf
                names, of = np.unique(c1, return_inverse=True)
                best = np.full(len(names), np.inf)
                np.minimum.at(best, of, w.min(axis=1))
                i, j = np.nonzero((w == best[of][:, None]) & np.isfinite(w))
                if len(i):
                    a, b = part(v1, "id")[i], part(v2, "id")[j]
                    swap = a > b
                    lo, hi = np.where(swap, b, a), np.where(swap, a, b)
                    order = np.lexsort((hi, lo, of[i]))
                    first = order[np.concatenate(([True], of[i][order][1:] != of[i][order][:-1]))]
                    named = [pa.array(v, v1.field("id").type) for v in (c1[i][first], lo[first], hi[first], c2[j][first])]
                    columns = [named[0], pa.array(w[i, j][first]), *named[1:]]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pairs.mapInArrow(compare, schema)


def joined_roots(best: DataFrame) -> DataFrame:
    """(node, root) of components that join along each one's least edge (comp, other). Least edges form trees, in each of which
    one edge is both its ends': the lesser of them is the root. Pointers double in reach, a join each time."""
    up = best.select(F.col("comp").alias("node"), F.col("other").alias("to"))
    back = up.select(F.col("node").alias("to"), F.col("to").alias("again"))
    at = staged(up.join(back, "to").select("node", F.when((F.col("again") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("to")), "pointers")
    while True:
        further = at.join(at.select(F.col("node").alias("to"), F.col("to").alias("root")), "to").select("node", "to", "root")
        further = staged(further, "pointers")
        if further.where("to <> root").isEmpty():
            return further.select("node", "root")
        at = further.select("node", F.col("root").alias("to"))


def spanning_tree(points: DataFrame, neighbours: int = 5, rows: int = BLOCK, listed: int = 16) -> DataFrame:
    """(w, lo, hi): the edges of the least spanning tree of points (id, x, y, z) by mutual reachability, n - 1 of them."""
    known, lists = nearest_lists(staged(points.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"]), "points"), neighbours, max(listed, neighbours + 1), rows)
    known = staged(blocked(known, rows), "blocked")
    core = lambda c: known.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"))
    w = F.greatest("d", "core_u", "core_v")
    left = staged(lists.join(core("u"), "u").join(core("v"), "v").select(w.alias("w"), F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).distinct(), "listed")
    comps, tree = known.select("id", F.col("id").alias("comp")), None
    while True:
        of = lambda c, name: comps.select(F.col("id").alias(c), F.col("comp").alias(name))  # noqa: B023, E731
        left = staged(left.join(of("lo", "c_lo"), "lo").join(of("hi", "c_hi"), "hi").where("c_lo <> c_hi").select("w", "lo", "hi", "c_lo", "c_hi"), "listed")
        both = left.select(F.col("c_lo").alias("comp"), "w", "lo", "hi", F.col("c_hi").alias("other")).unionByName(left.select(F.col("c_hi").alias("comp"), "w", "lo", "hi", F.col("c_lo").alias("other")))
        least = both.groupBy("comp").agg(F.min(F.struct(*EDGE)).alias("edge"))
        here = staged(known.join(comps, "id").join(least.select("comp", F.col("edge.w").alias("bound")), "comp", "left"), "rounds")
        asked = here.where(F.col("bound").isNull() | (F.col("beyond") <= F.col("bound")))  # a point beyond its list may be nearer
        more = _closest(here, asked)
        best = staged(least.select("comp", "edge.*").unionByName(more).groupBy("comp").agg(F.min(F.struct(*EDGE)).alias("edge")).select("comp", "edge.*"), "least-edges")
        if best.isEmpty():
            return points.select(F.lit(0.0).alias("w"), F.col("id").alias("lo"), F.col("id").alias("hi")).limit(0) if tree is None else tree
        added = best.select("w", "lo", "hi").distinct()
        tree = staged(added if tree is None else tree.unionByName(added), "tree")
        comps = staged(comps.join(joined_roots(best).withColumnRenamed("node", "comp"), "comp").select("id", F.col("root").alias("comp")), "comps")
        left = left.select("w", "lo", "hi")


def _folded(min_size: int):
    """What a group of edges, in order, does to the components that it joins."""

    def fold(edges: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        parent, state, out = {}, {}, []
        for s in states.itertuples(index=False):
            parent[s.id] = s.id
            state[s.id] = [int(s.size), int(s.cluster), list(s.members), float(s.mass), float(s.kids)]

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        row = lambda kind, id, new=None, cluster=-1, above=-1, chosen=False, size=0, members=(), mass=0.0, kids=0.0: out.append((kind, id, new, cluster, above, chosen, size, list(members), mass, kids))
        for e in edges.sort_values("rank").itertuples(index=False):
            a, b = sorted((find(e.su), find(e.sv)))
            x, y = state[a], state.pop(b)
            parent[b], dense, size = a, 1.0 / max(e.w, LEAST), x[0] + y[0]
            if x[1] >= 0 and y[1] >= 0:  # two clusters end, one begins
                kids = 0.0
                for s in (x, y):
                    own = s[3] - s[0] * dense
                    row("cluster", a, cluster=s[1], above=int(e.rank), chosen=own >= s[4])
                    kids += max(own, s[4])
                state[a] = [size, int(e.rank), [], size * dense, kids]
            elif x[1] >= 0 or y[1] >= 0:  # a cluster takes a few points in
                c, few = (x, y) if x[1] >= 0 else (y, x)
                for p in few[2]:
                    row("point", p, cluster=c[1])
                state[a] = [size, c[1], [], c[3] + few[0] * dense, c[4]]
            elif size >= min_size:  # enough points for a cluster
                for p in x[2] + y[2]:
                    row("point", p, cluster=int(e.rank))
                state[a] = [size, int(e.rank), [], size * dense, 0.0]
            else:
                state[a] = [size, -1, x[2] + y[2], 0.0, 0.0]
        for old in states["id"]:
            row("moved", old, new=find(old))
        for k, s in state.items():
            row("state", k, cluster=s[1], size=s[0], members=s[2], mass=s[3], kids=s[4])
        return pd.DataFrame(out, columns=["kind", "id", "new", "cluster", "above", "chosen", "size", "members", "mass", "kids"])

    return fold


def condensed(tree: DataFrame, points: DataFrame, min_size: int, batch_edges: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """The condensed tree of a spanning tree (w, lo, hi): points with the cluster that they join first (id, cluster), and clusters
    with the one that they end in and whether they last longer than what is in them (cluster, above, chosen)."""
    kind = points.schema["id"].dataType.simpleString()
    schema = f"kind string, id {kind}, new {kind}, cluster long, above long, chosen boolean, size long, members array<{kind}>, mass double, kids double"
    edges = staged(numbered(tree, F.col("w"), F.col("lo"), F.col("hi")).withColumn("batch", F.floor((F.col("rank") - 1) / batch_edges)), "ranked-edges").withColumnsRenamed({"lo": "su", "hi": "sv"})
    states = points.select("id", F.lit(1).cast("long").alias("size"), F.lit(-1).cast("long").alias("cluster"), F.array("id").alias("members"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("kids"))
    said = None
    for k in range((edges.agg(F.max("batch")).first()[0] or 0) + 1):
        own = edges.where(F.col("batch") == k)
        found = components(own.select(F.col("su").alias("u"), F.col("sv").alias("v")))
        roots = staged(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "forest")
        grouped = own.join(roots.select(F.col("node").alias("su"), "root"), "su").select("root", "su", "sv", "w", "rank")
        held = states.join(roots.select(F.col("node").alias("id"), F.col("root").alias("of")), "id")
        done = staged(grouped.groupBy("root").cogroup(held.groupBy("of")).applyInPandas(_folded(min_size), schema), "folded")
        now = done.where("kind in ('point', 'cluster')").select("kind", "id", "cluster", "above", "chosen")
        said = now if said is None else said.unionByName(now)
        states = staged(states.join(roots.select(F.col("node").alias("id")), "id", "left_anti").unionByName(done.where("kind = 'state'").select(*states.columns)), "components")
        moved = staged(done.where("kind = 'moved'").select("id", "new"), "moved")
        rest = edges.where(F.col("batch") > k)
        for c in ("su", "sv"):
            rest = rest.join(moved.select(F.col("id").alias(c), F.col("new").alias(f"new_{c}")), c, "left").withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
        edges = staged(rest, "ranked-edges")
    last = states.where("cluster >= 0").select("cluster", F.lit(-1).cast("long").alias("above"), F.lit(False).alias("chosen"))  # all points together aren't a cluster
    return said.where("kind = 'point'").select("id", "cluster"), said.where("kind = 'cluster'").select("cluster", "above", "chosen").unionByName(last)


def uppermost(clusters: DataFrame) -> DataFrame:
    """(cluster, top): the highest chosen cluster that each is in, itself included; null if none is. Pointers double in reach."""
    at = staged(clusters.select("cluster", F.nullif("above", F.lit(-1)).alias("above"), F.when(F.col("chosen"), F.col("cluster")).alias("top")), "pointers")
    while not at.where("above is not null").isEmpty():
        up = at.select(F.col("cluster").alias("above"), F.col("above").alias("next"), F.col("top").alias("higher"))
        at = staged(at.join(up, "above", "left").select("cluster", F.col("next").alias("above"), F.coalesce("higher", "top").alias("top")), "pointers")
    return at.select("cluster", "top")


def cluster_hierarchy(points: DataFrame, min_size: int | None = None, rows: int = BLOCK, batch_edges: int = 200_000) -> DataFrame:
    """(id, cluster_id) of points (id, x, y, z): the clusters that last longest over all densities; noise is null, a cluster is
    named by its least point.

    Of a cluster and the clusters within it those stay whose points stay in them longer, summed over density (one over
    distance); all points together are no cluster. min_size is min(5, max(2, n // 3)) if not given. Points without
    coordinates are left out; one point, or none, has no cluster."""
    points = staged(points.where("x is not null and y is not null and z is not null").select("id", *"xyz"), "points")
    n = points.count()
    if n < 2:
        return points.select("id", F.lit(None).cast(points.schema["id"].dataType).alias("cluster_id"))
    least = min_size or min(5, max(2, n // 3))
    joined, clusters = condensed(spanning_tree(points, min(least, n - 1), rows), points.select("id"), least, batch_edges)
    tops = joined.join(uppermost(clusters), "cluster").where("top is not null").select("id", "top")
    names = tops.groupBy("top").agg(F.min("id").alias("cluster_id"))
    return points.select("id").join(tops.join(names, "top").select("id", "cluster_id"), "id", "left")
