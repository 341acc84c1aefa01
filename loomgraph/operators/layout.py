"""Projections, clusters, gaps and what is drawn of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..staging import split_join, staged
from .components import components
from .vectors import knn, matrix

NOISE_COLOR = "#787068"


def project_groups(vectors: DataFrame) -> DataFrame:
    """(id, x, y, z): centred vectors, summed over three equal runs of dimensions (the last takes the rest) and
    divided by the root of a third of the dimensions. Vectors of fewer than three dimensions are padded."""
    long = vectors.select("id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    means = long.groupBy("k").agg(F.avg("v").alias("m"))  # one row a dimension
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("mean"))
    both = vectors.join(F.broadcast(mean))  # one row
    n = F.size("embedding")
    run = F.floor(n / 3).cast("int")
    centred = F.zip_with(F.col("embedding").cast("array<double>"), F.col("mean"), lambda a, b: a - b)
    total = lambda start, size: F.aggregate(F.slice(F.col("c"), start, size), F.lit(0.0), lambda acc, x: acc + x) / F.sqrt(F.greatest(n / 3, F.lit(1.0)))
    padded = F.when(n < 3, F.concat(centred, F.array_repeat(F.lit(0.0), 3 - n))).otherwise(centred)
    run = F.greatest(run, F.lit(1))
    rows = both.withColumn("c", padded)
    return rows.select("id", total(F.lit(1), run).alias("x"), total(run + 1, run).alias("y"), total(2 * run + 1, F.greatest(F.size("c") - 2 * run, F.lit(1))).alias("z"))


def project_pca(vectors: DataFrame, k: int = 3) -> DataFrame:
    """(id, x, y, z) by principal components, which stand in for a manifold projection; nothing under two rows."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if len(rows.take(2)) < 2:
        return vectors.select("id", *[F.lit(0.0).alias(c) for c in "xyz"]).limit(0)
    out = PCA(k=k, inputCol="features", outputCol="p").fit(rows).transform(rows).withColumn("p", vector_to_array("p"))
    return out.select("id", *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")])


def cluster(points: DataFrame, min_size: int = 5, eps: float | None = None, share: float = 0.9) -> DataFrame:
    """(id, cluster_id) of points (id, x, y, z), clustered by density; noise is null, a cluster is named by its least
    core id.

    A point is core if ``min_size`` points, itself included, lie within ``eps``; core points within ``eps`` of each other are
    one cluster, and another point joins its nearest core point (the lesser id if equal) within ``eps``. Without ``eps``
    it is the distance that ``share`` of the points have ``min_size`` points within, estimated.

    Points meet by cell. A cell's diagonal is below ``eps``, so its core points are one cluster without being compared,
    and it is dealt into tiles of bounded size; only points of different cells within reach are compared, tile by tile,
    and a pair of tiles returns counts, a link between cells, or nearest core points, never pairs."""
    points = staged(points.where("x is not null and y is not null and z is not null").select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"]), "points")
    if eps is None:
        kth = knn(points.select(F.col("id").alias("q"), F.array(*"xyz").alias("embedding")), points.select("id", F.array(*"xyz").alias("embedding")), min_size, "q")
        eps = kth.groupBy("q").agg(F.max("d2").alias("d2"), F.count(F.lit(1)).alias("n")).where(F.col("n") == min_size).agg(F.expr(f"percentile_approx(sqrt(d2), {float(share)}, 10000)")).first()[0]
    if not eps:
        eps = 1e-12
    side = eps / 3**0.5 * (1 - 1e-9)
    cell = [F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in "xyz"]
    celled = staged(points.select("id", *"xyz", *cell), "celled")
    kind = points.schema["id"].dataType
    key = ["cx", "cy", "cz"]
    sized = split_join(celled, celled.groupBy(*key).agg(F.count(F.lit(1)).alias("held")), key)  # the points of a cell of min_size points are core
    counts = _neighbours(sized.where(F.col("held") < min_size).drop("held"), celled, eps, T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType())]), _count)
    core_ids = staged(counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_size).select("id").unionByName(sized.where(F.col("held") >= min_size).select("id")), "core-ids")
    core = staged(celled.join(core_ids, "id", "left_semi"), "core")
    first = staged(core.groupBy(*key).agg(F.min("id").alias("v")), "core-cells")
    within = split_join(core.select("id", *key), first, key).select(F.col("id").alias("u"), "v").where("u <> v")
    between = _neighbours(core, core, eps, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]), _touch, own_cell=False)
    roots = components(within.unionByName(between))
    named = core.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster_id"))
    rest = celled.join(core_ids, "id", "left_anti")
    nearest = _neighbours(rest, core, eps, T.StructType([T.StructField("id", kind), T.StructField("d2", T.DoubleType()), T.StructField("core", kind)]), _nearest)
    joined = nearest.groupBy("id").agg(F.min(F.struct("d2", "core"))["core"].alias("core"))
    border = joined.join(named.select(F.col("id").alias("core"), "cluster_id"), "core").select("id", "cluster_id")
    return points.select("id").join(named.unionByName(border), "id", "left")


def _count(ai, a, bi, b, eps):
    return [ai, pa.array((_squares(a, b) <= eps * eps).sum(1).astype(np.int64))]


def _touch(ai, a, bi, b, eps):
    i, j = np.nonzero(_squares(a, b) <= eps * eps)
    return [ai.take(pa.array(i[:1])), bi.take(pa.array(j[:1]))]


def _nearest(ai, a, bi, b, eps):
    d = _squares(a, b)
    order = np.argsort(bi.to_numpy(zero_copy_only=False), kind="stable")
    j = order[np.argmin(d[:, order], axis=1)]
    d2 = d[np.arange(len(a)), j]
    i = np.flatnonzero(d2 <= eps * eps)
    return [ai.take(pa.array(i)), pa.array(d2[i]), bi.take(pa.array(j[i]))]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(3))


def _neighbours(left: DataFrame, right: DataFrame, eps: float, schema: T.StructType, step, own_cell: bool = True, tile: int = 1024) -> DataFrame:
    """step over each pair of a tile of left and one of right whose cells are within reach of each other."""
    key = ["cx", "cy", "cz"]

    def tiled(df: DataFrame) -> DataFrame:
        sizes = df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
        dealt = split_join(df, sizes, key).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        lists = dealt.groupBy(*key, "tile").agg(F.collect_list(F.struct("id", F.array(*"xyz").alias("p"))).alias("m"))
        return lists.select(*key, F.col("m.id").alias("ids"), F.flatten("m.p").alias("flat"))

    span = range(-2, 3)
    steps = [(x, y, z) for x in span for y in span for z in span if own_cell or (x, y, z) > (0, 0, 0)]
    moves = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", s)]) for s in steps])
    a = staged(tiled(left), "cell-tiles")
    b = a if left is right else staged(tiled(right), "cell-tiles")
    # cells first, without their points: what is shipped is a tile for each cell within reach that has points
    to = [f"to_{c}" for c in key]
    moved = a.select(*key).distinct().select(*key, F.explode(moves).alias("d")).select(*key, *[(F.col(c) + F.col(f"d.{c[1]}")).alias(t) for c, t in zip(key, to)])
    met = moved.join(b.select(*[F.col(c).alias(t) for c, t in zip(key, to)]).distinct(), to)
    pairs = a.select(*key, F.col("ids").alias("a_ids"), F.col("flat").alias("a_flat")).join(met, key).drop(*key).join(b.select(*[F.col(c).alias(t) for c, t in zip(key, to)], "ids", "flat"), to).select("a_ids", "a_flat", "ids", "flat")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (ai, x), (bi, y) = matrix(batch, r, "a_ids", "a_flat"), matrix(batch, r, "ids", "flat")
                yield pa.RecordBatch.from_arrays(step(ai, x, bi, y, eps), names=schema.names)

    return pairs.mapInArrow(compare, schema)


def cluster_stats(points: DataFrame) -> DataFrame:
    """(cluster_id, n, x, y, z): size and centroid, noise left out."""
    return points.where("cluster_id is not null").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


def cluster_list(stats: DataFrame, overviews: DataFrame) -> DataFrame:
    return stats.join(overviews.select("cluster_id", "label", "summary"), "cluster_id", "left")


def overview_changes(stats: DataFrame, overviews: DataFrame) -> DataFrame:
    """(cluster_id, status): stale for overviews without a cluster, resynthesize where the size differs or there is
    none, else keep."""
    both = stats.select("cluster_id", "n").join(overviews.select("cluster_id", "engram_count"), "cluster_id", "full_outer")
    status = F.when(F.col("n").isNull(), "stale").when(F.col("engram_count").isNull() | (F.col("n") != F.col("engram_count")), "resynthesize").otherwise("keep")
    return both.select("cluster_id", status.alias("status"))


def cluster_prompt(points: DataFrame, engrams: DataFrame, most: int = 50) -> DataFrame:
    """(cluster_id, n, prompt): up to ``most`` members of each cluster as lines '- name: description' or '- name'."""
    named = points.where("cluster_id is not null").join(engrams.select("id", "canonical_name", "description"), "id")
    place = F.row_number().over(W.partitionBy("cluster_id").orderBy("canonical_name", "id"))
    few = named.withColumn("place", place).where(F.col("place") <= most)
    line = F.concat(F.lit("- "), F.concat_ws(": ", "canonical_name", F.nullif("description", F.lit(""))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return few.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "\n").alias("prompt"))


def gaps(points: DataFrame, least: float = 0.5) -> DataFrame:
    """(c1, c2, x, y, z, radius): midpoints of cluster centroids with no point, noise included, within ``least``.

    The midpoints are the query set of a nearest-neighbour search over all points, block by block."""
    c = staged(cluster_stats(points), "centroids")
    n = max(1, -(-c.count() // 1024))
    deal = F.pmod(F.xxhash64("cluster_id"), F.lit(n)).cast("int")
    a = c.select(F.col("cluster_id").alias("c1"), *[F.col(x).alias(f"a{x}") for x in "xyz"], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    b = c.select(F.col("cluster_id").alias("c2"), *[F.col(x).alias(f"b{x}") for x in "xyz"], deal.alias("block"))
    mids = a.join(b, "block").where("c1 < c2")  # every pair is a gap to look at
    mids = staged(mids.select(F.struct("c1", "c2").alias("pair"), F.array(*[(F.col(f"a{x}") + F.col(f"b{x}")) / 2 for x in "xyz"]).alias("embedding")), "midpoints")
    near = knn(mids, points.select("id", F.array(*"xyz").alias("embedding")), 1, "pair").where(F.sqrt("d2") >= least)
    best = near.select("pair", F.sqrt("d2").alias("radius")).join(mids, "pair")
    return best.select("pair.c1", "pair.c2", *[F.col("embedding")[i].alias(x) for i, x in enumerate("xyz")], "radius")


def cluster_color(cluster_id: Column) -> Column:
    """Hex colour by golden-angle hue, saturation 0.7, lightness 0.6; noise is grey."""
    h = F.pmod(cluster_id * 137.508, F.lit(360.0))
    c, m = 0.8 * 0.7, 0.6 - 0.8 * 0.7 / 2
    x = F.lit(c) * (1 - F.abs(F.pmod(h / 60, F.lit(2.0)) - 1))
    full, none = F.lit(c), F.lit(0.0)
    sector = F.floor(h / 60)
    pick = lambda *six: F.element_at(F.array(*six), (sector + 1).cast("int"))
    part = lambda v: F.lower(F.lpad(F.hex(F.floor((v + m) * 255).cast("long")), 2, "0"))
    color = F.concat(F.lit("#"), part(pick(full, x, none, none, x, full)), part(pick(x, full, full, x, none, none)), part(pick(none, none, x, full, full, x)))
    return F.when(cluster_id.isNull() | (cluster_id < 0), NOISE_COLOR).otherwise(color)


def graph_nodes(points: DataFrame, ranks: DataFrame, engrams: DataFrame, label_from: float = 0.3) -> DataFrame:
    """Nodes (id, name, rank, labelled, color) of the map."""
    nodes = points.join(engrams.select("id", F.col("canonical_name").alias("name")), "id").join(ranks.withColumnRenamed("node", "id"), "id", "left").fillna(0.0, ["rank"])
    return nodes.select("id", "name", "rank", (F.col("rank") >= label_from).alias("labelled"), cluster_color(F.col("cluster_id")).alias("color"))


def graph_links(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with both ends on the map."""
    on = lambda c: points.select(F.col("id").alias(c))
    return edges.join(on("source"), "source", "left_semi").join(on("target"), "target", "left_semi")


def bounds(points: DataFrame, default: float = 15.0) -> DataFrame:
    """One row: centroid, and the greatest distance from it (``default`` if there are no points or it is zero)."""
    centre = points.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"c{c}") for c in "xyz"])
    d = F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "yz"), (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))))
    far = points.join(F.broadcast(centre)).agg(F.max(d).alias("far"))  # one row
    return centre.join(far).select("cx", "cy", "cz", F.when(F.coalesce("far", F.lit(0.0)) > 0, F.col("far")).otherwise(default).alias("radius"))


def top_edges(edges: DataFrame, most: int = 5000) -> DataFrame:
    return edges.orderBy(F.desc("confidence"), "id").limit(most)


def named_points(points: DataFrame, engrams: DataFrame) -> DataFrame:
    """Points with names, by cluster (noise last) and name."""
    return points.join(engrams.select("id", F.col("canonical_name").alias("name")), "id").orderBy(F.asc_nulls_last("cluster_id"), "name", "id")


def minimap(points: DataFrame, width: float, height: float, pad: float = 8.0, tilt: float = 0.3) -> DataFrame:
    """(id, px, py): points tilted to a plane and fitted into width x height, padded, the aspect kept."""
    flat = points.select("id", (F.col("x") + tilt * F.col("z")).alias("u"), (F.col("y") + tilt * F.col("z")).alias("v"))
    box = flat.agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"))
    span = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(1.0)
    scale = F.least((width - 2 * pad) / span("u0", "u1"), (height - 2 * pad) / span("v0", "v1"))
    return flat.join(F.broadcast(box)).select("id", (pad + (F.col("u") - F.col("u0")) * scale).alias("px"), (pad + (F.col("v") - F.col("v0")) * scale).alias("py"))  # one row
