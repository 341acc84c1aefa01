"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit for each bit position that is set in over half of its shingles' XXH64. Distinct
fingerprints are put in classes by the population counts of their two 32-bit halves, and classes are cut into
tiles. Two fingerprints within the radius have population counts within it, so tile pairs whose counts differ by
more are never formed; the others meet in an equi-join on the class and are compared exactly with numpy
(exclusive or, bit counts), where the counts of the 16-bit quarters skip most of a tile again.

A tile pair returns a spanning forest of its links, not all of them: at most one row a fingerprint, with the same
components. Components are then found over distinct fingerprints.

At a wide radius population counts say little and one word links strangers. Then more words (the same shingles,
hashed on) tell them apart by the distance over all words, and a bound on the ratio of shingle counts, which a
similarity implies, cuts the classes by length, so that only texts of about one length meet.

Sketches alone don't decide a similarity: with ``least`` they only propose, at bounds wide enough to lose next to
nothing, and documents link whose sets of shingles have that Jaccard similarity. The proposals' components are small
next to the table; within each, tiles of sets meet and every proposed pair is compared exactly unless its two ends are
known to be connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import split_join, staged

SEED = 42


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of the whole sequence if it is shorter."""
    import xxhash

    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, n - width + 1)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of h, as an unsigned number; 0 without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big") if len(h) else 0


def hashed_on(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64-bit hash of each hash: multiply and shift, odd constants by k."""
    x = (h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def fingerprint(words: list[bytes], width: int) -> int:
    return majority(shingle_hashes(words, width))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes((text or b"").lower().split(), width))


def set_key(h: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, words: int = 1, distinct: bool = False) -> DataFrame:
    """(id, fp long, more array<long>, n long): the fingerprint, the further words and the number of shingles.

    A-Z is lower-cased, words stand between blanks, shingles have ``width`` words. A null text has no words. With
    ``distinct`` each shingle counts once, and ``node`` names the set of them."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), T.StructField("more", T.ArrayType(T.LongType())), T.StructField("n", T.LongType())]
    schema = T.StructType([*fields, T.StructField("node", T.LongType())] if distinct else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, sizes, names = [], [], []
            for t in b.column(1).cast(pa.binary()):
                if distinct:
                    names.append(set_key(h := shingle_set(t.as_py(), width)))
                else:
                    h = shingle_hashes((t.as_py() or b"").lower().split(), width)
                out += [majority(h), *(majority(hashed_on(h, k)) for k in range(1, words))]
                sizes.append(len(h))
            x = np.array(out, np.uint64).view(np.int64).reshape(-1, words)
            at = pa.array(np.arange(len(x) + 1) * (words - 1), pa.int32())
            more = pa.ListArray.from_arrays(at, pa.array(x[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ascontiguousarray(x[:, 0])), more, pa.array(sizes, pa.int64()), *([pa.array(names, pa.int64())] if distinct else [])], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges u-v to stars with the same components: each node but the least of its component, and that least."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    i, j, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        old = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        label = label[label]
        if (label == old).all():
            break
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _pairs(a: np.ndarray, b: np.ndarray, radius: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (into a, into b) of the pairs within the radius, in pieces of about ``step`` comparisons."""
    if len(a) * len(b) <= step >> 3 or radius > 8:  # too few, or too wide, to sort by quarters
        rows = max(1, step // max(1, len(b)))
        for s in range(0, len(a), rows):
            x, y = np.nonzero(np.bitwise_count(a[s : s + rows, None] ^ b[None, :]) <= radius)
            yield x + s, y
        return
    qa, qb = _quarters(a), _quarters(b)
    kinds, of = np.unique(qa, axis=0, return_inverse=True)
    for k, counts in enumerate(kinds):
        own = np.flatnonzero(of.ravel() == k)
        near = np.flatnonzero(np.abs(qb - counts).sum(axis=1) <= radius)
        rows = max(1, step // max(1, len(near)))
        for s in range(0, len(own) if len(near) else 0, rows):
            part = own[s : s + rows]
            x, y = np.nonzero(np.bitwise_count(a[part][:, None] ^ b[near][None, :]) <= radius)
            yield part[x], near[y]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, total: int | None = None, ratio: float | None = None, step: int = 1 << 21) -> np.ndarray:
    """Spanning forest of the links between rows of a and of b, as rows (member, root) of node numbers.

    Rows are int64: the words, the number of shingles, the node. A link has its first words within ``radius``, all
    words within ``total`` and its numbers of shingles within ``ratio`` of each other."""
    wa, wb = (np.ascontiguousarray(x[:, :-2]).view(np.uint64) for x in (a, b))
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for x, y in _pairs(np.ascontiguousarray(wa[:, 0]), np.ascontiguousarray(wb[:, 0]), radius, step):
        good = a[x, -1] != b[y, -1]
        if total is not None:
            good &= np.bitwise_count(wa[x] ^ wb[y]).sum(axis=1, dtype=np.int64) <= total
        if ratio is not None:
            good &= np.minimum(a[x, -2], b[y, -2]) >= ratio * np.maximum(a[x, -2], b[y, -2])
        u, v = np.concatenate((u, a[x[good], -1])), np.concatenate((v, b[y[good], -1]))
        if len(u) > step:  # keep a forest of what is known
            u, v = _forest(u, v)
    return np.stack(_forest(u, v), axis=1) if len(u) else np.empty((0, 2), np.int64)


def links(keys: DataFrame, radius: int = 4, total: int | None = None, ratio: float | None = None, tile: int = 8192) -> DataFrame:
    """keys (node, fp, more, n; distinct nodes) to edges (u, v) whose components are those of all links.

    Classes are single population counts up to a radius of 4, and radius + 1 counts wide beyond, with lengths in
    powers of 1 / ratio; a link stays within neighbouring classes."""
    wide = 1 if radius <= 4 else radius + 1
    reach = radius // wide + (wide > 1)  # classes that a count can move by
    half = lambda shift: F.floor(F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF))) / wide)
    long = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / math.log(1 / ratio)) if ratio else F.lit(0).cast("long")
    line = F.concat(F.array("fp"), "more", F.array("n", "node"))
    classed = keys.select(half(32).alias("hi"), half(0).alias("lo"), long.alias("len"), line.alias("line"))
    key = ["hi", "lo", "len"]
    width = keys.select(F.size("more")).first()
    width = (width[0] if width else 0) + 3
    sizes = classed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / tile).alias("n_tiles"))  # 33 x 33 times the lengths' logarithm, at most
    dealt = classed.join(F.broadcast(sizes), key).withColumn("tile", F.pmod(F.xxhash64("line"), F.col("n_tiles")))
    tiles = staged(dealt.groupBy(*key, "tile").agg(F.flatten(F.collect_list("line")).alias("lines")), "tiles")
    span = range(-reach, reach + 1)
    steps = [(h, x, z) for h in span for x in span for z in (range(-1, 2) if ratio else (0,)) if (wide > 1 or abs(h) + abs(x) <= radius) and (h, x, z) >= (0, 0, 0)]
    near = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("hxz", s)]) for s in steps])
    left = tiles.select(*key, "tile", F.col("lines").alias("a"), F.explode(near).alias("d"))
    same = (F.col("d.h") == 0) & (F.col("d.x") == 0) & (F.col("d.z") == 0)
    left = left.select("a", "tile", same.alias("same"), (F.col("hi") + F.col("d.h")).alias("hi"), (F.col("lo") + F.col("d.x")).alias("lo"), (F.col("len") + F.col("d.z")).alias("len"))
    right = tiles.select(*key, F.col("tile").alias("tile_b"), F.col("lines").alias("b"))
    pairs = left.join(right, key).where("not same or tile <= tile_b").select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].values.to_numpy().reshape(-1, width) for c in (0, 1))
                e = tile_links(a, b, radius, total, ratio)
                if len(e):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, c])) for c in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def shingle_sets(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(node, shingles array<long>): the set of each row's shingles under its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(0).cast(pa.binary())]
            if sets:
                at = pa.array(np.concatenate(([0], np.cumsum([len(h) for h in sets]))), pa.int32())
                flat = pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([set_key(h) for h in sets], pa.int64()), flat], names=["node", "shingles"])

    return docs.select(text_col).mapInArrow(run, "node long, shingles array<long>")


def _sets(flat: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, sketches, sizes and sets of lines (node, n, sketch words, n shingles) that follow each other."""
    heads, sets, i = [], [], 0
    while i < len(flat):
        start, n = i + 2 + words, int(flat[i + 1])
        heads.append(flat[i:start])
        sets.append(flat[start : start + n].view(np.uint64))
        i = start + n
    heads = np.array(heads, np.int64).reshape(-1, 2 + words)
    return heads[:, 0], np.ascontiguousarray(heads[:, 2:]).view(np.uint64), heads[:, 1], sets


def similar_links(a: np.ndarray, b: np.ndarray, words: int, total: int, least: float) -> np.ndarray:
    """Spanning forest of the pairs of a line of a and one of b whose sketches are within ``total`` and whose sets have
    a Jaccard similarity of ``least`` or more, as rows (member, root). Pairs that are connected already are passed over."""
    (na, wa, sa, ha), (nb, wb, sb, hb) = _sets(a, words), _sets(b, words)
    nodes, at = np.unique(np.concatenate((na, nb)), return_inverse=True)
    ia, ib, label, out = at[: len(na)], at[len(na) :], np.arange(len(nodes)), []
    for i in range(len(na)):
        near = np.bitwise_count(wb ^ wa[i]).sum(axis=1, dtype=np.int64) <= total
        near &= np.minimum(sb, sa[i]) >= least * np.maximum(sb, sa[i]) * (1 - 1e-9)
        for j in np.flatnonzero(near & (label[ib] != label[ia[i]])).tolist():
            if label[ib[j]] == label[ia[i]]:
                continue
            x, y = (ha[i], hb[j]) if sa[i] <= sb[j] else (hb[j], ha[i])
            k = np.searchsorted(y, x)
            both = int((y[np.minimum(k, len(y) - 1)] == x).sum()) if len(y) else 0
            if both and both / (len(x) + len(y) - both) >= least:
                label[label == label[ib[j]]] = label[ia[i]]
                out.append((na[i], nb[j]))
    return np.array(out, np.int64).reshape(-1, 2)


def verified(docs: DataFrame, keys: DataFrame, roots: DataFrame, id_col: str, text_col: str, width: int, words: int, total: int, least: float, tile: int = 1 << 18) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of one proposed component that ``least`` holds for.

    Sets come from the texts again, of the nodes with a proposal only. A component's sets are cut by size (powers of
    1 / ``least``: a pair stays in neighbouring classes) and into tiles of about ``tile`` shingles."""
    size = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / math.log(1 / least))
    roots = roots.union(roots.select("root", "root").distinct())  # a root has no row of its own
    proposed = staged(keys.join(roots, "node").withColumnRenamed("root", "family").withColumn("len", size), "proposed")
    tiles = proposed.groupBy("family", "len").agg(F.ceil(F.sum("n") / tile).cast("int").alias("n_tiles"))
    after = tiles.select("family", (F.col("len") - 1).alias("len"), F.col("n_tiles").alias("n_after"))
    tiles = tiles.join(after, ["family", "len"], "left").withColumn("n_after", F.coalesce("n_after", F.lit(0)))
    dealt = split_join(proposed, tiles, ["family", "len"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles")).cast("int"))
    wanted = proposed.select(F.col("least_id").alias("_wanted")).distinct().hint("merge")
    texts = docs.select(id_col, text_col).join(wanted, F.col(id_col).eqNullSafe(F.col("_wanted")), "left_semi")
    sets = shingle_sets(texts, text_col, width).groupBy("node").agg(F.first("shingles").alias("shingles"))
    line = F.concat(F.array("node", "n", "fp"), "more", "shingles")
    dealt = dealt.join(sets.hint("merge"), "node").select("family", "len", "tile", "n_tiles", "n_after", line.alias("line"))
    tiled = staged(dealt.groupBy("family", "len", "tile", "n_tiles", "n_after").agg(F.flatten(F.collect_list("line")).alias("lines")), "set-tiles")
    to = lambda step, first, n: F.transform(F.when(n > first, F.sequence(first, n - 1)).otherwise(F.array().cast("array<int>")), lambda t: F.struct((F.col("len") + step).alias("len"), t.alias("tile")))
    other = F.explode(F.concat(to(0, F.col("tile"), F.col("n_tiles")), to(1, F.lit(0), F.col("n_after"))))
    left = tiled.select("family", F.col("lines").alias("a"), other.alias("to")).select("family", "a", "to.*")
    pairs = left.join(tiled.select("family", "len", "tile", F.col("lines").alias("b")), ["family", "len", "tile"]).select("a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                e = similar_links(*(batch.column(c)[k].values.to_numpy() for c in (0, 1)), words, total, least)
                if len(e):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, c])) for c in (0, 1)], names=["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    radius: int = 4,
    words: int = 1,
    total: int | None = None,
    ratio: float | None = None,
    tile: int = 8192,
    least: float | None = None,
) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id reachable over links).

    With one word a link is a distance of ``radius`` bits or fewer, found exactly. With more words it must also be
    within ``total`` over all of them and, if given, have shingle counts within ``ratio``; distinct sketches are
    then told apart by their 64-bit hash. With ``least`` (and ``total``) sketches and counts are those of the distinct
    shingles, such links are proposals, and a link has a Jaccard similarity of ``least`` or more. Null and empty texts, and texts of blanks, have fingerprint zero and link
    like any other. Repeated rows give repeated rows. A null id takes part and is never a component_id unless its
    component has no other. An empty table gives no rows. Other columns of docs are not read.
    """
    if least is not None:
        fps = staged(fingerprints(docs, id_col, text_col, width, words, distinct=True), "fingerprints")
    else:
        node = F.col("fp") if words == 1 and ratio is None else F.xxhash64("fp", "more", "n")
        count = F.col("n") if ratio is not None else F.lit(0).cast("long")
        fps = staged(fingerprints(docs, id_col, text_col, width, words).withColumn("n", count).withColumn("node", node), "fingerprints")
    keys = staged(fps.groupBy("node", "fp", "more", "n").agg(F.min(id_col).alias("least_id")), "fingerprint-keys")
    roots = components(links(keys.drop("least_id"), radius, total, ratio, tile))
    if least is not None:
        roots = components(verified(docs, keys, roots, id_col, text_col, width, words, total, least))
    rooted = keys.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = staged(split_join(rooted.select("node", "root"), least, ["root"]).select("node", "component_id"), "fingerprint-components")
    return fps.join(named, "node").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
