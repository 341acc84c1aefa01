"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents in a seeded order, are cut into blocks. A source's target gives an exact
number of words: whole passes over all blocks, then permuted blocks and the beginning of one more. The blocks to
draw are shared out over output shards by a binary tree: each node splits its per-source counts between its
halves by a multivariate-hypergeometric draw, so shards have equal block counts and each is a uniform random part
of the mix. A document's words are taken where a shard's quota holds their block's rank.

A node's draw over the sources is itself made by halves: of the blocks that go left, how many are of the first half of
the sources, and so on down to one source. Every step is a plain hypergeometric draw seeded by its place, so the quotas
of one source need the counts of halves on the way to it only, and a task works out those of its own sources: nobody
holds shards times sources. Draws among 10^9 blocks or more, which numpy refuses, are made by rejection.

Where a document stands in its source comes from running sums: rows are dealt to ranges of (source, seeded hash, row),
summed within a range, and ranges are offset by the sums before. So neither a hot source nor an id or a text that
repeats is one task's. Blocks are permuted by a keyed Feistel network. The driver and each task hold a few numbers for
each source (not its name), and one for each range of rows and source that meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, row_keyed, staged

WEIGHTS = (3, 1, 2)
#: numpy's hypergeometric takes fewer items than this in all.
NUMPY_MOST = 1_000_000_000

DRAWS = T.ArrayType(
    T.StructType([T.StructField("shard", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType())])
)
#: What a source's plan holds, a number each.
PLAN = ("source_size", "target", "blocks", "key", "passes", "full", "part")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, h, at) and the columns to carry: words between blanks, the place in a seeded order of the source,
    and a key of the row, which parts rows that are equal in all else."""
    docs, row = row_keyed(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return staged(docs.select(id_col, F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"), F.col(row).alias("at"), *carry), "mix-sizes")


def water_level(sizes: np.ndarray, weights: np.ndarray, share: float, most: float) -> np.ndarray:
    """Each source's target: sources share ``share`` of all words by weight, a target stops at ``most`` times its source's
    size, and the excess goes to the others by weight.

    That is the level L at which sum(min(cap, L * weight)) is the total. With sources sorted by cap / weight, the level that
    the sources from one on would share rises as long as that one is above its cap and falls after, so L is its greatest value."""
    cap, total = sizes * most, sizes.sum() * share
    order = np.argsort(cap / weights, kind="stable")
    before = lambda v: np.concatenate(([0.0], np.cumsum(v[order])[:-1]))
    level = (total - before(cap)) / (weights.sum() - before(weights))
    fits = level * weights[order] <= cap[order]
    return np.minimum(cap, level[fits].max() * weights) if fits.any() else cap


def sources_of(sizes: DataFrame) -> DataFrame:
    """(source, number, source_size): sources in code-point order, null last, numbered from 0."""
    by_source = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    return numbered(by_source, F.col("source").asc_nulls_last()).withColumn("number", F.col("rank") - 1).select("source", "number", "source_size")


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each x in a permutation of 0..n-1 that its key picks: four Feistel rounds on the least even number
    of bits that holds n, walked on until the place is below n. Neighbours land anywhere."""
    x, n, key = (np.asarray(v, np.uint64) for v in np.broadcast_arrays(x, n, key))
    half = np.maximum(np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(float)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(4):
            mixed = (right + k + np.uint64(r * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def plan_of(number: int, size: int, target: float, block: int, most: float, seed: int) -> tuple[int, int, int, int, int]:
    """(blocks, key, passes, full, part) of a source: how many blocks it has, the key of their order, and what is drawn: whole
    passes, the first ``full`` ranks of one more, and ``part`` words of the next."""
    take, blocks = (min(round(target), int(most * size)), -(-size // block)) if size else (0, 0)
    key, passes, full, part = int(np.random.default_rng([seed, number]).integers(0, 1 << 62)), 0, 0, 0
    if blocks:
        passes, rest = divmod(take, size)
        short, at = size - (blocks - 1) * block, int(permuted([blocks - 1], [blocks], [key])[0])  # the last block, and its rank
        if rest <= at * block:
            full, part = divmod(rest, block)
        elif rest < at * block + short:
            full, part = at, rest - at * block
        else:
            full, part = divmod(rest + block - short, block)
    return blocks, key, passes, full, part


def _log_steps(a: float, d: np.ndarray) -> np.ndarray:
    """log((a + d)! / a!) - d log(a), exact to some 1e-12 for large a and d well below it."""
    b = a + d
    return (b + 0.5) * np.log1p(d / a) - d + (1 / b - 1 / a) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n items drawn from good + bad are good. By numpy where it can; beyond, by rejection from a wide curve around
    the mode (ratio of uniforms), with the ratio of probabilities to the mode's by Stirling's series."""
    total = good + bad
    if total < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    small = min(good, bad, n, total - n)
    if small < 1 << 20:  # the few are good, bad, drawn or left out: they fall one after another among the places that are left
        hit, left, places = 0, n if small in (good, bad) else good, total
        for u in rng.random(small):
            inside = u * places < left
            hit, left, places = hit + inside, left - inside, places - 1
        return int(hit if small in (good, n) else (n if small == bad else good) - hit)
    mode = (n + 1) * (good + 1) // (total + 2)
    lo, hi = max(0, n - bad), min(n, good)
    wide = math.sqrt(n / total * good / total * bad * (total - n) / total) + 1
    a, b, c, e = float(mode), float(good - mode), float(n - mode), float(bad - n + mode)
    step = math.log1p((b * c - a * e) / (a * e))
    while True:
        u, v = rng.random(256), rng.random(256)
        k = mode + np.floor(0.5 + 2.2 * wide * (v - 0.5) / u)  # the tails beyond are below e-100 of the mode
        d = np.where((k < lo) | (k > hi) | (np.abs(k - mode) > 40 * wide), np.nan, k - mode)
        log_ratio = d * step - _log_steps(a, d) - _log_steps(b, -d) - _log_steps(c, -d) - _log_steps(e, d)
        good_ones = np.flatnonzero(2 * np.log(u) <= log_ratio)
        if len(good_ones):
            return int(k[good_ones[0]])


class ShardTree:
    """Quotas of blocks by shard, for one source at a time.

    before: how many blocks all sources before a source have, and the sum. Shards have equal sizes, to one block. A group is
    a range of sources; its counts are kept by level of the tree over shards, 1, 2, 4... numbers, and worked out from those
    of the group twice as large. Halves are split once and kept as long as there is room."""

    def __init__(self, before: np.ndarray, shards: int, seed: int, room: int = 48):
        self.before, self.shards, self.seed, self.room, self.known = before, shards, seed, room, {}
        self.levels = max(0, math.ceil(math.log2(shards)))
        base, extra = divmod(int(before[-1]), shards)
        sizes = np.zeros(1 << self.levels, np.int64)
        sizes[:shards] = base + (np.arange(shards) < extra)
        self.known[0, len(before) - 1] = [sizes.reshape(1 << d, -1).sum(axis=1) for d in range(self.levels + 1)]

    def split(self, whole: list[np.ndarray], lo: int, mid: int) -> list[np.ndarray]:
        """The counts of sources lo to mid, of those of a group that begins with them."""
        out = [np.array([self.before[mid] - self.before[lo]], np.int64)]
        for d in range(self.levels):
            own, rest, left = out[d], whole[d] - out[d], whole[d + 1][0::2]
            goes = np.where(rest == 0, left, 0)
            todo = np.flatnonzero((own > 0) & (rest > 0) & (left > 0))
            if len(todo):
                rng = np.random.default_rng([self.seed, d, lo, mid])
                x, y, n = own[todo], rest[todo], left[todo]
                if (x + y).max() < NUMPY_MOST:
                    goes[todo] = rng.hypergeometric(x, y, n)
                else:
                    goes[todo] = [hypergeometric(rng, *map(int, t)) for t in zip(x, y, n)]
            out.append(np.stack([goes, own - goes], axis=1).ravel())
        return out

    def column(self, source: int) -> np.ndarray:
        """Blocks of the source for each shard."""
        lo, hi = 0, len(self.before) - 1
        while hi - lo > 1:
            mid, whole = (lo + hi) // 2, self.known[lo, hi]
            if (lo, mid) not in self.known:
                while len(self.known) > self.room:  # the oldest but the root
                    self.known.pop(next(k for k in self.known if k not in ((0, len(self.before) - 1), (lo, hi))))
                first = self.split(whole, lo, mid)
                self.known[lo, mid], self.known[mid, hi] = first, [w - f for w, f in zip(whole, first)]
            elif (mid, hi) not in self.known:
                self.known[mid, hi] = [w - f for w, f in zip(whole, self.known[lo, mid])]
            lo, hi = (lo, mid) if source < mid else (mid, hi)
        return self.known[lo, hi][-1][: self.shards]


def shard_quotas(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources): the tree whole. Column sums are the counts and row sums
    differ by one at most. For tests and small mixes."""
    tree = ShardTree(np.concatenate(([0], np.cumsum(counts))).astype(np.int64), shards, seed)
    return np.stack([tree.column(k) for k in range(len(counts))], axis=1)


def placed(rows: DataFrame) -> DataFrame:
    """rows (number, size, h, at, ...) with begin: how many words of its source stand before a row, in an order that h gives.

    Ranges of rows are summed up one by one; the sums of what they have of each source, at most ranges + sources numbers, are
    joined back as the offsets of the next."""
    order = ["number", "h", "size", "at"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.shiftright(F.monotonically_increasing_id(), 33))
    schema = T.StructType([*ranges.schema.fields, T.StructField("begin", T.LongType())])
    at, of = ranges.columns.index("size"), ranges.columns.index("number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = -1, 0
        for b in batches:
            if b.num_rows:
                size, number = b.column(at).to_numpy(), b.column(of).to_numpy()
                before = np.cumsum(size) - size
                new = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
                begin = before - np.repeat(before[new], np.diff(np.append(new, len(number))))
                if number[0] == last:
                    begin[: new[1] if len(new) > 1 else None] += held
                last, held = number[-1], int(begin[-1] + size[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(begin)], names=schema.names)

    ranges = staged(ranges.mapInArrow(run, schema), "mix-ranges")
    sums = ranges.groupBy("number", "range").agg(F.sum("size").alias("words")).orderBy("number", "range").toArrow()
    number, words = sums.column("number").to_numpy(), sums.column("words").to_numpy()
    before = np.cumsum(words) - words
    first = np.searchsorted(number, number)  # where the ranges of a source begin
    sums = sums.drop_columns(["words"]).append_column("offset", pa.array(before - before[first]))
    offsets = rows.sparkSession.createDataFrame(sums.to_pandas(), "number long, range long, offset long") if len(number) else ranges.select("number", "range", F.lit(0).cast("long").alias("offset"))
    return ranges.join(offsets, ["number", "range"]).withColumn("begin", F.col("begin") + F.col("offset")).drop("offset", "range")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 256,
    shard_words: int = 50_000_000,
    seed: int = 7,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, the columns to carry, taken and draws (shard,
    rank of the block among the source's draws, first word, words).

    ``taken`` is the sum of the draws, those of a row's words whose block some shard's quota holds; per source it is the
    rounded target. Null texts have size 0 and are never drawn; null sources are one source, the last. Repeated rows are
    drawn like different documents. An empty table gives no rows, other columns are not read, and the same rows and seed
    give the same result however they are partitioned.
    """
    sizes = measured(docs, id_col, text_col, source_col, seed, carry)
    sources = staged(sources_of(sizes), "mix-numbers")
    known = sources.select("number", "source_size").orderBy("number").toArrow()  # numbers of each source, without its name
    words = known.column("source_size").to_numpy().astype(np.int64)
    target = water_level(words.astype(float), np.array(weights, float)[np.arange(len(words)) % len(weights)], share, most) if len(words) else np.empty(0)
    shared = docs.sparkSession.sparkContext.broadcast((words, target))
    fields = [sources.schema["source"], T.StructField("number", T.LongType()), *[T.StructField(c, T.DoubleType() if c == "target" else T.LongType()) for c in PLAN]]

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, target = shared.value
        for b in batches:
            number = b.column(1).to_numpy()
            rows = [plan_of(k, int(words[k]), float(target[k]), block_words, most, seed) for k in number.tolist()]
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words[number]), pa.array(target[number]), *columns], names=["source", "number", *PLAN])

    lines = staged(sources.select("source", "number").mapInArrow(planned, T.StructType(fields)), "mix-plan").withColumnRenamed("source", "_source")
    drawn = F.col("passes") * F.col("blocks") + F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0)
    counts = lines.select("number", drawn.alias("n")).orderBy("number").toArrow().column("n").to_numpy()
    rows = sizes.join(lines, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    at = placed(rows)
    keep = [id_col, "source", "size", "source_size", "target", *carry, "number", "begin", "blocks", "key", "passes", "full", "part"]
    own_columns = 5 + len(carry)
    block, shards = block_words, max(1, math.ceil(float(target.sum()) / shard_words))
    before = docs.sparkSession.sparkContext.broadcast(np.concatenate(([0], np.cumsum(counts))).astype(np.int64))
    schema = T.StructType([*at.select(*keep[:own_columns]).schema.fields, T.StructField("taken", T.LongType()), T.StructField("draws", DRAWS)])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ShardTree(before.value, shards, seed)
        for d in batches:
            x = {c: d.column(keep.index(c)).to_numpy(zero_copy_only=False) for c in [*keep[own_columns:], "size"]}
            first, last = x["begin"] // block, (x["begin"] + x["size"] - 1) // block
            n = np.where(x["size"] > 0, last - first + 1, 0)
            row = np.repeat(np.arange(d.num_rows), n)
            b = first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x = {c: v[row] for c, v in x.items()}
            lo, hi = np.maximum(x["begin"], b * block), np.minimum(x["begin"] + x["size"], (b + 1) * block)
            rank = permuted(b, x["blocks"], x["key"])
            parts = []
            for p in range(int(x["passes"].max(initial=0)) + 1):
                whole = (p < x["passes"]) | ((p == x["passes"]) & (rank < x["full"]))
                some = (p == x["passes"]) & (rank == x["full"])
                end = np.where(whole, hi, np.where(some, np.minimum(hi, b * block + x["part"]), lo))
                at = np.flatnonzero(end > lo)
                parts.append((row[at], p * x["blocks"][at] + rank[at], (lo - x["begin"])[at], (end - lo)[at], x["number"][at]))
            row, rank, start, words, number = (np.concatenate(c) for c in zip(*parts))
            shard = np.zeros(len(row), np.int64)
            for s in np.unique(number):
                of = number == s
                shard[of] = np.searchsorted(np.cumsum(tree.column(int(s))), rank[of], "right")  # the shard whose quota holds the rank
            row, rank, start, words, shard = (v[shard < shards] for v in (row, rank, start, words, shard))
            order = np.lexsort((rank, row))
            fields = [pa.array(v[order].astype(np.int64)) for v in (shard, rank, start, words)]
            cut = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=d.num_rows))))
            draws = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, DRAWS.elementType.names))
            taken = pa.array(np.bincount(row, words, d.num_rows).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*d.columns[:own_columns], taken, draws], names=schema.names)

    return at.select(*keep).mapInArrow(draw, schema)


def mix_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, n_shards (that take words of it) and draws_sha256 (of its
    draws as shard:rank:start:n, in their order)."""
    lines = F.transform("draws", lambda d: F.concat_ws(":", d["shard"], d["rank"], d["start"], d["n"]))
    shards = F.size(F.array_distinct(F.transform("draws", lambda d: d["shard"]))).cast("long")
    return mix(docs, id_col, **options).select(id_col, "size", "source_size", "target", "taken", shards.alias("n_shards"), F.sha2(F.array_join(lines, ","), 256).alias("draws_sha256"))


def shuffled_shards(mixed: DataFrame, id_col: str = "doc_id", seed: int = 7) -> DataFrame:
    """The mix as shards: (shard, id, source, start, n) of each draw, each shard shuffled by itself. Partitions
    are split by shard and a part of its draws, so a large shard is not one task's."""
    d = mixed.select(id_col, "source", F.explode("draws").alias("d")).select("d.shard", id_col, "source", "d.start", "d.n", F.xxhash64(F.lit(seed), F.col(id_col), F.col("d.rank")).alias("_h"))
    return d.repartitionByRange("shard", "_h").sortWithinPartitions("shard", "_h").drop("_h")
