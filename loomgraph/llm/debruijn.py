"""Substring dedup by compaction of a de Bruijn graph over words.

The graph's edges are windows of ``k`` words, its nodes the k - 1 words that two windows share. A repeated passage is a path
of edges that several documents walk, and a path without branches is one thing however long it is: it has one set of
occurrences.

1. Each document is walked once. Its windows are cut into pieces where the window's minimizer (the least hash of a run of
   ``gram`` words in it) changes, so that equal passages are cut alike wherever they stand. A piece is a path of the graph
   already, named by a 128-bit digest of its words, and has its source coordinates: row, first window, windows.
2. Equal pieces are counted by their digests (partial sums first, so copies by the thousand are one row a task). Equal
   windows have equal minimizers, so a minimizer that only one document has cannot be in a repeat and is left out here.
3. Where a minimizer has several different pieces, they may share some of their windows. Source coordinates lead back to the
   words: for one occurrence of each such piece its windows become edges, each named by a digest of its words that is read
   there and then, with the words before and after it. Grouping by edge gives the earliest document and whether the nodes
   at its ends branch; a join takes that back, and edges of a piece between branching nodes are compacted into paths.
4. Paths go by piece to all occurrences, which gives spans in source coordinates, and the texts are cut by them.

Nothing rests on a short hash: minimizers only group, pieces and edges are told apart by 128-bit digests of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import row_keyed, split_join, staged

#: Words hashed at once, and the longest piece in windows: periodic texts have one minimizer from end to end.
WORDS_AT_ONCE, MOST_WINDOWS = 1 << 18, 64
LONGS = T.LongType()


class WordHashes(dict):
    """XXH64 of each word met; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n entries of x: a polynomial, made by doubling the run's length and adding one by n's bits."""
    power = lambda e: np.uint64(pow(0x9E3779B97F4A7C15, e, 1 << 64))
    out, size = x, 1
    for bit in bin(n)[3:]:
        out, size = out[: max(len(out) - size, 0)] * power(size) + out[size:], size * 2
        if bit == "1":
            out, size = out[: max(len(out) - 1, 0)] * power(1) + x[size:], size + 1
    return scrambled(out)


def run_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of n entries of x."""
    size = 1
    while size * 2 <= n:
        x, size = np.minimum(x[: max(len(x) - size, 0)], x[size:]), size * 2
    rest = n - size
    return np.minimum(x[: max(len(x) - rest, 0)], x[rest:]) if rest else x


def pieces_of(hashes: np.ndarray, begins: np.ndarray, k: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents whose words' hashes stand one after another: (document, first window's word, windows,
    minimizer). begins: where each document begins, and the end."""
    empty = np.empty(0, np.int64)
    least = run_least(run_hashes(hashes, gram), k - gram + 1)
    if not len(least):
        return empty, empty, empty, empty.astype(np.uint64)
    doc = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[: len(least)]
    inside = np.arange(len(least)) + k <= begins[doc + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, empty.astype(np.uint64)
    new = np.concatenate(([True], (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    parts = -(-size // MOST_WINDOWS)
    own = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(at[first], parts) + own * MOST_WINDOWS
    windows = np.minimum(np.repeat(size, parts) - own * MOST_WINDOWS, MOST_WINDOWS)
    return doc[start], start, windows, least[start]


def digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def pieces(docs: DataFrame, row: str, k: int, gram: int) -> DataFrame:
    """docs (row, id, text) to (row, id, least, piece, start, windows): the pieces of all texts."""
    schema = T.StructType(
        [docs.schema[row], docs.schema["id"], T.StructField("least", LONGS), T.StructField("piece", T.BinaryType()), T.StructField("start", LONGS), T.StructField("windows", LONGS)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = WordHashes()

        def cut(rows: pa.RecordBatch, numbers: list[int], texts: list[list[bytes]]) -> pa.RecordBatch:
            begins = np.cumsum([0, *map(len, texts)])
            hashes = np.fromiter((hash_of[w] for t in texts for w in t), np.uint64, begins[-1])
            doc, start, windows, least = pieces_of(hashes, begins, k, gram)
            joined = b" ".join(b" ".join(t) for t in texts)
            ends = np.cumsum(np.fromiter((len(w) for t in texts for w in t), np.int64, begins[-1]) + 1)
            lo, hi = np.concatenate(([0], ends))[start].tolist(), (ends[start + windows + k - 2] - 1).tolist()
            named = [digest(joined[a:b]) for a, b in zip(lo, hi)]
            of = rows.take(pa.array(np.array(numbers, np.int64)[doc]))
            columns = [pa.array(least.view(np.int64)), pa.array(named, pa.binary()), pa.array(start - begins[doc]), pa.array(windows)]
            return pa.RecordBatch.from_arrays([of.column(0), of.column(1), *columns], names=schema.names)

        for b in batches:
            rows, numbers, texts, held = b.select([0, 1]), [], [], 0
            for i, t in enumerate(b.column(2).cast(pa.binary())):
                words = (t.as_py() or b"").split()
                if len(words) >= k:
                    numbers.append(i)
                    texts.append(words)
                    held += len(words)
                if held >= WORDS_AT_ONCE:
                    yield cut(rows, numbers, texts)
                    numbers, texts, held = [], [], 0
            if texts:
                yield cut(rows, numbers, texts)

    return docs.select(row, "id", "text").mapInArrow(run, schema)


def packed(docs: DataFrame, row: str) -> DataFrame:
    """docs (row, id, text) as (row, id, packed): texts as zstandard frames, which are a good deal smaller to shuffle."""
    schema = T.StructType([docs.schema[row], docs.schema["id"], T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=1)
        for b in batches:
            frames = [small.compress(t.as_py() or b"") for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(frames, pa.binary())], names=schema.names)

    return docs.select(row, "id", "text").mapInArrow(run, schema)


def unpacked(frames: pa.Array) -> Iterator[bytes]:
    import zstandard

    whole = zstandard.ZstdDecompressor()
    return (whole.decompress(f.as_py()) for f in frames)


def ambiguous_edges(docs: DataFrame, asked: DataFrame, row: str, k: int) -> DataFrame:
    """(edge, piece, j, lo, hi, before, after) of the windows of the pieces in asked (row, piece, lo, hi, start, windows): the
    words at their source coordinates are read again. before and after are hashes of the words beside a window, null at an end."""
    struct = asked.groupBy(row).agg(F.collect_list(F.struct("piece", "start", "windows", "lo", "hi")).alias("asked"))
    kind = asked.schema["lo"].dataType
    schema = T.StructType(
        [T.StructField("edge", T.BinaryType()), T.StructField("piece", T.BinaryType()), T.StructField("j", LONGS), T.StructField("lo", kind), T.StructField("hi", kind), T.StructField("before", LONGS), T.StructField("after", LONGS)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside = lambda w: xxhash.xxh64_intdigest(w, 7) >> 1
        for b in batches:
            listed = b.column(1)
            flat, cut = listed.flatten(), listed.offsets.to_numpy()
            names, starts, sizes = flat.field("piece").to_pylist(), flat.field("start").to_pylist(), flat.field("windows").to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t in enumerate(unpacked(b.column(0))):
                words = t.split()
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
                joined = b" ".join(words)
                for p in range(cut[i] - cut[0], cut[i + 1] - cut[0]):
                    for j in range(sizes[p]):
                        at = starts[p] + j
                        out[0].append(digest(joined[ends[at - 1] if at else 0 : ends[at + k - 1] - 1]))
                        out[1].append(p)
                        out[2].append(j)
                        out[3].append(beside(words[at - 1]) if at else None)
                        out[4].append(beside(words[at + k]) if at + k < len(words) else None)
                if len(out[0]) >= 1 << 16 or i == b.num_rows - 1:
                    of = flat.take(pa.array(out[1], pa.int64()))
                    columns = [pa.array(out[0], pa.binary()), of.field("piece"), pa.array(out[2], pa.int64()), of.field("lo"), of.field("hi"), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    out = ([], [], [], [], [])

    return packed(docs, row).join(struct.hint("shuffle_hash"), row).select("packed", "asked").mapInArrow(run, schema)


def compacted(edges: DataFrame) -> DataFrame:
    """edges to (piece, paths array<(first, windows, source)>): runs of a piece's repeated edges without a branching node
    between them and with one earliest document, the source."""
    one = lambda c: F.min(F.coalesce(c, F.lit(-1))) == F.max(F.coalesce(c, F.lit(-1)))
    groups = edges.groupBy("edge").agg(F.min("lo").alias("source"), F.max("hi").alias("last"), one("before").alias("one_in"), one("after").alias("one_out"))
    repeated = split_join(edges.select("edge", "piece", "j", "hi"), groups.where("source < last").drop("last"), ["edge"]).where("source < hi")
    order = W.partitionBy("piece").orderBy("j")  # a piece has few windows
    joined = (F.lag("j").over(order) == F.col("j") - 1) & (F.lag("source").over(order) == F.col("source")) & F.lag("one_out").over(order) & F.col("one_in")
    steps = repeated.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    steps = steps.withColumn("path", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    paths = steps.groupBy("piece", "path").agg(F.min("j").alias("first"), F.count(F.lit(1)).alias("windows"), F.first("source").alias("source"))
    return paths.groupBy("piece").agg(F.collect_list(F.struct("first", "windows", "source")).alias("paths"))


def repeated_paths(docs: DataFrame, found: DataFrame, row: str, k: int) -> DataFrame:
    """(piece, paths) of the pieces (row, id, least, piece, start, windows), of minimizers that several documents have, that stand, in
    whole or in part, in an earlier document than some document that has them."""
    at = F.min(F.struct(row, "start")).alias("at")
    groups = staged(found.groupBy("least", "piece").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), at, F.first("windows").alias("windows")), "piece-groups")
    kinds = groups.groupBy("least").agg(F.count(F.lit(1)).alias("kinds"))
    groups = staged(split_join(groups, kinds, ["least"]), "repeated-pieces")
    whole = groups.where("kinds = 1").select("piece", F.array(F.struct(F.lit(0).cast("long").alias("first"), "windows", F.col("lo").alias("source"))).alias("paths"))
    asked = groups.where("kinds > 1").select(F.col("at")[row].alias(row), "piece", "lo", "hi", F.col("at")["start"].alias("start"), "windows")
    edges = staged(ambiguous_edges(docs, asked, row, k), "edges")
    return whole.unionByName(compacted(edges))


def repeated_spans(docs: DataFrame, row: str, k: int = 50, gram: int = 16) -> DataFrame:
    """(row, start, windows, source): windows of documents (row, id, text) that also start in a document of a smaller id,
    the least of them, as runs."""
    if not 1 <= gram <= k:
        raise ValueError("gram must be 1 to k")
    every = staged(pieces(docs, row, k, gram), "pieces")
    kept = F.min("id.id").alias("lo"), F.max("id.id").alias("hi"), F.max("id.none").alias("none")
    met = every.groupBy("least").agg(*kept).where("lo is not null and (lo < hi or none)")  # most minimizers are one document's
    found = staged(split_join(every, met.select("least"), ["least"], "left_semi"), "shared-pieces")
    paths = repeated_paths(docs, found, row, k)
    spans = split_join(found.select(row, "id", "piece", "start"), paths, ["piece"]).select(row, "id", "start", F.explode("paths").alias("path"))
    return spans.where("path.source < id").select(row, (F.col("start") + F.col("path.first")).alias("start"), F.col("path.windows").alias("windows"), F.col("path.source").alias("source"))


def without_repeats(docs: DataFrame, k: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 and, if asked for, kept: the words that stay, joined by a blank.

    A word goes if a window of k words that covers it has the words of a window in a row of a smaller id; what other rows lose
    is not looked at. Ids compare as their type does; a null id is larger than all others, and rows that share an id leave
    each other alone, as a row does its own repeats. Null, empty and short texts lose nothing. An empty table gives no
    rows and other columns are not read."""
    ordered = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")).alias("id")
    docs, row = row_keyed(docs.select(ordered, F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    spans = repeated_spans(docs, row, k, gram).groupBy(row).agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    spans = staged(spans, "repeated-spans")
    kind = docs.schema["id"].dataType["id"].dataType
    fields = [T.StructField(id_col, kind), T.StructField("n_words", LONGS), T.StructField("n_removed", LONGS), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*fields, T.StructField("kept", T.StringType())] if with_text else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for t, spans in zip(unpacked(b.column(1)), b.column(2)):
                words, gone = t.split(), 0
                if spans.is_valid:
                    start, windows = (spans.values.field(c).to_numpy() for c in ("start", "windows"))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + windows + k - 1, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    kept = b" ".join([words[i] for i in np.flatnonzero(stays).tolist()])
                else:
                    kept = b" ".join(words)
                for c, v in zip(out, (len(words), gone, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *([pa.array(out[3], pa.binary()).cast(pa.string())] if with_text else [])], names=schema.names)

    both = packed(docs, row).join(spans.hint("shuffle_hash"), row, "left")
    return both.select(F.col("id.id"), "packed", "spans").mapInArrow(run, schema)
