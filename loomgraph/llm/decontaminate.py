"""Benchmark decontamination through a distributed positional inverted index.

The index is partitioned by document: a segment covers one run of documents and stores, for each term that a
benchmark item uses, the sorted positions of its occurrences (a document's words follow the last document's,
with a gap no phrase crosses). A phrase is found by intersecting offset-adjusted position lists, from the term
that is rarest in the whole corpus to the commonest; a proximity match needs an item's rarest terms near each
other. Nothing but term counts is shuffled, so a passage or word that a third of the documents share costs each
segment its own occurrences only.

The benchmark is a query set against all rows. Spark cuts it into distinct windows and deals them, by their own
hash, into blocks of about ``block_windows``; a block is a few integer arrays on the driver and in a task, however
long an item is. Each block has an index of the terms it asks for and of no others, so neither its dictionary nor its
postings grow with the benchmark, and the blocks' results meet row by row.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, lower_ascii, row_keyed, staged


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def build_index(docs: DataFrame, terms: list[bytes], gap: int, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 32 << 20) -> DataFrame:
    """Stored segments (ids, sizes, terms, counts, positions): the postings of the given terms over all docs.

    terms are term numbers into the given list; positions are the zlib-packed int32 steps between the occurrences
    of each term in turn. sizes are the documents' lengths in words."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("positions", T.BinaryType()),
        ]
    )
    number = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(terms)})

    def segment(ids: list, sizes: list[int], streams: list[np.ndarray]) -> pa.RecordBatch:
        start = np.cumsum([0, *(n + gap for n in sizes)])
        at = np.concatenate([s + np.flatnonzero(x >= 0) for s, x in zip(start, streams)] or [np.empty(0, np.int64)])
        of = np.concatenate([x[x >= 0] for x in streams] or [np.empty(0, np.int32)])
        order = np.argsort(of, kind="stable")
        used, counts = np.unique(of, return_counts=True)
        steps = np.diff(at[order], prepend=0).astype(np.int32)
        columns = [[pa.concat_arrays(ids).to_pylist()], [sizes], [used.tolist()], [counts.tolist()], [zlib.compress(steps.tobytes(), 1)]]
        types = [pa.list_(ids[0].type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.value.get
        ids, sizes, streams, held = [], [], [], 0
        for b in batches:
            for k, text in enumerate(b.column(1).cast(pa.binary())):
                text = text.as_py()
                words = words_of(text)
                ids.append(b.column(0).slice(k, 1))
                sizes.append(len(words))
                streams.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                held += len(text or b"") + 64
                if held >= segment_bytes:
                    yield segment(ids, sizes, streams)
                    ids, sizes, streams, held = [], [], [], 0
        if ids:
            yield segment(ids, sizes, streams)

    return staged(docs.select(id_col, text_col).mapInArrow(run, schema), "postings")


class Segment:
    """One segment in memory: document starts and sorted positions by term."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, packed: bytes, gap: int):
        self.sizes = sizes
        self.start = np.concatenate(([0], np.cumsum(sizes + gap)))
        at = np.cumsum(np.frombuffer(zlib.decompress(packed), np.int32).astype(np.int64))
        self.positions = dict(zip(terms.tolist(), np.split(at, np.cumsum(counts)[:-1]))) if len(terms) else {}

    def phrase(self, terms: list[tuple[int, int]]) -> np.ndarray:
        """Starts of a phrase given as (term, offset), the rarest first."""
        found = None
        for term, offset in terms:
            p = self.positions.get(term)
            if p is None:
                return np.empty(0, np.int64)
            if found is None:
                found = p - offset
            else:
                k = np.searchsorted(p, found + offset)
                found = found[(k < len(p)) & (p[np.minimum(k, len(p) - 1)] == found + offset)]
            if not len(found):
                break
        return found

    def near(self, terms: list[int], slop: int) -> np.ndarray:
        """Positions of the first term that have every other term within ``slop`` words."""
        found = self.positions.get(terms[0], np.empty(0, np.int64))
        for term in terms[1:]:
            p = self.positions.get(term)
            if p is None or not len(found):
                return np.empty(0, np.int64)
            k = np.searchsorted(p, found)
            after = np.abs(p[np.minimum(k, len(p) - 1)] - found)
            before = np.abs(p[np.maximum(k - 1, 0)] - found)
            found = found[np.minimum(after, before) <= slop]
        return found

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1


def windows_of(items: list[tuple[str, list[bytes]]], width: int) -> dict[tuple[bytes, ...], list[str]]:
    """Each distinct window with the items that have it; a short item is one window. For tests and small benchmarks."""
    out = defaultdict(list)
    for item, words in items:
        for i in range(max(1, len(words) - width + 1) if words else 0):
            out[tuple(words[i : i + width])].append(item)
    return out


def word_list(text: Column) -> Column:
    """words_of as a column."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


@dataclass
class Asked:
    """A block of windows as integers: words (a row of term numbers each, -1 beyond a short window), order (places from
    the rarest term on), and the items of window i at items[cut[i]:cut[i + 1]]. Rows are sorted by their rarest term."""

    words: np.ndarray
    order: np.ndarray
    sizes: np.ndarray
    cut: np.ndarray
    items: np.ndarray
    names: list[str]


def asked_block(windows: pa.Table, terms: pa.Array, counts: np.ndarray, width: int) -> Asked:
    """windows (window, items) of one block; those with a term that no document has are left out."""
    lists = windows.column("window").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.index_in(lists.flatten(), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int32)
    words = np.full((len(sizes), width), -1, np.int32)
    words[np.arange(width)[None] < sizes[:, None]] = flat
    n = np.where(words >= 0, np.append(counts, 0)[words], np.iinfo(np.int64).max)
    order = np.lexsort((words, n), axis=1).astype(np.int16)
    first = words[np.arange(len(words)), order[:, 0]] if len(words) else np.empty(0, np.int32)
    kept = np.argsort(first, kind="stable")
    kept = kept[(n[kept] > 0).all(axis=1)]
    held = windows.column("items").combine_chunks().take(pa.array(kept))
    names, of = np.unique(held.flatten().to_numpy(zero_copy_only=False).astype(object), return_inverse=True) if len(kept) else ([], np.empty(0, int))
    cut = np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return Asked(words[kept], order[kept], sizes[kept], cut, of.astype(np.int32), list(names))


def _matches(index: DataFrame, block: Asked, nearby: list, gap: int, slop: int, kind: T.DataType, every: bool) -> DataFrame:
    """(id, n_words, hits, items, near) for every document of the index, or only for those with a match."""
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_words", T.LongType()),
            T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("near", T.ArrayType(T.StringType())),
        ]
    )
    plain = (block.words, block.order, block.sizes, block.cut, block.items, block.names)  # no class of ours, which executors may lack
    asked = index.sparkSession.sparkContext.broadcast((plain, nearby))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, near_by_term = Asked(*asked.value[0]), defaultdict(list)
        for terms, item in asked.value[1]:
            near_by_term[terms[0]].append((terms, item))
        rarest = block.words[np.arange(len(block.words)), block.order[:, 0]] if len(block.words) else np.empty(0, np.int32)
        for b in batches:
            for k in range(b.num_rows):
                sizes, used, counts = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                s = Segment(sizes, used, counts, b.column(4)[k].as_py(), gap)
                edge = np.zeros(int(s.start[-1]) + 1, np.int32)
                items, near = defaultdict(set), defaultdict(set)
                lo, hi = np.searchsorted(rarest, used), np.searchsorted(rarest, used, "right")
                for w in np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange((hi - lo).sum()) if len(used) else ():
                    n, order = int(block.sizes[w]), block.order[w]
                    at = s.phrase([(int(block.words[w, o]), int(o)) for o in order[:n]])
                    if len(at):
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + n, -1)
                        names = block.items[block.cut[w] : block.cut[w + 1]].tolist()
                        for d in np.unique(s.docs(at)).tolist():
                            items[d].update(names)
                for t in used.tolist() if near_by_term else ():
                    for terms, name in near_by_term.get(t, ()):
                        for d in np.unique(s.docs(s.near(terms, slop))).tolist():
                            near[d].add(name)
                step = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
                begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                hits = defaultdict(list)
                for d, x, y in zip(s.docs(begin).tolist(), begin.tolist(), end.tolist()):
                    hits[d].append({"start": x - int(s.start[d]), "end": y - int(s.start[d])})
                n = range(len(sizes)) if every else sorted({*hits, *near})
                rows = pa.array(n, pa.int64())
                columns = [b.column(0)[k].values.take(rows), pa.array(sizes, pa.int64()).take(rows), pa.array([hits.get(d, []) for d in n], HITS)]
                columns += [pa.array([sorted(block.names[x] for x in items.get(d, ())) for d in n], pa.list_(pa.string())), pa.array([sorted(near.get(d, ())) for d in n], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return index.mapInArrow(run, schema)


HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    width: int = 10,
    slop: int = 40,
    near_terms: int = 5,
    block_windows: int = 200_000,
) -> DataFrame:
    """One row per input row: id, n_words, hits (merged word ranges inside exact matches), items and near (ids as
    strings, sorted; near: the item's ``near_terms`` rarest terms lie within ``slop`` words of the rarest).

    Null and empty texts have no words and no matches; items without words match nothing; a null item id is
    written as an empty string. Items that repeat an id count once. Repeated document rows give repeated rows.
    An empty benchmark leaves every document clean; other columns are not read. The driver and each task hold one block:
    ``block_windows`` windows as integers (30 bytes of each of 10 words), as many items, and the distinct terms of
    those. Each block reads the texts once. The result is the same for every block size.
    """
    gap, kind = max(width, slop) + 1, docs.schema[id_col].dataType
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), word_list(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = staged(items, "benchmark-words")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("window"))
    windows = staged(cut.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items")), "benchmark-windows")
    blocks = max(1, math.ceil(max(windows.count(), items.count()) / block_windows))
    key = id_col
    if blocks > 1:  # rows are numbered once, so that the blocks' results meet by row
        docs, row = row_keyed(docs)
        docs, key = docs.select(F.struct(F.col(id_col).alias("id"), F.col(row).alias("row")).alias("_key"), F.col(text_col)), "_key"
        kind = docs.schema[key].dataType
    own = lambda df, c, k: df if blocks == 1 else df.where(F.pmod(F.xxhash64(*c), F.lit(blocks)) == k)
    parts = [_block(docs, own(windows, ["window"], k), own(items, ["item", "words"], k), key, text_col, kind, width, slop, near_terms, gap, blocks == 1) for k in range(blocks)]
    if blocks == 1:
        return parts[0][0]
    index = parts[0][1]
    every = index.select(F.explode(F.arrays_zip("ids", "sizes")).alias("x")).select(F.col("x.ids").alias(key), F.col("x.sizes").alias("n_words"))
    found = staged(_merged([p for p, _ in parts], key).withColumnRenamed(key, "_found"), "blocks-merged")
    empty = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    out = every.join(found, F.col(f"{key}.row") == F.col("_found.row"), "left")
    return out.select(F.col(f"{key}.id").alias(id_col), "n_words", *[empty(c) for c in ("hits", "items", "near")])


def _block(docs: DataFrame, windows: DataFrame, items: DataFrame, key: str, text_col: str, kind: T.DataType, width: int, slop: int, near_terms: int, gap: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """The matches of one block of windows (window, items) and items (item, words), and the index of its terms."""
    used = windows.select(F.explode("window").alias("term")).union(items.select(F.explode("words")))
    terms = used.distinct().orderBy("term").toArrow().column(0).combine_chunks()
    index = build_index(docs, [t.encode() for t in terms.to_pylist()], gap, key, text_col)
    zipped = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("x.*")
    summed = zipped.groupBy("terms").agg(F.sum("counts").alias("n")).toArrow()
    counts = np.zeros(len(terms), np.int64)
    counts[summed.column("terms").to_numpy()] = summed.column("n").to_numpy()
    number = dict(zip(terms.to_pylist(), range(len(terms))))
    rank = lambda t: (int(counts[t]), t)
    distinct = items.select("item", F.array_distinct("words").alias("words")).toArrow()
    nearby = [(sorted((number[w] for w in words.as_py()), key=rank)[:near_terms], item.as_py()) for item, words in zip(distinct.column(0), distinct.column(1))]
    block = asked_block(windows.toArrow(), terms, counts, width)
    return _matches(index, block, nearby, gap, slop, kind, every).withColumnRenamed("id", key), index


def _merged(parts: list[DataFrame], key: str) -> DataFrame:
    """Blocks' results by row."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    flat = lambda c: F.flatten(F.collect_list(c))
    found = every.groupBy(key).agg(flat("hits").alias("hits"), *[F.array_sort(F.array_distinct(flat(c))).alias(c) for c in ("items", "near")])
    spans = "array<struct<start:bigint,end:bigint>>"

    def join(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.named_struct(F.lit("start"), last["start"], F.lit("end"), F.greatest(last["end"], x["end"]))
        grown = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), grown).otherwise(F.concat(acc, F.array(x))).cast(spans)

    hits = F.aggregate(F.array_sort("hits"), F.array().cast(spans), join)
    return found.select(key, hits.alias("hits"), "items", "near")


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return contamination(docs, benchmark, id_col, **options).select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def brute_force(texts: dict, items: dict, width: int = 10) -> dict:
    """doc to (n_words, n_hit, items, sha256), by looking for every window at every place. For tests."""
    out = {}
    asked = {k: windows_of([(str(k), words_of((t or "").encode()))], width) for k, t in items.items()}
    for d, text in texts.items():
        words, hit, names = words_of((text or "").encode()), set(), set()
        for k, ws in asked.items():
            for w in ws:
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        names.add(str(k))
        out[d] = (len(words), len(hit), sorted(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return out
