"""Target-distribution importance resampling by external sort-count.

One pass over the texts writes each document's features as a packed stream of bucket numbers, two bytes each, many documents
to a stream with the offsets at which they begin, in the shared folder. Counting sorts each stream and encodes its runs; only
(bucket, run length) leave a task, at most one pair a bucket. The gains of all buckets are one small array, and a second pass
over the streams gathers them and adds them up between the offsets (np.add.reduceat). Texts are read once and never shuffled.

The draw is exponential-race sampling without replacement: a seeded Gumbel number is added to each weight and the highest sums
are drawn. Ranks come from a range exchange: rows are numbered within their range, and the ranges' sizes give the offsets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, numbered, row_keyed, staged

MOST_BUCKETS = 1 << 16  # a bucket number has two bytes
#: A stream is closed at so many features or documents; a longer document is a stream by itself.
STREAM_FEATURES, STREAM_DOCS = 1 << 18, 4096


class Buckets(dict):
    """The bucket of each feature met, computed once; forgotten when there are too many."""

    def __init__(self, buckets: int, most: int = 1 << 18):
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.buckets
        return out


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def runs_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by a blank."""
    runs = list(words)
    for k in range(2, longest + 1):
        runs += [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    return runs


def streams(docs: DataFrame, id_col: str, text_col: str, buckets: int, longest: int = 1) -> DataFrame:
    """(ids, words, at, stream): documents with their numbers of words, the places where they begin in the stream, and the
    stream of uint16 buckets."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    longs = T.ArrayType(T.LongType())
    names = ["ids", "words", "at", "stream"]
    schema = T.StructType([T.StructField(c, k) for c, k in zip(names, (T.ArrayType(docs.schema[id_col].dataType), longs, longs, T.BinaryType()))])

    def listed(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def closed(ids: pa.Array, words: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        at = np.cumsum([0, *map(len, parts[:-1])])
        columns = [listed(ids), listed(pa.array(words, pa.int64())), listed(pa.array(at, pa.int64())), pa.array([np.concatenate(parts).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = Buckets(buckets)
        for b in batches:
            begin, held, words, parts = 0, 0, [], []
            for k, t in enumerate(b.column(1).cast(pa.binary())):
                found = words_of(t.as_py())
                words.append(len(found))
                found = runs_of(found, longest)
                parts.append(np.fromiter(map(bucket_of.__getitem__, found), "<u2", len(found)))
                held += len(found)
                if held >= STREAM_FEATURES or len(parts) >= STREAM_DOCS:
                    yield closed(b.column(0).slice(begin, len(parts)), words, parts)
                    begin, held, words, parts = k + 1, 0, [], []
            if parts:
                yield closed(b.column(0).slice(begin), words, parts)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a stream in order and how often each stands in it."""
    x = np.sort(stream)
    begin = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return x[begin].astype(np.int64), np.diff(np.append(begin, len(x)))


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all streams are in each bucket: one number a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for s in b.column(0):
                values, lengths = run_lengths(np.frombuffer(s.as_buffer(), "<u2"))
                total[values] += lengths
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in packed.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of target share over source share) by bucket, each count and total raised so that none is 0."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(packed: DataFrame, id_col: str, gains: np.ndarray) -> DataFrame:
    """(id, words, n_features, weight): gains gathered along the streams and added up between the offsets."""
    kind = packed.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(c, T.LongType()) for c in ("words", "n_features", "weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                gathered = gains[np.frombuffer(b.column(3)[k].as_buffer(), "<u2")]
                at = b.column(2)[k].values.to_numpy()
                sizes = np.diff(np.append(at, len(gathered)))
                some, out = sizes > 0, np.zeros(len(at), np.int64)  # reduceat gives a neighbour's value for an empty slice
                if some.any():
                    out[some] = np.add.reduceat(gathered, at[some])
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, b.column(1)[k].values, pa.array(sizes), pa.array(out)], names=schema.names)

    return packed.select("ids", "words", "at", "stream").mapInArrow(run, schema)


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel number) that sha256 of seed and id gives; a null id counts as empty."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(hexed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(F.lit(-1000) * F.log(-F.log(u))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    longest: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_features, weight, score and rank, all but the id long; rank is null where not drawn.

    Of the rows of ``least_words`` words or more, floor(percent of them) with the highest scores are drawn, ties to the smaller
    id, a null id last. Rows that repeat an id have its random number, and which of two rows equal in id and score comes
    first is arbitrary. Null and empty texts have no words and weigh 0. An empty target has all buckets alike; an empty
    table gives no rows; other columns are not read."""
    packed = staged(streams(docs, id_col, text_col, buckets, longest), "importance-streams")
    wanted = staged(streams(target.select(F.lit(0).cast("long").alias("id"), F.col(target_text_col).alias("text")), "id", "text", buckets, longest), "target-streams")
    gains = bucket_gains(bucket_counts(packed, buckets), bucket_counts(wanted, buckets))
    scored = weights(packed, id_col, gains).withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed))
    scored, row = row_keyed(staged(scored, "importance-scores"))
    enough = scored.where(F.col("words") >= least_words)
    ranked = numbered(enough, F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col(row))  # the row parts what ties
    draws = enough.count() * percent // 100
    out = [id_col, "n_features", "weight", "score"]
    ranked = ranked.select(*out, F.when(F.col("rank") <= draws, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(F.col("words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
