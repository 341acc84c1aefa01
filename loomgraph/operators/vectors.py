"""Nearest neighbours, linking and triage."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.replies import json_object, own_object
from ..staging import split_join, staged

#: The predicates that an edge may have; fixed values.
PREDICATES = (
    "is_a",
    "part_of",
    "related_to",
    "contradicts",
    "supports",
    "provides_methodology_for",
    "exemplifies",
    "derives_from",
    "influences",
    "precedes",
    "co_occurs_with",
    "subsumes",
)


#: Blocks a side of a cell: blocks meet in cells of so many by so many, so each is shipped once a cell, not once a partner.
CELL = 8
#: Vectors in a block: a block pair is one numpy product, of 2048 x 2048 doubles at most (32 MB).
BLOCK = 2048


def packed(df: DataFrame, id_col: str, rows: int, n: int | None = None) -> tuple[DataFrame, int]:
    """df (id, embedding) as blocks of about ``rows`` rows: (block, ids array, flat array of all components), and the
    number of blocks."""
    blocks = max(1, -(-(df.count() if n is None else n) // rows))
    deal = F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("int")
    lists = df.select(deal.alias("block"), F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return lists.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("block", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat")), blocks


def matrix(batch: pa.RecordBatch, k: int, ids: str, flat: str) -> tuple[pa.Array, np.ndarray]:
    names = batch.column(ids)[k].values
    return names, batch.column(flat)[k].values.to_numpy(zero_copy_only=False).reshape(len(names), -1)


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_col: str = "cand", rows: int = BLOCK) -> DataFrame:
    """queries (query_col, embedding) against vectors (id, embedding): (query_col, id, d2, cosine, rank) of the k
    nearest by L2, exactly, equal distances by id. Rows without a vector are left out.

    A query set against all rows in blocks of ``rows``: each pair of blocks is one matrix product, which proposes; the
    k best of each query in a block are settled by the plain sum of squares, and the last step ranks those few."""
    queries, vectors = queries.where("embedding is not null"), vectors.where("embedding is not null")
    q, n_q = packed(queries, query_col, rows)
    v, n_v = packed(vectors, "id", rows)
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // CELL)))
    left = q.select(F.floor(F.col("block") / CELL).cast("int").alias("row"), cells(n_v).alias("column"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    right = v.select(F.floor(F.col("block") / CELL).cast("int").alias("column"), cells(n_q).alias("row"), "ids", "flat", "block")
    pairs = left.join(right, ["row", "column"]).select("q_ids", "q_flat", "ids", "flat", "block")
    kind = lambda df, c: df.schema[c].dataType
    schema = T.StructType([T.StructField(query_col, kind(queries, query_col)), T.StructField("id", kind(vectors, "id")), T.StructField("d2", T.DoubleType()), T.StructField("block", T.IntegerType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (qi, x), (vi, y) = matrix(b, r, "q_ids", "q_flat"), matrix(b, r, "ids", "flat")
                near = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
                few = min(k, len(vi))
                least = np.partition(near, few - 1, axis=1)[:, few - 1]
                i, j = np.nonzero(near <= (least + 1e-9 * (1 + np.abs(least)))[:, None])
                d2 = ((x[i] - y[j]) ** 2).sum(1)
                place = np.empty(len(vi), np.int64)
                place[np.argsort(vi.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(vi))
                order = np.lexsort((place[j], d2, i))
                i, j, d2 = i[order], j[order], d2[order]
                good = np.arange(len(i)) - np.searchsorted(i, i) < k
                columns = [qi.take(pa.array(i[good])), vi.take(pa.array(j[good])), pa.array(d2[good]), pa.array(np.full(int(good.sum()), b.column("block")[r].as_py()), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    few = pairs.mapInArrow(compare, schema)
    rank = F.row_number().over(W.partitionBy(query_col).orderBy("d2", "id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= k).select(query_col, "id", "d2", (1 - F.col("d2") / 2).alias("cosine"), "rank")


def find_neighbors(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = 0.5, self_takes_slot: bool = False) -> DataFrame:
    """(id, neighbor, cosine, rank): nearest other vectors of each vector, of cosine ``least`` or more, k at most.
    With ``self_takes_slot`` the vector itself is one of the k asked for."""
    near = knn(queries.select(F.col("id").alias("query"), "embedding"), vectors, k if self_takes_slot else k + 1, "query")
    near = near.where((F.col("id") != F.col("query")) & (F.col("cosine") >= least))
    rank = F.row_number().over(W.partitionBy("query").orderBy("rank"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("id"), F.col("id").alias("neighbor"), "cosine", "rank")


def block_pairs(blocks: DataFrame, n: int) -> DataFrame:
    """blocks (block, ids, flat) with each other: (a_ids, a_flat, ids, flat, same), every unordered pair once."""
    own, last = F.floor(F.col("block") / CELL).cast("int"), F.lit((n - 1) // CELL)
    left = blocks.select(own.alias("row"), F.explode(F.sequence(own, last)).alias("column"), F.col("block").alias("a"), F.col("ids").alias("a_ids"), F.col("flat").alias("a_flat"))
    right = blocks.select(own.alias("column"), F.explode(F.sequence(F.lit(0), own)).alias("row"), F.col("block").alias("b"), "ids", "flat")
    met = left.join(right, ["row", "column"]).where("a <= b")
    return met.select("a_ids", "a_flat", "ids", "flat", (F.col("a") == F.col("b")).alias("same"))


def threshold_pairs(vectors: DataFrame, least: float, rows: int = BLOCK) -> DataFrame:
    """(a, b, cosine), a < b: all pairs of unit vectors (id, embedding) of cosine ``least`` or more, exactly.

    Blocks have ``rows`` rows however many there are, and a block pair is one matrix product; what it proposes is
    settled by the plain sum of products."""
    vectors = vectors.where("embedding is not null")
    blocks, n = packed(vectors, "id", rows)
    kind = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("cosine", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (ai, x), (bi, y) = matrix(b, r, "a_ids", "a_flat"), matrix(b, r, "ids", "flat")
                i, j = np.nonzero(x @ y.T >= least - 1e-9)
                c = (x[i] * y[j]).sum(1)
                one, two = ai.to_numpy(zero_copy_only=False)[i], bi.to_numpy(zero_copy_only=False)[j]
                good = (c >= least) & ((one < two) if b.column("same")[r].as_py() else (one != two))
                swap = one > two
                a, z = np.where(swap, two, one), np.where(swap, one, two)
                yield pa.RecordBatch.from_arrays([pa.array(a[good], ai.type), pa.array(z[good], bi.type), pa.array(c[good])], names=schema.names)

    return block_pairs(staged(blocks, "vector-blocks"), n).mapInArrow(compare, schema)


def propose_edges(replies: DataFrame, known: DataFrame, least: float | None = None) -> DataFrame:
    """replies (source, document_id, reply) to edges: targets by known name, predicates of the vocabulary,
    confidence a number within 0 to 1 (1 if it isn't one; below ``least`` dropped). A reply may have its JSON object
    in a fence or among other words, or be a bare list of edges; one without any gives none."""
    one = "struct<target:string,predicate:string,confidence:string>"
    replies = replies.withColumn("own", own_object(F.col("reply")))
    repaired = F.from_json(json_object(F.col("reply"), F.col("own")), f"struct<edges:array<{one}>,items:array<{one}>>")
    parsed = replies.select("source", "document_id", repaired.alias("r")).select("source", "document_id", F.explode(F.coalesce("r.edges", "r.items")).alias("e"))
    confidence = F.least(F.greatest(F.coalesce(F.expr("try_cast(e.confidence AS double)"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    edges = parsed.select("source", "document_id", F.col("e.target").alias("name"), F.col("e.predicate").alias("predicate"), confidence.alias("confidence"))
    edges = edges.where(F.col("predicate").isin(*PREDICATES)).join(known, "name").select("source", F.col("id").alias("target"), "predicate", "confidence", "document_id")
    return edges if least is None else edges.where(F.col("confidence") >= least)


def triage(docs: DataFrame, doc_vectors: DataFrame, vectors: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, triaged, similarity): 1 if the nearest concept's cosine is ``least`` or more, or there is none to compare
    with; else -1."""
    near = knn(docs.select("id").join(doc_vectors, "id").select(F.col("id").alias("doc"), "embedding"), vectors, 1, "doc")
    best = near.select(F.col("doc").alias("id"), F.col("cosine").alias("similarity"))
    return docs.select("id").join(best, "id", "left").select("id", F.when(F.col("similarity").isNull() | (F.col("similarity") >= least), 1).otherwise(-1).alias("triaged"), "similarity")


def triage_batch(docs: DataFrame, source_type: str = "feed", limit: int = 50) -> DataFrame:
    """The next documents to triage, oldest first."""
    return docs.where((F.col("triaged") == 0) & (F.col("source_type") == source_type)).orderBy("created_at", "id").limit(limit)


def mock_embedding(text: Column, size: int = 384) -> Column:
    """A unit vector that depends on the text only: normals seeded by its SHA-256. For tests."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t):
            seed = int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "little")
            v = np.random.Generator(np.random.PCG64(seed)).standard_normal(size)
            return (v / np.linalg.norm(v)).tolist()

        return texts.map(one)

    return embed(text)


def mock_replies(prompts: DataFrame, canned: dict[str, str], default: str = "{}") -> DataFrame:
    """prompts (id, prompt) to (id, reply): the reply of the first key that the prompt holds. For tests."""
    out = F.lit(default)
    for key, reply in reversed(canned.items()):
        out = F.when(F.contains("prompt", F.lit(key)), reply).otherwise(out)
    return prompts.select("id", out.alias("reply"))


def _each_or_alone(call, rows: list) -> tuple[list, list]:
    """What call(rows) gives, one result a row; if it fails, the rows are tried one by one, and those that fail by themselves have
    None and their error."""
    try:
        got = list(call(rows))
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} results for {len(rows)} rows")
        return got, [None] * len(rows)
    except Exception:  # the function is the caller's: what it raises is unknown
        out, errors = [], []
        for row in rows:
            try:
                (one,), error = call([row]), None
            except Exception as e:
                one, error = None, f"{type(e).__name__}: {e}"
            out.append(one)
            errors.append(error)
        return out, errors


def ask(prompts: DataFrame, model, batch_rows: int = 32) -> DataFrame:
    """prompts (id, prompt) through model(list of prompts) -> list of replies, a batch at a time: (id, reply, error).

    A batch that fails is asked again row by row, so that only rows that fail have a null reply, and their error is
    there to be stored and asked again later (``quarantined``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies, errors = [], []
            for s in range(0, len(b), batch_rows):
                got, failed = _each_or_alone(model, b["prompt"].tolist()[s : s + batch_rows])
                replies, errors = replies + got, errors + failed
            yield pd.DataFrame({"id": b["id"], "reply": pd.Series(replies, b.index, dtype=object), "error": pd.Series(errors, b.index, dtype=object)})

    return prompts.select("id", "prompt").mapInPandas(run, f"id {prompts.schema['id'].dataType.simpleString()}, reply string, error string")


def quarantined(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers (id, reply, error) as those that came, and those to be seen and asked again."""
    return answers.where("error is null").drop("error"), answers.where("error is not null").select("id", "error")


def embed(texts: DataFrame, model, size: int, batch_rows: int = 64, keep_errors: bool = False) -> DataFrame:
    """texts (id, text) through model(list of texts) -> rows of ``size`` numbers: (id, embedding) of unit length; a zero
    row stays zero. A batch that fails is tried row by row; a row that fails, or has another size, is an error: the job's, or with
    ``keep_errors`` a row with a null embedding and a third column, error (see quarantined)."""

    def vectors_of(rows: list[str]) -> list[np.ndarray]:
        got = list(model(rows))
        v = [np.asarray(x, np.float64).reshape(size) for x in got]
        return [x / (np.linalg.norm(x) or 1.0) for x in v]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, errors = [], []
            for s in range(0, len(b), batch_rows):
                got, failed = _each_or_alone(vectors_of, [t or "" for t in b["text"].tolist()[s : s + batch_rows]])
                out, errors = out + got, errors + failed
            lost = [(i, e) for i, e in zip(b["id"], errors) if e]
            if lost and not keep_errors:
                raise ValueError(f"{len(lost)} of {len(b)} texts have no vector; the first, {lost[0][0]}: {lost[0][1]}")
            columns = {"id": b["id"], "embedding": pd.Series(out, b.index, dtype=object)}
            yield pd.DataFrame(columns | ({"error": pd.Series(errors, b.index, dtype=object)} if keep_errors else {}))

    kind = f"id {texts.schema['id'].dataType.simpleString()}, embedding array<double>"
    return texts.select("id", "text").mapInPandas(run, f"{kind}, error string" if keep_errors else kind)


def bands_for(least: float, recall: float, width: int) -> int:
    """How many bands of ``width`` signs find a pair of cosine ``least`` with a probability of ``recall``: one sign is equal with
    1 - angle / pi."""
    band = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** width
    return 1 if band >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - band)))


#: What moving a vector costs, counted in comparisons of two vectors: a fixed value, by which the width of bands is chosen.
MOVE = 5000


def band_width(n: int, least: float, recall: float, tile: int) -> int:
    """The width whose bands cost least over n vectors. Wide bands leave few strangers to compare, but at a low cosine need very
    many bands, each of which moves every vector: into its tile, and from there once a cell of its bucket."""

    def cost(width: int) -> float:
        bucket = n / 2**width
        return bands_for(least, recall, width) * (MOVE * (2 + bucket / (tile * CELL)) + bucket)

    return min(range(4, max(4, min(32, math.ceil(math.log2(max(n, 2) / 64)))) + 1), key=cost)


def sketches(vectors: DataFrame, width: int, bands: int, seed: int) -> DataFrame:
    """(id, embedding, keys array<long>, signs): for each band the signs of ``width`` seeded projections as a number, and all signs
    as bits."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("signs", T.BinaryType())])
    place = (1 << np.arange(width, dtype=np.int64)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                if planes is None:
                    planes = np.random.default_rng(seed).standard_normal((x.shape[1], bands * width))
                signs = (x @ planes) > 0
                keys = signs.reshape(len(x), bands, width).astype(np.int64) @ place
                at = pa.array(np.arange(len(x) + 1) * bands, pa.int32())
                bits = pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(at, pa.array(keys.ravel())), bits], names=schema.names)

    return vectors.mapInArrow(run, schema)


def sketch_pairs(vectors: DataFrame, least: float, recall: float = 0.95, width: int | None = None, seed: int = 11, tile: int = BLOCK) -> DataFrame:
    """(a, b, cosine), a < b: pairs of unit vectors (id, embedding) of cosine ``least`` or more, each found with a probability of
    ``recall`` at least, and none that isn't one. threshold_pairs finds all.

    Vectors whose signs agree in all of a band's projections are compared. Bands are as wide as costs least (band_width), and as
    many as the recall needs. Members of a bucket are dealt into tiles with their vectors, tiles meet two by two in cells, the
    product of the two vectors decides there, and a pair is handed on by the first band that both ends share: nothing but pairs
    that are near leaves a task."""
    vectors = staged(vectors.where("embedding is not null").select("id", "embedding"), "vectors")
    n = vectors.count()
    width = width or band_width(n, least, recall, tile)
    bands = bands_for(least, recall, width)
    rows = staged(sketches(vectors, width, bands, seed), "sketches")
    laid = rows.select("id", F.posexplode("keys").alias("band", "key"))
    sizes = laid.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = split_join(rows.select("id", "embedding", "signs", F.posexplode("keys").alias("band", "key")), sizes, ["band", "key"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    lists = dealt.groupBy("band", "key", "tile", "tiles").agg(F.collect_list(F.struct("id", "embedding", "signs")).alias("m"))
    packs = staged(lists.select("band", "key", "tile", "tiles", F.col("m.id").alias("ids"), F.flatten("m.embedding").alias("flat"), F.col("m.signs").alias("signs")), "sketch-tiles")
    own, last = F.floor(F.col("tile") / CELL).cast("int"), F.floor((F.col("tiles") - 1) / CELL).cast("int")
    side = lambda k: [F.col(c).alias(f"{c}{k}") for c in ("ids", "flat", "signs", "tile")]
    left = packs.select("band", "key", own.alias("row"), F.explode(F.sequence(own, last)).alias("column"), *side(1))
    right = packs.select("band", "key", own.alias("column"), F.explode(F.sequence(F.lit(0), own)).alias("row"), *side(2))
    met = left.join(right, ["band", "key", "row", "column"]).where("tile1 <= tile2").select("band", *(f"{c}{k}" for k in (1, 2) for c in ("ids", "flat", "signs")), (F.col("tile1") == F.col("tile2")).alias("same"))
    kind = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("cosine", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                band, same = batch.column("band")[r].as_py(), batch.column("same")[r].as_py()
                (ai, x), (bi, y) = matrix(batch, r, "ids1", "flat1"), matrix(batch, r, "ids2", "flat2")
                x, y = x.astype(np.float64), y.astype(np.float64)
                one, two = ai.to_numpy(zero_copy_only=False), bi.to_numpy(zero_copy_only=False)
                bits = [np.frombuffer(b"".join(batch.column(c)[r].as_py()), np.uint8).reshape(len(v), -1) for c, v in (("signs1", x), ("signs2", y))]
                g, h = (np.unpackbits(s, axis=1, count=bands * width).reshape(len(s), bands, width)[:, :band] for s in bits)
                for at in range(0, len(x), 64):  # a stripe at a time: in a tile of copies every pair is near
                    i, j = np.nonzero(x[at : at + 64] @ y.T >= least - 1e-9)
                    i += at
                    good = one[i] < two[j] if same else one[i] != two[j]
                    i, j = i[good], j[good]
                    c = (x[i] * y[j]).sum(1)
                    i, j, c = i[c >= least], j[c >= least], c[c >= least]
                    for t in range(band):  # another band has handed it on
                        new = (g[i, t] != h[j, t]).any(1)
                        i, j, c = i[new], j[new], c[new]
                    a, z = np.minimum(one[i], two[j]), np.maximum(one[i], two[j])
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(a, ai.type), pa.array(z, bi.type), pa.array(c)], names=schema.names)

    return met.mapInArrow(compare, schema)
