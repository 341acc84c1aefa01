"""Keyword, vector and hybrid search, and look-ups over typed edges."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.vectors import l2_squared
from ..staging import staged

#: Letters with marks and what they fold to; fixed values.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def query_phrases(query: str) -> list[str]:
    """The quoted phrases of a query: marks and the words AND, OR, NOT, NEAR go, the rest is split at blanks."""
    bare = re.sub(r'["*():^]', " ", query)
    return re.sub(r"(?i)\b(?:AND|OR|NOT|NEAR)\b", " ", bare).split()


def sanitized(query: Column) -> Column:
    """query_phrases for a column, as one string of quoted phrases; empty if nothing is left."""
    bare = F.regexp_replace(query, r'["*():^]', " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)\b(?:AND|OR|NOT|NEAR)\b", " "), r"\s+", " "))
    return F.when(bare == "", "").otherwise(F.concat(F.lit('"'), F.regexp_replace(bare, " ", '" "'), F.lit('"')))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without marks."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@dataclass(frozen=True)
class TextIndex:
    """A stored inverted index: postings (term, id, tf, places, len) in runs by term, and the corpus totals (n, avglen)."""

    postings: DataFrame
    totals: DataFrame


def posting_rows(docs: DataFrame, columns: tuple[str, ...], id_col: str = "id", most: int = 2_000_000) -> DataFrame:
    """The postings (term, id, tf, places, len) of all columns together, and a row without a term for each document.

    A document's postings are made where its text is read, so nothing is shuffled. Documents are taken in runs of up to ``most``
    tokens, one longer document at least, and a run's rows are in order of (term, place among the documents)."""
    gap, names = 1 << 40, [f"t{k}" for k, _ in enumerate(columns)]
    listed = docs.select(F.col(id_col).alias("id"), *[tokens(F.col(c)).alias(t) for c, t in zip(columns, names)])
    kind = T.StructField("id", listed.schema["id"].dataType)
    schema = T.StructType([T.StructField("term", T.StringType()), kind, T.StructField("tf", T.LongType()), T.StructField("places", T.ArrayType(T.LongType())), T.StructField("len", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, found = batch.num_rows, [batch.column(t) for t in names]
        sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in found]
        doc = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
        place = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + k * gap for k, s in enumerate(sizes)])
        words = pa.chunked_array([c.flatten().cast(pa.string()) for c in found]).combine_chunks().dictionary_encode()
        by_term = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(by_term), np.int64)
        rank[by_term] = np.arange(len(by_term))
        key = rank[words.indices.to_numpy()] * n + doc
        order = np.argsort(key, kind="stable")  # places of a column follow each other, and columns do
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(starts, len(key))
        of, length = key[starts] % max(n, 1), sum(sizes)
        terms = words.dictionary.take(pa.array(by_term[key[starts] // max(n, 1)]))
        own = np.arange(n)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.nulls(n, pa.string()), terms]),
                batch.column("id").take(pa.array(np.concatenate([own, of]))),
                pa.array(np.concatenate([own * 0, np.diff(ends)])),
                pa.ListArray.from_arrays(pa.array(np.concatenate([own * 0, ends]).astype(np.int32)), pa.array(place[order])),
                pa.array(np.concatenate([length, length[of]])),
            ],
            names=schema.names,
        )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.cumsum(sum(pc.list_value_length(batch.column(t)).to_numpy(zero_copy_only=False).astype(np.int64) for t in names))
            first = 0
            while first < batch.num_rows:
                before = held[first - 1] if first else 0
                last = max(int(np.searchsorted(held, before + most, side="right")), first + 1)
                yield run(batch.slice(first, last - first))
                first = last

    return listed.mapInArrow(runs, schema)


def text_index(docs: DataFrame, columns: tuple[str, ...] = ("title", "text", "annotation"), id_col: str = "id") -> TextIndex:
    """The index of all columns together, written once in the shared folder; searches read the terms they ask for.

    Each task writes the postings of the documents that it reads, in runs by term, so the pages of a file that lack a term are
    passed over by their statistics, and a term that every document has is spread as the documents are. places count on from
    column to column with a gap that no phrase crosses; len is the document's number of tokens. ids name one document each.
    An index that follows its documents is in text_segments."""
    rows = staged(posting_rows(docs, columns, id_col), "text-postings")
    totals = rows.where("term is null").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("avglen"))
    return TextIndex(rows.where("term is not null"), staged(totals, "text-totals"))


def keyword_search(index: TextIndex, query: str, limit: int | None = 20) -> DataFrame:
    """(id, score): documents that hold every phrase of the query, by BM25 over all columns together.

    Only the query's terms are read. A phrase of several tokens counts where its tokens' places follow each other. A
    phrase that repeats counts again; a query without phrases gives no rows."""
    folded = [re.findall(r"[^\W_]+", p.lower().translate(str.maketrans(MARKED, PLAIN))) for p in query_phrases(query)]
    folded = [p for p in folded if p]
    asked = index.postings
    if not folded:
        return asked.select("id", F.lit(0.0).alias("score")).limit(0)
    terms = sorted({t for p in folded for t in p})
    in_phrase = {t for p in folded if len(p) > 1 for t in p}
    rows = asked.where(F.col("term").isin(terms)).groupBy("id").agg(
        F.max("len").cast("double").alias("len"),
        *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{i}") for i, t in enumerate(terms)],
        *[F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"at_{i}") for i, t in enumerate(terms) if t in in_phrase],
    )

    def tf(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.coalesce(F.col(f"tf_{terms.index(phrase[0])}"), F.lit(0))
        shifted = lambda t, k: F.transform(f"at_{terms.index(t)}", lambda x: x - k)
        starts = [shifted(t, k) for k, t in enumerate(phrase)]
        met = starts[0]
        for other in starts[1:]:
            met = F.array_intersect(met, other)
        return F.coalesce(F.when(met.isNotNull(), F.size(met)), F.lit(0))

    k = range(len(folded))
    counted = rows.select("id", "len", *[tf(p).cast("double").alias(f"tf{i}") for i, p in enumerate(folded)])
    df = counted.agg(*[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in k])
    raw = [F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i in k]
    idf = [F.when(x <= 0, 1e-6).otherwise(x) for x in raw]
    norm = 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avglen"))
    score = sum(idf[i] * F.col(f"tf{i}") * 2.2 / (F.col(f"tf{i}") + norm) for i in k)
    every = counted.where(" AND ".join(f"tf{i} > 0" for i in k))
    found = every.join(F.broadcast(index.totals)).join(F.broadcast(df)).select("id", score.alias("score"))  # one row each
    return found if limit is None else found.orderBy(F.desc("score"), "id").limit(limit)


def vector_search(vectors: DataFrame, query: list[float], limit: int = 20, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the nearest vectors by L2, score 1 - d*d/2. What no document has is dropped by the caller after."""
    d2 = l2_squared(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    near = vectors.select(F.col(id_col).alias("id"), d2.alias("d2")).orderBy("d2", "id").limit(limit)
    return near.select("id", (1 - F.col("d2") / 2).alias("score"))


def fuse(lists: dict[str, DataFrame], limit: int | None = 20, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (id, score) lists: (id, rrf, score, match_type).

    match_type is the list's name, or 'hybrid' for a row of more than one; score is the row's highest. Equal sums
    keep the order of the lists, then of the ranks in them."""
    ranked = [
        df.select("id", "score", F.lit(name).alias("list"), F.lit(i).alias("place"), F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))
        for i, (name, df) in enumerate(lists.items())
    ]  # each list has at most the search's limit of rows
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    fused = both.groupBy("id").agg(
        F.sum(1 / (F.lit(float(k)) + F.col("rank"))).alias("rrf"),
        F.max("score").alias("score"),
        F.when(F.count_distinct("list") > 1, "hybrid").otherwise(F.min("list")).alias("match_type"),
        F.min(F.struct("place", "rank")).alias("seen"),
    )
    fused = fused.orderBy(F.desc("rrf"), "seen.place", "seen.rank")
    return (fused if limit is None else fused.limit(limit)).drop("seen")


def hybrid_search(index: TextIndex, docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int = 20) -> DataFrame:
    """Keyword and vector search, fused."""
    known = vector_search(vectors, vector, limit).join(docs.select("id"), "id", "left_semi")
    return fuse({"keyword": keyword_search(index, query, limit), "semantic": known}, limit)


def like_ascii(c: Column, part: str) -> Column:
    """SQL LIKE %part% that ignores the case of ASCII letters only; % and _ in part stay wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, upper, lower).like(f"%{part.translate(str.maketrans(upper, lower))}%")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end in ids (id). Two equi-joins rather than one on either end."""
    ends = ids.select("id").distinct()
    by = lambda c: edges.join(ends.withColumnRenamed("id", c), c, "left_semi")
    only_target = by("target").join(ends.withColumnRenamed("id", "source"), "source", "left_anti")
    return by("source").unionByName(only_target)


def knowledge_search(engrams: DataFrame, edges: DataFrame, query: str, n_engrams: int = 10, n_edges: int = 100) -> DataFrame:
    """Edges that touch the concepts whose name holds the query; if there are none, edges of that predicate."""
    found = engrams.where(like_ascii(F.col("canonical_name"), query)).orderBy("id").limit(n_engrams).select("id")
    none = found.agg((F.count(F.lit(1)) == 0).alias("none"))  # one row
    fallback = edges.where(F.col("predicate") == query).join(F.broadcast(none)).where("none").drop("none")
    return touching(edges, found).unionByName(fallback).orderBy(F.desc("confidence"), "id").limit(n_edges)


def named_edge_search(engrams: DataFrame, edges: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Edges either of whose ends has the query in its name, with both names, best first."""
    name = lambda c: engrams.select(F.col("id").alias(c), F.col("canonical_name").alias(f"{c}_name"))
    hits = engrams.where(like_ascii(F.col("canonical_name"), query)).select("id")
    return touching(edges, hits).join(name("source"), "source").join(name("target"), "target").orderBy(F.desc("confidence"), "id").limit(limit)


def named_engrams(engrams: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Concepts whose name holds the query, by name."""
    return engrams.where(like_ascii(F.col("canonical_name"), query)).orderBy("canonical_name", "id").limit(limit)


def named_edge_hits(engrams: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """One row for each end that matches: an edge whose ends both do comes twice."""
    hits = engrams.where(like_ascii(F.col("canonical_name"), query)).select(F.col("id").alias("hit"))
    by = lambda c: edges.join(hits, edges[c] == hits["hit"])
    return by("source").unionByName(by("target").where("source <> target"))


def edges_for(edges: DataFrame, engram_id, predicate: str | None = None, limit: int = 100) -> DataFrame:
    chosen = edges.where((F.col("source") == engram_id) | (F.col("target") == engram_id))
    chosen = chosen if predicate is None else chosen.where(F.col("predicate") == predicate)
    return chosen.orderBy(F.desc("confidence"), "id").limit(limit)


def edges_between(edges: DataFrame, a, b) -> DataFrame:
    ab = (F.col("source") == a) & (F.col("target") == b)
    return edges.where(ab | (F.col("source") == b) & (F.col("target") == a)).orderBy(F.desc("confidence"), "id")


def edges_by_predicate(edges: DataFrame, predicate: str, limit: int = 100) -> DataFrame:
    return edges.where(F.col("predicate") == predicate).orderBy(F.desc("confidence"), "id").limit(limit)


def synthesis_prompt(docs: DataFrame, ids: list, query: str, most: int = 10, chars: int = 2000) -> DataFrame:
    """One row (title, metadata, prompt) from chosen documents, in table order."""
    chosen = docs.where(F.col("id").isin(ids)).orderBy("id").limit(most)
    text = F.substring(F.coalesce(F.nullif("tidy_text", F.lit("")), "text"), 1, chars)
    line = F.concat_ws(": ", F.coalesce("title", F.lit("Untitled")), text)
    rows = chosen.agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("rows"))
    return rows.select(
        F.lit(f"Synthesis: {query[:100]}").alias("title"),
        F.to_json(F.struct(F.lit(query).alias("query"), F.transform("rows", lambda r: r["id"]).alias("ids"))).alias("metadata"),
        F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("prompt"),
    )
