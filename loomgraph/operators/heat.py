"""Document activity, and the upkeep that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..staging import split_join
from .listing import is_draft


#: What the score counts up to: beyond these, more co-active documents or edges change nothing.
MOST_CO, MOST_EDGES = 5, 10


def _least(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, few): the n least values of each key as an array. A hot key sends n rows a task to the shuffle."""
    place = F.row_number().over(W.partitionBy(key).orderBy(value))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).groupBy(key).agg(F.collect_list(value).alias("few"))


def _union_size(links: DataFrame, few: DataFrame, most: int, name: str, besides_self: bool) -> DataFrame:
    """(id, name): how many different values a document's concepts have, ``most`` at most."""
    met = split_join(links, few, ["engram_id"]).groupBy("document_id").agg(F.array_distinct(F.flatten(F.collect_list("few"))).alias("all"))
    every = F.array_remove("all", F.col("document_id")) if besides_self else F.col("all")
    return met.select(F.col("document_id").alias("id"), F.least(F.size(every), F.lit(most)).cast("long").alias(name)).where(F.col(name) > 0)


def co_activity(docs: DataFrame, links: DataFrame, as_of: str, days: int = 30, most: int = MOST_CO) -> DataFrame:
    """(id, co_activity): other documents created in the last ``days`` (whole days) that share a concept, counted up to
    ``most``. Of each concept the ``most`` + 1 recent documents of least id are enough for that: if it has more, they
    reach ``most`` without the document itself. So a concept that everything has is one short row, not all its pairs."""
    fresh = docs.where(F.to_date("created_at") >= F.date_sub(F.to_date(F.lit(as_of)), days)).select(F.col("id").alias("other"))
    recent = links.join(fresh, links["document_id"] == fresh["other"]).select("engram_id", "other")
    return _union_size(links, _least(recent, "engram_id", "other", most + 1), most, "co_activity", True)


def edge_counts(links: DataFrame, edges: DataFrame, distinct: bool = True, most: int = MOST_EDGES) -> DataFrame:
    """(id, edge_count): edges that touch a concept of the document, counted up to ``most``, from the ``most`` of least id of
    each concept. Not distinct: one for each concept and edge that meet, from the concepts' degrees."""
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array_distinct(F.array("source", "target"))).alias("engram_id"))
    if distinct:
        return _union_size(links, _least(ends, "engram_id", "edge", most), most, "edge_count", False)
    degree = ends.groupBy("engram_id").agg(F.count(F.lit(1)).alias("n"))
    return split_join(links, degree, ["engram_id"]).groupBy(F.col("document_id").alias("id")).agg(F.least(F.sum("n"), F.lit(most)).alias("edge_count"))


def days_before(at: Column, as_of: str) -> Column:
    return (F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(at)) / 86400.0


def heat(docs: DataFrame, links: DataFrame, edges: DataFrame, as_of: str, variant: str = "standard") -> DataFrame:
    """(id, co_activity, edge_count, heat_score, heat_tier) of documents that aren't drafts; the counts stop where the
    score does.

    0.40 recency, 0.35 co-activity up to 5, 0.10 revisions and 0.15 edges up to 10. 'standard': recency from
    updated_at, never in the future, revision 1 counts as none, edges distinct. 'created': from created_at as it
    is, revision over 3, edges by concept, processed documents only."""
    plain = variant == "created"
    chosen = docs.where("processed > 0") if plain else docs.where(~is_draft())
    rows = chosen.join(co_activity(docs, links, as_of), "id", "left").join(edge_counts(links, edges, not plain), "id", "left").fillna(0, ["co_activity", "edge_count"])
    days = days_before(F.col("created_at" if plain else "updated_at"), as_of)
    days = days if plain else F.greatest(days, F.lit(0.0))
    revision = F.least(F.col("revision"), F.lit(3)) / 3.0 if plain else F.least((F.col("revision") - 1) / 3.0, F.lit(1.0))
    score = 0.40 * F.exp(-0.03 * days) + 0.35 * F.least(F.col("co_activity") / 5.0, F.lit(1.0)) + 0.10 * revision + 0.15 * F.least(F.col("edge_count") / 10.0, F.lit(1.0))
    scored = rows.withColumn("heat_score", F.least(score, F.lit(1.0)))
    return scored.select("id", "co_activity", "edge_count", "heat_score", heat_tier(F.col("heat_score")).alias("heat_tier"))


def heat_tier(score: Column) -> Column:
    return F.when(score >= 0.35, "active").when(score >= 0.12, "reference").otherwise("dormant")


def stale_articles(engrams: DataFrame, links: DataFrame, docs: DataFrame, least_docs: int = 2, limit: int = 5) -> DataFrame:
    """(id, canonical_name, doc_count) of concepts with documents newer than their article, or without one."""
    n = links.join(docs.select(F.col("id").alias("document_id"), "updated_at"), "document_id").groupBy("engram_id").agg(F.count(F.lit(1)).alias("doc_count"), F.max("updated_at").alias("newest"))
    rows = engrams.join(n.where(F.col("doc_count") >= least_docs), engrams["id"] == n["engram_id"])
    stale = rows.where(F.col("article").isNull() | F.col("article_updated_at").isNull() | (F.col("article_updated_at") < F.col("newest")))
    return stale.orderBy(F.desc("doc_count"), "id").limit(limit).select("id", "canonical_name", "doc_count")


def article_documents(links: DataFrame, docs: DataFrame, of: DataFrame, most: int = 20) -> DataFrame:
    """(engram_id, document_id, place): the newest documents of each concept in ``of`` (id)."""
    mine = links.join(of.select(F.col("id").alias("engram_id")), "engram_id", "left_semi").join(docs.select(F.col("id").alias("document_id"), "created_at"), "document_id")
    place = F.row_number().over(W.partitionBy("engram_id").orderBy(F.desc("created_at"), "document_id"))
    return mine.withColumn("place", place).where(F.col("place") <= most).select("engram_id", "document_id", "place")


def article_edges(edges: DataFrame, engrams: DataFrame, of: DataFrame, most: int = 30) -> DataFrame:
    """(engram_id, direction, predicate, confidence, other_name, place): the surest edges of each concept."""
    ids = of.select(F.col("id").alias("engram_id"))
    out = edges.join(ids, edges["source"] == ids["engram_id"]).select("engram_id", F.lit("out").alias("direction"), "predicate", "confidence", F.col("target").alias("other"), F.col("id").alias("edge"))
    back = edges.where("source <> target").join(ids, edges["target"] == ids["engram_id"]).select("engram_id", F.lit("in").alias("direction"), "predicate", "confidence", F.col("source").alias("other"), F.col("id").alias("edge"))
    place = F.row_number().over(W.partitionBy("engram_id").orderBy(F.desc("confidence"), "edge"))
    best = out.unionByName(back).withColumn("place", place).where(F.col("place") <= most)
    names = engrams.select(F.col("id").alias("other"), F.col("canonical_name").alias("other_name"))
    return best.join(names, "other").select("engram_id", "direction", "predicate", "confidence", "other_name", "place")


def article_prompt(documents: DataFrame, edges: DataFrame, engrams: DataFrame, budget: int = 2000) -> DataFrame:
    """(engram_id, prompt): name, edges as arrows with confidence in per cent, then document texts of at most
    ``budget`` characters together. documents: (engram_id, place, text)."""
    arrow = F.when(F.col("direction") == "out", F.lit("->")).otherwise(F.lit("<-"))
    line = F.concat(arrow, F.lit(" "), "predicate", F.lit(" "), "other_name", F.format_string(" (%.0f%%)", F.col("confidence") * 100))
    lines = edges.groupBy("engram_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("edges"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
    texts = documents.groupBy("engram_id").agg(F.substring(joined, 1, budget).alias("texts"))
    rows = engrams.select(F.col("id").alias("engram_id"), "canonical_name").join(texts, "engram_id").join(lines, "engram_id", "left")
    return rows.select("engram_id", F.concat_ws("\n\n", "canonical_name", "edges", "texts").alias("prompt"))
