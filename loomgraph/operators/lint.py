"""Checks of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import find_neighbors


def _issue(df: DataFrame, kind: str, severity: str, ids) -> DataFrame:
    return df.select(F.lit(kind).alias("issue_type"), F.array_sort(ids).alias("engram_ids"), F.lit(severity).alias("severity"))


def orphans(engrams: DataFrame, edges: DataFrame, limit: int | None = 50) -> DataFrame:
    """Concepts without an edge."""
    lone = engrams.join(edges.select(F.col("source").alias("id")), "id", "left_anti").join(edges.select(F.col("target").alias("id")), "id", "left_anti")
    lone = lone if limit is None else lone.orderBy("id").limit(limit)
    return _issue(lone, "orphan", "info", F.array("id"))


def contradictions(edges: DataFrame, limit: int | None = 20) -> DataFrame:
    """Directed pairs that both support and contradict."""
    has = lambda p: F.bool_or(F.col("predicate") == p)
    both = edges.where(F.col("predicate").isin("supports", "contradicts")).groupBy("source", "target").agg(has("supports").alias("s"), has("contradicts").alias("c")).where("s AND c")
    both = both if limit is None else both.orderBy("source", "target").limit(limit)
    return _issue(both, "contradiction", "error", F.array("source", "target"))


def missing_links(vectors: DataFrame, edges: DataFrame, most_vectors: int | None = 200, most_queries: int | None = 50, k: int = 3, most_distance: float = 0.3, limit: int | None = 20) -> DataFrame:
    """Close concepts without an edge either way. A report: the first ``most_queries`` of the first
    ``most_vectors`` are asked about; None for all of them."""
    first = lambda df, n: df if n is None else df.orderBy("id").limit(n)
    pool = first(vectors, most_vectors)
    near = find_neighbors(first(pool, most_queries), pool, k, -1.0, self_takes_slot=True)
    close = near.where(F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))) <= most_distance)
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    pairs = close.groupBy(*pair("id", "neighbor")).agg(F.max("cosine").alias("cosine"))
    free = pairs.join(edges.select(*pair("source", "target")), ["a", "b"], "left_anti")
    free = free if limit is None else free.orderBy(F.desc("cosine"), "a", "b").limit(limit)
    return _issue(free, "missing_link", "warning", F.array("a", "b"))


def new_issues(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Found issues that aren't open already; the key is the sorted ids and the type."""
    open_ = stored.where(~F.col("resolved")).select("issue_type", F.array_sort("engram_ids").alias("engram_ids"))
    return found.dropDuplicates(["issue_type", "engram_ids"]).join(open_, ["issue_type", "engram_ids"], "left_anti")


def resolve(stored: DataFrame, ids: list) -> DataFrame:
    return stored.withColumn("resolved", F.col("resolved") | F.col("id").isin(ids))


def duplicate_candidates(families: DataFrame) -> DataFrame:
    """Families to merge, as issues (an extension: this type is declared but nothing else makes it)."""
    members = families.groupBy("survivor").agg(F.collect_set("id").alias("ids"))
    return _issue(members, "duplicate_candidate", "warning", F.col("ids"))
