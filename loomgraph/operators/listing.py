"""Listings and look-ups over documents, concepts, feeds and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import split_join


def is_draft(tidy: bool = True) -> Column:
    """A scribble not yet processed and, unless told otherwise, without tidy text."""
    draft = (F.col("source_type") == "scribble") & (F.col("processed") == 0)
    return draft & F.col("tidy_text").isNull() if tidy else draft


def display_title(default: str | None = None) -> Column:
    """The tidy title unless null or empty, else the title."""
    parts = [F.nullif(F.col("tidy_title"), F.lit("")), F.col("title")]
    return F.coalesce(*parts, F.lit(default)) if default else F.coalesce(*parts)


def concepts_of(links: DataFrame, engrams: DataFrame, by: str = "engram_id") -> DataFrame:
    """(document_id, engrams): each document's concepts as an array of (id, name), sorted by id or by name."""
    both = links.join(engrams.select(F.col("id").alias("engram_id"), F.col("canonical_name").alias("name")), "engram_id")
    first, second = ("engram_id", "name") if by == "engram_id" else ("name", "engram_id")
    packed = F.array_sort(F.collect_list(F.struct(first, second)))
    return both.groupBy("document_id").agg(F.transform(packed, lambda x: F.struct(x["engram_id"].alias("id"), x["name"].alias("name"))).alias("engrams"))


def with_concepts(docs: DataFrame, links: DataFrame, engrams: DataFrame, by: str = "engram_id") -> DataFrame:
    found = concepts_of(links, engrams, by)
    empty = F.array().cast(found.schema["engrams"].dataType)
    return docs.join(found, docs["id"] == found["document_id"], "left").drop("document_id").withColumn("engrams", F.coalesce("engrams", empty))


def recent(docs: DataFrame, as_of: str, days: int = 14, boundary: str = "day") -> DataFrame:
    """Documents created at most ``days`` before as_of. 'day': whole days, as when times are compared as text;
    'exact': to the instant."""
    if boundary == "day":
        return docs.where(F.to_date("created_at") >= F.date_sub(F.to_date(F.lit(as_of)), days))
    return docs.where(F.col("created_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS"))


def recent_documents(docs: DataFrame, links: DataFrame, engrams: DataFrame, as_of: str, days: int = 14, drafts: bool = False, by: str = "engram_id", boundary: str = "day") -> DataFrame:
    """Recent documents, newest first, each with its concepts."""
    chosen = recent(docs, as_of, days, boundary)
    chosen = chosen if drafts else chosen.where(~is_draft())
    return with_concepts(chosen, links, engrams, by).orderBy(F.desc("created_at"), "id")


def related_documents(docs: DataFrame, links: DataFrame, of: DataFrame, default: str | None = None) -> DataFrame:
    """(of_id, id, title) of other documents sharing a concept with each document in ``of`` (of_id)."""
    mine = links.join(of, links["document_id"] == of["of_id"]).select("of_id", "engram_id").distinct()
    other = links.select("engram_id", F.col("document_id").alias("id"))
    pairs = split_join(other, mine, ["engram_id"]).where("id <> of_id").select("of_id", "id").distinct()
    return pairs.join(docs.select("id", display_title(default).alias("title")), "id").select("of_id", "id", "title")


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def counted(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"))


def documents_of(links: DataFrame, docs: DataFrame, engram_id) -> DataFrame:
    """Documents that a concept occurs in."""
    return docs.join(links.where(F.col("engram_id") == engram_id).select(F.col("document_id").alias("id")), "id", "left_semi")


def edge_names(edges: DataFrame, engrams: DataFrame) -> DataFrame:
    """Edges with the names of both ends."""
    name = lambda c: engrams.select(F.col("id").alias(c), F.col("canonical_name").alias(f"{c}_name"))
    return edges.join(name("source"), "source").join(name("target"), "target")


def pending(docs: DataFrame, limit: int = 50) -> DataFrame:
    """The next documents to process: unprocessed and not rejected, oldest first; drafts are included."""
    return docs.where((F.col("processed") == 0) & (F.col("triaged") != -1)).orderBy("created_at", "id").limit(limit)


def tidy_scope(docs: DataFrame, scope: str, level: str = "full") -> DataFrame:
    """Documents to tidy again: all, those missing tidy fields, or those of another level."""
    if scope == "all":
        return docs
    if scope == "missing":
        return docs.where(F.col("tidy_title").isNull() | F.col("tidy_text").isNull())
    if scope == "mismatched":
        return docs.where(F.coalesce("tidy_level", F.lit("")) != level)
    raise ValueError(f"no such scope: {scope}")


def issues(rows: DataFrame, resolved: bool = False, kind: str | None = None, limit: int = 100) -> DataFrame:
    chosen = rows.where(F.col("resolved") == resolved)
    chosen = chosen if kind is None else chosen.where(F.col("issue_type") == kind)
    return chosen.orderBy(F.desc("created_at"), "id").limit(limit)


def growth_stage(n: Column) -> Column:
    return F.when(n == 0, "seed").when(n <= 10, "sprout").when(n <= 50, "sapling").when(n <= 200, "tree").otherwise("forest")


def companion(docs: DataFrame, engrams: DataFrame, edges: DataFrame, open_issues: DataFrame) -> DataFrame:
    """One row of totals, open issues by severity, a mood from them and a growth stage from the concepts."""
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    sev = lambda s: F.count_if(F.col("severity") == s)
    bad = open_issues.where(~F.col("resolved")).agg(*[sev(s).alias(f"n_{s}") for s in ("error", "warning", "info")])
    row = n(docs, "documents").join(n(engrams, "engrams")).join(n(edges, "edges")).join(bad)  # one row each
    mood = F.when(F.col("n_error") > 0, "distressed").when(F.col("n_warning") > 0, "uneasy").when(F.col("n_info") > 0, "curious").otherwise("content")
    return row.withColumn("mood", mood).withColumn("stage", growth_stage(F.col("engrams")))


#: Milestones in order: key, which total, how many.
MILESTONES = (("first_document", "documents", 1), ("ten_documents", "documents", 10), ("hundred_engrams", "engrams", 100), ("first_edge", "edges", 1), ("thousand_edges", "edges", 1000), ("ten_thousand_engrams", "engrams", 10_000))


def next_milestone(totals: DataFrame, achieved: DataFrame) -> DataFrame:
    """The first milestone reached and not achieved before, if any."""
    spark = totals.sparkSession
    marks = spark.createDataFrame([(i, *m) for i, m in enumerate(MILESTONES)], "place int, milestone string, total string, least long")
    long = totals.select(F.explode(F.create_map(*[x for c in ("documents", "engrams", "edges") for x in (F.lit(c), F.col(c))])).alias("total", "n"))
    return marks.join(long, "total").where("n >= least").join(achieved, "milestone", "left_anti").orderBy("place").limit(1).select("milestone", "n")


def time_ago(at: Column, as_of: str) -> Column:
    s = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(at)
    short = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(s < 60, short(s, "s")).when(s < 3600, short(s / 60, "m")).when(s < 86400, short(s / 3600, "h")).otherwise(short(s / 86400, "d"))


def processing_status(fallback_used: Column, chunk_failed: Column) -> Column:
    return F.when(F.coalesce(fallback_used, F.lit(False)) | (F.coalesce(chunk_failed, F.lit(0)) > 0), "partial").otherwise("completed")


ENGRAM_LIST = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))
