"""Changes to tables, each as a function from the old tables to the new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import alias_index, rewrite_edges

EDGE_KEY = ["source", "target", "predicate"]


def insert_new(stored: DataFrame, batch: DataFrame, key: str = "source_uri", order: str = "pos") -> DataFrame:
    """Rows of the batch to insert: keys that aren't stored, the first of each; rows without a key all go in."""
    keyed = batch.where(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r"))
    fresh = first.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(key, "r.*")
    return fresh.select(*batch.columns).unionByName(batch.where(F.col(key).isNull()))


def insert_edges(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """All edges after inserting a batch; the first writer of (source, target, predicate) stays."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in EDGE_KEY]
    return both.groupBy(*EDGE_KEY).agg(F.min_by(F.struct(*rest), F.struct("_new", "id")).alias("r")).select(*EDGE_KEY, "r.*").select(*stored.columns)


def upsert_edges(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """All edges after an upsert: a key keeps its row's id and time, and takes the last writer's confidence and document."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    keep = [c for c in stored.columns if c not in (*EDGE_KEY, "confidence", "document_id")]
    first, last = F.min_by(F.struct(*keep), F.struct("_new", "id")), F.max_by(F.struct("confidence", "document_id"), F.struct("_new", "id"))
    return both.groupBy(*EDGE_KEY).agg(first.alias("a"), last.alias("b")).select(*EDGE_KEY, "a.*", "b.*").select(*stored.columns)


def insert_links(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return stored.unionByName(batch).distinct()


def edit_documents(docs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits (id, new_text, new_annotation) to (revisions to append, documents after). A snapshot is taken before;
    then revision + 1, tidy fields cleared, a blank annotation null."""
    hit = docs.join(edits.select("id"), "id", "left_semi")
    title = F.coalesce(F.nullif("tidy_title", F.lit("")), "title")
    revisions = hit.select(F.col("id").alias("document_id"), "revision", "text", "annotation", title.alias("title"))
    both = docs.join(edits.withColumn("_hit", F.lit(True)), "id", "left")
    when = lambda new, old: F.when(F.col("_hit"), new).otherwise(F.col(old))
    after = both.withColumns(
        {
            "text": when(F.coalesce("new_text", "text"), "text"),
            "annotation": when(F.nullif(F.trim("new_annotation"), F.lit("")), "annotation"),
            "revision": when(F.col("revision") + 1, "revision"),
            **{c: when(F.lit(None).cast("string"), c) for c in ("tidy_title", "tidy_text", "tidy_level")},
        }
    )
    return revisions, after.select(*docs.columns)


def detach_documents(links: DataFrame, vectors: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links, document vectors and edges without those of the documents in ids (id)."""
    gone = lambda df, c: df.join(ids.select(F.col("id").alias(c)), c, "left_anti").select(*df.columns)
    return gone(links, "document_id"), gone(vectors, "id"), gone(edges, "document_id")


def delete_documents(docs: DataFrame, links: DataFrame, edges: DataFrame, engrams: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting documents: their links and edges go, then concepts that had a link to them and have no
    link and no edge left."""
    left = links.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    kept_edges = edges.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(*edges.columns)
    touched = links.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(F.col("engram_id").alias("id")).distinct()
    lone = touched.join(left.select(F.col("engram_id").alias("id")), "id", "left_anti")
    for end in ("source", "target"):
        lone = lone.join(kept_edges.select(F.col(end).alias("id")), "id", "left_anti")
    return {"documents": docs.join(ids, "id", "left_anti").select(*docs.columns), "links": left.select(*links.columns), "edges": kept_edges, "engrams": engrams.join(lone, "id", "left_anti").select(*engrams.columns), "orphans": lone}


def delete_engrams(engrams: DataFrame, links: DataFrame, edges: DataFrame, issues: DataFrame, ids: list) -> dict[str, DataFrame]:
    """Tables without the concepts, and open issues about them resolved. issues has engram_ids, an array."""
    gone = F.array(*map(F.lit, ids))
    return {
        "engrams": engrams.where(~F.col("id").isin(ids)),
        "links": links.where(~F.col("engram_id").isin(ids)),
        "edges": edges.where(~(F.col("source").isin(ids) | F.col("target").isin(ids))),
        "issues": issues.withColumn("resolved", F.col("resolved") | F.arrays_overlap("engram_ids", gone)),
    }


def delete_edge(edges: DataFrame, edge_id) -> DataFrame:
    return edges.where(F.col("id") != edge_id)


def edges_from_issues(issues: DataFrame, predicate: str = "related_to", confidence: float = 0.8) -> DataFrame:
    """An edge for each open missing_link issue (id, engram_ids)."""
    chosen = issues.where(~F.col("resolved") & (F.col("issue_type") == "missing_link"))
    return chosen.select("id", F.col("engram_ids")[0].alias("source"), F.col("engram_ids")[1].alias("target"), F.lit(predicate).alias("predicate"), F.lit(confidence).alias("confidence"))


def merge_engrams(links: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and edges with merged concepts (id, survivor) replaced, duplicates and loops dropped."""
    to = mapping.select(F.col("id").alias("engram_id"), "survivor")
    moved = links.join(to, "engram_id", "left").select("document_id", F.coalesce("survivor", "engram_id").alias("engram_id")).distinct()
    return moved, rewrite_edges(edges, mapping)


def revise(old: DataFrame, new: DataFrame, most_churn: float = 0.5) -> DataFrame:
    """old and new links (document_id, engram_id) to (document_id, added, removed, rebuild): rebuild if more than
    ``most_churn`` of the old (at least one) changes."""
    both = old.withColumn("o", F.lit(1)).join(new.withColumn("n", F.lit(1)), ["document_id", "engram_id"], "full_outer")
    counts = both.groupBy("document_id").agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count("o").alias("had"))
    return counts.select("document_id", "added", "removed", (F.col("added") + F.col("removed") > most_churn * F.greatest("had", F.lit(1))).alias("rebuild"))


def replace_projections(stored: DataFrame, batch: DataFrame, whole: bool = False) -> DataFrame:
    """The batch alone, or stored rows with those of the batch replaced (rows of concepts that are gone stay)."""
    return batch if whole else stored.join(batch.select("id"), "id", "left_anti").select(*stored.columns).unionByName(batch)


def mask(value: Column) -> Column:
    return F.concat(F.lit("****"), F.right(value, F.lit(4)))


def upsert_settings(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return stored.join(batch.select("key"), "key", "left_anti").select(*stored.columns).unionByName(batch)


def reset_documents(docs: DataFrame, triaged: bool = True) -> DataFrame:
    out = docs.withColumn("processed", F.lit(0))
    return out.withColumn("triaged", F.lit(0)) if triaged else out


def update_feed(feeds: DataFrame, feed_id, **fields) -> DataFrame:
    """Feeds with the given fields of one replaced; an error if there are none."""
    if not fields:
        raise ValueError("nothing to update")
    return feeds.withColumns({c: F.when(F.col("id") == feed_id, F.lit(v)).otherwise(F.col(c)) for c, v in fields.items()})


def merge_metadata(current: Column, updates: Column) -> Column:
    """Two maps joined; nulls among the updates are left out, updates win."""
    given = F.map_filter(updates, lambda k, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(current, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(kept, given)


def back_up(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")


def migrate(old: DataFrame, schema: DataFrame) -> DataFrame:
    """Rows of an older table in the new table's columns; missing ones are null."""
    return schema.limit(0).unionByName(old.select(*[c for c in old.columns if c in schema.columns]), allowMissingColumns=True)


def backfill_aliases(engrams: DataFrame, stored: DataFrame) -> DataFrame:
    """Alias rows for concepts that have none."""
    return alias_index(engrams.join(stored.select(F.col("engram_id").alias("id")), "id", "left_anti"))


def store_aliases(stored: DataFrame, engrams: DataFrame) -> DataFrame:
    """Stored alias rows and those of the concepts' names that aren't stored yet."""
    new = alias_index(engrams).join(stored.select("engram_id", "alias_key"), ["engram_id", "alias_key"], "left_anti")
    return stored.select("engram_id", "alias_key", "alias_kind").unionByName(new.select("engram_id", "alias_key", "alias_kind"))


def retidy(docs: DataFrame, results: DataFrame) -> DataFrame:
    """docs with the tidy fields of results (id, revision, tidy_title, tidy_text, tidy_level) where the revision is still the
    document's; a result of an older one changes nothing, and neither text nor graph is touched."""
    fields = ("tidy_title", "tidy_text", "tidy_level")
    new = results.select("id", "revision", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit")).dropDuplicates(["id", "revision"])
    both = docs.join(new, ["id", "revision"], "left")
    return both.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}).select(*docs.columns)


def materialize(prepared: DataFrame) -> DataFrame:
    """prepared (pos, engram_id, ...) to one row a concept, the first by pos."""
    rest = [c for c in prepared.columns if c != "engram_id"]
    return prepared.groupBy("engram_id").agg(F.min_by(F.struct(*rest), "pos").alias("r")).select("engram_id", "r.*").select(*prepared.columns)


def vector_sizes(tables: dict[str, DataFrame], size: int, column: str = "embedding") -> DataFrame:
    """(table, size, uneven, mismatch): the length of each table's vectors, whether they differ among themselves, and whether they
    must be made anew for vectors of ``size``. A table without vectors has a null size and is no mismatch."""
    out = None
    for name, df in tables.items():
        n = F.size(column)
        row = df.where(F.col(column).isNotNull()).agg(F.max(n).alias("size"), F.coalesce(F.max(n) > F.min(n), F.lit(False)).alias("uneven")).select(F.lit(name).alias("table"), "size", "uneven", F.coalesce(F.col("size") != size, F.lit(False)).alias("mismatch"))
        out = row if out is None else out.unionByName(row)
    return out
