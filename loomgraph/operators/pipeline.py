"""Documents through all phases: what is asked of a model, and the order in which results are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import heat, lint, resolve, vectors
from .mutate import insert_edges, insert_links, materialize


def predicate_prompts(sources: DataFrame, targets: DataFrame, texts: DataFrame | None = None, most: int = 1500) -> DataFrame:
    """sources (id, canonical_name, description, document_id) and targets (id, place, canonical_name, description) to (id, prompt):
    the source, its targets in order of place, and the first ``most`` characters of its document's text (document_id, text).
    Sources without a target have no prompt."""
    about = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("no description"))
    line = F.concat(F.lit("- "), "canonical_name", F.lit(": "), about(F.col("description")))
    listed = targets.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("listed"))
    rows = sources.join(listed, "id")
    rows = rows.withColumn("text", F.lit(None).cast("string")) if texts is None else rows.join(texts, "document_id", "left")
    head = F.concat(F.lit("Source concept: "), "canonical_name", F.lit("\nDescription: "), about(F.col("description")), F.lit("\n\nTarget concepts:\n"), "listed")
    context = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("\n\nContext from source document:\n"), F.substring("text", 1, most)))
    return rows.select("id", F.concat(head, F.coalesce(context, F.lit(""))).alias("prompt"))


def in_phases(docs: DataFrame, phases: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """All documents through one phase after the other, each over all that the one before made; the last phase's rows, and
    (phase, place, total, done, failed). A phase returns its rows with an ``error`` column; rows with an error go no further."""
    rows, progress = docs, None
    for place, (name, run) in enumerate(phases):
        out = staged(run(rows), f"phase-{place}")
        count = rows.agg(F.count(F.lit(1)).alias("total")).join(out.agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed")))  # one row each
        count = staged(count.select(F.lit(name).alias("phase"), F.lit(place).alias("place"), "total", "done", "failed"), "progress")
        progress = count if progress is None else progress.unionByName(count)
        rows = out.where("error is null").drop("error")
    return rows, progress


def process(docs: DataFrame, extracted: DataFrame, engrams: DataFrame, engram_vectors: DataFrame, links: DataFrame, edges: DataFrame, synonyms: DataFrame, embed: Callable[[DataFrame], DataFrame], propose: Callable[[DataFrame], DataFrame], as_of: str, least: float = 0.91) -> dict[str, DataFrame]:
    """New documents into the graph, in the order that a result depends on: extracted names (group: document, pos, name,
    description) are joined with synonyms, embedded, resolved against the concepts and linked; edges that ``propose`` makes of the
    new links are inserted; then come heat, stale articles and checks. Returns the tables after."""
    named = staged(resolve.prepare_batch(extracted, synonyms), "prepared")
    names = staged(named.groupBy(F.col("canonical").alias("name")).agg(F.min("pos").alias("cand"), F.min_by("description", "pos").alias("description")), "names")
    cands = staged(names.join(embed(names.select(F.col("cand").alias("id"), F.col("name").alias("text"))).withColumnRenamed("id", "cand"), "cand"), "candidates")
    found = staged(resolve.get_or_create(cands.select("cand", "name", "embedding"), engrams, engram_vectors, least), "resolved")
    made = materialize(found.where("created").join(cands, "cand").select(F.col("cand").alias("pos"), "engram_id", F.col("name").alias("canonical_name"), "description", "embedding"))
    all_engrams = engrams.unionByName(made.select(F.col("engram_id").alias("id"), "canonical_name", "description"), allowMissingColumns=True)
    new_links = named.join(names.select(F.col("name").alias("canonical"), "cand"), "canonical").join(found, "cand").select(F.col("group").alias("document_id"), "engram_id").distinct()
    all_links = staged(insert_links(links, new_links), "links")
    all_edges = staged(insert_edges(edges, propose(new_links)), "edges")
    scores = heat.heat(docs, all_links, all_edges, as_of)
    return {
        "engrams": all_engrams,
        "vectors": engram_vectors.unionByName(made.select("engram_id", "embedding")),
        "links": all_links,
        "edges": all_edges,
        "heat": scores,
        "stale": heat.stale_articles(all_engrams, all_links, docs),
        "issues": lint.orphans(all_engrams, all_edges).unionByName(lint.contradictions(all_edges)),
        "prompts": vectors.find_neighbors(made.select(F.col("engram_id").alias("id"), "embedding"), engram_vectors.select(F.col("engram_id").alias("id"), "embedding"), 10, 0.5),
    }
