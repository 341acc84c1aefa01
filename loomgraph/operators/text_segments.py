"""A text index that follows its documents: segments of postings, deletes, and merges by size.

A change (new, edited and deleted documents) is one new segment: the postings of its documents, and the ids whose older postings no
longer count. A search reads the postings of its terms from every segment, less those that a later segment voids, and gives
what an index built anew would. Where the segments at the end are not small next to the one before them, they are merged with it,
so there are about as many as the logarithm of the index's size, and each posting is rewritten about that often.

A state of the index is a manifest, one small JSON row that names its segments; it is written after them, so a change that breaks
off leaves the last state as it was, and whoever holds a state can go on reading it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import TextIndex, posting_rows

TEXTS = ("title", "text", "annotation")


@dataclass(frozen=True)
class Segment:
    """A folder with rows (postings, and a row without a term for each document) and gone (id); how many postings; whether it voids anything."""

    name: str
    postings: int
    voids: bool


@dataclass(frozen=True)
class SegmentedIndex:
    """A state of the index: segments from the oldest on, and the number of live documents and of their tokens."""

    folder: str
    version: int
    segments: tuple[Segment, ...]
    n: int
    tokens: int

    def part(self, spark: SparkSession, segment: Segment, name: str) -> DataFrame:
        """rows, postings, docs (id, len) or gone of a segment."""
        rows = spark.read.parquet(f"{self.folder}/{segment.name}/{'gone' if name == 'gone' else 'rows'}")
        return rows.where("term is not null") if name == "postings" else rows.where("term is null").select("id", "len") if name == "docs" else rows

    def live(self, spark: SparkSession, name: str, segments: tuple[Segment, ...] | None = None) -> DataFrame | None:
        """rows, postings or docs of the given segments (all by default), less what later ones void."""
        chosen, out, gone = self.segments if segments is None else segments, None, None
        for s in reversed(self.segments):
            if s in chosen:
                rows = self.part(spark, s, name)
                rows = rows if gone is None else rows.join(gone, "id", "left_anti")
                out = rows if out is None else out.unionByName(rows)
            if s.voids:
                more = self.part(spark, s, "gone")
                gone = more if gone is None else gone.unionByName(more).distinct()
        return out

    def index(self, spark: SparkSession) -> TextIndex:
        """For keyword_search."""
        totals = spark.createDataFrame([(float(self.n), self.tokens / self.n if self.n else None)], "n double, avglen double")
        return TextIndex(self.live(spark, "postings"), totals)


def _committed(spark: SparkSession, state: SegmentedIndex) -> SegmentedIndex:
    line = json.dumps({"version": state.version, "segments": [[s.name, s.postings, s.voids] for s in state.segments], "n": state.n, "tokens": state.tokens})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{state.folder}/manifests/version={state.version}")
    return state


def open_index(spark: SparkSession, folder: str) -> SegmentedIndex:
    """The last state that was written under a folder; an empty one if there is none."""
    try:
        rows = spark.read.option("wholetext", True).text(f"{folder}/manifests").orderBy(F.desc("version")).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    if not rows:
        return SegmentedIndex(folder, 0, (), 0, 0)
    m = json.loads(rows[0].value)
    return SegmentedIndex(folder, m["version"], tuple(Segment(*s) for s in m["segments"]), m["n"], m["tokens"])


def _written(folder: str, rows: DataFrame, gone: DataFrame | None) -> Segment:
    name, spark = f"segment-{uuid.uuid4().hex[:12]}", rows.sparkSession
    rows.write.parquet(f"{folder}/{name}/rows")
    if gone is not None:
        gone.write.parquet(f"{folder}/{name}/gone")
    return Segment(name, spark.read.parquet(f"{folder}/{name}/rows").where("term is not null").count(), gone is not None)


def _in_runs(rows: DataFrame, most: int = 2_000_000) -> DataFrame:
    """rows of each task in runs by (term, id) of about ``most``; small runs become one, nothing is shuffled or spilled."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from ordered(held)
                held, n = [], 0
        if held:
            yield from ordered(held)

    def ordered(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        by = pc.sort_indices(table, sort_keys=[("term", "ascending"), ("id", "ascending")], null_placement="at_start")
        return table.take(by).combine_chunks().to_batches()

    return rows.mapInArrow(runs, rows.schema)


def changed(spark: SparkSession, state: SegmentedIndex, docs: DataFrame, deleted: DataFrame | None = None, columns: tuple[str, ...] = TEXTS, id_col: str = "id", ratio: float = 4.0) -> SegmentedIndex:
    """The next state: docs are new or take the place of those of their ids, and the ids in deleted (id) go. An id that is in both
    stays with its new text; ids in docs name one document each; deleting what isn't there does nothing.

    Then segments are merged: from the newest on, one joins those after it while it has no more than ``ratio`` times their postings."""
    ids = docs.select(F.col(id_col).alias("id"))
    void = ids if deleted is None else ids.unionByName(deleted.select("id").where(F.col("id").isNotNull())).distinct()
    n, tokens, gone = state.n, state.tokens, None
    if state.segments:
        old = state.live(spark, "docs").join(void, "id", "left_semi")
        lost = old.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
        n, tokens = n - lost.n, tokens - lost.tokens
        gone = old.select("id").distinct() if lost.n else None
    segment = _written(state.folder, posting_rows(docs, columns, id_col), gone)
    own = SegmentedIndex(state.folder, 0, (segment,), 0, 0).part(spark, segment, "docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
    state = replace(state, version=state.version + 1, segments=(*state.segments, segment), n=n + own.n, tokens=tokens + own.tokens)
    return _committed(spark, merged(spark, state, ratio))


def merged(spark: SparkSession, state: SegmentedIndex, ratio: float) -> SegmentedIndex:
    """state with its last segments as one, as far back as one has no more than ratio times the postings of those after it."""
    k, size = len(state.segments), 0
    while k and (size == 0 or state.segments[k - 1].postings <= ratio * size):
        k -= 1
        size += max(state.segments[k].postings, 1)
    tail = state.segments[k:]
    if len(tail) < 2:
        return state
    gone = None
    if k:  # what they void in the segments before still counts
        parts = [state.part(spark, s, "gone") for s in tail if s.voids]
        for p in parts:
            gone = p if gone is None else gone.unionByName(p).distinct()
    rows = state.live(spark, "rows", tail).coalesce(max(1, -(-size // 8_000_000)))  # fewer files where they are small
    one = _written(state.folder, _in_runs(rows), gone)
    return replace(state, segments=(*state.segments[:k], one))
