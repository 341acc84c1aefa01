"""Feeds as streams: polls, first-seen items, triage, and windows over events."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import first_seen_stream


def poll(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Items that fetchers drop into a folder as Parquet files, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def active_only(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """Items of feeds that are active when the batch runs (a stream-static join: feeds are read again each batch)."""
    return items.join(feeds.where("active").select(F.col("id").alias("feed_id")), "feed_id", "left_semi")


def first_seen(items: DataFrame, key: str = "source_uri", at: str | None = None, within: str | None = None, order: list[str] | None = None) -> DataFrame:
    """The first item of each key. A table has the first by ``order``; a stream the first that comes, with keys kept for ever
    without ``within``, else for that long after ``at``. Within a micro-batch this has no order: first_seen_stream does."""
    if not items.isStreaming:
        rest = [c for c in items.columns if c != key]
        by = F.struct(*(order or [at or rest[0]]))
        return items.groupBy(key).agg(F.min_by(F.struct(*rest), by).alias("r")).select(key, "r.*").select(*items.columns)
    if within is None:
        return items.dropDuplicates([key])
    return items.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def stored_or_empty(spark: SparkSession, table: str, schema) -> DataFrame:
    """The rows of a table that insert_batches or process_batches writes, none if there isn't one yet; with the columns run and
    batch, which name the stream and the batch that a row came with."""
    schema = T.StructType([*schema.fields])
    for c, kind in (("run", T.StringType()), ("batch", T.LongType())):
        schema = schema if c in schema.names else schema.add(c, kind)
    try:
        return spark.read.schema(schema).parquet(table)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run_of(checkpoint: str) -> str:
    """A name for the stream that has this checkpoint."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def insert_batches(items: DataFrame, table: str, checkpoint: str, key: str = "source_uri", after: Callable[[DataFrame, str], None] | None = None, order: str | None = None, at: str | None = None, forget: int | None = None):
    """Write each batch's rows of new keys to a Parquet table; of a key's rows that come together the one of least ``order`` (the
    first column by default); rows without a key all go in.

    Keys are kept as state, so a batch costs what its own rows cost, however long the history is; what other streams have put
    in the table is read once, when this one begins. Where keys should not be kept for ever, ``forget`` says how many milliseconds
    past ``at``, a time that the stream has a watermark on. A batch has a folder of its own, run=<stream>/batch=<number>, and one that
    runs again writes it again. Then ``after`` gets the stored rows and that folder's name (triage, for one); if it fails, or the
    driver does before it ends, the batch runs again and so does it, so what it writes should go by the name. Stops when what
    is there has been read."""
    spark, run = items.sparkSession, run_of(checkpoint)
    stored = stored_or_empty(spark, table, items.schema).where(F.col("run") != run)
    fresh = first_seen_stream(items, key, order or items.columns[0], stored, at, forget, checkpoint)

    def write(batch: DataFrame, n: int) -> None:
        name = f"run={run}/batch={n}"
        batch.write.mode("overwrite").parquet(f"{table}/{name}")
        if after is not None:
            after(batch.sparkSession.read.schema(items.schema).parquet(f"{table}/{name}"), name)

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_batches(items: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, quarantine: str, checkpoint: str, key: str = "id"):
    """Each batch's items through ``work``, which returns them with an ``error`` column, null where all went well: good rows go to
    ``done``, the others with their error to ``quarantine``, and the stream goes on. Items that either table has are passed over,
    as in insert_batches; a batch that runs again writes its folders again. Stops when what is there has been read."""
    spark, run = items.sparkSession, run_of(checkpoint)
    kind = T.StructType([items.schema[key]])
    seen = [stored_or_empty(spark, t, kind).where(F.col("run") != run).select(key) for t in (done, quarantine)]
    fresh = first_seen_stream(items, key, items.columns[0], seen[0].unionByName(seen[1]), checkpoint=checkpoint)

    def write(batch: DataFrame, n: int) -> None:
        rows, at = work(batch).persist(), f"run={run}/batch={n}"
        rows.where("error is null").drop("error").write.mode("overwrite").parquet(f"{done}/{at}")
        rows.where("error is not null").write.mode("overwrite").parquet(f"{quarantine}/{at}")
        rows.unpersist()

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Items without a result: what a restart has to take up again, quarantined ones included."""
    return items.join(done.select(key), key, "left_anti")


def latest_revision(items: DataFrame, key: str = "id", revision: str = "revision") -> DataFrame:
    """The row of the highest revision of each document; work on an older one is dropped."""
    rest = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.max_by(F.struct(*rest), revision).alias("r")).select(key, "r.*")


def progress(chunks: DataFrame) -> DataFrame:
    """(id, total, completed, failed, retried) from rows (id, status, attempt)."""
    s = F.col("status")
    return chunks.groupBy("id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count_if(F.col("attempt") > 1).alias("retried"))


def tumbling_counts(events: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """(start, by, n) in windows of ``size``; on a stream, rows later than the watermark are dropped."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    e = e.withWatermark(at, late) if events.isStreaming else e
    return e.groupBy(F.window(at, size), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def session_counts(events: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """(by, start, stop, n) of sessions that end after ``gap`` without an event."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    e = e.withWatermark(at, late) if events.isStreaming else e
    s = e.groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")
