"""Streams that remember: stateful operators with one value a key in the state store, and counters of a running job.

State is kept by Spark (RocksDB under the checkpoint), survives a restart and grows with keys, not with batches; a batch costs
what its own rows cost. Rows without a key are told apart by what they hold, so they don't meet in one task."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that rows without a key are dealt to.
SALTS = 64
#: Groups that a batch's rows are dealt to by key, and bytes of a group that are held before rows of repeated keys are dropped.
GROUPS, HELD = 256, 1 << 26


class FirstSeen(StatefulProcessor):
    """Lets the first row of a key pass: of those that come together the one of least ``order``. With ``forget``, a timer clears a key
    once the watermark is so many milliseconds past the time ``at`` of the row that was let pass, and then it counts as new."""

    def __init__(self, order: str, at: str | None = None, forget: int | None = None):
        self.order, self.at, self.forget = order, at, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "since long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:
            yield from (self.bare(r) for r in rows)
        elif self.seen.exists():
            for _ in rows:
                pass
        else:
            best = min(rows, key=lambda r: (r[self.order] is None, r[self.order]))
            since = int(best[self.at].timestamp() * 1000) if self.forget else 0
            self.seen.update((since,))
            if self.forget:
                self.handle.registerTimer(since + self.forget)
            yield self.bare(best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        yield from ()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if key[0] is not None:
            self.seen.update((0,))

    def close(self) -> None:
        pass

    @staticmethod
    def bare(row: Row) -> Row:
        return Row(**{k: v for k, v in row.asDict().items() if k != "_salt"})


class LatestRevision(StatefulProcessor):
    """Lets a row pass if its revision is higher than any that its key has had: work on an older one is stale and dropped as it
    arrives, whatever the order of arrival."""

    def __init__(self, revision: str):
        self.revision = revision

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", "revision long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        good = [r for r in rows if r[self.revision] is not None]
        if key[0] is None:
            yield from map(FirstSeen.bare, good)
        elif good:
            best = max(good, key=lambda r: r[self.revision])
            if not self.highest.exists() or self.highest.get()[0] < best[self.revision]:
                self.highest.update((best[self.revision],))
                yield FirstSeen.bare(best)

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, key: str) -> DataFrame:
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0)
    return rows.withColumn("_salt", salt.cast("int"))


def with_rocksdb(spark: SparkSession) -> None:
    """Stateful operators of several values need this store; set where the session names none."""
    if spark.conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def earliest(rows: pa.Table) -> pa.Table:
    """Of rows (_key, _new, _order) that have a key the first of each: those known from the start, then by order, nulls last."""
    by = rows.select(["_key", "_new", "_order"]).combine_chunks()
    at = pc.sort_indices(by, sort_keys=[("_key", "ascending"), ("_new", "ascending"), ("_order", "ascending")], null_placement="at_end")
    keys = pc.take(by.column("_key"), at).combine_chunks()
    first = pc.not_equal(keys.slice(1), keys.slice(0, max(len(keys) - 1, 0)))
    if pc.all(first).as_py():  # so it is of none
        return rows
    return rows.take(pa.concat_arrays([at.slice(0, 1), at.slice(1).filter(first)]))


def first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a key of a group's, see earliest; rows without a key all, equal ones numbered in _apart. What is held at once are the
    group's rows of different keys and about as many again, however often a key comes."""
    held, n, kept, twins = [], 0, 0, Counter()
    for b in batches:
        bare = pc.is_null(b.column("_key"))
        if some := pc.sum(bare).as_py():
            free = b.filter(bare)
            apart = []
            for x in free.column("_apart").to_pylist():
                apart.append(f"{x} {twins[x]}")
                twins[x] += 1
            place = free.schema.get_field_index("_apart")
            yield free.set_column(place, free.schema.field(place), pa.array(apart, free.schema.field(place).type))
            b = b.filter(pc.invert(bare))
        held.append(b)
        n += b.nbytes
        if n > max(HELD, 2 * kept):
            held = earliest(pa.Table.from_batches(held)).to_batches()
            n = kept = sum(x.nbytes for x in held)
    if held:
        yield from earliest(pa.Table.from_batches(held)).to_batches()


def known_keys(stored: DataFrame, key: str, checkpoint: str) -> DataFrame:
    """The keys of a table as a stream: they are written into the checkpoint's folder when a stream begins, and a restart finds them there."""
    spark, path = stored.sparkSession, f"{checkpoint.rstrip('/')}/known"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    keys = stored.select(key).where(F.col(key).isNotNull()).distinct()
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        keys.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(keys.schema).parquet(path)


def first_seen_stream(items: DataFrame, key: str, order: str, stored: DataFrame | None = None, at: str | None = None, forget: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """The rows of a stream whose key is new; of those that come together the one of least ``order``. Keys in ``stored`` (column key)
    count as seen from the start: the table is read once, when the stream with this ``checkpoint`` begins, and not again.

    A batch's first row of each key is found in groups of keys, and Spark's deduplication remembers the keys. With ``forget``, for
    which the stream has a watermark on ``at``, or keys or order that aren't plain values, each key is asked for by itself, see FirstSeen."""
    with_rocksdb(items.sparkSession)
    if forget is not None or not all(isinstance(items.schema[c].dataType, T.AtomicType) for c in (key, order)):
        start = None if stored is None else keyed(stored.select(key).where(F.col(key).isNotNull()).distinct(), key).groupBy(key, "_salt")
        mode = "None" if forget is None else "EventTime"
        return keyed(items, key).groupBy(key, "_salt").transformWithState(FirstSeen(order, at, forget), items.schema, "Append", mode, start).select(*items.columns)
    # a row without a key is one of its own: by the batch's time, what it holds and, among equals, its number
    content, bare = F.xxhash64(*items.columns), F.col(key).isNull()
    apart = F.when(bare, F.concat_ws(" ", F.unix_micros(F.current_timestamp()).cast("string"), content.cast("string")))
    group = lambda c: F.pmod(c, F.lit(GROUPS)).cast("int").alias("_group")
    rows = items.select(group(F.when(bare, content).otherwise(F.xxhash64(key))), F.col(key).alias("_key"), F.lit(True).alias("_new"), F.col(order).alias("_order"), apart.alias("_apart"), F.struct(*items.columns).alias("_row"))
    if stored is not None:
        none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
        known = known_keys(stored.select(F.col(key).cast(items.schema[key].dataType).alias(key)), key, checkpoint)
        rows = rows.unionByName(known.select(group(F.xxhash64(key)), F.col(key).alias("_key"), F.lit(False).alias("_new"), none("_order"), none("_apart"), none("_row")))
    once = rows.groupBy("_group").applyInArrow(first_of_batch, rows.schema).dropDuplicates(["_key", "_apart"])
    return once.where("_new").select("_row.*")


def latest_stream(items: DataFrame, key: str, revision: str) -> DataFrame:
    """The rows of a stream that raise their key's revision, see LatestRevision. Each replaces the one before (update mode)."""
    with_rocksdb(items.sparkSession)
    return keyed(items, key).groupBy(key, "_salt").transformWithState(LatestRevision(revision), items.schema, "Update", "None").select(*items.columns)


def counters(status: Column, attempt: Column) -> list[Column]:
    """What a job counts as it goes: chunks in all, completed, failed, and taken up again."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(attempt > 1).alias("retried"),
    ]


class Progress(StreamingQueryListener):
    """Counters of running streams by name, added up from the metrics that observe() puts in each batch's progress: they cost no
    pass of their own and can be read while the job runs. A batch that ran again after a failure counts once, by its number."""

    def __init__(self, name: str):
        self.name, self.batches, self.ended, self.error = name, {}, threading.Event(), None
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self.lock:
                self.batches[str(event.progress.id), event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.error = event.exception
        self.ended.set()

    def counts(self) -> dict[str, int]:
        with self.lock:
            out: Counter = Counter()
            for row in self.batches.values():
                out.update({k: v or 0 for k, v in row.items()})
        return dict(out)


def followed(rows: DataFrame, name: str, status: str = "status", attempt: str = "attempt") -> DataFrame:
    """rows, a stream or a table, with the counters put under ``name``."""
    return rows.observe(name, *counters(F.col(status), F.col(attempt)))


def run_followed(stream: DataFrame, name: str, write, seconds: float = 60.0) -> dict[str, int]:
    """Start ``write(followed stream)``, wait for its end, and return the counters. The listener goes whatever happens."""
    spark, progress = stream.sparkSession, Progress(name)
    spark.streams.addListener(progress)
    try:
        write(followed(stream, name)).awaitTermination()
        if not progress.ended.wait(seconds):  # events come after the query's end, in order
            raise PySparkException(f"no end of the stream was reported within {seconds} s")
        return progress.counts()
    finally:
        spark.streams.removeListener(progress)
