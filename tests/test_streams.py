"""Streams with state: restarts, late and repeated rows, failures between steps, feeds switched off, counters."""

import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomgraph.sources.polling import polls
from loomgraph.streaming import feeds, state

SCHEMA = "pos long, source_uri string"


def dropped(spark, path, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(path)
    return feeds.poll(spark, path, df.schema, 1000)


def rows_of(spark, path, *columns):
    return sorted(tuple(r[c] for c in columns) for r in spark.read.parquet(path).collect())


def test_keys_outlive_a_restart_and_repeats_come_late(spark, tmp_path):
    at = str(tmp_path)
    for rows in ([(4, "b"), (1, "a"), (2, "a"), (3, None)], [(5, "a"), (6, "c"), (7, None), (8, "b")], [(0, "a"), (9, "c")]):
        feeds.insert_batches(dropped(spark, f"{at}/in", rows), f"{at}/table", f"{at}/check").awaitTermination()
    assert sorted((r.pos, r.source_uri) for r in spark.read.parquet(f"{at}/table").collect()) == [(1, "a"), (3, None), (4, "b"), (6, "c"), (7, None)]
    other = feeds.poll(spark, f"{at}/in", spark.createDataFrame([], SCHEMA).schema)  # a stream of its own finds the table's keys
    feeds.insert_batches(other.where("source_uri is not null"), f"{at}/table", f"{at}/check2").awaitTermination()
    assert spark.read.parquet(f"{at}/table").count() == 5


def test_a_batch_costs_its_own_rows(spark, tmp_path):
    """What a stream reads doesn't grow with the history: no scan of the table it has written."""
    at = str(tmp_path)
    for k in range(4):
        q = feeds.insert_batches(dropped(spark, f"{at}/in", [(100 * k + i, f"u{k}-{i}") for i in range(50)]), f"{at}/table", f"{at}/check")
        q.awaitTermination()
        data = [p for p in q.recentProgress if p["numInputRows"]]
        assert [p["numInputRows"] for p in data] == [50]
        assert data[-1]["stateOperators"][0]["numRowsTotal"] == 50 * (k + 1)


def test_keys_are_remembered_without_asking_for_each(spark, tmp_path, monkeypatch):
    """Spark's deduplication holds the keys; what comes before it lets one row a key of a batch pass, and rows without a key all."""
    monkeypatch.setattr(state, "HELD", 100, raising=False)  # repeated rows go while a group is read
    at, schema = str(tmp_path), "pos long, source_uri string, ts timestamp, more struct<a: string, b: array<int>>"
    row = lambda pos, key: (pos, key, datetime.datetime(2024, 1, 1, 1), ("x", [1, 2]))
    hot = [row(p, "hot") for p in range(30_000, 5, -1)] + [row(None, "hot"), row(None, "null"), row(9, "null"), row(None, "only")]
    for k, rows in enumerate(([row(7, None), row(7, None), *hot], [row(7, None), row(1, "hot"), row(2, "new"), row(None, None)], [row(3, "new")])):
        q = feeds.insert_batches(dropped(spark, f"{at}/in", rows, schema), f"{at}/table", f"{at}/check")
        q.awaitTermination()
        assert [s["operatorName"] for s in q.lastProgress["stateOperators"]] == ["dedupe"], k
    stored = spark.read.parquet(f"{at}/table")
    got = sorted(((r.pos, r.source_uri) for r in stored.collect()), key=repr)
    assert got == sorted([(7, None), (7, None), (6, "hot"), (9, "null"), (None, "only"), (7, None), (2, "new"), (None, None)], key=repr)
    assert {(r.ts, r.more.a, tuple(r.more.b)) for r in stored.collect()} == {(datetime.datetime(2024, 1, 1, 1), "x", (1, 2))}
    other = feeds.insert_batches(feeds.poll(spark, f"{at}/in", stored.drop("run", "batch").schema), f"{at}/table", f"{at}/check2")
    other.awaitTermination()  # finds the keys of the first stream; rows without one have none to be found by
    assert stored.count() == 8 and spark.read.parquet(f"{at}/table").count() == 12


def test_earliest_row_of_a_key():
    import pyarrow as pa

    rows = pa.table({"_key": ["b", "a", "b", "a", "a", "c"], "_new": [True, True, True, True, False, True], "_order": pa.array([2, 1, 1, 0, None, None], pa.int64()), "n": range(6)})
    assert state.earliest(rows).to_pydict()["n"] == [4, 2, 5]
    assert state.earliest(rows.slice(4)) is not None and state.earliest(rows.slice(4)).num_rows == 2


def test_a_key_may_be_forgotten(spark, tmp_path):
    """A timer clears a key when the watermark is an hour past its row."""
    at, time = str(tmp_path), lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    for rows in ([(1, "a", time(1)), (2, "b", time(2, 30))], [(3, "a", time(1, 30)), (4, "x", time(3))], [(5, "a", time(4)), (6, "b", time(3))]):
        items = dropped(spark, f"{at}/in", rows, "pos long, source_uri string, ts timestamp").withWatermark("ts", "0 seconds")
        feeds.insert_batches(items, f"{at}/table", f"{at}/check", at="ts", forget=3_600_000).awaitTermination()
    assert rows_of(spark, f"{at}/table", "pos") == [(1,), (2,), (4,), (5,)]  # a is known at 1:30 and forgotten by 3:00; b isn't


def test_triage_that_fails_is_done_again(spark, tmp_path):
    at, asked = str(tmp_path), []

    def after(rows, name):
        asked.append((name, sorted(r.pos for r in rows.collect())))
        if len(asked) == 1:
            raise RuntimeError("lost")
        rows.write.mode("overwrite").parquet(f"{at}/triaged/{name}")

    items = dropped(spark, f"{at}/in", [(1, "a"), (2, "b"), (3, "a")])
    with pytest.raises(StreamingQueryException):
        feeds.insert_batches(items, f"{at}/table", f"{at}/check", after=after).awaitTermination()
    assert rows_of(spark, f"{at}/table", "pos") == [(1,), (2,)]  # stored, not triaged
    feeds.insert_batches(items, f"{at}/table", f"{at}/check", after=after).awaitTermination()
    assert asked[0] == asked[1] and rows_of(spark, f"{at}/triaged", "pos") == rows_of(spark, f"{at}/table", "pos") == [(1,), (2,)]


def test_quarantine_runs_again_after_a_failure(spark, tmp_path):
    at, runs = str(tmp_path), []

    def work(batch):
        runs.append(batch.count())
        if len(runs) == 1:
            raise RuntimeError("lost")
        return batch.withColumn("error", F.when(F.col("id") % 2 == 0, "even"))

    for k, rows in enumerate(([(1,), (2,), (3,)], [(3,), (4,)])):
        items = dropped(spark, f"{at}/in", rows, "id long")
        go = lambda: feeds.process_batches(items, work, f"{at}/done", f"{at}/bad", f"{at}/check").awaitTermination()  # noqa: B023, E731
        if k == 0:
            with pytest.raises(StreamingQueryException):
                go()
        go()
    assert rows_of(spark, f"{at}/done", "id") == [(1,), (3,)] and rows_of(spark, f"{at}/bad", "id", "error") == [(2, "even"), (4, "even")]


def test_stale_revisions_are_dropped(spark, tmp_path):
    at, schema = str(tmp_path), "id long, revision long, text string"
    for k, rows in enumerate(([(1, 3, "c"), (2, 1, "a"), (None, 5, "n")], [(1, 2, "b"), (2, 2, "b"), (1, 3, "again")], [(1, 1, "a"), (2, None, "x"), (2, 9, "z"), (2, 8, "y"), (None, 4, "m")])):
        passed = state.latest_stream(dropped(spark, f"{at}/in", rows, schema), "id", "revision")
        write = lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out/batch={k}-{n}")  # noqa: B023, E731
        passed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination()
    got = {(r.id, r.revision, r.text) for r in spark.read.parquet(f"{at}/out").collect()}
    assert got == {(1, 3, "c"), (2, 1, "a"), (2, 2, "b"), (2, 9, "z"), (None, 5, "n"), (None, 4, "m")}


def test_sessions_behind_the_watermark_and_open_ones(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    path, schema = str(tmp_path), "ts timestamp, user_id long"
    for n, rows in enumerate(([(at(1, 5), 1), (at(1, 20), 1), (at(1, 0), 2)], [(at(6, 0), 1)], [(at(1, 30), 1), (at(6, 20), 1), (at(5, 55), 2)], [(at(9, 0), 3)])):
        counts = feeds.session_counts(dropped(spark, f"{path}/in", rows, schema))
        counts.writeStream.outputMode("append").option("checkpointLocation", f"{path}/check").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{path}/out").select("user_id", "start", "stop", "n").collect()}
    # the row of 1:30 is late, and the session of 9:00 still open
    assert got == {(1, at(1, 5), at(1, 50), 2), (2, at(1, 0), at(1, 30), 1), (1, at(6, 0), at(6, 50), 2), (2, at(5, 55), at(6, 25), 1)}


def test_a_feed_that_is_switched_off_stops(spark, tmp_path):
    folder, table, check = (str(tmp_path / x) for x in ("polls", "feeds", "check"))
    schema = "feed_id long, pos long, source_uri string"
    got = []

    def poll(n, rows, active):
        if rows:
            spark.createDataFrame(rows, schema).write.partitionBy("feed_id").parquet(f"{folder}/poll={n}")
        spark.range(4).select("id", F.col("id").isin(active).alias("active")).write.mode("overwrite").parquet(table)
        out = []
        write = lambda b, _: out.extend(sorted((r.feed_id, r.pos) for r in b.collect()))
        polls(spark, folder, table, schema).writeStream.foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        got.append(out)

    poll(1, [(0, 1, "a"), (1, 2, "b"), (3, 3, "c")], [0, 1])
    poll(2, [(0, 4, "d"), (1, 5, "e")], [0])  # feed 1 is off
    poll(2, [], [0, 1])  # nothing new: what it dropped meanwhile is passed over
    poll(3, [(1, 6, "f"), (2, 7, "g")], [0, 1, 2])
    assert got == [[(0, 1), (1, 2)], [(0, 4)], [], [(1, 6), (2, 7)]]
    (tmp_path / "polls" / "poll=5").mkdir()  # a poll that isn't whole, after one that is missing
    poll(5, [], [0, 1, 2, 3])
    assert got[-1] == []


def test_counters_of_a_running_job(spark, tmp_path):
    at, schema = str(tmp_path), "id long, status string, attempt int"
    parts = [[(1, "completed", 1), (1, "failed", 2)], [(2, "completed", 3), (2, "open", 1), (3, None, None)]]
    counts = []
    for k, rows in enumerate(parts):
        stream = dropped(spark, f"{at}/in", rows, schema)
        write = lambda s: s.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
        counts.append(state.run_followed(stream, f"job{k}", write))
    assert counts == [{"total": 2, "completed": 1, "failed": 1, "retried": 1}, {"total": 3, "completed": 1, "failed": 0, "retried": 1}]
    batch = spark.read.schema(schema).parquet(f"{at}/out")
    whole = batch.agg(*state.counters(F.col("status"), F.col("attempt"))).first().asDict()
    assert whole == {k: counts[0][k] + counts[1][k] for k in whole}
    assert batch.count() == 5
