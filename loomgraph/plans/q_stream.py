"""Streams (STR): as batches, and as streams whose parts come late, out of order or in several starts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import feeds as S
from ..streaming import state
from .q_source import arriving
from .registry import query
from .views import view


@query("str2_first_seen", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def str2(spark, d):
    return S.first_seen(view(spark, d, "events"), "user_id", order=["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("str5_latest_revision", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def str5(spark, d):
    return S.latest_revision(view(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("str6_progress", "SELECT user_id AS id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 50) AS retried FROM events GROUP BY 1")
def str6(spark, d):
    e = view(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("open")
    return S.progress(e.select(F.col("user_id").alias("id"), status.alias("status"), F.when(F.col("value") > 50, 2).otherwise(1).alias("attempt")))


@query("str7_tumbling_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str7(spark, d):
    return S.tumbling_counts(view(spark, d, "events"))


@query(
    "str7_session_counts",
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS stop, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def str7s(spark, d):
    return S.session_counts(view(spark, d, "events"))


@query(
    "str5_streamed_revisions",
    """WITH c AS (SELECT conv_id, turn, role, (turn + conv_id) % 3 AS part FROM conversations), p AS (SELECT conv_id, part, max(turn) AS turn FROM c GROUP BY 1, 2),
    a AS (SELECT *, turn > coalesce(max(turn) OVER (PARTITION BY conv_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS passed FROM p)
    SELECT a.conv_id, max(a.turn) AS turn, max_by(c.role, a.turn) AS role, count(*) AS passed FROM a JOIN c ON c.conv_id = a.conv_id AND c.turn = a.turn WHERE a.passed GROUP BY 1""",
)
def str5s(spark, d):
    """Revisions in three parts out of order: what passes rises, the last that passed is the highest, and stale rows are gone."""
    c = view(spark, d, "conversations")
    rows = c.select("conv_id", "turn", "role", ((F.col("turn") + F.col("conv_id")) % 3).cast("int").alias("part"))

    def run(stream, out, k):
        passed = state.latest_stream(stream, "conv_id", "turn")
        write = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/table/batch={k}-{n}")
        passed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()

    _, out = arriving(spark, rows, F.col("part"), 3, run)
    passed = spark.read.schema(rows.schema).parquet(f"{out}/table")
    return passed.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.count(F.lit(1)).alias("passed"))


@query("str6_streamed_counters", "SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 50) AS retried FROM events")
def str6s(spark, d):
    """Counted by the job as it runs, in several batches, and read from its progress: the rows aren't read a second time."""
    e = view(spark, d, "events")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("open")
    rows = e.select(F.col("user_id").alias("id"), status.alias("status"), F.when(F.col("value") > 50, 2).otherwise(1).alias("attempt"), (F.col("event_id") % 3).cast("int").alias("part"))
    run = lambda stream, out, k: state.run_followed(stream, f"chunks-{k}", lambda s: s.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start())
    counts, _ = arriving(spark, rows, F.col("part"), 3, run)
    names = ["total", "completed", "failed", "retried"]
    return spark.createDataFrame([tuple(sum(c.get(n, 0) for c in counts) for n in names)], ", ".join(f"{n} long" for n in names))


#: Events in three parts by time, but for every tenth of the first part, which comes with the last.
LATE = """e AS (SELECT *, CASE WHEN ts < lo + (hi - lo) / 3 THEN CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END WHEN ts < lo + (hi - lo) / 3 * 2 THEN 1 ELSE 2 END AS part FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events)),
    w AS (SELECT 0 AS part, NULL::TIMESTAMP AS mark UNION ALL SELECT k, max(date_trunc('milliseconds', ts)) - INTERVAL '10 minutes' FROM e, (SELECT unnest([1, 2, 3]) AS k) WHERE part < k GROUP BY k), top AS (SELECT mark AS last FROM w WHERE part = 3)"""


def late_events(spark, d):
    """Events and the part that each comes with: three by time, but for every tenth of the first, which comes with the last."""
    e = view(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = e.agg(F.unix_micros(F.min("ts")).alias("lo"), F.unix_micros(F.max("ts")).alias("hi")).first()
    at, step = F.unix_micros("ts"), ((x.hi or 0) - (x.lo or 0)) // 3
    first = F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    part = F.when(at < (x.lo or 0) + step, first).when(at < (x.lo or 0) + 2 * step, 1).otherwise(2)
    return e.select("event_id", "user_id", "event_type", "ts", part.alias("part"))


def appended(spark, rows, aggregate):
    """What an aggregate writes in append mode: windows once the watermark is past them, no row that came behind it."""

    def run(stream, out, k):
        done = aggregate(stream)
        write = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/table/batch={k}-{n}")
        done.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()

    _, out = arriving(spark, rows, F.col("part"), 3, run)
    kind = aggregate(rows).schema
    return spark.read.schema(kind).parquet(f"{out}/table").select(*kind.names)


@query(
    "str7_streamed_counts",
    f"""WITH {LATE}, k AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type FROM e JOIN w USING (part) WHERE mark IS NULL OR time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' > mark)
    SELECT start, event_type, count(*) AS n FROM k, top WHERE start + INTERVAL '1 hour' <= last GROUP BY 1, 2""",
)
def str7stream(spark, d):
    return appended(spark, late_events(spark, d), S.tumbling_counts)


@query(
    "str7_streamed_sessions",
    f"""WITH {LATE}, k AS (SELECT user_id, event_id, ts FROM e JOIN w USING (part) WHERE mark IS NULL OR ts + INTERVAL '30 minutes' > mark),
    n AS (SELECT *, CASE WHEN ts - lag(ts) OVER u <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM k WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM n)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS stop, count(*) AS n FROM s, top GROUP BY user_id, s, last HAVING max(ts) + INTERVAL '30 minutes' <= last""",
)
def str7sessions(spark, d):
    return appended(spark, late_events(spark, d), S.session_counts)
