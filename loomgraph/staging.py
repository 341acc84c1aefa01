"""Results written once in the folder that the cluster shares, and joins that survive a hot key."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. In local mode, where driver and executors are one
    process, one of our own will do if none is named; elsewhere that is an error."""
    if d := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return d.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: its lineage ends there, so a lost
    executor costs the retry of one stage, and its real size is known to the planner."""
    spark, path = df.sparkSession, staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, keys: list[str], name: str, rows: int = 2_000_000, dealt: int | None = None, order: list[str] | None = None, group_rows: int | None = None) -> Iterator[DataFrame]:
    """df written once in the shared folder in buckets by keys, about ``rows`` rows each and as many as shuffle partitions at least:
    joins on the keys exchange the other side only, as often as they are made. The table has a name until the end of the
    block, so what is read from it must have been used by then. Rows that are ``dealt`` by the keys to so many partitions already are
    written as they come, one file a bucket. A file has the ``order`` (of the keys if not given) and, if its rows are large, row groups of
    ``group_rows``: a reader holds as many at once."""
    spark, at = df.sparkSession, staging_path(df.sparkSession, name)
    n = dealt
    if n is None:
        df = staged(df, f"{name}-rows")
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
        df = df.repartition(n, *keys)
    table = "loomgraph_" + uuid.uuid4().hex[:12]
    out = df.write.bucketBy(n, *keys).sortBy(*(order or keys)).option("path", at).format("parquet")
    (out.option("parquet.block.row.count.limit", group_rows) if group_rows else out).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


#: How often drop_staged has run: what is kept by its staged path holds for one count.
DROPS = [0]


def drop_staged(spark: SparkSession) -> None:
    """Remove what staged() has written in this application. Results read from it must have been used before."""
    DROPS[0] += 1
    jvm, path = spark._jvm, f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}"
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that adaptive execution can split where a key is hot.

    right is often an aggregate that is already partitioned by ``on``; joining on a hash of the key beside the
    key makes Spark exchange both sides, and only joins of two plain exchanges are split by skew."""
    k = "_split_key"
    out = left.withColumn(k, F.xxhash64(*on)).join(right.withColumn(k, F.xxhash64(*on)), [k, *on], how)
    return out.drop(k)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank: 1, 2, 3... in the order. Rows are dealt to ranges of the order, sorted and numbered in each; the ranges'
    sizes, one number a partition, are summed on the driver."""
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id())
    ranges = staged(ranges, "ranges")  # the number's upper bits are the range, the lower 33 the place in it
    part, before, starts = F.shiftright("rank", 33), 0, []
    for r in ranges.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r.part, before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    placed = ranges.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn("rank", F.col("_before") + F.col("rank").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before")
