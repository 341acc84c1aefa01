"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import drop_staged, numbered, shared_dir, split_join, staged, staging_path

__all__ = ["LOWER", "UPPER", "WORD_BYTES", "drop_staged", "lower_ascii", "numbered", "row_keyed", "shared_dir", "split_join", "staged", "staging_path", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z to a-z, other non-alphanumeric ASCII to a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def plain_scan(df: DataFrame) -> bool:
    """Whether each row of df is a row of a file: a scan under projections and filters alone. Under anything else (an
    exploded array, a union, a join, a function over batches) several rows may come from one place in a file."""
    try:
        node = df._jdf.queryExecution().analyzed()
    except AttributeError:  # a session without a JVM beside it shows no plan
        return False
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        if not node.deterministic():
            return False
        node = node.child()
    return node.nodeName().split(" ")[0] == "LogicalRelation"


def row_keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each row, the same whenever it is read, and the name of that column.

    Rows of Parquet files are named by file and place, which costs no copy; any other table, one derived from such files
    by more than projections and filters included, is written once with a number for each row."""
    row = "_row"
    while row in map(str.lower, docs.columns):
        row += "_"
    if "_metadata" not in map(str.lower, docs.columns) and plain_scan(docs) and (files := docs.inputFiles()):
        names = {xxhash.xxh64_intdigest(f.encode(), 42) for f in files}
        try:
            keyed = docs.withColumn(row, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
            if len(names) == len(set(files)) and keyed.schema[row]:
                return keyed, row
        except AnalysisException:  # not Parquet
            pass
    return staged(docs.withColumn(row, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "rows"), row
