"""Feeds polled as a streaming source of our own.

Fetchers drop what they get in folders, ``<folder>/poll=<n>/feed_id=<id>/*.parquet`` with a ``_SUCCESS`` once poll n is whole. At each
trigger the source looks which polls are whole and which feeds are active just then; both stand in the offset, so a batch that
runs again reads the same. What an inactive feed dropped is passed over, as if it had not been polled."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "loom_polls"


def opened(uri: str):
    """(file system, path) of a URI or an absolute path."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri)


class PolledFile(InputPartition):
    def __init__(self, path: str, feed: int):
        self.path, self.feed = path, feed


class PollReader(DataSourceStreamReader):
    def __init__(self, folder: str, feeds: str, names: list[str]):
        self.folder, self.feeds, self.names = folder, feeds, names

    def initialOffset(self) -> dict:
        return {"poll": 0, "active": {}}

    def latestOffset(self) -> dict:
        return {"poll": max([0, *self.polls()]), "active": {str(k): True for k in self.active()}}

    def polls(self) -> list[int]:
        """Polls that are whole, up to the first that isn't there."""
        import pyarrow.fs

        fs, path = opened(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        numbers = {int(m[1]): x.path for x in found if (m := re.fullmatch(r"poll=(\d+)", x.base_name))}
        whole, n = [], 1
        while n in numbers and fs.get_file_info(f"{numbers[n]}/_SUCCESS").type != pyarrow.fs.FileType.NotFound:
            whole.append(n)
            n += 1
        return whole

    def active(self) -> list[int]:
        """Ids of the feeds that are active now: the table is read again each time it is asked."""
        import pyarrow.dataset as ds

        fs, path = opened(self.feeds)
        rows = ds.dataset(path, filesystem=fs, format="parquet").to_table(columns=["id", "active"]).to_pylist()
        return sorted(r["id"] for r in rows if r["active"])

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        import pyarrow.fs

        fs, path = opened(self.folder)
        out: list[InputPartition] = []
        for n in range(start["poll"] + 1, end["poll"] + 1):
            for feed in sorted(map(int, end["active"])):
                found = fs.get_file_info(pyarrow.fs.FileSelector(f"{path}/poll={n}/feed_id={feed}", allow_not_found=True))
                out += [PolledFile(x.path, feed) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".parquet")]
        return out or [PolledFile("", 0)]

    def read(self, partition: PolledFile) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq

        if not partition.path:
            return
        fs, _ = opened(self.folder)
        with fs.open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(columns=[c for c in self.names if c != "feed_id"]):
                columns = [pa.array([partition.feed] * b.num_rows, pa.int64()) if c == "feed_id" else b.column(c) for c in self.names]
                yield pa.RecordBatch.from_arrays(columns, names=self.names)


class Polls(DataSource):
    """Options folder and feeds; the schema is the caller's and has feed_id, a long."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "feed_id long, pos long, source_uri string"

    def streamReader(self, schema: StructType) -> PollReader:
        return PollReader(self.options["folder"], self.options["feeds"], schema.names)


def polls(spark: SparkSession, folder: str, feeds: str, schema: str | StructType | None = None) -> DataFrame:
    """The items of all feeds that are active when a trigger looks, as a stream."""
    spark.dataSource.register(Polls)
    reader = spark.readStream.format(NAME).option("folder", folder).option("feeds", feeds)
    return (reader.schema(schema) if schema is not None else reader).load()
