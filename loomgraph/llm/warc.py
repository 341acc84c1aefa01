"""WARC archives and their capture index.

Pages are written as WARC 1.1 records (one gzip member each) by the tasks that hold them, each task into files of
its own; payloads that an earlier page already has become revisit records. Reading an archive back gives a run of
index lines sorted by URL key and time. Runs are merged by key range: every range takes its slice of each run and
merges the slices with a loser tree, so the ranges in order are the capture histories in global order. What a task
holds is bounded: a run has at most ``max_records`` lines, and there are as many ranges as give each
``range_records`` lines; lines of one key are told apart by run and place, so no key is too busy for its range.

Files go through pyarrow's file systems by URI, so the folder can be any that the cluster shares.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, split_join, staged, staging_path

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels reversed, then path and query: a.example.com/x to com,example,a)/x. Null without a ://."""
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))
    return F.when(at > 0, key)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (pyarrow.fs.LocalFileSystem(), uri) if "://" not in uri else pyarrow.fs.FileSystem.from_uri(uri)


def record(kind: str, page: str | None, url: str | None, date: str, digest: str, n: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record with an HTTP block; a revisit has the block's head only."""
    block = HTTP + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest} {date}')}>"), ("WARC-Date", date)]
    if any(c in x for x in (url or "", page or "", refers_to or "") for c in "\r\n"):  # a line end in a value would end its header
        url, page, refers_to = map(escaped, (url, page, refers_to))
        head.append(("X-Escaped", "1"))
    if url is not None:
        head.append(("WARC-Target-URI", url))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(n))]
    if page is not None:
        head.append(("X-Page-Id", page))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT), ("X-Refers-To-Page", refers_to)]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def escaped(value: str | None) -> str | None:
    return value and value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def unescaped(value: str | None) -> str | None:
    return value and value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def read_records(f: BinaryIO, chunk: int = 1 << 20) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each gzip member of an archive."""
    offset, data = 0, b""
    while data or (data := f.read(chunk)):
        member, parts, used = zlib.decompressobj(31), [], 0
        while not member.eof:
            if not data and not (data := f.read(chunk)):
                raise EOFError(f"the record at {offset} is cut off")
            parts.append(member.decompress(data))
            used += len(data) - len(member.unused_data)
            data = member.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        if headers.pop("X-Escaped", None):
            headers |= {k: unescaped(headers[k]) for k in ("WARC-Target-URI", "X-Page-Id", "X-Refers-To-Page") if k in headers}
        block = body[: int(headers["Content-Length"])]
        yield offset, used, headers, block.partition(b"\r\n\r\n")[2]
        offset += used


class LoserTree:
    """k-way merge of sorted lists: inner nodes hold the losers, so the next winner costs log2(k) comparisons."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(self.k, 1)
        self.winner = self._build(1) if self.k else -1

    def _head(self, run: int):
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) < (y, b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.k and (head := self._head(self.winner)) is not None:
            yield head
            run = self.winner
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def revisits(measured: DataFrame, least: int) -> DataFrame:
    """(id, digest, refers_to) of the pages whose payload of ``least`` bytes or more a page of smaller id has."""
    large = measured.where(F.col("n") >= least)
    first = large.groupBy("digest").agg(F.min("id").alias("refers_to"))
    return split_join(large, first, ["digest"]).where("id <> refers_to or id is null").select("id", "digest", "refers_to").where("refers_to is not null").distinct()


def write_archives(records: DataFrame, folder: str, max_bytes: int = 1 << 30, max_records: int = 100_000, level: int = 4) -> DataFrame:
    """Write (id, url, date, digest, n, payload, refers_to) as archives; the manifest (path, records, bytes).

    A file is named once and appears whole or not at all; a task that runs again writes new files, and only the
    files of the run that counts are in the manifest."""
    columns = ["id", "url", "date", "digest", "n", "payload", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, path, count, size = None, "", 0, 0

        def close():
            out.close()
            fs.move(f"{path}.open", path)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rpartition('/')[2]}"], "records": [count], "bytes": [size]})

        for b in batches:
            for page, url, date, digest, n, payload, refers_to in zip(*(b.column(k).to_pylist() for k in range(7))):
                if out is None:
                    path, count, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}.open", compression=None)
                raw = record("revisit" if refers_to is not None else "response", page, url, date, digest, n, payload, refers_to)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= max_bytes or count >= max_records:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return staged(records.select(*columns).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


INDEX = "run string, seq long, url_key string, date string, id string, payload_bytes long, payload_digest string, record_type string, refers_to string, offset long, length long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """The archives' index lines, a sorted run for each file. Payloads must have the digest and length stated."""
    files = manifest.count()  # a row of the manifest is one archive
    names = [x.split()[0] for x in INDEX.split(", ")]

    def key_of(url: str | None) -> str | None:
        if url is None or "://" not in url:
            return None
        rest = url.split("://", 1)[1].split("#")[0]
        end = min((i for c in "/?" if (i := rest.find(c)) >= 0), default=len(rest))
        host = rest[:end].encode().translate(ASCII_LOWER).decode()
        return ",".join(reversed(host.split("."))) + ")" + rest[end:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = file_system(path)
                lines = []
                with fs.open_input_stream(p, compression=None) as f:
                    for offset, length, h, payload in read_records(f):
                        digest, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: the record at {offset} isn't what was written")
                        lines.append((key_of(h.get("WARC-Target-URI")), h["WARC-Date"], h.get("X-Page-Id"), n, digest, h["WARC-Type"], h.get("X-Refers-To-Page"), offset, length))
                lines.sort(key=lambda x: tuple(("" if c is None else c) for c in x[:3]))
                rows = [(path, k, *x) for k, x in enumerate(lines)]
                if rows:
                    kinds = [pa.int64() if " long" in x else pa.string() for x in INDEX.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return manifest.select("path").repartition(max(1, min(files, 10_000))).mapInArrow(run, INDEX)


ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def merge_runs(runs: DataFrame, ranges: int) -> DataFrame:
    """Index lines of all runs in global order of URL key, time and page: partitions are key ranges in order, and
    each merges its slices of the runs with a loser tree. Ranges are cut by all three and by the place in the run, so
    neither a busy URL nor a row that is repeated for ever is a single range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)  # the index lines of one range
        t = t.sort_by([("run", "ascending"), ("seq", "ascending")])
        keys = list(zip(*([("" if x is None else x) for x in t.column(c).to_pylist()] for c in ("url_key", "date", "id")), range(t.num_rows)))
        names, slices = t.column("run").to_pylist(), []
        for k, name in enumerate(names):
            if not k or name != names[k - 1]:
                slices.append([])
            slices[-1].append(keys[k])
        order = pa.array([x[3] for x in LoserTree(slices)], pa.int64())
        yield from t.take(order).combine_chunks().to_batches()

    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return runs.repartitionByRange(ranges, empty("url_key"), "date", empty("id"), "run", "seq").mapInArrow(run, runs.schema)


def capture_index(
    pages: DataFrame,
    date: Callable[[DataFrame], Column] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = 100,
    folder: str | None = None,
    max_records: int = 100_000,
    range_records: int = 50_000,
) -> DataFrame:
    """Write pages as archives in ``folder``, read them back, and return the merged index in global order:
    id, url_key, captured_at, payload_bytes, payload_digest, record_type, refers_to, archive, offset, length.

    Of equal payloads (SHA-256) of ``least`` bytes or more, the page of least id is the response and the others
    revisit it; rows that repeat that page are responses too. A null payload is empty; a null URL has no key and
    sorts first, as does a null id, which revisits a page that has one. Ids and URLs come back as they were, line ends
    in them included. Rows that repeat are records each. An empty table gives an empty index; other columns are not
    read.
    """
    kind = pages.schema[id_col].dataType
    stamp = F.date_format(date(pages) if date else F.timestamp_seconds(F.lit(0)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), stamp.alias("date"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    again = revisits(staged(base.select("id", "digest", "n"), "warc-digests"), least).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    records = base.join(again, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    records = records.withColumns({"id": F.col("id").cast("string"), "refers_to": F.col("refers_to").cast("string"), "date": F.coalesce("date", F.lit("1970-01-01T00:00:00Z"))})
    manifest = write_archives(records, folder or staging_path(pages.sparkSession, "warc"), max_records=max_records)
    total = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    runs = staged(read_archives(manifest), "warc-runs")
    return merge_runs(runs, max(1, -(-total // range_records))).select(
        F.col("id").cast(kind).alias(id_col),
        "url_key",
        F.to_timestamp("date").alias("captured_at"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        F.col("run").alias("archive"),
        "offset",
        "length",
    )
