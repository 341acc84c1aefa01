"""Files of documents as a data source of our own: ``spark.read.format("loom_files")``.

A partition is a run of files of about ``partition_bytes`` or ``partition_files``; ``only`` and ``but`` list suffixes to open or to
leave out, with commas. Each file is a row: Markdown and Word files with
their text, PDFs with the texts of their pages as far as a reader of theirs was registered, and what can't be read with the
reason why. Listing is the driver's, reading the executors'."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .polling import opened
from .readers import MIME, docx_text, page_texts

NAME = "loom_files"
SCHEMA = "source_uri string, title string, suffix string, mime_type string, text string, pages array<string>, error string"
Pages = Callable[[bytes], list[str]]


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def split_name(path: str) -> tuple[str, str]:
    """(title, suffix): the name without its suffix, and that in lower case."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, suffix = name.rpartition(".")
    return (stem, suffix.lower()) if dot and stem else (name, "")


def parsed(data: bytes, suffix: str, pdf_pages: Pages | None) -> tuple[str | None, list[str] | None, str | None]:
    """(text, pages, error) of a file."""
    try:
        if suffix == "md":
            text = data.decode("utf-8").strip()
        elif suffix == "docx":
            text = docx_text(data).strip()
        elif suffix == "pdf" and pdf_pages is not None:
            return None, list(pdf_pages(data)), None
        else:
            return None, None, f"unsupported suffix: {suffix}"
    except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError, ValueError) as e:
        return None, None, f"damaged: {type(e).__name__}"
    return (text, None, None) if text else (None, None, "blank")


class FileReader(DataSourceReader):
    def __init__(self, options: dict, pdf_pages: Pages | None):
        self.path, self.pdf_pages = options["path"], pdf_pages
        self.bytes, self.files = int(options.get("partition_bytes", 64 << 20)), int(options.get("partition_files", 1000))
        listed = lambda name: set(filter(None, options.get(name, "").lower().split(",")))
        self.only, self.but = listed("only"), listed("but")

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs

        fs, path = opened(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        out, held, size = [], [], 0
        for x in sorted((x for x in found if x.is_file), key=lambda x: x.path):
            name = x.path.rsplit("/", 1)[-1]
            suffix = split_name(name)[1]
            if name[0] in "._" or self.only and suffix not in self.only or suffix in self.but:
                continue
            if held and (size + x.size > self.bytes or len(held) >= self.files):
                out.append(Files(held))
                held, size = [], 0
            held.append(x.path)
            size += x.size
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for path in partition.paths:
            title, suffix = split_name(path)
            with fs.open_input_file(path) as f:
                text, pages, error = parsed(f.read(), suffix, self.pdf_pages)
            yield path, title, suffix, MIME.get(suffix), text, pages, error


def file_source(pdf_pages: Pages | None = None) -> type[DataSource]:
    """The data source, with a reader of PDFs (bytes to the texts of their pages) if there is one."""

    class DocumentFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return FileReader(self.options, pdf_pages)

    return DocumentFiles


def read_files(spark: SparkSession, path: str, pdf_pages: Pages | None = None, **options) -> DataFrame:
    """(source_uri, title, suffix, mime_type, text, error) of all files under a path. Pages of PDFs are cleaned and joined as
    page_texts does; one without text on any page is blank."""
    spark.dataSource.register(file_source(pdf_pages))
    load = lambda **own: spark.read.format(NAME).options(**options, **own).load(path)
    if pdf_pages is None:
        return load().drop("pages")
    paged = load(only="pdf")
    clean = paged.drop("text").join(page_texts(paged.select(F.col("source_uri").alias("id"), "pages")).withColumnRenamed("id", "source_uri"), "source_uri", "left")
    clean = clean.withColumn("error", F.coalesce("error", F.when(F.col("text").isNull(), "blank")))
    out = ["source_uri", "title", "suffix", "mime_type", "text", "error"]
    return load(but="pdf").select(*out).unionByName(clean.select(*out))


def docx_of(paragraphs: list[str], rows: list[list[str]] = ()) -> bytes:
    """A Word file of paragraphs and one table, as small as one can be. For tests and made-up inputs."""
    from xml.sax.saxutils import escape

    run = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    table = "".join(f"<w:tr>{''.join(f'<w:tc>{run(c)}</w:tc>' for c in r)}</w:tr>" for r in rows)
    body = "".join(map(run, paragraphs)) + (f"<w:tbl>{table}</w:tbl>" if rows else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
