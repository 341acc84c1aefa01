"""Exact deduplication by content-defined chunk recipes. DataFrame functions only.

A text is cut where its own content says so, at least ``lo`` and at most ``hi`` characters on: after a sentence or line
end, without one after two equal characters, and at ``hi`` only where there is neither. Distinct chunks are compared by content once, which proves that a digest names one chunk; then
each document is the ordered list of its chunks' digests, and documents are grouped by that list. A long text
moves at most once as chunks, and copies of it move as one distinct chunk a task.

If one digest ever names two chunks, the lists carry the chunks themselves, so that equality stays exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_join, staged

ENDS = r".!?\n。！？；"
Digest = Callable[[Column], Column]


def sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def chunks(text: Column, lo: int = 512, hi: int = 4096) -> Column:
    """array<string>: the text in content-defined pieces, whose concatenation is the text."""
    at_end, at_pair = rf".{{{lo},{hi}}}?(?:(?<=[{ENDS}])|\z)", rf".{{{lo},{hi - 2}}}?(.)\1"
    return F.regexp_extract_all(text, F.lit(rf"(?s){at_end}|{at_pair}|.{{1,{hi}}}"), F.lit(0))


def digests_verified(texts: DataFrame, digest: Digest, lo: int, hi: int) -> bool:
    """Whether no digest names two different chunks of column ``text``."""
    distinct = texts.select(F.explode(chunks(F.col("text"), lo, hi)).alias("chunk")).distinct()
    twice = distinct.groupBy(digest(F.col("chunk")).alias("digest")).count().where("count > 1")
    return twice.isEmpty()


def recipes(docs: DataFrame, id_col: str, text_col: str, digest: Digest = sha256, lo: int = 512, hi: int = 4096) -> DataFrame:
    """(id, text_sha256, recipe array<binary>), staged."""
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    name = digest if digests_verified(texts.select("text"), digest, lo, hi) else lambda c: F.encode(c, "UTF-8")
    return staged(
        texts.select(
            id_col,
            F.sha2("text", 256).alias("text_sha256"),
            F.transform(chunks(F.col("text"), lo, hi), lambda c: name(c)).alias("recipe"),
        ),
        "recipes",
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha256, lo: int = 512, hi: int = 4096
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical; a null text is empty. Of equal texts the largest id stays. Rows that repeat
    an id and its text are all marked kept where that id stays, and count each in group_size; a null id never
    beats another and is kept only in a group that has no other. An empty table gives no rows. Other columns of
    docs are not read.
    """
    r = recipes(docs, id_col, text_col, digest, lo, hi)
    groups = r.groupBy("recipe").agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return split_join(r, groups, ["recipe"]).select(
        id_col,
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
