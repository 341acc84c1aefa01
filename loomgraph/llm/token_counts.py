"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Token lengths in bytes give token spans, and an interval join against the
document's sorted sections (both sides in order, a binary search for each boundary) attributes every token. A
token that crosses a boundary goes by an explicit rule:

  start     to the section of its first byte
  end       to the section of its last byte
  majority  to the section with most of its bytes, the earlier one if equal
  split     to every section it touches, in proportion to its bytes

Tokens outside all sections are counted apart. Documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = ("start", "end", "majority", "split")
#: The pre-tokenisation that belongs to the byte-level BPE vocabularies; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load(path: str):
    """A byte-level BPE encoding, and the length in bytes of each token id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(k) for k in ranks]
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section (rows start, end in bytes; sorted, disjoint), the last entry for those outside.

    ends: where each token ends; a token begins where the one before ends."""
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    n = len(sections)
    if rule == "split" or rule == "majority":
        # share of each section in each token, as a sparse list of (token, section, bytes)
        first = np.searchsorted(sections[:, 1], starts, "right")
        last = np.searchsorted(sections[:, 0], ends, "left")
        touched = np.maximum(last - first, 0)
        token = np.repeat(np.arange(len(ends)), touched)
        section = first[token] + np.arange(touched.sum()) - np.repeat(np.cumsum(touched) - touched, touched)
        size = np.minimum(ends[token], sections[section, 1]) - np.maximum(starts[token], sections[section, 0])
        whole = ends - starts
        outside = whole - np.bincount(token, size, len(ends))
        if rule == "split":
            share = np.bincount(section, size / whole[token], n + 1)
            share[n] = (outside / whole).sum()
            return share
        best = np.full(len(ends), n)
        order = np.lexsort((section, -size, token))
        lead = order[np.concatenate(([True], token[order][1:] != token[order][:-1]))] if len(order) else order
        best[token[lead]] = np.where(size[lead] >= outside[token[lead]], section[lead], n)
        return np.bincount(best, minlength=n + 1).astype(float)
    at = starts if rule == "start" else ends - 1
    section = np.searchsorted(sections[:, 1], at, "right")
    inside = (section < n) & (at >= np.concatenate((sections[:, 0], [np.iinfo(np.int64).max]))[section])
    return np.bincount(np.where(inside, section, n), minlength=n + 1).astype(float)


def byte_spans(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Code-point spans as byte spans of the UTF-8 text; ends beyond the text are its end."""
    lead = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    at = np.concatenate((lead, [len(text)]))
    return at[np.clip(spans, 0, len(lead))]


def line_sections(text: Column) -> Column:
    """Title (the first line), body and tail (the last line, if there are three or more) as (name, start, end) in
    code points; a line break belongs to the line it ends."""
    n = F.length(text)
    first = F.when(F.locate("\n", text) > 0, F.locate("\n", text)).otherwise(n)
    last = F.when(F.locate("\n", text) > 0, n - F.locate("\n", F.reverse(text)) + 1).otherwise(n)
    section = lambda name, a, b: F.struct(F.lit(name).alias("name"), a.cast("long").alias("start"), b.cast("long").alias("end"))
    return F.array(section("title", F.lit(0), first), section("body", first, F.greatest(last, first)), section("tail", F.greatest(last, first), n))


def token_counts(
    docs: DataFrame,
    sections: Callable[[Column], Column] = line_sections,
    rule: str = "start",
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_tokens, n_crossing, outside and counts (name, tokens) in section order.

    ``sections`` gives an array of (name, start, end) in code points from the text column; spans are taken in
    order of start, and a span that overlaps an earlier one begins where that ends. Sections of equal name add
    up. Null and empty texts have no tokens. Repeated rows give repeated rows, an empty table none; other columns
    are not read. A file of the vocabulary must be at the same path on every executor.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or default_vocabulary()
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_crossing", T.LongType()),
            T.StructField("outside", T.DoubleType()),
            T.StructField("counts", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("tokens", T.DoubleType())]))),
        ]
    )
    counts_type = pa.list_(pa.struct([("name", pa.string()), ("tokens", pa.float64())]))

    def count(encoding, lengths, text: bytes, spans: list[dict]):
        ids = encoding.encode_to_numpy(text.decode("utf-8", "replace"), disallowed_special=()) if text else np.empty(0, np.int64)
        ends = np.cumsum(lengths[ids.astype(np.int64)])
        spans = sorted((s for s in spans if s["start"] < s["end"]), key=lambda s: s["start"])
        cut = byte_spans(text, np.array([(s["start"], s["end"]) for s in spans], np.int64).reshape(-1, 2))
        if len(cut):
            cut[1:, 0] = np.maximum(cut[1:, 0], np.maximum.accumulate(cut[:, 1])[:-1])
            cut[:, 1] = np.maximum(cut[:, 1], cut[:, 0])
        got = attribute(ends, cut, rule)
        edges = np.unique(cut)
        starts = ends - lengths[ids.astype(np.int64)]
        crossing = (np.searchsorted(edges, ends, "left") > np.searchsorted(edges, starts, "right")).sum()
        names: dict[str, float] = {}
        for s, x in zip(spans, got):
            names[s["name"]] = names.get(s["name"], 0.0) + float(x)
        return len(ids), int(crossing), float(got[-1]), [{"name": k, "tokens": v} for k, v in names.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = load(path)
        for b in batches:
            texts, spans = b.column(1).cast(pa.binary()), b.column(2)
            rows = [count(encoding, lengths, t.as_py() or b"", s.as_py() or []) for t, s in zip(texts, spans)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.float64(), counts_type]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, text.alias("text"), sections(text).alias("sections")).mapInArrow(run, schema)


def token_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, title_tokens, body_tokens, tail_tokens, outside and n_crossing."""
    of = lambda name: F.coalesce(F.get(F.filter("counts", lambda x: x["name"] == name), 0)["tokens"], F.lit(0.0))
    counted = token_counts(docs, line_sections, rule, vocabulary, id_col, text_col)
    return counted.select(id_col, "n_tokens", *[of(x).alias(f"{x}_tokens") for x in ("title", "body", "tail")], "outside", "n_crossing")
