"""Fill-in-the-middle as relational units.

A text is cut into units by a pattern. posexplode lays its matches out as rows, a window sums their lengths, the cut
requests of a document join by the ordinal of a unit, the offsets of a document's cuts are aggregated, and substring cuts
the text there.

It is done twice, so that few rows stand for a text: first with blocks of ``block`` units as matches, whose offsets lead a
request to the block it falls into (its ordinal divided by the block's size), then with the units of those blocks alone. A
document of n units is n / block rows and 2 * block more, not n; only rows of numbers and the blocks asked for are shuffled,
and whole texts once, compressed, to be cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import row_keyed, staged
from .debruijn import packed, unpacked

#: Letters in a row, or anything else by itself. Matches must cover a text without a gap.
UNITS = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def digest_numbers(id_col: Column) -> list[Column]:
    """The first four groups of eight digits of sha256('1:' and the id) as numbers; a null id counts as empty."""
    hexed = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def form_of(text: Column, h3: Column, h4: Column, plain_share: int, spm_share: int) -> Column:
    """plain, psm or spm."""
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= 100 - plain_share)
    return F.when(plain, "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")


def cut_requests(docs: DataFrame, row: str, units: str = UNITS, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """docs (row, id, text) with n, form and the ordinals of the cuts, first and second: how many units stand before each."""
    h1, h2, h3, h4 = digest_numbers(F.col("id"))
    n = F.length(F.regexp_replace("text", units, ".")).cast("long")  # matches cover the text, so one character each
    counted = docs.select(row, "id", "text", n.alias("n"), form_of(F.col("text"), h3, h4, plain_share, spm_share).alias("form"))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return counted.withColumns({"first": F.least(a, b), "second": F.greatest(a, b)})


def cut_offsets(asked: DataFrame, requests: DataFrame, row: str, units: str = UNITS, block: int = 32) -> DataFrame:
    """(row, first_at, second_at): code points before the cuts of requests (row, cut, ordinal), cut 0 or 1 and ordinal over 0,
    in the texts of asked (row, text, first, second).

    A cut ends the unit of ordinal - 1, so every request has a block and a unit. Joins go by row alone and compare the
    ordinals beside it: a row has at most two blocks asked for, and the windows' partitioning serves every step."""
    blocks = F.regexp_extract_all("text", F.lit(f"(?:{units}){{1,{block}}}+"), F.lit(0))
    number = lambda c: F.floor((c - 1) / block).cast("int")
    laid = asked.select(row, "first", "second", F.posexplode(blocks).alias("pos", "piece"))
    wanted = (F.col("pos") == number(F.col("first"))) | (F.col("pos") == number(F.col("second")))
    laid = laid.select(row, "pos", F.length("piece").alias("chars"), F.when(wanted, F.col("piece")).alias("piece"))
    before = W.partitionBy(row).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    offsets = laid.withColumn("offset", F.coalesce(F.sum("chars").over(before), F.lit(0).cast("long"))).where("piece is not null").drop("chars")
    asks = requests.select(row, "cut", number(F.col("ordinal")).alias("in_block"), ((F.col("ordinal") - 1) % block).cast("int").alias("within"))
    found = offsets.join(asks.hint("shuffle_hash"), row).where("pos - in_block = 0")
    inner = found.select(row, "cut", "within", "offset", F.posexplode(F.regexp_extract_all("piece", F.lit(units), F.lit(0))).alias("unit", "match"))
    upto = W.partitionBy(row, "cut").orderBy("unit").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = inner.select(row, "cut", "within", "unit", (F.col("offset") + F.sum(F.length("match")).over(upto)).alias("at")).where("unit = within")
    at = lambda cut: F.max(F.when(F.col("cut") == cut, F.col("at")))
    return ends.groupBy(row).agg(at(0).alias("first_at"), at(1).alias("second_at"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a marker of its own is plain, and no marker can arise where a part and
    a marker meet, so the first of each marker is the one put there."""
    after = lambda mark: F.locate(mark, output)
    part = lambda a, b: F.substr(output, a, b - a)
    n, p, s, m = F.length(output) + 1, after(PREFIX), after(SUFFIX), after(MIDDLE)
    psm = F.concat(part(p + 3, s), part(m + 3, n), part(s + 3, m))
    spm = F.concat(part(p + 3, m), part(m + 3, n), part(s + 3, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def opened(rows: DataFrame) -> DataFrame:
    """rows with ``packed`` (see debruijn.packed) as its text, in a column text."""
    others = [c for c in rows.columns if c != "packed"]
    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array(unpacked(b.column(len(others))), pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=schema.names)

    return rows.select(*others, "packed").mapInArrow(run, schema)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = UNITS, plain_share: int = 10, spm_share: int = 20, block: int = 32
) -> DataFrame:
    """One row per input row: id, n, form, prefix_chars, middle_chars (null if plain) and output.

    The cuts stand after two numbers of units drawn by the id, so rows that repeat an id and its text have equal results.
    A null text is empty and plain; a null id draws as an empty one. The matches of ``units`` must cover any text. An empty
    table gives no rows and other columns are not read."""
    docs, row = row_keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    asked = cut_requests(docs, row, units, plain_share, spm_share)
    stated = staged(asked.drop("text"), "fim-requests")
    todo = stated.where("form <> 'plain'")
    requests = todo.select(row, F.posexplode(F.array("first", "second")).alias("cut", "ordinal")).where("ordinal > 0")
    cuts = cut_offsets(asked.where("form <> 'plain' and second > 0"), requests, row, units, block)
    cuts = staged(stated.join(cuts, row, "left").select(row, "n", "form", "first_at", "second_at"), "fim-cuts")
    both = opened(packed(docs, row).join(cuts.hint("shuffle_hash"), row).drop(row))
    cut = F.col("form") != "plain"
    a, b = F.coalesce("first_at", F.lit(0)), F.coalesce("second_at", F.lit(0))
    prefix, middle, suffix = F.substr("text", F.lit(1), a), F.substr("text", a + 1, b - a), F.substr("text", b + 1)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return both.select(
        F.col("id").alias(id_col), "n", "form", F.when(cut, a).cast("long").alias("prefix_chars"), F.when(cut, b - a).cast("long").alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def fim_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fill_in_middle with digests instead of outputs: of the output, and of the text rebuilt from output and form."""
    out = fill_in_middle(docs, id_col, text_col)
    return out.select(
        id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )
