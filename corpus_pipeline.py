"""A training corpus from documents: poor texts out, one of each group of copies and near copies, no benchmark
passages, and the sources mixed to their target weights.

Each stage takes all that the one before kept, and its decisions take effect, row by row: an id may be null or repeat.
All but the last return the columns of documents; the last returns the mix: the drawn documents with the words taken
of each and their draws, the word ranges (shard, rank, start, n) that the shards take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, exact_dedup, mixing, quality, simhash
from loomgraph.llm.common import row_keyed, staged, table

#: Documents go when the classifier gives the best grade less probability than this.
LEAST_QUALITY = 0.5
#: Near copies: a Jaccard similarity of 0.8 or more over distinct five-word shingles, computed for each pair that the
#: sketches propose. At 0.8 sketches differ in about 39 of 256 bits, at worst (4 of 5 shingles) in about 48; the bounds
#: lose 3 in a million such pairs, at worst 2 in 10,000. Strangers' differ in about 128.
NEAR = {"width": 5, "words": 4, "radius": 24, "total": 72, "ratio": 0.8, "least": 0.8}


def without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """docs but the rows whose key is in dropped, and without the key.

    A merge join whatever the sizes: what is dropped grows with the corpus, so it is never broadcast."""
    return docs.join(dropped.select(row).hint("merge"), row, "left_anti").select(*[c for c in docs.columns if c != row])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is clean with a probability of LEAST_QUALITY or more, by the model of the labels table.

    A null or empty text is judged by its style; rows that repeat are judged alike; ids don't matter. Without labels all
    grades are equally likely and every row goes."""
    ratings = quality.grades_of(table(spark, sf_dir, "labels"))
    return quality.select_quality(docs, ratings, LEAST_QUALITY)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, a null text being empty: the one of the largest id, a null id last; of rows that
    share id and text, one."""
    docs, row = row_keyed(docs)
    key = F.struct("doc_id", F.col(row).alias("row"))  # the largest id stays, a null one last
    groups = exact_dedup.exact_groups(docs.select(key.alias("key"), "text"), "key")
    return without(docs, staged(groups.where("not kept").select(F.col("key.row").alias(row)), "copies"), row)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of the least id, a null id last. Groups are the components of the pairs
    whose sets of five-word shingles have a similarity of 0.8 or more; texts without words are one group."""
    docs, row = row_keyed(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))  # the least id stays, a null one last
    groups = simhash.near_groups(docs.select(key.alias("key"), "text"), "key", **NEAR)
    return without(docs, staged(groups.where("not key <=> component_id").select(F.col("key.row").alias(row)), "near-copies"), row)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a passage of the benchmark table, each by its own text: rows that share an id are told apart. Null and
    empty texts stay, and with an empty benchmark all rows do."""
    docs, row = row_keyed(docs)
    found = decontaminate.contamination_report(docs.select(row, "text"), table(spark, sf_dir, "benchmark"), row)
    return without(docs, staged(found.where("contaminated"), "leaks"), row)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes words of, with those words; columns of docs called like the mix's give way to them. Null and
    empty texts have no words to take; a null source is a source; rows that repeat are drawn like different ones."""
    docs, row = row_keyed(docs)
    mixed = mixing.mix(docs, carry=(row,)).where("taken > 0").select(row, "size", "source_size", "target", "taken", "draws")
    mixed = staged(mixed, "mix")
    return docs.drop(*mixed.columns[1:]).join(mixed.hint("merge"), row).drop(row)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
