"""Sign bits before distance, as a rung of their own and as proposals that the vectors check."""

import duckdb

from loomgraph.operators import resolve as R
from loomgraph.plans import registry

VECTORS = {
    1: [0.8, 0.35, 0.35, 0.35],  # the bits of 60, farther than 2
    2: [1.0, -0.01, 0.0, -0.01],  # nearest to 60, of other bits
    3: [0.0, 0.6, -0.8, 0.0],  # the vector of 120, as 4 is
    4: [0.0, 0.6, -0.8, 0.0],
    60: [1.0, 0.01, 0.01, 0.01],
    120: [0.0, 0.6, -0.8, 0.0],
    180: [-1.0, -0.1, 0.0, -0.1],  # far from all
    100: [0.0, 0.6, -0.8, 0.0],  # known by name
}


def tables(spark, path):
    part = [(k, "hot gear" if k in (1, 100) else f"name {k}", "Brand#1", "SMALL") for k in VECTORS]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(k, v, 0) for k, v in VECTORS.items()], "vec_id long, embedding array<double>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")


def test_hash_first_equals_its_sql(spark, tmp_path):
    tables(spark, tmp_path)
    name = "er1g_match_hash_first"
    got = {r.cand: (r.engram_id, r.reason, r.cosine) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    for t in ("part", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in duck.execute(f"SELECT cand, engram_id, reason, cosine FROM ({registry.oracle_sql()[name]})").fetchall()}
    assert got == want
    assert got[60][:2] == (2, "vector_similarity") and got[120] == (3, "vector_similarity", 1.0) and got[180] == (None, "none", None) and got[100] == (1, "exact_name", None)


def test_sign_bits_as_a_rung(spark):
    """Unchecked, equal sign bits decide before distance."""
    rows = lambda ids, names: spark.createDataFrame([(k, f"name {k}", VECTORS[k]) for k in ids], names)
    known = rows((1, 2, 3, 4), "id long, canonical_name string, embedding array<double>")
    found = R.match(rows((60, 120), "cand long, name string, embedding array<double>").replace({"name 60": "x", "name 120": "y"}), known, known.withColumnRenamed("id", "engram_id"), 5, 0.3, hash_first=True)
    assert {r.cand: (r.engram_id, r.reason) for r in found.collect()} == {60: (1, "concept_hash"), 120: (3, "concept_hash")}
