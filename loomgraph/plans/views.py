"""The knowledge-graph tables as views of the test tables, in SQL that Spark and DuckDB both run.

Orders stand for dated documents, parts for concepts, line items for the links and typed edges between them,
and embeddings for concept vectors. Line items of one order may share a number, so edges are told apart by their other
columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "kd": """
        SELECT o_orderkey AS id,
          CASE o_orderkey % 5 WHEN 0 THEN 'scribble' WHEN 1 THEN 'file' WHEN 2 THEN 'feed' WHEN 3 THEN 'url' ELSE 'synthesis' END AS source_type,
          CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Order ', CAST(o_orderkey AS STRING)) END AS title,
          concat(o_orderpriority, ' ', o_orderstatus) AS text,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '' ELSE concat('Tidy ', CAST(o_orderkey AS STRING)) END AS tidy_title,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'tidy text' END AS tidy_text,
          CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'light_cleanup' ELSE 'full' END AS tidy_level,
          CASE WHEN o_orderkey % 6 = 0 THEN 'noted' WHEN o_orderkey % 6 = 1 THEN '' ELSE NULL END AS annotation,
          CASE WHEN o_orderkey % 5 IN (2, 3) THEN concat('http://example.com/', CAST(o_custkey % 500 AS STRING)) ELSE NULL END AS source_uri,
          CASE WHEN o_orderkey % 11 = 0 THEN 'application/pdf' ELSE 'text/plain' END AS mime_type,
          CAST(o_orderkey % 3 - 1 AS INT) AS triaged,
          CAST(o_custkey % 3 AS INT) AS processed,
          CAST(1 + o_orderkey % 6 AS INT) AS revision,
          CASE o_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'reference' ELSE 'dormant' END AS heat_tier,
          CAST(o_orderdate AS TIMESTAMP) AS created_at,
          CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS TIMESTAMP) AS updated_at
        FROM orders""",
    "ke": """
        SELECT p_partkey AS id, p_name AS canonical_name,
          CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS description,
          CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'article' END AS article,
          CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE CAST(DATE '1998-01-01' + CAST(p_partkey % 1000 AS INT) AS TIMESTAMP) END AS article_updated_at,
          CAST(DATE '1996-01-01' + CAST(p_partkey % 700 AS INT) AS TIMESTAMP) AS created_at
        FROM part""",
    "kl": "SELECT DISTINCT l_orderkey AS document_id, l_partkey AS engram_id FROM lineitem",
    "kx0": """
        SELECT (l_orderkey * 10 + l_linenumber) * 100 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate, l_discount, l_quantity, l_extendedprice, l_tax) AS id, l_partkey AS source, l_suppkey * 3 AS target,
          CASE concat(l_returnflag, l_linestatus) WHEN 'RO' THEN 'supports' WHEN 'NO' THEN 'contradicts' WHEN 'NF' THEN 'related_to'
            WHEN 'AF' THEN 'part_of' WHEN 'AO' THEN 'causes' ELSE 'precedes' END AS predicate,
          round(1 - l_discount, 2) AS confidence,
          CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_orderkey END AS document_id,
          CAST(l_shipdate AS TIMESTAMP) AS created_at
        FROM lineitem""",
    "kx": """
        SELECT id, source, target, predicate, confidence, document_id, created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY source, target, predicate ORDER BY id) AS rn FROM kx0) AS q WHERE rn = 1""",
    "kissue": """
        SELECT id, CASE id % 3 WHEN 0 THEN 'orphan' WHEN 1 THEN 'contradiction' ELSE 'missing_link' END AS issue_type,
          CASE id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'error' END AS severity,
          source AS first_id, target AS second_id, id % 5 = 0 AS resolved, created_at
       
        FROM kx""",
}


def needed(sql: str) -> list[str]:
    """The views that sql uses, each after those that it uses itself."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def oracle(sql: str) -> str:
    """sql for DuckDB with the views it uses as common table expressions."""
    names = needed(sql)
    if not names:
        return sql
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if re.match(r"WITH\b", body) else f"WITH {ctes} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = oracle(f"SELECT * FROM {name}")
    used = {t: view(spark, sf_dir, t) for t in TABLES if re.search(rf"(\bFROM|,|\bJOIN)\s+{t}\b", sql)}
    for t in used:
        sql = re.sub(rf"(\bFROM|,|\bJOIN)(\s+){t}\b", rf"\1\2{{{t}}}", sql)
    return spark.sql(sql, **used)
