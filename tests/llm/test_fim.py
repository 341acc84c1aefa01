"""Fill-in-the-middle against plain Python, and odd cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, fim

from .conftest import ROWS


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    return Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect())


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_random_texts(spark, block):
    rng = random.Random(block)
    rows = [(k, "".join(rng.choice(["a", "Zq", " ", "\n", "é", "𝒳", "<", "P>", "<P", "S", ">", "<M", "1"]) for _ in range(rng.choice([0, 1, 2, 5, 31, 32, 33, 64, 65, 200])))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((k, *plain(k, t)) for k, t in rows)
    assert rows_of(fim.fill_in_middle(df, block=block)) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_odd_rows(odd, empty):
    assert rows_of(fim.fill_in_middle(odd)) == Counter((r[0], *plain(r[0], r[1])) for r in ROWS)
    assert fim.fill_in_middle(empty).collect() == []


def test_files_and_rebuilt_texts(spark, docs):
    got = fim.fim_report(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(texts)
    for r in got:
        n, form, a, b, out = plain(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(out), sha(texts[r.doc_id]))


def test_rows_of_one_id_and_exploded_files(spark, docs):
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    assert not common.plain_scan(lines) and common.plain_scan(docs.where("doc_id > 3"))
    want = Counter((r.doc_id, *plain(r.doc_id, r.text)) for r in lines.collect())
    assert rows_of(fim.fill_in_middle(lines)) == want


def test_units_of_another_kind(spark):
    df = spark.createDataFrame([(k, "one two  three\nfour five six") for k in range(40)], "doc_id long, text string")
    got = fim.fill_in_middle(df, units=r"\S+\s*|\s+", plain_share=0).collect()
    assert {r.n for r in got} == {6} and all(r.form != "plain" for r in got)
    starts = {0, 4, 9, 15, 20, 25, 28}
    assert {r.prefix_chars for r in got} <= starts and {r.prefix_chars + r.middle_chars for r in got} <= starts


def test_texts_are_packed_to_be_shuffled(spark):
    """No exchange of the plan that cuts the texts moves a text as it is; what comes out is the text all the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = fim.fill_in_middle(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"MapInArrow run\(.*text", plan) and "packed" in plan
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(texts) and all(r.back == texts[r.doc_id] for r in got)
