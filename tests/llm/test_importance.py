"""Importance resampling against plain Python, and odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import importance, queries

from .conftest import ROWS, SMALL


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in runs(t, longest))
    t = Counter(bucket(f) for x in target for f in runs(x, longest))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, x in rows:
        f = runs(x, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: len(enough) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def rows_of(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect())


def test_whole_table(spark, docs):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in benchmark.collect()])
    got = queries.op12_importance_resampling(spark, SMALL)
    assert rows_of(got) == want and sorted(got.columns) == sorted(["doc_id", "n_features", "weight", "score", "rank"])
    assert {t for c, t in got.dtypes} == {"bigint"} and any(r[4] for r in want)


@pytest.mark.parametrize("longest, buckets, percent", [(2, 64, 50), (3, 65536, 100), (1, 1, 33)])
def test_other_parameters_and_odd_rows(spark, odd, empty, longest, buckets, percent):
    target = [None, "", "lorem ipsum dolor", "the quick brown fox"]
    df = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(odd, df, percent=percent, least_words=3, longest=longest, buckets=buckets)
    assert rows_of(got) == plain([(r[0], r[1]) for r in ROWS], target, percent, 3, longest, buckets)
    assert importance.resample(empty, df).collect() == []
    assert rows_of(importance.resample(odd, df.limit(0), buckets=buckets)) == plain([(r[0], r[1]) for r in ROWS], [], buckets=buckets)


def test_bounds():
    with pytest.raises(ValueError):
        importance.streams(None, "doc_id", "text", 70_000)
    values, lengths = importance.run_lengths(np.array([5, 1, 5, 5, 0], np.uint16))
    assert values.tolist() == [0, 1, 5] and lengths.tolist() == [1, 1, 3]
    assert [x.tolist() for x in importance.run_lengths(np.empty(0, np.uint16))] == [[], []]


def test_small_streams_and_many_ranges(spark, docs, monkeypatch):
    """Documents that end streams, streams of one document, and more ranges than rows in some."""
    monkeypatch.setattr(importance, "STREAM_FEATURES", 50)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = importance.resample(docs.repartition(7), docs.limit(0).select("text"), percent=70)
    assert rows_of(got) == plain(rows, [], percent=70)
