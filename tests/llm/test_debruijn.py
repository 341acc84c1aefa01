"""Substring dedup against plain Python: random, periodic, nested and odd texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import debruijn

from .conftest import ROWS


def plain(rows, k):
    least, out = {}, []
    key = lambda i: (i is None, 0 if i is None else i)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            least[g] = min(least.get(g, key(i)), key(i))
    for i, w in split:
        gone = set()
        for p in range(len(w) - k + 1):
            if least[tuple(w[p : p + k])] < key(i):
                gone |= set(range(p, p + k))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def rows_of(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("k, gram, letters", [(4, 2, "ab"), (5, 3, "abc"), (6, 6, "ab"), (8, 1, "abcdefgh"), (1, 1, "abcdefghijkl"), (7, 4, "a")])
def test_random_texts(spark, k, gram, letters):
    rng = random.Random(k * 10 + gram)
    shared = [[rng.choice(letters) for _ in range(rng.randint(k, 4 * k))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(shared) if rng.random() < 0.5 else [rng.choice(letters) + rng.choice(["", "é", str(rng.randint(0, 40))]) for _ in range(rng.randint(0, 2 * k))]
        rows.append((rng.choice([i, i, i // 3, None]), rng.choice([" ", "  ", "\n", "\t\x0b"]).join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(debruijn.without_repeats(df, k, gram)) == plain(rows, k)


def test_passages_of_natural_length(spark):
    """Passages of 49, 50, 51 and 300 words within different texts, near copies, copies by the hundred, a periodic text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    fresh = lambda n: [word() for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 300)]
    rows = [(k, " ".join(fresh(rng.randint(0, 90)) + passages[k % 4] + fresh(rng.randint(0, 90)))) for k in range(80)]
    long = fresh(400)
    rows += [(100 + k, " ".join(long)) for k in range(200)]
    for k in range(40):
        edited = list(long)
        edited[rng.randrange(400)] = "edited"
        rows.append((400 + k, " ".join(edited)))
    rows += [(500, "a b c " * 500), (501, "b c a " * 400), (90, "c " + "a b c " * 60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got, want = rows_of(debruijn.without_repeats(df)), plain(rows, 50)
    assert got == want and sum(r[2] > 0 for r in want) > 200


def test_odd_rows(odd, empty, docs):
    for k in (3, 50):
        assert rows_of(debruijn.without_repeats(odd, k, 3)) == plain([(r[0], r[1]) for r in ROWS], k)
    assert debruijn.without_repeats(empty).collect() == []
    short = debruijn.without_repeats(docs, with_text=False)
    assert short.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_exploded_files(docs):
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    assert rows_of(debruijn.without_repeats(lines, 6, 3)) == plain([(r.doc_id, r.text) for r in lines.collect()], 6)


def test_hashes_and_pieces():
    x = np.arange(100, dtype=np.uint64) % 7
    for n in (1, 2, 3, 5, 16, 50, 99, 100, 101):
        h = debruijn.run_hashes(x, n)
        assert len(h) == max(len(x) - n + 1, 0) and len(set(h.tolist())) == min(7, len(h))
        assert debruijn.run_least(x, n).tolist() == [min(x[i : i + n]) for i in range(len(x) - n + 1)]
    doc, start, windows, _ = debruijn.pieces_of(debruijn.scrambled(np.arange(500, dtype=np.uint64)), np.array([0, 10, 10, 300, 500]), 20, 5)
    covered = [(d, s + j) for d, s, n in zip(doc, start, windows) for j in range(n)]
    assert covered == [(2, p) for p in range(10, 281)] + [(3, p) for p in range(300, 481)]
    _, _, periodic, _ = debruijn.pieces_of(np.zeros(1000, np.uint64), np.array([0, 1000]), 20, 5)
    assert periodic.max() == debruijn.MOST_WINDOWS and periodic.sum() == 981
