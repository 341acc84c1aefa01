"""Brute force and odd cases for each numbered operator."""

import hashlib
import heapq
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import common, decontaminate, exact_dedup, licenses, mixing, quality, queries, secrets, simhash, token_counts, url_rules, warc

from .conftest import ROWS, SMALL


def ids(rows, c="doc_id"):
    return Counter(r[c] for r in rows)


# 1


def test_quality_learns_grades(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta".split())
    rows = []
    for k in range(600):
        text = [word() for _ in range(rng.randint(20, 60))]
        grade = k % 3
        if grade == 1:
            text[rng.randrange(len(text))] = "vile"
        if grade == 0:
            text = [w + "%%%" for w in text]
        rows.append((k, " ".join(text), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    got = quality.quality_report(df.select("doc_id", "text"), df.where("doc_id % 2 = 0").select("doc_id", "grade")).collect()
    held = [(r.kept, rows[r.doc_id][2] == 2) for r in got if r.doc_id % 2]
    assert sum(a == b for a, b in held) > 0.95 * len(held)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_top <= 1 for r in got)
    kept = quality.select_quality(df.select("doc_id", "text"), df.where("doc_id % 2 = 0").select("doc_id", "grade"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_quality_thresholds_are_ordered_and_odd_rows_pass(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert ids(quality.quality_report(odd, none).collect()) == Counter(r[0] for r in ROWS)
    assert quality.quality_report(empty, none).collect() == []
    flat = np.concatenate([np.array([k % 7, 8 + k % 3]) for k in range(50)])
    m = quality.fit_ordinal(flat, np.full(50, 2), np.arange(50) % 4, 4)
    assert (np.diff(m.thresholds) > 0).all()
    tied = quality.fit_ordinal(np.zeros(40, int), np.ones(40, int), np.arange(40) % 2, 3)  # equal rows of either grade
    assert np.isfinite(tied.weights).all() and abs(tied.weights[0]) < 1
    bare = quality.fit_ordinal(np.array([3, 3, 3]), np.array([1, 0, 1, 0, 1]), np.array([1, 0, 1, 0, 1]), 2, screen=None)  # rows without features
    assert bare.weights[3] > 0 > bare.thresholds[0] - bare.weights[3] and (bare.weights[:3] == 0).all()
    some = spark.createDataFrame([(1, 2), (4, 0), (9, 2), (8, 1), (None, 1), (6, 7), (7, None)], "doc_id long, grade int")
    assert quality.select_quality(odd, some, least=0.0).columns == odd.columns


def ordinal_rows(rng, n=300, kinds=12):
    rows = [np.unique(rng.integers(0, kinds, rng.integers(1, 6))) for _ in range(n)]
    truth = rng.normal(0, 1.5, kinds)
    score = np.array([truth[r].sum() for r in rows]) + rng.logistic(0, 1, n)
    return np.concatenate(rows), np.array([len(r) for r in rows]), np.digitize(score, [-1.0, 1.0])


def likelihood_by_hand(w, t, flat, sizes, grades):
    """Row by row, from the definition: P(grade <= k) is the logistic of threshold k less the score."""
    total, at = 0.0, 0
    for n, y in zip(sizes, grades):
        score, at = sum(w[f] for f in flat[at : at + n]), at + n
        below = [0.0] + [1 / (1 + np.exp(-(x - score))) for x in t] + [1.0]
        total += np.log(below[y + 1] - below[y])
    return total / len(sizes)


def test_ordinal_likelihood_and_gradients_by_hand():
    rng = np.random.default_rng(11)
    flat, sizes, grades = ordinal_rows(rng)
    m = quality.OrdinalModel(rng.normal(0, 0.5, 12), np.array([-0.7, 0.9]))
    by_hand = lambda w, t: likelihood_by_hand(w, t, flat, sizes, grades)
    assert abs(quality.log_likelihood(m, flat, sizes, grades) - by_hand(m.weights, m.thresholds)) < 1e-9
    g, gt = quality.gradients(m, flat, sizes, grades)
    for k in range(12):
        step = np.eye(12)[k] * 1e-5
        assert abs(g[k] + (by_hand(m.weights + step, m.thresholds) - by_hand(m.weights - step, m.thresholds)) / 2e-5) < 1e-6
    for k in range(2):
        step = np.eye(2)[k] * 1e-5
        assert abs(gt[k] + (by_hand(m.weights, m.thresholds + step) - by_hand(m.weights, m.thresholds - step)) / 2e-5) < 1e-6


def test_ordinal_fit_is_the_best_there_is():
    """Against plain gradient descent on the same likelihood, without screen or penalty."""
    flat, sizes, grades = ordinal_rows(np.random.default_rng(12), 600)
    m = quality.fit_ordinal(flat, sizes, grades, 3, l1=0.0, screen=None)
    best = quality.OrdinalModel(np.zeros(12), np.array([-1.0, 1.0]))
    for _ in range(4000):
        g, gt = quality.gradients(best, flat, sizes, grades)
        best.weights, best.thresholds = best.weights - 0.5 * g, best.thresholds - 0.5 * gt
    got, want = (quality.log_likelihood(x, flat, sizes, grades) for x in (m, best))
    assert got > want - 0.01 and np.abs(m.weights[:12] - best.weights).max() < 0.35


def test_quality_held_out(spark):
    """Fitted on the labels of half the ids of sf0.1, judged on the other half, which nothing here has seen."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    grades = quality.grades_of(spark.read.parquet("/root/testdata/sf0.1/labels.parquet")).where("grade is not null")
    half = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(2))
    judged = docs.join(grades.where(half == 1), "doc_id", "left_semi")
    got = quality.quality_report(docs, grades.where(half == 0)).join(judged.select("doc_id"), "doc_id", "left_semi").join(grades, "doc_id")
    share = {r.grade: r.s for r in got.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    print("held out, share kept by grade", share)
    assert share[2] > 0.97 and share[1] < 0.4 and share[0] < 0.1  # with 2,000 labels to learn from; README has more


# 2


def dedup_by_hand(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    out = []
    for d, t, *_ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1)])
def test_exact_dedup(odd, docs, empty, digest):
    assert exact_dedup.exact_groups(empty, digest=digest).collect() == []
    for df in (odd, docs):
        got = exact_dedup.exact_groups(df, digest=digest, lo=64, hi=512).drop("n_chunks").collect()
        assert Counter(map(tuple, got)) == dedup_by_hand([(r.doc_id, r.text) for r in df.collect()])


def test_chunks_are_the_text(odd, docs):
    for df in (odd, docs):
        rows = df.select("text", exact_dedup.chunks(F.col("text")).alias("c")).where("text is not null").collect()
        assert all("".join(r.c) == r.text and all(len(c) <= 4096 for c in r.c) for r in rows)


def test_texts_without_sentence_ends_are_cut_by_their_content(spark):
    """An insertion near the front changes the chunks around it and leaves those behind it alone."""
    rng = random.Random(9)
    body = "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(30_000))
    rows = [("b", body), ("i", body[:700] + "新" + body[700:]), ("s", body.replace(body[500], "。"))]
    got = {r.k: r.c for r in spark.createDataFrame(rows, "k string, t string").select("k", exact_dedup.chunks(F.col("t")).alias("c")).collect()}
    assert all("".join(got[k]) == t for k, t in rows)
    assert len(set(got["b"]) & set(got["i"])) >= len(got["b"]) - 2 and len(got["b"]) > 8


# 3


def near_by_hand(rows, width=4, radius=4):
    fp = [simhash.fingerprint((t or "").encode().lower().split(), width) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        old = list(label)
        for i in range(len(rows)):
            for j in range(i):
                if (fp[i] ^ fp[j]).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
        if old == label:
            break
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[label[i]] = min(least.get(label[i], r[0]), r[0])
    return Counter((r[0], f"{fp[i]:016x}", least.get(label[i])) for i, r in enumerate(rows))


def test_fingerprint_against_spark_hash(spark, docs):
    """Spark's xxhash64 is XXH64 with seed 42."""
    r = docs.where("lang = 'de'").limit(1).first()
    words = r.text.encode().lower().split()
    grams = [b" ".join(words[i : i + 4]).decode() for i in range(len(words) - 3)]
    h = [x.h % (1 << 64) for x in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g").alias("h")).collect()]
    bits = sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))
    assert bits == simhash.fingerprint(words, 4)


def test_near_groups(odd, docs, empty):
    assert simhash.near_groups(empty).collect() == []
    for df in (odd, docs):
        got = simhash.near_groups(df, tile=16).collect()
        assert Counter(map(tuple, got)) == near_by_hand([(r.doc_id, r.text) for r in df.collect()])


def test_tiles_link_what_is_near():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 63, 40, dtype=np.uint64)) for _ in range(6)])
    rows = np.stack((x.view(np.int64), np.zeros(len(x), np.int64), np.arange(len(x))), axis=1)
    for step in (1 << 21, 64):
        e = simhash.tile_links(rows, rows, 2, step=step)
        label = np.arange(len(x))
        for u, v in e:
            label[u] = v
        want = np.bitwise_count(x[:, None] ^ x[None]) <= 2
        assert all(label[i] == label[j] for i, j in zip(*np.nonzero(want)))


def test_wide_sketches_find_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    copy = list(words)
    copy[50] = copy[300] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(f"w{rng.randrange(5000)}" for _ in range(400)))]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=5, words=4, radius=16, total=50, ratio=0.8).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def families_by_hand(rows, width=5, least=0.8):
    grams = {i: {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if (w := t.lower().split()) else set() for i, t in rows}
    label, sizes = {i: i for i in grams}, sorted(grams)
    root = lambda i: i if label[i] == i else root(label[i])
    for k, i in enumerate(sizes):
        for j in sizes[k + 1 :]:
            if grams[i] == grams[j] or len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= least:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i in grams}


def around(rng, n_pairs=120):
    """Pairs with similarities around 0.8, repeats of a passage, short texts and a null-like text."""
    rows = []
    for k in range(n_pairs):
        n = rng.choice([8, 9, 40, 150, 400])
        words = [f"p{k}w{rng.randrange(10**6)}" for _ in range(n)]
        cut = max(1, round(n * rng.uniform(0.05, 0.16)))
        other = words[:-cut] + [f"p{k}x{i}" for i in range(cut)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    base = [f"r{i}" for i in range(60)]
    rows += [(1000, " ".join(base)), (1001, " ".join(base * 5)), (1002, ""), (1003, "  ")]
    return rows


def test_near_copies_are_decided_by_exact_similarity(spark):
    import corpus_pipeline

    rows = around(random.Random(5))
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), **corpus_pipeline.NEAR).collect()
    want = families_by_hand(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert 20 < sum(want[2 * k + 1] == 2 * k for k in range(120)) < 100 and want[1001] == 1000


def test_verified_tiles_link_every_similar_pair(spark):
    rng, base = random.Random(6), [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 5])):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = simhash.fingerprints(df, width=5, words=4, distinct=True)
    keys = fps.withColumnRenamed("doc_id", "least_id")
    roots = keys.select("node", F.lit(0).cast("long").alias("root"))
    for tile in (256, 1 << 18):
        e = simhash.verified(df, keys, roots, "doc_id", "text", 5, 4, 256, 0.8, tile).collect()
        name = {r.node: r.least_id for r in keys.collect()}
        label = {i: i for i, _ in rows}
        root = lambda i: i if label[i] == i else root(label[i])
        for u, v in e:
            x, y = sorted((root(name[u]), root(name[v])))
            label[y] = x
        assert {i: root(i) for i in label} == families_by_hand(rows)


# 4


def url_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.lower() if host.isascii() else host, re.match(r"[^?#]*", rest[len(host) :])[0]


def tokens_by_hand(u):
    host, path = url_parts(u)
    labels = [x for x in reversed(host.split(".")) if x]
    out = {f"h{i + 1}:{x}" for i, x in enumerate(labels)} | {f"w:{w}" for x in labels if re.search("[^a-z]", x) for w in re.findall("[a-z]{2,}", x)}
    *dirs, file = path.split("/")
    out |= {f"p{i + 1}:{x}" for i, x in enumerate([x for x in dirs if x])}
    ext = re.search(r"\.([A-Za-z0-9]+)$", file)
    out |= {f"x:{ext[1]}"} if ext else set()
    out |= {f"f:{w}" for w in re.findall(r"[^\W_]+", file[: ext.start()] if ext else file)}
    query = re.search(r"\?([^#]*)", u or "")
    return out | ({f"q:{k}" for k in re.findall(r"(?:^|&)([^=&]+)", query[1])} if query else set())


def verdicts_by_hand(rows, labels, support, confidence=0.9):
    """Every combination of frequent tokens is counted, and every URL is held against every rule."""
    import itertools

    said, out, baskets = defaultdict(set), Counter(), []
    for r in labels:
        said[r.page_id].add(r.label)
    given = {}
    for r in rows:
        host, path = url_parts(r.url)
        fits = [g for g in url_rules.GIVEN if (host == g.host or host.endswith("." + g.host)) and path.startswith("/" + g.path)]
        given[r.page_id, r.url] = best = max(fits, key=lambda g: len(g.name), default=None)
        baskets += [(tokens_by_hand(r.url), x) for x in ([best.verdict] if best else said[r.page_id] if r.page_id is not None else [])]
    n, counts = len(baskets), Counter(t for b, _ in baskets for t in b)
    frequent = {t for t, k in counts.items() if k >= support * n}
    sets = Counter(c for b, _ in baskets for k in range(1, len(frequent & b) + 1) for c in itertools.combinations(sorted(frequent & b), k))
    both = Counter((c, y) for b, y in baskets for k in range(1, len(frequent & b) + 1) for c in itertools.combinations(sorted(frequent & b), k))
    rules = [(k / sets[c], k / n, list(c), y) for (c, y), k in both.items() if k >= support * n - 1e-9 and k / sets[c] >= confidence]
    assert rules
    for r in rows:
        best, held = given[r.page_id, r.url], tokens_by_hand(r.url)
        mined = max((x for x in rules if held >= set(x[2])), default=None) if best is None else None
        out[(r.page_id, *url_parts(r.url), best and best.name, best.verdict if best else mined[3] if mined else "allow", mined and " ".join(mined[2]))] += 1
    return out


def test_url_rules(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    more = [(1000, None), (1001, "no scheme"), (1002, "HTTP://COM/en/1"), (1003, "http://notcom/en/1"), (1004, "x://a.COM/en/"), (1005, "http://example.com/en/7?q"), (1006, "://"), (1006, "://"), (1007, "http://a.org?es/#x")]
    pages = pages.union(spark.createDataFrame(more, "page_id long, url string"))
    rows = pages.collect()
    for labels in (None, spark.createDataFrame([(1001, "block"), (1001, "allow"), (1002, "allow"), (5, "block"), (None, "block")], "page_id long, label string")):
        got = url_rules.url_verdicts(pages, labels, support=0.02).collect()
        assert Counter(map(tuple, got)) == verdicts_by_hand(rows, labels.collect() if labels else [], 0.02)
        assert any(g.mined for g in got)
    assert url_rules.url_verdicts(pages.limit(0)).collect() == []


def test_url_rules_on_odd_tables(spark, odd):
    """Clashing columns, no URL at all, very long hosts, paths and queries, ties and repeated rows."""
    assert ids(url_rules.url_verdicts(odd, id_col="doc_id", url_col="text").collect()) == Counter(r[0] for r in ROWS)
    long = [(k, f"http://{'.'.join(f'l{i}' for i in range(3000))}.com/{'en/' * 3000}?{'k=1&' * 3000}") for k in (1, 1, 2)] + [(3, "http://a.com/en/" + "x" * 100_000)]
    pages = spark.createDataFrame(long, "page_id long, url string").withColumns({c: F.lit("1") for c in ("id", "host", "path", "given", "tokens", "label", "known")})
    got = url_rules.url_verdicts(pages, support=0.9).collect()
    assert [r.verdict for r in got] == ["block"] * 4 and {r.rule for r in got} == {"com/en/"}


def test_mined_rules_hold_and_match(spark):
    rows = [([f"t{k % 5}", "common", f"u{k % 7}"], "block" if k % 5 == 1 else "allow") for k in range(350)]
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = url_rules.mine_rules(df, 0.02, 0.9)
    found = {(tuple(r.tokens), r.label) for r in rules.collect()}
    assert (("t1",), "block") in found and all(r.confidence >= 0.9 for r in rules.collect())
    got = {tuple(r.tokens): r.label for r in url_rules.match_rules(df.select("tokens").distinct(), rules).collect()}
    assert all(got[tuple(t)] == label for t, label in rows)


# 5


def test_trigrams_are_mandatory():
    assert secrets.trigram_query("[0-9a-f]{16,}") == secrets.ANY
    assert secrets.trigram_query("AKIA[A-Z]+") == frozenset([frozenset(["aki", "kia"])])
    samples = ["Password: xx", "API_KEY = abcdef", "apikey=1", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "AKIA" + "B" * 14, "xoxb-1234567890ab"]
    for s in samples:
        for r in secrets.RULES:
            if re.search(r.pattern, s):
                assert any(all(t in s.lower() for t in c) for c in secrets.trigram_query(r.pattern)), (r.kind, s)


def test_secret_scan(odd, docs, empty):
    assert secrets.secret_report(empty).collect() == []
    for df in (odd, docs):
        got = secrets.secret_report(df).collect()
        want = []
        for r in df.collect():
            found = sorted((m.start(), k, m.end()) for k, x in enumerate(secrets.RULES) for m in re.finditer(x.pattern, r.text or "") if len(m.group(x.group)) >= x.least)
            line = lambda f: ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in f)
            n = [sum(k == i for _, k, _ in found) for i in range(3)]
            want.append((r.doc_id, *n, hashlib.sha256(line([f for f in found if f[1] < 3]).encode()).hexdigest(), line(found)))
        assert Counter(map(tuple, got)) == Counter(want)


# 6


def test_automaton():
    a = licenses.TokenAutomaton("licensed under <<opt>>the<</opt>> x <<var 1-2>> end")
    w = lambda s: s.encode().split()
    assert a.accept(w("licensed under the x y end"), 0) == 6
    assert a.accept(w("licensed under x y z end"), 0) == 6
    assert a.accept(w("licensed under x end"), 0) == -1
    assert a.accept(w("licensed under a x y end"), 0) == -1


def test_nested_and_wrong_markup():
    a = licenses.TokenAutomaton("a <<opt>>b <<opt>>c<</opt>> <<var 0-1>> d<</opt>> e")
    w = lambda s: s.encode().split()
    assert [a.accept(w(x), 0) for x in ("a e", "a b d e", "a b c d e", "a b x d e", "a b c x d e", "a c e", "a b c x y d e", "a b e")] == [2, 4, 5, 5, 6, -1, -1, -1]
    for bad in ("<<opt>>a<</opt>>", "<<var 1-2>> a", "a <<opt>> b"):
        with pytest.raises(ValueError):
            licenses.TokenAutomaton(bad)


#: A text, and what each template says of it, by label.
LICENSED = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software!", "mit", 1.0),
    ("x Copyright (c) 2020 A B. All rights reserved y", "copyright,reserved", 8 / 10),
    ("Copyright all rights reserved", "reserved", 3 / 4),
    ("SPDX-License-Identifier: MIT", "spdx", 1.0),
    ("GNU Lesser General Public License", "gpl,lgpl", 1.0),
    ("the General Public License, version 2 of the License, or (at your option) any later version", "gpl,gpl-2.0", 15 / 16),
    ("THE SOFTWARE IS PROVIDED 'AS IS', WITHOUT WARRANTY OF ANY KIND", "warranty", 1.0),
    ("licensed under the Apache License 2.1", "", 0.0),
    ("Licensed under Creative Commons CC BY-NC 4.0 license", "cc-by,cc-by-nc-4.0", 1.0),
)


def test_license_labels_by_case(spark):
    got = licenses.license_scan(spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(LICENSED)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, round(r.score, 9)) for r in got} == {k: (labels, round(score, 9)) for k, (_, labels, score) in enumerate(LICENSED)}


MIT = """Copyright (c) 2021 Ann Example

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
{holders} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def test_whole_licenses(spark):
    """Every template against a text made of it, with and without what is optional, and with one mandatory word changed."""
    texts = [(0, MIT.format(holders="AUTHORS OR COPYRIGHT HOLDERS")), (1, MIT.format(holders="X").replace("(the \"Software\")", "")), (2, MIT.format(holders="X").replace("merge", "join"))]
    want = {0: True, 1: True, 2: False}
    for k, t in enumerate(licenses.WHOLE):
        bare = re.sub(r"<<var (\d+)-(\d+)>>", lambda m: "any " * int(m[2]), t.markup)
        full = re.sub(r"<<.*?>>", " ", bare)
        least = bare
        while "<<opt>>" in least:
            least = re.sub(r"<<opt>>((?!<<opt>>).)*?<</opt>>", " ", least)
        words = full.split()
        wrong = " ".join([*words[:40], "else", *words[41:]])
        for n, (text, found) in enumerate(((full, True), (f"before. {least.upper()}!", True), (wrong, False))):
            texts.append((10 * (k + 1) + n, text))
            want[10 * (k + 1) + n] = found
    label = lambda i: "mit-text" if i < 3 else licenses.WHOLE[i // 10 - 1].label
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: label(i) in r.labels.split(",") for i, r in got.items()} == want
    assert got[0].score > 0.95 and got[10].score == 1.0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SMALL)
    r = c.execute(queries.ORACLES[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(r.fetchall())


def test_license_scan(odd, docs, empty):
    assert licenses.license_scan(empty).collect() == []
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    for df in (odd, docs):
        rows = df.collect()
        got = licenses.license_scan(df).collect()
        want = []
        for r in rows:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            places = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
            at = [i for i, _ in places]
            want.append((r.doc_id, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places}))))
        assert Counter((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got) == Counter(want)
        assert all(0 <= g.score <= 1 and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) for g in got)
    assert [g.labels for g in licenses.license_scan(odd).collect() if g.doc_id == 9] == ["apache-2.0,reserved"]


# 7


def test_loser_tree():
    rng = random.Random(5)
    for k in range(12):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 8))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))


def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    more = [(900, None, None), (901, "http://A.example.com", "x" * 200), (902, "http://A.example.com/?q#f", "x" * 200), (None, "a", "x" * 200), (903, "http://b.c/\n", "y" * 99), (904, "http://b.c/", "y" * 99), (901, "http://A.example.com", "x" * 200)]
    pages = pages.union(spark.createDataFrame(more, pages.schema)).repartition(3)
    got = warc.capture_index(pages, folder=f"file://{tmp_path}/w").collect()
    rows = pages.collect()
    payload = {r.page_id: (r.html or "").encode() for r in rows}
    assert ids(got, "page_id") == ids(rows, "page_id")
    for g in got:
        p = payload[g.page_id]
        assert (g.payload_bytes, g.payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
        first = min((k for k, v in payload.items() if v == p and k is not None), default=None) if len(p) >= 100 else g.page_id
        assert (g.record_type, g.refers_to) == (("response", None) if first == g.page_id else ("revisit", first))
    order = [(g.url_key or "", g.captured_at) for g in got]
    assert order == sorted(order)
    assert warc.capture_index(pages.limit(0), folder=f"file://{tmp_path}/e").collect() == []


def test_warc_odd_values(spark, odd, tmp_path):
    """Ids and URLs with line ends, clashing columns, very long values, repeated rows; short runs and ranges."""
    long = "y" * 300_000
    rows = [("a\r\nX-Page-Id: b", "http://h/1\r\nWARC-Type: response", "p" * 150), ("b%0A", "http://h/%41?" + long, long), ("c", None, None), ("c", None, None), (None, "http://H/1", "p" * 150), ("d\n", "http://h/1\r\n", "p" * 150)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    for c in ("id", "digest", "n", "payload", "date", "run", "seq"):
        pages = pages.withColumn(c, F.lit("1"))
    got = warc.capture_index(pages, folder=f"file://{tmp_path}/o", max_records=2, range_records=2).collect()
    want = []
    for p, u, h in rows:
        key = u and u.split("://", 1)[1].split("#")[0]
        end = min((key.find(c) for c in "/?" if c in key), default=len(key)) if key else 0
        want.append((p, u and ",".join(reversed(key[:end].lower().split("."))) + ")" + key[end:], len(h or ""), "revisit" if h == "p" * 150 and p != rows[0][0] else "response", rows[0][0] if h == "p" * 150 and p != rows[0][0] else None))
    assert Counter((r.page_id, r.url_key, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter(want)
    order = [(r.url_key or "", r.captured_at, r.page_id or "") for r in got]
    assert order == sorted(order) and len({r.archive for r in got}) > 1
    table = odd.select("doc_id", "text", "id", "digest")
    got = warc.capture_index(table, id_col="doc_id", url_col="text", payload_col="text", folder=f"file://{tmp_path}/odd").collect()
    assert ids(got) == Counter(r[0] for r in ROWS)


def test_a_range_has_a_bounded_number_of_lines(spark, tmp_path):
    """One URL and one time for all rows: its lines are still dealt out."""
    pages = spark.range(4000).select(F.lit(None).cast("long").alias("page_id"), F.lit("http://one/").alias("url"), F.lit("x").alias("html"))
    got = warc.capture_index(pages, folder=f"file://{tmp_path}/b", max_records=300, range_records=500)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 1000
    archives = got.groupBy("archive").count().collect()
    assert max(r["count"] for r in archives) <= 300


# 8


def test_contamination(spark, odd, docs, empty):
    items = [(1, "quick brown fox jumps over the lazy dog and runs far"), (2, "lazy dog"), (3, None), (4, "à zürich all"), (4, "lazy"), (None, "rights"), (5, "dolor sit amet lorem ipsum dolor sit amet lorem ipsum dolor")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination_report(empty, bench).collect() == []
    big = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    for df, b in ((odd, bench), (docs, big), (odd, bench.limit(0))):
        texts = dict(enumerate((r.text for r in df.collect())))
        want = Counter()
        by_item = defaultdict(list)
        for r in b.collect():
            by_item["" if r.item_id is None else str(r.item_id)].append(r.text)
        for k, t in texts.items():
            words, hit, names = decontaminate.words_of((t or "").encode()), set(), set()
            for name, many in by_item.items():
                for text in many:
                    for w in decontaminate.windows_of([("", decontaminate.words_of((text or "").encode()))], 10):
                        at = [i for i in range(len(words) - len(w) + 1) if words[i] == w[0] and tuple(words[i : i + len(w)]) == w]
                        hit.update(x for i in at for x in range(i, i + len(w)))
                        names |= {name} if at else set()
            want[(len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))] += 1
        whole = None
        for options in ({}, {"block_windows": 3}) if df is odd else ({}, {"block_windows": 400}):
            found = decontaminate.contamination(df, b, **options).collect()
            got = decontaminate.contamination_report(df, b, **options).collect()
            assert Counter((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
            assert ids(got) == ids(df.collect())
            plain = Counter(map(repr, found))
            assert whole in (None, plain)  # hits, items and near are those of one block
            whole = plain


def test_blocks_keep_rows_of_one_id_apart(spark):
    passage, other = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    clean = " ".join(f"c{i}" for i in range(12))
    rows = [(1, passage), (1, clean), (None, other), (None, clean), (2, other), (2, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage), (2, other), (3, "d " * 12)], "item_id long, text string")
    want = Counter([(1, True), (1, False), (None, True), (None, False), (2, True), (2, True)])
    for block_windows in (200_000, 4, 1):
        got = decontaminate.contamination_report(df, items, block_windows=block_windows).collect()
        assert Counter((r.doc_id, r.contaminated) for r in got) == want


def test_a_block_is_small_on_the_driver(spark):
    """What the driver holds grows with the windows of a block, not with the benchmark."""
    rng = random.Random(8)
    bench = spark.createDataFrame([(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(500))) for k in range(40)], "item_id long, text string")
    text = [r.text for r in bench.collect()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(text)] + [(100, "clean words only")], "doc_id long, text string")
    sizes = []
    old = decontaminate.asked_block

    def spy(*args):
        out = old(*args)
        sizes.append((len(out.words), sum(x.nbytes for x in (out.words, out.order, out.sizes, out.cut, out.items))))
        return out

    decontaminate.asked_block = spy
    try:
        got = decontaminate.contamination_report(df, bench, block_windows=2000).collect()
    finally:
        decontaminate.asked_block = old
    assert len(sizes) > 5 and sum(n for n, _ in sizes) == 40 * 491 and all(n < 2600 and b < 100 * n + 16 for n, b in sizes)
    assert {r.doc_id for r in got if r.contaminated} == set(range(40)) and all(r.n_hit == r.n_words for r in got if r.contaminated)


# 9


def reshared(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    t, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total, add, left = sum(w[s] for s in free), left, 0.0
        for s in list(free):
            t[s] += add * w[s] / total
        for s in list(free):
            if t[s] > 2 * sizes[s]:
                left += t[s] - 2 * sizes[s]
                t[s] = 2.0 * sizes[s]
                free.discard(s)
    return t


def test_mix(odd, docs, empty):
    assert mixing.mix(empty).collect() == []
    for df in (odd, docs):
        got = mixing.mix(df, block_words=32, shard_words=5000).collect()
        assert ids(got) == ids(df.collect())
        sizes, taken = Counter(), Counter()
        for r in got:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            assert r.taken <= 2 * r.size and r.taken == sum(x.n for x in r.draws)
        want = reshared(sizes)
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        draws = Counter((r.source, x.rank) for r in got for x in r.draws)
        shards = Counter()
        for r in got:
            for s, k in {(x.shard, x.rank) for x in r.draws}:
                shards[(s, r.source, k)] = 1
        per_shard = Counter(s for s, *_ in shards)
        assert len(shards) == len(draws) and max(per_shard.values()) - min(per_shard.values()) <= 1
        again = mixing.mix(df.repartition(7), block_words=32, shard_words=5000).collect()
        assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_blocks_are_permuted():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 16, 17, 1000):
        for key in rng.integers(0, 1 << 62, 5):
            p = mixing.permuted(np.arange(n), n, key)
            assert sorted(p.tolist()) == list(range(n))
            if n == 1000:  # neighbours are at no constant stride, and land all over
                steps = Counter(np.diff(p).tolist())
                assert max(steps.values()) < 12 and abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.15


def test_mix_sizes_and_targets_in_sql(spark, docs, odd, tmp_path):
    """size, source_size and target by DuckDB: the water level is raised step by step."""
    import duckdb

    for k, df in enumerate((docs, odd)):
        path = str(tmp_path / f"m{k}")
        df.select("doc_id", "text", "source").write.parquet(path)
        sql = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM '{path}/*.parquet'),
          s AS (SELECT source, sum(size) AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM d GROUP BY 1),
          fill AS (SELECT 0 AS round, (SELECT 1.5 * sum(n) / sum(w) FROM s)::DOUBLE AS level
            UNION ALL SELECT round + 1, ((SELECT 1.5 * sum(n) FROM s) - (SELECT coalesce(sum(2 * n), 0) FROM s WHERE level * w > 2 * n)) / (SELECT sum(w) FROM s WHERE level * w <= 2 * n) FROM fill
            WHERE round < 40 AND EXISTS (SELECT 1 FROM s WHERE level * w <= 2 * n)),
          top AS (SELECT arg_max(level, round) AS level FROM fill WHERE level IS NOT NULL)
          SELECT doc_id, size, CAST(n AS BIGINT), least(2 * n, level * w)::DOUBLE FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, top"""
        want = duckdb.sql(sql).fetchall()
        got = mixing.mix(df).select("doc_id", "size", "source_size", "target").collect()
        near = lambda rows: Counter((*r[:3], round(r[3], 5)) for r in rows)
        assert near(got) == near(want)


def test_splitting_tree():
    q = mixing.shard_quotas([100, 7, 0, 33], 9, 1)
    assert q.sum(axis=0).tolist() == [100, 7, 0, 33] and q.sum(axis=1).max() - q.sum(axis=1).min() <= 1
    assert (q == mixing.shard_quotas([100, 7, 0, 33], 9, 1)).all()


def test_shards_hold_their_quotas(docs):
    m = mixing.mix(docs, block_words=16, shard_words=3000).cache()
    rows = m.where("taken > 0").collect()
    drawn = [(d.shard, r.source, d.rank, r.doc_id, d.start, d.n) for r in rows for d in r.draws]
    shard_of = {}
    for shard, source, rank, *_ in drawn:
        assert shard_of.setdefault((source, rank), shard) == shard  # a block is one shard's
    sources = sorted({s for s, _ in shard_of})
    shards = max(shard_of.values()) + 1
    counts = [sum(s == x for s, _ in shard_of) for x in sources]
    assert all(sorted(r for s, r in shard_of if s == x) == list(range(c)) for x, c in zip(sources, counts))
    held = np.array([[sum(v == k and s == x for (s, _), v in shard_of.items()) for x in sources] for k in range(shards)])
    assert shards > 3 and (held == mixing.shard_quotas(counts, shards, 7)).all()
    size = {r.doc_id: r.size for r in rows}
    assert all(0 <= start and start + n <= size[d] for *_, d, start, n in drawn)
    by_block = Counter((x, rank, d, w) for _, x, rank, d, start, n in drawn for w in range(start, start + n))
    assert max(by_block.values()) == 1 and sum(by_block.values()) == sum(r.taken for r in rows)  # disjoint
    out = mixing.shuffled_shards(m).collect()
    assert Counter((r.shard, r.source, r.doc_id, r.start, r.n) for r in out) == Counter((s, x, d, a, n) for s, x, _, d, a, n in drawn)
    for k in range(shards):
        ids = [r.doc_id for r in out if r.shard == k]
        assert len(ids) < 5 or ids != sorted(ids)


# 10


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution(rule):
    rng = np.random.default_rng(4)
    for _ in range(50):
        lengths = rng.integers(1, 6, rng.integers(1, 30))
        ends = np.cumsum(lengths)
        cuts = np.sort(rng.integers(0, ends[-1] + 1, 6)).reshape(3, 2)
        got = token_counts.attribute(ends, cuts, rule)
        want = np.zeros(4)
        for a, b in zip(ends - lengths, ends):
            parts = [max(0, min(b, y) - max(a, x)) for x, y in cuts]
            out = (b - a) - sum(parts)
            if rule == "split":
                want += np.array([*parts, out]) / (b - a)
            elif rule == "majority":
                best = int(np.argmax(parts))
                want[best if parts[best] >= out and parts[best] else 3] += 1
            else:
                at = a if rule == "start" else b - 1
                want[next((k for k, (x, y) in enumerate(cuts) if x <= at < y), 3)] += 1
        assert np.allclose(got, want)


def test_token_counts(odd, docs, empty):
    assert token_counts.token_report(empty).collect() == []
    encoding, _ = token_counts.load(token_counts.default_vocabulary())
    for df in (odd, docs):
        got = token_counts.token_report(df).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(encoding.encode_ordinary(r.text or ""))) for r in df.collect())
        assert all(r.n_tokens == r.title_tokens + r.body_tokens + r.tail_tokens and r.outside == 0 for r in got)


def sections_by_hand(text):
    """(title end, tail start) in bytes: the first line with its break, and the last one if there are three or more."""
    lines = text.split("\n")
    if len(lines) == 1:
        return len(text.encode()), len(text.encode())
    title = len((lines[0] + "\n").encode())
    return title, max(title, len(text.encode()) - len(lines[-1].encode()))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_by_hand(spark, odd, docs, rule):
    """Every token of every document, one by one."""
    more = spark.createDataFrame([(50, "one line"), (51, "Zürich\nand\nmore été"), (52, "\n"), (53, "a\n"), (54, "\n\nx"), (55, "t\n" + "body words " * 50 + "\nlast\n")], "doc_id long, text string")
    encoding, lengths = token_counts.load(token_counts.default_vocabulary())
    for df in (odd.select("doc_id", "text"), docs.select("doc_id", "text"), more):
        want = []
        for r in df.collect():
            text, parts, n, crossing, at = r.text or "", [0.0, 0.0, 0.0], 0, 0, 0
            a, b = sections_by_hand(text)
            cuts = [(0, a), (a, b), (b, len(text.encode()))]
            for t in encoding.encode_ordinary(text):
                s, e = at, at + int(lengths[t])
                share = [max(0, min(e, y) - max(s, x)) for x, y in cuts]
                if rule == "split":
                    parts = [p + x / (e - s) for p, x in zip(parts, share)]
                else:
                    k = next(k for k, (x, y) in enumerate(cuts) if x <= (s if rule == "start" else e - 1) < y) if rule != "majority" else share.index(max(share))
                    parts[k] += 1
                crossing += sum(x > 0 for x in share) > 1
                n, at = n + 1, e
            want.append((r.doc_id, n, *(round(p, 6) for p in parts), 0.0, crossing))
        got = [(r.doc_id, r.n_tokens, round(r.title_tokens, 6), round(r.body_tokens, 6), round(r.tail_tokens, 6), round(r.outside, 6), r.n_crossing) for r in token_counts.token_report(df, rule=rule).collect()]
        assert Counter(got) == Counter(want)


def test_invalid_and_overlapping_sections(spark):
    """Empty, reversed and far sections have no tokens; an overlap is the earlier section's."""
    span = lambda name, a, b: F.struct(F.lit(name).alias("name"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"))
    some = lambda c: F.array(span("late", 8, 99), span("none", 3, 3), span("back", 6, 2), span("first", 0, 9), span("far", 500, 600))
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, ""), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.token_counts(df, some).collect()}
    tokens = {x["name"]: x["tokens"] for x in got[1].counts}
    assert sum(tokens.values()) + got[1].outside == got[1].n_tokens and tokens.get("none", 0) == tokens.get("back", 0) == tokens.get("far", 0) == 0
    assert tokens["first"] == 3 and got[2].n_tokens == got[3].n_tokens == 0
    assert {x["name"]: x["tokens"] for x in token_counts.token_counts(df.limit(1), lambda c: F.lit(None).cast("array<struct<name:string,start:bigint,end:bigint>>")).first().counts} == {}


# common


def test_ascii_lower(spark):
    assert spark.range(1).select(common.lower_ascii(F.lit("AÉZ")).alias("x")).first().x == "aÉz"


def test_queries_have_their_columns(spark):
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in queries.QUERIES) == 1
