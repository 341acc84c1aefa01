"""Small hand-made cases of each family of operators."""

import datetime
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import names as N
from loomgraph.functions import text as X
from loomgraph.functions import vectors as V
from loomgraph.operators import evals, graph, heat, layout, lint, resolve, search, vectors
from loomgraph.operators.components import components
from loomgraph.sources import readers
from loomgraph.streaming import feeds


@pytest.fixture(scope="module")
def path(spark):
    engrams = spark.createDataFrame([(k, f"concept {k}") for k in ("a", "b", "c", "lonely")], "id string, canonical_name string")
    rows = [("e1", "a", "b", "supports", 0.9), ("e2", "b", "c", "contradicts", 0.8), ("e3", "a", "b", "related_to", 0.7)]
    return engrams, spark.createDataFrame(rows, "id string, source string, target string, predicate string, confidence double")


def reach(spark, path, seed, hops, predicate=None):
    nodes, edges = graph.neighbourhood(spark.createDataFrame([(seed,)], "seed string"), *path, hops, predicate)
    return {r.node for r in nodes.collect()}, sorted(r.edge for r in edges.collect())


def test_neighbourhood(spark, path):
    assert reach(spark, path, "a", 1) == ({"a", "b"}, ["e1", "e3"])
    assert reach(spark, path, "a", 2) == ({"a", "b", "c"}, ["e1", "e2", "e3"])
    assert reach(spark, path, "a", 2, "supports") == ({"a", "b"}, ["e1"])
    assert reach(spark, path, "nowhere", 2) == (set(), [])
    assert reach(spark, path, "lonely", 2) == ({"lonely"}, [])


def test_page_rank_and_orphans(spark, path):
    ranks = {r.node: r.rank for r in graph.page_rank(path[1]).collect()}
    assert ranks["b"] == 1.0 and ranks["a"] > ranks["c"] and "lonely" not in ranks
    assert [r.engram_ids for r in lint.orphans(*path).collect()] == [["lonely"]]


def test_query_phrases():
    assert search.query_phrases('"hello" (world*)') == ["hello", "world"]
    assert search.query_phrases("cats AND dogs") == ["cats", "dogs"]
    assert search.query_phrases('""***') == []


def test_keyword_search(spark):
    rows = [(1, "The quick brown fox jumps"), (2, "A lazy dog sleeps"), (3, "The fox and the hound"), (4, "foo bar"), (5, "bar foo"), (6, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    index = search.text_index(docs, ("text",))
    hits = lambda q: {r.id for r in search.keyword_search(index, q).collect()}
    assert hits("fox") == {1, 3} and hits("FOX hound") == {3} and hits("foo-bar") == {4} and hits('"*') == set()


def test_fusion(spark):
    a = spark.createDataFrame([("a", 1.0), ("b", 0.8)], "id string, score double")
    b = spark.createDataFrame([("b", 0.9), ("c", 0.7)], "id string, score double")
    got = [(r.id, round(r.rrf, 9), r.match_type) for r in search.fuse({"keyword": a, "semantic": b}).collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 9), "hybrid"), ("a", round(1 / 61, 9), "keyword"), ("c", round(1 / 62, 9), "semantic")]


def keys(spark, name, index=False):
    return spark.range(1).select(N.alias_keys(F.lit(name), index).alias("k")).first().k


def test_alias_keys(spark):
    assert {"최지연 교수님 (professor choi ji-yeon)", "최지연 교수님", "최지연"} <= set(keys(spark, "최지연 교수님 (professor choi ji-yeon)"))
    assert keys(spark, "기술 수용성") == ["기술 수용성", "기술수용성"]
    assert "safety" not in keys(spark, "safety (clinical)")
    assert {"생명윤리및안전에관한법률", "생명윤리법", "bioethics and safety law"} <= set(keys(spark, "생명윤리및안전에관한법률 (bioethics and safety law)", True))


def test_merge_families(spark):
    vec = lambda *x: [float(v) for v in np.array(x + (0,) * (8 - len(x))) / np.linalg.norm(x)]
    at = lambda s: datetime.datetime(2026, 3, 13, *s)
    rows = [
        (1, "safety", at((7, 55, 35)), None, vec(1, 0, 0.9, 0.7)),
        (2, "안전성 (safety)", at((7, 55, 54)), None, vec(1, 0, 0.5, 1)),
        (3, "안전성", at((9, 5, 55)), "safe", vec(1, 0, 0, 1)),
        (4, "임상 결과", at((9, 5, 56)), None, vec(0, 1, 0, 1)),
        (5, "환자 안전", at((9, 5, 57)), None, vec(0, 1, 1, 0)),
    ]
    engrams = spark.createDataFrame(rows, "id long, canonical_name string, created_at timestamp, description string, embedding array<double>")
    edges = spark.createDataFrame([(1, 1, 4, "supports", 0.7, None), (2, 2, 4, "supports", 0.9, 1), (3, 3, 5, "supports", 0.8, 1), (4, 1, 2, "related_to", 0.5, None)], "id long, source long, target long, predicate string, confidence double, document_id long").withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))
    fam = resolve.merge_families(engrams, engrams.select(F.col("id").alias("engram_id"), "embedding"))
    assert {(r.id, r.survivor) for r in fam.collect()} == {(1, 3), (2, 3), (3, 3)}
    left = {(r.source, r.target, r.confidence, r.document_id) for r in resolve.rewrite_edges(edges, fam.select("id", "survivor")).collect()}
    assert left == {(3, 4, 0.9, 1), (3, 5, 0.8, 1)}


def test_gaps_and_clusters(spark):
    rows = [(1, 0.0, 0.0, 0.0, 0), (2, 1.0, 0.0, 0.0, 0), (3, 10.0, 0.0, 5.0, 1), (4, 11.0, 0.0, 5.0, 1)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, cluster_id long")
    (gap,) = layout.gaps(points).collect()
    assert (gap.c1, gap.c2, gap.x, gap.z) == (0, 1, 5.5, 2.5)
    assert layout.gaps(points.where("cluster_id = 0")).collect() == []
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (60, 3)) for c in (0, 5, 10)] + [rng.uniform(-3, 13, (40, 3)), np.repeat([[5.0, 5.0, 5.0]], 30, axis=0)])
    frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double, z double")
    for size, eps in ((5, 0.3), (8, 0.15), (4, None)):
        got = {r.id: r.cluster_id for r in layout.cluster(frame, size, eps).collect()}
        if eps is not None:
            assert got == density_by_hand(x, size, eps)
        assert all(len({got[i] for i in range(k, k + 60)} - {None}) >= 1 for k in (0, 60, 120))
    assert layout.cluster(frame.limit(0), 3, 0.1).collect() == [] and layout.cluster(frame.limit(1), 3).collect()[0].cluster_id is None


def density_by_hand(x, size, eps):
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    core = (d2 <= eps * eps).sum(1) >= size
    label = {i: i for i in np.flatnonzero(core).tolist()}
    for _ in range(len(x)):
        old = dict(label)
        for i in label:
            label[i] = min(label[j] for j in label if d2[i, j] <= eps * eps)
        if old == label:
            break
    for i in np.flatnonzero(~core).tolist():
        near = min(((d2[i, j], j) for j in np.flatnonzero(core).tolist() if d2[i, j] <= eps * eps), default=None)
        label[i] = label[near[1]] if near else None
    return label


def test_nearest_in_blocks(spark):
    """Copies and ties by id, ids that are words, more blocks than one, zero vectors and a missing one."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6)).round(1)
    v = np.concatenate([base, base[:20], np.zeros((2, 6))])
    rows = [(f"v{i:03d}", [float(c) for c in x]) for i, x in enumerate(v)] + [("none", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    for block in (7, 2048):
        near = vectors.knn(df.select(F.col("id").alias("q"), "embedding"), df, 4, "q", block).collect()
        want = {}
        for i, x in enumerate(v):
            for r, (d, j) in enumerate(sorted((((x - y) ** 2).sum(), j) for j, y in enumerate(v))[:4]):
                want[f"v{i:03d}", r + 1] = f"v{j:03d}"
        assert {(r.q, r["rank"]): r.id for r in near} == want
        unit = df.where("embedding is not null and id < 'v060'").withColumn("embedding", V.unit(F.col("embedding")))
        n = v[:60] / np.linalg.norm(v[:60], axis=1, keepdims=True)
        pairs = {(f"v{i:03d}", f"v{j:03d}") for i in range(60) for j in range(i + 1, 60) if n[i] @ n[j] >= 0.9}
        got = {(r.a, r.b) for r in vectors.threshold_pairs(unit, 0.9, block).collect()}
        assert got == pairs


def test_families_of_a_busy_name(spark):
    """The least cosine of all pairs of a name, in tiles of three members."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(11, 4))
    held = spark.createDataFrame([("hot", i, [float(c) for c in x]) for i, x in enumerate(v)] + [("lone", 50, [1.0] * 4)], "alias_key string, engram_id long, embedding array<double>")
    got = resolve.least_cosines(held, 3).collect()
    assert abs(min(r.cosine for r in got) - min(v[i] @ v[j] for i in range(11) for j in range(i))) < 1e-9 and len(got) <= 15


def test_new_concepts_link_beyond_ten_copies(spark):
    """Crowds of equal vectors on either side of a link: one concept."""
    a, b, c = [1.0, 0.05, 0.0], [1.0, -0.05, 0.0], [0.0, -1.0, -1.0]
    rows = [(i, f"name {i}", x) for i, x in enumerate([a] * 15 + [b] * 15 + [c])]
    cands = spark.createDataFrame(rows, "cand long, name string, embedding array<double>").withColumn("embedding", V.unit(F.col("embedding")))
    none = spark.createDataFrame([], "id long, canonical_name string")
    got = resolve.get_or_create(cands, none, spark.createDataFrame([], "engram_id long, embedding array<double>"), least=0.99).collect()
    assert {r.engram_id for r in got if r.cand < 30} == {0} and {r.engram_id for r in got if r.cand == 30} == {30}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert all(got.get(k, k) == v for k, v in label.items() if k not in loops)


def test_mock_embedding_is_stable(spark):
    v = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(vectors.mock_embedding(F.col("t"), 16).alias("v")).collect()
    assert v[0].v == v[1].v != v[2].v and abs(np.linalg.norm(v[0].v) - 1) < 1e-9


def test_chunks_overlap_and_cover():
    text = ("Some words make a sentence. " * 400).strip()
    parts = X.split_chunks(text, 1000, 100)
    assert all(len(p) <= 1000 for p in parts) and text.startswith(parts[0]) and text.endswith(parts[-1])
    assert X.split_chunks("short", 1000) == ["short"]


def test_chunks_by_case():
    """The best kind of mark near the limit ends a piece, even before a later one of a lesser kind."""
    text = "a" * 60 + ". " + "b" * 20 + ", " + "c" * 30 + " d"
    assert X.split_chunks(text, 100, 0) == ["a" * 60 + ".", "b" * 20 + ", " + "c" * 30 + " d"]
    para = "x " * 45 + "\n\n" + "y " * 10
    assert X.split_chunks(para, 100, 0)[0] == ("x " * 45).strip()
    solid = "z" * 250
    assert X.split_chunks(solid, 100, 10) == [solid[:100], solid[90:190], solid[180:]]
    words = "word " * 60
    assert all(p.startswith("word") for p in X.split_chunks(words, 100, 13))


def test_fingerprints(spark):
    cases = [("The Ethics of AI vs Safety", "ethics ai safety"), ("안전과 윤리", "안전 윤리"), ("윤리 및 안전", "윤리 안전"), ("AI와 사회", "ai 사회"), ("of the", "of the"), ("A-B (b)", "b"), ("사과", "사과")]
    got = spark.createDataFrame([(a,) for a, _ in cases], "n string").select(N.fingerprint(F.col("n")).alias("f")).collect()
    assert [r.f for r in got] == [b for _, b in cases]


def test_heat_counts_stop_where_the_score_does(spark):
    """A concept that all have, documents with fewer recent ones than count, loops, and both variants."""
    import collections

    as_of, day = "2026-01-31 00:00:00", datetime.timedelta(days=1)
    docs = [(i, datetime.datetime(2026, 1, 31) - day * (i * 3), i % 4, "url", 1, "t") for i in range(30)]
    links = [(i, 1) for i in range(30)] + [(i, 10 + i % 7) for i in range(30)] + [(0, 99), (29, 99)]
    edges = [(k, k % 5, 10 + k % 3) for k in range(14)] + [(100, 99, 99), (101, 99, 1)]
    d = spark.createDataFrame(docs, "id long, created_at timestamp, revision int, source_type string, processed int, tidy_text string").withColumn("updated_at", F.col("created_at"))
    k = spark.createDataFrame(links, "document_id long, engram_id long")
    e = spark.createDataFrame(edges, "id long, source long, target long")
    of = collections.defaultdict(set)
    for i, c in links:
        of[i].add(c)
    recent = {i for i, at, *_ in docs if at.date() >= datetime.date(2026, 1, 1)}
    co = {i: len({j for j in recent if j != i and of[i] & of[j]}) for i in of}
    near = {i: sum(1 for _, a, b in edges if {a, b} & of[i]) for i in of}
    met = {i: sum(len({a, b} & of[i]) for _, a, b in edges) for i in of}
    for variant, n in (("standard", near), ("created", met)):
        got = {r.id: (r.co_activity, r.edge_count) for r in heat.heat(d, k, e, as_of, variant).collect()}
        assert got == {i: (min(co[i], 5), min(n[i], 10)) for i in of}


def test_files(spark, tmp_path):
    (tmp_path / "note.md").write_text("# Head\n\nBody.\n")
    (tmp_path / "blank.md").write_text(" \n")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "word.docx").write_bytes(data.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "paper.pdf").write_bytes(b"%PDF-1.7 one\ftwo goes on")
    (tmp_path / "sheet.xlsx").write_bytes(b"x")
    got = {r.title: (r.text, r.error) for r in readers.files(spark, str(tmp_path)).collect()}
    assert got["note"] == ("# Head\n\nBody.", None) and got["word"] == ("One\na | b", None) and got["blank"] == (None, "blank") and got["bad"] == (None, "damaged")
    assert got["paper"] == (None, "unsupported suffix: pdf") and got["sheet"] == (None, "unsupported suffix: xlsx")
    read = {r.title: (r.text, r.error, r.mime_type) for r in readers.files(spark, str(tmp_path), lambda b: b.decode().split("\f")).collect()}
    assert read["paper"] == ("%PDF-1.7 one\n\ntwo goes on", None, "application/pdf") and len(read) == 6


def test_pdf_pages(spark):
    word = ("apple", "brick", "cloud")
    pages = [f"Journal of Things\n{w} opens the page\nwith text that goes hyphen-\nated {w} here.\nThe {w} ends\n{k + 1}" for k, w in enumerate(word)]
    (r,) = readers.page_texts(spark.createDataFrame([(1, pages)], "id long, pages array<string>")).collect()
    assert "Journal" not in r.text and "hyphenated cloud here." in r.text and not r.text.endswith("3")
    blocks = [f"Paragraph {i} ends here." for i in range(30)] + ["References", "[1] A paper."]
    few = ["Start.", "References", "[1] Kept, as the text is short."]
    rows = [(1, ["\n".join(blocks)]), (2, ["\n".join(few)]), (3, ["\n".join(["References"] + blocks)]), (4, [" ", ""]), (5, ["one page\n1 of 2", "Page 2\nSHOUTED\nruns on\nand on.\nNew one"])]
    got = {x.id: x.text for x in readers.page_texts(spark.createDataFrame(rows, "id long, pages array<string>")).collect()}
    assert got == {1: "\n\n".join(blocks[:30]), 2: "\n\n".join(few), 3: "\n\n".join(["References"] + blocks[:30]), 5: "one page\n\nSHOUTED\n\nruns on and on.\n\nNew one"}


def test_feeds_and_articles(spark):
    bodies = [
        ("u1", "<rss><channel><item><title>T</title><description>&lt;p&gt;Some  text&lt;/p&gt;</description><link>l</link><pubDate>d</pubDate></item><item><title>Only title</title></item><item><description> </description></item></channel></rss>"),
        ("u2", '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>E</title><content>Body</content><link rel="self" href="s"/><link rel="alternate" href="a"/><published>p</published></entry><entry><title>Bare</title></entry></feed>'),
        ("u3", "not xml"),
    ]
    got = {(r.feed_url, r.title, r.text, r.source_uri, r.published) for r in readers.feed_items(spark.createDataFrame(bodies, "feed_url string, xml string")).collect()}
    assert got == {("u1", "T", "Some text", "l", "d"), ("u1", "Only title", "Only title", "u1", None), ("u2", "E", "Body", "a", "p"), ("u2", "Bare", "Bare", "u2", None)}
    html = """<html><head><title>Plain</title><meta property="og:title" content="Own &amp; only"><meta name="author" content="Ann"><meta property="article:published_time" content="2024-01-02">
      <script>var x = "<p>no</p>"</script></head><body><nav><p>menu</p></nav><article><h1>Head</h1><p>First <b>bold</b> line.</p><p><a href=x>only a link</a></p><!-- <p>gone</p> --><ul><li>Item &lt;1&gt;</li></ul></article><footer>foot</footer></body></html>"""
    pages = [(html,), ("<title>T</title><p>a<br>b",), ("<script>x</script>",), (None,)]
    a, b, c, d = [r.a for r in spark.createDataFrame(pages, "h string").select(readers.article(F.col("h")).alias("a")).collect()]
    assert (a.title, a.author, a.date, a.text) == ("Own & only", "Ann", "2024-01-02", "Head\nFirst bold line.\nItem <1>")
    assert (b.title, b.text) == ("T", "T\na\nb") and c.text is None and d.text is None
    page = lambda t: spark.range(1).select(readers.reader_page(F.lit(t)).alias("p")).first().p
    assert page("# Head\nshort") is None and page("# Head\n" + "x" * 50).title == "Head" and page("Title: A b\n" + "x" * 50).title == "A b" and page("x" * 50).title is None


def test_failed_prompts_are_known(spark):
    """One prompt of a batch fails: the others have their replies, and its error is kept."""

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        return [p.upper() for p in prompts]

    got = vectors.ask(spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, prompt string").coalesce(1), model)
    good, lost = vectors.quarantined(got)
    assert {r.id: r.reply for r in good.collect()} == {1: "A", 3: "C"} and [(r.id, r.error) for r in lost.collect()] == [(2, "RuntimeError: refused")]


def test_late_events_and_windows(spark, tmp_path):
    """A stream with a watermark: a row later than it is left out, a window is written once it is past."""
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, event_type string"
    for n, rows in enumerate(([(at(1, 5), "a"), (at(1, 20), "a")], [(at(5, 0), "b")], [(at(1, 30), "late"), (at(5, 30), "b")], [(at(9, 0), "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counts = feeds.tumbling_counts(feeds.poll(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema))
        counts.writeStream.option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.start, r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(at(1, 0), "a", 2), (at(5, 0), "b", 2)}


def test_unknown_cases_are_an_error(spark):
    cases = spark.createDataFrame([(1, "a", 1, False), (2, "b", 1, True)], "id long, category string, rank int, map_reduce boolean")
    assert [r.id for r in evals.eligible(cases, 5, 1, [1]).collect()] == [1]
    with pytest.raises(ValueError):
        evals.eligible(cases, 5, 1, [1, 2])


def test_stream_inserts_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u1"), (2, "u1"), (3, "u2")], "pos long, source_uri string")
    rows.write.parquet(str(tmp_path / "in"))
    for n in range(2):
        items = feeds.poll(spark, str(tmp_path / "in"), rows.schema)
        feeds.insert_batches(items, str(tmp_path / "table"), str(tmp_path / f"check{n}")).awaitTermination()
    got = [(r.pos, r.source_uri) for r in spark.read.parquet(str(tmp_path / "table")).collect()]
    assert sorted(got) == [(1, "u1"), (3, "u2")]
