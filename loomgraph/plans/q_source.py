"""Sources, streams and pipeline steps (SRC, STR, PIP, LNK2, MUT18, EMB)."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import mutate as M
from ..operators import pipeline as P
from ..operators import resolve as R
from ..operators import vectors as K
from ..sources import readers as S
from ..sources.file_source import docx_of, read_files
from ..sources.polling import opened, polls
from ..staging import staged, staging_path
from ..streaming import feeds as T
from .q_resolve import ALIASES
from .registry import query
from .views import oracle, view


@query("src1_scribbles", "SELECT event_id, event_type AS text FROM events WHERE user_id % 5 <> 0")
def src1(spark, d):
    text = F.when(F.col("user_id") % 5 == 0, " \t\n\u00a0").otherwise(F.concat(F.lit("\n\t "), "event_type", F.lit(" \u00a0 ")))
    return S.scribbles(view(spark, d, "events").select("event_id", text.alias("text")))


def written(spark, d):
    """A folder of files made from documents, one each, by id: Markdown, Word, PDF (pages between form feeds), Word files
    that are cut short, blank Markdown, and text."""
    folder = staging_path(spark, "files")
    docs = view(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f]", " ").alias("text"))

    def write(batches):
        fs, path = opened(folder)
        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                kind = ("md", "docx", "pdf", "docx", "md", "txt")[i % 6]
                data = docx_of(["", t], [[" a", str(i)]]) if kind == "docx" else (" \n" if i % 6 == 4 else f" \n{t}\n").encode()
                data = data[: len(data) // 2] if i % 6 == 3 else "\f".join([t[:40], "", t[40:80]]).encode() if kind == "pdf" else data
                fs.create_dir(f"{path}/{i % 10}")
                with fs.open_output_stream(f"{path}/{i % 10}/{i}.{kind}") as f:
                    f.write(data)
            yield b[["doc_id"]]

    docs.mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
    return folder


BARE = r"regexp_replace(text, '[\x00-\x08\x0b-\x1f]', ' ', 'g')"


@query("src2_files", rf"""SELECT doc_id AS title, ['text/markdown', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'text/markdown', NULL][1 + doc_id % 6] AS mime_type,
    CASE WHEN doc_id % 6 IN (0, 1) THEN sha256(CASE doc_id % 6 WHEN 0 THEN t ELSE CASE WHEN t = '' THEN '' ELSE b || chr(10) END || 'a | ' || doc_id END) END AS text_sha256,
    CASE WHEN doc_id % 6 = 3 THEN 'damaged: BadZipFile' WHEN doc_id % 6 = 4 OR (doc_id % 6 = 0 AND t = '') OR (doc_id % 6 = 2 AND trim(left(b, 80), ' ' || chr(10) || chr(9)) = '') THEN 'blank' WHEN doc_id % 6 = 5 THEN 'unsupported suffix: txt' END AS error
    FROM (SELECT doc_id, b, trim(b, ' ' || chr(10) || chr(9)) AS t FROM (SELECT doc_id, {BARE} AS b FROM documents)) WHERE doc_id % 6 <> 2""")
def src2(spark, d):
    """Files of all kinds but PDFs, which go through page cleaning (txt3_page_texts)."""
    rows = read_files(spark, written(spark, d), lambda data: data.decode("utf-8").split("\f"))
    kept = rows.where("suffix <> 'pdf'")
    return kept.select(F.col("title").cast("long").alias("title"), "mime_type", F.sha2("text", 256).alias("text_sha256"), "error")


def paged(spark, d, lines=5):
    """Documents as pages of some lines each, with a running head that has the page's number, and a foot."""
    found = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    docs = view(spark, d, "documents").select("doc_id", found.alias("found")).where("size(found) > 0")
    page = lambda k: F.concat(F.lit("Journal of Looms, page "), k.cast("string"), F.lit("\n"), F.array_join(F.slice("found", k * lines - (lines - 1), lines), "\n"), F.lit("\n"), k.cast("string"))
    pages = F.transform(F.sequence(F.lit(1), F.ceil(F.size("found") / lines).cast("int")), page)
    return docs.select(F.col("doc_id").alias("id"), pages.alias("pages"))


@query("txt3_page_texts")
def txt3(spark, d):
    """Not for SQL: paragraphs flow by a fold over lines; tests/test_files.py has a plain one."""
    return S.page_texts(paged(spark, d))


@query("emb1_mock_vectors", "SELECT doc_id AS id, 8 AS n, 1.0::DOUBLE AS length, count(*) OVER (PARTITION BY text) AS alike FROM documents")
def emb1(spark, d):
    """A unit vector a text, the same for equal texts and no others."""
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("id"), K.mock_embedding(F.col("text"), 8).alias("v"))
    norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 9)
    counts = staged(docs.select("id", F.size("v").alias("n"), norm.alias("length"), F.xxhash64("v").alias("mark")), "mock-vectors")
    return counts.join(counts.groupBy("mark").agg(F.count(F.lit(1)).alias("alike")), "mark").select("id", "n", "length", "alike")


@query("src15_vectors", "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, round(avg(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS squares, CAST(max(len(embedding)) AS BIGINT) AS size FROM embeddings GROUP BY 1")
def src15(spark, d):
    """Vectors as they are stored."""
    e = view(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return e.groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(squares), 6).alias("squares"), F.max(F.size("embedding")).cast("long").alias("size"))


@query("src6_feed_items", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Sum of ' || page_id ELSE 'Item ' || page_id END AS text, CASE WHEN page_id % 4 = 0 THEN 'http://feed/' || page_id ELSE 'http://item/' || page_id END AS source_uri, CASE WHEN page_id % 2 = 0 THEN 'Mon' ELSE '2024-01-02' END AS published FROM pages WHERE page_id % 7 <> 6")
def src6(spark, d):
    n, k = F.col("page_id"), F.col("page_id").cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    title = F.when(n % 7 == 6, F.lit("&lt;b&gt; ")).otherwise(put("&lt;b&gt;Item&lt;/b&gt; ", k))
    summary = F.when(n % 3 == 0, put("Sum  of &lt;i/&gt;", k)).otherwise(F.lit(" "))
    rss = put("<rss><channel><title>t</title><item><title>", title, "</title><description>", F.when(n % 7 == 6, F.lit("")).otherwise(summary), "</description>", F.when(n % 4 == 0, "").otherwise(put("<link>http://item/", k, "</link>")), "<pubDate>Mon</pubDate></item></channel></rss>")
    links = F.when(n % 4 == 0, "").otherwise(put('<link rel="self" href="http://self"/><link href="http://item/', k, '"/>'))
    atom = put('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title>', title, "</title><summary>", F.when(n % 7 == 6, F.lit("")).otherwise(summary), "</summary>", links, "<updated>2024-01-02</updated></entry></feed>")
    bodies = view(spark, d, "pages").select(put("http://feed/", k).alias("feed_url"), F.when(n % 2 == 0, rss).otherwise(atom).alias("xml"))
    return S.feed_items(bodies).select(F.regexp_extract("feed_url", "[0-9]+", 0).cast("long").alias("page_id"), "text", "source_uri", "published")


@query("src8_transcripts", r"SELECT conv_id AS video, string_agg(t, ' ' ORDER BY turn) AS text FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS t FROM conversations) WHERE t <> '' GROUP BY 1")
def src8(spark, d):
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    line = F.concat(F.lit('<text start="1" dur="2">'), escaped, F.lit("</text>"))
    c = view(spark, d, "conversations").groupBy(F.col("conv_id").alias("video")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("x")))), lambda r: r["x"]), "").alias("xml"))
    return S.transcripts(S.captions(c))


@query("src12_reader_pages", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Head ' || doc_id WHEN 1 THEN 'Named ' || doc_id END AS title, length(t) AS n FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '# Head ' || doc_id || chr(10) WHEN 1 THEN 'Title: Named ' || doc_id || chr(10) ELSE '' END || regexp_replace(text, '\\s+$', '') AS t FROM documents WHERE trim(text) <> '') WHERE length(t) >= 50")
def src12(spark, d):
    n, k = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    head = F.when(n == 0, F.concat(F.lit(" \n# Head "), k, F.lit("\n"))).when(n == 1, F.concat(F.lit("Title: Named "), k, F.lit("\n"))).otherwise("")
    rows = view(spark, d, "documents").where("trim(text) <> ''").select("doc_id", S.reader_page(F.concat(head, "text", F.lit("\n "))).alias("p"))
    return rows.where("p is not null").select("doc_id", "p.title", F.length("p.text").cast("long").alias("n"))


def article_sql() -> str:
    bare = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    title = f"regexp_extract({bare}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    for tag in S.ASIDE:
        bare = rf"regexp_replace({bare}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    inner = ", ".join(rf"nullif(regexp_extract(bare, '(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>', 1), '')" for tag in ("article", "main", "body"))
    words = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))"
    plain = words(r"regexp_replace(x, '(?is)<a\b[^>]*>.*?</a\s*>', ' ', 'g')")

    def decoded(t: str) -> str:
        for mark, char in S.ENTITIES:
            t = f"replace({t}, '{mark}', '{char.replace(chr(39), chr(39) * 2)}')"
        return t

    lines = f"list_transform(list_filter(regexp_split_to_array(coalesce({inner}, bare), '{S.BREAKS}'), lambda x: {words('x')} <> '' AND 2 * length({plain}) >= length({words('x')})), lambda x: {words('x')})"
    return f"SELECT page_id, {decoded('trim(title)')} AS title, {decoded(f'array_to_string({lines}, chr(10))')} AS text FROM (SELECT page_id, {title} AS title, {bare} AS bare FROM pages)"


@query("src13_articles", article_sql())
def src13(spark, d):
    return view(spark, d, "pages").select("page_id", S.article(F.col("html")).alias("a")).select("page_id", "a.title", "a.text")


@query("src14_eval_cases", "SELECT 'full' AS chosen, count(*) AS n FROM events UNION ALL SELECT 'smoke', count(*) FROM events WHERE event_id % 4 = 0")
def src14(spark, d):
    rows = view(spark, d, "events").select(F.to_json(F.struct(F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 == 0, "smoke").otherwise("full").alias("set"))).alias("value"))
    path = staging_path(spark, "cases")
    rows.write.text(path)
    n = [S.cases(spark, path, c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("chosen"), "n") for c in ("full", "smoke")]
    return n[0].unionByName(n[1])


def stream_of(spark, df):
    """A table as a stream of files, and a folder for what comes of it."""
    path = staging_path(spark, "arrivals")
    df.write.parquet(path)
    return T.poll(spark, path, df.schema, 2), staging_path(spark, "stream")


def arriving(spark, df, part, parts, run):
    """df in parts by the column ``part``, one after another: each is added to a folder of files, and ``run`` starts a stream over the
    folder, which takes up where the last one ended. Gives what run returned, and a folder for what comes of it."""
    path, out, got = staging_path(spark, "arrivals"), staging_path(spark, "stream"), []
    for k in range(parts):
        df.where(part == k).write.mode("append").parquet(path)
        got.append(run(T.poll(spark, path, df.schema, 1000), out, k))
    return got, out


FEED_ITEMS = "SELECT event_id AS pos, user_id % 7 AS feed_id, 'u' || (user_id % 50) || event_type AS source_uri FROM events"


def arrivals(spark, d):
    e = view(spark, d, "events")
    return e.select(F.col("event_id").alias("pos"), (F.col("user_id") % 7).alias("feed_id"), F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"), "event_type").alias("source_uri"))


def thirds(items):
    """items and the part of three that each comes with, by pos: 0 to 2."""
    n = items.agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("top"), F.min("pos").alias("low")).first()
    step = ((n.top or 0) - (n.low or 0) + 1) / 3
    return items.withColumn("third", F.least(F.floor((F.col("pos") - (n.low or 0)) / step), F.lit(2)).cast("int"))


BY_THIRD = "least(floor((pos - min(pos) OVER ()) / ((max(pos) OVER () - min(pos) OVER () + 1) / 3.0::DOUBLE)), 2)"


@query("str1_polled_items", f"SELECT source_uri, min(pos) AS pos FROM (SELECT *, {BY_THIRD} AS third FROM ({FEED_ITEMS})) WHERE feed_id < 4 AND (feed_id <> 3 OR third <> 1) AND (feed_id <> 2 OR third = 0) GROUP BY 1")
def str1(spark, d):
    """Feed 3 is off at the second poll and on again at the third; feed 2 is switched off after the first."""
    items, folder, feeds, out = thirds(arrivals(spark, d)), staging_path(spark, "polls"), staging_path(spark, "feeds"), staging_path(spark, "stream")
    for k, active in enumerate(([0, 1, 2, 3], [0, 1], [0, 1, 3])):
        items.where(F.col("third") == k).drop("third").write.partitionBy("feed_id").parquet(f"{folder}/poll={k + 1}")
        spark.range(7).select("id", F.col("id").isin(active).alias("active")).write.mode("overwrite").parquet(feeds)
        polled = polls(spark, folder, feeds, items.drop("third").schema).select("pos", "source_uri")
        T.insert_batches(polled, f"{out}/table", f"{out}/check").awaitTermination()
    return spark.read.parquet(f"{out}/table").select("source_uri", "pos")


@query("str2_streamed_first_seen", f"SELECT source_uri, min(pos) AS pos, third AS came FROM (SELECT *, {BY_THIRD} AS third FROM ({FEED_ITEMS})) GROUP BY source_uri, third QUALIFY row_number() OVER (PARTITION BY source_uri ORDER BY min(pos)) = 1")
def str2s(spark, d):
    """Three arrivals, the stream started anew for each: keys that came before are known from its state."""
    items = thirds(arrivals(spark, d))
    items = items.select("pos", "source_uri", F.col("third").cast("double").alias("came"))

    def run(stream, out, k):
        T.insert_batches(stream, f"{out}/table", f"{out}/check").awaitTermination()

    _, out = arriving(spark, items, F.col("came"), 3, run)
    return spark.read.schema(items.schema).parquet(f"{out}/table").select("source_uri", "pos", "came")


D2 = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query("str3_triaged_after_poll", f"SELECT i.id, CASE WHEN s IS NULL OR s >= 0.35 THEN 1 ELSE -1 END AS triaged FROM (SELECT min(pos) AS id FROM ({FEED_ITEMS}) GROUP BY source_uri) i LEFT JOIN (SELECT a.vec_id AS id, max(1 - {D2} / 2) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 GROUP BY 1) USING (id)")
def str3(spark, d):
    """Three arrivals; triage goes by the batch that stored the rows and fails the first time in the second, which runs again."""
    v = view(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries, known = v.where("id % 20 = 0"), v.where("id % 20 <> 0")
    items, failed = thirds(arrivals(spark, d)), []

    def run(stream, out, k):
        def triage(rows, name):
            if k == 1 and not failed:
                failed.append(name)
                raise RuntimeError("the first triage fails")
            K.triage(rows.select(F.col("pos").alias("id")), queries, known, 0.35).select("id", "triaged").write.mode("overwrite").parquet(f"{out}/triaged/{name}")

        go = lambda: T.insert_batches(stream, f"{out}/table", f"{out}/check", after=triage).awaitTermination()
        try:
            go()
        except StreamingQueryException:
            go()

    _, out = arriving(spark, items.drop("feed_id"), F.col("third"), 3, run)
    return spark.read.parquet(f"{out}/triaged").select("id", "triaged")


@query("str4_quarantine", "SELECT 'done' AS status, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT 'quarantined', count(*), NULL FROM events WHERE event_id % 9 = 0 UNION ALL SELECT 'pending', count(*), NULL FROM events WHERE event_id % 9 = 0")
def str4(spark, d):
    rows = view(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 9 == 0, F.substring("props", 2, 100)).otherwise(F.col("props")).alias("props"))
    items, out = stream_of(spark, rows)
    work = lambda b: b.select("id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.when(F.get_json_object("props", "$.k").isNull(), F.lit("no object with k")).alias("error"))
    for run in range(2):  # the second, with a checkpoint of its own, finds all of it there
        T.process_batches(items, work, f"{out}/done", f"{out}/failed", f"{out}/check{run}").awaitTermination()
    done, failed = (spark.read.parquet(f"{out}/{t}") for t in ("done", "failed"))
    n = lambda df, name, k: df.agg(F.count(F.lit(1)).alias("n"), k.cast("long").alias("k")).select(F.lit(name).alias("status"), "n", "k")
    none = F.lit(None)
    return n(done, "done", F.sum("k")).unionByName(n(failed, "quarantined", none)).unionByName(n(T.pending(rows, done), "pending", none))


@query("pip2_retidied", oracle("SELECT id, revision, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN 'new' ELSE tidy_title END AS tidy_title, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN 'full' ELSE tidy_level END AS tidy_level FROM kd"))
def pip2(spark, d):
    kd = view(spark, d, "kd")
    results = kd.where("id % 4 = 0").select("id", (F.col("revision") - F.when(F.col("id") % 3 == 0, 0).otherwise(1)).alias("revision"), F.lit("new").alias("tidy_title"), F.lit("text").alias("tidy_text"), F.lit("full").alias("tidy_level"))
    return M.retidy(kd, results).select("id", "revision", "tidy_title", "tidy_level")


@query("pip3_materialized", "SELECT p_size AS engram_id, min(p_partkey) AS pos, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1")
def pip3(spark, d):
    return M.materialize(view(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").alias("engram_id"), F.col("p_name").alias("name")))


@query("pip4_stored_aliases", f"SELECT id AS engram_id, k AS alias_key, CASE WHEN id % 3 = 0 THEN 'stored' ELSE kind END AS alias_kind FROM ({ALIASES})")
def pip4(spark, d):
    ke = view(spark, d, "ke")
    return M.store_aliases(R.alias_index(ke.where("id % 3 = 0")).withColumn("alias_kind", F.lit("stored")), ke)


@query("pip5_predicate_prompts", oracle("""SELECT s.id, 'Source concept: ' || s.canonical_name || chr(10) || 'Description: ' || coalesce(s.description, 'no description') || chr(10) || chr(10) || 'Target concepts:' || chr(10) || listed || chr(10) || chr(10) || 'Context from source document:' || chr(10) || substring(t.text, 1, 1500) AS prompt
    FROM ke s JOIN (SELECT x.source AS id, string_agg('- ' || e.canonical_name || ': ' || coalesce(e.description, 'no description'), chr(10) ORDER BY x.id) AS listed FROM kx x JOIN ke e ON e.id = x.target GROUP BY 1) g ON g.id = s.id JOIN kd t ON t.id = s.id"""))
def pip5(spark, d):
    ke, kx = view(spark, d, "ke"), view(spark, d, "kx")
    sources = ke.select("id", "canonical_name", "description", F.col("id").alias("document_id"))
    targets = kx.select(F.col("source").alias("id"), F.col("id").alias("place"), "target").join(ke.select(F.col("id").alias("target"), "canonical_name", "description"), "target")
    return P.predicate_prompts(sources, targets, view(spark, d, "kd").select(F.col("id").alias("document_id"), "text"))


@query("pip6_vector_sizes", "SELECT 'engrams' AS \"table\", max(len(embedding))::INT AS size, false AS uneven, max(len(embedding)) <> 384 AS mismatch FROM embeddings UNION ALL SELECT 'cut', max(len(embedding))::INT, true, max(len(embedding)) <> 384 FROM embeddings UNION ALL SELECT 'none', NULL, false, false")
def pip6(spark, d):
    e = view(spark, d, "embeddings")
    cut = e.withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return M.vector_sizes({"engrams": e, "cut": cut, "none": e.limit(0)}, 384)


@query("pip7_phases", oracle("SELECT 'extract' AS phase, 0 AS place, count(*) AS total, count(*) FILTER (id % 10 <> 0) AS done, count(*) FILTER (id % 10 = 0) AS failed FROM kd UNION ALL SELECT 'link', 1, count(*) FILTER (id % 10 <> 0), count(*) FILTER (id % 10 > 1), count(*) FILTER (id % 10 = 1) FROM kd UNION ALL SELECT 'project', 2, count(*) FILTER (id % 10 > 1), count(*) FILTER (id % 10 > 1), 0 FROM kd"))
def pip7(spark, d):
    fails = lambda k: lambda df: df.withColumn("error", F.when(F.col("id") % 10 == k, "refused"))
    return P.in_phases(view(spark, d, "kd").select("id"), [("extract", fails(0)), ("link", fails(1)), ("project", fails(-1))])[1]


@query("pip8_processed", oracle("""WITH n AS (SELECT l_orderkey AS g, CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE 'new ' || p_type END AS name FROM lineitem JOIN part ON p_partkey = l_partkey), e AS (SELECT canonical_name, min(id) AS id FROM ke GROUP BY 1)
    SELECT (SELECT count(*) FROM ke) + (SELECT count(DISTINCT name) FROM n WHERE name NOT IN (SELECT canonical_name FROM e)) AS engrams, (SELECT count(*) FROM (SELECT document_id, CAST(engram_id AS VARCHAR) FROM kl UNION SELECT g, coalesce(CAST(id AS VARCHAR), name) FROM n LEFT JOIN e ON canonical_name = name)) AS links,
    (SELECT count(*) FROM kx) + (SELECT count(DISTINCT name) FROM n WHERE name NOT IN (SELECT canonical_name FROM e)) AS edges, (SELECT count(*) FROM kd WHERE NOT (source_type = 'scribble' AND processed = 0 AND tidy_text IS NULL)) AS heat"""))
def pip8(spark, d):
    ke, kx, kl, kd = (view(spark, d, v) for v in ("ke", "kx", "kl", "kd"))
    li = view(spark, d, "lineitem").join(view(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("new "), "p_type"))
    extracted = li.select(F.col("l_orderkey").alias("group"), (F.lit(10_000_000) + F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("pos"), name.alias("name"), F.col("p_type").alias("description"))
    none = spark.createDataFrame([], "name string, canonical string")
    embed = lambda texts: texts.select("id", K.mock_embedding(F.col("text"), 64).alias("embedding"))

    def propose(new):
        made = new.where("engram_id >= 10000000").groupBy("engram_id").agg(F.min("document_id").alias("document_id"))
        return made.select((F.col("engram_id") * -1).alias("id"), F.col("engram_id").alias("source"), F.lit(1).cast("long").alias("target"), F.lit("related_to").alias("predicate"), F.lit(0.5).alias("confidence"), "document_id", F.lit("2024-01-01").cast("timestamp").alias("created_at"))

    vectors = view(spark, d, "embeddings").select(F.col("vec_id").alias("engram_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    t = P.process(kd, extracted, ke, vectors, kl, kx, none, embed, propose, "2001-08-01 00:00:00", 0.99)
    n = [t[k].agg(F.count(F.lit(1)).alias(k)) for k in ("engrams", "links", "edges", "heat")]
    return n[0].join(n[1]).join(n[2]).join(n[3])  # one row each


@query("lnk2_collected_proposals", oracle("SELECT l_partkey AS source, e.id AS target, 'supports' AS predicate, 0.5::DOUBLE AS confidence, l_orderkey AS document_id FROM lineitem JOIN ke e ON e.id = l_suppkey WHERE l_linenumber IN (1, 2, 5)"))
def lnk2(spark, d):
    li, n = view(spark, d, "lineitem"), F.col("l_linenumber")
    edge = F.concat(F.lit('[{"target": "'), F.col("l_suppkey").cast("string"), F.lit('", "predicate": "supports", "confidence": 0.5}]'))
    wrapped = F.concat(F.lit('{"edges": '), edge, F.lit("}"))
    reply = F.when(n == 1, F.concat(F.lit("```json\n"), wrapped, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here: "), wrapped)).when(n == 5, edge).when(n == 3, "no JSON").when(n == 4, F.replace(wrapped, F.lit("supports"), F.lit("likes")))
    known = view(spark, d, "ke").select("id", F.col("id").cast("string").alias("name"))
    return K.propose_edges(li.select(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("document_id"), reply.alias("reply")), known)


@query("mut18_backup", oracle("SELECT 'kd' AS name, count(*) AS n FROM kd UNION ALL SELECT 'kx', count(*) FROM kx"))
def mut18(spark, d):
    folder = staging_path(spark, "backup")
    M.back_up({v: view(spark, d, v) for v in ("kd", "kx")}, folder)
    n = [spark.read.parquet(f"{folder}/{v}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("name"), "n") for v in ("kd", "kx")]
    return n[0].unionByName(n[1])


@query("emb0_unit_vectors", "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN [0.0, 0.0]::DOUBLE[] ELSE [p_size / sqrt(p_size * p_size + 9.0::DOUBLE), 3 / sqrt(p_size * p_size + 9.0::DOUBLE)] END[1] AS x FROM part")
def emb0(spark, d):
    p = view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("text"))
    model = lambda texts: [[0.0, 0.0] if int(t) % 4 == 0 else [float(t), 3.0] for t in texts]
    return K.embed(p, model, 2).select("id", F.col("embedding")[0].alias("x"))


@query("emb2_asked", "SELECT event_id AS id, CASE WHEN event_type = 'error' THEN NULL ELSE upper(event_type) END AS reply, event_type = 'error' AS failed FROM events")
def emb2(spark, d):
    def model(prompts):
        if "error" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    got = staged(K.ask(view(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("prompt")), model), "asked")
    return got.select("id", "reply", F.col("error").isNotNull().alias("failed"))
