"""Search (FTS, VEC, RRF, KNW, EDG, SYN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import text_segments as X
from ..staging import DROPS, staging_path
from .registry import query
from .views import oracle, view

FOLD = f"translate(lower(coalesce({{c}}, '')), '{S.MARKED}', '{S.PLAIN}')"
TOKENS = r"regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}]+')"


def bm25_sql(terms: list[str], limit: int | None = 20) -> str:
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS df{i}" for i, _ in enumerate(terms))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / avglen))" for i, _ in enumerate(terms))
    where = " AND ".join(f"tf{i} > 0" for i, _ in enumerate(terms))
    cut = f"ORDER BY score DESC, id LIMIT {limit}" if limit else ""
    return f"""(WITH tok AS (SELECT doc_id AS id, {TOKENS.format(c='text')} AS w FROM documents),
      cnt AS (SELECT id, CAST(len(w) AS DOUBLE) AS length, {tf} FROM tok),
      tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS avglen, {df} FROM cnt)
      SELECT id, {score} AS score FROM cnt, tot WHERE {where} {cut})"""


VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)"
VEC = f"(SELECT id, 1 - d2 / 2 AS score FROM (SELECT vec_id AS id, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), {VECTOR}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM embeddings ORDER BY d2, id LIMIT 20))"


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def docs(spark, d):
    return view(spark, d, "documents").withColumnRenamed("doc_id", "id")


_INDEXES: dict[tuple, S.TextIndex] = {}


def index(spark, d):
    """The text index of a folder's documents, kept as long as the files are the same and staged tables stay."""
    rows = docs(spark, d)
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()  # a row a file
    key = (spark.sparkContext.applicationId, DROPS[0], d, *sorted(map(tuple, files)))
    if key not in _INDEXES:
        _INDEXES[key] = S.text_index(rows, ("text",))
    return _INDEXES[key]


@query("fts1_index_build", f"SELECT term, count(*) AS documents, sum(tf)::BIGINT AS places FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format(c='text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def fts1_build(spark, d):
    """The index built anew, and what it holds of each term."""
    return S.text_index(docs(spark, d), ("text",)).postings.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("places"))


#: Documents after the changes of fts1_updated_index.
AFTER = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Edited: la mer avec etre ' || doc_id || ' ' || text ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"


@query("fts1_updated_index", f"SELECT id, round(score, 6) AS score FROM {bm25_sql(['la', 'avec', 'etre'], None).replace('FROM documents', 'FROM ' + AFTER)}")
def fts1_updated(spark, d):
    """An index that began with a part of the documents, got the others in two batches, then edits, then deletes."""
    rows, folder = docs(spark, d).select("id", "text"), staging_path(spark, "segments")
    edited = rows.where("id % 7 = 0").select("id", F.concat(F.lit("Edited: la mer avec etre "), F.col("id").cast("string"), F.lit(" "), "text").alias("text"))
    state = X.open_index(spark, folder)
    for batch in (rows.where("id % 4 > 1"), rows.where("id % 4 = 1"), rows.where("id % 4 = 0"), edited):
        state = X.changed(spark, state, batch, columns=("text",))
    state = X.changed(spark, state, rows.limit(0), rows.where("id % 11 = 0").select("id"), columns=("text",))
    return rounded(S.keyword_search(X.open_index(spark, folder).index(spark), "la avec être", None))


def vectors(spark, d):
    return view(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


def vector_of(spark, d, vec_id=3):
    return list(view(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@query(
    "fts0_sanitize",
    """SELECT event_id, CASE WHEN q = '' THEN '' ELSE '"' || replace(q, ' ', '" "') || '"' END AS phrases FROM
    (SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(event_type || ' (AND "' || props || '"* near:^', '["*():^]', ' ', 'g'), '(?i)\\b(?:AND|OR|NOT|NEAR)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM events)""",
)
def fts0(spark, d):
    text = F.concat("event_type", F.lit(' (AND "'), "props", F.lit('"* near:^'))
    return view(spark, d, "events").select("event_id", S.sanitized(text).alias("phrases"))


@query("fts1_keyword_search", f"SELECT id, round(score, 6) AS score FROM {bm25_sql(['that', 'ingthe'][:1])}")
def fts1(spark, d):
    return rounded(S.keyword_search(index(spark, d), "(That*)"))


@query("fts1_keyword_search_all_terms", f"SELECT id, round(score, 6) AS score FROM {bm25_sql(['la', 'avec', 'etre'], None)}")
def fts1_all(spark, d):
    return rounded(S.keyword_search(index(spark, d), 'la AND "avec" être', None))


PHRASE = """WITH tok AS (SELECT doc_id AS id, list_filter(""" + TOKENS.format(c="text") + """, lambda x: true) AS w FROM documents), cnt AS (SELECT id, CAST(len(w) AS DOUBLE) AS length, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS DOUBLE) AS tf FROM tok),
    tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS avglen, CAST(count(*) FILTER (tf > 0) AS DOUBLE) AS df FROM cnt)
    SELECT id, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avglen)), 6) AS score FROM cnt, tot WHERE tf > 0"""


@query("fts1_phrase_search", PHRASE)
def fts1_phrase(spark, d):
    return rounded(S.keyword_search(index(spark, d), "of-The", None))


@query("vec1_vector_search", f"SELECT id, round(score, 6) AS score FROM {VEC} WHERE id IN (SELECT doc_id FROM documents)")
def vec1(spark, d):
    return rounded(S.vector_search(vectors(spark, d), vector_of(spark, d)).join(docs(spark, d).select("id"), "id", "left_semi"))


def fused_sql(limit: str) -> str:
    return f"""SELECT id, round(rrf, 6) AS rrf, round(score, 6) AS score, match_type FROM (
      SELECT id, sum(1 / (60.0 + rank)) AS rrf, max(score) AS score, CASE WHEN count(DISTINCT list) > 1 THEN 'hybrid' ELSE min(list) END AS match_type, min(place * 1000 + rank) AS seen FROM (
        SELECT id, score, 'keyword' AS list, 0 AS place, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {bm25_sql(['the', 'that'])}
        UNION ALL SELECT id, score, 'semantic', 1, row_number() OVER (ORDER BY score DESC, id) FROM {VEC} WHERE id IN (SELECT doc_id FROM documents)) GROUP BY id ORDER BY rrf DESC, seen {limit})"""


@query("srch_hybrid", fused_sql("LIMIT 20"))
def srch(spark, d):
    return rounded(S.hybrid_search(index(spark, d), docs(spark, d), vectors(spark, d), "the that", vector_of(spark, d)))


@query("rrf1_fuse_untruncated", fused_sql(""))
def rrf1(spark, d):
    known = S.vector_search(vectors(spark, d), vector_of(spark, d)).join(docs(spark, d).select("id"), "id", "left_semi")
    return rounded(S.fuse({"keyword": S.keyword_search(index(spark, d), "the that"), "semantic": known}, None))


EDGE = "id, source, target, predicate, confidence"


@query("knw1_knowledge_search", oracle(f"SELECT {EDGE} FROM kx WHERE source IN (SELECT id FROM ke WHERE canonical_name ILIKE '%gizmo%' ORDER BY id LIMIT 10) OR target IN (SELECT id FROM ke WHERE canonical_name ILIKE '%gizmo%' ORDER BY id LIMIT 10) ORDER BY confidence DESC, id LIMIT 100"))
def knw1(spark, d):
    return S.knowledge_search(view(spark, d, "ke"), view(spark, d, "kx"), "Gizmo").select(*EDGE.split(", "))


@query("knw1_knowledge_search_predicate", oracle(f"SELECT {EDGE} FROM kx WHERE predicate = 'part_of' ORDER BY confidence DESC, id LIMIT 100"))
def knw1p(spark, d):
    return S.knowledge_search(view(spark, d, "ke"), view(spark, d, "kx"), "part_of").select(*EDGE.split(", "))


@query(
    "knw1u_named_edges",
    oracle("""SELECT x.id, s.canonical_name AS source_name, t.canonical_name AS target_name, predicate, confidence FROM kx x JOIN ke s ON s.id = source JOIN ke t ON t.id = target
    WHERE s.canonical_name ILIKE '%red%' OR t.canonical_name ILIKE '%red%' ORDER BY confidence DESC, x.id LIMIT 50"""),
)
def knw1u(spark, d):
    return S.named_edge_search(view(spark, d, "ke"), view(spark, d, "kx"), "red").select("id", "source_name", "target_name", "predicate", "confidence")


@query("knw1u_named_engrams", oracle("SELECT id, canonical_name FROM ke WHERE canonical_name ILIKE '%red%' ORDER BY canonical_name, id LIMIT 30"))
def knw1un(spark, d):
    return S.named_engrams(view(spark, d, "ke"), "Red").select("id", "canonical_name")


@query("knw1g_edge_hits", oracle("SELECT x.id, e.id AS hit, predicate FROM ke e JOIN kx x ON x.source = e.id OR x.target = e.id WHERE e.canonical_name ILIKE '%red bolt%'"))
def knw1g(spark, d):
    return S.named_edge_hits(view(spark, d, "ke"), view(spark, d, "kx"), "red bolt").select("id", "hit", "predicate")


@query("edg1_edges_for_engram", oracle(f"SELECT {EDGE} FROM kx WHERE (source = 6 OR target = 6) AND predicate = 'supports' ORDER BY confidence DESC, id LIMIT 100"))
def edg1(spark, d):
    return S.edges_for(view(spark, d, "kx"), 6, "supports").select(*EDGE.split(", "))


@query("edg2_edges_between", oracle(f"SELECT {EDGE} FROM kx WHERE (source = 3 AND target = 6) OR (source = 6 AND target = 3) OR (source = 9 AND target = 9)"))
def edg2(spark, d):
    kx = view(spark, d, "kx")
    return S.edges_between(kx, 3, 6).unionByName(S.edges_between(kx, 9, 9)).select(*EDGE.split(", "))


@query("edg3_edges_by_predicate", oracle(f"SELECT {EDGE} FROM kx WHERE predicate = 'contradicts' ORDER BY confidence DESC, id LIMIT 100"))
def edg3(spark, d):
    return S.edges_by_predicate(view(spark, d, "kx"), "contradicts").select(*EDGE.split(", "))


@query(
    "syn1_synthesis_prompt",
    oracle("""SELECT 'Synthesis: what is late' AS title, '{"query":"what is late","ids":[' || string_agg(id, ',' ORDER BY id) || ']}' AS metadata,
    string_agg(coalesce(title, 'Untitled') || ': ' || substring(coalesce(nullif(tidy_text, ''), text), 1, 2000), chr(10) || chr(10) ORDER BY id) AS prompt FROM (SELECT * FROM kd WHERE id IN (28, 4, 7, 12) ORDER BY id LIMIT 10)"""),
)
def syn1(spark, d):
    return S.synthesis_prompt(view(spark, d, "kd"), [28, 4, 7, 12], "what is late")
