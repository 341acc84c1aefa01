"""Vectors, heat, checks, graph and layout (HSH, COS, KNN, TRI, LNK, HEAT, GPH, LNT, BFS, PR, PRJ, CLU, GAP, VIZ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph as G
from ..operators import heat as H
from ..operators import hierarchy
from ..operators import layout as Y
from ..operators import lint as L
from ..operators import manifold
from ..operators import resolve as R
from ..operators import vectors as K
from ..operators.listing import is_draft
from .registry import query
from .views import oracle, view

AS_OF = "2001-08-01 00:00:00"
E = "CAST({a}.embedding AS DOUBLE[])"
D2 = "list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def vecs(spark, d):
    return view(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def points(spark, d):
    p = Y.project_groups(vecs(spark, d))
    label = vecs(spark, d).select("id", F.when(F.col("label") < 9, F.col("label")).cast("long").alias("cluster_id"))
    return p.join(label, "id")


GROUPS = """proj AS (WITH m AS (SELECT k, avg(v) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY k),
    c AS (SELECT vec_id AS id, label, k, v - m AS v FROM (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) JOIN m USING (k))
    SELECT id, CASE WHEN label < 9 THEN CAST(label AS BIGINT) END AS cluster_id, sum(v) FILTER (k <= 21) / sqrt(64 / 3.0::DOUBLE) AS x, sum(v) FILTER (k > 21 AND k <= 42) / sqrt(64 / 3.0::DOUBLE) AS y, sum(v) FILTER (k > 42) / sqrt(64 / 3.0::DOUBLE) AS z FROM c GROUP BY id, label)"""


BITS = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN x {op} 0 THEN '1' ELSE '0' END)"
HASH = f"sha256(unhex(array_to_string(list_transform(range(0, len(embedding), 8), lambda i: printf('%02X', list_sum(list_transform(range(8), lambda j: CASE WHEN coalesce(list_extract({BITS}, i + j + 1), '0') = '1' THEN CAST(pow(2, 7 - j) AS INT) ELSE 0 END))::INT)), '')))"


@query("hsh1_concept_hash", f"SELECT vec_id AS id, {HASH.format(op='>=')} AS hash, {HASH.format(op='>')} AS hash_positive FROM embeddings")
def hsh1(spark, d):
    return vecs(spark, d).select("id", V.concept_hash(F.col("embedding")).alias("hash"), V.concept_hash(F.col("embedding"), True).alias("hash_positive"))


@query("cos1_cosine", f"SELECT a.vec_id AS id, round(list_cosine_similarity({E.format(a='a')}, {E.format(a='b')}), 6) AS cosine, round(1 - {D2} / 2, 6) AS from_l2 FROM embeddings a, embeddings b WHERE b.vec_id = 3")
def cos1(spark, d):
    q = F.array(*[F.lit(float(x)) for x in vecs(spark, d).where("id = 3").first()["embedding"]])
    return rounded(vecs(spark, d).select("id", V.cosine(F.col("embedding"), q).alias("cosine"), V.l2_to_cosine(F.sqrt(V.l2_squared(F.col("embedding"), q))).alias("from_l2")))


KNN = f"SELECT a.vec_id AS id, b.vec_id AS neighbor, {D2} AS d2 FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 20 = 0"


@query("knn1_find_neighbors", f"SELECT id, neighbor, round(1 - d2 / 2, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbor) AS rank FROM ({KNN})) WHERE rank <= 10 AND 1 - d2 / 2 >= 0.3")
def knn1(spark, d):
    return rounded(K.find_neighbors(vecs(spark, d).where("id % 20 = 0"), vecs(spark, d), 10, 0.3))


@query("knn1g_find_neighbors_self_slot", f"SELECT id, neighbor, round(1 - d2 / 2, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbor) AS rank FROM ({KNN})) WHERE rank <= 4 AND 1 - d2 / 2 >= 0.3")
def knn1g(spark, d):
    return rounded(K.find_neighbors(vecs(spark, d).where("id % 20 = 0"), vecs(spark, d), 5, 0.3, self_takes_slot=True))


@query("knn2_threshold_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3")
def knn2(spark, d):
    return rounded(K.threshold_pairs(vecs(spark, d), 0.3))


@query("knn2_sketched_pairs")
def knn2s(spark, d):
    """Not for SQL: which pairs meet goes by seeded projections; tests/test_sketches.py measures the recall against the exact form."""
    return rounded(K.sketch_pairs(vecs(spark, d), 0.3))


@query("tri1_triage", oracle(f"""SELECT d.id, CASE WHEN s IS NULL OR s >= 0.35 THEN 1 ELSE -1 END AS triaged, round(s, 6) AS similarity FROM kd d LEFT JOIN (SELECT a.vec_id AS id, max(1 - {D2} / 2) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 GROUP BY a.vec_id) USING (id)
    WHERE d.source_type <> 'scribble'"""))
def tri1(spark, d):
    docs = view(spark, d, "kd").where("source_type <> 'scribble'")
    v = vecs(spark, d).select("id", "embedding")
    return rounded(K.triage(docs, v.where("id % 20 = 0"), v.where("id % 20 <> 0"), 0.35))


@query("tri2_triage_batch", oracle("SELECT id, created_at FROM kd WHERE triaged = 0 AND source_type = 'feed' ORDER BY created_at, id LIMIT 50"))
def tri2(spark, d):
    return K.triage_batch(view(spark, d, "kd")).select("id", "created_at")


@query("lnk1_propose_edges", oracle("""SELECT l_partkey AS source, e.id AS target, p AS predicate, least(greatest(c, 0), 1) AS confidence, l_orderkey AS document_id FROM (
    SELECT l_partkey, l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'supports' ELSE 'part_of' END AS p, CASE WHEN l_linenumber = 3 THEN 1.0 ELSE round(l_quantity / 40.0, 3) END AS c, l_suppkey FROM lineitem WHERE l_linenumber <> 4) JOIN ke e ON e.id = l_suppkey"""))
def lnk1(spark, d):
    li = view(spark, d, "lineitem")
    predicate = F.when(F.col("l_linenumber") == 4, "likes").when(F.col("l_linenumber") % 2 == 0, "supports").otherwise("part_of")
    confidence = F.when(F.col("l_linenumber") == 3, '"high"').otherwise(F.round(F.col("l_quantity") / 40.0, 3).cast("string"))
    reply = F.concat(F.lit('{"edges":[{"target":"'), F.col("l_suppkey").cast("string"), F.lit('","predicate":"'), predicate, F.lit('","confidence":'), confidence, F.lit("}]}"))
    replies = li.select(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("document_id"), reply.alias("reply"))
    known = view(spark, d, "ke").select("id", F.col("id").cast("string").alias("name"))
    return K.propose_edges(replies, known)


HEAT = """WITH co AS (SELECT a.document_id AS id, count(DISTINCT b.document_id) AS n FROM kl a JOIN kl b USING (engram_id) JOIN kd r ON r.id = b.document_id AND CAST(r.created_at AS DATE) >= DATE '2001-07-02' WHERE a.document_id <> b.document_id GROUP BY 1),
    ec AS (SELECT document_id AS id, count({distinct}) AS n FROM (SELECT l.document_id, x.id FROM kl l JOIN kx x ON x.source = l.engram_id UNION ALL SELECT l.document_id, x.id FROM kl l JOIN kx x ON x.target = l.engram_id AND x.source <> x.target) GROUP BY 1),
    s AS (SELECT d.id, least(coalesce(co.n, 0), 5) AS co_activity, least(coalesce(ec.n, 0), 10) AS edge_count, least(1.0, 0.40 * exp(-0.03 * {days}) + 0.35 * least(coalesce(co.n, 0) / 5.0::DOUBLE, 1.0) + 0.10 * {revision} + 0.15 * least(coalesce(ec.n, 0) / 10.0::DOUBLE, 1.0)) AS score
      FROM kd d LEFT JOIN co USING (id) LEFT JOIN ec USING (id) WHERE {where})
    SELECT id, co_activity, edge_count, round(score, 6) AS heat_score, CASE WHEN score >= 0.35 THEN 'active' WHEN score >= 0.12 THEN 'reference' ELSE 'dormant' END AS heat_tier FROM s"""
DAYS = "(epoch(TIMESTAMP '2001-08-01 00:00:00') - epoch({c})) / 86400.0::DOUBLE"


@query("heat1_scores", oracle(HEAT.format(distinct="DISTINCT id", days=f"greatest({DAYS.format(c='updated_at')}, 0)", revision="least((revision - 1) / 3.0::DOUBLE, 1.0)", where="NOT (source_type = 'scribble' AND processed = 0 AND tidy_text IS NULL)")))
def heat1(spark, d):
    return rounded(H.heat(view(spark, d, "kd"), view(spark, d, "kl"), view(spark, d, "kx"), AS_OF))


@query("heat1g_scores_created", oracle(HEAT.format(distinct="id", days=DAYS.format(c="created_at"), revision="least(revision, 3) / 3.0::DOUBLE", where="processed > 0")))
def heat1g(spark, d):
    return rounded(H.heat(view(spark, d, "kd"), view(spark, d, "kl"), view(spark, d, "kx"), AS_OF, "created"))


@query("heat2_tiers", "SELECT CASE WHEN v >= 0.35 THEN 'active' WHEN v >= 0.12 THEN 'reference' ELSE 'dormant' END AS tier, count(*) AS n FROM (SELECT value / 100 AS v FROM events) GROUP BY 1")
def heat2(spark, d):
    return view(spark, d, "events").groupBy(H.heat_tier(F.col("value") / 100).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("gph1_stale_articles", oracle("""SELECT e.id, canonical_name, doc_count FROM ke e JOIN (SELECT engram_id, count(*) AS doc_count, max(updated_at) AS newest FROM kl JOIN kd ON kd.id = document_id GROUP BY 1 HAVING count(*) >= 2) n ON n.engram_id = e.id
    WHERE article IS NULL OR article_updated_at IS NULL OR article_updated_at < newest ORDER BY doc_count DESC, e.id LIMIT 5"""))
def gph1(spark, d):
    return H.stale_articles(view(spark, d, "ke"), view(spark, d, "kl"), view(spark, d, "kd"))


@query("gph2_article_documents", oracle("SELECT * FROM (SELECT engram_id, document_id, row_number() OVER (PARTITION BY engram_id ORDER BY created_at DESC, document_id) AS place FROM kl JOIN kd ON kd.id = document_id) WHERE place <= 20"))
def gph2(spark, d):
    return H.article_documents(view(spark, d, "kl"), view(spark, d, "kd"), view(spark, d, "ke"))


ARTICLE_EDGES = """SELECT engram_id, direction, predicate, confidence, canonical_name AS other_name, place FROM (SELECT *, row_number() OVER (PARTITION BY engram_id ORDER BY confidence DESC, edge) AS place FROM (
    SELECT source AS engram_id, 'out' AS direction, predicate, confidence, target AS other, id AS edge FROM kx UNION ALL SELECT target, 'in', predicate, confidence, source, id FROM kx WHERE source <> target)) JOIN ke ON ke.id = other WHERE place <= 30 AND engram_id IN (SELECT id FROM ke)"""


@query("gph2_article_edges", oracle(ARTICLE_EDGES))
def gph2e(spark, d):
    return H.article_edges(view(spark, d, "kx"), view(spark, d, "ke"), view(spark, d, "ke"))


@query("gph3_article_prompts", oracle(f"""SELECT e.id AS engram_id, concat_ws(chr(10) || chr(10), canonical_name, edges, texts) AS prompt FROM ke e JOIN (SELECT engram_id, substring(string_agg(text, chr(10) ORDER BY place), 1, 2000) AS texts FROM
    (SELECT engram_id, text, row_number() OVER (PARTITION BY engram_id ORDER BY created_at DESC, document_id) AS place FROM kl JOIN kd ON kd.id = document_id) WHERE place <= 20 GROUP BY 1) t ON t.engram_id = e.id
    LEFT JOIN (SELECT engram_id, string_agg((CASE direction WHEN 'out' THEN '->' ELSE '<-' END) || ' ' || predicate || ' ' || other_name || ' (' || CAST(CAST(round(confidence * 100) AS INT) AS VARCHAR) || '%)', chr(10) ORDER BY place) AS edges FROM ({ARTICLE_EDGES}) GROUP BY 1) g ON g.engram_id = e.id"""))
def gph3(spark, d):
    ke, kd = view(spark, d, "ke"), view(spark, d, "kd")
    texts = H.article_documents(view(spark, d, "kl"), kd, ke).join(kd.select(F.col("id").alias("document_id"), "text"), "document_id")
    return H.article_prompt(texts.select("engram_id", "place", "text"), H.article_edges(view(spark, d, "kx"), ke, ke), ke)


def flat(df):
    return df.withColumn("engram_ids", F.array_join(F.transform("engram_ids", lambda x: x.cast("string")), ","))


@query("lnt1_orphans", oracle("SELECT 'orphan' AS issue_type, CAST(id AS VARCHAR) AS engram_ids, 'info' AS severity FROM (SELECT c_custkey + 1000 AS id FROM customer WHERE c_custkey + 1000 NOT IN (SELECT source FROM kx) AND c_custkey + 1000 NOT IN (SELECT target FROM kx) ORDER BY id LIMIT 50)"))
def lnt1(spark, d):
    return flat(L.orphans(view(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("id")), view(spark, d, "kx")))


@query("lnt1_orphans_all", oracle("SELECT 'orphan' AS issue_type, CAST(id AS VARCHAR) AS engram_ids, 'info' AS severity FROM (SELECT c_custkey + 1000 AS id FROM customer) WHERE id NOT IN (SELECT source FROM kx) AND id NOT IN (SELECT target FROM kx)"))
def lnt1a(spark, d):
    return flat(L.orphans(view(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("id")), view(spark, d, "kx"), None))


@query("lnt2_contradictions", oracle("""SELECT 'contradiction' AS issue_type, CAST(least(source, target) AS VARCHAR) || ',' || CAST(greatest(source, target) AS VARCHAR) AS engram_ids, 'error' AS severity FROM (SELECT DISTINCT a.source, a.target FROM kx a JOIN kx b
    ON a.source = b.source AND a.target = b.target WHERE a.predicate = 'supports' AND b.predicate = 'contradicts' ORDER BY 1, 2 LIMIT 20)"""))
def lnt2(spark, d):
    return flat(L.contradictions(view(spark, d, "kx")))


@query("lnt3_missing_links", oracle(f"""SELECT 'missing_link' AS issue_type, a || ',' || b AS engram_ids, 'warning' AS severity FROM (SELECT least(id, neighbor) AS a, greatest(id, neighbor) AS b, max(1 - d2 / 2) AS c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbor) AS rank FROM
    (SELECT a.vec_id AS id, b.vec_id AS neighbor, {D2} AS d2 FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id < 50 AND b.vec_id < 200)) WHERE rank <= 2 AND sqrt(d2) <= 1.183 GROUP BY 1, 2)
    WHERE NOT EXISTS (SELECT 1 FROM kx WHERE (source = a AND target = b) OR (source = b AND target = a)) ORDER BY c DESC, a, b LIMIT 20"""))
def lnt3(spark, d):
    return flat(L.missing_links(vecs(spark, d).select("id", "embedding"), view(spark, d, "kx"), most_distance=1.183))


@query("lnt3_missing_links_all", oracle(f"""SELECT 'missing_link' AS issue_type, a || ',' || b AS engram_ids, 'warning' AS severity FROM (SELECT DISTINCT least(id, neighbor) AS a, greatest(id, neighbor) AS b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, neighbor) AS rank FROM
    (SELECT a.vec_id AS id, b.vec_id AS neighbor, {D2} AS d2 FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 2 AND sqrt(d2) <= 1.183)
    WHERE NOT EXISTS (SELECT 1 FROM kx WHERE (source = a AND target = b) OR (source = b AND target = a))"""))
def lnt3a(spark, d):
    return flat(L.missing_links(vecs(spark, d).select("id", "embedding"), view(spark, d, "kx"), None, None, most_distance=1.183, limit=None))


@query("lnt6_duplicate_candidates", oracle("SELECT 'duplicate_candidate' AS issue_type, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS engram_ids, 'warning' AS severity FROM ke GROUP BY canonical_name HAVING count(*) > 1"))
def lnt6(spark, d):
    v = view(spark, d, "embeddings").select(F.col("vec_id").alias("engram_id"), "embedding")
    return flat(L.duplicate_candidates(R.merge_families(view(spark, d, "ke"), v, -1.0)))


@query("lnt4_new_issues", oracle("""SELECT 'contradiction' AS issue_type, CAST(least(source, target) AS VARCHAR) || ',' || CAST(greatest(source, target) AS VARCHAR) AS engram_ids, 'error' AS severity FROM (SELECT source, target FROM kx WHERE predicate IN ('supports', 'contradicts') GROUP BY 1, 2 HAVING count(DISTINCT predicate) = 2)
    WHERE NOT EXISTS (SELECT 1 FROM kissue i WHERE issue_type = 'contradiction' AND NOT resolved AND least(first_id, second_id) = least(source, target) AND greatest(first_id, second_id) = greatest(source, target)) GROUP BY ALL"""))
def lnt4(spark, d):
    stored = view(spark, d, "kissue").withColumn("engram_ids", F.array("first_id", "second_id"))
    return flat(L.new_issues(L.contradictions(view(spark, d, "kx"), None), stored))


@query("lnt5_resolve", oracle("SELECT resolved OR id IN (SELECT min(id) FROM kissue) AS resolved, count(*) AS n FROM kissue GROUP BY 1"))
def lnt5(spark, d):
    issues = view(spark, d, "kissue")
    return L.resolve(issues, [issues.agg(F.min("id")).first()[0]]).groupBy("resolved").agg(F.count(F.lit(1)).alias("n"))


BFS = """WITH x AS (SELECT id, source, target FROM kx), seeds AS (SELECT id AS seed FROM ke WHERE id IN (1, 700)),
    hop1 AS (SELECT seed, source AS node FROM seeds JOIN x ON target = seed UNION SELECT seed, target FROM seeds JOIN x ON source = seed),
    hop2 AS (SELECT seed, source AS node FROM hop1 JOIN x ON target = node UNION SELECT seed, target FROM hop1 JOIN x ON source = node),
    nodes AS (SELECT seed, node, min(hop) AS hop FROM (SELECT seed, seed AS node, 0 AS hop FROM seeds UNION ALL SELECT seed, node, 1 FROM hop1 UNION ALL SELECT seed, node, 2 FROM hop2) GROUP BY 1, 2) """
SEEDS = [(1,), (700,), (-5,)]


@query("bfs1_nodes", oracle(BFS + "SELECT seed, node, CAST(hop AS INT) AS hop FROM nodes"))
def bfs1(spark, d):
    return G.neighbourhood(spark.createDataFrame(SEEDS, "seed long"), view(spark, d, "ke"), view(spark, d, "kx"))[0].select("seed", "node", "hop")


@query("bfs1_edges", oracle(BFS + "SELECT DISTINCT seed, id AS edge FROM nodes JOIN x ON source = node OR target = node WHERE hop <= 1"))
def bfs1e(spark, d):
    return G.neighbourhood(spark.createDataFrame(SEEDS, "seed long"), view(spark, d, "ke"), view(spark, d, "kx"))[1].select("seed", "edge")


def rank_sql(share: str, scale: str, rounds: int = 20) -> str:
    step = "SELECT w.u, 0.15::DOUBLE / (SELECT n FROM nn) + 0.85::DOUBLE * coalesce(s, 0) AS r FROM w LEFT JOIN (SELECT v, sum(r{k}.r * mv.share) AS s FROM r{k} JOIN mv ON mv.u = r{k}.u GROUP BY v) q ON q.v = w.u"
    steps = ", ".join(f"r{k + 1} AS MATERIALIZED ({step.format(k=k)})" for k in range(rounds))
    return f"""WITH x AS (SELECT source AS u, target AS v, confidence AS c FROM kx UNION ALL SELECT target, source, confidence FROM kx),
    w AS MATERIALIZED (SELECT u, sum(c) AS weight, count(*) AS degree FROM x GROUP BY u), mv AS MATERIALIZED (SELECT x.u, x.v, sum({share}) AS share FROM x JOIN w ON w.u = x.u GROUP BY 1, 2), nn AS (SELECT count(*) AS n FROM w),
    r0 AS (SELECT u, 1.0::DOUBLE / (SELECT n FROM nn) AS r FROM w), {steps} SELECT u AS node, round(r / {scale}, 6) AS rank FROM r{rounds}"""


RANKS = rank_sql("c / weight", "(SELECT max(r) FROM r20)")


@query("pr1_page_rank", oracle(RANKS))
def pr1(spark, d):
    return rounded(G.page_rank(view(spark, d, "kx")))


@query("pr1g_page_rank_plain", oracle(rank_sql("c / degree", "1")))
def pr1g(spark, d):
    return rounded(G.page_rank(view(spark, d, "kx"), variant="plain"))


@query("prj2_project_groups", f"WITH {GROUPS} SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM proj")
def prj2(spark, d):
    return rounded(Y.project_groups(vecs(spark, d)))


@query("prj1_project_pca")
def prj1(spark, d):
    return rounded(Y.project_pca(vecs(spark, d)), 4)


@query("prj1_project_neighbours")
def prj1n(spark, d):
    """Not for SQL: gradient steps; tests/test_manifold.py measures which neighbours are kept, against components."""
    return rounded(manifold.project_neighbours(vecs(spark, d)), 2)


EPS = 0.2


@query("clu1_density_clusters", f"""WITH RECURSIVE {GROUPS}, near AS MATERIALIZED (SELECT a.id AS a, b.id AS b, (a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2 AS d2 FROM proj a, proj b WHERE (a.x - b.x)^2 + (a.y - b.y)^2 + (a.z - b.z)^2 <= {EPS * EPS}),
    core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 8), link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
    reach AS (SELECT id AS root, id FROM core UNION SELECT root, b FROM reach JOIN link ON a = reach.id WHERE b > root), least AS (SELECT id, min(root) AS cluster_id FROM (SELECT root, id FROM reach) GROUP BY 1),
    edge AS (SELECT a AS id, arg_min(b, (d2, b)) AS core FROM near WHERE a NOT IN (FROM core) AND b IN (FROM core) GROUP BY 1)
    SELECT p.id, coalesce(l.cluster_id, m.cluster_id) AS cluster_id FROM proj p LEFT JOIN least l ON l.id = p.id LEFT JOIN edge e ON e.id = p.id LEFT JOIN least m ON m.id = e.core""")
def clu1(spark, d):
    return Y.cluster(points(spark, d), 8, EPS)


@query("clu1_cluster_hierarchy")
def clu1h(spark, d):
    """Not for SQL: a spanning tree and a fold over its edges; tests/test_hierarchy.py has a plain one."""
    return hierarchy.cluster_hierarchy(points(spark, d))


@query("clu2_cluster_stats", f"WITH {GROUPS} SELECT cluster_id, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM proj WHERE cluster_id IS NOT NULL GROUP BY 1")
def clu2(spark, d):
    return rounded(Y.cluster_stats(points(spark, d)))


def overviews(spark, d):
    n = F.when(F.col("label") == 2, F.count(F.lit(1)) + 1).otherwise(F.count(F.lit(1)))
    rows = view(spark, d, "embeddings").where("label >= 2").groupBy("label").agg(n.alias("engram_count"))
    return rows.select(F.col("label").cast("long").alias("cluster_id"), F.concat(F.lit("Cluster "), F.col("label").cast("string")).alias("label"), F.lit("about").alias("summary"), "engram_count")


OVERVIEW = "ov AS (SELECT CAST(label AS BIGINT) AS cluster_id, 'Cluster ' || label AS label, 'about' AS summary, count(*) + (CASE WHEN label = 2 THEN 1 ELSE 0 END) AS engram_count FROM embeddings WHERE label >= 2 GROUP BY label)"


@query("clu3_cluster_list", f"WITH {OVERVIEW} SELECT cluster_id, n, ov.label, summary FROM (SELECT CAST(label AS BIGINT) AS cluster_id, count(*) AS n FROM embeddings WHERE label < 9 GROUP BY 1) LEFT JOIN ov USING (cluster_id)")
def clu3(spark, d):
    return Y.cluster_list(Y.cluster_stats(points(spark, d)).select("cluster_id", "n"), overviews(spark, d))


@query("clu4_overview_changes", f"WITH {OVERVIEW} SELECT cluster_id, CASE WHEN n IS NULL THEN 'stale' WHEN engram_count IS NULL OR n <> engram_count THEN 'resynthesize' ELSE 'keep' END AS status FROM (SELECT CAST(label AS BIGINT) AS cluster_id, count(*) AS n FROM embeddings WHERE label < 9 GROUP BY 1) FULL JOIN ov USING (cluster_id)")
def clu4(spark, d):
    return Y.overview_changes(Y.cluster_stats(points(spark, d)), overviews(spark, d))


@query("clu5_cluster_prompts", oracle("""SELECT cluster_id, count(*) AS n, string_agg('- ' || canonical_name || coalesce(': ' || nullif(description, ''), ''), chr(10) ORDER BY place) AS prompt FROM (SELECT CAST(label AS BIGINT) AS cluster_id, canonical_name, description,
    row_number() OVER (PARTITION BY label ORDER BY canonical_name, id) AS place FROM embeddings JOIN ke ON ke.id = vec_id WHERE label < 9) WHERE place <= 50 GROUP BY 1"""))
def clu5(spark, d):
    return Y.cluster_prompt(points(spark, d), view(spark, d, "ke"))


@query("gap1_gaps", f"""WITH {GROUPS}, c AS (SELECT cluster_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM proj WHERE cluster_id IS NOT NULL GROUP BY 1), m AS (SELECT a.cluster_id AS c1, b.cluster_id AS c2, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, (a.z + b.z) / 2 AS z FROM c a JOIN c b ON a.cluster_id < b.cluster_id)
    SELECT c1, c2, round(m.x, 6) AS x, round(m.y, 6) AS y, round(m.z, 6) AS z, round(min(sqrt((p.x - m.x)^2 + (p.y - m.y)^2 + (p.z - m.z)^2)), 6) AS radius FROM m, proj p GROUP BY c1, c2, m.x, m.y, m.z HAVING min(sqrt((p.x - m.x)^2 + (p.y - m.y)^2 + (p.z - m.z)^2)) >= 0.01""")
def gap1(spark, d):
    return rounded(Y.gaps(points(spark, d), 0.01))


def color_sql(c: str) -> str:
    h = f"fmod({c} * 137.508::DOUBLE, 360.0)"
    x = f"0.56::DOUBLE * (1 - abs(fmod({h} / 60, 2.0) - 1))"
    part = lambda six: f"printf('%02x', CAST(floor((list_extract([{', '.join(six)}], CAST(floor({h} / 60) AS INT) + 1) + 0.32::DOUBLE) * 255) AS INT))"
    full, none = "0.56::DOUBLE", "0.0::DOUBLE"
    return f"CASE WHEN {c} IS NULL OR {c} < 0 THEN '#787068' ELSE '#' || {part([full, x, none, none, x, full])} || {part([x, full, full, x, none, none])} || {part([none, none, x, full, full, x])} END"


@query("viz1_graph_nodes", oracle(f"""WITH {GROUPS}, rank AS (SELECT * FROM ({RANKS})) SELECT p.id, canonical_name AS name, round(coalesce(rank, 0), 6) AS rank, coalesce(rank, 0) >= 0.3 AS labelled, {color_sql('cluster_id')} AS color
    FROM proj p JOIN ke ON ke.id = p.id LEFT JOIN rank ON rank.node = p.id"""))
def viz1(spark, d):
    return rounded(Y.graph_nodes(points(spark, d), G.page_rank(view(spark, d, "kx")), view(spark, d, "ke")))


@query("viz1_graph_links", oracle("SELECT id, source, target FROM kx WHERE source IN (SELECT vec_id FROM embeddings) AND target IN (SELECT vec_id FROM embeddings)"))
def viz1l(spark, d):
    return Y.graph_links(points(spark, d), view(spark, d, "kx")).select("id", "source", "target")


@query("viz2_cluster_colors", f"SELECT id, {color_sql('id')} AS color FROM (SELECT p_partkey % 60 - 1 AS id FROM part GROUP BY 1)")
def viz2(spark, d):
    ids = view(spark, d, "part").select((F.col("p_partkey") % 60 - 1).alias("id")).distinct()
    return ids.select("id", Y.cluster_color(F.col("id")).alias("color"))


@query("viz3_bounds", f"WITH {GROUPS}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM proj) SELECT round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz, round((SELECT max(sqrt((x - cx)^2 + (y - cy)^2 + (z - cz)^2)) FROM proj), 6) AS radius FROM c")
def viz3(spark, d):
    return rounded(Y.bounds(points(spark, d))).select(*[(F.col(c) + 0.0).alias(c) for c in ("cx", "cy", "cz")], "radius")


@query("viz4_edge_overlay", oracle("SELECT id, source, target, confidence FROM kx ORDER BY confidence DESC, id LIMIT 5000"))
def viz4(spark, d):
    return Y.top_edges(view(spark, d, "kx")).select("id", "source", "target", "confidence")


@query("viz5_named_points", oracle("SELECT vec_id AS id, canonical_name AS name, CASE WHEN label < 9 THEN CAST(label AS BIGINT) END AS cluster_id FROM embeddings JOIN ke ON ke.id = vec_id"))
def viz5(spark, d):
    return Y.named_points(points(spark, d), view(spark, d, "ke")).select("id", "name", "cluster_id")


@query("viz6_minimap", f"""WITH {GROUPS}, f AS (SELECT id, x + 0.3 * z AS u, y + 0.3 * z AS v FROM proj), b AS (SELECT min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM f)
    SELECT id, round(8 + (u - u0) * least(184 / (u1 - u0), 134 / (v1 - v0)), 4) AS px, round(8 + (v - v0) * least(184 / (u1 - u0), 134 / (v1 - v0)), 4) AS py FROM f, b""")
def viz6(spark, d):
    return rounded(Y.minimap(points(spark, d), 200, 150), 4)


@query("viz7_cluster_overviews", f"WITH {OVERVIEW} SELECT cluster_id, label, engram_count FROM ov ORDER BY cluster_id")
def viz7(spark, d):
    return overviews(spark, d).orderBy("cluster_id").select("cluster_id", "label", "engram_count")
