"""Listings (LST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listing as L
from .registry import query
from .views import oracle, view

AS_OF = "2001-08-01 00:00:00"
DRAFT = "(source_type = 'scribble' AND processed = 0 AND tidy_text IS NULL)"
NAMES = "list_transform(list_sort(list({k})), x -> x)"


def packed(c: str = "engrams"):
    """An array of (id, name) as text, which compares alike everywhere."""
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["id"].cast("string"), x["name"])), ",")


RECENT = """SELECT d.id, d.title, d.created_at, coalesce(n, 0) AS n_engrams, coalesce(names, '') AS engrams
    FROM kd d LEFT JOIN (SELECT document_id, count(*) AS n, string_agg(engram_id || ':' || canonical_name, ',' ORDER BY {order}) AS names
      FROM kl JOIN ke ON ke.id = engram_id GROUP BY document_id) g ON g.document_id = d.id
    WHERE {where}"""


@query("lst1_recent_documents", oracle(RECENT.format(order="engram_id", where=f"CAST(d.created_at AS DATE) >= DATE '2001-07-18' AND NOT {DRAFT}")))
def lst1(spark, d):
    r = L.recent_documents(view(spark, d, "kd"), view(spark, d, "kl"), view(spark, d, "ke"), AS_OF)
    return r.select("id", "title", "created_at", F.size("engrams").cast("long").alias("n_engrams"), packed().alias("engrams"))


@query("lst1g_recent_documents_by_name", oracle(RECENT.format(order="canonical_name, engram_id", where="d.created_at >= TIMESTAMP '2001-07-18 00:00:00'")))
def lst1g(spark, d):
    r = L.recent_documents(view(spark, d, "kd"), view(spark, d, "kl"), view(spark, d, "ke"), AS_OF, drafts=True, by="name", boundary="exact")
    return r.select("id", "title", "created_at", F.size("engrams").cast("long").alias("n_engrams"), packed().alias("engrams"))


@query("lst2_count_documents", oracle(f"SELECT count(*) AS n FROM kd WHERE NOT {DRAFT}"))
def lst2(spark, d):
    return L.counted(view(spark, d, "kd").where(~L.is_draft()))


@query("lst2g_count_documents_processed", oracle("SELECT count(*) AS n FROM kd WHERE processed > 0 OR source_type <> 'scribble'"))
def lst2g(spark, d):
    return L.counted(view(spark, d, "kd").where(~L.is_draft(tidy=False)))


@query("lst3_drafts", oracle(f"SELECT id, title, updated_at FROM kd WHERE {DRAFT} ORDER BY updated_at DESC, id"))
def lst3(spark, d):
    return view(spark, d, "kd").where(L.is_draft()).orderBy(F.desc("updated_at"), "id").select("id", "title", "updated_at")


@query("lst4_document_detail", oracle(RECENT.format(order="engram_id", where="d.id IN (1, 7, 42)")))
def lst4(spark, d):
    r = L.with_concepts(view(spark, d, "kd").where(F.col("id").isin(1, 7, 42)), view(spark, d, "kl"), view(spark, d, "ke"))
    return r.select("id", "title", "created_at", F.size("engrams").cast("long").alias("n_engrams"), packed().alias("engrams"))


RELATED = """SELECT DISTINCT a.document_id AS of_id, d.id, {title} AS title FROM kl a JOIN kl b ON a.engram_id = b.engram_id AND a.document_id <> b.document_id
    JOIN kd d ON d.id = b.document_id WHERE a.document_id IN (1, 7, 42, 100)"""


@query("lst5_related_documents", oracle(RELATED.format(title="coalesce(nullif(tidy_title, ''), title)")))
def lst5(spark, d):
    of = view(spark, d, "kd").where(F.col("id").isin(1, 7, 42, 100)).select(F.col("id").alias("of_id"))
    return L.related_documents(view(spark, d, "kd"), view(spark, d, "kl"), of)


@query("lst5g_related_documents_untitled", oracle(RELATED.format(title="coalesce(nullif(tidy_title, ''), title, 'Untitled')")))
def lst5g(spark, d):
    of = view(spark, d, "kd").where(F.col("id").isin(1, 7, 42, 100)).select(F.col("id").alias("of_id"))
    return L.related_documents(view(spark, d, "kd"), view(spark, d, "kl"), of, "Untitled")


@query("lst6_revisions", "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations ORDER BY conv_id, turn DESC")
def lst6(spark, d):
    return view(spark, d, "conversations").orderBy("conv_id", F.desc("turn")).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("lst7_engram_page", oracle("SELECT id, canonical_name, (SELECT count(*) FROM ke) AS total FROM ke ORDER BY created_at DESC, id LIMIT 50 OFFSET 100"))
def lst7(spark, d):
    ke = view(spark, d, "ke")
    total = L.counted(ke).withColumnRenamed("n", "total")
    return L.page(ke, [F.desc("created_at"), "id"], 50, 100).select("id", "canonical_name").join(total)  # one row of total


@query("lst7g_engram_page_by_name", oracle("SELECT id, canonical_name FROM ke ORDER BY canonical_name, id LIMIT 50 OFFSET 20"))
def lst7g(spark, d):
    return L.page(view(spark, d, "ke"), ["canonical_name", "id"], 50, 20).select("id", "canonical_name")


@query(
    "lst8_engram_detail_edges",
    oracle("""SELECT x.id, s.canonical_name AS source_name, t.canonical_name AS target_name, predicate, confidence FROM (SELECT * FROM kx WHERE source = 6 OR target = 6 ORDER BY confidence DESC, id LIMIT 100) x
    JOIN ke s ON s.id = x.source JOIN ke t ON t.id = x.target"""),
)
def lst8(spark, d):
    from ..operators.search import edges_for

    top = edges_for(view(spark, d, "kx"), 6)
    return L.edge_names(top, view(spark, d, "ke")).select("id", "source_name", "target_name", "predicate", "confidence")


@query("lst9_documents_of_engram", oracle("SELECT id, title FROM kd WHERE id IN (SELECT document_id FROM kl WHERE engram_id = 6)"))
def lst9(spark, d):
    return L.documents_of(view(spark, d, "kl"), view(spark, d, "kd"), 6).select("id", "title")


@query("lst10_stream_page", oracle("SELECT id, title, heat_tier FROM kd WHERE heat_tier = 'active' ORDER BY created_at DESC, id LIMIT 100"))
def lst10(spark, d):
    return L.page(view(spark, d, "kd").where("heat_tier = 'active'"), [F.desc("created_at"), "id"], 100).select("id", "title", "heat_tier")


@query("lst11_feeds", "SELECT s_suppkey AS id, s_name AS name, s_acctbal > 0 AS active FROM supplier WHERE s_acctbal > 0 ORDER BY s_name")
def lst11(spark, d):
    feeds = view(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("active"))
    return feeds.where("active").orderBy("name")


@query("lst12_pending", oracle("SELECT id, created_at FROM kd WHERE processed = 0 AND triaged <> -1 ORDER BY created_at, id LIMIT 50"))
def lst12(spark, d):
    return L.pending(view(spark, d, "kd")).select("id", "created_at")


@query(
    "lst13_tidy_scope",
    oracle("""SELECT 'all' AS scope, count(*) AS n FROM kd UNION ALL SELECT 'missing', count(*) FROM kd WHERE tidy_title IS NULL OR tidy_text IS NULL
    UNION ALL SELECT 'mismatched', count(*) FROM kd WHERE coalesce(tidy_level, '') <> 'full'"""),
)
def lst13(spark, d):
    kd = view(spark, d, "kd")
    parts = [L.counted(L.tidy_scope(kd, s)).select(F.lit(s).alias("scope"), "n") for s in ("all", "missing", "mismatched")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("lst14_open_issues", oracle("SELECT id, issue_type, severity FROM kissue WHERE NOT resolved AND issue_type = 'contradiction' ORDER BY created_at DESC, id LIMIT 100"))
def lst14(spark, d):
    return L.issues(view(spark, d, "kissue"), kind="contradiction").select("id", "issue_type", "severity")


COMPANION = """SELECT *, CASE WHEN n_error > 0 THEN 'distressed' WHEN n_warning > 0 THEN 'uneasy' WHEN n_info > 0 THEN 'curious' ELSE 'content' END AS mood,
    CASE WHEN engrams = 0 THEN 'seed' WHEN engrams <= 10 THEN 'sprout' WHEN engrams <= 50 THEN 'sapling' WHEN engrams <= 200 THEN 'tree' ELSE 'forest' END AS stage
    FROM (SELECT (SELECT count(*) FROM kd) AS documents, (SELECT count(*) FROM ke) AS engrams, (SELECT count(*) FROM kx) AS edges,
      count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info
      FROM kissue WHERE NOT resolved)"""


@query("lst15_companion", oracle(COMPANION))
def lst15(spark, d):
    return L.companion(view(spark, d, "kd"), view(spark, d, "ke"), view(spark, d, "kx"), view(spark, d, "kissue"))


@query("lst16_next_milestone", oracle("SELECT 'hundred_engrams' AS milestone, count(*) AS n FROM ke HAVING count(*) >= 100"))
def lst16(spark, d):
    totals = L.companion(view(spark, d, "kd"), view(spark, d, "ke"), view(spark, d, "kx"), view(spark, d, "kissue"))
    return L.next_milestone(totals, spark.createDataFrame([("first_document",), ("ten_documents",)], "milestone string"))


@query(
    "lst17_time_ago",
    """SELECT event_id, CASE WHEN s < 60 THEN floor(s)::BIGINT::VARCHAR || 's' WHEN s < 3600 THEN floor(s / 60.0)::BIGINT::VARCHAR || 'm' WHEN s < 86400 THEN floor(s / 3600.0)::BIGINT::VARCHAR || 'h'
    ELSE floor(s / 86400.0)::BIGINT::VARCHAR || 'd' END AS ago FROM (SELECT event_id, epoch(TIMESTAMP '2024-01-03 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events WHERE ts <= TIMESTAMP '2024-01-03 00:00:00')""",
)
def lst17(spark, d):
    e = view(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("ts <= TIMESTAMP '2024-01-03 00:00:00'")
    return e.select("event_id", L.time_ago(F.col("ts"), "2024-01-03 00:00:00").alias("ago"))


@query(
    "lst18_processing_status",
    """SELECT event_id, CASE WHEN coalesce(event_type = 'error', false) OR coalesce(CAST(json_extract(props, '$.k') AS INT), 0) % 10 > 7 THEN 'partial' ELSE 'completed' END AS status FROM events""",
)
def lst18(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = view(spark, d, "events")
    return e.select("event_id", L.processing_status(F.col("event_type") == "error", F.greatest(k % 10 - 7, F.lit(0))).alias("status"))
