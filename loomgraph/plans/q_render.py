"""Long documents put together from what a model says of their chunks (TXT12-16, 19, 21-28), and replies (EMB3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import artifacts as A
from ..functions import replies as J
from ..functions import text as X
from .q_text import LINES, WORDY
from .registry import query
from .views import view

LEVEL = "structured_notes"


@query("emb3_json_object", "SELECT event_id, CAST(CASE WHEN event_id % 6 = 5 THEN NULL ELSE json_extract(props, '$.k') END AS BIGINT) AS k, event_id % 6 = 3 AS listed FROM events")
def emb3(spark, d):
    n, props = F.col("event_id") % 6, F.col("props")
    reply = (
        F.when(n == 0, props)
        .when(n == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(n == 2, F.concat(F.lit("Here {you} are: "), props, F.lit(" Yours, [the model]")))
        .when(n == 3, F.concat(F.lit("["), props, F.lit("]")))
        .when(n == 4, F.concat(F.lit("  \n{broken "), props))
        .otherwise(F.lit("nothing {to see"))
    )
    o = J.json_object(reply)
    rows = view(spark, d, "events").select("event_id", o.alias("o"))
    items = F.get_json_object("o", "$.items[0].k")
    return rows.select("event_id", F.coalesce(F.get_json_object("o", "$.k"), items).cast("long").alias("k"), F.coalesce(items.isNotNull(), F.lit(False)).alias("listed"))


def lined(spark, d):
    """Documents with their lines and a reply that repeats them."""
    found = X.lines(F.col("text"))
    return view(spark, d, "documents").where("trim(text) <> ''").select("doc_id", "text", found.alias("found"), F.to_json(F.struct(found.alias("evidence_lines"))).alias("reply"))


FIRSTS = f"(SELECT doc_id, x, k, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM ({LINES})) WHERE rn = 1)"


@query("txt22_evidence_lines", f"SELECT doc_id, string_agg(x, chr(10) ORDER BY place) AS lines FROM {FIRSTS} WHERE place <= 12 GROUP BY 1")
def txt22(spark, d):
    summary = F.to_json(F.struct(F.lit("none").alias("evidence_lines"), F.col("text").alias("chunk_summary")))
    reply = F.when(F.col("doc_id") % 2 == 0, F.col("reply")).otherwise(summary)
    return lined(spark, d).select("doc_id", F.array_join(A.evidence_lines(reply), "\n").alias("lines"))


HEADING = r"(starts_with(x, '#') OR (regexp_matches(x, '^\d+(?:\.\d+)*(?:\s+|$)') AND NOT regexp_matches(x, '^\d+[.)]\s+')) OR (upper(x) = x AND lower(x) <> x AND length(x) <= 120 AND len(regexp_split_to_array(x, '\s+')) <= 12))"
CAPTION = r"(regexp_matches(x, '(?i)^(?:figure|table)\s+\d+[.:]?\s+') OR regexp_matches(x, '^\[\d+\]') OR starts_with(lower(x), 'doi:'))"
QUOTE = "regexp_matches(x, '[\"“”''‘’]')"
AFFILIATION = "(contains(lower(x), '@') OR " + " OR ".join(f"contains(lower(x), '{m}')" for m in X.AFFILIATIONS) + ")"
KEPT = f"(len(regexp_extract_all(x, '{X.NUMBER}')) + len(regexp_extract_all({WORDY.replace('text', 'x')}, '{X.ACRONYM}')))"
TOPIC = rf"(NOT {AFFILIATION} AND length(x) BETWEEN 40 AND 260 AND len(regexp_extract_all(x, '{X.TOPIC_WORD}')) >= 4 AND len(regexp_extract_all(x, '{X.CITATION}')) < 2 AND (length(x) - length(regexp_replace(x, '\p{{L}}', '', 'g'))) / nullif(CAST(length(x) - length(regexp_replace(x, '[\p{{L}}\p{{N}}]', '', 'g')) AS DOUBLE), 0) >= 0.6)"
CLASSES = f"""(SELECT *, place = min(CASE WHEN place <= 2 AND plain THEN place END) OVER (PARTITION BY doc_id) AS top FROM (SELECT doc_id, x, place, NOT {AFFILIATION} AND NOT {HEADING} AND NOT {CAPTION} AND length(x) <= 180 AS plain,
    CASE WHEN {HEADING} THEN 'heading' WHEN {QUOTE} THEN 'quote' WHEN {CAPTION} OR {KEPT} >= 2 THEN 'numeric' WHEN {TOPIC} THEN 'topic' ELSE 'support' END AS kind FROM {FIRSTS}))"""


def chunk_sql(size: int, overlap: int, docs: str = "documents") -> str:
    """Chunks by recursion: the end of one from the last mark of the best kind in its window, the start of the next from the
    word after the overlap."""
    reach = min(600, max(80, size // 3))
    low, window = f"greatest(start + 1, start + {size} - {reach})", f"substring(text, greatest(start + 1, start + {size} - {reach}) + 1, start + {size} - greatest(start + 1, start + {size} - {reach}))"
    ends = " ".join(
        f"WHEN contains({window}, {lit}) THEN {low} + length(regexp_extract({window}, '(?s)^(.*){pattern}', 1)) + {keep}"
        for lit, pattern, keep in (("chr(10) || chr(10)", "\\n\\n", 0), ("chr(10)", "\\n", 0), *((f"'{c} '", ("\\" if c in ".?" else "") + c + " ", 1) for c in ".?!;:,"), ("' '", " ", 0))
    )
    end = f"CASE WHEN start + {size} >= length(text) THEN length(text) {ends} ELSE start + {size} END"
    back = f"greatest(stop - {overlap}, start + 1)"
    blank = r"[\s]"
    rest = f"substring(text, {back} + 1)"
    lead = f"(CASE WHEN regexp_matches(substring(text, {back}, 1), '{blank}') THEN 0 ELSE least(120, length(regexp_extract({rest}, '^\\S*', 0))) END)"
    word = f"({back} + {lead} + length(regexp_extract(substring(text, {back} + {lead} + 1), '^\\s*', 0)))"
    return f"""WITH RECURSIVE c AS (SELECT doc_id, text, start, CAST({end} AS BIGINT) AS stop, 0 AS n FROM (SELECT doc_id, text, CAST(0 AS BIGINT) AS start FROM {docs} WHERE text IS NOT NULL)
      UNION ALL SELECT doc_id, text, start, CAST({end} AS BIGINT), n + 1 FROM (SELECT doc_id, text, CAST(CASE WHEN {word} < stop THEN {word} ELSE {back} END AS BIGINT) AS start, n FROM c WHERE stop < length(text) AND length(text) > {size})),
      p AS (SELECT doc_id, n, CASE WHEN length(text) <= {size} THEN text ELSE trim(substring(text, start + 1, stop - start), ' ' || chr(9) || chr(10) || chr(13)) END AS chunk FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS place, chunk FROM p WHERE chunk <> '' OR n = 0"""


@query("txt4_chunks", chunk_sql(4000, 200))
def txt4(spark, d):
    return view(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("place", "chunk"))


SPLIT = r"string_split(regexp_replace({0}, '([.!?])\s+([A-Z0-9“\"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query("txt9_sentences", f"SELECT doc_id, unnest(range(len(l)))::INT AS place, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform({SPLIT.format('text')}, lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)")
def txt9(spark, d):
    return view(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("place", "sentence"))


PIECES = f"""(SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS place, trim(regexp_replace(regexp_replace(trim(x), '^(?:#{{1,6}}\\s+|[-*+]\\s+)', ''), '\\s+', ' ', 'g')) AS k FROM (SELECT doc_id, i, unnest(l) AS x, unnest(range(len(l))) AS j FROM (SELECT doc_id, i, CASE WHEN {HEADING} OR {CAPTION} THEN [x] ELSE list_filter(list_transform({SPLIT.format('x')}, lambda y: trim(y)), lambda y: y <> '') END AS l
    FROM (SELECT doc_id, trim(b) AS x, i FROM (SELECT doc_id, unnest(b) AS b, unnest(range(len(b))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\n{{2,}}') AS b FROM documents))) WHERE x <> '')))"""


@query("txt10_preservation_lines", f"""SELECT doc_id, coalesce(lines, '') AS lines FROM documents LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY n) AS lines FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY q DESC, place) AS n FROM
    (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY q DESC, place) AS rn FROM (SELECT *, {QUOTE} AS q FROM {PIECES} WHERE length(x) <= 240 AND NOT {HEADING} AND NOT {CAPTION}) WHERE q OR {KEPT} >= 2) WHERE rn = 1 AND k <> '') WHERE n <= 8 GROUP BY 1) USING (doc_id)""")
def txt10(spark, d):
    return view(spark, d, "documents").select("doc_id", F.array_join(X.preservation_lines(F.col("text")), "\n").alias("lines"))


SCORED = f"""(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -score, i) AS rk, count(*) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, x, i, {HEADING} AS h, {QUOTE} AS q, {KEPT} AS n,
    CASE WHEN i = 0 THEN 25 ELSE 0 END + CASE WHEN {HEADING} THEN 100 ELSE 0 END + CASE WHEN {CAPTION} THEN 80 ELSE 0 END + CASE WHEN {QUOTE} THEN 45 ELSE 0 END + CASE WHEN {KEPT} > 0 THEN 35 + least(60, 12 * {KEPT}) ELSE 0 END
      + CASE WHEN regexp_matches({WORDY.replace('text', 'x')}, '\\b[A-Z]{{2,}}\\b') THEN 15 ELSE 0 END + CASE WHEN length(x) BETWEEN 40 AND 180 THEN 10 ELSE 0 END AS score FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i FROM ({LINES}))))"""


@query("txt11_trimmed_evidence", f"""WITH s AS MATERIALIZED (FROM {SCORED}), a AS (SELECT doc_id, min(rk) FILTER (h) AS h FROM s GROUP BY 1), b AS (SELECT s.doc_id, any_value(a.h) AS h, min(rk) FILTER (q AND rk IS DISTINCT FROM a.h) AS q FROM s JOIN a USING (doc_id) GROUP BY 1),
    c AS (SELECT s.doc_id, any_value(b.h) AS h, any_value(b.q) AS q, min(rk) FILTER (n >= 2 AND rk IS DISTINCT FROM b.h AND rk IS DISTINCT FROM b.q) AS k FROM s JOIN b USING (doc_id) GROUP BY 1),
    o AS (SELECT s.doc_id, x, i, total, row_number() OVER (PARTITION BY s.doc_id ORDER BY CASE WHEN rk = c.h THEN 0 WHEN rk = c.q THEN 1 WHEN rk = c.k THEN 2 ELSE 3 END, rk) AS turn FROM s JOIN c USING (doc_id))
    SELECT doc_id, coalesce(lines, '') AS lines FROM documents LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS lines FROM o WHERE total <= 6 OR turn <= 6 GROUP BY 1) USING (doc_id)""")
def txt11(spark, d):
    return view(spark, d, "documents").select("doc_id", F.array_join(X.trim_evidence(X.lines(F.col("text")), 6), "\n").alias("lines"))


@query(
    "txt12_classified_lines",
    f"""SELECT doc_id, kind, lines FROM (SELECT doc_id, kind, string_agg(x, chr(10) ORDER BY place) AS lines FROM (SELECT doc_id, CASE WHEN top THEN 'title' ELSE kind END AS kind, x, place, row_number() OVER (PARTITION BY doc_id, CASE WHEN top THEN 'title' ELSE kind END ORDER BY place) AS n FROM {CLASSES})
    WHERE n <= CASE kind WHEN 'title' THEN 1 WHEN 'heading' THEN 1 WHEN 'topic' THEN 2 WHEN 'quote' THEN 2 WHEN 'numeric' THEN 2 ELSE 1 END GROUP BY 1, 2)""",
)
def txt12(spark, d):
    rows = lined(spark, d).select("doc_id", A.classify(A.distinct(F.col("found")), LEVEL).alias("a"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.array_join(F.col("a")[k], "\n").alias("lines"), F.size(F.col("a")[k]).alias("n")) for k in A.KINDS]))
    return rows.select("doc_id", kinds.alias("r")).where("r.n > 0").select("doc_id", "r.kind", "r.lines")


def artifacts(spark, d, level=LEVEL):
    """(doc_id, artifacts): those of each document's chunks, from replies that repeat a chunk's lines."""
    chunks = view(spark, d, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 1500, 100)).alias("place", "chunk"))
    reply = F.to_json(F.struct(X.lines(F.col("chunk")).alias("evidence_lines")))
    made = chunks.select("doc_id", "place", A.artifact(reply, F.col("chunk"), level).alias("a"))
    return made.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "a"))).alias("rows")).select("doc_id", F.col("rows.a").alias("artifacts"))


def titled(spark, d, level=LEVEL):
    return artifacts(spark, d, level).withColumn("title", A.document_title(F.col("artifacts"), F.array(F.lit("abc"), F.lit("An entity"))))


OF_CHUNKS = lambda sql: sql.replace("FROM documents", "FROM ch")
CAPS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in zip(A.KINDS, A.STRATEGIES[LEVEL]["caps"])) + " END"
RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(A.KINDS)) + " END"
CLASSED = lambda lines: f"SELECT doc_id, kind, x, place FROM (SELECT doc_id, kind, x, place, row_number() OVER (PARTITION BY doc_id, kind ORDER BY place) AS n FROM (SELECT doc_id, CASE WHEN top THEN 'title' ELSE kind END AS kind, x, place FROM {CLASSES.replace(FIRSTS, lines)})) WHERE n <= {CAPS}"
LINE_KEY = r"trim(regexp_replace(regexp_replace(trim(x), '^(?:#{1,6}\s+|[-*+]\s+)', ''), '\s+', ' ', 'g'))"
#: Each chunk as a document of its own, classified; lacking quotes or numbers, what those lines and three more give stands in
#: for the kinds that are empty.
ARTIFACTS = f"""WITH ch AS MATERIALIZED (SELECT doc_id * 100000 + place AS doc_id, chunk AS text FROM ({chunk_sql(1500, 100)})),
    f1 AS MATERIALIZED (FROM {OF_CHUNKS(FIRSTS)}), a AS MATERIALIZED ({CLASSED('f1')}),
    kept AS (SELECT doc_id, x, n FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY q DESC, place) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY q DESC, place) AS rn FROM (SELECT *, {QUOTE} AS q FROM {OF_CHUNKS(PIECES)}
      WHERE length(x) <= 240 AND NOT {HEADING} AND NOT {CAPTION}) WHERE q OR {KEPT} >= 2) WHERE rn = 1 AND k <> '') WHERE n <= 3),
    pooled AS (SELECT doc_id, x, {LINE_KEY} AS k, o FROM (SELECT doc_id, x, {RANK} * 1000000 + place AS o FROM a UNION ALL SELECT doc_id, x, 100000000 + n FROM kept)),
    f2 AS MATERIALIZED (SELECT doc_id, x, k, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY o) AS rn FROM pooled) WHERE rn = 1 AND k <> ''),
    b AS MATERIALIZED ({CLASSED('f2')}), whole AS (SELECT doc_id FROM a WHERE kind IN ('quote', 'numeric') GROUP BY 1 HAVING count(DISTINCT kind) = 2),
    art AS MATERIALIZED (SELECT * FROM a UNION ALL SELECT b.* FROM b WHERE doc_id NOT IN (FROM whole) AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = b.doc_id AND a.kind = b.kind))"""


@query("txt24_artifacts", f"""{ARTIFACTS} SELECT CAST(floor(ch.doc_id / 100000) AS BIGINT) AS doc_id, CAST(ch.doc_id % 100000 AS INT) AS chunk, """
    + ", ".join(f"coalesce(string_agg(x, chr(10) ORDER BY place) FILTER (kind = '{k}'), '') AS {k}" for k in A.KINDS) + " FROM ch LEFT JOIN art ON art.doc_id = ch.doc_id GROUP BY ch.doc_id")
def txt24(spark, d):
    rows = artifacts(spark, d).select("doc_id", F.posexplode("artifacts").alias("chunk", "a"))
    return rows.select("doc_id", "chunk", *[F.array_join(F.col("a")[k], "\n").alias(k) for k in A.KINDS])


NOISE = "(trim(x) = '' OR " + AFFILIATION + " OR " + " OR ".join(f"starts_with(lower(trim(x)), '{m}')" for m in A.FRONTMATTER) + r" OR (starts_with(lower(trim(x)), 'doi:') AND len(regexp_split_to_array(trim(x), '\s+')) <= 6))"
BARE_LINE = r"trim(regexp_replace(x, '^(?:#{1,6}\s+|[-*+]\s+|\d+\.\s+)', ''))"


@query("txt25_titles", rf"""{ARTIFACTS}, l AS (SELECT CAST(floor(doc_id / 100000) AS BIGINT) AS d, kind, x, (doc_id % 100000) * 100000000 + {RANK} * 1000000 + place AS o FROM art WHERE NOT {NOISE}),
    t AS (SELECT d, x, o, kind = 'title' AS head, bool_or(kind = 'title') OVER (PARTITION BY d) AS has FROM l),
    g AS (SELECT d, c, o, h FROM (SELECT d, o, x, {BARE_LINE} AS c, {HEADING} AS h FROM t WHERE head OR NOT has) WHERE c <> '' AND NOT regexp_matches(c, '(?i)^(?:\d|figure\b|table\b|doi:)') AND NOT {AFFILIATION.replace('(x)', '(c)')}),
    f AS (SELECT d, arg_min(c, o) AS c, bool_or(h) AS h FROM g GROUP BY 1)
    SELECT doc_id, CASE WHEN coalesce(h, false) THEN CASE WHEN length(c) > 120 THEN rtrim(substring(c, 1, 117)) || '...' ELSE c END ELSE 'An entity' END AS title FROM documents LEFT JOIN f ON f.d = doc_id WHERE text IS NOT NULL""")
def txt25(spark, d):
    return titled(spark, d).select("doc_id", "title")


@query("txt13_render_plan")
def txt13(spark, d):
    rows = titled(spark, d).select("doc_id", F.explode(A.plan(F.col("artifacts"), F.col("title"), LEVEL)).alias("c"))
    return rows.select("doc_id", "c.chunk", *[F.size(F.col("c")[k]).alias(k) for k in A.BODY], "c.fault")


@query("txt14_rendered")
def txt14(spark, d):
    plan = A.plan(F.col("artifacts"), F.col("title"), LEVEL)
    return titled(spark, d).select("doc_id", A.render(plan, F.col("title"), LEVEL).alias("text"))


@query("txt14_stitched")
def txt14s(spark, d):
    return lined(spark, d).select("doc_id", A.stitched(A.distinct(F.col("found")), LEVEL).alias("text"))


@query("txt14_fallback", rf"""SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(substring(t, 1, 117)) || '...' END AS title, list FROM (SELECT doc_id, arg_min(trim(regexp_replace(x, '^(?:#{{1,6}}\s+|[-*+]\s+|\d+\.\s+)', '')), place) FILTER (trim(regexp_replace(x, '^(?:#{{1,6}}\s+|[-*+]\s+|\d+\.\s+)', '')) <> '') AS t,
    string_agg(CASE WHEN regexp_matches(x, '^(?:#{{1,6}}\s+|[-*+]\s+|\d+\.\s+|>\s+)') THEN x ELSE '- ' || x END, chr(10) ORDER BY place) AS list FROM {FIRSTS} GROUP BY 1)""")
def txt14f(spark, d):
    found = A.distinct(F.col("found"))
    return lined(spark, d).select("doc_id", A.fallback_title(found).alias("title"), A.listed(found).alias("list"))


@query("txt15_compressed")
def txt15(spark, d):
    lists = F.transform(F.col("artifacts"), lambda a: A.flat(a))
    return artifacts(spark, d).select("doc_id", F.array_join(A.compressed(lists, 400), "\n").alias("lines"))


FAULTS = (
    ("kept", "Alpha beta gamma grows. He said “so it is” in 1984.", None),
    ("blank", "  ", "empty_polished_block"),
    ("span", "Alpha beta gamma grows in 1984.", "missing_quote_span"),
    ("number", "Alpha beta gamma grows. He said “so it is”.", "missing_numeric_token"),
    ("added", "Alpha beta gamma grows. He said “so it is” in 1984 and 1985.", "added_numeric_token"),
    ("topic", "Alp bet gam grows. He said “so it is” in 1984.", "missing_topic_anchor"),
    ("heading", "# Alpha beta gamma\nHe said “so it is” in 1984.", "unexpected_heading"),
)


@query("txt16_polish_faults", "SELECT p_partkey AS id, CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN {repr(f[2]) if f[2] else 'NULL'}" for k, f in enumerate(FAULTS)) + " END AS fault FROM part")
def txt16(spark, d):
    one = lambda x: F.array(F.lit(x))
    block = F.element_at(F.array(*[F.lit(f[1]) for f in FAULTS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    fault = A.polish_fault(block, one("alpha beta gamma"), one("He said “so it is”"), one("In 1984."), A.none(), LEVEL)
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), fault.alias("fault"))


@query("txt19_entities", "SELECT p_partkey AS id, p_name AS name, p_type AS description FROM part WHERE p_partkey % 5 <> 4")
def txt19(spark, d):
    one = F.struct(F.concat(F.lit("  "), "p_name").alias("name"), F.concat("p_type", F.lit(" ")).alias("description"))
    rows = F.array(one, F.struct(F.lit(" ").alias("name"), F.lit("x").alias("description")))
    n = F.col("p_partkey") % 5
    reply = F.when(n == 4, F.lit('{"entities": "none"}')).when(n % 2 == 0, F.to_json(F.struct(rows.alias("entities")))).otherwise(F.concat(F.lit("Sure:\n"), F.to_json(rows)))
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(A.entities(J.json_object(reply))).alias("e")).select("id", "e.*")


def two():
    """Two chunks of a document's lines, which overlap."""
    return F.array(F.slice("found", 1, 5), F.slice("found", 4, 6))


@query("txt21_payload", f"SELECT doc_id, CAST(20 + sum(length(x) + 2 + length(x) - length(replace(replace(x, '\"', ''), '\\', ''))) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM {FIRSTS} WHERE NOT contains(x, chr(9)) GROUP BY 1".replace("CAST(20", "CAST(length('{\"evidence_lines\": []}')"))
def txt21(spark, d):
    found = F.filter(A.distinct(F.col("found")), lambda x: ~F.contains(x, F.lit("\t")))
    return lined(spark, d).where(F.size(found) > 0).select("doc_id", F.length(A.payload(found)).cast("long").alias("chars"))


OVER = LINES.replace("SELECT doc_id, i, trim(x) AS x", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, trim(x) AS x")


@query("txt26_merged_evidence", f"SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM ({OVER}) WHERE i <= 9) WHERE rn = 1 GROUP BY 1")
def txt26(spark, d):
    return lined(spark, d).select("doc_id", F.array_join(A.distinct(F.flatten(two())), "\n").alias("lines"))


@query("txt27_summary_inputs", f"SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'said' ELSE string_agg(x, chr(10) ORDER BY i) FILTER (i IN (1, 2, 4, 5)) END AS inputs FROM ({OVER}) GROUP BY 1")
def txt27(spark, d):
    said = F.when(F.col("doc_id") % 2 == 1, F.array(F.lit(""), F.lit("said"))).otherwise(F.array(F.lit(None).cast("string"), F.lit("")))
    return lined(spark, d).select("doc_id", F.array_join(A.summary_inputs(said, two()), "\n").alias("inputs"))


@query("txt28_grounded_merge", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN arg_min('- ' || k, i) ELSE string_agg(x, chr(10) ORDER BY i) FILTER (rn = 1) END AS lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM ({OVER}) WHERE i <= 9) GROUP BY 1")
def txt28(spark, d):
    first = F.concat(F.lit("- "), X.line_key(F.get("found", F.lit(0))))
    said = F.when(F.col("doc_id") % 2 == 0, F.array(first)).otherwise(F.array(first, F.lit("never said before")))
    return lined(spark, d).select("doc_id", F.array_join(A.merged(said, two()), "\n").alias("lines"))


#: Texts of fewer than four lines, and their evidence: pieces of 1,200 characters, the first of each key.
FEW = f"(SELECT doc_id, text FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM ({LINES}) GROUP BY 1 HAVING count(*) >= 4))"
CUT = rf"""(SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM
    (SELECT doc_id, place AS i, chunk AS x, regexp_replace(regexp_replace(trim(chunk), '^(?:#{{1,6}}\s+|[-*+]\s+)', ''), '\s+', ' ', 'g') AS k FROM ({chunk_sql(1200, 0, FEW)})) WHERE regexp_matches(x, '\S')) WHERE rn = 1)"""


@query("txt23_fallback_evidence", f"""SELECT doc_id, coalesce(lines, '') AS lines FROM documents LEFT JOIN (SELECT doc_id, string_agg(x, chr(10) ORDER BY place) AS lines FROM
    (SELECT doc_id, x, place FROM {FIRSTS} WHERE doc_id NOT IN (SELECT doc_id FROM {FEW}) UNION ALL SELECT * FROM {CUT}) WHERE place <= 80 GROUP BY 1) USING (doc_id) WHERE trim(text) <> ''""")
def txt23(spark, d):
    return lined(spark, d).select("doc_id", F.array_join(X.fallback_evidence(F.col("text")), "\n").alias("lines"))
