"""Text, evaluation, sources and streams (TXT, EVL, SRC, STR, PIP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evals as V
from .registry import query
from .views import oracle, view


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("txt1_strip_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM pages")
def txt1(spark, d):
    return view(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("txt2_html_title", "SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>') THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) END AS title FROM pages")
def txt2(spark, d):
    return view(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"))


VIDEO = "concat('https://', CASE page_id % 4 WHEN 0 THEN 'youtu.be/a' WHEN 1 THEN 'www.youtube.com/watch?x=1&v=b' WHEN 2 THEN 'm.youtube.com/embed/c' ELSE 'example.com/v/d' END, CAST(page_id AS STRING), '?t=3')"


@query("txt5_video_id", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' || page_id WHEN 1 THEN 'b' || page_id || '?t=3' WHEN 2 THEN 'c' || page_id END AS video FROM pages")
def txt5(spark, d):
    return view(spark, d, "pages").select("page_id", X.video_id(F.expr(VIDEO)).alias("video"))


COUNT = "length(text) - length(regexp_replace(text, '{p}', '', 'g'))"


@query(
    "txt6_token_estimate",
    f"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE greatest(1, CAST(ceil(({COUNT.format(p='[A-Za-z0-9]')}) / 4.0) + ceil(({COUNT.format(p='[가-힣]')}) / 2.0) + ceil(({COUNT.format(p=chr(92) + 'x')}) / 2.0) AS BIGINT)) END AS tokens FROM documents""".replace(
        "\\x", r"[^\p{L}\p{M}\p{N}\p{Pc}\s]"
    ),
)
def txt6(spark, d):
    return view(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


LINES = r"SELECT doc_id, i, trim(x) AS x, regexp_replace(regexp_replace(trim(x), '^(?:#{1,6}\s+|[-*+]\s+)', ''), '\s+', ' ', 'g') AS k FROM (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(x) <> ''"


@query("txt7_distinct_lines", f"SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rn FROM ({LINES})) WHERE rn = 1 GROUP BY 1")
def txt7(spark, d):
    docs = view(spark, d, "documents").where("trim(text) <> ''")
    return docs.select("doc_id", F.array_join(X.distinct_lines(X.lines(F.col("text"))), "\n").alias("lines"))


@query(
    "txt8_line_classes",
    rf"""SELECT doc_id, i AS place, regexp_matches(x, '^(?:#{{1,6}}\s+|[-*+]\s+|\d+[.)]\s+|>\s+)') AS structural, regexp_matches(x, '["“”''‘’]') AS quote, regexp_matches(x, '(?i)^(?:figure|table)\s+\d+[.:]?\s+') OR regexp_matches(x, '^\[\d+\]') OR starts_with(lower(x), 'doi:') AS caption,
    contains(lower(x), '@') OR regexp_matches(lower(x), 'university|institute|department|school of|hospital|centre|center|faculty|college|st |road|avenue|street|email') AS affiliation,
    CAST(len(regexp_extract_all(x, '[0-9][0-9,./:-]*(?:%|st|nd|rd|th)?')) AS INT) AS numbers FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i, x FROM ({LINES}))""",
)
def txt8(spark, d):
    rows = view(spark, d, "documents").select("doc_id", F.posexplode(X.lines(F.col("text"))).alias("place", "x"))
    x = F.col("x")
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), X.is_structural(x).alias("structural"), X.is_quote(x).alias("quote"), X.is_caption(x).alias("caption"), X.is_affiliation(x).alias("affiliation"), F.size(X.numeric_tokens(x)).alias("numbers"))


@query("txt17_grounded", rf"SELECT doc_id, doc_id % 5 <> 0 AS grounded FROM documents WHERE trim(text) <> ''")
def txt17(spark, d):
    docs = view(spark, d, "documents").where("trim(text) <> ''")
    out = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nnever said before"))).otherwise(F.concat(F.lit("# "), F.col("text")))
    return docs.select("doc_id", X.grounded(out, F.col("text")).alias("grounded"))


@query("txt18_strategy", "SELECT CASE WHEN length(text) < 8000 THEN 'single' ELSE 'map_reduce' END AS strategy, count(*) AS n FROM documents GROUP BY 1")
def txt18(spark, d):
    return view(spark, d, "documents").groupBy(X.strategy(F.col("text")).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query("txt20_extraction_text", oracle("SELECT id, CASE WHEN source_type <> 'scribble' AND trim(annotation) <> '' THEN text || chr(10) || chr(10) || '[annotation]' || chr(10) || trim(annotation) ELSE text END AS text FROM kd"))
def txt20(spark, d):
    return view(spark, d, "kd").select("id", X.extraction_text(F.col("text"), F.col("annotation"), F.col("source_type")).alias("text"))


@query("txt29_prompt_text", "SELECT doc_id, length(CASE WHEN length(text) > 3000 THEN substring(text, 1, 3000) || chr(10) || '[truncated]' ELSE text END)::BIGINT AS n FROM documents")
def txt29(spark, d):
    return view(spark, d, "documents").select("doc_id", F.length(X.prompt_text(F.col("text"), 3000)).cast("long").alias("n"))


@query("pip1_tidy_level", oracle("SELECT id, CASE WHEN mime_type = 'application/pdf' AND tidy_level = 'full' THEN 'light_cleanup' ELSE tidy_level END AS level FROM kd"))
def pip1(spark, d):
    return view(spark, d, "kd").select("id", X.tidy_level(F.col("mime_type"), F.col("tidy_level")).alias("level"))


@query("evl2_script_counts", f"SELECT doc_id, CAST({COUNT.format(p='[가-힣]')} AS INT) AS hangul, CAST({COUNT.format(p='[A-Za-z]')} AS INT) AS latin FROM documents")
def evl2(spark, d):
    s = V.script_counts(F.col("text"))
    return view(spark, d, "documents").select("doc_id", s["hangul"].alias("hangul"), s["latin"].alias("latin"))


NOVEL = rf"SELECT a.doc_id, list_filter(regexp_extract_all(lower(a.text), '{V.WORD.replace(chr(39), chr(39) * 2)}'), lambda w: NOT list_contains([{', '.join(repr(w) for w in V.STOPWORDS)}], w)) AS o, list_filter(regexp_extract_all(lower(b.text), '{V.WORD.replace(chr(39), chr(39) * 2)}'), lambda w: NOT list_contains([{', '.join(repr(w) for w in V.STOPWORDS)}], w)) AS s FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"


@query("evl5_novel_ratio", f"SELECT doc_id, round(len(list_filter(o, lambda w: NOT list_contains(s, w))) / nullif(len(o), 0)::DOUBLE, 6) AS ratio FROM ({NOVEL})")
def evl5(spark, d):
    docs = view(spark, d, "documents")
    both = docs.select("doc_id", "text").join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("source")), "doc_id")
    return rounded(both.select("doc_id", V.novel_ratio(F.col("source"), F.col("text")).alias("ratio")))


def cases(spark, d):
    docs = view(spark, d, "documents").where("length(text) > 0")
    n = F.col("doc_id")
    out = F.when(n % 4 == 0, F.col("text")).when(n % 4 == 1, F.expr("substring(text, 1, cast(length(text) / 2 as int))")).when(n % 4 == 2, F.concat("text", F.lit(" In 1984 it was added, 99%."))).otherwise(F.concat(F.lit(MARKED), "text"))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (n % k + 1).cast("int"))
    words = lambda x: F.array(F.lit(x))
    return docs.select(
        n.alias("id"), pick(V.NOVELTY, 5).alias("level"), pick(("notes-light", "memo-light", "preserve-markdown"), 3).alias("style"), F.lit("en").alias("dominant"), F.col("text").alias("source"), F.when(n % 7 > 0, "T").alias("title"),
        out.alias("output"), words("the").alias("must"), words("and").alias("critical"), words("added,").alias("must_not"), (F.length("text") >= 8000).alias("map_reduce"), F.lit("single").alias("strategy"),
        F.lit(2).alias("least_entities"), (n % 4).alias("entities"), F.lit(0.7).alias("least_ratio"), F.lit(0.4).alias("fail_below"),
    )


MARKED = "# Head\n\n## More\n\n**b** **c**\n- a\n- b\n- c\n1. d\n\n\n\n\n"
LEVELS = "CASE (doc_id % 5) WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} ELSE {4} END"
OUTPUT = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, CAST(floor(length(text) / 2) AS INT)) WHEN 2 THEN text || ' In 1984 it was added, 99%.' ELSE '" + MARKED + "' || text END"
CASES = f"(SELECT *, {OUTPUT} AS output FROM documents WHERE length(text) > 0)"


def checked(name: str, category: str, score: str, passed: str, hard: str) -> str:
    return f"SELECT doc_id AS id, '{name}' AS \"check\", '{category}' AS category, CAST({score} AS DOUBLE) AS score, {passed} AS passed, {hard} AS hard_fail FROM {CASES}"


def must(name: str, category: str, good: str) -> str:
    return checked(name, category, f"CASE WHEN {good} THEN 100 ELSE 0 END", good, f"NOT ({good})")


def every(*checks: str) -> str:
    return " UNION ALL ".join(checks)


def only(df, *names):
    return df.where(F.col("check").isin(*names))


KEPT = lambda found: f"len(list_filter({found}, lambda t: NOT contains(output, t))) = 0"
NUMBERS = f"regexp_extract_all({{0}}, '{V.NUMBER}')"
QUOTES = "list_filter(list_concat(" + ", ".join(f"regexp_extract_all(text, '{V.QUOTED.replace(chr(39), chr(39) * 2)}', {g})" for g in (1, 2, 3, 4)) + "), lambda x: x <> '')"


@query("evl1_guards", every(
    must("required_fields", "accuracy", "(doc_id % 7 > 0 AND output <> '')"), must("required_tokens", "accuracy", "(contains(output, 'the') AND contains(output, 'and'))"), must("forbidden_tokens", "hallucination", "(NOT contains(output, 'added,'))"),
    must("trace_strategy", "accuracy", "(length(text) < 8000)"), must("entity_guardrails", "accuracy", "(doc_id % 4 >= 2)"),
))
def evl1(spark, d):
    return only(V.validate(cases(spark, d)), "required_fields", "required_tokens", "forbidden_tokens", "trace_strategy", "entity_guardrails")


@query("evl3_mixed_language", must("mixed_language", "locale", "(NOT (regexp_matches(text, '[가-힣]') AND regexp_matches(text, '[A-Za-z]')) OR contains(output, 'the'))"))
def evl3(spark, d):
    return only(V.validate(cases(spark, d)), "mixed_language")


@query("evl4_tokens", every(
    must("numbers_kept", "accuracy", f"({KEPT(f'list_concat({NUMBERS.format(chr(116) + chr(101) + chr(120) + chr(116))}, regexp_extract_all(text, {chr(39)}{X.ACRONYM}{chr(39)}))')})"),
    must("numbers_added", "hallucination", f"(len(list_filter({NUMBERS.format('output')}, lambda t: NOT list_contains({NUMBERS.format('text')}, t))) = 0)"), must("quotes_kept", "accuracy", f"({KEPT(QUOTES)})"),
))
def evl4(spark, d):
    return only(V.validate(cases(spark, d)), "numbers_kept", "numbers_added", "quotes_kept")


#: Letters beyond ASCII as one that DuckDB's word boundary knows.
WORDY = "regexp_replace(text, '[À-ÖØ-öø-ÿĀ-ſ가-힣]', 'z', 'g')"
LESS = "(CASE WHEN {0} THEN {1} ELSE 0 END)"
HAS = lambda p: f"regexp_matches(output, '(?m){p}')"
N = lambda c, p: f"len(regexp_extract_all({c}, '(?m){p}'))"
SURFACE = f"(100 - {LESS.format(HAS('[ ' + chr(92) + 't]{3,}'), 10)} - {LESS.format(HAS(chr(92) + 'n{4,}'), 10)} - {LESS.format(HAS('^[-*+]' + chr(92) + 's*$'), 15)} - {LESS.format('doc_id % 5 >= 3 AND length(output) > 180 AND NOT ' + HAS('[.!?]' + chr(92) + 's|' + chr(92) + 'n[-*+#>]'), 15)})"
ROOM = "list_extract([{0}], CAST(doc_id % 5 AS INT) + 1)"
SH, SL, SB, OH, OL, OB = (N(c, p) for c in ("text", "output") for p in (V.HEADING, V.ITEM, V.BOLD))
FORM = f"greatest(0, 100 - {LESS.format(f'doc_id % 3 = 0 AND {OH} > {SH} + ' + ROOM.format('0, 1, 2, 4, 6'), 35)} - {LESS.format(f'doc_id % 3 = 0 AND {OB} > {SB} + ' + ROOM.format('0, 1, 2, 4, 6'), 15)} - {LESS.format(f'doc_id % 3 = 2 AND {OL} + {OH} < {SL} + {SH}', 25)} - {LESS.format(f'doc_id % 3 = 1 AND doc_id % 5 > 0 AND {OH} = 0 AND {OL} = 0', 20)} - {LESS.format(f'{OL} > {SL} + ' + ROOM.format('1, 3, 6, 8, 10'), 20)} - {LESS.format(f'doc_id % 5 = 0 AND output <> text AND {OL} + {OH} > {SL} + {SH} + 1', 25)})"


@query("evl7_surface", every(
    checked("fluency_surface", "fluency", f"CASE WHEN trim(output) = '' THEN 0 ELSE {SURFACE} END", f"(CASE WHEN trim(output) = '' THEN 0 ELSE {SURFACE} END >= 60)", "(trim(output) = '')"),
    must("markdown_structure", "structure", f"((length(output) - length(replace(output, '```', ''))) / 3 % 2 = 0 AND NOT {HAS(V.EMPTY_HEADING)} AND NOT {HAS(V.EMPTY_ITEM)})"),
    checked("markdown_form", "structure", FORM, f"({FORM} >= 60)", "false"),
))
def evl7(spark, d):
    return only(V.validate(cases(spark, d)), "fluency_surface", "markdown_structure", "markdown_form")


LENGTHS = f"""(WITH b AS (SELECT doc_id, length(output) AS n, length(output) / CAST(length(text) AS DOUBLE) AS r, {LEVELS.format(1.1, 1.2, 1.35, 1.5, 1.7)} AS most, least(0.7, {LEVELS.format(0.9, 0.75, 0.7, 0.55, 0.45)}) AS lo FROM {CASES})
    SELECT doc_id AS id, 'length_ratio' AS "check", 'accuracy' AS category, CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN r BETWEEN lo AND most THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, round(100 - abs(1 - r) * 150, 2)) END AS score, NOT (n = 0 OR (NOT (r BETWEEN lo AND most) AND (r < least(0.4, lo * 0.7) OR r > most + 0.35))) AS passed,
    n = 0 OR (NOT (r BETWEEN lo AND most) AND (r < least(0.4, lo * 0.7) OR r > most + 0.35)) AS hard_fail FROM b)"""


@query("evl6_length_ratio", f"FROM {LENGTHS}")
def evl6(spark, d):
    return only(V.validate(cases(spark, d)), "length_ratio")


CONTENT = f"list_filter(regexp_extract_all(lower({{0}}), '{V.WORD.replace(chr(39), chr(39) * 2)}'), lambda w: NOT list_contains([{', '.join(repr(w) for w in V.STOPWORDS)}], w))"
NOVELTIES = f"""(WITH w AS (SELECT doc_id, {CONTENT.format('output')} AS o, {CONTENT.format('text')} AS s FROM {CASES}), r AS (SELECT doc_id, len(list_filter(o, lambda x: NOT list_contains(s, x))) / nullif(len(o), 0)::DOUBLE AS r, {LEVELS.format(0.12, 0.2, 0.35, 0.45, 0.55)}::DOUBLE AS soft, {LEVELS.format(0.2, 0.3, 0.5, 0.58, 0.68)}::DOUBLE AS hard FROM w)
    SELECT doc_id AS id, 'novel_token_ratio' AS "check", 'hallucination' AS category, coalesce(greatest(0.0::DOUBLE, round(100 - greatest(0.0::DOUBLE, r - soft) * 300, 2)), 0) AS score, coalesce(r <= soft, false) AS passed, coalesce(r > soft AND r > hard, true) AS hard_fail FROM r)"""
LATIN = "(length({0}) - length(regexp_replace({0}, '[A-Za-z]', '', 'g')))"
HANGUL = "(length({0}) - length(regexp_replace({0}, '[가-힣]', '', 'g')))"
SHARE = lambda c: f"coalesce({LATIN.format(c)} / nullif(CAST({LATIN.format(c)} + {HANGUL.format(c)} AS DOUBLE), 0), 0)"
LOCALES = checked("locale_consistency", "locale", f"CASE WHEN {LATIN.format('output')} = 0 THEN 0 ELSE greatest(0, round(100 - 180 * abs({SHARE('text')} - {SHARE('output')}), 2)) END", f"({LATIN.format('output')} > 0 AND {SHARE('output')} >= 0.55)", f"(NOT ({LATIN.format('output')} > 0 AND {SHARE('output')} >= 0.55))")


def all_checks() -> str:
    from .registry import _ENTRIES

    return every(*[_ENTRIES[n].sql for n in ("evl1_guards", "evl3_mixed_language", "evl4_tokens", "evl7_surface")], f"(FROM {LENGTHS})", f"(FROM {NOVELTIES})", LOCALES)


@query("evl20_checks", all_checks())
def evl20(spark, d):
    return V.validate(cases(spark, d))


SCORES = f"""(SELECT id, max(mean) FILTER (category = 'accuracy') AS accuracy, max(mean) FILTER (category = 'fluency') AS fluency, max(mean) FILTER (category = 'hallucination') AS hallucination, max(mean) FILTER (category = 'locale') AS locale, max(mean) FILTER (category = 'structure') AS structure, bool_or(hard_fail) AS hard_fail
    FROM (SELECT id, category, avg(score) AS mean, bool_or(hard_fail) AS hard_fail FROM ({all_checks()}) GROUP BY 1, 2) GROUP BY 1)"""


@query("evl8_case_scores", f"SELECT id, round(accuracy, 4) AS accuracy, round(fluency, 4) AS fluency, round(hallucination, 4) AS hallucination, round(locale, 4) AS locale, round(structure, 4) AS structure, hard_fail, CASE WHEN hard_fail THEN 0.0::DOUBLE ELSE round(0.3 * accuracy + 0.15 * fluency + 0.3 * hallucination + 0.1 * locale + 0.15 * structure, 4)::DOUBLE END AS overall FROM {SCORES}")
def evl8(spark, d):
    return rounded(V.case_scores(V.validate(cases(spark, d))), 4)


@query("evl15_case_tokens", f"""SELECT doc_id, CASE WHEN h > 0 AND l > 0 THEN 'mixed-ko-en' WHEN h > 0 THEN 'ko' ELSE 'en' END AS locale, CASE WHEN regexp_matches(text, '(?m){V.HEADING}') OR regexp_matches(text, '(?m){V.ITEM}') THEN 'preserve-markdown' WHEN regexp_matches(lower(text), 'attendees|minutes|next steps') THEN 'memo-light' ELSE 'notes-light' END AS style,
    len(list_distinct(list_concat({QUOTES}, {NUMBERS.format('text')}[1:3], regexp_extract_all({WORDY}, '{X.ACRONYM}')[1:3])))::INT AS preserve, len(list_distinct(list_filter(regexp_extract_all(text, '{V.WORD.replace(chr(39), chr(39) * 2)}'), lambda w: length(w) >= 4)[1:4]))::INT AS critical FROM (SELECT *, {HANGUL.format('text')} AS h, {LATIN.format('text')} AS l FROM documents)""")
def evl15(spark, d):
    t = F.col("text")
    return view(spark, d, "documents").select("doc_id", V.script_locale(t).alias("locale"), V.style(t).alias("style"), F.size(V.preserve_tokens(t)).alias("preserve"), F.size(V.critical_tokens(t)).alias("critical"))


@query("evl19_retargeted", f"""SELECT id, "check", category, score, passed, hard_fail FROM ({all_checks()}) WHERE "check" NOT IN ('required_tokens', 'numbers_kept', 'quotes_kept') UNION ALL
    SELECT doc_id, 'topic_coverage', 'accuracy', round(100 * r, 2), r >= 0.8, r < 0.8 FROM (SELECT doc_id, (CAST(contains(output, 'the') AS INT) + CAST(contains(output, 'and') AS INT) + CAST(contains(output, 'zzz') AS INT)) / 3.0::DOUBLE AS r FROM {CASES})""")
def evl19(spark, d):
    c = cases(spark, d)
    asked = c.select("id", F.explode(F.array(F.lit("the"), F.lit("and"), F.lit("zzz"))).alias("token"))
    covered = V.coverage(asked, c.select("id", "output")).select("id", F.lit("topic").alias("kind"), "ratio", F.lit(0.8).alias("least"))
    return V.retarget(V.validate(c), covered)


@query("evl24_eligible", "SELECT id, category FROM (SELECT p_partkey AS id, p_type AS category, p_size AS rank, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS rn FROM part WHERE p_partkey % 4 <> 0) ORDER BY rn = 1 DESC, rank, id LIMIT 19")
def evl24(spark, d):
    p = view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_size").alias("rank"), (F.col("p_partkey") % 4 == 0).alias("map_reduce"))
    return V.eligible(p, 40, 5).select("id", "category")


E2 = "list_sum(list_transform(list_zip(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query("evl21_policy_cases", f"""WITH c AS (SELECT a.vec_id AS id, a.embedding AS l, b.embedding AS r, z.embedding AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings z ON z.vec_id = (a.vec_id * 7) % 400),
    d AS (SELECT id, 1 - {E2.format('l', 's')} / 2 AS ls, 1 - {E2.format('r', 's')} / 2 AS rs, 1 - {E2.format('l', 'r')} / 2 AS lr FROM c), m AS (SELECT id, ls, rs, lr, CASE WHEN id % 3 = 0 THEN 0 ELSE -1 END AS left_id FROM d)
    SELECT id, policy, CASE WHEN left_id = 0 OR ls >= 0.3 THEN 0 ELSE -1 END AS left_id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 0 WHEN rs >= 0.3 AND (left_id = 0 OR ls >= 0.3 OR rs >= lr) THEN 0 WHEN left_id = -1 AND ls < 0.3 AND lr >= 0.3 THEN -1 WHEN rs >= 0.3 THEN 0 ELSE -2 END AS right_id FROM m, (SELECT unnest(['by vector', 'by key']) AS policy)""")
def evl21(spark, d):
    e = view(spark, d, "embeddings").select("vec_id", "embedding")
    a = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("left"))
    b, z = e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("right")), e.select(F.col("vec_id").alias("seed"), F.col("embedding").alias("vector"))
    rows = a.join(b, "id").withColumn("seed", F.col("id") * 7 % 400).join(z, "seed")
    same = F.lit("a known thing")
    left = F.when(F.col("id") % 3 == 0, same).otherwise(F.concat(F.lit("left "), F.col("id").cast("string")))
    right = F.when((F.col("id") % 3 == 0) & (F.col("id") % 2 == 0), same).otherwise(F.concat(F.lit("right "), F.col("id").cast("string")))
    c = rows.select("id", F.lit("merge").alias("expected"), left.alias("left_name"), right.alias("right_name"), "left", "right", F.array(F.struct(same.alias("name"), "vector")).alias("seeds"))
    return V.simulate_policies(c, (("by vector", 0.3, 5, False, False), ("by key", 0.3, 5, True, True))).select("id", "policy", "left_id", "right_id")


@query("evl11_salient_coverage", f"""WITH t AS (SELECT doc_id AS id, unnest(list_concat(regexp_extract_all(text, '{X.NUMBER}'), regexp_extract_all({WORDY}, '{X.ACRONYM}'))) AS token FROM documents), n AS (SELECT id, token, count(*) AS n FROM t GROUP BY 1, 2),
    k AS (SELECT id, token FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, length(token) DESC, token) AS rank FROM n) WHERE rank <= 10)
    SELECT id, round(avg(CASE WHEN contains(substring(text, 1, CAST(floor(length(text) / 2) AS INT)), token) THEN 1.0::DOUBLE ELSE 0 END), 6) AS ratio, avg(CASE WHEN contains(substring(text, 1, CAST(floor(length(text) / 2) AS INT)), token) THEN 1.0::DOUBLE ELSE 0 END) >= 0.8 AS passed FROM k JOIN documents ON doc_id = id GROUP BY 1""")
def evl11(spark, d):
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return rounded(V.coverage(V.salient_tokens(docs), docs.select("id", F.expr("substring(text, 1, cast(length(text) / 2 as int))").alias("output"))), 6)


@query("evl9_run_summary", "SELECT count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (value >= 70 AND event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS hard_fails, round(quantile_cont(CAST(user_id AS DOUBLE), 0.5), 6) AS median_ms, round(quantile_cont(CAST(user_id AS DOUBLE), 0.95), 6) AS p95_ms FROM events")
def evl9(spark, d):
    e = view(spark, d, "events").select(F.col("value").alias("overall"), (F.col("event_type") == "error").alias("hard_fail"), F.col("user_id").alias("latency_ms"))
    return rounded(V.run_summary(e))


@query("evl10_review_reasons", """SELECT event_id AS id, array_to_string(list_filter([CASE WHEN user_id % 9 = 0 THEN 'manual' END, CASE WHEN event_type = 'error' THEN 'hard_fail' END, CASE WHEN value < 70 THEN 'low_score' END, CASE WHEN abs(value - user_id) >= 15 THEN 'judges_disagree' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM events WHERE user_id % 9 = 0 OR event_type = 'error' OR value < 70 OR abs(value - user_id) >= 15""")
def evl10(spark, d):
    e = view(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 9 == 0).alias("manual"), (F.col("event_type") == "error").alias("hard_fail"), F.col("value").alias("overall"), F.col("value").alias("judge_a"), F.col("user_id").alias("judge_b"))
    return V.review_reasons(e).withColumn("reasons", F.array_join("reasons", ","))


@query("evl12_tier_summary", "SELECT event_type AS tier, count(*) AS n, round(median(value), 6) AS median, round(avg(value), 6) AS mean, count(*) FILTER (value >= 70) AS passed FROM events GROUP BY 1")
def evl12(spark, d):
    return rounded(V.tier_summary(view(spark, d, "events").select(F.col("event_type").alias("tier"), F.col("value").alias("overall"))))


@query("evl13_length_sample", "SELECT id, bucket FROM (SELECT doc_id AS id, CASE WHEN length(text) >= 2000 THEN 0 WHEN length(text) >= 600 THEN 1 ELSE 2 END AS bucket, row_number() OVER (PARTITION BY CASE WHEN length(text) >= 2000 THEN 0 WHEN length(text) >= 600 THEN 1 ELSE 2 END ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE length(text) >= 80) ORDER BY rn, bucket LIMIT 30")
def evl13(spark, d):
    docs = view(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("updated_at"))
    return V.length_sample(docs, 30).select("id", "bucket")


@query("evl14_coverage_sample", "SELECT p_partkey AS id, p_type AS category FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS rn FROM part) ORDER BY rn = 1 DESC, p_size, p_partkey LIMIT 25")
def evl14(spark, d):
    p = view(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_size").alias("rank"))
    return V.coverage_sample(p, 25).select("id", "category")


@query("evl16_decisions", "SELECT p_partkey AS level, CASE WHEN p_size % 10 = 0 THEN 'reject' WHEN p_size - p_partkey % 50 >= 2 THEN 'adopt' WHEN p_size - p_partkey % 50 <= -2 THEN 'reject' ELSE 'keep' END AS decision FROM part")
def evl16(spark, d):
    p = view(spark, d, "part")
    return V.decide(p.select(F.col("p_partkey").alias("level"), (F.col("p_partkey") % 50).alias("base"), F.col("p_size").alias("challenger"), (F.col("p_size") % 10 == 0).cast("int").alias("hard_fails")))


@query("evl17_word_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS INT) AS n FROM documents")
def evl17(spark, d):
    return view(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("n"))


@query("evl18_second_judge", "SELECT event_id, event_type = 'error' OR value < 85 OR user_id % 6 <= 3 AS flagged FROM events")
def evl18(spark, d):
    return view(spark, d, "events").select("event_id", V.needs_second_judge("flagged", F.lit(False), F.col("event_type") == "error", F.col("value"), F.col("user_id") % 6).alias("flagged"))


@query("evl22_prompt_hash", "SELECT event_id, substring(sha256(event_type || chr(10) || props), 1, 12) AS hash FROM events")
def evl22(spark, d):
    return view(spark, d, "events").select("event_id", X.prompt_hash(F.col("event_type"), F.col("props")).alias("hash"))


@query("evl23_slug", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def evl23(spark, d):
    return view(spark, d, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


@query("src7_scraped_pages", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')))::INT AS n FROM pages")
def src7(spark, d):
    return view(spark, d, "pages").select("page_id", X.html_title(F.col("html")).alias("title"), F.length(X.strip_html(F.col("html"))).alias("n"))


@query("src9_new_urls", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def src9(spark, d):
    p = view(spark, d, "pages")
    return p.join(p.where("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id")


@query("src10_pdf_responses", "SELECT page_id, page_id % 3 = 0 OR page_id % 5 = 0 AS pdf FROM pages")
def src10(spark, d):
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("  %PDF-1.7"), "html")).otherwise(F.col("html"))
    return view(spark, d, "pages").select("page_id", X.is_pdf(F.lit("text/html"), F.when(F.col("page_id") % 5 == 0, F.lit("http://a/b.PDF?x")).otherwise(F.lit("http://a/b")), body).alias("pdf"))


@query("src11_challenge_pages", "SELECT page_id, page_id % 4 = 0 AS challenge FROM pages")
def src11(spark, d):
    html = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("<p>Just A Moment...</p>"))).otherwise(F.col("html"))
    return view(spark, d, "pages").select("page_id", X.is_challenge_page(html).alias("challenge"))
