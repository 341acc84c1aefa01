"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import re

from .licenses import TEMPLATES, Template, TokenAutomaton
from .secrets import RULES, Rule
from .url_rules import GIVEN, GivenRule

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def _either_case(pattern: str) -> str:
    """The pattern with (?i:...) spelled out as classes, since DuckDB folds more than ASCII."""
    head, _, rest = pattern.partition("(?i:")
    if not rest:
        return pattern
    inner, tail = rest.split(")", 1)
    return f"{head}(?:{''.join(f'[{c.upper()}{c}]' if c.isalpha() else c for c in inner)}){tail}"


def _spans(rule: Rule, rank: int) -> str:
    """Rows (doc_id, start, rank, end) of a rule: pieces between matches and matches, laid end to end."""
    p = _either_case(rule.pattern).replace("'", "''")
    return f"""SELECT doc_id, s AS start, {rank} AS rank, s + length(m) AS stop FROM (
      SELECT doc_id, m, v, coalesce(sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(piece) AS s FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(pieces[1:len(ms)]) AS piece, unnest(range(len(ms))) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {rule.group}) AS vs, regexp_split_to_array(text, '{p}') AS pieces
          FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)))) WHERE length(v) >= {rule.least}"""


def secret_scan(rules: tuple[Rule, ...] = RULES) -> str:
    kinds = ", ".join(f"'{r.kind}'" for r in rules)
    every = " UNION ALL ".join(_spans(r, k) for k, r in enumerate(rules))
    n = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules if r.base)
    base = [k for k, r in enumerate(rules) if r.base]
    counts = ", ".join(f"count(*) FILTER (rank = {k}) AS n_{rules[k].kind}" for k in base)
    line = f"[{kinds}][rank + 1] || ':' || start || ':' || stop"
    return f"""WITH f AS ({every}), g AS (SELECT doc_id, {counts}, string_agg({line}, ',' ORDER BY start, rank, stop) FILTER (rank <= {max(base)}) AS b, string_agg({line}, ',' ORDER BY start, rank, stop) AS spans FROM f GROUP BY doc_id)
    SELECT d.doc_id, {n}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"""


WARC = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest, url,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest FROM pages),
  g AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to,
  CASE WHEN contains(url, '://') THEN list_aggregate(list_reverse(string_split(translate(host, '{UPPER}', '{LOWER}'), '.')), 'string_agg', ',') || ')' || rest END AS url_key,
  TIMESTAMP '2020-01-01 00:00:00' + INTERVAL 1 SECOND * page_id AS captured_at FROM g"""

DECONTAMINATE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents), i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
  iw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
  ks AS (SELECT DISTINCT k FROM iw),
  dw AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS gram FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
  m AS MATERIALIZED (SELECT r, p, dw.k, item_id FROM dw JOIN iw ON iw.gram = dw.gram AND iw.k = dw.k),
  h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM m) GROUP BY r),
  t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY r),
  c AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
  v AS (SELECT row_number() OVER () AS v, item_id, ts FROM (SELECT DISTINCT item_id, list_sort(list_distinct(w)) AS ts FROM i WHERE len(w) > 0)),
  rare AS MATERIALIZED (SELECT * FROM (SELECT v, item_id, term, least(len(ts), 5) AS every, row_number() OVER (PARTITION BY v ORDER BY coalesce(n, 0), term) AS k FROM (SELECT v, item_id, ts, unnest(ts) AS term FROM v) LEFT JOIN c USING (term)) WHERE k <= 5),
  o AS MATERIALIZED (SELECT r, p, term FROM (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS p FROM d) SEMI JOIN rare USING (term)),
  near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM (SELECT a.r, x.item_id FROM rare x JOIN o a ON x.k = 1 AND a.term = x.term JOIN rare y ON y.v = x.v JOIN o b ON b.r = a.r AND b.term = y.term AND abs(b.p - a.p) <= 40
    GROUP BY a.r, a.p, x.v, x.item_id, x.every HAVING count(DISTINCT y.k) = x.every) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r) LEFT JOIN near USING (r)"""

FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
  h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
  f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
  c AS (SELECT doc_id, n, form, t, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

SUBSTRING_DEDUP = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  g AS MATERIALIZED (SELECT r, doc_id, p, md5_number(array_to_string(w[p:p + 49], ' ')) AS gram FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
  f AS (SELECT gram, min(doc_id) AS lo FROM g GROUP BY gram HAVING count(*) > 1),
  s AS (SELECT DISTINCT r, p FROM g JOIN f USING (gram) WHERE lo < doc_id OR (doc_id IS NULL AND lo IS NOT NULL)),
  x AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS q FROM s),
  k AS (SELECT r, count(*) AS n, string_agg(v, ' ' ORDER BY q) AS kept FROM (SELECT r, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS q FROM d) t ANTI JOIN x USING (r, q) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


def _regex(markup: str) -> str:
    """A template as a pattern over words that each end in a blank."""
    out = ""
    for part in re.findall(r"<<.*?>>|[^\s<]+", markup):
        if part == "<<opt>>":
            out += "(?:"
        elif part == "<</opt>>":
            out += ")?"
        elif m := re.fullmatch(r"<<var (\d+)-(\d+)>>", part):
            out += f"(?:[^ ]+ ){{{m[1]},{m[2]}}}"
        else:
            out += part + " "
    return out


def license_scan(templates: tuple[Template, ...] = TEMPLATES) -> str:
    automata = [TokenAutomaton(t.markup) for t in templates]
    first = ", ".join(f"'{w}'" for w in sorted({w.decode() for a in automata for w in a.first}))
    found = " UNION ALL ".join(
        f"SELECT r, i, '{t.label}' AS label, {t.base} AS base, len(string_split(regexp_extract(t, '^({_regex(t.markup)})', 1), ' ')) - 1 AS n FROM s WHERE regexp_matches(t, '^{_regex(t.markup)}')" for t in templates
    )
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
  s AS MATERIALIZED (SELECT r, i, array_to_string(w[i + 1:i + {max(a.n for a in automata)}], ' ') || ' ' AS t FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d) WHERE w[i + 1] IN ({first})),
  f AS MATERIALIZED ({found}),
  g AS (SELECT r, count(*) FILTER (base) AS n_base, min(i) FILTER (base) AS first_word, max(i) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f GROUP BY r),
  c AS (SELECT r, count(DISTINCT p) AS covered FROM (SELECT r, unnest(range(i, i + n)) AS p FROM f) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE coalesce(covered, 0) / CAST(len(w) AS DOUBLE) END AS score FROM d LEFT JOIN g USING (r) LEFT JOIN c USING (r)"""


def url_filter(rules: tuple[GivenRule, ...] = GIVEN, support: float = 0.005, confidence: float = 0.9, default: str = "allow") -> str:
    """Every combination of a labelled URL's frequent tokens is counted, and every combination of an open URL's tokens is
    looked up among the rules."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '/{r.path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in longest) + " END"
    tag = lambda mark, c: f"list_transform({c}, lambda x: '{mark}' || x)"
    labels, file = "list_filter(list_reverse(string_split(host, '.')), lambda x: x <> '')", "regexp_extract(path, '([^/]*)$', 1)"
    dirs = "list_filter(string_split(path, '/')[:-2], lambda x: x <> '')"
    ext = rf"regexp_extract({file}, '\.([A-Za-z0-9]+)$', 1)"
    tokens = ", ".join(
        (
            f"list_transform({labels}, lambda x, i: 'h' || i || ':' || x)",
            tag("w:", f"flatten(list_transform(list_filter({labels}, lambda x: regexp_matches(x, '[^a-z]')), lambda x: regexp_extract_all(x, '[a-z]{{2,}}')))"),
            f"list_transform({dirs}, lambda x, i: 'p' || i || ':' || x)",
            tag("f:", rf"regexp_extract_all(regexp_replace({file}, '\.[A-Za-z0-9]+$', ''), '[\p{{L}}\p{{N}}]+')"),
            f"CASE WHEN {ext} <> '' THEN ['x:' || {ext}] ELSE [] END",
            tag("q:", r"regexp_extract_all(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1)"),
        )
    )
    subsets = lambda c: f"unnest(list_transform(range(1, CAST(pow(2, len({c})) AS BIGINT)), lambda m: list_filter({c}, lambda x, i: (m >> (i - 1)) & 1 = 1)))"
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  j AS MATERIALIZED (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS said, list_sort(list_distinct(list_concat({tokens}))) AS tokens FROM u),
  n AS (SELECT count(*) AS n FROM j WHERE rule IS NOT NULL),
  often AS MATERIALIZED (SELECT token FROM (SELECT unnest(tokens) AS token FROM j WHERE rule IS NOT NULL), n GROUP BY token, n HAVING count(*) >= {support} * n),
  b AS (SELECT said, list_sort(list_intersect(tokens, (SELECT coalesce(list(token), []) FROM often))) AS known FROM j WHERE rule IS NOT NULL),
  c AS (SELECT s, count(*) AS every, said, sum(count(*)) OVER (PARTITION BY s) AS held FROM (SELECT said, {subsets('known')} AS s FROM b) GROUP BY s, said),
  rules AS MATERIALIZED (SELECT s, said AS label, every / CAST(held AS DOUBLE) AS confidence, every / CAST(n AS DOUBLE) AS support FROM c, n WHERE every >= ceil({support} * n) AND every / CAST(held AS DOUBLE) >= {confidence}),
  o AS (SELECT r, {subsets('known')} AS s FROM (SELECT r, list_sort(list_intersect(tokens, (SELECT coalesce(list(DISTINCT t), []) FROM (SELECT unnest(s) AS t FROM rules)))) AS known FROM j WHERE rule IS NULL)),
  m AS (SELECT r, s, label FROM (SELECT r, o.s, label, row_number() OVER (PARTITION BY r ORDER BY confidence DESC, support DESC, o.s DESC, label DESC) AS place FROM o JOIN rules ON rules.s = o.s) WHERE place = 1)
SELECT page_id, host, path, rule, coalesce(said, label, '{default}') AS verdict, array_to_string(s, ' ') AS mined FROM j LEFT JOIN m USING (r)"""
