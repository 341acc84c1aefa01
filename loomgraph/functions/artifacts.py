"""What a model says of a chunk, and how a long document is put together from that under a budget.

An artifact is a struct of line lists (title, heading, topic, quote, numeric, support) and a polished block. Choosing
under a budget depends on what was chosen before, so a document's candidates are folded once (``aggregate``) over a
list of steps that is known beforehand; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .names import let
from .replies import names_key, strings_of

KINDS = ("title", "heading", "topic", "quote", "numeric", "support")
BODY = KINDS[1:]
#: What a reply calls each list; fixed values.
KEYS = ("title_candidates", "section_headings", "topic_lines", "quote_lines", "numeric_lines", "support_lines")
#: By tidy level; fixed values. Caps of a chunk's lists in the order of KINDS, whether a polished block counts and its
#: tokens, the tokens of the chosen lines and of the output, and of a document: headings at most, topic, quote and
#: numeric lines to have first, support lines at most.
STRATEGIES = {
    "format_only": {"caps": (1, 1, 2, 1, 2, 0), "polish": 0, "evidence": 700, "output": 560, "heading": 4, "topic": 4, "quote": 2, "numeric": 3, "support": 0},
    "light_cleanup": {"caps": (1, 1, 2, 1, 2, 0), "polish": 0, "evidence": 700, "output": 560, "heading": 4, "topic": 4, "quote": 2, "numeric": 3, "support": 0},
    "structured_notes": {"caps": (1, 1, 2, 2, 2, 1), "polish": 120, "evidence": 1300, "output": 980, "heading": 5, "topic": 5, "quote": 3, "numeric": 4, "support": 2},
    "editorial_polish": {"caps": (1, 1, 3, 2, 3, 1), "polish": 180, "evidence": 2100, "output": 1500, "heading": 6, "topic": 6, "quote": 4, "numeric": 5, "support": 3},
    "full_revision": {"caps": (1, 1, 3, 2, 3, 1), "polish": 180, "evidence": 2100, "output": 1500, "heading": 6, "topic": 6, "quote": 4, "numeric": 5, "support": 3},
}
FLOWING = ("structured_notes", "editorial_polish", "full_revision")
#: Words that say nothing of a topic, openings that are no content, what a quoted span looks like, and marks that open
#: a line; fixed values.
STOPWORDS = (
    "also", "among", "and", "are", "but", "can", "for", "from", "have", "into", "its", "more", "not", "our", "that", "the",
    "their", "there", "these", "this", "those", "through", "under", "with", "within", "would",
)
FRONTMATTER = ("copyright", "correspondence", "supplementary", "received ", "accepted ")
QUOTED = r""""([^"\n]+)"|“([^”\n]+)”|‘([^’\n]+)’|'([^'\n]+)'"""
OPENING = r"^(?:#{1,6}\s+|[-*+]\s+|\d+\.\s+)"

NONE = "array<string>"


def none() -> Column:
    return F.array().cast(NONE)


def distinct(found: Column, limit: int | None = None) -> Column:
    """Trimmed lines that aren't blank, the first of each key."""
    return X.distinct_lines(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""), limit)


def evidence_lines(reply: Column, limit: int | None = 12) -> Column:
    """The evidence lines of a reply; where the key holds no list, the lines of its chunk summary."""
    found = strings_of(reply, "evidence_lines")
    summary = F.split(F.coalesce(F.get_json_object(reply, "$.chunk_summary"), F.lit("")), r"\r\n|\r|\n")
    return distinct(F.coalesce(found, summary), limit)


def entities(reply: Column) -> Column:
    """(name, description) of a reply's entities, or of its items without that key; blank names go. Null if it is no list."""
    raw = F.coalesce(F.get_json_object(reply, "$.entities"), F.get_json_object(reply, "$.items"), F.lit("[]"))
    rows = F.from_json(raw, "array<struct<name:string,description:string>>")
    named = F.transform(rows, lambda x: F.struct(F.trim(x["name"]).alias("name"), F.coalesce(F.trim(x["description"]), F.lit("")).alias("description")))
    return F.when(F.startswith(raw, F.lit("[")), F.filter(named, lambda x: x["name"] != ""))


def optional(reply: Column, key: str) -> Column:
    """A string of a reply, trimmed; null if it is blank or no string."""
    v = F.try_variant_get(F.try_parse_json(reply), f"$.{key}", "variant")
    return F.when(names_key(reply, key), let(v, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.trim(F.variant_get(v, "$", "string")), F.lit("")))))


def _made(lists: dict[str, Column], polished: Column | None = None) -> Column:
    return F.struct(*[lists[k].alias(k) for k in KINDS], (F.lit(None).cast("string") if polished is None else polished).alias("polished"))


def classify(found: Column, level: str) -> Column:
    """An artifact from lines: one of the first two may be the title; the others are headings, lines with a quote,
    captions and lines with two numbers or acronyms, topics, and support, in this order of tests."""
    caps = STRATEGIES[level]["caps"]
    plain = lambda x: ~X.is_affiliation(x) & ~X.is_heading(x) & ~X.is_caption(x) & (F.length(x) <= 180)
    kind = lambda x: F.when(X.is_heading(x), "heading").when(X.is_quote(x), "quote").when(X.is_caption(x) | (X.protected_count(x) >= 2), "numeric").when(X.is_topical(x), "topic").otherwise("support")

    def named(rows: Column) -> Column:
        first = F.array_min(F.transform(F.filter(rows, lambda r: r["head"]), lambda r: r["i"]))
        of = lambda k: F.transform(F.filter(rows, lambda r: (r["kind"] == k) & ~r["i"].eqNullSafe(first)), lambda r: r["x"])
        lists = {k: X.distinct_lines(of(k), caps[i]) if caps[i] else none() for i, k in enumerate(KINDS) if i}
        lists["title"] = F.transform(F.filter(rows, lambda r: r["i"].eqNullSafe(first)), lambda r: r["x"])
        return _made(lists)

    rows = F.transform(found, lambda x, i: F.struct(i.alias("i"), x.alias("x"), ((i < 2) & plain(x)).alias("head"), kind(x).alias("kind")))
    return let(rows, named)


def flat(artifact: Column) -> Column:
    """All lines of an artifact, in the order of the kinds."""
    return distinct(F.concat(*[artifact[k] for k in KINDS]))


def artifact(reply: Column, chunk: Column, level: str) -> Column:
    """The artifact of a reply about a chunk: its capped lists, or if all are empty its evidence lines classified; what it
    lacks in quotes or numbers comes from the chunk."""
    return let(reply, lambda r: _artifact(r, chunk, level))


def _artifact(reply: Column, chunk: Column, level: str) -> Column:
    s = STRATEGIES[level]
    polished = optional(reply, "polished_block") if s["polish"] else None
    said = _made({k: distinct(F.coalesce(strings_of(reply, key), none()), cap) if cap else none() for k, key, cap in zip(KINDS, KEYS, s["caps"])}, polished)

    def or_classified(a: Column) -> Column:
        nothing = a["polished"].isNull()
        for k in KINDS:
            nothing = nothing & (F.size(a[k]) == 0)
        return F.when(nothing, classify(evidence_lines(reply, None), level)).otherwise(a)

    def filled(a: Column) -> Column:
        spare = classify(distinct(F.concat(flat(a), X.preservation_lines(chunk, 3))), level)
        both = let(spare, lambda b: _made({k: F.when(F.size(a[k]) > 0, a[k]).otherwise(b[k]) for k in KINDS}, a["polished"]))
        return F.when((F.size(a["quote"]) > 0) & (F.size(a["numeric"]) > 0), a).otherwise(both)

    return let(let(said, or_classified), filled)


def is_noise(line: Column) -> Column:
    """What stands before a paper's text: affiliations, notices, a bare DOI."""
    low = F.lower(F.trim(line))
    out = (low == "") | X.is_affiliation(line)
    for mark in FRONTMATTER:
        out = out | F.startswith(low, F.lit(mark))
    return out | (F.startswith(low, F.lit("doi:")) & (F.size(F.split(F.trim(line), r"(?U)\s+")) <= 6))


def shortened(line: Column, most: int = 120) -> Column:
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("..."))).otherwise(line)


def fallback_title(found: Column) -> Column:
    """The first line that has something beside its opening mark."""
    return shortened(F.get(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, OPENING, ""))), lambda x: x != ""), F.lit(0)))


def title_of(found: Column, names: Column) -> Column:
    """A title from lines and entity names: the first good line if a heading is good, else a name of 4 to 120
    characters, else the first good line, else the first line. Good: not a figure, number or affiliation."""
    bare = F.transform(found, lambda x: F.struct(F.trim(F.regexp_replace(x, OPENING, "")).alias("c"), X.is_heading(x).alias("h")))
    good = F.filter(bare, lambda r: (r["c"] != "") & ~r["c"].rlike(r"(?i)^(?:\d|figure\b|table\b|doi:)") & ~X.is_affiliation(r["c"]))
    name = F.get(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: F.length(n).between(4, 120)), F.lit(0))

    def chosen(g: Column) -> Column:
        first = shortened(F.get(g, F.lit(0))["c"])
        return F.when(F.exists(g, lambda r: r["h"]), first).otherwise(F.coalesce(name, first, fallback_title(found)))

    return let(good, chosen)


def document_title(artifacts: Column, names: Column) -> Column:
    """title_of the artifacts' title candidates, or if they are all noise of all their lines."""
    kept = lambda found: F.filter(found, lambda x: ~is_noise(x))
    titles = distinct(F.flatten(F.transform(artifacts, lambda a: kept(a["title"]))))
    every = F.flatten(F.transform(artifacts, lambda a: kept(flat(a))))
    return let(titles, lambda t: title_of(F.when(F.size(t) > 0, t).otherwise(every), names))


def weights(line: Column) -> Column:
    """What a line adds to the three counts of the token estimate, which add up over lines."""
    n = lambda c: (F.length(line) - F.length(F.regexp_replace(line, c, ""))).cast("int")
    return F.struct(n("[A-Za-z0-9]+").alias("a"), n("[가-힣]+").alias("h"), n(r"(?U)[^\w\s]+").alias("p"))


def _tokens(a: Column, h: Column, p: Column) -> Column:
    return F.ceil(a / 4) + F.ceil(h / 2) + F.ceil(p / 2)


def candidates(artifacts: Column) -> Column:
    """(at, chunk, section, kind, x, key, a, h, p) of all lines but titles, in order; a chunk with a heading begins a
    section."""
    kept = lambda found: F.filter(found, lambda x: ~is_noise(x))
    headed = F.transform(artifacts, lambda a: (F.size(kept(a["heading"])) > 0).cast("int"))
    rows = lambda a, i, k, starts: F.transform(
        kept(a[k]), lambda x: F.struct(i.alias("chunk"), F.aggregate(F.slice(starts, 1, i + 1), F.lit(0), lambda n, s: n + s).alias("section"), F.lit(k).alias("kind"), x.alias("x"), X.line_key(x).alias("key"), weights(x).alias("w"))
    )
    every = let(headed, lambda starts: F.flatten(F.transform(artifacts, lambda a, i: F.concat(*[rows(a, i, k, starts) for k in BODY]))))
    return F.transform(every, lambda r, i: F.struct(i.alias("at"), *[r[c].alias(c) for c in ("chunk", "section", "kind", "x", "key")], *[r["w"][c].alias(c) for c in "ahp"]))


MANY = 1 << 30


def _steps(rows: Column, s: dict) -> Column:
    """What is tried in turn: headings; then, a section each in turn, the topic, quote and numeric lines to have first; then
    the others. A step names its lines by their places, and how many of their kind there may be."""
    step = lambda kind, places, most: F.struct(F.lit(kind).alias("kind"), places.alias("places"), F.lit(most).alias("most"))
    each = lambda kind, most: F.transform(F.filter(rows, lambda r: r["kind"] == kind), lambda r: step(kind, F.array(r["at"]), most))

    def in_turn(kind: str, least: int) -> Column:
        def of_section(own: Column) -> Column:
            sections = F.array_sort(F.array_distinct(F.transform(own, lambda r: r["section"])))
            listed = F.transform(sections, lambda x: step(kind, F.transform(F.filter(own, lambda r: r["section"] == x), lambda r: r["at"]), least))
            return let(listed, lambda steps: F.flatten(F.array_repeat(steps, least)))

        return let(F.filter(rows, lambda r: r["kind"] == kind), of_section)

    return F.concat(each("heading", s["heading"]), *[in_turn(k, s[k]) for k in ("topic", "quote", "numeric")], *[each(k, MANY) for k in ("topic", "quote", "numeric")], each("support", s["support"]))


def chosen(rows: Column, title: Column, level: str) -> Column:
    """The places of the candidates that a document's plan takes, in the order they were taken.

    One fold over the steps: a step looks its lines up by place, and what has been taken is their places, their keys, of which
    the token budget bounds the number, and a count of each kind."""
    s, w = STRATEGIES[level], weights(F.coalesce(title, F.lit("")))
    counts = lambda state, kind=None: F.struct(*[(state["n"][k] + F.when(kind == k, 1).otherwise(0) if kind is not None else state["n"][k]).alias(k) for k in BODY])
    start = F.struct(F.array().cast("array<int>").alias("at"), none().alias("key"), F.struct(*[F.lit(0).alias(k) for k in BODY]).alias("n"), *[w[c].alias(c) for c in "ahp"])

    def take(state: Column, step: Column) -> Column:
        fits = lambda r: _tokens(state["a"] + r["a"], state["h"] + r["h"], state["p"] + r["p"]) <= s["evidence"]
        may = lambda r: fits(r) & ~F.array_contains(state["key"], r["key"])
        first = F.get(F.filter(F.transform(step["places"], lambda i: F.get(rows, i)), may), F.lit(0))
        free = F.element_at(F.array(*[state["n"][k] for k in BODY]), F.array_position(F.array(*map(F.lit, BODY)), step["kind"]).cast("int")) < step["most"]
        added = lambda r: F.when(
            r["at"].isNotNull(),
            F.struct(F.concat(state["at"], F.array(r["at"])).alias("at"), F.concat(state["key"], F.array(r["key"])).alias("key"), counts(state, r["kind"]).alias("n"), *[(state[c] + r[c]).alias(c) for c in "ahp"]),
        ).otherwise(state)
        return F.when(free, let(first, added)).otherwise(state)

    return F.aggregate(_steps(rows, s), start, take, lambda state: state["at"])


def numeric_tokens(text: Column) -> Column:
    """Numbers and acronyms without closing marks, each once."""
    return F.array_distinct(F.transform(F.concat(X.numeric_tokens(text), X.acronyms(text)), lambda t: F.regexp_replace(t, r"(?<=.)[.,;:]+$", "")))


def anchors(line: Column, most: int = 2) -> Column:
    """The longest words that name a topic, lower-cased, ties by the alphabet."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(X.TOPIC_WORD), F.lit(0)), lambda w: F.lower(w)))
    telling = F.filter(words, lambda w: ~w.isin(*STOPWORDS))
    return F.transform(F.slice(F.sort_array(F.transform(telling, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, most), lambda r: r["w"])


#: What may be wrong with a polished block, in the order of the tests; fixed values.
EMPTY, OVER_CAP, LOST_SPAN, LOST_LINE = "empty_polished_block", "polished_block_over_cap", "missing_quote_span", "missing_quote_line"
LOST_NUMBER, NEW_NUMBER, OFF_TOPIC, HEADED = "missing_numeric_token", "added_numeric_token", "missing_topic_anchor", "unexpected_heading"


def polish_fault(block: Column, topic: Column, quote: Column, numeric: Column, support: Column, level: str) -> Column:
    """Why a polished block can't stand for the lines it was made of; null if it can."""
    b = F.trim(block)
    low = F.lower(b)
    spans = lambda q: F.filter(F.transform(F.concat(*[F.regexp_extract_all(q, F.lit(QUOTED), F.lit(g)) for g in (1, 2, 3, 4)]), lambda x: F.trim(x)), lambda x: x != "")
    lost_span = F.exists(quote, lambda q: F.exists(spans(q), lambda x: ~F.contains(b, x)))
    lost_line = F.exists(quote, lambda q: (F.size(spans(q)) == 0) & ~F.contains(b, q))
    first_lost = F.get(F.filter(F.transform(quote, lambda q: F.when(F.exists(spans(q), lambda x: ~F.contains(b, x)), LOST_SPAN).when((F.size(spans(q)) == 0) & ~F.contains(b, q), LOST_LINE)), lambda x: x.isNotNull()), F.lit(0))
    wanted, has = numeric_tokens(F.array_join(F.concat(quote, numeric), "\n")), numeric_tokens(b)
    off_topic = F.exists(F.concat(topic, support), lambda x: let(anchors(x), lambda a: (F.size(a) > 0) & ~F.exists(a, lambda w: F.contains(low, w))))
    return (
        F.when(F.coalesce(b, F.lit("")) == "", EMPTY)
        .when(X.estimate_tokens(b) > STRATEGIES[level]["polish"], OVER_CAP)
        .when(lost_span | lost_line, first_lost)
        .when(F.size(F.array_except(wanted, has)) > 0, LOST_NUMBER)
        .when(F.size(F.array_except(has, wanted)) > 0, NEW_NUMBER)
        .when(off_topic, OFF_TOPIC)
        .when(b.rlike(r"^#{1,6}\s+"), HEADED)
    )


def heading(line: Column, mark: str = "##") -> Column:
    return F.rtrim(F.concat(F.lit(mark + " "), F.trim(F.regexp_replace(line, r"^#{1,6}\s+", ""))))


def bullet(line: Column) -> Column:
    """A line as it is if it has a form of its own, else as a list item."""
    return F.when(X.is_caption(line) | X.is_structural(line), line).otherwise(F.concat(F.lit("- "), line))


def plan(artifacts: Column, title: Column, level: str) -> Column:
    """The chosen lines by chunk: (chunk, heading, topic, quote, numeric, support, polished, fault); a polished block that can't
    stand for its chunk's lines is null with the fault beside it. Chunks with neither lines nor a block are left out."""

    def by_chunk(rows: Column, taken: Column) -> Column:
        of = lambda i, k: F.transform(F.filter(rows, lambda r: (r["chunk"] == i) & (r["kind"] == k) & F.array_contains(taken, r["at"])), lambda r: r["x"])

        def one(a: Column, i: Column) -> Column:
            return let(F.struct(i.alias("chunk"), *[of(i, k).alias(k) for k in BODY], a["polished"].alias("polished")), judged)

        def judged(c: Column) -> Column:
            body = sum((F.size(c[k]) for k in BODY[2:]), F.size(c["topic"]))
            fault = F.when(c["polished"].isNotNull() & (body > 0), polish_fault(c["polished"], c["topic"], c["quote"], c["numeric"], c["support"], level))
            return F.struct(*[c[x].alias(x) for x in ("chunk", *BODY)], F.when(fault.isNull() & (body > 0), c["polished"]).alias("polished"), fault.alias("fault"), (c["polished"].isNotNull() | (body + F.size(c["heading"]) > 0)).alias("there"))

        return F.filter(F.transform(artifacts, one), lambda c: c["there"])

    return let(candidates(artifacts), lambda rows: let(chosen(rows, title, level), lambda taken: by_chunk(rows, taken)))


def chunk_blocks(c: Column, level: str) -> Column:
    """One chunk of a plan as blocks: headings, then its polished block, or its lines."""
    heads = F.transform(c["heading"], lambda x: heading(x))
    body, kept = F.concat(c["topic"], c["support"]), F.concat(c["quote"], c["numeric"])
    if level == "light_cleanup":
        lines = F.transform(F.concat(body, kept), bullet)
    else:
        running = F.when(F.size(body) > 1, F.array(F.array_join(body, " "))).otherwise(body) if level in FLOWING else body
        lines = F.concat(running, F.transform(F.filter(kept, lambda x: ~F.array_contains(F.concat(heads, running), x)), bullet))
    return F.concat(heads, F.when(c["polished"].isNotNull(), F.array(c["polished"])).otherwise(lines))


def within_budget(first: Column, blocks: Column, budget: int, stop: bool = False) -> Column:
    """first and then the blocks that fit the budget, the very first one whatever it takes; a ## heading is said once.
    With ``stop`` nothing follows a block that doesn't fit."""
    sized = F.transform(blocks, lambda x: F.struct(x.alias("x"), X.line_key(x).alias("key"), F.startswith(x, F.lit("## ")).alias("head"), weights(x).alias("w")))
    w = F.aggregate(first, F.struct(*[F.lit(0).alias(c) for c in "ahp"]), lambda acc, x: let(weights(x), lambda v: F.struct(*[(acc[c] + v[c]).alias(c) for c in "ahp"])))
    start = F.struct(first.alias("x"), none().alias("heads"), F.lit(False).alias("full"), *[w[c].alias(c) for c in "ahp"])

    def put(state: Column, b: Column) -> Column:
        said = b["head"] & F.array_contains(state["heads"], b["key"]) if not stop else F.lit(False)
        over = (F.size(state["x"]) > 0) & (_tokens(*[state[c] + b["w"][c] for c in "ahp"]) > budget)
        good = ~said & ~over & ~state["full"]
        heads = F.when(b["head"] & ~said, F.concat(state["heads"], F.array(b["key"]))).otherwise(state["heads"])
        return F.struct(
            F.when(good, F.concat(state["x"], F.array(b["x"]))).otherwise(state["x"]).alias("x"),
            heads.alias("heads"),
            (state["full"] | (over if stop else F.lit(False))).alias("full"),
            *[F.when(good, state[c] + b["w"][c]).otherwise(state[c]).alias(c) for c in "ahp"],
        )

    return F.aggregate(sized, start, put, lambda state: state["x"])


def render(chunks: Column, title: Column, level: str) -> Column:
    """A plan as text within the level's budget; null if nothing is left."""
    first = F.when(title.isNotNull(), F.array(heading(title, "#"))).otherwise(none())
    out = within_budget(first, F.flatten(F.transform(chunks, lambda c: chunk_blocks(c, level))), STRATEGIES[level]["output"])
    return F.nullif(F.trim(F.array_join(out, "\n\n")), F.lit(""))


def stitched(found: Column, level: str) -> Column:
    """Evidence lines as text: a first plain line is the title, headings and structured lines stand alone, others run on
    until a sentence ends or enough is together (levels that rewrite) or are list items. Blocks go in while they fit; of
    those that don't, quotes and lines with numbers follow under a heading of their own."""
    runs = level in FLOWING
    enough = 240 if level == "structured_notes" else 360
    kind = lambda x, i: F.when((i == 0) & ~X.is_structural(x) & (F.length(x) <= 180), "title").when(X.is_heading(x), "heading").when(X.is_structural(x) | X.is_caption(x), "own").otherwise("run")
    rows = F.filter(F.transform(found, lambda x, i: F.struct(F.trim(x).alias("x"), kind(F.trim(x), i).alias("k"))), lambda r: r["x"] != "")
    whole = lambda buffer: F.when(F.size(buffer) == 0, none()).otherwise(F.array(F.array_join(buffer, " ")) if runs and level != "structured_notes" else F.when(F.size(buffer) > 1, F.array(F.array_join(buffer, " "))).otherwise(F.transform(buffer, lambda x: F.concat(F.lit("- "), x))))

    def step(state: Column, r: Column) -> Column:
        longer = F.concat(state["buffer"], F.array(r["x"]))
        closed = (F.length(F.array_join(longer, " ")) >= enough) | r["x"].rlike("[.!?][\"”’)\\]]?$") if runs else F.lit(True)
        alone = F.when(r["k"] == "title", heading(r["x"], "#")).when(r["k"] == "heading", heading(r["x"])).otherwise(r["x"])
        return (
            F.when(r["k"] != "run", F.struct(F.concat(state["out"], whole(state["buffer"]), F.array(alone)).alias("out"), none().alias("buffer")))
            .when(closed, F.struct(F.concat(state["out"], whole(longer)).alias("out"), none().alias("buffer")))
            .otherwise(F.struct(state["out"].alias("out"), longer.alias("buffer")))
        )

    blocks = F.aggregate(rows, F.struct(none().alias("out"), none().alias("buffer")), step, lambda s: F.concat(s["out"], whole(s["buffer"])))
    budget = STRATEGIES[level]["output"]

    def fitted(b: Column) -> Column:
        return let(within_budget(none(), b, budget, stop=True), lambda head: finished(b, head))

    def finished(b: Column, head: Column) -> Column:
        left = F.filter(F.slice(b, F.size(head) + 1, F.greatest(F.size(b) - F.size(head), F.lit(0))), lambda x: X.is_quote(x) | (X.protected_count(x) >= 2))
        spare = F.when(F.size(left) > 0, F.concat(F.array(F.concat(F.lit("## Preserved Source Spans\n\n"), F.get(left, F.lit(0)))), F.slice(left, 2, F.greatest(F.size(left) - 1, F.lit(0))))).otherwise(none())
        return F.array_join(within_budget(head, spare, budget, stop=True), "\n\n")

    return F.nullif(F.trim(let(blocks, fitted)), F.lit(""))


def listed(found: Column) -> Column:
    """Evidence lines as a plain list; null without any."""
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: F.when(x.rlike(r"^(?:#{1,6}\s+|[-*+]\s+|\d+\.\s+|>\s+)"), x).otherwise(F.concat(F.lit("- "), x))), "\n"))


def payload(found: Column) -> Column:
    """Lines as the JSON text that a prompt holds; its length and its token estimate are the payload's size."""
    quoted = lambda x: let(F.to_json(F.array(x)), lambda j: F.substr(j, F.lit(2), F.length(j) - 2))
    return F.concat(F.lit('{"evidence_lines": ['), F.array_join(F.transform(found, quoted), ", "), F.lit("]}"))


def compressed(lists: Column, budget: int) -> Column:
    """The lines of several lists (each of distinct lines) that fit a budget as a payload, taken a line of each list in turn;
    a key counts once, where it comes first. One line of each list if none fits."""
    row = lambda x, i, j: let(weights(payload(F.array(x))), lambda w: F.struct(i.alias("list"), j.alias("place"), x.alias("x"), X.line_key(x).alias("key"), (w["a"] - 13).alias("a"), w["h"].alias("h"), (w["p"] - 7).alias("p")))
    kind = "array<struct<list:int,place:int,x:string,key:string,a:int,h:int,p:int>>"

    def of_turn(rows: Column) -> Column:
        rounds = F.greatest(F.aggregate(F.transform(rows, lambda x: F.size(x)), F.lit(0), lambda a, b: a + b), F.lit(1))
        turns = F.flatten(F.transform(F.sequence(F.lit(1), rounds), lambda _: F.transform(rows, lambda x, i: i)))
        start = F.struct(F.transform(rows, lambda x: F.lit(0)).alias("n"), F.array().cast(kind).alias("kept"), F.lit(13).alias("a"), F.lit(0).alias("h"), F.lit(7).alias("p"))
        return F.aggregate(turns, start, lambda state, i: let(F.get(F.get(rows, i), F.get(state["n"], i)), lambda r: with_row(state, i, r)), lambda s: F.transform(F.sort_array(s["kept"]), lambda r: r["x"]))

    def with_row(state: Column, i: Column, r: Column) -> Column:
        return let(F.get(F.filter(state["kept"], lambda k: k["key"] == r["key"]), F.lit(0)), lambda same: placed(state, i, r, same))

    def placed(state: Column, i: Column, r: Column, same: Column) -> Column:
        new = same["key"].isNull()
        first = new | (r["list"] < same["list"]) | ((r["list"] == same["list"]) & (r["place"] < same["place"]))
        rest = F.filter(state["kept"], lambda k: k["key"] != r["key"])
        comma = (new & (F.size(state["kept"]) > 0)).cast("int")
        plus = {c: F.when(first, r[c] - F.coalesce(same[c], F.lit(0))).otherwise(0) for c in "ahp"}
        more = {c: state[c] + plus[c] + (comma if c == "p" else F.lit(0)) for c in "ahp"}
        counts = F.transform(state["n"], lambda k, j: F.when(j == i, k + 1).otherwise(k))
        grown = F.struct(counts.alias("n"), F.when(first, F.concat(rest, F.array(r))).otherwise(state["kept"]).cast(kind).alias("kept"), *[more[c].cast("int").alias(c) for c in "ahp"])
        return F.when(r["key"].isNotNull() & (_tokens(*[more[c] for c in "ahp"]) <= budget), grown).otherwise(state)

    rows = F.transform(lists, lambda x, i: F.transform(x, lambda y, j: row(y, i, j)))
    first = distinct(F.flatten(F.transform(lists, lambda x: F.slice(x, 1, 1))))
    return let(let(rows, of_turn), lambda out: F.when(F.size(out) > 0, out).otherwise(first))


def summary_inputs(summaries: Column, evidence: Column) -> Column:
    """Chunk summaries that aren't empty, else the first two evidence lines of each chunk, six at most."""
    said = F.filter(summaries, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(said) > 0, said).otherwise(F.slice(F.flatten(F.transform(evidence, lambda e: F.slice(e, 1, 2))), 1, 6))


def merged(reply_lines: Column, lists: Column) -> Column:
    """A model's merge of lists of lines if each of its lines is one of theirs, else their lines, each once."""
    source = F.flatten(lists)
    keys = lambda c: F.transform(c, lambda x: X.line_key(x))
    good = (F.size(reply_lines) > 0) & (F.size(F.array_except(keys(reply_lines), keys(source))) == 0)
    return F.when(F.coalesce(good, F.lit(False)), reply_lines).otherwise(distinct(source))
