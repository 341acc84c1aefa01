"""Secret scans through a trigram inverted index. DataFrame functions only.

Each rule's regex gives a Boolean query over lower-case trigrams that every match must contain, in disjunctive
form. The index holds postings (trigram, id) for the trigrams that some rule asks for; a rule's candidates are
the documents whose postings cover one of its clauses, and only those are searched with the regex. A rule
without mandatory trigrams is searched in every document.

Spans are code-point offsets, end exclusive, leftmost and non-overlapping per rule. They come from the pieces
between matches and the matches themselves, so no Python runs on the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_keyed, split_join, staged

MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # the same to java.util.regex and to re
    group: int = 0  # whose length must be
    least: int = 0  # so many characters at least
    base: bool = False


#: The base kinds, in the order that breaks ties, then this method's own. In access and hex the least length is
#: part of the pattern: a run that starts too short has no longer one later, so this finds the same spans.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abp]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Clauses = frozenset  # of frozensets of trigrams: any of the sets, each wholly; one empty set: nothing is mandatory
ANY: Clauses = frozenset([frozenset()])


def _and(a: Clauses, b: Clauses) -> Clauses:
    both = frozenset(x | y for x in a for y in b)
    kept = frozenset(x for x in both if not any(y < x for y in both))
    return kept if len(kept) <= MAX_STRINGS else a


def _trigrams(strings: frozenset[str]) -> Clauses:
    """What a match that holds one of the strings must contain."""
    sets = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    return frozenset(x for x in sets if not any(y < x for y in sets)) or ANY


def _literals(op, arg) -> frozenset[str] | None:
    """The lower-case strings that a small construct can match; None if not a small finite set."""
    if op is rc.LITERAL:
        return frozenset([chr(arg).lower()])
    if op is rc.IN and all(o is rc.LITERAL for o, _ in arg):
        return frozenset(chr(c).lower() for _, c in arg)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 2:
        one = _strings(arg[2])
        return None if one is None else frozenset("".join(p) for n in range(arg[0], arg[1] + 1) for p in _product([one] * n))
    if op is rc.SUBPATTERN:
        return _strings(arg[3])
    if op is rc.BRANCH:
        parts = [_strings(x) for x in arg[1]]
        return None if None in parts else frozenset().union(*parts)
    return None


def _product(sets):
    return reduce(lambda out, s: [(*p, x) for p in out for x in s], sets, [()])


def _strings(seq) -> frozenset[str] | None:
    parts = [_literals(*x) for x in seq]
    if None in parts:
        return None
    out = frozenset("".join(p) for p in _product(parts)) if reduce(lambda n, p: n * len(p), parts, 1) <= MAX_STRINGS else None
    return out


def _query(seq) -> Clauses:
    """Walk a sequence: runs of small finite sets become strings, the rest contributes its own query."""
    out, run = ANY, frozenset([""])

    for op, arg in seq:
        part = _literals(op, arg)
        if part is not None and len(run) * len(part) <= MAX_STRINGS:
            run = frozenset(a + b for a in run for b in part)
            continue
        out, run = _and(out, _trigrams(run)), frozenset([""])
        if op is rc.SUBPATTERN:
            out = _and(out, _query(arg[3]))
        elif op is rc.BRANCH:
            out = _and(out, frozenset().union(*(_query(x) for x in arg[1])))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
            out = _and(out, _query(arg[2]))
    return _and(out, _trigrams(run))


def trigram_query(pattern: str) -> Clauses:
    """Sets of lower-case trigrams, one of which every match contains wholly. ANY if nothing is mandatory."""
    q = _query(rp.parse(pattern))
    return ANY if any(not x for x in q) else q


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index (trigram number, id) over the given trigrams of the lower-cased whole texts."""
    low = docs.select(id_col, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)]))
    return low.select(id_col, F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """(id, kinds), for each document the indexed rules with a clause that its postings cover; and for every clause the
    trigram of fewest postings, one of which every candidate holds."""
    spark = docs.sparkSession
    clauses = [(r.kind, n, sorted(c)) for r in rules for n, c in enumerate(sorted(trigram_query(r.pattern), key=sorted)) if c]
    trigrams = sorted({t for *_, c in clauses for t in c})
    if not trigrams:
        return docs.select(id_col, F.array().cast("array<string>").alias("kinds")).limit(0), []
    rows = [(trigrams.index(t), kind, n, 1 << k, (1 << len(c)) - 1) for kind, n, c in clauses for k, t in enumerate(c)]
    asked = F.broadcast(spark.createDataFrame(rows, "trigram int, kind string, clause int, bit long, full long"))  # as many rows as the rules have trigrams
    index = staged(postings(docs, trigrams, id_col, text_col), "secret-postings")
    sizes = {trigrams[r.trigram]: r["count"] for r in index.groupBy("trigram").count().collect()}  # a row a trigram of the rules
    met = index.join(asked, "trigram").groupBy(id_col, "kind", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    rarest = sorted({min(c, key=lambda t: (sizes.get(t, 0), t)) for *_, c in clauses})
    return met.where("bits = full").groupBy(id_col).agg(F.collect_set("kind").alias("kinds")), rarest


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end>> of a rule's matches in text."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    value = lambda m: m if not rule.group else F.regexp_extract(m, rule.pattern, rule.group)

    def step(acc, x):
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        good = x["match"].isNotNull() & (F.length(value(x["match"])) >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"))

    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), matches.alias("match"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    return F.when(F.size(matches) == 0, empty).otherwise(F.aggregate(zipped, start, step, lambda acc: acc["found"]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``found``, an array of (start, kind, end) sorted by start, then rule order.

    Rules without trigrams are searched in a pass over all texts, without a join. Those with are searched in the
    candidates: only texts that hold some clause's rarest trigram reach the join with them, so no other text moves,
    and the two passes' spans meet by row. Null texts are empty and have none. Rows that repeat an id, and null ids,
    are rows of their own. An empty table gives no rows; other columns are not read.
    """
    kinds = [r.kind for r in rules]
    indexed = {r.kind for r in rules if trigram_query(r.pattern) != ANY}
    texts, row = row_keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    hits, rarest = candidates(texts, rules, row, "text")
    hits = staged(hits, "secret-candidates")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    part = lambda r, k: spans_of(F.col("text"), r, k)
    scanned = texts.select("id", row, F.concat(none, *[part(r, k) for k, r in enumerate(rules) if r.kind not in indexed]).alias("scanned"))
    asked_for = F.array(*map(F.lit, rarest)).cast("array<string>")
    held = texts.where(F.exists(F.array(F.lower("text")), lambda low: F.exists(asked_for, lambda t: F.contains(low, t))))  # lower-cased once a row
    asked = [F.when(F.array_contains("kinds", r.kind), part(r, k)).otherwise(none) for k, r in enumerate(rules) if r.kind in indexed]
    verified = held.join(hits, row).select(row, F.concat(none, *asked).alias("verified")).where(F.size("verified") > 0)
    both = split_join(scanned, staged(verified, "secret-spans"), [row], "left")
    found = both.select(F.col("id").alias(id_col), F.sort_array(F.concat("scanned", F.coalesce("verified", none))).alias("found"))
    name = F.array(*[F.lit(k) for k in kinds])
    return found.select(id_col, F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.element_at(name, x["rank"] + 1).alias("kind"), x["end"].alias("end"))).alias("found"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_<kind> for each base rule, base_sha256 and spans."""
    base = [r.kind for r in rules if r.base]
    of_base = F.filter("found", lambda x: x["kind"].isin(base))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return find_secrets(docs, rules, id_col, text_col).select(
        id_col, *[count(k).alias(f"n_{k}") for k in base], F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )
