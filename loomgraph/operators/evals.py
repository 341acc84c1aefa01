"""Evaluation of rewritten texts: checks by row, then scores by case and run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import names as N
from ..functions import text as X
from ..functions.names import let
from ..functions.vectors import l2_squared
from .resolve import POLICIES

# Weights of the categories, and by level the shares of new words (soft, hard) and the length ratios
# (least, most) that are allowed, and how many more headings or bold spans, and list items, an output may have.
WEIGHTS = {"accuracy": 0.3, "fluency": 0.15, "hallucination": 0.3, "locale": 0.1, "structure": 0.15}
NOVELTY = {
    "format_only": (0.12, 0.2),
    "light_cleanup": (0.2, 0.3),
    "structured_notes": (0.35, 0.5),
    "editorial_polish": (0.45, 0.58),
    "full_revision": (0.55, 0.68),
}
LENGTH = {
    "format_only": (0.9, 1.1),
    "light_cleanup": (0.75, 1.2),
    "structured_notes": (1.0, 1.35),
    "editorial_polish": (0.55, 1.5),
    "full_revision": (0.45, 1.7),
}
GROWTH = {
    "format_only": (0, 1),
    "light_cleanup": (1, 3),
    "structured_notes": (2, 6),
    "editorial_polish": (4, 8),
    "full_revision": (6, 10),
}
# The words that say nothing, and what a word, a number with its unit, an acronym, a quoted span and the marks
# of a heading, a list item and bold text look like.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with",
    "것", "것인가", "그리고", "대한", "및", "이", "이후", "있는", "있다", "정리", "제안", "검토", "관련", "중", "수", "등", "더", "또는",
)
NUMBER = r"[0-9][0-9,./:-]*(?:%|년|월|일|명|개|회|단계|차|시군)?"
QUOTED = r""""([^"\n]+)"|“([^”\n]+)”|‘([^’\n]+)’|'([^'\n]+)'"""
EMPTY_HEADING, EMPTY_ITEM = r"^#{1,6}[ \t]*$", r"^[ \t]*(?:[-*+]|\d+\.)[ \t]*$"
HEADING, ITEM, BOLD = r"^#{1,6}\s+\S", r"^\s*(?:[-*+]|\d+\.)\s+\S", r"\*\*[^*\n]+\*\*"
WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)*|[가-힣]+|[0-9]+(?:[.,:/-][0-9]+)*"


def missing(tokens: Column, output: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.contains(output, t))


def present(tokens: Column, output: Column) -> Column:
    return F.filter(tokens, lambda t: F.contains(output, t))


def script_counts(text: Column) -> dict[str, Column]:
    n = lambda c: F.length(text) - F.length(F.regexp_replace(text, c, ""))
    return {"hangul": n("[가-힣]"), "latin": n("[A-Za-z]")}


def by_level(level: Column, values: dict, i: int) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v[i]))]), level)


def locale_check(source: Column, output: Column, dominant: Column) -> tuple[Column, Column]:
    """(score, passed): 100 less 180 for each point that the dominant script's share moves; it must keep 0.55 of the
    output. Mixed texts must keep both scripts."""
    s, o = script_counts(source), script_counts(output)
    share = lambda c, k: F.coalesce(F.try_divide(c[k], c["hangul"] + c["latin"]), F.lit(0.0))
    score = lambda k: F.when(o[k] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(100 - 180 * F.abs(share(s, k) - share(o, k)), 2)))
    both = (o["hangul"] > 0) & (o["latin"] > 0)
    passed = lambda k: (o[k] > 0) & (share(o, k) >= 0.55)
    return (
        F.when(dominant == "ko", score("hangul")).when(dominant == "en", score("latin")).otherwise(F.when(both, 100.0).otherwise(0.0)),
        F.when(dominant == "ko", passed("hangul")).when(dominant == "en", passed("latin")).otherwise(both),
    )


def locale(text: Column, least: float = 0.55) -> Column:
    s = script_counts(text)
    share = F.try_divide(s["hangul"], s["hangul"] + s["latin"])
    return F.when(share >= least, "ko").when(share <= 1 - least, "en").when(share.isNull(), "en").otherwise("mixed-ko-en")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def quoted(text: Column) -> Column:
    """What stands between quotation marks of one kind on one line."""
    parts = [F.regexp_extract_all(text, F.lit(QUOTED), F.lit(g)) for g in (1, 2, 3, 4)]
    both = F.arrays_zip(*[p.alias(f"q{i}") for i, p in enumerate(parts)])
    return F.filter(F.transform(both, lambda x: F.concat(*[F.coalesce(x[f"q{i}"], F.lit("")) for i in range(4)])), lambda x: x != "")


def style(text: Column) -> Column:
    """What the form of a text asks for: markdown is kept, minutes become a memo, the rest are notes."""
    low = F.lower(text)
    memo = F.contains(low, F.lit("attendees")) | F.contains(low, F.lit("minutes")) | F.contains(low, F.lit("next steps"))
    return F.when(text.rlike("(?md)" + HEADING) | text.rlike("(?md)" + ITEM), "preserve-markdown").when(memo, "memo-light").otherwise("notes-light")


def script_locale(text: Column) -> Column:
    s = script_counts(text)
    return F.when((s["hangul"] > 0) & (s["latin"] > 0), "mixed-ko-en").when(s["hangul"] > 0, "ko").otherwise("en")


def preserve_tokens(text: Column) -> Column:
    """Quoted spans, the first three numbers and the first three acronyms, each once."""
    return F.array_distinct(F.concat(quoted(text), F.slice(numbers(text), 1, 3), F.slice(X.acronyms(text), 1, 3)))


def critical_tokens(text: Column) -> Column:
    """The first four words of four letters or more, each once."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_distinct(F.slice(F.filter(words, lambda w: F.length(w) >= 4), 1, 4))


def content_words(text: Column) -> Column:
    """Words, lower-cased, without stop words; repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def novel_ratio(source: Column, output: Column) -> Column:
    """The share of the output's content words that the source lacks; null without any.

    Both the output's words and the new ones among them are sorted, and one walk along the words counts those that are new:
    each new word is met in its turn, so the place in the list of new words moves by one at most."""
    o = content_words(output)
    once = F.array(F.struct(F.array_sort(o).alias("o"), F.array_sort(F.array_except(o, content_words(source))).alias("new")))  # computed once a row

    def walk(new: Column):
        def step(acc: Column, w: Column) -> Column:
            at = acc["at"] + F.when(w > F.get(new, acc["at"]), 1).otherwise(0)
            return F.struct(at.alias("at"), (acc["n"] + F.when(F.get(new, at) == w, 1).otherwise(0)).alias("n"))

        return step

    count = lambda x: F.aggregate(x["o"], F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), walk(x["new"]), lambda acc: acc["n"])
    return F.get(F.transform(once, lambda x: F.try_divide(count(x), F.size(x["o"]))), F.lit(0))


def length_ratio(source: Column, output: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(output), F.length(source)), F.lit(0.0))


def surface_score(text: Column, level: Column) -> Column:
    """100 less 10 for a run of blanks, 10 for one of empty lines, 15 for an empty bullet, and 15 for a long rewrite without
    a sentence or list in it."""
    has = lambda p: text.rlike(p)
    long = level.isin("editorial_polish", "full_revision") & (F.length(text) > 180) & ~has(r"[.!?]\s|\n[-*+#>]")
    less = lambda c, v: F.when(c, v).otherwise(0.0)
    return 100.0 - less(has(r"[ \t]{3,}"), 10.0) - less(has(r"\n{4,}"), 10.0) - less(has(r"(?md)^[-*+]\s*$"), 15.0) - less(long, 15.0)


def form_score(source: Column, output: Column, level: Column, form: Column) -> Column:
    """100 less what goes beyond the light form that a level allows."""
    n = lambda c, p: F.regexp_count(c, F.lit("(?md)" + p))
    h, heads, items = {c: (n(t, HEADING), n(t, ITEM), n(t, BOLD)) for c, t in (("s", source), ("o", output))}, by_level(level, GROWTH, 0), by_level(level, GROWTH, 1)
    (sh, sl, sb), (oh, ol, ob) = h["s"], h["o"]
    less = lambda c, v: F.when(c, v).otherwise(0.0)
    faults = (
        (form == "notes-light") & (oh > sh + heads), 35.0,
        (form == "notes-light") & (ob > sb + heads), 15.0,
        (form == "preserve-markdown") & (ol + oh < sl + sh), 25.0,
        (form == "memo-light") & (level != "format_only") & (oh == 0) & (ol == 0), 20.0,
        ol > sl + items, 20.0,
        (level == "format_only") & (output != source) & (ol + oh > sl + sh + 1), 25.0,
    )
    return F.greatest(F.lit(0.0), sum((-less(c, v) for c, v in zip(faults[::2], faults[1::2])), F.lit(100.0)))


def validate(cases: DataFrame) -> DataFrame:
    """cases (id, level, style, dominant, source, title, output, must array, critical array, must_not array, map_reduce,
    strategy, least_entities, entities, least_ratio, fail_below) to one row a check: (id, check, category, score, passed,
    hard_fail)."""
    s, o, level = F.col("source"), F.coalesce("output", F.lit("")), F.col("level")
    novel, ratio, most = novel_ratio(s, o), length_ratio(s, o), by_level(level, LENGTH, 1)
    soft, hard = by_level(level, NOVELTY, 0), by_level(level, NOVELTY, 1)
    least = F.least("least_ratio", F.when(level == "structured_notes", F.col("least_ratio")).otherwise(by_level(level, LENGTH, 0)))
    blank = (F.length(s) == 0) | (F.length(o) == 0)
    locale_points, locale_passed = locale_check(s, o, F.col("dominant"))
    latin = lambda found: F.filter(found, lambda t: t.rlike("[A-Za-z]"))
    mixed = (F.col("dominant") == "mixed-ko-en") | (s.rlike("[가-힣]") & (F.size(latin(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))) > 0))
    none_missing = lambda found: F.size(missing(found, o)) == 0
    fences = (F.length(o) - F.length(F.replace(o, F.lit("```"), F.lit("")))) / 3
    whole = (fences % 2 == 0) & ~o.rlike("(?md)" + EMPTY_HEADING) & ~o.rlike("(?md)" + EMPTY_ITEM)
    surface, form = F.when(F.trim(o) == "", 0.0).otherwise(surface_score(o, level)), form_score(s, o, level, F.col("style"))
    once: dict[str, Column] = {"_novel": novel, "_ratio": ratio, "_surface": surface, "_form": form, "_locale": locale_points, "_in_locale": locale_passed}  # computed once a row

    def must(name: str, category: str, good: Column) -> tuple:
        once[f"_{name}"] = good
        held = F.col(f"_{name}")
        return name, category, F.when(held, 100.0).otherwise(0.0), held, ~held

    novel, ratio, surface, form, locale_points, locale_passed = map(F.col, once)
    right_length = ratio.between(least, most)
    too_far = blank | (~right_length & ((ratio < F.least(F.col("fail_below"), least * 0.7)) | (ratio > most + 0.35)))
    checks = [
        must("required_fields", "accuracy", (F.coalesce("title", F.lit("")) != "") & (o != "")),
        must("required_tokens", "accuracy", none_missing(F.concat("must", "critical"))),
        must("forbidden_tokens", "hallucination", F.size(present(F.col("must_not"), o)) == 0),
        must("trace_strategy", "accuracy", F.col("strategy") == F.when(F.col("map_reduce"), "map_reduce").otherwise("single")),
        must("entity_guardrails", "accuracy", F.col("entities") >= F.col("least_entities")),
        ("locale_consistency", "locale", locale_points, locale_passed, ~locale_passed),
        must("mixed_language", "locale", ~mixed | none_missing(latin(F.col("must")))),
        must("numbers_kept", "accuracy", none_missing(F.array_distinct(F.concat(numbers(s), X.ascii_acronyms(s))))),
        must("numbers_added", "hallucination", F.size(F.array_except(numbers(o), numbers(s))) == 0),
        must("quotes_kept", "accuracy", none_missing(quoted(s))),
        (
            "novel_token_ratio",
            "hallucination",
            F.coalesce(F.greatest(F.lit(0.0), F.round(100 - F.greatest(F.lit(0.0), novel - soft) * 300, 2)), F.lit(0.0)),
            F.coalesce(novel <= soft, F.lit(False)),
            F.coalesce((novel > soft) & (novel > hard), F.lit(True)),
        ),
        ("length_ratio", "accuracy", F.when(blank, 0.0).when(right_length, 100.0).otherwise(F.greatest(F.lit(0.0), F.round(100 - F.abs(1 - ratio) * 150, 2))), ~too_far, too_far),
        ("fluency_surface", "fluency", surface, surface >= 60, F.trim(o) == ""),
        must("markdown_structure", "structure", whole),
        ("markdown_form", "structure", form, form >= 60, F.lit(False)),
    ]
    rows = [F.struct(F.lit(a).alias("check"), F.lit(b).alias("category"), c.cast("double").alias("score"), F.coalesce(d, F.lit(False)).alias("passed"), F.coalesce(e, F.lit(False)).alias("hard_fail")) for a, b, c, d, e in checks]
    return cases.withColumns(once).select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.*")


def case_scores(checks: DataFrame, judged: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, category scores, overall, hard_fail): means by category, 0.7 of them and 0.3 of a judge's (id, category,
    judge) where there is one, weighted; 0 overall on a hard fail."""
    means = checks.groupBy("id", "category").agg(F.avg("score").alias("mean"), F.bool_or("hard_fail").alias("hard_fail"))
    if judged is not None:
        means = means.join(judged, ["id", "category"], "left").withColumn("mean", F.when(F.col("judge").isNotNull(), 0.7 * F.col("mean") + 0.3 * F.col("judge")).otherwise(F.col("mean")))
    one = lambda c: F.max(F.when(F.col("category") == c, F.col("mean")))
    out = means.groupBy("id").agg(*[one(c).alias(c) for c in weights], F.bool_or("hard_fail").alias("hard_fail"))
    overall = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return out.withColumn("overall", F.when(F.col("hard_fail"), 0.0).otherwise(overall))


def run_summary(scores: DataFrame, passing: float = 70.0) -> DataFrame:
    """One row of scores (overall, hard_fail, latency_ms): mean, passes, hard fails, median and 95th percentile."""
    p = lambda x: F.percentile(F.col("latency_ms").cast("double"), F.lit(x))
    return scores.agg(
        F.count(F.lit(1)).alias("n"), F.avg("overall").alias("mean"), F.count_if((F.col("overall") >= passing) & ~F.col("hard_fail")).alias("passed"), F.count_if("hard_fail").alias("hard_fails"), p(0.5).alias("median_ms"), p(0.95).alias("p95_ms")
    )


def tier_summary(scores: DataFrame, passing: float = 70.0) -> DataFrame:
    return scores.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.median("overall").alias("median"), F.avg("overall").alias("mean"), F.count_if(F.col("overall") >= passing).alias("passed"))


def review_reasons(scores: DataFrame) -> DataFrame:
    """scores (id, manual, hard_fail, overall, judge_a, judge_b) to (id, reasons) of cases that a person should see."""
    r = F.array_compact(
        F.array(
            F.when(F.col("manual"), "manual"), F.when(F.col("hard_fail"), "hard_fail"), F.when(F.col("overall") < 70, "low_score"), F.when(F.abs(F.col("judge_a") - F.col("judge_b")) >= 15, "judges_disagree")
        )
    )
    return scores.select("id", r.alias("reasons")).where(F.size("reasons") > 0)


def needs_second_judge(mode: str, manual: Column, hard_fail: Column, overall: Column, least_primary: Column) -> Column:
    if mode in ("none", "all"):
        return F.lit(mode == "all")
    return manual | hard_fail | (overall < 85) | (least_primary <= 3)


def length_sample(docs: DataFrame, n: int, least: int = 80, text: str = "text") -> DataFrame:
    """A round-robin sample of n over long (from 2000 characters), medium (from 600) and short texts, each newest first."""
    size = F.length(text)
    bucket = F.when(size >= 2000, 0).when(size >= 600, 1).otherwise(2)
    rows = docs.where(size >= least).withColumn("bucket", bucket)
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("updated_at"), "id"))).where(F.col("rn") <= n)
    return ranked.orderBy("rn", "bucket").limit(n)


def coverage_sample(cases: DataFrame, n: int, by: str = "category") -> DataFrame:
    """The best of each group first, then the best of the rest. cases: (id, by, rank)."""
    place = F.row_number().over(W.partitionBy(by).orderBy("rank", "id"))
    return cases.withColumn("first", place == 1).orderBy(F.desc("first"), "rank", "id").limit(n).drop("first")


def case_limit(requested: int, levels: int) -> int:
    return max(1, min(requested, 99 // levels))


def decide(scores: DataFrame, margin: float = 2.0) -> DataFrame:
    """scores (level, base, challenger, hard_fails) to a decision for each level."""
    better = F.col("challenger") - F.col("base")
    return scores.select("level", F.when(F.col("hard_fails") > 0, "reject").when(better >= margin, "adopt").when(better <= -margin, "reject").otherwise("keep").alias("decision"))


def salient_tokens(docs: DataFrame, most: int = 10) -> DataFrame:
    """docs (id, text) to the numbers and acronyms that recur, by count and then length: (id, token, n, rank)."""
    found = docs.select("id", F.explode(F.concat(X.numeric_tokens(F.col("text")), X.acronyms(F.col("text")))).alias("token"))
    counts = found.groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), F.desc(F.length("token")), "token"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


def coverage(tokens: DataFrame, outputs: DataFrame, passing: float = 0.8) -> DataFrame:
    """(id, ratio, passed): the share of each document's salient tokens that its output has."""
    both = tokens.join(outputs, "id")
    out = both.groupBy("id").agg((F.count_if(F.contains("output", F.col("token"))) / F.count(F.lit(1))).alias("ratio"))
    return out.withColumn("passed", F.col("ratio") >= passing)


def retarget(checks: DataFrame, covered: DataFrame) -> DataFrame:
    """checks with the three token checks replaced by coverage checks: covered (id, kind, ratio, least), a row for each kind of
    token, fails hard below ``least``."""
    kept = checks.where(~F.col("check").isin("required_tokens", "numbers_kept", "quotes_kept"))
    good = F.col("ratio") >= F.col("least")
    new = covered.select("id", F.concat(F.col("kind"), F.lit("_coverage")).alias("check"), F.lit("accuracy").alias("category"), F.round(100 * F.col("ratio"), 2).alias("score"), good.alias("passed"), (~good).alias("hard_fail"))
    return kept.select(*new.columns).unionByName(new)


def eligible(cases: DataFrame, requested: int, levels: int, ids: list | None = None) -> DataFrame:
    """Cases for a run over ``levels`` levels: those that need no map and reduce; the ids asked for, all of which must be
    there, or a sample with each category first (category, rank) as far as the budget of evaluations goes."""
    good = cases.where(~F.coalesce("map_reduce", F.lit(False)))
    if not ids:
        return coverage_sample(good, case_limit(requested, levels))
    found = good.where(F.col("id").isin(ids))
    known = {r.id for r in found.select("id").distinct().collect()}  # as many as were asked for
    if lost := [i for i in ids if i not in known]:
        raise ValueError(f"unknown cases, or cases that need map and reduce: {lost}")
    return found


def simulate_policies(cases: DataFrame, policies: tuple = POLICIES) -> DataFrame:
    """cases (id, expected, left_name, right_name, left, right vectors, seeds array of (name, vector)) to (id, policy, left_id,
    right_id, merged): each case in a store of its own, the seeds there first, the left name resolved and then the right.

    A name takes the first seed (or the left name) that its policy matches: an equal normal name; a shared key of the alias
    index, if it leads to one only; then the nearest by vector among so many, if it shares a key or is near enough.
    Places are 0.. for seeds and then the names, so -1 and -2 stand for left and right as new concepts."""
    norm = N.normalize
    entry = lambda name, vector, place: F.struct(norm(name).alias("n"), name.alias("name"), N.alias_keys(name, True).alias("index"), N.alias_keys(name).alias("keys"), vector.cast("array<double>").alias("v"), place.cast("int").alias("place"))

    def resolve(store: Column, x: Column, least: float, k: int, keys: bool, index: bool) -> Column:
        exact = F.filter(store, lambda e: e["n"] == x["n"])
        shared = F.filter(store, lambda e: F.arrays_overlap(e["index"], x["index"]))
        near = F.slice(F.sort_array(F.transform(store, lambda e: F.struct(l2_squared(e["v"], x["v"]).alias("d2"), e["place"].alias("place"), e["keys"].alias("keys")))), 1, k)
        close = F.filter(near, lambda e: (1 - e["d2"] / 2 >= least) | (F.arrays_overlap(e["keys"], x["keys"]) if keys else F.lit(False)))
        first = F.get(exact, F.lit(0))["place"]
        by_index = F.when(F.size(shared) == 1, F.get(shared, F.lit(0))["place"]) if index else F.lit(None).cast("int")
        return F.coalesce(first, by_index, F.get(close, F.lit(0))["place"])

    seeds = F.transform(F.coalesce("seeds", F.array().cast(cases.schema["seeds"].dataType)), lambda s, i: entry(s["name"], s["vector"], i))
    out = None
    for name, least, k, keys, index in policies:
        left, right = entry(F.col("left_name"), F.col("left"), F.lit(-1)), entry(F.col("right_name"), F.col("right"), F.lit(-2))

        def both(e: Column, least=least, k=k, keys=keys, index=index) -> Column:
            one = F.coalesce(resolve(e["seeds"], e["l"], least, k, keys, index), F.lit(-1))
            return let(one, lambda a: F.struct(a.alias("left_id"), F.coalesce(resolve(F.when(a == -1, F.concat(e["seeds"], F.array(e["l"]))).otherwise(e["seeds"]), e["r"], least, k, keys, index), F.lit(-2)).alias("right_id")))

        asked = let(F.struct(seeds.alias("seeds"), left.alias("l"), right.alias("r")), lambda e: both(e))  # noqa: B023, PLW0108
        rows = cases.select("id", "expected", F.lit(name).alias("policy"), asked.alias("x")).select("id", "expected", "policy", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("merged", F.col("left_id") == F.col("right_id"))
