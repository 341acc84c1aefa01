"""The render chain against plain Python on small documents."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import artifacts as A
from loomgraph.functions import replies as J
from loomgraph.functions import text as X


def key(x):
    return re.sub(r"\s+", " ", re.sub(r"^(?:#{1,6}\s+|[-*+]\s+)", "", x.strip()))


def tokens(t):
    n = lambda p: sum(map(len, re.findall(p, t)))
    return math.ceil(n("[A-Za-z0-9]") / 4) + math.ceil(n("[가-힣]") / 2) + math.ceil(n(r"[^\w\s]") / 2)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta 학습 윤리 epsilon zeta 12% NASA".split()) for _ in range(n))


def made(rng):
    """Documents of artifacts: a list of (heading, topic, quote, numeric, support) lists a chunk."""
    out = []
    for _ in range(rng.randint(1, 6)):
        some = lambda most, mark="": [mark + sentence(rng, rng.randint(1, 60)) for _ in range(rng.randint(0, most))]
        out.append({"title": [], "heading": some(1, "# "), "topic": some(4), "quote": some(3, "“q” "), "numeric": some(3), "support": some(3) + (["copyright notice"] if rng.random() < 0.3 else [])})
    return out


def planned(doc, title, level):
    s, rows, section = A.STRATEGIES[level], [], 0
    for i, a in enumerate(doc):
        section += bool(a["heading"])
        rows += [(i, section, k, x) for k in A.BODY for x in a[k] if not x.startswith("copyright")]
    lines, keys, taken = [title] if title else [], set(), []

    def add(r):
        if r in taken_set() or key(r[3]) in keys or tokens("\n\n".join(lines + [r[3]])) > s["evidence"]:
            return False
        lines.append(r[3])
        keys.add(key(r[3]))
        taken.append(r)
        return True

    taken_set = lambda: taken
    count = lambda k: sum(t[2] == k for t in taken)
    of = lambda k: [r for r in rows if r[2] == k]
    for r in of("heading"):
        if count("heading") < s["heading"]:
            add(r)
    for k in ("topic", "quote", "numeric"):
        moved = True
        while moved and count(k) < s[k]:
            moved = False
            for x in sorted({r[1] for r in of(k)}):
                if count(k) < s[k] and any(add(r) for r in of(k) if r[1] == x):
                    moved = True
    for k in ("topic", "quote", "numeric"):
        for r in of(k):
            add(r)
    for r in of("support"):
        if count("support") < s["support"]:
            add(r)
    return sorted((i, k, x) for i, _, k, x in taken)


SCHEMA = "id long, title string, artifacts array<struct<title:array<string>,heading:array<string>,topic:array<string>,quote:array<string>,numeric:array<string>,support:array<string>,polished:string>>"


@pytest.mark.parametrize("level", ["light_cleanup", "structured_notes", "full_revision"])
def test_render_plan(spark, level):
    rng = random.Random(level)
    docs = [made(rng) for _ in range(40)]
    rows = [(i, "A title" if i % 3 else None, [(*[a[k] for k in A.KINDS], None) for a in d]) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = A.plan(F.col("artifacts"), F.col("title"), level)
    got = df.select("id", "title", plan.alias("plan"), A.render(plan, F.col("title"), level).alias("text")).collect()
    for r in got:
        want = planned(docs[r.id], r.title, level)
        assert sorted((c.chunk, k, x) for c in r.plan for k in A.BODY for x in c[k]) == want
        assert r.text == rendered(r, level)


def rendered(r, level):
    head = lambda x, m: f"{m} " + re.sub(r"^#{1,6}\s+", "", x).strip()
    item = lambda x: x if re.match(r"(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|>\s+)|(?:figure|table)\s+\d|\[\d+\]", x) else f"- {x}"
    out, seen = [head(r.title, "#")] if r.title else [], set()
    for c in r.plan:
        heads, body, kept = [head(x, "##") for x in c.heading], list(c.topic) + list(c.support), list(c.quote) + list(c.numeric)
        if level == "light_cleanup":
            blocks = heads + [item(x) for x in body + kept]
        else:
            blocks = heads + ([" ".join(body)] if len(body) > 1 else body)
            blocks += [item(x) for x in kept if x not in blocks]
        for b in blocks:
            if b.startswith("## "):
                if key(b) in seen:
                    continue
                seen.add(key(b))
            if not out or tokens("\n\n".join(out + [b])) <= A.STRATEGIES[level]["output"]:
                out.append(b)
    return "\n\n".join(out).strip() or None


def test_compressed(spark):
    rng = random.Random(5)
    lists = [[[f"{rng.choice(['', '- ', '# '])}{sentence(rng, rng.randint(1, 9))} {rng.randint(0, 9)}" for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(1, 4))] for _ in range(40)]

    def firsts(lines):
        out = {}
        for x in lines:
            out.setdefault(key(x), x)
        return list(out.values())

    lists = [[firsts(x) for x in d] for d in lists]
    quoted = lambda lines: '{"evidence_lines": [' + ", ".join(f'"{x}"' for x in lines) + "]}"

    def by_hand(d, budget):
        n, best, moved = [0] * len(d), [], True
        while moved:
            moved = False
            for i in range(len(d)):
                if n[i] < len(d[i]):
                    more = firsts(x for j, own in enumerate(d) for x in own[: n[j] + (i == j)])
                    if tokens(quoted(more)) <= budget:
                        n[i], best, moved = n[i] + 1, more, True
        return best or firsts(x for own in d for x in own[:1])

    df = spark.createDataFrame(list(enumerate(lists)), "id long, lists array<array<string>>")
    for budget in (5, 60, 120, 10_000):
        got = {r.id: r.x for r in df.select("id", A.compressed(F.col("lists"), budget).alias("x")).collect()}
        assert got == {i: by_hand(d, budget) for i, d in enumerate(lists)}


def test_titles(spark):
    cases = [
        (["Figure 1. x", "Great results", "# Head"], ["ab", "An entity"], "Great results"),
        (["Great results", "More text"], ["ab", "An entity"], "An entity"),
        (["Great results"], ["ab"], "Great results"),
        (["12 monkeys"], [], "12 monkeys"),
        (["- " + "x" * 130], [], "x" * 117 + "..."),
        ([], [], None),
    ]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "id long, f array<string>, n array<string>").select("id", A.title_of(F.col("f"), F.col("n")).alias("t")).collect()
    assert {r.id: r.t for r in got} == {i: c for i, (*_, c) in enumerate(cases)}


def test_artifact_falls_back_to_lines_and_chunk(spark):
    reply = '{"topic_lines": ["the learning rate matters a great deal here", 5, "  "], "polished_block": " P "}'
    chunk = "It was said “never again” twice. In 1984 NASA flew 3 missions."
    cases = [(1, reply), (2, '{"evidence_lines": ["My title", "# Head", "“Quoted” words", "In 1984 NASA flew"]}'), (3, "{}"), (4, None)]
    df = spark.createDataFrame([(i, r, chunk) for i, r in cases], "id long, reply string, chunk string")
    got = {r.id: r.a for r in df.select("id", A.artifact(F.col("reply"), F.col("chunk"), "structured_notes").alias("a")).collect()}
    assert got[1].topic == ["the learning rate matters a great deal here"] and got[1].polished == "P"
    assert got[1].quote == ["It was said “never again” twice."] and got[1].numeric == ["In 1984 NASA flew 3 missions."]
    assert (got[2].title, got[2].heading, got[2].quote, got[2].numeric) == (["My title"], ["# Head"], ["“Quoted” words"], ["In 1984 NASA flew"])
    assert got[3].quote == got[4].quote == [] and got[3].title == ["It was said “never again” twice."]


def test_stitched(spark):
    lines = ["My title", "# Part", "first words", "end of it.", "- item", "Figure 2. Shown", "alone.", "x" * 3000, "He said “yes” then", "some 12 of 40 and 7"]
    df = spark.createDataFrame([(lines,)], "f array<string>")
    one = lambda level: df.select(A.stitched(F.col("f"), level).alias("t")).first().t
    assert one("light_cleanup").split("\n\n")[:7] == ["# My title", "## Part", "- first words", "- end of it.", "- item", "Figure 2. Shown", "- alone."]
    assert one("full_revision").split("\n\n")[:6] == ["# My title", "## Part", "first words end of it.", "- item", "Figure 2. Shown", "alone."]
    assert one("structured_notes").split("\n\n")[:6] == ["# My title", "## Part", "first words end of it.", "- item", "Figure 2. Shown", "- alone."]
    assert one("light_cleanup").split("\n\n")[7:] == ["## Preserved Source Spans", "- He said “yes” then", "- some 12 of 40 and 7"]
    assert df.select(A.stitched(A.none(), "full_revision").alias("t")).first().t is None


def test_first_object():
    cases = {
        '{"a": 1}': '{"a": 1}', "```json\n{\"a\": 1}\n```": '{"a": 1}', 'Sure [see {"a": 2} there': '{"a": 2}', "[1, 2]": '{"items": [1, 2]}', "{bad} [3]": '{"items": [3]}',
        "": None, "5": None, '"{}"': None, "no": None, None: None, '{"한": "é"} {"b": 1}': '{"한": "é"}',
    }
    assert {k: J.first_object(k) for k in cases} == cases


def test_workers_get_only_the_texts_that_are_cut(spark, monkeypatch):
    """Short texts, and texts whose lines are the evidence, don't go to a Python worker."""
    monkeypatch.setattr(X, "split_chunks", lambda *a, **b: 1 / 0)
    lined, short = "one\ntwo\nthree\n" + "four " * 600, " some text "
    rows = spark.createDataFrame([(1, lined), (2, short), (3, None), (4, "")], "id int, text string")
    got = {r.id: (r.e, r.c) for r in rows.select("id", X.fallback_evidence(F.col("text")).alias("e"), X.chunks(F.col("text")).alias("c")).collect()}
    assert got == {1: (["one", "two", "three", ("four " * 600).strip()], [lined]), 2: ([short], [short]), 3: ([], [""]), 4: ([], [""])}


def test_lists_under_an_escaped_key(spark):
    replies = [r'{"evidence_lines": ["a", 1, " b "]}', r'{"evidence\u005flines": ["c"]}', '{"other": ["d"]}', '{"evidence_lines": "e"}', None]
    rows = spark.createDataFrame(list(enumerate(replies)), "id int, reply string")
    got = {r.id: r.x for r in rows.select("id", A.strings_of(F.col("reply"), "evidence_lines").alias("x")).collect()}
    assert got == {0: ["a", "b"], 1: ["c"], 2: [], 3: None, 4: []}
