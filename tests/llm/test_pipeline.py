"""The pipeline against its stages done by hand on what each was given."""

from collections import Counter

import pytest

from .conftest import SMALL

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    from loomgraph.llm import decontaminate, mixing, quality, simhash
    from loomgraph.llm.common import staged, table

    docs = table(spark, SMALL, "documents")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SMALL), "stage")
        steps[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    kept = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = steps["quality classifier"]
    report = quality.quality_report(before, quality.grades_of(table(spark, SMALL, "labels"))).where("kept")
    assert kept(after) == kept(report) and len(kept(after)) > 0.7 * before.count()

    before, after = steps["exact dedup"]
    best = {}
    for r in before.collect():
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    assert kept(after) == set(best.values())

    before, after = steps["SimHash near-dedup"]
    groups = simhash.near_groups(before, **corpus_pipeline.NEAR)
    assert kept(after) == {r.component_id for r in groups.collect()}

    before, after = steps["benchmark decontamination"]
    items = {r.item_id: r.text for r in table(spark, SMALL, "benchmark").collect()}
    by_hand = decontaminate.brute_force({r.doc_id: r.text for r in before.collect()}, items)
    assert kept(after) == {d for d, x in by_hand.items() if not x[1]}

    before, after = steps["mixing sources to target weights"]
    taken = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken}
    assert {r.doc_id: r.taken for r in after.collect()} == taken


def test_odd_tables(spark, odd, empty):
    for df in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SMALL)
            rows = out.collect()
            assert set(df.columns) <= set(out.columns) and len(rows) <= df.count() and (rows or name != "exact dedup" or not df.count())


def test_stages_act_on_rows(spark, odd):
    """A null id, a repeated row, and rows that share an id but not a text."""
    from loomgraph.llm import mixing
    from loomgraph.llm.common import table

    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()]
    more = [(None, "a text without an id", "en", "a"), (None, rows[0][1], "en", "a"), (2, "a text that only this row has", "en", "a")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string")

    out = stages["exact dedup"](spark, docs, SMALL)
    assert ids(out) == Counter([2, 2, None, 4, 5, 6, 7, 8, 9]) and len({r.text for r in out.collect()}) == 9
    out = stages["SimHash near-dedup"](spark, docs, SMALL)
    assert ids(out) == Counter([1, 2, None, 3, 6, 8, 9])
    assert {r.text for r in out.collect() if r.doc_id == 2} == {"a text that only this row has"}

    leak = table(spark, SMALL, "benchmark").first().text
    some = spark.createDataFrame([(1, leak), (1, "clean"), (None, leak), (None, "clean too")], "doc_id long, text string")
    assert Counter(map(tuple, stages["benchmark decontamination"](spark, some, SMALL).collect())) == Counter([(1, "clean"), (None, "clean too")])

    taken = Counter((r.doc_id, r.taken) for r in mixing.mix(docs).collect() if r.taken)
    got = stages["mixing sources to target weights"](spark, docs, SMALL)
    assert Counter((r.doc_id, r.taken) for r in got.collect()) == taken
    assert None in ids(got)
    assert all(sum(d.n for d in r.draws) == r.taken and all(0 <= d.start and d.start + d.n <= r.size for d in r.draws) for r in got.collect())
