"""An index that follows its documents against one built anew, after every change."""

import random

import pytest

from loomgraph.operators import search as S
from loomgraph.operators import text_segments as X

SCHEMA = "id long, title string, text string, annotation string"


@pytest.mark.parametrize("ratio", [0.0, 4.0])
def test_changes_give_what_a_rebuild_gives(spark, tmp_path, ratio):
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice("red green blue sea-side sky night the of moon".split()) for _ in range(rng.randint(0, 12)))
    doc = lambda i: (i, rng.choice([None, line()]), line(), rng.choice([None, line()]))
    folder, now, state = str(tmp_path / "index"), {}, None
    state, counts = X.open_index(spark, folder), []
    batches = [(range(40), []), ([3, 4, 50], [7, 8, 999]), ([], [9, 50]), (range(60, 64), [3, 60]), ([7], [])]
    for added, gone in batches:
        rows = [doc(i) for i in added]
        for i in gone:
            now.pop(i, None)
        now.update({r[0]: r for r in rows})
        deleted = spark.createDataFrame([(i,) for i in gone], "id long") if gone else None
        state = X.changed(spark, state, spark.createDataFrame(rows, SCHEMA), deleted, ratio=ratio)
        assert X.open_index(spark, folder) == state
        counts.append(len(state.segments))
        anew = S.text_index(spark.createDataFrame(list(now.values()), SCHEMA))
        assert state.n == len(now)
        for q in ("red", '"sea-side" the', "of moon night"):
            got, want = ({r.id: round(r.score, 9) for r in S.keyword_search(i, q, None).collect()} for i in (state.index(spark), anew))
            assert got == want
    assert counts == [1, 2, 3, 3, 4] if ratio == 0.0 else max(counts) <= 3


def test_merges_keep_the_number_of_segments_low(spark, tmp_path):
    state = X.open_index(spark, str(tmp_path / "index"))
    for k in range(9):
        state = X.changed(spark, state, spark.createDataFrame([(10 * k + i, None, f"word{i} common", None) for i in range(4)], SCHEMA), ratio=2.0)
    assert state.n == 36 and len(state.segments) <= 4
    assert S.keyword_search(state.index(spark), "common", None).count() == 36


def test_a_change_that_breaks_off(spark, tmp_path, monkeypatch):
    """Without a manifest a segment isn't there."""
    folder = str(tmp_path / "index")
    state = X.changed(spark, X.open_index(spark, folder), spark.createDataFrame([(1, "a", "red", None)], SCHEMA))
    monkeypatch.setattr(X, "_committed", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        X.changed(spark, state, spark.createDataFrame([(2, "b", "red", None)], SCHEMA))
    assert X.open_index(spark, folder) == state and [r.id for r in S.keyword_search(X.open_index(spark, folder).index(spark), "red").collect()] == [1]
    empty = X.open_index(spark, str(tmp_path / "none"))
    assert (empty.n, empty.segments) == (0, ())


@pytest.mark.parametrize("most", [1, 7, 2_000_000])
def test_postings_are_made_without_a_shuffle(spark, most):
    """Counted by hand in runs of any length, documents without tokens included, and no exchange in the plan."""
    docs = [(1, None, "red the Red", "the"), (2, "blue", "", None), (3, None, None, None), (4, "the", "été the red red", "red"), (5, "", "x1 " * 20, "a")]
    rows = S.posting_rows(spark.createDataFrame(docs, SCHEMA), X.TEXTS, most=most)
    want = []
    for i, *texts in docs:
        words = [(w, n + k * (1 << 40)) for k, t in enumerate(texts) for n, w in enumerate((t or "").lower().translate(str.maketrans(S.MARKED, S.PLAIN)).split())]
        want.append((None, i, 0, [], len(words)))
        for w in {w for w, _ in words}:
            at = [p for x, p in words if x == w]
            want.append((w, i, len(at), at, len(words)))
    key = lambda r: (r[1], r[0] or "")
    assert sorted([tuple(r) for r in rows.collect()], key=key) == sorted(want, key=key)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
