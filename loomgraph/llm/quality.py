"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) is the logistic of threshold k minus one score, the sum of hashed text weights that all grades
share. Thresholds are ordered. A document's features are its distinct lower-cased words and their stems (first
bytes of longer words, so that an inflected word is known by its beginning), hashed, and its style in steps (length,
shares of capitals, digits, marks and repeated words), so one rude word in a long text counts as much as in a short
one. The model gives an expected grade and, for selection, the probability of a grade or more.

It is fitted on at most ``max_rows`` rated rows, those of least hashed id; Spark counts their features, the
driver holds those that tell grades apart, and everything is scored with the model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, row_keyed, staged

BITS = 20
STEMS = (4, 5, 6)  # bytes


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature numbers below 2^BITS. A text always has its style features."""
    text = text or b""
    words = text.translate(WORD_BYTES).split()
    kinds = set(words)
    letters = np.frombuffer(text, np.uint8)
    n = max(len(letters), 1)
    share = lambda low, high: int(10 * np.count_nonzero((letters >= low) & (letters <= high)) / n)
    marks = int(20 * np.count_nonzero((letters < 128) & ~((letters | 32) - 97 < 26) & ((letters < 48) | (letters > 57)) & (letters > 32)) / n)
    style = {
        f"size {len(words).bit_length()}",
        f"capitals {share(65, 90)}",
        f"digits {share(48, 57)}",
        f"marks {marks}",
        f"variety {int(10 * len(kinds) / max(len(words), 1))} {min(len(words).bit_length(), 8)}",
        f"word length {min(int(len(text) / max(len(words), 1)), 20)}",
        f"most repeated {_top_share(words)}",
    }
    stems = {w[:n] for n in STEMS for w in kinds if len(w) > n}
    hashed = {zlib.crc32(w) & ((1 << BITS) - 1) for w in kinds}
    hashed |= {zlib.crc32(b"\1" + w) & ((1 << BITS) - 1) for w in stems}
    hashed |= {zlib.crc32(b"\0" + s.encode()) & ((1 << BITS) - 1) for s in style}
    return np.sort(np.fromiter(hashed, np.int32, len(hashed)))


def _top_share(words: list[bytes]) -> int:
    if not words:
        return 0
    from collections import Counter

    return int(10 * Counter(words).most_common(1)[0][1] / len(words))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one fewer than grades

    def score(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sum of the weights of each row's features, laid end to end; 0 for a row without any."""
        if sizes.all():
            return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes) if len(sizes) else np.empty(0)
        return np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.weights[flat], len(sizes))

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., a column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def log_likelihood(m: OrdinalModel, flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray) -> float:
    """Mean log-probability of the grades."""
    edge = np.concatenate((np.full((len(grades), 1), 1.0), m.tails(m.score(flat, sizes)), np.zeros((len(grades), 1))), axis=1)
    p = edge[np.arange(len(grades)), grades] - edge[np.arange(len(grades)), grades + 1]
    return float(np.log(np.maximum(p, 1e-12)).mean())


def gradients(m: OrdinalModel, flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of minus the mean log-likelihood, by weight and by threshold."""
    k, y = len(m.thresholds) + 1, grades
    score = m.score(flat, sizes)
    upper = np.where(y < k - 1, m.thresholds[np.minimum(y, k - 2)] - score, 30.0)
    lower = np.where(y > 0, m.thresholds[np.maximum(y - 1, 0)] - score, -30.0)
    pu, pl = _sigmoid(upper), _sigmoid(lower)
    du, dl, p = pu * (1 - pu) * (y < k - 1), pl * (1 - pl) * (y > 0), np.maximum(pu - pl, 1e-9)
    g = np.bincount(flat, np.repeat((du - dl) / p, sizes), len(m.weights)) / len(y)
    return g, (np.bincount(y, dl / p, k)[1:] - np.bincount(y, du / p, k)[:-1]) / len(y)


def fit_ordinal(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = 200, batch: int = 1024, rate: float = 0.3, l1: float = 1e-4, screen: float | None = 4.0, seed: int = 5) -> OrdinalModel:
    """Mini-batch AdaGrad on the log-likelihood with an L1 penalty, from the rows' features laid end to end and their
    numbers. Features whose rows reach each grade as often as all rows do, within ``screen`` standard errors, keep
    weight 0: a long text is then not the sum of many small errors. None if that was seen to before. Without rows every
    grade is equally likely; a row without features is scored by the thresholds alone."""
    base = np.arange(1, n_grades, dtype=float) / n_grades
    m = OrdinalModel(np.zeros(1 << BITS), np.log(base / (1 - base)))
    if not len(sizes):
        return m
    share = np.clip([np.mean(grades <= k) for k in range(n_grades - 1)], 1e-3, 1 - 1e-3)
    thresholds = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    tells = np.zeros(1 << BITS, bool)
    if screen is None:
        tells[flat] = True
    else:
        n = np.maximum(np.bincount(flat, minlength=1 << BITS), 1)
        for k in range(1, n_grades):
            high = (grades >= k).astype(float)
            rate_with = np.bincount(flat, np.repeat(high, sizes), 1 << BITS) / n
            tells |= np.abs(rate_with - high.mean()) * np.sqrt(n) > screen * max(high.std(), 1e-9)
        good = tells[flat]
        kept = np.concatenate(([0], np.cumsum(good, dtype=np.int32)))
        ends = np.cumsum(sizes)
        flat, sizes = flat[good], (kept[ends] - kept[ends - sizes]).astype(np.int64)
    chosen = np.flatnonzero(tells)  # the weights that are fitted
    flat = (np.cumsum(tells, dtype=np.int32) - 1)[flat]
    begin = np.concatenate(([0], np.cumsum(sizes)))
    fitted = OrdinalModel(np.zeros(len(chosen)), thresholds)
    rng, w2, t2 = np.random.default_rng(seed), np.full(len(chosen), 1e-6), np.full(n_grades - 1, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(sizes))
        for s in range(0, len(sizes), batch):
            part = order[s : s + batch]
            n = sizes[part]
            at = flat[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            g, gt = gradients(fitted, at, n, grades[part])
            w2 += g * g
            t2 += gt * gt
            step = rate / np.sqrt(w2)
            w = fitted.weights - step * g
            fitted.weights = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            fitted.thresholds = np.maximum.accumulate(fitted.thresholds - rate * gt / np.sqrt(t2) + 1e-9 * np.arange(n_grades - 1))
    m.weights[chosen], m.thresholds = fitted.weights, fitted.thresholds
    return m


def _features_of(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("features", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(b.num_columns - 1).cast(pa.binary())]
            if rows:
                at = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(at, pa.array(np.concatenate(rows), pa.int32()))], names=schema.names)

    return docs.select(*columns, text_col).mapInArrow(run, schema)


def telling(rated: DataFrame, n_grades: int, screen: float = 4.0) -> np.ndarray:
    """Numbers of the features that fit_ordinal's screen passes, counted by Spark over rated (grade, features)."""
    totals = {r.grade: r["count"] for r in rated.groupBy("grade").count().collect()}  # a row a grade
    every = sum(totals.values())
    kinds = rated.select("grade", F.explode("features").alias("feature")).groupBy("feature")
    counts = kinds.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("grade") >= k).alias(f"n{k}") for k in range(1, n_grades)])
    passed = F.lit(False)
    for k in range(1, n_grades):
        mean = sum(n for g, n in totals.items() if g >= k) / max(every, 1)
        passed |= F.abs(F.col(f"n{k}") / F.col("n") - mean) * F.sqrt("n") > screen * max((mean * (1 - mean)) ** 0.5, 1e-9)
    return counts.where(passed).select("feature").toArrow().column(0).to_numpy()


def only(rated: DataFrame, chosen: np.ndarray) -> DataFrame:
    """rated (grade, features) with the chosen features only, and a key of them."""
    mask = np.zeros(1 << BITS, bool)
    mask[chosen] = True
    shared = rated.sparkSession.sparkContext.broadcast(mask)  # 2^BITS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            flat, n = b.column(1).flatten().to_numpy(), b.column(1).value_lengths().to_numpy()
            good = shared.value[flat]
            at = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[good], minlength=len(n)))))
            flat = flat[good]
            key = [int(np.uint64(xxhash.xxh64_intdigest(flat[x:y].tobytes())).astype(np.int64)) for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32())), pa.array(key, pa.int64())], names=["grade", "features", "key"])

    return rated.select("grade", "features").mapInArrow(run, "grade int, features array<int>, key long")


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on ratings (id, grade from 0) of documents. Null ids, and grades that are null or out of range, are left out. At most
    ``max_rows`` rows are read, with their grades, in an order that a hash of the id gives: an id that stands in many rows of docs,
    or has many ratings, counts with each of them up to there."""
    rated = ratings.select(F.col(id_col), F.col("grade").cast("int").alias("grade")).where(F.col(id_col).isNotNull() & F.col("grade").between(0, n_grades - 1))
    order = (F.xxhash64(id_col), id_col, "grade")
    sample = rated.orderBy(*order).limit(max_rows)  # at most max_rows ids, so it may be broadcast
    keyed, row = row_keyed(docs.select(id_col, text_col))
    rows = keyed.select(id_col, row).join(F.broadcast(sample), id_col).orderBy(*order, row).limit(max_rows)  # an id may stand in any number of rows
    featured = staged(_features_of(keyed.join(F.broadcast(rows.select(row, "grade")), row), ["grade"], text_col), "rated-features")
    rows = only(featured, telling(featured, n_grades)).toArrow()
    order = pa.array(np.lexsort((rows.column("key").to_numpy(), rows.column("grade").to_numpy())))  # one order, whatever the partitions were
    features, grades = rows.column("features").combine_chunks().take(order), rows.column("grade").combine_chunks().take(order)
    del rows
    sizes, flat = features.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), features.flatten().to_numpy()
    return fit_ordinal(flat, sizes, grades.to_numpy(zero_copy_only=False).astype(int), n_grades, screen=None)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns to carry, expected_grade and tails (P(grade >= 1), P(grade >= 2), ...).

    Null and empty texts are scored by their style alone; repeated rows give repeated rows, an empty table none;
    other columns are not read."""
    given = [id_col, *(c for c in carry if c != id_col)]
    scores = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*docs.select(*given).schema.fields, *scores])
    columns = given if text_col in given else [*given, text_col]
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 2^BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = OrdinalModel(*shared.value)
        for b in batches:
            rows = [features(t.as_py()) for t in b.column(columns.index(text_col)).cast(pa.binary())]
            if rows:
                sizes = np.array([len(r) for r in rows])
                tails = m.tails(m.score(np.concatenate(rows), sizes).astype(float))
                at = pa.array(np.arange(len(rows) + 1) * tails.shape[1], pa.int32())
                out = [pa.array(tails.sum(axis=1)), pa.ListArray.from_arrays(at, pa.array(tails.ravel()))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(given)], *out], names=schema.names)

    return docs.select(*columns).mapInArrow(run, schema)


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ratings from the labels table: 0 poor, 1 toxic but well formed, 2 clean."""
    return labels.select(id_col, F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def quality_report(docs: DataFrame, ratings: DataFrame, least: float = 0.5, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, expected_grade, p_top (probability of the best grade) and kept (p_top of ``least`` or more)."""
    model = fit(docs, ratings, 3, max_rows, id_col, text_col)
    top = F.element_at("tails", -1)
    return score(docs, model, id_col, text_col).select(id_col, "expected_grade", top.alias("p_top"), (top >= least).alias("kept"))


def select_quality(docs: DataFrame, ratings: DataFrame, least: float = 0.5, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_report keeps, with their columns, in one pass and without a shuffle."""
    model = fit(docs, ratings, 3, max_rows, id_col, text_col)
    own = {c: f"_{k}" for k, c in enumerate(docs.columns)}  # whatever the columns are called
    scored = score(docs.withColumnsRenamed(own), model, own[id_col], own[text_col], tuple(own.values()))
    return scored.where(F.element_at("tails", -1) >= least).select(*[F.col(v).alias(c) for c, v in own.items()])
