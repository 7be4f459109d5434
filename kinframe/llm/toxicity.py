"""Toxicity as a cumulative-link ordinal regression over sparse word features.

``P(grade <= k) = logistic(theta_k - w.x)``: one weight vector is shared by all ordered
thresholds, and the expected severity is ``sum_k P(grade > k)``. ``x`` marks which words
of a learned vocabulary occur in a text (ASCII letters lowered, punctuation dropped), so
a long text is not diluted.

What is learned comes from at most ``max_rows`` labelled documents, the lowest by hash of
their id (the documented bound of the fit). Word counts by grade are summed by Spark over
those documents; words whose occurrence departs from the base rate by ``min_z`` standard
errors in at least ``min_docs`` documents form the vocabulary, at most ``max_words`` of
them. The fit itself sees only those words, so its size is bounded by the two parameters.

Rows: a null text and a text without known words score by the thresholds alone. Labels
with a null grade or id are left out; of several labels of one id the highest counts.
Repeated rows are scored one by one. Without labels of at least two grades there is no
evidence: severity is 0 everywhere and nothing is toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm.words import ALNUM_WORDS, Words, slices, texts_of

MAX_ROWS = 50_000
MAX_WORDS = 20_000
MIN_DOCS = 5
MIN_Z = 6.0
RIDGE = 0.01
STEPS = 1200
TOXIC_AT = 0.3


@dataclass(frozen=True)
class Model:
    """Sorted word hashes with their weights, and the ordered thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, margin: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` per row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, grade_col: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(doc_id, text, grade)`` of the labelled documents used for fitting.

    The sampled labels are at most ``max_rows`` rows of two numbers, which bounds the
    broadcast; the texts are not shuffled.
    """
    grades = labels.where(F.col(grade_col).isNotNull() & F.col("doc_id").isNotNull())
    grades = grades.groupBy("doc_id").agg(F.max(grade_col).cast("int").alias("grade"))
    # Only hashes below a level that about twice the number stay under are sorted.
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(2.0**63)
    level = 2 * max_rows / max(1, grades.count())
    grades = grades.withColumn("place", place).where(F.col("place") < level)
    grades = grades.orderBy("place", "doc_id").limit(max_rows).drop("place")
    return docs.select("doc_id", "text").join(F.broadcast(grades), "doc_id")


def _rows(batch: pa.RecordBatch):
    """Distinct (row, word hash) pairs of a batch, by row."""
    w = Words(texts_of(batch, "text"), ALNUM_WORDS)
    for i in range(batch.num_rows):
        yield i, np.unique(w.hash[w.first[i] : w.first[i + 1]])


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _word_table(sample: DataFrame) -> DataFrame:
    """``(word, grade, n)``: documents of the sample by word and grade."""

    def run(batches):
        for batch in slices(batches, "text"):
            grade = batch.column("grade").to_numpy(zero_copy_only=False)
            words, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, h in _rows(batch):
                words.append(h)
                marks.append(np.full(len(h), grade[i], np.int64))
            h, g = np.concatenate(words), np.concatenate(marks)
            order = np.lexsort((g, h))
            h, g = h[order], g[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, int)
            n = np.diff(np.concatenate([new, [len(h)]]))
            yield pa.RecordBatch.from_arrays([_signed(h[new]), pa.array(g[new]), pa.array(n.astype(np.int64))], ["word", "grade", "n"])

    return sample.mapInArrow(run, "word long, grade long, n long").groupBy("word", "grade").agg(F.sum("n").alias("n"))


def vocabulary(sample: DataFrame, totals: dict[int, int], max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS, min_z: float = MIN_Z) -> np.ndarray:
    """Sorted hashes of the words whose share of positive grades departs from the base rate."""
    base = sum(n for g, n in totals.items() if g > 0) / sum(totals.values())
    by_word = _word_table(sample).groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).alias("pos"))
    z = F.abs(F.col("pos") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
    kept = by_word.where(F.col("n") >= min_docs).withColumn("z", z).where(F.col("z") >= min_z)
    rows = kept.orderBy(F.desc("z"), "word").limit(max_words).select("word").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _features(sample: DataFrame, words: np.ndarray, max_rows: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sampled document its grade and word positions (row lengths, flat positions).

    ``max_rows`` bounds the rows where documents repeat a labelled id: the lowest by hash
    of id and text, equal rows once.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            found = [np.searchsorted(words, h[np.isin(h, words)]).astype(np.int32) for _, h in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(found, pa.list_(pa.int32())), batch.column("place")], ["doc_id", "grade", "at", "place"])

    place = F.lit(0).cast("long") if max_rows is None else F.xxhash64("doc_id", "text")
    id_type = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.withColumn("place", place).mapInArrow(run, f"doc_id {id_type}, grade int, at array<int>, place long")
    if max_rows is not None:
        rows = rows.dropDuplicates(["doc_id", "place"]).orderBy("place", "doc_id").limit(max_rows)
    rows = rows.orderBy("doc_id").collect()
    lengths = np.array([len(r["at"]) for r in rows], np.int64)
    flat = np.array([p for r in rows for p in r["at"]], np.int64)
    return np.array([r["grade"] for r in rows], np.int64), lengths, flat


def fit(grade: np.ndarray, lengths: np.ndarray, flat: np.ndarray, n_words: int, ridge: float = RIDGE, steps: int = STEPS):
    """Weights and thresholds by accelerated gradient descent on the penalised likelihood.

    Thresholds are a first value and positive gaps, so they stay ordered.
    """
    n, levels = len(grade), int(grade.max())
    row = np.repeat(np.arange(n), lengths)
    share = np.array([(grade <= k).mean() for k in range(levels)])
    logit = np.log(share + 1e-6) - np.log(1 - share + 1e-6)
    first, gaps = logit[0], np.log(np.maximum(np.diff(logit), 1e-2))
    params = np.concatenate([np.zeros(n_words), [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for t in range(1, steps + 1):
        w, first, gaps = params[:n_words], params[n_words], params[n_words + 1 :]
        theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        margin = np.bincount(row, w[flat], n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = edges[grade + 1] - margin, edges[grade] - margin
        fh, fl = np.where(np.isinf(hi), 1.0, sig(hi)), np.where(np.isinf(lo), 0.0, sig(lo))
        p = np.maximum(fh - fl, 1e-12)
        dh, dl = fh * (1 - fh) / p, fl * (1 - fl) / p
        g_margin = (dh - dl) / n
        g_theta = np.zeros(levels)
        np.add.at(g_theta, grade[grade < levels], -dh[grade < levels] / n)
        np.add.at(g_theta, grade[grade > 0] - 1, dl[grade > 0] / n)
        grad = np.concatenate(
            [
                np.bincount(flat, g_margin[row], n_words) + ridge / n * w,
                [g_theta.sum()],
                [np.exp(gaps[j]) * g_theta[j + 1 :].sum() for j in range(levels - 1)],
            ]
        )
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = params[n_words + 1 :]
    return params[:n_words], params[n_words] + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def severity_grades(grade: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Split a yes/no label into 0, 1 and 2: the toxic half with more known words is severe."""
    if grade.max(initial=0) > 1 or not (grade > 0).any():
        return grade
    middle = np.median(lengths[grade > 0])
    return np.where(grade > 0, 1 + (lengths > middle), 0)


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "toxic", max_rows: int = MAX_ROWS, **limits) -> Model:
    """Fit the regression. Labels with grades above 1 are used as they are."""
    sample = labelled_sample(docs, labels, grade_col, max_rows)
    totals = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if len(totals) < 2 or min(totals) < 0:
        return none
    words = vocabulary(sample, totals, **limits)
    grade, lengths, flat = _features(sample, words, max_rows if sum(totals.values()) > max_rows else None)
    if not grade.size or grade.min() == grade.max():
        return none
    weights, thresholds = fit(severity_grades(grade, lengths), lengths, flat, len(words))
    return Model(words, weights, thresholds)


def _margins(m: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the sum of the weights of its known words, and how many there are."""
    n = batch.num_rows
    if not len(m.words):
        return np.zeros(n), np.zeros(n, np.int32)
    w = Words(texts_of(batch, "text"), ALNUM_WORDS)
    at = np.minimum(np.searchsorted(m.words, w.hash), len(m.words) - 1)
    hit = m.words[at] == w.hash
    pair = np.unique(w.text_of()[hit] * len(m.words) + at[hit])
    row = pair // len(m.words)
    return np.bincount(row, m.weights[pair % len(m.words)], n), np.bincount(row, minlength=n).astype(np.int32)


def score(docs: DataFrame, model: Model, keep: list[str], toxic_at: float = TOXIC_AT) -> DataFrame:
    """The ``keep`` columns with severity, the probability of any toxicity, grade and flag.

    The text is read, but only returned if ``keep`` names it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    added = "severity double, p_toxic double, grade int, n_known int, toxic boolean"

    def run(batches):
        m = shared.value
        for batch in slices(batches, "text"):
            n = batch.num_rows
            margin, known = _margins(m, batch)
            above = m.above(margin) if len(m.thresholds) else np.zeros((n, 1))
            cells = np.column_stack([1 - above[:, 0], above[:, :-1] - above[:, 1:], above[:, -1]])
            columns = [above.sum(1), above[:, 0], cells.argmax(1).astype(np.int32), known, above[:, 0] >= toxic_at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, columns)], [*keep, "severity", "p_toxic", "grade", "n_known", "toxic"])

    source = docs if "text" in keep else docs.select(*keep, "text")
    return source.mapInArrow(run, f"{fields}, {added}")


def drop_toxic(docs: DataFrame, model: Model, toxic_at: float = TOXIC_AT) -> DataFrame:
    """``docs`` without the documents whose probability of any toxicity reaches ``toxic_at``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in slices(batches, "text"):
            margin, _ = _margins(m, batch)
            above = m.above(margin)[:, 0] if len(m.thresholds) else np.zeros(batch.num_rows)
            yield batch.filter(pa.array(above < toxic_at))

    return docs.mapInArrow(run, docs.schema)
