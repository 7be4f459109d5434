"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words; only the bag has a label. Every
passage is encoded as ``h = tanh(W x + b)``, where ``x`` holds normalised counts of hashed
character shapes and words and a few measures of repetition. A gate gives each passage its
share of the document's attention, ``softmax(u . (tanh(V h) * sigmoid(G h)))``, the shares
weigh the passages into one vector, and a logistic unit scores that. ``W``, ``V``, ``G``,
``u`` and the unit are learned together from document labels, so the model finds out by
itself which passages tell good documents from bad ones.

The fit is bounded: at most ``max_docs`` labelled documents with ``max_bytes`` of text, the
first by a hash of their rows; a document with more than a sixteenth of those bytes is left
to the scores. Features of the sample are made by Spark, and the fit sees nothing else.
Scores read whole texts, all passages of them, in one pass without a shuffle.

Rows: a null text and a text without words is one passage without counts and gets a score
as any other. Labels with a null id or value are left out; several labels of one id count
as their mean. Repeated rows are scored one by one and so get equal scores. Without labels
every score is 0.5. Extra columns are ignored unless ``keep`` names them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinframe.llm.words import WHITESPACE_WORDS, Words, mix, slices, texts_of

PASSAGE = 64
SHAPES, WORDS, MEASURES = 512, 256, 4
WIDTH = SHAPES + WORDS + MEASURES
HIDDEN, GATE = 16, 8
MAX_DOCS = 4_000
MAX_BYTES = 32 << 20
STEPS = 300
RATE = 0.01
RIDGE = 1e-4
SCORE_SLICE = 1 << 20


def _shape_classes() -> np.ndarray:
    """A class per byte: letters by case, digits, line ends, spaces, marks, the rest by value."""
    kind = np.arange(256, dtype=np.uint8)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[128:] = 1  # letters outside ASCII, in any script
    return kind


_CLASS = _shape_classes()


def passages(texts: list[bytes | None], size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages as rows, and the number of passages of every text."""
    w = Words(texts, WHITESPACE_WORDS)
    counts = w.counts
    bags = np.maximum(-(-counts // size), 1)
    first = np.cumsum(bags) - bags
    owner = w.text_of()
    place = np.arange(len(owner)) - w.first[owner]
    of_word = first[owner] + place // size
    n = int(bags.sum())
    x = np.zeros((n, WIDTH), np.float32)
    x[:, -1] = np.repeat(np.log1p(bags) / 5, bags)
    if not len(owner):
        return x, bags
    # Shapes: three consecutive bytes by class, from the first to the last word of a passage.
    kinds = _CLASS[np.frombuffer(w.raw, np.uint8)].astype(np.uint64)
    code = mix(kinds[:-2] | kinds[1:-1] << np.uint64(8) | kinds[2:] << np.uint64(16)) % np.uint64(SHAPES)
    opens = np.flatnonzero(np.diff(of_word, prepend=-1))
    length = np.maximum(w.stop[np.append(opens[1:], len(owner)) - 1] - w.start[opens] - 2, 0)
    at_byte = np.repeat(w.start[opens] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    cell = np.repeat(of_word[opens], length) * SHAPES + code[at_byte].astype(np.int64)
    x[:, :SHAPES] = np.bincount(cell, minlength=n * SHAPES).reshape(n, SHAPES)
    bucket = (w.hash % np.uint64(WORDS)).astype(np.int64)
    x[:, SHAPES : SHAPES + WORDS] = np.bincount(of_word * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
    for a, b in ((0, SHAPES), (SHAPES, SHAPES + WORDS)):
        part = np.sqrt(x[:, a:b])
        x[:, a:b] = part / np.maximum(np.sqrt((part**2).sum(1, keepdims=True)), 1)
    n_words = np.bincount(of_word, minlength=n)
    order = np.lexsort((w.hash, of_word))
    again = (np.diff(w.hash[order]) == 0) & (np.diff(of_word[order]) == 0)
    repeats = np.bincount(of_word[order][1:][again], minlength=n)
    some = np.maximum(n_words, 1)
    x[:, -4] = repeats / some
    x[:, -3] = np.bincount(of_word, w.stop - w.start, n) / some / 10
    x[:, -2] = n_words / size
    return x, bags


@dataclass(frozen=True)
class Model:
    """Weights of the encoder, the two gates, the attention and the unit on top."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    g: np.ndarray
    u: np.ndarray
    c: np.ndarray
    c0: np.ndarray

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        """Scores per bag, attention per passage, and what the gradient needs."""
        first = np.cumsum(bags) - bags
        bag = np.repeat(np.arange(len(bags)), bags)
        # Features stay in their own precision; everything behind them is in double.
        h = np.tanh((x @ self.w.astype(x.dtype)).astype(np.float64) + self.b)
        t, s = np.tanh(h @ self.v), _logistic(h @ self.g)
        e = (t * s) @ self.u
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"p": _logistic(z @ self.c + self.c0[0]), "a": a, "z": z, "h": h, "t": t, "s": s, "bag": bag, "first": first}

    def gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, "Model"]:
        """The penalised log loss over all bags, and its gradient."""
        f = self.forward(x, bags)
        p, a, z, h, t, s, bag = (f[k] for k in ("p", "a", "z", "h", "t", "s", "bag"))
        d = (p - y) / len(y)
        dz = (d[:, None] * self.c)[bag]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, f["first"])[bag])
        gate = t * s
        dt, ds = de[:, None] * self.u * s * (1 - t**2), de[:, None] * self.u * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ self.v.T + ds @ self.g.T) * (1 - h**2)
        loss = float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))
        loss += ridge / 2 * float((self.w**2).sum() + (self.v**2).sum() + (self.g**2).sum() + (self.u**2).sum() + (self.c**2).sum())
        return loss, Model(
            x.T @ dh.astype(x.dtype) + ridge * self.w, dh.sum(0), h.T @ dt + ridge * self.v, h.T @ ds + ridge * self.g,
            gate.T @ de + ridge * self.u, z.T @ d + ridge * self.c, np.array([d.sum()]),
        )


PARTS = ("w", "b", "v", "g", "u", "c", "c0")


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def untrained(seed: int = 1) -> Model:
    """Small random weights; the unit on top starts at zero, so every score is 0.5."""
    r = np.random.default_rng(seed)
    scale = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
    return Model(scale(WIDTH, HIDDEN) * 4, np.zeros(HIDDEN), scale(HIDDEN, GATE), scale(HIDDEN, GATE), scale(GATE), np.zeros(HIDDEN), np.zeros(1))


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Adam over the whole sample, with a fixed start and fixed number of steps."""
    model = untrained()
    if not len(y):
        return model
    m = {k: np.zeros_like(getattr(model, k)) for k in PARTS}
    v = {k: np.zeros_like(getattr(model, k)) for k in PARTS}
    for step in range(1, steps + 1):
        _, grad = model.gradient(x, bags, y, ridge)
        new = {}
        for k in PARTS:
            g = getattr(grad, k)
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            new[k] = getattr(model, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        model = Model(**new)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(text, y, place)`` of the documents that the model is fitted to.

    Only ids and hashes are sorted; the texts of the chosen rows join at the end, and no
    text goes through the shuffle of the choice.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    rows = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id"), F.col("text")).alias("place"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    small = rows.where(F.col("size") <= max_bytes // 16)
    chosen = small.select("doc_id", "place", "size").join(y, "doc_id").dropDuplicates(["doc_id", "place"]).orderBy("place", "doc_id").limit(max_docs)
    # At most max_docs rows of numbers meet in this window.
    total = F.sum(F.col("size").cast("long")).over(Window.orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("total", total).where(F.col("total") <= max_bytes).select("doc_id", "place", "y")
    return small.join(chosen, ["doc_id", "place"]).select("text", "y", "place")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, **options) -> Model:
    """Fit the model to a bounded sample of the labelled documents of ``docs``."""

    def run(batches):
        for batch in slices(batches, "text", SCORE_SLICE):
            x, bags = passages(texts_of(batch, "text"))
            ends = np.cumsum(bags)
            packed = [x[e - n : e].astype(np.float16).tobytes() for n, e in zip(bags, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("y"), pa.array(packed, pa.binary())], ["place", "y", "x"])

    sample = training_sample(docs, labels, label_col, max_docs, max_bytes)
    rows = sample.mapInArrow(run, "place long, y double, x binary").dropDuplicates(["place"]).orderBy("place").limit(max_docs).collect()
    if not rows:
        return untrained()
    bags = np.array([len(r["x"]) // (2 * WIDTH) for r in rows], np.int64)
    y, x, at = np.array([r["y"] for r in rows]), np.empty((int(bags.sum()), WIDTH), np.float32), 0
    for n, r in zip(bags, rows):
        x[at : at + n] = np.frombuffer(r["x"], np.float16).reshape(n, WIDTH)
        at += n
    del rows
    return fit(x, bags, y, **options)


_ADDED = "score double, predicted int, n_passages long, top_passage long, top_share double"


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with score and prediction, and the passage with most attention.

    ``top_passage`` counts passages of ``PASSAGE`` words from 0, ``top_share`` is its weight.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    added = [x.split(" ")[0] for x in _ADDED.split(", ")]

    def run(batches):
        for batch in slices(batches, "text", SCORE_SLICE):
            x, bags = passages(texts_of(batch, "text"))
            f = shared.value.forward(x, bags)
            best = np.maximum.reduceat(f["a"], f["first"])
            is_best = np.flatnonzero(f["a"] == best[f["bag"]])
            top = is_best[np.searchsorted(f["bag"][is_best], np.arange(len(bags)))] - f["first"]
            columns = [f["p"], (f["p"] >= 0.5).astype(np.int32), bags, top, best]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, columns)], [*keep, *added])

    source = docs if "text" in keep else docs.select(*keep, "text")
    return source.mapInArrow(run, f"{fields}, {_ADDED}")


def held_out_split(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of two thirds of the labelled ones, by a checksum of the id."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    return score(docs, train(docs.where("NOT held_out"), labels), ["doc_id", "held_out"])
