"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Texts are lowered; every three consecutive bytes of a word with its borders count as a
gram, hashed into ``DIM`` cells. A vector is ``(1 + log tf) * idf``, scaled to length 1.
The document frequencies come from all training documents, in one pass. The centroids of
a language, ``clusters`` of them, come from spherical k-means over about ``sample``
training documents per language, chosen by hash (the documented bound of the fit); every
language is fitted in a task of its own. A text gets the language of the centroid with the
largest cosine. It is marked ``rejected`` when it is farther from that centroid than
nearly all of the centroid's own training documents are.

Rows: a null text or one without a letter is ``und`` with score 0. Documents without an
id or a language teach nothing; a null id is not held out. Repeated rows are predicted one
by one. Without training documents everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinframe.llm.words import slices

DIM = 4096
CLUSTERS = 4
SAMPLE = 2000
ROUNDS = 12
SLICE = 1 << 20
REJECT_QUANTILE = 0.995
REJECT_SLACK = 0.1
UNKNOWN = "und"

_LETTERS = np.array([b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256)], np.uint8)


def _cells(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """``(rows, DIM)`` counts of hashed grams; texts are lowered already."""
    buf = _LETTERS[np.frombuffer(b" " + b"  ".join(texts) + b"  ", np.uint8)]
    ends = 1 + np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    wide = buf.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    at = np.flatnonzero(buf[1:-1] != 0x20)
    row = np.searchsorted(ends, at + 1, "right")
    counts = np.bincount(row * DIM + _cells(code[at]), minlength=len(texts) * DIM)
    return counts.reshape(len(texts), DIM)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _lowered(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(pc.utf8_lower(batch.column("text").cast(pa.string())), "").cast(pa.binary()).to_pylist()


def _has_letter(text: bytes) -> bool:
    if any(97 <= b <= 122 for b in text[:64]):
        return True
    return any(map(str.isalpha, text.decode()))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training documents each cell occurs, and their number: ``DIM`` sums."""

    def run(batches):
        total, n = np.zeros(DIM, np.int64), 0
        for batch in slices(batches, "text", SLICE):
            total += (gram_counts(_lowered(batch)) > 0).sum(0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1, dtype=np.int32)), pa.array(np.append(total, n))], ["cell", "n"])

    rows = train.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out[:-1], int(out[-1])


def _spherical(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-means by cosine from farthest-first starts; centroids and each row's cluster."""
    starts = [int((x @ x.mean(0)).argmax())]
    near = x @ x[starts[0]]
    for _ in range(min(k, len(x)) - 1):
        starts.append(int(near.argmin()))
        near = np.maximum(near, x @ x[starts[-1]])
    c = x[starts]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                mean = x[own == j].sum(0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c, (x @ c.T).argmax(1)


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, limits: np.ndarray):
        self.idf, self.langs, self.centroids, self.limits = idf, langs, centroids, limits


def train(docs: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Fit on the rows of ``docs`` (``doc_id``, ``text``, ``lang``, none of them null)."""
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    shares = {r["lang"]: min(1.0, sample / r["n"]) for r in counts.collect()}
    if not shares:
        return Model(idf, [], np.zeros((0, DIM)), np.zeros(0))
    share = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v))])[F.col("lang")]
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 1) / F.lit(2.0**63)

    def sparse(batches):
        for batch in slices(batches, "text", SLICE):
            c = gram_counts(_lowered(batch))
            cells = [np.flatnonzero(r).astype(np.int32) for r in c]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("doc_id"), pa.array(cells, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(c, cells)], pa.list_(pa.int64()))],
                ["lang", "doc_id", "cells", "counts"],
            )

    def centroids(key, table):
        table = table.sort_by("doc_id")
        c = np.zeros((table.num_rows, DIM), np.int64)
        for i, (cells, counts) in enumerate(zip(table.column("cells").to_pylist(), table.column("counts").to_pylist())):
            c[i, cells] = counts
        x = vectors(c, shared.value)
        x = x[(x != 0).any(1)]
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.list_(pa.float64())), "far": pa.array([], pa.float64())})
        mid, own = _spherical(x, clusters)
        cosine = (x * mid[own]).sum(1)
        far = [float(np.quantile(1 - cosine[own == j], REJECT_QUANTILE)) if (own == j).any() else 0.0 for j in range(len(mid))]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(mid), pa.string()), "centroid": pa.array(list(mid), pa.list_(pa.float64())), "far": pa.array(far)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.where(place < share).select("lang", "doc_id", "text").mapInArrow(sparse, f"lang string, doc_id {id_type}, cells array<int>, counts array<long>")
    rows = chosen.groupBy("lang").applyInArrow(centroids, "lang string, centroid array<double>, far double").orderBy("lang").collect()
    return Model(idf, [r["lang"] for r in rows], np.array([r["centroid"] for r in rows]).reshape(-1, DIM), np.array([r["far"] for r in rows]) + REJECT_SLACK)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        m = shared.value
        for batch in slices(batches, "text", SLICE):
            texts = _lowered(batch)
            pred, score = np.array([UNKNOWN] * len(texts), object), np.zeros(len(texts))
            rejected = np.zeros(len(texts), bool)
            if m.langs:
                cosine = vectors(gram_counts(texts), m.idf) @ m.centroids.T
                best = cosine.argmax(1)
                known = np.fromiter(map(_has_letter, texts), bool, len(texts))
                near = cosine[np.arange(len(texts)), best]
                pred[known] = np.array(m.langs, object)[best[known]]
                score[known] = np.clip(near[known], 0, 1)
                rejected = known & (1 - near > m.limits[best])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")


def held_out_split(docs: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all of them."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = train(docs.where((fold != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), clusters, sample)
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
