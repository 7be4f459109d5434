"""Ranked lexical search over an inverted index in shards, by a hybrid of two evaluations.

A shard holds about 16 MB of text: its document ids and lengths, and per term the ordinals
of its documents with their term frequencies. Shards are the unit of work: a search sends
the lists of the asked terms to the task of their shard, each shard returns its ``k`` best
documents per item, and Spark ranks those. No list is ever gathered over shards, so a term
that occurs in every document costs each shard its own part only.

Within a shard an item is evaluated in two steps:

1. Term at a time: the short lists are summed into accumulators, sorted by document. From
   here on they are one more list, with the largest sum as its bound.
2. Document at a time: the accumulators and the long lists are read side by side in
   ranges of documents. Every list knows its largest contribution in each range; a range
   whose bounds cannot reach the k-th best score so far is skipped as a whole. Within a
   range the lists come in order of their bounds, and documents are dropped as soon as
   what they have and what is left cannot reach that score. The k-th best accumulator is
   the score to beat from the start.

Scores are integers, so equal scores are equal, and only documents strictly below the k-th
best are dropped; the order of lists and shards cannot change a result. Weights use counts
over all documents.

Rows: a null text and a text without terms is in no count and no result. Items of one id
are one item, terms added up; an item without terms or matches has no rows. Repeated rows
are ranked one by one; a row without id counts, is ranked after those with one at equal
scores, and is returned without id. Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinframe.llm.words import ALNUM_WORDS, Words, slices, texts_of
from kinframe.session import materialize

K = 10
SHARD_BYTES = 16 << 20
SHARD_DOCS = 60_000
RANGE = 512
#: Lists of at most this share of a shard's documents are summed first.
SHORT = 1 / 16
#: Weighted terms of all items that are broadcast at a time.
MAX_TERMS = 200_000
#: Fixed value: what separates terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Index:
    """``lists``: shard, term, df, docs, tfs. ``shards``: shard, docs, terms, doc_ids, no_id, lengths."""

    lists: DataFrame
    shards: DataFrame


_ROWS = "shard long, term string, df int, docs binary, tfs binary, n_docs long, n_terms long, doc_ids binary, no_id binary, lengths binary"


def _cut(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """Consecutive pieces of an array as binary values."""
    offsets = (np.append(first, len(data)) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _shard(number: int, batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """All lists of a slice of documents, and one row about the documents themselves."""
    w = Words(texts_of(batch, "text"), ALNUM_WORDS)
    if not len(w.hash):
        return None
    counts = w.counts
    owner = w.text_of()
    order = np.argsort(w.hash, kind="stable")
    word, doc = w.hash[order], owner[order]
    new_word = np.append(True, word[1:] != word[:-1])
    posting = np.flatnonzero(new_word | np.append(True, doc[1:] != doc[:-1]))
    tf = np.diff(np.append(posting, len(doc))).astype(np.uint32)
    first = np.flatnonzero(new_word[posting])
    at = order[posting[first]]
    low = w.raw.lower()
    terms = [low[a:b].decode() for a, b in zip(w.start[at], w.stop[at])]
    df = np.diff(np.append(first, len(posting))).astype(np.int32)
    ids = batch.column("doc_id")
    n = len(terms) + 1
    pad = lambda a, kind: pa.concat_arrays([a, pa.nulls(1, kind)])
    only = lambda x, kind: pa.concat_arrays([pa.nulls(n - 1, kind), pa.array([x], kind)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, number, np.int64)),
            pad(pa.array(terms, pa.string()), pa.string()),
            pad(pa.array(df), pa.int32()),
            pad(_cut(doc[posting].astype(np.uint16), first), pa.binary()),
            pad(_cut(tf, first), pa.binary()),
            only(int((counts > 0).sum()), pa.int64()),
            only(int(counts.sum()), pa.int64()),
            only(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), pa.binary()),
            only(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), pa.binary()),
            only(counts.astype(np.int64).tobytes(), pa.binary()),
        ],
        ["shard", "term", "df", "docs", "tfs", "n_docs", "n_terms", "doc_ids", "no_id", "lengths"],
    )


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> Index:
    """Write the inverted index of all texts below the shared folder."""
    shard_docs = min(shard_docs, 1 << 16)  # ordinals have 16 bits

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for some in slices(batches, "text", shard_bytes):
            for at in range(0, some.num_rows, shard_docs):
                rows = _shard((part << 32) + number, some.slice(at, shard_docs))
                number += 1
                if rows is not None:
                    for i in range(0, rows.num_rows, 20_000):
                        yield rows.slice(i, 20_000)

    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROWS))
    return Index(
        rows.where(F.col("term").isNotNull()).select("shard", "term", "df", "docs", "tfs"),
        rows.where(F.col("term").isNull()).select("shard", "n_docs", "n_terms", "doc_ids", "no_id", "lengths"),
    )


# ------------------------------------------------------------------ evaluation of a shard


class Posting:
    """A term's documents in a shard with their contributions, and the largest of each range."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray, edges: np.ndarray):
        self.docs, self.impact = docs, impact
        self.cut = np.searchsorted(docs, edges)
        self.largest = np.zeros(len(edges) - 1, np.int64)
        some = np.flatnonzero(np.diff(self.cut))
        if len(some):
            self.largest[some] = np.maximum.reduceat(impact, self.cut[some])


def best_documents(lists: list[tuple[Posting, int]], edges: np.ndarray, k: int, tie: np.ndarray, short: float = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals and scores of the ``k`` best documents of a shard, best first.

    ``lists`` are postings with the weight of their term, ``tie[d]`` the rank of document
    ``d`` among equal scores, ``edges`` the limits of the ranges.
    """
    n = int(edges[-1])
    few = max(RANGE // 8, int(n * short))
    sums = np.zeros(n, np.int64)
    long_lists = []
    for posting, weight in lists:
        if len(posting.docs) <= few:
            sums[posting.docs] += weight * posting.impact
        else:
            long_lists.append((posting, weight))
    touched = np.flatnonzero(sums)
    accumulators = Posting(touched, sums[touched], edges)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    beat = int(np.partition(accumulators.impact, -k)[-k]) if len(touched) >= k else 1
    bounds = np.array([weight * posting.largest for posting, weight in long_lists], np.int64).reshape(len(long_lists), len(edges) - 1)
    whole = bounds.sum(0) + accumulators.largest
    for r in np.flatnonzero(whole):
        if whole[r] < beat:
            continue
        low, high = int(edges[r]), int(edges[r + 1])
        part = sums[low:high].copy()
        left = int(bounds[:, r].sum())
        alive = None
        for i in np.argsort(-bounds[:, r], kind="stable"):
            posting, weight = long_lists[i]
            if not bounds[i, r]:
                break
            a, b = posting.cut[r], posting.cut[r + 1]
            if alive is None:
                part[posting.docs[a:b] - low] += weight * posting.impact[a:b]
            else:  # seek the documents that are left
                at = a + np.searchsorted(posting.docs[a:b], alive + low)
                hit = at < b
                hit[hit] = posting.docs[at[hit]] == alive[hit] + low
                part[alive[hit]] += weight * posting.impact[at[hit]]
            left -= int(bounds[i, r])
            if alive is not None:
                alive = alive[part[alive] + left >= beat]
            elif beat > 1:
                able = np.flatnonzero(part + left >= beat)
                if len(able) * 8 < high - low:
                    alive = able
            if alive is not None and not len(alive):
                break
        if alive is None:
            alive = np.flatnonzero(part)
        alive = alive[part[alive] >= beat]
        if not len(alive):
            continue
        docs, scores = np.append(docs, alive + low), np.append(scores, part[alive])
        if len(docs) > k:
            kept = np.lexsort((tie[docs], -scores))[:k]
            docs, scores = docs[kept], scores[kept]
        if len(docs) == k:
            beat = max(beat, int(scores.min()))
    order = np.lexsort((tie[docs], -scores))[:k]
    return docs[order], scores[order]


_BEST = "item int, doc_id long, score long"
_BEST_ARROW = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _evaluate(shared, n_docs: int, n_terms: int, k: int, short: float):
    def run(key, shard, lists):
        none = _BEST_ARROW.empty_table()
        if not shard.num_rows or not lists.num_rows:
            return none
        row = shard.to_pylist()[0]
        ids, no_id = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["no_id"], np.uint8)
        # The fixed saturation of the score: a document's length against the mean.
        m = 25 + (75 * np.frombuffer(row["lengths"], np.int64) * n_docs) // max(n_terms, 1)
        tie = np.empty(len(ids), np.int64)
        tie[np.lexsort((ids, no_id))] = np.arange(len(ids))
        edges = np.append(np.arange(0, len(ids), RANGE), len(ids))
        postings = {}
        for term, docs, tfs in zip(*(lists.column(c).to_pylist() for c in ("term", "docs", "tfs"))):
            docs, tf = np.frombuffer(docs, np.uint16).astype(np.int64), np.frombuffer(tfs, np.uint32).astype(np.int64)
            postings[term] = Posting(docs, (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]), edges)
        out = []
        for item, terms in shared.value:
            own = [(postings[t], w) for t, w in terms if t in postings]
            if own:
                docs, scores = best_documents(own, edges, k, tie, short)
                out.append((np.full(len(docs), item, np.int32), ids[docs], no_id[docs] > 0, scores))
        if not out:
            return none
        item, doc, missing, score = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(item), pa.array(doc, mask=missing), pa.array(score)], schema=_BEST_ARROW)

    return run


# ------------------------------------------------------------------ search


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, term, times)`` of all items."""
    terms = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(item_col).alias("item_id"), F.explode(terms).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def search(index: Index, items: DataFrame, k: int = K, max_terms: int = MAX_TERMS, short: float = SHORT, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``.

    Items are worked through in blocks of about ``max_terms`` weighted terms, which is what
    a block broadcasts; every block reads only the lists of its own terms.
    """
    n_docs, n_terms = index.shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    asked = materialize(item_terms(items, item_col, text_col))
    df = index.lists.select("term", "df").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long") * F.col("times")
    weighted = materialize(asked.join(df, "term").select("item_id", "term", weight.alias("weight")).where("weight > 0"))
    blocks = max(1, math.ceil(weighted.count() / max_terms))
    parts = []
    for block in range(blocks):
        mine = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        by_item: dict = {}
        for item, term, w in mine.collect():
            by_item.setdefault(item, []).append((term, w))
        names = list(by_item)
        shared = items.sparkSession.sparkContext.broadcast([(i, by_item[name]) for i, name in enumerate(names)])
        lists = index.lists.join(mine.select("term").distinct(), "term").select(F.col("shard").alias("of_shard"), "term", "docs", "tfs")
        best = index.shards.groupBy("shard").cogroup(lists.groupBy("of_shard")).applyInArrow(_evaluate(shared, n_docs, n_terms, k, short), _BEST)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        item_type = items.schema[item_col].dataType.simpleString()
        known = items.sparkSession.createDataFrame(list(enumerate(names)), f"item int, item_id {item_type}")
        parts.append(best.join(known, "item").select("item_id", "rank", "doc_id", "score"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, **options) -> DataFrame:
    """Index ``docs`` and search them for ``items``."""
    return search(build_index(docs), items, k, **options)
