"""Benchmark decontamination: documents that hold passages of test items.

Every run of ``width`` consecutive words of a test item is a window; an item with fewer
words, but not none, is one window as a whole. The windows are made by a Spark job and
sent to the tasks as a sorted array of hashes with their words. Documents are scanned
once, in batches: a rolling hash of their words is looked up, and each candidate is
confirmed on the words themselves, so hash collisions cannot produce hits.

The broadcast is bounded: at most ``max_windows`` (window, item) pairs go out at a time.
A larger test set is dealt into as many parts, the documents are scanned once per part,
and what the earlier parts found travels with the rows through a written table.

Rows: a null text and a text without words have no hits. Repeated rows and repeated
``doc_id`` values are scanned row by row. Items with a null text add no window. Items
with a null id mark words as hit, but name no item. An empty test set hits nothing.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.llm.words import ALNUM_WORDS, Words, slices, texts_of, windows
from kinframe.session import materialize

WIDTH = 10
MAX_WINDOWS = 500_000
STATE = "__contamination"
STATE_TYPE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
_STATE_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


def item_windows(benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(words, size, item)``: the distinct windows of all items, words joined by a space."""

    def run(batches):
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            names = batch.column("item").to_pylist()
            w = Words(texts, ALNUM_WORDS)
            low = w.raw.lower()
            found = set()
            for i, name in enumerate(names):
                a, b = w.first[i], w.first[i + 1]
                tokens = [low[s:e] for s, e in zip(w.start[a:b], w.stop[a:b])]
                size = min(width, len(tokens))
                if size:
                    found.update((b" ".join(tokens[j : j + size]), size, name) for j in range(len(tokens) - size + 1))
            rows = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
                ["words", "size", "item"],
            )

    return (
        benchmark.select(F.col(text_col).alias("text"), F.col(item_col).cast("string").alias("item"))
        .mapInArrow(run, "words binary, size int, item string")
        .distinct()
    )


class Index:
    """Windows by size: sorted hashes, their words, and the items they come from."""

    def __init__(self, rows: list[tuple[bytes, int, str | None]]):
        by_size: dict[int, dict[bytes, set]] = {}
        for words, size, item in rows:
            by_size.setdefault(size, {}).setdefault(bytes(words), set()).add(item)
        self.sizes: dict[int, tuple[np.ndarray, list[list[tuple[bytes, list[str]]]]]] = {}
        for size, known in by_size.items():
            texts = list(known)
            w = Words(texts, ALNUM_WORDS)
            hashes = windows(w.hash, size)[w.first[:-1]]
            at: dict[int, list] = {}
            for h, words in zip(hashes.tolist(), texts):
                at.setdefault(h, []).append((words, sorted(x for x in known[words] if x is not None)))
            keys = np.array(sorted(at), np.uint64)
            self.sizes[size] = (keys, [at[int(k)] for k in keys])


def scan(texts: list[bytes | None], index: Index):
    """Per text: number of words, merged hit ranges of word positions, and items."""
    w = Words(texts, ALNUM_WORDS)
    n, low = len(w.hash), None
    change = np.zeros(n + 1, np.int64)
    found: dict[int, set[str]] = {}
    owner = w.text_of()
    for size, (keys, entries) in index.sizes.items():
        h = windows(w.hash, size)
        if not len(h) or not len(keys):
            continue
        same = owner[: len(h)] == owner[size - 1 :]
        where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        for p in np.flatnonzero((keys[where] == h) & same):
            low = low or w.raw.lower()
            words = b" ".join([low[s:e] for s, e in zip(w.start[p : p + size], w.stop[p : p + size])])
            for known, items in entries[where[p]]:
                if known == words:
                    change[p] += 1
                    change[p + size] -= 1
                    found.setdefault(int(owner[p]), set()).update(items)
                    break
    hit = np.cumsum(change[:-1]) > 0
    # A range ends where the hits end and where the text ends.
    spans: dict[int, list[tuple[int, int]]] = {}
    if hit.any():
        at = np.flatnonzero(hit)
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(owner[at]) != 0)) + 1
        for run in np.split(at, breaks):
            i = int(owner[run[0]])
            spans.setdefault(i, []).append((int(run[0] - w.first[i]), int(run[-1] + 1 - w.first[i])))
    return w.counts, spans, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    max_windows: int = MAX_WINDOWS,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` with a struct column ``__contamination``: counts, word ranges and items."""
    pairs = materialize(item_windows(benchmark, width, item_col, item_text_col))
    parts = max(1, math.ceil(pairs.count() / max_windows))
    schema = T.StructType([*docs.schema.fields, T.StructField(STATE, STATE_TYPE)])
    out, names = docs, docs.columns
    for part in range(parts):
        mine = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(parts)) == part)
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in mine.collect()]))

        def run(batches, index=index, first=part == 0):
            for batch in slices(batches, text_col):
                counts, spans, found = scan(texts_of(batch, text_col), index.value)
                if first:
                    before = [None] * batch.num_rows
                else:
                    before = batch.column(STATE).to_pylist()
                states = []
                for i, old in enumerate(before):
                    mine, items = spans.get(i, []), found.get(i, set())
                    if old:
                        mine = _merged(mine + [(s["start"], s["stop"]) for s in old["spans"]])
                        items = items | set(old["items"])
                    states.append(
                        {
                            "n_words": int(counts[i]),
                            "n_hit": sum(b - a for a, b in mine),
                            "spans": [{"start": a, "stop": b} for a, b in mine],
                            "items": sorted(items),
                        }
                    )
                columns = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(states, _STATE_ARROW)], [*names, STATE])

        out = out.mapInArrow(run, schema)
        if part + 1 < parts:
            out = materialize(out)
    return out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each range."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, pos = [], 0
    for a, b in spans:
        out.append(text[pos : at[a][0]])
        pos = at[b - 1][1]
    return b"".join([*out, text[pos:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or without the contaminated passages.

    ``remove="spans"`` cuts the hit word ranges out of the text and keeps every row.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    marked, names = contamination(docs, benchmark, text_col=text_col, **options), docs.columns
    if remove == "documents":
        return marked.where(F.col(f"{STATE}.n_hit") == 0).drop(STATE)

    def run(batches):
        for batch in batches:
            texts = texts_of(batch, text_col)
            for i, s in enumerate(batch.column(STATE).to_pylist()):
                if s["spans"]:
                    texts[i] = without_spans(texts[i], [(x["start"], x["stop"]) for x in s["spans"]])
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.mapInArrow(run, docs.schema)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: word counts, the items found in it, and whether it is contaminated."""
    state = contamination(docs.select("doc_id", "text"), benchmark, **options)
    items = F.array_join(F.col(f"{STATE}.items"), ",")
    return state.select(
        "doc_id",
        F.col(f"{STATE}.n_words").alias("n_words"),
        F.col(f"{STATE}.n_hit").alias("n_hit"),
        F.size(f"{STATE}.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (F.col(f"{STATE}.n_hit") > 0).alias("contaminated"),
    )
