"""Katz back-off bigram scores of texts, with Good-Turing discounts.

``P(w | h)`` is the discounted count of the pair over the count of ``h`` if the pair was
seen, else ``alpha(h) P(w)``, where ``alpha(h)`` divides what the discounts left by the
unigram mass of the words not seen after ``h``; so the probabilities after every history
sum to one. Unigrams leave their discounted mass to one unknown word. Discounts follow
Katz up to five counts, and absolute discounting where the counts of counts do not allow
that (small corpora). A history whose pairs are all frequent leaves one count more.

The corpus is worked through in blocks of texts. What a block needs to know is requested
from hash partitions of the model and returned in the order of the request, so only keys
and counts travel, never tokens with their results:

1. Blocks send their distinct words with training counts. Partitions sum them and give
   words numbers by falling count; a number then tells the count through the table of
   distinct counts, which has at most ``sqrt(2 N)`` rows for ``N`` training tokens.
2. Blocks send their distinct pairs of numbers with training counts to partitions of the
   history. These sum them and return, per pair, its count, and per history the unigram
   mass and the small counts of its continuations: a written table, partitioned alike.
3. With the discounts known, blocks score their tokens recursively: pair, else word.

A very frequent history is dealt over several partitions; the sums of such histories, at
most ``HOT_HISTORIES`` and a few more, are the only broadcast besides the distinct counts.

Rows: a null or empty text is the end token alone. Rows without an id are scored, but not
learned from. Repeated rows count each. Without training documents every score is 0 and
the base is that of an empty corpus. ``docs`` is read three times and must come back in
the same order, as a table does; each block checks that what is returned is its own.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinframe.llm.words import WHITESPACE_WORDS, Words, mix, slices, texts_of
from kinframe.session import materialize

BLOCK_BYTES = 16 << 20
PARTITION_BYTES = 12 << 20
HOT_COUNT = 250_000
HOT_HISTORIES = 65_536
SMALL = 5
END = np.uint64(0xE07E07E07E07E07E)
UNKNOWN, START = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)


def pack(a: np.ndarray) -> bytes:
    """Compressed byte planes of an array."""
    import zstandard

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1)


def _sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def _unsorted(data: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind)


# ------------------------------------------------------------------ blocks

BLOCK = "block long, stamp long, at binary, lengths binary, doc_ids binary, no_id binary, held binary, train binary"
WORDS = "bucket int, block long, stamp long, keys binary, counts binary"


def _block_rows(batches):
    """``(block, words, tokens, lengths, batch)``: distinct words in order, and where they are."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in slices(batches, "text", BLOCK_BYTES):
        w = Words(texts_of(batch, "text"), WHITESPACE_WORDS)
        lengths = w.counts + 1
        ends = np.cumsum(lengths) - 1
        tokens = np.empty(int(lengths.sum()), np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner] = w.hash
        tokens[ends] = END
        words, at = np.unique(tokens, return_inverse=True)
        yield (part << 32) + number, words, at, lengths, batch
        number += 1


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.uint8)


def _blocks(docs: DataFrame) -> DataFrame:
    def run(batches):
        for block, words, at, lengths, batch in _block_rows(batches):
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": block,
                        "stamp": zlib.crc32(words.tobytes()),
                        "at": pack(at.astype(np.uint32)),
                        "lengths": pack(lengths.astype(np.uint32)),
                        "doc_ids": pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)),
                        "no_id": pack(ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)),
                        "held": pack(_flags(batch, "held")),
                        "train": pack(_flags(batch, "train")),
                    }
                ],
                schema=_arrow(BLOCK),
            )

    return docs.mapInArrow(run, BLOCK)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _word_requests(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for block, words, at, lengths, batch in _block_rows(batches):
            learned = np.repeat(_flags(batch, "train"), lengths)
            counts = np.bincount(at, learned, len(words)).astype(np.uint32)
            bucket = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            stamp = zlib.crc32(words.tobytes())
            rows = [{"bucket": b, "block": block, "stamp": stamp, "keys": _sorted(words[i:j]), "counts": pack(counts[i:j])} for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(WORDS))

    return docs.mapInArrow(run, WORDS)


def _summed(table: pa.Table):
    """Distinct keys with their training counts; each row's keys."""
    keys = [_unsorted(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = [unpack(x, np.uint32) for x in table.column("counts").to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64), keys


def _spectrum_rows(key, table):
    _, total, _ = _summed(table)
    count, n = np.unique(total[total > 0], return_counts=True)
    return pa.table({"bucket": pa.array([key[0].as_py()] * len(count), pa.int32()), "count": pa.array(count, pa.int64()), "n": pa.array(n, pa.int64())})


IDS = "block long, bucket int, kind int, stamp long, ids binary, mass binary, small binary"


def _numbered(key, table, starts):
    """The numbers of each block's words: by falling count, then in bucket order."""
    distinct, total, keys = _summed(table)
    first = dict(zip(starts.column("count").to_pylist(), starts.column("start").to_pylist()))
    ids = np.full(len(distinct), UNKNOWN, np.uint32)
    order = np.argsort(total, kind="stable")
    order = order[total[order] > 0]
    counts, begin = np.unique(total[order], return_index=True)
    for c, part in zip(counts.tolist(), np.split(order, begin[1:])):
        ids[part] = first[c] + np.arange(len(part))
    rows = [
        {"block": block, "bucket": key[0].as_py(), "kind": 0, "stamp": stamp, "ids": pack(ids[np.searchsorted(distinct, k)]), "mass": None, "small": None}
        for block, stamp, k in zip(table.column("block").to_pylist(), table.column("stamp").to_pylist(), keys)
    ]
    return pa.Table.from_pylist(rows, schema=_arrow(IDS))


# ------------------------------------------------------------------ discounts


def discounts(n: dict[int, int]) -> np.ndarray:
    """``d[r]`` for ``r`` up to ``SMALL``: the factor on a count of ``r``; ``d[0]`` is unused."""
    d = np.ones(SMALL + 1)
    ones = n.get(1, 0)
    if ones and all(n.get(r, 0) for r in range(1, SMALL + 2)):
        common = (SMALL + 1) * n[SMALL + 1] / ones
        katz = [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if common != 1 else -1 for r in range(1, SMALL + 1)]
        if common < 1 and all(0 < x < 1 for x in katz):
            d[1:] = katz
            return d
    take = ones / (ones + 2 * n.get(2, 0)) if ones else 0.5
    take = min(max(take, 0.05), 0.95)
    d[1:] = [(r - take) / r for r in range(1, SMALL + 1)]
    return d


class Unigrams:
    """Counts and probabilities by word number, from the table of distinct counts."""

    def __init__(self, spectrum: dict[int, int], train_docs: int):
        self.count = np.array(sorted(spectrum, reverse=True), np.int64)
        words = np.array([spectrum[int(c)] for c in self.count], np.int64)
        self.last = np.cumsum(words)
        self.first = self.last - words
        self.tokens, self.types = int((self.count * words).sum()), int(words.sum())
        self.train_docs = train_docs
        d = discounts({r: spectrum.get(r, 0) for r in range(1, SMALL + 2)})
        factor = np.where(self.count <= SMALL, d[np.minimum(self.count, SMALL)], 1.0)
        kept = self.count * factor / max(self.tokens, 1)
        left = 1 - float((kept * words).sum())
        if self.tokens and left <= 0:  # no small count at all: one count more for the unknown
            kept, left = self.count / (self.tokens + 1), 1 / (self.tokens + 1)
        self.p, self.p_unknown = kept, left

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts; 0 for unknown words, the training documents for the start."""
        out = np.zeros(len(ids), np.int64)
        known = ids < START
        out[known] = self.count[np.searchsorted(self.last, ids[known].astype(np.int64), "right")] if self.types else 0
        out[ids == START] = self.train_docs
        return out

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), self.p_unknown)
        known = ids < START
        if self.types:
            out[known] = self.p[np.searchsorted(self.last, ids[known].astype(np.int64), "right")]
        return out


# ------------------------------------------------------------------ pairs

PAIRS = "bucket int, block long, history binary, word binary, counts binary"


class Deal:
    """Which partition holds a pair: that of its history, several for a frequent one."""

    def __init__(self, unigrams: Unigrams, buckets: int, hot_count: int, hot_histories: int):
        self.unigrams, self.buckets = unigrams, buckets
        self.limit = max(hot_count, -(-unigrams.tokens // hot_histories))

    def hot(self, history: np.ndarray) -> np.ndarray:
        return self.unigrams.counts(history) > self.limit

    def bucket(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        ways = -(-self.unigrams.counts(history) // self.limit)
        place = mix(history.astype(np.uint64) + np.uint64(1))
        spread = mix(word.astype(np.uint64) + np.uint64(7)) % np.maximum(ways, 1).astype(np.uint64)
        return ((place % np.uint64(self.buckets) + spread) % np.uint64(self.buckets)).astype(np.int64)


class Block:
    """A block's tokens as word numbers, and its distinct pairs in the order of requests."""

    def __init__(self, row: dict, returned: list[dict], deal: Deal):
        ids = [r for r in sorted(returned, key=lambda r: r["bucket"]) if r["kind"] == 0]
        number = np.concatenate([unpack(r["ids"], np.uint32) for r in ids]) if ids else np.zeros(0, np.uint32)
        if {r["stamp"] for r in ids} != {row["stamp"]}:
            raise RuntimeError("the documents came back in another order; write them to a table first")
        self.lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word = number[unpack(row["at"], np.uint32)]
        self.history = np.concatenate([[START], self.word[:-1]]).astype(np.uint32)
        self.history[self.starts] = START
        self.learned = np.repeat(unpack(row["train"], np.uint8), self.lengths)
        self.follows = self.history != UNKNOWN
        pair = (self.history[self.follows].astype(np.uint64) << np.uint64(32)) | self.word[self.follows]
        distinct, at = np.unique(pair, return_inverse=True)
        h, w = (distinct >> np.uint64(32)).astype(np.uint32), (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bucket = deal.bucket(h, w)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.pair_history, self.pair_word, self.bucket, self.at = h[order], w[order], bucket[order], place[at]
        # Where a new history begins inside a request.
        new = np.ones(len(order), bool)
        new[1:] = (self.bucket[1:] != self.bucket[:-1]) | (self.pair_history[1:] != self.pair_history[:-1])
        self.first = np.flatnonzero(new)


def _pair_requests(deal):
    def run(key, blocks, returned):
        rows = []
        for row in blocks.to_pylist():
            b = Block(row, returned.to_pylist(), deal.value)
            counts = np.bincount(b.at, b.learned[b.follows], len(b.bucket)).astype(np.uint32)
            cuts = np.flatnonzero(np.diff(b.bucket, prepend=-1, append=-1))
            for i, j in zip(cuts[:-1], cuts[1:]):
                rows.append({"bucket": int(b.bucket[i]), "block": row["block"], "history": _sorted(b.pair_history[i:j]), "word": pack(b.pair_word[i:j]), "counts": pack(counts[i:j])})
        return pa.Table.from_pylist(rows, schema=_arrow(PAIRS))

    return run


MODEL = "kind int, block long, bucket int, totals binary, mass binary, small binary, history long, s1 double, n array<long>"


def _pair_model(deal):
    """Sums of one partition: what each block gets back, counts of counts, hot histories."""

    def run(key, table):
        deals, schema = deal.value, _arrow(MODEL)
        none = dict.fromkeys(schema.names)
        bucket = key[0].as_py()
        h = [_unsorted(x, np.uint32) for x in table.column("history").to_pylist()]
        w = [unpack(x, np.uint32) for x in table.column("word").to_pylist()]
        counts = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()])
        pairs = [(a.astype(np.uint64) << np.uint64(32)) | b for a, b in zip(h, w)]
        distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.bincount(at, counts, len(distinct)).astype(np.int64)
        history = (distinct >> np.uint64(32)).astype(np.uint32)
        p = deals.unigrams.probabilities((distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        own, group = np.unique(history, return_inverse=True)
        seen = total > 0
        mass = np.bincount(group[seen], p[seen], len(own))
        small = np.zeros((len(own), SMALL), np.int64)
        for r in range(1, SMALL + 1):
            small[:, r - 1] = np.bincount(group[total == r], minlength=len(own))
        rows = [none | {"kind": 2, "n": [int((total == r).sum()) for r in range(1, SMALL + 2)]}]
        hot = np.flatnonzero(deals.hot(own))
        rows += [none | {"kind": 3, "history": int(own[i]), "s1": float(mass[i]), "n": small[i].tolist()} for i in hot]
        ends = np.cumsum([len(x) for x in pairs])
        for block, a, b, hs in zip(table.column("block").to_pylist(), ends - [len(x) for x in pairs], ends, h):
            asked = np.searchsorted(own, hs[np.flatnonzero(np.diff(hs, prepend=np.uint32(hs[0] + np.uint32(1))))] if len(hs) else hs)
            rows.append(none | {"kind": 1, "block": block, "bucket": bucket, "totals": pack(np.minimum(total[at[a:b]], 0xFFFFFFFF).astype(np.uint32)), "mass": pack(mass[asked]), "small": pack(small[asked].astype(np.uint32).reshape(-1))})
        return pa.Table.from_pylist(rows, schema=schema)

    return run


# ------------------------------------------------------------------ scores

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def backoff(c: np.ndarray, mass: np.ndarray, small: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``alpha`` of histories with count ``c``, and the count their pairs are divided by."""
    left = (small * (np.arange(1, SMALL + 1) * (1 - d[1:]))).sum(1)
    whole = np.where(left > 0, c, c + 1)
    left = np.where(left > 0, left, 1)
    return left / np.maximum(whole, 1) / np.maximum(1 - mass, 1e-300), whole


def _scored(deal, hot, d):
    def run(key, blocks, returned):
        deals, u = deal.value, deal.value.unigrams
        found = returned.to_pylist()
        tables = []
        for row in blocks.to_pylist():
            b = Block(row, found, deals)
            model = sorted((r for r in found if r["kind"] == 1), key=lambda r: r["bucket"])
            total = np.concatenate([unpack(r["ids"], np.uint32) for r in model]).astype(np.int64) if model else np.zeros(0, np.int64)
            mass = np.concatenate([unpack(r["mass"], np.float64) for r in model]) if model else np.zeros(0)
            small = np.concatenate([unpack(r["small"], np.uint32) for r in model]).reshape(-1, SMALL).astype(np.int64) if model else np.zeros((0, SMALL), np.int64)
            if len(total) != len(b.bucket) or len(mass) != len(b.first):
                raise RuntimeError("the documents came back in another order; write them to a table first")
            own = b.pair_history[b.first]
            is_hot = np.flatnonzero(deals.hot(own))
            for i in is_hot:
                mass[i], small[i] = hot.value[int(own[i])]
            alpha, whole = backoff(u.counts(own), mass, small, d)
            run_of = np.repeat(np.arange(len(b.first)), np.diff(np.append(b.first, len(b.bucket))))
            p_word = u.probabilities(b.pair_word)
            factor = np.where(total <= SMALL, d[np.minimum(total, SMALL)], 1.0)
            # Histories that leave one count more are not discounted: their counts are large.
            p = np.where(total > 0, factor * total / np.maximum(whole[run_of], 1), alpha[run_of] * p_word)
            p_token = u.probabilities(b.word)
            p_token[b.follows] = p[b.at]
            c = u.counts(b.word)
            base = np.log10((c + 0.5) / (u.tokens + 0.5 * (u.types + 1)))
            logp = np.log10(p_token) if u.tokens else np.zeros(len(c))
            at = b.starts
            ids, none = unpack(row["doc_ids"], np.int64), unpack(row["no_id"], np.uint8).astype(bool)
            tables.append(
                pa.table(
                    [
                        pa.array(ids, mask=none),
                        pa.array(unpack(row["held"], np.uint8).astype(bool)),
                        pa.array(b.lengths),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
                        pa.array(np.full(len(at), u.tokens, np.int64)),
                        pa.array(np.add.reduceat(base, at)),
                        pa.array(np.add.reduceat(logp, at)),
                    ],
                    schema=_arrow(SCORES),
                )
            )
        return pa.concat_tables(tables) if tables else _arrow(SCORES).empty_table()

    return run


def scores(docs: DataFrame, held_out, hot_count: int = HOT_COUNT, hot_histories: int = HOT_HISTORIES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Score every row of ``docs`` by a model of the rows for which ``held_out`` is false.

    ``held_out`` is a boolean column; where it is null a row is scored, not learned from.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(~held_out, F.lit(False)).alias("train"))
    size, train_docs = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    buckets = max(1, math.ceil(size / partition_bytes))
    requests = _word_requests(docs, max(1, math.ceil(buckets / 4)))

    spectrum = materialize(requests.groupBy("bucket").applyInArrow(_spectrum_rows, "bucket int, count long, n long"))
    counts = {r["count"]: r["n"] for r in spectrum.groupBy("count").agg(F.sum("n").alias("n")).collect()}
    unigrams = Unigrams(counts, train_docs)
    bases = spark.createDataFrame([(int(c), int(f)) for c, f in zip(unigrams.count, unigrams.first)], "count long, base long")
    before = F.sum("n").over(Window.partitionBy("count").orderBy("bucket")) - F.col("n")
    starts = spectrum.withColumn("before", before).join(bases, "count").select("bucket", "count", (F.col("base") + F.col("before")).alias("start"))
    ids = materialize(requests.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(_numbered, IDS))

    deal = spark.sparkContext.broadcast(Deal(unigrams, buckets, hot_count, hot_histories))
    blocks = _blocks(docs)
    pairs = blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_pair_requests(deal), PAIRS)
    model = materialize(pairs.groupBy("bucket").applyInArrow(_pair_model(deal), MODEL))

    sums = model.where("kind = 2").select(F.posexplode("n")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    d = discounts({r["pos"] + 1: r["n"] for r in sums})
    hot_rows = model.where("kind = 3").groupBy("history").agg(F.sum("s1").alias("s1"), *[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(SMALL)])
    hot = spark.sparkContext.broadcast({r["history"]: (r["s1"], [r[f"n{i}"] for i in range(SMALL)]) for r in hot_rows.collect()})
    answers = model.where("kind = 1").select("block", "bucket", "kind", F.lit(None).cast("long").alias("stamp"), F.col("totals").alias("ids"), "mass", "small")
    return blocks.groupBy("block").cogroup(ids.unionByName(answers).groupBy("block")).applyInArrow(_scored(deal, hot, d), SCORES)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """Scores with every fifth document, by a checksum of its id, held out."""
    return scores(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1)
