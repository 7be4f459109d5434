"""Token ids in binary shards, every document compressed alone with a shared dictionary.

A zstandard dictionary is trained on the serialized ids of a bounded sample (the lowest
``sample_docs`` documents by hash of their id and text, none longer than ``sample_chars``). Every
document's ids become one frame compressed with it, so that a short document can be read
without its neighbours. Shards hold, in ascending id order: a header with the hash of the
dictionary, the ids and token counts of the documents, the offsets of their frames, and
the frames. They are rows of a Parquet table written by Spark's own committer, so a lost
executor only repeats its tasks; the dictionary is a one-row table beside it.

Encoding works on distinct words. Byte-level BPE never joins what stands on both sides of
a space that follows a visible character, so a text is cut there, each distinct piece is
encoded once, and the ids are put together again. New pieces are encoded many at a time in
one string and told apart by the byte lengths of their tokens. Texts with other white space
before a space are encoded as a whole.

Rows: a null or empty text has no ids but the end id. Documents without an id come first;
rows that repeat an id stay side by side, in order of their content's checksum. An empty
table gives no shard. Without enough samples the dictionary is empty.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinframe.llm.words import slices
from kinframe.session import checkpoint_root, materialize

SAMPLE_DOCS = 512
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 65_536
SHARD_BYTES = 4 << 20
SHARD_DOCS = 65_536
SLICE = 4 << 20
CACHE_PIECES = 400_000
JOINED_PIECES = 256
END_ID = 0
MAGIC = b"TIDS"
_HEAD = struct.Struct("<4sHBx32sII")
# What may count as white space in front of a space; a cut there would not be safe.
_SPACED = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "


class Encoder:
    """Ids of texts through a cache of encoded pieces; one per worker process."""

    _open: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # Bytes that a token of a byte-level vocabulary stands for: one per character.
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.token_bytes[i] = len(token.content.encode())
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.offsets = np.zeros(1 << 16, np.int64)
        self.seen = np.zeros(1 << 16, np.uint16)
        self.size = 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of separate pieces, end to end, and how many each has.

        Pieces that start with a space and end with a visible character stay apart when
        joined. The token ends must then meet the piece ends; a group where they do not
        is encoded piece by piece.
        """
        joins = [p[0] == " " and len(p) > 1 and not p[-1].isspace() for p in pieces]
        groups, singles = [], []
        inner = [i for i, j in enumerate(joins) if j]
        for at in range(0, len(inner), JOINED_PIECES):
            groups.append(inner[at : at + JOINED_PIECES])
        singles = [i for i, j in enumerate(joins) if not j]
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = []
        for group, ids in zip(groups, self._encode(["".join(pieces[i] for i in g) for g in groups])):
            ids = np.array(ids, np.uint32)
            ends = np.cumsum(self.token_bytes[ids])
            want = np.cumsum([len(pieces[i].encode()) for i in group])
            cuts = np.searchsorted(ends, want)
            if len(ends) and cuts[-1] == len(ends) - 1 and (ends[cuts] == want).all():
                found.append((group, ids, np.diff(cuts, prepend=-1)))
            else:
                singles += group
        apart = self._encode([pieces[i] for i in singles])
        if singles:
            found.append((singles, np.array([x for y in apart for x in y], np.uint32), np.array([len(y) for y in apart], np.int64)))
        # Back in the order of the pieces.
        lengths = np.zeros(len(pieces), np.int64)
        for group, _, n in found:
            lengths[group] = n
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.uint32)
        for group, ids, n in found:
            flat[np.repeat(starts[group] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, lengths

    def _forget(self) -> None:
        """Keep the pieces that most slices had, half of the cache at most; of the rest, none.

        Pieces seen once, as in junk, go; what is frequent is never encoded again.
        """
        seen = self.seen[: len(self.known)]
        level = max(2, int(np.partition(seen, -(CACHE_PIECES // 2))[-(CACHE_PIECES // 2)]) + 1)
        kept = np.flatnonzero(seen >= level)
        names = np.array(list(self.known), object)[kept].tolist()
        lengths = np.diff(self.offsets[: len(seen) + 1])[kept]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.offsets[kept] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        marks = seen[kept] // 2
        self.reset()
        self._keep(names, flat, lengths)
        self.seen[: len(marks)] = marks

    def _keep(self, names: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        """Append pieces with their ids."""
        n, used = len(self.known), self.size
        while used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(names) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        self.flat[used : used + len(flat)] = flat
        self.offsets[n : n + len(names) + 1] = used + np.concatenate([[0], np.cumsum(lengths)])
        self.size = used + len(flat)
        self.known.update(zip(names, range(n, n + len(names))))

    def _store(self, pieces: list[str]) -> np.ndarray:
        """Positions of pieces in the cache, encoding those that are new."""
        if len(self.known) > CACHE_PIECES:
            self._forget()
        new = [p for p in dict.fromkeys(pieces) if p not in self.known and p]
        if "" not in self.known:
            new.append("")
        flat, lengths = self._pieces([p for p in new if p])
        if new and not new[-1]:
            lengths = np.append(lengths, 0)
        self._keep(new, flat, lengths)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        self.seen[at] = np.minimum(self.seen[at], 60_000) + 1
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text, without the end id."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _SPACED).to_numpy(zero_copy_only=False)
        cut = texts.filter(pa.array(~whole))
        parts = pc.split_pattern(cut, " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        words = parts.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        code = words.indices.to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        # The first piece of a text has no space in front of it.
        first = code[starts] if len(starts) else code[:0]
        both = self._store([" " + w for w in distinct] + [distinct[c] for c in first])
        at = both[: len(distinct)][code]
        at[starts] = both[len(distinct) :]
        lengths = self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.offsets[at] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([starts, [len(code)]])]
        done = iter([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
        full = iter(self._encode(texts.filter(pa.array(whole)).to_pylist()))
        return [np.array(next(full), np.uint32) if w else next(done) for w in whole]


def _sample(docs: DataFrame, sample_docs: int, sample_chars: int) -> list[str]:
    """Texts of the documents with the lowest hashes: a bounded number of bounded texts.

    Only hashes below a level that about twice the number stay under are sorted, and no
    more than ``sample_docs`` rows reach the driver, whatever ids repeat or are missing.
    """
    short = docs.select("doc_id", "text").where(F.length("text").between(1, sample_chars))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1) / F.lit(2.0**63)
    level = 2 * sample_docs / max(1, short.count())
    rows = short.withColumn("place", place).where(F.col("place") < level)
    return [r["text"] for r in rows.orderBy("place", "doc_id", "text").limit(sample_docs).collect()]


def train_dictionary(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for serialized ids, empty if the samples are too few."""
    import zstandard

    texts = _sample(docs, sample_docs, sample_chars)
    encoder = Encoder.of(path)
    samples = [_bytes(ids, encoder.width) for ids in encoder.encode(pa.array(texts, pa.string()))]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _bytes(ids: np.ndarray, width: int) -> bytes:
    return np.append(ids, np.uint32(END_ID)).astype(f"<u{width}").tobytes()


def _codec(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(dict_data=known), zstandard.ZstdDecompressor(dict_data=known)


def encode_documents(docs: DataFrame, path: str, dictionary: bytes) -> DataFrame:
    """``(doc_id, n_tokens, crc, width, frame)`` of every document, the end id included."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        encoder, (compress, _) = Encoder.of(path), _codec(shared.value)
        for batch in slices(batches, "text", SLICE):
            counts, crcs, frames = [], [], []
            for ids in encoder.encode(batch.column("text")):
                counts.append(len(ids) + 1)
                crcs.append(zlib.crc32(_bytes(ids, 4)))
                frames.append(compress.compress(_bytes(ids, encoder.width)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array([encoder.width] * len(counts), pa.int32()), pa.array(frames, pa.binary())],
                ["doc_id", "n_tokens", "crc", "width", "frame"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, crc long, width int, frame binary")


def pack_shard(doc_ids: list[int | None], counts: list[int], frames: list[bytes], width: int, dictionary_hash: bytes) -> bytes:
    """Header, ids with a null mask, token counts, frame offsets, frames."""
    n = len(doc_ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    head = _HEAD.pack(MAGIC, 1, width, dictionary_hash, n, 0)
    return b"".join([head, ids.tobytes(), null.tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Shard:
    """Reads a shard; ``ids(k)`` decompresses only document ``k``."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.width, digest, n, _ = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = _HEAD.size
        self.data, self._decompress = data, _codec(dictionary)[1]
        ids = np.frombuffer(data, "<i8", n, at)
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null)]
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 13 * n)
        self.body = at + 13 * n + 8 * (n + 1)

    def ids(self, k: int) -> np.ndarray:
        frame = self.data[self.body + int(self.offsets[k]) : self.body + int(self.offsets[k + 1])]
        return np.frombuffer(self._decompress.decompress(frame, max_output_size=int(self.counts[k]) * self.width), f"<u{self.width}").astype(np.uint32)


def write_shards(docs: DataFrame, path: str, out: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``docs`` and write ``out/shards`` and ``out/dictionary``."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest, dictionary)], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    encoded = materialize(encode_documents(docs, path, dictionary))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        rows: list[dict] = []
        size = 0

        def shard():
            nonlocal number, before
            counts = [r["n_tokens"] for r in rows]
            data = pack_shard([r["doc_id"] for r in rows], counts, [r["frame"] for r in rows], rows[0]["width"], digest)
            out = pa.RecordBatch.from_pylist([{"part": part, "shard": number, "n_docs": len(rows), "n_tokens": sum(counts), "before": before, "data": data}], schema=schema)
            number, before = number + 1, before + sum(counts)
            return out

        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                size += len(row["frame"]) + 21
                if size >= shard_bytes or len(rows) >= SHARD_DOCS:
                    yield shard()
                    rows, size = [], 0
        if rows:
            yield shard()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("data", pa.binary())])
    order = ("doc_id", "crc", "n_tokens")
    shards = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards.select("doc_id", "n_tokens", "width", "frame").mapInArrow(run, "part int, shard int, n_docs long, n_tokens long, before long, data binary").write.option("compression", "none").parquet(f"{out}/shards")


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the written shards.

    ``start`` is the number of ids in front of a document; the sums run over the parts.
    """
    shards = spark.read.parquet(f"{out}/shards")
    shared = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{out}/dictionary").first()["dictionary"]))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["data"], shared.value)
                counts, crcs = [], []
                for k in range(len(shard.doc_ids)):
                    ids = shard.ids(k)
                    counts.append(len(ids))
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                start = row["before"] + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(counts), pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(start), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    found = shards.select("part", "before", "data").mapInArrow(run, "part int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # One row per written partition.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return found.join(bases, "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and report what is read back."""
    out = f"{checkpoint_root(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, out)
    return read_documents(docs.sparkSession, out)
