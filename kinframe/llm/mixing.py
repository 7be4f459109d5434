"""Mixing sources to target weights by a low-discrepancy schedule.

Each source gets a weight and from it a target number of words, at most ``max_repeats``
times its own size. Slots of ``block`` words are dealt to the sources by golden-ratio
points mapped through the cumulative targets, so every stretch of the schedule holds the
sources in their shares. The documents of a source, shuffled by a hash of their id, form
one stream of words cut into equal blocks; the ``r``-th slot of a source takes the
``r``-th block, starting over at the end of the stream. Slots beyond a source's target are
left out, the few it lacks are added at the end of the schedule, and its last slot takes
part of its block, so a source's words meet its target to the word.

Both running counts (words in a stream, slots of a source) are sums over buckets with the
running count inside a bucket. There are about as many buckets as rows in a bucket, so
neither a hot source nor the table of buckets meets in one task.

Rows: a null or empty text has no words and is never taken. A null source is a source, the
last one. Rows that repeat an id are separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinframe.llm.words import WHITESPACE_WORDS, slices, texts_of
from kinframe.session import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 1024
CHUNK = 1024
# 2**64 divided by the golden ratio: multiples modulo 2**64 are its points.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _key():
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def word_counts(texts: list[bytes | None]) -> np.ndarray:
    """Words of every text: runs of bytes that are not ASCII white space."""
    texts = [t or b"" for t in texts]
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = WHITESPACE_WORDS[buf] != 0
    begins = np.concatenate([inside[:1], inside[1:] & ~inside[:-1]])
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    total = np.concatenate([[0], np.cumsum(begins)])[np.concatenate([[0], ends])]
    return np.diff(total)


def with_size(docs: DataFrame, keep: Sequence[str], name: str = "size") -> DataFrame:
    """The ``keep`` columns of ``docs`` and the number of words of the text."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    keep = list(keep)

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(word_counts(texts_of(batch, "text")), pa.int64())], [*keep, name])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{fields}, `{name}` long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """``(key, source, source_size, target)`` from ``(source, size)`` rows.

    Weights repeat over the sources in code point order, null last. Sources are filled in
    order of the level at which they reach their limit: the level of a source is what is
    left after the full ones, by weight. One row per source.
    """
    per = sizes.groupBy(_key().alias("key"), "source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(all_rows) - (F.sum("limit").over(order) - F.col("limit"))
    weight = F.sum("weight").over(all_rows) - (F.sum("weight").over(order) - F.col("weight"))
    per = per.withColumn("level", left / weight).withColumn("full", F.col("limit") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(all_rows)["level"]
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), level * F.col("weight")))
    return per.select("key", "source", "source_size", target.alias("target"))


def streams(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """``sizes`` with ``key`` and ``start``: words of the source in front of the document."""
    n = sizes.count()
    buckets = max(1, math.isqrt(n))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
    rows = sizes.withColumn("key", _key()).withColumn("place", place).withColumn("bucket", F.floor(F.col("place") / F.lit(2.0**63) * buckets))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words")
    offsets = sums.select("key", "bucket", before.alias("before"))
    inner = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("inner", inner - F.col("size")).join(offsets, ["key", "bucket"])
    return rows.select(*sizes.columns, "key", (F.col("before") + F.col("inner")).alias("start"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(slot, key, rank)``: the source of every slot and the slot's rank in its source.

    The tasks get the cumulative targets, eight bytes a source, through the driver; names
    and quotas of the sources are a table that is joined. Of each chunk of slots only the
    sources it deals to are counted.
    """
    spark = targets.sparkSession
    words, size = F.round("target").cast("long"), F.col("source_size")
    full = F.floor(words / size)
    quota = full * F.ceil(size / block) + F.ceil((words - full * size) / block)
    number = (F.row_number().over(Window.orderBy("key")) - 1).cast("int")
    sources = materialize(targets.where("target > 0").select("key", number.alias("sid"), "target", quota.cast("long").alias("quota")))
    share = sources.orderBy("sid").select("target").toPandas()["target"].to_numpy(np.float64)
    # Upper ends of the sources' intervals; the last one ends with the points.
    ends = np.cumsum(share)[:-1] / share.sum() if len(share) else share
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    chunk = max(CHUNK, math.isqrt(total))

    def dealt(ids: np.ndarray):
        for c in ids.tolist():
            slot = np.arange(c * chunk, min(total, (c + 1) * chunk), dtype=np.int64)
            point = (slot.astype(np.uint64) * GOLDEN) / 2.0**64
            yield c, slot, np.searchsorted(ends, point, "right")

    def count(batches):
        for batch in batches:
            for c, _, source in dealt(batch.column("id").to_numpy()):
                sid, n = np.unique(source, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), c)), pa.array(sid.astype(np.int32)), pa.array(n.astype(np.int64))], ["chunk", "sid", "n"])

    def place(batches):
        for batch in batches:
            for c, slot, source in dealt(batch.column("id").to_numpy()):
                order = np.argsort(source, kind="stable")
                inner = np.empty(len(slot), np.int64)
                inner[order] = np.arange(len(slot)) - np.searchsorted(source[order], source[order])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), c)), pa.array(slot), pa.array(source.astype(np.int32)), pa.array(inner)], ["chunk", "slot", "sid", "inner"])

    chunks = spark.range(-(-total // chunk))
    counts = materialize(chunks.mapInArrow(count, "chunk long, sid int, n long"))
    before = counts.select("chunk", "sid", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("before"))
    slots = chunks.mapInArrow(place, "chunk long, slot long, sid int, inner long").join(before, ["chunk", "sid"]).select("slot", "sid", (F.col("before") + F.col("inner")).alias("rank"))
    slots = slots.join(sources.select("sid", "key", "quota"), "sid").where("rank < quota").select("slot", "key", "rank")
    have = sources.join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < quota")
    rest = have.select(F.lit(total).cast("long").alias("slot"), "key", F.explode(F.sequence("n", F.col("quota") - 1)).alias("rank"))
    return slots.unionByName(rest)


def block_uses(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(key, block, slot, take)``: the schedule joined to what each slot takes of its block."""
    slots = schedule(targets, block).join(targets.select("key", "source_size", F.round("target").cast("long").alias("words")), "key")
    blocks = F.ceil(F.col("source_size") / block)
    number = F.pmod("rank", blocks)
    before = F.floor(F.col("rank") / blocks) * F.col("source_size") + number * block
    take = F.least(F.lit(block), F.col("source_size") - number * block, F.col("words") - before)
    return slots.select("key", number.alias("block"), "slot", take.alias("take"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: float = MAX_REPEATS, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, taken, copies``.

    ``taken`` counts the words that the mix takes, repeats included; ``copies`` how often
    it takes the document's first word.
    """
    sizes = materialize(with_size(docs, ["doc_id", "source"]))
    targets = materialize(source_targets(sizes, weights, max_repeats))
    rows = streams(sizes, seed)
    pieces = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start DIV {block}"), F.expr(f"(start + size - 1) DIV {block}"))))
    begin = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    pieces = pieces.select("key", "block", "start", "doc_id", "source", "size", begin.alias("begin"), end.alias("end"))
    met = pieces.join(block_uses(targets, block).drop("slot"), ["key", "block"], "left")
    # least() skips nulls; a block that no slot takes has no take.
    words = F.when(F.col("take").isNotNull(), F.greatest(F.least("end", "take") - F.col("begin"), F.lit(0)))
    first = (F.col("block") * block + F.col("begin") == F.col("start")) & (F.col("take") > F.col("begin"))
    taken = met.groupBy("key", "start", "doc_id", "source", "size").agg(F.coalesce(F.sum(words), F.lit(0)).alias("taken"), F.count(F.when(first, 1)).alias("copies")).drop("start")
    none = sizes.where("size = 0").select(_key().alias("key"), "doc_id", "source", "size", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"))
    out = taken.unionByName(none).join(targets.drop("source"), "key")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document once for each time its first word is taken.

    Every pass over a stream starts at its beginning and only the last one may be cut, so up
    to some document the mix takes all once more than those behind it. One row a source names
    that document, and the texts are not moved to be joined by id. Only where several rows
    agree in id, source and size with it are they told apart by a number.
    """
    place = F.struct(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1).alias("place"), F.col("doc_id"), F.col("__size").alias("size"))
    met = mix(docs, seed=seed, **options).where("size > 0").select(_key().alias("__key"), "doc_id", F.col("size").alias("__size"), "copies")
    # Counted by place and then by source, so that a source with most of the rows meets in no task.
    places = met.groupBy("__key", place.alias("at"), "copies").agg(F.count(F.lit(1)).alias("n"))
    ends = places.groupBy("__key", "copies").agg(F.max(F.struct("at", "n")).alias("last"), F.min(F.struct("at", "n")).alias("first"))
    cuts = ends.groupBy("__key").agg(F.min("copies").alias("__low"), F.max("copies").alias("high"), F.max_by("last", "copies").alias("last"), F.min_by("first", "copies").alias("first"))
    last, first, cut = F.col("last"), F.col("first"), F.col("high") > F.col("__low")
    less = F.when(cut & (first["at"] == last["at"]), first["n"]).otherwise(0)
    cuts = cuts.select("__key", "__low", F.when(cut, last["at"]).alias("__cut"), F.when(cut, last["n"]).alias("__more"), less.alias("__less"))
    cuts = materialize(cuts)

    sized = with_size(docs, docs.columns, "__size").where("__size > 0").withColumn("__key", _key()).withColumn("__at", place)
    rows = sized.join(cuts, "__key")
    times = F.col("__low") + F.when(F.col("__at") <= F.col("__cut"), 1).otherwise(0)
    if not cuts.where("__less > 0").isEmpty():
        split = (F.col("__at") == F.col("__cut")) & (F.col("__less") > 0)
        number = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64("text")))
        part = rows.where(split).withColumn("__times", F.col("__low") + F.when(number <= F.col("__more"), 1).otherwise(0))
        rows = rows.where(F.coalesce(~split, F.lit(True))).withColumn("__times", times).unionByName(part)
    else:
        rows = rows.withColumn("__times", times)
    return rows.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(docs.columns)
