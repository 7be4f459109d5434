"""MinHash near-duplicates through an LSH forest.

A document is the set of its distinct runs of ``width`` words. Documents with equal sets
form one class, found by a fingerprint of the whole set, and only classes go on. Each
class has ``trees`` signature orders of ``depth`` MinHash values. In every order the
classes are sorted over the cluster by range (tree, signature, class), so that neither a
shared prefix nor equal signatures meet in one task, and each class meets the next
``reach`` ones that share its longest prefix: in a sparse region a short common prefix of
``min_depth`` values is enough, in a crowded one only the deepest neighbours are met.
Rows at the edge of a sorted partition are paired through a small table of edges.

Neighbours whose 128 sketch bits differ by far more than the threshold allows (five
standard errors) are left out; the others are confirmed on the full sets of both.

A region is crowded where more than ``reach`` classes share ``crowded`` values of an order.
There a class would meet too few of those that resemble it, so nothing is paired; the
order only says that these classes belong together. Classes that pairs or crowded runs
connect, with a crowded run among them, are one region, and a region is finished exactly:
every class outside its largest component is compared with every class of the other
components. Blocks of such classes meet blocks of the region in a task, where common
shingles are counted by one matrix product over the frequent ones and lists of the rest;
blocks are bounded in rows and bytes, and a task names one link per class and component.
So two similar classes are missed only if they share no long prefix in any order: where
they do, they are neighbours, or lie in one crowded region.

The sets of candidate classes are written once, and only they are joined with pairs and
blocks. Texts are joined by id only where a bit table of bounded size marks their id. A class is named by its smallest id and its fingerprint, so the smallest class of a
component is the answer and no join goes by component.

Rows: a null text and a text without words have an empty set and link with nothing. A row
without a ``doc_id`` cannot be named; it links with nothing and is kept. Every row counts
by its own set, also where an id repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinframe.llm.words import WHITESPACE_WORDS, Words, mix, slices, texts_of, windows
from kinframe.operators.cluster import connected_components
from kinframe.session import materialize

WIDTH = 5
TREES = 16
DEPTH = 8
MIN_DEPTH = 3
REACH = 4
CROWDED = 5
PERCENT = 80
# Largest blocks of the exact finish: classes to place, classes of the region, bytes of both.
PROBES, MEMBERS, BLOCK_BYTES = 1024, 2048, 16 << 20
# Most bits of the marks that spare texts a join by id: 262,144 rows, some megabytes.
MARK_BITS = 1 << 24


def _sets(w: Words, width: int):
    """The distinct shingle hashes of every text, sorted."""
    runs = windows(w.hash, width)
    for i in range(len(w.first) - 1):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            yield windows(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest scrambled shingle under every factor, folded to 32 bits."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(low, (factors[:, None] * part[None, :]).min(axis=1), out=low)
    low = mix(low)
    return (low ^ (low >> np.uint64(32))).astype(np.uint32)


SKETCH = 128


def _sketch(signature: np.ndarray) -> bytes:
    """One bit of each of the first values."""
    return np.packbits((signature[:SKETCH] & np.uint32(1)).astype(np.uint8)).tobytes()


def _fingerprint(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, width: int, trees: int, depth: int, seed: int = 0) -> DataFrame:
    """``(doc_id, n_shingles, cls, sketch, sig)``: set size, fingerprint, sketch, signature."""
    factors = mix(np.arange(1, trees * depth + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)

    def run(batches):
        for batch in slices(batches, "text"):
            size, cls, sketch, sig = [], [], [], []
            for s in _sets(Words(texts_of(batch, "text"), WHITESPACE_WORDS), width):
                values = _signature(s, factors)
                size.append(len(s))
                cls.append(_fingerprint(s))
                sketch.append(_sketch(values))
                sig.append(values.astype(">u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), *(pa.array(x, pa.binary()) for x in (cls, sketch, sig))],
                ["doc_id", "n_shingles", "cls", "sketch", "sig"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_shingles long, cls binary, sketch binary, sig binary")


def _too_far(percent: int) -> int:
    """Most sketch bits in which similar sets differ, five standard errors allowed."""
    p = (1 - percent / 100) / 2
    return int(np.ceil(SKETCH * p + 5 * np.sqrt(SKETCH * p * (1 - p))))


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _neighbours(rows: list[tuple], at_least: int, reach: int, min_depth: int, crowded: int, percent: int):
    """Pairs of rows of one tree, at most ``reach`` apart, with ``min_depth`` common values.

    Rows are ``(tree, key, cls, n_shingles, sketch)``; the later one has position
    ``at_least`` or more. Returns the classes, how many sketch bits agree, and whether the
    pair only joins two rows of a crowded run (then no bits are given).
    """
    tree, keys, cls, size, sketch = zip(*rows)
    n = len(rows)
    tree, size = np.array(tree), np.array(size)
    values = np.frombuffer(b"".join(keys), ">u4").reshape(n, -1)
    bits = np.frombuffer(b"".join(sketch), np.uint8).reshape(n, -1)

    def common(step: int) -> np.ndarray:
        differ = values[:-step] != values[step:]
        lcp = np.where(differ.any(1), differ.argmax(1), differ.shape[1])
        return np.where(tree[:-step] == tree[step:], lcp, -1)

    # A run begins where the row ``reach`` further shares ``crowded`` values; all rows between do.
    run = np.zeros(n + 1, np.int64)
    if n > reach:
        starts = np.flatnonzero(common(reach) >= crowded)
        np.add.at(run, starts, 1)
        np.add.at(run, starts + reach, -1)
    inside = np.cumsum(run)[: n - 1] > 0  # whether a row and the next are of one run
    at = np.flatnonzero(inside)
    at = at[at + 1 >= at_least - reach]  # known since the last call, or new
    left, right, agree, crowd = [at], [at + 1], [np.zeros(len(at), np.int64)], [np.ones(len(at), bool)]
    covered = np.concatenate([[0], np.cumsum(inside)])
    for step in range(1, min(reach, n - 1) + 1):
        lcp = common(step)
        hit = (lcp >= min_depth) & ~((covered[step:] - covered[:-step] == step) & (lcp >= crowded))
        hit[: max(0, at_least - step)] = False
        at = np.flatnonzero(hit)
        small, large = np.minimum(size[at], size[at + step]), np.maximum(size[at], size[at + step])
        off = _ONES[bits[at] ^ bits[at + step]].sum(1)
        fits = (100 * small >= percent * large) & (off <= _too_far(percent))
        at, off = at[fits], off[fits]
        left.append(at)
        right.append(at + step)
        agree.append(SKETCH - off)
        crowd.append(np.zeros(len(at), bool))
    left, right, agree, crowd = map(np.concatenate, (left, right, agree, crowd))
    return [cls[i] for i in left], [cls[i] for i in right], agree.tolist(), crowd.tolist()


ROW = ("tree", "key", "cls", "n_shingles", "sketch")
FOUND = "kind int, a binary, b binary, agree int, crowd boolean, tree int, key binary, n_shingles long, sketch binary"
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("agree", pa.int32()), ("crowd", pa.bool_()), ("tree", pa.int32()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("sketch", pa.binary())])


def _rows_of(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(batch.column(c).to_pylist() for c in ROW)))


def forest_rows(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """One row per class and tree with the tree's part of the signature as sort key."""
    key = F.expr(f"substring(sig, tree * {4 * depth} + 1, {4 * depth})")
    rows = classes.select("cls", "n_shingles", "sketch", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return rows.select("tree", key.alias("key"), "cls", "n_shingles", "sketch")


def candidates(classes: DataFrame, trees: int, depth: int, percent: int, min_depth: int, crowded: int, reach: int) -> DataFrame:
    """``(a, b, agree, crowd)`` with ``a < b``: classes that are neighbours in some order."""
    rows = forest_rows(classes, trees, depth)
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("tree", "key", "cls")

    def met(rows: list[tuple], at_least: int):
        a, b, agree, crowd = _neighbours(rows, at_least, reach, min_depth, crowded, percent)
        columns = [[0] * len(a), a, b, agree, crowd, *([[None] * len(a)] * 4)]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _FOUND)], schema=_FOUND)

    def edge(rows: list[tuple]):
        tree, keys, cls, size, sketch = zip(*rows)
        none = [None] * len(rows)
        columns = [[1] * len(rows), cls, none, none, none, tree, keys, size, sketch]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _FOUND)], schema=_FOUND)

    def run(batches):
        held, first = [], []
        for batch in batches:
            new = _rows_of(batch)
            if not new:
                continue
            first += new[: max(0, reach - len(first))]
            yield met(held + new, len(held))
            held = (held + new)[-reach:]
        if held:
            yield edge(first)
            yield edge(held)

    found = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, FOUND))
    # At most 2 * reach rows of each sorted partition.
    borders = found.where("kind = 1").select("tree", "key", F.col("a").alias("cls"), "n_shingles", "sketch").distinct()

    def across(batches):
        rows = [r for batch in batches for r in _rows_of(batch)]
        if rows:
            yield met(rows, 0)

    pairs = found.where("kind = 0").unionByName(borders.coalesce(1).sortWithinPartitions(*order).mapInArrow(across, FOUND))
    return (
        pairs.where("a <> b")
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.max("agree").alias("agree"), F.max("crowd").alias("crowd"))
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def _apart(docs: DataFrame, ids: DataFrame, most_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may have one of the ``ids``, and those that have none of them.

    Each id sets one of about 16 bits an id, ``most_bits`` at most, 64 to a row. So the marks
    are bounded however many ids there are, they are broadcast, and texts are not moved. With
    more ids more rows only may have one, which a join by id then decides.
    """
    bits = min(most_bits or MARK_BITS, max(1024, 16 * ids.count()))
    word, bit = f"cast(pmod(xxhash64(doc_id), {bits}L) div 64 as int)", f"cast(pmod(xxhash64(doc_id), {bits}L) % 64 as int)"
    marks = materialize(ids.groupBy(F.expr(word).alias("__word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("__bits")))
    hit = F.expr(f"__word = {word} AND getbit(__bits, {bit}) = 1")
    return docs.join(F.broadcast(marks), hit, "left_semi"), docs.join(F.broadcast(marks), hit, "left_anti")


def _class_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(cls, shingles)``: the sorted shingle hashes of every wanted class, from one of its documents."""

    def run(batches):
        # Of rows that repeat an id, those with the set of the class.
        for batch in slices(batches, "text"):
            own = batch.column("cls").to_pylist()
            sets = list(_sets(Words(texts_of(batch, "text"), WHITESPACE_WORDS), width))
            same = [i for i, (s, c) in enumerate(zip(sets, own)) if _fingerprint(s) == c[-16:]]
            yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in same], pa.binary()), pa.array([sets[i].tobytes() for i in same], pa.binary())], ["cls", "shingles"])

    named = materialize(reps.join(wanted, "cls", "left_semi").select(F.col("rep").alias("doc_id"), "cls"))
    found = _apart(docs.select("doc_id", "text"), named)[0].join(named, "doc_id").select("cls", "text").mapInArrow(run, "cls binary, shingles binary")
    return found.dropDuplicates(["cls"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("set_a", "set_b"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("cls").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _components(links: DataFrame) -> DataFrame:
    """``(cls, comp)`` of the linked classes; ``comp`` is the smallest one."""
    return materialize(connected_components(links, "a", "b").select(F.col("id").alias("cls"), F.col("component").alias("comp")))


def _name(kind: T.DataType):
    """The key of a class: its smallest id in a form that sorts as the id, then its fingerprint."""
    if isinstance(kind, T.StringType):
        return F.concat(F.encode("rep", "utf-8"), F.unhex(F.lit("00")), F.col("mark"))
    return F.concat(F.unhex(F.lpad(F.hex(F.col("rep").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")), F.col("mark"))


def _id_of(kind: T.DataType):
    """The smallest id of the component ``comp``."""
    if isinstance(kind, T.StringType):
        return F.decode(F.expr("substring(comp, 1, length(comp) - 17)"), "utf-8")
    return (F.conv(F.hex(F.substring("comp", 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast(kind)


def _parties(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """``(cls, comp, region, probe)`` of the crowded regions that lie in several components.

    Every class outside the largest component of its region is a probe.
    """
    found = _components(pairs.select("a", "b")).withColumnRenamed("comp", "region")
    crowded = pairs.where("crowd").select(F.col("a").alias("cls")).distinct().join(found, "cls").select("region").distinct()
    members = found.join(crowded, "region", "left_semi").join(comps.select("cls", "comp"), "cls", "left")
    members = materialize(members.select("cls", "region", F.coalesce("comp", "cls").alias("comp")))
    sizes = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"))
    homes = sizes.groupBy("region").agg(F.max_by("comp", F.struct("n", "comp")).alias("home"), F.count(F.lit(1)).alias("parts"))
    return materialize(members.join(homes.where("parts > 1"), "region").select("cls", "comp", "region", (F.col("comp") != F.col("home")).alias("probe")))


class _Probes:
    """Sets of one pass, by shingle: frequent ones as columns of a matrix, others as lists."""

    COLUMNS = 2048

    def __init__(self, cls: list[bytes], comp: list[bytes], sets: list[np.ndarray]):
        self.cls, self.comp, self.size = cls, comp, np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.shingles, at, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = np.argsort(-df, kind="stable")[: self.COLUMNS]
        often = often[64 * df[often] >= len(sets)]
        self.column = np.full(len(df), -1)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), len(sets)), np.float32)
        dense = self.column[at] >= 0
        self.matrix[self.column[at[dense]], owner[dense]] = 1
        order = np.argsort(at, kind="stable")
        self.owner, self.df, self.start = owner[order], df, np.cumsum(df) - df

    def common(self, sets: list[np.ndarray]) -> np.ndarray:
        """Common shingles of every set with every probe."""
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.shingles, flat), len(self.shingles) - 1)
        hit = self.shingles[at] == flat
        at, row = at[hit], row[hit]
        dense = self.column[at] >= 0
        marks = np.zeros((len(sets), len(self.matrix)), np.float32)
        marks[row[dense], self.column[at[dense]]] = 1
        out = (marks @ self.matrix).astype(np.int64)
        at, row = at[~dense], row[~dense]
        n = self.df[at]
        each = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out, (np.repeat(row, n), self.owner[np.repeat(self.start[at], n) + each]), 1)
        return out


_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _exact_links(parties: DataFrame, sets: DataFrame, percent: int, probes: int = PROBES, members: int = MEMBERS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(a, b)``: links of all probes with classes of other components of their region.

    A block of probes meets a block of members in a task, which names one link per probe
    and component.
    """
    rows = materialize(parties.join(sets, "cls"))
    size = F.octet_length("shingles")
    blocks = lambda n, most, total: F.greatest(F.ceil(n / most), F.ceil(total / block_bytes), F.lit(1)).cast("int")
    deal = rows.groupBy("region").agg(
        blocks(F.count_if("probe"), probes, F.sum(F.when(F.col("probe"), size).otherwise(0))).alias("across"),
        blocks(F.count(F.lit(1)), members, F.sum(size)).alias("down"),
    )
    dealt = rows.join(deal, "region")
    place = F.xxhash64("cls")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = dealt.where("probe").select("region", F.pmod(place, "across").alias("x"), F.explode(upto("down")).alias("y"), F.lit(True).alias("asks"), "cls", "comp", "shingles")
    shown = dealt.select("region", F.explode(upto("across")).alias("x"), F.pmod(place, "down").alias("y"), F.lit(False).alias("asks"), "cls", "comp", "shingles")

    def run(table):
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        cls, comp = table.column("cls").to_pylist(), table.column("comp").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        ask, show = np.flatnonzero(asks), np.flatnonzero(~asks)
        a, b, seen = [], [], set()
        if len(ask):
            held = _Probes([cls[i] for i in ask], [comp[i] for i in ask], [sets[i] for i in ask])
            codes = {c: k for k, c in enumerate(dict.fromkeys(comp))}
            probe_comp = np.array([codes[c] for c in held.comp])
            for at in range(0, len(show), 256):
                part = show[at : at + 256]
                common = held.common([sets[i] for i in part])
                total = np.array([len(sets[i]) for i in part])[:, None] + held.size[None, :]
                own = np.array([codes[comp[i]] for i in part])
                hit = (100 * common >= percent * (total - common)) & (own[:, None] != probe_comp[None, :])
                for i, j in zip(*(x.tolist() for x in np.nonzero(hit))):
                    if (j, own[i]) not in seen:
                        seen.add((j, own[i]))
                        a.append(min(cls[part[i]], held.cls[j]))
                        b.append(max(cls[part[i]], held.cls[j]))
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=_LINK)

    # Dealt anew: the rows lie by region, which would leave a region to one task.
    blocks_of = asked.unionByName(shown).repartition("region", "x", "y")
    return blocks_of.groupBy("region", "x", "y").applyInArrow(run, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    percent: int = PERCENT,
    width: int = WIDTH,
    trees: int = TREES,
    depth: int = DEPTH,
    min_depth: int = MIN_DEPTH,
    crowded: int = CROWDED,
    reach: int = REACH,
    **blocks: int,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Documents are linked when their sets have a Jaccard similarity of ``percent`` / 100 or
    more; ``component_id`` is the smallest id of the component. ``blocks`` bounds the
    blocks of the exact finish.
    """
    rows = materialize(signatures(docs, width, trees, depth).withColumnRenamed("cls", "mark"))
    named = rows.where(F.col("doc_id").isNotNull() & F.col("mark").isNotNull())
    kind = rows.schema["doc_id"].dataType
    alike = [F.first(c).alias(c) for c in ("n_shingles", "sketch", "sig")]
    classes = materialize(named.groupBy("mark").agg(F.min("doc_id").alias("rep"), *alike).withColumn("cls", _name(kind)))

    pairs = materialize(candidates(classes, trees, depth, percent, min_depth, crowded, reach))
    sets = materialize(_class_sets(docs, classes.select("cls", "rep"), _ends(pairs), width))
    links = materialize(_links(pairs.where("agree > 0").select("a", "b"), sets, percent))
    comps = _components(links)
    if not pairs.where("crowd").isEmpty():
        more = materialize(_exact_links(_parties(pairs, comps), sets, percent, **blocks))
        if not more.isEmpty():
            comps = _components(links.unionByName(more))

    labels = classes.select("mark", "rep", "cls").join(comps.select("cls", _id_of(kind).alias("component_id")), "cls", "left")
    out = rows.select("doc_id", "n_shingles", "mark").join(labels.select("mark", F.coalesce("component_id", "rep").alias("component_id")), "mark", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    Of rows that repeat the id of a kept document one stays; rows without an id all stay.
    """
    found = materialize(near_duplicates(docs, percent, **options))
    # Ids whose every row is in a group of a smaller one go; they are named once.
    gone = materialize(found.where("NOT kept").select("doc_id").distinct())
    doubtful, others = _apart(docs, gone)
    left = others.unionByName(doubtful.join(gone, "doc_id", "left_anti"))
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    return left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)
