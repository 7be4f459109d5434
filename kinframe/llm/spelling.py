"""Spelling variants: words one edit apart, found by walking a trie kept as a table.

The trie is a distributed table of edges and the search a frontier of states ``(word,
rest, node, edits)``: the part of a word still to be read, the node reached, and the edits
spent. Each round joins the frontier with the edges of its nodes. An inner edge is read as
it is, or with one inserted, deleted or replaced code point if no edit was spent before; an
edge to a leaf must use up the rest of the word with exactly one edit in all, and names a
neighbour. Rounds go on until the frontier is empty.

Three things keep the frontier small. Every word is walked twice, from its start and from
its end, and starts in the middle: an edit in the second half leaves the first half as it
is, so the walk begins at the node of that half, deep in the trie; the other half is found
by the walk over the reversed words. A node with at most ``BURST`` words below it has
one leaf edge for each of them, with all that is left of the word, and chains without a
branch are one edge, so a walk takes few rounds. And inner edges know which two letters
can follow, so that states which the next round could not read are dropped.

The trie is made in sorted order: words are range-partitioned by the node of their half
and the rest, and each partition writes the edges of its own stretch. A node whose words
fall into several partitions has several sets of edges, each complete for its own words. A
node has at most as many edges as the alphabet has letters, or ``BURST``, per partition: a
hot half multiplies its states by that at most, adaptive execution splits the join, and
pairs within a group are never listed. Nodes are hashes; leaves are compared with the word
itself before they count, so a collision cannot change a result.

Rows: a null or empty text has no words; a null id counts as the empty text in the
checksum of ``perturbed_words``. Repeated rows count each. A word without neighbours has
no form, and is its own root. Of equally frequent neighbours the smallest in code-point
order is the form. Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.llm.words import slices, texts_of
from kinframe.session import materialize

MIN_LENGTH = 7
MIN_COUNT = 2
FORM_FACTOR = 10
DELETE_EVERY = 31
FLUSH = 500_000
#: Words below a node that get an edge each, and letters that an inner edge looks ahead.
BURST = 32
LOOK = 2


# ------------------------------------------------------------------ words


def perturbed_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """``(word, n)``: words of all texts with their occurrences, some with a letter lost.

    A run of letters in a document loses a code point if ``delete_every`` divides the
    checksum of ``<doc_id>:<run>``; 0 turns that off.
    """
    letters = re.compile(f"[a-zA-ZÀ-ÿ]{{{min_length},}}")

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc").to_pylist(), texts_of(batch, "text")):
                if not text:
                    continue
                start = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in Counter(letters.findall(text.lower().decode())).items():
                    if delete_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % delete_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    counts[word] += n
            if len(counts) >= FLUSH:
                yield _count_batch(counts)
                counts = Counter()
        yield _count_batch(counts)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _count_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


# ------------------------------------------------------------------ trie


def _halves(words: DataFrame) -> DataFrame:
    """``(word, n, spelled, length, side)``: words as read from both ends."""
    both = words.select("word", "n", F.length("word").alias("length"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    return both.withColumn("spelled", F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")))


def _half(length: Column) -> Column:
    """Letters before the walk of a word of this length: together the two sides leave none out."""
    return F.when(F.col("side") == 0, F.ceil(length / 2)).otherwise(F.floor(length / 2)).cast("int")


def _node(depth: Column) -> Column:
    return F.xxhash64("side", depth, F.substring(F.col("spelled"), F.lit(1), depth))


def _start(words: DataFrame) -> DataFrame:
    """The first frontier: every word at the node of its half, no edit spent."""
    half = _half(F.col("length"))
    return _halves(words).select("word", F.substring(F.col("spelled"), half + 1, F.col("length")).alias("rest"), _node(half).alias("node"), F.lit(0).alias("edits"))


_EDGES = "node long, inner boolean, label string, child long, ahead string, leaf string, leaf_n long"


def _subtree(start: int, rests: list[str], words: list[str], counts: list[int], number, burst: int) -> list[tuple]:
    """The edges below a node for sorted remainders of words."""
    out, todo = [], [(start, 0, 0, len(rests))]
    while todo:
        node, depth, low, high = todo.pop()
        inner = node != start
        if high - low <= burst:
            out += [(node, inner, rests[i][depth:], None, None, words[i], counts[i]) for i in range(low, high)]
            continue
        while low < high and len(rests[low]) == depth:  # words that end here
            out.append((node, inner, "", None, None, words[low], counts[low]))
            low += 1
        while low < high:
            letter = rests[low][depth]
            end = bisect.bisect_left(rests, rests[low][:depth] + chr(ord(letter) + 1), low, high)
            if end - low == 1:
                out.append((node, inner, rests[low][depth:], None, None, words[low], counts[low]))
            else:
                below = len(os.path.commonprefix([rests[low], rests[end - 1]]))
                child = next(number)
                follows = sorted({r[below : below + LOOK] for r in rests[low:end]})
                out.append((node, inner, rests[low][depth:below], child, f"|{'|'.join(follows)}|", None, None))
                todo.append((child, below, low, end))
            low = end
    return out


def _edges(words: DataFrame, burst: int) -> DataFrame:
    """The edges of all nodes from the halves down; ``inner`` ones are met from the second round on."""

    def run(batches):
        number = itertools.count((TaskContext.get().partitionId() << 40) + 1)
        group, out = (None, [], [], []), []
        for batch in batches:
            for node, rest, word, n in zip(*(batch.column(c).to_pylist() for c in ("node", "rest", "word", "n"))):
                if node != group[0]:
                    out += _subtree(*group, number, burst)
                    group = (node, [], [], [])
                for column, value in zip(group[1:], (rest, word, n)):
                    column.append(value)
            if len(out) > 50_000:
                yield _edge_batch(out)
                out = []
        yield _edge_batch(out + _subtree(*group, number, burst))

    halves = _halves(words)
    # Words one letter shorter or longer may start their walk here.
    depths = F.array_distinct(F.array(*[_half(F.col("length") + d) for d in (-1, 0, 1)]))
    rows = halves.withColumn("depth", F.explode(depths)).where("depth <= length")
    rows = rows.select(_node(F.col("depth")).alias("node"), F.substring(F.col("spelled"), F.col("depth") + 1, F.col("length")).alias("rest"), "word", "n")
    return rows.repartitionByRange("node", "rest").sortWithinPartitions("node", "rest").mapInArrow(run, _EDGES)


def _edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [x.split(" ")[0] for x in _EDGES.split(", ")])


# ------------------------------------------------------------------ frontier


def _goes_on(n: str) -> str:
    return f"instr(ahead, concat('|', substring(rest, {n} + 1, {LOOK}), '|')) > 0"


_HIT = "leaf IS NOT NULL AND if(edits = 0, abs(length(label) - length(rest)) <= 1 AND levenshtein(label, rest, 1) = 1, label = rest)"
_EDITED = "edits = 0 AND {n} >= 0 AND length(rest) >= {n} AND {on} AND levenshtein(label, left(rest, {n}), 1) = 1"
_READ = "array_compact(array(if(startswith(rest, label) AND (edits = 0 OR {on}), struct(length(label) AS taken, edits AS spent), null), {edited}))".format(
    on=_goes_on("length(label)"),
    edited=", ".join(f"if({_EDITED.format(n=n, on=_goes_on(n))}, struct({n} AS taken, 1 AS spent), null)" for n in ("(length(label) - 1)", "length(label)", "(length(label) + 1)")),
)


def _round(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """What one edge further finds: neighbours (``near``), and states at inner nodes."""
    met = frontier.join(edges, "node").where(F.expr(f"if(leaf IS NOT NULL, {_HIT}, edits = 0 OR startswith(rest, label))"))
    read = met.select("word", "rest", "child", F.col("leaf").alias("near"), F.col("leaf_n").alias("near_n"), F.explode_outer(F.when(F.col("leaf").isNull(), F.expr(_READ))).alias("r"))
    read = read.where("near IS NOT NULL OR r IS NOT NULL")
    return read.select("word", F.when(F.col("near").isNull(), F.expr("substring(rest, r.taken + 1)")).alias("rest"), F.col("child").alias("node"), F.col("r.spent").alias("edits"), "near", "near_n")


def neighbours(words: DataFrame, burst: int = BURST) -> DataFrame:
    """``(word, near, near_n)``: for every word the words one edit away, in both directions.

    ``words`` holds distinct ``word`` of at least two letters, with ``n``.
    """
    edges = materialize(_edges(words, burst))
    found = []
    frontier, mine = _start(words), edges.where("NOT inner")
    while True:
        states = materialize(_round(frontier, mine))
        found.append(states.where("near IS NOT NULL").select("word", "near", "near_n"))
        frontier, mine = states.where("near IS NULL").select("word", "rest", "node", "edits"), edges.where("inner")
        if frontier.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.where(F.expr("levenshtein(word, near, 1) = 1")).distinct()


# ------------------------------------------------------------------ groups


def variants(words: DataFrame, factor: int = FORM_FACTOR, burst: int = BURST) -> DataFrame:
    """Per word: its form, the root of its chain of forms, and counts.

    The form is the most frequent neighbour with at least ``factor`` times the occurrences.
    Forms grow by that factor, so chains are short; they are followed by doubling.
    """
    words = materialize(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near")))
    near = neighbours(words, burst).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus_n") >= factor * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.minus_n")).alias("form_n"),
    )
    out = materialize(out)
    links = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("up"))
    while True:
        onward = links.select(F.col("word").alias("up"), F.col("up").alias("next"))
        further = materialize(links.join(onward, "up", "left").select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        moved = not further.where("moved").isEmpty()
        links = further.select("word", "up")
        if not moved:
            break
    return out.join(links, "word", "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")
