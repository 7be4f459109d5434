"""Texts are not moved to be joined by id: what leaves out copies and what repeats the mix."""

import collections
import random

from kinframe.llm import minhash_forest, mixing

DOCS = "doc_id long, text string, lang string, source string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marked_rows_are_told_apart_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "a") for i in range(500)] + [(7, "again", "en", "a"), (None, "no id", "en", "a")], DOCS)
    ids = spark.range(0, 500, 3).withColumnRenamed("id", "doc_id")
    wanted = set(range(0, 500, 3))
    for bits in (None, 1, 64, 300):
        doubtful, others = (x.collect() for x in minhash_forest._apart(docs, ids, bits))
        assert sorted(r.text for r in doubtful + others) == sorted(r.text for r in docs.collect())
        assert wanted <= {r.doc_id for r in doubtful} and not wanted & {r.doc_id for r in others}
    assert len(doubtful) < 500
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part in minhash_forest._apart(docs, ids):
            assert "Exchange hashpartitioning" not in plan_of(part)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    everything, none = minhash_forest._apart(docs, ids.limit(0))
    assert everything.count() == 0 and none.count() == 502


def test_the_mix_repeats_rows_without_a_join_by_id(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(60), "en", rng.choice(["a"] * 5 + ["b", None])) for i in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        out = mixing.mixed_documents(docs, block=64)
        assert "SortMergeJoin" not in plan_of(out)
        want = {r.doc_id: r.copies for r in mixing.mix(docs, block=64).collect() if r.copies}
        assert collections.Counter(r.doc_id for r in out.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_that_agree_are_told_apart_where_the_last_pass_ends(spark):
    # Without ids, all rows of a size stand together in the stream; the last pass ends among them.
    rows = [(None, " ".join(["w"] * 10 + [f"x{i}"]), "en", "ab"[i % 4 == 0]) for i in range(200)] + [(5, "one two", "en", "c"), (6, None, "en", None)]
    docs = spark.createDataFrame(rows, DOCS)
    want = collections.Counter()
    for r in mixing.mix(docs, block=64).collect():
        want[r.doc_id, r.source, r.copies] += 1
    got = collections.Counter(r.text for r in mixing.mixed_documents(docs, block=64).collect())
    times = collections.Counter((i, s, got[t]) for i, t, _, s in rows)
    assert times == want
    assert len({c for i, s, c in want if s == "a"}) == 2
