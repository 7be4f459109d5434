"""The registered queries of the subpackage: SQL twins and the pipeline's decisions."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from kinframe.llm import queries

SF = os.environ.get("KINFRAME_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(name, spark, tables):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert canonical(df.select(*columns).collect()) == canonical(want)


def test_thirteen_queries_and_a_pipeline():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(corpus_pipeline.QUERIES) == {*queries.QUERIES, "pipeline"}


def test_pipeline_stages(spark, tmp_path):
    """Every stage takes effect, keeps what is clean, and the last one reads back all of it."""
    docs = queries.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "token_shards":
            assert docs.columns == columns
        kept[name] = docs
    n = {k: v.count() for k, v in kept.items()}
    assert before > n["toxicity"] > n["near_duplicates"] > n["decontamination"] > 0.7 * before
    toxic = queries.table(spark, SF, "labels").where("toxic = 1")
    gone = queries.table(spark, SF, "documents").join(kept["toxicity"], "doc_id", "left_anti")
    assert gone.join(toxic, "doc_id").count() > 0.6 * toxic.count()
    assert gone.join(queries.table(spark, SF, "labels").where("toxic = 0"), "doc_id").count() <= 2
    bench = queries.table(spark, SF, "benchmark")
    from kinframe.llm import decontaminate, minhash_forest

    assert decontaminate.report(kept["decontamination"], bench).where("contaminated").count() == 0
    again = minhash_forest.near_duplicates(kept["near_duplicates"], corpus_pipeline.NEAR_PERCENT)
    assert again.where("NOT kept").count() == 0
    texts = {r.doc_id for r in kept["mixing"].collect()}
    assert texts <= {r.doc_id for r in kept["decontamination"].select("doc_id").collect()}
    assert docs.count() == n["mixing"] and {r.doc_id for r in docs.collect()} == texts
