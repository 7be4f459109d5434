"""A training-data pipeline over ``documents``: five stages, each written and read again.

Toxic documents go, one document of each group of near copies stays, documents with
passages of the benchmark go, sources are mixed to their target weights, and the rest is
written as token shards and read back. Each stage works on what the one before kept and
returns the columns of ``documents``, but for the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kinframe.llm import decontaminate, minhash_forest, mixing, token_shards, toxicity
from kinframe.llm import queries as registered
from kinframe.session import checkpoint_root

NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the ordinal regression finds toxic."""
    model = toxicity.train(docs, registered.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_forest.drop_near_duplicates(docs, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontaminate.decontaminate(docs, registered.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated as often as it takes them."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back."""
    return token_shards.round_trip(docs, registered.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", write_tokens),
]

# MinHash candidates and token ids are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written below the shared folder."""
    docs = registered.table(spark, sf_dir, "documents")
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {**registered.QUERIES, "pipeline": run}
SQL = {**registered.SQL, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
