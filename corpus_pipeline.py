"""The corpus pipeline: documents in, token ids in binary shards out.

Each stage works on all that the stage before it kept, and is one of the operators
with its production parameters. All but the last return the columns of documents.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import decontaminate, mixing, prob_minhash, token_store, toxicity
from gradeloom.llm.common import table, without
from gradeloom.llm.queries import END_ID
from gradeloom.llm.registry import QUERIES
from gradeloom.session import shared_dir


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain does not reject; it learns from labelled rows of ``docs``."""
    chain = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, chain)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return prob_minhash.survivors(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by benchmark items."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter("contaminated").select("doc_id", "tie"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated to the target weights of their sources, in shuffled order."""
    return mixing.mixed(docs).select("_row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row, written, and read back by key: (doc_id, start, n_tokens, ids_crc32, shard)."""
    folder, manifest = token_store.write(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_store.lookup(folder, manifest, docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("near-duplicates", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
    ("token ids", token_stage),
]

# Trained models, sketches and tokenizers are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again under the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs


QUERIES["pipeline"] = run
