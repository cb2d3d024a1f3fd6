"""From raw documents to token files: filter, deduplicate, decontaminate, mix, encode.

Every stage reads what its predecessor wrote and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hitledger.llm import decontaminate, jaccard_join, mixing, quality, token_store
from hitledger.llm.common import table, written
from hitledger.llm.queries import byte_bpe_path
from hitledger.sinks.scratch import scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a phrase of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are sampled towards the target weights."""
    return mixing.sample_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns its documents: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(spark, "tokens")
    token_store.write_store(docs, path, byte_bpe_path())
    return token_store.read_documents(spark, path)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", one_of_each_class),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The classifier, the hashes of the sampling and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
