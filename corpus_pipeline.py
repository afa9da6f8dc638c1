"""A training-data pipeline: toxic documents go, exact copies go, one document of
each group of near copies stays, sources are mixed to target weights, and what is
left is packed into token sequences.

Each stage works on all its predecessor kept and, but for the last, returns the
columns of ``documents``. ``run`` writes each as Parquet to the shared folder and
reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirespark.llm.common import documents, staged
from quirespark.llm.exact_dedup import drop_copies
from quirespark.llm.mixing import mixed_documents
from quirespark.llm.near_dedup import drop_near_copies
from quirespark.llm.packing import pack_documents
from quirespark.llm.queries import tokenizer_path
from quirespark.llm.toxicity import drop_toxic


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the near-duplicate, tokenizer and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
