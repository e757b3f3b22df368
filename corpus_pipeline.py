"""A corpus pipeline of four stages over the documents table: toxic documents go, of near copies one stays, live-looking
credentials are masked, and what is left is packed into windows of token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logtrawl.llm import packing, secrets, signature_join, toxicity
from logtrawl.llm.common import byte_bpe_path, shared_folder
from logtrawl.llm.queries import HELD_OUT


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.without_toxic(docs, labels, keep="not " + HELD_OUT.format("id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return signature_join.one_of_each_group(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, byte_bpe_path(), end_id=0, window=1024)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]

#: none of it for SQL: the tokenizer, the fitted score and the groups of linked documents are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written to the shared folder and read again as the next one's input."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
