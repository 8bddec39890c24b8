"""A corpus in five stages: language, near copies, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before kept, and is written as Parquet before the next
reads it. All but the last return the columns of documents. The last one's position is a document's place in the mixture, from the files' order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, common, jaccard_join, language_id, mixing, secret_scan

STAGES = [
    ("language", language_id.stage),
    ("near copies", jaccard_join.stage),
    ("secrets", secret_scan.stage),
    ("mixture", mixing.stage),
    ("tokens", bpe.stage),
]

# BPE and rank-order profiles are beyond SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
