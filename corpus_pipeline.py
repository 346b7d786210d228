"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and returns the columns of ``documents``, but for the
last, which returns the packed pieces.

Defined results: a null or empty text has no words and is rejected by the first stage. A null id goes through like any other.
Rows that repeat an id and a text are copies of each other, of which near dedup keeps one; rows that repeat an id with another text
stay documents of their own. Ties between copies go to the least id. Columns that ``documents`` has beside the five are dropped by
the first stage. An empty table gives an empty result.

What stands between two stages is written under the shared checkpoint folder, where whatever clears that folder finds it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, near_dedup, packing, quality_rules, toxicity
from tessera.llm.common import ensure_checkpoint_dir, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the threshold table."""
    return quality_rules.passing(docs).select(*COLUMNS)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, scores below one half."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, into="__toxicity").where(F.col("__toxicity") < 0.5).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return near_dedup.one_of_each(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("toxicity", non_toxic),
    ("near dedup", deduplicated),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``; what stands between two stages is written to the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
    return docs


#: The classifier, the dedup and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
