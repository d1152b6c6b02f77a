"""A corpus from ``documents``: toxic documents go, copies and near copies go,
sources are mixed to their targets, and what is left is packed for training.

Every stage works on all that the one before kept; its result is written as
Parquet under ``spark.checkpoint.dir`` and read again, so a lost executor never
costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritab.llm import dedup, jaccard, mixing, packing, toxicity
from veritab.llm.common import materialize
from veritab.sources.tables import load_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents scored 0.5 or more go."""
    return toxicity.drop_toxic(docs, load_table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the row with the largest id stays."""
    return dedup.drop_duplicates_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 on five words and a similarity of 0.8: of linked documents
    the one with the smallest id stays."""
    return jaccard.one_per_component(docs, shingle_words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document as often as the mix takes it."""
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the pieces of all documents with their seats."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies),
          ("mixing sources", mix), ("best-fit packing", pack)]

#: The learned scores and the tokenizer have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last one."""
    docs = load_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
