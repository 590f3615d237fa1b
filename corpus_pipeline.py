"""From raw documents to packed training windows. Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from simlattice.llm import exact_dedup, mixing, near_dedup, packing, quality
from simlattice.llm.common import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep: see quality.judge(). Null and empty texts go, blank and short ones stay; repeated
    rows are judged one by one."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each text the row of the least doc_id: see exact_dedup.duplicates(). Null and empty texts all stay; a null doc_id comes last."""
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document that outranks the others: see near_dedup.near_duplicates(). Rows without text or
    doc_id stay; rows that share a doc_id go or stay together."""
    return near_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mixture's order, once for each epoch of their source: see mixing.mixed_documents(). Rows without a token go;
    rows that repeat or share a null doc_id are told apart by number."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows' contents: see packing.pack(). Every token of every row is packed once; a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_duplicates), ("near dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: The divergence of histograms, MinHash bands and the packing plan have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet in the shared folder, read again, and removed once its
    successor's is there. The last goes when the driver ends."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(base)
    for i, (_, stage) in enumerate(STAGES):
        now = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if last:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(last), True)
        last = now
    return docs
