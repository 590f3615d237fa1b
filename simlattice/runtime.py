"""Where intermediate results live, and small helpers that all operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). A local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="simlattice-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; later plans begin there, and a lost executor repeats nothing before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like cut(), but columns are packed and read alone. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Actions within run under this setting of the session."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def col(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's 0-based place in the whole order, found without bringing all rows into one task.

    Rows are range-sorted; a partition's first place is the number of rows before it. ``order`` should be total: rows that tie take
    places in any order. Empty table: no row.
    """
    s = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__r", F.monotonically_increasing_id()))
    per = s.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__r").alias("__first"))  # a row for each partition
    per = per.select("__p", "__first", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__base"))
    return s.join(per, "__p").select(*[col(c) for c in df.columns], (F.col("__base") + F.col("__r") - F.col("__first")).alias(name))
