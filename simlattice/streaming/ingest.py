"""Appends a parser's records to the tables of functions and postings as files arrive; the next analysis starts from these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import blocking
from ..sources.files import RECORD, with_ids


def functions(spark: SparkSession, folder: str, lang: str = "java") -> DataFrame:
    """A stream of function rows from record files, each read once. A function that comes again is a row again."""
    d = spark.readStream.schema(RECORD).option("multiLine", "true").json(folder).select(F.explode("functions").alias("f")).select("f.*")
    d = d.where("not coalesce(test_code, false) and not coalesce(generated_code, false)")
    return with_ids(d.drop("token_seq_hash").withColumnRenamed("package_name", "package").withColumn("lang", F.lit(lang)))


def append(rows: DataFrame, index: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes the stream's functions and their postings into the tables of a stored index, in the partition of their language.

    A batch is a partition of its own in it, as store.GROWING has it, so that a batch which is tried again replaces what it left.
    """

    def write(batch: DataFrame, number: int) -> None:
        able = blocking.eligible(batch)
        langs = [r[0] for r in batch.select("lang").distinct().collect()]  # a handful: parsers, not rows
        for lang in langs:
            here = F.col("lang") == lang
            for name, d in (("functions", batch.where(here).drop("lang")), ("postings", blocking.postings(able.where(here)))):
                d.write.mode("overwrite").parquet(f"{index}/{name}/lang={lang}/batch={number}")

    w = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
