"""The index: Parquet tables of functions, postings, frequencies, clusters, members and near misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking, calibrate, report
from ..plans.analysis import Analysis


#: Tables that a stream appends to, with a partition for each of its batches; what the index began with is this one.
GROWING, FIRST_BATCH = ("functions", "postings"), -1


def write_index(analyses: dict[str, Analysis], index: str) -> None:
    """Writes the index of every language's analysis, in place of what was there. Tables that are read by language are partitioned by it."""
    for name, of in _TABLES.items():
        rows = None
        for lang, a in analyses.items():
            d = of(a).withColumn("lang", F.lit(lang))
            rows = d if rows is None else rows.unionByName(d)
        # a partitioned table without rows has no file to tell its schema
        rows.sparkSession.createDataFrame([(rows.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{index}/_schemas/{name}")
        by = ("tier",) if name == "clusters" else ("lang",)
        if name in GROWING:
            rows, by = rows.withColumn("batch", F.lit(FIRST_BATCH)), (*by, "batch")
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{index}/{name}")


def _clusters(a: Analysis) -> DataFrame:
    return a.clusters.join(report.ordinals(a.clusters).drop("tier"), "cluster_id").withColumn("stage", F.lit("identified"))


_TABLES = {
    "functions": lambda a: a.fns.drop("lang"), "postings": lambda a: a.postings, "doc_freq": lambda a: blocking.doc_freq(a.postings), "clusters": _clusters,
    "cluster_members": lambda a: a.members, "near_misses": lambda a: a.near_misses,
}


def write_calibration(points: DataFrame, path: str) -> None:
    """The table of points as one CSV file; it has a row for each threshold."""
    header = "threshold,clusters,clustered,coverage,coherence,callCoherence,meanScore,bootstrapStability,stableClusters,noiseClusters,meanSize,medianSize,maxSize"
    lines = [header, *[r[0] for r in calibrate.csv_rows(points).collect()]]  # one row, so that the header stays in front
    points.sparkSession.createDataFrame([("\n".join(lines),)], "lines string").coalesce(1).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", "true").option("quoteAll", "true").csv(path)
