"""Summaries: tiers, histograms, coverage of packages, directions of deltas, and what they say in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import profile as P

SCORE_LABELS = ("0.55 – 0.65", "0.65 – 0.75", "0.75 – 0.85", "0.85 – 0.95", "0.95 – 1.00")
SIZE_LABELS = ("3 – 4", "5 – 9", "10+")
DIRECTIONS = ("missing", "extends", "mixed")


def tier_counts(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("tier").agg(F.count("*").alias("clusters"))


def tier_rollup(clusters: DataFrame, lang: str = "lang") -> DataFrame:
    """(tier, lang, clusters): by both, by each and of all; the summed-up column is null."""
    return clusters.cube("tier", lang).agg(F.count("*").alias("clusters"))


def _histogram(values: DataFrame, bucket: Column, labels: tuple[str, ...]) -> DataFrame:
    """(bucket, label, count, width): all buckets, empty ones too; the width is a percentage of the largest."""
    spark = values.sparkSession
    names = spark.createDataFrame(list(enumerate(labels)), "bucket int, label string")
    c = values.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    d = names.join(c, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("count"))
    most = F.greatest(F.max("count").over(W.partitionBy()), F.lit(1))  # a row for each bucket
    return d.withColumn("width", (F.col("count") * 100 / most).cast("int"))


def score_histogram(avg_scores: DataFrame) -> DataFrame:
    s = F.col("score")
    bucket = F.when(s >= 0.95, 4).when(s >= 0.85, 3).when(s >= 0.75, 2).when(s >= 0.65, 1).otherwise(0)
    return _histogram(avg_scores, bucket, SCORE_LABELS)


def size_histogram(clusters: DataFrame) -> DataFrame:
    return _histogram(clusters, F.when(F.col("size") >= 10, 2).when(F.col("size") >= 5, 1).otherwise(0), SIZE_LABELS)


def average_scores(members: DataFrame, fns: DataFrame) -> DataFrame:
    """(cluster_id, score): the mean of the members' geometric means."""
    return P.member_scores(members, fns, "geo").groupBy("cluster_id").agg(F.avg("score").alias("score"))


def means(clusters: DataFrame, avg_scores: DataFrame) -> DataFrame:
    """One row: total_clusters, functions_in_clusters, mean_coherence, mean_call_coherence, mean_avg_score; zeros without clusters."""
    d = clusters.where("not is_primitive").join(avg_scores, "cluster_id")
    zero = lambda x, n: F.coalesce(x, F.lit(0)).alias(n)
    return d.agg(F.count("*").alias("total_clusters"), zero(F.sum("size"), "functions_in_clusters"), zero(F.avg("coherence"), "mean_coherence"), zero(F.avg("call_coherence"), "mean_call_coherence"), zero(F.avg("score"), "mean_avg_score"))


def ordinals(clusters: DataFrame) -> DataFrame:
    """(cluster_id, tier, ordinal): 1-based rank in the tier by composite score, then size, then id."""
    w = W.partitionBy("tier").orderBy(F.desc(F.round("composite_score", 9)), F.desc("size"), "cluster_id")
    return clusters.select("cluster_id", "tier", F.row_number().over(w).alias("ordinal"))


def member_rows(members: DataFrame, fns: DataFrame) -> DataFrame:
    """(cluster_id, package, name, file_path, start_line, score): members by how close they are to the others."""
    d = P.member_scores(members, fns, "geo").join(fns.select("fn_id", "package", "name", "file_path", "start_line"), "fn_id")
    return d.select("cluster_id", "package", "name", "file_path", "start_line", "score").orderBy("cluster_id", F.desc("score"), "package", "name")


def package_coverage(members: DataFrame, found: DataFrame, fns: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` packages by functions in clusters and near misses, with percentages of the first one's total; ties by name."""
    of = fns.select("fn_id", "package")
    inside = members.join(of, "fn_id").groupBy("package").agg(F.count("*").alias("c"))
    outside = found.select("fn_id").distinct().join(of, "fn_id").groupBy("package").agg(F.count("*").alias("o"))
    d = inside.join(outside, "package", "full").select("package", F.coalesce("c", F.lit(0)).alias("clustered"), F.coalesce("o", F.lit(0)).alias("outliers"))
    d = d.withColumn("total", F.col("clustered") + F.col("outliers")).orderBy(F.desc("total"), "package").limit(top)
    most = F.max("total").over(W.partitionBy())  # at most ``top`` rows
    return d.select("package", "clustered", "outliers", "total", (F.col("clustered") * 100 / most).cast("int").alias("clustered_pct"), (F.col("outliers") * 100 / most).cast("int").alias("outliers_pct"))


def delta_direction(deltas: DataFrame) -> DataFrame:
    """(bucket, label, count, width) of near misses that lack something, add something, or both; those with neither count nowhere."""
    some = lambda x: F.size(F.concat(*[F.col(f"{s}_{x}") for s in ("tokens", "imports", "calls")])) > 0
    d = deltas.select(F.when(some("removed") & some("added"), 2).when(some("removed"), 0).when(some("added"), 1).alias("d")).where("d is not null")
    return _histogram(d, F.col("d"), DIRECTIONS)


def missing_tokens(deltas: DataFrame, top: int = 10) -> DataFrame:
    """(token, count, width): the ``top`` tokens that near misses lack most often; ties by name."""
    c = deltas.select(F.explode("tokens_removed").alias("token")).groupBy("token").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "token").limit(top)
    return c.withColumn("width", (F.col("count") * 100 / F.max("count").over(W.partitionBy())).cast("int"))  # at most ``top`` rows


def explain_scores(histogram: DataFrame) -> DataFrame:
    """(total, verdict, text): what the score histogram's shape says."""
    b = [F.sum(F.when(F.col("bucket") == i, F.col("count")).otherwise(0)).alias(f"b{i}") for i in range(5)]
    d = histogram.agg(*b).withColumns({"total": F.expr("b0 + b1 + b2 + b3 + b4"), "body": F.expr("b0 + b1 + b2")})
    d = d.withColumns({"clone_pct": F.expr("b4 * 100 div greatest(total, 1)"), "body_pct": F.expr("body * 100 div greatest(total, 1)"), "two": F.expr("body > b3 and b4 > b3 and b3 < (body + b4) div 3")})
    verdict = F.when(F.col("total") == 0, "none").when(F.col("two") & (F.col("clone_pct") >= 15), "bimodal").when(F.col("clone_pct") >= 25, "clones").when(F.col("body_pct") >= 80, "conventions")
    verdict = verdict.when(F.expr("b0 >= b1 and b1 >= b2 and b2 >= b3 and b3 >= b4"), "declining").otherwise("spread")
    v = F.col("verdict")
    text = (
        F.when(v == "none", "There are no clusters.")
        .when(v == "bimodal", F.format_string("Two populations: %d%% loose conventions under 0.85, and %d%% near copies from 0.95 on, with a gap between.", "body_pct", "clone_pct"))
        .when(v == "clones", F.format_string("Near copies prevail: %d%% of clusters score 0.95 or more.", "clone_pct"))
        .when(v == "conventions", F.format_string("Conventions with variation prevail: %d%% of clusters score under 0.85.", "body_pct"))
        .when(v == "declining", "Counts fall steadily from the threshold upwards; no group of near copies stands out.")
        .otherwise(F.format_string("The %d clusters are spread over the whole range; no band stands out.", "total"))
    )
    return d.withColumn("verdict", verdict).select("total", "verdict", text.alias("text"))


def explain_sizes(histogram: DataFrame) -> DataFrame:
    """(total, verdict, text): what the size histogram's shape says."""
    d = histogram.agg(*[F.sum(F.when(F.col("bucket") == i, F.col("count")).otherwise(0)).alias(f"b{i}") for i in range(3)])
    d = d.withColumn("total", F.expr("b0 + b1 + b2")).withColumn("large_pct", F.expr("(b1 + b2) * 100 div greatest(total, 1)"))
    verdict = F.when(F.col("total") == 0, "none").when(F.col("b2") >= 5, "idioms").when((F.col("b2") >= 1) & (F.col("b1") >= 3), "healthy").when((F.col("b2") == 0) & (F.col("b1") <= 2), "local").otherwise("mixed")
    v = F.col("verdict")
    text = (
        F.when(v == "none", "There are no clusters.")
        .when(v == "idioms", F.format_string("%d clusters have 10 members or more: idioms of the whole corpus.", "b2"))
        .when(v == "healthy", F.format_string("%d%% of clusters have 5 members or more: conventions recur in many places.", "large_pct"))
        .when(v == "local", F.format_string("Patterns are local: %d clusters have 3 or 4 members, few have more.", "b0"))
        .otherwise(F.format_string("%d%% of clusters have 5 members or more, %d of them 10 or more.", "large_pct", "b2"))
    )
    return d.withColumn("verdict", verdict).select("total", "verdict", text.alias("text"))


def cluster_rows(clusters: DataFrame, members: DataFrame, fns: DataFrame, found: DataFrame) -> DataFrame:
    """The report's table of clusters: rank in tier, badges, bar width, packages, and the near misses that might belong."""
    from .deltas import potentials

    packages = members.join(fns.select("fn_id", "package"), "fn_id").groupBy("cluster_id").agg(F.array_sort(F.collect_set("package")).alias("package_names"))
    d = clusters.where("not is_primitive").join(ordinals(clusters).drop("tier"), "cluster_id").join(average_scores(members, fns).withColumnRenamed("score", "avg_score"), "cluster_id")
    d = d.join(packages, "cluster_id").join(potentials(found, fns), "shape_hash", "left")
    return d.select(
        "tier", "ordinal", F.substring("shape_hash", 1, 6).alias("stable_id"), "shape_hash", S.label_or_hash(F.col("label"), F.col("shape_hash")).alias("label"), "size",
        S.seq_string(F.col("common_seq")).alias("common_shape"), "avg_score", S.score_badge(F.col("avg_score")).alias("score_badge"), "coherence", S.coherence_badge(F.col("coherence")).alias("coherence_badge"),
        "call_coherence", "cyclo_mean", "composite_score", S.confidence_bar(F.col("composite_score")).alias("bar"), S.join_comma(F.col("top_imports")).alias("imports"),
        S.join_comma(F.col("package_names")).alias("packages"), F.coalesce("potentials", F.array().cast("array<string>")).alias("potentials"),
    )


def agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(cluster_id, best, precision, recall, f1): each cluster of ours against the group of another index that it overlaps best.

    Both are (cluster_id, fn_id). A cluster that overlaps nothing has zeros.
    """
    n = ours.groupBy("cluster_id").agg(F.count("*").alias("a"))
    m = theirs.groupBy(F.col("cluster_id").alias("other")).agg(F.count("*").alias("b"))
    both = ours.join(theirs.select(F.col("cluster_id").alias("other"), "fn_id"), "fn_id").groupBy("cluster_id", "other").agg(F.count("*").alias("c"))
    d = both.join(n, "cluster_id").join(m, "other").withColumns({"p": F.expr("c / a"), "r": F.expr("c / b")}).withColumn("f", F.expr("2 * p * r / (p + r)"))
    best = d.groupBy("cluster_id").agg(F.max(F.struct("f", (-F.col("other")).alias("o"), "p", "r")).alias("x"))
    zero = lambda x, name: F.coalesce(x, F.lit(0.0)).alias(name)
    return n.join(best, "cluster_id", "left").select("cluster_id", (-F.col("x.o")).alias("best"), zero(F.col("x.p"), "precision"), zero(F.col("x.r"), "recall"), zero(F.col("x.f"), "f1"))
