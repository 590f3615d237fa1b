"""Near misses: functions outside all clusters, scored against every cluster that they might have been in."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import Config
from . import profile as P
from .blocking import DEFAULT, comparable


def _sharing(lone: DataFrame, sigs: DataFrame, column: str, least: float) -> DataFrame:
    """(fn_id, cluster_id) of which some member's set has a Jaccard similarity of ``least`` with the function's.

    Such a member has at least that share of the function's items, so of these the most frequent may be left out: the member has one
    of the rest, which an equi-join finds.
    """
    have = sigs.select("cluster_id", F.explode(column).alias("item")).distinct()
    freq = have.groupBy("item").agg(F.count("*").alias("f"))
    mine = lone.select("fn_id", F.explode(column).alias("item"), F.size(column).alias("n")).join(freq, "item", "left")
    w = W.partitionBy("fn_id").orderBy(F.coalesce("f", F.lit(0)), "item")
    rare = mine.withColumn("r", F.row_number().over(w)).where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & F.col("f").isNotNull())
    return rare.select("fn_id", "item").join(have, "item").select("fn_id", "cluster_id").distinct()


def possible(lone: DataFrame, sigs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(fn_id, cluster_id) that can reach the threshold at all.

    The mean of three similarities is at least T only if that of calls is 3T - 2. Where that is nothing (T up to 2/3), that of imports
    or of calls must be (3T - 1) / 2. Below a third neither need be: then sequences of comparable length are possible, as the medoid's
    must be alike by ``seq_fast_reject``; without that bound, too, all are, by their lengths' classes alone.
    """
    t = cfg.identify_threshold
    if 3 * t - 2 > 1e-9:
        return _sharing(lone, sigs, "calls", 3 * t - 2)
    if 3 * t - 1 > 1e-9:
        return _sharing(lone, sigs, "calls", (3 * t - 1) / 2).union(_sharing(lone, sigs, "imps", (3 * t - 1) / 2)).distinct()
    # sequences are alike by s only if the shorter has s of the longer's length: classes of that ratio, and their neighbours
    ratio = max(cfg.seq_fast_reject, 1e-6)
    size = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / -math.log(min(ratio, 0.99)))
    q = lone.select("fn_id", F.explode(F.array(size("enc") - 1, size("enc"), size("enc") + 1)).alias("c"))
    return q.join(sigs.select("cluster_id", size("enc").alias("c")).distinct(), "c").select("fn_id", "cluster_id").distinct()


def candidates(orphans: DataFrame, clusters: DataFrame, members: DataFrame, fns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(fn_id, rank, cluster_id, shape_hash, arith_score, seq_score, imp_score, call_score, cyclo_delta, idiom) of clusters that a
    function nearly belongs to: its mean scores over all members reach the cluster's admission_bar(). Ranked by score, then hash.

    The medoid's sequence must be alike enough before members are scored; members that are alike in all three respects are scored
    once, with their number as the weight.
    """
    lone = comparable(fns).join(orphans.select("fn_id"), "fn_id").select("fn_id", "enc", "imps", "calls")
    sigs = P.signatures(members, fns)
    medoid = clusters.where("not is_primitive").select("cluster_id", F.col("medoid").alias("m")).join(comparable(fns).select(F.col("fn_id").alias("m"), F.col("enc").alias("enc_m")), "m").drop("m")
    p = possible(lone, sigs, cfg).join(lone, "fn_id").join(medoid, "cluster_id").where(S.seq_similarity(F.col("enc"), F.col("enc_m")) >= cfg.seq_fast_reject).drop("enc_m")
    q = sigs.select("cluster_id", F.col("enc").alias("e"), F.col("imps").alias("i"), F.col("calls").alias("c"), "w")
    p = p.join(q, "cluster_id")
    parts = {"seq_score": S.seq_similarity(F.col("enc"), F.col("e")), "imp_score": S.jaccard(F.col("imps"), F.col("i")), "call_score": S.jaccard(F.col("calls"), F.col("c"))}
    p = p.groupBy("fn_id", "cluster_id").agg(F.sum("w").alias("n"), *[(F.sum(v * F.col("w")) / F.sum("w")).alias(k) for k, v in parts.items()])
    p = p.withColumn("arith_score", S.arith_score(*[F.col(k) for k in parts]))
    p = p.join(clusters.select("cluster_id", "shape_hash", "mean_score", "std_score", "cyclo_mean", "semantic_idiom"), "cluster_id")
    bar = S.admission_bar(cfg.identify_threshold, F.col("n"), F.col("mean_score"), F.col("std_score"), cfg.tolerance_k, cfg.tolerance_shrink_k)
    p = p.where(F.col("arith_score") >= bar).join(fns.select("fn_id", F.col("features.cyclomatic_complexity").alias("cyclo")), "fn_id")
    p = p.withColumn("rank", F.row_number().over(W.partitionBy("fn_id").orderBy(F.desc("arith_score"), "shape_hash")))
    return p.select("fn_id", "rank", "cluster_id", "shape_hash", "arith_score", *parts, (F.col("cyclo") - F.col("cyclo_mean")).alias("cyclo_delta"), F.col("semantic_idiom").alias("idiom"))
