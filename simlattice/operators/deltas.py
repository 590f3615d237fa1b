"""What sets near misses apart: tokens, imports and calls that they add to or lack against their closest cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

SIDES = ("tokens", "imports", "calls")


def deltas(found: DataFrame, clusters: DataFrame, fns: DataFrame, how: str = "left") -> DataFrame:
    """A row for each near miss and its best candidate, with <side>_added and <side>_removed for tokens, imports and calls.

    Imports are compared by their last segments with the cluster's top imports, calls with its top calls, tokens with its common
    subsequence. With ``how`` 'left' a candidate whose cluster isn't there (any more) keeps its row, with nothing added or removed.
    """
    top = found.where("rank = 1")
    c = clusters.where("not is_primitive").select("shape_hash", "common_seq", "top_imports", "top_call_targets", "tier", "label", F.col("semantic_idiom").alias("cluster_idiom"), "size", F.lit(True).alias("there"))
    d = top.join(c, "shape_hash", how).join(fns.select("fn_id", "name", "package", "file_path", "start_line", "token_seq", "direct_imports", "call_targets", "body"), "fn_id")
    short = lambda x: F.transform(x, S.short_import)
    none = F.array().cast("array<string>")
    both = {
        "tokens": (S.token_diff, F.col("token_seq"), F.col("common_seq")),
        "imports": (S.list_diff, short(F.col("direct_imports")), short(F.col("top_imports"))),
        "calls": (S.list_diff, F.col("call_targets"), F.col("top_call_targets")),
    }
    out = {}
    for side, (diff, mine, theirs) in both.items():
        out[f"{side}_added"] = F.when(F.col("there"), diff(mine, theirs)).otherwise(none)
        out[f"{side}_removed"] = F.when(F.col("there"), diff(theirs, mine)).otherwise(none)
    return d.withColumns(out).drop("there")


def outliers(found: DataFrame, clusters: DataFrame, fns: DataFrame) -> DataFrame:
    """The answer to 'which functions stand out': each near miss with its deltas and all its candidates, as nested rows."""
    c = clusters.select("shape_hash", "tier", "size", S.seq_string(F.col("common_seq")).alias("common_shape"))
    entry = F.struct("rank", F.col("shape_hash").alias("cluster_id"), F.col("arith_score").alias("score"), "idiom", F.coalesce("tier", F.lit("")).alias("tier"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("common_shape", F.lit("")).alias("common_shape"))
    every = found.join(c, "shape_hash", "left").groupBy("fn_id").agg(F.array_sort(F.collect_list(entry)).alias("candidates"))
    d = deltas(found, clusters, fns).join(every, "fn_id")
    side = lambda x: F.struct(F.col(f"{x}_added").alias("added"), F.col(f"{x}_removed").alias("removed")).alias(f"{x.removesuffix('s')}_delta")
    return d.select("fn_id", F.col("name").alias("func"), "package", F.col("file_path").alias("file"), F.col("start_line").alias("line"), "body", *[side(x) for x in SIDES], "cyclo_delta", "candidates")


def outlier_groups(found: DataFrame, clusters: DataFrame, fns: DataFrame) -> DataFrame:
    """Near misses under their closest clusters, a row for each with at least one, by tier and id."""
    d = deltas(found, clusters, fns, "inner")
    row = F.struct("package", "name", "file_path", F.col("start_line").alias("line"), "cyclo_delta", S.seq_string(F.col("token_seq")).alias("token_shape"), *[F.col(f"{s}_{x}") for s in SIDES for x in ("added", "removed")])
    label = F.coalesce(F.nullif("cluster_idiom", F.lit("")), F.col("label"))
    g = d.groupBy("shape_hash").agg(F.first(label).alias("label"), F.first(S.seq_string(F.col("common_seq"))).alias("common_shape"), F.first(F.coalesce(F.nullif("tier", F.lit("")), F.lit("low"))).alias("tier"), F.array_sort(F.collect_list(row)).alias("outliers"))
    order = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    return g.select(F.substring("shape_hash", 1, 6).alias("cluster_id"), F.col("shape_hash").alias("cluster_hash"), F.col("label").alias("cluster_label"), "common_shape", "tier", "outliers").orderBy(order, "cluster_id", "cluster_hash")


def potentials(found: DataFrame, fns: DataFrame) -> DataFrame:
    """(shape_hash, potentials): for each cluster all functions, at any rank, that nearly belong to it."""
    d = found.join(fns.select("fn_id", "name", "file_path", "start_line"), "fn_id")
    entry = F.concat_ws("#", "name", S.short_path(F.col("file_path")), F.col("start_line").cast("string"))
    return d.groupBy("shape_hash").agg(F.array_sort(F.collect_list(entry)).alias("potentials"))


def member_details(members: DataFrame, fns: DataFrame) -> DataFrame:
    """(cluster_id, member_pos, func, package, file, line, tokens, imports, calls, body) of each member; the sets sorted."""
    d = members.join(fns, "fn_id")
    return d.select(
        "cluster_id", "member_pos", "fn_id", F.col("name").alias("func"), "package", F.col("file_path").alias("file"), F.col("start_line").alias("line"),
        S.seq_string(F.col("token_seq")).alias("tokens"), F.array_sort("direct_imports").alias("imports"), F.array_sort("call_targets").alias("calls"), "body",
    )


def cluster_shape(shape: str, clusters: DataFrame, members: DataFrame, fns: DataFrame) -> DataFrame:
    """The cluster of exactly this shape hash with its members as nested rows; no row if there is none."""
    hit = clusters.where(F.col("shape_hash") == shape)
    m = member_details(members.join(hit.select("cluster_id"), "cluster_id"), fns)
    m = m.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("member_pos", "func", "package", "file", "line", "tokens", "imports", "calls", "body"))).alias("members"))
    keep = ["shape_hash", "tier", "size", "mean_score", "std_score", "coherence", "call_coherence", "composite_score"]
    return hit.join(m, "cluster_id").select(*keep, S.seq_string(F.col("common_seq")).alias("common_shape"), "members")


def export(found: DataFrame, clusters: DataFrame, members: DataFrame, fns: DataFrame, *, repo: str = "", commit: str = "", min_score: float = 0.0) -> DataFrame:
    """One row: repo, commit, corpus_size, unclustered_count, clusters of at least ``min_score`` and all near misses, nested.

    The corpus size counts clusters that the score leaves out, too. The lists make this a document for one reader, as an export is.
    """
    chosen = clusters.where((F.col("mean_score") >= min_score) & ~F.col("is_primitive"))
    m = member_details(members.join(chosen.select("cluster_id"), "cluster_id"), fns).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("member_pos", "func", "package", "file", "line", "tokens", "imports", "calls", "body"))).alias("members"))
    keep = ["shape_hash", "tier", "size", "mean_score", "std_score", "coherence", "call_coherence", "composite_score"]
    c = chosen.join(m, "cluster_id").select(F.struct(F.col("size").alias("by_size"), *keep, S.seq_string(F.col("common_seq")).alias("common_shape"), "members").alias("c"))
    c = c.agg(F.sort_array(F.collect_list("c"), asc=False).alias("clusters"))
    entry = F.struct("rank", F.col("shape_hash").alias("cluster_hash"), "arith_score", "seq_score", "imp_score", "call_score", "cyclo_delta", "idiom")
    o = found.groupBy("fn_id").agg(F.array_sort(F.collect_list(entry)).alias("candidates")).join(fns, "fn_id")
    o = o.select(F.struct("package", F.col("name").alias("func"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), S.seq_string(F.col("token_seq")).alias("tokens"), F.array_sort("direct_imports").alias("imports"), F.array_sort("call_targets").alias("calls"), "body", "candidates").alias("o"))
    o = o.agg(F.array_sort(F.collect_list("o")).alias("orphans"))
    n = corpus_size(clusters, found).select("corpus_size", "unclustered_count")
    return c.crossJoin(o).crossJoin(n).select(F.lit(repo).alias("repo"), F.lit(commit).alias("commit"), "corpus_size", "unclustered_count", "clusters", "orphans")


def corpus_size(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """(corpus_size, unclustered_count): members of all clusters plus near misses, and the near misses."""
    n = clusters.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"))
    return n.crossJoin(found.agg(F.count_distinct("fn_id").alias("u"))).select((F.col("n") + F.col("u")).alias("corpus_size"), F.col("u").alias("unclustered_count"))
