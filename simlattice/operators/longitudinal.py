"""Studies over releases: how long clusters and near misses last, how they end, and how the corpus grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Snapshots are rows (tag, idx, package, func, file, cluster, score): a near miss of a release, with its best candidate.
KEY = ["package", "func"]


def release_order(releases: DataFrame, take: int | None = None) -> DataFrame:
    """(tag, idx) of releases (tag, ts): the ``take`` latest by version, oldest first; by time and tag if no tag has a version."""
    line = S.release_line(F.col("tag"))
    patch = F.coalesce(F.nullif(F.regexp_extract("tag", r"^v?\d+\.\d+\.(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    d = releases.select("tag", F.coalesce("ts", F.lit(0)).alias("ts"), line.alias("v"), patch.alias("p"))
    any_version = d.agg(F.coalesce(F.bool_or(F.col("v.major") >= 0), F.lit(False)).alias("versioned"))
    d = d.crossJoin(any_version).where("not versioned or v.major >= 0")  # one row
    key = F.when(F.col("versioned"), F.struct(F.col("v.major").cast("long").alias("a"), F.col("v.minor").cast("long").alias("b"), F.col("p").cast("long").alias("c"))).otherwise(F.struct(F.col("ts").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")))
    d = d.withColumn("k", key).withColumn("back", F.row_number().over(W.orderBy(F.desc("k"), F.desc("tag"))))  # a row for each release
    d = d.where(F.col("back") <= take) if take else d
    return d.select("tag", (F.row_number().over(W.orderBy("k", "tag")) - 1).alias("idx"))


def consecutive(releases: DataFrame) -> DataFrame:
    """(tag, idx, next_tag) of releases (tag, idx) that have a next one."""
    w = W.orderBy("idx")  # a row for each release
    return releases.select("tag", "idx", F.lead("tag").over(w).alias("next_tag")).where("next_tag is not null")


def outlier_tracking(snapshots: DataFrame) -> DataFrame:
    """(package, func, file, first_seen, last_seen, num_releases, release_list, top_cluster, mean_score) of every near miss ever.

    file is the latest. top_cluster is the most frequent; of several, the one seen first.
    """
    c = snapshots.groupBy(*KEY, "cluster").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    top = c.groupBy(*KEY).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "cluster")).alias("t")).select(*KEY, F.col("t.cluster").alias("top_cluster"))
    d = snapshots.groupBy(*KEY).agg(
        F.max_by("file", "idx").alias("file"), F.min_by("tag", "idx").alias("first_seen"), F.max_by("tag", "idx").alias("last_seen"), F.count("*").alias("num_releases"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "tag"))), lambda x: x["tag"]), ";").alias("release_list"), F.avg("score").alias("mean_score"),
    )
    return d.join(top, KEY)


def cluster_tracking(sizes: DataFrame) -> DataFrame:
    """(shape_hash, first_seen_idx, first_seen_release, num_releases_present, release_indices, sizes) of rows (tag, idx, shape_hash, size)."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "size")))
    d = sizes.groupBy("shape_hash").agg(F.min("idx").alias("first_seen_idx"), F.min_by("tag", "idx").alias("first_seen_release"), F.count("*").alias("num_releases_present"), ordered.alias("o"))
    text = lambda k: F.array_join(F.transform("o", lambda x: x[k].cast("string")), ",")
    return d.select("shape_hash", "first_seen_idx", "first_seen_release", "num_releases_present", text("idx").alias("release_indices"), text("size").alias("sizes"))


def gone(snapshots: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of a release whose key isn't in the next one any more, the last release's left out."""
    last = snapshots.agg(F.max("idx").alias("last"))  # one row
    here = snapshots.crossJoin(F.broadcast(last)).where("idx < last").drop("last")
    after = snapshots.select((F.col("idx") - 1).alias("idx"), *key).distinct()
    return here.join(after, ["idx", *key], "left_anti")


def resolutions(snapshots: DataFrame, releases: DataFrame) -> DataFrame:
    """(package, func, file, outlier_in, resolved_by, resolution, top_cluster, score_at_disappearance) of near misses that ended.

    rejoined_cluster: the next release still has near misses of that cluster, so the cluster is there. fixed_or_refactored: it has
    some of that file. Otherwise deleted_or_moved. The first is an inference that overcounts; verdicts() looks at the code.
    """
    g = gone(snapshots).alias("g")
    clusters = snapshots.where("cluster <> ''").select((F.col("idx") - 1).alias("idx"), "cluster").distinct().withColumn("has_cluster", F.lit(True))
    files = snapshots.where("file <> ''").select((F.col("idx") - 1).alias("idx"), "file").distinct().withColumn("has_file", F.lit(True))
    d = g.join(clusters, ["idx", "cluster"], "left").join(files, ["idx", "file"], "left").join(consecutive(releases).select("idx", "next_tag"), "idx")
    how = F.when(F.col("has_cluster"), "rejoined_cluster").when(F.col("has_file"), "fixed_or_refactored").otherwise("deleted_or_moved")
    return d.select(*KEY, "file", F.col("tag").alias("outlier_in"), F.col("next_tag").alias("resolved_by"), how.alias("resolution"), F.col("cluster").alias("top_cluster"), F.col("score").alias("score_at_disappearance"))


def resolution_counts(resolved: DataFrame) -> DataFrame:
    """One row: total, rejoined, fixed, deleted, rejoined_share, verdict."""
    d = resolved.agg(F.count("*").alias("total"), *[F.count_if(F.col("resolution") == r).alias(n) for n, r in (("rejoined", "rejoined_cluster"), ("fixed", "fixed_or_refactored"), ("deleted", "deleted_or_moved"))])
    d = d.withColumn("rejoined_share", F.col("rejoined") / F.greatest(F.col("total"), F.lit(1)))
    return d.withColumn("verdict", F.when(F.col("rejoined_share") > 0.3, "strong").when(F.col("rejoined_share") > 0.1, "moderate").otherwise("weak"))


def transitions(resolved: DataFrame) -> DataFrame:
    """(transition, deleted_or_moved, fixed_or_refactored, rejoined_cluster): counts by pair of releases."""
    d = resolved.withColumn("transition", F.concat_ws(" → ", "outlier_in", "resolved_by")).groupBy("transition").pivot("resolution", ["deleted_or_moved", "fixed_or_refactored", "rejoined_cluster"]).count()
    return d.na.fill(0)


def threshold_drift(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, n, mean, stdev, cv, drift, max_jump, verdict) of numeric columns over rows with idx; values that aren't numbers are left out."""
    d = rows.select("idx", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.expr(f"try_cast(`{f}` as double)").alias("v")) for f in fields])).alias("x")).select("idx", "x.field", "x.v").where("v is not null")
    d = d.withColumn("jump", F.abs(F.col("v") - F.lag("v").over(W.partitionBy("field").orderBy("idx"))))
    d = d.groupBy("field").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("stdev"), (F.max_by("v", "idx") - F.min_by("v", "idx")).alias("drift"), F.max("jump").alias("max_jump"))
    d = d.withColumn("cv", F.when(F.col("mean") != 0, F.col("stdev") / F.col("mean")).otherwise(0.0))
    return d.withColumn("verdict", F.when(F.col("n") < 2, "insufficient").when(F.col("cv") < 0.03, "stable").when(F.col("cv") < 0.08, "moderate").otherwise("variable"))


def persistence(counts: Column, num_releases: int, *, brief: int, bounds: tuple[float, float]) -> list[Column]:
    """Aggregates over rows with the number of releases each lasted: total, persistent (half of all or more), brief ones, universal,
    the persistent ones' share, and a verdict on it."""
    half = counts >= num_releases / 2
    share = F.avg(half.cast("double"))
    verdict = F.when(share > bounds[0], "high").when(share > bounds[1], "moderate").otherwise("low")
    return [F.count("*").alias("total_unique"), F.count_if(half).alias("persistent"), F.count_if(counts <= brief).alias("brief"), F.count_if(counts == num_releases).alias("universal"), share.alias("persistence_ratio"), verdict.alias("verdict")]


def cluster_persistence(tracking: DataFrame, num_releases: int) -> DataFrame:
    return tracking.agg(*persistence(F.col("num_releases_present"), num_releases, brief=2, bounds=(0.6, 0.3)))


def outlier_persistence(tracking: DataFrame, num_releases: int) -> DataFrame:
    n = F.col("num_releases")
    more = [F.count_if((n >= num_releases / 2) & (F.col("mean_score") > 0.5)).alias("persistent_high_score"), F.avg(n).alias("mean_persistence")]
    return tracking.agg(*persistence(n, num_releases, brief=1, bounds=(0.5, 0.2)), *more)


def growth(releases: DataFrame) -> DataFrame:
    """One row of least-squares slopes over releases (idx, clusters, functions): cluster_slope, function_slope, ratio_slope, verdict."""
    x = F.col("idx").cast("double")
    ratio = F.when(F.col("functions") > 0, F.col("clusters") / F.col("functions")).otherwise(0.0)
    slope = lambda y: F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    d = releases.agg(slope(F.col("clusters").cast("double")).alias("cluster_slope"), slope(F.col("functions").cast("double")).alias("function_slope"), slope(ratio).alias("ratio_slope"))
    return d.withColumn("verdict", F.when(F.abs("ratio_slope") < 0.001, "stable").when(F.col("ratio_slope") > 0, "rising").otherwise("falling"))


def chains(releases: DataFrame) -> DataFrame:
    """(tag, line, chain, pos) of releases (tag, ts): lines of one (major, minor) in time order, joined to the next line only if both
    version and time move on; a parallel or backported line begins a chain of its own."""
    d = releases.select("tag", F.coalesce("ts", F.lit(0)).alias("ts"), S.release_line(F.col("tag")).alias("line"))
    lines = d.groupBy("line").agg(F.min("ts").alias("begin"), F.max("ts").alias("end"))
    w = W.orderBy("begin", "line")  # a row for each line
    follows = (F.col("line") > F.lag("line").over(w)) & (F.col("begin") > F.lag("end").over(w))
    lines = lines.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("chain", F.sum("new").over(w) - 1)
    d = d.join(lines.select("line", "chain", "begin"), "line")
    return d.select("tag", "line", "chain", (F.row_number().over(W.partitionBy("chain").orderBy("begin", "line", "ts", "tag")) - 1).alias("pos"))


def chain_events(snapshots: DataFrame, chained: DataFrame) -> DataFrame:
    """Rows (tag, next_tag, package, func, rel_file, ...) of near misses that the next release of the same chain hasn't."""
    s = snapshots.withColumn("rel_file", S.relative_path(F.col("file"))).join(chained.select("tag", "chain", "pos"), "tag")
    key = [*KEY, "rel_file"]
    following = chained.select("chain", (F.col("pos") - 1).alias("pos"), F.col("tag").alias("next_tag"))
    after = s.select("chain", (F.col("pos") - 1).alias("pos"), *key).distinct()
    return s.join(following, ["chain", "pos"]).join(after, ["chain", "pos", *key], "left_anti")


def commit_counts(commits: DataFrame, keys: list[str], most: int = 30) -> DataFrame:
    """(*keys, commits, fix, refactor, feature) of rows (*keys, n, subject); the first ``most`` by n count."""
    d = commits.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy("n", "subject"))).where(F.col("r") <= most)
    return d.groupBy(*keys).agg(F.count("*").alias("commits"), *[F.count_if(S.commit_is(k, F.col("subject"))).alias(k) for k in ("fix", "refactor", "feature")])


def verdicts(events: DataFrame) -> DataFrame:
    """``events`` with ``verdict``, from columns found (is the function there at the next release?), unchanged, moved, diff_ratio,
    movement (towards the cluster's shape; null if unknown), fix, refactor and feature. Null counts are 0, null flags false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    v = F.when(~flag("found"), "DELETED").when(flag("unchanged"), "ARTEFACT").when(flag("moved") & (F.coalesce("diff_ratio", F.lit(1.0)) < 0.1), "MOVED")
    v = v.when((n("fix") > 0) & (F.coalesce("movement", F.lit(0.0)) > 0.05), "FIXED_TOWARD_CONVENTION").when((n("fix") > 0) & (n("fix") >= F.greatest(n("refactor"), n("feature"))), "LIKELY_FIX")
    v = v.when(n("feature") > F.greatest(n("fix"), n("refactor")), "REQUIREMENT_CHANGE").when(n("refactor") > 0, "REFACTOR").otherwise("AMBIGUOUS")
    return events.withColumn("verdict", v)


def code_facts(events: DataFrame) -> DataFrame:
    """``events`` (func, old_body, new_source, common_shape) with found, unchanged, diff_ratio and movement, for verdicts().

    new_source is the file at the next release, null if it is gone; common_shape is the cluster's, as token names.
    """
    from ..functions import kernels as K

    d = events.withColumn("new_body", K.find_function_udf("new_source", "func"))
    d = d.withColumns({"old_norm": K.normal_form_udf("old_body"), "new_norm": K.normal_form_udf("new_body"), "old_tokens": K.coarse_tokens_udf("old_body"), "new_tokens": K.coarse_tokens_udf("new_body")})
    lcs = F.when(F.coalesce("common_shape", F.lit("")) != "", F.split("common_shape", " "))
    d = d.withColumns({"found": F.col("new_body").isNotNull(), "unchanged": (F.coalesce("old_body", F.lit("")) != "") & (F.col("old_norm") == F.col("new_norm")), "diff_ratio": 1.0 - K.ratio("old_norm", "new_norm"), "lcs": lcs})
    return d.withColumn("movement", K.ratio("new_tokens", "lcs") - K.ratio("old_tokens", "lcs")).drop("old_norm", "new_norm", "old_tokens", "new_tokens", "lcs")


def verdict_counts(verified: DataFrame) -> DataFrame:
    """(verdict, events, class): how often each verdict came up, and whether it is a fix, an artefact or neither."""
    kind = F.when(F.col("verdict").isin("FIXED_TOWARD_CONVENTION", "LIKELY_FIX"), "fix").when(F.col("verdict") == "ARTEFACT", "artefact").otherwise("other")
    return verified.groupBy("verdict").agg(F.count("*").alias("events")).withColumn("class", kind)
