"""Choosing thresholds: sweeps over already scored pairs, bootstrap stability, and the knee of its curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from ..runtime import cut
from ..schema import Config
from . import blocking
from . import cluster as C
from . import profile as P
from .blocking import DEFAULT

THRESHOLDS = tuple(round(0.60 + 0.05 * i, 2) for i in range(7))
SEQ_THRESHOLDS = (0.30, 0.40, 0.50)


def grid(spark: SparkSession) -> DataFrame:
    """All 180 settings of (identify_threshold, seq_similarity_threshold, max_bucket), with the derived seq_fast_reject and a name."""
    one = lambda name, values, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    t = one("identify_threshold", [0.60, 0.65, 0.70, 0.75, 0.80, 0.85], "double")
    d = t.crossJoin(one("seq_similarity_threshold", [0.25, 0.30, 0.35, 0.40, 0.45, 0.50], "double")).crossJoin(one("max_bucket", [100, 200, 300, 400, 500], "int"))
    name = F.format_string("IT=%.2f|SS=%.2f|MB=%d", "identify_threshold", "seq_similarity_threshold", "max_bucket")
    return d.withColumns({"seq_fast_reject": F.col("seq_similarity_threshold") * 0.75, "config": name})


def sweep_edges(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, i, j, geo): the edges at every threshold, from pairs that were scored once."""
    t = F.explode(F.filter(F.array(*[F.lit(x) for x in thresholds]), lambda x: x <= F.col("geo")))
    return scored.where(F.col("geo") >= min(thresholds)).select(t.alias("threshold"), "i", "j", "geo")


def edge_counts(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    return sweep_edges(scored, thresholds).groupBy("threshold").agg(F.count("*").alias("edges"))


def subsamples(fns: DataFrame, rounds: int = 20, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """(boot, fn_id): ``rounds`` samples without replacement, of the share ``fraction`` of the rows, 3 at least.

    The rows with the least hashes of (fn_id, boot, seed) are taken: the same each time, whatever the partitions.
    """
    n = fns.agg(F.count("*").alias("n")).select(F.greatest(F.floor(F.col("n") * fraction), F.lit(3)).alias("k"))
    d = fns.select("fn_id", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("boot")).withColumn("h", F.xxhash64("fn_id", "boot", F.lit(seed)))
    # ranks in two steps: hashes are dealt to 4096 classes in their order; only the class at the bound needs ranks within it
    d = d.withColumn("c", F.shiftright("h", 52))
    per = d.groupBy("boot", "c").agg(F.count("*").alias("m"))
    per = per.withColumn("upto", F.sum("m").over(W.partitionBy("boot").orderBy("c"))).crossJoin(F.broadcast(n))  # n is one row
    d = d.join(F.broadcast(per.select("boot", "c", (F.col("k") - F.col("upto") + F.col("m")).alias("room"), "m")), ["boot", "c"]).where("room > 0")  # 4096 rows a round
    at = d.where("room < m").withColumn("r", F.row_number().over(W.partitionBy("boot", "c").orderBy("h", "fn_id"))).where("r <= room")
    return d.where("room >= m").select("boot", "fn_id").unionByName(at.select("boot", "fn_id"))


def _runs(edges: DataFrame, by: list[str]) -> DataFrame:
    """(*by, component, i, j, geo): components within each run, by way of vertices that the run is part of."""
    rank = cut(edges.select(*by).distinct().withColumn("run", F.dense_rank().over(W.orderBy(*by)).cast("long")))  # a row for each run
    ids = cut(edges.select(F.col("i").alias("v")).union(edges.select("j")).distinct().withColumn("v2", F.monotonically_increasing_id()))
    e = edges.join(F.broadcast(rank), by)
    for k in "ij":
        e = e.join(ids.select(F.col("v").alias(k), F.col("v2").alias(f"{k}2")), k)
    runs = rank.count() + 1
    e = cut(e.withColumns({f"{k}2": F.col(f"{k}2") * runs + F.col("run") for k in "ij"}))
    of = C.components(e.select(F.col("i2").alias("i"), F.col("j2").alias("j")))
    return e.join(of.select(F.col("fn_id").alias("i2"), "component"), "i2").select(*by, "component", "i", "j", "geo")


def runs(fns: DataFrame, edges: DataFrame, n_rows: DataFrame, by: list[str], threshold: float | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(*by, cluster_id, fn_id, member_pos): the clusters of every run in ``edges``, all in one job. Each run's edges are those
    that its threshold allows, so the linkage gate asks only whether an edge is there."""
    from dataclasses import replace

    free = replace(cfg, identify_threshold=1e-12 if threshold is None else threshold)
    grouped = cut(C.groups(_runs(edges, by), fns, free, tuple(by)))
    return C.kept(grouped, fns, n_rows, cfg, tuple(by))


def bootstrap_edges(index: DataFrame, scored: DataFrame, samples: DataFrame, cfg: Config = DEFAULT, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, boot, i, j, geo): the edges that each resample finds.

    scored: (i, j, least, geo) of all pairs that any resample may find. Scores don't depend on the sample; which pairs share enough hashes does, since a smaller corpus has smaller buckets. So the
    buckets and shared counts are made anew for every resample, and the scores joined.
    """
    p = samples.join(index, "fn_id")
    freq = p.groupBy("boot", "hash").agg(F.sum("mult").alias("f")).where(F.col("f").between(2, cfg.max_bucket))
    kept = p.join(freq.select("boot", "hash"), ["boot", "hash"])
    a, b = [kept.select("boot", "hash", F.col("fn_id").alias(k), F.col("mult").alias(f"m{k}")) for k in "ij"]
    shared = a.join(b, ["boot", "hash"]).where("i < j").groupBy("boot", "i", "j").agg(F.sum(F.expr("mi * mj")).alias("n"))
    found = shared.join(scored.select("i", "j", "least", "geo"), ["i", "j"]).where("n >= least")
    t = F.explode(F.filter(F.array(*[F.lit(x) for x in thresholds]), lambda x: x <= F.col("geo")))
    return found.select(t.alias("threshold"), "boot", "i", "j", "geo")


def fingerprints(members: DataFrame, fns: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, cluster_id, key): the set of package/name of each cluster's members."""
    return members.join(fns.select("fn_id", F.concat_ws("/", "package", "name").alias("key")), "fn_id").select(*by, "cluster_id", "key").distinct()


def matches(full: DataFrame, boot: DataFrame) -> DataFrame:
    """(threshold, cluster_id, boot): the full run's clusters of which a resample has one with Jaccard similarity above 1/2."""
    n = full.groupBy("threshold", "cluster_id").agg(F.count("*").alias("a"))
    m = boot.groupBy("threshold", "boot", F.col("cluster_id").alias("other")).agg(F.count("*").alias("b"))
    both = full.join(boot.select("threshold", "boot", F.col("cluster_id").alias("other"), "key"), ["threshold", "key"]).groupBy("threshold", "cluster_id", "boot", "other").agg(F.count("*").alias("c"))
    d = both.join(n, ["threshold", "cluster_id"]).join(m, ["threshold", "boot", "other"])
    return d.where("2 * c > a + b - c").select("threshold", "cluster_id", "boot").distinct()


def stability(clusters: DataFrame, matched: DataFrame, rounds: int = 20, survival: float = 0.7) -> DataFrame:
    """(threshold, bootstrap_stability, stable_clusters, noise_clusters) of clusters (threshold, cluster_id)."""
    hits = matched.groupBy("threshold", "cluster_id").agg(F.count("*").alias("n"))
    d = clusters.join(hits, ["threshold", "cluster_id"], "left").withColumn("stable", F.coalesce("n", F.lit(0)) >= int(rounds * survival))
    return d.groupBy("threshold").agg(F.avg(F.col("stable").cast("double")).alias("bootstrap_stability"), F.count_if("stable").alias("stable_clusters"), F.count_if(~F.col("stable")).alias("noise_clusters"))


def knee(points: DataFrame) -> DataFrame:
    """(knee_threshold, max_drop): where stability, going down from the tightest threshold, drops most; no row if there are fewer
    than 3 points or the drop is under 0.05. Of equal drops the tightest threshold counts."""
    w = W.orderBy(F.desc("threshold"))  # a row for each threshold
    d = points.select("threshold", (F.lag("bootstrap_stability").over(w) - F.col("bootstrap_stability")).alias("drop"))
    d = d.agg(F.count("*").alias("n"), F.max(F.struct("drop", "threshold")).alias("x"))
    return d.where((F.col("n") >= 3) & (F.col("x.drop") >= 0.05)).select(F.col("x.threshold").alias("knee_threshold"), F.col("x.drop").alias("max_drop"))


def eligible_count(fns: DataFrame, least: int = 3) -> DataFrame:
    """(eligible): what coverage divides by; the bound on length is another than clustering's."""
    from dataclasses import replace

    return blocking.eligible(fns, replace(DEFAULT, min_token_seq_len=least)).agg(F.count("*").alias("eligible"))


def tradeoff(members: DataFrame, fns: DataFrame, stable: DataFrame | None = None) -> DataFrame:
    """A row for each threshold of members (threshold, cluster_id, ...): counts, coverage, means, sizes and stability.

    The median of an even number of sizes is the upper one.
    """
    # a cluster of one run is told from the same id in another by a number of its own
    ids = cut(members.select("threshold", "cluster_id").distinct().withColumn("c", F.monotonically_increasing_id()))
    m = cut(members.join(ids, ["threshold", "cluster_id"]).select(F.col("c").alias("cluster_id"), "fn_id", "member_pos"))
    one = m.groupBy("cluster_id").agg(F.count("*").alias("size")).join(P.coherence(m, fns, whole=True), "cluster_id").join(P.cluster_stats(P.member_scores(m, fns)), "cluster_id")
    d = one.join(ids.select("threshold", F.col("c").alias("cluster_id")), "cluster_id").groupBy("threshold").agg(
        F.count("*").alias("num_clusters"), F.sum("size").alias("num_clustered"), F.avg("coherence").alias("mean_coherence"), F.avg("call_coherence").alias("mean_call_coherence"), F.avg("mean_score").alias("mean_pairwise_score"),
        F.avg("size").alias("mean_cluster_size"), F.expr("element_at(array_sort(collect_list(size)), cast(count(*) div 2 + 1 as int))").alias("median_cluster_size"), F.max("size").alias("max_cluster_size"),
    )
    d = d.crossJoin(eligible_count(fns)).withColumn("coverage", F.col("num_clustered") / F.greatest(F.col("eligible"), F.lit(1)))
    return d if stable is None else d.join(stable, "threshold", "left")


def calibrate(fns: DataFrame, cfg: Config = DEFAULT, thresholds: tuple[float, ...] = THRESHOLDS, rounds: int = 20, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """tradeoff() at every threshold, with bootstrap stability. Pairs are scored once for all thresholds and all resamples."""
    from dataclasses import replace

    able = blocking.eligible(fns, cfg)
    # blocking.postings(), without its search of each function's hashes for each of them
    index = cut(able.select("fn_id", F.explode("token_seq_hash").alias("hash")).groupBy("hash", "fn_id").agg(F.count("*").alias("mult")))
    samples = cut(subsamples(fns, rounds, fraction, seed))
    # hashes that are rare enough in the corpus or in any resample; a bucket of theirs isn't much larger than the bound
    rare = samples.join(index, "fn_id").groupBy("boot", "hash").agg(F.sum("mult").alias("f")).where(F.col("f") <= cfg.max_bucket).select("hash")
    rare = rare.union(blocking.doc_freq(index).where(F.col("freq") <= cfg.max_bucket).select("hash")).distinct()
    # no threshold needs the edit distance of a pair whose sets don't allow the least one
    every = blocking.scored_pairs(blocking.shared_pairs(index.join(rare, "hash"), replace(cfg, max_bucket=1 << 30)), able, cfg, min(thresholds))
    exact = blocking.shared_pairs(index, cfg).join(every.drop("shared"), ["i", "j"])
    least = able.select("fn_id", (F.size("token_seq_hash") >= 2).alias("two"))
    need = every.join(least.select(F.col("fn_id").alias("i"), F.col("two").alias("ti")), "i").join(least.select(F.col("fn_id").alias("j"), F.col("two").alias("tj")), "j")
    need = cut(need.select("i", "j", "geo", F.when(F.col("ti") & F.col("tj"), 2).otherwise(1).alias("least")))
    exact = exact.join(need.select("i", "j", "least"), ["i", "j"]).where("shared >= least")
    spark = fns.sparkSession
    t = spark.createDataFrame([(x,) for x in thresholds], "threshold double")
    total = fns.agg(F.count("*").alias("n"))
    full = cut(runs(fns, sweep_edges(exact, thresholds), t.crossJoin(total), ["threshold"], None, cfg))
    size = samples.groupBy("boot").agg(F.count("*").alias("n"))
    boot = cut(runs(fns, bootstrap_edges(index, need, samples, cfg, thresholds), t.crossJoin(size), ["threshold", "boot"], None, cfg))
    matched = matches(fingerprints(full, fns, ("threshold",)), fingerprints(boot, fns, ("threshold", "boot")))
    return tradeoff(full, fns, stability(full.select("threshold", "cluster_id").distinct(), matched, rounds))


def sequence_sweep(fns: DataFrame, cfg: Config = DEFAULT, values: tuple[float, ...] = SEQ_THRESHOLDS, **options) -> DataFrame:
    """calibrate() at the one identify_threshold of ``cfg``, for each of a few sequence thresholds, as ``seq_threshold``."""
    from dataclasses import replace
    from functools import reduce

    runs = [calibrate(fns, replace(cfg, seq_similarity_threshold=v), (cfg.identify_threshold,), **options).withColumn("seq_threshold", F.lit(v)) for v in values]
    return reduce(DataFrame.unionByName, runs)


def csv_rows(points: DataFrame) -> DataFrame:
    """(line): the table of points as CSV lines, tightest threshold first."""
    f = lambda c, n: F.format_string(f"%.{n}f", F.coalesce(F.col(c), F.lit(0)).cast("double"))
    i = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    return points.orderBy(F.desc("threshold")).select(F.concat_ws(",", f("threshold", 2), i("num_clusters"), i("num_clustered"), f("coverage", 3), f("mean_coherence", 3), f("mean_call_coherence", 3), f("mean_pairwise_score", 3), f("bootstrap_stability", 3), i("stable_clusters"), i("noise_clusters"), f("mean_cluster_size", 1), i("median_cluster_size"), i("max_cluster_size")).alias("line"))
