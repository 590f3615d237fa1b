"""From function rows to scored pairs: an inverted index of window hashes, a self-join, and exact scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..runtime import cut, setting, with_position
from ..schema import Config

DEFAULT = Config()
#: Bytes of functions that one task holds when pairs are compared, about.
HELD_BYTES = 96 << 20
#: Tasks that compare pairs are this number squared, at least.
SIDES = 4


def eligible(fns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Rows that take part: long enough, and neither generated, nor tests, nor trivial constructors."""
    return fns.where((F.size("token_seq") >= cfg.min_token_seq_len) & ~F.col("generated_code") & ~F.col("test_code") & ~F.col("is_constructor"))


def order_key() -> Column:
    """The order of functions: by package/name; ties by path, line and id, so that it is total."""
    return F.struct(F.concat_ws("/", "package", "name").alias("key"), "file_path", "start_line", "fn_id")


def function_order(fns: DataFrame) -> DataFrame:
    """(fn_id, position) of every row in the order of order_key()."""
    return with_position(fns.select("fn_id", order_key().alias("o")), [F.col("o")]).select("fn_id", "position")


def postings(fns: DataFrame) -> DataFrame:
    """(hash, fn_id, mult): the inverted index. A function that has a hash several times is one row with its multiplicity.

    The multiplicity is counted inside the row, so building the index moves nothing.
    """
    h = F.col("token_seq_hash")
    counted = F.transform(F.array_distinct(h), lambda x: F.struct(x.alias("hash"), F.size(F.filter(h, lambda y: y == x)).cast("long").alias("mult")))
    return fns.select("fn_id", F.explode(counted).alias("p")).select("p.hash", "fn_id", "p.mult")


def doc_freq(index: DataFrame) -> DataFrame:
    """(hash, freq): occurrences of each hash, repeats within a function included."""
    return index.groupBy("hash").agg(F.sum("mult").alias("freq"))


def stop_buckets(index: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(hash, freq) of hashes too common to tell anything."""
    return doc_freq(index).where(F.col("freq") > cfg.max_bucket)


def shared_pairs(index: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(i, j, shared) with i < j: pairs with a hash in common, and the products of multiplicities summed over their common hashes.

    The self-join is over buckets of at most ``max_bucket`` occurrences, so no key yields more than max_bucket^2 / 2 pairs; the
    large buckets never reach it.
    """
    kept = index.join(doc_freq(index).where(F.col("freq").between(2, cfg.max_bucket)).select("hash"), "hash")
    a = kept.select("hash", F.col("fn_id").alias("i"), F.col("mult").alias("ma"))
    b = kept.select("hash", F.col("fn_id").alias("j"), F.col("mult").alias("mb"))
    return a.join(b, "hash").where("i < j").groupBy("i", "j").agg(F.sum(F.expr("ma * mb")).alias("shared"))


def self_pairs(index: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(i, shared) of functions whose own hashes repeat: what a bucket with the same function twice amounts to."""
    kept = index.join(doc_freq(index).where(F.col("freq") <= cfg.max_bucket).select("hash"), "hash")
    return kept.where("mult > 1").groupBy(F.col("fn_id").alias("i")).agg(F.sum(F.expr("mult * (mult - 1) div 2")).alias("shared"))


def comparable(fns: DataFrame) -> DataFrame:
    """What scoring needs of a function, and no more: body, parameters and imports stay where they are."""
    return fns.select("fn_id", S.encode(F.col("token_seq")).alias("enc"), F.size("token_seq_hash").alias("n_hashes"), F.col("direct_imports").alias("imps"), F.col("call_targets").alias("calls"))


def _enough(shared: Column, needed: Column, n_i: Column, n_j: Column, cfg: Config) -> Column:
    """Whether a pair shares as many hashes as it must, and its lengths alone don't rule out the sequence threshold."""
    return (shared >= needed) & _comparable_lengths(n_i, n_j, cfg)


def _comparable_lengths(n_i: Column, n_j: Column, cfg: Config) -> Column:
    return F.least(n_i, n_j) >= F.lit(cfg.seq_similarity_threshold) * F.greatest(n_i, n_j) - 1e-9


def _brief(fns: DataFrame) -> DataFrame:
    """(fn_id, n, needed): a function's tokens, and how many hashes it must share if the other one has two or more."""
    return fns.select("fn_id", F.size("token_seq").alias("n"), F.when(F.size("token_seq_hash") >= 2, 2).otherwise(1).alias("needed"))


def candidates(fns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(i, j, shared): those of shared_pairs() that are worth scoring, since they share enough hashes and are of comparable lengths.

    Lengths go with the postings, so that pairs of other lengths are never moved. Multiplicities are counted where a bucket lies.
    """
    index = fns.select("fn_id", F.size("token_seq").alias("n"), F.when(F.size("token_seq_hash") >= 2, 2).otherwise(1).alias("needed"), F.explode("token_seq_hash").alias("hash"))
    freq = index.groupBy("hash").agg(F.count("*").alias("freq")).where(F.col("freq").between(2, cfg.max_bucket)).select("hash")
    kept = index.join(freq, "hash").groupBy("hash", "fn_id").agg(F.count("*").alias("mult"), F.first("n").alias("n"), F.first("needed").alias("needed"))
    a, b = [kept.select("hash", F.col("fn_id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("mult", "n", "needed")]) for k in "ij"]
    p = a.join(b, "hash").where("i < j").where(_comparable_lengths(F.col("n_i"), F.col("n_j"), cfg))
    p = p.groupBy("i", "j").agg(F.sum(F.expr("mult_i * mult_j")).alias("shared"), F.max(F.least("needed_i", "needed_j")).alias("needed"))
    return p.where("shared >= needed").drop("needed")


def scored_pairs(pairs: DataFrame, fns: DataFrame, cfg: Config = DEFAULT, least: float = 0.0) -> DataFrame:
    """(i, j, shared, seq_s, imp_s, call_s, geo): pairs that share enough hashes, whose sequences are alike enough, and of which geo may be ``least``.

    A pair whose lengths alone rule out the sequence threshold is dropped before the functions meet.
    """
    b = _brief(fns)
    for k in "ij":
        pairs = pairs.join(b.select(F.col("fn_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("needed").alias(f"needed_{k}")), k)
    p = pairs.where(_enough(F.col("shared"), F.least("needed_i", "needed_j"), F.col("n_i"), F.col("n_j"), cfg))
    return compared(p.select("i", "j", "shared"), fns, cfg, least)


def compared(pairs: DataFrame, fns: DataFrame, cfg: Config = DEFAULT, least: float = 0.0) -> DataFrame:
    """Pairs (i, j, ...) with seq_s, imp_s, call_s and geo, of which the sequences are alike enough and geo may be ``least`` or more.

    Functions are wide and pairs are many, so functions don't move once for each pair: first ones are dealt to rows and second ones to
    columns of a square of tasks, and a function moves once for each task that has pairs of it. A task holds its second functions,
    about HELD_BYTES of them, and streams the first ones past. The edit distance comes last, for pairs whose sets allow ``least``.
    Sets are compared as 64-bit hashes of their items, of which the sets of two functions don't have equal ones but for equal items.
    """
    hashed = lambda x: F.transform(x, lambda item: F.xxhash64(item)).alias(x)
    pairs, c = cut(pairs), comparable(fns).select("fn_id", "enc", hashed("imps"), hashed("calls"))
    more = [x for x in pairs.columns if x not in ("i", "j")]
    wide = F.length("enc") + 8 * (F.size("imps") + F.size("calls"))
    second = c.join(pairs.select(F.col("j").alias("fn_id")).distinct(), "fn_id", "left_semi")
    sides = max(SIDES, -(-(second.agg(F.sum(wide)).first()[0] or 0) // HELD_BYTES))
    dealt = pairs.withColumn("g", F.pmod(F.xxhash64("i"), F.lit(sides)) * sides + F.pmod(F.xxhash64("j", F.lit(1)), F.lit(sides)))
    first = dealt.groupBy("g", F.col("i").alias("fn_id")).agg(F.collect_list(F.struct("j", *more)).alias("with"))
    tasks = 2 * sides * sides
    a = first.join(c, "fn_id").repartition(tasks, "g").select("g", F.col("fn_id").alias("i"), *[F.col(x).alias(f"{x}_i") for x in ("enc", "imps", "calls")], F.explode("with").alias("p"))
    a = a.select("g", "i", *[f"{x}_i" for x in ("enc", "imps", "calls")], "p.*")
    b = dealt.select("g", F.col("j").alias("fn_id")).distinct().join(c, "fn_id").repartition(tasks, "g").select("g", F.col("fn_id").alias("j"), *[F.col(x).alias(f"{x}_j") for x in ("enc", "imps", "calls")])
    p = a.join(b.hint("shuffle_hash"), ["g", "j"])
    here = F.spark_partition_id().alias("here")  # filters aren't moved below it, so no score is computed twice
    ratio = lambda x, y: F.least(x, y) / F.greatest(x, y, F.lit(1))
    alike = F.when(F.col("enc_i") == F.col("enc_j"), 1.0).otherwise(ratio(F.length("enc_i"), F.length("enc_j")))
    may = lambda imp, call: (F.col("here") >= 0) & (alike * imp * call >= least**3 - 1e-9) if least > 0 else F.lit(True)
    p = p.select("i", "j", *more, "enc_i", "enc_j", "calls_i", "calls_j", S.jaccard(F.col("imps_i"), F.col("imps_j")).alias("imp_s"), here)
    p = p.where(may(F.col("imp_s"), ratio(F.size("calls_i"), F.size("calls_j"))))
    p = p.select("i", "j", *more, "enc_i", "enc_j", "imp_s", S.jaccard(F.col("calls_i"), F.col("calls_j")).alias("call_s"), here).where(may(F.col("imp_s"), F.col("call_s")))
    p = p.select("i", "j", *more, "imp_s", "call_s", S.seq_similarity(F.col("enc_i"), F.col("enc_j")).alias("seq_s"), (F.col("enc_i") == F.col("enc_j")).alias("same"), here)
    p = p.where((F.col("here") >= 0) & ((F.col("seq_s") >= cfg.seq_similarity_threshold) | F.col("same")))
    p = p.select("i", "j", *more, "seq_s", "imp_s", "call_s", S.geo_score(F.col("seq_s"), F.col("imp_s"), F.col("call_s")).alias("geo"))
    with setting(fns.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # both sides lie as their task's number tells
        return cut(p)


def edges(scored: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(i, j, geo) of pairs that may be in one cluster."""
    return scored.where(F.col("geo") >= cfg.identify_threshold).select("i", "j", "geo")


def scored_below(scored: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(fn_id) of functions with a scored pair that fell short: they almost joined something."""
    low = scored.where(F.col("geo") < cfg.identify_threshold)
    return low.select(F.col("i").alias("fn_id")).union(low.select(F.col("j").alias("fn_id"))).distinct()


def self_scored_below(index: DataFrame, fns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """With cfg.compat only: (fn_id) of functions that 'almost joined' themselves, since one of their sets is empty."""
    least = F.when(F.size("token_seq_hash") >= 2, 2).otherwise(1)
    empty = (F.size("direct_imports") == 0) | (F.size("call_targets") == 0)
    return self_pairs(index, cfg).join(fns, F.col("i") == F.col("fn_id")).where((F.col("shared") >= least) & empty).select("fn_id")
