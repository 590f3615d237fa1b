"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import col, cut, shuffle_key, small, token_count

GOLDEN = 0.6180339887498949
#: Up to so many sources are listed on the driver; of more, the edges stay a table, and slots find their source by a join.
MAX_SOURCES = 10_000
CHUNK = 65_536


def points(kind: str, slot):
    """The slot's point in [0, 1): multiples of the golden ratio, or base-2 radical inverses (van der Corput)."""
    if kind == "golden":
        return F.expr(f"(({slot} + 1) * {GOLDEN}D) % 1D")
    if kind == "van_der_corput":
        return F.expr(f"conv(reverse(lpad(bin({slot} + 1), 48, '0')), 2, 10)").cast("double") / F.lit(float(1 << 48))
    raise ValueError(f"unknown points {kind!r}")


def row_identity(doc_id: str, text: str, source: str) -> Column:
    """128 bits that rows share only if they have the same doc_id, source and text."""
    parts = [x for c in (doc_id, text, source) for x in (col(c).isNull(), col(c).cast("string"))]  # a null alone wouldn't change a hash
    return F.struct(*[F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (1, 2)])


def pieces(docs: DataFrame, *, block_tokens: int, seed: int, doc_id: str, text: str, source: str, identity: bool = False) -> DataFrame:
    """(source, block, doc_id, doc_from, doc_to): each source's shuffled token stream, cut into equal blocks.

    With ``identity`` also (rid, ord): row_identity() and the row's number among rows that share it.

    The running token count is taken in two steps, over hash buckets and then within each, so that a hot source isn't one task.
    """
    d = docs.select(F.coalesce(col(source), F.lit("")).alias("source"), col(doc_id).alias("doc_id"), shuffle_key(doc_id, seed).alias("k"), token_count(text).alias("n"), *([row_identity(doc_id, text, source).alias("rid")] if identity else []))
    own = ["rid", "ord"] if identity else []
    d = cut(d.where("n > 0").withColumn("b", F.substring("k", 1, 3)))  # kept: texts are read and their tokens counted once
    before = d.groupBy("source", "b").agg(F.sum("n").alias("s"))
    before = before.select("source", "b", (F.sum("s").over(W.partitionBy("source").orderBy("b")) - F.col("s")).alias("base"))
    d = d.withColumn("upto", F.sum("n").over(W.partitionBy("source", "b").orderBy("k", "doc_id", "n", *own[:1]).rowsBetween(W.unboundedPreceding, 0)))
    if identity:
        d = d.withColumn("ord", F.row_number().over(W.partitionBy("source", "b", "rid").orderBy("upto")))
    d = d.join(before, ["source", "b"]).select("source", "doc_id", "n", *own, (F.col("base") + F.col("upto") - F.col("n")).alias("at"))
    d = d.withColumn("block", F.explode(F.expr(f"sequence(at div {block_tokens}, (at + n - 1) div {block_tokens})")))
    return d.select(
        "source", "block", "doc_id",
        F.greatest(F.col("block") * block_tokens - F.col("at"), F.lit(0)).alias("doc_from"),
        F.least((F.col("block") + 1) * block_tokens - F.col("at"), F.col("n")).alias("doc_to"), *own,
    )


def schedule(blocks: list[tuple[str, int, int]], spark, *, weights: dict[str, float] | None, power: float, kind: str) -> DataFrame:
    """(slot, source, epoch, block) for sources given as (name, tokens, blocks), up to the slot by which every block has been placed.

    weights: shares of the mixture by source; sources without one are left out. By default tokens to ``power``, which favours small sources.
    """
    have = [(s, t, n) for s, t, n in blocks if n > 0 and (weights is None or weights.get(s, 0) > 0)]
    if not have:
        return spark.createDataFrame([], "slot long, source string, epoch long, block long")
    total = sum(t for _, t, _ in have)
    raw = [weights[s] if weights is not None else round((t / total) ** power, 12) for s, t, _ in have]
    whole, run, upper, most = sum(raw), 0.0, [], 0
    for (s, _, n), r in zip(have, raw, strict=True):
        run += r
        w = r / whole
        upper.append(run / whole)
        # a golden-ratio or dyadic sequence visits an interval as often as its length demands, but for a logarithm
        most = max(most, (n + 2 * int(2 + n / w).bit_length() + 3) / w)
    upper[-1] = 1.0
    table = spark.createDataFrame([(i, s, n) for i, (s, _, n) in enumerate(have)], "i int, source string, n long")
    edges = F.array(*[F.lit(float(x)) for x in upper])
    slots = spark.range(0, int(most) + 1).withColumnRenamed("id", "slot").withColumn("u", points(kind, "slot"))
    slots = slots.select("slot", F.size(F.filter(edges, lambda e: e <= F.col("u"))).alias("i"), F.expr(f"slot div {CHUNK}").alias("c"))
    return _ranked(slots, table)


def schedule_of_many(sizes: DataFrame, *, weights: dict[str, float] | None, power: float, kind: str) -> DataFrame:
    """schedule() for sizes (source, t, n) of any number of sources: the cumulative weights are a table too."""
    spark = sizes.sparkSession
    if weights is None:
        d = sizes.crossJoin(sizes.agg(F.sum("t").alias("total"))).withColumn("r", F.round(F.pow(F.col("t") / F.col("total"), F.lit(power)), 12))
    else:
        d = sizes.join(spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, r double").where("r > 0"), "source")
    # running sums in two steps; a range partition begins at exactly the sum at which the one before it ends
    d = cut(d.select("source", "n", "r").repartitionByRange("source").withColumn("p", F.spark_partition_id()))
    d = d.withColumn("run", F.sum("r").over(W.partitionBy("p").orderBy("source").rowsBetween(W.unboundedPreceding, 0)))
    per = d.groupBy("p").agg(F.max("run").alias("s"), F.max("source").alias("last"))
    ends = per.select("p", F.sum("s").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, 0)).alias("upto"), "last")
    base = ends.select("p", F.coalesce(F.lag("upto").over(W.orderBy("p")), F.lit(0.0)).alias("base"))
    whole, last, many = ends.agg(F.max("upto"), F.max("last")).first() + (d.count(),)
    if not many:
        return spark.createDataFrame([], "slot long, source string, epoch long, block long")
    d = d.join(base, "p").withColumn("hi", F.when(F.col("source") == last, 1.0).otherwise((F.col("base") + F.col("run")) / whole))
    before = F.lag("run").over(W.partitionBy("p").orderBy("source"))
    d = cut(d.withColumn("lo", (F.col("base") + F.coalesce(before, F.lit(0.0))) / whole).withColumn("w", F.col("r") / whole).select("source", "n", "lo", "hi", "w"))
    most = d.agg(F.max(F.expr("(n + 2 * length(bin(cast(2 + n / w as bigint))) + 3) / w"))).first()[0]
    cells = min(many, 1 << 20)
    spans = d.withColumn("cell", F.explode(F.expr(f"sequence(cast(lo * {cells} as bigint), least(cast(hi * {cells} as bigint), {cells - 1}L))"))).select("cell", "lo", "hi", F.col("source").alias("i"))
    slots = spark.range(0, int(most) + 1).withColumnRenamed("id", "slot").withColumn("u", points(kind, "slot")).withColumn("cell", F.expr(f"cast(u * {cells} as bigint)"))
    slots = slots.join(spans, "cell").where("u >= lo and u < hi").select("slot", "i", F.expr(f"slot div {CHUNK}").alias("c"))
    return _ranked(slots, d.select(F.col("source").alias("i"), "source", "n"))


def _ranked(slots: DataFrame, table: DataFrame) -> DataFrame:
    """(slot, source, epoch, block): slots (slot, i, c) of source i, ranked, up to the one by which every block of the table (i, source, n) has been placed."""
    base = slots.groupBy("c", "i").count()
    base = base.select("c", "i", (F.sum("count").over(W.partitionBy("i").orderBy("c")) - F.col("count")).alias("base"))
    slots = slots.withColumn("r", F.row_number().over(W.partitionBy("c", "i").orderBy("slot"))).join(base, ["c", "i"])
    slots = slots.select("slot", "i", (F.col("base") + F.col("r") - 1).alias("r")).join(table, "i")
    last = slots.where("r = n - 1").agg(F.max("slot").alias("last"))
    return slots.crossJoin(last).where("slot <= last").select("slot", "source", F.expr("r div n").alias("epoch"), F.expr("r % n").alias("block"))


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, power: float = 0.8, block_tokens: int = 2048, seed: int = 17, kind: str = "golden", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture as rows (slot, source, epoch, block, doc_id, doc_from, doc_to), the last two in tokens of the document.

    Each source's documents are shuffled and cut into blocks of ``block_tokens`` tokens (the last may be shorter). Slot after
    slot, a low-discrepancy point picks the source through the cumulative weights, and the source's next block takes the slot.
    A source that runs out begins again (``epoch``); the schedule ends when each block of every source has been placed.

    Null source: a source of its own, named ''. Null or blank text: no tokens, so no row. Null doc_id: kept, as null. Rows that
    repeat are placed as often as they occur; equal shuffle keys are ordered by doc_id and length. Empty table: no row. Other
    columns of ``docs`` aren't read. Only names and sizes of sources reach the driver, MAX_SOURCES at most; more are joined as a table.
    """
    p, s = _mixture(docs, weights=weights, power=power, block_tokens=block_tokens, seed=seed, kind=kind, doc_id=doc_id, text=text, source=source)
    return s.join(p, ["source", "block"]).select("slot", "source", "epoch", "block", "doc_id", "doc_from", "doc_to")


def _mixture(docs: DataFrame, *, weights: dict[str, float] | None = None, power: float = 0.8, block_tokens: int = 2048, seed: int = 17, kind: str = "golden", doc_id: str = "doc_id", text: str = "text", source: str = "source", identity: bool = False) -> tuple[DataFrame, DataFrame]:
    """The pieces() and their schedule()."""
    p = cut(pieces(docs, block_tokens=block_tokens, seed=seed, doc_id=doc_id, text=text, source=source, identity=identity))
    sizes = p.groupBy("source").agg(F.sum(F.expr("doc_to - doc_from")).alias("t"), (F.max("block") + 1).alias("n"))
    found = sizes.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        s = schedule_of_many(cut(sizes), weights=weights, power=power, kind=kind)
    else:
        s = schedule([tuple(r) for r in found], docs.sparkSession, weights=weights, power=power, kind=kind)
    return p, s


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents in the mixture's order, with the columns of ``docs``: each where its first token falls, once for each epoch.

    Rows of null or blank text have no place in a token stream and go. Every other row comes out once for each epoch, also if
    rows share a null or repeated doc_id: the identity of a row is doc_id, source and text, and a number among rows alike in these.
    Partitions of the result are equal runs of slots, so they hold about as many tokens each.
    """
    names = [options.get(x, x) for x in ("doc_id", "text", "source")]
    p, s = _mixture(docs, **options, identity=True)
    placed = cut(s.join(p.where("doc_from = 0"), ["source", "block"]).select(F.col("slot").alias("__slot"), F.col("doc_id").alias("__placed"), F.col("rid").alias("__rid"), F.col("ord").alias("__ord")))
    d, repeated = docs.withColumn("__rid", row_identity(*names)), cut(p.where("ord > 1").select(F.col("rid").alias("__rid")).distinct())
    if repeated.isEmpty():
        d = d.withColumn("__ord", F.lit(1))
    else:  # only rows that repeat are numbered, so the other texts move once
        many = d.join(small(repeated), "__rid", "left_semi").withColumn("__ord", F.row_number().over(W.partitionBy("__rid").orderBy("__rid")))
        d = d.join(small(repeated), "__rid", "left_anti").withColumn("__ord", F.lit(1)).unionByName(many)
    n, slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (placed.agg(F.max("__slot")).first()[0] or 0) + 1
    joined = d.join(small(placed), ["__rid", "__ord"]).withColumn("__part", F.expr(f"cast(__slot * {n} div {slots} as int)"))
    return joined.repartitionById(n, F.col("__part")).sortWithinPartitions("__slot", "__placed").select(*[col(c) for c in docs.columns])
