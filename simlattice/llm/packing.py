"""Packing documents into windows of equal length by minimum bin slack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import col, cut, shuffle_key, token_count


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, copies) of the multiset that fills the capacity best, with the longest remaining length in it.

    A bitset holds the reachable sums; each length is added in turn, longest first, until the capacity itself is reachable.
    The copies come from walking the stored bitsets backwards.
    """
    lengths = sorted(counts, reverse=True)
    first, mask = lengths[0], (1 << (capacity - lengths[0] + 1)) - 1
    room, sums, steps = capacity - first, 1, []
    for length in lengths:
        have = min(counts[length] - (length == first), room // length)
        if have <= 0:
            continue
        steps.append((length, sums))
        for _ in range(have):
            more = (sums | sums << length) & mask
            if more == sums:
                break
            sums = more
        if sums >> room & 1:
            break
    left, chosen = sums.bit_length() - 1, {first: 1}
    for length, before in reversed(steps):
        while not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + 1
            left -= length
    return sorted(chosen.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, copies, first_window, offset) that give each piece, by length and rank, its window.

    A multiset is used again as long as its lengths last, so there are about as many steps as lengths, whatever the corpus' size.
    """
    left, used, window, rows = dict(counts), dict.fromkeys(counts, 0), 0, []
    while left:
        chosen = fullest(left, capacity)
        times, at = min(left[x] // k for x, k in chosen), 0
        for length, k in chosen:
            rows.append((length, used[length], used[length] + times * k, k, window, at))
            used[length] += times * k
            left[length] -= times * k
            if not left[length]:
                del left[length]
            at += length * k
        window += times
    return rows


def pack(docs: DataFrame, *, capacity: int = 2048, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (window, window_from, doc_id, doc_from, doc_to): which tokens of which document fill each window, from where in it.

    Documents longer than ``capacity`` tokens are cut into full windows and a rest. The multiset of all lengths (at most
    ``capacity`` numbers, whatever the corpus' size) goes to the driver, where minimum bin slack fills one window after the
    other as closely as the lengths left allow; documents of one length are dealt out in a shuffled order.

    Null or blank text: no tokens, so no row. Null doc_id: kept, as null. Repeated rows: each is packed. Ties of the shuffle
    are broken by doc_id and position. Empty table: no row. Other columns of ``docs`` aren't read.
    """
    spark, c = docs.sparkSession, capacity
    d = docs.select(col(doc_id).alias("doc_id"), shuffle_key(doc_id, seed).alias("k"), token_count(text).alias("n")).where("n > 0")
    d = d.withColumn("doc_from", F.explode(F.expr(f"sequence(0L, n - 1, {c}L)"))).withColumn("len", F.least(F.lit(c), F.col("n") - F.col("doc_from")).cast("int"))
    d = cut(d.select("doc_id", "k", "doc_from", "len", F.substring("k", 1, 3).alias("b")))
    per = cut(d.groupBy("len", "b").count())
    counts = {r[0]: r[1] for r in per.groupBy("len").agg(F.sum("count")).collect()}
    base = per.select("len", "b", (F.sum("count").over(W.partitionBy("len").orderBy("b")) - F.col("count")).alias("base"))
    d = d.withColumn("r", F.row_number().over(W.partitionBy("len", "b").orderBy("k", "doc_id", "doc_from"))).join(base, ["len", "b"])
    d = d.withColumn("rank", F.col("base") + F.col("r") - 1)
    rows = spark.createDataFrame(plan(counts, c), "len int, lo long, hi long, copies long, first long, off long")
    d = d.join(rows, "len").where("rank >= lo and rank < hi")
    return d.select(
        F.expr("first + (rank - lo) div copies").alias("window"), F.expr("off + (rank - lo) % copies * len").alias("window_from"),
        "doc_id", "doc_from", (F.col("doc_from") + F.col("len")).alias("doc_to"),
    )
