from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from simlattice.llm import mixing


def brute(docs, block, seed=17, power=0.8, weights=None):
    import hashlib
    import re

    streams, key = defaultdict(list), lambda i: hashlib.md5(f"{'null' if i is None else i}/{seed}".encode()).hexdigest()
    for r in docs:
        n = len(re.findall("[^ \t\n\r]+", r["text"] or ""))
        if n:
            streams[r["source"] or ""].append((key(r["doc_id"]), (r["doc_id"] is not None, r["doc_id"] or 0), n, r["doc_id"]))
    blocks, tokens = {}, {}
    for s, rows in streams.items():
        at, cut = 0, defaultdict(list)
        for _, _, n, i in sorted(rows):
            for b in range(at // block, (at + n - 1) // block + 1):
                cut[b].append((i, max(b * block - at, 0), min((b + 1) * block - at, n)))
            at += n
        blocks[s], tokens[s] = cut, at
    names = sorted(s for s in blocks if weights is None or weights.get(s, 0) > 0)
    total = sum(tokens[s] for s in names)
    w = [weights[s] if weights else round((tokens[s] / total) ** power, 12) for s in names]
    edges, run = [], 0.0
    for x in w:
        run += x
        edges.append(run / sum(w))
    edges[-1:] = [1.0] if edges else []
    used, out, slot = dict.fromkeys(names, 0), [], 0
    while any(used[s] < len(blocks[s]) for s in names):
        u = ((slot + 1) * mixing.GOLDEN) % 1
        s = names[next(i for i, e in enumerate(edges) if u < e)]
        epoch, b = divmod(used[s], len(blocks[s]))
        out += [(slot, s, epoch, b, *p) for p in blocks[s][b]]
        used[s] += 1
        slot += 1
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [7, 100, 5000])
def test_schedule_is_the_slot_by_slot_one(docs, block):
    assert rows(mixing.mix(docs, block_tokens=block)) == sorted(brute(docs.collect(), block), key=str)


def test_whole_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows(mixing.mix(d, block_tokens=64)) == sorted(brute(d.collect(), 64), key=str)


def test_target_weights_are_met(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 5 == 0, "x").otherwise("y"))
    for kind in ("golden", "van_der_corput"):
        slots = [r[0] for r in mixing.mix(d, weights={"x": 3.0, "y": 1.0}, block_tokens=32, kind=kind).select("slot", "source").distinct().orderBy("slot").select("source").collect()]
        for n in (40, 100, 400):
            assert abs(slots[:n].count("x") / n - 0.75) < 3 / n + 0.01, (kind, n)  # at every prefix, not only in the end


def test_empty_clashing_and_left_out(spark, empty, clashing, docs):
    assert mixing.mix(empty).count() == 0
    assert rows(mixing.mix(clashing, block_tokens=9)) == rows(mixing.mix(docs, block_tokens=9))
    assert {r["source"] for r in mixing.mix(docs, weights={"b": 1.0}).collect()} == {"b"}
    assert mixing.mixed_documents(empty).columns == empty.columns and mixing.mixed_documents(empty).count() == 0
    out = mixing.mixed_documents(spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", f"s{i % 3}", 1) for i in range(60)], empty.schema))
    assert {r["doc_id"] for r in out.collect()} == set(range(60))


def test_sources_beyond_the_cap(spark, docs, sf, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    assert rows(mixing.mix(docs, block_tokens=7)) == sorted(brute(docs.collect(), 7), key=str)
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 60))
    assert rows(mixing.mix(d, block_tokens=64)) == sorted(brute(d.collect(), 64), key=str)
    w = {f"s{i}": 1.0 + i for i in range(5)}
    assert rows(mixing.mix(d, block_tokens=64, weights=w)) == sorted(brute(d.collect(), 64, weights=w), key=str)


def test_every_row_once_per_epoch(spark, empty):
    rough = [(None, f"text number {i} " + "w " * (i % 5), "en", "a", i) for i in range(40)] + [(7, f"other {i % 3}", "en", f"s{i % 2}", i) for i in range(12)]
    out = [r["n_chars"] for r in mixing.mixed_documents(spark.createDataFrame(rough, empty.schema), block_tokens=100_000, weights={"a": 1.0}).collect()]
    assert sorted(out) == list(range(40))
    d = spark.createDataFrame(rough, empty.schema)
    starts = mixing.mix(d).where("doc_from = 0").groupBy("source").count().collect()
    got = mixing.mixed_documents(d).groupBy("source").count().collect()
    assert sorted(got) == sorted(starts) and {r["n_chars"] for r in mixing.mixed_documents(d.where("doc_id = 7")).collect()} == set(range(12))


def test_mixed_documents_of_rough_rows(spark, docs, clashing, empty):
    """Nulls, repeated rows and columns of names that the operator uses: every row with a token once for each epoch, in the slots' order."""
    want = sum(bool((r["text"] or "").strip()) for r in docs.collect())
    for d in (docs, clashing, clashing.withColumnsRenamed({"slot": "__slots", "k": "rid", "b": "ord"})):
        one = mixing.mixed_documents(d.where("source = 'a'"), block_tokens=100_000).collect()
        assert len(one) == sum(r["source"] == "a" and bool((r["text"] or "").strip()) for r in docs.collect())
        out = mixing.mixed_documents(d, block_tokens=9)
        assert out.columns == d.columns and out.count() == mixing.mix(d, block_tokens=9).where("doc_from = 0").count() >= want
    four = spark.createDataFrame([(None, "a b", "en", "s", 1), (None, "c d", "en", "s", 2), (5, "e f", "en", "s", 3), (5, "e f", "en", "s", 3)], empty.schema)
    assert sorted(r["n_chars"] for r in mixing.mixed_documents(four).collect()) == [1, 2, 3, 3]


def test_partitions_follow_the_slots(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    slot = {r["doc_id"]: r["slot"] for r in mixing.mix(d, block_tokens=64).where("epoch = 0 and doc_from = 0").collect()}
    order = [r["doc_id"] for r in mixing.mixed_documents(d, block_tokens=64).collect()]
    seen = list(dict.fromkeys(order))
    assert set(seen) == set(slot) and [slot[i] for i in seen] == sorted(slot.values())


def test_unknown_points():
    with pytest.raises(ValueError):
        mixing.points("random", "slot")
