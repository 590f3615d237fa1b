import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlattice.llm import exact_dedup as E


def naive(data):
    h = [0, 0]
    for x in data:
        h = [(h[j] * E.BASES[j] + x) % E.PRIMES[j] for j in range(2)]
    return (len(data), *h)


@pytest.mark.parametrize("n", [0, 1, 5, 4095, 4096, 4097, 12_288, 30_001])
def test_fingerprint_is_the_polynomial(n):
    data = np.random.default_rng(n).integers(0, 256, n, np.uint8)
    assert E.fingerprint(data) == naive(data.tolist())


def test_parts_combine():
    data = np.random.default_rng(7).integers(0, 256, 50_000, np.uint8)
    for k in (0, 1, 4096, 33_333, 50_000):
        assert E.combine(E.fingerprint(data[:k]), E.fingerprint(data[k:])) == E.fingerprint(data)


def test_documents_in_parts(spark):
    whole = {i: "".join(random.Random(i).choice("abcä ") for _ in range(20_000)) for i in range(3)}
    parts = [(i, k, t[k * 7000 : (k + 1) * 7000]) for i, t in whole.items() for k in range(3)]
    random.Random(0).shuffle(parts)
    got = {r["doc_id"]: (r["n"], r["h1"], r["h2"]) for r in E.fold_parts(spark.createDataFrame(parts, "doc_id long, part int, text string")).collect()}
    assert got == {i: E.fingerprint(np.frombuffer(t.encode(), np.uint8)) for i, t in whole.items()}


def brute(rows):
    first, out = {}, []
    for i, t in sorted(((r["doc_id"], r["text"]) for r in rows if r["text"]), key=lambda x: (x[0] is None, x[0] or 0)):
        if t in first:
            out.append((i, first[t]))
        else:
            first[t] = i
    return sorted(out, key=str)


@pytest.mark.parametrize("salted", [1, 2, 2000])
def test_duplicates(spark, docs, sf, salted):
    for d in (docs, spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame([(i, f"t{i % 3}") for i in range(200)] + [(None, "t0"), (None, "t9"), (None, "t9")], "doc_id long, text string")):
        assert sorted(map(tuple, E.duplicates(d, salted=salted).collect()), key=str) == brute(d.collect())


def test_documents_in_parts_against_brute_force(spark):
    r, whole = random.Random(4), {}
    for i in range(30):
        whole[i] = "".join(r.choice("abcä€ ") for _ in range(r.randrange(1, 9000))) if i % 3 or i < 3 else whole[r.randrange(i)]
    whole |= {90: "", 91: "", 92: "x", 93: "x"}
    parts = []
    for i, t in whole.items():
        cuts = sorted(r.sample(range(1, len(t)), min(len(t) - 1, r.randrange(4)))) if len(t) > 1 else []
        parts += [(i, k, t[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(t)]))]
    parts += [(5, -1, None), (None, 0, "x")]
    r.shuffle(parts)
    d = spark.createDataFrame(parts, "doc_id long, part int, text string").withColumns({c: F.lit(1) for c in ("n", "c", "lo", "bytes", "kind", "size")})
    for chunk in (7, 1000, 1 << 20):
        assert sorted(map(tuple, E.part_duplicates(d, chunk=chunk).collect()), key=str) == brute([{"doc_id": i, "text": t} for i, t in whole.items()])
    assert E.part_duplicates(d.where("false")).count() == 0


def test_parts_of_equal_fingerprint_are_compared(spark, monkeypatch):
    """With a fingerprint that takes all texts of a length for the same."""
    fold = E.fold_parts
    monkeypatch.setattr(E, "fold_parts", lambda p: fold(p).withColumns({"h1": F.lit(1), "h2": F.lit(1)}))
    d = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (2, 0, "a"), (2, 1, "bcd"), (3, 0, "abcx"), (4, 0, "abcx"), (5, 0, "xbcd")], "doc_id long, part int, text string")
    assert sorted(map(tuple, E.part_duplicates(d, chunk=3).collect())) == [(2, 1), (4, 3)]


def test_filter_lets_more_through(spark, docs, monkeypatch):
    """A filter of 64 bits admits nearly all texts; the comparison decides."""
    from simlattice.llm import common

    want = sorted(map(str, E.duplicates(docs).collect())), sorted(map(str, E.keep_first(docs).collect()))
    monkeypatch.setattr(common, "FILTER_BITS", 6)
    assert (sorted(map(str, E.duplicates(docs).collect())), sorted(map(str, E.keep_first(docs).collect()))) == want


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    """Texts that the fingerprint takes for the same are told apart by their bytes."""
    d = spark.createDataFrame([(1, "k", "aa"), (2, "k", "bb"), (3, "k", "aa"), (4, "k", "bb")], "id long, key string, text string")
    got = sorted((r["id"], r["lead"], r["lead_id"]) for r in E._leaders(d, ["key"], "id", "text").collect())
    assert got == [(1, True, 1), (2, True, 2), (3, False, 1), (4, False, 2)]
    assert E.same(memoryview(b"x" * 200_000), memoryview(b"x" * 200_000)) and not E.same(memoryview(b"x" * 199_999 + b"y"), memoryview(b"x" * 200_000))


def test_keep_first(docs, empty, clashing):
    kept = E.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - len(brute(docs.collect()))
    assert E.keep_first(empty).count() == 0 and E.duplicates(empty).count() == 0
    c = E.keep_first(clashing)
    assert c.columns == clashing.columns and c.count() == kept.count()
    assert sorted(map(str, E.duplicates(clashing).collect())) == sorted(map(str, E.duplicates(docs).collect()))
