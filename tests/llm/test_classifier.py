import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from simlattice.llm import classifier as C
from simlattice.llm import textstats


def walk(forest, x):
    """One row, one tree, one step at a time."""
    total = forest.base
    for i in forest.roots:
        while forest.left[i] != i:
            i = forest.left[i] if x[forest.feature[i]] <= forest.threshold[i] else forest.right[i]
        total += forest.value[i]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_is_the_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = C.fit(x, y, trees=20)
    assert np.allclose(f.scores(x[:60]), [walk(f, v) for v in x[:60]])
    assert ((f.scores(x) > 0.5) == y).mean() > 0.97


def plain_fit(x, y, trees, depth, rate=0.2, least=10, l2=1.0):
    """Every split of every node tried by itself, one row after the other; the score of each row."""
    n, m = x.shape
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, C.BINS + 1)[1:-1]))) for j in range(m)]
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    f = [float(np.log(p / (1 - p)))] * n

    def grow(rows, g, h, level):
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        best, found = 1e-6, None
        if level < depth and len(rows) >= 2 * least:
            for j in range(m):
                for e in edges[j]:
                    left = [i for i in rows if x[i, j] <= e]
                    if len(left) < least or len(rows) - len(left) < least:
                        continue
                    gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    if gain > best + 1e-9:
                        best, found = gain, (j, e)
        if found is None:
            for i in rows:
                f[i] -= rate * gs / (hs + l2)
            return
        j, e = found
        grow([i for i in rows if x[i, j] <= e], g, h, level + 1)
        grow([i for i in rows if x[i, j] > e], g, h, level + 1)

    for _ in range(trees):
        q = [1 / (1 + np.exp(-v)) for v in f]
        grow(list(range(n)), [q[i] - y[i] for i in range(n)], [max(v * (1 - v), 1e-9) for v in q], 0)
    return 1 / (1 + np.exp(-np.array(f)))


def test_splits_against_brute_force():
    r = np.random.default_rng(5)
    x = np.column_stack([r.normal(size=150), r.integers(0, 4, 150), r.normal(size=150) ** 3])
    y = ((x[:, 0] + x[:, 1] > 1.5) ^ (x[:, 2] > 1)).astype(float)
    for trees, depth in ((1, 1), (3, 3), (5, 4)):
        assert np.allclose(C.fit(x, y, trees=trees, depth=depth).scores(x), plain_fit(x, y, trees, depth), atol=1e-9)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    forest = C.train(d, labels.where(~held))
    p = C.classify(d, forest).join(labels.where(held), "doc_id").select("keep", "quality", "score").toPandas()
    assert len(p) > 500 and (p["keep"].astype(int) == p["quality"]).mean() > 0.9
    assert (p["keep"] & (p["quality"] == 1)).sum() / (p["quality"] == 1).sum() > 0.97  # clean documents stay


def test_statistics_against_plain_counting():
    texts = ["the cat the cat\nA b", "", "x", "The, the. THE! zz " * 500]
    got = textstats.features(pa.array(texts, pa.large_string()), ["en"] * 4)
    for t, row in zip(texts, got):
        f, w, n = dict(zip(textstats.FEATURES, row)), t.lower().split(), max(len(t.split()), 1)
        assert np.isclose(f["log_words"], np.log1p(len(w))) and np.isclose(f["unique_words"], len(set(w)) / n)
        assert np.isclose(f["top_word"], max([w.count(x) for x in set(w)], default=0) / n)
        assert np.isclose(f["same_as_last"], sum(a == b for a, b in zip(w, w[1:])) / n) and np.isclose(f["lines"], np.log1p(t.count("\n") + 1))


def test_cases(spark, docs, empty, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = C.train(docs, none)
    scored = C.classify(docs, flat)
    assert scored.count() == docs.count() and {r["score"] for r in scored.collect()} == {0.5}
    assert C.classify(empty, flat).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (8, 5, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    f = C.train(clashing, labels)
    assert sorted(map(str, C.classify(clashing, f).collect())) == sorted(map(str, C.classify(docs, f).collect()))
    few = C.train(docs, labels, max_rows=1)
    assert C.classify(docs, few).count() == docs.count()
