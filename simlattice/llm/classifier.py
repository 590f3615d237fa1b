"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, slices
from .textstats import FEATURES, features

BINS = 64


@dataclass
class Forest:
    """All trees in flat arrays: node i of a tree splits on ``feature[i]`` at ``threshold[i]``; a leaf leads to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities: all rows walk down all trees at once, ``depth`` vectorised steps."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, least: int = 10, l2: float = 1.0) -> Forest:
    """Boosted trees on the logistic loss, split by gradient histograms of at most BINS quantile bins a feature, level by level."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)]) if n else np.zeros((0, m), np.int64)
    p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    f = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(0.0)
        return i

    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        level = [(node(), np.arange(n))]
        roots.append(level[0][0])
        for d in range(depth + 1):
            following = []
            for i, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                best, gain = None, 1e-6
                if d < depth and len(rows) >= 2 * least:
                    b = (binned[rows] + np.arange(m) * BINS).ravel()
                    gh, hh, ch = (np.bincount(b, w, m * BINS).reshape(m, BINS).cumsum(1) for w in (np.repeat(g[rows], m), np.repeat(h[rows], m), np.ones(len(b))))
                    gains = gh**2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
                    gains[(ch < least) | (len(rows) - ch < least)] = -1
                    j, k = np.unravel_index(np.argmax(gains), gains.shape)
                    if gains[j, k] > gain:
                        best = (int(j), int(k))
                if best is None:
                    value[i] = -rate * gs / (hs + l2)
                    f[rows] += value[i]
                    continue
                j, k = best
                feature[i], threshold[i] = j, float(edges[j][k])
                goes = binned[rows, j] <= k
                left[i], right[i] = node(), node()
                following += [(left[i], rows[goes]), (right[i], rows[~goes])]
            level = following
    return Forest(base, *(np.array(a) for a in (roots, feature, threshold, left, right, value)), depth)


def statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, x array<double>, *carry): the statistics named in FEATURES for each row."""
    source = docs.select(col(doc_id).alias("id"), col(text).alias("t"), col(lang).cast("string").alias("l"), *[col(c) for c in carry])
    out = T.StructType([source.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType())), *[source.schema[c] for c in carry]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                x = features(texts, [v or "" for v in part.column(2).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *part.columns[3:]], ["id", "x", *carry])

    return source.mapInArrow(run, out)


def train(docs: DataFrame, labels: DataFrame, *, target: str = "quality", max_rows: int = 8_000, seed: int = 17, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> Forest:
    """Trees fitted on at most ``max_rows`` labelled documents, those with the least hashes of doc_id.

    Labels that are null or not 0 or 1 are ignored; of repeated labels for a document the least counts. No labels: every score is 0.5.
    """
    l = labels.where(col(target).isin(0, 1) & col(doc_id).isNotNull()).groupBy(col(doc_id).alias("__id")).agg(F.min(col(target)).alias("y"))  # noqa: E741
    l = l.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(max_rows)  # noqa: E741
    d = docs.select(col(doc_id).alias("i"), col(text).alias("t"), col(lang).alias("l")).join(l, F.col("i") == F.col("__id")).dropDuplicates(["i"])
    rows = statistics(d.withColumn("y", F.col("y").cast("double")), doc_id="i", text="t", lang="l", carry=("y",)).orderBy("id").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), trees=1, **options)
    return fit(np.vstack(rows["x"].to_numpy()), rows["y"].to_numpy(), **options)


def classify(docs: DataFrame, forest: Forest, *, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, score, keep): the probability of good quality and whether it reaches ``threshold``, for each row.

    Null and empty text: statistics of zeros. Null language: no common words are known. Null doc_id: scored, with a null id. Repeated rows: each is
    scored. Empty table: no row. Other columns of ``docs`` aren't read.
    """
    source = docs.select(col(doc_id).alias("doc_id"), col(text).alias("t"), col(lang).cast("string").alias("l"))
    out = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                s = np.round(forest.scores(features(texts, [v or "" for v in part.column(2).to_pylist()])), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array(s >= threshold)], ["doc_id", "score", "keep"])

    return source.mapInArrow(run, out)
