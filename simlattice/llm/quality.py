"""Quality rules by distribution divergence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, cut, slices
from .textstats import CLASSES, COMMON, class_counts, word_counts, words

#: So many languages' references may go to the executors with the code; more are joined.
MAX_REFERENCES = 5_000


def learned_words(docs: DataFrame, *, text: str = "text", lang: str = "lang", share: float = 0.005) -> DataFrame:
    """(lang, common): the common words, as hashes, of every named language that COMMON doesn't have: those that are ``share`` of
    its words or more, 30 at most, by number, then hash. From all of its documents.

    A first pass sends, of each slice of texts, only words that are half of ``share`` in it. What they add up to falls short of the
    truth by less than half of ``share``, so any that reach half are candidates: a bounded number, none missing. A second pass counts them.
    """
    d = docs.select(col(text).alias("t"), col(lang).cast("string").alias("l")).where(~F.col("l").isin("", *COMMON))
    out = "lang string, key long, n long"

    def sums(kept):
        """Rows (language, word, number) of each slice, of those words that ``kept`` picks; the key null for all words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in slices(batch, 0):
                    of, (h, row, _) = np.array(part.column(1).to_pylist(), object), words(texts)
                    for x in {*of}:
                        u, n = np.unique(h[(of == x)[row]], return_counts=True)
                        pick = kept(x, u, n)
                        keys = pa.array([None, *u[pick].view(np.int64)], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([x] * len(keys), pa.string()), keys, pa.array([n.sum(), *n[pick]], pa.int64())], ["lang", "key", "n"])

        return run

    first = cut(d.mapInArrow(sums(lambda x, u, n: n >= share / 2 * n.sum()), out).groupBy("lang", "key").agg(F.sum("n").alias("n")))
    some = first.where("key is not null").join(first.where("key is null").select("lang", F.col("n").alias("total")), "lang").where(F.col("n") >= share / 2 * F.col("total"))
    many = some.groupBy("key").agg(F.lit(1).alias("one"))  # a superset for every language; what another language's word counts is its own
    wanted = np.sort(many.select("key").toArrow().column(0).to_numpy().view(np.uint64)) if _few(some) else None
    counted = d.mapInArrow(sums(lambda x, u, n: np.ones(len(u), bool) if wanted is None else np.isin(u, wanted)), out).groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counted = cut(counted.join(some.select("lang", "key", "total"), ["lang", "key"]).where(F.col("n") >= share * F.col("total")))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "key"))).where("r <= 30")
    return cut(ranked.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda v: v["key"]).alias("common")))


def _few(rows: DataFrame, most: int = 1_000_000) -> bool:
    """Whether so few words are candidates that they may go with the code; else the second pass sends all words."""
    return rows.limit(most + 1).count() <= most


def references(docs: DataFrame, learned: dict[str, list[int]] | None = None, *, text: str = "text", lang: str = "lang", common: str | None = None) -> DataFrame:
    """(lang, chars, words): the summed histograms of each language's documents, over the whole corpus.

    learned: common words of other languages; or ``common``, a column of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in slices(batch, 0):
                langs = [x or "" for x in part.column(1).to_pylist()]
                lists = learned if common is None else dict(zip(langs, part.column(2).to_pylist(), strict=True))
                both = np.hstack([class_counts(texts), word_counts(words(texts), langs, lists)])
                of = np.array(langs, object)
                for x in {*langs}:
                    total[x] = total.get(x, 0) + both[of == x].sum(0)
        for x, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(v), pa.string()), "i": np.arange(len(v)), "n": v})

    sums = docs.select(col(text).alias("t"), col(lang).cast("string").alias("l"), *([col(common)] if common else [])).mapInArrow(run, "lang string, i long, n long")
    sums = sums.groupBy("lang", "i").agg(F.sum("n").alias("n"))
    pairs = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("n"))
    return pairs.select("lang", F.slice("n", 1, len(CLASSES)).alias("chars"), F.slice("n", len(CLASSES) + 1, 31).alias("words"))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2, 0 to 1) between rows of counts; 0 where either is empty."""
    ps, qs = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    p, q = p / np.maximum(ps, 1), q / np.maximum(qs, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)).sum(-1) / 2
    return np.where((ps[..., 0] > 0) & (qs[..., 0] > 0), np.sqrt(np.maximum(d, 0)), 0)


VERDICT = "n_chars_seen long, n_words long, char_distance double, word_distance double, keep boolean, reason string"


def _verdicts(c, w, rc, rw, *, min_char_words, min_words, char_base, char_noise, word_base, word_noise):
    chars, count = c.sum(1), w.sum(1)
    dc, dw = np.round(distance(c, rc), 6), np.round(distance(w, rw), 6)
    root = np.sqrt(np.maximum(count, 1))
    bad_c, bad_w = (count >= min_char_words) & (dc > char_base + char_noise / root), (count >= min_words) & (dw > word_base + word_noise / root)
    reason = np.select([chars == 0, bad_c, bad_w, count < min_words], ["empty", "characters", "words", "short"], "ok")
    return chars, count, dc, dw, np.isin(reason, ["ok", "short"]), reason


def judge(docs: DataFrame, *, min_char_words: int = 30, min_words: int = 60, char_base: float = 0.13, char_noise: float = 1.4, word_base: float = 0.08, word_noise: float = 2.4, text: str = "text", lang: str = "lang", max_references: int = MAX_REFERENCES, add: str = "") -> DataFrame:
    """``docs`` with n_chars_seen, n_words, char_distance, word_distance, keep and reason, each prefixed by ``add``.

    A document's histograms of character classes and of its language's common words are compared, by Jensen-Shannon distance,
    to those of all documents of that language. A limit is its base plus its noise over the square root of the document's words,
    since the histogram of a short sample strays by that much. Documents under ``min_char_words`` or ``min_words`` words aren't
    judged by the histogram in question; 'short' ones stay. Reasons of rejection: 'empty', 'characters', 'words'.

    Null, empty text: rejected as 'empty'; blank text is 'short'. Null language: a language of its own, whose documents may be in
    any, judged by characters alone. Languages that have no list of common words learn one from their documents. Repeated rows: each is judged, and counts in the
    reference. Empty table: no row. Columns of ``docs`` that are named like the added ones are replaced, whatever their case.

    The references are a row a language. Up to ``max_references`` of them travel with the code, more are joined by language.
    """
    limits = {"min_char_words": min_char_words, "min_words": min_words, "char_base": char_base, "char_noise": char_noise, "word_base": word_base, "word_noise": word_noise}
    language = F.coalesce(col(lang).cast("string"), F.lit(""))
    other = docs.where(~language.isin("", *COMMON)).limit(1).count()  # no pass for languages that have lists
    more = learned_words(docs, text=text, lang=lang) if other else docs.sparkSession.createDataFrame([], "lang string, common array<long>")
    lists = more.limit(max_references + 1).collect()
    learned = {r["lang"]: r["common"] for r in lists}
    if len(lists) > max_references:
        with_lists = docs.select(col(text).alias("t"), language.alias("l")).join(more.withColumnRenamed("lang", "l"), "l", "left")
        ref = cut(references(with_lists, text="t", lang="l", common="common"))
    else:
        ref = cut(references(docs, learned, text=text, lang=lang))
    few = ref.limit(max_references + 1).collect()
    new = [x.split() for x in VERDICT.split(", ")]
    verdict = T.StructType([T.StructField(n, {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}[t]) for n, t in new])
    joined = len(few) > max_references
    table = {} if joined else {r["lang"]: np.array([*r["chars"], *r["words"]]) for r in few}

    def run(t: pa.Array, l: pa.Array, r: pa.Array | None, m: pa.Array | None) -> pa.Array:  # noqa: E741
        batch, done = pa.RecordBatch.from_arrays([t, l, *([r, m] if joined else [])], ["t", "l", *["r", "m"] * joined]), []
        for part, texts in slices(batch, 0):
            langs = [x or "" for x in part.column(1).to_pylist()]
            c, w = class_counts(texts), word_counts(words(texts), langs, dict(zip(langs, part.column(3).to_pylist(), strict=True)) if joined else learned)
            against = np.array(part.column(2).to_pylist()) if joined else np.array([table[x] for x in langs])
            columns = _verdicts(c, w, against[:, : len(CLASSES)], against[:, len(CLASSES) :], **limits)
            done.append(pa.StructArray.from_arrays([pa.array(x) if x.dtype.kind != "U" else pa.array(x.tolist(), pa.string()) for x in columns], [n for n, _ in new]))
        return pa.concat_arrays(done) if done else pa.array([], pa.struct([("n_chars_seen", pa.int64()), ("n_words", pa.int64()), ("char_distance", pa.float64()), ("word_distance", pa.float64()), ("keep", pa.bool_()), ("reason", pa.string())]))

    names = {(add + n).lower() for n, _ in new}
    kept = [c for c in docs.columns if c.lower() not in names]
    if joined:
        ref = ref.join(more, "lang", "left").select(F.col("lang").alias("__lang"), F.concat("chars", "words").alias("__ref"), F.col("common").alias("__common"))
        docs = docs.join(ref, language == F.col("__lang"))
        udf = F.arrow_udf(lambda t, l, r, m: run(t, l, r, m), verdict).asNondeterministic()  # noqa: E741
        judged = docs.withColumn("__v", udf(col(text), language, F.col("__ref"), F.col("__common")))
    else:
        udf = F.arrow_udf(lambda t, l: run(t, l, None, None), verdict).asNondeterministic()  # noqa: E741
        judged = docs.withColumn("__v", udf(col(text), language))
    return judged.select(*[col(c) for c in kept], *[F.col(f"__v.{n}").alias(add + n) for n, _ in new])


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that judge() keeps, with their columns."""
    names = docs.columns
    return judge(docs, add="__quality_", **options).where("__quality_keep").select(*[col(c) for c in names])
