"""Exact deduplication by composable polynomial fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import admits, buffers, col, cut, key_filter, mixed, slices, small

#: Two primes below 2^31, a base for each, and the bytes of a chunk: byte * power * chunk stays below 2^53, exact in a double.
PRIMES = (2147483629, 2147483587)
BASES = (1000003579, 1299709933)
CHUNK = 4096

_POWERS = np.empty((CHUNK, 2))
for _j in range(2):
    _x = 1
    for _i in range(CHUNK - 1, -1, -1):
        _POWERS[_i, _j] = _x
        _x = _x * BASES[_j] % PRIMES[_j]


def chunk_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes (n, 2) of the chunks, all at once; zero bytes in front, which change no polynomial, fill up the first."""
    pad = -len(data) % CHUNK
    x = np.zeros(len(data) + pad)
    x[pad:] = data
    h = x.reshape(-1, CHUNK) @ _POWERS
    return np.stack([h[:, j].astype(np.int64) % PRIMES[j] for j in range(2)], 1)


def combine(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """The fingerprint (bytes, h1, h2) of two parts in a row: the first is shifted by the second's length."""
    return (a[0] + b[0], *((a[j + 1] * pow(BASES[j], b[0], PRIMES[j]) + b[j + 1]) % PRIMES[j] for j in range(2)))


def fingerprint(data: np.ndarray) -> tuple[int, int, int]:
    """(bytes, h1, h2): chunks are hashed in parallel, then halves are combined until one is left."""
    if not len(data):
        return 0, 0, 0
    h, length = chunk_hashes(data), CHUNK
    while len(h) > 1:
        if len(h) % 2:
            h = np.vstack([np.zeros((1, 2), np.int64), h])
        shift = [pow(BASES[j], length, PRIMES[j]) for j in range(2)]
        h = np.stack([(h[::2, j] * shift[j] + h[1::2, j]) % PRIMES[j] for j in range(2)], 1)
        length *= 2
    return len(data), int(h[0, 0]), int(h[0, 1])


_FP = T.StructType([T.StructField(x, T.LongType()) for x in ("n", "h1", "h2", "key")])


def _hashed(t: pa.Array) -> np.ndarray:
    """fingerprint() of each text, a row each; null and empty have (0, 0, 0)."""
    out, at = np.zeros((len(t), 3), np.int64), 0
    for _, texts in slices(pa.RecordBatch.from_arrays([t], ["t"]), 0):
        data, offsets = buffers(texts)
        for i in range(len(texts)):
            out[at + i] = fingerprint(data[offsets[i] : offsets[i + 1]])
        at += len(texts)
    return out


def _keys(h: np.ndarray) -> np.ndarray:
    """A 64-bit key for each fingerprint."""
    u = h.astype(np.uint64)
    return mixed((u[:, 1] << np.uint64(32) | u[:, 2]) + mixed(u[:, 0]))


@F.arrow_udf(_FP)
def fingerprints(t: pa.Array) -> pa.Array:
    """fingerprint() of each text with its key; null and empty have (0, 0, 0)."""
    h = _hashed(t)
    return pa.StructArray.from_arrays([*[pa.array(h[:, j]) for j in range(3)], pa.array(_keys(h).view(np.int64))], _FP.names)


fingerprints = fingerprints.asNondeterministic()  # else a filter on it is pushed down and computes it twice


def fold_parts(parts: DataFrame, *, doc_id: str = "doc_id", part: str = "part", text: str = "text") -> DataFrame:
    """(doc_id, n, h1, h2) of documents too large for one row, whose texts lie in rows by ``part``: hashed apart, combined in order."""
    p = parts.select(col(doc_id).alias("doc_id"), col(part).alias("part"), fingerprints(col(text)).alias("f"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "f.n", "f.h1", "f.h2")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.column(1).to_pylist():
                h = (0, 0, 0)
                for x in row:
                    h = combine(h, (x["n"], x["h1"], x["h2"]))
                done.append(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([h[j] for h in done], pa.int64()) for j in range(3)]], ["doc_id", "n", "h1", "h2"])

    schema = T.StructType([T.StructField("doc_id", p.schema["doc_id"].dataType), *_FP.fields[:3]])
    return p.groupBy("doc_id").agg(ordered.alias("parts")).mapInArrow(fold, schema)


def same(a: memoryview, b: memoryview, chunk: int = 1 << 16) -> bool:
    """Whether the bytes agree, chunk by chunk and no further than the first that differs."""
    return len(a) == len(b) and all(a[i : i + chunk] == b[i : i + chunk] for i in range(0, len(a), chunk))


def _leaders(df: DataFrame, keys: list[str], ident: str, text: str) -> DataFrame:
    """The rows with ``lead`` (is it the first of its keys and text, by ident?) and ``lead_id`` (the ident of the first).

    A streaming comparison: rows arrive sorted, and only one text for each distinct content of the same keys is held.
    """
    names = df.columns
    k, i_id, i_text = [names.index(x) for x in keys], names.index(ident), names.index(text)
    out = T.StructType([*df.schema.fields, T.StructField("lead", T.BooleanType()), T.StructField("lead_id", df.schema[ident].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            key = list(zip(*[batch.column(j).to_pylist() for j in k], strict=True))
            ids, texts, lead, first = batch.column(i_id).to_pylist(), batch.column(i_text), [], []
            for r in range(len(ids)):
                text = memoryview(texts[r].as_buffer()).cast("B")
                if key[r] != now:
                    now, held = key[r], []
                found = next((h for h in held if same(h[0], text)), None)
                lead.append(found is None)
                if found is None:
                    held.append(found := (memoryview(bytes(text)), ids[r]))
                first.append(found[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.bool_()), pa.array(first, batch.column(i_id).type)], [*names, "lead", "lead_id"])

    return df.repartition(*[F.col(x) for x in keys]).sortWithinPartitions(*keys, F.col(ident).asc_nulls_last()).mapInArrow(run, out)


_KEYS = ["n", "h1", "h2"]


def _rounds(docs: DataFrame, doc_id: str, text: str, salted: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (columns c0, c1, ...) whose fingerprint no other row has, and the two rounds of comparison over all others.

    Which fingerprints repeat is found from fingerprints alone. A filter of them lets the rows in question through to the
    comparison; the other texts aren't moved. A row that it lets through by chance meets no other and leads its own group.
    """
    names = docs.columns
    i, t = f"c{names.index(doc_id)}", f"c{names.index(text)}"
    d = docs.select(*[col(x).alias(f"c{j}") for j, x in enumerate(names)])
    g = cut(d.select(fingerprints(F.col(t)).alias("f")).select("f.*").where("n > 0").groupBy(*_KEYS, "key").count().where("count > 1"))
    bits = key_filter(g)
    with_twin = T.StructType([*_FP.fields, T.StructField("twin", T.BooleanType())])

    def marked(t: pa.Array) -> pa.Array:
        h = _hashed(t)
        k = _keys(h)
        return pa.StructArray.from_arrays([*[pa.array(h[:, j]) for j in range(3)], pa.array(k.view(np.int64)), pa.array((h[:, 0] > 0) & admits(bits.value, k))], with_twin.names)

    d = d.withColumn("f", F.arrow_udf(lambda t: marked(t), with_twin).asNondeterministic()(F.col(t)))
    hot = g.where(F.col("count") > salted).select(*[F.col(x).alias(f"hot_{x}") for x in _KEYS], F.expr(f"ceil(count / {salted})").alias("parts"))
    c = d.where("f.twin").join(small(hot), [F.col(f"f.{x}") == F.col(f"hot_{x}") for x in _KEYS], "left")
    c = c.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64(i), F.col("parts")))
    one = _leaders(c.select(*[F.col(f"f.{x}").alias(x) for x in _KEYS], "salt", "parts", *d.columns[:-1]), [*_KEYS, "salt"], i, t)
    two = _leaders(one.where("lead and parts > 1").drop("lead", "lead_id"), _KEYS, i, t)
    return d.where("not f.twin").drop("f"), one, two


def duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salted: int = 2000) -> DataFrame:
    """(doc_id, duplicate_of): each row whose text an earlier row has, by doc_id, byte for byte; duplicate_of is the first.

    Texts get a fingerprint of their length and two polynomial hashes; rows that share one are compared, chunk by chunk, with the
    first of their group. Groups of more than ``salted`` rows are compared in parts, and then the parts' first rows. Only texts
    whose fingerprint repeats are moved. Documents too large for a row: part_duplicates().

    Null and empty text: no duplicate of anything. Null doc_id: ordered last, so duplicate_of is null only where all are.
    Repeated rows: the second is a duplicate of the first, so both columns are the same. Empty table: no row. Other columns of
    ``docs`` aren't read.
    """
    _, one, two = _rounds(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), "doc_id", "text", salted)
    again = two.where("not lead").select(*_KEYS, "salt", F.col("c0").alias("id"), F.col("lead_id").alias("first_id"))
    o, same_key = one.where("not lead").alias("o"), F.lit(True)
    for x in [*_KEYS, "salt"]:
        same_key = same_key & (F.col(f"o.{x}") == F.col(f"a.{x}"))
    early = o.join(again.alias("a"), same_key & F.col("o.lead_id").eqNullSafe(F.col("a.id")), "left")
    early = early.select(F.col("o.c0").alias("doc_id"), F.when(F.col("a.n").isNull(), F.col("o.lead_id")).otherwise(F.col("a.first_id")).alias("duplicate_of"))
    return early.unionByName(again.select(F.col("id").alias("doc_id"), F.col("first_id").alias("duplicate_of")))


def part_duplicates(parts: DataFrame, *, chunk: int = 1 << 20, doc_id: str = "doc_id", part: str = "part", text: str = "text") -> DataFrame:
    """(doc_id, duplicate_of) as by duplicates(), for documents too large for one row, whose texts lie in rows by ``part``.

    The parts' fingerprints are combined into the documents'. Documents that share one are cut anew, at multiples of ``chunk`` bytes
    of the whole, however their parts lie; chunks at one place are compared byte for byte, and documents that agree in all of
    them are the same. No task holds more than chunks.

    Null text: a part without bytes. Null or repeated part: ordered before the others, ties by text. Null doc_id: no document. A
    document without bytes: no duplicate of anything. Empty table: no row. Other columns of ``parts`` aren't read.
    """
    p = parts.select(col(doc_id).alias("doc_id"), col(part).alias("part"), F.coalesce(col(text), F.lit("")).alias("text")).where("doc_id is not null")
    f = fold_parts(p).where("n > 0")
    shared = f.groupBy(*_KEYS).count().where("count > 1").drop("count")
    some = cut(f.join(shared, _KEYS))
    p = p.join(small(some), "doc_id").withColumn("bytes", F.encode("text", "UTF-8")).withColumn("size", F.octet_length("bytes").cast("long"))
    at = F.sum("size").over(W.partitionBy("doc_id").orderBy("part", "text").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    p = p.withColumn("at", at).where("size > 0")
    p = p.withColumn("c", F.explode(F.expr(f"sequence(at div {chunk}, (at + size - 1) div {chunk})")))
    lo, hi = F.greatest(F.col("at"), F.col("c") * chunk), F.least(F.col("at") + F.col("size"), (F.col("c") + 1) * chunk)
    p = p.select(*_KEYS, "doc_id", "c", lo.alias("lo"), F.substring("bytes", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    p = p.groupBy(*_KEYS, "doc_id", "c").agg(F.expr("aggregate(transform(array_sort(collect_list(struct(lo, piece))), x -> x.piece), cast('' as binary), (a, x) -> concat(a, x))").alias("bytes"))
    kind = p.groupBy(*_KEYS, "c", "bytes").agg(F.min("doc_id").alias("kind"))
    p = p.join(kind, [*_KEYS, "c", "bytes"]).groupBy(*_KEYS, "doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "kind"))), lambda x: x["kind"].cast("string")), ","), 256).alias("content"))
    first = p.groupBy(*_KEYS, "content").agg(F.min("doc_id").alias("duplicate_of"))
    return p.join(first, [*_KEYS, "content"]).where("doc_id <> duplicate_of").select("doc_id", "duplicate_of")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salted: int = 2000) -> DataFrame:
    """The rows that duplicates() doesn't list, with all their columns: of each text, the row of the least doc_id."""
    alone, one, two = _rounds(docs, doc_id, text, salted)
    rows = [F.col(f"c{j}").alias(x) for j, x in enumerate(docs.columns)]
    return alone.select(*rows).unionByName(one.where("lead and parts = 1").select(*rows)).unionByName(two.where("lead").select(*rows))
