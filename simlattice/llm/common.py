"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A token of the operators that count tokens: a maximal run of characters other than blank, tab and line ends.
TOKEN = "[^ \\t\\n\\r]+"
#: Numpy work is cut into slices of about so many bytes of text.
SLICE_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="simlattice-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that neither replanning nor a lost executor repeats the work."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys of 8 bytes that a join may send to every executor; a table of more is joined by a shuffle.
BROADCAST_KEYS = 2_000_000


def small(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """The keys, to be broadcast if they are at most ``limit`` rows. They are counted, so cut() them first."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def tidy() -> None:
    """Gives memory that Python no longer uses back to the machine: workers wait for their next task, and several share an executor."""
    import ctypes  # here, since functions travel to the workers with their globals, and a library can't

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: like cut(), but columns are packed and read alone. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = at
    return out


def discard(df: DataFrame) -> None:
    """Removes what stored() keeps for exactly this DataFrame, once nothing reads it any more."""
    df.stored_at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df.stored_at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Actions within send Python at most so many rows at a time, so that long texts don't make batches of a hundred megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Bits of a key filter. It is of this size whatever the data; beyond some ten million keys more passes that needn't.
FILTER_BITS = 27


def key_filter(keys: DataFrame, key: str = "key", twice: bool = False):
    """A broadcast bitmap that admits() every key of the table (64-bit hashes), or with ``twice`` every one that occurs in two rows or more; and others by chance.

    Tasks send the places of their keys' marks, 2 bytes each; the driver gets the bitmap and no more. It only spares rows a
    shuffle: who uses it joins or counts exactly afterwards.
    """
    bits, block = 1 << FILTER_BITS, min(1 << 16, 1 << FILTER_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, again, more = np.zeros(0, np.uint32), np.zeros(0, np.uint32), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, c = np.unique(np.concatenate([at, *more]), return_counts=True)
            return u, np.union1d(again, u[c > 1]) if twice else again

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            more += [(p & np.uint64(bits - 1)).astype(np.uint32) for p in (k, k >> np.uint64(32))]
            if sum(map(len, more)) > 1 << 20:
                at, again = merged()
                more = []
        at, again = merged()
        for places, often in ((at, False), (again, True)):
            ends = np.searchsorted(places, np.arange(0, bits + 1, block))
            some = np.flatnonzero(np.diff(ends))
            low = (places % block).astype(np.uint16)
            tidy()
            yield pa.RecordBatch.from_pydict({"block": pa.array(some, pa.int64()), "often": pa.array([often] * len(some), pa.bool_()), "places": pa.array([low[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, often_seen = None, np.zeros(block, bool), np.zeros(block, bool)
        close = lambda: pa.RecordBatch.from_pydict({"block": [now], "often": [True], "places": [np.packbits(often_seen if twice else seen, bitorder="little").tobytes()]})
        for batch in batches:
            for b, often, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if b != now:
                    if now is not None:
                        yield close()
                    now, seen, often_seen = b, np.zeros(block, bool), np.zeros(block, bool)
                at = np.frombuffer(places, np.uint16)
                if often:
                    often_seen[at] = True
                else:
                    often_seen[at] |= seen[at]
                    seen[at] = True
        if now is not None:
            yield close()

    shape = "block long, often boolean, places binary"
    found = keys.select(F.col(key).alias("key")).mapInArrow(mark, shape).repartition("block").sortWithinPartitions("block").mapInArrow(merge, shape).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for b, places in zip(found.column(0).to_pylist(), found.column(2).to_pylist(), strict=True):
        out[b * block // 8 : (b + 1) * block // 8] = np.frombuffer(places, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def admits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) may be in the table of key_filter()."""
    last = np.uint64(64 * len(bits) - 1)
    at = lambda p: (bits[((p & last) >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)
    hit = at(keys).astype(bool)
    hit[hit] = at(keys[hit] >> np.uint64(32)).astype(bool)
    return hit


def col(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def token_count(text: str = "text") -> Column:
    """Tokens in the text; 0 for null and empty."""
    return F.coalesce(F.regexp_count(col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def shuffle_key(ident: str, seed: int) -> Column:
    """A reproducible pseudo-random order of documents that other engines can compute too."""
    return F.md5(F.concat(F.coalesce(col(ident).cast("string"), F.lit("null")), F.lit(f"/{seed}")))


def strings(column: pa.Array) -> pa.Array:
    """Nulls become empty texts."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins (one more offset than texts); no copy."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch in runs of rows with about SLICE_BYTES of text, each with its texts (nulls as empty)."""
    texts = strings(batch.column(text))
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to
    tidy()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15 | 1, np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes above 32), the text each belongs to, and each one's bytes."""
    blank = data <= 32
    starts = ~blank
    starts[1:] &= blank[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = ~blank[firsts]
    ws = np.flatnonzero(starts)
    if not len(ws):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail, off = data[ws[0] :], ws - ws[0]
    lengths = np.diff(off, append=len(tail))
    place = np.arange(len(tail)) - np.repeat(off, lengths)
    value = (tail.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023]
    value[tail <= 32] = 0
    h = mixed(np.add.reduceat(value, off))
    size = np.add.reduceat((tail > 32).astype(np.int64), off)
    return h, np.searchsorted(offsets, ws, "right") - 1, size


def hash_of(word: str) -> int:
    """What word_hashes() gives for this one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])
