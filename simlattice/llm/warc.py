"""A deterministic, sharded WARC writer."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, shared_dir, stored

#: Keys that the driver sees to place a shard's bounds, for each shard.
SAMPLED = 16
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "url string, shard long, file string, offset long, length long, digest string"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or absolute path."""
    return pafs.FileSystem.from_uri(uri)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, url: str | None, ident: str, date: str, content: str, block: bytes, payload: bytes | None, extra: tuple[tuple[str, str], ...] = ()) -> bytes:
    """One WARC record. Its headers are made anew from its content, its id from ``ident``, so that the same record is the same bytes."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, ident)}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", url))
    if payload is not None:
        head.append(("WARC-Payload-Digest", digest(payload)))
    head += [("WARC-Block-Digest", digest(block)), ("Content-Type", content), *extra, ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def response(url: str | None, page_id: object, page: str | None, date: str) -> bytes:
    """The response record of a page: HTTP headers regenerated for the bytes at hand, UTF-8 and neither chunked nor compressed."""
    body = (page or "").encode()
    clean = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    return record("response", clean, f"{clean}\n{page_id}\n{hashlib.sha1(body).hexdigest()}", date, "application/http; msgtype=response", http, body)


def member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name, so that it depends on the data alone."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def order_key(page_id: str, url: str, page: str, kind: T.DataType) -> Column:
    """The records' order, as text: by url, page_id as text, and a hash of the page; rows that share it are the same."""
    ident = F.hex(page_id) if isinstance(kind, T.BinaryType) else F.col(page_id).cast("string")
    return F.concat_ws("\0", F.coalesce(url, F.lit("")), F.coalesce(ident, F.lit("")), F.md5(F.coalesce(page, F.lit(""))))


def bounds(keys: DataFrame, shard_bytes: int) -> list[str]:
    """The least key of every shard but the first, from keys (k, s) with the records' sizes. They depend on the records alone, not
    on how these lie in partitions.

    The keys of the least hashes are the sample, as many for each shard's worth of bytes; its evenly spaced keys are the bounds.
    """
    total = keys.agg(F.sum("s"), F.count("*")).first()
    shards = -(-(total[0] or 0) // shard_bytes)
    if shards < 2:
        return []
    # a hash is below this with the chance that the sample's size asks for; hashes, and so the sample, are the same each time
    limit = int(-(2**63) + 2**64 * min(1.0, SAMPLED * shards / total[1]))
    sample = sorted({r[0].encode() for r in keys.where(F.xxhash64("k") <= F.lit(min(limit, 2**63 - 1))).select("k").collect()})
    return sorted({sample[len(sample) * i // shards] for i in range(1, shards)}) if sample else []


def write(pages: DataFrame, folder: str, *, shard_bytes: int = 1 << 30, file_bytes: int = 1 << 28, level: int = 6, date: str = "2020-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Writes the pages as WARC files into ``folder`` and returns their index: page_id and INDEX, a row for each record.

    Records are range-sorted by url, page_id (as text) and page into shards of about ``shard_bytes`` of text, so that pages of one
    url may lie in several shards; only rows that are the same in all three can't be parted. A shard's file is closed once it has
    ``file_bytes`` compressed bytes, and the next begun. Each is written under a temporary name and renamed when complete; then
    the shard's manifest (files, sizes, SHA-256, records) is, and last of all, by the driver, ``manifest.json``, which lists the
    shards. A task that is lost or runs twice writes the same bytes to the same name. Without manifest.json nothing counts as written.

    Null url: 'about:blank', sorted as ''. Null page: an empty body. page_id: of any type that has a text form, or binary; null: written. Repeated rows: each is a record, with the same
    id. Empty table: no shard, a manifest of none. Characters that no URL has are percent-encoded. Other columns of ``pages`` aren't read.
    """
    spark = pages.sparkSession
    p = pages.select(col(page_id).alias("page_id"), col(url).cast("string").alias("url"), col(page).alias("page"))
    kind = p.schema["page_id"].dataType
    size = F.coalesce(F.octet_length("page"), F.lit(0)).cast("long") + 300
    p = p.withColumn("k", order_key("page_id", "url", "page", kind))
    edges = bounds(stored(p.select("k", size.alias("s"))), shard_bytes)  # one pass over the pages finds sizes and bounds

    @F.arrow_udf(T.IntegerType())
    def shard_of(k: pa.Array) -> pa.Array:
        from bisect import bisect_right

        return pa.array([bisect_right(edges, x.encode()) for x in k.to_pylist()], pa.int32())

    out = T.StructType([T.StructField("shard", T.LongType()), T.StructField("manifest", T.StringType())])
    info_block = b"software: deterministic sharded writer\r\nformat: WARC File Format 1.1\r\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        state: dict = {"shard": None}

        def open_file() -> None:
            state["name"] = f"shard-{state['shard']:06d}-{len(state['files']):05d}.warc.gz"
            state["temporary"] = f"{root}/_{state['name']}.{attempt}"
            state["out"], state["at"], state["sum"], state["n"] = fs.open_output_stream(state["temporary"]), 0, hashlib.sha256(), 0
            put(record("warcinfo", None, state["name"], date, "application/warc-fields", info_block, None, (("WARC-Filename", state["name"]),)))

        def put(data: bytes) -> tuple[int, int]:
            z = member(data, level)
            state["out"].write(z)
            state["sum"].update(z)
            state["at"] += len(z)
            return state["at"] - len(z), len(z)

        def close_file() -> None:
            state["out"].close()
            fs.move(state["temporary"], f"{root}/{state['name']}")
            state["files"].append({"file": state["name"], "bytes": state["at"], "records": state["n"], "sha256": state["sum"].hexdigest()})
            state["out"] = None

        def close_shard() -> pa.RecordBatch:
            if state["out"] is not None:
                close_file()
            name = f"shard-{state['shard']:06d}.json"
            text = json.dumps({"shard": state["shard"], "files": state["files"]})
            columns = dict(zip(index_names, zip(*state["index"], strict=True), strict=True))
            index = pa.table([pa.array(columns[c], t) for c, t in zip(index_names, index_types, strict=True)], names=index_names)
            with fs.open_output_stream(temporary := f"{root}/_{name}.index.{attempt}") as f:
                pq.write_table(index, f)
            fs.move(temporary, f"{root}/shard-{state['shard']:06d}.index")
            with fs.open_output_stream(temporary := f"{root}/_{name}.{attempt}") as f:
                f.write(text.encode())
            fs.move(temporary, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"shard": pa.array([state["shard"]], pa.int64()), "manifest": [name]})

        index_names = ["page_id", *[x.split()[0] for x in INDEX.split(", ")]]
        for batch in batches:
            index_types = [batch.column(1).type, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            for shard, pid, u, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != state["shard"]:
                    if state["shard"] is not None:
                        yield close_shard()
                    state = {"shard": shard, "files": [], "index": [], "out": None}
                if state["out"] is None:
                    open_file()
                data = response(u, pid, html, date)
                offset, length = put(data)
                state["n"] += 1
                state["index"].append((pid, u, shard, state["name"], offset, length, digest((html or "").encode())))
                if state["at"] >= file_bytes:
                    close_file()
        if state["shard"] is not None:
            yield close_shard()

    n = len(edges) + 1
    rows = p.withColumn("shard", shard_of("k")).repartitionById(n, F.col("shard")).sortWithinPartitions("k").select("shard", "page_id", "url", "page")
    done = rows.mapInArrow(run, out).collect()
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(temporary := f"{root}/_manifest.{uuid.uuid4().hex}") as f:
        f.write(json.dumps({"shards": sorted(r["manifest"] for r in done), "date": date}).encode())
    fs.move(temporary, f"{root}/manifest.json")
    schema = T.StructType([T.StructField("page_id", kind), *T._parse_datatype_string(INDEX).fields])
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/shard-{r['shard']:06d}.index" for r in done])


def fresh_folder(spark: SparkSession) -> str:
    """A new folder for output in the one that all executors share."""
    base = shared_dir(spark)
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc-{uuid.uuid4().hex}".replace("file:////", "file:///")
