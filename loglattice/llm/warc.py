"""WARC files written in shards, the same bytes for the same rows, and read again."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, shared_dir, written

DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6f0a4dd1-5f0e-5d1c-9f0b-3c1c7a2b9e10")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    """One gzip member without a time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(kind: str, name: str, block: bytes, content_type: str, extra: list[tuple[str, str]], date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"), ("WARC-Date", date), *extra, ("WARC-Block-Digest", _digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def uri(url: str | None) -> str:
    """A target for the header: what can't stand in one line of ASCII is escaped; a null is ``urn:none``."""
    if url is None:
        return "urn:none"
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) or "urn:empty"


class _File:
    """A file under a temporary name until it is complete."""

    def __init__(self, base: str, name: str, date: str):
        self.system, self.folder = fs.FileSystem.from_uri(base)
        self.name, self.date, self.size, self.rows, self.sha = name, date, 0, [], hashlib.sha1()
        self.system.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.temporary = f"{self.folder}/_temporary/{name}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.temporary)
        info = f"software: loglattice\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
        self.put(_record("warcinfo", name, info, "application/warc-fields", [("WARC-Filename", name)], date))

    def put(self, record: bytes) -> tuple[int, int]:
        data, at = _member(record), self.size
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        return at, len(data)

    def page(self, key, url: str | None, html: str | None) -> None:
        body = (html or "").encode("utf-8", "surrogatepass")
        digest = _digest(body)
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
        record = _record("response", f"{self.name}:{len(self.rows)}", block, "application/http; msgtype=response", [("WARC-Target-URI", uri(url)), ("WARC-Payload-Digest", digest)], self.date)
        self.rows.append((key, url, *self.put(record), digest))

    def commit(self) -> list[tuple]:
        """Move the file to its name. A second attempt of a lost task writes the same bytes and replaces it."""
        self.out.close()
        self.system.move(self.temporary, f"{self.folder}/{self.name}")
        return [(k, u, self.name, a, n, d, self.size, self.sha.hexdigest()) for k, u, a, n, d in self.rows]


#: at most about so many keys come to the driver, and so many tasks write
SAMPLE, TASKS = 131_072, 32_768


def _key(pages: DataFrame, id_col: str, url_col: str) -> Column:
    """(url, id) as one text in whose order records stand: nulls first, whole numbers by their value."""
    ids = column(id_col)
    shown = ids.cast("string")
    if isinstance(pages.schema[id_col].dataType, T.IntegralType):
        shown = F.lpad((ids.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    part = lambda c: F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c))
    return F.concat(part(column(url_col)), F.lit("\x00"), part(shown))


def _edges(rows: DataFrame, bucket_bytes: int) -> tuple[list[str], int]:
    """(first keys of all buckets but the first, number of buckets), from a sample of rows by the hash of their key.

    Buckets hold about ``bucket_bytes`` of text each, more where there would be over TASKS of them. The sample depends
    on the rows alone, and has some SAMPLE distinct keys at most.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 512
    total, n = rows.agg(F.sum(size), F.count(F.lit(1))).first()
    buckets = min(TASKS, max(1, -(-(total or 0) // bucket_bytes)))
    if buckets == 1:
        return [], 1
    share = min(1.0, min(64 * buckets, SAMPLE) / n)
    kept = rows.where(F.xxhash64("key") <= min(2**63 - 1, int(share * 2.0**64) - 2**63)).groupBy("key").agg(F.sum(size).alias("size"))
    keys = sorted((r["key"].encode("utf-8", "surrogatepass"), r["size"]) for r in kept.collect())
    due, seen, edges = sum(z for _, z in keys) / buckets, 0, []
    for key, z in keys:
        if seen >= due * (len(edges) + 1):
            edges.append(key)
        seen += z
    return edges, len(edges) + 1


def write_warc(pages: DataFrame, path: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, date: str = DATE) -> DataFrame:
    """Write ``pages`` as WARC files to ``path`` and return the index: (id, url, file, offset, length, digest).

    1. Splitters come from the rows whose key, (url, id), has one of the lowest hashes: the same ones for the same
       rows. They cut the order of keys into buckets of about ``bucket_bytes`` of text (:func:`_edges`).
    2. Each bucket goes to the task of its number, is sorted by key and text and written in this order, one gzip member
       for each record. Once a file has ``roll_bytes`` of compressed bytes, the next one begins.
    3. A file is written under a temporary name and moved to its own when complete. Attempts of the same task write
       the same bytes, so that a lost executor leaves nothing but a file in ``_temporary``, removed at the end.
    4. ``manifest`` lists the files with sizes, counts and SHA-1. It is written last, also under a temporary name: files
       count only if it is there.

    Headers, lengths, digests and record ids are made anew. Nulls sort first; a null url becomes ``urn:none`` and a
    null page an empty payload. Rows of one url are spread by their ids; repeated rows have a record each, next to each
    other. No rows make an empty manifest and no file.
    """
    spark = pages.sparkSession
    path = (path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}").rstrip("/")
    if ":" not in path.split("/")[0]:
        path = "file://" + path
    rows = pages.select(column(id_col).alias("id"), column(url_col).alias("url"), column(html_col).alias("html"), _key(pages, id_col, url_col).alias("key"))
    kind = pages.schema[id_col].dataType
    edges, buckets = _edges(rows, bucket_bytes)

    @F.pandas_udf("int")
    def bucket(key):
        import numpy as np
        import pandas as pd

        asked = np.array([k.encode("utf-8", "surrogatepass") for k in key], object)
        return pd.Series(np.searchsorted(np.array(edges, object), asked, "right").astype("int32"))

    placed = rows.withColumn("bucket", bucket("key") if edges else F.lit(0))
    order = placed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "key", F.asc_nulls_first("html"))
    order = order.select("id", "url", "html", "bucket")
    names = ["id", "url", "file", "offset", "length", "digest", "size", "sha1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, types = None, (-1, 0), None

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            types = [batch.schema.field("id").type, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            for k in range(len(batch)):
                key, url, html, b = (c[k].as_py() for c in batch.columns)
                if out and (b != at[0] or out.size >= roll_bytes):
                    yield done(out.commit())
                    out = None
                if not out:
                    at = (b, at[1] + 1 if b == at[0] else 0)
                    out = _File(path, f"pages-{at[0]:06d}-{at[1]:04d}.warc.gz", date)
                out.page(key, url, html)
        if out:
            yield done(out.commit())

    index = written(order.mapInArrow(run, f"id {kind.simpleString()}, url string, file string, offset long, length long, digest string, size long, sha1 string"), "index")
    manifest = index.groupBy("file").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("records"), F.max("sha1").alias("sha1"))
    manifest.coalesce(1).sortWithinPartitions("file").write.mode("overwrite").json(f"{path}/_manifest")
    system, folder = fs.FileSystem.from_uri(path)
    if system.get_file_info(f"{folder}/manifest").type != fs.FileType.NotFound:
        system.delete_dir(f"{folder}/manifest")
    system.move(f"{folder}/_manifest", f"{folder}/manifest")
    if system.get_file_info(f"{folder}/_temporary").type != fs.FileType.NotFound:
        system.delete_dir(f"{folder}/_temporary")
    return index.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "file", "offset", "length", "digest")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each gzip member of a WARC file."""
    at = 0
    while at < len(data):
        z = zlib.decompressobj(31)
        parts, end = [], at
        while not z.eof and end < len(data):
            parts.append(z.decompress(memoryview(data)[end : end + 65536]))
            end = min(end + 65536, len(data))
        raw, end = b"".join(parts), end - len(z.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield at, end - at, headers, rest[: int(headers["Content-Length"])]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, url, html, digest) of the responses in the files that the manifest lists."""
    listed = spark.read.schema("file string").json(f"{path}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for at, _, headers, block in records(data):
                    if headers["WARC-Type"] == "response":
                        rows.append((name, at, headers["WARC-Target-URI"], block.partition(b"\r\n\r\n")[2].decode("utf-8", "replace"), headers["WARC-Payload-Digest"]))
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "offset", "url", "html", "digest"), r)) for r in rows], pa.schema([("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("digest", pa.string())]))

    return files.join(listed, "file", "left_semi").mapInArrow(run, "file string, offset long, url string, html string, digest string")
