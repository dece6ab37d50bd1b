"""WARC archives through a chunked record table.

Payloads never travel whole through Python: the JVM cuts each into rows of (record, chunk number,
bytes), at most CHUNK bytes each. Writers append a record chunk by chunk, each record a gzip member of
its own; readers inflate a member piece by piece and yield the same kind of rows, with the running
byte count and SHA-256 so far, so no step holds a record of any size in memory.

Archives lie in the shared folder, reached through a file system chosen by its address. Each write
attempt has its own file name, and the manifest that a reader starts from is a committed table of
the attempts that succeeded, so lost executors or repeated tasks leave no half-read archive. A record's
id is made of its file's name and its number there.

Which record revisits which is decided on slim rows of keys and digests. Only rows that a bitmap of these cannot
rule out are joined with their payloads; the others are written from where they are read.

Defined cases: null payload is empty; a null key or url is written as an absent header, and a null key
is a response that none revisits; repeated rows are records of their own (of equal payloads and equal smallest keys all
are responses), and rows of one key with different payloads are judged each by its own; payloads under
MIN_REVISIT bytes are always responses; no rows give no archives; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, pick, scratch, sliced, written

CHUNK, MIN_REVISIT, SALTS = 1 << 18, 100, 16
#: Chunk rows as read: size_so_far and sha256_so_far run over the payload up to this chunk.
CHUNK_SCHEMA = "archive string, record_offset long, record_id string, key long, uri string, record_type string, refers_to long, stated_digest string, chunk_no long, is_last boolean, data binary, size_so_far long, sha256_so_far string"
_MANIFEST = "archive string, records long, bytes long"
_KEY, _REFERS = b"WARC-Source-Key", b"WARC-Refers-To-Key"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """key, uri, payload, size, digest, record_type, refers_to of each row."""
    rows = pick(pages, key=key, uri=url, payload=payload)
    rows = rows.select(F.col("key").cast("long").alias("key"), F.col("uri").cast("string").alias("uri"), F.encode(F.coalesce(F.col("payload").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # A hot digest is split by its salt.
    slim = written(rows.select("key", "digest", "size").filter(F.col("size") >= MIN_REVISIT).filter("key is not null").select("key", "digest", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt")), "warc-keys")
    again = slim.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = slim.join(again, ["digest", "salt"]).filter(F.col("key") > F.col("first")).select("key", "digest", F.col("first").alias("refers_to")).distinct()
    revisits = written(revisits.withColumn("mark", F.xxhash64("key", "digest")), "warc-revisits")
    told = marked(rows.withColumn("mark", F.xxhash64("key", "digest")), revisits, "mark").drop("mark")
    plain = told.filter("not _maybe").drop("_maybe").withColumn("refers_to", F.lit(None).cast("long"))
    again = told.filter("_maybe").drop("_maybe").join(revisits.drop("mark"), ["key", "digest"], "left").select(*plain.columns)
    return plain.unionByName(again).withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _chunked(rows: DataFrame) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(CHUNK))).cast("int")
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("key", "uri", "size", "digest", "record_type", "refers_to", "chunk_no", F.expr(f"substring(payload, chunk_no * {CHUNK} + 1, {CHUNK})").alias("data"))


def _header(row: dict, record_id: str) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + row["record_type"].encode(), b"WARC-Record-ID: <urn:uuid:%s>" % record_id.encode(), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if row["uri"] is not None:
        lines.append(b"WARC-Target-URI: " + b" ".join(row["uri"].encode().split()))
    if row["key"] is not None:
        lines.append(_KEY + b": %d" % row["key"])
    if row["refers_to"] is not None:
        lines.append(_REFERS + b": %d" % row["refers_to"])
    lines += [b"WARC-Payload-Digest: sha256:" + row["digest"].encode(), b"Content-Type: text/html", b"Content-Length: %d" % row["size"]]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def _writer(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, packer, count = None, "", None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system, base = pafs.FileSystem.from_uri(folder)
                    system.create_dir(base, recursive=True)
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(f"{base}/{name.rpartition('/')[2]}", compression=None)
                if row["chunk_no"] == 0:
                    packer, left = zlib.compressobj(level, zlib.DEFLATED, 31), row["size"]
                    out.write(packer.compress(_header(row, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{count}")))))
                out.write(packer.compress(row["data"]))
                left -= len(row["data"])
                if left <= 0:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    count += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [count], "bytes": [size]}, pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return write


def write_archives(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write ``records()`` as WARC files below ``folder``; the manifest of them, committed."""
    return written(_chunked(rows).mapInArrow(sliced(_writer(folder, level)), _MANIFEST), "warc-manifest")


class _Member:
    """Streams one archive: inflates members piece by piece and splits them in headers and payload pieces."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.raw, self.at = stream, b"", 0

    def pieces(self) -> Iterator[tuple[int, Iterator[bytes]]]:
        while self.raw or self._fill():
            yield self.at, self._one()

    def _fill(self) -> bool:
        self.raw = self.stream.read(CHUNK)
        return bool(self.raw)

    def _one(self) -> Iterator[bytes]:
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            if not self.raw and not self._fill():
                raise ValueError("an archive ends inside a record")
            given = len(self.raw)
            piece = inflate.decompress(self.raw, CHUNK)
            self.raw = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            self.at += given - len(self.raw)
            if piece:
                yield piece


def _read_one(archive: str) -> Iterator[dict]:
    system, path = pafs.FileSystem.from_uri(archive)
    with system.open_input_stream(path, compression=None) as stream:
        for offset, pieces in _Member(stream).pieces():
            buffer = b""
            while b"\r\n\r\n" not in buffer:
                buffer += next(pieces)
            head, _, buffer = buffer.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            left, digest, size, number = int(fields[b"Content-Length"]), hashlib.sha256(), 0, 0
            number_of = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
            base = {"archive": archive, "record_offset": offset, "record_id": fields[b"WARC-Record-ID"].decode()[10:-1], "key": number_of(_KEY), "uri": fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None, "record_type": fields[b"WARC-Type"].decode(), "refers_to": number_of(_REFERS), "stated_digest": fields[b"WARC-Payload-Digest"].decode().partition(":")[2]}
            while True:
                if not buffer and left:
                    buffer = next(pieces)
                data, buffer = buffer[:left], buffer[left:]
                left -= len(data)
                size += len(data)
                digest.update(data)
                yield base | {"chunk_no": number, "is_last": not left, "data": data, "size_so_far": size, "sha256_so_far": digest.hexdigest()}
                number += 1
                if not left:
                    break
            for _ in pieces:  # the record's end
                pass


def _reader(keep_data: bool):
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in CHUNK_SCHEMA.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                for row in _read_one(archive):
                    if not keep_data:
                        if not row["is_last"]:
                            continue
                        row["data"] = None
                    rows.append(row)
                    held += len(row["data"] or b"")
                    if held > 8 * CHUNK or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(manifest: DataFrame, keep_data: bool = True) -> DataFrame:
    """Chunk rows (CHUNK_SCHEMA) of all archives in ``manifest``; one task an archive. Without data,
    only each record's last row, whose running size and digest cover the whole payload."""
    spread = manifest.select("archive").repartition(max(1, manifest.count()), "archive")  # by number: not coalesced
    return spread.mapInArrow(_reader(keep_data), CHUNK_SCHEMA)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None) -> DataFrame:
    """Write all rows, read them back; one row a record, from the archives alone. A digest that
    differs from the stated one fails the job."""
    folder = folder or scratch(pages.sparkSession, "warc")
    read = read_archives(write_archives(records(pages, key, url, payload), folder), keep_data=False)
    digest = F.when(F.col("sha256_so_far") == F.col("stated_digest"), F.col("sha256_so_far")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "record_id")))
    return read.select(F.col("key").alias(key), F.col("size_so_far").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "record_id", "archive", "record_offset", F.col("uri"))
