"""WARC archives: planning revisits, and a Python data source that writes and reads compressed archives.

Records are one gzip member each, with the member's length in the gzip header's extra field (`sl`), so that a reader
inflates a record's headers only and leaps over payloads it doesn't need. Files of other writers, without that field
or without compression, are read too. ``spark.read.format("warc")`` makes a partition of each file; equality, `IN`,
range and null predicates on header columns and on the record type are decided from headers, before any payload is
decoded. With the option ``payload=false`` no payload is decoded; with ``verify=true`` each payload's length and SHA-1 are
held against its headers.

A null payload is empty. Null urls and ids have no header and come back null. Repeated pages get a record each; of
repeated rows with one payload and the largest page_id all are responses. An empty table makes an archive without files,
which is read as an empty table. Columns but page_id, url and html are not read. A record is held whole by a task, as a
payload is one value; members of 4 GiB and more have no skip length. A file that ends within a record is an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from strideway.llm.common import looked_up, marked, written

SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Revisits are made for payloads of at least so many bytes.
MIN_BYTES = 0
#: A file is closed when it has so many bytes; payload bytes in a batch that is read; bytes read to find headers.
FILE_BYTES, BATCH_BYTES, PEEK = 256 << 20, 4 << 20, 1 << 12
WRITTEN_AT = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n\r\n"
MANIFEST = "_files-"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record_bytes(page_id, url, record_type: str, payload_bytes: int, digest: str, refers_to, payload: bytes) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    headers = {
        "WARC-Type": record_type,
        "WARC-Record-ID": record_id(page_id, url),
        "WARC-Date": WRITTEN_AT,
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~%"),
        "X-URI-Escaped": None if url is None or quote(url, safe="!#$&'()*+,/:;=?@[]~%") == url else quote(url, safe=""),
        "X-Page-ID": page_id,
        "X-Payload-Length": payload_bytes,
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if record_type == "revisit":
        headers |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": refers_to}
    else:
        block += payload
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers.items() if v is not None)]
    return "\r\n".join(lines).encode() + BREAK + block + BREAK


def member(data: bytes, level: int = 4) -> bytes:
    """A gzip member with skip lengths (compressed and not) in its extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:  # beyond the field's numbers: readers inflate such a member
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, size, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own; only those of committed tasks get into the manifest that readers follow."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        stem = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        names, out, size = [], None, 0
        for batch in iterator:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for k in range(batch.num_rows):
                row = {name: column[k].as_py() for name, column in columns.items()}
                payload = row["payload"] or b""
                digest = payload_digest(payload)
                data = member(record_bytes(row["page_id"], row["url"], row["record_type"], len(payload), digest, row["refers_to"], payload))
                if out is None:
                    names.append(f"{stem}-{len(names):04d}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name.startswith(MANIFEST):
                    store.delete_file(old.path)
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Files | None]) -> None:
        store, root = file_system(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.delete_file(f"{root}/{name}")


@dataclass
class FilePart(InputPartition):
    name: str


def _matches(row: dict, test) -> bool:
    value = row[test.attribute[0]]
    if isinstance(test, IsNull):
        return value is None
    if value is None:
        return False
    if isinstance(test, IsNotNull):
        return True
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, GreaterThan):
        return value > test.value
    if isinstance(test, GreaterThanOrEqual):
        return value >= test.value
    if isinstance(test, LessThan):
        return value < test.value
    return value <= test.value


class WarcReader(DataSourceReader):
    HEADER_COLUMNS = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to")
    TESTS = (EqualTo, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)

    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify = path, payload, verify
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, self.TESTS) and len(f.attribute) == 1 and f.attribute[0] in self.HEADER_COLUMNS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        store, root = file_system(self.path)
        found = store.get_file_info(fs.FileSelector(root)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        manifests = [x for x in found if x.base_name.startswith(MANIFEST)]
        if manifests:
            names = [f"{root}/{n}" for x in manifests for n in json.loads(store.open_input_stream(x.path, compression=None).read())]
        else:
            names = [x.path for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        return [FilePart(n) for n in sorted(names)] or [FilePart("")]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, _ = file_system(self.path)
        rows: list[dict] = []
        size = 0
        with store.open_input_file(partition.name) as f:
            for row in records(f, self.tests, self.payload or self.verify):
                if self.verify and row["record_type"] == "response" and (row["payload_bytes"] != len(row["payload"]) or row["payload_digest"] != payload_digest(row["payload"])):
                    raise ValueError(f"{partition.name}: the payload of page {row['page_id']} isn't that of its headers")
                if not self.payload:
                    row["payload"] = None
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)


def parse_headers(data: bytes) -> dict:
    """A record's header columns; the payload is still missing."""
    found = {}
    for line in data.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        found[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    number = lambda k: int(found[k]) if found.get(k, "").lstrip("-").isdigit() else None
    escaped = found.get(b"x-uri-escaped")
    return {
        "page_id": number(b"x-page-id"), "url": unquote(escaped) if escaped else found.get(b"warc-target-uri"), "record_type": found.get(b"warc-type"), "payload_bytes": number(b"x-payload-length"),
        "payload_digest": (found.get(b"warc-payload-digest") or "").rpartition(":")[2] or None, "refers_to": number(b"x-refers-to-page-id"), "payload": None, "length": number(b"content-length") or 0,
    }


def _payload(row: dict, block: bytes) -> bytes | None:
    if row["record_type"] != "response":
        return None
    payload = block.partition(BREAK)[2] if block.startswith(b"HTTP/") else block
    if row["payload_bytes"] is None:
        row["payload_bytes"] = len(payload)
    return payload


def _skip_length(extra: bytes) -> int:
    while len(extra) >= 4:
        size = struct.unpack("<H", extra[2:4])[0]
        if extra[:2] == b"sl" and size >= 4:
            return struct.unpack("<I", extra[4:8])[0]
        extra = extra[4 + size :]
    return 0


def _more(data: bytes) -> bytes:
    if not data:
        raise ValueError("the archive is cut off")
    return data


def records(f, tests: list, payload: bool) -> Iterator[dict]:
    """The records of an open file that pass ``tests``; bodies are inflated only for those, if at all."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        head = f.read(PEEK)
        if head[:2] == b"\x1f\x8b":
            extra = head[12 : 12 + struct.unpack("<H", head[10:12])[0]] if head[3] & 4 else b""
            skip = _skip_length(extra)
            inflate = zlib.decompressobj(31)
            text = inflate.decompress(head, PEEK)
            while BREAK not in text and not inflate.eof:
                text += inflate.decompress(_more(inflate.unconsumed_tail or f.read(PEEK)), PEEK)
            row = parse_headers(text.partition(BREAK)[0])
            wanted = all(_matches(row, t) for t in tests)
            if skip and not (wanted and payload):
                at += skip
            else:
                parts = [text]
                while not inflate.eof:
                    parts.append(inflate.decompress(_more(inflate.unconsumed_tail or f.read(1 << 16))))
                at = f.tell() - len(inflate.unused_data)
                if wanted and payload:
                    row["payload"] = _payload(row, b"".join(parts).partition(BREAK)[2][: row["length"]])
        else:
            while BREAK not in head and len(head) < size - at:
                head += _more(f.read(PEEK))
            start = head.find(BREAK) + len(BREAK)
            if start < len(BREAK):
                if head.strip():
                    _more(b"")
                return
            row = parse_headers(head[: start - len(BREAK)].lstrip())
            wanted = all(_matches(row, t) for t in tests)
            if wanted and payload:
                f.seek(at + start)
                block = f.read(row["length"])
                if len(block) < row["length"]:
                    _more(b"")
                row["payload"] = _payload(row, block)
            at += start + row["length"] + len(BREAK)
        if wanted:
            del row["length"]
            yield row


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        flag = lambda k, default: self.options.get(k, default).lower() == "true"
        return WarcReader(self.options["path"], flag("payload", "true"), flag("verify", "false"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of each page.

    Only pages whose payload surely or maybe occurs again are moved: a filter over repeated payloads keeps the others
    where they are. Payloads are compared by SHA-256 and length. The digest is made when records are written.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("key", F.concat_ws(":", F.sha2("payload", 256), "payload_bytes"))
    same = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = written(same.where("group_size > 1"), "payloads")
    flagged = marked(rows, repeated, repeated.count(), "key", "maybe")
    found = looked_up(flagged.where("maybe").drop("maybe"), repeated, "key", pages.count())
    single = flagged.where("not maybe").drop("maybe").withColumn("response_id", F.lit(None).cast("long"))
    every = single.unionByName(found.drop("group_size"))
    revisit = F.coalesce(F.col("response_id") != F.col("page_id"), F.col("response_id").isNotNull() & F.col("page_id").isNull())
    return every.select(
        "page_id", "url", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), "payload_bytes", F.lit("").alias("payload_digest"),
        F.when(revisit, F.col("response_id")).alias("refers_to"), "payload",
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    pages.sparkSession.dataSource.register(WarcDataSource)
    plan_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)
