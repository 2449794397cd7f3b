"""WARC archives as a Spark data source, and a deduplicating archive of pages.

Each record is a gzip member of its own whose ``sl`` extra field (skip lengths,
as the WARC guidelines give them) tells the member's size.  The reader
plans partitions of whole files, decodes only the head of each record, tests
the pushed predicates on it, and seeks past the members it doesn't want.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from lodegraph.llm.scratch import new_path, written

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Header of each column that a predicate can be pushed down for.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
MANIFEST = "_MANIFEST.json"
_HEAD = 1 << 12


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:", path) else (pyarrow.fs.LocalFileSystem(), path)


def _line(value: str) -> str:
    """A header value: control characters would end the line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that tells its own compressed and uncompressed size."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if row["record_type"] == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_line(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_line(row['refers_to'])}>"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_length']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict:
    """Columns of a record's header lines, without the payload."""
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    out = {c: found.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        out[c] = out[c] and out[c].strip("<>")
    out["payload_digest"] = out["payload_digest"] and out["payload_digest"].partition(":")[2]
    out["payload_length"] = int(out["payload_length"]) if out["payload_length"] else None
    return out | {"content_length": int(found["content-length"])}


def read_members(f, want=lambda head: True, payload: bool = True) -> Iterator[dict]:  # noqa: ANN001
    """Records of an open archive whose head ``want`` accepts; ValueError where it is damaged."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        start = f.read(24)
        if start[:4] != b"\x1f\x8b\x08\x04" or start[12:14] != b"sl":
            raise ValueError(f"no record with skip lengths at {at}")
        length, whole = struct.unpack_from("<II", start, 16)
        if at + length > size:
            raise ValueError("cut off")
        inflate = zlib.decompressobj(-15)
        raw = f.read(min(_HEAD, length - 32))
        text = inflate.decompress(raw, 1 << 14)
        while (end := text.find(b"\r\n\r\n")) < 0:
            raw = inflate.unconsumed_tail or f.read(min(_HEAD, at + length - 8 - f.tell()))
            if not raw:
                raise ValueError("no end of the header")
            text += inflate.decompress(raw, 1 << 14)
        head = parse_head(text[:end])
        if want(head):
            if payload:
                text += inflate.decompress(inflate.unconsumed_tail + f.read(at + length - 8 - f.tell())) + inflate.flush()
                crc, _ = struct.unpack("<II", f.read(8))
                if zlib.crc32(text) != crc or len(text) != whole:
                    raise ValueError(f"checksum of the record at {at}")
                block = text[end + 4 : end + 4 + head["content_length"]]
                head["payload"] = block[block.index(b"\r\n\r\n") + 4 :] if head["record_type"] == "response" else None
            else:
                head["payload"] = None
            yield head
        at += length


@dataclass
class _Files(InputPartition):
    paths: list


@dataclass
class _Written(WriterCommitMessage):
    names: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.bytes = int(options.get("partition_bytes", 64 << 20))
        self.equal: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):  # noqa: ANN001, ANN201, N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In)):
                self.equal.append((column, (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            elif not (column == "record_type" and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[_Files]:
        fs, path = _filesystem(self.path)
        with fs.open_input_file(f"{path}/{MANIFEST}") as f:
            names = json.loads(f.read())
        sizes = {i.base_name: i.size for i in fs.get_file_info([f"{path}/{n}" for n in names])} if names else {}
        out, room = [], 0
        for name in names:
            if not out or room + sizes[name] > self.bytes:
                out.append(_Files([]))
                room = 0
            out[-1].paths.append(name)
            room += sizes[name]
        return out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(self.path)
        want = lambda head: all(head[c] in values for c, values in self.equal)
        rows, held = [], 0
        for name in partition.paths:
            with fs.open_input_file(f"{path}/{name}") as f:
                for row in read_members(f, want, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if held > 4 << 20 or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
        yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"payload": pa.binary(), "payload_length": pa.int64()}
    return pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in (*HEADERS, "payload")})


class _Writer(DataSourceArrowWriter):
    """Each task writes files of its own; only those of committed tasks get into the manifest."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.bytes, self.level = int(options.get("file_bytes", 32 << 20)), int(options.get("level", 6))
        self.date = options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, path = _filesystem(self.path)
        fs.create_dir(path)
        names, out = [], None
        for batch in iterator:
            for i in range(len(batch)):
                if out is None or out.tell() > self.bytes:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(f"{path}/{names[-1]}", compression=None)
                out.write(member(record({c: batch.column(c)[i].as_py() for c in (*HEADERS, "payload")}, self.date), self.level))
        if out:
            out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        fs, path = _filesystem(self.path)
        fs.create_dir(path)
        names = [n for m in messages if m for n in m.names]
        if not self.overwrite and fs.get_file_info(f"{path}/{MANIFEST}").type == pyarrow.fs.FileType.File:
            with fs.open_input_file(f"{path}/{MANIFEST}") as f:
                names = json.loads(f.read()) + names
        with fs.open_output_stream(f"{path}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        fs, path = _filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    """``format("warc")``; options: payload (false: heads only), partition_bytes, file_bytes, level, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``pages(page_id, url, html)`` -> records to write.

    Of equal payloads of ``least_bytes`` or more, the row with the least
    page_id is the response and the others revisit it.  A null html counts as
    empty.  Rows that repeat that page_id are responses too; a null page_id
    revisits if there is another row to revisit.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.sha2(html, 256).alias("payload_digest"), F.length(html).cast("long").alias("payload_length"), html.alias("payload"))
    # Who revisits whom is found from ids and digests alone; payloads meet it by page, so that copies of one page don't meet in one task.
    slim = written(rows.where(f"payload_length >= {int(least_bytes)}").select("page_id", "payload_digest"), "digests")
    first = slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    revisits = slim.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct().withColumnsRenamed({"page_id": "_id", "payload_digest": "_digest"})
    joined = rows.join(written(revisits, "revisits"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    again = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return joined.select(F.when(again, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), "target_uri", F.when(again, name(F.col("first"))).alias("refers_to"), "payload_digest", "payload_length", F.when(~again, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Writes the pages as WARC files to ``path`` (a new folder among the shared ones) and returns it."""
    spark = pages.sparkSession
    register(spark)
    path = path or new_path(spark, "warc")
    records(pages).write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def report(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; of responses from the payload read, of revisits from their headers."""
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    return read(spark, path).select(
        number("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
