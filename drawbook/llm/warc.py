"""A Spark data source for WARC archives, written and read in Python.

Writing: each task writes its own files; a manifest names the files of the tasks that ended well, so that files of lost
attempts are never read. Reading: one partition per file; the record header is parsed first, predicates on record type
and headers are decided on it, and the block of an unwanted record is skipped by seeking. Files are opened through the
file system that the path's scheme names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, IsNull, WriterCommitMessage)

from drawbook.session import new_path, write_table

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, "
          "headers map<string,string>, http_headers map<string,string>, payload binary")
HEADER_COLUMNS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
                  "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
MANIFEST = "_manifest.json"
FILE_BYTES = 256 << 20
ARROW = pa.schema([(c, pa.string()) for c in HEADER_COLUMNS] + [("headers", pa.map_(pa.string(), pa.string())),
                                                               ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def one_line(value: str) -> str:
    """Header values are one line: line breaks become percent escapes."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def header_bytes(first: str, fields: list[tuple[str, str]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {one_line(v)}\r\n" for k, v in fields), "\r\n"]).encode()


def record_bytes(row: dict) -> bytes:
    """One record from record_type, record_id, target_uri, warc_date, payload_digest, refers_to and payload.

    A response holds an HTTP header and the payload; a revisit holds the HTTP header alone, whose Content-Length is still
    that of the whole payload.
    """
    payload = row["payload"] or b""
    http = header_bytes("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(row.get("payload_bytes") or len(payload)))])
    fields = [(name, row[column]) for column, name in HEADER_COLUMNS.items() if row.get(column) is not None]
    block = http + (payload if row["record_type"] == "response" else b"")
    return header_bytes("WARC/1.1", [*fields, ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        attempt, files, out = uuid.uuid4().hex, [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= self.file_bytes:
                        if out is not None:
                            files[-1] = (files[-1][0], out.tell())
                            out.close()
                        files.append((f"{attempt}-{len(files):04d}.warc", 0))
                        out = system.open_output_stream(f"{folder}/{files[-1][0]}")
                    out.write(record_bytes(row))
        finally:
            if out is not None:
                files[-1] = (files[-1][0], out.tell())
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        manifest = f"{folder}/{MANIFEST}"
        before = []
        if system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as f:
                before = json.loads(f.read())
        with system.open_output_stream(manifest) as f:
            f.write(json.dumps(before + [x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = opened(self.path)
        for name, _ in (x for m in messages if m for x in m.files):
            system.delete_file(f"{folder}/{name}")


@dataclass
class FilePartition(InputPartition):
    name: str
    size: int


def parse_fields(lines: bytes) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")) if k}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool):
        self.path, self.with_payload = path, with_payload
        self.wanted: list[tuple[str, tuple | None, bool]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes equality, IN and null tests on header columns and on entries of ``headers``; leaves the others to Spark."""
        for f in filters:
            name = None
            if isinstance(f, (EqualTo, In, IsNull, IsNotNull)):
                if len(f.attribute) == 1:
                    name = HEADER_COLUMNS.get(f.attribute[0])
                elif len(f.attribute) == 2 and f.attribute[0] == "headers":
                    name = f.attribute[1]
            if name is None:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((name, (f.value,), True))
            elif isinstance(f, In):
                self.wanted.append((name, tuple(f.value), True))
            else:
                self.wanted.append((name, None, isinstance(f, IsNotNull)))

    def partitions(self) -> list[InputPartition]:
        system, folder = opened(self.path)
        with system.open_input_stream(f"{folder}/{MANIFEST}") as f:
            return [FilePartition(name, size) for name, size in json.loads(f.read())]

    def keeps(self, fields: dict[str, str]) -> bool:
        return all((fields.get(name) in values) if values is not None else ((name in fields) == there) for name, values, there in self.wanted)

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, folder = opened(self.path)
        rows, held = [], 0
        with system.open_input_file(f"{folder}/{partition.name}") as f:
            at, buffer, base = 0, b"", 0
            while at < partition.size:
                # The header is looked for in a window that grows only while its end isn't found.
                span = 4096
                while True:
                    if not base <= at < base + len(buffer) or (end := buffer.find(b"\r\n\r\n", at - base)) < 0:
                        buffer, base = f.read_at(min(span, partition.size - at), at), at
                        end = buffer.find(b"\r\n\r\n")
                    if end >= 0:
                        break
                    if at + span >= partition.size:
                        raise ValueError(f"{partition.name}: a record header at byte {at} does not end")
                    span *= 4
                version, _, lines = buffer[at - base: end].partition(b"\r\n")
                if not version.startswith(b"WARC/"):
                    raise ValueError(f"{partition.name}: no record at byte {at}")
                fields, body = parse_fields(lines), base + end + 4
                length = int(fields["Content-Length"])
                at = body + length + 4
                if not self.keeps(fields):
                    continue
                http, payload = {}, None
                if self.with_payload or fields.get("WARC-Type") == "revisit":
                    block = f.read_at(length, body)
                    head, _, rest = block.partition(b"\r\n\r\n")
                    http = parse_fields(head.partition(b"\r\n")[2])
                    payload = rest if self.with_payload and fields.get("WARC-Type") != "revisit" else None
                rows.append([fields.get(n) for n in HEADER_COLUMNS.values()] + [list(fields.items()), list(http.items()), payload])
                held += len(payload or b"") + 1000
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class WarcDataSource(DataSource):
    """``format("warc")``. Options: ``path``; ``payload`` (false: blocks of responses are never read); ``fileBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


PAGE_URN = "<urn:page:"


def plan_records(pages: DataFrame, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The record of each page: of equal payloads of at least ``least_bytes``, all but that with the largest id revisit it.

    Null html is an empty payload; a page without an id is always a response. Repeated rows of one id and payload are alike:
    all responses or all revisits. Extra columns are ignored. Only ids and digests are shuffled to find copies; the list of
    revisits is written first, so that its size decides how it is joined to the pages.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    hashed = pages.select("page_id", "url", body.alias("payload")).withColumns({"sha": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    keys = hashed.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha", "payload_bytes")
    shared = keys.groupBy("sha", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n", "payload_bytes")
    revisits, _ = write_table(keys.join(shared, "sha").where("page_id < first_id").select("page_id", "sha", "first_id").distinct(), "revisits")
    urn = lambda c: F.concat(F.lit(PAGE_URN), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("first_id").isNotNull()
    return hashed.join(revisits, ["page_id", "sha"], "left").select(
        urn(F.col("page_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(F.lit("sha1:"), "sha").alias("payload_digest"),
        F.when(again, urn(F.col("first_id"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"), "payload_bytes")


def write_warc(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive. Spark hands predicates to Python sources only where a session allows it, so this turns it on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_pages(pages: DataFrame) -> str:
    """Writes the archive of ``pages`` in the shared folder and returns its path."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(plan_records(pages), path)
    return path


def page_of(urn: str) -> Column:
    return F.expr(f"try_cast(substring({urn}, {len(PAGE_URN) + 1}, length({urn}) - {len(PAGE_URN) + 1}) as bigint)")


def page_records(archive: DataFrame) -> DataFrame:
    """Per record of :func:`archive_pages`: the page, its whole payload's length and digest, and what it revisits.

    A response's figures are computed from the payload that was read; a revisit's come from its headers.
    """
    stored = F.col("payload").isNotNull()
    return archive.select(
        page_of("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.expr("try_cast(http_headers['Content-Length'] as bigint)")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", page_of("refers_to").alias("refers_to"))
