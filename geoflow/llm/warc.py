"""WARC archives as a PySpark data source, with revisits for equal payloads.

Writing: each task writes files ``part-*.warc.gz`` (or ``.warc``) of about ``file_bytes``.
A gzip member holds one record and states its length in an ``sl`` extra field, so a reader
can pass over it without inflating it. The commit writes ``_manifest.json`` with the files
of successful tasks and places in them at which a reader can begin, about ``split_bytes``
apart; files of failed attempts are in no manifest and are never read.

Reading: partitions are the stretches that the manifest plans (whole files where there is
none). Predicates on record type and header columns are pushed down. A record's headers
are parsed first; if they fail a predicate, or payloads aren't asked for, its payload is
neither inflated nor decoded, but passed over. ``verify`` recomputes the digest of every
payload that is stored.

Paths can be of any store that ``pyarrow.fs`` opens (``file:``, ``hdfs:``, ``s3:``, ``gs:``).

``classify`` marks rows: of rows with equal payloads of at least ``least`` bytes, those with
the smallest id are ``response``, the others are ``revisit`` and refer to that id; rows with
smaller payloads are all ``response``. Payloads are equal if their SHA-256 and length are.
Null payloads are empty; a null id is never the smallest, and if a payload has only null ids
all its rows are ``response``. Repeated rows with the smallest id are all ``response``.
An empty table makes an archive without files. Null or odd URLs are percent-encoded or left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

#: Names and sizes of the files that count, and beside each file the places (int64) where a reader may start.
MANIFEST, STARTS = "_manifest.json", ".starts"
DATE = "1970-01-01T00:00:00Z"

#: One record as a row. ``payload_bytes`` and ``payload_digest`` are those of the full payload, for revisits too.
SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload", T.BinaryType()),
])

#: Columns that are headers, hence known before a payload is looked at.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
           "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_LENGTH = "x-payload-length"
_MEMBER = struct.Struct("<2sBBIBB")
_BLOCK = 1 << 16


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- classify

def classify(pages: DataFrame, id_col: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with ``_first``: the id that holds the payload, null for rows that are no revisit.

    Only payloads that occur more than once are in the table that is joined; hot payloads
    are summed before they are shuffled, and the join may split them.
    """
    size = F.octet_length(F.coalesce(F.col(payload), F.lit("")))
    keyed = pages.withColumn("_key", F.when(size >= least, F.concat(F.unhex(F.sha2(F.coalesce(F.col(payload), F.lit("")), 256)), F.unhex(F.lpad(F.hex(size), 16, "0")))))
    first = (keyed.where("_key is not null").groupBy("_key").agg(F.min(id_col).alias("_least"), F.count("*").alias("_n"))
             .where((F.col("_n") > 1) & F.col("_least").isNotNull()).select("_key", "_least"))
    is_first = F.col("_least").isNull() | F.coalesce(F.col(id_col) == F.col("_least"), F.lit(False))
    return keyed.join(first, "_key", "left").withColumn("_first", F.when(~is_first, F.col("_least"))).drop("_key", "_least")


def page_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Rows for the archive: ``record_id, target_uri, refers_to, payload``."""
    def name(x: Column) -> Column:
        return F.concat(F.lit("urn:page:"), F.coalesce(x.cast("string"), F.lit("")))

    rows = classify(pages.select(F.col(id_col), F.col(url), F.col(payload)), id_col, payload, least)
    return rows.select(name(F.col(id_col)).alias("record_id"), F.col(url).cast("string").alias("target_uri"),
                       F.when(F.col("_first").isNotNull(), name(F.col("_first"))).alias("refers_to"),
                       F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))


# ---------------------------------------------------------------- records

def _uri(value: str) -> str:
    return urllib.parse.quote(value, safe="!#$%&'()*+,/:;=?@[]~-._")


def record(record_id: str, target_uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One record: a response with its payload, or a revisit without."""
    http = b"" if refers_to is not None else (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http + (b"" if refers_to is not None else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_uri(record_id)}>",
             f"WARC-Date: {DATE}"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {_uri(target_uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_uri(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member that states its own length, so that it can be passed over."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total if total < 1 << 32 else 0, len(data) & 0xFFFFFFFF)
    return (_MEMBER.pack(b"\x1f\x8b", 8, 4, 0, 0, 255) + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def parse_headers(text: bytes) -> dict[str, str]:
    """Header fields by lower-case name; angle brackets around ids and the digest's label are taken off."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", text).decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    for name in ("warc-record-id", "warc-refers-to", "warc-target-uri"):
        if name in fields:
            fields[name] = fields[name].removeprefix("<").removesuffix(">")
    if "warc-payload-digest" in fields:
        fields["warc-payload-digest"] = fields["warc-payload-digest"].removeprefix("sha1:")
    return fields


class _Bytes:
    """Forward reading with passing over, on a file that can seek."""

    def __init__(self, file, start: int):
        self.file, self.at, self.held = file, start, b""
        file.seek(start)

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            more = self.file.read(max(_BLOCK * 4, n - len(self.held)))
            if not more:
                break
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def unread(self, data: bytes) -> None:
        self.held = data + self.held
        self.at -= len(data)

    def seek(self, to: int) -> None:
        if 0 <= to - self.at <= len(self.held):
            self.held = self.held[to - self.at:]
        else:
            self.held = b""
            self.file.seek(to)
        self.at = to


class _Plain:
    """The records of an uncompressed file: headers, then the block or a jump over it."""

    def __init__(self, source: _Bytes):
        self.source = source

    def records(self, stop: int, wants) -> Iterator[tuple[dict[str, str], bytes | None]]:
        source = self.source
        while source.at < stop:
            head = b""
            while (end := head.find(b"\r\n\r\n")) < 0:
                more = source.read(2048)
                if not more:
                    if head.strip():
                        raise ValueError("the file ends inside a record's headers")
                    return
                head = (head + more).lstrip(b"\r\n")
            source.unread(head[end + 4:])
            fields = parse_headers(head[:end])
            length, begin = int(fields["content-length"]), source.at
            block = source.read(length) if wants(fields) else None
            if block is not None and len(block) < length:
                raise ValueError("the file ends inside a record's block")
            source.seek(begin + length + 4)
            yield fields, block


class _Gzip:
    """The records of a file of gzip members, one record each."""

    def __init__(self, source: _Bytes):
        self.source = source

    def records(self, stop: int, wants) -> Iterator[tuple[dict[str, str], bytes | None]]:
        source = self.source
        while source.at < stop:
            begin = source.at
            start = source.read(24)
            if not start:
                return
            total = None
            if start[:4] == b"\x1f\x8b\x08\x04" and len(start) == 24 and start[12:16] == b"sl\x08\x00":
                total = struct.unpack_from("<I", start, 16)[0] or None
            source.unread(start)
            inflate = zlib.decompressobj(31)
            head = b""
            while (end := head.find(b"\r\n\r\n")) < 0:
                data = inflate.unconsumed_tail or source.read(_BLOCK)
                if not data:
                    raise ValueError("the file ends inside a record's headers")
                head += inflate.decompress(data, 2048)
                if inflate.eof and b"\r\n\r\n" not in head:
                    raise ValueError("a record without the end of its headers")
            fields = parse_headers(head[:end])
            length = int(fields["content-length"])
            wanted = wants(fields)
            parts = [head[end + 4:]]
            if wanted or total is None:
                while not inflate.eof:
                    data = inflate.unconsumed_tail or source.read(_BLOCK)
                    if not data:
                        raise ValueError("the file ends inside a record's block")
                    more = inflate.decompress(data, 1 << 20)
                    if wanted:
                        parts.append(more)
            # A member too long for its field states 0 and is read through.
            source.seek(begin + total) if total is not None and not inflate.eof else source.unread(inflate.unused_data)
            if wanted:
                block = b"".join(parts)[:length]
                if len(block) < length:
                    raise ValueError("a record that is shorter than its headers say")
                yield fields, block
            else:
                yield fields, None


def _payload(fields: dict[str, str], block: bytes) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


# ---------------------------------------------------------------- data source

@dataclass
class _Part(InputPartition):
    path: str = ""
    start: int = 0
    stop: int = 0

    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


@dataclass
class _Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for one in filters:
            column = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(one, EqualTo):
                self.tests.append((HEADERS[column], "in", (one.value,)))
            elif column in HEADERS and isinstance(one, In):
                self.tests.append((HEADERS[column], "in", tuple(one.value)))
            elif column in HEADERS and isinstance(one, StringStartsWith):
                self.tests.append((HEADERS[column], "starts", (one.value,)))
            elif column in HEADERS and isinstance(one, IsNotNull):
                self.tests.append((HEADERS[column], "there", ()))
            else:
                yield one

    def passes(self, fields: dict[str, str]) -> bool:
        for name, how, values in self.tests:
            value = fields.get(name)
            if value is None or how == "in" and value not in values or how == "starts" and not value.startswith(values[0]):
                return False
        return True

    def partitions(self) -> list[_Part]:
        store, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        try:
            with store.open_input_stream(f"{path}/{MANIFEST}") as file:
                files = json.loads(file.read())["files"]
        except FileNotFoundError:
            found = store.get_file_info(pafs.FileSelector(path))
            files = [{"name": x.base_name, "size": x.size, "split": x.size} for x in found if re.search(r"\.warc(\.gz)?$", x.base_name)]
        return [_Part(f["name"], a, min(f["size"], a + f["split"])) for f in files for a in range(0, f["size"], max(1, f["split"]))]

    @staticmethod
    def _between(store, name: str, start: int, stop: int) -> tuple[int, int]:
        """The records of a part: from the first noted start in it to the first one behind it. A file without notes is one part."""
        try:
            with store.open_input_stream(f"{name}{STARTS}") as file:
                starts = np.frombuffer(file.read(), "<i8")
        except FileNotFoundError:
            return start, stop
        first, end = np.searchsorted(starts, (start, stop))
        return (int(starts[first]) if first < len(starts) else stop), (int(starts[end]) if end < len(starts) else 1 << 62)

    def read(self, partition: _Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        schema = to_arrow_schema(SCHEMA)
        store, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        rows, held = [], 0

        def wants(fields: dict[str, str]) -> bool:
            return (self.payload or self.verify or _LENGTH not in fields) and fields.get("warc-type") != "revisit" and self.passes(fields)

        start, stop = self._between(store, f"{path}/{partition.path}", partition.start, partition.stop)
        if start >= partition.stop:
            return
        with store.open_input_file(f"{path}/{partition.path}") as file:
            source = _Bytes(file, start)
            kind = _Gzip(source) if partition.path.endswith(".gz") else _Plain(source)
            for fields, block in kind.records(min(stop, file.size()), wants):
                if not self.passes(fields):
                    continue
                payload = None if block is None else _payload(fields, block)
                named = fields.get("warc-payload-digest")
                if self.verify and payload is not None and named is not None and digest(payload) != named:
                    raise ValueError(f"payload of {fields.get('warc-record-id')} does not have the digest it states")
                size = int(fields[_LENGTH]) if _LENGTH in fields else None if payload is None else len(payload)
                row = {c: fields.get(h) for c, h in HEADERS.items()}
                row |= {"payload_bytes": size, "payload": payload if self.payload else None}
                rows.append(row)
                held += len(row["payload"] or b"") + 200
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.gzip = options.get("compression", "gzip") != "none"
        self.file_bytes = int(options.get("file_bytes", 1 << 28))
        self.split_bytes = int(options.get("split_bytes", 1 << 24))

    def _store(self):
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, path = self._store()
        store.create_dir(path, recursive=True)
        files, out, size, starts = [], None, 0, []

        def close() -> None:
            out.close()
            files[-1]["size"] = size
            with store.open_output_stream(f"{path}/{files[-1]['name']}{STARTS}", compression=None) as notes:
                notes.write(np.array(starts, "<i8").tobytes())

        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        close()
                    name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}"
                    out, size, starts = store.open_output_stream(f"{path}/{name}", compression=None), 0, [0]
                    files.append({"name": name, "size": 0, "split": self.split_bytes})
                if size - starts[-1] >= self.split_bytes:
                    starts.append(size)
                data = record(row["record_id"], row["target_uri"], row["refers_to"], row["payload"] or b"")
                data = member(data) if self.gzip else data
                out.write(data)
                size += len(data)
        if out is not None:
            close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, path = self._store()
        store.create_dir(path, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{path}/{MANIFEST}") as file:
            file.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list) -> None:
        store, path = self._store()
        for one in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{path}/{one['name']}")
            store.delete_file(f"{path}/{one['name']}{STARTS}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with predicates handed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archives(records: DataFrame, path: str, **options) -> None:
    """Write rows of ``page_records`` to a new folder."""
    register(records.sparkSession)
    records.write.format("warc").options(path=path, **options).mode("append").save()


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of ``SCHEMA``. Options: ``payload`` (true), ``verify`` (false)."""
    register(spark)
    return spark.read.format("warc").options(path=path, **options).load()
