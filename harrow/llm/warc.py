"""WARC archives as a PySpark Python data source.

Writing gives each task one archive, a gzip member for each record. A member's extra field "sl" holds its compressed
and plain length, so a reader can go on to the next record without inflating this one. A task's file counts once
the driver's commit lists it in _records.json, so files of failed or repeated attempts are never read. The list has a
place to start at for every PART_BYTES of a file too.

Reading plans partitions of about PART_BYTES: several small files, or a stretch of a large one. Equality and IN predicates on
record_type and on header columns are taken over; a record's headers are inflated first, and its payload only if the
record passes and the schema asks for the payload or ``verify`` asks for its digest. Archives of other writers are
one partition a file; those of gzip members without "sl" are inflated piece by piece to find where a member ends,
and what is not wanted is thrown away as it comes.

Paths are URIs that pyarrow.fs knows (file, hdfs, s3 and so on); the folder must be shared by all executors.

Defined cases: null html is an empty payload; a null id is an empty record id, and null again when read; line breaks
in a URL are percent-encoded; of equal payloads (equal SHA-1 and length) the least id is the response, all rows of that id
are, and payloads of null ids alone are all responses; other columns are dropped. An empty table gives an empty archive. The payload
of an HTTP record is what follows the HTTP header, that of any other record its whole block, and a revisit has none. An archive
that ends within a record loses that record, or fails under ``verify``.
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
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from harrow.llm._storage import Scratch

MANIFEST = "_records.json"
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary"
#: Header of each column that a predicate can be pushed to.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
DATE, PROFILE = "1970-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PART_BYTES, BATCH, BATCH_BYTES, CHUNK = 128 << 20, 512, 32 << 20, 1 << 16
LEVEL = 1


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field tells its length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(record_id: str, kind: str, uri: str, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(uri, safe=SAFE)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to or ''}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Characters of a URL that stay as they are.
SAFE = "%/:=&?~#+!$,;'@()*[]|"


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    starts: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = path, schema.names, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name, starts, at = f"part-{uuid.uuid4().hex}.warc.gz", [0], 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for r in batch.to_pylist():
                    payload = (r["payload"] or b"") if r["record_type"] == "response" else b""
                    made = member(record_bytes(r["record_id"] or "", r["record_type"], r["target_uri"] or "", r["payload_digest"], payload, r["payload_length"], r["refers_to"]))
                    if at - starts[-1] >= PART_BYTES:
                        starts.append(at)
                    out.write(made)
                    at += len(made)
        return Written(name, at, starts)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        old = [] if self.overwrite else listed(self.path)
        files = old + [[m.name, m.size, m.starts] for m in messages if m is not None]
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


def listed(path: str) -> list[list]:
    """[name, size, starts] of the archives in a folder: those of the manifest, or all .warc and .warc.gz files without one."""
    fs, root = _open(path)
    try:
        with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted([x.base_name, x.size, [0]] for x in found if x.base_name.endswith((".warc", ".warc.gz")))


@dataclass
class Files(InputPartition):
    #: Name, first byte and the byte to end before.
    stretches: list[tuple[str, int, int]]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, verify: bool):
        self.path, self.schema, self.verify, self.wanted = path, schema, verify, {}

    def pushFilters(self, filters: list):  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in HEADERS and all(isinstance(v, str) for v in values):
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        parts, some, total = [], [], 0
        for name, size, starts in listed(self.path):
            for start, end in zip(starts, [*starts[1:], size], strict=True):
                if some and total + end - start > PART_BYTES:
                    parts.append(Files(some))
                    some, total = [], 0
                some.append((name, start, end))
                total += end - start
        return [*parts, Files(some)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.path)
        arrow = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        types = pa.schema([(f.name, arrow[f.dataType.simpleString()]) for f in self.schema])
        full = self.verify or "payload" in types.names
        rows: list[dict] = []
        held = 0
        for name, start, end in partition.stretches:
            with fs.open_input_file(f"{root}/{name}") as f:
                for row in records(f, self.wanted, full, self.verify, start, end):
                    rows.append({k: row.get(k) for k in types.names})
                    held += len(rows[-1].get("payload") or b"")
                    if len(rows) >= BATCH or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, types)


class Record:
    """A record whose plain bytes come into ``data`` as they are asked for."""

    def __init__(self, f, start: int, end: int):
        self.f, self.start, self.data = f, start, b""
        f.seek(start)
        head = f.read(24)
        self.inflate, self.size = None, None
        if head[:2] == b"\x1f\x8b":
            self.inflate = zlib.decompressobj(31)
            if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
                self.size = struct.unpack("<I", head[16:20])[0]
                if start + self.size > end:
                    raise EOFError
        f.seek(start)
        self.next = 2048

    def more(self) -> bool:
        """Take in another stretch; False at the record's or the file's end."""
        if self.inflate is not None and self.inflate.eof:
            return False
        room = self.next if self.size is None else min(self.next, self.start + self.size - self.f.tell())
        got = self.f.read(room)
        self.next = CHUNK
        self.data += self.inflate.decompress(got) if self.inflate is not None else got
        return bool(got)

    def after(self, mark: bytes, at: int = 0) -> int:
        """The place after the first ``mark`` from ``at`` on."""
        while (k := self.data.find(mark, at)) < 0:
            if not self.more():
                raise EOFError
        return k + len(mark)

    def upto(self, size: int) -> None:
        parts = [self.data]
        have = len(self.data)
        while have < size:
            self.data = b""
            if not self.more():
                raise EOFError
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)

    def end(self, plain: int) -> int:
        """Where the next record starts; ``plain`` is this one's length as it stands in a file that is not compressed."""
        if self.inflate is None:
            return self.start + plain
        if self.size is not None:
            return self.start + self.size
        while not self.inflate.eof:
            self.data = b""
            if not self.more():
                raise EOFError
        return self.f.tell() - len(self.inflate.unused_data)


def records(f, wanted: dict[str, set], full: bool, verify: bool, start: int = 0, end: int | None = None) -> Iterator[dict]:
    """The records of a stretch of an archive that pass, with their payload if ``full``."""
    end = f.size() if end is None else end
    while start < end:
        try:
            record = Record(f, start, end)
            at = record.after(b"\r\n\r\n")
            fields = header(record.data[:at])
            length = int(fields.get("content-length") or 0)
            made = row(fields, record, at, length, full, verify) if keep(fields, wanted) else None
            start = record.end(at + length + 4)
        except (EOFError, zlib.error) as error:
            if verify:
                raise ValueError(f"the archive breaks off in the record at byte {start}") from error
            return
        if made is not None:
            yield made


def header(data: bytes) -> dict[str, str]:
    lines = data[: data.index(b"\r\n\r\n")].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def value(fields: dict[str, str], column: str) -> str | None:
    got = fields.get(HEADERS[column])
    if got is not None and column in ("record_id", "refers_to"):
        got = got.strip("<>")
    return got.removeprefix("sha1:") if got and column == "payload_digest" else got or None


def keep(fields: dict[str, str], wanted: dict[str, set]) -> bool:
    return all(value(fields, column) in values for column, values in wanted.items())


def row(fields: dict[str, str], record: Record, at: int, length: int, full: bool, verify: bool) -> dict:
    """The columns of a record whose block of ``length`` bytes starts at ``at``."""
    out = {column: value(fields, column) for column in HEADERS}
    http = fields.get("content-type", "").lower().startswith("application/http") or out["record_type"] == "response"
    if full:
        record.upto(at + length)
    begin, told = at, None
    if http:
        try:
            begin = min(record.after(b"\r\n\r\n", at), at + length)
            told = header(record.data[at:begin]).get("content-length")
        except (EOFError, ValueError):
            begin = at + length  # a header alone, without the empty line
    revisit = out["record_type"] == "revisit"
    out["payload_length"] = int(told) if revisit and told and told.isdigit() else at + length - begin
    payload = record.data[begin : at + length] if full and not revisit else None
    out["payload"] = payload
    if verify and out["record_type"] == "response":
        got = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if got != (out["payload_digest"] or got) or (told or str(len(payload))) != str(len(payload)):
            raise ValueError(f"record {out['record_id']}: the payload has digest {got} and {len(payload)} bytes")
    return out


class WarcDataSource(DataSource):
    """format("warc"): options path and verify (true: check payloads of responses against their digest)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, self.options.get("verify", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def to_records(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows of SCHEMA for pages: of equal payloads of at least ``min_bytes`` the least id is a response, the others revisits."""
    scratch = Scratch(pages.sparkSession, "warc-first")
    text = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), F.encode(text, "UTF-8").alias("payload"))
    base = base.withColumns({"_sha": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    first = scratch.write(base.filter(F.col("payload_length") >= min_bytes).groupBy("_sha", "payload_length").agg(F.min("_id").alias("_first")), "first")
    joined = base.join(first, ["_sha", "payload_length"], "left")
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        name("_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.coalesce("_url", F.lit("")).alias("target_uri"), F.lit(DATE).alias("date"),
        base32(F.col("_sha")).alias("payload_digest"), "payload_length", F.when(again, name("_first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def base32(hex_: Column) -> Column:
    """Base32 of a SHA-1 in hex: 40 bits, or ten hex digits, are eight letters."""
    letters = F.array(*map(F.lit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
    groups = [F.conv(F.substring(hex_, 10 * i + 1, 10), 16, 10).cast("long") for i in range(4)]
    return F.concat(*[F.get(letters, F.shiftright(g, 35 - 5 * k).bitwiseAND(31).cast("int")) for g in groups for k in range(8)])


def page_number(urn: str) -> Column:
    return F.expr(f"try_cast(nullif(substring({urn}, 10), '') AS bigint)")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back with their payloads checked, and return a row for each page."""
    spark = pages.sparkSession
    register(spark)
    scratch = Scratch(spark, "warc")
    to_records(pages, min_bytes).write.format("warc").mode("overwrite").save(scratch.path("archive"))
    back = spark.read.format("warc").schema(", ".join(x for x in SCHEMA.split(", ") if not x.startswith("payload binary"))).option("verify", "true").load(scratch.path("archive"))
    return back.select(page_number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page_number("refers_to").alias("refers_to"))
