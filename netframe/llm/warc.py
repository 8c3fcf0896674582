"""Operator 5: WARC archives as a PySpark Python data source.

Reading: whole files are planned into partitions of about `partition_bytes`; a record's header
block is parsed first, and only if the record passes the pushed predicates (record type and
the other header columns) and payloads are wanted is its block read.  In a plain file an
unwanted block is skipped by a seek over Content-Length bytes.  A gzip file (the default) has one member for
each record; ours say their own length in the member's extra field "sl", so that of an unwanted record
only the header's first bytes are inflated and the rest is skipped by a seek.  Members without it are
inflated through, but what is unwanted is neither kept nor decoded.

Writing: each task writes files of about `file_bytes` below a folder of this write in _temporary; the driver
renames those of the attempts that count, COMMITTERS at a time, so a repeated task leaves nothing behind and
two writes to one folder leave each other alone.  Files are opened through pyarrow's file systems.
An archive from elsewhere is read by one task, whatever its size.

Rows: record_id, record_type, target_uri, refers_to, payload_digest (strings), payload_bytes long,
payload binary.  A response's block is an HTTP message, whose body is the payload; a revisit
has no payload and says the length and digest of what it stands for in its header.  Bytes and
digest come from the header where it has them.

Cases: an empty payload is stored as such; a null URI is written as about:blank; line ends and other
control characters of a URI are percent-encoded; a folder without archives has no rows; a very long payload
is held in memory once by its task; repeated rows become records of one id and are all responses;
extra columns of pages, whatever their names, are not read; an empty table writes no archive.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema([*((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_HEADER_COLUMNS = {"record_id", "record_type", "target_uri", "refers_to", "payload_digest"}
SHORTEST_REVISIT = 100


def _encode(r: dict, date: str) -> bytes:
    payload = r["payload"] or b""
    uri = quote(r["target_uri"] or "about:blank", safe="".join(map(chr, range(33, 127))))
    head = [
        "WARC/1.1",
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: <{r['record_id']}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
    ]
    if r["record_type"] == "revisit":
        head += [f"WARC-Refers-To: <{r['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head += ["Content-Type: application/http; msgtype=response", f"X-Payload-Bytes: {r['payload_bytes']}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list = field(default_factory=list)


HEAD_BYTES = 1 << 14
COMMITTERS = 32


def pack_member(data: bytes, level: int = 4) -> bytes:
    """A gzip member with the extra field sl: lengths of the deflated and of the plain data."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, len(body) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri = options["path"].rstrip("/")
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.date = options.get("date", "2000-01-01T00:00:00Z")
        self.overwrite = overwrite
        self.own = f"_temporary/{uuid.uuid4().hex}"

    def write(self, iterator):
        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(f"{root}/{self.own}", recursive=True)
        done, out, size = _Written(), None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                data = _encode({c: batch.column(c)[k].as_py() for c in _ARROW.names}, self.date)
                if self.gzip:
                    data = pack_member(data)
                if out is None:
                    done.files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = store.open_output_stream(f"{root}/{self.own}/{done.files[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return done

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name.endswith((".warc", ".warc.gz")):
                    store.delete_file(old.path)
        names = [name for m in messages if m for name in m.files]
        with ThreadPoolExecutor(COMMITTERS) as pool:
            list(pool.map(lambda name: store.move(f"{root}/{self.own}/{name}", f"{root}/{name}"), names))
        self.abort(messages)

    def abort(self, messages):
        store, root = fs.FileSystem.from_uri(self.uri)
        if store.get_file_info(f"{root}/{self.own}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.own}")
        others = store.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True))
        if not others and store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_temporary")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Inflated(io.RawIOBase):
    """The members of a gzip file one after the other; seek goes forward only."""

    def __init__(self, raw):
        self.raw, self.z, self.rest, self.at = raw, zlib.decompressobj(31), b"", 0

    def readable(self):
        return True

    def readinto(self, b):
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data or self.rest, zlib.decompressobj(31)
            data = self.z.unconsumed_tail or self.rest or self.raw.read(1 << 16)
            self.rest = b""
            if not data:
                return 0
            out = self.z.decompress(data, len(b))
            if out:
                b[: len(out)] = out
                return len(out)


class _Counted:
    """A stream without seek; tell() has no meaning there."""

    def __init__(self, f):
        self.readline, self.read, self.seekable, self.tell = f.readline, f.read, f.seekable, lambda: 0


def _skip(f, n: int) -> None:
    if f.seekable():
        f.seek(n, io.SEEK_CUR)
        return
    while n and (got := f.read(min(n, 1 << 20))):
        n -= len(got)


def _passes(tests: list, row: dict) -> bool:
    for kind, column, value in tests:
        x = row.get(column)
        if kind == "null":
            ok = (x is None) == value
        else:
            ok = x is not None and (x in value if kind == "in" else x.startswith(value) if kind == "starts" else x.endswith(value) if kind == "ends" else value in x)
        if not ok:
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _HEADER_COLUMNS:
                yield f
            elif isinstance(f, EqualTo) and f.value is not None:
                self.tests.append(("in", column, (f.value,)))
            elif isinstance(f, In):
                self.tests.append(("in", column, tuple(f.value)))
            elif isinstance(f, IsNull | IsNotNull):
                self.tests.append(("null", column, isinstance(f, IsNull)))
            elif isinstance(f, StringStartsWith | StringEndsWith | StringContains):
                kind = {StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}[type(f)]
                self.tests.append((kind, column, f.value))
            else:
                yield f

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        found = sorted((f.path, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")))
        out, files, size = [], [], 0
        for path, n in found:
            if files and size + n > self.partition_bytes:
                out.append(_Files(files))
                files, size = [], 0
            files.append(path)
            size += n
        return [*out, _Files(files)]

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.uri)
        rows, size = [], 0
        for path in partition.files:
            raw = store.open_input_file(path)
            for row in self._members(raw) if path.endswith(".gz") else self._records(raw):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
            raw.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def _members(self, raw):
        """Records of a gzip file: by members that say their length, as long as there are such."""
        at, size = 0, raw.size()
        while at < size:
            raw.seek(at)
            head = raw.read(24)
            if len(head) < 24 or head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x0c\0sl\x08\0":
                raw.seek(at)
                yield from self._records(io.BufferedReader(_Inflated(raw), 1 << 16))
                return
            packed, plain = struct.unpack_from("<II", head, 16)
            z = zlib.decompressobj(-15)
            first = raw.read(min(packed, HEAD_BYTES))
            text = z.decompress(first, HEAD_BYTES)
            if b"\r\n\r\n" not in text:  # a long header
                text += z.decompress(z.unconsumed_tail + raw.read(packed - len(first)))
                first = b"\0" * packed
            row, length, kind, start = self._header(io.BytesIO(text))
            if _passes(self.tests, row):
                if row["record_type"] != "revisit" and self.payload:
                    if len(text) < plain:
                        text += z.decompress(z.unconsumed_tail + raw.read(packed - len(first)))
                    row["payload"] = self._payload(text[start : start + length], kind)
                yield row
            at += 24 + packed + 8

    @staticmethod
    def _payload(block: bytes, kind: str) -> bytes:
        return block.partition(b"\r\n\r\n")[2] if kind.startswith("application/http") else block

    def _header(self, f):
        """(row without payload, bytes of the block, its content type, where it begins), or None at the end."""
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        strip = lambda x: x[1:-1] if x and x[0] == "<" else x
        row = {
            "record_id": strip(head.get("warc-record-id")),
            "record_type": head.get("warc-type"),
            "target_uri": head.get("warc-target-uri"),
            "refers_to": strip(head.get("warc-refers-to")),
            "payload_digest": (head.get("warc-payload-digest") or "").rpartition(":")[2] or None,
            "payload_bytes": int(head["x-payload-bytes"]) if head.get("x-payload-bytes", "").isdigit() else None,
            "payload": None,
        }
        return row, int(head.get("content-length", 0)), head.get("content-type", ""), f.tell()

    def _records(self, f):
        """Records of plain data, one after the other."""
        f = f if isinstance(f, io.BufferedReader) else io.BufferedReader(f, 1 << 16)
        f = f if f.seekable() else _Counted(f)
        while (got := self._header(f)) is not None:
            row, length, kind, _ = got
            if not _passes(self.tests, row):
                _skip(f, length)
                continue
            if row["record_type"] == "revisit" or not self.payload:
                _skip(f, length)
            else:
                row["payload"] = self._payload(f.read(length), kind)
            yield row


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shortest: int = SHORTEST_REVISIT) -> DataFrame:
    """Rows for format("warc") from a table of pages.

    Of equal payloads of `shortest` bytes or more the page with the smallest id is the response, the
    others are revisits; a page without an id is a response unless another one has its payload.
    """
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    key = page.where(F.col("payload_bytes") >= shortest)
    first = key.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("payload_digest", "first")
    joined = page.join(first, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return joined.select(
        F.coalesce(name(F.col("id")), F.concat(F.lit("urn:sha256:"), F.col("payload_digest"))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, name(F.col("first"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, uri: str, **options) -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").options(**options).save(uri)


def read_warc(spark: SparkSession, uri: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(uri)
