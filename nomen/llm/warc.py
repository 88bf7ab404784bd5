"""WARC archives as a Spark data source, and de-duplicating archives of a page table.

``WarcDataSource`` (format ``warc``) plans whole files into partitions, takes predicates on the record type and
on header columns down to the reader, parses the headers of a record first, and jumps over the payload of a
record that no one wants: each record is a gzip member of its own whose header tells the member's length, so
the rest is not even inflated.  Foreign gzip members and plain records are read as well.

Options: ``path``; ``payload`` (``true``/``false``: leave the payload column null and unread);
``partitionBytes`` (reading: files are packed up to so many bytes); ``fileBytes`` (writing: start a new file
after so many).  A record without a usable ``Content-Length`` is taken to its member's end; in a plain file it ends the read
with an error.  Written files count only if the manifest that the commit writes names them, so those of
failed or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from nomen.llm._shared import materialise, numbered

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, payload binary"
_TYPES = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
_MANIFEST = "_manifest.json"

# Header names of the WARC format, by column (fixed values); the last is an extension of ours
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "payload_length": "x-payload-length"}
_SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_GZIP = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"  # deflate, with an extra field
_EXTRA = struct.Struct("<H2sHQ")  # its size, our mark, the size of its data, the length of the whole member


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _member(record: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    total = len(_GZIP) + _EXTRA.size + len(body) + 8
    return _GZIP + _EXTRA.pack(12, b"WL", 8, total) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _record(row: dict) -> bytes:
    payload = row["payload"] or b""
    headers = ["WARC/1.1"]
    for column, name in (("record_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("date", "WARC-Date"), ("target_uri", "WARC-Target-URI"), ("payload_digest", "WARC-Payload-Digest"), ("refers_to", "WARC-Refers-To")):
        value = row.get(column)
        if value is not None:
            value = value.replace("\r", "%0D").replace("\n", "%0A").strip()
            value = f"<{value}>" if column in ("record_id", "refers_to") else f"sha1:{value}" if column == "payload_digest" else value
            headers.append(f"{name}: {value}")
    if row["record_type"] == "revisit":
        headers.append(f"WARC-Profile: {_SAME_PAYLOAD}")
        payload = b""
    headers += [f"X-Payload-Length: {row['payload_length']}", "Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.level, self.most = int(options.get("level", "1")), int(options.get("filebytes", str(64 << 20)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(posixpath.join(root, name), compression=None)  # members are packed already
                data = _member(_record(row), self.level)
                out.write(data)
                size += len(data)
                if size >= self.most:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        at = posixpath.join(root, _MANIFEST)
        files = [] if self.overwrite else _manifest(fs, root) or []
        files += [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(at) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = filesystem(self.path)
        for name, _ in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(posixpath.join(root, name))


def _manifest(fs: pafs.FileSystem, root: str) -> list[tuple[str, int]] | None:
    if fs.get_file_info(posixpath.join(root, _MANIFEST)).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(posixpath.join(root, _MANIFEST)) as f:
        return [tuple(x) for x in json.loads(f.read())]


@dataclass
class _Files(InputPartition):
    files: list[str]


class _Source:
    """A window on a file: bytes are read in blocks, and jumps over unwanted bytes become seeks."""

    def __init__(self, file: pa.NativeFile, block: int = 1 << 18):
        self.file, self.block, self.data, self.base = file, block, b"", 0

    def peek(self, at: int, n: int) -> bytes:
        if at < self.base or at + n > self.base + len(self.data):
            self.file.seek(at)
            self.data, self.base = self.file.read(max(n, self.block)), at
        return self.data[at - self.base : at - self.base + n]


def _split_headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _number(value: str | None) -> int | None:
    """A length as written in a header; null if it is missing or no number."""
    return int(value) if value is not None and value.isascii() and value.isdigit() else None


class _Inflated:
    """The unpacked bytes of one gzip member, made only as far as they are asked for."""

    def __init__(self, source: _Source, at: int):
        self.source, self.at, self.z, self.data = source, at, zlib.decompressobj(31), b""

    def upto(self, enough) -> bytes:
        while not enough(self.data) and not self.z.eof:
            piece = self.z.unconsumed_tail
            if not piece:
                piece = self.source.peek(self.at, 1 << 14) or b""
                self.at += len(piece)
                if not piece:
                    break
            self.data += self.z.decompress(piece, 1 << 16)
        return self.data

    def end(self) -> int:
        while not self.z.eof:
            before = len(self.data)
            self.upto(lambda d: len(d) > before)
            self.data = b""
            if not self.z.eof and not self.z.unconsumed_tail and not self.source.peek(self.at, 1):
                break
        return self.at - len(self.z.unused_data)


def records(file: pa.NativeFile, wanted, payload: bool) -> Iterator[dict]:
    """The records whose columns (all but the payload) ``wanted`` accepts; only theirs are unpacked as a whole."""
    source, at = _Source(file), 0
    while head := source.peek(at, 10 + _EXTRA.size):
        if head[:2] == b"\x1f\x8b":
            own = head[3] == 4 and len(head) == 10 + _EXTRA.size and (extra := _EXTRA.unpack(head[10:]))[1] == b"WL"
            member = _Inflated(source, at)
            data = member.upto(lambda d: b"\r\n\r\n" in d)
        else:
            member, own, n = None, False, 1 << 12
            while b"\r\n\r\n" not in (data := source.peek(at, n)) and len(data) == n:
                n *= 2
        end = data.find(b"\r\n\r\n")
        if end < 0:
            return
        headers = _split_headers(data[:end])
        row = {c: headers.get(h) for c, h in _HEADERS.items()}
        size = _number(headers.get("content-length"))
        if size is None and member is None:
            raise ValueError(f"a record at byte {at} of a plain file has no length, so that the next one can't be found")
        if size is None:  # a member holds one record: the rest of it, without the line ends that close a record
            size = len(member.upto(lambda d: False).removesuffix(b"\r\n\r\n")) - end - 4
        told = _number(row["payload_length"])
        row["payload_length"] = size if told is None else told
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] is not None else None
        row["payload_digest"] = row["payload_digest"].removeprefix("sha1:") if row["payload_digest"] else None
        row["payload"] = None
        if take := wanted(row):
            if payload:
                whole = member.upto(lambda d: len(d) >= end + 4 + size) if member else source.peek(at, end + 4 + size)
                row["payload"] = whole[end + 4 : end + 4 + size]
            yield row
        if own:
            at += extra[3]
        elif member:
            at = member.end()
        else:
            at += end + 4 + size + 4


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partitionbytes", str(32 << 20)))
        self.equal: list[tuple[str, tuple]] = []
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in _HEADERS and column != "payload_length" and isinstance(f, EqualTo) and f.value is not None:
                self.equal.append((column, (f.value,)))
            elif column in _HEADERS and column != "payload_length" and isinstance(f, In) and None not in f.value:
                self.equal.append((column, tuple(f.value)))
            elif column in _HEADERS and column != "payload_length" and isinstance(f, StringStartsWith):
                self.prefix.append((column, f.value))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        fs, root = filesystem(self.path)
        files = _manifest(fs, root)
        if files is None:
            infos = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            files = [(posixpath.relpath(i.path, root), i.size) for i in infos if i.type == pafs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        out, size = [_Files([])], 0
        for name, n in sorted(files):
            if out[-1].files and size + n > self.most:
                out.append(_Files([]))
                size = 0
            out[-1].files.append(name)
            size += n
        return out

    def wanted(self, row: dict) -> bool:
        return all(row[c] in values for c, values in self.equal) and all((row[c] or "").startswith(v) and row[c] is not None for c, v in self.prefix)

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        rows, size = [], 0
        for name in partition.files:
            with fs.open_input_file(posixpath.join(root, name)) as f:
                for row in records(f, self.wanted, self.payload):
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= 4 << 20 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def to_records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Records of a page table (columns of SCHEMA): of equal payloads of ``least_bytes`` or more, the largest id is
    the response and the others revisit it; a null payload is empty; rows that repeat the largest id all are
    responses; a null id counts as smaller than any other; an empty table gives no records; other columns are ignored.

    Equal payloads are found by SHA-256 of rows with a number of their own: what is grouped is (digest, id), so that a hot
    payload gathers nowhere.  Payloads are only joined to responses, by row number.
    """
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    columns = [F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body")]
    rows, row = numbered(pages.select(*columns), "pages")
    # a hex digest becomes base32 by Spark's own conv on each 20 bits
    digest = F.concat(*[_base32(F.substring(F.sha1("body"), 1 + 5 * i, 5)) for i in range(8)])
    heads = rows.select(F.col(row).alias("row"), "id", "url", F.sha2("body", 256).alias("key"), F.octet_length("body").cast("long").alias("size"), digest.alias("digest"))
    heads = materialise(heads, "heads")
    latest = heads.groupBy("key").agg(F.max("id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = (F.col("size") >= least_bytes) & F.col("latest").isNotNull() & F.coalesce(F.col("id") != F.col("latest"), F.lit(True))
    judged = materialise(heads.join(latest, "key", "left").withColumn("again", again).drop("key"), "judged")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    columns = [
        name("id").alias("record_id"),
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.col("digest").alias("payload_digest"),
        F.when(F.col("again"), name("latest")).alias("refers_to"),
        F.col("size").alias("payload_length"),
    ]
    payloads = rows.select(F.col(row).alias("row"), F.col("body").alias("payload"))
    first = judged.where("NOT again").join(payloads, "row").select(*columns, "payload")
    return first.unionByName(judged.where("again").select(*columns, F.lit(None).cast("binary").alias("payload")))


def _base32(hex5: F.Column) -> F.Column:
    """Five hex digits (20 bits) as four base32 characters."""
    digits = F.lpad(F.conv(hex5, 16, 32), 4, "0")
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(records_df: DataFrame, path: str, **options: str) -> None:
    register(records_df.sparkSession)
    records_df.write.format("warc").mode("append").options(**options).save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(payload=str(payload).lower(), **options).load(path)


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back: length and digest of responses are
    taken from their payloads; revisits are read by their headers alone."""
    page = lambda c: F.substring_index(F.col(c), ":", -1).try_cast("long")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b or b"" for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array([base32_sha1(b) for b in bodies], pa.string())], names=["record_id", "payload_bytes", "payload_digest"])

    full = read_archive(spark, path).where("record_type = 'response'").select("record_id", "payload").mapInArrow(measure, "record_id string, payload_bytes long, payload_digest string")
    full = full.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    heads = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    return full.unionByName(heads.select(page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, body, sha1(body) AS h FROM p),
g AS (SELECT body, max(page_id) AS latest, count(*) AS n FROM d GROUP BY body),
b AS (SELECT d.page_id, d.payload_bytes, d.h, g.latest, g.n,
  array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', substr(d.h, CAST(i AS INT), 1))]), '') AS bits
  FROM d JOIN g ON d.body = g.body)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest,
  CASE WHEN n > 1 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> latest THEN latest END AS refers_to
FROM b
"""
