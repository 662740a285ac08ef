"""WARC archives as a PySpark Python data source.

``spark.read.format("warc")`` plans a partition for each stretch of records of each archive file,
takes predicates on record types and other header fields into the reader, parses headers first,
and seeks past the payload of every record that a predicate drops (or of all, with option
``payload`` set to ``false``). ``df.write.format("warc")`` writes archives; a manifest written on
commit names the files that count, so that leftovers of failed or repeated tasks are never read.

Files are reached by ``pyarrow.fs``, so any URI that it knows will do. Archives from elsewhere are
read too: ``.warc`` and ``.warc.gz`` (one gzip member a record, or any other way), header names in
any case, chunked and gzip-coded payloads. A gzip file is written with option ``compress``, one
member a record, so that its stretches are partitions as well; one without a manifest is a single
partition, since its members' places are not known.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from seekstone.shared import new_folder, stage

READ_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_bytes bigint, payload binary"
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload")
VERSION = "WARC/1.1"
MANIFEST = "_manifest-"
#: Header of the HTTP block that keeps the size of the decoded payload, also where it is left out.
SIZE_HEADER = "X-Payload-Bytes"
#: Field that names the fields whose values are escaped, and the format's profile of equal payloads (a fixed value).
ESCAPED, IDENTICAL = "X-Escaped-Fields", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_OF = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def one_line(fields: dict[str, str]) -> dict[str, str]:
    """Header fields on one line each. A value with line ends is escaped, and a field of our own says
    which are; all others, percent signs included, stand as they are."""
    out, escaped = {}, []
    for name, value in fields.items():
        if "\r" in value or "\n" in value or value != value.strip():
            escaped.append(name)
            value = re.sub(r"[%\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)
        out[name] = value
    return out | ({ESCAPED: ", ".join(escaped)} if escaped else {})


def as_written(head: dict[str, str]) -> dict[str, str]:
    """Fields by their names in lower case, with what ``one_line`` escaped undone, and nothing else."""
    for name in filter(None, (n.strip().lower() for n in head.get(ESCAPED.lower(), "").split(","))):
        if name in head:
            head[name] = unquote(head[name])
    return head


def encode_record(row: dict, date: str) -> bytes:
    """One record. Payloads of responses are gzip-coded inside their HTTP block where that is shorter."""
    payload = row["payload"] or b""
    body, coding = b"", ""
    if row["record_type"] == "response":
        body = payload
        if len(payload) >= 100 and len(packed := gzip.compress(payload, 1, mtime=0)) < len(payload):
            body, coding = packed, "Content-Encoding: gzip\r\n"
    length = f"Content-Length: {len(body)}\r\n" if row["record_type"] == "response" else ""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{coding}{length}{SIZE_HEADER}: {len(payload)}\r\n\r\n".encode() + body
    fields = {HEADER_OF[k]: str(row[k]) for k in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to") if row.get(k) is not None}
    if row["record_type"] == "revisit":
        fields["WARC-Profile"] = IDENTICAL
    head = [f"{name}: {value}" for name, value in one_line(fields).items()]
    head += [f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([VERSION, *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class WarcWriter(DataSourceWriter):
    """Each task writes files of about ``max_bytes`` under names that no other attempt uses."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.max_bytes = int(options.get("maxFileBytes", 64 << 20))
        self.stretch = int(options.get("stretchBytes", 8 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.compress = options.get("compress", "false").lower() == "true"
        if overwrite:
            raise ValueError("warc archives are only appended to")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        done, out, name, size, marks = [], None, "", 0, [0]
        try:
            for row in iterator:
                record = encode_record(row.asDict(), self.date)
                record = gzip.compress(record, 1, mtime=0) if self.compress else record
                if out is not None and size >= self.max_bytes:
                    out.close()
                    done.append({"name": name, "size": size, "marks": marks})
                    out = None
                if out is None:
                    name, size, marks = f"{uuid.uuid4().hex}.warc" + ".gz" * self.compress, 0, [0]
                    out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                if size - marks[-1] >= self.stretch:
                    marks.append(size)
                out.write(record)
                size += len(record)
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append({"name": name, "size": size, "marks": marks})
        return Written(done)

    def commit(self, messages: list) -> None:
        fs, base = open_fs(self.path)
        fs.create_dir(base, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with fs.open_output_stream(f"{base}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, base = open_fs(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{base}/{f['name']}")


@dataclass
class Stretch(InputPartition):
    """Bytes ``start`` to ``end`` of a file, both at the start of a record (or the file's end)."""

    name: str
    start: int
    end: int

    def __init__(self, name: str, start: int, end: int):
        super().__init__((name, start, end))
        self.name, self.start, self.end = name, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.accept: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Predicates on header fields are kept; all others go back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_OF and isinstance(f, EqualTo):
                self.accept.append((HEADER_OF[name], "in", (str(f.value),)))
            elif name in HEADER_OF and isinstance(f, In):
                self.accept.append((HEADER_OF[name], "in", tuple(map(str, f.value))))
            elif name in HEADER_OF and isinstance(f, StringStartsWith):
                self.accept.append((HEADER_OF[name], "starts", (str(f.value),)))
            elif name in HEADER_OF and isinstance(f, IsNotNull):
                self.accept.append((HEADER_OF[name], "there", ()))
            else:
                yield f

    def wanted(self, head: dict) -> bool:
        for name, how, values in self.accept:
            value = head.get(name.lower())
            if value is None or how == "in" and value not in values or how == "starts" and not value.startswith(values[0]):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        fs, base = open_fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        out: list[InputPartition] = []
        manifests = [i for i in found if i.base_name.startswith(MANIFEST)]
        for info in manifests:
            with fs.open_input_stream(info.path) as f:
                for x in json.loads(f.read()):
                    ends = [*x["marks"][1:], x["size"]]
                    out += [Stretch(x["name"], a, b) for a, b in zip(x["marks"], ends)]
        if not manifests:  # archives from elsewhere
            out += [Stretch(i.base_name, 0, i.size) for i in found if i.base_name.endswith((".warc", ".warc.gz"))]
        return out or [Stretch("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.start == partition.end:
            return
        fs, base = open_fs(self.path)
        with fs.open_input_file(f"{base}/{partition.name}") as raw:
            raw.seek(partition.start)
            if partition.name.endswith(".gz"):
                f, size = io.BufferedReader(gzip.GzipFile(fileobj=Part(raw, partition.end - partition.start)), 1 << 20), None
            else:
                f, size = io.BufferedReader(raw, 1 << 20), partition.end - partition.start
            at = 0
            while True:
                while f.peek(1)[:1] in (b"\r", b"\n"):  # what stands between records
                    at += len(f.read(1))
                if size is not None and at >= size:
                    return
                head, n = read_head(f, VERSION[:5])
                if head is None:
                    return
                length = int(head.get("content-length", 0))
                at += n + length
                if self.wanted(head):
                    yield (*(head.get(h.lower()) for h in HEADER_OF.values()), *self.block(f, head, length))
                else:
                    skip(f, length)

    def block(self, f: io.BufferedReader, head: dict, length: int) -> tuple[int | None, bytes | None]:
        """Size and bytes of the payload; the block is read or skipped to its end."""
        kind = head.get("content-type", "").lower()
        if not kind.startswith("application/http") or "msgtype=request" in kind.replace(" ", "") or head.get("warc-type") == "request":
            if self.with_payload:
                return length, f.read(length)
            skip(f, length)
            return length, None
        if not f.peek(5)[:5] == b"HTTP/"[: len(f.peek(5)[:5])] or not length:
            return length, f.read(length)
        http, n = read_head(f, "HTTP/", length)
        size = int(http[SIZE_HEADER.lower()]) if http.get(SIZE_HEADER.lower(), "").isdigit() else None
        if not self.with_payload or head.get("warc-type") != "response":
            skip(f, length - n)
            return size, None
        body = f.read(length - n)
        if "chunked" in http.get("transfer-encoding", "").lower():
            body = unchunked(body)
        if http.get("content-encoding", "").lower() in ("gzip", "x-gzip"):
            try:
                body = gzip.decompress(body)
            except (OSError, EOFError, zlib.error):  # crawlers also keep the header of bodies they have decoded
                pass
        return len(body), body


class Part(io.RawIOBase):
    """The next so many bytes of a file."""

    def __init__(self, raw: pa.NativeFile, size: int):
        self.raw, self.left = raw, size

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        got = self.raw.read(min(len(to), self.left))
        self.left -= len(got)
        to[: len(got)] = got
        return len(got)


def skip(f: io.BufferedReader, n: int) -> None:
    """Pass n bytes: a seek, or in a gzip file reading on."""
    if n > 0:
        f.seek(n, io.SEEK_CUR)


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; a body that is not is returned as it is."""
    out, at = [], 0
    while at < len(body):
        line = body.find(b"\r\n", at)
        digits = body[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", digits):
            return body
        size = int(digits, 16)
        if not size:
            break
        out.append(body[line + 2 : line + 2 + size])
        at = line + 2 + size + 2
    return b"".join(out)


def read_head(f: io.BufferedReader, starts: str, most: int | None = None) -> tuple[dict | None, int]:
    """Header fields by their names in lower case, up to the empty line, and the bytes read; None at
    the file's end. A line that begins with white space goes on with the one before it."""
    first = f.readline()
    if not first:
        return None, 0
    if not first.startswith(starts.encode()):
        raise ValueError(f"not a header: {first[:40]!r}")
    head, n, name = {}, len(first), ""
    while most is None or n < most:
        line = f.readline() if most is None else f.readline(most - n)
        n += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and name:
            head[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        head[name] = value.strip()
    return as_written(head), n


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def mark_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``pages(page_id, url, payload)`` as records to write: response, or revisit of the first copy.

    Among rows with equal payloads of ``least_bytes`` or more, those with the smallest ``page_id``
    are responses and the others revisit it; shorter payloads are all responses. Equality is that
    of SHA-256 digests. A null payload is empty; rows with a null id are never referred to and are
    responses; rows that repeat the smallest id are all responses.

    Only digests are compared across pages: their counts are partially aggregated, and the rows of a
    digest that many pages share are joined with one row each. Payloads move once, by page.
    """
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit("").cast("binary")).alias("payload"))
    digest = F.sha2("payload", 256)
    keys = rows.select("page_id", digest.alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    first = stage(keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"), "first")
    again = keys.join(first, "digest").where("page_id <> first").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first").distinct()
    rows = rows.withColumn("payload_digest", digest)
    marked = rows.join(stage(again, "again"), (F.col("page_id") == F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return marked.select(
        F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:>")).alias("record_id"),
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"),
        urn(F.col("first")).alias("refers_to"),
        "payload",
    )


def write_archive(records: DataFrame, path: str, compress: bool = False) -> None:
    register(records.sparkSession)
    records.select(*WRITE_COLUMNS).write.format("warc").option("compress", str(compress).lower()).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as an archive and return its records, read back.

    A null html is an empty payload, a null url leaves its field out, a null id makes a record without a
    number that nothing refers to; rows that repeat are records each. An empty table gives an archive
    without records; other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    write_archive(mark_revisits(pages.select("page_id", "url", payload.alias("payload"))), path)
    return read_archive(spark, path)


def page_digests(records: DataFrame) -> DataFrame:
    """Columns of the query. A response's size and digest come from its decoded payload."""
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    response = F.col("record_type") == "response"
    stated = F.regexp_replace("payload_digest", "^sha256:", "")
    return records.select(
        F.when(page("record_id") != "", page("record_id").cast("long")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(stated).alias("payload_digest"),
        "record_type",
        F.when(~response, page("refers_to").cast("long")).alias("refers_to"),
    )
