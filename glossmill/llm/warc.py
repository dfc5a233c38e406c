"""WARC archives, written and read by one Python data source.

Writing: ``df.write.format("warc")`` takes rows of ``header``, which ends with its blank line,
and ``body``, both binary (null body: empty; a null header is an error). Each record becomes a
gzip member of its own, whose extra field tells the member's length. Tasks write files of at most about
FILE_BYTES under names of their own in a hidden folder; the commit moves the files of the tasks that counted and
deletes the rest, so a task that runs twice leaves nothing behind. ``write`` makes the records of a table of pages: of those
with equal payloads of ``least`` bytes or more, that of the smallest id is a response and the others are
revisits without payload that refer to it.

Reading: ``spark.read.format("warc")``. Files are planned into partitions of about ``partition_bytes``. Predicates
on record_type and other header columns are pushed down. Each record's header is parsed first; only then is it
known whether the payload is wanted, and one that isn't (its record fails a predicate, or option ``payload`` is
false) is neither inflated nor read where the file allows it: members that tell their length and records of plain files are
passed by seeking. Foreign gzip files, whose members don't tell their length, are inflated as a stream, and what is
skipped is thrown away in pieces; such a file is one task. ``read`` turns the session's push-down of filters to Python
sources on; without it Spark filters afterwards.

Bad records: folded header lines continue the one before. A record that doesn't begin with WARC/, has no whole
number as its Content-Length or ends early raises ValueError with its file: what follows can't be found then.
With option ``bad`` set to skip, the rest of such a file is passed over instead.

Nulls: a null html is an empty payload, a null url an empty target; rows with a null id are responses of their
own. Rows of one id and payload are all responses. Empty tables give a folder without files, which is read as no
records. Other columns than page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from glossmill.plans.lineage import cut, ensure_checkpoint_dir, remove

END = b"\r\n\r\n"
FILE_BYTES = 64 << 20
LEVEL = 4
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, content_length long, payload binary"
_HEADERS = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-payload-digest": "payload_digest", "warc-refers-to": "refers_to"}
PREFIX = "urn:x-page:"
Wanted = list[tuple[str, frozenset]]


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each 10 hexadecimal digits are 8 digits of base 32, respelt."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, payload, record_type, refers_to``: which pages are responses, and what revisits refer to."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("_key", F.sha2("payload", 256))
    same = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    first = cut(same.groupBy("_key").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last")).where("_first < _last").select("_key", "_first"))
    again = F.col("_first").isNotNull() & (F.col("page_id") > F.col("_first"))
    marked = rows.join(first, "_key", "left")
    return marked.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    rows = records(pages, least)
    name = lambda c: F.concat(F.lit(f"<{PREFIX}"), c.cast("string"), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.coalesce(name(F.col("page_id")), F.lit(f"<{PREFIX}>"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"\s+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))), line("X-Payload-Length", F.octet_length("payload").cast("string")),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
    )
    spark = pages.sparkSession
    fs, name = _open(_uri(path))
    if fs.get_file_info(name).type != pafs.FileType.NotFound:
        raise ValueError(f"{path} exists already")
    spark.dataSource.register(WarcDataSource)
    rows.select(F.encode(header, "UTF-8").alias("header"), body.alias("body")).write.format("warc").mode("append").save(path)


# A member's gzip header: deflate with an extra field of 12 bytes, which is one subfield "sl" of 8 bytes with the
# length of the whole member and the length of what it holds.
_MEMBER = struct.Struct("<4sIBBH2sHII")
_SIGN = b"\x1f\x8b\x08\x04"


def member(record: bytes) -> bytes:
    """A record as one gzip member that tells its length."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    data = packer.compress(record) + packer.flush()
    return _MEMBER.pack(_SIGN, 0, 0, 255, 12, b"sl", 8, _MEMBER.size + len(data) + 8, len(record)) + data + struct.pack("<II", zlib.crc32(record), len(record))


def told(head: bytes) -> tuple[int, int] | None:
    """The lengths that a member's first bytes tell, or None."""
    if len(head) < _MEMBER.size:
        return None
    sign, _, _, _, extra, name, width, whole, inner = _MEMBER.unpack(head)
    return (whole, inner) if (sign, extra, name, width) == (_SIGN, 12, b"sl", 8) and whole > _MEMBER.size else None


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = _uri(options["path"])
        self.hidden = f"_warc-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = _open(self.path)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for header, body in zip(batch.column(0), batch.column(1), strict=True):
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        fs.create_dir(posixpath.join(path, self.hidden), recursive=True)
                        out, size = fs.open_output_stream(posixpath.join(path, self.hidden, names[-1]), compression=None), 0
                    data = member(header.as_py() + (body.as_py() or b"") + END)
                    out.write(data)
                    size += len(data)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            fs.move(posixpath.join(path, self.hidden, name), posixpath.join(path, name))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        if fs.get_file_info(posixpath.join(path, self.hidden)).type == pafs.FileType.Directory:
            fs.delete_dir(posixpath.join(path, self.hidden))


@dataclass
class Files(InputPartition):
    paths: list[str]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path[5:].lstrip("/").join(["/", ""]) if path.startswith("file:") else path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = _uri(options["path"])
        self.target = int(options.get("partition_bytes", 64 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.skip_bad = options.get("bad", "raise").lower() == "skip"
        self.wanted: Wanted = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = set(_HEADERS.values())
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in names and isinstance(f.value, str):
                self.wanted.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in names:
                self.wanted.append((f.attribute[0], frozenset(f.value)))
            elif not (isinstance(f, IsNotNull) and f.attribute[0] == "record_type"):
                yield f

    def partitions(self) -> list[Files]:
        fs, path = _open(self.path)
        scheme = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        info = fs.get_file_info(path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted(((f.size, f.path) for f in found if f.type == pafs.FileType.File and not any(part.startswith(("_", ".")) for part in (f.base_name if info.type == pafs.FileType.File else f.path[len(path) :]).split("/"))), reverse=True)
        parts, sizes = [], []
        for size, name in files:  # largest first; the rest fill up partitions
            if parts and sizes[-1] + size <= self.target:
                parts[-1].paths.append(scheme + name)
                sizes[-1] += size
            else:
                parts.append(Files([scheme + name]))
                sizes.append(size)
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows, held = [], 0
        for path in partition.paths:
            fs, name = _open(path)
            with fs.open_input_file(name) as raw:
                for row in self._rows(raw, path):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield self._batch(rows, names)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows, names)

    def _rows(self, raw: pa.NativeFile, path: str) -> Iterator[tuple]:
        try:
            yield from archive(raw, self.wanted, self.payload)
        except (ValueError, EOFError, OSError, zlib.error) as e:
            if not self.skip_bad:
                raise ValueError(f"{path}: {e}") from e

    @staticmethod
    def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _Raw(io.RawIOBase):
    """A pyarrow file as Python's raw stream."""

    def __init__(self, inner: pa.NativeFile):
        self.inner = inner

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, place: int, whence: int = 0) -> int:
        self.inner.seek(place, whence)
        return self.inner.tell()

    def readinto(self, buffer) -> int:
        data = self.inner.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class _Inflated(io.RawIOBase):
    """What a member holds, inflated as far as it is read. Its checksum is compared when its end is read."""

    def __init__(self, raw: pa.NativeFile, size: int):
        self.raw, self.left, self.unpacker = raw, size, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.unpacker.eof:
            data = self.unpacker.unconsumed_tail
            if not data:
                data = self.raw.read(min(self.left, 1 << 14 if len(buffer) < 1 << 16 else 1 << 20))
                self.left -= len(data)
                if not data:
                    raise EOFError("a member ends early")
            out = self.unpacker.decompress(data, len(buffer))
            if out:
                buffer[: len(out)] = out
                return len(out)
        return 0


def archive(raw: pa.NativeFile, wanted: Wanted, payload: bool = True) -> Iterator[tuple]:
    """Records of a file, plain or gzip, that satisfy ``wanted``."""
    size = raw.size()
    if raw.read(2) != b"\x1f\x8b":
        raw.seek(0)
        stream = io.BufferedReader(_Raw(raw), 1 << 16)

        def pass_by(n: int) -> None:
            if stream.tell() + n > size:
                raise ValueError(f"a record ends {stream.tell() + n - size} bytes early")
            stream.seek(n, 1)

        yield from parse(stream, wanted, payload, pass_by)
        return
    at = 0
    while at < size:
        raw.seek(at)
        lengths = told(raw.read(_MEMBER.size))
        raw.seek(at)
        if lengths is None:  # from here on a stream
            yield from parse(gzip.open(io.BufferedReader(_Raw(raw), 1 << 20)), wanted, payload)
            return
        if at + lengths[0] > size:
            raise ValueError(f"a member ends {at + lengths[0] - size} bytes early")
        stream = _Counted(_Inflated(raw, lengths[0]))
        head = read_head(stream)
        if head is not None and stream.count + head[1] + len(END) == lengths[1]:
            row = _row(stream, *head, wanted, payload, lambda n: None)
            if row and payload and stream.read() != END:
                raise ValueError("a record isn't followed by two line ends")
            if row:
                yield row
        else:  # a member of several records
            raw.seek(at)
            yield from parse(io.BufferedReader(_Inflated(raw, lengths[0]), 1 << 16), wanted, payload)
        at += lengths[0]


class _Counted(io.BufferedReader):
    """Counts the bytes of the lines read."""

    def __init__(self, inner: io.RawIOBase):
        super().__init__(inner, 1 << 12)
        self.count = 0

    def readline(self, size: int = -1) -> bytes:
        line = super().readline(size)
        self.count += len(line)
        return line


def read_head(stream) -> tuple[dict[str, str], int] | None:
    """The next record's header fields and the length of what follows them; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    head: dict[str, str] = {}
    key = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        if line[:1] in b" \t" and key:
            head[key] = f"{head[key]} {line.decode('utf-8', 'replace').strip()}".strip()
            continue
        key = name.strip().lower()
        head[key] = value.strip()
    if not head.get("content-length", "").isdecimal():
        raise ValueError(f"a record with Content-Length {head.get('content-length')!r}")
    return head, int(head["content-length"])


def _row(stream, head: dict[str, str], size: int, wanted: Wanted, payload: bool, pass_by: Callable[[int], None]) -> tuple | None:
    """The row of a record whose header was read, or None if it fails ``wanted``; its payload is read or passed by."""
    row = {column: head.get(key) for key, column in _HEADERS.items()}
    good = all(row[c] in values for c, values in wanted)
    body = None
    if good and payload:
        body = stream.read(size)
        if len(body) < size:
            raise ValueError(f"a record of {size} bytes ends after {len(body)}")
    else:
        pass_by(size)
    length = head.get("x-payload-length", "")
    return (*row.values(), int(length) if length.isdecimal() else size, size, body) if good else None


def parse(stream, wanted: Wanted, payload: bool = True, pass_by: Callable[[int], None] | None = None) -> Iterator[tuple]:
    """Records of a stream, header first; what fails ``wanted`` is passed over without being kept."""
    while (head := read_head(stream)) is not None:
        row = _row(stream, *head, wanted, payload, pass_by or (lambda n: _skip(stream, n)))
        if row:
            yield row


def _skip(stream, size: int) -> None:
    while size > 0:
        got = len(stream.read(min(size, 1 << 20)))
        if not got:
            raise ValueError(f"a record ends {size} bytes early")
        size -= got


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        if [(f.name, f.dataType.typeName()) for f in schema.fields] != [("header", "binary"), ("body", "binary")]:
            raise ValueError("records to write are rows of header and body, both binary")
        return WarcWriter(self.options)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages as archives in the shared folder, read them back, report each record, and remove the archives.

    A response's digest and length are taken from the payload that was read, a revisit's from its header.
    """
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    found = read(spark, path).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, f"{PREFIX}(-?[0-9]+)", 1).try_cast("long")
    whole = F.col("record_type") == "response"
    seen = found.select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
    seen = cut(seen)
    remove(spark, path)
    return seen
