"""WARC files as a data source, "warc": read and written by Python, planned by file and byte range.

Reading: files (.warc, .warc.gz, or other names by their first bytes) are
cut into ranges of `splitBytes`; a record belongs to the range in which it (or its gzip member) begins, which a
reader finds by itself. A member with many records, as where a whole file is one, is read to its end by the range in which it begins; its
records have the member's offset. Of every record the WARC header is parsed first; comparisons of
columns that come from it (warc_type, record_id, target_uri, date, content_type,
content_length, record_offset, file) are pushed down and decided there. A record that fails them is
skipped: by a seek where its length is known (plain files; members that carry the
"sl" field of the standard's annex), else by inflating without keeping. Only for
wanted records is the block read, the HTTP head parsed, chunked transfer and gzip or deflate
coding undone; with option payload=false not even then.

Writing: one row is one record; every task writes a file of its own under a
temporary name, and the commit gives the files of finished tasks their names, so that
lost and repeated tasks leave nothing behind.

Defined results: a null in any column read means that the header is missing; a
damaged or cut-off record is passed over, up to the next one that can be found (mode=permissive, the default), or
fails the job (mode=failfast); repeated records are read each; payloads of any length are read whole; an empty file has no records; on writing, null payloads and
empty ones are blocks of HTTP head alone, null headers are left out, other columns are ignored.
"""

from __future__ import annotations

import datetime
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = "warc_type string, record_id string, target_uri string, date string, content_type string, content_length long, headers map<string,string>, http_status int, http_headers map<string,string>, payload binary, file string, record_offset long"
_ARROW = pa.schema([
    ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()),
    ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("record_offset", pa.int64()),
])
_FROM_HEADER = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "content_length": "content-length"}
SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 18


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
        return fs, at
    return pafs.LocalFileSystem(), path


class Test:
    """A pushed comparison; null compares as in SQL, that is, it fails."""

    def __init__(self, filter) -> None:
        self.kind = type(filter).__name__
        if self.kind == "Not":
            self.inner, self.column = Test(filter.child), None
        else:
            self.inner, self.column = None, filter.attribute[0]
            self.value = getattr(filter, "value", None)

    def columns(self) -> set[str]:
        return self.inner.columns() if self.inner else {self.column}

    def known(self, row: dict) -> bool | None:
        """True, False, or None for unknown."""
        if self.inner:
            x = self.inner.known(row)
            return None if x is None else not x
        v, w, k = row.get(self.column), self.value, self.kind
        if k == "IsNull":
            return v is None
        if k == "IsNotNull":
            return v is not None
        if k == "EqualNullSafe":
            return v == w
        if k == "In":
            return None if v is None else True if v in w else None if None in w else False
        if v is None or w is None:
            return None
        if k == "EqualTo":
            return v == w
        if k == "GreaterThan":
            return v > w
        if k == "GreaterThanOrEqual":
            return v >= w
        if k == "LessThan":
            return v < w
        if k == "LessThanOrEqual":
            return v <= w
        return v.startswith(w) if k == "StringStartsWith" else v.endswith(w) if k == "StringEndsWith" else w in v


_TESTS = (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)


def _pushable(filter) -> bool:
    if isinstance(filter, Not):
        return _pushable(filter.child)
    return isinstance(filter, _TESTS) and len(filter.attribute) == 1 and filter.attribute[0] in {*_FROM_HEADER, "file", "record_offset"}


class Damaged(ValueError):
    pass


class Source:
    """Reads of a file by offset, through one buffer."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def at(self, offset: int, n: int) -> bytes:
        """Up to n bytes from an offset."""
        a = offset - self.base
        if a < 0 or a + n > len(self.held):
            if offset + n > self.size:
                n = max(0, self.size - offset)
            if a < 0 or a + n > len(self.held):
                self.base, a = offset, 0
                self.held = self.file.read_at(min(max(n, _CHUNK), self.size - offset), offset) if offset < self.size else b""
        return self.held[a : a + n]


def _headers(raw: bytes) -> dict[str, str]:
    """Names and values of header lines; a line that begins with white space goes on with the one before; of equal names the last counts."""
    out, name = {}, None
    for line in raw.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip()
            out[name] = value.strip()
    return out


class Plain:
    """Records of an uncompressed file."""

    def __init__(self, source: Source) -> None:
        self.source = source

    def first(self, start: int) -> int:
        """Where the first record at or after an offset begins; the file's size if nowhere."""
        if start == 0:
            return 0
        at, s = start - 4, self.source
        at = max(at, 0)
        while at < s.size:
            block = s.at(at, _CHUNK)
            k = block.find(b"\r\n\r\nWARC/")
            while k >= 0:
                if at + k + 4 >= start and self._is_record(at + k + 4):
                    return at + k + 4
                k = block.find(b"\r\n\r\nWARC/", k + 1)
            if len(block) < _CHUNK:
                break
            at += len(block) - 8
        return s.size

    def _is_record(self, at: int) -> bool:
        """A header whose length leads to another record, or to the end of the file."""
        try:
            _, fields, _, _, after = self.head(at)
        except Damaged:
            return False
        return "warc-type" in fields and (after >= self.source.size or self.source.at(after, 5) == b"WARC/")

    def head(self, at: int) -> tuple[dict[str, str], dict[str, str], int, int, int]:
        """Headers, by lower-case names too, where the block begins, its length, where the next record begins."""
        n = 4096
        while (end := (raw := self.source.at(at, n)).find(b"\r\n\r\n")) < 0:
            if len(raw) < n:
                raise Damaged(f"no end of the header at {at}")
            n *= 2
        if not raw.startswith(b"WARC/"):
            raise Damaged(f"no record at {at}")
        headers = _headers(raw[:end].split(b"\r\n", 1)[-1])
        low = {k.lower(): v for k, v in headers.items()}
        if not low.get("content-length", "").isdigit():
            raise Damaged(f"no length at {at}")
        length = int(low["content-length"])
        return headers, low, at + end + 4, length, at + end + 4 + length + 4

    def block(self, begin: int, length: int) -> bytes:
        out = self.source.at(begin, length)
        if len(out) < length:
            raise Damaged(f"cut off at {begin}")
        return out


class Gzipped:
    """Records of a file with a gzip member for each."""

    def __init__(self, source: Source) -> None:
        self.source = source

    def first(self, start: int) -> int:
        at, s = start, self.source
        while at < s.size:
            block = s.at(at, _CHUNK)
            k = block.find(b"\x1f\x8b\x08")
            while k >= 0:
                try:
                    if zlib.decompressobj(31).decompress(s.at(at + k, 4096), 5) == b"WARC/":
                        return at + k
                except zlib.error:
                    pass
                block = s.at(at, _CHUNK)
                k = block.find(b"\x1f\x8b\x08", k + 1)
            if len(block) < _CHUNK:
                break
            at += len(block) - 2
        return s.size

    def _member(self, at: int) -> int:
        """The member's length if its "sl" field has it, else 0."""
        head = self.source.at(at, 64)
        if len(head) >= 24 and head[3] & 4:
            extra, k = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
            while k + 4 <= len(extra):
                n = struct.unpack_from("<H", extra, k + 2)[0]
                if extra[k : k + 2] == b"sl" and n == 8 and k + 12 <= len(extra):
                    return struct.unpack_from("<I", extra, k + 4)[0]
                k += 4 + n
        return 0

    def head(self, at: int) -> tuple[dict[str, str], dict[str, str], int, int, int]:
        """As Plain.head; the next record's place is -1 where only inflating tells it."""
        self.open(at)
        headers, low, length = self.next_head(at)
        size = self._member(at)
        return headers, low, at, length, at + size if size else -1

    def open(self, at: int) -> None:
        self.inflate, self.rest, self.read = zlib.decompressobj(31), b"", at

    def more(self, most: int) -> bool:
        """Inflates some more of the member into `rest`; False at its end."""
        if self.inflate.eof:
            return False
        piece = self.inflate.unconsumed_tail or self.source.at(self.read, min(most, _CHUNK))
        if not self.inflate.unconsumed_tail:
            self.read += len(piece)
        if not piece:
            raise Damaged("cut off")
        try:
            self.rest += self.inflate.decompress(piece, most)
        except zlib.error as e:
            raise Damaged(str(e)) from e
        return True

    def next_head(self, at: int) -> tuple[dict[str, str], dict[str, str], int]:
        """Headers of the record that `rest` begins with, and its length; `rest` is its block from then on."""
        while (end := self.rest.find(b"\r\n\r\n")) < 0:
            if not self.more(2048):
                raise Damaged(f"no end of the header at {at}")
        raw = self.rest
        if not raw.startswith(b"WARC/"):
            raise Damaged(f"no record at {at}")
        headers = _headers(raw[:end].split(b"\r\n", 1)[-1])
        low = {k.lower(): v for k, v in headers.items()}
        if not low.get("content-length", "").isdigit():
            raise Damaged(f"no length at {at}")
        self.rest = raw[end + 4 :]
        return headers, low, int(low["content-length"])

    def block(self, begin: int, length: int) -> bytes:
        parts, have = [self.rest], len(self.rest)
        self.rest = b""
        while have < length:
            if not self.more(1 << 22):
                raise Damaged(f"cut off at {begin}")
            parts.append(self.rest)
            have += len(self.rest)
            self.rest = b""
        whole = b"".join(parts)
        self.rest = whole[length:]
        return whole[:length]

    def follows(self, length: int) -> bool:
        """Passes over so much of the block as is left and the empty lines after it; whether the member goes on with another record."""
        while length > len(self.rest):
            length -= len(self.rest)
            self.rest = b""
            if not self.more(1 << 22):
                raise Damaged("cut off")
        self.rest = self.rest[length:]
        while True:
            self.rest = self.rest.lstrip(b"\r\n")
            if self.rest:
                return True
            if not self.more(1 << 16):
                return False

    def skip(self) -> int:
        """Inflates to the member's end, keeping nothing; where the next begins."""
        self.rest = b""
        while self.more(1 << 22):
            self.rest = b""
        return self.read - len(self.inflate.unused_data)


def _http(block: bytes) -> tuple[int | None, dict[str, str] | None, bytes]:
    """Status, headers and decoded body of an HTTP message; of a request the status is null."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return None, None, block
    first, _, rest = block[:end].partition(b"\r\n")
    headers, body, status = _headers(rest), block[end + 4 :], None
    if first.startswith(b"HTTP/"):
        code = first.split(b" ", 2)[1:2]
        status = int(code[0]) if code and code[0].isdigit() else None
    low = {k.lower(): v.lower() for k, v in headers.items()}
    if "chunked" in low.get("transfer-encoding", ""):
        parts, at = [], 0
        while (line := body.find(b"\r\n", at)) >= 0:
            try:
                n = int(body[at:line].split(b";")[0], 16)
            except ValueError:
                parts = [body]  # it isn't chunked after all
                break
            if not n:
                break
            parts.append(body[line + 2 : line + 2 + n])
            at = line + 2 + n + 2
        body = b"".join(parts)
    for wbits, coding in ((47, "gzip"), (47, "deflate")):
        if coding in low.get("content-encoding", ""):
            try:
                body = zlib.decompressobj(wbits).decompress(body)
            except zlib.error:
                pass
    return status, headers, body


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.payload = options.get("payload", "true").lower() != "false"
        self.failfast = options.get("mode", "permissive").lower() == "failfast"
        self.tests: list[Test] = []

    def pushFilters(self, filters):
        for f in filters:
            if _pushable(f):
                self.tests.append(Test(f))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, at = _file_system(self.path)
        info = fs.get_file_info(at)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.is_file and f.size and not any(p.startswith(("_", ".")) for p in f.path[len(at) :].split("/")):
                by_file = [t for t in self.tests if t.columns() == {"file"}]
                if all(t.known({"file": f.path}) for t in by_file):
                    out += [Range(f.path, s, min(f.size, s + self.split)) for s in range(0, f.size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _file_system(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            source = Source(file, file.size())
            zipped = source.at(0, 2) == b"\x1f\x8b"
            records = (Gzipped if zipped else Plain)(source)
            at = records.first(partition.start)
            while at < partition.end:
                try:
                    headers, low, begin, length, after = records.head(at)
                    while True:
                        row = {c: low.get(h) for c, h in _FROM_HEADER.items()} | {"content_length": length, "file": partition.path, "record_offset": at}
                        left = length
                        if all(t.known(row) for t in self.tests):
                            row |= {"headers": list(headers.items()), "http_status": None, "http_headers": None, "payload": None}
                            if self.payload:
                                body, left = records.block(begin, length), 0
                                if low.get("content-type", "").lower().startswith("application/http"):
                                    row["http_status"], http, body = _http(body)
                                    row["http_headers"] = list(http.items()) if http is not None else None
                                row["payload"] = body
                                held += len(body)
                            rows.append(row)
                        # a member without a length of its own may hold more records
                        if after >= 0 or not records.follows(left):
                            break
                        headers, low, length = records.next_head(at)
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                    at = after if after >= 0 else records.skip()
                    if not zipped and at < source.size:
                        # a record may be followed by more or fewer empty lines than two
                        while source.at(at, 1) in (b"\r", b"\n"):
                            at += 1
                except Damaged:
                    if self.failfast:
                        raise
                    at = records.first(at + 1)
                if len(rows) >= 2000 or held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class Wrote(WriterCommitMessage):
    def __init__(self, name: str) -> None:
        self.name = name


def _record(kind: str, uri: str | None, date: str, content_type: str, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {uri}"] if uri is not None else []
    lines += [f"{k}: {v}" for k, v in extra]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).replace("\0", "").encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with the "sl" field: its own length and the record's."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H2sH", 12, b"sl", 8)
    return head + struct.pack("<II", len(head) + 8 + len(body) + 8, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class Writer(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.gzip = options.get("compression", "gzip").lower() == "gzip"
        self.requests = options.get("requests", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        fs, at = _file_system(self.path)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
        fs.create_dir(f"{at}/_temporary", recursive=True)
        pack = member if self.gzip else lambda r: r
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        with fs.open_output_stream(f"{at}/_temporary/{name}", compression=None) as out:
            out.write(pack(_record("warcinfo", None, now, "application/warc-fields", b"software: graftwork\r\nformat: WARC File Format 1.1\r\n", [])))
            for b in iterator:
                for r in b.to_pylist():
                    uri, extra = r.get("target_uri"), [(k, v) for k, v in r.get("headers") or [] if v is not None]
                    date = r.get("date") or now
                    if self.requests:
                        host = (uri or "").split("/")[2:3] or [""]
                        out.write(pack(_record("request", uri, date, "application/http; msgtype=request", f"GET / HTTP/1.1\r\nHost: {host[0]}\r\n\r\n".encode(), extra)))
                    body = r.get("payload") or b""
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: {r.get('content_type') or 'text/html; charset=utf-8'}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                    out.write(pack(_record(r.get("warc_type") or "response", uri, date, "application/http; msgtype=response", head + body, extra)))
        return Wrote(name)

    def commit(self, messages) -> None:
        fs, at = _file_system(self.path)
        for m in messages:
            if m is not None:
                fs.move(f"{at}/_temporary/{m.name}", f"{at}/{m.name}")
        fs.delete_dir(f"{at}/_temporary")

    def abort(self, messages) -> None:
        fs, at = _file_system(self.path)
        if fs.get_file_info(f"{at}/_temporary").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/_temporary")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    """Makes "warc" known to the session, and lets filters reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def write(records: DataFrame, path: str, **options: str) -> None:
    """Writes records with any of the columns warc_type, target_uri, date, content_type (of the HTTP body), headers, payload."""
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records, the id in a header of its own."""
    headers = F.create_map(F.lit("X-Page-Id"), F.coalesce(pages[id_col].cast("string"), F.lit("")))
    return pages.select(F.lit("response").alias("warc_type"), pages[url_col].cast("string").alias("target_uri"), headers.alias("headers"), F.encode(pages[html_col].cast("string"), "UTF-8").alias("payload"))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages as WARC files with request and response records, and reads the HTML responses back: page_id, url, http_status, bytes and md5 of the payload."""
    write(page_records(pages), path, requests="true")
    got = read(pages.sparkSession, path).where("warc_type = 'response' AND content_type LIKE 'application/http%'")
    number = F.expr("try_cast(nullif(headers['X-Page-Id'], '') AS bigint)")
    return got.select(number.alias("page_id"), F.col("target_uri").alias("url"), F.col("http_status").cast("long").alias("http_status"), F.length("payload").cast("long").alias("bytes"), F.md5("payload").alias("md5"))
