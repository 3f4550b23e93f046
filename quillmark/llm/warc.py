"""Operator 10: WARC archives as a Spark data source, read and written.

    spark.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").load(folder).where("record_type = 'response'")

Every record is a gzip member of its own, whose extra field ``sl`` tells its
length, so a reader inflates a record's header, up to a kibibyte beyond it, and
passes over the rest. Files are read once, 64 KiB ahead; what a jump leaves beyond
that is not read. Other people's archives, plain or gzipped, with or without that
field, are read too. Records without a header are null there, an archive that
ends within a record is an error, and an empty folder has no records.
"""

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string,"
    " payload_digest string, payload_length long, headers map<string,string>, payload binary"
)
NAMED = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
ARROW = pa.schema(
    [(name, pa.string()) for name in NAMED]
    + [("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
#: Bytes read ahead of a file; fed to inflation at once; inflated at once in search of a blank line.
CHUNK, FEED, HEAD = 1 << 16, 1 << 12, 1 << 10
BLANK = b"\r\n\r\n"
#: A file is closed and a new one begun beyond this size; a batch of records is passed on.
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
COMMITTED = "_committed"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# Writing


def _member(data: bytes) -> bytes:
    """One gzip member with its own length in the extra field, if that can hold it."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    end = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 24 + len(body) + 8
    if max(size, len(data)) < 1 << 32:
        extra = struct.pack("<H2sHII", 12, b"sl", 8, size, len(data))
        return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + body + end
    return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + end


def _one_line(value: str) -> str:
    """A header value; line breaks and other control characters are percent-encoded."""
    return re.sub("[\0-\x1f\x7f]", lambda m: quote(m[0]), value)


def _record(row: dict) -> bytes:
    payload = row["payload"] or b""
    length = len(payload) if row["payload_length"] is None else row["payload_length"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    block = http.encode() + (payload if row["record_type"] == "response" else b"")
    headers = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": row["date"],
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": row["payload_digest"],
    }
    if row["record_type"] == "revisit":
        headers["WARC-Refers-To"] = f"<{row['refers_to']}>"
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Files of whole records; only those of successful tasks are named as committed."""

    def __init__(self, options, overwrite: bool):
        if overwrite:
            raise ValueError("archives are only appended to")
        self.path = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, place = _system(self.path)
        system.create_dir(place, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{place}/{files[-1]}", compression=None), 0
                data = _member(_record(row))
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        system, place = _system(self.path)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{COMMITTED}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages) -> None:
        """Files of a failed job stay, but nothing names them."""


# Reading


@dataclass
class Files(InputPartition):
    paths: list = field(default_factory=list)


class _Input:
    """Bytes of a file from a place on, through one buffer: what was read ahead is not
    read again, and what is passed over beyond it is not read at all."""

    def __init__(self, file):
        self.file, self.size, self.at = file, file.size(), 0
        self.ahead, self.begin = b"", 0

    def plain(self, n: int) -> bytes:
        """The next ``n`` bytes, fewer at the end of the file."""
        n = min(n, self.size - self.at)
        if self.at + n > self.begin + len(self.ahead):
            kept = self.ahead[self.at - self.begin :] if self.at >= self.begin else b""
            self.ahead = kept + self.file.read_at(max(n, CHUNK) - len(kept), self.at + len(kept))
            self.begin = self.at
        return self.ahead[self.at - self.begin :][:n]


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    pairs = (line.partition(":")[::2] for line in lines[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _blocks(file, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records; ``wanted`` tells by the headers: None to leave out
    the record, else whether the whole block is needed or only the HTTP headers it begins with."""
    source = _Input(file)
    while source.at < source.size:
        if source.plain(2) == b"\x1f\x8b":
            yield from _gzipped(source, wanted)
        else:
            yield from _plain(source, wanted)


def _is_http(headers: dict[str, str]) -> bool:
    return headers.get("content-type", "").startswith("application/http")


def _gzipped(source: _Input, wanted):
    """One member: inflated step by step up to the blank line, then as far as is wanted."""
    begin, start = source.at, source.plain(24)
    jump = None
    if start[3] & 4 and start[12:14] == b"sl":
        jump = struct.unpack_from("<I", start, 16)[0]
    inflate = zlib.decompressobj(31)

    def more(most: int) -> bytes:
        part = inflate.unconsumed_tail
        if not part:
            part = source.plain(FEED)
            source.at += len(part)
        found = inflate.decompress(part, most)
        if not part and not found and not inflate.eof:
            raise ValueError("an archive ends within a record")
        return found

    data = b""
    while (end := data.find(BLANK)) < 0 and not inflate.eof:
        data += more(max(HEAD, len(data)))
    headers = _headers(data[:end])
    whole = wanted(headers)
    if whole is not None:
        length = int(headers.get("content-length", 0))
        most = length if whole else min(length, CHUNK) if _is_http(headers) else 0
        parts = [data[end + 4 :]]
        have = len(parts[0])
        while have < most and not inflate.eof and (whole or BLANK not in b"".join(parts)):
            parts.append(more(most - have if whole else HEAD))
            have += len(parts[-1])
        yield headers, b"".join(parts)[:most]
    if jump:
        source.at = begin + jump
        if source.at > source.size:
            raise ValueError("an archive ends within a record")
        return
    while not inflate.eof:
        more(CHUNK)
    source.at -= len(inflate.unused_data)


def _plain(source: _Input, wanted):
    data, size = b"", HEAD
    while (end := data.find(BLANK, len(data) - len(data.lstrip(b"\r\n")))) < 0:
        data = source.plain(size)
        if len(data) < size and BLANK not in data.lstrip(b"\r\n"):
            if data.strip():
                raise ValueError("an archive ends within a header")
            source.at += len(data)
            return
        size *= 2
    headers = _headers(data[:end].lstrip(b"\r\n"))
    length = int(headers.get("content-length", 0))
    source.at += end + 4
    whole = wanted(headers)
    if whole is not None:
        yield headers, source.plain(length if whole else min(length, CHUNK) if _is_http(headers) else 0)
    source.at = min(source.size, source.at + length + 4)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.bytes_each = int(options.get("partitionBytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes the tests of header fields; the rest is left to Spark."""
        kinds = {EqualTo: "is", In: "in", StringStartsWith: "starts", IsNotNull: "known"}
        for test in filters:
            kind = kinds.get(type(test))
            name = test.attribute[0] if kind and len(test.attribute) == 1 else None
            if name in NAMED:
                self.tests.append((NAMED[name], kind, getattr(test, "value", None)))
            else:
                yield test

    def partitions(self) -> list[Files]:
        """Files in groups of about ``partitionBytes``, largest first into the emptiest group."""
        from pyarrow import fs

        system, place = _system(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.File:
            return [Files([self.path])]
        found = {f.base_name: f for f in system.get_file_info(fs.FileSelector(place, recursive=False))}
        lists = [f for name, f in found.items() if name.startswith(COMMITTED)]
        if lists:
            names = []
            for f in lists:
                with system.open_input_stream(f.path) as file:
                    names += json.loads(file.read())
        else:
            names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        sizes = sorted(((found[n].size, n) for n in names), reverse=True)
        groups: list[Files] = []
        room = 0
        for size, name in sizes:
            if size > room:
                groups.append(Files())
                room = self.bytes_each
            groups[-1].paths.append(f"{self.path}/{name}")
            room -= size
        return groups or [Files()]

    def _passes(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            own = _value(headers, name)
            if own is None:
                return False
            if kind == "is" and own != value or kind == "in" and own not in value:
                return False
            if kind == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        def wanted(headers: dict[str, str]) -> bool | None:
            return self.with_payload if self._passes(headers) else None

        rows, held = [], 0
        for path in partition.paths:
            system, place = _system(path)
            with system.open_input_file(place) as file:
                for headers, block in _blocks(file, wanted):
                    rows.append(_row(headers, block, self.with_payload))
                    held += len(block)
                    if held > BATCH_BYTES or len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


def _value(headers: dict[str, str], name: str) -> str | None:
    """A header's value; ids stand in angle brackets."""
    value = headers.get(name)
    if value and name in ("warc-record-id", "warc-refers-to"):
        value = value.strip("<>")
    return value


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    row = {name: _value(headers, key) for name, key in NAMED.items()} | {"headers": list(headers.items())}
    length, payload = int(headers.get("content-length", 0)), block
    if _is_http(headers):
        head, _, payload = block.partition(BLANK)
        told = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        length = int(told[1]) if told else length - len(head) - 4
    whole = with_payload and row["record_type"] != "revisit"
    return row | {"payload_length": length, "payload": payload if whole else None}


class WarcSource(DataSource):
    """Options: path; payload=false leaves payloads unread; partitionBytes of files per task."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


# Records of pages


def page_records(pages: DataFrame, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """WARC records of pages (page_id, url, html), one each, in the columns of the source.

    Of equal payloads of at least ``least`` bytes, the one with the smallest
    page_id is a response and the others are revisits of it; all smaller ones
    are responses. A null html is an empty payload, a null url has no target,
    and a null page_id is never the one referred to unless all are null.
    Repeated rows of the smallest id are responses each, an empty table has no
    records, and further columns, whatever they are called, are left out. Ids are
    reduced per digest before the shuffle, and only the join back moves payloads:
    those of at least ``least`` bytes, as no smaller one meets another.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"))
    records = records.withColumns(
        {"payload_length": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)}
    )
    large = records.where(F.col("payload_length") >= least)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    small = records.where(F.col("payload_length") < least).withColumn("first", F.lit(None))
    joined = large.join(firsts.where("n > 1").drop("n"), "digest", "left").unionByName(small)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return joined.select(
        name("page_id").alias("record_id"),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(revisit, name("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        "payload_length",
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_id(column: str):
    """The page_id in a record id; null for a page without one."""
    number = F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1)
    return F.when(number != "", number.cast("long"))
