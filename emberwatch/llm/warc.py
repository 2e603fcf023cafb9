"""WARC archives as a Spark data source, written and read in Python.

    spark.dataSource.register(Warc)
    pages.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").load(folder).where("record_type = 'response'")

Each record is one gzip member that says in its header how long it is (the `sl` extra field), so a reader passes over
records without unpacking them. Files from other writers, without that field or not packed at all, are read as well.
"""

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains,
    StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Columns of a record. `content` is null when the option `payload` is false or the record has none.
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, payload_digest string, "
    "refers_to string, content_type string, length long, payload_length long, content binary"
)
#: Columns that a predicate may be pushed to, and the header field each comes from.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
}
GZIP = b"\x1f\x8b\x08"
DATE = "2026-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(
    kind: str, record_id: str, uri: str | None, sha1: str, payload: bytes | None, refers_to: str | None, length: int,
    date: str = DATE,
) -> bytes:
    """One record, unpacked. The block is an HTTP answer; that of a revisit ends after the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        # A line end inside an address would end the field.
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {IDENTICAL}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its packed and plain length in the extra field `sl`."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = GZIP + b"\x04" + b"\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Packed:
    """The plain bytes of the gzip member at a file's position, unpacked as far as they are asked for."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data, self.used, self.size = source, start, b"", 0, None
        self.pack = zlib.decompressobj(31)
        source.seek(start)
        self.waiting = source.read(4096)
        if self.waiting[3] & 4 and self.waiting[12:14] == b"sl":
            self.size = struct.unpack("<I", self.waiting[16:20])[0]

    def _more(self) -> bytes:
        raw = self.waiting or self.source.read(1 << 18)
        out = self.pack.decompress(raw, 1 << 20)
        self.waiting = self.pack.unconsumed_tail
        self.used += len(raw) - len(self.waiting) - len(self.pack.unused_data)
        if not raw and not out and not self.pack.eof:
            raise EOFError("a gzip member breaks off")
        return out

    def until(self, done) -> bytes:
        """Unpack until done(data) holds or the member ends."""
        while not done(self.data) and not self.pack.eof:
            self.data += self._more()
        return self.data

    def end(self) -> int:
        """Where the next member starts; without the length in the header the rest has to be unpacked."""
        if self.size is not None:
            return self.start + self.size
        while not self.pack.eof:
            self._more()
        return self.start + self.used


class _Plain:
    """As _Packed, for a record that is not packed."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data, self.block_end = source, start, b"", 0
        source.seek(start)

    def until(self, done) -> bytes:
        while not done(self.data):
            raw = self.source.read(1 << 16)
            if not raw:
                break
            self.data += raw
        return self.data

    def end(self) -> int:
        return self.start + (self.block_end + 4 if self.block_end else max(len(self.data), 1))


def _fields(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    return fields


def records(source, wanted, payload: bool) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(fields, payload length, payload) of the records of an open file whose fields `wanted` accepts. Payloads that are
    read are held against their digest.

    The header is parsed first; blocks of records that are not wanted, and all blocks when `payload` is false, are
    passed over, unpacked only as far as the HTTP header that tells the payload's length.
    """
    at, size = 0, source.size()
    while at < size:
        source.seek(at)
        packed = source.read(3) == GZIP
        reader = _Packed(source, at) if packed else _Plain(source, at)
        data = reader.until(lambda d: b"\r\n\r\n" in d)
        split = data.find(b"\r\n\r\n")
        if split < 0:
            if data.strip():
                raise ValueError(f"no record at {at}")
            at = reader.end()
            continue
        fields = _fields(data[:split])
        length, body = int(fields.get("content-length", 0)), split + 4
        reader.block_end = body + length
        if wanted(fields):
            http = "application/http" in fields.get("content-type", "")
            if payload:
                data = reader.until(lambda d: len(d) >= body + length)
            elif http:
                data = reader.until(lambda d: len(d) >= body + length or b"\r\n\r\n" in d[body:])
            block = data[body : body + length]
            cut = block.find(b"\r\n\r\n") + 4 if http and b"\r\n\r\n" in block else 0
            told = _fields(block[:cut]).get("content-length", "") if cut else ""
            full = int(told) if told.isdigit() else length - cut
            own = payload and fields.get("warc-type") != "revisit"
            content = block[cut:] if own else None
            digest = fields.get("warc-payload-digest", "")
            if content is not None and digest.startswith("sha1:") and digest[5:] != base32_sha1(content):
                raise ValueError(f"the payload of {fields.get('warc-record-id')} does not have its digest")
            yield fields, full, content
        at = reader.end()


@dataclass
class FilePart(InputPartition):
    """Some files of an archive that one task reads."""

    files: tuple[str, ...]

    def __init__(self, files):
        super().__init__(tuple(files))
        self.files = tuple(files)


def _test(filters: list[Filter]):
    """A test of header fields for the pushed predicates."""
    tests = []
    for f in filters:
        name = HEADERS[f.attribute[0]]
        if isinstance(f, EqualTo):
            tests.append(lambda fields, n=name, v=f.value: fields.get(n) == v)
        elif isinstance(f, In):
            tests.append(lambda fields, n=name, v=frozenset(f.value): fields.get(n) in v)
        elif isinstance(f, StringStartsWith):
            tests.append(lambda fields, n=name, v=f.value: fields.get(n, "").startswith(v))
        else:
            tests.append(lambda fields, n=name, v=f.value: v in fields.get(n, ""))
    return lambda fields: all(test(fields) for test in tests)


class WarcReader(DataSourceReader):
    """Options: path; payload (default true), false leaves `content` null and blocks unread; partitionBytes (default
    64 MB), the size of files that one task takes together."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.most = int(options.get("partitionBytes", 64_000_000))
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            known = isinstance(f, (EqualTo, In, StringStartsWith, StringContains))
            if known and len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "payload_digest":
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, path = fs.FileSystem.from_uri(self.path)
        infos = [x for x in files.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file]
        lists = [x for x in infos if x.base_name.startswith("_committed-")]
        if lists:  # written by WarcWriter: files of lost tasks are in no list
            named = set()
            for x in lists:
                with files.open_input_file(x.path) as source:
                    named |= set(json.loads(source.read()))
            infos = [x for x in infos if x.base_name in named]
        infos = sorted((x for x in infos if x.base_name.endswith((".warc", ".warc.gz"))), key=lambda x: x.path)
        parts, held, size = [], [], 0
        for x in infos:
            if held and size + x.size > self.most:
                parts.append(FilePart(held))
                held, size = [], 0
            held.append(x.path)
            size += x.size
        return [*parts, FilePart(held)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(self.path)
        wanted, rows, size = _test(self.pushed), [], 0
        for path in partition.files:
            with files.open_input_file(path) as source:
                for fields, length, content in records(source, wanted, self.payload):
                    digest = fields.get("warc-payload-digest")
                    rows.append(
                        [fields.get(HEADERS[c]) for c in ("record_type", "record_id", "target_uri", "date")]
                        + [digest and digest.removeprefix("sha1:")]
                        + [fields.get(HEADERS[c]) for c in ("refers_to", "content_type")]
                        + [int(fields.get("content-length", 0)), length, content]
                    )
                    size += len(content or b"") + 300
                    if size > 8_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)


_KINDS = [pa.string()] * 7 + [pa.int64()] * 2 + [pa.binary()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes columns record_type, record_id, target_uri, payload_sha1 (hex), payload, refers_to and payload_length.

    A task starts a new file after `fileBytes`. Names are new in each attempt; the files of tasks that succeeded are
    listed when the job commits, and readers go by the lists.
    """

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("fileBytes", 32_000_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = fs.FileSystem.from_uri(self.path)
        files.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        columns = ("record_type", "record_id", "target_uri", "payload_sha1", "payload", "refers_to", "payload_length")
        for batch in iterator:
            for row in zip(*(batch[c].to_pylist() for c in columns)):
                if out is None or size > self.most:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = files.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                size += out.write(member(record(*row)))
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = fs.FileSystem.from_uri(self.path)
        files.create_dir(path, recursive=True)
        names = [name for message in messages if message for name in message.files]
        with files.open_output_stream(f"{path}/_committed-{uuid.uuid4().hex}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, path = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.files if message else ():
                files.delete_file(f"{path}/{name}")


class Warc(DataSource):
    """The data source `warc`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))
