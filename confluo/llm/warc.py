"""WARC records in ZIP-packaged archives, read by range without extraction.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip member per record), its index
``indexes/index.cdxj`` and ``datapackage.json``. The reader parses the end record, the ZIP64 records and the central
directory, finds where a stored member's bytes lie, and then reads single records by offset and length.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, tune
from .tokenfile import filesystem

DATA, CDX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: A task starts another archive after so many bytes.
ARCHIVE_BYTES = 1 << 30
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

# --- ZIP ---------------------------------------------------------------------------------------------------------------

_END = struct.Struct("<4s4H2LH")
_LOCATOR = struct.Struct("<4sLQL")
_END64 = struct.Struct("<4sQ2H2L4Q")
_CENTRAL = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int


class Archive:
    """The members of a ZIP file that allows random access; nothing is extracted."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.file = self.fs.open_input_file(self.path)
        self.members = {m.name: m for m in self._directory()}

    def read_at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _directory(self) -> Iterator[Member]:
        size = self.file.size()
        tail_at = max(0, size - _END.size - 0xFFFF)
        tail = self.read_at(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError(f"{self.path} has no ZIP end record")
        _, _, _, _, count, length, start, _ = _END.unpack_from(tail, at)
        if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail_at + at >= _LOCATOR.size:
            mark, _, end64, _ = _LOCATOR.unpack(self.read_at(tail_at + at - _LOCATOR.size, _LOCATOR.size))
            if mark == b"PK\x06\x07":
                _, _, _, _, _, _, _, count, length, start = _END64.unpack(self.read_at(end64, _END64.size))
        raw, at = self.read_at(start, length), 0
        for _ in range(count):
            mark, _, _, _, method, _, _, _, packed, full, n, extra, note, _, _, _, header = _CENTRAL.unpack_from(raw, at)
            if mark != b"PK\x01\x02":
                raise ValueError(f"{self.path} has a broken central directory")
            at += _CENTRAL.size
            name = raw[at : at + n].decode()
            full, packed, header = self._wide(raw[at + n : at + n + extra], full, packed, header)
            at += n + extra + note
            yield Member(name, method, packed, full, header)

    @staticmethod
    def _wide(extra: bytes, *values: int) -> list[int]:
        """Values that do not fit into 32 bits stand in the ZIP64 field, in this order."""
        at, out = 0, list(values)
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<2H", extra, at)
            if kind == 1:
                field = at + 4
                for k, v in enumerate(out):
                    if v == 0xFFFFFFFF:
                        out[k] = struct.unpack_from("<Q", extra, field)[0]
                        field += 8
            at += 4 + size
        return out

    def begins(self, name: str) -> int:
        """Where a stored member's bytes begin in the file."""
        m = self.members[name]
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} in {self.path} is compressed; only stored members can be read by range")
        mark, *_, n, extra = _LOCAL.unpack(self.read_at(m.header, _LOCAL.size))
        if mark != b"PK\x03\x04":
            raise ValueError(f"{self.path} has a broken local header")
        return m.header + _LOCAL.size + n + extra

    def whole(self, name: str) -> bytes:
        return self.read_at(self.begins(name), self.members[name].size)

    def close(self) -> None:
        self.file.close()


# --- WARC --------------------------------------------------------------------------------------------------------------


def record(kind: str, rid: str, url: str, block: bytes, payload_digest: str, more: dict[str, str]) -> bytes:
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": DATE, "WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{payload_digest}",
        **more, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_fields(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:]) if k}


@dataclass(frozen=True)
class Record:
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = parse_fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(fields, parse_fields(http), payload)


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"


def page_of(urn: str | None) -> int | None:
    urn = (urn or "").strip("<>")
    return int(urn.removeprefix("urn:page:")) if urn.startswith("urn:page:") else None


class _Sink:
    """A stream that only grows, as object stores offer."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class ArchiveWriter:
    def __init__(self, path: str):
        fs, where = filesystem(path)
        fs.create_dir(os.path.dirname(where), recursive=True)
        self.path, self.out = path, fs.open_output_stream(where)
        self.zip = zipfile.ZipFile(_Sink(self.out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, url: str, kind: str, raw: bytes) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = pack.compress(raw) + pack.flush()
        self.member.write(data)
        self.index.append(f"{url} 20240101000000 " + json.dumps({"url": url, "type": kind, "offset": str(self.at), "length": str(len(data))}))
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(CDX, "\n".join(self.index))
        self.zip.writestr(PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": CDX}]}))
        self.zip.close()
        self.out.close()


def records(archive: Archive, start: int = 0, end: int | None = None) -> Iterator[Record]:
    """The records of the index from number ``start`` to before ``end``, each read by its range."""
    base = archive.begins(DATA)
    lines = archive.whole(CDX).decode().split("\n")
    for line in lines[start:end]:
        if line:
            entry = json.loads(line[line.index("{") :])
            raw = archive.read_at(base + int(entry["offset"]), int(entry["length"]))
            yield parse_record(zlib.decompress(raw, 31))


# --- tables --------------------------------------------------------------------------------------------------------------

#: Payloads of fewer bytes are always stored whole.
REVISIT_BYTES = 1000


def decided(pages: DataFrame) -> DataFrame:
    """pages with payload, digest, and the page_id (top) whose record holds an equal payload, if there are several.

    Only equal payloads of at least REVISIT_BYTES are shared; the largest page_id holds them. The maximum is aggregated
    before the shuffle, and the join is by digest, whose hot values AQE splits.
    """
    rows = pages.selectExpr("cast(page_id as long) as page_id", "coalesce(url, '') as url", "coalesce(html, '') as html")
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    tops = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("c")).where("c > 1").drop("c")
    return rows.drop("n").join(tops, "digest", "left")


def write(pages: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write one record per page into archives in ``folder``; return the archives with their numbers of records.

    Rows that repeat page_id and payload of the holder are responses too. A null page_id revisits a holder that has one.
    A repeated attempt of a task writes under another name, and only the archives returned count.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, made = None, []
        for batch in batches:
            for page_id, url, html, digest, top in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if writer is None or writer.at > ARCHIVE_BYTES:
                    if writer is not None:
                        writer.close()
                        made.append((writer.path, len(writer.index)))
                    writer = ArchiveWriter(f"{folder}/pages-{uuid.uuid4().hex}.wacz")
                payload = html.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                url = "".join(url.split()) or "urn:none"
                if top is not None and top != page_id:
                    more = {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{page_urn(top)}>"}
                    writer.add(url, "revisit", record("revisit", page_urn(page_id), url, http, digest, more))
                else:
                    writer.add(url, "response", record("response", page_urn(page_id), url, http + payload, digest, {}))
        if writer is not None:
            writer.close()
            made.append((writer.path, len(writer.index)))
        cols = list(zip(*made)) if made else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["path", "n"])

    rows = decided(pages).select("page_id", "url", "html", "digest", "top")
    return sorted(map(tuple, rows.mapInArrow(run, "path string, n long").collect()))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Records of one reading task.
READ_RECORDS = 4096


def read(spark: SparkSession, archives: list[tuple[str, int]]) -> DataFrame:
    """Every record of the archives; payloads are compared with the digests in their headers."""
    parts = [(p, k, min(k + READ_RECORDS, n)) for p, n in archives for k in range(0, n, READ_RECORDS)]
    if not parts:
        return spark.createDataFrame([], READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                archive, rows = Archive(path), []
                for r in records(archive, start, end):
                    digest = r.fields["warc-payload-digest"].removeprefix("sha1:")
                    kind, size = r.fields["warc-type"], int(r.http["content-length"])
                    if kind == "response" and (hashlib.sha1(r.payload).hexdigest() != digest or len(r.payload) != size):
                        raise ValueError(f"{path}: the payload of {r.fields['warc-record-id']} is broken")
                    rows.append((page_of(r.fields["warc-record-id"]), r.fields["warc-target-uri"], size, digest, kind, page_of(r.fields.get("warc-refers-to"))))
                archive.close()
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, min(len(parts), 4096))
    return spark.createDataFrame(parts, "path string, start long, end long").repartition(n).mapInArrow(run, READ)


def written_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` and read them back; null html counts as empty, an empty table gives no rows."""
    spark = pages.sparkSession
    return read(spark, write(pages, folder or shared_dir(spark, "warc")))
