"""WARC records in ZIP-packaged archives: written by tasks, read back by byte ranges.

An archive is a ZIP file with two stored members: `archive/data.warc.gz` (a gzip member per record, so that each
can be read alone) and `indexes/index.cdxj` (a line per record with its offset and length). The reader finds the
end-of-central-directory record, follows it to the ZIP64 one where the plain fields are full, walks the central
directory and the local headers to the stored members, reads the index, and fetches only the ranges it names:
nothing is unpacked to disk. Records are read in chunks of an index, so that one large archive feeds many tasks.

Archives go to the folder named in `spark.checkpoint.dir` through the file system that its URI names. A task
writes under a name of its own attempt, and only the names in the written manifest are ever read, so a task
that runs twice leaves an unused file and no double rows.

Nulls: a null payload is empty; a null URL gives a record without target; a null id is kept, last in order.
Repeated rows are records of their own; of rows with equal payload, every one with the smallest id is a
response. Other columns are ignored. No rows: no archives.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from oddsloom.session import settle, shared_folder

#: Payloads below this many bytes are always written in full.
REVISIT_BYTES = 100
#: An archive is closed once its data member has so many bytes.
ARCHIVE_BYTES = 256 << 20
#: Index lines read by one task at a time.
CHUNK_LINES = 2_000
#: Records closer than this are fetched in one read.
GAP_BYTES = 1 << 16
READ_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = StructType().add("path", "string").add("bytes", "long").add("records", "long")
_CHUNK = StructType().add("path", "string").add("data_offset", "long").add("offset", "long").add("length", "long").add("first", "long")
_RECORD = (
    StructType().add("page_id", "long").add("record_type", "string").add("refers_to", "long").add("url", "string")
    .add("payload_bytes", "long").add("payload_digest", "string").add("intact", "boolean").add("payload", "binary")
)


# --- records -------------------------------------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str, date: str = DATE) -> bytes:
    """A response record, or a revisit of `refers_to` that carries the HTTP header and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def parse_record(raw: bytes) -> tuple:
    """The row of a record: id, type, referred id, URL, payload size, digest, whether they agree, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told, size = warc["warc-payload-digest"].partition(":")[2], int(_fields(http)["content-length"])
    number = lambda s: int(s[10:-1]) if s and len(s) > 11 else None  # noqa: E731  <urn:page:N>
    revisit = warc["warc-type"] == "revisit"
    digest = told if revisit else hashlib.sha256(payload).hexdigest()
    return (
        number(warc["warc-record-id"]), warc["warc-type"], number(warc.get("warc-refers-to")), warc.get("warc-target-uri"),
        size if revisit else len(payload), digest, digest == told and (revisit or len(payload) == size), None if revisit else payload,
    )


# --- archives ------------------------------------------------------------------------------------------------


def _file_system(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


class _Archive:
    """One archive being written: the data member streams out, the index follows it."""

    def __init__(self, folder: str, force_zip64: bool = True):
        self.fs, base = _file_system(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"{uuid.uuid4().hex}.wacz"
        self.out = self.fs.open_output_stream(f"{base}/{self.name}")
        self.zip = zipfile.ZipFile(_Forward(self.out), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=force_zip64)
        self.lines, self.at = [], 0

    def add(self, page_id, raw: bytes) -> None:
        squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = squeeze.compress(raw) + squeeze.flush()
        self.data.write(packed)
        self.lines.append(json.dumps({"id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{x}\n" for x in self.lines))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.name, size, len(self.lines)


class _Forward(io.RawIOBase):
    """A write-only file over an output stream; ZIP then puts sizes behind the data."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


def _write(folder: str, archive_bytes: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = archive or _Archive(folder)
                payload = (html or "").encode()
                archive.add(page_id, record_bytes(page_id, url, payload, refers_to, digest))
                if archive.at >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        for name, size, records in done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([records])], schema=schema)

    return run


# --- reading -------------------------------------------------------------------------------------------------


def read_directory(source, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, offset of the data, stored size) of every member of a ZIP file, by ranged reads."""
    tail_at = max(0, size - 22 - 65535 - 20)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        locator = tail[end - 20 : end]
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = source.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, at = struct.unpack_from("<QQQ", wide, 32)
    directory, members, p = source.read_at(length, at), [], 0
    for _ in range(count):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, packed, plain, n, m, k = struct.unpack_from("<8xH8xIIHHH", directory, p + 2)
        header = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8", "replace")
        extra, q = directory[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide, w = extra[q + 4 : q + 4 + width], 0
                values = [plain, packed, header]
                for i, v in enumerate(values):
                    if v == 0xFFFFFFFF:
                        values[i] = struct.unpack_from("<Q", wide, w)[0]
                        w += 8
                plain, packed, header = values
            q += 4 + width
        local = source.read_at(30, header)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        a, b = struct.unpack_from("<HH", local, 26)
        members.append((name, method, header + 30 + a + b, packed))
        p += 46 + n + m + k
    return members


def _open(path: str):
    fs, name = _file_system(path)
    return fs.open_input_file(name)


def _locate(chunk_lines: int, schema: pa.Schema):
    """Index chunks of archives: where a run of index lines lies, for other tasks to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                with _open(path) as source:
                    members = {name: (method, at, n) for name, method, at, n in read_directory(source, size)}
                    (method, data, _), (stored, at, n) = members[DATA], members[INDEX]
                    if method or stored:
                        raise ValueError(f"{path}: members are not stored")
                    rows, start, p, lines = [], at, at, 0
                    while p < at + n:
                        part = source.read_at(min(READ_BYTES, at + n - p), p)
                        q = part.find(b"\n")
                        while q >= 0:
                            lines += 1
                            if lines % chunk_lines == 0:
                                rows.append((path, data, start, p + q + 1 - start, lines - chunk_lines))
                                start = p + q + 1
                            q = part.find(b"\n", q + 1)
                        p += len(part)
                    if start < at + n:
                        rows.append((path, data, start, at + n - start, lines - lines % chunk_lines))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _fetch(keep_payload: bool, schema: pa.Schema):
    """The records of index chunks, neighbours in one read."""

    def rows_of(source, data: int, lines: list[dict]) -> Iterator[tuple]:
        at = 0
        while at < len(lines):
            first, to = lines[at]["offset"], at + 1
            while to < len(lines) and lines[to]["offset"] - lines[to - 1]["offset"] - lines[to - 1]["length"] <= GAP_BYTES and lines[to]["offset"] + lines[to]["length"] - first <= READ_BYTES:
                to += 1
            raw = source.read_at(lines[to - 1]["offset"] + lines[to - 1]["length"] - first, data + first)
            for x in lines[at:to]:
                yield parse_record(zlib.decompress(raw[x["offset"] - first : x["offset"] - first + x["length"]], 31))
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data, offset, length in zip(*(batch.column(k).to_pylist() for k in ("path", "data_offset", "offset", "length")), strict=True):
                with _open(path) as source:
                    lines = [json.loads(x) for x in source.read_at(length, offset).splitlines()]
                    some, held = [], 0
                    for row in rows_of(source, data, lines):
                        some.append(row if keep_payload else (*row[:7], None))
                        held += len(row[7] or b"")
                        if held >= READ_BYTES or len(some) >= 4096:
                            yield _batch(some, schema)
                            some, held = [], 0
                    if some:
                        yield _batch(some, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# --- operators -----------------------------------------------------------------------------------------------


def revisits(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): which rows repeat the payload of a smaller id.

    The first ids are found from digests alone; the payloads are shuffled once, to meet them."""
    html = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    long = F.octet_length("html") >= least_bytes
    heads = rows.filter(long).groupBy("digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(heads, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to")
    )


def write_archives(rows: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `rows` of `revisits` as archives; returns their manifest (path, bytes, records)."""
    folder = f"{(folder or shared_folder(rows.sparkSession)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    ordered = rows.select("page_id", "url", "html", "digest", "refers_to")
    return settle(ordered.mapInArrow(_write(folder, archive_bytes, to_arrow_schema(_MANIFEST)), _MANIFEST))


def read_archives(manifest: DataFrame, *, keep_payload: bool = True, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """The records of the archives named in a manifest."""
    chunks = manifest.select("path", "bytes").mapInArrow(_locate(chunk_lines, to_arrow_schema(_CHUNK)), _CHUNK)
    return chunks.repartition("path", "first").mapInArrow(_fetch(keep_payload, to_arrow_schema(_RECORD)), _RECORD)


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write every row of `pages` as a record and read the archives back, without the payloads."""
    rows = revisits(pages, id_col=id_col, url_col=url_col, payload_col=payload_col)
    return read_archives(write_archives(rows), keep_payload=False).drop("payload").withColumnRenamed("page_id", id_col)
